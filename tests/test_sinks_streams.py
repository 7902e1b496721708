from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from siftwarden.sinks import grouped, render
from siftwarden.sources import documents, feeds, policies
from siftwarden.streaming import live


def findings(spark):
    rows = [("f1", "R1", "high", "a.py", 3, 'x < "y" & z'), ("f2", "R2", "info", "b|.py", 1, "=1")]
    return spark.createDataFrame(rows, "fingerprint string, rule_id string, severity string, file_path string, line long, snippet string")


def test_sarif(spark):
    doc = json.loads("".join(render.sarif(findings(spark), "tool")))
    run = doc["runs"][0]
    assert [r["ruleId"] for r in run["results"]] == ["R1", "R2"]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["R1", "R2"]
    assert [r["id"] for r in json.loads("".join(render.sarif(findings(spark).withColumn("severity", F.lit("low")), "t")))["runs"][0]["tool"]["driver"]["rules"]] == ["R1", "R2"]


def test_documents_of_groups_are_those_of_each_alone(spark, tmp_path):
    """Made and written by tasks, a group's document is what the writer of one document makes of it; repeated findings stay as many."""
    rows = [(g, *r) for g in (1, 2) for r in [("f1", "R1", "high", "a.py", 3, 'x < "y" & z'), ("f2", "R2", "info", "b|.py", 1, "=1"), ("f2", "R2", "info", "b|.py", 1, "=1"), ("f3", "R1", "low", "c.py", g, "s")]]
    f = spark.createDataFrame(rows, "g int, fingerprint string, rule_id string, severity string, file_path string, line long, snippet string").withColumns({"confidence": F.lit("high"), "category": F.lit("code")})
    keys = spark.createDataFrame([(1,), (2,), (3,)], "g int")
    pieces = grouped.sarif(f, "g", "tool", keys)
    got = {r.g: json.loads(r.document) for r in grouped.documents(pieces, "g").collect()}
    for g in (1, 2, 3):
        assert got[g] == json.loads("".join(render.sarif(f.where(F.col("g") == g), "tool")))
    assert got[3]["runs"][0]["results"] == [] and len(got[1]["runs"][0]["results"]) == 4
    grouped.write(pieces, "g", str(tmp_path / "sarif"), 3)
    text = "".join(p.read_text().replace("\n", "") for p in sorted((tmp_path / "sarif").glob("part-*.txt")))
    decoder, at, told = json.JSONDecoder(), 0, []
    while at < len(text):
        one, at = decoder.raw_decode(text, at)
        told.append(one)
    assert told == [got[1], got[2], got[3]]
    reports = {r.g: json.loads(r.document) for r in grouped.documents(grouped.report(f, "g"), "g").collect()}
    assert reports[1]["total_findings"] == 4 and [x["rule_id"] for x in reports[1]["findings"]] == ["R1", "R1", "R2", "R2"] and reports[1]["severity_counts"]["high"] == 1


def many_findings(spark):
    f = spark.range(400).select((F.col("id") % 5).alias("g"), F.lit("f").alias("fingerprint"), F.lit("R").alias("rule_id"), F.lit("low").alias("severity"), F.lit("a.py").alias("file_path"), (F.col("id") % 40).alias("line"), F.lit("s").alias("snippet"))
    return f.withColumns({"confidence": F.lit("high"), "category": F.lit("code")})


def exchanges(df, capsys):
    df.explain()
    return capsys.readouterr().out.count("Exchange hashpartitioning")


def test_documents_are_dealt_once_to_as_many_tasks_as_are_asked_for(spark, capsys):
    """The pieces of a SARIF document meet by their group, without a join before: groups, rules and then all pieces are dealt."""
    pieces = grouped.sarif(many_findings(spark), "g", "tool")
    docs = grouped.documents(pieces, "g", 7)
    assert exchanges(docs, capsys) == 3
    assert docs.rdd.getNumPartitions() == 7
    assert {r.g: len(json.loads(r.document)["runs"][0]["results"]) for r in docs.collect()} == dict.fromkeys(range(5), 80)


def test_reports_deal_findings_twice(spark, capsys):
    """Sums of a group are made once, its findings meet them in the document: two shuffles."""
    docs = grouped.documents(grouped.report(many_findings(spark), "g"), "g")
    assert exchanges(docs, capsys) == 2
    assert {r.g: len(json.loads(r.document)["findings"]) for r in docs.collect()} == dict.fromkeys(range(5), 80)


def test_reports_in_one_go_are_those_of_pieces(spark, capsys):
    """Sums are made where a group's findings meet, so these are dealt once; repeated findings stay as many, and places that are alike are told apart by the piece."""
    f = many_findings(spark).withColumns({"severity": F.when(F.col("line") % 3 == 0, "critical").when(F.col("line") % 3 == 1, "odd").otherwise("low"), "snippet": F.concat(F.lit('"s'), (F.col("line") % 2).cast("string"))})
    f = f.withColumns({"line": F.col("line") % 4, "g": F.when(F.col("g") > 0, F.col("g"))})
    docs = grouped.report_documents(f, "g")
    assert exchanges(docs, capsys) == 1 and exchanges(grouped.report_documents(f.repartition(7, "g"), "g"), capsys) == 1
    got, want = ({r.g: r.document for r in df.collect()} for df in (docs, grouped.documents(grouped.report(f, "g"), "g")))
    assert got == want and len(got) == 5
    assert {len(json.loads(d)["findings"]) for d in got.values()} == {80}


def test_inventories_of_groups(spark):
    c = spark.createDataFrame([(g, *r) for g in (1, 2) for r in [("python", "a", "1", "pkg:pypi/a@1", "MIT"), ("npm", "b", str(g), f"pkg:npm/b@{g}", "ISC")]], "g int, ecosystem string, name string, version string, purl string, licence string")
    found = findings(spark).withColumns({"g": F.lit(2), "confidence": F.lit("high"), "category": F.lit("code"), "purl": F.lit("pkg:npm/b@1")})
    name = F.concat(F.lit("n"), F.col("g").cast("string"))
    got = {r.g: json.loads(r.document) for r in grouped.documents(grouped.cyclonedx(c, "g", name, found), "g").collect()}
    for g in (1, 2):
        own = c.where(F.col("g") == g)
        want = json.loads("".join(render.cyclonedx(own, found.where(F.col("g") == g), f"n{g}")))
        assert {k: got[g][k] for k in ("serialNumber", "components", "metadata", "vulnerabilities")} == {k: want[k] for k in ("serialNumber", "components", "metadata", "vulnerabilities")}
    assert got[1]["vulnerabilities"] == [] and {x["affects"] == [] for x in got[2]["vulnerabilities"]} == {True}


def test_report_and_baseline(spark, tmp_path):
    f = findings(spark).withColumns({"confidence": F.lit("high"), "category": F.lit("code")})
    stats = spark.sql("select 3 files_scanned, 1 files_skipped, 9 lines_scanned, 0 critical, 1 high, 0 medium, 0 low, 1 info, 2 n_findings, 120 risk_score, 'F' grade")
    doc = json.loads("".join(render.report(f, stats, "t")))
    assert (doc["risk_score_capped"], doc["severity_counts"]["high"], [x["rule_id"] for x in doc["findings"]]) == (100, 1, ["R1", "R2"])
    (tmp_path / "r.json").write_text(json.dumps(doc))
    assert {(r.rule_id, r.line, r.fingerprint_verified) for r in documents.read_json_report(spark, str(tmp_path / "r.json")).collect()} == {("R1", 3, False), ("R2", 1, False)}
    (tmp_path / "foreign.json").write_text('{"other": 1}')
    with pytest.raises(Exception, match="not a findings report"):
        documents.read_json_report(spark, str(tmp_path / "foreign.json")).collect()
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    (tmp_path / "b.json").write_text("".join(render.baseline(render.baseline_entries(f.unionByName(f), now, days=7))))
    rows = documents.read_baseline(spark, str(tmp_path / "b.json")).collect()
    assert sorted((r.fingerprint, str(r.expires_at)[:10]) for r in rows) == [("f1", "2024-01-08"), ("f2", "2024-01-08")]
    with pytest.raises(ValueError):
        render.baseline_entries(f.withColumn("severity", F.lit("critical")), now)
    assert render.baseline_entries(f.withColumn("severity", F.lit("critical")), now, "known").count() == 2


def test_junit_markdown_html(spark):
    f = findings(spark)
    assert 'tests="2" failures="1"' in "".join(render.junit(f, "s"))
    assert "&lt; &quot;y&quot; &amp;" in "".join(render.junit(f, "s"))
    assert list(render.markdown(f, 1))[-1].strip() == "1 more."
    assert "<td>R1</td>" in "".join(render.html(f, "t"))


def test_inventories(spark):
    c = spark.createDataFrame([("python", "a", "1", "pkg:pypi/a@1", "MIT"), ("npm", "b", "2", "pkg:npm/b@2", "ISC")], "ecosystem string, name string, version string, purl string, licence string")
    assert [x["name"] for x in json.loads("".join(render.cyclonedx(c)))["components"]] == ["b", "a"]
    doc = json.loads("".join(render.spdx(c, "n")))
    root, *packages = doc["packages"]
    assert [x["name"] for x in packages] == ["b", "a"] and doc["documentDescribes"] == [root["SPDXID"]]
    assert {(x["spdxElementId"], x["relationshipType"], x["relatedSpdxElementId"]) for x in doc["relationships"]} == {(root["SPDXID"], "DEPENDS_ON", x["SPDXID"]) for x in packages} | {("SPDXRef-DOCUMENT", "DESCRIBES", root["SPDXID"])}
    found = findings(spark).withColumns({"confidence": F.lit("high"), "category": F.lit("code"), "purl": F.when(F.col("rule_id") == "R1", "pkg:npm/b@2").otherwise("pkg:none")})
    doc = json.loads("".join(render.cyclonedx(c, found, "n")))
    assert [x["ref"] for x in doc["dependencies"]] == [render.ROOT, "pkg:npm/b@2", "pkg:pypi/a@1"] and doc["dependencies"][0]["dependsOn"] == ["pkg:npm/b@2", "pkg:pypi/a@1"]
    assert [v["affects"] for v in doc["vulnerabilities"]] == [[{"ref": "pkg:npm/b@2"}], []]
    assert doc["serialNumber"] == json.loads("".join(render.cyclonedx(c, None, "n")))["serialNumber"] != json.loads("".join(render.cyclonedx(c, None, "m")))["serialNumber"]
    edges = spark.createDataFrame([("pkg:pypi/a@1", "pkg:none")], "purl string, needs string")
    assert [(r.problem, r.purl) for r in render.inventory_problems(c.unionByName(c.limit(1)), edges).orderBy("problem").collect()] == [("dangling", "pkg:none"), ("duplicate", "pkg:pypi/a@1")]


def test_prometheus_and_csv(spark, tmp_path):
    df = spark.createDataFrame([('a"b', 2)], "kind string, n long")
    assert render.prometheus(df, "m", ["kind"], "n").first().line == 'm{kind="a\\"b"} 2'
    render.write_csv(findings(spark), str(tmp_path / "c"))
    assert any("'=1" in p.read_text() for p in (tmp_path / "c").glob("*.csv"))


def test_osv_and_baseline(spark, tmp_path):
    rec = {"id": "G-1", "aliases": ["CVE-2"], "summary": "s  t", "affected": [{"package": {"ecosystem": "PyPI", "name": "Foo_Bar"}, "ranges": [{"type": "ECOSYSTEM", "events": [{"introduced": "0"}, {"fixed": "1.2"}]}, {"type": "GIT", "events": [{"introduced": "abc"}]}], "versions": ["9.9"]}], "database_specific": {"severity": "MODERATE"}}
    (tmp_path / "a.json").write_text(json.dumps(rec))
    r = documents.read_osv(spark, str(tmp_path / "a.json")).first()
    assert (r.ecosystem, r.package, r.cve, r.affected, r.severity, r.summary, r.fixed_in) == ("python", "foo-bar", "CVE-2", "<1.2||=9.9", "high", "s t", "1.2")
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "list.json").write_text(json.dumps([rec | {"id": "G-2"}, rec | {"id": "G-3", "withdrawn": "2024"}, {"id": "G-4", "affected": []}]))
    (tmp_path / "many" / "batch.json").write_text(json.dumps({"vulns": [rec | {"id": "G-5"}]}))
    assert sorted(r.id for r in documents.read_osv(spark, str(tmp_path / "many")).collect()) == ["G-2", "G-5"]
    (tmp_path / "b.json").write_text(json.dumps({"fingerprints": ["x", "y"]}))
    assert documents.read_baseline(spark, str(tmp_path / "b.json")).count() == 2


def test_append_new_is_idempotent(spark, tmp_path):
    batch = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    for _ in range(2):
        live.append_new(batch, str(tmp_path / "t"), ["id"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_append_new_reads_its_partitions(spark, tmp_path):
    batch = spark.createDataFrame([(1, "a", "d1"), (2, "b", "d2")], "id long, v string, day string")
    for more in (batch, batch, batch.withColumn("id", F.col("id") + 1)):
        live.append_new(more, str(tmp_path / "t"), ["id", "day"], "day")
    assert sorted((r.id, r.day) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, "d1"), (2, "d1"), (2, "d2"), (3, "d2")]


def test_split_by_contract(spark, tmp_path):
    rows = [(1, "a", '{"k": 1}'), (2, "a", "{}"), (3, "z", "{}"), (None, "a", "{}"), (None, "a", '{"k": 2}'), (5, "a", '{"k": 3}'), (5, "a", "{}")]
    batch = spark.createDataFrame(rows, "event_id long, event_type string, props string")
    live.split_by_contract(batch, {"a": ("k",)}, str(tmp_path / "g"), str(tmp_path / "b"))
    kept = lambda d: sorted(str((r.event_id, r.props)) for r in spark.read.parquet(str(tmp_path / d)).collect())
    assert kept("g") == sorted(map(str, [(1, '{"k": 1}'), (None, '{"k": 2}'), (5, '{"k": 3}')]))
    assert kept("b") == sorted(map(str, [(2, "{}"), (3, "{}"), (None, "{}"), (5, "{}")]))


def test_hourly_stream(spark, tmp_path):
    df = spark.sql("select timestamp_ntz'2024-01-01 00:10:00' as ts, 'a' as event_type union all select timestamp_ntz'2024-01-01 00:50:00', 'a'")
    df.write.parquet(str(tmp_path / "in"))
    run = live.hourly(live.read(spark, str(tmp_path / "in"), df.schema)).writeStream.outputMode("complete").format("memory").queryName("t_hourly").trigger(availableNow=True).start()
    run.awaitTermination()
    assert [(r.event_type, r.n) for r in spark.table("t_hourly").collect()] == [("a", 2)]


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def streamed(spark, tmp_path, batches, make):
    """All rows that a stream over these batches, one file and micro-batch each, gives out."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out = []
    try:
        for k, batch in enumerate(batches):
            batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            run = make(stream).writeStream.outputMode("update").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            run.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return out


def test_rate_limit_stream_matches_the_formula(spark, tmp_path):
    from siftwarden.operators import events

    hits = [("k", 1000), ("k", 1010), ("j", 1011), ("k", 1061), ("j", 1071), ("k", 1062)]
    table = lambda rows: spark.createDataFrame([(k, a * 1_000_000) for k, a in rows], "key string, at long")
    hits += [("i", 9000), ("k", 9001)]  # long after, so that what k had is gone
    got = streamed(spark, tmp_path, [table(hits[:3]), table(hits[3:6]), table(hits[6:7]), table(hits[7:])], lambda s: live.rate_limited(s, 60))
    want = events.rate_limited(table(hits), "key", F.col("at"), [], 2, 60).collect()
    assert sorted((r.key, r["at"], r.n_hits) for r in got) == sorted((r.key, r["at"], r.n_hits) for r in want)


def test_job_stream(spark, tmp_path):
    s = 1_000_000
    table = lambda rows: spark.createDataFrame(rows, "job_id string, at long, outcome string")
    first = [("a", 0, "enqueued"), ("a", 1 * s, "claimed"), ("a", 2 * s, "failed"), ("a", 3 * s, "claimed"), ("b", 0, "enqueued"), ("b", 1, "succeeded")]
    then = [("a", 7 * s, "claimed"), ("a", 8 * s, "failed"), ("a", 99 * s, "claimed"), ("a", 100 * s, "failed"), ("a", 101 * s, "enqueued"), ("b", 2, "claimed"), ("b", 3, "succeeded"), ("b", 4, "claimed")]
    got = streamed(spark, tmp_path, [table(first), table(then)], lambda x: live.job_states(x, 3))
    a = [(r.status, r.attempts, r.due // s) for r in sorted(got, key=lambda r: r["at"]) if r.job_id == "a"]
    # not due at 3, due at 7 after 5 seconds; then 10 seconds; then its three attempts are used up
    assert a == [("queued", 0, 0), ("running", 1, 0), ("queued", 1, 7), ("running", 2, 7), ("queued", 2, 18), ("running", 3, 18), ("failed", 3, 18)]
    assert [r.status for r in sorted(got, key=lambda r: r["at"]) if r.job_id == "b"] == ["queued", "running", "succeeded"]


def test_rate_limit_stream_with_resets(spark, tmp_path):
    """A success clears what a key has, in the stream as on a table, also across batches and stretches of time."""
    from siftwarden.operators import events

    hits = [("k", 1000, False), ("k", 1001, True), ("k", 1002, False), ("j", 1003, True), ("k", 1010, False), ("j", 1011, False), ("k", 1030, True), ("k", 3839, False), ("k", 3841, False), ("k", 3842, True), ("k", 3843, False)]
    table = lambda rows: spark.createDataFrame([(k, a * 1_000_000, r) for k, a, r in rows], "key string, at long, reset boolean")
    got = streamed(spark, tmp_path, [table(hits[:4]), table(hits[4:])], lambda s: live.rate_limited(s, 60))
    want = events.rate_limited(table(hits), "key", F.col("at"), ["at"], 2, 60, reset=F.col("reset")).collect()
    assert sorted((r.key, r["at"], r.n_hits) for r in got) == sorted((r.key, r["at"], r.n_hits) for r in want)
    assert {(r.key, r["at"] // 1_000_000): r.n_hits for r in want} == dict(zip([h[:2] for h in hits], [1, 2, 1, 1, 2, 1, 3, 1, 2, 3, 1]))


def test_rate_limit_of_a_hot_key_in_stretches(spark, monkeypatch):
    import random

    from siftwarden.operators import events

    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.9 else "b", rng.randrange(2_000) * 500_000, i) for i in range(800)]
    monkeypatch.setattr(events, "STRETCH", 2)
    got = {r.i: (r.n_hits, r.allowed, r.retry_after) for r in events.rate_limited(spark.createDataFrame(rows, "key string, at long, i int"), "key", F.col("at"), ["i"], 5, 7).collect()}
    for key, at, i in rows:
        inside = sorted((a, j) for k, a, j in rows if k == key and at - 7_000_000 < a <= at)
        last = [a for a, j in inside if (a, j) <= (at, i)][-5:]
        assert got[i] == (len(inside), len(inside) <= 5, None if len(inside) <= 5 else max(1, (last[0] + 7_000_000 - at) // 1_000_000 + 1))
    assert len(got) == len(rows)


def test_job_stream_reclaims_stale_jobs(spark, tmp_path):
    """A timer queues a job of which nothing is heard, once; a late report finds it queued; the same as on the table of reports."""
    from siftwarden.operators import events

    s = 1_000_000
    table = lambda rows: spark.createDataFrame(rows, "job_id string, at long, outcome string")
    one = [("a", 0, "enqueued"), ("a", 10 * s, "claimed"), ("b", 0, "enqueued"), ("b", 20 * s, "claimed"), ("c", 0, "enqueued"), ("c", 30 * s, "claimed")]
    two = [("b", 900 * s, "succeeded"), ("c", 1000 * s, "succeeded"), ("x", 3000 * s, "enqueued")]
    three = [("a", 3100 * s, "claimed"), ("x", 3200 * s, "claimed"), ("y", 9000 * s, "enqueued")]
    got = streamed(spark, tmp_path, [table(one), table(two), table(three), table([("y", 9001 * s, "claimed")])], lambda x: live.job_states(x))
    by = {j: [(r["at"] // s, r.status, r.attempts) for r in sorted(got, key=lambda r: r["at"]) if r.job_id == j] for j in "abcx"}
    assert by["a"] == [(0, "queued", 0), (10, "running", 1), (910, "queued", 1), (3100, "running", 2), (4000, "queued", 2)]
    assert by["b"] == [(0, "queued", 0), (20, "running", 1), (900, "succeeded", 1)]
    assert by["c"] == [(0, "queued", 0), (30, "running", 1), (930, "queued", 1)]
    want = {(r.job_id, r.reclaimed_at) for r in events.reclaims(table(one + two + three), F.lit(9000 * s)).collect()}
    assert {(r.job_id, r["at"]) for r in got if r.status == "queued" and r["at"] == r.due and r.attempts} == want


def test_late_events_are_told_apart_and_counted(spark, tmp_path):
    table = lambda rows: spark.sql("select cast(t as timestamp_ntz) as ts, e as event_type from values " + ", ".join(f"('2024-01-01 {t}', '{e}')" for t, e in rows) + " as v(t, e)")
    batches = [[("01:00:00", "a"), ("03:30:00", "a")], [("03:00:00", "a"), ("01:59:59", "a"), ("02:31:00", "b"), ("05:00:00", "b")], [("01:00:00", "b"), ("04:10:00", "a")]]
    place = str(tmp_path / "p")
    for k, rows in enumerate(batches):
        table(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(table(rows).schema).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(lambda df, n: live.split_late(df, n, place, 3600)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    live.split_late(table(batches[2]), 2, place, 3600)  # a batch that runs again
    hours = {(r.hour.hour, r.event_type): (r.n, r.closed) for r in live.hours_kept(spark, place, 3600).collect()}
    assert hours == {(1, "a"): (1, True), (3, "a"): (2, True), (2, "b"): (1, True), (5, "b"): (1, False), (4, "a"): (1, False)}
    assert {r.event_type: r.n for r in live.late_counts(spark, place).collect()} == {"a": 1, "b": 1}


def test_replayed_events_once(spark, tmp_path):
    """An event that comes again within the watermark is dropped by the stream, one that comes after it by the target."""
    table = lambda rows: spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, d) as ts, id, v from values " + ", ".join(f"({d}, {i}, '{v}')" for d, i, v in rows) + " as t(d, id, v)")
    place, seen = str(tmp_path / "out"), []

    def keep(df, _):
        seen.append(sorted(r.id for r in df.collect()))
        live.append_new(df, place, ["id"])

    for rows in ([(0, 1, "a"), (0, 2, "b"), (0, 1, "a")], [(0, 2, "b"), (1, 3, "c")], [(9, 4, "d")], [(9, 1, "a"), (9, 4, "d")]):
        table(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = live.once(spark.readStream.schema(table(rows).schema).parquet(str(tmp_path / "in")), ["id"], "2 days")
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert [x for x in seen if x] == [[1, 2], [3], [4], [1]]
    assert sorted(r.id for r in spark.read.parquet(place).collect()) == [1, 2, 3, 4]


def test_verified_report(spark, tmp_path):
    from siftwarden.functions import text as T

    f = findings(spark).withColumn("category", F.lit("code"))
    f = f.withColumn("fingerprint", F.when(F.col("rule_id") == "R1", T.fingerprint(F.col("rule_id"), F.col("file_path"), F.col("snippet"), F.col("category"))).otherwise("bad"))
    render.write_jsonl(f, str(tmp_path / "r"))
    assert {r.rule_id: r.fingerprint_verified for r in documents.read_report(spark, str(tmp_path / "r")).collect()} == {"R1": True, "R2": False}


def test_feeds(spark, tmp_path):
    own = lambda i: {"id": i, "cve": f"CVE-{i}", "affected": "<1", "severity": "high", "summary": "s", "fixed_in": "1"}
    osv = {"id": "G-1", "affected": [{"package": {"ecosystem": "PyPI", "name": "C"}, "ranges": [{"type": "ECOSYSTEM", "events": [{"introduced": "0"}, {"fixed": "2"}]}]}]}
    (tmp_path / "base.json").write_text(json.dumps({"_note": "x", "python": {"A_b": [own("1")], "c": [own("2")]}, "npm": {"A": [own("3"), own("4")]}}))
    over = tmp_path / "over"
    over.mkdir()
    (over / "1.json").write_text(json.dumps({"python": {"a-b": [own("5")]}, "npm": {"z": [own("6")]}}))
    (over / "2.json").write_text(json.dumps({"python": {"A.B": [own("7"), own("8")]}}))
    (over / "3.json").write_text(json.dumps(osv))
    (over / "bad.json").write_text("{")
    base = feeds.read_bundle(spark, str(tmp_path / "base.json"))
    assert sorted((r.ecosystem, r.package, r.id) for r in base.collect()) == [("npm", "a", "3"), ("npm", "a", "4"), ("python", "a-b", "1"), ("python", "c", "2")]
    both = feeds.read_overlay(spark, str(over), base)
    assert sorted((r.ecosystem, r.package, r.id) for r in both.collect()) == [("npm", "a", "3"), ("npm", "a", "4"), ("npm", "z", "6"), ("python", "a-b", "7"), ("python", "a-b", "8"), ("python", "c", "G-1")]
    assert {r.ecosystem: (r.packages, r.advisories, r.with_cve, r.with_fix) for r in feeds.import_stats(both).collect()} == {"npm": (2, 3, 3, 3), "python": (2, 3, 2, 3)}
    assert {(r.package, len(json.loads(r.advisories))) for r in feeds.export_pieces(both).collect()} == {("a", 2), ("z", 1), ("a-b", 2), ("c", 1)}
    (tmp_path / "l.json").write_text(json.dumps({"python": {"x": "MIT"}}))
    assert [tuple(r) for r in feeds.read_licences(spark, str(tmp_path / "l.json")).collect()] == [("python", "x", "MIT")]


def test_policy_documents(tmp_path):
    doc = {"version": 1, "fail_on": "HIGH", "severity_gates": {"critical": 0}, "rules": {"ignore": ["A"], "severity_overrides": {"B": "Low"}, "min_confidence": "medium"}, "licenses": {"blocked": ["GPL-3.0"], "unknown": "block"}, "blocked_dependencies": [{"name": "x", "reason": "r"}], "engines": {"enabled": ["iac", "secrets"]}, "entropy_threshold": 4.0}
    (tmp_path / "p.json").write_text(json.dumps(doc))
    p = policies.policy_of(policies.document(str(tmp_path / "p.json")))
    assert (p.fail_on, p.gates, p.overrides, p.blocked, p.engines) == ("high", {"critical": 0}, {"B": "low"}, (("*", "x", "r"),), ("iac", "secrets"))
    bad = {"version": 2, "fail_on": "x", "severity_gates": {"huge": -1, "low": True}, "rules": [], "licenses": {"allowed": ["MIT"], "blocked": ["MIT"], "unknown": "?"}, "blocked_dependencies": [{}], "engines": {"enabled": ["none"]}, "max_risk_score": -1}
    with pytest.raises(policies.Refused) as e:
        policies.policy_of(bad)
    assert len(e.value.problems) >= 9
    s = policies.under(policies.settings_of(environment={}), p)
    assert (s.engines, s.ignored, s.min_confidence, s.entropy_threshold, s.unknown_licence) == (("secrets", "iac"), ("A",), "medium", 4.0, "block")


def test_settings_precedence(tmp_path):
    (tmp_path / "org.json").write_text(json.dumps({"min_severity": "low", "entropy_threshold": 4.0, "ignored": ["A"]}))
    (tmp_path / "project.json").write_text(json.dumps({"min_severity": "medium", "unknown": 1}))
    env = {"SIFTWARDEN_ENTROPY_THRESHOLD": "3.5", "SIFTWARDEN_ENGINES": "iac, secrets", "SIFTWARDEN_MIN_CONFIDENCE": ""}
    s = policies.settings_of(str(tmp_path / "org.json"), str(tmp_path / "project.json"), str(tmp_path / "none.json"), environment=env, ignored=["B"])
    assert (s.min_severity, s.entropy_threshold, s.engines, s.ignored, s.min_confidence) == ("medium", 3.5, ("iac", "secrets"), ("B",), "low")
    assert policies.settings_of(environment={"SIFTWARDEN_ENTROPY_THRESHOLD": "x"}).entropy_threshold == 4.3


def test_allowed_hosts():
    from siftwarden.operators import events

    assert events.allowed_hosts(None, None) is None and events.allowed_hosts(["a.b"], None) == ["a.b"]
    assert events.allowed_hosts(["*.b.c", "x.y", "d.e"], ["a.b.c", "*.y", "d.e", "q"]) == ["a.b.c", "d.e", "x.y"]
