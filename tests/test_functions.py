from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from siftwarden.functions import licences as L, severity as S, text as T, versions as V
from siftwarden.operators import advisories, baseline, detect, events, findings as ops, manifests, policy, pyast, store
from siftwarden.plans import of_findings
from siftwarden.sources import files, rules


def one(spark, value, *cols):
    return spark.createDataFrame([(value,)], "v string").select(*cols).first()[0]


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x85e f", "\n\n", "x\n\ny"])
def test_lines_as_splitlines(spark, text):
    assert one(spark, text, T.lines(F.col("v"))) == text.splitlines()


def test_fingerprint(spark):
    want = hashlib.sha256(("R|a.py|" + "x=1" + "|code").encode()).hexdigest()[:16]
    assert one(spark, " x\t= \x1c1\n", T.fingerprint(F.lit("R"), F.lit("a.py"), F.col("v"), F.lit("code"))) == want


@pytest.mark.parametrize("text,bits", [("aabb", 1.0), ("aaaa", 0.0), ("abcd", 2.0)])
def test_entropy(spark, text, bits):
    assert math.isclose(one(spark, text, T.entropy(F.col("v"))), bits)


@pytest.mark.parametrize("cell,want", [("=1", "'=1"), ("-a", "'-a"), ("a=1", "a=1"), ("@x", "'@x")])
def test_csv_safe(spark, cell, want):
    assert one(spark, cell, T.csv_safe(F.col("v"))) == want


@pytest.mark.parametrize("score,grade", [(0, "A+"), (1, "A"), (10, "A"), (11, "B"), (25, "B"), (26, "C"), (50, "C"), (90, "D"), (91, "F"), (5000, "F")])
def test_grade(spark, score, grade):
    assert one(spark, str(score), S.grade(F.col("v").cast("long"))) == grade


@pytest.mark.parametrize("version,spec,want", [("1.0", "", False), ("1.5", ">=1,<2", True), ("2.0", ">=1,<2", False), ("0.5", "<1||>=3", True), ("1.0.0-alpha", "<1.0.0", True), ("1.0", "!=1.0", False)])
def test_in_range(spark, version, spec, want):
    assert one(spark, version, V.in_range(F.col("v"), F.lit(spec))) is want


def test_first_wins_and_order(spark):
    df = spark.createDataFrame([("f", 2, "b"), ("f", 1, "a"), ("g", 1, "c")], "fingerprint string, seq int, x string")
    assert {r.x for r in ops.first_of(df, ["fingerprint"], ["seq"]).collect()} == {"a", "c"}


def test_first_rows_are_told_by_what_is_asked_for(spark, capsys):
    """Columns that nobody asks for aren't shuffled, nor read."""
    df = spark.createDataFrame([("f", 2, "b"), ("f", 1, "a"), ("g", 1, "c")], "fingerprint string, seq int, x string")
    assert sorted(map(tuple, ops.first_of(df, ["fingerprint"], ["seq"], ["x"]).collect())) == [("a",), ("c",)]
    of_findings.fingerprint_dedupe(spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "l_quantity" in plan and not [c for c in ("l_discount", "l_linestatus", "o_custkey") if c in plan]


@pytest.mark.parametrize("tasks", [None, 5])
def test_resolved_open(spark, tasks):
    """What the last succeeded scan lacks of all that was open before; it has what it calls resolved, too."""
    scans = spark.createDataFrame([(1, 1, "succeeded"), (2, 1, "succeeded"), (3, 1, "running"), (4, 2, "failed")], "scan_id int, project_id int, status string")
    rows = [(1, 1, "a", "open"), (1, 1, "b", "open"), (1, 1, "b", "open"), (1, 1, "c", "resolved"), (1, 1, "e", "open"), (1, 1, "f", None), (2, 1, "a", "open"), (2, 1, "e", None), (3, 1, "d", "open"), (4, 2, "a", "open")]
    gone = store.resolved_open(spark.createDataFrame(rows, "scan_id int, project_id int, fingerprint string, status string"), scans, tasks)
    assert tasks is None or gone.rdd.getNumPartitions() == tasks
    assert [(r.scan_id, r.fingerprint) for r in gone.collect()] == [(1, "b"), (1, "b")]


def test_baseline_boundaries(spark):
    entries = spark.createDataFrame([("a", None), ("b", "2024-01-01"), ("c", "2024-01-02")], "fingerprint string, e string").withColumn("expires_at", F.col("e").cast("timestamp"))
    found = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "fingerprint string")
    got = {r.fingerprint: r.disposition for r in baseline.diff(found, entries, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert got == {"a": "suppressed", "b": "expired", "c": "suppressed", "d": "new"}


def test_policy_problems():
    assert policy.Policy(fail_on="high").problems() == []
    assert len(policy.Policy(fail_on="x", gates={"y": 1, "low": -1}, overrides={"R": "z"}).problems()) == 4


def test_rate_limit_window_is_half_open(spark):
    hits = spark.createDataFrame([("k", 1000), ("k", 1010), ("k", 1061)], "key string, s int")
    got = events.rate_limited(hits, "key", F.col("s") * 1_000_000, ["s"], 1, 60).orderBy("s").collect()
    assert [r.n_hits for r in got] == [1, 2, 2]
    assert [r.allowed for r in got] == [True, False, False]
    assert got[1].retry_after == 61


@pytest.mark.parametrize("host,want", [("a.example.com", True), ("example.com", False), ("badexample.com", False), ("x.org", True), ("", False)])
def test_host_allowed(spark, host, want):
    assert one(spark, host, events.host_allowed(F.col("v"), ["*.example.com", "x.org"])) is want


def test_scoped_refuses(spark):
    with pytest.raises(ValueError):
        store.scoped(spark.range(1), 1)


def test_licence_classes(spark):
    assert one(spark, "MIT OR GPL-3.0", L.classify(F.col("v"))) == "allowed"
    assert one(spark, None, L.classify(F.col("v"))) == "unknown"


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert detect.scan(detect.exploded(none), detect.TEXT_RULES).count() == 0


def test_rule_packs():
    good, bad = rules.pack([{"id": "A", "pattern": "x"}, {"id": "B", "pattern": "("}, {"id": "C"}, {"id": "D", "pattern": "y", "severity": "odd"}])
    assert [r.rule_id for r in good] == ["A"] and len(bad) == 3


@pytest.mark.parametrize("path,language,kind,manifest", [("a/b.py", "python", None, False), ("Dockerfile", "dockerfile", "docker", False), ("k8s/x.yaml", "yaml", "kubernetes", False), ("x/requirements-dev.txt", "other", None, True), ("poetry.lock", "other", None, True), (".env", "dotenv", None, False)])
def test_classify(spark, path, language, kind, manifest):
    r = files.classified(spark.createDataFrame([(path,)], "rel_path string")).first()
    assert (r.language, r.iac_kind, r.is_manifest) == (language, kind, manifest)


def test_read_tree(spark, tmp_path):
    for name, data in {"a.py": b"x = 1\xff\n", "node_modules/b.js": b"y", "poetry.lock": b"z", "c.lock": b"q", ".github/w.yml": b"w", "p/__init__.py": b"1", ".env": b"K=v"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(data)
    got = {r.rel_path: (r.skip_reason, r.content) for r in files.read_tree(spark, str(tmp_path)).collect()}
    assert got["a.py"] == (None, "x = 1\n")
    assert got["poetry.lock"][0] is None and got["c.lock"][0] == "excluded-name"
    assert got["node_modules/b.js"][0] == "excluded-directory"
    assert got["p/__init__.py"] == (None, "1") and got[".env"] == (None, "K=v") and ".github/w.yml" not in got
    assert not files.inside(str(tmp_path), str(tmp_path / ".." / "x"))


def test_read_tree_by_tasks(spark, tmp_path):
    """Hidden files and folders, links out of the tree, files that are too large; a bound on length reaches the walk; nothing is read twice."""
    top = tmp_path / "t"
    for path, text in {"a.py": "x", ".env": "K=1", ".github/w.yml": "no", ".hidden/deep/b.py": "y", "src/one/c.py": "z", "src/two/d.py": "z" * 50, "node_modules/m.js": "m", ".git/config": "g", "_under/e.py": "e"}.items():
        (top / path).parent.mkdir(parents=True, exist_ok=True)
        (top / path).write_text(text)
    (tmp_path / "outside.py").write_text("o")
    (top / "link.py").symlink_to(tmp_path / "outside.py")
    (top / "src/inner.py").symlink_to(top / "a.py")
    got = {r.rel_path: (r.skip_reason, r.content) for r in files.read_tree(spark, str(top)).collect()}
    assert set(got) == {"a.py", ".env", ".hidden/deep/b.py", "src/one/c.py", "src/two/d.py", "src/inner.py", "node_modules/m.js", "_under/e.py"}
    assert got[".env"] == (None, "K=1") and got["node_modules/m.js"] == ("excluded-directory", None) and got["src/inner.py"] == (None, "x")
    reader = files.TreeReader({"path": str(top), "maxbytes": "10"})
    rest = list(reader.pushFilters([files.LessThanOrEqual(("length",), 20), files.LessThanOrEqual(("other",), 1)]))
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(rest) == 1 and len(rows) == len({r[0] for r in rows}) == 7 and "src/two/d.py" not in {r[0] for r in rows}
    reader = files.TreeReader({"path": str(top), "maxbytes": "10"})
    assert {r[0]: r[2] for p in reader.partitions() for r in reader.read(p)}["src/two/d.py"] is None
    assert all(not isinstance(p, files.Folders) or p.top.startswith(str(top)) for p in reader.partitions())



@pytest.mark.parametrize("code,rule", [("import os\ndef f(payload):\n  os.system(payload)", "PY-AST-CMD-INJECTION"), ("import yaml\nyaml.load(x)", "PY-AST-INSECURE-DESERIALIZATION"), ("eval(input())", "PY-AST-EVAL-USE"), ("import os, shlex\ndef f(payload):\n  os.system(shlex.quote(payload))", "PY-AST-SHELL-TRUE"), ("assert user.is_admin", "PY-AST-ASSERT-SECURITY-CHECK"), ("import random\ntoken = random.random()", "PY-AST-INSECURE-RANDOM")])
def test_pyast(code, rule):
    assert rule in {r[1] for r in pyast.findings_of("a.py", code)}


@pytest.mark.parametrize("code", ["def (", "import yaml\nyaml.load(x, Loader=yaml.SafeLoader)", "import subprocess\nsubprocess.run(payload)", "import hashlib\nhashlib.md5(b'', usedforsecurity=False)"])
def test_pyast_quiet(code):
    assert pyast.findings_of("a.py", code) == []


@pytest.mark.parametrize("path,text,want", [("requirements.txt", "a==1\n", [("a", "==1")]), ("yarn.lock", 'a@^1:\n  version "1.2.0"\n', [("a", "1.2.0")]), ("go.sum", "m v1.0.0 h1:x\nm v1.0.0/go.mod h1:y\n", [("m", "v1.0.0")]), ("build.gradle", "implementation 'g:a:1.0'\n", [("g:a", "1.0")])])
def test_manifests(path, text, want):
    assert [(r[3], r[4]) for r in manifests.rows_of(path, text)] == want


@pytest.mark.parametrize("path,text,want", [
    ("a.csproj", '<Project><ItemGroup>\n<PackageReference Include="A" Version="1" /><PackageReference Include="B"><Version>2</Version></PackageReference>\n<PackageReference Include="A" Version="3" /></ItemGroup></Project>', [("A", "1", 2, True), ("B", "2", 2, True), ("A", "3", 3, True)]),
    ("packages.config", '<packages>\n<package id="X" version="1.2" targetFramework="n" />\n</packages>', [("X", "1.2", 2, True)]), ("Gemfile.lock", "GEM\n  specs:\n    rails (7.0.0)\n      rack (>= 2)\n", [("rails", "7.0.0", 3, False)]),
    ("build.gradle.kts", 'implementation("g:a:1.0")\n// api "x:y:1"\napi "g:b:$v", "g:c:2@jar"\n', [("g:a", "1.0", 1, True), ("g:b", None, 3, True), ("g:c", "2", 3, True)]),
])
def test_more_manifests(path, text, want):
    assert [r[3:7] for r in manifests.rows_of(path, text)] == want


def test_redaction(spark):
    texts = ['{"a":{"Password":"x"},"l":[{"api_key":1},2]}', "not json token", '{"k":1}', None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(events.redacted_json(F.col("t"))).collect()]
    assert got == ['{"a":{"Password":"[redacted]"},"l":[{"api_key":"[redacted]"},2]}', "not json token", '{"k":1}', None]


@pytest.mark.parametrize("path,text,error", [("evil.csproj", '<!DOCTYPE x [<!ENTITY a "b">]><Project/>', "MALFORMED"), ("package.json", "{", "MALFORMED"), ("go.mod", "", "EMPTY"), ("setup.py", "x", "UNPARSED"), ("Cargo.toml", "[a]", "NO-DEPENDENCIES"), ("what.ever", "x", "UNRECOGNIZED")])
def test_manifest_errors(path, text, error):
    assert manifests.rows_of(path, text)[0][7].startswith(error)


def test_advisory_match(spark):
    specs = ["==1.0", ">=2", ">=1,<1.4", ">=1", "==1.5", "latest"]
    deps = spark.createDataFrame([("python", n, s) for n, s in zip(["Foo_Bar", "foo.bar", "foo-bar", "foo-bar", "foo-bar", "foo-bar"], specs)], "ecosystem string, name string, spec string")
    adv = spark.createDataFrame([("python", "foo-bar", "X", "<1.5", "1.5")], "ecosystem string, package string, id string, affected string, fixed_in string")
    got = {(r.spec, r.confidence) for r in advisories.matched(deps, adv).collect()}
    # >=2 names a version out of range, >=1 allows the one that mends it
    assert got == {("==1.0", "high"), (">=1,<1.4", "medium")}


def test_time_ranges(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 12:00:00' at, 1 n union all select timestamp_ntz'2024-01-02 23:59:59', 2 union all select null, 3")
    n = lambda *a: sorted(r.n for r in store.between(df, "at", *a).collect())
    assert n(None, None) == [1, 2, 3] and n("2024-01-02", "2024-01-02") == [2] and n("2024-01-01 12:00:00", None) == [1, 2] and n(None, "2024-01-01") == [1]
    with pytest.raises(ValueError):
        store.between(df, "at", "2024-01-02", "2024-01-01")


def test_keyed_and_named_hashes(spark):
    import hmac
    import uuid

    names = ["", "a", "é ü", "x" * 300]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    space = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    for key in (b"k", b"long" * 40):
        got = [tuple(r) for r in df.select(T.uuid5(space, F.col("n")), T.hmac_sha256(key, F.col("n"))).collect()]
        assert got == [(str(uuid.uuid5(uuid.UUID(space), n)), hmac.new(key, n.encode(), hashlib.sha256).hexdigest()) for n in names]


def test_manifest_lines_that_are_wrong():
    rows = manifests.rows_of("requirements.txt", "flask==1\n@@@\n")
    assert [(r[1], r[3], r[5], r[7]) for r in rows] == [("dependency", "flask", 1, None), ("error", None, 2, "UNPARSEABLE-LINE")]
    rows = manifests.rows_of("pom.xml", "<dependency>\n<groupId>g</groupId><artifactId>a</artifactId><version>${v}</version></dependency>")
    assert [(r[1], r[4], r[7]) for r in rows] == [("dependency", None, None), ("error", None, "UNRESOLVED-VERSION: ${v}")]


def test_rule_pack_keys():
    good, bad = rules.pack([{"id": "A", "pattern": "a.b", "multiline": True, "exclude_if_matches": "c"}])
    assert (good[0].whole, good[0].exclude, bad) == (True, "c", [])


@pytest.mark.parametrize("code", ["x = " + " + ".join(["payload"] * 3000), "x = q" + ".f(1)" * 3000, "if a:\n    pass\n" + "elif b:\n    pass\n" * 2000, "x = " + "[" * 150 + "]" * 150, "def f(payload):\n    " + "x = " * 60 + "payload\n" + "    os.system(" + "x" + " + x" * 2500 + ")"])
def test_pyast_goes_through_deep_files(code):
    """Neither deep trees nor what the parser itself can't take end a scan; what lies beside the depth is found."""
    found = pyast.findings_of("a.py", code + "\nimport hashlib\nhashlib.md5(b'x')\n")
    assert found == [("a.py", "PARSER-CRASH", "info", 1, "")] or "PY-AST-WEAK-HASH" in {r[1] for r in found}
    if "os.system" in code:
        assert {"PARSER-CRASH", "PY-AST-CMD-INJECTION"} & {r[1] for r in found}


def test_pyast_of_a_deep_file_in_a_table(spark):
    files = spark.createDataFrame([("deep.py", "x = " + "a + " * 900 + "a\n"), ("bad.py", "eval(x)\n"), ("deeper.py", "x = " + "-" * 90_000 + "1\n")], "rel_path string, content string")
    got = {(r.rel_path, r.rule_id) for r in pyast.scan(files).collect()}
    assert ("bad.py", "PY-AST-EVAL-USE") in got and {p for p, _ in got} <= {"bad.py", "deeper.py"}


def test_busy_packages_are_matched_by_an_index(spark, monkeypatch):
    """The same rows as by pairs, for ranges of all kinds; candidates grow with the matches, not with versions times advisories."""
    import random

    rng = random.Random(6)
    number = lambda: ".".join(str(rng.choice([0, 1, 2, 3, 7, 10, 40, 99_999 * (rng.random() < 0.05)])) for _ in range(rng.randint(1, 4)))
    one = lambda: "".join([rng.choice([">=", ">", "=", "", "!="]), number()]) + rng.choice(["", "," + rng.choice(["<", "<="]) + number()])
    adv = [("npm", "hot", f"A{k}", "||".join(one() for _ in range(rng.choice([1, 1, 2]))) if k % 50 else "", "2.0" if k % 2 else "") for k in range(300)] + [("npm", "hot", "A1", "<1", ""), ("npm", "hot", "A1", "<1", ""), ("npm", "cold", "C", "<5", "")]
    deps = [(k, "npm", "Hot" if k % 9 else "cold", rng.choice(["", "==", ">=", "^"]) + number() + rng.choice(["", "", "-rc1", "-beta.2"])) for k in range(400)] + [(900, "npm", "hot", "latest"), (901, "npm", "none", "1.0")]
    a = spark.createDataFrame(adv, "ecosystem string, package string, id string, affected string, fixed_in string")
    d = spark.createDataFrame(deps, "k int, ecosystem string, name string, spec string")
    told = lambda: sorted((r.k, r.id, r.affected, r.confidence) for r in advisories.matched(d, a).select("k", "id", "affected", "confidence").collect())
    want = told()
    monkeypatch.setattr(advisories, "BUSY", 5)
    assert told() == want and len(want) > 1000
    from siftwarden.functions import versions as V

    few = spark.range(3000).select(F.lit("npm").alias("ecosystem"), F.lit("hot").alias("package"), V.key(F.format_string("%d.%d.%d", F.col("id") % 13, F.col("id") % 37, F.floor(F.col("id") / 481))).alias("_key"))
    narrow = spark.range(2000).select(F.lit("npm").alias("ecosystem"), F.lit("hot").alias("package"), F.col("id").alias("_adv"), V.bounds(F.format_string(">=%d.%d.0,<%d.%d.2", F.col("id") % 13, F.floor(F.col("id") / 13), F.col("id") % 13, F.floor(F.col("id") / 13))).alias("_bounds"))
    found = advisories.indexed(few, narrow)
    assert found.count() == few.distinct().join(narrow, ["ecosystem", "package"]).where(V.within(F.col("_key"), F.col("_bounds"))).count() > 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
