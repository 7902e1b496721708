"""Tables whose rows change, and jobs that only one worker gets."""

from __future__ import annotations

import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siftwarden.operators import events
from siftwarden.sinks import ledger
from siftwarden.streaming import handlers

JOBS = "id long, status string, scheduled_at timestamp_ntz, started_at timestamp_ntz, attempts int, worker string"


def at(minute: int):
    return F.lit(datetime(2024, 1, 1, 0, minute)).cast("timestamp_ntz")


def queue(spark, path, n=12):
    jobs = ledger.Ledger(spark, path, ["id"], JOBS)
    rows = [(k, "queued", datetime(2024, 1, 1, 0, k % 3), None, 0, None) for k in range(n)]
    jobs.commit(lambda _: spark.createDataFrame(rows, JOBS))
    return jobs


def claimed(jobs, n, worker, minute=5):
    return sorted(r.id for r in ledger.claim(jobs, lambda t: events.claimable(t, at(minute)), n, worker, at(minute)).collect())


def test_latest_rows_win_and_gone_keys_go(spark, tmp_path):
    t = ledger.Ledger(spark, str(tmp_path / "t"), ["k"], "k int, v string")
    assert t.read().count() == 0 and t.version() == 0
    make = lambda *rows: lambda _: spark.createDataFrame(rows, "k int, v string, gone boolean")
    t.commit(make((1, "a", None), (2, "b", False), (3, "c", False)))
    t.commit(make((2, "B", False), (3, None, True)))
    look = lambda **how: sorted((r.k, r.v) for r in t.read(**how).collect())
    assert look() == [(1, "a"), (2, "B")] and look(version=1) == [(1, "a"), (2, "b"), (3, "c")]
    assert t.compact() and look() == [(1, "a"), (2, "B")] and len(t.commits()) == 1
    t.commit(make((3, "again", False)))
    assert look() == [(1, "a"), (2, "B"), (3, "again")] and t.version() == 4


def test_a_writer_that_comes_second_looks_again(spark, tmp_path):
    t, other = (ledger.Ledger(spark, str(tmp_path / "t"), ["k"], "k int, v int") for _ in range(2))
    t.commit(lambda _: spark.createDataFrame([(1, 0)], "k int, v int"))
    more = lambda df: df.select("k", (F.col("v") + 1).alias("v"))
    seen = []

    def slow(df):
        seen.append(df.first().v)
        if len(seen) == 1:
            other.commit(more)
        return more(df)

    number, rows = t.commit(slow)
    assert seen == [0, 1] and number == 3 and rows.first().v == 2 and t.read().first().v == 2
    # nothing that lost is left to be read
    assert len(list((tmp_path / "t/data").iterdir())) == 3


def test_commits_that_always_come_second_are_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "TRIES", 2)
    t, other = (ledger.Ledger(spark, str(tmp_path / "t"), ["k"], "k int") for _ in range(2))

    def slow(df):
        other.commit(lambda _: spark.createDataFrame([(1,)], "k int"))
        return spark.createDataFrame([(2,)], "k int")

    with pytest.raises(ledger.Taken):
        t.commit(slow)
    assert [r.k for r in t.read().collect()] == [1]


def test_no_job_is_claimed_twice(spark, tmp_path):
    """Two streams of ticks claim jobs at once; each job goes to one of them, in the order of schedule and id."""
    queue(spark, str(tmp_path / "jobs"))
    got, failed = {"a": [], "b": []}, []

    def work(name):
        try:
            spark.range(4).repartition(1).write.mode("append").parquet(str(tmp_path / f"in-{name}"))
            jobs = ledger.Ledger(spark, str(tmp_path / "jobs"), ["id"], JOBS)
            for k in range(3):
                stream = spark.readStream.schema("id long").parquet(str(tmp_path / f"in-{name}"))
                stream.writeStream.foreachBatch(lambda df, _: got[name].append(claimed(jobs, 2, name))).option("checkpointLocation", str(tmp_path / f"state-{name}{k}")).trigger(availableNow=True).start().awaitTermination()
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(name,)) for name in got]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    taken = [i for rows in (*got["a"], *got["b"]) for i in rows]
    assert sorted(taken) == list(range(12))
    table = ledger.Ledger(spark, str(tmp_path / "jobs"), ["id"], JOBS).read().collect()
    assert {r.id: r.worker for r in table} == {i: name for name, all_ in got.items() for rows in all_ for i in rows}
    assert {(r.status, r.attempts) for r in table} == {("running", 1)}


def test_stale_jobs_are_claimed_again_and_recent_ones_not(spark, tmp_path):
    jobs = queue(spark, str(tmp_path / "jobs"), 3)
    assert claimed(jobs, 1, "a", minute=1) == [0] and claimed(jobs, 5, "b", minute=3) == [1, 2]
    assert claimed(jobs, 5, "c", minute=15) == []
    assert claimed(jobs, 5, "c", minute=17) == [0]
    assert {r.id: (r.worker, r.attempts) for r in jobs.read().collect()} == {0: ("c", 2), 1: ("b", 1), 2: ("b", 1)}


def test_findings_of_scans(spark, tmp_path):
    table = ledger.Ledger(spark, str(tmp_path / "f"), ["project_id", "fingerprint"], ledger.FINDINGS)
    one = lambda rows: spark.createDataFrame(rows, "project_id long, fingerprint string, rule_id string, severity string")
    scan = lambda n, rows, *projects: ledger.scanned(table, spark.createDataFrame([(p, n) for p in projects], "project_id long, scan_id long"), one(rows), at(n))
    scan(1, [(1, "x", "R", "high"), (1, "y", "R", "low"), (2, "x", "R", "low")], 1, 2)
    table.commit(lambda t: t.where("project_id = 2").withColumn("status", F.lit("suppressed")).drop("_version"))
    scan(2, [(1, "x", "R", "critical")], 1)  # project 2 isn't scanned, so nothing of it is resolved
    look = lambda: {(r.project_id, r.fingerprint): (r.status, r.severity, r.first_scan, r.last_scan, r.changed_at.minute) for r in table.read().collect()}
    assert look() == {(1, "x"): ("open", "critical", 1, 2, 1), (1, "y"): ("resolved", "low", 1, 1, 2), (2, "x"): ("suppressed", "low", 1, 1, 1)}
    scan(3, [(1, "y", "R", "low"), (2, "x", "R", "low")], 1, 2)
    assert look() == {(1, "x"): ("resolved", "critical", 1, 2, 3), (1, "y"): ("open", "low", 1, 3, 3), (2, "x"): ("suppressed", "low", 1, 3, 1)}
    scan(4, [], 1)
    assert look()[1, "y"] == ("resolved", "low", 1, 3, 4)




def test_jobs_by_handlers(spark, tmp_path):
    """What succeeds, fails, raises and isn't spoken of; retries with backoff until attempts are used up; kinds without a handler wait."""
    jobs = ledger.Ledger(spark, str(tmp_path / "j"), ["id"], handlers.JOBS)
    rows = [(k, kind, "{}", "queued", datetime(2024, 1, 1), None, 0, 2, None, None) for k, kind in enumerate(["good", "bad", "raises", "silent", "other", "good"])]
    jobs.commit(lambda _: spark.createDataFrame(rows, handlers.JOBS))

    def raises(df):
        raise RuntimeError("no")

    by = {"good": lambda df: df.select("id", F.lit(None).alias("error")), "bad": lambda df: df.select("id", F.lit("broken").alias("error")), "raises": raises, "silent": lambda df: df.where("false").select("id", F.lit("").alias("error"))}
    look = lambda: {r.id: (r.status, r.attempts, (r.error or "").partition(":")[0]) for r in jobs.read().collect()}
    assert handlers.work_off(jobs, by, 10, "w", at(1)) == 5
    assert look() == {0: ("succeeded", 1, ""), 1: ("queued", 1, "broken"), 2: ("queued", 1, "RuntimeError"), 3: ("queued", 1, "not handled"), 4: ("queued", 0, ""), 5: ("succeeded", 1, "")}
    assert handlers.work_off(jobs, by, 10, "w", at(1)) == 0  # not due yet
    assert handlers.work_off(jobs, by, 10, "w", at(2)) == 3
    assert {r[0] for k, r in look().items() if k in (1, 2, 3)} == {"failed"} and handlers.work_off(jobs, by, 10, "w", at(50)) == 0


def test_events_to_subscribers(spark, tmp_path):
    seen = []

    def count(df):
        seen.append(df.count())

    def fails(df):
        raise ValueError("x")

    batch = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "event_id int, event_type string")
    handlers.dispatched(batch, {"a": [fails, count], "*": [count], "c": [count]}, str(tmp_path / "f"))
    assert seen == [2, 3, 0]
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "f")).collect()] == [("fails", "a", "ValueError: x")]


def test_sources_are_asked_in_turn(spark):
    from siftwarden.operators import advisories

    schema = "ecosystem string, package string, id string"
    base, remote = spark.createDataFrame([("npm", "a", "B-1")], schema), spark.createDataFrame([("npm", "a", "R-1"), ("npm", "b", "R-2")], schema)
    asked = []

    def service(packages):
        asked.append(sorted(r.package for r in packages.collect()))
        return advisories.table_source(remote)(packages)

    packages = spark.createDataFrame([("npm", "a"), ("npm", "b"), ("npm", "b"), ("go", "c")], "ecosystem string, package string")
    assert sorted(r.id for r in advisories.looked_up(packages, [advisories.table_source(base), service]).collect()) == ["B-1", "R-2"]
    assert asked == [["b", "c"]]
    with pytest.raises(ValueError):
        advisories.looked_up(packages, [])
