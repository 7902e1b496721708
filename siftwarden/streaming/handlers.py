"""What is done with jobs and events: handlers by kind of job, subscribers by type of event.

Handlers and subscribers are given DataFrames, so what they do is Spark's work; one that fails is told as such and the others go on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwarden.operators import events as ops
from siftwarden.sinks.ledger import Ledger, claim

#: Jobs as `work_off` wants them in a ledger, by id.
JOBS = "id long, kind string, payload string, status string, scheduled_at timestamp_ntz, started_at timestamp_ntz, attempts int, max_attempts int, worker string, error string"
#: A handler: jobs of its kind to (id, error), an error for each that failed and null for those that didn't.
Handler = Callable[[DataFrame], DataFrame]


def work_off(jobs: Ledger, handlers: dict[str, Handler], n: int, worker: str, now: Column) -> int:
    """Claims the next n jobs whose kind has a handler, lets these do them, and writes how they ended; how many there were.

    A job that fails is queued again, later each time, until its attempts are used up.  What a handler doesn't speak of has failed.
    """
    mine = claim(jobs, lambda t: ops.claimable(t, now).where(F.col("kind").isin(*handlers)), n, worker, now)
    ends, done = None, 0
    for kind in sorted(r.kind for r in mine.select("kind").distinct().collect()):  # no more kinds than handlers
        own = mine.where(F.col("kind") == kind)
        done += own.count()
        try:
            said = {r.id: r.error for r in handlers[kind](own).select("id", "error").collect()}  # n rows at most; what a handler fails at comes up here
            rows = [(r.id, said.get(r.id, "not handled")) for r in own.select("id").collect()]
            told = own.sparkSession.createDataFrame(rows, "id long, error string")
        except Exception as e:
            told = own.select("id", F.lit(f"{type(e).__name__}: {e}"[:2000]).alias("error"))
        ends = told if ends is None else ends.unionByName(told)
    if ends is None:
        return 0

    def finished(table: DataFrame) -> DataFrame:
        # only what is still this worker's: a job gone stale may be another's by now
        rows = table.where((F.col("worker") == worker) & (F.col("status") == "running")).drop("error").join(ends, "id")
        again = F.col("error").isNotNull() & (F.col("attempts") < F.col("max_attempts"))
        status = F.when(F.col("error").isNull(), "succeeded").when(again, "queued").otherwise("failed")
        return rows.withColumns({"status": status, "scheduled_at": F.when(again, ops.backoff(F.col("attempts"), now)).otherwise(F.col("scheduled_at"))})

    jobs.commit(finished)
    return done


def dispatched(batch: DataFrame, subscribers: dict[str, list[Callable[[DataFrame], None]]], failures: str) -> None:
    """For foreachBatch: each subscriber is given the events of its type (`*`: all); one that fails is a row of the table `failures`: subscriber, event_type, error."""
    told = []
    for kind, some in subscribers.items():
        rows = batch if kind == "*" else batch.where(F.col("event_type") == kind)
        for one in some:
            try:
                one(rows)
            except Exception as e:
                told.append((getattr(one, "__name__", "subscriber"), kind, f"{type(e).__name__}: {e}"[:2000]))
    if told:
        batch.sparkSession.createDataFrame(told, "subscriber string, event_type string, error string").write.mode("append").parquet(failures)
