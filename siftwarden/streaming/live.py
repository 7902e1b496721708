"""Events as streams: hourly counts with a watermark, contract split, rate limits, idempotent writes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from siftwarden.operators import events as ops

WATERMARK = "1 day"


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def hourly(events: DataFrame) -> DataFrame:
    """n by hour and type; rows later than the watermark are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", WATERMARK)
    out = timed.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("hour"), "event_type", "n")


def split_by_contract(batch: DataFrame, contract: dict, good: str, bad: str) -> None:
    """For foreachBatch: events that keep their contract to one table, the others with what they miss to another."""
    told = ops.with_missing(batch, contract, "props")
    told.where("missing <> ''").write.mode("append").parquet(bad)
    told.where("missing = ''").drop("missing").write.mode("append").parquet(good)


def append_new(batch: DataFrame, path: str, keys: list[str], by: str | None = None) -> None:
    """For foreachBatch: rows whose key the target hasn't yet, so that a batch that runs twice changes nothing.

    by: a column that the target is partitioned by (a day, a tenant) and that goes with the key; only the partitions of the
    batch's own values are read then.
    """
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(keys)
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # the target is made by the first batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
    else:
        if by:
            old = old.join(fresh.select(by).distinct(), by, "left_semi")
        fresh = fresh.join(old.select(*keys), keys, "left_anti")
    out = fresh.write.mode("append")
    (out.partitionBy(by) if by else out).parquet(path)


def once(events: DataFrame, keys: list[str], late: str = WATERMARK) -> DataFrame:
    """Events (ts, ...) of a stream, each key once: a key's state goes when the watermark has passed it by `late`.

    In front of `append_new`, which keeps out what comes again after that.
    """
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def split_late(batch: DataFrame, batch_id: int, place: str, late_seconds: int) -> None:
    """For foreachBatch: events in time to place/kept, later ones than the latest event of all batches before by late_seconds to place/late.

    Each batch writes folders of its own, so that one that runs again replaces what it wrote.  place/marks has the latest event of each batch.
    """
    spark = batch.sparkSession
    own = lambda df, name: df.write.mode("overwrite").parquet(f"{place}/{name}/batch={batch_id}")
    rows = batch.withColumn("_us", ops.micros(F.col("ts")))
    own(rows.agg(F.max("_us").alias("mark")), "marks")
    before = spark.read.parquet(f"{place}/marks").where(F.col("batch") < batch_id).agg(F.max("mark").alias("m")).first().m
    late = F.coalesce(F.col("_us") < F.lit(before) - late_seconds * 1_000_000, F.lit(False)) if before is not None else F.lit(False)
    own(rows.where(late).drop("_us"), "late")
    own(rows.where(~late).drop("_us"), "kept")


def hours_kept(spark: SparkSession, place: str, late_seconds: int) -> DataFrame:
    """n by hour and type of the events that came in time, and whether the hour is closed: no event of it can be in time any more."""
    kept = spark.read.parquet(f"{place}/kept").withColumn("hour", F.date_trunc("hour", F.col("ts").cast("timestamp")))
    mark = spark.read.parquet(f"{place}/marks").agg(F.max("mark").alias("m")).first().m
    closed = F.unix_micros(F.col("hour")) + 3_600_000_000 <= F.lit(mark) - late_seconds * 1_000_000
    return kept.groupBy("hour", "event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("closed", closed)


def late_counts(spark: SparkSession, place: str) -> DataFrame:
    """n late events of each type."""
    return spark.read.parquet(f"{place}/late").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def purged(audit: DataFrame, org_id: int, cutoff: Column, now: Column, days: int) -> DataFrame:
    """An audit table (org_id, at, action, actor, detail) without one tenant's rows before the cutoff, and with a row that says so.

    The row tells how many went even if none did: that history was removed is itself history.
    """
    mine = (F.col("org_id") == org_id) & (F.col("at") < cutoff)
    told = F.to_json(F.struct(F.lit(days).alias("retention_days"), cutoff.cast("string").alias("cutoff"), F.col("n").alias("records_removed")))
    note = audit.agg(F.count_if(mine).alias("n")).select(F.lit(org_id).cast(audit.schema["org_id"].dataType).alias("org_id"), now.cast(audit.schema["at"].dataType).alias("at"), F.lit("audit.purged").alias("action"), F.lit("system").alias("actor"), told.alias("detail"))
    return audit.where(~F.coalesce(mine, F.lit(False))).select("org_id", "at", "action", "actor", "detail").unionByName(note)


class RateLimit(StatefulProcessor):
    """Hits (key, at in microseconds, and reset where there are any) to (key, at, n_hits): how many lie in (at - window, at], with times kept as state.

    A hit with reset, one that succeeds, counts, and then all of its key's times go.  A key's times also go when the watermark has passed its last one by a window, since no hit can count them then.
    """

    def __init__(self, window_micros: int):
        self.window = window_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.times = handle, handle.getListState("times", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times, out = sorted(t[0] for t in self.times.get()) if self.times.exists() else [], []
        for at, reset in sorted((int(x), bool(r)) for part in rows for x, r in zip(part["at"], part["reset"] if "reset" in part else [False] * len(part))):
            times = [t for t in times if t > at - self.window] + [at]
            out.append((key[0], at, len(times)))
            times = [] if reset else times
        if times:
            self.times.put([(t,) for t in times])
            self.handle.registerTimer((times[-1] + self.window) // 1000 + 1)
        else:
            self.times.clear()
        yield pd.DataFrame(out, columns=["key", "at", "n_hits"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = max((t[0] for t in self.times.get()), default=0) if self.times.exists() else 0
        if last + self.window < 1000 * expiredTimerInfo.getExpiryTimeInMs():
            self.times.clear()
        yield pd.DataFrame({"key": pd.Series(dtype=str), "at": pd.Series(dtype="int64"), "n_hits": pd.Series(dtype="int32")})

    def close(self) -> None:
        pass


def rate_limited(hits: DataFrame, window_seconds: int, late: str = "10 minutes") -> DataFrame:
    """Hits (key, at) may come so late; needs the RocksDB state store."""
    timed = hits.withColumn("ts", F.timestamp_micros("at")).withWatermark("ts", late)
    return timed.groupBy("key").transformWithStateInPandas(RateLimit(window_seconds * 1_000_000), "key string, at long, n_hits int", "update", "eventTime")


#: Reports are timed a day later than they say, since a watermark begins at 1970 and what is timed then would be late at once.
AHEAD = 86_400_000_000


class Jobs(StatefulProcessor):
    """Reports on jobs (job_id, at in microseconds, outcome: enqueued, claimed, succeeded or failed) to (job_id, at, status, attempts, due).

    A failed job is queued again, later each time, until its attempts are used up; reports on a job that has ended change nothing.
    One that is claimed and of which nothing is heard for stale_seconds is queued again at that time: a timer tells when the watermark
    has passed it, and a report that comes later finds it so, whatever batch it comes in.
    """

    def __init__(self, most_attempts: int = 5, backoff_seconds: int = ops.BACKOFF_SECONDS, stale_seconds: int = ops.STALE_SECONDS):
        self.most, self.backoff, self.stale = most_attempts, backoff_seconds, stale_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.job = handle, handle.getValueState("job", "status string, attempts int, due long, started long")

    def _state(self) -> tuple[str, int, int, int]:
        return tuple(self.job.get()) if self.job.exists() else ("new", 0, 0, 0)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status, attempts, due, started = self._state()
        out = []
        for at, outcome in sorted((int(a), o) for part in rows for a, o in zip(part["at"], part["outcome"])):
            if status == "running" and at > started + self.stale:
                status, due = "queued", started + self.stale
                out.append((key[0], due, status, attempts, due))
            if outcome == "enqueued" and status == "new":
                status, due = "queued", at
            elif outcome == "claimed" and status == "queued" and at >= due:
                status, attempts, started = "running", attempts + 1, at
            elif outcome == "succeeded" and status == "running":
                status = "succeeded"
            elif outcome == "failed" and status == "running":
                again = attempts < self.most
                status, due = ("queued", at + 1_000_000 * self.backoff * 2 ** (attempts - 1)) if again else ("failed", due)
            else:
                continue
            out.append((key[0], at, status, attempts, due))
        self.job.update((status, attempts, due, started))
        if status == "running":
            self.handle.registerTimer((started + self.stale + AHEAD) // 1000 + 1)
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, attempts, due, started = self._state()
        out = []
        if status == "running" and started + self.stale + AHEAD < 1000 * expiredTimerInfo.getExpiryTimeInMs():
            due = started + self.stale
            self.job.update(("queued", attempts, due, started))
            out.append((key[0], due, "queued", attempts, due))
        yield self._rows(out)

    @staticmethod
    def _rows(out: list[tuple]) -> pd.DataFrame:
        names = {"job_id": str, "at": "int64", "status": str, "attempts": "int32", "due": "int64"}
        return pd.DataFrame(out, columns=list(names)).astype(names)

    def close(self) -> None:
        pass


def job_states(reports: DataFrame, most_attempts: int = 5, late: str = "10 minutes", stale_seconds: int = ops.STALE_SECONDS) -> DataFrame:
    """Reports may come so late; needs the RocksDB state store."""
    timed = reports.withColumn("ts", F.timestamp_micros(F.col("at") + AHEAD)).withWatermark("ts", late)
    return timed.groupBy("job_id").transformWithStateInPandas(Jobs(most_attempts, stale_seconds=stale_seconds), "job_id string, at long, status string, attempts int, due long", "update", "eventTime")
