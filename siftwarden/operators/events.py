"""Event-time logic on tables: rate limits, backoff, claims, histograms, retention, contracts."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Upper bounds of the latency buckets, in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)
BACKOFF_SECONDS, STALE_SECONDS = 5, 900


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp without zone, read as UTC."""
    return F.unix_micros(F.to_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


#: Windows in a stretch of time.
STRETCH = 64


def rate_limited(hits: DataFrame, key: str, at: Column, order: list[str], limit: int, window_seconds: int, reset: Column | None = None) -> DataFrame:
    """hits with n_hits in (now - window, now], itself included, allowed, and retry_after in seconds.

    A hit that is refused counts as well.  It may come again when the oldest of the last `limit` hits of its window leaves it.  reset: hits that succeed, after which all before them, themselves included, count no more.
    A key's hits are dealt by stretches of time, each with copies of the hits of the window before it, so a hot key is many tasks.
    """
    span = window_seconds * 1_000_000
    wide = span * STRETCH
    df = hits.withColumn("_at", at)
    own = ((F.col("_at") - F.pmod("_at", F.lit(wide))) / wide).cast("long")
    ahead = F.pmod("_at", F.lit(wide)) >= wide - span
    df = df.withColumn("_own", own).withColumn("_in", F.explode(F.when(ahead, F.array(F.col("_own"), F.col("_own") + 1)).otherwise(F.array("_own"))))
    part = [key, "_in"]
    if reset is not None:
        before = Window.partitionBy(*part).orderBy("_at", *order).rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumn("_session", F.coalesce(F.sum(F.coalesce(reset, F.lit(False)).cast("int")).over(before), F.lit(0)))
        part = [*part, "_session"]
    w = Window.partitionBy(*part).orderBy("_at").rangeBetween(-(span - 1), 0)
    oldest = Window.partitionBy(*part).orderBy("_at", *order).rowsBetween(-(limit - 1), 0)
    df = df.withColumns({"n_hits": F.count(F.lit(1)).over(w), "_first": F.greatest(F.min("_at").over(oldest), F.min("_at").over(w))}).where(F.col("_in").eqNullSafe(F.col("_own")))
    wait = F.greatest(F.lit(1), F.floor((F.col("_first") + span - F.col("_at")) / 1_000_000) + 1)
    return df.withColumns({"allowed": F.col("n_hits") <= limit, "retry_after": F.when(F.col("n_hits") > limit, wait.cast("long"))}).drop("_at", "_first", "_own", "_in", "_session")


def histogram(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """le, n for each key: cumulative counts for each bound and +Inf."""
    bounds = [*map(float, BUCKETS)]
    many = [F.count_if(F.col(value) <= b) for b in bounds] + [F.count(F.lit(1))]
    names = [str(b) for b in bounds] + ["+Inf"]
    out = df.groupBy(*keys).agg(F.array(*(F.struct(F.lit(n).alias("le"), m.cast("long").alias("n")) for n, m in zip(names, many))).alias("_all"))
    return out.select(*keys, F.inline("_all"))


def backoff(attempts: Column, now: Column) -> Column:
    """When a failed job runs again: 5 seconds, doubled for each attempt before."""
    return now + F.make_dt_interval(secs=F.lit(float(BACKOFF_SECONDS)) * F.pow(F.lit(2.0), attempts - 1))


def claimable(jobs: DataFrame, now: Column) -> DataFrame:
    """Queued jobs that are due and running ones gone stale, in the order they are claimed."""
    stale = (F.col("status") == "running") & (F.col("started_at") < now - F.make_dt_interval(secs=F.lit(float(STALE_SECONDS))))
    return jobs.where(((F.col("status") == "queued") & (F.col("scheduled_at") <= now)) | stale)


def reclaims(reports: DataFrame, until: Column, stale_seconds: int = STALE_SECONDS) -> DataFrame:
    """(job_id, claimed_at, reclaimed_at) in microseconds: claims that no report of the job follows in time, as of `until`; reports: (job_id, at, outcome)."""
    after = F.lead("at").over(Window.partitionBy("job_id").orderBy("at", "outcome"))
    back = F.col("at") + stale_seconds * 1_000_000
    told = reports.withColumn("_next", F.coalesce(after, until)).where((F.col("outcome") == "claimed") & (F.col("_next") > back))
    return told.select("job_id", F.col("at").alias("claimed_at"), back.alias("reclaimed_at"))


def with_missing(events: DataFrame, contract: dict[str, tuple[str, ...]], payload: str) -> DataFrame:
    """events with missing: the keys of its type that a payload lacks, sorted; <type> for a type that isn't known; empty if none."""
    known = F.create_map(*(x for k, v in contract.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else F.expr("cast(array() as array<string>)"))))
    want = known[F.col("event_type")]
    have = F.coalesce(F.json_object_keys(F.col(payload)), F.expr("cast(array() as array<string>)"))
    missing = F.when(want.isNull(), F.array(F.lit("<type>"))).otherwise(F.sort_array(F.array_except(want, have)))
    return events.withColumn("missing", F.array_join(missing, ","))


def violations(events: DataFrame, contract: dict[str, tuple[str, ...]], payload: str) -> DataFrame:
    """Events that don't keep their contract, with what they miss."""
    return with_missing(events, contract, payload).where("missing <> ''")


def retention(df: DataFrame, at: str, cutoff: Column) -> DataFrame:
    """total, expiring (before the cutoff) and retained."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(at) < cutoff).alias("expiring"), F.count_if(F.col(at) >= cutoff).alias("retained"))


def host_allowed(host: Column, allowed: list[str] | None) -> Column:
    """Exactly listed, or under a listed *.suffix; no list allows all, no host is never allowed."""
    if allowed is None:
        return F.coalesce(F.length(host) > 0, F.lit(False))
    each = [F.endswith(host, F.lit(a[1:])) & (F.length(host) > len(a) - 1) if a.startswith("*.") else host == a for a in allowed]
    out = F.lit(False)
    for e in each:
        out = out | e
    return F.coalesce((F.length(host) > 0) & out, F.lit(False))


def allowed_hosts(*lists: list[str] | None) -> list[str] | None:
    """What all lists allow: no list allows all; entries stay where each other list has them or a suffix above them."""
    given = [x for x in lists if x is not None]
    if not given:
        return None
    under = lambda host, entry: host == entry or entry.startswith("*.") and host.removeprefix("*").endswith(entry[1:]) and len(host.removeprefix("*")) >= len(entry[1:])
    return sorted({e for one in given for e in one if all(any(under(e, o) for o in other) for other in given)})


# Keys whose values an audit never shows, and what stands for these.
SENSITIVE = r"(?i)(password|passwd|secret|token|api[_-]?key|authorization|credential|private[_-]?key)"
HIDDEN = "[redacted]"


def redacted_json(payload: Column) -> Column:
    """A JSON text whose sensitive keys, at any depth and also in lists, have their values hidden; other texts as they are."""

    @F.arrow_udf("string")
    def hide(texts: pa.Array) -> pa.Array:
        sensitive = re.compile(SENSITIVE)

        def clean(x):
            if isinstance(x, dict):
                return {k: HIDDEN if sensitive.search(k) else clean(v) for k, v in x.items()}
            return [clean(v) for v in x] if isinstance(x, list) else x

        def one(t: str) -> str:
            try:
                return json.dumps(clean(json.loads(t)), separators=(",", ":"), ensure_ascii=False)
            except (ValueError, RecursionError):
                return t

        return pa.array([None if t is None else one(t) for t in texts.to_pylist()], pa.string())

    # only texts that may have such a key are looked into
    return F.when(payload.rlike(SENSITIVE), hide(payload)).otherwise(payload)


def resets(hits: DataFrame, key: str, at: Column, window_seconds: int) -> DataFrame:
    """For each key's last hit: how many hits its window holds, and seconds until the oldest of these leaves it."""
    span = window_seconds * 1_000_000
    seen = hits.select(key, at.alias("_at"))
    last = seen.groupBy(key).agg(F.max("_at").alias("_last"))
    inside = seen.join(last, key).where(F.col("_at") > F.col("_last") - span)
    return inside.groupBy(key).agg(F.count(F.lit(1)).alias("n_hits"), F.ceil((F.min("_at") + span - F.max("_last")) / 1_000_000).alias("reset_after"))


def last_of(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Each key's last row by time; only that one counts, all before it are void."""
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*rows.columns), F.struct(at, tie)).alias("_row")).select("_row.*")


def metrics(events: DataFrame, name: str, value: str, at: str, tie: str) -> DataFrame:
    """For each name a counter, all values added, and a gauge, the last one."""
    return events.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("counter"), F.max_by(value, F.struct(at, tie)).alias("gauge"))
