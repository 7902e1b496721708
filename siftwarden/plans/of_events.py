"""Queries on events, requests and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwarden.functions import text as T
from siftwarden.operators import events as ops

from .registry import query
from .standins import read


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events")


def _micros():
    return F.unix_micros(F.to_timestamp_ltz(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("Z")), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSSX")))


WINDOW = "count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW)"


@query(f"SELECT event_id, user_id, CAST({WINDOW} AS BIGINT) AS n_hits, {WINDOW} <= 2 AS allowed FROM events")
def rate_limit_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.rate_limited(_events(spark, sf_dir), "user_id", _micros(), ["event_id"], 2, 21_600).select("event_id", "user_id", "n_hits", "allowed")


@query(f"""WITH h AS (SELECT event_id, epoch_us(ts) AS us, {WINDOW} AS n, min(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS oldest FROM events)
  SELECT event_id, CAST(greatest(1, floor((oldest + 21600000000 - us) / 1000000) + 1) AS BIGINT) AS retry_after FROM h WHERE n > 2""")
def retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.rate_limited(_events(spark, sf_dir), "user_id", _micros(), ["event_id"], 2, 21_600).where("not allowed").select("event_id", "retry_after")


SESSION = "coalesce(sum(CAST(event_type = 'purchase' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"


@query(f"""WITH h AS (SELECT event_id, user_id, epoch_us(ts) AS us, {SESSION} AS session FROM events),
  c AS (SELECT *, count(*) OVER (PARTITION BY user_id, session ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS n, min(us) OVER (PARTITION BY user_id, session ORDER BY us, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS oldest FROM h)
  SELECT event_id, user_id, CAST(n AS BIGINT) AS n_hits, n <= 3 AS allowed, CAST(CASE WHEN n > 3 THEN greatest(1, floor((oldest + 86400000000 - us) / 1000000) + 1) ELSE 0 END AS BIGINT) AS retry_after FROM c""")
def rate_limit_after_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A purchase is a success, after which a user's hits before it count no more."""
    told = ops.rate_limited(_events(spark, sf_dir), "user_id", _micros(), ["event_id"], 3, 86_400, reset=F.col("event_type") == "purchase")
    return told.select("event_id", "user_id", "n_hits", "allowed", F.coalesce("retry_after", F.lit(0)).alias("retry_after"))


@query("SELECT event_type, le, n FROM (SELECT event_type, " + ", ".join(f"count(*) FILTER (WHERE value / 100 <= {b}) AS \"{b}\"" for b in map(float, ops.BUCKETS)) + ", count(*) AS \"+Inf\" FROM events GROUP BY event_type) UNPIVOT (n FOR le IN (" + ", ".join(f'"{b}"' for b in map(float, ops.BUCKETS)) + ', "+Inf"))')
def latency_histogram_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.histogram(_events(spark, sf_dir).withColumn("seconds", F.col("value") / 100), "seconds", "event_type")


#: Events as jobs: type gives status, value the attempts.
JOB = """job AS (SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'queued' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' WHEN 'signup' THEN 'running' ELSE 'cancelled' END AS status,
  ts AS scheduled_at, ts AS started_at, CAST(1 + event_id % 6 AS INTEGER) AS attempts FROM events)"""
AT = "2024-01-20 00:00:00"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    status = F.when(t == "click", "queued").when(t == "error", "failed").when(t == "purchase", "succeeded").when(t == "signup", "running").otherwise("cancelled")
    return _events(spark, sf_dir).select(F.col("event_id").alias("id"), status.alias("status"), F.col("ts").alias("scheduled_at"), F.col("ts").alias("started_at"), (1 + F.col("event_id") % 6).cast("int").alias("attempts"))


@query(f"""WITH {JOB} SELECT id, status, scheduled_at FROM job WHERE (status = 'queued' AND scheduled_at <= TIMESTAMP '{AT}') OR (status = 'running' AND started_at < TIMESTAMP '{AT}' - INTERVAL 900 SECONDS)
  ORDER BY scheduled_at, id LIMIT 25""")
def job_claim_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(AT).cast("timestamp_ntz")
    return ops.claimable(_jobs(spark, sf_dir), now).orderBy("scheduled_at", "id").limit(25).select("id", "status", "scheduled_at")


@query("""WITH r AS (SELECT user_id % 40 AS job, epoch_us(ts) AS "at", CASE WHEN event_type IN ('click', 'view') THEN 'claimed' ELSE 'succeeded' END AS outcome FROM events),
  n AS (SELECT *, coalesce(lead(r."at") OVER (PARTITION BY job ORDER BY r."at", outcome), epoch_us(TIMESTAMP '2024-02-01')) AS next FROM r)
  SELECT CAST(job AS VARCHAR) AS job_id, "at" AS claimed_at, "at" + 900000000 AS reclaimed_at FROM n WHERE outcome = 'claimed' AND next > "at" + 900000000""")
def job_reclaims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and views claim a job, all else ends it: the claims of which nothing is heard in time."""
    outcome = F.when(F.col("event_type").isin("click", "view"), "claimed").otherwise("succeeded")
    reports = _events(spark, sf_dir).select((F.col("user_id") % 40).cast("string").alias("job_id"), _micros().alias("at"), outcome.alias("outcome"))
    return ops.reclaims(reports, F.unix_micros(F.lit("2024-02-01 00:00:00+00:00").cast("timestamp")))


@query(f"""WITH {JOB} SELECT id, CASE WHEN attempts >= 5 THEN 'failed' ELSE 'queued' END AS next_status,
  CASE WHEN attempts < 5 THEN TIMESTAMP '{AT}' + to_seconds(5 * 2 ** (attempts - 1)) END AS scheduled_at FROM job WHERE status = 'failed'""")
def job_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = _jobs(spark, sf_dir).where("status = 'failed'")
    again = F.col("attempts") < 5
    return failed.select("id", F.when(again, "queued").otherwise("failed").alias("next_status"), F.when(again, ops.backoff(F.col("attempts"), F.lit(AT).cast("timestamp_ntz"))).alias("scheduled_at"))


@query(f"""WITH {JOB}, s AS (SELECT unnest(['queued', 'running', 'succeeded', 'failed', 'cancelled', 'expired']) AS status)
  SELECT s.status, CAST(count(job.id) AS BIGINT) AS n FROM s LEFT JOIN job USING (status) GROUP BY s.status""")
def job_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(s,) for s in ("queued", "running", "succeeded", "failed", "cancelled", "expired")], "status string")
    many = _jobs(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return names.join(many, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


CONTRACT = {"click": ("k",), "error": ("k", "code"), "purchase": ("amount", "k"), "signup": ()}


@query("""WITH e AS (SELECT *, coalesce(json_keys(props), []) AS have FROM events), m AS (
  SELECT event_id, event_type, CASE event_type WHEN 'click' THEN array_to_string(list_filter(['k'], lambda x: NOT list_contains(have, x)), ',')
    WHEN 'error' THEN array_to_string(list_filter(['code', 'k'], lambda x: NOT list_contains(have, x)), ',')
    WHEN 'purchase' THEN array_to_string(list_filter(['amount', 'k'], lambda x: NOT list_contains(have, x)), ',') WHEN 'signup' THEN '' ELSE '<type>' END AS missing FROM e)
  SELECT * FROM m WHERE missing <> ''""")
def event_contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.violations(_events(spark, sf_dir), CONTRACT, "props").select("event_id", "event_type", "missing")


@query("SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-15') AS BIGINT) AS expiring, CAST(count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-15') AS BIGINT) AS retained FROM events")
def retention_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.retention(_events(spark, sf_dir), "ts", F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))


@query("SELECT event_id, ts, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
def retention_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where(F.col("ts") >= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("event_id", "ts", "user_id")


#: Events as audit payloads: the value is a token, at the top or within a list.
PAYLOAD = """CASE event_id % 4 WHEN 0 THEN '{"user_token":"t' || user_id || '","n":' || user_id || '}' WHEN 1 THEN '{"a":[{"API-Key":"' || event_type || '"},7],"b":{"c":{"passwd":null}}}' WHEN 2 THEN '{"k":"' || event_type || '"}' ELSE 'token: ' || event_type END"""


@query(f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{{"user_token":"[redacted]","n":' || user_id || '}}' WHEN 1 THEN '{{"a":[{{"API-Key":"[redacted]"}},7],"b":{{"c":{{"passwd":"[redacted]"}}}}}}' ELSE {PAYLOAD} END AS payload FROM events""")
def audit_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensitive keys at any depth and in lists; texts that aren't JSON stay."""
    return _events(spark, sf_dir).select("event_id", ops.redacted_json(F.expr(PAYLOAD)).alias("payload"))


@query("""SELECT CAST(user_id % 7 AS BIGINT) AS org_id, ts AS at, event_type AS action, CAST(user_id AS VARCHAR) AS actor, props AS detail FROM events WHERE NOT (user_id % 7 = 3 AND ts < TIMESTAMP '2024-01-15')
  UNION ALL SELECT 3, TIMESTAMP '2024-02-01', 'audit.purged', 'system', '{"retention_days":17,"cutoff":"2024-01-15 00:00:00","records_removed":' || (SELECT count(*) FROM events WHERE user_id % 7 = 3 AND ts < TIMESTAMP '2024-01-15') || '}'""")
def retention_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tenant's old audit rows go, and a row says how many."""
    from siftwarden.streaming import live

    at = lambda s: F.lit(s).cast("timestamp_ntz")
    audit = _events(spark, sf_dir).select((F.col("user_id") % 7).cast("long").alias("org_id"), F.col("ts").alias("at"), F.col("event_type").alias("action"), F.col("user_id").cast("string").alias("actor"), F.col("props").alias("detail"))
    return live.purged(audit, 3, at("2024-01-15 00:00:00"), at("2024-02-01 00:00:00"), 17)


CELL = "CASE event_id % 4 WHEN 0 THEN '=' || event_type WHEN 1 THEN '-' || event_type WHEN 2 THEN '@' || event_type ELSE event_type END"


@query(f"SELECT event_id, CASE WHEN regexp_matches(c, '^[=+\\-@\\t\\r]') THEN '''' || c ELSE c END AS cell FROM (SELECT event_id, {CELL} AS c FROM events)")
def audit_csv_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", T.csv_safe(F.expr(CELL)).alias("cell"))


HOSTS = ["*.example.com", "news0.example.org", "example.net"]


@query("""WITH h AS (SELECT page_id, regexp_extract(url, '^https?://([^/:]+)', 1) AS host FROM pages)
  SELECT page_id, host, length(host) > 0 AND (ends_with(host, '.example.com') AND length(host) > 12 OR host = 'news0.example.org' OR host = 'example.net') AS allowed FROM h""")
def host_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "^https?://([^/:]+)", 1)
    return read(spark, sf_dir, "pages").select("page_id", host.alias("host")).withColumn("allowed", ops.host_allowed(F.col("host"), HOSTS))


@query("""SELECT date_trunc('hour', ts) AS hour, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def metrics_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return e.groupBy("hour", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH h AS (SELECT user_id, epoch_us(ts) AS us, max(epoch_us(ts)) OVER (PARTITION BY user_id) AS last FROM events)
  SELECT user_id, CAST(count(*) AS BIGINT) AS n_hits, CAST(ceil((min(us) + 21600000000 - max(last)) / 1000000) AS BIGINT) AS reset_after FROM h WHERE us > last - 21600000000 GROUP BY user_id""")
def rate_limit_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.resets(_events(spark, sf_dir), "user_id", _micros(), 21_600)


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type = 'signup') WHERE k = 1")
def last_reset_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups as reset tokens: the last of each user is valid."""
    return ops.last_of(_events(spark, sf_dir).where("event_type = 'signup'"), "user_id", "ts", "event_id").select("user_id", "event_id", "ts")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS counter, arg_max(value, (ts, event_id)) AS gauge FROM events GROUP BY event_type")
def counters_and_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.metrics(_events(spark, sf_dir), "event_type", "value", "ts", "event_id")
