"""Queries on stored scans: latest, trends, dashboards, pages, lifecycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwarden.operators import findings as ops, store

from .registry import query
from .standins import BARE, COUNTS, FINDING, GRADE, PROJECT, RANK, SCAN, WEIGHT, bare_findings, findings, projects, read, scans, tasks

LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY scan_id DESC) AS recency FROM scan WHERE status = 'succeeded') WHERE recency <= {n})"


@query(f"WITH {SCAN}, {LATEST.format(n=1)} SELECT project_id, scan_id, created_at FROM latest")
def latest_scan_per_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(scans(spark, sf_dir)).select("project_id", "scan_id", "created_at")


@query(f"""WITH {SCAN}, {BARE}, {LATEST.format(n=5)} SELECT l.project_id, l.scan_id, CAST(recency AS BIGINT) AS recency, {COUNTS}
  FROM latest l LEFT JOIN bare USING (scan_id) GROUP BY ALL""")
def trend_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = store.latest(scans(spark, sf_dir), n=5).select("project_id", "scan_id", F.col("recency").cast("long").alias("recency"))
    return ops.counts_by_severity(last.join(bare_findings(spark, sf_dir).select("scan_id", "severity"), "scan_id", "left"), "project_id", "scan_id", "recency")


@query(f"""WITH {SCAN}, {BARE}, {PROJECT}, {LATEST.format(n=1)}, f AS (SELECT l.project_id, b.* FROM latest l JOIN bare b USING (scan_id))
  SELECT org_id, CAST(count(DISTINCT p.project_id) AS BIGINT) AS projects, CAST(count(DISTINCT f.project_id) AS BIGINT) AS scanned, {COUNTS},
    CAST(count(*) FILTER (WHERE f.status = 'open') AS BIGINT) AS open_findings, CAST(coalesce(sum(CASE WHEN severity IS NOT NULL THEN {WEIGHT} END), 0) AS BIGINT) AS risk_score
  FROM project p LEFT JOIN f ON p.project_id = f.project_id GROUP BY org_id""")
def dashboard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwarden.functions import severity as S

    last = store.latest(scans(spark, sf_dir)).select("project_id", "scan_id")
    f = last.join(bare_findings(spark, sf_dir).select("scan_id", "severity", F.col("status").alias("state")), "scan_id").withColumn("scanned", F.col("project_id"))
    many = [F.count_if(F.col("severity") == s).alias(s) for s in S.SEVERITIES]
    return projects(spark, sf_dir).join(f, "project_id", "left").groupBy("org_id").agg(
        F.count_distinct("project_id").alias("projects"), F.count_distinct("scanned").alias("scanned"), *many, F.count_if(F.col("state") == "open").alias("open_findings"), F.coalesce(F.sum(S.weight(F.col("severity"))), F.lit(0)).cast("long").alias("risk_score")
    )


@query(f"WITH {SCAN}, {BARE} SELECT scan_id, project_id, CAST(count(rule_id) AS BIGINT) AS n_findings FROM scan LEFT JOIN bare USING (scan_id) GROUP BY scan_id, project_id")
def scan_finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    many = bare_findings(spark, sf_dir).groupBy("scan_id").agg(F.count(F.lit(1)).alias("n_findings"))
    return scans(spark, sf_dir).join(many, "scan_id", "left").select("scan_id", "project_id", F.coalesce("n_findings", F.lit(0)).alias("n_findings"))


@query(f"""WITH {FINDING}, page AS (SELECT rule_id FROM finding ORDER BY created_at DESC, scan_id DESC, line, part, supp, rule_id LIMIT 200)
  SELECT rule_id, CAST(count(*) AS BIGINT) AS n FROM page GROUP BY rule_id""")
def rule_frequency_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = store.page(findings(spark, sf_dir), [F.desc("created_at"), F.desc("scan_id"), "line", "part", "supp", "rule_id"], 200)
    return page.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FINDING} SELECT project_id, fingerprint, min(created_at) AS first_seen_at, max(created_at) AS last_seen_at, CAST(count(DISTINCT scan_id) AS BIGINT) AS n_scans FROM finding GROUP BY project_id, fingerprint")
def first_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.seen(findings(spark, sf_dir))


@query(f"""WITH {FINDING}, {LATEST.format(n=2)}, rows AS (SELECT f.*, recency FROM finding f JOIN latest l USING (scan_id))
  SELECT project_id, scan_id, fingerprint, rule_id, line FROM rows r WHERE recency = 2 AND NOT EXISTS (SELECT 1 FROM rows n WHERE n.recency = 1 AND n.project_id = r.project_id AND n.fingerprint = r.fingerprint)""")
def resolve_previous_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.resolved(findings(spark, sf_dir), scans(spark, sf_dir)).select("project_id", "scan_id", "fingerprint", "rule_id", "line")


@query("""SELECT user_id, arg_max(event_type, event_id) AS state, max(event_id) AS event_id, CAST(count(*) AS BIGINT) AS n_events FROM events GROUP BY user_id""")
def lifecycle_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("state"), F.max("event_id").alias("event_id"), F.count(F.lit(1)).alias("n_events"))


@query(f"""WITH {SCAN}, {PROJECT} SELECT scan_id, project_id, name, created_at FROM scan JOIN project USING (project_id) WHERE org_id = 1 ORDER BY created_at DESC, scan_id DESC LIMIT 50 OFFSET 100""")
def tenant_scoped_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.scoped(scans(spark, sf_dir).join(projects(spark, sf_dir), "project_id"), 1)
    return store.page(rows, [F.desc("created_at"), F.desc("scan_id")], 50, 100).select("scan_id", "project_id", "name", "created_at")


@query(f"WITH {SCAN} SELECT scan_id, project_id, status FROM scan WHERE scan_id > 100 ORDER BY scan_id LIMIT 100")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.keyset(scans(spark, sf_dir), "scan_id", 100, 100).select("scan_id", "project_id", "status")


@query(f"WITH {SCAN} SELECT scan_id, created_at FROM scan WHERE created_at BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31 23:59:59'")
def time_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.between(scans(spark, sf_dir), "created_at", "1995-01-01", "1995-12-31 23:59:59").select("scan_id", "created_at")


@query(f"""WITH {FINDING} SELECT project_id, severity, rule_id, CAST(count(*) AS BIGINT) AS n FROM finding WHERE status = 'open' AND severity IN ('critical', 'high') GROUP BY ALL""")
def findings_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).where("status = 'open' and severity in ('critical', 'high')").groupBy("project_id", "severity", "rule_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PROJECT} SELECT org_id, CAST(count(*) AS BIGINT) AS n FROM project JOIN customer ON c_custkey = project_id WHERE NOT c_acctbal < 0 GROUP BY org_id")
def unarchived_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a balance below 0 stand for archived projects."""
    p = projects(spark, sf_dir).join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"), (F.col("c_acctbal") < 0).alias("archived")), "project_id")
    return store.unarchived(p).groupBy("org_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {FINDING}, c AS (SELECT project_id, {COUNTS}, CAST(count(*) AS BIGINT) AS finding_count, CAST(sum({WEIGHT}) AS BIGINT) AS risk_score FROM finding GROUP BY project_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY {RANK}, file_path, line, rule_id, fingerprint) AS k FROM finding),
  t AS (SELECT project_id, '[' || string_agg('{{"rule_id":"' || rule_id || '","severity":"' || severity || '","file":"' || file_path || '","line":' || line || '}}', ',' ORDER BY k) || ']' AS top_findings FROM r WHERE k <= 20 GROUP BY project_id)
  SELECT c.*, {GRADE} AS grade, top_findings FROM c JOIN t USING (project_id)""")
def notification_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.notification(findings(spark, sf_dir), "project_id")


@query(f"""WITH {FINDING}, {LATEST.format(n=1)}, r AS (SELECT f.*, l.scan_id AS last FROM finding f JOIN latest l ON l.project_id = f.project_id WHERE f.scan_id <= l.scan_id)
  SELECT project_id, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT fingerprint) AS BIGINT) AS n_fingerprints FROM r WHERE status = 'open' AND scan_id < last AND NOT EXISTS (SELECT 1 FROM r n WHERE n.project_id = r.project_id AND n.fingerprint = r.fingerprint AND n.scan_id = n.last) GROUP BY project_id""")
def resolve_open_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each project's last scan resolves of all that was open before it."""
    gone = store.resolved_open(findings(spark, sf_dir), scans(spark, sf_dir), tasks(spark, sf_dir))
    return gone.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fingerprint").alias("n_fingerprints"))


#: The first three orders of a customer are scans of a project, the parts of their rows what they find.
THREE = """nth AS (SELECT o_custkey AS project_id, o_orderkey AS scan_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
  hit AS (SELECT project_id, CAST(l_partkey % 40 AS VARCHAR) AS fingerprint, k, any_value(scan_id) AS scan_id FROM lineitem JOIN nth ON l_orderkey = scan_id WHERE k <= 3 GROUP BY ALL),
  made AS (SELECT project_id, max(k) FILTER (WHERE k <= 3) AS scans FROM nth GROUP BY project_id)"""


@query(f"""WITH {THREE}, f AS (SELECT project_id, fingerprint, arg_min(scan_id, k) AS first_scan, arg_max(scan_id, k) AS last_scan, min(k) AS lo, max(k) AS hi, count(*) AS n, any_value(scans) AS scans FROM hit JOIN made USING (project_id) GROUP BY project_id, fingerprint)
  SELECT project_id, fingerprint, CASE WHEN hi = scans THEN 'open' ELSE 'resolved' END AS status, first_scan, last_scan,
    TIMESTAMP '2024-01-01' + to_days(CAST(CASE WHEN hi < scans THEN hi + 1 WHEN n = hi - lo + 1 THEN lo ELSE 3 END AS INTEGER)) AS changed_at FROM f""")
def finding_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three scans of each project written to one table of findings, one after the other: found first, again, resolved, and opened again."""
    from pyspark.sql.window import Window

    from siftwarden.sinks import ledger, work

    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    scans = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("scan_id"), nth.alias("k")).where("k <= 3")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scan_id"), (F.col("l_partkey") % 40).cast("string").alias("fingerprint"))
    table = ledger.Ledger(spark, work.place(spark, "finding_ledger"), ["project_id", "fingerprint"], ledger.FINDINGS)
    for k in (1, 2, 3):
        of_turn = scans.where(F.col("k") == k).select("project_id", "scan_id")
        found = rows.join(of_turn, "scan_id").select("project_id", "fingerprint", F.lit("RULE").alias("rule_id"), F.lit("high").alias("severity")).distinct()
        ledger.scanned(table, of_turn, found, F.lit(f"2024-01-0{k + 1} 00:00:00").cast("timestamp_ntz"))
        if k == 2:
            table.compact()
    return table.read().select("project_id", "fingerprint", "status", "first_scan", "last_scan", "changed_at")
