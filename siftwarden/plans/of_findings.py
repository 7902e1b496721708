"""Queries on findings: dedupe, counts, floors, baselines, policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwarden.functions import severity as S
from siftwarden.operators import baseline, findings as ops, policy

from .registry import query
from .standins import BARE, COUNTS, FINDING, GRADE, RANK, WEIGHT, bare_findings, findings, read

ORDER = ["created_at", "scan_id", "line", "part", "supp"]
NOW = "TIMESTAMP '1998-01-01 00:00:00'"


@query(f"""WITH {FINDING} SELECT fingerprint, scan_id, line, rule_id, file_path, severity FROM (
  SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY created_at, scan_id, line, part, supp, severity) AS rn FROM finding) WHERE rn = 1""")
def fingerprint_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = ["fingerprint", "scan_id", "line", "rule_id", "file_path", "severity"]
    return ops.first_of(findings(spark, sf_dir), ["fingerprint"], [*ORDER, "severity"], told)


@query(f"WITH {FINDING} SELECT project_id, {COUNTS} FROM finding GROUP BY project_id")
def severity_counts_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.counts_by_severity(findings(spark, sf_dir), "project_id")


@query(f"WITH {FINDING}, s AS (SELECT project_id, CAST(sum({WEIGHT}) AS BIGINT) AS risk_score FROM finding GROUP BY project_id) SELECT project_id, risk_score, {GRADE} AS grade FROM s")
def risk_grade_per_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.risk(findings(spark, sf_dir), "project_id")


@query(f"""WITH {FINDING} SELECT scan_id, rule_id, severity, file_path, line, part, supp FROM finding
  ORDER BY {RANK}, file_path, line, scan_id, part, supp, rule_id LIMIT 50""")
def canonical_order_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = findings(spark, sf_dir).orderBy(*ops.canonical_order("scan_id", "part", "supp", "rule_id")).limit(50)
    return top.select("scan_id", "rule_id", "severity", "file_path", "line", "part", "supp")


@query(f"""WITH {BARE} SELECT rule_id, severity, CAST(count(*) AS BIGINT) AS n FROM bare
  WHERE {RANK} <= 2 AND confidence IN ('medium', 'high') AND rule_id NOT IN ('RULE-N1', 'RULE-R2') GROUP BY rule_id, severity""")
def severity_floor_and_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ops.above_floor(bare_findings(spark, sf_dir), "medium", "medium", ("RULE-N1", "RULE-R2"))
    return kept.groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


OVERRIDES = {"RULE-A0": "critical", "RULE-R3": "info", "RULE-N5": "low"}


@query(f"""WITH {BARE}, o AS (SELECT *, CASE rule_id WHEN 'RULE-A0' THEN 'critical' WHEN 'RULE-R3' THEN 'info' WHEN 'RULE-N5' THEN 'low' END AS new FROM bare)
  SELECT rule_id, coalesce(new, severity) AS severity, CASE WHEN new <> severity THEN severity END AS original_severity, CAST(count(*) AS BIGINT) AS n FROM o GROUP BY ALL""")
def severity_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.overridden(bare_findings(spark, sf_dir), OVERRIDES).groupBy("rule_id", "severity", "original_severity").agg(F.count(F.lit(1)).alias("n"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted findings: those of resolved rows, for 400 days from their scan; of supplier 0 of 10 for good."""
    f = findings(spark, sf_dir).where("status = 'resolved'")
    return f.select("fingerprint", "rule_id", "created_at", F.when(F.col("supp") % 10 != 0, F.col("created_at") + F.expr("INTERVAL 400 DAYS")).alias("expires_at"))


ENTRY = f"{FINDING}, entry AS (SELECT fingerprint, rule_id, created_at, CASE WHEN supp % 10 <> 0 THEN created_at + INTERVAL 400 DAYS END AS expires_at FROM finding WHERE status = 'resolved')"
OPEN = "opened AS (SELECT * FROM finding WHERE status = 'open')"


def _now():
    return F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")


@query(f"""WITH {ENTRY}, {OPEN}, known AS (SELECT fingerprint, bool_or(expires_at IS NULL OR expires_at > {NOW}) AS active FROM entry GROUP BY fingerprint)
  SELECT CASE WHEN active THEN 'suppressed' WHEN NOT active THEN 'expired' ELSE 'new' END AS disposition, severity, CAST(count(*) AS BIGINT) AS n
  FROM opened LEFT JOIN known USING (fingerprint) GROUP BY ALL""")
def baseline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = baseline.diff(findings(spark, sf_dir).where("status = 'open'"), _entries(spark, sf_dir), _now())
    return told.groupBy("disposition", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ENTRY}, {OPEN} SELECT rule_id, CAST(count(*) AS BIGINT) AS n FROM entry WHERE fingerprint NOT IN (SELECT fingerprint FROM opened) GROUP BY rule_id")
def baseline_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = baseline.fixed(findings(spark, sf_dir).where("status = 'open'"), _entries(spark, sf_dir))
    return gone.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ENTRY}, {OPEN} SELECT rule_id, CAST(count(*) AS BIGINT) AS n FROM entry WHERE fingerprint IN (SELECT fingerprint FROM opened) GROUP BY rule_id")
def baseline_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = baseline.pruned(findings(spark, sf_dir).where("status = 'open'"), _entries(spark, sf_dir))
    return kept.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


POLICY = policy.Policy(fail_on="critical", gates={"high": 12, "medium": 15}, max_risk=900)


@query(f"""WITH {FINDING}, c AS (SELECT project_id, {COUNTS}, CAST(sum({WEIGHT}) AS BIGINT) AS risk_score FROM finding GROUP BY project_id)
  SELECT project_id, 'severity_gate' AS kind, 'high' AS subject, high AS actual, CAST(12 AS BIGINT) AS allowed FROM c WHERE high > 12
  UNION ALL SELECT project_id, 'severity_gate', 'medium', medium, 15 FROM c WHERE medium > 15
  UNION ALL SELECT project_id, 'risk_score', 'total', risk_score, 900 FROM c WHERE risk_score > 900
  UNION ALL SELECT project_id, 'severity', rule_id, count(*), 0 FROM finding WHERE severity = 'critical' GROUP BY project_id, rule_id""")
def policy_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.violations(findings(spark, sf_dir), POLICY, "project_id")


@query(f"""WITH {FINDING}, c AS (SELECT project_id, CAST(sum({WEIGHT}) AS BIGINT) AS risk_score, CAST(count(*) FILTER (WHERE {RANK} <= 1) AS BIGINT) AS failing FROM finding GROUP BY project_id)
  SELECT project_id, risk_score, failing, failing = 0 AND risk_score <= 900 AS passed FROM c""")
def gate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    failing = F.count_if(policy.fails("high")).alias("failing")
    out = findings(spark, sf_dir).groupBy("project_id").agg(F.sum(S.weight(F.col("severity"))).cast("long").alias("risk_score"), failing)
    return out.withColumn("passed", (F.col("failing") == 0) & (F.col("risk_score") <= 900))


@query("""WITH c AS (SELECT p_partkey, p_name, p_brand, CASE p_size % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'npm' ELSE 'go' END AS ecosystem FROM part),
  r AS (SELECT 'python' AS ecosystem, 'Brand#11' AS name, 'old' AS reason UNION ALL SELECT '*', 'Brand#12', 'unsafe' UNION ALL SELECT '*', 'Brand#11', 'everywhere')
  SELECT p_partkey, c.ecosystem, p_brand AS name, coalesce(own.reason, every.reason) AS reason FROM c LEFT JOIN r own ON own.ecosystem = c.ecosystem AND own.name = p_brand
  LEFT JOIN r every ON every.ecosystem = '*' AND every.name = p_brand WHERE coalesce(own.reason, every.reason) IS NOT NULL""")
def blocked_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    eco = F.when(F.col("p_size") % 3 == 0, "python").when(F.col("p_size") % 3 == 1, "npm").otherwise("go")
    parts = read(spark, sf_dir, "part").select("p_partkey", eco.alias("ecosystem"), F.col("p_brand").alias("name"))
    rules = spark.createDataFrame([("python", "Brand#11", "older", 0), ("python", "Brand#11", "old", 1), ("*", "Brand#12", "unsafe", 2), ("*", "Brand#11", "everywhere", 3)], "ecosystem string, name string, reason string, no int")
    return policy.blocked_packages(parts, rules).select("p_partkey", "ecosystem", "name", "reason")
