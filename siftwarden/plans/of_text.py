"""Queries on the text of documents and pages: rules, secrets, entropy, licences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwarden.functions import licences as L, severity as S, text as T
from siftwarden.operators import detect, findings as ops

from .registry import query
from .standins import GRADE, RANK, WEIGHT, dealt, dealt_sql, read, spread

_SPLIT = "regexp_split_to_array(coalesce(text, ''), '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]')"
LINE = f"""part AS (SELECT doc_id, source, {_SPLIT} AS p FROM documents),
  line AS (SELECT doc_id, source, unnest(p) AS line_text, CAST(generate_subscripts(p, 1) AS BIGINT) AS line FROM (SELECT doc_id, source, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS p FROM part))"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_SNIPPET = ("substr(trim(line_text, ' '), 1, 500)", "'<redacted:' || length(line_text) || '>'")


def _rule_sql(r: detect.Rule) -> str:
    skip = f" AND NOT regexp_matches(line_text, {_quoted(r.exclude)})" if r.exclude else ""
    return f"SELECT doc_id, source, line, '{r.rule_id}' AS rule_id, '{r.severity}' AS severity, '{r.category}' AS category, {_SNIPPET[r.category == "secret"]} AS snippet, line_text FROM line WHERE regexp_matches(line_text, {_quoted(r.pattern)}){skip}"


HIT = f"{LINE}, hit AS ({' UNION ALL '.join(map(_rule_sql, detect.TEXT_RULES))})"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.scan(detect.exploded(spread(spark, sf_dir, "documents").select("doc_id", "source", "text")), detect.TEXT_RULES)


@query(f"WITH {HIT} SELECT doc_id, line, rule_id, severity, snippet FROM hit WHERE category <> 'secret'")
def rule_scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).where("category <> 'secret'").select("doc_id", "line", "rule_id", "severity", "snippet")


@query(f"""WITH {HIT} SELECT doc_id, line, rule_id, severity, '<redacted:' || length(regexp_extract(line_text, '["'']([^"''\\s]{{8,}})["'']', 1)) || '>' AS value FROM hit WHERE category = 'secret'""")
def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = T.redacted(F.regexp_extract("line_text", r"""["']([^"'\s]{8,})["']""", 1))
    return _hits(spark, sf_dir).where("category = 'secret'").select("doc_id", "line", "rule_id", "severity", value.alias("value"))


#: Lower than the default, since the tables' values are hexadecimal.
LEAST_ENTROPY = 3.0


@query(f"""WITH {LINE}, v AS (SELECT doc_id, line, regexp_extract(line_text, {_quoted(detect.ASSIGNMENT)}, 1) AS name, regexp_extract(line_text, {_quoted(detect.ASSIGNMENT)}, 2) AS value
    FROM line WHERE length(line_text) <= {detect.LONGEST_LINE} AND regexp_matches(line_text, {_quoted(detect.ASSIGNMENT)})),
  c AS (SELECT doc_id, line, name, value, unnest(string_split(value, '')) AS ch FROM v), n AS (SELECT doc_id, line, name, value, ch, count(*) / any_value(length(value)) AS p FROM c WHERE ch <> '' GROUP BY doc_id, line, name, value, ch),
  e AS (SELECT doc_id, line, name, length(value) AS value_length, -sum(p * log2(p)) AS entropy FROM n GROUP BY doc_id, line, name, value)
  SELECT doc_id, line, name, CAST(value_length AS BIGINT) AS value_length, round(entropy, 6) AS entropy FROM e WHERE entropy >= {LEAST_ENTROPY}""")
def entropy_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = detect.exploded(spread(spark, sf_dir, "documents").select("doc_id", "text"))
    return detect.entropy_assignments(lines, LEAST_ENTROPY).select("doc_id", "line", "name", "value_length", F.round("entropy", 6).alias("entropy"))


@query(f"WITH {HIT}, s AS (SELECT source, CAST(count(*) AS BIGINT) AS n_findings, CAST(sum({WEIGHT}) AS BIGINT) AS risk_score FROM hit GROUP BY source) SELECT source, n_findings, risk_score, {GRADE} AS grade FROM s")
def source_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: documents to lines, all rules, findings, risk and grade of each source."""
    hits = _hits(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n_findings"), F.sum(S.weight(F.col("severity"))).cast("long").alias("risk_score"))
    return hits.withColumn("grade", S.grade(F.col("risk_score")))


@query(f"""WITH {HIT}, f AS (SELECT *, substr(sha256(rule_id || '|' || source || '|' || substr(regexp_replace(snippet, '[\\s\\x0B\\x1C-\\x1F]+', '', 'g'), 1, 400) || '|' || category), 1, 16) AS fingerprint FROM hit WHERE source IS NOT NULL)
  SELECT fingerprint, doc_id, line, rule_id FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY doc_id, line) AS rn FROM f) WHERE rn = 1""")
def document_findings_deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _hits(spark, sf_dir).where("source is not null").withColumn("fingerprint", T.fingerprint(F.col("rule_id"), F.col("source"), F.col("snippet"), F.col("category")))
    return ops.first_of(f, ["fingerprint"], ["doc_id", "line"]).select("fingerprint", "doc_id", "line", "rule_id")


SENTENCE = r"(?i)\b(?:licensed|released) under (?:the )?([A-Za-z0-9 .,-]*License[A-Za-z0-9 .,-]*)"


@query(f"WITH {LINE} SELECT doc_id, line, trim(regexp_extract(line_text, {_quoted(SENTENCE)}, 1), ' .') AS licence FROM line WHERE regexp_matches(line_text, {_quoted(SENTENCE)})")
def license_lines_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = detect.exploded(spread(spark, sf_dir, "documents").select("doc_id", "text")).where(F.col("line_text").rlike(SENTENCE))
    return lines.select("doc_id", "line", F.trim(F.regexp_extract("line_text", SENTENCE, 1), F.lit(" .")).alias("licence"))


@query(f"""WITH {HIT}, d AS (SELECT doc_id, max(CASE WHEN rule_id = 'PII-EMAIL-ADDRESS' THEN 1 ELSE 0 END) AS told FROM hit GROUP BY doc_id),
  l AS (SELECT doc_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS truth FROM labels GROUP BY doc_id), b AS (SELECT truth, coalesce(told, 0) AS told FROM l LEFT JOIN d USING (doc_id)),
  c AS (SELECT CAST(count(*) FILTER (WHERE truth = 1 AND told = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE truth = 0 AND told = 1) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE truth = 1 AND told = 0) AS BIGINT) AS fn FROM b)
  SELECT tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fn) END, 6) AS recall FROM c""")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _hits(spark, sf_dir).groupBy("doc_id").agg(F.max(F.when(F.col("rule_id") == "PII-EMAIL-ADDRESS", 1).otherwise(0)).alias("told"))
    truth = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("truth"))
    both = truth.join(told, "doc_id", "left").select("truth", F.coalesce("told", F.lit(0)).alias("told"))
    c = both.agg(F.sum(F.expr("IF(truth = 1 AND told = 1, 1, 0)")).alias("tp"), F.sum(F.expr("IF(truth = 0 AND told = 1, 1, 0)")).alias("fp"), F.sum(F.expr("IF(truth = 1 AND told = 0, 1, 0)")).alias("fn"))
    part = lambda x: F.round(F.when(F.col("tp") + F.col(x) == 0, 1.0).otherwise(F.col("tp") / F.nullif(F.col("tp") + F.col(x), F.lit(0))), 6)
    return c.select("tp", "fp", "fn", part("fp").alias("precision"), part("fn").alias("recall"))


#: Expressions to classify, with the class expected: fixed values.
EXPRESSIONS = [
    ("MIT", "allowed"), ("MIT OR GPL-3.0", "allowed"), ("MIT or GPL-3.0", "allowed"), ("MIT AND GPL-3.0", "blocked"), ("mit", "unknown"), ("GPL-3.0-only", "unknown"), ("LGPL-2.0", "warning"), ("LGPL-2.1", "blocked"), ("LGPL-3.0", "blocked"),
    ("Artistic-2.0", "warning"), ("BlueOak-1.0.0", "allowed"), ("OSL-3.0", "blocked"), ("EUPL-1.2", "blocked"), ("MPL-1.1", "warning"), ("CDDL-1.1", "warning"), ("CC0-1.0", "allowed"), ("(GPL-2.0 WITH Classpath-exception-2.0)", "blocked"), ("GPL-2.0 WITH OR MIT", "unknown"),
    ("MIT/Apache-2.0", "allowed"), ("MIT, GPL-2.0", "allowed"), ("Proprietary", "unknown"), ("MIT OR Proprietary", "allowed"), ("MIT AND Proprietary", "unknown"), ("MIT OR Apache-2.0 AND GPL-3.0", "unknown"), ("", "unknown"), ("NOASSERTION", "unknown"), ("None", "unknown"), ("MPL-2.0 AND MIT", "warning"),
]


#: Two licences joined: the better of them with OR, the worse with AND.
RANKED = {"MIT": 1, "Apache-2.0": 1, "MPL-2.0": 2, "EPL-2.0": 2, "Custom-1": 3, "GPL-3.0": 4, "AGPL-3.0": 4}
_NTH = "list_extract([" + ", ".join(f"'{x}'" for x in RANKED) + "], CAST(1 + p_partkey // {0} % " + str(len(RANKED)) + " AS INTEGER))"
_RANK = "list_extract(" + str(list(RANKED.values())) + ", CAST(1 + p_partkey // {0} % " + str(len(RANKED)) + " AS INTEGER))"


@query(
    f"WITH {dealt_sql(EXPRESSIONS, 'expression, class')} SELECT p_partkey, expression, class FROM dealt UNION ALL SELECT p_partkey, {_NTH.format(1)} || CASE p_partkey % 2 WHEN 0 THEN ' OR ' ELSE ' AND ' END || {_NTH.format(7)},"
    f" list_extract(['allowed', 'warning', 'unknown', 'blocked'], CASE p_partkey % 2 WHEN 0 THEN least({_RANK.format(1)}, {_RANK.format(7)}) ELSE greatest({_RANK.format(1)}, {_RANK.format(7)}) END) FROM part"
)
def license_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part one of the expressions above, and two licences joined."""
    k = F.col("p_partkey")
    nth = lambda by: F.get(F.array(*map(F.lit, RANKED)), (F.floor(k / by) % len(RANKED)).cast("int"))
    two = read(spark, sf_dir, "part").select("p_partkey", F.concat(nth(1), F.when(k % 2 == 0, " OR ").otherwise(" AND "), nth(7)).alias("expression"))
    rows = dealt(spark, sf_dir, [(a,) for a, _ in EXPRESSIONS], "expression string").select("p_partkey", "expression").unionByName(two)
    return rows.select("p_partkey", "expression", L.classify(F.col("expression")).alias("class"))


@query(f"WITH {HIT} SELECT severity, rule_id, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_files FROM hit WHERE {RANK} <= 3 GROUP BY severity, rule_id")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ops.above_floor(_hits(spark, sf_dir), "low")
    return kept.groupBy("severity", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_files"))
