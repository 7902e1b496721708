"""Whole runs: all detectors over documents that stand for source files, findings and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwarden.operators import compliance, detect, engine, findings as ops
from siftwarden.sources.builtin import RULES

from .of_supply import COMPONENT, components
from .of_text import LINE, _quoted
from .registry import query
from .standins import COUNTS, GRADE, RANK, spread

#: A document's language by its number: those whose comments are whole lines.
LANGUAGES = ("javascript", "ruby", "shell", "go", "php", "sql", "yaml", "other")
SETTINGS = engine.Settings(engines=("rule-engine", "secrets"), min_severity="low", ignored=("SHELL-UNQUOTED-VARIABLE",), overrides={"SECRETS-HARDCODED-CREDENTIAL": "critical"}, entropy_threshold=3.0)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    language = F.get(F.array(*map(F.lit, LANGUAGES)), (F.col("doc_id") % len(LANGUAGES)).cast("int"))
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit("."), language)
    return spread(spark, sf_dir, "documents").select(path.alias("rel_path"), language.alias("language"), F.lit(None).cast("string").alias("iac_kind"), F.lit(False).alias("is_manifest"), F.col("text").alias("content"))


def _rule_sql(r: detect.Rule, engine_: str) -> str:
    skip = f" AND NOT regexp_matches(line_text, {_quoted(r.exclude)})" if r.exclude else ""
    where = " AND length(line_text) <= 2000" if engine_ == "secrets" else f" AND NOT comment AND language IN ({', '.join(map(_quoted, r.languages))})" if "*" not in r.languages else " AND NOT comment"
    snippet = "'<redacted:' || length(line_text) || '>'" if r.category == "secret" else "substr(trim(line_text, ' '), 1, 500)"
    severity = SETTINGS.overrides.get(r.rule_id, r.severity)
    return f"SELECT '{engine_}' AS engine, file_path, line, '{r.rule_id}' AS rule_id, '{severity}' AS severity, '{r.severity}' AS declared, '{r.category}' AS category, {snippet} AS snippet FROM src WHERE regexp_matches(line_text, {_quoted(r.pattern)}){skip}{where}"


_MARK = "CASE language " + " ".join(f"WHEN '{k}' THEN '{detect.COMMENT[k]}'" for k in LANGUAGES if k in detect.COMMENT) + " END"
_A = _quoted(detect.ASSIGNMENT)
#: Of whole-file rules none is for a language here.
FOUND = f"""{LINE}, named AS (SELECT doc_id, line, line_text, ['{"', '".join(LANGUAGES)}'][doc_id % {len(LANGUAGES)} + 1] AS language FROM line),
  src AS (SELECT 'docs/' || doc_id || '.' || language AS file_path, language, line, line_text, coalesce(starts_with(ltrim(line_text, ' ' || chr(9)), {_MARK}), false) AS comment FROM named),
  v AS (SELECT file_path, line, regexp_extract(line_text, {_A}, 1) AS name, regexp_extract(line_text, {_A}, 2) AS value FROM src WHERE length(line_text) <= 2000 AND regexp_matches(line_text, {_A})),
  ch AS (SELECT file_path, line, name, value, unnest(string_split(value, '')) AS c FROM v), p AS (SELECT file_path, line, name, value, c, count(*) / any_value(length(value)) AS p FROM ch WHERE c <> '' GROUP BY ALL),
  e AS (SELECT file_path, line, name, length(value) AS n FROM p GROUP BY file_path, line, name, value HAVING -sum(p * log2(p)) >= 3.0),
  hit AS ({" UNION ALL ".join([_rule_sql(r, "rule-engine") for r in RULES if not r.whole and set(r.languages) & set(LANGUAGES)] + [_rule_sql(r, "secrets") for r in detect.SECRET_RULES])}
    UNION ALL SELECT 'secrets', file_path, line, 'SECRETS-HIGH-ENTROPY-ASSIGNMENT', 'high', 'high', 'secret', name || ' = <redacted:' || n || '>' FROM e),
  kept AS (SELECT *, substr(sha256(rule_id || '|' || file_path || '|' || substr(regexp_replace(snippet, '[\\s\\x0B\\x1C-\\x1F]+', '', 'g'), 1, 400) || '|' || category), 1, 16) AS fingerprint FROM hit WHERE declared <> 'info' AND rule_id <> 'SHELL-UNQUOTED-VARIABLE'),
  found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY file_path, line, rule_id, engine) AS rn FROM kept) WHERE rn = 1)"""


@query(f"WITH {FOUND} SELECT engine, rule_id, severity, category, file_path, line, snippet, fingerprint FROM found")
def engine_scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of eight languages: rules with their masks, secrets and entropy, override, floor, de-duplication."""
    return engine.run(files(spark, sf_dir), SETTINGS).select("engine", "rule_id", "severity", "category", "file_path", "line", "snippet", "fingerprint")


@query(f"""WITH {FOUND}, n AS (SELECT {COUNTS}, CAST(count(*) AS BIGINT) AS n_findings FROM found), s AS (SELECT *, 40 * critical + 20 * high + 8 * medium + 3 * low AS risk_score FROM n)
  SELECT (SELECT CAST(count(text) AS BIGINT) FROM documents) AS files_scanned, (SELECT CAST(count(*) - count(text) AS BIGINT) FROM documents) AS files_skipped, (SELECT CAST(sum(CASE WHEN text = '' THEN 0 ELSE length(regexp_replace(text, '\\r\\n', chr(10), 'g')) - length(replace(regexp_replace(text, '\\r\\n', chr(10), 'g'), chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END END) AS BIGINT) FROM documents) AS lines_scanned,
    critical, high, medium, low, info, n_findings, risk_score, {GRADE} AS grade FROM s""")
def engine_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = files(spark, sf_dir)
    return engine.stats(some, engine.run(some, SETTINGS))


@query(f"WITH {FOUND} SELECT engine, severity, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT file_path) AS BIGINT) AS n_files FROM found WHERE {RANK} <= 3 GROUP BY engine, severity")
def engine_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.above_floor(engine.run(files(spark, sf_dir), SETTINGS), "low")
    return found.groupBy("engine", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_path").alias("n_files"))


_LICENCE = "CASE WHEN l.licence IS NULL THEN 'unknown' WHEN l.licence = 'MIT' OR l.licence = 'MIT OR GPL-2.0' THEN 'allowed' WHEN l.licence = 'GPL-3.0' THEN 'blocked' WHEN l.licence = 'MPL-2.0' THEN 'warning' ELSE 'unknown' END"


@query(f"""WITH {COMPONENT}, l AS (SELECT ecosystem, lower(name) AS name, min(licence) AS licence FROM component WHERE p_partkey % 4 <> 0 GROUP BY 1, 2),
  k AS (SELECT p_partkey, coalesce(l.licence, 'UNKNOWN') AS licence, {_LICENCE} AS class FROM component c LEFT JOIN l ON l.ecosystem = c.ecosystem AND l.name = lower(c.name))
  SELECT p_partkey, licence, CASE class WHEN 'blocked' THEN 'LICENSE-COPYLEFT-DEPENDENCY' WHEN 'warning' THEN 'LICENSE-REVIEW-REQUIRED' ELSE 'LICENSE-UNKNOWN' END AS rule_id, CASE class WHEN 'blocked' THEN 'high' ELSE 'low' END AS severity, CASE class WHEN 'warning' THEN 'medium' ELSE 'high' END AS confidence FROM k WHERE class <> 'allowed'""")
def license_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as dependencies against a licence table that three quarters of them make: looked up by name, classified, reported."""
    deps = components(spark, sf_dir).withColumn("spec", F.concat(F.lit("=="), F.col("version")))
    table = deps.where("p_partkey % 4 <> 0").select("ecosystem", "name", "licence")
    return compliance.licence_findings(deps.drop("licence"), table).select("p_partkey", "licence", "rule_id", "severity", "confidence")
