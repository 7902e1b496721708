"""The packaged rules over pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwarden.operators import detect
from siftwarden.sources.builtin import RULES

from .registry import query
from .standins import spread

_JS = [r for r in RULES if "javascript" in r.languages]


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql(r: detect.Rule) -> str:
    skip = f" AND NOT regexp_matches(line_text, {_quoted(r.exclude)})" if r.exclude else ""
    return f"SELECT page_id, '{r.rule_id}' AS rule_id FROM line WHERE regexp_matches(line_text, {_quoted(r.pattern)}){skip}"


@query(
    "WITH line AS (SELECT page_id, unnest(regexp_split_to_array(coalesce(html, ''), '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]')) AS line_text FROM pages), hit AS ("
    + " UNION ALL ".join(map(_sql, _JS))
    + ") SELECT rule_id, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT page_id) AS BIGINT) AS n_pages FROM hit GROUP BY rule_id"
)
def script_rules_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read as scripts: all JavaScript rules in one pass."""
    lines = detect.exploded(spread(spark, sf_dir, "pages").select("page_id", "html", F.lit("javascript").alias("language")), "html")
    return detect.scan(lines, _JS, "language").groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("n_pages"))
