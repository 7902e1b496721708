"""Dependencies against licence tables and advisories: findings with the ids that reports use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwarden.functions import licences as L, versions as V

from . import advisories as A

UNKNOWN = "UNKNOWN"
# Rule, severity and confidence of each class that is a finding.
LICENCE_RULES = {"unknown": ("LICENSE-UNKNOWN", "low", "high"), "blocked": ("LICENSE-COPYLEFT-DEPENDENCY", "high", "high"), "warning": ("LICENSE-REVIEW-REQUIRED", "low", "medium")}


def licensed(dependencies: DataFrame, licences: DataFrame) -> DataFrame:
    """dependencies (ecosystem, name, ...) with the licence of a table (ecosystem, name, licence), UNKNOWN where it has none."""
    named = licences.groupBy("ecosystem", F.lower("name").alias("_name")).agg(F.min("licence").alias("licence"))
    out = dependencies.drop("licence").withColumn("_name", F.lower("name")).join(named, ["ecosystem", "_name"], "left").drop("_name")
    return out.withColumn("licence", F.coalesce("licence", F.lit(UNKNOWN)))


def licence_findings(dependencies: DataFrame, licences: DataFrame, sets: dict[str, tuple[str, ...]] | None = None, unknown: str = "warn") -> DataFrame:
    """A finding for each dependency whose licence is blocked, wants review or isn't known; `unknown`: what a policy does with the last kind."""
    told = licensed(dependencies, licences).withColumn("licence_class", L.classify(F.col("licence"), sets, unknown))
    rule = lambda k: F.create_map(*(F.lit(x) for c, v in LICENCE_RULES.items() for x in (c, v[k])))[F.col("licence_class")]
    severity = F.when((F.col("licence_class") == "unknown") & F.lit(unknown == "block"), "medium").otherwise(rule(1))
    snippet = F.trim(F.concat_ws(" ", "name", F.coalesce("spec", F.lit(""))))
    return told.withColumns({"rule_id": rule(0), "severity": severity, "confidence": rule(2), "category": F.lit("license-compliance"), "snippet": snippet}).where("rule_id is not null")


def advisory_findings(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """A finding for each dependency and advisory that concerns it."""
    hit = A.matched(dependencies, advisories)
    known = F.lower("severity").isin("critical", "high", "medium", "low", "info")
    named = {"rule_id": F.concat(F.lit("DEP-"), F.col("id")), "severity": F.when(known, F.lower("severity")).otherwise("medium"), "category": F.lit("vulnerable-dependency"), "snippet": F.concat_ws(" ", "name", "spec")}
    return hit.withColumns(named)


def manifest_findings(rows: DataFrame) -> DataFrame:
    """A finding for each error row of parsed manifests."""
    rule = F.concat(F.lit("DEP-MANIFEST-"), F.regexp_extract("error", r"^([A-Z-]+)", 1))
    return rows.where("kind = 'error'").withColumns({"rule_id": rule, "severity": F.lit("low"), "confidence": F.lit("high"), "category": F.lit("manifest-integrity"), "snippet": F.substring_index("rel_path", "/", -1)})


def summary(dependencies: DataFrame, licences: DataFrame) -> DataFrame:
    """n of each class of licence, 0 included, over distinct components."""
    one = licensed(dependencies.select("ecosystem", V.package_name(F.col("ecosystem"), F.col("name")).alias("name"), "spec").distinct(), licences)
    many = one.groupBy(L.classify(F.col("licence")).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    all_ = dependencies.sparkSession.createDataFrame([(c,) for c in L.CLASSES], "class string")
    return all_.join(many, "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"))
