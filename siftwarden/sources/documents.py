"""Stored documents read with explicit schemas: advisory records, baselines, reports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwarden.functions import text as T, versions as V
from siftwarden.operators import advisories

EVENT = "struct<introduced:string,fixed:string,last_affected:string,limit:string>"
OSV = f"""id string, modified string, published string, withdrawn string, aliases array<string>, summary string, details string, severity array<struct<type:string,score:string>>,
affected array<struct<package:struct<ecosystem:string,name:string,purl:string>,ranges:array<struct<type:string,events:array<{EVENT}>>>,versions:array<string>>>, database_specific struct<severity:string>"""
_STRUCT = re.sub(r"(^|, |,\n)(\w+) ", lambda m: m[1].replace("\n", "").strip(" ") + m[2] + ":", OSV)
# Our name for a feed's ecosystem and severity.
ECOSYSTEMS = {"PyPI": "python", "npm": "npm", "Go": "go", "Maven": "maven", "RubyGems": "ruby", "Packagist": "php", "crates.io": "rust", "NuGet": "nuget"}
SEVERITIES = {"critical": "critical", "high": "high", "moderate": "high", "medium": "medium", "low": "low"}


def _mapped(col, values: dict):
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[col]


def read_osv(spark: SparkSession, path: str) -> DataFrame:
    """Advisories (ecosystem, package, id, cve, affected, severity, summary, fixed_in) of JSON records, one, many or a batch a file.

    Withdrawn records, source-control ranges and packages without ranges or versions give none.
    """
    texts = spark.read.text(path, wholetext=True).select(F.lit("").alias("file"), F.col("value").alias("text"))
    return osv_rows(texts).drop("file")


def osv_rows(texts: DataFrame) -> DataFrame:
    """The same from a table of texts (file, text), with the file of each."""
    one = F.from_json("text", OSV)
    many = F.from_json("text", f"array<struct<{_STRUCT}>>")
    batch = F.from_json("text", f"struct<vulns:array<struct<{_STRUCT}>>>")["vulns"]
    records = F.when(F.col("text").rlike(r"^\s*\["), many).when(F.col("text").rlike(r'"vulns"\s*:'), batch).otherwise(F.array(one))
    raw = texts.select("file", F.explode(records).alias("r")).where("r is not null").select("file", "r.*").where("id is not null and withdrawn is null")
    one = raw.select("*", F.explode("affected").alias("a"))
    kept = F.filter(F.coalesce("a.ranges", F.expr(f"cast(array() as array<struct<type:string,events:array<{EVENT}>>>)")), lambda r: r["type"] != "GIT")
    spans = F.array_join(F.transform(kept, lambda r: advisories.ranges(r["events"])), "||")
    named = F.array_join(F.transform(F.coalesce("a.versions", F.expr("cast(array() as array<string>)")), lambda v: F.concat(F.lit("="), v)), "||")
    affected = F.concat_ws("||", F.nullif(spans, F.lit("")), F.nullif(named, F.lit("")))
    fixed = F.get(F.filter(F.flatten(F.transform(kept, lambda r: r["events"])), lambda e: e["fixed"].isNotNull()), F.lit(0))["fixed"]
    eco = F.coalesce(_mapped(F.substring_index("a.package.ecosystem", ":", 1), ECOSYSTEMS), F.lower("a.package.ecosystem"))
    cve = F.get(F.filter(F.concat(F.array("id"), F.coalesce("aliases", F.expr("cast(array() as array<string>)"))), lambda x: x.startswith("CVE-")), F.lit(0))
    out = one.select(
        "file", eco.alias("ecosystem"), V.package_name(eco, F.col("a.package.name")).alias("package"), "id", cve.alias("cve"), affected.alias("affected"),
        F.coalesce(_mapped(F.lower("database_specific.severity"), SEVERITIES), F.lit("medium")).alias("severity"), F.substring(F.trim(F.regexp_replace(F.coalesce("summary", "details", F.lit("")), T.BLANK, " ")), 1, 300).alias("summary"), F.coalesce(fixed, F.lit("")).alias("fixed_in"),
    )
    return out.where("affected <> ''")


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a baseline file: of the older form, bare fingerprints, or of the newer, records."""
    entry = "fingerprint string, rule_id string, file string, line int, severity string, reason string, created_at timestamp, expires_at timestamp, created_by string"
    raw = spark.read.schema(f"schema_version int, fingerprints array<string>, entries array<struct<{', '.join(x.replace(' ', ':') for x in entry.split(', '))}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    bare = raw.select(F.explode("fingerprints").alias("fingerprint")).where("fingerprint is not null")
    return raw.select(F.inline("entries")).unionByName(bare, allowMissingColumns=True)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a JSON-lines report, with whether the fingerprint they carry is theirs."""
    raw = spark.read.schema("fingerprint string, rule_id string, severity string, file_path string, line long, snippet string, category string").json(path)
    return raw.withColumn("fingerprint_verified", F.col("fingerprint") == T.fingerprint(F.col("rule_id"), F.col("file_path"), F.col("snippet"), F.col("category")))


_LOCATION = "struct<file_path:string,start_line:long,end_line:long,snippet:string>"


def read_json_report(spark: SparkSession, path: str) -> DataFrame:
    """Findings of JSON reports, one document a file, with whether their fingerprint is theirs; a file that is no report is refused."""
    found = f"array<struct<rule_id:string,severity:string,confidence:string,category:string,location:{_LOCATION},fingerprint:string>>"
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", f"target string, findings {found}").alias("d")).select("d.target", "d.findings")
    # each file is one row, so what is refused is known before its findings are told apart
    docs = docs.select("target", F.when(F.col("findings").isNull(), F.raise_error(F.lit("not a findings report"))).otherwise(F.col("findings")).alias("findings"))
    rows = docs.select("target", F.explode("findings").alias("f")).select("target", "f.rule_id", "f.severity", "f.confidence", "f.category", "f.location.file_path", F.col("f.location.start_line").alias("line"), "f.location.end_line", "f.location.snippet", "f.fingerprint")
    return rows.withColumn("fingerprint_verified", F.col("fingerprint") == T.fingerprint(F.col("rule_id"), F.col("file_path"), F.col("snippet"), F.col("category")))
