"""Advisory and licence documents as tables: bundles, overlay folders, what an import brought, and their export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwarden.functions import versions as V
from siftwarden.operators.advisories import overlaid_packages

from . import documents

COLUMNS = ("ecosystem", "package", "id", "cve", "affected", "severity", "summary", "fixed_in")
# Other names of ecosystems, as documents may use them.
ALIASES = {"javascript": "npm", "node": "npm", "java": "maven", "pypi": "python", "golang": "go"}
_NATIVE = "map<string,map<string,array<struct<id:string,cve:string,affected:string,severity:string,summary:string,fixed_in:string>>>>"


def ecosystem_of(name: Column) -> Column:
    lower = F.lower(name)
    return F.coalesce(F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))[lower], lower)


def _texts(spark: SparkSession, path: str) -> DataFrame:
    """file and text of each JSON file."""
    return spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.substring_index(F.col("_metadata.file_path"), "/", -1).alias("file"), F.col("value").alias("text"))


def _native(texts: DataFrame) -> DataFrame:
    """Advisories of files in our own form, {ecosystem: {package: [advisory]}}; names that start with _ are notes."""
    ecosystems = texts.select("file", F.explode(F.from_json(F.regexp_replace("text", r'"_[A-Za-z0-9_]*"\s*:\s*"[^"]*"\s*,?', ""), _NATIVE)).alias("ecosystem", "packages")).where("ecosystem not like '\\\\_%'")
    rows = ecosystems.withColumn("ecosystem", ecosystem_of(F.col("ecosystem"))).select("file", "ecosystem", F.explode("packages").alias("_name", "found")).select("file", "ecosystem", V.package_name(F.col("ecosystem"), F.col("_name")).alias("package"), F.explode("found").alias("a"))
    return rows.select("file", "ecosystem", "package", "a.*").select("file", *COLUMNS).where("id is not null")


def is_osv(text):
    """Whether a text is of OSV records: one, a list of them, or a batch."""
    return text.rlike(r'^\s*(\[|\{)') & text.rlike(r'"affected"\s*:\s*\[')


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """COLUMNS of one file in our own form."""
    return _native(_texts(spark, path)).select(*COLUMNS)


def read_overlay(spark: SparkSession, folder: str, base: DataFrame | None = None) -> DataFrame:
    """COLUMNS of a folder's JSON files, of either form; the last file by name wins for a package, and all replace those of base."""
    texts = _texts(spark, folder)
    own = _native(texts.where(~is_osv(F.col("text"))))
    osv = documents.osv_rows(texts.where(is_osv(F.col("text"))))
    both = own.unionByName(osv.select("file", *COLUMNS))
    last = both.groupBy("ecosystem", "package").agg(F.max("file").alias("file"))
    found = both.join(last, ["ecosystem", "package", "file"], "left_semi").select(*COLUMNS)
    return found if base is None else overlaid_packages(base.select(*COLUMNS), found)


def import_stats(rows: DataFrame) -> DataFrame:
    """One row for each ecosystem: packages, advisories, with_cve, with_fix."""
    return rows.groupBy("ecosystem").agg(
        F.count_distinct("package").alias("packages"), F.count(F.lit(1)).alias("advisories"), F.count("cve").alias("with_cve"), F.count_if(F.coalesce("fixed_in", F.lit("")) != "").alias("with_fix")
    )


def read_licences(spark: SparkSession, path: str) -> DataFrame:
    """ecosystem, name and licence of files {ecosystem: {name: licence}}."""
    by = _texts(spark, path).select(F.explode(F.from_json("text", "map<string,map<string,string>>")).alias("ecosystem", "names"))
    return by.select(ecosystem_of(F.col("ecosystem")).alias("ecosystem"), F.explode("names").alias("name", "licence"))


def export_pieces(rows: DataFrame) -> DataFrame:
    """ecosystem, package and the JSON list of its advisories: one package of our own form in each row."""
    one = F.struct(*(c for c in COLUMNS if c not in ("ecosystem", "package")))
    return rows.groupBy("ecosystem", "package").agg(F.to_json(F.sort_array(F.collect_list(one))).alias("advisories"))
