"""The driver's tables read as security data, in Spark and, under the same names, as SQL.

org: region; project: customer; scan: orders; finding: lineitem; component: part; audit and request events: events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwarden.functions import text as T


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table over all cores where its files make fewer than two tasks for each; larger ones, of more splits, stay as they are read.

    For scans that weigh each row, since one row group is one task.
    """
    df, cores = read(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(cores)


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("scan_id"), F.col("o_custkey").alias("project_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("name"), F.col("n_regionkey").cast("long").alias("org_id"), F.col("c_mktsegment").alias("segment"))


def _told(lines: DataFrame, *more: str) -> DataFrame:
    """Rows of lineitem, l_orderkey as scan_id, as findings."""
    q = F.col("l_quantity")
    severity = F.when(q > 40, "critical").when(q > 30, "high").when(q > 20, "medium").when(q > 10, "low").otherwise("info")
    d = F.col("l_discount")
    confidence = F.when(d < 0.03, "low").when(d < 0.07, "medium").otherwise("high")
    df = lines.select(
        "scan_id", F.concat(F.lit("RULE-"), F.col("l_returnflag"), (F.col("l_suppkey") % 10).cast("string")).alias("rule_id"), severity.alias("severity"), confidence.alias("confidence"),
        F.concat(F.lit("src/m"), (F.col("l_partkey") % 97).cast("string"), F.lit(".py")).alias("file_path"), F.col("l_linenumber").cast("long").alias("line"),
        F.concat(F.lit("x = "), (F.col("l_partkey") % 13).cast("string")).alias("snippet"), F.when(F.col("l_linestatus") == "O", "open").otherwise("resolved").alias("status"),
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), *more,
    )
    return df.withColumn("fingerprint", T.fingerprint(F.col("rule_id"), F.col("file_path"), F.col("snippet"), F.lit("code")))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "scan_id")


def bare_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings without their scan's columns."""
    return _told(_lines(spark, sf_dir))


#: Findings that one task gets where there are many.
A_TASK = 250_000


def tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """Among how many tasks findings are dealt, so that what one of them holds doesn't grow with the table, whose rows the files' footers count; None where cores are enough."""
    n = -(-read(spark, sf_dir, "lineitem").count() // A_TASK)
    return n if n > spark.sparkContext.defaultParallelism else None


def findings(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    """Findings with their scan's columns, dealt by one of these if that is told; rows meet their scan as they are read and are dealt so, the longer texts are made after that."""
    lines, of_scan = _lines(spark, sf_dir), scans(spark, sf_dir).select("scan_id", "project_id", "created_at")
    if n := tasks(spark, sf_dir):
        lines, of_scan = lines.repartition(n, "scan_id"), of_scan.repartition(n, "scan_id")
    found = lines.join(of_scan, "scan_id")
    if by:
        found = found.repartition(n, by) if n else found.repartition(by)
    return _told(found, "project_id", "created_at")


def dealt(spark: SparkSession, sf_dir: str, rows: list[tuple], schema: str) -> DataFrame:
    """Each part with one of a few rows, by its key: a table of as many cases as there are parts."""
    few = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"_case long, {schema}")
    return read(spark, sf_dir, "part").withColumn("_case", F.pmod("p_partkey", F.lit(len(rows)))).join(F.broadcast(few), "_case").drop("_case")


def dealt_sql(rows: list[tuple], columns: str, types: dict[str, str] | None = None) -> str:
    """The same as a table `dealt` of SQL."""
    value = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, (bool, int)) else "'" + v.replace("'", "''") + "'"
    return f"dealt AS (SELECT part.*, t.* FROM part JOIN (VALUES {', '.join(f'({k}, ' + ', '.join(map(value, r)) + ')' for k, r in enumerate(rows))}) t(_case, {columns}) ON p_partkey % {len(rows)} = _case)"


def made_files(spark: SparkSession, sf_dir: str, texts: list[tuple[str, str]], shift: bool = False) -> DataFrame:
    """A file for each part: rel_path below a folder of its own, content with the part's key for @N@, behind 0 to 4 empty lines where `shift`."""
    rows = dealt(spark, sf_dir, texts, "_path string, _text string")
    lines = F.repeat(F.lit("\n"), (F.col("p_size") % 5).cast("int")) if shift else F.lit("")
    key = F.col("p_partkey").cast("string")
    return rows.select(F.concat(F.lit("p"), key, F.lit("/"), F.col("_path")).alias("rel_path"), F.concat(lines, F.replace("_text", F.lit("@N@"), key)).alias("content"))


def made_sql(paths: list[str], found: list[tuple], columns: str) -> str:
    """What is found in the made files: rows of (path, columns), for each part whose file has that path, with its key and `shift`."""
    value = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, (bool, int)) else "'" + v.replace("'", "''") + "'"
    values = ", ".join(f"({paths.index(r[0])}, {', '.join(map(value, r))})" for r in found)
    return f"made AS (SELECT 'p' || p_partkey || '/' || path AS rel_path, p_partkey, p_size % 5 AS shift, t.* EXCLUDE (_case, path) FROM part JOIN (VALUES {values}) t(_case, path, {columns}) ON p_partkey % {len(paths)} = _case)"


SCAN = """scan AS (SELECT o_orderkey AS scan_id, o_custkey AS project_id, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, o_orderdate AS created_at FROM orders)"""
PROJECT = """project AS (SELECT c_custkey AS project_id, c_name AS name, CAST(n_regionkey AS BIGINT) AS org_id, c_mktsegment AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
BARE = """bare AS (SELECT *, substr(sha256(rule_id || '|' || file_path || '|' || replace(snippet, ' ', '') || '|code'), 1, 16) AS fingerprint FROM (
  SELECT l_orderkey AS scan_id, 'RULE-' || l_returnflag || (l_suppkey % 10) AS rule_id,
    CASE WHEN l_quantity > 40 THEN 'critical' WHEN l_quantity > 30 THEN 'high' WHEN l_quantity > 20 THEN 'medium' WHEN l_quantity > 10 THEN 'low' ELSE 'info' END AS severity,
    CASE WHEN l_discount < 0.03 THEN 'low' WHEN l_discount < 0.07 THEN 'medium' ELSE 'high' END AS confidence,
    'src/m' || (l_partkey % 97) || '.py' AS file_path, CAST(l_linenumber AS BIGINT) AS line, 'x = ' || (l_partkey % 13) AS snippet,
    CASE WHEN l_linestatus = 'O' THEN 'open' ELSE 'resolved' END AS status, l_partkey AS part, l_suppkey AS supp FROM lineitem))"""
FINDING = f"{SCAN}, {BARE}, finding AS (SELECT bare.*, project_id, created_at FROM bare JOIN scan USING (scan_id))"
RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
WEIGHT = "CASE severity WHEN 'critical' THEN 40 WHEN 'high' THEN 20 WHEN 'medium' THEN 8 WHEN 'low' THEN 3 ELSE 0 END"
GRADE = "CASE WHEN least(risk_score, 100) <= 0 THEN 'A+' WHEN least(risk_score, 100) <= 10 THEN 'A' WHEN least(risk_score, 100) <= 25 THEN 'B' WHEN least(risk_score, 100) <= 50 THEN 'C' WHEN least(risk_score, 100) <= 90 THEN 'D' ELSE 'F' END"
COUNTS = ", ".join(f"CAST(count(*) FILTER (WHERE severity = '{s}') AS BIGINT) AS {s}" for s in ("critical", "high", "medium", "low", "info"))
