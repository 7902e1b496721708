"""Import of advisory records from folders of files: what was read, and what couldn't be.

Files are JSON or YAML, each a record, a list of records or a batch (`vulns`).  A file that can't be read is a row with the reason and
ends nothing.  YAML in block style wants PyYAML on the workers; where that is missing such files count as unreadable.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwarden.operators.findings import first_of

from . import documents
from .feeds import COLUMNS

try:
    import yaml
except ImportError:
    yaml = None


def texts(spark: SparkSession, folders: list[str]) -> DataFrame:
    """source_no, file and text (bytes) of all .json, .yaml and .yml files below the folders, the most trusted folder first."""
    out = None
    for k, folder in enumerate(folders):
        read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.lower("path").rlike(r"\.(json|ya?ml)$"))
        one = read.select(F.lit(k).alias("source_no"), F.col("path").alias("file"), F.col("content").alias("text"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no folder to import from")
    return out


def _load(name: str, text: str):
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        if not name.lower().endswith((".yaml", ".yml")):
            raise
    if yaml is None:
        raise ValueError("no reader for YAML")
    return yaml.load(text, Loader=yaml.BaseLoader)  # texts and lists only: dates and numbers stay as they are written


def _records(payload) -> list[dict]:
    if isinstance(payload, dict):
        inner = payload.get("vulns")
        if isinstance(inner, list):
            return [r for r in inner if isinstance(r, dict)]
        return [payload] if "id" in payload and "affected" in payload else []
    return [r for r in payload if isinstance(r, dict)] if isinstance(payload, list) else []


def decoded(files: DataFrame) -> DataFrame:
    """source_no, file, nth, record (as JSON) and error: a row for each record, and one with an error for each file that can't be read.

    Each text is looked at once; keep the result (a table, persist) where both records and sums are asked for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for source, name, text in zip(*(batch[c].to_pylist() for c in ("source_no", "file", "text"))):
                try:
                    rows += [(source, name, k, json.dumps(r, ensure_ascii=False, default=str), None) for k, r in enumerate(_records(_load(name or "", (text or b"").decode())))]
                except Exception as e:  # whatever a reader makes of a file's bytes, the file is told and the others go on
                    rows.append((source, name, None, None, f"{type(e).__name__}: {e}"[:200]))
            kinds = (("source_no", pa.int32()), ("file", pa.string()), ("nth", pa.int32()), ("record", pa.string()), ("error", pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    return files.select(F.col("source_no").cast("int").alias("source_no"), "file", F.col("text").cast("binary").alias("text")).mapInArrow(run, "source_no int, file string, nth int, record string, error string")


def entries(read: DataFrame) -> DataFrame:
    """source_no, file, nth and COLUMNS of every package that a record names."""
    place = F.to_json(F.struct("source_no", "file", "nth"))
    rows = documents.osv_rows(read.where("record is not null").select(place.alias("file"), F.col("record").alias("text")))
    return rows.withColumn("_at", F.from_json("file", "source_no int, file string, nth int")).select("_at.*", *COLUMNS)


def merged(rows: DataFrame, ecosystems: tuple[str, ...] = (), limit: int = 0) -> DataFrame:
    """COLUMNS, one advisory for each package and CVE (id where it has none), of the first source that has it; limit: as many of a package at most, 0 for all."""
    some = rows.where(F.col("ecosystem").isin(*ecosystems)) if ecosystems else rows
    some = first_of(some.withColumn("_name", F.coalesce("cve", "id")), ["ecosystem", "package", "_name"], ["source_no", "file", "nth", "id"]).drop("_name")
    if limit:
        from pyspark.sql.window import Window

        nth = F.row_number().over(Window.partitionBy("ecosystem", "package").orderBy("source_no", "file", "nth", "id"))
        some = some.withColumn("_nth", nth).where(F.col("_nth") <= limit).drop("_nth")
    return some.select(*COLUMNS)


def sums(read: DataFrame, rows: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: records, unreadable files, duplicates that were merged, packages and advisories; rows: the entries of what was read, kept: `merged` of these."""
    of_files = read.agg(F.count("record").alias("records"), F.count("error").alias("unreadable"))
    keys = F.count_distinct("ecosystem", "package", F.coalesce("cve", "id"))
    of_rows = rows.agg((F.count(F.lit(1)) - keys).alias("duplicates"))
    of_kept = kept.agg(F.count_distinct("ecosystem", "package").alias("packages"), F.count(F.lit(1)).alias("advisories"))
    one = lambda df: df.withColumn("_k", F.lit(1))  # noqa: E731  a row each
    return one(of_files).join(one(of_rows), "_k").join(one(of_kept), "_k").drop("_k")
