"""What the corpus operators share: table access, work tables, word columns."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the characters between words: space and \x09-\x0D.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A driver table, or the named columns of it."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def whole_ids(docs: DataFrame) -> None:
    """Refuses a doc_id that isn't a whole number, since smallest ids and keys are told by it."""
    if dict(docs.dtypes)["doc_id"] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("doc_id must be a whole number; number text ids first")


def work_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for work tables: spark.checkpoint.dir.

    Only where that is unset (tests, one machine) a temporary folder of our own takes its place;
    it goes when the process ends.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="siftwarden-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df as a Parquet table of the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/siftwarden-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def boxed(docs: DataFrame, needed: list[str], results: list[str]) -> tuple[DataFrame, Callable[[DataFrame, list[str]], DataFrame]]:
    """docs with `needed` and all other columns in one, so that no name of theirs meets one that an operator makes;
    and what takes them out again beside the operator's results.  A column with a result's name gives way to it."""
    box = "__box"
    others = [f for f in docs.schema if f.name not in needed and f.name not in results]

    def opened(df: DataFrame, made: list[str]) -> DataFrame:
        first = [c for c in needed if c in df.columns and c not in made]
        return df.select(*first, *(F.col(box)[k].alias(f.name) for k, f in zip(map("c{}".format, range(len(others))), others)), *made)

    inner = [F.struct(*(F.col(f"`{f.name}`").alias(f"c{k}") for k, f in enumerate(others))).alias(box)] if others else []
    return docs.select(*needed, *inner), opened


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, as an array; null text: none."""
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def n_words(text: Column) -> Column:
    """How many words a text has, as a long; null text: 0."""
    return F.size(words(text)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`: which fold a document is in."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))
