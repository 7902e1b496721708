"""A training-data pipeline of five of the corpus operators, near duplicates included.

Each stage takes (spark, docs, sf_dir) and returns a table, written as Parquet and read again for the next one.
All but the last return the columns of documents.  Rows with a null doc_id are documents like all others: copies
among them go, and they are mixed by their sources' targets.  Rows that are alike in all columns are told
apart by their number alone.  A stage carries each row whole in one column, `row`, so whatever other columns documents have, of whatever
names, they come out as they went in; very long texts are judged whole; an empty table stays one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwarden.llm import decontam, mixing, neardup, sharding, toxicity
from siftwarden.llm.common import id_bucket, table, written


def whole(docs: DataFrame) -> Column:
    """All columns of a row as one."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, learnt from the labels' training fold, scores under 0.5 stay."""
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(id_bucket(F.col("doc_id"), 5) != 0)
    return toxicity.scored(docs.select(whole(docs), "text"), toxicity.learn(docs, labels), "score").where("score < 0.5").select("row.*")


#: Stands for a null doc_id among near copies: a named copy is kept before it.
NO_ID = (1 << 63) - 1


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one stays, the one with the smallest doc_id; of rows that repeat doc_id and text, the first by all columns."""
    keys = ["id", "mark"]
    named = docs.select(whole(docs), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), neardup.text_hash().alias("mark"), "text")
    found = written(neardup.classed(named.select(F.col("id").alias("doc_id"), "text")).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("mark"), "n_shingles", "kept"), "found")
    named = named.drop("text")
    again = found.where("kept and n_shingles > 0").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)
    kept = named.join(found.where("not kept").select(*keys).distinct(), keys, "left_anti")
    if not again.isEmpty():
        once = kept.join(again, keys, "left_semi").groupBy(*keys).agg(F.min("row").alias("row"))
        kept = kept.join(again, keys, "left_anti").unionByName(once)
    return kept.select("row.*")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item stay."""
    hits = decontam.with_hits(docs.select(whole(docs), "text"), table(spark, sf_dir, "benchmark", "item_id", "text"), "hits")
    return hits.where(F.size("hits") == 0).select("row.*")


#: Copies of one row that a task gives out.
COPIES = 1 << 12


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, 0 to 3; rows alike in all columns as often as they take it together."""
    columns = [c for name in docs.columns for c in (F.col(f"`{name}`"), F.col(f"`{name}`").isNull())]
    keyed = docs.select(whole(docs), F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(4), *columns).alias("b")).alias("key"), "source", "text")
    drawn = mixing.taken_words(keyed.select(F.col("key").alias("doc_id"), "source", "text")).groupBy(F.col("doc_id").alias("key"))
    drawn = written(drawn.agg(F.sum("copies").alias("all"), F.min("copies").alias("least"), F.max("copies").alias("most")).where("`all` > 0"), "drawn")
    keyed = keyed.select("row", "key")
    taken = keyed.join(drawn.where("least = most").select("key", F.col("least").alias("copies")), "key")
    # rows alike that differ in their copies: one of them, as often as all together
    uneven = drawn.where("least < most").select("key", "all")
    if not uneven.isEmpty():
        once = keyed.join(uneven, "key").dropDuplicates(["key"])
        once = once.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("all") - 1) / COPIES)))).repartition("key", "part")
        taken = taken.unionByName(once.withColumn("copies", F.least(F.lit(COPIES).cast("long"), F.col("all") - F.col("part") * COPIES)).drop("all", "part"))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with size, text_crc32, shard and slot."""
    return sharding.assign(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]
#: Training, hashing signatures and drawing copies have no SQL form; tests hold near copies and decontamination against
#: brute force, toxicity against a plain forward pass, and mixing and sharding against their laws.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
