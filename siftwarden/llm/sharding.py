"""Operator 10, sharding: vector bin packing of bytes, tokens and rows.

Documents with equal texts form a group.  A group of at least 1/(shards * HEAVY) of the table's
bytes, tokens or rows is heavy: there are at most 3 * shards * HEAVY of these, and each is a vector of its own.  It stays whole
unless it holds more than a whole shard's share of any of the three; then it is cut by the rank of its rows into
pieces of about 1/HEAVY of a share, never more than it has rows.  All other groups ride whole in one of BUNDLES
bundles, picked by the hash of their text.  Pieces, heavy groups and bundles, whose number is bounded whatever the input, are
the vectors to pack, so packing decides where these go: largest first, each goes to the shard where the
dot product of its vector with the residual capacity is highest.  Bytes weigh most, since the law that holds is `bytes`.

Rows get a number of their own in a written table, so that ranks, counts and the rows themselves agree whatever is run
again.  Ranks, of a heavy group's rows and of a shard's, are those within a bucket of row numbers plus the counts of the
buckets before it, so that no task ranks a whole group or shard.

Nulls and edges: a null text has no bytes, no tokens, crc32 0 and groups with other null texts; ids decide nothing, so
null and repeated ones are placed like any other, and repeated rows take a slot each; very long texts only add to
sums; groups that tie go in the order of their hashes; columns of docs stay, but one named as a
result column gives way to it; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import boxed, n_words, table, written

SHARDS = 40
BUNDLES = 8192
HEAVY = 16
ROW_BYTES = 16
#: How much an equal share of bytes, tokens and rows counts in the dot product.
WEIGHTS = (8.0, 1.0, 1.0)
#: Rows that are ranked together, about.
SLOT_ROWS = 20_000


def pack(vectors: np.ndarray, shards: int, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """The shard of each vector (bytes, tokens, rows)."""
    if not len(vectors):
        return np.zeros(0, int)
    total = vectors.sum(axis=0)
    v = vectors / np.where(total > 0, total, 1) * shards * np.sqrt(weights)
    left, out = np.tile(np.sqrt(weights), (shards, 1)), np.zeros(len(v), int)
    for k in np.lexsort((np.arange(len(v)), -(v * v).sum(axis=1))):
        out[k] = best = int(np.argmax(left @ v[k]))
        left[best] -= v[k]
    return out


RESULTS = ["size", "text_crc32", "shard", "slot"]


def measured(docs: DataFrame) -> DataFrame:
    """docs with size, text_crc32, and the tokens and group that packing needs."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.withColumns({"size": (F.octet_length(text) + ROW_BYTES).cast("long"), "text_crc32": F.crc32(text).cast("long"), "_tokens": n_words(F.col("text")), "_group": F.xxhash64("text")})


def assign(docs: DataFrame, shards: int = SHARDS, bundles: int = BUNDLES) -> DataFrame:
    """docs with size, text_crc32, shard and slot; needs doc_id and text."""
    docs, opened = boxed(docs, ["doc_id", "text"], RESULTS)
    return opened(placed(measured(docs), shards, bundles), RESULTS)


def placed(told: DataFrame, shards: int = SHARDS, bundles: int = BUNDLES) -> DataFrame:
    """Measured rows, of whatever other columns, with shard and slot."""
    spark = told.sparkSession
    keyed = written(told.withColumn("_row", F.monotonically_increasing_id()), "keyed")
    slim = keyed.select("_row", "size", "_tokens", "_group")
    dims = {"b": F.sum("size"), "t": F.sum("_tokens"), "r": F.count(F.lit(1))}
    sums = lambda df, by: df.groupBy(by).agg(*(f.cast("double").alias(k) for k, f in dims.items()))
    total = slim.agg(*(f.cast("double").alias(k) for k, f in dims.items())).first()
    if not total.r:
        return keyed.drop("_tokens", "_group", "_row").withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    share = {k: max(total[k] or 0.0, 1.0) / (shards * HEAVY) for k in dims}
    part = F.greatest(*(F.col(k) / share[k] for k in dims))
    # at most len(dims) * shards * HEAVY groups reach a full part: a proven bound, so these go to all workers
    parts = F.when(part <= HEAVY, 1).otherwise(F.least(F.ceil(part), F.col("r"))).cast("int")
    groups = sums(slim, "_group").withColumn("_parts", parts).where(part >= 1).orderBy("_group").collect()
    vectors, heavy = [], []
    for g in groups:
        heavy.append((g["_group"], g["_parts"], bundles + len(vectors)))
        vectors += [(g.b / g["_parts"], g.t / g["_parts"], g.r / g["_parts"])] * g["_parts"]
    heavy = F.broadcast(spark.createDataFrame(heavy, "_group long, _parts int, _base int"))
    light = slim.join(heavy, "_group", "left_anti").withColumn("_bundle", F.pmod(F.xxhash64("_group"), F.lit(bundles)).cast("int"))
    rows = sums(light, "_bundle").orderBy("_bundle").collect()  # `bundles` at most
    names = [r["_bundle"] for r in rows] + list(range(bundles, bundles + len(vectors)))
    shard = pack(np.array([[r.b, r.t, r.r] for r in rows] + vectors), shards)
    to = F.broadcast(spark.createDataFrame(list(zip(names, map(int, shard))), "_bundle int, shard int"))
    pieces = ranked(slim.join(heavy, "_group"), "_group", 1 + int(total.r) // SLOT_ROWS, "_rank")
    pieces = pieces.withColumn("_bundle", F.col("_base") + F.pmod("_rank", "_parts").cast("int"))
    out = written(light.select("_row", "_bundle").unionByName(pieces.select("_row", "_bundle")).join(to, "_bundle").select("_row", "shard"), "shards")
    out = ranked(out, "shard", 1 + int(total.r) // (shards * SLOT_ROWS), "slot")
    return keyed.join(out, "_row").drop("_tokens", "_group", "_row")


def ranked(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """df (_row, key, ...) with each row's rank from 0 among those of its key, in the order of buckets and row numbers."""
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(9), "_row"), F.lit(buckets)).cast("int"))
    counts = df.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(key).orderBy("_bucket")) - F.col("_n")).drop("_n")
    df = df.withColumn("_nth", F.row_number().over(Window.partitionBy(key, "_bucket").orderBy("_row")))
    return df.join(before, [key, "_bucket"]).withColumn(name, (F.col("_before") + F.col("_nth") - 1).cast("long")).drop("_before", "_nth", "_bucket")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = placed(measured(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
