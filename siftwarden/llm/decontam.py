"""Operator 1, benchmark decontamination: size-partitioned MinHash containment search.

An item is in a document if the document's set of 5-word shingles holds at least 75% of the item's.

Items are partitioned by the size of their shingle set, in powers of two; each class has an index of its own.  Its items
are sketched by their k smallest shingle hashes (bottom-k MinHash), k = q - ceil(0.75 q) + 1 for the largest size q of the
class: a document that holds 75% of an item's set misses fewer than k of its shingles, so it holds at least one of any k, and no
match is lost, however long the document.  A document looks its shingles up in the classes whose smallest item could fit
into it (0.75 of its size at most the document's) and skips the others, and each candidate is verified on the full sets.

Sketches and item sets go to the workers while the items have at most SENT_SHINGLES shingles in all, ITEM_COST for each item added; more are searched by
a join on the sketch hashes, of documents' shingles that pass a filter of all sketches, with the same result.

Nulls and edges: an item or document without words or text matches nothing; an item of fewer than five
words is one shingle, which a document holds only if that is its whole text; items that repeat are each
reported; ids may be of any type; a null doc_id is reported as null; a very long text is one set, which its task must hold (8 bytes for each of its
words); an item held by exactly 75% matches; other columns of docs stay, one named as the result gives way to it;
an empty table on either side gives no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import table, written
from .hashing import U, shingle_sets

SHARE = (3, 4)
SHINGLE = 5
SENT_SHINGLES = 4_000_000
#: Shingles that an item counts for besides its own, for what it takes to hold it: at most 250,000 items and 32 MB of shingles are sent.
ITEM_COST = 15
_BITS = 20


def needed(q: np.ndarray | int) -> np.ndarray | int:
    """The shingles of q that make 75%."""
    return -(-q * SHARE[0] // SHARE[1])


def sketched(items: DataFrame) -> DataFrame:
    """item_id, n (shingles), part (size class), shingles and sketch (sorted hashes, as bytes) for each item that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch["text"], SHINGLE))
            n = np.array([len(s) for s in sets], np.int64)
            part = np.ceil(np.log2(np.maximum(n, 1))).astype(np.int32)
            largest = np.left_shift(1, part.astype(np.int64))
            # hashes are uniform, so the smallest k of them are a MinHash sample of the set
            heads = [s[:k].tobytes() for s, k in zip(sets, largest - needed(largest) + 1)]
            yield pa.RecordBatch.from_arrays([batch["item_id"], pa.array(n.astype(np.int32)), pa.array(part), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(heads, pa.binary())], ["item_id", "n", "part", "shingles", "sketch"])

    kind = dict(items.dtypes)["item_id"]
    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, n int, part int, shingles binary, sketch binary").where("n > 0")


class Index:
    """The sketches of all items, by size class and hash, and their sets."""

    def __init__(self, rows: list):
        self.ids = [r.item_id for r in rows]
        self.sets = [np.frombuffer(r.shingles, U) for r in rows]
        self.n = np.array([r.n for r in rows], np.int64)
        part = np.array([r.part for r in rows], np.int64)
        self.classes = []  # least shingles of a document, hashes, whose they are, and which low bits occur
        for p in np.unique(part).tolist():
            own = np.flatnonzero(part == p)
            heads = [np.frombuffer(rows[k].sketch, U) for k in own]
            h, of = np.concatenate(heads), np.repeat(own, [len(x) for x in heads])
            order = np.argsort(h, kind="stable")
            maybe = np.zeros(1 << _BITS, bool)
            maybe[(h & U((1 << _BITS) - 1)).astype(np.int64)] = True
            self.classes.append((int(needed(self.n[own].min())), h[order], of[order], maybe))

    def search(self, s: np.ndarray) -> list[tuple]:
        """(item_id, n_item, n_shared) of the items that a document's set holds, in the order of the index."""
        low = (s & U((1 << _BITS) - 1)).astype(np.int64)
        found = []
        for least, h, of, maybe in self.classes:
            if least > len(s):
                break  # classes rise in size
            near = s[maybe[low]]
            if len(near):
                found += [of[x:y] for x, y in zip(np.searchsorted(h, near), np.searchsorted(h, near, "right"))]
        out = []
        for k in np.unique(np.concatenate(found)).tolist() if found else ():
            shared = len(np.intersect1d(self.sets[k], s, assume_unique=True))
            if shared >= needed(int(self.n[k])):
                out.append((self.ids[k], int(self.n[k]), shared))
        return out


def with_hits(docs: DataFrame, items: DataFrame, name: str = "hits") -> DataFrame:
    """docs with the column `name`, an array of (item_id, n_item, n_shared); items: item_id, text."""
    made = written(sketched(items).withColumn("item", F.monotonically_increasing_id()), "items")
    kind = f"array<struct<item_id:{dict(items.dtypes)['item_id']},n_item:int,n_shared:int>>"
    if (made.agg(F.sum(F.col("n") + ITEM_COST)).first()[0] or 0) > SENT_SHINGLES:
        # rows are told apart by keys of their own, written so that they stay: ids may be null or repeat
        docs = written(docs.withColumn("_doc", F.monotonically_increasing_id()), "keyed")
        found = joined(docs.select(F.col("_doc").alias("doc"), "text"), made).join(made.select("item", "item_id"), "item")
        found = found.groupBy(F.col("doc").alias("_doc")).agg(F.sort_array(F.collect_list(F.struct("item_id", "n_item", "n_shared"))).alias(name))
        return docs.join(found, "_doc", "left").withColumn(name, F.coalesce(name, F.expr(f"cast(array() as {kind})"))).drop("_doc")
    id_type = to_arrow_type(items.schema["item_id"].dataType)
    sent = docs.sparkSession.sparkContext.broadcast(Index(made.orderBy("item_id").collect()))

    @F.arrow_udf(kind)
    def search(texts: pa.Array) -> pa.Array:
        hits = [[dict(zip(("item_id", "n_item", "n_shared"), x)) for x in sent.value.search(s)] for s in shingle_sets(texts, SHINGLE)]
        return pa.array(hits, pa.list_(pa.struct([("item_id", id_type), ("n_item", pa.int32()), ("n_shared", pa.int32())])))

    return docs.withColumn(name, search("text"))


#: Bits of the filter of all sketches, 16 MB, and tasks that a common shingle is dealt over.
FILTER_BITS, SALTS = 1 << 27, 8


def _exploded(rows: DataFrame, key: str, name: str) -> DataFrame:
    """key, n, least and h: a row for each hash of a column of bytes."""
    keep = [c for c in (key, "n", "least") if c in rows.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [np.frombuffer(x.as_buffer(), np.int64) for x in batch[name]]
            at = pa.array(np.repeat(np.arange(len(batch)), [len(x) for x in h]))
            yield pa.RecordBatch.from_arrays([*(batch[c].take(at) for c in keep), pa.array(np.concatenate([*h, np.zeros(0, np.int64)]))], [*keep, "h"])

    return rows.select(*keep, name).mapInArrow(run, ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in keep) + ", h long")


def joined(docs: DataFrame, made: DataFrame) -> DataFrame:
    """The same pairs by joins, for items too many to send: doc, item, n_item, n_shared; docs: doc, text."""
    spark = docs.sparkSession
    least = made.groupBy("part").agg(F.min("n").alias("_least"))
    heads = written(_exploded(made.join(least, "part").withColumn("least", F.ceil(F.col("_least") * SHARE[0] / SHARE[1])), "item", "sketch"), "heads")
    # Spark's buckets count places from 1, and the first of those is in the bucket after the first
    place = F.shiftrightunsigned("h", 8).bitwiseAND(F.lit(FILTER_BITS - 1)) + 1
    bits, size = bytearray((FILTER_BITS // 32768 + 2) << 12), 1 << 12
    for r in heads.select(place.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).toLocalIterator():
        bits[r.bucket * size : (r.bucket + 1) * size] = r.bits
    sent = spark.sparkContext.broadcast(bytes(bits))

    def shingles(some: DataFrame, filtered: bool) -> DataFrame:
        """doc, size and h of the documents' shingles, all or those that a sketch may have."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for doc, s in zip(batch["doc"].to_pylist(), shingle_sets(batch["text"], SHINGLE)):
                    h = s
                    if filtered:
                        at = (s >> U(8) & U(FILTER_BITS - 1)).astype(np.int64) + 32768
                        h = s[(np.frombuffer(sent.value, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), doc, np.int64)), pa.array(np.full(len(h), len(s), np.int64)), pa.array(h.view(np.int64))], ["doc", "size", "h"])

        return some.select("doc", "text").mapInArrow(run, "doc long, size long, h long")

    salted = heads.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    near = shingles(docs, True).withColumn("_salt", F.pmod("doc", F.lit(SALTS)).cast("int")).join(salted, ["h", "_salt"]).where("least <= size")
    near = written(near.select("doc", "item", F.col("n").alias("n_item")).distinct(), "near")
    # a candidate's item shingles meet the document's: a row for each shingle of the item, not for each of the document
    asked = near.join(_exploded(made, "item", "shingles").drop("n"), "item")
    held = asked.join(shingles(docs.join(near.select("doc").distinct(), "doc", "left_semi"), False).drop("size"), ["doc", "h"])
    held = held.groupBy("doc", "item", "n_item").agg(F.count(F.lit(1)).cast("int").alias("n_shared"))
    return held.where(f"n_shared * {SHARE[1]} >= n_item * {SHARE[0]}")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    hits = with_hits(docs, items).select("doc_id", F.explode("hits").alias("x")).select("doc_id", "x.*")
    return hits.select("doc_id", "item_id", F.col("n_item").cast("long").alias("n_item"), F.col("n_shared").cast("long").alias("n_shared"))


ORACLE = r"""
WITH word AS (
  SELECT 0 AS side, doc_id AS id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') FROM benchmark),
shingle AS (
  SELECT DISTINCT side, id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM word),
item AS (SELECT id AS item_id, s, count(*) OVER (PARTITION BY id) AS n_item FROM shingle WHERE side = 1)
SELECT d.id AS doc_id, item_id, n_item::BIGINT AS n_item, count(*)::BIGINT AS n_shared
FROM item JOIN (SELECT id, s FROM shingle WHERE side = 0) d USING (s)
GROUP BY d.id, item_id, n_item HAVING 4 * count(*) >= 3 * n_item
"""
