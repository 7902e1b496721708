"""Operator 3, MinHash near-dedup: an LSH forest of sorted signature orders.

Documents whose sets of 5-word shingles have a Jaccard similarity of 0.75 or more are linked; a component
is what links reach.

1. Each text gets its set's hash and a signature of ORDERS * DEPTH MinHash values.  Equal sets are one
   class from here on, whatever their number, numbered in the order of their smallest doc_id and set hash.
2. The forest: ORDERS sorted orders of the classes, each by its own sequence of signature values (DEPTH of
   its own, then DEPTH of the next order's).  Rows are sorted over the whole cluster by range, so that an order's
   region, the classes that share a prefix, may span tasks.  Of a class' two neighbours in an order the one with the longer
   common prefix is a candidate first, the other one after it, if they share DEPTH values at least: 0.75**4 in each of 32
   orders, so a link at 0.75 is missed in all of them with a probability of 5e-6.
3. Candidates are verified on full sets in rounds, each class with its neighbour of the smallest component first, and
   components merge after each round, so a group of n near copies costs about n verifications and not n * n.
4. Adaptive depth: where neighbours, at whatever depth they met, have put a region into one component,
   it is finished.  Regions with more components are worked on from the deepest up: first those that share 2 * DEPTH values,
   then, where components are still apart, those that share DEPTH.  All pairs of different components of such a region are
   candidates, none is capped.  In a large region these are not told one by one: the rows outside its largest component
   meet each other and the rest in bounded blocks, where products of incidence matrices give every pair's exact overlap.

Nulls and edges: a text without words is linked with nothing; a null doc_id is linked with nothing and kept;
rows that repeat a doc_id with the same text are copies of each other, with another text each stands for
itself; ties go to the smallest doc_id; a very long text is one set, which its task must hold (8 bytes for each of its
words); other columns of docs are not looked at; an empty table gives none; a doc_id that isn't a whole number is refused (ValueError).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, whole_ids, written
from .components import relabel
from .hashing import U, goes, mix, ngram_hashes, word_hashes

SHINGLE = 5
ORDERS, DEPTH = 32, 4
#: Rounds over neighbours.
ROUNDS = 3
#: Rows of a region whose pairs are told one by one; rows and shingles of a block in larger regions.
SMALL, BLOCK, BLOCK_SHINGLES = 16, 512, 1 << 20
_MUL = (mix(np.arange(1, ORDERS * DEPTH + 1, dtype=U)) | U(1)).astype(np.uint32)
_ADD = mix(np.arange(1001, 1001 + ORDERS * DEPTH, dtype=U)).astype(np.uint32)
_KINDS = mix(np.array([301, 302], U))
#: Bits for each member of the filter that picks the texts to read again for verification, and all its bits at most (32 MB).
MEMBER_BITS, PICK_BITS = 8, 1 << 28


def text_hash() -> Column:
    """With the doc_id, what tells rows of different texts apart."""
    return F.xxhash64("text")


def _sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, shingles, where each text's begin, with one end more), repeats included."""
    for row, end, data, at in goes(column):
        h, of = word_hashes(data, at)
        n = np.diff(of)
        runs = ngram_hashes(h, SHINGLE)
        size = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
        off = np.concatenate([[0], np.cumsum(size)])
        # each text's windows begin where its words do
        flat = np.zeros(off[-1], U)
        long_ = n >= SHINGLE
        place = np.arange(off[-1]) - np.repeat(off[:-1], size) + np.repeat(of[:-1], size)
        inside = np.repeat(long_, size)
        flat[inside] = runs[place[inside]]
        for k in np.flatnonzero((n > 0) & ~long_):
            flat[off[k]] = ngram_hashes(h[of[k] : of[k + 1]], int(n[k]))[0]
        yield row, end, flat, off


def _distinct(flat: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    out = []
    for a, b in zip(off[:-1], off[1:]):
        s = np.sort(flat[a:b])
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s)
    return out


def signatures(flat: np.ndarray, off: np.ndarray) -> np.ndarray:
    """16 bits of each MinHash value, for each text that has shingles."""
    at = off[:-1][np.diff(off) > 0]
    out = np.zeros((len(at), ORDERS * DEPTH), np.uint16)
    if len(at):
        x = (flat >> U(32)).astype(np.uint32)
        for k in range(ORDERS * DEPTH):
            least = np.minimum.reduceat(x * _MUL[k] + _ADD[k], at)
            out[:, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def _set_hash(sets: list[np.ndarray], kind: int) -> np.ndarray:
    """64 bits of each set; two kinds make its key, so that unequal sets of some 10**12 documents aren't taken for equal."""
    h = np.array([np.sum(mix(s ^ _KINDS[kind]), dtype=U) for s in sets], U)
    return mix(h + np.array([len(s) for s in sets], U)).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_hash, set_more (the set's key) and signature (null where there are no shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, more, marks = [], [], [], []
            for _, _, flat, off in _sets(batch["text"]):
                sets = _distinct(flat, off)
                size = np.array([len(s) for s in sets])
                n.append(size)
                keys.append(_set_hash(sets, 0))
                more.append(_set_hash(sets, 1))
                rows = iter(signatures(flat, off))
                marks += [next(rows).tobytes() if k else None for k in size]
            told = [np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (n, keys, more)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], *map(pa.array, told), pa.array(marks, pa.binary())], ["doc_id", "text_hash", "n_shingles", "set_hash", "set_more", "signature"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", text_hash().alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, text_hash long, n_shingles long, set_hash long, set_more long, signature binary")


def forest(classes: DataFrame) -> DataFrame:
    """Rows (tree, p, q, id, n): a class in each order, by its first DEPTH values p and the next ones q."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            sig = np.frombuffer(b"".join(batch["signature"].to_pylist()), np.uint16).reshape(len(batch), -1)
            own = sig.reshape(len(batch), ORDERS, DEPTH).astype(U)
            label = (own[:, :, 0] << U(48)) | (own[:, :, 1] << U(32)) | (own[:, :, 2] << U(16)) | own[:, :, 3]
            tree = np.tile(np.arange(ORDERS, dtype=np.int32), len(batch))
            each = lambda c: batch[c].take(pa.array(np.repeat(np.arange(len(batch)), ORDERS)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(tree), pa.array(label.reshape(-1).view(np.int64)), pa.array(np.roll(label, -1, axis=1).reshape(-1).view(np.int64)), each("id"), each("n")], ["tree", "p", "q", "id", "n"]
            )

    return classes.mapInArrow(run, "tree int, p long, q long, id long, n long")


def neighbours(rows: DataFrame, parts: int) -> DataFrame:
    """From the sorted orders, rows of four kinds: 0, neighbours a and b of one region of which neither is nearer to one
    of them on its other side, by their common prefix; 3, other neighbours; 1, members a of regions with more than one;
    2, the first and last row of a task, which may have neighbours in another one."""
    ordered = rows.repartitionByRange(parts, "tree", "p", "q", "id").sortWithinPartitions("tree", "p", "q", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tree", "p", "q", "id", "n"]

        def out(kind: int, x: dict, at: np.ndarray, other: dict | None = None) -> pa.RecordBatch:
            o = other or x
            cols = [np.full(len(at), kind, np.int32), x["tree"][at], x["p"][at], x["q"][at], x["id"][at], x["n"][at], *((o["id"][at + 1], o["n"][at + 1]) if kind in (0, 3) else (x["id"][at], x["n"][at]))]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["kind", "tree", "p", "q", "a", "n_a", "b", "n_b"])

        last, first = None, True
        for batch in batches:
            if not len(batch):
                continue
            x = {c: batch[c].to_numpy(zero_copy_only=False) for c in names}
            if first:
                yield out(2, x, np.array([0]))
            elif last is not None:
                x = {c: np.concatenate([last[c], x[c]]) for c in names}
            same = (x["tree"][1:] == x["tree"][:-1]) & (x["p"][1:] == x["p"][:-1])
            # values of 16 bits in common: DEPTH and those of q from its first on; what another batch holds isn't seen here
            apart = (x["q"][1:] ^ x["q"][:-1]).view(U)
            common = np.where(same, DEPTH + sum(((apart >> U(16 * k)) == 0).astype(int) for k in range(DEPTH)), 0)
            before, after = np.concatenate([[0], common[:-1]]), np.concatenate([common[1:], [0]])
            nearest = (common >= before) | (common >= after)
            yield out(0, x, np.flatnonzero(same & nearest))
            yield out(3, x, np.flatnonzero(same & ~nearest))
            at = np.flatnonzero(same)
            yield out(1, x, np.union1d(at, at + 1))
            last, first = {c: v[-1:] for c, v in x.items()}, False
        if last is not None:
            yield out(2, last, np.array([0]))

    return ordered.mapInArrow(run, "kind int, tree int, p long, q long, a long, n_a long, b long, n_b long")


def _fits(a: str, b: str):
    """Set sizes that allow a similarity of 0.75."""
    return 4 * F.least(a, b) >= 3 * F.greatest(a, b)


def _sets_of(docs: DataFrame, ids: DataFrame, again: DataFrame) -> DataFrame:
    """id and set, as sorted bytes, of the classes in ids (id, doc_id, text_hash).  Of other documents, a filter spares
    most; where it would grow beyond PICK_BITS it spares fewer, and the join decides.

    again: doc_id and text_hash of rows that repeat both, of which one is read.
    """
    n_bits = min(PICK_BITS, 1 << max(20, (MEMBER_BITS * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(n_bits))
    rows = ids.select(place.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    # a bucket is 4 KB and there are n_bits / 32768 of them
    size = 1 << 12
    bits = bytearray((n_bits // (size * 8) + 2) * size)
    for r in rows.collect():
        bits[r.bucket * size : (r.bucket + 1) * size] = r.bits
    sent = docs.sparkSession.sparkContext.broadcast(bytes(bits))

    @F.arrow_udf("boolean")
    def picked(bucket: pa.Array, position: pa.Array) -> pa.Array:
        at = bucket.to_numpy(zero_copy_only=False) * size * 8 + position.to_numpy(zero_copy_only=False)
        return pa.array((np.frombuffer(sent.value, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, _, flat, off in _sets(batch["text"]) for s in _distinct(flat, off)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "text_hash", "shingles"])

    at = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), text_hash()), F.lit(n_bits))
    some = docs.where("doc_id is not null").where(picked(F.bitmap_bucket_number(at), F.bitmap_bit_position(at)))
    some = some.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), "text")
    if not again.isEmpty():
        once = some.join(again, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
        some = some.join(again, ["doc_id", "text_hash"], "left_anti").unionByName(once)
    made = some.mapInArrow(run, "doc_id long, text_hash long, shingles binary")
    return written(made.join(ids, ["doc_id", "text_hash"]).select("id", "shingles"), "sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with is_link, from the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for x, y in zip(batch["s_a"], batch["s_b"]):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                hits.append(bool(both) and 4 * both >= 3 * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(hits, pa.bool_())], ["a", "b", "is_link"])

    of = lambda name: sets.select(F.col("id").alias(name), F.col("shingles").alias(f"s_{name}"))
    return pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").mapInArrow(run, "a long, b long, is_link boolean")


def _with_components(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs of different components, with comp_a and comp_b."""
    for name in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("id").alias(name), F.col("comp").alias(f"comp_{name}")), name)
    return pairs.where("comp_a <> comp_b")


def _picked(pairs: DataFrame) -> DataFrame:
    """For each document of a pair whose component is the larger: its pair with the smallest component."""
    swap = F.col("comp_a") > F.col("comp_b")
    one = pairs.select(F.when(swap, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(swap, F.struct(F.col("comp_b").alias("comp"), F.col("b").alias("y"))).otherwise(F.struct(F.col("comp_a").alias("comp"), F.col("a").alias("y"))).alias("to"))
    one = one.groupBy("x").agg(F.min("to").alias("to")).select("x", "to.y")
    return one.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (region, a, n) of regions with more than one component: region, id, n, comp, m (rows), major (whether comp is
    the one with most rows), and minors and majors, the numbers of blocks of either kind."""
    rows = members.join(labels.withColumnRenamed("id", "a"), "a").select("region", F.col("a").alias("id"), "n", "comp")
    per = rows.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("all"))
    per = per.groupBy("region").agg(F.sum("m").alias("m"), F.sum("all").alias("all"), F.max(F.struct("m", "comp", "all")).alias("most"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    blocks = lambda m, all_: F.greatest(F.ceil(m / BLOCK), F.ceil(all_ / BLOCK_SHINGLES), F.lit(1)).cast("int")
    per = per.select("region", "m", F.col("most.comp").alias("top"), blocks(F.col("m") - F.col("most.m"), F.col("all") - F.col("most.all")).alias("minors"), blocks(F.col("most.m"), F.col("most.all")).alias("majors"))
    return written(rows.join(per, "region").withColumn("major", F.col("comp") == F.col("top")).drop("top"), "mixed")


def _small_pairs(mixed: DataFrame) -> DataFrame:
    """Pairs of different components in regions of up to SMALL rows."""
    rows = mixed.where(F.col("m") <= SMALL).select("region", "id", "n", "comp")
    pairs = rows.join(rows.withColumnsRenamed({"id": "j", "n": "n_j", "comp": "other"}), "region").where((F.col("comp") < F.col("other")) & _fits("n", "n_j"))
    return pairs.select(F.least("id", "j").alias("a"), F.greatest("id", "j").alias("b")).distinct()


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share: a product of incidence matrices, some columns at a time."""
    kinds, at, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    column = np.cumsum(many > 1) - 1  # a shingle of one set only is shared with none
    shared = many[at] > 1
    row, column = row[shared], column[at[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [k, k + 4096])
        part = np.zeros((len(sets), min(4096, int(column[-1]) + 1 - k)), np.float32)
        part[row[a:b], column[a:b] - k] = 1
        out += part @ part.T
    return out


def _block_links(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that put together all components which any link joins, in regions of more than SMALL rows.

    Rows of the region's largest component needn't meet each other.  The rows of all other components fall by hash into
    minor blocks of about BLOCK rows and BLOCK_SHINGLES shingles, those of the largest into major ones; each two minor
    blocks meet in one group, and each minor block meets each major one.  There all pairs are compared exactly by one
    product, and only links that join components are given out: fewer than the group has rows.
    """
    rows = mixed.where(F.col("m") > SMALL).join(sets, "id")
    own = F.pmod(F.xxhash64(F.lit(5), "id"), F.when(F.col("major"), F.col("majors")).otherwise(F.col("minors"))).cast("int")
    meets = F.explode(F.when(F.col("major"), F.sequence(F.lit(0), F.col("minors") - 1)).otherwise(F.sequence(F.lit(0), F.col("minors") + F.col("majors") - 1)))
    rows = rows.withColumn("own", F.when(F.col("major"), F.col("minors") + own).otherwise(own)).withColumn("with", meets)
    rows = rows.select("region", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "id", "comp", "shingles")

    def link(group: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_buffer(), U) for x in group["shingles"].combine_chunks()]
        ids, size = group["id"].to_numpy(), np.array([len(s) for s in sets])
        comp = np.unique(group["comp"].to_numpy(), return_inverse=True)[1]
        both = _overlaps(sets)
        hit = 4 * both >= 3 * (size[:, None] + size[None, :] - both)
        a, b = np.nonzero(np.triu(hit & (both > 0) & (comp[:, None] != comp[None, :]), 1))
        up, out = list(range(comp.max() + 1)), []

        def top(k: int) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        for x, y in zip(a.tolist(), b.tolist()):
            p, q = top(int(comp[x])), top(int(comp[y]))
            if p != q:
                up[max(p, q)] = min(p, q)
                out.append((x, y))
        x, y = (np.array([o[k] for o in out], np.int64) for k in (0, 1))
        return pa.table({"a": ids[x], "b": ids[y]})

    return rows.groupBy("region", "i", "j").applyInArrow(link, "a long, b long")


def classed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and kept for each row of docs (doc_id, text).

    Of each component one doc_id and text_hash is kept, with all rows that repeat both; what is linked with nothing is kept.
    """
    whole_ids(docs)
    spark = docs.sparkSession
    told = written(sketches(docs), "sketches")
    some = told.where("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("set_hash", "set_more").agg(F.min(F.struct(F.col("doc_id").cast("long").alias("doc_id"), "text_hash")).alias("head"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    # numbers in this order make the smallest id of a component that of its smallest doc_id
    classes = written(classes.select("set_hash", "set_more", "head.*", "n", "signature").orderBy("doc_id", "set_hash").withColumn("id", F.monotonically_increasing_id()), "classes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = written(neighbours(forest(classes.select("id", "n", "signature")), parts), "neighbours")
    ends = near.where("kind = 2").select("tree", "p", "q", F.col("a").alias("id"), F.col("n_a").alias("n"))
    # two rows for each task; rows of a region that meet over a task's end are neighbours too
    following = Window.partitionBy("tree", "p").orderBy("q", "id")
    over = ends.distinct().withColumns({"b": F.lead("id").over(following), "n_b": F.lead("n").over(following)}).where("b is not null")
    over = over.select("tree", "p", "q", F.col("id").alias("a"), F.col("n").alias("n_a"), "b", "n_b")
    both = near.where("kind in (0, 3)").withColumn("nearest", F.col("kind") == 0).drop("kind").unionByName(over.withColumn("nearest", F.lit(True)))
    pairs = both.where((F.col("a") != F.col("b")) & _fits("n_a", "n_b"))
    pairs = written(pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("nearest").alias("nearest")), "candidates")
    members = near.where("kind = 1").select("tree", "p", "q", "a", F.col("n_a").alias("n"))
    ends = ends.join(over.select("tree", "p").distinct(), ["tree", "p"], "left_semi").select("tree", "p", "q", F.col("id").alias("a"), "n")
    members = written(members.unionByName(ends).distinct(), "members")
    labels = written(members.select(F.col("a").alias("id")).distinct().withColumn("comp", F.col("id")), "labels")
    again = written(some.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "again")
    sets = _sets_of(docs, classes.select("id", "doc_id", "text_hash").join(labels.select("id"), "id", "left_semi"), again)
    tested = None

    def untested(some: DataFrame) -> DataFrame:
        return some if tested is None else some.join(tested, ["a", "b"], "left_anti")

    def settle(some: DataFrame) -> bool:
        """Verifies the pairs and merges what they link; whether anything was linked."""
        nonlocal labels, tested
        done = written(verified(some, sets), "verified")
        tested = done.select("a", "b") if tested is None else tested.unionByName(done.select("a", "b"))
        links = done.where("is_link").select("a", "b")
        if links.isEmpty():
            return False
        labels = relabel(labels, links)
        return True

    for turn in range(ROUNDS):
        some = pairs.where("nearest") if turn == 0 else pairs
        if not settle(_picked(_with_components(untested(some.select("a", "b")), labels))) and turn:
            break
    for region in (["tree", "p", "q"], ["tree", "p"]):  # from the deepest up
        mixed = _mixed(members.select(F.xxhash64(F.lit(len(region)), *region).alias("region"), "a", "n").distinct(), labels)
        small = verified(untested(_small_pairs(mixed)), sets).where("is_link").select("a", "b")
        links = written(small.unionByName(_block_links(mixed, sets)), "links")
        if not links.isEmpty():
            labels = relabel(labels, links)
    heads = classes.select(F.col("id").alias("comp"), F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_text"))
    labels = labels.where("id <> comp").join(heads, "comp").select("id", "_doc", "_text")
    by_set = classes.join(labels, "id", "left").select("set_hash", "set_more", F.coalesce("_doc", "doc_id").alias("_doc"), F.coalesce("_text", "text_hash").alias("_text"), F.col("_doc").isNull().alias("_first"))
    out = told.drop("signature").join(by_set, ["set_hash", "set_more"], "left")
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    kept = ~linked | (F.col("_first") & (F.col("doc_id") == F.col("_doc")) & (F.col("text_hash") == F.col("_text")))
    return out.select("doc_id", "text_hash", "n_shingles", F.when(linked, F.col("_doc")).otherwise(F.col("doc_id")).alias("component_id"), kept.alias("kept"))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    return classed(docs).select("doc_id", "n_shingles", "component_id")


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = components(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


ORACLE = r"""
WITH RECURSIVE word AS (
  SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingle AS (
  SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM word),
n AS (SELECT id, count(*) AS n FROM shingle GROUP BY id),
pair AS (SELECT x.id AS a, y.id AS b, count(*) AS n_both FROM shingle x JOIN shingle y ON x.s = y.s AND x.id < y.id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(id, other) AS (SELECT id, id FROM n UNION SELECT r.id, e.b FROM reach r JOIN edge e ON r.other = e.a),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id, coalesce(l.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.id = d.doc_id LEFT JOIN least l ON l.id = d.doc_id
"""
