"""Operator 13, embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, several probes, verified pairs.

Vectors of one label are linked if their cosine in double precision is AT_LEAST or more; a component is what links reach.

1. Equal vectors of a label are one class from here on, whatever their number.
2. Hashing: a vector is turned by three rounds of random signs and a fast Hadamard transform; its hash is the
   axis it lies nearest to, and its sign.  HASHES of them name a bucket of a table.  Each class lies in its own bucket of every table
   and probes the buckets that come next, with second-nearest axes where the loss is least.  Two meet where one's own
   bucket is among the other's.  The number of hashes follows from the number of classes, so that a bucket holds few that are far apart; the
   number of tables from how often simulated pairs at exactly AT_LEAST meet, so that a link is missed with a probability of MISS.
3. Dense regions: where DENSE classes or more lie in one bucket, they are a unit with a centre, and each lies at an
   angle from it, in one of RINGS rings.  Angles obey the triangle inequality, so two rings whose angles and
   centres' angle add up to the link's angle at most are linked throughout, and two that are farther apart aren't at all: their counts are enough.
   Only rings in between are compared, by blocks of about BLOCK classes, each pair of blocks once.  So n near copies of one vector cost about n and not n * n.
4. All other classes are units of their own.  Units that meet in any table are told once, but classes whose SKETCH signs of random projections
   differ in more than APART are none: at AT_LEAST that has a probability below 1e-9, and it spares nearly all that met by chance.
   They are verified: classes by their cosine, units of many by the rings.

Labels and vector lengths are told apart by 64 bits of hash, equal vectors by 128.

Nulls and edges: a vector that is null, zero, empty or holds null or non-finite components, or whose label is null, is linked with
nothing; vectors of different lengths aren't linked; rows that repeat are copies of each other; a null vec_id is linked like any other, its component_id
is the smallest id there is in its component, or null, and it is kept only if that is null; ties don't matter, since links and smallest ids are facts; other
columns are not looked at; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .components import roots
from .hashing import U, mix
from .whitening import finite, matrices

AT_LEAST = 0.98
ANGLE = float(np.arccos(AT_LEAST))
#: Angles that add up to within this of ANGLE are left to the exact comparison.
SLACK = 1e-7
#: Probability that a link at exactly AT_LEAST meets in no table; simulated pairs that tables are counted by.
MISS, SIMULATED = 1e-6, 4_000
#: Buckets of a table that a class is found in; classes of a label that are far apart in a bucket, about.
PROBES, FAR = 4, 4
#: Classes in a bucket that make a unit; its rings; classes of a block.
DENSE, RINGS, BLOCK = 64, 16, 256
#: Signs of random projections that a class carries, and how many of two classes' may differ.
SKETCH, APART = 64, 20
#: Units of a bucket that are dealt by bucket; larger buckets are dealt in parts.
WIDE = 2_048
#: Parts that a hot key's rows are dealt to.
SALTS = 32
#: Entries that are turned at one go.
CHUNK = 1 << 20
SEED = 13


def units(x: np.ndarray) -> np.ndarray:
    """Rows over their lengths, in double; no row is zero."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def turned(x: np.ndarray, seed: tuple[int, ...]) -> np.ndarray:
    """Rows, whose length is a power of two, after three rounds of random signs and a fast Hadamard transform."""
    rng, (n, d) = np.random.default_rng((SEED, *seed)), x.shape
    for _ in range(3):
        x = x * rng.choice(np.array([-1, 1], x.dtype), d)
        step = 1
        while step < d:
            pair = x.reshape(n, d // (2 * step), 2, step)
            x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, d)
            step *= 2
        x = x / np.float32(np.sqrt(d))
    return x


def codes(u: np.ndarray, at: int, hashes: int) -> np.ndarray:
    """For each unit row the axes of its buckets in table `at`, its own first: rows * probes * hashes."""
    n, d = u.shape
    wide = np.zeros((n, max(4, 1 << (d - 1).bit_length())), np.float32)
    wide[:, :d] = u
    first, second, loss = (np.zeros((n, hashes), kind) for kind in (np.int64, np.int64, np.float32))
    for k in range(hashes):
        x = turned(wide, (at, k))
        size = np.abs(x)
        rows, one = np.arange(n), size.argmax(axis=1)
        most = size[rows, one]
        size[rows, one] = -1
        two = size.argmax(axis=1)
        first[:, k], second[:, k] = 2 * one + (x[rows, one] < 0), 2 * two + (x[rows, two] < 0)
        loss[:, k] = most - size[rows, two]
    ways = np.array(sorted(product((0, 1), repeat=hashes), key=sum))
    best = np.argsort(loss @ ways.T.astype(np.float32), axis=1, kind="stable")[:, : min(PROBES, len(ways))]
    return np.where(ways[best] == 1, second[:, None, :], first[:, None, :])


def sketches(u: np.ndarray) -> np.ndarray:
    """SKETCH signs of each row's random projections, as bits of a long."""
    signs = u @ np.random.default_rng((SEED, SKETCH, u.shape[1])).standard_normal((u.shape[1], SKETCH)) > 0
    return np.packbits(signs, axis=1).view(np.int64).reshape(-1)


def tables_for(d: int, n: int) -> tuple[int, int]:
    """(hashes, tables) for n classes of one label with d entries."""
    axes = 2 * max(4, 1 << (d - 1).bit_length())
    hashes = max(1, int(np.ceil(np.log(max(n / FAR, 1)) / np.log(axes))))
    rng, meet, tries = np.random.default_rng((SEED, d)), 0, 0
    at = 1 << 20  # tables of no use but here
    for rows in np.array_split(np.arange(SIMULATED), 1 + SIMULATED * axes // CHUNK):
        u = units(rng.standard_normal((len(rows), d)))
        w = rng.standard_normal((len(rows), d))
        w -= (w * u).sum(axis=1, keepdims=True) * u
        v = AT_LEAST * u + np.sqrt(1 - AT_LEAST**2) * (units(w) if d > 1 else 0)
        for _ in range(2):
            a, b = codes(u, at, hashes), codes(v, at, hashes)
            found = (a[:, :1] == b).all(axis=2).any(axis=1) | (b[:, :1] == a).all(axis=2).any(axis=1)
            meet, tries, at = meet + int(found.sum()), tries + len(rows), at + 1
    miss = max(1 - meet / tries, 1 / tries)
    return hashes, max(2, int(np.ceil(np.log(MISS) / np.log(min(miss, 0.999)))))


def buckets(classes: DataFrame, key: str, plan: dict[int, tuple[int, int]], probes: bool) -> DataFrame:
    """(bucket, key, own, sketch): each row's buckets in all tables, with its probes or without, and its sketch; buckets are negative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, labels = np.asarray(batch[key]), np.asarray(batch["lab"]).view(U)
            for rows, x in matrices(batch["embedding"]):
                d = x.shape[1]
                hashes, tables = plan[d]
                for part in np.array_split(np.arange(len(rows)), 1 + len(rows) * d // CHUNK):
                    u, own = units(x[part].astype(np.float64)), rows[part]
                    marks = sketches(u)
                    for at in range(tables):
                        code = codes(u, at, hashes)[:, : None if probes else 1]
                        h = np.repeat(mix(labels[own] + U(at + 1))[:, None], code.shape[1], axis=1)
                        for k in range(hashes):
                            h = mix(h + code[:, :, k].astype(U) + U(1))
                        first = np.zeros(h.shape, bool)
                        first[:, 0] = True
                        yield pa.RecordBatch.from_arrays([pa.array((h | U(1 << 63)).reshape(-1).view(np.int64)), pa.array(np.repeat(keys[own], code.shape[1])), pa.array(first.reshape(-1)), pa.array(np.repeat(marks, code.shape[1]))], ["bucket", key, "own", "sketch"])

    return classes.select(key, "lab", "embedding").mapInArrow(run, f"bucket long, {key} long, own boolean, sketch long")


def salted(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """left and right joined on a key that may be hot on the left; right has few rows for each and is dealt SALTS times."""
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(right, [key, "_salt"], how).drop("_salt")


def dense_members(classes: DataFrame, plan: dict[int, tuple[int, int]]) -> tuple[DataFrame, DataFrame] | None:
    """(id, unit, angle) of the classes in dense units, and these units' (unit, centre); None where there are none."""
    own = buckets(classes, "id", plan, False)
    heavy = written(own.groupBy("bucket").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") >= DENSE), "heavy")
    if heavy.isEmpty():
        return None
    # each class goes to the largest of its dense buckets
    chosen = salted(own, heavy, "bucket", "id").groupBy("id").agg(F.max(F.struct("many", "bucket")).alias("m")).select("id", F.col("m.bucket").alias("unit"))
    chosen = written(chosen.join(classes.select("id", "embedding"), "id"), "chosen")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}

        def told() -> pa.RecordBatch:
            lengths = [len(v) for v in total.values()]
            unit, at = np.repeat(np.array(list(total), np.int64), lengths), np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])
            return pa.RecordBatch.from_arrays([pa.array(unit), pa.array(at), pa.array(np.concatenate(list(total.values())))], ["unit", "at", "s"])

        for batch in batches:
            unit = np.asarray(batch["unit"])
            for rows, x in matrices(batch["embedding"]):
                names, of = np.unique(unit[rows], return_inverse=True)
                add = np.zeros((len(names), x.shape[1]))
                np.add.at(add, of, units(x.astype(np.float64)))
                for name, s in zip(names.tolist(), add):
                    total[name] = total[name] + s if name in total else s
            if sum(map(len, total.values())) > CHUNK:
                yield told()
                total = {}
        if total:
            yield told()

    by_entry = chosen.select("unit", "embedding").mapInArrow(sums, "unit long, at int, s double").groupBy("unit", "at").agg(F.sum("s").alias("s"))
    centres = written(by_entry.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("at", "s"))).alias("c")).select("unit", F.col("c.s").alias("centre")), "centres")

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(len(batch), np.pi)
            for (rows, x), (_, c) in zip(matrices(batch["embedding"]), matrices(batch["centre"])):
                there = np.abs(c).max(axis=1) > 0
                out[rows[there]] = between(units(x[there].astype(np.float64)), units(c[there]))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["unit"], pa.array(out)], ["id", "unit", "angle"])

    told = salted(chosen, centres, "unit", "id").select("id", "unit", "embedding", "centre").mapInArrow(angles, "id long, unit long, angle double")
    return written(told.where(F.col("angle") <= ANGLE), "members"), centres


def between(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Angles between unit rows, exact for small ones as well."""
    return 2 * np.arcsin(np.minimum(1, np.sqrt(((u - v) ** 2).sum(axis=1)) / 2))


def meetings(found: DataFrame) -> DataFrame:
    """(x, y), x < y: units that meet in a bucket, from (bucket, unit, own, sketch); a unit of many has no sketch of its own."""
    found = written(found.groupBy("bucket", "unit").agg(F.max("own").alias("own"), F.max("sketch").alias("sketch")), "found")
    left, right = (found.select("bucket", F.col("unit").alias(name), F.col("own").alias(f"own_{name}"), F.col("sketch").alias(f"sketch_{name}")) for name in "xy")
    wide = written(found.groupBy("bucket").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > WIDE).select("bucket"), "wide")
    if wide.isEmpty():
        pairs = left.join(right, "bucket")
    else:
        # a bucket of very many units: its left side is dealt in parts, each of which meets the whole right side
        pairs = left.join(wide, "bucket", "left_anti").join(right, "bucket")
        pairs = pairs.unionByName(salted(left.join(wide, "bucket", "left_semi"), right.join(wide, "bucket", "left_semi"), "bucket", "x"))
    near = (F.col("x") < 0) | (F.bit_count(F.col("sketch_x").bitwiseXOR(F.col("sketch_y"))) <= APART)
    return pairs.where("x < y and (own_x or own_y)").where(near).select("x", "y").distinct()


def compared(pairs: DataFrame, at: DataFrame) -> DataFrame:
    """pairs (x, y) of one lab with cosine and angle of the units' vectors; at: (unit, lab, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine, angle = np.zeros(len(batch)), np.zeros(len(batch))
            for (rows, a), (_, b) in zip(matrices(batch["vx"]), matrices(batch["vy"])):
                u, v = units(a), units(b)
                cosine[rows], angle[rows] = (u * v).sum(axis=1), between(u, v)
            yield pa.RecordBatch.from_arrays([batch["x"], batch["y"], pa.array(cosine), pa.array(angle)], ["x", "y", "cosine", "angle"])

    side = lambda name: at.select(F.col("unit").alias(name), F.col("lab").alias(f"lab_{name}"), F.col("vector").alias(f"v{name}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y").where("lab_x = lab_y")
    return both.select("x", "y", "vx", "vy").mapInArrow(run, "x long, y long, cosine double, angle double")


def _spread(linked: np.ndarray) -> np.ndarray:
    """The smallest row that each row of a symmetric matrix of links reaches."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label)))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def in_blocks(open_: DataFrame, members: DataFrame) -> DataFrame:
    """(id, links, to): for classes of open cells their links, by rows, and a class that they are connected with.

    open_: (cx, cy) pairs of cells; members: (cell, classes, id, n, embedding).
    """
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("classes") / BLOCK)).cast("int")
    cells = open_.select(F.explode(F.array("cx", "cy")).alias("cell")).distinct()
    rows = written(members.join(cells, "cell", "left_semi").withColumn("block", block), "open")
    blocks = rows.select("cell", "block").distinct()
    side = lambda name: blocks.select(F.col("cell").alias(f"c{name}"), F.col("block").alias(f"b{name}"))
    pairs = open_.join(side("x"), "cx").join(side("y"), "cy").where("cx <> cy or bx <= by")
    pairs = written(pairs.withColumn("pair", F.monotonically_increasing_id()), "pairs")
    of = lambda name: pairs.select("pair", F.col(f"c{name}").alias("cell"), F.col(f"b{name}").alias("block")).join(rows, ["cell", "block"]).select(*(F.col(c).alias(f"{c}_{name}") for c in ("pair", "id", "n", "embedding")))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (x, nx, u), (y, ny, v) = ((np.asarray(t[f"id_{k}"]), np.asarray(t[f"n_{k}"]), units(next(matrices(t[f"embedding_{k}"].combine_chunks()))[1].astype(np.float64))) for k, t in (("x", left), ("y", right)))
        linked = u @ v.T >= AT_LEAST
        linked &= x[:, None] != y[None, :]
        same = len(x) == len(y) and set(x) == set(y)
        ids = np.concatenate([x, y])
        whole = np.zeros((len(ids), len(ids)), bool)
        whole[: len(x), len(x) :] = linked
        whole[len(x) :, : len(x)] = linked.T
        if same:  # a block with itself: both sides' rows of a class are one
            whole[np.arange(len(x)), len(x) + np.argsort(y)[np.argsort(np.argsort(x))]] = True
            whole |= whole.T
        to = ids[_spread(whole)]
        links = np.concatenate([linked @ ny, (0 if same else 1) * (linked.T @ nx)])
        keep = links > 0
        return pa.table({"id": ids[keep], "links": links[keep].astype(np.int64), "to": to[keep]})

    return of("x").groupBy("pair_x").cogroup(of("y").groupBy("pair_y")).applyInArrow(run, "id long, links long, to long")


def classed(classes: DataFrame) -> DataFrame:
    """(id, links, comp): rows that a class' rows are linked with beside themselves, and its component's smallest class."""
    counts = classes.groupBy(F.size("embedding").alias("d"), "lab").agg(F.count(F.lit(1)).alias("n")).groupBy("d").agg(F.max("n").alias("n"))
    plan = {r.d: tables_for(r.d, r.n) for r in counts.collect()}  # a row for each vector length
    dense = dense_members(classes, plan)
    double = F.col("embedding").cast("array<double>")
    if dense is None:
        alone = classes.select(F.col("id").alias("unit"), "lab", double.alias("vector"))
        met = compared(meetings(buckets(classes, "id", plan, True).withColumnRenamed("id", "unit")), alone)
        links = written(met.where(F.col("cosine") >= AT_LEAST).select("x", "y"), "links")
        return _closed(classes, _both_ways(links, classes), links, None)

    members, centres = dense
    width = ANGLE / RINGS
    placed = classes.join(members, "id", "left").withColumn("ring", F.floor(F.col("angle") / width).cast("int"))
    placed = placed.withColumn("cell", F.when(F.col("unit").isNotNull(), F.xxhash64("unit", "ring"))).withColumn("unit", F.coalesce("unit", "id"))
    placed = written(placed.withColumn("cell", F.coalesce("cell", "id")).withColumn("angle", F.coalesce("angle", F.lit(0.0))), "placed")
    cells = placed.groupBy("unit", "cell").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"), F.min("angle").alias("low"), F.max("angle").alias("high"), F.min("id").alias("least"))
    cells = written(cells, "cells")
    ends = placed.where("unit < 0").groupBy("unit").agg(F.max("angle").alias("reach"), F.min("lab").alias("lab"))
    middle = ends.join(centres, "unit").select("unit", "lab", F.col("centre").alias("vector"))
    at = placed.where("unit >= 0").select("unit", "lab", double.alias("vector")).unionByName(middle)
    met = written(compared(meetings(buckets(placed, "unit", plan, True)), at), "met")
    links = written(met.where((F.col("x") >= 0) & (F.col("cosine") >= AT_LEAST)).select("x", "y"), "links")

    # units of many with each other, with single classes, and with themselves
    reach = ends.select("unit", "reach")
    near = met.where("x < 0").join(reach.select(F.col("unit").alias("x"), F.col("reach").alias("rx")), "x").join(reach.select(F.col("unit").alias("y"), F.col("reach").alias("ry")), "y", "left")
    near = near.where(F.col("angle") <= ANGLE + SLACK + F.col("rx") + F.coalesce("ry", F.lit(0.0))).select("x", "y", "angle")
    near = near.unionByName(ends.select(F.col("unit").alias("x"), F.col("unit").alias("y"), F.lit(0.0).alias("angle")))
    side = lambda name: cells.select(F.col("unit").alias(name), F.col("cell").alias(f"c{name}"), *(F.col(c).alias(f"{c}_{name}") for c in ("rows", "low", "high", "least")))
    rings = near.join(side("x"), "x").join(side("y"), "y").where("x <> y or cx <= cy")
    a, low_x, high_x, low_y, high_y = (F.col(c) for c in ("angle", "low_x", "high_x", "low_y", "high_y"))
    apart = F.greatest(a - high_x - high_y, low_x - a - high_y, low_y - a - high_x)
    rings = written(rings.where(apart <= ANGLE + SLACK).withColumn("sure", a + high_x + high_y <= ANGLE - SLACK), "rings")

    sure = rings.where("sure")
    each = [F.struct(F.col("cx").alias("cell"), F.col("rows_y").alias("rows"), (F.col("cx") == F.col("cy")).alias("within")), F.struct(F.col("cy").alias("cell"), F.col("rows_x").alias("rows"), F.lit(False).alias("within"))]
    of_cell = sure.select(F.explode(F.when(F.col("cx") == F.col("cy"), F.array(each[0])).otherwise(F.array(*each))).alias("e")).groupBy("e.cell").agg(F.sum("e.rows").alias("of_cell"), F.max("e.within").alias("within"))
    of_cell = written(of_cell.join(cells.select("cell", "least"), "cell"), "sure")
    opened = written(in_blocks(rings.where("not sure").select("cx", "cy"), placed.select("cell", "id", "n", "embedding").join(cells.select("cell", "classes"), "cell")), "opened")
    counted = _both_ways(links, classes).unionByName(opened.select("id", "links"))
    nodes = salted(placed.select("id", "cell"), of_cell, "cell", "id").select("id", "of_cell", "within", F.col("least").alias("node"))
    nodes = written(nodes, "nodes")
    edges = links.unionByName(opened.select(F.col("id").alias("x"), F.col("to").alias("y"))).unionByName(sure.select(F.col("least_x").alias("x"), F.col("least_y").alias("y")))
    return _closed(classes, counted, edges, nodes)


def _both_ways(links: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, links): rows at the other end of each link (x, y)."""
    ends = links.select(F.col("x").alias("id"), F.col("y").alias("other")).unionByName(links.select(F.col("y").alias("id"), F.col("x").alias("other")))
    return ends.join(classes.select(F.col("id").alias("other"), F.col("n").alias("links")), "other").select("id", "links")


def _closed(classes: DataFrame, counted: DataFrame, edges: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """(id, k1, k2, n, first, links, comp) of all classes; nodes: those that stand for whole rings."""
    out = classes.select("id", "k1", "k2", "n", "first").join(counted.groupBy("id").agg(F.sum("links").alias("links")), "id", "left")
    own = F.col("n") - 1
    if nodes is not None:
        out = out.join(nodes, "id", "left")
        # a ring that is linked throughout has counted a row's copies and the row itself
        own = F.when(F.col("within"), F.col("of_cell") - 1).otherwise(F.col("n") - 1 + F.coalesce("of_cell", F.lit(0)))
        stands = nodes.select(F.col("id").alias("old"), "node").where("old <> node")
        for end in ("x", "y"):
            edges = edges.join(stands, F.col(end) == F.col("old"), "left").withColumn(end, F.coalesce("node", end)).drop("old", "node")
    else:
        out = out.withColumn("node", F.col("id"))
    moves = roots(edges)
    out = out.withColumn("links", own + F.coalesce("links", F.lit(0))).withColumn("node", F.coalesce("node", "id"))
    out = out.join(moves, F.col("node") == F.col("x"), "left").withColumn("comp", F.coalesce("y", "node"))
    return out.select("id", "k1", "k2", "n", "first", "links", "comp")


RESULTS = ["vec_id", "n_links", "component_id", "kept"]


def near_vectors(docs: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row with vec_id, embedding and label."""
    comparable = finite(F.col("embedding")) & F.col("label").isNotNull() & F.coalesce(F.exists("embedding", lambda c: c != 0), F.lit(False))
    told = docs.select("vec_id", "embedding", "label").withColumn("_ok", F.coalesce(comparable, F.lit(False)))
    keys = {f"k{k}": F.xxhash64(F.lit(k), "label", "embedding") for k in (1, 2)}
    rows = told.where("_ok").withColumns(keys | {"lab": F.xxhash64("label", F.size("embedding"))})
    classes = rows.groupBy("k1", "k2", "lab", "embedding").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    done = written(classed(classes), "classed")
    # the smallest id of components of several classes
    comps = done.groupBy("comp").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("classes")).where("classes > 1").drop("classes")
    done = salted(done, comps, "comp", "id", "left").select("k1", "k2", "n", F.col("links").alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    done = written(done, "done")
    slim = rows.select("vec_id", "k1", "k2")
    # of classes with a thousandth of the rows there are a thousand at most
    many = done.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(done.where(F.col("n") > F.lit(many / 1000)).drop("n"))
    out = slim.join(hot, ["k1", "k2"]).unionByName(slim.join(hot, ["k1", "k2"], "left_anti").join(done.drop("n"), ["k1", "k2"])) if many else slim.join(done.drop("n"), ["k1", "k2"])
    alone = told.where("not _ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).select(*RESULTS)


def op13_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
