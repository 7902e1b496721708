"""Operator 4, mixing sources to target weights: pivotal dependent rounding on a reduction tree.

Sources, by code point with null last, weigh 1, 2, 3 and so on again, and share the corpus' words by
weight; no target exceeds MAX_COPIES times its source, and the excess is shared anew by weight until
none does.  That fixed point is min(cap, level * weight); the level is found in turns, each one sum over all sources.

A source's documents are each wanted target / size times: so many whole copies for all of them, and a
fraction left.  The fractions are rounded in pairs: words (fraction times length) move at random, up
or down with the odds that keep every document's expectation, from one of the two to the other until
one has 0 or 1 copies; that one is done and the other meets the next.  The words a source takes stay
the same at each step.  The tree: documents are dealt by hash into blocks of about BLOCK, each folds to
one undecided document, and these are dealt and folded again until each source has one.  Of each size class (a power of two)
RESERVE documents of a source, picked by hash, are left out of the tree.  At its root the undecided document meets all of them at once: they have one
fraction, which gives or takes what rounds it, and then the same is done with each of them, from the largest down, and those behind it.
So what a source misses its target by shrinks to about its smallest documents, as long as those behind can make up for one; if they can't,
it is drawn, and the source is off by less than that document.  No document's expectation changes by this.  Only where a source of few and unlike
documents is still off by more than 1/NEAR of its target, documents of the reserve that fit into what is missing, from the largest down, are rounded the other way, if need be after one that is too large.

All of it is DataFrame functions.  Hashes of (seed, ids) are the coins, so reruns agree.

Nulls and edges: a null text or one without words takes 0; a null source is a source; rows with a null
doc_id or a repeated one are each rounded on their own (rows alike in id, source and size are counted and
numbered, so that each has coins of its own); very long texts count their words; columns of docs other than
doc_id, text and source are not looked at; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import n_words, table, written

MAX_COPIES = 3
BLOCK = 64
#: Up to so many sources, what is known of each goes to all workers (under 100 MB); of more, it meets the documents in a shuffle.
SENT_SOURCES = 1_000_000
SEED = 20
#: Documents of each size class of a source that wait for the root of its tree.
RESERVE = 64
NEAR = 64


def targets(sized: DataFrame) -> DataFrame:
    """source, source_no (from 1), source_size, target and copies (target / source_size) from rows with source and size."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = written(by.orderBy(F.col("source").isNull(), "source").withColumn("_at", F.monotonically_increasing_id()), "sources")
    # sorted by range: a source's number is its place in its task's part of the order and the rows of the parts before
    part = F.shiftright("_at", 33).cast("int")
    starts, n = [F.lit(0), F.lit(0)], 0
    for r in by.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # a row for each task
        starts += [F.lit(r.part), F.lit(n)] if r.part else []
        n += r.n
    by = by.withColumn("source_no", (F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.create_map(*starts)[part] + 1).cast("int"))
    by = by.withColumn("_weight", F.pmod(F.col("source_no") - 1, F.lit(3)) + 1).withColumn("_cap", F.col("source_size") * F.lit(MAX_COPIES).cast("double"))
    level, capped = 0.0, -1
    while True:
        over = F.col("_cap") < F.lit(level) * F.col("_weight")
        r = by.agg(F.sum("source_size").alias("all"), F.count_if(over).alias("n"), F.sum(F.when(over, F.col("_cap"))).alias("cap"), F.sum(F.when(~over, F.col("_weight"))).alias("weight")).first()
        if r.n == capped or not r.weight:
            break
        capped, level = r.n, ((r["all"] or 0) - (r.cap or 0.0)) / r.weight
    by = by.withColumn("target", F.least("_cap", F.lit(level) * F.col("_weight")))
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return by.select("source", "source_no", "source_size", "target", F.least(copies, F.lit(float(MAX_COPIES))).alias("copies"))


#: Rows alike that one row stands for while they are numbered.
ALIKE = 1 << 14


def numbered(sized: DataFrame) -> DataFrame:
    """The rows with `nth`, which counts rows that are alike from 1; the same whatever their order."""
    many = sized.groupBy(*sized.columns).agg(F.count(F.lit(1)).alias("_n"))
    spread = lambda df, last: df.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), last)))
    few = spread(many.where(F.col("_n") <= ALIKE), F.col("_n"))
    part = many.where(F.col("_n") > ALIKE).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / ALIKE))))
    large = spread(part.repartition("_part"), F.least(F.lit(ALIKE).cast("long"), F.col("_n") - F.col("_part") * ALIKE)).withColumn("nth", F.col("nth") + F.col("_part") * ALIKE)
    return few.unionByName(large.drop("_part")).drop("_n")


#: A document in the tree: x is the part of a copy it may still get.
ITEM = "struct<size:bigint,tie:bigint,doc_id:{id},source_no:int,base:int,x:double>"


def _coin(a: Column, b: Column, level: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), F.lit(level), a, b), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _fold(level: int, item: str) -> Column:
    """From array `items`: struct(open, done), the one document that stays undecided and the rest with x 0 or 1."""

    def meet(state: Column, new: Column) -> Column:
        old = state["open"]
        a, x, b, y = old["size"].cast("double"), old["x"], new["size"].cast("double"), new["x"]
        at = lambda doc, v: doc.withField("x", F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))
        up, down = F.least(a * (1 - x), b * y), F.least(a * x, b * (1 - y))  # words that can move to old, or from it
        rises = _coin(old["tie"], new["tie"], level) * (up + down) < down
        step = lambda goes_on, ends: F.struct(goes_on.alias("open"), F.concat(state["done"], F.array(ends)).alias("done"))
        return (
            F.when(old.isNull(), F.struct(new.alias("open"), state["done"].alias("done")))
            .when(rises & (a * (1 - x) <= b * y), step(at(new, y - up / b), at(old, F.lit(1.0))))
            .when(rises, step(at(old, x + up / a), at(new, F.lit(0.0))))
            .when(a * x <= b * (1 - y), step(at(new, y + down / b), at(old, F.lit(0.0))))
            .otherwise(step(at(old, x - down / a), at(new, F.lit(1.0))))
        )

    nothing = F.expr(f"named_struct('open', cast(null as {item}), 'done', cast(array() as array<{item}>))")
    return F.aggregate("items", nothing, meet)


def _root(item: str) -> Callable[[DataFrame], DataFrame]:
    """From `open`, the document that the tree leaves (or null), `reserve`, documents of one fraction, and `target`: all documents with x 0 or 1."""

    def meet(state: Column, new: Column, own: bool) -> Column:
        a, y = new["size"].cast("double"), state["y"]
        x, rest = (y, state["rest"] - a) if own else (new["x"], state["rest"])
        up, down = F.least(a * (1 - x), rest * y), F.least(a * x, rest * (1 - y))  # words that can move to it, or from it
        moves = (rest > 0) & (up + down > 0)
        rises = _coin(new["tie"], F.lit(1), -1) * (up + down) < down
        whole = F.when(rises, a * (1 - x) <= rest * y).otherwise(a * x <= rest * (1 - y))
        part = F.when(moves & rises, x + up / a).when(moves, x - down / a).otherwise(x)
        ends = F.when(moves & whole, rises).otherwise(_coin(new["tie"], F.lit(2), -1) < part)
        behind = F.when(rises, F.when(whole, y - up / rest).otherwise(0.0)).otherwise(F.when(whole, y + down / rest).otherwise(1.0))
        y = F.when(moves, F.greatest(F.lit(0.0), F.least(F.lit(1.0), behind))).otherwise(y)
        return F.struct(y.alias("y"), rest.alias("rest"), F.concat(state["done"], F.array(new.withField("x", F.when(ends, 1.0).otherwise(0.0)))).alias("done"))

    def turn(state: Column, new: Column) -> Column:
        more, fits = state["left"] > 0, (new["size"] > 0) & (new["size"] <= F.abs(state["left"]))
        turns = fits & (new["x"] == F.when(more, 0.0).otherwise(1.0))
        to = F.when(turns, 1 - new["x"]).otherwise(new["x"])
        left = state["left"] - (to - new["x"]) * new["size"]
        return F.struct(left.alias("left"), F.concat(state["done"], F.array(new.withField("x", to))).alias("done"))

    none = F.expr(f"cast(array() as array<{item}>)")
    total = lambda of, by: F.aggregate(of, F.lit(0.0), lambda n, r: n + r["size"] * (r["x"] if by else 1))
    start = F.struct(F.coalesce(F.get("reserve", F.lit(0))["x"], F.lit(0.0)).alias("y"), total(F.col("reserve"), False).alias("rest"), none.alias("done"))
    done = F.aggregate("reserve", F.when(F.col("open").isNull(), start).otherwise(meet(start, F.col("open"), False)), lambda state, new: meet(state, new, True))["done"]
    every = F.array_compact(F.concat(F.array("open"), "reserve"))
    near = lambda left: F.abs(left) <= F.col("target") / NEAR
    turned = lambda docs, left: F.aggregate(F.sort_array(docs, False), F.struct(left.alias("left"), none.alias("done")), turn)

    def settled(roots: DataFrame) -> DataFrame:
        roots = roots.withColumn("done", done).withColumn("left", total(every, True) - total(F.col("done"), True))
        roots = roots.withColumn("one", F.when(~near(F.col("left")), turned(F.col("done"), F.col("left"))))
        # what fits doesn't do: the smallest that is more than missing turns, and what it is too much is made up for
        left, docs = F.col("one.left"), F.col("one.done")
        way = F.when(left > 0, 0.0).otherwise(1.0)
        roots = roots.withColumn("over", F.when(~near(left), F.array_min(F.filter(docs, lambda d: (d["size"] > F.abs(left)) & (d["x"] == way)))))
        both = F.transform(docs, lambda d: F.when(d == F.col("over"), d.withField("x", 1 - d["x"])).otherwise(d))
        roots = roots.withColumn("two", F.when(F.col("over").isNotNull(), turned(both, left - F.when(left > 0, 1).otherwise(-1) * F.col("over.size"))))
        better = F.abs("two.left") < F.abs(left)
        return roots.select(F.when(better, F.col("two.done")).otherwise(F.coalesce("one.done", "done")).alias("done"))

    return settled


def taken_words(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for each row of docs (doc_id, text, source)."""
    slim = written(numbered(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))), "sizes")
    goal = written(targets(slim), "targets").withColumnRenamed("source", "_source")
    sent = F.broadcast if goal.count() <= SENT_SOURCES else lambda df: df
    # a null source is a source, so it must meet itself
    wanted = slim.join(sent(goal), F.col("source").eqNullSafe(F.col("_source")))
    base = F.floor("copies").cast("int")
    x = F.when(F.col("size") > 0, F.col("copies") - base).otherwise(0.0)
    items = wanted.select("size", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "source_no", "size", "nth").alias("tie"), "doc_id", "source_no", base.alias("base"), x.alias("x"))
    item = ITEM.format(id=dict(items.dtypes)["doc_id"])
    fields = items.columns
    ended = [items.where("x = 0")]
    live = items.where("x > 0").withColumn("_class", F.floor(F.log2("size")).cast("int"))
    # a task gives out RESERVE rows of each class at most, and a source has 63 classes
    nth = F.row_number().over(Window.partitionBy("source_no", "_class").orderBy("tie"))
    cut = live.select("source_no", "_class", "tie").withColumn("_nth", nth).where(F.col("_nth") <= RESERVE).groupBy("source_no", "_class").agg(F.max("tie").alias("_cut"))
    cut = written(cut, "cut")
    live = live.join(F.broadcast(cut) if cut.count() <= SENT_SOURCES else cut, ["source_no", "_class"])
    reserve = live.where("tie <= _cut").select(*fields)
    live = live.where("tie > _cut").select(*fields)
    many = written(live.groupBy("source_no").agg(F.count(F.lit(1)).alias("_n")), "many")
    most = many.agg(F.max("_n")).first()[0] or 0
    level, reach = 0, 1
    while most and (reach < most or level == 0):
        reach *= block
        blocks = F.ceil(F.col("_n") / F.lit(reach))
        dealt = live.join(sent(many), "source_no").groupBy("source_no", F.pmod(F.xxhash64(F.lit(level), "tie"), blocks).alias("_block"))
        folded = dealt.agg(F.sort_array(F.collect_list(F.struct(*fields)), False).alias("items")).select(_fold(level, item).alias("f"))
        folded = written(folded.select("f.open", "f.done"), f"fold{level}")
        ended.append(folded.select(F.inline("done")))
        live = folded.select("open.*")
        level += 1
    waiting = reserve.select("source_no", F.struct(*fields).alias("r"), F.lit(None).cast(item).alias("o")).unionByName(live.select("source_no", F.lit(None).cast(item).alias("r"), F.struct(*fields).alias("o")))
    roots = waiting.groupBy("source_no").agg(F.sort_array(F.collect_list("r"), False).alias("reserve"), F.max("o").alias("open"))
    ended.append(written(_root(item)(roots.join(sent(goal.select("source_no", "target")), "source_no")), "roots").select(F.inline("done")))
    out = ended[0]
    for more in ended[1:]:
        out = out.unionByName(more)
    copies = (F.col("base") + F.col("x")).cast("long")
    return out.join(sent(goal.select("source_no", "source_size", "target")), "source_no").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "source_no"
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents", "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")
