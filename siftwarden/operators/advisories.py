"""Advisories: events to ranges, overlays, feeds, and the match with dependencies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwarden.functions import versions as V

from .findings import first_of


def ranges(events: Column) -> Column:
    """Events (introduced, fixed, last_affected, limit) in order to a range: each upper bound ends an alternative.

    introduced 0 is no lower bound; a lower bound that nothing ends stays open.
    """
    low = lambda lower: F.when(lower.isNull() | (lower == "0"), F.lit("")).otherwise(F.concat(F.lit(">="), lower))
    join = lambda a, b: F.when(a == "", b).otherwise(F.concat(a, F.lit(","), b))
    start = F.struct(F.lit(None).cast("string").alias("lower"), F.lit(False).alias("open"), F.expr("cast(array() as array<string>)").alias("done"))

    def step(state: Column, e: Column) -> Column:
        top = F.when(e["fixed"].isNotNull(), F.concat(F.lit("<"), e["fixed"])).when(e["limit"].isNotNull(), F.concat(F.lit("<"), e["limit"])).when(e["last_affected"].isNotNull(), F.concat(F.lit("<="), e["last_affected"]))
        ended = F.struct(F.lit(None).cast("string").alias("lower"), F.lit(False).alias("open"), F.concat(state["done"], F.array(join(low(state["lower"]), top))).alias("done"))
        opened = F.struct(e["introduced"].alias("lower"), F.lit(True).alias("open"), state["done"].alias("done"))
        return F.when(e["introduced"].isNotNull(), opened).when(top.isNotNull(), ended).otherwise(state)

    def end(state: Column) -> Column:
        rest = F.when(state["open"], F.array(F.when(low(state["lower"]) == "", F.lit(">=0")).otherwise(low(state["lower"])))).otherwise(F.expr("cast(array() as array<string>)"))
        return F.array_join(F.concat(state["done"], rest), "||")

    return F.aggregate(events, start, step, end)


def overlaid(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Overlay advisories replace those of the same package and id, and add to the rest."""
    return base.join(overlay, ["ecosystem", "package", "id"], "left_anti").unionByName(overlay)


def overlaid_packages(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """All that an overlay says of a package replaces all that is known of it."""
    return base.join(overlay.select("ecosystem", "package").distinct(), ["ecosystem", "package"], "left_anti").unionByName(overlay)


def looked_up(packages: DataFrame, sources: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Advisories for packages (ecosystem, package) from sources asked in turn, each for what those before know nothing of.

    A source is a function from packages to advisories: a table that is joined, or a service that tasks ask.
    """
    by, out, open_ = ["ecosystem", "package"], None, packages.select("ecosystem", "package").distinct()
    for source in sources:
        found = source(open_)
        out = found if out is None else out.unionByName(found)
        open_ = open_.join(found.select(*by).distinct(), by, "left_anti")
    if out is None:
        raise ValueError("no source to ask")
    return out


def table_source(advisories: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A source that a table is."""
    return lambda packages: advisories.join(packages, ["ecosystem", "package"], "left_semi")


def merged_feeds(feeds: DataFrame) -> DataFrame:
    """One advisory for each package and CVE (or id), from the first source that has it."""
    keyed = feeds.withColumn("_name", F.coalesce("cve", "id"))
    return first_of(keyed, ["ecosystem", "package", "_name"], [F.col("source_no"), F.col("id")]).drop("_name")


#: Advisories of a package from which on its versions are looked up in an index of ranges.
BUSY = 1_000
#: Bits of a version's code that one level of the index takes, and levels.
BITS, LEVELS = 3, 21


def _nodes(low: Column, high: Column) -> Column:
    """The stretches of codes, each all codes that agree but for their last BITS * level bits, that make up [low, high]: structs of level and n.

    At most 2 * (2**BITS - 1) of each level, so a range is a few dozen rows however many versions lie in it.
    """
    width = 1 << BITS
    start = F.struct(low.alias("a"), (high + 1).alias("b"), F.expr("cast(array() as array<struct<level:int,n:bigint>>)").alias("nodes"))

    def level(state: Column, k: Column) -> Column:
        a, b = state["a"], state["b"]
        up, down = F.shiftright(a + (width - 1), BITS), F.shiftright(b, BITS)
        left = F.least(up * width, b)
        right = F.greatest(down * width, left)
        run = lambda x, y: F.when(x < y, F.sequence(x, y - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))
        some = F.transform(F.concat(run(a, left), run(right, b)), lambda n: F.struct(k.cast("int").alias("level"), n.alias("n")))
        return F.struct(up.alias("a"), down.alias("b"), F.concat(state["nodes"], some).alias("nodes"))

    # once a is not under b nothing is left of the range
    whole = lambda state, k: F.when(state["a"] < state["b"], level(state, k)).otherwise(state)
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), start, whole)["nodes"]


def indexed(versions: DataFrame, ranges_: DataFrame) -> DataFrame:
    """(ecosystem, package, _key, _adv) for each version of a package in each range that holds it; versions: (ecosystem, package, _key), ranges_: (ecosystem, package, _adv, _bounds).

    Alternatives become stretches of version codes and versions the stretches that they lie in, one of each level, so these two meet by equality,
    and a package's versions and ranges are never paired but where they meet.
    """
    alternatives = ranges_.select("ecosystem", "package", "_adv", F.explode("_bounds").alias("_alt"))
    keys = lambda *ops: F.transform(F.filter("_alt", lambda c: c["op"].isin(*ops)), lambda c: V.code(c["key"]))
    exact = ("=", "==", "===", "")
    low = F.coalesce(F.array_max(keys(">=", ">", *exact)), F.lit(0).cast("long"))
    high = F.coalesce(F.array_min(keys("<=", "<", *exact)), F.lit((1 << 62) - 1))
    nodes = alternatives.withColumn("_node", F.explode(_nodes(low, high)))
    nodes = nodes.select("ecosystem", "package", F.col("_node.level").alias("_level"), F.col("_node.n").alias("_n"), "_adv", "_alt")
    points = versions.select("ecosystem", "package", "_key").distinct().withColumn("_code", V.code(F.col("_key")))
    at = F.array(*(F.struct(F.lit(k).alias("_level"), F.shiftright("_code", BITS * k).alias("_n")) for k in range(LEVELS)))
    points = points.select("ecosystem", "package", "_key", F.inline(at))
    met = nodes.join(points, ["ecosystem", "package", "_level", "_n"]).where(V.within(F.col("_key"), F.array("_alt")))
    return met.select("ecosystem", "package", "_key", "_adv").distinct()


def matched(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies with each advisory whose range holds the version they name, and the confidence: high if that is
    the one version they allow, medium if they allow more but provably not the one that mends it, or none does.

    Ranges and versions are taken apart once for each row of either side, and their parts compared; of packages with more than BUSY
    advisories only those that an index of ranges gives.
    """
    ranges_ = advisories.withColumn("_bounds", V.bounds(F.col("affected")))
    # pre-releases and build marks count where the version is the only one
    version = F.when(V.pinned(F.col("spec")), F.regexp_replace("spec", r"^={0,3}\s*v?", "")).otherwise(V.candidate(F.col("spec")))
    named = dependencies.withColumns({"package": V.package_name(F.col("ecosystem"), F.col("name")), "_pinned": V.pinned(F.col("spec")), "_key": V.key(version), "_normal": V.normalized(F.col("spec"))})
    named = named.where(version.isNotNull())
    by = ["ecosystem", "package"]
    busy = advisories.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BUSY).select(*by)
    direct = lambda some: some.join(ranges_, by).where(V.within(F.col("_key"), F.col("_bounds")))
    if busy.isEmpty():
        both = direct(named)
    else:
        both, few = direct(named.join(busy, by, "left_anti")), named.join(busy, by, "left_semi")
        told = ranges_.join(busy, by, "left_semi").withColumn("_adv", F.struct(F.xxhash64(*advisories.columns).alias("a"), F.xxhash64(F.lit(1), *advisories.columns).alias("b")))
        found = indexed(few, told.select(*by, "_adv", "_bounds").dropDuplicates([*by, "_adv"]))
        both = both.unionByName(few.join(found, [*by, "_key"]).join(told, [*by, "_adv"]).drop("_adv"))
    fixed = F.coalesce("fixed_in", F.lit(""))
    mends = F.when(F.col("_normal").isNotNull() & fixed.rlike(r"^v?\d"), V.in_range(fixed, F.col("_normal")))
    loose = (fixed == "") | ~F.coalesce(mends, F.lit(True))
    return both.where(F.col("_pinned") | loose).withColumn("confidence", F.when(F.col("_pinned"), "high").otherwise("medium")).drop("_pinned", "_key", "_normal", "_bounds")
