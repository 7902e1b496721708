"""Queries on components, versions, ranges and advisories.

Parts are components: brand is the name, size and price make the version, type picks ecosystem and licence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwarden.functions import licences as L, versions as V
from siftwarden.operators import advisories, findings as ops
from siftwarden.sinks.render import purl

from .registry import query
from .standins import dealt, dealt_sql, read

ECOSYSTEMS = ("python", "npm", "go")
LICENCE_OF = ("MIT", "GPL-3.0", "MPL-2.0", "MIT OR GPL-2.0", "Custom")
COMPONENT = """component AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'npm' ELSE 'go' END AS ecosystem, p_brand AS name,
  p_size || '.' || (p_partkey % 10) || '.' || (p_partkey % 7) AS version, CASE p_partkey % 5 WHEN 0 THEN 'MIT' WHEN 1 THEN 'GPL-3.0' WHEN 2 THEN 'MPL-2.0' WHEN 3 THEN 'MIT OR GPL-2.0' ELSE 'Custom' END AS licence FROM part)"""


def _of(n: int, values: tuple[str, ...]):
    return F.get(F.array(*map(F.lit, values)), (F.col("p_partkey") % n).cast("int"))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 10).cast("string"), (F.col("p_partkey") % 7).cast("string"))
    return read(spark, sf_dir, "part").select("p_partkey", _of(3, ECOSYSTEMS).alias("ecosystem"), F.col("p_brand").alias("name"), version.alias("version"), _of(5, LICENCE_OF).alias("licence"))


@query(f"""WITH {COMPONENT} SELECT ecosystem, lower(name) AS name, version, min(p_partkey) AS first_part,
  'pkg:' || CASE ecosystem WHEN 'python' THEN 'pypi' WHEN 'npm' THEN 'npm' ELSE 'golang' END || '/' || replace(lower(name), '#', '%23') || '@' || version AS purl FROM component GROUP BY ecosystem, name, version""")
def components_sbom(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = components(spark, sf_dir).withColumn("purl", purl(F.col("ecosystem"), V.package_name(F.col("ecosystem"), F.col("name")), F.col("version"))).withColumn("name", F.lower("name"))
    first = ops.first_of(c, ["ecosystem", "name", "version"], ["p_partkey"])
    return first.select("ecosystem", "name", "version", F.col("p_partkey").alias("first_part"), "purl")


@query(f"""WITH {COMPONENT}, k AS (SELECT CASE licence WHEN 'MIT' THEN 'allowed' WHEN 'GPL-3.0' THEN 'blocked' WHEN 'MPL-2.0' THEN 'warning' WHEN 'MIT OR GPL-2.0' THEN 'allowed' ELSE 'unknown' END AS class FROM component)
  SELECT c.class, CAST(count(k.class) AS BIGINT) AS n FROM (SELECT unnest(['allowed', 'warning', 'unknown', 'blocked']) AS class) c LEFT JOIN k USING (class) GROUP BY c.class""")
def license_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    many = components(spark, sf_dir).groupBy(L.classify(F.col("licence")).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame([(c,) for c in L.CLASSES], "class string").join(many, "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"))


# Versions in order, pairs next to each other: fixed values.
VERSIONS = ["0.9", "1.0.0-alpha", "1.0.0-beta", "1.0.0", "1.0.0rc1", "1.2", "1.10", "2.0", "v2.0.1", "10.0.0.1"]


#: Versions of a part: three numbers, and a pre-release for some.
_V = lambda a, b, c, d: f"p_partkey {a} % 3 AS x{d}, p_partkey {b} % 11 AS y{d}, p_partkey {c} % 4 AS z{d}, CASE WHEN p_partkey {c} % 5 = 0 THEN 'rc' || p_partkey {b} % 3 ELSE '~' END AS pre{d}"
_TEXT = lambda d: f"x{d} || '.' || y{d} || '.' || z{d} || CASE WHEN pre{d} = '~' THEN '' ELSE '-' || pre{d} END"


@query(
    f"WITH {dealt_sql([(a, b, (i < j) - (i > j)) for i, a in enumerate(VERSIONS) for j, b in enumerate(VERSIONS)], 'a, b, less')}, v AS (SELECT p_partkey, {_V('', '// 3', '// 5', 'a')}, {_V('// 2', '// 7', '// 4', 'b')} FROM part)"
    f" SELECT p_partkey, a, b, CAST(less AS INTEGER) AS less FROM dealt UNION ALL SELECT p_partkey, {_TEXT('a')}, {_TEXT('b')}, CASE WHEN (xa, ya, za, prea) < (xb, yb, zb, preb) THEN 1 WHEN (xa, ya, za, prea) > (xb, yb, zb, preb) THEN -1 ELSE 0 END FROM v"
)
def version_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part one of the pairs of versions above, and two made of its key."""
    k = F.col("p_partkey")
    by = lambda n, m: (F.floor(k / n) % m).cast("string")
    made = lambda x, y, z: F.concat(by(x, 3), F.lit("."), by(y, 11), F.lit("."), by(z, 4), F.when(by(z, 5) == "0", F.concat(F.lit("-rc"), by(y, 3))).otherwise(""))
    two = read(spark, sf_dir, "part").select("p_partkey", made(1, 3, 5).alias("a"), made(2, 7, 4).alias("b"))
    pairs = dealt(spark, sf_dir, [(a, b) for a in VERSIONS for b in VERSIONS], "a string, b string").select("p_partkey", "a", "b").unionByName(two)
    a, b = V.key(F.col("a")), V.key(F.col("b"))
    return pairs.select("p_partkey", "a", "b", (F.when(a < b, 1).when(a > b, -1).otherwise(0)).alias("less"))


ADVISORIES = [("python", "brand#11", "ADV-1", ">=5,<20", "20.0"), ("npm", "brand#11", "ADV-2", "<10||>=40.5,<=45.9.9", ""), ("go", "brand#22", "ADV-3", ">30.1.2", "99.0"), ("npm", "brand#33", "ADV-4", "", "1.0")]
# Versions here have three small parts, so one number orders them.
_N = "CAST(split_part(version, '.', 1) AS INTEGER) * 10000 + CAST(split_part(version, '.', 2) AS INTEGER) * 100 + CAST(split_part(version, '.', 3) AS INTEGER)"
HELD = {"ADV-1": "v >= 50000 AND v < 200000", "ADV-2": "v < 100000 OR (v >= 400500 AND v <= 450909)", "ADV-3": "v > 300102", "ADV-4": "false"}
#: Parts with an even key name one version; odd ones allow all later ones too, so the version that mends it unless that is none.
MENDS = {"ADV-1": "v <= 200000", "ADV-2": "false", "ADV-3": "v <= 990000", "ADV-4": "true"}


@query(
    f"WITH {COMPONENT}, c AS (SELECT *, {_N} AS v, p_partkey % 2 = 0 AS pinned FROM component) "
    + " UNION ALL ".join(f"SELECT p_partkey, '{i}' AS id, CASE WHEN pinned THEN 'high' ELSE 'medium' END AS confidence FROM c WHERE ecosystem = '{e}' AND lower(name) = '{n}' AND ({HELD[i]}) AND (pinned OR NOT ({MENDS[i]}))" for e, n, i, _, _ in ADVISORIES)
)
def version_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    adv = spark.createDataFrame(ADVISORIES, "ecosystem string, package string, id string, affected string, fixed_in string")
    deps = components(spark, sf_dir).withColumn("spec", F.concat(F.when(F.col("p_partkey") % 2 == 0, "==").otherwise(">="), F.col("version")))
    return advisories.matched(deps, adv).select("p_partkey", "id", "confidence")


# Requirement, whether it names one version, and its normal form: fixed values.
SPECS = [("1.2.3", True, "1.2.3"), ("==1.2.3", True, "==1.2.3"), ("=1.2", True, "=1.2"), ("^1.2.3", False, ">=1.2.3,<2.0.0"), ("^0.2.3", False, ">=0.2.3,<0.3.0"), ("^0.0.3", False, ">=0.0.3,<0.0.4"), ("~1.2.3", False, ">=1.2.3,<1.3.0"),
         ("~>1.2", False, ">=1.2.0,<2.0.0"), ("~>1.2.3", False, ">=1.2.3,<1.3.0"), ("~=1.4.2", False, ">=1.4.2,<1.5.0"), ("1.*", False, ">=1.0.0,<2.0.0"), ("1.2.x", False, ">=1.2.0,<1.3.0"), (">=1.0, <2.0", False, ">=1.0,<2.0"), ("*", False, None), ("latest", False, None)]


#: Requirements of a part's own numbers x, y, z, of ten forms, as SQL; and the bounds that each stands for, as numbers x * 10000 + y * 100 + z.
FORMS = ["'^' || x || '.' || y || '.' || z", "'~' || x || '.' || y || '.' || z", "'~>' || x || '.' || y", "'~> ' || x || '.' || y || '.' || z", "'~=' || x || '.' || y || '.' || z", "x || '.*'", "x || '.' || y || '.x'", "'>=' || x || '.' || y || '.' || z || ', <' || (x + 1) || '.0'", "'==' || x || '.' || y || '.' || z", "'latest'"]
_FULL, _NEXT = "x * 10000 + y * 100 + z", {"major": "(x + 1) * 10000", "minor": "x * 10000 + (y + 1) * 100", "patch": "x * 10000 + y * 100 + z + 1"}
_CARET = f"CASE WHEN x > 0 THEN {_NEXT['major']} WHEN y > 0 THEN {_NEXT['minor']} ELSE {_NEXT['patch']} END"
LIMITS = [(_FULL, _CARET), (_FULL, _NEXT["minor"]), ("x * 10000 + y * 100", _NEXT["major"]), (_FULL, _NEXT["minor"]), (_FULL, _NEXT["minor"]), ("x * 10000", _NEXT["major"]), ("x * 10000 + y * 100", _NEXT["minor"]), (_FULL, _NEXT["major"]), (_FULL, _NEXT["patch"]), ("NULL", "NULL")]
_CASE = lambda values: "CASE form " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"
SPEC = f"""nums AS (SELECT p_partkey, p_partkey % 10 AS form, p_partkey // 10 % 3 AS x, p_partkey // 30 % 4 AS y, p_partkey // 7 % 5 AS z, p_partkey // 3 % 4 AS a, p_partkey // 11 % 5 AS b, p_partkey // 13 % 6 AS c FROM part),
  spec AS (SELECT *, {_CASE(FORMS)} AS spec, {_CASE([low for low, _ in LIMITS])} AS low, {_CASE([high for _, high in LIMITS])} AS high FROM nums)"""
_DOTS = lambda v: f"({v}) // 10000 || '.' || ({v}) // 100 % 100 || '.' || ({v}) % 100"


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's requirement, and a version."""
    k = F.col("p_partkey")
    n = lambda by, m: (F.floor(k / by) % m).cast("int")
    nums = read(spark, sf_dir, "part").select("p_partkey", (k % 10).cast("int").alias("form"), n(10, 3).alias("x"), n(30, 4).alias("y"), n(7, 5).alias("z"), F.concat_ws(".", n(3, 4).cast("string"), n(11, 5).cast("string"), n(13, 6).cast("string")).alias("version"))
    return nums.withColumn("spec", F.expr(_CASE(FORMS)))


@query(
    f"WITH {SPEC}, {dealt_sql(SPECS, 'case_spec, pinned, normalized')} SELECT p_partkey, case_spec AS spec, pinned, normalized FROM dealt UNION ALL SELECT p_partkey, spec, form = 8, CASE form WHEN 7 THEN replace(spec, ' ', '') WHEN 8 THEN spec WHEN 9 THEN NULL ELSE '>=' || {_DOTS('low')} || ',<' || {_DOTS('high')} END FROM spec"
)
def spec_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part one of the requirements above, and one of its own numbers."""
    rows = dealt(spark, sf_dir, [(a,) for a, _, _ in SPECS], "spec string").select("p_partkey", "spec").unionByName(_specs(spark, sf_dir).select("p_partkey", "spec"))
    return rows.select("p_partkey", "spec", V.pinned(F.col("spec")).alias("pinned"), V.normalized(F.col("spec")).alias("normalized"))


PERMITS = [("^1.0", "1.5.0", True), ("^1.0", "2.0.0", False), (">=1,!=1.3", "1.3", False), (">=1,!=1.3", "1.4", True), ("latest", "1.0", None), ("~1.2", "1.2.9", True), (None, "1.0", None)]


@query(
    f"WITH {SPEC}, {dealt_sql(PERMITS, 'case_spec, version, permits')} SELECT p_partkey, case_spec AS spec, version, permits FROM dealt"
    " UNION ALL SELECT p_partkey, spec, a || '.' || b || '.' || c, a * 10000 + b * 100 + c >= low AND a * 10000 + b * 100 + c < high FROM spec"
)
def range_permits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part one of the cases above, and its own requirement with a version."""
    rows = dealt(spark, sf_dir, [(a, b) for a, b, _ in PERMITS], "spec string, version string").select("p_partkey", "spec", "version").unionByName(_specs(spark, sf_dir).select("p_partkey", "spec", "version"))
    return rows.select("p_partkey", "spec", "version", V.permits(F.col("spec"), F.col("version")).alias("permits"))


# Events (introduced, fixed, last_affected, limit) and the range they make: fixed values.
EVENTS = [("fixed", [("0", None, None, None), (None, "1.2", None, None)], "<1.2"), ("last", [("1.0", None, None, None), (None, None, "1.9", None)], ">=1.0,<=1.9"), ("open", [("0", None, None, None)], ">=0"),
          ("two", [("1", None, None, None), (None, "1.5", None, None), ("2", None, None, None), (None, "2.3", None, None)], ">=1,<1.5||>=2,<2.3"), ("limit", [("3", None, None, None), (None, None, None, "4")], ">=3,<4")]


@query(f"WITH {dealt_sql([(a, c) for a, _, c in EVENTS], 'id, affected')} SELECT p_partkey, id, replace(affected, '1.', p_size || '.') AS affected FROM dealt")
def osv_events_to_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part the events of one of the cases above, its size for 1 in front of a dot."""
    kind = "array<struct<introduced:string,fixed:string,last_affected:string,limit:string>>"
    rows = dealt(spark, sf_dir, [(a, b) for a, b, _ in EVENTS], f"id string, events {kind}")
    size = lambda v: F.replace(v, F.lit("1."), F.concat(F.col("p_size").cast("string"), F.lit(".")))
    own = F.transform("events", lambda e: F.struct(*(size(e[c]).alias(c) for c in ("introduced", "fixed", "last_affected", "limit"))))
    return rows.select("p_partkey", "id", advisories.ranges(own).alias("affected"))


FEED = """feed AS (SELECT CASE p_partkey % 2 WHEN 0 THEN 'npm' ELSE 'python' END AS ecosystem, lower(p_brand) AS package, 'A-' || (p_partkey % 50) AS id, CASE WHEN p_partkey % 3 = 0 THEN 'CVE-' || (p_partkey % 25) END AS cve, CAST(p_size % 3 AS INTEGER) AS source_no, p_partkey FROM part)"""


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        F.when(k % 2 == 0, "npm").otherwise("python").alias("ecosystem"), F.lower("p_brand").alias("package"), F.concat(F.lit("A-"), (k % 50).cast("string")).alias("id"),
        F.when(k % 3 == 0, F.concat(F.lit("CVE-"), (k % 25).cast("string"))).alias("cve"), (F.col("p_size") % 3).cast("int").alias("source_no"), "p_partkey",
    )


@query(f"WITH {FEED} SELECT ecosystem, package, id, cve, source_no FROM (SELECT *, row_number() OVER (PARTITION BY ecosystem, package, coalesce(cve, id) ORDER BY source_no, id) AS rn FROM feed) WHERE rn = 1")
def feed_merge_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advisories.merged_feeds(_feed(spark, sf_dir)).select("ecosystem", "package", "id", "cve", "source_no")


@query(f"""WITH {FEED}, base AS (SELECT * FROM feed WHERE source_no < 2), over AS (SELECT * FROM feed WHERE source_no = 2)
  SELECT ecosystem, source_no, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM base b WHERE NOT EXISTS (SELECT 1 FROM over o WHERE o.ecosystem = b.ecosystem AND o.package = b.package AND o.id = b.id) UNION ALL SELECT * FROM over) GROUP BY ecosystem, source_no""")
def advisory_overlay_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _feed(spark, sf_dir)
    return advisories.overlaid(f.where("source_no < 2"), f.where("source_no = 2")).groupBy("ecosystem", "source_no").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FEED} SELECT ecosystem, CAST(count(DISTINCT package) AS BIGINT) AS packages, CAST(count(*) AS BIGINT) AS advisories, CAST(count(DISTINCT cve) AS BIGINT) AS cves FROM feed GROUP BY ecosystem")
def advisory_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed(spark, sf_dir).groupBy("ecosystem").agg(F.count_distinct("package").alias("packages"), F.count(F.lit(1)).alias("advisories"), F.count_distinct("cve").alias("cves"))


@query(f"WITH {FEED} SELECT ecosystem, package, id, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY ecosystem, package ORDER BY p_partkey) AS rn FROM feed) WHERE rn <= 5")
def advisories_per_package_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    rn = F.row_number().over(Window.partitionBy("ecosystem", "package").orderBy("p_partkey"))
    return _feed(spark, sf_dir).withColumn("rn", rn).where("rn <= 5").select("ecosystem", "package", "id", "p_partkey")


@query(f"""WITH {FEED}, e AS (SELECT DISTINCT cve FROM feed WHERE source_no = 0 AND cve IS NOT NULL), f AS (SELECT DISTINCT cve FROM feed WHERE source_no = 1 AND cve IS NOT NULL)
  SELECT CASE WHEN e.cve IS NULL THEN 'extra' WHEN f.cve IS NULL THEN 'missed' ELSE 'found' END AS outcome, CAST(count(*) AS BIGINT) AS n FROM e FULL JOIN f ON e.cve = f.cve GROUP BY 1""")
def feed_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _feed(spark, sf_dir).where("cve is not null")
    side = lambda n, name: f.where(F.col("source_no") == n).select("cve").distinct().withColumn(name, F.lit(1))
    both = side(0, "e").join(side(1, "f"), "cve", "full")
    return both.groupBy(F.when(F.col("e").isNull(), "extra").when(F.col("f").isNull(), "missed").otherwise("found").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {COMPONENT}, c AS (SELECT *, {_N} AS v FROM component), hit AS ("
    + " UNION ALL ".join(f"SELECT ecosystem, lower(name) AS name, version, '{i}' AS id FROM c WHERE ecosystem = '{e}' AND lower(name) = '{n}' AND ({HELD[i]})" for e, n, i, _, _ in ADVISORIES)
    + ") SELECT ecosystem, name, version, CAST(count(*) AS BIGINT) AS parts, CAST(count(DISTINCT id) AS BIGINT) AS advisories, min(id) AS first_id FROM hit GROUP BY ecosystem, name, version"
)
def vulnerable_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components with the advisories that concern them."""
    adv = spark.createDataFrame(ADVISORIES, "ecosystem string, package string, id string, affected string, fixed_in string")
    hit = advisories.matched(components(spark, sf_dir).withColumn("spec", F.concat(F.lit("=="), F.col("version"))), adv)
    return hit.groupBy("ecosystem", F.lower("name").alias("name"), "version").agg(F.count(F.lit(1)).alias("parts"), F.count_distinct("id").alias("advisories"), F.min("id").alias("first_id"))


#: A file of advisory records for each part, of six kinds: a record, a batch of two, a list of one and a number, a record with another name for the same, one that is cut off, a list of numbers.
RECORD = """'{"id":"' || {0} || '","aliases":["' || {1} || '"],"affected":[{"package":{"ecosystem":"PyPI","name":"' || p_brand || '"},"ranges":[{"type":"ECOSYSTEM","events":[{"introduced":"0"},{"fixed":"' || p_size || '.0"}]}]}]}'"""
_RECORD = lambda id_, alias: RECORD.replace("{0}", id_).replace("{1}", alias)
_KEY, _CVE = "CAST(p_partkey AS STRING)", "CAST(p_partkey % 50 AS STRING)"
FILES = [
    ("json", _RECORD(f"'A-' || {_KEY}", f"'CVE-' || {_CVE}")), ("json", f"""'{{"vulns":[' || {_RECORD(f"'B-' || {_KEY}", "'x'")} || ',' || {_RECORD(f"'B-' || {_KEY}", "'x'")} || ']}}'"""), ("json", f"""'[' || {_RECORD(f"'CVE-' || {_CVE}", "'y'")} || ', 7]'"""),
    ("yaml", _RECORD(f"'PY-' || {_KEY}", f"'CVE-' || {_CVE}")), ("json", """'{"id": "cut'"""), ("json", "'[1, 2]'"),
]


def _imported(spark: SparkSession, sf_dir: str):
    from siftwarden.sources import imports

    kind = F.expr("p_partkey % 6")
    text = F.lit(None).cast("string")
    for k, (_, sql) in enumerate(FILES):
        text = F.when(kind == k, F.expr(sql)).otherwise(text)
    name = F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.when(kind == 3, ".yaml").otherwise(".json"))
    read_ = imports.decoded(read(spark, sf_dir, "part").select((F.col("p_size") % 2).alias("source_no"), name.alias("file"), text.alias("text")))
    rows = imports.entries(read_)
    return read_, rows, imports.merged(rows)


IMPORTED = """e AS (SELECT p_size % 2 AS source_no, 'f' || p_partkey || CASE WHEN p_partkey % 6 = 3 THEN '.yaml' ELSE '.json' END AS file, lower(p_brand) AS package, '<' || p_size || '.0' AS affected,
    CASE p_partkey % 6 WHEN 0 THEN 'A-' || p_partkey WHEN 1 THEN 'B-' || p_partkey WHEN 2 THEN 'CVE-' || (p_partkey % 50) ELSE 'PY-' || p_partkey END AS id,
    CASE WHEN p_partkey % 6 IN (0, 2, 3) THEN 'CVE-' || (p_partkey % 50) END AS cve FROM part WHERE p_partkey % 6 < 4),
  all_rows AS (SELECT * FROM e UNION ALL SELECT * FROM e WHERE id LIKE 'B-%'),
  kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY package, coalesce(cve, id) ORDER BY source_no, file) AS k FROM all_rows) WHERE k = 1)"""


@query(f"WITH {IMPORTED} SELECT 'python' AS ecosystem, package, id, cve, affected FROM kept")
def advisory_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advisories of a file for each part, from two sources of which the first wins."""
    return _imported(spark, sf_dir)[2].select("ecosystem", "package", "id", "cve", "affected")


@query(f"""WITH {IMPORTED} SELECT (SELECT count(*) FROM all_rows) AS records, (SELECT count(*) FROM part WHERE p_partkey % 6 = 4) AS unreadable,
  (SELECT count(*) FROM all_rows) - (SELECT count(*) FROM kept) AS duplicates, (SELECT count(DISTINCT package) FROM kept) AS packages, (SELECT count(*) FROM kept) AS advisories""")
def advisory_import_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What that import read, couldn't read and merged."""
    from siftwarden.sources import imports

    return imports.sums(*_imported(spark, sf_dir))
