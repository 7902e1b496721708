"""Operator 2, quality rules: hashed n-gram log-likelihood ratio of trusted against raw text.

Tokens are runs of letters, digits and `_`, and runs of other visible characters, of the lower-cased
text.  Their uni- and bigrams, hashed into BUCKETS, are counted over all documents (raw) and over
those that `trusted` names; each bucket's log ratio of the two multinomials is summed over a
document's n-grams and divided by their number.  The trusted multinomial is smoothed towards the raw one, by
PRIOR n-grams dealt as raw ones are, so that where little is trusted ratios come near 0 and not below it.  A document is
kept if its ratio is at least THRESHOLD (a constant, so the verdict depends on no sample or quantile) and the base rules pass.

All of it is DataFrame functions; the BUCKETS log ratios are a literal in the scoring plan.  Write the result
before filtering on its columns: Spark would copy their nested expressions into the filter.

Nulls and edges: a null text has no words and fails the base rules; a text without n-grams has ratio 0;
without trusted documents all ratios are 0; repeated rows are counted and scored each; trusted ids that
repeat or are null count once or not at all; a ratio that equals THRESHOLD keeps; a very long text is one array of its
words, which its task must hold; columns of docs stay, but those named as result columns give way to them; an
empty table gives none.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, boxed, table, words

BUCKETS = 1 << 16
#: N-grams that the trusted counts are filled up with.
PRIOR = 1 << 16
#: Nats for each n-gram.  Clean texts lie about 0, also very short ones within 0.15; texts of symbols below -0.5.
THRESHOLD = -0.2
#: Up to so many trusted ids go to all workers, some 90 bytes each (under 64 MB); more meet the documents in a shuffle.
SENT_IDS = 700_000


def hashed(docs: DataFrame) -> DataFrame:
    """docs with _grams: for each token its hash and that of its bigram with the next one (the last: with none).

    In two columns, so that each is worked out once; Spark repeats a nested expression at every use.
    """
    tokens = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"), F.lit(0))
    docs = docs.withColumn("_tokens", F.transform(tokens, lambda t: F.xxhash64(t)))
    return docs.withColumn("_pairs", F.transform("_tokens", lambda h, i: F.xxhash64(h, F.get("_tokens", i + 1))))


def log_ratios(docs: DataFrame, trusted: DataFrame, n: int = BUCKETS) -> list[float]:
    """The log of trusted over raw probability for each bucket, over all of docs."""
    ids = trusted.select("doc_id").where("doc_id is not null").distinct().withColumn("_good", F.lit(1))
    ids = F.broadcast(ids) if ids.limit(SENT_IDS + 1).count() <= SENT_IDS else ids
    seen = hashed(docs.select("doc_id", "text").join(ids, "doc_id", "left")).select(F.explode(F.concat("_tokens", "_pairs")).alias("h"), F.coalesce("_good", F.lit(0)).alias("good"))
    counts = seen.groupBy(F.pmod("h", F.lit(n)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("good"))
    rows = counts.collect()  # n rows at most
    raw, good = sum(r.raw for r in rows), sum(r.good for r in rows)
    out = [0.0] * n
    if good:
        for r in rows:
            share = r.raw / raw
            out[r.b] = log((r.good + PRIOR * share) / (good + PRIOR)) - log(share)
    return out


def with_ratio(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """docs with llr, the length-normalised log-likelihood ratio of the text."""
    known = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folds to one literal
    of = lambda h: F.get(known, F.pmod(h, F.lit(len(ratios))).cast("int"))
    docs = hashed(docs)
    docs = docs.withColumn("_each", F.zip_with("_tokens", "_pairs", lambda a, b: of(a) + of(b)))
    mean = F.aggregate("_each", F.lit(0.0), lambda acc, x: acc + x) / (2 * F.size("_each"))
    return docs.withColumn("llr", F.when(F.size("_each") == 0, 0.0).otherwise(mean)).drop("_tokens", "_pairs", "_each")


def base_columns(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.withColumn("_words", words(F.col("text")))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(SPACE))) > 0)
    docs = docs.withColumns({"_hashes": F.transform("_words", lambda w: F.xxhash64(w)), "_lines": lines})
    windows = F.expr("transform(sequence(0, greatest(size(_hashes) - 5, 0)), i -> xxhash64(get(_hashes, i), get(_hashes, i + 1), get(_hashes, i + 2), get(_hashes, i + 3), get(_hashes, i + 4)))")
    docs = docs.withColumn("_windows", F.when(F.size("_words") > 5, windows))
    again = F.size("_windows") > F.size(F.array_distinct("_windows"))
    by_hash = F.when(again, F.expr("sort_array(transform(_windows, (h, i) -> struct(h, i)))"))
    docs = docs.withColumn("_by_hash", by_hash)
    starts = F.expr("""sort_array(filter(transform(_by_hash, (x, k) -> IF(x.h <=> get(_by_hash, k - 1).h OR x.h <=> get(_by_hash, k + 1).h, x.i, NULL)), i -> i IS NOT NULL))""")
    docs = docs.withColumn("_starts", starts)
    # each window that recurs covers its five words, up to where the next such window starts
    covered = F.expr("aggregate(transform(_starts, (s, k) -> least(5, coalesce(get(_starts, k + 1) - s, 5))), 0L, (n, m) -> n + m)")
    docs = docs.withColumns({
        "n_words": F.size("_words").cast("long"), "word_chars": F.char_length(F.array_join("_words", "")).cast("long"), "n_symbols": F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
    })
    docs = docs.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return docs.drop("_words", "_hashes", "_lines", "_windows", "_by_hash", "_starts")


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with the base columns, llr and kept."""
    docs, opened = boxed(docs, ["doc_id", "text"], RESULTS)
    out = with_ratio(base_columns(docs), log_ratios(docs, trusted))
    return opened(out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold)), RESULTS)


RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return judge(docs, trusted).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
