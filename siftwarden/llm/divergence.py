"""Operator 12, source divergence audit: two passes over the vocabulary, the second by an automaton.

Terms are runs of letters A-Z, a-z and of characters beyond ASCII, A-Z lower-cased.  A lang keeps the terms that
occur in at least LEAST of its documents.

1. The texts, their terms alone with a space between, are written once as blocks of one lang: a task packs what it reads of
   a source, compressed, a line for each document; what all tasks have packed of a source is dealt to blocks of about BLOCK bytes, and
   small sources share blocks.
2. First pass: each block gives its distinct terms with the number of its documents that hold them.  Added up they are exact document frequencies.
   A term's block counts meet once, in a window, which tells for each whether it is kept.
3. Second pass: each block meets those of its own terms that are kept, and only these, so an automaton (pyahocorasick)
   never holds more terms than a block has, whatever the vocabulary.  Every term is padded with a space on both sides, so it
   matches whole terms alone.  The matches are the occurrences; a term's list of sources and counts is its posting list.
4. Pairs of sources: with p(c) what a source gives a term of count c, the sum over all kept terms of f splits into terms that both
   have, that one has, and that none has.  Only the first need the postings of a term together; the others follow from how many terms of a source
   have each count, so that nothing runs over sources times vocabulary.
5. Ranks: pairs by source; terms are cut to the first 200 of each group, and those that tie with the last, in every task before they meet.

p = 1 + floor(10**9 * (count + 1) / (N + V)) is a long division by thousands, so no product leaves the longs below 9 * 10**15 occurrences.

Nulls and edges: null text, lang and source are ''; a document without terms still makes its group occur; a lang that keeps no
term has pairs of value 0 and no terms; a lang's only source has no pairs; rows that repeat count each, whatever their doc_id, which is
not looked at; ties go to the smaller item by UTF-8 bytes; a very long text makes a block of its own; bytes that aren't UTF-8 count as
letters; other columns are not looked at; an empty table gives none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written
from .hashing import utf8

#: Documents of a lang that a kept term occurs in.
LEAST = 3
#: Bytes of text in a block, about; bytes of terms that a task packs together, and that it holds of all sources, at most.
BLOCK, PACK, HELD = 16 << 20, 8 << 20, 48 << 20
#: Ranks of terms.
TERMS = 200
#: Pairs of sources that a task works on at one go.
PAIRS = 1 << 20
#: Groups whose totals are sent to all workers at most (some 10 MB); totals of more meet the postings in a shuffle.
SENT_GROUPS = 100_000
#: What a byte counts as: a lower-case letter, itself beyond ASCII, else a space.
_LETTER = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def packs(docs: DataFrame) -> DataFrame:
    """(nth, lang, source, size, terms) from rows (lang, source, text): zstd of lines of terms, a line for each document; size: bytes unpacked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list[bytes]] = {}
        sizes: Counter[tuple[str, str]] = Counter()
        given = 0

        def packed(groups: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
            nonlocal given
            for group in groups:
                raw = b"\n".join(held.pop(group))
                del sizes[group]
                columns = [[given], [group[0]], [group[1]], [len(raw)], [pa.compress(raw, "zstd", asbytes=True)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()))], ["nth", "lang", "source", "size", "terms"])
                given += 1

        for batch in batches:
            data, at = utf8(batch["text"])
            raw = data.tobytes().translate(_LETTER)
            for lang, source, a, b in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), at.tolist(), at[1:].tolist()):
                line = b" ".join(raw[a:b].split())
                held.setdefault((lang, source), []).append(line)
                sizes[lang, source] += len(line) + 1
                if sizes[lang, source] >= PACK:
                    yield from packed([(lang, source)])
            if sum(sizes.values()) >= HELD:
                yield from packed(list(held))
        yield from packed(list(held))

    return docs.mapInArrow(run, "nth long, lang string, source string, size long, terms binary")


def blocks(docs: DataFrame) -> DataFrame:
    """(block, lang, source, size, terms), in the order of blocks: packs, where a block has one lang, and one source unless its sources are small."""
    groups = docs.groupBy("lang", "source").agg(F.sum(F.octet_length("text")).cast("long").alias("bytes"))
    small = F.col("bytes") < BLOCK // 16
    together = F.sum(F.when(small, F.col("bytes"))).over(Window.partitionBy("lang"))
    groups = written(groups.withColumns({"small": small, "parts": 1 + F.floor(F.when(small, together).otherwise(F.col("bytes")) / BLOCK)}), "groups")
    sent = F.broadcast if groups.count() <= SENT_GROUPS else lambda df: df
    made = packs(docs).withColumn("task", F.spark_partition_id()).join(sent(groups.select("lang", "source", "small", "parts")), ["lang", "source"])
    of_source = F.xxhash64(F.lit(1), "lang", "source", F.pmod(F.xxhash64("task", "nth"), "parts"))
    shared = F.xxhash64(F.lit(0), "lang", F.pmod(F.xxhash64("source"), "parts"))
    made = made.select(F.when(F.col("small"), shared).otherwise(of_source).alias("block"), "lang", "source", "size", "terms")
    return made.repartition("block").sortWithinPartitions("block", "lang")


def _lines(size: int, terms: bytes) -> bytes:
    return pa.decompress(terms, size, "zstd", asbytes=True) if size else b""


def block_terms(packed: DataFrame) -> DataFrame:
    """(block, lang, term, df): the documents of each block that hold a term; in several rows if the block's rows are read apart."""

    def told(block: int, lang: str, df: Counter) -> Iterator[pa.RecordBatch]:
        if df:
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(df), pa.int64()), pa.array([lang] * len(df)), pa.array(list(df), pa.binary()), pa.array(list(df.values()), pa.int64())], ["block", "lang", "term", "df"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, df = None, Counter()
        for batch in batches:
            for block, lang, size, terms in zip(*(batch[c] for c in ("block", "lang", "size", "terms"))):
                here = (block.as_py(), lang.as_py())
                if last is not None and here != last:
                    yield from told(*last, df)
                    df = Counter()
                last = here
                for line in _lines(size.as_py(), terms.as_py()).split(b"\n"):
                    df.update(set(line.split()))
        if last is not None:
            yield from told(*last, df)

    return packed.select("block", "lang", "size", "terms").mapInArrow(run, "block long, lang string, term binary, df long")


def occurrences(packed: DataFrame, needed: DataFrame) -> DataFrame:
    """(lang, term, posts): the sources and counts of the needed terms (block, lang, term), from the blocks' rows."""

    def run(terms: pa.Table, rows: pa.Table) -> pa.Table:
        names = [x.decode("utf-8", "surrogateescape") for x in set(terms["term"].to_pylist())]
        found = ahocorasick.Automaton()
        for k, name in enumerate(names):
            found.add_word(f" {name} ", k)
        found.make_automaton()
        langs, sources, out, counts = [], [], [], []
        for lang, source, size, blob in zip(*(rows[c].to_pylist() for c in ("lang", "source", "size", "terms"))):
            text = _lines(size, blob).decode("utf-8", "surrogateescape").replace("\n", " ")
            n = Counter(map(itemgetter(1), found.iter(f" {text} "))) if names else Counter()
            langs += [lang] * len(n)
            sources += [source] * len(n)
            out += [names[k].encode("utf-8", "surrogateescape") for k in n]
            counts += n.values()
        return pa.table({"lang": pa.array(langs, pa.string()), "source": pa.array(sources, pa.string()), "term": pa.array(out, pa.binary()), "count": pa.array(counts, pa.int64())})

    made = needed.groupBy("block", "lang").cogroup(packed.groupBy("block", "lang")).applyInArrow(run, "lang string, source string, term binary, count long")
    # dealt by term, so that neither adding up nor listing deals the rows again; a list has a source once
    whole = made.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("count").alias("count"))
    return whole.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "count")).alias("posts"))


def _part(count: Column, total: Column) -> Column:
    """1 + floor(10**9 * (count + 1) / total) in three steps of a thousand, exact."""
    out, rest = F.lit(1).cast("long"), (count + 1).cast("long")
    for unit in (1_000_000, 1_000, 1):
        out, rest = out + F.call_function("div", rest * 1000, total) * unit, rest * 1000 % total
    return out


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _parts(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same as _part, of arrays."""
    out, rest = np.ones_like(count), count + 1
    for unit in (1_000_000, 1_000, 1):
        out, rest = out + rest * 1000 // total * unit, rest * 1000 % total
    return out


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank for rows with text, lang and source."""
    named = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    packed = written(blocks(named), "blocks", codec="zstd")
    terms = written(block_terms(packed), "terms", codec="zstd")
    documents = F.sum("df").over(Window.partitionBy("lang", "term"))
    needed = terms.withColumn("documents", documents).where(F.col("documents") >= LEAST).select("block", "lang", "term")
    lists = written(occurrences(packed, needed), "lists", codec="zstd")

    # how many terms of a source have each count; totals of each group and lang; `none`: what a group gives a kept term that it doesn't have
    counts = written(lists.select("lang", F.inline("posts")).groupBy("lang", "source", "count").agg(F.count(F.lit(1)).alias("n")), "counts")
    seen = counts.groupBy("lang", "source").agg(F.sum(F.col("count") * F.col("n")).alias("total"), F.sum("n").alias("have"))
    langs = lists.groupBy("lang").agg(F.count(F.lit(1)).alias("kept")).join(seen.groupBy("lang").agg(F.sum("total").alias("lang_total")), "lang")
    groups = packed.select("lang", "source").distinct().join(seen, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "have", "kept", "lang_total"])
    groups = groups.withColumns({"over": F.col("total") + F.col("kept"), "lang_over": F.col("lang_total") + F.col("kept")}).drop("total", "lang_total")
    groups = written(groups.withColumn("none", F.when(F.col("kept") > 0, _part(F.lit(0), F.col("over")))), "totals")
    few = groups.count() <= SENT_GROUPS
    found = written(judged(lists, groups, few), "found")
    ahead = found.where("part = 'term'")
    pairs = pair_values(counts, groups, found.where("part = 'pair'"), F.broadcast if few else lambda df: df)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    columns = ["lang", "source", "part", F.col("item").cast("string").alias("item"), "value", "rank"]
    return ranked(pairs).select(*columns).unionByName(ranked(ahead).where(F.col("rank") <= TERMS).select(*columns))


def judged(lists: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """(lang, source, part, item, value), in parts still: `pair`, what terms that both sources have add to f beyond what each alone makes of them;
    `term`, those that may be among a group's first.  few: whether the groups' totals can be sent."""
    totals: dict[tuple[str, str], tuple[int, int, int]] = {}
    if few:
        totals = {(r.lang, r.source): (r.over, r.none or 0, r.lang_over) for r in groups.select("lang", "source", "over", "none", "lang_over").toLocalIterator()}
    else:
        told = lists.select("lang", "term", F.inline("posts")).join(groups.select("lang", "source", "over", "none", "lang_over"), ["lang", "source"])
        lists = told.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "count", "over", "none", "lang_over")).alias("posts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[tuple[str, str, str]] = Counter()
        best: tuple[list, np.ndarray, np.ndarray, np.ndarray] = ([], *(np.zeros(0, t) for t in (np.int64, np.int64, object)))  # groups, and each term's group, value and bytes
        for batch in batches:
            size = np.diff(np.asarray(batch["posts"].offsets))
            start, of = np.concatenate([[0], np.cumsum(size)])[:-1], np.repeat(np.arange(len(size)), size)
            flat, langs = batch["posts"].flatten(), batch["lang"].dictionary_encode()
            names, lang = flat.field("source").dictionary_encode(), np.asarray(langs.indices).astype(np.int64)
            name, count, many = np.asarray(names.indices).astype(np.int64), np.asarray(flat.field("count")), len(names.dictionary)
            kinds, kind = np.unique(lang[of] * many + name, return_inverse=True)
            group = [(langs.dictionary[k // many].as_py(), names.dictionary[k % many].as_py()) for k in kinds.tolist()]
            if few:
                over, none, lang_over = np.array([totals[g] for g in group], np.int64).reshape(-1, 3)[kind].T
            else:
                over, none, lang_over = (np.asarray(flat.field(c)) for c in ("over", "none", "lang_over"))
            p = _parts(count, over)
            q = _parts(np.add.reduceat(count, start) if len(size) else count, lang_over[start])[of]
            ahead = np.flatnonzero(p > q)
            at = {g: k for k, g in enumerate(best[0])}
            for g in group:
                at.setdefault(g, len(at))
            own = np.array([at[g] for g in group], np.int64)[kind[ahead]]
            terms = np.array(batch["term"].to_pylist(), object)[of[ahead]]
            best = (list(at), *_first(np.concatenate([best[1], own]), np.concatenate([best[2], (p[ahead] - q[ahead]) ** 2 // q[ahead]]), np.concatenate([best[3], terms])))
            for k in np.unique(size[size > 1]):
                rows = np.flatnonzero(size == k)
                for part, some in ((f, i) for f in np.array_split(rows, 1 + len(rows) * k * k // PAIRS) for i in np.array_split(np.arange(k), 1 + len(f) * k * k // PAIRS)):
                    here = start[part][:, None] + np.arange(k)
                    one = lambda x: x[here[:, some]][:, :, None]  # noqa: B023, E731
                    two = lambda x: x[here][:, None, :]  # noqa: B023, E731
                    a, b, a0, b0 = one(p), two(p), one(none), two(none)
                    v = (a - b) ** 2 // b - (a - b0) ** 2 // b0 - (a0 - b) ** 2 // b + (a0 - b0) ** 2 // b0
                    other = np.broadcast_to(some[:, None] != np.arange(k), v.shape)
                    keys, of_key = np.unique((one(kind) * len(kinds) + two(kind))[other], return_inverse=True)
                    total = np.zeros(len(keys), np.int64)
                    np.add.at(total, of_key, v[other])
                    for key, add in zip(keys.tolist(), total.tolist()):
                        s, t = group[key // len(kinds)], group[key % len(kinds)]
                        sums[s[0], s[1], t[1]] += add
            if len(sums) > PAIRS:
                yield told_pairs(sums)
                sums = Counter()
        if sums:
            yield told_pairs(sums)
        if len(best[1]):
            lang, source = zip(*(best[0][k] for k in best[1].tolist()))
            yield rows_of(lang, source, "term", best[3].tolist(), best[2])

    def told_pairs(sums: Counter) -> pa.RecordBatch:
        lang, s, t = zip(*sums)
        return rows_of(lang, s, "pair", [x.encode("utf-8", "surrogateescape") for x in t], list(sums.values()))

    def rows_of(lang, source, part, item, value) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array([part] * len(lang)), pa.array(item, pa.binary()), pa.array(value, pa.int64())], ["lang", "source", "part", "item", "value"])

    return lists.select("lang", "term", "posts").mapInArrow(run, "lang string, source string, part string, item binary, value long")


def _first(group: np.ndarray, value: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each group the TERMS largest values and those that tie with the last of them."""
    order = np.lexsort((-value, group))
    g, v = group[order], value[order]
    begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, int)
    size = np.diff(np.append(begin, len(g)))
    least = v[begin + np.minimum(size, TERMS) - 1]
    keep = order[v >= np.repeat(least, size)]
    return group[keep], value[keep], term[keep]


def pair_values(counts: DataFrame, groups: DataFrame, both: DataFrame, sent) -> DataFrame:
    """(lang, source, part, item, value): for each group and other source of its lang the sum of f over all kept terms."""
    none = lambda side: sent(groups.select("lang", F.col("source").alias(side), F.col("none").alias(f"{side}0"), F.col("have").alias(f"{side}_have")))
    ps, pt, s0, t0 = (F.col(c) for c in ("ps", "pt", "s0", "t0"))
    # terms that one has, by their counts
    many = counts.join(sent(groups.select("lang", "source", "over")), ["lang", "source"]).withColumn("p", _part(F.col("count"), F.col("over")))
    mine = many.select("lang", F.col("source").alias("s"), F.col("p").alias("ps"), "n").join(none("t"), "lang").where("s <> t")
    mine = mine.groupBy("lang", "s", "t").agg(F.sum(_f(ps, t0) * F.col("n")).alias("v"))
    other = many.select("lang", F.col("source").alias("t"), F.col("p").alias("pt"), "n").join(none("s"), "lang").where("s <> t")
    other = other.groupBy("lang", "s", "t").agg(F.sum(_f(s0, pt) * F.col("n")).alias("v"))
    # those that none has, and those that both have
    rest = none("s").join(none("t"), "lang").where("s <> t").join(sent(groups.select("lang", F.col("source").alias("s"), "kept")), ["lang", "s"])
    rest = rest.select("lang", "s", "t", F.coalesce(_f(s0, t0) * (F.col("kept") - F.col("s_have") - F.col("t_have")), F.lit(0).cast("long")).alias("v"))
    both = both.select("lang", F.col("source").alias("s"), F.col("item").cast("string").alias("t"), F.col("value").alias("v"))
    every = rest.unionByName(both).unionByName(mine).unionByName(other)
    return every.groupBy("lang", "s", "t").agg(F.sum("v").alias("value")).select("lang", F.col("s").alias("source"), F.lit("pair").alias("part"), F.col("t").alias("item"), "value")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents", "lang", "source", "text"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT row_no, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT row_no) >= 3),
posts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
size AS (SELECT g.lang, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang FROM d) g LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY lang) USING (lang)),
groups AS (SELECT g.lang, g.source, v, coalesce(n, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) g JOIN size USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM posts GROUP BY lang, source) USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (total + v)::HUGEINT AS p
      FROM groups g JOIN kept k USING (lang) LEFT JOIN posts o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)::HUGEINT) // (any_value(total) + any_value(v))::HUGEINT AS q
      FROM posts JOIN (SELECT lang, sum(total) AS total, any_value(v) AS v FROM groups GROUP BY lang) USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
          ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
           UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
