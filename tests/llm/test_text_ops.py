"""Quality, mixing, scoring, toxicity, language, sharding: brute force or held-out accuracy."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwarden.llm import language, mixing, quality, scoring, sharding, toxicity
from siftwarden.llm.common import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.01"
here = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables aren't here")
SCHEMA = "doc_id long, text string, source string, lang string, size long, n_words string, tie string, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, None, -1, "x", "y", "z") for i, t, s in rows], SCHEMA)


def odd_rows():
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(60)] + ["é!", "#$%", "<b>"]
    rows = [(i, "".join(rng.choice(vocab) + rng.choice([" ", "  ", "\n", "\t", "\n\n"]) for _ in range(rng.randint(0, 90))), rng.choice(["a", "b", None, "B"])) for i in range(60)]
    return rows + [(60, None, "a"), (61, "", "a"), (62, " \n", None), (63, "x" * 30_000, "b"), (64, "same words here " * 900, "b"), (65, "same words here " * 900, "b"), (None, "null id has words too", "a"), (1, "repeated id with another text", "a")]


def test_quality_base_columns(spark):
    rows = odd_rows()
    out = quality.base_columns(table(spark, rows).drop("n_words")).collect()
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    want = collections.Counter()
    for i, t, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        runs = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        many = collections.Counter(runs)
        covered = {k + j for k, r in enumerate(runs) if many[r] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        n = len(covered)
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), n, len(w) < 10 or 100 * n > 20 * len(w)] += 1
    assert got == want


def test_quality_ratio_against_brute_force(spark):
    docs = table(spark, odd_rows())
    trusted = docs.where("doc_id < 20").select("doc_id")
    n = 50
    ratios = quality.log_ratios(docs, trusted, n)
    grams = {(r.doc_id, r.text): list(r._tokens) + list(r._pairs) for r in quality.hashed(docs).collect()}
    raw, good = collections.Counter(), collections.Counter()
    for r in docs.collect():
        raw.update(h % n for h in grams[r.doc_id, r.text])
        if r.doc_id is not None and r.doc_id < 20:
            good.update(h % n for h in grams[r.doc_id, r.text])
    a, b = sum(good.values()) + quality.PRIOR, sum(raw.values())
    want = [math.log((good[k] + quality.PRIOR * raw[k] / b) / a) - math.log(raw[k] / b) if raw[k] else 0.0 for k in range(n)]
    assert np.allclose(ratios, want)
    for r in quality.with_ratio(docs, ratios).collect():
        g = grams[r.doc_id, r.text]
        assert math.isclose(r.llr, sum(want[h % n] for h in g) / len(g) if g else 0.0, abs_tol=1e-9)


def test_quality_of_odd_tables(spark):
    assert quality.judge(table(spark, []), spark.createDataFrame([], "doc_id long")).count() == 0
    out = quality.judge(table(spark, odd_rows()), spark.createDataFrame([], "doc_id long"))
    assert {r.llr for r in out.collect()} == {0.0}


def test_quality_keeps_extra_columns(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b", "x", "y", 3), (None, None, None, "z", 4)], "doc_id long, text string, _words string, kept string, _good int")
    got = []
    for sent in (0, 10):
        monkeypatch.setattr(quality, "SENT_IDS", sent)
        out = quality.judge(docs, spark.createDataFrame([(1,), (1,), (None,)], "doc_id long"))
        assert out.columns == ["doc_id", "text", "_words", "_good", *quality.RESULTS]
        got.append(sorted(map(str, out.collect())))
    assert got[0] == got[1] and "_words='x'" in got[0][0]


@here
@pytest.mark.parametrize("trusted", [3, 30, 10_000])
def test_quality_leaves_clean_texts_alone_whatever_is_trusted(spark, trusted):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id").distinct().orderBy("doc_id")
    out = written(quality.judge(docs, good.limit(trusted)), "judged").join(good, "doc_id").where("not base_failed")
    assert out.agg(F.avg(F.col("kept").cast("int"))).first()[0] > 0.99


@here
def test_quality_tells_junk(spark):
    q = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {0: [], 1: []}
    for r in quality.op2_quality(spark, SF).collect():
        if r.doc_id in q and not r.base_failed:
            kept[q[r.doc_id]].append(r.kept)
    assert all(kept[1]) and np.mean(kept[0]) < 0.1


# --- mixing


def expected_targets(size):
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in size)
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, capped = sum(size.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 3.0 * size[s] for s in free if share[s] > 3 * size[s]}
        if not over:
            return capped | share
        capped |= over


def test_targets_against_iteration(spark):
    rng = random.Random(8)
    for n in (1, 2, 5, 9):
        size = {("s" + chr(96 + k) if k else None): rng.choice([0, 1, 10, 1000, 50_000]) for k in range(n)}
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(size.items()), "source string, size long")).collect()}
        want = expected_targets(size) if sum(size.values()) else dict.fromkeys(size, 0.0)
        assert all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in size)


def test_mixing_keeps_totals_and_expectations(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.choice([1, 3, 10, 60]), rng.choice(["a", "b", "c", None])) for i in range(600)] + [(None, "w w", "a"), (5, "w", "b"), (700, None, "a")]
    df = table(spark, rows)
    out = mixing.taken_words(df, block=4).collect()
    assert len(out) == len(rows)
    by = collections.defaultdict(list)
    for r in out:
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
        by[r.target, r.source_size].append(r)
    for (target, source_size), docs in by.items():
        assert sum(r.size for r in docs) == source_size
        assert abs(sum(r.taken for r in docs) - target) < max(r.size for r in docs)
        low = math.floor(target / source_size + 1e-9)
        assert {r.copies for r in docs if r.size} <= {low, low + 1}
    again = mixing.taken_words(df, block=4).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_mixing_of_rows_alike(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ALIKE", 100)
    rows = [(None, "w w w", "a")] * 3000 + [(k, "w w", "b") for k in range(100)] + [(7, "w w", "b")] * 50
    slim = mixing.numbered(table(spark, rows).select("doc_id", "source", F.lit(1).alias("size")))
    assert collections.Counter((r.doc_id, r.source) for r in slim.collect()) == collections.Counter((i, s) for i, _, s in rows)
    assert slim.select("doc_id", "source", "nth").distinct().count() == len(rows)
    out = mixing.taken_words(table(spark, rows)).collect()
    want = expected_targets({"a": 9000, "b": 300})
    got = collections.Counter()
    for r in out:
        got["a" if r.size == 3 else "b"] += r.taken
    assert len(out) == len(rows) and all(abs(got[s] - want[s]) < 3 for s in want)
    orders = [sorted(map(str, mixing.taken_words(table(spark, rows).repartition(n)).collect())) for n in (1, 3)]
    assert orders[0] == orders[1] == sorted(map(str, out))


def test_mixing_gives_every_document_its_expectation(spark, monkeypatch):
    """Over seeds, documents of any size are taken as often as their source's target asks, within four standard errors."""
    rng = random.Random(10)
    rows = [(i, "w " * rng.choice([1, 2, 7, 40]), rng.choice("abc")) for i in range(900)]
    taken, seeds = collections.defaultdict(list), 6
    for seed in range(seeds):
        monkeypatch.setattr(mixing, "SEED", 100 + seed)
        for r in mixing.taken_words(table(spark, rows), block=4).collect():
            taken[r.size, r.source_size, r.target].append(r.copies)
    assert len(taken) == 12
    for (_, source_size, target), copies in taken.items():
        want = target / source_size
        error = math.sqrt((want % 1) * (1 - want % 1) / len(copies))
        assert abs(np.mean(copies) - want) < 4 * error + 1e-9


def test_mixing_of_small_sources_comes_near(spark):
    """Sources of 50 documents of very unlike sizes end within 2% of their targets, or nearer than their smallest document."""
    rng = random.Random(19)
    rows = [(i, "w " * min(9_000, int(rng.paretovariate(0.7) * 20)), f"s{i % 12:02}") for i in range(600)]
    by = collections.defaultdict(list)
    for r in mixing.taken_words(table(spark, rows)).collect():
        by[r.source_no, r.target, r.source_size].append(r)
    assert len(by) == 12
    for (_, target, source_size), docs in by.items():
        assert abs(sum(r.taken for r in docs) - target) <= max(0.02 * target, min(r.size for r in docs))
        low = math.floor(target / source_size + 1e-9)
        assert {r.copies for r in docs} <= {low, low + 1}


@here
def test_mixing_of_the_given_tables_comes_near(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.coalesce("source", F.lit("")))
    by = collections.defaultdict(list)
    for r in mixing.op4_mixing(spark, SF).join(docs.select("doc_id", "source"), "doc_id").collect():
        by[r.source, r.target].append(r)
    for (_, target), rows in by.items():
        assert abs(sum(r.taken for r in rows) - target) <= max(0.02 * target, min(r.size for r in rows))


def test_mixing_of_empty_table(spark):
    assert mixing.taken_words(table(spark, [])).count() == 0


# --- scoring


def test_scoring_base_against_brute_force(spark):
    rows = odd_rows()
    docs = table(spark, rows)
    train = docs.where("doc_id % 3 <> 0")
    for frequent in (0, 7, 10_000):
        model, rare = scoring.fit(train, frequent=frequent)
        words = lambda t: WORD.findall((t or "").translate(FOLD)) + ["</s>"]
        c = collections.Counter(w for i, t, _ in rows if i is not None and i % 3 for w in words(t))
        n, v = sum(c.values()), len(c)
        assert (model.tokens, model.distinct) == (n, v)
        got = collections.Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in scoring.score(docs, model, rare).collect())
        want = collections.Counter((i, len(words(t)), sum(w in c for w in words(t)), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for i, t, _ in rows)
        assert got == want


def test_scoring_base_of_words_beyond_exact(spark):
    c = collections.Counter({"a": scoring.EXACT + 3, "b": scoring.EXACT + 2, "c": scoring.EXACT + 1, "d": 2, "</s>": 2})
    docs = table(spark, [(1, "a " * c["a"] + "b " * c["b"] + "c " * c["c"] + "d d", "s"), (2, "", "s")]).select("doc_id", "text")
    asked = table(spark, [(3, "a b c d x", "s")]).select("doc_id", "text")
    n, v = sum(c.values()), len(c)
    want = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ["a", "b", "c", "d", "x", "</s>"])
    for frequent in (0, 1, 2, 3, 10):
        model, rare = scoring.fit(docs, frequent=frequent)
        assert len(model.frequent[0]) == min(frequent, v)
        r = scoring.score(asked, model, rare).first()
        assert r.n_known == 5 and abs(r.base_score - want) < 1e-6


def test_filter_gives_levels_back():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 1 << 62, 20_000).astype(np.uint64)
    level = rng.integers(1, 9, len(h))
    h >>= np.uint64(14)
    order = np.argsort(h)
    h, level = h[order], level[order]
    cut = np.searchsorted(scoring.range_of(h, 3), [0, 1, 2, 3])
    parts = [np.frombuffer(scoring.Filter.segment(h[a:b], level[a:b]), np.uint64) for a, b in zip(cut[:-1], cut[1:])]
    f = scoring.Filter(3, np.concatenate(parts), np.cumsum([0, *map(len, parts)]))
    got = f.level(h)
    assert (got >= level).all() and (got == level).mean() > 0.98
    assert (f.level(rng.integers(0, 1 << 48, 20_000).astype(np.uint64)) == 0).mean() > 0.98
    most = rng.integers(0, 5, len(h))
    assert (f.level(h, most) == np.minimum(got, most)).all()


def test_model_is_a_distribution_about_its_filter(spark):
    docs = table(spark, [(i, "a b a c a b d", "s") for i in range(50)])
    model, _ = scoring.fit(docs)
    assert model.texts == 50 and model.tokens == 400
    out = scoring.score(docs.select("doc_id", "text"), model, spark.createDataFrame([], "h long, n long")).first()
    assert out.base_score < out.score <= 0


def test_scoring_of_odd_tables(spark):
    none = table(spark, []).select("doc_id", "text")
    model, rare = scoring.fit(none)
    assert scoring.score(none, model, rare).count() == 0
    r = scoring.score(table(spark, [(1, None, "a")]).select("doc_id", "text"), model, rare).first()
    assert (r.n_tokens, r.n_known, r.base_score, r.score) == (1, 0, 0.0, 0.0)


def test_scoring_holds_all_bigrams_whatever_the_filter(spark, monkeypatch):
    monkeypatch.setattr(scoring, "RANGE_BYTES", 1 << 18)
    monkeypatch.setattr(scoring, "RUN_BYTES", 1 << 17)
    rows = odd_rows() + [(70 + k, f"only{k} here{k} once{k} " + " ".join(f"{k}-{i}" for i in range(150)), "s") for k in range(2_000)]
    docs = table(spark, rows).select("doc_id", "text")
    got = []
    for size in (scoring.FILTER_BYTES, 1 << 10):
        model, rare = scoring.fit(docs.where("doc_id is not null"), filter_bytes=size, frequent=7)
        assert (model.apart is None) == (size == scoring.FILTER_BYTES) and model.ranges > 3
        got.append(collections.Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in scoring.score(docs, model, rare).collect()))
    assert got[0] == got[1] and sum(got[0].values()) == len(rows)
    model, rare = scoring.fit(docs.where("doc_id is not null"))
    assert scoring.score(docs.limit(0), model, rare).count() == 0


def test_packed_values_come_back():
    rng = np.random.default_rng(6)
    for n, top in ((1, 10), (5, 1 << 63), (1_000, 1 << 20), (1_000, 1 << 45), (3, 1 << 33)):
        v = np.unique(rng.integers(0, top, n).astype(np.uint64))
        assert np.array_equal(scoring._unpack(memoryview(scoring._pack(v))), v)


def test_scoring_passes_few_values_for_many_ranges():
    """Each run of texts passes a value for each part on; at 6 GB there are some 4,200 ranges."""
    codes = np.unique(np.random.default_rng(7).integers(0, 1 << 48, 50_000).astype(np.uint64))
    for ranges, most in ((1, 1), (364, 364), (1_023, 1_023), (4_400, 550), (22_000, 2_750)):
        wide = scoring._wide(ranges)
        parts, at = scoring._cuts(codes, ranges, wide)
        assert len(parts) <= most
        assert np.array_equal(np.repeat(parts, np.diff(at)), scoring.range_of(codes, ranges) // wide)
        values, n = scoring._unpack(scoring._pack(codes, at))
        assert np.array_equal(values, codes) and np.array_equal(n, np.diff(at))


def test_many_packed_values_come_back():
    rng = np.random.default_rng(8)
    for top in (1 << 20, 1 << 40, 1 << 63):
        v = np.unique(rng.integers(0, top, 300).astype(np.uint64))
        at = np.array([0, 1, 2, 100, len(v)])
        column = scoring._pack(v, at)
        for a, b in ((0, 4), (1, 3), (3, 4)):
            values, n = scoring._unpack(column[a:b])
            assert np.array_equal(values, v[at[a] : at[b]]) and np.array_equal(n, np.diff(at)[a:b])
        assert [scoring._unpack(memoryview(x.as_py())).tolist() for x in column] == [v[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


def test_scoring_codes_that_differ_in_their_lowest_bits():
    """With many codes only the upper bits are sorted with their places."""
    tokens = np.arange(300_000, dtype=np.uint64) % np.uint64(1_000) << np.uint64(16)  # codes 0, 4, 8 and so on
    pairs, triples = tokens + np.uint64(1), tokens + np.uint64(2)
    tokens, pairs, triples = tokens, scoring.code(pairs, 1), scoring.code(triples, 2)
    codes, back = scoring._coded([(0, 1, tokens, pairs, triples, np.zeros(1, np.int64))])
    want = [scoring.code(tokens, 0), pairs, triples]
    assert np.array_equal(codes, np.unique(np.concatenate(want)))
    (got,) = back((codes % np.uint64(251)).astype(np.uint8))
    assert all(np.array_equal(a, b % np.uint64(251)) for a, b in zip(got, want))


def test_scoring_by_parts_of_many_ranges(spark, monkeypatch):
    docs = table(spark, odd_rows() + [(70 + k, f"only{k} here{k} " + " ".join(f"{k}-{i}" for i in range(150)) + " of it" * 300, "s") for k in range(300)]).select("doc_id", "text")
    monkeypatch.setattr(scoring, "RANGE_BYTES", 1 << 14)
    monkeypatch.setattr(scoring, "RUN_BYTES", 1 << 15)
    got = []
    for parts, size in ((1 << 30, scoring.FILTER_BYTES), (1 << 30, 1 << 10), (5, scoring.FILTER_BYTES), (5, 1 << 10)):
        monkeypatch.setattr(scoring, "PARTS", parts)
        model, rare = scoring.fit(docs.where("doc_id is not null"), filter_bytes=size, frequent=7)
        assert scoring._wide(model.ranges) == (scoring.WIDEST if parts == 5 else 1) and (model.apart is None) == (size == scoring.FILTER_BYTES)
        got.append(collections.Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in scoring.score(docs, model, rare).collect()))
    assert got[0] == got[1] == got[2] == got[3]


def test_score_against_plain_dictionaries(spark):
    """The same model with exact sets in place of the filter, whose errors are the only difference."""
    rng = random.Random(12)
    rows = odd_rows() + [(100 + k, " ".join(f"t{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randint(1, 60))), "a") for k in range(150)]
    c = collections.Counter()
    mark = lambda t: ["<s>"] + WORD.findall((t or "").translate(FOLD)) + ["</s>"]
    for i, t, _ in rows:
        if i is not None and i % 3:
            w = mark(t)
            c.update((x,) for x in w)
            c.update(zip(w, w[1:]))
            c.update(zip(w, w[1:], w[2:]))
    low = lambda *k: max((e for e in scoring.EDGES if e <= c[k]), default=0.0)
    high = lambda *k: min(e for e in scoring.EDGES if e > c[k]) - 1 if c[k] else 0.0
    words = [k for k in c if len(k) == 1 and k != ("<s>",)]
    total = sum(low(*k) for k in words) + len(words) + 1
    back = lambda num, den, p: scoring.WEIGHT * min(max(num - scoring.DISCOUNT, 0) / den, 1) + (1 - scoring.WEIGHT) * p if den else p

    def plain(t):
        w, out = mark(t), 0.0
        for k in range(1, len(w)):
            p = (low(w[k]) + 1) / total
            p = back(low(*w[k - 1 : k + 1]), c["<s>",] if k == 1 else high(w[k - 1]), p)
            p = back(low(*w[k - 2 : k + 1]), high(*w[k - 2 : k]), p) if k > 1 else p
            out += math.log10(p)
        return out

    docs = table(spark, rows)
    model, rare = scoring.fit(docs.where("doc_id % 3 <> 0"))
    want = collections.defaultdict(list)
    for i, t, _ in rows:
        want[i].append(plain(t))
    near, same = 0, 0
    for r in scoring.score(docs, model, rare).collect():
        gap = min(abs(r.score - x) for x in want[r.doc_id])
        same += gap < 1e-6
        near += gap <= 0.1 + 0.02 * abs(r.score)
    assert near > 0.95 * len(rows) and same > 0.5 * len(rows)


def test_scoring_keeps_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 5, 7.0)], "doc_id long, text string, _uid string, h int, score double")
    model, rare = scoring.fit(docs, frequent=0)
    out = scoring.score(docs, model, rare)
    assert out.columns == ["doc_id", "_uid", "h", *scoring.RESULTS]
    r = out.first()
    assert (r._uid, r.h, r.n_tokens) == ("x", 5, 3) and r.score < 0


@here
def test_model_beats_base(spark):
    t = scoring.op6_scoring(spark, SF).groupBy("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).collect()
    assert len(t) == 2 and all(r.s > r.b for r in t)


# --- toxicity


def toxic_rows(n, seed):
    rng = random.Random(seed)
    good = ["sun", "tree", "river", "stone", "walk", "blue", "house", "garden"]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(good) + rng.choice(["", "ing", "er", "s"]) for _ in range(rng.randint(5, 150))]
        bad = i % 4 == 0
        for _ in range(1 + len(w) // 40 if bad else 0):
            w.insert(rng.randint(0, len(w)), rng.choice(["zorgle" + rng.choice(["x", "qua", "tt", "o"]), "Blarn!"]))
        rows.append(" ".join(w))
        labels.append(int(bad))
    return rows, np.array(labels)


def test_gradients_are_derivatives():
    texts, label = toxic_rows(6, 1)
    net = toxicity.Network(0.1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    t = toxicity._tokens(texts)
    _, first, length = t.windows()
    text = t.windows()[0]
    y = label[text].astype(np.float64)
    loss = lambda: net.gradients(t, first, length, y)[0]
    _, g = net.gradients(t, first, length, y)
    for name in ("in", "fwd", "bwd", "att", "out", "in_b"):
        where = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        step = 1e-2
        net.p[name][where] += step
        up = loss()
        net.p[name][where] -= 2 * step
        down = loss()
        net.p[name][where] += step
        assert math.isclose((up - down) / (2 * step), float(g[name][where]), rel_tol=0.08), name


def plain_logit(net, text):
    """The network on one text in scalar loops: its largest window's logit."""
    p, hid = {k: v.astype(float) for k, v in net.p.items()}, toxicity.HIDDEN
    sig = lambda x: 1 / (1 + math.exp(-x))
    t = toxicity._tokens([text])
    grams = collections.defaultdict(list)
    for g, k in zip(t.gram, t.gram_of):
        grams[k].append(p["char"][g])
    inputs = [np.concatenate([p["word"][t.word[k]], sum(grams[k]) / len(grams[k])]) for k in t.kind]

    def direction(xs, name, off):
        h, out = [0.0] * hid, []
        for x in xs:
            a = [sum(x[i] * p["in"][i, off + c] for i in range(len(x))) + p["in_b"][off + c] for c in range(3 * hid)]
            b = [sum(h[i] * p[name][i, c] for i in range(hid)) for c in range(3 * hid)]
            new = []
            for c in range(hid):
                z, r = sig(a[c] + b[c]), sig(a[hid + c] + b[hid + c])
                n = math.tanh(a[2 * hid + c] + r * b[2 * hid + c])
                new.append(n + z * (h[c] - n))
            h = new
            out.append(h)
        return out

    best, n, k = -math.inf, len(inputs), 0
    while True:
        xs = inputs[k : k + toxicity.WINDOW]
        fwd, bwd = direction(xs, "fwd", 0), direction(xs[::-1], "bwd", 3 * hid)[::-1]
        states = [f + b for f, b in zip(fwd, bwd)]
        e = [math.exp(sum(a * s for a, s in zip(p["att"], st))) for st in states]
        pooled = [sum(w * st[c] for w, st in zip(e, states)) / sum(e) for c in range(2 * hid)]
        best = max(best, sum(o * v for o, v in zip(p["out"], pooled)) + p["out_b"][0])
        if k + toxicity.WINDOW >= n:
            return best
        k += toxicity.STEP


def test_forward_pass_against_scalar_loops():
    texts, label = toxic_rows(40, 4)
    net = toxicity.train(texts, label, 0.25)
    some = ["one", "two words", " ".join(texts[:3]), texts[4] + " zorglex", "é" * 5 + " a b"]
    got = net.logits(toxicity._tokens(some))[0]
    assert np.allclose(got, [plain_logit(net, x) for x in some], atol=1e-3)


def test_training_texts_are_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "TRAIN_SUM", 3_000)
    monkeypatch.setattr(toxicity, "train", lambda texts, label, rate: seen.append(texts))
    docs = table(spark, [(i, "w " * 50, "s") for i in range(300)])
    toxicity.learn(docs, spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int"))
    assert 10 < len(seen[0]) < 60


def test_toxicity_keeps_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 7.0)], "doc_id long, text string, _drawn string, score double")
    out = toxicity.scored(docs, (None, 0.2))
    assert out.columns == docs.columns and (out.first()._drawn, out.first().score) == ("x", 0.2)


def test_windows_cover_every_token():
    texts = ["", "a", "b " * 47, "c " * 48, "d " * 49, "e " * 500, "!!!"]
    t = toxicity._tokens(texts)
    text, first, length = t.windows()
    for k, x in enumerate(texts):
        n = len(x.split()) if x != "!!!" else 0
        own = [(a - t.of[k], b) for a, b in zip(first[text == k], length[text == k])]
        assert {j for a, b in own for j in range(a, a + b)} == set(range(n))
        assert all(b <= toxicity.WINDOW for _, b in own)


def test_toxicity_on_held_out_texts(spark):
    texts, label = toxic_rows(400, 2)
    docs = table(spark, [(i, x, "s") for i, x in enumerate(texts)])
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(label.tolist()) if i % 5] + [(None, 1), (3, None)], "doc_id long, toxic int")
    more = docs.unionByName(table(spark, [(900, None, "s"), (901, "", "s"), (902, "a" * 100_000, "s"), (903, " ".join(["sun"] * 3000 + ["blarn"] + ["tree"] * 3000), "s"), (None, "sun", "s")]))
    out = {r.doc_id: r.score for r in toxicity.scored(more, toxicity.learn(docs, labels)).collect()}
    held = [i for i in range(400) if i % 5 == 0]
    assert np.mean([(out[i] >= 0.5) == label[i] for i in held]) > 0.95
    assert out[900] == out[901] < 0.5 and 0 <= out[902] <= 1
    assert out[903] >= 0.5  # one word in the midst of a long text


def test_toxicity_without_labels(spark):
    docs = table(spark, [(1, "a", "s"), (2, None, "s")])
    out = toxicity.scored(docs, toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int")))
    assert {r.score for r in out.collect()} == {0.0}
    assert toxicity.scored(docs.limit(0), (None, 0.0)).count() == 0


# --- language


def plain_vector(text, dim):
    a, b, c = language.letter_vectors(dim)
    s = [0]
    for ch in text:
        x = int(language._symbols()[ord(ch)])
        if x or s[-1]:
            s.append(x)
    s = s + [0] if s[-1] else s
    return sum((a[x].astype(int) * b[y] * c[z] for x, y, z in zip(s, s[1:], s[2:])), np.zeros(dim, int))


def test_vectors_against_a_loop():
    for text in ("Hello, Wörld", "a", "it's  2 é", "ñandú\nÉtude"):
        assert np.array_equal(language.vector(text, language.letter_vectors(64)).astype(int), plain_vector(text, 64))
    assert language.vector("123 !", language.letter_vectors(64)) is None


@here
def test_language_on_held_out_texts(spark):
    out = language.op9_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    assert out.where("score < 0 or score > 1").count() == 0


def test_language_accuracy_rises_with_dimension():
    """Held-out texts of four made languages by the number of coordinates; DIM has reached what more of them give."""
    rng = random.Random(14)
    langs = {k: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 7))) for _ in range(60)] for k in range(4)}
    text = lambda k: " ".join(rng.choice(langs[k] if rng.random() < 0.7 else langs[(k + 1) % 4]) for _ in range(12))
    train, test = [(k, text(k)) for k in range(4) for _ in range(30)], [(k, text(k)) for k in range(4) for _ in range(50)]
    right = {}
    for dim in (8, 64, language.DIM, 2 * language.DIM):
        letters = language.letter_vectors(dim)
        unit = lambda v: v / np.linalg.norm(v)
        own = np.array([sum(unit(language.vector(t, letters)) for k, t in train if k == lang) for lang in range(4)])
        own = np.array([unit(x) for x in own])
        own = own - own.mean(axis=0)
        right[dim] = np.mean([np.argmax([unit(o) @ language.vector(t, letters) for o in own]) == k for k, t in test])
    assert right[8] < right[64] < right[language.DIM] and right[language.DIM] > right[2 * language.DIM] - 0.02 and right[language.DIM] > 0.95, right


def test_language_keeps_extra_columns_and_bounds_languages(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the cat", "en", "x", 1), (2, "a dog the", "en", "y", 2), (3, "le chat", "fr", "z", 3)], "doc_id long, text string, lang string, _told string, score int")
    monkeypatch.setattr(language, "LANGUAGES", 1)
    model = language.learn(docs)
    assert list(model) == ["en"]
    out = language.predict(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "_told", "lang_pred", "score"]
    assert {(r.doc_id, r._told, r.lang_pred) for r in out.collect()} == {(1, "x", "en"), (2, "y", "en"), (3, "z", "en")}


def test_language_of_odd_tables(spark):
    rows = [(1, "the cat", None), (2, "123", None), (3, None, None), (4, "", None), (None, "le chat", None)]
    docs = table(spark, rows)
    assert {r.lang_pred for r in language.predict(docs, language.learn(docs)).collect()} == {"und"}
    model = {"en": plain_vector("the cat sat on the mat", language.DIM) / 50.0, "fr": plain_vector("le chat dort sur la table", language.DIM) / 50.0}
    got = {r.doc_id: r.lang_pred for r in language.predict(docs, model).collect()}
    assert got == {1: "en", 2: "und", 3: "und", 4: "und", None: "fr"}
    assert language.predict(docs.limit(0), model).count() == 0


# --- sharding


def plain_pack(vectors, shards, weights):
    """The same packing in plain loops."""
    total = [sum(v[k] for v in vectors) or 1 for k in range(3)]
    share = [[v[k] / total[k] * shards for k in range(3)] for v in vectors]
    left, out = [[1.0] * 3 for _ in range(shards)], [0] * len(vectors)
    norm = lambda v: sum(w * x * x for w, x in zip(weights, v))
    for k in sorted(range(len(vectors)), key=lambda k: (-norm(share[k]), k)):
        dots = [sum(w * a * b for w, a, b in zip(weights, left[j], share[k])) for j in range(shards)]
        out[k] = dots.index(max(dots))
        left[out[k]] = [a - b for a, b in zip(left[out[k]], share[k])]
    return out


def test_pack_against_plain_loops():
    rng = np.random.default_rng(4)
    for n, shards in ((0, 3), (1, 3), (7, 3), (200, 5), (400, 40)):
        v = np.stack([rng.integers(1, 10_000, n), rng.integers(0, 2_000, n), rng.integers(1, 50, n)], 1).astype(float)
        assert sharding.pack(v, shards).tolist() == plain_pack(v.tolist(), shards, sharding.WEIGHTS)


@pytest.mark.parametrize("doc_id", [None, 7])
def test_sharding_of_one_text_in_bulk(spark, monkeypatch, doc_id):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 10)
    rows = [(doc_id, "one text in bulk", "s")] * 2000 + [(i, f"text {i}", "s") for i in range(1500)] + [(9_999, "x" * 5_000, "s")]
    out = sharding.assign(table(spark, rows)).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    assert len(out) == len(rows) and set(by) == set(range(40))
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    # one text is larger than a shard's share: its shard holds little else, all others are alike
    total = [sum(r.size for r in v) for v in by.values()]
    assert sorted(total)[-1] < 5_016 + 0.2 * sum(total) / 40 and sorted(total)[-2] < 1.1 * min(total)


@pytest.mark.parametrize("n", [400, 3000])
def test_shards_are_alike_in_bytes_and_small_groups_whole(spark, n):
    """Sizes of very unlike documents, and groups of equal ones below a shard's share: all shards count."""
    rng = random.Random(n)
    rows = [(i, "w" * min(n * 60, int(rng.paretovariate(0.8) * 100)), "s") for i in range(n)]
    rows += [(n + i, f"group {i % 60} " * (1 + i % 60), "s") for i in range(n // 4)]
    by, shards = collections.Counter(), collections.defaultdict(set)
    for r in sharding.assign(table(spark, rows)).collect():
        by[r.shard] += r.size
        shards[r.text].add(r.shard)
    mean, largest = sum(by.values()) / 40, max(len(t) for _, t, _ in rows) + 16
    assert len(by) == 40 and max(by.values()) < max(1.03 * mean, largest + 0.1 * mean)
    if largest < mean:
        assert min(by.values()) > 0.97 * mean
    groups, tokens = collections.Counter(t for _, t, _ in rows), sum(len(t.split()) for _, t, _ in rows) / 40
    small = [t for t, many in groups.items() if (len(t) + 16) * many < mean and len(t.split()) * many < tokens and many < len(rows) / 40]
    assert all(len(shards[t]) == 1 for t in small) and sum(groups[t] > 1 for t in small) > 20


@here
def test_shards_of_the_given_tables_are_alike(spark):
    for scale, most in (("sf0.01", 1.03), ("sf0.1", 1.01)):
        path = SF.replace(SF.rpartition("/")[2], scale)
        size = [r.b for r in sharding.op10_sharding(spark, path).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
        assert len(size) == 40 and max(size) < most * sum(size) / 40 and min(size) > sum(size) / 40 / most


def test_sharding_keeps_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a", 5, "x", "y"), (2, "b", 6, "z", None)], "doc_id long, text string, size int, _bucket string, _group string")
    out = sharding.assign(docs)
    assert out.columns == ["doc_id", "text", "_bucket", "_group", *sharding.RESULTS]
    assert sorted((r.doc_id, r._bucket, r._group, r.size) for r in out.collect()) == [(1, "x", "y", 17), (2, "z", None, 17)]


def test_sharding_laws(spark):
    rng = random.Random(11)
    rows = [(i, "w " * rng.randint(0, 40) + str(i), "s") for i in range(3000)] + [(5000 + i, "hot text " * 5, "s") for i in range(1500)] + [(None, None, "s"), (7, None, "s"), (7, None, "s")]
    out = sharding.assign(table(spark, rows)).collect()
    assert len(out) == len(rows)
    by = collections.defaultdict(list)
    for r in out:
        raw = (r.text or "").encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)
        by[r.shard].append(r)
    assert set(by) == set(range(40))
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    total = [sum(r.size for r in v) for v in by.values()]
    assert max(total) < 1.03 * min(total)
    assert max(map(len, by.values())) < 1.25 * min(map(len, by.values()))


def test_small_groups_stay_together(spark):
    rows = [(i, f"text {i // 2}", "s") for i in range(4000)]
    shard = {r.doc_id: r.shard for r in sharding.assign(table(spark, rows)).collect()}
    assert all(shard[i] == shard[i + 1] for i in range(0, 4000, 2))
    assert sharding.assign(table(spark, [])).count() == 0
