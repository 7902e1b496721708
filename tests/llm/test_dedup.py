"""Line dedup, near-dedup and decontamination against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwarden.llm import decontam, hashing, line_dedup, neardup
from siftwarden.llm.components import roots

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, component_id string, n long, shingles string"  # extra columns with clashing names


def shingles(text):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)


def corpus(seed=1):
    """Exact copies, near copies of a base that are alike or only half alike, odd texts."""
    rng = random.Random(seed)
    vocab = [f"w{k}é" if k % 7 == 0 else f"W{k}" for k in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows = [text(rng.randint(1, 120)) for _ in range(60)]
    base = text(100).split()
    for share in [0.005] * 30 + [0.02] * 30 + [0.06] * 30:
        rows.append(" ".join(w if rng.random() > share else rng.choice(vocab) for w in base))
    rows += [rows[3]] * 12 + [rows[4].upper(), rows[4].replace(" ", "\n\t")]
    rows += [None, "", "  \n", "one", "ONE", "two words", "é", "x" * 50_000, text(9_000)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def expected_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i, _ in rows}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = [i for i in sets if sets[i]]
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("small", [2, 16])
def test_components_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(neardup, "SMALL", small)  # with 2, large regions are compared in blocks
    monkeypatch.setattr(neardup, "BLOCK", 24)
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.components(table(spark, rows)).collect()}
    assert got == expected_components(rows)


def test_components_of_odd_tables(spark):
    assert neardup.components(table(spark, [])).count() == 0
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (2, "A B C D E F"), (9, None)]
    got = sorted(((r.doc_id, r.component_id) for r in neardup.components(table(spark, rows)).collect()), key=str)
    assert got == sorted([(None, None), (5, 2), (5, 2), (2, 2), (9, 9)], key=str)


def test_overlaps():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(30)]
    want = [[len(set(a.tolist()) & set(b.tolist())) if k != j else 0 for j, b in enumerate(sets)] for k, a in enumerate(sets)]
    got = neardup._overlaps(sets)
    np.fill_diagonal(got, 0)
    assert got.tolist() == want


def test_roots(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 480)]
    up = list(range(500))
    for a, b in edges:
        x, y = up[a], up[b]
        up = [min(x, y) if u in (x, y) else u for u in up]
    got = {r.x: r.y for r in roots(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {k: u for k, u in enumerate(up) if u != k}


def test_hashes_depend_on_words_alone():
    texts = ["The cat\tsat", "on THE  cat", None, "", "x\ny", "the"]
    words = {}
    for _, _, data, at in hashing.goes(pa.array(texts)):
        h, of = hashing.word_hashes(data, at)
        for k, t in enumerate(texts):
            own = WORD.findall((t or "").translate(FOLD))
            assert of[k + 1] - of[k] == len(own)
            for w, x in zip(own, h[of[k] : of[k + 1]].tolist()):
                assert words.setdefault(w, x) == x
    assert len(set(words.values())) == len(words)


def test_goes_cover_all_rows(monkeypatch):
    monkeypatch.setattr(hashing, "CHUNK", 10)
    texts = ["a" * 25, "", "b c", None, "d" * 9, "e"]
    assert [(a, b) for a, b, _, _ in hashing.goes(pa.array(texts))] == [(0, 1), (1, 4), (4, 6)] or sum(b - a for a, b, _, _ in hashing.goes(pa.array(texts))) == 6


# --- line dedup


def expected_lines(rows):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    holders = {}
    for i, t in rows:
        for x in {key(s) for s in (t or "").split("\n")}:
            if len(x) >= 10:
                holders.setdefault(x, set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [s for s in lines if not (len(holders.get(key(s), ())) > 1 and min(holders[key(s)]) != i)]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def line_rows():
    rng = random.Random(4)
    pool = [f"Shared line number {k} é" for k in range(20)] + ["short", "", "   ", "\t Shared line number 3 é\r"]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own line {i} {k}" for k in range(rng.randint(0, 12)))) for i in range(80)]
    return rows + [(80, None), (81, ""), (82, "\n"), (83, "one very common line here\none very common line here"), (84, "ONE VERY COMMON LINE HERE")]


def told(df):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.sha) for r in df.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("sha")).collect()}


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
def test_lines_against_brute_force(spark, tmp_path, broadcast):
    rows = line_rows()
    store = line_dedup.LineDedup(spark, str(tmp_path), broadcast, shard_keys=8)
    store.insert(table(spark, rows))
    assert told(store.apply(table(spark, rows))) == expected_lines(rows)


def test_lines_insert_and_delete_are_reversible(spark, tmp_path):
    rows = line_rows()
    first, more = rows[:50], rows[50:]
    store = line_dedup.LineDedup(spark, str(tmp_path), shard_keys=8)
    store.insert(table(spark, first))
    before = told(store.apply(table(spark, first)))
    store.insert(table(spark, more))
    store.insert(table(spark, more))  # already in
    assert told(store.apply(table(spark, rows))) == expected_lines(rows)
    store.delete(table(spark, more))
    assert told(store.apply(table(spark, first))) == before == expected_lines(first)
    again = line_dedup.LineDedup(spark, str(tmp_path)).open_at(store.describe())
    assert told(again.apply(table(spark, first))) == before


def test_lines_deletion_reads_touched_shards_alone(spark, tmp_path):
    rows = [(i, "\n".join(f"a line of text number {(i + k) % 300}" for k in range(3))) for i in range(300)]
    store = line_dedup.LineDedup(spark, str(tmp_path), shard_keys=8)
    store.insert(table(spark, rows))
    before = dict(store.now["counts"])
    assert store.now["shards"] > 30
    store.delete(table(spark, rows[:1]))
    touched = [k for k, v in store.now["counts"].items() if v != before[k]]
    assert 0 < len(touched) <= 3
    assert told(store.apply(table(spark, rows[1:]))) == expected_lines(rows[1:])
    assert store.now["docs"] and len(store.now["gone"]) == 1


def test_lines_filters_grow_and_tables_are_rewritten(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(line_dedup, "SEGMENTS", 4)
    store = line_dedup.LineDedup(spark, str(tmp_path), shard_keys=8)
    store.insert(table(spark, [(0, "the very first line"), (1, "the very first line")]))
    rows, seen = [(0, "the very first line"), (1, "the very first line")], set()
    for k in range(1, 5):
        # a growing insert overfills filters, then asks for more shards
        more = [(100 * k + i, "\n".join(f"line {j} of round {k if j % 2 else 0}" for j in range(20 * k))) for i in range(2)]
        store.insert(table(spark, more))
        rows += more
        seen.add(store.now["shards"])
        assert told(store.apply(table(spark, rows))) == expected_lines(rows)
    assert len(seen) > 1
    store.delete(table(spark, rows[:1]))
    store.insert(table(spark, rows[:1]))  # in again
    assert told(store.apply(table(spark, rows))) == expected_lines(rows)
    state = store.describe()
    monkeypatch.setattr(line_dedup, "_counted", lambda rows: rows.select(F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost|UNRESOLVED|part"):
        store.insert(table(spark, [(999, "the very first line")]))
    assert store.describe() == state  # the state before the failed step


def test_lines_of_odd_tables(spark, tmp_path):
    store = line_dedup.LineDedup(spark, str(tmp_path))
    store.insert(table(spark, []))
    assert store.apply(table(spark, [])).count() == 0
    rows = [(None, "a shared line of text"), (1, "a shared line of text"), (1, "a shared line of text"), (2, "a shared line of text")]
    store.insert(table(spark, rows))
    got = sorted(((r.doc_id, r.n_dropped) for r in store.apply(table(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 0), (1, 0), (1, 0), (2, 1)], key=str)


def test_cuckoo():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 5_000).astype(np.uint64)
    c = line_dedup.Cuckoo.sized(len(h))
    assert c.add(h) and c.has(h).all()
    other = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    assert c.has(other).mean() < 0.01
    c.remove(h[:2_000])
    assert c.has(h[2_000:]).all() and c.has(h[:2_000]).mean() < 0.01
    assert not line_dedup.Cuckoo.sized(10).add(h)


# --- decontamination


def bench_rows():
    rng = random.Random(6)
    vocab = [f"v{k}" for k in range(3000)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([3, 5, 8, 16, 40, 120])))) for k in range(30)] + [(30, None), (31, " "), (32, "solo")]
    docs = []
    for i in range(120):
        w = rng.choices(vocab, k=rng.choice([0, 5, 50, 3000]))
        if i % 3 == 0:
            x = items[rng.randrange(30)][1].split()
            x = [y.upper() if rng.random() < 0.5 else y for y in x]
            if i % 2:
                x = x[: max(1, int(len(x) * rng.uniform(0.5, 1)))]
            at = rng.randint(0, len(w))
            w = w[:at] + x + w[at:]
        docs.append((i, " ".join(w)))
    return docs + [(120, None), (121, "SOLO"), (122, "solo and more")], items


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_decontamination_against_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(decontam, "SENT_SHINGLES", sent)
    docs, items = bench_rows()
    sets = {i: shingles(t) for i, t in docs}
    want = set()
    for k, t in items:
        s = shingles(t)
        want |= {(i, k, len(s), len(s & d)) for i, d in sets.items() if s and 4 * len(s & d) >= 3 * len(s)}
    found = decontam.with_hits(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, h.item_id, h.n_item, h.n_shared) for r in found.collect() for h in r.hits}
    assert got == want and len(want) > 15
    assert found.count() == len(docs)


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_decontamination_of_null_and_repeated_ids(spark, monkeypatch, sent):
    monkeypatch.setattr(decontam, "SENT_SHINGLES", sent)
    items = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "h i j k l m n"), (None, "o p q r s t u")]
    docs = [(None, "x a b c d e f g"), (None, "nothing in it"), (7, "a b c d e f g x"), (7, "clean text of the same id"), (7, "h i j k l m n"), (8, "o p q r s t u"), (9, "a b c d e h i j k l")]
    found = decontam.with_hits(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted(((r.text, r.doc_id, [tuple(h) for h in r.hits]) for r in found.collect()), key=str)
    hits = {0: [(1, 3, 3)] * 2, 2: [(1, 3, 3)] * 2, 4: [(1, 3, 3)], 5: [(None, 3, 3)]}
    assert got == sorted(((t, i, hits.get(k, [])) for k, (i, t) in enumerate(docs)), key=str)


def test_decontamination_of_empty_tables(spark):
    docs, items = bench_rows()
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.with_hits(table(spark, docs), none).where(F.size("hits") > 0).count() == 0
    assert decontam.with_hits(table(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_text_ids(spark, monkeypatch):
    """Items and documents may have ids of any type, on both sides of the bound; where smallest ids are asked for, text ids are refused."""
    from siftwarden.llm import decontam, line_dedup, neardup

    text = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([("d1", f"x y {text} z"), ("d2", "nothing here"), (None, text)], "doc_id string, text string")
    items = spark.createDataFrame([("i1", text), ("i2", "a b c d e f g")], "item_id string, text string")
    for bound in (decontam.SENT_SHINGLES, 0):
        monkeypatch.setattr(decontam, "SENT_SHINGLES", bound)
        got = {(r.doc_id, h.item_id) for r in decontam.with_hits(docs, items).collect() for h in r.hits}
        assert got == {("d1", "i1"), (None, "i1")}
    for refuses in (lambda: neardup.classed(docs), lambda: line_dedup.LineDedup(spark).insert(docs), lambda: line_dedup.LineDedup(spark).apply(docs)):
        with pytest.raises(ValueError, match="whole number"):
            refuses()
