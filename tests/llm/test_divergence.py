"""The audit of sources against plain loops over whole numbers."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from siftwarden.llm import divergence

DOCS = "doc_id long, lang string, source string, text string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_audit(rows):
    terms = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]) for _, lang, source, text in rows]
    df, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, words in terms:
        df[lang].update(set(words))
        counts[lang, source].update(words)
        sources[lang].add(source)
    out = set()
    for lang, names in sources.items():
        kept = [w for w, n in df[lang].items() if n >= 3]

        def share(count, kept=kept):
            total = sum(count[w] for w in kept) + len(kept)
            return {w: 1 + 10**9 * (count[w] + 1) // total for w in kept}

        p = {s: share(counts[lang, s]) for s in names}
        q = share(sum((counts[lang, s] for s in names), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in names:
            pairs = [(-sum(f(p[s][w], p[t][w]) for w in kept), t.encode()) for t in names - {s}]
            ahead = [(-f(p[s][w], q[w]), w.encode()) for w in kept if counts[lang, s][w] and p[s][w] > q[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(ahead)[:200])):
                out |= {(lang, s, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(found)}
    return out


def told(spark, rows, **how):
    got = divergence.audit(spark.createDataFrame(rows, DOCS).repartition(how.get("parts", 3)))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    out = [tuple(r) for r in got.collect()]
    assert len(out) == len(set(out))
    return set(out)


def made(n, seed=3):
    import random

    rng = random.Random(seed)
    pool = ["Überall", "naïve", "don't", "x1y", "the", "THE", "a", "-", "日本 語", "é", "zz\x7fq", "İ"] + [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]
    return [(k, rng.choice(["en", "en", "de"]), rng.choice(["b", "a", "c", "ab"]), rng.choice([" ", "\n", "\t;"]).join(rng.choice(pool[: rng.choice([12, 50, 312])]) for _ in range(rng.randrange(80)))) for k in range(n)]


def test_audit_against_plain_loops(spark):
    rows = made(150)
    rows += [(None, None, "a", "one two"), (7, "en", None, "the the"), (7, "en", None, "the the"), (8, "xx", "lonely", None), (9, "yy", "a", ""), (10, "yy", "b", "rare words")]
    rows += [(20 + k, "zz", s, "same same tie") for k, s in enumerate("abcab")]
    want = plain_audit(rows)
    assert told(spark, rows) == want
    assert {r[4] for r in want if r[0] == "yy"} == {0} and not [r for r in want if r[0] == "xx"]


def test_audit_of_many_small_blocks(spark, monkeypatch):
    """Blocks of a few texts, read apart from each other, and totals that meet postings in a shuffle give the same."""
    rows = made(120, 4)
    want = plain_audit(rows)
    monkeypatch.setattr(divergence, "SENT_GROUPS", 0)
    assert told(spark, rows, parts=7) == want
    count = lambda: divergence.packs(spark.createDataFrame(rows, DOCS).select("lang", "source", "text").repartition(1)).count()
    few = count()
    for name, value in (("BLOCK", 900), ("PACK", 200), ("HELD", 400), ("PAIRS", 7)):
        monkeypatch.setattr(divergence, name, value)
    assert few == len({(r[1], r[2]) for r in rows}) < count()
    assert told(spark, rows, parts=2) == want


def test_audit_ranks_only_the_first_terms(spark):
    words = [f"k{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(260)]
    rows = [(k, "en", "a", " ".join(words)) for k in range(3)] + [(9 + k, "en", "b", "common " * 90) for k in range(3)]
    got = told(spark, rows)
    assert got == plain_audit(rows) and max(r[5] for r in got) == 200


def test_audit_edges(spark):
    assert told(spark, []) == set()
    extra = spark.createDataFrame([(1, "en", "a", "x x", "p", 3), (2, "en", "b", "x x", "p", 3)], DOCS + ", part string, rank int")
    assert {tuple(r) for r in divergence.audit(extra).collect()} == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
    long_text = ("word " * 400_000) + "end"
    rows = [(k, "en", "ab"[k % 2], long_text if k == 0 else "word end") for k in range(4)]
    assert told(spark, rows) == plain_audit(rows)
    bad = spark.sql("select 'en' as lang, source, cast(concat(X'FF41', cast(' b' as binary)) as string) as text from values ('a'), ('a'), ('b') as t(source)")
    assert {r.source for r in divergence.audit(bad).collect()} == {"a", "b"}


def test_shares_are_exact(spark):
    """Long division by thousands against whole numbers, up to the ends of what it takes."""
    cases = [(0, 1), (0, 3), (5, 7), (9 * 10**14, 9 * 10**15), (9 * 10**15 - 1, 9 * 10**15), (123456789012345, 987654321012345)]
    got = spark.createDataFrame(cases, "c long, t long").select("c", "t", divergence._part(divergence.F.col("c"), divergence.F.col("t")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (c + 1) // t for c, t in cases]
