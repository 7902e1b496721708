"""Operators on vectors, against plain loops."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwarden.llm import vectors, whitening

VECTORS = "vec_id long, embedding array<double>, label int"


def plain_whitening(rows):
    """n, deviations, explained and whitened up to sign, by exact fractions and a plain covariance."""
    kept = [(i, [math.floor(Fraction(c) * 256) for c in v]) for i, v, _ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    cov = np.array([[float(sum((Fraction(x[a]) - Fraction(sums[a], n)) * (Fraction(x[b]) - Fraction(sums[b], n)) for x in fit) / n) for b in range(d)] for a in range(d)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    out = []
    for i, x in kept:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        y = np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, sums)])
        for k, e in enumerate(values):
            out.append((i, k + 1, n, deviation, abs(float(y @ vectors[:, k])) / math.sqrt(e), e / float(np.trace(cov))))
    return out


def assert_whitened(got, rows):
    want = sorted(plain_whitening(rows))
    told = sorted((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got)
    assert [w[:4] for w in want] == [t[:4] for t in told]
    assert np.allclose([w[4:] for w in want], [t[4:] for t in told], rtol=1e-9, atol=1e-9)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def made(n, d, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) * np.linspace(3, 1, d)
    return [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]


def test_whitening_against_fractions(spark):
    rows = made(60, 7)
    rows += [(100 + i, v, 1) for i, v, _ in rows[:9]] + [(3, rows[5][1], None), (200, None, 0), (201, [math.nan] * 7, 0), (202, [1.0] * 6 + [None], 0), (203, [math.inf] + [0.0] * 6, 0)]
    got = whitening.whitened(spark.createDataFrame(rows, VECTORS).repartition(5)).collect()
    assert_whitened(got, rows)


def test_whitening_of_large_entries(spark):
    """Entries whose products no long holds still make an exact scatter; deviations beyond a long are an error that says so."""
    rows = [(i, [c * 2e4 for c in v], 0) for i, v, _ in made(20, 5, 1)]
    assert_whitened(whitening.whitened(spark.createDataFrame(rows, VECTORS)).collect(), rows)
    fit = spark.createDataFrame([([1 << 62, -(1 << 63)],), ([3, (1 << 63) - 1],), ([5, 7],)], "x array<long>")
    space = whitening.spaces(fit)[2]
    x = [[1 << 62, -(1 << 63)], [3, (1 << 63) - 1], [5, 7]]
    assert space.sums == [sum(r[k] for r in x) for k in (0, 1)] and space.n == 3
    mean = [Fraction(s, 3) for s in space.sums]
    cov = np.array([[float(sum((r[a] - mean[a]) * (r[b] - mean[b]) for r in x) / 3) for b in (0, 1)] for a in (0, 1)])
    assert np.allclose(space.values, np.linalg.eigvalsh(cov)[::-1], rtol=1e-12)
    with pytest.raises(OverflowError):
        space.deviation(space.centred(np.array(x, np.int64)))


def test_whitening_edges(spark):
    empty = whitening.whitened(spark.createDataFrame([], VECTORS))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    # one distinct vector has no variance; an empty vector no component; each length is a space of its own
    rows = [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (None, [0.5], 0), (4, [0.25], 0), (5, [], 0)]
    docs = spark.createDataFrame([(*r, "x", 9) for r in rows], VECTORS + ", component string, n int")
    got = {(r.vec_id, r.component): r for r in whitening.whitened(docs).collect()}
    assert sorted(got, key=str) == [(1, 1), (1, 2), (2, 1), (2, 2), (4, 1), (None, 1)]
    assert got[1, 1].whitened is None and got[1, 1].explained is None and got[1, 1].n == 1 and got[1, 1].deviation == 0 and got[1, 1].identity_error is None
    assert abs(got[4, 1].whitened) == 1.0 and got[None, 1].whitened == -got[4, 1].whitened and got[4, 1].n == 2 and got[4, 1].explained == 1.0
    # a component without variance beside one that has it
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], 0) for i in range(9)], VECTORS)
    for r in whitening.whitened(line).collect():
        assert (r.whitened is None) == (r.component > 1) and abs(r.explained - (r.component == 1)) < 1e-12 and r.identity_error < 1e-12


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(1 << 90), 1 << 90), min_size=1, max_size=5))
def test_remainders_give_back_whole_numbers(numbers):
    moduli = whitening.primes(2 * max(map(abs, numbers)) + 1)
    residues = np.array([[n % p for n in numbers] for p in moduli], np.int64)
    assert list(whitening.remainder(residues, moduli)) == numbers


def plain_links(rows):
    """vec_id, n_links, component_id and kept by comparing all pairs of a label."""
    n = len(rows)
    good = [v is not None and lab is not None and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v, lab in rows]
    unit = [np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max()) if ok else None for (_, v, _), ok in zip(rows, good)]
    to, links = list(range(n)), [0] * n

    def top(k):
        while to[k] != k:
            k = to[k]
        return k

    for a in range(n):
        for b in range(a):
            if good[a] and good[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98:
                links[a] += 1
                links[b] += 1
                to[top(a)] = top(b)
    least = {}
    for k in range(n):
        if rows[k][0] is not None:
            least[top(k)] = min(least.get(top(k), rows[k][0]), rows[k][0])
    return sorted(((rows[k][0], links[k], least.get(top(k)), rows[k][0] == least.get(top(k))) for k in range(n)), key=str)


def near(rng, base, cosine):
    """A unit vector at exactly this cosine from a unit vector."""
    w = rng.standard_normal(len(base))
    w -= (w @ base) * base
    return cosine * base + math.sqrt(1 - cosine**2) * w / np.linalg.norm(w)


def planted(d=24, seed=5):
    rng = np.random.default_rng(seed)
    some = lambda: vectors.units(rng.standard_normal((1, d)))[0]
    out = [some() * rng.uniform(0.1, 30) for _ in range(150)]
    tight = some()
    out += [near(rng, tight, 0.996) for _ in range(130)]  # nearly all linked
    loose = some()
    out += [near(rng, loose, rng.uniform(0.985, 0.999)) for _ in range(130)]  # some linked, some not
    cloud = some()
    out += [near(rng, cloud, 0.95) for _ in range(90)]  # in one bucket, but not linked
    step = some()
    for _ in range(25):  # a chain of links at the threshold
        out.append(step)
        step = near(rng, step, 0.9801)
    out += [out[151]] * 30 + [out[300] * 7.5] * 3
    rows = [(k, [float(c) for c in v], 1 if k % 40 else 2) for k, v in enumerate(out)]
    order = rng.permutation(len(rows))
    return [(int(order[k]), v, lab) for k, (_, v, lab) in enumerate(rows)]


ODD = [(None, [1.0] * 24, 1), (None, [2.0] * 24, 1), (900, [1.0] * 24, None), (901, None, 1), (902, [0.0] * 24, 1), (903, [math.nan] + [1.0] * 23, 1), (904, [None] + [1.0] * 23, 1), (905, [1.0] * 23, 1), (906, [], 1), (905, [1.0] * 23, 1), (3, [5e200] * 24, 2), (907, [-0.0, 1.0], 1), (908, [0.0, 1.0], 1)]


def told_links(spark, rows):
    got = vectors.near_vectors(spark.createDataFrame(rows, VECTORS).repartition(3))
    assert got.columns == vectors.RESULTS
    return sorted(((r.vec_id, r.n_links, r.component_id, r.vec_id == r.component_id) for r in got.collect()), key=str)


@pytest.mark.parametrize("dense", [16, 64, 100_000])
def test_links_against_all_pairs(spark, monkeypatch, dense):
    """With units of many, their rings and blocks, with few of them, and by pairs alone."""
    monkeypatch.setattr(vectors, "DENSE", dense)
    monkeypatch.setattr(vectors, "BLOCK", 24)
    rows = planted() + ODD
    assert told_links(spark, rows) == plain_links(rows)


def test_links_of_wide_buckets(spark, monkeypatch):
    monkeypatch.setattr(vectors, "WIDE", 3)
    monkeypatch.setattr(vectors, "DENSE", 100_000)
    rows = planted(6, 8)[100:330]
    assert told_links(spark, rows) == plain_links(rows)


def test_links_edges(spark):
    assert told_links(spark, []) == []
    one = spark.createDataFrame([(7, [1.0, 0.0], 3, "a", True)], VECTORS + ", component_id string, kept boolean")
    assert [tuple(r) for r in vectors.near_vectors(one).collect()] == [(7, 0, 7, True)]
    nulls = vectors.near_vectors(spark.createDataFrame([(None, [1.0], 1), (None, [2.0], 1)], VECTORS)).collect()
    assert [tuple(r) for r in nulls] == [(None, 1, None, True)] * 2


def test_hadamard_is_a_rotation_and_few_links_are_missed():
    x = np.random.default_rng(2).standard_normal((40, 16)).astype(np.float32)
    y = vectors.turned(x, (1, 2))
    assert np.allclose(x @ x.T, y @ y.T, atol=1e-3) and not np.allclose(x, y)
    for d, n in ((2, 10), (64, 5_000), (64, 10**7), (300, 10**5)):
        hashes, tables = vectors.tables_for(d, n)
        assert 1 <= hashes and 2 <= tables <= 60
        rng = np.random.default_rng(77)
        u = vectors.units(rng.standard_normal((2000, d)))
        v = np.array([near(rng, row, 0.98) for row in u])
        met = np.zeros(len(u), bool)
        for at in range(tables):
            a, b = vectors.codes(u, at, hashes), vectors.codes(v, at, hashes)
            met |= (a[:, :1] == b).all(axis=2).any(axis=1) | (b[:, :1] == a).all(axis=2).any(axis=1)
        assert met.all(), (d, n, hashes, tables)
