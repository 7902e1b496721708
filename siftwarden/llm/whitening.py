"""Operator 11, embedding whitening: an exact scatter by residue numbers, then a double eigendecomposition.

Each entry c of a vector becomes the integer x = floor(256 * c).  The fit list is each distinct x-vector once.  Its
scatter, the sums of x[i] * x[j], is found modulo several primes: a task reduces its vectors modulo each
prime and multiplies them in blocks of ROWS, so small that a double holds every sum exactly (GEMM); Spark adds up the tasks'
residues, and Chinese remaindering puts the exact sums together.  How many primes it takes follows from
the number of vectors and the largest entry.  With n vectors and sums S the covariance is
(n * scatter - S * S) / (n * n) in whole numbers, so that centring costs no digit and the one rounding is the last division.
numpy's `eigh` then gives unit components, numbered by falling eigenvalue.

A second pass over the fit list whitens it and measures how far its covariance is from the identity; a third one
whitens all rows.  What the driver takes is d * d numbers for vectors of d entries, whatever the number of rows.

Nulls and edges: a row whose vector is null or holds null or non-finite entries is dropped; vectors of another length
are a space of their own, with n, components and identity_error of their own; an empty vector has no component and gives no
row; a null vec_id is kept, repeated ids and rows each give their rows; a component without variance (not above
rounding) has null whitened, and explained is null if no component has any; vectors with fewer than 4 entries have as
many components; entries beyond the range of longs count as its ends, and deviations that a long can't hold raise OverflowError;
components of equal eigenvalue are whichever `eigh` gives; other columns are not looked at; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

SCALE = 256
COMPONENTS = 4
#: Residues stay within half of 2**PRIME_BITS of 0, so ROWS products of two add up to less than 2**53.
PRIME_BITS, ROWS = 21, 1 << 12


def integers(embedding: Column) -> Column:
    """The x-vector of a finite vector."""
    return F.transform(embedding, lambda c: F.floor(c.cast("double") * SCALE))


def finite(embedding: Column) -> Column:
    """Whether a vector is there and all its entries are finite."""
    ok = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))
    return F.coalesce(embedding.isNotNull() & F.forall(embedding, ok), F.lit(False))


def primes(product: int) -> list[int]:
    """The largest primes below 2**PRIME_BITS, as many as it takes for a product of more than `product`."""
    out, have, p = [], 1, 1 << PRIME_BITS
    while have <= product:
        p -= 1
        if all(p % k for k in range(2, int(p**0.5) + 1)):
            out.append(p)
            have *= p
    return out


def remainder(residues: np.ndarray, moduli: list[int]) -> np.ndarray:
    """The whole numbers nearest to 0 with these residues, a row of them for each modulus (Chinese remaindering)."""
    product = 1
    for p in moduli:
        product *= p
    total = np.zeros(residues.shape[1:], object)
    for r, p in zip(residues, moduli):
        rest = product // p
        total += r.astype(object) * (rest * pow(rest, -1, p))
    total %= product
    return np.where(total > product // 2, total - product, total)


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x) for each vector length of an Arrow column of lists without nulls."""
    size = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten())
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield rows, flat[start[rows][:, None] + np.arange(d)] if d else np.zeros((len(rows), 0), flat.dtype)


def scatter(fit: DataFrame, moduli: dict[int, list[int]]) -> DataFrame:
    """(d, prime, i, j, r): for each length d and prime, sums of x[i] * x[j] (i <= j) and of x[j] (i = -1), modulo the prime but for the tasks' carries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for _, x in matrices(batch["x"]):
                d = x.shape[1]
                for k in range(0, len(x), ROWS):
                    for p in moduli[d]:
                        r = np.mod(x[k : k + ROWS], p)
                        r = np.where(r > p // 2, r - p, r).astype(np.float64)
                        r = np.concatenate([r, np.ones((len(r), 1))], axis=1)  # the last column makes the plain sums
                        sums[d, p] = (sums.get((d, p), 0) + (r[:, :d].T @ r).astype(np.int64)) % p
        for (d, p), s in sums.items():
            i, j = np.nonzero(np.triu(np.ones((d, d), bool)))
            i, j, r = np.concatenate([i, np.full(d, -1)]), np.concatenate([j, np.arange(d)]), np.concatenate([s[i, j], s[:, d]])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), v, t)) for v, t in ((d, np.int32), (p, np.int32))] + [pa.array(v.astype(t)) for v, t in ((i, np.int32), (j, np.int32), (r, np.int64))], ["d", "prime", "i", "j", "r"])

    return fit.mapInArrow(run, "d int, prime int, i int, j int, r long").groupBy("d", "prime", "i", "j").agg(F.sum("r").alias("r"))


@dataclass
class Space:
    """What vectors of one length are whitened by."""

    n: int
    sums: list[int]
    largest: int  # no entry lies farther from 0
    values: np.ndarray  # eigenvalues of the first components, falling
    vectors: np.ndarray  # a column for each
    live: np.ndarray  # which of them have variance
    explained: list[float | None]
    identity_error: float | None = None

    @classmethod
    def of(cls, n: int, largest: int, sums: np.ndarray, products: np.ndarray) -> Space:
        """From exact sums of entries and of their products."""
        d = len(sums)
        centred = n * products - np.outer(sums, sums)
        v = (centred / (n * n)).astype(np.float64)
        values, vectors = np.linalg.eigh(v)
        order = np.argsort(-values, kind="stable")[:COMPONENTS]
        values, vectors = values[order], vectors[:, order]
        vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
        live = values > max(float(values[0]), 0.0) * d * np.finfo(np.float64).eps
        trace = int(np.trace(centred)) / (n * n)
        return cls(n, [int(s) for s in sums], largest, values, vectors, live, [max(float(e), 0.0) / trace if trace else None for e in values])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: longs where they can't run over, else Python's integers."""
        small = 2 * self.n * self.largest < 1 << 62
        return x * self.n - np.array(self.sums, np.int64) if small else x.astype(object) * self.n - np.array(self.sums, object)

    def deviation(self, y: np.ndarray) -> np.ndarray:
        """Sums of squares of rows of n * x - S."""
        if y.shape[1] * (2 * self.n * self.largest) ** 2 < 1 << 63:
            return (y * y).sum(axis=1)
        exact = (y.astype(object) ** 2).sum(axis=1)
        if len(exact) and max(exact) >= 1 << 63:
            raise OverflowError("a deviation is beyond the range of a long")
        return exact.astype(np.int64)

    def whiten(self, y: np.ndarray) -> np.ndarray:
        """Rows of n * x - S on the components over their deviations; NaN where a component has none."""
        by = np.where(self.live, self.values, np.nan)
        return (y / self.n).astype(np.float64) @ self.vectors / np.sqrt(by)


def spaces(vectors: DataFrame) -> dict[int, Space]:
    """The space of each vector length of rows (x)."""
    fit = written(vectors.select("x").where(F.size("x") > 0).distinct(), "fit")
    bounds = fit.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.min(F.array_min("x")).alias("low"), F.max(F.array_max("x")).alias("high")).collect()  # a row for each length
    largest = {b.d: max(-b.low, b.high, 1) for b in bounds}
    # both signs, and the plain sums are no larger
    moduli = {b.d: primes(2 * b.n * largest[b.d] ** 2) for b in bounds}
    told = scatter(fit, moduli).toArrow()
    d, prime, i, j, r = (np.asarray(told[c]) for c in ("d", "prime", "i", "j", "r"))
    out = {}
    for b in bounds:
        whole = np.zeros((len(moduli[b.d]), b.d + 1, b.d), np.int64)
        for k, p in enumerate(moduli[b.d]):
            at = (d == b.d) & (prime == p)
            whole[k, i[at], j[at]] = r[at] % p
        exact = remainder(whole, moduli[b.d])
        upper = exact[: b.d]
        out[b.d] = Space.of(b.n, largest[b.d], exact[b.d], upper + np.triu(upper, 1).T)
    return measured(fit, out)


def measured(fit: DataFrame, of: dict[int, Space]) -> dict[int, Space]:
    """The spaces with the largest entry of the whitened fit list's covariance minus the identity; the whitened vectors are centred."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in matrices(batch["x"]):
                space = of[x.shape[1]]
                w = space.whiten(space.centred(x))[:, space.live]
                sums[x.shape[1]] = sums.get(x.shape[1], 0.0) + w.T @ w
        for d, s in sums.items():
            i, j = np.indices(s.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(s.size, d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(s.reshape(-1))], ["d", "i", "j", "s"])

    for r in fit.mapInArrow(run, "d int, i int, j int, s double").groupBy("d", "i", "j").agg(F.sum("s").alias("s")).collect():  # COMPONENTS**2 rows for each length
        off = abs(r.s / of[r.d].n - (r.i == r.j))
        of[r.d].identity_error = max(off, of[r.d].identity_error or 0.0)
    return of


def whitened(docs: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for rows with vec_id and embedding."""
    rows = docs.where(finite(F.col("embedding"))).select("vec_id", integers(F.col("embedding")).alias("x"))
    of = spaces(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in matrices(batch["x"]):
                if not x.shape[1]:
                    continue
                space = of[x.shape[1]]
                y = space.centred(x)
                w, many = space.whiten(y), len(space.values)
                each = lambda v: np.repeat(v, many)
                alike = lambda v, kind: pa.array(v * len(x), kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["vec_id"].take(pa.array(each(at))), alike(list(range(1, many + 1)), pa.int32()), alike([space.n] * many, pa.int64()), pa.array(each(space.deviation(y)), pa.int64()),
                        pa.array(w.reshape(-1), mask=np.isnan(w.reshape(-1))), alike(space.explained, pa.float64()), alike([space.identity_error] * many, pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = dict(docs.dtypes)["vec_id"]
    return rows.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
