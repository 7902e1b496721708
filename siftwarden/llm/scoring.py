"""Operator 6, LM scoring: a trigram model in a log-frequency Bloom filter.

Counting: words, bigrams and trigrams of all training texts (ASCII-lower-cased words, an end after each text, a
start before it).  Each task counts its own texts and passes sorted codes and counts on, as one value for each
part, some ranges of codes; a part meets in one task, which sums it exactly.  Words are told apart by 64 bits, bigrams
and trigrams by 46; the number of ranges follows the bytes of the texts, so a range's size does not.  As all texts have
something for all parts, the values' number would grow with the square of the input if a part stayed one range: parts
widen first, up to WIDEST ranges, and values are made and read many at a time.

Model: counts are quantised to edges, the whole numbers next above powers of BASE.  An n-gram's level is
how many edges its count c has reached; the filter holds all n-grams, those seen once too, as
(n-gram, 1) to (n-gram, level).  Probing levels from 1 until one misses gives the level back, and so the
edges low <= c <= high about c.  With L the sum of low over all words and V their number,

    p1(w) = (low(w) + 1) / (L + V + 1)
    p2(w | v) = WEIGHT * max(low(v w) - DISCOUNT, 0) / high(v) + (1 - WEIGHT) * p1(w),   or p1(w) where v isn't held
    p3(w | u v) = WEIGHT * max(low(u v w) - DISCOUNT, 0) / high(u v) + (1 - WEIGHT) * p2(w | v),   or p2 where u v isn't held.

Low over high keeps the sums over w at 1 at most; the discount keeps what a text itself adds to the counts from
telling most about it.  `score` is the sum of log10 p3 over a text's words and its end.

The filter has a segment for each range, built where the range is summed.  Up to FILTER_BYTES they are sent to all
workers.  A larger filter stays a table of segments: texts are cut into runs, the distinct n-grams of each run go
to the parts that they fall in, are probed there, and the levels meet the run again, with the same scores.

The base score needs exact counts.  The FREQUENT commonest words, a fixed number, go to the workers with
their counts; the other words of each text meet the exact table in a join.

Nulls and edges: a null text is an empty one, one end; rows with a null doc_id are scored but not learnt
from; repeated rows are learnt from and scored each; without training texts every probability is 1 (log 0);
very long texts are taken whole (a text's own words and n-grams must fit its task: some 100 bytes for each of its words);
columns of docs stay, but one named as a result column gives way to it; an empty table gives none.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, id_bucket, table, written
from .hashing import U, goes, mix, utf8, word_hashes

BASE = 1.3
WEIGHT, DISCOUNT = 0.6, 0.75
BITS = 14
PROBES = 6
#: Up to so many bytes the filter is sent to all workers.
FILTER_BYTES = 64 << 20
#: Bytes of text whose n-grams make a range on average; a range is summed, and probed, by one task.
RANGE_BYTES = 2 << 20
#: Bytes of text that ask for their n-grams together where the filter is a table, and in how many turns runs do so: a turn's
#: shuffle goes before the next one's comes.
RUN_BYTES, TURNS = 2 << 20, 2
#: Ranges are dealt to tasks in parts of one range each; from 2 * PARTS ranges on parts widen instead of becoming more, up to WIDEST ranges.
PARTS, WIDEST = 512, 8
#: Bytes of text that are hashed, and of packed n-grams that are unpacked, at one go.
HASHED = SLICE = 1 << 18
FREQUENT = 200_000
#: Tokens that a task counts before it passes counts on.
HELD = 3 << 18
#: Bits of a code; the last two tell words, bigrams and trigrams apart.
CODE = 48
_END, _START = mix(np.array([101, 102], U))
_LEFT, _RIGHT, _LEFT3, _RIGHT3 = mix(np.array([103, 104, 105, 106], U)) | U(1)


def code(h: np.ndarray, kind: int) -> np.ndarray:
    return h >> U(64 - CODE) & ~U(3) | U(kind)


def range_of(codes: np.ndarray, ranges: int) -> np.ndarray:
    """The range that a code falls in; rises with the code."""
    return ((codes >> U(CODE - 32)) * U(ranges) >> U(32)).astype(np.int64)


def sequences(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, words, bigram codes, trigram codes, where each text's words begin) for runs of texts.

    A value for each word; a text's first word ends no trigram, and the value there means nothing.
    """
    for row, end, data, at in goes(column, HASHED):
        h, of = word_hashes(data, at)
        ends = of[1:] + np.arange(1, end - row + 1)  # behind each text's words
        inner = np.ones(len(h) + end - row, bool)
        inner[ends - 1] = False
        tokens = np.empty(len(inner), U)
        tokens[inner] = h
        tokens[~inner] = _END
        first = np.concatenate([[0], ends[:-1]])
        before = np.concatenate([[_START], tokens[:-1]]).astype(U)
        before[first] = _START
        pairs = mix(before * _LEFT + tokens * _RIGHT)
        triples = mix(np.concatenate([[U(0)], pairs[:-1]]) * _LEFT3 + tokens * _RIGHT3)
        yield row, end, tokens, code(pairs, 1), code(triples, 2), first


def _counted(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate([*values, np.zeros(0, U)]), return_counts=True)


def _many(data: np.ndarray, at: np.ndarray) -> pa.BinaryArray:
    """The values that begin at `at` in data, with one end more."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.array(at).cast(pa.int32()).buffers()[1], pa.py_buffer(np.ascontiguousarray(data))])


def _flat(column: pa.BinaryArray) -> tuple[memoryview, np.ndarray]:
    """The bytes of all values of a column, and where each begins, with one end more."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return memoryview(column.buffers()[2] or b"")[at[0] : at[-1]], at - at[0]


def _spread(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1 and so on, n[0] of them, then those from at[1]."""
    return np.arange(n.sum()) + np.repeat(at - (np.cumsum(n) - n), n)


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of sorted h, and the sum of n of each."""
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[at], np.add.reduceat(n, at, dtype=np.int64) if len(h) else np.zeros(0, np.int64)


def _pack(sorted_: np.ndarray, at: np.ndarray | None = None) -> bytes | pa.BinaryArray:
    """Sorted values as the first, steps of four bytes, the few larger steps, and their number; with at, the pieces that begin there, with one end more.

    No piece is empty.  All of them are made in a few array passes, as there is one for each run of texts and part.
    """
    many, at = at is not None, np.array([0, len(sorted_)]) if at is None else np.asarray(at)
    n, head = np.diff(at), at[:-1]
    step = np.diff(sorted_, prepend=U(0))
    large = step >= U(0xFFFFFFFF)
    large[head] = False
    above = np.add.reduceat(large, head, dtype=np.int64)
    end = np.cumsum(n + 3 + 2 * above)  # in units of four bytes
    begin = end - (n + 3 + 2 * above)
    out = np.empty(end[-1], np.uint32)
    small = np.where(large, U(0xFFFFFFFF), step).astype(np.uint32)
    out[np.arange(len(step)) + np.repeat(begin + 1 - head, n)] = small  # the first one's place is taken next
    out[begin], out[begin + 1] = sorted_[head].astype(np.uint32), (sorted_[head] >> U(32)).astype(np.uint32)
    out[_spread(begin + 1 + n, 2 * above)] = step[large].view(np.uint32)
    out[end - 2], out[end - 1] = n, 0
    return _many(out, 4 * np.append(begin, end[-1])) if many else out.tobytes()


def _unpack(data: memoryview | pa.BinaryArray) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """What _pack took; of a column, the values of all pieces one after another, and how many each has."""
    many = isinstance(data, pa.BinaryArray)
    data, at = _flat(data) if many else (data, np.array([0, len(data)]))
    packed, begin, end = np.frombuffer(data, np.uint32), at[:-1] // 4, at[1:] // 4
    n = packed[end - 2].astype(np.int64)
    above = (end - begin - 3 - n) // 2
    head = np.cumsum(n) - n
    step = packed[np.arange(n.sum()) + np.repeat(begin + 1 - head, n)].astype(U)
    step[head] = 0
    if above.any():
        step[step == 0xFFFFFFFF] = packed[_spread(begin + 1 + n, 2 * above)].view(U)
    out = np.cumsum(step, dtype=U)
    out += np.repeat((packed[begin] | packed[begin + 1].astype(U) << U(32)) - out[head], n)
    return (out, n) if many else out


def _upto(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """h with counts of one byte: what occurs more than 255 times stands several times."""
    times = -(-n // 255)
    out = np.full(times.sum(), 255, np.uint8)
    out[np.cumsum(times) - 1] = n - 255 * (times - 1)
    return np.repeat(h, times), out


def _wide(ranges: int) -> int:
    """How many ranges make a part."""
    return max(1, min(WIDEST, ranges // PARTS))


def _least(ranges: int, of: range) -> np.ndarray:
    """The least upper 32 bits of the codes of some ranges."""
    return ((np.arange(of.start, of.stop, of.step, dtype=U) << U(32)) + U(ranges - 1)) // U(ranges)


def _cuts(codes: np.ndarray, ranges: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts, of `wide` ranges each, that sorted codes fall in, and where each begins, with one end more."""
    at = np.append(np.searchsorted(codes, _least(ranges, range(0, ranges, wide)) << U(CODE - 32)), len(codes))
    held = np.flatnonzero(np.diff(at))
    return held, np.append(at[held], len(codes))


def _groups(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of rows with equal keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.append(np.flatnonzero(new), len(new)).tolist()
    return zip(at[:-1], at[1:])


def _slices(column: pa.BinaryArray, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Rows a to b in slices of about SLICE bytes."""
    at = _flat(column[a:b])[1]
    while a < b:
        end = a + max(1, int(np.searchsorted(at, at[0] + SLICE, "right")) - 1)
        yield a, end
        at, a = at[end - a :], end


def _tasks(df: DataFrame, ranges: int) -> int:
    """Shuffle partitions: some 16 ranges each, and no fewer than others have."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), ranges // 16)


def count_ngrams(docs: DataFrame, ranges: int) -> DataFrame:
    """A row for each range that n-grams of docs (text) fall in: part, bits (its segment), word and n (exact counts of its words)."""
    kinds, wide = "part long, kind int, h binary, n binary", _wide(ranges)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[np.ndarray] = []
        grams: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, (h, n) in enumerate((_counted(words), _counted(grams))):
                if len(h):
                    h, n = _upto(h, n)
                    parts, at = _cuts(h if kind else code(h, 0), ranges, wide)
                    yield pa.RecordBatch.from_arrays([pa.array(parts), pa.array(np.full(len(parts), kind, np.int32)), _pack(h, at), _many(n, at)], ["part", "kind", "h", "n"])
            words.clear(), grams.clear()

        for batch in batches:
            for _, _, tokens, pairs, triples, first in sequences(batch["text"]):
                words.append(tokens)
                grams += [pairs, np.delete(triples, first)]
                if sum(map(len, words)) > HELD:
                    yield from flush()
        yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by part and kind."""
        here, held = None, ([], [])

        def done() -> Iterator[pa.RecordBatch]:
            if here is None:
                return
            h, n = (np.concatenate([x[k] for x in held[0]] + [np.zeros(0, t)]) for k, t in enumerate((U, np.uint8)))
            order = np.argsort(h)
            words = _summed(h[order], n[order])
            both = np.concatenate([*held[1], np.zeros(0, U)])
            held[1].clear()
            both.sort()
            of = range(here * wide, min((here + 1) * wide, ranges))
            cut = [np.append(np.searchsorted(x, _least(ranges, of) << U(up)), len(x)) for x, up in ((words[0], 32), (both, CODE - 32 + 8))]
            for k, part in enumerate(of):
                a, b = cut[0][k : k + 2]
                word, many = words[0][a:b], words[1][a:b]
                a, b = cut[1][k : k + 2]
                gram, more = _summed(both[a:b] >> U(8), both[a:b] & U(0xFF))
                if len(word) + len(gram):
                    bits = Filter.segment(np.concatenate([code(word, 0), gram]), np.searchsorted(EDGES, np.concatenate([many, more]), "right"))
                    yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([bits], pa.binary()), pa.array([word.view(np.int64)], pa.list_(pa.int64())), pa.array([many], pa.list_(pa.int64()))], ["part", "bits", "word", "n"])

        for batch in batches:
            part, kind = batch["part"].to_numpy(), batch["kind"].to_numpy()
            for a, b in _groups(part, kind):
                if part[a] != here:
                    yield from done()
                    here, held = int(part[a]), ([], [])
                for a, b in _slices(batch["h"], a, b):
                    h, n = _unpack(batch["h"][a:b])[0], np.frombuffer(_flat(batch["n"][a:b])[0], np.uint8)
                    held[kind[a]].append(h << U(8) | n if kind[a] else (h, n.copy()))  # a code and its count are less than 64 bits
        yield from done()

    told = docs.select("text").mapInArrow(count, kinds).repartition(_tasks(docs, ranges), "part").sortWithinPartitions("part", "kind")
    return told.mapInArrow(merge, "part long, bits binary, word array<long>, n array<long>")


#: The bits of a word that an entry sets, for each value of 16 hash bits.
_MARK_MASK = np.bitwise_or.reduce(U(1) << (mix(np.arange(PROBES << 16, dtype=U)).reshape(-1, PROBES) & U(63)), axis=1)


class Filter:
    """A Bloom filter in segments, whose entries set PROBES bits of one 64-bit word, and levels of n-grams by probing."""

    def __init__(self, ranges: int, words: np.ndarray, at: np.ndarray, first: int = 0):
        """words: the bits of the segments of ranges from `first` on, which begin at `at`, with one end more."""
        self.ranges, self.words, self.at, self.first = ranges, words, at, first

    @staticmethod
    def _place(codes: np.ndarray, level: np.ndarray | int, size: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Word in its segment, of so many words, and kind of mark of an entry."""
        r = mix(codes ^ (np.asarray(level).astype(U) * U(0x9FB21C651E98DF25)))
        return ((r >> U(32)) * np.asarray(size).astype(U) >> U(32)).astype(np.int64), (r & U(0xFFFF)).astype(np.int64)

    @classmethod
    def segment(cls, codes: np.ndarray, level: np.ndarray) -> bytes:
        """The bits of a segment that holds n-grams up to the given levels."""
        size = -(-int(level.sum()) * BITS // 64)
        step = np.arange(level.sum()) - np.repeat(np.cumsum(level) - level, level) + 1
        word, mark = cls._place(np.repeat(codes, level), step, size)
        both = np.sort(word << 16 | mark)
        word, mask = both >> 16, _MARK_MASK[both & 0xFFFF]
        out, at = np.zeros(size, U), np.flatnonzero(np.diff(word, prepend=-1))
        if len(at):
            out[word[at]] = np.bitwise_or.reduceat(mask, at)
        return out.tobytes()

    def level(self, codes: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
        """The level of each n-gram; `most`: levels that it can't exceed, which aren't probed."""
        out = np.zeros(len(codes), np.int64)
        one = len(self.at) == 2
        part = np.zeros(1, np.int64) if one else range_of(codes, self.ranges) - self.first
        base = self.at[part]
        size = self.at[part + 1] - base
        live = np.flatnonzero(np.broadcast_to(size > 0, len(codes)) if most is None else (size > 0) & (most > 0))
        codes, level = codes[live], 0
        if not one:
            base, size = base[live], size[live]
        while len(live):
            level += 1
            word, mark = self._place(codes, level, size)
            mask = _MARK_MASK[mark]
            hit = (self.words[base + word] & mask) == mask
            out[live[hit]] = level
            if most is not None:
                hit &= most[live] > level
            live, codes = live[hit], codes[hit]
            if not one:
                base, size = base[hit], size[hit]
        return out


#: 1, 2, 3, 4, 5, 7, 9 and so on: the counts at which levels rise.
EDGES = np.unique(np.ceil(BASE ** np.arange(150) - 1e-9))


class Model:
    """What scoring needs: the filter, the commonest words' counts, and the totals.

    apart: the segments (part, bits) of a filter too large to send; `filter` is none then.
    """

    def __init__(self, filter_: Filter | None, ranges: int, apart: DataFrame | None, frequent: tuple[np.ndarray, np.ndarray], tokens: int, distinct: int, texts: int, low_tokens: float):
        self.filter, self.ranges, self.apart, self.frequent = filter_, ranges, apart, frequent
        self.tokens, self.distinct, self.texts, self.low_tokens = tokens, distinct, texts, low_tokens

    def __getstate__(self) -> dict:
        return self.__dict__ | {"apart": None}  # a table isn't sent

    def log_p(self, word: np.ndarray, first: np.ndarray, look: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
        """log10 p3 of each word; word: their levels; look: those of the bigrams (1) or trigrams (2) that end there, each at most as given."""
        low = np.concatenate([[0.0], EDGES])
        high = np.concatenate([[0.0], EDGES[1:] - 1.0])  # the next edge less 1
        earlier = lambda x: np.concatenate([[0], x[:-1]])
        # an n-gram occurs no more often than its parts do, so higher levels needn't be probed
        most = np.minimum(word, earlier(word))
        most[first] = word[first]
        pair = look(1, most)
        most = np.minimum(pair, earlier(pair))
        most[first] = 0
        triple = look(2, most)
        seen = high[earlier(word)]
        seen[first] = self.texts
        p = (low[word] + 1) / (self.low_tokens + self.distinct + 1)
        p = _backed(low[pair], seen, p)
        seen = high[earlier(pair)]
        seen[first] = 0
        return np.log10(_backed(low[triple], seen, p))


def _backed(low: np.ndarray, seen: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    p = WEIGHT * np.minimum(np.maximum(low - DISCOUNT, 0) / np.maximum(seen, 1.0), 1.0) + (1 - WEIGHT) * shorter
    return np.where(seen > 0, p, shorter)


#: Counts below this are told apart one by one.
EXACT = 10_000


def _settled(made: DataFrame) -> DataFrame:
    """made, a written table; Spark deletes the shuffle files of finished plans once these are collected."""
    gc.collect()
    made.sparkSession.sparkContext._jvm.System.gc()
    return made


def fit(train: DataFrame, filter_bytes: int = FILTER_BYTES, frequent: int = FREQUENT) -> tuple[Model, DataFrame]:
    """The model of texts `train` (text), and the exact counts of its words (h, n)."""
    ranges = 1 + int(train.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES
    made = _settled(written(count_ngrams(train, ranges), "ngrams"))
    words = made.select(F.explode(F.arrays_zip(F.col("word").alias("h"), "n")).alias("x")).select("x.h", "x.n")
    above = F.when(F.col("n") >= EXACT, F.element_at(F.filter(F.array(*(F.lit(float(x)) for x in EDGES)), lambda x: x <= F.col("n")), -1))
    totals = words.agg(F.sum("n"), F.count(F.lit(1)), F.sum(above), F.sum(F.when(F.col("h") == int(_END.astype(np.int64)), F.col("n")))).first()
    # EXACT rows at most, whatever the corpus
    sizes = words.groupBy(F.least("n", F.lit(EXACT)).alias("n")).agg(F.count(F.lit(1)).alias("many")).collect()
    low_tokens = sum(EDGES[np.searchsorted(EDGES, r.n, "right") - 1] * r.many for r in sizes if r.n < EXACT) + (totals[2] or 0.0)
    filter_, apart = None, None
    if (made.agg(F.sum(F.length("bits"))).first()[0] or 0) > filter_bytes:
        apart = made.select("part", "bits")
    else:
        bits = {r.part: np.frombuffer(r.bits, U) for r in made.select("part", "bits").toLocalIterator()}
        at = np.concatenate([[0], np.cumsum([len(bits.get(k, ())) for k in range(ranges)])]).astype(np.int64)
        filter_ = Filter(ranges, np.concatenate([*(bits[k] for k in sorted(bits)), np.zeros(0, U)]), at)
    least, room = EXACT + 1, frequent
    for r in sorted(sizes, key=lambda r: -r.n):
        if (room := room - r.many) < 0:
            break
        least = r.n
    if room < 0 and least > EXACT and r.n == EXACT:
        # more than `frequent` words are beyond EXACT: those commoner than the next one after so many
        least = 1 + words.where(F.col("n") >= EXACT).select("n").orderBy(F.desc("n")).limit(frequent + 1).agg(F.min("n")).first()[0]
    common = words.where(F.col("n") >= least).toPandas()
    h = common.h.to_numpy(np.int64).view(U)
    order = np.argsort(h)
    model = Model(filter_, ranges, apart, (h[order], common.n.to_numpy(np.int64)[order]), totals[0] or 0, totals[1], totals[3] or 0, low_tokens)
    return model, words.where(F.col("n") < least)


def _told(m: Model, batch: pa.RecordBatch, keep: list[str], uid: int, runs: Iterator[tuple], levels: Iterator[tuple] | None = None) -> pa.RecordBatch:
    """What the model tells of the texts of a batch, in runs as `sequences` gives them; levels: of the n-grams of each run, where they have been looked up."""
    known_h, known_n = m.frequent
    log_all = np.log10(m.tokens + m.distinct + 1)
    n_tokens, n_known = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
    base, total = np.zeros(len(batch)), np.zeros(len(batch))
    rest_h: list[np.ndarray] = []
    rest_at = [np.zeros(1, np.int64)]
    for row, end, tokens, pairs, triples, first in runs:
        kinds, at = np.unique(tokens, return_inverse=True)
        if levels is None:
            word, look = m.filter.level(code(kinds, 0))[at], lambda n, most: m.filter.level((tokens, pairs, triples)[n], most)
        else:
            known = next(levels)
            word, look = known[0], lambda n, most: np.minimum(known[n], most)
        total[row:end] = np.add.reduceat(m.log_p(word, first, look), first)
        n_tokens[row:end] = np.diff(first, append=len(tokens))
        if len(known_h):
            near = np.minimum(np.searchsorted(known_h, kinds), len(known_h) - 1)
            found = known_h[near] == kinds
            n = np.where(found, known_n[near], 0)[at]
            found = found[at]
        else:
            n, found = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
        base[row:end] = np.add.reduceat(np.where(found, np.log10(n + 1) - log_all, 0.0), first)
        n_known[row:end] = np.add.reduceat((found & (n > 0)).astype(np.int64), first)
        rest_h.append(tokens[~found])
        rest_at.append(np.add.reduceat((~found).astype(np.int64), first))
    flat = np.concatenate([*rest_h, np.zeros(0, U)]).view(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(rest_at)).astype(np.int32)), pa.array(flat))
    out = [pa.array(np.arange(uid, uid + len(batch))), pa.array(n_tokens), pa.array(n_known), pa.array(base), pa.array(total), lists]
    return pa.RecordBatch.from_arrays([batch[c] for c in keep] + out, names=[*keep, "_uid", "n_tokens", "n_known", "base_score", "score", "_rest"])


def _coded(runs: list[tuple]) -> tuple[np.ndarray, Callable[[np.ndarray], Iterator[tuple]]]:
    """The distinct codes of all n-grams of runs of texts, sorted, and from their levels to those of each run's words, bigrams and trigrams."""
    parts = [x for _, _, tokens, pairs, triples, _ in runs for x in (code(tokens, 0), pairs, triples)]
    codes = np.concatenate(parts)
    bits = len(codes).bit_length()
    cut = U(max(0, CODE + bits - 64))  # where a code and its place are more than 64 bits, codes are sorted by their upper bits
    order = (np.sort(codes >> cut << U(bits) | np.arange(len(codes), dtype=U)) & U((1 << bits) - 1)).astype(np.int64)
    if (codes[order[1:]] < codes[order[:-1]]).any():  # two differ in the lowest bits alone
        order = np.argsort(codes)
    codes = codes[order]
    new = np.concatenate([[True], codes[1:] != codes[:-1]])

    def back(level: np.ndarray) -> Iterator[tuple]:
        out = np.empty(len(codes), np.uint8)
        out[order] = level[np.cumsum(new) - 1]
        cut = iter(np.split(out, np.cumsum([len(x) for x in parts])[:-1]))
        return zip(cut, cut, cut)

    return codes[new], back


def _apart(docs: DataFrame, model: Model, sent: Broadcast, keep: list[str], schema: str) -> DataFrame:
    """As _told for all docs, where the filter is a table."""
    ranges, names, wide = model.ranges, ["part", "run", "data"], _wide(model.ranges)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of each run, in one value; a run's number is the _uid of its first row."""
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            at, row = utf8(batch["text"])[1], 0
            while row < len(batch):
                end = max(row + 1, int(np.searchsorted(at, at[row] + RUN_BYTES, "right")) - 1)
                texts = pa.BufferOutputStream()
                with pa.ipc.new_stream(texts, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                    to.write_batch(batch.slice(row, end - row))
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([uid + row], pa.int64()), pa.array([texts.getvalue().to_pybytes()], pa.binary())], names)
                row = end
            uid += len(batch)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The n-grams of each run, by part."""
        for batch in batches:
            for run, data in zip(batch["run"].to_pylist(), batch["data"]):
                for texts in pa.ipc.open_stream(data.as_buffer()):
                    codes = _coded(list(sequences(texts["text"])))[0]
                    parts, at = _cuts(codes, ranges, wide)
                    yield pa.RecordBatch.from_arrays([pa.array(parts), pa.array(np.full(len(parts), run)), _pack(codes, at)], names)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The levels of the n-grams of each part and run; the segments of a part (run < 0) come before them."""
        here, held = None, []
        for batch in batches:
            part, run = batch["part"].to_numpy(), batch["run"].to_numpy()
            for a, b in _groups(part):
                if part[a] != here:
                    here, held = part[a], [np.zeros(0, U)] * wide
                while a < b and run[a] < 0:
                    held[run[a]] = np.frombuffer(batch["data"][a].as_buffer(), U).copy()
                    a += 1
                if a < b and isinstance(held, list):
                    held = Filter(ranges, np.concatenate(held), np.cumsum([0, *map(len, held)]), int(here) * wide)
                for a, b in _slices(batch["data"], a, b):
                    codes, n = _unpack(batch["data"][a:b])
                    level = held.level(codes)
                    yield pa.RecordBatch.from_arrays([batch["part"][a:b], batch["run"][a:b], _many(level.astype(np.uint8), np.append(0, np.cumsum(n)))], names)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A run's texts come first, then its levels by part."""
        texts, uid, levels = None, 0, []

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal levels
            if texts is None:
                return
            for batch in pa.ipc.open_stream(texts):
                rows = list(sequences(batch["text"]))
                levels = _coded(rows)[1](np.frombuffer(b"".join(levels), np.uint8))
                yield _told(sent.value, batch, keep, uid, rows, levels)

        for batch in batches:
            part, run = batch["part"].to_numpy(), batch["run"].to_numpy()
            for a, b in _groups(run):
                if part[a] < 0:
                    yield from done()
                    texts, uid, levels, a = batch["data"][a].as_py(), int(run[a]), [], a + 1
                levels.append(bytes(_flat(batch["data"][a:b])[0]))
        yield from done()

    kind = "part long, run long, data binary"
    runs = written(docs.mapInArrow(cut, kind), "runs")
    # the segments of a part are numbered from -wide to -1
    held = model.apart.select(F.floor(F.col("part") / wide).alias("part"), (F.col("part") % wide - wide).alias("run"), F.col("bits").alias("data"))
    found = None
    for turn in range(TURNS):
        some = runs.where(F.pmod(F.xxhash64("run"), F.lit(TURNS)) == turn)
        told = _settled(written(held.unionByName(some.mapInArrow(ask, kind)).repartition(_tasks(docs, ranges), "part").sortWithinPartitions("part", "run").mapInArrow(probe, kind), "found"))
        found = told if found is None else found.unionByName(told)
    return runs.unionByName(found).repartition(_tasks(docs, ranges), "run").sortWithinPartitions("run", "part").mapInArrow(finish, schema)


RESULTS = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]


def score(docs: DataFrame, model: Model, rare: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...), but for text, with n_tokens, n_known, train_tokens, base_score and score."""
    docs, opened = boxed(docs, ["doc_id", "text"], [*RESULTS, "text"])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            yield _told(sent.value, batch, keep, uid, sequences(batch["text"]))
            uid += len(batch)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    schema = f"{kinds}, _uid long, n_tokens long, n_known long, base_score double, score double, _rest array<long>"
    # written, since _uid must not change between the two uses
    told = written(docs.mapInArrow(run, schema) if model.apart is None else _apart(docs, model, sent, keep, schema), "scored")
    log_all = float(np.log10(model.tokens + model.distinct + 1))
    rest = told.select("_uid", F.explode("_rest").alias("h")).groupBy("_uid", "h").agg(F.count(F.lit(1)).alias("m"))
    rest = rest.join(rare, "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rest = rest.groupBy("_uid").agg(F.sum(F.col("m") * (F.log10(F.col("n") + 1) - log_all)).alias("_base"), F.sum(F.when(F.col("n") > 0, F.col("m")).otherwise(0)).alias("_known"))
    out = told.drop("_rest").join(rest, "_uid", "left")
    out = out.withColumns({
        "base_score": F.col("base_score") + F.coalesce("_base", F.lit(0.0)), "n_known": F.col("n_known") + F.coalesce("_known", F.lit(0)), "train_tokens": F.lit(model.tokens).cast("long"),
    }).drop("_uid", "_base", "_known", "text")
    return opened(out, RESULTS)


def op6_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_bucket(F.col("doc_id"), 7) == 2
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model, rare = fit(docs.where(~held_out))
    out = score(docs, model, rare).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
