"""Operator 5, line dedup: sharded cuckoo filters over exact reference-count tables.

A line's key is the line stripped of ASCII white space with A-Z lower-cased.  A key of MIN_CHARS
code points or more that at least two documents hold is *shared*: all its lines go, except in the
smallest doc_id that holds it.

State, all of it tables in a folder, cut into shards:
  docs     (part, doc_id, h1, h2)   each document's distinct keys, as 128 bits, by the hash of doc_id: what a deletion takes back
  keys     (part, h1, h2, doc_id)   the same rows by the hash of the key: who holds a key
  gone     (doc_id)                 deleted documents, each table with the segments of docs and keys that it is later than
  counts   (part, h1, h2, n_docs, first_doc)   the exact reference counts of a key shard
  filters  (part, blob)             a cuckoo filter of a key shard's shared keys
An insertion adds a segment to docs and keys, a deletion a table to gone; both read and write counts and filters of those
key shards alone that their documents' keys fall in.  A key that becomes shared is added to its shard's filter, one that
is no longer shared is taken out, so a deletion undoes its insertion; a filter that is full is built anew from its shard's
counts, and when shards have grown beyond four times their size, or segments beyond SEGMENTS, all is rewritten once.
What describes the state changes last, so a failed step leaves the state before it.

In use, the filters rule out nearly all lines that no other document holds, and only the rest meet the exact table, so a
filter's false positives never show.  While they are under `broadcast_bytes` they are sent to the workers; larger ones
are probed shard by shard, where lines and filters of a shard meet in SALTS tasks, with the same result.

Nulls and edges: null or empty text is one empty line; rows with a null doc_id keep all their lines
and count for nothing; rows that repeat a doc_id count as one document; a key that ties goes to the smallest doc_id; a very
long text is taken whole, its lines one row each; other columns stay, but those named as result columns give way
to them; an empty table gives none; a doc_id that isn't a whole number is refused (ValueError).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, boxed, table, whole_ids, work_dir

MIN_CHARS = 10
#: Shared keys that a shard holds on average; a shard's filter is then about 170 KB.
SHARD_KEYS = 1 << 16
BROADCAST_BYTES = 48 << 20
FULL = 0.8
U = np.uint64


class Cuckoo:
    """A cuckoo filter of 64-bit hashes: buckets of four 16-bit fingerprints, 0 for free."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots
        self.mask = len(slots) - 1

    @classmethod
    def sized(cls, n: int) -> Cuckoo:
        return cls(np.zeros((1 << max(2, int(np.ceil(np.log2(max(n, 1) / 4 / FULL)))), 4), np.uint16))

    @classmethod
    def loads(cls, blob: bytes) -> Cuckoo:
        return cls(np.frombuffer(blob, np.uint16).reshape(-1, 4).copy())

    def dumps(self) -> bytes:
        return self.slots.tobytes()

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = np.maximum(h >> U(48), U(1)).astype(np.uint16)
        at = (h & U(self.mask)).astype(np.int64)
        return mark, at, self._other(at, mark)

    def _other(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return at ^ ((mark.astype(np.int64) * 0x5BD1E995) >> 8 & self.mask)

    def add(self, h: np.ndarray) -> bool:
        """All at once, in rounds: free slots fill, and where none is left one entry of each full
        bucket makes room and goes on to its other bucket.  False: too full; make a larger one."""
        mark, at, _ = self._places(h)
        for turn in range(400):
            if not len(mark):
                return True
            order = np.argsort(at, kind="stable")
            mark, at = mark[order], at[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            free = self.slots[at] == 0
            nth = np.cumsum(free, axis=1) - 1
            hit = free & (nth == rank[:, None])
            fits = hit.any(axis=1)
            self.slots[at[fits], hit[fits].argmax(axis=1)] = mark[fits]
            mark, at, rank = mark[~fits], at[~fits], rank[~fits]
            if turn % 2:  # every other round, else just try the other bucket
                lead = np.unique(at, return_index=True)[1]
                slot = (turn // 2 + at[lead]) % 4
                out = self.slots[at[lead], slot].copy()
                self.slots[at[lead], slot] = mark[lead]
                mark[lead] = out
            at = self._other(at, mark)
        return False

    def remove(self, h: np.ndarray) -> None:
        """Takes one entry out for each hash, all of which must have been added."""
        for mark, *places in zip(*self._places(h)):
            for at in places:
                found = np.flatnonzero(self.slots[at] == mark)
                if len(found):
                    self.slots[at, found[0]] = 0
                    break

    def __contains__(self, h: int) -> bool:
        return bool(self.has(np.array([h], U))[0])

    def has(self, h: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(h)
        return ((self.slots[a] == mark[:, None]) | (self.slots[b] == mark[:, None])).any(axis=1)


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    """A row for each line whose key is long enough: doc_id, position from 0, key as two hashes."""
    line = docs.select("doc_id", *more, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    line = line.withColumn("line", ascii_lower(F.trim("line", F.lit(SPACE)))).where(F.char_length("line") >= MIN_CHARS)
    return line.select("doc_id", *more, "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _part(n: int, of: str = "h1") -> Column:
    return F.pmod(F.shiftright("h1", 16) if of == "h1" else F.xxhash64(of), F.lit(n)).cast("int")


#: Segments after which all tables are rewritten as one, and tasks that a shard's lines are dealt over when filters aren't sent.
SEGMENTS, SALTS = 16, 8
_KEYS = "part int, h1 long, h2 long, doc_id long"
_COUNTS = "part int, h1 long, h2 long, n_docs long, first_doc long"
_FILTERS = "part int, blob binary"


class LineDedup:
    """Documents come and go (`insert`, `delete`); `apply` drops the shared lines of some of them."""

    def __init__(self, spark: SparkSession, path: str | None = None, broadcast_bytes: int = BROADCAST_BYTES, shard_keys: int = SHARD_KEYS):
        self.spark, self.broadcast_bytes, self.shard_keys = spark, broadcast_bytes, shard_keys
        self.path = path or f"{work_dir(spark)}/siftwarden-lines-{uuid.uuid4().hex}"
        #: docs, keys: segments; gone: (table, how many segments it is later than); counts, filters: the table of each shard.
        self.now: dict = {"shards": 0, "shared": 0, "docs": [], "keys": [], "gone": [], "counts": {}, "filters": {}}

    def describe(self) -> str:
        """The state as text: table paths and sizes, enough to open it again with `open_at`."""
        return json.dumps(self.now)

    def open_at(self, described: str) -> LineDedup:
        self.now = json.loads(described)
        return self

    def _put(self, name: str, df: DataFrame, shards: bool = True) -> str:
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        out = df.repartition("part", F.pmod(F.xxhash64(*[c for c in df.columns if c != "part"]), F.lit(SALTS))) if shards and name in ("docs", "keys") else df
        (out.write.partitionBy("part") if shards else out.write).parquet(path)
        return path

    def _segments(self, state: dict, name: str, parts: list[int] | None) -> DataFrame:
        """Live rows of docs or keys, of some parts or all."""
        out = self.spark.createDataFrame([], f"{_KEYS}, _segment int")
        for k, path in enumerate(state[name]):
            out = out.unionByName(self.spark.read.schema(_KEYS).parquet(path).withColumn("_segment", F.lit(k)))
        out = out if parts is None else out.where(F.col("part").isin(parts))
        if state["gone"]:
            gone = None
            for path, later in state["gone"]:
                one = self.spark.read.parquet(path).withColumn("_later", F.lit(later))
                gone = one if gone is None else gone.unionByName(one)
            gone = gone.groupBy("doc_id").agg(F.max("_later").alias("_later"))
            out = out.join(gone, "doc_id", "left").where("_later is null or _segment >= _later").drop("_later")
        return out.drop("_segment")

    def _of_shards(self, state: dict, name: str, schema: str, parts: list[int] | None = None) -> DataFrame:
        """Rows of counts or filters, of some shards or all, from the table that each shard has now."""
        by: dict[str, list[int]] = {}
        for part, path in state[name].items():
            if parts is None or int(part) in parts:
                by.setdefault(path, []).append(int(part))
        out = self.spark.createDataFrame([], schema)
        for path, some in by.items():
            out = out.unionByName(self.spark.read.schema(schema).parquet(path).where(F.col("part").isin(some)))
        return out

    @staticmethod
    def _parts(df: DataFrame) -> list[int]:
        """The shards in df: as many as there are shards at most."""
        return sorted(r.part for r in df.select("part").distinct().collect())

    def insert(self, docs: DataFrame) -> None:
        """Documents that are already in are taken as they were."""
        whole_ids(docs)
        new = _keyed(docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("h1", "h2", "doc_id").dropDuplicates()
        state = json.loads(self.describe())
        if not state["shards"]:
            self._rebuild(new)
            return
        n = state["shards"]
        here = new.withColumn("part", _part(n, "doc_id"))
        known = self._segments(state, "docs", self._parts(here)).select("doc_id").distinct()
        segment = self._put("docs", here.join(known, "doc_id", "left_anti").select("part", "h1", "h2", "doc_id"))
        fresh = self.spark.read.schema(_KEYS).parquet(segment).withColumn("part", _part(n))
        state["docs"].append(segment)
        state["keys"].append(self._put("keys", fresh))
        self._settle(state, self._parts(self.spark.read.schema(_KEYS).parquet(state["keys"][-1])))

    def delete(self, doc_ids: DataFrame) -> None:
        state = json.loads(self.describe())
        if not state["shards"]:
            return
        whole_ids(doc_ids)
        gone = self._put("gone", doc_ids.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), shards=False)
        out = self.spark.read.parquet(gone)
        held = self._segments(state, "docs", self._parts(out.withColumn("part", _part(state["shards"], "doc_id")))).join(out, "doc_id", "left_semi")
        parts = self._parts(held.withColumn("part", _part(state["shards"])))
        state["gone"].append([gone, len(state["docs"])])
        self._settle(state, parts)

    def _settle(self, state: dict, parts: list[int]) -> None:
        """Counts and filters of the shards that changed; then the state is the new one."""
        if len(state["docs"]) + len(state["gone"]) > SEGMENTS:
            self._rebuild(self._segments(state, "docs", None).select("h1", "h2", "doc_id"))
            return
        if parts:
            before = self._of_shards(self.now, "counts", _COUNTS, parts).where("n_docs >= 2").select("part", "h1", "h2", F.lit(True).alias("was"))
            path = self._put("counts", _counted(self._segments(state, "keys", parts)))
            state["counts"] |= dict.fromkeys(map(str, parts), path)
            shared = self._of_shards(state, "counts", _COUNTS, parts).where("n_docs >= 2").select("part", "h1", "h2")
            change = shared.withColumn("is", F.lit(True)).join(before, ["part", "h1", "h2"], "full").where("was is null or is is null").select("part", "h1", F.col("is").isNotNull().alias("enters"))
            made = self._put("filters", self._of_shards(state, "filters", _FILTERS, parts).groupBy("part").cogroup(change.groupBy("part")).applyInPandas(_turned, f"{_FILTERS}, more long"), shards=False)
            told = self.spark.read.parquet(made)
            state["shared"] += told.agg(F.sum("more")).first()[0] or 0
            full = [r.part for r in told.where("blob is null").collect()]
            state["filters"] |= dict.fromkeys(map(str, parts), made)
            if full:
                again = self._put("filters", _filters(shared.where(F.col("part").isin(full))), shards=False)
                state["filters"] |= dict.fromkeys(map(str, full), again)
        if state["shared"] > 4 * state["shards"] * self.shard_keys:
            self._rebuild(self._segments(state, "docs", None).select("h1", "h2", "doc_id"))
            return
        self.now = state

    def _rebuild(self, rows: DataFrame) -> None:
        """All tables anew, of one segment, with as many shards as the shared keys ask for."""
        flat = self.spark.read.parquet(self._put("rows", rows.select("h1", "h2", "doc_id"), shards=False))
        told = self.spark.read.parquet(self._put("told", _counted(flat.withColumn("part", F.lit(0))).drop("part"), shards=False))
        shared = told.where("n_docs >= 2").count()
        n = max(1, -(-shared // self.shard_keys))
        state = {"shards": n, "shared": shared, "gone": []}
        state["docs"] = [self._put("docs", flat.withColumn("part", _part(n, "doc_id")))]
        state["keys"] = [self._put("keys", flat.withColumn("part", _part(n)))]
        counts = self._put("counts", told.withColumn("part", _part(n)))
        filters = self._put("filters", _filters(told.where("n_docs >= 2").select("h1", _part(n).alias("part"))), shards=False)
        self.now = state | {"counts": dict.fromkeys(map(str, range(n)), counts), "filters": dict.fromkeys(map(str, range(n)), filters)}

    def _maybe_shared(self, lines: DataFrame) -> DataFrame:
        """The lines that pass their shards' filters."""
        n = max(1, self.now["shards"])
        filters = self._of_shards(self.now, "filters", _FILTERS)
        if (filters.agg(F.sum(F.length("blob"))).first()[0] or 0) > self.broadcast_bytes:
            return _probed(lines.withColumn("part", _part(n)), filters)
        sent = self.spark.sparkContext.broadcast({r.part: r.blob for r in filters.toLocalIterator()})

        @F.pandas_udf("boolean")
        def passes(h: pd.Series, shard: pd.Series) -> pd.Series:
            h, shard = h.to_numpy(np.int64).view(U), shard.to_numpy()
            out = np.zeros(len(h), bool)
            for k in np.unique(shard):
                if k in sent.value:
                    out[shard == k] = Cuckoo(np.frombuffer(sent.value[k], np.uint16).reshape(-1, 4)).has(h[shard == k])
            return pd.Series(out)

        return lines.where(passes("h1", _part(n)))

    def apply(self, docs: DataFrame, text: str = "kept_text") -> DataFrame:
        """docs with n_lines, n_dropped and the text that is left."""
        whole_ids(docs)
        docs, opened = boxed(docs, ["doc_id", "text"], ["n_lines", "n_dropped", text])
        same = F.xxhash64("text").alias("_same")  # rows that repeat a doc_id with another text stay apart
        lines = self._maybe_shared(_keyed(docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", same), "_same"))
        go = lines.join(self._of_shards(self.now, "counts", _COUNTS).where("n_docs >= 2").drop("part"), ["h1", "h2"]).where("doc_id > first_doc")
        go = go.groupBy("doc_id", "_same").agg(F.collect_set("pos").alias("_go"))
        out = docs.withColumn("_same", same).join(go, ["doc_id", "_same"], "left")
        n = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
        gone = F.coalesce(F.size("_go"), F.lit(0))
        out = out.withColumns({"n_lines": n.cast("long"), "n_dropped": gone.cast("long")})
        out = out.withColumn("_lines", F.split("text", "\n"))
        left = F.expr("array_join(transform(array_except(sequence(0, size(_lines) - 1), _go), i -> get(_lines, i)), '\\n')")
        out = out.withColumn("_left", F.when(F.col("_go").isNull(), F.coalesce("text", F.lit(""))).otherwise(left))
        return opened(out.withColumn(text, F.col("_left")), ["n_lines", "n_dropped", text])


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("part", "h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


def _filters(shared: DataFrame) -> DataFrame:
    """A filter for each shard of shared keys (part, h1), with room for as many again."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        room = max(2 * len(part), 16)
        while not (made := Cuckoo.sized(room)).add(part.h1.to_numpy(np.int64).view(U)):
            room *= 2
        return pd.DataFrame({"part": [part.part.iloc[0]], "blob": [made.dumps()]})

    return shared.select("part", "h1").groupBy("part").applyInPandas(build, _FILTERS)


def _turned(old: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter after keys enter and leave it, none if it has no room for them, and how many keys more it has."""
    h, enters = change.h1.to_numpy(np.int64).view(U), change.enters.to_numpy(bool)
    kept = Cuckoo.loads(old.blob.iloc[0]) if len(old) else Cuckoo.sized(max(2 * int(enters.sum()), 16))
    kept.remove(h[~enters])
    blob = kept.dumps() if kept.add(h[enters]) else None
    return pd.DataFrame({"part": [(old if len(old) else change).part.iloc[0]], "blob": [blob], "more": [int(enters.sum()) - int((~enters).sum())]})


def _probed(lines: DataFrame, filters: DataFrame) -> DataFrame:
    """The lines (part, h1, ...) that pass their shard's filter; a common line's shard is dealt over SALTS tasks."""
    names = [c for c in lines.columns if c != "part"]
    salted = lines.withColumns({"_salt": F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS)).cast("int"), "_blob": F.lit(None).cast("binary")})
    blobs = filters.select("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), F.col("blob").alias("_blob"))
    both = salted.unionByName(blobs, allowMissingColumns=True).repartition("part", "_salt").sortWithinPartitions("part", "_salt", F.col("_blob").isNull())

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's filter comes before its lines."""
        here, held = None, None
        for batch in batches:
            part, blob = batch["part"].to_numpy(zero_copy_only=False), batch["_blob"]
            keep = np.zeros(len(batch), bool)
            at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(batch) else []
            starts = np.union1d(at, np.flatnonzero(~blob.is_null().to_numpy(zero_copy_only=False))).astype(int)
            for a, b in zip(starts, np.append(starts[1:], len(batch))):
                if blob[a].is_valid:
                    here, held, a = part[a], Cuckoo(np.frombuffer(blob[a].as_buffer(), np.uint16).reshape(-1, 4).copy()), a + 1
                if part[a - 1 if a == b else a] == here and a < b:
                    keep[a:b] = held.has(batch["h1"][a:b].to_numpy(zero_copy_only=False).view(U))
            yield pa.RecordBatch.from_arrays([batch[c].filter(pa.array(keep)) for c in names], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.select(*names).schema)
    return both.mapInArrow(probe, kinds)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    store = LineDedup(spark)
    store.insert(docs)
    return store.apply(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
shared AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
told AS (
  SELECT k.*, coalesce(k.doc_id > s.first_doc, false) AS goes FROM keyed k LEFT JOIN shared s USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE goes)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT goes), '')) AS kept_sha256
FROM told GROUP BY doc_id
"""
