"""Operator 9, language ID: hyperdimensional profiles of letter trigrams.

Every letter has a random vector of DIM signs.  A trigram's vector binds (multiplies) its letters'
vectors, the first permuted (rolled) twice and the second once; a text's vector bundles (adds) the vectors
of all its trigrams, and a language's prototype bundles those of its training texts, each scaled to
length 1.  The prediction is the prototype with the largest cosine after the mean of all prototypes,
what languages have in common, is taken from prototypes and text alike; ties go to the first by name.

Letters fall into SYMBOLS - 1 symbols: a-z after lower-casing have their own, others share the rest by
code point; a run of anything else is one blank.  Trigrams are counted over whole texts.

Training texts are a bounded sample: about TRAIN_DOCS of each language, by a hash of doc_id, of the LANGUAGES that most
documents have; their vectors are summed by Spark, so that one row for each language and coordinate reaches the driver.

Nulls and edges: a null text or one without a letter is `und` with score 0; with nothing to learn from
every text is; rows with null lang are not learnt from; repeated rows count as often as they occur; a very long text is one
array of its letters, which its task must hold; columns of docs stay, but those named lang_pred or score give way; an
empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, id_bucket, table

DIM = 1024
SYMBOLS = 64
#: Documents of a language that are learnt from, and languages that are: a model of LANGUAGES * DIM numbers at most.
TRAIN_DOCS, LANGUAGES = 2_000, 1_000
SEED = 9
UNKNOWN = "und"
_kept: dict[str, np.ndarray] = {}


def _symbols() -> np.ndarray:
    """Code point to symbol; 0 for what isn't a letter.  Made once for each worker."""
    if "symbols" not in _kept:
        out = np.zeros(0x110000, np.uint8)
        letters = np.array([c for c in range(0x110000) if chr(c).isalpha()])
        lower = np.array([ord(chr(c).lower()[0]) for c in letters])
        out[letters] = np.where((lower >= 97) & (lower < 123), lower - 96, 27 + lower % (SYMBOLS - 27))
        _kept["symbols"] = out
    return _kept["symbols"]


def letter_vectors(dim: int = DIM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The signs of each symbol as a trigram's first, second and third letter."""
    own = np.random.default_rng(SEED).integers(0, 2, (SYMBOLS, dim), dtype=np.int8) * 2 - 1
    return np.roll(own, 2, axis=1), np.roll(own, 1, axis=1), own


def trigrams(text: str) -> np.ndarray:
    """Code of each trigram of symbols, blanks around each run of letters included."""
    s = _symbols()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    s = np.concatenate([[0], s, [0]]).astype(np.int32)
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]  # runs of blanks: one
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:] if len(s) > 2 else np.zeros(0, np.int32)


def vector(text: str | None, letters: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray | None:
    """The bundle of a text's trigrams; none without a letter."""
    codes = np.sort(trigrams(text)) if text else np.zeros(0, np.int32)
    if not len(codes):
        return None
    at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    count = np.diff(at, append=len(codes)).astype(np.float32)
    codes = codes[at]
    a, b, c = letters
    bound = a[codes // (SYMBOLS * SYMBOLS)] * b[codes // SYMBOLS % SYMBOLS] * c[codes % SYMBOLS]
    return count @ bound.astype(np.float32)


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS, dim: int = DIM) -> dict[str, np.ndarray]:
    """Prototypes by language from docs (doc_id, text, lang)."""
    docs = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    per = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).select("lang", (F.lit(float(train_docs)) / F.col("n")).alias("part"))
    drawn = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = docs.join(F.broadcast(per), "lang").where(drawn < F.col("part")).select("lang", "text")  # a row for each language

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                v = vector(text, letter_vectors_kept(dim))
                if v is not None:
                    sums[lang] = sums.get(lang, 0) + v / max(np.linalg.norm(v), 1e-9)
        langs = np.repeat(np.array(list(sums), object), dim)
        at = np.tile(np.arange(dim), len(sums))
        yield pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "at": pa.array(at, pa.int32()), "v": pa.array(np.concatenate([*sums.values(), np.zeros(0)]), pa.float64())})

    rows = some.mapInArrow(bundle, "lang string, at int, v double").groupBy("lang", "at").agg(F.sum(F.round("v", 6).cast("decimal(28,6)")).alias("v"))
    out: dict[str, np.ndarray] = {}
    for r in rows.toLocalIterator():
        out.setdefault(r.lang, np.zeros(dim))[r["at"]] = float(r.v)
    return {k: v / max(np.linalg.norm(v), 1e-9) for k, v in sorted(out.items())}


def letter_vectors_kept(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if f"letters{dim}" not in _kept:
        _kept[f"letters{dim}"] = letter_vectors(dim)
    return _kept[f"letters{dim}"]


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """docs with lang_pred and score; Spark carries the columns of docs along."""
    docs, opened = boxed(docs, ["doc_id", "text"], ["lang_pred", "score"])
    langs = list(prototypes)
    raw = np.array([prototypes[k] for k in langs]) if langs else np.zeros((0, DIM))
    dim = raw.shape[1]
    shared = raw.mean(axis=0) if len(langs) > 1 else np.zeros(dim)
    own = raw - shared
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)

    @F.pandas_udf("lang_pred string, score double")
    def told(texts):
        import pandas as pd

        out, scores = [], np.zeros(len(texts))
        for k, text in enumerate(texts):
            v = vector(text, letter_vectors_kept(dim)) if langs else None
            if v is None:
                out.append(UNKNOWN)
                continue
            v = v / max(np.linalg.norm(v), 1e-9) - shared
            cosine = own @ v / max(np.linalg.norm(v), 1e-9)
            best = int(np.argmax(cosine))
            out.append(langs[best])
            scores[k] = min(1.0, max(0.0, cosine[best]))
        return pd.DataFrame({"lang_pred": out, "score": scores})

    return opened(docs.withColumn("_told", told("text")).withColumns({"lang_pred": F.col("_told.lang_pred"), "score": F.col("_told.score")}), ["lang_pred", "score"])


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_bucket(F.col("doc_id"), 4) == 2
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = learn(docs.where(~held_out))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
