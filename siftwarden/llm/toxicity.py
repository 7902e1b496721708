"""Operator 8, toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Input: each token (a run of letters, digits and bytes above 127 of the ASCII-lower-cased UTF-8 text) is the
embedding of its hash and the mean embedding of its character n-grams, n from NGRAMS, ends included.  A
text is cut into overlapping windows of WINDOW tokens, STEP apart, whole to its end; each window runs through a
gated recurrent unit in both directions, attention pools the states, and a linear layer gives its logit.
The text's logit is its largest window's.

Training: a bounded sample of labelled rows, about TRAIN_ROWS of each label by a hash of doc_id and
texts of TRAIN_CHARS at most and of TRAIN_SUM in all (labelled texts are for learning only; every text is scored whole).  The
embeddings' first coordinates are the log odds of tokens and n-grams; all else is trained by
back-propagation through each text's largest window (Adam), with odds from one half of the sample and texts of the
other, then the halves swapped, so that weights are fitted to odds of unseen texts.  In the end the odds
are those of the whole sample.  Seeds are fixed.

Nulls and edges: a text without tokens scores the labels' base rate, but under 0.5; labels that repeat
count once, as toxic if any says so; null labels and ids aren't learnt from; without both labels to
learn from every score is the base rate likewise; windows that tie count once; a very long text runs in windows, SIDE at
a time; columns of docs stay as they are, one named as the score gives way to it; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_bucket, table
from .hashing import U, goes, mix, word_hashes, word_spans

TRAIN_ROWS = {0: 3_000, 1: 2_000}
#: Characters of a text that is learnt from, and of all such texts: what the driver takes at most, 128 MB.
TRAIN_CHARS, TRAIN_SUM = 200_000, 32_000_000
WINDOW, STEP = 48, 32
HIDDEN, WORD_DIM, CHAR_DIM = 8, 4, 4
WORD_ROWS, CHAR_ROWS = 1 << 16, 1 << 16
NGRAMS = (3, 4, 5)
EPOCHS, BATCH, RATE = 6, 32, 0.01
#: Documents that a log odds ratio is drawn back by.
PRIOR = 3.0
#: Windows that run side by side in scoring.
SIDE = 4096
SEED = 8
_SEEN = np.array([b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


class Tokens:
    """The tokens of a run of texts: where each text's begin, and their kinds' word and n-gram rows."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        data = _SEEN[data]
        h, self.of = word_hashes(data, at)
        start, end, _ = word_spans(data, at)
        kinds, first, self.kind = np.unique(h, return_index=True, return_inverse=True)
        self.word = (kinds & U(WORD_ROWS - 1)).astype(np.int64)
        # the kinds' bytes side by side, each between two blanks
        size = (end - start)[first] + 2
        off = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(off[-1]) - np.repeat(off[:-1], size)
        inner = (place > 0) & (place < np.repeat(size, size) - 1)
        chars = np.full(off[-1], 32, np.uint8)
        chars[inner] = data[(np.repeat(start[first], size) + place - 1)[inner]]
        rows, keep = [], []
        left = np.repeat(off[1:], size) - np.arange(off[-1])  # bytes to the token's end
        for n in NGRAMS:
            code = np.zeros(off[-1], U)
            for k in range(n):
                code[: len(code) - k] += chars[k:].astype(U) << U(8 * k)
            rows.append((mix(code + (U(n) << U(56))) & U(CHAR_ROWS - 1)).astype(np.int64))
            keep.append((left >= n) | (place == 0) & (n == NGRAMS[0]))  # a token of one byte has one n-gram still
        rows, keep = np.stack(rows, 1).reshape(-1), np.stack(keep, 1).reshape(-1)
        self.gram = rows[keep]
        per = np.add.reduceat(keep.astype(np.int64), off[:-1] * len(NGRAMS)) if len(kinds) else np.zeros(0, np.int64)
        self.gram_of = np.repeat(np.arange(len(kinds)), per)
        self.gram_at, self.gram_n = np.cumsum(per) - per, per

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each window: its text, its first token and its length."""
        n = np.diff(self.of)
        many = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STEP)), 0)
        text = np.repeat(np.arange(len(n)), many)
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return text, self.of[:-1][text] + nth * STEP, np.minimum(n[text] - nth * STEP, WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    def __init__(self, base_rate: float):
        rng = np.random.default_rng(SEED)
        draw = lambda *shape, by=1.0: (rng.standard_normal(shape) * by).astype(np.float32)
        h, d = HIDDEN, WORD_DIM + CHAR_DIM
        self.base_rate = base_rate
        self.p = {
            "word": draw(WORD_ROWS, WORD_DIM, by=0.05), "char": draw(CHAR_ROWS, CHAR_DIM, by=0.05), "in": draw(d, 6 * h, by=0.5), "in_b": np.zeros(6 * h, np.float32),
            "fwd": draw(h, 3 * h, by=0.3), "bwd": draw(h, 3 * h, by=0.3), "att": draw(2 * h, by=0.5), "out": draw(2 * h, by=0.5), "out_b": np.zeros(1, np.float32),
        }

    def inputs(self, t: Tokens) -> np.ndarray:
        """The kinds' embeddings: word, then the mean of the n-grams."""
        rows = self.p["char"][t.gram]
        mean = np.add.reduceat(rows, t.gram_at, axis=0) / t.gram_n[:, None] if len(t.word) else np.zeros((0, CHAR_DIM), np.float32)
        return np.concatenate([self.p["word"][t.word], mean], axis=1).astype(np.float32)

    def run(self, x: np.ndarray, at: np.ndarray, length: np.ndarray, keep: bool = False):
        """Logits of windows; x: projected inputs by kind, at: kinds by step and window (any value behind `length`)."""
        steps, many = at.shape
        h3, hid = 3 * HIDDEN, HIDDEN
        live = np.arange(steps)[:, None] < length[None, :]
        states = np.zeros((steps, many, 2 * hid), np.float32)
        saved = {}
        for name, way, cols in (("fwd", range(steps), slice(0, h3)), ("bwd", range(steps - 1, -1, -1), slice(h3, 2 * h3))):
            w, h = self.p[name], np.zeros((many, hid), np.float32)
            own = np.ascontiguousarray(x[:, cols])
            for t in way:
                a, b = own[at[t]], h @ w
                zr = _sigmoid(a[:, : 2 * hid] + b[:, : 2 * hid])
                z, r = zr[:, :hid], zr[:, hid:]
                n = np.tanh(a[:, 2 * hid :] + r * b[:, 2 * hid :])
                new = (n + z * (h - n)) * live[t][:, None]
                if keep:
                    saved[name, t] = (h, z, r, n, b[:, 2 * hid :])
                h = new
                states[t, :, hid * (name == "bwd") : hid * (1 + (name == "bwd"))] = h
        e = np.where(live, states @ self.p["att"], -1e9)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", a, states)
        logit = pooled @ self.p["out"] + self.p["out_b"][0]
        return (logit, (live, states, a, pooled, saved)) if keep else logit

    def project(self, x: np.ndarray) -> np.ndarray:
        return x @ self.p["in"] + self.p["in_b"]

    def logits(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, tuple]:
        """The largest logit of each text (-inf without tokens), which window has it, and the windows."""
        text, first, length = wins = t.windows()
        texts = len(t.of) - 1
        out, x = np.zeros(len(text), np.float32), self.project(self.inputs(t))
        order = np.argsort(length, kind="stable")  # short windows together, so that they take few steps
        for k in range(0, len(order), SIDE):
            w = order[k : k + SIDE]
            out[w] = self.run(x, self.kinds(t, first[w], length[w]), length[w])
        best, where = np.full(texts, -np.inf), np.zeros(texts, np.int64)
        if len(text):
            begin = np.flatnonzero(np.diff(text, prepend=-1))
            best[text[begin]] = np.maximum.reduceat(out, begin)
            for k in np.flatnonzero(out == best[text])[::-1]:
                where[text[k]] = k
        return best, where, wins

    @staticmethod
    def kinds(t: Tokens, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        at = first[None, :] + np.arange(length.max() if len(length) else 0)[:, None]
        return t.kind[np.minimum(at, len(t.kind) - 1)]

    def scores(self, t: Tokens) -> np.ndarray:
        best = self.logits(t)[0].astype(np.float64)
        return np.where(np.isfinite(best), _sigmoid(np.clip(best, -500, 500)), min(self.base_rate, 0.49))

    def gradients(self, t: Tokens, first: np.ndarray, length: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
        """Mean cross entropy of windows and its gradients, by back-propagation through time."""
        hid, h3 = HIDDEN, 3 * HIDDEN
        x = self.inputs(t)
        at = self.kinds(t, first, length)
        logit, (live, states, a, pooled, saved) = self.run(self.project(x), at, length, keep=True)
        p = _sigmoid(logit)
        loss = -np.mean(label * np.log(p + 1e-7) + (1 - label) * np.log(1 - p + 1e-7))
        d = ((p - label) / len(label)).astype(np.float32)
        g = {"out": pooled.T @ d, "out_b": np.array([d.sum()], np.float32)}
        d_pooled = d[:, None] * self.p["out"]
        d_a = np.einsum("tbh,bh->tb", states, d_pooled)
        d_e = a * (d_a - (a * d_a).sum(axis=0))
        g["att"] = np.einsum("tb,tbh->h", d_e, states)
        d_states = a[:, :, None] * d_pooled[None] + d_e[:, :, None] * self.p["att"]
        d_x = np.zeros((*at.shape, 2 * h3), np.float32)
        for name, way, off in (("fwd", range(len(at) - 1, -1, -1), 0), ("bwd", range(len(at)), 1)):
            w, back = self.p[name], np.zeros((at.shape[1], hid), np.float32)
            g[name] = np.zeros_like(w)
            for t_ in way:
                h, z, r, n, b = saved[name, t_]
                d_h = (d_states[t_, :, off * hid : off * hid + hid] + back) * live[t_][:, None]
                d_n = d_h * (1 - z) * (1 - n * n)
                d_z = d_h * (h - n) * z * (1 - z)
                d_r = d_n * b * r * (1 - r)
                d_b = np.concatenate([d_z, d_r, d_n * r], axis=1)
                d_x[t_, :, off * h3 : off * h3 + h3] = np.concatenate([d_z, d_r, d_n], axis=1)
                g[name] += h.T @ d_b
                back = d_b @ w.T + d_h * z
        used, where = np.unique(at, return_inverse=True)
        by_kind = np.zeros((len(used), 2 * h3), np.float32)
        np.add.at(by_kind, where.reshape(-1), d_x.reshape(-1, 2 * h3))
        g["in"], g["in_b"] = x[used].T @ by_kind, by_kind.sum(axis=0)
        d_in = np.zeros_like(x)
        d_in[used] = by_kind @ self.p["in"].T
        g["word"] = (t.word[used], d_in[used, :WORD_DIM])
        spread = d_in[:, WORD_DIM:] / np.maximum(t.gram_n, 1)[:, None]
        some = np.isin(t.gram_of, used)
        g["char"] = (t.gram[some], spread[t.gram_of[some]])
        return float(loss), g


    def set_odds(self, texts: list[str], label: np.ndarray) -> None:
        """The embeddings' first coordinates, which training leaves alone."""
        if len(set(label.tolist())) == 2:
            self.p["word"][:, 0], self.p["char"][:, 0] = _log_odds(texts, label)

    def step(self, gradients: dict, moments: dict, turn: int) -> None:
        """Adam; embeddings in use only, as pairs of rows and their gradients."""
        for name, grad in gradients.items():
            rows = slice(None)
            if isinstance(grad, tuple):
                rows, at = np.unique(grad[0], return_inverse=True)
                total = np.zeros((len(rows), grad[1].shape[1]), np.float32)
                np.add.at(total, at, grad[1])
                grad = total
                grad[:, 0] = 0
            mean, var = moments[name]
            m = mean[rows] = 0.9 * mean[rows] + 0.1 * grad
            v = var[rows] = 0.99 * var[rows] + 0.01 * grad * grad
            self.p[name][rows] -= RATE * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-6)


def _log_odds(texts: list[str], label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By row of either embedding: how much likelier toxic texts are to have it, drawn back by PRIOR documents."""
    seen = [np.zeros((2, WORD_ROWS)), np.zeros((2, CHAR_ROWS))]
    for k in range(len(texts)):
        t = _tokens(texts[k : k + 1])
        seen[0][label[k], np.unique(t.word)] += 1
        seen[1][label[k], np.unique(t.gram)] += 1
    part = np.array([[max(1, (label == k).sum())] for k in (0, 1)])
    back = PRIOR / part.min()
    return tuple(np.log((x[1] + back) / (x[0] + back)).astype(np.float32) for x in (n / part for n in seen))


def _tokens(texts: list[str]) -> Tokens:
    raw = [x.encode() for x in texts]
    return Tokens(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))


def train(texts: list[str], label: np.ndarray, base_rate: float) -> Network | None:
    """A network from texts and labels 0 and 1, in a fixed order; none without both."""
    if len(set(label.tolist())) < 2:
        return None
    rng = np.random.default_rng(SEED)
    net = Network(base_rate)
    half = np.zeros(len(label), np.int64)
    for k in (0, 1):
        own = np.flatnonzero(label == k)
        half[rng.permutation(own)[::2]] = 1
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    epochs, turn = max(EPOCHS, min(40, EPOCHS * 3_000 // len(label))), 0
    for epoch in range(epochs):
        # odds from one half, weights from the other, and then the other way round
        if epoch in (0, (epochs + 1) // 2):
            stats, fit = np.flatnonzero(half == (epoch > 0)), np.flatnonzero(half != (epoch > 0))
            net.set_odds([texts[k] for k in stats], label[stats])
        order = rng.permutation(fit)
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            t = _tokens([texts[i] for i in some])
            best, where, (_, first, length) = net.logits(t)
            has = np.flatnonzero(np.isfinite(best))
            if len(has):
                turn += 1
                _, g = net.gradients(t, first[where[has]], length[where[has]], label[some][has].astype(np.float32))
                net.step(g, moments, turn)
    net.set_odds(texts, label)
    return net


def learn(docs: DataFrame, labels: DataFrame, rows: dict[int, int] = TRAIN_ROWS) -> tuple[Network | None, float]:
    """From docs (doc_id, text) and labels (doc_id, toxic): the network and the base rate."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    many = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = F.when(F.col("toxic") == 1, min(1.0, rows[1] / max(1, many.get(1, 0)))).otherwise(min(1.0, rows[0] / max(1, many.get(0, 0))))
    drawn = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = known.where(drawn < part)  # about sum(rows) rows: bounded, so they go to all workers
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").where(F.length("text") <= TRAIN_CHARS)
    # fewer rows where their texts are long: those whose draw is low, of either label alike
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    got = texts.where(F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, TRAIN_SUM / max(chars, 1)))).select("doc_id", "text", "toxic").collect()
    got.sort(key=lambda r: (r.doc_id, r.text))
    rate = many.get(1, 0) / max(1, sum(many.values()))
    return train([r.text for r in got], np.array([r.toxic for r in got], np.int64), rate), rate


def scored(docs: DataFrame, model: tuple[Network | None, float], name: str = "score") -> DataFrame:
    """docs with the score of the whole text, in a column of that name."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net, rate = sent.value
        for texts in batches:
            out = np.full(len(texts), min(rate, 0.49))
            for row, end, data, at in goes(texts) if net else ():
                out[row:end] = net.scores(Tokens(data, at))
            yield pa.array(out)

    return docs.withColumn(name, score("text"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_bucket(F.col("doc_id"), 5) == 0
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels", "doc_id", "toxic").where(~held_out))
    out = scored(docs, model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
