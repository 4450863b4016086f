"""Toxicity: averaged subword-bag embeddings into a linear softmax, trained jointly.

A word's vector is the mean of the vectors of itself and of its character n-grams (hashed to buckets), a text's vector
is the mean over its distinct words, and a linear softmax turns it into class probabilities.  Embeddings and softmax are trained
together in numpy on a bounded, documented sample of labelled rows, so misspellings that were never seen share the
vectors of their n-grams.  As everything before the softmax is linear, a trained model is one number for each word: a
task computes it once for each distinct word, and a text costs a lookup a word.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ALNUM, alnum_words, spans, text_batches, text_bytes, word_hashes

#: Labelled rows of each class that the fit uses at most, those with the lowest hash of the id, and their characters.
SAMPLE, CHARS = 4000, 32_000_000
#: UPDATES batches are drawn at every size of the sample: three passes over a full one.
BUCKETS, DIM, UPDATES, BATCH, RATE = 1 << 17, 4, 375, 64, 0.3
SIZES = (3, 4, 5)
#: A text's mean vector is multiplied by this before the softmax: a few words among hundreds have to tip it.
GAIN = 1000.0
#: A text counts as having so many more words, of no meaning: a word or two do not decide on a short text.  This and GAIN
#: were chosen by three folds within the learning rows of the small tables, never by held-out labels, as were the weights in crossed().
PADDING = 300
#: Adagrad starts as if it had seen so many mean squared gradients.
STIFF = 20.0
#: Bytes of the longest words whose log odds are remembered; longer ones, such as text without spaces, seldom come back.
LONG = 256
#: Parts for the calibration.
FOLDS = 2


def subwords(word: bytes, buckets: int = BUCKETS) -> list[int]:
    """Buckets of the word and of its n-grams of characters, with marks at its ends."""
    w = f"<{word.decode('utf-8', 'replace')}>"
    grams = {w[i : i + n] for n in SIZES for i in range(len(w) - n + 1)}
    return [xxhash.xxh3_64_intdigest(g) % buckets for g in sorted(grams | {w, f"={word!r}"})]


@dataclass
class Model:
    """Each bucket's contribution to the log odds, and the bias."""

    value: np.ndarray
    bias: float

    def word(self, word: bytes) -> float:
        return float(self.value[subwords(word, len(self.value))].mean())


class Words(dict):
    """Log odds of words, filled as they come; the memory in use is bounded."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, word: bytes) -> float:
        if len(self) > 600_000:
            self.clear()
        v = self.model.word(word)
        if len(word) <= LONG:
            self[word] = v
        return v


class Texts:
    """Texts as numbers of their distinct words, and the buckets of each word's n-grams."""

    def __init__(self, texts: list[str | None], buckets: int = BUCKETS):
        number: dict[bytes, int] = {}
        self.buckets = buckets
        self.docs = [np.unique(np.array([number.setdefault(w, len(number)) for w in alnum_words(t)], np.int32)) for t in texts]
        flat, size = array("i"), array("i")
        for w in number:
            grams = subwords(w, buckets)
            flat.extend(grams)
            size.append(len(grams))
        self.flat, self.at = np.array(flat, np.int32), spans(np.array(size, np.int64))

    def log_odds(self, model: Model, rows: np.ndarray) -> np.ndarray:
        words = np.add.reduceat(model.value[self.flat], self.at[:-1]) / np.diff(self.at) if len(self.flat) else np.zeros(0)
        return np.array([model.bias + words[self.docs[i]].sum() / (len(self.docs[i]) + PADDING) for i in rows.tolist()])


def train(texts: Texts, rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, dim: int = DIM, updates: int = UPDATES, rate: float = RATE, seed: int = 7) -> Model:
    """Fits embeddings and softmax together by Adagrad on the weighted cross-entropy of the rows of texts."""
    rng = np.random.default_rng(seed)
    docs, buckets, flat, g_at, g_len = texts.docs, texts.buckets, texts.flat, texts.at, np.diff(texts.at)
    e = rng.normal(0, 0.001, (buckets, dim))
    w, b = rng.normal(0, 0.5, (dim, 2)), np.zeros(2)
    b[1] = np.log(max(weights[rows][labels[rows] == 1].sum(), 1e-3) / max(weights[rows][labels[rows] == 0].sum(), 1e-3))
    se = sw = sb = None
    full = [i for i in rows.tolist() if len(docs[i])]
    seen, place = np.zeros(len(g_len), bool), np.zeros(len(g_len), np.int64)
    order = np.concatenate([rng.permutation(full) for _ in range(-(-updates * BATCH // len(full)))]) if full else np.zeros(0, np.int64)
    for start in range(0, min(len(order), updates * BATCH), BATCH):
        pick = order[start : start + BATCH]
        n = np.array([len(docs[i]) for i in pick])
        words = np.concatenate([docs[i] for i in pick])
        share = np.concatenate([np.full(len(docs[i]), 1 / (len(docs[i]) + PADDING)) for i in pick])
        row = np.repeat(np.arange(len(pick)), n)
        seen[words] = True
        uniq = np.flatnonzero(seen)
        seen[uniq], place[uniq] = False, np.arange(len(uniq))
        back = place[words]
        length = g_len[uniq]
        own = flat[np.repeat(g_at[uniq + 1] - np.cumsum(length), length) + np.arange(int(length.sum()))]
        ends = spans(length)[:-1]
        vec = np.add.reduceat(e[own], ends) / length[:, None]
        h = np.add.reduceat(vec[back] * share[:, None], spans(n)[:-1])
        z = GAIN * h @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        y = np.eye(2)[labels[pick]]
        d = (p - y) * (weights[pick] / weights[pick].sum())[:, None]
        dw, db, dh = GAIN * h.T @ d, d.sum(0), GAIN * d @ w.T
        per = dh[row] * share[:, None]
        dv = np.stack([np.bincount(back, per[:, k], len(uniq)) for k in range(dim)], 1) / length[:, None]
        spread = np.repeat(dv, length, 0)
        hit = np.flatnonzero(np.bincount(own, minlength=buckets))
        de = np.stack([np.bincount(own, spread[:, k], buckets)[hit] for k in range(dim)], 1)
        if se is None:  # the start holds back what occurs in a few texts only
            se, sw, sb = np.full(e.shape, STIFF * (de**2).mean()), STIFF * (dw**2).mean() + 0 * w, STIFF * (db**2).mean() + 0 * b
        se[hit] += de**2
        e[hit] -= rate * de / np.sqrt(se[hit])
        sw += dw**2
        sb += db**2
        w -= rate * dw / np.sqrt(sw)
        b -= rate * db / np.sqrt(sb)
    return Model((GAIN * (e @ (w[:, 1] - w[:, 0]))).astype(np.float32), float(b[1] - b[0]))


def calibration(x: np.ndarray, labels: np.ndarray, weights: np.ndarray, steps: int = 50) -> np.ndarray:
    """The scale and shift that fit log odds of texts to their labels, by Newton's method."""
    v = np.stack([np.clip(x, -30, 30), np.ones(len(x))], 1)
    c = np.array([1.0, 0.0])
    w = weights / weights.mean()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(v @ c, -30, 30)))
        g = v.T @ (w * (p - labels)) + 0.1 * (c - [1.0, 0.0])
        h = (v * (w * p * (1 - p))[:, None]).T @ v + 0.1 * np.eye(2)
        c = c - np.clip(np.linalg.solve(h, g), -1, 1)
        c[0] = max(c[0], 0.1)
    return c


def crossed(texts: list[str | None], labels: np.ndarray, weights: np.ndarray) -> Model:
    """A model of all texts, calibrated by the log odds that models of FOLDS - 1 parts give the part that they leave out.

    The classes' weights there are halfway (as powers) between their shares and alike: by folds within the learning rows,
    weighing them alike finds a few more toxic texts and rejects several times as many clean ones.  Where one class has fewer than two texts there is nothing to leave out; without a text of each class the model is the
    classes' share alone.
    """
    n = np.bincount(labels, minlength=2)
    if not n.all():
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((n[1] + 0.5) / (n[0] + 0.5)) if n.sum() else 0.0))
    texts = Texts(texts)
    model = train(texts, np.arange(len(labels)), labels, weights)
    if (n < 2).any():
        return model
    part = np.zeros(len(labels), np.int64)
    for k in (0, 1):
        part[labels == k] = np.arange(n[k]) % FOLDS
    x = np.zeros(len(labels))
    for k in range(min(FOLDS, int(n.min()))):
        own, other = np.flatnonzero(part != k), np.flatnonzero(part == k)
        x[other] = texts.log_odds(train(texts, own, labels, weights), other)
    seen = part < n.min()
    alike = np.array([weights[seen & (labels == k)].sum() for k in (0, 1)])
    c = calibration(x[seen], labels[seen], (weights / np.sqrt(alike[labels]))[seen])
    return Model((model.value * c[0]).astype(np.float32), float(model.bias * c[0] + c[1]))


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, sample: int = SAMPLE, chars: int = CHARS) -> Model:
    """Learns from labels (doc_id, toxic) where `learn` (of doc_id) holds.

    Null labels and ids are left out, of repeated ones the largest label counts.  Of each class the `sample` ids with the
    lowest hashes are looked up, one text an id (where an id has several, that with the least hash); of those texts, as
    many as have `chars` characters together reach the driver, weighted so that the classes keep their shares.  With no
    rows of one class, or none at all, every text gets the same score.
    """
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    rows = (rows if learn is None else rows.where(learn)).groupBy("doc_id").agg(F.max("y").alias("y"))
    total = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    few = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * sample rows at most
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(few, "doc_id")
    each = found.groupBy("doc_id").agg(F.max("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text"))
    so_far = F.sum(F.length(F.coalesce("text", F.lit("")))).over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id"))
    got = each.withColumn("so_far", so_far).where(F.col("so_far") <= chars).orderBy("doc_id").toPandas()
    y = got["y"].to_numpy(np.int64)
    count = np.bincount(y, minlength=2)
    weight = np.array([total.get(k, 0) / max(1, count[k]) for k in (0, 1)])
    return crossed(got["text"].tolist(), y, weight[y] if len(y) else np.zeros(0))


class Known:
    """Log odds of words by their 64-bit hashes, filled as they come; 16 bytes a word, of which there are `most` or so."""

    def __init__(self, model: Model, most: int = 1_000_000):
        self.model, self.most = model, most
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0)

    def __call__(self, data: np.ndarray, cuts: np.ndarray, starts: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The log odds of the distinct hashes of h, in order; words begin at `starts` in data."""
        every, first = np.unique(h, return_index=True)
        if len(self.keys) > self.most:
            self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0)
        at = np.searchsorted(self.keys, every)
        new = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != every) if len(self.keys) else np.arange(len(every))
        if len(new):
            begin = starts[first[new]]
            ends = np.append(np.sort(np.concatenate([np.flatnonzero(ALNUM[data] == 0), cuts])), len(data))
            stop = ends[np.searchsorted(ends, begin, "right")]
            raw = data.tobytes().lower()
            keys = np.concatenate([self.keys, every[new]])
            values = np.concatenate([self.values, [self.model.word(raw[i:j]) for i, j in zip(begin.tolist(), stop.tolist(), strict=True)]])
            order = np.argsort(keys)
            self.keys, self.values = keys[order], values[order]
            at = np.searchsorted(self.keys, every)
        return self.values[at]


def scorer(spark, model: Model):
    """A function from Arrow columns of texts to probabilities, for use in tasks."""
    sent = spark.sparkContext.broadcast(model)  # BUCKETS numbers
    state: dict = {}

    def score(column) -> np.ndarray:
        if "known" not in state:
            state["known"] = Known(sent.value)
        data, cuts = text_bytes(column)
        starts, h = word_hashes(data, cuts)
        out = np.full(len(column), sent.value.bias)
        if len(h):
            each, word = np.unique(h, return_inverse=True)
            values = state["known"](data, cuts, starts, h)
            # distinct words of each text
            pair = np.unique((np.repeat(np.arange(len(column)), np.diff(np.searchsorted(starts, cuts))) << 32) | word)
            of = pair >> 32
            n = np.bincount(of, minlength=len(column))
            out += np.bincount(of, values[pair & 0xFFFFFFFF], minlength=len(column)) / (n + PADDING)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))

    return score


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score for each row; null and empty texts have the bias alone, repeated rows repeat, other columns are ignored."""
    each, kind = scorer(docs.sparkSession, model), dict(docs.dtypes)["doc_id"]

    def run(batches):
        for b in text_batches(batches, 2_000_000):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(each(b.column("text")))], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, score double")


def clean(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold."""
    each = scorer(docs.sparkSession, model)

    def run(batches):
        for b in text_batches(batches, 2_000_000):
            yield b.filter(pa.array(each(b.column("text").cast(pa.string())) < threshold))

    return docs.mapInArrow(run, docs.schema)
