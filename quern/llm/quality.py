"""Quality: random Fourier features of document statistics, ridge scores from summed normal equations, isotonic calibration.

Each text becomes a short vector of statistics (lengths, shares of character classes, repetition, entropy).  Random
Fourier features of the standardised vector approximate a Gaussian kernel; every partition sums its part of the normal
equations, the parts are added up in Spark, and the driver solves one system of a fixed size.  The scores of rows kept
from that fit, binned, calibrate the score by pool-adjacent-violators.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import keep, scratch, text_batches

#: Random features, the kernel's width in standard deviations, the ridge, bins for calibration.
FEATURES, WIDTH, RIDGE, BINS = 384, 3.0, 1e-3, 2000
NAMES = ("log_bytes", "log_words", "word_length", "upper", "digit", "symbol", "space", "beyond_ascii", "loud", "lines", "line_words", "distinct", "repeated", "commonest", "with_symbol", "odd_end", "line_repeats", "entropy", "capital_words", "top_symbol")
_KINDS = np.zeros((7, 256))
_KINDS[0, 65:91] = _KINDS[1, 48:58] = _KINDS[3, [9, 10, 11, 12, 13, 32]] = _KINDS[4, 128:] = _KINDS[6, 97:123] = 1
_KINDS[2, 33:127] = 1 - _KINDS[0, 33:127] - _KINDS[1, 33:127] - _KINDS[6, 33:127]
_KINDS[5, [c for c in range(33, 127) if _KINDS[2, c] and chr(c) not in ".,'\"-;:?()"]] = 1


def statistics(text: str | None) -> list[float]:
    """The numbers named in NAMES; all 0 for a null or empty text."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    if not words:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, k = len(raw), len(words)
    upper, digit, symbol, space, beyond, loud, lower = (_KINDS @ counts).tolist()
    p = counts[counts > 0] / n
    own = Counter(words)
    lines = [x for x in raw.split(b"\n") if x]
    repeated = sum(map(bytes.__eq__, words, words[1:]))
    ends = sum(w[-1:] in b"!%*#$&|~^_+=<>@/\\" for w in words)
    return [
        np.log1p(n), np.log1p(k), sum(map(len, words)) / k, upper / max(1, upper + lower), digit / n, symbol / n, space / n, beyond / n, loud / n,
        np.log1p(len(lines)), np.log1p(k / len(lines)), len(own) / k, repeated / k, own.most_common(1)[0][1] / k, sum(not w.isalnum() and w.isascii() for w in words) / k,
        ends / k, 1 - len(set(lines)) / len(lines), float(-(p * np.log2(p)).sum()), sum(w[:1].isupper() for w in words) / k, float((counts * _KINDS[2]).max()) / n,
    ]


def describe(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of the whole text, for each row."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for b in text_batches(batches):
            x = [statistics(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, x array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    phase: np.ndarray
    beta: np.ndarray | None = None
    at: np.ndarray | None = None
    value: np.ndarray | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.w + self.phase), np.ones((len(x), 1))], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.features(x[i : i + 4096]) @ self.beta for i in range(0, len(x), 4096)] or [np.zeros(0)])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.at, self.value)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing values nearest to the given ones."""
    blocks: list[list[float]] = []
    for v, w in zip(value.tolist(), weight.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


def fit(described: DataFrame, labels: DataFrame, learn: Column | None = None, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, seed: int = 11) -> Model:
    """Learns from labels (doc_id, quality) where `learn` (of doc_id) holds, over rows of describe().

    Null labels and ids are left out, of repeated ones the least label counts.  All labelled rows take part: four of
    five (by hash of the id) in the normal equations, the rest in the calibration.  With no labelled row every text
    scores 0.5.
    """
    rows = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    rows = (rows if learn is None else rows.where(learn)).groupBy("doc_id").agg(F.min("y").alias("y"))
    data = described.join(rows, "doc_id").select("x", "y", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("check"))
    k = len(NAMES)
    means = data.agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(k)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(k)], F.avg("y").alias("y")).first()
    if means.y is None:
        return Model(np.zeros(k), np.ones(k), np.zeros((k, 1)), np.zeros(1), np.zeros(2), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    rng = np.random.default_rng(seed)
    scale = np.array([means[f"s{i}"] for i in range(k)])
    model = Model(np.array([means[f"m{i}"] for i in range(k)]), np.where(scale > 1e-9, scale, 1.0), rng.normal(0, 1 / (width * np.sqrt(k / 4)), (k, features)), rng.uniform(0, 2 * np.pi, features))
    d = features + 1

    def sums(batches):
        a = np.zeros((d, d + 1))
        for b in batches:
            y = b["y"].to_numpy(np.float64)
            z = model.features(np.stack(b["x"].to_numpy()) if len(b) else np.zeros((0, k)))
            a[:, :d] += z.T @ z
            a[:, d] += z.T @ y
        if a.any():
            from pyspark import TaskContext

            yield pd.DataFrame({"r": np.arange(d), "salt": TaskContext.get().partitionId() // 64, "v": list(a)})

    def add(_, b):
        return pd.DataFrame({"r": b["r"].iloc[:1], "salt": b["salt"].iloc[:1], "v": [np.sum(np.stack(b["v"].to_numpy()), 0)]})

    # one partial sum a task; rows of the matrix are added in Spark, those of 64 tasks and then their sums, so that the driver gets one matrix
    form = "r int, salt int, v array<double>"
    parts = data.where(~F.col("check")).select("x", "y").mapInPandas(sums, form)
    whole = parts.groupBy("r", "salt").applyInPandas(add, form).groupBy("r").applyInPandas(add, form).toPandas()
    m = np.zeros((d, d + 1))
    if len(whole):
        m[whole["r"].to_numpy()] = np.stack(whole["v"].to_numpy())
    model.beta = np.linalg.solve(m[:, :d] + ridge * max(1.0, m[d - 1, d - 1]) * np.eye(d) / d + 1e-9 * np.eye(d), m[:, d])

    def bins(batches):
        for b in batches:
            raw = model.raw(np.stack(b["x"].to_numpy()) if len(b) else np.zeros((0, k)))
            yield pd.DataFrame({"b": np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int64), "y": b["y"].astype(np.float64)})

    hist = data.where("check").select("x", "y").mapInPandas(bins, "b long, y double").groupBy("b").agg(F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("b").toPandas()
    if len(hist):
        # one pseudo-row of the mean in each bin keeps the ends off 0 and 1
        n = hist["n"].to_numpy(np.float64)
        model.at = (hist["b"].to_numpy() + 0.5) / BINS * 2 - 0.5
        model.value = isotonic((hist["y"].to_numpy() + 0.01 * means.y) / (n + 0.01), n + 0.01)
    else:
        model.at, model.value = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def predict(described: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) for each row of describe()."""
    sent = described.sparkSession.sparkContext.broadcast(model)  # of a fixed size
    kind = dict(described.dtypes)["doc_id"]

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(NAMES))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.clip(sent.value(x), 0, 1))], ["doc_id", "score"])

    return described.mapInArrow(run, f"doc_id {kind}, score double")


def score(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> DataFrame:
    """doc_id and score for each row of docs; texts are read once, their statistics kept in a scratch table.

    Null and empty texts have statistics of 0 and the score that follows, repeated rows repeat, other columns are ignored.
    """
    described = keep(describe(docs), scratch(docs.sparkSession) + "/described")
    return predict(described, fit(described, labels, learn))
