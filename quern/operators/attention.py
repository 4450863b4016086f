"""Attention of frames: over their chunk and a cache of earlier frames, and over a vocabulary of any size.

Both take plain vectors (queries, keys and values are what the caller's projections have made of the frames).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import numbered, settled


def attend(q: np.ndarray, k: np.ndarray, v: np.ndarray, heads: int = 1) -> np.ndarray:
    """Softmax attention of each row of q over all rows of k and v, head by head."""
    n, width = q.shape
    d = width // heads
    out = np.empty((n, v.shape[1]))
    for h in range(heads):
        s = slice(h * d, (h + 1) * d)
        scores = q[:, s] @ k[:, s].T * d**-0.5
        w = np.exp(scores - scores.max(1, keepdims=True))
        out[:, s] = w @ v[:, s] / w.sum(1, keepdims=True)
    return out


def chunked(vectors: np.ndarray, first: int, stride: int, right: int, look_back: int, heads: int) -> np.ndarray:
    """Attention of frames first to first + stride of vectors over the look_back strides before them, them, and `right` frames behind."""
    begin = 0 if look_back < 0 else max(0, first - look_back * stride)
    seen = vectors[begin : first + stride + right]
    return attend(vectors[first : first + stride], seen, seen, heads)


def chunk_attention(df: DataFrame, key: str, order: list[str], vector: str, stride: int, right: int = 0, look_back: int = 1, heads: int = 1) -> DataFrame:
    """key, t (frame from 0) and out for the frames of each key, chunk by chunk as they would come in a stream.

    A chunk is `stride` frames; its frames attend to the chunk, the `right` frames behind it and the look_back * stride
    frames before it.  A chunk waits until all its frames and those behind it are there, so the frames of a key that
    come after its last whole chunk have no row.  look_back 0 keeps nothing.  A frame is sent to each chunk that sees it
    (1 + look_back + right / stride of them), so a key's chunks are many tasks' work, however long the key.
    """
    if look_back < 0 or stride < 1 or right < 0:
        raise ValueError("a table's chunks need a stride of 1 or more, and as many frames before and behind as there are numbers for")
    rows = numbered(df.select(key, *[c for c in order if c != key], F.col(vector).cast("array<double>").alias("_v")), [key], order, "_t").select(key, "_t", "_v")
    first = F.greatest(F.lit(0), F.floor((F.col("_t") - right) / stride))  # the first chunk whose frames behind it reach t
    last = F.floor(F.col("_t") / stride) + look_back
    dealt = rows.withColumn("_c", F.explode(F.sequence(first, last)))
    kind = dict(df.dtypes)[key]

    def run(table: pa.Table) -> pa.Table:
        t = table.column("_t").to_numpy()
        c = table.column("_c")[0].as_py()
        by = np.argsort(t, kind="stable")
        own = (c + 1) * stride + right
        at = t[by]
        if not len(at) or at[-1] != own - 1:
            by = by[:0]
        x = np.array([table.column("_v")[int(i)].as_py() for i in by], float)
        begin = int(np.searchsorted(at, c * stride))
        out = chunked(x, begin, stride, right, look_back, heads) if len(by) else np.zeros((0, 1))
        n = len(out)
        return pa.table({key: table.column(key).slice(0, 1).take(pa.array([0] * n, pa.int64())), "t": pa.array(c * stride + np.arange(n), pa.int64()), "out": pa.array(list(out), pa.list_(pa.float64()))})

    return dealt.groupBy(key, "_c").applyInArrow(run, f"`{key}` {kind}, t long, out array<double>")


def packed(table: DataFrame, vector: str, block: int) -> DataFrame:
    """The table's vectors, `block` of them to a row: block and matrix (doubles, row by row)."""
    rows = numbered(table.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null"), [], [], "n")

    def run(part: pa.Table) -> pa.Table:
        values = pc.list_flatten(part.column("v").combine_chunks()).to_numpy(zero_copy_only=False)
        return pa.table({"block": part.column("block").slice(0, 1), "matrix": pa.array([values.tobytes()], pa.binary())})

    return rows.select("v", F.expr(f"n div {block}").alias("block")).groupBy("block").applyInArrow(run, "block long, matrix binary")


class Running:
    """Softmax-weighted sums that blocks of keys are added to one by one: the greatest score so far, the weights' sum and the weighted vectors."""

    def __init__(self, q: np.ndarray, heads: int):
        self.q, self.heads, self.d = q, heads, q.shape[1] // heads
        self.most, self.total = np.full((heads, len(q)), -np.inf), np.zeros((heads, len(q)))
        self.sum = np.zeros(q.shape)

    def add(self, keys: np.ndarray) -> None:
        for h in range(self.heads):
            s = slice(h * self.d, (h + 1) * self.d)
            own = np.ascontiguousarray(keys[:, s])
            w = self.q[:, s] * self.d**-0.5 @ own.T
            most = np.maximum(self.most[h], w.max(1))
            scale = np.exp(self.most[h] - most)
            w -= most[:, None]
            np.exp(w, out=w)
            self.total[h] = self.total[h] * scale + w.sum(1)
            self.sum[:, s] = self.sum[:, s] * scale[:, None] + w @ own
            self.most[h] = most

    def value(self) -> np.ndarray:
        return self.sum / np.repeat(self.total.T, self.d, axis=1)


#: Frames that a task holds at a time, pairs of a frame and an entry that are scored at a time (few enough for a core's cache), and bytes of a block.
FRAMES, PAIRS, BLOCK = 256, 1 << 17, 256 << 20
#: Tasks for each core: frames are few bytes and much work, so they are dealt to tasks anew, however few files they come from.
TASKS = 4


def cross_attention(df: DataFrame, key: list[str], vector: str, table: DataFrame, entry: str, heads: int = 1, block: int | None = None) -> DataFrame:
    """key and out: each frame's softmax-weighted mean of the table's vectors, scored by the scaled product with the frame's vector.

    df has vectors of the width of the table's; keys and values are the table's vectors themselves.  The table is packed
    into blocks (of BLOCK bytes, or `block` vectors); one block at a time goes to all executors, and each pass adds its block to what the frames have so far
    (greatest score, sum of weights, weighted sum a head), so no row is made for a pair, and memory holds one block
    whatever the vocabulary.  Frames with null vectors have null, and an empty table gives null for all.
    """
    spark = df.sparkSession
    if block is None:
        widest = table.agg(F.max(F.size(entry))).first()[0] or 1
        block = max(1, BLOCK // (8 * max(1, widest)))
    blocks = settled(packed(table, entry, block))
    names = [r.block for r in blocks.select("block").orderBy("block").collect()]  # a number for each block
    kinds = dict(df.dtypes)
    form = ", ".join(f"`{k}` {kinds[k]}" for k in key)
    state = df.select(*key, F.col(vector).cast("array<double>").alias("q"), F.lit(None).cast("binary").alias("held")).repartition(TASKS * spark.sparkContext.defaultParallelism)
    form_state = form + ", q array<double>, held binary"
    for name in names:
        matrix = blocks.where(F.col("block") == name).first()["matrix"]  # of `block` vectors
        sent = spark.sparkContext.broadcast(bytes(matrix))
        state = settled(state.mapInArrow(_pass(sent, heads, len(key)), form_state))
        sent.unpersist()
    return state.mapInArrow(_finish(heads, len(key)), form + ", out array<double>")


def _frames(batch: pa.RecordBatch, heads: int, at: int):
    """The batch's rows with vectors: their numbers and running sums, taken up where the last pass left them."""
    q, held = batch.column(at), batch.column(at + 1)
    full = [i for i in range(batch.num_rows) if q[i].is_valid]
    if not full:
        return full, None
    one = Running(np.array([q[i].as_py() for i in full], float), heads)
    if held[full[0]].is_valid:
        x = np.array([np.frombuffer(held[i].as_py()) for i in full])
        one.most, one.total, one.sum = x[:, :heads].T.copy(), x[:, heads : 2 * heads].T.copy(), x[:, 2 * heads :].copy()
    return full, one


def _slices(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, FRAMES):
            yield batch.slice(i, FRAMES)


def _pass(sent, heads: int, at: int):
    def run(batches):
        for batch in _slices(batches):
            full, one = _frames(batch, heads, at)
            held: list[bytes | None] = [None] * batch.num_rows
            if full:
                keys = np.frombuffer(sent.value).reshape(-1, one.q.shape[1])
                step = max(1, PAIRS // len(full))
                for i in range(0, len(keys), step):
                    one.add(keys[i : i + step])
                for i, x in zip(full, np.concatenate([one.most.T, one.total.T, one.sum], 1), strict=True):
                    held[i] = x.tobytes()
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(at + 1)], pa.array(held, pa.binary())], schema=batch.schema)

    return run


def _finish(heads: int, at: int):
    def run(batches):
        for batch in _slices(batches):
            full, one = _frames(batch, heads, at)
            out: list[np.ndarray | None] = [None] * batch.num_rows
            if full and one.total.any():
                for i, x in zip(full, one.value(), strict=True):
                    out[i] = x
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(at)], pa.array(out, pa.list_(pa.float64()))], [*batch.schema.names[:at], "out"])

    return run
