"""Convolutions along frames: long sequences are cut into stretches that carry the frames around them along."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import numbered

#: Outputs of a stretch.
STRETCH = 4096


def slid(x: np.ndarray, weights: np.ndarray, stride: int) -> np.ndarray:
    """Windows of len(weights) rows of x, every `stride` rows, times the weights: (k, d) for each channel by itself, (k, d, o) for all."""
    windows = np.lib.stride_tricks.sliding_window_view(x, len(weights), axis=0)[::stride]  # (n, d, k)
    return np.einsum("ndk,kd->nd" if weights.ndim == 2 else "ndk,kdo->no", windows, weights)


def convolve(df: DataFrame, key: str, order: list[str], vector: str, weights, stride: int = 1, left: int = 0, right: int = 0, bias=None, residual: bool = False, mask: str | None = None, stretch: int = STRETCH) -> DataFrame:
    """key, t and out: the convolution of each key's frames, in order, as if `left` and `right` frames of zeros stood around them.

    weights: (k, d) convolves each of d channels by itself, (k, d, o) all into o.  Output t sees the frames from
    t * stride - left on; one that would need more than the zeros on the right is not made.  residual adds the frame
    itself (strides of 1).  Frames whose mask is not true count as zeros, and so do their outputs (strides of 1).  A key's frames
    are numbered over ranges and dealt to stretches of outputs together with the frames around them, so the frames of one
    very long key are many tasks' work.  Null vectors fail, an empty table gives an empty one.
    """
    w = np.asarray(weights, float)
    k = len(w)
    if left >= k or right >= k:
        raise ValueError("as many zeros as the kernel is long would make outputs that see no frame")
    if (residual or mask) and stride != 1:
        raise ValueError("frames and outputs pair up at strides of 1 only")
    shown = F.col(vector).cast("array<double>")
    keep = F.lit(True) if mask is None else F.coalesce(F.col(mask), F.lit(False))
    rows = df.select(key, *[c for c in order if c != key], shown.alias("_v"), keep.alias("_m"))
    rows = numbered(rows, [key], order, "_t").select(key, "_t", "_v", "_m")
    # outputs that see frame t run from ceil((t + left - k + 1) / stride) to floor((t + left) / stride)
    first = F.greatest(F.lit(0), F.ceil((F.col("_t") + (left - k + 1)) / stride))
    last = F.floor((F.col("_t") + left) / stride)
    dealt = rows.where(first <= last).withColumn("_c", F.explode(F.sequence(F.floor(first / stretch), F.floor(last / stretch))))
    kind, b = dict(df.dtypes)[key], 0.0 if bias is None else np.asarray(bias, float)

    def run(table: pa.Table) -> pa.Table:
        c, t = table.column("_c")[0].as_py(), table.column("_t").to_numpy()
        x = np.array(table.column("_v").to_pylist(), float)
        m = table.column("_m").to_numpy()
        x[~m] = 0
        low = c * stretch * stride - left
        n = (stretch - 1) * stride + k
        held, seen, live = np.zeros((n, x.shape[1])), (t >= low) & (t < low + n), np.zeros(n, bool)
        held[t[seen] - low], live[t[seen] - low] = x[seen], m[seen]
        end = int(t[seen].max()) + 1  # of the sequence, unless the stretch has all that it can see
        out = slid(held, w, stride) + b
        s = np.arange(c * stretch, (c + 1) * stretch)
        made = np.ones(len(s), bool) if end == low + n else s * stride - left + k <= end + right
        if residual:
            out = out + held[left : left + stretch]
        if mask is not None:
            out[~live[left : left + stretch]] = 0
        s, out = s[made], out[made]
        return pa.table({key: table.column(key).slice(0, 1).take(pa.array([0] * len(s), pa.int64())), "t": pa.array(s, pa.int64()), "out": pa.array(list(out), pa.list_(pa.float64()))})

    return dealt.groupBy(key, "_c").applyInArrow(run, f"`{key}` {kind}, t long, out array<double>")


def memory(df: DataFrame, key: str, order: list[str], vector: str, weights, shift: int = 0, mask: str | None = None, stretch: int = STRETCH) -> DataFrame:
    """The memory block of an FSMN: each channel's weighted frames around a frame (more of them before it by `shift`), and the frame itself."""
    k = len(weights)
    left = (k - 1) // 2 + shift
    return convolve(df, key, order, vector, weights, 1, left, k - 1 - left, residual=True, mask=mask, stretch=stretch)


def strided(df: DataFrame, key: str, order: list[str], vector: str, weights, bias=None, stretch: int = STRETCH) -> DataFrame:
    """Each k = len(weights) neighbouring frames become one, weights (k, d, o); a rest of fewer is dropped."""
    return convolve(df, key, order, vector, weights, len(weights), bias=bias, stretch=stretch)
