"""Beam search over the frames of a sequence: prefixes of labels, with the masses of all paths that collapse to them."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FOUND = "array<struct<ids: array<int>, score: double>>"


def _more(a: float, b: float) -> float:
    return float(np.logaddexp(a, b))


def prefix_beam(logs: Iterable[np.ndarray], width: int, blank: int = 0, labels: int | None = None) -> list[tuple[tuple[int, ...], float]]:
    """The best label sequences of frames of log probabilities and their log masses, best first; `width` prefixes are kept a frame.

    A prefix has two masses: of the paths that end in a blank and of those that end in its last label, so a label that
    follows itself makes a longer prefix only behind a blank.  With `labels` only a frame's best so many labels (and the
    blank) are tried.  Equal masses go by the prefix itself, label by label, the shorter first; equal labels of a
    frame by number.  A frame at which nothing is possible ends all prefixes.
    """
    none = -np.inf
    beam: dict[tuple[int, ...], tuple[float, float]] = {(): (0.0, none)}
    for row in logs:
        tried = np.argsort(-row, kind="stable")
        tried = [c for c in (tried if labels is None else tried[:labels]).tolist() if c != blank and row[c] > none]
        found: dict[tuple[int, ...], tuple[float, float]] = {}

        def add(prefix, in_blank, in_label, found=found):
            b, n = found.get(prefix, (none, none))
            found[prefix] = _more(b, in_blank), _more(n, in_label)

        for prefix, (b, n) in beam.items():
            both = _more(b, n)
            add(prefix, both + row[blank], n + row[prefix[-1]] if prefix else none)
            for c in tried:
                add((*prefix, c), none, (b if prefix and c == prefix[-1] else both) + row[c])
        ranked = sorted((-_more(b, n), p) for p, (b, n) in found.items() if _more(b, n) > none)[:width]
        beam = {p: found[p] for _, p in ranked}
    return sorted(((p, _more(b, n)) for p, (b, n) in beam.items()), key=lambda x: (-x[1], x[0]))


def beam_search(frames: Column | str, width: int = 4, blank: int = 0, best: int = 1, labels: int | None = None) -> Column:
    """The `best` label sequences (ids, score) of each row's frames, an array of log probabilities a frame; no frames have the empty one, null has null."""

    @F.pandas_udf(FOUND)
    def each(x: pd.Series) -> pd.Series:
        def one(v):
            if v is None:
                return None
            logs = [np.array(f, float) for f in v]
            return [{"ids": list(p), "score": s} for p, s in prefix_beam(logs, width, blank, labels)[:best]]

        return pd.Series([one(v) for v in x])

    return each(frames)
