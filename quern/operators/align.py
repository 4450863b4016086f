"""Alignment: edit distance with counts of correct, substituted, deleted and inserted tokens, and CTC forced alignment."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

COUNTS = T.StructType([T.StructField(x, T.IntegerType()) for x in "ncsdi"])
STEPS = T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in ("ref", "hyp")]))


def _rows(ref, hyp):
    """For each token of ref the least edits of the prefix up to it and all prefixes of hyp; before them, those of no token."""
    vocabulary = {t: k for k, t in enumerate(dict.fromkeys([*ref, *hyp]))}
    h = np.array([vocabulary[t] for t in hyp], np.int64)
    at = np.arange(len(h) + 1)
    row = at
    yield row
    for t in ref:
        up = row + 1
        up[1:] = np.minimum(up[1:], row[:-1] + (h != vocabulary[t]))
        row = np.minimum.accumulate(up - at) + at  # insertions run along the row
        yield row


def distance(ref, hyp) -> int:
    """Least edits between two sequences, with two rows in memory."""
    last = None
    for last in _rows(ref, hyp):
        pass
    return int(last[-1])


#: Cells of the largest table that is kept whole; longer pairs are halved.
CELLS = 1 << 22


def _ways(row: np.ndarray, before: np.ndarray | None) -> np.ndarray:
    """How the best path comes to each cell of a row: 1 over a deletion, 2 over an insertion, 0 over a pair; of equal ones in this order."""
    way = np.zeros(len(row), np.uint8)
    way[1:] = np.where(row[1:] == row[:-1] + 1, 2, 0)
    if before is not None:
        way[row == before + 1] = 1
    return way


def _crossing(ref: list, hyp: list, middle: int) -> int:
    """The column in which the best path of the whole pair, followed from its end, comes to row `middle`.

    Each cell below that row carries the column of its path along: a deletion takes it from the cell above, a pair from
    the one before that, and insertions from the cell left of them.  So halving a pair changes no choice between equal paths.
    """
    at, before, column = np.arange(len(hyp) + 1), None, None
    for i, row in enumerate(_rows(ref, hyp)):
        if i == middle:
            column = at
        elif i > middle:
            way = _ways(row, before)
            moved = np.where(way == 1, column, np.concatenate([[0], column[:-1]]))
            column = moved[np.maximum.accumulate(np.where(way == 2, 0, at))]
        before = row
    return int(column[-1])


def steps(ref, hyp) -> list[tuple[str, str]]:
    """Pairs (ref token, hyp token) of the best alignment, "" for a gap; of equal paths deletions come before insertions before pairs.

    A pair whose table has over CELLS cells is parted where its path crosses the middle of ref, and so are its parts, so
    memory is of the tokens' number plus CELLS bytes.
    """
    ref, hyp, out, todo = list(ref), list(hyp), [], []
    todo.append((0, len(ref), 0, len(hyp)))
    while todo:
        a, b, c, d = todo.pop()
        if (b - a + 1) * (d - c + 1) > CELLS and b - a > 1:
            middle = (b - a) // 2
            j = c + _crossing(ref[a:b], hyp[c:d], middle)
            todo += [(a + middle, b, j, d), (a, a + middle, c, j)]  # the first part is taken up next
        else:
            out += _table(ref[a:b], hyp[c:d])
    return out


def _table(ref: list, hyp: list) -> list[tuple[str, str]]:
    """steps() by a table of a byte a cell."""
    way = np.zeros((len(ref) + 1, len(hyp) + 1), np.uint8)
    before = None
    for i, row in enumerate(_rows(ref, hyp)):
        way[i] = _ways(row, before)
        before = row
    i, j, out = len(ref), len(hyp), []
    while i or j:
        if i and way[i, j] == 1:
            i -= 1
            out.append((ref[i], ""))
        elif j and way[i, j] == 2:
            j -= 1
            out.append(("", hyp[j]))
        else:
            i, j = i - 1, j - 1
            out.append((ref[i], hyp[j]))
    return out[::-1]


def counts_of(a: list[tuple[str, str]]) -> tuple[int, int, int, int, int]:
    """(n, correct, substituted, deleted, inserted) of an alignment; n is the length of its reference."""
    deleted, inserted = sum(h == "" for _, h in a), sum(r == "" for r, _ in a)
    correct = sum(r == h for r, h in a)
    return len(a) - inserted, correct, len(a) - deleted - inserted - correct, deleted, inserted


def counts(ref, hyp) -> tuple[int, int, int, int, int]:
    """counts_of() the best alignment."""
    return counts_of(steps(list(ref), list(hyp)))


def _listed(x) -> list:
    return [] if x is None else list(x)


#: Pairs of a batch that are held as Python lists at a time; the rest stays in Arrow's arrays.
PAIRS = 64


def pairs_of(ref: pa.Array, hyp: pa.Array):
    """The pairs of two arrays of lists, one after the other, null as an empty list."""
    for i in range(0, len(ref), PAIRS):
        for r, h in zip(ref.slice(i, PAIRS).to_pylist(), hyp.slice(i, PAIRS).to_pylist(), strict=True):
            yield _listed(r), _listed(h)


def counted(rows: list[tuple]) -> list[pa.Array]:
    """The columns of COUNTS."""
    return [pa.array(x, pa.int32()) for x in np.array(rows, np.int32).reshape(-1, len("ncsdi")).T]


@F.arrow_udf(COUNTS)
def align_counts(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays(counted([counts(r, h) for r, h in pairs_of(ref, hyp)]), list("ncsdi"))


@F.arrow_udf(STEPS)
def align_steps(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    kind, out = pa.list_(pa.struct([("ref", pa.string()), ("hyp", pa.string())])), []
    for i in range(0, len(ref), PAIRS):
        each = [steps(r, h) for r, h in pairs_of(ref.slice(i, PAIRS), hyp.slice(i, PAIRS))]
        flat = pa.StructArray.from_arrays([pa.array([s[k] for x in each for s in x], pa.string()) for k in (0, 1)], ["ref", "hyp"])
        out.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, each)]), pa.int32()), flat).cast(kind))
    return pa.concat_arrays(out) if out else pa.array([], kind)


@F.arrow_udf(T.IntegerType())
def edit_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([distance(x, y) for x, y in pairs_of(a, b)], pa.int32())


#: Different pairs of tokens that a task counts before it hands their counts on.
TOKENS = 20_000


def tallied(batches):
    """token, n, c, s, d and i over the alignments of pairs (ref, hyp), added up in the task: at most TOKENS different steps and those of one pair are held."""
    held: Counter = Counter()

    def rows():
        out: dict[str, list[int]] = {}
        for (r, h), k in held.items():
            one = out.setdefault(r or h, [0] * 5)
            one[0] += k * (r != "")
            one[1 if r == h else 3 if h == "" else 4 if r == "" else 2] += k
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *(pa.array(x, pa.int64()) for x in zip(*out.values(), strict=True))], ["token", *"ncsdi"])

    for b in batches:
        for ref, hyp in pairs_of(b.column("ref"), b.column("hyp")):
            held.update(steps(ref, hyp))
            if len(held) > TOKENS:
                yield rows()
    if held:
        yield rows()


def forced_align(scores: np.ndarray, targets: list[int], blank: int = 0) -> np.ndarray:
    """The best label for each frame (rows of scores, summed along the path) so that collapsing them gives the targets."""
    path = np.full(2 * len(targets) + 1, blank)
    path[1::2] = targets
    skip = np.zeros(len(path), bool)
    skip[2:] = (path[2:] != blank) & (path[2:] != path[:-2])
    best = np.full(len(path), -np.inf)
    best[:2] = scores[0, path[:2]] if len(scores) else -np.inf
    back = np.zeros((len(scores), len(path)), np.int8)
    for t in range(1, len(scores)):
        options = np.stack([best, np.concatenate([[-np.inf], best[:-1]]), np.where(skip, np.concatenate([[-np.inf] * min(2, len(path)), best[:-2]]), -np.inf)])
        back[t] = options.argmax(0)
        best = options.max(0) + scores[t, path]
    if not len(scores):
        return np.zeros(0, np.int64)
    k = len(path) - 1 if len(path) < 2 or best[-1] > best[-2] else len(path) - 2
    out = []
    for t in range(len(scores) - 1, -1, -1):
        out.append(path[k])
        k -= back[t, k]
    return np.array(out[::-1])


def align_frames(scores: Column | str, targets: Column | str, blank: int = 0) -> Column:
    """forced_align() of each row's frames (an array of scores by label each) and targets; null or empty frames give no labels."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def each(frames: pd.Series, ids: pd.Series) -> pd.Series:
        def one(f, t):
            rows = [list(x) for x in _listed(f)]
            if not rows:
                return []
            return forced_align(np.array(rows, float).reshape(len(rows), -1), [int(x) for x in _listed(t)], blank).tolist()

        return pd.Series([one(f, t) for f, t in zip(frames, ids, strict=True)])

    return each(scores, targets)
