"""Greedy batches bounded by padded size, padding and collation."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import register


@dataclass(frozen=True)
class Policy:
    """How a sequence of rows falls into batches: a fold whose state is a tuple of numbers.

    columns: what a step sees of a row.  start: the state of a batch without rows.  step: from the state and the row's
    values to the state with the row in it, or None where the row has to begin the next batch.  form: the state as a schema.
    A batch takes its first row whatever the step says of it.
    """

    columns: tuple[str, ...]
    start: tuple
    step: Callable[..., tuple | None]
    form: str

    def first(self, *values) -> tuple:
        """The state of a batch of one row."""
        return self.step(self.start, *values, first=True)


@register("policy", "padded")
def padded(size: str, limit: int) -> Policy:
    """Rows times the longest of them stay within the limit."""

    def step(state, s, first=False):
        n, longest = state[0] + 1, max(state[1], int(s))
        return (n, longest) if first or n * longest <= limit else None

    return Policy((size,), (0, 0), step, "n long, longest long")


@register("policy", "total")
def total(size: str, limit: int) -> Policy:
    """The sum of the sizes stays within the limit."""

    def step(state, s, first=False):
        held = state[0] + int(s)
        return (held,) if first or held <= limit else None

    return Policy((size,), (0,), step, "held long")


@register("policy", "frames")
def frames_and_tokens(tokens: str, frames: str, limit: int, ds_rate: int = 1) -> Policy:
    """As padded, of rows as long as their tokens with frames // ds_rate slots in the place of one of them."""

    def step(state, t, f, first=False):
        n, longest = state[0] + 1, max(state[1], int(t) + int(f) // ds_rate - 1)
        return (n, longest) if first or n * longest <= limit else None

    return Policy((tokens, frames), (0, 0), step, "n long, longest long")


def folded(policy: Policy, rows: Iterable[tuple], batch: int = 0, state: tuple | None = None) -> tuple[list[int], int, tuple | None]:
    """The batch numbers of rows (the policy's values), and the open batch and its state, from those of an earlier call on."""
    out = []
    for values in rows:
        after = policy.first(*values) if state is None else policy.step(state, *values)
        if after is None:
            batch, after = batch + 1, policy.first(*values)
        state = after
        out.append(batch)
    return out, batch, state


def fold(sizes, limit: int) -> list[int]:
    """Batch numbers under padded(): an element that would make (count + 1) * longest exceed the limit starts the next batch."""
    return folded(padded("", limit), ((s,) for s in sizes))[0]


def dynamic_batches(df: DataFrame, shard: str, order: list[str], size: str | Policy, limit: int | None = None) -> DataFrame:
    """Adds batch, the number in the shard, by a policy, or by padded(size, limit).

    A shard is a sequence by definition, so one task folds it, in a few numbers of memory; shards run side by side.
    """
    policy = padded(size, limit) if isinstance(size, str) else size
    form = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", batch int"

    def run(batches):
        of, batch, state, begun = None, 0, None, False
        for b in batches:
            keys, values = b.column(shard).to_pylist(), list(zip(*(b.column(c).to_pylist() for c in policy.columns), strict=True))
            out, at = [], 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if not begun or keys[at] != of:
                    of, batch, state, begun = keys[at], 0, None, True
                numbers, batch, state = folded(policy, values[at:end], batch, state)
                out += numbers
                at = end
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], [*b.schema.names, "batch"])

    return df.repartition(shard).sortWithinPartitions(shard, *order).mapInArrow(run, form)


def pad(c, width, value, left: bool = False):
    """An array filled up, or cut, to `width` with a value."""
    fill = F.array_repeat(F.lit(value), F.greatest(width - F.size(c), F.lit(0)))
    kept = F.slice(c, 1, F.least(F.size(c), width))
    return F.concat(fill, kept) if left else F.concat(kept, fill)


def collate(df: DataFrame, batch: list[str], fills: dict[str, object], left: bool) -> DataFrame:
    """Pads the array columns of `fills`, each with its value, to the longest of the batch by the first of them; adds width.

    Sequences pad on the left for inference and on the right for training.
    """
    w = Window.partitionBy(*batch)
    out = df.withColumn("width", F.max(F.size(next(iter(fills)))).over(w))
    return out.withColumns({c: pad(F.col(c), F.col("width"), value, left) for c, value in fills.items()})


def batches(df: DataFrame, batch: list[str], order: str, columns: list[str]) -> DataFrame:
    """A row a batch with the lists of its rows' columns, in order."""
    rows = F.sort_array(F.collect_list(F.struct(order, *columns)))
    return df.groupBy(*batch).agg(rows.alias("_rows")).select(*batch, *[F.col("_rows")[c].alias(c) for c in columns])


def length_mask(length, width):
    """True for the first `length` of `width` places."""
    return F.transform(F.sequence(F.lit(1), width), lambda t: t <= length)


def with_queries(frames, length, queries: list):
    """Frames with the query frames (arrays, null ones left out) in front, and their length; what drop_prefix() takes off again."""
    front = F.filter(F.array(*queries), lambda q: q.isNotNull())
    return F.concat(front, F.coalesce(frames, F.slice(front, 1, 0))), F.coalesce(length, F.lit(0)) + F.size(front)


def drop_prefix(frames, length, n: int = 4):
    """Frames without the first n, and their length."""
    return F.slice(frames, n + 1, F.greatest(F.size(frames) - n, F.lit(0))), F.greatest(length - n, F.lit(0))


def downsampled(length, k: int):
    return F.floor(length / k)


def audio_seconds(df: DataFrame, batch: list[str], length: str, shift_ms: float = 10, frames: int = 6) -> DataFrame:
    """Seconds of audio in each batch of stacked frames."""
    return df.groupBy(*batch).agg((F.sum(length) * shift_ms * frames / 1000).alias("seconds"))
