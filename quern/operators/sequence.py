"""Frame and token sequences: runs, collapsing, merging, stacking and placeholder expansion, in long form (a row a frame)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered, settled


def runs(df: DataFrame, key: str, order: list[str], symbol: str) -> DataFrame:
    """Adds t (frame from 0) and run (number of the run of equal symbols)."""
    w = Window.partitionBy(key).orderBy(*order)
    t = df.withColumn("t", F.row_number().over(w) - 1).withColumn("_new", (~F.lag(symbol).over(w).eqNullSafe(F.col(symbol))).cast("int"))
    return t.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def collapse(df: DataFrame, key: str, order: list[str], symbol: str, blank) -> DataFrame:
    """key, ids: symbols without repeats and blanks, in order (keys of blanks only have an empty list)."""
    r = runs(df, key, order, symbol).groupBy(key, "run").agg(F.first(symbol).alias("x"))
    listed = F.sort_array(F.collect_list(F.when(F.col("x") != F.lit(blank), F.struct("run", "x"))))
    return r.groupBy(key).agg(F.transform(listed, lambda e: e.x).alias("ids"))


def timestamps(df: DataFrame, key: str, order: list[str], symbol: str, blank, step_ms: int = 60, shift_ms: int = 30) -> DataFrame:
    """key, run, symbol, start and end in seconds of each run that is not blank."""
    at = lambda c: (c * step_ms - shift_ms) / 1000
    w = Window.partitionBy(key)
    g = runs(df, key, order, symbol).withColumn("_T", F.count("*").over(w)).groupBy(key, "run").agg(F.first(symbol).alias("symbol"), F.min("t").alias("s"), (F.max("t") + 1).alias("e"), F.first("_T").alias("T"))
    return g.where(F.col("symbol") != F.lit(blank)).select(key, "run", "symbol", F.greatest(at(F.col("s")), F.lit(0.0)).alias("start"), F.least(at(F.col("e")), at(F.col("T"))).alias("end"))


def greedy(df: DataFrame, key: str, frame: str, vector: str, blank: int = 0) -> DataFrame:
    """key and ids: the best entry of each frame's scores, without repeats and blanks."""
    best = df.select(key, frame, F.expr(f"array_position({vector}, array_max({vector})) - 1").alias("_id"))
    return collapse(best, key, [frame], "_id", blank)


#: Frames of a run that are added up in one go at most.
TOGETHER = 256


def _added(key: str, blank: int, threshold: float):
    """A function that takes sorted frames and gives a row for each run in its part: what names it, its frames' number and their sums.

    Blank frames, and runs that neither begin nor end the part, are whole: they stay if their mean blank probability is
    below the threshold.  Others come with a mark for the part's start and one for its end.
    """

    def run(batches):
        held, starts, out, form = None, True, [], None

        def close(ends):
            name, first, n, off, total = held
            whole = name[1] == blank or not (starts or ends)
            if not whole or off / n < threshold:
                out.append((*name, first, n, off, total, starts and not whole, ends and not whole))

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), form, strict=True)], schema=form)

        for batch in batches:
            form = pa.schema([batch.schema.field(key), ("best", pa.int32()), batch.schema.field("first"), ("frames", pa.int64()), ("off", pa.float64()), ("total", pa.list_(pa.float64())), ("starts", pa.bool_()), ("ends", pa.bool_())])
            names = list(zip(batch.column(key).to_pylist(), batch.column("best").to_pylist(), strict=True))
            first, off, at = batch.column("first"), batch.column("off").to_numpy(zero_copy_only=False), 0
            while at < len(names):
                end = at + 1
                while end < len(names) and end - at < TOGETHER and names[end] == names[at] and names[at][1] != blank:
                    end += 1
                total = np.array(batch.column("vector").slice(at, end - at).to_pylist(), float).sum(0)
                if held and held[0] == names[at] and names[at][1] != blank:
                    held = (*held[:2], held[2] + end - at, held[3] + float(off[at:end].sum()), held[4] + total)
                else:
                    if held:
                        close(False)
                        starts = False
                    held = (names[at], first[at].as_py(), end - at, float(off[at:end].sum()), total)
                at = end
            if len(out) > 1000:
                yield rows()
                out.clear()
        if held:
            close(True)
        if out:
            yield rows()

    return run


def merge_encoded(df: DataFrame, key: str, frame: str, vector: str, encoded: str, blank: int = 0, threshold: float = 0.9, length: str | None = None) -> DataFrame:
    """Posterior-guided merging: key, first, frames, blank (mean probability) and vector (the mean of `encoded`) of what stays.

    Runs of one best id that is not blank become one, blank frames stay by themselves; of all those stay whose mean
    blank probability is below the threshold.  With `length` only so many frames of a key count, numbered from 0 by
    `frame`.  Frames are dealt to ranges of key and frame, each task adds up the vectors of its runs (a row a run, not a
    row an element), and only runs that reach an edge of a range are put together afterwards, so one long key is many
    tasks' work.
    """
    best = F.expr(f"array_position({vector}, array_max({vector})) - 1").cast("int")
    rows = df if length is None else numbered(df, [key], [frame], "_t").where(F.col("_t") < F.col(length))
    rows = rows.select(F.col(key), F.col(frame).alias("first"), best.alias("best"), F.col(vector)[blank].cast("double").alias("off"), F.col(encoded).cast("array<double>").alias("vector"))
    kinds = dict(rows.dtypes)
    form = f"`{key}` {kinds[key]}, best int, first {kinds['first']}, frames long, off double, total array<double>, starts boolean, ends boolean"
    parts = settled(rows.repartitionByRange(key, "first").sortWithinPartitions(key, "first").mapInArrow(_added(key, blank, threshold), form))
    order = Window.partitionBy(key).orderBy("first")  # of two rows a range at most
    edges = parts.where("starts or ends")
    goes_on = F.col("starts") & F.lag("ends", 1, False).over(order) & (F.lag("best").over(order) == F.col("best"))
    edges = edges.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order))
    total = F.transform(F.sort_array(F.collect_list(F.struct("first", "total"))), lambda x: x["total"])
    whole = edges.groupBy(key, "_run").agg(F.min("first").alias("first"), F.sum("frames").alias("frames"), F.sum("off").alias("off"), total.alias("_all"))
    added = F.aggregate(F.slice("_all", 2, F.size("_all")), F.col("_all")[0], lambda x, y: F.zip_with(x, y, lambda p, q: p + q))
    columns = [key, "first", "frames", (F.col("off") / F.col("frames")).alias("blank"), F.transform("total", lambda x: x / F.col("frames")).alias("vector")]
    return parts.where("not starts and not ends").select(*columns).unionByName(whole.withColumn("total", added).select(*columns).where(F.col("blank") < threshold))


def position_ids(mask: Column | str) -> Column:
    """Places of the unmasked entries from 0 on; 1 for masked ones.  One sum along each mask."""

    @F.pandas_udf("array<int>")
    def each(masks: pd.Series) -> pd.Series:
        def one(m):
            if m is None:
                return None
            on = np.array([bool(x) for x in m], bool)
            return np.where(on, np.cumsum(on) - 1, 1).astype(np.int32)

        return masks.map(one)

    return each(mask)


def interleave(df: DataFrame, batch: list[str], ids: str, mask: str, labels: str, slots: str, placeholder: int, pad: int, ignore: int = -100) -> DataFrame:
    """Puts slots for features in the place of placeholders: the columns ids, mask, labels, and audio, position_ids and left.

    Rows are padded sequences: arrays of ids, of 0 and 1 (or booleans) and of labels, all of a length, and the numbers
    of slots of the row's placeholders in order.  Every slot has the pad's id and the ignored label, counts as unmasked
    and is true in audio.  The side of the padding is that of the batch: on the left if some mask begins with 0 and none
    ends with it, on the right if it is the other way round, on the left if there is no padding or one row only; both in
    a batch of several rows is an error.  So are masks with zeros amid ones, and slots that are not as many as the
    placeholders.  All rows of a batch come out as wide as its widest.
    """
    w = Window.partitionBy(*batch)
    on = F.transform(mask, lambda x: x.cast("int"))
    n = F.size(ids)
    rows = df.withColumn("_m", on).withColumns({"_l": F.max(F.coalesce(F.get("_m", F.lit(0)), F.lit(1)) == 0).over(w), "_r": F.max(F.coalesce(F.get("_m", F.size("_m") - 1), F.lit(1)) == 0).over(w), "_n": F.count("*").over(w)})
    fail = lambda text: F.raise_error(F.lit(text))
    left = F.when(F.col("_n") == 1, True).when(F.col("_l") & F.col("_r"), fail("masks of one batch have zeros on both sides").cast("boolean")).otherwise(~F.col("_r"))
    rows = rows.withColumn("left", left)
    live = F.aggregate("_m", F.lit(0), lambda a, x: a + x)
    even = F.array_sort("_m") == F.when((F.get("_m", F.lit(0)) == 0) & (live > 0), F.col("_m")).otherwise(F.reverse("_m"))
    token = F.arrays_zip(F.col(ids).alias("i"), F.col("_m").alias("m"), F.col(labels).alias("l"))
    rows = rows.withColumn("_t", F.when(~even, fail("a mask has zeros amid ones").cast(rows.select(token.alias("t")).schema["t"].dataType)).otherwise(F.filter(token, lambda x: x["m"] == 1)))
    rows = rows.withColumn("_at", F.filter(F.transform("_t", lambda x, i: F.when(x["i"] == placeholder, i)), lambda i: i.isNotNull()))
    wrong = F.size("_at") != F.size(slots)
    struct = lambda i, l, a: F.struct(i.cast("long").alias("i"), l.cast("long").alias("l"), a.alias("a"))  # noqa: E731, E741
    taken = F.transform("_t", lambda x, i: F.when(x["i"] == placeholder, F.array_repeat(struct(F.lit(pad), F.lit(ignore), F.lit(True)), F.get(F.col(slots), F.array_position("_at", i).cast("int") - 1).cast("int"))).otherwise(F.array(struct(x["i"], x["l"], F.lit(False)))))
    rows = rows.withColumn("_x", F.when(wrong, fail("a row has more or fewer slots than placeholders").cast("array<struct<i:bigint,l:bigint,a:boolean>>")).otherwise(F.flatten(taken)))
    used = F.size("_x")
    rows = rows.withColumn("_gap", F.max(used + n - live).over(w) - used)
    filled = lambda name, value, kind: F.when(F.col("left"), F.concat(F.array_repeat(F.lit(value), F.col("_gap")), F.transform("_x", lambda x: x[name]))).otherwise(F.concat(F.transform("_x", lambda x: x[name]), F.array_repeat(F.lit(value), F.col("_gap")))).cast(kind)
    begin = F.when(F.col("left"), F.col("_gap")).otherwise(0)
    places = F.transform(F.array_repeat(F.lit(0), used + F.col("_gap")), lambda _, i: i - begin)
    inside = lambda p: (p >= 0) & (p < used)
    out = rows.withColumns({"_ids": filled("i", pad, "array<long>"), "_labels": filled("l", ignore, "array<long>"), "audio": filled("a", False, "array<boolean>"), "_mask": F.transform(places, lambda p: inside(p).cast("int")), "position_ids": F.transform(places, lambda p: F.when(inside(p), p).otherwise(1))})
    return out.withColumns({ids: F.col("_ids"), labels: F.col("_labels"), mask: F.col("_mask")}).drop("_m", "_l", "_r", "_n", "_t", "_at", "_x", "_gap", "_ids", "_labels", "_mask")


def expanded_labels(df: DataFrame, key: str, token: str, label: str, placeholder: Column, pad: int, ignore: int = -100) -> DataFrame:
    """key, ids and labels of the new sequence, from rows with start and length of expand(): slots have the pad's id and are ignored."""
    own = df.where("length is not null").select(key, "start", F.col("length").cast("int").alias("_n"), F.when(placeholder, pad).otherwise(F.col(token)).alias("_t"), F.when(placeholder, ignore).otherwise(F.col(label)).alias("_l"))
    listed = own.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "_n", "_t", "_l"))).alias("_x"))  # a row a token, not one a slot
    spread = lambda name: F.flatten(F.transform("_x", lambda x: F.array_repeat(x[name], x["_n"])))
    return listed.select(key, spread("_t").alias("ids"), spread("_l").alias("labels"))


def merge_frames(df: DataFrame, key: str, frame: str, vector: str, blank: int = 0, threshold: float = 0.9, length: str | None = None) -> DataFrame:
    """merge_encoded() of the posteriors themselves: key, first, frames and the mean vector of what stays."""
    return merge_encoded(df, key, frame, vector, vector, blank, threshold, length).drop("blank")


def utterances(merged: DataFrame, keys: DataFrame, key: str, width: int, batch: str | None = None) -> DataFrame:
    """keys with length and vectors: the merged frames of each key in order, filled up with zeros of `width` to the longest of its batch.

    Without `batch` all keys are one.  A key of which no frame is left, or that had none, has length 0 and zeros only;
    where that is so for a whole batch its keys have no vectors.
    """
    own = merged.groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_list(F.struct("first", "vector"))).alias("_v"))
    rows = keys.join(own, keys[key].eqNullSafe(F.col("_key")), "left").withColumn("_v", F.coalesce(F.transform("_v", lambda x: x["vector"]), F.expr("cast(array() as array<array<double>>)")))
    rows = rows.withColumn("length", F.size("_v"))
    most = F.max("length").over(Window.partitionBy(F.lit(0) if batch is None else F.col(batch)))
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0), width), most - F.col("length"))
    return rows.withColumn("vectors", F.concat("_v", zeros)).drop("_key", "_v")


def stack(df: DataFrame, key: str, frame: str, vector: str, k: int) -> DataFrame:
    """k neighbouring frames become one; a rest of fewer is dropped."""
    w = Window.partitionBy(key).orderBy(frame)
    g = df.withColumn("_t", F.row_number().over(w) - 1).groupBy(key, F.floor(F.col("_t") / k).alias("step"))
    return g.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_t", vector))), lambda e: e[vector])).alias("stacked"), F.count("*").alias("_n")).where(F.col("_n") == k).drop("_n")


def expand(df: DataFrame, key: str, order: list[str], placeholder: Column, slots: Column) -> DataFrame:
    """Adds start and length: a placeholder takes `slots` positions of the new sequence, any other token one."""
    w = Window.partitionBy(key).orderBy(*order)
    n = F.when(placeholder, slots).otherwise(1).cast("long")
    d = df.withColumn("length", n)
    return d.withColumn("start", F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
