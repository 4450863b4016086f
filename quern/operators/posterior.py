"""Distributions over a vocabulary as arrays: softmax, divergence, cross-entropy, entropy, agreement, resampling."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession, Window

from .numbering import settled

TINY = 1e-12


def _bound(c: Column, use) -> Column:
    """use(c) with c worked out once, not for each element that it is used for."""
    return F.transform(F.array(c), use)[0]


def softmax(v: Column) -> Column:
    v = v.cast("array<double>")
    e = _bound(v, lambda a: _bound(F.array_max(a), lambda m: F.transform(a, lambda x: F.exp(x - m))))
    return _bound(e, lambda a: _bound(_sum(a), lambda total: F.transform(a, lambda x: x / total)))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, b: a + b)


def _floor(x: Column) -> Column:
    return F.greatest(x, F.lit(TINY))


def js_distance(p: Column, q: Column) -> Column:
    kl = lambda a, b: _floor(a) * (F.log(_floor(a)) - F.log((_floor(a) + _floor(b)) / 2))
    return F.sqrt(F.greatest(_sum(F.zip_with(p, q, lambda a, b: 0.5 * kl(a, b) + 0.5 * kl(b, a))), F.lit(0.0)))


def cross_entropy(p: Column, q: Column) -> Column:
    """Mean of both directions."""
    return _sum(F.zip_with(p, q, lambda a, b: -0.5 * (_floor(a) * F.log(_floor(b)) + _floor(b) * F.log(_floor(a)))))


def entropy(p: Column) -> Column:
    return _sum(F.transform(p, lambda a: -_floor(a) * F.log(_floor(a))))


def best(p: Column) -> Column:
    """The lowest index of the largest value."""
    return F.array_position(p, F.array_max(p)) - 1


def ban(v: Column, k: int) -> Column:
    """Scores with entry k made the least there is."""
    return F.transform(v, lambda x, i: F.when(i == k, F.lit(float("-inf"))).otherwise(x))


def probabilities(df: DataFrame, vector: str) -> DataFrame:
    """df with log probabilities (no entry of any row above 0) turned into probabilities."""
    top = df.agg(F.max(F.array_max(vector)).alias("_top"))
    both = df.crossJoin(F.broadcast(top))  # one row
    return both.withColumn(vector, F.when(F.col("_top") <= 0, F.transform(vector, F.exp)).otherwise(F.col(vector))).drop("_top")


def resample(df: DataFrame, key: str, frame: str, vector: str, lengths: DataFrame) -> DataFrame:
    """key, t and the vector of the frames of each key at the length of `lengths` (key, length).

    Frames are numbered from 0 in the order of `frame`; their logs are interpolated linearly (half-pixel centres) and
    made probabilities again, also where the length stays.  A key without a length goes.
    """
    w = Window.partitionBy(key)
    rows = df.select(key, (F.row_number().over(w.orderBy(frame)) - 1).cast("long").alias("t"), F.transform(F.col(vector).cast("array<double>"), lambda x: F.log(_floor(x))).alias("v"))
    size = rows.groupBy(key).agg(F.count("*").alias("n"))
    target = size.join(lengths.select(key, "length"), key).select(key, "n", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length").cast("long") - 1)).alias("t"))
    src = F.greatest((F.col("t") + 0.5) * F.col("n") / F.col("length") - 0.5, F.lit(0.0))
    low = F.least(F.floor(src), F.col("n") - 1)
    target = target.select(key, "t", low.alias("low"), F.least(low + 1, F.col("n") - 1).alias("high"), (src - low).alias("w"))
    a = rows.select(key, F.col("t").alias("low"), F.col("v").alias("a"))
    b = rows.select(key, F.col("t").alias("high"), F.col("v").alias("b"))
    both = target.join(a, [key, "low"]).join(b, [key, "high"])
    mixed = F.zip_with("a", "b", lambda x, y: x * (1 - F.col("w")) + y * F.col("w"))
    return both.select(key, "t", F.transform(softmax(mixed), _floor).alias(vector))


#: The columns of a comparison.
METRICS = ("js", "sce", "top1_acc", "entropy_a", "entropy_b", "blank_frac_a", "blank_frac_b", "edit_dist", "edit_norm", "len_a", "len_b")


def compare(a: DataFrame, b: DataFrame, key: str, frame: str, vector: str, blank: int = 0) -> DataFrame:
    """key and METRICS for each key that both sides (key, frame, vector) have, both brought to the longer one's length."""
    from .align import edit_distance
    from .sequence import collapse

    size = lambda d, n: d.groupBy(key).agg(F.count("*").alias(n))
    lengths = size(a, "x").join(size(b, "y"), key).select(key, F.greatest("x", "y").alias("length"))
    p, q = (resample(d, key, frame, vector, lengths) for d in (a, b))
    both = p.withColumnRenamed(vector, "p").join(q.withColumnRenamed(vector, "q"), [key, "t"])
    p, q = F.col("p"), F.col("q")
    best_p, best_q = best(p), best(q)
    rows = both.select(key, "t", js_distance(p, q).alias("js"), cross_entropy(p, q).alias("sce"), entropy(p).alias("ep"), entropy(q).alias("eq"), best_p.alias("ip"), best_q.alias("iq"))
    share = lambda c: F.avg(c.cast("double"))
    means = rows.groupBy(key).agg(
        F.avg("js").alias("js"), F.avg("sce").alias("sce"), share(F.col("ip") == F.col("iq")).alias("top1_acc"), F.avg("ep").alias("entropy_a"), F.avg("eq").alias("entropy_b"),
        share(F.col("ip") == blank).alias("blank_frac_a"), share(F.col("iq") == blank).alias("blank_frac_b"),
    )
    x, y = (collapse(rows, key, ["t"], c, blank).withColumnRenamed("ids", n) for c, n in (("ip", "x"), ("iq", "y")))
    texts = x.join(y, key).withColumn("edit_dist", edit_distance(F.col("x").cast("array<string>"), F.col("y").cast("array<string>")))
    len_a, len_b = F.size("x"), F.size("y")
    out = means.join(texts, key).withColumn("edit_norm", F.col("edit_dist") / F.greatest(len_a, len_b, F.lit(1)))
    return out.withColumns({"len_a": len_a, "len_b": len_b}).select(key, *METRICS)


def listed_keys(groups: dict[str, DataFrame], key: str, of: str = "ctc") -> DataFrame:
    """The keys of the group `of`, one row each, in order; one that another group lacks is an error."""
    out = groups[of].select(key).distinct()
    for name in groups:
        if name != of:
            there = groups[name].select(F.col(key).alias("_key")).distinct()
            found = out.join(there, F.col(key) == F.col("_key"), "left")
            out = found.select(F.coalesce("_key", F.raise_error(F.concat(F.lit(f"{name} has no "), F.col(key).cast("string"))).cast(dict(out.dtypes)[key])).alias(key))
    return out.orderBy(key)


def cached_groups(spark: SparkSession, folder: str, names: tuple[str, ...] = ("ctc", "clean", "noise")) -> dict[str, DataFrame]:
    """The groups of a posterior cache: Parquet in a folder `group=name` each, with key, frame and p."""
    every = spark.read.parquet(folder)
    return {n: every.where(F.col("group") == n).drop("group") for n in names}


def write_groups(groups: dict[str, DataFrame], folder: str) -> None:
    for name, rows in groups.items():
        rows.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/group={name}")


def comparison(groups: dict[str, DataFrame], key: str, frame: str, vector: str, blank: int = 0) -> DataFrame:
    """The row of 35 columns for each key that all of ctc, clean and noise have: key, METRICS of three pairs, and delta."""
    out = None
    for x, y in (("ctc", "clean"), ("ctc", "noise"), ("noise", "clean")):
        names = [m[:-1] + {"a": x, "b": y}[m[-1]] if m[-2:] in ("_a", "_b") else m for m in METRICS]
        one = compare(groups[x], groups[y], key, frame, vector, blank).select(key, *[F.col(m).alias(f"{x}_{y}_{n}") for m, n in zip(METRICS, names, strict=True)])
        out = one if out is None else out.join(one, key)
    return out.withColumn("delta", F.col("ctc_noise_js") - F.col("ctc_clean_js"))


def delta_summary(rows: DataFrame) -> DataFrame:
    """The mean delta and the percentage of keys where it is below 0."""
    return rows.agg(F.avg("delta").alias("mean_delta"), (F.avg((F.col("delta") < 0).cast("double")) * 100).alias("below_zero"))


def write_comparison(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


#: Bytes of a block of an embedding table.
BLOCK = 256 << 20


def soft_embedding(df: DataFrame, key: list[str], vector: str, table: DataFrame, blank_last: bool = False, block: int | None = None) -> DataFrame:
    """key, h and x: the sum over v of the vector's entry v and the table's (v, h, e); its last entry can be left out as the blank.

    The table's rows are packed into blocks of neighbouring v (of BLOCK bytes, or `block` of them), and each pass over
    the frames adds what one block has: a product of matrices for many frames at a time, no row for a frame and an
    entry.  Entries that the table lacks count as 0; h runs from 0 to the table's greatest.
    """
    spark = df.sparkSession
    width = (table.agg(F.max("h")).first()[0] if table.columns else None) or 0
    width += 1
    block = block or max(1, BLOCK // (8 * width))

    def dense(part: pa.Table) -> pa.Table:
        m = np.zeros((block, width))
        v = part.column("v").to_numpy() % block
        np.add.at(m, (v, part.column("h").to_numpy()), part.column("e").to_numpy())
        return pa.table({"block": part.column("block").slice(0, 1), "matrix": pa.array([m[: v.max() + 1].tobytes()], pa.binary())})

    rows = table.select(F.col("v").cast("long").alias("v"), F.col("h").cast("long").alias("h"), F.col("e").cast("double").alias("e"), F.expr(f"cast(v div {block} as long)").alias("block"))
    blocks = settled(rows.groupBy("block").applyInArrow(dense, "block long, matrix binary"))
    v = F.col(vector)
    v = softmax(F.slice(v, 1, F.size(v) - 1)) if blank_last else v.cast("array<double>")
    state = df.select(*key, v.alias("_p"), F.lit(None).cast("array<double>").alias("_x"))
    form = state.schema
    names = [r.block for r in blocks.select("block").orderBy("block").collect()]  # a number for each block
    for k, name in enumerate(names):
        matrix = blocks.where(F.col("block") == name).first()["matrix"]  # of `block` rows
        sent = spark.sparkContext.broadcast(bytes(matrix))

        def add(batches, sent=sent, at=name * block):
            for b in batches:
                m = np.frombuffer(sent.value).reshape(-1, width)
                p, x = b.column("_p").to_pylist(), b.column("_x").to_pylist()
                own = np.zeros((len(p), len(m)))
                for i, f in enumerate(p):
                    part = (f or [])[at : at + len(m)]
                    own[i, : len(part)] = part
                out = own @ m + np.array([y or [0.0] * width for y in x]).reshape(-1, width)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(list(out), pa.list_(pa.float64()))], schema=b.schema)

        state = state.mapInArrow(add, form)
        if k < len(names) - 1:
            state = settled(state)
            sent.unpersist()
    return state.select(*key, F.posexplode("_x").alias("h", "x"))


def top1_gather(df: DataFrame, key: list[str], vector: str, table: DataFrame) -> DataFrame:
    """key, h and x: the table's row of the vector's best entry."""
    return df.select(*key, best(F.col(vector)).alias("v")).join(table, "v").select(*key, "h", F.col("e").alias("x"))


def pseudo_posterior(df: DataFrame, key: str, ids: str, size: int, alpha: Column | None = None, keep: Column | None = None) -> DataFrame:
    """key, t, id, p (of the id) and rest (of each other entry of `size`) for the ids of each text.

    Without alpha and keep rows are one-hot.  alpha (of key) is the mass spread over all entries; keep (of key, at and
    id) says which places stay, and t numbers those.
    """
    long = df.select(key, F.posexplode(ids).alias("at", "id"), (F.lit(0.0) if alpha is None else alpha).cast("double").alias("alpha"))
    long = long if keep is None else long.where(keep)
    t = F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1
    return long.select(key, t.alias("t"), "id", (1 - F.col("alpha") + F.col("alpha") / size).alias("p"), (F.col("alpha") / size).alias("rest"))


def with_insertions(rows: DataFrame, key: str, share: float, place: Callable[[Column, Column], Column], copied: Callable[[Column, Column], Column], blank: int = 0) -> DataFrame:
    """pseudo_posterior()'s rows (key, t, id, p, rest) of each key with floor(n * share) rows put in, and t numbered anew.

    place(j, n) and copied(j, n) are columns (that may also use the key) of an insertion's number j from 0 and the key's
    rows n: before which of the rows 0 to n it goes (n: behind all), and whether it repeats the row before that place
    (the first row at place 0) or is the blank alone.  Insertions at one place go by j.  Each is known by its key and
    number alone, so they are made side by side, and a row moves once.
    """
    n = rows.groupBy(key).agg(F.count("*").alias("_n"))
    put = n.withColumn("_j", F.explode(F.sequence(F.lit(0), F.floor(F.col("_n") * share).cast("int") - 1))).where(F.floor(F.col("_n") * share) > 0)
    at = F.least(F.greatest(place(F.col("_j"), F.col("_n")), F.lit(0)), F.col("_n")).cast("int")
    put = put.select(key, "_j", at.alias("_at"), copied(F.col("_j"), F.col("_n")).alias("_copy"))
    put = put.withColumn("_of", F.when(F.col("_copy"), F.greatest(F.col("_at") - 1, F.lit(0))))
    own = rows.select(F.col(key).alias("_key"), F.col("t").alias("_t"), "id", "p", "rest")
    found = put.join(own, put[key].eqNullSafe(F.col("_key")) & (F.col("_of") == F.col("_t")), "left")
    alone = F.col("_copy")
    new = found.select(key, F.col("_at"), F.lit(0).alias("_own"), "_j", F.when(alone, F.col("id")).otherwise(blank).cast(dict(rows.dtypes)["id"]).alias("id"), F.when(alone, F.col("p")).otherwise(1.0).alias("p"), F.when(alone, F.col("rest")).otherwise(0.0).alias("rest"))
    old = rows.select(key, F.col("t").alias("_at"), F.lit(1).alias("_own"), F.lit(0).alias("_j"), "id", "p", "rest")
    t = F.row_number().over(Window.partitionBy(key).orderBy("_at", "_own", "_j")) - 1
    return old.unionByName(new).select(key, t.alias("t"), "id", "p", "rest")


def inserted(df: DataFrame, key: str, ids: str, size: int, share: float, place: Callable[[Column, Column], Column], copied: Callable[[Column, Column], Column], alpha: Column | None = None, blank: int = 0) -> DataFrame:
    """with_insertions() of pseudo_posterior() for texts of one row a key, each put together within its row: nothing is shuffled."""
    texts = df.where(F.col(ids).isNotNull()).select(key, F.col(ids).alias("_ids"), F.size(ids).alias("_n"), (F.lit(0.0) if alpha is None else alpha).cast("double").alias("_alpha"))
    kind, n = texts.schema["_ids"].dataType.elementType, F.col("_n")
    many = F.floor(n * share).cast("int")
    numbers = F.when(many > 0, F.sequence(F.lit(0), F.greatest(many - 1, F.lit(0)))).otherwise(F.expr("cast(array() as array<int>)"))
    row = lambda at, own, j, x, as_text: F.struct(at.cast("int").alias("at"), F.lit(own).alias("own"), j.cast("int").alias("j"), x.cast(kind).alias("id"), as_text.alias("as_text"))
    at = lambda j: F.least(F.greatest(place(j, n), F.lit(0)), n)
    taken = lambda j: F.get("_ids", F.greatest(at(j) - 1, F.lit(0)).cast("int"))
    new = F.transform(numbers, lambda j: row(at(j), 0, j, F.when(copied(j, n), taken(j)).otherwise(F.lit(blank)), F.coalesce(copied(j, n), F.lit(False))))
    old = F.transform("_ids", lambda x, i: row(i, 1, F.lit(0), x, F.lit(True)))
    long = texts.select(key, "_alpha", F.posexplode(F.sort_array(F.concat(old, new))).alias("t", "_x"))
    rest = F.col("_alpha") / size
    own = F.col("_x")["as_text"]
    return long.select(key, "t", F.col("_x")["id"].alias("id"), F.when(own, 1 - F.col("_alpha") + rest).otherwise(1.0).alias("p"), F.when(own, rest).otherwise(0.0).alias("rest"))


def sinusoid(t: Column, depth: int) -> Column:
    """Sines, then cosines, of the place t (from 1 on) at depth / 2 falling frequencies."""
    half = depth // 2
    angles = [t * float(10000.0 ** (-i / (half - 1))) for i in range(half)]
    return F.array(*[F.sin(x) for x in angles], *[F.cos(x) for x in angles])
