"""Attention, convolutions, filter banks and beam search against plain definitions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import filterbank
from quern.operators import attention, beam, convolution
from quern.operators.numbering import numbered
from quern.streaming.attention_stream import chunk_attention_stream

FORM = "u string, o int, v array<double>, t string, out int"


def made(lengths, width=4, seed=0):
    rng = np.random.default_rng(seed)
    return {u: rng.normal(size=(n, width)) for u, n in lengths.items()}


def table(spark, sequences):
    rows = [(u, 10 * i, x.tolist(), "x", 1) for u, s in sequences.items() for i, x in enumerate(s)]
    rng = np.random.default_rng(1)
    return spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))] if rows else [], FORM).repartition(3)


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r[0], {})[r.t] = r.out
    return {u: np.array([x[i] for i in sorted(x)]) for u, x in out.items() if sorted(x) == list(range(len(x)))}


def same(a, b):
    b = {u: x for u, x in b.items() if len(x)}
    assert a.keys() == b.keys()
    for u in a:
        assert np.allclose(a[u], b[u], atol=1e-9), u


def test_numbered(spark):
    rows = [("a", i % 3, None) for i in range(500)] + [("b", 5, "x"), (None, 1, "y"), (None, 0, "z"), ("c", None, "w")]
    df = spark.createDataFrame(rows, "k string, o int, part string").repartition(7)
    out = numbered(df, ["k"], ["o"]).collect()
    for key in ("a", "b", "c", None):
        own = sorted((r.n, r.o if r.o is not None else -1) for r in out if r.k == key)
        assert [x[0] for x in own] == list(range(len(own))) and [x[1] for x in own] == sorted(x[1] for x in own)
    every = numbered(df, [], ["k", "o"], "row").collect()
    assert sorted(r.row for r in every) == list(range(504)) and {r.k for r in every if r.row < 2} == {None}
    assert numbered(df.where("false"), ["k"], ["o"]).collect() == []


def attended(x, stride, right, look_back, heads):
    out, width = [], x.shape[1] // heads
    for c in range((len(x) - right) // stride if len(x) >= right else 0):
        seen = x[max(0, (c - look_back) * stride) : (c + 1) * stride + right]
        for q in x[c * stride : (c + 1) * stride]:
            row = []
            for h in range(heads):
                s = slice(h * width, (h + 1) * width)
                w = [math.exp(q[s] @ k[s] / math.sqrt(width)) for k in seen]
                row += (sum(a * k[s] for a, k in zip(w, seen, strict=True)) / sum(w)).tolist()
            out.append(row)
    return np.array(out)


@pytest.mark.parametrize(("stride", "right", "look_back", "heads"), [(4, 2, 2, 2), (3, 0, 1, 1), (2, 5, 0, 4)])
def test_chunk_attention(spark, stride, right, look_back, heads):
    x = made({"a": 43, "b": 1, "c": stride + right, "d": 12})
    out = attention.chunk_attention(table(spark, x), "u", ["o"], "v", stride, right, look_back, heads)
    same(got(out), {u: attended(s, stride, right, look_back, heads) for u, s in x.items()})
    assert attention.chunk_attention(table(spark, {}), "u", ["o"], "v", stride).collect() == []


@pytest.mark.parametrize("look_back", [2, -1])
def test_chunk_stream(spark, tmp_path, look_back):
    """The stream's rows are the table's, however the rows fall into triggers, and across a restart."""
    x = made({"a": 37, "b": 3, "c": 14}, seed=2)
    rows = [(u, i, v.tolist()) for u, s in x.items() for i, v in enumerate(s)]
    rows.sort(key=lambda r: (r[1], r[0]))
    form = "u string, o int, v array<double>"
    for a, b in itertools.pairwise([0, 6, 30, len(rows)]):  # each a query of its own that takes up the last one's state
        spark.createDataFrame(rows[a:b], form).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = chunk_attention_stream(spark.readStream.schema(form).parquet(f"{tmp_path}/in"), "u", ["o"], "v", 4, 2, look_back, 2)
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
    same(got(spark.read.parquet(f"{tmp_path}/out")), {u: attended(s, 4, 2, 99 if look_back < 0 else look_back, 2) for u, s in x.items()})


@pytest.mark.parametrize("block", [3, None])
def test_cross_attention(spark, block):
    rng = np.random.default_rng(5)
    q, k = 9 * rng.normal(size=(11, 6)), 9 * rng.normal(size=(17, 6))
    k[3] = k[4]
    frames = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)] + [(11, None)], "i int, v array<double>").repartition(3)
    words = spark.createDataFrame([(x.tolist(),) for x in k] + [(None,)], "e array<double>")
    out = {r.i: r.out for r in attention.cross_attention(frames, ["i"], "v", words, "e", 3, block).collect()}
    assert out[11] is None
    for i, x in enumerate(q):
        want = []
        for h in range(3):
            s = slice(2 * h, 2 * h + 2)
            z = k[:, s] @ x[s] / math.sqrt(2)
            w = np.exp(z - z.max())
            want += (w @ k[:, s] / w.sum()).tolist()
        assert np.allclose(out[i], want)
    if block == 3:
        assert {r.out for r in attention.cross_attention(frames, ["i"], "v", words.where("false"), "e").collect()} == {None}
        assert attention.cross_attention(frames.where("false"), ["i"], "v", words, "e").collect() == []


def convolved(x, w, stride, left, right, bias=0, residual=False, mask=None):
    k, live = len(w), np.ones(len(x), bool) if mask is None else mask
    x = x * live[:, None]
    padded = np.concatenate([np.zeros((left, x.shape[1])), x, np.zeros((right, x.shape[1]))])
    out = []
    for s in range((len(padded) - k) // stride + 1 if len(padded) >= k else 0):
        seen = padded[s * stride : s * stride + k]
        y = (seen * w).sum(0) if w.ndim == 2 else np.einsum("kd,kdo->o", seen, w)
        y = y + bias + (x[s] if residual else 0)
        out.append(y * live[s] if mask is not None else y)
    return np.array(out)


@pytest.mark.parametrize("stretch", [4])
def test_convolutions(spark, stretch):
    rng = np.random.default_rng(6)
    x = made({"a": 41, "b": 1, "c": 8, "d": 3}, seed=3)
    df = table(spark, x)
    w, mix = rng.normal(size=(5, 4)), rng.normal(size=(3, 4, 2))
    for stride, left, right in ((1, 2, 2), (1, 4, 0), (2, 1, 3), (3, 0, 0), (7, 0, 1)):
        out = convolution.convolve(df, "u", ["o"], "v", w, stride, left, right, stretch=stretch)
        same(got(out), {u: convolved(s, w, stride, left, right) for u, s in x.items()})
    same(got(convolution.memory(df, "u", ["o"], "v", w, 1, stretch=stretch)), {u: convolved(s, w, 1, 3, 1, residual=True) for u, s in x.items()})
    same(got(convolution.strided(df, "u", ["o"], "v", mix, [1, 2], stretch)), {u: convolved(s, mix, 3, 0, 0, np.array([1, 2])) for u, s in x.items()})
    masked = df.withColumn("m", F.when(F.col("o") % 30 != 0, True))
    want = {u: convolved(s, w, 1, 2, 2, residual=True, mask=np.arange(len(s)) % 3 != 0) for u, s in x.items()}
    same(got(convolution.memory(masked, "u", ["o"], "v", w, mask="m", stretch=stretch)), want)
    assert convolution.strided(df.where("false"), "u", ["o"], "v", mix).collect() == []


def test_one_sequence_is_many_tasks(spark):
    """A sequence of all rows is numbered and convolved in stretches, none of which sees much more than its own frames."""
    df = spark.range(3000).select(F.lit("u").alias("u"), F.col("id").alias("o"), F.array(F.col("id").cast("double")).alias("v")).repartition(6)
    out = got(convolution.convolve(df, "u", ["o"], "v", [[1.0], [1.0]], stretch=100))["u"][:, 0]
    assert out.tolist() == [2 * i + 1 for i in range(2999)]


def naive_bank(x, f):
    n, step, size = f.samples
    rows, w = [], filterbank.window(f.window, n)
    for a in range(0, len(x) - n + 1, step):
        y = np.array(x[a : a + n], float)
        y -= y.mean()
        energy = math.log(max((y**2).sum(), f.floor, filterbank.LEAST))
        y = np.array([(y[i] - f.emphasis * y[max(0, i - 1)]) * w[i] for i in range(n)])
        power = [abs(sum(y[i] * np.exp(-2j * math.pi * i * k / size) for i in range(n))) ** 2 for k in range(size // 2)]
        high = f.high if f.high > 0 else f.rate / 2 + f.high
        m = lambda z: 1127 * math.log(1 + z / 700)
        gap, row = (m(high) - m(f.low)) / (f.bins + 1), []
        for b in range(f.bins):
            left = m(f.low) + b * gap
            total = sum(p * max(0, min((m(k * f.rate / size) - left) / gap, (left + 2 * gap - m(k * f.rate / size)) / gap)) for k, p in enumerate(power))
            row.append(math.log(max(total, filterbank.LEAST)))
        rows.append((row + [energy] if f.energy_last else [energy] + row) if f.energy else row)
    return np.array(rows)


@pytest.mark.parametrize("form", [filterbank.Form(800, 5, 20, 10), filterbank.Form(1000, 4, 25, 7, window="povey", energy=True), filterbank.Form(640, 6, 25, 10, window="hanning", low=0, high=300, energy=True, energy_last=True)])
def test_filter_bank(form):
    x = np.random.default_rng(8).normal(size=90)
    assert np.allclose(filterbank.filter_bank(x, form), naive_bank(x, form))
    assert filterbank.filter_bank(x[:5], form).shape == (0, form.bins + form.energy)
    assert np.isfinite(filterbank.filter_bank(np.zeros(60), form)).all()


def test_filter_bank_column(spark):
    form = filterbank.Form(800, 5, 20, 10, dither=0.1)
    df = spark.createDataFrame([(1, [0.5, -0.5] * 30), (2, None), (3, []), (4, [0.5, -0.5] * 30)], "i int, s array<float>")
    out = {r.i: r.f for r in df.select("i", filterbank.features("s", form, F.col("i")).alias("f")).collect()}
    assert out[2] is None and out[3] == [] and len(out[1]) == 6 and out[1] != out[4]
    assert out == {r.i: r.f for r in df.repartition(3).select("i", filterbank.features("s", form, F.col("i")).alias("f")).collect()}
    assert {r.i: r.f and len(r.f[0]) for r in df.select("i", filterbank.features("s", form, stack=(7, 6)).alias("f")).collect()}[1] == 35
    frames = np.arange(10.0).reshape(5, 2)
    assert filterbank.low_frame_rate(frames, 3, 2).tolist() == [[0, 1, 0, 1, 2, 3], [2, 3, 4, 5, 6, 7], [6, 7, 8, 9, 8, 9]]
    with pytest.raises(ValueError):
        filterbank.window("square", 4)


def exhaustive(logs, blank):
    mass = {}
    for path in itertools.product(range(logs.shape[1]), repeat=len(logs)):
        ids = tuple(c for i, c in enumerate(path) if c != blank and (not i or path[i - 1] != c))
        mass[ids] = mass.get(ids, 0) + math.exp(sum(logs[i][c] for i, c in enumerate(path)))
    return sorted(((p, math.log(m)) for p, m in mass.items() if m > 0), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize(("seed", "blank"), [(1, 0), (2, 2), (3, 1)])
def test_beam_search(seed, blank):
    rng = np.random.default_rng(seed)
    for n in (0, 1, 2, 5, 6):
        p = rng.dirichlet(np.ones(3), n).reshape(n, 3)
        with np.errstate(divide="ignore"):
            want = exhaustive(np.log(p), blank)
            found = beam.prefix_beam(np.log(p), 1000, blank)
        assert [x[0] for x in found] == [x[0] for x in want] and np.allclose([x[1] for x in found], [x[1] for x in want])
        assert beam.prefix_beam(np.log(p), 1, blank)[0][1] <= want[0][1] + 1e-9


def test_beam_ties_and_column(spark):
    even = [[math.log(1 / 3)] * 3] * 2
    found = beam.prefix_beam(map(np.array, even), 9, 0)
    assert [p for p, _ in found] == [(1,), (2,), (), (1, 2), (2, 1)]
    df = spark.createDataFrame([(1, even), (2, None), (3, [])], "i int, f array<array<double>>")
    out = {r.i: r.b for r in df.select("i", beam.beam_search("f", 9, 0, 2).alias("b")).collect()}
    assert [x.ids for x in out[1]] == [[1], [2]] and out[2] is None and [(x.ids, x.score) for x in out[3]] == [([], 0.0)]


def test_cross_attention_is_dealt_to_all_cores(spark):
    frames = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(2000)], "i int, v array<double>").coalesce(1)
    out = attention.cross_attention(frames, ["i"], "v", frames, "v").select("i", F.spark_partition_id().alias("task"))
    tasks = out.groupBy("task").count().collect()
    assert sum(r["count"] for r in tasks) == 2000 and len(tasks) >= spark.sparkContext.defaultParallelism
    assert max(r["count"] for r in tasks) <= 1000
