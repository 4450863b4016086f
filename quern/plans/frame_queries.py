"""Queries of the operators on frames: attention, convolutions, filter banks and beam search, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import filterbank
from ..operators import attention, beam, convolution, posterior
from .catalogue import frames, t

#: How chunks are cut: frames of a chunk, frames behind it that it sees, chunks before it that it sees.
STRIDE, RIGHT, LOOK_BACK = 8, 3, 2
FORM = filterbank.Form(rate=1000, bins=6, length=25, shift=10, low=20)
KERNEL = 5
_BY_USER = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"


def event_vectors(s, d):
    """The users' events as frames of four numbers."""
    e = t(s, d, "events")
    return e.select("user_id", "ts", "event_id", F.array(F.col("value") / 100, *[F.pmod("event_id", F.lit(n)) / F.lit(float(n)) for n in (7, 11, 13)]).alias("v"))


_VECTORS = f"SELECT user_id, row_number() {_BY_USER} - 1 AS t, count(*) OVER (PARTITION BY user_id) AS n, [value / 100, event_id % 7 / 7.0::DOUBLE, event_id % 11 / 11.0::DOUBLE, event_id % 13 / 13.0::DOUBLE] AS v FROM events"
_MICRO = "round({} * 1000000)::BIGINT"


def micro(c):
    return F.round(c * 1_000_000).cast("long")


def spread(df, keys, vector):
    """A row for each entry of a vector: keys, h (from 0) and x in millionths."""
    return df.select(*keys, F.posexplode(vector).alias("h", "x")).withColumn("x", micro(F.col("x")))


def memory_weights():
    return [[(j + 1) * (c + 1) / 50 for c in range(4)] for j in range(KERNEL)]


def mixing_weights():
    return [[[((j * 64 + e) * (o + 1) % 7 - 3) / 10 for o in range(2)] for e in range(64)] for j in range(3)]


def waveforms(s, d):
    """Each user's values, in order, as a waveform."""
    e = t(s, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("e"))
    return e.select("user_id", F.transform("e", lambda x: x.value).alias("samples"))


def _bank() -> str:
    """Fourier sums as they are defined, term by term, and the triangles in mel, in SQL."""
    n, step, size = FORM.samples
    mel = lambda f: f"1127 * ln(1 + ({f}) / 700.0::DOUBLE)"
    low, high = mel(FORM.low), mel(FORM.rate / 2)
    gap = f"(({high} - {low}) / {FORM.bins + 1})"
    wave = lambda f: f"list_sum(list_transform(range(0, {n}), lambda i: x[i + 1] * {f}(2 * pi() * i * k / {size})))"
    left = f"({low} + b * {gap})"
    weight = f"greatest(0, least(({mel(f'k * {FORM.rate}.0 / {size}')} - {left}) / {gap}, ({left} + 2 * {gap} - {mel(f'k * {FORM.rate}.0 / {size}')}) / {gap}))"
    return f"""WITH w AS (SELECT user_id, list(value::DOUBLE ORDER BY ts, event_id) AS s FROM events GROUP BY user_id),
    f AS (SELECT user_id, t, list_transform(range(0, {n}), lambda i: s[t * {step} + i + 1]) AS x FROM (SELECT user_id, s, unnest(range(0, greatest(0, (len(s) - {n}) // {step} + 1))) AS t FROM w WHERE len(s) >= {n})),
    c AS (SELECT user_id, t, list_transform(x, lambda y: y - list_avg(x)) AS x FROM f),
    p AS (SELECT user_id, t, list_transform(range(0, {n}), lambda i: (x[i + 1] - {FORM.emphasis} * x[greatest(i, 1)]) * (0.54 - 0.46 * cos(2 * pi() * i / {n - 1}))) AS x FROM c),
    k AS (SELECT user_id, t, k, pow({wave('cos')}, 2) + pow({wave('sin')}, 2) AS power FROM p, range(0, {size // 2}) r(k)),
    m AS (SELECT user_id, t, b, ln(greatest(sum(power * {weight}), {filterbank.LEAST!r}::DOUBLE)) AS x FROM k, range(0, {FORM.bins}) q(b) GROUP BY ALL)
    SELECT user_id, t::INTEGER AS t, b::INTEGER AS h, {_MICRO.format('x')} AS x FROM m"""


def _conv() -> str:
    dots = "list_sum(list_transform(range(0, 64), lambda e: v{j}[e + 1] * ((({j} * 64 + e) * (h + 1)) % 7 - 3) / 10.0::DOUBLE))"
    picks = ", ".join(f"max(CASE WHEN t % 3 = {j} THEN embedding END)::DOUBLE[] AS v{j}" for j in range(3))
    return f"""WITH f AS (SELECT vec_id % 20 AS u, embedding::DOUBLE[] AS embedding, row_number() OVER (PARTITION BY vec_id % 20 ORDER BY vec_id) - 1 AS t FROM embeddings),
    g AS (SELECT u, t // 3 AS t, {picks} FROM f GROUP BY u, t // 3 HAVING count(*) = 3)
    SELECT u, t, h::INTEGER AS h, {_MICRO.format('(' + ' + '.join(dots.format(j=j) for j in range(3)) + ' + CASE h WHEN 0 THEN 0.1 ELSE -0.2 END)')} AS x FROM g, range(0, 2) r(h)"""


def _memory() -> str:
    terms = " + ".join(f"{j + 1} * (h + 1) / 50.0::DOUBLE * coalesce({'lag' if j < 3 else 'lead'}(v[h + 1], {abs(3 - j)}) OVER w, 0)" if j != 3 else "4 * (h + 1) / 50.0::DOUBLE * v[h + 1]" for j in range(KERNEL))
    return f"SELECT user_id, t, h::INTEGER AS h, {_MICRO.format(f'({terms} + v[h + 1])')} AS x FROM ({_VECTORS}), range(0, 4) r(h) WINDOW w AS (PARTITION BY user_id, h ORDER BY t)"


_CHUNKS = f"""WITH f AS ({_VECTORS}),
p AS (SELECT a.user_id, a.t, h, exp((a.v[2 * h + 1] * b.v[2 * h + 1] + a.v[2 * h + 2] * b.v[2 * h + 2]) / sqrt(2)) AS w, b.v AS v FROM f a JOIN f b ON a.user_id = b.user_id
  AND b.t >= (a.t // {STRIDE} - {LOOK_BACK}) * {STRIDE} AND b.t < (a.t // {STRIDE} + 1) * {STRIDE} + {RIGHT}, range(0, 2) r(h) WHERE (a.t // {STRIDE} + 1) * {STRIDE} + {RIGHT} <= a.n),
s AS (SELECT user_id, t, h, sum(w * v[2 * h + 1]) / sum(w) AS x, sum(w * v[2 * h + 2]) / sum(w) AS y FROM p GROUP BY ALL)
SELECT user_id, t, (2 * h)::INTEGER AS h, {_MICRO.format('x')} AS x FROM s UNION ALL SELECT user_id, t, (2 * h + 1)::INTEGER, {_MICRO.format('y')} FROM s"""

_CROSS = f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 5) AS v FROM embeddings),
p AS (SELECT a.vec_id, h, exp(list_dot_product(a.v[8 * h + 1:8 * h + 8], b.v[8 * h + 1:8 * h + 8]) / sqrt(8)) AS w, b.v[8 * h + 1:8 * h + 8] AS v FROM e a, e b, range(0, 8) r(h)),
s AS (SELECT vec_id, h, sum(w) AS w, [{', '.join(f'sum(w * v[{k}])' for k in range(1, 9))}] AS v FROM p GROUP BY ALL)
SELECT vec_id, (8 * h + k)::INTEGER AS h, {_MICRO.format('v[k + 1] / w')} AS x FROM s, range(0, 8) q(k)"""

#: name: (query, SQL or None)
CATALOGUE = {
    "chunk_attention": (lambda s, d: spread(attention.chunk_attention(event_vectors(s, d), "user_id", ["ts", "event_id"], "v", STRIDE, RIGHT, LOOK_BACK, heads=2), ["user_id", "t"], "out"), _CHUNKS),
    "cross_attention": (
        lambda s, d: spread(attention.cross_attention((e := t(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 5).alias("v"))), ["vec_id"], "v", e, "v", heads=8), ["vec_id"], "out"),
        _CROSS,
    ),
    "fsmn_memory": (lambda s, d: spread(convolution.memory(event_vectors(s, d), "user_id", ["ts", "event_id"], "v", memory_weights(), shift=1, stretch=16), ["user_id", "t"], "out"), _memory()),
    "strided_conv": (
        lambda s, d: spread(convolution.strided(t(s, d, "embeddings").withColumn("u", F.col("vec_id") % 20), "u", ["vec_id"], "embedding", mixing_weights(), bias=[0.1, -0.2], stretch=4), ["u", "t"], "out"),
        _conv(),
    ),
    "filter_bank": (
        lambda s, d: spread(waveforms(s, d).select("user_id", F.posexplode(filterbank.features("samples", FORM)).alias("t", "bank")), ["user_id", "t"], "bank"),
        _bank(),
    ),
    "beam_search": (
        lambda s, d: frames(s, d).withColumn("logs", F.transform(posterior.softmax(F.transform("scores", lambda y: y * 4)), lambda y: F.log(y)))
        .groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "logs"))).alias("e"))
        .withColumn("found", beam.beam_search(F.col("e.logs"), 4, 3, 2))
        .select("user_id", *[x for k in range(2) for x in (F.array_join(F.transform(F.col("found")[k]["ids"], lambda x: x.cast("string")), " ").alias(f"ids_{k}"), F.round(F.col("found")[k]["score"], 6).alias(f"score_{k}"))]),
        None,
    ),
}


def queries() -> dict:
    return {k: q for k, (q, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in CATALOGUE.items() if sql}
