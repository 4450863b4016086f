"""Reports line by line, runs merged over ranges, interleaving with its errors, insertions, policies in tables and streams."""

import itertools
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import batching, posterior, scoring, sequence
from quern.plans import frame_queries
from quern.sources import manifest
from quern.streaming import manifest_stream


def test_aligned_report(spark):
    rows = [("a", ["DAS", "明", "IST"], ["DAS", "IST", "É"]), ("b", ["X"] * 8, ["X"] * 7 + ["Y"]), ("c", [], [])]
    both = spark.createDataFrame(rows, "id string, ref array<string>, hyp array<string>")
    kinds = spark.createDataFrame([("Words", "IST"), ("Words", "DAS"), ("None", "Q")], "cluster string, word string")
    lines = [r.line for r in scoring.report(both, aligned=True, words=2, padding="_", clusters=kinds).collect()]
    assert lines == [
        "", "utt: a", "WER: 66.67 % N=3 C=2 S=0 D=1 I=1",
        "lab: DAS 明 ", "rec: DAS __ ", "", "lab: IST _ ", "rec: IST É ", "",
        "", "utt: b", "WER: 12.50 % N=8 C=7 S=1 D=0 I=0",
        *["lab: X X ", "rec: X X ", ""] * 3, "lab: X X ", "rec: X Y ", "",
        "", "utt: c", "WER: 0.00 % N=0 C=0 S=0 D=0 I=0",
        "=" * 75, "", "Overall -> 27.27 % N=11 C=9 S=1 D=1 I=1",
        "English -> 20.00 % N=10 C=9 S=1 D=0 I=1", "Mandarin -> 100.00 % N=1 C=0 S=0 D=1 I=0",
        "Words -> 0.00 % N=2 C=2 S=0 D=0 I=0", "", "=" * 75,
    ]
    assert [r.line for r in scoring.report(both).collect()][0] == "WER: 66.67 % N=3 C=2 S=0 D=1 I=1"


def test_rates_are_rounded_by_their_value(spark):
    rates = spark.createDataFrame([(3.125,), (2.675,), (0.005,), (100.0,)], "w double")
    assert [r.x for r in rates.select(scoring.shown("w").alias("x")).collect()] == ["%4.2f" % x for x in (3.125, 2.675, 0.005, 100.0)]


def test_spoken_text(spark):
    rows = [r"café \n", "plain", "é", r"bad \x", None, r"\\"]
    got = [r.g for r in spark.createDataFrame([(x,) for x in rows], "t string").select(manifest.spoken("t").alias("g")).collect()]
    assert got == ["cafÃ© \n", "plain", "Ã©", r"bad \x", "", "\\"]


def test_last_parts_of_a_word_count(spark, tmp_path):
    Path(f"{tmp_path}/split").write_text("don't do n't\nalone\nit's it z\ndon't a b c\nit's it 's\n")
    assert {r.word: r.parts for r in manifest.split_words(spark, f"{tmp_path}/split").collect()} == {"DON'T": ["A", "B", "C"], "IT'S": ["IT", "'S"]}


def test_comparison_file(spark, tmp_path):
    rows = spark.createDataFrame([("k1", 0.5, 3), ("k,2", None, 4)], "key string, js double, edit_dist int")
    posterior.write_comparison(rows.coalesce(1), f"{tmp_path}/out")
    text = next(Path(f"{tmp_path}/out").glob("*.csv")).read_text()
    assert text.splitlines() == ["key,js,edit_dist", "k1,0.5,3", '"k,2",,4']
    assert sorted(map(tuple, spark.read.option("header", True).csv(f"{tmp_path}/out").collect())) == [("k,2", None, "4"), ("k1", "0.5", "3")]


def merged(ids, vectors, blank, threshold):
    out = []
    for _, part in itertools.groupby(range(len(ids)), key=lambda i: ids[i] if ids[i] != blank else (i,)):
        part = list(part)
        p, e = (np.array([v[k] for v in (vectors[i] for i in part)]).mean(0) for k in (0, 1))
        off = p[blank]
        if off < threshold:
            out.append((part[0], len(part), off, e.tolist()))
    return out


@pytest.mark.parametrize("parts", [1, 13])
def test_runs_over_ranges(spark, parts):
    """Runs that span any number of ranges are put together, and blanks between like runs keep them apart."""
    rng = np.random.default_rng(parts)
    rows, want = [], {}
    for u, n in (("a", 300), ("b", 1), ("c", 40), (None, 30)):
        ids = np.repeat(rng.integers(0, 3, n), rng.choice([1, 2, 60], n))[:n]
        p = np.stack([np.where(np.arange(3) == i, rng.uniform(0.5, 0.99), 0.01) for i in ids])
        p /= p.sum(1, keepdims=True)
        e = rng.normal(size=(n, 5))
        rows += [(u, i, p[i].tolist(), e[i].tolist()) for i in range(n)]
        want[u] = merged(p.argmax(1).tolist(), list(zip(p, e, strict=True)), 0, 0.9)
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "u string, t int, p array<double>, e array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sequence.merge_encoded(df, "u", "t", "p", "e").collect()
        short = sequence.merge_encoded(df.withColumn("n", F.lit(7)), "u", "t", "p", "e", length="n").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for u, w in want.items():
        own = sorted((r.first, r.frames, r.blank, r.vector) for r in got if r.u == u)
        assert [x[:2] for x in own] == [x[:2] for x in w] and np.allclose([x[2] for x in own], [x[2] for x in w])
        assert all(np.allclose(x[3], y[3]) for x, y in zip(own, w, strict=True))
        assert max((r.first for r in short if r.u == u), default=0) < 7
    assert sequence.merge_encoded(df.where("false"), "u", "t", "p", "e").collect() == []


def test_utterances_without_frames(spark):
    keys = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "u string, g int")
    frames = spark.createDataFrame([("a", 5, [1.0, 2.0]), ("a", 2, [3.0, 4.0])], "u string, first int, vector array<double>")
    got = {r.u: (r.length, r.vectors) for r in sequence.utterances(frames, keys, "u", 2, "g").collect()}
    assert got == {"a": (2, [[3.0, 4.0], [1.0, 2.0]]), "b": (0, [[0.0, 0.0], [0.0, 0.0]]), "c": (0, [])}


def interleave(spark, rows, **names):
    df = spark.createDataFrame(rows, "b int, k int, ids array<int>, mask array<int>, labels array<int>, slots array<int>")
    out = sequence.interleave(df, ["b"], "ids", "mask", "labels", "slots", 9, 0, **names)
    return {(r.b, r.k): (r.ids, r.mask, r.labels, r.position_ids, [int(x) for x in r.audio], r.left) for r in out.collect()}


def test_interleave(spark):
    right = [(1, 1, [1, 2, 9, 3], [1, 1, 1, 1], [-100, 2, -100, 3], [3]), (1, 2, [4, 9, 9, 0], [1, 1, 1, 0], [4, -100, -100, -100], [1, 2])]
    left = [(2, 1, [1, 2, 9, 3], [1, 1, 1, 1], [-100, 2, -100, 3], [3]), (2, 2, [0, 4, 9, 9], [0, 1, 1, 1], [-100, 4, -100, -100], [1, 2])]
    alone = [(3, 1, [5, 9, 0, 0], [1, 1, 0, 0], [5, -100, -100, -100], [0])]
    even = [(4, 1, [9, 7], [1, 1], [-100, 7], [2]), (4, 2, [8, 7], [1, 1], [8, 7], [])]
    got = interleave(spark, right + left + alone + even)
    assert got[1, 1] == ([1, 2, 0, 0, 0, 3], [1] * 6, [-100, 2, -100, -100, -100, 3], [0, 1, 2, 3, 4, 5], [0, 0, 1, 1, 1, 0], False)
    assert got[1, 2] == ([4, 0, 0, 0, 0, 0], [1, 1, 1, 1, 0, 0], [4] + [-100] * 5, [0, 1, 2, 3, 1, 1], [0, 1, 1, 1, 0, 0], False)
    assert got[2, 2] == ([0, 0, 4, 0, 0, 0], [0, 0, 1, 1, 1, 1], [-100, -100, 4, -100, -100, -100], [1, 1, 0, 1, 2, 3], [0, 0, 0, 1, 1, 1], True)
    assert got[3, 1] == ([0, 0, 5], [0, 0, 1], [-100, -100, 5], [1, 1, 0], [0, 0, 0], True)
    assert got[4, 2] == ([0, 8, 7], [0, 1, 1], [-100, 8, 7], [1, 0, 1], [0, 0, 0], True)


@pytest.mark.parametrize(
    ("rows", "message"),
    [
        ([(1, 1, [1, 2], [0, 1], [1, 2], []), (1, 2, [1, 2], [1, 0], [1, 2], [])], "both sides"),
        ([(1, 1, [1, 9], [1, 1], [1, 2], []), (1, 2, [1, 2], [1, 1], [1, 2], [])], "slots than placeholders"),
        ([(1, 1, [1, 2], [1, 1], [1, 2], [4]), (1, 2, [1, 2], [1, 1], [1, 2], [])], "slots than placeholders"),
        ([(1, 1, [1, 2, 3], [1, 0, 1], [1, 2, 3], []), (1, 2, [1, 2, 3], [1, 1, 1], [1, 2, 3], [])], "zeros amid ones"),
    ],
)
def test_interleave_errors(spark, rows, message):
    with pytest.raises(Exception, match=message):
        interleave(spark, rows)


def test_insertions(spark):
    rows = [("a", t, 10 + t, 0.9, 0.1) for t in range(7)] + [("b", 0, 5, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, t int, id int, p double, rest double")
    place, copied = (lambda j, n: (j * 5) % (n + 1)), (lambda j, n: j % 2 == 0)
    got = sorted(map(tuple, posterior.with_insertions(df, "k", 0.5, place, copied, blank=99).collect()))
    own = [(10 + t, 0.9, 0.1) for t in range(7)]
    put = [(own[0],), (), (own[1],), (), (), ((99, 1.0, 0.0),)]  # before rows 0 (j 0), 2 (j 2) and 5 (j 1)
    want = [x for i, r in enumerate(own) for x in (*(put[i] if i < len(put) else ()), r)]
    assert [r[2:] for r in got if r[0] == "a"] == want and [r[1] for r in got if r[0] == "a"] == list(range(10))
    assert [r for r in got if r[0] == "b"] == [("b", 0, 5, 1.0, 0.0)]
    ends = posterior.with_insertions(df, "k", 1.0, lambda j, n: n + 5, lambda j, n: F.lit(True), blank=99).collect()
    assert [r.id for r in sorted(ends, key=lambda r: (r.k, r.t))] == [10, 11, 12, 13, 14, 15, 16, *[16] * 7, 5, 5]


def test_blocks_of_a_table(spark):
    rng = np.random.default_rng(2)
    p, e = rng.uniform(size=(9, 13)), rng.normal(size=(13, 4))
    frames = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(p)], "i int, p array<double>").repartition(2)
    table = spark.createDataFrame([(v, h, float(e[v, h])) for v in range(13) for h in range(4)], "v int, h int, e double")
    for block in (5, None):
        got = {(r.i, r.h): r.x for r in posterior.soft_embedding(frames, ["i"], "p", table, block=block).collect()}
        assert np.allclose([[got[i, h] for h in range(4)] for i in range(9)], p @ e)


@pytest.mark.parametrize("policy", [batching.padded("size", 40), batching.total("size", 25), batching.frames_and_tokens("size", "frames", 60, 3)])
def test_policies_in_table_and_stream(spark, tmp_path, policy):
    """One policy gives the same batches in a table and in a stream, however the rows fall into triggers, and none breaks its rule."""
    rng = np.random.default_rng(3)
    rows = [(f"s{i % 3}", i, int(rng.integers(1, 30)), int(rng.integers(0, 50))) for i in range(90)]
    form = "shard string, n int, size int, frames int"
    table = {(r.shard, r.n): r.batch for r in batching.dynamic_batches(spark.createDataFrame(rows, form).repartition(4), "shard", ["n"], policy).collect()}
    for a, b in itertools.pairwise([0, 40, 90]):
        spark.createDataFrame(rows[a:b], form).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = manifest_stream.dynamic_batch_stream(spark.readStream.schema(form).parquet(f"{tmp_path}/in"), "shard", "n", policy)
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
    assert {(r.shard, r.n): r.batch for r in spark.read.parquet(f"{tmp_path}/out").collect()} == table
    for s in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == s]
        want, batch, held = [], 0, []
        for r in own:  # by the rule itself, over the whole batch each time
            new = [*held, r]
            longest = max(x[2] + (x[3] // 3 - 1 if len(policy.columns) == 2 else 0) for x in new)
            fits = sum(x[2] for x in new) <= 25 if policy.form.startswith("held") else len(new) * longest <= (60 if len(policy.columns) == 2 else 40)
            if held and not fits:
                batch, new = batch + 1, [r]
            held = new
            want.append(batch)
        assert [table[s, r[1]] for r in own] == want


def test_frame_queries_without_sql(spark):
    for name in sorted(set(frame_queries.queries()) - set(frame_queries.oracle_sql())):
        assert frame_queries.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_posterior_cache(spark, tmp_path):
    rows = lambda keys: spark.createDataFrame([(k, 0, [0.5, 0.5]) for k in keys], "key string, frame int, p array<double>")
    posterior.write_groups({"ctc": rows("ba"), "clean": rows("abc"), "noise": rows("abc")}, f"{tmp_path}/cache")
    groups = posterior.cached_groups(spark, f"{tmp_path}/cache")
    assert [r.key for r in posterior.listed_keys(groups, "key").collect()] == ["a", "b"] and groups["clean"].columns == ["key", "frame", "p"]
    with pytest.raises(Exception, match="ctc has no c"):
        posterior.listed_keys(groups, "key", "clean").collect()


def test_queries_in_front(spark):
    df = spark.createDataFrame([(1, [[1.0]], 1), (2, None, None)], "k int, f array<array<double>>, n int")
    frames, length = batching.with_queries(F.col("f"), F.col("n"), [F.array(F.lit(9.0)), F.lit(None).cast("array<double>"), F.array(F.lit(8.0))])
    got = {r.k: (r.f, r.n) for r in df.select("k", frames.alias("f"), length.alias("n")).collect()}
    assert got == {1: ([[9.0], [8.0], [1.0]], 3), 2: ([[9.0], [8.0]], 2)}
    back = batching.drop_prefix(frames, length, 2)
    assert {r.k: (r.f, r.n) for r in df.select("k", back[0].alias("f"), back[1].alias("n")).collect()} == {1: ([[1.0]], 1), 2: ([], 0)}


def test_insertions_within_rows(spark):
    rows = [("a", list(range(10, 31))), ("b", [5]), ("c", []), ("d", None), ("e", [7, 8, 9, 7])]
    df = spark.createDataFrame(rows, "k string, ids array<int>")
    place, copied, alpha = (lambda j, n: (j * j * 5) % (n + 3) - 1), (lambda j, n: j % 2 == 0), F.length("k") / 20
    got = posterior.inserted(df, "k", "ids", 8, 0.5, place, copied, alpha, blank=99)
    want = posterior.with_insertions(posterior.pseudo_posterior(df, "k", "ids", 8, alpha), "k", 0.5, place, copied, blank=99)
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.where("id = 99").count() == 6 and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_labels_of_many_slots_are_collected_by_token(spark):
    df = spark.createDataFrame([(1, 0, 3, "R", 4, 5), (1, 3, 1, "A", 6, 7), (1, 4, 2, "R", 8, 9), (2, 0, 1, "A", 1, 2)], "k int, start long, length long, f string, x int, y int")
    out = sequence.expanded_labels(df, "k", "x", "y", F.col("f") == "R", 0)
    assert sorted(map(tuple, out.collect())) == [(1, [0, 0, 0, 6, 0, 0], [-100, -100, -100, 7, -100, -100]), (2, [1], [2])]
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
