"""Readers, text functions, edge cases of operators, streams and plug-ins on small inputs."""

import dataclasses
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import align, batching, metrics, posterior, scoring, sequence
from quern.plans import registry
from quern.sources import manifest as M
from quern.streaming import manifest_stream


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_manifest(spark, tmp_path):
    put(tmp_path / "multitask.jsonl", '{"key":"a","task":"ASR","target":"x y","path":"/a.wav"}\n\n{"key":"b","task":"hotword","target":"z","path":"/b.ark:5","GT":"zz","hotword":"Ann"}\n')
    rows = M.manifest(spark, str(tmp_path), ("hotword",)).where("key is not null")
    assert sorted((r.key, r.GT, r.hotword) for r in rows.collect()) == [("a", None, None), ("b", "zz", "Ann")]
    assert M.row_count(spark, str(tmp_path)) == 3
    put(tmp_path / "p.jsonl", '{"task":"ASR","prompt":"Write it."}\n{"task":"hotword","prompt":"Mind {}."}\n')
    got = M.with_prompt(rows, M.prompts(spark, str(tmp_path / "p.jsonl")), "<speech>{}!")
    assert sorted((r.key, r.prompt) for r in got.collect()) == [("a", "<speech>Write it.!"), ("b", "<speech>Mind Ann.!")]
    with pytest.raises(Exception, match="no prompt for task"):
        M.with_prompt(rows.withColumn("task", F.lit("new")), M.prompts(spark, str(tmp_path / "p.jsonl")), "{}").collect()
    put(tmp_path / "bad" / "multitask.jsonl", "{broken")
    with pytest.raises(Exception):
        M.manifest(spark, str(tmp_path / "bad")).collect()
    assert M.split_folder({"train": "t"}, "train") == "t"
    with pytest.raises(ValueError):
        M.split_folder({}, "dev")


def test_word_files(spark, tmp_path):
    assert sorted(r.word for r in M.ignored_words(spark, put(tmp_path / "i", " uh \n\nEr\nuh\n")).collect()) == ["ER", "UH"]
    assert {r.word: r.parts for r in M.split_words(spark, put(tmp_path / "s", "don't do n't\nalone\n")).collect()} == {"DON'T": ["DO", "N'T"]}
    got = M.clusters(spark, put(tmp_path / "c", "<Name> Ann Bob\nCy </Name>\n<Place>Rome</Place> rest")).collect()
    assert sorted(map(tuple, got)) == [("Name", "Ann"), ("Name", "Bob"), ("Name", "Cy"), ("Place", "Rome")]


def test_transcripts(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x\ny"), ("b", "")], "id string, text string")
    M.write_transcript(rows, str(tmp_path / "out"))
    assert sorted(map(tuple, M.transcript(spark, str(tmp_path / "out")).collect())) == [("a", "x y"), ("b", "")]
    lines = spark.createDataFrame([("k\ta—b, c\td",), ("no, tab",)], "line string")
    assert [r.line for r in M.clean_transcript(lines).collect()] == ["k\ta—b cd", "no, tab"]


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize("text,want", [("hello,world", ["hello,world"]), ("café", ["caf", "é"]), ("<unk><noise>", ["<unk>", "<noise>"]), ("你好 ok!", ["你", "好", "ok!"]), ("!a", ["a"]), ("a<b", ["a<b"]), ("", []), ("<a\u00e9>", ["<a", "é>"]), ("x>y z", ["x>y", "z"]), ("\u3000a\u0378b", ["a", "b"])])
def test_characterize(spark, text, want):
    assert one(spark, X.characterize(F.lit(text))) == want


def test_normalize(spark):
    tokens = F.array(*map(F.lit, ["the", "<b>", "a<b", "it", "don't", "the"]))
    split = F.create_map(F.lit("DON'T"), F.array(F.lit("DO"), F.lit("N'T")))
    assert one(spark, X.normalize(tokens, F.array(F.lit("THE")), False, split)) == ["A", "IT", "DO", "N'T"]
    assert one(spark, X.normalize(tokens, case_sensitive=True)) == ["the", "a", "it", "don't", "the"]
    assert one(spark, X.words(F.lit(None).cast("string"))) == []
    for text, marks in (("a—b, c&d'e-f", "a—b cdef"), ("tab\there\u3000, 。x", "tabhere x"), ("“q”…\u200b", "q")):
        assert one(spark, X.clean_marks(F.lit(text))) == marks
    assert one(spark, X.train_target(F.lit("\u00a0It's 5!\u3000"))) == "it's\u00a0!" or one(spark, X.train_target(F.lit("It's 5!"))) == "it's !"
    assert one(spark, X.decode_target(F.lit("It's 5!"))) == "its !"


def test_names_of_tokens(spark):
    rows = spark.createDataFrame([("12",), ("Ab",), ("é",), ("明",), ("はこ",), ("カ",), ("a1",), ("it's",), ("-",), ("",), (None,)], "t string")
    got = [r.c for r in rows.select(X.cluster_of("t").alias("c")).collect()]
    assert got == ["Number", "English", "English", "Mandarin", "Japanese", "Other", "Other", "English", "Other", "Other", "Other"]
    assert [r.w for r in rows.select(X.width("t").alias("w")).collect()] == [2, 2, 2, 2, 4, 2, 2, 4, 1, 0, 0]


def test_null_pairs(spark):
    rows = spark.createDataFrame([("1", ["a"], None), ("2", None, ["b"]), ("3", ["a", "b"], ["b", "a"])], "id string, ref array<string>, hyp array<string>")
    assert {r.id: (r.n, r.c, r.s, r.d, r.i) for r in scoring.per_pair(rows).collect()} == {"1": (1, 0, 0, 1, 0), "2": (0, 0, 0, 0, 1), "3": (2, 1, 0, 1, 1)}
    assert [r.e for r in rows.select(align.edit_distance("ref", "hyp").alias("e")).collect()] == [1, 1, 2]
    lines = [r.line for r in scoring.report(rows).collect()]
    assert lines[2] == "WER: 100.00 % N=2 C=1 S=0 D=1 I=1" and lines[3].startswith("Overall -> 133.33 % N=3 C=1 S=0 D=2 I=2")
    kinds = spark.createDataFrame([("k", "a")], "cluster string, word string")
    assert [tuple(r) for r in scoring.by_clusters(rows, kinds).collect()] == [("k", 2, 0, 0, 2, 1)] or scoring.by_clusters(rows, kinds).count() == 1
    clash = spark.createDataFrame([(1, 1, 7), (1, 2, 8)], "id int, o int, _n int")
    assert [tuple(r) for r in scoring.last_wins(clash, "id", "o").collect()] == [(1, 2, 8)]


def test_long_pair():
    a = [str(i % 50) for i in range(3000)]
    b = a[:1000] + a[1100:]
    assert align.counts(a, b) == (3000, 2900, 0, 100, 0) and align.distance(a, b) == 100


def test_masked_accuracy(spark):
    rows = spark.createDataFrame([(1, -100), (2, -100)], "p int, y int")
    assert math.isnan(metrics.masked_accuracy(rows, "p", "y").first().accuracy)
    assert math.isnan(metrics.masked_accuracy(rows.where("false"), "p", "y").first().accuracy)
    rows = spark.createDataFrame([([5, 6, 7], [-100, 5, 9]), ([1], [1]), ([], [])], "p array<int>, y array<int>")
    assert metrics.next_token_accuracy(rows, "p", "y").first().accuracy == 0.5
    assert metrics.run_averages(rows.where("false").select(F.size("p").alias("v")), ["v"]).first().v == 0


def test_posteriors(spark):
    rows = spark.createDataFrame([("k", 0, [0.7, 0.3]), ("k", 1, [0.2, 0.8])], "k string, t int, p array<double>")
    got = posterior.resample(rows, "k", "t", "p", spark.createDataFrame([("k", 3)], "k string, length int")).orderBy("t").collect()
    logs = np.log([[0.7, 0.3], [0.2, 0.8]])
    for r, w in zip(got, (0, 0.5, 1), strict=True):
        v = np.exp(logs[0] * (1 - w) + logs[1] * w)
        assert r.p == pytest.approx((v / v.sum()).tolist())
    same = posterior.compare(rows, rows, "k", "t", "p").first()
    assert same.js == pytest.approx(0, abs=1e-6) and (same.top1_acc, same.edit_dist, same.len_a, same.blank_frac_a) == (1, 0, 1, 0.5)
    assert len(posterior.comparison({"ctc": rows, "clean": rows, "noise": rows}, "k", "t", "p").columns) == 35
    assert one(spark, posterior.ban(F.array(F.lit(3.0), F.lit(1.0)), 0)) == [float("-inf"), 1.0]
    assert [x.p for x in posterior.probabilities(rows, "p").collect()] == [[0.7, 0.3], [0.2, 0.8]]


def test_padding_and_masks(spark):
    a = F.array(*map(F.lit, [1, 2, 3]))
    assert one(spark, batching.pad(a, F.lit(5), 0)) == [1, 2, 3, 0, 0] and one(spark, batching.pad(a, F.lit(5), 0, True)) == [0, 0, 1, 2, 3] and one(spark, batching.pad(a, F.lit(2), 0)) == [1, 2]
    mask = F.array(*map(F.lit, [False, True, True]))
    assert one(spark, sequence.position_ids(mask)) == [1, 0, 1] and one(spark, batching.length_mask(F.lit(1), F.lit(3))) == [True, False, False]
    assert one(spark, M.labels(F.array(F.lit(7), F.lit(8)), F.array(F.lit(1)))) == [-100, -100, 1]
    words = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "word string")
    v = M.vocabulary(words)
    rows = spark.createDataFrame([(1, ["b", "x", "a"]), (2, []), (3, None)], "k int, w array<string>")
    ids = M.encode(rows, "k", "w", v, 9)
    assert {r.k: r.ids for r in ids.collect()} == {1: [2, 0, 1, 9], 2: [9], 3: [9]}
    assert {r.k: r.text for r in M.decode(ids, "k", "ids", v).collect()} == {1: "b a", 2: "", 3: ""}


def test_aligned_frames(spark):
    rows = spark.createDataFrame([(1, [[0.0, -5.0], [-5.0, 0.0]], [1]), (2, None, [1]), (3, [], [])], "k int, s array<array<double>>, y array<int>")
    assert {r.k: r.x for r in rows.select("k", align.align_frames("s", "y").alias("x")).collect()} == {1: [0, 1], 2: [], 3: []}


def test_batch_stream(spark, tmp_path):
    sizes = [3, 4, 9, 2, 2, 7]
    for part, rows in enumerate((sizes[:4], sizes[4:])):
        put(tmp_path / "in" / f"{part}.json", "\n".join(f'{{"shard":1,"n":{part * 4 + k},"size":{s}}}' for k, s in enumerate(rows)))
        os.utime(tmp_path / "in" / f"{part}.json", (1000 + part, 1000 + part))
    stream = spark.readStream.schema("shard int, n int, size int").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = manifest_stream.dynamic_batch_stream(stream, "shard", "n", "size", 12).writeStream.format("memory").queryName("batched").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [r.batch for r in spark.table("batched").orderBy("n").collect()]
    assert got == batching.fold(sizes, 12) == [0, 0, 1, 2, 2, 3]
    put(tmp_path / "m" / "a.json", '{"key":"a","task":"ASR","target":"x","path":"p"}')
    assert manifest_stream.manifest_stream(spark, str(tmp_path / "m")).isStreaming


@dataclasses.dataclass
class Inner:
    rate: float = 0.1
    tasks: tuple = ("a",)


@dataclasses.dataclass
class Outer:
    name: str = "x"
    on: bool = False
    inner: Inner = dataclasses.field(default_factory=Inner)


def test_registry(tmp_path):
    registry.register("dataset", "tiny")(len)
    assert registry.find("dataset", "tiny") is len
    with pytest.raises(ValueError):
        registry.register("dataset", "tiny")(len)
    with pytest.raises(KeyError, match="tiny"):
        registry.find("dataset", "other")
    path = put(tmp_path / "f.py", "def make(x):\n    return x + 1\n")
    assert registry.factory(f"{path}:make")(1) == 2
    for bad, kind in ((f"{path}:none", AttributeError), ("x.txt:f", ValueError), ("missing.py:f", FileNotFoundError)):
        with pytest.raises(kind):
            registry.factory(bad)
    got = registry.override(Outer(), ["++inner.rate=0.5", "on=true", "inner.tasks=[b, c]"])
    assert (got.inner.rate, got.on, got.inner.tasks, got.name) == (0.5, True, ("b", "c"), "x")
    with pytest.raises(KeyError):
        registry.override(Outer(), ["inner.none=1"])
