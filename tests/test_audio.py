"""Archives: what is written is read, in ranges, by header alone, and damaged files fail."""

import struct
import wave
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.sources import audio


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    audio.register(spark)
    at = tmp_path_factory.mktemp("audio")
    rng = np.random.default_rng(0)
    for name, rate, channels, n in (("one", 8000, 1, 400), ("two", 16000, 2, 300), ("none", 8000, 1, 0)):
        with wave.open(f"{at}/{name}.wav", "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(2)
            w.setframerate(rate)
            w.writeframes(rng.integers(-30000, 30000, n * channels).astype("<i2").tobytes())
    return at


def pcm(path, channels):
    with wave.open(str(path)) as w:
        return np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32).reshape(-1, channels).mean(1) / 32768


def test_wave_files(spark, folder):
    got = {Path(r.path).stem: r for r in spark.read.format("ark").load(str(folder)).collect()}
    assert got.keys() == {"one", "two", "none"} and got["one"].rate == 8000 and got["none"].samples == []
    for name, channels in (("one", 1), ("two", 2)):
        assert np.allclose(got[name].samples, pcm(folder / f"{name}.wav", channels), atol=1e-7) and got[name].key is None
    heads = spark.read.format("ark").schema("path string, rate int").load(str(folder))
    assert sorted(r.rate for r in heads.collect()) == [8000, 8000, 16000]


def records(spark, n=200):
    rng = np.random.default_rng(1)
    return [(f"utt{i:03d}", 16000, (rng.integers(-32768, 32767, int(rng.integers(0, 500))) / 32768).astype(np.float32).tolist()) for i in range(n)]


def test_round_trip_in_ranges(spark, folder, tmp_path):
    audio.register(spark)
    rows = records(spark)
    spark.createDataFrame(rows, "key string, rate int, samples array<float>").repartition(3).write.format("ark").mode("append").save(f"{tmp_path}/out")
    assert len(list(Path(f"{tmp_path}/out").glob("*.ark"))) == 3 and not list(Path(f"{tmp_path}/out").glob("_*"))
    whole, parts = (spark.read.format("ark").option("split", n).load(f"{tmp_path}/out") for n in (128 << 20, 5000))
    assert whole.rdd.getNumPartitions() == 3 < 20 < parts.rdd.getNumPartitions()
    for df in (whole, parts):
        assert sorted((r.key, r.rate, r.samples) for r in df.collect()) == rows
    for p in Path(f"{tmp_path}/out").glob("*.scp"):  # without an index an archive is read from its start
        p.unlink()
    assert sorted((r.key, r.rate, r.samples) for r in spark.read.format("ark").load(f"{tmp_path}/out").collect()) == rows


def test_matrices(spark, tmp_path):
    audio.register(spark)
    rows = [(f"m{i}", [[float(i + j), 0.5] for j in range(i)]) for i in range(1, 5)]
    spark.createDataFrame(rows, "key string, features array<array<float>>").coalesce(1).write.format("ark").mode("append").save(f"{tmp_path}/m")
    got = spark.read.format("ark").load(f"{tmp_path}/m").collect()
    assert sorted((r.key, r.features) for r in got) == rows and {r.samples for r in got} == {None}
    with open(f"{tmp_path}/d.ark", "wb") as f:
        f.write(b"a \0BDM " + struct.pack("<bibi", 4, 1, 4, 2) + np.array([1.5, 2.5]).tobytes() + b"b \0BFV " + struct.pack("<bi", 4, 3) + np.arange(3, dtype="<f4").tobytes())
    assert {r.key: r.features for r in spark.read.format("ark").load(f"{tmp_path}/d.ark").collect()} == {"a": [[1.5, 2.5]], "b": [[0.0, 1.0, 2.0]]}


def test_manifest_lookup(spark, folder, tmp_path):
    audio.register(spark)
    rows = records(spark, 30)
    spark.createDataFrame(rows, "key string, rate int, samples array<float>").repartition(2).write.format("ark").mode("append").save(f"{tmp_path}/out")
    places = dict(x.split() for p in Path(f"{tmp_path}/out").glob("*.scp") for x in p.read_text().splitlines())
    manifest = spark.createDataFrame([(k, p, "old") for k, p in places.items()] + [("wave", f"{folder}/one.wav", "old"), ("null", None, "old")], "key string, path string, rate string")
    got = {r.key: r for r in audio.load(manifest).collect()}
    assert got["null"].samples is None and got["wave"].rate == 8000 and {k: got[k].samples for k in places} == {k: s for k, _, s in rows}
    kept = {r.key for r in audio.load(manifest, least=0.01, most=0.02).collect()}
    assert kept == {k for k, _, s in rows if 0.01 <= len(s) / 16000 <= 0.02} | {"null"}
    assert audio.load(manifest.where("false")).collect() == []


@pytest.mark.parametrize("harm", ["cut", "magic", "key", "bits", "scp", "missing"])
def test_damaged_files_fail(spark, tmp_path, harm):
    audio.register(spark)
    body = audio.wave_bytes(np.zeros(50), 8000)
    data = {"cut": b"a " + body[:-7], "magic": b"a XX" + body, "key": b"a " + body + b"rest", "bits": b"a " + body[:34] + b"\x08\x00" + body[36:], "scp": b"a " + body, "missing": b""}[harm]
    (tmp_path / "x.ark").write_bytes(data)
    if harm == "scp":
        (tmp_path / "x.scp").write_text(f"a {tmp_path}/x.ark:3\n")
    at = f"{tmp_path}/nothing" if harm == "missing" else str(tmp_path)
    for schema in (audio.RECORDS, "key string, rate int"):
        with pytest.raises(Exception, match="x.ark|nothing|ends within"):
            spark.read.format("ark").schema(schema).load(at).collect()
    if harm == "cut":
        with pytest.raises(Exception, match="x.ark"):
            audio.load(spark.createDataFrame([(f"{tmp_path}/x.ark:2",)], "path string")).collect()


def test_features_of_audio(spark, folder):
    from quern.functions import filterbank

    audio.register(spark)
    form = filterbank.Form(8000, 8)
    got = spark.read.format("ark").load(f"{folder}/one.wav").select(F.size(filterbank.features("samples", form)).alias("n")).first().n
    assert got == 1 + (400 - 200) // 80
