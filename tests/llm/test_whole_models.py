"""The quality model against dense equations, packing against a plain best fit, search by what it verifies, and the pipeline stage by stage."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import decontaminate, hamming, packing, quality, shared, toxicity


def test_normal_equations(spark):
    """The fit's weights are those of the dense ridge problem over the learning rows, whatever their number of tasks."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    learn = ~shared.held_out(4, 2)
    described = quality.describe(docs).repartition(70).cache()
    model = quality.fit(described, labels, learn)
    rows = described.join(labels.where(learn).groupBy("doc_id").agg(F.min("quality").alias("y")), "doc_id").select("x", "y", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("check")).toPandas()
    x = np.stack(rows["x"].to_numpy())
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.where(x.std(0) > 1e-9, x.std(0), 1))
    own = ~rows["check"].to_numpy(bool)
    z, y = model.features(x[own]), rows["y"].to_numpy(float)[own]
    d = z.shape[1]
    dense = np.linalg.lstsq(np.concatenate([z, math.sqrt(quality.RIDGE * max(1.0, len(z)) / d + 1e-9) * np.eye(d)]), np.concatenate([y, np.zeros(d)]), rcond=None)[0]
    assert np.allclose(model.beta, dense, atol=1e-6)
    assert (np.diff(model.value) >= 0).all() and len(model.at) == len(model.value)
    raw = model.features(x) @ model.beta
    got = {tuple(np.round(r.x, 9)): r.score for r in described.join(quality.predict(described, model), "doc_id").select("x", "score").collect()}
    for v, r in zip(x, raw, strict=True):
        assert got[tuple(np.round(v, 9))] == pytest.approx(min(1, max(0, np.interp(r, model.at, model.value))), abs=1e-9)


def plain_best_fit(lengths, capacities, overhead):
    """Bin and offset of each piece in order of falling length, and the bins' final sizes, by looking at every bin every time."""
    used, size, out = [], [], []
    for i, n in enumerate(lengths):
        fits = [(size[b] - used[b], b) for b in range(len(used)) if size[b] - used[b] >= n]
        if fits:
            b = min(fits)[1]
        else:
            rest = lengths[i + 1 :]
            cost = lambda c, n=n, rest=rest: ((c + overhead) / (n + min(c - n, sum(x for x in rest if x <= c - n))), c)
            b = len(used)
            used.append(0)
            size.append(min((c for c in capacities if c >= n), key=cost))
        out.append((b, used[b]))
        used[b] += n
    return out, [min(c for c in capacities if c >= u) for u in used]


def packed_as_plainly(rows, capacities=packing.CAPACITIES, overhead=packing.OVERHEAD):
    for _, part in rows.groupby("shard"):
        part = part.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        where, sizes = plain_best_fit(part.n_tokens.tolist(), capacities, overhead)
        want = sorted((n, b, at, sizes[b]) for n, (b, at) in zip(part.n_tokens.tolist(), where, strict=True))
        assert sorted(zip(part.n_tokens, part.bin, part.bin_offset, part.bin_size, strict=True)) == want


@pytest.mark.parametrize(("capacities", "overhead"), [((64, 128, 256), 16), ((100,), 0), ((32, 48, 96, 200), 5)])
def test_packing_is_best_fit(spark, capacities, overhead):
    rng = np.random.default_rng(len(capacities))
    rows = [(int(i), int(n)) for i, n in enumerate(rng.lognormal(3, 1, 500))] + [(5, 40), (5, 40), (None, 77), (None, 77), (9, None), (10, 0), (11, 5000)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), capacities, overhead, 150).toPandas()
    assert out.n_tokens.sum() == sum(n or 0 for _, n in rows) and out.shard.nunique() > 2
    packed_as_plainly(out, sorted(capacities), overhead)
    bins = out.drop_duplicates(["shard", "bin"])
    assert bins.bin_size.sum() / out.n_tokens.sum() < 1.1 + 0.05 * (len(capacities) == 1)  # little is padding
    one = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), capacities[-1:], overhead, 150).toPandas().drop_duplicates(["shard", "bin"])
    assert (bins.bin_size + overhead).sum() <= 1.02 * (one.bin_size + overhead).sum()


def test_search_verifies_few_codes():
    rng = np.random.default_rng(3)
    codes = np.unique(rng.integers(0, 1 << 63, 300_000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 300_000, dtype=np.uint64))
    shard = hamming.Shard(codes)
    assert shard.m == 4 and sum(shard.widths) == 64
    for q in codes[rng.integers(0, len(codes), 10)]:
        at, d = shard.search(int(q), 11, np.ones(len(codes), np.int64))
        every = np.bitwise_count(codes ^ q).astype(np.int64)
        last = np.sort(every)[10]
        assert sorted(at.tolist()) == np.flatnonzero(every <= last).tolist() and (every[at] == d).all()
    assert shard.verified < 0.12 * 10 * len(codes)
    for n in (1, 2, 300):  # few codes, other widths
        few = hamming.Shard(codes[:n], 7)
        at, d = few.search(12345, 3, np.ones(n, np.int64))
        every = np.sort(np.bitwise_count(codes[:n] ^ np.uint64(12345)).astype(np.int64))
        assert np.sort(d)[:3].tolist() == every[:3].tolist()


WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with nulls, repeats, copies, toxic and leaked texts and columns with names that the stages use themselves."""
    rng, at = np.random.default_rng(7), tmp_path_factory.mktemp("corpus")
    text = lambda n: " ".join(rng.choice(WORDS, n))
    clean = ["\n".join(text(int(rng.integers(6, 30))) for _ in range(4)) for _ in range(60)]
    toxic = [text(30).replace("w1", "vile") + " vile wretch vilest" for _ in range(30)]
    leak = text(14)
    texts = [None, "", "\n \n", *clean, *toxic, clean[0], clean[1] + " w3", clean[2] + "\n" + clean[3], f"{text(20)} {leak.upper()} {text(9)}", text(9000)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), i % 2, "k") for i, t in enumerate(texts)] + [(4, clean[1], "en", "s", 1, 0, "k"), (None, clean[5], None, None, None, None, None), (None, None, None, None, None, None, None)]
    form = "doc_id long, text string, lang string, source string, n_chars int, h int, removed string"
    spark.createDataFrame(rows, form).repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None), (3, "w1")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    bad = [(i, 1, int(t in toxic)) for i, t in enumerate(texts) if t and i % 9]
    spark.createDataFrame([*bad, (None, 1, 1), (5, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), set(toxic)


def stage(spark, at, docs, name, k, folder):
    function = dict(corpus_pipeline.STAGES)[name]
    return shared.keep(function(spark, docs, at), f"{folder}/{k}").cache()


def counted(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


def test_pipeline(spark, corpus, tmp_path):
    at, toxic = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    # toxicity: the model's own numbers for words, added up by hand
    model = toxicity.fit(docs, spark.read.parquet(f"{at}/labels.parquet"), ~shared.held_out(3, 1))
    stay = []
    for r in docs.collect():
        own = set(shared.alnum_words(r.text))
        odds = model.bias + sum(model.word(w) for w in own) / (len(own) + toxicity.PADDING)
        if 1 / (1 + math.exp(-odds)) < 0.7:
            stay.append(r)
    one = stage(spark, at, docs, "toxicity", 1, tmp_path)
    assert one.columns == docs.columns and counted(one) == sorted(tuple(map(str, r)) for r in stay)
    assert sum(r.text in toxic for r in stay) <= 5 and len(stay) > 60
    # line dedup: a line like an earlier one goes, and a document of which nothing is left
    two = stage(spark, at, one, "line_dedup", 2, tmp_path)
    rows = {(r.doc_id, r.text): r for r in one.collect()}
    seen, gone = [], {k: set() for k in rows}
    lines = sorted(((-1 if d is None else d), i, shared_hash(t), (d, t), frozenset(shared.alnum_words(x))) for d, t in rows for i, x in enumerate((t or "").split("\n") if t else []))
    for _, i, _, key, w in lines:
        if w:
            if any(len(w & s) >= 0.8 * len(w | s) for s in seen):
                gone[key].add(i)
            seen.append(w)
    want = []
    for r in one.collect():
        out, t = gone[r.doc_id, r.text], r.text
        if out:
            t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in out)
            if not t.strip():
                continue
        want.append((r.doc_id, t))
    assert two.columns == docs.columns and counted(two.select("doc_id", "text")) == sorted((str(d), str(t)) for d, t in want) and any(gone.values())
    # near copies: one row of each class of texts linked by five-word shingles at 0.8 or more
    three = stage(spark, at, two, "ngram_jaccard_join", 3, tmp_path)
    rows = two.collect()
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in (shared.alnum_words(r.text) for r in rows)]
    cls = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                cls = [cls[j] if c == cls[i] else c for c in cls]
    kept = counted(three)
    by = {}
    for r, c, s in zip(rows, cls, sets, strict=True):
        by.setdefault(c if s else (c, "none"), []).append(tuple(map(str, r)))
    assert three.columns == docs.columns and len(kept) == len(by) and all(sum(m in kept for m in set(members)) == 1 for members in by.values())
    # decontamination: documents with an item's ten words in a row, or a whole shorter item, go
    four = stage(spark, at, three, "decontamination", 4, tmp_path)
    items = [w for w in (shared.alnum_words(r.text) for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()) if w]
    windows = {tuple(w[i : i + min(10, len(w))]) for w in items for i in range(max(1, len(w) - 9))}
    held = lambda w: any(tuple(w[i : i + len(x)]) == x for x in windows for i in range(len(w) - len(x) + 1))
    assert counted(four) == sorted(tuple(map(str, r)) for r in three.collect() if not held(shared.alnum_words(r.text)))
    assert 0 < four.count() < three.count() and decontaminate.WINDOW == 10
    # packing: every token, bin by bin as a plain best fit has it
    five = stage(spark, at, four, "best_fit_packing", 5, tmp_path)
    out = five.toPandas()
    assert out.n_tokens.sum() == sum(len(shared.space_words(r.text)) + 1 for r in four.collect())
    packed_as_plainly(out)
    assert counted(corpus_pipeline.run(spark, at)) == counted(five)


def shared_hash(text):
    import xxhash

    h = xxhash.xxh3_64_intdigest((text or "").encode())
    return h - (1 << 64 if h >> 63 else 0)


def test_pipeline_of_nothing(spark, corpus, tmp_path):
    at, _ = corpus
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{at}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
