"""op6 on words of any length: n-grams after the 64th character count."""

import numpy as np

from quern.llm import toxicity


def test_long_words(spark):
    head = "天" * 80
    assert set(toxicity.subwords(f"{head}毒物質".encode())) >= {toxicity.xxhash.xxh3_64_intdigest(g) % toxicity.BUCKETS for g in ("毒物質", "天毒物質", "毒物質>")}
    value = np.zeros(toxicity.BUCKETS, np.float32)
    value[[i for i in toxicity.subwords("毒物質".encode()) if i not in toxicity.subwords(head.encode())]] = 500 * (1 + toxicity.PADDING)
    model = toxicity.Model(value, -1.0)
    docs = spark.createDataFrame([(1, head + "毒物質" + head), (2, head + head), (3, head * 20 + "毒物質")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert got[1] > 0.7 and got[2] < 0.5 and got[3] > got[2]
    memo = toxicity.Words(model)
    assert memo[b"a" * 10_000] == model.word(b"a" * 10_000) and not len(memo)
    assert memo[b"word"] == model.word(b"word") and list(memo) == [b"word"]


def test_held_out_rows(spark):
    """Held-out toxic rows are found, with misspellings that no learning row has; clean ones are left alone."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(7)
    words = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    bad = ["blorgish", "fnarkhole", "zwimpface"]
    rows = []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if i % 4 == 0:
            for _ in range(3):
                x = rng.choice(bad)
                k = rng.randrange(len(x))
                text.insert(rng.randrange(len(text)), rng.choice([x, x[:k] + x[k] + x[k:], x.upper()]))
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    every = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    learn = F.col("doc_id") % 3 != 1
    model = toxicity.fit(every.select("doc_id", "text"), every.select("doc_id", "toxic"), learn)
    got = {r.doc_id: r.score for r in toxicity.score(every, model).collect()}
    held = [(got[i], y) for i, _, y in rows if i % 3 == 1]
    assert np.mean([s >= 0.7 for s, y in held if y]) >= 0.8 and np.mean([s >= 0.7 for s, y in held if not y]) <= 0.02


def test_few_or_no_labels(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "bad", None, ""])], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (3, None)], "doc_id long, toxic int")
    for some in (labels, labels.where("false")):
        model = toxicity.fit(docs, some)
        assert all(r.score < 0.7 for r in toxicity.score(docs, model).collect())
        assert toxicity.clean(docs, model).count() == 4
    assert toxicity.fit(docs.where("false"), labels).bias == 0


def test_no_labels_of_quality(spark):
    from quern.llm import quality

    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for d, n in ((docs, 2), (docs.where("false"), 0)):
        got = quality.score(d, spark.createDataFrame([], "doc_id long, quality int")).collect()
        assert [r.score for r in got] == [0.5] * n
