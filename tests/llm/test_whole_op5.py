"""op5 and the pipeline's stage on lines of few distinct words, against brute force."""

import corpus_pipeline
from quern.llm import queries, shared


def test_lines_of_few_words(spark, tmp_path):
    texts = [
        "Read more\na b a b a b a b\none two three four\n\n...",
        "read MORE!\nfirst line of its own here today\nx",
        "b a\none two three four five\n\n...\nmore",
        "東京都は今日も晴れです\none two three\nthree two one zero",
        "東京都は今日も晴れです\nREAD more\nnot seen\none two three",
        "x\nread more",
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, seen = {}, []
    for i, t in enumerate(texts):
        want[i] = []
        for k, x in enumerate(t.split("\n")):
            w = frozenset(shared.alnum_words(x))
            if w and any(len(w & v) >= 0.8 * len(w | v) for v in seen):
                want[i].append(k)
            seen += [w] * bool(w)
    assert want == {0: [], 1: [0], 2: [0, 1], 3: [], 4: [0, 1, 3], 5: [0, 1]}
    assert {r.doc_id: list(r.removed) for r in queries.op5_line_dedup(spark, str(tmp_path)).collect()} == want
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, docs, str(tmp_path)).collect()}
    assert got == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i]) for i, t in enumerate(texts) if i != 5}
