"""Long words whose letters alternate as the digit sums of their places do are told apart by every operator that hashes words."""

import zlib

import numpy as np
import pytest

from quern.llm import huffman, jaccard_join, language_model, line_dedup, queries, shared, toxicity


def alternating(n):
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


SIZES = (1024, 2048, 4096)


def test_hashes():
    for n in (8, 16, 31, 32, 33, 64, *SIZES):
        data, cuts = (x := " ".join(alternating(n)).encode()), np.array([0, 2 * n + 1])
        raw = np.frombuffer(data, np.uint8)
        for values in (shared.ALNUM, shared.SPACE):
            starts, h = shared.word_hashes(raw, cuts, values)
            assert starts.tolist() == [0, n + 1] and h[0] != h[1]
            again = shared.word_hashes(np.frombuffer(x.upper(), np.uint8), cuts, values)[1]
            assert (again == h).all()
        assert len(set(huffman.pieces(raw, cuts)[2].tolist())) == 2


def test_words_across_cuts_and_chunks(monkeypatch):
    long, short = "x" * 50, "y" * 20
    text = f"{long}{long} {short} {long} " * 40
    data = np.frombuffer(text.encode(), np.uint8)
    cuts = np.array([0, 50, len(data)])
    want = shared.word_hashes(data, cuts)
    assert len(set(want[1].tolist())) == 3 and want[1][0] == want[1][1]
    monkeypatch.setattr(shared, "_CHUNK", 64)
    got = shared.word_hashes(data, cuts)
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(2 * k + i, w) for k, n in enumerate(SIZES) for i, w in enumerate(alternating(n))]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_line_dedup_and_join(spark, odd):
    assert [r.removed for r in line_dedup.removals(odd, words=1).collect() if r.removed] == []
    got = jaccard_join.join(odd).collect()
    assert len({r.class_id for r in got}) == 6 and {r.n_copies for r in got} == {0}


def test_language_model(spark):
    a, b = alternating(1024)
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2][:3]
    other = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(ids[0], f"some words {a}"), (ids[1], "some more words"), (ids[2], None), (other, b)]
    got = {r.doc_id: r for r in language_model.fit_and_score(spark.createDataFrame(rows, "doc_id long, text string"), shared.held_out(7, 2), least=1).collect()}
    assert got[other].n_known == 1 and got[ids[0]].n_known == 4


def test_tokens(odd):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path(queries.TOKENIZER)
    one, each = Tokenizer.from_file(path), huffman.Encoder(path)
    texts = [w for n in SIZES for w in alternating(n)]
    import pyarrow as pa

    ids, n = each(pa.array(texts), 2)
    want = [[*one.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


def test_sample_is_bounded(spark, monkeypatch):
    """One id on many rows, and very long texts, reach the driver as one text an id and within the characters asked for."""
    docs = spark.range(4000).selectExpr("least(id, 5) as doc_id", "case when id = 4 then repeat('long ', 9000) else concat('word ', id % 9) end as text")
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "crossed", lambda texts, labels, weights: seen.append((texts, labels.tolist())))
    toxicity.fit(docs, labels, sample=3, chars=20_000)
    texts, y = seen[0]
    assert len(texts) <= 6 and sorted(y)[-3:] == [1, 1, 1] and sum(map(len, texts)) < 1000
