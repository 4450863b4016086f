"""op1 against brute force over every n-gram that was seen, those seen once too."""

import math
import zlib
from collections import Counter

import pytest

from quern.llm import language_model, queries, shared


@pytest.mark.parametrize("shard", [language_model.SHARD, 20])
def test_ngrams_that_occur_once(spark, tmp_path, monkeypatch, shard):
    monkeypatch.setattr(language_model, "SHARD", shard)
    texts = ["the red fox ran home", "a blue whale sang at night", "the red hen sat", "the red fox ran home again", None, "", "the blue fox"]
    rows = [(i, texts[i % len(texts)] if i % 7 < 5 or i > 20 else f"only here {i} once") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seq = lambda t: [b"<s>", *shared.space_words(t), b"</s>"]
    learn = [seq(t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    one, grams, after = Counter(), Counter(), Counter()
    for w in learn:
        one.update(w[1:])
        for i in range(1, len(w)):
            for g in {tuple(w[max(0, i - k) : i + 1]) for k in (1, 2)}:
                grams[g] += 1
    for g in grams:
        after[g[:-1]] += 1
    assert sum(c == 1 for c in grams.values()) > 10
    n, v = sum(one.values()), len(one)

    def p(g):
        if len(g) == 1:
            return (one[g[0]] + 1) / (n + v + 1)
        k = (len(learn) if g[0] == b"<s>" else one[g[0]]) if len(g) == 2 else grams[g[:-1]]
        return p(g[1:]) if not k else max(0, grams[g] - 0.75) / k + (1 - sum(c - 0.75 for h, c in grams.items() if h[:-1] == g[:-1]) / k) * p(g[1:])

    got = {r.doc_id: r.score for r in queries.op1_ngram_lm(spark, str(tmp_path)).collect()}
    for i, t in rows:
        w = seq(t)
        assert got[i] == pytest.approx(sum(math.log10(p(tuple(w[max(0, k - 2) : k + 1]))) for k in range(1, len(w))), abs=1e-3 * len(w))


def test_counts_of_any_size():
    """Counts beyond 32 bits come back from packed blocks as they went in."""
    import numpy as np

    from quern.llm import language_model

    k, c = np.array([3, 9, 2**63 + 5], np.uint64), np.array([1, 2**32 + 3, 2**41], np.int64)
    for own in (c, c % 1000 + 1):
        (part, n, raw), = language_model._split(k, own, np.zeros(3, np.int64))
        keys, counts = language_model._unpacked(n, raw)
        assert part == 0 and keys.tolist() == k.tolist() and counts.tolist() == own.tolist()


def test_lookups_beside_the_ends():
    """Nothing is found beyond the last element, neighbours come as they are one by one, and packed sorts number keys as np.unique does."""
    import numpy as np

    from quern.llm import elias_fano

    rng = np.random.default_rng(4)
    for x in (np.array([5]), np.array([3, 900]), np.sort(rng.integers(0, 1 << 20, 700)), np.arange(0, 64 * 500, 64), np.repeat([7, 90_000], 200)):
        ef = elias_fano.EliasFano(*elias_fano.encode(x))
        want = np.unique(np.concatenate([x, x + 1, x[-1] + np.arange(1, 1 << 12), x[-1] + (np.arange(1, 300) << 10)])).astype(np.uint64)
        at, hit = ef.find(want, np.zeros(len(want), np.int64), np.full(len(want), len(x)))
        assert hit.tolist() == np.isin(want, x.astype(np.uint64)).tolist()
        assert (x[at[hit]] == want[hit]).all()
        a, b = ef.both(np.arange(len(x) - 1))
        assert a.tolist() == x[:-1].tolist() and b.tolist() == x[1:].tolist()
    for n, most in ((0, 1), (1, 9), (5000, 900), (5000, 1 << 40), (300, 1 << 62)):
        key = rng.integers(0, most, n).astype(np.uint64)
        for got, own in zip(language_model._distinct(key), np.unique(key, return_inverse=True), strict=True):
            assert got.tolist() == own.tolist()


def _peak(work):
    """What work() returns, and the bytes that it held at most."""
    import gc
    import tracemalloc

    gc.collect()
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_tasks_hold_little(monkeypatch, tmp_path):
    """Counting, merging, writing and viewing n-grams take few bytes each beyond the n-grams themselves."""
    import numpy as np

    from quern.llm import elias_fano

    for module in (language_model, elias_fano):
        monkeypatch.setattr(module, "STEP", 1 << 15)
    rng, n = np.random.default_rng(7), 600_000
    keys = (rng.integers(0, 5000, n).astype(np.uint64) << np.uint64(32)) | rng.integers(0, 300, n).astype(np.uint64)
    want, times = np.unique(keys, return_counts=True)

    rows, most = _peak(lambda own=keys.copy(): list(language_model._blocks(own, 7)))
    assert most < 32 * n
    got = [language_model._unpacked(m, raw) for _, m, raw in rows]
    k, c = (np.concatenate(x) for x in zip(*got, strict=True))
    assert len(rows) == 7 and k[np.argsort(k)].tolist() == want.tolist() and c[np.argsort(k)].tolist() == times.tolist()

    for size in (90_000, 500):  # in blocks of many keys and of few
        blocks = [np.unique(keys[i : i + size], return_counts=True) for i in range(0, n, size)]
        parts, most = _peak(lambda blocks=blocks: sum((list(language_model._split(k, c, (k >> np.uint64(42)).astype(np.int64))) for k, c in language_model._merged(blocks)), []))
        assert len(parts) > 5 and most < 16 * n
        got = [language_model._unpacked(m, raw) for _, m, raw in parts]
        k, c = (np.concatenate(x) for x in zip(*got, strict=True))
        assert k.tolist() == want.tolist() and c.tolist() == times.tolist()

    _, most = _peak(lambda: language_model._level(f"{tmp_path}/level", want, 0, times, np.full(5000, 2.0 * n), lambda node, w: np.full(len(w), 0.01)))
    assert most < 26 * len(want)
    files = language_model.load(f"{tmp_path}/level")
    ef, most = _peak(lambda: elias_fano.EliasFano(*files[4:8]))
    ends = np.append(0, np.cumsum(np.bincount((want >> np.uint64(32)).astype(np.int64), minlength=5000)))
    assert elias_fano.EliasFano(*files[:4])[np.arange(5001)].tolist() == ends.tolist()
    last = np.maximum.reduceat(want & np.uint64(0xFFFFFFFF), ends[:-1])
    x = np.append(0, np.cumsum(last)[:-1])[(want >> np.uint64(32)).astype(np.int64)] + (want & np.uint64(0xFFFFFFFF)).astype(np.int64)
    assert ef[np.arange(ef.n)].tolist() == x.tolist()
    high = np.unpackbits(ef.bytes.reshape(-1), bitorder="little")
    assert ef.select0(np.arange((high == 0).sum())).tolist() == np.flatnonzero(high == 0).tolist()
    assert most + ef.zeros.nbytes < len(want) / 32 + 8192
