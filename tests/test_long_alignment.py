"""Alignments that are parted along the way are those of one table, and long pairs need little memory."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quern.operators import align


@pytest.mark.parametrize("cells", [1, 6, 40])
def test_parted_pairs_keep_their_choices(monkeypatch, cells):
    rng = np.random.default_rng(cells)
    for _ in range(300):
        a, b = ([str(x) for x in rng.integers(0, rng.integers(1, 5), rng.integers(0, 24))] for _ in range(2))
        monkeypatch.setattr(align, "CELLS", 1 << 30)
        want = align.steps(a, b)
        monkeypatch.setattr(align, "CELLS", cells)
        assert align.steps(a, b) == want


def test_memory_of_a_long_pair():
    rng = np.random.default_rng(1)
    a = [str(x) for x in rng.integers(0, 300, 6000)]
    b = [x for x in a if rng.random() > 0.1] + ["end"]
    tracemalloc.start()
    steps = align.steps(a, b)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 25_000_000  # a table would have 32 million cells
    assert [r for r, _ in steps if r] == a and [h for _, h in steps if h] == b
    assert sum(r != h for r, h in steps) == align.distance(a, b)


def test_memory_of_many_pairs(monkeypatch):
    rng = np.random.default_rng(2)
    ref = [[str(x) for x in rng.integers(0, 300, 100)] for _ in range(1500)]
    hyp = [[t for t in r if rng.random() > 0.1] for r in ref]
    arrays = [pa.array(x, pa.list_(pa.string())) for x in (ref, hyp)]
    monkeypatch.setattr(align, "TOKENS", 500)
    tracemalloc.start()
    batches = list(align.tallied([pa.RecordBatch.from_arrays(arrays, ["ref", "hyp"])]))
    aligned = align.align_steps.func(*arrays)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 6_000_000  # one list of all steps takes some 20 million bytes
    assert len(batches) > 1 and aligned.to_pylist()[7] == [{"ref": r, "hyp": h} for r, h in align.steps(ref[7], hyp[7])]
    every = [x for r, h in zip(ref, hyp, strict=True) for x in align.steps(r, h)]
    got = {k: sum(sum(b.column(k).to_pylist()) for b in batches) for k in "ncsdi"}
    n, c, s, d, i = align.counts_of(every)
    assert got == {"n": n, "c": c, "s": s, "d": d, "i": i} and d
