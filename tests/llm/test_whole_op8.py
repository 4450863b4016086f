"""op8 with a benchmark of several blocks, and matches of passages that items share."""

from quern.llm import decontaminate


def test_several_blocks(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(9)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    texts = [f"a {rows[2][1]} b {rows[7][1]}", "nothing of it", None, rows[8][1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    columns = ("doc_id", "n_words", "n_hit", "items", "longest")
    one = decontaminate.report(docs, items).select(*columns).orderBy("doc_id").collect()
    assert [(r.n_hit, r.longest, r["items"]) for r in one] == [(24, 12, ["2", "7"]), (0, 0, []), (0, 0, []), (12, 12, ["8"])]
    monkeypatch.setattr(decontaminate.Tests.__init__, "__defaults__", (decontaminate.WINDOW, 30))
    assert len(decontaminate.Tests(items).sent) == 5
    assert decontaminate.report(docs, items).select(*columns).orderBy("doc_id").collect() == one
    assert [r.doc_id for r in decontaminate.clean(docs, items).orderBy("doc_id").collect()] == [1, 2]


def test_matches_of_shared_passages(spark):
    """Every left-maximal match with every place of every item, also where an earlier item shares the window."""
    shared_ = [f"s{k}" for k in range(10)]
    a, b = [*shared_, "a1", "a2"], ["b0", *shared_, *(f"b{k}" for k in range(1, 31))]
    c = ["c0", *shared_, "c1", *shared_, "b1", "c2"]  # the passage twice in one item
    items = {"A": a, "B": b, "C": c, "D": ["d1", "d2"], "E": a}
    texts = [["x", *b[1:], "y"], [*a, "z", *c[11:]], ["q", *shared_], ["d1", "d2", "d1", "d2"], ["no"], b]

    def want(text, item):
        n = min(10, len(item))
        for p in range(len(text)):
            for k in range(len(item)):
                if p and k and text[p - 1] == item[k - 1]:
                    continue
                m = 0
                while p + m < len(text) and k + m < len(item) and text[p + m] == item[k + m]:
                    m += 1
                if m >= n:
                    yield p, k, m

    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id string, text string")
    expected = sorted((d, p, i, k, m) for d, t in enumerate(texts) for i, x in items.items() for p, k, m in want(t, x))
    assert (0, 1, "B", 1, 40) in expected
    assert sorted(tuple(r) for r in decontaminate.matches(docs, bench).collect()) == expected
    longest = {r.doc_id: r.longest for r in decontaminate.report(docs, bench).collect()}
    assert longest == {d: max((m for e, *_, m in expected if e == d), default=0) for d in range(len(texts))}
