"""Lexical search, importance resampling and sharding against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from quern.llm import importance, lexical, sharding

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text):
    return TERM.findall((text or "").encode().translate(LOW))


def rows_of(seed, n=80):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("Oak", "elm", "ASH", "fir-", "né", "日本", "3") for b in range(9)]
    text = lambda k: " ".join(rng.choice(vocabulary[: rng.choice((5, 20, 63))]) for _ in range(k))
    out = [None, "", " \n\t", "--", "one", "İstanbul ẞ ſ K", *[text(rng.randint(1, 90)) for _ in range(n)], text(30_000)]
    return [*out, *out[6:12] * 3]  # copies under other ids


FORM = "doc_id long, text string, size string, shard string, rank int, score double, part int"


def table(spark, texts, more=()):
    rows = [(i, t, "x", None, 1, 0.5, 2) for i, t in enumerate(texts)] + [(i, t, "x", None, 1, 0.5, 2) for i, t in more]
    return spark.createDataFrame(rows, FORM).repartition(5)


@pytest.fixture(scope="module")
def docs(spark):
    texts = rows_of(1)
    return table(spark, texts, [(7, texts[7]), (7, texts[7]), (7, texts[8]), (None, texts[9]), (None, texts[9]), (None, None)]).cache()


@pytest.fixture(scope="module")
def items(spark):
    texts = rows_of(2, 30)
    rows = [(f"q{i}", t) for i, t in enumerate(texts)] + [("q7", texts[7]), ("q7", texts[8]), (None, texts[9])]
    return spark.createDataFrame(rows, "item_id string, text string")


def searched(docs, items, k):
    rows = [(r.doc_id, Counter(words(r.text))) for r in docs.collect()]
    rows = [(d, c, c.total()) for d, c in rows if c]
    n, total = len(rows), sum(x[2] for x in rows)
    df = Counter(w for _, c, _ in rows for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for w, x in df.items()}
    out = []
    for r in items.collect():
        terms = {w for w in words(r.text) if w in weight}
        found = []
        for d, c, size in rows:
            m = 50 + 50 * size * n // total
            score = sum(weight[w] * (1_000_000_000 * c[w] // (1000 * c[w] + 20 * m)) for w in terms)
            if score > 0:
                found.append((-score, d is not None, d or 0, d))
        out += [(r.item_id, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(found)[:k])]
    return out


def same(got, want):
    key = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize(("k", "block", "size"), [(50, 200_000, 4_000_000), (3, 40, 3000), (7, 1, 400)])
def test_search(docs, items, k, block, size, monkeypatch, spark):
    monkeypatch.setattr(lexical, "SEGMENT", size)
    same(lexical.rank(docs, items, k, block).collect(), searched(docs, items, k))


def test_search_of_nothing(spark, docs, items):
    assert lexical.rank(docs.where("false"), items).collect() == []
    assert lexical.rank(docs, items.where("false")).collect() == []
    assert lexical.rank(docs.where("doc_id < 4"), items).collect() == []
    assert lexical.rank(docs, spark.createDataFrame([(1, "nothinglikethis"), (2, None)], "item_id int, text string")).collect() == []
    with pytest.raises(TypeError):
        lexical.index(docs.selectExpr("cast(doc_id as string) as doc_id", "text"), "unused")


def test_few_documents_are_scored_exactly(spark):
    """Upper bounds keep nearly all documents from the exact step."""
    rng = random.Random(4)
    texts = [" ".join(f"w{int(rng.paretovariate(0.5)) % 3000}" for _ in range(rng.randint(20, 200))) for _ in range(3000)]
    m, terms, at, place, bounds, tf = lexical.segment(texts, 3000, sum(len(t.split()) for t in texts))
    one = lexical.Segment({"doc_ids": list(range(3000)), "lengths": m.tobytes(), "terms": terms, "at": at.tobytes(), "places": place.tobytes(), "bounds": bounds.tobytes(), "tf": tf.astype("u4").tobytes()})
    vocabulary = {w: i for i, w in enumerate(terms.split(b" "))}
    df = at[1:] - at[:-1]
    asked = [lexical.np.unique([vocabulary[w.encode()] for w in t.split()]) for t in texts[:40]]
    scored = lexical.look(one, vocabulary, lexical.weights(df, 3000), asked, lexical.Best(40, 50))
    assert 40 * 50 <= scored < 40 * 150


def resampled(docs, target, runs=2, buckets=10_000, least=20, percent=25, seed=7):
    def features(text):
        w = words(text)
        return Counter(zlib.crc32(b" ".join(w[i : i + n])) % buckets for n in range(1, runs + 1) for i in range(len(w) - n + 1)), len(w)

    source, wanted = Counter(), Counter()
    for t, c in ((docs, source), (target, wanted)):
        for r in t.collect():
            c.update(features(r.text)[0])
    s, t = source.total(), wanted.total()
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((source[b] + 1) * (t + buckets)))) for b in range(buckets)]
    rows = []
    for r in docs.collect():
        f, n = features(r.text)
        weight = sum(gain[b] * k for b, k in f.items()) // f.total() if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((r.doc_id, f.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = able[: percent * len(able) // 100]
    rest = Counter(rows) - Counter(drawn)
    return [(*r[:4], i + 1) for i, r in enumerate(drawn)] + [(*r[:4], None) for r in rest.elements()]


@pytest.mark.parametrize(("runs", "percent"), [(2, 25), (3, 60), (1, 100)])
def test_resampling(docs, items, runs, percent, monkeypatch):
    monkeypatch.setattr(importance, "SLICE", 500)
    got = importance.resample(docs, items, percent, runs).select("doc_id", "n_features", "weight", "score", "rank")
    same(got.collect(), resampled(docs, items, runs, percent=percent))


def test_resampling_of_nothing(docs, items):
    empty = docs.where("false")
    assert importance.resample(empty, items).collect() == []
    same(importance.resample(docs, items.where("false")).select("doc_id", "n_features", "weight", "score", "rank").collect(), resampled(docs, items.where("false")))
    drawn = importance.draw(docs, items, 25)
    assert drawn.columns == docs.columns and drawn.count() >= sum(r[4] is not None for r in resampled(docs, items))


def test_long_text_keeps_its_ring(monkeypatch):
    text = "a bc d " * 4000
    want = importance.states(text, 3)
    monkeypatch.setattr(importance, "SLICE", 7)
    got = importance.states(text, 3)
    assert got[1] == want[1] == 12000 and got[0].tolist() == want[0].tolist()


def placed(docs, shards):
    size = lambda r: len((r.text or "").encode()) + 1
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    total, at = sum(map(size, rows)), 0
    out = []
    for r in rows:
        out.append((r.doc_id, size(r), zlib.crc32((r.text or "").encode()), min(shards - 1, (2 * at + size(r)) * shards // (2 * total))))
        at += size(r)
    return out


@pytest.mark.parametrize("shards", [16, 1, 5])
def test_shards(docs, shards):
    docs = docs.where("doc_id is null or doc_id != 7 or size = 'y'")  # rows of one id follow in any order
    got = sharding.place(docs.where("doc_id is not null"), shards).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32, r.shard) for r in got) == placed(docs.where("doc_id is not null"), shards)
    for s in {r.shard for r in got}:
        own = sorted((r.slot, r.doc_id) for r in got if r.shard == s)
        assert [x[0] for x in own] == list(range(len(own))) and [x[1] for x in own] == sorted(x[1] for x in own)


def test_shards_of_odd_tables(spark, docs):
    assert sharding.place(docs.where("false")).collect() == []
    got = sharding.place(docs, 4).collect()
    assert len(got) == docs.count() and {r.doc_id for r in got if r.shard == 0} >= {None, 0, 1}
    shares = Counter()
    for r in got:
        shares[r.shard] += r.size
    assert max(shares.values()) - min(shares.values()) <= 2 * max(r.size for r in got)
    for s in range(4):
        own = [r.slot for r in got if r.shard == s]
        assert sorted(own) == list(range(len(own)))


def test_one_id_on_many_rows(spark):
    """A third of all rows share an id and a text: they are spread over shards like any others."""
    docs = spark.range(3000).selectExpr("if(id < 1000, 5, id) as doc_id", "if(id < 1000, 'the same', repeat('x', cast(id % 20 as int))) as text")
    got = sharding.place(docs, 8).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 40 and len({r.shard for r in got if r.doc_id == 5}) == 3


def test_shard_files(docs, tmp_path):
    out = sharding.write(docs, f"{tmp_path}/shards", 4)
    assert {p.name for p in (tmp_path / "shards").glob("shard_=*")} <= {f"shard_={i}" for i in range(4)}
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")
    assert sorted(map(tuple, out.select(*docs.columns).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    assert sorted((r.slot for r in out.where("shard_ = 3").collect())) == list(range(out.where("shard_ = 3").count()))
