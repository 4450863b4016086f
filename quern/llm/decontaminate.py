"""Benchmark decontamination by suffix arrays of the training text.

Each slice of documents becomes one sequence of word numbers in which words that no benchmark item has, and the ends of
documents, are 0.  Its suffixes that could match are sorted by their first `window` words (a suffix array to that
depth; words are packed several to an integer), and every benchmark suffix is found in it by binary search.  From each
interval come the places of the window, and extending them along every place of it in the items gives the longest
verbatim matches.

The benchmark goes to the executors as files of a bounded number of words, one in memory at a time; the documents
are read once, and nothing of them is shuffled.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import alnum_words, filesystem, publish, scratch, spans, text_batches

WINDOW = 10
#: Benchmark words in a block: what an executor holds at a time.
BLOCK_WORDS = 1_000_000


class Test:
    """A block of benchmark items, as word numbers from 1 on, with the distinct windows of them."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({i for i, _ in items})
        number = {n: k for k, n in enumerate(self.names)}
        own: dict[tuple[int, ...], set[int]] = {}
        places: dict[tuple[int, ...], list[int]] = {}  # of each window: all its places in `flat`
        rows = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64) for _, words in items]
        begin = spans(np.array([len(ids) + 1 for ids in rows], np.int64)) + 1
        self.flat = np.full(int(begin[-1]), -1, np.int64)  # all items, with -1 before, between and after them
        for row, ((name, _), ids) in enumerate(zip(items, rows, strict=True)):
            self.flat[begin[row] : begin[row] + len(ids)] = ids
            n = min(window, len(ids))
            for k in range(len(ids) - n + 1 if n else 0):
                key = tuple(ids[k : k + n].tolist())
                own.setdefault(key, set()).add(number[name])
                places.setdefault(key, []).append(int(begin[row]) + k)
        self.begin, self.row_names = begin[:-1], [name for name, _ in items]
        self.place_at = spans(np.array([len(v) for v in places.values()], np.int64))
        self.places = np.array([x for v in places.values() for x in v], np.int64)
        self.lengths = np.array([len(k) for k in own], np.int64)
        self.least = int(self.lengths.min()) if len(own) else 0
        self.items = [np.array(sorted(v), np.int64) for v in own.values()]
        self.bits = max(1, (len(self.vocabulary) + 1).bit_length())
        words = np.zeros((len(own), window), np.int64)
        for r, k in enumerate(own):
            words[r, : len(k)] = k
        self.low = self.pack(words.T)
        short = np.arange(window)[:, None] >= self.lengths[None, :]
        self.high = self.pack(np.where(short, (1 << self.bits) - 1, words.T))

    def pack(self, words: np.ndarray) -> list[np.ndarray]:
        """words[i]: the i-th words of all suffixes.  Integers whose order, taken in turn, is that of the suffixes."""
        each = 62 // self.bits
        return [sum(words[i] << (self.bits * (each - 1 - (i - k))) for i in range(k, min(k + each, self.window))) for k in range(0, self.window, each)]


def suffix_array(ids: np.ndarray, test: Test) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions sorted by their first words, and the packed words in that order; those that can match no window are left out."""
    padded = np.concatenate([ids, np.zeros(test.window, np.int64)])
    known = ids > 0
    for k in range(1, test.least):
        known = known & (padded[k : k + len(ids)] > 0)
    at = np.flatnonzero(known)
    keys = test.pack([padded[at + i] for i in range(test.window)])
    order = np.lexsort(keys[::-1])
    return at[order], [k[order] for k in keys]


def search(keys: list[np.ndarray], wanted: list[np.ndarray], after: bool) -> np.ndarray:
    """Binary search of all suffixes at once: how many sorted suffixes come before each, or with `after` not after it."""
    n = len(keys[0])
    lo, hi = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), n, np.int64)
    while n and (open_ := lo < hi).any():
        mid = np.minimum((lo + hi) >> 1, n - 1)
        less = np.full(len(mid), after)
        for k, w in zip(reversed(keys), reversed(wanted), strict=True):
            v = k[mid]
            less = (v < w) | ((v == w) & less)
        lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
    return lo


def occurrences(ids: np.ndarray, test: Test) -> tuple[np.ndarray, np.ndarray]:
    """All places of all windows: numbers of windows and positions."""
    if not len(test.lengths) or not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, keys = suffix_array(ids, test)
    lo, hi = search(keys, test.low, False), search(keys, test.high, True)
    n = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(n)), n)
    return which, at[np.repeat(hi - np.cumsum(n), n) + np.arange(int(n.sum()))]


def longest(ids: np.ndarray, test: Test, which: np.ndarray, at: np.ndarray, most: int = 1_000_000):
    """Left-maximal matches of every place of the windows in the items, some at a time: (occurrence, place, words that match from there on)."""
    n = np.diff(test.place_at)[which]
    total, text = np.cumsum(n), np.append(ids, 0)
    first = 0
    while first < len(which):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + most, "right")))
        own = n[first:last]
        i = np.repeat(np.arange(first, last), own)
        place = test.places[np.repeat(test.place_at[which[first:last]] + own - np.cumsum(own), own) + np.arange(int(own.sum()))]
        left = np.where(at[i] > 0, text[at[i] - 1], 0) != test.flat[place - 1]  # neither 0 nor -1 is a word of both
        i, place = i[left], place[left]
        size = test.lengths[which[i]].copy()
        go = np.arange(len(i))
        while len(go):
            go = go[text[at[i[go]] + size[go]] == test.flat[place[go] + size[go]]]
            size[go] += 1
        yield i, place, size
        first = last


class Tests:
    """Blocks of the benchmark, files in the shared folder; in a task, one is unpacked at a time."""

    def __init__(self, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS):
        spark = benchmark.sparkSession
        rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").cast("string").alias("t"))
        self.sent, block, size, folder = [], [], 0, scratch(spark)

        def send():
            path = f"{folder}/block-{len(self.sent):06d}"
            publish(path, lambda out: out.write(zlib.compress(pickle.dumps(Test(block, window)))))
            self.sent.append(path)

        for r in rows.toLocalIterator():
            words = alnum_words(r.t)
            if block and size + len(words) > block_words:
                send()
                block, size = [], 0
            if words:
                block.append((r.i, words))
                size += len(words)
        if block or not self.sent:
            send()
        self.one: Test | None = None

    def __getstate__(self):
        return {"sent": self.sent, "one": None}

    def __iter__(self):
        if len(self.sent) == 1:
            self.one = self.one or self.block(self.sent[0])
            yield self.one
            return
        for path in self.sent:
            yield self.block(path)

    @staticmethod
    def block(path: str) -> Test:
        fs, where = filesystem(path)
        with fs.open_input_stream(where) as f:
            return pickle.loads(zlib.decompress(f.read()))

    def look(self, texts: list[str | None], places: bool = False):
        """For each text: (words, hit words, item ids in order, longest match); with places, a list of matches as well.

        A match is (text's number, its word offset, item id, item's word offset, length), left-maximal.
        """
        words = [alnum_words(t) for t in texts]
        n = np.array([len(w) for w in words], np.int64)
        starts = spans(n + 1)
        hit = np.zeros(int(starts[-1]) + 1, np.int32)
        items: list[set[str]] = [set() for _ in texts]
        most = np.zeros(len(texts), np.int64)
        found = []
        for test in self:
            get = test.vocabulary.get
            ids = np.zeros(int(starts[-1]), np.int64)
            for s, w in zip(starts.tolist(), words, strict=False):
                ids[s : s + len(w)] = [get(x, 0) for x in w]
            which, at = occurrences(ids, test)
            if not len(which):
                continue
            np.add.at(hit, at, 1)
            np.add.at(hit, at + test.lengths[which], -1)
            doc = np.searchsorted(starts, at, "right") - 1
            for d, w in np.unique(np.stack([doc, which], 1), axis=0).tolist():
                items[d].update(test.names[i] for i in test.items[w])
            for i, place, length in longest(ids, test, which, at):
                np.maximum.at(most, doc[i], length)
                if places:
                    row = np.searchsorted(test.begin, place, "right") - 1
                    for d, p, k, e, m in zip(doc[i].tolist(), (at[i] - starts[doc[i]]).tolist(), row.tolist(), (place - test.begin[row]).tolist(), length.tolist(), strict=True):
                        found.append((d, p, test.row_names[k], e, m))
        covered = np.cumsum(hit)[:-1] > 0
        hits = [int(covered[a : a + k].sum()) for a, k in zip(starts.tolist(), n.tolist(), strict=False)]
        out = list(zip(n.tolist(), hits, [sorted(x) for x in items], most.tolist(), strict=True))
        return (out, sorted(set(found))) if places else out


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items and longest (words of the longest match) for each row.

    Null and empty texts have no words and are clean, repeated rows give repeated rows, null ids stay, other columns
    are ignored; an empty benchmark leaves all clean, and items with null ids go by the empty name.
    """
    tests, kind = Tests(benchmark, window), dict(docs.dtypes)["doc_id"]

    def run(batches):
        for b in text_batches(batches):
            n, hit, items, most = zip(*tests.look(b.column("text").to_pylist()), strict=True)
            sha = [hashlib.sha256(",".join(i).encode()).hexdigest() for i in items]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(map(len, items), pa.int64()), pa.array(sha), pa.array([h > 0 for h in hit]), pa.array(items, pa.list_(pa.string())), pa.array(most, pa.int64())],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "longest"],
            )

    schema = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, longest long"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The longest verbatim matches and where they are: doc_id, doc_word, item_id, item_word, length, all in words."""
    tests, kind = Tests(benchmark, window), dict(docs.dtypes)["doc_id"]

    def run(batches):
        for b in text_batches(batches):
            _, found = tests.look(b.column("text").to_pylist(), places=True)
            cols = list(zip(*found, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())],
                ["doc_id", "doc_word", "item_id", "item_word", "length"],
            )

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, doc_word long, item_id string, item_word long, length long")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, with all their columns, of which no word is hit."""
    tests = Tests(benchmark, window)

    def run(batches):
        for b in text_batches(batches):
            yield b.filter(pa.array([r[1] == 0 for r in tests.look(b.column("text").to_pylist())]))

    return docs.mapInArrow(run, docs.schema)


ORACLE = r"""WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS g FROM (SELECT *, least(10, len(w)) AS n FROM i WHERE len(w) > 0)),
s AS (SELECT DISTINCT n FROM v),
d AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS k, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS g FROM w, s WHERE len(w) >= n),
h AS (SELECT r, d.n, k, item FROM d JOIN v ON d.g = v.g AND d.n = v.n),
p AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS k FROM h) GROUP BY r),
q AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN p USING (r) LEFT JOIN q USING (r)"""
