"""Ranked lexical search: a two-level index of quantised impacts, with exact scores behind cheap upper bounds.

The index is a table of segments, each of some documents.  A segment has its terms, and for each term the documents that
hold it.  Its first level is a byte for each of these, the term's impact in the document rounded upwards; its second has
what exact scores need, the occurrences and the documents' lengths.  A search adds up weighted bytes, which gives every
document of the segment an upper bound and, less the weights, a lower one; documents whose upper bound reaches the kth
best lower bound (or the kth best score of the task's segments so far) are scored exactly, in 64-bit integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .importance import word_blocks
from .shared import ALNUM, keep, scratch, spans, text_batches, text_bytes
from .sharding import positions

#: Terms of the queries that are looked up at a time, in one pass over the index; one query has all its terms in one pass.
BLOCK_TERMS = 200_000
#: Characters of the texts of a segment.
SEGMENT = 4_000_000
#: Impacts lie below FULL; a byte counts units of FULL / STEPS, rounded up.
FULL, STEPS = 1_000_000, 255
_FORM = "doc_ids array<long>, lengths binary, terms binary, at binary, places binary, bounds binary, tf binary"


def statistics(docs: DataFrame) -> tuple[int, int]:
    """N, the documents with a term, and L, all their terms: places where a term begins, counted over all bytes at once."""

    def run(batches):
        count = total = 0
        for b in text_batches(batches):
            data, cuts = text_bytes(b.column("text"))
            word = ALNUM[data] != 0
            first = word.copy()
            first[1:] &= ~word[:-1]
            first[cuts[:-1][cuts[:-1] < len(data)]] = word[cuts[:-1][cuts[:-1] < len(data)]]
            n = np.diff(np.searchsorted(np.flatnonzero(first), cuts))
            count, total = count + int((n > 0).sum()), total + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64()), pa.array([total], pa.int64())], ["docs", "terms"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "docs long, terms long")
    row = counted.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    return row.docs or 0, row.terms or 0


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def segment(texts: list[str | None], count: int, total: int) -> tuple[np.ndarray, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """m of each text, and the terms one after another, where the places of each begin, places, bounds and occurrences."""
    number: dict[bytes, int] = {}
    m, term, place, tf = [], [], [], []
    for i, text in enumerate(texts):
        own: Counter[bytes] = Counter()
        for words in word_blocks(text):
            own.update(words)
        m.append(50 + 50 * own.total() * count // total if total else 50)  # of any size
        term.append(np.fromiter((number.setdefault(w, len(number)) for w in own), np.int64, len(own)))
        tf.append(np.fromiter(own.values(), np.int64, len(own)))
        place.append(np.full(len(own), i, np.uint32))
    m = np.array(m, np.int64)
    term, place, tf = (np.concatenate(x) for x in (term, place, tf))
    order = np.argsort(term, kind="stable")
    place, tf = place[order], tf[order]
    bounds = -(-impact(tf, m[place]) * STEPS // FULL)
    return m, b" ".join(number), spans(np.bincount(term, minlength=len(number))), place, bounds.astype(np.uint8), tf


@dataclass
class Index:
    """The table of segments, and how many documents with terms, and terms with repeats, it is of."""

    made: DataFrame
    count: int
    total: int


def index(docs: DataFrame, path: str) -> Index:
    """Writes the index of all rows of docs (doc_id, text) to path and returns it; each row of docs is a document.

    doc_id has to be an integer; null and empty texts have no terms.  Texts are whole, and each task writes the segments
    of what it reads: nothing is shuffled.  A second scan of the texts counts N and L beforehand.
    """
    kind = dict(docs.dtypes)["doc_id"]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"doc_id is {kind}; equal scores are ordered by integer ids")
    count, total = statistics(docs)

    def run(batches):
        for b in text_batches(batches, SEGMENT):
            rows = b.take(pc.sort_indices(b.column("doc_id"), null_placement="at_start"))
            m, terms, at, place, bounds, tf = segment(rows.column("text").to_pylist(), count, total)
            cols = [m.tobytes(), terms, at.tobytes(), place.tobytes(), bounds.tobytes(), tf.astype(np.uint32 if tf.max(initial=0) < 1 << 32 else np.int64).tobytes()]
            ids = pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([c], pa.binary()) for c in cols]], [x.split()[0] for x in _FORM.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return Index(keep(rows.mapInArrow(run, _FORM), path, "zstd"), count, total)


class Segment:
    """A row of the index, as far as its columns are there."""

    def __init__(self, row: dict):
        self.terms = row["terms"].split(b" ") if row["terms"] else []
        self.at = np.frombuffer(row["at"], np.int64)
        if "places" in row:
            self.ids = row["doc_ids"]
            self.m = np.frombuffer(row["lengths"], np.int64)
            self.places, self.bounds = np.frombuffer(row["places"], np.uint32), np.frombuffer(row["bounds"], np.uint8)
            width = len(row["tf"]) // max(1, len(self.places))
            self.tf = np.frombuffer(row["tf"], np.uint32 if width < 8 else np.int64)

    def known(self, vocabulary: dict[bytes, int]) -> dict[int, int]:
        """The number of each term of the vocabulary that is here, and its place here."""
        get = vocabulary.get
        return {v: k for k, w in enumerate(self.terms) if (v := get(w)) is not None}


def _rows(batches) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {n: b.column(n)[i].as_py() for n in b.schema.names}


def frequencies(made: DataFrame, vocabulary: dict[bytes, int]) -> np.ndarray:
    """The documents that hold each term of the vocabulary, from the lengths of the lists of all segments."""
    sent = made.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        total = np.zeros(len(sent.value), np.int64)
        for row in _rows(batches):
            one = Segment(row)
            found = one.known(sent.value)
            at = np.fromiter(found.values(), np.int64, len(found))
            total[np.fromiter(found, np.int64, len(found))] += one.at[at + 1] - one.at[at]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["v", "n"])

    got = made.select("terms", "at").mapInArrow(run, "v long, n long").groupBy("v").agg(F.sum("n").alias("n")).toPandas()  # a row a term
    out = np.zeros(len(vocabulary), np.int64)
    out[got["v"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    sent.destroy()
    return out


def weights(df: np.ndarray, count: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * count + 2) / (2 * df + 1))).astype(np.int64)


class Best:
    """The k best documents of each query so far, by score and then by id."""

    def __init__(self, queries: int, k: int):
        self.k, self.rows = k, [[] for _ in range(queries)]

    def least(self, q: int) -> int:
        """A score below which no document is among the k best."""
        return -self.rows[q][-1][0] if len(self.rows[q]) == self.k else 1

    def add(self, q: int, found: list[tuple[int, int | None]]) -> None:
        key = lambda x: (x[0], x[1] is not None, x[1] or 0)
        self.rows[q] = sorted(self.rows[q] + found, key=key)[: self.k]


def look(one: Segment, vocabulary: dict[bytes, int], weight: np.ndarray, asked: list[np.ndarray], best: Best) -> int:
    """Adds what a segment has to the best of each query (its terms' numbers); the documents that were scored exactly."""
    here = one.known(vocabulary)
    slices = {v: slice(int(one.at[k]), int(one.at[k + 1])) for v, k in here.items() if weight[v] > 0}
    upper = {v: weight[v] * one.bounds[s].astype(np.int64) for v, s in slices.items()}
    scored = 0
    for q, terms in enumerate(asked):
        terms = [v for v in terms.tolist() if v in slices]
        if not terms:
            continue
        total = np.zeros(len(one.m), np.int64)
        for v in terms:
            total[one.places[slices[v]]] += upper[v]
        bar = max(1, -(-STEPS * best.least(q) // FULL))
        if len(total) >= best.k:  # less one unit for each weight is a lower bound, which k documents at least reach
            bar = max(bar, int(np.partition(total, len(total) - best.k)[len(total) - best.k]) - int(weight[terms].sum()))
        near = np.flatnonzero(total >= bar)
        if not len(near):
            continue
        exact = np.zeros(len(near), np.int64)
        for v in terms:
            s = slices[v]
            at = np.searchsorted(one.places[s], near)
            at[at == s.stop - s.start] = 0
            hit = np.flatnonzero(one.places[s][at] == near)
            exact[hit] += weight[v] * impact(one.tf[s][at[hit]].astype(np.int64), one.m[near[hit]])
        scored += len(near)
        order = np.argsort(-exact, kind="stable")[: best.k]  # places go by ids
        best.add(q, [(-int(exact[i]), one.ids[near[i]]) for i in order.tolist() if exact[i] > 0])
    return scored


def search(of: Index, queries: DataFrame, k: int = 50, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score: for each row of queries (item_id, text) its k best documents of the index, scores above 0.

    Equal scores go by ascending doc_id, null ids first; each row of the indexed table is a document, each row of queries
    a query.  A term counts once in a query; null and empty queries, and those whose terms nothing holds, have no rows.
    Queries go through the index in blocks of `block_terms` terms; each task hands on k documents a query at most.
    """
    spark, made, count = of.made.sparkSession, of.made, of.count
    at, kind = scratch(spark), dict(queries.dtypes)["item_id"]

    def terms(batches):
        for b in text_batches(batches):
            found = [sorted({w for block in word_blocks(t) for w in block}) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(found, pa.list_(pa.binary())), pa.array(map(len, found), pa.int64())], ["item_id", "terms", "n"])

    rows = queries.select("item_id", F.col("text").cast("string")).mapInArrow(terms, f"item_id {kind}, terms array<binary>, n long").where("n > 0")
    rows = positions(keep(rows, f"{at}/queries"), ["item_id"], f"{at}/dealt", {"before": "n"})
    rows = keep(rows.select("item_id", "terms", F.expr(f"before div {block_terms}").alias("block")), f"{at}/blocks")
    out = None
    for (block,) in rows.select("block").distinct().orderBy("block").collect():  # a row for each pass
        own = rows.where(F.col("block") == block).orderBy("item_id").collect()  # block_terms terms and one query at most
        vocabulary: dict[bytes, int] = {}
        asked = [np.array([vocabulary.setdefault(bytes(w), len(vocabulary)) for w in r.terms], np.int64) for r in own]
        weight = weights(frequencies(made, vocabulary), count)
        sent = spark.sparkContext.broadcast((vocabulary, weight, asked))

        def run(batches, sent=sent):
            best = Best(len(sent.value[2]), k)
            for row in _rows(batches):
                look(Segment(row), *sent.value, best)
            for q, found in enumerate(best.rows):
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([q] * len(found), pa.int32()), pa.array([d for _, d in found], pa.int64()), pa.array([-s for s, _ in found], pa.int64())], ["q", "doc_id", "score"])

        first = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        found = made.mapInArrow(run, "q int, doc_id long, score long").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(q, r.item_id) for q, r in enumerate(own)], f"q int, item_id {kind}")
        found = found.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")
        found.write.mode("overwrite").parquet(f"{at}/found/block={block}")
        sent.destroy()
        out = f"{at}/found"
    form = f"item_id {kind}, rank int, doc_id long, score long"
    return spark.read.parquet(out).select("item_id", "rank", "doc_id", "score") if out else spark.createDataFrame([], form)


def rank(docs: DataFrame, queries: DataFrame, k: int = 50, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """search() of an index of docs that is built on the way."""
    return search(index(docs, scratch(docs.sparkSession) + "/index"), queries, k, block_terms)


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
g AS (SELECT count(*) AS n, sum(len(w)) AS l FROM d WHERE len(w) > 0),
m AS (SELECT r, doc_id, 50 + (50 * len(w)::HUGEINT * n) // l AS m FROM d, g WHERE len(w) > 0),
p AS (SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(w) AS w FROM d) GROUP BY ALL),
f AS (SELECT w, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight FROM (SELECT w, count(*) AS df FROM p GROUP BY w), g),
q AS (SELECT DISTINCT i, item_id, unnest(w) AS w FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS w FROM benchmark)),
s AS (SELECT i, item_id, r, m.doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN f USING (w) JOIN p USING (w) JOIN m USING (r) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST, r)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50"""
