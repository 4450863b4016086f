"""Importance resampling towards a target: hashed n-gram features, gains of buckets, Gumbel top-k.

Features are the runs of 1 to n words; a run's bucket comes from the CRC-32 of its bytes.  One scan over a text keeps a
ring of running zlib states, one for each of the last n starts: a word extends each of them by a space and itself and
begins one more, and every state is a feature.  No n-gram is built as a string.  One scan of both tables adds up the
buckets' counts (a table of fixed size), a second one weighs each text by the gains of its buckets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import _WORD_TABLE, keep, scratch, text_batches
from .sharding import crc_table, positions

BUCKETS, RUNS, LEAST_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7
#: Bytes of a text that are taken apart at a time.
SLICE = 1 << 20


def word_blocks(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text (A-Z lower-cased, runs of letters, digits and all beyond ASCII), some at a time."""
    raw = text.encode("utf-8", "surrogatepass").translate(_WORD_TABLE) if text else b""
    at = 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= SLICE else raw.find(b" ", at + SLICE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def states(text: str | None, runs: int = RUNS) -> tuple[np.ndarray, int]:
    """The CRC-32 of every run of 1 to `runs` words, repeats and all, and the number of words."""
    crc, out, ring, count = zlib.crc32, [], [], 0
    for words in word_blocks(text):
        count += len(words)
        found: list[int] = []
        emit = found.append
        for word in words:
            if ring:
                longer = b" " + word
                for i, state in enumerate(ring):
                    ring[i] = state = crc(longer, state)
                    emit(state)
            state = crc(word)
            emit(state)
            ring.append(state)
            if len(ring) == runs:
                del ring[0]
        out.append(np.array(found, np.uint32))
    return (np.concatenate(out) if out else np.zeros(0, np.uint32)), count


def bucket_counts(texts: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n, the features of all texts in it; buckets without any are left out."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in text_batches(batches):
            for text in b.column("text").to_pylist():
                total += np.bincount(states(text, runs)[0] % buckets, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    return texts.select(F.col("text").cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """A number for each bucket: how much likelier it is in the target, in thousandths of a natural logarithm, smoothed by one."""
    source = bucket_counts(docs, runs, buckets).withColumnRenamed("n", "s")
    wanted = bucket_counts(target, runs, buckets).withColumnRenamed("n", "t")
    each = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(source, "bucket", "left").join(wanted, "bucket", "left").fillna(0)
    got = each.select("bucket", "s", "t").toPandas().sort_values("bucket")  # `buckets` rows
    s, t = got["s"].to_numpy(np.float64), got["t"].to_numpy(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, runs: int = RUNS) -> DataFrame:
    """doc_id, n_words, n_features and weight (the floored mean of the features' gains; 0 without any) for each row of docs."""
    sent, kind = docs.sparkSession.sparkContext.broadcast(gain), dict(docs.dtypes)["doc_id"]  # a number a bucket

    def run(batches):
        own = sent.value
        for b in text_batches(batches):
            rows = []
            for text in b.column("text").to_pylist():
                found, words = states(text, runs)
                rows.append((words, len(found), int(own[found % len(own)].sum()) // len(found) if len(found) else 0))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(seed: int = SEED):
    """Thousandths of a Gumbel variate that the id alone decides."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, runs: int = RUNS, buckets: int = BUCKETS, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank for each row of docs (doc_id, text); target has a column text.

    rank: 1, 2, ... for the drawn rows, the highest scores among those of at least `least` words, `percent` hundredths of
    them (floored); null for the others.  Equal scores go by ascending doc_id, null ids first, repeated rows by their
    place in the table; each repeated row is a document.  Null and empty texts have no features, weight 0 and no rank.
    A null id's score is that of an empty id.  Empty tables give an empty result, or gains of counts of 0; other columns
    are ignored.  Counts are of all rows of both tables.
    """
    at = scratch(docs.sparkSession)
    rows = weigh(docs, gains(docs, target, runs, buckets), runs).withColumn("score", F.col("weight") + gumbel(seed))
    rows = rows.withColumns({"able": (F.col("n_words") >= least).cast("long"), "last": F.when(F.col("n_words") >= least, -F.col("score")).otherwise(F.lit(2**62))})
    rows = keep(rows, f"{at}/scored")  # the range partitioning below reads its rows twice
    ranked = positions(rows, ["last", "doc_id"], f"{at}/ranked", {"before": "able"})
    drawn = (F.col("able") == 1) & (F.col("before") < F.expr(f"(before_all * {percent}) div 100"))
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", F.when(drawn, F.col("before") + 1).cast("long").alias("rank"))


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, **how) -> DataFrame:
    """The drawn rows of docs, with all their columns, once for each id that was drawn; ids are taken to be of one row each."""
    drawn = resample(docs, target, percent, **how).where("rank is not null").select("doc_id").distinct()
    return docs.join(drawn, "doc_id", "left_semi")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: Buckets come from the CRC-32 of each distinct feature, by a table of 256 numbers that SQL makes itself.
ORACLE = """WITH t AS (SELECT {table} AS t),
w AS (SELECT 0 AS of, row_number() OVER () AS r, doc_id, {words} AS w FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, {words} FROM benchmark),
f AS (SELECT of, r, unnest(w || list_transform(range(1, greatest(len(w), 1)), lambda k: w[k] || ' ' || w[k + 1])) AS g FROM w),
c AS (SELECT of, r, g, count(*) AS n FROM f GROUP BY ALL),
b AS (SELECT g, xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(g)), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) % 10000 AS b FROM (SELECT DISTINCT g FROM c), t),
k AS (SELECT of, r, b, sum(n)::BIGINT AS n FROM c JOIN b USING (g) GROUP BY ALL),
s AS (SELECT b, coalesce(sum(n) FILTER (of = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (of = 1), 0)::DOUBLE AS t FROM k GROUP BY b),
a AS (SELECT b, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM s) + 10000) / ((s + 1) * ((SELECT sum(t) FROM s) + 10000))))::BIGINT AS gain FROM s),
d AS (SELECT r, sum(n)::BIGINT AS n, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM k JOIN a USING (b) WHERE of = 0 GROUP BY r),
e AS (SELECT doc_id, r, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, CAST('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN d USING (r) WHERE of = 0),
g AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS FIRST, r) AS k, count(*) FILTER (words >= 20) OVER () AS n FROM g)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND k <= 25 * n // 100 THEN k END AS rank FROM o"""


def oracle() -> str:
    return ORACLE.format(table=crc_table(), words=_WORDS)
