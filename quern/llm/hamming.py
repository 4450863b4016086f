"""Exact k nearest neighbours of binary codes by incremental multi-index hashing.

Codes are cut into segments; each shard of codes keeps, for each segment, its distinct codes sorted by the segment's
value; segments are about as wide as the logarithm of the shard's codes.  A query looks up all values within Hamming
distance r of its own segment, segment by segment, r growing from 0.  Once j + 1 of m segments were searched at r (and the
others at r - 1), every code within m * r + j bits has been seen, so the search ends as soon as the k-th verified distance
is no more than that: ties at the k-th distance have then all been seen too.

Equal codes are held once with the k + 1 smallest ids that have them, all that a list of k can need: a vector that a
third of the rows share is one code.  Queries go round in blocks of a fixed size, shards give k rows a query at most,
and the best of the shards' rows are the result.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import keep, scratch

#: Queries that go to the executors at once: 16 bytes each, so 1 MB.
BLOCK = 65_536
#: Distinct codes to a shard, on average.
SHARD = 2_000_000
#: Bits of the narrowest and of the widest segments.
NARROW, WIDE = 8, 16


def sign_codes(vectors: DataFrame, bits: int = 64) -> DataFrame:
    """vec_id and code: bit i is set where element i is over 0, for the first 64 elements (null, NaN, missing: not set)."""
    bit = f"transform(sequence(0, {bits - 1}), i -> if(coalesce(try_element_at(embedding, i + 1), 0) > 0 and not isnan(coalesce(try_element_at(embedding, i + 1), 0)), shiftleft(1L, i), 0L))"
    return vectors.select("vec_id", F.expr(f"aggregate({bit}, 0L, (a, b) -> a | b)").alias("code"))


def width_for(codes: int) -> int:
    """Bits of a segment, so that a value has a code or so: the logarithm of the codes, within NARROW and WIDE, that parts 64 bits best."""
    return min(WIDE, max(NARROW, max(1, codes).bit_length() - 1))


@cache
def flips(width: int, r: int) -> np.ndarray:
    """All masks of `width` bits with r bits set."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(width), r)], np.int64)


class Shard:
    """The index over one shard's distinct codes."""

    def __init__(self, codes: np.ndarray, width: int | None = None):
        self.codes, self.m = codes, -(-64 // (width or width_for(len(codes))))
        cuts = [64 * j // self.m for j in range(self.m + 1)]  # all bits, in segments that are alike or differ by one
        self.at, self.widths = cuts[:-1], [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
        self.by, self.verified = [], 0
        for j in range(self.m):
            values = self.segment(codes, j)
            order = np.argsort(values, kind="stable")
            self.by.append((order, np.searchsorted(values[order], np.arange((1 << self.widths[j]) + 1))))

    def segment(self, codes: np.ndarray, j: int) -> np.ndarray:
        return ((codes >> np.uint64(self.at[j])) & np.uint64((1 << self.widths[j]) - 1)).astype(np.int64)

    def search(self, query: int, k: int, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (their positions) and distances, enough to hold every row at or below the k-th distance; count: rows of each code."""
        own = [int(query >> at) & ((1 << width) - 1) for at, width in zip(self.at, self.widths, strict=True)]
        seen, d, known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self.codes), bool)
        for r, j in product(range(max(self.widths) + 1), range(self.m)):
            v = own[j] ^ flips(self.widths[j], r)
            order, starts = self.by[j]
            lo, hi = starts[v], starts[v + 1]
            n = hi - lo
            if total := int(n.sum()):
                new = order[np.repeat(hi - np.cumsum(n), n) + np.arange(total)]
                new = np.unique(new[~known[new]])
                known[new] = True
                seen = np.concatenate([seen, new])
                d = np.concatenate([d, np.bitwise_count(self.codes[new] ^ np.uint64(query)).astype(np.int64)])
            reach = self.m * r + j  # a code further off than that by all segments' radii together may still be unseen
            if int(count[seen[d <= reach]].sum()) >= k or len(seen) == len(self.codes):
                break
        self.verified += len(seen)
        if len(seen):
            order = np.argsort(d, kind="stable")
            enough = int(np.searchsorted(np.cumsum(count[seen[order]]), k))
            last = d[order[min(enough, len(order) - 1)]]
            keep = d <= last
            seen, d = seen[keep], d[keep]
        return seen, d


def _searcher(sent, k: int):
    def search(pdf):
        pdf = pdf.sort_values("code", ignore_index=True)
        index = Shard(pdf["code"].to_numpy(np.int64).view(np.uint64))
        ids = [np.asarray(x, np.int64) for x in pdf["ids"]]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        cols = ([], [], [])
        for own, code in zip(*sent.value, strict=True):
            at, d = index.search(int(code), k + 1, count)
            found = np.concatenate([ids[i] for i in at]) if len(at) else np.zeros(0, np.int64)
            far = np.repeat(d, count[at])
            found, far = found[found != own], far[found != own]
            best = np.lexsort((found, far))[:k]
            for c, v in zip(cols, (np.full(len(best), own), found[best], far[best]), strict=True):
                c.append(v)
        return pd.DataFrame({n: np.concatenate(c) if c else [] for n, c in zip(("query_id", "vec_id", "distance"), cols, strict=True)})

    return search


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """For each query (vec_id, code) the k rows of codes (vec_id, code) of least Hamming distance: query_id, rank, vec_id, distance.

    Equal distances go by vec_id; a row is no neighbour of its own id.  Null ids and codes are left out, repeated ids
    with equal codes count once, ids with several codes count once a code, fewer than k rows give fewer, empty tables
    give none.
    """
    spark = codes.sparkSession
    rows = codes.select("vec_id", "code").dropna().distinct()
    # map-side: each task hands on k + 1 ids of a code at most
    part = rows.groupBy("code", F.spark_partition_id().alias("p")).agg(F.expr(f"slice(sort_array(collect_list(vec_id)), 1, {k + 1})").alias("ids"))
    held = part.groupBy("code").agg(F.expr(f"slice(sort_array(flatten(collect_list(ids))), 1, {k + 1})").alias("ids"))
    shards = max(1, -(-codes.select(F.approx_count_distinct("code")).first()[0] // shard))
    held = held.withColumn("s", F.pmod(F.xxhash64("code"), F.lit(shards)))
    asked = queries.select("vec_id", "code").dropna().distinct()
    n = asked.count()
    blocks = max(1, -(-n // block))
    asked = asked.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    at, form = scratch(spark), "query_id long, vec_id long, distance int"
    held = keep(held, f"{at}/codes")
    for b in range(blocks):  # one block of queries is out at a time
        q = asked.where(F.col("b") == b).toPandas()
        sent = spark.sparkContext.broadcast((q["vec_id"].to_numpy(np.int64), q["code"].to_numpy(np.int64).view(np.uint64)))
        near = held.groupBy("s").applyInPandas(_searcher(sent, k), form)
        near.write.mode("overwrite").parquet(f"{at}/near/block={b}")
        sent.destroy()
    out = spark.read.parquet(f"{at}/near").select("query_id", "vec_id", "distance")
    best = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


ORACLE = """WITH c AS (SELECT vec_id, list_reduce(list_transform(range(64), lambda i: CASE WHEN i < len(embedding) AND coalesce(embedding[i + 1], 0) > 0 AND NOT isnan(embedding[i + 1]) THEN 1::UHUGEINT << i::UHUGEINT ELSE 0::UHUGEINT END), lambda a, b: a | b)::UBIGINT AS code FROM embeddings),
d AS (SELECT DISTINCT q.vec_id AS query_id, c.vec_id, bit_count(xor(q.code, c.code))::INTEGER AS distance FROM c q JOIN c ON q.vec_id != c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank FROM d)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10"""
