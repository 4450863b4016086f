"""Best-fit packing into sequences of several permitted lengths.

Texts are cut into pieces of at most the largest length; pieces go, longest first, into the open bin with the least
room that holds them.  Where none does, a bin opens whose size is chosen by cost: of the permitted sizes that hold the
piece, the one whose expected cost per token is least, given how much of the shard's remaining tokens are in pieces
short enough to fill it.  When all pieces are placed, every bin shrinks to the smallest permitted size that holds its
contents.  All lengths are small integers, so a shard is packed by counting: bins by room, pieces by length.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep, scratch, space_words, text_batches

CAPACITIES = (512, 1024, 2048, 4096)
#: What a bin costs beside its tokens, in tokens (the overhead of one more sequence).
OVERHEAD = 16
#: Pieces to a shard, on average.  Each shard leaves a few bins unfilled at most.
SHARD = 50_000


def opened(length: int, shorter: np.ndarray, capacities, overhead: int) -> int:
    """The bin size to open for a piece, the longest of those left; shorter[n]: tokens in pieces left of up to n.

    Opening size c costs c + overhead and is expected to hold the piece and what the rest can still put into its room.
    """
    best = None
    for c in capacities:
        if c >= length:
            filled = length + min(c - length, int(shorter[min(c - length, len(shorter) - 1)]))
            key = ((c + overhead) / filled, c)
            if best is None or key < best[0]:
                best = (key, c)
    return best[1]


def best_fit(lengths: np.ndarray, capacities=CAPACITIES, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each piece its bin and its offset in the bin; for each bin its final size.  Pieces are as long as the largest size at most."""
    capacities = sorted(capacities)
    most = capacities[-1]
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    tokens = np.bincount(lengths, minlength=most + 1).astype(np.int64) * np.arange(most + 1)
    shorter = np.cumsum(tokens)
    bins = np.zeros(len(lengths), np.int64)
    at = np.zeros(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(most + 1)]  # open bins by room, first opened first
    mask, used = 0, []  # the bits of mask: rooms that some bin has
    for left, i in enumerate(order.tolist()):
        n = int(lengths[i])
        shorter[n:] -= n
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = heapq.heappop(rooms[room])
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            room, b = opened(n, shorter, capacities, overhead), len(used)
            used.append(0)
        bins[i], at[i] = b, used[b]
        used[b] += n
        if room > n:
            heapq.heappush(rooms[room - n], b)
            mask |= 1 << (room - n)
    sizes = np.asarray(capacities)[np.searchsorted(capacities, np.asarray(used, np.int64))] if used else np.zeros(0, np.int64)
    return bins, at, sizes


def pack(lengths: DataFrame, capacities=CAPACITIES, overhead: int = OVERHEAD, shard: int = SHARD) -> DataFrame:
    """Packs rows of (doc_id, n_tokens); other columns are ignored.

    Returns a row for each piece: doc_id, piece (0, 1, ... in the text), n_tokens, shard and bin (together the
    sequence's name), bin_size, bin_offset.  A text longer than the largest size gives pieces of that size and a rest,
    so no token is lost.  Null or non-positive lengths give no piece, repeated rows are packed each, null ids like any
    other, an empty table gives an empty one.  Pieces of one text are spread over shards by hash, so that neither many
    rows of one id nor one huge text meet in one task.
    """
    most = max(capacities)
    rows = lengths.select("doc_id", F.col("n_tokens").cast("long").alias("n")).where("n > 0")
    rows = keep(rows, scratch(lengths.sparkSession) + "/lengths")
    whole = F.expr(f"cast((n + {most - 1}) div {most} as int)")
    pieces = rows.select("doc_id", "n", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece"))
    pieces = pieces.select("doc_id", "piece", F.least(F.lit(most), F.col("n") - F.col("piece").cast("long") * most).cast("int").alias("n_tokens"))
    count = rows.agg(F.sum(whole)).first()[0] or 0
    shards = max(1, -(-int(count) // shard))

    def packed(batch):
        d = batch.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        bins, at, sizes = best_fit(d["n_tokens"].to_numpy(np.int64), capacities, overhead)
        return d.assign(bin=bins, bin_size=sizes[bins].astype(np.int32), bin_offset=at.astype(np.int32))[["doc_id", "piece", "n_tokens", "shard", "bin", "bin_size", "bin_offset"]]

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))
    kind = dict(lengths.dtypes)["doc_id"]
    return dealt.groupBy("shard").applyInPandas(packed, f"doc_id {kind}, piece int, n_tokens int, shard int, bin long, bin_size int, bin_offset int")


def word_lengths(docs: DataFrame) -> DataFrame:
    """doc_id and the number of white-space words of the text and one end token; a null text has its end token alone."""
    import pyarrow as pa

    kind = dict(docs.dtypes)["doc_id"]

    def count(batches):
        for b in text_batches(batches):
            n = [1 + len(space_words(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(count, f"doc_id {kind}, n_tokens long")
