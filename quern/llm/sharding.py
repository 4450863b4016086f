"""Contiguous shards of nearly equal bytes, by global prefix sums of the documents' sizes.

Rows are dealt to ranges of doc_id once; each range's total of bytes and rows, added up over the ranges before it, gives
where the range begins, and a running sum within the range gives where each row begins.  A row belongs to the shard in
whose equal part of all bytes its middle lies.  Only ids, sizes and checksums move, unless the texts are asked for.
Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop, fresh, keep, scratch


def positions(rows: DataFrame, order: list[str], path: str, sums: dict[str, str]) -> DataFrame:
    """The rows with the sums of some columns over all rows before them in the order of the named columns.

    sums: name of the sum to the column it adds up; `<name>_all` has the sum over all rows.  Rows that are alike in `order`
    follow one another in the table's order.  The rows are dealt to ranges and written to `path`, so a range is the same
    to whoever reads it later, also after a lost executor.  One value on very many rows is spread over ranges, as the
    place in the table is part of the order.
    """
    tie, part = fresh(rows.columns, "tie", "part")
    dealt = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*order, tie).withColumn(part, F.spark_partition_id())
    dealt = keep(dealt, path)
    totals = dealt.groupBy(part).agg(*[F.sum(c).alias(n) for n, c in sums.items()])  # a row for each range
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    begin = totals.select(F.col(part), *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_part") for n in sums], *[F.sum(n).over(every).alias(f"{n}_all") for n in sums])
    inside = Window.partitionBy(part).orderBy(*order, tie).rowsBetween(Window.unboundedPreceding, -1)
    found = dealt.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(n) for n, c in sums.items()])
    found = found.join(F.broadcast(begin), part)
    return found.withColumns({n: F.col(n) + F.col(f"{n}_part") for n in sums}).drop(part, tie, *[f"{n}_part" for n in sums])


def place(docs: DataFrame, shards: int = 16, carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for each row of docs (doc_id, text); with carry, all columns of docs as well.

    A row's size is its text's bytes in UTF-8 (none for null) and one.  Rows go by ascending doc_id, null ids first;
    rows of one id follow in the order of the table.  shard: the part of all bytes, of `shards` equal ones, in which the
    middle of the row lies, so a shard's bytes differ from an equal share by at most the halves of two rows, and a row
    larger than a share stays whole.  slot: the row's place in its shard from 0.  An empty table gives an empty one;
    fewer rows than shards leave shards empty; repeated rows are placed each.  Own names that docs has too get a `_`
    where its columns are carried along, and are no matter otherwise.
    """
    at = scratch(docs.sparkSession)
    size, crc, shard, slot = fresh(docs.columns if carry else [], "size", "text_crc32", "shard", "slot")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*(docs.columns if carry else ["doc_id"]), (F.octet_length(text) + 1).cast("long").alias(size), F.crc32(text.cast("binary")).alias(crc))
    begin, number, one = fresh(rows.columns, "begin_", "number_", "one_")
    rows = positions(rows.withColumn(one, F.lit(1).cast("long")), ["doc_id"], f"{at}/rows", {begin: size, number: one})
    # twice the middle, in decimals: sums of 100 TB times the shards pass the longs
    share = F.expr(f"(cast(`{begin}` * 2 + `{size}` as decimal(24,0)) * {shards}) div cast(`{begin}_all` * 2 as decimal(24,0))")
    rows = rows.withColumn(shard, F.least(share.cast("int"), F.lit(shards - 1)))
    rows = keep(rows.drop(begin, f"{begin}_all", f"{number}_all", one), f"{at}/placed")
    drop(docs.sparkSession, f"{at}/rows")
    first = rows.groupBy(F.col(shard).alias(begin)).agg(F.min(number).alias(one))  # a row for each shard
    rows = rows.join(F.broadcast(first), F.col(shard) == F.col(begin))
    return rows.withColumn(slot, F.col(number) - F.col(one)).drop(begin, number, one)


def write(docs: DataFrame, folder: str, shards: int = 16) -> DataFrame:
    """Writes docs with all their columns as Parquet, a folder `shard=N` each, ordered by slot within a file; returns them as read."""
    rows = place(docs, shards, carry=True)
    shard, slot = [c for c in rows.columns if c not in docs.columns][-2:]
    rows.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(folder)
    return docs.sparkSession.read.parquet(folder)


#: CRC-32 of the texts' bytes by a table of 256 numbers that SQL makes itself.
ORACLE = """WITH t AS (SELECT {table} AS t),
d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size FROM documents),
c AS (SELECT r, xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) AS crc FROM d, t),
s AS (SELECT *, 2 * sum(size) OVER (ORDER BY doc_id NULLS FIRST, r) - size AS middle, 2 * sum(size) OVER () AS whole FROM d),
p AS (SELECT *, least((middle * 16)::HUGEINT // whole::HUGEINT, 15)::INTEGER AS shard FROM s)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, r) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p JOIN c USING (r)"""


def crc_table() -> str:
    """SQL of the 256 numbers of CRC-32."""
    table = "range(0, 256)"
    for _ in range(8):
        table = f"list_transform({table}, lambda c: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)"
    return table


def oracle() -> str:
    return ORACLE.format(table=crc_table())
