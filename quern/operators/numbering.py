"""Numbers of rows in an order, of a whole table or of each key, without a task that gets a table or a key whole."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """df written to spark.checkpoint.dir and read from there, so that its rows and partitions stay what they are.

    Where that setting is unset in local mode a temporary folder takes its place; on a cluster it has to be set.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + (own := tempfile.mkdtemp(prefix="quern-"))
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(base)
    return df.checkpoint()


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "n") -> DataFrame:
    """Adds `name`, from 0: the number of the row among those of its keys (of all rows without keys), in order.

    Rows are dealt to ranges of keys and order, so one key on very many rows is many tasks' work.  What has to be known of
    other ranges is how many rows of a range's first key lie in those before it: one number a range at most.  Rows that
    are alike in keys and order are numbered in the table's order.
    """
    taken = set(df.columns)
    tie, part, before = (next(x + "_" * k for k in range(9) if x + "_" * k not in taken) for x in ("tie", "part", "before"))
    rows = settled(df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys, *order, tie).withColumn(part, F.spark_partition_id()))
    counts = rows.groupBy(part, *keys).agg(F.count("*").alias(before))
    earlier = F.sum(before).over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    names = {k: f"{k}_{before}" for k in keys}
    carried = counts.withColumn(before, earlier).where(F.col(before) > 0).select(F.col(part).alias(f"{part}_{before}"), before, *[F.col(k).alias(n) for k, n in names.items()])
    same = F.col(part) == F.col(f"{part}_{before}")
    for k, n in names.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    inside = F.row_number().over(Window.partitionBy(part, *keys).orderBy(*order, tie)) - 1
    found = rows.withColumn(name, inside).join(F.broadcast(carried), same, "left")  # a row a range at most
    return found.withColumn(name, F.col(name) + F.coalesce(before, F.lit(0))).select(*df.columns, name)
