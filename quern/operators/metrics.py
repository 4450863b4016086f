"""Training and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _share(hits, n):
    return F.when(n > 0, hits / n).otherwise(F.lit(float("nan")))


def masked_accuracy(df: DataFrame, predicted: str, target: str, ignore: int = -100) -> DataFrame:
    """The share of targets that are predicted, of those that are not to be ignored; NaN where there is none."""
    counts = F.col(target) != ignore
    return df.agg(_share(F.sum((counts & (F.col(predicted) == F.col(target))).cast("double")), F.sum(counts.cast("long"))).alias("accuracy"))


def next_token_accuracy(df: DataFrame, predicted: str, labels: str, ignore: int = -100) -> DataFrame:
    """The same over arrays, where each prediction is for the label after its place."""
    n = F.size(labels)
    both = F.zip_with(F.slice(predicted, 1, F.greatest(n - 1, F.lit(0))), F.slice(labels, 2, F.greatest(n - 1, F.lit(0))), lambda p, t: F.struct((t != ignore).alias("counts"), ((t != ignore) & (p == t)).alias("hit")))
    each = df.select(F.explode(both).alias("e")).select("e.*")
    return each.agg(_share(F.sum(F.col("hit").cast("double")), F.sum(F.col("counts").cast("long"))).alias("accuracy"))


def epoch_means(df: DataFrame, epoch: str, loss: str) -> DataFrame:
    return df.groupBy(epoch).agg(F.avg(loss).alias("mean_loss"), F.exp(F.avg(loss)).alias("perplexity"))


def eval_mean(df: DataFrame, loss: str, compat: bool = False) -> DataFrame:
    """The mean; compat divides by one more than there are."""
    return df.agg((F.sum(loss) / (F.count(loss) + (1 if compat else 0))).alias("mean_loss"))


def running_mean(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running_mean", F.avg(value).over(w))


def best_so_far(df: DataFrame, key: str, order: list[str], loss: str, acc: str) -> DataFrame:
    """Adds save: the loss is below, or the accuracy above, all before."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    low, high = F.coalesce(F.min(loss).over(w), F.lit(float("inf"))), F.coalesce(F.max(acc).over(w), F.lit(0.0))
    return df.withColumn("save", (F.col(loss) < low) | (F.col(acc) > high))


def run_averages(df: DataFrame, values: list[str]) -> DataFrame:
    """The mean of each column over all epochs; 0 where there is none."""
    return df.agg(*[F.coalesce(F.avg(v), F.lit(0.0)).alias(v) for v in values])
