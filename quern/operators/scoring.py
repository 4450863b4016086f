"""Error rates of hypotheses against references."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import cluster_of, columns
from .align import PAIRS, align_counts, counted, counts_of, edit_distance, pairs_of, steps, tallied


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the last."""
    name = "_n"
    while name in df.columns:
        name += "_"
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    return df.withColumn(name, n).where(F.col(name) == 1).drop(name)


def pairs(ref: DataFrame, hyp: DataFrame, order: str) -> DataFrame:
    """id, ref, hyp for ids that both sides have; references without a hypothesis are not scored."""
    return ref.select("id", F.col("tokens").alias("ref")).join(last_wins(hyp, "id", order).select("id", F.col("tokens").alias("hyp")), "id")


def rate(errors, n):
    return F.when(n > 0, 100.0 * errors / n).otherwise(0.0)


def per_pair(both: DataFrame) -> DataFrame:
    return both.select("id", align_counts("ref", "hyp").alias("a")).select("id", "a.*").withColumn("wer", rate(F.col("s") + F.col("d") + F.col("i"), F.col("n")))


def overall(both: DataFrame) -> DataFrame:
    sums = per_pair(both).agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("n", "c", "s", "d", "i")])
    return sums.withColumn("wer", rate(F.col("s") + F.col("d") + F.col("i"), F.col("n")))


def token_counts(both: DataFrame) -> DataFrame:
    """Counts by token: substitutions and deletions go to the reference's token, insertions to the hypothesis's."""
    each = both.select("ref", "hyp").mapInArrow(tallied, "token string, n long, c long, s long, d long, i long")
    return each.groupBy("token").agg(*[F.sum(x).alias(x) for x in "ncsdi"])


def by_cluster(both: DataFrame) -> DataFrame:
    """token_counts by kind of token (by the names of its characters), with the total in the row of null."""
    return token_counts(both).withColumn("cluster", cluster_of("token")).rollup("cluster").agg(*[F.sum(x).alias(x) for x in "ncsdi"])


def by_clusters(both: DataFrame, clusters: DataFrame) -> DataFrame:
    """token_counts summed by the clusters (cluster, word) that name a token; tokens of no cluster are left out."""
    return token_counts(both).join(clusters.withColumnRenamed("word", "token"), "token").groupBy("cluster").agg(*[F.sum(x).alias(x) for x in "ncsdi"])


def errors(both: DataFrame) -> DataFrame:
    """id, n (tokens of the reference), errors (least edits) and wer for each pair."""
    n, e = F.size("ref"), edit_distance("ref", "hyp")
    return both.select("id", n.alias("n"), e.alias("errors")).withColumn("wer", rate(F.col("errors"), F.col("n")))


#: How lines of the report look.
PAIR, WHOLE, KIND, COUNTED = "WER: %s %%", "Overall -> %s %%", "%s -> %s %%", " N=%d C=%d S=%d D=%d I=%d"
RATE, RULE = "%4.2f", "=" * 75


@F.pandas_udf(T.StringType())
def shown(rates: pd.Series) -> pd.Series:
    """Rates to two places, rounded by their exact values (a format of the JVM's would round their decimal digits)."""
    return rates.map(lambda x: RATE % x)


def _counted(form: str, *first):
    """A line of the report from columns wer, n, c, s, d and i."""
    return F.format_string(form + COUNTED, *first, shown("wer"), *[F.col(x).cast("long") for x in "ncsdi"])


def wrapped(steps: list[tuple[str, str]], words: int | None = None, padding: str = " ") -> list[str]:
    """Lines of an alignment: lab with the reference's tokens, rec with the hypothesis's below them, and an empty one, again and again.

    Both tokens of a pair take the wider one's columns (two for wide and ambiguous characters of East Asia), filled up
    with `padding`; at most `words` pairs stand in a line.
    """
    out, words = [], words or max(1, len(steps))
    for i in range(0, len(steps), words):
        part = [(r, h, columns(r), columns(h)) for r, h in steps[i : i + words]]
        for name, k in (("lab", 0), ("rec", 1)):
            out.append(f"{name}: " + "".join(p[k] + padding * (max(p[2], p[3]) - p[2 + k]) + " " for p in part))
        out.append("")
    return out


def report(both: DataFrame, aligned: bool = False, words: int | None = None, padding: str = " ", clusters: DataFrame | None = None) -> DataFrame:
    """Lines of the text report in order: each pair's in order of ids, the whole's, those of the kinds of tokens, and of `clusters` (cluster, word).

    With aligned, a pair's line stands below its id and above its alignment, as wrapped() has it, and rules stand around
    the sums.
    """
    rated = lambda d: d.withColumn("wer", rate(F.col("s") + F.col("d") + F.col("i"), F.col("n")))
    row = lambda part, key, lines: (F.lit(part).alias("part"), key.alias("id"), lines.alias("lines"))
    one = lambda part, key, line: row(part, key, F.array(line))
    if aligned:

        @F.arrow_udf(", ".join(f"{x} int" for x in "ncsdi") + ", shown array<string>")
        def laid_out(ref: pa.Array, hyp: pa.Array) -> pa.Array:
            rows, lines = [], []
            for i in range(0, len(ref), PAIRS):
                each = [steps(r, h) for r, h in pairs_of(ref.slice(i, PAIRS), hyp.slice(i, PAIRS))]
                rows += [counts_of(x) for x in each]
                lines.append(pa.array([wrapped(x, words, padding) for x in each], pa.list_(pa.string())))
            lines = pa.concat_arrays(lines) if lines else pa.array([], pa.list_(pa.string()))
            return pa.StructArray.from_arrays([*counted(rows), lines], [*"ncsdi", "shown"])

        counts = rated(both.select("id", laid_out("ref", "hyp").alias("a")).select("id", "a.*"))
        pair = counts.select(*row(0, F.col("id"), F.concat(F.array(F.lit(""), F.concat(F.lit("utt: "), "id"), _counted(PAIR)), "shown")))
    else:
        pair = per_pair(both).select(*one(0, F.col("id"), _counted(PAIR)))
    parts = [pair, overall(both).select(*one(2, F.lit(""), _counted(WHOLE)))]
    parts.append(rated(by_cluster(both).where("cluster is not null")).select(*one(3, F.col("cluster"), _counted(KIND, "cluster"))))
    if clusters is not None:
        parts.append(rated(by_clusters(both, clusters)).select(*one(4, F.col("cluster"), _counted(KIND, "cluster"))))
    if aligned:
        rules = both.sparkSession.createDataFrame([(1, "", [RULE, ""]), (5, "", ["", RULE])], "part int, id string, lines array<string>")
        parts.append(rules)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.orderBy("part", "id").select(F.explode("lines").alias("line"))
