"""The corpus pipeline: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontaminate, jaccard_join, line_dedup, packing, toxicity
from quern.llm.shared import held_out, keep, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.7 or more go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out(3, 1))
    return toxicity.clean(docs, model, 0.7)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines like an earlier line go, and documents of which no line is left."""
    return line_dedup.clean(docs, words=1)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return jaccard_join.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' tokens in sequences of the permitted lengths."""
    return packing.pack(packing.word_lengths(docs))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("ngram_jaccard_join", drop_near_copies), ("decontamination", drop_leaks), ("best_fit_packing", pack_documents)]

#: SQL can express neither the trained classifier nor the packing; tests hold each stage, on its own input, against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet in the shared scratch folder and read again.

    Null and empty texts pass all stages and are packed as their end token.  Rows that repeat id and text are one document
    from the third stage on; null ids are ids like any other.  Other columns, whatever their names, go along up to the
    packing, which returns doc_id, piece, n_tokens, shard, bin, bin_size and bin_offset.  Without labels no document
    counts as toxic, without a benchmark none as leaked, and empty documents give no rows.
    """
    at, docs = scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = keep(stage(spark, docs, sf_dir), f"{at}/{k}-{name}")
    return docs
