"""The registered queries of this package: thin, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hamming, huffman, importance, jaccard_join, language_model, lexical, line_dedup, packing, quality, sharding, toxicity, url_filters
from .shared import held_out, keep, scratch

#: File of the tokenizer that op4 uses, by its name in the public_tokenizers package.
TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.fit_and_score(table(spark, sf_dir, "documents"), held_out(7, 2), least=1)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out(4, 2))
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.word_lengths(table(spark, sf_dir, "documents")))


def op4_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return huffman.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end=2)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.removals(table(spark, sf_dir, "documents"), words=1)
    each = found.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return each.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out(3, 1))
    return toxicity.score(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies", "n_shingles")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = keep(hamming.sign_codes(table(spark, sf_dir, "embeddings")), scratch(spark) + "/codes")
    return hamming.top_k(codes, codes.where("vec_id % 50 = 0"), k=10)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.place(table(spark, sf_dir, "documents"), shards=16)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict:
    ops = (op1_ngram_lm, op2_quality, op3_packing, op4_huffman_ids, op5_line_dedup, op6_toxicity, op7_jaccard_join, op8_decontaminate, op9_hamming_topk, op10_url_filters, op11_lexical_search, op12_importance, op13_sharding)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {
        "op8_decontaminate": decontaminate.ORACLE, "op9_hamming_topk": hamming.ORACLE, "op10_url_filters": url_filters.oracle(),
        "op11_lexical_search": lexical.ORACLE, "op12_importance": importance.oracle(), "op13_sharding": sharding.oracle(),
    }
