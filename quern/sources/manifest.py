"""Manifests, prompts and transcripts as DataFrames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.numbering import numbered

MANIFEST = "key string, task string, target string, path string, GT string"


def manifest(spark: SparkSession, folder: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """multitask.jsonl of a split's folder; a malformed line fails the read."""
    schema = MANIFEST + "".join(f", {c} string" for c in extra)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{folder}/multitask.jsonl")


def split_folder(folders: dict[str, str], split: str) -> str:
    if split not in ("train", "val", "test"):
        raise ValueError(f"no such split: {split}")
    return folders[split]


def prompts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("task string, prompt string").json(path).groupBy("task").agg(F.sort_array(F.collect_list("prompt")).alias("prompts"))


def with_prompt(rows: DataFrame, prompts: DataFrame, style: str, seed: int = 0, append: tuple[str, ...] = ("hotword",)) -> DataFrame:
    """Adds prompt: one of the task's, chosen by hash of the key, in the style's slot.  A task without prompts fails.

    The prompt table has a row a task, so it is broadcast.
    """
    joined = rows.join(F.broadcast(prompts), "task", "left")
    found = F.coalesce(F.col("prompts"), F.raise_error(F.concat(F.lit("no prompt for task "), F.coalesce("task", F.lit("null")))))
    one = F.element_at(found, (F.pmod(F.xxhash64("key", F.lit(seed)), F.size("prompts")) + 1).cast("int"))
    for task in append:
        if task in rows.columns:
            one = F.when(F.col("task") == task, F.replace(one, F.lit("{}"), F.coalesce(F.col(task), F.lit("")))).otherwise(one)
    return joined.withColumn("prompt", F.replace(F.lit(style), F.lit("{}"), one)).drop("prompts")


def transcript(spark: SparkSession, path: str) -> DataFrame:
    """id and text of key-tab-text lines, blank ones left out; text has later tabs as they are."""
    parts = F.split("value", r"\t", 2)
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("id"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("text"))


def write_transcript(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws("\t", "id", F.replace("text", F.lit("\n"), F.lit(" ")))).write.mode("overwrite").text(path)


def shard(index: Column, workers: int, rank: int, world: int, worker: int) -> Column:
    return index % (workers * world) == rank * workers + worker


def labels(prompt: Column, target: Column, ignore: int = -100) -> Column:
    """Labels of prompt and target: the prompt's are ignored."""
    return F.concat(F.transform(prompt, lambda x: F.lit(ignore)), target)


def row_count(spark: SparkSession, folder: str) -> int:
    """Lines of a split's manifest, blank ones too."""
    return spark.read.text(f"{folder}/multitask.jsonl").count()


def _lines(spark: SparkSession, path: str, case_sensitive: bool) -> DataFrame:
    line = F.regexp_replace("value", r"^[ \t\r\n\x0b\x0c]+|[ \t\r\n\x0b\x0c]+$", "")
    return spark.read.text(path).select((line if case_sensitive else F.upper(line)).alias("line")).where("line != ''")


def ignored_words(spark: SparkSession, path: str, case_sensitive: bool = False) -> DataFrame:
    """word: one a line, blank lines left out, in upper case unless the case counts."""
    return _lines(spark, path, case_sensitive).select(F.col("line").alias("word")).distinct()


def split_words(spark: SparkSession, path: str, case_sensitive: bool = False) -> DataFrame:
    """word and parts of lines of a word and its parts; lines of one field are left out, of a word's lines the last counts."""
    parts = F.split("line", r"[ \t\r\n\x0b\x0c]+")
    rows = _lines(spark, path, case_sensitive).withColumn("at", F.struct(F.input_file_name(), F.input_file_block_start(), F.monotonically_increasing_id())).select(parts.alias("p"), "at").where("size(p) > 1")
    return rows.select(F.col("p")[0].alias("word"), F.expr("slice(p, 2, size(p) - 1)").alias("parts"), "at").groupBy("word").agg(F.max_by("parts", "at").alias("parts"))


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """cluster and word of a file of <Name> words </Name>, in whatever lines: the whole file is read as one text."""
    found = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<([^/>][^>]*)>(.*?)</\1>"), F.lit(0))).alias("x"))
    words = F.explode(F.split(F.regexp_extract("x", r"(?s)>(.*)<", 1), r"\s+"))
    return found.select(F.regexp_extract("x", "<([^>]*)>", 1).alias("cluster"), words.alias("word")).where("word != ''").distinct()


def vocabulary(words: DataFrame) -> DataFrame:
    """word and id (from 1 on, in order of the words; 0 is for words it lacks) of a table of words, numbered range by range."""
    distinct = words.select("word").where("word is not null").distinct()
    return numbered(distinct, [], ["word"], "id").withColumn("id", (F.col("id") + 1).cast("int"))


def encode(rows: DataFrame, key: str, tokens: str, words: DataFrame, end: int | None = None) -> DataFrame:
    """key and ids of its tokens by a vocabulary (word, id), 0 for words it lacks, with the end's id after them."""
    long = rows.select(key, F.posexplode_outer(tokens).alias("at", "word")).join(words, "word", "left")
    listed = F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", F.coalesce("id", F.lit(0)).alias("id")))))
    ids = F.transform(listed, lambda x: x.id)
    return long.groupBy(key).agg((ids if end is None else F.concat(ids, F.array(F.lit(end)))).alias("ids"))


def decode(rows: DataFrame, key: str, ids: str, words: DataFrame, pad: int = 0, ignore: int = -100) -> DataFrame:
    """key and text: the words of its ids in order, those that are ignored or padding left out."""
    long = rows.select(key, F.posexplode_outer(ids).alias("at", "id")).withColumn("id", F.when(F.col("id") == ignore, pad).otherwise(F.col("id"))).join(words, "id", "left")
    listed = F.sort_array(F.collect_list(F.when((F.col("id") != pad) & F.col("word").isNotNull(), F.struct("at", "word"))))
    return long.groupBy(key).agg(F.concat_ws(" ", F.transform(listed, lambda x: x.word)).alias("text"))


def attention(ids: Column) -> Column:
    return F.transform(ids, lambda x: x >= -1)


def clean_transcript(rows: DataFrame) -> DataFrame:
    """Lines (line) with the text after their first tab cleaned of marks; lines without a tab stay as they are."""
    from ..functions.text import clean_marks

    at = F.instr("line", "\t")
    return rows.withColumn("line", F.when(at > 0, F.concat(F.expr("substring(line, 1, instr(line, '\t'))"), clean_marks(F.expr("substring(line, instr(line, '\t') + 1)")))).otherwise(F.col("line")))


@F.pandas_udf(T.StringType())
def spoken(text: pd.Series) -> pd.Series:
    r"""The transcription that a manifest's GT stands for: its UTF-8 bytes with escapes (\n, \xe9, \u4f60, ...) taken as what they mean.

    Bytes beyond ASCII count one by one, as Latin-1; a text with an escape that means nothing stays as it is, null has "".
    """

    def one(raw: str | None) -> str:
        try:
            return (raw or "").encode("utf-8").decode("unicode_escape")
        except UnicodeDecodeError:
            return raw

    return text.map(one)


def line_numbers(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.monotonically_increasing_id())))
