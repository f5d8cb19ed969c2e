"""A corpus pipeline: language, repeated lines, near-duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; what it returns is written as Parquet and read
again for the next one. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcube.llm import decontamination, language_id, line_dedup, near_dedup, packing
from sparkcube.llm._shared import written


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts that are null, have no letter, are undecided or foreign to every language go.

    It learns from the rows with text and lang; without any, nothing can be told and all texts with a letter stay. Nulls in other
    columns don't matter, repeated rows share their fate, and an empty table gives none.
    """
    model = language_id.train(docs)
    return language_id.keep_native(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document (by doc_id), or an earlier line, has; n_chars follows the text.

    A document that lost lines and has no words left goes. Rows with a null doc_id lose only lines that repeat in their own text;
    repeated rows lose the same lines; null and empty texts and lines without words stay as they are; an empty table gives none.
    """
    found = line_dedup.drop_repeated_lines(docs)
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles with a similarity of 0.8 or more: the one of the smallest doc_id.

    Wordless and null texts, and rows with a null doc_id, are in no group and stay; rows that repeat a doc_id stay or go together; an
    empty table gives none.
    """
    return near_dedup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark. Null and wordless texts stay; repeated rows share their fate; an empty table gives
    none, and an empty benchmark leaves all."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts with their bins. Null and empty texts take one token; null sources conflict with none; repeated rows are
    packed apart; equal sizes go by doc_id and piece; an empty table gives none."""
    return packing.pack(docs, texts=True)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_texts),
]

#: Naive Bayes and best-fit packing are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
