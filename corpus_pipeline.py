"""From raw documents to a training mix, in five stages that each apply one operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, jaccard_join, language_id, mixing, pii
from lectern.llm.common import Scratch, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language can be told: texts without a letter go, and those on the border of two languages.

    So null and empty texts go; rows with a null id or a null language stay; a
    row that occurs twice stays twice; of an empty table, or one without a
    language to learn from, nothing stays. Other columns may have any name.
    """
    learn = docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    return language_id.keep_identified(docs, language_id.fit_languages(learn))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of documents whose five-word shingles are alike by 0.8 or more.

    The row of the smallest id stays. Texts without words, null ones too, are
    like nothing and stay; so do rows with a null id. Rows with one id and one
    text are one row; different texts with one id are documents of their own.
    Other columns may have any name.
    """
    return jaccard_join.one_of_each(docs, words=5, num=80, den=100)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item by 0.8 or more of its five-word shingles.

    Null and empty texts hold nothing and stay; rows with a null id stay;
    repeated rows go or stay together; without items all stay. Other columns may
    have any name.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), words=5, least=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data and secrets replaced by the name of their kind, n_chars made to fit.

    A null text stays null, with its n_chars; repeated rows are changed alike.
    Other columns may have any name.
    """
    out = pii.redact(docs, pii.fit_field(docs))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select([F.col(f"`{c}`") for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their place in the mix of sources: mix_block and mix_row, no two alike.

    A null source is a source of its own, named ""; repeated rows and rows with a
    null id are rows of their own. Columns named like the new ones are replaced,
    others may have any name.
    """
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
]

#: SQL expresses neither the fitted models nor components over all pairs; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents that the stages keep."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        kept = scratch.write(stage(spark, docs, sf_dir), name)
        if hasattr(docs, "scratch_path"):
            scratch.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
