"""The registered queries of this package, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontaminate, jaccard_join, language_id, licenses, mixing, oracles, pii, toxicity, warc
from .common import table


def _fold(k: int, of: str = "doc_id"):
    """crc32 of the id as text, modulo k."""
    return F.crc32(F.col(of).cast("string")) % k


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find_pii(docs, pii.fit_field(docs))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(_fold(5) != 0)
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))
    return scored.select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs).select("doc_id", "source", "mix_block", "mix_row")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render_chats(table(spark, sf_dir, "conversations"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    codes = language_id.fit_languages(docs.where(_fold(4) != 2))
    found = language_id.identify(docs, codes)
    return found.select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, _ = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read_archive(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_decontamination": op6_decontamination,
    "op7_chat": op7_chat,
    "op8_language_id": op8_language_id,
    "op9_warc": op9_warc,
    "op10_licenses": op10_licenses,
}
ORACLES: dict[str, str] = {
    "op4_ngram_jaccard_join": oracles.OP4,
    "op6_decontamination": oracles.OP6,
    "op7_chat": oracles.OP7,
    "op9_warc": oracles.OP9,
}
