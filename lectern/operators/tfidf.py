"""Term weights in long form: (document, keyword, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session_scratch import materialised


def term_counts(tokens: DataFrame, doc: list[str]) -> DataFrame:
    """The document-term matrix: tf of each keyword in each document."""
    return tokens.groupBy(*doc, "keyword").agg(F.count("*").alias("tf"))


def document_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("keyword").agg(F.count("*").alias("df"))


def doc_lengths(counts: DataFrame, doc: list[str]) -> DataFrame:
    return counts.groupBy(*doc).agg(F.sum("tf").alias("length"))


def term_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("keyword").agg(F.sum("tf").alias("total"))


def prune(counts: DataFrame, doc: list[str], min_df: int = 5, max_df: float = 0.85) -> DataFrame:
    """Counts of the terms in at least min_df documents and at most a share max_df of all documents."""
    n = counts.select(*doc).distinct().agg(F.count("*").alias("n"))
    fit = document_frequencies(counts).join(F.broadcast(n)).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n"))).select("keyword")
    return counts.join(fit, "keyword", "left_semi")


def tfidf(tokens: DataFrame, doc: list[str], counts: DataFrame | None = None) -> DataFrame:
    """tf * (ln((1 + n) / (1 + df)) + 1), each document's weights scaled to length 1."""
    counts = term_counts(tokens, doc) if counts is None else counts
    n = counts.select(*doc).distinct().agg(F.count("*").alias("n"))  # one row
    idf = document_frequencies(counts).join(F.broadcast(n)).select("keyword", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = counts.join(idf, "keyword").select(*doc, "keyword", (F.col("tf") * F.col("idf")).alias("w"))
    length = raw.groupBy(*doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    return raw.join(length, doc).select(*doc, "keyword", (F.col("w") / F.col("len")).alias("tfidf"))


def top_terms(weights: DataFrame, n: int, by: list[str]) -> DataFrame:
    """The n heaviest terms of each group with their rank; ties by keyword."""
    w = Window.partitionBy(*by).orderBy(F.desc("tfidf"), "keyword")
    return weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def mean_tfidf(weights: DataFrame, docs: DataFrame) -> DataFrame:
    """Each keyword's mean over all documents, those without it counting as 0."""
    n = docs.agg(F.count("*").alias("n"))
    return weights.groupBy("keyword").agg(F.sum("tfidf").alias("s")).join(F.broadcast(n)).select("keyword", (F.col("s") / F.col("n")).alias("mean_tfidf"))


def mean_by(weights: DataFrame, docs: DataFrame, by: str) -> DataFrame:
    """The same within each group of documents."""
    n = docs.groupBy(by).agg(F.count("*").alias("n"))
    return weights.groupBy(by, "keyword").agg(F.sum("tfidf").alias("s")).join(n, by).select(by, "keyword", (F.col("s") / F.col("n")).alias("mean_tfidf"))


def cosine_adjacent(weights: DataFrame, by: str = "section") -> DataFrame:
    """Cosine of each section's weights with those of the next section that exists."""
    weights = materialised(weights)  # read three times: terms by sections, far fewer than tokens
    order = weights.select(by).distinct()
    step = order.select(by, F.lead(by).over(Window.orderBy(by)).alias("_next")).where("_next is not null")  # a row for each section
    left = weights.join(F.broadcast(step), by).select(by, "_next", "keyword", F.col("tfidf").alias("a"))
    right = weights.select(F.col(by).alias("_next"), "keyword", F.col("tfidf").alias("b"))
    dot = left.join(right, ["_next", "keyword"], "left").groupBy(by, "_next").agg(F.sum(F.coalesce(F.col("a") * F.col("b"), F.lit(0.0))).alias("cosine_similarity"))
    return dot.select(F.concat(F.col(by).cast("string"), F.lit("→"), F.col("_next").cast("string")).alias("transition"), "cosine_similarity")


def heatmap(weights: DataFrame, n: int = 20, by: str = "section") -> tuple[DataFrame, list[str]]:
    """Sections by the n keywords with the largest weight anywhere, in that order; 0 where a section lacks one."""
    top = weights.groupBy("keyword").agg(F.max("tfidf").alias("m")).orderBy(F.desc("m"), "keyword").limit(n).collect()
    names = [r.keyword for r in top]
    return weights.where(F.col("keyword").isin(names)).groupBy(by).pivot("keyword", names).agg(F.first("tfidf")).na.fill(0.0), names
