"""Modelling run: features, clusters, topics and their distributions over sections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text, words
from ..functions.values import SECTION_NAMES, label
from ..operators import ml, stats
from ..session_scratch import materialised


@dataclass
class Analysis:
    clusters: DataFrame
    cluster_terms: DataFrame
    cluster_shares: DataFrame
    elbow: DataFrame | None
    topics: DataFrame
    topic_terms: DataFrame
    topic_shares: DataFrame


def analysis_rows(posts: DataFrame, names: dict = SECTION_NAMES, text: str = "doc") -> DataFrame:
    """Posts with text, section name, words and their number."""
    out = posts.withColumn(text, normalize_text(F.col(text))).where(F.col("section").isNotNull() & (F.col(text) != ""))
    out = out.withColumns({"section_name": label(F.col("section"), names), "tokens": words(F.col(text))})
    return out.withColumn("token_count", F.size("tokens"))


def analyse(posts: DataFrame, k: int = 3, topics: int = 5, n_init: int = 20, iterations: int = 20, min_df: int = 5, max_df: float = 0.85, ks=None, seed: int = 42, names: dict = SECTION_NAMES) -> Analysis:
    spark = posts.sparkSession
    rows = materialised(analysis_rows(posts, names).select("rid", "section", "section_name", "tokens"))
    vocab = ml.vocabulary(rows.select("rid", F.explode("tokens").alias("keyword")), "rid", min_df, max_df)
    weighted = materialised(ml.vectors(rows, vocab).select("rid", "section", "section_name", "features"))
    model, _ = ml.kmeans(weighted, k, n_init, seed)
    clusters = model.transform(weighted).drop("features")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("cluster_size"))
    import numpy as np

    terms = ml.matrix_terms(spark, np.array(model.clusterCenters()), vocab, "cluster").join(F.broadcast(sizes), "cluster", "left")
    counted = materialised(ml.vectors(rows, vocab, weighted=False).select("rid", "section", "section_name", "features"))
    fitted = ml.lda(counted, topics, iterations, seed)
    documents = ml.topic_documents(fitted, counted, topics)
    by = ["section", "section_name"]
    return Analysis(
        clusters, terms, stats.share_table(clusters, "cluster", by), ml.elbow(weighted, ks, n_init, seed) if ks else None,
        documents, ml.topic_terms(fitted, spark, vocab), stats.share_table(documents, "dominant_topic", by),
    )
