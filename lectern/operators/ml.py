"""K-means and LDA over term weights, with their tables of terms and sections."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import argmax
from ..session_scratch import materialised


def vocabulary(tokens: DataFrame, doc: str = "rid", min_df: int = 5, max_df: float = 0.85) -> list[str]:
    """All terms that their document frequency keeps, sorted.

    They come to the driver, in columns, as the models' matrices do whose places they are; their number grows more
    slowly than the texts'.
    """
    counts = tokens.select(doc, "keyword").distinct()
    n = tokens.select(doc).distinct().count()
    kept = counts.groupBy("keyword").agg(F.count("*").alias("df")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    return sorted(kept.select("keyword").toArrow()["keyword"].to_pylist())


def _counter(spark, vocab: list[str], tokens: str, out: str) -> CountVectorizerModel:
    """A counter of given terms, which go to the JVM as one text: one by one a million takes minutes."""
    if not vocab:
        raise ValueError("no terms")
    mark = next(m for m in ("\n", "\x1e", "\ue000", "\U0010fffd") if not any(m in w for w in vocab))
    split = spark.sparkContext._jvm.java.util.regex.Pattern.compile(mark).split(mark.join(vocab), -1)
    model = CountVectorizerModel._create_from_java_class("org.apache.spark.ml.feature.CountVectorizerModel", split)
    return model._set(inputCol=tokens, outputCol=out, vocabSize=len(vocab))


def vectors(df: DataFrame, vocab: list[str], tokens: str = "tokens", weighted: bool = True) -> DataFrame:
    """Rows with `features`: counts, or smooth tf-idf of length 1. A fixed vocabulary keeps places stable."""
    counted = _counter(df.sparkSession, vocab, tokens, "_tf").transform(df)
    if not weighted:
        return counted.withColumnRenamed("_tf", "features")
    held = F.explode(F.array_distinct(F.filter(F.col(tokens), lambda w: w.isNotNull())))
    df_of = df.select(held.alias("keyword")).groupBy("keyword").agg(F.count("*").alias("df"))
    n = df.count()
    found = df_of.join(_terms(df.sparkSession, vocab), "keyword").toArrow()
    found = dict(zip(found["keyword"].to_pylist(), found["df"].to_pylist(), strict=True))
    idf = np.log((1 + n) / (1 + np.array([found.get(w, 0) for w in vocab], float))) + 1
    from pyspark.ml.feature import ElementwiseProduct
    from pyspark.ml.linalg import Vectors

    scaled = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_w").transform(counted)
    return Normalizer(p=2.0, inputCol="_w", outputCol="features").transform(scaled).drop("_tf", "_w")


def _terms(spark, vocab: list[str], **more: np.ndarray) -> DataFrame:
    """Terms, and figures of each, as a table; the driver holds them anyway."""
    import pyarrow as pa

    return spark.createDataFrame(pa.table({"keyword": pa.array(vocab, pa.string())} | {k: pa.array(v) for k, v in more.items()}))


def dense(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))


#: Fits of one search that run side by side: each is a row of short jobs, which leave most of a cluster idle.
AT_ONCE = 4


def kmeans(df: DataFrame, k: int = 3, n_init: int = 20, seed: int = 42, iterations: int = 100):
    """The best of n_init fits by the sum of squared distances, the first of equal ones, and that sum."""

    def fit(i: int):
        m = KMeans(k=k, seed=seed + i, maxIter=iterations, featuresCol="features", predictionCol="cluster").fit(df)
        return m, m.summary.trainingCost

    with ThreadPoolExecutor(AT_ONCE) as pool:
        return min(pool.map(inheritable_thread_target(df.sparkSession)(fit), range(n_init)), key=lambda x: x[1])


def spread(df: DataFrame) -> DataFrame:
    """The frame in as many parts as the session has cores, where it has fewer: iterations over small tables then use them all."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def elbow(df: DataFrame, ks=range(2, 8), n_init: int = 20, seed: int = 42) -> DataFrame:
    """(k, sse); the features are computed once, and written where lost executors don't matter."""
    rows = materialised(spread(df.select("features")))
    found = [(k, float(kmeans(rows, k, n_init, seed)[1])) for k in ks]
    return df.sparkSession.createDataFrame(found, "k int, sse double")


def elbow_by_section(df: DataFrame, sections: list, ks=range(2, 9), n_init: int = 20, seed: int = 42) -> DataFrame:
    from functools import reduce

    return reduce(DataFrame.unionByName, [elbow(df.where(F.col("section") == s), ks, n_init, seed).select(F.lit(s).alias("section"), "k", "sse") for s in sections])


def cluster_terms_by_section(df: DataFrame, sections: list, k: int = 3, n: int = 15, min_df: int = 5, max_df: float = 0.85, n_init: int = 20, seed: int = 42) -> DataFrame:
    """section, cluster, cluster_size, rank, keyword and weight of the clusters of each section alone (rows: rid, section, tokens).

    Terms and weights are those of the section's own documents; a section of fewer documents than clusters, or without terms, has none.
    """
    from functools import reduce

    out = []
    for s in sections:
        rows = materialised(df.where(F.col("section") == s))
        vocab = vocabulary(rows.select("rid", F.explode("tokens").alias("keyword")), "rid", min_df, max_df)
        if not vocab or rows.limit(k).count() < k:
            continue
        weighted = materialised(vectors(rows, vocab).select("rid", "features"))
        model, _ = kmeans(weighted, k, n_init, seed)
        sizes = model.transform(weighted).groupBy("cluster").agg(F.count("*").alias("cluster_size"))
        terms = matrix_terms(df.sparkSession, np.array(model.clusterCenters()), vocab, "cluster", n)
        out.append(terms.join(F.broadcast(sizes), "cluster").select(F.lit(s).alias("section"), "cluster", "cluster_size", "rank", "keyword", "weight"))  # k rows
    ddl = "section int, cluster int, cluster_size bigint, rank int, keyword string, weight double"
    return reduce(DataFrame.unionByName, out) if out else df.sparkSession.createDataFrame([], ddl)


def _ranked(df: DataFrame, by: str, n: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("weight"), "keyword")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def heaviest(weights: np.ndarray, vocab: list[str], n: int) -> list[int]:
    """Places of the n largest weights; ties by term. Only what reaches the n-th weight is sorted."""
    least = np.partition(weights, -n)[-n] if n < len(weights) else -np.inf
    return sorted(np.flatnonzero(weights >= least).tolist(), key=lambda j: (-weights[j], vocab[j]))[:n]


def matrix_terms(spark, rows: np.ndarray, vocab: list[str], by: str, n: int = 15) -> DataFrame:
    """The n heaviest terms of each row of a small model matrix (clusters or topics by terms)."""
    top = [(i, vocab[j], float(r[j])) for i, r in enumerate(rows) for j in heaviest(r, vocab, n)]
    return _ranked(spark.createDataFrame(top, f"{by} int, keyword string, weight double"), by, n)


def centroid_terms(weights: DataFrame, clusters: DataFrame, n: int = 15, doc: str = "rid") -> DataFrame:
    """The heaviest terms of each cluster's mean, with its size, from weights in long form; documents without a term count as 0."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("cluster_size"))
    sums = weights.join(clusters.select(doc, "cluster"), doc).groupBy("cluster", "keyword").agg(F.sum("tfidf").alias("s"))
    means = sums.join(sizes, "cluster").select("cluster", "keyword", (F.col("s") / F.col("cluster_size")).alias("weight"), "cluster_size")
    return _ranked(means, "cluster", n)


def lda(df: DataFrame, k: int = 5, iterations: int = 20, seed: int = 42):
    """Variational LDA over whole passes with symmetric priors of 1/k."""
    return LDA(
        k=k, maxIter=iterations, seed=seed, optimizer="online", subsamplingRate=1.0, optimizeDocConcentration=False,
        docConcentration=[1.0 / k] * k, topicConcentration=1.0 / k, featuresCol="features", topicDistributionCol="topics",
    ).fit(spread(df))


def topic_terms(model, spark, vocab: list[str], n: int = 15) -> DataFrame:
    return matrix_terms(spark, model.topicsMatrix().toArray().T, vocab, "topic", n)


def topic_documents(model, df: DataFrame, k: int) -> DataFrame:
    """Rows with topic_0... and the first most probable topic; a row without any known term is spread evenly."""
    out = model.transform(df).withColumn("_p", vector_to_array("topics"))
    total = F.aggregate("_p", F.lit(0.0), lambda a, x: a + x)
    out = out.withColumn("_p", F.when(total > 0, F.col("_p")).otherwise(F.array_repeat(F.lit(1.0 / k), k)))
    return out.withColumns({f"topic_{i}": F.col("_p")[i] for i in range(k)} | {"dominant_topic": argmax(F.col("_p")).cast("int")}).drop("_p", "topics", "features")


def probability_check(docs: DataFrame, k: int) -> DataFrame:
    total = sum((F.col(f"topic_{i}") for i in range(1, k)), F.col("topic_0"))
    return docs.select(total.alias("s")).agg(F.min("s").alias("least"), F.max("s").alias("most"), F.avg("s").alias("mean"))


def term_topic_shares(model, spark, vocab: list[str]) -> DataFrame:
    """(topic, keyword, share) with each topic's shares summing to 1."""
    m = model.topicsMatrix().toArray().T
    m = m / m.sum(1, keepdims=True)
    wide = _terms(spark, vocab, **{f"t{t}": row for t, row in enumerate(m)})
    one = F.explode(F.array(*[F.struct(F.lit(t).alias("topic"), F.col(f"t{t}").alias("share")) for t in range(len(m))]))
    return wide.select("keyword", one.alias("s")).select("s.topic", "keyword", "s.share")


def topic_distances(model, spark) -> DataFrame:
    """Jensen-Shannon distance of each pair of topics and their places in two dimensions (principal coordinates): k by k, on the driver."""
    m = model.topicsMatrix().toArray().T
    m = m / m.sum(1, keepdims=True)
    k = len(m)

    def kl(a, b):
        some = a > 0
        return float((a[some] * np.log(a[some] / b[some])).sum())

    d = np.array([[0.5 * kl(a, (a + b) / 2) + 0.5 * kl(b, (a + b) / 2) for b in m] for a in m])
    centre = np.eye(k) - 1 / k
    values, vecs = np.linalg.eigh(-0.5 * centre @ d @ centre)
    top = np.argsort(-values)[:2]
    at = vecs[:, top] * np.sqrt(np.maximum(values[top], 0))
    at = np.pad(at, ((0, 0), (0, max(0, 2 - at.shape[1]))))
    rows = [(i, j, float(d[i, j]), float(at[i, 0]), float(at[i, 1])) for i in range(k) for j in range(k)]
    return spark.createDataFrame(rows, "topic int, other int, divergence double, x double, y double")


def relevance(model, spark, vocab: list[str], tokens: DataFrame, lam: float = 0.6, n: int = 30) -> DataFrame:
    """The n most relevant terms of each topic: lam * log share + (1 - lam) * log lift."""
    share = materialised(term_topic_shares(model, spark, vocab))
    counts = tokens.groupBy("keyword").agg(F.count("*").alias("c")).join(share.select("keyword").distinct(), "keyword")
    total = counts.agg(F.sum("c").alias("t"))
    p = counts.join(F.broadcast(total)).select("keyword", (F.col("c") / F.col("t")).alias("p"))
    scored = share.join(p, "keyword").withColumn("weight", lam * F.log("share") + (1 - lam) * F.log(F.col("share") / F.col("p")))
    return _ranked(scored.drop("p", "share"), "topic", n)
