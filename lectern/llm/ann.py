"""Approximate nearest neighbours over learned partitions.

On a bounded sample the nearest-neighbour graph is cut into balanced parts
(recursive halving along a random-walk direction of the graph, then moves of
vertices to the part that holds most of their neighbours, while sizes allow).
A small softmax classifier learns to name the part of a vector. It deals every
row to its most probable part, and sends every query to the most probable
parts, as many as find a share `recall` of the neighbours of sampled vectors
that were held out of the graph. Exact cosines rank the candidates there.

The classifier is bounded by `parts`; rows aren't: a part is cut by hash into
blocks of about `block_rows`, each searched on its own, and the blocks' best
are merged. So neither a large part nor a very common vector meets in one task.

Measured recall against brute force is a test and stands in the README.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part; ties go to the smaller id;
a row that occurs twice counts once, and a query's own id is no candidate; a
query goes on to further parts until those searched hold k other rows, so fewer
than k candidates in the table are all returned; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, hash_share

RESULT = "query_id long, vec_id long, score double"


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its largest component near one: exact, and squares neither overflow nor vanish."""
    _, power = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    return np.ldexp(x, -power)


def normalised(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int = 10) -> np.ndarray:
    """The k nearest of each row, itself excluded."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + len(s)] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, x: np.ndarray, parts: int, slack: float = 1.15, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Part of each vertex: halves of the graph, halved again, then moves towards neighbours within the size limit."""
    rng, n = np.random.default_rng(seed), len(graph)
    part = np.zeros(n, np.int64)
    done = 1
    while done < parts:
        # a direction that varies slowly along edges splits a part where few edges cross
        v = x @ rng.normal(size=(x.shape[1], 1))[:, 0]
        for _ in range(20):
            same = part[graph] == part[:, None]
            v = 0.5 * v + 0.5 * np.where(same.any(1), (v[graph] * same).sum(1) / np.maximum(same.sum(1), 1), v)
            total, size = np.bincount(part, v, done), np.bincount(part, minlength=done)
            v = v - (total / np.maximum(size, 1))[part]
        order = np.lexsort((v, part))
        first = np.searchsorted(part[order], np.arange(done))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n) - first[part[order]]
        size = np.bincount(part, minlength=done)
        part = part * 2 + (rank >= size[part] // 2)
        done *= 2
    limit = int(np.ceil(slack * n / done))
    for _ in range(rounds):
        votes = np.zeros((n, done), np.int32)
        np.add.at(votes, (np.repeat(np.arange(n), graph.shape[1]), part[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(part, graph.shape[1])), 1)
        want = votes.argmax(1)
        gain = votes[np.arange(n), want] - votes[np.arange(n), part]
        size, moved = np.bincount(part, minlength=done), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[want[i]] < limit:
                size[part[i]] -= 1
                size[want[i]] += 1
                part[i] = want[i]
                moved += 1
        if not moved:
            break
    return part


class Router:
    """Softmax over the parts."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights, bias

    @classmethod
    def fit(cls, x: np.ndarray, part: np.ndarray, graph: np.ndarray, steps: int = 300, rate: float = 1.0) -> Router:
        """Targets are the shares of a vector's neighbours (and itself) in the parts, as queries look for neighbours."""
        n, k = len(x), int(part.max()) + 1
        target = np.zeros((n, k))
        np.add.at(target, (np.repeat(np.arange(n), graph.shape[1]), part[graph].ravel()), 0.5 / graph.shape[1])
        target[np.arange(n), part] += 0.5
        w, b = np.zeros((x.shape[1], k)), np.zeros(k)
        mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
        for t in range(1, steps + 1):
            z = x @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            gw, gb = x.T @ (p - target) / n, (p - target).mean(0)
            mw, vw = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw**2
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
            step = 0.1 * rate * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
            w -= step * mw / (np.sqrt(vw) + 1e-9)
            b -= step * mb / (np.sqrt(vb) + 1e-9)
        return cls(w, b)

    def best(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The most probable parts, best first; equal ones by number."""
        return np.argsort(-(x @ self.weights + self.bias), axis=1, kind="stable")[:, :probes]


def exact_cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of paired rows in double precision, summed row by row, so that equal vectors get equal scores; of any finite size."""
    q, x = scaled(q), scaled(x)
    return (q * x).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1)))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 1))


def search_block(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of each query within one block, by score, then id."""
    out = []
    if len(queries) and len(rows):
        rows = rows.sort_values("vec_id", kind="stable").drop_duplicates("vec_id")
        queries = queries.drop_duplicates("vec_id")
        ids, x = rows.vec_id.to_numpy(), _matrix(rows.v)
        unit = normalised(x)
        for at in range(0, len(queries), 256):
            part = queries.iloc[at : at + 256]
            q, qid = _matrix(part.v), part.vec_id.to_numpy()
            s = normalised(q) @ unit.T
            s[qid[:, None] == ids[None]] = -np.inf
            kth = -np.partition(-s, min(k, s.shape[1]) - 1, axis=1)[:, min(k, s.shape[1]) - 1]
            for i in range(len(part)):
                near = np.flatnonzero((s[i] >= kth[i] - 1e-9) & (s[i] > -np.inf))
                score = exact_cosine(np.broadcast_to(q[i], (len(near), q.shape[1])), x[near])
                best = near[np.lexsort((ids[near], -score))][:k]
                got = np.sort(-score)[:k]
                out.append(pd.DataFrame({"query_id": qid[i], "vec_id": ids[best], "score": -got}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v (array of double) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine & F.exists("v", lambda c: c != 0))


def probes_for(router: Router, x: np.ndarray, held: np.ndarray, k: int, recall: float) -> int:
    """How many parts must be searched to find a share of the held-out vectors' k nearest among x."""
    own = router.best(x, 1)[:, 0]
    near = np.argsort(-(held @ x.T), axis=1, kind="stable")[:, :k]
    order = router.best(held, router.weights.shape[1])
    rank = np.take_along_axis(np.argsort(order, axis=1), own[near], 1)
    return int(np.quantile(rank, recall, method="higher")) + 1


def fit_router(rows: DataFrame, n: int, k: int = 5, sample_rows: int = 8000, parts: int = 64, recall: float = 0.93) -> tuple[Router | None, int]:
    """A router for n usable rows from about sample_rows of them, chosen by hash of the id, and how many parts a query searches."""
    h = F.xxhash64(F.lit(11), "vec_id")  # at most sample_rows rows, also where one id has many
    got = rows.where(hash_share("vec_id", sample_rows, n)).orderBy(h, "v").limit(sample_rows).collect() if n else []
    if not got:
        return None, 1
    x = normalised(np.unique(np.array([r.v for r in got], np.float64), axis=0))
    x = np.random.default_rng(1).permutation(x)
    held, x = x[: len(x) // 16], x[len(x) // 16 :]
    parts = min(parts, 1 << max(0, int(np.log2(max(1, len(x) // 32)))))
    if parts < 2 or not len(held):
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1)), 1
    graph = neighbour_graph(x)
    router = Router.fit(x, balanced_parts(graph, x, parts), graph)
    return router, probes_for(router, x, held, k, recall)


def nearest(
    vectors: DataFrame,
    is_query,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample_rows: int = 8000,
    parts: int = 64,
    recall: float = 0.93,
    block_rows: int = 4000,
) -> DataFrame:
    """The k nearest rows of each query row: query_id, rank from 1, vec_id, score.

    is_query: a condition on vec_id. Candidates are all usable rows but the query's own.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = usable(vectors, id_col, vector_col)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not length:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == length[0].n)
    n = rows.count()
    router, probes = fit_router(rows, n, k, sample_rows, parts, recall)
    if router is None:  # no row fell into the sample of a very small table: one part holds all
        router = Router(np.zeros((length[0].n, 1)), np.zeros(1))
    count = router.weights.shape[1]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(part=router.best(normalised(_matrix(b.v)), 1)[:, 0].astype("int32"))

    # blocks by the rows' number, not by a part's: every part is cut alike, and none needs to be known beforehand
    blocks = max(1, -(-n // (count * block_rows)) * 2)
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    dealt = Scratch(spark).write(rows.mapInPandas(deal, "vec_id long, v array<double>, part int").select("vec_id", "v", "part", block), "dealt")
    size = np.zeros(count, np.int64)  # one number for each part
    for r in dealt.groupBy("part").agg(F.countDistinct("vec_id").alias("n")).collect():
        size[r.part] = r.n

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                best = router.best(normalised(_matrix(b.v)), count)
                most = np.maximum(probes, (np.cumsum(size[best], 1) <= k).sum(1) + 1)  # k others and the query's own row
                yield b.assign(parts=[p[:m].astype("int32") for p, m in zip(best, most, strict=True)])

    asked = rows.where(is_query).mapInPandas(ask, "vec_id long, v array<double>, parts array<int>").select("vec_id", "v", F.explode("parts").alias("part"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = asked.groupBy("part", "block").cogroup(dealt.groupBy("part", "block")).applyInPandas(lambda q, x: search_block(q, x, k), RESULT)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(w).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
