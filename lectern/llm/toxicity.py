"""Toxicity by subword-bag embeddings averaged into a linear softmax, fitted jointly in numpy.

A unit (a word) is the mean of the embeddings of its hashed character 3- to
5-grams, word ends included, so a misspelt word shares most vectors with the
word it comes from. The mean goes into a softmax over {clean, toxic}. A text is
scored by its most toxic unit, so one word tells in a text of any length (the
README compares this with one mean over the whole text).

Labels are known for whole texts only, so the fit alternates: pick the unit
that speaks most for each toxic text, then step embeddings and softmax together
over those units against units of clean texts. Toxic texts in which nothing
speaks for toxicity are left out of a round, as are labels that are noise. Last,
a logistic on the texts' highest units sets scale and offset of the softmax.

The softmax is linear in the mean, so each hashed n-gram has one number when
scoring, and a text takes a few array operations over its characters.

The fit takes `fit_rows` labelled rows of each label at most, chosen by hash of
their id, without texts of more than `fit_chars` characters.

Defined results: a null or empty text, or one without letters or digits, has
score 0; without both labels in the fit every text has score 0; repeated rows
give repeated results; extra columns are ignored; an empty table gives an empty
result. One Arrow batch bounds the memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_of_each, hash_share, map_batches

BITS, DIM, GRAMS = 17, 16, (3, 4, 5)
SCHEMA = "doc_id long, score double, predicted int"


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text between spaces; what is no letter or digit is a space."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    low = (c >= 97) & (c <= 122) | (c >= 48) & (c <= 57)
    high = (c >= 0xAA) & (c != 0xD7) & (c != 0xF7) & ~((c >= 0x2000) & (c <= 0x206F)) & (c != 0x3000)
    return np.where(low | high, c, np.uint32(32))


def _gram_ids(c: np.ndarray) -> list[np.ndarray]:
    """For each n, the bucket of the n-gram at each place."""
    out, h = [], np.zeros(len(c), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] + np.uint32(1)
        if n in GRAMS:
            out.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS))
    return out


def _units(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word."""
    word = np.concatenate([[False], c != 32, [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], edge[1::2]


def unit_means(c: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's mean of what its n-grams are worth, with the word's start and end."""
    start, end = _units(c)
    total, count = np.zeros(len(start)), np.zeros(len(start))
    for n, ids in zip(GRAMS, _gram_ids(c), strict=False):
        run = np.concatenate([[0.0], np.cumsum(value[ids], dtype=np.float64)])
        last = np.maximum(end - n + 2, start - 1)  # the n-gram that ends with the space after the word is the last one
        total += run[np.minimum(last, len(ids))] - run[np.minimum(start - 1, len(ids))]
        count += last - start + 1
    return total / np.maximum(count, 1), start, end


class Model:
    """Embeddings and softmax, or what they make of each n-gram."""

    def __init__(self, embeddings: np.ndarray, softmax: np.ndarray, bias: np.ndarray):
        self.embeddings, self.softmax, self.bias = embeddings, softmax, bias
        self.value = (embeddings @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32)
        self.offset = float(bias[1] - bias[0])

    def score(self, text: str | None) -> float:
        c = _codes(text or "")
        mean, _, _ = unit_means(c, self.value)
        return float(1 / (1 + np.exp(-np.clip(mean.max() + self.offset, -30, 30)))) if len(mean) else 0.0


def _words(text: str) -> list[str]:
    return _codes(text).tobytes().decode("utf-32-le").split()


class Bags:
    """Hashed n-grams of many words, one after another, numbered among those that occur."""

    def __init__(self, words: list[str]):
        self.codes = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32)
        start, end = _units(self.codes)
        lo = np.concatenate([start - 1 for _ in GRAMS])
        hi = np.concatenate([np.maximum(end - n + 2, start - 1) for n in GRAMS])
        sizes = [len(self.codes) - n + 1 for n in GRAMS]
        ids = np.concatenate(_gram_ids(self.codes))
        base = np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), len(words))
        # by word, then n
        order = np.argsort(np.tile(np.arange(len(words)), len(GRAMS)), kind="stable")
        flat = ids[_ranges((lo + base)[order], (hi - lo)[order])]
        self.sizes = (hi - lo).reshape(len(GRAMS), -1).sum(0)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.buckets, self.flat = np.unique(flat, return_inverse=True)

    def of(self, words: np.ndarray) -> np.ndarray:
        return self.flat[_ranges(self.starts[words], self.sizes[words])]

    def means(self, value: np.ndarray) -> np.ndarray:
        """Each word's mean of what its n-grams are worth."""
        return np.add.reduceat(value[self.flat], self.starts) / self.sizes


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... n times, for each pair."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def _calibrated(top: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Scale and offset of the logistic that tells texts' labels from their highest units, by Newton's steps."""
    scale, offset, x = 1.0, 0.0, np.stack([top, np.ones(len(top))], 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ [scale, offset], -30, 30)))
        g = x.T @ (p - y) + 1e-3 * np.array([scale, offset])
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        step /= max(1.0, np.abs(step).max())
        scale, offset = scale - step[0], offset - step[1]
    return float(scale), float(offset)


def fit_model(toxic: list[str], clean: list[str], rounds: int = 3, epochs: int = 5, negatives: int = 40_000, seed: int = 5) -> Model | None:
    """Joint fit of embeddings and softmax over the units picked from whole texts, then of scale and offset on the texts; see the module."""
    toxic, clean = sorted(set(toxic)), sorted(set(clean))
    texts = [t for t in (sorted(set(_words(t))) for t in toxic + clean) if t]
    n_toxic = sum(1 for t in toxic if _words(t))
    if not n_toxic or n_toxic == len(texts):
        return None
    rng = np.random.default_rng(seed)
    vocabulary = sorted({w for t in texts for w in t})
    number = {w: i for i, w in enumerate(vocabulary)}
    sizes = np.array([len(t) for t in texts])
    held = np.array([number[w] for t in texts for w in t])  # the words of all texts, one after another
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    found = np.bincount(held[: cuts[n_toxic]], minlength=len(vocabulary))
    against = np.bincount(held[cuts[n_toxic] :], minlength=len(vocabulary))
    bags = Bags(vocabulary)
    least = next((n for n in (3, 2) if ((found >= n) & (against == 0)).any()), 1)
    odds = np.log((found + 0.5) / n_toxic) - np.log((against + 0.5) / (len(texts) - n_toxic))
    first = np.where((found >= least) & (odds > 1.5), odds * np.minimum(found, 10), 0.0)

    def witnesses(worth: np.ndarray) -> np.ndarray:
        """The word of each toxic text that speaks most for toxicity, if one does."""
        picked = [t[np.argmax(worth[t])] for t in np.split(held[: cuts[n_toxic]], cuts[1:n_toxic])]
        return np.array([w for w in picked if worth[w] > 0], np.int64)

    witness = witnesses(first)
    others = np.flatnonzero(against)
    if len(others) > negatives:
        weight = np.sqrt(against[others])
        others = np.sort(rng.choice(others, negatives, replace=False, p=weight / weight.sum()))
    emb = rng.normal(0, 0.1, (len(bags.buckets), DIM))
    soft, bias = rng.normal(0, 0.1, (DIM, 2)), np.array([1.0, -1.0])
    ge, gs, gb = np.full(len(emb), 1e-4), np.full(soft.shape, 1e-4), np.full(2, 1e-4)
    for _ in range(rounds):
        if not len(witness):
            return None
        words = np.concatenate([witness, others])
        label = np.repeat([1, 0], [len(witness), len(others)])
        weight = np.repeat([0.5 / len(witness), 0.5 / max(1, len(others))], [len(witness), len(others)]) * len(words)
        for _ in range(epochs):
            order = rng.permutation(len(words))
            for at in range(0, len(order), 2048):
                part = order[at : at + 2048]
                ids, n = bags.of(words[part]), bags.sizes[words[part]]
                mean = np.add.reduceat(emb[ids], np.concatenate([[0], np.cumsum(n)[:-1]])) / n[:, None]
                z = mean @ soft + bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                d = (p - np.eye(2)[label[part]]) * weight[part][:, None]
                dm = (d @ soft.T) / n[:, None]
                gsoft, gbias = mean.T @ d / len(part), d.mean(0)
                gs += gsoft**2
                gb += gbias**2
                # gradient of each n-gram's embedding: sum over the units that hold it
                owner = np.repeat(np.arange(len(part)), n)
                by = np.argsort(ids, kind="stable")
                rows, start = np.unique(ids[by], return_index=True)
                g = np.add.reduceat(dm[owner[by]], start)
                ge[rows] += (g**2).mean(1)
                emb[rows] -= 0.5 * g / np.sqrt(ge[rows])[:, None]
                soft -= 0.1 * gsoft / np.sqrt(gs)
                bias -= 0.1 * gbias / np.sqrt(gb)
        worth = bags.means(emb @ (soft[:, 1] - soft[:, 0])) + bias[1] - bias[0]
        witness = witnesses(np.where(found >= min(2, least), worth, -np.inf))
    scale, offset = _calibrated(np.maximum.reduceat(worth[held], cuts[:-1]), np.arange(len(texts)) < n_toxic)
    if scale <= 0:
        return None
    table = np.zeros((1 << BITS, DIM))
    table[bags.buckets] = emb
    return Model(table, soft * scale, np.array([0.0, (bias[1] - bias[0]) * scale + offset]))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = 2500, fit_chars: int = 6_000
) -> Model | None:
    """A model from fit_rows labelled rows of each label at most; rows with a null label or id take no part."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n = F.when(F.col("y") == 1, F.lit(counts.get(1, 0))).otherwise(F.lit(counts.get(0, 0)))
    h = F.xxhash64(F.lit(11), "doc_id")
    chosen = first_of_each(known.where(hash_share("doc_id", fit_rows, n)).distinct().withColumn("h", h), "y", ["h", "doc_id"], fit_rows)
    # at most twice fit_rows ids go to every task, and as many texts come back, also where an id has many
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") <= fit_chars)
    got = first_of_each(rows.join(F.broadcast(chosen), "doc_id"), "y", ["h", "text"], fit_rows).select("y", "text").collect()
    return fit_model([r.text for r in got if r.y == 1], [r.text for r in got if r.y == 0])


def score_toxicity(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score of 0 to 1 and its rounding to 0 or 1 for every whole text."""
    slim = None
    if model:
        slim = Model.__new__(Model)
        slim.value, slim.offset = model.value, model.offset

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            score = np.array([slim.score(t) if slim else 0.0 for t in b.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return map_batches(docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text"), batches, SCHEMA)
