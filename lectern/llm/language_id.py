"""Language identification by error-correcting output codes.

Every language gets a codeword; one binary logistic classifier per bit, on hashed
character 1- to 3-grams of the whole text, predicts that bit. Decoding adds the
logistic loss of each bit, weighted by how well that bit's classifier does on
the language (loss-weighted decoding); the nearest codeword wins. Scores come
from the losses by a factor that tells the sample's texts best from mixtures of
two of them, half and half; a text is flagged ambiguous where the second
language's score is near the first one's.

The fit takes `per_language` texts of each language at most, and `fit_rows` in
all, chosen by hash of their id, without those of more than `fit_chars`
characters; all texts are scored whole.

Defined results: a null text, or one without a letter, is `und` with score 0;
without any learnable row every text is `und`; repeated rows give repeated
results; extra columns are ignored; an empty table gives an empty result.
Ties between codewords go to the alphabetically first language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_of_each, hash_share, map_batches

BITS = 12  # of a feature's number
SCHEMA = "doc_id long, lang_pred string, score double, ambiguous boolean, margin double"


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed 1- to 3-grams, of length 1."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    counts = np.zeros(1 << BITS)
    h = np.zeros(len(c), np.uint32)
    for n in range(1, 4):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * np.uint32(0x9E3779B1) + c[n - 1 :] + np.uint32(n)
        counts += np.bincount((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    return np.sqrt(counts / counts.sum())


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of -1 and 1: all splits in two for up to 5 languages, else the best of many drawn codes."""
    if k <= 5:
        splits = [[1 if not i or (m >> (i - 1)) & 1 else -1 for i in range(k)] for m in range(max(1, 2 ** (k - 1) - 1))]
        return np.array(splits, float).T
    bits, rng, best = int(np.ceil(10 * np.log2(k))), np.random.default_rng(seed), None
    for _ in range(300):
        code = rng.choice([-1.0, 1.0], (k, bits))
        far = ((bits - code @ code.T) / 2 + bits * np.eye(k)).min()
        if (np.abs(code.sum(0)) < k).all() and (best is None or far > best[0]):
            best = far, code
    return best[1]


class Codes:
    """Fitted bit classifiers and the code."""

    FACTORS = (0.25, 0.5, 1.0, 2.0, 4.0, 8.0)

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray, factor: float = 1.0):
        self.languages, self.code, self.weights, self.bias, self.trust, self.factor = languages, code, weights, bias, trust, factor

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str], steps: int = 300, rate: float = 8.0) -> Codes | None:
        languages = sorted(set(langs))
        if not languages:
            return None
        y = np.array([languages.index(v) for v in langs])
        code = codewords(len(languages))
        target = code[y]
        share = 1 / np.bincount(y)[y]
        share = (share / share.sum())[:, None]
        x, target, share = x.astype(np.float32), target.astype(np.float32), share.astype(np.float32)
        w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
        vw, vb = np.zeros_like(w), np.zeros_like(b)
        for _ in range(steps):
            g = -target * share / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30)))
            vw, vb = 0.9 * vw - rate * (x.T @ g + 1e-6 * w), 0.9 * vb - rate * g.sum(0)
            w, b = w + vw, b + vb
        right = (target * (x @ w + b)) > 0
        trust = np.array([(right[y == k].sum(0) + 1) / ((y == k).sum() + 2) for k in range(len(languages))])
        codes = cls(languages, code, w.astype(np.float32), b, trust / trust.sum(1, keepdims=True))
        codes.factor = codes._best_factor(x, y)
        return codes

    def _best_factor(self, x: np.ndarray, y: np.ndarray, mixtures: int = 500, seed: int = 3) -> float:
        """The factor with the least log loss on texts and on mixtures of two texts of different languages."""
        i, j = np.random.default_rng(seed).integers(0, len(y), (2, mixtures))
        i, j = i[y[i] != y[j]], j[y[i] != y[j]]
        # features are roots of shares, so the squares mix
        losses = np.concatenate([self.losses(x), self.losses(np.sqrt((x[i] ** 2 + x[j] ** 2) / 2))])
        first, second = np.concatenate([y, y[i]]), np.concatenate([y, y[j]])
        weight = np.repeat([1 / len(y), 1 / max(1, len(i))], [len(y), len(i)])
        row = np.arange(len(losses))

        def log_loss(factor: float) -> float:
            z = -factor * losses
            z -= z.max(1, keepdims=True)
            log_p = z - np.log(np.exp(z).sum(1, keepdims=True))
            return -(weight * (log_p[row, first] + log_p[row, second]) / 2).sum()

        return min(self.FACTORS, key=log_loss)

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Loss of every codeword."""
        margin = np.clip(x.astype(np.float32) @ self.weights + self.bias, -8, 8)
        return (np.log1p(np.exp(-self.code[None] * margin[:, None])) * self.trust[None]).sum(2)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the nearest codeword, its score of 0 to 1, and its lead over the next in score."""
        loss = self.losses(x)
        p = np.exp(-self.factor * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = loss.argmin(1)
        ranked = np.sort(p, 1)
        return best, ranked[:, -1], ranked[:, -1] - (ranked[:, -2] if p.shape[1] > 1 else 0)


def _featured(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        rows = [features(t).astype(np.float16).tobytes() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], ["lang", "x"])


def fit_languages(
    train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 500, fit_rows: int = 20_000, fit_chars: int = 20_000
) -> Codes | None:
    """Codes from at most per_language texts of each language and fit_rows in all; of more than fit_rows languages, the most common."""
    rows = train.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull())
    found = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(fit_rows).collect()
    counts = {r.lang: r.n for r in found}
    if not counts:
        return None
    each = min(per_language, fit_rows // len(counts))
    n = F.create_map(*(F.lit(v) for pair in sorted(counts.items()) for v in pair))[F.col("lang")]
    chosen = rows.where(hash_share("doc_id", each, n)).where(F.col("text").rlike(r"\p{L}") & (F.length("text") <= fit_chars))
    # at most `each` of a language, also where one id has many rows
    chosen = first_of_each(chosen.withColumn("h", F.xxhash64(F.lit(11), "doc_id")), "lang", ["h", "text"], each)
    got = sorted(map_batches(chosen.select("lang", "text"), _featured, "lang string, x binary").collect(), key=lambda r: (r.lang, bytes(r.x)))
    if not got:
        return None
    x = np.array([np.frombuffer(r.x, np.float16) for r in got], np.float32).reshape(len(got), -1)
    return Codes.fit(x, [r.lang for r in got])


def _decide(said: list[str | None], codes: Codes | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and lead of each text."""
    lang, score, lead = ["und"] * len(said), np.zeros(len(said)), np.zeros(len(said))
    some = [i for i, t in enumerate(said) if t and any(map(str.isalpha, t))] if codes else []
    for at in range(0, len(some), 256):
        part = some[at : at + 256]
        best, p, gap = codes.decode(np.array([features(said[i]) for i in part]))
        for i, k in zip(part, best, strict=True):
            lang[i] = codes.languages[k]
        score[part], lead[part] = p, gap
    return lang, score, lead


def identify(docs: DataFrame, codes: Codes | None, id_col: str = "doc_id", text_col: str = "text", ambiguous_below: float = 0.5) -> DataFrame:
    """Language of every whole text, its score, and whether the second language's is within ambiguous_below of it."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            lang, score, lead = _decide(b.column(1).to_pylist(), codes)
            flag = [x != "und" and g < ambiguous_below for x, g in zip(lang, lead, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(flag, pa.bool_()), pa.array(lead)], names)

    return map_batches(docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text"), batches, SCHEMA)


def keep_identified(docs: DataFrame, codes: Codes | None, text_col: str = "text", ambiguous_below: float = 0.0025) -> DataFrame:
    """The rows, with all their columns, whose language can be told: not `und`, and no second one within ambiguous_below.

    That is narrower than the flag of `identify`: what goes is lost, so only texts on the very border go.
    """
    place = docs.columns.index(text_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            lang, _, lead = _decide(b.column(place).to_pylist(), codes)
            yield b.filter(pa.array([x != "und" and g >= ambiguous_below for x, g in zip(lang, lead, strict=True)], pa.bool_()))

    return map_batches(docs, batches, docs.schema)
