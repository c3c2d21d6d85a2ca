"""Duplicates by address, by whole row, and near-duplicates among posts with the same title."""

from __future__ import annotations

import math
from bisect import bisect_left
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import canonical_post_url
from ..session_scratch import materialised
from .filters import with_url

#: Most rows of one title and length that are compared with as many others in one task, and most characters of them.
BLOCK, BLOCK_CHARS = 512, 1 << 20
#: Lengths of a band differ by this factor at most; a row is compared with the bands whose lengths can be like its own.
STEP = 1.2
#: Most cells of a table of n-grams in a task.
CELLS = 1 << 23


def dedupe_urls(df: DataFrame, order: str = "rid") -> DataFrame:
    """The first row of each address; rows without one go."""
    if "canonical_url" not in df.columns:
        df = df.withColumn("canonical_url", canonical_post_url(F.col("url")))
    first = F.row_number().over(Window.partitionBy("canonical_url").orderBy(order))
    return with_url(df).withColumn("_r", first).where("_r = 1").drop("_r")


def ordered_distinct(df: DataFrame, value: str, position: str) -> DataFrame:
    """Each value once, at its first position, in order."""
    return df.groupBy(value).agg(F.min(position).alias(position)).orderBy(position)


def ratio(a: str, b: str, autojunk: bool = True) -> float:
    """Share of characters in matching blocks; two empty texts are equal, one empty is unlike all others. Not symmetric."""
    if not a or not b:
        return float(not a and not b)
    return SequenceMatcher(None, a, b, autojunk=autojunk).ratio()


class _Text:
    """What bounds the ratio of a text with others, found once: its characters, and hashes of its n-grams, with their counts."""

    GRAMS = (3, 4, 6)

    def __init__(self, text: str):
        self.text = text
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.chars = np.unique(c, return_counts=True)
        # the characters that the matcher's heuristic leaves alone in a second text of 200 or more
        rare = self.chars[1] <= len(text) // 100 + 1
        self.rare = self.chars[0][rare], self.chars[1][rare]
        self.grams = {}
        h = np.zeros(len(c), np.uint64)
        for n in range(1, max(self.GRAMS) + 1):
            if len(c) >= n:
                h = h[: len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :] + np.uint64(1)
            if n in self.GRAMS:
                self.grams[n] = np.unique(h if len(c) >= n else h[:0], return_counts=True)


def _common(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Size of the intersection of two multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    return int(np.minimum(a[1][i], b[1][j]).sum())


def _most(a: _Text, b: _Text, autojunk: bool) -> float:
    """An upper bound of the ratio of a and b.

    Matching blocks hold no more than the common characters. With the matcher's
    heuristic, each block but one at the very beginning holds a rare character of
    b (one that only grew from the corner between two others can't be: the block
    before that corner would have grown over it), so there are r + 1 at most for
    r common ones; a block of s characters has s - n + 1 common n-grams.
    """
    total = len(a.text) + len(b.text)
    most = _common(a.chars, b.chars)
    if autojunk and len(b.text) >= 200:
        blocks = _common(a.chars, b.rare) + 1
        for n in _Text.GRAMS:
            if (n - 1) * blocks < most:
                most = min(most, (n - 1) * blocks + _common(a.grams[n], b.grams[n]))
    return 2 * most / total


#: Texts from this length on are matched by arrays.
LONG = 4000


class _Matcher(SequenceMatcher):
    """The matcher, with places outside the part in question left out by bisection: the plain one passes over all of them for each part."""

    def set_seq2(self, b):
        super().set_seq2(b)
        self.places = {c: np.array(js) for c, js in self.b2j.items()} if len(b) >= LONG else None

    def find_longest_match(self, alo=0, ahi=None, blo=0, bhi=None):
        a, b = self.a, self.b
        i, j, size = self._by_arrays(alo, ahi, blo, bhi) if self.places is not None else self._by_lists(alo, ahi, blo, bhi)
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
            size += 1
        return i, j, size

    def _by_lists(self, alo, ahi, blo, bhi):
        a, b2j, best, before = self.a, self.b2j, (alo, blo, 0), {}
        for i in range(alo, ahi):
            now = {}
            if js := b2j.get(a[i]):
                for j in js[bisect_left(js, blo) : bisect_left(js, bhi)]:
                    k = now[j] = before.get(j - 1, 0) + 1
                    if k > best[2]:
                        best = i - k + 1, j - k + 1, k
            before = now
        return best

    def _by_arrays(self, alo, ahi, blo, bhi):
        a, best, old = self.a, (alo, blo, 0), None
        places = {c: js[bisect_left(js, blo) : bisect_left(js, bhi)] for c, js in self.places.items()}
        before, now = np.zeros(len(self.b) + 1, np.int32), np.zeros(len(self.b) + 1, np.int32)  # [j + 1]: length of the match that ends at j
        for i in range(alo, ahi):
            js = places.get(a[i])
            if js is not None and len(js):
                k = before[js] + 1
                now[js + 1] = k
                x = int(k.max())
                if x > best[2]:
                    best = i - x + 1, int(js[k.argmax()]) - x + 1, x
            else:
                js = None
            if old is not None:
                before[old + 1] = 0
            before, now, old = now, before, js
        return best


def _ratio_from(matcher: SequenceMatcher, least: float) -> float | None:
    """The matcher's ratio if it is at least `least`; given up when what is left to match can't reach it."""
    total = len(matcher.a) + len(matcher.b)
    found, most, left = 0, min(len(matcher.a), len(matcher.b)), [(0, len(matcher.a), 0, len(matcher.b))]
    while left:
        a0, a1, b0, b1 = left.pop()
        i, j, k = matcher.find_longest_match(a0, a1, b0, b1)
        parts = [x for x in ((a0, i, b0, j), (i + k, a1, j + k, b1)) if x[0] < x[1] and x[2] < x[3]] if k else []
        room = [min(x[1] - x[0], x[3] - x[2]) for x in parts]
        found, most = found + k, most - min(a1 - a0, b1 - b0) + k + sum(room)
        if 2.0 * most / total < least:
            return None
        left += [x for _, x in sorted(zip(room, parts, strict=True))]  # the largest part next: it tells most
    r = 2.0 * found / total
    return r if r >= least else None


class _Rows:
    """Texts of a block with figures that bound the ratios of all its pairs at once; characters and n-grams are told apart by hash only, which raises the bounds."""

    CHARS, GRAM = 256, 6

    def __init__(self, rids: list, texts: list[str], places: int):
        self.rids, self.texts, self.size = np.array(rids), texts, np.array([len(t) for t in texts])
        n, c = len(texts), np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        doc = np.repeat(np.arange(n), self.size)
        key, count = np.unique(doc << 32 | c, return_counts=True)
        at = (key >> 32) * self.CHARS + (key & 0xFFFFFFFF) % self.CHARS
        table = lambda w: np.bincount(at, w, n * self.CHARS).reshape(n, self.CHARS).astype(np.int32)
        self.chars, self.rare = table(count), table(np.where(count <= self.size[key >> 32] // 100 + 1, count, 0))
        h, c = np.zeros(max(0, len(c) - self.GRAM + 1), np.uint64), c.astype(np.uint64)
        for k in range(self.GRAM):
            h = h * np.uint64(0x9E3779B97F4A7C15) + c[k : k + len(h)] + np.uint64(1)
        whole = doc[: len(h)] == doc[self.GRAM - 1 :] if len(h) else np.zeros(0, bool)
        h = (h * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(40)).astype(np.int64) % places
        self.grams = np.bincount(doc[: len(h)][whole] * places + h[whole], minlength=n * places).reshape(n, places).astype(np.float32)
        self.exact: dict[int, _Text] = {}

    def text(self, i: int) -> _Text:
        if i not in self.exact:
            self.exact[i] = _Text(self.texts[i])
        return self.exact[i]


def _similar(x: _Rows, y: _Rows, least: float, kept_second: bool, autojunk: bool) -> list[tuple[int, int, float]]:
    """(first, second, ratio) of the pairs of x and y (or within x, if it is y) that reach `least`. No text is empty."""
    both = x.size[:, None] + y.size
    near = 2 * np.minimum(x.size[:, None], y.size) / both >= least
    if x is y:
        near &= np.arange(len(x.size))[:, None] < np.arange(len(x.size))
    grams = np.minimum(x.grams @ (y.grams > 0).astype(np.float32).T, (x.grams > 0).astype(np.float32) @ y.grams.T) if autojunk and near.any() else None
    by_second: dict[tuple[bool, int], list[int]] = {}
    for i in np.flatnonzero(near.any(1)):
        js = np.flatnonzero(near[i])
        most = np.minimum(x.chars[i], y.chars[js]).sum(1)
        js, most = js[keep := 2 * most / both[i, js] >= least], most[keep]
        second = (y.rids[js] < x.rids[i]) == kept_second  # y's row is the matcher's second text
        if autojunk and len(js):
            r = np.where(second, np.minimum(x.chars[i], y.rare[js]).sum(1), np.minimum(x.rare[i], y.chars[js]).sum(1))
            bound = (_Rows.GRAM - 1) * (r + 1) + grams[i, js]
            most = np.where(np.where(second, y.size[js], x.size[i]) >= 200, np.minimum(most, bound), most)
            js, second = js[keep := 2 * most / both[i, js] >= least], second[keep]
        for j, s in zip(js.tolist(), second.tolist(), strict=True):
            by_second.setdefault((s, j if s else int(i)), []).append(int(i) if s else j)
    out = []
    for (s, k), others in by_second.items():
        mine, theirs = (y, x) if s else (x, y)
        matcher = _Matcher(None, "", mine.texts[k], autojunk=autojunk)  # what it finds out about its second text serves all
        for o in others:
            if _most(theirs.text(o), mine.text(k), autojunk) >= least:
                matcher.set_seq1(theirs.texts[o])
                if (r := _ratio_from(matcher, least)) is not None:
                    a, b = int(mine.rids[k]), int(theirs.rids[o])
                    out.append((min(a, b), max(a, b), r))
    return out


def first_copies(df: DataFrame) -> DataFrame:
    """rid and first, the first row with the same title (null being one) and text (null being empty)."""
    keyed = df.select("rid", "title", F.sha2(F.coalesce("doc", F.lit("")), 256).alias("h"))
    first = keyed.groupBy(F.col("title").alias("_t"), F.col("h").alias("_h")).agg(F.min("rid").alias("first"))
    return keyed.join(first, (F.col("h") == F.col("_h")) & F.col("title").eqNullSafe(F.col("_t"))).select("rid", "first")


def similar_pairs(df: DataFrame, least: float = 0.8, kept_second: bool = True, autojunk: bool = True) -> DataFrame:
    """(first, second, similarity) of rows with the same title (null being one), different texts and a ratio of at least `least`.

    Titles that occur once are left out natively. The rows of a title with more
    than BLOCK, or than BLOCK_CHARS characters, are cut by length into bands, and by hash into blocks; pairs of blocks whose
    lengths allow a likeness are compared in tasks of their own, so a very common
    title is spread. Within a task bounds of all pairs are figured at once, and
    few are left to the matcher. Equal texts must be collapsed before.
    kept_second: the ratio of (later, earlier), else of (earlier, later).
    """
    # the longer of two texts has at most (2 - least) / least times the characters of the other
    reach = math.floor(math.log((2 - least) / least) / math.log(STEP)) + 1 if least > 0 else None
    size = F.length("doc")
    band = F.floor(F.log(size) / math.log(STEP)).cast("int") if reach is not None else F.lit(0)
    slim = df.select("rid", "title", F.coalesce("doc", F.lit("")).alias("doc")).where(size > 0)  # an empty text is like no other one
    often = slim.groupBy("title").agg(F.count("*").alias("_n"), F.sum(size).alias("_s")).where("_n > 1").select(F.col("title").alias("_t"), ((F.col("_n") > BLOCK) | (F.col("_s") > BLOCK_CHARS)).alias("_cut"))
    slim = slim.join(often, F.col("title").eqNullSafe(F.col("_t"))).select("rid", "title", "doc", F.when(F.col("_cut"), band).otherwise(0).alias("band"), "_cut")
    fits = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_CHARS) / F.max(size)).cast("int")))
    sizes = slim.groupBy("title", "band").agg(F.count("*").alias("n"), F.when(F.bool_or("_cut"), fits).otherwise(BLOCK).alias("fits")).select("title", "band", "n", F.ceil(F.col("n") / F.col("fits")).cast("int").alias("blocks"))
    sizes = materialised(sizes)  # a row for each title and length
    other = sizes.select(F.col("title").alias("_t"), F.col("band").alias("_b"), F.col("n").alias("_n"), F.col("blocks").alias("_blocks"))
    around = sizes.withColumn("_o", F.explode(F.sequence(F.col("band") - (reach or 0), F.col("band") + (reach or 0))))
    met = around.join(other, F.col("title").eqNullSafe(F.col("_t")) & (F.col("_o") == F.col("_b")))
    met = met.groupBy("title", "band", "blocks").agg(F.sum("_n").alias("_n"), F.collect_list(F.struct("_b", "_blocks")).alias("_all")).where("_n > 1")
    met = met.select(F.col("title").alias("_t"), F.col("band").alias("_band"), "blocks", "_all")
    code = lambda b, k: b.cast("long") * (1 << 32) + k
    every = F.flatten(F.transform("_all", lambda o: F.transform(F.sequence(F.lit(0), o["_blocks"] - 1), lambda k: code(o["_b"], k))))
    cut = slim.join(met, F.col("title").eqNullSafe(F.col("_t")) & (F.col("band") == F.col("_band"))).withColumn("block", code(F.col("band"), F.pmod(F.xxhash64("rid"), F.col("blocks"))))
    cut = cut.withColumn("_o", F.explode(every)).select("title", F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j"), "block", "rid", "doc")
    # as many parts as the session has: their bytes don't tell how long they take
    cut = cut.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "title", "i", "j")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = rows.i.iloc[0], rows.j.iloc[0]
        places = 1 << max(10, min(17, (3 * int(rows.doc.str.len().max())).bit_length(), (CELLS // len(rows)).bit_length() - 1))
        made = {b: _Rows(part.rid.tolist(), part.doc.tolist(), places) for b, part in rows.groupby("block")} if len(rows) > 1 and (i == j or rows.block.nunique() == 2) else {}
        return pd.DataFrame(_similar(made[i], made[j], least, kept_second, autojunk) if made else [], columns=["first", "second", "similarity"])

    return cut.groupBy("title", "i", "j").applyInPandas(compare, "first long, second long, similarity double")


def drop_similar(df: DataFrame, least: float = 0.8, autojunk: bool = True) -> tuple[DataFrame, DataFrame]:
    """Greedy by row: a row goes if it is like an earlier row of its title that stayed; (kept rows, log).

    The log names the first such row. Copies of an earlier row always go, and
    say nothing that their first doesn't, so only first copies are compared.
    They are settled in rounds: a row whose earlier similar rows all went stays;
    one with a similar row that stays goes. Every round settles the first open
    row of each title at least. Kept rows carry group_rid, the first row of their
    title: order by (group_rid, rid) for groups in order of appearance.
    """
    copies = materialised(first_copies(df))
    ones = df.join(copies.where("rid = first").select("rid"), "rid", "left_semi")
    pairs = materialised(similar_pairs(ones, least, True, autojunk))
    fate = materialised(pairs.groupBy(F.col("second").alias("rid")).agg(F.min("first")).select("rid", F.lit(None).cast("boolean").alias("gone")))
    while fate.where("gone is null").limit(1).count():
        known = pairs.join(fate.select(F.col("rid").alias("first"), "gone", F.lit(True).alias("_open")), "first", "left")
        # an earlier row without an entry never had a similar one: it stays
        state = F.when(F.col("_open").isNull(), F.lit(False)).otherwise(F.col("gone"))
        told = known.select(F.col("second").alias("rid"), state.alias("s")).groupBy("rid").agg(F.count(F.when(F.col("s") == F.lit(False), 1)).alias("stay"), F.count(F.when(F.col("s").isNull(), 1)).alias("open"))
        verdict = F.when(F.col("stay") > 0, True).when(F.col("open") == 0, False)
        fate = materialised(told.select("rid", verdict.alias("gone")))
    gone = fate.where("gone").select("rid")
    kept = ones.join(gone, "rid", "left_anti")
    group = df.groupBy(F.col("title").alias("_t")).agg(F.min("rid").alias("group_rid"))
    kept = kept.join(group, F.col("title").eqNullSafe(F.col("_t"))).drop("_t")
    by = pairs.join(gone.withColumnRenamed("rid", "second"), "second").join(gone.withColumnRenamed("rid", "first"), "first", "left_anti")
    by = by.groupBy(F.col("second").alias("first")).agg(F.min(F.struct("first", "similarity")).alias("m"))
    # a copy of a kept row went by that one, a copy of one that went by the same as it
    gone_by = copies.join(by, "first", "left").where("rid <> first or m is not null")
    gone_by = gone_by.select("rid", F.coalesce("m.first", "first").alias("kept_index"), F.coalesce("m.similarity", F.lit(1.0)).alias("similarity"))
    rows = df.select("rid", "title", "date", "section")
    log = gone_by.join(rows, "rid").select(F.col("rid").alias("removed_index"), "kept_index", "title", F.round("similarity", 4).alias("similarity"), "date", "section")
    return kept, log


def drop_any_similar(df: DataFrame, least: float = 0.8, autojunk: bool = True) -> DataFrame:
    """Without rows that are like any earlier row of their title, even one that goes itself; rows without a title stay."""
    titled = df.where(F.col("title").isNotNull())
    copies = materialised(first_copies(titled))
    pairs = similar_pairs(titled.join(copies.where("rid = first").select("rid"), "rid", "left_semi"), least, False, autojunk)
    gone = copies.where("rid <> first").select("rid").unionByName(pairs.select(F.col("second").alias("rid")))
    return df.join(gone.distinct(), "rid", "left_anti")


def dedupe_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropDuplicates(columns)
