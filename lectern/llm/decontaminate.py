"""Benchmark decontamination: size-partitioned MinHash containment search, native.

Which documents hold at least `least` of a benchmark item's distinct word
shingles? Items are partitioned by the power of two of their number q of
shingles. A document holding `least` of an item misses m(q) = floor((1 - least)
* q) of its shingles at most, so of the item's MinHash signature, its m(q) + c
shingles of smallest hash, it holds c at least. c grows with the partition (1
below 16 shingles, 2 below 32, 3 below 64, then 4): long items need more evidence to
become candidates. A partition's threshold is the largest hash in any of its
signatures; a document's MinHash sketch for the partition are its shingles with
hashes up to that. So a sketch is a fixed share of a document, however long, and
the search has no false negatives.

(Signatures of fixed length, cut into bands, would have to tell Jaccard
similarities of 0.002 apart, since a short item is a tiny part of a long
document; the README has their recall by document size.)

Documents' sketches are looked up in the signatures; every candidate pair is
then verified exactly, shingle by shingle, as text. The items' tables are
broadcast only if they have at most `broadcast_rows` shingles; above, a filter
of bounded size goes before the lookups, which shuffle.

Words are runs of letters and digits, lower-cased. Items of fewer than `words`
words are looked up as one shingle of their own length.

Defined results: null or empty texts, or ones without words, match nothing;
ties and repeated rows: a document id or item id that occurs twice counts with
the union of its rows' shingles; rows with a null id take no part; extra
columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, maybe_among, named, spare, without

#: Most shingles of all items with which they, and the signatures among them, are broadcast: words of text each.
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hashes(k: int) -> Column:
    """xxhash64 of each run of k words of column ws."""
    run = ", ".join(f"ws[i + {j}]" for j in range(k))
    return F.expr(f"CASE WHEN size(ws) >= {k} THEN transform(sequence(0, greatest(size(ws) - {k}, 0)), i -> xxhash64({run})) END")


def _strings(k: int) -> Column:
    """Each run of k words of column ws as text."""
    run = ", ".join(f"ws[i + {j}]" for j in range(k))
    return F.expr(f"CASE WHEN size(ws) >= {k} THEN transform(sequence(0, greatest(size(ws) - {k}, 0)), i -> concat_ws(' ', {run})) END")


def item_shingles(items: DataFrame, words: int) -> tuple[DataFrame, list[int]]:
    """item_id, len, shingle (distinct), q of the items, and the shingle lengths that occur."""
    ws = items.select(F.col("item_id").cast("long").alias("item_id"), words_of(F.col("text")).alias("ws")).where(F.col("item_id").isNotNull() & (F.size("ws") > 0))
    ws = ws.withColumn("len", F.least(F.size("ws"), F.lit(words)))
    lengths = sorted(r.len for r in ws.select("len").distinct().collect())  # at most `words` values
    parts = [ws.where(F.col("len") == k).select("item_id", "len", F.explode(_strings(k)).alias("shingle")) for k in lengths]
    if not parts:
        return ws.selectExpr("item_id", "len", "'' shingle", "1L q").where("false"), []
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.distinct()
    sizes = rows.groupBy("item_id").agg(F.count("*").alias("q"))
    return rows.join(sizes, "item_id"), lengths


def contained(docs: DataFrame, items: DataFrame, words: int = 5, least: float = 0.8, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, item_id, n_shared, n_item and containment of all pairs with containment of at least `least`.

    docs: doc_id, text; items: item_id, text.
    """
    shingles, lengths = item_shingles(items, words)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    if not lengths:
        return docs.selectExpr("doc_id", "0L item_id", "0L n_shared", "0L n_item", "0d containment").where("false")
    scratch = Scratch(docs.sparkSession)
    shingles = scratch.write(shingles, "shingles")  # read four times below
    # an item's shingles meet by nature: one text of the benchmark
    ranked = []
    for k in lengths:
        part = shingles.where(F.col("len") == k).withColumn("ws", F.split("shingle", " "))
        ranked.append(part.select("item_id", "len", "q", F.expr("xxhash64(" + ", ".join(f"ws[{j}]" for j in range(k)) + ")").alias("h")))
    signatures = ranked[0]
    for p in ranked[1:]:
        signatures = signatures.unionByName(p)
    missed = F.floor(F.round((1 - F.lit(least)) * F.col("q"), 6)).cast("int")
    needed = F.when(F.col("q") < 16, 1).when(F.col("q") < 32, 2).when(F.col("q") < 64, 3).otherwise(4)
    signatures = signatures.groupBy("item_id", "q").agg(F.array_sort(F.collect_set("h")).alias("hs"))
    signatures = signatures.select("item_id", F.floor(F.log2("q")).alias("part"), needed.alias("needed"), F.explode(F.slice("hs", F.lit(1), missed + needed)).alias("h"))
    signatures = scratch.write(signatures, "signatures")
    # thresholds of the partitions: a few rows, as sizes are powers of two
    highest = {r.part: r.h for r in signatures.groupBy("part").agg(F.max("h").alias("h")).collect()}
    keys = signatures.select("h").distinct()
    n_keys = shingles.count()
    small = n_keys <= broadcast_rows

    def among(rows: DataFrame, other: DataFrame, on: str) -> DataFrame:
        if small:
            return rows.join(F.broadcast(other), on, "left_semi")
        return maybe_among(rows, on, other, n_keys).join(other, on, "left_semi")

    def lookup(rows: DataFrame, other: DataFrame, on: str) -> DataFrame:
        return rows.join(F.broadcast(other) if small else other, on)

    worded = docs.select("doc_id", words_of(F.col("text")).alias("ws"))
    arrays = [F.coalesce(_hashes(k), F.array().cast("array<bigint>")) for k in lengths]
    # sketches are nested, so the one of the highest threshold holds all others
    sketch = F.array_distinct(F.filter(F.flatten(F.array(*arrays)) if len(arrays) > 1 else arrays[0], lambda h: h <= max(highest.values())))
    hits = among(worded.select("doc_id", F.explode(sketch).alias("h")), keys, "h")
    found = lookup(hits, signatures, "h").groupBy("doc_id", "item_id", "needed").agg(F.size(F.collect_set("h")).alias("n")).where("n >= needed")
    # written, as three parts of the rest read it; a few rows for each document that may hold an item
    pairs = scratch.write(found.select("doc_id", "item_id").distinct(), "candidates")
    # exact: the shingles, as text, of documents that are candidates; only those that some item has go on
    candidates = pairs.select("doc_id").distinct()
    texts = maybe_among(docs, "doc_id", candidates, pairs.count()).join(candidates, "doc_id", "left_semi").select("doc_id", words_of(F.col("text")).alias("ws"))
    runs = [F.coalesce(_strings(k), F.array().cast("array<string>")) for k in lengths]
    spoken = texts.select("doc_id", F.explode(F.flatten(F.array(*runs)) if len(runs) > 1 else runs[0]).alias("shingle"))
    held = among(spoken, shingles.select("shingle").distinct(), "shingle").distinct()
    shared = lookup(held, shingles.select("shingle", "item_id", "q"), "shingle").join(pairs, ["doc_id", "item_id"], "left_semi")
    out = shared.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"), F.first("q").alias("n_item"))
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item")).where(F.col("n_shared") >= F.round(F.lit(least) * F.col("n_item"), 6))


def decontaminate(docs: DataFrame, items: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of docs, with all their columns, that hold `least` of no item; rows with a null id stay. Extra columns may have any name."""
    key, hit_key = spare(docs.columns, "key", "hit")
    found = contained(docs.select("doc_id", "text"), items, words, least).select(F.col("doc_id").alias(hit_key)).distinct()
    hit = Scratch(docs.sparkSession).write(found, "hits")
    return without(docs.withColumn(key, F.col("doc_id").cast("long")), key, hit, hit.count()).select(named(docs))
