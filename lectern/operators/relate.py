"""Joins, set operations, order and limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def left_lookup(df: DataFrame, names: DataFrame, *on: str) -> DataFrame:
    return df.join(names, list(on), "left")


def unseen(candidates: DataFrame, done: DataFrame, key: str = "canonical_url") -> DataFrame:
    """Candidates whose key isn't done yet; null keys stay."""
    return candidates.join(done.select(key).distinct(), key, "left_anti")


def attach(parsed: DataFrame, links: DataFrame, key: str = "canonical_url") -> DataFrame:
    """Parsed rows with their link's columns; where both have a column, the link's wins."""
    clash = [c for c in parsed.columns if c in links.columns and c != key]
    return parsed.drop(*clash).join(links, key)


def update_columns(df: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with given columns replaced by those of the new rows with the same key; the rest as it was."""
    fresh = new.select(key, F.lit(True).alias("_new"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = df.join(fresh, key, "left")
    pick = [F.when(F.col("_new"), F.col(f"_new_{c}")).otherwise(F.col(f"`{c}`")).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns]
    return out.select(*pick)


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def union_sets(*frames: DataFrame, column: str = "keyword") -> DataFrame:
    return reduce(DataFrame.union, [f.select(column) for f in frames]).distinct()


def next_row(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Each row with the next one's columns as next_...; for tables of one row a section."""
    w = Window.orderBy(order)
    return df.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])


def overlap(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Sorted common, new (in b) and gone (in a) elements of two arrays."""
    return F.array_sort(F.array_intersect(a, b)), F.array_sort(F.array_except(b, a)), F.array_sort(F.array_except(a, b))


def venn(a: DataFrame, b: DataFrame, key: str = "keyword") -> DataFrame:
    """Sizes of the three regions of two sets, in one pass over both."""
    marked = a.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).union(b.select(key, F.lit(0), F.lit(1)))
    sides = marked.groupBy(key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return sides.agg(count((F.col("_a") == 1) & (F.col("_b") == 0), "only_a"), count((F.col("_a") == 0) & (F.col("_b") == 1), "only_b"), count((F.col("_a") == 1) & (F.col("_b") == 1), "both"))


def first_rows(df: DataFrame, n: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(n)


def first_of_each(df: DataFrame, n: int, by: list[str], *order, rank: str | None = None) -> DataFrame:
    """The first n rows of each group; Spark limits each task's rows before the shuffle."""
    out = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n)
    return out.withColumnRenamed("_r", rank) if rank else out.drop("_r")


def seeded_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows, the same ones for the same seed on any cluster."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def snapshots_largest(df: DataFrame, key: list[str], links: str = "links", most: int | None = None) -> DataFrame:
    """The longest list of links seen for each query, cut to the first `most`."""
    out = df.groupBy(*key).agg(F.max_by(links, F.size(links)).alias(links))
    return out.withColumn(links, F.slice(links, 1, most)) if most else out


def link_rows(df: DataFrame, links: str = "links") -> DataFrame:
    """One row for each link, with canonical and mobile address."""
    from ..functions.urls import to_mobile_url

    rest = [c for c in df.columns if c != links]
    return df.select(*rest, F.explode(links).alias("canonical_url")).withColumn("url", to_mobile_url(F.col("canonical_url")))
