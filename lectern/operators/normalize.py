"""From crawled or prepared rows to the prepared schema, and schema evolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nested, values
from ..functions.text import text_or_empty
from ..functions.urls import canonical_post_url
from ..functions.values import PERIODS
from ..schemas import CRAWLED, PREPARED
from ..session_scratch import materialised


def is_prepared(df: DataFrame) -> bool:
    return set(PREPARED) <= set(df.columns)


def first_present(df: DataFrame, *names: str, default: Column | None = None) -> Column:
    """The first of several columns that a frame has, found when the plan is made."""
    for n in names:
        if n in df.columns:
            return F.col(f"`{n}`")
    return default if default is not None else F.lit(None).cast("string")


def _comments(df: DataFrame, name: str = "comment_list") -> Column:
    """A comment column, nested already or still JSON text."""
    return F.col(name) if dict(df.dtypes)[name].startswith("array") else nested.parse_comments(F.col(name))


def in_sections(df: DataFrame, periods=PERIODS) -> DataFrame:
    return df.where(F.col("section").isin([p[0] for p in periods]))


def prepare(df: DataFrame, periods=PERIODS, keep: tuple[str, ...] = ()) -> DataFrame:
    """The prepared schema of crawled rows or of rows that have it already; only rows of a known section stay.

    Crawled rows get their dates rewritten; prepared ones keep theirs as they are.
    keep: further columns, such as rid, that go along in front.
    """
    if is_prepared(df):
        out = df.select(
            *keep,
            text_or_empty(F.col("title")).alias("title"),
            text_or_empty(F.col("doc")).alias("doc"),
            values.to_int(F.col("like")).alias("like"),
            values.to_int(F.col("comment_cnt")).alias("comment_cnt"),
            nested.normalize_comments(_comments(df)).alias("comment_list"),
            text_or_empty(F.col("ch")).alias("ch"),
            text_or_empty(F.col("date")).alias("date"),
            values.normalize_section(F.col("section"), F.col("date"), periods).alias("section"),
        )
        return in_sections(out, periods)
    day = first_present(df, "date", "post_date")
    dated = any(c in df.columns for c in ("section", "date", "post_date"))
    section = values.normalize_section(F.col("section") if "section" in df.columns else None, day, periods) if dated else F.lit(0)
    out = df.select(
        *keep,
        text_or_empty(F.col("title")).alias("title"),
        text_or_empty(F.col("content")).alias("doc"),
        values.to_int(first_present(df, "post_like_count", "like_count")).alias("like"),
        values.to_int(first_present(df, "comment_count")).alias("comment_cnt"),
        nested.build_comments(*(first_present(df, c) for c in ("comments_json", "comments_text", "comment_times", "comment_like_counts"))).alias("comment_list"),
        values.map_channel(first_present(df, "source")).alias("ch"),
        values.normalize_date(day).alias("date"),
        section.alias("section"),
    )
    return in_sections(out, periods)


def backfill_columns(df: DataFrame, source: str = "", columns: list[str] = CRAWLED) -> DataFrame:
    """Rows of an older schema with all columns of the current one."""
    have = set(df.columns)
    new = {}
    if "canonical_url" not in have:
        new["canonical_url"] = canonical_post_url(F.col("url")) if "url" in have else F.lit("")
    for a, b in (("post_like_count", "like_count"), ("like_count", "post_like_count")):
        if a not in have and b in have:
            new[a] = F.col(b)
    if "search_date" not in have and "date" in have:
        new["search_date"] = F.col("date")
    for c in columns:
        if c not in have and c not in new:
            new[c] = F.lit("")
    out = df.withColumns(new) if new else df
    return out.withColumn("source", F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit(source)))


def with_defaults(df: DataFrame, **defaults) -> DataFrame:
    """Columns that are missing, with a fixed value."""
    new = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(new) if new else df


def rename(df: DataFrame, **names: str) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def with_rid(df: DataFrame, *order: str, name: str = "rid") -> DataFrame:
    """Rows numbered from 0 in a given order, without a task that sees them all.

    Rows are dealt by ranges of the order; a range's numbers begin after the
    counts of the ranges before it. Ties need a further column to be stable.
    """
    # written once: the ranges must stay what they are for the counts to fit
    ranged = materialised(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    out = ranged.withColumn("_i", within).join(F.broadcast(before), "_p")
    return out.select((F.col("_i") + F.col("_b")).alias(name), *[F.col(f"`{c}`") for c in df.columns])
