"""Row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nested, values
from ..functions.text import strip, text_or_empty


def min_length(df: DataFrame, column: str = "doc", least: int = 5) -> DataFrame:
    return df.where(F.length(column) >= least)


def with_text(df: DataFrame, section: str = "section", text: str = "doc") -> DataFrame:
    return df.where(F.col(section).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0))


def complete_comment_meta(cap: int = 0) -> Column:
    """Whether a crawled row has title, content, a like count and complete comments."""
    said = lambda c: strip(text_or_empty(F.col(c))) != ""
    liked = values.parse_int(F.col("post_like_count"), None).isNotNull() | values.parse_int(F.col("like_count"), None).isNotNull()
    comments = nested.complete_comments(F.col("comments_text"), F.col("comment_times"), F.col("comment_like_counts"), F.col("comment_count"), cap)
    return said("title") & said("content") & liked & comments


def complete_comment_rows(df: DataFrame, cap: int = 0) -> tuple[DataFrame, DataFrame]:
    """Complete rows, and one row with the number removed."""
    good = F.coalesce(complete_comment_meta(cap), F.lit(False))
    return df.where(good), df.agg(F.count(F.when(~good, 1)).alias("removed"))


def with_keywords(df: DataFrame, keywords: list[str], blank_too: bool = False) -> DataFrame:
    """Rows of the given keywords; a frame without keywords stays as it is."""
    if "keyword" not in df.columns:
        return df
    k = F.col("keyword")
    return df.where((F.trim(F.coalesce(k, F.lit(""))) == "") | k.isin(keywords) if blank_too else k.isin(keywords))


def to_reparse(df: DataFrame, complete: bool = False, cap: int = 0, most: int | None = None, order: str = "rid") -> DataFrame:
    """Rows with comments whose comment columns are missing (or incomplete), the first `most` of them."""
    missing = (strip(text_or_empty(F.col("comment_times"))) == "") | (strip(text_or_empty(F.col("comment_like_counts"))) == "")
    wanted = ~F.coalesce(complete_comment_meta(cap), F.lit(False)) if complete else missing
    out = df.where(wanted & (F.coalesce(values.to_number(F.col("comment_count")), F.lit(0.0)) > 0))
    return out.orderBy(order).limit(most) if most else out


def with_url(df: DataFrame, column: str = "canonical_url") -> DataFrame:
    return df.where(F.col(column).isNotNull() & (F.col(column) != ""))


def changed(before: list[str], after: list[str]) -> Column:
    """Whether any of several columns differs from its partner, nulls being equal to nulls."""
    out = F.lit(False)
    for a, b in zip(before, after, strict=True):
        out = out | ~F.col(a).eqNullSafe(F.col(b))
    return out


def accepted(df: DataFrame) -> DataFrame:
    """Rows with a title or a content."""
    return df.where(~((F.coalesce("title", F.lit("")) == "") & (F.coalesce("content", F.lit("")) == "")))


def among_top(df: DataFrame, top: DataFrame, key: str = "keyword") -> DataFrame:
    return df.join(top.select(key).distinct(), key, "left_semi")


def by_pos(tokens: Column, tags: list[str], least: int = 1) -> Column:
    """Forms of the tokens with one of the tags and at least `least` characters."""
    return F.transform(F.filter(tokens, lambda t: t["tag"].isin(tags) & (F.length(t["form"]) >= least)), lambda t: t["form"])
