"""Comments and token arrays: higher-order functions over nested columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text, values

COMMENT = "struct<comment_content:string,comment_like:bigint,comment_date:string>"
_RAW = "array<struct<comment_content:string,content:string,comment_like:string,comment_date:string>>"
_CRAWLED = "array<struct<text:string,time:string,like_count:string>>"


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def parse_json_array(c: Column, kind: str) -> Column:
    """A JSON array as a nested column; null, blank, broken text and other JSON values are empty arrays."""
    return F.coalesce(F.from_json(F.when(c.rlike(r"^\s*\["), c), kind), _empty(kind))


def parse_comments(c: Column) -> Column:
    """Comments from JSON text: content, like (as text, cleaned later), date."""
    return F.transform(
        parse_json_array(c, _RAW),
        lambda x: F.struct(x["comment_content"].alias("comment_content"), x["comment_like"].alias("comment_like"), x["comment_date"].alias("comment_date")),
    )


def _comment(content: Column, like: Column, day: Column) -> Column:
    return F.struct(content.alias("comment_content"), like.alias("comment_like"), day.alias("comment_date"))


def clean_comments(c: Column, entities: bool = False) -> Column:
    """Every comment with cleaned content, whole likes and a stripped date.

    A Python function can't run inside an array: where contents hold entities,
    unescape the JSON text before it is parsed.
    """
    return F.transform(c, lambda x: _comment(text.clean_noise(x["comment_content"], entities), values.to_int(x["comment_like"]), text.strip(text.text_or_empty(x["comment_date"]))))


def clean_comments_strict(json: Column) -> Column:
    """Comments by the second cleaner, with `content` where `comment_content` is missing, without those left empty."""
    parts = F.filter(parse_json_array(json, "array<string>"), lambda x: x.startswith("{"))  # what is no object is skipped
    cleaned = F.transform(
        F.transform(parts, lambda x: F.from_json(x, _RAW[len("array<") : -1])),
        lambda x: _comment(text.clean_strict(F.coalesce(x["comment_content"], x["content"])), values.to_int(x["comment_like"]), text.text_or_empty(x["comment_date"])),
    )
    return F.filter(cleaned, lambda x: x["comment_content"] != "")


def normalize_comments(c: Column) -> Column:
    """Comments with stripped content, whole likes, and dates as yyyy-MM-dd."""
    return F.transform(c, lambda x: _comment(text.strip(text.text_or_empty(x["comment_content"])), values.to_int(x["comment_like"]), values.normalize_date(x["comment_date"])))


def split_delimited(c: Column) -> Column:
    """Stripped, non-empty parts between double bars."""
    return F.filter(F.transform(F.split(text.text_or_empty(c), r"\s*\|\|\s*"), lambda x: F.trim(x)), lambda x: x != "")


def join_delimited(c: Column) -> Column:
    return F.array_join(c, " || ")


def split_options(c: Column) -> Column:
    """Distinct, stripped, non-empty parts between commas or bars, in order of appearance."""
    return F.array_distinct(F.filter(F.transform(F.split(text.text_or_empty(c), r"[,|]"), lambda x: text.collapse_ws(x)), lambda x: x != ""))


def build_comments(json: Column, contents: Column, times: Column, likes: Column) -> Column:
    """Comments from JSON where there is some, else from three delimited columns, padded to the longest.

    A null text column counts as empty.
    """
    from_json = F.transform(parse_json_array(json, _CRAWLED), lambda x: _comment(text.strip(text.text_or_empty(x["text"])), values.to_int(x["like_count"]), values.normalize_date(x["time"])))
    zipped = F.arrays_zip(split_delimited(contents).alias("a"), split_delimited(times).alias("b"), split_delimited(likes).alias("c"))
    from_text = F.transform(zipped, lambda x: _comment(text.text_or_empty(x["a"]), values.to_int(x["c"]), values.normalize_date(x["b"])))
    return F.when(text.strip(text.text_or_empty(json)) != "", from_json).otherwise(from_text)


def first_content(c: Column) -> Column:
    return F.coalesce(F.try_element_at(c, F.lit(1))["comment_content"], F.lit(""))


def contents(c: Column) -> Column:
    return F.transform(c, lambda x: x["comment_content"])


def parse_string_list(c: Column) -> Column:
    """A list of texts written as JSON or with single quotes; else empty."""
    return parse_json_array(c, "array<string>")


def flatten_tokens(c: Column) -> Column:
    """One level flatter; null lists count as empty."""
    return F.flatten(F.transform(F.coalesce(c, _empty("array<array<string>>")), lambda x: F.coalesce(x, _empty("array<string>"))))


def flatten_mixed(c: Column) -> Column:
    """One level flatter, for JSON lists that mix texts and lists of texts."""
    parts = parse_json_array(c, "array<string>")
    inner = lambda x: F.when(x.startswith("["), parse_json_array(x, "array<string>")).otherwise(F.array(x))
    return F.flatten(F.transform(parts, inner))


def concat_tokens(*arrays: Column) -> Column:
    return F.concat(*(F.coalesce(a, _empty("array<string>")) for a in arrays))


def without(tokens: Column, stop: Column, least: int = 1) -> Column:
    """Tokens of at least `least` characters that are not in a stop list; order and repetitions stay."""
    return F.filter(tokens, lambda w: ~F.array_contains(stop, w) & (F.length(w) >= least))


def without_nested(tokens: Column, stop: Column, least: int = 1) -> Column:
    return F.transform(tokens, lambda inner: without(inner, stop, least))


def complete_comments(contents_: Column, times: Column, likes: Column, count: Column, cap: int = 0) -> Column:
    """Whether the delimited comment columns are there, equally long, with readable likes, and no more than cap (0: any)."""
    a, b, c = split_delimited(contents_), split_delimited(times), split_delimited(likes)
    size = F.size(a)
    good = (values.parse_int(count) > 0) & (size > 0) & (F.size(b) == size) & (F.size(c) == size) & F.forall(c, lambda x: values.parse_int(x, None).isNotNull())
    return good & (size <= cap) if cap else good
