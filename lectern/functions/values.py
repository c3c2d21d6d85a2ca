"""Numbers, dates, sections and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, text_or_empty

#: The calendar sections (number, name, first day, last day). Every function takes its own table as well.
PERIODS = [
    (1, "1구간", "2024-01-01", "2024-03-31"),
    (2, "2구간", "2024-04-01", "2024-06-30"),
    (3, "3구간", "2024-07-01", "2024-12-31"),
    (4, "4구간", "2025-01-01", "2025-06-30"),
]
SECTION_NAMES = {1: "1구간 (2024.01~03)", 2: "2구간 (2024.04~06)", 3: "3구간 (2024.07~12)", 4: "4구간 (2025.01~06)"}


def to_int(c: Column, default: int = 0) -> Column:
    """A whole number out of text: commas and one final .0 go; what is still no number is reduced to its digits (1.5 gives 15)."""
    t = F.regexp_replace(F.regexp_replace(strip(text_or_empty(c)), ",", ""), r"\.0$", "")
    whole = F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint"))
    digits = F.nullif(F.regexp_replace(t, "[^0-9]", ""), F.lit("")).try_cast("bigint")
    return F.coalesce(whole, digits, F.lit(default).cast("bigint"))


def parse_int(c: Column, default: int | None = 0) -> Column:
    """The digits of a text as one number; a sign is lost."""
    return F.coalesce(F.nullif(F.regexp_replace(text_or_empty(c), "[^0-9]", ""), F.lit("")).try_cast("bigint"), F.lit(default).cast("bigint"))


def to_number(c: Column) -> Column:
    """A number or null."""
    return strip(text_or_empty(c)).try_cast("double")


def to_count(c: Column) -> Column:
    """A number without its fraction, 0 where there is none."""
    return F.coalesce(to_number(c), F.lit(0.0)).cast("int")


def parse_date(c: Column) -> Column:
    """The local date that a text begins with, or null: 20240131, 2024-01-31..., 2024.01.31., 2024/1/31."""
    t = F.regexp_replace(strip(text_or_empty(c)), r"\.0$", "")
    compact = F.when(t.rlike(r"^\d{8}$"), F.try_to_date(t, "yyyyMMdd"))
    part = lambda i: F.regexp_extract(t, r"^(\d{4})[-./] ?(\d{1,2})[-./] ?(\d{1,2})(?:\D|$)", i)
    split = F.concat(part(1), F.lit("-"), F.lpad(part(2), 2, "0"), F.lit("-"), F.lpad(part(3), 2, "0"))
    return F.coalesce(compact, F.when(part(1) != "", F.try_to_date(split, "yyyy-MM-dd")))


def normalize_date(c: Column) -> Column:
    """yyyy-MM-dd, or an empty text."""
    return F.coalesce(F.date_format(parse_date(c), "yyyy-MM-dd"), F.lit(""))


def section_of_date(day: Column, periods=PERIODS) -> Column:
    """Number of the period that holds a date, else 0."""
    out = F.lit(0)
    for number, _, first, last in reversed(periods):
        out = F.when(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")), number).otherwise(out)
    return out


def normalize_section(section: Column | None, day: Column | None, periods=PERIODS) -> Column:
    """A section's own number if it is one of the periods', else that of its date, else 0."""
    by_date = section_of_date(parse_date(day), periods) if day is not None else F.lit(0)
    if section is None:
        return by_date
    own = to_int(section)
    return F.when(own.isin([p[0] for p in periods]), own.cast("int")).otherwise(by_date).cast("int")


def map_channel(c: Column) -> Column:
    """blog, cafe, or the lower-cased text."""
    t = F.lower(strip(text_or_empty(c)))
    blog, cafe = t.contains("blog") | t.contains("블로그"), t.contains("cafe") | t.contains("카페")
    return F.when(blog, "blog").when(cafe, "cafe").otherwise(t)


def label(c: Column, names: dict) -> Column:
    """Name of a value by a fixed map; null where it has none."""
    out = None
    for k, v in names.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out if out is not None else F.lit(None).cast("string")


def day_of_millis(c: Column) -> Column:
    """yyyyMMdd of milliseconds since 1970 in the session's time zone; else an empty text."""
    return F.coalesce(F.date_format(F.timestamp_millis(text_or_empty(c).try_cast("bigint")), "yyyyMMdd"), F.lit(""))


def argmax(c: Column) -> Column:
    """Place, from 0, of the first largest element."""
    return F.array_position(c, F.array_max(c)) - 1


def period_label(first: Column, last: Column) -> Column:
    return F.concat(F.date_format(first, "yyyy.MM.dd"), F.lit("~"), F.date_format(last, "yyyy.MM.dd"))


def quota(target: int, multiplier: float, days: int, keywords: int, sorts: int, least: int) -> tuple[int, int]:
    """Links wanted in all, and from each query."""
    import math

    links = math.ceil(target * multiplier)
    return links, max(least, math.ceil(links / max(1, days * keywords * sorts)))
