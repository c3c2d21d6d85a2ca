"""Cleaning and tokenising of text columns.

Java's \\s and \\S are ASCII only, so white space is an explicit class. All
functions but `unescape` are native expressions.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns that decide what the cleaners keep.
WS = r"\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TAG = r"<[^>]+>"
URL = rf"(https?://[^{WS}]+|www\.[^{WS}]+)"
URL_HTTP = rf"https?://[^{WS}]+"
LAUGH = "ㅋ{2,}|ㅎ{2,}"
JAMO = "[ㄱ-ㅎㅏ-ㅣ]+"
EMOJI = r"[\x{1F300}-\x{1F6FF}\x{1F900}-\x{1FAFF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}\x{FE0F}\x{200D}]+"
NOT_ALLOWED = rf"[^가-힣a-zA-Z0-9{WS}]"
WORD = r"[\p{L}\p{N}_]{2,}"


@F.pandas_udf(StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(lambda t: html.unescape(t) if t is not None and "&" in t else t)


def unescape(c: Column) -> Column:
    """HTML entities to characters. The one Python function of the cleaners: Spark has no built-in for it.

    Only texts with an ampersand are sent to Python.
    """
    some = c.contains("&")
    return F.when(some, _unescape(F.when(some, c))).otherwise(c)


def named_entities(c: Column, names: dict[str, str]) -> Column:
    """Given entities only, and only whole ones ("&amp" at the end of a page that is cut off stays); the ampersand's comes last. Native."""
    for name, char in sorted(names.items(), key=lambda x: x[0] == "amp"):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return c


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, rf"^[{WS}]+|[{WS}]+$", "")


def collapse_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, rf"[{WS}]+", " "))


def strip_tags(c: Column, by: str = " ") -> Column:
    return F.regexp_replace(c, TAG, by)


def strip_urls(c: Column) -> Column:
    return F.regexp_replace(c, URL, " ")


def remove_repeated_laughs(c: Column) -> Column:
    """Runs of two or more of the same laughing consonant become one space."""
    return F.regexp_replace(c, LAUGH, " ")


def remove_emoji(c: Column) -> Column:
    return F.regexp_replace(c, EMOJI, " ")


def keep_allowed(c: Column) -> Column:
    """Hangul syllables, ASCII letters and digits, and white space stay; each other character becomes a space."""
    return F.regexp_replace(c, NOT_ALLOWED, " ")


def only_allowed(c: Column) -> Column:
    """collapse_ws(keep_allowed(c)) in one pass: a run of anything else, white space or not, is one space."""
    return F.trim(F.regexp_replace(c, "[^가-힣a-zA-Z0-9]+", " "))


def clean_noise(c: Column, entities: bool = True) -> Column:
    """The main cleaner: entities, tags, addresses, all but allowed characters, white space.

    Laughs and emoji need no steps of their own here: what they leave behind is
    covered by the allowed characters. entities=False skips the Python step for
    input without entities.
    """
    t = text_or_empty(c)
    t = unescape(t) if entities else t
    return only_allowed(strip_urls(strip_tags(t)))


def clean_strict(c: Column) -> Column:
    """The second cleaner: tags, http addresses and all lone jamo go without a space; no entities."""
    t = F.regexp_replace(strip_tags(text_or_empty(c), ""), URL_HTTP, "")
    return only_allowed(F.regexp_replace(t, JAMO, ""))


def clean_markup_text(c: Column) -> Column:
    """Text taken from a page: entities, zero-width and no-break spaces, white space."""
    return collapse_ws(F.regexp_replace(unescape(text_or_empty(c)), r"[\x{200b}\xa0]", " "))


def normalize_text(c: Column) -> Column:
    return collapse_ws(text_or_empty(c))


def join_tokens(c: Column) -> Column:
    return collapse_ws(F.array_join(F.coalesce(c, F.array().cast("array<string>")), " "))


def words(c: Column) -> Column:
    """Lower-cased runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(WORD), F.lit(0))


def whitespace_tokens(c: Column) -> Column:
    """Lower-cased parts between white space."""
    return F.filter(F.split(F.lower(text_or_empty(c)), rf"[{WS}]+"), lambda w: w != "")


def token_count(c: Column) -> Column:
    """Parts between white space; none in an empty text."""
    t = collapse_ws(text_or_empty(c))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def strip_title_suffix(c: Column, site: str) -> Column:
    """A title without ' : site' at its end."""
    return F.trim(F.regexp_replace(c, rf"\s*:\s*\Q{site}\E\s*$", ""))
