"""Tokens as rows, stop-words, frequencies, and figures of sections.

Tokens stay one row each (rid, section, keyword); a section's tokens never meet
in one array, so the largest section is just more rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..functions.values import period_label
from ..session_scratch import materialised

TOKEN = "array<struct<form:string,tag:string>>"
NOUNS, VERBS, ADJECTIVES = ["NNG", "NNP"], ["VV"], ["VA"]


def token_rows(df: DataFrame, tokens: Column | str = "tokens", keep: tuple[str, ...] = ("rid", "section")) -> DataFrame:
    return df.select(*keep, F.explode(tokens).alias("keyword"))


def word_rows(df: DataFrame, text: str = "doc", keep: tuple[str, ...] = ("rid", "section")) -> DataFrame:
    return token_rows(df, words(F.col(text)), keep)


# --- morphological analysis


def regex_analyser() -> Callable[[str], list[tuple[str, str]]]:
    """Stand-in where no analyser is installed: every word is a common noun. It knows no verbs or adjectives."""
    import re

    found = re.compile(r"\w+").findall
    return lambda text: [(w, "NNG") for w in found(text)]


def kiwi_analyser() -> Callable[[str], list[tuple[str, str]]]:
    """The Korean analyser, where kiwipiepy is installed on the executors."""
    from kiwipiepy import Kiwi

    kiwi = Kiwi()
    return lambda text: [(t.form, t.tag) for t in kiwi.tokenize(text)]


def default_analyser() -> Callable[[str], list[tuple[str, str]]]:
    try:
        return kiwi_analyser()
    except ImportError:
        return regex_analyser()


#: Characters of a batch whose tokens a Python worker holds at once: tokens take many times the room of their text.
PIECE = 1 << 18


def in_pieces(batches: Iterator[pd.Series], tokens_of: Callable, size: Callable) -> Iterator[pd.Series]:
    """Each value's tokens, handed on after at most PIECE characters (or one value)."""
    for values in batches:
        out: list = []
        held = 0
        for v in values:
            if out and held + size(v) > PIECE:
                yield pd.Series(out)
                out, held = [], 0
            out.append(tokens_of(v))
            held += size(v)
        yield pd.Series(out, dtype=object)


def _words_as_nouns(c: Column) -> Column:
    """What regex_analyser finds, natively."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.struct(w.alias("form"), F.lit("NNG").alias("tag")))


def tagged(make: Callable = default_analyser):
    """A column function from text to (form, tag) tokens; the analyser is made once for each task. The stand-in needs no Python."""
    if make is regex_analyser:
        return _words_as_nouns

    @F.pandas_udf(TOKEN)
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        analyse = make()
        yield from in_pieces(batches, lambda t: [{"form": f, "tag": g} for f, g in analyse(t)] if t and t.strip() else [], lambda t: len(t or ""))

    return tag


def tagged_lists(make: Callable = default_analyser):
    """The same for an array of texts: one token array for each."""
    if make is regex_analyser:
        return lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), _words_as_nouns)

    @F.pandas_udf(f"array<{TOKEN}>")
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        analyse = make()
        each = lambda ts: [[{"form": f, "tag": g} for f, g in analyse(t)] if t and t.strip() else [] for t in (ts if ts is not None else [])]
        yield from in_pieces(batches, each, lambda ts: sum(len(t or "") for t in (ts if ts is not None else [])))

    return tag


def tokenised(df: DataFrame, make: Callable = default_analyser) -> DataFrame:
    """Posts with all tokens, nouns of two characters or more, verbs and adjectives of title, doc and each comment."""
    from .filters import by_pos

    tag, tag_all = tagged(make), tagged_lists(make)
    out = df.withColumns({"comment_text_list": F.transform("comment_list", lambda c: c["comment_content"]), "title_token_list": tag(F.col("title")), "doc_token_list": tag(F.col("doc"))})
    out = out.withColumn("comment_token_list", tag_all(F.col("comment_text_list")))
    kinds = {"noun": (NOUNS, 2), "verb": (VERBS, 1), "adj": (ADJECTIVES, 1)}
    new = {f"{p}_token_{k}": by_pos(F.col(f"{p}_token_list"), *v) for p in ("title", "doc") for k, v in kinds.items()}
    of_each = lambda v: lambda ts: by_pos(ts, *v)
    new |= {f"comment_token_{k}": F.transform("comment_token_list", of_each(v)) for k, v in kinds.items()}
    return out.withColumns(new)


def comment_rows(df: DataFrame) -> DataFrame:
    """One row for each comment of tokenised posts, with its place."""
    names = ["comment_text_list", "comment_token_list", "comment_token_noun", "comment_token_verb", "comment_token_adj"]
    zipped = F.posexplode(F.arrays_zip(*[F.col(n).alias(n) for n in names])).alias("comment_idx", "c")
    out = df.select(F.col("rid").alias("post_idx"), zipped)
    return out.select("post_idx", "comment_idx", F.col("c.comment_text_list").alias("comment_text"), *[F.col(f"c.{n}").alias(n) for n in names[1:]])


def explode_comments(df: DataFrame, column: str = "comment_list") -> DataFrame:
    """One row for each comment, with its post's rid; posts without comments have none."""
    return df.select("rid", F.explode(column).alias("c")).where("c is not null").select("rid", "c.*")


def comment_table(df: DataFrame, rid: int, column: str = "comment_list") -> DataFrame:
    """The comments of one post as a table."""
    return explode_comments(df.where(F.col("rid") == rid), column).drop("rid")


def noun_table(df: DataFrame) -> DataFrame:
    """Posts with their nouns only: title, document and the comments' in one list."""
    from ..functions.nested import flatten_tokens

    return df.select(
        "rid", "section", "like", "comment_cnt", F.col("title_token_noun"), F.col("doc_token_noun").alias("document_token_noun"), flatten_tokens(F.col("comment_token_noun")).alias("comment_token_noun")
    )


def section_text(df: DataFrame, tokens_: str = "tokens", posts: int = 1000) -> DataFrame:
    """All tokens of a section as text, a row for each run of `posts` row numbers: put together by part, they are the section's text."""
    part = F.floor(F.col("rid") / F.lit(posts)).alias("part")
    rows = F.array_sort(F.collect_list(F.struct("rid", tokens_)))
    return df.groupBy("section", part).agg(F.array_join(F.flatten(F.transform(rows, lambda x: x[tokens_])), " ").alias("section_doc"))


# --- stop-words


def without_words(tokens: DataFrame, stop: DataFrame) -> DataFrame:
    """Token rows without the words of a list: (keyword), or (section, keyword) with a null section for all sections."""
    if "section" not in stop.columns:
        return tokens.join(stop.select("keyword").distinct(), "keyword", "left_anti")
    everywhere = stop.where("section is null").select("keyword").distinct()
    own = stop.where("section is not null").select("section", "keyword").distinct()
    return tokens.join(everywhere, "keyword", "left_anti").join(own, ["section", "keyword"], "left_anti")


def frequencies(tokens: DataFrame, by: list[str] | None = None) -> DataFrame:
    """count of each keyword, overall or in each group."""
    return tokens.groupBy(*(by or []), "keyword").agg(F.count("*").alias("count"))


def top_words(counts: DataFrame, n: int, by: list[str] | None = None, rank: str = "rank") -> DataFrame:
    """The n most frequent words (of each group); ties by keyword."""
    order = [F.desc("count"), F.asc("keyword")]
    if by:
        out = counts.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        return out.where(F.col(rank) <= n)
    top = counts.orderBy(*order).limit(n)
    return top.withColumn(rank, F.row_number().over(Window.orderBy(*order)))  # n rows


def automatic_stopwords(tokens: DataFrame, base: DataFrame, in_section: int = 20, overall: int = 30) -> DataFrame:
    """(section, keyword): the most frequent words of each section and, with a null section, of all, after the base list."""
    counts = frequencies(without_words(tokens, base), ["section"])
    own = top_words(counts, in_section, ["section"]).select("section", "keyword")
    total = counts.groupBy("keyword").agg(F.sum("count").alias("count"))
    return own.unionByName(top_words(total, overall).select(F.lit(None).cast("int").alias("section"), "keyword"))


def finally_without(tokens: DataFrame, base: DataFrame, automatic: DataFrame) -> DataFrame:
    """Raw tokens without the base list and the automatic ones."""
    stop = base.select(F.lit(None).cast("int").alias("section"), "keyword").unionByName(automatic.select("section", "keyword"))
    return without_words(tokens, stop)


def sticky_scores(tokens: DataFrame) -> DataFrame:
    """doc_freq / (1 + 1000 * largest mean tf-idf of any section): high for words that are everywhere and tell nothing."""
    from .tfidf import mean_by, term_counts, tfidf

    counts = materialised(term_counts(tokens, ["rid", "section"]))  # the texts are read and cut into words once
    n = counts.select("rid", "section").distinct()
    means = mean_by(tfidf(tokens, ["rid", "section"], counts), n, "section").groupBy("keyword").agg(F.max("mean_tfidf").alias("top"))
    df = counts.groupBy("keyword").agg(F.count("*").alias("doc_freq"))
    return df.join(means, "keyword").select("keyword", "doc_freq", (F.col("doc_freq") / (1 + 1000 * F.col("top"))).alias("sticky_score"))


def sticky_stopwords(tokens: DataFrame, least: float, keep: DataFrame | None = None) -> DataFrame:
    """Words of at least this score, without those of a keep list."""
    out = sticky_scores(tokens).where(F.col("sticky_score") >= least).select("keyword")
    return out.join(keep.select("keyword"), "keyword", "left_anti") if keep is not None else out


def word_cloud(counts: DataFrame, by: list[str] | None = None, n: int = 100) -> DataFrame:
    """keyword and count of the n most frequent words (of each section)."""
    return top_words(counts, n, by).drop("rank")


# --- sections


def concentration(counts: DataFrame, by: str = "section", n: int = 20) -> DataFrame:
    """Sum of squared shares among the n most frequent words of each group; null where there are none."""
    top = top_words(counts, n, [by])
    share = F.col("count") / F.sum("count").over(Window.partitionBy(by))
    return top.select(by, (share * share).alias("s")).groupBy(by).agg(F.sum("s").alias(f"hhi_top{n}"))


def section_rollup(posts: DataFrame, day: str = "date") -> DataFrame:
    """Period and number of posts of each section, with a label."""
    out = posts.groupBy("section").agg(F.min(day).alias("period_start"), F.max(day).alias("period_end"), F.count("*").alias("post_count"))
    label = F.concat(F.col("section").cast("string"), F.lit("구간 ("), period_label(F.col("period_start"), F.col("period_end")), F.lit(")"))
    return out.withColumn("section_label", label)


def section_metrics(posts: DataFrame, tokens: DataFrame, n: int = 20) -> DataFrame:
    """Posts, words, different words and concentration of each section; sections without words have 0, 0 and null."""
    counts = frequencies(tokens, ["section"])
    nouns = counts.groupBy("section").agg(F.sum("count").alias("noun_count"), F.count("*").alias("unique_noun_count"))
    out = posts.groupBy("section").agg(F.count("*").alias("post_count")).join(nouns, "section", "left").join(concentration(counts, "section", n), "section", "left")
    return out.na.fill(0, ["noun_count", "unique_noun_count"])


def transitions(top: DataFrame) -> DataFrame:
    """Common, new and gone words between each section and the next one that exists. top: (section, keyword), few per section."""
    from .relate import next_row, overlap

    lists = top.groupBy("section").agg(F.collect_set("keyword").alias("words"))
    pairs = next_row(lists, "section", ["section", "words"]).where("next_section is not null")
    both, new, gone = overlap(F.col("words"), F.col("next_words"))
    return pairs.select(
        F.concat(F.col("section").cast("string"), F.lit("→"), F.col("next_section").cast("string")).alias("transition"),
        F.size(both).cast("long").alias("overlap_n"), F.size(new).cast("long").alias("new_n"), F.size(gone).cast("long").alias("gone_n"),
        both.alias("overlap"), new.alias("new"), gone.alias("gone"),
    )
