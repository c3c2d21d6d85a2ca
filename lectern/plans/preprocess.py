"""Load, clean, drop near-duplicates, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nested, text
from ..functions.values import PERIODS
from ..operators.dedupe import drop_similar
from ..operators.normalize import prepare, with_rid
from ..operators.stats import change_preview, preprocess_report
from ..schemas import PREPARED
from ..session_scratch import materialised
from ..sources.tabular import as_frame, read_csv, write_csv


@dataclass
class Preprocessed:
    """Lazy frames of a run."""

    posts: DataFrame
    duplicate_log: DataFrame
    report: DataFrame
    preview: DataFrame


def clean_posts(posts: DataFrame, entities: bool = True) -> DataFrame:
    """Prepared posts (with rid) and, as ..._new, their cleaned title, doc and comments.

    Entities of comments are resolved in one Python step over all contents of a post.
    """
    said = nested.contents(F.col("comment_list"))
    if entities:
        sep = "\x1e"
        said = F.split(text.unescape(F.array_join(F.transform(said, lambda x: F.replace(F.coalesce(x, F.lit("")), F.lit(sep), F.lit(" "))), sep)), sep)
        said = F.when(F.size("comment_list") == 0, F.array().cast("array<string>")).otherwise(said)
    out = posts.withColumn("_said", said)
    fixed = F.zip_with("comment_list", "_said", lambda c, s: F.struct(s.alias("comment_content"), c["comment_like"].alias("comment_like"), c["comment_date"].alias("comment_date")))
    return out.withColumns({"title_new": text.clean_noise(F.col("title"), entities), "doc_new": text.clean_noise(F.col("doc"), entities), "comment_list_new": nested.clean_comments(fixed)}).drop("_said")


def preprocess(data: DataFrame | str, least: float = 0.8, periods=PERIODS, preview_rows: int = 10, order: tuple[str, ...] = (), spark: SparkSession | None = None) -> Preprocessed:
    """A run over a frame or a file. order: columns that give the rows' order, where there is no rid."""
    raw = as_frame(spark or data.sparkSession, data)
    if "rid" not in raw.columns:
        raw = with_rid(raw, *(order or [c for c in ("date", "title") if c in raw.columns] or raw.columns[:1]))
    prepared = materialised(prepare(raw, periods, keep=("rid",)))
    cleaned = materialised(clean_posts(prepared))
    final = cleaned.select("rid", F.col("title_new").alias("title"), F.col("doc_new").alias("doc"), "like", "comment_cnt", F.col("comment_list_new").alias("comment_list"), "ch", "date", "section")
    kept, log = drop_similar(final, least)
    rows = cleaned.select(
        "rid", "title", "title_new", "doc", "doc_new",
        nested.contents(F.col("comment_list")).alias("comments"), nested.contents(F.col("comment_list_new")).alias("comments_new"),
        nested.first_content(F.col("comment_list")).alias("comment"), nested.first_content(F.col("comment_list_new")).alias("comment_new"),
    )
    return Preprocessed(kept.select("rid", "group_rid", *PREPARED), log, preprocess_report(rows, kept), change_preview(rows, preview_rows))


def save(run: Preprocessed, posts_path: str, log_path: str) -> None:
    write_csv(run.posts.drop("group_rid", "rid"), posts_path)
    write_csv(run.duplicate_log, log_path)


def run_preprocessing(spark: SparkSession, source: str, posts_path: str, log_path: str, least: float = 0.8) -> Preprocessed:
    out = preprocess(read_csv(spark, source) if source.endswith(".csv") else source, least, spark=spark)
    save(out, posts_path, log_path)
    return out


def load_results(spark: SparkSession, posts_path: str, log_path: str) -> tuple[DataFrame, DataFrame]:
    return read_csv(spark, posts_path), read_csv(spark, log_path)
