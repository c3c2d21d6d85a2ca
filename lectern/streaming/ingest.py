"""Incremental collecting: pages that arrive in a folder become posts once each, exactly once; back-fill of old posts."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import canonical_post_url
from ..functions.values import PERIODS, quota
from ..operators.filters import accepted, to_reparse, with_url
from ..operators.pages import Profile, parse_pages
from ..operators.relate import unseen, update_columns
from ..schemas import REPARSED
from ..session_scratch import materialised
from ..sources.tabular import exists, front_columns
from ..sources.words import calendar


@dataclass
class Options:
    """What a collecting run takes."""

    keywords: list[str] = field(default_factory=list)
    sorts: list[str] = field(default_factory=lambda: ["r", "dd"])
    target: int = 20_000
    link_multiplier: float = 2.5
    least_links: int = 40
    most_comments: int = 50
    most_days: int | None = None
    complete_only: bool = False
    profile: Profile = Profile()


def searches(spark: SparkSession, o: Options, periods=PERIODS) -> DataFrame:
    """One row for each day, keyword and order, with its address and the number of links wanted from it."""
    from ..functions.urls import build_search_url

    days = calendar(spark, periods, o.most_days)
    n = days.count()
    _, each = quota(o.target, o.link_multiplier, n, len(o.keywords), len(o.sorts), o.least_links)
    options = spark.createDataFrame([(k, s) for k in o.keywords for s in o.sorts], "keyword string, search_sort string")
    every = days.join(F.broadcast(options))  # days by the few options of one call
    return every.withColumns({"search_url": build_search_url(F.col("keyword"), F.col("date"), F.col("search_sort")), "search_date": F.col("date"), "links_wanted": F.lit(each)})


def posts_of(pages: DataFrame, o: Options) -> DataFrame:
    """Accepted posts of pages (url, html), with canonical address, in the crawled schema."""
    keyed = with_url(pages.withColumn("canonical_url", canonical_post_url(F.col("url"))))
    parsed = accepted(parse_pages(keyed, "html", ("url", "canonical_url"), o.profile, o.most_comments))
    return front_columns(parsed.select(*[F.col(c).cast("string").alias(c) for c in parsed.columns]))


#: What ends a run at its target.
ENOUGH = "the target of posts is reached"


class Run:
    """A run of the stream; reaching the target is no failure."""

    def __init__(self, query):
        self.query = query

    def awaitTermination(self) -> None:  # noqa: N802  (as the query it stands for)
        try:
            self.query.awaitTermination()
        except StreamingQueryException as e:
            if ENOUGH not in str(e):
                raise


def collect(spark: SparkSession, arriving: str, posts: str, checkpoint: str, o: Options = Options(), schema: str = "url string, html string"):
    """Reads all pages that have arrived (Parquet) since the last run and appends the posts that are new, until there are `o.target`.

    Each micro-batch takes one page of each address (the first by its mark-up)
    and leaves out the addresses that the table has already, of which it reads
    that column only; no state grows with the stream. It is written under its
    number, so a batch that is run again after a failure replaces its own files.
    Of a batch that would pass the target, the first addresses in order are
    taken; it ends the run and is not marked as done, so a run with a larger
    target goes on with it.
    """
    stream = spark.readStream.schema(schema).parquet(arriving)
    keyed = with_url(stream.withColumn("canonical_url", canonical_post_url(F.col("url"))))

    def batch(rows: DataFrame, number: int) -> None:
        done = spark.read.parquet(posts).where(F.col("batch") != number).select("canonical_url") if exists(spark, posts) else None
        left = max(0, o.target - (done.count() if done is not None else 0))
        fresh = unseen(rows, done) if done is not None else rows
        one = fresh.groupBy("canonical_url").agg(F.min(F.struct("html", "url")).alias("p")).select("p.url", "p.html")
        new = materialised(posts_of(one, o))
        enough = new.count() > left
        if enough:
            new = new.orderBy("canonical_url").limit(left)
        new.write.mode("overwrite").parquet(f"{posts}/batch={number}")
        if enough:
            raise RuntimeError(ENOUGH)

    return Run(keyed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def save_links(links: DataFrame, path: str, day: str, most: int | None = None) -> int:
    """Adds one day's links that the table lacks, one row for each address, and returns how many links there are now.

    A day's links lie in a folder of their own, so a day that is run again
    replaces its own; of a day that would pass `most`, the first addresses in order are taken.
    """
    spark = links.sparkSession
    done = spark.read.parquet(path).where(F.col("day") != day).select("canonical_url") if exists(spark, path) else None
    before = done.count() if done is not None else 0
    rest = [c for c in links.columns if c != "canonical_url"]
    one = with_url(links).groupBy("canonical_url").agg(F.min(F.struct(*rest)).alias("r")).select("canonical_url", "r.*") if rest else with_url(links).distinct()
    new = materialised(unseen(one, done) if done is not None else one)
    n = new.count()
    if most is not None and before + n > most:
        n = max(0, most - before)
        new = new.orderBy("canonical_url").limit(n)
    new.write.mode("overwrite").parquet(f"{path}/day={day}")
    return before + n


def collect_links(days: Iterable[tuple[str, DataFrame]], path: str, o: Options = Options()) -> int:
    """Saves the links of one day after another, until there are as many as the target asks for; returns their number."""
    wanted, n = math.ceil(o.target * o.link_multiplier), 0
    for day, links in days:
        n = save_links(links, path, day, wanted)
        if n >= wanted:
            break
    return n


def refresh(old: DataFrame, pages: DataFrame, o: Options = Options(), most: int | None = None) -> DataFrame:
    """Posts with the comment columns of rows that lack them taken from a new parse of their pages."""
    wanted = to_reparse(old, o.complete_only, o.most_comments, most, "canonical_url")
    again = pages.withColumn("canonical_url", canonical_post_url(F.col("url"))).join(wanted.select("canonical_url").distinct(), "canonical_url", "left_semi")
    parsed = parse_pages(again.dropDuplicates(["canonical_url"]), "html", ("canonical_url",), o.profile, o.most_comments)
    new = parsed.select("canonical_url", *[F.col(c).cast("string").alias(c) for c in REPARSED])
    return update_columns(old, new, "canonical_url", REPARSED)
