"""Command line: preprocess a CSV, list searches, collect arriving pages, refresh old posts."""

from __future__ import annotations

import argparse

from .operators.filters import with_keywords
from .plans.preprocess import run_preprocessing
from .session import session
from .sources.tabular import remove
from .streaming.ingest import Options, collect, refresh, searches


def _options(a) -> Options:
    return Options(
        keywords=a.keywords, sorts=a.sorts, target=a.target, link_multiplier=a.link_multiplier, least_links=a.least_links,
        most_comments=a.most_comments, most_days=a.most_days, complete_only=a.complete_only,
    )


def main(args: list[str] | None = None) -> None:
    names = lambda t: [x.strip() for x in t.replace("|", ",").split(",") if x.strip()]
    p = argparse.ArgumentParser(prog="lectern")
    sub = p.add_subparsers(dest="run", required=True)
    one = sub.add_parser("preprocess", help="clean a CSV and drop near-duplicates")
    for x in ("source", "posts", "log"):
        one.add_argument(x)
    one.add_argument("--similarity", type=float, default=0.8)
    for name, paths in (("searches", ["out"]), ("collect", ["arriving", "posts", "checkpoint"]), ("refresh", ["posts", "pages", "out"])):
        s = sub.add_parser(name)
        for x in paths:
            s.add_argument(x)
        s.add_argument("--keywords", type=names, default=[])
        s.add_argument("--sorts", type=names, default=["r", "dd"])
        s.add_argument("--target", type=int, default=20_000)
        s.add_argument("--link-multiplier", type=float, default=2.5)
        s.add_argument("--least-links", type=int, default=40)
        s.add_argument("--most-comments", type=int, default=50)
        s.add_argument("--most-days", type=int)
        s.add_argument("--most-rows", type=int)
        s.add_argument("--complete-only", action="store_true")
        s.add_argument("--no-resume", action="store_true", help="forget what was collected before")
        s.add_argument("--keep-keywords", action="store_true", help="refresh only posts of the given keywords")
    a = p.parse_args(args)
    spark = session()
    if a.run == "preprocess":
        run_preprocessing(spark, a.source, a.posts, a.log, a.similarity)
    elif a.run == "searches":
        searches(spark, _options(a)).write.mode("overwrite").parquet(a.out)
    elif a.run == "collect":
        if a.no_resume:
            for path in (a.posts, a.checkpoint):
                remove(spark, path)
        collect(spark, a.arriving, a.posts, a.checkpoint, _options(a)).awaitTermination()
    else:
        old = spark.read.parquet(a.posts)
        old = with_keywords(old, a.keywords, blank_too=True) if a.keep_keywords else old
        refresh(old, spark.read.parquet(a.pages), _options(a), a.most_rows).write.mode("overwrite").parquet(a.out)


if __name__ == "__main__":
    main()
