"""Distributions, quantiles and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session_scratch import materialised


def share_table(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """doc_count of each value in each section, the section's total, and the share."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("doc_count"))
    total = counts.withColumn("section_total", F.sum("doc_count").over(Window.partitionBy(by[0])))
    return total.withColumn("ratio", F.col("doc_count") / F.col("section_total"))


def share_matrix(shares: DataFrame, row: str, column: str, values: list, cell: str = "ratio") -> DataFrame:
    """One column for each of the given values, 0 where a combination is missing."""
    return shares.groupBy(row).pivot(column, values).agg(F.first(cell)).na.fill(0)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("count")).orderBy(column)


def distinct_with_null(df: DataFrame, column: str) -> DataFrame:
    """Number of different values, null being one."""
    return df.agg((F.countDistinct(column) + F.max(F.when(F.col(column).isNull(), 1).otherwise(0))).alias("n"))


#: Accuracy of the sketches that say where a quantile lies: a few parts in this of the rows are then ranked exactly.
ACCURACY = 10_000


#: Most groups, or bounds of groups, that go to all tasks.
FEW = 100_000


def _to_all(small: DataFrame) -> DataFrame:
    """A written table of a row for each group, sent to all tasks where groups are few: dealt by group, all rows of one would meet in one task."""
    return F.broadcast(small) if small.limit(FEW + 1).count() <= FEW else small


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str]) -> DataFrame:
    """Exact quantiles with linear interpolation of each group, one column for each share; groups without a value have none.

    A sketch of each group bounds every quantile from both sides; what lies
    below is counted, and only the different values between the bounds are
    ranked. So no task holds a group's values, however large it is.
    """
    names, points = list(shares), list(shares.values())
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(c).alias(f"g{i}") for i, c in enumerate(by)], F.col(value).cast("double").alias("v"))
    groups = [f"g{i}" for i in range(len(by))]
    edge = 4 / ACCURACY
    asked = [min(1.0, max(0.0, p + d)) for p in points for d in (-edge, edge)]
    sketch = rows.groupBy(*groups).agg(F.percentile_approx("v", asked, ACCURACY).alias("e"), F.min("v").alias("least"), F.max("v").alias("most"), F.count("*").alias("n"))
    # bounds at the ends of the range are the least and the largest value, and so are those of groups of few rows
    few = F.col("n") <= ACCURACY
    ends = [
        F.struct(
            F.lit(i).alias("k"), (F.lit(float(p)) * (F.col("n") - 1)).alias("at"),
            F.when(few | F.lit(p <= edge), F.col("least")).otherwise(F.col("e")[2 * i]).alias("lo"),
            F.when(few | F.lit(p >= 1 - edge), F.col("most")).otherwise(F.col("e")[2 * i + 1]).alias("hi"),
        )
        for i, p in enumerate(points)
    ]
    bounds = materialised(sketch.select(*[F.col(g).alias(f"b{g}") for g in groups], F.explode(F.array(*ends)).alias("b")).select(*[f"b{g}" for g in groups], "b.*"))
    same = [F.col(g).eqNullSafe(F.col(f"b{g}")) for g in groups] or [F.lit(True)]
    # a row for each group and share: few next to the rows
    met = rows.join(_to_all(bounds), reduce(lambda x, y: x & y, same)).where("v <= hi")
    key = [f"b{g}" for g in groups] + ["k", "at"]
    counts = met.groupBy(*key, F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    up_to = F.sum("c").over(Window.partitionBy(*key).orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.withColumn("end", up_to).where("v is not null")
    here = lambda at: F.min(F.when(F.col("end") > at, F.col("v")))
    low = placed.groupBy(*key).agg(here(F.floor("at")).alias("x"), here(F.ceil("at")).alias("y"))
    exact = low.withColumn("q", F.col("x") + (F.col("y") - F.col("x")) * (F.col("at") - F.floor("at")))
    one = [F.max(F.when(F.col("k") == i, F.col("q"))).alias(name) for i, name in enumerate(names)]
    return exact.groupBy(*[F.col(f"b{g}").alias(c) for g, c in zip(groups, by, strict=True)]).agg(*one)


def describe(df: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    """count, mean, deviation, least, quartiles and largest of each column, exactly."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    long = df.selectExpr(f"stack({len(columns)}, {pairs}) as (column, v)")
    whole = long.groupBy("column").agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    out = whole.join(quantiles(long, "v", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["column"]), "column", "left")
    return out.select("column", "count", *[F.round(c, digits).alias(c) for c in ("mean", "std", "min", "q1", "median", "q3", "max")])


def plot_cap(df: DataFrame, column: str, share: float = 0.99, least: float = 1.0) -> DataFrame:
    """A quantile of all rows, or `least` if that is more; `least` where there are none."""
    return quantiles(df, column, {"q": share}, []).agg(F.greatest(F.max("q"), F.lit(least)).alias("cap"))


def box_stats(df: DataFrame, value: str, by: str) -> DataFrame:
    """Quartiles, whiskers (the furthest values within 1.5 boxes) and number of outliers of each group."""
    q = materialised(quantiles(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, [by]))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    rows = df.select(by, value).join(_to_all(q), by).withColumn("_in", F.col(value).between(F.col("q1") - reach, F.col("q3") + reach))
    return rows.groupBy(by, "q1", "median", "q3").agg(
        F.min(F.when(F.col("_in"), F.col(value))).alias("whisker_low"), F.max(F.when(F.col("_in"), F.col(value))).alias("whisker_high"), F.count(F.when(~F.col("_in"), 1)).alias("outliers")
    )


def ordered_list(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Each group's values in order, for small groups such as the top words of a topic."""
    return df.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias(f"{value}s"))


def max_per(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.max(value).alias(name))


def preprocess_report(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """(metric, value): rows before and after, removed, and changed titles, docs and comment lists.

    rows: title, doc, comments (array of texts) of each row before and, as title_new..., after cleaning.
    """
    differ = lambda c: F.count(F.when(~F.col(c).eqNullSafe(F.col(f"{c}_new")), 1))
    before = rows.agg(F.count("*").alias("before"), differ("title").alias("t"), differ("doc").alias("d"), differ("comments").alias("c"))
    one = before.join(F.broadcast(kept.agg(F.count("*").alias("after"))))
    pairs = [("전처리 전 행 수", "before"), ("전처리 후 행 수", "after"), ("제거된 행 수", "before - after"), ("제목 변경 행 수", "t"), ("본문 변경 행 수", "d"), ("댓글 변경 행 수", "c")]
    return one.selectExpr(f"stack({len(pairs)}, " + ", ".join(f"'{name}', {expr}" for name, expr in pairs) + ") as (metric, value)")


def change_preview(rows: DataFrame, n: int = 10, order: str = "rid") -> DataFrame:
    """Title, doc and first comment before and after cleaning, of the first n changed rows."""
    from .filters import changed

    names = ["title", "doc", "comment"]
    out = rows.where(changed(names, [f"{c}_new" for c in names])).orderBy(order).limit(n)
    return out.select(order, *[F.col(x).alias(y) for c in names for x, y in ((c, f"{c}_before"), (f"{c}_new", f"{c}_after"))])


def sentiment_shares(tokens: DataFrame, lexicon: DataFrame, by: str = "section") -> DataFrame:
    """Share of positive, negative and neutral documents of each section by a lexicon of (keyword, polarity)."""
    told = tokens.join(lexicon, "keyword", "left").groupBy("rid", by).agg(F.sum(F.coalesce("polarity", F.lit(0))).alias("p"))
    named = told.select(by, F.when(F.col("p") > 0, "positive").when(F.col("p") < 0, "negative").otherwise("neutral").alias("sentiment"))
    return share_table(named, "sentiment", [by])
