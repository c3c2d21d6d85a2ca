"""The data behind charts as one long table: (chart, series, x, y), for any plotting tool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars(chart: str, df: DataFrame, x: str, y: str, series: str | None = None) -> DataFrame:
    """Bars, stacked bars, lines or the cells of a heat map: one point for each row."""
    of = F.col(series).cast("string") if series else F.lit("")
    return df.select(F.lit(chart).alias("chart"), of.alias("series"), F.col(x).cast("string").alias("x"), F.col(y).cast("double").alias("y"))


def boxes(chart: str, df: DataFrame, by: str) -> DataFrame:
    """Box plots from `box_stats`: whiskers, quartiles, median and number of outliers of each group."""
    parts = ("whisker_low", "q1", "median", "q3", "whisker_high", "outliers")
    pairs = ", ".join(f"'{p}', cast({p} as double)" for p in parts)
    return df.selectExpr(f"'{chart}' chart", f"cast(`{by}` as string) x", f"stack({len(parts)}, {pairs}) as (series, y)").select("chart", "series", "x", "y")


def venn(chart: str, df: DataFrame) -> DataFrame:
    """The three regions of two sets from `venn`."""
    return df.selectExpr(f"'{chart}' chart", "'' series", "stack(3, 'only_a', cast(only_a as double), 'only_b', cast(only_b as double), 'both', cast(`both` as double)) as (x, y)")
