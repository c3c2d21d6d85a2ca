"""Progress of a run: rows counted while they pass, without a job of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class Counted:
    """A frame whose rows are counted when an action runs; `rows` waits for the first one."""

    def __init__(self, df: DataFrame, name: str):
        self.seen = Observation(name)
        self.df = df.observe(self.seen, F.count(F.lit(1)).alias("rows"))

    @property
    def rows(self) -> int:
        return self.seen.get["rows"]
