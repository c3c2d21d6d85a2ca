"""Tables written to the folder that spark.checkpoint.dir names, to cut lineage in a way that survives lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _set_folder(sc) -> None:
    """A checkpoint folder of our own, only where none is configured and all runs on one machine (tests)."""
    if not (sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))


def materialised(df: DataFrame) -> DataFrame:
    """The frame, computed once and read from shared storage from here on."""
    _set_folder(df.sparkSession.sparkContext)
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder in the shared place."""
    sc = spark.sparkContext
    _set_folder(sc)
    return f"{(sc.getConf().get('spark.checkpoint.dir', None) or sc.getCheckpointDir()).rstrip('/')}/{uuid.uuid4().hex}"
