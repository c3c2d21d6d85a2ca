"""CSV, Parquet and pickle sources; CSV, JSON-in-CSV and Parquet sinks."""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CRAWLED
from ..session import empty

#: Encodings to try, in order, with Java's name of each. Java's own cp949 isn't the one meant here.
ENCODINGS = [("utf-8-sig", "UTF-8"), ("utf-8", "UTF-8"), ("cp949", "MS949"), ("euc-kr", "EUC-KR")]
def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or a folder, if it is there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def files_of(spark: SparkSession, path: str) -> list[str]:
    """A file, or the files of a folder but hidden ones, in order."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.getFileStatus(p).isDirectory():
        return [path]
    return sorted(str(x.getPath()) for x in fs.listStatus(p) if x.isFile() and not x.getPath().getName().startswith(("_", ".")))


def _decodes(line: bytes, encoding: str) -> bool:
    try:
        codecs.decode(line, encoding)
    except UnicodeDecodeError:
        return False
    return True


def encodings(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Files by Java's name of the first encoding that decodes them to their end; each is read once, by an executor, in lines.

    No encoding here has a line end within a character, so a line decodes alike
    alone. Lines are told apart by their bytes: only which encodings fail in a
    file comes to the driver.
    """
    files = files_of(spark, path)
    if not files:
        return {}
    names = [java for _, java in ENCODINGS]

    def failures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        failed: dict[str, set[str]] = {}
        for b in batches:
            for file, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                known = failed.setdefault(file, set())
                if not line.isascii():
                    known |= {java for python, java in ENCODINGS if java not in known and not _decodes(line, python)}
        yield pa.RecordBatch.from_arrays([pa.array(list(failed), pa.string()), pa.array([sorted(x) for x in failed.values()], pa.list_(pa.string()))], ["file", "failed"])

    raw = spark.read.option("lineSep", "\n").text(files).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    bad = raw.mapInArrow(failures, "file string, failed array<string>").groupBy("file").agg(F.array_distinct(F.flatten(F.collect_list("failed"))).alias("failed")).collect()
    failed = {r.file.rpartition("/")[2]: set(r.failed) for r in bad}
    out: dict[str, list[str]] = {}
    for file in files:
        fits = [n for n in names if n not in failed.get(file.rpartition("/")[2], ())]
        if not fits:
            raise ValueError(f"{file} is in none of the encodings {', '.join(dict.fromkeys(names))}")
        out.setdefault(fits[0], []).append(file)
    return out


def detect_encoding(spark: SparkSession, path: str) -> str:
    """Java's name of the first encoding that decodes a file (or all files of a folder) to the end."""
    found = encodings(spark, path)
    return max(found, key=lambda java: [x for _, x in ENCODINGS].index(java), default="UTF-8")


def read_csv(spark: SparkSession, path: str, schema: str | None = None, encoding: str | None = None) -> DataFrame:
    """A CSV file, or the files of a folder, with header, quoted line ends and doubled quotes. Without a schema, all columns are text.

    Files of different encodings are read each in its own. Korean legacy encodings
    need spark.sql.legacy.javaCharsets, which is set for the session when one is met.
    """
    groups = {encoding: [path]} if encoding else encodings(spark, path) or {"UTF-8": [path]}
    if set(groups) != {"UTF-8"}:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")

    def one(java: str, files: list[str]) -> DataFrame:
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", java)
        return (reader.schema(schema) if schema else reader).csv(files)

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [one(*x) for x in groups.items()])


def read_csv_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file, or an empty frame where it is missing, empty or unreadable."""
    try:
        if not exists(spark, path):
            return empty(spark, schema)
        out = read_csv(spark, path)
        return out if out.columns else empty(spark, schema)
    except (AnalysisException, ValueError):
        return empty(spark, schema)


def _local_or_shared(path: str):
    """The file system of a path or URI, and the path in it."""
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def read_pickle(spark: SparkSession, path: str) -> DataFrame:
    """One-off conversion of a pickled frame, read by the driver; keep Parquet afterwards. Only for files of your own: a pickle runs code."""
    import pandas as pd

    fs, place = _local_or_shared(path)
    with fs.open_input_stream(place) as f:
        return spark.createDataFrame(pd.read_pickle(f))


def write_pickle(df: DataFrame, path: str) -> None:
    """A result table as a pickled frame, by way of the driver: for small tables that other programs want so."""
    fs, place = _local_or_shared(path)
    fs.create_dir(place.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(place) as f:
        df.toPandas().to_pickle(f)


def read_preferred(spark: SparkSession, *paths: str) -> tuple[DataFrame, str]:
    """The first of several files that exists (Parquet, pickle or CSV by its name), and which it was."""
    for path in paths:
        if exists(spark, path):
            kind = path.rstrip("/").rpartition(".")[2]
            return (read_pickle(spark, path) if kind in ("pkl", "pickle") else spark.read.parquet(path) if kind == "parquet" else read_csv(spark, path)), path
    raise FileNotFoundError(f"none of {', '.join(paths)} exists")


def as_frame(spark: SparkSession, data: DataFrame | str) -> DataFrame:
    """A frame as it is, or the one at a path."""
    return data if isinstance(data, DataFrame) else read_preferred(spark, data)[0]


def nested_as_json(df: DataFrame) -> DataFrame:
    """Arrays and structs as JSON text with null fields, everything else as it is."""
    kinds = dict(df.dtypes)
    return df.select(*[F.to_json(c, {"ignoreNullFields": "false"}).alias(c) if kinds[c].startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c in df.columns])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", mark: bool = True) -> None:
    """CSV files with header, nested columns as JSON. Each file begins where a task begins, with a byte order mark if there is to be one."""
    out = nested_as_json(df)
    if mark and out.columns:  # every file's header begins with the first name
        out = out.withColumnRenamed(out.columns[0], "\ufeff" + out.columns[0])
    out.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def export_csv_utf8(df: DataFrame, path: str, rows_at_once: int = 10_000) -> None:
    """One CSV file with byte order mark on the driver's disk. Rows pass through the driver some at a time, one task's after another's."""
    from itertools import islice
    from pathlib import Path

    import pandas as pd

    rows = nested_as_json(df)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    it = rows.toLocalIterator(prefetchPartitions=False)
    pd.DataFrame(columns=rows.columns).to_csv(path, index=False, encoding="utf-8-sig")
    while piece := list(islice(it, rows_at_once)):
        pd.DataFrame(piece, columns=rows.columns).to_csv(path, index=False, header=False, mode="a", encoding="utf-8")


def front_columns(df: DataFrame, front: list[str] = CRAWLED) -> DataFrame:
    """Known columns first, missing ones as empty text, others after them."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit("").alias(c) for c in front], *[F.col(f"`{c}`") for c in df.columns if c not in front])


def write_both(df: DataFrame, base: str) -> None:
    """Parquet for programs, CSV for people."""
    df.write.mode("overwrite").parquet(f"{base}.parquet")
    write_csv(df, f"{base}.csv")


class Layout:
    """Folders of a project's outputs under one base path."""

    PARTS = ("datasets", "wordcloud/raw", "wordcloud/filtered", "tfidf", "kmeans", "lda", "stopwords")

    def __init__(self, base: str):
        self.base = base.rstrip("/")

    def path(self, part: str, name: str) -> str:
        if part not in self.PARTS:
            raise ValueError(f"no such part: {part}")
        return f"{self.base}/{part}/{name}"
