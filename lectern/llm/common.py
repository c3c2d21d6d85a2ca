"""What the operators of this package share: tables, scratch tables, Arrow batches, filters of ids."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch that goes to Python at once; long texts make bytes the binding one.
BATCH_ROWS, BATCH_BYTES = 500, "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def named(df: DataFrame) -> list[Column]:
    """The frame's columns, whatever their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def bound_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that a worker's memory doesn't depend on text length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    bound_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def map_groups(df: DataFrame, keys: list[str], f: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """f of the rows of each group, read one group after another from sorted partitions; groups must be bounded."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            marks = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in keys])
            cuts = np.concatenate([[0], np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1, [b.num_rows]])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and (marks[:, lo] != last).any():
                    if (out := f(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                last = marks[:, lo]
                held.append(b.slice(lo, hi - lo))
        if held and (out := f(pa.Table.from_batches(held))) is not None:
            yield out

    return map_batches(df.repartition(*keys).sortWithinPartitions(*keys), go, schema)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def hash_share(id_col: str, rows: int, of: int | Column) -> Column:
    """Whether a row falls among about `rows` of `of`, by a hash of its id; null ids never do."""
    slots = 1 << 30
    most = F.least(F.lit(1.0), F.lit(float(rows)) / (F.greatest(of, F.lit(1)) if isinstance(of, Column) else F.lit(max(of, 1))))
    return F.col(id_col).isNotNull() & (F.pmod(F.xxhash64(F.lit(11), F.col(id_col)), F.lit(slots)) < most * slots)


def first_of_each(df: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """At most n rows of each value of `by`, in the order of some columns; every task sends at most n on."""
    place = spare(df.columns, "place")[0]
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn(place, F.row_number().over(w)).where(F.col(place) <= n).drop(place)


#: Most bits of a filter of ids, which are broadcast (16 MB), and bits of a row of it.
MOST_BITS, ROW_BITS = 1 << 27, 1 << 18


def maybe_among(df: DataFrame, id_col: str, ids: DataFrame, rows: int, among: bool = True) -> DataFrame:
    """Rows whose id may be one of `ids` (one column, about `rows` values), or those whose id surely isn't.

    A one-hash Bloom filter, broadcast and tested natively: it spares the
    shuffle of wide rows before an exact join with few ids. It has eight bits or
    more for each id, up to MOST_BITS; with over sixteen million ids more rows
    pass, and the exact join that follows moves them. Null ids surely are not
    among them.
    """
    bits = min(MOST_BITS, max(ROW_BITS, 1 << (8 * max(rows, 1) - 1).bit_length()))
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    key = ids.columns[0]
    marks = ids.where(F.col(key).isNotNull()).select(bit(F.col(key)).alias("b"))
    words = marks.select(F.expr("b div 64").alias("w"), F.expr("shiftleft(1L, cast(b % 64 as int))").alias("m"))
    words = words.unionAll(df.sparkSession.range(bits // 64).selectExpr("id", "0L")).groupBy("w").agg(F.expr("bit_or(m)").alias("m"))
    per_row = ROW_BITS // 64
    part, held, at = spare(df.columns, "part", "held", "at")
    # some rows of 32 kB each
    packed = words.groupBy(F.expr(f"w div {per_row}").alias(part)).agg(F.expr("transform(array_sort(collect_list(struct(w, m))), x -> x.m)").alias(held))
    tested = df.withColumn(at, F.coalesce(bit(F.col(id_col)), F.lit(0))).withColumn(part, F.expr(f"`{at}` div {ROW_BITS}"))
    tested = tested.join(F.broadcast(packed), part)
    hit = F.expr(f"getbit(element_at(`{held}`, cast(`{at}` div 64 % {per_row} as int) + 1), cast(`{at}` % 64 as int)) = 1") & F.col(id_col).isNotNull()
    return tested.where(hit if among else ~hit).select(named(df))


#: Most ids that are broadcast as they are.
FEW_IDS = 100_000


def without(df: DataFrame, key: str, gone: DataFrame, rows: int) -> DataFrame:
    """Rows whose key is none of `gone` (one column of another name, `rows` values); null keys stay.

    Few ids are broadcast. With more, a filter of them tells the rows that surely
    stay, and only the others are moved.
    """
    same = F.col(key) == F.col(gone.columns[0])
    if rows <= FEW_IDS:
        return df.join(F.broadcast(gone), same, "left_anti")
    unsure = maybe_among(df, key, gone, rows).join(gone, same, "left_anti")
    return maybe_among(df, key, gone, rows, among=False).unionByName(unsure)


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the place that spark.checkpoint.dir names, which driver and executors share.

    Where none is named, a temporary folder serves on one machine; elsewhere
    executors would write to disks of their own, so that is refused.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        base = sc.getCheckpointDir()
    if "://" not in base and not base.startswith("file:"):
        # as Spark's own writers resolve it: against the default file system
        jvm = sc._jvm
        path = jvm.org.apache.hadoop.fs.Path(base)
        base = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def delete(spark: SparkSession, folder: str) -> None:
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: Folders with tables that may still be read, each with its session.
_FOLDERS: dict[str, SparkSession] = {}


@atexit.register
def _end() -> None:
    for folder, spark in _FOLDERS.items():
        try:
            delete(spark, folder)
        except Exception:  # the session may be gone already
            pass


#: Whether Spark removes a query's shuffle files at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A table survives lost executors, unlike cached blocks. `drop` removes one
    that no later plan reads; the rest goes when the Python process ends. With
    `tidy` the shuffle files of a write go as soon as it is done, instead of
    when the driver happens to collect its garbage.
    """

    def __init__(self, spark: SparkSession, tidy: bool = False):
        self.spark, self.folder, self.n, self.there, self.tidy = spark, shared_folder(spark), 0, set(), tidy

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n:03d}-{name}"
        _FOLDERS[self.folder] = self.spark
        before = self.spark.conf.get(CLEAN_UP)
        if self.tidy:
            self.spark.conf.set(CLEAN_UP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEAN_UP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        self.there.add(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self.there.discard(t.scratch_path)
            delete(self.spark, t.scratch_path)
        if not self.there and _FOLDERS.pop(self.folder, None):
            delete(self.spark, self.folder)

    def drop_all_but(self, kept: DataFrame) -> None:
        for path in sorted(self.there - {kept.scratch_path}):
            delete(self.spark, path)
        self.there = {kept.scratch_path}
