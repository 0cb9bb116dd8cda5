"""Readers and writers: CSV input, ground truth, JDBC, and a run directory of stage tables."""

from __future__ import annotations

import contextlib
import json
import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cellmend import schema
from cellmend.functions.text import normalise_null, or_placeholder


def with_tid(df: DataFrame, split: Sequence[Column] = ()) -> DataFrame:
    """tid = 1..n, dense, in order of the split that a row is from and of rows in a split; a column of this name is replaced. A split is
    a partition unless columns name it. Rows are counted per split and each split numbers its own, so nothing is moved; df must read its
    files in the same order twice, as scans do."""
    names = [f"__split{k}" for k in range(max(1, len(split)))]
    df = df.select("*", F.monotonically_increasing_id().alias("__id"), *[c.alias(n) for c, n in zip(split or [F.spark_partition_id()], names, strict=True)]).drop("tid")
    counts = df.groupBy(*names).agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("__first")  # one row a split
    numbered = df.join(F.broadcast(counts.select(*names, before.alias("__before"))), names)
    tid = F.col("__before") + F.col("__id") + 1
    return numbered.select(tid.cast("long").alias("tid"), *[F.col(f"`{c}`") for c in df.columns if c not in ("__id", *names)])


def read_csv(spark: SparkSession, path: str, limit: int | None = None, multi_line: bool = True) -> DataFrame:
    """Wide table of strings with tid in order of file name and of rows in a file; missing values are null. A scan deals files to its
    partitions by size, so these are in no such order. A file whose quoted values hold line ends is one task; without multi_line
    such values are not understood, and a file of any size is read by many."""
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, quote='"', escape='"', nullValue="")
    wide = with_tid(raw, [F.col("_metadata.file_path"), F.col("_metadata.file_block_start")])
    return normalise(wide.where(F.col("tid") <= limit) if limit else wide)


def normalise(wide: DataFrame) -> DataFrame:
    """Strip every string and make nulls of what means a missing value."""
    return wide.select(*[normalise_null(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f"`{f.name}`") for f in wide.schema.fields])


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth in long form: (tid, attr, correct_val); ids in the file start at 0, empty values are the placeholder."""
    raw = spark.read.schema("tid_csv int, attribute string, correct_val string").csv(path, header=True, quote='"', escape='"', nullValue="")
    return raw.select((F.col("tid_csv") + 1).cast("long").alias("tid"), F.col("attribute").alias("attr"), or_placeholder(F.nullif("correct_val", F.lit(""))).alias("correct_val"))


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database; give partitionColumn, lowerBound, upperBound and numPartitions for a parallel read."""
    return spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    """Rows into a table of a database, which is made where it is missing; numPartitions bounds the connections."""
    df.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode(mode).save()


class RunDirectory:
    """The stage tables of one run as Parquet. Writing a table replaces it: a new version is written beside the old one, then a pointer is
    switched by an atomic rename, so a failed write loses nothing. Resetting a run replaces all tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
        fixed = schema.TABLES[name]
        old, new = self._version(name), f"v-{uuid.uuid4().hex}"
        df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fixed]).write.partitionBy(*partition_by).parquet(f"{self.path}/{name}/{new}")
        self._point(name, new)
        if old:
            _remove(self.spark, f"{self.path}/{name}/{old}")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        version = self._version(name)
        if version is None:
            return self.spark.createDataFrame([], schema.TABLES[name])
        return self.spark.read.schema(schema.TABLES[name]).parquet(f"{self.path}/{name}/{version}")

    def reset(self) -> None:
        for name, fixed in schema.TABLES.items():
            self.write(name, self.spark.createDataFrame([], fixed))

    def _pointer(self, name: str):  # noqa: ANN202  a Java path and its file system
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/CURRENT")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _version(self, name: str) -> str | None:
        path, fs = self._pointer(name)
        if not fs.exists(path):
            return None
        data = fs.open(path)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8")
        finally:
            data.close()

    def _point(self, name: str, version: str) -> None:
        sc = self.spark.sparkContext
        path, fs = self._pointer(name)
        new = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/CURRENT-{version}")
        out = fs.create(new, True)
        out.write(bytearray(version, "utf-8"))
        out.close()
        kind = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
        over = sc._gateway.new_array(kind, 1)
        over[0] = kind.OVERWRITE
        sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else fs.getUri(), sc._jsc.hadoopConfiguration()).rename(new, path, over)

    def write_settings(self, settings: dict) -> None:
        self.spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/settings")

    def read_settings(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/settings").first()[0])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset a local session, as in tests, takes a folder of
    this machine; on a cluster that would be each executor's own disk, so there it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "cellmend-checkpoints")
    return base.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: For each open scope() the tables written in it.
_SCOPES: list[list[str]] = []


def checkpointed(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends, lost executors cost nothing. The table is deleted with the scope() that
    it is written in, else when the driver's JVM ends, whether or not the session was stopped before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    fixed = df.schema
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.parquet(path)
    fs.deleteOnExit(p)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return spark.read.schema(fixed).parquet(path)


def drop_checkpoint(df: DataFrame) -> None:
    """Delete the files of a frame made by checkpointed() that nothing reads any more."""
    for path in {os.path.dirname(x) for x in df.inputFiles()}:
        _remove(df.sparkSession, path)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What checkpointed() writes inside is deleted at the end: by then its readers must have written their results."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _remove(spark, path)


def dense_number(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """name = 0..n-1 in the order of the given columns, without a task that holds all rows: rows are sorted over ranges, counted per
    range, and each range numbers its own."""
    parts = df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    parts = checkpointed(parts, "ranges")
    counts = parts.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return parts.join(F.broadcast(counts.select("__range", before.alias("__before"))), "__range").withColumn(name, (F.col("__before") + within).cast("long")).drop("__range", "__before")
