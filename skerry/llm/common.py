"""Shared folder, scratch tables and small column helpers of the training-data operators."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed set of ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or an own one where a local session has none (tests)."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="skerry-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(target)] if fs.exists(target) else []


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of a (narrow) table: survives lost executors. Spark removes it when the table is no longer referenced if
    spark.cleaner.referenceTracking.cleanCheckpoints is on, else it stays."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Parquet tables in the shared folder that live as long as the ``with`` block; what outlives it is checkpointed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.prefix, self.tables = f"{name}-{uuid.uuid4().hex}", []
        self.path = f"{shared_dir(spark)}/{self.prefix}"

    def __enter__(self) -> "Scratch":
        return self

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write once, read back: cuts the lineage, so a lost executor costs one file's work."""
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_bucketed(self, df: DataFrame, name: str, buckets: int, keys: list[str]) -> DataFrame:
        """Write once into buckets of the keys: joins and groups by them need no exchange on this side."""
        table_name = f"{self.prefix}_{name}".replace("-", "_")
        self.tables.append(table_name)
        df.write.option("compression", "zstd").bucketBy(min(buckets, 100_000), *keys).sortBy(*keys).option("path", f"{self.path}/{name}").saveAsTable(table_name)
        return self.spark.table(table_name)

    def drop(self, name: str = "") -> None:
        delete(self.spark, f"{self.path}/{name}" if name else self.path)

    def __exit__(self, *_) -> None:
        for name in self.tables:
            self.spark.sql(f"drop table if exists {name}")
        self.drop()


def bounded_arrow(spark: SparkSession, rows: int = 1024, size: str = "4m") -> None:
    """Keep Arrow batches small, so that a batch of very long documents still fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def text_hash(text: Column) -> Column:
    """With the doc_id, what tells rows apart: rows with both equal are copies of one row."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _rows_in(docs: DataFrame, some: DataFrame, how: str) -> DataFrame:
    some = checkpointed(some.select(F.struct(F.col("doc_id").alias("id"), F.col("_th").alias("th")).alias("_skerry_row")).distinct())
    if some.isEmpty():  # nothing to compare: the texts need not move
        return docs if how == "left_anti" else docs.filter(F.lit(False))
    own = F.struct(F.col("doc_id").alias("id"), text_hash(F.col("text")).alias("th"))
    return docs.withColumn("_skerry_row", own).join(some, "_skerry_row", how).select(*[F.col(f"`{c}`") for c in docs.columns])


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows of ``gone`` (doc_id, _th: hash of the text), whatever other columns docs has."""
    return _rows_in(docs, gone, "left_anti")


def within(docs: DataFrame, some: DataFrame) -> DataFrame:
    """The rows of docs that ``some`` (doc_id, _th) names."""
    return _rows_in(docs, some, "left_semi")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
