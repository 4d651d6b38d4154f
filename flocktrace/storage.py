"""Intermediate tables in the folder that driver and executors share, and running totals over a whole table."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master a folder of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='flocktrace-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Has Spark delete the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _no_shuffle_files_left(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files; the session's own setting comes back after them."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, path: str, codec: str = "snappy") -> None:
    """Writes df as parquet files and leaves no shuffle files."""
    with _no_shuffle_files_left(df.sparkSession):
        df.write.option("compression", codec).parquet(path)


def staged(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df written as a table in the shared folder and read back: its lineage ends there, and a lost executor costs no more than rereading."""
    spark, path = df.sparkSession, new_dir(df.sparkSession, name)
    written(df, path, codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that shuffles both sides, whatever Spark takes its size to be.

    Spark takes a table for as large as its files, and an exploded one too.  Files compress, and hold many members in a
    row, so a join by such an estimate sends far more than spark.sql.autoBroadcastJoinThreshold through the driver.
    """
    return df.hint("merge")


def dropped(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_staged_path", None)
        if path:
            jvm = table.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def running_totals(df: DataFrame, order: list[Column], totals: dict[str, Column], name: str = "ordered") -> DataFrame:
    """df with, for each name in totals, the sum of its column over all rows up to and including this one in the given order.

    Rows are dealt into ranges of the order and written; one sum for each range goes to a window over ranges, whose
    number is that of the shuffle partitions.  Rows that tie in the order get totals in an order of Spark's choosing.
    Adds the column _range, the number of the row's range.
    """
    made = df.withColumns({f"_of_{k}": v for k, v in totals.items()})
    # the number is counted by us, as boundaries are drawn once only where the rows are written
    ranged = staged(made.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)
    sums = ranged.groupBy("_range").agg(*(F.sum(f"_of_{k}").alias(f"_sum_{k}") for k in totals))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_range", *(F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_before_{k}") for k in totals))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # offsets has one row for each range: at most as many as shuffle partitions
    joined = ranged.withColumns({f"_within_{k}": F.sum(f"_of_{k}").over(within) for k in totals}).join(F.broadcast(offsets), "_range")
    return joined.withColumns({k: F.col(f"_within_{k}") + F.col(f"_before_{k}") for k in totals}).drop(*(f"{p}{k}" for k in totals for p in ("_of_", "_within_", "_before_")))
