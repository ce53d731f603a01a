"""Written intermediate tables, and joins that broadcast only what has been counted."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where none is named, a temporary one in local mode, as in
    tests; on a cluster that is an error, as each machine would write to its own disk."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not named:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="rasterloom-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


#: While a table is written, its shuffle files go at the end, and batches for Python workers stay small whatever the length of texts.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings have these values inside the block."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


class Written:
    """A table written once to the shared folder: later reads survive lost executors and don't repeat the work.

    Once it is written, the shuffle files of its making are deleted, as nothing reads them again.
    """

    def __init__(self, df: DataFrame, name: str, folder: str | None = None):
        self.spark = df.sparkSession
        self.path = f"{(folder or shared_dir(self.spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        with settings(self.spark, WRITING):
            df.write.parquet(self.path)
        self.schema = df.schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Deletes the files; nothing may read the table any more."""
        jvm, context = self.spark._jvm, self.spark.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    return Written(df, name).df


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows (they must be narrow); else df itself, for a shuffled join that AQE splits where it is skewed."""
    few = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if few else df


def with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """df beside the columns of a one-row table, by a scalar subquery: no join, whatever the optimizer makes of constant keys."""
    row = one.select(F.struct(*one.columns)).scalar()
    return df.withColumn("__row", row).withColumns({c: F.col(f"__row.{c}") for c in one.columns}).drop("__row")
