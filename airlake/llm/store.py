"""Tables written to the shared folder of ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from airlake.session import ensure_checkpoint_dir


def _new_path(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/airlake-{uuid.uuid4().hex}"


#: Removes the shuffle files of a SQL execution when it ends. Else they stay
#: until the driver happens to collect its garbage.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Tables stored within leave no shuffle files behind."""
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FILE_CLEANUP)
        else:
            spark.conf.set(FILE_CLEANUP, before)


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` written as Parquet and read again: computed once, its lineage cut."""
    return StoredTable(df, *partition_by).df


class StoredTable:
    """A stored table that can be given up when another one has replaced it."""

    def __init__(self, df: DataFrame, *partition_by: str):
        spark = df.sparkSession
        self.path = _new_path(spark)
        df.write.partitionBy(*partition_by).parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def discard(self) -> None:
        """Remove the files; nothing may read the table afterwards."""
        spark = self.df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
