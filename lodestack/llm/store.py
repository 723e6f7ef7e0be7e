"""Tables written between steps, in the folder that the cluster shares.

`spark.checkpoint.dir` is read from the session.  Only where it is unset (tests, one machine) a
folder under the warehouse is used.  A written table cuts the lineage: a lost executor costs the
tasks that it ran, not the steps before them.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch: it is held by the JVM, by the Python worker, and in what is made of it.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_BYTES where they are larger; the results do not depend on it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(name, "64m")).strip().lower().removesuffix("b")
    if not now.isdigit() or int(now) <= 0 or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_steps"
    return base.rstrip("/")


class Steps:
    """Writes tables under one folder of their own; `drop` removes those no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        bound_batches(spark)
        self.base = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._at = 0

    def write(self, df: DataFrame) -> DataFrame:
        self._at += 1
        path = f"{self.base}/{self._at}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._written_to = path
        return out

    def append(self, table: DataFrame, more: DataFrame) -> None:
        """Add rows to a written table; `read` gives them all."""
        more.select(table.columns).write.mode("append").parquet(table._written_to)

    def read(self, table: DataFrame) -> DataFrame:
        """A written table as it is now."""
        out = self.spark.read.schema(table.schema).parquet(table._written_to)
        out._written_to = table._written_to
        return out

    def release(self) -> None:
        """Let Spark remove the shuffle files of steps that nothing refers to any more."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._written_to)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def sent(ids: DataFrame, most: int = 2_000_000) -> DataFrame:
    """A table of ids, to be broadcast while it has at most `most` rows, so that texts stay where they are read."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def spare(df: DataFrame, name: str) -> str:
    """`name`, or where `df` has such a column (names are compared as Spark does, in any case), a longer one."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
