"""Intermediate tables of iterative operators, in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; where it is unset, as in tests, a folder under the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    return (base or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_steps").rstrip("/")


def cut(df: DataFrame, name: str = "step", by: str | None = None) -> DataFrame:
    """`df` written and read again: its lineage ends, and a lost executor costs no earlier step.

    With `by`, a folder for each value of that column, so that a read of one value lists and scans only its own.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = True
    return out


def is_written(df: DataFrame) -> bool:
    """Whether `df` is a written table as `cut` gave it, which costs a scan and nothing else."""
    return getattr(df, "_written", False)
