"""Append-only result logs and scratch folders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint area."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/evigraph-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint area and read back; the copy goes when the application ends.

    For frames that a query uses several times: they are computed once, and the plans
    behind them do not pile up.
    """
    spark = df.sparkSession
    folder = scratch_folder(spark, name)
    df.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)


def append_results(results: DataFrame, folder: str) -> None:
    """Add a set of results to a log; files already there stay as they are."""
    results.write.mode("append").parquet(folder)
