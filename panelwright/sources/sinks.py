"""Sinks and the restartable sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelwright.sources.tables import exists


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_batches(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append finished batches, one directory per key value."""
    df.write.mode("append").partitionBy(*keys).parquet(path)


def write_part(df: DataFrame, path: str, keys: list[str]) -> None:
    """Put results beside those written before; a batch that is written again replaces its own directory alone, so the
    table read back is cumulative after every batch and a restart changes nothing that is done."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def unfinished(spark: SparkSession, todo: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Batches of ``todo`` that no earlier run has appended under ``path``."""
    if not exists(spark, path):
        return todo
    done = spark.read.parquet(path).select(*keys).distinct()
    return todo.join(done, keys, "left_anti")


def report_rows(df: DataFrame, name: str = "metric", value: str = "value") -> DataFrame:
    """One wide summary row as key/value rows."""
    return df.select(*[df[c].cast("double").alias(c) for c in df.columns]).unpivot([], df.columns, name, value)
