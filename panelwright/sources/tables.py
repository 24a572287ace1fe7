"""Scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv_scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, typed by a declared schema; ``NA`` and empty are null."""
    return spark.read.csv(path, header=True, schema=schema, nullValue="NA", mode="PERMISSIVE")


def csv_select(spark: SparkSession, path: str, typed: dict[str, tuple[str, str]]) -> DataFrame:
    """Typed projection of a CSV: output name -> (input column, type).

    Text is read as written and cast with ``try_cast``, so a bad cell is null."""
    raw = spark.read.csv(path, header=True, nullValue="NA", inferSchema=False)
    return raw.select(*[F.col(src).try_cast(t).alias(out) for out, (src, t) in typed.items()])


def by_layout(df: DataFrame, layouts: dict[str, list[Column]]) -> DataFrame:
    """Project one of several layouts, chosen by the column that marks it."""
    for marker, projection in layouts.items():
        if marker in df.columns:
            return df.select(*projection)
    raise ValueError(f"none of {list(layouts)} among {df.columns}")


def wide_to_long(df: DataFrame, ids: list[str], pattern: str, name: str, value: str) -> DataFrame:
    """Unpivot every column whose name matches ``pattern``."""
    import re

    months = [c for c in df.columns if re.fullmatch(pattern, c)]
    return df.unpivot(ids, months, name, value)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def optional_enrichment(df: DataFrame, spark: SparkSession, path: str, schema: str, on: list[str]) -> DataFrame:
    """Left join a Parquet enrichment when it exists, else add null columns."""
    if exists(spark, path):
        return df.join(spark.read.schema(schema).parquet(path), on, "left")
    extra = spark.createDataFrame([], schema)
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in extra.schema if f.name not in on])


def crosswalk(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Literal lookup table; written out in the program, so its size is fixed."""
    return F.broadcast(spark.createDataFrame(rows, schema))
