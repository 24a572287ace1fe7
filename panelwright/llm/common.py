"""What the operators of this subpackage share: column selection, folds, shared storage, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.session import small_batches

NULL_ID = 2**63 - 1
#: Texts handed to a Python loop at once.
SLICE = 512


def need(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast to the given types; a missing one is an error, further ones are left out."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[df[c].cast(t).alias(c) for c, t in columns.items()])


def id_or_last(c: str | Column) -> Column:
    """A null id counts as the largest one."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(NULL_ID))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that nothing is learnt from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learnable(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 != 0, F.lit(False))


def smallest_hashes(rows: DataFrame, group: str, key: str, k: int) -> tuple[DataFrame, dict]:
    """The ``k`` rows of each group with the smallest hash of ``key``, numbered _k from 1, and the groups' sizes.

    Groups are labels or languages, so their sizes go to the driver. A bound on the hash, set from the sizes so that about
    4 k + 100 rows of a group pass, is applied before the shuffle: what is sorted does not grow with the input."""
    sizes = {r[group]: r["count"] for r in rows.groupBy(group).count().collect()}
    bound = F.lit(2**63 - 1)
    for g, n in sizes.items():
        share = (4 * k + 100) / max(1, n)
        if g is not None and share < 1:
            bound = F.when(F.col(group) == F.lit(g), F.lit(int(share * 2**64) - 2**63)).otherwise(bound)
    order = Window.partitionBy(group).orderBy(F.xxhash64(key), key)
    near = rows.where(F.xxhash64(key) <= bound)
    return near.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k), sizes


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A cluster names it in spark.checkpoint.dir; a local
    session without the setting gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back: what follows survives lost executors."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that no later plan reads."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict[str, list]] | dict[str, list]], schema: str) -> DataFrame:
    """Apply ``fn`` to slices of at most SLICE rows; it returns columns by name, or yields several such."""
    parsed = T._parse_datatype_string(schema)
    arrow = _arrow(parsed)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                got = fn(batch.slice(at, SLICE))
                for part in [got] if isinstance(got, dict) else got:
                    yield pa.RecordBatch.from_arrays([pa.array(part[f.name], f.type) for f in arrow], schema=arrow)

    return small_batches(df).mapInArrow(run, parsed)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
