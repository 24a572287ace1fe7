"""Comparison of two vintages of a data set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from panelwright.functions.scalars import near, sum0


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    a, b = set(old.columns), set(new.columns)
    rows = [(c, "only_old") for c in sorted(a - b)] + [(c, "only_new") for c in sorted(b - a)] + [(c, "both") for c in sorted(a & b)]
    return old.sparkSession.createDataFrame(rows, "column STRING, side STRING")


def added_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return new.select(*keys).distinct().join(old.select(*keys).distinct(), keys, "left_anti")


def dropped_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return added_keys(new, old, keys)


def key_sides(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Every key once with its row counts on both sides; one shuffle for both
    vintages and no join, so a key repeated in either side stays one row."""
    u = old.select(*keys, F.lit(1).alias("_o"), F.lit(0).alias("_n")).unionAll(new.select(*keys, F.lit(0).alias("_o"), F.lit(1).alias("_n")))
    return u.groupBy(*keys).agg(F.sum("_o").alias("n_old"), F.sum("_n").alias("n_new"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unique_only(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs once, without a self join: a group of one row is
    its own minimum."""
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in rest])
    return g.where("_n = 1").drop("_n")


def aggregate_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Duplicated keys collapsed: numbers summed, text taken at its minimum."""
    rest = [f for f in df.schema if f.name not in keys]
    return df.groupBy(*keys).agg(*[(sum0(F.col(f.name).cast("double")) if isinstance(f.dataType, NumericType) else F.min(f.name)).alias(f.name) for f in rest])


def changed_cells(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Long list (key, variable, old, new) of cells that differ on shared keys.

    Only keys that occur once on a side are compared: duplicates are dropped by
    an aggregate on the join key, whose partitioning the join then reuses. A change is one side missing, numbers apart by more than rounding, or text
    that is not equal. Both values are shown as text."""
    shared = [c for c in old.columns if c in new.columns and c not in keys]
    numeric = {f.name for f in old.schema if isinstance(f.dataType, NumericType)}
    old, new = unique_only(old.select(*keys, *shared), keys), unique_only(new.select(*keys, *shared), keys)
    j = old.select(*keys, *[F.col(c).alias(f"{c}__o") for c in shared]).join(new.select(*keys, *[F.col(c).alias(f"{c}__n") for c in shared]), keys)
    cells = []
    for c in shared:
        a, b = F.col(f"{c}__o"), F.col(f"{c}__n")
        one_missing = a.isNull() != b.isNull()
        differs = ~near(a, b) if c in numeric else a != b
        cells.append(F.when(one_missing | F.coalesce(differs, F.lit(False)),
                            F.struct(F.lit(c).alias("variable"), a.cast("string").alias("old"), b.cast("string").alias("new"))))
    return j.select(*keys, F.explode(F.array_compact(F.array(*cells))).alias("c")).select(*keys, "c.variable", "c.old", "c.new")
