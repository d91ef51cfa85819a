"""Checks. Each returns the offending rows; ``require_empty`` turns them into an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A relation breaks a stated contract."""


def require_empty(bad: DataFrame, message: str) -> None:
    if rows := bad.limit(3).collect():
        raise ContractError(f"{message}: {rows}")


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that repeat or hold a null."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | null)


def not_null_count(columns: Sequence[str]) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + F.col(c).isNotNull().cast("int")
    return total


def not_exactly_one(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(not_null_count(columns) != 1)


def outside(df: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    """Rows with a value that is neither null nor in the domain."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))


def key_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only, with ``side``."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def largest_gap(df: DataFrame, a: Column, b: Column) -> DataFrame:
    return df.agg(F.max(F.abs(a - b)).alias("gap"))


def table_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, status``: added, removed, changed or same, by the hash of the common columns."""
    common = [c for c in old.columns if c in new.columns and c not in keys]
    a = old.select(*keys, F.xxhash64(*common, F.lit(0)).alias("_a"))
    b = new.select(*keys, F.xxhash64(*common, F.lit(0)).alias("_b"))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") == F.col("_b"), "same").otherwise("changed")
    return a.join(b, list(keys), "full").select(*keys, status.alias("status"))


def cell_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, column, old, new`` of cells that differ, as text, for keys on both sides."""
    common = [c for c in old.columns if c in new.columns and c not in keys]

    def long(df, name):
        return df.select(*keys, *[F.col(c).cast("string").alias(c) for c in common]).unpivot(list(keys), common, "column", name)

    return long(old, "old").join(long(new, "new"), [*keys, "column"]).where(~F.col("old").eqNullSafe(F.col("new")))


def recomputed_gap(stored: DataFrame, again: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``n, max_gap, mean_gap, corr`` of a column computed twice."""
    j = stored.select(*keys, F.col(value).alias("_a")).join(again.select(*keys, F.col(value).alias("_b")), list(keys))
    gap = F.abs(F.col("_a") - F.col("_b"))
    return j.agg(F.count(F.lit(1)).alias("n"), F.max(gap).alias("max_gap"), F.avg(gap).alias("mean_gap"), F.corr("_a", "_b").alias("corr"))


def disagreements(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Rows that both cover with different values."""
    return a.select(key, F.col(value).alias("first")).join(b.select(key, F.col(value).alias("second")), key).where("first <> second")


def unreconciled(parts: DataFrame, totals: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-6) -> DataFrame:
    """Groups whose parts do not sum to the reported total: ``keys, parts, total``."""
    p = parts.groupBy(*keys).agg(F.sum(value).alias("parts"))
    t = totals.select(*keys, F.col(value).alias("total"))
    return p.join(t, list(keys), "full").where(~(F.abs(F.col("parts") - F.col("total")) <= tolerance * F.greatest(F.lit(1.0), F.abs("total"))) | F.col("parts").isNull() | F.col("total").isNull())
