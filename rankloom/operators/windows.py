"""Window operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import numbered


def ranks_within(df: DataFrame, keys: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """Dense rank, smallest value first."""
    return df.withColumn(out, F.dense_rank().over(W.partitionBy(*keys).orderBy(value)))


def top_and_bottom(df: DataFrame, keys: Sequence[str], value: str, tie: str, k: int) -> DataFrame:
    """The k highest and k lowest rows per key, with ``end`` and ``place``; ties by ``tie``."""
    high = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(value).desc(), tie))
    low = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(value).asc(), tie))
    rows = df.withColumn("_h", high).withColumn("_l", low)
    ends = F.array(F.struct(F.lit("top").alias("end"), F.col("_h").alias("place")), F.struct(F.lit("bottom").alias("end"), F.col("_l").alias("place")))
    return rows.where((F.col("_h") <= k) | (F.col("_l") <= k)).withColumn("e", F.explode(ends)).select(*df.columns, "e.end", "e.place").where(F.col("place") <= k)


def absolute_sums(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """``left_sum, right_sum``: summed distance of a value to the smaller and to the larger ones of its key."""
    w = W.partitionBy(*keys).orderBy(value, *order)
    before, after = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(1, W.unboundedFollowing)
    x = F.col(value)
    left = x * F.count(value).over(before) - F.coalesce(F.sum(value).over(before), F.lit(0))
    right = F.coalesce(F.sum(value).over(after), F.lit(0)) - x * F.count(value).over(after)
    return df.withColumn("left_sum", left).withColumn("right_sum", right)


def share_of_group(df: DataFrame, keys: Sequence[str], value: str, out: str = "share") -> DataFrame:
    return df.withColumn(out, F.col(value) / F.sum(value).over(W.partitionBy(*keys)))


def weighted_demean(df: DataFrame, keys: Sequence[str], value: str, weight: str, out: str) -> DataFrame:
    w = W.partitionBy(*keys)
    return df.withColumn(out, F.col(value) - F.sum(F.col(value) * F.col(weight)).over(w) / F.sum(weight).over(w))


def z_score(value: str, keys: Sequence[str] = ()) -> Column:
    """Null where the group's standard deviation is 0 or undefined."""
    w = W.partitionBy(*keys)
    sd = F.stddev_samp(value).over(w)
    return F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / sd)


def rescaled(df: DataFrame, value: str, like: str, out: str) -> DataFrame:
    """``value`` moved to the mean and standard deviation of ``like`` over all rows."""
    m = df.agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"), F.avg(like).alias("_lm"), F.stddev_samp(like).alias("_ls"))
    return df.join(F.broadcast(m)).withColumn(out, F.col("_lm") + (F.col(value) - F.col("_m")) * F.col("_ls") / F.col("_s")).drop("_m", "_s", "_lm", "_ls")


def inconstant_keys(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys within which a value is not constant."""
    return df.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high")).where("low <> high")


def permuted_ids(df: DataFrame, entity: str, seed: int, out: str) -> DataFrame:
    """A seeded random permutation of a dimension's ids."""
    ids = df.select(entity).distinct()
    a = numbered(ids, [entity], "_n")
    b = numbered(ids.select(F.col(entity).alias(out)).withColumn("_h", F.xxhash64(out, F.lit(seed))), ["_h", out], "_n").drop("_h")
    return a.join(b, "_n").drop("_n")
