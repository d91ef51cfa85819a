"""Group aggregates of the measurement pipeline, on long relations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import checkpointed, running_sum


def entity_means(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``n, mean, rss, var, se``: unbiased variance and naive standard error are null for one rating."""
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))
    return out.withColumn("rss", F.coalesce(F.col("var") * (F.col("n") - 1), F.lit(0.0))).withColumn("se", F.sqrt(F.col("var") / F.col("n")))


def raters_with_more(df: DataFrame, keys: Sequence[str], more_than: int = 2) -> DataFrame:
    """Rows of raters (and items) with more than so many rows."""
    return df.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys))).where(F.col("_n") > more_than).drop("_n")


def without_repeating_raters(df: DataFrame, rater: Sequence[str], entity: str) -> DataFrame:
    """Drops every rater who has any entity twice."""
    bad = df.groupBy(*rater, entity).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*rater).distinct()
    return df.join(bad, list(rater), "left_anti")


def straight_liners(df: DataFrame, rater: str, item: str, value: str, more_than: int = 2) -> DataFrame:
    """Raters all of whose items with more than so many answers have one distinct answer."""
    per = df.groupBy(rater, item).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(value).alias("k")).where(F.col("n") > more_than)
    return per.groupBy(rater).agg(F.max("k").alias("k")).where("k = 1").select(rater)


def analysis_raters(df: DataFrame, rater: str, item: str, entity: str, value: str) -> DataFrame:
    """Raters who survive the preparation of some item, without straight-liners."""
    kept = without_repeating_raters(raters_with_more(df, [rater, item]), [rater, item], entity).select(rater).distinct()
    return kept.join(straight_liners(df, rater, item, value), rater, "left_anti")


def mode(df: DataFrame, keys: Sequence[str], code: str) -> DataFrame:
    """Most frequent code per key, the smallest at a tie, and how many codes tie: ``keys, code, n, ties``."""
    counts = df.groupBy(*keys, code).agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy(*keys).agg(F.max("n").alias("n"))
    return counts.join(top, [*keys, "n"]).groupBy(*keys, "n").agg(F.min(code).alias(code), F.count(F.lit(1)).alias("ties"))


def collapse_workers(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per company and user: mean positive salary, weight of long jobs, distinct lines."""
    return df.groupBy(*keys).agg(
        F.avg(F.when(F.col("salary") > 0, F.col("salary"))).alias("salary"),
        F.avg("weight").alias("weight"),
        F.count_distinct("line").alias("lines"),
        F.count_if(F.col("enddate").isNull()).alias("open_jobs"),
    )


def probability_shares(df: DataFrame, key: str, weight: str, value: str, groups: Mapping[str, Column]) -> DataFrame:
    """Per group probability p: share sum(w p) / sum(w), and mean sum(w v p) / sum(w p); null on a zero divisor."""
    w, v = F.col(weight), F.col(value)
    aggs = []
    for name, p in groups.items():
        aggs += [F.try_divide(F.sum(w * p), F.sum(w)).alias(f"share_{name}"), F.try_divide(F.sum(w * v * p), F.sum(w * p)).alias(f"mean_{name}")]
    return df.groupBy(key).agg(*aggs)


def weighted_mean(value: str, weight: str) -> Column:
    """Weights of rows without a value do not count."""
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(F.when(F.col(value).isNotNull(), F.col(weight))))


def distribution(df: DataFrame, columns: Sequence[str], split: str | None = None) -> DataFrame:
    """``split, variable, category, n, share`` over several category columns, overall and per value of ``split``."""
    both = df.withColumn("_split", F.explode(F.array(F.lit("all"), *([F.col(split).cast("string")] if split else []))))
    long = both.select("_split", *[F.col(c).cast("string").alias(c) for c in columns]).unpivot("_split", list(columns), "variable", "category")
    counts = long.groupBy(F.col("_split").alias("split"), "variable", "category").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("split", "variable")))


def clustered_shares(df: DataFrame, rater: str, value: str, values: Sequence[int]) -> DataFrame:
    """Share of each answer, with a standard error clustered by rater: the mean and sd / sqrt(n) of the raters' own shares."""
    per = df.groupBy(rater).agg(*[F.avg((F.col(value) == v).cast("double")).alias(str(v)) for v in values])
    long = per.unpivot(rater, [str(v) for v in values], "answer", "share")
    out = long.groupBy("answer").agg(F.avg("share").alias("mean"), (F.stddev_samp("share") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return out.withColumn("low", F.col("mean") - 1.96 * F.col("se")).withColumn("high", F.col("mean") + 1.96 * F.col("se"))


def proportion(df: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """``p, se, low, high, n`` of a 0/1 flag with a binomial standard error, limits clipped to [0, 1]."""
    out = df.groupBy(*keys).agg(F.avg(flag).alias("p"), F.count(flag).alias("n")).withColumn("se", F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n")))
    return out.withColumn("low", F.greatest(F.lit(0.0), F.col("p") - 1.96 * F.col("se"))).withColumn("high", F.least(F.lit(1.0), F.col("p") + 1.96 * F.col("se")))


def option_shares(df: DataFrame, unit: str, options: str) -> DataFrame:
    """Share of units whose comma list holds each option."""
    total = df.agg(F.count_distinct(unit).alias("all"))
    rows = df.select(unit, F.explode(F.split(options, ",")).alias("option")).distinct()
    return rows.groupBy("option").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total)).select("option", (F.col("n") / F.col("all")).alias("share"))


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    """Shares of left-closed bins of a fixed width, by the bin's start."""
    counts = df.where(F.col(value).isNotNull()).groupBy((F.floor(F.col(value) / width) * width).alias("start")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    return counts.join(F.broadcast(total)).select("start", "n", (F.col("n") / F.col("all")).alias("share"))


def frequency_table(df: DataFrame, value: str) -> DataFrame:
    """``value, n, percent, cumulative``."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    summed = running_sum(counts, [F.col(value).asc_nulls_last()], "n", "_upto")
    rows = summed.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_all"))))  # one row
    return rows.select(value, "n", (100.0 * F.col("n") / F.col("_all")).alias("percent"), (100.0 * F.col("_upto") / F.col("_all")).alias("cumulative"))


def pair_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``a, b, n, corr, median_gap, p95_gap`` on complete cases of each pair, in one pass."""
    rows = df.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs]))).where("x is not null and y is not null")
    gap = F.abs(F.col("x") - F.col("y"))
    found = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("corr"))
    return found.join(percentiles(rows.select("a", "b", gap.alias("gap")), ["a", "b"], "gap", {"median_gap": 0.5, "p95_gap": 0.95}), ["a", "b"])


def percentiles(df: DataFrame, keys: Sequence[str], value: str, points: Mapping[str, float]) -> DataFrame:
    """``keys`` and a column for each of ``points``: exact percentiles, interpolated between neighbours, of values that are not null.

    Values are counted, and sorted and numbered in ranges, so that no task holds a group's values; a row for each range and key gives where it starts. Keys
    must not be null.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    dealt = checkpointed(counts.repartitionByRange(*keys, "_v").withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy(*keys, "_range").agg(F.sum("_c").alias("_s"))
    by = W.partitionBy(*keys).orderBy("_range")
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_s").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_s").over(W.partitionBy(*keys))).drop("_s")
    inner = dealt.withColumn("_upto", F.sum("_c").over(W.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)))
    last = F.col("_start") + F.col("_upto")  # places of a value among its group's: first <= place < last, counted from 0
    rows = inner.join(starts, [*keys, "_range"]).select(*keys, "_v", (last - F.col("_c")).alias("_first"), last.alias("_last"), "_n")
    at = lambda place: F.max(F.when((F.col("_first") <= place) & (place < F.col("_last")), F.col("_v")))
    aggs = []
    for name, p in points.items():
        place = (F.col("_n") - 1) * F.lit(p)
        low, high = at(F.floor(place)), at(F.ceil(place))
        share = F.max(place - F.floor(place))
        # Neighbours that are equal are not interpolated, as infinities are not.
        aggs.append(F.when(low == high, low).otherwise(low * (1 - share) + high * share).alias(name))
    return rows.groupBy(*keys).agg(*aggs)


def weighted_correlation(df: DataFrame, keys: Sequence[str], x: str, y: str, w: str) -> DataFrame:
    """Pearson correlation with weights, from weighted moments."""
    a, b, c = F.col(x), F.col(y), F.col(w)
    m = df.where(a.isNotNull() & b.isNotNull() & c.isNotNull()).groupBy(*keys).agg(F.sum(c).alias("s"), F.sum(c * a).alias("sx"), F.sum(c * b).alias("sy"), F.sum(c * a * a).alias("sxx"), F.sum(c * b * b).alias("syy"), F.sum(c * a * b).alias("sxy"))
    cov, vx, vy = (F.col(t) / F.col("s") - F.col(p) * F.col(q) / (F.col("s") * F.col("s")) for t, p, q in (("sxy", "sx", "sy"), ("sxx", "sx", "sx"), ("syy", "sy", "sy")))
    return m.select(*keys, F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).alias("corr"))


def preferred(df: DataFrame, keys: Sequence[str], preference: str) -> DataFrame:
    """Rows with the least preference value of their key."""
    return df.withColumn("_r", F.rank().over(W.partitionBy(*keys).orderBy(preference))).where("_r = 1").drop("_r")


def top_share(df: DataFrame, keys: Sequence[str], value: str, k: int = 4) -> DataFrame:
    """Share of the k largest members in the group's total."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(value).desc()))
    return df.withColumn("_r", rank).groupBy(*keys).agg((F.sum(F.when(F.col("_r") <= k, F.col(value))) / F.sum(value)).alias("top_share"))


def eligible_counts(df: DataFrame, rater: str, item: str, value: str) -> DataFrame:
    """Raters left by alternative sample rules: ``rule, raters``."""
    rules = {
        "any_answer": df.select(rater),
        "three_answers": raters_with_more(df, [rater, item]).select(rater),
        "no_straight_liners": df.select(rater).join(straight_liners(df, rater, item, value), rater, "left_anti"),
    }
    out = None
    for name, rows in rules.items():
        part = rows.agg(F.count_distinct(rater).alias("raters")).select(F.lit(name).alias("rule"), "raters")
        out = part if out is None else out.unionByName(part)
    return out
