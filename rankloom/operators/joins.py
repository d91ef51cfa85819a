"""Joins with stated cardinality, key cascades and interval overlaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quality import require_empty, repeated_keys
from .tables import checkpointed


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", one_to_one: bool = False) -> DataFrame:
    """Join that fails unless keys are unique on the right, and on the left as well if one to one."""
    require_empty(repeated_keys(right, on), "keys repeat on the right side")
    if one_to_one:
        require_empty(repeated_keys(left, on), "keys repeat on the left side")
    return left.join(right, list(on), how)


def outer_with_source(left: DataFrame, right: DataFrame, on: Sequence[str], out: str = "source") -> DataFrame:
    """Full outer join that tells where a key was found: left, right or both."""
    a, b = left.withColumn("_l", F.lit(1)), right.withColumn("_r", F.lit(1))
    found = F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("both")
    return a.join(b, list(on), "full").withColumn(out, found).drop("_l", "_r")


def unmatched(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on), "left_anti")


def rater_pairs(df: DataFrame, cell: Sequence[str], entity: str, values: Sequence[str] = (), ordered: bool = False) -> DataFrame:
    """Pairs of entities of one rater (and the other columns of ``cell``): each once as i < j, or both ways if ``ordered``."""
    a = df.select(*cell, F.col(entity).alias("i"), *[F.col(v).alias(f"{v}_i") for v in values])
    b = df.select(*cell, F.col(entity).alias("j"), *[F.col(v).alias(f"{v}_j") for v in values])
    return a.join(b, list(cell)).where("i <> j" if ordered else "i < j")


def unique_tier_keys(dim: DataFrame, key_id: str, keys: Column) -> DataFrame:
    """``tier, key, id`` of keys that belong to one dimension row in their tier."""
    rows = dim.select(F.col(key_id).alias("id"), F.inline(keys)).where("key is not null").distinct()
    return rows.groupBy("tier", "key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def cascade_match(facts: DataFrame, fact_id: str, fact_keys: Column, dim: DataFrame, dim_id: str, dim_keys: Column) -> DataFrame:
    """First tier, from strict to loose, in which a fact's key is unique among the dimension: ``fact_id, tier, id``."""
    usable = unique_tier_keys(dim, dim_id, dim_keys)
    rows = facts.select(fact_id, F.inline(fact_keys)).join(usable, ["tier", "key"])
    return rows.groupBy(fact_id).agg(F.min(F.struct("tier", "id")).alias("m")).select(fact_id, "m.tier", "m.id")


def cascade_one_to_one(facts: DataFrame, fact_id: str, fact_keys: Column, dim: DataFrame, dim_id: str, dim_keys: Column, tiers: int = 7) -> DataFrame:
    """The same, but a dimension row serves one fact: within a tier the least fact id takes it.

    One step per tier; each works on the facts and dimension rows still free, which are checkpointed, so
    that the plan does not grow with the tiers.
    """
    rows = facts.select(F.col(fact_id).alias("f"), F.inline(fact_keys)).where("key is not null")
    rows, usable = checkpointed(rows), checkpointed(unique_tier_keys(dim, dim_id, dim_keys))
    done = None
    for t in range(1, tiers + 1):
        f, u = rows.where(F.col("tier") == t), usable.where(F.col("tier") == t)
        if done is not None:
            f = f.join(done, "f", "left_anti")
            u = u.join(done.select("id"), "id", "left_anti")
        got = f.select("f", "key").join(u.select("key", "id"), "key").groupBy("id").agg(F.min("f").alias("f")).select("f", "id", F.lit(t).alias("tier"))
        done = checkpointed(got if done is None else done.unionByName(got))
    return done.select(F.col("f").alias(fact_id), "tier", "id")


def alternative_match(facts: DataFrame, fact_key: str, dim: DataFrame, dim_id: str, fields: Sequence[str]) -> DataFrame:
    """Matches on the first of several fields of the dimension; fails if a key means two rows. Adds ``dim_id, field``."""
    keys = None
    for rank, field in enumerate(fields):
        part = dim.select(F.col(field).alias("_key"), F.col(dim_id), F.lit(rank).alias("_rank"), F.lit(field).alias("field")).where("_key is not null")
        keys = part if keys is None else keys.unionByName(part)
    require_empty(keys.groupBy("_key").agg(F.count_distinct(dim_id).alias("n")).where("n > 1"), "a key means two rows")
    best = keys.groupBy("_key").agg(F.min(F.struct("_rank", dim_id, "field")).alias("m")).select("_key", f"m.{dim_id}", "m.field")
    return facts.join(best, facts[fact_key] == best["_key"], "left").drop("_key")


def overlapping(df: DataFrame, start: str, end: str, low, high) -> DataFrame:
    """Rows whose closed interval meets [low, high]; a null end is open."""
    return df.where((F.col(start).isNull() | (F.col(start) <= high)) & (F.col(end).isNull() | (F.col(end) >= low)))


def interval_join(left: DataFrame, right: DataFrame, on: Sequence[str], step_days: int = 64) -> DataFrame:
    """Pairs of rows with equal keys and overlapping date ranges (``start, end``, closed, not null).

    Both sides are dealt into buckets of ``step_days`` days that they touch, so the join is
    an equi join; a pair is emitted in the first bucket that both touch.
    """

    def dealt(df, s):
        first, last = (F.floor(F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) / step_days).cast("int") for c in ("start", "end"))
        return df.select(*on, *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c not in on], first.alias(f"_first_{s}"), F.explode(F.sequence(first, last)).alias("_bucket"))

    joined = dealt(left, "l").join(dealt(right, "r"), [*on, "_bucket"])
    met = joined.where((F.col("_bucket") == F.greatest("_first_l", "_first_r")) & (F.col("start_l") <= F.col("end_r")) & (F.col("start_r") <= F.col("end_l")))
    return met.drop("_bucket", "_first_l", "_first_r")


def inherited(own: DataFrame, parents: DataFrame, metrics: DataFrame, entity: str, source: str) -> DataFrame:
    """Metrics by source id for entities, and for brands those of their parent (``parents``: entity, source)."""
    links = own.select(F.col(entity), F.col(entity).alias(source)).union(parents.select(entity, source)).distinct()
    return links.join(metrics, source)


def pair_key(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def with_both_variances(cov: DataFrame, var: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Attaches variance rows to both sides of covariance rows (``lhs, rhs``); no row is lost or doubled if variance keys are unique."""
    out = cov
    for side, s in (("lhs", 1), ("rhs", 2)):
        v = var.select(*keys, F.col("item").alias(side), *[F.col(c).alias(f"{c}{s}") for c in values])
        out = out.join(v, [*keys, side], "left")
    return out


def crosswalk(first: DataFrame, second: DataFrame, dropped: DataFrame) -> DataFrame:
    """Composition of ``a, b`` and ``b, bin`` without the dropped pairs ``a, bin``; fails if a code still means two bins."""
    both = first.join(second, "b").select("a", "bin").distinct().join(dropped, ["a", "bin"], "left_anti")
    require_empty(repeated_keys(both, ["a"]), "a code means two bins")
    return both


def first_match_by_row(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in an order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")
