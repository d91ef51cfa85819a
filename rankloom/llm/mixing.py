"""Mixing sources to target weights by Pareto order sampling, with built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, fresh, rank_in_order, salted_join, table, words_in, written

#: Size of the grid of the uniform numbers: 52 bits of an md5.
GRID = float(1 << 52)


def uniform(id_col: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the id and the seed alone, so that reruns agree."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(GRID)


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), cap: float = 3.0, share: float = 1.0) -> DataFrame:
    """One row per source from ``source, source_size``: adds ``target``.

    Sources in code point order, null last, weigh ``weights`` in turn. The targets
    share ``share`` of all words by weight, none above ``cap`` times its source's
    size; what is cut off goes to the others by weight. With sources sorted by
    cap / weight the level at which the shares stop is the first that its source
    does not exceed, so prefix sums give it without iterating. There is one row per
    source, not per document.
    """
    nth = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(cap))
    rows = sizes.withColumn("weight", weight).withColumn("limit", limit).withColumn("level", F.col("limit") / F.col("weight"))
    order = W.orderBy("level", F.col("source").isNull(), "source")
    below = F.coalesce(F.sum("limit").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    above = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(W.partitionBy()) * F.lit(float(share))
    rows = rows.withColumn("fits", (total - below) / above)
    found = F.min(F.when(F.col("fits") <= F.col("level"), F.struct("level", "fits"))).over(W.partitionBy())["fits"]
    target = F.when(found.isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("weight") * found))
    return rows.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    importance: Column | None = None,
    weights: Sequence[float] = (1.0, 2.0, 3.0),
    cap: int = 3,
    seed: int = 20,
    row_col: str | None = None,
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies, taken``, and ``row`` if there is a ``row_col``.

    A document of a source with target t and size s is wanted m = t / s times, times
    its ``importance`` over the source's mean by words. It gets floor(m) certain copies, and
    one more if it is among the first in the order of Pareto sampling: a random
    number's odds over the odds of its inclusion probability m - floor(m). The order
    is cut where the words taken come nearest to what the certain copies leave of
    the target, so the sample has a fixed size in words and, within a source,
    errs by half a document at most.

    The running sum behind the cut is made in blocks (``rank_in_order``) and the
    figures of a source reach its rows through a salted join, so a source that
    holds a third of all rows is spread out. Sizes are counted once and
    checkpointed.

    Null text has size 0, empty texts too; their ``taken`` is 0. A null source is
    a source, the last one. Rows with equal ids are taken alike or, at the cut, in
    the order of their size. Null or negative importance counts as 0. Other columns of
    ``docs`` are ignored, whatever their names. Without rows there is no result.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        words_in(F.col(text_col).cast("string")).alias("size"),
        (F.lit(1.0) if importance is None else F.greatest(F.coalesce(importance.cast("double"), F.lit(0.0)), F.lit(0.0))).alias("imp"),
        *([] if row_col is None else [F.col(row_col).alias("row")]),
    )
    kept = ["doc_id", "source", "size", "source_size", "target", "copies"] + ([] if row_col is None else ["row"])
    rows = checkpoint(rows)
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("imp")).alias("imp_size"))
    targets = source_targets(sums.select("source", "source_size"), weights, float(cap))
    t = targets.withColumnRenamed("source", "_src")
    figures = sums.select("source", "imp_size").join(t, F.col("source").eqNullSafe(F.col("_src"))).drop("_src")
    rows = salted_join(rows, figures, "source", "source_size", "target", "imp_size")
    # A share that is a whole number must not fall just below it through rounding.
    times = F.when(F.col("imp_size") > 0, F.col("target") / F.col("imp_size") * F.col("imp")).otherwise(F.lit(0.0))
    rows = rows.withColumn("times", F.least(F.lit(float(cap)), times)).withColumn("certain", F.floor(F.col("times") + 1e-9).cast("long"))
    chance = F.greatest(F.col("times") - F.col("certain"), F.lit(0.0))
    u = uniform(F.col("doc_id"), seed)
    ratio = (u / (1.0 - u)) / (chance / (1.0 - chance))
    rows = rows.withColumn("u", u).withColumn("at", F.when(chance > 0, ratio / (1.0 + ratio)).otherwise(F.lit(None)))
    rows = rows.withColumn("at", F.when(F.col("certain") >= cap, None).otherwise(F.least(F.col("at"), F.lit(1.0 - 2.0**-53))))
    ranked = checkpoint(rows)
    taken = ranked.groupBy("source").agg(F.sum(F.col("certain") * F.col("size")).alias("sure"), F.max("target").alias("t2"), F.avg(F.when(F.col("at").isNotNull(), F.col("times") - F.col("certain"))).alias("mean"))
    # Where all chances of a source are equal, the odds times those of the chance are those of the uniform number again.
    means = taken.select("source", (F.col("t2") - F.col("sure")).alias("left_over"), F.greatest(F.least(F.coalesce("mean", F.lit(0.5)), F.lit(1.0 - 1e-9)), F.lit(1e-9)).alias("mean"))
    odds = F.col("at") / (1.0 - F.col("at")) * F.col("mean") / (1.0 - F.col("mean"))
    open_rows = salted_join(ranked.where("at is not null"), means, "source", "mean", "left_over").withColumn("position", F.least(odds / (1.0 + odds), F.lit(1.0 - 2.0**-53)))
    open_rows = rank_in_order(checkpoint(open_rows), "source", ["at", "doc_id", "size", *kept[6:]], F.col("size"), "position")
    extra = (F.col("before") + F.col("size") / 2.0 <= F.col("left_over")).cast("long")
    both = open_rows.withColumn("copies", F.col("certain") + extra).select(*kept)
    rest = ranked.where("at is null").withColumn("copies", F.col("certain")).select(*kept)
    return both.unionByName(rest).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as ``mix`` takes each of them.

    The rows are written with their places, by which they get their numbers of copies; so rows
    that share an id, or have none, are taken one by one.
    """
    row, copies, nth, placed = (fresh(n, docs) for n in ("_row", "_copies", "_nth", "_placed"))
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()))
    taken = mix(rows, row_col=row, **options).where("copies > 0").select(F.col("row").alias(placed), F.col("copies").cast("int").alias(copies))
    joined = rows.join(taken, rows[row] == taken[placed])
    return joined.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def op10_source_mix(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS lim FROM s
), l AS (
  SELECT *, lim / weight AS level FROM w
), f AS (
  SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(lim) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fits FROM l
), t AS (
  SELECT source, source_size, least(lim, weight * (SELECT arg_min(fits, level) FROM f WHERE fits <= level)) AS target FROM f
), j AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
         least(3.0::DOUBLE, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END) AS times,
         (CAST('0x' || substr(md5('20:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), k AS (
  SELECT *, CAST(floor(times + 1e-9) AS BIGINT) AS certain, greatest(times - floor(times + 1e-9), 0) AS chance FROM j
), q AS (
  SELECT *, CASE WHEN chance > 0 AND certain < 3 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS ratio FROM k
), r AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source, ratio IS NULL ORDER BY ratio, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(certain * size) OVER (PARTITION BY source) AS sure FROM q
)
SELECT doc_id, size, source_size, target,
       CAST(size * (certain + CASE WHEN ratio IS NOT NULL AND before + size / 2.0 <= target - sure THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
