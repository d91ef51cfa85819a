"""Reshapes between wide and long relations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.columns import range_codes

from .quality import require_empty


def slots_to_long(df: DataFrame, keys: Sequence[str], stubs: Sequence[str], slots: Sequence[int] = range(1, 6)) -> DataFrame:
    """One row per slot from columns ``stub_slot`` of several stubs at once, in one pass."""
    rows = F.array(*[F.struct(F.lit(k).alias("slot"), *[F.col(f"{s}_{k}").alias(s) for s in stubs]) for k in slots])
    return df.select(*keys, F.inline(rows))


def ranks_to_wide(df: DataFrame, unit: str, entity: str, value: str, entities: Sequence[int], prefix: str = "firm") -> DataFrame:
    """Export form: a column per entity in numeric order, 0 where not ranked."""
    wide = df.groupBy(unit).agg(*[F.coalesce(F.max(F.when(F.col(entity) == e, F.col(value))), F.lit(0)).alias(f"{prefix}{e}") for e in sorted(entities)])
    return wide


def spread(df: DataFrame, keys: Sequence[str], name: str, values: Mapping[str, Column], outputs: Sequence[str]) -> DataFrame:
    """Conditional aggregates: for each output name and value column, the value of the rows with that name."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(name) == o, c)).alias(f"{o}_{v}" if v else o) for o in outputs for v, c in values.items()])


def complete(df: DataFrame, left: DataFrame, right: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """All combinations of two small dimensions, with 0 where the count is missing."""
    return left.crossJoin(right).join(df, list(keys), "left").withColumn(count, F.coalesce(count, F.lit(0)))


def expand_ranges(df: DataFrame, ranges: str, out: str) -> DataFrame:
    return df.withColumn(out, F.explode(range_codes(F.col(ranges))))


def triples(df: DataFrame, row: str, names: Sequence[str], column: str = "column", value: str = "value") -> DataFrame:
    """Matrix with a column per name to long triples."""
    return df.unpivot(row, list(names), column, value)


def result_grid(grid: DataFrame, results: DataFrame, keys: Sequence[str], cell: str, scale: float = 1.0) -> DataFrame:
    """Looks up estimate and standard error for each cell of a specification grid; a missing cell stays null."""
    found = results.select(*keys, (F.col("estimate") * scale).alias("estimate"), (F.col("se") * scale).alias("se"))
    return grid.join(found, list(keys), "left").select(cell, *keys, "estimate", "se")


def result_table(spec: DataFrame, results: DataFrame, keys: Sequence[str], columns: Sequence[str], scale: float = 1.0) -> DataFrame:
    """Results placed in a table: ``panel, row, line`` and a column for each of ``columns``.

    ``spec`` says by ``panel, row, column`` where the result with its ``keys`` goes. Each row has a line of estimates and one of standard errors; a
    cell without a result stays null, as does a row without any. A place that several results claim is an error.
    """
    require_empty(spec.groupBy("panel", "row", "column").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "a place has several results")
    found = result_grid(spec.select("panel", "row", "column", *keys).withColumn("_cell", F.struct("panel", "row", "column")), results, keys, "_cell", scale)
    lines = F.array(*[F.struct(F.lit(n).alias("line"), F.col(n).alias("value")) for n in ("estimate", "se")])
    long = found.select("_cell.*", F.inline(lines))
    return long.groupBy("panel", "row", "line").agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns])
