"""Row-wise operators on whole relations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import numbered
from rankloom.functions import columns as C


def rename_families(df: DataFrame, names: Mapping[str, str], families: Mapping[str, str] | None = None, slots: Sequence[int] = range(1, 6)) -> DataFrame:
    """Renames columns, and for each family ``var`` its columns ``var_k`` to ``name_k``."""
    all_names = dict(names) | {f"{old}_{k}": f"{new}_{k}" for old, new in (families or {}).items() for k in slots}
    return df.withColumnsRenamed(all_names)


def sentinels_to_null(df: DataFrame, sentinel: int = -1) -> DataFrame:
    """The sentinel becomes null in number columns, its text in text columns."""
    kinds = dict(df.dtypes)

    def fixed(c: str) -> Column:
        if kinds[c] == "string":
            return C.null_if(F.col(c), str(sentinel))
        return C.null_if(F.col(c), sentinel) if kinds[c] in ("int", "bigint", "smallint", "tinyint", "double", "float") else F.col(c)

    return df.select(*[fixed(c).alias(c) for c in df.columns])


def without_statuses(df: DataFrame, status: str, excluded: Sequence[str]) -> DataFrame:
    """Drops rows with an excluded status; null statuses stay."""
    return df.where(~F.coalesce(F.col(status).isin(*excluded), F.lit(False)))


def surrogate_ids(df: DataFrame, key: str, out: str) -> DataFrame:
    """Dense ids by the sorted distinct keys: the dimension is numbered by ranges, and joined back."""
    dim = df.select(key).where(F.col(key).isNotNull()).distinct()
    ranked = numbered(dim, [key], out).withColumn(out, (F.col(out) + 1).cast("int"))
    return df.join(ranked, key, "left")


def median_split(df: DataFrame, unit: str, value: str, out: str) -> DataFrame:
    """1 if the unit's value is above the exact median over distinct units, 0 if not, null for null."""
    middle = df.select(unit, value).distinct().agg(F.median(value).alias("_m"))
    joined = df.join(F.broadcast(middle))  # one row
    return joined.withColumn(out, F.when(F.col(value).isNull(), None).otherwise((F.col(value) > F.col("_m")).cast("int"))).drop("_m")


def attention_score(df: DataFrame, shown: Sequence[str], probes: Sequence[str], ticked: str, out: str = "attention_score") -> DataFrame:
    """Share of probes whose presence among the shown ones agrees with the ticked text; null without an answer."""
    hits = [(F.array_contains(F.array(*shown), F.col(p)) == F.contains(F.col(ticked), F.col(p))).cast("double") for p in probes]
    return df.withColumn(out, F.when(F.col(ticked).isNotNull(), sum(hits[1:], hits[0]) / len(hits)))


def override(base: DataFrame, supplement: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Columns of rows whose key is in the supplement come from there, null or not."""
    right = supplement.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = base.join(right, base[key] == F.col("_k"), "left")
    return joined.select(*[F.when(F.col("_k").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def append_newer(base: DataFrame, increment: DataFrame, ts: str) -> DataFrame:
    """Rows of the increment later than all of the base, appended by name."""
    last = base.agg(F.max(ts).alias("_last"))  # one row
    newer = increment.join(F.broadcast(last)).where(F.col("_last").isNull() | (F.col(ts) > F.col("_last"))).drop("_last")
    return base.unionByName(newer, allowMissingColumns=True)


def into_runs(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """One row per run a row belongs to: ``full``, and ``flag_value`` for each flag that is not null."""
    runs = [F.lit("full"), *[F.when(F.col(f).isNotNull(), F.concat(F.lit(f"{f}_"), F.col(f).cast("string"))) for f in flags]]
    return df.withColumn("run", F.explode(F.filter(F.array(*runs), lambda r: r.isNotNull())))


def blank_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which all the columns are null or blank, such as national totals."""
    test = F.lit(True)
    for c in columns:
        test = test & (F.col(c).isNull() | (F.trim(F.col(c)) == ""))
    return df.where(test)


def with_aliases(df: DataFrame, aliases: Mapping[str, str], optional: Mapping[str, str]) -> DataFrame:
    """Adds missing columns from their alias, and missing optional ones as null of a type."""
    new = {c: F.col(a) for c, a in aliases.items() if c not in df.columns and a in df.columns}
    return df.withColumns(new | {c: F.lit(None).cast(t) for c, t in optional.items() if c not in df.columns})


def overridden(df: DataFrame, manual: DataFrame, key: str, column: str) -> DataFrame:
    """Manual values where there are any, else the automatic ones."""
    m = manual.select(F.col(key).alias("_k"), F.col(column).alias("_v"))
    return df.join(m, df[key] == m["_k"], "left").withColumn(column, F.coalesce("_v", column)).drop("_k", "_v")


#: Cleaning variants of labour microdata: what happens to rows with an allocated wage.
CLEANING = ("baseline", "corrected", "ignore", "reported", "shares_only")


def microdata_universe(df: DataFrame, variant: str = "baseline", age: tuple[int, int] = (20, 60), hours: int = 35) -> DataFrame:
    """Private full-time workers in an age range with positive earnings below the top code; adds ``lnwage``.

    The baseline keeps rows whose allocation flag is not 0, the corrected variant
    those whose flag is 0, ``ignore`` both. ``reported`` takes the hourly wage that was reported (``hourly``, positive) where that was not allocated
    (``hourly_allocated`` 0), whatever the earnings are. ``shares_only`` has the wages of the corrected variant, see ``share_universe``.
    """
    if variant not in CLEANING:
        raise ValueError(f"no variant {variant}")
    rows = _workers(df, age, hours)
    if variant == "reported":
        return rows.where((F.col("hourly_allocated") == 0) & (F.col("hourly") > 0)).withColumn("lnwage", F.ln("hourly"))
    rows = rows.where((F.col("earn") > 0) & (F.col("earn") < F.col("topcode")))
    if variant == "baseline":
        rows = rows.where("allocated <> 0")
    elif variant in ("corrected", "shares_only"):
        rows = rows.where("allocated = 0")
    return rows.withColumn("lnwage", F.ln(F.col("earn") / F.col("hours")))


def share_universe(df: DataFrame, variant: str = "baseline", age: tuple[int, int] = (20, 60), hours: int = 35) -> DataFrame:
    """Rows that shares of workers are taken of: all workers of the universe for ``shares_only``, those with a wage otherwise."""
    return _workers(df, age, hours) if variant == "shares_only" else microdata_universe(df, variant, age, hours)


def _workers(df: DataFrame, age: tuple[int, int], hours: int) -> DataFrame:
    return df.where(F.col("private") & (F.col("hours") >= hours) & F.col("age").between(*age))


def measured_entities(df: DataFrame, entity: str, measure: str) -> DataFrame:
    """Distinct entities with an external measure."""
    return df.where(F.col(measure).isNotNull()).select(entity).distinct()
