"""Wage gaps and levels by industry from one regression on sparse one-hot designs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import checkpointed

#: Columns of a design; its k x k system is solved on the driver.
MAX_COLUMNS = 2_000
#: Between the two parts of an interaction's name.
AND = " & "


@dataclass
class Fit:
    """A weighted regression: what the columns are, their coefficients and robust covariance, and which directions the data determine.

    Numeric columns enter by powers of their standard scores, so ``origin`` has what they are where the numbers themselves are 0.
    """

    columns: dict[str, int]
    origin: dict[int, float]
    beta: np.ndarray
    covariance: np.ndarray
    determined: np.ndarray
    n: int

    def sum(self, *names: str) -> tuple[float | None, float | None]:
        """A sum of coefficients and its standard error, the constant being that of numeric columns of 0; None where the data do not determine it, or a column is not there."""
        c = np.zeros(len(self.beta))
        for name in names:
            if name not in self.columns:
                return None, None
            c[self.columns[name]] += 1
            if name == "const":
                for j, x in self.origin.items():
                    c[j] += x
        if np.abs(self.determined @ c - c).max() > 1e-6:
            return None, None
        return float(c @ self.beta), float(np.sqrt(max(0.0, c @ self.covariance @ c)))


def _levels(df: DataFrame, factors: Sequence[Column], numbers: Sequence[str]) -> tuple[list[list[str]], list[tuple[float, float]]]:
    """Sorted levels of each factor, and mean and standard deviation of each number, in one pass; more than MAX_COLUMNS levels are an error."""
    sets = [F.array_sort(F.collect_set(f)) for f in factors]
    moments = [f(F.col(c).cast("double")) for c in numbers for f in (F.avg, F.stddev_pop)]
    found = df.agg(F.lit(0), *sets, *moments).first()[1:]
    levels, rest = [list(x) for x in found[: len(sets)]], found[len(sets) :]
    if sum(map(len, levels)) > MAX_COLUMNS:
        raise ValueError(f"a design has at most {MAX_COLUMNS} columns")
    return levels, [(rest[i] or 0.0, rest[i + 1] or 1.0) for i in range(0, len(rest), 2)]


def _one_hot(value: Column, names: Sequence[str], prefix: str, columns: dict[str, int]) -> tuple[Column, Column]:
    """The column of a factor's level and its value, 1; value 0 for levels without a column."""
    for name in names:
        columns[f"{prefix}={name}"] = len(columns)
    if not names:
        return F.lit(0), F.lit(0.0)
    places = F.map_from_arrays(F.lit(list(names)), F.lit([columns[f"{prefix}={name}"] for name in names]))
    j = F.try_element_at(places, value)
    return F.coalesce(j, F.lit(0)).cast("int"), j.isNotNull().cast("double")


def _products(sparse: DataFrame, k: int, beta: np.ndarray | None = None) -> np.ndarray:
    """Sums of w x x' over the rows ``y, w, j, v`` of a design of k columns, its last column y; with ``beta``, of w^2 e^2 x x' without y.

    ``j`` and ``v`` are lists of equal length, the same for all rows: ascending columns and values, column 0 with value 0 for none. A task adds its rows up and returns the cells that are not 0, so at most k^2 rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1) * (k + 1))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            y, w = (batch.column(i).to_numpy() for i in range(2))
            j, v = (batch.column(i).flatten().to_numpy().reshape(n, -1) for i in (2, 3))
            if beta is None:
                j, v = np.column_stack([j, np.full(n, k)]), np.column_stack([v, y])
            else:
                w = (w * (y - (v * beta[j]).sum(axis=1))) ** 2
            a, b = np.triu_indices(j.shape[1])
            total += np.bincount((j[:, a] * (k + 1) + j[:, b]).ravel(), (w[:, None] * v[:, a] * v[:, b]).ravel(), len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at // (k + 1)), pa.array(at % (k + 1)), pa.array(total[at])], names=["i", "j", "v"])

    out = np.zeros((k + 1, k + 1))
    for r in sparse.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def least_squares(df: DataFrame, y: str, w: str, factors: Sequence[str], interaction: tuple[str, str] | None = None, bases: dict[str, str] | None = None, polynomials: dict[str, int] | None = None) -> Fit:
    """Regression of ``y`` with probability weights on a constant, one column for each level of the ``factors`` but one, the ``interaction`` of two of them, and powers of numeric columns.

    A row is a short list of columns and one of values. Each task adds up the products of its rows' entries, all of X'WX and
    X'Wy, and only sums by (column, column) are shuffled, k^2 for each task at most; a second pass sums
    w^2 e^2 x x'. Only these k x k sums reach the driver, k at most MAX_COLUMNS. Columns that depend on others are no error:
    what the data do not determine is null. Robust covariance times n / (n - rank).

    Rows with a null in any column, or without a positive weight, are left out. The base of a factor is its least level if ``bases`` names none.
    """
    bases, polynomials = bases or {}, polynomials or {}
    used = [F.col(f"`{c}`") for c in dict.fromkeys((y, w, *factors, *polynomials))]
    rows = checkpointed(df.select(*used).where(" and ".join(f"`{c}` is not null" for c in (y, w, *factors, *polynomials))).where(F.col(w) > 0))
    columns: dict[str, int] = {"const": 0}
    values = {f: F.col(f).cast("string") for f in factors}
    pair = F.concat_ws(AND, *(values[f] for f in interaction)) if interaction else None
    levels, moments = _levels(rows, [*values.values(), *([pair] if interaction else [])], list(polynomials))
    base = {f: bases.get(f, found[0] if found else "") for f, found in zip(factors, levels)}
    entries = [(F.lit(0), F.lit(1.0))]
    entries += [_one_hot(values[f], [x for x in found if x != base[f]], f, columns) for f, found in zip(factors, levels)]
    if interaction:
        inner = [x for x in levels[-1] if not any(x.split(AND)[i] == base[f] for i, f in enumerate(interaction))]
        entries.append(_one_hot(pair, inner, AND.join(interaction), columns))
    origin: dict[int, float] = {}
    for (name, degree), (mean, sd) in zip(polynomials.items(), moments):
        for p in range(1, degree + 1):
            columns[f"{name}^{p}"] = j = len(columns)
            origin[j] = (-mean / sd) ** p
            entries.append((F.lit(j), F.pow((F.col(name).cast("double") - mean) / sd, F.lit(float(p)))))
    k = len(columns)
    if k > MAX_COLUMNS:
        raise ValueError(f"a design has at most {MAX_COLUMNS} columns")
    sparse = rows.select(F.col(y).cast("double").alias("y"), F.col(w).cast("double").alias("w"), *(F.array(*parts).alias(n) for n, parts in zip("jv", zip(*entries))))
    first, n = _products(sparse, k), rows.count()
    scale = np.sqrt(np.maximum(np.diag(first)[:k], 1e-300))
    scaled = first[:k, :k] / np.outer(scale, scale)
    bread = np.linalg.pinv(scaled, rcond=1e-11, hermitian=True)
    determined = scaled @ bread
    rank = int(round(np.trace(determined)))
    bread = bread / np.outer(scale, scale)
    beta = bread @ first[:k, k]
    meat = _products(sparse, k, beta)[:k, :k]
    covariance = bread @ meat @ bread * (n / (n - rank) if n > rank else np.nan)
    return Fit(columns, origin, beta, covariance, determined * np.outer(scale, 1 / scale), n)


def gaps_and_levels(df: DataFrame, y: str, w: str, demo: str, industry: str, base: str, other: str, factors: Sequence[str] = (), polynomials: dict[str, int] | None = None) -> DataFrame:
    """``industry, gap, gap_se, level, level_se``: adjusted gap of the ``other`` group of ``demo`` to the ``base`` one in each industry, and the level of the base one.

    From one regression with the interaction of both, further ``factors`` and ``polynomials``; a gap is
    the sum of the main effect and the interaction, a level that of the constant and the industry. Null where an industry lacks one of the groups.
    """
    fit = least_squares(df, y, w, [demo, industry, *factors], (demo, industry), {demo: base}, polynomials)
    industries = [r[0] for r in df.where(F.col(industry).isNotNull()).select(F.col(industry).cast("string")).distinct().orderBy(industry).collect()]
    first = next((x for x in industries if f"{industry}={x}" not in fit.columns), None)
    out = []
    for x in industries:
        own = [] if x == first else [f"{industry}={x}"]
        inner = f"{demo}{AND}{industry}={other}{AND}{x}"
        both = [] if x == first else [inner]
        out.append((x, *fit.sum(f"{demo}={other}", *both), *fit.sum("const", *own)))
    return df.sparkSession.createDataFrame(out, "industry string, gap double, gap_se double, level double, level_se double")
