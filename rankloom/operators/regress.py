"""Errors-in-variables and least-squares regressions on long relations.

Rows carry a specification key, so a suite of specifications is one grouped job. Moments are aggregates with
map-side sums, joined back by specification; no specification is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import checkpointed


def _with(rows: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of ``stats``, one row per ``keys``; null keys match."""
    named = stats.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in stats.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return rows.join(named, on).drop(*[f"_k{i}" for i in range(len(keys))])


def partialled(df: DataFrame, spec: Sequence[str], y: str, xs: Sequence[str], w: str, fe: str | None = None) -> DataFrame:
    """Adds ``_N, wt, yt`` and ``xt0, xt1, ...``: weights scaled to sum to the number of rows, ``_N``, y and xs less their weighted (group) means.

    Rows without y, an x, or a positive weight are left out. They are written once, so what they come from is not computed again for each of their sums.
    """
    rows = checkpointed(df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (y, *xs)]) & (F.col(w) > 0)))
    names = {"y": y} | {f"x{i}": x for i, x in enumerate(xs)}
    by = [*spec, fe] if fe else list(spec)
    stats = rows.groupBy(*by).agg(*[(F.sum(F.col(w) * F.col(c)) / F.sum(w)).alias(f"_m{n}") for n, c in names.items()], F.count(F.lit(1)).alias("_N"), F.sum(w).alias("_w"))
    if fe:  # sums over the groups, which are few
        whole = stats.groupBy(*spec).agg(F.sum("_N").alias("_N"), F.sum("_w").alias("_w"))
        stats = _with(stats.drop("_N", "_w"), whole, spec)
    rows = _with(rows, stats, by)
    less = {"yt": F.col(y) - F.col("_my")} | {f"xt{i}": F.col(x) - F.col(f"_mx{i}") for i, x in enumerate(xs)}
    return rows.withColumns({"wt": F.col(w) * F.col("_N") / F.col("_w")} | less).drop("_w", *[f"_m{n}" for n in names])


def _sum(*factors: str | Column) -> Column:
    return F.sum(reduce(lambda a, b: a * b, [F.col(f) if isinstance(f, str) else f for f in factors]))


def eiv(df: DataFrame, spec: Sequence[str], y: str, x: str, w: str, noise: str, fe: str | None = None, cluster: str | None = None, df_adj: bool = False) -> DataFrame:
    """Regression with one regressor measured with known error variance: ``spec, b, se, n, ok``.

    After partialling out, Q = sum w x^2 - N sigma^2 and b = sum w x y / Q; each row's influence is
    w (x e + sigma^2 b) / Q, and the standard error the root of its summed squares, or
    with ``cluster`` of squared cluster sums times G / (G - 1), and with ``df_adj`` times N / (N - k) as well, where k counts the
    slope and the intercept or group effects. Not ok, with
    null figures, where Q is not positive or the corrected moments are not positive semidefinite.
    """
    rows = partialled(df, spec, y, [x], w, fe).withColumn("_noise", F.col(noise))
    m = rows.groupBy(*spec).agg(_sum("wt", "xt0", "xt0").alias("sxx"), _sum("wt", "xt0", "yt").alias("sxy"), _sum("wt", "yt", "yt").alias("syy"), F.first("_N").alias("n"), F.first("_noise").alias("sigma"), (F.count_distinct(fe) if fe else F.lit(1)).alias("effects"))
    m = m.withColumn("Q", F.col("sxx") - F.col("n") * F.col("sigma"))
    m = m.withColumn("ok", F.coalesce((F.col("Q") > 0) & (F.col("syy") * F.col("Q") >= F.col("sxy") * F.col("sxy")), F.lit(False)))
    m = m.select(*spec, "n", "sigma", "Q", "ok", "effects", F.when(F.col("ok"), F.col("sxy") / F.col("Q")).alias("b"))
    rows = _with(rows, m, spec).withColumn("infl", F.col("wt") * (F.col("xt0") * (F.col("yt") - F.col("b") * F.col("xt0")) + F.col("sigma") * F.col("b")) / F.col("Q"))
    firsts = [F.first(c).alias(c) for c in ("b", "n", "ok", "effects")]
    if cluster is not None:
        rows = rows.groupBy(*spec, cluster).agg(F.sum("infl").alias("infl"), *firsts)
    out = rows.groupBy(*spec).agg(F.sum(F.col("infl") * F.col("infl")).alias("v"), F.count(F.lit(1)).alias("G"), *firsts)
    scale = _cluster_scale(F.col("G"), F.col("n"), F.col("effects") + 1, df_adj) if cluster is not None else F.lit(1.0)
    return out.select(*spec, "b", F.sqrt(F.col("v") * scale).alias("se"), "n", "ok")


def _cluster_scale(g: Column, n: Column, k: Column, df_adj: bool) -> Column:
    """Null with one cluster, or without a degree of freedom."""
    scale = F.when(g > 1, g / (g - 1))
    return F.when(n > k, scale * n / (n - k)) if df_adj else scale


def eiv_known_reliability(df: DataFrame, spec: Sequence[str], y: str, x: str, w: str, reliability: float) -> DataFrame:
    """Slope with a known reliability: sigma^2 = (1 - reliability) times the weighted variance of x."""
    rows = partialled(df, spec, y, [x], w)
    m = rows.groupBy(*spec).agg(_sum("wt", "xt0", "xt0").alias("sxx"), _sum("wt", "xt0", "yt").alias("sxy"), F.first("_N").alias("n"))
    back = _with(rows, m.withColumn("b", F.col("sxy") / (F.col("sxx") * reliability)), spec)
    # The variance of x is estimated as well, so each row moves Q by reliability times its own share.
    infl = F.col("wt") * (F.col("xt0") * F.col("yt") - F.col("b") * reliability * F.col("xt0") * F.col("xt0")) / (F.col("sxx") * reliability)
    return back.withColumn("i", infl).groupBy(*spec).agg(F.first("b").alias("b"), F.sqrt(F.sum(F.col("i") * F.col("i"))).alias("se"), F.first("n").alias("n"))


def ols(df: DataFrame, spec: Sequence[str], y: str, x: str, cluster: str | None = None) -> DataFrame:
    """Simple regression with robust standard errors (HC1, or clustered with the same kind of factor): ``b, a, se, n, r2, adj_r2``."""
    rows = partialled(df.withColumn("_one", F.lit(1.0)), spec, y, [x], "_one")
    m = rows.groupBy(*spec).agg(F.first("_N").alias("nn"), _sum("xt0", "xt0").alias("sxx"), _sum("xt0", "yt").alias("sxy"), _sum("yt", "yt").alias("syy"), F.avg(y).alias("my"), F.avg(x).alias("mx"))
    rows = _with(rows, m.where("sxx > 0").withColumn("b", F.col("sxy") / F.col("sxx")), spec)
    rows = rows.withColumn("e", F.col("yt") - F.col("b") * F.col("xt0")).withColumn("i", F.col("xt0") * F.col("e") / F.col("sxx"))
    firsts = [F.first(c).alias(c) for c in ("b", "my", "mx", "nn", "syy")]
    if cluster:
        rows = rows.groupBy(*spec, cluster).agg(F.sum("i").alias("i"), F.sum(F.col("e") * F.col("e")).alias("ee"), *firsts)
    else:
        rows = rows.withColumn("ee", F.col("e") * F.col("e"))
    out = rows.groupBy(*spec).agg(F.sum(F.col("i") * F.col("i")).alias("v"), F.count(F.lit(1)).alias("G"), F.sum("ee").alias("see"), *firsts)
    n, g = F.col("nn"), F.col("G")
    scale = g / (g - 1) * (n - 1) / (n - 2) if cluster else n / (n - 2)
    r2 = F.when(F.col("syy") > 0, 1 - F.col("see") / F.col("syy"))
    enough = (n > 2) & (g > 1)
    return out.select(*spec, "b", (F.col("my") - F.col("b") * F.col("mx")).alias("a"), F.when(enough, F.sqrt(F.col("v") * scale)).alias("se"), n.alias("n"), r2.alias("r2"), F.when(n > 2, 1 - (1 - r2) * (n - 1) / (n - 2)).alias("adj_r2"))


def fitted_median_split(df: DataFrame, key: str, x: str, fit: DataFrame) -> DataFrame:
    """``key, propensity, high``: what a fit (``a, b``, one row) says of each ``key``, and whether that is above the median of all."""
    rows = df.select(key, x).distinct().where(F.col(x).isNotNull()).crossJoin(F.broadcast(fit.select("a", "b"))).select(key, (F.col("a") + F.col("b") * F.col(x)).alias("propensity"))
    middle = rows.agg(F.median("propensity").alias("_middle"))
    return rows.crossJoin(F.broadcast(middle)).select(key, "propensity", (F.col("propensity") > F.col("_middle")).alias("high"))


def interacted_eiv(df: DataFrame, group: str, spec: Sequence[str], y: str, x: str, w: str, noise: str, entity: str, fe: str | None = None) -> DataFrame:
    """Two subgroups stacked: ``b1, se1, b0, se0, d, se, ok`` with a slope each, their difference ``d`` and its standard error ``se``, clustered by entity.

    Each subgroup has its own intercept, or with ``fe`` its own group effects. Weights are scaled over the stack of N rows, so each
    slope's noise enters as N sigma^2 / 2, spread over all rows. The corrected moments of both slopes and y are tested together;
    where they are not positive semidefinite, figures are null. Cluster sums are scaled by G / (G - 1).
    """
    block = "_block"
    own = [group] if fe is None else [group, fe]
    stacked = df.withColumn(block, F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in own]))
    rows = partialled(stacked, spec, y, [x], w, block)
    one = F.col(group) == 1
    sides = {1: one, 0: ~one}
    sums = [F.sum(F.when(c, F.col("wt") * a * b)).alias(f"{n}{g}") for g, c in sides.items() for n, a, b in (("sxx", F.col("xt0"), F.col("xt0")), ("sxy", F.col("xt0"), F.col("yt")))]
    sums += [F.max(F.when(c, F.col(noise))).alias(f"sigma{g}") for g, c in sides.items()]
    m = rows.groupBy(*spec).agg(*sums, _sum("wt", "yt", "yt").alias("syy"), F.first("_N").alias("n"))
    m = m.withColumns({f"Q{g}": F.col(f"sxx{g}") - F.col("n") * F.col(f"sigma{g}") / 2 for g in sides})
    rest = F.col("syy") - F.col("sxy1") * F.col("sxy1") / F.col("Q1") - F.col("sxy0") * F.col("sxy0") / F.col("Q0")
    m = m.withColumn("ok", F.coalesce(F.when((F.col("Q1") > 0) & (F.col("Q0") > 0), rest >= 0), F.lit(False)))
    m = m.withColumns({f"b{g}": F.when(F.col("ok"), F.col(f"sxy{g}") / F.col(f"Q{g}")) for g in sides})
    back = _with(rows, m.select(*spec, "ok", *[f"{c}{g}" for g in sides for c in ("b", "Q", "sigma")]), spec)
    e = F.col("yt") - F.when(one, F.col("b1")).otherwise(F.col("b0")) * F.col("xt0")
    infl = {f"i{g}": F.col("wt") * (F.when(c, F.col("xt0") * e).otherwise(0.0) + F.col(f"sigma{g}") / 2 * F.col(f"b{g}")) / F.col(f"Q{g}") for g, c in sides.items()}
    firsts = [F.first(c).alias(c) for c in ("b1", "b0", "ok")]
    sums = back.withColumns(infl).groupBy(*spec, entity).agg(F.sum("i1").alias("i1"), F.sum("i0").alias("i0"), *firsts)
    gap = F.col("i1") - F.col("i0")
    out = sums.groupBy(*spec).agg(_sum("i1", "i1").alias("v1"), _sum("i0", "i0").alias("v0"), F.sum(gap * gap).alias("v"), F.count(F.lit(1)).alias("G"), *firsts)
    se = lambda c: F.when(F.col("G") > 1, F.sqrt(F.col(c) * F.col("G") / (F.col("G") - 1)))
    return out.select(*spec, "b1", se("v1").alias("se1"), "b0", se("v0").alias("se0"), (F.col("b1") - F.col("b0")).alias("d"), se("v").alias("se"), "ok")


def weighted_least_squares(df: DataFrame, y: str, xs: Sequence[str], w: str, combine: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """Weighted regression on a handful of columns: ``name, b, se`` (robust, times n / (n - k)).

    ``combine`` names sums of coefficients, by column, that are returned with their standard errors as well. The normal equations are one
    aggregate, k (k + 3) / 2 sums; their k x k system is solved
    on the driver, and a second pass sums the meat of the sandwich.
    """
    k = len(xs)
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    rows = df.where(" and ".join(f"{c} is not null" for c in (y, w, *xs)))
    c = [F.col(x).cast("double") for x in xs]
    first = rows.agg(*[F.sum(F.col(w) * c[i] * c[j]) for i, j in upper], *[F.sum(F.col(w) * x * F.col(y)) for x in c], F.count(F.lit(1))).first()
    a, m = np.zeros((k, k)), np.zeros((k, k))
    for (i, j), v in zip(upper, first):
        a[i, j] = a[j, i] = v or 0.0
    bread = np.linalg.pinv(a)
    beta = bread @ np.array([v or 0.0 for v in first[len(upper) : -1]])
    fit = sum((x * F.lit(float(b)) for x, b in zip(c[1:], beta[1:])), c[0] * F.lit(float(beta[0])))
    e2 = (F.col(y) - fit) * (F.col(y) - fit) * F.col(w) * F.col(w)
    for (i, j), v in zip(upper, rows.agg(*[F.sum(e2 * c[i] * c[j]) for i, j in upper]).first()):
        m[i, j] = m[j, i] = v or 0.0
    n = first[-1]
    v = bread @ m @ bread * (n / (n - k) if n > k else np.nan)
    wanted = {x: {x: 1.0} for x in xs} | dict(combine or {})
    at = {x: i for i, x in enumerate(xs)}
    out = []
    for name, parts in wanted.items():
        c = np.zeros(k)
        for x, f in parts.items():
            c[at[x]] = f
        out.append((name, float(c @ beta), float(np.sqrt(c @ v @ c))))
    return df.sparkSession.createDataFrame(out, "name string, b double, se double")


def eiv_many(df: DataFrame, spec: Sequence[str], y: str, xs: Sequence[str], w: str, noise: Mapping[tuple[str, str], float | str], fe: str | None = None, cluster: str | None = None, df_adj: bool = False) -> DataFrame:
    """Several mismeasured regressors: ``spec, name, b, se, n, ok``.

    ``noise`` has the error covariance of pairs of regressors, as numbers or columns that are constant in a specification; 0 where it has
    none. As in ``eiv``, b = Q^-1 sum w x y with Q = sum w x x' - N Sigma on partialled-out columns, and influences
    are Q^-1 w (x e + Sigma b). Spark sums the moments and influences; only the k x k systems are solved in Python, one row for each
    specification. Not ok, with null figures, where the corrected moments of y and xs are not positive semidefinite, or Q has no inverse.
    """
    k = len(xs)
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    sigma = {(i, j): noise.get((xs[i], xs[j]), noise.get((xs[j], xs[i]), 0.0)) for i, j in upper}
    rows = partialled(df, spec, y, xs, w, fe)
    rows = rows.withColumns({f"_s{i}_{j}": F.col(v).cast("double") if isinstance(v, str) else F.lit(float(v)) for (i, j), v in sigma.items()})
    sums = [F.first("_N").alias("n"), _sum("wt", "yt", "yt").alias("yy"), (F.count_distinct(fe) if fe else F.lit(1)).alias("effects")]
    sums += [_sum("wt", f"xt{i}", "yt").alias(f"xy{i}") for i in range(k)]
    sums += [_sum("wt", f"xt{i}", f"xt{j}").alias(f"xx{i}_{j}") for i, j in upper] + [F.first(f"_s{i}_{j}").alias(f"s{i}_{j}") for i, j in upper]
    m = rows.groupBy(*spec).agg(*sums)
    types = dict(df.dtypes)
    names = [f"b{i}" for i in range(k)] + [f"q{i}_{j}" for i in range(k) for j in range(k)]
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in spec), "n long, effects long, ok boolean", *(f"{c} double" for c in [*names, *(f"s{i}_{j}" for i, j in upper)])])

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                full = lambda c: np.array([[r[f"{c}{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
                s, v = full("s"), np.array([r[f"xy{i}"] for i in range(k)], float)
                q = full("xx") - r["n"] * s
                whole = np.block([[np.array([[r["yy"]]]), v[None, :]], [v[:, None], q]])
                good = bool(np.isfinite(whole).all()) and np.linalg.eigvalsh(whole).min() >= -1e-10 * np.abs(whole).max() and np.linalg.matrix_rank(q) == k
                inverse = np.linalg.inv(q) if good else np.full((k, k), np.nan)
                beta = inverse @ v if good else np.full(k, np.nan)
                out.append([*(r[c] for c in spec), r["n"], r["effects"], good, *(None if np.isnan(x) else float(x) for x in (*beta, *inverse.ravel())), *(r[f"s{i}_{j}"] for i, j in upper)])
            yield pd.DataFrame(out, columns=[*spec, "n", "effects", "ok", *names, *(f"s{i}_{j}" for i, j in upper)])

    solved = m.mapInPandas(solve, schema)
    back = _with(rows.drop("_N"), solved, spec)
    e = F.col("yt") - sum((F.col(f"b{i}") * F.col(f"xt{i}") for i in range(1, k)), F.col("b0") * F.col("xt0"))
    score = [F.col("wt") * (F.col(f"xt{i}") * e + sum((F.col(f"s{min(i, j)}_{max(i, j)}") * F.col(f"b{j}") for j in range(1, k)), F.col(f"s0_{i}") * F.col("b0"))) for i in range(k)]
    infl = {f"i{i}": sum((F.col(f"q{i}_{j}") * score[j] for j in range(1, k)), F.col(f"q{i}_0") * score[0]) for i in range(k)}
    back = back.withColumns(infl)
    firsts = [F.first(c).alias(c) for c in ("n", "effects", "ok", *(f"b{i}" for i in range(k)))]
    if cluster is not None:
        back = back.groupBy(*spec, cluster).agg(*[F.sum(f"i{i}").alias(f"i{i}") for i in range(k)], *firsts)
    out = back.groupBy(*spec).agg(*[_sum(f"i{i}", f"i{i}").alias(f"v{i}") for i in range(k)], F.count(F.lit(1)).alias("G"), *firsts)
    scale = _cluster_scale(F.col("G"), F.col("n"), F.col("effects") + k, df_adj) if cluster is not None else F.lit(1.0)
    each = F.array(*[F.struct(F.lit(x).alias("name"), F.col(f"b{i}").alias("b"), F.sqrt(F.col(f"v{i}") * scale).alias("se")) for i, x in enumerate(xs)])
    return out.select(*spec, "n", "ok", F.explode(each).alias("c")).select(*spec, "c.*", "n", "ok")
