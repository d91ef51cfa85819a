"""Joint positivity correction of the signal covariance of several noisy regressors, for all specifications at once.

A specification's signal, observed covariance less noise, is drawn again with the covariance that the delta method gives it; draws
that are positive definite are averaged. Specifications and draws are rows of Spark jobs; only k x k matrices are handled in Python, one row for each specification.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import checkpointed

#: Draws in a batch, accepted draws at which a specification is done, and most draws.
BATCH, QUOTA, DRAWS = 10_000, 5_000, 50_000
#: Least eigenvalue of a positive definite matrix, and distance of relative signals from 0 and 1.
LEAST = 1e-10
SEED = 1961


def cells(k: int) -> list[tuple[int, int]]:
    """Distinct entries of a symmetric matrix."""
    return [(i, j) for j in range(k) for i in range(j, k)]


def lifted(m: np.ndarray, floor: float) -> np.ndarray:
    """``m`` with eigenvalues of at least ``floor``."""
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    return (vectors * np.maximum(values, floor)) @ vectors.T


def signal_variances(spread: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Covariance of the distinct entries of a weighted covariance, when each entity's regressors err with covariance ``noise``.

    ``spread``: sums of squared weights times products of centred regressors. An entry (i, j) moves with the error of i by the
    value of j and the other way round, so two entries share four such terms.
    """
    own = cells(len(noise))
    return np.array([[spread[j, b] * noise[i, a] + spread[j, a] * noise[i, b] + spread[i, b] * noise[j, a] + spread[i, a] * noise[j, b] for a, b in own] for i, j in own])


def inside(signal: np.ndarray, observed: np.ndarray, floor: float = LEAST) -> np.ndarray:
    """``signal`` with eigenvalues relative to ``observed`` between ``floor`` and 1 - ``floor``."""
    values, vectors = np.linalg.eigh(lifted(observed, floor))
    root, back = ((vectors * np.maximum(values, floor) ** p) @ vectors.T for p in (0.5, -0.5))
    values, vectors = np.linalg.eigh(back @ signal @ back)
    return root @ ((vectors * np.clip(values, floor, 1 - floor)) @ vectors.T) @ root


def _square(values: Sequence[float], k: int) -> np.ndarray:
    out = np.zeros((k, k))
    for (i, j), v in zip(cells(k), values):
        out[i, j] = out[j, i] = v
    return out


def _list(m: np.ndarray) -> list[float]:
    return [float(x) for x in np.asarray(m).ravel()]


def _minors(v: Mapping[tuple[int, int], Column], k: int) -> Column:
    """That all leading principal minors are positive, for k of 1 to 3."""
    c = lambda i, j: v[max(i, j), min(i, j)]
    ok = c(0, 0) > LEAST
    if k >= 2:
        ok = ok & (c(0, 0) * c(1, 1) - c(0, 1) * c(0, 1) > 0)
    if k == 3:
        ok = ok & (c(0, 0) * (c(1, 1) * c(2, 2) - c(1, 2) * c(1, 2)) - c(0, 1) * (c(0, 1) * c(2, 2) - c(1, 2) * c(0, 2)) + c(0, 2) * (c(0, 1) * c(1, 2) - c(1, 1) * c(0, 2)) > 0)
    return ok


def _uniform(stream: int) -> Column:
    return (F.pmod(F.xxhash64("id", F.lit(stream), F.lit(SEED)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def prepared_signals(rows: DataFrame, spec: Sequence[str], xs: Sequence[str], w: str, raw: Mapping[tuple[str, str], str]) -> DataFrame:
    """One row for each specification: ``observed, noise, signal`` (distinct entries), ``root`` of the signal's covariance, and whether it is to be drawn, ``open``.

    All sums over entities are one aggregate; weights count relative to their sum. ``raw`` names columns of noise that are constant in a
    specification; a pair without one has none. A specification with a null or infinite moment is not ``good``; with a noise below 1e-12 for one of its regressors, or with a
    signal that is positive definite and certain, it is good and not open.
    """
    k, own = len(xs), cells(len(xs))
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*xs, w)]) & (F.col(w) > 0)
    x = [F.col(c).cast("double") for c in xs]
    named = {(i, j): raw.get((xs[i], xs[j]), raw.get((xs[j], xs[i]))) for i, j in own}
    sums: dict[str, Column] = {}
    for p in (1, 2):
        f = F.pow(F.col(w).cast("double"), F.lit(float(p)))
        sums[f"w{p}"] = F.sum(f)
        sums |= {f"w{p}_{i}": F.sum(f * x[i]) for i in range(k)} | {f"w{p}_{i}_{j}": F.sum(f * x[i] * x[j]) for i, j in own}
    sums |= {f"raw_{i}_{j}": F.first(F.col(c).cast("double")) if c else F.lit(0.0) for (i, j), c in named.items()}
    m = rows.where(ok).groupBy(*spec).agg(*(c.alias(n) for n, c in sums.items()))
    out = ["observed", "noise", "signal", "root"]

    def matrices(batches):
        for pdf in batches:
            lines = []
            for r in pdf.to_dict("records"):
                square = lambda name: _square([np.nan if r[f"{name}_{i}_{j}"] is None else r[f"{name}_{i}_{j}"] for i, j in own], k)
                one, two = (np.array([r[f"w{p}_{i}"] for i in range(k)], float) for p in (1, 2))
                mean = one / r["w1"]
                observed = square("w1") / r["w1"] - np.outer(mean, mean)
                spread = (square("w2") - np.outer(mean, two) - np.outer(two, mean) + np.outer(mean, mean) * r["w2"]) / r["w1"] ** 2
                noise = square("raw")
                good = bool(np.isfinite(observed).all() and np.isfinite(noise).all())
                if not good:
                    lines.append([*(r[c] for c in spec), *[None] * 4, False, False])
                    continue
                noisy = bool((np.abs(noise).max(axis=1) > 1e-12).all())
                if np.linalg.eigvalsh(noise).min() < -1e-8:
                    noise = lifted(noise, LEAST)
                signal = observed - noise
                values, vectors = np.linalg.eigh(signal_variances(spread, noise))
                root = vectors * np.sqrt(np.maximum(values, 0))
                sure = np.linalg.eigvalsh(signal).min() > LEAST and values.max() < 1e-16
                lines.append([*(r[c] for c in spec), *(_list([a[i, j] for i, j in own]) for a in (observed, noise, signal)), _list(root), noisy, noisy and not sure])
            yield pd.DataFrame(lines, columns=[*spec, *out, "good", "open"])

    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in spec), *(f"{c} array<double>" for c in out), "good boolean, open boolean"])
    return m.mapInPandas(matrices, schema)


def accepted_draws(specs: DataFrame, spec: Sequence[str], k: int) -> DataFrame:
    """``spec..., accepted, draws, sums`` of the open specifications: sums over their positive definite draws.

    Draws come in batches; a specification that has its quota leaves, and no one gets more than DRAWS. All specifications see the same standard normals,
    by hashes of the number of a draw, so reruns and lost tasks agree.
    """
    own = cells(k)
    left, found = specs.where("open").select(*spec, "signal", "root"), None
    for low in range(0, DRAWS, BATCH):
        share = 250
        parts = left.select("*", F.explode(F.sequence(F.lit(low // share), F.lit((low + BATCH) // share - 1))).alias("part")).repartition(*spec, "part")
        rows = parts.select(*spec, "signal", "root", F.explode(F.sequence(F.col("part") * share, F.col("part") * share + (share - 1))).alias("id"))
        normal = [F.sqrt(-2 * F.ln(_uniform(2 * m))) * F.cos(2 * np.pi * _uniform(2 * m + 1)) for m in range(len(own))]
        rows = rows.withColumns({f"z{m}": z for m, z in enumerate(normal)})
        value = [reduce(lambda a, b: a + b, [F.get("root", F.lit(a * len(own) + m)) * F.col(f"z{m}") for m in range(len(own))], F.get("signal", F.lit(a))) for a in range(len(own))]
        rows = rows.select(*spec, *(v.alias(f"v{a}") for a, v in enumerate(value)))
        rows = rows.withColumn("in", _minors({c: F.col(f"v{a}") for a, c in enumerate(own)}, k))
        sums = [F.coalesce(F.sum(F.when(F.col("in"), F.col(f"v{a}"))), F.lit(0.0)).alias(f"s{a}") for a in range(len(own))]
        batch = checkpointed(rows.groupBy(*spec).agg(F.count_if("in").alias("accepted"), F.count(F.lit(1)).alias("draws"), *sums))
        found = batch if found is None else found.unionByName(batch)
        total = found.groupBy(*spec).agg(F.sum("accepted").alias("accepted"), F.sum("draws").alias("draws"), F.array(*[F.sum(f"s{a}") for a in range(len(own))]).alias("sums"))
        left = checkpointed(left.join(total.where(F.col("accepted") >= QUOTA), list(spec), "left_anti"))
        if left.isEmpty():
            break
    return total


def joint_noise(rows: DataFrame, spec: Sequence[str], xs: Sequence[str], w: str, raw: Mapping[tuple[str, str], str], scalar: Mapping[tuple[str, str], str]) -> tuple[DataFrame, dict[tuple[str, str], str]]:
    """``rows`` with the corrected noise of each pair of two or three regressors as columns, with ``corrected, accepted, draws``; and the names of these columns.

    The mean of the accepted draws, or without any the signal made positive definite, is kept inside the observed covariance;
    what is left of that is noise. Where this is not possible, or one of the regressors has no noise, the columns that ``scalar`` names hold. Rows that the regression can't use get the noise of their specification too.
    """
    k, own = len(xs), cells(len(xs))
    if k not in (2, 3):
        raise ValueError("two or three noisy regressors")
    specs = checkpointed(prepared_signals(rows, spec, xs, w, raw))
    drawn = accepted_draws(specs, spec, k)
    names = {(xs[i], xs[j]): f"_joint_{i}_{j}" for i, j in own}
    head = [F.col(c).alias(f"_key_{c}") for c in spec]

    def noise_of(batches):
        for pdf in batches:
            lines = []
            for r in pdf.to_dict("records"):
                observed, signal = _square(r["observed"], k), _square(r["signal"], k)
                count = 0 if r["accepted"] is None or np.isnan(r["accepted"]) else int(r["accepted"])
                if r["open"]:
                    signal = _square(np.asarray(r["sums"]) / count, k) if count else lifted(signal, LEAST)
                noise = observed - inside(signal, observed)
                if np.linalg.eigvalsh(noise).min() < -1e-8:
                    noise = lifted(noise, LEAST)
                good = bool(np.isfinite(noise).all())
                lines.append([*(r[c] for c in spec), *(float(noise[i, j]) if good else None for i, j in own), good, count, 0 if count == 0 and not r["open"] else int(r["draws"])])
            yield pd.DataFrame(lines, columns=[*spec, *names.values(), "corrected", "accepted", "draws"])

    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in spec), *(f"{c} double" for c in names.values()), "corrected boolean, accepted long, draws long"])
    found = specs.where("good").join(drawn, list(spec), "left").mapInPandas(noise_of, schema)
    found = checkpointed(found.select(*head, *names.values(), "corrected", "accepted", "draws"))
    out = rows.join(found, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_key_{c}") for c in spec]), "left").drop(*(f"_key_{c}" for c in spec))
    plain = {(i, j): scalar.get((xs[i], xs[j]), scalar.get((xs[j], xs[i]))) for i, j in own}
    out = out.withColumns({names[xs[i], xs[j]]: F.coalesce(F.col(names[xs[i], xs[j]]), F.col(plain[i, j]) if plain[i, j] else F.lit(0.0)) for i, j in own})
    return out.withColumn("corrected", F.coalesce("corrected", F.lit(False))), names
