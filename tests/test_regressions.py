"""Regressions, vector tests and shrinkage against their matrix forms in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import compare as K
from rankloom.operators import denoise as D
from rankloom.operators import estimates as E
from rankloom.operators import regress as R
from rankloom.operators.tables import numbered


def simulated(k, n=60, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k)) @ (np.eye(k) + 0.3)
    y = x @ np.arange(1, k + 1) + rng.normal(size=n)
    return x, y, rng.uniform(1, 3, n), np.arange(n) % 4, np.arange(n) % 9


def frame(spark, x, y, w, g, c):
    rows = [("s", *map(float, a), float(b), float(v), int(i), int(j)) for a, b, v, i, j in zip(x, y, w, g, c)]
    cols = ", ".join(f"x{i} double" for i in range(x.shape[1]))
    return spark.createDataFrame(rows, f"spec string, {cols}, y double, w double, g int, c int")


def matrix_form(x, y, w, design, sigma, cluster=None, df_adj=False):
    """Coefficients of x and their standard errors, from the whole design and its corrected normal equations."""
    n, k = len(y), x.shape[1]
    w = w * n / w.sum()
    full = np.hstack([x, design])
    s = np.zeros((full.shape[1],) * 2)
    s[:k, :k] = sigma
    q = full.T @ (w[:, None] * full) - n * s
    b = np.linalg.solve(q, full.T @ (w * y))
    scores = w[:, None] * (full * (y - full @ b)[:, None] + s @ b)
    assert np.abs(scores.sum(axis=0)).max() < 1e-9  # the estimating equation holds
    infl = scores @ np.linalg.inv(q)
    scale = 1.0
    if cluster is not None:
        infl = np.array([infl[cluster == v].sum(axis=0) for v in np.unique(cluster)])
        scale = len(infl) / (len(infl) - 1) * (n / (n - full.shape[1]) if df_adj else 1)
    return b[:k], np.sqrt((infl**2).sum(axis=0) * scale)[:k]


@pytest.mark.parametrize("k, effects, clustered", [(1, False, False), (1, True, True), (2, False, True), (2, True, False), (3, True, True)])
def test_errors_in_variables_is_the_matrix_form(spark, k, effects, clustered):
    x, y, w, g, c = simulated(k)
    sigma = 0.02 * np.eye(k) + 0.004  # small enough for the moments to stay positive semidefinite
    noise = {(f"x{i}", f"x{j}"): float(sigma[i, j]) for i in range(k) for j in range(i, k)}
    design = np.eye(4)[g] if effects else np.ones((len(y), 1))
    for adj in (False, True):
        want_b, want_se = matrix_form(x, y, w, design, sigma, c if clustered else None, adj)
        got = R.eiv_many(frame(spark, x, y, w, g, c), ["spec"], "y", [f"x{i}" for i in range(k)], "w", noise, "g" if effects else None, "c" if clustered else None, adj).orderBy("name").collect()
        assert [r.b for r in got] == pytest.approx(want_b) and [r.se for r in got] == pytest.approx(want_se) and all(r.ok and r.n == 60 for r in got)
    if k == 1:
        df = frame(spark, x, y, w, g, c).withColumn("noise", F.lit(float(sigma[0, 0])))
        one = R.eiv(df, ["spec"], "y", "x0", "w", "noise", "g" if effects else None, "c" if clustered else None, True).first()
        assert (one.b, one.se) == pytest.approx((want_b[0], want_se[0]))


def test_invalid_moments_give_no_figures(spark):
    x, y, w, g, c = simulated(2)
    got = R.eiv_many(frame(spark, x, y, w, g, c), ["spec"], "y", ["x0", "x1"], "w", {("x0", "x0"): 50.0}).collect()
    assert len(got) == 2 and not any(r.ok for r in got) and all(r.b is None and r.se is None for r in got)


def test_stacked_subgroups_are_the_matrix_form(spark):
    x, y, w, g, c = simulated(1, 40)
    rows = [("s", k, int(i), float(a), float(b + k * a), float(v), int(h), 0.04 if k else 0.02) for k in (0, 1) for i, (a, b, v, h) in enumerate(zip(x[:, 0], y, w, g))]
    df = spark.createDataFrame(rows, "spec string, k int, entity_id int, x double, y double, w double, g int, noise double")
    z = np.array([[r[3] * (r[1] == 1), r[3] * (r[1] == 0)] for r in rows])
    yy, ww, ee = (np.array([r[i] for r in rows]) for i in (4, 5, 2))
    for fe in (None, "g"):
        block = np.array([4 * r[1] + (r[6] if fe else 0) for r in rows])
        design = (block[:, None] == np.unique(block)).astype(float)
        b, se = matrix_form(z, yy, ww, design, np.diag([0.02, 0.01]), ee)
        got = R.interacted_eiv(df, "k", ["spec"], "y", "x", "w", "noise", "entity_id", fe).first()
        assert got.ok and (got.b1, got.b0, got.d) == pytest.approx((b[0], b[1], b[0] - b[1])) and (got.se1, got.se0) == pytest.approx(tuple(se))


def test_sums_of_coefficients(spark):
    x, y, w, g, c = simulated(2, 50)
    df = frame(spark, x, y, w, g, c).withColumn("one", F.lit(1.0))
    full = np.column_stack([np.ones(50), x])
    bread = np.linalg.inv(full.T @ (w[:, None] * full))
    b = bread @ full.T @ (w * y)
    e = y - full @ b
    v = bread @ (full.T @ (((w * e) ** 2)[:, None] * full)) @ bread * 50 / 47
    got = {r.name: r for r in R.weighted_least_squares(df, "y", ["one", "x0", "x1"], "w", {"sum": {"x0": 1.0, "x1": 1.0}}).collect()}
    assert got["x1"].b == pytest.approx(b[2]) and got["x1"].se == pytest.approx(np.sqrt(v[2, 2]))
    assert got["sum"].b == pytest.approx(b[1] + b[2]) and got["sum"].se == pytest.approx(np.sqrt(v[1, 1] + v[2, 2] + 2 * v[1, 2]))


def test_vector_fit_against_plain_inverses():
    rng = np.random.default_rng(3)
    for scale in (0.5, 1.0, 300.0):
        m1, m2 = (rng.normal(size=(8, 30)) for _ in range(2))
        v1, v2 = m1 @ m1.T / 300, m2 @ m2.T / 300 / scale**2
        y2 = rng.normal(size=8) / scale
        y1 = 0.3 + scale * y2 + rng.multivariate_normal(np.zeros(8), v1)
        wald, cmd, a, b = K.fit_vectors(y1, y2, v1, v2)
        d = y1 - y2
        assert wald == pytest.approx(d @ np.linalg.solve(v1 + v2, d))

        def loss(s):
            inverse = np.linalg.inv(v1 + s * s * v2)
            one, r = np.ones(8), y1 - s * y2
            e = r - (one @ inverse @ r) / (one @ inverse @ one)
            return e @ inverse @ e

        assert cmd == pytest.approx(loss(b)) and all(cmd <= loss(b * f) + 1e-9 for f in (0.5, 0.9, 0.99, 1.01, 1.1, 2))
    assert K.fit_vectors(np.ones(3), np.ones(3), np.ones((3, 3)), np.ones((3, 3))) is None


def test_bootstrap_tells_shifted_groups_apart(spark):
    rng = np.random.default_rng(5)
    scores = lambda low, lift: spark.createDataFrame([("a", low + r, e, float(rng.normal() + lift * e)) for r in range(60) for e in range(4)], "item string, resp_id long, entity_id long, score double")
    a, same, other = scores(0, 0.0).cache(), scores(100, 0.0).cache(), scores(200, 1.0).cache()
    far, near = (K.bootstrap_tests(a, b, 39).first() for b in (other, same))
    assert far.reps == near.reps == 39 and far.wald_p == pytest.approx(1 / 40) and near.wald_p > 1 / 40
    weights = K.bootstrap_weights(a.select("resp_id"), 5, 1).groupBy("rep").agg(F.sum("weight").alias("n")).collect()
    assert len(weights) == 5 and all(r.n == 60 for r in weights)
    p = K.calibration(a, 6).collect()
    assert len(p) == 6 and all(0 <= r.wald_p <= 1 for r in p)


def test_rows_are_numbered_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")).repartition(5)
    got = [(r.k, r.n) for r in numbered(df, ["k"], "n").orderBy("n").collect()]
    assert [n for _, n in got] == list(range(1000)) and [k for k, _ in got] == sorted(k for k, _ in got)


def test_observed_covariance_fills_to_the_full_one(spark):
    infl = spark.createDataFrame([("a", 1, 1, 0.5), ("a", 1, 2, -1.0), ("a", 2, 3, 2.0)], "item string, resp_id long, entity_id long, s double")
    seen = {(r.entity_i, r.entity_j): r.rcov for r in E.observed_covariance(infl).collect()}
    assert seen == {(1, 1): 0.25, (1, 2): -0.5, (2, 1): -0.5, (2, 2): 1.0, (3, 3): 4.0}
    full = {(r.entity_i, r.entity_j): r.rcov for r in E.robust_covariance(infl).collect()}
    assert full == {(i, j): seen.get((i, j), 0.0) for i in (1, 2, 3) for j in (1, 2, 3)}


def test_variances_of_a_centred_covariance_without_its_cells(spark):
    """From observed pairs alone: the same as with the full double-centred matrix, plain, weighted, and for groups."""
    rng = np.random.default_rng(5)
    n = 12
    s = rng.normal(size=(9, n)) * (rng.random((9, n)) < 0.3)
    s[0] += 0.1  # each entity has a diagonal
    v = s.T @ s
    v[np.abs(v) < 1e-12] = 0
    b, w, grp = rng.normal(size=n), rng.random(n) + 0.1, np.arange(n) % 3
    cov = spark.createDataFrame([("x", i, j, float(v[i, j])) for i in range(n) for j in range(n) if v[i, j]], "item string, entity_i long, entity_j long, rcov double")
    est = E.recentred_estimates(spark.createDataFrame([("x", i, float(b[i])) for i in range(n)], "item string, entity_id long, estimate double"))
    weights = spark.createDataFrame([(i, float(w[i])) for i in range(n)], "entity_id long, weight double")
    c = np.eye(n) - 1 / n
    m, bc = c @ v @ c, c @ b
    got = D.variance_parts(est, cov).first()
    assert np.allclose([got.variance, got.noise, got.v_hat], [bc @ bc / n, np.trace(m) / n, (4 * bc @ m @ bc - 2 * (m * m).sum()) / n**2])
    q = w / w.sum()
    bw = bc - q @ bc
    u = q * bw
    got = D.weighted_variance_parts(est, cov, weights).first()
    assert np.allclose([got.variance, got.noise, got.v_hat], [q @ bw**2, q @ np.diag(m), 4 * u @ m @ u - 2 * (np.outer(q, q) * m * m).sum()])
    groups = spark.createDataFrame([(i, int(grp[i])) for i in range(n)], "entity_id long, grp long")
    a = E.group_weights(groups)
    mean = np.array([(grp == g) / (grp == g).sum() for g in range(3)])
    found = {r.grp: r.v for r in E.recentred_group_variances(cov, a).collect()}
    assert np.allclose([found[g] for g in range(3)], np.diag(mean @ m @ mean.T))
    dev = np.eye(n) - mean[grp]
    found = {r.entity_id: r.v for r in E.deviation_variances(cov, a).collect()}
    assert np.allclose([found[i] for i in range(n)], np.diag(dev @ m @ dev.T))
    full = {(r.entity_i, r.entity_j): r.rcov for r in E.deviation_covariance(cov, a).collect()}
    assert np.allclose([[full[i, j] for j in range(n)] for i in range(n)], dev @ m @ dev.T)


def test_wage_gaps_are_those_of_the_dense_design(spark):
    """Against the whole design in numpy: interactions, a year, a quartic of age, an empty cell, nulls and rows without weight."""
    from rankloom.operators import wages

    rng = np.random.default_rng(8)
    rows = []
    for _ in range(400):
        ind, demo, year, age = rng.choice(["a", "b", "c", "d"]), int(rng.integers(2)), int(rng.integers(2000, 2003)), float(rng.integers(20, 60))
        if ind == "d":
            demo = 0  # an industry without the other group
        rows.append((float(rng.normal() + 0.3 * demo + age / 50), float(rng.uniform(0.5, 2)), demo, ind, year, age))
    odd = [(None, 1.0, 1, "a", 2000, 30.0), (9.0, 0.0, 1, "a", 2000, 30.0), (9.0, 1.0, None, "a", 2000, 30.0)]
    df = spark.createDataFrame(rows + odd, "y double, w double, demo int, ind string, year int, age double")
    got = {r.industry: r for r in wages.gaps_and_levels(df, "y", "w", "demo", "ind", "0", "1", ["year"], {"age": 4}).collect()}
    y, w = (np.array([r[i] for r in rows]) for i in (0, 1))
    names = ["a", "b", "c", "d"]
    cols = [np.ones(len(rows))] + [np.array([float(r[3] == x) for r in rows]) for x in names[1:]] + [np.array([float(r[2]) for r in rows])]
    cols += [np.array([float(r[2] and r[3] == x) for r in rows]) for x in names[1:3]] + [np.array([float(r[4] == t) for r in rows]) for t in (2001, 2002)]
    cols += [np.array([r[5] for r in rows]) ** p / 60.0**p for p in range(1, 5)]
    x = np.stack(cols, 1)
    bread = np.linalg.inv(x.T @ (w[:, None] * x))
    beta = bread @ x.T @ (w * y)
    e = y - x @ beta
    v = bread @ (x * ((w * e) ** 2)[:, None]).T @ x @ bread * len(y) / (len(y) - x.shape[1])
    for k, name in enumerate(names):
        level, gap = np.zeros(len(beta)), np.zeros(len(beta))
        level[0] = gap[4] = 1
        if k:
            level[k] = 1
        if k in (1, 2):
            gap[4 + k] = 1
        assert np.allclose([got[name].level, got[name].level_se], [level @ beta, np.sqrt(level @ v @ level)], rtol=1e-5)
        if name == "d":
            assert got[name].gap is None and got[name].gap_se is None
        else:
            assert np.allclose([got[name].gap, got[name].gap_se], [gap @ beta, np.sqrt(gap @ v @ gap)], rtol=1e-5)


def test_running_sums_and_frequencies(spark):
    from rankloom.operators.aggregates import frequency_table
    from rankloom.operators.tables import running_sum

    df = spark.range(500).select((F.col("id") * 7919 % 1009).alias("k"), (F.col("id") % 5).alias("v")).repartition(5)
    got = [(r.k, r.v, r.s) for r in running_sum(df, ["k"], "v", "s").orderBy("k").collect()]
    total = 0
    for _, v, s in got:
        total += v
        assert s == total
    table = frequency_table(spark.createDataFrame([(None,), (2,), (1,), (2,)], "x int"), "x").collect()
    assert {r.x: (r.n, r.percent, r.cumulative) for r in table} == {1: (1, 25.0, 25.0), 2: (2, 50.0, 75.0), None: (1, 25.0, 100.0)}
    assert frequency_table(spark.createDataFrame([], "x int"), "x").count() == 0


def test_uniformity_is_the_distance_of_sorted_values(spark):
    rng = np.random.default_rng(1)
    values = {"a": rng.random(50).round(1), "b": rng.random(7)}
    df = spark.createDataFrame([(k, float(p)) for k, v in values.items() for p in v], "g string, p double")
    for r in K.uniformity(df, ["g"], "p").collect():
        p = np.sort(values[r.g])
        n = len(p)
        assert r.ks == pytest.approx(max(np.max(np.arange(1, n + 1) / n - p), np.max(p - np.arange(n) / n)))
        assert (r.at_5, r.at_10) == pytest.approx((np.mean(p <= 0.05), np.mean(p <= 0.1)))
