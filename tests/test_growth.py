"""Queries that must not grow faster than their input, and the parts that keep them from it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import estimates as E
from rankloom.plans import registry

DATA = "/root/testdata/sf0.001"


def test_the_identity_is_checked_on_observed_pairs(spark, monkeypatch):
    def full(infl):
        raise AssertionError("a full matrix")

    monkeypatch.setattr(E, "robust_covariance", full)
    assert {(r.item, r.holds) for r in registry.queries()["qa_6_identity"](spark, DATA).collect()} == {("a", True), ("b", True)}


@pytest.fixture(scope="module")
def sparse(spark):
    """Influences of nine raters on twelve entities in three groups, with a rater who has an entity twice, and the dense matrix."""
    rng = np.random.default_rng(5)
    s = rng.normal(size=(9, 12)) * (rng.random((9, 12)) < 0.3)
    s[0] += 0.1
    rows = [("x", r, i, float(s[r, i])) for r in range(9) for i in range(12) if s[r, i]]
    rows = [("x", 0, 0, rows[0][3] - 0.5), ("x", 0, 0, 0.5), *rows[1:]]
    est = spark.createDataFrame([("x", i, float(b)) for i, b in enumerate(rng.normal(size=12))], "item string, entity_id long, estimate double")
    weights = spark.createDataFrame([(i, float(w)) for i, w in enumerate(rng.random(12) + 0.1)], "entity_id long, weight double")
    groups = spark.createDataFrame([(i, i % 3, float(w)) for i, w in enumerate(rng.random(12) + 0.1)], "entity_id long, grp long, weight double")
    return s.T @ s, spark.createDataFrame(rows, "item string, resp_id long, entity_id long, s double"), est, weights, E.group_weights(groups, "weight")


def test_variance_sheets_of_influences_are_those_of_their_covariance(sparse, spark):
    from rankloom.operators import denoise as D

    v, infl, est, weights, a = sparse
    cov = spark.createDataFrame([("x", i, j, float(v[i, j])) for i in range(12) for j in range(12) if v[i, j]], "item string, entity_i long, entity_j long, rcov double")
    assert E.squared_pairs(infl).first().vv == pytest.approx((v * v).sum())
    centred, dev = E.recentred_estimates(est), E.group_deviations(est, a)
    for new, old in (
        (D.variance_parts_of_influences(centred, infl), D.variance_parts(centred, cov)),
        (D.weighted_variance_parts_of_influences(centred, infl, weights), D.weighted_variance_parts(centred, cov, weights)),
        (D.deviation_variance_parts_of_influences(dev, infl, a), D.deviation_variance_parts(dev, cov, a)),
    ):
        assert new.columns == old.columns
        got, want = ([np.nan if x is None else x for x in df.drop("item").first()] for df in (new, old))
        assert np.allclose(got, want, equal_nan=True)


@pytest.mark.parametrize("name", ["st_17_variance_table", "st_21_variances", "st_24_measured_noise", "st_30_measured_suites", "st_40_cells", "ag_29_average_se", "qa_8_recomputed"])
def test_variance_sheets_keep_no_pairs(spark, monkeypatch, name):
    def pairs(infl):
        raise AssertionError("all observed pairs")

    monkeypatch.setattr(E, "observed_covariance", pairs)
    assert registry.queries()[name](spark, DATA).collect()


def test_both_items_are_found_in_one_pass(spark):
    from rankloom.sources import fixtures as X

    both = X.items(spark, DATA)
    assert both._jdf.queryExecution().optimizedPlan().toString().count("lineitem") <= 1
    for item in "ab":
        one = X.ratings(spark, DATA, item)
        assert both.where(F.col("item") == item).select(*one.columns).exceptAll(one).count() == 0 == one.exceptAll(both.where(F.col("item") == item).select(*one.columns)).count()


def test_full_matrices_are_written_in_blocks(sparse, spark, monkeypatch):
    v, infl, est, weights, a = sparse
    monkeypatch.setattr(E, "BLOCK_ENTITIES", 5)
    def dense(df):
        seen = {(r.entity_i, r.entity_j): r.rcov for r in df.collect()}
        return np.array([[seen[i, j] for j in range(12)] for i in range(12)])

    for df, want in ((E.robust_covariance(infl), v), (E.recentred_covariance(E.observed_covariance(infl)), (np.eye(12) - 1 / 12) @ v @ (np.eye(12) - 1 / 12))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("FlatMapGroupsInArrow") == 1 and plan.index("FlatMapGroupsInArrow") < plan.index("Join")
        assert df.count() == 144 and np.allclose(dense(df), want)
    share = {r.entity_id: (r.grp, r.a) for r in a.collect()}
    mean = np.array([[share[j][1] * (share[i][0] == share[j][0]) for j in range(12)] for i in range(12)])
    assert np.allclose(dense(E.deviation_covariance(E.observed_covariance(infl), a)), (np.eye(12) - mean) @ v @ (np.eye(12) - mean).T)


def test_percentiles_are_exact_and_held_by_no_task(spark):
    from rankloom.operators.aggregates import pair_correlations, percentiles

    rng = np.random.default_rng(3)
    values = {"a": rng.integers(0, 50, 300) / 4, "b": np.array([7.0]), "c": rng.random(101)}
    rows = [(k, float(v)) for k, x in values.items() for v in x] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    points = {"low": 0.0, "q1": 0.25, "p95": 0.95, "high": 1.0}
    got = {r.g: list(r)[1:] for r in percentiles(df, ["g"], "v", points).collect()}
    assert set(got) == set(values) and all(np.allclose(got[k], np.quantile(x, list(points.values()))) for k, x in values.items())
    pairs = pair_correlations(df.select("v", (F.col("v") * 2).alias("w")), [("v", "w")])
    assert "percentile(" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_tails_are_taken_once_for_equal_arguments(spark):
    df = registry.queries()["fn_9_tails"](spark, DATA)
    assert "Join" in df._jdf.queryExecution().optimizedPlan().toString() and df.count() == spark.read.parquet(f"{DATA}/lineitem.parquet").count()


def test_raters_are_not_joined_with_themselves(spark):
    from rankloom.operators import windows

    rows = spark.createDataFrame([("x", r, e, (r * e) % 5 + 1) for r in range(6) for e in range(r + 1)] + [("x", 5, 2, 4)], "item string, resp_id long, entity_id long, value int")
    ranked = windows.ranks_within(rows, ["item", "resp_id"], "value")
    found = E.both_scores(ranked)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in E.squared_pairs(E.influences(E.mean_scores(rows)))._jdf.queryExecution().optimizedPlan().toString()
    data = [r.asDict() for r in ranked.collect()]
    want = {}
    for x in data:
        want.setdefault(("OLS", x["resp_id"], x["entity_id"]), []).append(6.0 - x["value"])
        for y in data:
            if y["resp_id"] == x["resp_id"] and y["entity_id"] != x["entity_id"]:
                want.setdefault(("Borda", x["resp_id"], x["entity_id"]), []).append(1.0 if x["rank"] < y["rank"] else 0.5 if x["rank"] == y["rank"] else 0.0)
    got = {}
    for r in found.collect():
        got.setdefault((r.method, r.resp_id, r.entity_id), []).append(r.score)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) if k[0] == "OLS" else [pytest.approx(sum(v) / len(v))] for k, v in want.items()}
