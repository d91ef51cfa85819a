"""Identities and hand-computed cases of the core operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions import columns as C
from rankloom.functions.tails import beta_share, gamma_tail
from rankloom.operators import estimates as E
from rankloom.operators import graph as G
from rankloom.operators import quality as Q
from rankloom.operators import regress as R

RATINGS = [(1, 1, 1), (1, 2, 3), (1, 3, 5), (2, 1, 2), (2, 2, 2), (2, 3, 4), (3, 2, 1), (3, 3, 2), (3, 4, 3), (4, 1, 5), (4, 3, 1), (4, 4, 4)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([("a", *r) for r in RATINGS], "item string, resp_id long, entity_id long, value int")


def test_robust_covariance_is_the_cross_product_of_influences(rows):
    infl = E.influences(E.mean_scores(rows))
    s = np.zeros((5, 5))
    for r in infl.collect():
        s[r.resp_id, r.entity_id] = r.s
    cov = {(r.entity_i, r.entity_j): r.rcov for r in E.robust_covariance(infl).collect()}
    assert len(cov) == 16
    for (i, j), v in cov.items():
        assert v == pytest.approx((s.T @ s)[i, j], abs=1e-12)


def test_recentring_is_double_centring(rows):
    cov = E.robust_covariance(E.influences(E.mean_scores(rows)))
    dense = np.zeros((4, 4))
    for r in cov.collect():
        dense[r.entity_i - 1, r.entity_j - 1] = r.rcov
    c = np.eye(4) - 1 / 4
    for r in E.recentred_covariance(cov).collect():
        assert r.rcov == pytest.approx((c @ dense @ c)[r.entity_i - 1, r.entity_j - 1], abs=1e-12)


def test_borda_without_reference_averages_one_half(rows):
    ranked = E.ranks_within(rows, ["item", "resp_id"], "value")
    means = E.borda_scores(ranked).groupBy("resp_id").agg(F.avg("score").alias("m")).collect()
    assert all(r.m == pytest.approx(0.5) for r in means)


def test_largest_set_prefers_more_entities_then_the_smaller_id(spark):
    edges = spark.createDataFrame([("a", 5, 6), ("a", 1, 2), ("a", 7, 8), ("a", 8, 9), ("b", 3, 4), ("b", 1, 2)], "item string, i long, j long")
    found = {(r.item, r.entity_id) for r in G.largest_set(edges).collect()}
    assert found == {("a", 7), ("a", 8), ("a", 9), ("b", 1), ("b", 2)}


def test_eiv_without_error_is_weighted_least_squares(spark):
    rng = np.random.default_rng(0)
    x, w = rng.normal(size=40), rng.uniform(1, 2, 40)
    y = 2 * x + rng.normal(size=40)
    df = spark.createDataFrame([("s", float(a), float(b), float(c), 0.0) for a, b, c in zip(y, x, w)], "spec string, y double, x double, w double, noise double")
    got = R.eiv(df, ["spec"], "y", "x", "w", "noise").first()
    xc, yc = x - np.average(x, weights=w), y - np.average(y, weights=w)
    assert got.ok and got.b == pytest.approx((w * xc * yc).sum() / (w * xc * xc).sum())


def test_tails_at_known_points():
    assert gamma_tail(0.5, 3.841459 / 2) == pytest.approx(0.05, abs=1e-6)
    assert beta_share(5.0, 0.5, 10 / (10 + 2.228139**2)) == pytest.approx(0.05, abs=1e-6)


def test_recodes_keep_three_states(spark):
    df = spark.createDataFrame([(1,), (5,), (-1,), (None,)], "v int")
    assert [r[0] for r in df.select(C.reverse_code(F.col("v"))).collect()] == [5, 1, -1, None]


def test_checks_raise(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(Q.ContractError):
        Q.require_empty(Q.repeated_keys(df, ["k"]), "keys repeat")


def test_vector_tests_take_all_common_entities(spark):
    from rankloom.plans import pairs_compare, registry

    d = "/root/testdata/sf0.001"
    (_, a, _), (_, b, _) = pairs_compare.halves(spark, d)
    common = a.select("entity_id").intersect(b.select("entity_id")).count()
    assert common > 8 and [r.J for r in registry.queries()["st_38_39_vector_tests"](spark, d).collect()] == [common]


def test_identity_looks_at_every_cell(rows):
    from rankloom.plans.checks import cross_product_holds

    infl = E.influences(E.mean_scores(rows))
    cov = E.robust_covariance(infl)
    wrong = cov.withColumn("rcov", F.when((F.col("entity_i") == 3) & (F.col("entity_j") == 4), 9.0).otherwise(F.col("rcov")))
    assert [r.holds for r in cross_product_holds(infl, cov).collect()] == [True]
    assert [r.holds for r in cross_product_holds(infl, wrong).collect()] == [False]


def test_replicates_and_draws_are_those_of_the_reference(spark):
    from rankloom.operators import positivity
    from rankloom.plans import registry

    assert [r.reps for r in registry.queries()["st_41_bootstrap"](spark, "/root/testdata/sf0.001").collect()] == [499]
    assert (positivity.BATCH, positivity.QUOTA, positivity.DRAWS) == (10_000, 5_000, 50_000)


def test_permuted_ids_are_a_permutation(spark):
    from rankloom.operators.windows import permuted_ids

    df = spark.range(200).select((F.col("id") * 3).alias("k"), F.lit("x").alias("v")).unionByName(spark.range(5).select((F.col("id") * 3).alias("k"), F.lit("y").alias("v")))
    first, again, other = ({r.k: r.p for r in permuted_ids(x, "k", seed, "p").collect()} for x, seed in ((df, 1), (df.repartition(7), 1), (df, 2)))
    assert set(first) == set(first.values()) == {3 * k for k in range(200)}
    assert first == again != other and sum(k == p for k, p in first.items()) < 20


def test_groups_without_a_common_rater_have_covariance_zero(spark):
    cov = spark.createDataFrame([("a", 1, 1, 0.5), ("a", 2, 2, 0.25), ("a", 1, 3, 0.1), ("a", 3, 1, 0.1), ("a", 3, 3, 0.2), ("b", 1, 1, 1.0)], "item string, entity_i long, entity_j long, rcov double")
    weights = spark.createDataFrame([(1, 7, 1.0), (2, 8, 1.0), (3, None, 1.0), (4, 9, 1.0)], "entity_id long, grp int, a double")
    got = {(r.item, r.grp_i, r.grp_j): r.rcov for r in E.full_group_covariance(cov, weights).collect()}
    assert got == {("a", 7, 7): 0.5, ("a", 7, 8): 0.0, ("a", 8, 7): 0.0, ("a", 8, 8): 0.25, ("a", 7, None): 0.1, ("a", None, 7): 0.1, ("a", None, None): 0.2, ("a", 8, None): 0.0, ("a", None, 8): 0.0, ("b", 7, 7): 1.0}
