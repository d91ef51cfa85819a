"""Queries of estimates, covariance and denoising (ST-1 to ST-23), and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions import columns as C
from rankloom.operators import denoise as D
from rankloom.operators import estimates as E
from rankloom.operators import graph as G
from rankloom.operators.aggregates import raters_with_more
from rankloom.operators.joins import rater_pairs
from rankloom.operators.tables import checkpointed
from rankloom.operators.windows import top_and_bottom
from rankloom.sources import fixtures as X
from rankloom.sources.fixtures import with_

from .registry import query

# Shared definitions of the oracle. p: answers of raters with more than two; at these sizes all entities are connected,
# which st_1 checks by itself.
P = "p AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY item, resp_id) AS k FROM vi) WHERE k > 2)"
SC = f"{P}, sc AS (SELECT item, resp_id, entity_id, 6.0 - value AS score FROM p)"
EST = f"{SC}, est AS (SELECT item, entity_id, count(*) AS n, avg(score) AS estimate, sqrt(var_samp(score) / count(*)) AS se FROM sc GROUP BY 1, 2)"
INF = f"{EST}, inf AS (SELECT sc.item, sc.resp_id, sc.entity_id, (sc.score - est.estimate) / est.n AS s FROM sc JOIN est USING (item, entity_id))"
COV = f"{INF}, half AS (SELECT a.item, a.entity_id AS entity_i, b.entity_id AS entity_j, sum(a.s * b.s) AS v FROM inf a JOIN inf b ON a.item = b.item AND a.resp_id = b.resp_id GROUP BY 1, 2, 3), cov AS (SELECT a.item, a.entity_id AS entity_i, b.entity_id AS entity_j, coalesce(h.v, 0) AS rcov FROM est a JOIN est b ON a.item = b.item LEFT JOIN half h ON h.item = a.item AND h.entity_i = a.entity_id AND h.entity_j = b.entity_id)"
REC = f"{COV}, est_c AS (SELECT item, entity_id, n, estimate - avg(estimate) OVER (PARTITION BY item) AS estimate FROM est), cov_c AS (SELECT item, entity_i, entity_j, rcov - avg(rcov) OVER (PARTITION BY item, entity_i) - avg(rcov) OVER (PARTITION BY item, entity_j) + avg(rcov) OVER (PARTITION BY item) AS rcov FROM cov)"


def prep(s, d):
    return raters_with_more(X.valid(X.items(s, d)), ["item", "resp_id"])


def scores(s, d):
    return E.mean_scores(prep(s, d))


def fitted(s, d):
    """Estimates, and the observed pairs of their covariance."""
    sc = checkpointed(scores(s, d))
    return E.estimates(sc), checkpointed(E.observed_covariance(E.influences(sc)))


def estimated(s, d):
    """Estimates alone."""
    return E.estimates(scores(s, d))


def with_influences(s, d):
    """Estimates, and the influences that their covariance is made of."""
    sc = checkpointed(scores(s, d))
    return checkpointed(E.estimates(sc)), checkpointed(E.influences(sc))


def recentred(s, d):
    """Recentred estimates, with the observed pairs that ``centring`` recentres."""
    est, cov = fitted(s, d)
    return E.recentred_estimates(est), cov


@query("entry_worst_rated", with_("vr entities", f"""
, p AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY resp_id) AS k FROM vr) WHERE k > 2),
m AS (SELECT entity_id, count(*) AS n, avg(6.0 - value) AS est, sum(power((6.0 - value) - mu, 2)) / power(count(*), 2) AS v FROM (SELECT *, avg(6.0 - value) OVER (PARTITION BY entity_id) AS mu FROM p) GROUP BY 1),
c AS (SELECT grp, entity_id, name, n, round(est - avg(est) OVER (), 9) AS estimate, sqrt(v) AS rse FROM m JOIN entities USING (entity_id))
SELECT grp, entity_id, name, n, estimate, rse, place FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY estimate, entity_id) AS place FROM c) WHERE place <= 3"""), d="estimate rse", i="n place grp")
def _(s, d):
    """Worst-rated entities within each group: prepare, score, estimate, robust standard error, recentre, rank."""
    rows = raters_with_more(X.valid(X.ratings(s, d)).withColumn("item", F.lit("a")), ["item", "resp_id"])
    sc = E.mean_scores(rows)
    se = E.influences(sc).groupBy("item", "entity_id").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("rse"))
    est = E.recentred_estimates(E.estimates(sc).drop("se")).join(se, ["item", "entity_id"]).join(F.broadcast(X.entities(s, d)), "entity_id")
    worst = top_and_bottom(est.withColumn("estimate", F.round("estimate", 9)).select("grp", "entity_id", "name", "n", "estimate", "rse"), ["grp"], "estimate", "entity_id", 3)
    return worst.where(F.col("end") == "bottom").drop("end")


@query("st_1_largest_set", with_("vi", f", {P}, e AS (SELECT DISTINCT a.item, a.entity_id AS i, b.entity_id AS j FROM p a JOIN p b ON a.item = b.item AND a.resp_id = b.resp_id AND a.entity_id <> b.entity_id), l0 AS (SELECT item, i AS node, least(i, min(j)) AS label FROM e GROUP BY 1, 2), l1 AS (SELECT e.item, e.i AS node, least(min(l.label), min(m.label)) AS label FROM e JOIN l0 l ON l.item = e.item AND l.node = e.j JOIN l0 m ON m.item = e.item AND m.node = e.i GROUP BY 1, 2), l2 AS (SELECT e.item, e.i AS node, least(min(l.label), min(m.label)) AS label FROM e JOIN l1 l ON l.item = e.item AND l.node = e.j JOIN l1 m ON m.item = e.item AND m.node = e.i GROUP BY 1, 2), l3 AS (SELECT e.item, e.i AS node, least(min(l.label), min(m.label)) AS label FROM e JOIN l2 l ON l.item = e.item AND l.node = e.j JOIN l2 m ON m.item = e.item AND m.node = e.i GROUP BY 1, 2), z AS (SELECT item, label, row_number() OVER (PARTITION BY item ORDER BY count(*) DESC, label) AS r FROM l3 GROUP BY 1, 2) SELECT item, node AS entity_id FROM l3 JOIN z USING (item, label) WHERE r = 1"))
def _(s, d):
    edges = rater_pairs(prep(s, d), ["item", "resp_id"], "entity_id").select("item", "i", "j").distinct()
    return G.largest_set(edges)


@query("st_2_prepared", with_("vi", f", {P} SELECT item, resp_id, entity_id, dense_rank() OVER (PARTITION BY item, resp_id ORDER BY value) AS rank FROM p"), i="rank")
def _(s, d):
    return E.prepared(X.items(s, d)).select("item", "resp_id", "entity_id", "rank")


def _borda_sql(ref: str) -> str:
    return with_("vi", f""", {P}, w AS (SELECT a.item, a.resp_id, a.entity_id, avg(CASE WHEN a.value < b.value THEN 1.0 WHEN a.value = b.value THEN 0.5 ELSE 0.0 END) AS f,
  sum(CASE WHEN b.entity_id IN ({ref}) THEN NULL WHEN a.value < b.value THEN 1.0 WHEN a.value = b.value THEN 0.5 ELSE 0.0 END) AS b, count(*) FILTER (WHERE b.entity_id NOT IN ({ref})) AS o
  FROM p a JOIN p b ON a.item = b.item AND a.resp_id = b.resp_id AND a.entity_id <> b.entity_id GROUP BY 1, 2, 3), n AS (SELECT item, CAST(count(DISTINCT entity_id) AS DOUBLE) AS n FROM p WHERE entity_id NOT IN ({ref}) GROUP BY 1)
SELECT item, resp_id, entity_id, CASE WHEN entity_id IN ({ref}) OR o < 1 THEN f ELSE 1 / (2 * n) + (n - 1) / n * b / o END AS score FROM w JOIN n USING (item)""")


@query("st_3_borda", _borda_sql("1, 2, 3"), d="score")
def _(s, d):
    return E.borda_scores(E.ranks_within(prep(s, d), ["item", "resp_id"], "value"), (1, 2, 3))


@query("st_4_mean_score", with_("vi", f", {SC} SELECT * FROM sc"), d="score")
def _(s, d):
    return scores(s, d)


@query("st_5_influence", with_("vi", f", {INF} SELECT * FROM inf"), d="s")
def _(s, d):
    return E.influences(scores(s, d))


@query("st_6_robust_covariance", with_("vi", f", {COV} SELECT * FROM cov"), d="rcov")
def _(s, d):
    return E.robust_covariance(E.influences(scores(s, d)))


@query("st_7_naive_covariance", with_("vi", f", {EST} SELECT item, entity_id AS entity_i, entity_id AS entity_j, se * se AS cov FROM est"), d="cov")
def _(s, d):
    return E.naive_covariance(estimated(s, d))


@query("st_8_recentred", with_("vi", f", {REC} SELECT * FROM cov_c"), d="rcov")
def _(s, d):
    return E.recentred_covariance(fitted(s, d)[1])


@query("st_8_naive_se", with_("vi", f", {EST}, j AS (SELECT item, count(*) AS j, CASE WHEN count(se) = count(*) THEN sum(se * se) END AS t FROM est GROUP BY 1) SELECT item, entity_id, sqrt(se * se * (1 - 2.0 / j) + t / (j * j)) AS se FROM est JOIN j USING (item)"), d="se")
def _(s, d):
    return E.recentred_naive_se(estimated(s, d)).select("item", "entity_id", "se")


@query("st_9_both_versions", with_("vi", f", {EST} SELECT 'OLS' AS method, item, entity_id, estimate - avg(estimate) OVER (PARTITION BY item) AS estimate FROM est UNION ALL SELECT 'OLS_not_recentered', item, entity_id, estimate FROM est"), d="estimate")
def _(s, d):
    return E.with_uncentred(estimated(s, d).withColumn("method", F.lit("OLS"))).select("method", "item", "entity_id", "estimate")


@query("st_10_within_set", with_("vi external", f", {COV}, k AS (SELECT entity_id FROM external WHERE disc IS NOT NULL), c AS (SELECT * FROM cov WHERE entity_i IN (SELECT * FROM k) AND entity_j IN (SELECT * FROM k)) SELECT item, entity_i, entity_j, rcov - avg(rcov) OVER (PARTITION BY item, entity_i) - avg(rcov) OVER (PARTITION BY item, entity_j) + avg(rcov) OVER (PARTITION BY item) AS rcov FROM c"), d="rcov")
def _(s, d):
    est, cov = fitted(s, d)
    return E.recentred_covariance(E.within_set(est, cov, X.external(s, d).where("disc is not null").select("entity_id"))[1])


@query("st_11_combined", with_("vi", f", {INF}, st AS (SELECT resp_id, item, entity_id, s / 2 AS s FROM inf WHERE entity_id IN (SELECT entity_id FROM inf WHERE item = 'a') AND entity_id IN (SELECT entity_id FROM inf WHERE item = 'b')) SELECT x.entity_id AS entity_i, y.entity_id AS entity_j, sum(x.s * y.s) AS rcov FROM st x JOIN st y ON x.resp_id = y.resp_id AND x.item = y.item GROUP BY 1, 2"), d="rcov")
def _(s, d):
    infl = E.influences(scores(s, d))
    both = E.combined_influences(infl.where("item = 'a'"), infl.where("item = 'b'"), "ab")
    stacked = both.withColumn("resp_id", F.struct("resp_id", "stack"))
    a = stacked.select("resp_id", F.col("entity_id").alias("entity_i"), F.col("s").alias("x"))
    b = stacked.select("resp_id", F.col("entity_id").alias("entity_j"), F.col("s").alias("y"))
    return a.join(b, "resp_id").groupBy("entity_i", "entity_j").agg(F.sum(F.col("x") * F.col("y")).alias("rcov"))


@query("st_11_combined_estimates", with_("vi", f", {EST} SELECT 'ab' AS item, entity_id, a.n + b.n AS n, (a.estimate + b.estimate) / 2 AS estimate FROM (SELECT * FROM est WHERE item = 'a') a JOIN (SELECT * FROM est WHERE item = 'b') b USING (entity_id)"), d="estimate", i="n")
def _(s, d):
    est = estimated(s, d)
    return E.combined(est.where("item = 'a'"), est.where("item = 'b'"), "ab")


WT = "g AS (SELECT entity_id, grp, 1.0 / count(*) OVER (PARTITION BY grp) AS a FROM entities)"


@query("st_12_group_means", with_("vi entities", f", {EST}, {WT} SELECT item, grp, sum(a * estimate) AS estimate, count(*) AS members FROM est JOIN g USING (entity_id) GROUP BY 1, 2"), d="estimate", i="members")
def _(s, d):
    return E.group_means(estimated(s, d), E.group_weights(X.entities(s, d)))


@query("st_12_group_deviations", with_("vi entities", f", {EST}, {WT} SELECT item, entity_id, estimate - sum(a * estimate) OVER (PARTITION BY item, grp) AS estimate FROM est JOIN g USING (entity_id)"), d="estimate")
def _(s, d):
    return E.group_deviations(estimated(s, d), E.group_weights(X.entities(s, d))).select("item", "entity_id", "estimate")


@query("st_12_group_covariance", with_("vi entities", f", {COV}, {WT} SELECT item, x.grp AS grp_i, y.grp AS grp_j, sum(x.a * y.a * rcov) AS rcov FROM cov JOIN g x ON x.entity_id = entity_i JOIN g y ON y.entity_id = entity_j GROUP BY 1, 2, 3"), d="rcov")
def _(s, d):
    return E.full_group_covariance(fitted(s, d)[1], E.group_weights(X.entities(s, d)))


@query("st_12_deviation_covariance", with_("vi entities", f", {COV}, {WT}, c AS (SELECT cov.*, x.grp AS gi, y.grp AS gj, x.a AS ai, y.a AS aj FROM cov JOIN g x ON x.entity_id = entity_i JOIN g y ON y.entity_id = entity_j) SELECT item, entity_i, entity_j, rcov - sum(ai * rcov) OVER (PARTITION BY item, entity_j, gi) - sum(aj * rcov) OVER (PARTITION BY item, entity_i, gj) + sum(ai * aj * rcov) OVER (PARTITION BY item, gi, gj) AS rcov FROM c"), d="rcov")
def _(s, d):
    return E.deviation_covariance(fitted(s, d)[1], E.group_weights(X.entities(s, d)))


GRID = [g / 20 for g in range(-20, 41)]


def shrunken_sql(src: str, tag: str) -> str:
    """``eb_<tag>``: item, entity_id, eb of a relation with item, entity_id, estimate, se; psi from two passes over grids."""
    t = [f"{tag}{i}" for i in range(1, 8)]
    line = "CASE WHEN ll - n * mx * mx > 1e-12 THEN (le - n * mx * my) / (ll - n * mx * mx) ELSE 0 END"
    sums = "sum(y * exp(2 * psi * ls)) AS yz, sum(exp(4 * psi * ls)) AS zz, sum(y * y) AS yy"
    best = "row_number() OVER (PARTITION BY item ORDER BY round(yy - 2 * v * yz + v * v * zz, {d}), psi, v) AS k"
    return f"""{t[0]} AS (SELECT *, ln(greatest(se, 1e-8)) AS ls FROM {src} WHERE NOT isnan(estimate) AND se > 0),
{t[1]} AS (SELECT *, count(*) OVER w AS n, avg(ls) OVER w AS mx, avg(estimate) OVER w AS my, sum(ls * ls) OVER w AS ll, sum(ls * estimate) OVER w AS le FROM {t[0]} WINDOW w AS (PARTITION BY item)),
{t[2]} AS (SELECT *, estimate - fit AS r, power(estimate - fit, 2) - se * se AS y FROM (SELECT *, my + {line} * (ls - mx) AS fit FROM {t[1]} WHERE n >= 2)),
{t[3]} AS (SELECT *, greatest(yz / zz, 0) AS v FROM (SELECT item, psi, {sums} FROM {t[2]}, (SELECT unnest(range(-20, 41)) / 20.0::DOUBLE AS psi) GROUP BY 1, 2)),
{t[4]} AS (SELECT item, psi AS psi0, {best.format(d=9)} FROM {t[3]}),
{t[5]} AS (SELECT *, greatest(yz / zz, 0) AS v FROM (SELECT item, psi, {sums} FROM {t[2]} JOIN (SELECT item, psi0 + unnest(range(-20, 21)) * 0.0025::DOUBLE AS psi FROM {t[4]} WHERE k = 1) USING (item) GROUP BY 1, 2)),
{t[6]} AS (SELECT item, psi, v, {best.format(d=13)} FROM {t[5]}),
eb_{tag} AS (SELECT item, entity_id, fit + CASE WHEN v > 0 THEN v / (v + exp(2 * (1 - psi) * ls)) ELSE 0 END * r AS eb FROM {t[2]} JOIN {t[6]} USING (item) WHERE k = 1)"""


@query("st_13_shrunken", with_("vi", f", {REC}, ez AS (SELECT item, entity_id, est_c.estimate, est.se FROM est_c JOIN est USING (item, entity_id)), {shrunken_sql('ez', 'e')} SELECT item, entity_id, round(eb, 4) AS eb FROM eb_e"))
def _(s, d):
    est = E.recentred_estimates(estimated(s, d))
    return E.shrunken(est, GRID).select("item", "entity_id", F.round("eb", 4).alias("eb"))


VP = "vp AS (SELECT item, sum(CAST(entity_i = entity_j AS INTEGER)) AS J, sum(CASE WHEN entity_i = entity_j THEN a.estimate * a.estimate END) AS bb, sum(CASE WHEN entity_i = entity_j THEN rcov END) AS tr, sum(a.estimate * b.estimate * rcov) AS bcb, sum(rcov * rcov) AS cc FROM cov_c JOIN est_c a USING (item) JOIN est_c b USING (item) WHERE a.entity_id = entity_i AND b.entity_id = entity_j GROUP BY item), vr2 AS (SELECT item, J, bb / J AS variance, tr / J AS noise, (bb - tr) / J AS signal_raw, (4 * bcb - 2 * cc) / (J * J) AS v_hat FROM vp)"


@query("st_14_variance", with_("vi", f", {REC}, {VP} SELECT *, {C.positive_part_sql('signal_raw', 'sqrt(greatest(v_hat, 0))')} AS signal FROM vr2"), d="variance noise signal_raw v_hat signal", i="J")
def _(s, d):
    est, infl = with_influences(s, d)
    return D.variance_parts_of_influences(E.recentred_estimates(est), infl)


@query("st_15_positive_part", f"SELECT p_partkey, {C.positive_part_sql('x', 'e')} AS signal FROM (SELECT p_partkey, p_size / 10.0 - 2 AS x, (p_partkey % 4) / 2.0 AS e FROM part)", d="signal")
def _(s, d):
    p = X.table(s, d, "part").select("p_partkey", (F.col("p_size") / 10.0 - 2).alias("x"), ((F.col("p_partkey") % 4) / 2.0).alias("e"))
    return p.select("p_partkey", C.positive_part(F.col("x"), F.col("e")).alias("signal"))


def _positive(s, d):
    """Entities with a positive weight, and estimates and influences inside them."""
    w = X.entities(s, d).where("weight is not null").select("entity_id", "weight")
    est, infl = with_influences(s, d)
    return (*E.inside(est, infl, w.select("entity_id")), w)


WV = f"{COV}, ww AS (SELECT entity_id, weight FROM entities WHERE weight IS NOT NULL), e2 AS (SELECT item, entity_id, estimate, weight / sum(weight) OVER (PARTITION BY item) AS w FROM est JOIN ww USING (entity_id)), e3 AS (SELECT *, estimate - sum(w * estimate) OVER (PARTITION BY item) AS b FROM e2), c2 AS (SELECT item, entity_i, entity_j, rcov - avg(rcov) OVER (PARTITION BY item, entity_i) - avg(rcov) OVER (PARTITION BY item, entity_j) + avg(rcov) OVER (PARTITION BY item) AS rcov FROM cov WHERE entity_i IN (SELECT entity_id FROM ww) AND entity_j IN (SELECT entity_id FROM ww)), m2 AS (SELECT item, sum(CASE WHEN entity_i = entity_j THEN x.w * x.b * x.b END) AS variance, sum(CASE WHEN entity_i = entity_j THEN x.w * rcov END) AS noise, 4 * sum(x.w * x.b * rcov * y.w * y.b) - 2 * sum(x.w * y.w * rcov * rcov) AS v_hat FROM c2 JOIN e3 x USING (item) JOIN e3 y USING (item) WHERE x.entity_id = entity_i AND y.entity_id = entity_j GROUP BY item), m3 AS (SELECT *, {C.positive_part_sql('(variance - noise)', 'sqrt(greatest(v_hat, 0))')} AS signal FROM m2)"


@query("st_16_weighted_variance", with_("vi entities", f", {WV} SELECT *, CASE WHEN variance - signal > 0 THEN variance - signal END AS katz_noise FROM m3"), d="variance noise v_hat signal katz_noise")
def _(s, d):
    est, infl, w = _positive(s, d)
    return D.weighted_variance_parts_of_influences(est, infl, w)


@query("st_17_variance_table", with_("vi entities", f", {WV} SELECT item, sqrt(variance) AS sd, sqrt(greatest(signal, 0)) AS signal_sd, signal / nullif(variance, 0) AS reliability, CASE WHEN v_hat > 0 THEN (variance - noise) / sqrt(v_hat) END AS t FROM m3"), d="sd signal_sd reliability t")
def _(s, d):
    est, infl, w = _positive(s, d)
    return D.variance_table(D.weighted_variance_parts_of_influences(est, infl, w)).select("item", "sd", "signal_sd", "reliability", "t")


IC = "ic AS (SELECT 'a' AS lhs, 'b' AS rhs, count(*) AS J, avg(x.b * y.b) AS covariance FROM (SELECT entity_id, estimate - avg(estimate) OVER () AS b FROM est WHERE item = 'a') x JOIN (SELECT entity_id, estimate - avg(estimate) OVER () AS b FROM est WHERE item = 'b') y USING (entity_id)), nz AS (SELECT sum(x.s * y.s) AS noise FROM inf x JOIN inf y ON x.item = 'a' AND y.item = 'b' AND x.resp_id = y.resp_id AND x.entity_id = y.entity_id), nn AS (SELECT count(DISTINCT CASE WHEN item = 'a' THEN resp_id END) AS N1, count(DISTINCT CASE WHEN item = 'b' THEN resp_id END) AS N2, (SELECT count(*) FROM (SELECT resp_id FROM inf WHERE item = 'a' INTERSECT SELECT resp_id FROM inf WHERE item = 'b')) AS Ncommon FROM inf)"


def pair_rows(s):
    return s.range(1).select(F.lit("a").alias("lhs"), F.lit("b").alias("rhs"))


@query("st_18_item_covariance", with_("vi", f", {INF}, {IC} SELECT lhs, rhs, J, N1, N2, Ncommon, covariance, noise / J AS noise FROM ic, nz, nn"), d="covariance noise", i="J N1 N2 Ncommon")
def _(s, d):
    sc = checkpointed(scores(s, d))
    return D.item_covariances(checkpointed(E.estimates(sc)), checkpointed(E.influences(sc)), pair_rows(s))


BORDA = "bo AS (SELECT a.item, a.resp_id, a.entity_id, avg(CASE WHEN a.value < b.value THEN 1.0 WHEN a.value = b.value THEN 0.5 ELSE 0.0 END) AS score FROM p a JOIN p b ON a.item = b.item AND a.resp_id = b.resp_id AND a.entity_id <> b.entity_id GROUP BY 1, 2, 3), be AS (SELECT item, entity_id, count(*) AS n, avg(score) AS estimate FROM bo GROUP BY 1, 2)"


def both_methods(s, d):
    """Scores of item a by both methods, the method in ``item``."""
    rows = prep(s, d).where("item = 'a'")
    return E.both_scores(E.ranks_within(rows, ["item", "resp_id"], "value")).select(F.col("method").alias("item"), "resp_id", "entity_id", "score")


@query("st_19_cross_method", with_("vi", f", {EST}, {BORDA}, x AS (SELECT entity_id, estimate - avg(estimate) OVER () AS b FROM est WHERE item = 'a'), y AS (SELECT entity_id, estimate - avg(estimate) OVER () AS b FROM be WHERE item = 'a') SELECT 'OLS' AS lhs, 'Borda' AS rhs, count(*) AS J, avg(x.b * y.b) AS covariance FROM x JOIN y USING (entity_id)"), d="covariance", i="J")
def _(s, d):
    sc = checkpointed(both_methods(s, d))
    pairs = s.range(1).select(F.lit("OLS").alias("lhs"), F.lit("Borda").alias("rhs"))
    return D.item_covariances(checkpointed(E.estimates(sc)), checkpointed(E.influences(sc)), pairs).select("lhs", "rhs", "J", "covariance")


CORR = f"{REC}, {VP}, {IC}, sv AS (SELECT *, {C.positive_part_sql('signal_raw', 'sqrt(greatest(v_hat, 0))')} AS signal FROM vr2)"


def _correlated(s, d):
    from rankloom.operators.joins import with_both_variances

    sc = checkpointed(scores(s, d))
    est, infl = checkpointed(E.estimates(sc)), checkpointed(E.influences(sc))
    var = D.variance_parts_of_influences(E.recentred_estimates(est), infl)
    cov = D.item_covariances(est, infl, pair_rows(s)).withColumn("one", F.lit(1))
    return D.correlations(with_both_variances(cov, var.withColumn("one", F.lit(1)), ["one"], ["variance", "signal"]))


@query("st_20_correlations", with_("vi", f", {CORR} SELECT lhs, rhs, covariance / sqrt(x.variance * y.variance) AS corr, CASE WHEN x.signal > 0 AND y.signal > 0 THEN covariance / sqrt(x.signal * y.signal) END AS corr_den, CASE WHEN x.signal > 0 AND y.signal > 0 THEN (covariance - nz.noise / ic.J) / sqrt(x.signal * y.signal) END AS corr_c FROM ic, nz, sv x, sv y WHERE x.item = 'a' AND y.item = 'b'"), d="corr corr_den corr_c")
def _(s, d):
    return _correlated(s, d).select("lhs", "rhs", "corr", "corr_den", "corr_c")


@query("st_21_within_between", with_("vi entities", f", {EST}, {WT}, m AS (SELECT item, grp, sum(a * estimate) AS e FROM est JOIN g USING (entity_id) GROUP BY 1, 2), dv AS (SELECT item, entity_id, estimate - sum(a * estimate) OVER (PARTITION BY item, grp) AS e FROM est JOIN g USING (entity_id)) SELECT 'between' AS part, avg(x.e * y.e) - avg(x.e) * avg(y.e) AS covariance FROM m x JOIN m y ON x.item = 'a' AND y.item = 'b' AND x.grp = y.grp UNION ALL SELECT 'within', avg(x.e * y.e) - avg(x.e) * avg(y.e) FROM dv x JOIN dv y ON x.item = 'a' AND y.item = 'b' AND x.entity_id = y.entity_id"), d="covariance")
def _(s, d):
    est, w = estimated(s, d), E.group_weights(X.entities(s, d))

    def cov(df, key, name):
        x, y = (df.where(F.col("item") == i).select(key, F.col("estimate").alias(i)) for i in "ab")
        return x.join(y, key).agg((F.avg(F.col("a") * F.col("b")) - F.avg("a") * F.avg("b")).alias("covariance")).select(F.lit(name).alias("part"), "covariance")

    return cov(E.group_means(est, w), "grp", "between").unionByName(cov(E.group_deviations(est, w), "entity_id", "within"))


# Both parts with entity weights: the dense influences and covariances of group means (im) and of deviations from them (dm).
GW = "gw AS (SELECT entity_id, grp, weight / sum(weight) OVER (PARTITION BY grp) AS a FROM entities WHERE weight IS NOT NULL)"
MAPPED = f"""{INF}, {GW}, im AS (SELECT item, grp AS entity_id, sum(a * estimate) AS e FROM est JOIN gw USING (entity_id) GROUP BY 1, 2), dm AS (SELECT item, entity_id, estimate - sum(a * estimate) OVER (PARTITION BY item, grp) AS e FROM est JOIN gw USING (entity_id)),
ims AS (SELECT item, resp_id, grp AS entity_id, sum(a * s) AS s FROM inf JOIN gw USING (entity_id) GROUP BY 1, 2, 3), dms AS (SELECT ims.item, ims.resp_id, gw.entity_id, coalesce(inf.s, 0) - ims.s AS s FROM ims JOIN gw ON gw.grp = ims.entity_id LEFT JOIN inf ON inf.item = ims.item AND inf.resp_id = ims.resp_id AND inf.entity_id = gw.entity_id),
pe AS (SELECT 'between' AS part, item, entity_id, e - avg(e) OVER (PARTITION BY item) AS b FROM im UNION ALL SELECT 'within', item, entity_id, e - avg(e) OVER (PARTITION BY item) FROM dm), ps AS (SELECT 'between' AS part, * FROM ims UNION ALL SELECT 'within', * FROM dms),
pc0 AS (SELECT x.part, x.item, x.entity_id AS i, y.entity_id AS j, coalesce(v, 0) AS v FROM pe x JOIN pe y ON x.part = y.part AND x.item = y.item LEFT JOIN (SELECT x.part, x.item, x.entity_id AS i, y.entity_id AS j, sum(x.s * y.s) AS v FROM ps x JOIN ps y ON x.part = y.part AND x.item = y.item AND x.resp_id = y.resp_id GROUP BY ALL) z ON z.part = x.part AND z.item = x.item AND z.i = x.entity_id AND z.j = y.entity_id),
pc AS (SELECT part, item, i, j, CASE WHEN part = 'between' THEN v - avg(v) OVER (PARTITION BY part, item, i) - avg(v) OVER (PARTITION BY part, item, j) + avg(v) OVER (PARTITION BY part, item) ELSE v END AS v FROM pc0),
pm AS (SELECT c.part, c.item, sum(CAST(i = j AS INTEGER)) AS J, sum(CASE WHEN i = j THEN x.b * x.b END) AS bb, sum(CASE WHEN i = j THEN v END) AS tr, sum(x.b * y.b * v) AS bcb, sum(v * v) AS cc FROM pc c JOIN pe x ON x.part = c.part AND x.item = c.item AND x.entity_id = i JOIN pe y ON y.part = c.part AND y.item = c.item AND y.entity_id = j GROUP BY ALL),
pv AS (SELECT part, item, J, bb / J AS variance, tr / J AS noise, (bb - tr) / J AS signal_raw, (4 * bcb - 2 * cc) / (J * J) AS v_hat FROM pm), pg AS (SELECT *, {C.positive_part_sql('signal_raw', 'sqrt(greatest(v_hat, 0))')} AS signal FROM pv),
pk AS (SELECT x.part, count(*) AS J, avg(x.b * y.b) AS covariance FROM pe x JOIN pe y ON x.part = y.part AND x.entity_id = y.entity_id AND x.item = 'a' AND y.item = 'b' GROUP BY 1), pn AS (SELECT x.part, sum(x.s * y.s) AS noise FROM ps x JOIN ps y ON x.part = y.part AND x.resp_id = y.resp_id AND x.entity_id = y.entity_id AND x.item = 'a' AND y.item = 'b' GROUP BY 1)"""


def mapped_parts(s, d):
    """Variance and covariance sheets of weighted group means and of deviations from them, ``part`` telling which."""
    sc = checkpointed(scores(s, d))
    w = checkpointed(E.group_weights(X.entities(s, d).where("weight is not null"), "weight"))
    est, infl = checkpointed(E.estimates(sc)), checkpointed(E.influences(sc))
    groups = D.group_influences(infl, w).withColumnRenamed("grp", "entity_id")
    between = D.variance_parts_of_influences(E.recentred_estimates(E.group_means(est, w).withColumnRenamed("grp", "entity_id")), groups)
    within = D.deviation_variance_parts_of_influences(E.group_deviations(est, w), infl, w)
    named = lambda df, p: df.withColumn("part", F.lit(p))
    variances = named(between, "between").unionByName(named(within, "within"))
    covariances = named(D.between_covariances(est, infl, w, pair_rows(s)), "between").unionByName(named(D.within_covariances(est, infl, w, pair_rows(s)), "within"))
    return checkpointed(variances), checkpointed(covariances)


@query("st_21_variances", with_("vi entities", f", {MAPPED} SELECT part, item, J, variance, noise, signal_raw, v_hat, signal FROM pg"), d="variance noise signal_raw v_hat signal", i="J")
def _(s, d):
    """Variance, noise and signal of weighted group means and deviations, with influences and covariance mapped alike."""
    return mapped_parts(s, d)[0]


@query("st_21_correlations", with_("vi entities", f", {MAPPED} SELECT part, lhs, rhs, J, covariance, noise, corr, corr_den, corr_c FROM (SELECT k.part, 'a' AS lhs, 'b' AS rhs, k.J, covariance, n.noise / k.J AS noise, covariance / sqrt(x.variance * y.variance) AS corr, CASE WHEN x.signal > 0 AND y.signal > 0 THEN covariance / sqrt(x.signal * y.signal) END AS corr_den, CASE WHEN x.signal > 0 AND y.signal > 0 THEN (covariance - n.noise / k.J) / sqrt(x.signal * y.signal) END AS corr_c FROM pk k JOIN pn n USING (part) JOIN pg x ON x.part = k.part AND x.item = 'a' JOIN pg y ON y.part = k.part AND y.item = 'b')"), d="covariance noise corr corr_den corr_c", i="J")
def _(s, d):
    """Covariance of both items between and within groups, its noise, and the correlations."""
    from rankloom.operators.joins import with_both_variances

    variances, covariances = mapped_parts(s, d)
    out = D.correlations(with_both_variances(covariances, variances, ["part"], ["variance", "signal"]))
    return out.select("part", "lhs", "rhs", "J", "covariance", "noise", "corr", "corr_den", "corr_c")


KATZ = f"{WV}, {IC}, kz AS (SELECT item, coalesce(CASE WHEN variance - signal > 0 THEN variance - signal END, noise) AS noise, noise AS raw FROM m3)"


def sheets(s, d):
    """The weighted variance sheet, and the covariance sheet of both items."""
    sc = checkpointed(scores(s, d))
    est, infl = checkpointed(E.estimates(sc)), checkpointed(E.influences(sc))
    w = X.entities(s, d).where("weight is not null").select("entity_id", "weight")
    return D.weighted_variance_parts_of_influences(*E.inside(est, infl, w.select("entity_id")), w), D.item_covariances(est, infl, pair_rows(s))


@query("st_22_noise_matrix", with_("vi entities", f", {KATZ} SELECT item AS v1, item AS v2, noise, raw FROM kz UNION ALL SELECT 'a', 'b', nz.noise / J, nz.noise / J FROM ic, nz UNION ALL SELECT 'b', 'a', nz.noise / J, nz.noise / J FROM ic, nz"), d="noise raw")
def _(s, d):
    return D.noise_matrix(*sheets(s, d))


@query("st_23_exact_controls", with_("vi entities", f", {KATZ}, v AS (SELECT unnest(['a', 'b', 'size']) AS v) SELECT item AS v1, item AS v2, noise, raw FROM kz UNION ALL SELECT 'a', 'b', nz.noise / J, nz.noise / J FROM ic, nz UNION ALL SELECT 'b', 'a', nz.noise / J, nz.noise / J FROM ic, nz UNION ALL SELECT x.v, y.v, 0, 0 FROM v x, v y WHERE x.v = 'size' OR y.v = 'size'"), d="noise raw")
def _(s, d):
    return D.noise_matrix(*sheets(s, d), ("size",))


@query("ag_29_average_se", with_("vi", f", {COV} SELECT item, sqrt(sum(rcov)) / count(DISTINCT entity_i) AS se FROM cov GROUP BY 1"), d="se")
def _(s, d):
    rows = E.centring_of_influences(E.influences(scores(s, d)))
    return rows.groupBy("item").agg(F.sqrt(F.first("total")).alias("se"))


@query("st_49_correlation_grid", with_("vi", f", {CORR} SELECT 1 AS i, 2 AS j, 'corr' AS kind, covariance / sqrt(x.variance * y.variance) AS value FROM ic, sv x, sv y WHERE x.item = 'a' AND y.item = 'b' UNION ALL SELECT 2, 1, 'signal', CASE WHEN x.signal > 0 AND y.signal > 0 THEN (covariance - nz.noise / ic.J) / sqrt(x.signal * y.signal) END FROM ic, nz, sv x, sv y WHERE x.item = 'a' AND y.item = 'b'"), d="value", i="i j")
def _(s, d):
    c = _correlated(s, d)
    return c.select(F.lit(1).alias("i"), F.lit(2).alias("j"), F.lit("corr").alias("kind"), F.col("corr").alias("value")).unionByName(c.select(F.lit(2).alias("i"), F.lit(1).alias("j"), F.lit("signal").alias("kind"), F.col("corr_c").alias("value")))
