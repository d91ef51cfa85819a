"""Queries of pair differences and comparisons (ST-38 to ST-51)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions import columns as C
from rankloom.operators import bootstrap as B
from rankloom.operators import cells as CE
from rankloom.operators import compare as K
from rankloom.operators import denoise as D
from rankloom.operators import estimates as E
from rankloom.operators.tables import checkpointed
from rankloom.operators.windows import permuted_ids, ranks_within
from rankloom.sources import fixtures as X
from rankloom.sources.fixtures import with_

from .estimates import GRID, REC, SC, VP, WT, P, fitted, prep, recentred, shrunken_sql
from .registry import query


def halves(s, d):
    """Scores of item a, split by arm; the arm's estimates and influences."""
    rows = X.valid(X.ratings(s, d)).withColumn("item", F.lit("a"))
    out = []
    for arm in ("contact", "conduct"):
        sc = E.mean_scores(rows.where(F.col("arm") == arm))
        out.append((sc, E.estimates(sc), E.influences(sc)))
    return out


@query("st_38_39_vector_tests")
def _(s, d):
    (_, ea, ia), (_, eb, ib) = halves(s, d)
    out = K.vector_tests(ea, eb, ia, ib)
    return out.select("item", "J", *[F.round(c, 4).alias(c) for c in ("wald", "wald_p", "cmd", "cmd_p", "a", "b")])


# Nine pairs of subsamples, by two methods for two items: name, first and second subsample.
PAIRS = [
    ("arm", "arm = 'contact'", "arm = 'conduct'"), ("framing", "framing = 'pos'", "framing = 'neg'"), ("rich", "rich = 1", "rich = 0"), ("odd", "odd = 1", "odd = 0"), ("auto", "auto = 1", "auto = 0"),
    ("contact", "arm = 'contact' AND framing = 'pos'", "arm = 'contact' AND framing = 'neg'"), ("conduct", "arm = 'conduct' AND framing = 'pos'", "arm = 'conduct' AND framing = 'neg'"),
    ("pos", "framing = 'pos' AND rich = 1", "framing = 'pos' AND rich = 0"), ("neg", "framing = 'neg' AND rich = 1", "framing = 'neg' AND rich = 0"),
]
SIDES = ", ".join(f"struct_pack(cell := '{n}', side := {k}, inside := coalesce({c}, FALSE))" for n, *both in PAIRS for k, c in enumerate(both, 1))
CELLS36 = f"""{P}, pz AS (SELECT p.*, rich, odd, auto FROM p JOIN raters USING (resp_id)),
mt AS (SELECT 'OLS' AS method, item, resp_id, entity_id, 6.0 - value AS score FROM p UNION ALL SELECT 'Borda', a.item, a.resp_id, a.entity_id, avg(CASE WHEN a.value < b.value THEN 1.0 WHEN a.value = b.value THEN 0.5 ELSE 0.0 END) FROM p a JOIN p b ON a.item = b.item AND a.resp_id = b.resp_id AND a.entity_id <> b.entity_id GROUP BY 2, 3, 4),
sd AS (SELECT DISTINCT item, resp_id, unnest([{SIDES}]) AS c FROM pz),
sc AS (SELECT c.cell || ':' || method || ':' || mt.item || ':' || c.side AS item, mt.resp_id, entity_id, score FROM mt JOIN sd ON mt.item = sd.item AND mt.resp_id = sd.resp_id WHERE c.inside)"""


def cell_scores(s, d):
    """Scores of the 36 cells: ``cell`` (pair, method and item), ``side, sample, resp_id, entity_id, score``; the methods and items of a pair share its samples."""
    rows = prep(s, d)
    borda = E.borda_scores(ranks_within(rows, ["item", "resp_id"], "value"))
    both = E.mean_scores(rows).withColumn("method", F.lit("OLS")).unionByName(borda.withColumn("method", F.lit("Borda")))
    who = rows.select("item", "resp_id", "arm", "framing").distinct().join(X.raters(s, d), "resp_id")
    sides = F.array(*[F.struct(F.lit(n).alias("cell"), F.lit(k).alias("side"), F.coalesce(F.expr(c), F.lit(False)).alias("inside")) for n, *two in PAIRS for k, c in enumerate(two, 1)])
    who = who.select("item", "resp_id", F.explode(F.filter(sides, lambda x: x["inside"])).alias("c"))
    return both.join(who, ["item", "resp_id"]).select(F.concat_ws(":", "c.cell", "method", "item").alias("cell"), F.col("c.side").alias("side"), F.concat_ws(":", "c.cell", "c.side").alias("sample"), "resp_id", "entity_id", "score")


def packed_cells(s, d):
    """The scores of the 36 cells as packed rows, and the names of the cells."""
    rows = CE.packed(cell_scores(s, d), ["cell", "side"])
    return rows, CE.cells_of(rows)


@query("st_38_39_cells")
def _(s, d):
    """Both tests in all cells, on recentred estimates."""
    out = CE.fits(*packed_cells(s, d)).withColumnRenamed("cell", "item")
    return out.select("item", "J", *[F.round(c, 4).alias(c) for c in ("wald", "wald_p", "cmd", "cmd_p", "a", "b")])


@query("st_40_cells", with_("vi raters", f", {CELLS36}{REC[len(SC):]}, {VP}, sg AS (SELECT item, {C.positive_part_sql('signal_raw', 'sqrt(greatest(v_hat, 0))')} AS signal FROM vr2), k AS (SELECT left(x.item, length(x.item) - 2) AS item, avg(x.estimate * y.estimate) - avg(x.estimate) * avg(y.estimate) AS c FROM est x JOIN est y ON left(x.item, length(x.item) - 2) = left(y.item, length(y.item) - 2) AND right(x.item, 1) = '1' AND right(y.item, 1) = '2' AND x.entity_id = y.entity_id GROUP BY 1) SELECT k.item, CASE WHEN a.signal > 0 AND b.signal > 0 THEN c / sqrt(a.signal * b.signal) END AS corr FROM k JOIN sg a ON a.item = k.item || ':1' JOIN sg b ON b.item = k.item || ':2'"), d="corr")
def _(s, d):
    """Signal correlation of all cells, with the signal variances of both sides."""
    sums = CE.signal_sums(*packed_cells(s, d))
    signal = D.parts_of_sums(sums, ["cell", "side", "c"])
    one, two = (signal.where(F.col("side") == k).select(F.col("cell").alias("item"), "c", F.col("signal").alias(f"s{k}")) for k in (1, 2))
    both = one.join(two.drop("c"), "item")
    return both.select("item", F.when((F.col("s1") > 0) & (F.col("s2") > 0), F.col("c") / F.sqrt(F.col("s1") * F.col("s2"))).alias("corr"))


ARMS = "m AS (SELECT arm, entity_id, avg(6.0 - value) AS e FROM vr GROUP BY 1, 2), c AS (SELECT arm, entity_id, e - avg(e) OVER (PARTITION BY arm) AS e FROM m)"


@query("st_40_signal_correlation", with_("vr", f", {ARMS} SELECT 'a' AS item, (avg(x.e * y.e) - avg(x.e) * avg(y.e)) / sqrt((SELECT var_pop(e) FROM c WHERE arm = 'contact') * (SELECT var_pop(e) FROM c WHERE arm = 'conduct')) AS corr FROM c x JOIN c y ON x.arm = 'contact' AND y.arm = 'conduct' AND x.entity_id = y.entity_id"), d="corr")
def _(s, d):
    (_, ea, _), (_, eb, _) = halves(s, d)
    sa, sb = (e.groupBy("item").agg(F.var_pop("estimate").alias("signal")) for e in (ea, eb))
    return K.signal_correlation(ea, eb, ["item"], sa, sb)


#: Bootstrap replicates, as in the reference.
REPLICATES = 499


@query("st_41_bootstrap")
def _(s, d):
    (sa, _, _), (sb, _, _) = halves(s, d)
    out = K.bootstrap_tests(checkpointed(sa), checkpointed(sb), REPLICATES)
    return out.select(*[F.round(c, 4).alias(c) for c in ("wald", "wald_p", "cmd", "cmd_p")], "reps")


@query("st_41_cells")
def _(s, d):
    """Bootstrap p-values of both tests in all 36 cells."""
    out = B.bootstrap_cells(cell_scores(s, d), REPLICATES)
    return out.select("cell", "J", *[F.round(c, 4).alias(c) for c in ("wald", "wald_p", "cmd", "cmd_p")], "reps")


@query("st_42_raw_correlation", with_("vr", f", {ARMS} SELECT corr(x.e, y.e) AS corr, count(*) AS n FROM c x JOIN c y ON x.arm = 'contact' AND y.arm = 'conduct' AND x.entity_id = y.entity_id"), d="corr", i="n")
def _(s, d):
    (_, ea, _), (_, eb, _) = halves(s, d)
    return ea.select("entity_id", F.col("estimate").alias("x")).join(eb.select("entity_id", F.col("estimate").alias("y")), "entity_id").agg(F.corr("x", "y").alias("corr"), F.count(F.lit(1)).alias("n"))


@query("st_42_placebo")
def _(s, d):
    (_, ea, _), (_, eb, _) = halves(s, d)
    shuffled = eb.join(permuted_ids(eb, "entity_id", 42, "placebo"), "entity_id").select(F.col("placebo").alias("entity_id"), F.col("estimate").alias("y"))
    return ea.select("entity_id", F.col("estimate").alias("x")).join(shuffled, "entity_id").agg(F.round(F.corr("x", "y"), 6).alias("corr"), F.count(F.lit(1)).alias("n"))


@query("st_43_uniformity", "WITH p AS (SELECT l_returnflag AS g, (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31 + l_suppkey) % 100003 / 100003.0::DOUBLE AS p FROM lineitem), r AS (SELECT g, p, row_number() OVER (PARTITION BY g ORDER BY p) AS k, count(*) OVER (PARTITION BY g) AS n FROM p) SELECT g, max(greatest(k / n - p, p - (k - 1) / n)) AS ks, avg(CAST(p <= 0.05 AS DOUBLE)) AS at_5, avg(CAST(p <= 0.1 AS DOUBLE)) AS at_10 FROM r GROUP BY 1", d="ks at_5 at_10")
def _(s, d):
    line = X.table(s, d, "lineitem")
    p = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729 + F.col("l_partkey") * 31 + F.col("l_suppkey")) % 100003 / 100003.0
    return K.uniformity(line.select(F.col("l_returnflag").alias("g"), p.alias("p")), ["g"], "p")


@query("st_43_calibration")
def _(s, d):
    """Random halves of all raters: how far the p-values of both tests are from uniform."""
    p = K.calibration(checkpointed(E.mean_scores(X.valid(X.ratings(s, d)).withColumn("item", F.lit("a")))))
    long = p.unpivot("split", ["wald_p", "cmd_p"], "test", "p").where("p is not null")
    return K.uniformity(long, ["test"], "p").select("test", *[F.round(c, 4).alias(c) for c in ("ks", "at_5", "at_10")])


@query("st_43_bootstrap_calibration")
def _(s, d):
    """Random halves of all raters, 100 times: how far the bootstrap p-values of both tests, of 99 replicates each, are from uniform."""
    scores = X.valid(X.ratings(s, d)).select("resp_id", "entity_id", (6.0 - F.col("value")).alias("score"))
    p = checkpointed(B.bootstrap_halves(scores, 100, 99).select("cell", "wald_p", "cmd_p"))
    long = p.unpivot("cell", ["wald_p", "cmd_p"], "test", "p").where("p is not null")
    return K.uniformity(long, ["test"], "p").select("test", *[F.round(c, 4).alias(c) for c in ("ks", "at_5", "at_10")])


CELL = "SELECT {c}, count(*) AS pairs FROM vr a JOIN vr b ON a.arm = b.arm AND a.entity_id = b.entity_id AND a.resp_id < b.resp_id GROUP BY 1, 2"


@query("st_44_rating_differences", with_("vr", "SELECT a.arm, a.entity_id, count(*) AS pairs, avg(abs(a.value - b.value)) AS amad, avg(CAST(a.value <> b.value AS DOUBLE)) AS p_differ, avg(CASE WHEN a.value <> b.value THEN abs(a.value - b.value) END) AS gap_if_differ FROM vr a JOIN vr b ON a.arm = b.arm AND a.entity_id = b.entity_id AND a.resp_id < b.resp_id GROUP BY 1, 2"), d="pairs amad p_differ gap_if_differ")
def _(s, d):
    return K.rating_differences(X.valid(X.ratings(s, d)), ["arm"]).where("pairs > 0")


@query("st_45_win_differences", with_("vr", ", w AS (SELECT a.arm, a.resp_id, a.entity_id AS i, b.entity_id AS j, CASE WHEN a.value < b.value THEN 1.0 WHEN a.value = b.value THEN 0.5 ELSE 0.0 END AS w FROM vr a JOIN vr b ON a.resp_id = b.resp_id AND a.entity_id <> b.entity_id AND b.entity_id NOT IN (1, 2)), f AS (SELECT x.arm, x.i, count(*) AS pairs, sum(abs(x.w - y.w)) AS far FROM w x JOIN w y ON x.arm = y.arm AND x.i = y.i AND x.j = y.j AND x.resp_id < y.resp_id GROUP BY 1, 2), t AS (SELECT arm, i, avg(CAST(w = 0.5 AS DOUBLE)) AS tie_share FROM w GROUP BY 1, 2) SELECT t.arm, t.i AS entity_id, coalesce(pairs, 0) AS pairs, far / pairs AS amad, tie_share FROM t LEFT JOIN f ON t.arm = f.arm AND t.i = f.i"), d="pairs amad tie_share")
def _(s, d):
    return K.win_differences(X.valid(X.ratings(s, d)), ["arm"], (1, 2))


@query("st_46_difference_se", with_("vr", ", am AS (SELECT a.arm, a.entity_id, avg(abs(a.value - b.value)) AS amad FROM vr a JOIN vr b ON a.arm = b.arm AND a.entity_id = b.entity_id AND a.resp_id < b.resp_id GROUP BY 1, 2), ow AS (SELECT a.arm, a.entity_id, a.resp_id, sum(abs(a.value - b.value)) / CAST(count(*) - 1 AS DOUBLE) AS d, count(*) AS n FROM vr a JOIN vr b ON a.arm = b.arm AND a.entity_id = b.entity_id GROUP BY 1, 2, 3 HAVING count(*) > 1), t AS (SELECT arm, resp_id, sum(2 * (d - amad) / n) AS t FROM ow JOIN am USING (arm, entity_id) GROUP BY 1, 2), h AS (SELECT arm, avg(amad) AS mean, count(*) AS J FROM am GROUP BY 1), r AS (SELECT arm, count(DISTINCT resp_id) AS R FROM vr GROUP BY 1) SELECT h.arm, any_value(mean) AS mean, any_value(J) AS J, sqrt((sum(t * t) - sum(t) * sum(t) / any_value(R)) * any_value(R) / (any_value(R) - 1) / (any_value(J) * any_value(J))) AS se FROM h JOIN t USING (arm) JOIN r USING (arm) GROUP BY 1"), d="mean se", i="J")
def _(s, d):
    return K.difference_se(X.valid(X.ratings(s, d)), ["arm"])


@query("st_46_win_difference_se", with_("vr", ", w AS (SELECT a.arm, a.resp_id, a.entity_id AS i, b.entity_id AS j, CASE WHEN a.value < b.value THEN 1.0 WHEN a.value = b.value THEN 0.5 ELSE 0.0 END AS w FROM vr a JOIN vr b ON a.resp_id = b.resp_id AND a.entity_id <> b.entity_id AND b.entity_id NOT IN (1, 2)), o AS (SELECT x.arm, x.i, x.resp_id, sum(abs(x.w - y.w)) AS far, CAST(count(*) - count(DISTINCT x.j) AS DOUBLE) AS met FROM w x JOIN w y ON x.arm = y.arm AND x.i = y.i AND x.j = y.j GROUP BY 1, 2, 3), tt AS (SELECT arm, i, resp_id, sum(CAST(w = 0.5 AS DOUBLE)) AS ties, CAST(count(*) AS DOUBLE) AS wins FROM w GROUP BY 1, 2, 3), st AS (SELECT arm, i, sum(far) / 2 AS af, sum(met) / 2 AS pairs, sum(ties) AS at, sum(wins) AS aw, CASE WHEN sum(met) > 0 THEN sum(far) / sum(met) END AS amad, sum(ties) / sum(wins) AS tie FROM o JOIN tt USING (arm, i, resp_id) GROUP BY 1, 2), h AS (SELECT arm, count(amad) AS J, avg(amad) AS mean, count(tie) AS J_tie, avg(tie) AS mean_tie FROM st GROUP BY 1), pr AS (SELECT arm, resp_id, sum(CASE WHEN amad IS NOT NULL THEN (far - amad * met) / pairs ELSE 0 END) AS t, sum((ties - tie * wins) / aw) AS u FROM o JOIN tt USING (arm, i, resp_id) JOIN st USING (arm, i) GROUP BY 1, 2), m AS (SELECT arm, sum(t) AS s1, sum(t * t) AS s2, sum(u) AS u1, sum(u * u) AS u2 FROM pr GROUP BY 1), r AS (SELECT arm, count(DISTINCT resp_id) AS R FROM vr GROUP BY 1) SELECT arm, J, mean, sqrt(greatest((s2 - s1 * s1 / R) * R / (R - 1), 0)) / J AS se, J_tie, mean_tie, sqrt(greatest((u2 - u1 * u1 / R) * R / (R - 1), 0)) / J_tie AS se_tie FROM h JOIN m USING (arm) JOIN r USING (arm)"), d="mean se mean_tie se_tie", i="J J_tie")
def _(s, d):
    return K.win_difference_se(X.valid(X.ratings(s, d)), ["arm"], (1, 2))


@query("st_47_framing_cells", with_("ratings", "SELECT resp_id, entity_id, arm || '_' || framing AS cell FROM ratings"))
def _(s, d):
    r = X.ratings(s, d)
    names = [f"{a}_{f}" for a in ("contact", "conduct") for f in ("pos", "neg")]
    wide = r.select("resp_id", "entity_id", *[F.when(F.concat_ws("_", "arm", "framing") == n, F.col("value")).alias(n) for n in names])
    return K.framing_cells(wide, names).select("resp_id", "entity_id", "cell")


# Group means and deviations from them, with standard errors; those of 1e-6 and less are rounding of an exact 0.
PARTS = f"{REC}, {WT}, gm AS (SELECT item, grp AS entity_id, sum(a * estimate) AS estimate FROM est_c JOIN g USING (entity_id) GROUP BY 1, 2), gv AS (SELECT item, x.grp AS entity_id, sum(x.a * y.a * rcov) AS v FROM cov_c JOIN g x ON x.entity_id = entity_i JOIN g y ON y.entity_id = entity_j WHERE x.grp = y.grp GROUP BY 1, 2), gs AS (SELECT item, entity_id, estimate, sqrt(greatest(round(v, 12), 0)) AS se FROM gm JOIN gv USING (item, entity_id)), dx AS (SELECT item, entity_i AS entity_id, sum(y.a * rcov) AS c FROM cov_c JOIN g x ON x.entity_id = entity_i JOIN g y ON y.entity_id = entity_j WHERE x.grp = y.grp GROUP BY 1, 2), ds AS (SELECT e.item, e.entity_id, e.estimate - gm.estimate AS estimate, sqrt(greatest(round(cov_c.rcov - 2 * c + gv.v, 12), 0)) AS se FROM est_c e JOIN g USING (entity_id) JOIN gm ON gm.item = e.item AND gm.entity_id = grp JOIN gv ON gv.item = e.item AND gv.entity_id = grp JOIN dx ON dx.item = e.item AND dx.entity_id = e.entity_id JOIN cov_c ON cov_c.item = e.item AND entity_i = e.entity_id AND entity_j = e.entity_id)"


@query("st_48_group_shrunken", with_("vi entities", f", {PARTS}, {shrunken_sql('gs', 'g')} SELECT item, entity_id AS grp, round(eb, 4) AS eb FROM eb_g"))
def _(s, d):
    est, cov = recentred(s, d)
    return E.shrunken(_group_level(est, cov, E.group_weights(X.entities(s, d))), GRID).select("item", F.col("entity_id").alias("grp"), F.round("eb", 4).alias("eb"))


def _root(v):
    return F.sqrt(F.greatest(F.round(v, 12), F.lit(0.0))).alias("se")


def _group_level(est, cov, w):
    se = E.recentred_group_variances(cov, w).select("item", F.col("grp").alias("entity_id"), _root("v"))
    return E.group_means(est, w).withColumnRenamed("grp", "entity_id").join(se, ["item", "entity_id"])


@query("st_48_shrunken_parts", with_("vi entities", f", {PARTS}, {shrunken_sql('gs', 'g')}, {shrunken_sql('ds', 'd')}, mu AS (SELECT item, avg(estimate) AS mu FROM est GROUP BY 1) SELECT est.item, est.entity_id, round(eb_g.eb, 4) AS between_part, round(coalesce(eb_d.eb, 0), 4) AS within_part, round(mu + eb_g.eb + coalesce(eb_d.eb, 0), 4) AS shrunken FROM est JOIN mu USING (item) JOIN g USING (entity_id) JOIN eb_g ON eb_g.item = est.item AND eb_g.entity_id = grp LEFT JOIN eb_d ON eb_d.item = est.item AND eb_d.entity_id = est.entity_id"))
def _(s, d):
    """Shrunken group means and deviations, put together again with the overall mean."""
    raw, cov = fitted(s, d)
    raw = checkpointed(raw)
    est = checkpointed(E.recentred_estimates(raw))
    w = E.group_weights(X.entities(s, d))
    diagonal = E.deviation_variances(cov, w).select("item", "entity_id", _root("v"))
    inner = E.group_deviations(est, w).select("item", "entity_id", "estimate").join(diagonal, ["item", "entity_id"])
    between = E.shrunken(_group_level(est, cov, w), GRID).select("item", F.col("entity_id").alias("grp"), F.col("eb").alias("g"))
    within = E.shrunken(inner, GRID).select("item", "entity_id", F.col("eb").alias("w"))
    mu = raw.groupBy("item").agg(F.avg("estimate").alias("mu"))
    j = raw.select("item", "entity_id").join(mu, "item").join(w.select("entity_id", "grp"), "entity_id").join(between, ["item", "grp"]).join(within, ["item", "entity_id"], "left")
    inside = F.coalesce("w", F.lit(0.0))
    return j.select("item", "entity_id", F.round("g", 4).alias("between_part"), F.round(inside, 4).alias("within_part"), F.round(F.col("mu") + F.col("g") + inside, 4).alias("shrunken"))


PUB = "a AS (SELECT entity_id, avg(value) AS e1, sqrt(var_samp(value) / count(*)) AS s1 FROM vi WHERE item = 'a' GROUP BY 1), b AS (SELECT entity_id, avg(value) AS e2, sqrt(var_samp(value) / count(*)) AS s2 FROM vi WHERE item = 'b' GROUP BY 1)"


@query("st_51_against_published", with_("vi", f", {PUB} SELECT entity_id, e1 - e2 AS difference, e2 - 1.96 * s2 AS low, e2 + 1.96 * s2 AS high, e1 BETWEEN e2 - 1.96 * s2 AND e2 + 1.96 * s2 AS inside, CASE WHEN abs(e1) > 1.96 * s1 THEN sign(e1) ELSE 0 END = CASE WHEN abs(e2) > 1.96 * s2 THEN sign(e2) ELSE 0 END AS same_significance FROM a JOIN b USING (entity_id)"), d="difference low high")
def _(s, d):
    m = X.valid(X.items(s, d)).groupBy("item", "entity_id").agg(F.avg("value").alias("estimate"), F.sqrt(F.var_samp("value") / F.count(F.lit(1))).alias("se"))
    return K.against_published(m.where("item = 'a'"), m.where("item = 'b'"), "entity_id")
