"""Queries of regressions (ST-24 to ST-37, ST-50)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import denoise as D
from rankloom.operators import estimates as E
from rankloom.operators import positivity as P
from rankloom.operators import regress as R
from rankloom.operators import wages as G
from rankloom.operators.tables import checkpointed
from rankloom.operators.windows import ranks_within
from rankloom.sources import fixtures as X
from rankloom.sources.fixtures import table, with_

from .estimates import COV, GW, MAPPED, SC, WV, prep
from .registry import query

# Entity data: y = external measure, x = mean rating turned, w = weight, grp = group; item is the specification.
DATA = "xs AS (SELECT item, entity_id, avg(6.0 - value) AS x FROM vi GROUP BY 1, 2), dt AS (SELECT item, entity_id, x, disc * 100 AS y, weight AS w, grp FROM xs JOIN external USING (entity_id) JOIN entities USING (entity_id) WHERE disc IS NOT NULL AND weight > 0)"
SRC = "vi external entities"


def data(s, d):
    xs = X.valid(X.items(s, d)).groupBy("item", "entity_id").agg(F.avg(6.0 - F.col("value")).alias("x"))
    j = xs.join(X.external(s, d), "entity_id").join(X.entities(s, d), "entity_id").where("disc is not null and weight > 0")
    return j.select("item", "entity_id", "x", (F.col("disc") * 100).alias("y"), F.col("weight").alias("w"), "grp")


def eiv_sql(src: str, sigma: str, fe: str | None = None, spec: str = "item") -> str:
    by = f"{spec}, {fe}" if fe else spec
    return f"""a1 AS (SELECT *, w * count(*) OVER (PARTITION BY {spec}) / sum(w) OVER (PARTITION BY {spec}) AS wt, y - sum(w * y) OVER (PARTITION BY {by}) / sum(w) OVER (PARTITION BY {by}) AS yt, x - sum(w * x) OVER (PARTITION BY {by}) / sum(w) OVER (PARTITION BY {by}) AS xt FROM {src}),
a2 AS (SELECT {spec}, count(*) AS n, sum(wt * xt * xt) - count(*) * max({sigma}) AS q, sum(wt * xt * yt) AS sxy, sum(wt * yt * yt) AS syy FROM a1 GROUP BY {spec}),
a3 AS (SELECT *, q > 0 AND syy * q >= sxy * sxy AS ok, CASE WHEN q > 0 AND syy * q >= sxy * sxy THEN sxy / q END AS b FROM a2),
a4 AS (SELECT a1.*, n, q, ok, b, wt * (xt * (yt - b * xt) + {sigma} * b) / q AS i FROM a1 JOIN a3 USING ({spec}))"""


def noisy(s, d, sigma=0.001):
    return data(s, d).withColumn("noise", F.lit(sigma))


# Measured noise: scores of both items by both methods, and what the weighted variance sheet says of their noise among the entities of the regression.
BOTH = f"{SC[: SC.index(', sc AS')]}, sc AS (SELECT 'OLS ' || item AS item, resp_id, entity_id, 6.0 - value AS score FROM p UNION ALL SELECT 'Borda ' || a.item, a.resp_id, a.entity_id, avg(CASE WHEN a.value < b.value THEN 1.0 WHEN a.value = b.value THEN 0.5 ELSE 0.0 END) FROM p a JOIN p b ON a.item = b.item AND a.resp_id = b.resp_id AND a.entity_id <> b.entity_id GROUP BY 1, 2, 3)"


def measured_sql(keep: str = "TRUE") -> str:
    parts = COV.replace(SC, BOTH) + f", ww AS (SELECT entity_id, weight, disc * 100 AS y, grp FROM entities JOIN external USING (entity_id) WHERE disc IS NOT NULL AND weight > 0 AND {keep})" + WV[WV.index(", e2 AS") :]
    return f"{parts}, dm AS (SELECT item, entity_id, estimate AS x, ww.y, ww.weight AS w, ww.grp, coalesce(CASE WHEN variance - signal > 0 THEN variance - signal END, noise) AS noise FROM est JOIN ww USING (entity_id) JOIN m3 USING (item))"


def measured(s, d, keep=None):
    """``item`` (method and item), ``entity_id, x, y, w, grp, noise``; with ``keep``, of those entities, and with their noise."""
    rows = prep(s, d)
    sc = checkpointed(E.both_scores(ranks_within(rows, ["item", "resp_id"], "value")).select(F.concat_ws(" ", "method", "item").alias("item"), "resp_id", "entity_id", "score"))
    w = X.external(s, d).join(X.entities(s, d), "entity_id").where("disc is not null and weight > 0")
    w = (w if keep is None else w.join(keep, "entity_id", "left_semi")).select("entity_id", "weight", (F.col("disc") * 100).alias("y"), "grp")
    est, w = checkpointed(E.estimates(sc)), checkpointed(w)
    inside = [checkpointed(x) for x in E.inside(est, E.influences(sc), w.select("entity_id"))]
    noise = D.weighted_variance_parts_of_influences(*inside, w.select("entity_id", "weight")).select("item", F.coalesce("katz_noise", "noise").alias("noise"))
    return checkpointed(est.select("item", "entity_id", F.col("estimate").alias("x")).join(w, "entity_id").join(noise, "item").withColumnRenamed("weight", "w"))


@query("st_24_measured_noise", with_(SRC, f", {measured_sql()}, {eiv_sql('dm', 'noise')} SELECT item, max(b) AS b, sqrt(sum(i * i)) AS se, max(n) AS n, max(ok) AS ok, max(noise) AS noise FROM a4 GROUP BY item"), d="b se noise", i="n")
def _(s, d):
    dt = measured(s, d)
    return R.eiv(dt, ["item"], "y", "x", "w", "noise").join(dt.groupBy("item").agg(F.max("noise").alias("noise")), "item")


@query("st_24_eiv", with_(SRC, f", {DATA}, {eiv_sql('dt', '0.001')} SELECT item, max(b) AS b, sqrt(sum(i * i)) AS se, max(n) AS n, max(ok) AS ok FROM a4 GROUP BY item"), d="b se", i="n")
def _(s, d):
    return R.eiv(noisy(s, d), ["item"], "y", "x", "w", "noise")


@query("st_24_eiv_group_effects", with_(SRC, f", {DATA}, {eiv_sql('dt', '0.001', 'grp')} SELECT item, max(b) AS b, sqrt(sum(i * i)) AS se, max(n) AS n, max(ok) AS ok FROM a4 GROUP BY item"), d="b se", i="n")
def _(s, d):
    return R.eiv(noisy(s, d), ["item"], "y", "x", "w", "noise", fe="grp")


@query("st_24_two_regressors", with_(SRC, f", {DATA}, c1 AS (SELECT *, w * count(*) OVER (PARTITION BY item) / sum(w) OVER (PARTITION BY item) AS wt, y - sum(w * y) OVER (PARTITION BY item) / sum(w) OVER (PARTITION BY item) AS yt, x - sum(w * x) OVER (PARTITION BY item) / sum(w) OVER (PARTITION BY item) AS xt, grp - sum(w * grp) OVER (PARTITION BY item) / sum(w) OVER (PARTITION BY item) AS zt FROM dt), c2 AS (SELECT item, count(*) AS n, sum(wt * xt * xt) - count(*) * 0.001 AS q11, sum(wt * xt * zt) AS q12, sum(wt * zt * zt) AS q22, sum(wt * xt * yt) AS v1, sum(wt * zt * yt) AS v2 FROM c1 GROUP BY item), c3 AS (SELECT *, q11 * q22 - q12 * q12 AS det, (q22 * v1 - q12 * v2) / (q11 * q22 - q12 * q12) AS b1, (q11 * v2 - q12 * v1) / (q11 * q22 - q12 * q12) AS b2 FROM c2), c4 AS (SELECT c1.item, n, b1, b2, det, q11, q12, q22, wt * (xt * (yt - b1 * xt - b2 * zt) + 0.001 * b1) AS u1, wt * zt * (yt - b1 * xt - b2 * zt) AS u2 FROM c1 JOIN c3 USING (item)), c5 AS (SELECT item, max(n) AS n, max(b1) AS b1, max(b2) AS b2, sqrt(sum(power((q22 * u1 - q12 * u2) / det, 2))) AS s1, sqrt(sum(power((q11 * u2 - q12 * u1) / det, 2))) AS s2 FROM c4 GROUP BY item) SELECT item, 'x' AS name, b1 AS b, s1 AS se, n, TRUE AS ok FROM c5 UNION ALL SELECT item, 'z', b2, s2, n, TRUE FROM c5"), d="b se", i="n")
def _(s, d):
    dt = data(s, d).withColumn("z", F.col("grp").cast("double"))
    return R.eiv_many(dt, ["item"], "y", ["x", "z"], "w", {("x", "x"): 0.001})


@query("st_25_eiv_clustered", with_(SRC, f", {DATA}, {eiv_sql('dt', '0.001')}, c AS (SELECT item, grp, sum(i) AS i, max(b) AS b, max(n) AS n, max(ok) AS ok FROM a4 GROUP BY 1, 2) SELECT item, max(b) AS b, CASE WHEN count(*) > 1 THEN sqrt(sum(i * i) * count(*) / (count(*) - 1)) END AS se, CASE WHEN count(*) > 1 THEN sqrt(sum(i * i) * count(*) / (count(*) - 1) * max(n) / (max(n) - 2)) END AS se_adj, max(n) AS n, max(ok) AS ok FROM c GROUP BY 1"), d="b se se_adj", i="n")
def _(s, d):
    plain, adjusted = (R.eiv(noisy(s, d), ["item"], "y", "x", "w", "noise", cluster="grp", df_adj=adj) for adj in (False, True))
    return plain.join(adjusted.select("item", F.col("se").alias("se_adj")), "item")


@query("st_26_known_reliability", with_(SRC, f", {DATA}, {eiv_sql('dt', '0')}, k AS (SELECT item, sum(wt * xt * xt) AS sxx, sum(wt * xt * yt) / (0.8 * sum(wt * xt * xt)) AS rb FROM a4 GROUP BY 1) SELECT item, max(rb) AS b, sqrt(sum(power(wt * (xt * yt - rb * 0.8 * xt * xt) / (sxx * 0.8), 2))) AS se, max(n) AS n FROM a4 JOIN k USING (item) GROUP BY 1"), d="b se", i="n")
def _(s, d):
    return R.eiv_known_reliability(data(s, d), ["item"], "y", "x", "w", 0.8)


@query("st_27_naive_line", with_(SRC, f", {DATA}, {eiv_sql('dt', '0')} SELECT item, max(b) AS b, sqrt(sum(i * i)) AS se, sum(w * y) / sum(w) AS my, sum(w * x) / sum(w) AS mx FROM a4 GROUP BY 1"), d="b se my mx")
def _(s, d):
    dt = noisy(s, d, 0.0)
    through = dt.groupBy("item").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("my"), (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mx"))
    return R.eiv(dt, ["item"], "y", "x", "w", "noise").select("item", "b", "se").join(through, "item")


SUITE = "su AS (SELECT item || ':' || o AS item, entity_id, x, CASE WHEN o = 'y' THEN y ELSE ln(w) END AS y, w, grp FROM dt CROSS JOIN (SELECT unnest(['y', 'lw']) AS o))"


@query("st_29_suite", with_(SRC, f", {DATA}, {SUITE}, {eiv_sql('su', '0.001')} SELECT item AS spec, max(b) AS b, sqrt(sum(i * i)) AS se, max(n) AS n FROM a4 WHERE ok GROUP BY 1"), d="b se", i="n")
def _(s, d):
    dt = noisy(s, d)
    suite = dt.unpivot(["item", "entity_id", "x", "w", "grp", "noise"], ["y"], "o", "v").unionByName(dt.withColumn("lw", F.ln("w")).unpivot(["item", "entity_id", "x", "w", "grp", "noise"], ["lw"], "o", "v"))
    suite = suite.withColumn("spec", F.concat_ws(":", "item", "o"))
    return R.eiv(suite, ["spec"], "v", "x", "w", "noise").where("ok").drop("ok")


CELLS = "cells AS (SELECT item || ':' || o || ':' || f AS spec, entity_id, x, CASE WHEN o = 'y' THEN y ELSE ln(w) END AS y, w, CASE WHEN f = 'effects' THEN grp ELSE -1 END AS fx, {sigma} AS noise FROM {src} CROSS JOIN (SELECT unnest(['y', 'lw']) AS o) CROSS JOIN (SELECT unnest(['none', 'effects']) AS f))"


def cells(dt):
    """All cells of a suite: outcomes, with and without group effects."""
    each = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.lit(f).alias("f")) for o in ("y", "lw") for f in ("none", "effects")]))
    rows = dt.select("*", each.alias("c")).withColumn("y", F.when(F.col("c.o") == "y", F.col("y")).otherwise(F.ln("w")))
    return rows.select(F.concat_ws(":", "item", "c.o", "c.f").alias("spec"), "entity_id", "x", "y", "w", F.when(F.col("c.f") == "effects", F.col("grp")).otherwise(-1).alias("fx"), "noise")


@query("st_29_measured_suite", with_(SRC, f", {measured_sql()}, {CELLS.format(src='dm', sigma='noise')}, {eiv_sql('cells', 'noise', 'fx', 'spec')} SELECT spec, max(b) AS b, sqrt(sum(i * i)) AS se, max(n) AS n FROM a4 WHERE ok GROUP BY 1"), d="b se", i="n")
def _(s, d):
    return R.eiv(cells(measured(s, d)), ["spec"], "y", "x", "w", "noise", fe="fx").where("ok").drop("ok")


@query("st_29_suite_with_effects", with_(SRC, f", {DATA}, {CELLS.format(src='dt', sigma='0.001')}, {eiv_sql('cells', 'noise', 'fx', 'spec')} SELECT spec, max(b) AS b, sqrt(sum(i * i)) AS se, max(n) AS n FROM a4 WHERE ok GROUP BY 1"), d="b se", i="n")
def _(s, d):
    return R.eiv(cells(noisy(s, d)), ["spec"], "y", "x", "w", "noise", fe="fx").where("ok").drop("ok")


@query("st_30_between", with_(SRC, f", {DATA}, bt AS (SELECT item, grp, sum(w * x) / sum(w) AS x, sum(w * y) / sum(w) AS y, sum(w) AS w FROM dt GROUP BY 1, 2), {eiv_sql('bt', '0.0005')} SELECT item, max(b) AS b, sqrt(sum(i * i)) AS se, max(n) AS n FROM a4 GROUP BY 1"), d="b se", i="n")
def _(s, d):
    w = F.col("w")
    bt = data(s, d).groupBy("item", "grp").agg((F.sum(w * F.col("x")) / F.sum(w)).alias("x"), (F.sum(w * F.col("y")) / F.sum(w)).alias("y"), F.sum(w).alias("w")).withColumn("noise", F.lit(0.0005))
    return R.eiv(bt, ["item"], "y", "x", "w", "noise").select("item", "b", "se", "n")


# Within and between suites: deviations from weighted group means, and these means, with the noise that their own variance sheets measure.
SUITE_PARTS = MAPPED.replace(SC, BOTH).replace(GW, "gw AS (SELECT entity_id, grp, weight / sum(weight) OVER (PARTITION BY grp) AS a, weight, disc * 100 AS y FROM entities JOIN external USING (entity_id) WHERE disc IS NOT NULL AND weight > 0)")
SUITE_ROWS = f"""{SUITE_PARTS}, pr AS (SELECT 'within ' || item AS item, entity_id, e AS x, y - sum(a * y) OVER (PARTITION BY item, grp) AS y, weight AS w FROM dm JOIN gw USING (entity_id) UNION ALL SELECT 'between ' || im.item, im.entity_id, any_value(im.e), sum(a * y), sum(weight) FROM im JOIN gw ON gw.grp = im.entity_id GROUP BY im.item, im.entity_id),
nz AS (SELECT part || ' ' || item AS item, coalesce(CASE WHEN variance - signal > 0 THEN variance - signal END, noise) AS noise FROM pg), dz AS (SELECT pr.*, noise FROM pr JOIN nz USING (item))"""


def suite_rows(s, d):
    """``part, method, entity_id, y, w`` with both items' estimates ``xa, xb`` and their noise ``naa, nbb, nab``: deviations of entities (within) and group means (between)."""
    rows = prep(s, d)
    sc = checkpointed(E.both_scores(ranks_within(rows, ["item", "resp_id"], "value")).select(F.concat_ws(" ", "method", "item").alias("item"), "resp_id", "entity_id", "score"))
    own = checkpointed(X.external(s, d).join(X.entities(s, d), "entity_id").where("disc is not null and weight > 0").select("entity_id", "grp", "weight", (F.col("disc") * 100).alias("y")))
    w = checkpointed(E.group_weights(own.select("entity_id", "grp", "weight"), "weight"))
    est, infl = checkpointed(E.estimates(sc)), checkpointed(E.influences(sc))
    dev, mean = E.group_deviations(est, w), E.group_means(est, w).withColumnRenamed("grp", "entity_id")
    groups = D.group_influences(infl, w).withColumnRenamed("grp", "entity_id")
    pairs = s.range(1).select(F.inline(F.array(*[F.struct(F.lit(f"{m} a").alias("lhs"), F.lit(f"{m} b").alias("rhs")) for m in ("OLS", "Borda")])))
    yd = own.join(w.select("entity_id", "a"), "entity_id")
    ym = yd.groupBy("grp").agg(F.sum(F.col("a") * F.col("y")).alias("my"), F.sum("weight").alias("mw"))
    outcome = {"within": yd.join(ym, "grp").select("entity_id", (F.col("y") - F.col("my")).alias("y"), F.col("weight").alias("w")), "between": ym.select(F.col("grp").cast("long").alias("entity_id"), F.col("my").alias("y"), F.col("mw").alias("w"))}
    sheets = {"within": (dev, D.deviation_variance_parts_of_influences(dev, infl, w), D.within_covariances(est, infl, w, pairs)), "between": (mean, D.variance_parts_of_influences(E.recentred_estimates(mean), groups), D.between_covariances(est, infl, w, pairs))}
    out = None
    for part, (x, var, both) in sheets.items():
        x = x.select(F.split_part("item", F.lit(" "), F.lit(1)).alias("method"), F.split_part("item", F.lit(" "), F.lit(2)).alias("i"), F.col("entity_id").cast("long").alias("entity_id"), "estimate")
        wide = x.groupBy("method", "entity_id").agg(*[F.max(F.when(F.col("i") == i, F.col("estimate"))).alias(f"x{i}") for i in "ab"])
        rest = F.col("variance") - F.col("signal")
        noise = var.select(F.split_part("item", F.lit(" "), F.lit(1)).alias("method"), F.split_part("item", F.lit(" "), F.lit(2)).alias("i"), F.coalesce(F.when(rest > 0, rest), F.col("noise")).alias("noise"))
        noise = noise.groupBy("method").agg(*[F.max(F.when(F.col("i") == i, F.col("noise"))).alias(f"n{i}{i}") for i in "ab"])
        nab = both.select(F.split_part("lhs", F.lit(" "), F.lit(1)).alias("method"), F.col("noise").alias("nab"))
        rows = wide.join(outcome[part], "entity_id").join(noise, "method").join(nab, "method").select(F.lit(part).alias("part"), "method", "entity_id", "xa", "xb", "y", "w", "naa", "nbb", "nab")
        out = rows if out is None else out.unionByName(rows)
    return checkpointed(out)


@query("st_30_measured_suites", with_(SRC, f", {SUITE_ROWS}, {eiv_sql('dz', 'noise')} SELECT item AS spec, max(b) AS b, sqrt(sum(i * i)) AS se, max(n) AS n, max(ok) AS ok, max(noise) AS noise FROM a4 GROUP BY item"), d="b se noise", i="n")
def _(s, d):
    """Within and between groups, by both methods for both items, on measured noise."""
    rows = suite_rows(s, d)
    each = F.inline(F.array(*[F.struct(F.concat_ws(" ", "part", "method", F.lit(i)).alias("spec"), F.col(f"x{i}").alias("x"), F.col(f"n{i}{i}").alias("noise")) for i in "ab"]))
    long = checkpointed(rows.select("y", "w", each))
    return R.eiv(long, ["spec"], "y", "x", "w", "noise").join(long.groupBy("spec").agg(F.max("noise").alias("noise")), "spec")


@query("st_30_measured_suites_with_control")
def _(s, d):
    """The same with the other item beside it, whose noise and common noise count as well; ``eiv_many`` is tested in numpy."""
    rows = suite_rows(s, d).withColumn("spec", F.concat_ws(" ", "part", "method"))
    out = R.eiv_many(rows, ["spec"], "y", ["xa", "xb"], "w", {("xa", "xa"): "naa", ("xb", "xb"): "nbb", ("xa", "xb"): "nab"})
    return out.select("spec", "name", *[F.round(c, 6).alias(c) for c in ("b", "se")], "n", "ok")


SHARES = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS {n}" for n, c in (("a", "l_returnflag = 'A'"), ("r", "l_returnflag = 'R'"), ("o", "l_linestatus = 'O'")))


def workforce(s, d, key):
    """Three shares of each company's, or each group's, lines."""
    line = table(s, d, "lineitem").join(X.entities(s, d).select("entity_id", "grp"), F.col("l_suppkey") == F.col("entity_id"))
    flags = {"a": F.col("l_returnflag") == "A", "r": F.col("l_returnflag") == "R", "o": F.col("l_linestatus") == "O"}
    return line.groupBy(key).agg(*[F.avg(f.cast("double")).alias(n) for n, f in flags.items()])


@query("st_31_measured_outcomes", with_(SRC, f", {measured_sql()}, sh AS (SELECT l_suppkey AS entity_id, {SHARES} FROM lineitem GROUP BY 1), d2 AS (SELECT dm.item || ' ' || u.name AS item, dm.entity_id, x, CASE u.name WHEN 'a' THEN sh.a WHEN 'r' THEN sh.r ELSE sh.o END AS y, w, grp, noise FROM dm JOIN sh USING (entity_id), (SELECT unnest(['a', 'r', 'o']) AS name) u), {eiv_sql('d2', 'noise')} SELECT item AS spec, max(b) AS b, sqrt(sum(i * i)) AS se, max(n) AS n, max(ok) AS ok FROM a4 GROUP BY 1"), d="b se", i="n")
def _(s, d):
    """Workforce measures of the companies as outcomes, by both methods for both items, on measured noise."""
    rows = measured(s, d).drop("y").join(workforce(s, d, "entity_id"), "entity_id")
    each = F.inline(F.array(*[F.struct(F.concat_ws(" ", "item", F.lit(o)).alias("spec"), F.col(o).alias("y")) for o in "aro"]))
    return R.eiv(rows.select("x", "w", "noise", each), ["spec"], "y", "x", "w", "noise")


@query("st_29_all_specifications", with_(SRC, f", {measured_sql()}, sh AS (SELECT l_suppkey AS entity_id, {SHARES} FROM lineitem GROUP BY 1), sp AS (SELECT dm.item || ':' || u.name || ':' || f.name AS spec, dm.entity_id, x, CASE u.name WHEN 'y' THEN dm.y WHEN 'lw' THEN ln(w) WHEN 'a' THEN sh.a WHEN 'r' THEN sh.r ELSE sh.o END AS y, w, CASE WHEN f.name = 'effects' THEN grp ELSE -1 END AS fx, noise FROM dm JOIN sh USING (entity_id), (SELECT unnest(['y', 'lw', 'a', 'r', 'o']) AS name) u, (SELECT unnest(['none', 'effects']) AS name) f), {eiv_sql('sp', 'noise', 'fx', 'spec')} SELECT spec, max(b) AS b, sqrt(sum(i * i)) AS se, max(n) AS n FROM a4 WHERE ok GROUP BY 1"), d="b se", i="n")
def _(s, d):
    """Five outcomes on both items by both methods, with and without group effects, as one grouped job: 40 cells, of which failed ones yield no row."""
    rows = measured(s, d).join(workforce(s, d, "entity_id"), "entity_id").withColumn("lw", F.ln("w"))
    specs = F.inline(F.array(*[F.struct(F.concat_ws(":", "item", F.lit(o), F.lit(f)).alias("spec"), F.col(o).alias("v"), (F.col("grp") if f == "effects" else F.lit(-1)).alias("fx")) for o in ("y", "lw", "a", "r", "o") for f in ("none", "effects")]))
    return R.eiv(rows.select("x", "w", "noise", specs), ["spec"], "v", "x", "w", "noise", fe="fx").where("ok").drop("ok")


@query("st_31_group_shares", with_(SRC, f", {measured_sql()}, sh AS (SELECT grp, {SHARES} FROM lineitem JOIN entities ON l_suppkey = entity_id GROUP BY 1), d2 AS (SELECT dm.item, dm.entity_id, x, sh.a AS y, w, dm.grp, noise FROM dm JOIN sh ON sh.grp = dm.grp), {eiv_sql('d2', 'noise')}, c AS (SELECT item, grp, sum(i) AS i, max(b) AS b, max(n) AS n, max(ok) AS ok FROM a4 GROUP BY 1, 2) SELECT item, max(b) AS b, CASE WHEN count(*) > 1 THEN sqrt(sum(i * i) * count(*) / (count(*) - 1)) END AS se, max(n) AS n, max(ok) AS ok FROM c GROUP BY 1"), d="b se", i="n")
def _(s, d):
    """A share of the finer group as the outcome of its companies, standard errors clustered by group."""
    rows = measured(s, d).drop("y").join(workforce(s, d, "grp").select(F.col("grp").alias("_grp"), F.col("a").alias("y")), F.col("grp") == F.col("_grp"))
    return R.eiv(rows, ["item"], "y", "x", "w", "noise", cluster="grp")


@query("st_31_share_outcome", with_(SRC, f", {DATA}, sh AS (SELECT l_suppkey AS entity_id, avg(CAST(l_returnflag = 'A' AS DOUBLE)) AS y FROM lineitem GROUP BY 1), d2 AS (SELECT item, entity_id, x, sh.y, w, grp FROM dt JOIN sh USING (entity_id)), {eiv_sql('d2', '0.001')} SELECT item, max(b) AS b, sqrt(sum(i * i)) AS se, max(n) AS n FROM a4 GROUP BY 1"), d="b se", i="n")
def _(s, d):
    shares = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("entity_id")).agg(F.avg((F.col("l_returnflag") == "A").cast("double")).alias("y"))
    return R.eiv(noisy(s, d).drop("y").join(shares, "entity_id"), ["item"], "y", "x", "w", "noise").select("item", "b", "se", "n")


def interacted_sql(block: str) -> str:
    means = {c: f"{c} - sum(w * {c}) OVER (PARTITION BY {block}) / sum(w) OVER (PARTITION BY {block})" for c in ("y", "x")}
    return f"""i1 AS (SELECT *, w * count(*) OVER () / sum(w) OVER () AS wt, {means['y']} AS yt, {means['x']} AS xt FROM dt),
i2 AS (SELECT count(*) AS n, sum(wt * yt * yt) AS syy, sum(wt * xt * xt) FILTER (WHERE item = 'a') - count(*) * 0.001 / 2 AS q1, sum(wt * xt * xt) FILTER (WHERE item = 'b') - count(*) * 0.001 / 2 AS q0, sum(wt * xt * yt) FILTER (WHERE item = 'a') AS s1, sum(wt * xt * yt) FILTER (WHERE item = 'b') AS s0 FROM i1),
i3 AS (SELECT *, q1 > 0 AND q0 > 0 AND syy - s1 * s1 / q1 - s0 * s0 / q0 >= 0 AS ok, s1 / q1 AS b1, s0 / q0 AS b0 FROM i2),
i4 AS (SELECT entity_id, sum(wt * (CASE WHEN item = 'a' THEN xt * (yt - b1 * xt) ELSE 0 END + 0.0005 * b1) / q1) AS i1, sum(wt * (CASE WHEN item = 'b' THEN xt * (yt - b0 * xt) ELSE 0 END + 0.0005 * b0) / q0) AS i0 FROM i1, i3 GROUP BY 1),
i5 AS (SELECT count(*) / (count(*) - 1) AS f, sum(i1 * i1) AS v1, sum(i0 * i0) AS v0, sum(power(i1 - i0, 2)) AS v FROM i4)
SELECT 's' AS spec, CASE WHEN ok THEN b1 END AS b1, CASE WHEN ok THEN sqrt(v1 * f) END AS se1, CASE WHEN ok THEN b0 END AS b0, CASE WHEN ok THEN sqrt(v0 * f) END AS se0, CASE WHEN ok THEN b1 - b0 END AS d, CASE WHEN ok THEN sqrt(v * f) END AS se, ok FROM i3, i5"""


def stacked(s, d):
    return noisy(s, d).withColumn("g", (F.col("item") == "a").cast("int")).withColumn("spec", F.lit("s"))


@query("st_32_interacted", with_(SRC, f", {DATA}, {interacted_sql('item')}"), d="b1 se1 b0 se0 d se")
def _(s, d):
    return R.interacted_eiv(stacked(s, d), "g", ["spec"], "y", "x", "w", "noise", "entity_id")


@query("st_32_interacted_effects", with_(SRC, f", {DATA}, {interacted_sql('item, grp')}"), d="b1 se1 b0 se0 d se")
def _(s, d):
    return R.interacted_eiv(stacked(s, d), "g", ["spec"], "y", "x", "w", "noise", "entity_id", fe="grp")


OLS = "o1 AS (SELECT item, grp, x - avg(x) OVER (PARTITION BY item) AS xt, y - avg(y) OVER (PARTITION BY item) AS yt, x, y FROM dt), o2 AS (SELECT item, count(*) AS n, sum(xt * yt) / sum(xt * xt) AS b, avg(y) - sum(xt * yt) / sum(xt * xt) * avg(x) AS a, sum(xt * xt) AS sxx, sum(yt * yt) AS syy FROM o1 GROUP BY 1), o3 AS (SELECT o1.item, grp, n, b, a, syy, yt - b * xt AS e, xt * (yt - b * xt) / sxx AS i FROM o1 JOIN o2 USING (item))"


@query("st_33_ols_hc1", with_(SRC, f", {DATA}, {OLS} SELECT item, max(b) AS b, max(a) AS a, sqrt(sum(i * i) * max(n) / (max(n) - 2)) AS se, max(n) AS n, 1 - sum(e * e) / max(syy) AS r2, 1 - (sum(e * e) / max(syy)) * (max(n) - 1) / (max(n) - 2) AS adj_r2 FROM o3 GROUP BY 1"), d="b a se r2 adj_r2", i="n")
def _(s, d):
    return R.ols(data(s, d), ["item"], "y", "x")


@query("st_33_ols_clustered", with_(SRC, f", {DATA}, {OLS}, c AS (SELECT item, grp, sum(i) AS i, max(b) AS b, max(n) AS n FROM o3 GROUP BY 1, 2) SELECT item, max(b) AS b, sqrt(sum(i * i) * count(*) / (count(*) - 1) * (max(n) - 1) / (max(n) - 2)) AS se FROM c GROUP BY 1"), d="b se")
def _(s, d):
    return R.ols(data(s, d), ["item"], "y", "x", cluster="grp").select("item", "b", "se")


def ols_sql(src: str, spec: str) -> str:
    return OLS.replace("PARTITION BY item", f"PARTITION BY {spec}").replace("item", spec).replace("grp, ", "").replace("FROM dt", f"FROM {src}") + f" SELECT {spec}, max(b) AS b, max(a) AS a, sqrt(sum(i * i) * max(n) / (max(n) - 2)) AS se, max(n) AS n FROM o3 GROUP BY 1"


@query("st_34_group_level", with_(f"{SRC}", f", xa AS (SELECT item, arm, entity_id, avg(6.0 - value) AS x FROM vi GROUP BY 1, 2, 3), ent AS (SELECT item || ':' || arm || ':' || o AS cell, grp, x, CASE WHEN o = 'y' THEN disc * 100 ELSE ln(weight) END AS y FROM xa JOIN external USING (entity_id) JOIN entities USING (entity_id) CROSS JOIN (SELECT unnest(['y', 'lw']) AS o) WHERE disc IS NOT NULL AND weight > 0), lv AS (SELECT cell || ':entity' AS cell, x, y FROM ent UNION ALL SELECT cell || ':group', avg(x), avg(y) FROM ent GROUP BY cell, grp), {ols_sql('lv', 'cell')}"), d="b a se", i="n")
def _(s, d):
    """16 cells: two items, two arms and two outcomes, by entity and by groups of equal weight."""
    xs = X.valid(X.items(s, d)).groupBy("item", "arm", "entity_id").agg(F.avg(6.0 - F.col("value")).alias("x"))
    j = xs.join(X.external(s, d), "entity_id").join(X.entities(s, d), "entity_id").where("disc is not null and weight > 0")
    outcomes = F.explode(F.map_from_arrays(F.array(F.lit("y"), F.lit("lw")), F.array(F.col("disc") * 100, F.ln("weight")))).alias("o", "y")
    ent = j.select("item", "arm", "grp", "x", outcomes).select(F.concat_ws(":", "item", "arm", "o").alias("cell"), "grp", "x", "y")
    group = ent.groupBy("cell", "grp").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    both = ent.withColumn("cell", F.concat("cell", F.lit(":entity"))).unionByName(group.withColumn("cell", F.concat("cell", F.lit(":group"))))
    return R.ols(both, ["cell"], "y", "x").select("cell", "b", "a", "se", "n")


@query("st_35_many_bivariate", with_(SRC, f", {DATA}, l AS (SELECT item, x, 'disc' AS trait, y AS v FROM dt UNION ALL SELECT item, x, 'weight', w FROM dt UNION ALL SELECT item, x, 'group', grp FROM dt), z AS (SELECT item || ':' || trait AS cell, x, (v - avg(v) OVER (PARTITION BY item, trait)) / stddev_samp(v) OVER (PARTITION BY item, trait) AS y FROM l), {ols_sql('z', 'cell')}"), d="b a se", i="n")
def _(s, d):
    """Each standardised trait of the entities on each of two estimates of theirs."""
    dt = data(s, d).select("item", "x", F.col("y").alias("disc"), F.col("w").alias("weight"), F.col("grp").cast("double").alias("group"))
    long = dt.unpivot(["item", "x"], ["disc", "weight", "group"], "trait", "v").withColumn("cell", F.concat_ws(":", "item", "trait"))
    m = long.groupBy("cell").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("sd"))
    return R.ols(long.join(m, "cell").withColumn("y", (F.col("v") - F.col("m")) / F.col("sd")), ["cell"], "y", "x").select("cell", "b", "a", "se", "n")


@query("st_36_wage_gap")
def _(s, d):
    line = table(s, d, "lineitem").withColumn("lnw", F.ln(F.col("l_extendedprice") / F.col("l_quantity")))
    rows = line.withColumns({"one": F.lit(1.0), "r": (F.col("l_returnflag") == "R").cast("double"), "a": (F.col("l_returnflag") == "A").cast("double"), "o": (F.col("l_linestatus") == "O").cast("double"), "q": F.col("l_quantity") / 50, "q2": F.col("l_quantity") * F.col("l_quantity") / 2500}).withColumn("ro", F.col("r") * F.col("o"))
    out = R.weighted_least_squares(rows, "lnw", ["one", "r", "a", "o", "ro", "q", "q2"], "l_quantity")
    return out.select("name", F.round("b", 6).alias("b"), F.round("se", 6).alias("se"))


WAGE = "SELECT l_returnflag AS grp, l_linestatus = 'O' AS demo, ln(l_extendedprice / l_quantity) AS y, l_quantity AS w FROM lineitem"


@query("st_36_gap_and_level", f"WITH r AS ({WAGE}), m AS (SELECT grp, demo, sum(w * y) / sum(w) AS mean, sum(w) AS tw FROM r GROUP BY 1, 2), c AS (SELECT r.grp, r.demo, any_value(mean) AS mean, sum(power(w * (y - mean) / tw, 2)) * (SELECT count(*) / (count(*) - (SELECT count(*) FROM m)) FROM r) AS v FROM r JOIN m ON r.grp = m.grp AND r.demo = m.demo GROUP BY 1, 2) SELECT 'level ' || grp AS name, mean AS b, sqrt(v) AS se FROM c WHERE NOT demo UNION ALL SELECT 'gap ' || x.grp, x.mean - y.mean, sqrt(x.v + y.v) FROM c x JOIN c y ON x.grp = y.grp AND x.demo AND NOT y.demo", d="b se")
def _(s, d):
    """Level and gap of each group from one regression with interactions and probability weights, as sums of its coefficients."""
    rows = table(s, d, "lineitem").select(F.col("l_returnflag").alias("grp"), (F.col("l_linestatus") == "O").cast("int").alias("demo"), F.ln(F.col("l_extendedprice") / F.col("l_quantity")).alias("lnw"), F.col("l_quantity").cast("double").alias("w"))
    out = G.gaps_and_levels(rows, "lnw", "w", "demo", "grp", "0", "1")
    each = F.array(*[F.struct(F.concat(F.lit(f"{c} "), "industry").alias("name"), F.col(c).alias("b"), F.col(f"{c}_se").alias("se")) for c in ("level", "gap")])
    return out.select(F.inline(each)).where("b is not null")


def microdata(s, d):
    """Lines as workers: log price, weight, a demographic, an industry (nation of the supplier), year, another demographic, education, and an age."""
    line = table(s, d, "lineitem").join(table(s, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return line.select(
        F.ln(F.col("l_extendedprice") / F.col("l_quantity")).alias("lnw"), F.col("l_quantity").cast("double").alias("w"), (F.col("l_partkey") % 2).cast("int").alias("demo"), F.col("s_nationkey").alias("industry"),
        F.year("l_shipdate").alias("year"), (F.col("l_returnflag") == "R").cast("int").alias("other"), F.col("l_linenumber").alias("education"), (F.col("l_quantity") + 15).cast("double").alias("age"),
    )


@query("st_36_full_gaps")
def _(s, d):
    """Gaps and levels by industry, adjusted for year, a quartic of age, the other demographic and education: about 70 columns."""
    out = G.gaps_and_levels(microdata(s, d), "lnw", "w", "demo", "industry", "0", "1", ["year", "other", "education"], {"age": 4})
    return out.select("industry", *[F.round(c, 6).alias(c) for c in ("gap", "gap_se", "level", "level_se")])


SATURATED = "SELECT CAST(s_nationkey AS VARCHAR) AS grp, l_partkey % 2 = 1 AS demo, ln(l_extendedprice / l_quantity) AS y, l_quantity AS w FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"


@query("st_36_saturated_gaps", f"WITH r AS ({SATURATED}), m AS (SELECT grp, demo, sum(w * y) / sum(w) AS mean, sum(w) AS tw FROM r GROUP BY 1, 2), c AS (SELECT r.grp, r.demo, any_value(mean) AS mean, sum(power(w * (y - mean) / tw, 2)) * (SELECT count(*) / (count(*) - (SELECT count(*) FROM m)) FROM r) AS v FROM r JOIN m ON r.grp = m.grp AND r.demo = m.demo GROUP BY 1, 2) SELECT coalesce(x.grp, y.grp) AS industry, x.mean - y.mean AS gap, sqrt(x.v + y.v) AS gap_se, y.mean AS level, sqrt(y.v) AS level_se FROM (SELECT * FROM c WHERE demo) x FULL JOIN (SELECT * FROM c WHERE NOT demo) y ON x.grp = y.grp", d="gap gap_se level level_se")
def _(s, d):
    """The same by industry without further controls, where cell means give the answer."""
    return G.gaps_and_levels(microdata(s, d), "lnw", "w", "demo", "industry", "0", "1")


LPM = ", j AS (SELECT resp_id, CAST(value = -1 AS DOUBLE) AS y, balance / 1000 AS x FROM ratings JOIN raters USING (resp_id)), f AS (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b, count(*) AS n FROM j)"


def lpm(s, d):
    j = X.ratings(s, d).join(X.raters(s, d), "resp_id").select(F.lit("dk").alias("spec"), "resp_id", (F.col("value") == -1).cast("double").alias("y"), (F.col("balance") / 1000).alias("x"))
    return j, R.ols(j, ["spec"], "y", "x", cluster="resp_id")


@query("st_37_linear_probability", with_("ratings raters", f"{LPM}, c AS (SELECT resp_id, sum((x - mx) * (y - a - b * x)) / any_value(sxx) AS i FROM j, f, (SELECT avg(x) AS mx, sum(x * x) - count(*) * avg(x) * avg(x) AS sxx FROM j) GROUP BY 1) SELECT a, b, (SELECT sqrt(sum(i * i) * count(*) / (count(*) - 1)) FROM c) * sqrt((n - 1) / (n - 2)) AS se, n FROM f"), d="a b se", i="n")
def _(s, d):
    return lpm(s, d)[1].select("a", "b", "se", "n")


@query("st_37_propensity", with_("ratings raters", f"{LPM}, p AS (SELECT resp_id, any_value(a + b * x) AS propensity FROM j, f GROUP BY 1) SELECT resp_id, propensity, round(propensity, 9) > round((SELECT median(propensity) FROM p), 9) AS high FROM p"), d="propensity")
def _(s, d):
    j, fit = lpm(s, d)
    found = R.fitted_median_split(j, "resp_id", "x", fit)
    middle = found.agg(F.round(F.median("propensity"), 9).alias("m"))
    return found.crossJoin(F.broadcast(middle)).select("resp_id", "propensity", (F.round("propensity", 9) > F.col("m")).alias("high"))


DK = "k AS (SELECT entity_id, avg(CAST(value = -1 AS DOUBLE)) AS dk, row_number() OVER (ORDER BY avg(CAST(value = -1 AS DOUBLE)) DESC, entity_id) AS r FROM ratings GROUP BY 1)"


def dont_know(s, d):
    return X.ratings(s, d).groupBy("entity_id").agg(F.avg((F.col("value") == -1).cast("double")).alias("dk"))


@query("st_50_measured_below_median", with_(f"ratings {SRC}", f", {DK}, {measured_sql('entity_id IN (SELECT entity_id FROM k WHERE dk <= (SELECT median(dk) FROM k))')}, {eiv_sql('dm', 'noise')} SELECT item, max(b) AS b, sqrt(sum(i * i)) AS se, max(n) AS n, max(noise) AS noise FROM a4 GROUP BY 1"), d="b se noise", i="n")
def _(s, d):
    k = dont_know(s, d)
    dt = measured(s, d, k.crossJoin(F.broadcast(k.agg(F.median("dk").alias("m")))).where("dk <= m"))
    return R.eiv(dt, ["item"], "y", "x", "w", "noise").drop("ok").join(dt.groupBy("item").agg(F.max("noise").alias("noise")), "item")


@query("st_50_measured_without_top", with_(f"ratings {SRC}", f", {DK}, {measured_sql('entity_id IN (SELECT entity_id FROM k WHERE r > 10)')}, {eiv_sql('dm', 'noise')} SELECT item, max(b) AS b, sqrt(sum(i * i)) AS se, max(n) AS n, max(noise) AS noise FROM a4 GROUP BY 1"), d="b se noise", i="n")
def _(s, d):
    """Without the ten entities with the highest rates of don't know."""
    k = dont_know(s, d)
    top = k.orderBy(F.desc("dk"), "entity_id").limit(10)
    dt = measured(s, d, k.join(top.select("entity_id"), "entity_id", "left_anti"))
    return R.eiv(dt, ["item"], "y", "x", "w", "noise").drop("ok").join(dt.groupBy("item").agg(F.max("noise").alias("noise")), "item")


@query("st_50_below_median_dk", with_(f"ratings {SRC}", f", {DATA}, k AS (SELECT entity_id, avg(CAST(value = -1 AS DOUBLE)) AS dk FROM ratings GROUP BY 1), low AS (SELECT * FROM dt WHERE entity_id IN (SELECT entity_id FROM k WHERE dk <= (SELECT median(dk) FROM k))), {eiv_sql('low', '0.001')} SELECT item, max(b) AS b, sqrt(sum(i * i)) AS se, max(n) AS n FROM a4 GROUP BY 1"), d="b se", i="n")
def _(s, d):
    k = X.ratings(s, d).groupBy("entity_id").agg(F.avg((F.col("value") == -1).cast("double")).alias("dk"))
    low = k.crossJoin(F.broadcast(k.agg(F.median("dk").alias("m")))).where("dk <= m").select("entity_id")
    return R.eiv(noisy(s, d).join(low, "entity_id", "left_semi"), ["item"], "y", "x", "w", "noise").select("item", "b", "se", "n")


def noisy_regressors(s, d):
    """Entities with their estimates of item a by both methods and of item b (``xa, xb, xc``), two outcomes, weight, and noise: ``raw_<i><j>`` as measured, ``one_<i>`` after the correction of each by itself."""
    rows = prep(s, d)
    both = E.both_scores(ranks_within(rows, ["item", "resp_id"], "value")).where("method = 'OLS' or item = 'a'")
    sc = checkpointed(both.select(F.when(F.col("method") == "OLS", F.col("item")).otherwise("c").alias("item"), "resp_id", "entity_id", "score"))
    w = checkpointed(X.external(s, d).join(X.entities(s, d), "entity_id").where("disc is not null and weight > 0").select("entity_id", "weight", "grp", (F.col("disc") * 100).alias("y")))
    est, infl = checkpointed(E.estimates(sc)), checkpointed(E.influences(sc))
    inside = [checkpointed(x) for x in E.inside(est, infl, w.select("entity_id"))]
    var = D.weighted_variance_parts_of_influences(*inside, w.select("entity_id", "weight"))
    pairs = s.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("lhs"), F.lit(j).alias("rhs")) for i, j in ("ab", "ac", "bc")])))
    own = w.select("entity_id")
    cov = D.item_covariances(est.join(own, "entity_id", "left_semi"), infl.join(own, "entity_id", "left_semi"), pairs)
    pick = lambda df, cond, c: F.max(F.when(cond, F.col(c)))
    noise = var.agg(*[pick(var, F.col("item") == i, c).alias(f"{n}_{i}") for i in "abc" for n, c in (("raw", "noise"), ("katz", "katz_noise"))])
    between = cov.agg(*[pick(cov, (F.col("lhs") == i) & (F.col("rhs") == j), "noise").alias(f"raw_{i}{j}") for i, j in ("ab", "ac", "bc")])
    noise = noise.select(*[F.col(f"raw_{i}").alias(f"raw_{i}{i}") for i in "abc"], *[F.coalesce(f"katz_{i}", f"raw_{i}").alias(f"one_{i}") for i in "abc"])
    wide = est.groupBy("entity_id").agg(*[pick(est, F.col("item") == i, "estimate").alias(f"x{i}") for i in "abc"]).dropna()
    dt = wide.join(w, "entity_id").crossJoin(F.broadcast(noise)).crossJoin(F.broadcast(between))  # one row of noise each
    outcomes = F.array(F.struct(F.lit("y").alias("lhs"), F.col("y").alias("v")), F.struct(F.lit("lw").alias("lhs"), F.ln("weight").alias("v")))
    return checkpointed(dt.select("*", F.inline(outcomes)))


def joint(dt, items: str):
    """Regressions of both outcomes on the estimates ``items``, after the joint correction of their noise."""
    xs = [f"x{i}" for i in items]
    raw = {(f"x{i}", f"x{j}"): f"raw_{min(i, j)}{max(i, j)}" for i in items for j in items if i <= j}
    alone = {(a, b): f"one_{a[1]}" if a == b else c for (a, b), c in raw.items()}
    rows, noise = P.joint_noise(dt.withColumn("spec", F.concat_ws(" ~ ", "lhs", F.lit(" + ".join(items)))), ["spec"], xs, "weight", raw, alone)
    rows = checkpointed(rows)
    fit = R.eiv_many(rows, ["spec"], "v", xs, "weight", noise)
    how = rows.groupBy(F.col("spec").alias("_spec")).agg(F.first("corrected").alias("corrected"), F.first("accepted").alias("accepted"), F.first("draws").alias("draws"))
    return fit.join(how, F.col("spec") == F.col("_spec")).select("spec", "name", *[F.round(c, 6).alias(c) for c in ("b", "se")], "n", "ok", "corrected", "accepted", "draws")


@query("st_28_positive_signal")
def _(s, d):
    """Regressions of two outcomes on both items, with the noise of the items corrected together."""
    return joint(noisy_regressors(s, d), "ab")


@query("st_28_all_specifications")
def _(s, d):
    """The same for all sets of two and three of the noisy regressors, one row for each specification and regressor."""
    dt = noisy_regressors(s, d)
    sets = [joint(dt, items) for items in ("ab", "ac", "bc", "abc")]
    return sets[0].unionByName(sets[1]).unionByName(sets[2]).unionByName(sets[3])
