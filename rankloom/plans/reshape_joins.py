"""Queries of reshapes and joins (RS, JN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions import columns as C
from rankloom.operators import joins as J
from rankloom.operators import reshape as S
from rankloom.sources import fixtures as X
from rankloom.sources.fixtures import table, with_

from .recode import DIRTY_SQL, TIERS_SQL, dirty
from .registry import query

WIDE_SQL = "SELECT resp_id" + "".join(f", max(CASE WHEN slot = {k} THEN {c} END) AS {n}_{k}" for k in range(1, 6) for c, n in (("entity_id", "firm"), ("value", "rating"))) + " FROM ratings GROUP BY resp_id"


def wide(s, d):
    r = X.ratings(s, d)
    return S.spread(r.withColumn("slot", F.col("slot").cast("string")), ["resp_id"], "slot", {"firm": F.col("entity_id"), "rating": F.col("value")}, [str(k) for k in range(1, 6)]).withColumnsRenamed({f"{k}_{n}": f"{n}_{k}" for k in range(1, 6) for n in ("firm", "rating")})


@query("rs_1_slots_to_long", with_("ratings", "SELECT r.resp_id, k.slot, v.entity_id AS firm, v.value AS rating FROM (SELECT DISTINCT resp_id FROM ratings) r CROSS JOIN (SELECT unnest(range(1, 6)) AS slot) k LEFT JOIN ratings v ON v.resp_id = r.resp_id AND v.slot = k.slot"), i="slot firm rating")
def _(s, d):
    return S.slots_to_long(wide(s, d), ["resp_id"], ["firm", "rating"])


@query("rs_2_ranks_wide", with_("ratings", "SELECT resp_id, " + ", ".join(f"coalesce(max(CASE WHEN entity_id = {e} THEN value END), 0) AS firm{e}" for e in (0, 1, 2, 7)) + " FROM ratings GROUP BY resp_id"))
def _(s, d):
    return S.ranks_to_wide(X.ratings(s, d), "resp_id", "entity_id", "value", (7, 2, 0, 1))


MEANS_SQL = "means AS (SELECT item, entity_id, avg(6.0 - value) AS m FROM vi GROUP BY item, entity_id)"


@query("rs_3_items_wide", with_("vi external", f", {MEANS_SQL}, w AS (SELECT entity_id, max(CASE WHEN item = 'a' THEN m END) AS a, max(CASE WHEN item = 'b' THEN m END) AS b FROM means GROUP BY entity_id) SELECT entity_id, a, b, disc FROM w LEFT JOIN external USING (entity_id)"), d="a b disc")
def _(s, d):
    means = X.valid(X.items(s, d)).groupBy("item", "entity_id").agg(F.avg(6.0 - F.col("value")).alias("m"))
    return S.spread(means, ["entity_id"], "item", {"": F.col("m")}, ["a", "b"]).join(X.external(s, d), "entity_id", "left")


@query("rs_4_unpivot", "SELECT p_partkey, 'p_size' AS measure, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part", d="value")
def _(s, d):
    return table(s, d, "part").select("p_partkey", F.col("p_size").cast("double"), "p_retailprice").unpivot("p_partkey", ["p_size", "p_retailprice"], "measure", "value")


@query("rs_5_complete", "SELECT g.n_nationkey, v.r AS code, count(s.s_suppkey) AS n FROM nation g CROSS JOIN (SELECT unnest(range(0, 4)) AS r) v LEFT JOIN supplier s ON s.s_nationkey = g.n_nationkey AND s.s_suppkey % 4 = v.r GROUP BY 1, 2", i="n code")
def _(s, d):
    counts = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey"), (F.col("s_suppkey") % 4).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return S.complete(counts, table(s, d, "nation").select("n_nationkey"), s.range(4).withColumnRenamed("id", "code"), ["n_nationkey", "code"], "n")


@query("rs_6_expand_ranges", "SELECT p_partkey, unnest(range(p_size, p_size + p_partkey % 4 + 1)) AS code FROM part", i="code")
def _(s, d):
    p = table(s, d, "part").select("p_partkey", F.concat_ws("-", F.col("p_size").cast("string"), (F.col("p_size") + F.col("p_partkey") % 4).cast("string")).alias("r"))
    return S.expand_ranges(p, "r", "code").drop("r")


@query("rs_7_triples", with_("ratings", "SELECT resp_id, 'x' || slot AS \"column\", value FROM (SELECT r.resp_id, k.slot, v.value FROM (SELECT DISTINCT resp_id FROM ratings) r CROSS JOIN (SELECT unnest(range(1, 6)) AS slot) k LEFT JOIN ratings v ON v.resp_id = r.resp_id AND v.slot = k.slot)"))
def _(s, d):
    w = wide(s, d).select("resp_id", *[F.col(f"rating_{k}").alias(f"x{k}") for k in range(1, 6)])
    return S.triples(w, "resp_id", [f"x{k}" for k in range(1, 6)])


@query("rs_8_group_wide", "SELECT l_suppkey, avg(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS a, avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS r, avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END) - avg(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS gap FROM lineitem GROUP BY l_suppkey", d="a r gap")
def _(s, d):
    m = table(s, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_quantity").alias("m"))
    return S.spread(m, ["l_suppkey"], "l_returnflag", {"": F.col("m")}, ["A", "R"]).select("l_suppkey", F.col("A").alias("a"), F.col("R").alias("r"), (F.col("R") - F.col("A")).alias("gap"))


CELL_MEANS = "m AS (SELECT item AS lhs, entity_id AS rhs, 100 * avg(value) AS estimate, 100 * sqrt(var_samp(value) / count(*)) AS se FROM vi GROUP BY 1, 2)"


def cell_means(s, d):
    return X.valid(X.items(s, d)).groupBy(F.col("item").alias("lhs"), F.col("entity_id").alias("rhs")).agg(F.avg("value").alias("estimate"), F.sqrt(F.var_samp("value") / F.count(F.lit(1))).alias("se"))


def items_by_entities(s, d):
    """A specification for each entity and each of three items, of which the last has no results."""
    return X.entities(s, d).select(F.explode(F.array(*map(F.lit, "abc"))).alias("lhs"), F.col("entity_id").alias("rhs"), "grp", "name")


@query("rs_9_result_grid", with_("vi entities", f", {CELL_MEANS} SELECT g.lhs || ':' || g.rhs AS cell, g.lhs, g.rhs, m.estimate, m.se FROM (SELECT unnest(['a', 'b', 'c']) AS lhs, entity_id AS rhs FROM entities) g LEFT JOIN m USING (lhs, rhs)"), d="estimate se")
def _(s, d):
    grid = items_by_entities(s, d).select(F.concat_ws(":", "lhs", F.col("rhs").cast("string")).alias("cell"), "lhs", "rhs")
    return S.result_grid(grid, cell_means(s, d), ["lhs", "rhs"], "cell", 100.0)


@query("rs_9_wide_table", with_("vi entities", f", {CELL_MEANS}, w AS (SELECT grp AS panel, name AS \"row\", m.lhs AS c, m.estimate, m.se FROM entities LEFT JOIN m ON m.rhs = entity_id) SELECT panel, \"row\", line, max(CASE WHEN c = 'a' THEN CASE WHEN line = 'estimate' THEN estimate ELSE se END END) AS a, max(CASE WHEN c = 'b' THEN CASE WHEN line = 'estimate' THEN estimate ELSE se END END) AS b, CAST(NULL AS DOUBLE) AS c FROM w, (SELECT unnest(['estimate', 'se']) AS line) GROUP BY ALL"), d="a b c")
def _(s, d):
    """The same as a table: a panel for each group, a line of estimates and one of standard errors for each entity, a column for each item."""
    spec = items_by_entities(s, d).select(F.col("grp").alias("panel"), F.col("name").alias("row"), F.col("lhs").alias("column"), "lhs", "rhs")
    return S.result_table(spec, cell_means(s, d), ["lhs", "rhs"], list("abc"), 100.0)


@query("rs_10_appendix", with_("items vi entities", """, m AS (SELECT entity_id, item, avg(6.0 - value) AS est, sqrt(var_samp(value) / count(*)) AS se FROM vi GROUP BY 1, 2), k AS (SELECT entity_id, count(*) AS shown, avg(CAST(value = -1 AS DOUBLE)) AS dk FROM items WHERE item = 'a' GROUP BY 1)
SELECT e.name, max(CASE WHEN item = 'a' THEN est END) AS a_est, max(CASE WHEN item = 'a' THEN se END) AS a_se, max(CASE WHEN item = 'b' THEN est END) AS b_est, max(CASE WHEN item = 'b' THEN se END) AS b_se, max(shown) AS shown, max(dk) AS dk
FROM m JOIN entities e USING (entity_id) JOIN k USING (entity_id) GROUP BY e.name"""), d="a_est a_se b_est b_se dk", i="shown")
def _(s, d):
    it = X.items(s, d)
    m = X.valid(it).groupBy("entity_id", "item").agg(F.avg(6.0 - F.col("value")).alias("est"), F.sqrt(F.var_samp("value") / F.count(F.lit(1))).alias("se"))
    w = S.spread(m, ["entity_id"], "item", {"est": F.col("est"), "se": F.col("se")}, ["a", "b"])
    k = it.where("item = 'a'").groupBy("entity_id").agg(F.count(F.lit(1)).alias("shown"), F.avg((F.col("value") == -1).cast("double")).alias("dk"))
    return w.join(k, "entity_id").join(X.entities(s, d).select("entity_id", "name"), "entity_id").drop("entity_id").orderBy(F.desc("a_est"))


@query("jn_1_checked_left", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def _(s, d):
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return J.checked_join(table(s, d, "supplier").select("s_suppkey", "s_nationkey"), n, ["s_nationkey"]).drop("s_nationkey")


@query("jn_2_outer_source", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'both' END AS source FROM (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity > 49) a FULL JOIN (SELECT s_suppkey AS k FROM supplier WHERE s_acctbal > 0) b ON a.k = b.k")
def _(s, d):
    a = table(s, d, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("k")).distinct()
    return J.outer_with_source(a, table(s, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("k")), ["k"])


@query("jn_3_inner", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(s, d):
    n, r = table(s, d, "nation"), table(s, d, "region")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_name", "r_name")


@query("jn_4_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(s, d):
    return J.unmatched(table(s, d, "customer").select("c_custkey"), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("jn_5_semi", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def _(s, d):
    return table(s, d, "part").select("p_partkey").join(table(s, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")


@query("jn_6_rater_pairs", with_("vr", "SELECT a.entity_id AS i, b.entity_id AS j, count(*) AS n FROM vr a JOIN vr b ON a.resp_id = b.resp_id AND a.entity_id < b.entity_id GROUP BY 1, 2"), i="n")
def _(s, d):
    return J.rater_pairs(X.valid(X.ratings(s, d)), ["resp_id"], "entity_id").groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))


@query("jn_7_ordered_pairs", with_("vr", "SELECT a.arm, a.entity_id AS i, count(*) AS n, sum(CAST(a.value < b.value AS INTEGER)) AS wins FROM vr a JOIN vr b ON a.resp_id = b.resp_id AND a.arm = b.arm AND a.entity_id <> b.entity_id AND b.entity_id NOT IN (1, 2, 3) AND a.value <> b.value GROUP BY 1, 2"), i="n wins")
def _(s, d):
    p = J.rater_pairs(X.valid(X.ratings(s, d)), ["resp_id", "arm"], "entity_id", ["value"], ordered=True)
    return p.where("j not in (1, 2, 3) and value_i <> value_j").groupBy("arm", "i").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("value_i") < F.col("value_j")).cast("int")).alias("wins"))


DIM_SQL = "SELECT min(p_partkey) AS id, p_name AS name FROM part GROUP BY p_name"


def names_dim(s, d):
    return table(s, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))


_TIERED = f"f AS ({TIERS_SQL.format(id='p_partkey', src=DIRTY_SQL)}), t AS ({TIERS_SQL.format(id='id', src=DIM_SQL)}), u AS (SELECT tier, key, min(id) AS id FROM (SELECT DISTINCT tier, key, id FROM t WHERE key <> '') GROUP BY 1, 2 HAVING count(*) = 1)"


@query("jn_8_cascade", f"WITH {_TIERED} SELECT p_partkey, min(tier) AS tier, arg_min(id, tier) AS id FROM f JOIN u USING (tier, key) GROUP BY p_partkey", i="tier id")
def _(s, d):
    keys = C.name_keys(F.col("name"))
    return J.cascade_match(dirty(s, d), "p_partkey", keys, names_dim(s, d), "id", keys)


def _one_to_one_sql() -> str:
    steps, taken = [], []
    for t in range(1, 8):
        free = "".join(f" AND f.p_partkey NOT IN (SELECT p_partkey FROM s{k}) AND u.id NOT IN (SELECT id FROM s{k})" for k in taken)
        steps.append(f"s{t} AS (SELECT min(f.p_partkey) AS p_partkey, {t} AS tier, u.id FROM f JOIN u ON f.tier = {t} AND u.tier = {t} AND f.key = u.key{free} GROUP BY u.id)")
        taken.append(t)
    return f"WITH {_TIERED}, {', '.join(steps)} " + " UNION ALL ".join(f"SELECT p_partkey, tier, id FROM s{t}" for t in taken)


@query("jn_9_cascade_one_to_one", _one_to_one_sql(), i="tier id")
def _(s, d):
    keys = C.name_keys(F.col("name"))
    return J.cascade_one_to_one(dirty(s, d), "p_partkey", keys, names_dim(s, d), "id", keys)


@query("jn_10_alternative_fields", "SELECT c_custkey, coalesce(a.s_suppkey, b.s_suppkey) AS s_suppkey, CASE WHEN a.s_suppkey IS NOT NULL THEN 'first' WHEN b.s_suppkey IS NOT NULL THEN 'second' END AS field FROM customer LEFT JOIN supplier a ON 3 * a.s_suppkey = c_custkey LEFT JOIN supplier b ON CASE WHEN b.s_suppkey % 2 = 0 THEN 3 * b.s_suppkey ELSE 3 * b.s_suppkey + 1 END = c_custkey")
def _(s, d):
    """Suppliers under two fields, which even ones have the same key in: the first field counts."""
    key = 3 * F.col("s_suppkey")
    dim = table(s, d, "supplier").select("s_suppkey", key.alias("first"), F.when(F.col("s_suppkey") % 2 == 0, key).otherwise(key + 1).alias("second"))
    return J.alternative_match(table(s, d, "customer").select("c_custkey"), "c_custkey", dim, "s_suppkey", ["first", "second"])


@query("jn_11_match_flag", "SELECT c_custkey, o.k IS NOT NULL AS matched FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 200000) o ON c_custkey = o.k")
def _(s, d):
    o = table(s, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("k")).distinct()
    c = table(s, d, "customer").select("c_custkey")
    return c.join(o, c.c_custkey == o.k, "left").select("c_custkey", F.col("k").isNotNull().alias("matched"))


@query("jn_12_overlap", with_("positions", "SELECT company, count(*) AS n FROM positions WHERE startdate <= DATE '1997-12-31' AND (enddate IS NULL OR enddate >= DATE '1997-01-01') GROUP BY company"), i="n")
def _(s, d):
    return J.overlapping(X.positions(s, d), "startdate", "enddate", F.lit("1997-01-01").cast("date"), F.lit("1997-12-31").cast("date")).groupBy("company").agg(F.count(F.lit(1)).alias("n"))


@query("jn_12_interval_join", with_("positions", ", a AS (SELECT company, user_id, startdate AS s, greatest(enddate, startdate) AS e, line FROM positions WHERE enddate IS NOT NULL) SELECT x.company, count(*) AS n FROM a x JOIN a y ON x.company = y.company AND x.line = 2 AND y.line = 3 AND x.s <= y.e AND y.s <= x.e GROUP BY 1"), i="n")
def _(s, d):
    p = X.positions(s, d).where("enddate is not null").select("company", F.col("startdate").alias("start"), F.greatest("enddate", "startdate").alias("end"), "line")
    return J.interval_join(p.where("line = 2").drop("line"), p.where("line = 3").drop("line"), ["company"]).groupBy("company").agg(F.count(F.lit(1)).alias("n"))


@query("jn_13_inherit", "WITH m AS (SELECT l_suppkey AS source, avg(l_quantity) AS q FROM lineitem GROUP BY 1), l AS (SELECT s_suppkey AS entity, s_suppkey AS source FROM supplier UNION SELECT s_suppkey, s_suppkey - s_suppkey % 5 FROM supplier WHERE s_suppkey % 2 = 1) SELECT entity, source, q FROM l JOIN m USING (source)", d="q")
def _(s, d):
    own = table(s, d, "supplier").select(F.col("s_suppkey").alias("entity"))
    parents = own.where("entity % 2 = 1").select("entity", (F.col("entity") - F.col("entity") % 5).alias("source"))
    return J.inherited(own, parents, table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("source")).agg(F.avg("l_quantity").alias("q")), "entity", "source")


@query("jn_14_unordered_pairs", "SELECT least(l_suppkey, l_partkey % 100) AS lo, greatest(l_suppkey, l_partkey % 100) AS hi, count(*) AS n FROM lineitem GROUP BY 1, 2", i="n")
def _(s, d):
    pairs = table(s, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 100).alias("other"))
    lo, hi = J.pair_key("l_suppkey", "other")
    return pairs.groupBy(lo.alias("lo"), hi.alias("hi")).agg(F.count(F.lit(1)).alias("n"))


@query("jn_15_both_variances", with_("vi", ", v AS (SELECT item, arm, var_samp(value) AS v FROM vi GROUP BY 1, 2) SELECT c.arm, 'a' AS lhs, 'b' AS rhs, x.v AS v1, y.v AS v2 FROM (SELECT DISTINCT arm FROM vi) c JOIN v x ON x.arm = c.arm AND x.item = 'a' JOIN v y ON y.arm = c.arm AND y.item = 'b'"), d="v1 v2")
def _(s, d):
    var = X.valid(X.items(s, d)).groupBy("item", "arm").agg(F.var_samp("value").alias("v"))
    cov = var.select("arm").distinct().select("arm", F.lit("a").alias("lhs"), F.lit("b").alias("rhs"))
    return J.with_both_variances(cov, var, ["arm"], ["v"])


@query("jn_16_shares", "WITH t AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) SELECT s_suppkey, 1.0 * n / (SELECT count(*) FROM supplier) AS share FROM supplier JOIN t USING (s_nationkey)", d="share")
def _(s, d):
    sup = table(s, d, "supplier").select("s_suppkey", "s_nationkey")
    total = sup.agg(F.count(F.lit(1)).alias("all"))
    shares = sup.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total)).select("s_nationkey", (F.col("n") / F.col("all")).alias("share"))
    J.require_empty(J.unmatched(sup, shares, ["s_nationkey"]), "a group has no share")
    return J.checked_join(sup, shares, ["s_nationkey"]).drop("s_nationkey")


@query("jn_17_crosswalk", "SELECT n_nationkey AS a, n_regionkey AS bin FROM nation")
def _(s, d):
    n = table(s, d, "nation")
    first = n.select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("b")).union(n.where("n_nationkey % 4 = 0").select("n_nationkey", F.lit(99)))
    second = table(s, d, "region").select(F.col("r_regionkey").alias("b"), F.col("r_regionkey").alias("bin")).union(s.range(1).select(F.lit(99), F.lit(77)))
    return J.crosswalk(first, second, n.select(F.col("n_nationkey").alias("a"), F.lit(77).alias("bin")))


@query("jn_18_patched_codes", "SELECT p_partkey, n_name FROM (SELECT p_partkey, CASE WHEN p_size = 50 THEN '0' ELSE CAST(p_size % 25 AS VARCHAR) END AS code FROM part) JOIN nation ON CAST(n_nationkey AS VARCHAR) = code")
def _(s, d):
    p = table(s, d, "part").select("p_partkey", F.regexp_replace(F.concat(F.when(F.col("p_size") == 50, "x0").otherwise((F.col("p_size") % 25).cast("string")), F.lit(".0")), r"^x|\.0$", "").alias("code"))
    n = table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("code"), "n_name")
    return p.join(F.broadcast(n), "code").drop("code")
