"""Queries of windows, sorts and set operations (WN, SO, SE)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.operators import joins as J
from rankloom.operators import windows as N
from rankloom.sources import fixtures as X
from rankloom.sources.fixtures import table, with_

from .registry import query

MEANS = "m AS (SELECT item, entity_id, avg(6.0 - value) AS est FROM vi GROUP BY 1, 2)"


def means(s, d):
    return X.valid(X.items(s, d)).groupBy("item", "entity_id").agg(F.avg(6.0 - F.col("value")).alias("est"))


@query("wn_1_dense_rank", with_("vi", "SELECT item, resp_id, entity_id, dense_rank() OVER (PARTITION BY item, resp_id ORDER BY value) AS rank FROM vi"), i="rank")
def _(s, d):
    return N.ranks_within(X.valid(X.items(s, d)), ["item", "resp_id"], "value").select("item", "resp_id", "entity_id", "rank")


@query("wn_2_top_bottom", with_("vi", f", {MEANS} SELECT item, entity_id, est, 'top' AS \"end\", r AS place FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY round(est, 9) DESC, entity_id) AS r FROM m) WHERE r <= 5 UNION ALL SELECT item, entity_id, est, 'bottom', r FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY round(est, 9), entity_id) AS r FROM m) WHERE r <= 5"), d="est", i="place")
def _(s, d):
    return N.top_and_bottom(means(s, d).withColumn("est", F.round("est", 9)), ["item"], "est", "entity_id", 5)


@query("wn_3_absolute_sums", with_("vr", "SELECT a.resp_id, a.entity_id, sum(CASE WHEN b.value < a.value THEN a.value - b.value ELSE 0 END) AS left_sum, sum(CASE WHEN b.value > a.value THEN b.value - a.value ELSE 0 END) AS right_sum FROM vr a JOIN vr b ON a.resp_id = b.resp_id GROUP BY 1, 2"), i="left_sum right_sum")
def _(s, d):
    return N.absolute_sums(X.valid(X.ratings(s, d)), ["resp_id"], "value", ["entity_id"]).select("resp_id", "entity_id", "left_sum", "right_sum")


@query("wn_4_share_of_group", "SELECT s_suppkey, s_acctbal / sum(s_acctbal) OVER (PARTITION BY s_nationkey) AS share FROM supplier", d="share")
def _(s, d):
    return N.share_of_group(table(s, d, "supplier"), ["s_nationkey"], "s_acctbal").select("s_suppkey", "share")


@query("wn_5_weighted_demean", with_("entities external", "SELECT entity_id, disc - sum(disc * weight) OVER (PARTITION BY grp) / sum(weight) OVER (PARTITION BY grp) AS dev FROM entities JOIN external USING (entity_id) WHERE disc IS NOT NULL AND weight IS NOT NULL"), d="dev")
def _(s, d):
    j = X.entities(s, d).join(X.external(s, d), "entity_id").where("disc is not null and weight is not null")
    return N.weighted_demean(j, ["grp"], "disc", "weight", "dev").select("entity_id", "dev")


@query("wn_6_distinct_on", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS r FROM events) WHERE r = 1")
def _(s, d):
    return J.first_match_by_row(table(s, d, "events"), ["user_id"], [F.col("value").desc_nulls_last(), F.col("event_id")]).select("user_id", "event_id")


@query("wn_7_z_score", "SELECT p_partkey, (p_size - avg(p_size) OVER (PARTITION BY p_brand)) / nullif(stddev_samp(p_size) OVER (PARTITION BY p_brand), 0) AS z FROM part", d="z")
def _(s, d):
    return table(s, d, "part").select("p_partkey", N.z_score("p_size", ["p_brand"]).alias("z"))


@query("wn_8_rescaled", "WITH m AS (SELECT avg(l_quantity) a, stddev_samp(l_quantity) b, avg(l_discount) c, stddev_samp(l_discount) e FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, c + (l_quantity - a) * e / b AS moved FROM lineitem, m", d="moved")
def _(s, d):
    return N.rescaled(table(s, d, "lineitem"), "l_quantity", "l_discount", "moved").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "moved")


@query("wn_9_first_per_key", "SELECT p_brand, p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size, p_partkey) AS r FROM part) WHERE r = 1")
def _(s, d):
    return J.first_match_by_row(table(s, d, "part"), ["p_brand", "p_type"], [F.col("p_size"), F.col("p_partkey")]).select("p_brand", "p_type", "p_partkey")


@query("wn_10_inconstant", "SELECT o_custkey, min(o_orderstatus) AS low, max(o_orderstatus) AS high FROM orders GROUP BY 1 HAVING min(o_orderstatus) <> max(o_orderstatus)")
def _(s, d):
    return N.inconstant_keys(table(s, d, "orders"), ["o_custkey"], "o_orderstatus")


@query("wn_11_permuted_ids")
def _(s, d):
    return N.permuted_ids(X.entities(s, d), "entity_id", 42, "placebo_id")


@query("wn_12_any_within", with_("ratings", "SELECT resp_id, entity_id, max(CAST(value = -1 AS INTEGER)) OVER (PARTITION BY resp_id) AS any_dk FROM ratings"))
def _(s, d):
    return X.ratings(s, d).select("resp_id", "entity_id", F.max((F.col("value") == -1).cast("int")).over(W.partitionBy("resp_id")).alias("any_dk"))


@query("so_1_nulls_last", with_("raters", "SELECT resp_id, odd FROM raters ORDER BY odd NULLS LAST, resp_id"))
def _(s, d):
    return X.raters(s, d).select("resp_id", "odd").orderBy(F.col("odd").asc_nulls_last(), "resp_id")


@query("so_2_display_order", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1", i="n")
def _(s, d):
    order = F.array_position(F.array(*map(F.lit, ("HOUSEHOLD", "BUILDING", "AUTOMOBILE", "MACHINERY", "FURNITURE"))), F.col("c_mktsegment"))
    return table(s, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).orderBy(order, "c_mktsegment")


DK = "k AS (SELECT entity_id, avg(CAST(value = -1 AS DOUBLE)) AS dk FROM ratings GROUP BY 1)"


@query("so_3_without_top_ten", with_("ratings", f", {DK} SELECT entity_id FROM k WHERE entity_id NOT IN (SELECT entity_id FROM k ORDER BY dk DESC, entity_id LIMIT 10)"))
def _(s, d):
    k = X.ratings(s, d).groupBy("entity_id").agg(F.avg((F.col("value") == -1).cast("double")).alias("dk"))
    return k.join(k.orderBy(F.desc("dk"), "entity_id").limit(10), "entity_id", "left_anti").select("entity_id")


@query("se_1_union_by_name", "SELECT s_suppkey AS id, s_name AS name, NULL AS size FROM supplier UNION ALL SELECT p_partkey, NULL, p_size FROM part", i="size")
def _(s, d):
    a = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return a.unionByName(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size")), allowMissingColumns=True)


@query("se_2_union_distinct", "SELECT l_suppkey AS id FROM lineitem UNION SELECT s_suppkey FROM supplier")
def _(s, d):
    return table(s, d, "lineitem").select(F.col("l_suppkey").alias("id")).union(table(s, d, "supplier").select("s_suppkey")).distinct()


@query("se_3_intersect", "SELECT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders")
def _(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("id")).intersect(table(s, d, "orders").select("o_custkey"))


@query("se_4_difference", "SELECT k AS c_custkey, side FROM (SELECT c_custkey AS k, 'left' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'right' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))")
def _(s, d):
    from rankloom.operators.quality import key_difference

    return key_difference(table(s, d, "customer"), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("se_5_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def _(s, d):
    return table(s, d, "part").select("p_brand", "p_type").distinct()


@query("se_6_item_pairs", "SELECT a.s AS lhs, b.s AS rhs FROM (SELECT DISTINCT c_mktsegment AS s FROM customer) a JOIN (SELECT DISTINCT c_mktsegment AS s FROM customer) b ON a.s < b.s")
def _(s, d):
    items = table(s, d, "customer").select(F.col("c_mktsegment").alias("lhs")).distinct()
    return items.join(F.broadcast(items.withColumnRenamed("lhs", "rhs")), F.col("lhs") < F.col("rhs"))
