"""Queries of aggregates (AG)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import aggregates as A
from rankloom.sources import fixtures as X
from rankloom.sources.fixtures import table, with_

from .registry import query


@query("ag_1_entity_means", with_("vi", "SELECT item, entity_id, count(*) AS n, avg(value) AS mean, var_samp(value) AS var, coalesce(var_samp(value) * (count(*) - 1), 0) AS rss, sqrt(var_samp(value) / count(*)) AS se FROM vi GROUP BY 1, 2"), d="mean var rss se", i="n")
def _(s, d):
    return A.entity_means(X.valid(X.items(s, d)), ["item", "entity_id"], "value")


@query("ag_2_three_answers", with_("vi", "SELECT item, resp_id, entity_id FROM (SELECT *, count(*) OVER (PARTITION BY item, resp_id) AS k FROM vi) WHERE k > 2"))
def _(s, d):
    return A.raters_with_more(X.valid(X.items(s, d)), ["item", "resp_id"]).select("item", "resp_id", "entity_id")


@query("ag_3_no_repeats", with_("rating_rows", "SELECT resp_id, entity_id, value FROM rating_rows WHERE resp_id NOT IN (SELECT resp_id FROM rating_rows GROUP BY resp_id, entity_id HAVING count(*) > 1)"))
def _(s, d):
    return A.without_repeating_raters(X.rating_rows(s, d), ["resp_id"], "entity_id").select("resp_id", "entity_id", "value")


LINERS = "SELECT resp_id FROM (SELECT resp_id, item, count(DISTINCT value) AS k FROM vi GROUP BY 1, 2 HAVING count(*) > 2) GROUP BY resp_id HAVING max(k) = 1"


@query("ag_4_straight_liners", with_("vi", LINERS))
def _(s, d):
    return A.straight_liners(X.valid(X.items(s, d)), "resp_id", "item", "value")


@query("ag_5_analysis_raters", with_("vi", f"SELECT DISTINCT resp_id FROM (SELECT resp_id, item FROM vi GROUP BY 1, 2 HAVING count(*) > 2) WHERE resp_id NOT IN ({LINERS})"))
def _(s, d):
    return A.analysis_raters(X.valid(X.items(s, d)), "resp_id", "item", "entity_id", "value")


@query("ag_6_mode", "SELECT p_brand, n, p_size, ties FROM (SELECT p_brand, p_size, count(*) AS n, count(*) OVER (PARTITION BY p_brand, count(*)) AS ties, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_size) AS r FROM part GROUP BY 1, 2) WHERE r = 1", i="n ties p_size")
def _(s, d):
    return A.mode(table(s, d, "part"), ["p_brand"], "p_size")


@query("ag_7_best_key", "SELECT l_suppkey, n, key FROM (SELECT l_suppkey, l_returnflag || l_linestatus AS key, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_returnflag || l_linestatus) AS r FROM lineitem GROUP BY 1, 2) WHERE r = 1", i="n")
def _(s, d):
    return A.mode(table(s, d, "lineitem").select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("key")), ["l_suppkey"], "key").select("l_suppkey", "n", "key")


@query("ag_8_collapse_workers", with_("positions", "SELECT company, user_id, avg(CASE WHEN salary > 0 THEN salary END) AS salary, avg(weight) AS weight, count(DISTINCT line) AS lines, count(*) FILTER (WHERE enddate IS NULL) AS open_jobs FROM positions GROUP BY 1, 2"), d="salary weight", i="lines open_jobs")
def _(s, d):
    return A.collapse_workers(X.positions(s, d), ["company", "user_id"])


@query("ag_9_probability_shares", with_("positions", "SELECT company, sum(weight * p) / nullif(sum(weight), 0) AS share_f, sum(weight * salary * p) / nullif(sum(weight * p), 0) AS mean_f, sum(weight * (1 - p)) / nullif(sum(weight), 0) AS share_m, sum(weight * salary * (1 - p)) / nullif(sum(weight * (1 - p)), 0) AS mean_m FROM (SELECT *, (user_id % 100) / 100.0::DOUBLE AS p FROM positions) GROUP BY 1"), d="share_f mean_f share_m mean_m")
def _(s, d):
    p = (F.col("user_id") % 100) / 100.0
    return A.probability_shares(X.positions(s, d), "company", "weight", "salary", {"f": p, "m": 1.0 - p})


@query("ag_10_reviews", with_("reviews", "SELECT company, avg(score) AS score, count(*) AS n FROM reviews WHERE lower(trim(status)) IN ('click', 'purchase') AND score BETWEEN 1 AND 5 GROUP BY 1"), d="score", i="n")
def _(s, d):
    kept = X.reviews(s, d).where(F.lower(F.trim("status")).isin("click", "purchase") & F.col("score").between(1, 5))
    return kept.groupBy("company").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n"))


@query("ag_11_part_of_total", "SELECT s_nationkey, sum(CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END) / nullif(sum(s_acctbal), 0) AS share FROM supplier GROUP BY 1", d="share")
def _(s, d):
    return table(s, d, "supplier").groupBy("s_nationkey").agg(F.try_divide(F.sum(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal"))), F.sum("s_acctbal")).alias("share"))


@query("ag_12_strict_row_sum", with_("raters", "SELECT resp_id, auto + rich + odd AS total FROM raters"))
def _(s, d):
    return X.raters(s, d).select("resp_id", (F.col("auto") + F.col("rich") + F.col("odd")).alias("total"))


@query("ag_13_weighted_group_mean", with_("entities external", "SELECT grp, sum(disc * weight) / nullif(sum(CASE WHEN disc IS NOT NULL THEN weight END), 0) AS weighted, avg(disc) AS equal, sum(weight) AS total FROM entities LEFT JOIN external USING (entity_id) GROUP BY 1"), d="weighted equal total")
def _(s, d):
    j = X.entities(s, d).join(X.external(s, d), "entity_id", "left")
    return j.groupBy("grp").agg(A.weighted_mean("disc", "weight").alias("weighted"), F.avg("disc").alias("equal"), F.sum("weight").alias("total"))


@query("ag_14_distribution", "WITH b AS (SELECT 'all' AS split, * FROM customer UNION ALL SELECT CAST(c_nationkey % 2 AS VARCHAR), * FROM customer), l AS (SELECT split, 'c_mktsegment' AS variable, c_mktsegment AS category FROM b UNION ALL SELECT split, 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM b) SELECT split, variable, category, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY split, variable) AS share FROM l GROUP BY 1, 2, 3", d="share", i="n")
def _(s, d):
    return A.distribution(table(s, d, "customer").withColumn("half", F.col("c_nationkey") % 2), ["c_mktsegment", "c_nationkey"], "half")


@query("ag_15_confident_raters", with_("vr", "SELECT segment, count(*) AS n FROM (SELECT resp_id FROM vr GROUP BY resp_id HAVING count(*) >= 3 AND max(value) > min(value)) JOIN (SELECT c_custkey AS resp_id, c_mktsegment AS segment FROM customer) USING (resp_id) GROUP BY 1"), i="n")
def _(s, d):
    ok = X.valid(X.ratings(s, d)).groupBy("resp_id").agg(F.count(F.lit(1)).alias("n"), (F.max("value") - F.min("value")).alias("range")).where("n >= 3 and range > 0")
    return X.raters(s, d).join(ok, "resp_id", "left_semi").groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


@query("ag_16_clustered_shares", with_("vr", ", p AS (SELECT resp_id, k AS answer, avg(CAST(value = k AS DOUBLE)) AS share FROM vr CROSS JOIN (SELECT unnest(range(1, 6)) AS k) GROUP BY 1, 2), m AS (SELECT CAST(answer AS VARCHAR) AS answer, avg(share) AS mean, stddev_samp(share) / sqrt(count(*)) AS se FROM p GROUP BY 1) SELECT *, mean - 1.96 * se AS low, mean + 1.96 * se AS high FROM m"), d="mean se low high")
def _(s, d):
    return A.clustered_shares(X.valid(X.ratings(s, d)), "resp_id", "value", range(1, 6))


@query("ag_17_proportions", with_("raters", ", m AS (SELECT segment, avg(rich) AS p, count(rich) AS n FROM raters GROUP BY 1), e AS (SELECT *, sqrt(p * (1 - p) / n) AS se FROM m) SELECT segment, p, n, se, greatest(0, p - 1.96 * se) AS low, least(1, p + 1.96 * se) AS high FROM e"), d="p se low high", i="n")
def _(s, d):
    return A.proportion(X.raters(s, d), ["segment"], "rich")


@query("ag_18_option_shares", "SELECT event_type AS option, count(DISTINCT user_id) / CAST((SELECT count(DISTINCT user_id) FROM events) AS DOUBLE) AS share FROM events GROUP BY 1", d="share")
def _(s, d):
    lists = table(s, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("options"))
    return A.option_shares(lists, "user_id", "options")


@query("ag_19_histogram", "SELECT floor(l_quantity / 5.0) * 5.0 AS start, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM lineitem GROUP BY 1", d="start share", i="n")
def _(s, d):
    return A.histogram(table(s, d, "lineitem"), "l_quantity", 5.0)


@query("ag_19_quartiles", "SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS q2, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem", d="q1 q2 q3")
def _(s, d):
    one = table(s, d, "lineitem").select(F.lit(0).alias("all"), "l_extendedprice")
    found = A.percentiles(one, ["all"], "l_extendedprice", {f"q{q}": q / 4 for q in (1, 2, 3)}).drop("all")
    return s.range(1).join(found, F.lit(True), "left").drop("id")  # a row of nulls for an empty table


@query("ag_20_dont_know", with_("ratings", "SELECT entity_id, count(*) AS asked, sum(CAST(value = -1 AS INTEGER)) AS dk, avg(CAST(value = -1 AS DOUBLE)) AS share, count(DISTINCT arm) AS arms FROM ratings GROUP BY 1"), d="share", i="asked dk arms")
def _(s, d):
    dk = F.col("value") == -1
    return X.ratings(s, d).groupBy("entity_id").agg(F.count(F.lit(1)).alias("asked"), F.count_if(dk).alias("dk"), F.avg(dk.cast("double")).alias("share"), F.count_distinct("arm").alias("arms"))


@query("ag_21_frequency_table", "SELECT p_size, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS percent, 100.0 * sum(count(*)) OVER (ORDER BY p_size) / sum(count(*)) OVER () AS cumulative FROM part GROUP BY 1", d="percent cumulative", i="n")
def _(s, d):
    return A.frequency_table(table(s, d, "part"), "p_size")


@query("ag_22_valid_members", with_("entities external", "SELECT grp, avg(disc) FILTER (WHERE weight IS NOT NULL) AS share, count(disc) FILTER (WHERE weight IS NOT NULL) AS members FROM entities LEFT JOIN external USING (entity_id) GROUP BY 1"), d="share", i="members")
def _(s, d):
    ok = F.when(F.col("weight").isNotNull(), F.col("disc"))
    return X.entities(s, d).join(X.external(s, d), "entity_id", "left").groupBy("grp").agg(F.avg(ok).alias("share"), F.count(ok).alias("members"))


@query("ag_23_pair_correlations", "SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, count(*) AS n, corr(l_quantity, l_extendedprice) AS corr, quantile_cont(abs(l_quantity - l_extendedprice), 0.5) AS median_gap, quantile_cont(abs(l_quantity - l_extendedprice), 0.95) AS p95_gap FROM lineitem UNION ALL SELECT 'l_discount', 'l_tax', count(*), corr(l_discount, l_tax), quantile_cont(abs(l_discount - l_tax), 0.5), quantile_cont(abs(l_discount - l_tax), 0.95) FROM lineitem", d="corr median_gap p95_gap", i="n")
def _(s, d):
    return A.pair_correlations(table(s, d, "lineitem"), [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax")])


@query("ag_24_weighted_correlation", "WITH m AS (SELECT l_returnflag, sum(l_tax) s, sum(l_tax * l_quantity) sx, sum(l_tax * l_discount) sy, sum(l_tax * l_quantity * l_quantity) sxx, sum(l_tax * l_discount * l_discount) syy, sum(l_tax * l_quantity * l_discount) sxy FROM lineitem GROUP BY 1) SELECT l_returnflag, (sxy / s - sx * sy / (s * s)) / sqrt((sxx / s - sx * sx / (s * s)) * (syy / s - sy * sy / (s * s))) AS corr FROM m", d="corr")
def _(s, d):
    return A.weighted_correlation(table(s, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_discount", "l_tax")


@query("ag_25_external_table", with_("external", "SELECT entity_id, 'disc' AS item, disc AS estimate FROM external WHERE disc IS NOT NULL"), d="estimate")
def _(s, d):
    return X.external(s, d).distinct().unpivot("entity_id", ["disc"], "item", "estimate").where("estimate is not null")


@query("ag_26_group_items", with_("entities external", ", j AS (SELECT entity_id, grp, disc, avg(disc) OVER (PARTITION BY grp) AS m FROM entities JOIN external USING (entity_id) WHERE disc IS NOT NULL) SELECT entity_id, 'disc_mean' AS item, m AS estimate FROM j UNION ALL SELECT entity_id, 'disc_dev', disc - m FROM j"), d="estimate")
def _(s, d):
    from rankloom.operators.windows import weighted_demean

    j = X.entities(s, d).join(X.external(s, d), "entity_id").where("disc is not null").withColumn("one", F.lit(1.0))
    j = weighted_demean(j, ["grp"], "disc", "one", "dev")
    return j.select("entity_id", (F.col("disc") - F.col("dev")).alias("disc_mean"), F.col("dev").alias("disc_dev")).unpivot("entity_id", ["disc_mean", "disc_dev"], "item", "estimate")


@query("ag_27_preferred", "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part) WHERE r = 1")
def _(s, d):
    return A.preferred(table(s, d, "part"), ["p_brand"], "p_size").select("p_brand", "p_partkey")


@query("ag_28_subgroup_summary", with_("vi raters", ", r AS (SELECT item, odd, entity_id, avg(6.0 - value) AS m, count(DISTINCT resp_id) AS n FROM vi JOIN raters USING (resp_id) WHERE odd IS NOT NULL GROUP BY 1, 2, 3) SELECT item, odd, avg(m) AS mean, sum(n) AS ratings, stddev_pop(m) AS sd FROM r GROUP BY 1, 2"), d="mean sd", i="ratings")
def _(s, d):
    r = X.valid(X.items(s, d)).join(X.raters(s, d).select("resp_id", "odd").where("odd is not null"), "resp_id")
    m = r.groupBy("item", "odd", "entity_id").agg(F.avg(6.0 - F.col("value")).alias("m"), F.count_distinct("resp_id").alias("n"))
    return m.groupBy("item", "odd").agg(F.avg("m").alias("mean"), F.sum("n").alias("ratings"), F.stddev_pop("m").alias("sd"))


@query("ag_30_source_gaps", "WITH a AS (SELECT l_returnflag AS g, l_linenumber AS c, count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag) AS s FROM lineitem GROUP BY 1, 2), b AS (SELECT l_returnflag AS g, l_linenumber AS c, sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY l_returnflag) AS s FROM lineitem GROUP BY 1, 2) SELECT g, max(abs(a.s - b.s)) AS gap, count(*) FILTER (WHERE abs(a.s - b.s) > 0.001) AS above FROM a JOIN b USING (g, c) GROUP BY 1", d="gap", i="above")
def _(s, d):
    from rankloom.operators.windows import share_of_group

    cells = table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("g"), "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    gap = F.abs(F.col("a") - F.col("b"))
    return share_of_group(share_of_group(cells, ["g"], "n", "a"), ["g"], "q", "b").groupBy("g").agg(F.max(gap).alias("gap"), F.count_if(gap > 0.001).alias("above"))


@query("ag_31_group_shares", "WITH m AS (SELECT l_returnflag AS g, l_linestatus AS t, avg(l_quantity) AS w, sum(l_quantity * l_discount) / sum(l_quantity) AS college FROM lineitem GROUP BY 1, 2) SELECT g, t, w / sum(w) OVER (PARTITION BY t) AS emp, college FROM m", d="emp college")
def _(s, d):
    from rankloom.operators.windows import share_of_group

    m = table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.col("l_linestatus").alias("t")).agg(F.avg("l_quantity").alias("w"), A.weighted_mean("l_discount", "l_quantity").alias("college"))
    return share_of_group(m, ["t"], "w", "emp").drop("w")


@query("ag_32_top_share", "SELECT s_nationkey, sum(CASE WHEN r <= 4 THEN b END) / sum(b) AS top_share FROM (SELECT s_nationkey, abs(s_acctbal) AS b, row_number() OVER (PARTITION BY s_nationkey ORDER BY abs(s_acctbal) DESC) AS r FROM supplier) GROUP BY 1", d="top_share")
def _(s, d):
    return A.top_share(table(s, d, "supplier").withColumn("b", F.abs("s_acctbal")), ["s_nationkey"], "b")


@query("ag_33_three_levels", with_("vr", "SELECT avg(value) AS raw, (SELECT avg(m) FROM (SELECT avg(value) AS m FROM vr GROUP BY resp_id)) AS by_rater, (SELECT avg(m) FROM (SELECT avg(value) AS m FROM vr GROUP BY entity_id)) AS by_entity FROM vr"), d="raw by_rater by_entity")
def _(s, d):
    r = X.valid(X.ratings(s, d))
    one = r.agg(F.avg("value").alias("raw"))
    for key, name in (("resp_id", "by_rater"), ("entity_id", "by_entity")):
        one = one.join(F.broadcast(r.groupBy(key).agg(F.avg("value").alias("m")).agg(F.avg("m").alias(name))))
    return one


@query("ag_34_eligible_raters", with_("vi", f"SELECT 'any_answer' AS rule, count(DISTINCT resp_id) AS raters FROM vi UNION ALL SELECT 'three_answers', count(DISTINCT resp_id) FROM (SELECT resp_id FROM vi GROUP BY resp_id, item HAVING count(*) > 2) UNION ALL SELECT 'no_straight_liners', count(DISTINCT resp_id) FROM vi WHERE resp_id NOT IN ({LINERS})"), i="raters")
def _(s, d):
    return A.eligible_counts(X.valid(X.items(s, d)), "resp_id", "item", "value")
