"""Queries of recodes, filters and scalar functions (PR, FN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions import columns as C
from rankloom.operators import recode as R
from rankloom.sources import fixtures as X
from rankloom.sources.fixtures import table, with_

from .registry import query


@query("pr_1_rename", "SELECT c_custkey AS resp_id, c_name AS firm_1, c_mktsegment AS firm_2 FROM customer")
def _(s, d):
    df = table(s, d, "customer").select("c_custkey", F.col("c_name").alias("q_1"), F.col("c_mktsegment").alias("q_2"))
    return R.rename_families(df, {"c_custkey": "resp_id"}, {"q": "firm"}, (1, 2))


PRIORITY = {"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 3, "4-NOT SPECIFIED": 2, "5-LOW": 1}
PRIORITY_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 2 WHEN '5-LOW' THEN 1 END"


@query("pr_2_label_code", f"SELECT o_orderkey, CAST({PRIORITY_SQL} AS INTEGER) AS code FROM orders")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", C.label_code(F.col("o_orderpriority"), PRIORITY).alias("code"))


@query("pr_3_reverse_code", with_("ratings", "SELECT resp_id, entity_id, CASE WHEN value BETWEEN 1 AND 5 THEN 6 - value ELSE value END AS value FROM ratings"))
def _(s, d):
    return X.ratings(s, d).select("resp_id", "entity_id", C.reverse_code(F.col("value")).alias("value"))


@query("pr_4_combine_framings", with_("ratings ratings_b", "SELECT a.resp_id, a.entity_id, CASE WHEN a.value BETWEEN 1 AND 5 THEN a.value WHEN b.value BETWEEN 1 AND 5 THEN 6 - b.value ELSE b.value END AS value FROM ratings a JOIN ratings_b b ON a.resp_id = b.resp_id AND a.entity_id = b.entity_id"))
def _(s, d):
    a, b = X.ratings(s, d), X.ratings(s, d, "b").select("resp_id", "entity_id", F.col("value").alias("second"))
    return a.join(b, ["resp_id", "entity_id"]).select("resp_id", "entity_id", C.combine_framings(F.col("value"), F.col("second")).alias("value"))


@query("pr_5_sentinels", with_("ratings", "SELECT resp_id, entity_id, nullif(value, -1) AS value, nullif(CAST(value AS VARCHAR), '-1') AS words FROM ratings"))
def _(s, d):
    return R.sentinels_to_null(X.ratings(s, d).select("resp_id", "entity_id", "value", F.col("value").cast("string").alias("words")))


@query("pr_6_pool_arms", with_("ratings ratings_b", "SELECT a.resp_id, a.entity_id, coalesce(nullif(a.value, -1), nullif(b.value, -1)) AS pooled FROM ratings a JOIN ratings_b b ON a.resp_id = b.resp_id AND a.entity_id = b.entity_id"))
def _(s, d):
    a, b = X.ratings(s, d), X.ratings(s, d, "b").select("resp_id", "entity_id", F.col("value").alias("other"))
    return a.join(b, ["resp_id", "entity_id"]).select("resp_id", "entity_id", C.pool(F.col("value"), F.col("other")).alias("pooled"))


@query("pr_7_ordinal_flag", f"SELECT o_orderkey, CAST(coalesce({PRIORITY_SQL} > 3, o_orderstatus = 'F') AS INTEGER) AS confident FROM orders")
def _(s, d):
    o = table(s, d, "orders")
    return o.select("o_orderkey", F.coalesce(C.label_code(F.col("o_orderpriority"), PRIORITY) > 3, F.col("o_orderstatus") == "F").cast("int").alias("confident"))


@query("pr_8_flags", with_("raters", "SELECT resp_id, CASE WHEN odd IS NULL THEN NULL WHEN odd = 1 THEN 1 ELSE 0 END AS is_odd, CASE WHEN odd IN (1, 3) THEN 1 ELSE 0 END AS in_set FROM raters"))
def _(s, d):
    return X.raters(s, d).select("resp_id", C.binary_flag(F.col("odd"), 1).alias("is_odd"), C.member_flag(F.col("odd"), (1, 3)).alias("in_set"))


@query("pr_9_surrogate_ids", "SELECT s_suppkey, dense_rank() OVER (ORDER BY s_name) AS firm_id FROM supplier", i="firm_id")
def _(s, d):
    return R.surrogate_ids(table(s, d, "supplier").select("s_suppkey", "s_name"), "s_name", "firm_id").select("s_suppkey", "firm_id")


@query("pr_10_median_split", with_("ratings raters", ", j AS (SELECT r.resp_id, r.entity_id, p.balance FROM ratings r JOIN raters p ON r.resp_id = p.resp_id) SELECT resp_id, entity_id, CASE WHEN balance > (SELECT median(balance) FROM (SELECT DISTINCT resp_id, balance FROM j)) THEN 1 ELSE 0 END AS high FROM j"))
def _(s, d):
    j = X.ratings(s, d).join(X.raters(s, d).select("resp_id", "balance"), "resp_id").select("resp_id", "entity_id", "balance")
    return R.median_split(j, "resp_id", "balance", "high").drop("balance")


@query("pr_11_attention", """SELECT p_partkey, CAST((contains(t, b1) = (b1 IN (p_brand, p_type))) AS DOUBLE) / 2 + CAST((contains(t, b2) = (b2 IN (p_brand, p_type))) AS DOUBLE) / 2 AS attention_score
FROM (SELECT *, CASE WHEN p_size % 7 <> 0 THEN concat(p_brand, ' ', p_name) END AS t, 'Brand#1' AS b1, 'PROMO' AS b2 FROM part) WHERE t IS NOT NULL AND ((contains(t, b1) = (b1 IN (p_brand, p_type))) AND (contains(t, b2) = (b2 IN (p_brand, p_type))))""", d="attention_score")
def _(s, d):
    p = table(s, d, "part").withColumn("t", F.when(F.col("p_size") % 7 != 0, F.concat_ws(" ", "p_brand", "p_name"))).withColumns({"b1": F.lit("Brand#1"), "b2": F.lit("PROMO")})
    return R.attention_score(p, ("p_brand", "p_type"), ("b1", "b2"), "t").where("attention_score = 1").select("p_partkey", "attention_score")


@query("pr_12_override", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE 'new' END ELSE c_mktsegment END AS c_mktsegment FROM customer")
def _(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_mktsegment")
    extra = c.where("c_custkey % 5 = 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 10 != 0, "new"))
    return R.override(c, extra, "c_custkey", ["c_mktsegment"])


@query("pr_13_append_newer", "WITH b AS (SELECT event_id, ts, event_type FROM events WHERE hour(ts) < 20 AND event_id % 10 < 9 AND day(ts) < 20) SELECT event_id, event_type FROM b UNION ALL SELECT event_id, NULL FROM events WHERE ts > (SELECT max(ts) FROM b)")
def _(s, d):
    e = table(s, d, "events").select("event_id", "ts", "event_type")
    base = e.where("hour(ts) < 20 and event_id % 10 < 9 and day(ts) < 20")
    return R.append_newer(base, e.drop("event_type"), "ts").select("event_id", "event_type")


@query("pr_14_corrected_square", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * l_discount - l_tax * l_tax AS sq FROM lineitem", d="sq")
def _(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C.corrected_square(F.col("l_discount"), F.col("l_tax")).alias("sq"))


@query("pr_15_log_gap", "SELECT s_suppkey, CASE WHEN s_acctbal > 0 AND s_nationkey > 0 THEN ln(s_acctbal) - ln(CAST(s_nationkey AS DOUBLE)) END AS gap FROM supplier", d="gap")
def _(s, d):
    return table(s, d, "supplier").select("s_suppkey", C.log_gap(F.col("s_acctbal"), F.col("s_nationkey").cast("double")).alias("gap"))


@query("pr_16_half_open_bins", "SELECT p_partkey, CASE WHEN p_size >= 1 AND p_size < 10 THEN 'low' WHEN p_size >= 10 AND p_size < 30 THEN 'mid' WHEN p_size >= 30 AND p_size < 50 THEN 'high' END AS bin FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", C.half_open_bin(F.col("p_size"), (1, 10, 30, 50), ("low", "mid", "high")).alias("bin"))


@query("pr_17_code_bands", "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 12 THEN 1 WHEN p_size BETWEEN 13 AND 30 THEN 2 ELSE 3 END AS band FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", C.code_band(F.col("p_size"), ((1, 12, 1), (13, 30, 2)), F.lit(3)).alias("band"))


MICRO_SQL = "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_returnflag <> 'R' AS private, l_quantity AS hours, 15 + l_partkey % 50 AS age, l_extendedprice AS earn, 90000.0 AS topcode, l_linenumber % 2 AS allocated, l_extendedprice * (1 - l_discount) / l_quantity AS hourly, l_suppkey % 3 AS hourly_allocated, l_orderkey % 4 = 0 AS college FROM lineitem"


def micro(s, d):
    return table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", (F.col("l_returnflag") != "R").alias("private"), F.col("l_quantity").alias("hours"), (15 + F.col("l_partkey") % 50).alias("age"),
        F.col("l_extendedprice").alias("earn"), F.lit(90000.0).alias("topcode"), (F.col("l_linenumber") % 2).alias("allocated"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity")).alias("hourly"), (F.col("l_suppkey") % 3).alias("hourly_allocated"), (F.col("l_orderkey") % 4 == 0).alias("college"),
    )


_WORKERS = "private AND hours >= 35 AND age BETWEEN 20 AND 60"
_UNIVERSE = f"{_WORKERS} AND earn > 0 AND earn < topcode"


@query("pr_18_universe", f"SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, ln(earn / hours) AS lnwage FROM ({MICRO_SQL}) WHERE {_UNIVERSE} AND allocated <> 0", d="lnwage")
def _(s, d):
    return R.microdata_universe(micro(s, d)).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "lnwage")


_VARIANTS = {"baseline": (f"{_UNIVERSE} AND allocated <> 0", "earn / hours"), "corrected": (f"{_UNIVERSE} AND allocated = 0", "earn / hours"), "ignore": (_UNIVERSE, "earn / hours"), "reported": (f"{_WORKERS} AND hourly_allocated = 0 AND hourly > 0", "hourly"), "shares_only": (f"{_UNIVERSE} AND allocated = 0", "earn / hours")}


@query("pr_19_variants", " UNION ALL ".join(f"SELECT '{v}' AS variant, (SELECT count(*) FROM ({MICRO_SQL}) WHERE {c}) AS n, (SELECT avg(ln({w})) FROM ({MICRO_SQL}) WHERE {c}) AS mean, (SELECT avg(CAST(college AS DOUBLE)) FROM ({MICRO_SQL}) WHERE {_WORKERS if v == 'shares_only' else c}) AS share" for v, (c, w) in _VARIANTS.items()), d="mean share", i="n")
def _(s, d):
    """All cleaning variants: number of wages, their mean, and the share of one education among the rows that shares are taken of."""
    out = None
    for v in R.CLEANING:
        wages = R.microdata_universe(micro(s, d), v).agg(F.count(F.lit(1)).alias("n"), F.avg("lnwage").alias("mean"))
        share = R.share_universe(micro(s, d), v).agg(F.avg(F.col("college").cast("double")).alias("share"))
        part = wages.crossJoin(F.broadcast(share)).select(F.lit(v).alias("variant"), "n", "mean", "share")  # one row each
        out = part if out is None else out.unionByName(part)
    return out


@query("pr_20_runs", with_("raters", "SELECT run, count(*) AS n FROM (SELECT unnest(['full', 'auto_' || auto, 'rich_' || rich, 'odd_' || odd]) AS run FROM raters) WHERE run IS NOT NULL GROUP BY run"), i="n")
def _(s, d):
    return R.into_runs(X.raters(s, d), ("auto", "rich", "odd")).groupBy("run").agg(F.count(F.lit(1)).alias("n"))


@query("pr_21_blank_rows", "SELECT n_nationkey FROM nation WHERE n_nationkey % 3 = 0")
def _(s, d):
    n = table(s, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).otherwise("  ").alias("state"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("county"))
    return R.blank_rows(n, ("state", "county")).select("n_nationkey")


@query("pr_22_aliases", "SELECT s_suppkey AS entry_rcid, s_suppkey AS rcid, CAST(NULL AS VARCHAR) AS note FROM supplier")
def _(s, d):
    return R.with_aliases(table(s, d, "supplier").select(F.col("s_suppkey").alias("entry_rcid")), {"rcid": "entry_rcid"}, {"note": "string"})


@query("pr_23_industry_bins", "SELECT p_partkey, CASE WHEN p_size BETWEEN 24 AND 35 THEN 24 WHEN p_size BETWEEN 42 AND 47 THEN 42 ELSE p_size END AS bin FROM part", i="bin")
def _(s, d):
    return table(s, d, "part").select("p_partkey", C.code_band(F.col("p_size"), ((24, 35, 24), (42, 47, 42)), F.col("p_size")).alias("bin"))


@query("pr_24_manual_override", "SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 3 THEN 99 ELSE s_nationkey END AS code FROM supplier", i="code")
def _(s, d):
    sup = table(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("code"))
    return R.overridden(sup, sup.where("s_suppkey % 10 = 3").select("s_suppkey", F.lit(99).alias("code")), "s_suppkey", "code")


@query("pr_25_first_non_null", with_("raters", "SELECT resp_id, coalesce(odd, auto) AS code FROM raters"))
def _(s, d):
    return X.raters(s, d).select("resp_id", F.coalesce("odd", "auto").alias("code"))


@query("pr_26_measured_entities", with_("external", "SELECT DISTINCT entity_id FROM external WHERE disc IS NOT NULL"))
def _(s, d):
    return R.measured_entities(X.external(s, d), "entity_id", "disc")


DIRTY_SQL = "SELECT p_partkey, concat(p_name, CASE p_partkey % 5 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' & Co' WHEN 2 THEN ' Holdings' WHEN 3 THEN '' ELSE ' (Brand)' END) AS name FROM part"


def dirty(s, d):
    ends = F.element_at(F.array(*map(F.lit, (" Inc.", " & Co", " Holdings", "", " (Brand)"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(s, d, "part").select("p_partkey", F.concat("p_name", ends).alias("name"))


KEY_SQL = "array_to_string(list_filter(string_split(trim(regexp_replace(replace({f}, '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w NOT IN ({w})), ' ')"


@query("fn_1_company_key", f"SELECT p_partkey, {KEY_SQL.format(f=C.fold_accents_sql('name'), w=', '.join(repr(w) for w in C.LEGAL_WORDS))} AS key FROM ({DIRTY_SQL})")
def _(s, d):
    return dirty(s, d).select("p_partkey", C.company_key(F.col("name")).alias("key"))


PLAIN_SQL = "trim(regexp_replace(replace(upper(trim(name)), '&', ' AND '), '[^A-Z0-9]+', ' ', 'g'))"
STRIPPED_SQL = f"regexp_replace({PLAIN_SQL}, '( ({'|'.join(C.SUFFIXES)}))+$', '')"
TIERS_SQL = f"""SELECT {{id}}, 1 AS tier, upper(trim(name)) AS key FROM ({{src}}) UNION ALL SELECT {{id}}, 2, {PLAIN_SQL} FROM ({{src}})
UNION ALL SELECT {{id}}, 3, replace({PLAIN_SQL}, ' ', '') FROM ({{src}}) UNION ALL SELECT {{id}}, 4, {STRIPPED_SQL} FROM ({{src}})
UNION ALL SELECT {{id}}, 5, replace({STRIPPED_SQL}, ' ', '') FROM ({{src}}) UNION ALL SELECT {{id}}, 6, array_to_string(string_split({STRIPPED_SQL}, ' ')[1:2], ' ') FROM ({{src}})
UNION ALL SELECT {{id}}, 7, string_split({STRIPPED_SQL}, ' ')[1] FROM ({{src}})"""


@query("fn_2_name_keys", TIERS_SQL.format(id="p_partkey", src=DIRTY_SQL), i="tier")
def _(s, d):
    return dirty(s, d).select("p_partkey", F.inline(C.name_keys(F.col("name"))))


@query("fn_3_parentheses", f"SELECT p_partkey, trim(regexp_replace(name, '\\([^)]*\\)', '', 'g')) AS name FROM ({DIRTY_SQL})")
def _(s, d):
    return dirty(s, d).select("p_partkey", C.without_parentheses(F.col("name")).alias("name"))


@query("fn_4_clean_text", f"SELECT p_partkey, CASE WHEN lower(x) = 'nan' THEN NULL ELSE x END AS name FROM (SELECT p_partkey, trim(regexp_replace(CASE WHEN p_partkey % 11 = 0 THEN 'NaN' ELSE name END, '[^A-Za-z0-9 ]', '', 'g')) AS x FROM ({DIRTY_SQL}))")
def _(s, d):
    return dirty(s, d).select("p_partkey", C.clean_text(F.when(F.col("p_partkey") % 11 == 0, "NaN").otherwise(F.col("name"))).alias("name"))


@query("fn_5_code_text", "SELECT p_partkey, regexp_replace(p_size || '.0', '\\.0$', '') AS code, substr(CAST(p_partkey AS VARCHAR), 1, 2) AS head FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", C.code_text(F.concat(F.col("p_size").cast("string"), F.lit(".0"))).alias("code"), F.substring(F.col("p_partkey").cast("string"), 1, 2).alias("head"))


@query("fn_6_number", "SELECT n_nationkey, TRY_CAST(CASE WHEN n_nationkey % 7 = 0 THEN '*' ELSE CAST(n_nationkey AS VARCHAR) END AS DOUBLE) AS total FROM nation", d="total")
def _(s, d):
    return table(s, d, "nation").select("n_nationkey", C.number(F.when(F.col("n_nationkey") % 7 == 0, "*").otherwise(F.col("n_nationkey").cast("string"))).alias("total"))


@query("fn_7_text_boolean", "SELECT event_id, lower(CASE WHEN event_id % 2 = 0 THEN 'TRUE' WHEN event_id % 3 = 0 THEN 't' ELSE event_type END) IN ('true', 't', '1') AS flag FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", C.text_boolean(F.when(F.col("event_id") % 2 == 0, "TRUE").when(F.col("event_id") % 3 == 0, "t").otherwise(F.col("event_type"))).alias("flag"))


@query("fn_8_safe_name", f"SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM ({DIRTY_SQL})")
def _(s, d):
    return dirty(s, d).select("p_partkey", C.safe_name(F.col("name")).alias("name"))


@query("fn_9_normal", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {C.normal_pdf_sql('z')} AS pdf, {C.normal_cdf_sql('z')} AS cdf FROM (SELECT *, (l_quantity - 25) / 8.0 AS z FROM lineitem)", d="pdf cdf")
def _(s, d):
    z = F.col("z")
    return table(s, d, "lineitem").withColumn("z", (F.col("l_quantity") - 25) / 8.0).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C.normal_pdf(z).alias("pdf"), C.normal_cdf(z).alias("cdf"))


# Closed forms: a sum for an even number of degrees of the chi-square, and sums of powers of a cosine for whole numbers of degrees of the Student variable.
_PRODUCT = "coalesce(list_product(list_transform(range(1, j + 1), lambda i: {f})), 1.0)"
CHI_SQL = f"exp(-q / 2) * list_sum(list_transform(range(0, CAST(k AS BIGINT)), lambda j: power(q / 2, j) / {_PRODUCT.format(f='CAST(i AS DOUBLE)')}))"
EVEN_SQL = f"sin(a) * list_sum(list_transform(range(0, CAST(df // 2 AS BIGINT)), lambda j: power(cos(a), 2 * j) * {_PRODUCT.format(f='(2 * i - 1) / (2.0 * i)')}))"
ODD_SQL = f"2 / pi() * (a + coalesce(sin(a) * list_sum(list_transform(range(0, CAST((df - 1) // 2 AS BIGINT)), lambda j: power(cos(a), 2 * j + 1) * {_PRODUCT.format(f='2 * i / (2.0 * i + 1)')})), 0))"


@query("fn_9_tails", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {CHI_SQL} AS chi, 1 - CASE WHEN df % 2 = 0 THEN {EVEN_SQL} ELSE {ODD_SQL} END AS t FROM (SELECT *, CAST(l_quantity AS DOUBLE) AS q, l_linenumber AS k, l_linenumber + 1 AS df, atan(l_quantity / 20 / sqrt(l_linenumber + 1)) AS a FROM lineitem)", d="chi t")
def _(s, d):
    q, k = F.col("l_quantity").cast("double"), F.col("l_linenumber")
    # A tail is a long fold, so it is taken once for each pair of arguments, of which there are far fewer than rows.
    line = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    arguments = line.select("l_quantity", "l_linenumber").distinct()
    tails = arguments.select(F.col("l_quantity").alias("_q"), F.col("l_linenumber").alias("_k"), C.chi_square_tail(q, 2.0 * k).alias("chi"), C.student_tail(q / 20, k + 1.0).alias("t"))
    found = line.join(tails, F.col("l_quantity").eqNullSafe(F.col("_q")) & F.col("l_linenumber").eqNullSafe(F.col("_k")), "left")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "chi", "t")


@query("fn_10_p_text", "SELECT p_partkey, CASE WHEN p < 0.001 THEN '<0.001' ELSE printf('%.3f', p) END AS p FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) * p_size * p_size / 131072 - 0.001 AS p FROM part)")
def _(s, d):
    x = F.col("p_size").cast("double")
    return table(s, d, "part").select("p_partkey", C.p_text(x * F.col("p_size") * F.col("p_size") / 131072 - 0.001).alias("p"))
