"""Survey-shaped relations derived from the given tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return line.join(orders, line.l_orderkey == orders.o_orderkey).select(F.col("o_custkey").cast("long").alias("resp_id"), F.col("l_suppkey").cast("long").alias("entity_id"), "l_orderkey", "l_linenumber", "l_partkey")


def _value(part):
    v = part % 6
    return F.when(v == 0, -1).otherwise(v).cast("int")


def rating_rows(spark, d) -> DataFrame:
    """All rating rows with repeated (rater, entity): ``resp_id, entity_id, value, l_orderkey, l_linenumber, l_partkey``."""
    return _joined(spark, d).withColumn("value", _value(F.col("l_partkey") + F.col("l_linenumber")))


def _rated(spark, d) -> DataFrame:
    """At most five different entities per rater, with ``slot`` and the columns that both items' values come from."""
    first = W.partitionBy("resp_id", "entity_id").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    slot = W.partitionBy("resp_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "entity_id")
    rows = _joined(spark, d).repartition("resp_id")  # serves both windows, and what counts by rater later
    rows = rows.withColumn("rn", F.row_number().over(first)).where("rn = 1").withColumn("slot", F.row_number().over(slot)).where("slot <= 5")
    arm = F.when(F.col("resp_id") % 2 == 0, "contact").otherwise("conduct")
    framing = F.when(F.col("resp_id") % 4 < 2, "pos").otherwise("neg")
    return rows.select("resp_id", "entity_id", F.col("slot").cast("int").alias("slot"), "l_partkey", "l_linenumber", arm.alias("arm"), framing.alias("framing"))


def _item_value(item: str):
    return _value(F.col("l_partkey") + F.col("l_linenumber") * (1 if item == "a" else 2))


def ratings(spark, d, item: str = "a") -> DataFrame:
    """``resp_id, entity_id, slot 1..5, value, arm, framing``: at most five different entities per rater; value -1 is don't know."""
    return _rated(spark, d).select("resp_id", "entity_id", "slot", _item_value(item).alias("value"), "arm", "framing")


def items(spark, d) -> DataFrame:
    """Both items, long: ``item`` (a, b) and the columns of ``ratings``. Which rows of a rater count does not depend on the item, so they are found once."""
    each = F.inline(F.array(*[F.struct(F.lit(i).alias("item"), _item_value(i).alias("value")) for i in ("a", "b")]))
    return _rated(spark, d).select("resp_id", "entity_id", "slot", "arm", "framing", each).select("resp_id", "entity_id", "slot", "value", "arm", "framing", "item")


def valid(df: DataFrame) -> DataFrame:
    return df.where("value between 1 and 5")


def entities(spark, d) -> DataFrame:
    """``entity_id, name, grp, weight``; weight null where not positive."""
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").cast("long").alias("entity_id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("int").alias("grp"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal").cast("double")).alias("weight"))


def raters(spark, d) -> DataFrame:
    """``resp_id, segment, balance, auto, rich, odd``: flags 0/1, ``odd`` null for every 17th rater."""
    c = table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").cast("long").alias("resp_id"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").cast("double").alias("balance"),
        (F.col("c_mktsegment") == "AUTOMOBILE").cast("int").alias("auto"),
        (F.col("c_acctbal") > 0).cast("int").alias("rich"),
        F.when(F.col("c_custkey") % 17 != 0, F.col("c_nationkey") % 2).cast("int").alias("odd"),
    )


def external(spark, d) -> DataFrame:
    """``entity_id, disc``: the external measure of entities with id not divisible by 3, else null."""
    line = table(spark, d, "lineitem")
    return line.groupBy(F.col("l_suppkey").cast("long").alias("entity_id")).agg(F.avg(F.col("l_discount").cast("double")).alias("m")).select("entity_id", F.when(F.col("entity_id") % 3 != 0, F.col("m")).alias("disc"))


def positions(spark, d) -> DataFrame:
    """``company, user_id, startdate, enddate (null: open), weight, salary, line``."""
    line, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    j = line.join(orders, line.l_orderkey == orders.o_orderkey)
    return j.select(
        F.col("l_suppkey").cast("long").alias("company"),
        F.col("o_custkey").cast("long").alias("user_id"),
        F.col("o_orderdate").cast("date").alias("startdate"),
        F.when(F.col("l_linenumber") != 1, F.col("l_shipdate")).cast("date").alias("enddate"),
        F.col("l_quantity").cast("double").alias("weight"),
        F.col("l_extendedprice").cast("double").alias("salary"),
        F.col("l_linenumber").cast("int").alias("line"),
    )


def reviews(spark, d) -> DataFrame:
    """``company, ts, status, score``."""
    e = table(spark, d, "events")
    return e.select((F.col("user_id") % 100).cast("long").alias("company"), "ts", F.col("event_type").alias("status"), (F.lit(1) + F.get_json_object("props", "$.k").cast("long") % 5).cast("int").alias("score"), F.col("user_id").cast("long").alias("user_id"))


_VALUE = "CASE WHEN ({x}) % 6 = 0 THEN -1 ELSE ({x}) % 6 END"


def _ratings_sql(x: str) -> str:
    return f"""SELECT CAST(resp_id AS BIGINT) AS resp_id, CAST(entity_id AS BIGINT) AS entity_id, CAST(slot AS INTEGER) AS slot, CAST(value AS INTEGER) AS value,
  CASE WHEN resp_id % 2 = 0 THEN 'contact' ELSE 'conduct' END AS arm, CASE WHEN resp_id % 4 < 2 THEN 'pos' ELSE 'neg' END AS framing
FROM (SELECT *, row_number() OVER (PARTITION BY resp_id ORDER BY l_orderkey, l_linenumber, l_partkey, entity_id) AS slot
  FROM (SELECT *, row_number() OVER (PARTITION BY resp_id, entity_id ORDER BY l_orderkey, l_linenumber, l_partkey, value) AS rn
    FROM (SELECT o_custkey AS resp_id, l_suppkey AS entity_id, l_orderkey, l_linenumber, l_partkey, {_VALUE.format(x=x)} AS value
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)) WHERE rn = 1) WHERE slot <= 5"""


SQL = {
    "rating_rows": f"SELECT CAST(o_custkey AS BIGINT) AS resp_id, CAST(l_suppkey AS BIGINT) AS entity_id, CAST({_VALUE.format(x='l_partkey + l_linenumber')} AS INTEGER) AS value, l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "ratings": _ratings_sql("l_partkey + l_linenumber"),
    "ratings_b": _ratings_sql("l_partkey + l_linenumber * 2"),
    "items": "SELECT 'a' AS item, * FROM ratings UNION ALL SELECT 'b' AS item, * FROM ratings_b",
    "vr": "SELECT * FROM ratings WHERE value BETWEEN 1 AND 5",
    "vi": "SELECT * FROM items WHERE value BETWEEN 1 AND 5",
    "entities": "SELECT CAST(s_suppkey AS BIGINT) AS entity_id, s_name AS name, CAST(s_nationkey AS INTEGER) AS grp, CASE WHEN s_acctbal > 0 THEN CAST(s_acctbal AS DOUBLE) END AS weight FROM supplier",
    "raters": "SELECT CAST(c_custkey AS BIGINT) AS resp_id, c_mktsegment AS segment, CAST(c_acctbal AS DOUBLE) AS balance, CAST(c_mktsegment = 'AUTOMOBILE' AS INTEGER) AS auto, CAST(c_acctbal > 0 AS INTEGER) AS rich, CASE WHEN c_custkey % 17 <> 0 THEN CAST(c_nationkey % 2 AS INTEGER) END AS odd FROM customer",
    "external": "SELECT CAST(l_suppkey AS BIGINT) AS entity_id, CASE WHEN l_suppkey % 3 <> 0 THEN avg(CAST(l_discount AS DOUBLE)) END AS disc FROM lineitem GROUP BY l_suppkey",
    "positions": "SELECT CAST(l_suppkey AS BIGINT) AS company, CAST(o_custkey AS BIGINT) AS user_id, CAST(o_orderdate AS DATE) AS startdate, CAST(CASE WHEN l_linenumber <> 1 THEN l_shipdate END AS DATE) AS enddate, CAST(l_quantity AS DOUBLE) AS weight, CAST(l_extendedprice AS DOUBLE) AS salary, CAST(l_linenumber AS INTEGER) AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "reviews": "SELECT CAST(user_id % 100 AS BIGINT) AS company, ts, event_type AS status, CAST(1 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS INTEGER) AS score, CAST(user_id AS BIGINT) AS user_id FROM events",
}
_NEEDS = {"items": ("ratings", "ratings_b"), "vr": ("ratings",), "vi": ("ratings", "ratings_b", "items")}


def with_(names: str, body: str) -> str:
    """``body`` after the definitions of the named relations; a body may go on with `, x AS (...) SELECT`."""
    wanted: list[str] = []
    for n in names.split():
        for m in (*_NEEDS.get(n, ()), n):
            if m not in wanted:
                wanted.append(m)
    head = ",\n".join(f"{n} AS ({SQL[n]})" for n in wanted)
    return f"WITH {head}{'' if body.lstrip().startswith(',') else chr(10)}{body}"
