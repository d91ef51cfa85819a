"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Blank characters of the query contracts: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows go to Python in batches of about so many bytes: 10,000 texts at a time, Spark's default, are held several times over by a task and its worker.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 21)}


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder.

    It is the one in ``spark.checkpoint.dir``. A session on one machine that names none, as in
    tests, gets a temporary folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="rankloom-"))
    return sc.getCheckpointDir()


@contextmanager
def set_to(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold inside a ``with`` block."""
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, which cuts its lineage."""
    checkpoint_dir(df.sparkSession)
    with set_to(df.sparkSession, BATCHES):
        return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back: smaller than a checkpoint of many rows.

    Shuffle files of what went into it are of no more use, so Spark is asked to remove them right after the write.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    with set_to(spark, BATCHES | {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.parquet(path)
    return spark.read.parquet(path)


def removed(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``written`` that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, df: DataFrame) -> str:
    """``name``, with marks added until ``df`` has no such column."""
    while name in df.columns:
        name += "_"
    return name


def crc_rest(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def words_in(text: Column) -> Column:
    """Number of maximal runs of non-blank characters; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def rank_in_order(df: DataFrame, group: str, order: list[str], weight: Column, position: str, block_rows: int = 1_000) -> DataFrame:
    """Adds ``before``: the sum of ``weight`` over the rows of the same ``group`` that come earlier in ``order``.

    A running sum over one window would put a whole group in one task. Here
    ``position``, a number in [0, 1) that never falls as ``order[0]`` grows, is cut into blocks of about ``block_rows``
    rows, block sums are accumulated, and only rows of one block meet in a window. The more evenly positions are spread,
    the more even are the blocks. The result is the same for any block size. Null groups form a group.
    """
    sizes = df.groupBy(group).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block_rows)).cast("long").alias("_blocks"))
    cut = salted_join(df, sizes, group, "_blocks").withColumn("_block", F.floor(F.col(position) * F.col("_blocks")).cast("long"))
    sums = cut.groupBy(group, "_block").agg(F.sum(weight).alias("_sum"))
    upto = W.partitionBy(group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(F.col(group).alias("_g"), F.col("_block").alias("_b"), F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_start"))
    within = W.partitionBy(group, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inner = cut.withColumn("_inner", F.coalesce(F.sum(weight).over(within), F.lit(0)))
    joined = inner.join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_block") == F.col("_b")), "left")
    return joined.withColumn("before", F.col("_start") + F.col("_inner")).drop("_g", "_b", "_start", "_inner", "_block", "_blocks")


def salted_join(df: DataFrame, stats: DataFrame, key: str, *values: str, salts: int = 64) -> DataFrame:
    """Left join of ``df`` with one row of ``stats`` per ``key``; null keys match.

    ``key`` may be hot, as one source may hold a third of all rows, so both sides
    carry a salt: ``stats`` is small and is repeated ``salts`` times. The salt is a row's
    place, so that equal rows are spread as well; ``df`` must come from a checkpoint, so that places stay as they are.
    """
    right = stats.select(F.col(key).alias("_k"), *values, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_s"))
    left = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    on = left[key].eqNullSafe(right["_k"]) & (left["_salt"] == right["_s"])
    return left.join(right, on, "left").drop("_k", "_s", "_salt")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, place: str, n: int, hot: int = 1_000) -> DataFrame:
    """Left join of ``rows`` with one row of ``groups`` per ``key``; ``groups`` has the group's ``size`` among the ``n`` rows.

    Groups with at least 1 / ``hot`` of the rows, at most ``hot`` of them, are broadcast. Their rows get a key of their own for
    the join with the others, from ``place``, which tells rows apart, so they do not meet.
    """
    values = [c for c in groups.columns if c != key]
    groups = checkpoint(groups)
    large = groups.where(F.col("size") * hot >= n).select(F.col(key).alias("_h"), *(F.col(c).alias(f"_h_{c}") for c in values))
    small = groups.where(F.col("size") * hot < n).select(F.col(key).alias("_s"), *values)
    joined = rows.join(F.broadcast(large), rows[key] == F.col("_h"), "left")
    spread = F.when(F.col("_h").isNotNull() | F.col(key).isNull(), F.concat(F.lit("-"), F.col(place).cast("string"))).otherwise(F.col(key).cast("string"))
    joined = joined.withColumn("_key", spread).join(small, F.col("_key") == F.col("_s").cast("string"), "left")
    return joined.select(*rows.columns, *(F.coalesce(f"_h_{c}", c).alias(c) for c in values))
