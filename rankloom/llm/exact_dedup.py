"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Only built-in functions are used. Rows of the dedup carry no text through a shuffle:
each level moves a few numbers per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, checkpoint, table

#: Most bits of a survivor filter: 64 MB.
FILTER_BITS = 1 << 29
#: A group is hot if it has at least one in so many rows; so there are at most so many hot groups.
HOT_GROUPS = 1000


def normalise(text: Column) -> Column:
    """Runs of blanks become one space; null counts as the empty text."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANKS, " ")


def _set_in(bitmap: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.bit_get(byte, (position % 8).cast("int")) == 1, F.lit(False))


def _with_shared(rows: DataFrame, name: str, keys: list[str], among: Column) -> DataFrame:
    """Adds ``name``: whether a row is ``among`` those looked at and more than one of these has its ``keys``; for a few others it is true as well.

    A bitmap of the shared keys is broadcast, 16 bits for each, from 128 KB up to 64 MB, so that rows stay where they are.
    """
    shared = checkpoint(rows.where(among).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.xxhash64(*keys).alias("k")))
    bits = min(FILTER_BITS, 1 << max(20, (16 * shared.count()).bit_length()))
    at = F.pmod(F.col("k"), F.lit(bits))
    marks = shared.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))
    probed = rows.withColumn("at", F.pmod(F.xxhash64(*keys), F.lit(bits)))
    probed = probed.withColumn("bucket", F.bitmap_bucket_number("at")).withColumn("pos", F.bitmap_bit_position("at"))
    probed = probed.join(F.broadcast(marks), "bucket", "left")
    return probed.withColumn(name, among & _set_in(F.col("bitmap"), F.col("pos"))).drop("at", "bucket", "pos", "bitmap")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, hash_all: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Level 1 counts rows by the length of the normalised text; level 2 rows of a shared length by a hash of
    the first ``prefix_chars`` characters as well; level 3 hashes the full content of the rows that share both.
    Between levels a bitmap of the surviving keys is broadcast, so the text is
    never shuffled; its false positives cost a needless hash and decide nothing.
    The full content is read for rows that survive level 2 alone, and ``text_sha256`` is null for the others. With ``hash_all``,
    for callers that want the digest of every row anyway, one scan makes the keys of all
    levels, which then work on these numbers.

    A hot group is reduced by map-side aggregation. Its rows find their group by a
    broadcast of the groups that hold at least 1 / HOT_GROUPS of all rows, of which
    there are at most HOT_GROUPS; all other rows find theirs by a join on the key.

    Null text counts as empty; all empty texts form one group. The row with the smallest id of a group is kept,
    one of them where several rows of a group have that id. A null id is not the one that stays unless its whole group has null ids. Other columns
    of ``docs`` are ignored, whatever their names. An empty table gives no rows.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), normalise(F.col(text_col)).alias("t")).withColumn("n", F.length("t"))
    prefix, digest = F.xxhash64(F.substring("t", 1, prefix_chars)), F.sha2(F.col("t").cast("binary"), 256)
    everyone, same_length, same_prefix = F.lit(True), F.col("same_length"), F.col("same_prefix")
    if hash_all:
        rows = checkpoint(base.select("doc_id", "n", prefix.alias("p"), digest.alias("sha")))
        rows = _with_shared(_with_shared(rows, "same_length", ["n"], everyone), "same_prefix", ["n", "p"], same_length)
    else:
        rows = _with_shared(base, "same_length", ["n"], everyone).withColumn("p", F.when(same_length, prefix))
        rows = _with_shared(rows, "same_prefix", ["n", "p"], same_length).withColumn("sha", F.when(same_prefix, digest))
    rows = checkpoint(rows.select("doc_id", "n", "p", "sha", "same_prefix")).withColumn("row", F.monotonically_increasing_id())
    # The least id, of rows with that id the first one; a null id comes last.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row")).alias("first")
    groups = rows.where("same_prefix").groupBy("n", "p", "sha").agg(first, F.count(F.lit(1)).alias("size")).where("size > 1")
    groups = checkpoint(groups.select(F.col("n").alias("gn"), F.col("p").alias("gp"), F.col("sha").alias("gs"), F.col("first.doc_id").alias("keep"), F.col("first.row").alias("at"), "size"))
    n = rows.count()
    hot = groups.where(F.col("size") * HOT_GROUPS >= n).toDF("hn", "hp", "hs", "hot_keep", "hot_at", "hot_size")
    cold = groups.where(F.col("size") * HOT_GROUPS < n)
    joined = rows.join(F.broadcast(hot), (rows["n"] == F.col("hn")) & (rows["p"] == F.col("hp")) & (rows["sha"] == F.col("hs")), "left")
    # Rows of hot groups have their answer; a spread key keeps them from meeting in the second join.
    joined = joined.withColumn("key", F.when(F.col("hot_size").isNotNull(), F.xxhash64("row")).otherwise(F.col("p")))
    joined = joined.join(cold, (joined["n"] == cold["gn"]) & (joined["key"] == cold["gp"]) & (joined["sha"] == cold["gs"]), "left")
    size = F.coalesce("hot_size", "size")
    keep = F.when(size.isNull(), F.col("doc_id")).when(F.col("hot_size").isNotNull(), F.col("hot_keep")).otherwise(F.col("keep"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce(size, F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.coalesce("hot_at", "at"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group.

    Of rows with one id and one text, any one stays.
    """
    found = checkpoint(exact_dedup(docs, id_col, text_col))
    gone = found.where("not kept and not doc_id <=> keep_id").select(F.col("doc_id").alias("_gone")).distinct()
    again = found.where("not kept and doc_id <=> keep_id").select(F.col("doc_id").alias("_again")).distinct()
    left = docs.join(gone, docs[id_col].eqNullSafe(gone["_gone"]), "left_anti")
    once = left.join(again, left[id_col].eqNullSafe(again["_again"]), "left_semi").dropDuplicates([id_col, text_col])
    return left.join(again, left[id_col].eqNullSafe(again["_again"]), "left_anti").unionByName(once)


def op4_exact_dedup(spark, sf_dir):
    """Contract of op4; the digest of every row is wanted, so ``hash_all`` is set."""
    return exact_dedup(table(spark, sf_dir, "documents"), hash_all=True)


OP4_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept,
       text_sha256
FROM n
"""
