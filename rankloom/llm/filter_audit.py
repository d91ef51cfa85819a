"""How document filters interact: five filters in all orders, with duplicates found by radix tries.

Texts are dealt by ranges of adaptive prefixes: prefixes that too many characters of text share are
lengthened until they do not. A task inserts the full texts of its ranges, by ascending id, into a
compressed trie with the least id at each terminal, so a text that arrives at a taken terminal repeats a smaller id.
What the filters say of a document is a mask of five bits; all orders are read off the counts of masks.
"""

from __future__ import annotations

import itertools
import json
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, table

#: The filters, in the order of their bits.
FILTERS = "ABCDE"
#: Characters of text in one range of prefixes, and so in one trie; more where that would make too many ranges.
RANGE_CHARS, MAX_RANGES = 1 << 22, 1 << 20
#: Lengths of prefixes; one that is shared by more than a range's characters is replaced by longer ones.
PREFIX_CHARS = (4, 16, 64, 512, 4096, 1 << 15, 1 << 18, 1 << 24, (1 << 31) - 1)
#: Rows whose duplicate flag is known before the shuffle travel without text, in so many shares of their own.
SHARES = 1024
CAPITALS, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"


class Trie:
    """Compressed trie of texts; a node is [edges by first character, value at the terminal], an edge [label, node]."""

    def __init__(self) -> None:
        self.root: list = [{}, None]

    def insert(self, text: str, value):
        """Puts ``value`` at the terminal of ``text`` if it is less than what is there; returns what is there then."""
        node, at = self.root, 0
        while at < len(text):
            edge = node[0].get(text[at])
            if edge is None:
                below: list = [{}, None]
                node[0][text[at]] = [text[at:], below]
                node = below
                break
            label = edge[0]
            if text.startswith(label, at):
                node, at = edge[1], at + len(label)
                continue
            k = _shared(label, text, at)
            middle: list = [{label[k]: [label[k:], edge[1]]}, None]
            edge[0], edge[1] = label[:k], middle
            node, at = middle, at + k
        if node[1] is None or value < node[1]:
            node[1] = value
        return node[1]


def _shared(label: str, text: str, at: int) -> int:
    """Length of the common start of ``label`` and ``text[at:]``, which differ somewhere in it."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[low:middle] == text[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


def mask_of(text: str) -> int:
    """Bits of the filters A to D that ``text`` fails."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # of bytes, this splits at space and \x09 to \x0D
    few = len(words) < 200
    dull = 100 * len(set(words)) < 50 * len(words)
    loud = 100 * (len(data) - len(data.translate(None, CAPITALS))) > 3 * len(text)
    marked = len(data.translate(None, MARKS)) < len(data)
    return few | dull << 1 | loud << 2 | marked << 3


def range_cuts(docs: DataFrame, text_col: str = "text", range_chars: int = RANGE_CHARS) -> list[str]:
    """Ascending prefixes that cut all texts into ranges of about ``range_chars`` characters, copies of one text aside, and into MAX_RANGES of them at most.

    Characters are summed by short prefixes; those of more than ``range_chars``, of which there are at most total / range_chars, are summed again
    by longer ones, unless one text has them all. As many cuts reach the driver. The table is read again for each
    length that is needed, and no more than its prefixes are shuffled.
    """
    rows, leaves = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).withColumn("n", F.length("t") + 1), None
    for size in PREFIX_CHARS:
        whole = F.xxhash64("t")
        sums = checkpoint(rows.groupBy(F.substring("t", 1, size).alias("p")).agg(F.sum("n").alias("chars"), (F.min(whole) < F.max(whole)).alias("several")))
        if leaves is None:
            range_chars = max(range_chars, (sums.agg(F.sum("chars")).first()[0] or 0) // MAX_RANGES)
        heavy = (F.col("chars") > range_chars) & F.col("several")
        light = sums.where(~heavy).select("p", "chars")
        leaves = light if leaves is None else leaves.unionByName(light)
        crowded = sums.where(heavy).select(F.col("p").alias("_p"))
        if crowded.isEmpty():
            break
        rows = rows.join(F.broadcast(crowded), F.substring("t", 1, size) == F.col("_p"), "left_semi")
    dealt = checkpoint(leaves.repartitionByRange("p").withColumn("part", F.spark_partition_id()))
    upto = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row for each part
    starts = dealt.groupBy("part").agg(F.sum("chars").alias("all")).select("part", F.coalesce(F.sum("all").over(upto), F.lit(0)).alias("start"))
    inner = F.sum("chars").over(W.partitionBy("part").orderBy("p").rowsBetween(W.unboundedPreceding, -1))
    place = F.col("start") + F.coalesce("inner", F.lit(0))
    cut = dealt.withColumn("inner", inner).join(starts, "part").groupBy(F.floor(place / range_chars).alias("range")).agg(F.min("p").alias("p"))
    return sorted(r["p"] for r in cut.where("range > 0").collect())


def _order(number: int | None) -> tuple[bool, int]:
    """Ids in order; none comes last."""
    return number is None, number or 0


def text_flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", range_chars: int = RANGE_CHARS) -> DataFrame:
    """``doc_id, part, mask, rows``: how many rows of an id and part fail exactly the filters in ``mask``.

    Before the shuffle, the rows of an Arrow batch that have the same text as a smaller id of that
    batch get their flag at once and leave their text behind, so of a group of copies a task receives one text from each batch. Rows without an id count as larger than all others; rows that repeat
    id and text do not repeat a smaller id. Null text counts as empty, a null part as the empty string; other columns are ignored.
    """
    cuts = docs.sparkSession.sparkContext.broadcast(range_cuts(docs, text_col, range_chars))
    repeats = 1 << FILTERS.index("E")

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts, texts = (c.to_pylist() for c in batch.columns)
            least: dict[str, tuple[bool, int]] = {}
            for i, t in zip(ids, texts):
                least[t] = min(least.get(t, (True, 0)), _order(i))
            masks = {t: mask_of(t) for t in least}
            rows: Counter = Counter()
            for i, part, t in zip(ids, parts, texts):
                rows[(i, part, masks[t] | repeats, None) if _order(i) > least[t] else (i, part, masks[t], t)] += 1
            ranges = [-1 - n % SHARES if t is None else bisect_right(cuts.value, t) for n, (_, _, _, t) in enumerate(rows)]
            keys = zip(*rows) if rows else [()] * 4
            columns = [ranges, *map(list, keys), list(rows.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["range", "doc_id", "part", "mask", "text", "rows"])

    def inserted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, current = Trie(), None
        for batch in batches:
            masks = batch.column(3).to_pylist()
            for n, (at, i, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 4)))):
                if at != current:  # rows come by range, and within it by id
                    trie, current = Trie(), at
                if text is not None and trie.insert(text, _order(i)) < _order(i):
                    masks[n] |= repeats
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(masks, pa.int32()), batch.column(5)], names=["doc_id", "part", "mask", "rows"])

    rows = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(part_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    dealt = rows.mapInArrow(masked, "range int, doc_id long, part string, mask int, text string, rows long").repartition("range").sortWithinPartitions("range", F.col("doc_id").asc_nulls_last())
    return dealt.mapInArrow(inserted, "doc_id long, part string, mask int, rows long")


def filter_orders() -> list[dict]:
    """One entry for each order and step: the bit of the step's filter and the bits of those before it."""
    out = []
    for order in itertools.permutations(FILTERS):
        bits = [1 << FILTERS.index(x) for x in order]
        out += [{"filter_order": "".join(order), "step": k + 1, "bit": bit, "earlier": sum(bits[:k])} for k, bit in enumerate(bits)]
    return out


def _count(condition: str, value: str = "c.n") -> F.Column:
    return F.expr(f"aggregate(filter(cells, c -> {condition}), 0L, (s, c) -> s + {value})")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", range_chars: int = RANGE_CHARS) -> DataFrame:
    """One row for each part, order of the five filters and step: ``kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    A: fewer than 200 words; B: under half of the words distinct; C: over 3 % capital letters; D: one of ``#$%&*|``; E: the text of a smaller id. Masks
    are counted by part and labels, at most 128 cells a part, and the 600 rows of a part are sums over its cells. An id with several labels is good or toxic if
    one of them says so; a null or unknown id has no label. Nulls, ties and repeated rows: see ``text_flags``. An empty table gives no rows.
    """
    good, toxic = (F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c) for c in ("quality", "toxic"))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(good, toxic)
    flags = text_flags(docs, id_col, text_col, part_col, range_chars).groupBy("doc_id", "part", "mask").agg(F.sum("rows").alias("rows"))
    counted = flags.join(marks, F.col("doc_id") == F.col("_id"), "left").groupBy("part", "mask", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    cells = counted.agg(F.sum("rows").alias("n")).groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("cells"))
    orders = F.from_json(F.lit(json.dumps(filter_orders())), "array<struct<filter_order string, step int, bit int, earlier int>>")
    rows = cells.select("part", "cells", F.inline(orders))
    removed = "c.mask & bit <> 0 and c.mask & earlier = 0"
    return rows.select(
        "part",
        "filter_order",
        "step",
        _count("c.mask & (bit | earlier) = 0").alias("kept"),
        _count(removed).alias("removed"),
        _count("c.mask & bit <> 0 and c.mask & earlier <> 0").alias("redundant"),
        _count("c.mask = bit").alias("unique_fails"),
        _count(f"{removed} and c.good = 1").alias("good_lost"),
        _count(f"{removed} and c.toxic = 1").alias("toxic_lost"),
        # Of the 120 orders, each of the filters that a document fails comes first among them equally often.
        _count("c.mask & bit <> 0", "c.n * (120 div bit_count(c.mask))").alias("shapley"),
    )


def op13_filter_audit(spark, sf_dir):
    """Contract of op13; see ``filter_audit``."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), m AS (
  SELECT doc_id, part,
         CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM d
), l AS (
  SELECT doc_id, max(CAST(coalesce(quality = 1, FALSE) AS INTEGER)) AS good, max(CAST(coalesce(toxic = 1, FALSE) AS INTEGER)) AS toxic FROM labels GROUP BY 1
), c AS (
  SELECT part, mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL
), f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s AS (
  SELECT filter_order, step, bits[step] AS bit, CAST(list_sum(bits[1:step]) - bits[step] AS INTEGER) AS earlier FROM (SELECT *, unnest(range(1, 6)) AS step FROM o)
), r AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (bit | earlier) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & bit <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN n * good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN n * toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""
