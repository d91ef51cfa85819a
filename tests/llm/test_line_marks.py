"""Bitmaps of line dedup reach the driver in shares."""

import numpy as np
from pyspark.sql import functions as F

from rankloom.llm import line_dedup


def test_bitmap_comes_in_shares(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARE_BITS", 1 << 18)
    ids = spark.range(1000).select(F.xxhash64("id").alias("key"))
    marks = line_dedup._bitmap(ids, "key")
    assert marks.bits == 1 << 20
    assert [len(x.value) for x in marks.shares] == [1 << 15] * 4
    known = np.array([r["key"] for r in ids.collect()])
    assert marks.marked(known).all()
    others = np.array([r["key"] for r in spark.range(1000, 3000).select(F.xxhash64("id").alias("key")).collect()])
    taken = np.zeros(1 << 20, bool)
    taken[known & (1 << 20) - 1] = True
    assert (marks.marked(others) == taken[others & (1 << 20) - 1]).all()
    marks.destroy()
