"""What goes to Python workers at a time is bounded in bytes, not only in rows."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rankloom.llm import suffix_tree_lm as lm
from rankloom.llm.common import checkpoint, written


def test_batches_of_long_texts_are_small(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["bytes"])

    texts = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("words "), 10_000).alias("text"))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    for kept in (written, checkpoint):
        found = [r[0] for r in kept(texts.mapInArrow(sizes, "bytes long")).collect()]
        assert sum(found) > 24e6 and max(found) < 4 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_hasher_is_small_and_words_are_hashed_the_same_wherever_they_lie():
    h = lm.Hasher()
    assert h.up.nbytes + h.down.nbytes < 4 << 20
    long = "x" * (lm.WINDOW + 5)
    text = " ".join(["one", "two", "y" * (lm.WINDOW - 3), long, "ONE"] + ["three four"] * 40_000 + [long, "two"])
    t = h.tokens(text)
    words = text.lower().split()
    assert len(t) == len(words) + 1
    of = {}
    for w, x in zip(words, t.tolist()):
        assert of.setdefault(w, x) == x
    assert len(set(of.values())) == len(of) == 6
    assert np.array_equal(h.tokens("three"), t[[words.index("three"), -1]])
