"""Toxicity: a logistic classifier regularised by counterfactual swaps of identity terms."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, crc_rest, table

#: At most so many labelled documents are used to fit the model.
MAX_TRAINING_ROWS = 20_000
#: So many features with the strongest association are fitted.
MAX_FEATURES = 4096
HASH_BITS = 20
_WORD = re.compile(r"[^\W\d_]+")

#: Identity terms in groups; a swap replaces a term by the next one of its group.
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("women", "men"),
    ("woman", "man"),
    ("female", "male"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino"),
    ("immigrants", "refugees", "natives"),
    ("mexican", "american", "chinese", "african", "european"),
    ("disabled", "blind", "deaf"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
    ("musulmans", "chrétiens", "juifs"),
    ("musulmanes", "cristianos", "judíos"),
    ("muslime", "christen", "juden"),
)
_SWAP = {term: group[(i + 1) % len(group)] for group in IDENTITY_TERMS for i, term in enumerate(group)}


def word_hashes(word: str) -> set[int]:
    """Hashes of a word and of its runs of four and five letters, its ends marked."""
    marked = f"^{word}$"
    parts = [f"w {word}"] + [marked[i : i + n] for n in (4, 5) for i in range(len(marked) - n + 1)]
    return {zlib.crc32(p.encode("utf-8", "replace")) >> (32 - HASH_BITS) for p in parts}


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features(words: set[str]) -> list[int]:
    """The distinct features of a set of words: what a document has, not how often."""
    return sorted(set().union(*map(word_hashes, words)))


def swapped(words: set[str]) -> set[str] | None:
    """The words after the identity terms are swapped; None if there is no such term."""
    return {_SWAP.get(w, w) for w in words} if not _SWAP.keys().isdisjoint(words) else None


@dataclass
class ToxicityModel:
    """Weights by feature, at most a few thousand, whatever the corpus."""

    weights: dict[int, float]
    bias: float
    #: Features with a weight by word, of words met lately and of those met before; the latter are forgotten when the former get many.
    met: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False, compare=False)
    older: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False, compare=False)

    def learn(self, word: str) -> tuple[int, ...]:
        found = self.older.get(word)
        if found is None:
            found = tuple(h for h in word_hashes(word) if h in self.weights)
        if len(self.met) > 100_000:
            self.older, self.met = self.met, {}
        self.met[word] = found
        return found

    def score(self, text: str) -> float:
        present: set[int] = set()
        words = words_of(text)
        for word, hit in zip(words, list(map(self.met.get, words))):
            if hit is None:
                hit = self.learn(word)
            if hit:
                present.update(hit)
        z = self.bias + math.fsum(self.weights[h] for h in present)
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


def training_sample(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str, text_col: str, label_col: str, max_rows: int) -> DataFrame:
    """``text, label`` of at most ``max_rows`` labelled documents, those with the least hash of their id.

    The ids of the sample are few enough by construction to be broadcast, so texts are not shuffled, unless rows
    repeat an id of the sample: then its least text stands for it.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable).select(F.col(id_col).alias("_id"), (F.col(label_col) > 0).cast("int").alias("label"))
    n = rows.count()
    at = F.xxhash64(F.col("_id"), F.lit(5))
    if n > max_rows:  # a little more than is needed by a threshold, then exactly, so that few rows are sorted
        rows = rows.where(F.pmod(at, F.lit(1 << 30)) < int(min(1.0, 1.2 * max_rows / n + 1e-3) * (1 << 30)))
    chosen = rows.orderBy(at, "_id", "label").limit(max_rows).groupBy("_id").agg(F.max("label").alias("label"))
    chosen = checkpoint(chosen)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")
    if texts.groupBy("_id").count().where("count > 1").isEmpty():
        return texts.select("_id", "text", "label")
    return texts.groupBy("_id", "label").agg(F.min("text").alias("text")).select("_id", "text", "label")


def _rows_of_features(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    for whole in batches:
        for low in range(0, whole.num_rows, rows):
            batch, lists, others = whole.slice(low, rows), [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                other = swapped(words)
                lists.append(np.array(features(words), np.int32))
                others.append(np.array(features(other), np.int32) if other is not None else None)
            columns = (batch.column(0), batch.column(2), lists, others)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) if isinstance(c, list) else c.cast(t) for c, t in zip(columns, types)], names=["id", "label", "f", "g"])


def _placed(lists: pa.ListArray, place: np.ndarray) -> pa.ListArray:
    """The lists with each number's ``place``, without numbers that have none."""
    offsets = lists.offsets.to_numpy()
    found = place[lists.values.to_numpy()[offsets[0] : offsets[-1]]]
    upto = np.append(0, np.cumsum(found >= 0))[offsets - offsets[0]]
    return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(found[found >= 0], pa.int32()), mask=lists.is_null())


def fit(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = MAX_TRAINING_ROWS,
    max_features: int = MAX_FEATURES,
    ridge: float = 3e-5,
    counterfactual: float = 1.0,
    steps: int = 400,
) -> ToxicityModel:
    """Fit on a bounded sample of labelled rows.

    Features are words and letter runs, present or not, hashed to 2^HASH_BITS places. Spark counts them by label and
    keeps those of the strongest association, identity terms always. The loss is the mean
    log loss, plus ``ridge`` times the squared weights, plus ``counterfactual`` times the
    mean squared change of the log odds when the identity terms of a labelled text are
    swapped: a group's name alone must not move the score. Only the kept features
    of the sampled rows (at most ``max_rows`` short lists) reach the driver.

    Rows of the rarer label weigh more, by the root of the ratio of the classes.

    Without usable labels, or with one class only, the score is the smoothed share of label 1.
    """
    spark = docs.sparkSession
    sample = training_sample(docs, labels, F.lit(True) if usable is None else usable, id_col, text_col, label_col, max_rows)
    sparse = checkpoint(sample.select(F.col("_id").cast("long"), "text", "label").mapInArrow(_rows_of_features, "id long, label int, f array<int>, g array<int>"))
    n, n1 = sparse.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    prior = float(np.log((n1 + 0.5) / (n - n1 + 0.5)))
    if n1 in (0, n):
        return ToxicityModel({}, prior)
    counts = sparse.select("label", F.explode("f").alias("j")).groupBy("j").agg(F.sum("label").alias("c1"), F.count(F.lit(1)).alias("c"))
    # Two-proportion z statistic of each feature.
    p = F.col("c") / F.lit(float(n))
    z = F.abs(F.col("c1") / F.lit(float(n1)) - (F.col("c") - F.col("c1")) / F.lit(float(n - n1))) / F.sqrt(p * (1 - p) + 1e-9)
    kept = {r["j"] for r in counts.where("c >= 3").orderBy(z.desc(), "j").limit(max_features).select("j").collect()}
    kept |= {int(j) for term in _SWAP for j in word_hashes(term)}
    keep = np.array(sorted(kept), np.int32)
    place = np.full(1 << HASH_BITS, -1, np.int32)
    place[keep] = np.arange(len(keep), dtype=np.int32)
    known = spark.sparkContext.broadcast(place)

    def narrowed(batches):
        for batch in batches:
            lists = [_placed(batch.column(c), known.value) for c in (2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["id", "label", "f", "g"])

    rows = sparse.mapInArrow(narrowed, "id long, label int, f array<int>, g array<int>").orderBy("id", "label").toArrow()
    known.unpersist()
    weights, bias = _descend(rows, len(keep), prior, ridge, counterfactual, steps)
    return ToxicityModel({j: w for j, w in zip(keep.tolist(), weights.tolist()) if w}, bias)


def _descend(rows: pa.Table, width: int, bias: float, ridge: float, counterfactual: float, steps: int) -> tuple[np.ndarray, float]:
    """Full-batch Adam steps on the sparse sample."""
    y = rows.column("label").to_numpy().astype(float)
    # The lists stay in Arrow's flat form: as Python lists they would take many times the room.
    lists, others = (rows.column(c).combine_chunks() for c in "fg")
    starts = lists.offsets.to_numpy()
    at = np.repeat(np.arange(len(lists), dtype=np.int32), np.diff(starts))
    col = lists.values.to_numpy()[starts[0] : starts[-1]]
    # Differences between a text and its swap: +1 and -1 entries.
    pairs = [(set(lists[k].as_py()), set(others[k].as_py())) for k in np.flatnonzero(others.is_valid()).tolist()]
    diffs = [(k, j, s) for k, (a, b) in enumerate(pairs) for s, js in ((1.0, a - b), (-1.0, b - a)) for j in js]
    d_at, d_col, d_sign = (np.array([d[i] for d in diffs], t) for i, t in ((0, np.int64), (1, np.int64), (2, float)))
    n, m = len(y), max(1, len(pairs))
    weight = np.where(y > 0, np.sqrt((n - y.sum()) / y.sum()), 1.0)
    weight *= n / weight.sum()
    w, b = np.zeros(width), bias
    m1, m2, rate = np.zeros(width + 1), np.zeros(width + 1), 0.05
    for t in range(1, steps + 1):
        p = 1.0 / (1.0 + np.exp(-np.clip(b + np.bincount(at, w[col], n), -60, 60)))
        err = weight * (p - y) / n
        grad = np.bincount(col, err[at], width) + 2 * ridge * w
        if len(diffs):
            change = np.bincount(d_at, d_sign * w[d_col], m)
            grad += counterfactual * 2 / m * np.bincount(d_col, d_sign * change[d_at], width)
        g = np.append(grad, err.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        move = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w.astype(np.float32), float(b)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every whole text.

    Null and empty texts get the model's base rate. Rows that repeat get the same score each, a null id stays null, other
    columns are ignored, whatever their names, and an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def scored(batches):
        m = sent.value
        for batch in batches:
            scores = [m.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(scored, "doc_id long, score double")


def non_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all columns, in one pass and without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def kept(batches):
        m = sent.value
        for batch in batches:
            keep = [m.score(t.as_py() or "") < threshold for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def op5_toxicity(spark, sf_dir):
    """Labels are learnt only from rows whose crc32 of the id leaves a rest modulo 5.

    One row for each row of ``documents``, null ids and repeats included; an empty table gives none. Without labels of both kinds
    the score is their smoothed share.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_rest(F.col("doc_id"), 5) == 0
    model = fit(docs, labels, ~held_out)
    found = score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
