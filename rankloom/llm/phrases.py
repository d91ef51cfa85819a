"""Collocations: phrases of two to five words that occur more often than their parts suggest.

A phrase's score is its lowest cut: 1000 a n / (l r), with a, l and r the counts of the phrase and of its two
parts. As no phrase is more frequent than its rest, cutting after the first word shows that no
phrase with the first word w scores above 1000 n / f(w): the count of a prefix bounds all that grows from it. So frequent pairs are counted, and longer
phrases are grown from those with the highest bounds first, until no bound left reaches the last of a language's wanted scores.

Words travel as 64-bit numbers that are checked to tell all words apart; phrases are keyed by
the numbers of their words. Filters of keys only spare work: counts are of the keys themselves.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import removed, table, written
from .suffix_tree_lm import SLICE, bitmap, hasher, marked, pair_key, signed

#: Contract of the query: phrases of each language, and the least count of a candidate.
TOP, MIN_COUNT = 2_000, 100
LONGEST = 5
#: Of the pairs that may still grow, ordered by bound, a wave takes those up to this share of their occurrences; the last wave takes all.
WAVE_SHARE, WAVES = 0.5, 2
#: Rows that a task gathers before it adds them up.
GATHERED = 1 << 21
#: Separators of words within a piece, and characters that end a piece.
GAPS, STOPS = b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d"
KEYS = [f"w{k}" for k in range(1, LONGEST + 1)]
_TO_WORDS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?", b"abcdefghijklmnopqrstuvwxyz      ")


def _numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, langs: np.ndarray, seed: int) -> np.ndarray:
    """Numbers, never 0, of the words at the given places, in the languages with the given hashes."""
    if seed == 0:
        words = hasher().words(data, starts, ends)
    else:  # in case that two words have one number
        words = np.array([xxhash.xxh64_intdigest(data[a:b].tobytes().lower(), seed) for a, b in zip(starts, ends)], np.uint64)
    return np.maximum(pair_key(langs, words), np.uint64(1))


def _lang_hash(langs: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x, 11) for x in langs], np.uint64)


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def pieces(batch: pa.RecordBatch, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """From columns of languages and texts, for about SLICE bytes at a time: words, and whether the next word goes on in the same piece."""
    if not batch.num_rows:
        return
    kinds = np.zeros(256, np.uint8)
    kinds[list(GAPS)], kinds[list(STOPS)] = 1, 2
    langs, (data, offsets) = _lang_hash(batch.column(0).to_pylist()), _flat(batch.column(1))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE, "right")) - 1)
        part, edges = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        kind = kinds[part]
        solid = kind == 0
        opens, closes = solid.copy(), solid.copy()
        opens[1:] &= ~solid[:-1]
        closes[:-1] &= ~solid[1:]
        inner = edges[(edges > 0) & (edges < len(part))]
        opens[inner], closes[inner - 1] = solid[inner], solid[inner - 1]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        row = np.searchsorted(edges, starts, "right") - 1
        stops = np.cumsum(kind == 2, dtype=np.int32)[starts]
        goes_on = np.zeros(len(starts), bool)
        goes_on[:-1] = (row[1:] == row[:-1]) & (stops[1:] == stops[:-1])
        if len(starts):
            yield _numbers(part, starts, ends, langs[low:high][row], seed), goes_on
        low = high


class Gathered:
    """Columns of keys that are added up when there are enough of them; ``ends``: columns of which the least and the largest value are kept as well."""

    def __init__(self, keys: int, ends: int = 0) -> None:
        self.keys, self.parts, self.rows = keys, [[] for _ in range(keys + ends)], 0

    def add(self, *columns: np.ndarray) -> None:
        self.rows += len(columns[0])
        for part, c in zip(self.parts, columns):
            part.append(c)

    def taken(self) -> pa.RecordBatch:
        columns = [np.concatenate(p) for p in self.parts]
        self.parts, self.rows = [[] for _ in self.parts], 0
        mixed = columns[0]
        for c in columns[1 : self.keys]:
            mixed = pair_key(mixed, c)
        order = np.argsort(mixed)
        columns = [c[order] for c in columns]
        new = np.ones(len(order), bool)
        # Keys with one hash may alternate; then a key has several rows, which the sum over all tasks adds up.
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns[: self.keys]])
        at = np.flatnonzero(new)
        out = [signed(c[at]) for c in columns[: self.keys]] + [pa.array(np.diff(np.append(at, len(order))), pa.int64())]
        for c in columns[self.keys :]:
            out += [pa.array(f.reduceat(c.view(np.int64), at), pa.int64()) for f in (np.minimum, np.maximum)]
        return pa.RecordBatch.from_arrays(out, names=[f"c{k}" for k in range(len(out))])


def _scan(docs: DataFrame, keys: int, seed: int, found: Callable, ends: int = 0) -> DataFrame:
    """One pass over the texts: rows of ``found(words, goes_on)``, added up: ``w1 ..., a`` and, with ``ends``, the least and largest neighbours on both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Gathered(keys, ends)
        for batch in batches:
            for words, goes_on in pieces(batch, seed):
                for columns in found(words, goes_on):
                    rows.add(*columns)
                if rows.rows >= GATHERED:
                    yield rows.taken()
        if rows.rows:
            yield rows.taken()

    names = [*KEYS[:keys], "a", *(f"{f}{k}" for k in range(ends) for f in ("least", "most"))]
    sums = [F.sum("a").alias("a"), *(F.min(n) if n.startswith("least") else F.max(n) for n in names[keys + 1 :])]
    return docs.mapInArrow(run, ", ".join(f"{n} long" for n in names)).groupBy(*KEYS[:keys]).agg(*sums).toDF(*names)


def _chain(columns: list[np.ndarray]) -> np.ndarray:
    """One key from the words of a phrase."""
    key = columns[0]
    for c in columns[1:]:
        key = pair_key(key, c)
    return key


def _with_key(phrases: DataFrame) -> DataFrame:
    """Adds ``key``, the chain of the words that are not 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [c.to_numpy().view(np.uint64) for c in batch.columns]
            key = words[0]
            for c in words[1:]:
                key = np.where(c != 0, pair_key(key, c), key)
            yield pa.RecordBatch.from_arrays([*batch.columns, signed(key)], names=[*batch.schema.names, "key"])

    return phrases.mapInArrow(run, ", ".join(f"{c} long" for c in [*phrases.columns, "key"]))


def vocabulary(docs: DataFrame) -> DataFrame:
    """``lang, word, f`` from ``lang, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: dict[str, Counter]) -> pa.RecordBatch:
            flat = [(lang, word, n) for lang, c in found.items() for word, n in c.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat), (pa.string(), pa.binary(), pa.int64()))], names=["lang", "word", "f"])

        found: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                found.setdefault(lang, Counter()).update(text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split())
            if sum(map(len, found.values())) > GATHERED // 4:
                yield rows(found)
                found = {}
        if any(found.values()):
            yield rows(found)

    return docs.mapInArrow(run, "lang string, word binary, f long").groupBy("lang", F.col("word").cast("string").alias("word")).agg(F.sum("f").alias("f"))


def frequent_words(docs: DataFrame, min_count: int) -> tuple[DataFrame, int]:
    """``id, lang, word, f, n`` of words that occur often enough, and the seed with which their numbers belong to no other word."""
    words = written(vocabulary(docs))
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    for seed in count():

        def numbered(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = _flat(batch.column(1))
                ids = _numbers(data, offsets[:-1], offsets[1:], _lang_hash(batch.column(0).to_pylist()), seed)
                yield pa.RecordBatch.from_arrays([signed(ids), *batch.columns], names=["id", "lang", "word", "f"])

        ids = written(words.mapInArrow(numbered, "id long, lang string, word string, f long"))
        shared = ids.groupBy("id").agg(F.count(F.lit(1)).alias("words"), F.sum("f").alias("f")).where((F.col("words") > 1) & (F.col("f") >= min_count))
        if shared.isEmpty():
            out = written(ids.where(F.col("f") >= min_count).join(n, "lang").select("id", "lang", "word", "f", "n"))
            removed(words, ids)
            return out, seed


#: floor(1000 a n / (l r)), exact up to counts of 15 digits.
SCORE = "cast(a as decimal(15,0)) * cast(n as decimal(15,0)) * 1000BD div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))"


def _padded(phrases: DataFrame, size: int) -> DataFrame:
    """``w1 .. w5, a`` of phrases of up to ``size`` words."""
    return phrases.select(*(F.col(k) if n < size else F.lit(0).cast("long").alias(k) for n, k in enumerate(KEYS)), "a")


def _scored(phrases: DataFrame, known: DataFrame, words: DataFrame) -> DataFrame:
    """Adds ``lang, n, score, l, r`` of the lowest cut of ``w1 .. w5, a``, among the cuts whose parts have a count in ``known``."""
    none = F.lit(0).cast("long")

    def cut(k: int) -> Column:
        left = [(F.col(w) if i < k else none).alias(f"x{i + 1}") for i, w in enumerate(KEYS)]
        right = [(F.col(KEYS[i + k]) if i + k < LONGEST else none).alias(f"y{i + 1}") for i in range(LONGEST)]
        return F.struct(F.lit(k).alias("k"), *left, *right)

    cuts = phrases.select(*KEYS, "a", F.inline(F.filter(F.array(*map(cut, range(1, LONGEST))), lambda c: c["y1"] != 0)))
    l, r = (known.toDF(*(f"{side}{i}" for i in range(1, LONGEST + 1)), part) for side, part in (("x", "l"), ("y", "r")))
    cuts = cuts.join(l, [f"x{i}" for i in range(1, LONGEST + 1)]).join(r, [f"y{i}" for i in range(1, LONGEST + 1)])
    cuts = cuts.join(words.select(F.col("id").alias("w1"), "lang", "n"), "w1").withColumn("score", F.expr(SCORE))
    lowest = cuts.groupBy(*KEYS, "a", "lang", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", *KEYS, "a", "n", "cut.score", "cut.l", "cut.r")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP, min_count: int = MIN_COUNT) -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A candidate occurs ``min_count`` times within pieces of text. It is dropped if a longer candidate that contains it is
    as frequent, which is so if and only if all its occurrences have the same word before them or the same word after them. Candidates are ordered by
    score and count, both descending, and phrase; all ties of the last score are looked at.

    Each pass over the texts adds up rows in its tasks, so frequent phrases are small, and tables of phrases are joined as
    tables. Only filters of keys, at most 64 MB each, pass through the driver. Null text counts as empty, a null language as ``und``; rows that repeat count each time; other columns
    are ignored; without candidates there are no rows.
    """
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words, seed = frequent_words(texts, min_count)
    enough = F.col("a") >= min_count
    word_bits = sc.broadcast(bitmap(words, "id"))

    def two(w: np.ndarray, goes_on: np.ndarray):
        ok = marked(word_bits.value, w)
        at = np.flatnonzero(goes_on[:-1] & ok[:-1] & ok[1:])
        yield w[at], w[at + 1]

    counted = written(_scan(texts, 2, seed, two).where(enough))
    word_bits.unpersist()
    keyed = _with_key(counted.select("w1", "w2")).join(words.select(F.col("id").alias("w1"), "lang", F.expr("cast(n as decimal(15,0)) * 1000BD div f").alias("bound")), "w1")
    pairs = written(keyed)
    pair_bits = sc.broadcast(bitmap(pairs, "key"))

    def good_pairs(w: np.ndarray, goes_on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Key of each word with the next one, and whether that may be a frequent pair."""
        at = np.flatnonzero(goes_on)
        key, good = np.zeros(len(w), np.uint64), np.zeros(len(w), bool)
        key[at] = pair_key(w[at], w[at + 1])
        good[at] = marked(pair_bits.value, key[at])
        return key, good

    def runs(good: np.ndarray, size: int) -> np.ndarray:
        """Starts of ``size`` words of which each two neighbours may be a frequent pair."""
        if len(good) < size:
            return np.zeros(0, np.int64)
        ok = good[: len(good) - size + 1].copy()
        for k in range(1, size - 1):
            ok &= good[k : len(good) - size + 1 + k]
        return np.flatnonzero(ok)

    def asked_for(phrases: DataFrame) -> DataFrame:
        """``w1 .. w4, a`` and the neighbours of the given phrases of two to four words, counted in all texts."""
        keyed = written(_with_key(phrases.select(*KEYS[:4]).distinct()))
        bits = sc.broadcast(bitmap(keyed, "key"))

        def found(w: np.ndarray, goes_on: np.ndarray):
            key, good = good_pairs(w, goes_on)
            before = np.append(np.uint64(0), np.where(goes_on[:-1], w[:-1], np.uint64(0)))
            after = np.append(np.where(goes_on[:-1], w[1:], np.uint64(0)), np.uint64(0))
            for size in (2, 3, 4):
                at = runs(good, size)
                chain = key[at]
                for k in range(2, size):
                    chain = pair_key(chain, w[at + k])
                at = at[marked(bits.value, chain)]
                own = [w[at + k] if k < size else np.zeros(len(at), np.uint64) for k in range(4)]
                yield *own, before[at], after[at + size - 1]

        out = written(_scan(texts, 4, seed, found, ends=2).join(keyed.drop("key"), KEYS[:4], "left_semi"))
        bits.unpersist()
        removed(keyed)
        return out

    def least_of(survivors: DataFrame | None) -> DataFrame | None:
        """``lang, least``: the last of the wanted scores so far, where there are so many."""
        if survivors is None:
            return None
        nth = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score")))
        return written(survivors.select("lang", "score", nth.alias("nth")).where(F.col("nth") <= top).where(F.col("nth") == top).select("lang", F.col("score").alias("least")))

    def open_still(rows: DataFrame, bound: str, survivors: DataFrame | None) -> DataFrame:
        """The rows whose bound reaches the last of the wanted scores so far."""
        least = least_of(survivors)
        return rows if least is None else rows.join(least, "lang", "left").where(F.col("least").isNull() | (F.col(bound) >= F.col("least"))).drop("least")

    def checked(hopeful: DataFrame, known: DataFrame) -> DataFrame:
        """The surviving ones of candidates, with their scores."""
        rests = [F.array(*(F.col(KEYS[i]) if i < LONGEST else F.lit(0).cast("long") for i in range(k, k + 4))) for k in range(LONGEST - 2)]
        # All parts of three words or four that are not known by growth, and the phrase itself if it may be part of a longer one.
        wanted = hopeful.select(F.explode(F.array(F.when(F.col("w5") == 0, rests[0]), *(F.when(F.col(KEYS[k + 2]) != 0, rests[k]) for k in range(1, LONGEST - 2)))).alias("p")).where("p is not null")
        found = asked_for(wanted.select(*(F.col("p")[i].alias(KEYS[i]) for i in range(4))))
        full = _scored(hopeful.select(*KEYS, "a"), known.unionByName(_padded(found.where("w3 <> 0"), 4)), words)
        inside = found.where("(least0 = most0 and least0 <> 0) or (least1 = most1 and least1 <> 0)").select(*KEYS[:4], F.lit(0).cast("long").alias("w5"))
        return written(full.join(inside, KEYS, "left_anti"))

    def settled(phrases: DataFrame, known: DataFrame, survivors: DataFrame | None) -> DataFrame | None:
        """Adds to the survivors those of new candidates, the most hopeful ones first, until the others can't reach the wanted scores."""
        hopeful, size = written(_scored(phrases, known, words)), 2 * top
        while True:
            hopeful = written(open_still(hopeful, "score", survivors).withColumn("nth", F.rank().over(W.partitionBy("lang").orderBy(F.desc("score")))))
            if hopeful.isEmpty():
                return survivors
            found = checked(hopeful.where(F.col("nth") <= size), known)
            survivors = found if survivors is None else survivors.unionByName(found)
            hopeful, size = hopeful.where(F.col("nth") > size).drop("nth"), 2 * size

    known = _padded(words.select(F.col("id").alias("w1"), F.col("f").alias("a")), 1).unionByName(_padded(counted, 2))
    survivors = settled(_padded(counted, 2), known, None)
    if survivors is None:  # no frequent pair
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    middle = written(pairs.groupBy("lang").agg(F.percentile_approx("bound", 1 - WAVE_SHARE).alias("middle")))
    for wave in range(WAVES):
        frontier = open_still(pairs, "bound", survivors).join(middle, "lang").where("bound >= middle" if wave == 0 else "bound < middle")
        grown = _grown(texts, written(frontier.select("w1", "w2", "key")), seed, enough, good_pairs, runs)
        if grown is not None:
            known = known.unionByName(grown)
            survivors = settled(grown, known, survivors)
    return _ranked(survivors, words, top)


def _grown(texts: DataFrame, frontier: DataFrame, seed: int, enough: Column, good_pairs: Callable, runs: Callable) -> DataFrame | None:
    """``w1 .. w5, a`` of all frequent phrases of three to five words that begin with the pairs of the frontier."""
    if frontier.isEmpty():
        return None
    sc = texts.sparkSession.sparkContext
    bits = sc.broadcast(bitmap(frontier, "key"))

    def three(w: np.ndarray, goes_on: np.ndarray):
        key, good = good_pairs(w, goes_on)
        at = runs(good, 3)
        at = at[marked(bits.value, key[at])]
        yield w[at], w[at + 1], w[at + 2]

    triples = written(_scan(texts, 3, seed, three).where(enough).join(frontier, KEYS[:2], "left_semi"))
    bits.unpersist()
    if triples.isEmpty():
        return None
    more = sc.broadcast(bitmap(written(_with_key(triples.select(*KEYS[:3]))), "key"))

    def longer(w: np.ndarray, goes_on: np.ndarray):
        key, good = good_pairs(w, goes_on)
        at = runs(good, 4)
        at = at[marked(more.value, pair_key(key[at], w[at + 2]))]
        fifth = np.where(good[at + 3], w[np.minimum(at + 4, len(w) - 1)], np.uint64(0))
        yield w[at], w[at + 1], w[at + 2], w[at + 3], fifth

    longest = written(_scan(texts, 5, seed, longer).join(triples, KEYS[:3], "left_semi"))
    more.unpersist()
    fours = longest.groupBy(*KEYS[:4]).agg(F.sum("a").alias("a")).where(enough)
    return written(_padded(triples, 3).unionByName(_padded(fours, 4)).unionByName(longest.where("w5 <> 0").where(enough)))


def _ranked(survivors: DataFrame, words: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language, with their words; before words are joined, all that score less than the last one go."""
    nth = F.rank().over(W.partitionBy("lang").orderBy(F.desc("score")))
    rows = survivors.withColumn("nth", nth).where(F.col("nth") <= top).drop("nth")
    spelled = rows.select("*", F.posexplode(F.array(*KEYS)).alias("at", "id")).where("id <> 0").join(words.select("id", "word"), "id")
    phrases = spelled.groupBy("lang", *KEYS, "a", "l", "r", "n", "score").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("parts"))
    phrases = phrases.withColumn("phrase", F.array_join(F.col("parts.word"), " "))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return phrases.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark, sf_dir):
    """Contract of op11; see ``collocations``."""
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS ws FROM p
), n AS (
  SELECT lang, CAST(sum(len(ws)) AS HUGEINT) AS n FROM w GROUP BY 1
), k AS (
  SELECT lang, ws, unnest(range(1, CAST(len(ws) AS BIGINT) + 1)) AS i FROM w
), g AS (
  SELECT lang, ws, i, unnest(range(1, least(5, CAST(len(ws) AS BIGINT) - i + 1) + 1)) AS size FROM k
), c AS (
  SELECT lang, array_to_string(ws[i:i + size - 1], ' ') AS phrase, size, CAST(count(*) AS HUGEINT) AS a FROM g GROUP BY ALL HAVING count(*) >= 100
), s AS (
  SELECT *, string_split(phrase, ' ') AS ws FROM c WHERE size > 1
), u AS (
  SELECT *, unnest(range(1, size)) AS cut FROM s
), v AS (
  SELECT u.lang, u.phrase, u.a, u.cut, x.a AS l, y.a AS r, n.n, 1000 * u.a * n.n // (x.a * y.a) AS score,
         row_number() OVER (PARTITION BY u.lang, u.phrase ORDER BY 1000 * u.a * n.n // (x.a * y.a), u.cut) AS nth
  FROM u JOIN n USING (lang) JOIN c x ON x.lang = u.lang AND x.phrase = array_to_string(u.ws[1:u.cut], ' ') JOIN c y ON y.lang = u.lang AND y.phrase = array_to_string(u.ws[u.cut + 1:], ' ')
), inner_parts AS (
  SELECT lang, a, array_to_string(ws[2:], ' ') AS phrase FROM s UNION SELECT lang, a, array_to_string(ws[:size - 1], ' ') FROM s
), z AS (
  SELECT v.*, row_number() OVER (PARTITION BY v.lang ORDER BY v.score DESC, v.a DESC, encode(v.phrase)) AS rank FROM v
  WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM inner_parts q WHERE q.lang = v.lang AND q.phrase = v.phrase AND q.a >= v.a)
)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM z WHERE rank <= 2000
"""
