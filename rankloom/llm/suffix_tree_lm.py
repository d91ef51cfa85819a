"""Language-model scoring by a probabilistic suffix tree over words.

States are contexts of no, one or two preceding words. The root is the add-one
unigram model. A longer context becomes a state if what follows it in training
diverges from what its suffix predicts. A token is scored by the longest suffix of its
history that is a state.

Below a state, symbols are listed that followed it at least MIN_COUNT times and whose log
likelihood ratio against the parent is large; they get probability (c - 1/2) / (n + 1).
All others share what is left in proportion to the parent's distribution, so every
state is a proper distribution. Hence a text's log probability is a sum of
independent terms: one of the root for each token, one for each state met, and one for
each listed symbol met there. The model is one table of keys and terms, and scoring
is one join and a sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_rest, removed, table, written

#: Entries of the model that are broadcast, those met most often; the others are joined.
HOT_ENTRIES = 1 << 20
#: Places of the table in which a task finds them: 16 MB.
PLACES = 1 << 22
#: Most bits of the filters that tell which keys matter: 64 MB.
FILTER_BITS = 1 << 29
#: From which bits of a key its two places in a filter are taken.
FILTER_SHIFTS = (0, 26)
#: A pair or triple of words counts if it is met so often.
MIN_COUNT = 2
#: Least log likelihood ratio (nats) of a listed symbol, and of a state.
SYMBOL_GAIN, STATE_GAIN = 4.0, 10.0
#: Sets the key of a context's state apart from the key of the context.
STATE_MARK = 0x1B87359351ED270B
#: Texts are scored, triples counted, and contexts of two words tested in so many parts, one after the other, each of which clears its shuffle files: this bounds disk alone.
SCORE_PARTS, TRIPLE_PARTS, CONTEXT_PARTS = 4, 2, 3
#: Bytes of text that ``phrases`` handles at a time, and those that are handled here, where a token takes more room.
SLICE, TEXT_SLICE = 1 << 20, 1 << 18
#: Bytes whose words are hashed at a time, and the length from which a word is hashed by itself.
WINDOW = 1 << 17
#: Fixed odd numbers of the key of a pair, and what undoes them.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9)
INVERSES = tuple(pow(f, -1, 1 << 64) for f in FACTORS)
ADDED = (0x51ED270B, 0x2545F491)


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of context ``a`` (a word or again such a hash) with the word ``b`` after it."""
    with np.errstate(over="ignore"):
        x = (a + np.uint64(ADDED[0])) * np.uint64(FACTORS[0]) ^ (b + np.uint64(ADDED[1])) * np.uint64(FACTORS[1])
        x ^= x >> np.uint64(29)
        x *= np.uint64(FACTORS[2])
        return x ^ (x >> np.uint64(32))


def second_of_pair(key: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The ``b`` of ``pair_key(a, b)``."""
    with np.errstate(over="ignore"):
        x = (key ^ (key >> np.uint64(32))) * np.uint64(INVERSES[2])
        x ^= (x >> np.uint64(29)) ^ (x >> np.uint64(58))
        return (x ^ (a + np.uint64(ADDED[0])) * np.uint64(FACTORS[0])) * np.uint64(INVERSES[1]) - np.uint64(ADDED[1])


def triple_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Key of three words from the keys of their two pairs."""
    return first ^ (second << np.uint64(1) | second >> np.uint64(63))


def second_of_triple(key: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The ``second`` of ``triple_key(first, second)``."""
    x = key ^ first
    return x >> np.uint64(1) | x << np.uint64(63)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


class Hasher:
    """Hashes of lower-cased (A-Z) words, for many texts at a time.

    A word's hash is the sum of a fixed random number for each byte times a power that its place in the
    word gives, modulo 2^64, and then mixed. So differences of one running sum give all words.
    """

    def __init__(self) -> None:
        rng = np.random.default_rng(7)
        self.of_byte = rng.integers(0, 1 << 64, 256, np.uint64)
        self.of_byte[65:91] = self.of_byte[97:123]
        base = int(rng.integers(0, 1 << 63)) * 2 + 1
        with np.errstate(over="ignore"):
            self.up, self.down = (np.cumprod(np.append(np.uint64(1), np.full(WINDOW, x, np.uint64))) for x in (base, pow(base, -1, 1 << 64)))
        self.end = np.uint64(rng.integers(0, 1 << 64, dtype=np.uint64))

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the words that start and end at the given places of ``data``."""
        out, low = np.empty(len(starts), np.uint64), 0
        while low < len(starts):
            first = starts[low]
            high = low + int(np.searchsorted(ends[low:], first + WINDOW, "right"))
            if high == low:  # one word of over WINDOW bytes
                out[low] = xxhash.xxh64_intdigest(data[first : ends[low]].tobytes().lower(), 7)
                low += 1
                continue
            with np.errstate(over="ignore"):
                sums = self.of_byte[data[first : ends[high - 1]]]
                sums *= self.up[: len(sums)]
                sums = np.cumsum(sums)
                at, to = starts[low:high] - first, ends[low:high] - first
                h = (sums[to - 1] - np.where(at > 0, sums[at - 1], np.uint64(0))) * self.down[at]
                h ^= h >> np.uint64(31)
                h *= np.uint64(FACTORS[2])
                out[low:high] = h ^ (h >> np.uint64(29))
            low = high
        return out

    def of_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the texts that lie in ``data`` between ``offsets``, one after the other, and their numbers: words, then one end each."""
        solid = (data != 32) & ((data < 9) | (data > 13))
        opens, closes = solid.copy(), solid.copy()
        opens[1:] &= ~solid[:-1]
        closes[:-1] &= ~solid[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        opens[edges] = solid[edges]
        closes[edges - 1] = solid[edges - 1]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        upto = np.searchsorted(starts, offsets)
        sizes = np.diff(upto)
        tokens = np.full(len(starts) + len(sizes), self.end, np.uint64)
        tokens[np.arange(len(starts)) + np.repeat(np.arange(len(sizes)), sizes)] = self.words(data, starts, ends)
        return tokens, sizes + 1

    def tokens(self, text: str | None) -> np.ndarray:
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        return self.of_bytes(data, np.array([0, len(data)]))[0]

    def of_column(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Parts of a column, each of about TEXT_SLICE bytes or one longer text: number of the first row, tokens, tokens of each row."""
        texts = texts.cast(pa.large_string()).fill_null("")
        _, offsets, data = texts.buffers()
        if not len(texts):
            return
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + TEXT_SLICE, "right")) - 1)
            part = data[offsets[low] : offsets[high]]
            yield low, *self.of_bytes(part, offsets[low : high + 1] - offsets[low])
            low = high


@lru_cache(maxsize=1)
def hasher() -> Hasher:
    """One per Python process. Its tables are made where they are used: as a value, they would travel with each task's function."""
    return Hasher()


def bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap with two bits set for each id of a column: 16 bits or more for each, from 128 KB up to 64 MB."""
    size = min(FILTER_BITS, 1 << max(20, (16 * ids.count()).bit_length()))
    at = F.explode(F.array(*(F.pmod(F.shiftright(column, by), F.lit(size)) + 1 for by in FILTER_SHIFTS)))
    rows = ids.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    bits = np.zeros(size // 8, np.uint8)
    for r in rows:
        bits[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return bits


def marked(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    found = np.ones(len(ids), np.uint8)
    for by in FILTER_SHIFTS:
        at = (ids >> np.uint64(by) & np.uint64(8 * len(bits) - 1)).astype(np.int64)
        found &= bits[at >> 3] >> (at & 7).astype(np.uint8)
    return found > 0


def buckets_for(texts: DataFrame, share: int = 1 << 22, least: int = 256) -> int:
    """Number of shares, a power of two, into which keys are dealt: one for each ``share`` bytes of text, so that a share fits in a task."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(least, 1 << (size // share).bit_length())


def _planes(x: np.ndarray) -> bytes:
    """Bytes of numbers, all lowest ones first, which compresses well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _numbers(raw: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Places at which a new number starts."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])


DEALT = "share long, keys binary, counts binary, contexts binary"


def dealt(buckets: int, kind: int, keys: np.ndarray, n: np.ndarray, contexts: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of ``DEALT``: sorted distinct keys of one kind (0 or 1) with counts, cut by their first bits, as differences."""
    cuts = np.searchsorted(keys, (np.arange(1, buckets, dtype=np.uint64) << np.uint64(64 - buckets.bit_length() + 1)))
    cuts = [0, *cuts.tolist(), len(keys)]
    rows: list[tuple] = []
    held = 0
    for share, (low, high) in enumerate(zip(cuts, cuts[1:])):
        if low < high:
            own = keys[low:high]
            rows.append((2 * share + kind, _planes(np.diff(own, prepend=np.uint64(0))), _planes(n[low:high].astype(np.uint32)), b"" if contexts is None else _planes(contexts[low:high])))
            held += high - low
        if rows and (held > 200_000 or high == len(keys)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["share", "keys", "counts", "contexts"])
            rows, held = [], 0


def added_up(shares: pa.Table) -> tuple[int, np.ndarray, np.ndarray, np.ndarray | None]:
    """Kind, distinct keys, their counts, and their contexts, of the rows of one share."""
    cols = {c: shares.column(c).to_pylist() for c in ("keys", "counts", "contexts")}
    keys = np.concatenate([np.cumsum(_numbers(k, np.uint64), dtype=np.uint64) for k in cols["keys"]])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = _firsts(keys)
    n = np.add.reduceat(np.concatenate([_numbers(c, np.uint32) for c in cols["counts"]]).astype(np.int64)[order], first)
    contexts = np.concatenate([_numbers(c, np.uint64) for c in cols["contexts"]])
    return shares.column("share")[0].as_py() & 1, keys[first], n, contexts[order[first]] if len(contexts) else None


def count_words_and_pairs(texts: DataFrame, buckets: int, held: int = 2_000_000) -> DataFrame:
    """``key, n``: counts of recurring pairs of neighbours, and of words with a minus sign. Each task adds up about ``held`` tokens at a time.

    Keys travel in shares by their first bits, sorted and as differences, which takes about a fifth of the room of rows. A
    share is a fixed part of all keys, and a task meets a key once for each time it adds up, so hot words are not heavy.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[np.ndarray]] = [[], []]
        size = 0

        def out():
            nonlocal size
            for kind in (0, 1):
                parts, found[kind] = found[kind], []
                if parts:
                    keys = np.concatenate(parts)
                    parts.clear()
                    keys.sort()
                    first = _firsts(keys)
                    yield from dealt(buckets, kind, keys[first], np.diff(first, append=len(keys)))
                    del keys, first
            size = 0

        for batch in batches:
            for _, t, sizes in hasher().of_column(batch.column(0)):
                within = np.ones(len(t), bool)
                within[np.cumsum(sizes) - 1] = False
                found[0].append(t)
                found[1].append(pair_key(t[:-1], t[1:])[within[:-1]])
                size += len(t)
                if size >= held:
                    yield from out()
        yield from out()

    def add(shares: pa.Table) -> pa.Table:
        kind, keys, n, _ = added_up(shares)
        if kind:
            keys, n = keys[n >= MIN_COUNT], n[n >= MIN_COUNT]
        return pa.table({"key": signed(keys), "n": pa.array(n if kind else -n)})

    return texts.mapInArrow(run, DEALT).groupBy("share").applyInArrow(add, "key long, n long")


def count_triples(texts: DataFrame, sent: Broadcast, buckets: int, part: int = 0, parts: int = 1, held: int = 1_500_000) -> DataFrame:
    """``key, context, other, n, pair`` of what the broadcast filter of recurring pairs lets through, if it recurs.

    Of the keys only every ``parts``-th is counted, those that leave a rest of ``part``.

    A ``pair`` has its first word as ``context`` and its second as ``other``. A word after a pair has the
    pair as ``context`` and the pair of the last two words as ``other``; both pairs recur, as they must if
    the three words do. ``other`` follows from the key and the context, so it does not travel.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        found: list[list[tuple]] = [[], []]
        size = 0

        def out():
            nonlocal size
            for kind in (0, 1):
                parts, found[kind] = found[kind], []
                if parts:
                    k, c = (np.concatenate([f[i] for f in parts]) for i in range(2))
                    parts.clear()
                    order = np.argsort(k)
                    k = k[order]
                    first = _firsts(k)
                    n, c = np.diff(first, append=len(k)), c[order[first]]
                    k = k[first]
                    del order, first
                    yield from dealt(buckets, kind, k, n, c)
                    del k, n, c
            size = 0

        for batch in batches:
            for _, t, sizes in hasher().of_column(batch.column(0)):
                pairs = pair_key(t[:-1], t[1:])
                hit = marked(bits, pairs)
                hit[np.cumsum(sizes)[:-1] - 1] = False
                at = np.flatnonzero(hit)
                both = np.flatnonzero(hit[:-1] & hit[1:])
                for kind, keys, contexts in ((0, triple_key(pairs[both], pairs[both + 1]), pairs[both]), (1, pairs[at], t[at])):
                    own = keys % np.uint64(parts) == part
                    found[kind].append((keys[own], contexts[own]))
                    size += int(own.sum())
                if size >= held:
                    yield from out()
        yield from out()

    def add(shares: pa.Table) -> pa.Table:
        kind, keys, n, contexts = added_up(shares)
        often = n >= MIN_COUNT
        keys, n, contexts = keys[often], n[often], contexts[often]
        other = (second_of_pair if kind else second_of_triple)(keys, contexts)
        return pa.table({"key": signed(keys), "context": signed(contexts), "other": signed(other), "n": pa.array(n), "pair": pa.array(np.full(len(n), kind > 0))})

    return texts.mapInArrow(run, DEALT).groupBy("share").applyInArrow(add, "key long, context long, other long, n long, pair boolean")


def states(followed: DataFrame, totals: DataFrame, symbol_gain: float, state_gain: float) -> DataFrame:
    """Listed symbols of the contexts that pass the divergence test: ``context, key, n, p, parent_p, rest, total``.

    ``followed``: ``context, key, n, parent_p`` ; ``totals``: ``context, total``. ``rest`` is the
    factor of symbols that are not listed. The test adds up n times the log of p over the
    parent's probability of the listed symbols, and the log of ``rest`` for the other occurrences.
    """
    rows = followed.join(totals, "context").withColumn("p", (F.col("n") - 0.5) / (F.col("total") + 1.0))
    # Few symbols are listed. They are written, so that the joins above are not made for the sums and again for the rows, and their shuffle files go.
    rows = written(rows.withColumn("gain", F.col("n") * F.log(F.col("p") / F.col("parent_p"))).where(F.col("gain") >= symbol_gain))
    sums = rows.groupBy("context").agg(F.sum("p").alias("ps"), F.sum("parent_p").alias("qs"), F.sum("gain").alias("gains"), (F.first("total") - F.sum("n")).alias("others"))
    sums = sums.where("ps < 1 and qs < 1").withColumn("rest", (1.0 - F.col("ps")) / (1.0 - F.col("qs")))
    kept = sums.where(F.col("gains") + F.col("others") * F.log("rest") >= state_gain)
    found = written(rows.drop("gain").join(kept.select("context", "rest"), "context"))
    removed(rows)
    return found


def train(docs: DataFrame, usable: Column, text_col: str = "text", symbol_gain: float = SYMBOL_GAIN, state_gain: float = STATE_GAIN) -> tuple[DataFrame, int, int]:
    """The model as ``key, term, seen, word`` (a written table), the number of training tokens, and of distinct ones.

    ``term`` is what a key adds to a log10 probability: for a word, its root probability; for a
    state, the factor of what is not listed; for a listed symbol, what it has beyond that
    factor. ``seen`` is how often the key was met in training; ``word`` tells the words.

    Counts cover all usable rows, in two passes: words and pairs, then triples of recurring pairs.
    """
    texts = docs.where(usable).select(F.col(text_col).cast("string").alias("text"))
    buckets = buckets_for(texts)
    counted = written(count_words_and_pairs(texts, buckets))
    words = counted.where("n < 0").select("key", (-F.col("n")).alias("m"))
    pairs = counted.where("n > 0")
    n_tokens, n_words = (int(x or 0) for x in words.agg(F.sum("m"), F.count(F.lit(1))).first())
    root_p = (F.col("m") + 1) / F.lit(float(n_tokens + n_words + 1))
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(pairs, "key"))
    sliced = [written(count_triples(texts, sent, buckets, i, TRIPLE_PARTS)) for i in range(TRIPLE_PARTS)]
    sent.destroy()
    longer = reduce(DataFrame.unionByName, sliced)

    first = longer.where("pair").select("key", "context", "other", "n")
    first = written(first.join(words.select(F.col("key").alias("other"), root_p.alias("root_p")), "other").select("context", "key", "n", "root_p"))
    one = states(first.withColumnRenamed("root_p", "parent_p"), words.select(F.col("key").alias("context"), F.col("m").alias("total")), symbol_gain, state_gain)

    # What the parent of a two-word context says: listed below its last word's state, or the root's share times that state's factor.
    factors = one.select("context", "rest").distinct()
    parents = first.join(factors, "context", "left").join(one.select("key", "p"), "key", "left")
    parents = written(parents.select(F.col("key").alias("other"), F.coalesce("p", F.col("root_p") * F.coalesce("rest", F.lit(1.0))).alias("parent_p")))
    removed(first)
    totals = pairs.select(F.col("key").alias("context"), F.col("n").alias("total"))
    of_part = F.pmod(F.xxhash64("context"), F.lit(CONTEXT_PARTS))
    tested = []
    for i in range(CONTEXT_PARTS):
        second = longer.where(~F.col("pair") & (of_part == i)).join(parents, "other").select("context", "key", "n", "parent_p")
        tested.append(states(second, totals.where(of_part == i), symbol_gain, state_gain))
    two = reduce(DataFrame.unionByName, tested)

    model = words.select("key", F.log10(root_p).alias("term"), F.col("m").alias("seen"), F.lit(True).alias("word"))
    for level in (one, two):
        state = level.select("context", "rest", "total").distinct()
        model = model.unionByName(state.select(F.col("context").bitwiseXOR(F.lit(STATE_MARK)).alias("key"), F.log10("rest").alias("term"), F.col("total").alias("seen"), F.lit(False).alias("word")))
        model = model.unionByName(level.select("key", (F.log10(F.col("p") / F.col("parent_p")) - F.log10("rest")).alias("term"), F.col("n").alias("seen"), F.lit(False).alias("word")))
    model = written(model)
    removed(counted, *sliced, parents, one, *tested)
    return model, n_tokens, n_words


def hot_entries(model: DataFrame, most: int = HOT_ENTRIES) -> DataFrame:
    """The entries met most often, at most ``most``: down to a count that a histogram of counts gives."""
    step = F.floor(F.log2(F.col("seen")) * 8)
    sizes = model.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("step").desc()).collect()
    left, least = most, None
    for r in sizes:  # a few hundred rows: eight to a doubling
        left -= r["n"]
        if left < 0:
            break
        least = r["step"]
    return model.where(F.lit(False) if least is None else step >= least)


def score(docs: DataFrame, model: DataFrame, n_tokens: int, n_words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` of every row and whole text.

    Frequent entries of the model are broadcast, and what they contribute is added up in
    place. Words that are not among them, and contexts that a filter of fixed size
    does not rule out, leave as keys with counts and meet the model in a join; as
    frequent keys are gone, none of them is hot. Texts are scored in SCORE_PARTS parts by a hash of
    their ids, so that the keys of one part are on disk at a time; the result is written.
    """
    sc = docs.sparkSession.sparkContext
    rows = hot_entries(model).orderBy("seen", "key").select("key", "term").toArrow()
    hot = {c: rows.column(c).to_numpy() for c in ("key", "term")}
    hot["bits"] = bitmap(model.where("not word"), "key")
    sent = sc.broadcast(hot)
    unknown = float(np.log10(1.0 / (n_tokens + n_words + 1)))
    names = ["row", "doc_id", "key", "word", "times", "n_tokens", "n_known", "base", "more"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = sent.value
        number = (TaskContext.get().partitionId() << 33) if TaskContext.get() else 0

        known_keys = np.append(h["key"], 0).view(np.uint64)
        places = np.full(PLACES, len(h["key"]), np.int32)
        shift = np.uint64(64 - PLACES.bit_length() + 1)
        # Where two entries want a place, the one met more often gets it; the other is left to the join.
        places[known_keys[:-1] >> shift] = np.arange(len(h["key"]), dtype=np.int32)

        def looked_up(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = places[keys >> shift]
            return (known_keys[at] == keys) & (at < len(h["key"])), at

        for batch in batches:
            for low, t, sizes in hasher().of_column(batch.column(1)):
                who = np.repeat(np.arange(len(sizes)), sizes)
                place = np.arange(len(t)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                pairs = np.zeros(len(t), np.uint64)
                pairs[1:] = pair_key(t[:-1], t[1:])
                i1, i2 = np.flatnonzero(place >= 1), np.flatnonzero(place >= 2)
                mark = np.uint64(STATE_MARK)
                ones, twos = t[i1 - 1] ^ mark, pairs[i2 - 1] ^ mark
                listed = [pairs[i1], triple_key(pairs[i2 - 1], pairs[i2])]
                # A symbol can be listed only below a state.
                met = [marked(h["bits"], ones), marked(h["bits"], twos)]
                also = [m & marked(h["bits"], k) for m, k in zip(met, listed)]
                keys = np.concatenate([ones[met[0]], listed[0][also[0]], twos[met[1]], listed[1][also[1]]])
                whose = np.concatenate([who[i1[met[0]]], who[i1[also[0]]], who[i2[met[1]]], who[i2[also[1]]]])
                hit, at = looked_up(keys)
                more = np.bincount(whose[hit], h["term"][at[hit]], len(sizes)).astype(float)
                found, where = looked_up(t)
                base = np.bincount(who[found], h["term"][where[found]], len(sizes)).astype(float)
                known = np.bincount(who[found], minlength=len(sizes)).astype(np.int64)
                lone = [(t[~found].view(np.int64), who[~found], True), (keys[~hit].view(np.int64), whose[~hit], False)]
                out = {n: [c] for n, c in zip(names, (np.arange(len(sizes)), None, np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool), np.zeros(len(sizes), np.int64), sizes, known, base, more))}
                for k, w, is_word in lone:
                    order = np.lexsort((k, w))
                    k, w = k[order], w[order]
                    first = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (w[1:] != w[:-1]))[: len(k)])
                    n = np.diff(first, append=len(k))
                    m = len(n)
                    for name, c in (("row", w[first]), ("key", k[first]), ("word", np.full(m, is_word)), ("times", n), *((x, np.zeros(m, out[x][0].dtype)) for x in ("n_tokens", "n_known", "base", "more"))):
                        out[name].append(c)
                cols = {n: np.concatenate(c) for n, c in out.items() if n != "doc_id"}
                ids = batch.column(0).take(pa.array(cols["row"] + low))
                cols["row"] = cols["row"] + number
                number += len(sizes)
                arrays = [ids if n == "doc_id" else pa.array(cols[n]) for n in names]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    of_part = F.pmod(F.xxhash64("doc_id"), F.lit(SCORE_PARTS))
    scored = [written(_scored_part(texts.where(of_part == i), run, model, unknown)) for i in range(SCORE_PARTS)]
    sent.destroy()
    return reduce(DataFrame.unionByName, scored)


def _scored_part(texts: DataFrame, run, model: DataFrame, unknown: float) -> DataFrame:
    parts = texts.mapInArrow(run, "row long, doc_id long, key long, word boolean, times long, n_tokens long, n_known long, base double, more double")
    entries = model.select(F.col("key").alias("_key"), "term", F.col("word").alias("_word")).hint("shuffle_hash")
    # Rows that only carry sums ask for no key.
    asks = F.when(F.col("times") > 0, F.col("key")).otherwise(F.xxhash64("row"))
    joined = parts.withColumn("key", asks).join(entries, (F.col("key") == F.col("_key")) & (F.col("word") == F.col("_word")) & (F.col("times") > 0), "left")
    met = F.col("term").isNotNull()
    word = F.col("word") & (F.col("times") > 0)
    base = F.col("base") + F.when(word, F.col("times") * F.coalesce("term", F.lit(unknown))).otherwise(F.lit(0.0))
    more = F.col("more") + F.when(~word & met, F.col("times") * F.col("term")).otherwise(F.lit(0.0))
    sums = joined.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(word & met, F.col("times")).otherwise(F.lit(0))).alias("n_known"),
        F.sum(base).alias("base_score"),
        F.sum(more).alias("more"),
    )
    return sums.select("doc_id", "n_tokens", "n_known", "base_score", (F.col("base_score") + F.col("more")).alias("score"))


def op3_suffix_tree_lm(spark, sf_dir):
    """Learns from documents whose crc32 of the id leaves a rest other than 2 modulo 7.

    Null and empty texts are the end token alone. Rows that repeat a document are
    counted and scored each. An empty table gives no rows; without training rows
    every token is unknown, of probability 1.
    """
    docs = table(spark, sf_dir, "documents")
    held_out = crc_rest(F.col("doc_id"), 7) == 2
    model, n_tokens, n_words = train(docs, ~held_out)
    found = score(docs, model, n_tokens, n_words)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
