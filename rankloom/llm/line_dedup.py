"""Line dedup by a segment-partition edit join.

Two lines are near duplicates if at most ``threshold`` single-character edits part
them. A line of length l is cut into threshold + 1 segments; by the pigeonhole
principle a line within the threshold has one of them unchanged, starting at one of
a few places. So segments are indexed by (length, segment number, content), other
lines probe with the substrings that can match, and candidates are verified with a
banded bit-parallel edit distance. Groups of very many similar lines are compared
block by block, and return counts and trees of links instead of pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, checkpoint, fresh, table
from .components import components

THRESHOLD = 2
#: The shortest line of the edit join: five segments of three characters. Shorter ones are the same only if they are equal.
MIN_CHARS = 3 * (THRESHOLD + 3)
#: A segment that more lines share than this is refined, see ``line_links``.
CROWD = 32
#: Most bits of the filters that tell which keys and lines matter: 64 MB.
FILTER_BITS = 1 << 29
#: Bits of a filter that the driver holds at a time: 4 MB.
SHARE_BITS = 1 << 25
#: Lines of 64 characters that a task compares with as many others.
BLOCK_LINES = 512


def _common_prefix(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    low = 0
    while low < n:  # in growing steps, so that an early difference costs little
        high = min(n, low + max(64, low))
        differs = a[low:high] != b[low:high]
        if differs.any():
            return low + int(differs.argmax())
        low = high
    return n


def _code_points(line: str) -> np.ndarray:
    return np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4")


def edit_distance_within(a: str, b: str, most: int) -> int | None:
    """Edit distance of ``a`` and ``b`` if it is at most ``most``, else None.

    Only the 2 most + 1 diagonals around the main one can hold so small a distance. Each column of
    that band is a few bits that say where a step down the rows costs one more or one less
    (Myers, in the banded form of Hyyro). Common ends are cut off first, and the
    loop stops once the distance cannot come back under ``most``.
    """
    if abs(len(a) - len(b)) > most:
        return None
    if a == b:
        return 0
    x, y = _code_points(a), _code_points(b)
    low = _common_prefix(x, y)
    high = _common_prefix(x[low:][::-1], y[low:][::-1])
    pattern, text = sorted((x[low : len(x) - high].tolist(), y[low : len(y) - high].tolist()), key=len)
    m, n = len(pattern), len(text)
    # In column j, bit k stands for row j - most + k, rows counted from 1; ``where`` tells the rows of a character.
    width = 2 * most + 1
    full, corner, base = (1 << width) - 1, 1 << (width - 1), 0
    where: dict[int, int] = {}
    for i in range(min(most, m)):
        where[pattern[i]] = where.get(pattern[i], 0) | 1 << (i + most)
    plus, minus, found = full & ~((1 << most) - 1), 0, min(most, m)
    for j in range(1, n + 1):
        if j - 1 - base >= 64:  # rows above the band are of no more use
            where = {c: bits >> 64 for c, bits in where.items() if bits >> 64}
            base += 64
        if j + most <= m:
            c = pattern[j + most - 1]
            where[c] = where.get(c, 0) | 1 << (j + 2 * most - 1 - base)
        eq = where.get(text[j - 1], 0) >> (j - 1 - base) & full
        d = (((eq & plus) + plus) ^ plus | eq | minus) & full
        hp, hm = (minus | ~(d | plus)) & full, d & plus
        if j + most <= m:  # down the lowest diagonal, then along the last row
            found += not d & corner
        else:
            bit = 1 << (m - j + most)
            found += bool(hp & bit) - bool(hm & bit)
        if found - (n - max(j, m - most)) > most:
            return None
        d >>= 1
        plus, minus = (hm | ~(d | hp)) & full, d & hp
    return found if found <= most else None


def within_matrix(short: list[str], long: list[str], most: int) -> np.ndarray:
    """Whether each of ``short`` (all of one length) is within ``most`` edits of each of ``long`` (all of one length, at most ``most`` more): the same band for all pairs at once."""
    if len(short) * len(long) < 32:
        return np.array([[edit_distance_within(a, b, most) is not None for b in long] for a in short], bool).reshape(len(short), len(long))
    m, n, width = len(short[0]), len(long[0]), 2 * most + 1
    codes = np.unique(_code_points("".join(short) + "".join(long)), return_inverse=True)[1]
    codes = codes.astype(np.uint8 if codes.max() < 256 else np.uint32)
    rows = np.ascontiguousarray(codes[: m * len(short)].reshape(-1, m).T)
    columns = np.ascontiguousarray(codes[m * len(short) :].reshape(-1, n).T)
    kind = np.uint8 if width < 8 else np.uint64
    shape = (len(short), len(long))
    full = kind((1 << width) - 1)
    plus, minus = np.full(shape, full & ~kind((1 << most) - 1), kind), np.zeros(shape, kind)
    found = np.full(shape, min(most, m), np.int32)
    for j in range(1, n + 1):
        eq = np.zeros(shape, kind)
        for k in range(width):
            i = j - most - 1 + k
            if 0 <= i < m:
                eq |= (rows[i][:, None] == columns[j - 1]).astype(kind) << kind(k)
        d = (((eq & plus) + plus) ^ plus | eq | minus) & full
        hp, hm = (minus | ~(d | plus)) & full, d & plus
        if j + most <= m:
            found += (d >> kind(width - 1)) == 0
        else:
            at = kind(m - j + most)
            found += (hp >> at & kind(1)).astype(np.int8) - (hm >> at & kind(1)).astype(np.int8)
        if j % 16 == 0 and (found - (n - max(j, m - most)) > most).all():
            return np.zeros(shape, bool)
        d >>= kind(1)
        plus, minus = (hm | ~(d | hp)) & full, d & hp
    return found <= most


def segments(length: int, parts: int) -> list[tuple[int, int]]:
    """Start and length of ``parts`` even segments, the longer ones last."""
    short, longer = divmod(length, parts)
    cuts, at = [], 0
    for i in range(parts):
        size = short + (i >= parts - longer)
        cuts.append((at, size))
        at += size
    return cuts


def probes(length: int, indexed: int, threshold: int) -> Iterator[tuple[int, int, int]]:
    """Segment number, start and size of the substrings of a line of ``length`` that can match a segment of a line of ``indexed`` <= ``length``.

    With d = the difference in length, a match of segment i (from 0) with i edits or
    fewer to its left shifts it by at most i, and with threshold - i or fewer to its
    right by at most threshold - i of d; both bounds hold for some matching segment.
    """
    d = length - indexed
    for i, (at, size) in enumerate(segments(indexed, threshold + 1)):
        low = max(at - i, at + d - (threshold - i), 0)
        high = min(at + i, at + d + (threshold - i), length - size)
        for start in range(low, high + 1):
            yield i, start, size


@lru_cache(maxsize=4096)
def _plan(n: int, threshold: int) -> list[tuple[int, int, int, bool]]:
    """Byte range in UTF-32, hash seed and whether it is a segment of the line itself, of all probes of a line of ``n`` characters.

    A line's segments are among its probes, at no shift.
    """
    own = {(i, a) for i, (a, _) in enumerate(segments(n, threshold + 1))}
    plan = []
    for shorter in range(n - threshold, n + 1):
        for i, start, size in probes(n, shorter, threshold):
            plan.append((4 * start, 4 * (start + size), shorter * (threshold + 1) + i, shorter == n and (i, start) in own))
    return plan


def _lines_of(text: str | None, min_chars: int) -> list[str]:
    return [x for x in (text or "").split("\n") if len(x) >= min_chars]


def _line_id(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)


def _signed(x: list[int]) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64)


def _scan(docs: DataFrame, text_col: str, min_chars: int, make, schema: str, names: list[str]) -> DataFrame:
    """One pass over the texts: ``make(lines)`` gives columns for the distinct eligible lines of some rows."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                lines = {x for t in batch.column(0).slice(low, 512).to_pylist() for x in _lines_of(t, min_chars)}
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in make(lines)], names=names)

    return texts.mapInArrow(run, schema)


class Marks:
    """A bitmap of ids in shares that are broadcast one by one, so that the driver never holds more than one."""

    def __init__(self, shares: list, bits: int) -> None:
        self.shares, self.bits = shares, bits

    def marked(self, ids: np.ndarray) -> np.ndarray:
        at = ids & (self.bits - 1)
        share, hit = at // SHARE_BITS, np.zeros(len(ids), bool)
        for k, sent in enumerate(self.shares):
            own = np.flatnonzero(share == k)
            place = at[own] % SHARE_BITS
            hit[own] = (sent.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
        return hit

    def destroy(self) -> None:
        """Nothing reads the marks any more: driver and executors drop them."""
        for sent in self.shares:
            sent.destroy()


def _bitmap(ids: DataFrame, column: str) -> Marks:
    """A bitmap of the ids of a column, broadcast: 16 bits for each row, from 128 KB up to 64 MB, whatever the number of rows."""
    bits = min(FILTER_BITS, 1 << max(20, (16 * ids.count()).bit_length()))
    at = F.pmod(F.col(column), F.lit(bits)) + 1  # Spark's buckets and bits count from 1
    rows = ids.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    size = min(bits, SHARE_BITS) // 8
    rows, shares = checkpoint(rows) if 8 * size < bits else rows, []
    for first in range(0, bits // 8 // 4096, size // 4096):
        marks = np.zeros(size, np.uint8)
        for r in rows.where(F.col("k").between(first + 1, first + size // 4096)).collect():
            marks[(r["k"] - 1 - first) * 4096 : (r["k"] - first) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
        shares.append(ids.sparkSession.sparkContext.broadcast(marks))
    return Marks(shares, bits)


def _keys_of(lines: Iterable[str], threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    digest = xxhash.xxh3_64_intdigest
    ids, keys, own = [], [], []
    for line in lines:
        wide = line.encode("utf-32-le", "surrogatepass")
        plan = _plan(len(line), threshold)
        keys += [digest(wide[a:b], seed) for a, b, seed, _ in plan]
        own += [o for _, _, _, o in plan]
        ids += [_line_id(line)] * len(plan)
    return _signed(ids), _signed(keys), np.array(own, bool)


def line_links(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, crowd: int = CROWD, text_col: str = "text") -> DataFrame:
    """Links of lines within ``threshold`` edits, in parts: ``line_id, other, links``.

    ``links`` summed up by ``line_id`` is the number of different lines within the threshold. The pairs
    of ``line_id`` and ``other``, where that is not null, are links that connect all that are linked.

    A first pass finds the keys that two different lines share, a second one the
    lines that have them, a third the texts of the candidates. In between a bitmap
    tells which keys or lines matter; its errors are removed by
    joins. So beyond hashes only candidate lines are shuffled.

    A key that more than ``crowd`` lines have as a segment would pair quadratically
    many. Its lines go another way that is exact as well: they are cut into
    threshold + 2 segments, of which two survive, and two must be shared. Lines for which
    that is crowded too are compared group by group, see ``_crowd_links``.
    """
    columns = ["line_id", "key", "own"]
    schema = "line_id long, key long, own boolean"
    keys = _scan(docs, text_col, min_chars, lambda lines: _keys_of(lines, threshold), schema, columns)
    known = _bitmap(live := checkpoint(_live(keys)), "key")

    def again(lines):
        ids, keys, own = _keys_of(lines, threshold)
        hit = known.marked(keys)
        return ids[hit], keys[hit], own[hit]

    rows = _scan(docs, text_col, min_chars, again, schema, columns).join(live, "key", "left_semi").groupBy("line_id", "key").agg(F.max("own").alias("own"))
    rows = checkpoint(rows)
    known.destroy()
    pairs, crowded = _paired(rows, crowd)
    need = checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("line_id")).union(crowded).distinct())
    wanted = _bitmap(need, "line_id")

    def texts(lines):
        lines = list(lines)
        ids = _signed([_line_id(x) for x in lines])
        hit = wanted.marked(ids)
        return ids[hit], pa.array([x for x, h in zip(lines, hit) if h], pa.string())

    found = _scan(docs, text_col, min_chars, texts, "line_id long, line string", ["line_id", "line"])
    lines = checkpoint(found.join(need, "line_id", "left_semi").groupBy("line_id").agg(F.first("line").alias("line")))
    wanted.destroy()
    links = _verified(pairs, lines, threshold)
    rest = lines.join(crowded, "line_id", "left_semi")
    if rest.isEmpty():
        return _both_ends(links)
    rows = _combined_rows(rest, threshold, 2)
    pairs, crowded = _paired(rows, crowd)
    links = links.unionByName(_verified(pairs, lines, threshold))
    rest = checkpoint(lines.join(crowded, "line_id", "left_semi"))
    if rest.isEmpty():
        return _both_ends(links)
    # Neither level has links between two of the rest; they are found, and counted, below.
    return _both_ends(links).unionByName(_crowd_links(rest, threshold))


def _live(keys: DataFrame) -> DataFrame:
    """Keys that two different lines share and one has as a segment."""
    return keys.groupBy("key").agg(F.max("own").alias("own"), F.min("line_id").alias("lo"), F.max("line_id").alias("hi")).where("own and lo <> hi").select("key")


def _both_ends(links: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("a").alias("line_id"), F.col("b").alias("other")), F.struct(F.col("b").alias("line_id"), F.lit(None).cast("long").alias("other")))
    return links.distinct().select(F.explode(ends).alias("e")).select("e.*", F.lit(1).cast("long").alias("links"))


def _combined_rows(lines: DataFrame, threshold: int, shared: int) -> DataFrame:
    rows = checkpoint(lines.select("line_id", "line").mapInArrow(_combined(threshold, shared), "line_id long, key long, own boolean").distinct())
    return checkpoint(rows.join(_live(rows), "key", "left_semi"))


def _crowd_links(lines: DataFrame, threshold: int) -> DataFrame:
    """``line_id, other, links`` of crowded lines, without a row for each pair.

    Lines that share three of threshold + 3 segments, as all within the threshold do, fall into groups. The lines of a
    group and length are dealt into blocks, and a task compares one block with another of a length that is
    at most ``threshold`` away. It returns how many of the other block each line links to, and a tree of links for
    each set of connected lines: a row for each line at most.
    """
    rows = _combined_rows(lines, threshold, 3)
    least = rows.groupBy("key").agg(F.min("line_id").alias("lo")).select(F.col("key").alias("k"), "lo")
    group = components(rows.join(least, F.col("key") == F.col("k")).where("line_id <> lo").select(F.col("line_id").alias("a"), F.col("lo").alias("b")))
    members = checkpoint(lines.select("line_id", F.length("line").alias("n")).join(group, F.col("line_id") == F.col("node")).select("component", "line_id", "n"))
    sizes = members.groupBy("component", "n").agg(F.count(F.lit(1)).alias("lines"))
    sizes = checkpoint(sizes.select("component", "n", "lines", F.ceil(F.col("lines") * F.greatest(F.lit(1.0), F.col("n") / 64) / BLOCK_LINES).alias("blocks")))
    own = sizes.select(F.col("component").alias("c"), F.col("n").alias("l"), F.col("blocks").alias("own_blocks"))
    dealt = members.join(own, (F.col("component") == F.col("c")) & (F.col("n") == F.col("l"))).withColumn("at", F.pmod(F.xxhash64("line_id"), F.col("own_blocks")))
    dealt = dealt.select("component", "line_id", "n", "at", F.explode(F.sequence(F.lit(-threshold), F.lit(threshold))).alias("d"))
    others = sizes.select(F.col("component").alias("c"), F.col("n").alias("l"), "lines", "blocks")
    met = dealt.join(others, (F.col("component") == F.col("c")) & (F.col("n") + F.col("d") == F.col("l"))).where("d <> 0 or lines > 1")
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    first = (F.col("d") > 0) | (F.col("d") == 0) & (F.col("at") <= F.col("with"))
    pick = lambda x, y: F.when(first, x).otherwise(y)
    tasks = met.select("component", pick(F.col("n"), F.col("n") + F.col("d")).alias("short"), pick(F.col("at"), F.col("with")).alias("i"), pick(F.col("n") + F.col("d"), F.col("n")).alias("long"), pick(F.col("with"), F.col("at")).alias("j"), "line_id", first.alias("first"))

    def compare(block: pa.Table) -> pa.Table:
        first = block.column("first")
        a, b = block.filter(first), block.filter(pc.invert(first))
        same = block.column("short")[0] == block.column("long")[0] and block.column("i")[0] == block.column("j")[0]
        b = a if same else b
        ids = np.concatenate([x.column("line_id").to_numpy() for x in ((a,) if same else (a, b))])
        near = within_matrix(a.column("line").to_pylist(), b.column("line").to_pylist(), threshold) if len(a) and len(b) else np.zeros((len(a), len(b)), bool)
        if same:
            np.fill_diagonal(near, False)
            linked = near
        else:
            linked = np.zeros((len(ids), len(ids)), bool)
            linked[: len(a), len(a) :], linked[len(a) :, : len(a)] = near, near.T
        count, parent = linked.sum(axis=1), spanning_parents(linked)
        keep = np.flatnonzero(count)
        other = pa.array(ids[np.maximum(parent[keep], 0)], mask=parent[keep] < 0)
        return pa.table({"line_id": pa.array(ids[keep]), "other": other, "links": pa.array(count[keep])})

    return tasks.join(lines, "line_id").groupBy("component", "short", "i", "long", "j").applyInArrow(compare, "line_id long, other long, links long")


def spanning_parents(linked: np.ndarray) -> np.ndarray:
    """For each node its parent in a tree that spans its connected part, -1 for roots."""
    parent, seen = np.full(len(linked), -1), np.zeros(len(linked), bool)
    for root in np.flatnonzero(linked.any(axis=1)).tolist():
        stack = [] if seen[root] else [root]
        seen[root] = True
        while stack:
            node = stack.pop()
            new = np.flatnonzero(linked[node] & ~seen)
            seen[new], parent[new] = True, node
            stack += new.tolist()
    return parent


def _paired(rows: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Pairs that share a key which one of them has as its own, and the lines of crowded keys (checkpointed both).

    Two lines of crowded keys are no pair here: where such lines go on to, all of them are compared again. Any other two that share
    a key share none that is crowded.
    """
    own = rows.where("own")
    sizes = own.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    crowded = checkpoint(rows.join(sizes.where(F.col("n") > crowd), "key", "left_semi").select("line_id").distinct())
    marked = crowded.select(F.col("line_id").alias("_line"), F.lit(True).alias("_crowded"))
    rows = rows.join(marked, F.col("line_id") == F.col("_line"), "left").select("line_id", "key", "own", F.col("_crowded").isNotNull().alias("in"))
    fit = rows.where("own").join(sizes.where(F.col("n") <= crowd), "key", "left_semi")
    b = rows.select(F.col("line_id").alias("b"), "key", "own", F.col("in").alias("in_b"))
    a = fit.select(F.col("line_id").alias("a"), F.col("key").alias("key_a"), F.col("in").alias("in_a"))
    # Two lines that both have the key as their own meet once, not in both orders.
    once = (F.col("a") != F.col("b")) & (~F.col("own") | (F.col("a") < F.col("b")))
    joined = b.join(a, (F.col("key") == F.col("key_a")) & once & ~(F.col("in_a") & F.col("in_b")))
    pairs = checkpoint(joined.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return pairs, crowded


def _combined(threshold: int, shared: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line_id, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own, reach = combined_keys(line, threshold, shared)
                keys = _signed(own + reach)
                yield pa.RecordBatch.from_arrays([pa.array([line_id] * len(keys), pa.int64()), pa.array(keys), pa.array([True] * len(own) + [False] * len(reach))], names=["line_id", "key", "own"])

    return deal


def combined_keys(line: str, threshold: int, shared: int) -> tuple[list[int], list[int]]:
    """Hashes of all combinations of ``shared`` of threshold + shared segments: the line's own, and those it can match in lines of its length or shorter."""
    parts, n, digest = threshold + shared, len(line), xxhash.xxh64_intdigest

    def mixed(length: int, picks) -> int:
        return digest(f"{length}|".encode() + b"|".join(f"{i}:{t}".encode("utf-8", "surrogatepass") for i, t in picks))

    own = [mixed(n, [(i, line[a : a + s]) for i, (a, s) in chosen]) for chosen in combinations(enumerate(segments(n, parts)), shared)]
    reach = set()
    for shorter in range(n - threshold, n + 1):
        spots = [[(i, p - a, line[p : p + s]) for p in range(max(0, a - threshold), min(a + threshold, n - s) + 1)] for i, (a, s) in enumerate(segments(shorter, parts))]
        for chosen in combinations(spots, shared):
            for picks in product(*chosen):
                shifts = [0, *(shift for _, shift, _ in picks), n - shorter]
                if sum(abs(y - x) for x, y in zip(shifts, shifts[1:])) <= threshold:
                    reach.add(mixed(shorter, [(i, t) for i, _, t in picks]))
    return own, sorted(reach - set(own))


def _verified(pairs: DataFrame, lines: DataFrame, threshold: int) -> DataFrame:
    a = lines.select(F.col("line_id").alias("a"), F.col("line").alias("la"))
    b = lines.select(F.col("line_id").alias("b"), F.col("line").alias("lb"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [edit_distance_within(x, y, threshold) is not None for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "la", "lb").mapInArrow(check, "a long, b long")


def line_classes(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line that is not blank: ``doc_id, line_no, line_id, class_id, links, kept``.

    Lines are what line feeds separate; ``line_id`` is a hash of the text, and
    ``class_id`` the least one that a chain of links reaches; ``links`` counts the different
    texts within ``threshold`` edits. The first line of a class by (document id, line
    number) is kept. Lines of less than ``min_chars`` characters have no links, so their class is
    the equal ones. ``min_chars`` is at least 3 (threshold + 3), so that segments are
    not too short to tell lines apart. Blank lines part paragraphs and have no row.

    Null and empty texts have no lines. Lines of documents with a null id are always kept and
    never come first. Rows that repeat an id are one document: if it holds the first
    place of a class, each of its rows keeps that line. Other columns are ignored.
    """
    least = max(min_chars, 3 * (threshold + 3))
    split = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("line_no", "line"))
    rows = checkpoint(split.where(F.col("line").rlike(WORD)).select("doc_id", "line_no", F.xxhash64("line").alias("line_id")))
    links = checkpoint(line_links(docs, threshold, least, text_col=text_col))
    degree = links.groupBy(F.col("line_id").alias("_line")).agg(F.sum("links").alias("links"))
    edges = links.where("other is not null").select(F.col("line_id").alias("a"), F.col("other").alias("b"))
    linked = checkpoint(degree.join(components(edges), F.col("_line") == F.col("node")).select("_line", "links", F.col("component").alias("class_id")))
    place = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "line_no")))
    firsts = rows.groupBy("line_id").agg(place.alias("at"), F.count(F.lit(1)).alias("copies"))
    firsts = firsts.join(linked, F.col("line_id") == F.col("_line"), "left").select("line_id", "at", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("class_id", "line_id").alias("class_id"))
    # Only lines that are not alone need the place of their class.
    alone = (F.col("copies") == 1) & (F.col("links") == 0)
    shared = checkpoint(firsts.where(~alone))
    heads = shared.groupBy("class_id").agg(F.min("at").alias("head"))
    known = shared.select(F.col("line_id").alias("_line"), "class_id", "links").join(heads, "class_id")
    joined = rows.join(known, F.col("line_id") == F.col("_line"), "left")
    first = (F.col("doc_id") == F.col("head.doc_id")) & (F.col("line_no") == F.col("head.line_no"))
    kept = F.col("doc_id").isNull() | F.col("_line").isNull() | F.coalesce(first, F.lit(True))
    return joined.select("doc_id", "line_no", "line_id", F.coalesce("class_id", "line_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), kept.alias("kept"))


def without_repeated_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its columns and rows, but without the lines that ``line_classes`` does not keep.

    A document of which nothing is left stays with an empty text; null texts stay null.
    """
    gone = line_classes(docs, threshold, min_chars, id_col, text_col).where("not kept")
    doc, numbers = fresh("_doc", docs), fresh("_gone", docs)
    lists = gone.groupBy("doc_id").agg(F.collect_set("line_no").alias(numbers)).withColumnRenamed("doc_id", doc)
    joined = docs.join(lists, docs[id_col] == lists[doc], "left")
    rest = F.array_join(F.filter(F.split(F.col(text_col).cast("string"), "\n"), lambda _, i: ~F.array_contains(F.col(numbers), i)), "\n")
    text = F.when(F.col(numbers).isNull(), F.col(text_col)).otherwise(rest).alias(text_col)
    return joined.select(*[text if c == text_col else F.col(c) for c in docs.columns])


def op6_line_dedup(spark, sf_dir):
    return line_classes(table(spark, sf_dir, "documents"))
