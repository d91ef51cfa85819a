"""SimHash near-dedup by anchor-point covering.

Fingerprints are words of 64 bits. The anchors are pairs of codewords of the binary
Golay code of length 23, one for bits 0-22 and one for bits 23-45. That code is
perfect with covering radius 3: each block of a fingerprint lies within 3 bits of
exactly one codeword, its home. If two fingerprints differ in at most t bits, and e1
and e2 of them lie in the blocks, the second one lies within 3 + e1 and 3 + e2 of the
first one's home. So each fingerprint is replicated to every anchor within the
covering radius plus threshold, where the excess over 3 of both blocks sums to at
most t, and any linked pair meets at the home of either.

Few bits stand for near identity. Where texts must be found that share most but not all of
their shingles, ``similar_links`` adds links by the Jaccard similarity of their sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, table, written
from .components import components
from .line_dedup import _bitmap

BLOCK, PARITY, RADIUS = 23, 11, 3
#: Generator polynomial of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: An anchor with more homes than this links its members through single-bit hubs instead of pair by pair.
CROWD = 64


#: Most bytes of shingle sets, and most sets, of a block of candidates.
BLOCK_BYTES, BLOCK_SETS = 1 << 21, 512
#: Bands and rows of the MinHash keys: a pair of similarity 0.8 shares no band with probability (1 - 0.8^5)^30 < 7e-6.
BANDS, ROWS = 30, 5
_draws = np.random.default_rng(20).integers(0, 1 << 64, (2, BANDS * ROWS + ROWS), np.uint64)
MASKS, MULTIPLIERS, MIXERS = _draws[0, : BANDS * ROWS, None], _draws[1, : BANDS * ROWS, None] | np.uint64(1), _draws[1, BANDS * ROWS :] | np.uint64(1)


def shingle_hashes(text: str, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Hashes of the lower-cased (A-Z) word shingles of a text, in its order; a shorter text is one shingle, no words give none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    return np.array(hashes, dtype="<u8")


def _majority(h: np.ndarray) -> int:
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for low in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[low : low + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of the lower-cased (A-Z) word shingles of a text; no words give 0."""
    return _majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, th, fp`` of whole texts, ``th`` a hash of the text as it is; null and blank texts have fingerprint 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.xxhash64(F.col(text_col)).alias("th"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps, pa.int64())], names=["doc_id", "th", "fp"])

    return rows.mapInArrow(hashed, "doc_id long, th long, fp long")


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of three byte tables; per syndrome the error patterns of weight up to 5, lightest first, and their excess over 3 (9: none)."""

    def rest(x: int) -> int:
        for i in range(BLOCK - 1, PARITY - 1, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - PARITY)
        return x

    columns = np.array([rest(1 << i) for i in range(24)], np.int64)
    byte = np.zeros((3, 256), np.int64)
    for part in range(3):
        for b in range(256):
            byte[part, b] = np.bitwise_xor.reduce(columns[8 * part : 8 * part + 8][[i for i in range(8) if b >> i & 1]]) if b else 0
    lists: list[list[tuple[int, int]]] = [[] for _ in range(1 << PARITY)]
    for weight in range(RADIUS + 3):
        for bits in combinations(range(BLOCK), weight):
            s = 0
            for i in bits:
                s ^= int(columns[i])
            lists[s].append((sum(1 << i for i in bits), max(0, weight - RADIUS)))
    width = max(map(len, lists))
    errors, excess = np.zeros((1 << PARITY, width), np.int64), np.full((1 << PARITY, width), 9, np.int64)
    for s, found in enumerate(lists):
        for j, (e, x) in enumerate(found):
            errors[s, j], excess[s, j] = e, x
    return byte, errors, excess


def _blocks(fp: np.ndarray) -> list[np.ndarray]:
    return [(fp >> (BLOCK * k)) & ((1 << BLOCK) - 1) for k in range(2)]


def _syndrome(x: np.ndarray) -> np.ndarray:
    byte = _golay()[0]
    return byte[0, x & 255] ^ byte[1, (x >> 8) & 255] ^ byte[2, (x >> 16) & 127]


def home_anchors(fp: np.ndarray) -> np.ndarray:
    """The anchor within the covering radius of each fingerprint."""
    errors = _golay()[1]
    a, b = (x ^ errors[_syndrome(x), 0] for x in _blocks(fp))
    return a | (b << BLOCK)


def reached_anchors(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """All anchors within covering radius plus threshold: row number and anchor."""
    _, errors, excess = _golay()
    (x, y) = _blocks(fp)
    sx, sy = _syndrome(x), _syndrome(y)
    rows, anchors = [], []
    for i in range(errors.shape[1]):
        for j in range(errors.shape[1]):
            hit = np.flatnonzero(excess[sx, i] + excess[sy, j] <= threshold)
            if len(hit):
                rows.append(hit)
                anchors.append((x[hit] ^ errors[sx[hit], i]) | ((y[hit] ^ errors[sy[hit], j]) << BLOCK))
    return (np.concatenate(rows), np.concatenate(anchors)) if rows else (np.zeros(0, np.int64),) * 2


def _anchored(fps: DataFrame, threshold: int | None) -> DataFrame:
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            if threshold is None:
                yield pa.RecordBatch.from_arrays([pa.array(home_anchors(fp)), batch.column(0)], names=["anchor", "fp"])
            else:
                for low in range(0, len(fp), 4096):
                    part = fp[low : low + 4096]
                    rows, anchors = reached_anchors(part, threshold)
                    yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(part[rows])], names=["anchor", "fp"])

    return fps.select("fp").mapInArrow(deal, "anchor long, fp long")


def fingerprint_links(fps: DataFrame, threshold: int = 2, crowd: int = CROWD) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints (column ``fp``) that connect all that differ in at most ``threshold`` (0 to 2) bits.

    At an anchor with at most ``crowd`` homes each reached fingerprint is compared
    with each home, which emits the links alone. A crowded anchor, as a large group
    of near copies makes, would compare quadratically many. Its fingerprints go
    another way that is exact as well: two of them differ in at most 2 bits exactly
    if they share a point within one bit of both, so each is sent to its 65 such
    points, and the at most 65 members of a point are linked to the least of them.
    That way misses no connection, if not every pair is an edge of its own.
    """
    if not 0 <= threshold <= 2:
        raise ValueError("the threshold must be 0, 1 or 2")
    homes = _anchored(fps, None)
    counts = homes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    sparse = homes.join(counts.where(F.col("n") <= crowd), "anchor").groupBy("anchor").agg(F.collect_list("fp").alias("members"))
    crowded = counts.where(F.col("n") > crowd).select("anchor", F.lit(None).cast("array<bigint>").alias("members"))
    cells = sparse.unionByName(crowded)
    near = F.filter("members", lambda m: (m != F.col("fp")) & (F.bit_count(m.bitwiseXOR(F.col("fp"))) <= threshold))
    met = _anchored(fps, threshold).join(cells, "anchor").select("fp", F.col("members").isNull().alias("crowded"), near.alias("near"))
    met = checkpoint(met.where("crowded or size(near) > 0"))
    pairs = met.where("not crowded").select(F.col("fp").alias("a"), F.explode("near").alias("b"))
    full = met.where("crowded").select("fp").distinct()
    if threshold == 2:
        bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
        points = full.select("fp", F.explode(F.concat(F.array("fp"), bits)).alias("point"))
        stars = points.groupBy("point").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
        hub = _thinned(stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")))
    elif threshold == 1:  # neighbours directly: b is a with one bit turned
        bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
        turned = full.select(F.col("fp").alias("a"), F.explode(bits).alias("b"))
        hub = turned.join(full.withColumnRenamed("fp", "b"), "b").select("a", "b")
    else:
        hub = full.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    return pairs.unionByName(hub).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _thinned(links: DataFrame) -> DataFrame:
    """Fewer edges ``a, b`` that connect the same: each ``b`` keeps its least ``a``, and its other ones are linked to that.

    Members of a large group of near copies share most of their points' least members, so what
    links these is few different edges.
    """
    own = links.groupBy("b").agg(F.min("a").alias("m"), F.collect_set("a").alias("all"))
    return own.select(F.col("m").alias("a"), F.explode(F.concat("all", F.array("b"))).alias("b")).distinct()


def band_keys(members: np.ndarray) -> np.ndarray:
    """One key for each band of the MinHash values of a set of hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(members), 512):
        np.minimum(least, ((members[low : low + 512] ^ MASKS) * MULTIPLIERS).min(axis=1), out=least)
    keys = (least.reshape(BANDS, ROWS) * MIXERS).sum(axis=1, dtype=np.uint64)
    keys = (keys ^ (keys >> np.uint64(31))) * MULTIPLIERS[:BANDS, 0]
    return keys ^ np.arange(BANDS, dtype=np.uint64)


def _set_id(members: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(members.tobytes(), 7)], np.uint64).view(np.int64)[0])


def _sketched(docs: DataFrame, shingle: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, th, fp, sid, n, keys``: with the fingerprint, the hash of the set of shingles, its size and its band keys; null without words."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.xxhash64(F.col(text_col)).alias("th"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sids, sizes, keys = [], [], [], []
            for t in batch.column(1):
                h = shingle_hashes(t.as_py(), shingle, seed)
                members = np.unique(h)
                fps.append(_majority(h))
                sids.append(_set_id(members) if len(h) else None)
                sizes.append(len(members))
                keys.append(band_keys(members).view(np.int64) if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps, pa.int64()), pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "th", "fp", "sid", "n", "keys"])

    return rows.mapInArrow(hashed, "doc_id long, th long, fp long, sid long, n long, keys array<bigint>")


def similar_trees(sets: list[np.ndarray], similarity: float, classes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of positions that connect all sets whose Jaccard similarity reaches ``similarity``, each such a pair itself.

    A set is compared with all others at once. Of two sets that are not connected at least one is not in the largest
    class, so those of the largest class need no turn. ``classes`` numbers what is connected already, if any is.
    """
    sizes = np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    classes = np.arange(len(sets)) if classes is None else classes.copy()
    used, links = np.zeros(len(sets), bool), []
    while True:
        largest = np.bincount(classes).argmax()
        rest = np.flatnonzero(~used & (classes != largest))
        if not len(rest):
            return links
        i = int(rest[0])
        used[i] = True
        here = np.zeros(ids.max() + 1, bool)
        here[ids[starts[i] : starts[i] + sizes[i]]] = True
        both = np.add.reduceat(here[ids], starts, dtype=np.int64)
        near = np.flatnonzero(both >= similarity * (sizes + sizes[i] - both) - 1e-9)
        for j in near.tolist():
            if classes[j] != classes[i]:
                links.append((i, j))
                classes[classes == classes[j]] = classes[i]


def similar_links(docs: DataFrame, sketches: DataFrame, similarity: float, shingle: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """Edges ``a, b`` between the ``sid`` of texts that connect all whose sets of shingles have a Jaccard similarity of ``similarity`` or more.

    Sets that share a band key are candidates. Keys are linked as stars, which are linear in
    the rows; classes of candidates then get their sets of shingles, and the exact similarity decides.
    Only sets of candidates are shuffled. A large class is dealt into blocks of bounded size, see ``_linked_in_blocks``.
    """
    sets = checkpoint(sketches.where("doc_id is not null and sid is not null").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    bands = sets.select("sid", F.explode("keys").alias("key"))
    stars = bands.groupBy("key").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo <> hi").select(F.col("key").alias("k"), "lo")
    met = components(bands.join(stars, F.col("key") == F.col("k")).where("sid <> lo").select(F.col("sid").alias("a"), F.col("lo").alias("b")))
    known = sets.select("sid", "rep", "n")
    found = checkpoint(met.join(known, met["node"] == known["sid"]).select("sid", F.col("component").alias("cluster"), "rep", "n"))
    sizes = _sizes(found, "blocks")
    found = checkpoint(found.join(sizes, found["cluster"] == sizes["_cluster"]).drop("_cluster").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks"))))
    wanted = _bitmap(found, "rep")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = pa.array(wanted.marked(batch.column(0).to_numpy(zero_copy_only=False)))
            part = batch.filter(hit)
            members = [np.unique(shingle_hashes(t, shingle, seed)) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_set_id(m) for m in members], pa.int64()), pa.array([m.tobytes() for m in members], pa.binary())], names=["doc_id", "id", "members"])

    read = rows.mapInArrow(again, "doc_id long, id long, members binary")
    once = read.dropDuplicates(["id", "doc_id"])
    joined = once.join(found, (once["id"] == found["sid"]) & (once["doc_id"] == found["rep"])).select("cluster", "sid", "n", "blocks", "block", "members")
    return _linked_in_blocks(written(joined), similarity)


def _sizes(rows: DataFrame, blocks: str) -> DataFrame:
    """``_cluster`` and how many blocks its sets need."""
    need = F.greatest(F.sum("n") * 8 / BLOCK_BYTES, F.count(F.lit(1)) / BLOCK_SETS)
    return rows.groupBy(F.col("cluster").alias("_cluster")).agg(F.ceil(need).alias(blocks))


def _linked_in_blocks(sets: DataFrame, similarity: float) -> DataFrame:
    """Edges ``a, b`` that connect all similar sets of each cluster: ``cluster, sid, n, blocks, block, members``.

    The sets of a cluster are dealt into ``blocks``, and one set of it, the pivot, goes to all of them, which connects
    what a large group of near copies has. Sets that are then outside of the largest class of their cluster
    meet all its blocks, in blocks of their own. So a task holds two blocks at most, and every pair of sets that
    are not connected yet is compared.
    """

    def linked(group: pa.Table) -> pa.Table:
        unique = dict(zip(group.column("sid").to_pylist(), zip(group.column("members").to_pylist(), group.column("class").to_pylist())))
        ids = list(unique)
        classes = np.unique([c for _, c in unique.values()], return_inverse=True)[1]
        pairs = similar_trees([np.frombuffer(m, "<u8") for m, _ in unique.values()], similarity, classes)
        return pa.table({"a": pa.array([ids[i] for i, _ in pairs], pa.int64()), "b": pa.array([ids[j] for _, j in pairs], pa.int64())})

    rows = sets.withColumn("class", F.col("sid"))
    many = rows.where("blocks > 1")
    pivots = many.groupBy("cluster").agg(F.min("sid").alias("pivot")).select("pivot")
    sent = many.join(pivots, many["sid"] == pivots["pivot"], "left_semi").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    first = checkpoint(rows.unionByName(sent).groupBy("cluster", "block").applyInArrow(linked, "a long, b long"))
    if pivots.isEmpty():
        return first
    large = many.drop("class", "members")
    inside = first.join(large.select(F.col("sid").alias("_sid")), F.col("a") == F.col("_sid"), "left_semi")
    classes = components(inside)
    large = checkpoint(large.join(classes, large["sid"] == classes["node"], "left").select("cluster", "sid", "n", "blocks", "block", F.coalesce("component", "sid").alias("class")))
    counts = large.groupBy(F.col("cluster").alias("_c"), "class").agg(F.count(F.lit(1)).alias("size"))
    largest = counts.groupBy("_c").agg(F.max(F.struct("size", "class")).alias("top")).select("_c", F.col("top.class").alias("top"))
    rest = checkpoint(large.join(largest, F.col("cluster") == F.col("_c")).where("class <> top").drop("_c", "top"))
    if rest.isEmpty():
        return first
    own = checkpoint(_sizes(rest, "own_blocks"))
    asked = rest.join(own, rest["cluster"] == own["_cluster"]).withColumn("own", F.pmod(F.xxhash64("sid"), F.col("own_blocks"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    stored = large.join(own, large["cluster"] == own["_cluster"]).withColumn("own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("own_blocks") - 1)))
    tasks = asked.select("cluster", "sid", "class", "own", "block").unionByName(stored.select("cluster", "sid", "class", "own", "block"))
    second = tasks.join(sets.select(F.col("sid").alias("_sid"), "members"), F.col("sid") == F.col("_sid")).drop("_sid")
    return first.unionByName(second.groupBy("cluster", "own", "block").applyInArrow(linked, "a long, b long"))


def near_duplicates(
    docs: DataFrame, threshold: int = 2, shingle: int = 3, seed: int = 42, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None
) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id`` (the smallest id of its class) and ``th``, a hash of its text.

    Documents are read once. From then on only distinct fingerprints travel, each with the
    smallest id that has it, so copies cost nothing; at the end the documents get
    their class by a join on the fingerprint, which AQE splits where a third of
    all rows share one. All texts without words have fingerprint 0 and are one
    class. A null id stays null and does not name a class unless no other id has
    its fingerprint; then the class of that fingerprint is null if it is alone.
    Repeated rows give repeated rows; an empty table gives none.

    With ``similarity``, 0.8 or more, texts whose sets of shingles have that Jaccard similarity are linked as well.
    """
    if similarity is not None and similarity < 0.8:
        raise ValueError("the bands are made for a similarity of 0.8 or more")
    hashed = checkpoint(fingerprints(docs, shingle, seed, id_col, text_col) if similarity is None else _sketched(docs, shingle, seed, id_col, text_col))
    reps = checkpoint(hashed.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    edges = fingerprint_links(reps.where("rep is not null").select("fp"), threshold, crowd).select("a", "b")
    if similarity is not None:
        # A set stands for the least of its fingerprints: the same set with other repeats has another one.
        nodes = checkpoint(hashed.where("sid is not null").select("sid", "fp").distinct().join(reps.where("rep is not null"), "fp", "left_semi"))
        of = nodes.groupBy("sid").agg(F.min("fp").alias("least"))
        same = nodes.join(of.withColumnRenamed("sid", "s"), F.col("sid") == F.col("s")).where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
        near = checkpoint(similar_links(docs, hashed, similarity, shingle, seed, id_col, text_col))
        sa, sb = (of.select(F.col("sid").alias(f"_{c}"), F.col("least").alias(f"r{c}")) for c in "ab")
        near = near.join(sa, F.col("a") == F.col("_a")).join(sb, F.col("b") == F.col("_b")).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        edges = edges.unionByName(same).unionByName(near)
    found = components(edges)
    linked = reps.join(found, reps["fp"] == found["node"]).select("fp", "component", "rep")
    least = linked.groupBy(F.col("component").alias("_c")).agg(F.min("rep").alias("component_id"))
    named = reps.join(linked.join(least, F.col("component") == F.col("_c")).select(F.col("fp").alias("_fp"), "component_id"), F.col("fp") == F.col("_fp"), "left")
    named = named.select(F.col("fp").alias("_fp"), F.coalesce("component_id", "rep").alias("component_id"))
    return hashed.join(named, hashed["fp"] == named["_fp"], "left").select("doc_id", "fp", "component_id", "th")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their class; rows with null ids stay.

    Where rows with several texts share an id, each of them goes or stays by the class of its own text.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where("doc_id <> component_id")
    gone = found.select(F.col("doc_id").alias("_gone"), F.col("th").alias("_th"))
    return docs.join(gone, (docs[id_col] == gone["_gone"]) & (F.xxhash64(docs[text_col]) == gone["_th"]), "left_anti")


def op1_simhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
