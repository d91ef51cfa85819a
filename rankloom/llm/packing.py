"""Packing documents into token sequences by best-fit decreasing."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, table

END_ID = 2
#: Entries after which a Python worker forgets the words it has not met since it last did; this bounds memory only.
CACHE_ENTRIES = 200_000
# Chunks of these characters are in NFC, and lower-casing them is a map of single characters.
_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ſ]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+")


def _byte_letters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


#: What the file of a vocabulary must say for the short way of ``ChunkTokenizer`` to be right.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class ChunkTokenizer:
    """Token ids of a text, as little-endian 32-bit numbers, with a cache of its blank-free chunks.

    Where the vocabulary drops white space and never joins across it, the ids of a text are
    those of its chunks in order, and a chunk is tokenised once however often it is met. Whether it does is
    read from its file; texts of any other vocabulary are tokenised whole.

    The string of a special token in a text becomes that token, as the library has it by
    default; with ``plain_specials`` it is ordinary text.
    """

    def __init__(self, path: str, plain_specials: bool = False):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            says = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.model = self.tokenizer.model
        added = says.get("added_tokens") or []
        self.specials = [t["content"] for t in added if not plain_specials or not t["special"]]
        self.by_chunk = says.get("normalizer") == _NORMALIZER and says.get("pre_tokenizer") == _PRE_TOKENIZER and says["model"]["type"] == "BPE"
        self.by_chunk &= not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or t["content"].split() != [t["content"]] for t in added)
        self.letters = _byte_letters()
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            letters = self.letters
            mapped = part if part.isascii() else "".join([letters[b] for b in part.encode()])
            found = self.parts[part] = np.array([t.id for t in self.model.tokenize(mapped)], dtype="<u4").tobytes()
        return found

    def _learn(self, chunks: set[str]) -> None:
        known = {c: ids for c in chunks if (ids := self.older.get(c)) is not None}
        self.chunks |= known
        chunks = chunks.difference(known)
        if len(self.parts) > CACHE_ENTRIES // 2:
            self.parts.clear()
        odd = []
        for chunk in chunks:
            if chunk.isascii() and chunk.isalpha():  # one word: nothing to normalise or to cut
                self.chunks[chunk] = np.array([t.id for t in self.model.tokenize(chunk.lower())], dtype="<u4").tobytes()
            elif _PLAIN.fullmatch(chunk) and not any(s in chunk for s in self.specials):
                self.chunks[chunk] = b"".join([self._part(p) for p in _PARTS.findall(chunk.lower())])
            else:
                odd.append(chunk)
        if odd:
            for chunk, e in zip(odd, self.tokenizer.encode_batch(odd, add_special_tokens=False)):
                self.chunks[chunk] = np.array(e.ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not self.by_chunk:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        words = _split(text)
        found = list(map(self.chunks.get, words))
        if None in found:
            missing = {w for w, ids in zip(words, found) if ids is None}
            if len(self.chunks) > CACHE_ENTRIES:
                self.older, self.chunks = self.chunks, {}
                missing = set(words)
            self._learn(missing)
            found = list(map(self.chunks.get, words))
        return b"".join(found)


_SEPARATORS = "\x1c\x1d\x1e\x1f"
_BLANK_RUN = re.compile(r"[\x20\x09-\x0D]+")


def _split(text: str) -> list[str]:
    """Chunks between white space. str.split also cuts at four control characters that the tokenizer keeps."""
    if any(c in text for c in _SEPARATORS):
        return [w for w in _BLANK_RUN.split(text) if w]
    return text.split()


_tokenizers: dict[tuple[str, bool], ChunkTokenizer] = {}


def chunk_tokenizer(path: str, plain_specials: bool = False) -> ChunkTokenizer:
    """One per Python worker and vocabulary, kept from task to task."""
    if (path, plain_specials) not in _tokenizers:
        _tokenizers[path, plain_specials] = ChunkTokenizer(path, plain_specials)
    return _tokenizers[path, plain_specials]


def tokenise(docs: DataFrame, window: int = 4096, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", plain_specials: bool = False) -> DataFrame:
    """Pieces of at most ``window`` tokens: ``doc_id, start, length, doc_tokens, ids``.

    A document's ids are its tokens and then END_ID; ``ids`` holds them as
    little-endian 32-bit numbers. Documents longer than a window are cut into full
    windows and a rest. The string of a special token in a text is that token, unless
    ``plain_specials``. Null and empty texts give the one id END_ID. The rows of an
    input batch are handled one by one, so memory is bounded by a batch.
    """
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    end = np.array([END_ID], dtype="<u4").tobytes()
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = chunk_tokenizer(path, plain_specials).encode
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                cols: list[list] = [[], [], [], [], []]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = encode(text) + end
                    n = len(ids) // 4
                    for start in range(0, n, window):
                        piece = ids[4 * start : 4 * (start + window)]
                        for col, value in zip(cols, (doc, start, len(piece) // 4, n, piece)):
                            col.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return source.mapInArrow(pieces, "doc_id long, start long, length long, doc_tokens long, ids binary")


class CapacityTree:
    """Open windows by remaining capacity; a segment tree tells which capacities have one."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.some = bytearray(2 * self.size)
        self.open: dict[int, list[int]] = {}

    def add(self, capacity: int, which: int) -> None:
        stack = self.open.setdefault(capacity, [])
        stack.append(which)
        if len(stack) == 1:
            node = capacity + self.size
            while node and not self.some[node]:
                self.some[node] = 1
                node >>= 1

    def take_tightest(self, length: int) -> tuple[int, int] | None:
        """The window with the least capacity of at least ``length``, removed; None if there is none."""
        some, node = self.some, length + self.size
        while not some[node]:
            while node & 1:  # a right child: everything to its right hangs on an ancestor
                node >>= 1
            if node == 0:
                return None
            node += 1
        while node < self.size:
            node = 2 * node if some[2 * node] else 2 * node + 1
        capacity = node - self.size
        stack = self.open[capacity]
        which = stack.pop()
        if not stack:
            some[node] = 0
            node >>= 1
            while node and not (some[2 * node] or some[2 * node + 1]):
                some[node] = 0
                node >>= 1
        return capacity, which


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each length; lengths must come in decreasing order."""
    tree, n_open = CapacityTree(window), 0
    number, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        found = tree.take_tightest(length)
        if found is None:
            found, n_open = (window, n_open), n_open + 1
        capacity, which = found
        number[i], offset[i] = which, window - capacity
        if capacity > length:
            tree.add(capacity - length, which)
    return number, offset


def pack(pieces: DataFrame, window: int = 4096, shard_rows: int = 50_000) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``pieces`` (columns ``doc_id, start, length`` and any others).

    Pieces are dealt into shards of about ``shard_rows``, and each shard is
    packed by itself: longest first, each into the open window with the least room
    that holds it. A shard leaves a few windows part full, one in thousands at this
    size, and takes the same time and memory however many shards there are.
    Rows are dealt by their place, so that repeated or null ids are spread like
    others; ``pieces`` must be checkpointed, so that places stay as they are.
    Columns beside the three are carried along and cost memory, so send ids only if
    they are wanted in the result.
    """
    n = pieces.count()
    shards = max(1, -(-n // shard_rows))
    dealt = pieces.withColumn("_shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")

    def one(shard: pa.Table) -> pa.Table:
        number = shard.column("_shard")[0].as_py()
        rows = shard.drop_columns(["_shard"]).sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        which, offset = best_fit_decreasing(rows.column("length").to_numpy(), window)
        return rows.append_column("sequence_id", pa.array((number << 32) + which)).append_column("offset", pa.array(offset))

    return dealt.groupBy("_shard").applyInArrow(one, schema)


def pack_documents(docs: DataFrame, window: int = 4096, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed pieces with a digest of their ids instead of the ids themselves.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``. Only these
    numbers are shuffled. Null and empty texts give a piece of one id; rows that
    repeat a document give pieces that repeat; a null id stays null; other columns
    are ignored; an empty table gives no rows.
    """
    cut = tokenise(docs, window, vocabulary, id_col, text_col)
    digests = cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(checkpoint(digests), window)


def sequences(docs: DataFrame, window: int = 4096, vocabulary: str | None = None, pad_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The training sequences: ``sequence_id, ids array<int>, doc_ids array<long>``.

    Pieces are concatenated by offset and padded with ``pad_id`` to ``window``, but for
    sequences whose length is a power of two. A sequence has at most ``window``
    pieces, which bounds what is gathered.
    """
    packed = pack(checkpoint(tokenise(docs, window, vocabulary, id_col, text_col)), window, 2_000)
    grouped = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p"))
    schema = pa.schema([("sequence_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64()))])

    def join(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            for number, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(b"".join([p["ids"] for p in parts]), "<u4").astype(np.int32)
                if len(ids) & (len(ids) - 1):
                    ids = np.pad(ids, (0, window - len(ids)), constant_values=pad_id)
                for col, value in zip(out, (number, ids, [p["doc_id"] for p in parts])):
                    col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return grouped.mapInArrow(join, "sequence_id long, ids array<int>, doc_ids array<long>")


def op2_pack(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))
