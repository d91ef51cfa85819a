"""WARC archives: pages written as records, and records put together again from their segments.

Archives are gzip files of Spark's text writer, whose line separator is the pair of line ends
after a record. They are read by Spark's text reader, line by line and in order, as a gzip file is not split; so a task holds one
record at a time. A record of several segments is put together by a group of its origin's identifier.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, checkpoint_dir, join_groups, table, written
from .exact_dedup import _with_shared

#: Bytes of a block in one record; what is longer goes on in continuation records.
SEGMENT_BYTES = 1 << 15
#: Bytes of a chunk of the transfer framing.
CHUNK_BYTES = 1 << 12
CRLF, BLANK_LINE = b"\r\n", b"\r\n\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nTransfer-Encoding: chunked\r\n\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Columns of a parsed record; a record without segments has its payload's figures, a segment its block.
PARSED = "record_id string, record_type string, page_id long, url string, refers_to_id string, segment int, origin_id string, total_length long, stated_digest string, payload_bytes long, payload_digest string, payload binary, block binary, problem string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """``payload`` in chunked transfer framing."""
    parts = (payload[k : k + size] for k in range(0, len(payload), size))
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes | None:
    """What chunked framing holds; None if it is broken."""
    out, at = [], 0
    while True:
        end = data.find(CRLF, at)
        size = re.fullmatch(rb"\s*([0-9A-Fa-f]+)\s*(?:;.*)?", data[at:end], re.S) if end >= 0 else None
        if size is None:
            return None
        n, at = int(size[1], 16), end + 2
        if n == 0:
            return b"".join(out)
        if data[at + n : at + n + 2] != CRLF:
            return None
        out.append(data[at : at + n])
        at += n + 2


def fields_of(head: bytes) -> dict[str, str]:
    """Named fields of a header, names in lower case; a folded line goes on with the one before."""
    text = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace"))
    pairs = (line.partition(":") for line in text.split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, colon, value in pairs if colon}


def payload_of(block: bytes) -> tuple[bytes | None, str | None]:
    """Payload of an HTTP response, and what is wrong with it."""
    head, blank, body = block.partition(BLANK_LINE)
    if not blank:
        return None, "no HTTP header"
    if "chunked" not in fields_of(head).get("transfer-encoding", "").lower():
        return body, None
    plain = unchunked(body)
    return plain, "broken chunks" if plain is None else None


def record(fields: Iterable[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends after it; fields of None are left out."""
    lines = [f"{name}: {value}" for name, value in fields if value is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"]).encode("utf-8", "surrogatepass") + BLANK_LINE + block


def segments(fields: list[tuple[str, object]], block: bytes, name, size: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The record, or its segments if the block is longer than ``size``: the first has the fields, the others their origin, the last the total length. ``name(k)`` is the identifier of segment k."""
    if len(block) <= size:
        yield record([*fields, ("WARC-Record-ID", name(1))], block)
        return
    for k, at in enumerate(range(0, len(block), size), 1):
        own = fields if k == 1 else [("WARC-Type", "continuation"), *((n, v) for n, v in fields if n in ("WARC-Target-URI", "WARC-Date")), ("WARC-Segment-Origin-ID", name(1))]
        total = len(block) if at + size >= len(block) else None
        yield record([*own, ("WARC-Record-ID", name(k)), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total)], block[at : at + size])


def chosen(pages: DataFrame, min_bytes: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``place, page_id, url, payload, sha1, first, first_url``: of pages with one payload of at least ``min_bytes`` bytes, ``first`` is the place of the one with the largest id.

    It is null, and the payload there, for that page and for pages alone. A bitmap of the payloads that several pages have tells
    which rows to look at; only these meet by payload, without it, and only their payloads are shuffled, by place, to drop those of revisits.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = written(rows.withColumn("place", F.monotonically_increasing_id()).withColumns({"key": F.sha2("payload", 256), "sha1": F.sha1("payload"), "counts": F.octet_length("payload") >= min_bytes}))
    best = F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", (-F.col("place")).alias("back"), "url")).alias("best")
    groups = rows.where("counts").groupBy("key").agg(best, F.count(F.lit(1)).alias("size")).where("size > 1")
    groups = groups.select("key", "size", (-F.col("best.back")).alias("first"), F.col("best.url").alias("first_url"))
    flagged = _with_shared(rows, "shared", ["key"], F.col("counts"))
    looked_at = flagged.where("shared").select("place", "page_id", "url", "key", "sha1")
    revisits = checkpoint(join_groups(looked_at, groups, "key", "place", rows.count()).where("first <> place").select("place", "page_id", "url", F.lit(None).cast("binary").alias("payload"), "sha1", "first", "first_url"))
    alone = flagged.where("not shared").unionByName(flagged.where("shared").join(revisits.select("place"), "place", "left_anti"))
    return alone.select("place", "page_id", "url", "payload", "sha1").unionByName(revisits, allowMissingColumns=True)


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, date: str = "2000-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes one record for each row of ``pages`` to gzip files in ``path``.

    Pages whose payload a page with a larger id has too, of at least ``min_bytes`` bytes, become revisits of that
    page. Of rows that share payload and largest id, one is the response. A null id counts as the smallest and is not written, nor is a null url; null html is an
    empty payload; other columns are ignored. An empty table gives archives without records.
    """
    made = uuid.uuid4()

    def name(place: int, k: int = 1) -> str:
        return f"<urn:uuid:{uuid.uuid5(made, f'{place}/{k}')}>"

    def uri(url: str | None) -> str | None:
        return url if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            for place, page, url, payload, sha1, first, first_url in zip(*(c.to_pylist() for c in batch.columns)):
                kind = "response" if first is None else "revisit"
                fields = [("WARC-Type", kind), ("WARC-Date", date), ("WARC-Target-URI", uri(url)), ("WARC-Page-ID", page), ("WARC-Payload-Digest", f"sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}"), ("Content-Type", "application/http; msgtype=response")]
                if first is not None:
                    fields += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", name(first)), ("WARC-Refers-To-Target-URI", uri(first_url))]
                block = HTTP_HEAD if first is not None else HTTP_HEAD + chunked(payload)
                out += segments(fields, block, lambda k, place=place: name(place, k), segment_bytes)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    rows = chosen(pages, min_bytes, id_col, url_col, html_col).mapInArrow(records, "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", BLANK_LINE.decode()).option("compression", "gzip").text(path)


class Parser:
    """Cuts a stream of bytes into records by their stated lengths."""

    def __init__(self) -> None:
        self.rest = bytearray()
        self.wanted = 0

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.rest += data
        at = 0
        while len(self.rest) - at >= self.wanted:
            while self.rest[at : at + 2] == CRLF:
                at += 2
            if self.rest[at : at + 1] == b"\n":  # a line end that the reader has added at the end of a file
                at += 1
            end = self.rest.find(BLANK_LINE, at)
            if end < 0:
                break
            head = bytes(self.rest[at:end])
            fields = fields_of(head)
            if not head.startswith(b"WARC/") or not fields.get("content-length", "").isdigit():
                raise ValueError(f"not a record header: {head[:100]!r}")
            stop = end + 4 + int(fields["content-length"])
            if len(self.rest) < stop:
                self.wanted = stop - at
                break
            yield fields, bytes(self.rest[end + 4 : stop])
            at, self.wanted = stop, 0
        del self.rest[:at]

    def over(self) -> bool:
        """Whether no part of a record is left."""
        return not self.rest.strip(b"\r\n")


def _integer(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d+", text) else None


def _whole(kind: str, block: bytes, stated: str | None, with_payload: bool) -> tuple:
    """``payload_bytes, payload_digest, payload, problem`` of a whole record."""
    if kind != "response":
        return None, None, None, None
    payload, problem = payload_of(block)
    if payload is None:
        return None, None, None, problem
    found = digest(payload)
    return len(payload), found, payload if with_payload else None, "wrong digest" if stated and stated != found else None


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row for each response, revisit or other whole record of the gzip archives in ``path``: the columns of ``PARSED`` but those of segments.

    Continuation records may lie in any file and order. A record whose segments are not 1, 2, ... up to the one with the total
    length, or do not add up to it, has a ``problem`` and no payload, as has one with broken chunks; a payload
    that does not have the stated digest has a ``problem`` too. Repeated segments count once. A file that ends within a record is an error.
    """
    schema = [(f.split()[0], f.split()[1]) for f in PARSED.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    arrow = pa.schema([(n, kinds[t]) for n, t in schema])

    def row(fields: dict[str, str], block: bytes) -> tuple:
        kind, segment, origin = fields.get("warc-type", ""), _integer(fields.get("warc-segment-number")), fields.get("warc-segment-origin-id")
        stated = fields.get("warc-payload-digest", "")
        stated = stated.removeprefix("sha1:") if stated.startswith("sha1:") else None
        parts = segment is not None or origin is not None
        whole = (None, None, None, None) if parts else _whole(kind, block, stated, with_payload)
        own = fields.get("warc-record-id")
        return own, kind, _integer(fields.get("warc-page-id")), fields.get("warc-target-uri"), fields.get("warc-refers-to"), segment, (origin or own) if parts else None, _integer(fields.get("warc-segment-total-length")), stated, *whole[:3], block if parts else None, whole[3]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, current = Parser(), None
        for batch in batches:
            files, rows, size = batch.column(0).to_numpy(), [], 0
            turns = [0, *((files[1:] != files[:-1]).nonzero()[0] + 1).tolist(), len(files)]
            for low, high in zip(turns, turns[1:]):
                if low < high and files[low] != current:
                    if not parser.over():
                        raise ValueError("an archive ends within a record")
                    parser, current = Parser(), files[low]
                for fields, block in parser.feed(b"\n".join([*batch.column(1).slice(low, high - low).to_pylist(), b""])):
                    rows.append(row(fields, block))
                    size += len(block)
                    if size > 1 << 24:
                        yield batch_of(rows)
                        rows, size = [], 0
            if rows:
                yield batch_of(rows)
        if not parser.over():
            raise ValueError("an archive ends within a record")

    def joined(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.drop_duplicates("segment").sort_values("segment")
        totals = parts["total_length"].dropna()
        first, block = parts.iloc[0].to_dict(), b"".join(parts["block"])
        if parts["segment"].tolist() != list(range(1, len(parts) + 1)) or len(totals) != 1 or len(block) != int(totals.iloc[0]):
            whole = (None, None, None, "segments missing")
        else:
            whole = _whole(first["record_type"], block, first["stated_digest"], with_payload)
        first |= dict(zip(("payload_bytes", "payload_digest", "payload", "problem"), whole)) | {"block": None, "total_length": None, "segment": None, "origin_id": None}
        return pd.DataFrame([first]).astype({n: "Int64" for n in ("page_id", "payload_bytes", "segment", "total_length")})

    lines = spark.read.option("lineSep", "\n").text(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    records = written(lines.mapInArrow(parsed, PARSED))
    parts = records.where("origin_id is not null").groupBy("origin_id").applyInPandas(joined, PARSED)
    return records.where("origin_id is null").unionByName(parts).drop("segment", "origin_id", "total_length", "block")


def resolved(records: DataFrame) -> DataFrame:
    """Adds ``refers_to``, the page of the response that a revisit refers to, and gives the revisit that payload's length and digest.

    A revisit whose response is not there keeps nulls and has a ``problem``, as has one whose stated digest differs.
    Many revisits may refer to one response.
    """
    narrow = checkpoint(records.select("record_id", "record_type", "page_id", "refers_to_id", "stated_digest", "payload_bytes", "payload_digest", "problem").withColumn("place", F.monotonically_increasing_id()))
    revisits = narrow.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest", "problem")
    wanted = revisits.groupBy("refers_to_id").agg(F.count(F.lit(1)).alias("size"))
    of = narrow.where("record_type = 'response'").select(F.col("record_id").alias("_id"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    groups = wanted.join(of, wanted["refers_to_id"] == of["_id"]).drop("_id")
    found = join_groups(revisits, groups, "refers_to_id", "place", narrow.count())
    problem = F.when(F.col("payload_digest").isNull(), "response missing").when(F.col("stated_digest") != F.col("payload_digest"), "wrong digest")
    rest = narrow.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    return rest.unionByName(found.withColumn("problem", problem), allowMissingColumns=True).drop("place", "size")


def op12_warc(spark, sf_dir):
    """Contract of op12: archives in the shared folder are written, read back and resolved; see ``write_warc``, ``read_warc`` and ``resolved``."""
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    found = resolved(read_warc(spark, path, with_payload=False))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


OP12_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages
), g AS (
  SELECT *, list_transform(range(8), lambda k: CAST('0x' || substr(h, CAST(5 * k + 1 AS INTEGER), 5) AS BIGINT)) AS fives FROM p
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((fives[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM g
"""
