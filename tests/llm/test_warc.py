"""WARC archives: round trips, segments in any file and order, broken records, and the query's rows by brute force."""

import base64
import glob
import gzip
import hashlib
import random

import pytest

from rankloom.llm import warc

SCHEMA = "page_id long, url string, html string, place long, first string, size double"


def brute(rows, least):
    out = []
    for n, (i, _, html) in enumerate(rows):
        data = (html or "").encode()
        same = [(j is not None, j or 0, -m) for m, (j, _, h) in enumerate(rows) if (h or "") == (html or "")]
        best = max(same)
        kind = "response" if len(data) < least or best == (i is not None, i or 0, -n) else "revisit"
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, rows[-best[2]][0] if kind == "revisit" else None))
    return sorted(out, key=str)


def round_trip(spark, path, rows, least=0, **options):
    pages = spark.createDataFrame([(*r, 1, "f", 0.5) for r in rows], SCHEMA).coalesce(1)
    warc.write_warc(pages, path, least, **options)
    records = warc.read_warc(spark, path)
    found = warc.resolved(records).collect()
    assert all(r.problem is None for r in found)
    payloads = {r.page_id: r.payload for r in records.collect() if r.record_type == "response"}
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str), payloads


@pytest.mark.parametrize("least", [0, 30])
def test_round_trip(spark, tmp_path, least):
    rng = random.Random(1)
    htmls = ["", None, "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "é" * 500, "\r\n\r\n\n\r", "a\x00b", "0\r\n\r\n", "x" * 20_000, "short"]
    rows = [(n, rng.choice((None, f"http://e.x/{n} \r\nX: y", "http://é.x/")), rng.choice(htmls)) for n in range(60)]
    rows += [(None, None, "short"), (None, "u", "no id"), (7, "u", "ties"), (7, "v", "ties"), (7, "v", "ties")]
    found, payloads = round_trip(spark, f"{tmp_path}/{least}", rows, least, segment_bytes=1000)
    assert found == brute(rows, least)
    assert payloads == {i: (h or "").encode() for i, _, h in rows if i in payloads and i not in (7, None)} | {k: payloads[k] for k in (7, None)}
    raw = b"".join(gzip.open(f).read() for f in glob.glob(f"{tmp_path}/{least}/*.gz"))
    assert raw.count(b"WARC-Type: continuation") >= 20 and raw.count(b"WARC-Segment-Total-Length") == raw.count(b"WARC-Segment-Number: 1\r\n")


def test_empty_table(spark, tmp_path):
    assert round_trip(spark, f"{tmp_path}/none", [])[0] == []


def test_segments_come_in_any_file_and_order(spark, tmp_path):
    payload = bytes(random.Random(2).randrange(256) for _ in range(5000))
    fields = [("WARC-Type", "response"), ("WARC-Page-ID", 5), ("WARC-Payload-Digest", f"sha1:{warc.digest(payload)}")]
    block = warc.HTTP_HEAD + warc.chunked(payload, 700)
    whole = [warc.segments(fields, block, lambda k, name=name: f"<urn:{name}:{k}>", 999) for name in "abcd"]
    a, b, c, d = map(list, whole)
    broken = bytearray(warc.HTTP_HEAD + warc.chunked(payload, 700))
    broken[len(warc.HTTP_HEAD)] = ord("z")
    single = [warc.record([*fields, ("WARC-Record-ID", "<urn:e:1>")], bytes(broken)), warc.record([*fields, ("WARC-Record-ID", "<urn:f:1>")], warc.HTTP_HEAD + warc.chunked(payload[1:]))]
    plain = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:g:1>")], b"HTTP/1.0 200 OK\r\nX: 1\r\n\r\nplain")
    info = warc.record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:h:1>")], b"software: x")
    lost = warc.record([("WARC-Type", "revisit"), ("WARC-Record-ID", "<urn:i:1>"), ("WARC-Refers-To", "<urn:gone>")], warc.HTTP_HEAD)
    records = [*a, *b[1:], b[0], b[0], *c[:2], *c[3:], *d[:-1], *single, plain, info, lost]
    random.Random(3).shuffle(records)
    folder = tmp_path / "w"
    folder.mkdir()
    for k in range(3):  # each record is a member of its own, as crawlers write them
        (folder / f"{k}.warc.gz").write_bytes(b"".join(gzip.compress(r + b"\r\n\r\n") for r in records[k::3]))
    found = warc.read_warc(spark, str(folder))
    by = {r.record_id: r for r in found.collect()}
    assert len(by) == 9 and by["<urn:a:1>"].payload == by["<urn:b:1>"].payload == payload and by["<urn:a:1>"].page_id == 5
    assert {k[5]: r.problem for k, r in by.items() if r.problem} == {"c": "segments missing", "d": "segments missing", "e": "broken chunks", "f": "wrong digest"}
    assert by["<urn:g:1>"].payload == b"plain" and by["<urn:h:1>"].payload is None
    assert {r.record_id: r.problem for r in warc.resolved(found).collect()}["<urn:i:1>"] == "response missing"


def test_an_archive_that_ends_within_a_record_is_an_error(spark, tmp_path):
    folder = tmp_path / "w"
    folder.mkdir()
    (folder / "0.warc.gz").write_bytes(gzip.compress(warc.record([("WARC-Type", "response")], b"abcdef")[:-3]))
    with pytest.raises(Exception, match="ends within a record"):
        warc.read_warc(spark, str(folder))


def test_chunks():
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0A\r\n0123456789\r\n0\r\nTrailer: y\r\n\r\n") == b"abc0123456789"
    for bad in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"x\r\n", b"3\r\nabc"):
        assert warc.unchunked(bad) is None
    for n in (0, 1, 7, 8, 9, 100):
        assert warc.unchunked(warc.chunked(b"\r" * n, 8)) == b"\r" * n
