"""WARC writing, and what the reader saves from damaged archives."""

import base64
import hashlib
import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logspark.llm import warc

SCHEMA = "page_id long, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({"path": F.lit(1), "h": F.lit("x"), "k": F.lit(0), "n_bytes": F.lit(2), "digest": F.lit("d"), "refers_to": F.lit(3)})


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def wanted(rows, least=0):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "")]
        best = max((p for p in same if p is not None), default=None)
        first = len(data) < least or page == best
        out.append((page, len(data), digest(data), "response" if first else "revisit", None if first else best))
    return sorted(out, key=str)


ROWS = [(1, "http://a/1", "<p>é one</p>"), (2, "http://a/2", "<p>é one</p>"), (3, None, None), (4, "u", ""), (5, "u\r\nX: y z", "<b>" + "long " * 60_000), (None, "n", "<p>é one</p>"), (None, "n", "only null"), (None, "n", "only null"), (9, "w", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\n"), (8, "t", "tiny"), (7, "t", "tiny"), (8, "t", "tiny")]


@pytest.mark.parametrize("gzip, least", [(True, 0), (False, 0), (True, 6)])
def test_round_trip(spark, tmp_path, monkeypatch, gzip, least):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 400)
    manifest = warc.write_warc(pages(spark, ROWS), f"file://{tmp_path}", gzip=gzip, min_bytes=least)
    rows = warc.read_warc(manifest).where("record_type <> 'warcinfo' or kind = 'gap'").collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str) == wanted(ROWS, least)
    by_page = {r.page_id: r for r in rows}
    assert by_page[5].payload.decode() == ROWS[4][2] and by_page[9].payload.decode() == ROWS[8][2] and by_page[3].target_uri is None
    assert "\n" not in by_page[5].target_uri and dict(by_page[8].fields)["warc-page-id"] == "8"
    assert {r.path.rpartition("/")[2] for r in warc.found(spark, str(tmp_path)).collect()} == {r.path.rpartition("/")[2] for r in manifest.collect()}


def test_empty_table(spark, tmp_path):
    assert warc.read_warc(warc.write_warc(pages(spark, []), f"file://{tmp_path}/none")).count() == 0


def archive(tmp_path, data, gzip):
    path = tmp_path / ("a.warc.gz" if gzip else "a.warc")
    path.write_bytes(data)
    with pa.OSFile(str(path)) as source:
        return list(warc.entries(warc.Archive(source, gzip)))


def made(n, gzip, seed=1):
    rng = random.Random(seed)
    records = [warc.page_record(i, f"http://x/{i}", (text := f"<p>{rng.random()} " + "words and " * rng.randrange(50)).encode(), len(text), digest(text.encode()), None) for i in range(n)]
    return [warc.member(r) if gzip else r for r in records]


def covered(got, size):
    """Rows lie end to end over the whole archive."""
    assert [r["offset"] for r in got] == [0, *itertools.accumulate(r["length"] for r in got)][: len(got)] and sum(r["length"] for r in got) == size


@pytest.mark.parametrize("gzip", [True, False])
def test_any_single_byte_loses_one_record_at_most(tmp_path, gzip):
    parts = made(5, gzip)
    data = b"".join(parts)
    bounds = [0, *itertools.accumulate(map(len, parts))]
    for at in range(0, len(data), 7):
        hurt = bytearray(data)
        hurt[at] ^= 0x15
        got = archive(tmp_path, bytes(hurt), gzip)
        covered(got, len(data))
        owner = next(i for i in range(5) if at < bounds[i + 1])
        pages_read = [r["page_id"] for r in got if r["kind"] == "record"]
        assert set(range(5)) - {owner} <= set(pages_read)
        for r in got:
            assert r["kind"] != "gap" or (r["offset"] == bounds[owner] and r["length"] == len(parts[owner]) and r["error"])


@pytest.mark.parametrize("gzip", [True, False])
def test_cut_junk_and_missing_bytes(tmp_path, gzip):
    parts = made(6, gzip)
    junk = bytes(random.Random(2).randrange(256) for _ in range(3_000)) + b"\nWARC/1.0\r\nno header" + warc.MAGIC + b"xyz"
    data = junk + parts[0] + parts[1][:-30] + parts[2] + junk + parts[3] + parts[4] + parts[5][:-1]
    got = archive(tmp_path, data, gzip)
    covered(got, len(data))
    assert [r["page_id"] for r in got if r["kind"] == "record"] == [0, 2, 3, 4]
    gaps = [(r["offset"], r["length"]) for r in got if r["kind"] == "gap"]
    assert gaps[0] == (0, len(junk)) and len(gaps) == 4 and gaps[3][1] == len(parts[5]) - 1
    assert archive(tmp_path, b"", gzip) == []
    assert [r["kind"] for r in archive(tmp_path, junk, gzip)] == ["gap"]


def test_wrong_length_and_wrong_digest(tmp_path):
    good = made(3, False)
    longer = good[1].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    other = good[1].replace(b"words", b"wards", 1) if b"words" in good[1] else good[1].replace(b"<p>", b"<q>", 1)
    for bad, gzip in ((longer, False), (other, False), (other, True)):
        parts = [warc.member(r) if gzip else r for r in (good[0], bad, good[2])]
        got = archive(tmp_path, b"".join(parts), gzip)
        assert [(r["kind"], r.get("page_id")) for r in got] == [("record", 0), ("gap", None), ("record", 2)]
        covered(got, sum(map(len, parts)))


def test_search_over_chunk_borders(tmp_path, monkeypatch):
    parts = made(4, False)
    for chunk in (64, 257, 1_001):
        monkeypatch.setattr(warc, "CHUNK", chunk)
        for gzip in (True, False):
            packed = [warc.member(p) if gzip else p for p in parts]
            data = b"x" * 700 + packed[0] + b"y" * 333 + packed[1] + packed[2]
            got = archive(tmp_path, data, gzip)
            covered(got, len(data))
            assert [r["page_id"] for r in got if r["kind"] == "record"] == [0, 1, 2]
