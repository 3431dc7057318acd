"""WARC archives: a writer of one record a page, and a salvage reader that goes on after damage.

Writing: of pages with equal payloads (MIN_BYTES at least) that with the largest page_id is a response
record, the others are revisits of it without payload; a smaller payload is always a response. Each
task writes archives of about ARCHIVE_BYTES, every record a gzip member of its own (or plain). An
archive's name has an attempt's own token and goes to the manifest only if the task succeeds, so an
attempt that was lost leaves no second copy in the results.

Reading: archives are rows (path) that Spark spreads over tasks; each is streamed from its start, one
record in memory at a time. A record must pass these checks: gzip header, checksum and length; version
line, header lines, Content-Length, end mark; block digest, payload digest. After a failed check the
reader searches for the next gzip member whose content is a valid record, or for the next version line
that begins one, recovers from there, and gives the bytes between as a row of kind `gap` with the
failed check. Bytes of payload that look like a record are only taken for one if
the record around them is damaged.

Null html: empty. Null url: no target. Null page_id counts as the smallest; rows that repeat the
largest page_id of their payload are all responses. Empty table: no archive, no rows. Other columns
are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import BROADCAST_ROWS, dropped, few, pick, pieces, saved, store
from logspark.llm.media import opened

ARCHIVE_BYTES, LEVEL, MIN_BYTES = 64_000_000, 4, 0
#: Bytes read at once, fed to the decoder at once, and of a record's header lines at most.
CHUNK, FEED, HEADER = 1 << 20, 1 << 14, 1 << 16
#: Archives (rows) that one reading task gets, more only beyond READ_TASKS tasks.
READ_TASKS = 10_000
VERSION, DATE, PROFILE = "WARC/1.1", "2024-01-01T00:00:00Z", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC, MARK, END = b"\x1f\x8b\x08", b"WARC/", b"\r\n\r\n"
FIRST_LINE = re.compile(rb"WARC/\d+\.\d+\r\n")


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def sha1(data: bytes) -> str:
    return base32(hashlib.sha1(data, usedforsecurity=False).digest())


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record(kind: str, block: bytes, fields: list[tuple[str, str | None]]) -> bytes:
    """One record; fields without value are left out."""
    head = [("WARC-Type", kind), *fields, ("WARC-Date", DATE), ("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{name}: {value}\r\n" for name, value in head if value is not None)
    return f"{VERSION}\r\n{lines}\r\n".encode() + block + END


def page_record(page_id: int | None, url: str | None, payload: bytes | None, n: int, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or (payload None) a revisit of the page refers_to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    fields = [
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Target-URI", None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")),
        ("WARC-Page-ID", None if page_id is None else str(page_id)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if payload is None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Refers-To-Page-ID", str(refers_to))]
        return record("revisit", http, fields)
    return record("response", http + payload, fields)


def member(data: bytes, level: int = LEVEL) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def planned(pages: DataFrame, min_bytes: int = MIN_BYTES) -> tuple[DataFrame, DataFrame]:
    """(page_id, url, html (null for revisits), n_bytes, digest, refers_to) and the saved table of repeated payloads."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.octet_length(html).cast("long").alias("n_bytes"), F.sha1(html.cast("binary")).alias("h"))
    same = saved(rows.where(F.col("n_bytes") >= min_bytes).groupBy("h").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select(F.col("h").alias("k"), "refers_to"), "warc-same")
    joined = rows.join(F.broadcast(same) if few(same, BROADCAST_ROWS) else same, F.col("h") == F.col("k"), "left")
    again = F.col("k").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return joined.select("page_id", "url", F.when(~again, F.col("html")).alias("html"), "n_bytes", F.unhex("h").alias("digest"), F.when(again, F.col("refers_to")).alias("refers_to")), same


def _pack(directory: str, gzip: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    fs, base = opened(directory)
    part, token, made, sink, written, members = TaskContext.get().partitionId(), uuid.uuid4().hex, [], None, 0, 0
    wrap = member if gzip else bytes
    for batch in pieces(batches, "html"):
        for page_id, url, html, n, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if sink is None:
                name = f"part-{part:06d}-{token}-{len(made):04d}.warc{'.gz' if gzip else ''}"
                sink = fs.open_output_stream(f"{base}/{name}", compression=None)
                sink.write(wrap(record("warcinfo", f"software: salvage writer\r\nformat: {VERSION}\r\n".encode(), [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")])))
                written = members = 0
            data = wrap(page_record(page_id, url, None if html is None else html.encode(), n, base32(digest), refers_to))
            sink.write(data)
            written, members = written + len(data), members + 1
            if written >= ARCHIVE_BYTES:
                sink.close()
                made.append((f"{directory}/{name}", members))
                sink = None
    if sink is not None:
        sink.close()
        made.append((f"{directory}/{name}", members))
    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in made], pa.string()), pa.array([n for _, n in made], pa.int64())], names=["path", "records"])


def write_warc(pages: DataFrame, directory: str, gzip: bool = True, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write (page_id, url, html) rows as archives under directory; the saved manifest (path, records)."""
    fs, base = opened(directory)
    fs.create_dir(base, recursive=True)
    rows, same = planned(pages, min_bytes)
    manifest = saved(rows.mapInArrow(functools.partial(_pack, directory, gzip), "path string, records long"), "warc-manifest")
    dropped(same)
    return manifest


class Damaged(Exception):
    """A failed check."""


class Archive:
    """Bytes of an open archive by offset, through one buffered chunk."""

    def __init__(self, source, gzip: bool):
        self.source, self.size, self.gzip = source, source.size(), gzip
        self.begin, self.held = 0, b""

    def at(self, offset: int, n: int) -> bytes:
        if not self.begin <= offset < self.begin + len(self.held):
            self.source.seek(offset)
            self.begin, self.held = offset, self.source.read(max(n, CHUNK))
        out = self.held[offset - self.begin : offset - self.begin + n]
        while len(out) < n and offset + len(out) < self.size:
            self.begin = offset + len(out)
            self.source.seek(self.begin)
            self.held = self.source.read(max(n - len(out), CHUNK))
            if not self.held:
                break
            out += self.held[: n - len(out)]
        return out

    def decoded(self, offset: int, most: int | None = None) -> tuple[bytes, int]:
        """Content of the gzip member at offset (its first bytes if most is given), and the offset after it."""
        decoder, out, at = zlib.decompressobj(31), [], offset
        try:
            while not decoder.eof:
                fed = self.at(at, FEED)
                if not fed:
                    raise Damaged("gzip member is cut off")
                at += len(fed)
                out.append(decoder.decompress(fed, most or 0))
                if most and sum(map(len, out)) >= most:
                    break
        except zlib.error as e:
            raise Damaged(f"gzip member: {e}") from e
        return b"".join(out), at - len(decoder.unused_data)

    def record(self, offset: int) -> tuple[dict[str, str], bytes, int]:
        """Header fields (lower-case names), block and end of the record at offset, or Damaged."""
        if self.gzip:
            if self.at(offset, 3) != MAGIC:
                raise Damaged("no gzip member")
            if not MARK.startswith(self.decoded(offset, len(MARK))[0][: len(MARK)]):
                raise Damaged("no version line in the member")
            data, end = self.decoded(offset)
            fields, start, n = header(data[:HEADER])
            if len(data) != start + n + len(END):
                raise Damaged("Content-Length differs from the member")
            block, tail = data[start : start + n], data[start + n :]
        else:
            fields, start, n = header(self.at(offset, HEADER))
            if offset + start + n + len(END) > self.size:
                raise Damaged("record is cut off")
            block, tail = self.at(offset + start, n) if n else b"", self.at(offset + start + n, len(END))
            end = offset + start + n + len(END)
        if tail != END:
            raise Damaged("no end mark after Content-Length bytes")
        checked(fields, block)
        return fields, block, end

    def search(self, offset: int) -> int:
        """Offset of the next valid record from offset on, or the archive's size."""
        mark = MAGIC if self.gzip else MARK
        while offset < self.size:
            window = self.at(offset, CHUNK)
            place = window.find(mark)
            while place >= 0:
                found = offset + place
                try:
                    self.record(found)
                    return found
                except Damaged:
                    pass
                place = window.find(mark, place + 1)
            offset += max(1, len(window) - len(mark) + 1) if offset + len(window) < self.size else len(window)
        return self.size


def header(data: bytes) -> tuple[dict[str, str], int, int]:
    """Fields, offset of the block, Content-Length."""
    if not FIRST_LINE.match(data):
        raise Damaged("no version line")
    stop = data.find(END)
    if stop < 0:
        raise Damaged("header does not end")
    fields: dict[str, str] = {}
    for line in data[:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without colon")
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = fields.get("content-length", "")
    if not re.fullmatch("[0-9]{1,15}", length):
        raise Damaged("no Content-Length")
    if "warc-type" not in fields:
        raise Damaged("no WARC-Type")
    return fields, stop + len(END), int(length)


def payload_of(fields: dict[str, str], block: bytes) -> bytes | None:
    """What follows the HTTP header of a response, the block of other types; revisits have none."""
    if fields["warc-type"] == "revisit":
        return None
    if fields.get("content-type", "").startswith("application/http"):
        stop = block.find(END)
        return block[stop + len(END) :] if stop >= 0 else b""
    return block


def checked(fields: dict[str, str], block: bytes) -> None:
    """Known digests agree, or Damaged; digests of other kinds are not checked."""
    for name, data in (("warc-block-digest", block), ("warc-payload-digest", payload_of(fields, block))):
        kind, _, digest = fields.get(name, "").partition(":")
        if data is not None and kind.lower() == "sha1" and digest.upper() != sha1(data):
            raise Damaged(f"{name} differs")


def full_bytes(block: bytes) -> int | None:
    """Content-Length of a revisit's HTTP header."""
    found = re.search(rb"(?im)^content-length:\s*(\d{1,15})\s*$", block[:HEADER])
    return int(found[1]) if found else None


def entries(archive: Archive) -> Iterator[dict]:
    """Records and gaps of an archive in order."""
    at = 0
    while at < archive.size:
        try:
            fields, block, end = archive.record(at)
        except Damaged as e:
            end = archive.search(at + 1)
            yield {"offset": at, "length": end - at, "kind": "gap", "error": str(e)}
        else:
            payload = payload_of(fields, block)
            number = lambda name, f=fields: int(f[name]) if re.fullmatch("-?[0-9]{1,18}", f.get(name, "")) else None
            yield {"offset": at, "length": end - at, "kind": "record", "record_type": fields["warc-type"], "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "page_id": number("warc-page-id"), "refers_to": number("warc-refers-to-page-id"), "fields": list(fields.items()), "payload": payload, "payload_bytes": full_bytes(block) if payload is None else len(payload), "payload_digest": fields.get("warc-payload-digest", ":").partition(":")[2].upper() or None if payload is None else sha1(payload)}
        at = end


SCHEMA = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("error", pa.string())])
SCHEMA_DDL = "path string, offset long, length long, kind string, record_type string, record_id string, target_uri string, page_id long, refers_to long, fields map<string, string>, payload binary, payload_bytes long, payload_digest string, error string"


def _read(payloads: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            fs, name = opened(re.sub("^file:/+", "file:///", path))
            with fs.open_input_file(name) as source:
                rows, held = [], 0
                for entry in entries(Archive(source, name.endswith(".gz"))):
                    held += 500 + (len(entry.get("payload") or b"") if payloads else 0)
                    rows.append(entry | {"path": path} | ({} if payloads else {"payload": None}))
                    if held >= CHUNK:
                        yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)


def read_warc(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and gaps of archives (path); without payloads only their sizes and digests leave the workers."""
    rows = pick(archives, "path")
    tasks = max(1, min(READ_TASKS, rows.count()))
    return rows.repartition(tasks).mapInArrow(functools.partial(_read, payloads), SCHEMA_DDL)


def found(spark, directory: str) -> DataFrame:
    """(path) of the archives in a folder, listed by Spark without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(directory).select("path")


def op13_warc(spark, sf_dir: str) -> DataFrame:
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{store(spark)}/warc-{uuid.uuid4().hex}")
    rows = read_warc(manifest, payloads=False)
    return rows.where((F.col("kind") == "record") & F.col("record_type").isin("response", "revisit")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
