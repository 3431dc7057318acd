"""Media columns: payloads in archive directories, read by a Spark data source in byte ranges.

Writing: each task packs its payloads as 8-bit greyscale PNG images, WIDTH samples a row, into
ZIP archives of about ARCHIVE_BYTES; a finished archive is moved to its final name, which a
repeated task would overwrite with equal contents. Reading (format `media_archive`): the
directory's archives are cut into byte ranges of RANGE_BYTES, longer ones where there would be
more than MAX_RANGES, so that the driver's list is bounded; a range's task reads the members
whose headers start in it, in Arrow batches, and tries each member again by its own offset, after
a pause and with the archive opened anew, when a read or its checksum fails. A member that fails
RETRIES times stays in the result with its error.

Null and empty texts: one padded block. Repeated rows: each is a member of its own. A payload
is held by one task at a time, whatever its length.
"""

from __future__ import annotations

import contextlib
import hashlib
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from logspark.llm.common import pick, pieces, store

WIDTH = 576
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES, RETRIES = 32_000_000, 8_000_000, 4_000_000, 3
#: Ranges that the driver lists at most, if each archive is one, and seconds before the first repeated read.
MAX_RANGES, PAUSE = 100_000, 0.2
SCHEMA = "archive string, offset long, doc_id long, n_bytes long, media binary, error string"


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of text with bytes 255 up to a positive multiple of WIDTH; the length without them."""
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % WIDTH if raw else WIDTH), len(raw)


def to_png(payload: bytes) -> bytes:
    """Greyscale PNG, 8 bits a sample, rows of WIDTH samples without filters."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)
    lines[:, 1:] = rows
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """Payload of an image that to_png made."""
    at, data = 8, b""
    while at < len(media):
        n = struct.unpack(">I", media[at : at + 4])[0]
        if media[at + 4 : at + 8] == b"IDAT":
            data += media[at + 8 : at + 8 + n]
        at += 12 + n
    return np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(-1, WIDTH + 1)[:, 1:].tobytes()


def opened(uri: str):
    return pafs.FileSystem.from_uri(uri)


def write_archives(docs: DataFrame, directory: str) -> None:
    """Pack (doc_id, text) rows into archives under directory (a URI that pyarrow opens)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = opened(directory)
        part, number, archive, sink, temp, members, sizes = TaskContext.get().partitionId(), 0, None, None, "", 0, []

        def close() -> None:
            nonlocal archive, number
            if archive is not None:
                archive.close()
                sink.close()
                fs.move(temp, f"{base}/part-{part:06d}-{number:04d}.zip")
                sizes.append(members)
                archive, number = None, number + 1

        for batch in pieces(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if archive is None:
                    temp, members = f"{base}/_open-{part:06d}-{uuid.uuid4().hex}", 0
                    sink = fs.open_output_stream(temp)
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
                payload, n = padded(text)
                info = zipfile.ZipInfo(f"{members}_{'' if doc_id is None else doc_id}_{n}.png")
                archive.writestr(info, to_png(payload))
                members += 1
                if archive.fp.tell() >= ARCHIVE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_pydict({"members": pa.array(sizes, pa.int64())})

    fs, base = opened(directory)
    fs.create_dir(base, recursive=True)
    pick(docs, "doc_id", "text").mapInArrow(pack, "members long").agg(F.sum("members")).collect()


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.directory = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[ByteRange]:
        fs, base = opened(self.directory)
        files = [f for f in fs.get_file_info(pafs.FileSelector(base)) if f.base_name.endswith(".zip")]
        step = max(self.range_bytes, -(-sum(f.size for f in files) // MAX_RANGES))
        return [ByteRange(f.path, at, at + step) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size, step)]

    def read(self, part: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # a directory without archives has no range
            return
        fs, _ = opened(self.directory)
        rows: list[tuple] = []
        held = 0
        with fs.open_input_file(part.path) as source, zipfile.ZipFile(source) as archive:
            members = [m for m in archive.infolist() if part.start <= m.header_offset < part.end]
        source = None
        try:
            for member in sorted(members, key=lambda m: m.header_offset):
                media, error, source = self.member(fs, part.path, member, source)
                _, doc_id, n = member.filename.removesuffix(".png").split("_")
                rows.append((part.path.rpartition("/")[2], member.header_offset, int(doc_id) if doc_id else None, int(n), media, error))
                held += len(media or b"")
                if held >= BATCH_BYTES:
                    yield self.batch(rows)
                    rows, held = [], 0
        finally:
            if source is not None:
                source.close()
        yield self.batch(rows)

    @staticmethod
    def member(fs, path: str, member: zipfile.ZipInfo, source) -> tuple[bytes | None, str | None, pa.NativeFile | None]:
        """The member's bytes, or the last error, and the open archive; after a failure it is opened anew."""
        error = ""
        for attempt in range(RETRIES):
            if attempt:
                time.sleep(PAUSE * 2 ** (attempt - 1))
            try:
                source = fs.open_input_file(path) if source is None else source
                source.seek(member.header_offset)
                head = source.read(30)
                source.seek(member.header_offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
                media = source.read(member.compress_size)
                if zlib.crc32(media) == member.CRC:
                    return media, None, source
                error = "checksum differs"
            except OSError as e:
                error = str(e)
            with contextlib.suppress(OSError):
                if source is not None:
                    source.close()
            source = None
        return None, error, None

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["archive", "offset", "doc_id", "n_bytes", "media", "error"])


class MediaArchive(DataSource):
    """spark.read.format("media_archive").option("rangeBytes", n).load(directory)"""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, directory: str) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").load(directory)


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the shares of 8 equal ranges in thousandths."""
    counts = np.bincount(np.frombuffer(payload, dtype=np.uint8), minlength=256)
    share = counts / counts.sum()
    level = np.arange(256)
    mean = float(share @ level)
    deviation = float(np.sqrt(max(0.0, share @ (level - mean) ** 2)))
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    return f"{mean:.3f}|{deviation:.3f}|{entropy:.4f}|" + ",".join(str(int(round(1000 * x))) for x in share.reshape(8, 32).sum(axis=1))


def features(members: DataFrame) -> DataFrame:
    """Digest columns and feature of each stored member; null where it could not be read (column error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "media"):
            out: list[tuple] = []
            for media in batch.column("media").to_pylist():
                if media is None:
                    out.append((None,) * 6)
                    continue
                payload = from_png(media)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)), batch.column("error")], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"])

    return members.select("doc_id", "n_bytes", "media", "error").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


def op9_media(spark, sf_dir: str) -> DataFrame:
    directory = f"{store(spark)}/media-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/documents.parquet"), directory)
    return features(read_archives(spark, directory))
