"""Helpers that the training-data operators share: columns, words, hashes, saved tables."""

from __future__ import annotations

import contextlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes and rows that one piece of a batch holds at most; a longer text is a piece of its own.
PIECE_BYTES, PIECE_ROWS = 1_000_000, 2_000
#: Rows up to which a side may be broadcast after its rows were counted.
BROADCAST_ROWS = 1_000_000


#: Settings while a table is saved: its shuffles are dropped once it stands; batches for the workers hold so many rows.
CLEANUP, BATCH = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"


def store(spark: SparkSession) -> str:
    """Shared folder for saved tables: spark.checkpoint.dir; if unset, a temporary one for a local master only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


@contextlib.contextmanager
def saving(spark: SparkSession, rows: int) -> Iterator[None]:
    """CLEANUP and BATCH hold inside; the session's own settings come back afterwards."""
    now = {CLEANUP: "true", BATCH: str(rows)}
    before = {k: spark.conf.get(k, None) for k in now}
    for k, v in now.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def saved(df: DataFrame, what: str, rows: int = 2_000, codec: str = "snappy") -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there. rows: of a batch for the workers."""
    spark = df.sparkSession
    path = f"{store(spark)}/{what}-{uuid.uuid4().hex}"
    with saving(spark, rows):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that saved() made, once nothing that is still to run reads them."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.saved_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def pick(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that other columns of the input can't clash with new ones."""
    return docs.select(*[docs[n] for n in names])


def one_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text), a row for each doc_id: of rows that repeat one the longest text, then the greatest. Rows without doc_id all stay.

    Only the ids are shuffled, and the texts of repeated ids.
    """
    rows = pick(docs, "doc_id", "text")
    many = rows.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id")
    many = saved(many, "repeated-ids")
    if few(many, 0):
        return rows
    again = side(many)
    best = F.max_by("text", F.struct(F.length(F.coalesce("text", F.lit(""))), "text")).alias("text")
    return rows.join(again, "doc_id", "left_anti").unionByName(rows.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(best))


def few(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most limit rows; counts no further than needed."""
    return df.limit(limit + 1).count() <= limit


def side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are few, else as it is (a shuffled join follows)."""
    return F.broadcast(df) if few(df, limit) else df


def crc_mod(ids: pa.Array, mod: int) -> np.ndarray:
    """crc32 of each id as text, modulo mod; null ids count as the empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % mod for i in ids.to_pylist()], dtype=np.int64)


def crc_mod_column(doc_id, mod: int):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most PIECE_BYTES of text and PIECE_ROWS rows (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        total, start = 0, 0
        for i, n in enumerate(size.tolist()):
            if i > start and (total + n > PIECE_BYTES or i - start >= PIECE_ROWS):
                yield batch.slice(start, i - start)
                total, start = 0, i
            total += n
        yield batch.slice(start)
    # A worker outlives its partition: what Arrow holds in reserve goes back.
    pa.default_memory_pool().release_unused()


def word_codes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, list, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of texts: code of each word, distinct words, offsets of each text's words."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    encoded = flat.dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    words = encoded.dictionary
    owner = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not full.all():
        codes, owner = codes[full], owner[full]
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(np.bincount(owner, minlength=len(texts)), out=offsets[1:])
    return codes, words, offsets


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word; the same in every process."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes, by doubling; shorter input gives none."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    out, have, power, size = None, 0, h, 1
    while size <= n:
        if n & size:
            out = power[: len(h) - size + 1] if out is None else mix(out[: len(h) - have - size + 1] * np.uint64(0x9E3779B97F4A7C15) + power[have : have + len(h) - have - size + 1])
            have += size
        size *= 2
        if size <= n:
            half = size // 2
            power = mix(power[:-half] * np.uint64(0x9E3779B97F4A7C15) + power[half:]) if half < len(power) else power[:0]
    return out


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64, copy=False).view(np.int64))


def empty(schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], type=f.type) for f in schema], schema=schema)
