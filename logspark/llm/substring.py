"""Substring dedup by level-wise doubling of repeated windows.

Level one looks at windows of half the target length. Of the half-length windows inside each
target window the one with the smallest hash stands for it (equal target windows have the same
one), which keeps about one position in a dozen. Positions whose half-length window occurs in
one document only are done. The others' target windows are hashed at twice the length, and
those found in several documents survive. Words covered by a window that also starts in a
document with a smaller doc_id are removed.

Documents with equal word sequences are settled as wholes first: all but the smallest doc_id
lose every word if they hold a window. Hashes are 64-bit; whole documents compare by 128 bits.

Null and empty texts: no word. Rows that repeat a doc_id are one document with the longest of
their texts (then the greatest). Each row without doc_id comes back with nothing removed and
proves no repeat. Windows are judged on the input, of any length. No rows: no result rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import dropped, hashes, mix, one_text, pick, pieces, saved, side, signed, windows, word_codes

TARGET = 50
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def inside(offsets: np.ndarray, length: int, total: int) -> np.ndarray:
    """Whether a window of this length that starts at each word stays in its document."""
    end = np.repeat(offsets[1:], np.diff(offsets))
    return np.arange(total) + length <= end


def representatives(h: np.ndarray, half: int) -> np.ndarray:
    """For each target window's start, the place of its smallest half-length window (leftmost if equal), by doubling spans."""
    low = mix(windows(h, half))
    width, size = half + 1, 1
    if len(low) < width:
        return np.zeros(0, dtype=np.int64)
    at = np.arange(len(low))
    while size < width:
        step = min(size, width - size)
        left = low[:-step] <= low[step:]
        at = np.where(left, at[:-step], at[step:])
        low = np.where(left, low[:-step], low[step:])
        size += step
    return at


def survey(docs: DataFrame, target: int = TARGET) -> DataFrame:
    """Per document: n_words, hash of the word sequence, SHA-256 of the joined words, level-one positions."""
    half = target // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            codes, words, offsets = word_codes(batch.column("text"))
            h = hashes(words)[codes]
            spelled = words.to_pylist()
            total = len(h)
            at = representatives(h, half)
            kept = np.unique(at[inside(offsets, target, total)[: len(at)]])
            short = windows(h, half)
            bounds = np.searchsorted(kept, offsets)
            places = np.arange(total)
            a, b = mix(h + mix(places.astype(np.uint64))), mix(h ^ mix(places.astype(np.uint64) + np.uint64(7)))
            one, two, sha = [], [], []
            for i in range(len(offsets) - 1):
                lo, hi = offsets[i], offsets[i + 1]
                shift = np.arange(hi - lo, dtype=np.uint64)
                own = h[lo:hi]
                one.append(int(mix(own + mix(shift)).sum(dtype=np.uint64)))
                two.append(int(mix(own ^ mix(shift + np.uint64(7))).sum(dtype=np.uint64)))
                sha.append(hashlib.sha256(" ".join([spelled[c] for c in codes[lo:hi]]).encode()).hexdigest())
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([signed(short[kept]), pa.array(kept - np.repeat(offsets[:-1], np.diff(bounds)), pa.int32())], names=["h", "pos"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), signed(np.array(one, dtype=np.uint64)), signed(np.array(two, dtype=np.uint64)), pa.array(sha), lists], names=["doc_id", "n_words", "key1", "key2", "sha", "seeds"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_words long, key1 long, key2 long, sha string, seeds array<struct<h:long,pos:int>>")


def target_windows(rows: DataFrame, target: int) -> DataFrame:
    """(doc_id, h, start) of the target windows that the given positions stand for; rows: (doc_id, text, places)."""
    half = target // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            codes, words, offsets = word_codes(batch.column("text"))
            h = hashes(words)[codes]
            places = batch.column("places")
            at, full = representatives(h, half), windows(h, target)
            marked = np.zeros(len(h) + 1, dtype=bool)
            counts = places.value_lengths().to_numpy(zero_copy_only=False)
            marked[places.flatten().to_numpy(zero_copy_only=False) + np.repeat(offsets[:-1], counts)] = True
            ok = inside(offsets, target, len(h))[: len(at)] & marked[at]
            starts = np.flatnonzero(ok)
            owner = np.searchsorted(offsets, starts, side="right") - 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner)), signed(full[starts]), pa.array(starts - offsets[owner], pa.int32())], names=["doc_id", "h", "start"])

    return rows.mapInArrow(run, "doc_id long, h long, start int")


def repeated(rows: DataFrame) -> DataFrame:
    """(h, first): hashes that occur in several documents, with the smallest doc_id.

    Saved, so that a join with it shuffles rows by an exchange of its own, whose hot hashes Spark splits.
    """
    both = rows.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    return side(saved(both.select("h", "first"), "windows-repeated"))


def with_text(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """lists (doc_id, places) with the text of each; only texts that are needed are moved."""
    rows = pick(docs, "doc_id", "text").join(side(lists.select("doc_id")), "doc_id", "left_semi")
    return rows.join(lists, "doc_id").select("doc_id", "text", "places")


def cut(rows: DataFrame, target: int) -> DataFrame:
    """(doc_id, n_removed, kept_sha256, kept) after the windows at places are taken out of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            codes, words, offsets = word_codes(batch.column("text"))
            spelled, places = words.to_pylist(), batch.column("places")
            counts = places.value_lengths().to_numpy(zero_copy_only=False)
            starts = places.flatten().to_numpy(zero_copy_only=False) + np.repeat(offsets[:-1], counts)
            edge = np.zeros(len(codes) + target + 1, dtype=np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + target, -1)
            gone = np.cumsum(edge)[: len(codes)] > 0
            removed, kept = [], []
            for i in range(len(offsets) - 1):
                lo, hi = offsets[i], offsets[i + 1]
                removed.append(int(gone[lo:hi].sum()))
                kept.append(" ".join([spelled[c] for c in codes[lo:hi][~gone[lo:hi]]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(k.encode()).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.string())], names=["doc_id", "n_removed", "kept_sha256", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_removed long, kept_sha256 string, kept string")


def find(docs: DataFrame, target: int = TARGET) -> tuple[DataFrame, DataFrame]:
    """(documents, removals): n_words, sha and copy (whether it is a later copy) of each document; per other doc_id with repeats its window starts (places).

    docs: (doc_id, text) of one_text.
    """
    surveyed = saved(survey(docs, target), "windows-survey")
    named = F.col("doc_id").isNotNull()
    wholes = surveyed.where(named & (F.col("n_words") >= target))
    classes = wholes.groupBy("n_words", "key1", "key2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    classes = side(saved(classes.drop("last"), "windows-classes"))
    marked = surveyed.select("doc_id", "n_words", "key1", "key2", "sha").join(classes, ["n_words", "key1", "key2"], "left")
    documents = marked.select("doc_id", "n_words", "sha", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)).alias("copy"))
    documents = saved(documents, "windows-documents")
    copies = documents.where("copy").select("doc_id")
    seeds = wholes.join(side(copies), "doc_id", "left_anti").select("doc_id", F.explode("seeds").alias("s")).select("doc_id", "s.h", "s.pos")
    held = seeds.join(repeated(seeds), "h").groupBy("doc_id").agg(F.collect_set("pos").alias("places"))
    held = saved(held, "windows-half")
    wide = saved(target_windows(with_text(docs, held), target), "windows-target")
    removals = wide.join(repeated(wide), "h").where(F.col("first") < F.col("doc_id")).groupBy("doc_id").agg(F.collect_set("start").alias("places"))
    removals = saved(removals, "windows-removals")
    dropped(surveyed, held, wide)
    return documents, removals


def op6_substring(spark, sf_dir: str) -> DataFrame:
    docs = one_text(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    documents, removals = find(docs)
    parts = cut(with_text(docs, removals), TARGET).drop("kept")
    out = documents.join(parts, "doc_id", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def cut_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents whose repeated passages are cut out; a document that had words and keeps none goes.

    Rows that repeat a doc_id are one document, as in one_text; all rows without doc_id stay as they are.
    """
    names = [c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in docs.columns]
    texts = one_text(docs)
    documents, removals = find(texts)
    parts = saved(cut(with_text(texts, removals), TARGET).select("doc_id", "kept"), "windows-kept")
    rows = pick(docs, *names).join(side(documents.where("copy").select("doc_id")), "doc_id", "left_anti")
    joined = rows.join(parts, "doc_id", "left").where(F.col("kept").isNull() | (F.col("kept") != ""))
    n_chars = F.when(F.col("kept").isNull(), F.col("n_chars") if "n_chars" in names else F.lit(None)).otherwise(F.length("kept"))
    swap = {"text": F.coalesce("kept", "text").alias("text"), "n_chars": n_chars.cast("long").alias("n_chars")}
    return joined.select(*[swap.get(n, F.col(n)) for n in names])
