"""Language identification by nearest centroid.

A text is its normalised TF-IDF vector over hashed character n-grams (1 to 3, words padded by
spaces). Each language has several centroids, clustered by spherical k-means; the closest by
cosine gives the language. A text farther from it than nearly all training texts of that
centroid is rejected (column rejected; lang_nearest keeps the answer).

Null texts and texts without a letter: `und`, score 0, rejected. Rows without lang don't train.
Repeated rows: each is answered. Whole texts of any length are read. Equal similarities: the
first centroid in order of language and bytes. No training text: `und` for all; no rows: no
result rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logspark.llm.common import crc_mod_column, pick, pieces, saved

#: Hashed dimensions, centroids per language, distinct training texts per language at most.
DIMS, CENTROIDS, SAMPLE = 1 << 14, 4, 1500
#: Share of training texts that may lie farther than the rejection distance; sharpness of the score.
REJECT_SHARE, SHARPNESS = 0.002, 20.0
LETTER = re.compile(r"[^\W\d_]")
GAP = re.compile(r"[\W\d_]+")


def gram_counts(text: str) -> np.ndarray:
    """Hashed counts of the character 1- to 3-grams of a whole text."""
    plain = " " + GAP.sub(" ", text.lower()) + " "
    c = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    out = np.bincount((c * np.uint64(2654435761) >> np.uint64(7)) & np.uint64(DIMS - 1), minlength=DIMS).astype(np.float64)
    key = c
    for n in (2, 3):
        key = key[:-1] * np.uint64(1_000_003) + c[n - 1 :]
        mixed = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)
        out += np.bincount(mixed.astype(np.int64), minlength=DIMS)
    return out


def vector(text: str, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(gram_counts(text)) * idf
    norm = np.linalg.norm(v)
    return v / norm if norm else v


def bounded_sample(rows: DataFrame) -> DataFrame:
    """The SAMPLE distinct texts of each language with the smallest hashes (all if there are fewer), so that reruns agree and copies count once."""
    key = F.xxhash64("text", F.lit("langid"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct(key).alias("n"))  # a row a language
    spread = F.pmod(F.col("key"), F.lit(1_000_003)) / 1_000_003.0
    # Somewhat more than asked for, so that the rank below only sees a few thousand rows a language.
    near = rows.select("lang", "text", key.alias("key")).join(F.broadcast(counts), "lang").where(spread * F.col("n") < 2 * SAMPLE)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(spread, "key", "text"))
    return near.dropDuplicates(["lang", "text"]).withColumn("rank", rank).where(F.col("rank") <= SAMPLE).select("lang", "text")


def fit(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, matrix of centroids, their rejection cosines, idf. The sample's size is bounded by SAMPLE per language."""
    rows = pick(labelled, "lang", "text").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sample = saved(bounded_sample(rows), "langid-sample")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMS, dtype=np.int64), 0
        for batch in pieces(batches):
            for text in batch.column("text").to_pylist():
                total += gram_counts(text) > 0
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"dim": pa.array(np.append(at, -1)), "n": pa.array(np.append(total[at], n))})

    df = dict(sample.mapInArrow(terms, "dim long, n long").groupBy("dim").agg(F.sum("n")).collect())  # DIMS + 1 rows at most
    idf = np.zeros(DIMS)
    for dim, n in df.items():
        if dim >= 0:
            idf[dim] = np.log((1 + df[-1]) / (1 + n)) + 0.1

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        """Spherical k-means over one language's bounded sample."""
        pdf = pdf.sort_values("text", kind="stable")
        x = np.stack([vector(t, idf) for t in pdf["text"]]).astype(np.float32)
        k = min(CENTROIDS, len(x))
        centers = x[np.linspace(0, len(x) - 1, k).astype(int)]
        for _ in range(12):
            near = (x @ centers.T).argmax(axis=1)
            centers = np.stack([x[near == j].mean(axis=0) if (near == j).any() else centers[j] for j in range(k)])
            centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
        best = (x @ centers.T).max(axis=1)
        floor = float(np.quantile(best, REJECT_SHARE))
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "center": [c.tobytes() for c in centers], "floor": floor})

    found = sample.groupBy("lang").applyInPandas(cluster, "lang string, center binary, floor double").orderBy("lang", "center").collect()
    centers = np.stack([np.frombuffer(r.center, dtype=np.float32) for r in found]) if found else np.zeros((0, DIMS), dtype=np.float32)
    return [r.lang for r in found], centers, np.array([r.floor for r in found]), idf


def predict(docs: DataFrame, model, *keep: str) -> DataFrame:
    """keep columns, lang_pred, score, lang_nearest, cosine, rejected of each row."""
    handle = docs.sparkSession.sparkContext.broadcast(model)
    fields = pick(docs, *keep).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "lang_pred string, score double, cosine double, rejected boolean"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, centers, floors, idf = handle.value
        langs = sorted(set(names))
        of = np.array([langs.index(n) for n in names], dtype=int)
        for batch in pieces(batches):
            pred, score, cosine, rejected = [], [], [], []
            for text in batch.column("text").to_pylist():
                if text is None or not LETTER.search(text) or not langs:
                    pred.append("und"), score.append(0.0), cosine.append(0.0), rejected.append(True)
                    continue
                sims = centers @ vector(text, idf).astype(np.float32)
                best = int(sims.argmax())
                each = np.array([sims[of == i].max() for i in range(len(langs))])
                odds = np.exp(SHARPNESS * (each - each.max()))
                pred.append(langs[of[best]])
                score.append(round(float(odds[of[best]] / odds.sum()), 6))
                cosine.append(round(float(sims[best]), 6))
                rejected.append(bool(sims[best] < floors[best]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(cosine, pa.float64()), pa.array(rejected, pa.bool_())], names=[*keep, "lang_pred", "score", "cosine", "rejected"])

    return pick(docs, *keep, "text").mapInArrow(answer, schema)


def op2_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = crc_mod_column(F.col("doc_id"), 5)
    model = fit(docs.where(fold != 0))
    return predict(docs, model, "doc_id").select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score", "cosine", "rejected")
