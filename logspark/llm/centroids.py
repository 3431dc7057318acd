"""Centroid clustering with heap-ordered bounds: exact rounds that rescan only vectors whose gap expired.

Vectors are packed into blocks of BLOCK vectors, a row of the saved table each. A block keeps one
heap a cluster; an entry is (key, place), the key being the gap between the distances to the second
nearest and to the nearest centroid plus the cluster's accumulated drift when the entry was made.
After a round a cluster's drift grows by its centroid's move and the largest move of the others, by
which a gap can shrink at most. The next round pops a heap while its least key is not above the
accumulated drift (with a margin for rounding), measures the popped vectors against all centroids
and pushes them into the heap of their cluster; all others are known to stay. Each block carries its
clusters' sums, which change only by moved vectors; the new centroids come from the sums of all
blocks. So a round reads the blocks, touches few vectors and shuffles only sums.

Components are integers and all arithmetic on them is exact: floats of 53 bits while they suffice,
64-bit integers beyond. A scaled component of 2^27 or more would overflow a distance: error.

Vectors of another size, null vectors and those with a null or non-finite component are left out.
Null ids: the empty text in the choice of the first centroids. Repeated rows are vectors of their
own. Ties between centroids: the smaller number; in the choice: the smaller vector. Fewer vectors
than clusters: each is a centroid. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import dropped, empty, saved

BLOCK, LARGEST, EXACT = 8_192, 1 << 27, float(1 << 53)
#: Margin of keys against rounding, as a share of the key and of the drift.
MARGIN = 1e-9
STATE = pa.schema([("ids", pa.list_(pa.int64())), ("width", pa.int32()), ("vectors", pa.binary()), ("clusters", pa.binary()), ("keys", pa.list_(pa.list_(pa.float64()))), ("places", pa.list_(pa.list_(pa.int32()))), ("sums", pa.list_(pa.int64())), ("rescanned", pa.int64())])
STATE_DDL = "ids array<long>, width int, vectors binary, clusters binary, keys array<array<double>>, places array<array<int>>, sums array<long>, rescanned long"


def kept(vectors: DataFrame, id_column: str, vector_column: str, size: int, scale: int) -> DataFrame:
    """(id, v): the scaled integer vectors of the given size."""
    whole = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    scaled = lambda x: F.floor(x.cast("double") * F.lit(float(scale)))
    rows = vectors.select(vectors[id_column].cast("long").alias("id"), vectors[vector_column].alias("x"))
    return rows.where((F.size("x") == size) & F.forall("x", whole)).select("id", F.transform("x", scaled).alias("v"))


def measured(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of vectors (rows) to centroids."""
    most = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))
    kind = np.float64 if 4.0 * x.shape[1] * float(most) ** 2 < EXACT else np.int64
    a, c = x.astype(kind), centroids.astype(kind)
    return ((a * a).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * (a @ c.T)).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, and the gap to the second nearest (infinite if there is none)."""
    d = measured(x, centroids)
    best = d.argmin(axis=1)
    first = np.sqrt(d[np.arange(len(d)), best].astype(np.float64))
    d[np.arange(len(d)), best] = np.iinfo(np.int64).max
    gap = np.sqrt(d.min(axis=1).astype(np.float64)) - first if len(centroids) > 1 else np.full(len(d), np.inf)
    return best, gap


def sums_of(x: np.ndarray, clusters: np.ndarray, k: int) -> np.ndarray:
    """Count and component sums of each cluster, a row each."""
    out = np.zeros((k, x.shape[1] + 1), dtype=np.int64)
    for c in np.unique(clusters):
        mine = x[clusters == c]
        out[c, 0], out[c, 1:] = len(mine), mine.sum(axis=0)
    return out


def packed(x: np.ndarray) -> tuple[int, bytes]:
    """Bytes a component and the vectors in the narrowest integers that hold them."""
    most = int(np.abs(x).max(initial=0))
    width = next(w for w in (1, 2, 4) if most < 1 << (8 * w - 1))
    return width, x.astype(f"<i{width}").tobytes()


def unpacked(block: dict, size: int) -> np.ndarray:
    return np.frombuffer(block["vectors"], dtype=f"<i{block['width']}").reshape(-1, size).astype(np.int64)


def _row(ids: list, width: int, vectors: bytes, clusters: np.ndarray, heaps: list[list], sums: np.ndarray, rescanned: int) -> pa.RecordBatch:
    row = {"ids": ids, "width": width, "vectors": vectors, "clusters": clusters.astype("<i4").tobytes(), "keys": [[key for key, _ in h] for h in heaps], "places": [[place for _, place in h] for h in heaps], "sums": sums.reshape(-1).tolist(), "rescanned": rescanned}
    return pa.RecordBatch.from_pylist([row], schema=STATE)


def _first(centroids: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors, each measured against all centroids, with their heaps."""
    k, size = centroids.shape
    ids: list = []
    parts: list[np.ndarray] = []

    def block() -> pa.RecordBatch:
        x = np.concatenate(parts)
        if np.abs(x).max(initial=0) >= LARGEST:
            raise ValueError(f"a scaled component is not below {LARGEST}: its distances would not fit a long")
        clusters, gap = nearest(x, centroids)
        heaps: list[list] = [[] for _ in range(k)]
        for place, (c, g) in enumerate(zip(clusters.tolist(), gap.tolist(), strict=True)):
            heaps[c].append((g, place))
        for heap in heaps:
            heapq.heapify(heap)
        return _row(ids, *packed(x), clusters, heaps, sums_of(x, clusters, k), len(x))

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            piece = batch.slice(at, BLOCK - len(ids))
            ids += piece.column("id").to_pylist()
            parts.append(piece.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size))
            at += piece.num_rows
            if len(ids) >= BLOCK:
                yield block()
                ids, parts = [], []
    yield block() if ids else empty(STATE)


def _next(centroids: np.ndarray, drift: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks after a round: expired entries are popped, measured against all centroids and pushed again."""
    k, size = centroids.shape
    for batch in batches:
        for block in batch.to_pylist():
            heaps = [list(zip(*h, strict=True)) for h in zip(block["keys"], block["places"], strict=True)]
            expired = []
            for c, heap in enumerate(heaps):
                while heap and heap[0][0] * (1 - MARGIN) <= drift[c] * (1 + MARGIN) + MARGIN:
                    expired.append(heapq.heappop(heap)[1])
            clusters = np.frombuffer(block["clusters"], dtype="<i4").copy()
            sums = np.array(block["sums"], dtype=np.int64).reshape(k, size + 1)
            if expired:
                x = unpacked(block, size)[expired]
                now, gap = nearest(x, centroids)
                for c, g, place in zip(now.tolist(), gap.tolist(), expired, strict=True):
                    heapq.heappush(heaps[c], (g + drift[c], place))
                moved = now != clusters[expired]
                sums += sums_of(x[moved], now[moved], k) - sums_of(x[moved], clusters[expired][moved], k)
                clusters[expired] = now
            yield _row(block["ids"], block["width"], block["vectors"], clusters, heaps, sums, len(expired))
    yield empty(STATE)


def _distances(centroids: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = centroids.shape[1]
    for batch in batches:
        for block in batch.to_pylist():
            clusters = np.frombuffer(block["clusters"], dtype="<i4")
            d = ((unpacked(block, size) - centroids[clusters]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(block["ids"], pa.int64()), pa.array(clusters, pa.int32()), pa.array(d, pa.int64())], names=["id", "cluster", "distance"])


def totals(state: DataFrame, k: int, size: int) -> np.ndarray:
    """Count and component sums of each cluster over all blocks, as exact Python integers."""
    rows = state.select(F.posexplode("sums").alias("at", "n")).groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
    out = np.zeros(k * (size + 1), dtype=object)
    for r in rows:
        out[r["at"]] = int(r["n"])
    return out.reshape(k, size + 1)


def cluster(vectors: DataFrame, id_column: str, vector_column: str, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(id, cluster, distance) of every vector that is kept, the final centroids, and how many vectors each pass measured in full.

    The first centroids are the k vectors with the smallest SHA-256 of `seed:id`; k * size numbers are on the driver.
    """
    spark = vectors.sparkSession
    rows = kept(vectors, id_column, vector_column, size, scale)
    start = rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), "v").limit(k).collect()
    if not start:
        return spark.createDataFrame([], "id long, cluster int, distance long"), np.zeros((0, size), dtype=np.int64), []
    centroids = np.array([r["v"] for r in start], dtype=np.int64)
    k = len(centroids)
    state = saved(rows.mapInArrow(functools.partial(_first, centroids), STATE_DDL), "clusters", rows=BLOCK)
    drift, measured_rows = np.zeros(k), [state.agg(F.sum("rescanned")).first()[0]]
    for _ in range(rounds):
        sums = totals(state, k, size)
        after = np.array([[int(x) // int(row[0]) for x in row[1:]] if row[0] else before.tolist() for row, before in zip(sums, centroids, strict=True)], dtype=np.int64)
        moves = np.sqrt(((after - centroids).astype(np.float64) ** 2).sum(axis=1))
        others = np.array([np.delete(moves, c).max(initial=0.0) for c in range(k)])
        centroids, drift = after, drift + moves + others
        before, state = state, saved(state.mapInArrow(functools.partial(_next, centroids, drift), STATE_DDL), "clusters", rows=8)
        dropped(before)
        measured_rows.append(state.agg(F.sum("rescanned")).first()[0])
    out = saved(state.mapInArrow(functools.partial(_distances, centroids), "id long, cluster int, distance long"), "clustered", rows=8)
    dropped(state)
    return out, centroids, measured_rows


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    out, centroids, _ = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(exact.alias("s")).collect()}
    rows = [(c, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    report = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.withColumnRenamed("id", "vec_id").join(F.broadcast(report), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
