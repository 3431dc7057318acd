"""Heap-bounded clustering against plain rounds over all vectors."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from logspark.llm import centroids


def plain(rows, k, rounds, size, scale=64):
    """(id, cluster, distance) by rounds that measure every vector, in Python integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    middle = [v for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(middle))
    for _ in range(rounds):
        groups = [[] for _ in middle]
        for _, v in kept:
            groups[near(v)[1]].append(v)
        middle = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else m for g, m in zip(groups, middle, strict=True)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=str), middle


def drawn(n, size, seed, spread=0.15):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 0.3, (6, size))
    return [(i, [float(x) for x in np.float32(middles[i % 6] + rng.normal(0, spread, size))]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "cluster": F.lit("x"), "v": F.lit(2), "distance": F.lit(0)})


@pytest.mark.parametrize("k, block", [(4, 50), (16, 8_192), (1, 20)])
def test_rounds_brute_force(spark, monkeypatch, k, block):
    monkeypatch.setattr(centroids, "BLOCK", block)
    rows = drawn(300, 8, k)
    rows += rows[:20] + [(None, [0.5] * 8), (None, [0.25] * 8), (900, None), (901, []), (902, [1.0] * 7), (903, [None, *[1.0] * 7]), (904, [float("nan"), *[1.0] * 7]), (905, [float("inf")] * 8), (906, [-0.001] * 8)]
    out, middle, _ = centroids.cluster(frame(spark, rows), "vec_id", "embedding", k=k, size=8)
    want, middles = plain(rows, k, 3, 8)
    assert sorted(((r.id, r.cluster, r.distance) for r in out.collect()), key=str) == want
    assert middle.tolist() == middles


def test_later_rounds_measure_few_vectors(spark):
    rows = drawn(4_000, 16, 3, spread=0.05)
    out, _, measured = centroids.cluster(frame(spark, rows), "vec_id", "embedding", k=6, rounds=6, size=16)
    assert sorted(((r.id, r.cluster, r.distance) for r in out.collect()), key=str) == plain(rows, 6, 6, 16)[0]
    assert measured[0] == 4_000 and measured[-1] < 400


def test_large_components_stay_exact(spark):
    rows = [(i, [x * 1_000_003.0 for x in v]) for i, v in drawn(60, 8, 5)]
    out, _, _ = centroids.cluster(frame(spark, rows), "vec_id", "embedding", k=3, size=8)
    assert sorted(((r.id, r.cluster, r.distance) for r in out.collect()), key=str) == plain(rows, 3, 3, 8)[0]


def test_equal_vectors_tie_to_the_smaller_number(spark):
    rows = [(i, [0.5] * 4) for i in range(30)]
    out, _, _ = centroids.cluster(frame(spark, rows), "vec_id", "embedding", k=4, size=4)
    assert {(r.cluster, r.distance) for r in out.collect()} == {(0, 0)}


def test_no_vectors(spark):
    for rows in ([], [(1, None)]):
        out, middle, measured = centroids.cluster(frame(spark, rows), "vec_id", "embedding", size=8)
        assert out.count() == 0 and len(middle) == 0 and measured == []
