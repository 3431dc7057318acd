"""The tree draw of the bootstrap against flat draws, and its cost."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logspark.operators import bootstrap, metrics

SCHEMA = "fold string, row_id long, y_true int, y_pred int, p_anomaly double"


def predictions(spark, n, seed, fold="f"):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.3).astype(int)
    s = np.round(np.clip(0.5 + 0.2 * (2 * y - 1) * rng.random(n) + rng.normal(0, 0.2, n), 0, 1), 3)
    return spark.createDataFrame([(fold, i, int(a), int(b >= 0.5), float(b)) for i, (a, b) in enumerate(zip(y, s, strict=True))], SCHEMA)


def drawn(spark, df, chunks, size=200):
    """(replicates, scores) counts of positives and negatives drawn over all blocks, in falling order of score."""
    rows = sorted(bootstrap.blocks(df).collect(), key=lambda r: r.block)
    out = [[], []]
    for k in range(chunks):
        ahead = [np.zeros(size, dtype=np.int64)] * 2
        parts = [[], []]
        for r in rows:
            cells = [np.array([s[c] for s in r.scores], dtype=np.int64) for c in ("a", "c", "b", "d")]
            made, before = bootstrap.drawn(r.fold, r.block, cells, r.path, k, size, 7)
            for i in range(2):
                assert (before[i] == ahead[i]).all()  # every block knows what the others drew
                both = made[2 * i] + made[2 * i + 1]
                ahead[i] = ahead[i] + both.sum(axis=1)
                parts[i].append(both)
        for i in range(2):
            out[i].append(np.concatenate(parts[i], axis=1))
            assert len(set(out[i][-1].sum(axis=1))) == 1
    return [np.concatenate(o) for o in out]


@pytest.mark.parametrize("block", [7, 10_000])
def test_tree_draw_is_a_flat_draw(spark, monkeypatch, block):
    monkeypatch.setattr(bootstrap, "BLOCK", block)
    df = predictions(spark, 120, 3)
    have = df.groupBy("p_anomaly").agg(F.count_if(F.col("y_true") == 1).alias("p"), F.count_if(F.col("y_true") == 0).alias("n")).orderBy(F.desc("p_anomaly")).collect()
    for got, name in zip(drawn(spark, df, 40), ("p", "n"), strict=True):
        counts = np.array([r[name] for r in have], dtype=float)
        total, share = counts.sum(), counts / counts.sum()
        assert (got.sum(axis=1) == total).all()
        error = np.sqrt(total * share * (1 - share) / len(got))
        assert (np.abs(got.mean(axis=0) - counts) <= 5 * error + 1e-12).all()
        want = total * (np.diag(share) - np.outer(share, share))
        assert np.abs(np.cov(got.T) - want).max() < 0.12


def test_blocks_do_not_change_the_intervals_much(spark, monkeypatch):
    df = predictions(spark, 900, 4)
    one = {r.metric: r for r in bootstrap.intervals(df, n=600).collect()}
    monkeypatch.setattr(bootstrap, "BLOCK", 25)
    many = {r.metric: r for r in bootstrap.intervals(df, n=600).collect()}
    for m in metrics.PANEL:
        assert one[m].point == many[m].point and many[m].n_bootstrap == 600
        assert abs(one[m].low - many[m].low) < 0.04 and abs(one[m].high - many[m].high) < 0.04


def test_cost_of_a_block_grows_with_the_logarithm(spark, monkeypatch):
    df = spark.range(6_400).select(F.lit("f").alias("fold"), F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("y_true"), F.lit(1).alias("y_pred"), (F.col("id") / 6_400).alias("p_anomaly"))
    monkeypatch.setattr(bootstrap, "BLOCK", 50)
    rows = bootstrap.blocks(df).select("block", F.size("path").alias("path"), F.size("scores").alias("scores")).collect()
    assert len(rows) == 128 and {r.path for r in rows} == {7} and {r.scores for r in rows} == {50}


def test_null_fold_and_null_truth(spark):
    df = predictions(spark, 200, 5).unionByName(predictions(spark, 150, 6, fold=None)).unionByName(spark.createDataFrame([("g", 1, None, 1, 0.5)], SCHEMA))
    got = bootstrap.intervals(df, n=100).collect()
    panel = {r.fold: r for r in metrics.panel(df).collect()}
    assert {r.fold for r in got} == {"f", None} == set(panel)
    for r in got:
        assert abs(r.point - panel[r.fold][r.metric]) < 1e-12 and r.low <= r.point <= r.high and r.n_bootstrap == 100
    for part in (metrics.auc_roc(df), metrics.auc_pr(df), metrics.fpr_at_recall(df)):
        name = part.columns[1]
        for r in part.collect():
            assert abs(r[1] - panel[r.fold]["fpr_at_95_recall" if name == "fpr_at_recall" else name]) < 1e-12


def test_empty(spark):
    assert bootstrap.intervals(spark.createDataFrame([], SCHEMA), n=100).count() == 0
