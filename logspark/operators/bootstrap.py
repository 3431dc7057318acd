"""Bootstrap intervals of the metric panel, stratified by class.

A fold's sample is compressed to counts of its distinct scores, by class and prediction, and cut
into blocks of BLOCK scores in falling order. A replicate is a multinomial draw for each class, made
in halves: over the blocks stands a binary tree of counts, a node deals its draws to its left half by
a binomial whose seed is the node's, and a block draws only the nodes on its own path, then its
scores. So a block knows its draws and those before it from the logarithm of the number of blocks,
and all blocks agree without meeting. Blocks and replicates are spread over tasks; a fold of any size
has no task of its own. Points are the panel's; in draws, ties are one threshold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.operators.metrics import PANEL, known, panel, thresholded, unpivot
from logspark.operators.ranking import running
from logspark.operators.tables import saved

#: Distinct scores of a block; share of positives that FPR at recall asks for.
BLOCK, RECALL = 20_000, 0.95
SUMS = ("tp", "fn", "fp", "tn", "u", "ap", "at_recall")


def sums(a: np.ndarray, c: np.ndarray, b: np.ndarray, d: np.ndarray, before: tuple[np.ndarray, np.ndarray], total: tuple[int, int]) -> dict[str, np.ndarray]:
    """SUMS of a block, a row a replicate: positives predicted 1 (a) and 0 (c), negatives (b, d) of each score.

    before: positives and negatives that each replicate drew of larger scores; total: of the fold.
    """
    pos, neg = a + c, b + d
    tp, fp = before[0][:, None] + pos.cumsum(axis=1), before[1][:, None] + neg.cumsum(axis=1)
    u = (pos * (total[1] - fp + neg / 2)).sum(axis=1)
    ap = (pos / max(total[0], 1) * tp / np.maximum(tp + fp, 1)).sum(axis=1)
    need = RECALL * total[0]
    reached = (before[0] < need) & (need <= tp[:, -1])
    first = fp[np.arange(len(fp)), (tp >= need).argmax(axis=1)] / max(total[1], 1)
    return {"tp": a.sum(axis=1), "fn": c.sum(axis=1), "fp": b.sum(axis=1), "tn": d.sum(axis=1), "u": u, "ap": ap, "at_recall": np.where(reached, first, np.nan)}


def blocks(predictions: DataFrame) -> DataFrame:
    """(fold, block, scores, p, n, path): a block's scores in falling order, its fold's totals, its tree nodes from the root down.

    A node has its level (it holds 2^level blocks), the positives and negatives in it, and those of its left half.
    """
    y, p = F.col("y_true") == 1, F.col("y_pred") == 1
    cells = [F.count_if(y & p).alias("a"), F.count_if(y & ~p).alias("c"), F.count_if(~y & p).alias("b"), F.count_if(~y & ~p).alias("d")]
    small = known(predictions).groupBy("fold", F.col("p_anomaly").alias("score")).agg(*cells).withColumn("one", F.lit(1).cast("long"))
    placed = running(saved(small, "bootstrap-scores"), ["fold"], "score", {"place": "one"}).withColumn("block", F.floor((F.col("place") - 1) / BLOCK))
    scores = F.array_sort(F.collect_list(F.struct("place", "a", "c", "b", "d"))).alias("scores")
    own = saved(placed.groupBy("fold", "block").agg(scores, F.sum(F.col("a") + F.col("c")).alias("p"), F.sum(F.col("b") + F.col("d")).alias("n")), "bootstrap-blocks")
    last = own.agg(F.max("block")).first()[0] or 0
    light = own.select("fold", "block", "p", "n")
    # One level more than the path needs: the root's node holds the fold's totals.
    top = max(1, int(last).bit_length())
    levels = light.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(top)))).withColumn("node", F.expr("shiftright(block, level)"))
    left = F.expr("shiftright(block, level - 1) % 2 = 0")
    nodes = levels.groupBy("fold", "level", "node").agg(*[F.sum(c).alias(k) for k, c in (("np", F.col("p")), ("nn", F.col("n")), ("lp", F.when(left, F.col("p")).otherwise(0)), ("ln", F.when(left, F.col("n")).otherwise(0)))])
    paths = levels.select("fold", "block", "level", "node").join(nodes, ["fold", "level", "node"]).groupBy("fold", "block").agg(F.sort_array(F.collect_list(F.struct("level", "np", "nn", "lp", "ln")), asc=False).alias("path"))
    return own.select("fold", "block", "scores").join(paths, ["fold", "block"])


def drawn(fold: str, block: int, cells: list[np.ndarray], path: list, k: int, size: int, seed: int) -> tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The block's cells in replicates k * size + (0 .. size - 1), a row each, and what they drew before it."""
    name, out, before = list(fold.encode()), [], []
    for i, (whole, half) in enumerate((("np", "lp"), ("nn", "ln"))):
        have, ahead = np.full(size, path[0][whole], dtype=np.int64), np.zeros(size, dtype=np.int64)
        for node in path:
            level = node["level"]
            rng = np.random.default_rng([seed, k, i, level, block >> level, *name])
            to_left = rng.binomial(have, node[half] / node[whole] if node[whole] else 0.0)
            if block >> (level - 1) & 1:
                ahead, have = ahead + to_left, have - to_left
            else:
                have = to_left
        both = np.concatenate(cells[2 * i : 2 * i + 2])
        rng = np.random.default_rng([seed, k, i, 0, block, *name])
        made = rng.multinomial(have, both / both.sum()) if both.sum() else np.zeros((size, len(both)), dtype=np.int64)
        out += [made[:, : len(both) // 2], made[:, len(both) // 2 :]]
        before.append(ahead)
    return out, (before[0], before[1])


def intervals(predictions: DataFrame, n: int = 1000, alpha: float = 0.05, seed: int = 42, chunk: int = 50) -> DataFrame:
    """(fold, metric, point, low, high, n_bootstrap); a fold with one class has its point as interval and n 0. A null fold is a fold."""
    if n < 100 or not 0 < alpha < 0.5:
        raise ValueError("n is at least 100 and alpha in (0, 0.5)")
    # Inside, a fold's name has a sign in front, and the null fold has no name.
    predictions = saved(predictions.select(F.coalesce(F.concat(F.lit("="), F.col("fold").cast("string")), F.lit("")).alias("fold"), "row_id", "y_true", "y_pred", "p_anomaly"), "bootstrap-rows")
    parts = blocks(predictions).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit((n + chunk - 1) // chunk - 1)))).repartition("fold", "block", "chunk")

    def draw(frames):
        for pdf in frames:
            out = []
            for fold, block, scores, path, c in zip(pdf["fold"], pdf["block"], pdf["scores"], pdf["path"], pdf["chunk"], strict=True):
                cells = [np.array([r[k] for r in scores], dtype=np.int64) for k in ("a", "c", "b", "d")]
                total = (path[0]["np"], path[0]["nn"])
                if all(total):
                    size = min(n, (c + 1) * chunk) - c * chunk
                    made, before = drawn(fold, block, cells, path, c, size, seed)
                    out.append(pd.DataFrame({"fold": fold, "replicate": np.arange(c * chunk, c * chunk + size), "p": total[0], "n": total[1], **sums(*made, before, total)}))
            yield pd.concat(out) if out else pd.DataFrame(columns=["fold", "replicate", "p", "n", *SUMS])

    kinds = "fold string, replicate long, p long, n long, tp long, fn long, fp long, tn long, u double, ap double, at_recall double"
    whole = parts.mapInPandas(draw, kinds).groupBy("fold", "replicate", "p", "n").agg(*[F.sum(k).alias(k) for k in SUMS[:-1]], F.max(F.nanvl("at_recall", F.lit(None))).alias("at_recall"))
    both = (F.col("p") > 0) & (F.col("n") > 0)
    ranks = {
        "auc_roc": F.when(both, F.col("u") / (F.col("p").cast("double") * F.col("n"))),
        "auc_pr": F.when(F.col("p") > 0, F.col("ap")),
        "fpr_at_95_recall": F.when(both, F.col("at_recall")),
    }
    wide = thresholded(whole.withColumns(ranks), ("fold", "replicate", *ranks))
    draws = wide.unpivot(["fold", "replicate"], list(PANEL), "metric", "value")
    ends = [F.percentile("value", F.lit(q)).alias(k) for k, q in (("low", alpha / 2), ("high", 1 - alpha / 2))]
    spread = draws.groupBy("fold", "metric").agg(*ends, F.count("value").alias("n_bootstrap"))
    out = unpivot(panel(predictions), ["fold"], PANEL).withColumnRenamed("value", "point").join(spread, ["fold", "metric"], "left")
    name = F.when(F.col("fold") != "", F.substring("fold", 2, 1_000_000)).alias("fold")
    return out.select(name, "metric", "point", F.coalesce("low", "point").alias("low"), F.coalesce("high", "point").alias("high"), F.coalesce("n_bootstrap", F.lit(0)).alias("n_bootstrap"))


def macro_intervals(per_fold: DataFrame) -> DataFrame:
    """(metric, point, low, high, n_folds): means over folds."""
    ok = per_fold.where(F.col("point").isNotNull() & ~F.isnan("point"))
    return ok.groupBy("metric").agg(F.avg("point").alias("point"), F.avg("low").alias("low"), F.avg("high").alias("high"), F.count("*").alias("n_folds"))


def formatted(point, low, high, percent: bool = True):
    """`87.45 [83.20, 91.10]`, or with four decimals if not percent."""
    k = 100 if percent else 1
    shape = "%.2f [%.2f, %.2f]" if percent else "%.4f [%.4f, %.4f]"
    return F.format_string(shape, k * point, k * low, k * high)
