"""Metrics of predictions (fold, row_id, y_true, y_pred, p_anomaly), all folds at once.

Undefined values are null: ranking metrics of a fold with one class. Ties in a ranking go by
row_id. Rows with null y_true are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.functions.columns import ratio
from logspark.operators.ranking import running

PANEL = ("precision", "recall", "f1", "fpr", "mcc", "auc_roc", "auc_pr", "fpr_at_95_recall")


def known(predictions: DataFrame) -> DataFrame:
    return predictions.where(F.col("y_true").isNotNull())


def confusion(predictions: DataFrame) -> DataFrame:
    """(fold, tp, fp, tn, fn)"""
    t, p = F.col("y_true") == 1, F.col("y_pred") == 1
    return known(predictions).groupBy("fold").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"))


def thresholded(counts: DataFrame, by: tuple[str, ...] = ("fold",)) -> DataFrame:
    """(by, precision, recall, f1, fpr, mcc) from confusion counts; 0 where a denominator is 0."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    product = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    mcc = F.when(product == 0, 0.0).otherwise((tp * tn - fp * fn) / F.sqrt(product))
    return counts.select(*by, precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"), ratio(fp, fp + tn).alias("fpr"), mcc.alias("mcc"))


def confusion_shares(predictions: DataFrame) -> DataFrame:
    """(fold, y_true, share_0, share_1): rows of the confusion matrix as shares, 0 for a class without rows."""
    c = confusion(predictions)
    rows = c.select("fold", F.explode(F.array(F.struct(F.lit(0).alias("y_true"), F.col("tn").alias("n0"), F.col("fp").alias("n1")), F.struct(F.lit(1).alias("y_true"), F.col("fn").alias("n0"), F.col("tp").alias("n1")))).alias("r")).select("fold", "r.*")
    total = F.col("n0") + F.col("n1")
    return rows.select("fold", "y_true", ratio(F.col("n0"), total).alias("share_0"), ratio(F.col("n1"), total).alias("share_1"))


def by_score(predictions: DataFrame) -> DataFrame:
    """(fold, p_anomaly, pos, neg): rows collapsed to distinct scores."""
    return known(predictions).groupBy("fold", "p_anomaly").agg(F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") == 0).alias("neg"))


def auc_roc(predictions: DataFrame) -> DataFrame:
    """(fold, auc_roc) by ranks, half for ties."""
    run = running(by_score(predictions), ["fold"], "p_anomaly", {"below": "neg"}, descending=False)
    part = F.col("pos") * (F.col("below") - F.col("neg") + F.col("neg") / 2)
    out = run.groupBy("fold").agg(F.sum(part).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return out.select("fold", F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p").cast("double") * F.col("n"))).alias("auc_roc"))


def ranked(predictions: DataFrame, *more: str) -> DataFrame:
    """known rows with pos, rank, tp, fp (running) in order of falling score, then row_id, and totals p, n; more: columns to keep."""
    rows = known(predictions).select("fold", "row_id", "p_anomaly", *more, (F.col("y_true") == 1).cast("long").alias("pos"), F.lit(1).cast("long").alias("one"))
    run = running(rows, ["fold"], "p_anomaly", {"rank": "one", "tp": "pos"}, tie="row_id")
    totals = rows.groupBy(F.col("fold").alias("_fold")).agg(F.sum("pos").alias("p"), (F.count("*") - F.sum("pos")).alias("n"))
    met = run.join(F.broadcast(totals), F.col("fold").eqNullSafe(F.col("_fold")))  # a row a fold
    return met.withColumn("fp", F.col("rank") - F.col("tp")).drop("one", "_fold")


def auc_pr(predictions: DataFrame) -> DataFrame:
    """(fold, auc_pr): average precision over rows."""
    step = F.when(F.col("pos") == 1, F.col("tp") / F.col("rank") / F.col("p"))
    return ranked(predictions).groupBy("fold").agg(F.when(F.max("p") > 0, F.sum(step)).alias("auc_pr"))


def fpr_at_recall(predictions: DataFrame, recall: float = 0.95) -> DataFrame:
    """(fold, fpr_at_recall) at the first rank whose recall reaches the target."""
    if not 0 < recall <= 1:
        raise ValueError("recall lies in (0, 1]")
    both = (F.col("p") > 0) & (F.col("n") > 0)
    # fp never falls along the ranks
    first = F.min(F.when(both, F.when(F.col("tp") / F.col("p") >= recall, F.col("fp"))))
    return ranked(predictions).groupBy("fold").agg(F.when((F.max("p") > 0) & (F.max("n") > 0), first / F.max("n")).alias("fpr_at_recall"))


def panel(predictions: DataFrame) -> DataFrame:
    """(fold, *PANEL) in one table, from one ranked pass: rows to distinct scores, scores to folds. A null fold is a fold."""
    t, y = F.col("pos") == 1, F.col("y_pred") == 1
    cells = {"tp": t & y, "fp": ~t & y, "tn": ~t & ~y, "fn": t & ~y}
    reached = F.when(F.col("p") > 0, F.col("tp") / F.col("p") >= 0.95)
    by = ranked(predictions, "y_pred").groupBy("fold", "p_anomaly").agg(
        *[F.count_if(c).alias(f"c_{k}") for k, c in cells.items()],
        F.sum("pos").alias("here"),
        F.sum(1 - F.col("pos")).alias("others"),
        F.max("fp").alias("upto"),
        F.max("p").alias("p"),
        F.max("n").alias("n"),
        F.sum(F.when(t, F.col("tp") / F.col("rank"))).alias("steps"),
        # fp never falls along the ranks
        F.min(F.when(reached, F.col("fp"))).alias("first"),
    )
    u = F.sum(F.col("here") * (F.col("n") - F.col("upto") + F.col("others") / 2))
    folds = by.groupBy("fold").agg(*[F.sum(f"c_{k}").alias(k) for k in cells], u.alias("u"), F.max("p").alias("p"), F.max("n").alias("n"), F.sum("steps").alias("steps"), F.min("first").alias("first"))
    both = (F.col("p") > 0) & (F.col("n") > 0)
    ranks = {
        "auc_roc": F.when(both, F.col("u") / (F.col("p").cast("double") * F.col("n"))),
        "auc_pr": F.when(F.col("p") > 0, F.col("steps") / F.col("p")),
        "fpr_at_95_recall": F.when(both, F.col("first") / F.col("n")),
    }
    return thresholded(folds.withColumns(ranks), ("fold", *ranks)).select("fold", *PANEL)


def summary(long: DataFrame, by: list[str]) -> DataFrame:
    """(by, mean, std, min, max, n) of value without nulls; std 0 for one value; null mean and n 0 for none."""
    v = F.when(~F.isnan("value"), F.col("value"))
    out = long.withColumn("v", v).groupBy(*by).agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), F.count("v").alias("n"))
    return out.withColumn("std", F.when(F.col("n") <= 1, 0.0).otherwise(F.col("std")))


def unpivot(table: DataFrame, ids: list[str], metrics) -> DataFrame:
    """(ids, metric, value)"""
    return table.unpivot(ids, [m for m in metrics], "metric", "value")


def macro(table: DataFrame, metrics=PANEL) -> DataFrame:
    return summary(unpivot(table, ["fold"], metrics), ["metric"])


def headline(mean, std):
    """`mean ± std` in percent with two decimals."""
    return F.format_string("%.2f ± %.2f", 100 * mean, 100 * std)
