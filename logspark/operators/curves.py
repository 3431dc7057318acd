"""ROC, precision-recall and risk-coverage curves, a point for each row; areas under them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.operators.metrics import ranked


def roc(predictions: DataFrame) -> DataFrame:
    """(fold, rank, threshold, fpr, tpr); none for a fold with one class."""
    r = ranked(predictions).where((F.col("p") > 0) & (F.col("n") > 0))
    return r.select("fold", "rank", F.col("p_anomaly").alias("threshold"), (F.col("fp") / F.col("n")).alias("fpr"), (F.col("tp") / F.col("p")).alias("tpr"))


def pr(predictions: DataFrame) -> DataFrame:
    """(fold, rank, threshold, recall, precision); none for a fold without positives."""
    r = ranked(predictions).where(F.col("p") > 0)
    return r.select("fold", "rank", F.col("p_anomaly").alias("threshold"), (F.col("tp") / F.col("p")).alias("recall"), (F.col("tp") / F.col("rank")).alias("precision"))


def areas(predictions: DataFrame) -> DataFrame:
    """(fold, roc_area, pr_area): trapezoids over ROC points from the origin, steps over PR points.

    A step adds to the ROC area only where a negative row comes, (tp so far) / (p * n); so sums do.
    """
    r = ranked(predictions)
    roc_step = F.when((F.col("pos") == 0) & (F.col("p") > 0), F.col("tp") / (F.col("p").cast("double") * F.col("n")))
    pr_step = F.when(F.col("pos") == 1, F.col("tp") / F.col("rank") / F.col("p"))
    both = (F.max("p") > 0) & (F.max("n") > 0)
    return r.groupBy("fold").agg(F.when(both, F.coalesce(F.sum(roc_step), F.lit(0.0))).alias("roc_area"), F.when(F.max("p") > 0, F.sum(pr_step)).alias("pr_area"))
