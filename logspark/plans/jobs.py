"""Whole jobs: prepare logs, evaluate with systems held out, calibrate, compare experiments, score.

Each job reads tables or paths, composes operators and writes tables under an output folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions.mask import mask
from logspark.operators import bootstrap, calibration, curves, leakage, metrics, ood, requests, selective, sequence, splits, stats
from logspark.sources import logs

Trainer = Callable[[DataFrame, DataFrame], DataFrame]


def prepare_sessions(spark: SparkSession, path: str, labels: str | None, system: str, kind: str, out: str, limit: int | None = None) -> None:
    """Session logs to masked, labelled and split sequences, partitioned by split."""
    raw = logs.parse_sessions(logs.read_lines(spark, path, system), kind)
    lines = raw.select(F.col("system").alias("source"), "group_id", "line_no", mask(F.col("text")).alias("text"))
    seqs = sequence.sessions(lines, logs.read_labels(spark, labels, trim=kind == "instance"), limit)
    splits.with_split(seqs).write.partitionBy("split").parquet(f"{out}/sequences")
    back = spark.read.parquet(f"{out}/sequences")
    logs.write_report(splits.split_stats(back), f"{out}/split_stats")


def prepare_windows(spark: SparkSession, path: str, system: str, out: str, window: int = 100, stride: int = 20) -> None:
    """Label-prefixed logs to masked, labelled and split windows of lines."""
    parsed = logs.parse_prefixed(logs.read_lines(spark, path, system))
    lines = parsed.select(F.col("system").alias("source"), "line_no", "label", mask(F.col("text")).alias("text"))
    seqs = sequence.window_lines(lines, window, stride)
    splits.with_split(seqs).write.partitionBy("split").parquet(f"{out}/sequences")
    logs.write_report(splits.split_stats(spark.read.parquet(f"{out}/sequences")), f"{out}/split_stats")


def exploded(sequences: DataFrame) -> DataFrame:
    return sequences.select("source", "group_id", F.explode("lines").alias("text"))


def held_out(spark: SparkSession, sequences: DataFrame, trainer: Trainer, out: str, strict: bool = True, n_bootstrap: int = 1000) -> None:
    """Leave-one-system-out: leakage gate, predictions of trainer(train, test), metrics, curves, intervals, distances.

    trainer returns (group_id, y_true, y_pred, p_anomaly), a row for each test sequence; target
    labels are hidden from it (0) and joined back afterwards.
    """
    lines = exploded(sequences)
    report = leakage.audit(lines, sequences.select("source", "group_id"))
    logs.write_report(report, f"{out}/leakage")
    leakage.gate(report, strict)
    for fold in [r.source for r in sequences.select("source").distinct().orderBy("source").collect()]:  # a row a system
        train, test = sequences.where(F.col("source") != fold), sequences.where(F.col("source") == fold)
        got = trainer(train, splits.strip_labels(test, F.lit(True))).select("group_id", "y_pred", "p_anomaly")
        rows = test.select("group_id", F.col("label").alias("y_true")).join(got, "group_id").withColumn("fold", F.lit(fold))
        logs.write_predictions(rows, f"{out}/predictions", "append")
        # The filter is on the folder's partitions: only this fold's files are read back.
        if spark.read.schema(f"{logs.PREDICTION}, fold string").json(f"{out}/predictions").where(F.col("fold") == fold).count() != test.count():
            raise ValueError(f"the trainer gave another number of rows for {fold}")
    every = spark.read.schema(f"{logs.PREDICTION}, fold string").json(f"{out}/predictions").withColumn("row_id", F.col("group_id"))
    panel = metrics.panel(every)
    logs.write_report(panel, f"{out}/metrics")
    logs.write_report(metrics.macro(panel), f"{out}/summary")
    logs.write_csv(curves.roc(every).select("fold", "threshold", "fpr", "tpr"), f"{out}/roc")
    logs.write_csv(curves.pr(every).select("fold", "threshold", "recall", "precision"), f"{out}/pr")
    logs.write_csv(metrics.confusion_shares(every), f"{out}/confusion")
    per = bootstrap.intervals(every, n_bootstrap)
    logs.write_report(per, f"{out}/bootstrap")
    logs.write_report(bootstrap.macro_intervals(per), f"{out}/macro_bootstrap")
    logs.write_report(ood.distances(lines), f"{out}/distances")


def calibrate(spark: SparkSession, predictions: str, out: str, budget: float = 0.05) -> dict:
    """Calibration report, reliability bins, risk-coverage and threshold of one fold's held-out predictions, calibrated."""
    rows = logs.read_predictions(spark, predictions).withColumns({"fold": F.lit("all"), "row_id": F.col("group_id")})
    got = calibration.calibrate(rows, budget=budget)
    p1 = calibration.parts(rows).where("part = 'held_out'").withColumn("p1", calibration.probability(got))
    logs.write_csv(calibration.bins(p1), f"{out}/reliability")
    logs.write_report(selective.aurc(p1), f"{out}/aurc")
    logs.write_report(selective.tau_for_budget(p1, budget), f"{out}/tau")
    return got


def ablation(cells: DataFrame, baseline: str, out: str) -> DataFrame:
    """Tests of every condition against the baseline: signed rank, Holm within axis and metric, Cliff's delta."""
    logs.write_csv(stats.matrix(stats.cell_summary(cells), baseline), f"{out}/matrix")
    tested = stats.holm(stats.tests(cells, baseline), ["axis", "metric"], ["condition"])
    joined = stats.joint(tested.join(stats.cliffs_delta(cells, baseline), stats.CELL))
    logs.write_csv(joined, f"{out}/tests")
    return joined


def score(spark: SparkSession, path: str, out: str, tau: float) -> None:
    """JSON requests (request_id, id, lines) in, scored decisions out; beside them rejected sequences and lines, and how many of each."""
    rows = logs.read_requests(spark, path, rejects=f"{out}/rejected_lines")
    requests.score_job(rows, tau).write.json(f"{out}/scored")
    requests.validate(rows).where("reason is not null").write.json(f"{out}/rejected")
    found = {name: spark.read.text(f"{out}/{name}").count() for name in ("scored", "rejected", "rejected_lines")}
    logs.write_report(spark.createDataFrame(list(found.items()), "what string, n long"), f"{out}/counts")
