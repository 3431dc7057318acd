"""Leakage between systems: lines and groups that training and test share, for all folds in one pass.

Lines are compared by the first 16 bytes of their SHA-256. Null lines are skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 16


def line_sets(lines: DataFrame) -> DataFrame:
    """(hash, sources, text): the systems in which each distinct line occurs; lines: (source, text)."""
    per = lines.where(F.col("text").isNotNull()).groupBy("source", F.substring(F.sha2("text", 256), 1, 32).alias("hash")).agg(F.min("text").alias("text"))
    return per.groupBy("hash").agg(F.collect_set("source").alias("sources"), F.min("text").alias("text"))


def audit(lines: DataFrame, groups: DataFrame) -> DataFrame:
    """A row for each system held out: line counts, distinct lines, shared lines and groups, clean."""
    counts = lines.groupBy("source").agg(F.count("text").alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    sets = line_sets(lines)
    # Sums over systems instead of rows for each fold: a line counts for the folds of its systems and, once, for all others.
    own = sets.select(F.explode("sources").alias("target"), (F.size("sources") > 1).cast("long").alias("shared"), (F.size("sources") == 1).cast("long").alias("alone"))
    per = own.groupBy("target").agg(F.count("*").alias("test_unique"), F.sum("shared").alias("shared_lines"), F.sum("alone").alias("alone"))
    distinct = sets.agg(F.count("*").alias("distinct"))
    ids = groups.groupBy("group_id").agg(F.collect_set("source").alias("s")).where(F.size("s") > 1).select(F.explode("s").alias("target")).groupBy("target").agg(F.count("*").alias("shared_groups"))
    out = counts.withColumnRenamed("source", "target").join(per, "target", "left").join(ids, "target", "left").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(distinct))  # one row each
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "target",
        (F.col("all") - F.col("n")).alias("train_lines"),
        F.col("n").alias("test_lines"),
        (F.col("distinct") - zero("alone")).alias("train_unique"),
        zero("test_unique").alias("test_unique"),
        zero("shared_lines").alias("shared_lines"),
        zero("shared_groups").alias("shared_groups"),
        ((zero("shared_lines") == 0) & (zero("shared_groups") == 0)).alias("clean"),
    )


def samples(lines: DataFrame) -> DataFrame:
    """(target, hash, text): the first SAMPLES shared lines of each fold by hash."""
    shared = line_sets(lines).where(F.size("sources") > 1).select(F.explode("sources").alias("target"), "hash", "text")
    return shared.withColumn("r", F.row_number().over(Window.partitionBy("target").orderBy("hash"))).where(F.col("r") <= SAMPLES).drop("r")


def group_samples(groups: DataFrame) -> DataFrame:
    """(target, group_id): the first SAMPLES groups by id that each fold shares with training; groups: (source, group_id)."""
    shared = groups.where(F.col("group_id").isNotNull()).groupBy("group_id").agg(F.collect_set("source").alias("s")).where(F.size("s") > 1)
    rows = shared.select(F.explode("s").alias("target"), "group_id")
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("target").orderBy("group_id"))).where(F.col("r") <= SAMPLES).drop("r")


def gate(report: DataFrame, strict: bool = True) -> list[str]:
    """Names of the folds that leak; raises if strict and there are any. A row a fold is read."""
    bad = sorted(r.target for r in report.where(~F.col("clean")).select("target").collect())
    if bad and strict:
        raise ValueError(f"leakage in folds: {bad}")
    return bad


def common_lines(lines: DataFrame) -> DataFrame:
    """(a, b, n): distinct lines that two systems share."""
    s = line_sets(lines).select("sources")
    pairs = s.select(F.explode("sources").alias("a"), "sources").select("a", F.explode("sources").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
