"""Sketches of lengths and distinct lines, kept for each source and split and merged without a new scan.

A table of sketches has a row for each source and split, whatever its number of rows: a quantile
sketch (KLL) of line numbers and a distinct-count sketch (HLL) of line texts. Folds, systems and any
other union of its rows come from merging them. RANK_ERROR and COUNT_ERROR hold for about 99 of 100
answers; exact forms are `sequence.profile` and count_distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a quantile sketch and its error as a share of the ranks; 2^LG_K registers of a distinct sketch and its relative error.
KLL_K, RANK_ERROR, LG_K, COUNT_ERROR = 400, 0.012, 14, 0.025


def sketched(sequences: DataFrame, by: tuple[str, ...] = ("source", "split")) -> DataFrame:
    """(by, n, lengths, texts) of sequences (by, n_lines, lines): one pass, partial sketches before the shuffle.

    Lines are counted as sketches of each row's own lines, so rows are not multiplied. Null lines are no text.
    """
    flat = sequences.select(*by, "n_lines", F.explode_outer(F.array_distinct("lines")).alias("text"), F.lit(1).alias("_"))
    texts = flat.groupBy(*by).agg(F.hll_sketch_agg("text", F.lit(LG_K)).alias("texts"))
    lengths = sequences.groupBy(*by).agg(F.count("*").alias("n"), F.kll_sketch_agg_bigint(F.col("n_lines").cast("long"), F.lit(KLL_K)).alias("lengths"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    joined = lengths.join(texts.select(*[F.col(c).alias(f"_{c}") for c in by], "texts"), same)
    return joined.select(*by, "n", "lengths", "texts")


def merged(sketches: DataFrame, *by) -> DataFrame:
    """Sketches of unions: rows of one value of by become one."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("lengths").alias("lengths"), F.hll_union_agg("texts").alias("texts"))


def of_folds(sketches: DataFrame) -> DataFrame:
    """(target, role, n, lengths, texts): each source held out once, from the table of sketches alone."""
    own = merged(sketches, "source")
    targets = own.select(F.col("source").alias("target"))
    role = F.when(F.col("source") == F.col("target"), "test").otherwise("train")
    return merged(targets.crossJoin(own).withColumn("role", role), "target", "role")  # a row a pair of systems


def quantile(q: float) -> Column:
    """Quantile of the lengths of a sketch row."""
    return F.kll_sketch_get_quantile_bigint("lengths", F.lit(q))


def distinct() -> Column:
    """Number of distinct texts of a sketch row."""
    return F.hll_sketch_estimate("texts")
