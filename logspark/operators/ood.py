"""Distances between systems by word n-grams of their lines.

Words are split at white space. Lines with fewer than n words give none; null lines are skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.operators.tables import saved

#: Bytes of text for each shuffle partition at most, so that a task's n-grams stay as many whatever the input.
TEXT_A_PARTITION = 8 << 20


def ngram_counts(lines: DataFrame, n: int = 2) -> DataFrame:
    """(source, ngram, cnt): n-grams, words joined by a space. Distinct lines are counted before they are cut up. The counts are saved."""
    if n < 1:
        raise ValueError("n is at least 1")
    distinct = lines.where(F.col("text").isNotNull()).groupBy("source", "text").agg(F.count("*").alias("times"))
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    cut = distinct.select("source", "times", words.alias("w")).where(F.size("w") >= n)
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice(F.col("w"), i, n), " "))
    counts = cut.select("source", "times", F.explode(grams).alias("ngram")).groupBy("source", "ngram").agg(F.sum("times").alias("cnt"))
    size = lines.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return saved(counts, "ngram-counts", partitions=-(-size // TEXT_A_PARTITION))


def distances(lines: DataFrame, n: int = 2) -> DataFrame:
    """(a, b, shared, jaccard, cosine) for all ordered pairs of systems."""
    # Norms and both sides of the join read one saved table, so the n-grams are cut and counted once.
    counts = ngram_counts(lines, n)
    norms = lines.select("source").distinct().join(counts.groupBy("source").agg(F.count("*").alias("types"), F.sum(F.col("cnt").cast("double") * F.col("cnt")).alias("sq")), "source", "left").select("source", F.coalesce("types", F.lit(0)).alias("types"), F.coalesce("sq", F.lit(0.0)).alias("sq"))
    left, right = counts.select(F.col("source").alias("a"), "ngram", F.col("cnt").alias("ca")), counts.select(F.col("source").alias("b"), "ngram", F.col("cnt").alias("cb"))
    # An n-gram has one row a system, so the join makes at most systems squared rows for it.
    dots = left.join(right, "ngram").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("shared"), F.sum(F.col("ca").cast("double") * F.col("cb")).alias("dot"))
    one = norms.select(F.col("source").alias("a"), F.col("types").alias("ta"), F.col("sq").alias("qa"))
    two = norms.select(F.col("source").alias("b"), F.col("types").alias("tb"), F.col("sq").alias("qb"))
    every = one.crossJoin(two).where("a <> b").join(dots, ["a", "b"], "left")  # a row a pair of systems
    shared, dot = F.coalesce("shared", F.lit(0)), F.coalesce("dot", F.lit(0)).cast("double")
    union = F.col("ta") + F.col("tb") - shared
    jaccard = F.when(union == 0, 0.0).otherwise(1 - shared / union)
    norm = F.sqrt(F.col("qa").cast("double")) * F.sqrt(F.col("qb").cast("double"))
    cosine = F.when(union == 0, 0.0).when(norm == 0, 1.0).otherwise(1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / norm)))
    return every.select("a", "b", shared.alias("shared"), F.round(jaccard, 6).alias("jaccard"), F.round(cosine, 6).alias("cosine"))
