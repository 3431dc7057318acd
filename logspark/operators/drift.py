"""Drift of a value against a frozen reference: two-sample Kolmogorov-Smirnov and summaries.

Null and NaN values are skipped, rows without a key too. An empty side gives D 0 and p 1.
Distributions are running sums over distinct values (ranking.running), so a hot key's values
are not one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.operators.ranking import first_rows, running

WINDOW, MIN_ROWS, D_LIMIT, P_LIMIT = 1024, 8, 0.1, 0.05


def finite(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))


def keyed(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.dropna(subset=by)


def with_p(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_a, n_b, d, p) of rows (by, n_a, n_b, d)."""
    en = F.sqrt(F.col("n_a").cast("double") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))
    lam = (en + 0.12 + 0.11 / en) * F.col("d")
    # The series alternates and its terms fall fast; later terms than the first below 1e-8 change nothing that shows.
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, j: s + 2.0 * F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * F.col("lam") * F.col("lam") * j * j))
    small = (F.col("d") <= 1e-12) | (F.col("n_a") == 0) | (F.col("n_b") == 0)
    p = F.when(small, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))
    return rows.withColumn("lam", F.when(small, 1.0).otherwise(lam)).select(*by, "n_a", "n_b", F.when(small, 0.0).otherwise(F.col("d")).alias("d"), p.alias("p"))


def gap(a: Column, b: Column) -> Column:
    """Distance of two distribution functions whose counts up to a value are a and b; 0 if a side is empty."""
    return F.when((F.col("n_a") > 0) & (F.col("n_b") > 0), F.abs(a / F.col("n_a") - b / F.col("n_b"))).otherwise(0.0)


def ks(samples: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_a, n_b, d, p) of rows (by, side, value) with side `a` or `b`."""
    per = finite(keyed(samples, by)).groupBy(*by, "value").agg(F.count_if(F.col("side") == "a").alias("a"), F.count_if(F.col("side") == "b").alias("b"))
    run = running(per, by, "value", {"ca": "a", "cb": "b"}, descending=False)
    totals = per.groupBy(*by).agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    out = run.join(totals, by).groupBy(*by).agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.max(gap(F.col("ca"), F.col("cb"))).alias("d"))
    return with_p(out, by)


def five_numbers(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, minimum, q1, median, q3, maximum, mean), quartiles interpolated."""
    per = finite(keyed(rows, by)).groupBy(*by, "value").agg(F.count("*").alias("c"))
    run = running(per, by, "value", {"upto": "c"}, descending=False)
    totals = per.groupBy(*by).agg(F.sum("c").alias("n"), F.min("value").alias("minimum"), F.max("value").alias("maximum"), (F.sum(F.col("value") * F.col("c")) / F.sum("c")).alias("mean"))
    at = lambda q: (F.col("n") - 1) * F.lit(q)
    quarters = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    # The value at place i from 0 is the smallest one with more than i values up to it.
    ends = [F.min(F.when(F.col("upto") > f(at(q)), F.col("value").cast("double"))).alias(f"{name}_{side}") for name, q in quarters.items() for side, f in (("low", F.floor), ("high", F.ceil))]
    found = run.join(totals.select(*by, "n"), by).groupBy(*by).agg(*ends)
    between = [(F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (at(q) - F.floor(at(q)))).alias(name) for name, q in quarters.items()]
    return totals.join(found, by).select(*by, "n", "minimum", *between, "maximum", "mean")


def last(rows: DataFrame, by: list[str], order: list[str], n: int = WINDOW) -> DataFrame:
    """The last n values of each key."""
    return first_rows(finite(rows), by, [F.desc(c) for c in order], n)


def against(window: DataFrame, reference: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """KS and drift flag of window rows (by, value) against reference rows (keys, value) of the same keys.

    The reference's counts below and up to each value are found once for a key and joined to the
    windows' distinct values; between two of those only the reference grows, so the distance is
    largest at a value or right before it.
    """
    number = F.col("value").cast("double").alias("value")
    kept = keyed(window, by)
    a = finite(kept.select(*by, number)).groupBy(*by, "value").agg(F.count("*").alias("a"))
    b = finite(keyed(reference, keys).select(*keys, number)).groupBy(*keys, "value").agg(F.count("*").alias("b"))
    points = b.unionByName(a.select(*keys, "value", F.lit(0).cast("long").alias("b"))).groupBy(*keys, "value").agg(F.sum("b").alias("b"))
    placed = running(points, keys, "value", {"cb": "b"}, descending=False)
    run = running(a.join(placed, [*keys, "value"]), by, "value", {"ca": "a"}, descending=False)
    n_a, n_b = a.groupBy(*by).agg(F.sum("a").alias("n_a")), b.groupBy(*keys).agg(F.sum("b").alias("n_b"))
    wide = F.greatest(gap(F.col("ca"), F.col("cb")), gap(F.col("ca") - F.col("a"), F.col("cb") - F.col("b")))
    totals = kept.select(*by).distinct().join(n_a, by, "left").join(n_b, keys, "left").select(*by, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))
    d = run.join(totals, by).groupBy(*by).agg(F.max(wide).alias("d"))
    out = with_p(totals.join(d, by, "left").withColumn("d", F.coalesce("d", F.lit(0.0))), by)
    return out.withColumn("drift", (F.col("d") > D_LIMIT) & (F.col("p") < P_LIMIT) & (F.col("n_a") > MIN_ROWS))


def report(rows: DataFrame, reference: DataFrame, by: list[str], order: list[str], n: int = WINDOW) -> DataFrame:
    """A row a key: KS of the last n values against the reference, drift flag, summary of the window."""
    window = last(rows, by, order, n)
    return against(window, reference, by, by).join(five_numbers(window, by).drop("n"), by)


def windows(rows: DataFrame, reference: DataFrame, by: list[str], size: str, slide: str | None = None) -> DataFrame:
    """(by, window_start, ..): drift of each event-time window."""
    timed = rows.withColumn("window_start", F.window("ts", size, slide)["start"] if slide else F.window("ts", size)["start"])
    return against(timed, reference, [*by, "window_start"], by)
