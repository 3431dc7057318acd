"""Paired statistics over experiment tables (axis, condition, seed, metric, value).

Null and NaN values are dropped before anything is paired. A condition without values keeps its
row: n 0, delta 0, p 1; so it counts in a family of tests.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logspark.operators.metrics import summary
from logspark.operators.ranking import running

# Bands of Cliff's delta.
BANDS = ((0.147, "negligible"), (0.33, "small"), (0.474, "medium"))
CELL = ["axis", "condition", "metric"]


def cell_summary(cells: DataFrame) -> DataFrame:
    return summary(cells, CELL)


def paired(cells: DataFrame, baseline: str, by_seed: bool = False) -> DataFrame:
    """(axis, condition, metric, place, a, b): condition values against the baseline's, by position after missing ones are dropped, or by seed."""
    v = cells.where(F.col("value").isNotNull() & ~F.isnan("value"))
    place = F.col("seed").cast("long") if by_seed else F.row_number().over(Window.partitionBy(*CELL).orderBy("seed", "value")).cast("long")
    v = v.withColumn("place", place)
    base = v.where(F.col("condition") == baseline).select("axis", "metric", "place", F.col("value").alias("b"))
    return v.where(F.col("condition") != baseline).join(base, ["axis", "metric", "place"]).select(*CELL, "place", F.col("value").alias("a"), "b")


def compare(cells: DataFrame, baseline: str) -> DataFrame:
    """(axis, condition, metric, n, delta_mean)"""
    got = paired(cells, baseline).groupBy(*CELL).agg(F.count("*").alias("n"), F.avg(F.col("a") - F.col("b")).alias("delta_mean"))
    return conditions(cells, baseline).join(got, CELL, "left").select(*CELL, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("delta_mean", F.lit(0.0)).alias("delta_mean"))


def conditions(cells: DataFrame, baseline: str) -> DataFrame:
    """(axis, condition, metric) other than the baseline, with values or without."""
    return cells.select(*CELL).where(F.col("condition") != baseline).distinct()


def against(cells: DataFrame, published: float) -> DataFrame:
    """(axis, condition, metric, place, a, b): every value paired with one published value, for a one-sample signed rank test."""
    v = cells.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return v.select(*CELL, F.col("seed").cast("long").alias("place"), F.col("value").alias("a"), F.lit(float(published)).alias("b"))


def tests(cells: DataFrame, baseline: str, alternative: str = "two-sided") -> DataFrame:
    """signed_rank of every condition against the baseline."""
    got = signed_rank(paired(cells, baseline), alternative)
    none = [F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("statistic", F.lit(0.0)).alias("statistic"), F.coalesce("p", F.lit(1.0)).alias("p")]
    return conditions(cells, baseline).join(got, CELL, "left").select(*CELL, *none)


#: Differences up to which the signed rank test is exact; cells that one task of a grid gets, more only beyond GRID_TASKS tasks.
EXACT, GRID_TASKS = 25, 10_000


def tail(plus: float, n: float, ties: float, alternative: str) -> float:
    """p of the normal form from the positive rank sum, the number of differences and the sum of t^3 - t over ties."""
    sd = math.sqrt(max(0.0, n * (n + 1) * (2 * n + 1) / 24 - ties / 48))
    z = (plus - n * (n + 1) / 4) / sd if sd else 0.0
    le, ge = 0.5 * math.erfc(-z / math.sqrt(2)), 0.5 * math.erfc(z / math.sqrt(2))
    return {"two-sided": 2 * min(le, ge), "greater": ge, "less": le}[alternative]


def signed_rank_test(diffs: np.ndarray, alternative: str = "two-sided") -> tuple[float, float]:
    """(statistic, p): zeros dropped, average ranks, exact for up to EXACT differences, else normal."""
    d = diffs[diffs != 0]
    n = len(d)
    if n == 0:
        return 0.0, 1.0
    ranks = pd.Series(np.abs(d)).rank().to_numpy()
    plus = float(ranks[d > 0].sum())
    minus = float(ranks.sum() - plus)
    statistic = min(plus, minus) if alternative == "two-sided" else plus
    if n <= EXACT:
        # Ways to reach each doubled rank sum.
        ways = np.ones(1)
        for r in np.round(2 * ranks).astype(int):
            longer = np.zeros(len(ways) + r)
            longer[: len(ways)] += ways
            longer[r:] += ways
            ways = longer
        share = ways / ways.sum()
        at = round(2 * plus)
        le, ge = share[: at + 1].sum(), share[at:].sum()
        p = {"two-sided": 2 * min(le, ge), "greater": ge, "less": le}[alternative]
    else:
        same = np.unique(ranks, return_counts=True)[1].astype(float)
        p = tail(plus, float(n), float((same**3 - same).sum()), alternative)
    return statistic, float(min(1.0, max(0.0, p)))


def signed_rank(pairs: DataFrame, alternative: str = "two-sided") -> DataFrame:
    """(axis, condition, metric, n, statistic, p) of pairs (.., a, b); n counts zero differences too, a single pair has p 1.

    Only groups of at most EXACT differences are gathered. For larger ones the differences are counted by
    size, ranks are running sums of the counts, and the normal form needs sums alone.
    """
    d = pairs.select(*CELL, (F.col("a") - F.col("b")).alias("d"))
    sizes = d.groupBy(*CELL).agg(F.count("*").alias("n"), F.count_if(F.col("d") != 0).alias("m"))
    key = lambda df: df.select(*[F.col(c).alias(f"_{c}") for c in CELL], "n", "m")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in CELL])
    sized = d.where("d <> 0").join(key(sizes), same).select(*CELL, "d", "n", "m")

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        s, p = signed_rank_test(pdf["d"].to_numpy(), alternative)
        return pd.DataFrame({c: [pdf[c].iloc[0]] for c in CELL} | {"n": [pdf["n"].iloc[0]], "statistic": [s], "p": [p]})

    small = sized.where((F.col("m") <= EXACT) & (F.col("n") > 1)).groupBy(*CELL).applyInPandas(test, "axis string, condition string, metric string, n long, statistic double, p double")
    by = sized.where(F.col("m") > EXACT).groupBy(*CELL, F.abs("d").alias("size")).agg(F.count("*").alias("c"), F.count_if(F.col("d") > 0).alias("up"), F.max("n").alias("n"), F.max("m").cast("double").alias("m"))
    ranked = running(by, list(CELL), "size", {"upto": "c"}, descending=False)
    rank, c = F.col("upto") - (F.col("c") - 1) / 2, F.col("c").cast("double")
    large = ranked.groupBy(*CELL).agg(F.max("n").alias("n"), F.max("m").alias("m"), F.sum(F.col("up") * rank).alias("plus"), F.sum(c * c * c - c).alias("ties"))
    p = F.pandas_udf(lambda plus, m, ties: pd.Series([min(1.0, max(0.0, tail(*x, alternative))) for x in zip(plus, m, ties, strict=True)], dtype=float), "double")
    statistic = F.least("plus", F.col("m") * (F.col("m") + 1) / 2 - F.col("plus")) if alternative == "two-sided" else F.col("plus")
    rest = sizes.where((F.col("m") == 0) | (F.col("n") <= 1)).select(*CELL, "n", F.lit(0.0).alias("statistic"), F.lit(1.0).alias("p"))
    return small.unionByName(large.select(*CELL, "n", statistic.alias("statistic"), p("plus", "m", "ties").alias("p"))).unionByName(rest)


def cliffs_delta(cells: DataFrame, baseline: str) -> DataFrame:
    """(axis, condition, metric, delta, band) of all values against the baseline's, by running counts of values."""
    v = cells.where(F.col("value").isNotNull() & ~F.isnan("value"))
    keys = v.select(*CELL).where(F.col("condition") != baseline).distinct()
    base = keys.join(v.where(F.col("condition") == baseline).select("axis", "metric", "value"), ["axis", "metric"])
    rows = v.where(F.col("condition") != baseline).select(*CELL, "value", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(base.select(*CELL, "value", F.lit(0).alias("a"), F.lit(1).alias("b")))
    per = rows.groupBy(*CELL, "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    below = F.sum("b").over(Window.partitionBy(*CELL).orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("b").over(Window.partitionBy(*CELL))
    out = per.select(*CELL, "a", "b", (below - F.col("b")).alias("under"), (total - below).alias("over"))
    out = out.groupBy(*CELL).agg(F.sum(F.col("a") * (F.col("under") - F.col("over"))).alias("s"), F.sum("a").alias("na"), F.sum("b").alias("nb"))
    delta = F.when((F.col("na") > 0) & (F.col("nb") > 0), F.col("s") / (F.col("na").cast("double") * F.col("nb"))).otherwise(0.0)
    size = F.abs(F.col("delta"))
    band = F.when(size < BANDS[0][0], BANDS[0][1]).when(size < BANDS[1][0], BANDS[1][1]).when(size < BANDS[2][0], BANDS[2][1]).otherwise("large")
    got = conditions(cells, baseline).join(out.select(*CELL, delta.alias("delta")), CELL, "left")
    return got.select(*CELL, F.coalesce("delta", F.lit(0.0)).alias("delta")).withColumn("band", band)


def holm(tests: DataFrame, by: list[str], id_: list[str], p: str = "p", alpha: float = 0.05) -> DataFrame:
    """tests with adjusted (running maximum of p * (m - k), at most 1) and rejected (stops at the first failure)."""
    w = Window.partitionBy(*by).orderBy(p, *id_)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    k = F.row_number().over(w) - 1
    m = F.count("*").over(Window.partitionBy(*by))
    out = tests.withColumns({"_k": k, "_m": m})
    scaled = F.least(F.lit(1.0), F.col(p) * (F.col("_m") - F.col("_k")))
    passes = (F.col(p) < alpha / (F.col("_m") - F.col("_k"))).cast("int")
    return out.withColumns({"adjusted": F.max(scaled).over(run), "rejected": F.min(passes).over(run) == 1}).drop("_k", "_m")


def joint(tests: DataFrame) -> DataFrame:
    """tests with significant: rejected and |delta| above 0.33."""
    return tests.withColumn("significant", F.col("rejected") & (F.abs("delta") > 0.33))


def matrix(summaries: DataFrame, baseline: str) -> DataFrame:
    """(axis, condition, metric, mean, std, n, baseline, delta) in order."""
    base = summaries.where(F.col("condition") == baseline).select("axis", "metric", F.col("mean").alias("base"))
    out = summaries.join(base, ["axis", "metric"], "left")
    return out.select(*CELL, "mean", "std", "n", (F.col("condition") == baseline).alias("baseline"), (F.col("mean") - F.col("base")).alias("delta"))


def head_to_head(ours: DataFrame, published: DataFrame, folds: list[str]) -> DataFrame:
    """(method, a column a fold, macro): percent with two decimals, an em dash for what is missing.

    ours: (method, fold, f1), its macro is the mean of its folds. published: published_table(); its macro is the published one.
    """
    own = ours.select("method", "fold", "f1", F.avg("f1").over(Window.partitionBy("method")).alias("macro"))
    rows = own.unionByName(published.select("method", "fold", "f1", F.col("macro_f1").alias("macro")))
    wide = rows.groupBy("method").pivot("fold", folds).agg(F.first("f1", ignorenulls=True))
    macro = rows.groupBy("method").agg(F.first("macro", ignorenulls=True).alias("macro"))
    show = lambda c: F.when(F.col(c).isNull(), "—").otherwise(F.format_string("%.2f", 100 * F.col(c)))
    return wide.join(macro, "method").select("method", *[show(f).alias(f) for f in folds], show("macro").alias("macro"))


def loss_tail(steps: DataFrame, by: list[str], fraction: float = 0.1) -> DataFrame:
    """(by, n, falling): whether the last max(2, ceil(n * fraction)) values of (step, value) never rise (by more than 1e-9)."""
    w = Window.partitionBy(*by)
    rows = steps.withColumns({"_n": F.count("*").over(w), "_r": F.row_number().over(w.orderBy(F.desc("step"))), "_prev": F.lag("value").over(w.orderBy("step"))})
    tail = F.greatest(F.lit(2), F.ceil(F.col("_n") * fraction))
    ok = (F.col("_r") >= tail) | F.col("_prev").isNull() | (F.col("value") <= F.col("_prev") + 1e-9)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(ok.cast("int")).alias("f")).select(*by, "n", (F.col("f") == 1).alias("falling"))


def run_grid(cells: DataFrame, runner, schema: str) -> DataFrame:
    """runner(pandas row dict) -> dict for each cell (axis, condition, seed), spread over tasks; equal cells are an error."""
    if cells.groupBy("axis", "condition", "seed").count().where("count > 1").limit(1).count():
        raise ValueError("a seed occurs twice in a condition")

    def run(frames):
        for pdf in frames:
            if len(pdf):
                yield pd.DataFrame([runner(r) for r in pdf.to_dict("records")])

    return cells.repartition(max(1, min(GRID_TASKS, cells.count())), "axis", "condition", "seed").mapInPandas(run, schema)
