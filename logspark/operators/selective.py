"""Risk-coverage analysis and thresholds for selective prediction.

Rows: (fold, row_id, y_true, p1). Confidence is max(p1, 1 - p1); class 0 on a tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.operators.ranking import running


def losses(rows: DataFrame, fn_cost: float = 1.0, fp_cost: float = 1.0) -> DataFrame:
    """(fold, row_id, conf, wrong, cost)"""
    if fn_cost <= 0 or fp_cost <= 0:
        raise ValueError("costs are above 0")
    p = F.col("p1")
    pred = F.when(p > 1 - p, 1).otherwise(0)
    wrong = (pred != F.col("y_true")).cast("long")
    cost = F.when(wrong == 0, 0.0).when(F.col("y_true") == 1, fn_cost).otherwise(fp_cost)
    return rows.select("fold", "row_id", F.greatest(p, 1 - p).alias("conf"), wrong.alias("wrong"), cost.alias("cost"), F.lit(1).cast("long").alias("one"))


def risk_coverage(rows: DataFrame, cost: str = "wrong", fn_cost: float = 1.0, fp_cost: float = 1.0) -> DataFrame:
    """(fold, rank, coverage, risk): running mean loss in order of falling confidence, then row_id."""
    own = losses(rows, fn_cost, fp_cost)
    run = running(own, ["fold"], "conf", {"rank": "one", "loss": cost}, tie="row_id")
    total = own.groupBy("fold").agg(F.count("*").alias("total"))
    return run.join(F.broadcast(total), "fold").select("fold", "rank", (F.col("rank") / F.col("total")).alias("coverage"), (F.col("loss") / F.col("rank")).alias("risk"), "conf")  # a row a fold


def harmonic(n: Column) -> Column:
    """1 + 1/2 + .. + 1/n: summed up to 64, beyond by its expansion, whose rest is below 1e-17 there."""
    x = n.cast("double")
    few = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(F.least(n, F.lit(64)), F.lit(1))), F.lit(0.0), lambda s, j: s + 1.0 / j)
    many = F.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
    return F.when(n <= 0, 0.0).when(n <= 64, few).otherwise(many)


def aurc(rows: DataFrame, fn_cost: float = 5.0, fp_cost: float = 1.0) -> DataFrame:
    """(fold, aurc, optimal, excess, cost_aurc): mean running risk, that of errors ranked last, their difference, with costs."""
    mean = risk_coverage(rows).groupBy("fold").agg(F.avg("risk").alias("aurc"))
    cost = risk_coverage(rows, "cost", fn_cost, fp_cost).groupBy("fold").agg(F.avg("risk").alias("cost_aurc"))
    n = losses(rows).groupBy("fold").agg(F.count("*").alias("n"), F.sum("wrong").alias("e"))
    # Errors last: rank n - e + j holds j errors, so the sum of j / (n - e + j) over j from 1 to e is asked for.
    right = F.col("n") - F.col("e")
    best = n.select("fold", ((F.col("e") - right * (harmonic(F.col("n")) - harmonic(right))) / F.col("n")).alias("optimal"))
    return mean.join(best, "fold").join(cost, "fold").select("fold", "aurc", "optimal", (F.col("aurc") - F.col("optimal")).alias("excess"), "cost_aurc")


def by_confidence(rows: DataFrame) -> DataFrame:
    """(fold, tau, accepted, errors, total): what each distinct confidence and the edges 0.5 and 1 accept as threshold."""
    per = losses(rows).groupBy("fold", F.col("conf").alias("tau")).agg(F.count("*").alias("n"), F.sum("wrong").alias("w"))
    edges = rows.select("fold").distinct().withColumn("tau", F.explode(F.array(F.lit(0.5), F.lit(1.0)))).withColumns({"n": F.lit(0).cast("long"), "w": F.lit(0).cast("long")})
    every = per.unionByName(edges).groupBy("fold", "tau").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    run = running(every, ["fold"], "tau", {"accepted": "n", "errors": "w"})
    total = per.groupBy("fold").agg(F.sum("n").alias("total"))
    return run.join(F.broadcast(total), "fold").select("fold", "tau", "accepted", "errors", "total")  # a row a fold


def tau_for_budget(rows: DataFrame, budget: float, taus: list[float] | None = None) -> DataFrame:
    """(fold, tau, risk, coverage, feasible): the smallest threshold whose risk keeps to the budget.

    taus: candidates instead of the distinct confidences, clipped to [0.5, 1]. Where nothing is
    feasible: tau 1, risk null, coverage 0.
    """
    table = by_confidence(rows)
    if taus is not None:
        marks = sorted({min(1.0, max(0.5, t)) for t in taus})
        # What a candidate accepts is what the next confidence at or above it accepts: a threshold counts
        # for the largest candidate up to it, and the sums go on from there to the smaller ones.
        place = F.size(F.filter(F.array(*[F.lit(t) for t in marks]), lambda t: t <= F.col("tau")))
        near = table.withColumn("place", place).where("place > 0").groupBy("fold", "place").agg(F.max("accepted").alias("accepted"), F.max_by("errors", "accepted").alias("errors"), F.max("total").alias("total"))
        every = near.select("fold").distinct().withColumn("place", F.explode(F.array(*[F.lit(i + 1) for i in range(len(marks))])))
        from_top = Window.partitionBy("fold").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)  # a row a candidate
        filled = every.join(near, ["fold", "place"], "left").select("fold", "place", *[F.last(c, True).over(from_top).alias(c) for c in ("accepted", "errors", "total")])
        table = filled.where("accepted is not null").withColumn("tau", F.element_at(F.array(*[F.lit(t) for t in marks]), F.col("place")))
    ok = table.where((F.col("accepted") > 0) & (F.col("errors") / F.col("accepted") <= budget))
    best = ok.groupBy("fold").agg(F.min("tau").alias("tau"), F.min_by(F.col("errors") / F.col("accepted"), "tau").alias("risk"), F.min_by(F.col("accepted") / F.col("total"), "tau").alias("coverage"))
    out = rows.select("fold").distinct().join(best, "fold", "left")
    return out.select("fold", F.coalesce("tau", F.lit(1.0)).alias("tau"), "risk", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.col("tau").isNotNull().alias("feasible"))


def coverage_at_risk(rows: DataFrame, risk: float = 0.05) -> DataFrame:
    """(fold, coverage): most coverage of a prefix of the ranking whose risk keeps to the limit; 0 if none."""
    got = risk_coverage(rows).where(F.col("risk") <= risk).groupBy("fold").agg(F.max("coverage").alias("coverage"))
    return rows.select("fold").distinct().join(got, "fold", "left").select("fold", F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def applied(rows: DataFrame, taus: DataFrame) -> DataFrame:
    """(fold, tau, risk, coverage) of thresholds (fold, tau) on rows; risk null if nothing is accepted."""
    got = losses(rows).join(F.broadcast(taus.select("fold", "tau")), "fold").groupBy("fold", "tau").agg(F.count("*").alias("n"), F.count_if(F.col("conf") >= F.col("tau")).alias("a"), F.sum(F.when(F.col("conf") >= F.col("tau"), F.col("wrong"))).alias("e"))  # a row a fold
    return got.select("fold", "tau", F.when(F.col("a") > 0, F.col("e") / F.col("a")).alias("risk"), (F.col("a") / F.col("n")).alias("coverage"))


def tau_shift(rows: DataFrame, target: str, budget: float, small) -> DataFrame:
    """(setting, tau, risk, coverage) on the target fold with thresholds fitted on the other folds, on its rows where small holds, and on all of it."""
    own, others = rows.where(F.col("fold") == target), rows.where(F.col("fold") != target)
    fits = {"source": others, "target_small": own.where(small), "target_full": own}
    out = None
    for name, part in fits.items():
        tau = tau_for_budget(part.withColumn("fold", F.lit(target)), budget)
        got = applied(own, tau).select(F.lit(name).alias("setting"), "tau", "risk", "coverage")
        out = got if out is None else out.unionByName(got)
    return out


