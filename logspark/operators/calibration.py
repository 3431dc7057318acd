"""Calibration: reliability bins, ECE, temperature, Platt and vector scaling, and the pipeline of them.

Rows: (fold, row_id, y_true, p1) or with logits z0, z1. Fits are iterated aggregates; a pass
returns a handful of sums and no rows travel. Empty bins are kept with null averages.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.functions.columns import logit, softmax, softmax1
from logspark.operators import selective
from logspark.operators.splits import stratified

THRESHOLD = 0.05


def bins(rows: DataFrame, n_bins: int = 15) -> DataFrame:
    """(fold, bin, lower, upper, n, mean_conf, accuracy) for every bin of every fold; class 0 on a tie."""
    if n_bins < 2:
        raise ValueError("at least 2 bins")
    p = F.col("p1")
    conf, pred = F.greatest(p, 1 - p), F.when(p > 1 - p, 1).otherwise(0)
    guess = F.least(F.floor(conf * n_bins), F.lit(n_bins - 1))
    # Edges are i / n as doubles; the product may fall on the other side of one.
    at = F.when(conf < guess / F.lit(float(n_bins)), guess - 1).when((guess < n_bins - 1) & (conf >= (guess + 1) / F.lit(float(n_bins))), guess + 1).otherwise(guess)
    got = rows.select("fold", at.cast("int").alias("bin"), conf.alias("c"), (pred == F.col("y_true")).cast("int").alias("ok")).groupBy("fold", "bin").agg(F.count("*").alias("n"), F.avg("c").alias("mean_conf"), F.avg("ok").alias("accuracy"))
    every = rows.select("fold").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    out = every.join(got, ["fold", "bin"], "left")
    return out.select("fold", "bin", (F.col("bin") / n_bins).alias("lower"), ((F.col("bin") + 1) / n_bins).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"), "mean_conf", "accuracy")


def ece(binned: DataFrame) -> DataFrame:
    """(fold, ece, mce, calibrated) from bins()."""
    gap = F.abs(F.col("accuracy") - F.col("mean_conf"))
    out = binned.groupBy("fold").agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))
    return out.withColumn("calibrated", F.col("ece") <= THRESHOLD)


def nll(z0, z1, y, t):
    """Negative log likelihood of softmax((z0, z1) / t), with a column or number t."""
    m = (z1 - z0) / t
    s = F.when(F.col(y) == 1, m).otherwise(-m)
    # log(1 + exp(-s)) without overflow
    return F.greatest(-s, F.lit(0.0)) + F.log1p(F.exp(-F.abs(s)))


def fit_temperature(rows: DataFrame) -> tuple[float, float, float]:
    """(T, NLL at 1, NLL at T): the minimiser over 1e-3 <= T <= 1e3.

    The NLL is convex in 1 / T, so Newton's method finds it in a few passes over the cached margins.
    """
    held = rows.select("z0", "z1", "y_true").persist()
    try:
        if held.limit(1).count() == 0:
            raise ValueError("no rows to fit")
        slope = newton(held, [F.col("z1") - F.col("z0")], (F.col("y_true") == 1).cast("double"))[0]
        t = min(1e3, max(1e-3, 1 / slope)) if slope > 1e-3 else 1e3
        z0, z1 = F.col("z0"), F.col("z1")
        before, after = held.agg(F.avg(nll(z0, z1, "y_true", 1.0)), F.avg(nll(z0, z1, "y_true", t))).first()
        return t, before, min(before, after)
    finally:
        held.unpersist()


def newton(rows: DataFrame, x: list, target, steps: int = 25) -> list[float]:
    """Weights of a logistic model on columns x with target in [0, 1]; a pass is one aggregate."""
    m = len(x)
    beta = np.zeros(m)
    for _ in range(steps):
        z = sum((F.lit(float(b)) * c for b, c in zip(beta, x, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        sums = [F.sum((target - p) * c) for c in x] + [F.sum(p * (1 - p) * x[i] * x[j]) for i in range(m) for j in range(i, m)]
        got = [float(v or 0.0) for v in rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
        h, k = np.zeros((m, m)), m
        for i in range(m):
            for j in range(i, m):
                h[i, j] = h[j, i] = got[k]
                k += 1
        step = np.linalg.solve(h + 1e-9 * np.eye(m), np.array(got[:m]))
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return [float(b) for b in beta]


def fit_platt(rows: DataFrame) -> tuple[float, float]:
    """(a, b) of sigmoid(a * margin + b) with smoothed targets."""
    n = {r.y_true: r["count"] for r in rows.groupBy("y_true").count().collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    target = F.when(F.col("y_true") == 1, (pos + 1) / (pos + 2)).otherwise(1 / (neg + 2))
    a, b = newton(rows, [F.col("z1") - F.col("z0"), F.lit(1.0)], target)
    return a, b


def platt(z0, z1, a: float, b: float):
    return 1 / (1 + F.exp(-(F.lit(a) * (z1 - z0) + F.lit(b))))


def fit_classes(rows: DataFrame, k: int, steps: int = 50) -> list[float]:
    """Weights w of softmax(w_1 z_1, .., w_k z_k) with the least mean NLL; rows: (z array of k logits, y_true from 0).

    Newton's method: a pass is one aggregate of k gradients, k (k + 1) / 2 Hessian sums and the NLL; a
    step that makes the NLL grow is halved. A class whose logit is always 0 keeps its weight of 1.
    """
    if k < 2:
        raise ValueError("at least 2 classes")
    held = rows.where(F.col("z").isNotNull() & F.col("y_true").between(0, k - 1)).select("y_true", *[F.col("z")[i].alias(f"z{i}") for i in range(k)]).persist()
    try:
        if held.limit(1).count() == 0:
            raise ValueError("no rows to fit")
        w, step, best = np.ones(k), np.zeros(k), np.inf
        for _ in range(steps):
            p = softmax([F.lit(float(w[i])) * F.col(f"z{i}") for i in range(k)])
            with_p = held.select("*", *[p[i].alias(f"p{i}") for i in range(k)])
            hit = F.greatest(F.lit(1e-300), F.coalesce(*[F.when(F.col("y_true") == i, F.col(f"p{i}")) for i in range(k)]))
            g = [F.sum((F.when(F.col("y_true") == i, 1.0).otherwise(0.0) - F.col(f"p{i}")) * F.col(f"z{i}")) for i in range(k)]
            h = [F.sum((F.lit(float(i == j)) - F.col(f"p{j}")) * F.col(f"p{i}") * F.col(f"z{i}") * F.col(f"z{j}")) for i in range(k) for j in range(i, k)]
            got = [float(v or 0.0) for v in with_p.agg(*[s.alias(f"s{i}") for i, s in enumerate((F.avg(-F.log(hit)), *g, *h))]).first()]
            if got[0] > best + 1e-12:
                step = step / 2
                w = w - step
                if np.abs(step).max() < 1e-9:
                    break
                continue
            best = got[0]
            hessian = np.zeros((k, k))
            hessian[np.triu_indices(k)] = got[k + 1 :]
            hessian = hessian + np.triu(hessian, 1).T
            step = np.linalg.solve(hessian + 1e-9 * np.eye(k) * max(1.0, np.trace(hessian)), np.array(got[1 : k + 1]))
            w = w + step
            if np.abs(step).max() < 1e-9:
                break
        return [float(x) for x in w]
    finally:
        held.unpersist()


def classes(z, w: list[float]):
    """Array of the probabilities of all classes after scaling the logits z (an array column) by w."""
    return F.array(*softmax([F.lit(float(x)) * z[i] for i, x in enumerate(w)]))


def fit_vector(rows: DataFrame) -> tuple[float, float]:
    """(w0, w1) of softmax((w0 z0, w1 z1)); the weight of a column that is always 0 stays 0."""
    w1, w0 = newton(rows, [F.col("z1"), -F.col("z0")], (F.col("y_true") == 1).cast("double"))
    return w0, w1


def vector(z0, z1, w0: float, w1: float):
    """Probability of class 1 after vector scaling."""
    return softmax1(F.lit(float(w0)) * z0, F.lit(float(w1)) * z1)


def with_logits(rows: DataFrame, p: str = "p_anomaly") -> DataFrame:
    return rows.withColumns({"z0": F.lit(0.0), "z1": logit(F.col(p))})


def parts(rows: DataFrame, fraction: float = 0.5, seed: int = 42) -> DataFrame:
    """rows with logits and part: calibration or held_out."""
    return stratified(with_logits(rows), ["fold", "y_true"], "row_id", fraction, seed)


def probability(fitted: dict):
    """Calibrated probability of class 1, by the method that calibrate() chose."""
    if fitted["method"] == "platt":
        return platt(F.col("z0"), F.col("z1"), fitted["a"], fitted["b"])
    return softmax1(F.col("z0"), F.col("z1"), fitted["temperature"])


def calibrate(rows: DataFrame, fraction: float = 0.5, seed: int = 42, budget: float = 0.05) -> dict:
    """Fit on the calibration part of one fold's rows, report on the held-out part.

    Temperature first; Platt scaling if the ECE stays above the threshold, kept if lower. The
    areas under risk-coverage and the threshold for the budget are those of the held-out part
    with the chosen calibration.
    """
    if rows.limit(4).count() < 4:
        raise ValueError("at least 4 predictions are needed")
    parted = parts(rows, fraction, seed).persist()
    fit, held = parted.where("part = 'calibration'"), parted.where("part = 'held_out'")
    z0, z1 = F.col("z0"), F.col("z1")
    error = lambda p: ece(bins(held.withColumn("p1", p))).first().ece
    t, before, after = fit_temperature(fit)
    out = {"base_ece": error(softmax1(z0, z1)), "temperature": t, "nll_before": before, "nll_after": after, "ece": error(softmax1(z0, z1, t)), "method": "temperature"}
    if out["ece"] > THRESHOLD:
        a, b = fit_platt(fit)
        other = error(platt(z0, z1, a, b))
        if other < out["ece"]:
            out |= {"ece": other, "method": "platt", "a": a, "b": b}
    final = held.withColumn("p1", probability(out))
    area, tau = selective.aurc(final).first(), selective.tau_for_budget(final, budget).first()
    out |= {k: area[k] for k in ("aurc", "optimal", "excess", "cost_aurc")} | {k: tau[k] for k in ("tau", "risk", "coverage", "feasible")}
    parted.unpersist()
    return out
