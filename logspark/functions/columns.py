"""Column functions on single rows: splits, scores, decisions, logits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that raise the demonstration score.
ALARMS = ("fatal", "panic", "kerndtlb", "exception")
MILLION = 1_000_000


def hash_fraction(dataset: Column, group: Column) -> Column:
    """SHA-256 of `dataset::group`, its first 8 bytes modulo a million."""
    digest = F.sha2(F.concat(dataset, F.lit("::"), group), 256)
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % MILLION).cast("long")


def assign_split(dataset: Column, group: Column, train: float = 0.8, val: float = 0.1, test: float = 0.1) -> Column:
    """train, val or test, by the group's hash alone."""
    if abs(train + val + test - 1) > 1e-9:
        raise ValueError("split ratios must add up to 1")
    at, first = hash_fraction(dataset, group), round(train * MILLION)
    return F.when(at < first, "train").when(at < first + round(val * MILLION), "val").otherwise("test")


def demo_score(text: Column) -> Column:
    """Deterministic anomaly score: first digest byte, plus 0.15 for each alarm word, at most 1."""
    raw = F.conv(F.substring(F.sha2(text, 256), 1, 2), 16, 10).cast("double") / 255.0
    low = F.lower(text)
    bias = sum((F.when(low.contains(w), 0.15).otherwise(0.0) for w in ALARMS), F.lit(0.0))
    return F.least(F.lit(1.0), raw + bias)


def confidence(p: Column) -> Column:
    return F.greatest(p, 1 - p)


def selective(p1: Column, tau: float) -> Column:
    """abstain under tau, else the larger class; a tie is normal."""
    if not 0.5 <= tau <= 1:
        raise ValueError("tau lies in [0.5, 1]")
    return F.when(confidence(p1) < tau, "abstain").when(p1 > 1 - p1, "anomaly").otherwise("normal")


def serving(p1: Column, tau: float) -> Column:
    """abstain under tau, else anomaly from 0.5 on."""
    return F.when(confidence(p1) < tau, "abstain").when(p1 >= 0.5, "anomaly").otherwise("normal")


def serving_reason(p1: Column, tau: float) -> Column:
    return F.when(confidence(p1) < tau, F.format_string("confidence=%.4f < tau=%.4f", confidence(p1), F.lit(tau)))


def logit(p: Column) -> Column:
    """ln(p / (1 - p)) with p kept 1e-7 away from 0 and 1."""
    q = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), p))
    return F.log(q / (1 - q))


def softmax1(z0: Column, z1: Column, temperature: float | Column = 1.0) -> Column:
    """Second entry of the softmax of (z0, z1) / T, shifted by the larger."""
    t = F.greatest(F.lit(1e-9), temperature if isinstance(temperature, Column) else F.lit(float(temperature)))
    top = F.greatest(z0, z1)
    a, b = F.exp((z0 - top) / t), F.exp((z1 - top) / t)
    return b / (a + b)


def ratio(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    """a / b as double; otherwise if b is 0."""
    return F.when(b != 0, a.cast("double") / b).otherwise(F.lit(otherwise).cast("double"))


def softmax(logits: list[Column], t: float = 1.0) -> list[Column]:
    """Probabilities of any number of classes at temperature t; the greatest logit is taken off first."""
    top = F.greatest(*logits) if len(logits) > 1 else logits[0]
    parts = [F.exp((z - top) / F.lit(float(t))) for z in logits]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]
