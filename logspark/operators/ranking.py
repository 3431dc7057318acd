"""Running sums in rank order within groups, for curves and ranking metrics.

With few rows one window per group does. Beyond SPREAD rows the rows are cut into ranges of
the ranking value at quantiles of all rows; each range has its own window, and the totals of
the ranges before it are added. So one large group doesn't land in one task. A value that
fills several ranges by itself is cut further by the tie column, if that is a number or a string.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

SPREAD = 2_000_000
RANGES = 512
#: Above this Spark plans no limit for a window's groups, so the rows of a key are ranked in parts first.
GROUP_LIMIT = 1000
PARTS = 256


def running(rows: DataFrame, by: list[str], value: str, sums: dict[str, str], tie: str | None = None, descending: bool = True, spread: int = SPREAD) -> DataFrame:
    """rows with a running sum of each column in sums (new name: column), rank order by value, then tie."""
    order = [F.desc(value) if descending else F.asc(value), *([F.asc(tie)] if tie else [])]
    if rows.limit(spread + 1).count() <= spread:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({k: F.sum(c).over(w) for k, c in sums.items()})
    cuts = rows.approxQuantile(value, [i / RANGES for i in range(1, RANGES)], 0.0005)
    # Equal values are in one range: the ranges follow the order. Null values are the lowest.
    place = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col(value)))
    cut = rows.withColumn("_range", F.coalesce(place, F.lit(-1)) * (-1 if descending else 1)).withColumn("_part", _tie_part(rows, value, tie, cuts, descending))
    parts = [*by, "_range", "_part"]
    totals = cut.groupBy(*parts).agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    # Null groups are groups too, so they are met by a form of the key without nulls.
    key = F.xxhash64(*[F.col(c) for c in parts], *[F.col(c).isNull() for c in by])
    starts = totals.select(*[F.col(c).alias(f"_k_{c}") for c in parts], key.alias("_key"), *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_s_{k}") for k in sums])
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in parts]
    w = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = cut.withColumn("_own", key).join(starts, [F.col("_own") == F.col("_key"), *same]).drop("_own", "_key", *[f"_k_{c}" for c in parts])
    out = met.withColumns({k: F.sum(c).over(w) + F.col(f"_s_{k}") for k, c in sums.items()})
    return out.drop("_range", "_part", *[f"_s_{k}" for k in sums])


def _tie_part(rows: DataFrame, value: str, tie: str | None, cuts: list[float], descending: bool):
    """Place of a row in its range: rows of a value that is several cuts at once are cut by quantiles of tie.

    A string tie is cut by the number that its first bytes make after those that all of its values share.
    """
    heavy = sorted({a for a, b in zip(cuts, cuts[1:]) if a == b})
    if not heavy or tie is None or not isinstance(rows.schema[tie].dataType, NumericType | StringType):
        return F.lit(0)
    own, at = F.col(value).isin(heavy), F.col(tie)
    if isinstance(rows.schema[tie].dataType, StringType):
        ends = rows.where(own).agg(F.min(tie), F.max(tie)).first()
        low, high = (((x or "").encode()) for x in ends)
        shared = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
        digits = F.rpad(F.hex(F.substring(F.encode(at, "UTF-8"), shared + 1, 6)), 12, "0")
        at = F.conv(digits, 16, 10).cast("long")
    marks = sorted(set(rows.where(own).select(at.alias("_t")).approxQuantile("_t", [i / RANGES for i in range(1, RANGES)], 0.0005)))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in marks]), lambda c: c < at))
    # The heavy value is its range's largest; a null tie comes first.
    return F.when(own, F.coalesce(F.when(at.isNotNull(), part), F.lit(-1))).otherwise(len(marks) + 1 if descending else -2)


def first_rows(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group. order: columns, or their descending forms."""
    rank = lambda df, keys: df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
    if n < GROUP_LIMIT:
        return rank(rows, by)
    # A hot key's rows are dealt over parts by their content; each part keeps its first n.
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(PARTS)))
    return rank(rank(dealt, [*by, "_deal"]).drop("_deal"), by)
