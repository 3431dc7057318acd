"""Lines to labelled sequences: sessions by key, sliding windows, profiles.

Lines: (source, line_no, label, text) or with group_id. Null text counts as a line. Equal
line numbers keep an order by text. Sequences: (source, group_id, label, lines).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.operators.ranking import first_rows

#: Window numbers that one row is spread into.
CHUNK = 100_000
#: Windows' lengths that a block of lines holds, for windows with their lines.
SPANS = 20


def sessions(lines: DataFrame, labels: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """One sequence for each (source, group_id), lines in order; label from labels, else 0.

    With limit only a group's first lines are gathered. Without it a group is one row, as it is asked for.
    """
    kept = first_rows(lines.select("source", "group_id", "line_no", "text"), ["source", "group_id"], ["line_no", "text"], limit) if limit else lines
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    out = kept.groupBy("source", "group_id").agg(ordered.alias("lines"))
    if labels is None:
        return out.withColumn("label", F.lit(0))
    return out.join(labels.select("group_id", "label"), "group_id", "left").withColumn("label", F.coalesce("label", F.lit(0)))


def bucketed(rows: DataFrame, table: str, buckets: int, by: str = "group_id") -> DataFrame:
    """rows as a table dealt into buckets of by and sorted in them; tables of as many buckets join by it without a shuffle."""
    rows.repartition(buckets, by).write.mode("overwrite").bucketBy(buckets, by).sortBy(by).saveAsTable(table)
    return rows.sparkSession.table(table)


def labelled(sequences: DataFrame, labels: DataFrame) -> DataFrame:
    """sequences with the label of their group, 0 without one; bucketed() tables are joined bucket by bucket."""
    met = sequences.join(labels.select("group_id", "label").hint("merge"), "group_id", "left")
    return met.withColumn("label", F.coalesce("label", F.lit(0)))


def window_count(total, window: int, stride: int):
    """Number of whole windows; a shorter input is one window, an empty one none."""
    return F.when(total <= 0, 0).when(total < window, 1).otherwise(F.floor((total - window) / stride) + 1)


def checked(window: int, stride: int) -> None:
    if window < 1 or stride < 1:
        raise ValueError("window and stride are at least 1")


def window_specs(totals: DataFrame, window: int = 100, stride: int = 20, pad_last: bool = False) -> DataFrame:
    """(source, k, start, end, group_id) for totals (source, total)."""
    checked(window, stride)
    base = totals.withColumn("n", window_count(F.col("total"), window, stride).cast("long")).where("n > 0")
    # Numbers in two steps, so that no row holds all windows of a source.
    chunks = base.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))))
    numbers = F.sequence(F.col("c") * CHUNK, F.least(F.col("n"), (F.col("c") + 1) * CHUNK) - 1)
    specs = chunks.withColumn("k", F.explode(numbers)).drop("c").withColumn("start", F.col("k") * F.lit(stride).cast("long"))
    if pad_last:
        tail = base.withColumn("reach", (F.col("n") - 1) * stride + window).where(F.col("reach") < F.col("total"))
        specs = specs.drop("reach").unionByName(tail.withColumns({"k": F.col("n"), "start": F.col("total") - window}).select(*specs.columns))
    end = F.least(F.col("total"), F.col("start") + window)
    return specs.select("source", "k", F.col("start").cast("long"), end.cast("long").alias("end"), F.concat_ws("_", "source", F.col("k").cast("string")).alias("group_id"))


def sliding(lines: DataFrame, window: int = 100, stride: int = 20, pad_last: bool = False) -> DataFrame:
    """(source, k, start, end, n_lines, label) of windows over line numbers from 0; label 1 if any line's is.

    Lines are first summed up in blocks of gcd(window, stride) lines, so a line is not copied
    into each of its windows.
    """
    checked(window, stride)
    block = math.gcd(window, stride)
    totals = lines.groupBy("source").agg((F.max("line_no") + 1).alias("total"))
    specs = window_specs(totals, window, stride)
    sums = lines.groupBy("source", F.floor(F.col("line_no") / block).alias("block")).agg(F.max("label").alias("label"), F.count("*").alias("n"))
    spread = specs.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
    out = spread.join(sums, ["source", "block"]).groupBy("source", "k", "start", "end").agg(F.sum("n").alias("n_lines"), F.max("label").alias("label"))
    if pad_last:
        last = window_specs(totals, window, stride, pad_last=True).join(specs.select("source", "k"), ["source", "k"], "left_anti")
        own = lines.join(F.broadcast(last), "source").where("line_no >= start and line_no < end")  # one window a source
        out = out.unionByName(own.groupBy("source", "k", "start", "end").agg(F.count("*").alias("n_lines"), F.max("label").alias("label")))
    return out


def haloed(lines: DataFrame, window: int, stride: int) -> DataFrame:
    """(source, block, arr): lines in blocks of about SPANS windows' lengths, each with the lines after it that its last windows reach.

    A block holds the windows that start in it. About a SPANS-th of the lines stands in two blocks.
    """
    size = block_size(window, stride)
    low, high = F.greatest(F.lit(0), F.floor((F.col("line_no") - (window - 1)) / size)), F.floor(F.col("line_no") / size)
    placed = lines.select("source", "line_no", "text", "label", F.explode(F.sequence(low, high)).alias("block"))
    return placed.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("line_no", "text", "label"))).alias("arr"))


def block_size(window: int, stride: int) -> int:
    """Lines of a block: a multiple of stride, at least SPANS windows or strides."""
    return stride * -(-SPANS * max(window, stride) // stride)


def window_lines(lines: DataFrame, window: int = 100, stride: int = 20, pad_last: bool = False) -> DataFrame:
    """(source, group_id, label, lines) of the windows, with pad_last one more over an uncovered tail.

    A line is shuffled once, and a second time near a block's end; windows are cut inside the blocks.
    """
    checked(window, stride)
    size = block_size(window, stride)
    totals = lines.groupBy("source").agg((F.max("line_no") + 1).alias("total"))
    blocks = haloed(lines, window, stride).join(F.broadcast(totals), "source")  # a row a source
    last = window_count(F.col("total"), window, stride) - 1
    first = F.col("block") * F.lit(size // stride)
    ks = F.sequence(first, F.least(last, first + (size // stride - 1)))
    starts = F.when(first <= last, F.transform(ks, lambda k: F.struct(k.alias("k"), (k * stride).alias("start"))))
    starts = F.coalesce(starts, F.array().cast("array<struct<k: bigint, start: bigint>>"))
    if pad_last:
        tail = F.col("total") - window
        more = (last * stride + window < F.col("total")) & (F.floor(tail / size) == F.col("block"))
        starts = F.concat(starts, F.when(more, F.array(F.struct((last + 1).alias("k"), tail.alias("start")))).otherwise(F.array().cast("array<struct<k: bigint, start: bigint>>")))
    begin = F.col("arr")[0]["line_no"]
    # Lines without holes or repeats are cut by place, others are looked through.
    dense = F.forall(F.sequence(F.lit(0), F.size("arr") - 1), lambda i: F.get("arr", i)["line_no"] == begin + i)
    cut = F.transform(
        "starts",
        lambda s: F.struct(
            s["k"].alias("k"),
            F.when(F.col("dense"), F.slice("arr", F.greatest(F.lit(1), s["start"] - begin + 1).cast("int"), F.greatest(F.lit(0), F.lit(window) - F.greatest(F.lit(0), begin - s["start"])).cast("int"))).otherwise(F.filter("arr", lambda x: (x["line_no"] >= s["start"]) & (x["line_no"] < s["start"] + window))).alias("w"),
        ),
    )
    out = blocks.withColumns({"starts": starts, "dense": dense}).select("source", F.explode(cut).alias("c")).where(F.size("c.w") > 0)
    return out.select("source", F.concat_ws("_", "source", F.col("c.k").cast("string")).alias("group_id"), F.array_max(F.transform("c.w", lambda x: x["label"])).alias("label"), F.transform("c.w", lambda x: x["text"]).alias("lines"))


def uncovered(lines: DataFrame, window: int = 100, stride: int = 20, pad_last: bool = False) -> DataFrame:
    """(source, covered, uncovered): lines that stand in some window, and the others, for any stride."""
    checked(window, stride)
    totals = lines.groupBy("source").agg((F.max("line_no") + 1).alias("total"))
    rows = lines.select("source", "line_no").join(F.broadcast(totals), "source")  # a row a source
    # The last window that starts at or before the line reaches farthest of those that do.
    k = F.least(F.floor(F.col("line_no") / stride), window_count(F.col("total"), window, stride) - 1)
    inside = F.col("line_no") < k * stride + window
    inside = inside | (F.col("line_no") >= F.col("total") - window) if pad_last else inside
    return rows.groupBy("source").agg(F.count_if(inside).alias("covered"), F.count_if(~inside).alias("uncovered"))


def profile(sequences: DataFrame) -> DataFrame:
    """(source, n, normal, anomalous, anomaly_fraction, mean_lines, p95_lines) from (source, label, n_lines)."""
    return sequences.groupBy("source").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("label") == 0).alias("normal"),
        F.count_if(F.col("label") == 1).alias("anomalous"),
        F.avg(F.col("label").cast("double")).alias("anomaly_fraction"),
        F.avg("n_lines").alias("mean_lines"),
        F.percentile("n_lines", F.lit(0.95)).alias("p95_lines"),
    )
