"""Splits, folds and samples that depend on ids alone, so reruns and machines agree."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logspark.functions.columns import assign_split
from logspark.operators.tables import saved

SPLITS = ("train", "val", "test")


def with_split(sequences: DataFrame, **ratios: float) -> DataFrame:
    return sequences.withColumn("split", assign_split(F.col("source"), F.col("group_id"), **ratios))


def split_stats(split: DataFrame) -> DataFrame:
    """(source, split, n, anomalies, anomaly_fraction) with empty splits at 0."""
    names = split.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    every = split.select("source").distinct().crossJoin(F.broadcast(names))  # three rows a source
    got = split.groupBy("source", "split").agg(F.count("*").alias("n"), F.sum("label").alias("anomalies"))
    out = every.join(got, ["source", "split"], "left").select("source", "split", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("anomalies", F.lit(0)).alias("anomalies"))
    return out.withColumn("anomaly_fraction", F.round(F.when(F.col("n") > 0, F.col("anomalies") / F.col("n")).otherwise(0.0), 6))


def manifest(split: DataFrame) -> DataFrame:
    """(source, group_id, split), sorted; the table form of a split manifest."""
    return split.select("source", "group_id", "split").distinct().orderBy("source", "group_id")


def manifest_json(split: DataFrame) -> DataFrame:
    """(source, json): one small document a source; for many groups keep manifest()."""
    pairs = F.map_from_entries(F.sort_array(F.collect_set(F.struct("group_id", "split"))))
    return split.groupBy("source").agg(F.to_json(pairs).alias("json"))


def write_manifest(split: DataFrame, path: str, train: float = 0.8, val: float = 0.1) -> None:
    """One JSON document over text parts in order: ratios, statistics, and every source's groups, sorted.

    Its bytes, joined by manifest_bytes(), depend on the rows alone. A row is one line of it, so no
    row or task holds a source: the lines are sorted by range, with the head and the end among them.
    """
    spark = split.sparkSession
    groups = saved(split.select("source", "group_id", "split").where("source is not null and group_id is not null").distinct(), "manifest-groups")
    name = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)\A\[(.*)\]\z", 1)
    first = groups.agg(F.min(F.struct("source", "group_id")).alias("f")).select("f.*")
    starts = groups.groupBy("source").agg(F.min("group_id").alias("first"))  # a row a source
    top = first.select(F.col("source").alias("top"))
    lines = groups.join(F.broadcast(starts), "source").crossJoin(F.broadcast(top))
    opening = F.when(F.col("group_id") == F.col("first"), F.concat(F.when(F.col("source") == F.col("top"), "").otherwise("}, "), name("source"), F.lit(": {"))).otherwise(", ")
    body = lines.select(F.lit(1).alias("at"), "source", "group_id", F.concat(opening, name("group_id"), F.lit(": "), name("split")).alias("piece"))
    stats = {r.source: {} for r in starts.select("source").collect()}
    for r in split_stats(split.where("source is not null")).collect():  # three rows a source
        stats.setdefault(r.source, {})[r.split] = {"anomalies": r.anomalies, "anomaly_fraction": r.anomaly_fraction, "n": r.n}
    head = json.dumps({"ratios": {"test": round(1 - train - val, 6), "train": train, "val": val}, "stats": stats}, sort_keys=True, ensure_ascii=False)
    shape = "at int, source string, group_id string, piece string"
    ends = spark.createDataFrame([(0, None, None, head[:-1] + ', "groups": {'), (2, None, None, ("}" if stats else "") + "}}")], shape)
    body.unionByName(ends).orderBy("at", "source", "group_id").select(F.col("piece").alias("value")).write.text(path)


def manifest_bytes(spark: SparkSession, path: str) -> Iterator[bytes]:
    """The document of write_manifest(), part by part in order; a part is held at a time."""
    names = sorted(r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path").collect())
    for name in names:
        for r in spark.read.format("binaryFile").load(name).select("content").collect():
            yield bytes(r.content)


def chronological(lines: DataFrame, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """lines with split by place: the first train share, then val, then test, within each source."""
    totals = lines.groupBy("source").agg((F.max("line_no") + 1).alias("total"))
    at = F.col("line_no") / F.col("total")
    return lines.join(F.broadcast(totals), "source").withColumn("split", F.when(at < train, "train").when(at < train + val, "val").otherwise("test"))  # a row a source


def folds(systems: DataFrame, include: list[str] | None = None) -> DataFrame:
    """(target, source, role): every system held out once; include limits the targets."""
    names = systems.select("source").distinct()
    targets = names.select(F.col("source").alias("target"))
    if include is not None:
        known = {r.source for r in names.collect()}  # a row a system
        if unknown := sorted(set(include) - known):
            raise ValueError(f"unknown systems: {unknown}")
        targets = targets.where(F.col("target").isin(include))
    return targets.crossJoin(names).withColumn("role", F.when(F.col("source") == F.col("target"), "test").otherwise("train"))


def compose(sequences: DataFrame, use_splits: bool = False) -> DataFrame:
    """(target, role, n, anomalies): sizes of each fold's parts, from per-source counts, without copies of rows.

    use_splits: train and val of the sources against test of the target, instead of whole systems.
    """
    keys = ["source", "split"] if use_splits else ["source"]
    counts = sequences.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("label").alias("anomalies"))
    joined = folds(sequences).join(counts, "source")
    if use_splits:
        joined = joined.where(F.when(F.col("role") == "test", F.col("split") == "test").otherwise(F.col("split") != "test"))
    return joined.groupBy("target", "role").agg(F.sum("n").alias("n"), F.sum("anomalies").alias("anomalies"))


def strip_labels(sequences: DataFrame, target: Column) -> DataFrame:
    """Label 0 where target holds."""
    return sequences.withColumn("label", F.when(target, 0).otherwise(F.col("label")))


def class_weights(train: DataFrame, by: str, cap: float = 10.0) -> DataFrame:
    """(by, weight_0, weight_1): total / (2 * count), at most cap; cap for a class that is absent."""
    n = train.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))
    weight = lambda c: F.when(F.col(c) > 0, F.least(F.lit(cap), F.col("n") / (2 * F.col(c)))).otherwise(cap)
    return n.select(by, weight("n0").alias("weight_0"), weight("n1").alias("weight_1"))


def majority(train_counts: DataFrame, test: DataFrame) -> DataFrame:
    """test rows (fold, row_id, y_true) with y_pred of the training majority (normal on a tie) and score 0.5."""
    pred = train_counts.select("fold", F.when(2 * F.col("anomalies") > F.col("n"), 1).otherwise(0).alias("y_pred"))
    return test.join(F.broadcast(pred), "fold").withColumn("p_anomaly", F.lit(0.5))  # a row a fold


def order_key(seed: int, *columns: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]), 256)


def fraction_sample(rows: DataFrame, by: list[str], id_: str, fraction: float, seed: int = 42) -> DataFrame:
    """max(1, round(n * fraction)) rows of each group, first by hash of seed and id.

    The cut is by rank in the hash order of each group; ranks come from a window over hash
    ranges, so a large group is spread over 256 of them.
    """
    keyed = rows.withColumn("_h", order_key(seed, id_)).withColumn("_b", F.substring("_h", 1, 2))
    sizes = keyed.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy("_b")
    starts = sizes.select(*by, "_b", (F.sum("_n").over(w) - F.col("_n")).alias("_start"), F.sum("_n").over(Window.partitionBy(*by)).alias("_total"))
    rank = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", id_))
    out = keyed.withColumn("_r", rank).join(starts, [*by, "_b"])
    want = F.greatest(F.lit(1), F.round(F.col("_total") * fraction).cast("long"))
    return out.where(F.col("_start") + F.col("_r") <= want).select(*rows.columns)


def stratified(rows: DataFrame, by: list[str], id_: str, fraction: float, seed: int = 42) -> DataFrame:
    """rows with part: calibration for max(1, round(n * fraction)) of each group, else held_out."""
    chosen = fraction_sample(rows, by, id_, fraction, seed).select(*by, id_).withColumn("_c", F.lit(True))
    return rows.join(chosen, [*by, id_], "left").withColumn("part", F.when(F.col("_c"), "calibration").otherwise("held_out")).drop("_c")
