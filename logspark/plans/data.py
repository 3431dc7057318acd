"""The given tables in the shapes that the jobs work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions.columns import demo_score


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """(source, group_id, line_no, text): the lines of each document; its language is the system."""
    docs = table(spark, sf, "documents")
    cut = docs.select(F.col("lang").alias("source"), F.col("doc_id").cast("string").alias("group_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return cut.withColumn("line_no", F.col("line_no").cast("long"))


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    """(source, group_id, label, n_lines): documents as sequences, label from labels.toxic or 0."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = docs.select(F.col("lang").alias("source"), "doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    out = rows.join(labels.select("doc_id", "toxic"), "doc_id", "left")
    return out.select("source", F.col("doc_id").cast("string").alias("group_id"), F.coalesce("toxic", F.lit(0)).cast("int").alias("label"), "n_lines")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """(fold, row_id, y_true, y_pred, p_anomaly): documents scored by the demonstration scorer."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = docs.select(F.col("lang").alias("fold"), F.col("doc_id").alias("row_id"), demo_score(F.col("text")).alias("p_anomaly"))
    out = rows.join(labels.select(F.col("doc_id").alias("row_id"), "toxic"), "row_id", "left")
    return out.select("fold", "row_id", F.coalesce("toxic", F.lit(0)).cast("int").alias("y_true"), F.when(F.col("p_anomaly") >= 0.5, 1).otherwise(0).alias("y_pred"), "p_anomaly")


def event_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(source, line_no, label, value): the events as an arrival stream of lines that start with their label."""
    e = table(spark, sf, "events")
    mark = F.when(F.col("event_type") == "error", "E").otherwise("-")
    value = F.concat_ws(" ", mark, "event_type", F.col("user_id").cast("string"), "props")
    return e.select(F.lit("events").alias("source"), F.col("event_id").alias("line_no"), (F.col("event_type") == "error").cast("int").alias("label"), value.alias("value"))


def conversation_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(source, group_id, line_no, text, value): turns as session logs; value names the instance."""
    c = table(spark, sf, "conversations")
    value = F.concat(F.lit("[instance: "), F.col("conv_id").cast("string"), F.lit("] "), F.col("text"))
    return c.select(F.lit("chat").alias("source"), F.col("conv_id").cast("string").alias("group_id"), F.col("turn").alias("line_no"), "text", value.alias("value"))


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """(axis, condition, seed, metric, value): mean length of documents by source, language and doc_id % 5."""
    d = table(spark, sf, "documents")
    return d.groupBy(F.col("source").alias("axis"), F.col("lang").alias("condition"), (F.col("doc_id") % 5).alias("seed")).agg(F.avg(F.col("n_chars").cast("double")).alias("value")).withColumn("metric", F.lit("chars"))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """(request_id, id, lines): documents dealt to requests of up to about 40 by their number."""
    d = table(spark, sf, "documents")
    return d.select(F.floor(F.col("doc_id") / 40).alias("request_id"), (F.col("doc_id") % 39).cast("string").alias("id"), F.split("text", "\n").alias("lines"))


def drift_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("key"), "value")
