"""Validation of batch scoring requests, and the scoring job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.functions.columns import confidence, demo_score, serving, serving_reason
from logspark.functions.mask import mask
from logspark.operators.tables import saved

ID_CHARS, MAX_LINES, LINE_BYTES, MAX_SEQUENCES, MAX_TOTAL = 128, 256, 4096, 64, 4096


def _own(requests: DataFrame) -> DataFrame:
    """The rows with own, the first rule for a sequence that fails (else null), and n, their lines."""
    own = (
        F.when(F.col("id").isNull() | ~F.length("id").between(1, ID_CHARS), "id length")
        .when(F.col("lines").isNull() | ~F.size("lines").between(1, MAX_LINES), "line count")
        .when(F.exists("lines", lambda x: F.coalesce(F.octet_length(x), F.lit(0)) > LINE_BYTES), "line bytes")
    )
    return requests.select("request_id", "id", "lines", own.alias("own"), F.coalesce(F.size("lines"), F.lit(0)).alias("n"))


def _judged(rows: DataFrame, *carried) -> DataFrame:
    """(request_id, id, reason, c, carried aggregates): equal rows of _own counted, with the first rule that fails.

    The counts are saved, as three sums read them, so the lines are read once.
    """
    rows = saved(rows.groupBy("request_id", "id", "own").agg(F.count("*").alias("c"), F.sum("n").alias("n"), *carried), "requests")
    per = rows.groupBy(F.col("request_id").alias("r")).agg(F.sum("c").alias("sequences"), F.sum("n").alias("total"))
    many = rows.groupBy(F.col("request_id").alias("r2"), F.col("id").alias("i2")).agg(F.sum("c").alias("same")).where("same > 1")
    met = rows.join(per, F.col("request_id").eqNullSafe(F.col("r"))).join(many, F.col("request_id").eqNullSafe(F.col("r2")) & F.col("id").eqNullSafe(F.col("i2")), "left")
    reason = F.coalesce("own", F.when(F.col("sequences") > MAX_SEQUENCES, "sequence count").when(F.col("total") > MAX_TOTAL, "total lines").when(F.col("same") > 1, "duplicate id"))
    return met.withColumn("reason", reason)


def validate(requests: DataFrame) -> DataFrame:
    """(request_id, id, reason): reason null for an accepted sequence; the first rule that fails else. Rows: (request_id, id, lines).

    Rules for a sequence are settled where its lines are read; what is shuffled are numbers: equal rows
    are counted, and a request's sums come from these counts, so a large request is no task of its own.
    """
    times = F.explode(F.sequence(F.lit(1).cast("long"), "c")).alias("_nth")
    return _judged(_own(requests)).select("request_id", "id", "reason", times).drop("_nth")


def score_job(requests: DataFrame, tau: float, scorer=demo_score) -> DataFrame:
    """(request_id, id, p_anomaly, confidence, decision, reason) of accepted sequences: mask, score, decide.

    Lines are masked and scored where they are read, unless their own rules reject them; the shuffles
    carry the score. An accepted sequence is alone with its id, so the largest score there is its own.
    """
    text = F.when(F.col("own").isNull(), F.array_join(F.transform("lines", lambda x: mask(x)), "\n")).otherwise("")
    rows = _own(requests).select("request_id", "id", "own", "n", text.alias("text"))
    scored = rows.select("request_id", "id", "own", "n", scorer(F.col("text")).alias("p_anomaly"))
    ok = _judged(scored, F.max("p_anomaly").alias("p_anomaly")).where("reason is null")
    return ok.select("request_id", "id", "p_anomaly", confidence(F.col("p_anomaly")).alias("confidence"), serving(F.col("p_anomaly"), tau).alias("decision"), serving_reason(F.col("p_anomaly"), tau).alias("reason"))


def score_with(sequences: DataFrame, load, schema: str = "group_id string, p_anomaly double") -> DataFrame:
    """Plug-in scorer: load() gives, once in a worker, a function from lists of lines to probabilities."""

    def run(frames):
        predict = load()
        for pdf in frames:
            p = list(predict([list(x) for x in pdf["lines"]]))
            if len(p) != len(pdf):
                raise ValueError("the scorer gave another number of rows")
            yield pdf[["group_id"]].assign(p_anomaly=p)

    return sequences.select("group_id", "lines").mapInPandas(run, schema)
