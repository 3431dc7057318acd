"""Streams with state of their own: sessions with lines, drift by event time, a sink that holds each batch once."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logspark.operators import drift, sequence
from logspark.streaming import streams

LINES = "key string, ts timestamp, place long, text string, label int"
DAY = dt.datetime(2024, 1, 1)


def fed(spark, tmp_path, parts, make, schema, mode="append", sink=None):
    """Sums of what drained() saw over triggers that each bring one part."""
    seen = []
    with streams.state_store(spark):
        for rows in parts:
            spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
            seen.append(streams.drained(make(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), str(tmp_path), mode, sink))
    return {k: sum(s[k] for s in seen) for k in seen[0]}


def batch_sessions(spark, rows, gap, limit):
    """W1 in batch: keys cut by gaps, sequences of the cut keys."""
    by_key, out = {}, []
    for key, ts, place, text, label in rows:
        by_key.setdefault(key, []).append((ts, place, text, label))
    for key, lines in by_key.items():
        lines.sort(key=lambda x: x[:2])
        number = 0
        for i, (ts, place, text, label) in enumerate(lines):
            number += i > 0 and (ts - lines[i - 1][0]).total_seconds() >= gap
            out.append(("s", f"{key}#{number}", i, text, ts, label, key))
    df = spark.createDataFrame(out, "source string, group_id string, line_no long, text string, ts timestamp, label int, key string")
    sums = df.groupBy("group_id").agg(F.first("key").alias("key"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n_lines"), F.max("label").alias("label"))
    return {(r.key, r.start, r.end, r.n_lines, r.label, tuple(r.lines)) for r in sequence.sessions(df.drop("label"), limit=limit).drop("label").join(sums, "group_id").collect()}


@pytest.mark.parametrize("limit", [None, 3])
def test_session_lines_equal_the_batch_ones(spark, tmp_path, limit):
    rng = random.Random(limit)
    rows = [(rng.choice("abc"), DAY + dt.timedelta(minutes=rng.randrange(0, 3_000)), i, rng.choice(["x", "y", "z"]) + str(i), int(rng.random() < 0.1)) for i in range(400)]
    rows += [("d", DAY, 1, "one", 0), ("d", DAY + dt.timedelta(seconds=1800), 2, "at the gap", 1), ("d", DAY + dt.timedelta(seconds=3599), 3, "inside", 0)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    end = [("flush", DAY + dt.timedelta(days=400), 0, "", 0)]
    seen = fed(spark, tmp_path, [shuffled[::3], shuffled[1::3], shuffled[2::3], end], lambda s: streams.session_lines(s, 1800, "30 days", limit), spark.createDataFrame([], LINES).schema)
    got = {(r.key, r.start, r.end, r.n_lines, r.label, tuple(r.lines)) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == batch_sessions(spark, rows, 1800, limit) and seen["late"] == 0 and seen["rows"] == len(rows) + 1


def test_sessions_close_in_time_and_late_lines_are_counted(spark, tmp_path):
    at = lambda minutes: DAY + dt.timedelta(minutes=minutes)
    parts = [[("a", at(0), 1, "one", 0), ("a", at(50), 2, "three", 1), (None, at(1), 3, None, None)], [("a", at(25), 4, "two", 0), ("b", at(200), 5, "far", 0)], [("b", at(201), 6, "on", 0)], [("a", at(3), 7, "late", 1), ("a", None, 8, "no time", 1)]]
    seen = fed(spark, tmp_path, parts, lambda s: streams.session_lines(s, 1800, "1 hour"), spark.createDataFrame([], LINES).schema)
    got = {r.key: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert set(got) == {"a", None} and seen["late"] == 1  # b is still open
    assert list(got["a"].lines) == ["one", "two", "three"] and (got["a"].start, got["a"].end, got["a"].label) == (at(0), at(50), 1)
    assert list(got[None].lines) == [None] and got[None].label == 0


def test_drift_by_event_time_equals_the_report(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [("ab"[i % 2], i, DAY + dt.timedelta(minutes=int(m)), float(v)) for i, (m, v) in enumerate(zip(rng.integers(0, 900, 600), rng.normal(0, 1, 600), strict=True))]
    rows += [("a", 9_000, DAY + dt.timedelta(days=3), float("nan")), ("c", 9_001, DAY, None), ("c", None, DAY, 2.0)]
    schema = spark.createDataFrame([], "key string, event_id long, ts timestamp, value double").schema
    df, base = spark.createDataFrame(rows, schema), spark.createDataFrame([("a", float(v)) for v in rng.normal(0.5, 1, 80)], "key string, value double")
    base.write.parquet(f"{tmp_path}/base")
    frozen = lambda: spark.readStream.schema(base.schema).parquet(f"{tmp_path}/base")
    late_first = sorted(rows, key=lambda r: r[2], reverse=True)
    fed(spark, tmp_path, [late_first[:100], late_first[300:], late_first[100:300]], lambda s: streams.drift_state(s, frozen(), n=64), schema, "update", streams.publish(f"{tmp_path}/out"))
    got = {r.key: r for r in streams.latest(spark, f"{tmp_path}/out", ["key"]).collect()}
    want = {r.key: r for r in drift.report(df, base, ["key"], ["ts", "event_id"], n=64).collect()}
    assert set(got) == set(want) == {"a", "b", "c"}
    for k, r in want.items():
        assert got[k].n == r.n_a and abs(got[k].d - r.d) < 1e-12 and abs(got[k].p - r.p) < 1e-8 and got[k].drift == r.drift


def test_a_repeated_batch_is_published_once(spark, tmp_path):
    schema, sink, killed = spark.createDataFrame([], "v long").schema, streams.publish(f"{tmp_path}/out"), []

    def killed_after(df, batch):
        sink(df, batch)
        if not killed:
            killed.append(batch)
            raise RuntimeError("lost before the batch was committed")

    spark.range(10).withColumnRenamed("id", "v").write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="lost before"):
        streams.drained(stream(), str(tmp_path), sink=killed_after)
    streams.drained(stream(), str(tmp_path), sink=killed_after)
    assert killed == [0] and sorted(r.v for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(10))

    def killed_before(df, batch):
        if batch == 1 and len(killed) == 1:
            killed.append(batch)
            df.write.parquet(f"{tmp_path}/out/_aside/1")
            raise RuntimeError("lost while it was written")
        sink(df, batch)

    spark.range(10, 15).withColumnRenamed("id", "v").write.mode("append").parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="lost while"):
        streams.drained(stream(), str(tmp_path), sink=killed_before)
    streams.drained(stream(), str(tmp_path), sink=killed_before)
    assert sorted(r.v for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(15))
    assert streams.latest(spark, f"{tmp_path}/out", ["v"]).count() == 15


def test_keys_that_share_a_bucket_stay_apart(spark, tmp_path):
    at = lambda minutes: DAY + dt.timedelta(minutes=minutes)
    schema = spark.createDataFrame([], LINES.replace("key string", "key long")).schema
    rows = [(k, at(k % 7 + 300 * j), 10 * k + j, f"{k}/{j}", int(j == 1)) for k in range(300) for j in range(3)] + [(None, at(2), 1, None, None)]
    end = [(-1, at(500_000), 0, "", 0)]
    seen = fed(spark, tmp_path, [rows[::2], rows[1::2], end], lambda s: streams.session_lines(s, 1800, "30 days", 2, buckets=3), schema)
    got = {(r.key, r.start, r.n_lines, r.label, tuple(r.lines)) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(k, at(k % 7 + 300 * j), 1, int(j == 1), (f"{k}/{j}",)) for k in range(300) for j in range(3)} | {(None, at(2), 1, 0, (None,))}
    # A bucket's state is one row with one timer, however many sessions are open.
    assert seen["late"] == 0 and spark.read.format("statestore").option("batchId", 1).option("stateVarName", "open").load(f"{tmp_path}/state").count() == 3
