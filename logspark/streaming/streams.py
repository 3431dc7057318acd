"""Structured Streaming forms of the stateless steps, sessions, windows, scores and drift."""

from __future__ import annotations

import contextlib
import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from logspark.functions.columns import confidence, demo_score, serving
from logspark.functions.mask import mask
from logspark.operators.drift import D_LIMIT, MIN_ROWS, P_LIMIT, WINDOW


def masked(stream: DataFrame) -> DataFrame:
    return stream.withColumn("masked", mask(F.col("text")))


def session_sequences(stream: DataFrame, gap: str, delay: str) -> DataFrame:
    """(key, start, n_lines, label) of each session of a key: it ends after a gap without events."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    out = timed.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_lines"), F.max("label").alias("label"))
    return out.select("key", F.col("w.start").alias("start"), "n_lines", "label")


def line_windows(stream: DataFrame, size: str, slide: str, delay: str) -> DataFrame:
    """(start, n_lines, label) of event-time windows; label 1 if any line's is."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", size, slide).alias("w")).agg(F.count("*").alias("n_lines"), F.max("label").alias("label")).select(F.col("w.start").alias("start"), "n_lines", "label")


def scored(stream: DataFrame, tau: float) -> DataFrame:
    p = demo_score(F.col("masked"))
    return masked(stream).withColumn("p_anomaly", p).withColumn("confidence", confidence(F.col("p_anomaly"))).withColumn("decision", serving(F.col("p_anomaly"), tau))


def ks_arrays(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    if not len(a) or not len(b):
        return 0.0, 1.0
    a, b = np.sort(a), np.sort(b)
    both = np.concatenate([a, b])
    d = float(np.abs(np.searchsorted(a, both, side="right") / len(a) - np.searchsorted(b, both, side="right") / len(b)).max())
    if d <= 1e-12:
        return 0.0, 1.0
    en = (len(a) * len(b) / (len(a) + len(b))) ** 0.5
    j = np.arange(1, 101)
    p = float((2.0 * np.where(j % 2 == 1, 1.0, -1.0) * np.exp(-2.0 * ((en + 0.12 + 0.11 / en) * d * j) ** 2)).sum())
    return d, min(1.0, max(0.0, p))


class OpenSessions(StatefulProcessor):
    """Sessions of a bucket of keys that may still grow, each with its first `limit` lines by (time, place); times in microseconds.

    A line joins a session of its key that it is less than `gap` away from, and may join two into one.
    A bucket's open sessions are one JSON text, read and written once a trigger, and its timer stands at
    the first end: a session closes once the watermark is `gap` past its last line, when no line can join it.
    """

    def __init__(self, gap: int, limit: int | None):
        self.gap, self.limit = gap, limit

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "sessions string")

    def held(self) -> list[list]:
        """[key, start, end, n, label, [us, ...], [place, ...], [text, ...]] of each open session."""
        return json.loads(self.open.get()[0]) if self.open.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now: dict[str | None, list[tuple]] = {}
        for own, start, end, n, label, *lines in self.held():
            now.setdefault(own, []).append((start, end, n, label, list(zip(*lines, strict=True))))
        for frame in rows:
            met = set()
            for own, us, place, text, label in zip(*(frame[c].tolist() for c in ("key", "us", "place", "text", "label")), strict=True):
                now.setdefault(own, []).append((us, us, 1, label, [(us, place, text)]))
                met.add(own)
            for own in met:
                now[own] = self.merged(now[own])
        self.hold([(own, start, end, n, label, *([x[i] for x in lines] for i in range(3))) for own, sessions in now.items() for start, end, n, label, lines in sessions])
        return iter(())

    def merged(self, sessions: list[tuple]) -> list[tuple]:
        """Sessions (start, end, n, label, lines) that lie less than gap apart as one."""
        out: list[list] = []
        for start, end, n, label, lines in sorted(sessions, key=lambda s: s[:2]):
            if out and start - out[-1][1] < self.gap:
                last = out[-1]
                last[1], last[2], last[3] = max(last[1], end), last[2] + n, max(last[3], label)
                last[4] += lines
            else:
                out.append([start, end, n, label, list(lines)])
        first = lambda lines: sorted(lines, key=lambda x: (x[0], x[1], x[2] is not None, x[2] or ""))[: self.limit]
        return [(*s[:4], first(s[4])) for s in out]

    def hold(self, sessions: list[tuple]) -> None:
        """The bucket's open sessions from now on, with a timer at the first of their ends."""
        first = min((self.due(s[2]) for s in sessions), default=None)
        timers = list(self.handle.listTimers())
        for at in timers:
            if at != first:
                self.handle.deleteTimer(at)
        if not sessions:
            return self.open.clear()
        self.open.update((json.dumps(sessions, ensure_ascii=False),))
        if first not in timers:
            self.handle.registerTimer(first)

    def due(self, end: int) -> int:
        return -(-(end + self.gap) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        done, still = [], []
        for session in self.held():
            (done if self.due(session[2]) <= now else still).append(session)
        self.hold(still)
        if done:
            key, start, end, n, label, _, _, lines = zip(*done, strict=True)
            yield pd.DataFrame({"key": pd.Series(key, dtype=object), "start": start, "end": end, "n_lines": n, "label": label, "lines": [list(x) for x in lines]})

    def close(self) -> None:
        pass


def session_lines(stream: DataFrame, gap_seconds: int, delay: str, limit: int | None = None, buckets: int = 512) -> DataFrame:
    """(key, start, end, n_lines, label, lines) of each session of a key, in append mode once it is closed.

    Rows: (key, ts, place, text, label); lines are ordered by (ts, place), whatever order they arrive
    in, and cut to the first `limit`; n_lines and label count all. Rows without ts go. Lines behind the
    watermark are dropped and counted by drained(). A key is a string or of a type that its string gives
    back (numbers, dates). Keys share state in so many buckets by their hash: a bucket's open sessions pass
    through one task, so set more for more than about 100 million of them; a checkpoint keeps its number.
    Needs the state store of state_store().
    """
    kind = stream.schema["key"].dataType
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")
    rows = stream.select(bucket, F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("place").cast("long").alias("place"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("label").cast("int"), F.lit(0)).alias("label")).where("ts is not null")
    timed = rows.withWatermark("ts", delay).withColumn("us", F.unix_micros("ts")).withColumn("place", F.coalesce("place", F.lit(-1)))
    out = timed.groupBy("bucket").transformWithStateInPandas(OpenSessions(gap_seconds * 1_000_000, limit), "key string, start long, end long, n_lines long, label int, lines array<string>", "append", "eventTime")
    return out.select(F.col("key").cast(kind).alias("key"), F.timestamp_micros("start").alias("start"), F.timestamp_micros("end").alias("end"), "n_lines", "label", "lines")


class LastValues(StatefulProcessor):
    """The last n values of a key by (ts, event_id), against the reference that stands in its state; a key silent for ttl_ms loses its values."""

    def __init__(self, n: int, ttl_ms: int | None):
        self.n, self.ttl = n, ttl_ms

    def init(self, handle) -> None:
        self.held = handle.getValueState("held", "us array<long>, event_id array<long>, value array<double>", self.ttl)
        self.reference = handle.getValueState("reference", "value array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        heap = list(zip(*self.held.get(), strict=True)) if self.held.exists() else []
        base = list(self.reference.get()[0]) if self.reference.exists() else []
        heapq.heapify(heap)
        had = len(base)
        for frame in rows:
            base += frame.loc[frame["frozen"], "value"].tolist()
            own = frame[~frame["frozen"]]
            for row in zip(own["us"].tolist(), own["event_id"].tolist(), own["value"].tolist(), strict=True):
                if len(heap) < self.n:
                    heapq.heappush(heap, row)
                elif row > heap[0]:
                    heapq.heapreplace(heap, row)
        if len(base) > had:
            self.reference.update((base,))
        if not heap:
            return
        self.held.update(tuple([x[i] for x in heap] for i in range(3)))
        d, p = ks_arrays(np.array([x[2] for x in heap]), np.array(base))
        yield pd.DataFrame({"key": [key[0]], "n": [len(heap)], "d": [d], "p": [p], "drift": [d > D_LIMIT and p < P_LIMIT and len(heap) > MIN_ROWS]})

    def close(self) -> None:
        pass


def drift_state(stream: DataFrame, reference: DataFrame, n: int = WINDOW, ttl_ms: int | None = None) -> DataFrame:
    """(key, n, d, p, drift) at each trigger: the last n values of a key by event time against its reference.

    State is a heap of at most n values a key by (ts, event_id), so triggers may bring rows in any
    order, and the key's reference. A null event_id counts as the smallest. reference: a stream of
    (key, value), a bounded sample of each key, that ends with the first trigger; it never passes the
    driver. With ttl_ms triggers without rows go on for ever, as its clock does: not for availableNow.
    Needs the state store of state_store().
    """
    finite = lambda rows: rows.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    value = F.col("value").cast("double").alias("value")
    rows = finite(stream).where("ts is not null").select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.coalesce(F.col("event_id").cast("long"), F.lit(-(1 << 62))).alias("event_id"), value, F.lit(False).alias("frozen"))
    base = finite(reference).select("key", F.lit(0).cast("long").alias("us"), F.lit(0).cast("long").alias("event_id"), value, F.lit(True).alias("frozen"))
    return rows.unionByName(base).groupBy("key").transformWithStateInPandas(LastValues(n, ttl_ms), "key string, n long, d double, p double, drift boolean", "update", "none" if ttl_ms is None else "processingTime")


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in the store that timers and maps need, and all their progress reports."""
    now = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.numRecentProgressUpdates": "10000"}
    before = {k: spark.conf.get(k, None) for k in now}
    for k, v in now.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def publish(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink whose folder holds each batch once: a batch is written aside, then named batch=<id>.

    A repeated batch finds its name taken and is left alone; one that was cut off is written anew.
    """

    def write(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        name = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        done, aside = name(f"{path}/batch={batch}"), f"{path}/_aside/{batch}"
        files = done.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(done):
            df.write.mode("overwrite").parquet(aside)
            if not files.rename(name(aside), done):
                raise OSError(f"{aside} could not be named {done}")

    return write


def latest(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """The last published row of each key, without its batch number."""
    rows = spark.read.parquet(path)
    kept = [c for c in rows.columns if c not in (*by, "batch")]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*kept), "batch").alias("r")).select(*by, *[F.col("r")[c].alias(c) for c in kept])


def drained(stream: DataFrame, path: str, mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None) -> dict[str, int]:
    """Run a stream over everything available and stop; (batches, rows, late) it saw.

    path: folder of the output (parquet files, or what sink makes of each batch) and of the checkpoint.
    late: rows that came behind the watermark and were dropped.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    query = (writer.foreachBatch(sink) if sink else writer.format("parquet").option("path", f"{path}/out")).start()
    query.awaitTermination()
    seen = query.recentProgress
    return {"batches": len(seen), "rows": sum(p.numInputRows for p in seen), "late": sum(o.numRowsDroppedByWatermark for p in seen for o in p.stateOperators)}
