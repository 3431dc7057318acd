"""Whole jobs on small logs, streams against batch, and the driver contract."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from logspark.operators import splits
from logspark.plans import jobs
from logspark.streaming import streams


def test_prepare_and_hold_out(spark, tmp_path):
    rng = random.Random(1)
    for system in ("one", "two"):
        (tmp_path / system).mkdir()
        lines = [f"{i:06d} 10.0.0.{i % 5} {system} step {rng.choice(['open', 'close', 'panic'])} blk_{i % 12}" for i in range(120)]
        (tmp_path / system / "x.log").write_text("\n".join(lines) + "\n")
        (tmp_path / f"{system}.csv").write_text("BlockId,Label\n" + "".join(f"blk_{i},{'Anomaly' if i % 4 == 0 else 'Normal'}\n" for i in range(12)))
        jobs.prepare_sessions(spark, str(tmp_path / system), str(tmp_path / f"{system}.csv"), system, "block", str(tmp_path / "out" / system))
    one, two = (spark.read.parquet(str(tmp_path / "out" / s / "sequences")) for s in ("one", "two"))
    seqs = one.unionByName(two)
    rows = seqs.collect()
    assert len(rows) == 24 and all(len(r.lines) == 10 for r in rows) and sum(r.label for r in rows) == 6
    assert all("<BLK>" in x and "<IP>" in x for r in rows for x in r.lines)
    unique = seqs.withColumn("group_id", F.concat("source", F.lit(":"), "group_id"))

    def trainer(train, test):
        assert train.select("source").distinct().count() == 1 and test.agg(F.max("label")).first()[0] == 0
        return test.select("group_id", F.lit(0).alias("y_pred"), F.lit(0.5).alias("p_anomaly"))

    jobs.held_out(spark, unique, trainer, str(tmp_path / "loso"), n_bootstrap=100)
    panel = {r.fold: r for r in spark.read.json(str(tmp_path / "loso" / "metrics")).collect()}
    assert set(panel) == {"one", "two"} and panel["one"].recall == 0 and panel["one"].auc_roc == 0.5
    out = jobs.calibrate(spark, str(tmp_path / "loso" / "predictions" / "fold=one"), str(tmp_path / "cal"))
    assert "temperature" in out


def test_windows_job(spark, tmp_path):
    (tmp_path / "w.log").write_text("".join(f"{'-' if i != 33 else 'E'} event {i}\n" for i in range(100)))
    jobs.prepare_windows(spark, str(tmp_path / "w.log"), "bgl", str(tmp_path / "o"), 20, 10)
    got = spark.read.parquet(str(tmp_path / "o" / "sequences")).collect()
    assert len(got) == 9 and all(len(r.lines) == 20 for r in got) and sum(r.label for r in got) == 2


def test_score_and_ablation_jobs(spark, tmp_path):
    (tmp_path / "r.json").write_text("\n".join(json.dumps({"request_id": "q", "id": i, "lines": [f"panic {i}"]}) for i in ("a", "b", "")))
    jobs.score(spark, str(tmp_path / "r.json"), str(tmp_path / "s"), 0.7)
    scored = {r.id: r.p_anomaly for r in spark.read.json(str(tmp_path / "s" / "scored")).collect()}
    assert scored == {i: min(1.0, hashlib.sha256(f"panic {i}".encode()).digest()[0] / 255 + 0.15) for i in "ab"}
    assert spark.read.json(str(tmp_path / "s" / "rejected")).count() == 1
    cells = spark.createDataFrame([("x", c, s, "m", s + (9.0 if c == "up" else 0.0)) for c in ("base", "up") for s in range(8)], "axis string, condition string, seed long, metric string, value double")
    r = jobs.ablation(cells, "base", str(tmp_path / "abl")).first()
    assert r.condition == "up" and r.significant and r.band == "large"


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"user {i} at 10.0.0.{i}") for i in range(40)], "id long, text string")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    streams.drained(streams.scored(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), 0.7), f"{tmp_path}/sink")
    assert sorted(spark.read.parquet(f"{tmp_path}/sink/out").collect()) == sorted(streams.scored(rows, 0.7).collect())


def test_folds(spark):
    df = spark.createDataFrame([(s, f"{s}{i}", i % 2, "train" if i < 6 else "test") for s in "abc" for i in range(10)], "source string, group_id string, label int, split string")
    assert {(r.target, r.role): r.n for r in splits.compose(df).collect()} == {(s, role): 20 if role == "train" else 10 for s in "abc" for role in ("train", "test")}
    assert {(r.target, r.role): r.n for r in splits.compose(df, use_splits=True).collect()} == {(s, role): 12 if role == "train" else 4 for s in "abc" for role in ("train", "test")}
    try:
        splits.folds(df, ["z"])
        raise AssertionError
    except ValueError:
        pass


def test_driver_contract(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 86
    assert entry.entry(spark).columns == ["source", "masked", "cnt"]
