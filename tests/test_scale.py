"""Forms for hot keys, large groups and streams against plain ones."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from logspark.operators import drift, ranking, selective, sequence
from logspark.streaming import streams


@pytest.mark.parametrize("descending", [True, False])
def test_a_constant_score_is_cut_by_its_tie(spark, descending):
    rows = [("f", i, 1 + i % 3, 0.5 if i % 4 else i / 3000) for i in range(3000)] + [(None, -1, 5, 0.5)]
    df = spark.createDataFrame(rows, "fold string, row_id long, y long, v double")
    one = ranking.running(df, ["fold"], "v", {"a": "y"}, tie="row_id", descending=descending)
    cut = ranking.running(df, ["fold"], "v", {"a": "y"}, tie="row_id", descending=descending, spread=0)
    assert sorted(map(str, one.collect())) == sorted(map(str, cut.select(*one.columns).collect()))
    cuts = df.approxQuantile("v", [i / ranking.RANGES for i in range(1, ranking.RANGES)], 0.0005)
    parts = df.withColumn("p", ranking._tie_part(df, "v", "row_id", cuts, descending)).where("v = 0.5").groupBy("p").count()
    assert parts.agg(F.max("count")).first()[0] < 100


def test_first_rows_of_hot_keys(spark):
    rows = spark.range(6000).select(F.when(F.col("id") < 5000, "hot").otherwise(F.lit("cold")).alias("k"), (F.col("id") * 7919 % 6007).alias("v"))
    for n in (3, 1500):
        got = ranking.first_rows(rows, ["k"], [F.desc("v")], n).collect()
        for k, own in (("hot", range(5000)), ("cold", range(5000, 6000))):
            assert sorted((r.v for r in got if r.k == k), reverse=True) == sorted((i * 7919 % 6007 for i in own), reverse=True)[:n]
    plan = sequence.sessions(rows.select(F.lit("s").alias("source"), F.col("k").alias("group_id"), F.col("v").alias("line_no"), F.lit("x").alias("text")), limit=5)
    assert "WindowGroupLimit" in plan._jdf.queryExecution().toString() and plan.where("size(lines) = 5").count() == 2


def test_harmonic_and_candidates(spark):
    ns = [0, 1, 2, 64, 65, 1000, 12345]
    got = [r.h for r in spark.createDataFrame([(n,) for n in ns], "n long").select(selective.harmonic(F.col("n")).alias("h")).collect()]
    assert all(abs(h - math.fsum(1 / j for j in range(1, n + 1))) < 1e-13 for n, h in zip(ns, got, strict=True))
    rng = np.random.default_rng(4)
    y, p = (rng.random(200) < 0.5).astype(int), np.round(rng.random(200), 2)
    rows = spark.createDataFrame([("f", i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], "fold string, row_id long, y_true int, p1 double")
    conf, wrong = np.maximum(p, 1 - p), (p > 1 - p).astype(int) != y
    for taus in ([0.2, 0.55, 0.6, 0.75, 0.9, 2.0], [0.99]):
        fits = [t for t in sorted({min(1, max(0.5, t)) for t in taus}) if (conf >= t).any() and wrong[conf >= t].mean() <= 0.5]
        r = selective.tau_for_budget(rows, 0.5, taus).first()
        assert (r.tau, r.feasible) == ((fits[0], True) if fits else (1.0, False))
        if fits:
            assert abs(r.risk - wrong[conf >= r.tau].mean()) < 1e-12 and abs(r.coverage - (conf >= r.tau).mean()) < 1e-12


@pytest.mark.parametrize("spread", [None, 0])
def test_drift_against_plain_arrays(spark, monkeypatch, spread):
    if spread is not None:
        monkeypatch.setattr(drift, "running", lambda *a, **k: ranking.running(*a, spread=0, **k))
    rng = np.random.default_rng(6)
    values = {(k, w): np.round(rng.normal(w / 4, 1, 5 + 20 * w), 1) for k, w in itertools.product("ab", range(4))}
    values["c", 0] = np.array([1.0])
    values["a", 9] = np.array([np.nan])
    ref = {k: np.round(rng.normal(0.2, 1, 60), 1) for k in "ab"}
    rows = spark.createDataFrame([(k, w, float(v)) for (k, w), x in values.items() for v in x] + [(None, 1, 1.0)], "key string, w long, value double")
    base = spark.createDataFrame([(k, float(v)) for k, x in ref.items() for v in x], "key string, value double")
    got = {(r.key, r.w): r for r in drift.against(rows, base, ["key", "w"], ["key"]).collect()}
    assert got.keys() == values.keys()
    for (k, w), x in values.items():
        x = x[~np.isnan(x)]
        d, p = streams.ks_arrays(x, ref.get(k, np.zeros(0)))
        r = got[k, w]
        assert abs(r.d - d) < 1e-12 and abs(r.p - p) < 1e-8 and (r.n_a, r.n_b) == (len(x), len(ref.get(k, ()))), (k, w)
    five = {(r.key, r.w): r for r in drift.five_numbers(rows, ["key", "w"]).collect()}
    assert five.keys() == values.keys() - {("a", 9)}
    for at, r in five.items():
        x = values[at]
        assert np.allclose(r[2:], [len(x), x.min(), *np.quantile(x, [0.25, 0.5, 0.75]), x.max(), x.mean()])


def test_drift_state_keeps_the_last_values(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [("k" if i % 5 else "j", i, 1_000 - i // 3, float(v)) for i, v in enumerate(rng.random(900))] + [("j", 1000, 5, None)]
    df = spark.createDataFrame(rows, "key string, event_id long, ts long, value double")
    df.repartition(5).write.parquet(f"{tmp_path}/in")
    ref = {"k": list(rng.random(50))}
    spark.createDataFrame([(k, float(v)) for k, x in ref.items() for v in x], "key string, value double").write.parquet(f"{tmp_path}/base")
    base = spark.readStream.schema("key string, value double").parquet(f"{tmp_path}/base")
    out = streams.drift_state(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), base, n=40)
    with streams.state_store(spark):
        streams.drained(out, str(tmp_path), "update", streams.publish(f"{tmp_path}/out"))
    got = {r.key: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    for k in "kj":
        own = sorted((t, i, v) for key, i, t, v in rows if key == k and v is not None)[-40:]
        d, p = streams.ks_arrays(np.array([v for *_, v in own]), np.array(ref.get(k, [])))
        assert got[k].n == 40 and abs(got[k].d - d) < 1e-12 and abs(got[k].p - p) < 1e-12
