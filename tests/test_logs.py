"""Single operators on hand-made values, and the numpy or brute-force forms of those that SQL can't state."""

import hashlib
import itertools
import json
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logspark.functions import columns as col
from logspark.functions.mask import RULES, collapse, mask, mask_count
from logspark.operators import bootstrap, calibration, curves, drift, leakage, metrics, ood, ranking, requests, selective, sequence, splits, stats
from logspark.sources import logs
from logspark.streaming import streams


def pred(spark, y, score, fold="f"):
    rows = [(fold, i, a, int(s >= 0.5), float(s)) for i, (a, s) in enumerate(zip(y, score, strict=True))]
    return spark.createDataFrame(rows, "fold string, row_id long, y_true int, y_pred int, p_anomaly double")


def test_masks(spark):
    cases = {
        "2005-06-03-15.42.50.675872 up": "<TS> up",
        "081109 203518 x": "<TS> x",
        "on 2020-01-02 at 10:11:12,5": "on <DATE> at <TIME>",
        "id 123e4567-e89b-12d3-a456-426614174000": "id <UUID>",
        "blk_-1608999687919862906 ok": "<BLK> ok",
        "10.250.19.102:54106 10.0.0.1": "<IP>:<PORT> <IP>",
        "fe80:0:0:1 http://a.b/c?d=1 0xdeadBEEF deadbeef01": "<IP> <URL> <HEX> <HEX>",
        "/usr/lib/x.so C:\\a b\\c 42": "<PATH> <PATH>",
        "  a\t\tb  7 \r\n": "a b <NUM>",
        "": "",
        None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.m for r in df.select("t", mask(F.col("t")).alias("m")).collect()}
    assert got == cases
    line = spark.createDataFrame([("A <IP> 5",)], "t string")
    assert line.select(mask(F.col("t"), lowercase=True).alias("x"), collapse(F.col("t")).alias("y"), mask_count(F.col("t")).alias("z")).first()[:] == ("a <ip> <num>", "A <NUM> 5", 1)
    own = line.select(mask(F.col("t"), rules=[("A", "<X>")]).alias("x")).first().x
    assert own == "<X> <IP> 5" and len(RULES) == 15


def test_split_hash(spark):
    groups = [f"grp_{i:04d}" for i in range(128)]
    df = spark.createDataFrame([("hdfs", g) for g in groups], "source string, group_id string")
    got = {r.group_id: r.split for r in splits.with_split(df).collect()}
    for g in groups:
        at = int.from_bytes(hashlib.sha256(f"hdfs::{g}".encode()).digest()[:8], "big") % 1_000_000
        assert got[g] == ("train" if at < 800_000 else "val" if at < 900_000 else "test")
    with pytest.raises(ValueError):
        col.assign_split(F.lit("a"), F.lit("b"), 0.5, 0.1, 0.1)
    stats_ = splits.split_stats(splits.with_split(df.limit(1).withColumn("label", F.lit(1)))).collect()
    assert len(stats_) == 3 and sum(r.n for r in stats_) == 1
    text = splits.manifest_json(splits.with_split(df)).first().json
    assert json.loads(text) == got and list(json.loads(text)) == groups


def test_lines_and_sessions(spark, tmp_path):
    for f in range(3):
        (tmp_path / "logs").mkdir(exist_ok=True)
        (tmp_path / "logs" / f"{f}.log").write_text("".join(f"{'-' if i % 10 else 'FATAL'} line {f} {i}\n" for i in range(50)))
    raw = logs.read_lines(spark, str(tmp_path / "logs"), "sys").orderBy("line_no").collect()
    assert [r.value.split(" line ")[1] for r in raw] == [f"{f} {i}" for f in range(3) for i in range(50)]
    assert [r.line_no for r in raw] == list(range(150))
    df = spark.createDataFrame([("- ok text",), ("E",), ("",), (" lead",), ("x " + "y" * 5000,)], "value string")
    got = [(r.label, r.text) for r in logs.parse_prefixed(df).collect()]
    assert got == [(0, "ok text"), (1, "E"), (1, "lead"), (1, "y" * 4096)]
    hd = spark.createDataFrame([("a blk_-12 b blk_9",), ("none",), ("[instance:  i-1 ] z",)], "value string")
    assert [r.group_id for r in logs.parse_sessions(hd, "block").collect()] == ["blk_-12"]
    assert [r.group_id for r in logs.parse_sessions(hd, "instance").collect()] == ["i-1"]
    (tmp_path / "h.csv").write_text("x,Anomaly\ninstanceid,Anomaly\n")
    assert {r.group_id: r.label for r in logs.read_labels(spark, str(tmp_path / "h.csv")).collect()} == {"x": 1, "instanceid": 1}
    assert logs.read_labels(spark, f"{tmp_path}/none.csv").count() == 0
    (tmp_path / "l.csv").write_text("BlockId,Label\nb1,Anomaly\nb2,Normal\nb1,normal\nlonely\nb3,ANOMALY\n")
    assert {r.group_id: r.label for r in logs.read_labels(spark, str(tmp_path / "l.csv")).collect()} == {"b1": 0, "b2": 0, "b3": 1}
    lines = spark.createDataFrame([("s", g, i, f"{g}{i}") for g in "ab" for i in (2, 0, 1)], "source string, group_id string, line_no long, text string")
    seqs = {r.group_id: (r.lines, r.label) for r in sequence.sessions(lines, logs.read_labels(spark, None), limit=2).collect()}
    assert seqs == {"a": (["a0", "a1"], 0), "b": (["b0", "b1"], 0)}


@pytest.mark.parametrize(("total", "window", "stride", "pad", "want"), [(10, 4, 2, False, [(0, 4), (2, 6), (4, 8), (6, 10)]), (0, 5, 1, False, []), (3, 10, 2, False, [(0, 3)]), (11, 4, 3, False, [(0, 4), (3, 7), (6, 10)]), (11, 4, 3, True, [(0, 4), (3, 7), (6, 10), (7, 11)])])
def test_window_specs(spark, total, window, stride, pad, want):
    df = spark.createDataFrame([("s", total)], "source string, total long")
    assert [(r.start, r.end) for r in sequence.window_specs(df, window, stride, pad).orderBy("k").collect()] == want


def test_windows_of_lines(spark):
    lines = spark.createDataFrame([("s", i, int(i == 7), f"t{i}") for i in range(23)], "source string, line_no long, label int, text string")
    got = {r.k: (r.start, r.end, r.n_lines, r.label) for r in sequence.sliding(lines, 6, 4).collect()}
    assert got == {k: (4 * k, 4 * k + 6, 6, int(4 * k <= 7 < 4 * k + 6)) for k in range(5)}
    whole = {r.group_id: (r.label, r.lines) for r in sequence.window_lines(lines, 6, 4).collect()}
    assert whole == {f"s_{k}": (int(4 * k <= 7 < 4 * k + 6), [f"t{i}" for i in range(4 * k, 4 * k + 6)]) for k in range(5)}


def test_leakage(spark):
    rows = [("a", f"x{i}") for i in range(30)] + [("b", f"x{i}") for i in range(26)] + [("c", "own"), ("c", None)]
    lines = spark.createDataFrame(rows, "source string, text string")
    groups = spark.createDataFrame([("a", "g1"), ("b", "g1"), ("c", "g2")], "source string, group_id string")
    got = {r.target: r for r in leakage.audit(lines, groups).collect()}
    assert (got["a"].shared_lines, got["a"].shared_groups, got["a"].clean, got["a"].train_unique) == (26, 1, False, 27)
    assert got["c"].clean and got["c"].test_unique == 1
    assert leakage.samples(lines).where("target = 'a'").count() == 16
    assert leakage.gate(leakage.audit(lines, groups), strict=False) == ["a", "b"]
    with pytest.raises(ValueError):
        leakage.gate(leakage.audit(lines, groups))


def test_distances(spark):
    lines = spark.createDataFrame([("a", "alpha beta gamma"), ("b", "alpha beta gamma"), ("c", "x y z"), ("d", "one")], "source string, text string")
    got = {(r.a, r.b): (r.jaccard, r.cosine) for r in ood.distances(lines).collect()}
    assert got["a", "b"] == (0, 0) and got["a", "c"] == (1, 1) and got["a", "d"] == (1, 1) and len(got) == 12


def test_small_metrics(spark):
    c = metrics.confusion(spark.createDataFrame([("f", i, a, b, 0.5) for i, (a, b) in enumerate(zip([1, 1, 0, 0, 1], [1, 0, 0, 1, 1]))], "fold string, row_id long, y_true int, y_pred int, p_anomaly double")).first()
    assert (c.tp, c.fp, c.tn, c.fn) == (2, 1, 1, 1)
    p = pred(spark, [1, 1, 0, 0], [0.9, 0.8, 0.2, 0.1])
    assert metrics.auc_roc(p).first().auc_roc == 1 and metrics.auc_pr(p).first().auc_pr == 1
    assert metrics.auc_roc(pred(spark, [1, 1, 0, 0], [0.1, 0.2, 0.8, 0.9])).first().auc_roc == 0
    one = metrics.panel(pred(spark, [0, 0], [0.4, 0.6])).first()
    assert one.auc_roc is None and one.auc_pr is None and one.fpr_at_95_recall is None and one.precision == 0
    assert metrics.fpr_at_recall(pred(spark, [1] * 4 + [0] * 5, [0.9] * 4 + [0.1] * 5), 1.0).first().fpr_at_recall == 0
    assert curves.roc(pred(spark, [0, 0], [0.1, 0.2])).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=2, max_size=40))
def test_ranges_agree_with_one_window(spark, rows):
    df = spark.createDataFrame([("f", i, y, s / 6) for i, (y, s) in enumerate(rows)], "fold string, row_id long, y long, v double")
    one = ranking.running(df, ["fold"], "v", {"a": "y"}, tie="row_id")
    cut = ranking.running(df, ["fold"], "v", {"a": "y"}, tie="row_id", spread=0)
    assert sorted(one.collect()) == sorted(cut.select(*one.columns).collect())


def test_calibration(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(0, 3, 600)
    y = (rng.random(600) < 1 / (1 + np.exp(-z / 2.2))).astype(int)
    df = spark.createDataFrame([("f", i, int(a), float(1 / (1 + math.exp(-b)))) for i, (a, b) in enumerate(zip(y, z))], "fold string, row_id long, y_true int, p_anomaly double")
    rows = calibration.with_logits(df)
    t, before, after = calibration.fit_temperature(rows)
    nll = lambda t: float(np.mean(np.log1p(np.exp(-np.where(y == 1, z, -z) / t))))
    grid = np.linspace(0.5, 6, 5000)
    assert abs(t - grid[np.argmin([nll(g) for g in grid])]) < 0.01 and after < before and abs(before - nll(1)) < 1e-6
    a, b = calibration.fit_platt(rows)
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    p = 1 / (1 + np.exp(-(a * z + b)))
    assert abs(((target - p) * z).sum()) < 1e-4 and abs((target - p).sum()) < 1e-4
    w0, w1 = calibration.fit_vector(rows)
    assert abs(w0) < 1e-6 and abs(((y - 1 / (1 + np.exp(-w1 * z))) * z).sum()) < 1e-3
    out = calibration.calibrate(df)
    assert out["ece"] <= out["base_ece"] and out["temperature"] > 1
    assert calibration.bins(df.withColumnRenamed("p_anomaly", "p1")).count() == 15
    with pytest.raises(ValueError):
        calibration.calibrate(df.limit(3))


def test_selective(spark):
    perfect = pred(spark, [i % 2 for i in range(40)], [0.51 + i / 100 if i % 2 else 0.49 - i / 100 for i in range(40)]).withColumnRenamed("p_anomaly", "p1")
    r = selective.tau_for_budget(perfect, 0.01).first()
    assert r.feasible and r.risk == 0 and r.coverage == 1
    wrong = pred(spark, [0] * 10, [0.99] * 10).withColumnRenamed("p_anomaly", "p1")
    r = selective.tau_for_budget(wrong, 0.05).first()
    assert (r.feasible, r.tau, r.risk, r.coverage) == (False, 1.0, None, 0.0)
    assert selective.tau_for_budget(perfect, 0.01, [0.2, 0.7, 0.8]).first().tau == 0.5
    oracle = pred(spark, [1] * 140 + [0] * 60, [0.999 - i / 1000 for i in range(200)]).withColumnRenamed("p_anomaly", "p1")
    assert abs(selective.aurc(oracle).first().excess) < 1e-12
    with pytest.raises(ValueError):
        selective.losses(oracle, fn_cost=0)


def test_bootstrap(spark):
    rng = np.random.default_rng(5)
    y = (rng.random(300) < 0.3).astype(int)
    s = np.clip(0.5 + 0.25 * (2 * y - 1) * rng.random(300) + rng.normal(0, 0.2, 300), 0, 1)
    p = pred(spark, y.tolist(), s.tolist())
    got = {r.metric: r for r in bootstrap.intervals(p, n=400).collect()}
    panel = metrics.panel(p).first()
    for m in metrics.PANEL:
        assert abs(got[m].point - panel[m]) < 1e-9 and got[m].low <= got[m].point <= got[m].high and got[m].n_bootstrap == 400
    pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rec = [np.mean(s[rng.choice(pos, len(pos))] >= 0.5) for _ in range(2000)]
    assert abs(np.quantile(rec, 0.025) - got["recall"].low) < 0.03 and abs(np.quantile(rec, 0.975) - got["recall"].high) < 0.03 and len(neg)
    assert sorted(bootstrap.intervals(p, n=100).collect()) == sorted(bootstrap.intervals(p.repartition(3), n=100).collect())
    single = bootstrap.intervals(pred(spark, [0, 0, 0], [0.1, 0.2, 0.9]), n=100).where("metric = 'fpr'").first()
    assert (single.low, single.high, single.n_bootstrap) == (single.point, single.point, 0)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(-6, 6), min_size=1, max_size=10), st.sampled_from(["two-sided", "greater", "less"]))
def test_signed_rank_enumerated(diffs, alternative):
    d = np.array([x / 2 for x in diffs if x])
    s, p = stats.signed_rank_test(np.array(diffs) / 2, alternative)
    if not len(d):
        assert (s, p) == (0, 1)
        return
    ranks = pd.Series(np.abs(d)).rank().to_numpy()
    plus = ranks[d > 0].sum()
    sums = [sum(r for r, k in zip(ranks, signs) if k) for signs in itertools.product([0, 1], repeat=len(d))]
    le, ge = np.mean([x <= plus + 1e-9 for x in sums]), np.mean([x >= plus - 1e-9 for x in sums])
    assert abs(p - {"two-sided": min(1, 2 * min(le, ge)), "greater": ge, "less": le}[alternative]) < 1e-9


def test_statistics(spark):
    t = spark.createDataFrame([("g", f"t{i}", p) for i, p in enumerate([0.001, 0.04, 0.06, 0.5])], "g string, id string, p double")
    got = stats.holm(t, ["g"], ["id"]).orderBy("id").collect()
    assert [r.rejected for r in got] == [True, False, False, False]
    assert [round(r.adjusted, 6) for r in got] == [0.004, 0.12, 0.12, 0.5]
    cells = spark.createDataFrame([("x", c, s, "m", v) for c, vs in {"base": [1.0, 2.0, 3.0], "up": [2.0, 3.0, 4.0], "gap": [None, 5.0, 6.0]}.items() for s, v in enumerate(vs)], "axis string, condition string, seed long, metric string, value double")
    d = {r.condition: (round(r.delta, 4), r.band) for r in stats.cliffs_delta(cells, "base").collect()}
    assert d == {"up": (0.5556, "large"), "gap": (1.0, "large")}
    assert {r.condition: (r.n, r.delta_mean) for r in stats.compare(cells, "base").collect()} == {"up": (3, 1.0), "gap": (2, 4.0)}
    assert stats.paired(cells, "base", by_seed=True).where("condition = 'gap'").agg(F.avg(F.col("a") - F.col("b"))).first()[0] == 3.0
    with pytest.raises(ValueError):
        stats.run_grid(cells.union(cells), dict, "axis string")
    tail = spark.createDataFrame([("a", i, 10.0 - i) for i in range(30)] + [("b", i, float(i)) for i in range(30)], "k string, step long, value double")
    assert {r.k: r.falling for r in stats.loss_tail(tail, ["k"]).collect()} == {"a": True, "b": False}


def test_requests(spark):
    rows = [("r", "a", ["x"]), ("r", "b", []), ("r", "", ["x"]), ("r", "c", ["é" * 2049]), ("r", "d", ["x"]), ("r", "d", ["y"]), ("s", "e", None)]
    df = spark.createDataFrame(rows, "request_id string, id string, lines array<string>")
    got = sorted((r.id, r.reason or "") for r in requests.validate(df).collect())
    assert got == [("", "id length"), ("a", ""), ("b", "line count"), ("c", "line bytes"), ("d", "duplicate id"), ("d", "duplicate id"), ("e", "line count")]
    scored = requests.score_job(df, 0.7).collect()
    want = hashlib.sha256(b"x").digest()[0] / 255
    assert [(r.id, r.p_anomaly) for r in scored] == [("a", want)]
    seqs = spark.createDataFrame([("g", ["a", "b"])], "group_id string, lines array<string>")
    assert requests.score_with(seqs, lambda: lambda x: [len(s) / 10 for s in x]).first().p_anomaly == 0.2
    ties = spark.createDataFrame([(0.5,)], "p double").select(col.selective(F.col("p"), 0.5).alias("a"), col.serving(F.col("p"), 0.5).alias("b")).first()
    assert (ties.a, ties.b) == ("normal", "anomaly")


def test_drift(spark):
    rng = np.random.default_rng(2)
    cases = {"same": (np.linspace(0, 1, 200),) * 2, "apart": (np.zeros(100), np.ones(100)), "drift": (rng.random(300), 0.9 + 0.1 * rng.random(200)), "empty": (np.zeros(0), np.ones(3))}
    rows = [(k, s, float(v)) for k, (a, b) in cases.items() for s, x in (("a", a), ("b", b)) for v in x] + [("same", "a", float("nan"))]
    got = {r.key: (r.d, r.p) for r in drift.ks(spark.createDataFrame(rows, "key string, side string, value double"), ["key"]).collect()}
    for k, (a, b) in cases.items():
        d, p = streams.ks_arrays(a, b)
        assert abs(got[k][0] - d) < 1e-12 and abs(got[k][1] - p) < 1e-8
    assert got["same"] == (0, 1) and got["apart"][0] == 1 and got["apart"][1] < 1e-3


def test_sinks(spark, tmp_path):
    t = spark.createDataFrame([("a", 0.5), ("b", None)], "k string, v double").coalesce(1)
    logs.write_csv(t, f"{tmp_path}/csv")
    text = next((tmp_path / "csv").glob("*.csv")).read_text()
    assert re.sub('"', "", text) == "k,v\na,0.500000\nb,\n"
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.bin").write_bytes(b"abc")
    files = spark.read.format("binaryFile").load(f"{tmp_path}/f")
    want = spark.createDataFrame([("x.bin", hashlib.sha256(b"abc").hexdigest()), ("gone", "0")], "name string, sha256 string")
    assert {r.name: r.status for r in logs.verify_checksums(files, want).collect()} == {"x.bin": "ok", "gone": "missing"}
    assert {r.status for r in logs.verify_checksums(files, want.where("name = 'gone'")).collect()} == {"new", "missing"}
    pub = logs.published_table(spark, [{"method": "m", "year": 2020, "per_fold": {"a": {"f1": 0.5}, "b": None}, "macro_f1": None}])
    assert sorted((r.fold, r.f1) for r in pub.collect()) == [("a", 0.5), ("b", None)]


def test_bootstrap_of_close_scores_and_many_blocks(spark, monkeypatch):
    y = [1, 0, 1, 0, 0, 1, 1, 0, 0, 0] * 6
    close = pred(spark, y, [0.3 + (1e-9 if v else 0) + i * 1e-12 for i, v in enumerate(y)])
    got = {r.metric: r for r in bootstrap.intervals(close, n=100).collect()}
    assert got["auc_roc"][2:5] == (1.0, 1.0, 1.0) and abs(got["auc_pr"].point - 1) < 1e-9 and got["fpr_at_95_recall"].high == 0.0
    rng = np.random.default_rng(8)
    mixed = pred(spark, y, np.round(rng.random(60), 2).tolist())
    whole = {r.metric: r for r in bootstrap.intervals(mixed, n=1000).collect()}
    monkeypatch.setattr(bootstrap, "BLOCK", 7)
    parts = {r.metric: r for r in bootstrap.intervals(mixed, n=1000).collect()}
    for m in metrics.PANEL:
        assert abs(whole[m].point - parts[m].point) < 1e-12
        assert abs(whole[m].low - parts[m].low) < 0.06 and abs(whole[m].high - parts[m].high) < 0.06, m


def test_conditions_without_values_stay(spark):
    rows = [("x", c, s, "m", v) for c, vs in {"base": [1.0, 2.0, 3.0], "up": [2.0, 3.0, 5.0], "none": [None, float("nan")]}.items() for s, v in enumerate(vs)]
    cells = spark.createDataFrame(rows, "axis string, condition string, seed long, metric string, value double")
    assert {r.condition: (r.n, r.delta_mean) for r in stats.compare(cells, "base").collect()} == {"up": (3, 4 / 3), "none": (0, 0.0)}
    assert {r.condition: (round(r.delta, 4), r.band) for r in stats.cliffs_delta(cells, "base").collect()} == {"up": (0.5556, "large"), "none": (0.0, "negligible")}
    tested = stats.holm(stats.tests(cells, "base"), ["axis", "metric"], ["condition"]).collect()
    assert {r.condition: (r.n, r.statistic, r.p) for r in tested} == {"up": (3, 0.0, 0.25), "none": (0, 0.0, 1.0)}
    assert {r.condition: r.adjusted for r in tested} == {"up": 0.5, "none": 1.0}
    one = {r.condition: (r.n, r.statistic, r.p) for r in stats.signed_rank(stats.against(cells, 1.0), "greater").collect()}
    assert one["up"] == (3, 6.0, 0.125)


def test_coverage_of_any_stride(spark):
    for total, window, stride, pad in itertools.product((1, 5, 20), (1, 3, 7), (1, 3, 10), (False, True)):
        df = spark.createDataFrame([("s", i) for i in range(total)], "source string, line_no long")
        specs = sequence.window_specs(df.groupBy("source").agg((F.max("line_no") + 1).alias("total")), window, stride, pad).collect()
        inside = {i for r in specs for i in range(r.start, r.end)}
        assert sequence.uncovered(df, window, stride, pad).first()[1:] == (len(inside), total - len(inside)), (total, window, stride, pad)
    with pytest.raises(ValueError):
        sequence.uncovered(df, 0, 1)
    huge = spark.createDataFrame([("s", 10**12)], "source string, total long")
    assert sequence.window_specs(huge, 100, 10**7).agg(F.count("*"), F.max("start")).first()[:] == (10**5, (10**5 - 1) * 10**7)


def test_calibration_reports_held_out_rows(spark):
    rng = np.random.default_rng(2)
    y = (rng.random(600) < 0.4).astype(int)
    z = 3.0 * rng.normal(1.2 * (2 * y - 1), 1.5)
    rows = pred(spark, y.tolist(), (1 / (1 + np.exp(-z))).tolist())
    got = calibration.calibrate(rows, budget=0.1)
    held = calibration.parts(rows).where("part = 'held_out'").withColumn("p1", calibration.probability(got))
    want = selective.aurc(held).first()
    assert got["temperature"] > 1.3 and got["aurc"] == want.aurc and got["ece"] <= got["base_ece"]
    p = np.array([r.p1 for r in held.collect()])
    wrong = np.array([(r.p1 > 0.5) != (r.y_true == 1) for r in held.collect()])
    taken = np.maximum(p, 1 - p) >= got["tau"]
    assert abs(wrong[taken].mean() - got["risk"]) < 1e-12 and got["risk"] <= 0.1 and abs(taken.mean() - got["coverage"]) < 1e-12
    three = spark.range(1).select(*[p.alias(f"p{i}") for i, p in enumerate(col.softmax([F.lit(1.0), F.lit(2.0), F.lit(4.0)], 2.0))]).first()
    e = np.exp(np.array([0.5, 1.0, 2.0]))
    assert np.allclose(three[:], e / e.sum()) and abs(spark.range(1).select(calibration.vector(F.lit(1.0), F.lit(2.0), 0.5, 1.5)).first()[0] - 1 / (1 + np.exp(-2.5))) < 1e-12


def test_masks_equal_every_rule_on_every_line(spark):
    from logspark.functions import mask as m

    rng = random.Random(12)
    bits = ["deadbeef", "DEADBEEFcafe", "deadbee", "abcdefab-abcd-abcd-abcd-abcdefabcdef", "a:b:c", "fe::1", "http://x", "/a/b", "a/b/c", "//", "C:\\x y\\z", "0x", "0xf", "٣٤", "١٢٣٤/٠١/٠٢", "x9", "9", "blk_-1", "1.2.3.4:5", "word", "é", "<IP>", " ", "  ", "\t", "\u00a0", "\u2003", "\x1c", "\x85", "\r", "\n", "\r\n", "\x0b"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " ", "-", ":"]) for _ in range(rng.randrange(1, 7))) for _ in range(3_000)] + ["", None, " ", "\n"]
    plain = F.regexp_replace("text", r"[\r\n]+\z", "")
    for pattern, replacement in m.RULES:
        plain = F.regexp_replace(plain, "(?U)" + pattern, replacement)
    plain = F.trim(F.regexp_replace(plain, r"[\t-\r\x1c-\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " "))
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", m.mask(F.col("text")).alias("got"), plain.alias("want"))
    assert rows.where("not got <=> want").collect() == []
    # Prose meets no rule: a line without digits, slashes or colons is left to one pass.
    assert spark.createDataFrame([("no rule has work in prose",)], "text string").where(F.col("text").rlike(m.NEEDED)).count() == 0


def test_ngram_tasks_grow_in_number_with_the_text(spark, monkeypatch):
    rows = spark.createDataFrame([("s", f"a{i} b{i % 50} c") for i in range(2_000)], "source string, text string")
    want = sorted(map(tuple, ood.ngram_counts(rows).collect()))
    seen, saved = [], ood.saved
    monkeypatch.setattr(ood, "TEXT_A_PARTITION", 1_000)
    monkeypatch.setattr(ood, "saved", lambda *a, **k: seen.append(k["partitions"]) or saved(*a, **k))
    assert sorted(map(tuple, ood.ngram_counts(rows).collect())) == want and seen[0] > 20
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4" and ood.ngram_counts(rows.limit(0)).count() == 0


def test_score_job_masks_only_lines_that_need_it(spark):
    lines = ["plain prose here", "at 10.0.0.1:80  twice", "tab\there"]
    rows = spark.createDataFrame([(1, "a", lines)], "request_id long, id string, lines array<string>")
    p = requests.score_job(rows, 0.7).first().p_anomaly
    assert p == spark.createDataFrame([("plain prose here\nat <IP>:<PORT> twice\ntab here",)], "t string").select(col.demo_score(F.col("t"))).first()[0]


def test_busy_lines_are_those_that_masks_or_spaces_change(spark):
    from logspark.functions import mask as m

    # Every character but surrogates, alone in a line: a rule may match it, or it is white space other than U+0020.
    points = spark.range(0x110000).where("id not between 55296 and 57343").select("id", F.concat(F.lit("x"), F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32"), F.lit("z")).alias("t"))
    odd = F.col("t").rlike(f"[{m.ODD_SPACES}]")
    assert points.where(F.col("t").rlike(m.BUSY) != (F.col("t").rlike(m.NEEDED) | odd)).collect() == []
    runs = [("x abcdefab", True), ("ABCDEFabcdef", True), ("abcdefa", False), ("gabcdefa bcdefab", False), ("decade faced", False), ("xéy … 中", False), ("\U0001d7ce", True), ("", False)]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(runs)], "i int, t string").select("i", F.col("t").rlike(m.BUSY).alias("b")).orderBy("i").collect()
    assert [r.b for r in got] == [b for _, b in runs]
    rows = spark.createDataFrame([("<IP> a <TS>",), ("<ip> < b",), ("no mark",), ("",), (None,)], "t string").select(m.collapse(F.col("t")).alias("c"), m.mask_count(F.col("t")).alias("n"))
    assert [tuple(r) for r in rows.collect()] == [("<NUM> a <NUM>", 2), ("<ip> < b", 0), ("no mark", 0), ("", 0), (None, None)]


def test_score_job_reads_lines_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def lines(id):
        read.add(1)
        return ["x" * 5000] if id == "long" else [f"line {id}", "twice  spaced"]

    rows = spark.createDataFrame([("r", "a"), ("r", "b"), ("r", "b"), ("r", "long"), (None, "d")], "request_id string, id string").withColumn("lines", lines("id"))
    got = requests.score_job(rows, 0.7, lambda text: F.length(text) / 100).orderBy("id").collect()
    assert [(r.request_id, r.id, r.p_anomaly) for r in got] == [("r", "a", 0.19), (None, "d", 0.19)]
    assert read.value == 5
