"""Sources that lose no row, digests of large files, windows cut inside blocks, scaling of several classes."""

import hashlib
import json
import random
import resource

import numpy as np
import pytest
from pyspark.sql import functions as F

from logspark.operators import calibration, sequence, stats
from logspark.plans import jobs
from logspark.sources import logs


def test_the_last_label_is_that_of_the_last_file(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.csv").write_text("BlockId,Label\nx,Anomaly\n")
    (tmp_path / "l" / "b.csv").write_text("".join(f"y{i},Normal\n" for i in range(5_000)) + "x,Normal\n")
    (tmp_path / "l" / "c.csv").write_text("y7,Anomaly\n")
    got = {r.group_id: r.label for r in logs.read_labels(spark, str(tmp_path / "l")).collect()}
    assert got["x"] == 0 and got["y7"] == 1 and len(got) == 5_001


def test_rejects_and_records_are_all_lines(spark, tmp_path):
    good = [json.dumps({"group_id": f"g{i}", "y_true": i % 2, "y_pred": 1, "p_anomaly": i / 50}) for i in range(40)]
    bad = ["{", '{"group_id": "b", "y_true": "x", "y_pred": 0, "p_anomaly": 0.1}', '{"group_id": "b", "y_true": 1, "y_pred": 0}', "[1, 2]", '"text"', "null"]
    lines = good[:10] + ["", bad[0], "  "] + good[10:20] + bad[1:]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.json").write_text("\n".join(lines) + "\n")
    (tmp_path / "p" / "b.json").write_text("\n".join(good[20:] + [bad[2]]))
    records, rejects = logs.read_records(spark, str(tmp_path / "p"), logs.PREDICTION, ("y_true", "y_pred", "p_anomaly"))
    assert sorted(r.group_id for r in records.collect()) == sorted(f"g{i}" for i in range(40))
    got = {(r.path.rpartition("/")[2], r.line_no): (r.reason, r.value) for r in rejects.collect()}
    assert {k: v for k, (_, v) in got.items()} == {("a.json", i): x for i, x in enumerate(lines) if x in bad} | {("b.json", 20): bad[2]}
    assert got["b.json", 20][0] == "no p_anomaly" and got["a.json", 11][0] == "not a record"
    with pytest.raises(ValueError, match="line"):
        logs.read_predictions(spark, str(tmp_path / "p"))
    assert logs.read_predictions(spark, str(tmp_path / "p"), rejects=f"{tmp_path}/r").count() == 40
    assert spark.read.json(f"{tmp_path}/r").count() == 7
    assert logs.read_predictions(spark, str(tmp_path / "p"), strict=False).count() == 40


def test_score_job_counts_its_rejects(spark, tmp_path):
    rows = [json.dumps({"request_id": "r", "id": str(i), "lines": ["a", "b"]}) for i in range(5)] + [json.dumps({"request_id": "r", "id": "", "lines": ["x"]}), "broken {"]
    (tmp_path / "in.json").write_text("\n".join(rows))
    jobs.score(spark, str(tmp_path / "in.json"), str(tmp_path / "out"), 0.6)
    assert {r.what: r.n for r in spark.read.json(f"{tmp_path}/out/counts").collect()} == {"scored": 5, "rejected": 1, "rejected_lines": 1}


def test_a_file_over_two_gigabytes_is_streamed(spark, tmp_path):
    big, n = tmp_path / "big #1.bin", (1 << 31) + 12_345
    with big.open("wb") as f:
        f.write(b"start")
        f.truncate(n)
    (tmp_path / "small.bin").write_bytes(b"abc")
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    digest, size = logs.sha256_of(f"file:{tmp_path}/big #1.bin")
    assert size == n and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000
    want = spark.createDataFrame([("big #1.bin", digest), ("small.bin", "0"), ("gone", "1")], "name string, sha256 string")
    got = {r.name: (r.status, r.sha256) for r in logs.verify_checksums(logs.files_in(spark, str(tmp_path)), want).collect()}
    assert got == {"big #1.bin": ("ok", digest), "small.bin": ("mismatch", hashlib.sha256(b"abc").hexdigest()), "gone": ("missing", "1")}


def test_published_results(spark, tmp_path):
    (tmp_path / "p.yaml").write_text("baselines:\n  - method: A\n    year: 2024\n    per_fold:\n      x: {f1: 0.949}\n      y: {f1: null}\n    macro_f1: 0.952\n  - method: B\n    macro_f1: 0.80\n  - method: C\n    per_fold: {x: {f1: many}}\n    macro_f1: null\n")
    table = logs.published_table(spark, logs.read_published(str(tmp_path / "p.yaml")))
    ours = spark.createDataFrame([("own", "x", 0.5), ("own", "y", 0.7)], "method string, fold string, f1 double")
    got = {r.method: (r.x, r.y, r.macro) for r in stats.head_to_head(ours, table, ["x", "y"]).collect()}
    assert got == {"own": ("50.00", "70.00", "60.00"), "A": ("94.90", "—", "95.20"), "B": ("—", "—", "80.00"), "C": ("—", "—", "—")}


@pytest.mark.parametrize("window, stride, pad", [(6, 4, True), (5, 9, False), (100, 20, True), (7, 7, True), (1, 1, False), (30, 7, True)])
def test_windows_cut_inside_blocks(spark, monkeypatch, window, stride, pad):
    monkeypatch.setattr(sequence, "SPANS", 3)
    rng = random.Random(window)
    rows = [("a", i, int(rng.random() < 0.05), f"a{i}") for i in range(431)] + [("b", i, 0, f"b{i}") for i in range(3)]
    rows += [("c", i, 0, None if i == 5 else f"c{i}") for i in range(200) if not 40 < i < 70] + [("c", 9, 1, "again")]
    lines = spark.createDataFrame(rows, "source string, line_no long, label int, text string").withColumn("starts", F.lit(1))
    want = {}
    for source in "abc":
        own = sorted((r for r in rows if r[0] == source), key=lambda r: (r[1], r[3] is not None, r[3] or ""))
        total = own[-1][1] + 1
        starts = [0] if total < window else list(range(0, total - window + 1, stride))
        if pad and starts[-1] + window < total:
            starts.append(total - window)
        for k, s in enumerate(starts):
            inside = [r for r in own if s <= r[1] < s + window]
            if inside:
                want[f"{source}_{k}"] = (max(r[2] for r in inside), [r[3] for r in inside])
    got = {r.group_id: (r.label, list(r.lines)) for r in sequence.window_lines(lines, window, stride, pad).collect()}
    assert got == want


def test_lines_are_shuffled_about_once(spark):
    lines = spark.range(20_000).select(F.lit("s").alias("source"), F.col("id").alias("line_no"), F.lit(0).alias("label"), F.lit("x").alias("text"))
    held = sequence.haloed(lines, 100, 20).agg(F.sum(F.size("arr"))).first()[0]
    assert held < 1.06 * 20_000


@pytest.mark.parametrize("k", [2, 3, 5])
def test_weights_of_several_classes(spark, k):
    rng = np.random.default_rng(k)
    z, true = rng.normal(0, 2, (600, k)), rng.uniform(0.3, 1.5, k)
    p = np.exp(z * true)
    y = np.array([rng.choice(k, p=q / q.sum()) for q in p])
    rows = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(y, z, strict=True)] + [(0, None), (None, [0.0] * k)], "y_true int, z array<double>")
    w = calibration.fit_classes(rows, k)

    def nll(v):
        s = z * v
        return float((np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(600), y]).mean())

    for i in range(k):
        for step in (1e-4, -1e-4):
            assert nll(np.array(w)) <= nll(np.array(w) + step * np.eye(k)[i]) + 1e-12
    assert np.abs(np.array(w) - true).max() < 0.5
    got = rows.where("z is not null").limit(5).select("z", calibration.classes(F.col("z"), w).alias("p")).collect()
    for r in got:
        e = np.exp(np.array(r.z) * np.array(w))
        assert np.allclose(r.p, e / e.sum())


def test_far_apart_classes_end(spark):
    rows = spark.createDataFrame([(i % 3, [5.0 * (i % 3 == j) for j in range(3)]) for i in range(60)], "y_true int, z array<double>")
    assert all(np.isfinite(calibration.fit_classes(rows, 3)))
    with pytest.raises(ValueError, match="no rows"):
        calibration.fit_classes(rows.limit(0), 3)


def test_checksums_of_tables_in_several_files(spark, tmp_path):
    for name, data in {"one.parquet": b"abc", "two.parquet/part-0.parquet": b"d", "two.parquet/k=1/part-0.parquet": b"e", "three.parquet/part-0.parquet": b"f"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    two = sha(f"k=1/part-0.parquet {sha(b'e')}\npart-0.parquet {sha(b'd')}".encode())
    want = spark.createDataFrame([("one.parquet", sha(b"abc")), ("two.parquet", two), ("gone.parquet", "0")], "name string, sha256 string")
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        got = {r.name: r.status for r in logs.verify_checksums(logs.files_in(spark, root, "*.parquet"), want, root).collect()}
        assert got == {"one.parquet": "ok", "two.parquet": "ok", "three.parquet": "new", "gone.parquet": "missing"}
    (tmp_path / "two.parquet" / "part-0.parquet").write_bytes(b"x")
    got = {r.name: r.status for r in logs.verify_checksums(logs.files_in(spark, root, "*.parquet"), want, root).collect()}
    assert got["two.parquet"] == "mismatch" and got["one.parquet"] == "ok"
