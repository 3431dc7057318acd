"""Forms for large groups and merged tables against plain ones."""

import itertools
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from logspark.functions.columns import assign_split
from logspark.operators import leakage, ranking, requests, sequence, sketches, splits, stats


@pytest.mark.parametrize("alternative", ["two-sided", "greater", "less"])
def test_signed_rank_of_large_and_small_groups(spark, alternative):
    rng = np.random.default_rng(8)
    groups = {("x", str(n), "m"): np.round(rng.normal(0.1, 1, n), 1) for n in (1, 2, 20, 25, 26, 27, 400)}
    groups |= {("x", "zeros", "m"): np.zeros(9), ("x", "few", "m"): np.array([0.0] * 60 + [1.0, -2.0, 3.0]), (None, "same", "m"): np.full(40, 2.0)}
    rows = [(*k, float(v), 0.0) for k, d in groups.items() for v in d]
    got = {tuple(r)[:3]: r for r in stats.signed_rank(spark.createDataFrame(rows, "axis string, condition string, metric string, a double, b double"), alternative).collect()}
    assert set(got) == set(groups)
    for k, d in groups.items():
        s, p = stats.signed_rank_test(d, alternative) if len(d) > 1 else (0.0, 1.0)
        assert got[k].n == len(d) and abs(got[k].statistic - s) < 1e-9 and abs(got[k].p - p) < 1e-12, k


def test_a_large_group_is_not_gathered(spark):
    pairs = spark.range(200_000).select(F.lit("x").alias("axis"), F.lit("c").alias("condition"), F.lit("m").alias("metric"), (F.col("id") % 1_000 / 100).alias("a"), F.lit(4.9).alias("b"))
    r = stats.signed_rank(pairs).first()
    d = np.repeat(np.arange(1_000) / 100 - 4.9, 200)
    d = d[d != 0]
    ranks = pd.Series(np.abs(d)).rank().to_numpy()
    assert r.n == 200_000 and math.isclose(r.statistic, min(ranks[d > 0].sum(), ranks[d < 0].sum()), rel_tol=1e-9)


def test_validate_counts_equal_rows(spark):
    ok, long = ["a"], ["b" * 5_000]
    rows = [("r1", "1", ok), ("r1", "1", ok), ("r1", "2", long), ("r1", None, ok), (None, "1", ok), (None, "2", []), ("r3", "", ok), ("r4", "1", None)]
    rows += [("big", str(i), ok) for i in range(65)] + [("lines", str(i), ["x"] * 256) for i in range(17)]
    got = sorted(((r.request_id, r.id, r.reason) for r in requests.validate(spark.createDataFrame(rows, "request_id string, id string, lines array<string>").withColumn("c", F.lit(1))).collect()), key=str)
    want = [("r1", "1", "duplicate id")] * 2 + [("r1", "2", "line bytes"), ("r1", None, "id length"), (None, "1", None), (None, "2", "line count"), ("r3", "", "id length"), ("r4", "1", "line count")]
    want += [("big", str(i), "sequence count") for i in range(65)] + [("lines", str(i), "total lines") for i in range(17)]
    assert got == sorted(want, key=str)


def test_string_ties_are_cut(spark):
    rows = [("f", f"group-é-{i:05d}", 1 + i % 3, 0.5) for i in range(3_000)] + [("f", None, 7, 0.5), ("f", "z", 1, 0.9)]
    df = spark.createDataFrame(rows, "fold string, row_id string, y long, v double")
    one = ranking.running(df, ["fold"], "v", {"a": "y"}, tie="row_id")
    cut = ranking.running(df, ["fold"], "v", {"a": "y"}, tie="row_id", spread=0)
    assert sorted(map(str, one.collect())) == sorted(map(str, cut.select(*one.columns).collect()))
    cuts = df.approxQuantile("v", [i / ranking.RANGES for i in range(1, ranking.RANGES)], 0.0005)
    assert df.withColumn("p", ranking._tie_part(df, "v", "row_id", cuts, True)).where("v = 0.5").groupBy("p").count().agg(F.max("count")).first()[0] < 100


def test_a_grid_is_spread_over_tasks(spark):
    cells = spark.createDataFrame([("x", f"c{i}", s) for i, s in itertools.product(range(8), range(10))], "axis string, condition string, seed int")

    def runner(row):
        from pyspark import TaskContext

        return {"condition": row["condition"], "task": TaskContext.get().partitionId()}

    assert stats.run_grid(cells, runner, "condition string, task int").select("task").distinct().count() > 30
    with pytest.raises(ValueError, match="twice"):
        stats.run_grid(cells.union(cells.limit(1)), runner, "condition string, task int")


def test_sketches_merge_into_folds(spark):
    rows = spark.range(6_000).select(F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"), (F.col("id") * 7919 % 997).alias("n_lines"), F.array((F.col("id") % 2_500).cast("string"), F.concat(F.lit("x"), F.col("id") % 40), F.lit(None)).alias("lines"))
    made = sketches.sketched(rows)
    assert made.count() == 6
    got = {(r.target, r.role): r for r in sketches.of_folds(made).withColumns({"q": sketches.quantile(0.95), "d": sketches.distinct()}).collect()}
    for target in ("s0", "s1", "s2"):
        for role, part in (("test", rows.where(F.col("source") == target)), ("train", rows.where(F.col("source") != target))):
            r = got[target, role]
            lengths = np.sort([x.n_lines for x in part.select("n_lines").collect()])
            exact = part.select(F.explode("lines").alias("t")).agg(F.count_distinct("t")).first()[0]
            rank = np.searchsorted(lengths, r.q, side="left") / len(lengths), np.searchsorted(lengths, r.q, side="right") / len(lengths)
            assert rank[0] - sketches.RANK_ERROR <= 0.95 <= rank[1] + sketches.RANK_ERROR and abs(r.d / exact - 1) <= sketches.COUNT_ERROR and r.n == len(lengths)
    none = sketches.sketched(rows.limit(0))
    assert sketches.of_folds(none).count() == 0


def test_bucketed_tables_join_without_a_shuffle(spark):
    seqs = spark.range(3_000).select(F.lit("s").alias("source"), F.col("id").cast("string").alias("group_id"), F.array(F.lit("x")).alias("lines"))
    labels = spark.range(0, 3_000, 7).select(F.col("id").cast("string").alias("group_id"), F.lit(1).alias("label"))
    out = sequence.labelled(sequence.bucketed(seqs, "t_seqs", 6), sequence.bucketed(labels, "t_labels", 6))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert out.where("label = 1").count() == labels.count() and out.count() == 3_000


def test_manifest_is_one_document_and_byte_stable(spark, tmp_path):
    rows = [(s, f'g"{i}\n', int(i % 9 == 0)) for s in ("b", "a", "é") for i in range(300)] + [("a", "g\\", 1), ("a", "g\\", 0)]
    df = spark.createDataFrame(rows, "source string, group_id string, label int").withColumn("split", assign_split(F.col("source"), F.col("group_id")))
    made = []
    for i, order in enumerate((df, df.repartition(7).orderBy(F.rand(3)))):
        splits.write_manifest(order, f"{tmp_path}/{i}")
        made.append(b"".join(splits.manifest_bytes(spark, f"{tmp_path}/{i}")))
    assert made[0] == made[1]
    got = json.loads(made[0])
    assert got["groups"] == {s: {r.group_id: r.split for r in df.where(F.col("source") == s).collect()} for s in ("a", "b", "é")}
    assert list(got["groups"]) == ["a", "b", "é"] and list(got["groups"]["a"]) == sorted(got["groups"]["a"])
    assert sum(x["n"] for x in got["stats"]["a"].values()) == 302 and got["ratios"] == {"test": 0.1, "train": 0.8, "val": 0.1}
    splits.write_manifest(df.limit(0), f"{tmp_path}/none")
    assert json.loads(b"".join(splits.manifest_bytes(spark, f"{tmp_path}/none")))["groups"] == {}


def test_group_samples_are_the_first_shared_ids(spark):
    rows = [("a", f"g{i:03d}") for i in range(60)] + [("b", f"g{i:03d}") for i in range(20, 90)] + [("c", "own"), ("c", None), ("a", None)]
    got = leakage.group_samples(spark.createDataFrame(rows, "source string, group_id string")).collect()
    assert sorted((r.target, r.group_id) for r in got) == [(s, f"g{i:03d}") for s in "ab" for i in range(20, 36)]
