"""Every stage of the pipeline against a brute-force form on its own input."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logspark.llm import decontaminate, mixing, neardup, substring, toxicity
from tests.llm.test_ops import SCHEMA, WORD, brute_substring, lower, sentence, shingles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    texts = [sentence(rng, rng.randrange(70, 140), 3000) for _ in range(240)]
    item, passage = sentence(rng, 30, 3000), sentence(rng, 60, 3000)
    for i in range(0, 240, 8):
        words = texts[i].split()
        for w in rng.sample(["grumblex", "snarkol", "vexidon"], 2):
            words.insert(rng.randrange(len(words)), w)
        texts[i] = " ".join(words)
    for i in (11, 57, 99):
        texts[i] = f"{texts[i]} {item}"
    for i in (13, 61, 101):
        texts[i] = f"{texts[i]}\n{passage}"
    texts[141] = texts[3]
    texts[143] = texts[5] + " tail"
    texts += [None, "", "a few words"]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    d = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, SCHEMA).withColumn("extra", F.lit(1)).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 0 and i < 240)) for i in range(0, 243) if i % 10], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), item


def test_stages(spark, corpus, tmp_path):
    d, item = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = docs.collect()
        kept[name] = {r.doc_id: r.text for r in after}
        if name == "toxicity":
            assert set(before) - set(kept[name]) == set(range(0, 240, 8)) and docs.columns == COLUMNS
        elif name == "near_dedup":
            sets = {i: shingles(t) for i, t in before.items()}
            gone = {b for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
            assert gone == {141, 143} and set(kept[name]) == set(before) - gone and docs.columns == COLUMNS
        elif name == "substring_dedup":
            order = sorted(before)
            want = brute_substring([before[i] for i in order])
            for at, i in enumerate(order):
                n, removed, _ = want[at]
                assert kept[name][i] == before[i] if not removed else len(WORD.findall(kept[name][i])) == n - removed
            assert {i for at, i in enumerate(order) if want[at][1]} == {61, 101} and docs.columns == COLUMNS
        elif name == "decontamination":
            assert set(before) - set(kept[name]) == {i for i, t in before.items() if item in lower(t)} == {11, 57, 99} and docs.columns == COLUMNS
        else:
            assert {r.doc_id for r in after} <= set(before) and [r.position for r in after] == sorted(r.position for r in after)
            taken = sum(r.size for r in after)
            total = sum(len(WORD.findall(t or "")) for t in before.values())
            assert abs(taken - 1.5 * total) < 4 * 150


def test_run_gives_the_stages_rows(spark, corpus):
    d, _ = corpus
    got = corpus_pipeline.run(spark, d)
    assert got.columns == [*COLUMNS, "size", "copy", "position"] and got.count() > 0
    assert neardup.dedup_stage(spark, spark.read.parquet(f"{d}/documents.parquet"), d).count() == 241
    assert toxicity.clean_stage(spark, spark.read.parquet(f"{d}/documents.parquet").limit(0), d).count() == 0


def test_rows_without_doc_id_keep_their_own_result(spark, corpus):
    d, item = corpus
    rng = random.Random(15)
    clean, same = [sentence(rng, 60 + i, 3000) for i in range(6)], sentence(rng, 50, 3000)
    rows = [*[(None, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(clean)], *[(None, same, "en", "s0", 1)] * 3, (None, f"{clean[0]} {item}", "en", "s1", 1), (None, None, "en", None, None), (1, clean[1], "en", "s0", 1), (1, clean[2], "en", "s1", 1), (2, f"a {item}", "en", "s0", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    key = lambda r: (str(r[0]), str(r[1]), str(r[3]))
    kept = decontaminate.clean_stage(spark, docs, d).collect()
    assert sorted(map(key, kept)) == sorted(key(r) for r in rows if item not in (r[1] or ""))
    sized = mixing.sizes(docs).collect()
    assert sorted(r.size for r in sized) == sorted(len(WORD.findall(r[1] or "")) for r in rows)
    planned = mixing.plan(mixing.sizes(docs)).collect()
    got = mixing.mix_stage(spark, docs, d).collect()
    assert len(got) == sum(r.copies for r in planned) and sum(r.size for r in got) == sum(r.taken for r in planned)
    want = collections.Counter((str(r.doc_id), str(r.source), r.size) for r in planned for _ in range(r.copies))
    assert collections.Counter((str(r.doc_id), str(r.source), len(WORD.findall(r.text))) for r in got) == want
    assert {key(r) for r in got} <= {key(r) for r in rows} and any(r.doc_id is None for r in got)


def test_a_mix_of_repeated_rows_takes_what_is_planned(spark, corpus):
    d, _ = corpus
    rng = random.Random(16)
    rows = [(i, sentence(rng, 20 + i), "en", f"s{i % 2}", i) for i in range(12)]
    rows += [(3, "one two", "en", "s1", 1), (3, rows[3][1], "en", "s1", 99), (4, "other source", "en", "s1", 2), (5, None, "en", "s1", None), (6, "x", None, None, 1), (6, "x y", None, None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    planned = {(r.doc_id, r.source): r for r in mixing.plan(mixing.sizes(docs)).collect()}
    got = collections.Counter((r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in mixing.mix_stage(spark, docs, d).collect())
    assert got == {(*k, r.size): r.copies for k, r in planned.items() if r.copies}
    assert sum(n * size for (_, _, size), n in got.items()) == sum(r.taken for r in planned.values())


def test_first_stages_with_repeated_and_missing_ids(spark, corpus):
    d, _ = corpus
    rng = random.Random(18)
    passage, own = sentence(rng, 60, 3000), [sentence(rng, 80 + i, 3000) for i in range(6)]
    toxic = f"{own[5]} grumblex snarkol vexidon {sentence(rng, 30, 3000)}"
    rows = [
        (900, f"{own[0]} {passage}", "en", "s0", 1),
        (901, f"{own[1]} {passage} {own[2]}", "en", "s0", 2),  # the longest text of 901 counts for it
        (901, own[3], None, None, None),
        (902, own[4], "en", "s1", 3),
        (902, own[4], "en", "s1", 3),
        (903, own[4], "en", "s1", 3),  # a copy of 902
        (None, own[4], "en", "s1", 3),
        (None, toxic, "en", "s1", 3),
        (None, None, None, None, None),
        (904, toxic, "en", "s1", 3),
        (905, "", "en", "s1", 0),
        (906, None, "en", "s1", 0),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    learned = spark.read.parquet(f"{d}/documents.parquet").select(*COLUMNS)
    key = lambda r: (str(r[0]), str(r[1]))
    kept = [r for r in toxicity.clean_stage(spark, learned.unionByName(docs), d).collect() if r.doc_id is None or r.doc_id >= 900]
    assert sorted(map(key, kept)) == sorted(key(r) for r in rows if r[1] != toxic)
    left = neardup.dedup_stage(spark, docs, d).collect()
    assert sorted(map(key, left)) == sorted(key(r) for r in rows if r[0] not in (903,))
    cut = substring.cut_stage(spark, docs, d).collect()
    got = collections.defaultdict(list)
    for r in cut:
        got[r.doc_id].append(r.text)
    assert sorted(got[901]) == [f"{own[1]} {own[2]}"] * 2 and got[900] == [f"{own[0]} {passage}"] and 903 not in got and got[902] == [own[4]] * 2
    assert sorted(map(str, got[None])) == sorted(map(str, [own[4], toxic, None])) and got[905] == [""] and got[906] == [None]
