"""The pattern grammar against the patterns' definitions, and held-out labels."""

import itertools
import random

from pyspark.sql import functions as F

from logspark.llm import toxicity as t
from tests.llm.test_ops import docs_of, sentence


def by_definition(symbols):
    """Tags of each hit, from places instead of states."""
    hits, out = [i for i, s in enumerate(symbols) if s in (t.H, t.I)], []
    for i in hits:
        clause = max([j + 1 for j in range(i) if symbols[j] == t.END], default=0)
        tags = {"threat" if symbols[i] == t.H else "insult"}
        near = lambda s, reach, clause=clause, i=i: any(symbols[j] == s for j in range(max(clause, i - reach), i))
        tags |= {"negated"} if near(t.N, t.NEGATION_REACH) else set()
        tags |= {"reported"} if near(t.R, len(symbols)) else set()
        tags |= {"target"} if near(t.T, t.TARGET_REACH) else set()
        out.append(tags)
    for j, s in enumerate(symbols):
        # A target counts for the latest hit before it, once, inside the clause.
        last = max([i for i in hits if i < j], default=None)
        if s == t.T and last is not None and j - last <= t.TARGET_REACH and not {t.END, t.T} & set(symbols[last + 1 : j]):
            out[hits.index(last)].add("target")
    return out


def test_every_short_string_of_symbols():
    assert len(t.GRAMMAR.arcs) > 20
    for n in range(6):
        for symbols in itertools.product(t.SYMBOLS, repeat=n):
            got = t.run(t.GRAMMAR, [(s, 1.0) for s in symbols])
            assert [set(tags) for tags, _ in got] == by_definition(symbols), symbols


def test_long_strings_of_symbols():
    rng = random.Random(5)
    for _ in range(3000):
        symbols = rng.choices(t.SYMBOLS, k=rng.randrange(6, 25))
        assert [set(tags) for tags, _ in t.run(t.GRAMMAR, [(s, 1.0) for s in symbols])] == by_definition(symbols)


def test_composition_runs_its_parts():
    a, b = t.marks(t.I, "one"), t.under(t.N, "two", 2)
    both = t.compose(a, b)
    for symbols in itertools.product(t.SYMBOLS, repeat=4):
        state, x, y = 0, 0, 0
        for s in symbols:
            state, tags = both.arcs[state][s]
            x, left = a.arcs[x][s]
            y, right = b.arcs[y][s]
            assert tags == left | right


def test_clause_weights():
    weights = lambda text, entries=None: dict(zip(t.FEATURES, t.clause_weights(text, t.Symbols(entries or {})), strict=True))
    assert weights("I will kill you")["threat_target"] == t.THREAT_WEIGHT
    assert not any(weights("time to kill a process, you").values()) and not any(weights("").values())
    assert weights("You FOOL", {"=fool": 3.0})["insult_target"] == 3.0 and weights("fools", {"fool": 2.0})["insult"] == 2.0
    assert weights("you are not a fool", {"=fool": 3.0})["negated"] == 3.0 and weights("he said: fool", {"=fool": 3.0})["insult"] == 3.0
    assert weights("he said fool", {"=fool": 3.0})["reported"] == 3.0


def test_held_out(spark):
    rng = random.Random(9)
    rows, toxic = [], {}
    for i in range(300):
        words = sentence(rng, 40).split()
        toxic[i] = int(i % 5 == 0)
        if toxic[i]:
            for w in rng.sample(["idiotex", "scumlon", "idiotar"], 2):
                words.insert(rng.randrange(40), w)
        rows.append(" ".join(words))
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, 1, x) for i, x in toxic.items()] + [(None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    entries, beta = t.fit(t.training_rows(docs, labels))
    assert all((r.score >= 0.3) == bool(toxic[r.doc_id]) for r in t.score(docs, entries, beta, "doc_id").collect())
    threat, plain = (r.score for r in t.score(docs_of(spark, ["i will kill you", ""]), entries, beta, "doc_id").orderBy("doc_id").collect())
    assert threat >= 0.3 > plain
    none = t.fit(docs.withColumn("toxic", F.lit(None).cast("int")))
    assert len(t.score(docs_of(spark, [None, ""]), *none, "doc_id").collect()) == 2
