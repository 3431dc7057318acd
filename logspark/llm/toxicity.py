"""Toxicity by a weighted finite-state pattern grammar.

Small transducers over word classes are stated as tables of arcs: insult and threat mark hits,
negation, reported speech and target tell what a hit stands under (the target may also follow
it). compose() makes one transducer of them, whose states are reachable tuples of theirs; a
text is run through it once. Hits weigh what the lexicon (whole words and word beginnings, log
odds learned from labels) or the threat class gives them. What is scored are the matched
clauses' hits by their final tags: insults, insults with a target, threats with a target,
negated and reported hits. A threat word without a target matches nothing. A logistic layer
over these sums, fitted to the labels and drawn towards PRIOR, gives the score, so patterns
that no label shows still have the grammar's weight.

Nulls and empty texts: no clause matches, the score is that of a text without matches. Null
labels don't train; a doc_id with several labels is toxic if one of them says so. Repeated rows:
each is scored. Whole texts of any length are read. No labels: the lexicon is empty and PRIOR
holds. No rows: no result rows. Equal lexicon weights need no order: the greatest one counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import crc_mod_column, pick, pieces, saved

# Closed word classes of the grammar.
NEGATION = "not never no nobody isn't aren't wasn't don't nicht kein keine nunca jamás ne pas jamais"
REPORTED = "said says called calls quoted quote wrote told claimed reported sagte dijo dit"
TARGET = "you your you're they them he she him her people du ihr sie tú usted ustedes tu vous toi"
THREAT = "kill hurt destroy beat shoot stab burn punish töten matar tuer"

#: Symbols: negation, reported speech, target, threat, insult, any other word, end of a clause.
N, R, T, H, I, O, END = "NRTHIO."
SYMBOLS = (N, R, T, H, I, O, END)
CLASSES = {w: symbol for symbol, words in ((N, NEGATION), (R, REPORTED), (T, TARGET), (H, THREAT)) for w in words.split()}
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
TOKEN = re.compile(WORD.pattern + r"|[.!?;:,\n]")
#: A word's beginnings that may enter the lexicon.
STEMS = (4, 5, 6)
#: Likelihood ratio (G squared) from which a lexicon entry is kept.
EVIDENCE = 18.0
#: Labelled documents that train the model at most (in expectation): a sample by hash of the id, small enough to broadcast.
LABELS = 400_000
#: Words that a negation, and a target before or behind a hit, reach over.
NEGATION_REACH, TARGET_REACH = 3, 4
#: What the threat class weighs without a lexicon.
THREAT_WEIGHT = 3.0
FEATURES = ("insult", "insult_target", "threat_target", "negated", "reported", "rate")
#: Logistic weights (bias first) that the fit is drawn towards.
PRIOR = (-4.0, 1.0, 1.0, 2.5, 0.0, 0.0, 0.5)
#: Words whose symbols a worker remembers.
REMEMBERED = 300_000


@dataclass(frozen=True)
class Transducer:
    """arcs[state][symbol] = (next state, tags put out); state 0 is the start."""

    arcs: tuple[dict[str, tuple[int, frozenset[str]]], ...]


def marks(symbol: str, tag: str) -> Transducer:
    """Puts out tag at each symbol."""
    return Transducer(({s: (0, frozenset([tag] if s == symbol else [])) for s in SYMBOLS},))


def under(symbol: str, tag: str, reach: int | None) -> Transducer:
    """Puts out tag at a hit (threat or insult) up to reach words behind the symbol, or anywhere behind it in the clause."""
    top = 1 if reach is None else reach

    def arc(state: int, s: str) -> tuple[int, frozenset[str]]:
        left = 0 if s == END else top if s == symbol else state if reach is None else max(0, state - 1)
        return left, frozenset([tag] if state and s in (H, I) else [])

    return Transducer(tuple({s: arc(state, s) for s in SYMBOLS} for state in range(top + 1)))


def followed(symbol: str, tag: str, reach: int) -> Transducer:
    """Puts out tag at the first symbol up to reach words behind a hit."""

    def arc(state: int, s: str) -> tuple[int, frozenset[str]]:
        left = 0 if s in (END, symbol) else reach if s in (H, I) else max(0, state - 1)
        return left, frozenset([tag] if state and s == symbol else [])

    return Transducer(tuple({s: arc(state, s) for s in SYMBOLS} for state in range(reach + 1)))


def compose(*machines: Transducer) -> Transducer:
    """One transducer that runs all machines at once: its states are the reachable tuples of theirs, its tags theirs together."""
    start = (0,) * len(machines)
    number, todo, arcs = {start: 0}, [start], []
    for at in todo:  # grows while it is read
        row = {}
        for s in SYMBOLS:
            steps = [m.arcs[q][s] for m, q in zip(machines, at, strict=True)]
            to = tuple(q for q, _ in steps)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row[s] = (number[to], frozenset().union(*[tags for _, tags in steps]))
        arcs.append(row)
    return Transducer(tuple(arcs))


GRAMMAR = compose(
    marks(I, "insult"),
    marks(H, "threat"),
    under(N, "negated", NEGATION_REACH),
    under(R, "reported", None),
    under(T, "target", TARGET_REACH),
    followed(T, "then_target", TARGET_REACH),
)


def run(machine: Transducer, symbols: list[tuple[str, float]]) -> list[tuple[frozenset[str], float]]:
    """Tags and weight of each hit; a target that follows counts for the latest hit. symbols: (symbol, weight)."""
    state, hits = 0, []
    for s, weight in symbols:
        state, tags = machine.arcs[state][s]
        if s in (H, I):
            hits.append((tags, weight))
        elif "then_target" in tags:
            hits[-1] = (hits[-1][0] | {"target"}, hits[-1][1])
    return hits


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, bad, good): in how many toxic and other documents (toxic 1/0) a word or word beginning occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            terms = list(seen[0].keys() | seen[1].keys())
            made = pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "bad": pa.array([seen[1][t] for t in terms], pa.int64()), "good": pa.array([seen[0][t] for t in terms], pa.int64())})
            seen[0].clear(), seen[1].clear()
            return made

        for batch in pieces(batches):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = set(WORD.findall((text or "").lower()))
                terms = {f"={w}" for w in words}
                for n in STEMS:
                    terms.update([w[:n] for w in words if len(w) > n])
                seen[toxic].update(terms)
            if len(seen[0]) + len(seen[1]) > 300_000:
                yield out()
        yield out()

    counted = pick(docs, "text", "toxic").mapInArrow(count, "term string, bad long, good long")
    return counted.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def lexicon(counts: DataFrame, bad_docs: int, good_docs: int) -> dict[str, float]:
    """Terms whose toxic share stands out by EVIDENCE, with log odds as weight: words of a sample of about LABELS documents at most."""
    if not bad_docs or not good_docs:
        return {}
    p = bad_docs / (bad_docs + good_docs)
    n, k = F.col("bad") + F.col("good"), F.col("bad")
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    g2 = 2 * (part(k.cast("double"), n * p) + part(F.col("good").cast("double"), n * (1 - p)))
    weight = F.log((k + 0.5) / (bad_docs + 1.0)) - F.log((F.col("good") + 0.5) / (good_docs + 1.0))
    kept = counts.where((k > n * p) & (weight > math.log(8.0))).select("term", weight.alias("w"), g2.alias("g2")).where(F.col("g2") >= EVIDENCE)
    return {r.term: r.w for r in kept.select("term", "w").collect()}


class Symbols(dict):
    """(symbol, weight) of each token, found once and remembered."""

    def __init__(self, entries: dict[str, float]):
        super().__init__()
        self.entries = entries

    def __missing__(self, token: str) -> tuple[str, float]:
        if len(self) >= REMEMBERED:
            self.clear()
        weight = self.entries.get("=" + token, 0.0)
        for n in STEMS:
            if len(token) > n:
                weight = max(weight, self.entries.get(token[:n], 0.0))
        symbol = CLASSES.get(token) or (END if not token[0].isalpha() else I if weight else O)
        self[token] = out = (symbol, THREAT_WEIGHT + weight if symbol == H else weight)
        return out


def clause_weights(text: str, symbols: Symbols) -> list[float]:
    """Sums of a text's hits, by what they stand under (FEATURES)."""
    sums = [0.0] * len(FEATURES)
    tokens = TOKEN.findall(text.lower())
    read = [symbols[t] for t in tokens]
    if not any(s in (H, I) for s in {s for s, _ in set(read)}):
        return sums
    for tags, weight in run(GRAMMAR, read):
        if "threat" in tags and "target" not in tags:
            continue
        if "negated" in tags:
            sums[3] += weight
        elif "reported" in tags:
            sums[4] += weight
        elif "threat" in tags:
            sums[2] += weight
        else:
            sums[0] += weight
            sums[1] += weight * ("target" in tags)
    if any(sums):
        sums[5] = 100.0 * (sums[0] + sums[2]) / max(20, sum(s != END for s, _ in read))
    return sums


def matched(docs: DataFrame, entries: dict[str, float], *keep: str) -> DataFrame:
    """The kept columns and FEATURES of each row."""
    handle = docs.sparkSession.sparkContext.broadcast(entries)  # words of a bounded sample
    fields = pick(docs, *keep).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{n} double" for n in FEATURES)])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Symbols(handle.value)
        for batch in pieces(batches):
            rows = np.array([clause_weights(t or "", symbols) for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(rows[:, i]) for i in range(len(FEATURES)))], names=[*keep, *FEATURES])

    return pick(docs, *keep, "text").mapInArrow(match, schema) if "text" not in keep else pick(docs, *keep).mapInArrow(match, schema)


def _inputs() -> list:
    """The logistic layer's inputs: bias and the logarithms of the clause sums."""
    return [F.lit(1.0), *[F.log1p(F.col(n)) for n in FEATURES]]


def fit_logistic(rows: DataFrame, steps: int = 8, ridge: float = 0.5) -> list[float]:
    """Newton's method towards PRIOR; each step is one aggregate of gradient and Hessian sums over rows with toxic 0/1."""
    x, m = _inputs(), len(FEATURES) + 1
    prior = np.array(PRIOR)
    beta = prior.copy()
    for _ in range(steps):
        z = sum((F.lit(float(b)) * c for b, c in zip(beta, x, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        sums = [F.sum((F.col("toxic") - p) * c) for c in x] + [F.sum(p * (1 - p) * x[i] * x[j]) for i in range(m) for j in range(i, m)]
        got = [v or 0.0 for v in rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
        hessian, k = np.zeros((m, m)), m
        for i in range(m):
            for j in range(i, m):
                hessian[i, j] = hessian[j, i] = got[k]
                k += 1
        step = np.linalg.solve(hessian + ridge * np.eye(m), np.array(got[:m]) - ridge * (beta - prior))
        beta = beta + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-4:
            break
    return [float(b) for b in beta]


def probability(beta: list[float]):
    return 1 / (1 + F.exp(-sum((F.lit(b) * c for b, c in zip(beta, _inputs(), strict=True)), F.lit(0.0))))


def fit(labelled: DataFrame) -> tuple[dict[str, float], list[float]]:
    """Lexicon and logistic weights from rows (text, toxic)."""
    rows = pick(labelled.where(F.col("toxic").isin(0, 1)), "text", "toxic")
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    entries = lexicon(term_counts(rows), n.get(1, 0), n.get(0, 0))
    return entries, fit_logistic(saved(matched(rows, entries, "toxic"), "toxicity-fit"))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of labelled documents outside the held-out fold (crc32 of doc_id mod 4 is 2), LABELS in expectation at most."""
    told = pick(labels, "doc_id", "toxic").where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    told = told.where(crc_mod_column(F.col("doc_id"), 4) != 2)
    share = min(1.0, LABELS / max(1, told.count()))
    told = told.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_003)) < share * 1_000_003)
    return pick(docs, "doc_id", "text").where(crc_mod_column(F.col("doc_id"), 4) != 2).join(F.broadcast(told), "doc_id").select("text", "toxic")


def score(docs: DataFrame, entries: dict[str, float], beta: list[float], *keep: str) -> DataFrame:
    return matched(docs, entries, *keep).select(*keep, F.round(probability(beta), 9).alias("score"), *FEATURES)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    entries, beta = fit(training_rows(docs, labels))
    out = score(docs, entries, beta, "doc_id")
    return out.select("doc_id", (crc_mod_column(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), *FEATURES[:5])


def clean_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model doesn't predict toxic; learned from this stage's input and labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    entries, beta = fit(training_rows(docs, labels))
    names = [c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in docs.columns]
    return score(docs, entries, beta, *names).where(F.col("score") < 0.3).select(*names)
