"""License scans: phrases, and an exact set-similarity join of text blocks with templates.

For a statement of n words, a text's blocks are its lines of at most 2 n - 1 words, and of its
paragraphs (lines up to one without words) the windows of 2 n - 1 words that start at every n-th
word. So a wrapped statement lies in a block, wherever its line ends are, and words scattered over
a long line or paragraph don't meet it. A block is taken as its set of words. A template is the set of a license statement's words. A block
meets a template if it holds at least CONTAINMENT of the template's words. The join follows
prefix filtering: the templates' words are ordered by the number of lines of the corpus that
hold them, rarest first; a block that meets a template of n words
holds one of its n - k + 1 rarest words (k: words needed). Blocks post those words with their
place in the order; the pairs are cut by length (k distinct template words in the block) and by
position (the block holds k words from the shared one on), then checked in full.

Null and empty texts: no word, no label. Repeated rows: each is answered, by a number given to
each row. Words of any text length are read. Empty table: no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import pick, pieces, saved

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
CONTAINMENT = 0.9

# The base phrases, and statements by which the licenses name themselves.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "mit": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "gpl-3.0": "licensed under the gnu general public license version 3",
    "gpl-2.0": "licensed under the gnu general public license version 2",
    "lgpl": "licensed under the gnu lesser general public license",
    "agpl": "licensed under the gnu affero general public license",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "cc-by-4.0": "licensed under a creative commons attribution 4 0 international license",
    "cc0": "dedicated to the public domain under cc0 1 0 universal",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "mpl-2.0": "subject to the terms of the mozilla public license v 2 0",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee",
}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate(LOWER))


def phrase_starts(words: list[str], phrase: list[str]) -> list[int]:
    """Places where the phrase's words stand consecutively."""
    found, at = [], -1
    try:
        while True:
            at = words.index(phrase[0], at + 1)
            if words[at : at + len(phrase)] == phrase:
                found.append(at)
    except ValueError:
        return found


def paragraphs(lines: list[list[str]]) -> Iterator[tuple[int, int]]:
    """(start, stop) in words of each run of lines with words."""
    at = start = 0
    for words in [*lines, []]:
        if not words:
            if at > start:
                yield start, at
            start = at
        at += len(words)


def word_blocks(docs: DataFrame, vocabulary: set[str]) -> dict[str, int]:
    """In how many lines of the whole corpus each word of the templates occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in pieces(batches):
            for text in batch.column("text").to_pylist():
                for line in (text or "").split("\n"):
                    seen.update(vocabulary.intersection(words_of(line)))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    counted = pick(docs, "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word: r.n for r in counted.collect()}  # one row a word of the templates


def scan(docs: DataFrame, rank: dict[str, int], prefixes: set[str]) -> DataFrame:
    """Per row: base columns, and the blocks that hold a prefix word, as (start, span, ranked template words).

    span: 0 for a line, else the number of words of the templates that the window is for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = {label: p.split() for label, p in PHRASES.items()}
        ranked = rank.keys()
        spans = sorted({len(t.split()) for t in TEMPLATES.values()})
        for batch in pieces(batches):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words: list[str] = []
                blocks = []
                lines = [words_of(line) for line in (text or "").split("\n")]

                def add(start: int, span: int, own: list[str]) -> None:
                    held = ranked & set(own)
                    if not prefixes.isdisjoint(held):
                        blocks.append({"start": start, "n": len(own), "span": span, "words": sorted(held, key=rank.__getitem__)})

                for own in lines:
                    add(len(words), 0, own)
                    words += own
                for first, last in paragraphs(lines):
                    if prefixes.isdisjoint(words[first:last]):
                        continue
                    for span in spans:
                        for start in range(first, last, span):
                            add(start, span, words[start : min(last, start + 2 * span - 1)])
                starts = {label: phrase_starts(words, p) for label, p in phrases.items()}
                every = [s for found in starts.values() for s in found]
                out.append((doc_id, len(words), len(every), min(every, default=None), max(every, default=None), sorted(k for k, v in starts.items() if v), blocks))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64()), ("span", pa.int64()), ("words", pa.list_(pa.string()))])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base", "blocks"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, blocks array<struct<start:long,n:long,span:long,words:array<string>>>")


def template_index(spark, rank: dict[str, int]) -> tuple[DataFrame, set[str]]:
    """(word, label, place, need, length, template): the templates' prefix words; their number is fixed by TEMPLATES."""
    rows = []
    for label, text in TEMPLATES.items():
        own = sorted(set(text.split()), key=rank.__getitem__)
        need = math.ceil(CONTAINMENT * len(own) - 1e-9)
        rows += [(w, label, i, need, len(text.split()), own) for i, w in enumerate(own[: len(own) - need + 1])]
    return spark.createDataFrame(rows, "word string, label string, place int, need int, length int, template array<string>"), {r[0] for r in rows}


def candidates(blocks: DataFrame, index: DataFrame) -> DataFrame:
    """Pairs of a block and a template that share a prefix word and pass the length and position filters."""
    posted = blocks.select("row", "start", "n", "span", "words", F.posexplode("words").alias("at", "word"))
    pairs = posted.join(F.broadcast(index), "word")  # the index is fixed by TEMPLATES
    fits = F.when(F.col("span") == 0, F.col("n") <= 2 * F.col("length") - 1).otherwise(F.col("span") == F.col("length"))
    pairs = pairs.where((F.size("words") >= F.col("need")) & fits)
    # If this is the first shared word, the others follow it in the block's order.
    return pairs.where(F.size("words") - F.col("at") >= F.col("need"))


def block_matches(blocks: DataFrame, index: DataFrame) -> DataFrame:
    """(row, start, n, label, containment) of each block that meets a template; blocks: (row, start, n, span, words)."""
    pairs = candidates(blocks, index)
    # First shared word only: nothing of the template's order before it is in the block.
    shared = F.array_intersect("words", "template")
    pairs = pairs.where((F.element_at(shared, 1) == F.col("word")) & (F.size(shared) >= F.col("need")))
    return pairs.select("row", "start", "n", "label", (F.size(shared) / F.size("template")).alias("containment"))


def label_licenses(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: base columns, labels of phrases and templates, best containment."""
    spark = docs.sparkSession
    vocabulary = {w for t in TEMPLATES.values() for w in t.split()}
    counts = word_blocks(docs, vocabulary)
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    index, prefixes = template_index(spark, rank)
    rows = saved(scan(docs, rank, prefixes).withColumn("row", F.monotonically_increasing_id()), "license-rows")
    blocks = rows.select("row", F.explode("blocks").alias("b")).select("row", "b.start", "b.n", "b.span", "b.words")
    found = block_matches(blocks, index).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    joined = rows.join(found, "row", "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    return label_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
