"""MinHash near-dedup by a signature-coordinate inverted join.

Documents with equal shingle sets are one class (128-bit sums over the set). Each class is
posted under its COORDINATES (coordinate, value) pairs. Values that one class alone has are
skipped, and so is a class with fewer shared values than the match threshold asks for. Of the
rest a class keeps its COORDINATES - threshold + 1 rarest postings: two classes that agree in
as many coordinates as the threshold share one of them. Lists merge their members' signatures
in blocks, counting agreements over LONG coordinates.

First every list proposes its most central member to the others (a star); those links are
confirmed on full sets and components are formed. Lists that still hold several components are
dealt in block pairs: the members outside the list's largest component against all members.
Those that agree in enough coordinates with a member of another component meet again with their
full sets, and a task emits only links that join what it has not joined yet: fewer rows than
members, however many pairs it compares. So no link between different components is lost, and a
large family never lists its pairs. The thresholds lie about 5 (postings) and 4.3 (full
signature) standard deviations below the expected agreement of a pair at the similarity asked
for, so a link is missed with a chance of about 1e-5.

Null and empty texts have no shingle and link with nothing; texts shorter than a shingle are
one shingle. Rows that repeat a doc_id are one document with the longest of their texts (then
the greatest). Rows without doc_id are left out of the linking and each come back with null
component. Texts of any length count as a whole. No rows: no result rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import dropped, few, hashes, mix, one_text, pick, pieces, saved, side, signed, windows, word_codes
from logspark.llm.components import components

SHINGLE = 5
#: Posted coordinates; coordinates of the whole signature (16 bits each).
COORDINATES, LONG = 64, 256
#: Members of a block of a list, and shingles they hold together (about).
BLOCK, BLOCK_SHINGLES = 1024, 500_000
FACTORS = mix(np.arange(1, LONG + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and the offsets."""
    codes, words, offsets = word_codes(texts, lower=True)
    h = hashes(words)[codes]
    full = windows(h, SHINGLE)
    sets = []
    for i in range(len(offsets) - 1):
        lo, hi = offsets[i], offsets[i + 1]
        if hi - lo >= SHINGLE:
            sets.append(np.unique(full[lo : hi - SHINGLE + 1]))
        elif hi > lo:
            sets.append(mix(windows(h[lo:hi], hi - lo) + np.uint64(hi - lo)))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    out = np.zeros(len(sets) + 1, dtype=np.int64)
    np.cumsum([len(s) for s in sets], out=out[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)), out


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n, key1, key2, sig): size of each set, sums that tell sets apart, COORDINATES minima of 32 bits, LONG of 16 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            flat, offsets = shingle_sets(batch.column("text"))
            n = np.diff(offsets)
            some = np.flatnonzero(n)
            starts = offsets[:-1][some]
            mins = np.zeros((len(n), LONG), dtype=np.uint32)
            key1, key2 = np.zeros(len(n), dtype=np.uint64), np.zeros(len(n), dtype=np.uint64)
            if len(some):
                for k, a in enumerate(FACTORS):
                    mins[some, k] = np.minimum.reduceat(flat * a >> np.uint64(32), starts).astype(np.uint32)
                key1[some] = np.add.reduceat(mix(flat), starts)
                key2[some] = np.add.reduceat(mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
            posted = [row[:COORDINATES].tobytes() for row in mins]
            short = [row.astype(np.uint16).tobytes() for row in mix(mins.astype(np.uint64))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), signed(key1), signed(key2), pa.array(posted, pa.binary()), pa.array(short, pa.binary())], names=["doc_id", "n", "key1", "key2", "posted", "sig"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n long, key1 long, key2 long, posted binary, sig binary")


def postings(classes: DataFrame) -> DataFrame:
    """(key, id): each class under its COORDINATES coordinate-value pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column("posted").to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)
            keys = mix((np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)) + values)
            yield pa.RecordBatch.from_arrays([signed(keys.ravel()), pa.array(np.repeat(batch.column("id").to_numpy(), COORDINATES))], names=["key", "id"])

    return classes.select("id", "posted").mapInArrow(run, "key long, id long")


def thresholds(similarity: float) -> tuple[int, int]:
    """Agreements asked for among COORDINATES and among LONG."""
    low = lambda n, z: max(1, math.floor(n * similarity - z * math.sqrt(n * similarity * (1 - similarity))))
    return low(COORDINATES, 5.0), low(LONG, 4.3)


def prefix_lists(classes: DataFrame, match: int) -> DataFrame:
    """(key, id, n, sig, freq, weight): each class under its rarest shared values, as many as match demands."""
    posted = saved(postings(classes), "postings")  # read twice: counted by key, then joined
    shared = posted.groupBy("key").agg(F.count("*").alias("freq")).where("freq > 1")
    lists = posted.join(shared, "key").groupBy("id").agg(F.collect_list(F.struct("freq", "key")).alias("keys")).where(F.size("keys") >= match)
    # A class holds at most COORDINATES keys; missing ones count as rarest, so fewer shared ones are left for the prefix.
    kept = F.slice(F.array_sort("keys"), 1, F.greatest(F.lit(1), F.size("keys") - match + 1))
    held = lists.select("id", kept.alias("kept"), F.aggregate("keys", F.lit(0).cast("long"), lambda a, k: a + k["freq"]).alias("weight"))
    rows = held.select("id", "weight", F.transform("kept", lambda k: k["key"]).alias("prefix"), F.posexplode("kept").alias("place", "k")).select("id", "weight", "prefix", "place", "k.freq", "k.key")
    out = saved(rows.join(classes.select("id", "n", "sig"), "id"), "prefix-lists")
    dropped(posted)
    return out


def grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows that stand together by keys, whole groups at a time; several groups may come as one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows, dtype=bool)
        for k in keys:
            column = batch.column(k).to_numpy(zero_copy_only=False)
            same &= column == column[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        before = held[-1] if held else None
        starts_new = before is not None and any(batch.column(k)[0] != before.column(k)[before.num_rows - 1] for k in keys)
        if held and (starts_new or cut):
            whole = held if starts_new or not cut else [*held, batch.slice(0, cut)]
            yield pa.Table.from_batches(whole)
            held = []
            if cut and starts_new:
                yield pa.Table.from_batches([batch.slice(0, cut)])
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def bounds(table: pa.Table, keys: tuple[str, ...]) -> Iterator[tuple[int, int]]:
    """Start and end of each group of a table sorted by keys."""
    change = np.zeros(table.num_rows - 1, dtype=bool)
    for k in keys:
        column = table.column(k).to_numpy()
        change |= column[1:] != column[:-1]
    edges = np.concatenate([[0], np.flatnonzero(change) + 1, [table.num_rows]])
    yield from zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def signature_rows(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint16).reshape(-1, LONG)


def stars(lists: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the most central member of each block of a list with those that agree with it."""
    _, long_match = thresholds(similarity)
    keys = ("key", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, keys):
            ids, n, weight = (table.column(c).to_numpy() for c in ("id", "n", "weight"))
            sig = signature_rows(table)
            found: set[tuple[int, int]] = set()
            for lo, hi in bounds(table, keys):
                center = lo + int(np.lexsort((ids[lo:hi], -weight[lo:hi]))[0])
                others = np.arange(lo, hi)
                others = others[(others != center) & (np.minimum(n[center], n[lo:hi]) >= similarity * np.maximum(n[center], n[lo:hi]) - 1e-9)]
                others = others[(sig[center] == sig[others]).sum(axis=1) >= long_match]
                c = int(ids[center])
                found.update((min(c, o), max(c, o)) for o in ids[others].tolist())
            a, b = zip(*sorted(found), strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("freq") / BLOCK)).cast("int").alias("block")
    rows = lists.select("key", block, "id", "n", "sig", "weight").repartition("key", "block").sortWithinPartitions("key", "block")
    return rows.mapInArrow(run, "a long, b long").distinct()


def mixed_lists(lists: DataFrame, joined: DataFrame) -> DataFrame:
    """(key, q, d, asks, id, n, component, sig, place, prefix): lists with several components, dealt in block pairs.

    asks: the row is one of those outside its list's largest component (block q) that are compared
    with all members (block d); a row that doesn't ask is one of the latter.
    """
    now = lists.select("key", "id", "n").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    per = now.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("n").alias("items"))
    most = F.max(F.struct("c", "component"))
    # A list has as many rows here as it has components; sums of them are kept, no rows.
    per_key = per.groupBy("key").agg(F.sum("c").alias("c"), F.sum("items").alias("items"), most.alias("home"), F.count("*").alias("kinds"))
    blocks = lambda c, items: F.ceil(F.greatest(c / BLOCK, items / BLOCK_SHINGLES)).cast("int")
    mixed = per_key.where("kinds > 1").select(
        "key",
        F.col("home.component").alias("home"),
        blocks(F.col("c"), F.col("items")).alias("ds"),
        blocks(F.col("c") - F.col("home.c"), F.col("items") * (1 - F.col("home.c") / F.col("c"))).alias("qs"),
    )
    mixed = side(saved(mixed, "mixed-keys"))
    rows = lists.select("key", "id", "n", "sig", "place", "prefix").join(mixed, "key").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    q, d = F.pmod(F.xxhash64("id", F.lit("q")), F.col("qs")).cast("int"), F.pmod(F.xxhash64("id"), F.col("ds")).cast("int")
    spot = lambda q, d, asks: F.struct(q.alias("q"), d.alias("d"), F.lit(asks).alias("asks"))
    told = F.transform(F.sequence(F.lit(0), F.col("qs") - 1), lambda x: spot(x, d, False))
    asking = F.when(F.col("component") != F.col("home"), F.transform(F.sequence(F.lit(0), F.col("ds") - 1), lambda x: spot(q, x, True)))
    dealt = rows.withColumn("at", F.explode(F.concat(told, F.coalesce(asking, F.array().cast("array<struct<q:int,d:int,asks:boolean>>")))))
    return dealt.select("key", "at.q", "at.d", "at.asks", "id", "n", "component", "home", "sig", "place", "prefix")


PAIRED = ("key", "q", "d")


def in_pairs(rows: DataFrame) -> DataFrame:
    return rows.repartition(*PAIRED).sortWithinPartitions(*PAIRED)


def touched(dealt: DataFrame, similarity: float) -> DataFrame:
    """The rows of mixed_lists (without signatures) that agree enough with one of another component.

    Of the lists that two classes share the first in their common order compares them.
    """
    _, long_match = thresholds(similarity)
    keep = [*PAIRED, "asks", "id", "n", "component", "home"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, PAIRED):
            asks, ids, n, component, home, place = (table.column(c).to_numpy() for c in ("asks", "id", "n", "component", "home", "place"))
            sig, prefix = signature_rows(table), table.column("prefix").to_pylist()
            hit = np.zeros(table.num_rows, dtype=bool)
            for lo, hi in bounds(table, PAIRED):
                data = lo + np.flatnonzero(~asks[lo:hi])
                for i in (lo + np.flatnonzero(asks[lo:hi])).tolist():
                    # Two that both ask would meet twice: the smaller id asks.
                    others = data[(component[data] != component[i]) & ((component[data] == home[i]) | (ids[data] > ids[i]))]
                    others = others[np.minimum(n[i], n[others]) >= similarity * np.maximum(n[i], n[others]) - 1e-9]
                    others = others[(sig[i] == sig[others]).sum(axis=1) >= long_match]
                    if len(others) and place[i]:
                        before = frozenset(prefix[i][: place[i]])
                        others = others[[before.isdisjoint(prefix[o]) for o in others]]
                    if len(others):
                        hit[i] = hit[others] = True
            yield from table.select(keep).filter(pa.array(hit)).combine_chunks().to_batches()

    kinds = "key long, q int, d int, asks boolean, id long, n long, component long, home long"
    return in_pairs(dealt).mapInArrow(run, kinds)


def joining(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): confirmed links of touched rows; of each block pair only those that join what it has not joined yet."""
    percent = round(100 * similarity)

    def links(ids, asks, component, home, items) -> Iterator[tuple[int, int]]:
        sizes = np.array([len(x) // 8 for x in items])
        codes = np.unique(np.frombuffer(b"".join(items), dtype=np.uint64), return_inverse=True)[1]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        mark = np.zeros(int(codes.max()) + 1, dtype=bool)
        part = np.unique(component, return_inverse=True)[1]
        data = np.flatnonzero(~asks)
        for i in np.flatnonzero(asks).tolist():
            other = (part[data] != part[i]) & ((component[data] == home[i]) | (ids[data] > ids[i]))
            if not other.any():
                continue
            own = codes[starts[i] : starts[i] + sizes[i]]
            mark[own] = True
            both = np.add.reduceat(mark[codes], starts, dtype=np.int64)[data]
            mark[own] = False
            for j in data[other & (100 * both >= percent * (sizes[i] + sizes[data] - both))].tolist():
                if part[j] != part[i]:
                    part[part == part[j]] = part[i]
                    yield min(int(ids[i]), int(ids[j])), max(int(ids[i]), int(ids[j]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, PAIRED):
            ids, asks, component, home = (table.column(c).to_numpy() for c in ("id", "asks", "component", "home"))
            items = table.column("items").to_pylist()
            found = {x for lo, hi in bounds(table, PAIRED) for x in links(ids[lo:hi], asks[lo:hi], component[lo:hi], home[lo:hi], items[lo:hi])}
            a, b = zip(*sorted(found), strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return in_pairs(rows.join(sets, "id").select(*PAIRED, "id", "asks", "component", "home", "items")).mapInArrow(run, "a long, b long").distinct()


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, items): the full shingle sets of the documents in ids (column doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            flat, offsets = shingle_sets(batch.column("text"))
            items = pa.array([flat[offsets[i] : offsets[i + 1]].tobytes() for i in range(batch.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), items], names=["id", "items"])

    wanted = saved(ids.distinct(), "set-ids")
    return saved(docs.join(side(wanted), "doc_id", "left_semi").mapInArrow(run, "id long, items binary"), "sets")


def confirmed(docs: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose full shingle sets are as similar as asked for."""
    percent = round(100 * similarity)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    held = sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
    first = pairs.join(held.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
    both = first.join(held.select(F.col("id").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y")
    out = saved(both.mapInArrow(test, "a long, b long"), "links")
    dropped(held)
    return out


def link(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per doc_id; component_id is the smallest doc_id reachable over links."""
    match, _ = thresholds(similarity)
    docs = one_text(docs)
    signed_docs = saved(signatures(docs), "signatures")
    full = signed_docs.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    heads = full.groupBy("n", "key1", "key2").agg(F.min("doc_id").alias("id"))
    # Equal sets have equal signatures: the head's row stands for its class.
    classes = saved(full.join(heads.select("id"), F.col("doc_id") == F.col("id")).select("id", "n", "posted", "sig"), "classes")
    lists = prefix_lists(classes, match)
    links = confirmed(docs, saved(stars(lists, similarity), "stars"), similarity)
    joined = saved(components(links), "components")
    near = saved(touched(mixed_lists(lists, joined), similarity), "touched")
    final = joined
    if not few(near, 0):
        sets = sets_of(docs, near.select(F.col("id").alias("doc_id")))
        more = saved(joining(near, sets, similarity), "more-links")
        dropped(sets)
        final = saved(components(joined.select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(more)), "components")
    # Saved: a join of its own, whose hot classes of equal texts Spark can split.
    of = side(saved(heads.join(final, "id", "left").select("n", "key1", "key2", F.coalesce("component", "id").alias("of")), "near-classes"))
    rows = signed_docs.select("doc_id", "n", "key1", "key2").join(of, ["n", "key1", "key2"], "left")
    named = F.when(F.col("doc_id").isNotNull(), F.coalesce("of", "doc_id"))
    out = saved(rows.select("doc_id", F.col("n").alias("n_shingles"), named.alias("component_id")), "near-copies")
    dropped(signed_docs, classes, lists, near)
    return out


def op8_neardup(spark, sf_dir: str) -> DataFrame:
    out = link(spark.read.parquet(f"{sf_dir}/documents.parquet"), 0.85)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies, and all rows without doc_id."""
    names = [c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in docs.columns]
    gone = link(docs).where(F.col("doc_id") != F.col("component_id")).select("doc_id")
    return pick(docs, *names).join(side(gone), "doc_id", "left_anti")
