"""Small fixtures for the ten operators: brute force, edge rows, empty tables, clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logspark.llm import decontaminate, langid, licenses, media, mixing, neardup, substring, tokens
from logspark.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, **more):
    """Documents from texts; a column with a clashing name is added to every table."""
    rows = [(i, t, more.get("lang", {}).get(i, "en"), more.get("source", {}).get(i, f"s{i % 3}"), len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit(1), "h": F.lit("x"), "n": F.lit(2.0), "tok": F.lit(3), "size": F.lit(4), "c": F.lit(5)})


def sentence(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = [sentence(rng, rng.randrange(60, 200)) for _ in range(24)]
    passage = sentence(rng, 70)
    for i in (3, 9, 15):
        out[i] = f"{sentence(rng, 20)} {passage} {sentence(rng, 25)}"
    out[20] = out[4]
    for i in (21, 22, 23):
        words = out[7].split()
        words[rng.randrange(len(words))] = "changed"
        out[i] = " ".join(words)
    return [*out, None, "", "   ", "short text", "Short  Text", "x" * 50_000, sentence(rng, 6000)]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t):
    w = WORD.findall(lower(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_neardup_brute_force(spark, texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    docs = docs_of(spark, texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.link(docs.union(docs.limit(3)), 0.85).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def test_neardup_large_family_and_null_id(spark):
    rng = random.Random(1)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(120)] = f"v{rng.randrange(10**6)}"
        rows.append(" ".join(w))
    docs = docs_of(spark, rows).withColumn("doc_id", F.when(F.col("doc_id") == 7, None).otherwise(F.col("doc_id")))
    got = neardup.link(docs, 0.85).collect()
    sets = {i: shingles(t) for i, t in enumerate(rows) if i != 7}
    near = collections.defaultdict(set)
    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            near[a].add(b), near[b].add(a)
    want, seen = {}, set()
    for i in sets:
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                for j in near[todo.pop()] - group:
                    group.add(j), todo.append(j)
            seen |= group
            want |= {j: min(group) for j in group}
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 100)] + [(rng.randrange(500, 600), rng.randrange(500, 600)) for _ in range(60)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    pairs = [(a, b) for a, b in pairs if a != b]
    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    from logspark.llm import components as module

    for small in (200_000, 1):
        module.SMALL_EDGES = small
        got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        assert got == {a: find(a) for a in parent}
    module.SMALL_EDGES = 200_000


def brute_substring(texts, target=50):
    first = {}
    words = [WORD.findall(t or "") for t in texts]
    for i, w in enumerate(words):
        for s in range(len(w) - target + 1):
            first.setdefault(tuple(w[s : s + target]), i)
    out = {}
    for i, w in enumerate(words):
        gone = [False] * len(w)
        for s in range(len(w) - target + 1):
            if first[tuple(w[s : s + target])] < i:
                gone[s : s + target] = [True] * target
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def test_substring_brute_force(spark, texts, tmp_path):
    texts = [*texts, " ".join(["a"] * 130), "b " + " ".join(["a"] * 80), " ".join(["c", "d"] * 60), texts[6][:300] + " " + texts[8]]
    docs = docs_of(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.op6_substring(spark, str(tmp_path)).collect()}
    assert got == brute_substring(texts)


def test_decontaminate(spark):
    rng = random.Random(3)
    item = sentence(rng, 30, 5000)
    other = item.split()
    for i in (4, 13, 22):
        other[i] = "different"
    rows = [f"{sentence(rng, 40)} {item} {sentence(rng, 10)}", f"{sentence(rng, 40)} {' '.join(other)}.", sentence(rng, 90, 5000), item.upper().replace(" ", ", "), None, "", " ".join(item.split()[:9]), f"{sentence(rng, 15)} {' '.join(item.split()[8:24])}"]
    bench = spark.createDataFrame([(5, item), (6, item), (7, None), (8, "too short"), (9, sentence(rng, 20, 5000))], "item_id long, text string").withColumn("doc_id", F.lit(1))
    for limit in (1_000_000, 1):
        decontaminate.SEED_ROWS = limit
        got = {r.doc_id: (r.contaminated, r.item_id, r.points) for r in decontaminate.judge(docs_of(spark, rows), bench).collect()}
        assert got == {0: (True, 5, 30), 1: (True, 5, 24), 2: (False, None, None), 3: (True, 5, 30), 4: (False, None, None), 5: (False, None, None), 6: (False, None, None), 7: (True, 5, 16)}
    decontaminate.SEED_ROWS = 1_000_000
    plan = decontaminate.judge(docs_of(spark, rows), bench)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_decontaminate_short_items(spark):
    rng = random.Random(13)
    sizes = (1, 2, 5, 10, 11, 12, 15, 17)
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in sizes}
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    copies = [f"{sentence(rng, 30)} {' '.join(w)} {sentence(rng, 30)}" for w in items.values()] + [" ".join(w) for w in items.values()]
    part = [f"{sentence(rng, 30)} {' '.join(items[n][: n // 2])} {sentence(rng, 30)}" for n in sizes if n > 1]
    # One word of an item is replaced near its end: the seeds before it stay.
    near = [" ".join([*sentence(rng, 20).split(), *items[n][:-2], "other", items[n][-1]]) for n in (15, 17)]
    for limit in (1_000_000, 1):
        decontaminate.SEED_ROWS = limit
        got = {r.doc_id: (r.item_id, r.points) for r in decontaminate.judge(docs_of(spark, [*copies, *part, *near]), bench).collect()}
        assert [got[i] for i in range(16)] == [(None, None), *[(n, n) for n in sizes[1:]]] * 2  # a word alone is no evidence
        assert [got[16 + i] for i in range(7)] == [(None, None)] * 7
        assert [got[23], got[24]] == [(15, 13), (17, 15)]
        # Two replaced words of 15: the rest is worth 11 points, under NEED.
        two = [items[15][0], "odd", *items[15][2:12], "other", *items[15][13:]]
        assert decontaminate.judge(docs_of(spark, [" ".join(two)]), bench).first().points == 11
    decontaminate.SEED_ROWS = 1_000_000


def statements(text):
    """Best containment of each template that a block of the text meets."""
    lines = [licenses.WORD.findall(lower(line)) for line in (text or "").split("\n")]
    runs = [[w for line in group for w in line] for full, group in itertools.groupby(lines, bool) if full]
    out = {}
    for label, statement in licenses.TEMPLATES.items():
        n, own = len(statement.split()), set(statement.split())
        blocks = [w for w in lines if len(w) <= 2 * n - 1] + [run[s : s + 2 * n - 1] for run in runs for s in range(0, len(run), n)]
        best = max((len(own & set(b)) / len(own) for b in blocks), default=0)
        if best >= licenses.CONTAINMENT - 1e-9:
            out[label] = best
    return out


def test_license_blocks_brute_force(spark):
    rng = random.Random(17)
    every = [t.split() for t in licenses.TEMPLATES.values()]
    rows = [" ".join([*["filler"] * 900, "released", *["filler"] * 300, "under the", *["filler"] * 600, "mit license"])]
    for _ in range(120):
        words = [w for w in rng.choice(every) if rng.random() > 0.04]
        for _ in range(rng.choice([0, 1, 3, len(words)])):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["filler", "of", "any"]))
        words = [f"p{i}" for i in range(rng.randrange(40))] + words + ["tail"] * rng.randrange(40)
        rows.append("".join(w + rng.choice([" ", " ", " ", " ", "\n", ", "] + ["\n\n"] * (rng.random() < 0.1)) for w in words))
    got = {r.doc_id: r for r in licenses.label_licenses(docs_of(spark, rows)).collect()}
    found = 0
    for i, t in enumerate(rows):
        want = statements(t)
        found += len(want)
        base = set(filter(None, got[i].base_labels.split(",")))
        assert set(filter(None, got[i].labels.split(","))) == base | set(want)
        assert base or abs(got[i].score - max(want.values(), default=0)) < 1e-12
    assert found > 60 and got[0].labels == ""


def test_licenses(spark):
    rows = ["All rights reserved.\nplain", "This work is licensed under the GNU General Public License, version 3.", "CC by, all RIGHTS reserved and cc-by", None, "", "Released under the MIT License.", "general public\nlicense", "rights reserved", "licensed under the apache license"]
    got = {r.doc_id: r for r in licenses.label_licenses(docs_of(spark, rows)).collect()}
    for i, t in enumerate(rows):
        words = licenses.WORD.findall(lower(t))
        places = [(s, k) for k, p in licenses.PHRASES.items() for s in range(len(words)) if words[s : s + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min((s for s, _ in places), default=None), max((s for s, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({k for _, k in places}))
        more = set(statements(t))
        assert r.labels == ",".join(sorted({k for _, k in places} | more))
    assert got[5].labels == "mit" and "gpl-3.0" in got[1].labels


def test_licenses_over_line_ends(spark):
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy"
    rows = [
        f"{grant}\nof this software and associated documentation files",
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that",
        " * Permission to use, copy, modify, and/or distribute this\n * software for any purpose with or without fee is hereby granted",
        f"{sentence(random.Random(1), 60)} released\nunder\nthe MIT\nLicense {sentence(random.Random(2), 60)}",
        "released under\n\nthe MIT license",
        f"released under {sentence(random.Random(3), 9)}\nthe MIT license",
    ]
    got = {r.doc_id: r.labels for r in licenses.label_licenses(docs_of(spark, rows)).collect()}
    assert got == {0: "mit-grant", 1: "bsd", 2: "isc", 3: "mit", 4: "", 5: ""}
    # Every statement, wrapped at every place.
    cut = [(k, w[:i], w[i:]) for k, t in licenses.TEMPLATES.items() for w in [t.split()] for i in range(1, len(w))]
    wrapped = {r.doc_id: r.labels.split(",") for r in licenses.label_licenses(docs_of(spark, [f"some words {' '.join(a)}\n{' '.join(b)} and more" for _, a, b in cut])).collect()}
    assert all(k in wrapped[i] for i, (k, _, _) in enumerate(cut))


def test_license_position_filter_prunes_and_loses_nothing(spark):
    vocabulary = sorted({w for t in licenses.TEMPLATES.values() for w in t.split()})
    rank = {w: i for i, w in enumerate(random.Random(9).sample(vocabulary, len(vocabulary)))}
    index, prefixes = licenses.template_index(spark, rank)
    rng = random.Random(10)
    sets = [sorted(rng.sample(vocabulary, rng.randrange(3, 40)), key=rank.get) for _ in range(150)]
    sets += [sorted(set(t.split()) - set(rng.sample(t.split(), k)), key=rank.get) for t in licenses.TEMPLATES.values() for k in (0, 1, 2)]
    blocks = spark.createDataFrame([(i, 0, len(w), 0, w) for i, w in enumerate(sets)], "row long, start long, n long, span long, words array<string>")
    own = {k: set(t.split()) for k, t in licenses.TEMPLATES.items()}
    want = {(i, k) for i, w in enumerate(sets) for k, t in own.items() if len(w) <= 2 * len(licenses.TEMPLATES[k].split()) - 1 and len(t & set(w)) >= licenses.CONTAINMENT * len(t) - 1e-9}
    assert {(r.row, r.label) for r in licenses.block_matches(blocks, index).collect()} == want
    by_prefix_and_length = sum(1 for w in sets for r in index.collect() if r.word in w and len(w) >= r.need)
    assert licenses.candidates(blocks, index).count() < by_prefix_and_length


def test_media_round_trip(spark, tmp_path):
    rng = random.Random(6)
    rows = ["", None, "a", "é" * 400, sentence(rng, 3000), "b" * 576, "b" * 576]
    out = f"file://{tmp_path}/archives"
    media.write_archives(docs_of(spark, rows), out)
    spark.dataSource.register(media.MediaArchive)
    got = media.features(spark.read.format("media_archive").option("rangeBytes", "700").load(out)).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(rows)))
    for r in got:
        raw = (rows[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.error) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), None)
    same = [r for r in got if r.doc_id in (5, 6)]
    assert same[0].media_sha256 == same[1].media_sha256 and same[0].feature == same[1].feature


def test_media_bad_member_keeps_its_row(spark, tmp_path):
    out = f"file://{tmp_path}/bad"
    media.write_archives(docs_of(spark, ["one", "two"]).coalesce(1), out)
    path = next((tmp_path / "bad").glob("*.zip"))
    data = bytearray(path.read_bytes())
    data[data.index(b"IDAT") + 8] ^= 0xFF
    path.write_bytes(data)
    got = {r.doc_id: r.error for r in media.features(media.read_archives(spark, out)).collect()}
    assert got == {0: "checksum differs", 1: None}


def test_media_ranges_are_bounded_and_features_are_the_payloads(spark, tmp_path, monkeypatch):
    rng = random.Random(12)
    rows = [sentence(rng, 300) for _ in range(20)]
    out = f"file://{tmp_path}/ranges"
    media.write_archives(docs_of(spark, rows).coalesce(2), out)
    monkeypatch.setattr(media, "MAX_RANGES", 5)
    reader = media.ArchiveReader({"path": out, "rangebytes": "100"})
    parts = reader.partitions()
    assert len(parts) <= 5 + 2
    read = [m for p in parts for b in reader.read(p) for m in b.to_pylist()]
    assert sorted(m["doc_id"] for m in read) == list(range(20)) and not any(m["error"] for m in read)
    for r in media.features(media.read_archives(spark, out)).collect():
        samples = list(rows[r.doc_id].encode())
        samples += [255] * (-len(samples) % 576)
        n, mean = len(samples), sum(samples) / len(samples)
        entropy = -sum(c / n * math.log2(c / n) for c in collections.Counter(samples).values())
        got = r.feature.split("|")
        assert abs(float(got[0]) - mean) < 1e-3 and abs(float(got[1]) - (sum((x - mean) ** 2 for x in samples) / n) ** 0.5) < 1e-3 and abs(float(got[2]) - entropy) < 1e-3
        assert all(abs(int(g) - 1000 * sum(32 * i <= x < 32 * i + 32 for x in samples) / n) <= 0.51 for i, g in enumerate(got[3].split(",")))


def test_media_read_recovers_at_the_members_offset(tmp_path, spark):
    out = f"file://{tmp_path}/retry"
    media.write_archives(docs_of(spark, ["one", "two", "three"]).coalesce(1), out)
    fs, _ = media.opened(out)
    opened = []

    class Flaky:
        def open_input_file(self, path):
            opened.append(path)
            if len(opened) == 2:  # the first one after the directory was read
                raise OSError("lost")
            return fs.open_input_file(path)

    reader = media.ArchiveReader({"path": out})
    (part,) = reader.partitions()
    real, media.opened = media.opened, lambda uri: (Flaky(), None)
    try:
        rows = [m for b in reader.read(part) for m in b.to_pylist()]
    finally:
        media.opened = real
    assert len(rows) == 3 and not any(r["error"] for r in rows) and len(opened) == 3


def test_mixing(spark):
    rng = random.Random(7)
    rows = [sentence(rng, rng.randrange(1, 80)) for _ in range(400)] + [None, ""]
    source = {i: None if i % 11 == 0 else f"s{min(i % 5, 3)}" for i in range(402)}
    docs = docs_of(spark, rows, source=source)
    planned = mixing.plan(mixing.sizes(docs)).collect()
    assert len(planned) == 402
    by = collections.defaultdict(list)
    for r in planned:
        by[r.source].append(r)
    total = sum(r.size for r in planned)
    assert math.isclose(sum(v[0].target for v in by.values()), 1.5 * total)
    for s, v in by.items():
        assert v[0].source_size == sum(r.size for r in v) and v[0].target <= 2 * v[0].source_size + 1e-6
        assert abs(sum(r.taken for r in v) - v[0].target) <= max(r.size for r in v)
        assert all(r.taken <= 2 * r.size for r in v)
    spots = mixing.placed(mixing.plan(mixing.sizes(docs))).collect()
    assert all(0 <= r.position <= 1 for r in spots) and len(spots) == sum(r.copies for r in planned)
    again = {r.doc_id: r.taken for r in mixing.plan(mixing.sizes(docs.repartition(7))).collect()}
    assert again == {r.doc_id: r.taken for r in planned}
    assert mixing.targets([("a", 10), ("b", 0), (None, 5)]) == {"a": 20.0, "b": 0.0, None: 2.5} or sum(mixing.targets([("a", 10), ("b", 0), (None, 5)]).values()) == 22.5


def test_tokens_add_up(spark):
    rows = ["one line", "a\nbb\n\nccc\n", None, "", "é\nü ñ\n" * 50, "tail  \n\n  spaces"]
    got = tokens.section_tokens(docs_of(spark, rows)).collect()
    enc, _ = tokens.encoder("")
    for i, t in enumerate(rows):
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.section)
        assert sum(r.n_tokens for r in own) == len(enc.encode_ordinary(t or "")) == own[0].doc_tokens
        assert own[0].start_byte == 0 and own[-1].end_byte == len((t or "").encode())
    ends, sections = np.array([3, 7, 8]), np.array([4, 6, 8])
    assert [x.tolist() for x in tokens.attribute(ends, sections)] == [[1, 1, 1], [0, 1, 0]]


def owners(spans, ends):
    """By counting bytes: tokens of each section, and those that cross an end."""
    of = [i for i, (a, b) in enumerate(zip([0, *ends], ends)) for _ in range(b - a)]
    tokens_of, crossing = [0] * len(ends), [0] * len(ends)
    for a, b in spans:
        held = collections.Counter(of[a:b])
        best = min(held, key=lambda s: (-held[s], s))
        tokens_of[best] += 1
        crossing[best] += len(held) > 1
    return tokens_of, crossing


def spans_of(text):
    at, out = 0, []
    enc, _ = tokens.encoder("")
    for i in enc.encode_ordinary(text):
        out.append((at, at := at + len(enc.decode_single_token_bytes(i))))
    return out


def test_tokens_by_counting_bytes(spark):
    rng = random.Random(3)
    pieces = ["\n", "\n\n", " ", "  \n", "word", "é", "日本", "x\ty", "don't", "1234", "🙂", ".\n", "{\n    "]
    rows = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 60))) for _ in range(60)] + ["\n" * 40, "no end"]
    got = collections.defaultdict(list)
    for r in tokens.section_tokens(docs_of(spark, rows)).orderBy("doc_id", "section").collect():
        got[r.doc_id].append(r)
    crossed = 0
    for i, t in enumerate(rows):
        lines = [x.encode() for x in re.findall(r"[^\n]*\n|[^\n]+", t)]
        ends = list(itertools.accumulate(map(len, lines)))
        want = owners(spans_of(t), ends)
        assert ([r.n_tokens for r in got[i]], [r.n_crossing for r in got[i]], [r.end_byte for r in got[i]]) == (*want, ends)
        crossed += sum(want[1])
    assert crossed > 20


def test_tokens_of_fields(spark):
    rng = random.Random(4)
    values = ["", None, "title", "two words ", " é\n", "日本語", "don", "'t go"]
    rows = [(i, rng.choice(values), rng.choice(values), rng.choice(values)) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, title string, field string, n_tokens string")
    for separator in ("\n", ""):
        got = {(r.doc_id, r.field): r for r in tokens.field_tokens(df, ["title", "field", "n_tokens"], separator).collect()}
        for i, *parts in rows:
            texts = [(p or "") + (separator if k < 2 else "") for k, p in enumerate(parts)]
            want = owners(spans_of("".join(texts)), list(itertools.accumulate(len(t.encode()) for t in texts)))
            have = [got[i, f] for f in ("title", "field", "n_tokens")]
            assert ([r.n_tokens for r in have], [r.n_crossing for r in have]) == want and have[0].doc_tokens == sum(want[0])


def test_langid_by_hand(spark):
    texts = ["aaa bbb", "abab", "zzz", "aaa zzz", "Aaa, BBB!", "aaa bbb aaa bbb"]
    idf = np.ones(langid.DIMS)
    unit = [langid.vector(t, idf) for t in texts]
    centers = np.stack([unit[0], unit[2], unit[0], unit[1]]).astype(np.float32)
    names, floors = ["bb", "aa", "cc", "bb"], np.array([0.9, 0.9, 0.9, 0.9])
    order = sorted(range(4), key=lambda i: (names[i], centers[i].tobytes()))
    model = ([names[i] for i in order], centers[order], floors, idf)
    got = {r.doc_id: r for r in langid.predict(docs_of(spark, texts), model, "doc_id").collect()}
    for i, v in enumerate(unit):
        sims = [float(np.dot(v.astype(np.float32), c)) for c in model[1]]
        each = {n: max(s for s, m in zip(sims, model[0]) if m == n) for n in set(names)}
        top = max(sims)
        assert abs(each[got[i].lang_pred] - top) < 1e-6 and abs(got[i].cosine - top) < 1e-5 and got[i].rejected == (top < 0.9)
        odds = {n: math.exp(langid.SHARPNESS * (s - top)) for n, s in each.items()}
        assert abs(got[i].score - odds[got[i].lang_pred] / sum(odds.values())) < 1e-4
    assert got[0].lang_pred == "bb" and not got[0].rejected  # bb and cc hold the same centroid: the first in order
    assert got[3].rejected and not got[4].rejected and got[2].lang_pred == "aa"


def test_langid_held_out(spark):
    rng = random.Random(8)
    parts = {"aa": "ka lo mi tu sen".split(), "bb": "cha ung heit ver".split()}
    rows, lang = [], {}
    for i in range(120):
        lang[i] = "aa" if i % 2 else "bb"
        rows.append(" ".join("".join(rng.choice(parts[lang[i]]) for _ in range(3)) for _ in range(20)))
    docs = docs_of(spark, rows, lang=lang)
    model = langid.fit(docs.where("doc_id < 80"))
    got = langid.predict(docs.where("doc_id >= 80"), model, "doc_id").collect()
    assert all(r.lang_pred == lang[r.doc_id] and 0 <= r.score <= 1 for r in got)
    odd = langid.predict(docs_of(spark, [None, "", "12 34"]), model, "doc_id").collect()
    assert {r.lang_pred for r in odd} == {"und"} and all(r.score == 0 for r in odd)
    empty = langid.fit(docs.where("doc_id < 0"))
    assert {r.lang_pred for r in langid.predict(docs.limit(2), empty, "doc_id").collect()} == {"und"}


def test_empty_tables(spark, tmp_path):
    docs = docs_of(spark, ["x"]).limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    from logspark.llm.queries import QUERIES

    for name, f in QUERIES.items():
        assert f(spark, str(tmp_path)).count() == 0, name


@pytest.mark.parametrize("target", [20, 30])
def test_substring_of_other_lengths(spark, target):
    rng = random.Random(target)
    texts = [sentence(rng, rng.randrange(1, 60), 12) for _ in range(40)] + [None, ""]
    docs = substring.one_text(docs_of(spark, texts))
    documents, removals = substring.find(docs, target)
    got = {r.doc_id: r.n_removed for r in substring.cut(substring.with_text(docs, removals), target).collect()}
    got |= {r.doc_id: r.n_words for r in documents.where("copy").collect()}
    want = brute_substring(texts, target)
    assert {i: n for i, n in got.items() if n} == {i: n for i, (_, n, _) in want.items() if n}
