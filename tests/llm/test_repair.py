"""Conversation repair against a plain recursion and against all edit strings of short conversations."""

import collections
import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from logspark.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
STATES = {"": "su", "s": "u", "u": "a", "a": "u"}


def damage(rows):
    """(lost conversations too) conv_id -> rows after damage, in order."""
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        out[conv] += [(turn, role, text)] * (2 if k == 3 else 1)
    for rows in out.values():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        letters = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def moves(rows, kinds, i, state):
    """(edit, cost, rows used, state after, emitted turn)"""
    due = "a" if state == "u" else "u"
    name = {"u": "user", "a": "assistant"}[due]
    yield "I", 2, 0, due, (name, "")
    if i < len(rows):
        _, role, text = rows[i]
        yield "D", 3, 1, state, None
        if kinds[i] not in ("blank", "duplicate"):
            more = kinds[i] == "truncated"
            yield "R", 2 + more, 1, due, (name, text)
            if role[:1] and role[:1] in STATES[state]:
                yield "K", 0 + more, 1, role[:1], (role, text)


def plain(rows):
    """Every conv's expected row by the recursion over (row, state): least (cost, audit)."""
    kinds = faults(rows)

    @functools.cache
    def best(i, state, inserts):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        for edit, cost, used, after, turn in moves(rows, kinds, i, state):
            if edit == "I" and inserts == 3:
                continue
            rest = best(i + used, after, 0 if used else inserts + 1)
            if rest:
                found.append((cost + rest[0], edit + rest[1], ((turn,) if turn else ()) + rest[2]))
        return min(found, key=lambda f: f[:2]) if found else None

    cost, audit, turns = best(0, "", 0)
    times = {t for t, _, _ in rows if t is not None}
    illegal = sum(f"{a[1][:1]}{b[1][:1]}" not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(times) - min(times) + 1 - len(times) if times else 0
    return {"gaps": gaps, "blank": kinds.count("blank"), "duplicate": kinds.count("duplicate"), "truncated": kinds.count("truncated"), "illegal": illegal, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()}


def got(spark, rows, tmp=None, **columns):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"h": F.lit(1), "n": F.lit("x"), "kind": F.lit(2), "k": F.lit(0), "lost": F.lit(True), "cut": F.lit(1)})
    tables = repair.repair(repair.damaged(df))[0]
    return {r.conv_id: r.asDict() for r in repair.digests(tables).collect()}


def check(spark, rows):
    have, want = got(spark, rows), damage(rows)
    assert set(have) == set(want)
    for conv, lines in want.items():
        row = have[conv]
        row.pop("conv_id")
        assert row == plain(lines), (conv, lines)


def talk(rng, conv, n):
    texts = ["yes.", "no", "", "  ", "why?", "ok!\n", "long text without end", "x. ", "aé!", "word. word"]
    return [(conv, None if rng.random() < 0.05 else rng.randrange(n + 2), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rng.choice([*texts, None, f"t{rng.random()}."])) for _ in range(n)]


def test_audit_is_the_least_of_all_strings():
    codes = range(repair.GONE + 1)
    rng = random.Random(1)
    for n in range(5):
        for chosen in itertools.product(codes, repeat=n) if n < 3 else [tuple(rng.choice(codes) for _ in range(n)) for _ in range(12)]:
            best = None
            for size in range(n, n + 6):
                if best and 2 * (size - n) > best[0]:
                    break
                for audit in itertools.product("DIKR", repeat=size):
                    if audit.count("I") != size - n:
                        continue
                    state, i, cost = 0, 0, 0
                    for edit in audit:
                        if edit == "I":
                            state, cost = repair.NEXT[state, repair.DUE[state]], cost + 2
                            continue
                        code, i = chosen[i], i + 1
                        if edit == "D":
                            cost += 3
                            continue
                        letter = repair.DUE[state] if edit == "R" else (repair.LETTERS + "?-")[code // 2]
                        if code == repair.GONE or (state, letter) not in repair.NEXT:
                            break
                        state, cost = repair.NEXT[state, letter], cost + (2 if edit == "R" else 0) + code % 2
                    else:
                        if state in (0, 3) and (best is None or (cost, "".join(audit)) < best):
                            best = (cost, "".join(audit))
            audit, cost = repair.whole(bytes(chosen))
            assert (cost, audit) == best, chosen


@pytest.mark.parametrize("limit", [2_000, 3])
def test_repair_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(repair, "BLOCK_ROWS", limit)
    rng = random.Random(limit)
    rows = [row for conv in range(60) for row in talk(rng, conv, rng.randrange(1, 12))]
    rows += talk(rng, None, 30) + [(77, i, "user" if i % 2 else "assistant", f"u{i}.") for i in range(40)]
    check(spark, rows + rows[:9])


def test_repeated_rows_of_a_heap(spark, monkeypatch):
    monkeypatch.setattr(repair, "HEAP", 5)
    check(spark, [(1, 2, "user", "same.")] * 40 + [(1, 3, "assistant", "b.")] + [(1, None, "user", "")] * 12 + [(2, 0, "system", "s."), (2, 1, "user", "q?")])


def test_empty_table_and_lost_conversations(spark):
    assert got(spark, []) == {}
    turns = [t for t in range(400) if zlib.crc32(f"5:{t}".encode()) % 20 == 0][:3]
    row = got(spark, [(5, t, "user", "a.") for t in turns])[5]
    assert row["audit"] == "" and row["cost"] == row["gaps"] == 0 and row["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


def test_turns_are_the_repaired_text(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "hello."), (1, 2, "user", "x" * 3_000_000 + "."), (1, 3, "assistant", "y.")], SCHEMA).withColumn("lost", F.lit(False))
    rows = repair.turns(repair.repair(df)[0]).orderBy("part", "block", "at").collect()
    assert [(r.role, len(r.text)) for r in rows] == [("user", 0), ("assistant", 6), ("user", 3_000_001), ("assistant", 2)]
