"""Conversation structure repair by Hirschberg's divide and conquer over four-state cost vectors.

The role initials of a conversation must read `(s?(ua)+)?`. States: 0 nothing yet, 1 after s, 2
after u, 3 after a; 0 and 3 may end. A row is kept (K, 0), given the role that the state asks for
(R, 2) or deleted (D, 3; the only choice for blank and repeated rows); a turn without text may be
inserted before it or at the end (I, 2); a truncated row that stays adds 1. In every state one
letter is due, so an audit, the edits' initials, fixes the repaired conversation.

`edits` finds the cheapest audit, the ASCII-least of equal ones, in linear space: forward costs
from the left and backward costs from the right meet in the middle, the crossing state is chosen,
both halves recurse. A crossing is taken just after a row is used up, so no audit of a left half
is the beginning of another one: their ASCII order alone decides between crossings of equal cost.
The forward vector carries this order as a rank for each state.

Rows are range-partitioned by conversation and turn and streamed in order. A conversation that
begins and ends inside a partition and fits a block is repaired there. The others are cut into
blocks of BLOCK_ROWS rows or PIECE_BYTES of text; a block's forward vectors from all four states are
a small matrix, the matrices of a conversation meet by the same crossing rule at the blocks' ends,
and each block is repaired by itself between its crossing states. More than HEAP equal rows of one
turn travel as one row with their number.

Null conv_id: one conversation. Null role or text: one space. Null turns come first; rows of one
turn go by role, then text. Empty table: no rows. A conversation without rows left: zeros, empty
audit. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import BROADCAST_ROWS, PIECE_BYTES, dropped, few, pick, pieces, saved

BLOCK_ROWS, HEAP = 2_000, 1_000
#: Edit costs; NO is the cost of what can't be done.
REROLE, DELETE, INSERT, TRUNCATED, NO = 2, 3, 2, 1, 1 << 50
#: The letter that each state asks for, the state after a letter, the inserts that end a conversation.
DUE, NEXT, TRAIL = "uuau", {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}, ("", "II", "I", "")
END = tuple(INSERT * len(t) for t in TRAIL)
ROLES = {"u": "user", "a": "assistant"}
#: Row codes: 2 * (place of the initial in LETTERS, 3 for others) + truncated; GONE must be deleted.
LETTERS, GONE = "sua", 8
LEGAL = {(0, 1), (1, 2), (2, 1)}
STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
SPACE = " \t\n\x0b\x0c\r"
LETTER = "[^\\x20\\x09-\\x0D]"


def _steps(code: int) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, edits) over one row: up to two inserts, then the row's own edit; the best of each pair."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start in range(4):
        state, cost, edits = start, 0, ""
        for _ in range(3):
            offers = [(state, DELETE, "D")]
            if code != GONE:
                letter, more = (LETTERS + "?")[code // 2], TRUNCATED * (code % 2)
                offers.append((NEXT[state, DUE[state]], REROLE + more, "R"))
                if (state, letter) in NEXT:
                    offers.append((NEXT[state, letter], more, "K"))
            for to, price, edit in offers:
                best[start, to] = min(best.get((start, to), (NO, "")), (cost + price, edits + edit))
            state, cost, edits = NEXT[state, DUE[state]], cost + INSERT, edits + "I"
    return [(a, b, cost, edits) for (a, b), (cost, edits) in sorted(best.items())]


STEPS = [_steps(code) for code in range(GONE + 1)]


def forward(codes: bytes, start: int) -> tuple[list[int], list[int]]:
    """Costs of the four states after all rows, and the ASCII ranks of their cheapest audits."""
    costs, ranks = [NO] * 4, [0] * 4
    costs[start] = 0
    for code in codes:
        best: list[tuple | None] = [None] * 4
        for a, b, price, edits in STEPS[code]:
            if costs[a] < NO:
                offer = (costs[a] + price, ranks[a], edits)
                if best[b] is None or offer < best[b]:
                    best[b] = offer
        costs = [o[0] if o else NO for o in best]
        order = sorted((o[1:], s) for s, o in enumerate(best) if o)
        ranks = [0] * 4
        for rank, (_, s) in enumerate(order):
            ranks[s] = rank
    return costs, ranks


def backward(codes: bytes, end: tuple[int, ...]) -> tuple[int, ...]:
    """Costs from each of the four states before the rows to the end costs after them."""
    for code in reversed(codes):
        now = [NO] * 4
        for a, b, price, _ in STEPS[code]:
            now[a] = min(now[a], price + end[b])
        end = tuple(now)
    return end


def crossing(costs: list[int], ranks: list[int], rest: tuple[int, ...]) -> int:
    """The state of the cheapest way through, of equal ones that with the least audit before it."""
    return min(range(4), key=lambda s: (costs[s] + rest[s], ranks[s]))


def only(state: int) -> tuple[int, ...]:
    return tuple(0 if s == state else NO for s in range(4))


def edits(codes: bytes, start: int, end: tuple[int, ...]) -> tuple[str, int]:
    """(audit, last state) of the rows from the start state to the end costs; inserts after the last row are not in it."""
    if not codes:
        return "", start
    if len(codes) == 1:
        _, audit, to = min((price + end[b], letters, b) for a, b, price, letters in STEPS[codes[0]] if a == start)
        return audit, to
    middle = len(codes) // 2
    costs, ranks = forward(codes[:middle], start)
    state = crossing(costs, ranks, backward(codes[middle:], end))
    left, _ = edits(codes[:middle], start, only(state))
    right, last = edits(codes[middle:], state, end)
    return left + right, last


@functools.lru_cache(maxsize=5_000)
def whole(codes: bytes) -> tuple[str, int]:
    """(audit, cost) of a conversation."""
    audit, last = edits(codes, 0, END)
    return audit + TRAIL[last], backward(codes, END)[0]


def carried_out(codes: bytes, rows: list[tuple[str, str]], audit: str, state: int) -> list[tuple[str, str]]:
    """The repaired (role, text) turns; rows: those of codes other than GONE."""
    out, code, row = [], iter(codes), iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" or next(code) == GONE else next(row)
        if edit == "D":
            continue
        due = role[:1] if edit == "K" else DUE[state]
        out.append((role if edit == "K" else ROLES[due], text))
        state = NEXT[state, due]
    return out


class Block:
    """Rows of one conversation that are still to be repaired, with their sums."""

    def __init__(self) -> None:
        self.codes, self.rows, self.size = bytearray(), [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first, self.last, self.low, self.high = -1, -1, None, None

    def add(self, turn: int | None, role: str, text: str, blank: bool, early: bool, cut: bool, n: int) -> None:
        initial = LETTERS.index(role[0]) if role and role[0] in LETTERS else 3
        if self.codes:
            self.illegal += (self.last, initial) not in LEGAL
        else:
            self.first = initial
        self.illegal += n - 1
        self.last = initial
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        again = 0 if blank else n if early else n - 1
        self.blank += n if blank else 0
        self.duplicate += again
        if not blank and again < n:
            self.truncated += cut
            self.codes.append(2 * initial + cut)
            self.rows.append((role, text))
            self.size += len(text)
            n -= 1
        self.codes += bytes([GONE]) * n

    def full(self) -> bool:
        return len(self.codes) >= BLOCK_ROWS or self.size >= PIECE_BYTES


TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
BLOCKS = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int64()), ("block", pa.int64()), ("done", pa.bool_()), ("audit", pa.string()), ("turns", TURNS)]
    + [(name, pa.int64()) for name in STATS]
    + [("codes", pa.binary()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64()))]
    + [(name, pa.int64()) for name in ("first", "last", "low", "high", "distinct")]
)
BLOCKS_DDL = "conv_id long, part long, block long, done boolean, audit string, turns array<struct<role: string, text: string>>, " + ", ".join(f"{s} long" for s in STATS) + ", codes binary, costs array<long>, ranks array<long>, first long, last long, low long, high long, distinct long"


def _turns(rows: list[tuple[str, str]]) -> list[dict]:
    return [{"role": role, "text": text} for role, text in rows]


def _closed(conv_id, part: int, number: int, b: Block) -> dict:
    audit, cost = whole(bytes(b.codes))
    gaps = b.high - b.low + 1 - b.turns if b.low is not None else 0
    return {"conv_id": conv_id, "part": part, "block": number, "done": True, "audit": audit, "turns": _turns(carried_out(b.codes, b.rows, audit, 0)), "gaps": gaps, "blank": b.blank, "duplicate": b.duplicate, "truncated": b.truncated, "illegal": b.illegal, "cost": cost}


def _open(conv_id, part: int, number: int, b: Block) -> dict:
    vectors = [forward(b.codes, s) for s in range(4)]
    return {"conv_id": conv_id, "part": part, "block": number, "done": False, "turns": _turns(b.rows), "blank": b.blank, "duplicate": b.duplicate, "truncated": b.truncated, "illegal": b.illegal, "codes": bytes(b.codes), "costs": [c for v, _ in vectors for c in v], "ranks": [r for _, v in vectors for r in v], "first": b.first, "last": b.last, "low": b.low, "high": b.high, "distinct": b.turns}


def _batches(rows: Iterator[tuple[int, dict]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of (size, row); a row is a dictionary."""
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n + 100
        if size >= PIECE_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    yield pa.RecordBatch.from_pylist(held, schema=schema)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repairs the conversations that lie inside a sorted partition; blocks of those that may go on beyond it."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()

    def rows() -> Iterator[tuple[int, dict]]:
        block, conv, first, cut, number, before = Block(), None, True, False, 0, None
        started = False
        for batch in pieces(batches):
            for conv_id, turn, role, text, blank, early, truncated, lost, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not started or conv_id != conv:
                    if started:
                        yield block.size, (_open if first or cut else _closed)(conv, part, number, block)
                        first, number = False, number + 1
                    block, conv, cut, before, started = Block(), conv_id, False, None, True
                elif block.full():
                    yield block.size, _open(conv, part, number, block)
                    block, cut, number = Block(), True, number + 1
                if not lost:
                    block.add(turn, role, text, blank, early or before == (turn, role, text), truncated, n)
                    before = (turn, role, text)
        if started:
            yield block.size, _open(conv, part, number, block)

    return _batches(rows(), BLOCKS)


PLAN_DDL = "part long, block long, begin long, end long, final boolean, " + ", ".join(f"t_{s} long" for s in STATS)
PLAN = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("final", pa.bool_())] + [(f"t_{s}", pa.int64()) for s in STATS])


def _plan(blocks: list[dict]) -> list[dict]:
    """Crossing states between a conversation's blocks, and its sums on the first one."""
    costs, ranks, ahead = [0, NO, NO, NO], [0] * 4, [END]
    vectors = []
    for b in blocks:
        vectors.append((costs, ranks))
        offers = [min(((costs[a] + b["costs"][4 * a + s], ranks[a], b["ranks"][4 * a + s]) for a in range(4) if costs[a] < NO and b["costs"][4 * a + s] < NO), default=None) for s in range(4)]
        order = sorted((o[1:], s) for s, o in enumerate(offers) if o)
        costs, ranks = [o[0] if o else NO for o in offers], [0] * 4
        for rank, (_, s) in enumerate(order):
            ranks[s] = rank
    for b in reversed(blocks):
        ahead.append(tuple(min(b["costs"][4 * a + s] + ahead[-1][s] for s in range(4)) for a in range(4)))
    ahead.reverse()
    states = [crossing(*v, rest) for v, rest in zip([*vectors, (costs, ranks)], ahead, strict=True)]
    sums = dict.fromkeys(STATS, 0) | {"cost": ahead[0][0]}
    full = [b for b in blocks if b["first"] >= 0]
    for b in blocks:
        for name in ("blank", "duplicate", "truncated", "illegal"):
            sums[name] += b[name]
    sums["illegal"] += sum((a["last"], b["first"]) not in LEGAL for a, b in zip(full, full[1:], strict=False))
    timed = [b for b in blocks if b["low"] is not None]
    if timed:
        shared = sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:], strict=False))
        sums["gaps"] = timed[-1]["high"] - timed[0]["low"] + 1 - sum(b["distinct"] for b in timed) + shared
    return [{"part": b["part"], "block": b["block"], "begin": states[i], "end": states[i + 1], "final": i + 1 == len(blocks), **({f"t_{s}": sums[s] for s in STATS} if not i else {})} for i, b in enumerate(blocks)]


def _planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple[int, dict]]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["conv_id"] != held[0]["conv_id"]:
                    yield from ((0, r) for r in _plan(held))
                    held = []
                held.append(row)
        if held:
            yield from ((0, r) for r in _plan(held))

    return _batches(rows(), PLAN)


PIECE = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("block", pa.int64()), ("done", pa.bool_()), ("audit", pa.string()), ("turns", TURNS)] + [(s, pa.int64()) for s in STATS])
PIECE_DDL = "conv_id long, part long, block long, done boolean, audit string, turns array<struct<role: string, text: string>>, " + ", ".join(f"{s} long" for s in STATS)


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block between its crossing states."""

    def rows() -> Iterator[tuple[int, dict]]:
        for batch in batches:
            for row in batch.to_pylist():
                audit, last = edits(row["codes"], row["begin"], END if row["final"] else only(row["end"]))
                audit += TRAIL[last] if row["final"] else ""
                turns = carried_out(row["codes"], [(t["role"], t["text"]) for t in row["turns"]], audit, row["begin"])
                yield sum(len(t) for _, t in turns), {"conv_id": row["conv_id"], "part": row["part"], "block": row["block"], "done": False, "audit": audit, "turns": _turns(turns)} | {s: row[f"t_{s}"] for s in STATS}

    return _batches(rows(), PIECE)


def repair(conversations: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Repaired pieces of every conversation and the saved tables behind them, to be dropped after use.

    Input: conv_id, turn, role, text and a boolean `lost` for rows that only keep their conversation
    in the result. Output: conv_id, part, block (a conversation's pieces in order), done (it is the
    only piece), audit, turns (role, text), and on a conversation's first piece gaps, blank,
    duplicate, truncated, illegal and cost; on the others these are null.
    """
    blank = ~F.col("text").rlike(LETTER)
    lines = pick(conversations, "conv_id", "turn", "role", "text", "lost").select("conv_id", "turn", F.when(F.col("lost"), "").otherwise(F.coalesce("role", F.lit(" "))).alias("role"), F.when(F.col("lost"), "").otherwise(F.coalesce("text", F.lit(" "))).alias("text"), "lost")
    lines = lines.withColumn("h", F.when(~F.col("lost") & ~blank, F.sha2("text", 256)))
    seen = saved(lines.where("h is not null").groupBy("conv_id", "turn", "role", "h").agg(F.count("*").alias("n")), "repair-seen")
    tables = [seen]

    def known(rows: DataFrame, table: DataFrame, on: Column) -> DataFrame:
        return rows.join(F.broadcast(table) if few(table, BROADCAST_ROWS) else table, on, "left")

    earliest = F.struct(F.col("turn").isNotNull(), "turn")
    early = saved(seen.groupBy("conv_id", "role", "h").agg(F.min(earliest)["turn"].alias("since"), F.count("*").alias("places")).where("places > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("k"), "since"), "repair-early")
    tables.append(early)
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("k"))
    lines = known(lines, early, same).withColumn("early", F.col("k").isNotNull() & ~F.col("turn").eqNullSafe(F.col("since"))).drop("c", "r", "k", "since")
    lines = lines.withColumn("n", F.lit(1).cast("long"))
    heaps = seen.where(F.col("n") > HEAP).select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("role").alias("r"), F.col("h").alias("k"))
    if not few(heaps, 0):
        same = same & F.col("turn").eqNullSafe(F.col("t"))
        marked = known(lines, heaps, same)
        heaped = marked.where("k is not null").groupBy("conv_id", "turn", "role", "text", "lost", "h", "early").agg(F.sum("n").alias("n"))
        lines = marked.where("k is null").drop("c", "t", "r", "k").unionByName(heaped)
    cut = ~F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1)).isin(".", "!", "?")
    rows = lines.select("conv_id", "turn", "role", "text", blank.alias("blank"), "early", cut.alias("cut"), "lost", "n")
    ordered = rows.repartitionByRange(F.col("conv_id"), F.col("turn"), F.col("role"), F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")
    made = saved(ordered.mapInArrow(_in_order, BLOCKS_DDL), "repair-blocks")
    tables.append(made)
    parts = made.where("not done")
    plan = saved(parts.select("conv_id", "part", "block", "costs", "ranks", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "distinct").repartition("conv_id").sortWithinPartitions("conv_id", "part", "block").mapInArrow(_planned, PLAN_DDL), "repair-plan")
    tables.append(plan)
    joined = parts.select("conv_id", "part", "block", "codes", "turns").join(F.broadcast(plan) if few(plan) else plan, ["part", "block"])
    return made.where("done").select(*PIECE.names).unionByName(joined.mapInArrow(_between, PIECE_DDL)), tables


def turns(repaired: DataFrame) -> DataFrame:
    """(conv_id, part, block, at, role, text): a row for each repaired turn, in the order of the first four columns."""
    return repaired.select("conv_id", "part", "block", F.posexplode("turns").alias("at", "turn")).select("conv_id", "part", "block", "at", "turn.role", "turn.text")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, audit, sums, hash) of conversations whose pieces come in order; texts pass piece by piece."""

    def rows() -> Iterator[tuple[int, dict]]:
        now = None
        for batch in pieces(batches, "audit"):
            for row in batch.to_pylist():
                if now is None or row["conv_id"] != now["conv_id"]:
                    if now is not None:
                        yield ended(now, audit, digest)
                    now, audit, digest, lines = row, [], hashlib.sha256(), 0
                audit.append(row["audit"])
                for turn in row["turns"]:
                    digest.update(("\n" if lines else "").encode() + f"{turn['role']}:{turn['text']}".encode())
                    lines += 1
        if now is not None:
            yield ended(now, audit, digest)

    def ended(row: dict, audit: list[str], digest) -> tuple[int, dict]:
        return sum(map(len, audit)), {"conv_id": row["conv_id"]} | {s: row[s] for s in STATS} | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    return _batches(rows(), pa.schema([("conv_id", pa.int64())] + [(s, pa.int64()) for s in STATS] + [("audit", pa.string()), ("repaired_sha256", pa.string())]))


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    A hash over a conversation is a chain, so pieces of a long one pass through one task, but never lie there together.
    """
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    single = repaired.where("done").select("conv_id", *STATS, "audit", F.sha2(line, 256).alias("repaired_sha256"))
    rest = repaired.where("not done").repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    return single.unionByName(rest.mapInArrow(_digests, "conv_id long, " + ", ".join(f"{s} long" for s in STATS) + ", audit string, repaired_sha256 string"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage by crc32(conv_id:turn) % 20, null parts as one space; dropped rows are marked lost."""
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    rows = pick(conversations, "conv_id", "turn", "role", "text").withColumn("kind", kind)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(space("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("lost"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", "lost", F.explode(F.sequence(F.lit(1), "times")).alias("copy")).drop("copy")


def op11_repair(spark, sf_dir: str) -> DataFrame:
    repaired, tables = repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    out = saved(digests(repaired), "repaired")
    dropped(*tables)
    return out
