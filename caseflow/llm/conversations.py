"""Conversation structure repair by Hirschberg's divide and conquer.

A conversation's rows, by turn, become one of sixteen kinds (role initial and fault). Edits lead through four states: nothing yet,
after system, after user, after assistant. A forward vector of four costs from the left end and a backward one from the right end
meet in the middle; of the states with the least sum the one whose audit is ASCII-least is the crossing, and both halves recurse, so
only vectors and no table are held. Audits that lead to different states of one place are never prefixes of each other (each ends
with the edit of the same row), so forward vectors carry, besides costs, the order of the four least audits, which settles every tie.

The same recursion works on blocks: a conversation that lies in several range partitions or exceeds a block is cut into blocks, each
block is summed up as its 4 x 4 costs and order of audits, the crossings between blocks are found from these, and then every block
is solved where it lies. So rows of one conversation are spread over tasks whatever its share of all rows; one task sees one audit
letter for each row of it. Only the reading out of the repaired rows in order passes one conversation through one task, as a stream.

Defined results: nulls of role and text are one blank, a null conv_id is a conversation of its own; rows are ordered by turn (nulls
first), then role, the first 40 characters of the text and its SHA-256; a role that begins with none of s, u, a (case counts, an
empty role too) can't be kept; repeated rows are duplicates; a blank row is never a duplicate; an empty table gives no rows; extra
columns are left out. Inserted rows have an empty text.
"""

from __future__ import annotations

import hashlib
from functools import partial
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

INF = 1 << 40
SYSTEM, USER, ASSISTANT = 1, 2, 3
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
FAULTS = ("", "blank", "duplicate", "truncated")
#: Rows of a block at most.
BLOCK = 65_536
#: Rows that a task keeps before it hands them on.
BATCH = 10_000
#: Different (vector, kind) steps that a task remembers.
REMEMBERED = 200_000
#: What closes a conversation that ends in each state.
CLOSING = ("", "II", "I", "")
ORDER = ("turn", "role", "head", "h")


def _inserted(state: int) -> int:
    return ASSISTANT if state == USER else USER


def _kind(initial: int, fault: int) -> tuple[list[list[int]], list[list[str]]]:
    """Costs and least audits of one row of a kind, from state to state, inserts before the row included."""
    cost, word = [[INF] * 4 for _ in range(4)], [[""] * 4 for _ in range(4)]
    for p in range(4):
        state, lead = p, ""
        for _ in range(4):
            edits = [("D", DELETE, state)]
            if fault in (0, 3):
                late = TRUNCATED * (fault == 3)
                follows = {SYSTEM: state == 0, USER: state != USER, ASSISTANT: state == USER}
                if follows.get(initial):
                    edits.append(("K", KEEP + late, initial))
                edits.append(("R", REROLE + late, _inserted(state)))
            for letter, c, to in edits:
                new = (c + INSERT * len(lead), lead + letter)
                if new < (cost[p][to], word[p][to]):
                    cost[p][to], word[p][to] = new
            state, lead = _inserted(state), lead + "I"
    return cost, word


KINDS = [_kind(i, f) for i in (SYSTEM, USER, ASSISTANT, 0) for f in range(4)]


def _unit(state: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    return tuple(0 if s == state else INF for s in range(4)), (0, 0, 0, 0)


def _forward(vector, element):
    """The vector after an element: least costs, and the order of the least audits that lead to each state."""
    (cost, rank), (steps, words) = vector, element
    out, keys = [], []
    for s in range(4):
        c, r, p = min((cost[p] + steps[p][s], rank[p], p) for p in range(4))
        out.append(min(c, INF))
        keys.append((r, words[p][s]) if c < INF else None)
    names = {k: i for i, k in enumerate(sorted({k for k in keys if k is not None}))}
    return tuple(out), tuple(names.get(k, 0) for k in keys)


def _backward(costs, element):
    return tuple(min(INF, *(element[0][p][s] + costs[s] for s in range(4))) for p in range(4))


class _Rows:
    """Steps over kinds of rows; vectors are kept relative to their least cost, so few different ones occur."""

    def __init__(self):
        self.ahead, self.back = {}, {}

    def forward(self, vector, kind):
        new = self.ahead.get((vector, kind))
        if new is None:
            cost, rank = _forward(vector, KINDS[kind])
            low = min(cost)
            new = tuple(c if c >= INF else c - low for c in cost), rank
            if len(self.ahead) >= REMEMBERED:
                self.ahead.clear()
            self.ahead[vector, kind] = new
        return new

    def backward(self, costs, kind):
        new = self.back.get((costs, kind))
        if new is None:
            new = _backward(costs, KINDS[kind])
            low = min(new)
            new = tuple(c if c >= INF else c - low for c in new)
            if len(self.back) >= REMEMBERED:
                self.back.clear()
            self.back[costs, kind] = new
        return new


def crossings(elements, start: int, end: int, forward=_forward, backward=_backward) -> list[tuple[int, int]]:
    """(state before, state after) of each element on the cheapest, then audit-least, way from start to end."""
    out, todo = [], [(0, len(elements), start, end)]
    while todo:
        a, b, p, s = todo.pop()
        if b - a <= 1:
            out += [(p, s)] * (b - a)
            continue
        mid = (a + b) // 2
        left, right = _unit(p), _unit(s)[0]
        for i in range(a, mid):
            left = forward(left, elements[i])
        for i in range(b - 1, mid - 1, -1):
            right = backward(right, elements[i])
        meet = min(range(4), key=lambda m: (left[0][m] + right[m], left[1][m]))
        todo += [(mid, b, meet, s), (a, mid, p, meet)]
    return out


def _last(vector) -> int:
    """The state in which the cheapest, then audit-least, way ends, closing inserts counted."""
    return min(range(4), key=lambda s: (vector[0][s] + INSERT * len(CLOSING[s]), vector[1][s]))


def _solve(rows: _Rows, kinds: bytes, start: int, end: int | None) -> tuple[str, int]:
    """(audit, state at the end) of a block; without an end, of a whole conversation, closed."""
    whole = end is None
    if whole:
        vector = _unit(start)
        for k in kinds:
            vector = rows.forward(vector, k)
        end = _last(vector)
    ways = crossings(kinds, start, end, rows.forward, rows.backward)
    return "".join(KINDS[k][1][p][s] for k, (p, s) in zip(kinds, ways)) + (CLOSING[end] if whole else ""), end


def audit(kinds: bytes) -> str:
    """The cheapest edits' initials for the kinds of a conversation's rows, the ASCII-least among them."""
    return _solve(_Rows(), kinds, 0, None)[0]


def _summary(kinds: bytes):
    """Costs and order of audits of a block, from every state to every state."""
    cost, order = [], []
    for p in range(4):
        vector = _unit(p)
        for k in kinds:
            vector = _forward(vector, KINDS[k])
        cost.append(list(vector[0]))
        order.append(list(vector[1]))
    return cost, order


#: White space that doesn't count as text.
SPACE = " \t\n\x0b\f\r"


def _marked(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) with what orders and names them."""
    text = F.col("text")
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "copies", F.substring(text, 1, 40).alias("head"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("h"))


def _named(rows: DataFrame) -> DataFrame:
    """One row per different row of a conversation, with its number of copies and the kind of the first of them."""
    marked = rows.withColumn("end", F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1)))
    same = marked.groupBy("conv_id", "turn", "role", "head", "h").agg(F.sum("copies").alias("copies"), F.first("end").alias("end"))
    when = F.struct(F.col("turn").isNotNull().alias("set"), "turn")
    again = same.groupBy("conv_id", "role", "h").agg(F.min(when).alias("seen"), F.count("*").alias("turns")).where("turns > 1").toDF("conv_2", "role_2", "h_2", "seen", "turns")
    on = same["conv_id"].eqNullSafe(again["conv_2"]) & (same["role"] == again["role_2"]) & (same["h"] == again["h_2"])
    end, role = F.col("end"), F.col("role")
    fault = F.when(end == "", 1).when(F.col("seen").isNotNull() & ~F.col("seen.turn").eqNullSafe(F.col("turn")), 2).when(~end.isin(".", "!", "?"), 3).otherwise(0)
    initial = F.when(role.startswith("s"), 0).when(role.startswith("u"), 1).when(role.startswith("a"), 2).otherwise(3)
    return same.join(again, on, "left").select("conv_id", "turn", "role", "head", "h", "copies", (4 * initial + fault).cast("int").alias("kind"))


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _blocks(batches, block):
    """Runs of one conversation in a range partition, cut into blocks of kinds."""
    pid, blk, cur, out = TaskContext.get().partitionId(), 0, None, []
    kinds, first, last, turns = bytearray(), None, None, 0

    def close():
        nonlocal blk, kinds, first, last, turns
        if kinds:
            out.append((cur[0], pid, blk, bytes(kinds), first, last, turns))
            blk, kinds, first, last, turns = blk + 1, bytearray(), None, None, 0

    for batch in batches:
        schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("pid", pa.int32()), ("blk", pa.int64()), ("kinds", pa.binary()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("n_turns", pa.int64())])
        for conv, turn, copies, kind in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "copies", "kind"))):
            if cur != (conv,):
                close()
                cur = (conv,)
            later = kind if kind % 4 == 1 else kind - kind % 4 + 2  # further copies of a row are duplicates, if not blank
            while copies:
                if len(kinds) >= block:
                    close()
                if turn is not None and turn != last:
                    first, last, turns = turn if first is None else first, turn, turns + 1
                take = min(copies, block - len(kinds))
                kinds += bytes([kind]) + bytes([later]) * (take - 1)
                kind, copies = later, copies - take
        if len(out) >= BATCH:
            yield _arrow(out, schema)
            out = []
    close()
    if out:
        yield _arrow(out, schema)


def _summaries(batches):
    for batch in batches:
        keys = ("conv_id", "pid", "blk")
        sums = [_summary(k) for k in batch["kinds"].to_pylist()]
        flat = lambda i: pa.array([[x for row in s[i] for x in row] for s in sums], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), flat(0), flat(1)], names=[*keys, "cost", "rank"])


def _by_conversation(batches, columns):
    """(conv_id, its rows as tuples) one after the other, as a stream."""
    rows = (r for b in batches for r in zip(*(b[c].to_pylist() for c in columns)))
    return groupby(rows, key=lambda r: r[0])


def _crossed(batches):
    """States before and after each block of the conversations that have several."""
    columns, out = ("conv_id", "pid", "blk", "cost", "rank"), []
    batches = iter(batches)
    for head in batches:
        schema = pa.schema([head.schema.field(c) for c in columns[:3]] + [("start", pa.int32()), ("end", pa.int32()), ("closes", pa.bool_())])
        for _, rows in _by_conversation(_chain(head, batches), columns):
            rows = list(rows)
            square = lambda x: [x[i : i + 4] for i in range(0, 16, 4)]
            elements = [(square(r[3]), square(r[4])) for r in rows]
            vector = _unit(0)
            for e in elements:
                vector = _forward(vector, e)
            ways = crossings(elements, 0, _last(vector))
            out += [(*r[:3], p, s, i == len(rows) - 1) for i, (r, (p, s)) in enumerate(zip(rows, ways))]
            if len(out) >= BATCH:
                yield _arrow(out, schema)
                out = []
        if out:
            yield _arrow(out, schema)


def _chain(head, rest):
    yield head
    yield from rest


def _audits(batches):
    """Audit and counts of every block."""
    rows = _Rows()
    for batch in batches:
        out = []
        for kinds, start, end, closes in zip(*(batch[c].to_pylist() for c in ("kinds", "start", "end", "closes"))):
            letters, end = _solve(rows, kinds, start or 0, end)
            if closes:
                letters += CLOSING[end]
            initials = bytes(k // 4 for k in kinds)
            legal = sum(initials.count(pair) for pair in LEGAL)
            counts = [sum(kinds.count(bytes([4 * i + f])) for i in range(4)) for f in (1, 2, 3)]
            cut = sum(k % 4 == 3 for k, edit in zip(kinds, letters.replace("I", "")) if edit != "D") if counts[2] else 0
            cost = DELETE * letters.count("D") + REROLE * letters.count("R") + INSERT * letters.count("I") + TRUNCATED * cut
            out.append((letters, *counts, len(kinds) - 1 - legal, initials[0], initials[-1], cost))
        names = ["audit", "blank", "duplicate", "truncated", "illegal", "opens", "ends", "cost"]
        cols = [pa.array(c, pa.string() if n == "audit" else pa.int64()) for n, c in zip(names, zip(*out))]
        keep = ["conv_id", "pid", "blk", "first_turn", "last_turn", "n_turns"]
        if out:
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keep), *cols], names=keep + names)


#: Adjacent initials that are legal, as places in "sua": system-user, user-assistant, assistant-user. No pair overlaps itself.
LEGAL = (bytes([0, 1]), bytes([1, 2]), bytes([2, 1]))
PARTS = "first_turn long, last_turn long, n_turns long, audit string, blank long, duplicate long, truncated long, illegal long, opens long, ends long, cost long"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def audits(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per block of each conversation, in order of (pid, blk): its audit and counts. rows: (conv_id, turn, role, text, copies)."""
    kind = dict(rows.dtypes)["conv_id"]
    named = cut_lineage(_named(_marked(rows)), "talk-rows")
    ranged = named.repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER)
    blocks = cut_lineage(ranged.mapInArrow(partial(_blocks, block=block), f"conv_id {kind}, pid int, blk long, kinds binary, first_turn long, last_turn long, n_turns long"), "talk-blocks")
    several = blocks.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("conv_2"))
    parted = blocks.join(several, F.col("conv_id").eqNullSafe(F.col("conv_2")), "left_semi")
    sums = parted.select("conv_id", "pid", "blk", "kinds").mapInArrow(_summaries, f"conv_id {kind}, pid int, blk long, cost array<long>, rank array<long>")
    ways = sums.repartition("conv_id").sortWithinPartitions("conv_id", "pid", "blk").mapInArrow(_crossed, f"conv_id {kind}, pid int, blk long, start int, end int, closes boolean")
    ways = ways.select(F.col("pid").alias("pid_2"), F.col("blk").alias("blk_2"), "start", "end", "closes")  # (pid, blk) is a key of blocks
    met = blocks.join(ways, (F.col("pid") == F.col("pid_2")) & (F.col("blk") == F.col("blk_2")), "left").select(*blocks.columns, "start", "end", "closes")
    return met.mapInArrow(_audits, f"conv_id {kind}, pid int, blk long, {PARTS}")


def _walk(batches):
    """From audits (tag 1) and then rows (tag 2) of each conversation: a row with its sums, then its repaired rows."""
    columns = ("conv_id", "tag", "audit", "first_turn", "last_turn", "n_turns", *COUNTS[1:], "opens", "ends", "role", "text", "copies")
    batches, out = iter(batches), []
    for head in batches:
        cid = head.schema.field("conv_id").type
        schema = pa.schema([("conv_id", cid), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()), ("audit", pa.string()), *((c, pa.int64()) for c in COUNTS)])
        size = 0
        for conv, rows in _by_conversation(_chain(head, batches), columns):
            letters, sums, first, last, turns, ends = [], dict.fromkeys(COUNTS[1:], 0), None, None, 0, None
            state = place = at = 0
            lines, started = [], False

            def insert():
                nonlocal state, at
                while at < len(letters) and letters[at] == "I":
                    state, at = _inserted(state), at + 1
                    yield "I", ("user", "assistant")[state - USER], ""

            for row in rows:
                if row[1] < 2:
                    if row[2] is not None:
                        _, _, part, t0, t1, n, *counts = row[:13]
                        letters.append(part)
                        for c, v in zip(COUNTS[1:], counts[:5]):
                            sums[c] += v
                        sums["illegal"] += ends is not None and bytes([ends, counts[5]]) not in LEGAL
                        ends = counts[6]
                        if n:
                            turns += n - (last is not None and last == t0)
                            first, last = t0 if first is None else first, t1
                    continue
                if not started:
                    started, letters = True, "".join(letters)
                    gaps = last - first + 1 - turns if turns else 0
                    out.append((conv, None, None, None, None, letters, gaps, *sums.values()))
                role, text, copies = row[13:]
                for _ in range(copies):
                    lines = list(insert())
                    edit, at = letters[at], at + 1
                    if edit == "R":
                        state = _inserted(state)
                        lines.append(("R", ("user", "assistant")[state - USER], text))
                    elif edit == "K":
                        state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                        lines.append(("K", role, text))
                    for line in lines:
                        out.append((conv, place, *line, None, *[None] * len(COUNTS)))
                        place, size = place + 1, size + len(line[2])
                if len(out) >= BATCH or size > BATCH * 400:
                    yield _arrow(out, schema)
                    out, size = [], 0
            if not started:
                out.append((conv, None, None, None, None, "", 0, *sums.values()))
            else:
                for line in insert():
                    out.append((conv, place, *line, None, *[None] * len(COUNTS)))
                    place += 1
        if out:
            yield _arrow(out, schema)


def repair(rows: DataFrame, conversations: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Repaired conversations. rows: (conv_id, turn, role, text); with a column `copies`, a row counts that many times.

    For each conversation, also those of `conversations` (conv_id) without rows: a row with null place, its audit and its counts; then,
    by place from 0, the repaired rows (edit, role, text). The rows of a conversation come together and in order within a partition.
    """
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    filled = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), copies.alias("copies"))
    parts = audits(filled, block)
    kind = dict(rows.dtypes)["conv_id"]
    names = (conversations if conversations is not None else rows).select("conv_id").distinct().withColumn("tag", F.lit(0))
    both = names.unionByName(parts.withColumn("tag", F.lit(1)), True).unionByName(_marked(filled).withColumn("tag", F.lit(2)), True)
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "tag", "pid", "blk", *ORDER)
    return ordered.mapInArrow(_walk, f"conv_id {kind}, place long, edit string, role string, text string, audit string, " + ", ".join(f"{c} long" for c in COUNTS))


def _digests(batches):
    columns, out = ("conv_id", "role", "text", "audit", *COUNTS, "place"), []
    batches = iter(batches)
    for head in batches:
        schema = pa.schema([head.schema.field("conv_id"), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("n_repaired", pa.int64())])
        for conv, rows in _by_conversation(_chain(head, batches), columns):
            digest, n = hashlib.sha256(), 0
            for row in rows:
                if row[-1] is None:
                    first = row
                else:
                    digest.update((f"\n{row[1]}:{row[2]}" if n else f"{row[1]}:{row[2]}").encode())
                    n += 1
            out.append((conv, *first[4:10], first[3], digest.hexdigest(), n))
            if len(out) >= BATCH:
                yield _arrow(out, schema)
                out = []
        if out:
            yield _arrow(out, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage: (conv_id, turn, role, text, copies)."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    role, text = name("role"), name("text")
    return conversations.select(
        "conv_id", "turn", F.when(d == 4, "user").otherwise(role).alias("role"),
        F.when(d == 1, "").when(d == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.when(d == 3, 2).otherwise(1).alias("copies"), d.alias("d"),
    ).where("d <> 0").drop("d")


def report(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, n_repaired) of every conv_id."""
    kind = dict(conversations.dtypes)["conv_id"]
    fixed = repair(damaged(conversations), conversations, block)
    return fixed.mapInArrow(_digests, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string, n_repaired long")
