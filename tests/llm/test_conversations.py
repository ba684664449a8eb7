"""Repaired conversations against a Viterbi that carries whole audits, and against every audit there is."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from caseflow.llm import conversations as C

SPACE = " \t\n\x0b\f\r"


def follow(state, role):
    if role == "s":
        return "s" if state == "" else None
    if role == "u":
        return "u" if state != "u" else None
    return "a" if role == "a" and state == "u" else None


def best(rows):
    """rows: (initial, fault). The least (cost, audit), by whole strings."""
    ways = {"": (0, "")}

    def inserts(ways):
        for _ in range(4):
            for s, (c, w) in list(ways.items()):
                to = "a" if s == "u" else "u"
                ways[to] = min(ways.get(to, (9e9, "")), (c + 3, w + "I"))
        return ways

    for initial, fault in rows:
        new = {}
        for s, (c, w) in inserts(dict(ways)).items():
            options = [(c + 4, w + "D", s)]
            if fault in (0, 3):
                late = 3 * (fault == 3)
                if follow(s, initial):
                    options.append((c + late, w + "K", follow(s, initial)))
                options.append((c + 3 + late, w + "R", "a" if s == "u" else "u"))
            for cost, word, to in options:
                new[to] = min(new.get(to, (9e9, "")), (cost, word))
        ways = new
    ways = inserts(ways)
    return min(ways[s] for s in ("", "a") if s in ways)


def price(rows, word):
    """Cost of an audit, None where it isn't one for these rows."""
    i, state, cost = 0, "", 0
    for e in word:
        if e == "I":
            state, cost = "a" if state == "u" else "u", cost + 3
            continue
        if i == len(rows):
            return None
        initial, fault = rows[i]
        i += 1
        if e == "D":
            cost += 4
        elif fault in (1, 2):
            return None
        else:
            to = follow(state, initial) if e == "K" else "a" if state == "u" else "u"
            if not to:
                return None
            state, cost = to, cost + (3 if e == "R" else 0) + (3 if fault == 3 else 0)
    return cost if i == len(rows) and state in ("", "a") else None


def kinds(rows):
    return bytes(4 * "sua?".index(i) + f for i, f in rows)


def test_every_audit_of_short_conversations():
    rng = random.Random(1)
    for _ in range(60):
        rows = [(rng.choice("suua?"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 3))]
        words = ("".join(w) for n in range(len(rows) + 3) for w in itertools.product("DIKR", repeat=n))
        want = min((price(rows, w), w) for w in words if price(rows, w) is not None)
        assert (price(rows, C.audit(kinds(rows))), C.audit(kinds(rows))) == want == best(rows)


def test_long_conversations():
    rng = random.Random(2)
    for n in [1, 2, 3, 5, 8, 13, 40, 200, 1000]:
        for _ in range(20 if n < 1000 else 3):
            rows = [(rng.choice("suuaa?"), rng.choice([0] * 6 + [1, 2, 3])) for _ in range(n)]
            assert C.audit(kinds(rows)) == best(rows)[1]


def plain(table):
    """The contract, conversation by conversation."""
    by = {}
    for conv, turn, role, text in table:
        out = by.setdefault(conv, [])
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    res = []
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:40].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in rows:
            bare = text.strip(SPACE)
            faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
            seen.add((role, text))
        first = [r[1][:1] for r in rows]
        turns = {r[0] for r in rows if r[0] is not None}
        cost, word = best([(i or "?", f) for i, f in zip(first, faults)])
        fixed, state, at = [], "", 0
        for e in word:
            if e == "D":
                at += 1
                continue
            if e != "K":
                role = "assistant" if state == "u" else "user"
            else:
                role = rows[at][1]
            state = role[0]
            fixed.append(f"{role}:{'' if e == 'I' else rows[at][2]}")
            at += e != "I"
        res.append((
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in (1, 2, 3)),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, word, hashlib.sha256("\n".join(fixed).encode()).hexdigest(),
        ))
    return sorted(res, key=str)


def got(df):
    return sorted((tuple(r)[:9] for r in df.collect()), key=str)


def case(rng, convs, most):
    out = []
    for c in range(convs):
        for t in range(rng.randint(1, most)):
            out.append((c, rng.choice([t, t, t, t + 3, None]), rng.choice(["user", "assistant", "assistant", "system", "tool", "", None, "User"]), rng.choice(["Yes.", "No", "  ", "", None, "what?", "é\n!", "a" * 50 + "x.", "a" * 50 + "y."])))
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block", [65_536, 3])
def test_cases(spark, block):
    rng = random.Random(3)
    table = case(rng, 60, 12) + [(None, None, None, None), (None, 5, "user", "Hi."), (7, 1, "user", "Yes.")] * 2
    hot = [(1000, t, rng.choice(["user", "assistant"]), f"{rng.choice(['same', t])}{rng.choice('.,')}") for t in range(3000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in table + hot], SCHEMA + ", copies int, tag string").repartition(5)
    assert got(C.report(df, block)) == plain(table + hot)


def test_empty_and_all_dropped(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert C.report(df).collect() == []
    gone = [(c, t, "user", "Hi.") for c in range(200) for t in range(2) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    rows = got(C.report(spark.createDataFrame(gone, SCHEMA)))
    assert rows == plain(gone) and {r[-1] for r in rows} == {hashlib.sha256(b"").hexdigest()}


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert got(C.report(df)) == plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_repaired_rows_are_well_formed(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    by = {}
    for r in C.repair(df).where("place is not null").collect():
        by.setdefault(r.conv_id, []).append((r.place, r.role[0]))
    assert by and all(re.fullmatch("(s?(ua)+)?", "".join(x for _, x in sorted(v))) and [p for p, _ in sorted(v)] == list(range(len(v))) for v in by.values())
