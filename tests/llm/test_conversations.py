"""Conversation repair against the contract restated in plain Python, and against every edit sequence there is."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from contiguum.llm import conversations as cv

GOOD = re.compile(r"(s?(ua)+)?")
COLUMNS = "conv_id long, turn long, role string, text string"


def faults_of(rows):
    out, seen = [], set()
    for _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "" if words[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def outcome(rows, faults, audit):
    """(cost, roles and texts) of an edit sequence, or None if it may not be done."""
    out, at, cost = [], 0, 0
    for c in audit:
        role = "user" if not out or out[-1][0][:1] != "u" else "assistant"
        if c == "I":
            out.append((role, ""))
            cost += 3
            continue
        if at == len(rows):
            return None
        _, old, text = rows[at]
        fault = faults[at]
        at += 1
        if c == "D":
            cost += 4
        elif fault in ("blank", "duplicate"):
            return None
        else:
            cost += 3 * (c == "R") + 3 * (fault == "truncated")
            out.append((old if c == "K" else role, text))
    return (cost, out) if at == len(rows) and GOOD.fullmatch("".join(r[:1] or "?" for r, _ in out)) else None


def cheapest(rows, faults):
    """Plain strings, no integers: the least (cost, letters) from each row and state to the end."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}

    def ends(tail, i):
        # up to two inserted turns are of use
        out = {}
        for state in after:
            options = []
            for n in range(3):
                st = state
                for _ in range(n):
                    st = after[st]
                here = tail(st, i)
                options += [(3 * n + c, "I" * n + a) for c, a in here]
            out[state] = min(options, default=None)
        return out

    best = ends(lambda st, _: [(0, "")] if st in ("", "a") else [], len(rows))
    for i in range(len(rows) - 1, -1, -1):
        _, role, _ = rows[i]
        nxt, fault = best, faults[i]

        def tail(st, i, nxt=nxt, fault=fault, role=role):
            more = 3 * (fault == "truncated")
            moves = [("D", st, 4)]
            if fault not in ("blank", "duplicate"):
                moves.append(("R", after[st], 3 + more))
                if role[:1] == after[st] or (role[:1] == "s" and st == ""):
                    moves.append(("K", role[:1], more))
            return [(c + nxt[to][0], letter + nxt[to][1]) for letter, to, c in moves if nxt[to]]

        best = ends(tail, i)
    return best[""]


def restated(table):
    """The contract over (conv_id, turn, role, text) rows."""
    key = lambda v: (v is not None, v or 0)
    convs: dict = {}
    for conv, turn, role, text in table:
        rows = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(h, text)
        rows += [(turn, "user" if h == 4 else role, text)] * {0: 0, 3: 2}.get(h, 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (key(r[0]), r[1].encode(), r[2].encode()))
        turns = {r[0] for r in rows if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        faults = faults_of(rows)
        cost, audit = cheapest(rows, faults)
        bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        got = outcome(rows, faults, audit)
        assert got[0] == cost
        left = got[1]
        text = "\n".join(f"{r}:{t}" for r, t in left)
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), bad, cost, audit, hashlib.sha256(text.encode()).hexdigest(), left)
    return out


def made(seed, convs, longest):
    rnd = random.Random(seed)
    texts = ["a.", "b!", "c", "d?", "", " \t", "é…", "it ends.  ", "x y. z", None]
    roles = ["user"] * 4 + ["assistant"] * 4 + ["system", "tool", "", None, "us"]
    rows = []
    for c in [*range(convs), None]:
        for t in range(rnd.randrange(longest + 1)):
            turn = rnd.choice([t, t, t, t // 2, None])
            text = rnd.choice(texts)
            rows.append((c, turn, rnd.choice(roles), text + str(rnd.randrange(40)) + "." if text and rnd.random() < 0.6 else text))
            if rnd.random() < 0.1:
                rows.append(rows[-1])
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_no_edit_sequence_is_better(seed):
    rnd = random.Random(seed)
    for _ in range(25):
        rows = [(t, rnd.choice(["user", "assistant", "system", "x"]), rnd.choice(["a.", "b", "", "c?"])) for t in range(rnd.randrange(5))]
        faults = faults_of(rows)
        tried = []
        for n in range(len(rows) + 4):
            for audit in itertools.product("DIKR", repeat=n):
                if len(rows) == n - audit.count("I") and audit.count("I") <= 3 and (got := outcome(rows, faults, audit)):
                    tried.append((got[0], "".join(audit)))
        c = cv.Conversation()
        code = {"": cv.SOUND, "blank": cv.BLANK, "duplicate": cv.DUPLICATE, "truncated": cv.CUT}
        for (turn, role, text), f in zip(rows, faults, strict=True):
            c.add(turn, role, text, code[f])
        assert min(tried) == c.close()[5:7] == cheapest(rows, faults)


def test_repair_equals_the_contract(spark):
    table = made(1, 60, 12) + [(1000, t, r, x) for _, t, r, x in made(2, 1, 400)] + [(1001, k, "system", f"{k}.") for k in range(150)]
    table += [(1002, k, "user", f"{k}.") for k in range(201)] + [(1003, None, None, None), (1004, 5, "assistant", "y" * 300_000 + ".")]
    want = restated(table)
    df = spark.createDataFrame(table, COLUMNS).selectExpr("*", "1 AS copies", "2 AS fault", "3 AS first")
    rows = cv.damage(df)
    plans = cv.plan_repairs(rows)
    got = {r[0]: tuple(r[1:]) for r in plans.collect()}
    assert got == {k: v[:-1] for k, v in want.items()}
    assert {v[6] for v in got.values()} > {""} and sum(v[1] for v in got.values()) and sum(v[2] for v in got.values())
    left: dict = {k: [] for k in want}
    for r in sorted(cv.repaired_rows(rows, plans).collect(), key=lambda r: r.place):
        left[r.conv_id].append((r.role, r.text))
    assert left == {k: v[-1] for k, v in want.items()}


def test_empty(spark):
    df = spark.createDataFrame([], COLUMNS)
    assert cv.plan_repairs(cv.damage(df)).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = cv.plan_repairs(cv.damage(spark.createDataFrame([(gone, 0, "user", "a.")], COLUMNS))).collect()
    assert [tuple(r) for r in row] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
