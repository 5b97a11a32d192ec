"""Conversation structure repair: the cheapest edits that turn a conversation into a system turn and user/assistant pairs.

The edits of a conversation form a DAG: a node is (rows consumed, what the output ends with), an edge puts up to two inserted
turns before a row and keeps, re-roles or deletes it.  A path's weight is one integer: its high digits are the cost, its low
digits the letters of the edits at fixed places (a path that is shorter has zeros at its end).  So the ordinary integer minimum at each node
settles cost and ties at once, and the letters are read off the winner.

Two facts keep the integers short.  Letters lead from a node to one node only, so paths to different nodes have different letters; and all paths
end with the row that was consumed, so none begins another.  Hence after every ``BLOCK`` rows the letters so far can be written down and replaced by
one digit, the path's rank among the (at most four) paths that are alive.  Each of these carries its own hash state, so a conversation
streams through a task: what stays in memory is a letter a row, which the result has in any case.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import Scratch, lean, small_batches

BLANKS = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
#: Letters by their digit; 0 is the end padding.  Digits ascend as the letters do.
LETTERS = " DIKR"
BLOCK = 64
PLACES = 3 * BLOCK + 2
RANK_AT = 3 * PLACES
COST_AT = RANK_AT + 2
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: b"user", ASSISTANT: b"assistant"}
#: What a user or assistant turn leads to.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
GOOD_PAIRS = frozenset(["su", "ua", "au"])
SOUND, BLANK, DUPLICATE, CUT, DROPPED = 0, 1, 2, 3, -1


def _inserted(state: int, n: int) -> tuple[int, ...]:
    """The states after each of n inserted turns."""
    out = []
    for _ in range(n):
        state = NEXT[state]
        out.append(state)
    return tuple(out)


def _edges(initial: str, fault: int) -> list[tuple]:
    """Edges over a row: (state before, inserted turns, letter, state after, cost in place, digits, number of letters).

    Three inserted turns in a row end where one does, at a higher cost, so two are enough.
    """
    out = []
    for state in range(4):
        for n in range(3):
            mid = (state, *_inserted(state, n))[-1]
            ends = [("D", mid, DELETE)]
            if fault in (SOUND, CUT):
                more = TRUNCATED if fault == CUT else 0
                ends.append(("R", NEXT[mid], REROLE + more))
                to = {"s": SYSTEM if mid == START else None, "u": USER if NEXT[mid] == USER else None, "a": ASSISTANT if mid == USER else None}.get(initial)
                if to is not None:
                    ends.append(("K", to, KEEP + more))
            for letter, to, cost in ends:
                digits = 0
                for c in "I" * n + letter:
                    digits = digits << 3 | LETTERS.index(c)
                out.append((state, n, letter, to, cost + INSERT * n << COST_AT, digits, n + 1))
    return out


_EDGES: dict[tuple[str, int], list[tuple]] = {}
_LAST = [(START, 0), (SYSTEM, 2), (USER, 1), (ASSISTANT, 0)]


def letters_of(weight: int, n: int) -> str:
    return "".join([LETTERS[weight >> 3 * (PLACES - 1 - k) & 7] for k in range(n)])


class Conversation:
    """One conversation's rows, one after another: faults, and the cheapest paths that are alive."""

    def __init__(self):
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.rows = 0
        self.low = self.high = self.turn = None
        self.before: str | None = None
        self.same = None
        # state -> (weight, letters in the block, hash state, letters before, anything put out)
        self.alive: dict[int, tuple] = {START: (0, 0, hashlib.sha256(), None, False)}
        self.in_block = 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None and (self.high is None or turn != self.turn):
            self.low = turn if self.low is None else self.low
            self.high, self.turn, self.turns = turn, turn, self.turns + 1
        if fault != BLANK and self.same == (turn, role, text):
            fault = DUPLICATE
        self.same = (turn, role, text)
        self.blank += fault == BLANK
        self.duplicate += fault == DUPLICATE
        self.truncated += fault == CUT
        initial = role[:1]
        if self.before is not None:
            self.illegal += self.before + initial not in GOOD_PAIRS
        self.before = initial
        self._step(initial, role, text, fault)

    def _step(self, initial: str, role: str, text: str, fault: int) -> None:
        kind = (initial if initial in ("s", "u", "a") else "", fault)
        edges = _EDGES.get(kind)
        if edges is None:
            edges = _EDGES[kind] = _edges(*kind)
        alive, best = self.alive, {}
        for edge in edges:
            held = alive.get(edge[0])
            if held is not None:
                w = held[0] + edge[4] + (edge[5] << 3 * (PLACES - held[1] - edge[6]))
                old = best.get(edge[3])
                if old is None or w < old[0]:
                    best[edge[3]] = (w, edge)
        raw = text.encode("utf-8", "replace")
        new = {}
        for to, (w, (state, n, letter, _, _, _, size)) in best.items():
            _, used, h, parts, any_ = alive[state]
            turns = [NAMES[s] + b":" for s in _inserted(state, n)]
            if letter != "D":
                turns.append((role.encode("utf-8", "replace") if letter == "K" else NAMES[to]) + b":" + raw)
            if turns:
                h = h.copy()
                h.update((b"\n" if any_ else b"") + b"\n".join(turns))
            new[to] = (w, used + size, h, parts, any_ or bool(turns))
        self.alive = new
        self.in_block += 1
        if self.in_block == BLOCK:
            self._settle()

    def _settle(self) -> None:
        """Write the block's letters down; a path keeps its cost and its rank by letters among those alive."""
        low = (1 << COST_AT) - 1
        order = sorted(self.alive, key=lambda s: self.alive[s][0] & low)
        for rank, s in enumerate(order):
            w, used, h, parts, any_ = self.alive[s]
            self.alive[s] = (w >> COST_AT << COST_AT | rank << RANK_AT, 0, h, (parts, letters_of(w, used)), any_)
        self.in_block = 0

    def close(self) -> tuple:
        """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha256 of what is left)."""
        best = None
        for state, n in _LAST:
            held = self.alive.get(state)
            if held is not None:
                w, used = held[0] + (INSERT * n << COST_AT), held[1]
                for k in range(n):
                    w += LETTERS.index("I") << 3 * (PLACES - 1 - used - k)
                if best is None or w < best[0]:
                    best = (w, used + n, n, state, held)
        w, used, n, state, (_, _, h, parts, any_) = best
        for s in _inserted(state, n):
            h = h.copy()
            h.update((b"\n" if any_ else b"") + NAMES[s] + b":")
            any_ = True
        out = [letters_of(w, used)]
        while parts is not None:
            parts, text = parts
            out.append(text)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, w >> COST_AT, "".join(reversed(out)), h.hexdigest()


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows damaged by the checksum of ``conv_id:turn``, as the query's contract says.

    A null id or turn is one space in the checksum's text and stays null as a column; a null role or text becomes one space.  A row
    that is dropped has 0 copies and no text, one that is repeated has 2.
    """
    cols = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    hit = cols.withColumn("_h", F.crc32(key.cast("binary")) % 20)
    h = F.col("_h")
    text = F.when(h <= 1, F.lit("")).when(h == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return hit.select("conv_id", "turn", F.when(h == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("copies"))


def _checked(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows with their fault.  What was said in an earlier turn is found by digests, without moving texts; equal rows of one turn
    end up side by side and are told by the stream."""
    solid = F.rtrim(F.col("text"), F.lit(BLANKS))
    kind = F.when(F.col("copies") == 0, DROPPED).when(solid == "", BLANK).when(~F.substring(solid, -1, 1).isin(".", "!", "?"), CUT).otherwise(SOUND)
    said = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    when = F.struct(F.col("turn").isNotNull().alias("there"), F.col("turn").alias("turn"))
    rows = rows.withColumn("fault", kind)
    turns = rows.filter(F.col("fault") >= SOUND).filter(F.col("fault") != BLANK).groupBy("conv_id", said.alias("said")).agg(F.min(when).alias("first"), F.max(when).alias("last"))
    again = scratch.save(turns.filter("first < last").select(F.col("conv_id").alias("c"), F.col("said").alias("s"), "first"), "said")
    out = rows.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (said == F.col("s")), "left")
    late = F.col("first").isNotNull() & (when > F.col("first")) & F.col("fault").isin(SOUND, CUT)
    return out.select("conv_id", "turn", "role", "text", "copies", F.when(late, DUPLICATE).otherwise(F.col("fault")).alias("fault"))


def _in_order(rows: DataFrame, *more: str) -> DataFrame:
    first = [F.col(c).asc_nulls_first() for c in ("conv_id", *more, "turn", "role", "text")]
    return rows.repartition("conv_id").sortWithinPartitions(*first)


PLAN = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def plan_repairs(rows: DataFrame) -> DataFrame:
    """The cheapest repair of each conversation of (conv_id, turn, role, text, copies): one row each, as ``PLAN`` names them.

    Rows of a conversation are taken by turn, nulls first, then role and text by their bytes; ``copies`` says how often a row stands
    there (0: it only names its conversation).  A null conv_id is one conversation.  Roles count by their first character: an empty
    or unknown one can only be changed or deleted.  Texts of any length pass one at a time; a conversation of any length passes through
    one task row by row, as its hash has to.  Without rows a conversation costs nothing; an empty table gives an empty result.  Other columns are not read.
    """
    scratch = Scratch(rows.sparkSession, "repair")
    ready = _in_order(_checked(rows.select("conv_id", "turn", "role", "text", "copies"), scratch))

    def run(batches):
        now, key = None, None
        names = [f.split()[0] for f in PLAN.split(", ")]
        for batch in small_batches(batches, "text"):
            out = []
            for conv, turn, role, text, copies, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != key:
                    if now is not None:
                        out.append((key, *now.close()))
                    now, key = Conversation(), conv
                for _ in range(copies):
                    now.add(turn, role, text, fault)
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=SCHEMA)
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (key, *now.close()), strict=True))], schema=SCHEMA)

    return ready.mapInArrow(lean(run), PLAN)


SCHEMA = pa.schema([(f.split()[0], pa.int64() if f.endswith("long") else pa.string()) for f in PLAN.split(", ")])


def repaired_rows(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the conversations after their repair; places count from 0, deleted rows are gone.

    A conversation's plan travels ahead of its rows, so they pass row by row.
    """
    rows = rows.filter("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "copies")
    ahead = plans.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("copies"))
    full = {USER: "user", ASSISTANT: "assistant"}

    def run(batches):
        key, audit, at, state, place, open_ = None, "", 0, START, 0, False

        def inserts(out):
            nonlocal at, state, place
            while at < len(audit) and audit[at] == "I":
                state = NEXT[state]
                out.append(Row(key, place, "I", full[state], ""))
                at, place = at + 1, place + 1

        for batch in small_batches(batches, "text"):
            out: list = []
            for conv, kind, _, role, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    if open_:
                        inserts(out)
                    key, audit, at, state, place, open_ = conv, text, 0, START, 0, True
                for _ in range(copies):
                    inserts(out)
                    letter = audit[at]
                    at += 1
                    if letter != "D":
                        state = NEXT[state] if letter == "R" else {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
                        out.append(Row(key, place, letter, full[state] if letter == "R" else role, text))
                        place += 1
            yield _row_batch(out)
        out = []
        if open_:
            inserts(out)
        yield _row_batch(out)

    return _in_order(rows.union(ahead), "kind").mapInArrow(lean(run), "conv_id long, place long, edit string, role string, text string")


def _row_batch(out: list) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [()] * 5
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["conv_id", "place", "edit", "role", "text"])
