"""The edit log as a stream: what ``operators.edits`` says of a whole log, kept as keyed state and told change by change.

Some edits concern every key (clear, load, clear_selection, select, force), and a grouped state cannot reach keys that it is not called for.
So the state is grouped by *shard*, a hash of the key: such edits go to all shards, others to their own, and a shard holds its keys in map states.

Files may come late, twice and in any order.  Each edit has its own ``seq``, and what is kept of a key does not depend on the order of arrival:
the newest write, the nudges and toggles behind the last edit that forgets them, and for each kind of forgetting the newest such edit (these only grow,
so what lies before one can go).  With ``lateness`` a key's nudges that lie that far behind the newest edit of the shard are summed up for good, and
edits that come later still are left out; without it nothing is, and a key's nudges since the last clear stay one by one.

Needs ``spark.sql.streaming.stateStore.providerClass`` set to the RocksDB provider, as all of Spark's map states do.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.edits import stepped
from ..shipping import ship

EDITS = "seq long, kind string, key long, v0 double, v1 double"
CHANGES = "kind string, key long, seq long, v0 double, v1 double, alive boolean, version long"
CHANGE = Row(*(f.split()[0] for f in CHANGES.split(", ")))
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Edits that concern all keys.
FAR = ("clear", "load", "clear_selection", "select", "force")
#: Last writes, with the edits that forget them.
WRITES = {"move_port": ("clear", "load"), "link_rest": ("clear", "load"), "live": ("clear", "load", "force"), "force": ("load",), "bulge": ("load",), "hover": ()}
PICKS = ("select", "add", "toggle")


def read_edit_log(spark, folder: str) -> DataFrame:
    """JSON lines that arrive in a folder."""
    return spark.readStream.schema(EDITS).json(folder)


def walk(curve: float, ways) -> float:
    """Steps one by one, clamped after each."""
    for w in ways:
        curve = stepped(curve, w)
    return curve


class EditState(StatefulProcessor):
    """The edits of one shard.  Map states: ``writes`` (kind, key), ``curves`` (key) and ``picks`` (key)."""

    def __init__(self, lateness: int | None = None):
        self.lateness = lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.marks = handle.getValueState("marks", "clear long, load long, clear_selection long, select long, force long, newest long, version long")
        self.writes = handle.getMapState("writes", "kind string, key long", "seq long, key long, v0 double, v1 double")
        self.curves = handle.getMapState("curves", "key long", "seqs array<long>, steps array<double>, settled double, upto long")
        self.picks = handle.getMapState("picks", "key long", "sure long, toggles array<long>, shown boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803 - Spark's names
        held = self.marks.get()
        marks = dict(zip((*FAR, "newest", "version"), held, strict=True)) if held else dict.fromkeys((*FAR, "newest"), -1) | {"version": 0}
        was = dict(marks)
        writes: dict[tuple, tuple] = {}
        nudges: dict[int, dict[int, float]] = {}
        picks: dict[int, list[tuple[int, bool]]] = {}
        closed = -1 if self.lateness is None else marks["newest"] - self.lateness
        for r in rows:
            if r.seq <= closed:
                continue
            marks["newest"] = max(marks["newest"], r.seq)
            if r.kind in FAR:
                marks[r.kind] = max(marks[r.kind], r.seq)
            if not r.own:
                continue
            if r.kind in WRITES:
                at = (r.kind, -1 if r.kind == "hover" else r.key)
                if at not in writes or writes[at][0] < r.seq:
                    writes[at] = (r.seq, r.key, r.v0, r.v1)
            elif r.kind == "nudge" and r.v0 is not None:
                nudges.setdefault(r.key, {})[r.seq] = float((r.v0 > 0) - (r.v0 < 0))
            elif r.kind in PICKS:
                picks.setdefault(r.key, []).append((r.seq, r.kind != "toggle"))
        out: list[tuple] = []
        self._write(writes, marks, was, out)
        self._nudge(nudges, marks, was, out)
        self._pick(picks, marks, was, out)
        for k, row in enumerate(out):
            yield CHANGE(*row, marks["version"] + k)
        marks["version"] += len(out)
        self.marks.update(tuple(marks.values()))

    @staticmethod
    def _floor(marks: dict, kinds) -> int:
        return max((marks[k] for k in kinds), default=-1)

    def _write(self, new: dict, marks: dict, was: dict, out: list) -> None:
        floors = {kind: self._floor(marks, by) for kind, by in WRITES.items()}
        if any(floors[k] != self._floor(was, by) for k, by in WRITES.items()):
            for at, value in list(self.writes.iterator()):
                if value[0] <= floors[at[0]]:
                    self.writes.removeKey(at)
                    out.append((at[0], value[1], value[0], None, None, False))
        for at, value in new.items():
            old = self.writes.getValue(at)
            if value[0] > floors[at[0]] and (old is None or old[0] < value[0]):
                self.writes.updateValue(at, value)
                out.append((at[0], value[1], value[0], value[2], value[3], True))

    def _nudge(self, new: dict, marks: dict, was: dict, out: list) -> None:
        floor = self._floor(marks, ("clear", "load"))
        if floor != self._floor(was, ("clear", "load")):
            for (key,), value in list(self.curves.iterator()):
                if key not in new and value[0] and value[0][0] > floor and value[3] < 0:
                    continue  # nothing of it is forgotten
                new.setdefault(key, {})
        closed = -1 if self.lateness is None else marks["newest"] - self.lateness
        for key, found in new.items():
            old = self.curves.getValue((key,))
            seqs, steps, settled, upto = old if old else ([], [], 0.0, -1)
            if upto <= floor:
                settled, upto = 0.0, -1
            all_ = sorted((s, v) for s, v in (dict(zip(seqs, steps, strict=True)) | found).items() if s > max(floor, upto))
            if not all_ and upto < 0:
                if old:
                    self.curves.removeKey((key,))
                    out.append(("nudge", key, floor, None, None, False))
                continue
            value = walk(settled, (v for _, v in all_))
            last = all_[-1][0] if all_ else upto
            done = [x for x in all_ if x[0] <= closed]
            if done:
                settled, upto, all_ = walk(settled, (v for _, v in done)), done[-1][0], all_[len(done) :]
            self.curves.updateValue((key,), ([s for s, _ in all_], [v for _, v in all_], settled, upto))
            out.append(("nudge", key, last, value, None, True))

    def _pick(self, new: dict, marks: dict, was: dict, out: list) -> None:
        def bounds(m: dict) -> tuple[int, int]:
            floor = self._floor(m, ("clear_selection", "load"))
            return floor, m["select"] if m["select"] > floor else -1

        floor, start = bounds(marks)
        if (floor, start) != bounds(was):
            for (key,), _ in list(self.picks.iterator()):
                new.setdefault(key, [])
        good = lambda s: s > floor and s >= start
        for key, found in new.items():
            sure, toggles, shown = self.picks.getValue((key,)) or (-1, [], False)
            sure = max([sure, *(s for s, is_sure in found if is_sure)])
            sure = sure if good(sure) else -1
            toggles = sorted({s for s in (*toggles, *(s for s, is_sure in found if not is_sure)) if good(s) and s > sure})
            on = ((sure >= 0) + len(toggles)) % 2 == 1
            if sure < 0 and not toggles:
                if self.picks.containsKey((key,)):
                    self.picks.removeKey((key,))
            else:
                self.picks.updateValue((key,), (sure, toggles, on))
            if on != shown:
                out.append(("selected", key, max([sure, floor, start, *toggles]), None, None, on))

    def close(self) -> None:
        pass


def changes(stream: DataFrame, shards: int = 64, lateness: int | None = None) -> DataFrame:
    """(kind, key, seq, v0, v1, alive, version): what each batch of edits changes, for ``update`` output.

    kinds: those of last writes (hover has the hovered key, which may be null), ``nudge`` (v0: the curve) and ``selected``.  ``alive`` is false where a value was
    forgotten.  Of two changes of a key the one with the larger version holds.  Edits of an unknown kind or without a ``seq`` change nothing.
    """
    ship(stream.sparkSession)
    own = F.when(F.col("kind") == "hover", F.lit(0)).otherwise(F.pmod(F.xxhash64("key"), F.lit(shards))).cast("int")
    to = F.when(F.col("kind").isin(*FAR), F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(own))
    dealt = stream.filter("seq IS NOT NULL").withColumn("_own", own).select("*", F.explode(to).alias("shard")).withColumn("own", F.col("shard") == F.col("_own")).drop("_own")
    return dealt.groupBy("shard").transformWithState(EditState(lateness), CHANGES, "Update", "None")


def current(told: DataFrame) -> DataFrame:
    """(kind, key, v0, v1) that hold, from all changes told so far."""
    slot = F.when(F.col("kind") == "hover", F.lit(-1)).otherwise(F.col("key"))
    last = told.groupBy("kind", slot.alias("slot")).agg(F.max_by(F.struct("key", "v0", "v1", "alive"), "version").alias("e"))
    return last.filter("e.alive").select("kind", "e.key", "e.v0", "e.v1")
