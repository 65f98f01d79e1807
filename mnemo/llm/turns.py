"""Repair of conversations by Viterbi with survivor coalescence.

The cheapest edits that make a conversation alternate are a path through four states. Every
state keeps one survivor in a tree of backpointers with reference counts; as soon as all
survivors share an ancestor, the edits up to it are final and leave the tree. A conversation is
read as a stream in turn order, so only its unresolved end is ever held.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from mnemo.llm.common import crc_mod

#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, OPENED, ASKED, ANSWERED = range(4)
DONE = (START, ANSWERED)
USER, ASSISTANT = "user", "assistant"
WHITE = " \t\n\x0b\x0c\r"
FAULTS = ("blank", "duplicate", "truncated")


@dataclass(frozen=True)
class EditCosts:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    #: On top, for a truncated turn that stays.
    truncated: int = 5


class _Step:
    """One turn's edits on a path, with the inserts before it; a node of the tree."""

    __slots__ = ("parent", "edits", "kids", "held")

    def __init__(self, parent, edits):
        self.parent, self.edits, self.kids, self.held = parent, edits, [], 0
        if parent is not None:
            parent.kids.append(self)


class Repair:
    """The edits of one conversation, turn by turn: ``add`` each turn, then ``end``.

    Edits are (initial, role): K(eep), R(erole), D(elete), I(nsert). Both calls return steps that
    became final, oldest first, each the edits of one turn: inserts, then the turn's own. The last
    step may be inserts only. ``cost`` is the least cost, known after ``end``.
    """

    def __init__(self, costs: EditCosts):
        self.costs, self.cost = costs, 0
        self.root = _Step(None, ())
        self.root.held = 1
        # Survivors in the order of their edits: (state, cost, step). No two paths over the same
        # turns are a prefix of each other, so this order settles every later tie between them as
        # their complete unresolved ends would.
        self.paths = [(START, 0, self.root)]
        c = costs.insert
        #: What another state pays at most to end as this one would: (other, this) -> cost.
        self.worth = {
            (START, OPENED): 0, (START, ANSWERED): 0, (START, ASKED): c,
            (ANSWERED, OPENED): 0, (ANSWERED, START): costs.delete, (ANSWERED, ASKED): c,
            (OPENED, ASKED): c, (OPENED, ANSWERED): 2 * c, (OPENED, START): 2 * c + costs.delete,
            (ASKED, ANSWERED): c, (ASKED, OPENED): c, (ASKED, START): c + costs.delete,
        }

    def _inserted(self, state: int):
        """(state, cost, edits) with none, one and two inserts; more never pay."""
        edits, total = (), 0
        for _ in range(3):
            yield state, total, edits
            role = ASSISTANT if state == ASKED else USER
            state = ANSWERED if state == ASKED else ASKED
            edits, total = (*edits, ("I", role)), total + self.costs.insert

    def _moves(self, state: int, role: str, gone: bool, extra: int):
        """(state, cost, edit) of one turn."""
        yield state, self.costs.delete, ("D", role)
        if gone:
            return
        after = ANSWERED if state == ASKED else ASKED
        initial = role[:1]
        if initial == "s" and state == START:
            yield OPENED, extra, ("K", role)
        if initial == ("a" if state == ASKED else "u"):
            yield after, extra, ("K", role)
        yield after, self.costs.rerole + extra, ("R", ASSISTANT if state == ASKED else USER)

    def add(self, role: str, fault: str | None) -> list[tuple]:
        best: dict[int, tuple] = {}
        gone, extra = fault in FAULTS[:2], self.costs.truncated if fault == "truncated" else 0
        for place, (state, cost, step) in enumerate(self.paths):
            for mid, paid, inserts in self._inserted(state):
                for after, own, edit in self._moves(mid, role, gone, extra):
                    edits = (*inserts, edit)
                    found = (cost + paid + own, place, "".join(e for e, _ in edits), edits, step)
                    if after not in best or found[:3] < best[after][:3]:
                        best[after] = found
        # A path that another one beats whatever follows is no survivor.
        kept = [
            (found[1:3], state, found) for state, found in best.items()
            if all(found[0] <= o[0] + self.worth.get((other, state), found[0]) for other, o in best.items() if other != state)
        ]
        old, self.paths = self.paths, []
        for _, state, (cost, _, _, edits, step) in sorted(kept, key=lambda k: k[0]):
            made = _Step(step, edits)
            made.held = 1
            self.paths.append((state, cost, made))
        for _, _, step in old:
            self._release(step)
        return self._settled()

    def _release(self, step) -> None:
        step.held -= 1
        while not step.held and not step.kids and step.parent is not None:
            step.parent.kids.remove(step)
            step = step.parent

    def _settled(self) -> list[tuple]:
        out = []
        while len(self.root.kids) == 1 and not self.root.held:
            self.root = self.root.kids[0]
            self.root.parent = None
            out.append(self.root.edits)
        return out

    def end(self) -> list[tuple]:
        ways = [
            (cost + paid, place, len(inserts), inserts, step)
            for place, (state, cost, step) in enumerate(self.paths)
            for last, paid, inserts in self._inserted(state) if last in DONE
        ]
        self.cost, _, _, inserts, step = min(ways, key=lambda w: w[:3])
        out = [inserts] if inserts else []
        while step is not self.root:
            out.append(step.edits)
            step = step.parent
        return out[::-1]


EDITS = "turn long, edit string, was string, role string, text string, fault string"


def _initialed(rows: Iterator[tuple]) -> Iterator[tuple[bool, tuple]]:
    """Rows, each with whether its conversation (first field) is another than the last row's."""
    last = object()
    for row in rows:
        yield row[0] != last, row
        last = row[0]


def _listed(batches) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def faults(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with the first fault of each: blank, duplicate, truncated.

    All turns of a conversation come to one partition, in order. Equal turns are numbered by a sort
    there, which spills; nothing of a conversation is held at once.
    """
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    bare = F.rtrim(F.coalesce("text", F.lit("")), F.lit(WHITE))
    fault = F.when(bare == "", FAULTS[0]).when(F.col("again") > 1, FAULTS[1])
    fault = fault.when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), FAULTS[2])
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").repartition("conv_id")
    rows = rows.withColumn("again", again).withColumn("fault", fault)
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "again"]
    return rows.sortWithinPartitions(*order).drop("again")


def repair(turns: DataFrame, costs: EditCosts = EditCosts()) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) to the cheapest edits that make each alternate.

    A repaired conversation is empty, or pairs of user and assistant turns, one system turn
    before them or none; roles count by their first letter. One row per edit, in order within a
    conversation: edit (K, R, D, I), turn, was (the role read; null for inserts), role and text
    after the edit (null text for D), fault (blank, duplicate, truncated, or null). Blank turns
    and later ones of equal role and text have to go. Of edits of equal cost the least string of
    initials is taken.

    Turns go by turn, nulls first, then by role and text. A null conv_id is one conversation; a
    null role has no letter, a null text is blank, and both equal only nulls. Repeated rows are
    duplicates. An empty table gives no rows. The rows of a conversation stay together and in
    order, so ``digest`` can follow without a shuffle.
    """
    rows = faults(turns)
    kind = rows.schema["conv_id"].dataType.simpleString()
    result = f"conv_id {kind}, {EDITS}, cost long"
    schema = to_arrow_schema(StructType.fromDDL(result))
    price = {"K": 0, "R": costs.rerole, "D": costs.delete, "I": costs.insert}

    def shown(conv, steps, held):
        for edits in steps:
            for edit, role in edits:
                if edit == "I":
                    yield conv, None, edit, None, role, "", None, price[edit]
                    continue
                turn, was, text, fault = held.popleft()
                kept = edit != "D"
                late = costs.truncated if kept and fault == "truncated" else 0
                yield conv, turn, edit, was, role if kept else None, text if kept else None, fault, price[edit] + late

    def run(batches):
        def edits():
            path = conv = held = None
            for new, (now, turn, role, text, fault) in _initialed(_listed(batches)):
                if new:
                    if path:
                        yield from shown(conv, path.end(), held)
                    conv, path, held = now, Repair(costs), deque()
                held.append((turn, role, text, fault))
                yield from shown(conv, path.add(role or "", fault), held)
            if path:
                yield from shown(conv, path.end(), held)

        yield from _batches(edits(), schema)

    return rows.mapInArrow(run, result)


DIGEST = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)


def digest(edits: DataFrame) -> DataFrame:
    """Edits as ``repair`` gives them to one row per conversation, in one narrow pass.

    gaps (turn numbers missing between the first and the last), how many turns are blank,
    duplicate, truncated, illegal (adjacent initials other than su, ua, au), cost, audit (initials
    of the edits) and the SHA-256 of the repaired ``role:text`` lines.
    """
    kind = edits.schema["conv_id"].dataType.simpleString()
    result = f"conv_id {kind}, {DIGEST}"
    schema = to_arrow_schema(StructType.fromDDL(result))

    def run(batches):
        def closed(conv, s):
            gaps = s["last"] - s["first"] + 1 - s["turns"] if s["turns"] else 0
            return (
                conv, gaps, *(s[f] for f in FAULTS), s["illegal"], s["cost"],
                s["audit"].decode(), s["hash"].hexdigest(),
            )

        def rows():
            state = conv = None
            for new, (now, turn, edit, was, role, text, fault, cost) in _initialed(_listed(batches)):
                if new:
                    if state:
                        yield closed(conv, state)
                    conv = now
                    state = dict.fromkeys((*FAULTS, "illegal", "cost", "turns", "lines"), 0)
                    state |= {"audit": bytearray(), "hash": hashlib.sha256(), "before": None, "first": None, "last": None}
                state["audit"] += edit.encode()
                state["cost"] += cost
                if edit != "I":
                    initial = (was or "")[:1]
                    if state["before"] is not None and state["before"] + initial not in ("su", "ua", "au"):
                        state["illegal"] += 1
                    state["before"] = initial
                    if fault:
                        state[fault] += 1
                    if turn is not None and turn != state["last"]:
                        state["first"] = turn if state["first"] is None else state["first"]
                        state["last"], state["turns"] = turn, state["turns"] + 1
                if edit != "D":
                    line = f"{role or ''}:{text or ''}"
                    state["hash"].update(("\n" + line if state["lines"] else line).encode())
                    state["lines"] += 1
            if state:
                yield closed(conv, state)

        yield from _batches(rows(), schema)

    return edits.mapInArrow(run, result)


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with seeded faults; null roles and texts become a space.

    By crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes out its
    ends of sentences, 3 repeats it, 4 makes it a user's.
    """
    space = F.lit(" ")
    part: dict[str, Column] = {c: F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn", "role", "text")}
    rows = turns.select(
        "conv_id", "turn", part["role"].alias("role"), part["text"].alias("text"),
        crc_mod(F.concat(part["conv_id"], F.lit(":"), part["turn"]), 20).alias("way"),
    ).filter("way != 0")
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("way") == 4, USER).otherwise(F.col("role"))
    times = F.when(F.col("way") == 3, 2).otherwise(1)
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)))
    return rows.drop("col")
