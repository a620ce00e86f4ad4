"""Repair of conversation structure by a Viterbi search with survivor coalescence.

A legal conversation reads ``(system? (user assistant)+)?``.  Walking through a
conversation's rows, the output so far is in one of four states: empty, after
a system row, after a user row, after an assistant row.  Keep, Rerole, Delete
and Insert lead from state to state at their costs, and each state keeps one
survivor: the cheapest edits that reach it, ties by the least audit string.

Survivors are leaves of a tree of back pointers.  Nodes count their
references; a node without any is dropped, with the ancestors that only it
held up.  As soon as all survivors share an ancestor, the edits up to it are
final: they are appended to the audit and hashed, and their texts leave
memory.  What stays is the unresolved part, usually a few rows.  Ties are
settled on the complete unresolved suffixes, back to the common ancestor.  A
run of deletions is one node with a count, so that a long stretch of blank or
repeated rows stays small while its start is undecided.  A state that another
one undercuts by more than the way from there could ever cost is dropped: it
cannot win, but would hold the common ancestor back.

Two shortcuts do not change the answer.  Cycles of inserts come back to their
state at a cost.  An insert right before a delete loses to the same insert
right after it: same cost, smaller audit.

Spark deals rows by conversation, once: the search for repeated rows and the
final order are two sorts of the same partitioning, both of which may spill.
A task then streams its rows, so a conversation of any length costs the memory
of its unresolved part and of its audit.  One conversation stays in one task,
as the hash of its repaired text is a chain over all its rows.

Order: turn (nulls first), then role, then text, so that rows of one turn have
a fixed order and copies lie side by side.

Defined results: a null role or text, or a null id or turn within the damage
key, is one space; the null conversation is a conversation; rows of equal turn,
role and text are repeats of the first of them; an empty role has no initial
and can only be reroled or deleted; conversations whose rows are all lost give
zeros, an empty audit and the hash of the empty string; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED_COST = 1
LEGAL_PAIRS = ("su", "ua", "au")
KEEP = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = {EMPTY: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
#: what going on from state ``other`` costs more, at most, than going on from ``state``: (state, other)
DETOUR = {(EMPTY, SYSTEM): 4, (EMPTY, USER): 5, (EMPTY, ASSISTANT): 3, (SYSTEM, EMPTY): 0, (SYSTEM, USER): 2, (SYSTEM, ASSISTANT): 0,
          (USER, EMPTY): 2, (USER, SYSTEM): 2, (USER, ASSISTANT): 2, (ASSISTANT, EMPTY): 0, (ASSISTANT, SYSTEM): 4, (ASSISTANT, USER): 2}
_BLANK = " \t\n\x0b\x0c\r"


def _inserts(state: int) -> list[tuple[int, tuple[str, ...]]]:
    """States that inserts reach from ``state``, with the roles inserted."""
    out, roles = [(state, ())], ()
    while True:
        state, role = NEXT[state]
        if state in [s for s, _ in out]:
            return out
        roles += (role,)
        out.append((state, roles))


INSERTS = [_inserts(s) for s in range(4)]


class Node:
    """Edits of one row (inserts before it included) or a run of deletions."""

    __slots__ = ("parent", "first", "edits", "times", "lines", "refs")

    def __init__(self, parent, first, edits, lines):
        self.parent, self.first, self.edits, self.lines = parent, first, edits, lines
        self.times, self.refs = 1, 1


def _less(a: Node, a_edits: str, b: Node, b_edits: str) -> bool:
    """Whether the edits up to ``a`` and ``a_edits`` come before those of ``b``:
    compared from the common ancestor on."""
    x, y = [a_edits], [b_edits]
    while a is not b:
        back_a, back_b = a.first >= b.first, b.first >= a.first
        if back_a:
            x.append(a.edits * a.times)
            a = a.parent
        if back_b:
            y.append(b.edits * b.times)
            b = b.parent
    return "".join(reversed(x)) < "".join(reversed(y))


class Repair:
    """The search over one conversation; rows come one by one."""

    def __init__(self):
        self.root = Node(None, -1, "", ())
        self.alive: dict[int, tuple[int, Node]] = {EMPTY: (0, self.root)}
        self.row, self.audit, self.hash, self.any = 0, [], hashlib.sha256(), False

    def _emit(self, edits: str, lines) -> None:
        self.audit.append(edits)
        for line in lines:
            self.hash.update((b"\n" if self.any else b"") + line.encode())
            self.any = True

    def _drop(self, node: Node) -> None:
        node.refs -= 1
        while node.refs == 0 and node is not self.root:
            node = node.parent
            node.refs -= 1

    def step(self, role: str, text: str, must_delete: bool, truncated: bool) -> None:
        best: dict[int, tuple[int, Node, str, tuple]] = {}

        def offer(state: int, cost: int, node: Node, edits: str, lines: tuple) -> None:
            old = best.get(state)
            if old is None or cost < old[0] or cost == old[0] and _less(node, edits, old[1], old[2]):
                best[state] = (cost, node, edits, lines)

        extra = TRUNCATED_COST if truncated else 0
        for state, (cost, node) in self.alive.items():
            offer(state, cost + COST["D"], node, "D", ())
            if must_delete:
                continue
            for at, roles in INSERTS[state]:
                before, paid = "I" * len(roles), cost + COST["I"] * len(roles) + extra
                keep = KEEP.get((at, role[:1]))
                if keep is not None:
                    offer(keep, paid + COST["K"], node, before + "K", (*roles, role))
                then, new_role = NEXT[at]
                offer(then, paid + COST["R"], node, before + "R", (*roles, new_role))
        for s, o in DETOUR:
            if s in best and o in best and best[o][0] + DETOUR[s, o] < best[s][0]:
                del best[s]
        used = Counter(id(node) for _, node, *_ in best.values())
        old, self.alive = self.alive, {}
        kept = set()
        for state, (cost, node, edits, roles) in best.items():
            if edits == node.edits == "D" and used[id(node)] == node.refs == 1 and node is not self.root:
                node.times += 1
                kept.add(id(node))
                self.alive[state] = (cost, node)
            else:
                lines = tuple(f"{r}:" for r in roles[:-1]) + (f"{roles[-1]}:{text}",) if roles else ()
                self.alive[state] = (cost, Node(node, self.row, edits, lines))
                node.refs += 1
        for _, node in old.values():
            if id(node) not in kept:
                self._drop(node)
        self.row += 1
        self._coalesce()

    def _coalesce(self) -> None:
        """Emits what all survivors share."""
        if self.root.refs > 1:
            return
        leaves = {id(node) for _, node in self.alive.values()}
        if id(self.root) in leaves:
            return
        node, path = next(iter(self.alive.values()))[1], []
        while node is not self.root:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            if self.root.refs > 1 or id(self.root) in leaves:
                break
            self._emit(node.edits * node.times, node.lines)
            node.parent, node.lines, self.root = None, (), node

    def unresolved(self) -> int:
        """Nodes in memory that no emitted edit covers."""
        seen = set()
        for _, node in self.alive.values():
            while node is not self.root and id(node) not in seen:
                seen.add(id(node))
                node = node.parent
        return len(seen)

    def finish(self) -> tuple[int, str, str]:
        """(cost, audit, hash of the repaired rows)."""
        best = None
        for state, (cost, node) in self.alive.items():
            roles = () if state == EMPTY else dict(INSERTS[state])[ASSISTANT]
            cost, edits = cost + COST["I"] * len(roles), "I" * len(roles)
            if best is None or cost < best[0] or cost == best[0] and _less(node, edits, best[1], best[2]):
                best = (cost, node, edits, roles)
        cost, node, edits, roles = best
        path = []
        while node is not self.root:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            self._emit(node.edits * node.times, node.lines)
        self._emit(edits, [f"{r}:" for r in roles])
        return cost, "".join(self.audit), self.hash.hexdigest()


class Conversation:
    """Counts and repair of the rows of one conversation, in order."""

    def __init__(self, key):
        self.key, self.repair = key, Repair()
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.initial = self.first = self.last = None
        self.turns = 0

    def row(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        words = text.rstrip(_BLANK)
        fault = "blank" if not words else "duplicate" if repeated else "truncated" if words[-1] not in ".!?" else None
        if fault:
            self.counts[fault] += 1
        if self.initial is not None and self.initial + role[:1] not in LEGAL_PAIRS:
            self.counts["illegal"] += 1
        self.initial = role[:1]
        self.repair.step(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def result(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.key, gaps, *self.counts.values(), *self.repair.finish())


_OUT = ("gaps bigint", "blank bigint", "duplicate bigint", "truncated bigint", "illegal bigint", "cost bigint", "audit string",
        "repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """From (conv_id, turn, role, text, lost): one row per conv_id.  ``lost``
    rows only say that their conversation exists."""
    key = rows.schema["conv_id"].dataType
    dealt = rows.repartition("conv_id")
    same = Window.partitionBy("conv_id", "lost", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    seen = dealt.withColumn("repeated", F.row_number().over(same) > 1)
    ordered = seen.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "repeated")
    schema = ", ".join((f"conv_id {key.simpleString()}", *_OUT))
    names = ["conv_id", *(c.split()[0] for c in _OUT)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kind = None, None
        for batch in batches:
            kind = batch.schema.field(0).type
            done = []
            for conv, turn, role, text, lost, repeated in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.key != conv:
                    if now is not None:
                        done.append(now.result())
                    now = Conversation(conv)
                if not lost:
                    now.row(turn, role, text, repeated)
            yield _batch(done, kind)
        if now is not None:
            yield _batch([now.result()], kind)

    def _batch(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*done)) or [()] * len(names)
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return ordered.select("conv_id", "turn", "role", "text", "lost", "repeated").mapInArrow(run, schema)


def clean_rows(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               text_col: str = "text") -> DataFrame:
    """The columns that ``repair`` reads; a null role or text is one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"),
                                text(text_col).alias("text"), F.lit(False).alias("lost"))


def damage(rows: DataFrame) -> DataFrame:
    """Planted faults by the CRC-32 of ``conv_id:turn`` modulo 20: 0 drops a
    row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it
    the user's."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(own("conv_id"), F.lit(":"), own("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       (F.col("lost") | (fault == 0)).alias("lost"), F.explode(copies).alias("copy")).drop("copy")


def repair_conversations(conversations: DataFrame, damaged: bool = False, **columns: str) -> DataFrame:
    """Counts of faults, cost, audit and hash of the repaired rows per
    conversation; ``damaged`` plants the faults of ``damage`` first."""
    rows = clean_rows(conversations, **columns)
    return repair(damage(rows) if damaged else rows)
