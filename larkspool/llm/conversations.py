"""Conversation structure repair: cheapest edits by Viterbi with coalescing survivors.

A conversation is sound if its roles are an optional system turn and one or more pairs of
user and assistant, or if it is empty. Each row has its first fault of: blank (nothing but
ASCII white space), duplicate (role and text seen earlier in the conversation), truncated
(its last visible character ends no sentence). Edits: K keeps a row (cost 0), R gives it
the role user or assistant (3), D deletes it (4; blank and duplicate rows must go), I
inserts a row without text (3); a truncated row that stays costs 3 more. The cheapest
edits win, and of equally cheap ones the letters that come first in ASCII.

The states are those of the grammar: nothing yet, system, user, assistant. A row leaves one
survivor per state, a leaf in a tree of back pointers with reference counts. A survivor that
another one beats whatever follows is dropped. A branch without survivors is freed, and once all survivors share an ancestor the edits up to it are
decided and leave the task, so memory follows the undecided rows and not the conversation;
rows that must go hold no text. Inserts are put in front of the next row's edit, so of two
undecided suffixes with as many rows none begins with the other, and which one is less never
changes later: survivors keep their order among the complete suffixes from row to row.

Rows are put in one order by a range shuffle (conversation, turn, role, digest of the text;
nulls first) and cut at every BLOCK positions, so a conversation of any size is spread over
tasks. For each piece of a cut conversation a first pass takes cost and order of the
survivors from every state to every state; these small tables are chained per conversation
to the states at the cuts, and then all pieces are solved at once.

A null role or text is one space, a null turn comes first, a null conversation id is an
id. Rows of one turn are ordered by role and digest of the text. Rows that repeat are
duplicates, which go. Other columns of the input are ignored. An empty table gives empty ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspool.llm.common import ensure_folder, extended, join_by_id, stage
from larkspool.operators.ranks import positions
from larkspool.operators.staging import lookup_join

#: Positions per piece; a conversation is cut where a multiple of this many rows lies.
BLOCK = 1 << 16
#: Edited rows, and characters of their texts, that a task sends at a time.
SENT_ROWS, SENT_CHARS = 4_096, 4 << 20
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
LEGAL = ("su", "ua", "au")
_WHITE = " \t\n\x0b\f\r"
# States of the grammar, and which one a kept, reroled or inserted row leads to.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = {_START: _USER, _SYSTEM: _USER, _USER: _ASSISTANT, _ASSISTANT: _USER}
_KEPT = {(_START, "s"): _SYSTEM} | {(s, "ua"[t == _ASSISTANT]): t for s, t in _NEXT.items()}
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
#: Inserts that end a conversation.
_END = {_START: "", _SYSTEM: "II", _USER: "I", _ASSISTANT: ""}


def _moves(initial: str, fault: str) -> dict[int, dict[int, tuple[int, str]]]:
    """From each state to each state, the cheapest letters for a row: inserts, then the row's edit."""
    extra = TRUNCATED if fault == "truncated" else 0
    out = {}
    for start in range(4):
        found: dict[int, tuple[int, str]] = {}
        state, inserts = start, ""
        for _ in range(3):
            cost = INSERT * len(inserts)
            options = [(state, cost + DELETE, inserts + "D")]
            if fault not in ("blank", "duplicate"):
                options.append((_NEXT[state], cost + REROLE + extra, inserts + "R"))
                if (state, initial) in _KEPT:
                    options.append((_KEPT[state, initial], cost + extra, inserts + "K"))
            for to, price, letters in options:
                found[to] = min(found.get(to, (price, letters)), (price, letters))
            state, inserts = _NEXT[state], inserts + "I"
        out[start] = found
    return out


_MOVES = {(i, f): _moves(i, f) for i in ("s", "u", "a", "") for f in ("", "blank", "duplicate", "truncated")}


def moves_of(role: str, fault: str) -> dict[int, dict[int, tuple[int, str]]]:
    initial = role[:1]
    return _MOVES[initial if initial in ("s", "u", "a") else "", fault]


class _Node:
    """The letters of one row on a path; ``refs`` counts its children, and one if it is a survivor."""

    __slots__ = ("children", "letters", "parent", "refs", "row")

    def __init__(self, parent: _Node | None, letters: str, row: object) -> None:
        self.parent, self.letters, self.row, self.refs, self.children = parent, letters, row, 0, []


class Survivors:
    """The best path into each state, from the state ``start``."""

    def __init__(self, start: int = _START) -> None:
        self.root = _Node(None, "", None)
        self.root.refs = 1
        #: state -> (cost, order among the survivors' complete suffixes, leaf)
        self.best = {start: (0, 0, self.root)}

    def add(self, moves: dict[int, dict[int, tuple[int, str]]], row: object) -> None:
        """Extend all survivors by one row and free the branches that no survivor is on."""
        found: dict[int, tuple[int, int, str, _Node]] = {}
        for state, (cost, order, leaf) in self.best.items():
            for to, (price, letters) in moves[state].items():
                candidate = (cost + price, order, letters, leaf)
                if to not in found or candidate[:3] < found[to][:3]:
                    found[to] = candidate
        best = {}
        ranked = sorted(found, key=lambda s: found[s][1:3])
        for order, state in enumerate(ranked):
            cost, _, letters, parent = found[state]
            leaf = _Node(parent, letters, row)
            leaf.refs = 1
            parent.refs += 1
            parent.children.append(leaf)
            best[state] = (cost, order, leaf)
        old, self.best = self.best, best
        for _, _, leaf in old.values():
            self._release(leaf)
        for state in self._beaten():
            self._release(self.best.pop(state)[2])

    def _beaten(self) -> list[int]:
        """States whose survivor another one beats whatever follows; no row leads back to them.

        What may follow the beginning or a system row may follow an assistant as well, but for a kept
        system row, which an assistant's path deletes instead; one insert leads from user to assistant.
        """
        best, never = self.best, (float("inf"), 0)
        user, assistant = best.get(_USER, never), best.get(_ASSISTANT, never)
        out = []
        if _START in best and best[_START][0] > min(assistant[0], user[0] + INSERT) + DELETE:
            out.append(_START)
        if _SYSTEM in best and (assistant[:2] < best[_SYSTEM][:2] or user[0] + INSERT < best[_SYSTEM][0]):
            out.append(_SYSTEM)
        return out

    def _release(self, node: _Node) -> None:
        node.refs -= 1
        while not node.refs and node is not self.root:
            parent = node.parent
            parent.children.remove(node)
            parent.refs -= 1
            node = parent

    def decided(self) -> Iterator[tuple[str, object]]:
        """Letters and row of every edit that all survivors share and that was not given before."""
        while self.root.refs == 1 and self.root.children:
            self.root = self.root.children[0]
            self.root.parent = None
            yield self.root.letters, self.root.row

    def close(self, end: int | None = None) -> str:
        """Keep only the survivor in the state ``end``, or the one that ends best; the inserts that end it."""
        if end is None:
            end = min(self.best, key=lambda s: (self.best[s][0] + INSERT * len(_END[s]), self.best[s][1]))
            last = _END[end]
        else:
            last = ""
        for state, (_, _, leaf) in list(self.best.items()):
            if state != end:
                del self.best[state]
                self._release(leaf)
        return last


@dataclass(frozen=True)
class Repair:
    """rows: conv_id, pos, turn, role, text, fault. edits: conv_id, pos, step, edit, role, text, cost, illegal.

    Edits in the order of pos and step make the audit; those with a role, the repaired
    conversation. ``illegal`` says that a row may not follow the one before it.
    """

    rows: DataFrame
    edits: DataFrame


def with_faults(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (over all rows), turn, role, text and the first fault of each row, '' if it has none."""
    space = F.lit(" ")
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text")
    )
    rows = rows.withColumn("_text", F.md5("text")).withColumn("_tie", F.monotonically_increasing_id())
    rows = positions(rows, ["conv_id", "turn", "role", "_text", "_tie"])
    rows = rows.withColumn("_same", F.md5(F.to_json(F.struct("conv_id", "role", "_text"))))
    # One row per text that repeats: partial counts meet in the shuffle, so a text of a third of all rows is a few.
    first = rows.groupBy("_same").agg(F.min("pos").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    rows = lookup_join(rows, stage(first, "first-turns"), ["_same"], "pos")
    seen = F.rtrim(F.col("text"), F.lit(_WHITE))
    fault = (
        F.when(seen == "", "blank")
        .when(F.col("pos") > F.col("_first"), "duplicate")
        .when(~F.right(seen, F.lit(1)).isin(".", "!", "?"), "truncated")
        .otherwise("")
    )
    return rows.select("conv_id", "pos", "turn", "role", "text", fault.alias("fault"))


def _pieces(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple]:
    """Rows as tuples of the named columns."""
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost and order of the survivors from every state to every state, for each piece; -1 where there is none."""
    out, at, runs, first, last, kind = [], None, [], "", "", None

    def flush() -> None:
        ends = [[(s.best[q][0], s.best[q][1]) if q in s.best else (-1, -1) for q in range(4)] for s in runs]
        out.append((*at, [e[0] for x in ends for e in x], [e[1] for x in ends for e in x], first, last))

    for batch in batches:
        kind = batch.column("conv_id").type
        for conv, block, role, fault in _pieces(batch, ["conv_id", "block", "role", "fault"]):
            if at != (conv, block):
                if at is not None:
                    flush()
                at, runs, first = (conv, block), [Survivors(p) for p in range(4)], role[:1]
            moves, last = moves_of(role, fault), role[:1]
            for survivors in runs:
                survivors.add(moves, None)
                for _ in survivors.decided():
                    pass
    if at is not None:
        flush()
    if out:
        convs, blocks, costs, orders, firsts, lasts = zip(*out)
        yield pa.RecordBatch.from_arrays(
            [pa.array(convs, kind), pa.array(blocks, pa.int64()), pa.array(costs, pa.list_(pa.int64())),
             pa.array(orders, pa.list_(pa.int64())), pa.array(firsts, pa.string()), pa.array(lasts, pa.string())],
            ["conv_id", "block", "costs", "orders", "first", "last"],
        )


def _chained(table: pa.Table) -> pa.Table:
    """States at the cuts of one conversation, from the tables of its pieces."""
    table = table.sort_by("block")
    best, back = {_START: (0, 0)}, []
    for costs, orders in zip(table["costs"].to_pylist(), table["orders"].to_pylist(), strict=True):
        found: dict[int, tuple] = {}
        for p, (cost, order) in best.items():
            for q in range(4):
                if costs[4 * p + q] >= 0:
                    candidate = (cost + costs[4 * p + q], order, orders[4 * p + q], p)
                    found[q] = min(found.get(q, candidate), candidate)
        ranked = sorted(found, key=lambda q: found[q][1:3])
        best = {q: (found[q][0], k) for k, q in enumerate(ranked)}
        back.append({q: found[q][3] for q in found})
    state = min(best, key=lambda s: (best[s][0] + INSERT * len(_END[s]), best[s][1]))
    starts, ends = [], []
    for origins in reversed(back):
        ends.append(state)
        state = origins[state]
        starts.append(state)
    ends[0] = None  # the last piece ends its conversation
    before = [None, *table["last"].to_pylist()[:-1]]
    return pa.table(
        {"piece": table["piece"], "start": pa.array(starts[::-1], pa.int32()),
         "end": pa.array(ends[::-1], pa.int32()), "before": pa.array(before, pa.string())}
    )


_EDITS = "pos long, step int, edit string, role string, text string, cost int, illegal boolean"
_COST = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cheapest edits of each piece between its given states, given as soon as they are decided."""
    rows: list[tuple] = []
    chars, kind = 0, None
    at = survivors = state = end = last_initial = pos = None

    def apply(letters: str, row: tuple | None, where: int, step: int) -> None:
        nonlocal state, chars
        for letter in letters:
            role, text, cost, illegal = None, None, _COST[letter], False
            if letter == "I":
                state = _NEXT[state]
                role, text = _ROLE[state], ""
            else:
                where, given, said, initial, extra, illegal = row
                if letter != "D":
                    state = _NEXT[state] if letter == "R" else _KEPT[state, initial]
                    role, text = _ROLE[state] if letter == "R" else given, said
                    cost += extra
                    chars += len(said)
            rows.append((at[0], where, step, letter, role, text, cost, illegal))
            step += 1

    def finish() -> None:
        last = survivors.close(end)
        for letters, row in survivors.decided():
            apply(letters, row, row[0], 0)
        apply(last, None, pos, 3)

    def sent() -> pa.RecordBatch:
        types = [kind, pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_()]
        names = ["conv_id", "pos", "step", "edit", "role", "text", "cost", "illegal"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    for batch in batches:
        kind = batch.column("conv_id").type
        names = ["conv_id", "block", "pos", "role", "text", "fault", "start", "end", "before"]
        for conv, block, pos_, role, text, fault, start, end_, before in _pieces(batch, names):
            if at != (conv, block):
                if at is not None:
                    finish()
                at, end, last_initial = (conv, block), end_, before
                state = _START if start is None else start
                survivors = Survivors(state)
            pos, initial = pos_, role[:1]
            illegal = last_initial is not None and last_initial + initial not in LEGAL
            last_initial = initial
            held = None if fault in ("blank", "duplicate") else text
            extra = TRUNCATED if fault == "truncated" else 0
            survivors.add(moves_of(role, fault), (pos, role, held, initial, extra, illegal))
            for letters, row in survivors.decided():
                apply(letters, row, row[0], 0)
            if len(rows) >= SENT_ROWS or chars >= SENT_CHARS:
                yield sent()
                rows, chars = [], 0
    if at is not None:
        finish()
    if rows:
        yield sent()


def repair(conversations: DataFrame) -> Repair:
    """The rows of ``conversations`` (conv_id, turn, role, text) with their faults, and the cheapest edits."""
    ensure_folder(conversations.sparkSession)
    rows = stage(with_faults(conversations), "turns")
    conv = rows.select("conv_id").schema
    blocks = rows.withColumn("block", F.floor(F.col("pos") / BLOCK))
    # A conversation that is cut: only its pieces take the first pass.
    ends = rows.groupBy("conv_id").agg(F.floor(F.min("pos") / BLOCK).alias("a"), F.floor(F.max("pos") / BLOCK).alias("b")).where("b > a")
    cut = stage(ends.drop("a", "b"), "cut-conversations")
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def sorted_pieces(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "conv_id", "block").sortWithinPartitions("conv_id", "block", "pos")

    narrow = sorted_pieces(join_by_id(blocks.drop("text", "turn"), cut, "conv_id", "left_semi"))
    tables = narrow.mapInArrow(
        _tables, extended(conv, "block long, costs array<long>, orders array<long>, first string, last string")
    )
    piece = F.to_json(F.struct("conv_id", "block"))
    states = tables.withColumn("piece", piece).groupBy("conv_id").applyInArrow(
        _chained, "piece string, start int, end int, before string"
    )
    placed = join_by_id(blocks.withColumn("piece", piece), stage(states, "cut-states"), "piece", "left")
    edits = sorted_pieces(placed.drop("piece", "turn")).mapInArrow(_edited, extended(conv, _EDITS))
    return Repair(rows, stage(edits, "edits"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and hash of each conversation, from its edits in order; only the hash's state is kept."""
    at, letters, digest, some, out, kind = None, [], None, False, [], None
    for batch in batches:
        kind = batch.column("conv_id").type
        for conv, edit, role, text in _pieces(batch, ["conv_id", "edit", "role", "text"]):
            if at is None or at[0] != conv:
                if at is not None:
                    out.append((at[0], "".join(letters), digest.hexdigest()))
                at, letters, digest, some = (conv,), [], hashlib.sha256(), False
            letters.append(edit)
            if role is not None:
                digest.update((("\n" if some else "") + role + ":" + text).encode())
                some = True
    if at is not None:
        out.append((at[0], "".join(letters), digest.hexdigest()))
        convs, audits, hashes = zip(*out)
        yield pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array(audits), pa.array(hashes)], ["conv_id", "audit", "repaired_sha256"])


def summary(found: Repair) -> DataFrame:
    """Per conversation with rows: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    turns = found.rows.groupBy("conv_id", "turn", "fault").agg(F.count("*").alias("n"))
    faults = turns.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"),
        *(F.coalesce(F.sum(F.when(F.col("fault") == f, F.col("n"))), F.lit(0)).alias(f) for f in ("blank", "duplicate", "truncated")),
    )
    costs = found.edits.groupBy("conv_id").agg(F.sum(F.col("illegal").cast("int")).alias("illegal"), F.sum("cost").alias("cost"))
    parts = max(1, int(found.edits.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = found.edits.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "pos", "step")
    digests = ordered.select("conv_id", "edit", "role", "text").mapInArrow(
        _digests, extended(found.edits.select("conv_id").schema, "audit string, repaired_sha256 string")
    )
    out = faults.withColumnRenamed("conv_id", "id")
    for part, name in ((costs, "cost_id"), (digests, "digest_id")):
        out = out.join(part.withColumnRenamed("conv_id", name), F.col("id").eqNullSafe(F.col(name)), "left").drop(name)
    return out.select(
        F.col("id").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )
