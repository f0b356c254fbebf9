"""Conversation structure repair: the cheapest edits that make a dialogue an optional system turn and user/assistant pairs.

Turns are partitioned by conversation and sorted inside it (a secondary sort), and a generator walks the Arrow batches. What it
carries from batch to batch is the state of a dynamic program: for each of four places in the pattern ``(s?(ua)+)?`` the cost
of the cheapest edits so far and how their letters rank among each other. A turn leaves one number behind, the transition
taken, from which the edits are read backwards when the conversation ends. A conversation that outgrows the memory set aside for it writes
its turns and transitions to the shared folder piece by piece.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from simloom.llm.columns import BLANKS
from simloom.session import scratch_path

#: Turns and bytes of one conversation that are held before they are written out.
SPILL_ROWS, SPILL_BYTES = 1 << 16, 32 << 20
REROLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
FAULTS = (None, "blank", "duplicate", "truncated")
INITIALS = "sua"
_LEGAL = {(0, 1), (1, 2), (2, 1)}
#: Places in the pattern: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. The role that is missing at each.
_MISSING = (1, 1, 2, 1)
_ROLES = ("system", "user", "assistant")
#: Edits around one turn: up to two insertions before it, then what happens to it.
BLOCKS = tuple("I" * k + op for k in range(3) for op in "DKR")


def _after(place: int, role: int) -> int | None:
    """The place after a turn of a role (0 system, 1 user, 2 assistant, 3 other), None if the pattern has none there."""
    if role == 0:
        return 1 if place == 0 else None
    return role + 1 if role == _MISSING[place] else None


def _inserted(place: int, k: int) -> tuple[int, list[int]]:
    """The place after ``k`` insertions, and the inserted roles."""
    roles = []
    for _ in range(k):
        roles.append(_MISSING[place])
        place = _MISSING[place] + 1
    return place, roles


class Automaton:
    """Transitions between states of the dynamic program, worked out when they are first met.

    A state holds (cost above the cheapest, rank of the letters) per place, or None. No sequence of letters at one place is the
    beginning of one at another, as all end with the edit of the same turn, so ranks decide ties for good.
    """

    def __init__(self):
        self.states = [((0, 0), None, None, None)]
        self.known = {self.states[0]: 0}
        self.steps: dict[tuple[int, int], tuple[int, int, int]] = {}
        self.back: list[tuple] = []

    def step(self, state: int, kind: int) -> tuple[int, int, int]:
        """(next state, number of the transition, cost added to the cheapest) for a turn of a kind: role + 4 * fault."""
        if (state, kind) not in self.steps:
            self.steps[state, kind] = self._work_out(self.states[state], kind % 4, kind // 4)
        return self.steps[state, kind]

    def _work_out(self, state, role: int, fault: int) -> tuple[int, int, int]:
        best: list = [None] * 4
        for place, entry in enumerate(state):
            if entry is None:
                continue
            for number, block in enumerate(BLOCKS):
                there, _ = _inserted(place, len(block) - 1)
                cost = entry[0] + INSERT * (len(block) - 1) + {"D": DELETE, "R": REROLE, "K": 0}[block[-1]]
                if block[-1] != "D":
                    there = _after(there, role) if block[-1] == "K" else _MISSING[there] + 1
                    if there is None or FAULTS[fault] in ("blank", "duplicate"):
                        continue
                    cost += UNFINISHED * (FAULTS[fault] == "truncated")
                found = (cost, entry[1], block, place, number)
                if best[there] is None or found < best[there]:
                    best[there] = found
        least = min(b[0] for b in best if b)
        order = sorted((b[1], b[2]) for b in best if b)
        new = tuple(b and (b[0] - least, order.index((b[1], b[2]))) for b in best)
        if new not in self.known:
            self.known[new] = len(self.states)
            self.states.append(new)
        self.back.append(tuple(b and (b[3], b[4]) for b in best))
        return self.known[new], len(self.back) - 1, least

    def end(self, state: int) -> tuple[int, int]:
        """(place, insertions) of the cheapest way to finish."""
        finish = {0: 0, 1: 2, 2: 1, 3: 0}
        return min((e[0] + INSERT * finish[p], e[1], p, finish[p]) for p, e in enumerate(self.states[state]) if e)[2:]

    def backwards(self, place: int, transitions: Iterable[int]) -> tuple[int, bytearray]:
        """(place before, place before each turn * 16 + block), read from the last turn to the first."""
        codes = bytearray()
        for t in reversed(transitions):
            place, block = self.back[t][place]
            codes.append(place << 4 | block)
        codes.reverse()
        return place, codes


class _Edits:
    """Edits of some turns: the rows of the batch that they take (-1 for insertions), and a column of each other value."""

    def __init__(self):
        self.take, self.edit, self.role, self.cost, self.n = [], [], [], [], []

    def insertion(self, role: int, n: int) -> None:
        self._add(-1, "I", _ROLES[role], INSERT, n)

    def nothing(self) -> None:
        self._add(-1, "", None, 0, 0)

    def _add(self, row: int, edit: str, role: str | None, cost: int, n: int) -> None:
        self.take.append(row)
        self.edit.append(edit)
        self.role.append(role)
        self.cost.append(cost)
        self.n.append(n)

    def turns(self, codes: bytes, kinds: list[int], first: int, n: int) -> int:
        """Adds the edits of the turns that begin at row ``first``; the number of the last edit."""
        for row, (code, kind) in enumerate(zip(codes, kinds), first):
            block = BLOCKS[code & 15]
            place, roles = _inserted(code >> 4, len(block) - 1)
            for role in roles:
                n += 1
                self.insertion(role, n)
            n += 1
            op = block[-1]
            extra = UNFINISHED if kind >> 2 == 3 and op != "D" else 0
            if op == "R":
                self._add(row, op, _ROLES[_MISSING[place]], REROLE + extra, n)
            else:
                self._add(row, op, None, DELETE if op == "D" else extra, n)
        return n

    def batch(self, rows: pa.RecordBatch, keys: list[int] | None = None) -> pa.RecordBatch:
        """``keys``: the row that lends its conversation id to each edit; the first row if None."""
        take = pa.array([t if t >= 0 else None for t in self.take], pa.int64())
        at = pa.array(keys if keys is not None else [0] * len(self.take), pa.int64())
        kind = pc.fill_null(pc.take(rows.column("kind"), take), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        role, text = pc.take(rows.column("role"), take), pc.take(rows.column("text"), take)
        return pa.RecordBatch.from_arrays([
            pc.take(rows.column("conv"), at), pc.take(rows.column("key"), at), pa.array(self.n, pa.int64()), pa.array(self.edit, pa.string()),
            pc.take(pa.array(FAULTS, pa.string()), pa.array(np.maximum(kind, 0) >> 2)),
            pc.fill_null(pc.take(rows.column("illegal"), take), False), pa.array(self.cost, pa.int64()), pc.take(rows.column("turn"), take),
            pc.coalesce(pa.array(self.role, pa.string()), role), pc.fill_null(text, "")],
            names=["conv", "key", "n", "edit", "fault", "illegal", "cost", "turn", "role", "text"])


class _Tale:
    """A conversation that runs on into the next batch."""

    def __init__(self, key, folder: str, limits: tuple[int, int]):
        self.key, self.folder, self.limits = key, folder, limits
        self.state, self.last, self.pieces, self.spilled, self.tag = 0, None, [], 0, uuid.uuid4().hex

    def hold(self, rows: pa.RecordBatch, transitions: array) -> None:
        self.pieces.append((rows, transitions))
        held = [r for r, _ in self.pieces]
        if sum(r.num_rows for r in held) > self.limits[0] or sum(r.nbytes for r in held) > self.limits[1]:
            for rows, transitions in self.pieces:
                self._write("rows", self.spilled, rows)
                self._write("back", self.spilled, transitions.tobytes())
                self.spilled += 1
            self.pieces = []

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder)

    def _write(self, what: str, i: int, value: pa.RecordBatch | bytes) -> None:
        store, root = self._store()
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{self.tag}-{i}.{what}") as f:
            if isinstance(value, bytes):
                f.write(value)
            else:
                with pa.ipc.new_stream(f, value.schema) as out:
                    out.write_batch(value)

    def _read(self, what: str, i: int) -> bytes:
        store, root = self._store()
        with store.open_input_stream(f"{root}/{self.tag}-{i}.{what}") as f:
            return f.read()

    def finish(self, machine: Automaton) -> Iterator[pa.RecordBatch]:
        place, tail = machine.end(self.state)
        end, ready = place, {}
        for i in reversed(range(len(self.pieces))):
            place, ready[i] = machine.backwards(place, self.pieces[i][1])
        for i in reversed(range(self.spilled)):
            place, codes = machine.backwards(place, array("I", self._read("back", i)))
            self._write("codes", i, bytes(codes))
        n, last = 0, self.spilled + len(self.pieces) - 1
        for i in range(last + 1):
            if i < self.spilled:
                rows = pa.ipc.open_stream(self._read("rows", i)).read_next_batch()
                codes = self._read("codes", i)
            else:
                rows, codes = self.pieces[i - self.spilled][0], ready[i - self.spilled]
            edits = _Edits()
            n = edits.turns(codes, rows.column("kind").to_pylist(), 0, n)
            if i == last:
                for role in _inserted(end, tail)[1]:
                    n += 1
                    edits.insertion(role, n)
                if n == 0:
                    edits.nothing()
            yield edits.batch(rows)
        if self.spilled:
            store, root = self._store()
            for i in range(self.spilled):
                for what in ("rows", "back", "codes"):
                    store.delete_file(f"{root}/{self.tag}-{i}.{what}")


def edited(batches: Iterable[pa.RecordBatch], folder: str, limits: tuple[int, int] = (SPILL_ROWS, SPILL_BYTES)) -> Iterator[pa.RecordBatch]:
    """Edits of all conversations, in order. Batches are sorted by key and hold (conv, key, kind, turn, role, text); kind -1
    marks a turn that is lost and only names its conversation, which gives one row with an empty ``edit`` if all are lost.
    """
    machine = Automaton()
    tale: _Tale | None = None
    for batch in batches:
        keys, kinds = batch.column("key").to_pylist(), batch.column("kind").to_pylist()
        illegal, total = [False] * len(keys), len(keys)
        starts = [0] + [i for i in range(1, total) if keys[i] != keys[i - 1]] + [total]
        if tale is not None and total and keys[0] != tale.key:
            yield from tale.finish(machine)
            tale = None
        out, lend, held = _Edits(), [], None
        for a, b in zip(starts, starts[1:]):
            if a == b:
                continue
            own = tale if tale is not None else _Tale(keys[a], folder, limits)
            rows = [i for i in range(a, b) if kinds[i] >= 0]
            state, last, transitions = own.state, own.last, array("I")
            for i in rows:
                state, t, _ = machine.step(state, kinds[i])
                transitions.append(t)
                role = kinds[i] & 3
                illegal[i] = last is not None and (last, role) not in _LEGAL
                last = role
            own.state, own.last = state, last
            if b == total:
                held, tale = (a, rows, transitions), own
            elif tale is not None:  # it began in an earlier batch
                yield from _with(tale, batch, a, rows, illegal, transitions).finish(machine)
                tale = None
            else:
                place, tail = machine.end(state)
                _, codes = machine.backwards(place, transitions)
                n = 0
                if not rows:
                    out.nothing()
                elif rows[-1] - rows[0] + 1 == len(rows):
                    n = out.turns(codes, kinds[rows[0]:rows[-1] + 1], rows[0], 0)
                else:
                    for code, i in zip(codes, rows):
                        n = out.turns([code], [kinds[i]], i, n)
                for role in _inserted(place, tail)[1]:
                    n += 1
                    out.insertion(role, n)
                lend += [a] * (len(out.take) - len(lend))
        if out.take:
            yield out.batch(_marked(batch, illegal), lend)
        if held is not None:
            _with(tale, batch, *held[:2], illegal, held[2])
    if tale is not None:
        yield from tale.finish(machine)


def _marked(batch: pa.RecordBatch, illegal: list[bool]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(illegal, pa.bool_())], names=[*batch.schema.names, "illegal"])


def _with(tale: _Tale, batch: pa.RecordBatch, first: int, rows: list[int], illegal: list[bool], transitions: array) -> _Tale:
    """Gives a conversation its turns of this batch; the first piece of one without turns is a row to name it."""
    marked = _marked(batch, illegal)
    if rows:
        tale.hold(marked.take(pa.array(rows, pa.int64())), transitions)
    elif not tale.pieces and not tale.spilled:
        tale.pieces.append((marked.slice(first, 1), array("I")))
    return tale


def summarised(edits: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its edits in order."""
    key, now, done = object(), None, []

    def close() -> None:
        done.append((now["conv"], now["high"] - now["low"] + 1 - now["distinct"] if now["distinct"] else 0, *now["faults"][1:], now["illegal"],
                     now["cost"], "".join(now["audit"]), now["sha"].hexdigest()))

    def flush() -> pa.RecordBatch:
        cols = [pa.array(c, t.type) for c, t in zip(zip(*done), schema)]
        done.clear()
        return pa.RecordBatch.from_arrays(cols, schema=schema)

    for b in edits:
        for conv, k, _, edit, fault, illegal, cost, turn, role, text in zip(*[c.to_pylist() for c in b.columns]):
            if now is None or k != key:
                if now is not None:
                    close()
                key = k
                now = {"conv": conv, "low": None, "high": None, "distinct": 0, "faults": [0] * 4, "illegal": 0, "cost": 0, "audit": [],
                       "sha": hashlib.sha256(), "some": False}
            if edit not in ("I", ""):
                now["faults"][FAULTS.index(fault)] += 1
                now["illegal"] += illegal
                if turn is not None and turn != now["high"]:
                    now["low"] = turn if now["low"] is None else now["low"]
                    now["high"] = turn
                    now["distinct"] += 1
            now["cost"] += cost
            now["audit"].append(edit)
            if edit in ("K", "R", "I"):
                now["sha"].update((("\n" if now["some"] else "") + f"{role}:{text}").encode())
                now["some"] = True
        if now is not None and len(now["audit"]) > 4096:
            now["audit"] = ["".join(now["audit"])]
        if len(done) > 4096:
            yield flush()
    if now is not None:
        close()
    if done:
        yield flush()


def _streamed(turns: DataFrame, conv: str, turn: str, role: str, text: str, lost: str | None) -> DataFrame:
    """(conv, key, kind, turn, role, text) with whole conversations in a partition, sorted; one shuffle."""
    blank = F.lit(" ")
    rows = turns.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{conv}`").cast("string").alias("key"), F.col(f"`{turn}`").cast("bigint").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), blank).alias("role"), F.coalesce(F.col(f"`{text}`").cast("string"), blank).alias("text"),
        (F.coalesce(F.col(f"`{lost}`"), F.lit(False)) if lost else F.lit(False)).alias("lost"))
    same = Window.partitionBy("key", "lost", "role", "text").orderBy(F.asc_nulls_first("turn"))
    body = F.rtrim("text", F.lit(BLANKS))
    fault = (F.when(body == "", 1).when(F.col("copy") > 1, 2).when(~F.substring(body, -1, 1).isin(".", "!", "?"), 3).otherwise(0))
    place = F.position(F.substring("role", 1, 1), F.lit(INITIALS))
    initial = F.when((F.col("role") == "") | (place == 0), 3).otherwise(place - 1)
    return (rows.repartition("key").withColumn("copy", F.row_number().over(same))
            .withColumn("kind", F.when(F.col("lost"), -1).otherwise(initial + 4 * fault).cast("int"))
            .sortWithinPartitions(F.asc_nulls_first("key"), F.asc_nulls_first("turn"), "role", "text", "copy")
            .select("conv", "key", "kind", "turn", "role", "text"))


_EDIT = "key string, n bigint, edit string, fault string, illegal boolean, cost bigint, turn bigint, role string, text string"
_SUMMARY = ("gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string,"
            " repaired_sha256 string")


def _schema(turns: DataFrame, conv: str, more: str) -> StructType:
    return StructType([StructField("conv", turns.schema[conv].dataType), *_parse_datatype_string(more).fields])


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           limits: tuple[int, int] = (SPILL_ROWS, SPILL_BYTES)) -> DataFrame:
    """(conv, n, edit, fault, illegal, cost, turn, role, text): the edits of every conversation, numbered from 1.

    ``edit`` is Keep, Rerole, Delete or Insert; all rows but the deleted ones are the repaired conversation, whose role
    initials give ``(s?(ua)+)?``. The edits are the cheapest, of those the ones whose letters come first. Turns go
    by (turn, role, text), NULL turns first. ``fault`` is the first that applies: blank, duplicate (role and text met earlier in the
    conversation) or truncated. NULL roles and texts are one space; a role that starts with none of s, u, a, also an empty one, can't be kept. NULL is a
    conversation of its own, an empty table gives no rows, columns beside the four are left out.
    """
    rows = _streamed(turns, conv, turn, role, text, None)
    folder = scratch_path(turns.sparkSession, "repair")
    out = rows.mapInArrow(lambda batches: edited(batches, folder, limits), _schema(turns, conv, _EDIT))
    return out.drop("key").withColumnRenamed("conv", conv)


def audit(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", lost: str | None = None,
          limits: tuple[int, int] = (SPILL_ROWS, SPILL_BYTES)) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): a row per conversation from its edits.

    ``lost`` names a boolean column of turns that are gone: they only keep their conversation in the result, which has zeros,
    an empty audit and the hash of the empty text if it has no other turn. See ``repair`` for the rest.
    """
    rows = _streamed(turns, conv, turn, role, text, lost)
    folder, kind = scratch_path(turns.sparkSession, "repair"), _schema(turns, conv, _SUMMARY)

    def run(batches):
        # Types of the id as Arrow sends them.
        first = next(batches, None)
        if first is None:
            return
        names = {"string": pa.string(), "bigint": pa.int64()}
        schema = pa.schema([("conv", first.schema.field("conv").type)] + [(f.name, names[f.dataType.simpleString()]) for f in kind.fields[1:]])
        yield from summarised(edited(chain([first], batches), folder, limits), schema)

    return rows.mapInArrow(run, kind).withColumnRenamed("conv", conv)
