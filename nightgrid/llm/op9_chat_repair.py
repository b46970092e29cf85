"""Chat formatting: minimum-cost role repair over a legal-turn automaton, then rendering.

A conversation is a walk over the automaton's states (the role of the last turn). Each given turn is kept, relabelled, merged into the
turn before it, or preceded by empty turns; dynamic programming finds the cheapest walk. The cost of a turn depends on its role alone,
so a stretch of turns is a small matrix in the (min, +) algebra. Turns are range-partitioned in their order, so a conversation of any length,
whatever its turn numbers, spreads over partitions, and are cut into blocks of at most ``BLOCK`` turns of one conversation. Block matrices
are made in parallel, chained per conversation, and each block is then repaired between its known end states. No task
needs a whole conversation's texts, and rendered pieces come out turn by turn: their concatenation in order is the conversation.

Defined results: turns are ordered by number, then role, then text (a null number, or one that is no number, comes first); equal turns repeat and are
merged or relabelled as the automaton asks; a null or unknown role fits none and is relabelled; a null text is empty; in a text ``<|`` is
written ``< |``, so that no text can pass for a turn's mark; a text of any length is one piece; a null
conversation id is an id like others, and ids may be of any type that has an order; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import materialise, read_table

ROLES = ["system", "user", "assistant", "tool"]
START = 4
#: Which role may follow which state (the last is the start).
LEGAL = {START: (0, 1), 0: (1,), 1: (2,), 2: (1, 3), 3: (2,)}
#: States in which a conversation may end.
FINAL = (1, 2)
MERGE, RELABEL, INSERT = 2, 3, 5
#: Turns in a block at most.
BLOCK = 512
SIZE = 5
INF = 1 << 40


def insertions() -> tuple[np.ndarray, dict[tuple[int, int], tuple[int, ...]]]:
    """Cheapest empty turns between two states: cost, and the roles inserted."""
    cost = np.full((SIZE, SIZE), INF, np.int64)
    path = {}
    for s in range(SIZE):
        cost[s, s], path[s, s], edge = 0, (), [s]
        while edge:
            nxt = []
            for a in edge:
                for b in LEGAL[a]:
                    if cost[s, b] >= INF:
                        cost[s, b], path[s, b] = cost[s, a] + INSERT, (*path[s, a], b)
                        nxt.append(b)
            edge = nxt
    return cost, path


INSERT_COST, INSERT_PATH = insertions()


def _options(role: int) -> list[list[tuple[int, str, tuple[int, ...]]]]:
    """[state][next state] -> the cheapest (cost, action, inserted roles) for a turn of ``role`` (4: unknown)."""
    out = []
    for p in range(SIZE):
        row = []
        for q in range(SIZE):
            best = (INF, "none", ())
            if q != START:
                change = 0 if q == role else RELABEL
                if p == q and p != START:
                    best = (MERGE + change, "merge" if not change else "merge_relabel", ())
                for a in range(SIZE):
                    if INSERT_COST[p, a] < INF and q in LEGAL[a]:
                        cand = (int(INSERT_COST[p, a]) + change, "keep" if not change else "relabel", INSERT_PATH[p, a])
                        best = min(best, cand, key=lambda x: (x[0], len(x[2])))
            row.append(best)
        out.append(row)
    return out


OPTIONS = [_options(r) for r in range(SIZE)]
STEP = [np.array([[o[0] for o in row] for row in t], np.int64) for t in OPTIONS]
END_COST = np.array([min(INSERT_COST[s, f] for f in FINAL) if s != START else 0 for s in range(SIZE)], np.int64)
END_PATH = [() if s == START else min((INSERT_PATH[s, f] for f in FINAL if INSERT_COST[s, f] < INF), key=len) for s in range(SIZE)]


def role_number(x: str | None) -> int:
    return ROLES.index(x) if x in ROLES else START


def walk(roles: list[int], entry: int, exit_: int | None = None) -> tuple[int, list[int]]:
    """Cheapest states after each turn, from ``entry`` to ``exit_`` (or the best legal end)."""
    cost = [INF] * SIZE
    cost[entry] = 0
    back = []
    for r in roles:
        t = OPTIONS[r]
        new, frm = [INF] * SIZE, [0] * SIZE
        for p in range(SIZE):
            if cost[p] < INF:
                for q in range(SIZE):
                    c = cost[p] + t[p][q][0]
                    if c < new[q]:
                        new[q], frm[q] = c, p
        back.append(frm)
        cost = new
    if exit_ is None:
        exit_ = min(range(SIZE), key=lambda s: (cost[s] + int(END_COST[s]), s))
    states, s = [], exit_
    for frm in reversed(back):
        states.append(s)
        s = frm[s]
    return cost[exit_], states[::-1]


def _grouped(batches: Iterator[pa.RecordBatch], n_key: int, limit: int = 1 << 62):
    """(key, rows) of runs of equal keys in sorted batches, of ``limit`` rows at most."""
    key, rows = None, []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if rows and (r[:n_key] != key or len(rows) == limit):
                yield key, rows
                rows = []
            key = r[:n_key]
            rows.append(r)
    if rows:
        yield key, rows


def _batches(records: Iterator[tuple], schema: pa.Schema, size: int = 5000):
    out = []
    for r in records:
        out.append(r)
        if len(out) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)


def _cut(conv_type: pa.DataType):
    """Rows in order -> the same with their block and place; the last row of a block has the block's matrix."""
    schema = pa.schema([("conv", conv_type), ("block", pa.int64()), ("at", pa.int32()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("m", pa.binary())])

    def records(batches):
        number = TaskContext.get().partitionId() << 40
        for (conv,), rows in _grouped(batches, 1, BLOCK):
            m = np.where(np.eye(SIZE, dtype=bool), 0, INF)
            for r in rows:
                m = np.minimum((m[:, :, None] + STEP[role_number(r[2])][None]).min(1), INF)
            for k, r in enumerate(rows):
                yield conv, number, k, *r[1:4], m.astype(np.int64).tobytes() if k == len(rows) - 1 else None
            number += 1

    return lambda batches: _batches(records(batches), schema)


def _chain(batches):
    """Entry and exit state of each block of a conversation, from rows (conv, block, matrix) in order."""
    schema = pa.schema([("block", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_())])

    def records():
        for _, rows in _grouped(batches, 1):
            cost = np.full(SIZE, INF, np.int64)
            cost[START] = 0
            back = []
            for r in rows:
                m = cost[:, None] + np.frombuffer(r[2], np.int64).reshape(SIZE, SIZE)
                back.append(m.argmin(0))
                cost = np.minimum(m.min(0), INF)
            s = int(np.argmin(cost + END_COST))
            ends = []
            for frm in reversed(back):
                ends.append((int(frm[s]), s))
                s = int(frm[s])
            for k, (r, (a, b)) in enumerate(zip(rows, reversed(ends))):
                yield r[1], a, b, k == 0, k == len(rows) - 1

    return _batches(records(), schema)


def _turn(role: int) -> str:
    return f"<|{ROLES[role]}|>\n"


def _repair(conv_type: pa.DataType):
    """Rows (block, conv, turn, role, text, entry, exit, first, last) in order -> repaired turns."""
    names = ["conv", "turn", "role", "new_role", "action", "inserted", "cost", "piece"]
    schema = pa.schema(list(zip(names, [conv_type, pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string()])))

    def records(batches):
        for _, rows in _grouped(batches, 1):
            entry, exit_, first, last = rows[0][5:9]
            roles = [role_number(r[3]) for r in rows]
            _, states = walk(roles, entry, exit_)
            before = entry
            for k, (r, role, q) in enumerate(zip(rows, roles, states)):
                cost, action, extra = OPTIONS[role][before][q]
                text = (r[4] or "").replace("<|", "< |")
                start = first and k == 0
                if action.startswith("merge"):
                    piece = "\n\n" + text
                else:
                    piece = ("" if start else "<|end|>\n") + "".join(_turn(x) + "<|end|>\n" for x in extra) + _turn(q) + text
                inserted = [ROLES[x] for x in extra]
                if last and k == len(rows) - 1:
                    piece += "<|end|>\n" + "".join(_turn(x) + "<|end|>\n" for x in END_PATH[q])
                    inserted += ["+" + ROLES[x] for x in END_PATH[q]]
                    cost += int(END_COST[q])
                before = q
                yield r[1], r[2], r[3], ROLES[q], action, ",".join(inserted), cost, piece

    return lambda batches: _batches(records(batches), schema)


def repair_roles(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: conv_id, turn, role, new_role, action, inserted roles ("+": after the last turn), cost and rendered ``piece``."""
    conv = turns.schema[conv_col].dataType
    kind, arrow = conv.simpleString(), to_arrow_type(conv)
    src = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).try_cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"),
        F.xxhash64(text_col).alias("h"), F.monotonically_increasing_id().alias("n"),
    )
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc_nulls_first("role"), "h", "n"]
    ordered = src.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "role", "text")
    rows = materialise(ordered.mapInArrow(_cut(arrow), f"conv {kind}, block long, at int, turn long, role string, text string, m binary"), "turns")
    blocks = rows.filter("m IS NOT NULL").select("conv", "block", "m").repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), "block")
    states = materialise(blocks.mapInArrow(_chain, "block long, entry int, exit int, first boolean, last boolean"), "states")
    full = rows.drop("m").join(states, "block").repartition("block").sortWithinPartitions("block", "at").select("block", "conv", "turn", "role", "text", "entry", "exit", "first", "last")
    out = full.mapInArrow(_repair(arrow), f"conv {kind}, turn long, role string, new_role string, action string, inserted string, cost long, piece string")
    return out.withColumnsRenamed({"conv": conv_col, "turn": turn_col, "role": role_col})


def op9_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_roles(read_table(spark, sf_dir, "conversations"))
