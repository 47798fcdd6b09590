"""Operator 9: chat formatting with minimum-cost repair of the roles.

A legal conversation is an optional system turn, then user and assistant in turn, the
assistant last. A dynamic program over this automaton (states: what the last turn is)
chooses for every turn whether to keep it, merge it into the turn before, relabel it,
or put an empty turn before it, at the least total cost. A turn's costs depend on its
role alone, so a stretch of a conversation is a 4 x 4 matrix in (min, +) algebra, and a
conversation of any length may lie in several partitions:

1. rows are range-partitioned by (conv_id, turn, role, text) and checkpointed;
2. each partition tells the matrices of its first and last conversation (two rows a
   partition go to the driver, whatever the table holds);
3. with costs-to-go at the partition ends known, each tells where such a stretch leads
   from each state; then every stretch's entry state is known, and the turns are
   rendered in place.

Among equal costs the earlier of keep, merge, relabel, insert, insert and relabel is
taken, from the first turn on; so the result doesn't depend on the partitioning.

Defined results: null and unknown roles are relabelled (at a lower cost); null text is
empty; rows without conv_id are one conversation; turns are ordered by turn (nulls
first), ties by role and text; repeated rows are turns of their own; an empty table
gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, shared_dir, ship

ROLES = ("system", "user", "assistant")
START, OTHER = 3, 3
#: next turn allowed after each state (a role's number, or START)
LEGAL = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
MERGE, MERGE_OTHER, RELABEL, RELABEL_OTHER, INSERT = 1, 3, 2, 1, 3
ACTIONS = ("keep", "merge", "relabel", "insert", "insert+relabel")
FAR = 10**9


def _moves() -> list[list[list[tuple[int, int, int, int]]]]:
    """moves[role][state]: (cost, action, inserted role or -1, next state), in order of preference."""
    out = []
    for role in range(4):
        relabel = RELABEL_OTHER if role == OTHER else RELABEL
        per = []
        for state in range(4):
            own = []
            for q in LEGAL[state]:
                own.append((0, 0, -1, q) if q == role else (relabel, 2, -1, q))
            if state != START:
                own.append((MERGE if role == state else MERGE_OTHER, 1, -1, state))
            for p in LEGAL[state]:
                for q in LEGAL[p]:
                    own.append((INSERT + (0 if q == role else relabel), 3 if q == role else 4, p, q))
            per.append(sorted(own, key=lambda m: (m[1], m[2], m[3])))
        out.append(per)
    return out


MOVES = _moves()
#: cost of ending in each state, with the empty turns that this takes
CLOSING = {2: (), 1: (2,), 0: (1, 2), START: ()}
END = np.array([INSERT * len(CLOSING[0]), INSERT, 0, FAR])
STEP = np.full((4, 4, 4), FAR, np.int64)
for _r in range(4):
    for _s in range(4):
        for _c, _, _, _q in MOVES[_r][_s]:
            STEP[_r, _s, _q] = min(STEP[_r, _s, _q], _c)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None]).min(axis=1), FAR)


def matrix(roles: np.ndarray) -> np.ndarray:
    """The (min, +) product of the turns' matrices, by halves."""
    now = STEP[roles]
    while len(now) > 1:
        even = np.minimum((now[0 : len(now) // 2 * 2 : 2, :, :, None] + now[1::2, None, :, :]).min(axis=2), FAR)
        now = np.concatenate([even, now[-1:]]) if len(now) % 2 else even
    return now[0]


def to_go(roles: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least cost to finish from each state before each turn (and after the last)."""
    out = np.empty((len(roles) + 1, 4), np.int64)
    out[-1] = end
    for i in range(len(roles) - 1, -1, -1):
        out[i] = np.minimum((STEP[roles[i]] + out[i + 1]).min(axis=1), FAR)
    return out


def follow(roles: np.ndarray, left: np.ndarray, state: int) -> list[tuple[int, int, int, int]]:
    """The chosen move of each turn from an entry state, given the costs to go."""
    out = []
    for role, after in zip(roles.tolist(), left[1:].tolist(), strict=True):
        move = min(MOVES[role][state], key=lambda m: m[0] + after[m[3]])  # the first of equals
        out.append(move)
        state = move[3]
    return out


def repaired(roles: list[str | None]) -> tuple[int, list[tuple[int, int, int, int]], tuple[int, ...]]:
    """Cost, moves and closing turns of one whole conversation, for use without Spark."""
    if not roles:
        return 0, [], ()
    codes = numbers(roles)
    left = to_go(codes, END)
    moves = follow(codes, left, START)
    return int(left[0, START]), moves, CLOSING[moves[-1][3]]


def numbers(roles: list[str | None]) -> np.ndarray:
    known = {r: i for i, r in enumerate(ROLES)}
    return np.array([known.get(r, OTHER) for r in roles], np.int64)


def opened(role: int, first: bool, text: str) -> str:
    return ("" if first else "<|im_end|>\n") + f"<|im_start|>{ROLES[role]}\n{text}"


def rendered(move: tuple[int, int, int, int], state: int, text: str) -> str:
    """What a turn adds to the conversation's text."""
    _, action, inserted, role = move
    if action == 1:
        return f"\n\n{text}"
    out, first = "", state == START
    if inserted >= 0:
        out, first = opened(inserted, first, ""), False
    return out + opened(role, first, text)


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, pa.Table, bool]]:
    """Rows of one conversation after another: its id, its rows, and whether they are the partition's last."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id")
        filled, null = np.asarray(ids.fill_null(0)), np.asarray(ids.is_null())
        edges = [0, *(np.flatnonzero((filled[1:] != filled[:-1]) | (null[1:] != null[:-1])) + 1).tolist(), batch.num_rows]
        for low, high in pairwise(edges):
            part = batch.slice(low, high - low)
            if kept and kept[0].column("conv_id")[0].as_py() != part.column("conv_id")[0].as_py():
                yield kept[0].column("conv_id")[0].as_py(), pa.Table.from_batches(kept), False
                kept = []
            kept.append(part)
    if kept:
        yield kept[0].column("conv_id")[0].as_py(), pa.Table.from_batches(kept), True


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, conv_id, place, matrix) of a partition's first (0) and last (1) conversation."""
    part, first = TaskContext.get().partitionId(), True
    for conv, table, last in stretches(batches):
        if first or last:
            m = matrix(numbers(table.column("role").to_pylist())).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([conv], pa.int64()), pa.array([1 if last and not first else 0]), pa.array([m.tolist()], pa.list_(pa.int64()))], ["part", "conv_id", "place", "matrix"])
        first = False


def _leads(ends: dict[tuple[int, int], list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first = TaskContext.get().partitionId(), True
        for _, table, last in stretches(batches):
            place = 1 if last and not first else 0
            if (first or last) and (part, place) in ends:
                roles = numbers(table.column("role").to_pylist())
                left = to_go(roles, np.array(ends[part, place]))
                to = [follow(roles, left, s)[-1][3] for s in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([place], pa.int64()), pa.array([to], pa.list_(pa.int64()))], ["part", "place", "to"])
            first = False

    return run


SCHEMA = "conv_id long, turn long, role string, action string, new_role string, cost int, inserted array<string>, closing array<string>, rendered string"


def _render(ends: dict[tuple[int, int], list[int]], entries: dict[tuple[int, int], int], open_: set[tuple[int, int]]):
    """open_: stretches that the conversation continues after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first = TaskContext.get().partitionId(), True
        for conv, table, last in stretches(batches):
            key = (part, 1 if last and not first else 0)
            edge, first = first or last, False
            roles = numbers(table.column("role").to_pylist())
            state = entries.get(key, START) if edge else START
            left = to_go(roles, np.array(ends[key]) if edge and key in ends else END)
            moves, at = follow(roles, left, state), 0
            for batch in table.to_batches(max_chunksize=2000):
                rows = []
                for turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("turn", "role", "text")), strict=True):
                    move = moves[at]
                    at += 1
                    piece = rendered(move, state, text or "")
                    closing = CLOSING[move[3]] if at == len(moves) and not (edge and key in open_) else ()
                    if at == len(moves) and not (edge and key in open_):
                        piece += "".join(opened(r, False, "") for r in closing) + "<|im_end|>\n"
                    rows.append((conv, turn, role, ACTIONS[move[1]], ROLES[move[3]], move[0] + INSERT * len(closing), [ROLES[move[2]]] if move[2] >= 0 else [], [ROLES[r] for r in closing], piece))
                    state = move[3]
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return run


def format_chats(turns: DataFrame) -> DataFrame:
    """One row for each turn of (conv_id, turn, role, text); a conversation's ``rendered`` in order is its text."""
    spark = turns.sparkSession
    ship(spark)
    shared_dir(spark)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = ["conv_id", "turn", "role", "text", "tie"]
    rows = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).drop("tie").checkpoint()

    chains: dict[int | None, list[tuple[int, int, np.ndarray]]] = {}
    for r in rows.mapInArrow(_edges, "part long, conv_id long, place long, matrix array<long>").collect():  # two rows a partition
        chains.setdefault(r["conv_id"], []).append((r["part"], r["place"], np.array(r["matrix"]).reshape(4, 4)))
    chains = {c: sorted(x, key=lambda y: y[:2]) for c, x in chains.items() if len(x) > 1}
    ends, entries, open_ = {}, {}, set()
    for chain in chains.values():
        cost = END
        for part, place, m in reversed(chain):
            ends[part, place] = cost.tolist()
            cost = np.minimum((m + cost).min(axis=1), FAR)
        open_.update((part, place) for part, place, _ in chain[:-1])
    if chains:
        leads = {(r["part"], r["place"]): r["to"] for r in rows.mapInArrow(_leads(ends), "part long, place long, to array<long>").collect()}
        for chain in chains.values():
            state = START
            for part, place, _ in chain:
                entries[part, place] = state
                state = leads[part, place][state]
    return rows.mapInArrow(_render(ends, entries, open_), SCHEMA)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read(spark, sf_dir, "conversations"))
