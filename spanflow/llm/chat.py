"""Chat formatting: minimum-cost role repair over a legal-turn automaton."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanflow.llm.common import batched, written

ROLES = ("system", "user", "assistant")
#: States: nothing said yet, then the role of the last turn.
START = 3
#: Legal next turns: a system turn only at the beginning, then user and assistant by turns.
LEGAL = {(START, 0), (START, 1), (0, 1), (1, 2), (2, 1)}
FAR = 10**9
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"


def _paths(insert: int) -> dict[tuple[int, int], tuple[int, tuple[int, ...]]]:
    """Cheapest empty turns to put between two states so that each step is legal: (cost, roles)."""
    found = {}
    for s in range(4):
        queue = [(s, ())]
        for at, way in queue:
            for r in range(3):
                if (at, r) in LEGAL and (s, r) not in found:
                    found[s, r] = (insert * len(way), way)
                    queue.append((r, (*way, r)))
    return found


def steps(relabel: int = 3, merge: int = 1, insert: int = 4) -> list[list[list[tuple[int, int, str, int, tuple[int, ...]]]]]:
    """For each role (3: unknown) and state, the possible (cost, next state,
    action, role, inserted roles), cheapest first and then in a fixed order."""
    paths, out = _paths(insert), []
    for role in range(4):
        states = []
        for s in range(4):
            options = []
            for r in range(3):
                change = 0 if r == role else relabel
                if r == s:
                    options.append((change + merge, r, "merge", r, ()))
                if (s, r) in paths:
                    cost, way = paths[s, r]
                    options.append((change + cost, r, ("insert" if way else "keep") if r == role else "relabel", r, way))
            states.append(sorted(options))
        out.append(states)
    return out


def transfer(roles: list[int], table: list) -> np.ndarray:
    """Least costs from each state before a run of turns to each state after it."""
    best = np.where(np.eye(4, dtype=bool), 0, FAR).tolist()
    for role in roles:
        new = [[FAR] * 4 for _ in range(4)]
        for entry, row in zip(range(4), best, strict=True):
            for s, have in enumerate(row):
                if have < FAR:
                    for cost, r, *_ in table[role][s]:
                        if have + cost < new[entry][r]:
                            new[entry][r] = have + cost
        best = new
    return np.array(best, np.int64)


def walk(roles: list[int], entry: int, leave: int, table: list) -> list[tuple[int, int, str, int, tuple[int, ...]]]:
    """The steps of one cheapest way from ``entry`` to ``leave`` (ties: the first option)."""
    costs, back = [[0 if s == entry else FAR for s in range(4)]], []
    for role in roles:
        row, frm = [FAR] * 4, [None] * 4
        for s in range(4):
            if costs[-1][s] < FAR:
                for option in table[role][s]:
                    if costs[-1][s] + option[0] < row[option[1]]:
                        row[option[1]], frm[option[1]] = costs[-1][s] + option[0], (s, option)
        costs.append(row)
        back.append(frm)
    out, at = [], leave
    for frm in reversed(back):
        at, option = frm[at]
        out.append(option)
    return out[::-1]


def repair(turns: DataFrame, block: int = 1024, relabel: int = 3, merge: int = 1, insert: int = 4) -> DataFrame:
    """Repaired and rendered conversations, a row per turn said or put in: conv_id,
    turn, part, role_in, role, action (keep, merge, relabel or insert), cost (of the whole
    conversation), rendered.

    A legal conversation is an optional system turn, then user and assistant by turns, user
    first and assistant last. A turn may be relabelled, merged with the one before if the
    roles are then equal, or empty turns may be put in; the least total cost wins, ties by a
    fixed order. Roles count without case and surrounding space; null and unknown roles must be
    relabelled. Null texts are empty. Turns go by number, null last, then by
    role and text. A null conv_id is a conversation of its own. Empty tables give no
    rows. The rendered parts of a conversation, by (turn, part), make up its text.

    Costs of a run of turns are a 4 x 4 matrix under minimum and sum, so a conversation of
    any length is cut into blocks of turn numbers: blocks are summed up by
    many tasks, one row a block is chained per conversation, and blocks are then
    walked by many tasks. No task holds a conversation."""
    table = steps(relabel, merge, insert)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.lower(F.trim("role")).alias("role_in"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(2**62)).cast("long"))
    key = ["conv_id", "block"]
    ordered = ["conv_id", "block", F.col("turn").asc_nulls_last(), "role_in", "text"]
    code = {r: k for k, r in enumerate(ROLES)}

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
        yield from ((k, list(g)) for k, g in groupby((r for b in batches for r in b.to_pylist()), key=lambda r: (r["conv_id"], r["block"])))

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("costs", pa.list_(pa.int64()))])
        out = [(c, b, transfer([code.get(r["role_in"], 3) for r in g], table).ravel().tolist()) for (c, b), g in runs(batches)]
        yield from batched(schema, [list(x) for x in zip(*out, strict=True)] or [[], [], []])

    roles = rows.select(*key, "turn", "role_in", "text")
    sums = rows.select(*key, "turn", "role_in", F.lit("").alias("text")).repartition(*key).sortWithinPartitions(*key, F.col("turn").asc_nulls_last(), "role_in")
    # Order inside a turn by text matters to the walk only where roles are equal, and so not to costs.
    sums = sums.mapInArrow(sum_up, "conv_id long, block long, costs array<long>")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("last", pa.bool_())])
        close = [_paths(insert)[s, 2][0] + insert if s != 2 else 0 for s in range(4)]
        out = []
        for conv, group in groupby((r for b in batches for r in b.to_pylist()), key=lambda r: r["conv_id"]):
            blocks = [(r["block"], np.array(r["costs"]).reshape(4, 4)) for r in group]
            costs, back = np.where(np.arange(4) == START, 0, FAR), []
            for _, m in blocks:
                total = costs[:, None] + m
                back.append(total.argmin(0))
                costs = np.minimum(total.min(0), FAR)
            at = int(np.argmin(costs + np.array(close)))
            cost, ways = int(costs[at] + close[at]), []
            for (b, _), frm in zip(reversed(blocks), reversed(back), strict=True):
                ways.append((conv, b, int(frm[at]), at, cost, b == blocks[-1][0]))
                at = int(frm[at])
            out += ways
        yield from batched(schema, [list(x) for x in zip(*out, strict=True)] or [[]] * 6)

    chained = sums.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(chain, "conv_id long, block long, entry int, leave int, cost long, last boolean")
    chained = written(chained, "chained").select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "entry", "leave", "cost", "last")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("part", pa.int64()), ("role_in", pa.string()), ("role", pa.string()), ("action", pa.string()), ("cost", pa.int64()), ("rendered", pa.string())])
        for (conv, _), group in runs(batches):
            out, one = [], group[0]
            state = one["entry"]
            for k, (r, (_, to, action, role, way)) in enumerate(zip(group, walk([code.get(r["role_in"], 3) for r in group], one["entry"], one["leave"], table), strict=True)):
                for j, x in enumerate(way):
                    out.append((conv, r["turn"], 16 * k + j, None, ROLES[x], "insert", one["cost"], (CLOSE if state != START else "") + OPEN.format(ROLES[x])))
                    state = x
                start = "\n" if action == "merge" else (CLOSE if state != START else "") + OPEN.format(ROLES[role])
                out.append((conv, r["turn"], 16 * k + 8, r["role_in"], ROLES[role], "keep" if action == "insert" else action, one["cost"], start + r["text"]))
                state = to
            if one["last"]:
                closing = [] if state == 2 else [*_paths(insert)[state, 2][1], 2]
                for j, x in enumerate(closing):
                    out.append((conv, group[-1]["turn"], 16 * len(group) + j, None, ROLES[x], "insert", one["cost"], CLOSE + OPEN.format(ROLES[x])))
                out.append((conv, group[-1]["turn"], 16 * len(group) + 8, None, None, "end", one["cost"], CLOSE))
            yield from batched(schema, [list(x) for x in zip(*out, strict=True)])

    both = roles.join(chained, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    both = both.select("conv_id", "block", "turn", "role_in", "text", "entry", "leave", "cost", "last").repartition(*key).sortWithinPartitions(*ordered)
    return both.mapInArrow(render, "conv_id long, turn long, part long, role_in string, role string, action string, cost long, rendered string")
