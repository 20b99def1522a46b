"""What is asked of the graphs of contracts, which are a few rows each, in one pass.

A flow's rows of all kinds come together in one shuffle by flow_id and go through these functions in Arrow batches of many flows: names become numbers, and
all graphs of a batch are one graph without edges between flows, that numpy walks level by level."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanflow.functions.scalars import INITIAL_VARIABLES
from spanflow.operators.steps import checkpointed

NODE, EDGE, REFERENCE, OUTPUT, STEP = range(5)
#: Rows of a flow that are handled as one; above, :mod:`spanflow.operators.graph` works in rounds over tables, with the same results.
BOUND = 100_000


def rows(kind: int, table: DataFrame, a: str, b: str | None = None, n: str | None = None) -> DataFrame:
    null = lambda c, t: F.col(c).cast(t) if c else F.lit(None).cast(t)
    return table.select("flow_id", F.lit(kind).alias("kind"), null(n, "long").alias("n"), null(a, "string").alias("a"), null(b, "string").alias("b"))


def split(parts: list[DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """All rows of ``parts``, written once, and the flows (flow_id) that have more than BOUND of them; None if there is no such flow."""
    table = checkpointed(reduce(DataFrame.unionByName, parts))
    large = table.groupBy("flow_id").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BOUND).select("flow_id")
    return (table, None) if large.isEmpty() else (table, checkpointed(large))


@dataclass
class Rows:
    """Rows of ``flows`` flows: the number of a row's flow, its kind, n (and whether it has none), and a and b as places in ``names``, which has null too."""

    flows: int
    flow: np.ndarray
    kind: np.ndarray
    n: np.ndarray
    no_n: np.ndarray
    a: np.ndarray
    b: np.ndarray
    names: pa.Array

    def keys(self, kind: int, column: str) -> np.ndarray:
        """A number for each flow and name."""
        here = self.kind == kind
        return self.flow[here] * len(self.names) + getattr(self, column)[here]

    def place(self, name: str | None) -> int:
        return self.names.index(pa.scalar(name, self.names.type)).as_py() if name is not None else int(np.argmax(self.names.is_null())) if self.names.null_count else -1

    def lists(self, flow: int, *kinds: int) -> list[list[tuple]]:
        """A flow's rows of each kind as (n, a, b)."""
        lo, hi = np.searchsorted(self.flow, [flow, flow + 1])
        by: dict[int, list] = {k: [] for k in kinds}
        for i in range(lo, hi):
            if self.kind[i] in by:
                by[self.kind[i]].append((None if self.no_n[i] else int(self.n[i]), self.names[self.a[i]].as_py(), self.names[self.b[i]].as_py()))
        return list(by.values())


def of_flows(table: DataFrame, f: Callable[[Rows], tuple[np.ndarray, list[pa.Array]]], fields: list[tuple[str, str]]) -> DataFrame:
    """flow_id and ``found``, an array of ``fields`` (name and type), which ``f`` makes of the :class:`Rows` of many flows: the numbers of flows, and a column a field."""
    table = table.groupBy("flow_id").agg(F.collect_list(F.struct("kind", "n", "a", "b")).alias("rows"))  # BOUND at most
    kind = table.schema["flow_id"].dataType.simpleString()
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    item = pa.struct([(name, types[t]) for name, t in fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col, flows = batch.column(1), batch.num_rows
            at = col.offsets.to_numpy()
            k, n, a, b = (c.slice(at[0], at[-1] - at[0]) for c in col.values.flatten())
            named = pa.concat_arrays([a.cast(pa.large_string()), b.cast(pa.large_string())]).dictionary_encode(null_encoding="encode")
            code = named.indices.to_numpy().astype(np.int64)
            rows_ = Rows(flows, np.repeat(np.arange(flows), np.diff(at)), k.to_numpy(), n.fill_null(0).to_numpy(), n.is_null().to_numpy(zero_copy_only=False), code[: len(a)], code[len(a) :], named.dictionary)
            flow, columns = f(rows_)
            by = np.argsort(flow, kind="stable")
            ends = np.searchsorted(flow[by], np.arange(flows + 1)).astype(np.int32)
            found = pa.StructArray.from_arrays([c.cast(x.type).take(pa.array(by)) for c, x in zip(columns, item, strict=True)], fields=list(item))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), found)], names=["flow_id", "found"])

    return table.mapInArrow(each, f"flow_id {kind}, found array<struct<{','.join(f'{name}:{t}' for name, t in fields)}>>")


def _at(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of ``keys`` in the sorted ``ids``, or -1."""
    if not len(ids):
        return np.full(len(keys), -1)
    i = np.minimum(np.searchsorted(ids, keys), len(ids) - 1)
    return np.where(ids[i] == keys, i, -1)


class _Graph:
    """Edges between places 0 to ``size``, by the place that they leave."""

    def __init__(self, size: int, from_: np.ndarray, to: np.ndarray) -> None:
        by = np.argsort(from_, kind="stable")
        self.to, self.start = to[by], np.searchsorted(from_[by], np.arange(size + 1))

    def out(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both ends of the edges that leave ``places``."""
        n = self.start[places + 1] - self.start[places]
        edge = np.arange(n.sum()) + np.repeat(self.start[places] - np.cumsum(n) + n, n)
        return np.repeat(places, n), self.to[edge]

    def layers(self, open_: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places by the longest path to them, and both ends of the edges that leave these; ``open_`` counts the edges into each place. Places on or behind cycles do not come."""
        left, ready = open_.copy(), np.flatnonzero(open_ == 0)
        while len(ready):
            source, to = self.out(ready)
            yield ready, source, to
            np.subtract.at(left, to, 1)
            ready = np.unique(to[left[to] == 0])


def _facts(ids: np.ndarray, a: np.ndarray, b: np.ndarray, nameless: np.ndarray, known_only: bool = False) -> tuple[np.ndarray, ...]:
    """Level (or -1), entry, reached, round and what a node is folded after (or -1), of nodes ``ids`` with edges between keys."""
    size, from_, to = len(ids), _at(ids, a), _at(ids, b)
    kept = (to >= 0) & ((from_ >= 0) | (not known_only))
    from_, to = from_[kept], to[kept]
    open_, sole = np.bincount(to, minlength=size), np.full(size, -1)
    sole[to] = from_
    single = (open_ == 1) & (sole >= 0)
    width = np.bincount(sole[single], minlength=size)
    graph = _Graph(size, from_[from_ >= 0], to[from_ >= 0])
    level, round_, folded = np.full(size, -1), np.zeros(size, int), np.full(size, -1)
    for k, (ready, source, target) in enumerate(graph.layers(open_)):
        level[ready], p = k, sole[ready]
        fold = single[ready] & (width[p] > 1) & (folded[p] < 0) & ~nameless[p]
        v, p = ready[fold], p[fold]
        folded[v], round_[v] = p, round_[p]
        np.maximum.at(round_, target, round_[source] + 1)
    entry = open_ == 0
    reached, new = entry.copy(), np.flatnonzero(entry)
    while len(new):
        to = graph.out(new)[1]
        new = np.unique(to[~reached[to]])
        reached[new] = True
    return level, entry, reached, round_, folded


FACTS = [("node", "string"), ("n", "long"), ("level", "int"), ("entry", "boolean"), ("reached", "boolean"), ("round", "int"), ("parallel_of", "string")]


def facts(rows: Rows, known_only: bool = False) -> tuple[np.ndarray, list[pa.Array]]:
    """FACTS of every node: its level (longest path from an entry; none on and behind cycles), whether it is an entry (has no predecessor) and is reached from
    one, the round in which folding emits it, and the node after which it is folded into a parallel group.

    An edge from what is no node blocks its target, or is left out with ``known_only``. A node is folded if it has one edge in, its
    predecessor has several such successors and is not folded itself. Folded nodes are emitted in their predecessor's round, others in the round
    after the last of their predecessors'."""
    ids, which = np.unique(rows.keys(NODE, "a"), return_inverse=True)
    n, no_n = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    n[which], no_n[which] = rows.n[rows.kind == NODE], rows.no_n[rows.kind == NODE]
    flow, node = np.divmod(ids, max(len(rows.names), 1))
    level, entry, reached, round_, folded = _facts(ids, rows.keys(EDGE, "a"), rows.keys(EDGE, "b"), node == rows.place(None), known_only)
    none = level < 0
    after = pa.array(node[folded] if len(ids) else node, mask=folded < 0)
    return flow, [rows.names.take(pa.array(node)), pa.array(n, mask=no_n), pa.array(level, mask=none), pa.array(entry), pa.array(reached), pa.array(round_, mask=none), rows.names.take(after)]


UNKNOWN = [("node", "string"), ("variable", "string")]


def unknown(rows: Rows) -> tuple[np.ndarray, list[pa.Array]]:
    """References (node, variable) whose root no predecessor, direct or not, puts out.

    Predecessors are bits of one number a node, made along the levels; flows with cycles or more than 64 ends of edges go through :func:`unknown_of_flow`."""
    size, refs, outs = max(len(rows.names), 1), rows.kind == REFERENCE, rows.kind == OUTPUT
    a, b = rows.keys(EDGE, "a"), rows.keys(EDGE, "b")
    ids = np.unique(np.concatenate([a, b]))
    flow = ids // size
    bit = np.arange(len(ids)) - np.searchsorted(flow, flow)
    a, b = _at(ids, a), _at(ids, b)
    done, above = bit < 64, np.zeros(len(ids), np.uint64)
    own = np.left_shift(np.uint64(1), np.where(done, bit, 0).astype(np.uint64))
    ordered = np.zeros(len(ids), bool)
    for ready, source, to in _Graph(len(ids), a, b).layers(np.bincount(b, minlength=len(ids))):
        ordered[ready] = True
        np.bitwise_or.at(above, to, above[source] | own[source])
    walked = np.zeros(rows.flows, bool)
    walked[flow[~(done & ordered)]] = True

    root = np.full(size, -1)
    variables = np.unique(rows.b[refs])
    place = {name: k for k, name in enumerate(rows.names.to_pylist())} if len(variables) else {}
    for v, name in zip(variables.tolist(), rows.names.take(pa.array(variables)).to_pylist(), strict=True):
        root[v] = place.get(name.split(".")[0], -1)
    put, which = np.unique(rows.keys(OUTPUT, "b"), return_inverse=True)
    by, masks = _at(ids, rows.keys(OUTPUT, "a")), np.zeros(len(put) + 1, np.uint64)
    np.bitwise_or.at(masks, which[by >= 0], own[by[by >= 0]])
    flow, node, variable = rows.flow[refs], rows.a[refs], rows.b[refs]
    mask = masks[np.where(root[variable] >= 0, _at(put, flow * size + root[variable]), -1)]  # the last one is empty
    seen = _at(ids, rows.keys(REFERENCE, "a"))
    lost = ~walked[flow] & ((np.append(above, np.uint64(0))[seen] & mask) == 0)
    more = [(k, *x) for k in np.unique(flow[walked[flow]]).tolist() for x in unknown_of_flow(*rows.lists(k, EDGE, REFERENCE, OUTPUT))]
    extra = [pa.array([x[c] for x in more], pa.large_string()) for c in (1, 2)]
    columns = [pa.concat_arrays([rows.names.take(pa.array(c[lost])), e]) for c, e in zip((node, variable), extra, strict=True)]
    return np.concatenate([flow[lost], np.array([x[0] for x in more], flow.dtype)]), columns


def unknown_of_flow(edges: list, refs: list, outs: list) -> list[tuple]:
    """References (node, variable) whose root no predecessor, direct or not, puts out.

    Most are settled by a direct predecessor; only where one is not, the predecessors of all nodes are made, as bits of one number a node, along the levels."""
    before, put = defaultdict(set), defaultdict(set)
    for _, a, b in edges:
        before[b].add(a)
    for _, node, variable in outs:
        put[variable].add(node)
    open_ = [(node, v) for _, node, v in refs if not before[node] & put[v.split(".")[0]]]
    if not open_:
        return []
    bit = {v: 1 << i for i, v in enumerate(dict.fromkeys(x for _, a, b in edges for x in (a, b)))}
    after, left, above = defaultdict(list), {v: len(before[v]) for v in bit}, dict.fromkeys(bit, 0)
    for b, all_ in list(before.items()):
        for a in all_:
            after[a].append(b)
    queue = [v for v in bit if not left[v]]
    for v in queue:
        for w in after[v]:
            above[w] |= above[v] | bit[v]
            left[w] -= 1
            if not left[w]:
                queue.append(w)
    done = set(queue)

    def ancestors(v: str) -> int:
        if v in done or v not in bit:
            return above.get(v, 0)
        seen, todo = set(), [v]  # on or behind a cycle
        for x in todo:
            new = before[x] - seen
            seen |= new
            todo += new
        above[v] = sum(bit[x] for x in seen)
        done.add(v)
        return above[v]

    masks = {r: sum(bit.get(x, 0) for x in put[r]) for r in {v.split(".")[0] for _, v in open_}}
    return [(node, v) for node, v in open_ if not ancestors(node) & masks[v.split(".")[0]]]


def too_early(steps: list, refs: list, outs: list) -> list[tuple]:
    """References (node, variable) of a linear flow's steps (pos, step) whose root no step of a smaller position puts out."""
    at, since = defaultdict(list), {}
    for pos, step, _ in steps:
        if step is not None:
            at[step].append(pos)
    for _, node, variable in outs:
        for pos in at.get(node, []):
            if pos is not None:
                since[variable] = min(pos, since.get(variable, pos))
    late = lambda first, pos: first is None or pos is not None and first >= pos
    return [(node, v) for _, node, v in refs for pos in at.get(node, []) if late(since.get(v.split(".")[0]), pos)]


ISSUES = [("level", "string"), ("rule", "string"), ("subject", "string")]


def issues(rows: Rows) -> tuple[np.ndarray, list[pa.Array]]:
    """ISSUES that the rows of flows show: names used twice or empty, edges from or to what is no node, nodes that cannot be ordered or reached, variables
    that nothing before puts out, and the linear format."""
    size, null, empty = max(len(rows.names), 1), rows.place(None), rows.place("")
    names, a, b = np.unique(rows.keys(NODE, "a")), rows.keys(EDGE, "a"), rows.keys(EDGE, "b")
    found: list[tuple] = []

    def add(rule: str, flow: np.ndarray, subject: pa.Array | list, level: str = "ERROR") -> None:
        found.append((flow, pa.repeat(level, len(flow)), pa.repeat(rule, len(flow)), pa.array(subject, pa.large_string()) if isinstance(subject, list) else subject))

    text = lambda keys: rows.names.take(pa.array(keys % size))
    known = (_at(names, a) >= 0) & (_at(names, b) >= 0) & (a % size != null) & (b % size != null)
    ends, which = np.unique(a[~known], return_inverse=True)
    pairs = np.unique(which * size + b[~known] % size)
    add("dangling edge", ends[pairs // size] // size, text(pairs))
    for rule, kind in (("step name", STEP), ("node name", NODE)):
        keys = rows.keys(kind, "a")
        keys = np.where(keys % size == null, keys - null + empty, keys) if min(null, empty) >= 0 else keys
        uses, times = np.unique(keys, return_counts=True)
        bad = uses[(times > 1) | (uses % size == (empty if empty >= 0 else null))]
        add(rule, bad // size, text(bad).fill_null(""))
    level, entry, reached, *_ = _facts(names, a[known], b[known], names % size == null)
    per_flow = lambda which: np.bincount(names[which] // size, minlength=rows.flows)
    blocked, unreached, entries = per_flow(level < 0), per_flow(~reached), per_flow(entry)
    for rule, n in (("cycle", blocked), ("unreachable nodes", unreached * (entries > 0))):
        flow = np.flatnonzero(n)
        add(rule, flow, [str(x) for x in n[flow].tolist()])
    for flow in np.unique(rows.flow[rows.kind == REFERENCE]).tolist():
        lost = variables_of_flow(*rows.lists(flow, NODE, EDGE, REFERENCE, OUTPUT, STEP))
        add("unknown variable", np.full(len(lost), flow), [node for node, _ in lost])
    legacy = np.unique(rows.flow[rows.kind == STEP])
    add("legacy format", legacy, ["flow"] * len(legacy), "WARN")
    flow, *columns = zip(*found, strict=True)
    return np.concatenate(flow), [pa.concat_arrays(c) for c in columns]


def variables_of_flow(nodes: list, edges: list, refs: list, outs: list, steps: list) -> list[tuple]:
    """References (node, variable) of a graph or of a linear flow that nothing before puts out."""
    names = {a for _, a, _ in nodes} - {None}
    known = [(n, a, b) for n, a, b in edges if a in names and b in names]
    refs = [r for r in refs if r[2] is not None and r[2].split(".")[0] not in INITIAL_VARIABLES]
    return (unknown_of_flow(known, refs, outs) if nodes else []) + too_early(steps, refs, outs)


def count(where: Callable[[Column], Column]) -> Column:
    """How many of ``found`` are so, as a long."""
    return F.size(F.filter("found", where)).cast("long")
