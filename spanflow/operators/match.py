"""Matching the steps of a contract to the spans of every trace.

Contracts are small tables whose rows the caller has at hand, so a chain of steps becomes
a chain of expressions over one partitioning by trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanflow.functions.scalars import normalize, overlaps, split_call
from spanflow.operators import callgraph, ranges
from spanflow.operators.steps import checkpointed

#: Messages and names of results.
MISSING, SEMANTIC, DAG_STEP = "no matching span found in trace", "Semantic validation failed", "DAG Validation"
SKIPPED, VIOLATED = ("matched span #", " by time sequence (intermediate spans exist)"), ("Detected ", " DAG constraint violations")


def skipped(idx: Column) -> Column:
    return F.concat(F.lit(SKIPPED[0]), idx.cast("string"), F.lit(SKIPPED[1]))


def violated(n: Column) -> Column:
    return F.concat(F.lit(VIOLATED[0]), n.cast("string"), F.lit(VIOLATED[1]))


def is_call(call: str) -> Column:
    """Whether a span's service and name, normalised, are those of a call."""
    service, operation = split_call(F.lit(call))
    return (normalize(F.col("service")) == normalize(service)) & (normalize(F.col("name")) == normalize(operation))


def time_sequence(spans: DataFrame, steps: list[tuple], carry: tuple[str, ...] = ()) -> DataFrame:
    """Greedy matching in order of time: (trace_id, pos, step, call, matched, span_id, status, note), and the columns ``carry`` of the matched span.

    Each step takes the first matching span after the one that the last matched step took; a
    miss leaves that place. One shuffle by trace; each step is a window over it."""
    order = Window.partitionBy("trace_id").orderBy("start_ns", "ordinal")
    whole = Window.partitionBy("trace_id")
    s = spans.select("trace_id", "span_id", "start_ns", "ordinal", "service", "name", *carry).withColumn("idx", F.row_number().over(order))
    s = s.withColumn("at", F.lit(0))
    found = []
    for k, (pos, _, step, call) in enumerate(steps):
        s = s.withColumn(f"m{k}", F.min(F.when(is_call(call) & (F.col("idx") > F.col("at")), F.col("idx"))).over(whole))
        s = s.withColumn(f"at{k}", F.col("at")).withColumn("at", F.coalesce(f"m{k}", "at"))
        note = F.when(F.max(f"m{k}") > F.max(f"at{k}") + 1, skipped(F.max(f"m{k}"))).otherwise("")
        found.append(
            F.struct(
                F.lit(pos).alias("pos"), F.lit(step).alias("step"), F.lit(call).alias("call"), F.max(f"m{k}").alias("matched"),
                F.max(F.when(F.col("idx") == F.col(f"m{k}"), F.col("span_id"))).alias("span_id"),
                F.when(F.max(f"m{k}").isNull(), "FAIL").otherwise("PASS").alias("status"),
                F.when(F.max(f"m{k}").isNull(), MISSING).otherwise(note).alias("note"),
                *[F.max_by(c, F.when(F.col("idx") == F.col(f"m{k}"), F.col("idx"))).alias(c) for c in carry],
            )
        )
    return s.groupBy("trace_id").agg(F.array(*found).alias("r")).select("trace_id", F.inline("r"))


def time_sequence_large(spans: DataFrame, steps: list[tuple], carry: tuple[str, ...] = ()) -> DataFrame:
    """:func:`time_sequence` for traces too large for one task: spans are numbered in ranges, and each step is one aggregation
    with partial results, whose outcome goes back to the ranges. A written table of a row a trace a step."""
    order = ["start_ns", "ordinal"]
    s = ranges.ranged(spans.select("trace_id", "span_id", *order, "service", "name", *carry), order)
    s = checkpointed(ranges.numbered(s, order))
    at, found = s.select("trace_id").distinct().withColumn("at", F.lit(0)), None
    for pos, _, step, call in steps:
        m = s.where(is_call(call)).join(ranges.per_range(s, at), ["trace_id", "range"]).where(F.col("idx") > F.col("at"))
        m = m.groupBy("trace_id").agg(F.min_by(F.struct(F.col("idx").alias("matched"), "span_id", *carry), "idx").alias("m"))
        now = checkpointed(at.join(m, "trace_id", "left").select("trace_id", "at", "m.*"))
        note = F.when(F.col("matched").isNull(), MISSING).when(F.col("matched") > F.col("at") + 1, skipped(F.col("matched"))).otherwise("")
        status = F.when(F.col("matched").isNull(), "FAIL").otherwise("PASS")
        one = now.select("trace_id", F.lit(pos).alias("pos"), F.lit(step).alias("step"), F.lit(call).alias("call"), "matched", "span_id", status.alias("status"), note.alias("note"), *carry)
        found = one if found is None else found.unionByName(one)
        at = now.select("trace_id", F.coalesce("matched", "at").alias("at"))
    return found


def step_presence(spans: DataFrame, steps: list[tuple], carry: tuple[str, ...] = ()) -> DataFrame:
    """Matching in any order, a span may serve several steps: (trace_id, pos, grp, step, call, status, span_id, ...).

    The earliest matching span is taken. One aggregation by trace with partial results per task."""
    found = []
    for pos, grp, step, call in steps:
        first = F.min_by(F.struct("start_ns", "ordinal", "span_id", "end_ns", "parent_span_id", *carry), F.when(is_call(call), F.struct("start_ns", "ordinal")))
        found.append(F.struct(F.lit(pos).alias("pos"), F.lit(grp).cast("string").alias("grp"), F.lit(step).alias("step"), F.lit(call).alias("call"), first.alias("m")))
    r = spans.groupBy("trace_id").agg(F.array(*found).alias("r")).select("trace_id", F.inline("r"))
    return r.select("trace_id", "pos", "grp", "step", "call", F.when(F.col("m").isNull(), "FAIL").otherwise("PASS").alias("status"), "m.span_id", "m.start_ns", "m.end_ns", "m.parent_span_id", "m.ordinal", *[f"m.{c}" for c in carry])


def resolved_parents(spans: DataFrame) -> DataFrame:
    """``spans`` with parent_span_id null unless another span of the trace has that id."""
    return callgraph.known_parents(spans).drop("parent_start", "parent_end")


def _apart(group: str) -> Column:
    """Whether two members of an array of matched steps ran neither at one time nor under one parent. A group is a few steps, so its pairs are compared inside one array."""
    apart = lambda a, b: ~(overlaps(a["start_ns"], a["end_ns"], b["start_ns"], b["end_ns"]) | a["parent_span_id"].eqNullSafe(b["parent_span_id"]))
    return F.exists(group, lambda a: F.exists(group, lambda b: (a["pos"] < b["pos"]) & apart(a, b)))


def _members() -> Column:
    return F.collect_list(F.when((F.col("status") == "PASS") & F.col("grp").isNotNull(), F.struct("pos", "start_ns", "end_ns", "parent_span_id")))


def parallel_groups(matched: DataFrame) -> DataFrame:
    """Whether the matched steps of each parallel group ran at the same time or under one parent:
    (trace_id, grp, n_matched, concurrent). ``matched`` is :func:`step_presence` over resolved parents."""
    s = matched.where("grp IS NOT NULL").groupBy("trace_id", "grp").agg(_members().alias("g"))
    return s.select("trace_id", "grp", F.size("g").alias("n_matched"), (~_apart("g")).alias("concurrent"))


def causality_steps(spans: DataFrame, steps: list[tuple], carry: tuple[str, ...] = ()) -> DataFrame:
    """:func:`step_presence`, where steps of a group that did not run concurrently fail. All in one partitioning by trace."""
    matched = step_presence(resolved_parents(spans), steps, carry).withColumn("g", _members().over(Window.partitionBy("trace_id", "grp")))
    return matched.withColumn("status", F.when((F.col("status") == "PASS") & _apart("g"), "FAIL").otherwise(F.col("status"))).drop("g")


def topological(dag: list[tuple]) -> list[tuple]:
    """Nodes of one contract by (level, declaration position); a contract is a few rows."""
    level: dict[str, int] = {}
    while len(level) < len(dag):
        ready = {n: 1 + max((level[p] for p in ps if p in level), default=-1) for _, n, _, ps in dag if n not in level and all(p in level or p not in {x[1] for x in dag} for p in ps)}
        if not ready:
            raise ValueError("the contract's graph has a cycle")
        level.update(ready)
    return sorted(dag, key=lambda n: (level[n[1]], n[0]))


def graph_match(spans: DataFrame, dag: list[tuple], carry: tuple[str, ...] = ()) -> DataFrame:
    """Nodes to spans without reuse: (trace_id, node, pos, call, span_id, ...), and the columns ``carry`` of the span; span_id is null if none is left.

    The k-th node of a call, in topological order, takes the k-th span of that call in file
    order; names match exactly, and spans of equal service, name and start count once. A rank replaces
    the walk, and a contract's few nodes are picked by one aggregation: all in one partitioning by trace."""
    rank: dict[str, int] = {}
    nodes = []
    for topo, (pos, node, call, _) in enumerate(topological(dag)):
        rank[call] = rank.get(call, 0) + 1
        nodes.append((pos, topo, node, call, rank[call]))
    call = F.concat_ws(".", "service", "name")
    s = spans.withColumn("call", F.when(call.isin(list(rank)), call)).withColumn("at", F.when(F.col("call").isNotNull(), F.col("start_ns")))
    s = s.groupBy("trace_id", "call", "at").agg(F.min_by(F.struct("start_ns", "span_id", "end_ns", "parent_span_id", "ordinal", *carry), "ordinal").alias("s"))
    s = s.withColumn("rank", F.row_number().over(Window.partitionBy("trace_id", "call").orderBy("s.ordinal")))
    taken = lambda call, r: F.first(F.when((F.col("call") == call) & (F.col("rank") == r), F.col("s")), ignorenulls=True)
    found = [F.struct(F.lit(pos).alias("pos"), F.lit(topo).alias("topo"), F.lit(node).alias("node"), F.lit(call).alias("call"), F.lit(r).alias("rank"), taken(call, r).alias("s")) for pos, topo, node, call, r in nodes]
    return s.groupBy("trace_id").agg(F.array(*found).alias("r")).select("trace_id", F.inline("r")).select("trace_id", "pos", "topo", "node", "call", "rank", "s.*")


def with_first_bad(matched: DataFrame, dag: list[tuple], mode: str = "temporal") -> DataFrame:
    """``matched`` of :func:`graph_match` with ``first_bad``, the first predecessor with which a node's span breaks causality.

    A predecessor stands for the first span of its call in file order. ``temporal``: a node must not start
    before it. ``strict``: its span must be the parent. ``off``: nothing is checked."""
    calls = {n: c for _, n, c, _ in dag}
    edges = [(n, p) for _, n, _, ps in dag for p in ps if p in calls]
    if mode == "off" or not edges:
        return matched.withColumn("first_bad", F.lit(None).cast("string"))
    whole, bad = Window.partitionBy("trace_id"), []
    first = {c: F.max(F.when((F.col("call") == c) & (F.col("rank") == 1) & F.col("span_id").isNotNull(), F.struct("start_ns", "span_id"))).over(whole) for c in {calls[p] for _, p in edges}}
    names = {c: f"_first{k}" for k, c in enumerate(sorted(first))}
    m = matched.withColumns({names[c]: w for c, w in first.items()})
    for n, p in edges:
        f = F.col(names[calls[p]])
        broken = F.col("start_ns") < f["start_ns"] if mode == "temporal" else ~F.coalesce(F.col("parent_span_id") == f["span_id"], F.lit(False))
        bad.append(F.when((F.col("node") == n) & F.col("span_id").isNotNull() & f.isNotNull() & broken, p))
    return m.withColumn("first_bad", F.coalesce(*bad)).drop(*names.values())


def graph_causality(matched: DataFrame, dag: list[tuple], mode: str = "temporal") -> DataFrame:
    """Nodes whose span breaks causality with a predecessor: (trace_id, node, pos, first_bad), as :func:`with_first_bad` finds them."""
    return with_first_bad(matched, dag, mode).where("first_bad IS NOT NULL").select("trace_id", "node", "pos", "first_bad")


def route(spans: DataFrame, kind: str) -> DataFrame:
    """How each trace is validated: graph contracts by graph, contracts with parallel groups and traces
    with known parents by causality, all else by time. ``kind``: graph, parallel or linear."""
    parents = F.bool_or(F.col("parent_span_id").isNotNull())
    return spans.groupBy("trace_id").agg(F.when(F.lit(kind) == "graph", "graph").when(F.lit(kind == "parallel") | parents, "causality").otherwise("time").alias("route"))
