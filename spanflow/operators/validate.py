"""Validation of many traces by many contracts, all of them tables.

Tables of contracts, keyed by flow_id (:func:`spanflow.sources.contracts.contract_tables` reads them): ``steps`` (pos, group_pos, step, call),
``nodes`` (n, node, call), ``edges`` (from_id, to_id) and ``conditions`` (service, operation, kind, condition, expression).
``pairs`` (trace_id, flow_id) says which trace is held against which contract. Each pair goes one way (:func:`routes`):
by graph, by causality or by time. Rows are (trace_id, flow_id, pos, step, call, status, span_id, note).

Contracts are broadcast where they have few rows (``_held``). What has a row a trace never is, however small its files are: its joins are merged (``_merged``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanflow.functions.scalars import normalize, overlaps, split_call
from spanflow.operators import callgraph, conditions, graph, match
from spanflow.operators.steps import checkpointed

#: Rows of a contracts' table that are broadcast.
HELD = 100_000
_SPAN = ["span_id", "start_ns", "end_ns", "parent_span_id", "ordinal", "service", "name", "attributes"]


def _merged(df: DataFrame) -> DataFrame:
    """``df``, which grows with the traces, for a join that the driver takes no part in: by the size of its files, or of the few columns that are read, Spark would broadcast it."""
    return df.hint("merge")


def _held(contracts: DataFrame) -> DataFrame:
    """A table of contracts for a join with rows of traces. By estimates of size Spark may take the traces for the smaller side."""
    return F.broadcast(contracts) if contracts.count() <= HELD else contracts.hint("merge")


def routes(spans: DataFrame, pairs: DataFrame, contracts: dict[str, DataFrame]) -> DataFrame:
    """``pairs`` with ``route``: contracts with nodes go by graph; those with a parallel group, and traces in which a span names a parent, by causality; all else by time."""
    kind = contracts["steps"].groupBy("flow_id").agg(F.bool_or(F.col("group_pos").isNotNull()).alias("parallel"))
    kind = kind.unionByName(contracts["nodes"].select("flow_id").distinct().withColumn("parallel", F.lit(None).cast("boolean")))
    parents = spans.groupBy("trace_id").agg(F.bool_or(F.col("parent_span_id").isNotNull()).alias("parents"))
    way = F.when(F.col("parallel").isNull(), "graph").when(F.col("parallel") | F.col("parents"), "causality").otherwise("time")
    return pairs.join(_held(kind), "flow_id").join(_merged(parents), "trace_id").select("trace_id", "flow_id", way.alias("route"))


def _called(call: str) -> tuple[Column, Column]:
    service, operation = split_call(F.col(call))
    return normalize(service), normalize(operation)


def by_time(spans: DataFrame, pairs: DataFrame, steps: DataFrame) -> DataFrame:
    """Greedy matching in order of time, the contracts' steps one after the other: each takes the first of its spans after the last one
    taken. Spans are numbered once, in one partitioning by trace; what a pair of trace and contract may take comes together as the places of each step's
    call, and a fold over the positions carries the place of the last one taken. The plan does not grow with the contracts."""
    order = Window.partitionBy("trace_id").orderBy("start_ns", "ordinal")
    s = spans.withColumn("idx", F.row_number().over(order)).withColumns({"s": normalize(F.col("service")), "o": normalize(F.col("name"))})
    service, operation = _called("call")
    wanted = _held(steps.select("flow_id", "pos", "step", "call", service.alias("s"), operation.alias("o")))
    c = s.select("trace_id", "idx", "s", "o").join(wanted.select("flow_id", "pos", "s", "o"), ["s", "o"]).join(_merged(pairs.select("trace_id", "flow_id")), ["trace_id", "flow_id"], "left_semi")
    places = c.groupBy("trace_id", "flow_id", "pos").agg(F.array_sort(F.collect_list("idx")).alias("at"))
    places = places.groupBy("trace_id", "flow_id").agg(F.array_sort(F.collect_list(F.struct("pos", "at"))).alias("steps"))
    start = F.struct(F.lit(0).alias("last"), F.array().cast("array<struct<pos:int,idx:int,since:int>>").alias("taken"))

    def take(state: Column, step: Column) -> Column:
        idx = F.get(F.filter(step["at"], lambda i: i > state["last"]), F.lit(0))
        one = F.struct(step["pos"].cast("int").alias("pos"), idx.cast("int").alias("idx"), state["last"].cast("int").alias("since"))
        return F.struct(F.coalesce(idx, state["last"]).cast("int").alias("last"), F.when(idx.isNull(), state["taken"]).otherwise(F.array_append(state["taken"], one)).alias("taken"))

    taken = places.select("trace_id", "flow_id", F.inline(F.aggregate("steps", start, take)["taken"]))
    taken = taken.join(_merged(s.select("trace_id", "idx", *_SPAN)), ["trace_id", "idx"])
    r = pairs.select("trace_id", "flow_id").join(wanted.drop("s", "o"), "flow_id").join(_merged(taken), ["trace_id", "flow_id", "pos"], "left")
    note = F.when(F.col("idx").isNull(), match.MISSING).when(F.col("idx") > F.col("since") + 1, match.skipped(F.col("idx"))).otherwise("")
    return r.select("trace_id", "flow_id", "pos", "step", "call", F.when(F.col("idx").isNull(), "FAIL").otherwise("PASS").alias("status"), note.alias("note"), *_SPAN)


def by_causality(spans: DataFrame, pairs: DataFrame, steps: DataFrame) -> DataFrame:
    """Matching in any order, a span may serve several steps; steps of a group that ran neither at one time nor under one parent fail.
    The span is the earliest that matches; conditions look at the first one in the file (``seen``)."""
    s = match.resolved_parents(spans).withColumns({"s": normalize(F.col("service")), "o": normalize(F.col("name"))})
    first = s.groupBy("trace_id", "s", "o").agg(F.min_by(F.struct(*_SPAN[:5]), F.struct("start_ns", "ordinal")).alias("m"), F.min_by(F.struct(*_SPAN), "ordinal").alias("seen"))
    service, operation = _called("call")
    wanted = _held(steps.select("flow_id", "pos", "group_pos", "step", "call", service.alias("s"), operation.alias("o")))
    r = pairs.select("trace_id", "flow_id").join(wanted, "flow_id").join(_merged(first), ["trace_id", "s", "o"], "left")
    r = r.select("trace_id", "flow_id", "pos", "group_pos", "step", "call", "m.*", "seen")
    group = r.where("group_pos IS NOT NULL AND span_id IS NOT NULL").groupBy("trace_id", "flow_id", "pos").agg(F.collect_list(F.struct("group_pos", "start_ns", "end_ns", "parent_span_id")).alias("g"))  # steps of a group
    apart = lambda a, b: ~(overlaps(a["start_ns"], a["end_ns"], b["start_ns"], b["end_ns"]) | a["parent_span_id"].eqNullSafe(b["parent_span_id"]))
    bad = F.exists("g", lambda a: F.exists("g", lambda b: (a["group_pos"] < b["group_pos"]) & apart(a, b)))
    r = r.join(_merged(group.select("trace_id", "flow_id", "pos", bad.alias("apart"))), ["trace_id", "flow_id", "pos"], "left")
    failed = F.col("span_id").isNull() | (F.col("group_pos").isNotNull() & F.coalesce("apart", F.lit(False)))
    note = F.when(F.col("span_id").isNull(), match.MISSING).otherwise("")
    return r.select("trace_id", "flow_id", "pos", "group_pos", "step", "call", F.when(failed, "FAIL").otherwise("PASS").alias("status"), note.alias("note"), "span_id", "seen")


def by_graph(spans: DataFrame, pairs: DataFrame, nodes: DataFrame, edges: DataFrame, mode: str = "temporal") -> DataFrame:
    """Nodes to spans without reuse: the k-th node of a call in topological order takes the k-th span of that call in the file; then causality with
    the predecessors, as :func:`match.graph_causality`. Ranks on both sides make it an equi-join."""
    level = graph.topo_levels(edges, nodes)
    turn = Window.partitionBy("flow_id", "call").orderBy("level", "n")
    wanted = checkpointed(nodes.join(level, ["flow_id", "node"]).select("flow_id", "n", "node", "call", F.row_number().over(turn).alias("rank")))
    s = spans.withColumn("call", F.concat_ws(".", "service", "name")).join(_held(nodes.select("call").distinct()), "call", "left_semi")
    s = s.groupBy("trace_id", "call", "start_ns").agg(F.min_by(F.struct(*[c for c in _SPAN if c != "start_ns"]), "ordinal").alias("s"))
    s = s.withColumn("rank", F.row_number().over(Window.partitionBy("trace_id", "call").orderBy("s.ordinal")))
    most = wanted.agg(F.max("rank")).first()[0] or 0  # the rank filter is a limit of each group, before the shuffle
    s = s.where(F.col("rank") <= most)
    m = pairs.select("trace_id", "flow_id").join(_held(wanted), "flow_id").join(_merged(s), ["trace_id", "call", "rank"], "left")
    m = m.select("trace_id", "flow_id", F.col("n").alias("pos"), F.col("node").alias("step"), "call", "start_ns", "s.*")
    if mode == "off":
        late = m.select("trace_id", "flow_id", "step", F.lit(None).cast("string").alias("first_bad")).where("false")
    else:
        pred = edges.select("flow_id", F.col("to_id").alias("step"), F.col("from_id").alias("pred")).join(nodes.select("flow_id", F.col("node").alias("pred"), F.col("call").alias("p_call"), F.col("n").alias("edge")), ["flow_id", "pred"])
        first = s.where("rank = 1").select("trace_id", F.col("call").alias("p_call"), F.col("s.span_id").alias("p_span"), F.col("start_ns").alias("p_start"))
        j = m.where("span_id IS NOT NULL").join(_held(pred), ["flow_id", "step"]).join(_merged(first), ["trace_id", "p_call"])
        bad = F.col("start_ns") < F.col("p_start") if mode == "temporal" else ~F.coalesce(F.col("parent_span_id") == F.col("p_span"), F.lit(False))
        late = j.where(bad).groupBy("trace_id", "flow_id", "step").agg(F.min_by("pred", "edge").alias("first_bad"))
    m = m.join(_merged(late), ["trace_id", "flow_id", "step"], "left")
    note = F.when(F.col("span_id").isNull(), match.MISSING).when(F.col("first_bad").isNotNull(), F.concat(F.lit("starts before " if mode == "temporal" else "is not called by "), "first_bad")).otherwise("")
    return m.select("trace_id", "flow_id", "pos", "step", "call", F.when(note == "", "PASS").otherwise("FAIL").alias("status"), note.alias("note"), *_SPAN)


def dag_rows(spans: DataFrame, pairs: DataFrame, tolerance_ms: int = 50) -> DataFrame:
    """One failing row for each pair whose trace has cycles or edges that break their relationship."""
    nodes = callgraph.call_nodes(spans)
    bad = callgraph.edge_violations(nodes, callgraph.call_edges(nodes), tolerance_ms).groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(_merged(bad), "trace_id").select(
        "trace_id", "flow_id", F.lit(-1).alias("pos"), F.lit(match.DAG_STEP).alias("step"), F.lit("internal").alias("call"), F.lit("FAIL").alias("status"), match.violated(F.col("n")).alias("note"), F.lit(None).cast("string").alias("span_id")
    )


def validate(spans: DataFrame, contracts: dict[str, DataFrame], pairs: DataFrame, mode: str = "temporal", tolerance_ms: int = 50) -> tuple[DataFrame, DataFrame]:
    """Steps and condition results of all ``pairs``, each by its route. A step whose conditions fail has status FAIL; ``found`` says whether
    it would have passed without them, which is what counts for the verdict of pairs that go by time."""
    # As files the contracts have a size, so small ones are broadcast, and rows of traces are not shuffled by the few values of a call or a flow.
    contracts = {k: checkpointed(t) for k, t in contracts.items()}
    way = checkpointed(routes(spans, pairs, contracts))
    on = {k: way.where(F.col("route") == k) for k in ("time", "causality", "graph")}
    seen = lambda of="": F.struct(*[F.col(f"{of}{c}").alias(c) for c in (*_SPAN[1:3], *_SPAN[5:])]).alias("seen")
    row = ["trace_id", "flow_id", "pos", F.lit(None).cast("int").alias("group_pos"), "step", "call", "status", "note", "span_id", seen()]
    time = by_time(spans, on["time"], contracts["steps"]).select(*row)
    cause = by_causality(spans, on["causality"], contracts["steps"]).withColumn("seen", seen("seen."))
    dag = by_graph(spans, on["graph"], contracts["nodes"], contracts["edges"], mode).select(*row)
    # Written once, as conditions and steps both read it, and by one job, in which the ways do not wait for each other.
    matched = checkpointed(time.unionByName(cause).unionByName(dag))
    results = conditions.by_operation(matched.where("status = 'PASS'").select("trace_id", "flow_id", "pos", "group_pos", "step", "call", "seen.*"), _held(contracts["conditions"]))
    key = ["trace_id", "flow_id", "pos", "step"]
    failed = results.groupBy(*key).agg(F.bool_or(F.col("result") == "FAIL").alias("bad"))
    bad = F.coalesce("bad", F.lit(False))
    steps = matched.join(_merged(failed), key, "left").select(*key, "call", F.when(bad, "FAIL").otherwise(F.col("status")).alias("status"), F.when(bad, match.SEMANTIC).otherwise(F.col("note")).alias("note"), "span_id", (F.col("status") == "PASS").alias("found"))
    checked = dag_rows(spans, way.where("route <> 'time'").select("trace_id", "flow_id"), tolerance_ms).withColumn("found", F.lit(False))
    return checked.unionByName(steps), results.select(*key, "kind", "condition", "result")
