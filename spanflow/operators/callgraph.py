"""Call graphs of traces: nodes, edges, constraints, cycles and levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanflow.functions.scalars import overlaps
from spanflow.operators import ranges
from spanflow.operators.steps import checkpointed


def summed_up(steps: DataFrame, keys: list[str], rounds: int = 64) -> DataFrame:
    """Sums along paths of pointers: ``steps`` has ``keys``, id, up (null at a path's end) and value; the result keys, id and
    total, the values of a node and of all that it leads up to, and one more for each pointer followed. Nodes
    that lead into a cycle have no row. Pointers double each round, so rounds grow with the logarithm of the longest path."""
    known = checkpointed(steps.select(*keys, "id", "up", F.col("value").cast("long").alias("total")))
    done, open_ = known.where("up IS NULL"), known.where("up IS NOT NULL")
    for _ in range(rounds):
        ahead = known.select(*keys, F.col("id").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"))
        now = checkpointed(open_.join(ahead, [*keys, "up"]).select(*keys, "id", F.col("next").alias("up"), (F.col("total") + 1 + F.col("more")).alias("total")))
        ended, open_ = now.where("up IS NULL"), now.where("up IS NOT NULL")
        done = done.unionByName(ended)
        if ended.isEmpty():  # there are paths of every length up to the longest, so that what is left leads into cycles
            return done.select(*keys, "id", "total")
        known = done.unionByName(open_)
    raise RuntimeError(f"paths did not end in {rounds} rounds")


def call_nodes(spans: DataFrame) -> DataFrame:
    """One node per span id and trace (the last in file order): trace_id, span_id, parent_span_id, start_ns, end_ns, service, ordinal."""
    keep = ["parent_span_id", "start_ns", "end_ns", "service", "name", "ordinal"]
    return spans.groupBy("trace_id", "span_id").agg(F.max_by(F.struct(*keep), "ordinal").alias("n")).select("trace_id", "span_id", "n.*")


def known_parents(spans: DataFrame) -> DataFrame:
    """``spans`` with parent_span_id null unless it is the id of another span of the trace, and parent_start and parent_end, that span's times.

    Each row stands for itself and for a child, and both meet in a window over trace and id, so a table that is partitioned by trace
    is not shuffled. A span without a parent, or that names itself, meets nobody but itself."""
    other = F.col("parent_span_id").isNotNull() & (F.col("parent_span_id") != F.col("span_id"))
    rest = [c for c in spans.columns if c not in ("trace_id", "start_ns", "end_ns")]
    row = F.struct(*rest, F.coalesce(other, F.lit(False)).alias("_other"))
    both = F.array(F.struct(F.col("span_id").alias("_id"), F.lit(None).cast(spans.select(row).schema[0].dataType).alias("_row")), F.struct(F.when(other, F.col("parent_span_id")).otherwise(F.col("span_id")).alias("_id"), row.alias("_row")))
    own = F.when(F.col("_row").isNull(), F.struct("start_ns", "end_ns"))
    s = spans.select("trace_id", "start_ns", "end_ns", F.inline(both)).withColumn("_parent", F.max(own).over(Window.partitionBy("trace_id", "_id"))).where("_row IS NOT NULL")
    found = F.col("_row._other") & F.col("_parent").isNotNull()
    of = {"parent_span_id": F.when(found, F.col("_row.parent_span_id")).alias("parent_span_id")} | {c: F.col(c) for c in ("trace_id", "start_ns", "end_ns")}
    times = [F.when(found, F.col(f"_parent.{t}_ns")).alias(f"parent_{t}") for t in ("start", "end")]
    return s.select(*[of.get(c, F.col(f"_row.{c}")) for c in spans.columns], *times)


def with_known_parents(nodes: DataFrame) -> DataFrame:
    """Nodes with ``parent``: the parent's id if that node exists."""
    return known_parents(nodes).withColumn("parent", F.col("parent_span_id"))


def _edge(from_id: str, to_id: str, kind: Column, from_: str, to: str) -> Column:
    """An edge with the times of its ends, which :func:`edge_violations` then need not look up."""
    return F.struct(
        F.col(from_id).alias("from_id"), F.col(to_id).alias("to_id"), kind.alias("relationship"), F.col(f"{from_}start{'_ns' * (not from_)}").alias("from_start"), F.col(f"{from_}end{'_ns' * (not from_)}").alias("from_end"),
        F.col(f"{to}start_ns").alias("to_start"), F.col(f"{to}end_ns").alias("to_end"),
    )


def _parent_edge() -> Column:
    return F.when(F.col("parent_span_id").isNotNull(), _edge("parent_span_id", "span_id", F.lit("parent"), "parent_", ""))


_ORDER, _NEXT = ["start_ns", "span_id"], ["span_id", "start_ns", "end_ns", "parent_span_id"]


def _followed(n: DataFrame, large: bool) -> DataFrame:
    """Nodes with ``x``, the next one in start order of the whole trace."""
    if large:
        return ranges.followed(ranges.ranged(n, _ORDER), _ORDER, _NEXT)
    return n.withColumn("x", F.lead(F.struct(*_NEXT)).over(Window.partitionBy("trace_id").orderBy(*_ORDER)))


def _temporal_edge() -> Column:
    kind = F.when(F.col("end_ns") <= F.col("x.start_ns"), "follows").when(overlaps(F.col("start_ns"), F.col("end_ns"), F.col("x.start_ns"), F.col("x.end_ns")), "concurrent")
    return F.when(F.col("x").isNotNull() & F.col("parent_span_id").eqNullSafe(F.col("x.parent_span_id")) & kind.isNotNull(), _edge("span_id", "x.span_id", kind, "", "x."))


def parent_edges(nodes: DataFrame) -> DataFrame:
    """Edges from parents to children. Edges are trace_id, from_id, to_id, relationship, and from_start, from_end, to_start, to_end."""
    return known_parents(nodes).select("trace_id", F.inline(F.array_compact(F.array(_parent_edge()))))


def temporal_edges(nodes: DataFrame, large: bool = False) -> DataFrame:
    """Edges between neighbours in start order of the whole trace that have one parent, or both none. ``large``: traces are cut into ranges (:mod:`spanflow.operators.ranges`)."""
    return _followed(known_parents(nodes), large).select("trace_id", F.inline(F.array_compact(F.array(_temporal_edge()))))


def call_edges(nodes: DataFrame, large: bool = False) -> DataFrame:
    """Edges of both kinds, in one pass over the nodes. ``large`` as in :func:`temporal_edges`."""
    return _followed(known_parents(nodes), large).select("trace_id", F.inline(F.array_compact(F.array(_parent_edge(), _temporal_edge()))))


def edge_violations(nodes: DataFrame, edges: DataFrame, tolerance_ms: int = 50) -> DataFrame:
    """Edges whose times break their relationship: trace_id, from_id, to_id, type. Edges with an unknown end are skipped.
    A trace with a cycle of parent links has one row of type ``cycle`` more, for the link that closes it.

    Edges of this module carry their times; for others (trace_id, from_id, to_id, relationship) they are looked up. Only a trace in which a
    parent does not come before its child, by start and id, can have a cycle: where there is none, none is looked for."""
    tol = tolerance_ms * 1_000_000
    e = edges
    if "from_start" not in edges.columns:
        side = lambda p: nodes.select("trace_id", F.col("span_id").alias(f"{p}_id"), F.col("start_ns").alias(f"{p}_start"), F.col("end_ns").alias(f"{p}_end"))
        e = edges.join(side("from"), ["trace_id", "from_id"]).join(side("to"), ["trace_id", "to_id"])
    r, out = F.col("relationship"), (F.col("to_start") < F.col("from_start") - tol) | (F.col("to_end") > F.col("from_end") + tol)
    kind = (
        F.when((r == "follows") & (F.col("from_end") > F.col("to_start") + tol), "causality")
        .when((r == "parent") & out, "parent-child")
        .when((r == "concurrent") & ~overlaps(F.col("from_start"), F.col("from_end"), F.col("to_start"), F.col("to_end")), "overlap")
    )
    bad = e.select("trace_id", "from_id", "to_id", kind.alias("type")).where("type IS NOT NULL")
    late = known_parents(nodes).where(F.struct("parent_start", "parent_span_id") >= F.struct("start_ns", "span_id")).select("trace_id").distinct()
    if late.isEmpty():
        return bad
    cycles = call_cycles(nodes.join(checkpointed(late).hint("merge"), "trace_id", "left_semi")).select("trace_id", F.element_at("path", -2).alias("from_id"), F.element_at("path", -1).alias("to_id"), F.lit("cycle").alias("type"))
    return cycles.unionByName(bad)


def call_cycles(nodes: DataFrame) -> DataFrame:
    """At most one cycle a trace, that of the smallest span id: trace_id, start_id, length, path.

    Only parent links can close a cycle (siblings are linked forward in time), and each node has one
    parent, so nodes jump over 1, 2, 4, ... parents until only nodes on a cycle or below one are left. The cycle is then
    cut open above its smallest span, and the spans' distances to it, again found by doubling, are its order. The
    number of joins grows with the logarithm of the largest trace."""
    up = checkpointed(parent_edges(nodes).select("trace_id", F.col("to_id").alias("id"), F.col("from_id").alias("parent")))
    jump, far = up.select("trace_id", "id", F.col("parent").alias("at")), 1
    most = up.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    while far < most:  # no tail below a cycle is longer than the largest trace
        ahead = jump.select("trace_id", F.col("id").alias("at"), F.col("at").alias("next"))
        jump, far = checkpointed(jump.join(ahead.hint("merge"), ["trace_id", "at"]).select("trace_id", "id", F.col("next").alias("at"))), 2 * far
        if jump.isEmpty():
            break
    on = jump.select("trace_id", F.col("at").alias("id")).distinct()  # after many jumps every node is on a cycle
    least = on.groupBy("trace_id").agg(F.min("id").alias("start_id"))
    links = up.join(on.hint("merge"), ["trace_id", "id"], "left_semi").join(least.hint("merge"), "trace_id")
    open_ = links.select("trace_id", "start_id", "id", F.when(F.col("id") != F.col("start_id"), F.col("parent")).alias("up"), F.lit(0).alias("value"))
    order = summed_up(open_, ["trace_id", "start_id"]).groupBy("trace_id", "start_id").agg(F.array_sort(F.collect_list(F.struct("total", "id"))).alias("p"))  # the result is this list
    path = F.concat(F.transform("p", lambda x: x["id"]), F.array("start_id"))
    return order.select("trace_id", "start_id", F.size(path).alias("length"), path.alias("path"))


def levels(edges: DataFrame, nodes: DataFrame, keys: list[str], rounds: int = 10_000) -> DataFrame:
    """Longest path to each node over acyclic ``edges(keys, from_id, to_id)``: keys, id, level. Nodes on or behind
    a cycle have no row. Each round takes the nodes without open predecessors of all graphs away; only what is left
    is written again. There are as many rounds as the longest path has nodes: contracts are meant, for call graphs see :func:`call_levels`."""
    edges = checkpointed(edges.select(*keys, "from_id", "to_id").distinct())
    degree = edges.groupBy(*keys, F.col("to_id").alias("id")).agg(F.count(F.lit(1)).alias("open"))
    left = checkpointed(nodes.select(*keys, "id").distinct().join(degree, [*keys, "id"], "left").select(*keys, "id", F.coalesce("open", F.lit(0)).alias("open")))
    found = left.select(*keys, "id", F.lit(0).alias("level")).where("false")
    for level in range(rounds):
        ready = left.where("open = 0").select(*keys, "id")
        if ready.isEmpty():
            return found
        found = found.unionByName(ready.withColumn("level", F.lit(level)))
        less = edges.join(ready.withColumnRenamed("id", "from_id"), [*keys, "from_id"]).groupBy(*keys, F.col("to_id").alias("id")).agg(F.count(F.lit(1)).alias("less"))
        left = checkpointed(left.where("open > 0").join(less, [*keys, "id"], "left").select(*keys, "id", (F.col("open") - F.coalesce("less", F.lit(0))).alias("open")))
    raise RuntimeError(f"a path of more than {rounds} nodes")


def call_levels(nodes: DataFrame) -> DataFrame:
    """Longest paths over parent and follows edges: trace_id, span_id, level. Spans on or behind a cycle have no row.

    A follows edge joins neighbours in start order that have one parent, so such edges form runs below one parent, and a
    span's level is its place in its run, and one more than its parent's level if it has one. Places come from one window over the trace,
    and sums over ancestors from doubling, in rounds that grow with the logarithm of the depth."""
    n = with_known_parents(nodes)
    w = Window.partitionBy("trace_id").orderBy("start_ns", "span_id")
    before = F.lag(F.struct("end_ns", "parent")).over(w)
    follows = before.isNotNull() & (before["end_ns"] <= F.col("start_ns")) & before["parent"].eqNullSafe(F.col("parent"))
    n = n.select("trace_id", "span_id", "start_ns", "parent", F.when(follows, 0).otherwise(1).alias("new"))
    n = n.withColumn("run", F.sum("new").over(w))
    place = F.row_number().over(Window.partitionBy("trace_id", "run").orderBy("start_ns", "span_id")) - 1
    return summed_up(n.select("trace_id", F.col("span_id").alias("id"), F.col("parent").alias("up"), place.alias("value")), ["trace_id"]).select("trace_id", F.col("id").alias("span_id"), F.col("total").cast("int").alias("level"))


def call_depth(nodes: DataFrame) -> DataFrame:
    """Greatest level of each trace: trace_id, depth."""
    return call_levels(nodes).groupBy("trace_id").agg(F.max("level").alias("depth"))


def nodes_by_service(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("trace_id", "service").agg(F.count(F.lit(1)).alias("nodes"))


def call_graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """trace_id, nodes, edges, roots, concurrent_pairs, services."""
    n = with_known_parents(nodes).groupBy("trace_id").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("parent").isNull()).alias("roots"), F.countDistinct("service").alias("services"))
    e = edges.groupBy("trace_id").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("relationship") == "concurrent").alias("concurrent_pairs"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return n.join(e, "trace_id", "left").select("trace_id", "nodes", zero("edges"), "roots", zero("concurrent_pairs"), "services")
