"""Contract graphs, many contracts at once: all tables are keyed by flow_id; nodes have
``node``, ``n`` (declaration position) and ``call``, edges ``from_id`` and ``to_id``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanflow.operators import contractgraph as cg
from spanflow.operators.callgraph import levels, summed_up
from spanflow.operators.steps import checkpointed

KEY = ["flow_id"]


def edges_from_depends(edges: DataFrame, depends: DataFrame) -> DataFrame:
    """Explicit edges, and for flows without any those of ``depends`` (flow_id, node, depends array)."""
    more = depends.join(edges.select("flow_id").distinct(), "flow_id", "left_anti").select("flow_id", F.explode("depends").alias("from_id"), F.col("node").alias("to_id"))
    return edges.select("flow_id", "from_id", "to_id").unionByName(more)


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    end = lambda c: nodes.select("flow_id", F.col("node").alias(c))
    return edges.join(end("from_id"), ["flow_id", "from_id"], "left_semi").join(end("to_id"), ["flow_id", "to_id"], "left_semi").select("flow_id", "from_id", "to_id")


def _in_one_pass(edges: DataFrame, nodes: DataFrame, one: Callable[[DataFrame], DataFrame], rounds: Callable[[DataFrame, DataFrame], DataFrame], known_only: bool = False) -> DataFrame:
    """``one`` of the facts of all flows, one shuffle and no rounds; flows of more than BOUND rows go through ``rounds`` instead."""
    table, large = cg.split([cg.rows(cg.NODE, nodes, "node", n="n"), cg.rows(cg.EDGE, edges, "from_id", "to_id")])
    facts = lambda rows: cg.facts(rows, known_only=known_only)
    if large is None:
        return one(cg.of_flows(table, facts, cg.FACTS))
    small = one(cg.of_flows(table.join(large, "flow_id", "left_anti"), facts, cg.FACTS))
    edges, nodes = (t.join(large, "flow_id", "left_semi") for t in (edges, nodes))
    return small.unionByName(rounds(known_edges(edges, nodes) if known_only else edges, nodes))


def _levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return levels(edges, nodes.select("flow_id", F.col("node").alias("id")), KEY).withColumnRenamed("id", "node")


def topo_levels(edges: DataFrame, nodes: DataFrame, known_only: bool = False) -> DataFrame:
    """flow_id, node, level: longest path from an entry; the order is (level, n). Flows with cycles lack the nodes that these block. With ``known_only`` here and
    below, edges from or to what is no node are left out, as by :func:`known_edges`."""
    one = lambda f: f.select("flow_id", F.inline("found")).where("level IS NOT NULL").select("flow_id", "node", "level")
    return _in_one_pass(edges, nodes, one, _levels, known_only)


def checks(edges: DataFrame, nodes: DataFrame, known_only: bool = False) -> DataFrame:
    """Per flow: blocked (nodes that cannot be ordered), nodes, entries and unreachable (nodes that no entry reaches). Nodes of one name are one."""

    def one(f: DataFrame) -> DataFrame:
        f = f.where(F.size("found") > 0)
        return f.select("flow_id", cg.count(lambda x: x["level"].isNull()).alias("blocked"), F.size("found").cast("long").alias("nodes"), cg.count(lambda x: x["entry"]).alias("entries"), cg.count(lambda x: ~x["reached"]).alias("unreachable"))

    def rounds(edges: DataFrame, nodes: DataFrame) -> DataFrame:
        nodes = nodes.select("flow_id", "node").distinct()
        entries = entry_nodes(edges, nodes)
        mark = lambda df, c: df.select("flow_id", "node").withColumn(c, F.lit(1))
        n = nodes
        for df, c in ((_levels(edges, nodes), "ordered"), (reachable(edges, entries), "seen"), (entries, "entry")):
            n = n.join(mark(df, c), ["flow_id", "node"], "left")
        nameless = F.col("node").isNull()  # has no edges, so it is an entry
        without = lambda c: F.count_if(F.col(c).isNull() & ~nameless)
        return n.groupBy("flow_id").agg(without("ordered").alias("blocked"), F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("entry").isNotNull() | nameless).alias("entries"), without("seen").alias("unreachable"))

    return _in_one_pass(edges, nodes, one, rounds, known_only)


def cycles(edges: DataFrame, nodes: DataFrame, known_only: bool = False) -> DataFrame:
    """Per flow the number of nodes that cannot be ordered, and whether there is a cycle."""
    return checks(edges, nodes, known_only).select("flow_id", "blocked", (F.col("blocked") > 0).alias("has_cycle"))


def entry_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.join(edges.select("flow_id", F.col("to_id").alias("node")), ["flow_id", "node"], "left_anti").select("flow_id", "node")


def reachable(edges: DataFrame, start: DataFrame, rounds: int = 10_000) -> DataFrame:
    """Nodes that can be reached from ``start`` (flow_id, node), these included. Each round follows the edges of what is new; more
    than ``rounds`` are an error."""
    seen = checkpointed(start.select("flow_id", "node").distinct())
    edges, new = checkpointed(edges.select("flow_id", "from_id", "to_id").distinct()), seen
    for _ in range(rounds):
        step = new.join(edges.withColumnRenamed("from_id", "node"), ["flow_id", "node"]).select("flow_id", F.col("to_id").alias("node")).distinct()
        new = checkpointed(step.join(seen, ["flow_id", "node"], "left_anti"))
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)
    raise RuntimeError(f"a path of more than {rounds} nodes")


def reachability(edges: DataFrame, nodes: DataFrame, known_only: bool = False) -> DataFrame:
    """Per flow: nodes, entries, nodes that no entry reaches, and whether all is well."""
    ok = (F.col("entries") > 0) & (F.col("unreachable") == 0)
    return checks(edges, nodes, known_only).select("flow_id", "nodes", "entries", "unreachable", ok.alias("ok"))


def ancestors(edges: DataFrame, rounds: int = 10_000) -> DataFrame:
    """All (flow_id, node, ancestor). Each round prolongs the paths that are new by one edge; more than ``rounds`` are an error."""
    edges = checkpointed(edges.select("flow_id", F.col("to_id").alias("node"), F.col("from_id").alias("ancestor")).distinct())
    seen, new = edges, edges
    farther = edges.select("flow_id", F.col("node").alias("ancestor"), F.col("ancestor").alias("farther"))
    for _ in range(rounds):
        step = new.join(farther, ["flow_id", "ancestor"]).select("flow_id", "node", F.col("farther").alias("ancestor")).distinct()
        new = checkpointed(step.join(seen, ["flow_id", "node", "ancestor"], "left_anti"))
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)
    raise RuntimeError(f"a path of more than {rounds} nodes")


def fold_parallel(edges: DataFrame, nodes: DataFrame, known_only: bool = False) -> DataFrame:
    """A linear flow from a DAG, as steps: flow_id, pos, group_pos, node.

    Nodes are emitted in rounds, each as soon as all its predecessors are; in a round by declaration. When a node is emitted that has several successors
    with no other edge in, these are emitted with it, as a parallel group after it (group_pos counts in it), and do not fold successors of their
    own. All nodes are kept, but those on and behind cycles."""
    one = lambda f: f.select("flow_id", F.inline("found")).where("round IS NOT NULL").select("flow_id", "node", "n", "round", "parallel_of")
    emitted = _in_one_pass(edges, nodes, one, _folded, known_only)
    first = emitted.select("flow_id", F.col("node").alias("parallel_of"), F.col("n").alias("at"))
    e = emitted.join(first, ["flow_id", "parallel_of"], "left").withColumn("entry", F.struct("round", F.coalesce("at", "n"), F.col("parallel_of").isNotNull()))
    pos = F.dense_rank().over(Window.partitionBy("flow_id").orderBy("entry")) - 1
    place = F.row_number().over(Window.partitionBy("flow_id", "parallel_of").orderBy("n")) - 1
    return e.select("flow_id", pos.alias("pos"), F.when(F.col("parallel_of").isNotNull(), place).alias("group_pos"), "node")


def _folded(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """What a node does depends on its only predecessor's doing the opposite, so along chains of such every second one folds: chains are
    measured by doubling. Rounds are levels of the graph in which folded nodes stand in their predecessor's place."""
    alone = edges.groupBy("flow_id", "to_id").agg(F.count(F.lit(1)).alias("n"), F.min("from_id").alias("up")).where("n = 1")
    wide = alone.groupBy("flow_id", "up").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("flow_id", "up")
    up = alone.join(wide, ["flow_id", "up"]).select("flow_id", F.col("to_id").alias("id"), "up")
    chain = nodes.select("flow_id", F.col("node").alias("id")).join(up, ["flow_id", "id"], "left").withColumn("value", F.lit(0))
    odd = summed_up(chain, KEY).where("total % 2 = 1").select("flow_id", "id").join(up, ["flow_id", "id"])
    folded = checkpointed(odd.select("flow_id", F.col("id").alias("node"), F.col("up").alias("parallel_of")))
    stands = lambda c: folded.select("flow_id", F.col("node").alias(c), F.col("parallel_of").alias(f"{c}_at"))
    e = edges.join(stands("from_id"), ["flow_id", "from_id"], "left").join(folded.select("flow_id", F.col("node").alias("to_id")), ["flow_id", "to_id"], "left_anti")
    e = e.select("flow_id", F.coalesce("from_id_at", "from_id").alias("from_id"), "to_id")
    plain = nodes.join(folded, ["flow_id", "node"], "left_anti")
    at = checkpointed(_levels(e, plain).withColumnRenamed("level", "round"))
    n = nodes.join(folded, ["flow_id", "node"], "left").withColumn("stands", F.coalesce("parallel_of", "node"))
    return n.join(at.withColumnRenamed("node", "stands"), ["flow_id", "stands"]).select("flow_id", "node", F.col("n").cast("long").alias("n"), "round", "parallel_of")


def flow_step_counts(nodes: DataFrame) -> DataFrame:
    """Steps of a contract and their names in order."""
    g = nodes.groupBy("flow_id").agg(F.count(F.lit(1)).alias("steps"), F.array_sort(F.collect_list(F.struct("n", "node"))).alias("s"))
    return g.select("flow_id", "steps", F.array_join(F.transform("s", lambda x: x["node"]), ",").alias("names"))


def flow_entry_counts(flow_steps: DataFrame) -> DataFrame:
    """Top-level entries of a linear flow and their names in order; a parallel group counts as one. ``flow_steps``: flow_id, pos, entry."""
    g = flow_steps.groupBy("flow_id").agg(F.array_sort(F.collect_set(F.struct("pos", "entry"))).alias("s"))
    return g.select("flow_id", F.size("s").alias("steps"), F.array_join(F.transform("s", lambda x: x["entry"]), ",").alias("names"))
