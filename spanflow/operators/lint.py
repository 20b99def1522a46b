"""Checks of contracts, each a table of issues over all contracts at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanflow.functions.scalars import INITIAL_VARIABLES, has_telemetry_prefix, split_call, variable_references
from spanflow.operators import contractgraph as cg
from spanflow.operators import graph
from spanflow.operators.graph import ancestors


def call_format(steps: DataFrame) -> DataFrame:
    """Calls that are not ``service.operation``. ``steps``: flow_id, node, call."""
    return steps.where(split_call(F.col("call"))[0].isNull()).select("flow_id", F.col("node").alias("subject"))


def undeclared_service(steps: DataFrame, services: DataFrame) -> DataFrame:
    """``services``: flow_id, service."""
    s = steps.select("flow_id", F.col("node").alias("subject"), split_call(F.col("call"))[0].alias("service")).where("service IS NOT NULL")
    return s.join(services, ["flow_id", "service"], "left_anti").select("flow_id", "subject", "service")


def missing_operation(steps: DataFrame, services: DataFrame, operations: DataFrame) -> DataFrame:
    """Calls of a declared service that has no such operation. ``operations``: service, operation."""
    service, operation = split_call(F.col("call"))
    s = steps.select("flow_id", F.col("node").alias("subject"), service.alias("service"), operation.alias("operation")).join(services, ["flow_id", "service"], "left_semi")
    return s.join(operations, ["service", "operation"], "left_anti").select("flow_id", "subject", "service", "operation")


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    known = nodes.select("flow_id", F.col("node").alias("to_id"))
    other = nodes.select("flow_id", F.col("node").alias("from_id"))
    lost = edges.join(known, ["flow_id", "to_id"], "left_anti").unionByName(edges.join(other, ["flow_id", "from_id"], "left_anti"))
    return lost.select("flow_id", "from_id", "to_id").distinct()


def duplicates(names: DataFrame) -> DataFrame:
    """Names used more than once in a flow (nodes of a graph; steps and their groups), and empty ones. ``names``: flow_id, name."""
    g = names.groupBy("flow_id", F.coalesce("name", F.lit("")).alias("name")).agg(F.count(F.lit(1)).alias("uses"))
    return g.where("uses > 1 OR name = ''")


def references(inputs: DataFrame) -> DataFrame:
    """Variables that a node's input names: flow_id, node, variable. ``inputs``: flow_id, node, and input as text of its values."""
    return inputs.select("flow_id", "node", F.explode(variable_references(F.col("input"))).alias("variable"))


def input_values(inputs: DataFrame) -> DataFrame:
    """``inputs`` with a VARIANT ``input`` as the text of its values: keys of objects are not searched for variables."""
    text = F.regexp_replace(F.to_json("input"), r'"(?:[^"\\]|\\.)*"\s*:', "")
    return inputs.select("flow_id", "node", text.alias("input"))


def graph_variables(refs: DataFrame, outputs: DataFrame, edges: DataFrame) -> DataFrame:
    """References to what no transitive predecessor puts out. ``outputs``: flow_id, node, variable.

    Rows of a flow come together in one shuffle (:func:`contractgraph.unknown`). Flows of more than BOUND rows have all theirs listed, in rounds."""
    root = F.split("variable", r"\.")[0]
    refs, outputs = refs.where(~root.isin(INITIAL_VARIABLES)).select("flow_id", "node", "variable"), outputs.select("flow_id", "node", "variable")
    table, large = cg.split([cg.rows(cg.EDGE, edges, "from_id", "to_id"), cg.rows(cg.REFERENCE, refs, "node", "variable"), cg.rows(cg.OUTPUT, outputs, "node", "variable")])
    flows = lambda table: cg.of_flows(table, cg.unknown, cg.UNKNOWN).select("flow_id", F.inline("found"))
    if large is None:
        return flows(table)
    refs, outputs, edges = (t.join(large, "flow_id", "left_semi") for t in (refs, outputs, edges))
    known = ancestors(edges).join(outputs.select("flow_id", F.col("node").alias("ancestor"), "variable"), ["flow_id", "ancestor"]).select("flow_id", "node", F.col("variable").alias("root")).distinct()
    rest = refs.withColumn("root", root).join(known, ["flow_id", "node", "root"], "left_anti").select("flow_id", "node", "variable")
    return flows(table.join(large, "flow_id", "left_anti")).unionByName(rest)


def flow_variables(refs: DataFrame, outputs: DataFrame, positions: DataFrame) -> DataFrame:
    """References to what no earlier step puts out; steps of one parallel group share a position. ``positions``: flow_id, node, pos."""
    first = outputs.join(positions, ["flow_id", "node"]).groupBy("flow_id", F.col("variable").alias("root")).agg(F.min("pos").alias("since"))
    r = refs.join(positions, ["flow_id", "node"]).withColumn("root", F.split("variable", r"\.")[0]).where(~F.col("root").isin(INITIAL_VARIABLES))
    return r.join(first, ["flow_id", "root"], "left").where("since IS NULL OR since >= pos").select("flow_id", "node", "variable")


def telemetry_keys(keys: DataFrame) -> DataFrame:
    """Input keys that belong to telemetry. ``keys``: flow_id, node, key (top level, or below ``body``)."""
    return keys.where(has_telemetry_prefix(F.regexp_replace("key", r"^body\.", ""))).select("flow_id", "node", "key").distinct()


def rollup(flows: DataFrame, issues: DataFrame) -> DataFrame:
    """Errors and warnings per flow, and whether it passes. ``issues``: flow_id, level."""
    g = issues.groupBy("flow_id").agg(F.count_if(F.col("level") == "ERROR").alias("errors"), F.count_if(F.col("level") == "WARN").alias("warnings"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return flows.join(g, "flow_id", "left").select("flow_id", zero("errors"), zero("warnings"), (F.coalesce("errors", F.lit(0)) == 0).alias("passed"))


def call_issues(calls: DataFrame, services: DataFrame, operations: DataFrame) -> DataFrame:
    """What is wrong with a call (flow_id, rule, subject), each at most once: its format, its service, or its operation. ``calls``: flow_id, node, call."""
    service, operation = split_call(F.col("call"))
    c = calls.select("flow_id", F.col("node").alias("subject"), service.alias("service"), operation.alias("operation"))
    c = c.join(services.select("flow_id", "service").distinct().withColumn("declared", F.lit(True)), ["flow_id", "service"], "left")
    c = c.join(operations.select("service", "operation").distinct().withColumn("exists", F.lit(True)), ["service", "operation"], "left")
    rule = F.when(F.col("service").isNull(), "call format").when(F.col("declared").isNull(), "undeclared service").when(F.col("exists").isNull(), "missing operation")
    return c.select("flow_id", rule.alias("rule"), "subject").where("rule IS NOT NULL")


def _graph_issues(steps: DataFrame, nodes: DataFrame, edges: DataFrame, refs: DataFrame | None, outputs: DataFrame | None) -> DataFrame:
    """:func:`contractgraph.issues` by tables, for flows of any size."""
    row = lambda df, rule, subject, level="ERROR": df.select("flow_id", F.lit(level).alias("level"), F.lit(rule).alias("rule"), F.col(subject).cast("string").alias("subject"))
    wrong = lambda rule, n: F.struct(F.lit(rule).alias("rule"), F.col(n).cast("string").alias("subject"))
    cycle, apart = F.when(F.col("blocked") > 0, wrong("cycle", "blocked")), F.when((F.col("entries") > 0) & (F.col("unreachable") > 0), wrong("unreachable nodes", "unreachable"))
    out = graph.checks(edges, nodes, known_only=True).select("flow_id", F.lit("ERROR").alias("level"), F.inline(F.array_compact(F.array(cycle, apart))))
    out = out.unionByName(row(dangling_edges(edges, nodes), "dangling edge", "to_id")).unionByName(row(steps.select("flow_id").distinct().withColumn("legacy", F.lit("flow")), "legacy format", "legacy", "WARN"))
    out = out.unionByName(row(duplicates(steps.select("flow_id", F.col("step").alias("name"))), "step name", "name")).unionByName(row(duplicates(nodes.select("flow_id", F.col("node").alias("name"))), "node name", "name"))
    if refs is None:
        return out
    of = lambda df: df.join(nodes.select("flow_id").distinct(), "flow_id", "left_semi")
    lost = graph_variables(of(refs), of(outputs), graph.known_edges(edges, nodes)).unionByName(flow_variables(refs, outputs, steps.select("flow_id", F.col("step").alias("node"), "pos")))
    return out.unionByName(row(lost, "unknown variable", "node"))


def issues(contracts: dict[str, DataFrame]) -> DataFrame:
    """All rules over all contracts: flow_id, level, rule, subject.

    ``contracts``: ``steps`` (flow_id, pos, group_pos, step, call), ``nodes`` (flow_id, n, node, call), ``edges``, ``services`` (flow_id, service) and ``operations``
    (service, operation); where they are at hand ``references`` and ``outputs`` (flow_id, node, variable), ``keys`` (flow_id, node, key) and ``issues`` of reading.

    Names, edges, order and variables of a flow are one pass over its rows, which come together in one shuffle (:func:`contractgraph.issues`); flows of more than
    BOUND rows have the same rules applied as tables. Calls meet services and operations in one chain of joins."""
    steps, nodes, edges, refs, outputs = (contracts.get(k) for k in ("steps", "nodes", "edges", "references", "outputs"))
    parts = [cg.rows(cg.STEP, steps, "step", n="pos"), cg.rows(cg.NODE, nodes, "node", n="n"), cg.rows(cg.EDGE, edges, "from_id", "to_id")]
    if refs is not None:
        parts += [cg.rows(cg.REFERENCE, refs, "node", "variable"), cg.rows(cg.OUTPUT, outputs, "node", "variable")]
    table, large = cg.split(parts)
    flows = lambda table: cg.of_flows(table, cg.issues, cg.ISSUES).select("flow_id", F.inline("found"))
    if large is None:
        out = flows(table)
    else:
        only = lambda t: None if t is None else t.join(large, "flow_id", "left_semi")
        out = flows(table.join(large, "flow_id", "left_anti")).unionByName(_graph_issues(*map(only, (steps, nodes, edges, refs, outputs))))
    calls = steps.select("flow_id", F.col("step").alias("node"), "call").unionByName(nodes.select("flow_id", "node", "call"))
    out = out.unionByName(call_issues(calls, contracts["services"], contracts["operations"]).withColumn("level", F.lit("ERROR")))
    if "keys" in contracts:
        out = out.unionByName(telemetry_keys(contracts["keys"]).select("flow_id", F.lit("ERROR").alias("level"), F.lit("telemetry key").alias("rule"), F.col("node").alias("subject")))
    if "issues" in contracts:
        out = out.unionByName(contracts["issues"].select("flow_id", "level", F.lit("format").alias("rule"), F.col("message").alias("subject")))
    return out
