"""Operators on literal spans, contracts and policies."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanflow.operators import callgraph, conditions, discover, gate, graph, lint, mask, match
from spanflow.plans import fixtures
from spanflow.plans.queries import QUERIES

MS = 1_000_000
SF = "/root/testdata/sf0.001"
SPAN = "trace_id string, span_id string, parent_span_id string, service string, name string, start_ns long, end_ns long, ordinal long"


def spans(spark, rows):
    return spark.createDataFrame([("t", i, p, s, n, a * MS, b * MS, k) for k, (i, p, s, n, a, b) in enumerate(rows)], SPAN)


@pytest.mark.parametrize(
    ("rows", "edges", "tolerance", "want"),
    [
        ([("a", None, "A", "x", 0, 100), ("b", "a", "B", "x", 10, 90)], None, 10, []),
        ([("a", None, "A", "x", 0, 100), ("b", "a", "B", "x", 10, 150)], None, 10, ["parent-child"]),
        ([("a", None, "A", "x", 0, 100), ("b", "a", "B", "x", 10, 150)], None, 50, []),
        ([("a", None, "A", "x", 0, 100), ("b", None, "B", "x", 20, 30)], [("a", "b", "follows")], 10, ["causality"]),
        ([("a", None, "A", "x", 0, 10), ("b", None, "B", "x", 20, 30)], [("a", "b", "concurrent")], 10, ["overlap"]),
    ],
)
def test_edge_violations(spark, rows, edges, tolerance, want):
    n = callgraph.call_nodes(spans(spark, rows))
    e = callgraph.call_edges(n) if edges is None else spark.createDataFrame([("t", *x) for x in edges], "trace_id string, from_id string, to_id string, relationship string")
    assert [r["type"] for r in callgraph.edge_violations(n, e, tolerance).collect()] == want


def test_a_cycle_is_a_violation(spark, monkeypatch):
    n = callgraph.call_nodes(spans(spark, [("a", "c", "A", "x", 0, 9), ("b", "a", "B", "x", 1, 8), ("c", "b", "C", "x", 2, 7)]))
    got = callgraph.edge_violations(n, callgraph.call_edges(n)).collect()
    assert [tuple(r) for r in got] == [("t", "c", "a", "cycle")]
    turned, sf = fixtures.cyclic_spans(spark, SF), SF
    cycles = {r["trace_id"] for r in QUERIES["call_graph_cycles"](spark, sf).collect()}
    monkeypatch.setattr(fixtures, "event_spans", lambda *_: turned)
    bad = QUERIES["edge_violations"](spark, sf).collect()
    assert sorted(r["trace_id"] for r in bad if r["type"] == "cycle") == sorted(cycles) and cycles
    notes = {t: f"Detected {k} DAG constraint violations" for t, k in Counter(r["trace_id"] for r in bad).items()}
    for name in ("graph_validation", "causality_validation"):
        assert {r["trace_id"]: r["note"] for r in QUERIES[name](spark, sf).where("step = 'DAG Validation'").collect()} == notes


def test_cycle(spark):
    n = callgraph.call_nodes(spans(spark, [("a", "c", "A", "x", 0, 9), ("b", "a", "B", "x", 1, 8), ("c", "b", "C", "x", 2, 7), ("d", "c", "D", "x", 3, 4)]))
    r = callgraph.call_cycles(n).collect()
    assert [(x["start_id"], x["length"], x["path"]) for x in r] == [("a", 4, ["a", "b", "c", "a"])]
    chain = callgraph.call_nodes(spans(spark, [("a", None, "A", "x", 0, 9), ("b", "a", "B", "x", 1, 8)]))
    assert callgraph.call_cycles(chain).count() == 0


def test_cycle_above_a_long_tail(spark):
    n = callgraph.call_nodes(spans(spark, [(str(i), str(i + 1) if i < 9 else "8", "A", "x", 0, 9) for i in range(1, 10)]))
    assert [(x["start_id"], x["length"], x["path"]) for x in callgraph.call_cycles(n).collect()] == [("8", 3, ["8", "9", "8"])]


def long_spans(spark, n, parent):
    """Spans s00000, s00001, ... of one trace, each starting after the one before."""
    name = lambda k: F.format_string("s%05d", k)
    return spark.range(n).select(F.lit("t").alias("trace_id"), name(F.col("id")).alias("span_id"), name(parent(F.col("id"))).alias("parent_span_id"), F.lit("A").alias("service"), F.lit("x").alias("name"), F.col("id").alias("start_ns"), F.lit(10**6).alias("end_ns"), F.col("id").alias("ordinal"))


def test_a_long_cycle_below_a_long_tail(spark):
    ring = long_spans(spark, 12_000, lambda k: F.when(k == 10_499, 0).otherwise(k + 1 - F.when(k >= 11_999, 2).otherwise(0)))
    ring = ring.withColumn("parent_span_id", F.when(F.col("ordinal") > 10_499, F.format_string("s%05d", F.col("ordinal") - 1)).otherwise(F.col("parent_span_id")))  # the tail
    r = callgraph.call_cycles(callgraph.call_nodes(ring)).first()
    assert (r["start_id"], r["length"], r["path"][1], r["path"][-1]) == ("s00000", 10_501, "s10499", "s00000")


def test_levels_of_a_long_trace(spark):
    nested = callgraph.call_nodes(long_spans(spark, 10_000, lambda k: k - 1).withColumn("parent_span_id", F.when(F.col("ordinal") > 0, F.col("parent_span_id"))))
    assert callgraph.call_levels(nested).agg(F.min("level"), F.max("level"), F.count("*")).first()[:] == (0, 9_999, 10_000)
    assert callgraph.call_depth(nested).first()["depth"] == 9_999


def test_levels_are_longest_paths(spark):
    """Doubling against taking nodes off one by one."""
    n = callgraph.call_nodes(fixtures.event_spans(spark, SF))
    edges = callgraph.call_edges(n).where("relationship <> 'concurrent'")
    slow = callgraph.levels(edges, n.select("trace_id", F.col("span_id").alias("id")), ["trace_id"])
    assert {(r[0], r[1], r[2]) for r in slow.collect()} == {(r[0], r[1], r[2]) for r in callgraph.call_levels(n).collect()}
    loop = callgraph.call_nodes(spans(spark, [("a", "b", "A", "x", 0, 9), ("b", "a", "B", "x", 1, 8), ("c", "b", "C", "x", 2, 3), ("d", None, "D", "x", 4, 5), ("e", "d", "E", "x", 5, 6), ("f", "d", "F", "x", 6, 7)]))
    assert {r["span_id"]: r["level"] for r in callgraph.call_levels(loop).collect()} == {"d": 0, "e": 1, "f": 2}


def test_levels(spark):
    n = callgraph.call_nodes(spans(spark, [("a", None, "A", "x", 0, 9), ("b", "a", "B", "x", 1, 2), ("c", "a", "C", "x", 3, 5), ("d", "b", "D", "x", 1, 2)]))
    assert {r["span_id"]: r["level"] for r in callgraph.call_levels(n).collect()}["a"] == 0


def test_duplicate_ids_keep_the_last(spark):
    r = callgraph.call_nodes(spans(spark, [("a", None, "A", "x", 0, 9), ("a", None, "B", "x", 1, 2)])).collect()
    assert [x["service"] for x in r] == ["B"]


def test_time_sequence_and_missing(spark):
    s = spans(spark, [("1", None, "Order ", "create", 5, 6), ("2", None, "noise", "x", 6, 7), ("3", None, "pay", "charge", 7, 8), ("4", None, "ship", "go", 1, 2)])
    flow = [(0, None, "s1", "order.create"), (1, None, "s2", "ship.go"), (2, None, "s3", "pay.charge")]
    r = {x["step"]: (x["status"], x["span_id"], x["note"]) for x in match.time_sequence(s, flow).collect()}
    assert r["s1"][:2] == ("PASS", "1") and r["s2"][0] == "FAIL" and r["s3"] == ("PASS", "3", "matched span #4 by time sequence (intermediate spans exist)")


def test_parallel(spark):
    flow = [(0, "g", "a", "A.x"), (1, "g", "b", "B.x")]
    apart = [("r", None, "R", "x", 0, 9), ("a", "r", "A", "x", 1, 2), ("b", "q", "B", "x", 5, 6), ("q", None, "Q", "x", 5, 9)]
    assert {x["status"] for x in match.causality_steps(spans(spark, apart), flow).collect()} == {"FAIL"}
    siblings = [("r", None, "R", "x", 0, 9), ("a", "r", "A", "x", 1, 2), ("b", "r", "B", "x", 5, 6)]
    assert {x["status"] for x in match.causality_steps(spans(spark, siblings), flow).collect()} == {"PASS"}


def test_graph_match_does_not_reuse(spark):
    dag = [(0, "n1", "A.x", []), (1, "n2", "A.x", ["n1"])]
    r = {x["node"]: x["span_id"] for x in match.graph_match(spans(spark, [("1", None, "A", "x", 3, 4)]), dag).collect()}
    assert r == {"n1": "1", "n2": None}


def test_conditions_types(spark):
    row = spark.range(1).select(F.expr("""map('response.status', cast(201.0 as variant), 'response.body', parse_json('{"s":"200","a":[1],"n":null}'))""").alias("attributes"))
    found = conditions.evaluate(row, [
        ("post", "number", "response.status", "eq", 201), ("post", "text", "response.body.s", "eq", 200), ("post", "order", "response.body.s", "lt", 200), ("post", "missing", "response.body.z", "ne", ""),
        ("post", "size", "response.body.a", "size_gt", 0), ("post", "match", "response.body.s", "matches", "^2"), ("post", "root", "http.method", "eq", "GET"), ("post", "has", "response.body.z", "has", None),
    ])
    assert {r["condition"]: r["result"] for r in found.collect()} == {"number": "PASS", "text": "FAIL", "order": "SKIP", "missing": "SKIP", "size": "PASS", "match": "PASS", "root": "SKIP", "has": "FAIL"}
    p = conditions.predicate({"and": [("response.status", "ge", 200), {"not": ("response.body.s", "eq", "x")}]})
    assert row.select(p).first()[0] is True


def cover(spark, sp, st, cp, cf, cs):
    return spark.createDataFrame([("t", sp, st, cp, cf, cs)], "trace_id string, steps_pass long, steps_total long, conditions_pass long, conditions_fail long, conditions_skip long")


@pytest.mark.parametrize(("row", "skip", "violations"), [((9, 10, 19, 1, 0), False, 0), ((1, 2, 1, 0, 0), False, 1), ((1, 1, 1, 1, 0), False, 1), ((1, 1, 1, 0, 1), True, 1), ((1, 1, 0, 0, 3), False, 1)])
def test_gate_absolute(spark, row, skip, violations):
    assert gate.absolute(cover(spark, *row), skip_as_fail=skip).first()["violations"] == violations


@pytest.mark.parametrize(("now", "base", "passed", "delta"), [((3, 3), (3, 3), True, 0.0), ((2, 3), (3, 3), True, -0.333333), ((1, 3), (3, 3), False, -0.666667), ((3, 3), (2, 3), True, 0.5), ((1, 1), (0, 0), True, 0.0)])
def test_gate_relative(spark, now, base, passed, delta):
    side = lambda p: spark.createDataFrame([("f", *p, 1, 1)], "flow string, steps_pass long, steps_total long, conditions_pass long, conditions_evaluated long")
    r = gate.relative(side(now), side(base), ["flow"], steps=0.5).first()
    assert (r["passed"], r["steps_delta_pct"]) == (passed, delta)


def test_condition_texts(spark):
    texts = ["response.status == 201", "response.body.id != ''", "size(response.body.items) > 0", "has(response.body.gone)", "response.body.s =~ /^2/", "response.body.s == 200", "input.items != ''", "a && b", "response.body.s < 'x'", "response.body.ok == true", "response.body.n >= 1.5"]
    rows = spark.createDataFrame([("f", "S", "op", "post", t, t) for t in texts], "flow_id string, service string, operation string, kind string, condition string, expression string")
    body = F.parse_json(F.lit('{"id":"o1","items":[1],"s":"200","ok":true,"n":2}'))
    span = spark.range(1).select(F.lit("f").alias("flow_id"), F.lit("S.op").alias("call"), F.create_map(F.lit("http.status_code"), F.lit(201).cast("variant"), F.lit("response.body"), body).alias("attributes"), F.lit("S").alias("service"), F.lit("op").alias("name"), F.lit(0).alias("start_ns"), F.lit(0).alias("end_ns"))
    got = {r["condition"]: r["result"] for r in conditions.by_operation(span, rows).collect()}
    assert got == dict(zip(texts, ["PASS", "PASS", "PASS", "FAIL", "PASS", "FAIL", "SKIP", "SKIP", "PASS", "PASS", "PASS"]))


def test_a_draft_fails_the_gate(spark):
    s = spans(spark, [("1", None, "shop", "buy", 0, 1), ("2", None, "pay.v2", "charge", 1, 2)])
    r = discover.lint_gate(discover.flow_steps(s), discover.services(s), discover.operations(s)).first()
    assert (r["steps"], r["errors"], r["passed"]) == (2, 1, False)


def test_lint_issues(spark):
    empty = spark.createDataFrame([], "flow_id string, from_id string, to_id string")
    tables = {
        "steps": spark.createDataFrame([("f", 0, None, "a", "S.op"), ("f", 1, None, "a", "S.none"), ("f", 2, None, "c", "bad"), ("f", 3, None, "d", "T.op")], "flow_id string, pos int, group_pos int, step string, call string"),
        "nodes": spark.createDataFrame([], "flow_id string, n int, node string, call string"), "edges": empty,
        "services": spark.createDataFrame([("f", "S")], "flow_id string, service string"), "operations": spark.createDataFrame([("S", "op")], "service string, operation string"),
        "references": spark.createDataFrame([("f", "d", "lost.x")], "flow_id string, node string, variable string"), "outputs": spark.createDataFrame([("f", "a", "kept")], "flow_id string, node string, variable string"),
        "keys": spark.createDataFrame([("f", "d", "http.method")], "flow_id string, node string, key string"),
    }
    got = Counter((r["level"], r["rule"]) for r in lint.issues(tables).collect())
    assert got == Counter({("ERROR", x): 1 for x in ("call format", "undeclared service", "missing operation", "step name", "unknown variable", "telemetry key")} | {("WARN", "legacy format"): 1})
    ok = spark.createDataFrame([("t", True)], "trace_id string, ok boolean")
    gated, errors = spark.createDataFrame([("t", True)], "trace_id string, passed boolean"), spark.createDataFrame([("t", 6)], "trace_id string, errors long")
    assert gate.verdict(ok, gated, errors).first()["verdict"] == 2


def test_verdict(spark):
    ok = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "trace_id string, ok boolean")
    g = spark.createDataFrame([("a", True), ("b", False), ("c", False)], "trace_id string, passed boolean")
    assert {r["trace_id"]: r["verdict"] for r in gate.verdict(ok, g).collect()} == {"a": 0, "b": 3, "c": 4}


def test_graph_lint(spark):
    nodes = spark.createDataFrame([("f", k, x, "a.b") for k, x in enumerate("abcd")], "flow_id string, n int, node string, call string")
    edges = spark.createDataFrame([("f", "a", "b"), ("f", "a", "c"), ("f", "b", "d"), ("f", "c", "d")], "flow_id string, from_id string, to_id string")
    assert {r["node"]: r["level"] for r in graph.topo_levels(edges, nodes).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert not graph.cycles(edges, nodes).first()["has_cycle"]
    assert graph.reachability(edges, nodes).first()["ok"]
    assert {r["node"]: (r["pos"], r["group_pos"]) for r in graph.fold_parallel(edges, nodes).collect()} == {"a": (0, None), "b": (1, 0), "c": (1, 1), "d": (2, None)}
    loop = edges.union(spark.createDataFrame([("f", "d", "a")], edges.schema))
    assert graph.cycles(loop, nodes).first()["blocked"] == 4
    assert graph.reachability(loop, nodes).first()["entries"] == 0
    assert {(r["node"], r["ancestor"]) for r in graph.ancestors(edges).collect()} == {("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("d", "a")}


def test_variables_in_values_only(spark):
    df = spark.createDataFrame([("f", "n", '{"${key}": "x", "b": ["text ${one.x}", {"c": "q: ${two}"}]}')], "flow_id string, node string, j string").select("flow_id", "node", F.parse_json("j").alias("input"))
    assert {r["variable"] for r in lint.references(lint.input_values(df)).collect()} == {"one.x", "two"}


def test_discovered_conditions(spark):
    a = spark.createDataFrame([("s", "op", 1, "http.method", "GET", False, True), ("s", "op", 1, "http.route", "/health", False, True), ("s", "op", 1, "http.status_code", "200", True, False)], "service string, operation string, start_ns long, key string, value string, is_number boolean, is_string boolean")
    r = {(x["kind"], x["condition"]): (x["path"], x["literal"]) for x in discover.conditions(a).collect()}
    assert r == {("pre", "req_method"): ("http.method", "GET"), ("pre", "req_route"): ("http.route", "/health"), ("post", "resp_status_code"): ("response.status", "200")}


def test_mask_golden(spark):
    policy = {"version": 1, "rules": [{"match": {"regexKeys": ["(?i)id$"]}, "strategy": {"type": "hash", "salt": "tenant-xyz"}}, {"match": {"regexKeys": ["email"]}, "strategy": {"type": "keep-prefix", "prefixLen": 2, "mask": "*"}}]}
    rows = spark.sql("select 's' service, 'o' name, map('customerId', cast('CUST-12345' as variant), 'email', cast('jo@example.com' as variant), 'n', cast(5 as variant)) attributes")
    out = mask.apply_to_spans(rows, policy).select(F.expr("attributes['customerId']::string"), F.expr("attributes['email']::string"), F.expr("attributes['n']::int")).first()
    assert out[0].startswith("8fd15203") and out[0].endswith("b3e") and out[1] == "jo" + "*" * 12 and out[2] == 5


@pytest.mark.parametrize("strategy", [{"type": "what"}, {"type": "keep-prefix"}, {"type": "hash", "algo": "md5"}, {"type": "tokenize"}, "unknown"])
def test_bad_policies(strategy):
    with pytest.raises(ValueError):
        mask.compiled({"version": 1, "rules": [{"match": {}, "strategy": strategy}]})
    with pytest.raises(ValueError):
        mask.compiled({"version": 2})


def test_tasks_do_not_grow_with_the_tables(spark, monkeypatch):
    """Rows a task come from the table's size and not from the session's shuffle partitions, and work by trace stays in that partitioning."""
    from spanflow.operators import steps

    monkeypatch.setattr(steps, "TASK_ROWS", 50)
    rows = spark.read.parquet(f"{SF}/events.parquet").count()
    most = lambda df: df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    e = fixtures.event_spans(spark, SF)
    assert e.rdd.getNumPartitions() == -(-rows // 50) > 4 and most(e) < rows / 4
    orders = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert steps.dealt(fixtures.order_spans(spark, SF), "trace_id", orders).rdd.getNumPartitions() == -(-orders // 50)
