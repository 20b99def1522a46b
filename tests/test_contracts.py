"""Contracts as tables: conditions as clauses, folding, variables, long contracts, own parents, and the store of spans."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from test_operators import SF, SPAN, spans

from spanflow.operators import callgraph, conditions, contractgraph, gate, graph, lint, mask, match, ranges, report, validate
from spanflow.operators.steps import checkpointed
from spanflow.plans import fixtures
from spanflow.plans.queries import QUERIES
from spanflow.sources import store

RULES = "flow_id string, service string, operation string, kind string, condition string, expression string"


def results(spark, texts, flow="f"):
    body = F.parse_json(F.lit('{"a":1,"b":"x","n":{"m":true}}'))
    attributes = F.create_map(F.lit("http.status_code"), F.lit(201).cast("variant"), F.lit("response.body"), body, F.lit("http"), F.parse_json(F.lit('{"route":"/r"}')), F.lit("http.route"), F.lit("/flat").cast("variant"))
    span = spark.range(1).select(F.lit(flow).alias("flow_id"), F.lit(" S.op ").alias("call"), attributes.alias("attributes"), F.lit("S").alias("service"), F.lit("op").alias("name"), F.lit(1).alias("start_ns"), F.lit(2).alias("end_ns"))
    rows = spark.createDataFrame([(flow, "S", "op", "post", t, t) for t in texts], RULES)
    return {r["condition"]: r["result"] for r in conditions.by_operation(span, rows).collect()}


def test_conditions_of_several_literals(spark):
    """What cannot be evaluated counts only where the rest does not decide."""
    yes, no, open_ = "response.body.a == 1", "response.body.b == 'y'", "response.body.z == 1"
    want = {
        f"{yes} && {yes}": "PASS", f"{yes} && {no}": "FAIL", f"{yes} && {open_}": "SKIP", f"{no} && {open_}": "FAIL", f"{yes} || {open_}": "PASS", f"{open_} || {no}": "SKIP", f"{no} || {no}": "FAIL",
        f"!({yes})": "FAIL", f"!({no})": "PASS", f"!({open_})": "SKIP", "!has(response.body.z)": "PASS", f"{no} || {yes} && {yes}": "PASS", f"({no} || {yes}) && {no}": "FAIL", f"({no} || {yes}) && ({yes})": "PASS",
        f"({open_} || {no}) && {no}": "FAIL", f"({yes} && {open_}) || {yes}": "PASS", f"({open_} || {yes}) && !({no})": "PASS", f"({open_} || {no}) && !({no})": "SKIP",
        "response.body.b =~ /[/": "SKIP", f"response.body.b =~ /[/ || {yes}": "PASS", f"response.body.b =~ /[/ && {no}": "FAIL", "!(response.body.b =~ /^x|y$/)": "FAIL",
        "response.body.b == 'a && b' || response.body.n.m == true": "PASS", f"({yes} && ({no} || {yes}))": "SKIP", f"{yes} &&": "SKIP", "a && b": "SKIP", f"!{yes}": "SKIP", "": "SKIP",
        "span.attributes.http.route == '/r'": "PASS", "span.attributes.http_route == '/flat'": "SKIP", "has(span.attributes.http)": "PASS",
    }
    assert results(spark, list(want)) == want


def test_a_bad_pattern_stops_nobody(spark):
    s = spans(spark, [("1", None, "S", "op", 0, 1)]).withColumn("attributes", F.create_map(F.lit("k"), F.lit("v").cast("variant")))
    tables = {
        "steps": spark.createDataFrame([(f, 0, None, "s", "S.op") for f in ("good", "bad")], "flow_id string, pos int, group_pos int, step string, call string"),
        "nodes": spark.createDataFrame([], "flow_id string, n int, node string, call string"), "edges": spark.createDataFrame([], "flow_id string, from_id string, to_id string"),
        "conditions": spark.createDataFrame([("good", "S", "op", "post", "c", "span.attributes.k =~ /^v$/"), ("bad", "S", "op", "post", "c", "span.attributes.k =~ /[/")], RULES),
    }
    steps, found = validate.validate(s, tables, spark.createDataFrame([("t", "good"), ("t", "bad")], "trace_id string, flow_id string"))
    assert {r["flow_id"]: r["status"] for r in steps.collect()} == {"good": "PASS", "bad": "PASS"}
    assert {r["flow_id"]: r["result"] for r in found.collect()} == {"good": "PASS", "bad": "SKIP"}
    row = spark.range(1).select(F.create_map(F.lit("k"), F.lit("v").cast("variant")).alias("attributes"))
    assert [r["result"] for r in conditions.evaluate(row, [("post", "c", "span.attributes.k", "matches", "["), ("post", "d", "span.attributes.k", "matches", "v")]).collect()] == ["SKIP", "PASS"]


def test_a_span_that_names_itself_has_no_parent(spark):
    flow = [(0, "g", "a", "A.x"), (1, "g", "b", "B.x")]
    for parents in ((None, None), ("a", None), ("a", "b"), (None, "gone")):
        rows = [("a", parents[0], "A", "x", 1, 2), ("b", parents[1], "B", "x", 5, 6)]
        assert {x["status"] for x in match.causality_steps(spans(spark, rows), flow).collect()} == {"PASS"}
        n = callgraph.call_nodes(spans(spark, rows))
        assert callgraph.parent_edges(n).count() == 0 and callgraph.call_graph_stats(n, callgraph.call_edges(n)).first()["roots"] == 2


def test_known_parents(spark):
    rows = [("a", "c", "A", "x", 1, 2), ("b", "a", "B", "x", 5, 6), ("a", "b", "A", "y", 0, 9), ("d", "a", "D", "x", 3, 4)]
    got = {(r["span_id"], r["ordinal"]): (r["parent_span_id"], r["parent_start"] is not None) for r in callgraph.known_parents(spans(spark, rows)).collect()}
    assert got == {("a", 0): (None, False), ("b", 1): ("a", True), ("a", 2): ("b", True), ("d", 3): ("a", True)}


def dag(spark, edges, names, flow="f"):
    nodes = spark.createDataFrame([(flow, k, x, "a.b") for k, x in enumerate(names)], "flow_id string, n int, node string, call string")
    return spark.createDataFrame([(flow, *e) for e in edges], "flow_id string, from_id string, to_id string"), nodes


def folded(*tables):
    steps = {}
    for r in graph.fold_parallel(*tables).collect():
        steps.setdefault(r["pos"], []).append((r["group_pos"], r["node"]))
    return [[n for _, n in sorted(steps[k])] if steps[k][0][0] is not None else steps[k][0][1] for k in sorted(steps)]


@pytest.mark.parametrize("bound", [contractgraph.BOUND, 0])
def test_fold(spark, monkeypatch, bound):
    monkeypatch.setattr(contractgraph, "BOUND", bound)
    assert folded(*dag(spark, ["pc", "pd", "ce", "cf"], "pcdef")) == ["p", ["c", "d"], "e", "f"]  # a folded node does not fold
    assert folded(*dag(spark, ["pc", "pd", "ce", "cf", "eg", "eh"], "pcdefgh")) == ["p", ["c", "d"], "e", ["g", "h"], "f"]
    assert folded(*dag(spark, ["ab", "ac", "bd", "cd"], "abcd")) == ["a", ["b", "c"], "d"]
    assert folded(*dag(spark, ["ab", "ac", "ad", "xd"], "xabcd")) == ["x", "a", ["b", "c"], "d"]  # kept, though its predecessor folds others
    assert folded(*dag(spark, ["ab", "bc"], "cab")) == ["a", "b", "c"]
    assert folded(*dag(spark, ["ab", "bc", "cb"], "abc")) == ["a"]


def test_a_folded_flow_is_validated(spark):
    edges, nodes = dag(spark, ["pc", "pd", "ce"], "pcde")
    nodes = nodes.withColumn("call", F.concat("node", F.lit(".x")))
    steps = graph.fold_parallel(edges, nodes).join(nodes.select("flow_id", "node", "call"), ["flow_id", "node"]).withColumnRenamed("node", "step")
    s = spans(spark, [("1", None, "p", "x", 0, 9), ("2", "1", "c", "x", 1, 3), ("3", "2", "d", "x", 4, 5), ("4", "1", "e", "x", 6, 7)]).withColumn("attributes", F.create_map().cast("map<string,variant>"))
    got = validate.by_causality(s, spark.createDataFrame([("t", "f")], "trace_id string, flow_id string"), steps)
    assert {r["step"]: r["status"] for r in got.collect()} == {"p": "PASS", "c": "FAIL", "d": "FAIL", "e": "PASS"}


def random_graphs(spark, seed):
    r = random.Random(seed)
    nodes, edges = [], []
    for f in range(60):
        n = r.randint(1, 9)
        order = r.sample(range(n), n)
        nodes += [(f, k, f"n{k}", "a.b") for k in range(n)]
        edges += [(f, f"n{order[a]}", f"n{order[b]}") for a in range(n) for b in range(a + 1, n) if r.random() < 0.35]
        if f % 5 == 0 and n > 2:
            edges += [(f, f"n{order[2]}", f"n{order[0]}"), (f, "n0", "lost"), (f, "gone", "n1")]
    return spark.createDataFrame(edges, "flow_id long, from_id string, to_id string"), spark.createDataFrame(nodes, "flow_id long, n int, node string, call string")


def test_rounds_give_what_one_pass_gives(spark, monkeypatch):
    edges, nodes = random_graphs(spark, 3)
    r = random.Random(4)
    outputs = nodes.select("flow_id", "node", F.concat(F.lit("v_"), "node").alias("variable"))
    refs = spark.createDataFrame([(f, f"n{r.randrange(9)}", f"v_n{r.randrange(9)}.x") for f in range(60) for _ in range(6)] + [(1, "n0", "userId")], "flow_id long, node string, variable string").distinct()

    def all_():
        dags = edges.where("flow_id % 5 <> 0")
        found = [graph.checks(edges, nodes), graph.checks(edges, nodes, known_only=True), graph.topo_levels(edges, nodes), graph.fold_parallel(dags, nodes.where("flow_id % 5 <> 0")), lint.graph_variables(refs, outputs, graph.known_edges(edges, nodes))]
        return [sorted(map(tuple, f.select(*sorted(f.columns)).collect()), key=str) for f in found]

    one = all_()
    monkeypatch.setattr(contractgraph, "BOUND", 0)
    assert all_() == one and all(one)
    monkeypatch.setattr(contractgraph, "BOUND", 15)  # some flows each way
    assert all_() == one


def test_issues_of_one_pass_are_those_of_tables(spark, monkeypatch):
    edges, nodes = random_graphs(spark, 5)
    r = random.Random(6)
    more = spark.createDataFrame([(1, 90, None, "a.b"), (2, 91, "", "a.b"), (3, 92, "n0", "a.b"), (61, 0, "alone", None)], "flow_id long, n int, node string, call string")
    nodes, edges = nodes.unionByName(more), edges.unionByName(spark.createDataFrame([(2, None, "n0"), (2, "n0", None), (62, "x", "y")], "flow_id long, from_id string, to_id string"))
    at = [(100 + f, None if r.random() < 0.1 else k // 2, k % 2, r.choice(["n0", "n1", "n2", "n3", "n4", None, ""]), "a.b") for f in range(20) for k in range(6)]
    steps = spark.createDataFrame(at, "flow_id long, pos int, group_pos int, step string, call string")
    flow = lambda: r.choice([r.randrange(63), 100 + r.randrange(20)])
    names = [f"n{k}" for k in range(7)] + [None]
    refs = spark.createDataFrame([(flow(), r.choice(names), r.choice(["v1.x", "v2", "v3.y.z", "userId", None])) for _ in range(400)], "flow_id long, node string, variable string")
    outputs = spark.createDataFrame([(flow(), r.choice(names), r.choice(["v1", "v2", "v3", None])) for _ in range(300)], "flow_id long, node string, variable string")
    tables = {"steps": steps, "nodes": nodes, "edges": edges, "references": refs, "outputs": outputs, "services": spark.createDataFrame([(1, "a")], "flow_id long, service string"), "operations": spark.createDataFrame([("a", "b")], "service string, operation string")}
    found = lambda: Counter(map(tuple, lint.issues(tables).select("flow_id", "level", "rule", "subject").collect()))
    one = found()
    assert {rule for _, _, rule, _ in one} == {"dangling edge", "step name", "node name", "cycle", "unreachable nodes", "unknown variable", "legacy format", "call format", "undeclared service"}
    monkeypatch.setattr(contractgraph, "BOUND", 0)
    assert found() == one
    monkeypatch.setattr(contractgraph, "BOUND", 15)  # some flows each way
    assert found() == one


def test_variables_along_a_long_chain(spark):
    n = 5000
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    k = spark.range(1, n)
    edges = k.select(F.lit("f").alias("flow_id"), name(F.col("id") - 1).alias("from_id"), name(F.col("id")).alias("to_id"))
    outputs = spark.createDataFrame([("f", "n0", "first"), ("f", f"n{n - 1}", "last")], "flow_id string, node string, variable string")
    refs = spark.createDataFrame([("f", f"n{n - 1}", "first.x"), ("f", "n7", "last"), ("f", "n0", "first"), ("f", "n1", "first")], "flow_id string, node string, variable string")
    assert sorted((r["node"], r["variable"]) for r in lint.graph_variables(refs, outputs, edges).collect()) == [("n0", "first"), ("n7", "last")]


def test_a_contract_of_a_thousand_steps(spark):
    """One window in the plan, however long the contract, and the same as a walk."""
    r, n = random.Random(1), 1000
    calls = [f"s{r.randrange(40)}.op" for _ in range(n)]
    steps = spark.createDataFrame([("f", k, None, f"p{k}", c) for k, c in enumerate(calls)] + [("g", 0, None, "p0", "s1.op")], "flow_id string, pos int, group_pos int, step string, call string")
    trace = [(str(k), None, f"s{r.randrange(45)}", "op", k, k + 1) for k in range(600)]
    s = spans(spark, trace).withColumn("attributes", F.create_map().cast("map<string,variant>"))
    found = validate.by_time(s, spark.createDataFrame([("t", "f"), ("t", "g")], "trace_id string, flow_id string"), steps)
    at, want = 0, {}
    for k, c in enumerate(calls):
        hit = next((i for i in range(at, len(trace)) if f"{trace[i][2]}.op" == c), None)
        want[k] = None if hit is None else str(hit)
        at = at if hit is None else hit + 1
    assert {x["pos"]: x["span_id"] for x in found.where("flow_id = 'f'").collect()} == want
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Window [") <= 2  # numbering, once for candidates and once for the spans taken


def test_a_store_is_not_shuffled(spark, tmp_path):
    conf = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.requireAllClusterKeysForCoPartition")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        store.save_spans(fixtures.with_attributes(fixtures.event_spans(spark, SF)), "spans_of_a_test", f"file://{tmp_path}", 8)
        s = store.load_spans(spark, "spans_of_a_test", attributes=True)
        n = callgraph.call_nodes(store.load_spans(spark, "spans_of_a_test"))
        e = callgraph.call_edges(n)
        plans = [s, n, e, callgraph.edge_violations(n, e), match.resolved_parents(s), match.causality_steps(s, fixtures.F2, ("attributes",)), match.with_first_bad(match.graph_match(s, fixtures.G1, ("attributes",)), fixtures.G1), match.time_sequence(s, fixtures.F1), match.route(s, "linear")]
        for df in plans:
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        narrow = callgraph.call_edges(n)._jdf.queryExecution().executedPlan().toString()
        assert "attributes" not in narrow and "Bucketed: true" in narrow
        assert s.count() == fixtures.event_spans(spark, SF).count()
        assert s.where("attributes IS NULL").count() == 0
        store.save_spans(spans(spark, [("1", None, "A", "x", 0, 1)]), "spans_of_a_test", f"file://{tmp_path}", 8)  # replaces
        assert store.load_spans(spark, "spans_of_a_test").count() == 1
    finally:
        store.drop_store(spark, "spans_of_a_test")
        for k, v in conf.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_cycles_are_looked_for_where_they_can_be(spark, monkeypatch):
    looked = []
    real = callgraph.call_cycles
    monkeypatch.setattr(callgraph, "call_cycles", lambda nodes: looked.append(nodes.select("trace_id").distinct().count()) or real(nodes))
    QUERIES["edge_violations"](spark, SF).count()
    assert not looked
    rows = [("t", "a", "b", "A", "x", 5, 9, 0), ("t", "b", "a", "B", "x", 6, 8, 1), ("u", "a", None, "A", "x", 1, 9, 2), ("u", "b", "a", "B", "x", 2, 8, 3), ("v", "a", "b", "A", "x", 3, 9, 4), ("v", "b", None, "B", "x", 4, 8, 5)]
    n = callgraph.call_nodes(spark.createDataFrame(rows, SPAN))
    got = callgraph.edge_violations(n, callgraph.call_edges(n)).where("type = 'cycle'").collect()
    assert [(r["trace_id"], r["from_id"], r["to_id"]) for r in got] == [("t", "b", "a")] and looked == [2]


def test_a_large_trace_is_many_ranges(spark):
    """Two million spans of one trace among small ones: no range much above the others."""
    n = 2_000_000
    s = spark.range(n + 60_000).select(F.when(F.col("id") < n, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 3000).cast("string"))).alias("trace_id"), (F.col("id") * 7919 % 1_000_003).alias("start_ns"), F.col("id").alias("ordinal"))
    r = ranges.ranged(s, ["start_ns", "ordinal"], 200_000)
    sizes = sorted(x["count"] for x in r.groupBy("range").count().collect())
    assert len(sizes) >= 10 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    hot = ranges.numbered(r, ["start_ns", "ordinal"]).where("trace_id = 'hot'")
    assert tuple(hot.agg(F.count(F.lit(1)), F.min("idx"), F.max("idx"), F.count_distinct("idx")).first()) == (n, 1, n, n)
    wrong = hot.select("idx", F.struct("start_ns", "ordinal").alias("at")).repartitionByRange(8, "idx").sortWithinPartitions("idx")
    wrong = wrong.withColumn("before", F.lag("at").over(Window.partitionBy((F.col("idx") / 1000).cast("int")).orderBy("idx")))
    assert wrong.where("before >= at").count() == 0


@pytest.mark.parametrize("rows", [1, 7, 10**6])
def test_ranges_give_what_a_window_gives(spark, monkeypatch, rows):
    real = ranges.ranged
    monkeypatch.setattr(ranges, "ranged", lambda s, order, _=0: real(s, order, rows))
    r = random.Random(rows)
    data = [(str(k), str(r.randrange(60)) if r.random() < 0.5 else None, r.choice("AB"), "x", r.randrange(30), r.randrange(20, 60)) for k in range(60)]
    s = spans(spark, data).union(spans(spark, data[:3]).withColumn("trace_id", F.lit("u")))
    n = callgraph.call_nodes(s)
    same = lambda a, b: sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.select(*a.columns).collect()), key=str)
    assert same(callgraph.call_edges(n), callgraph.call_edges(n, large=True))
    assert same(report.timeline(s), report.timeline(s, large=True))
    flow = [(0, None, "a", "A.x"), (1, None, "b", "B.x"), (2, None, "none", "C.x"), (3, None, "c", "A.x"), (4, None, "d", "A.x")]
    assert same(match.time_sequence(s, flow, ("end_ns",)), match.time_sequence_large(s, flow, ("end_ns",)))


def attributes(spark):
    rows = [(t, s, o, k, v, is_string) for t in ("a", "b", None) for s in ("crm", "shop") for o in ("get", "put") for k, v, is_string in (("user.email", "jo@x.org", True), ("email", "ann@x.org", True), ("id", "7", False), ("order.customer.id", "c1", True), ("note", None, True), ("k1234", "v", True))]
    return spark.createDataFrame(rows, "tenant string, service string, operation string, key string, value string, is_string boolean")


def test_rules_as_tables_are_the_chain(spark):
    prefix, hashed, token = {"type": "keep-prefix", "prefixLen": 2, "mask": "#"}, {"type": "hash", "salt": "s"}, {"type": "tokenize", "tokenPrefix": "p_"}
    policy = {"version": 1, "rules": [
        {"match": {"service": "crm", "operation": "get", "paths": ["customer.id", "nothing"]}, "strategy": hashed}, {"match": {"paths": ["email"], "regexKeys": ["^user"]}, "strategy": prefix}, {"match": {"service": "shop", "regexKeys": ["(?i)EMAIL", "id$"]}, "strategy": token},
        {"match": {"operation": "put", "tag": "pii"}, "strategy": {"type": "null"}}, {"match": {"regexKeys": ["note"]}, "strategy": {"type": "redact"}},
    ]}
    table = spark.createDataFrame(mask.rule_rows({"a": policy, "b": {"version": 1, "rules": policy["rules"][::-1]}}), mask.RULES)
    a = attributes(spark)
    got = {tuple(r[:4]): (r["rule"], r["masked"]) for r in mask.apply_rules(a, table).collect()}
    for tenant, p in (("a", policy), ("b", {"version": 1, "rules": policy["rules"][::-1]})):
        want = {tuple(r[:4]): (r["rule"], r["masked"]) for r in mask.apply(a.where(F.col("tenant") == tenant), p).collect()}
        assert {k: v for k, v in got.items() if k[0] == tenant} == want
    assert all(v[0] == -1 for k, v in got.items() if k[0] is None) and len(got) == a.count()


def test_the_plan_does_not_grow_with_the_rules(spark):
    a = attributes(spark)
    many = {"version": 1, "rules": [{"match": {"paths": [f"k{k}"]}, "strategy": {"type": "redact"}} for k in range(5000)] + [{"match": {"regexKeys": ["^no"]}, "strategy": {"type": "redact"}}]}
    size = lambda p: len(mask.apply_rules(a, spark.createDataFrame(mask.rule_rows({"a": p}), mask.RULES))._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(many) - size({"version": 1, "rules": many["rules"][:1]})) < 100
    got = mask.apply_rules(a, spark.createDataFrame(mask.rule_rows({"a": many}), mask.RULES)).where("rule >= 0").select("tenant", "key", "rule").distinct().collect()
    assert sorted(map(tuple, got)) == [("a", "k1234", 1234), ("a", "note", 5000)]
    bad = spark.createDataFrame([("a", 0, "*", "*", "*", ["["], ("redact", None, None, "", None)), ("a", 1, "*", "*", "note", [], ("redact", None, None, "", None))], mask.RULES)
    assert {r["rule"] for r in mask.apply_rules(a, bad).collect()} == {-1, 1}


def test_contracts_of_a_batch_are_one_graph():
    """Names are numbers, and flows of one batch do not meet, whether they have cycles or more nodes than a number has bits."""
    chain = [(contractgraph.EDGE, f"n{k}", f"n{k + 1}") for k in range(70)] + [(contractgraph.REFERENCE, "n70", "v.x"), (contractgraph.REFERENCE, "n70", "w"), (contractgraph.OUTPUT, "n0", "v"), (contractgraph.OUTPUT, "n70", "w")]
    r = random.Random(7)
    flows = [chain, [*chain, (contractgraph.EDGE, "n9", "n3")], []]
    for _ in range(200):
        name = lambda: r.choice(["n1", "n2", "n3", "n4", "n5", "", None])
        flows.append([(contractgraph.NODE, name(), None) for _ in range(r.randint(0, 6))] + [(contractgraph.EDGE, name(), name()) for _ in range(r.randint(0, 6))])
        flows[-1] += [(contractgraph.REFERENCE, name(), r.choice(["v.x", "w"])) for _ in range(2)] + [(contractgraph.OUTPUT, name(), r.choice("vw")) for _ in range(2)] + [(contractgraph.STEP, name(), None)] * r.randint(0, 1)

    def rows(flows):
        at = [(f, k, a, b) for f, of in enumerate(flows) for k, a, b in of]
        names = pa.array([x[2] for x in at] + [x[3] for x in at], pa.large_string()).dictionary_encode(null_encoding="encode")
        code, n = names.indices.to_numpy().astype(np.int64), len(at)
        column = lambda k: np.array([x[k] for x in at], np.int64)
        return contractgraph.Rows(len(flows), column(0), column(1), np.arange(n), np.zeros(n, bool), code[:n], code[n:], names.dictionary)

    def found(flows, f, first=0):
        flow, columns = f(rows(flows))
        return Counter(zip((flow + first).tolist(), *[c.to_pylist() for k, c in enumerate(columns) if f is not contractgraph.facts or k != 1], strict=True))

    for f in (contractgraph.facts, contractgraph.unknown, contractgraph.issues):
        assert found(flows, f) == sum((found([flow], f, k) for k, flow in enumerate(flows)), Counter())
    assert {x for x in found(flows, contractgraph.unknown) if x[0] < 2} == {(0, "n70", "w"), (1, "n70", "w")}


def test_a_store_with_attributes_inside_is_read_without_a_join(spark, tmp_path):
    s = fixtures.with_attributes(fixtures.event_spans(spark, SF))
    conf = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(conf)
    try:
        store.save_spans(s, "whole_spans_of_a_test", f"file://{tmp_path}", 8, apart=False)
        got = store.load_spans(spark, "whole_spans_of_a_test", attributes=True)
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
        assert "attributes" not in store.load_spans(spark, "whole_spans_of_a_test").columns
        columns = ["trace_id", "span_id", "ordinal", "parent_span_id", F.to_json("attributes").alias("a")]
        assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, s.select(*columns).collect()))
    finally:
        spark.conf.set(conf, before)
        store.drop_store(spark, "whole_spans_of_a_test")


def test_traces_are_not_shuffled_by_the_calls_of_a_contract(spark):
    s = fixtures.with_attributes(fixtures.event_spans(spark, SF))
    pairs = s.select("trace_id").distinct().crossJoin(spark.createDataFrame([(f,) for f in fixtures.FLOWS], "flow_id string"))
    results = validate.validate(s, fixtures.contracts(spark), pairs)[1]
    assert "Exchange hashpartitioning" not in results._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["json_report_read", "junit_report_read", "trace_verdict_linted"])
def test_a_run_that_is_read_often_matches_traces_once(spark, monkeypatch, name):
    """What is read more than once is read from a written step: no plan after it goes back to the events."""
    made = []
    kept = DataFrameWriter.json, DataFrameWriter.save, gate.verdict
    monkeypatch.setattr(DataFrameWriter, "json", lambda w, *a, **k: (made.append(w._df), kept[0](w, *a, **k))[1])
    monkeypatch.setattr(DataFrameWriter, "save", lambda w, *a, **k: (made.append(w._df), kept[1](w, *a, **k))[1])
    monkeypatch.setattr(gate, "verdict", lambda *a: (made.append(kept[2](*a)), made[-1])[1])
    QUERIES[name](spark, SF)
    assert len(made) == 1
    assert not any("events.parquet" in f for f in made[0].inputFiles())


def test_what_has_a_row_a_trace_is_never_broadcast(spark, monkeypatch):
    """However small its files are: the driver would have to hold all traces."""
    planned = []

    def wide(plan):
        """The broadcasts of a plan that have a column of traces."""
        if plan.nodeName().startswith("AdaptiveSparkPlan"):
            return wide(plan.initialPlan())
        found = [plan.toString()] if plan.nodeName().startswith("BroadcastExchange") and "trace_id" in plan.output().toString() else []
        return sum((wide(plan.children().apply(k)) for k in range(plan.children().size())), found)

    def seen(df):
        planned.append(df)
        return checkpointed(df)

    monkeypatch.setattr(validate, "checkpointed", seen)
    s = checkpointed(fixtures.with_attributes(fixtures.event_spans(spark, SF)))
    pairs = s.select("trace_id").distinct().crossJoin(F.broadcast(spark.createDataFrame([(f,) for f in fixtures.FLOWS], "flow_id string")))
    planned += validate.validate(s, fixtures.contracts(spark), pairs)
    assert len(planned) > 5
    for df in planned:
        assert wide(df._jdf.queryExecution().executedPlan()) == []
