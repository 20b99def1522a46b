"""Readers, writers and the streaming extension."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spanflow.operators import conditions, gate, graph, match, validate
from spanflow.plans import fixtures as fx
from spanflow.plans.queries import QUERIES
from spanflow.sources import contracts, sinks, spans
from spanflow.streaming.matching import match_stream, taken
from spanflow.streaming.sessions import validate_stream


def test_span_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"spans": [{"name": "x", "service": "s", "startNanos": 1693910000000000123, "attributes": {"a": 1, "otlp.span_id": "q"}}, {"name": "y", "service": "s"}]}))
    r = spans.read_spans(spark, f"{tmp_path}/*.json").orderBy("ordinal").collect()
    assert [(x["span_id"], x["start_ns"], x["end_ns"]) for x in r] == [("q", 1693910000000000123, 0), ("s:y:0", 0, 0)]


def otlp(tmp_path, spans_):
    attr = lambda k, **v: {"key": k, "value": v}
    body = {"resourceSpans": [{"resource": {"attributes": [attr("service.name", stringValue="shop")]}, "scopeSpans": [{"spans": spans_(attr)}]}]}
    (tmp_path / "o.json").write_text(json.dumps(body))
    return str(tmp_path / "o.json")


def test_otlp(spark, tmp_path):
    path = otlp(tmp_path, lambda attr: [
        {"traceId": "t", "spanId": "1", "name": "CreateOrder", "startTimeUnixNano": "5", "endTimeUnixNano": "9", "status": {"code": 1}, "attributes": [attr("n", intValue="7"), attr("n", intValue="8"), attr("bad", intValue="x"), attr("no", boolValue=False)]},
        {"traceId": "t", "spanId": "2", "parentSpanId": "1", "name": "read", "startTimeUnixNano": "6", "endTimeUnixNano": "8", "attributes": [attr("service.name", stringValue="other"), attr("http.status_code", intValue="404")]},
    ])
    text = lambda k: F.expr(f"attributes['{k}']::string").alias(k.replace(".", "_"))
    r = spans.read_otlp(spark, path).select("*", *[text(k) for k in ("n", "bad", "no", "response.status")]).orderBy("ordinal").collect()
    assert [(x["service"], x["parent_span_id"], x["start_ns"], x["n"], x["bad"], x["no"], x["response_status"]) for x in r] == [("shop", None, 5, "8", "x", "", "201"), ("other", "1", 6, None, None, None, "404")]
    assert spans.otlp_check(spark, path).first()["ok"]
    assert spans.otlp_stats(spark, path).first()[1:] == (1, 2)
    (tmp_path / "e.json").write_text('{"resourceSpans": []}')
    assert spans.otlp_check(spark, str(tmp_path / "e.json")).first()["reason"] == "no resourceSpans"


def test_otlp_bad_time(spark, tmp_path):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        spans.read_otlp(spark, otlp(tmp_path, lambda attr: [{"spanId": "1", "name": "x", "startTimeUnixNano": "soon", "endTimeUnixNano": "9"}])).collect()


@pytest.mark.parametrize("lines", [False, True])
def test_otlp_rejects(spark, tmp_path, lines):
    """Bad times, broken records and empty ones beside good ones: good spans are read, the others are listed."""
    span = lambda i, start, end="9": {"traceId": "t", "spanId": i, "name": "x", "startTimeUnixNano": start, "endTimeUnixNano": end}
    body = lambda *s: {"resourceSpans": [{"scopeSpans": [{"spans": list(s)}]}]}
    no_time = {"traceId": "t", "spanId": "6", "name": "x", "startTimeUnixNano": "1"}
    records = [json.dumps(body(span("1", "5"), span("2", "soon"), span("3", "6"))), '{"resourceSpans": [{"scope', json.dumps({"resourceSpans": []}), json.dumps(body(span("4", "7"))), json.dumps(body(no_time, {"name": "own", "startTimeUnixNano": "1", "endTimeUnixNano": "2"}))]
    if lines:
        (tmp_path / "all.jsonl").write_text("\n".join([*records[:2], "", *records[2:]]))
    else:
        for k, r in enumerate(records):
            (tmp_path / f"{k}.json").write_text(r)
    good, bad = spans.read_otlp_lenient(spark, f"{tmp_path}/*.json*", lines)
    got = good.collect()
    assert sorted((r["span_id"], r["start_ns"]) for r in got) == [("1", 5), ("3", 6), ("4", 7), ("unknown-service:own:1", 1)]
    assert sorted((r["position"], r["reason"]) for r in bad.collect() if r["position"]) == [("0.0.0", "end_ns: none"), ("0.0.1", "start_ns: soon")]
    assert sorted(r["reason"] for r in bad.collect() if not r["position"]) == ["no OTLP JSON", "no resourceSpans"]
    assert all(bool(r["record"]) == lines and r["file"].startswith("file:") for r in bad.collect())
    if not lines:
        strict = {r["file"][-6:]: r["ok"] for r in spans.otlp_check(spark, f"{tmp_path}/*.json").collect()}
        assert strict == {"0.json": True, "1.json": False, "2.json": False, "3.json": True, "4.json": True}
        assert {r["file"][-6:] for r in bad.where("position IS NULL").collect()} == {f for f, ok in strict.items() if not ok}


def test_contracts(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"info": {"title": "T"}, "services": {"a": {"spec": "./s.json"}}, "graph": {"nodes": [{"id": "x", "call": "a.b"}, {"id": "y", "call": "a.c", "depends": ["x"]}]}}))
    (tmp_path / "g.json").write_text(json.dumps({"info": {"title": "T"}, "flow": [{"step": "1", "call": "a.b", "output": {"v": "response.body"}}, {"step": "2", "parallel": [{"step": "p", "call": "a.b"}, {"step": "q", "call": "a.c"}]}]}))
    (tmp_path / "h.json").write_text(json.dumps({"info": {"title": "T"}}))
    t = contracts.read_flows(spark, f"{tmp_path}/[fgh].json")
    assert [(r["from_id"], r["to_id"]) for r in t["graph_edges"].collect()] == [("x", "y")]
    assert sorted((r["pos"], r["group_pos"], r["step"]) for r in t["flow_steps"].collect() if r["group_pos"] is not None) == [(1, 0, "p"), (1, 1, "q")]
    assert [tuple(r)[1:] for r in graph.flow_entry_counts(t["flow_steps"]).collect()] == [(2, "1,2")]
    assert t["service_bindings"].first()["spec"].endswith("/s.json")
    assert [r["message"] for r in t["issues"].collect()] == ["neither flow nor graph"]
    (tmp_path / "s.json").write_text(json.dumps({"service": "a", "operations": [{"operationId": "b", "preconditions": {"p": "x"}, "postconditions": {"q": "y"}}]}))
    assert sorted((r["kind"], r["condition"]) for r in contracts.read_services(spark, str(tmp_path / "s.json")).collect()) == [("post", "q"), ("pre", "p")]


def test_flow_files_validate_traces(spark, tmp_path):
    """Files of contracts against three traces: all is well; a wrong status is expected; steps are missing."""
    flow = lambda spec: {"info": {"title": "T"}, "services": {"order": {"spec": spec}, "stock": {"spec": "./stock.json"}}, "flow": [{"step": "1", "call": "order.create"}, {"step": "2", "call": "stock.reserve"}]}
    (tmp_path / "good.json").write_text(json.dumps(flow("./order.json")))
    (tmp_path / "strict.json").write_text(json.dumps(flow("./strict-order.json")))
    (tmp_path / "dag.json").write_text(json.dumps({"info": {"title": "D"}, "services": {"order": {"spec": "./order.json"}}, "graph": {"nodes": [{"id": "a", "call": "order.create"}, {"id": "b", "call": "stock.reserve", "depends": ["a"]}]}}))
    operation = lambda name, **post: {"service": name, "operations": [{"operationId": {"stock": "reserve"}.get(name, "create"), "postconditions": post}]}
    (tmp_path / "order.json").write_text(json.dumps(operation("order", created="response.status == 201", id="response.body.id != ''")))
    (tmp_path / "strict-order.json").write_text(json.dumps(operation("order", created="response.status == 418")))
    (tmp_path / "stock.json").write_text(json.dumps(operation("stock", items="size(response.body.items) > 0")))
    tables = contracts.contract_tables(contracts.read_flows(spark, f"{tmp_path}/{{good,strict,dag}}.json"), contracts.read_services(spark, f"{tmp_path}/*{{order,stock}}.json"))
    span = lambda t, service, name, start, body: (t, f"{t}{start}", None, service, name, start, start + 1, start, body)
    rows = [span("ok", "order", "create", 1, '{"id":"x"}'), span("ok", "stock", "reserve", 2, '{"items":[1]}'), span("half", "order", "create", 1, '{"id":""}')]
    found = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, service string, name string, start_ns long, end_ns long, ordinal long, body string")
    found = found.withColumn("attributes", F.create_map(F.lit("response.status"), F.lit(201).cast("variant"), F.lit("response.body"), F.parse_json("body")))
    flows = tables["steps"].select("flow_id").union(tables["nodes"].select("flow_id")).distinct()
    steps, results = validate.validate(found, tables, found.select("trace_id").distinct().crossJoin(flows))
    name = lambda r: (r["trace_id"], r["flow_id"].rpartition("/")[2][:-5])
    got = {}
    for r in steps.orderBy("pos").collect():
        got.setdefault(name(r), []).append((r["status"], r["found"]))
    yes, no, semantic = ("PASS", True), ("FAIL", False), ("FAIL", True)
    assert got == {("ok", "good"): [yes, yes], ("ok", "strict"): [semantic, yes], ("ok", "dag"): [yes, yes], ("half", "good"): [semantic, no], ("half", "strict"): [semantic, no], ("half", "dag"): [semantic, no]}
    assert sorted((*name(r), r["condition"], r["result"]) for r in results.where("trace_id = 'half'").collect()) == sorted([("half", "good", "created", "PASS"), ("half", "good", "id", "FAIL"), ("half", "dag", "created", "PASS"), ("half", "dag", "id", "FAIL"), ("half", "strict", "created", "FAIL")])


def test_sinks(spark, tmp_path):
    steps = spark.createDataFrame([("t", 0, "a<b", "x.y", "FAIL", "no & span"), ("t", 1, "c", "x.z", "PASS", "")], "trace_id string, pos int, step string, call string, status string, note string")
    results = spark.createDataFrame([("t", 1, "c", "post", "ok", "PASS")], "trace_id string, pos int, step string, kind string, condition string, result string")
    cover = gate.coverage(steps, results)
    sinks.json_report(steps, results, cover, gate.absolute(cover), f"{tmp_path}/r")
    r = spark.read.json(f"{tmp_path}/r").first()
    assert [s["step"] for s in r["steps"]] == ["a<b", "c"] and r["summary"]["steps_fail"] == 1 and not r["gate"]["passed"]
    sinks.junit_report(steps, f"{tmp_path}/x")
    back = spark.read.format("xml").option("rowTag", "testcase").load(f"{tmp_path}/x").orderBy("_name").collect()
    assert back[0]["_name"] == "a<b" and back[0]["failure"]["_message"] == "no & span"
    sinks.junit_report(steps, f"{tmp_path}/y", conditions=results, coverage=cover)
    back = spark.read.format("xml").option("rowTag", "testcase").load(f"{tmp_path}/y").orderBy("_name").collect()
    assert back[1]["system-out"] == "[PASS] post ok"
    more = spark.createDataFrame([("u", 0, "d", "x.z", "SKIP", "")], steps.schema)
    sinks.junit_report(steps.union(more), f"{tmp_path}/z", conditions=results, coverage=cover)
    suites = {r["_name"]: r for r in spark.read.format("xml").option("rowTag", "testsuite").load(f"{tmp_path}/z").collect()}
    assert {k: (r["_tests"], r["_failures"], r["_skipped"], r["_errors"]) for k, r in suites.items()} == {"t": (2, 1, 0, 0), "u": (1, 0, 1, 0)}
    assert {p["_name"]: p["_value"] for p in suites["t"]["properties"]["property"]}["steps_fail"] == 1
    assert [c["_name"] for c in suites["t"]["testcase"]] == ["a<b", "c"]
    base = gate.baseline_record(steps.where("status = 'PASS'"), results, "contract", 2)
    sinks.save_baseline(base, f"{tmp_path}/b")
    loaded = sinks.load_baseline(spark, f"{tmp_path}/b")
    assert loaded.first()["conditions"] == {"c": {"post:ok": True}} and loaded.first()["covered_steps"] == ["c"] and loaded.first()["flow_hash"].startswith("sha256:")
    now = spark.createDataFrame([("t", 1, 2, 0, 1)], "trace_id string, steps_pass long, steps_total long, conditions_pass long, conditions_evaluated long")
    r = gate.relative(now, gate.recorded(loaded), ["trace_id"], steps=0.5, conditions=0.5).first()
    assert (r["base_steps"], r["steps_delta"], r["base_conditions"], r["conditions_delta_pct"], r["passed"]) == (0.5, 0.0, 1.0, -1.0, False)
    assert sinks.load_baseline(spark, f"{tmp_path}/none", "treat-as-absolute") is None
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sinks.load_baseline(spark, f"{tmp_path}/none")
    sinks.discovered_contracts(steps, results.withColumn("service", F.lit("a b")), f"{tmp_path}/d")
    assert spark.read.json(f"{tmp_path}/d/services").first()["file"] == "a_b"
    sinks.masked_spans(spark.sql("select 't' trace_id, map('a', cast(1 as variant)) attributes"), f"{tmp_path}/m")
    assert json.loads(spark.read.json(f"{tmp_path}/m").first()["attributes"]) == {"a": 1}


def test_stream(spark, tmp_path):
    events = fx.event_spans(spark, "/root/testdata/sf0.001").withColumn("ts", (F.col("start_ns") / 1e9).cast("timestamp"))
    events.repartition(2).write.parquet(f"{tmp_path}/in")
    end = events.limit(1).withColumn("ts", F.lit("2030-01-01").cast("timestamp")).withColumn("trace_id", F.lit("end"))
    source = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    run = lambda: validate_stream(source, lambda s: match.time_sequence(s, fx.F1), f"{tmp_path}/out", f"{tmp_path}/check", gap="4 days").awaitTermination()
    run()
    end.write.mode("append").parquet(f"{tmp_path}/in")
    run()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.select("trace_id").distinct().count() >= 100 and out.where("status = 'PASS'").count() > 0


def feed(spark, tmp_path, rows, rules=(), steps=fx.F1, gap="5 minutes", late="10 minutes"):
    """Runs the stream over files added one after the other, restarting it from its checkpoint each time; the rows of each run."""
    schema = rows.schema
    (tmp_path / "in").mkdir(exist_ok=True)
    source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    out = match_stream(source, list(steps), list(rules), gap, late)

    def run(more):
        more.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(out.schema).parquet(f"{tmp_path}/out")

    return run


def test_stream_matching_is_batch_matching(spark, tmp_path):
    """State restored from a checkpoint, spans out of order, conditions over attributes; the same rows as the batch."""
    e = fx.with_attributes(fx.event_spans(spark, "/root/testdata/sf0.001")).withColumn("ts", (F.col("start_ns") / 1e9).cast("timestamp"))
    e = e.select("trace_id", "span_id", "start_ns", "end_ns", "ordinal", "service", "name", "attributes", "ts").where("hash(trace_id) % 3 = 0")
    run = feed(spark, tmp_path, e, fx.CONDITIONS, gap="4 days", late="40 days")
    bounds = [r[0] for r in e.agg(F.percentile_approx("start_ns", [0.4, 0.7]).alias("b")).select(F.explode("b")).collect()]
    run(e.where(F.col("start_ns") < bounds[0]).orderBy("span_id"))
    run(e.where((F.col("start_ns") >= bounds[0]) & (F.col("start_ns") < bounds[1])).orderBy(F.desc("start_ns")))
    run(e.where(F.col("start_ns") >= bounds[1]).orderBy("span_id"))
    end = lambda t: e.limit(1).withColumns({"ts": F.lit(t).cast("timestamp"), "trace_id": F.lit("end")})
    run(end("2040-01-01"))
    got = run(end("2041-01-01")).where("trace_id <> 'end'")
    want = conditions.with_results(match.time_sequence(e, fx.F1, ("attributes",)), fx.CONDITIONS, F.col("span_id").isNotNull())
    bad = conditions.failing(F.col("results"))
    want = want.select("trace_id", "pos", "span_id", F.when(bad, "FAIL").otherwise(F.col("status")).alias("status"), F.when(bad, match.SEMANTIC).otherwise(F.col("note")).alias("note"), F.col("results").alias("conditions"))
    rows = lambda df: sorted((tuple(r) for r in df.select("trace_id", "pos", "span_id", "status", "note", F.to_json("conditions")).collect()), key=str)
    assert rows(got) == rows(want) and got.where("status = 'PASS'").count() > 0


def test_stream_of_late_spans(spark, tmp_path):
    base = 1_700_000_000
    row = lambda t, k, service, at: (t, str(k), (base + at) * 10**9, (base + at) * 10**9 + 1, k, service, "evt", base + at)
    df = lambda rows: spark.createDataFrame(rows, "trace_id string, span_id string, start_ns long, end_ns long, ordinal long, service string, name string, t long").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    run = feed(spark, tmp_path, df([row("a", 1, "signup", 0)]), gap="5 minutes", late="10 minutes")
    run(df([row("a", 3, "purchase", 60), row("a", 1, "signup", 0), row("b", 9, "view", 0)]))
    run(df([row("a", 2, "view", 30)]))  # out of order, in time
    run(df([row("x", 0, "signup", 5000)]))
    run(df([row("a", 4, "purchase", 70), row("x", 1, "view", 5001)]))  # behind the watermark
    got = {(r["trace_id"], r["pos"]): (r["status"], r["span_id"]) for r in run(df([row("y", 0, "signup", 90_000)])).where("trace_id IN ('a', 'b')").collect()}
    assert got == {("a", 0): ("PASS", "1"), ("a", 1): ("PASS", "2"), ("a", 2): ("PASS", "3"), ("b", 0): ("FAIL", None), ("b", 1): ("PASS", "9"), ("b", 2): ("FAIL", None)}


def test_stream_state_is_a_row_a_shard(spark, tmp_path):
    """Traces of a shard begin, go on, end and begin anew on their own, though they share a row of state and a timeout."""
    base = 1_700_000_000
    row = lambda t, k, service, at: (t, str(k), (base + at) * 10**9, (base + at) * 10**9 + 1, k, service, "evt", base + at)
    df = lambda rows: spark.createDataFrame(rows, "trace_id string, span_id string, start_ns long, end_ns long, ordinal long, service string, name string, t long").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    batches = [
        [row(f"t{k}", k, "signup", k) for k in range(40)],
        [row(f"t{k}", 100 + k, "view", 700 + k) for k in range(0, 40, 2)],  # the others end first
        [row("far", 0, "click", 2000)],
        [row(f"t{k}", 200 + k, "purchase", 2000 + k) for k in range(0, 40, 4)],  # t2, t6, ... end; t4, ... begin anew
        [row("far", 1, "click", 9000)],
        [row("far", 2, "click", 90_000)],
        [row("far", 3, "click", 990_000)],
    ]
    found, states = {}, {}
    for shards in (2, 1000):
        at = f"{tmp_path}/{shards}"
        df([]).write.parquet(f"{at}/in")
        out = match_stream(spark.readStream.schema(df([]).schema).parquet(f"{at}/in"), fx.F1, shards=shards)
        for rows in batches:
            df(rows).coalesce(1).write.mode("append").parquet(f"{at}/in")
            q = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start()
            q.awaitTermination()
            states.setdefault(shards, []).append(max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]))
        got = spark.read.schema(out.schema).parquet(f"{at}/out").where("trace_id <> 'far'")
        found[shards] = sorted((tuple(r) for r in got.select("trace_id", "pos", "status", "span_id", "note").collect()), key=str)
    assert found[2] == found[1000] and len(found[2]) >= 3 * 40 and sum(r[2] == "PASS" for r in found[2]) == 40 + 20 + 10
    assert max(states[2]) <= 2 < max(states[1000])


def test_stream_state_is_bounded_by_the_contract():
    """Any order of calls: what is taken one by one is what a search of the whole trace takes, and a span a step is kept."""
    r = random.Random(2)
    for _ in range(300):
        steps, trace = [r.choice("abc") for _ in range(r.randint(1, 5))], [r.choice("abcd") for _ in range(r.randint(0, 12))]
        state = {"n": 0, "steps": {}}
        for i, call in enumerate(trace):
            taken(state, str(i + 1), [k for k, s in enumerate(steps) if s == call], None)
            assert len(state["steps"]) <= len(steps)
        at, want = 0, {}
        for k, s in enumerate(steps):
            hit = next((i + 1 for i in range(at, len(trace)) if trace[i] == s), None)
            if hit:
                want[str(k)], at = (hit, at), hit
        assert {k: tuple(v[:2]) for k, v in state["steps"].items()} == want


def test_entry():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) >= set(QUERIES)
