"""Queries that write files of the driver's tables and read them again: span files, OTLP, contracts, baselines, reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanflow.functions import scalars
from spanflow.operators import gate, lint, mask
from spanflow.operators.steps import shared_dir
from spanflow.plans import fixtures as fx
from spanflow.sources import contracts, sinks, spans
from spanflow.streaming.matching import match_stream

Query = Callable[[SparkSession, str], DataFrame]
Run = Callable[[SparkSession, str], tuple[DataFrame, DataFrame]]


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/spanflow-files-{uuid.uuid4().hex}"


def _text(attribute: str) -> Column:
    return F.try_variant_get(F.try_element_at("attributes", F.lit(attribute)), "$", "string")


def _part(file: str) -> Column:
    """The number of the folder that a file is in."""
    return F.regexp_extract(file, r"part=(\d+)", 1).cast("int")


def _objects(rows: DataFrame, path: str) -> str:
    """One JSON object a file: ``rows`` has part and value."""
    rows.write.partitionBy("part").text(path)
    return f"{path}/*/*.txt"


def span_files_read(spark: SparkSession, d: str) -> DataFrame:
    """Spans as files of {"spans": [...]}; a third of them name their id as text, a third as a number, which is no id."""
    own = [F.when(F.col("k") % 3 == 0, F.col("span_id")).alias("otlp.span_id"), F.col("parent_span_id").alias("otlp.parent_span_id")]
    number = [F.when(F.col("k") % 3 == 1, F.col("ordinal")).alias("otlp.span_id"), F.col("k").alias("k")]
    row = lambda attributes: F.struct("start_ns", "ordinal", F.to_json(F.struct("name", "service", F.col("start_ns").alias("startNanos"), F.when(F.col("k") < 90, F.col("end_ns")).alias("endNanos"), F.struct(*attributes).alias("attributes"))).alias("json"))
    e = fx.event_spans(spark, d).select((F.col("ordinal") % 8).alias("part"), F.when(F.col("k") % 3 == 1, row(number)).otherwise(row([*own, F.col("k").alias("k")])).alias("r"))
    whole = e.groupBy("part").agg(F.array_sort(F.collect_list("r")).alias("rs"))  # a file of the fixture
    value = F.concat(F.lit('{"spans":['), F.array_join(F.transform("rs", lambda r: r["json"]), ","), F.lit("]}"))
    s = spans.read_spans(spark, _objects(whole.select("part", value.alias("value")), _folder(spark)))
    return s.select(_part("trace_id").alias("part"), "ordinal", "span_id", "parent_span_id", "name", "service", "start_ns", "end_ns", _text("k").alias("k"))


def _otlp(spark: SparkSession, d: str) -> DataFrame:
    """An OTLP object for each trace of events: trace_id, part, value. Some times are no numbers."""
    value = lambda kind, c: F.struct(c.cast("string").alias(kind) if kind != "boolValue" else c.alias(kind))
    pair = lambda key, v: F.struct(F.lit(key).alias("key"), F.to_json(v).alias("v"))
    k = F.col("k")
    attributes = F.array_compact(F.array(
        pair("n", value("intValue", k)), pair("n", value("doubleValue", k / 4)), pair("flag", value("boolValue", k % 2 == 0)), pair("empty", value("stringValue", F.lit(""))),
        F.when(k % 4 == 0, pair("service.name", value("stringValue", F.concat(F.lit("own-"), "service")))), F.when(k % 5 == 0, pair("http.status_code", value("intValue", F.lit("4xx")))),
    ))
    listed = lambda pairs: F.concat(F.lit("["), F.array_join(F.transform(pairs, lambda p: F.concat(F.lit('{"key":"'), p["key"], F.lit('","value":'), p["v"], F.lit("}"))), ","), F.lit("]"))
    start = F.when(k % 25 == 3, "soon").otherwise(F.col("start_ns").cast("string"))
    body = F.to_json(F.struct(F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_span_id").alias("parentSpanId"), F.concat(F.when(k % 2 == 0, "create ").otherwise("get "), "service").alias("name"), start.alias("startTimeUnixNano"), F.when(k != 7, F.col("end_ns").cast("string")).alias("endTimeUnixNano"), F.struct((k % 3).alias("code")).alias("status")))
    span = F.concat(F.expr("left(_body, length(_body) - 1)"), F.lit(',"attributes":'), F.col("_attributes"), F.lit("}"))
    e = fx.event_spans(spark, d).withColumns({"_body": body, "_attributes": listed(attributes)}).select("trace_id", "start_ns", "ordinal", span.alias("json"))
    whole = e.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("start_ns", "ordinal", "json"))).alias("rs"), (F.min("ordinal") % 6).alias("part"))
    resource = F.when(F.col("part") < 4, F.lit('"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"shop"}}]},')).otherwise("")
    text = F.concat(F.lit('{"resourceSpans":[{'), resource, F.lit('"scopeSpans":[{"spans":['), F.array_join(F.transform("rs", lambda r: r["json"]), ","), F.lit("]}]}]}"))
    return whole.select("trace_id", "part", text.alias("value"))


def _otlp_lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Read line by line; the lines of part 5 are cut off."""
    path = _folder(spark)
    cut = F.when(F.col("part") == 5, F.substring("value", 1, 40)).otherwise(F.col("value"))
    _otlp(spark, d).select(cut.alias("value")).write.text(path)
    return spans.read_otlp_lenient(spark, path, lines=True)


def otlp_spans_read(spark: SparkSession, d: str) -> DataFrame:
    s = _otlp_lines(spark, d)[0]
    return s.select("trace_id", "ordinal", "span_id", "parent_span_id", "name", "service", "start_ns", "end_ns", *[_text(a).alias(b) for a, b in (("n", "n"), ("flag", "flag"), ("empty", "empty"), ("response.status", "status"), ("otlp.span_id", "own_id"))])


def otlp_spans_rejected(spark: SparkSession, d: str) -> DataFrame:
    return _otlp_lines(spark, d)[1].groupBy("reason", F.split("position", r"\.")[2].cast("int").alias("place")).agg(F.count(F.lit(1)).alias("rejects"))


def otlp_file_checks(spark: SparkSession, d: str) -> DataFrame:
    """A file for each part, of the parts' first trace; one has no resources."""
    first = _otlp(spark, d).groupBy("part").agg(F.min_by("value", "trace_id").alias("value"))
    path = _objects(first.select("part", F.when(F.col("part") == 2, '{"resourceSpans":[]}').otherwise(F.col("value")).alias("value")), _folder(spark))
    return spans.otlp_stats(spark, path).join(spans.otlp_check(spark, path), "file").select(_part("file").alias("part"), "resource_spans", "total_spans", "ok", "reason")


def contract_files_read(spark: SparkSession, d: str) -> DataFrame:
    """A graph contract for each nation: its suppliers in order, each after the one before; nodes with their calls and predecessors."""
    s = fx.table(spark, d, "supplier").select(F.col("s_nationkey").alias("part"), F.col("s_suppkey").alias("k"), F.concat(F.lit("shop.op"), (F.col("s_suppkey") % 5).cast("string")).alias("call"))
    name = lambda k: F.concat(F.lit("n"), k.cast("string"))
    whole = s.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("k", "call"))).alias("r"))
    node = lambda x, i: F.struct(name(x["k"]).alias("id"), x["call"].alias("call"), F.when(i > 0, F.array(name(F.get("r", i - 1)["k"]))).alias("depends"))
    value = F.to_json(F.struct(F.struct(F.concat(F.lit("Nation "), F.col("part").cast("string")).alias("title")).alias("info"), F.create_map(F.lit("shop"), F.struct(F.lit("./shop.json").alias("spec"))).alias("services"), F.struct(F.transform("r", node).alias("nodes")).alias("graph")))
    t = contracts.read_flows(spark, _objects(whole.select("part", value.alias("value")), _folder(spark)))
    e = t["graph_edges"].select("flow_id", F.col("to_id").alias("node"), "from_id")
    return t["graph_nodes"].join(e, ["flow_id", "node"], "left").select(_part("flow_id").alias("part"), "n", "node", "call", "from_id")


def sanitized_names(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat_ws(" / ", "p_type", "p_name", "p_brand")
    return fx.table(spark, d, "part").select("p_partkey", scalars.service_file_name(raw).alias("file"), scalars.identifier(raw).alias("identifier"), scalars.sanitized_operation(raw).alias("operation"))


def masked_spans_read(spark: SparkSession, d: str) -> DataFrame:
    """Spans with attributes masked by a policy, written and read."""
    policy = {"version": 1, "globals": {"strategies": {"who": {"type": "hash", "salt": "s"}}}, "rules": [{"match": {"service": "signup", "paths": ["user.id"]}, "strategy": "who"}, {"match": {"regexKeys": ["id$"]}, "strategy": {"type": "keep-prefix", "prefixLen": 1, "mask": "x"}}, {"match": {"paths": ["k"]}, "strategy": {"type": "redact"}}]}
    a = F.create_map(F.lit("user.id"), F.concat(F.lit("u"), "span_id").cast("variant"), F.lit("k"), F.col("k").cast("variant"), F.lit("n"), F.col("k").cast("variant"))
    path = _folder(spark)
    sinks.masked_spans(mask.apply_to_spans(fx.event_spans(spark, d).withColumn("attributes", a), policy).select("span_id", "service", "attributes"), path)
    got = F.from_json("attributes", "map<string,string>")
    return spark.read.schema("span_id string, service string, attributes string").json(path).select("span_id", "service", got["user.id"].alias("who"), got["k"].alias("k"), got["n"].alias("n"))


def stream_matching(spark: SparkSession, d: str) -> DataFrame:
    """Traces matched as a stream in two runs from one checkpoint, and a third that closes them; the rows of :func:`time_sequence_steps`."""
    path = _folder(spark)
    e = fx.events_as_spans(spark, d).select("trace_id", "span_id", "start_ns", "end_ns", "ordinal", "service", "name", F.timestamp_micros(F.expr("start_ns div 1000")).alias("ts"))
    e.limit(0).write.parquet(f"{path}/in")
    found = match_stream(spark.readStream.schema(e.schema).parquet(f"{path}/in"), fx.F1, gap="4 days", late="60 days")
    last = lambda year: e.limit(1).withColumns({"trace_id": F.lit("closing"), "ts": F.lit(f"{year}-01-01").cast("timestamp")})
    for more in (e.where("ordinal % 3 = 0"), e.where("ordinal % 3 > 0"), last(2040), last(2041)):
        more.write.mode("append").parquet(f"{path}/in")
        found.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{path}/out").where("trace_id <> 'closing'").select("trace_id", "pos", "step", "status", "span_id", "note")


def of_runs(run: Run, steps_text: str, steps_n: int, baseline: Callable[[DataFrame], DataFrame]) -> dict[str, Query]:
    """Queries over a run's steps and conditions (``run``)."""

    def baseline_files_read(spark: SparkSession, d: str) -> DataFrame:
        path = _folder(spark)
        sinks.save_baseline(gate.baseline_record(*run(spark, d), steps_text, steps_n), path)
        return baseline(sinks.load_baseline(spark, path))

    def json_report_read(spark: SparkSession, d: str) -> DataFrame:
        steps, results = run(spark, d)
        cover, path = gate.coverage(steps, results), _folder(spark)
        sinks.json_report(steps, results, cover, gate.absolute(cover), path)
        schema = "trace_id string, summary struct<steps_pass:bigint>, gate struct<passed:boolean>, steps array<struct<step:string,status:string,conditions:array<struct<result:string>>>>"
        r = spark.read.schema(schema).json(path)
        s = r.select("trace_id", F.col("summary.steps_pass").alias("steps_pass"), F.col("gate.passed").alias("passed"), F.explode("steps").alias("s"))
        return s.select("trace_id", "steps_pass", "passed", "s.step", "s.status", F.coalesce(F.size("s.conditions"), F.lit(0)).alias("conditions"))

    def junit_report_read(spark: SparkSession, d: str) -> DataFrame:
        steps, results = run(spark, d)
        path = _folder(spark)
        sinks.junit_report(steps, path, conditions=results, coverage=gate.coverage(steps, results))
        schema = "_name string, _tests long, _failures long, _skipped long, testcase array<struct<_name:string,failure:struct<_message:string,_VALUE:string>,`system-out`:string>>"
        s = spark.read.format("xml").option("rowTag", "testsuite").schema(schema).load(path).select("_name", "_tests", "_failures", F.explode("testcase").alias("c"))
        return s.select(F.col("_name").alias("trace_id"), F.col("_tests").alias("tests"), F.col("_failures").alias("failures"), F.col("c._name").alias("step"), F.col("c.failure").isNotNull().alias("failed"), F.col("c.failure._VALUE").alias("call"))

    def trace_verdict_linted(spark: SparkSession, d: str) -> DataFrame:
        """:func:`trace_verdict` where the contract of the user of the trace, by the order of that number, has lint errors."""
        steps, results = run(spark, d)
        named = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
        edges = fx.catalog_edges(spark, d).select("flow_id", named("a").alias("from_id"), named("b").alias("to_id"))
        errors = lint.dangling_edges(edges, fx.catalog_nodes(spark, d)).groupBy("flow_id").agg(F.count(F.lit(1)).alias("errors"))
        traces = steps.select("trace_id").distinct().withColumn("flow_id", F.split("trace_id", "-")[0].cast("bigint"))
        ok = steps.groupBy("trace_id").agg(F.bool_and("found").alias("ok"))
        return gate.verdict(ok, gate.absolute(gate.coverage(steps, results), 0.6, 0.5), traces.join(errors, "flow_id").select("trace_id", "errors"))

    return {f.__name__: f for f in (baseline_files_read, json_report_read, junit_report_read, trace_verdict_linted)}


QUERIES: dict[str, Query] = {f.__name__: f for f in (span_files_read, otlp_spans_read, otlp_spans_rejected, otlp_file_checks, contract_files_read, sanitized_names, masked_spans_read, stream_matching)}
