"""Draft contracts from observed spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanflow.functions.scalars import field_name, identifier, lower_first, operation_id, pascalize, string_attr
from spanflow.operators import lint

#: Parts of attribute keys that tell requests and responses.
REQUEST = ["request.", "http.method", "http.url", "http.route", "http.target"]
RESPONSE = ["response.", "http.status_code"]


def _any(key: Column, parts: list[str]) -> Column:
    out = key.contains(parts[0])
    for p in parts[1:]:
        out = out | key.contains(p)
    return out


def named(spans: DataFrame) -> DataFrame:
    """Spans with a service and a name, and ``operation`` where it is not there yet: from HTTP or RPC attributes if spans have ``attributes``, else from the name."""
    s = spans.where("coalesce(service, '') <> '' AND coalesce(name, '') <> ''")
    if "operation" in s.columns:
        return s
    if "attributes" not in s.columns:
        return s.withColumn("operation", lower_first(pascalize(F.col("name"))))
    text = [string_attr(F.col("attributes"), k) for k in ("http.method", "http.route", "http.target", "http.url", "rpc.method")]
    return s.withColumn("operation", operation_id(F.col("name"), *text))


def services(spans: DataFrame) -> DataFrame:
    """Distinct services of each trace: trace_id, service."""
    return spans.where("coalesce(service, '') <> ''").select("trace_id", "service").distinct()


def operations(spans: DataFrame) -> DataFrame:
    """Distinct operations: service, operation, spans."""
    return named(spans).groupBy("service", "operation").agg(F.count(F.lit(1)).alias("spans"))


def flow_steps(spans: DataFrame) -> DataFrame:
    """A linear flow per trace: trace_id, pos, step, call, output. Positions count all spans by start, unnamed ones
    too, but these give no step."""
    w = Window.partitionBy("trace_id").orderBy("start_ns", "ordinal")
    s = named(spans.select("trace_id", "start_ns", "ordinal", "service", "name", *[c for c in ("operation", "attributes") if c in spans.columns]).withColumn("pos", F.row_number().over(w)))
    return s.select("trace_id", "pos", F.concat(F.lit("Step"), F.col("pos").cast("string"), F.lit("-"), F.col("name")).alias("step"), F.concat_ws(".", "service", "operation").alias("call"), F.concat(F.lower("service"), F.lit("Response")).alias("output"))


def conditions(attributes: DataFrame) -> DataFrame:
    """One predicate per condition name and operation: service, operation, kind, condition, path, op, literal.

    ``attributes``: service, operation, start_ns, key, value (text), is_number, is_string. Of several values of one
    name the latest start wins, then the greatest key and predicate."""
    key, value = F.lower("key"), F.col("value")
    text = F.col("is_string") & (value != "")
    status = F.col("is_number") & key.contains("status")
    bearer = F.col("is_string") & key.contains("authorization") & F.lower(value).contains("bearer")
    row = lambda path, op, lit: F.struct(path.alias("path"), F.lit(op).alias("op"), lit.alias("literal"))
    field, none = field_name(F.col("key")), F.lit("")
    made = (
        F.when(text & (key == "http.method"), row(F.lit("http.method"), "eq", value))
        .when(text & key.isin("http.route", "http.target"), row(F.lit("http.route"), "eq", value))
        .when(status, row(F.lit("response.status"), "eq", F.col("value").cast("double").cast("bigint").cast("string")))
        .when(bearer, row(F.lit("request.headers.authorization"), "matches", F.lit("Bearer .+")))
        .when(text & (key.contains("request") | key.contains("body")), row(F.concat(F.lit("request.body."), field), "ne", none))
        .when(text & key.contains("response"), row(F.concat(F.lit("response.body."), field), "ne", none))
    )
    kind = F.when(_any(key, REQUEST), "pre").when(_any(key, RESPONSE), "post")
    name = F.concat(F.when(kind == "pre", "req_").otherwise("resp_"), identifier(field))
    a = attributes.select("service", "operation", "start_ns", "key", kind.alias("kind"), name.alias("condition"), made.alias("p")).where("kind IS NOT NULL AND p IS NOT NULL")
    best = a.groupBy("service", "operation", "kind", "condition").agg(F.max(F.struct("start_ns", "key", "p")).alias("m"))
    return best.select("service", "operation", "kind", "condition", "m.p.path", "m.p.op", "m.p.literal")


def lint_gate(steps: DataFrame, declared: DataFrame, known: DataFrame) -> DataFrame:
    """Which discovered flows pass the checks of linear flows: trace_id, steps, errors, passed.

    ``steps`` of :func:`flow_steps`; ``declared`` are the services drafted for a trace (:func:`services`), ``known`` the operations drafted (:func:`operations`).
    A draft fails, for one, where a service has a dot in its name, as its calls then name another service."""
    flow = steps.select(F.col("trace_id").alias("flow_id"), F.col("step").alias("node"), "call")
    declared = declared.withColumnRenamed("trace_id", "flow_id")
    found = [lint.call_format(flow), lint.undeclared_service(flow, declared), lint.missing_operation(flow, declared, known.select("service", "operation")), lint.duplicates(flow.select("flow_id", F.col("node").alias("name")))]
    bad = found[0].select("flow_id")
    for more in found[1:]:
        bad = bad.unionByName(more.select("flow_id"))
    bad = bad.groupBy(F.col("flow_id").alias("trace_id")).agg(F.count(F.lit(1)).alias("errors"))
    errors = F.coalesce("errors", F.lit(0))
    return steps.groupBy("trace_id").agg(F.count(F.lit(1)).alias("steps")).join(bad, "trace_id", "left").select("trace_id", "steps", errors.alias("errors"), (errors == 0).alias("passed"))
