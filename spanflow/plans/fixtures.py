"""Span, contract and attribute tables derived from the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanflow.operators.steps import dealt

#: Linear contracts: (pos, group, step, call); steps with a group run in parallel.
F1 = [(0, None, "s1", "signup.evt"), (1, None, "s2", "view.evt"), (2, None, "s3", "purchase.evt")]
F2 = [(0, None, "p1", "signup.evt"), (1, "par", "p2", "view.evt"), (2, "par", "p3", "click.evt"), (3, None, "p4", "purchase.evt")]
STEPS = "pos int, grp string, step string, call string"
#: A DAG: (declaration position, node, call, predecessors).
G1 = [(0, "n1", "signup.evt", []), (1, "n2", "view.evt", ["n1"]), (2, "n3", "click.evt", ["n1"]), (3, "n4", "purchase.evt", ["n2", "n3"]), (4, "n5", "view.evt", ["n4"])]
#: Conditions of every operation: (kind, name, path, op, literal).
CONDITIONS = [("post", "ghost", "response.body.missing", "ne", ""), ("post", "hasK", "response.body.k", "has", None), ("post", "smallK", "response.body.k", "lt", 50), ("post", "statusOk", "response.status", "eq", 200)]
SERVICES = ["click", "error", "purchase", "signup", "view"]
#: The three contracts as tables, with conditions of their operations as text: (flow, service, kind, condition, expression).
FLOWS = {"linear": F1, "parallel": F2, "graph": G1}
RULES = [
    (flow, *rule)
    for flow in FLOWS
    for rule in [
        ("signup", "post", "statusOk", "response.status == 200"), ("view", "post", "hasK", "has(response.body.k)"), ("view", "post", "smallK", "response.body.k < 50"),
        ("purchase", "pre", "ghost", "input.items != ''"), ("purchase", "post", "statusOk", "response.status == 200"), ("purchase", "post", "typed", "response.body.k != '5'"),
    ]
] + [
    ("graph", "click", "post", "pattern", "response.body.k =~ /^5/"), ("graph", "click", "post", "sized", "size(response.body.k) > 0"), ("linear", "view", "post", "broken", "span.service =~ /[/"),
    ("linear", "view", "post", "decided", "span.service =~ /[/ || response.body.k >= 0"), ("parallel", "view", "post", "both", "response.body.k < 70 && !(response.status == 200)"),
    ("parallel", "click", "post", "either", "(response.body.k < 10 || response.status == 404) && has(response.body.k)"), ("graph", "click", "post", "named", "span.service =~ /^cl.ck$/ && !has(response.body.gone)"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_as_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span for each event: trace_id, span_id, ordinal, service, name, start_ns, end_ns, k."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.floor((us / 1000000 - 1704067200) / 259200).cast("bigint").cast("string")).alias("trace_id"),
        F.col("event_id").cast("string").alias("span_id"),
        F.col("event_id").alias("ordinal"),
        F.col("event_type").alias("service"),
        F.lit("evt").alias("name"),
        (us * 1000).alias("start_ns"),
        (us * 1000 + F.round(F.col("value") * 100).cast("bigint") * 6000000000).alias("end_ns"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of events, partitioned by trace: those of :func:`events_as_spans`, status, parent_span_id."""
    e = dealt(events_as_spans(spark, sf_dir), "trace_id", table(spark, sf_dir, "events").count())
    before = Window.partitionBy("trace_id").orderBy("start_ns").rowsBetween(Window.unboundedPreceding, -1)
    status = F.when(F.col("k") % 10 == 0, None).when(F.col("k") < 80, 200).when(F.col("k") < 95, 404).otherwise(500)
    return e.withColumn("status", status).withColumn("parent_span_id", F.last(F.when(F.col("service") == "signup", F.col("span_id")), ignorenulls=True).over(before))


EVENT_SPANS = """
E0 AS (SELECT user_id || '-' || CAST(floor((epoch_us(ts) / 1000000 - 1704067200) / 259200) AS BIGINT) trace_id, CAST(event_id AS VARCHAR) span_id, event_id ordinal,
              event_type service, 'evt' AS name, epoch_us(ts) * 1000 start_ns, epoch_us(ts) * 1000 + CAST(round(value * 100) AS BIGINT) * 6000000000 end_ns,
              CAST(json_extract_string(props, '$.k') AS INT) k FROM events),
E AS (SELECT *, CASE WHEN k % 10 = 0 THEN NULL WHEN k < 80 THEN 200 WHEN k < 95 THEN 404 ELSE 500 END status,
             last_value(CASE WHEN service = 'signup' THEN span_id END IGNORE NULLS)
               OVER (PARTITION BY trace_id ORDER BY start_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) parent_span_id FROM E0)"""


def cyclic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event spans where the first span of each trace whose user is a multiple of 10 points to its last span."""
    w = Window.partitionBy("trace_id").orderBy("start_ns")
    last = F.last("span_id").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    e = event_spans(spark, sf_dir).withColumn("rn", F.row_number().over(w)).withColumn("last_id", last)
    turned = (F.split("trace_id", "-")[0].cast("bigint") % 10 == 0) & (F.col("rn") == 1) & (F.col("last_id") != F.col("span_id"))
    return e.withColumn("parent_span_id", F.when(turned, F.col("last_id")).otherwise(F.col("parent_span_id"))).drop("rn", "last_id")


CYCLIC_SPANS = (
    EVENT_SPANS
    + """,
EC0 AS (SELECT *, row_number() OVER w rn, last_value(span_id) OVER (PARTITION BY trace_id ORDER BY start_ns ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) last_id
        FROM E WINDOW w AS (PARTITION BY trace_id ORDER BY start_ns)),
EC AS (SELECT * EXCLUDE (parent_span_id, rn, last_id), CASE WHEN CAST(split_part(trace_id, '-', 1) AS BIGINT) % 10 = 0 AND rn = 1 AND last_id <> span_id THEN last_id ELSE parent_span_id END parent_span_id FROM EC0)"""
)


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("trace_id"), F.col("o_orderkey").cast("string").alias("span_id"), F.col("o_orderkey").alias("ordinal"),
        F.col("o_orderpriority").alias("service"), F.col("o_orderstatus").alias("name"), start.alias("start_ns"),
        (start + F.round("o_totalprice").cast("bigint") * 1000000000).alias("end_ns"), F.lit(None).cast("string").alias("parent_span_id"),
    )


ORDER_SPANS = """
O AS (SELECT CAST(o_custkey AS VARCHAR) trace_id, CAST(o_orderkey AS VARCHAR) span_id, o_orderkey ordinal, o_orderpriority service, o_orderstatus AS name,
             epoch_us(o_orderdate) * 1000 start_ns, epoch_us(o_orderdate) * 1000 + CAST(round(o_totalprice) AS BIGINT) * 1000000000 end_ns, CAST(NULL AS VARCHAR) parent_span_id FROM orders)"""


def hot_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order spans, a third of them in one trace."""
    return order_spans(spark, sf_dir).withColumn("trace_id", F.when(F.col("ordinal") % 3 == 0, "hot").otherwise(F.col("trace_id")))


HOT_SPANS = (
    ORDER_SPANS
    + """,
E AS (SELECT * EXCLUDE (trace_id), CASE WHEN ordinal % 3 = 0 THEN 'hot' ELSE trace_id END trace_id FROM O)"""
)


def with_attributes(spans: DataFrame) -> DataFrame:
    """Adds ``attributes`` (map of VARIANT) to event spans: response.status where known, and response.body."""
    status = F.when(F.col("status").isNotNull(), F.create_map(F.lit("response.status"), F.col("status").cast("int").cast("variant")))
    body = F.create_map(F.lit("response.body"), F.parse_json(F.concat(F.lit('{"k":'), F.col("k").cast("string"), F.lit("}"))))
    return spans.withColumn("attributes", F.when(F.col("status").isNotNull(), F.map_concat(status, body)).otherwise(body))


def steps(spark: SparkSession, flow: list = F1) -> DataFrame:
    return spark.createDataFrame(flow, STEPS)


def contracts(spark: SparkSession) -> dict[str, DataFrame]:
    """Tables of the contracts in FLOWS, as :func:`spanflow.operators.validate.validate` takes them."""
    rows, at = [], {}
    for flow in ("linear", "parallel"):
        for _, group, step, call in FLOWS[flow]:
            key = (flow, group or step)
            at.setdefault(key, len([k for k in at if k[0] == flow]))
            rows.append((flow, at[key], sum(r[0] == flow and r[1] == at[key] for r in rows) if group else None, step, call))
    return {
        "steps": spark.createDataFrame(rows, "flow_id string, pos int, group_pos int, step string, call string"),
        "nodes": spark.createDataFrame([("graph", n, node, call) for n, node, call, _ in G1], "flow_id string, n int, node string, call string"),
        "edges": spark.createDataFrame([("graph", p, node) for _, node, _, preds in G1 for p in preds], "flow_id string, from_id string, to_id string"),
        "conditions": spark.createDataFrame([(f, s, "evt", *rest) for f, s, *rest in RULES], "flow_id string, service string, operation string, kind string, condition string, expression string"),
    }


def _lines(spark: SparkSession, sf_dir: str, *columns: Column) -> DataFrame:
    """Rows (flow_id, columns) of lineitem, partitioned by contract."""
    li = table(spark, sf_dir, "lineitem")
    return dealt(li.select(F.col("l_orderkey").cast("bigint").alias("flow_id"), *columns), "flow_id", li.count())


def catalog_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contract per order, partitioned by it: flow_id, n, node, call."""
    d = _lines(spark, sf_dir, F.col("l_linenumber").cast("bigint").alias("n")).distinct()
    text = F.col("n").cast("string")
    return d.select("flow_id", "n", F.concat(F.lit("n"), text).alias("node"), F.concat(F.lit("svc"), (F.col("n") % 3).cast("string"), F.lit(".op"), text).alias("call"))


def catalog_edges(spark: SparkSession, sf_dir: str, acyclic: bool = False) -> DataFrame:
    """Edges (flow_id, a, b) between node numbers, partitioned by contract, with dangling targets and cycles, or without."""
    e = _lines(spark, sf_dir, F.col("l_linenumber").cast("bigint").alias("a"), (F.col("l_partkey") % 7 + 1).cast("bigint").alias("b"))
    e = e.where("a <> b").distinct()
    if acyclic:
        nodes = catalog_nodes(spark, sf_dir).select("flow_id", F.col("n").alias("b"))
        e = e.where("a < b").join(nodes, ["flow_id", "b"], "left_semi").select("flow_id", "a", "b")
    return e


CATALOG = """
N AS (SELECT DISTINCT CAST(l_orderkey AS BIGINT) flow_id, CAST(l_linenumber AS BIGINT) n, 'n' || l_linenumber node, 'svc' || (l_linenumber % 3) || '.op' || l_linenumber AS call FROM lineitem),
X AS (SELECT DISTINCT CAST(l_orderkey AS BIGINT) flow_id, CAST(l_linenumber AS BIGINT) a, CAST(l_partkey % 7 + 1 AS BIGINT) b FROM lineitem WHERE l_linenumber <> l_partkey % 7 + 1),
XI AS (SELECT X.* FROM X JOIN N ON X.flow_id = N.flow_id AND X.b = N.n),
XA AS (SELECT * FROM XI WHERE a < b)"""


def customer_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes in long form: service, operation, ordinal, key, value; numbers are not strings."""
    c = table(spark, sf_dir, "customer")
    pairs = F.array(
        F.struct(F.lit("customerEmail").alias("key"), F.concat(F.lower("c_mktsegment"), F.lit("@example.com")).alias("value"), F.lit(True).alias("is_string")),
        F.struct(F.lit("customerPhone").alias("key"), F.concat(F.lit("555-"), F.col("c_custkey").cast("string")).alias("value"), F.lit(True).alias("is_string")),
        F.struct(F.lit("customerId").alias("key"), F.col("c_name").alias("value"), F.lit(True).alias("is_string")),
        F.struct(F.lit("segment").alias("key"), F.col("c_mktsegment").alias("value"), F.lit(True).alias("is_string")),
        F.struct(F.lit("balance").alias("key"), F.col("c_nationkey").cast("string").alias("value"), F.lit(False).alias("is_string")),
    )
    return c.select(F.lit("crm").alias("service"), F.lit("getCustomer").alias("operation"), F.col("c_custkey").alias("ordinal"), F.inline(pairs))


CUSTOMER_ATTRIBUTES = """
A AS (SELECT 'crm' service, 'getCustomer' operation, c_custkey ordinal, u.key AS key, u.value AS value, u.key <> 'balance' AS is_string
      FROM customer, unnest([{'key': 'customerEmail', 'value': lower(c_mktsegment) || '@example.com'}, {'key': 'customerPhone', 'value': '555-' || c_custkey},
                            {'key': 'customerId', 'value': c_name}, {'key': 'segment', 'value': c_mktsegment}, {'key': 'balance', 'value': CAST(c_nationkey AS VARCHAR)}]) AS t(u))"""
