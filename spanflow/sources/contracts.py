"""Contracts as JSON: a flow (linear or graph) with its service specs, read into tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_STEP = "step:string,call:string,input:variant,output:map<string,string>"
FLOW = (
    "info struct<title:string,description:string,version:string>, services map<string,struct<spec:string>>, "
    f"flow array<struct<{_STEP},parallel:array<struct<{_STEP}>>>>, "
    "graph struct<nodes:array<struct<id:string,call:string,depends:array<string>,input:variant,output:map<string,string>>>,edges:array<struct<`from`:string,`to`:string>>>"
)
SERVICE = "service string, operations array<struct<operationId:string,description:string,preconditions:map<string,string>,postconditions:map<string,string>>>"


def read_flows(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """flow_steps, graph_nodes, graph_edges, service_bindings and issues, keyed by flow_id (the file). A file with both or neither of flow and
    graph is an issue; edges are those given, or else those of ``depends``. Paths of service specs count from the flow's folder."""
    raw = spark.read.schema(FLOW).json(path, multiLine=True).withColumn("flow_id", F.col("_metadata.file_path"))
    plain, parts = F.coalesce(F.size("flow"), F.lit(-1)) > 0, F.coalesce(F.size("graph.nodes"), F.lit(-1)) > 0
    folder = F.regexp_replace("flow_id", "[^/]*$", "")
    steps = raw.select("flow_id", F.posexplode("flow").alias("pos", "s"))
    single = F.coalesce(F.size("s.parallel"), F.lit(-1)) <= 0
    one = steps.where(single).select("flow_id", "pos", F.lit(None).cast("int").alias("group_pos"), F.col("s.step").alias("entry"), "s.step", "s.call", "s.input", "s.output")
    many = steps.where(~single).select("flow_id", "pos", F.col("s.step").alias("entry"), F.posexplode("s.parallel").alias("group_pos", "p")).select("flow_id", "pos", "group_pos", "entry", "p.step", "p.call", "p.input", "p.output")
    nodes = raw.select("flow_id", F.posexplode("graph.nodes").alias("n", "g"))
    given = raw.where(F.coalesce(F.size("graph.edges"), F.lit(-1)) > 0).select("flow_id", F.explode("graph.edges").alias("e")).select("flow_id", F.col("e.from").alias("from_id"), F.col("e.to").alias("to_id"))
    depends = raw.where(F.coalesce(F.size("graph.edges"), F.lit(-1)) <= 0).select("flow_id", F.explode("graph.nodes").alias("g")).select("flow_id", F.explode("g.depends").alias("from_id"), F.col("g.id").alias("to_id"))
    services = raw.select("flow_id", folder.alias("folder"), F.explode("services").alias("service", "s"))
    spec = F.when(F.col("s.spec").rlike("^(/|[a-z]+:/)"), F.col("s.spec")).otherwise(F.concat("folder", F.regexp_replace("s.spec", r"^\./", "")))
    reason = F.when(plain & parts, "both flow and graph").when(~plain & ~parts, "neither flow nor graph").when(F.trim(F.coalesce("info.title", F.lit(""))) == "", "no title")
    return {
        "flow_steps": one.unionByName(many),
        "graph_nodes": nodes.select("flow_id", "n", F.col("g.id").alias("node"), "g.call", "g.input", "g.output"),
        "graph_edges": given.unionByName(depends),
        "service_bindings": services.select("flow_id", "service", spec.alias("spec")),
        "issues": raw.select("flow_id", F.when(reason == "no title", "WARN").otherwise("ERROR").alias("level"), reason.alias("message")).where("message IS NOT NULL"),
    }


def _marked(conditions: str, kind: str) -> Column:
    return F.map_from_entries(F.transform(F.map_entries(conditions), lambda e: F.struct(F.concat(F.lit(kind + ":"), e["key"]), e["value"])))


def read_services(spark: SparkSession, path: str) -> DataFrame:
    """Operations and their conditions: spec (the file), service, operation, kind, condition, expression. Of operations with one id the last counts."""
    raw = spark.read.schema(SERVICE).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("spec"), "service", F.posexplode("operations").alias("pos", "o"))
    last = raw.groupBy("spec", "service", F.col("o.operationId").alias("operation")).agg(F.max_by("o", "pos").alias("o"))
    kinds = F.map_concat(*[F.coalesce(_marked(f"o.{k}conditions", k), F.create_map().cast("map<string,string>")) for k in ("pre", "post")])
    c = last.select("spec", "service", "operation", F.explode_outer(kinds).alias("k", "expression"))
    return c.select("spec", "service", "operation", F.split("k", ":", 2)[0].alias("kind"), F.get(F.split("k", ":", 2), F.lit(1)).alias("condition"), "expression")


def contract_tables(flows: dict[str, DataFrame], services: DataFrame) -> dict[str, DataFrame]:
    """What :func:`spanflow.operators.validate.validate` and :func:`spanflow.operators.lint.issues` take, from :func:`read_flows` and :func:`read_services`: conditions and operations
    are those of the specs that a flow binds, under the names that it gives them."""
    bound = flows["service_bindings"].join(services.withColumnRenamed("service", "spec_service"), "spec")
    return {
        "steps": flows["flow_steps"],
        "nodes": flows["graph_nodes"],
        "edges": flows["graph_edges"],
        "services": flows["service_bindings"].select("flow_id", "service"),
        "operations": bound.select("service", "operation").distinct(),
        "conditions": bound.where("condition IS NOT NULL").select("flow_id", "service", "operation", "kind", "condition", "expression"),
        "issues": flows["issues"],
    }
