"""Writers of reports, baselines, discovered contracts and masked spans."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BASELINE = "trace_id string, schema_version string, flow_hash string, steps_total int, covered_steps array<string>, conditions map<string,map<string,boolean>>"


def save_baseline(baseline: DataFrame, path: str) -> None:
    baseline.write.mode("overwrite").json(path)


def load_baseline(spark: SparkSession, path: str, on_missing: str = "fail") -> DataFrame | None:
    """The baseline, or, if there is none, an error (``fail``) or None (``treat-as-absolute``)."""
    try:
        found = spark.read.schema(_BASELINE).json(path)
    except AnalysisException:
        if on_missing != "treat-as-absolute":
            raise
        return None
    return found


def json_report(steps: DataFrame, conditions: DataFrame, coverage: DataFrame, gate: DataFrame, path: str) -> None:
    """One JSON object per trace: steps in order with their conditions, summary and gate. Arrays are as long as a contract."""
    c = conditions.groupBy("trace_id", "step").agg(F.array_sort(F.collect_list(F.struct("kind", "condition", "result"))).alias("conditions"))
    fields = [f for f in ("pos", "step", "call", "status", "note", "conditions") if f in steps.columns or f == "conditions"]
    s = steps.join(c, ["trace_id", "step"], "left").groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("steps"))
    summary = coverage.select("trace_id", F.struct(*[x for x in coverage.columns if x != "trace_id"]).alias("summary"))
    checked = gate.select("trace_id", F.struct(*[x for x in gate.columns if x != "trace_id"]).alias("gate"))
    s.join(summary, "trace_id", "left").join(checked, "trace_id", "left").write.mode("overwrite").json(path)


def junit_report(steps: DataFrame, path: str, suite: str = "testsuites", conditions: DataFrame | None = None, coverage: DataFrame | None = None) -> None:
    """Test results as XML: a suite a trace, with the numbers of its tests, failures and skipped ones, and those of its coverage as properties; in it a test case a step,
    with a failure where it failed and its conditions as text. A suite is as long as a contract. Escaping is the writer's."""
    note = F.col("note") if "note" in steps.columns else F.lit("")
    cases = steps.withColumn("details", F.lit(None).cast("string"))
    if conditions is not None:
        line = F.concat(F.lit("["), "result", F.lit("] "), "kind", F.lit(" "), "condition")
        lines = conditions.groupBy("trace_id", "step").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("details"))  # of one step
        cases = cases.drop("details").join(lines, ["trace_id", "step"], "left")
    failure = F.when(F.col("status") == "FAIL", F.struct(note.alias("_message"), F.col("call").alias("_VALUE")))
    case = F.struct(F.col("pos"), F.col("step"), F.struct(F.col("trace_id").alias("_classname"), F.col("step").alias("_name"), failure.alias("failure"), F.when(F.col("status") == "SKIP", F.lit("")).alias("skipped"), F.col("details").alias("system-out")).alias("case"))
    of = lambda status: F.count_if(F.col("status") == status)
    suites = cases.groupBy("trace_id").agg(F.count(F.lit(1)).alias("_tests"), of("FAIL").alias("_failures"), of("SKIP").alias("_skipped"), F.array_sort(F.collect_list(case)).alias("cases"))
    columns = [F.col("trace_id").alias("_name"), "_tests", "_failures", F.lit(0).alias("_errors"), "_skipped"]
    if coverage is not None:
        numbers = [F.struct(F.lit(c).alias("_name"), F.col(c).cast("string").alias("_value")) for c in coverage.columns if c != "trace_id"]
        suites = suites.join(coverage.select("trace_id", F.struct(F.array(*numbers).alias("property")).alias("properties")), "trace_id", "left")
        columns.append("properties")
    suites = suites.select(*columns, F.transform("cases", lambda c: c["case"]).alias("testcase"))
    suites.write.format("xml").option("rootTag", suite).option("rowTag", "testsuite").mode("overwrite").save(path)


def discovered_contracts(flow_steps: DataFrame, conditions: DataFrame, path: str) -> None:
    """Discovered steps as a table, and conditions in a folder per service."""
    flow_steps.write.mode("overwrite").json(f"{path}/flows")
    conditions.withColumn("file", F.regexp_replace("service", "[^a-zA-Z0-9_-]", "_")).repartition("file").write.mode("overwrite").partitionBy("file").json(f"{path}/services")


def masked_spans(masked: DataFrame, path: str) -> None:
    """Masked spans, attributes as JSON text."""
    masked.withColumn("attributes", F.to_json("attributes")).write.mode("overwrite").json(path)
