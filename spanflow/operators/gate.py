"""Coverage, gates, baselines and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanflow.functions.scalars import content_hash

#: Default thresholds of the gate, and its messages.
STEPS, CONDITIONS = 0.9, 0.95
BELOW = {"s": "Steps coverage %.1f%% < required {:.1f}%%", "c": "Conditions pass rate %.1f%% < required {:.1f}%%"}


def rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def coverage(steps: DataFrame, conditions: DataFrame, key: str = "trace_id") -> DataFrame:
    """Per trace: steps and conditions by status, coverage in percent and as a fraction, rate of conditions."""
    n = lambda c, v: F.count_if(F.col(c) == v)
    s = steps.groupBy(key).agg(F.count(F.lit(1)).alias("steps_total"), n("status", "PASS").alias("steps_pass"), n("status", "FAIL").alias("steps_fail"), n("status", "SKIP").alias("steps_skip"))
    c = conditions.groupBy(key).agg(F.count(F.lit(1)).alias("conditions_total"), n("result", "PASS").alias("conditions_pass"), n("result", "FAIL").alias("conditions_fail"), n("result", "SKIP").alias("conditions_skip"))
    names = ["conditions_total", "conditions_pass", "conditions_fail", "conditions_skip"]
    r = s.join(c, key, "left").withColumns({k: F.coalesce(k, F.lit(0)) for k in names})
    steps_rate = rate(F.col("steps_pass"), F.col("steps_total"))
    return r.withColumns({"coverage_pct": F.round(steps_rate * 100, 6), "coverage_rate": F.round(steps_rate, 6), "conditions_rate": F.round(rate(F.col("conditions_pass"), F.col("conditions_pass") + F.col("conditions_fail")), 6)})


def service_coverage(steps: DataFrame) -> DataFrame:
    return steps.where(F.col("call").contains(".")).groupBy("trace_id", F.split("call", r"\.")[0].alias("service")).agg(F.count(F.lit(1)).alias("steps"))


def uncovered(steps: DataFrame) -> DataFrame:
    """Names of failed steps in order, per trace."""
    u = steps.where("status = 'FAIL'").groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("pos", "step"))).alias("u"))
    return u.select("trace_id", F.array_join(F.transform("u", lambda x: x["step"]), ",").alias("uncovered"))


def absolute(cover: DataFrame, steps: float = STEPS, conditions: float = CONDITIONS, skip_as_fail: bool = False) -> DataFrame:
    """Rates against fixed thresholds: trace_id, steps_rate, conditions_rate, passed, violations."""
    evaluated = F.col("conditions_pass") + F.col("conditions_fail") + (F.col("conditions_skip") if skip_as_fail else F.lit(0))
    r = cover.select("trace_id", rate(F.col("steps_pass"), F.col("steps_total")).alias("s"), rate(F.col("conditions_pass"), evaluated).alias("c"))
    text = lambda col, least: F.when(F.col(col) < least, F.format_string(BELOW[col].format(least * 100), F.col(col) * 100))
    found = F.array_compact(F.array(text("s", steps), text("c", conditions)))
    return r.select("trace_id", F.round("s", 6).alias("steps_rate"), F.round("c", 6).alias("conditions_rate"), (F.size(found) == 0).alias("passed"), F.size(found).alias("violations"), F.array_join(found, "; ").alias("messages"))


def baseline_steps(steps: DataFrame, conditions: DataFrame) -> DataFrame:
    """What a run records, over traces of a contract: per step, whether covered, and conditions passed. Refused (no rows)
    for traces that failed."""
    ok = steps.groupBy("trace_id").agg(F.bool_and(F.col("status") == "PASS").alias("ok")).where("ok").select("trace_id")
    c = conditions.groupBy("trace_id", "step").agg(F.count(F.lit(1)).alias("conditions"), F.count_if(F.col("result") == "PASS").alias("conditions_passed"))
    s = steps.join(ok, "trace_id", "left_semi").join(c, ["trace_id", "step"], "left")
    return s.select("trace_id", "pos", "step", F.coalesce("conditions", F.lit(0)).alias("conditions"), F.coalesce("conditions_passed", F.lit(0)).alias("conditions_passed"))


def baseline_record(steps: DataFrame, conditions: DataFrame, contract: str, steps_total: int) -> DataFrame:
    """A run's record, a row for each trace that did not fail: trace_id, schema_version, flow_hash (of the contract's text), steps_total (entries of the
    contract), covered_steps in order, and conditions, a map from step to a map from ``kind:name`` to whether it passed. Lists are as long as a contract."""
    ok = steps.groupBy("trace_id").agg(F.bool_and(F.col("status") == "PASS").alias("ok")).where("ok").select("trace_id")
    covered = steps.where("status = 'PASS'").groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("pos", "step"))).alias("c"))
    one = conditions.groupBy("trace_id", "step").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws(":", "kind", "condition").alias("k"), (F.col("result") == "PASS").alias("v"))))).alias("m"))
    all_ = one.groupBy("trace_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("step", "m")), lambda a, b: F.when(a["step"] < b["step"], -1).when(a["step"] > b["step"], 1).otherwise(0))).alias("conditions"))
    r = ok.join(covered, "trace_id").join(all_, "trace_id", "left")
    none = F.create_map().cast("map<string,map<string,boolean>>")
    return r.select("trace_id", F.lit("1").alias("schema_version"), content_hash(F.lit(contract)).alias("flow_hash"), F.lit(steps_total).alias("steps_total"), F.transform("c", lambda x: x["step"]).alias("covered_steps"), F.coalesce("conditions", none).alias("conditions"))


def recorded(baseline: DataFrame) -> DataFrame:
    """A record as a side of :func:`relative`; what was skipped counts as not passed in it."""
    each = F.flatten(F.transform(F.map_values("conditions"), lambda m: F.map_values(m)))
    passed = F.size(F.filter(each, lambda x: x))
    return baseline.select("trace_id", F.size("covered_steps").cast("long").alias("steps_pass"), F.col("steps_total").cast("long").alias("steps_total"), passed.cast("long").alias("conditions_pass"), F.size(each).cast("long").alias("conditions_evaluated"))


def totals(steps: DataFrame, key: str = "trace_id") -> DataFrame:
    """Passed and failed steps of a report, and whether all is well."""
    return steps.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(F.col("status") == "FAIL").alias("failed"), (F.count_if(F.col("status") == "FAIL") == 0).alias("success"))


def relative(current: DataFrame, baseline: DataFrame, keys: list[str], steps: float = STEPS, conditions: float = CONDITIONS) -> DataFrame:
    """Changes against a baseline: both frames have keys, steps_pass, steps_total, conditions_pass, conditions_evaluated.

    Thresholds are the loss allowed. A baseline without steps has null coverage and a change of 0."""
    side = lambda df, p: df.select(*keys, F.try_divide(F.col("steps_pass").cast("double"), F.col("steps_total").cast("double")).alias(f"{p}_s"), rate(F.col("conditions_pass"), F.col("conditions_evaluated")).alias(f"{p}_c"))
    r = side(current, "now").join(side(baseline, "base"), keys)
    for x in "sc":
        now, base = F.coalesce(f"now_{x}", F.lit(0.0)), F.col(f"base_{x}")
        r = r.withColumn(f"d_{x}", F.coalesce(now - base, F.lit(0.0))).withColumn(f"p_{x}", F.when(base > 0, (now - base) / base).otherwise(0.0))
    six = lambda c, name: F.round(c, 6).alias(name)
    return r.select(
        *keys, six("base_s", "base_steps"), six("now_s", "steps"), six("d_s", "steps_delta"), six("p_s", "steps_delta_pct"), six("base_c", "base_conditions"), six("now_c", "conditions"),
        six("d_c", "conditions_delta"), six("p_c", "conditions_delta_pct"), ((F.col("p_s") >= -steps) & (F.col("p_c") >= -conditions)).alias("passed"),
    )


def verdict(structural: DataFrame, gate: DataFrame, lint: DataFrame | None = None) -> DataFrame:
    """Per trace: 2 if its contract has lint errors, 3 if validation failed, 4 if the gate did, else 0.
    ``structural`` has trace_id and ok, ``lint`` trace_id and errors (none where it is missing)."""
    r = structural.join(gate.select("trace_id", "passed"), "trace_id")
    r = r.withColumn("errors", F.lit(0)) if lint is None else r.join(lint.select("trace_id", "errors"), "trace_id", "left")
    code = F.when(F.coalesce("errors", F.lit(0)) > 0, 2).when(~F.col("ok"), 3).when(~F.col("passed"), 4).otherwise(0)
    return r.select("trace_id", "ok", F.col("passed").alias("gate_passed"), code.alias("verdict"))
