"""Numbers of reports: durations, timelines, counts of spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanflow.operators import ranges


def duration(spans: DataFrame) -> DataFrame:
    return spans.groupBy("trace_id").agg(F.count(F.lit(1)).alias("spans"), (F.max("end_ns") - F.min("start_ns")).alias("duration_ns"))


def timeline(spans: DataFrame, large: bool = False) -> DataFrame:
    """Left edge and width of each span in percent of its trace; at least 0.5 wide, and none if the trace has no length. ``large``: traces
    are cut into ranges (:mod:`spanflow.operators.ranges`)."""
    end = F.when(F.col("end_ns") == 0, F.col("start_ns")).otherwise(F.col("end_ns"))
    s = spans.select("trace_id", "span_id", "start_ns", end.alias("end_ns"))
    if large:
        s = ranges.with_extent(ranges.ranged(s, ["start_ns", "span_id"]), t0=F.min("start_ns"), t1=F.max("end_ns"))
    else:
        w = Window.partitionBy("trace_id")
        s = s.withColumns({"t0": F.min("start_ns").over(w), "t1": F.max("end_ns").over(w)})
    s = s.where("t1 > t0")
    total = (F.col("t1") - F.col("t0")).cast("double")
    part = lambda c: F.round(c.cast("double") * 100 / total, 6)  # nanoseconds times 100 can leave 64 bits
    return s.select("trace_id", "span_id", part(F.col("start_ns") - F.col("t0")).alias("left_pct"), F.greatest(part(F.col("end_ns") - F.col("start_ns")), F.lit(0.5)).alias("width_pct"))


def by_service(spans: DataFrame) -> DataFrame:
    return spans.groupBy(F.coalesce(F.nullif("service", F.lit("")), F.lit("unknown-service")).alias("service")).agg(F.count(F.lit(1)).alias("spans"))


def by_operation(spans: DataFrame) -> DataFrame:
    return spans.groupBy(F.col("name").alias("operation")).agg(F.count(F.lit(1)).alias("spans"))


def span_totals(spans: DataFrame) -> DataFrame:
    """Spans, traces, services and operations in one row."""
    return spans.agg(F.count(F.lit(1)).alias("spans"), F.countDistinct("trace_id").alias("traces"), F.countDistinct("service").alias("services"), F.countDistinct("name").alias("operations"))
