"""Windows over whole traces in two levels, for traces that are too large for one task.

Traces are cut by ranges of their order (start time and a tie-break). What a window computes is done inside a range; one row a range
carries on what the next range must know (how many came before, what comes first there), and goes back by a join on trace and range."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanflow.operators.steps import checkpointed

#: Spans of a range, about.
ROWS = 500_000


def ranged(spans: DataFrame, order: list[str], rows: int = ROWS) -> DataFrame:
    """``spans`` with ``range``: ascending with ``order`` in a trace, and of about ``rows`` spans, of one trace or of several.

    Range partitioning samples (trace_id, order) and cuts large traces wherever their weight is. Written once, so that all that reads it sees the same ranges."""
    n = max(1, math.ceil(spans.count() / rows))
    return checkpointed(spans.repartitionByRange(n, "trace_id", *order).withColumn("range", F.spark_partition_id()))


def _inside(order: list[str]):
    return Window.partitionBy("trace_id", "range").orderBy(*order)


def _trace():
    return Window.partitionBy("trace_id").orderBy("range")


def numbered(spans: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """``spans`` of :func:`ranged` with their place in the trace, from 1."""
    before = spans.groupBy("trace_id", "range").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("trace_id", "range", F.coalesce(F.sum("_n").over(_trace().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    s = spans.withColumn("_place", F.row_number().over(_inside(order)))
    return s.join(before, ["trace_id", "range"]).withColumn(name, (F.col("_place") + F.col("_before")).cast("int")).drop("_place", "_before")


def followed(spans: DataFrame, order: list[str], columns: list[str], name: str = "x") -> DataFrame:
    """``spans`` of :func:`ranged` with a struct of ``columns`` of the next one in the trace; null for the last."""
    row = F.struct(*columns)
    first = spans.groupBy("trace_id", "range").agg(F.min_by(row, F.struct(*order)).alias("_first"))
    after = first.select("trace_id", "range", F.lead("_first").over(_trace()).alias("_next"))
    s = spans.withColumn(name, F.lead(row).over(_inside(order)))
    return s.join(after, ["trace_id", "range"]).withColumn(name, F.coalesce(name, "_next")).drop("_next")


def with_extent(spans: DataFrame, **numbers: Column) -> DataFrame:
    """``spans`` of :func:`ranged` with aggregates of their whole trace."""
    total = spans.groupBy("trace_id").agg(*[c.alias(n) for n, c in numbers.items()])
    return spans.join(per_range(spans, total), ["trace_id", "range"])


def per_range(spans: DataFrame, of_traces: DataFrame) -> DataFrame:
    """A table with a row a trace as one with a row for each of its ranges, so that joining it never brings a trace into one task."""
    return spans.select("trace_id", "range").distinct().join(of_traces, "trace_id")
