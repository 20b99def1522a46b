"""Streaming extension: traces are validated once they have been quiet for a while."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def closed_traces(spans: DataFrame, gap: str = "5 minutes", late: str = "10 minutes", time_col: str = "ts") -> DataFrame:
    """A stream of spans (with an event time) to one row per finished session of a trace: trace_id, session, spans (by start and ordinal, with all their columns).

    All spans of a trace are kept until it closes; where only a contract's steps are asked for, :func:`spanflow.streaming.matching.match_stream` keeps less."""
    row = F.struct(*[c for c in spans.columns if c not in ("trace_id", time_col)])
    s = spans.withWatermark(time_col, late).groupBy("trace_id", F.session_window(time_col, gap).alias("session")).agg(F.collect_list(row).alias("spans"))
    key = lambda x: F.struct(x["start_ns"], x["ordinal"])
    return s.select("trace_id", "session", F.array_sort("spans", lambda x, y: F.when(key(x) < key(y), -1).when(key(x) > key(y), 1).otherwise(0)).alias("spans"))


def validate_stream(spans: DataFrame, validate: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, gap: str = "5 minutes", late: str = "10 minutes", **trigger: object) -> StreamingQuery:
    """Runs the batch operator ``validate`` on the traces that close in each batch, and writes its rows under ``path``, one
    folder a batch, so that a batch run again replaces its own."""

    def one(batch: DataFrame, number: int) -> None:
        flat = batch.select(F.concat_ws("@", "trace_id", F.col("session.start").cast("string")).alias("trace_id"), F.inline("spans"))
        validate(flat).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return closed_traces(spans, gap, late).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(one).trigger(**(trigger or {"availableNow": True})).start()
