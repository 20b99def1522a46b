"""A store of spans: tables bucketed by trace, attributes apart from the narrow columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanflow.sources.spans import SPAN_COLUMNS


def save_spans(spans: DataFrame, name: str, path: str, buckets: int = 1024, apart: bool = True) -> None:
    """Saves ``spans`` as the tables ``name`` (SPAN_COLUMNS) and, where there are attributes, ``name``_attributes (trace_id, span_id, ordinal, attributes) under ``path``.
    Without ``apart`` attributes are a column of ``name``: the spans are made once, and no join is needed to read them.

    Both are bucketed by trace_id, a file a bucket, in the order of trace, start and place in the file: what works by trace then needs
    no shuffle, and what needs no attributes does not read them. A name that exists is replaced."""
    tables = {name: [c for c in SPAN_COLUMNS if c in spans.columns]}
    if "attributes" in spans.columns and not apart:
        tables[name].append("attributes")
    elif "attributes" in spans.columns:
        tables[f"{name}_attributes"] = ["trace_id", "span_id", "ordinal", "attributes"]
    for table, columns in tables.items():
        order = ["trace_id", "start_ns", "ordinal"] if "start_ns" in columns else ["trace_id", "ordinal"]
        out = spans.select(*columns).repartition(buckets, "trace_id").write.bucketBy(buckets, "trace_id").sortBy(*order).mode("overwrite")
        out.option("path", f"{path.rstrip('/')}/{table}").saveAsTable(table)


def load_spans(spark: SparkSession, name: str, attributes: bool = False) -> DataFrame:
    """The spans of a store. With ``attributes``, these are joined bucket by bucket; for that the session's joins may use a partitioning by some of their
    keys (``spark.sql.requireAllClusterKeysForCoPartition`` is set to false). Columns of attributes are not read where nothing asks for them."""
    spans = spark.table(name)
    if not attributes:
        return spans.drop("attributes")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    if "attributes" in spans.columns:
        return spans
    return spans.join(spark.table(f"{name}_attributes").hint("merge"), ["trace_id", "span_id", "ordinal"], "left")


def drop_store(spark: SparkSession, name: str) -> None:
    """Forgets a store's tables; their files stay."""
    for table in (name, f"{name}_attributes"):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
