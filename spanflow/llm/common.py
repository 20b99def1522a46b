"""Helpers that the corpus operators share: scratch tables, whole-task Arrow
plumbing, skew-proof ranks and distributed connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets that split one hot key in :func:`ranked`.
RANK_BUCKETS = 256
ASCII_SPACE = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``;
    only where that is unset and all run on one machine (tests) a temporary folder is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/spanflow-{name}-{uuid.uuid4().hex}"


#: The setting by which Spark deletes the shuffle files of a query once it has run, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage is cut, and a lost
    executor costs nothing of what has been computed. Shuffle files of the step go with it."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of :func:`written` that nothing will read any more."""
    for path in {f.rpartition("/")[0] for t in tables for f in t.inputFiles()}:
        at = tables[0].sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(tables[0].sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def columns(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    return {name: batch.column(k) for k, name in enumerate(batch.schema.names)}


def ints(col: pa.Array) -> np.ndarray:
    return col.to_numpy(zero_copy_only=False)


def whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All rows of one task; None when there are none."""
    kept = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(kept).combine_chunks() if kept else None


def batched(schema: pa.Schema, cols: list, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Cuts equally long columns (numpy arrays or lists) into record batches."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)]
    if len(arrays[0]):
        yield from pa.Table.from_arrays(arrays, schema=schema).to_batches(max_chunksize=rows)


def ranked(df: DataFrame, keys: list[str], order: list, salt) -> DataFrame:
    """Adds ``rank`` (from 0, no gaps) within ``keys``, ordered by a bucket of
    ``salt`` and then ``order``. One hot key is spread over RANK_BUCKETS tasks:
    rows are numbered inside (key, bucket), and counts per bucket, summed before
    the shuffle, give each bucket's start. ``salt`` must be determined by the row."""
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(salt), F.lit(RANK_BUCKETS)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n")).select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1
    return df.withColumn("_inside", inside).join(start, [*keys, "_bucket"]).withColumn("rank", F.col("_start") + F.col("_inside")).drop("_bucket", "_inside", "_start")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` by alternating large and small
    stars (Kiveris et al. 2014): (node, root), root being the least node; a node
    without edges has no row. Values may be of any ordered type. Each round is
    two aggregations with partial sums and two joins that adaptive execution can
    split, so a node with very many links is no single task. Rounds grow with the
    logarithm of the longest path; the edges are written after each, and what
    comes to the driver is whether a node is left that is no root and has not one link to one."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)).distinct())
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty():
            break  # every node has one link, to a root: its least one, as u > v
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        before, edges = edges, written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        dropped(before)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
