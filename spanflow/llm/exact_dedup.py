"""Exact dedup: stateful streaming deduplication over disk-backed keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanflow.llm.common import ASCII_SPACE, scratch, written

#: State on disk; a partition's store is closed once its batch is committed, as each open one holds some MB.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def normalised(text: str = "text"):
    """The text without the six ASCII white spaces; null counts as empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), ASCII_SPACE, "")


def digest(text: str = "text", bits: int = 256):
    return F.sha2(normalised(text), 256) if bits == 256 else F.substring(F.sha2(normalised(text), 256), 1, bits // 4)


def state_stream(facts: DataFrame, state: str, out: str) -> None:
    """Runs every row of the table ``facts`` (digest, n, id) that the stream has not
    seen through keyed state: per digest the best locator and a count. State lives
    in RocksDB under ``state`` without expiry, so a later run with more files in
    the table's folder goes on from it. Each batch adds the digests that it changed
    to ``out``. Counts and best locators are summed per task before the shuffle, so
    a digest with very many copies sends one row a task."""
    spark = facts.sparkSession
    stream = spark.readStream.schema(facts.schema).parquet(facts.inputFiles()[0].rpartition("/")[0])
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("id").isNull().alias("unnamed"), F.col("id"), F.col("check")))
    keyed = stream.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))

    def keep(changed: DataFrame, batch: int) -> None:
        changed.select("digest", "group_size", "best", F.lit(batch).alias("batch")).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    had = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        query = keyed.writeStream.outputMode("update").option("checkpointLocation", state).foreachBatch(keep).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in had.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 256, state: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when the same after removal of ASCII white space (null:
    empty). The row with the most code points in its original text stays, then the
    one with the smallest id (null ids last); of rows that agree in both, all are
    marked kept only if the id is unique; equal ids count as copies of one row, of
    which the one with the smaller content check stays, and rows that agree in that
    too are all the same row. Empty input gives no rows; other columns are ignored.

    A task reads a text and passes on (digest, code points, id, content check).
    These run through a streaming query whose state (RocksDB, no expiry) keeps, per
    digest, the stable id and locator of the row that stays. On a hit the full
    bytes are compared: each copy's normalised text is joined to that of the row
    that stays, by locator. If a digest ever covers different texts (``bits`` can
    be lowered in tests), its rows are grouped anew by the whole text. With the ``state`` of an earlier run, texts of that run are not in
    ``docs``, and hits on them rest on 256 bits of digest."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    fact = rows.select(digest("text", bits).alias("digest"), F.coalesce(F.length("text"), F.lit(0)).alias("n"), "id", F.xxhash64("text").alias("check"))
    fact = written(fact, "digests")
    if not fact.inputFiles():
        facts_empty = True
    else:
        facts_empty = False
        out = scratch(spark, "kept")
        state_stream(fact, state or scratch(spark, "state"), out)
    schema = "digest string, group_size long, best struct<neg:int,unnamed:boolean,id:long,check:long>, batch int"
    if facts_empty:
        last = spark.createDataFrame([], schema).drop("batch")
    else:
        kept = spark.read.schema(schema).parquet(out)
        last = kept.groupBy("digest").agg(F.max_by(F.struct("group_size", "best"), "batch").alias("s")).select("digest", "s.group_size", "s.best")
    found = fact.join(last, "digest").select("digest", "id", "n", "check", "group_size", "best")

    # On a hit, whole bytes: copies against the row that stays, found by its locator (id and content check).
    hits = found.where("group_size > 1").select("id", "check", F.col("best.id").alias("keep_id"), F.col("best.check").alias("keep_check"), "digest").distinct()
    text = rows.select(F.col("id").alias("t_id"), F.xxhash64("text").alias("t_check"), normalised().alias("body"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    copies = hits.join(text, same("id", "t_id") & same("check", "t_check")).select("digest", "body", "id", "check", "keep_id", "keep_check")
    keepers = copies.where(same("id", "keep_id") & same("check", "keep_check")).select(F.col("digest").alias("k_digest"), F.col("body").alias("k_body")).dropDuplicates(["k_digest"])
    unlike = written(copies.join(keepers, copies["digest"] == keepers["k_digest"]).where("body <> k_body").select("digest").distinct(), "unlike")
    size = F.col("group_size").cast("long").alias("group_size")
    is_best = (F.col("n") == -F.col("best.neg")) & same("id", "best.id") & (F.col("check") == F.col("best.check"))
    sha = [F.col("digest").alias("text_sha256")] if bits == 256 else [F.lit(None).cast("string").alias("text_sha256")]
    out = found.select(F.col("id").alias("doc_id"), F.col("best.id").alias("keep_id"), size, is_best.alias("kept"), *sha, "digest", "check")
    if not unlike.isEmpty() or bits != 256:
        again = rows.select("id", F.coalesce(F.length("text"), F.lit(0)).alias("n"), F.xxhash64("text").alias("check"), normalised().alias("body"), digest("text", bits).alias("digest")).join(unlike, "digest", "left_semi")
        best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("id").isNull().alias("unnamed"), "id", "check"))
        again = again.join(again.groupBy("body").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")), "body")
        again = again.select(F.col("id").alias("doc_id"), F.col("best.id").alias("keep_id"), size, is_best.alias("kept"), F.sha2("body", 256).alias("text_sha256"), "digest", "check")
        clean = out.join(unlike, "digest", "left_anti")
        if bits != 256:
            full = rows.select(F.col("id").alias("f_id"), F.xxhash64("text").alias("f_check"), F.sha2(normalised(), 256).alias("full")).distinct()
            clean = clean.join(full, same("doc_id", "f_id") & same("check", "f_check")).withColumn("text_sha256", F.col("full")).select(*out.columns)
        out = clean.unionByName(again)
    return out.drop("digest")
