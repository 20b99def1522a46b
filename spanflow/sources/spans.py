"""Readers of span files: the simple JSON layout and OTLP JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanflow.functions.scalars import inferred_status, string_attr

#: The narrow columns of a span.
SPAN_COLUMNS = ["trace_id", "span_id", "parent_span_id", "service", "name", "start_ns", "end_ns", "ordinal"]
SPAN_FILE = "spans array<struct<name:string,service:string,startNanos:bigint,endNanos:bigint,attributes:map<string,variant>>>"
_VALUE = "struct<stringValue:string,intValue:string,doubleValue:string,boolValue:boolean,arrayValue:variant,kvlistValue:variant,bytesValue:string>"
_ATTRS = f"array<struct<key:string,value:{_VALUE}>>"
OTLP = f"""resourceSpans array<struct<resource:struct<attributes:{_ATTRS}>,scopeSpans:array<struct<scope:struct<name:string,version:string>,spans:array<struct<
traceId:string,spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_ATTRS},
events:array<struct<timeUnixNano:string,name:string,attributes:{_ATTRS}>>,status:struct<code:int,message:string>>>>>>>""".replace("\n", "")


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """Files of {"spans": [...]}: trace_id (the file), ordinal, name, service, start_ns, end_ns (absent: 0), attributes, and the
    OTLP ids where the attributes have them. One file is one trace."""
    raw = spark.read.schema(SPAN_FILE).json(path, multiLine=True)
    s = raw.select(F.col("_metadata.file_path").alias("trace_id"), F.posexplode("spans").alias("ordinal", "s"))
    text = lambda key: string_attr(F.col("s.attributes"), key)
    zero = lambda c: F.coalesce(c, F.lit(0))
    own = F.coalesce(text("otlp.span_id"), F.concat_ws(":", "s.service", "s.name", zero(F.col("s.startNanos")).cast("string")))
    return s.select(
        "trace_id", F.col("ordinal").cast("bigint").alias("ordinal"), own.alias("span_id"), text("otlp.parent_span_id").alias("parent_span_id"), F.col("s.name").alias("name"), F.col("s.service").alias("service"),
        zero(F.col("s.startNanos")).alias("start_ns"), zero(F.col("s.endNanos")).alias("end_ns"), F.col("s.attributes").alias("attributes"),
    )


def otlp_value(v: Column) -> Column:
    """The first value that is not empty: string, integer, double (numbers that do not parse stay text), true, array, list, bytes; else ''."""
    filled = lambda c: F.nullif(c, F.lit(""))
    number = lambda c, kind: F.coalesce(filled(c).try_cast(kind).cast("variant"), filled(c).cast("variant"))
    return F.coalesce(
        filled(v["stringValue"]).cast("variant"), number(v["intValue"], "bigint"), number(v["doubleValue"], "double"), F.when(v["boolValue"], F.lit(True).cast("variant")),
        v["arrayValue"], v["kvlistValue"], filled(v["bytesValue"]).cast("variant"), F.lit("").cast("variant"),
    )


def attribute_map(attrs: Column) -> Column:
    """Key and value pairs as a map; of equal keys the last wins."""
    pairs = F.coalesce(attrs, F.array().cast(_ATTRS))
    keys = F.transform(pairs, lambda a: a["key"])
    last = F.filter(pairs, lambda a, i: ~F.exists(F.slice(keys, i + 2, F.greatest(F.size(keys) - i - 1, F.lit(0))), lambda k: k == a["key"]))
    return F.map_from_entries(F.transform(last, lambda a: F.struct(a["key"].alias("key"), otlp_value(a["value"]).alias("value"))))


def read_otlp(spark: SparkSession, path: str) -> DataFrame:
    """OTLP JSON as the same columns as :func:`read_spans`; trace_id is the OTLP trace id, or the file. A time that is no number is an
    error; :func:`read_otlp_lenient` sets such spans apart. Ids and status go into the attributes as otlp.*, and response.status is the HTTP status or what an OK status lets expect."""
    raw = spark.read.schema(OTLP).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("file"), F.lit("").alias("record"), "resourceSpans")
    s = _spans_of(raw)
    start, end = (F.col(c).cast("bigint").alias(n) for c, n in _TIMES)
    return s.withColumns({"start_ns": start, "end_ns": end}).select(*_READ)


_TIMES = [("start_text", "start_ns"), ("end_text", "end_ns")]
_READ = ["trace_id", "ordinal", "span_id", "parent_span_id", "name", "service", "start_ns", "end_ns", "attributes"]


def read_otlp_lenient(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Spans as :func:`read_otlp`, and a table of what could not be read: file, record, position, reason; nothing stops the read of the rest.

    ``lines``: every line is an OTLP object of its own, and large files are read in splits; ``record`` is then the line's hash, and a trace
    without an id is the line's. A record that is no such JSON is one reject (position null); a span with a time that is no number or with none is one by
    its place in the record (resource, scope, span, from 0)."""
    if lines:
        # The line itself is kept, so that its hash can name it; blank lines are none.
        text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.trim("value") != "")
        raw = text.select("file", F.hex(F.xxhash64("value")).alias("record"), F.from_json("value", f"{OTLP}, _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("j"))
        raw = raw.select("file", "record", "j.*")
    else:
        raw = spark.read.schema(f"{OTLP}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path, multiLine=True).select(F.col("_metadata.file_path").alias("file"), F.lit("").alias("record"), "resourceSpans", "_broken")
    broken = F.col("_broken").isNotNull()
    records = raw.select("file", "record", F.lit(None).cast("string").alias("position"), F.when(broken, "no OTLP JSON").when(F.coalesce(F.size("resourceSpans"), F.lit(0)) <= 0, "no resourceSpans").alias("reason")).where("reason IS NOT NULL")
    s = _spans_of(raw.where(~broken)).withColumns({n: F.col(c).try_cast("bigint") for c, n in _TIMES})
    reason = F.concat_ws(", ", *[F.when(F.col(n).isNull(), F.concat(F.lit(f"{n}: "), F.coalesce(c, F.lit("none")))) for c, n in _TIMES])
    bad = s.select("file", "record", F.concat_ws(".", "p1", "p2", "p3").alias("position"), reason.alias("reason")).where("reason <> ''")
    return s.where("start_ns IS NOT NULL AND end_ns IS NOT NULL").select(*_READ), records.unionByName(bad)


def _spans_of(raw: DataFrame) -> DataFrame:
    """Spans of OTLP objects (file, record, resourceSpans), with times as text and their places."""
    r = raw.select("file", "record", F.posexplode("resourceSpans").alias("p1", "r"))
    r = r.select("file", "record", "p1", attribute_map(F.col("r.resource.attributes")).alias("resource"), F.posexplode("r.scopeSpans").alias("p2", "c"))
    s = r.select("file", "record", "p1", "p2", "resource", F.posexplode("c.spans").alias("p3", "s")).withColumn("a", attribute_map(F.col("s.attributes")))
    get = lambda m, key: F.get(F.map_values(F.map_filter(m, lambda k, _: k == key)), F.lit(0))
    service = lambda m: F.when(F.schema_of_variant(get(m, "service.name")) == "STRING", F.try_variant_get(get(m, "service.name"), "$", "string"))
    status = F.coalesce(get("a", "http.status_code"), inferred_status(F.lit(None).cast("int"), F.col("s.status.code"), F.col("s.name")).cast("variant"))
    extra = [("otlp.trace_id", F.coalesce("s.traceId", F.lit(""))), ("otlp.span_id", F.coalesce("s.spanId", F.lit(""))), ("otlp.parent_span_id", F.nullif("s.parentSpanId", F.lit(""))), ("otlp.status.code", F.nullif("s.status.code", F.lit(0))), ("otlp.status.message", F.nullif("s.status.message", F.lit(""))), ("response.status", status)]
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("variant").alias("value")) for k, v in extra]), lambda e: e["value"].isNotNull())
    names = F.transform(entries, lambda e: e["key"])
    attributes = F.map_concat(F.map_filter("a", lambda k, _: ~F.array_contains(names, k)), F.map_from_entries(entries))
    order = F.struct("p1", "p2", "p3")
    s = s.withColumn("attributes", attributes).withColumn("ordinal", F.row_number().over(Window.partitionBy("file", "record").orderBy(order)).cast("bigint") - 1)
    name = F.coalesce(F.nullif(F.coalesce(service(F.col("a")), service(F.col("resource"))), F.lit("")), F.lit("unknown-service"))
    start = F.col("s.startTimeUnixNano")
    own = F.coalesce(F.nullif("s.spanId", F.lit("")), F.concat_ws(":", name, "s.name", start))
    trace = F.coalesce(F.nullif("s.traceId", F.lit("")), F.concat_ws("#", "file", F.nullif("record", F.lit(""))))
    return s.select(
        "file", "record", "p1", "p2", "p3", trace.alias("trace_id"), "ordinal", own.alias("span_id"), F.nullif("s.parentSpanId", F.lit("")).alias("parent_span_id"),
        F.col("s.name").alias("name"), name.alias("service"), start.alias("start_text"), F.col("s.endTimeUnixNano").alias("end_text"), "attributes",
    )


def _otlp_spans():
    """Spans of a file as a number."""
    scopes = F.coalesce(F.flatten(F.transform("resourceSpans", lambda r: F.coalesce(r["scopeSpans"], F.array()))), F.array())
    return F.aggregate(scopes, F.lit(0), lambda n, c: n + F.coalesce(F.size(c["spans"]), F.lit(0)))


def otlp_stats(spark: SparkSession, path: str) -> DataFrame:
    """Per file: file, resource_spans, total_spans. Spans by service and operation are :func:`spanflow.operators.report.by_service` and ``by_operation`` over :func:`read_otlp`."""
    raw = spark.read.schema(OTLP).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("file"), "resourceSpans")
    return raw.select("file", F.coalesce(F.size("resourceSpans"), F.lit(0)).alias("resource_spans"), _otlp_spans().alias("total_spans"))


def otlp_check(spark: SparkSession, path: str) -> DataFrame:
    """Per file whether it is valid OTLP: file, ok, reason."""
    raw = spark.read.schema(OTLP).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("file"), "resourceSpans")
    reason = F.when(F.coalesce(F.size("resourceSpans"), F.lit(0)) <= 0, "no resourceSpans").when(_otlp_spans() <= 0, "no spans").otherwise("")
    return raw.select("file", (reason == "").alias("ok"), reason.alias("reason"))
