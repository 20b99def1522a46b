"""Names, paths and attribute values, as Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Verbs that a raw operation name may begin with.
HTTP_VERBS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"]
#: Parts of a name that tell a creating operation.
CREATING = ["create", "post", "insert", "add"]
#: Variables that every flow starts with.
INITIAL_VARIABLES = ["customerId", "orderItems", "totalAmount", "userId", "requestId"]
VARIABLE = r"\$\{\s*([a-zA-Z_][\w\-\.]*)\s*\}"


def normalize(c: Column) -> Column:
    return F.trim(F.lower(c))


def split_call(call: Column, trim: bool = True) -> tuple[Column, Column]:
    """Service and operation of ``service.operation``; without a point both are null, or
    (``trim`` off, as for graph nodes) the operation is empty."""
    parts = F.split(F.trim(call) if trim else call, r"\.", 2)
    if trim:
        ok = F.size(parts) == 2
        return F.when(ok, parts[0]), F.when(ok, parts[1])
    return parts[0], F.coalesce(F.get(parts, F.lit(1)), F.lit(""))


def capitalized(s: Column, rest_lower: bool) -> Column:
    rest = F.substring(s, 2, 2**31 - 1)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(rest) if rest_lower else rest)


def lower_first(s: Column) -> Column:
    return F.concat(F.lower(F.substring(s, 1, 1)), F.substring(s, 2, 2**31 - 1))


def words(s: Column) -> Column:
    return F.filter(F.split(s, r"\s+"), lambda x: x != "")


def pascalize(s: Column) -> Column:
    """Separators - _ . and spaces begin a word; the rest of a word is lowered."""
    return F.array_join(F.transform(words(F.regexp_replace(s, r"[-_.]", " ")), lambda x: capitalized(x, True)), "")


def pascal_keep(s: Column) -> Column:
    """Words of a string joined, each with its first letter raised and the rest as it is."""
    return F.array_join(F.transform(words(s), lambda x: capitalized(x, False)), "")


def service_alias(name: Column) -> Column:
    out = lower_first(pascal_keep(F.regexp_replace(name, "[^a-zA-Z0-9]+", " ")))
    return F.when(F.coalesce(out, F.lit("")) == "", "service").otherwise(out)


def url_path(url: Column) -> Column:
    """A path as it is; of a full URL what follows the host, without query and fragment."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    path = F.regexp_extract(rest, r"(?s)(/[^?#]*)", 1)
    return (
        F.when(F.coalesce(url, F.lit("")) == "", "")
        .when(url.startswith("/"), url)
        .when(url.contains("://"), F.when(rest.contains("/"), path).otherwise("/"))
        .otherwise(url)
    )


def http_operation(method: Column, route: Column) -> Column:
    """get + Plain + Segments + ByParameters; parameters stand after all plain segments."""
    tokens = F.filter(F.split(route, "/"), lambda x: x != "")
    braced = lambda x: x.startswith("{") & x.endswith("}")
    colon = lambda x: x.startswith(":") & (F.length(x) > 1)
    plain = F.transform(F.filter(tokens, lambda x: ~braced(x) & ~colon(x)), lambda x: pascalize(x))
    by = F.transform(F.filter(tokens, lambda x: braced(x) | colon(x)), lambda x: F.concat(F.lit("By"), pascalize(F.when(braced(x), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(F.substring(x, 2, 2**31 - 1)))))
    plain = F.when(F.size(plain) == 0, F.array(F.lit("Root"))).otherwise(plain)
    verb = F.lower(F.trim(method))
    out = F.regexp_replace(F.concat(verb, F.array_join(plain, ""), F.array_join(by, "")), "[^a-zA-Z0-9_]", "")
    return F.when(out == "", F.concat(verb, F.lit("Op"))).otherwise(out)


def operation_id(name: Column, http_method: Column, http_route: Column, http_target: Column, http_url: Column, rpc_method: Column) -> Column:
    """HTTP method and route first, then the RPC method, then the span's name."""
    blank = lambda c: F.nullif(c, F.lit(""))
    route = F.coalesce(blank(http_route), blank(http_target), blank(url_path(http_url)))
    method = F.upper(blank(http_method))
    named = r"^([A-Z]+)\s+(/.*)$"
    trimmed = F.trim(name)
    camel = lambda c: lower_first(pascalize(c))
    return (
        F.when(method.isNotNull() & route.isNotNull(), http_operation(method, route))
        .when(trimmed.rlike(named), http_operation(F.regexp_extract(trimmed, named, 1), F.regexp_extract(trimmed, named, 2)))
        .when(blank(rpc_method).isNotNull(), camel(rpc_method))
        .otherwise(camel(name))
    )


def raw_operation_id(raw: Column) -> Column:
    """An operation id from a raw name: verb and path, or the tail after the last . or /, or the words."""
    s = F.trim(raw)
    verb = F.regexp_extract(s, rf"(?i)^({'|'.join(HTTP_VERBS)}) ", 1)
    segments = F.filter(F.transform(F.split(F.trim(F.substring(s, F.length(verb) + 2, F.lit(2**31 - 1))), "/"), lambda x: F.trim(x)), lambda x: x != "")
    part = lambda x: (
        F.when(x.startswith("{") & x.endswith("}"), F.concat(F.lit("By"), pascal_keep(F.regexp_replace(x, r"^[{}]+|[{}]+$", ""))))
        .when(x.startswith(":"), F.concat(F.lit("By"), pascal_keep(F.substring(x, 2, 2**31 - 1))))
        .otherwise(pascal_keep(x))
    )
    tail = F.when(s.rlike(r"[./][^./]+$"), F.regexp_extract(s, r"[./]([^./]+)$", 1)).otherwise(s)
    camel = lower_first(pascal_keep(F.regexp_replace(tail, "[^a-zA-Z0-9]+", " ")))
    return (
        F.when(F.coalesce(s, F.lit("")) == "", "op")
        .when(verb != "", F.concat(F.lower(verb), F.array_join(F.transform(segments, part), "")))
        .otherwise(camel)
    )


def service_file_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9_-]", "_")


def identifier(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-zA-Z0-9_]", "_")


def sanitized_operation(name: Column) -> Column:
    return lower_first(F.regexp_replace(name, "[^a-zA-Z0-9]", ""))


def field_name(key: Column) -> Column:
    return F.element_at(F.split(key, r"\."), -1)


def string_attr(attributes: Column, key: str) -> Column:
    """The attribute if it is a string, else null (``attributes`` is a map of VARIANT)."""
    v = F.get(F.array(attributes.getItem(key)), F.lit(0))
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def span_identity(service: Column, name: Column, start: Column, span_id: Column) -> Column:
    return F.coalesce(span_id, F.concat_ws(":", service, name, start.cast("string")))


def inferred_status(http_status: Column, status_code: Column, name: Column) -> Column:
    """The HTTP status, else for status code 1 what the name lets expect."""
    low = F.lower(name)
    creates = low.contains(CREATING[0])
    for part in CREATING[1:]:
        creates = creates | low.contains(part)
    return F.coalesce(http_status, F.when(status_code == 1, F.when(creates, 201).otherwise(200)))


def variable_references(values: Column) -> Column:
    """Distinct variable names in a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(values, F.lit(VARIABLE), F.lit(1))))


def has_telemetry_prefix(key: Column) -> Column:
    return F.lower(key).rlike(r"^(http|otel|span)\.")


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))
