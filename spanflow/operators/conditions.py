"""Pre- and postconditions as structured predicates: {path, op, literal} with and, or, not.

A predicate is compiled to one Column of three values: true, false, and null for what
cannot be evaluated (a missing value, a wrong type, an unknown root), which becomes SKIP."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"
#: Attributes that give response.status, first found wins.
STATUS_KEYS = ["response.status", "http.status_code", "statusCode"]


def attribute(name: str) -> Column:
    return F.get(F.map_values(F.map_filter(F.col("attributes"), lambda k, _: k == name)), F.lit(0))


def lookup(path: str) -> Column:
    """The VARIANT at a path: request.body (the step's input), response.status, response.body, span, or null."""
    root, _, rest = path.partition(".")
    if root == "request" and rest.split(".")[0] == "body":
        found, rest = F.col("input"), rest.partition(".")[2]
    elif path == "response.status":
        return F.coalesce(*[attribute(k) for k in STATUS_KEYS], F.lit(0).cast("variant"))
    elif root == "response" and rest.split(".")[0] == "body":
        found, rest = F.coalesce(attribute("response.body"), F.to_variant_object(F.col("attributes"))), rest.partition(".")[2]
    elif root == "span" and rest.split(".")[0] == "attributes":
        key, _, rest = rest.partition(".")[2].partition(".")
        found = attribute(key)
    elif root == "span" and rest in ("name", "service", "start_ns", "end_ns"):
        return F.col(rest).cast("variant")
    else:
        return F.lit(None).cast("variant")
    if not rest:
        return found
    return F.try_variant_get(found, "$" + "".join(f"['{p}']" for p in rest.split(".")), "variant")


def compiles(pattern: Column) -> Column:
    """The pattern if it is a valid one, else null: what cannot be compiled makes its own condition SKIP and stops nothing."""
    return F.when(F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull(), pattern)


def compare(path: str, op: str, literal: Any) -> Column:
    """Values of different types are unequal and cannot be ordered; numbers compare as numbers."""
    value = lookup(path)
    kind = F.schema_of_variant(value)
    if op == "has":
        return F.when(F.lit(path.split(".")[0] in ("request", "response", "span")), value.isNotNull())
    if op == "size_gt":
        return F.when(kind.startswith("ARRAY"), F.size(F.try_variant_get(value, "$", "array<variant>")) > literal).when(kind == "STRING", F.length(F.try_variant_get(value, "$", "string")) > literal)
    if op == "matches":
        return F.when(kind == "STRING", F.regexp_like(F.try_variant_get(value, "$", "string"), compiles(F.lit(literal))))
    if isinstance(literal, bool):
        same, value = kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean")
    elif isinstance(literal, (int, float)):
        same, value = kind.rlike(_NUMBER), F.try_variant_get(value, "$", "double")
    else:
        same, value = kind == "STRING", F.try_variant_get(value, "$", "string")
    result = {"eq": value == literal, "ne": value != literal, "lt": value < literal, "le": value <= literal, "gt": value > literal, "ge": value >= literal}[op]
    unlike = {"eq": F.lit(False), "ne": F.lit(True)}.get(op, F.lit(None).cast("boolean"))
    return F.when(kind.isNotNull(), F.when(same, result).otherwise(unlike))


def predicate(spec: dict | tuple) -> Column:
    """{"and"|"or": [...]}, {"not": ...} or (path, op, literal)."""
    if isinstance(spec, tuple):
        return compare(*spec)
    ((name, inner),) = spec.items()
    if name == "not":
        return ~predicate(inner)
    parts = [predicate(p) for p in inner]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if name == "and" else out | p
    return out


def results(conditions: list[tuple]) -> Column:
    """An array of (kind, condition, result) of a row with ``attributes`` and ``input``; each of (kind, name, path, op, literal) is compiled once."""
    out = []
    for kind, name, path, op, literal in conditions:
        p = compare(path, op, literal)
        out.append(F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("condition"), F.when(p.isNull(), "SKIP").when(p, "PASS").otherwise("FAIL").alias("result")))
    return F.array(*out)


def failing(found: Column) -> Column:
    """Whether one of the :func:`results` is FAIL; false where there are none."""
    return F.coalesce(F.exists(found, lambda r: r["result"] == "FAIL"), F.lit(False))


def with_results(matched: DataFrame, conditions: list[tuple], where: Column | None = None) -> DataFrame:
    """``matched`` with ``results`` in place of ``attributes`` and ``input``; null where ``where`` does not hold. Steps and conditions can both be
    read from it without a join."""
    if "input" not in matched.columns:
        matched = matched.withColumn("input", F.lit(None).cast("variant"))
    found = results(conditions)
    return matched.withColumn("results", found if where is None else F.when(where, found)).drop("attributes", "input")


def evaluate(matched: DataFrame, conditions: list[tuple]) -> DataFrame:
    """Conditions of matched spans: the rows of ``matched`` (with ``attributes``, and ``input`` where known) times
    (kind, name, path, op, literal), as kind, name and result PASS, FAIL or SKIP."""
    r = with_results(matched, conditions)
    return r.select(*[c for c in r.columns if c != "results"], F.inline("results"))


_OPERATORS = {"==": "eq", "!=": "ne", "<=": "le", ">=": "ge", "<": "lt", ">": "gt"}


def _forms(group: str) -> dict[str, str]:
    """The forms of literals that are read: has(path), size(path) > number, path =~ /pattern/, a comparison of a path with a value. ``group`` opens their parts."""
    path = rf"{group}[A-Za-z_][\w.]*)"
    return {
        "has": rf"has\(\s*{path}\s*\)",
        "size_gt": rf"size\(\s*{path}\s*\)\s*>\s*{group}\d+)",
        "matches": rf"{path}\s*=~\s*/{group}[^/]+)/",
        "compare": rf"{path}\s*{group}==|!=|<=|>=|<|>)\s*{group}'[^']*'|\"[^\"]*\"|-?\d+(?:\.\d+)?|true|false)(?![\w.])",
    }


_FORMS = _forms("(")
#: A literal can be negated or in parentheses. A condition is ors of ands, with parentheses around ands or without, or ands of ors in parentheses.
_ATOM = "(?:" + "|".join(_forms("(?:").values()) + ")"
_LITERAL = rf"(?:!\s*has\([^)]*\)|!\s*\(\s*{_ATOM}\s*\)|\(\s*{_ATOM}\s*\)|{_ATOM})"
_AND, _OR = (rf"{_LITERAL}(?:\s*{op}\s*{_LITERAL})*" for op in ("&&", r"\|\|"))
_TERM, _FACTOR = (rf"(?:\(\s*{inner}\s*\)|{outer})" for inner, outer in ((_AND, _AND), (_OR, _LITERAL)))
_ORS, _ANDS = rf"^\s*{_TERM}(?:\s*\|\|\s*{_TERM})*\s*$", rf"^\s*{_FACTOR}(?:\s*&&\s*{_FACTOR})*\s*$"


def _literal(text: Column) -> Column:
    """One literal's text as struct(negated, path, op, literal, type)."""
    inner = F.regexp_replace(text, r"^!\s*", "")
    atom = F.when(inner.startswith("("), F.regexp_replace(inner, r"^\(\s*|\s*\)$", "")).otherwise(inner)
    part = lambda form, k: F.regexp_extract(atom, f"^{_FORMS[form]}$", k)
    value = part("compare", 3)
    op = F.element_at(F.create_map(*[F.lit(x) for pair in _OPERATORS.items() for x in pair]), part("compare", 2))
    kind = F.when(value.rlike("^['\"]"), "string").when(value.isin("true", "false"), "boolean").otherwise("number")
    row = lambda path, op, literal, kind: F.struct(text.startswith("!").alias("negated"), path.alias("path"), op.alias("op"), literal.alias("literal"), kind.alias("type"))
    return (
        F.when(atom.rlike(f"^{_FORMS['has']}$"), row(part("has", 1), F.lit("has"), F.lit(None).cast("string"), F.lit("string")))
        .when(atom.rlike(f"^{_FORMS['size_gt']}$"), row(part("size_gt", 1), F.lit("size_gt"), part("size_gt", 2), F.lit("number")))
        .when(atom.rlike(f"^{_FORMS['matches']}$"), row(part("matches", 1), F.lit("matches"), compiles(part("matches", 2)), F.lit("string")))
        .otherwise(row(part("compare", 1), op, F.when(kind == "string", F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value), kind))
    )


def parsed(expression: Column) -> Column:
    """A condition's text as struct(any, clauses): clauses are arrays of literals (negated, path, op, literal, type). With ``any`` one clause must hold, of
    which all literals hold, else all clauses, of each of which one literal holds. Null for other forms, whose result is SKIP."""
    of = lambda outer: F.transform(F.regexp_extract_all(expression, F.lit(outer), F.lit(0)), lambda c: F.transform(F.regexp_extract_all(c, F.lit(_LITERAL), F.lit(0)), _literal))
    return F.when(expression.rlike(_ORS), F.struct(F.lit(True).alias("any"), of(_TERM).alias("clauses"))).when(expression.rlike(_ANDS), F.struct(F.lit(False).alias("any"), of(_FACTOR).alias("clauses")))


def decided(p: Column) -> Column:
    """The value of a :func:`parsed` condition in three-valued logic: what cannot be evaluated counts only where the rest does not decide."""

    def one(x: Column) -> Column:
        value = holds(x["path"], x["op"], x["literal"], x["type"])
        return F.when(x["negated"] == p["any"], ~value).otherwise(value)

    # All of some are any of others, denied: all clauses hold unless in one of them every literal fails.
    found = F.exists(p["clauses"], lambda c: F.forall(c, one))
    return F.when(p["any"], found).when(~p["any"], ~found)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def lookup_by(path: Column) -> Column:
    """:func:`lookup` for a path that is a column."""
    rest = lambda n: F.substring(path, n + 1 if isinstance(n, int) else n + F.lit(1), F.length(path))
    at = lambda v, name: F.when(name == "", v).otherwise(F.try_variant_get(v, F.concat(F.lit("$['"), F.replace(name, F.lit("."), F.lit("']['")), F.lit("']")), "variant"))
    body = F.coalesce(attribute("response.body"), F.to_variant_object(F.col("attributes")))
    field = F.when(path == "span.name", F.col("name").cast("variant")).when(path == "span.service", F.col("service").cast("variant"))
    for time in ("start_ns", "end_ns"):
        field = field.when(path == f"span.{time}", F.col(time).cast("variant"))
    name = F.split_part(path, F.lit("."), F.lit(3))  # the key; what follows is looked up in its value
    key = F.try_element_at(F.col("attributes"), name)
    under = lambda root: (path == root) | path.startswith(root + ".")
    return (
        F.when(path == "response.status", F.coalesce(*[attribute(k) for k in STATUS_KEYS], F.lit(0).cast("variant")))
        .when(under("response.body"), at(body, rest(len("response.body."))))
        .when(under("request.body"), at(F.col("input"), rest(len("request.body."))))
        .when(path.startswith("span.attributes."), at(key, rest(len("span.attributes.") + F.length(name) + 1)))
        .otherwise(field)
    )


def holds(path: Column, op: Column, literal: Column, kind: Column) -> Column:
    """:func:`compare` for predicates that are rows and not values of the program."""
    return _let(lookup_by(path), lambda value: _let(F.schema_of_variant(value), lambda found: _holds(value, found, path, op, literal, kind)))


def _holds(value: Column, found: Column, path: Column, op: Column, literal: Column, kind: Column) -> Column:
    def ordered(x: Column, y: Column) -> Column:
        return F.when(op == "eq", x == y).when(op == "ne", x != y).when(op == "lt", x < y).when(op == "le", x <= y).when(op == "gt", x > y).when(op == "ge", x >= y)

    text = F.try_variant_get(value, "$", "string")
    size = F.when(found.startswith("ARRAY"), F.size(F.try_variant_get(value, "$", "array<variant>"))).when(found == "STRING", F.length(text))
    number = ordered(F.try_variant_get(value, "$", "double"), literal.try_cast("double"))
    same = F.when(kind == "number", F.when(found.rlike(_NUMBER), number)).when(kind == "boolean", F.when(found == "BOOLEAN", ordered(F.try_variant_get(value, "$", "boolean"), literal.try_cast("boolean")))).otherwise(F.when(found == "STRING", ordered(text, literal)))
    unlike = F.when(op == "eq", False).when(op == "ne", True)
    return (
        F.when(op == "has", F.when(F.substring_index(path, ".", 1).isin("request", "response", "span"), value.isNotNull()))
        .when(op == "size_gt", size > literal.try_cast("int"))
        .when(op == "matches", F.when(found == "STRING", F.regexp_like(text, literal)))
        .otherwise(F.when(found.isNotNull(), F.coalesce(same, unlike)))
    )


def by_operation(matched: DataFrame, table: DataFrame) -> DataFrame:
    """Conditions of the operation that each row of ``matched`` calls: its columns but attributes and input, and kind, condition, result.

    ``matched``: flow_id, call, attributes, service, name, start_ns, end_ns, and input where known. ``table``: flow_id,
    service, operation, kind, condition and expression, of all contracts; names must agree in case. An equi-join; contracts are
    broadcast only where Spark finds them small."""
    if "input" not in matched.columns:
        matched = matched.withColumn("input", F.lit(None).cast("variant"))
    table = table.select("flow_id", F.concat_ws(".", F.trim("service"), F.trim("operation")).alias("_call"), "kind", "condition", parsed(F.col("expression")).alias("p"))
    p = decided(F.col("p"))
    keep = [c for c in matched.columns if c not in ("attributes", "input", "service", "name", "start_ns", "end_ns")]
    found = matched.withColumn("_call", F.trim("call")).join(table, ["flow_id", "_call"])
    result = _let(p, lambda held: F.when(held.isNull(), "SKIP").when(held, "PASS").otherwise("FAIL"))
    return found.select(*keep, "kind", "condition", result.alias("result"))
