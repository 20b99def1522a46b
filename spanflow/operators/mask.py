"""Masking of attributes by an ordered policy, compiled to one CASE chain, or by tables of rules of many tenants."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanflow.operators.conditions import compiles

REDACTED = "***REDACTED***"
#: The built-in policy. First match wins.
DEFAULT_POLICY = {
    "version": 1,
    "globals": {
        "strategies": {
            "email": {"type": "keep-prefix", "prefixLen": 2, "mask": "*"},
            "phone": {"type": "redact"},
            "id": {"type": "hash", "algo": "sha256", "salt": "default-salt"},
            "secret": {"type": "redact"},
        }
    },
    "rules": [
        {"match": {"regexKeys": ["(?i)email"]}, "strategy": "email"},
        {"match": {"regexKeys": ["(?i)phone", "(?i)mobile", "(?i)tel"]}, "strategy": "phone"},
        {"match": {"regexKeys": ["(?i)id$", "(?i).*id$"]}, "strategy": "id"},
        {"match": {"regexKeys": ["(?i)password", "(?i)secret", "(?i)token", "(?i)key"]}, "strategy": "secret"},
    ],
}


def masked(value: Column, is_string: Column, strategy: dict[str, Any]) -> Column:
    """The value under one strategy. Redact and null take any type; others leave what is not a string as it is."""
    kind = strategy["type"]
    if kind == "redact":
        return F.lit(REDACTED)
    if kind == "null":
        return F.lit(None).cast("string")
    if kind == "keep-prefix":
        n = strategy["prefixLen"]
        rest = F.greatest(F.length(value) - n, F.lit(0))
        out = F.when(F.length(value) <= n, value).otherwise(F.concat(F.substring(value, 1, n), F.repeat(F.lit(strategy["mask"]), rest)))
    else:
        digest = F.sha2(F.concat(value, F.lit(strategy.get("salt") or "")), 256)
        out = digest if kind == "hash" else F.concat(F.lit(strategy["tokenPrefix"]), F.substring(digest, 1, 8))
    return F.when(is_string, out).otherwise(value)


def compiled(policy: dict[str, Any], tag_policy: str = "match_all") -> list[tuple[dict, dict]]:
    """Checked (selector, strategy) pairs in order. A rule with only a tag matches all, or is left out ("ignore")."""
    if policy.get("version") != 1:
        raise ValueError("a policy's version must be 1")
    named, out = policy.get("globals", {}).get("strategies", {}), []
    for rule in policy.get("rules", []):
        s = rule["strategy"]
        if isinstance(s, str):
            if s not in named:
                raise ValueError(f"unknown strategy {s}")
            s = named[s]
        kind = s.get("type")
        if kind not in ("redact", "null", "keep-prefix", "hash", "tokenize"):
            raise ValueError(f"unknown strategy type {kind}")
        if kind == "keep-prefix" and (s.get("prefixLen", 0) <= 0 or not s.get("mask")):
            raise ValueError("keep-prefix needs prefixLen above 0 and a mask")
        if kind == "hash" and s.get("algo", "sha256") not in ("", "sha256"):
            raise ValueError("only sha256 is supported")
        if kind == "tokenize" and not s.get("tokenPrefix"):
            raise ValueError("tokenize needs a tokenPrefix")
        match = rule.get("match", {})
        for r in match.get("regexKeys", []):
            re.compile(r)
        if tag_policy == "ignore" and set(match) == {"tag"}:
            continue
        out.append((match, s))
    return out


def selects(match: dict[str, Any], service: Column, operation: Column, key: Column) -> Column:
    """All given parts of a selector must hold: service, operation, one of the paths (whole, or as suffix), one of the patterns."""
    ok = F.lit(True)
    if match.get("service"):
        ok = ok & (service == match["service"])
    if match.get("operation"):
        ok = ok & (operation == match["operation"])
    for name, test in (("paths", lambda p: (key == p) | key.endswith("." + p)), ("regexKeys", key.rlike)):
        if match.get(name):
            hit = F.lit(False)
            for p in match[name]:
                hit = hit | test(p)
            ok = ok & hit
    return F.coalesce(ok, F.lit(False))


def rule_match(attributes: DataFrame, policy: dict[str, Any], tag_policy: str = "match_all") -> DataFrame:
    """``attributes`` (service, operation, key, ...) with ``rule``, the place of the first rule that selects it (-1: none)."""
    out = F.lit(-1)
    for k, (match, _) in reversed(list(enumerate(compiled(policy, tag_policy)))):
        out = F.when(selects(match, F.col("service"), F.col("operation"), F.col("key")), F.lit(k)).otherwise(out)
    return attributes.withColumn("rule", out)


def apply(attributes: DataFrame, policy: dict[str, Any], tag_policy: str = "match_all") -> DataFrame:
    """``attributes`` with ``rule`` and ``masked``; what no rule selects stays."""
    found = rule_match(attributes, policy, tag_policy)
    out = F.col("value")
    for k, (_, strategy) in enumerate(compiled(policy, tag_policy)):
        out = F.when(F.col("rule") == k, masked(F.col("value"), F.col("is_string"), strategy)).otherwise(out)
    return found.withColumn("masked", out)


_STRATEGY = "struct<type:string,prefixLen:int,mask:string,salt:string,tokenPrefix:string>"
RULES = f"tenant string, rule int, service string, operation string, path string, patterns array<string>, strategy {_STRATEGY}"
#: Stands for a part of a selector that is not given.
_ANY = "*"


def rule_rows(policies: dict[str, dict[str, Any]], tag_policy: str = "match_all") -> list[tuple]:
    """Policies of many tenants as rows of RULES, one a path of a rule, for :func:`apply_rules`."""
    out = []
    for tenant, policy in policies.items():
        for k, (match, s) in enumerate(compiled(policy, tag_policy)):
            strategy = (s["type"], s.get("prefixLen"), s.get("mask"), s.get("salt") or "", s.get("tokenPrefix"))
            out += [(tenant, k, match.get("service") or _ANY, match.get("operation") or _ANY, path, list(match.get("regexKeys") or []), strategy) for path in match.get("paths") or [_ANY]]
    return out


def masked_by(value: Column, is_string: Column, s: Column) -> Column:
    """:func:`masked` for a strategy that is a column."""
    digest = F.sha2(F.concat(value, s["salt"]), 256)
    prefix = F.when(F.length(value) <= s["prefixLen"], value).otherwise(F.concat(F.substring(value, F.lit(1), s["prefixLen"]), F.repeat(s["mask"], F.greatest(F.length(value) - s["prefixLen"], F.lit(0)))))
    text = F.when(s["type"] == "keep-prefix", prefix).when(s["type"] == "hash", digest).when(s["type"] == "tokenize", F.concat(s["tokenPrefix"], F.substring(digest, 1, 8)))
    return F.when(s["type"] == "redact", REDACTED).when(s["type"] == "null", F.lit(None).cast("string")).when(is_string & text.isNotNull(), text).otherwise(value)


def rules_of_keys(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """The first rule that selects each of ``keys`` (tenant, service, operation, key; distinct): these columns, rule and strategy; none where no rule does.

    A key can be meant by itself, by each of its dotted suffixes or by any path, in its service and operation or in any: a few rows, which meet the rules
    by equal columns. Patterns are tried only on what has met. One that does not compile selects nothing. The plan is the same for any number of rules."""
    parts = F.split("key", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    anyone = lambda c: F.array_distinct(F.array(F.col(c), F.lit(_ANY)))
    k = keys.withColumn("path", F.explode(F.array_distinct(F.concat(suffixes, F.array(F.lit(_ANY))))))
    k = k.withColumn("of_service", F.explode(anyone("service"))).withColumn("of_operation", F.explode(anyone("operation")))
    r = rules.withColumnsRenamed({"service": "of_service", "operation": "of_operation"}).withColumn("patterns", F.transform("patterns", compiles))
    hit = (F.size("patterns") == 0) | F.exists("patterns", lambda p: F.coalesce(F.regexp_like(F.col("key"), p), F.lit(False)))
    found = k.join(r, ["tenant", "of_service", "of_operation", "path"]).where(hit)
    return found.groupBy("tenant", "service", "operation", "key").agg(F.min_by(F.struct("rule", "strategy"), "rule").alias("r")).select("tenant", "service", "operation", "key", "r.*")


def apply_rules(attributes: DataFrame, rules: DataFrame) -> DataFrame:
    """:func:`apply` by a table of rules (RULES) of many tenants: ``attributes`` (tenant, service, operation, key, value, is_string, ...) with ``rule`` and ``masked``.

    Rules are found once for each distinct key, not for each attribute."""
    by = ["tenant", "service", "operation", "key"]
    found = rules_of_keys(attributes.select(*by).distinct(), rules)
    same = [attributes[c].eqNullSafe(found[c]) for c in by]
    j = attributes.join(found, same, "left").select(attributes["*"], F.coalesce(found["rule"], F.lit(-1)).alias("rule"), found["strategy"].alias("_strategy"))
    out = F.when(F.col("rule") >= 0, masked_by(F.col("value"), F.col("is_string"), F.col("_strategy"))).otherwise(F.col("value"))
    return j.withColumn("masked", out).drop("_strategy")


def apply_to_spans(spans: DataFrame, policy: dict[str, Any], tag_policy: str = "match_all") -> DataFrame:
    """Spans with ``attributes`` (map of string to VARIANT) masked in place: top-level keys only, no shuffle."""
    rules = compiled(policy, tag_policy)

    def one(key: Column, value: Column) -> Column:
        is_string = F.schema_of_variant(value) == "STRING"
        text = F.try_variant_get(value, "$", "string")
        out = value
        for match, strategy in reversed(rules):
            new = masked(text, is_string, strategy).cast("variant") if strategy["type"] in ("redact", "null") else F.when(is_string, masked(text, is_string, strategy).cast("variant")).otherwise(value)
            out = F.when(selects(match, F.col("service"), F.col("name"), key), new).otherwise(out)
        return out

    return spans.withColumn("attributes", F.transform_values("attributes", one))


def stats(applied: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """Masked attributes per rule: rule, type (service or global, and the strategy's), masked."""
    names = [("service-" if m.get("service") else "global-") + s["type"] for m, s in compiled(policy)]
    kind = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("rule") + 1)
    return applied.where("rule >= 0").groupBy("rule").agg(F.count(F.lit(1)).alias("masked")).select("rule", kind.alias("type"), "masked")


def totals(applied: DataFrame) -> DataFrame:
    """Spans, attributes and masked attributes in one row. ``applied`` has a row for each attribute of a span (its ``ordinal``)."""
    return applied.agg(F.countDistinct("ordinal").alias("spans"), F.count(F.lit(1)).alias("attributes"), F.count_if(F.col("rule") >= 0).alias("masked"))


def preview(applied: DataFrame, n: int) -> DataFrame:
    """The first n attributes before and after."""
    return applied.orderBy("ordinal", "key").limit(n).select("ordinal", "key", F.col("value").alias("before"), F.col("masked").alias("after"))
