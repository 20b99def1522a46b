"""Matching of a stream of spans, step by step: what is kept of a trace is bounded by its contract, not by its spans."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanflow.operators import conditions
from spanflow.operators.match import MISSING, SEMANTIC, SKIPPED, is_call

_OUT = "trace_id string, pos int, step string, call string, status string, span_id string, note string, conditions string"
_CONDITIONS = "array<struct<kind:string,condition:string,result:string>>"
#: Rows of state. A call of Python for each costs some ten milliseconds, a span in it some microseconds.
SHARDS = 1024


def taken(state: dict, span_id: str, hits: list[int], results: str | None) -> None:
    """The next span of a trace, in order of time: the first open step that it matches takes it, and later steps, which must come after, are open again.

    ``state``: n (spans so far), steps ({position: [place, place of the step before, span id, results]})."""
    state["n"] += 1
    steps = state["steps"]
    for k in hits:
        if str(k) not in steps:
            before = max((s[0] for j, s in steps.items() if int(j) < k), default=0)
            state["steps"] = {j: s for j, s in steps.items() if int(j) < k} | {str(k): [state["n"], before, span_id, results]}
            return


def match_stream(spans: DataFrame, steps: list[tuple], rules: list[tuple] = (), gap: str = "5 minutes", late: str = "10 minutes", time_col: str = "ts", shards: int = SHARDS) -> DataFrame:
    """A stream of spans to one row per step of each finished trace: trace_id, pos, step, call, status, span_id, note, conditions.

    The results are those of :func:`match.time_sequence` with ``rules`` evaluated on the matched spans (:func:`conditions.results`; a step that
    breaks one is FAIL). Spans are taken in order of time once the watermark (``late`` behind the newest) has passed them; until then a trace keeps
    their places, ids and condition results. Of what has passed, it keeps a count and one span a step. A trace ends when the watermark is ``gap`` beyond its last
    span; later spans of it begin it anew, and spans behind the watermark are dropped by Spark. The state lives in the query's checkpoint: a row
    a shard of traces (``shards``, by hash; a checkpoint keeps the number it began with), so that Python is called by shard and not by trace."""
    hit = F.array_compact(F.array(*[F.when(is_call(call), F.lit(str(k))) for k, (_, _, _, call) in enumerate(steps)]))
    s = spans.withColumn("hits", hit)
    found = F.lit(None).cast(_CONDITIONS)
    if rules:
        if "input" not in s.columns:
            s = s.withColumn("input", F.lit(None).cast("variant"))
        found = F.when(F.size("hits") > 0, conditions.results(list(rules)))
    s = s.withColumn("results", F.to_json(found)).withWatermark(time_col, late)
    s = s.select(F.pmod(F.xxhash64("trace_id"), F.lit(shards)).alias("shard"), "trace_id", time_col, "start_ns", "ordinal", "span_id", F.array_join("hits", ",").alias("hits"), "results")
    wait = pd.Timedelta(gap).value // 10**6
    names = [c.split()[0] for c in _OUT.split(", ")]

    def finished(trace_id: str | None, state: dict) -> Iterator[tuple]:
        for k, (pos, _, name, call) in enumerate(steps):
            place, before, span_id, results = state["steps"].get(str(k), (None, None, None, None))
            broken = any(r["result"] == "FAIL" for r in json.loads(results)) if results else False
            note = MISSING if place is None else SEMANTIC if broken else f"{SKIPPED[0]}{place}{SKIPPED[1]}" if place > before + 1 else ""
            yield trace_id, pos, name, call, "FAIL" if place is None or broken else "PASS", span_id, note, results

    def step(_key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        traces = {t: state for t, state in json.loads(group.get[0])} if group.exists else {}
        new = set()
        for rows in [] if group.hasTimedOut else batches:
            at = rows[time_col].astype("int64") // 10 ** (6 if rows[time_col].dtype == "datetime64[ns]" else 3)
            columns = (c.tolist() for c in (rows["trace_id"], at, rows["start_ns"], rows["ordinal"], rows["span_id"], rows["hits"], rows["results"]))
            for trace_id, t, start, ordinal, span_id, hits, results in zip(*columns, strict=True):
                state = traces.setdefault(trace_id, {"n": 0, "steps": {}, "open": [], "last": 0, "until": 0})
                state["open"].append([t, start, ordinal, span_id, hits, results])
                state["last"] = max(state["last"], t)
                new.add(trace_id)
        now, out = group.getCurrentWatermarkMs(), []
        for trace_id, state in list(traces.items()):
            if trace_id not in new and state["until"] >= now:
                continue
            state["open"].sort(key=lambda r: (r[1], r[2]))
            left = []
            for row in state["open"]:
                if trace_id not in new or (not left and row[0] < now):  # nothing that comes can be before it
                    taken(state, row[3], [int(h) for h in row[4].split(",")] if row[4] else [], row[5])
                else:
                    left.append(row)
            state["open"], state["until"] = left, max(state["last"] + wait, now + 1)
            if trace_id not in new:
                out += finished(trace_id, traces.pop(trace_id))
        if traces:
            group.update((json.dumps(list(traces.items())),))
            group.setTimeoutTimestamp(min(state["until"] for state in traces.values()))
        elif group.exists:
            group.remove()
        if out:
            yield pd.DataFrame(out, columns=names)

    rows = s.groupBy("shard").applyInPandasWithState(step, _OUT, "state string", "append", GroupStateTimeout.EventTimeTimeout)
    return rows.withColumn("conditions", F.from_json("conditions", _CONDITIONS))
