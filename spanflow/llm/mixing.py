"""Mixing sources to target weights: subset-sum budget fitting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanflow.llm.common import ranked, written

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """(src, source_size) to (src, source_size, target). Targets are
    min(most * size, x * weight) with the x that makes them sum to ``share`` of all
    sizes: what sharing the excess again and again leads to. Sources sorted by
    most * size / weight are full up to some place, and a running sum finds it.
    It works on one row per source, in one task."""
    everything = Window.orderBy(F.col("src").isNull(), "src")
    w = F.array(*[F.lit(float(x)) for x in weights])
    s = sizes.withColumn("w", F.element_at(w, (F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn("cap", F.col("source_size") * most)
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("src").isNull(), "src")
    full = Window.partitionBy()
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    s = s.withColumn("budget", F.least(F.sum("source_size").over(full) * share, F.sum("cap").over(full)))
    s = s.withColumn("x", (F.col("budget") - F.coalesce(F.sum("cap").over(before), zero)) / (F.sum("w").over(full) - F.coalesce(F.sum("w").over(before), zero)))
    # The first source that x does not fill sets x; before it all are full.
    s = s.withColumn("place", F.when(F.col("cap") / F.col("w") >= F.col("x"), F.row_number().over(by)))
    s = s.withColumn("level", F.min_by("x", "place").over(full))
    return s.select("src", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w"))).alias("target"))


def bits(x: int, n: int) -> np.ndarray:
    """Places of the bits of an integer of ``n`` bits."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(x.to_bytes(-(-n // 8), "little"), np.uint8), bitorder="little"))


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words sum as near
    below the budget as can be. Most of the budget goes evenly over all lengths;
    what is left, at most about the longest length, goes by a bounded
    knapsack over the counts that remain: reachable sums are the bits of one integer, and of each sum the step that
    first reached it is kept, so that memory grows with the longest length alone."""
    take = np.zeros(len(sizes), np.int64)
    total = int((sizes * counts).sum())
    if total <= budget:
        return counts.astype(np.int64)
    if budget <= 0 or total == 0:
        return take
    take = np.array([int(c) * budget // total for c in counts], np.int64)
    left = budget - int((take * sizes).sum())
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes.max())
    for i in order:  # until the rest is small enough for the knapsack
        if left <= 2 * longest or sizes[i] == 0:
            break
        k = min(int(counts[i] - take[i]), (left - longest) // int(sizes[i]))
        take[i] += max(0, k)
        left -= max(0, k) * int(sizes[i])
    mask, reach, steps, first = (1 << (left + 1)) - 1, 1, [], np.zeros(left + 1, np.int32)
    for i in order[::-1]:
        room, size = int(counts[i] - take[i]), int(sizes[i])
        if size == 0 or size > left:
            continue
        room, part = min(room, left // size), 1
        while room > 0 and not reach >> left & 1:  # 1, 2, 4, ... copies express every count
            part = min(part, room)
            new = (reach << (part * size)) & mask & ~reach
            if new:
                steps.append((i, part))
                first[bits(new, left + 1)] = len(steps)
                reach |= new
            room -= part
            part *= 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    while at > 0:  # a sum's first step starts from a sum that an earlier step reached
        i, part = steps[first[at] - 1]
        take[i] += part
        at -= part * int(sizes[i])
    return take


def mix(docs: DataFrame, weights: list[float] = [5, 2, 1], share: float = 1.5, most: float = 2.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:  # noqa: B006
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, times, source, check (a hash of the text).

    Size is the number of words (null text: 0). Sources, by code point and null
    last, weigh ``weights`` repeating; targets share ``share`` of all sizes and stop
    at ``most`` times a source's size (see :func:`targets`). A document is taken
    whole, ``times`` of 0, 1 or 2 (up to ``most``): every source takes all its documents as often
    as fits in the target, then a subset for the rest of it. Documents are counted by exact
    length, :func:`fit` says how many of each length to take, and which ones a seeded
    hash of id and size says, so reruns agree. Documents without words are taken
    never. Repeated rows count as documents of their own; of equal rows it is open
    which is taken. An empty table gives no rows, other columns are ignored.

    Only (id, source, size, check) is shuffled. A source's lengths are at most the square root of
    twice its words in number, so one task can fit a source; ranks in a hot
    length are spread over many tasks."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("src"), word_count(text_col).alias("size"), F.xxhash64(F.col(text_col)).alias("check"))
    d = written(d, "sizes")
    hist = d.groupBy("src", "size").agg(F.count(F.lit(1)).alias("n"))
    goal = targets(hist.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)

    def choose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        target, total = float(rows["target"].iloc[0]), int(rows["source_size"].iloc[0])
        sizes, counts = rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
        base = int(min(target // total, most)) if total else 0
        rows = rows[["src", "size", "source_size", "target"]].copy()
        rows["base"] = base
        rows["more"] = fit(sizes, counts, int(round(target - base * total))) if base < most else 0
        return rows

    same = F.col("h.src").eqNullSafe(F.col("g.src"))
    plan = hist.alias("h").join(goal.alias("g"), same).select("h.src", "size", "n", "source_size", "target")
    plan = plan.groupBy("src").applyInPandas(choose, "src string, size long, source_size long, target double, base int, more long")
    plan = written(plan, "plan").select(F.col("src").alias("p_src"), F.col("size").alias("p_size"), "source_size", "target", "base", "more")
    key = F.struct(F.lit(seed), "doc_id", "size", "check")
    d = d.withColumn("src_key", F.coalesce(F.concat(F.lit("s"), F.col("src")), F.lit("n")))
    d = ranked(d, ["src_key", "size"], [F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "check"], key)
    plan = plan.withColumn("src_key", F.coalesce(F.concat(F.lit("s"), F.col("p_src")), F.lit("n"))).withColumnRenamed("p_size", "size").drop("p_src")
    times = F.when(F.col("size") == 0, 0).otherwise(F.col("base") + (F.col("rank") < F.col("more")).cast("int")).cast("int")
    return d.join(plan, ["src_key", "size"]).select("doc_id", "size", "source_size", "target", (times * F.col("size")).cast("long").alias("taken"), times.alias("times"), F.col("src").alias("source"), "check")
