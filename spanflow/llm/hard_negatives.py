"""Hard negatives: clusters of anchors share a list of candidates by angular bound (as MAXIMUS does)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanflow.llm.common import batched, columns, written

#: Anchors that go together to a task, anchors of a cluster that share a list, and rows of a task.
BLOCK, CLUSTER, SHARD = 1024, 32, 8192
#: Centroids of blocks at most, sampled anchors a centroid, and bytes of the sample at most.
CENTROIDS, PER_CENTROID, SAMPLE_BYTES = 2048, 8, 1 << 27
#: Rows of a list that are scored at a time, at first; steps double.
STEP = 256
#: What rounding of angles and of double products can add to a bound.
SLACK = 1e-6


def prepared(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int, moved: Column | None) -> DataFrame:
    """Rows that take part: vec_id, label and x, the components times ``scale`` rounded down."""
    v, finite = F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    ok = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & F.coalesce(F.forall(v, lambda x: finite(x.cast("double"))), F.lit(False))
    rows = vectors.where(ok).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).cast("long").alias("label"),
        F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("x"),
    )
    if moved is not None:
        rows = rows.withColumn("label", moved)
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.label", "r.x", F.size("r.x").alias("dim"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of ``a`` with those of ``b``, as 64-bit integers."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    if most < 2**52:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T  # out of the range where doubles are exact
    return np.clip(exact, 1 - 2**63, 2**63 - 1).astype(np.int64)


def angles(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the rows of ``x`` and their angles with each unit vector of ``c``."""
    x = x.astype(float)
    norm = np.sqrt((x * x).sum(1))
    return norm, np.arccos(np.clip((x @ c.T) / np.maximum(norm, 1e-300)[:, None], -1, 1))


def centroids(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means from evenly spaced rows; reruns agree."""
    x = x.astype(float)
    x = x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None]
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        home = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        norm = np.sqrt((total * total).sum(1))
        c[norm > 0] = total[norm > 0] / norm[norm > 0][:, None]
    return c


def clusters(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Members of each cluster of anchors, CLUSTER of them at most, and its unit centroid."""
    c = centroids(x, math.ceil(len(x) / CLUSTER))
    home = (x.astype(float) @ c.T).argmax(1)
    for j in range(len(c)):
        own = np.flatnonzero(home == j)
        for lo in range(0, len(own), CLUSTER):
            yield own[lo : lo + CLUSTER], c[j : j + 1]


def shared_lists(anchors: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each cluster of anchors: its members, their lengths, the rows in descending order of their bound, and the bounds.

    A row at angle r from the centroid of a cluster whose members are within t of it is at least r - t from every
    member, so that no member a has a product above |a| times the row's bound |row| cos(max(0, r - t))."""
    for own, c in clusters(anchors):
        length, spread = angles(anchors[own], c)
        norm, away = angles(rows, c)
        bound = norm * np.cos(np.maximum(0, away[:, 0] - spread.max() - SLACK))
        bound += norm * SLACK
        order = np.argsort(-bound, kind="stable")
        yield own, length, order, bound[order]


def walk(anchors: np.ndarray, rows: np.ndarray, visit, done) -> None:
    """Every member of a cluster walks the cluster's list in steps, until ``done(anchor, bound)`` certifies that
    nothing below ``bound`` can change its result. ``visit(anchor, places, products)`` takes what a step has shown."""
    for own, length, order, bound in shared_lists(anchors, rows):
        live, at, step = np.arange(len(own)), 0, STEP
        while len(live) and at < len(order):
            live = np.array([k for k in live if not done(own[k], float(length[k] * bound[at]) + SLACK)], int)
            if not len(live):
                break
            some = order[at : at + step]
            s = products(anchors[own[live]], rows[some])
            for k, row in zip(live, s, strict=True):
                visit(own[k], some, row)
            at, step = at + step, 2 * step


def best(ids: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the n highest scores, ties by ascending id."""
    return np.lexsort((ids, -scores))[:n]


class Positives:
    """The n best rows of each anchor's own label in one shard."""

    def __init__(self, a: pd.DataFrame, r: pd.DataFrame, n: int):
        self.a_id, self.a_label, self.r_id, self.r_label, self.n = a["vec_id"].to_numpy(), a["label"].to_numpy(), r["vec_id"].to_numpy(), r["label"].to_numpy(), n
        self.found = {k: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for k in range(len(a))}

    def visit(self, k: int, places: np.ndarray, s: np.ndarray) -> None:
        own = (self.r_label[places] == self.a_label[k]) & (self.r_id[places] != self.a_id[k])
        ids, scores = np.append(self.found[k][0], self.r_id[places[own]]), np.append(self.found[k][1], s[own])
        top = best(ids, scores, self.n)
        self.found[k] = ids[top], scores[top]

    def done(self, k: int, bound: float) -> bool:
        scores = self.found[k][1]
        return len(scores) == self.n and bound < scores[-1]

    def result(self) -> pd.DataFrame:
        return pd.DataFrame({"anchor_id": np.repeat(self.a_id, [len(x[0]) for x in self.found.values()]), "positive_id": np.concatenate([x[0] for x in self.found.values()]), "positive_score": np.concatenate([x[1] for x in self.found.values()])})


class Negatives:
    """For each anchor and positive the n best rows of other labels in one shard whose score is within the band."""

    def __init__(self, a: pd.DataFrame, r: pd.DataFrame, n: int, low: int, high: int):
        self.a_label, self.r_id, self.r_label, self.n, self.low, self.high = a["label"].to_numpy(), r["vec_id"].to_numpy(), r["label"].to_numpy(), n, low, high
        self.goals = [[int(p) for p in ps] for ps in a["positive_scores"]]
        self.found = {(k, j): (np.zeros(0, np.int64), np.zeros(0, np.int64)) for k, ps in enumerate(self.goals) for j in range(len(ps))}

    def band(self, p: int) -> tuple[int, int]:
        """Least and greatest whole score of the band (empty if the least is above the greatest)."""
        return -(-self.low * p // 100), self.high * p // 100

    def visit(self, k: int, places: np.ndarray, s: np.ndarray) -> None:
        other = self.r_label[places] != self.a_label[k]
        ids, s = self.r_id[places[other]], s[other]
        for j, p in enumerate(self.goals[k]):
            lo, hi = self.band(p)
            ok = (lo <= s) & (s <= hi)
            if ok.any():
                all_ids, scores = np.append(self.found[k, j][0], ids[ok]), np.append(self.found[k, j][1], s[ok])
                top = best(all_ids, scores, self.n)
                self.found[k, j] = all_ids[top], scores[top]

    def done(self, k: int, bound: float) -> bool:
        return all(bound < self.band(p)[0] or self.band(p)[0] > self.band(p)[1] or len(self.found[k, j][1]) == self.n and bound < self.found[k, j][1][-1] for j, p in enumerate(self.goals[k]))

    def result(self, a: pd.DataFrame) -> pd.DataFrame:
        out = [(int(a["vec_id"].iloc[k]), int(a["positive_ids"].iloc[k][j]), self.goals[k][j], ids, scores) for (k, j), (ids, scores) in self.found.items() if len(ids)]
        many = np.array([len(x[3]) for x in out], np.int64)
        flat = lambda i: np.repeat(np.array([x[i] for x in out], np.int64), many)
        both = [np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in (3, 4)]
        return pd.DataFrame({"anchor_id": flat(0), "positive_id": flat(1), "positive_score": flat(2), "negative_id": both[0], "negative_score": both[1]})


def matrix(col: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, np.int64) for v in col], np.int64).reshape(len(col), -1)


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", moved: Column | None = None) -> DataFrame:
    """Hard negatives of every anchor: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null id, a null label, a null vector or any null or non-finite component take no part; of rows of
    one vec_id the least (by label, then components) does, as results name rows by id. ``moved`` replaces the label (of columns vec_id and label).
    Components become floor(``scale`` x), a score is the exact inner product (beyond 64 bits: the nearest 64-bit number), and higher scores
    come first, ties by smaller vec_id. Anchors are rows whose vec_id ``every`` divides. Their positives are the first
    ``positives`` other rows of their label, and for each positive the first ``negatives`` rows of other labels with low p <= 100 s <= high p are
    returned, p being the positive's score. Vectors of different length do not meet; empty ones score 0. Anchors without positives or
    with nothing in the band have no rows, nor has an empty table; other columns are ignored.

    Anchors are a stated query set (one row in ``every``). They are cut into blocks by centroids of a bounded sample, rows into shards by a
    hash, and a task takes one block and one shard. There, clusters of anchors sort the shard's rows by an upper
    bound of their angle once, and every member walks that list until certified. Shards pass on no more
    than an anchor asks for. Positives come first; their scores then bound negatives from below, so that rows which cannot reach any anchor of a
    block are not sent to it. Blocks and shards are of bounded size, whatever labels or copies are frequent."""
    rows = written(prepared(vectors, id_col, vec_col, label_col, scale, moved), "vectors")
    anchors = rows.where(F.col("vec_id") % every == 0)
    dims = {r["dim"]: (r["n"], r["a"]) for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("a")).collect()}  # a row per length of vectors
    out = None
    for dim in sorted(d for d, (_, a) in dims.items() if a):
        found = _mine(rows.where(F.col("dim") == dim), anchors.where(F.col("dim") == dim), dim, *dims[dim], positives, negatives, low, high)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out


def blocks_of(anchors: DataFrame, n: int, dim: int) -> tuple[DataFrame, np.ndarray]:
    """Anchors with their block (a centroid and, where it has many, a part), and the centroids."""
    k = min(CENTROIDS, max(1, math.ceil(n / BLOCK)), max(1, SAMPLE_BYTES // (8 * max(1, dim) * PER_CENTROID)))
    c = np.zeros((1, dim))
    if k > 1:
        sample = anchors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(k * PER_CENTROID).select("x").toPandas()["x"]
        c = centroids(matrix(sample), k)
    shared = anchors.sparkSession.sparkContext.broadcast(c)
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("x", pa.list_(pa.int64())), ("home", pa.int32())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = columns(batch)
            x = matrix(pd.Series(b["x"].to_pylist()))
            home = (x.astype(float) @ shared.value.T).argmax(1) if len(x) else np.zeros(0)
            yield from batched(schema, [b["vec_id"], b["label"], b["x"], home.astype(np.int32)])

    a = anchors.select("vec_id", "label", "x").mapInArrow(assign, "vec_id long, label long, x array<long>, home int")
    parts = a.groupBy("home").agg(F.count(F.lit(1)).alias("_n")).select("home", F.ceil(F.col("_n") / BLOCK).alias("parts"))
    a = a.join(F.broadcast(parts), "home")  # at most CENTROIDS rows
    return a.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).drop("parts"), c


def sent(rows: DataFrame, anchors: DataFrame, c: np.ndarray, floor: Column) -> DataFrame:
    """Rows with each block (home, part) that they can matter to: those of the homes where their bound reaches the least ``floor`` of an
    anchor's score, over all anchors of unit length."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(c)
    about = pa.schema([("home", pa.int32()), ("part", pa.int64()), ("away", pa.float64()), ("floor", pa.float64())])

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = columns(batch)
            x, home = matrix(pd.Series(b["x"].to_pylist())).astype(float), b["home"].to_numpy()
            norm = np.sqrt((x * x).sum(1))
            away = np.arccos(np.clip((x * shared.value[home]).sum(1) / np.maximum(norm, 1e-300), -1, 1)) if len(x) else norm
            yield from batched(about, [b["home"], b["part"], away, b["floor"].to_numpy(zero_copy_only=False) / np.maximum(norm, 1e-300)])

    table = anchors.withColumn("floor", floor.cast("double")).select("home", "part", "x", "floor").mapInArrow(reach, "home int, part long, away double, floor double")
    held = table.groupBy("home").agg(F.max("away").alias("away"), F.min("floor").alias("floor"), (F.max("part") + 1).alias("parts")).collect()  # at most CENTROIDS rows
    homes, spread, least = np.array([r["home"] for r in held], np.int32), np.array([r["away"] for r in held]), np.array([r["floor"] for r in held])
    reached = spark.sparkContext.broadcast((homes, spread, least))
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("x", pa.list_(pa.int64())), ("homes", pa.list_(pa.int32()))])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes, spread, least = reached.value
        for batch in batches:
            b = columns(batch)
            norm, away = angles(matrix(pd.Series(b["x"].to_pylist())), shared.value[homes])
            bound = norm[:, None] * (np.cos(np.maximum(0, away - spread - SLACK)) + SLACK)
            yield from batched(schema, [b["vec_id"], b["label"], b["x"], [homes[ok] for ok in bound >= least - SLACK]])

    near = rows.select("vec_id", "label", "x").mapInArrow(choose, "vec_id long, label long, x array<long>, homes array<int>").withColumn("home", F.explode("homes")).drop("homes")
    parts = spark.createDataFrame([(r["home"], r["parts"]) for r in held], "home int, parts long")
    return near.join(F.broadcast(parts), "home").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")


def _mine(rows: DataFrame, anchors: DataFrame, dim: int, n: int, n_anchors: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    shards = math.ceil(n / SHARD)
    blocks, c = blocks_of(anchors, n_anchors, dim)
    blocks = written(blocks, "anchors")
    key = ["home", "part", "shard"]
    in_shards = lambda a: a.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard")

    def first(a: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        best_ = Positives(a, r, positives)
        if len(a) and len(r):
            walk(matrix(a["x"]), matrix(r["x"]), best_.visit, best_.done)
        return best_.result() if len(a) else pd.DataFrame({k: np.zeros(0, np.int64) for k in ("anchor_id", "positive_id", "positive_score")})

    pairs = in_shards(blocks).groupBy(*key).cogroup(sent(rows, blocks, c, F.lit(float("-inf"))).select("*", shard).groupBy(*key)).applyInPandas(first, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    pairs = pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    goals = pairs.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("p"), F.min(F.when(F.col("positive_score") >= 0, F.col("positive_score"))).alias("least"))  # of a few each
    goals = goals.where("least IS NOT NULL").select(F.col("anchor_id").alias("vec_id"), F.col("p.positive_id").alias("positive_ids"), F.col("p.positive_score").alias("positive_scores"), (F.col("least") * low / 100).cast("double").alias("floor"))
    wanted = written(blocks.join(goals, "vec_id"), "anchors")

    def second(a: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        best_ = Negatives(a, r, negatives, low, high)
        if len(a) and len(r):
            walk(matrix(a["x"]), matrix(r["x"]), best_.visit, best_.done)
        return best_.result(a)

    found = in_shards(wanted).groupBy(*key).cogroup(sent(rows, wanted, c, F.col("floor")).select("*", shard).groupBy(*key)).applyInPandas(second, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
