"""Embedding near-dedup: robust-pruned flat graphs on overlapping cluster shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanflow.llm.common import components, written

#: Vectors that a shard should have, centroids over all labels at most, sampled vectors per centroid, and bytes of the sample at most.
SHARD, CENTROIDS, PER_CENTROID, SAMPLE_BYTES = 600, 8192, 12, 1 << 28
#: Vectors of a graph, and vectors searched for in it, that a task has at most on average over a shard's blocks.
BLOCK = 2400
#: Out-degree and slack of the pruned graph, candidates to prune, width of the greedy search,
#: and how far below the threshold a vector may be to be expanded.
DEGREE, ALPHA, POOL, BEAM, SLACK = 24, 1.2, 64, 16, 0.1
#: Places where a search starts, vectors of each label that are audited, at most and over all labels, and the recall they must show.
STARTS, AUDIT, AUDITS, RECALL = 32, 256, 8192, 0.98


def unit(rows: list) -> np.ndarray:
    x = np.array([np.asarray(r, np.float64) for r in rows])
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k centroids of greatest cosine, ascending, for blocks of bounded size at a time."""
    step = max(1, (1 << 22) // max(1, len(c)))
    parts = [np.argpartition(-(x[a : a + step] @ c.T), k - 1, 1)[:, :k] for a in range(0, len(x), step)]
    return np.sort(np.concatenate(parts), 1)


def within(x: np.ndarray, c: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vector, centroid) pairs of the shards to search for each vector, and each vector's nearest centroid.

    A vector at most d away whose nearest is t makes x.c_s - x.c_t at most d |c_s - c_t|, where s is
    the nearest of x: with ``reach`` d no such t is left out."""
    step, rows, cols, homes = max(1, (1 << 22) // len(c)), [], [], []
    norm = (c * c).sum(1)
    for a in range(0, len(x), step):
        sims = x[a : a + step] @ c.T
        home = sims.argmax(1)
        apart = np.sqrt(np.maximum(norm[home][:, None] + norm[None] - 2 * (c[home] @ c.T), 0))
        i, t = np.nonzero(sims[np.arange(len(home)), home][:, None] - sims <= reach * apart + 1e-6)
        rows.append(a + i)
        cols.append(t)
        homes.append(home)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(homes)


def centroids(x: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """Spherical k-means on a sample, a few rounds."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(8):
        near = nearest(x, c, 1)[:, 0]
        for j in range(len(c)):
            if (near == j).any():
                m = x[near == j].mean(0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def prune(x: np.ndarray) -> np.ndarray:
    """A flat graph: of each vector's nearest, those are kept that no kept one is much
    nearer to (squared distance times ALPHA), and the very nearest. Rows of neighbours, padded with the own index.
    Links back and one to the next vector keep it in one piece."""
    n = len(x)
    out: list[list[int]] = [[] for _ in range(n)]
    pool = min(POOL, n - 1)
    for at in range(0, n, 256):
        sims = x[at : at + 256] @ x.T
        sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -2
        near = np.argpartition(-sims, pool - 1, 1)[:, :pool] if pool else np.zeros((len(sims), 0), int)
        for i, cand in enumerate(near):
            s = sims[i, cand]
            cand, s = cand[np.argsort(-s, kind="stable")], np.sort(s)[::-1]
            between, open_, kept = x[cand] @ x[cand].T, np.ones(len(cand), bool), out[at + i]
            while open_.any() and len(kept) < DEGREE:
                j = int(open_.argmax())
                kept.append(int(cand[j]))
                open_ &= ALPHA * (1 - between[j]) > 1 - s
                open_[j] = False
            kept += [j for j in cand[: DEGREE // 2].tolist() if j not in kept]  # dense groups stay connected
    back: list[list[int]] = [[] for _ in range(n)]
    for i, row in enumerate(out):
        for j in row:
            back[j].append(i)
    out = [list(dict.fromkeys([*a, *b[:DEGREE], (i + 1) % n])) for i, (a, b) in enumerate(zip(out, back, strict=True))]
    width = max(map(len, out))
    return np.array([a + [i] * (width - len(a)) for i, a in enumerate(out)])


def hits(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, own: np.ndarray, least: float, whole: bool = False) -> np.ndarray:
    """Which of ``x`` have a cosine of at least ``least`` with each query, as a matrix: from the medoid, some
    other starts and the query's own links (``own``: its place in x, or -1) the graph is walked greedily towards
    each query, and then on through everything that is near enough. ``whole``: all are compared, without the graph."""
    n = len(x)
    near = np.zeros((len(queries), n), bool)
    start = np.unique(np.append(np.linspace(0, n - 1, min(n, STARTS)).astype(int), (x @ x.mean(0)).argmax()))
    for at in range(0, len(queries), 256):
        q, o = queries[at : at + 256], own[at : at + 256]
        row, inside = np.arange(len(q)), np.flatnonzero(o >= 0)
        if whole:
            sims = q @ x.T
        else:
            sims = walk(x, graph, q, o, start, row, inside, least)
        i, v = np.nonzero(sims >= least - 1e-4)
        for k in range(0, len(i), 100_000):
            a, b = i[k : k + 100_000], v[k : k + 100_000]
            fine = np.einsum("ij,ij->i", q[a], x[b]) >= least
            near[at + a[fine], b[fine]] = True
        near[at + inside, o[inside]] = False
    at = np.flatnonzero(own >= 0)
    if len(at):  # what one of two has found
        both = near[np.ix_(at, own[at])]
        near[np.ix_(at, own[at])] = both | both.T
    return near


def walk(x: np.ndarray, graph: np.ndarray, q: np.ndarray, own: np.ndarray, start: np.ndarray, row: np.ndarray, inside: np.ndarray, least: float) -> np.ndarray:
    """Cosines of the queries and what the walk has seen of ``x``; -2 elsewhere."""
    n = len(x)
    sims = np.full((len(q), n), -2.0, np.float32)
    done = np.zeros((len(q), n), bool)
    sims[:, start] = q @ x[start].T
    sims[inside, own[inside]] = 1

    def expand(i: np.ndarray, v: np.ndarray) -> None:
        done[i, v] = True
        near = graph[v]
        flat_i, flat_v = np.repeat(i, near.shape[1]), near.ravel()
        new = sims[flat_i, flat_v] == -2
        flat_i, flat_v = flat_i[new], flat_v[new]
        for lo in range(0, len(flat_i), 200_000):
            a, b = flat_i[lo : lo + 200_000], flat_v[lo : lo + 200_000]
            sims[a, b] = np.einsum("ij,ij->i", q[a], x[b])

    live = row
    for _ in range(4 * BEAM):
        s = sims[live]
        beam = np.argpartition(-s, min(BEAM, n) - 1, 1)[:, : min(BEAM, n)]
        top = np.take_along_axis(s, beam, 1)
        top[np.take_along_axis(done[live], beam, 1) | (top == -2)] = -3
        best = top.argmax(1)
        go = top[np.arange(len(live)), best] > -2
        live, best, beam = live[go], best[go], beam[go]
        if not len(live):
            break
        expand(live, beam[np.arange(len(live)), best])
    while True:
        near = sims >= least - SLACK
        dense = np.flatnonzero((near.sum(1) * graph.shape[1] > n) & ~done.all(1))  # links to follow outnumber the vectors: all are compared
        sims[dense], done[dense] = q[dense] @ x.T, True
        i, v = np.nonzero(near & ~done)
        if not len(i):
            return sims
        for lo in range(0, len(i), 20_000):
            expand(i[lo : lo + 20_000], v[lo : lo + 20_000])


def search(x: np.ndarray, graph: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ``x`` with a cosine of at least ``least``, both ways."""
    return np.nonzero(hits(x, graph, x, np.arange(len(x)), least))


def roots(n: int, i: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least member of each vector's component."""
    r = np.arange(n)
    while True:
        m = r.copy()
        np.minimum.at(m, i, r[v])
        m = m[m]
        if (m == r).all():
            return r
        r = m


def near_dedup(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors are linked when their labels are equal and not null and their cosine, in double
    precision, is at least ``least``. Null, empty and zero vectors, and those with null or
    non-finite components, have no links, and vectors of different lengths have none with each other.
    component_id is the smallest vec_id reached by links (null ids last), kept whether it is the own
    one. Repeated rows are vectors of their own and linked. An empty table gives no rows; other columns are ignored.

    Equal vectors of a label become one with a count. Each label is clustered on a
    sample of bounded size; all its vectors go to the shards of their two nearest centroids. A shard
    builds a robust-pruned graph, and the adjacency lists of a vector's shards are united. Each vector is
    searched for in the united graph of every shard near enough (:func:`within`), where those count whose
    nearest centroid it is. A shard passes on numbers of links and its members' local roots, not pairs.

    Cost: a shard's graph takes all cosines of a block of about BLOCK vectors, and the search what it walks through. Recall is that of the audit.
    Pairs are tied to the threshold in double precision; those within 1e-12 of it may fall on either side.

    Audit: a hashed sample of each large label (and one of all others) is compared with all rows of
    its label. Where less than RECALL of its links were found, the label is searched again with twice the reach,
    at last with the one that leaves out no shard, and then by comparing all in the shards."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    fine = F.col("label").isNotNull() & F.coalesce(
        (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0), F.lit(False)
    )
    rows = rows.withColumn("space", F.when(fine, F.concat_ws("/", F.size("v").cast("string"), "label")))
    one = rows.where("space IS NOT NULL").groupBy("space", "v").agg(F.min(F.coalesce("vec_id", F.lit(2**63 - 1))).alias("cid"), F.count(F.lit(1)).alias("copies"))
    one = written(one.select("space", "v", "cid", "copies", F.xxhash64("v").alias("key")), "vectors")

    sizes = one.groupBy("space").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD * 3 // 2)
    total = sizes.agg(F.sum(F.ceil(F.col("n") / SHARD))).first()[0] or 0
    longest = one.agg(F.max(F.size("v"))).first()[0] or 1
    most = max(1, min(CENTROIDS, SAMPLE_BYTES // (8 * PER_CENTROID * longest)))
    per = max(SHARD, -(-SHARD * int(total) // most)) if total else SHARD  # so that centroids and their sample stay within their bounds
    large = {r["space"]: r["n"] for r in sizes.where(F.col("n") > per * 3 // 2).collect()}  # fewer than CENTROIDS rows
    means: dict[str, np.ndarray] = {}
    if large:
        plan = spark.createDataFrame([(k, PER_CENTROID * -(-n // per) / n) for k, n in large.items()], "space string, part double")
        unif = F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(1 << 20)) / float(1 << 20)
        sample = one.join(plan, "space").where(unif < F.col("part")).select("space", "v", "cid").toPandas().sort_values(["space", "cid"])
        means = {k: centroids(unit(g["v"].tolist()), -(-large[k] // per)) for k, g in sample.groupby("space")}
    shared = spark.sparkContext.broadcast(means)
    truth = written(audited(one, large, least), "audit")

    apart, reach, whole = float(np.sqrt(2 - 2 * least)) if least < 1 else 0.0, {k: min(1.0, 3 / np.sqrt(c.shape[1])) for k, c in means.items()}, set()
    parts, now = [], one.withColumn("part", part_of(large))
    while True:
        seen = written(searched(now, shared, {k: r * apart for k, r in reach.items()}, frozenset(whole), least), "seen")
        found = seen.groupBy("cid").agg(F.sum("links").alias("links"))
        recall = truth.join(now.select("cid", "part"), "cid").join(found, "cid", "left").groupBy("part").agg(F.sum("true").alias("n"), F.sum(F.least("true", F.coalesce("links", F.lit(0)))).alias("found"))
        bad = [r["part"] for r in recall.where(F.col("found") < RECALL * F.col("n")).collect()]  # parts are large labels and one more
        parts.append(seen.where(~F.col("part").isin(bad)) if bad else seen)
        if not bad:
            break
        if whole & set(bad):
            raise RuntimeError("links are missing though all were compared")
        for k in bad:
            if reach.get(k, 1.0) < 1:
                reach[k] = min(1.0, 2 * reach[k])
            else:
                whole.add(k)
        now = now.where(F.col("part").isin(bad))
    seen = parts[0]
    for more in parts[1:]:
        seen = seen.unionByName(more)
    links = seen.groupBy("cid").agg(F.sum("links").alias("links"))
    comp = components(seen.select(F.col("cid").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("cid"), F.col("root").alias("component"))
    known = one.join(links, "cid").join(comp, "cid", "left").select("space", "v", "links", "copies", F.coalesce("component", "cid").alias("component"))
    rows = rows.withColumn("key", F.xxhash64("v"))
    known = known.select(F.col("space").alias("k_space"), F.xxhash64("v").alias("k_key"), F.col("v").alias("k_v"), "links", "copies", "component")
    out = rows.join(known, (F.col("space") == F.col("k_space")) & (F.col("key") == F.col("k_key")) & (F.col("v") == F.col("k_v")), "left")
    component = F.coalesce("component", "vec_id")
    component = F.when(component == 2**63 - 1, F.lit(None)).otherwise(component)
    return out.select("vec_id", F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def part_of(large: dict[str, int]):
    """What is audited as one: a large label, or all others."""
    return F.when(F.col("space").isin(list(large)), F.col("space")).otherwise("") if large else F.lit("")


def audited(one: DataFrame, large: dict[str, int], least: float) -> DataFrame:
    """(cid, true): the links of sampled vectors, found by comparing each with all rows of its label."""
    spark, each = one.sparkSession, max(1, min(AUDIT, AUDITS // max(1, len(large))))
    few = one.where(part_of(large) == "").count()
    plan = spark.createDataFrame([(k, each / n) for k, n in large.items()] + [("", AUDIT / max(1, few))], "part string, share double")
    unif = F.pmod(F.xxhash64(F.lit("audit"), "key"), F.lit(1 << 30)) / float(1 << 30)
    sample = one.withColumn("part", part_of(large)).join(plan, "part").where(unif < F.col("share")).select("space", "v", "cid").toPandas()
    asked = spark.sparkContext.broadcast({k: (unit(g["v"].tolist()), g["cid"].to_numpy()) for k, g in sample.groupby("space")})

    def count(batches):
        for pdf in batches:
            out = []
            for space, g in pdf.groupby("space"):
                if space in asked.value:
                    (q, ids), x = asked.value[space], unit(g["v"].tolist())
                    near = (q @ x.T >= least + 1e-12) & (ids[:, None] != g["cid"].to_numpy()[None])
                    out.append(pd.DataFrame({"cid": ids, "true": near @ g["copies"].to_numpy()}))
            if out:
                yield pd.concat(out)

    return one.select("space", "v", "cid", "copies").mapInPandas(count, "cid long, true long").groupBy("cid").agg(F.sum("true").alias("true"))


def searched(one: DataFrame, shared, reach: dict[str, float], whole: frozenset, least: float) -> DataFrame:
    """(part, cid, links, root), a row for each vector and shard that it was searched for in or links with."""

    def assign(batches):
        for pdf in batches:
            out = []
            for space, g in pdf.groupby("space"):
                c, x = shared.value.get(space), unit(g["v"].tolist())
                if c is None or len(c) < 2:
                    i, t, home, two = np.arange(len(g)), np.zeros(len(g), int), np.zeros(len(g), int), np.zeros((len(g), 1), int)
                else:
                    (i, t, home), two = within(x, c, reach[space]), nearest(x, c, 2)
                known = np.zeros((len(g), 1 if c is None else len(c)), np.int8) if len(g) else None
                known[i, t] = 1  # searched for there
                known[np.arange(len(g))[:, None], two] |= 2  # in the graph
                known[np.arange(len(g)), home] |= 6  # and counted
                i, t = np.nonzero(known)
                raw, cid, copies, key, part = [b.tobytes() for b in x], g["cid"].to_numpy(), g["copies"].to_numpy(), g["key"].to_numpy(), g["part"].to_numpy()
                out.append(pd.DataFrame({"part": part[i], "shard": [f"{space}#{k}" for k in t], "cid": cid[i], "copies": copies[i], "key": key[i], "x": [raw[k] for k in i], "role": known[i, t].astype(np.int32)}))
            if out:
                yield pd.concat(out)

    homes = written(one.mapInPandas(assign, "part string, shard string, cid long, copies long, key long, x binary, role int"), "shards")
    sizes = homes.groupBy("shard").agg(F.ceil(F.count_if(F.col("role") >= 2) / BLOCK).alias("graphs"), F.ceil(F.count_if(F.col("role") % 2 == 1) / BLOCK).alias("asks"))
    homes = homes.join(sizes.where("graphs > 1 OR asks > 1"), "shard", "left").fillna(1, ["graphs", "asks"])
    homes = homes.withColumn("b", F.pmod(F.xxhash64(F.lit("graph"), "key", "cid"), F.greatest("graphs", F.lit(1)))).withColumn("a", F.pmod(F.xxhash64(F.lit("ask"), "key", "cid"), F.greatest("asks", F.lit(1))))
    graphs = homes.where(F.col("role") >= 2)
    # A task has one block of a shard's graphs and one of the vectors to search for; a row goes to its block's tasks, as the one and as the other.
    cell = lambda b, a, role: F.struct(b.cast("long").alias("b"), a.cast("long").alias("a"), role.cast("int").alias("role"))
    as_graph = F.transform(F.sequence(F.lit(0), F.greatest("asks", F.lit(1)) - 1), lambda a: cell(F.col("b"), a, F.col("role") - F.when((F.col("role") % 2 == 1) & (a != F.col("a")), 1).otherwise(0)))
    as_ask = F.transform(F.sequence(F.lit(0), F.greatest("graphs", F.lit(1)) - 1), lambda b: cell(b, F.col("a"), F.lit(1)))
    as_ask = F.when(F.col("role") % 2 == 1, as_ask).otherwise(F.filter(as_ask, lambda _: F.lit(False)))
    as_graph = F.when(F.col("role") >= 2, as_graph).otherwise(F.filter(as_graph, lambda _: F.lit(False)))
    as_ask = F.when(F.col("role") >= 2, F.filter(as_ask, lambda t: t["b"] != F.col("b"))).otherwise(as_ask)  # there it is both
    tasks = homes.withColumn("cell", F.explode(F.concat(as_graph, as_ask))).select("part", "shard", "cell.b", "cell.a", "cid", "copies", "x", "cell.role")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "cid"], ignore_index=True)
        x = np.stack([np.frombuffer(b) for b in pdf["x"]])
        graph = prune(x.astype(np.float32)) if len(x) > 1 else np.zeros((1, 1), int)
        ids = pdf["cid"].to_numpy()
        return pd.DataFrame({"cid": ids, "near": [np.unique(ids[g]) for g in graph]})

    lists = graphs.groupBy("shard", "b").applyInPandas(build, "cid long, near array<long>")
    united = lists.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # two lists of bounded length

    def look(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid", ignore_index=True)
        vectors, role, part = np.stack([np.frombuffer(b) for b in pdf["x"]]), pdf["role"].to_numpy(), pdf["part"].iloc[0]
        base, asks = np.flatnonzero(role & 2), np.flatnonzero(role & 1)
        ids, n = pdf["cid"].to_numpy(), len(base)
        if not n or not len(asks):
            return pd.DataFrame({"part": part, "cid": ids[asks], "links": 0, "root": ids[asks]})
        place = []
        for i, near in enumerate(pdf["near"].iloc[base]):
            near = np.asarray(near, np.int64)
            at = np.minimum(np.searchsorted(ids[base], near), n - 1)
            place.append(at[(ids[base][at] == near) & (at != i)])
        width = max(1, max(map(len, place)))
        graph = np.array([np.append(p, np.full(width - len(p), i)) for i, p in enumerate(place)], np.int64)
        own = np.full(len(pdf), -1)
        own[base] = np.arange(n)
        near = hits(vectors[base], graph, vectors[asks], own[asks], least, part in whole)
        weight = np.where(role[base] & 4, pdf["copies"].to_numpy()[base], 0).astype(np.float64)
        links, root = np.zeros(len(pdf), np.int64), np.arange(len(pdf))
        for lo in range(0, len(asks), 256):
            links[asks[lo : lo + 256]] = np.rint(near[lo : lo + 256] @ weight)
            i, v = np.nonzero(near[lo : lo + 256])
            i, v, every = asks[lo + i], base[v], np.arange(len(pdf))
            root = roots(len(pdf), np.concatenate([i, v, every, root]), np.concatenate([v, i, root, every]))
        return pd.DataFrame({"part": part, "cid": ids, "links": links, "root": ids[root]})

    return tasks.join(united, "cid", "left").groupBy("shard", "b", "a").applyInPandas(look, "part string, cid long, links long, root long")
