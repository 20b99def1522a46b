"""Embeddings, chat, quality and the pipeline."""

import itertools
import os
import zlib

import numpy as np
import pytest
from helpers import roots, rows
from pyspark.sql import functions as F

from spanflow.llm import chat, common, embedding_dedup, quality

SF = "/root/testdata/sf0.001"


def vectors(seed=0):
    r = np.random.default_rng(seed)
    out, centers = [], r.normal(size=(12, 8))
    for i in range(300):
        v = (centers[i % 12] + r.normal(size=8) * 0.12).tolist()
        out.append((i, v, None if i % 50 == 7 else i % 2))
    out += [(300 + k, centers[0].tolist(), 0) for k in range(40)]  # copies
    out += [(400, None, 0), (401, [0.0] * 8, 0), (402, [float("nan")] * 8, 0), (403, [None] * 8, 0), (404, [], 0), (405, [1.0], 0)]
    return out


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", 60)
    data = vectors()
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(4)
    for clash in ("key", "space", "v", "cid", "part", "links", "component", "n_links"):
        df = df.withColumn(clash, F.lit("clash"))
    got = rows(embedding_dedup.near_dedup(df), "vec_id", "n_links", "component_id", "kept")
    good = {i: np.array(np.array(v, np.float32), float) for i, v, lab in data if lab is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    label = {i: lab for i, _, lab in data}
    unit = {i: v / np.linalg.norm(v) for i, v in good.items()}
    links = {(a, b) for a, b in itertools.combinations(unit, 2) if label[a] == label[b] and float(unit[a] @ unit[b]) >= 0.93}
    found = sum(v[0] for v in got.values()) / 2
    assert 0.9 * len(links) <= found <= len(links)
    want = roots([i for i, *_ in data], links)
    same = sum(got[i][1] == want[i] for i in want) / len(want)
    assert same >= 0.95 and all(v[2] == (v[1] == i) for i, v in got.items())
    for i in (400, 401, 402, 403, 404, 405, 7):
        assert got[i] == (0, i, True)
    assert embedding_dedup.near_dedup(df.limit(0)).count() == 0


def test_graph_search_recall():
    r = np.random.default_rng(3)
    x = embedding_dedup.unit((r.normal(size=(20, 16))[r.integers(0, 20, 700)] + r.normal(size=(700, 16)) * 0.1).tolist())
    i, v = embedding_dedup.search(x, embedding_dedup.prune(x.astype(np.float32)), 0.93)
    s = x @ x.T
    np.fill_diagonal(s, 0)
    assert len(i) >= 0.9 * (s >= 0.93).sum() and (s[i, v] >= 0.93).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 200)]
    got = rows(common.components(spark.createDataFrame(chain, "a long, b long")), "node", "root")
    assert got == {**{i: (0,) for i in range(51)}, **{k: (100,) for k in range(100, 160)}, 200: (200,), 201: (200,)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ranks(spark):
    df = spark.createDataFrame([(i, "k" if i % 3 else None or "z", i % 5) for i in range(500)], "i long, k string, v int")
    got = common.ranked(df, ["k"], ["i"], df["i"]).collect()
    for key in ("k", "z"):
        assert sorted(r["rank"] for r in got if r["k"] == key) == list(range(sum(r["k"] == key for r in got)))


def cheapest(roles, relabel=3, merge=1, insert=4):
    """Dijkstra by hand: every way to say, merge, relabel and put in turns."""
    best = {3: 0}
    legal = chat.LEGAL

    def fill(costs):
        costs = dict(costs)
        for _ in range(4):
            for s, c in list(costs.items()):
                for r in range(3):
                    if (s, r) in legal and c + insert < costs.get(r, 10**9):
                        costs[r] = c + insert
        return costs

    for role in roles:
        new = {}
        for s, c in best.items():
            for r in range(3):
                change = c + (0 if r == role else relabel)
                if r == s:
                    new[r] = min(new.get(r, 10**9), change + merge)
        for s, c in fill(best).items():
            for r in range(3):
                if (s, r) in legal:
                    new[r] = min(new.get(r, 10**9), c + (0 if r == role else relabel))
        best = new
    return fill(best)[2]


def test_chat(spark):
    names = ["system", "user", "assistant", "tool"]
    talks = [c for n in range(1, 5) for c in itertools.product(range(4), repeat=n)]
    data = [(i, k, names[r].upper() if k % 2 else f" {names[r]} ", f"t{k}") for i, c in enumerate(talks) for k, r in enumerate(c)]
    data += [(None, 0, None, None), (None, None, "user", "last")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(5)
    for clash in ("cost", "action", "part", "rendered", "block", "state"):
        df = df.withColumn(clash, F.lit("clash"))
    for block in (1024, 2):
        out = {}
        for r in chat.repair(df, block=block).orderBy("conv_id", "turn", "part").collect():
            out.setdefault(r["conv_id"], []).append(r)
        for i, c in enumerate(talks):
            assert out[i][0]["cost"] == cheapest(c), (c, block)
            said = [chat.ROLES.index(r["role"]) for r in out[i] if r["role"] and not r["action"] == "merge"]
            assert all(p in chat.LEGAL for p in zip([chat.START, *said], said)) and said[-1] == 2
            text = "".join(r["rendered"] for r in out[i])
            assert text.count("<|end|>") == len(said) and all(f"t{k}" in text for k in range(len(c)))
    assert chat.repair(df.limit(0)).count() == 0


def test_chat_ties_and_nulls(spark):
    odd = spark.createDataFrame([(7, 1, "user", "b"), (7, 1, "user", "a"), (7, 2, "assistant", None), (7, 2, "assistant", None), (None, 0, None, None), (None, None, "user", "last")], "conv_id long, turn long, role string, text string").repartition(3)
    for block in (1024, 1):
        said = chat.repair(odd, block=block).orderBy("conv_id", F.col("turn").asc_nulls_last(), "part").collect()
        seven, none = [r for r in said if r["conv_id"] == 7], [r for r in said if r["conv_id"] is None]
        assert [(r["role"], r["action"]) for r in seven] == [("user", "keep"), ("user", "merge"), ("assistant", "keep"), ("assistant", "merge"), (None, "end")] and {r["cost"] for r in seven} == {2}
        text = "".join(r["rendered"] for r in seven)
        assert text.index("a") < text.index("b") and text.count("<|end|>") == 2  # turns of one number go by text
        assert {r["cost"] for r in none} == {cheapest((3, 1))} and "last" in "".join(r["rendered"] for r in none)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_quality(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    net = quality.fit(docs, labels)
    got = rows(quality.score(docs, net), "doc_id", "held_out", "score", "predicted")
    truth = rows(labels, "doc_id", "quality")
    assert all(v[0] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= v[1] <= 1 and v[2] == (v[1] >= 0.3) for i, v in got.items())
    held = [(got[i][2], q[0]) for i, q in truth.items() if got[i][0]]
    assert sum(p == q for p, q in held) / len(held) >= 0.9
    odd = spark.createDataFrame([(1, None), (None, ""), (3, "x" * 5000), (3, "x" * 5000)], "doc_id long, text string")
    out = quality.score(odd, net).collect()
    assert len(out) == 4 and all(0 <= r["score"] <= 1 for r in out)
    assert quality.score(odd.limit(0), net).count() == 0


def test_every_byte_is_in_a_chunk():
    for n in (0, 1, 447, 448, 449, 512, 513, 960, 961, 5000):
        lo, hi = quality.chunk_bounds(n)
        assert lo[0] == 0 and hi[-1] >= n and (hi[:-1] - lo[1:] >= quality.WIDTH - 1).all() and (hi - lo <= quality.CHUNK).all()


def random_network(seed=0):
    r = np.random.default_rng(seed)
    return quality.Network(r.normal(size=(quality.WIDTH, 256, quality.FILTERS)).astype(np.float32), r.normal(size=quality.FILTERS).astype(np.float32), r.normal(size=3 * quality.FILTERS).astype(np.float32) / 50, 0.1)


def test_chunks_at_once_are_chunks_alone():
    net, r = random_network(), np.random.default_rng(0)
    text = r.integers(97, 123, 130_000).astype(np.uint8)
    for n in (0, 3, 445, 448, 513, 700, 130_000):
        got = quality.chunk_filters(text[:n], net, net.pairs())
        lo, hi = quality.chunk_bounds(n)
        alone = np.zeros((len(lo), quality.CHUNK + quality.WIDTH - 1), np.uint8)
        for k, a in enumerate(lo):
            part = text[:n][a : a + quality.CHUNK + quality.WIDTH - 1]
            alone[k, : len(part)] = part
        assert np.allclose(got, net.pooled(alone, hi - lo)[0], atol=1e-4)


def test_score_by_hand(spark):
    """The score of whole texts, partial chunks among them, against loops over every place and filter."""
    net, r = random_network(), np.random.default_rng(1)
    texts = [None, "", "é x", "short text", *("".join(map(chr, r.integers(97, 123, n))) for n in (447, 449, 600, 1400))]

    def by_hand(text):
        body, pooled = (text or "").encode(), []
        for lo in range(0, max(1, len(body) - 64), 448):
            places = range(lo, min(lo + 512, max(1, len(body))))
            seen = [sum(net.taps[j][body[p + j] if p + j < len(body) else 0].astype(float) for j in range(6)) for p in places]
            pooled.append(np.maximum(np.max(seen, 0) + net.bias, 0))
        z = np.array(pooled)
        return 1 / (1 + np.exp(-(np.concatenate([z.mean(0), z.max(0), z.min(0)]) @ net.head + net.shift)))

    odd = spark.createDataFrame([(i, t, "clash", 1.0, 2) for i, t in enumerate(texts)], "doc_id long, text string, _bytes string, score double, predicted int")
    got = rows(quality.score(odd, net), "doc_id", "score", "predicted")
    for i, t in enumerate(texts):
        assert abs(got[i][0] - by_hand(t)) < 1e-4 and got[i][1] == (got[i][0] >= 0.3)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, common.written(stage(spark, kept, SF), "stage")
        assert kept.columns == corpus_pipeline.COLUMNS
        if name != "mixing sources":
            assert 0 < kept.count() <= before.count()
    texts = [r["text"] for r in kept.collect()]
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert packed.where("piece = 0").count() == len(texts)


def test_pipeline_stages_by_brute_force(spark):
    """Every stage on rows with nulls, repeated rows and ids, ties and an empty table, against loops."""
    pipeline = pytest.importorskip("corpus_pipeline")
    stages, types = dict(pipeline.STAGES), "doc_id long, text string, lang string, source string, n_chars long"
    base = [f"w{i}" for i in range(60)]
    long, other = " ".join(base), " ".join(f"x{i}" for i in range(40))
    close = " ".join([*base[:59], "changed"])
    data = [(5, long, "en", "a", 1), (3, close, "en", "b", 2), (3, other, None, None, None), (3, close, "en", "b", 2), (7, long + " ", "en", "a", 3), (None, None, None, None, None), (None, "", "en", "a", 0), (8, "one two", "en", "a", 4), (2, other.upper(), "en", "b", 5)]
    docs = spark.createDataFrame(data, types).repartition(3)
    got = lambda df: sorted(map(tuple, df.collect()), key=str)
    run = lambda name, d: got(stages[name](spark, d, SF))

    best = {}
    for row in data:
        body = "".join((row[1] or "").split())
        rank = (-len(row[1] or ""), row[0] is None, row[0] or 0)
        if body not in best or rank < best[body][0]:
            best[body] = (rank, row)
    exact = run("exact dedup", docs)
    assert [r for r in exact if r[1]] == sorted([v[1] for k, v in best.items() if k], key=str) and len([r for r in exact if not r[1]]) == 1

    near = run("n-gram Jaccard join", docs)
    want = [(3, close, "en", "b", 2), (2, other.upper(), "en", "b", 5), (8, "one two", "en", "a", 4), (None, None, None, None, None), (None, "", "en", "a", 0)]
    assert near == sorted(want, key=str)

    taken = run("mixing sources", docs)
    for s in {r[3] for r in data}:
        size = sum(len((r[1] or "").split()) for r in data if r[3] == s)
        assert sum(len((r[1] or "").split()) for r in taken if r[3] == s) <= 2 * size
    assert set(taken) <= set(data) and all((r[1] or "").split() for r in taken)
    assert all(taken.count(r) <= 2 * data.count(r) for r in set(taken))

    packed = stages["best-fit packing"](spark, docs, SF).collect()
    assert sorted(str(r["doc_id"]) for r in packed) == sorted(str(r[0]) for r in data)
    scored = run("quality classifier", docs)
    assert all(scored.count(r) == data.count(r) for r in set(scored))
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_embeddings_of_one_dense_group(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=32) + r.normal(size=(3000, 32)) * 0.2  # median cosine 0.96
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    got = rows(embedding_dedup.near_dedup(df), "vec_id", "n_links")
    u = embedding_dedup.unit(list(x))
    links = (u @ u.T >= 0.93).sum() - len(u)
    assert 0.98 * links <= sum(v[0] for v in got.values()) <= links


def test_a_full_reach_leaves_out_no_shard():
    r = np.random.default_rng(6)
    x = embedding_dedup.unit(list(r.normal(size=(30, 6))[r.integers(0, 30, 900)] + r.normal(size=(900, 6)) * 0.3))
    i, t, home = embedding_dedup.within(x, embedding_dedup.centroids(x, 40), np.sqrt(2 - 2 * 0.93))
    searched = np.zeros((900, 40), bool)
    searched[i, t] = True
    a, b = np.nonzero(x @ x.T >= 0.93)
    assert searched[a, home[b]].all()


def test_a_failed_audit_widens_the_search(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", 100)
    r, real, calls = np.random.default_rng(7), embedding_dedup.searched, []
    x = r.normal(size=(5, 32))[r.integers(0, 5, 400)] + r.normal(size=(400, 32)) * 0.2

    def poor(one, shared, reach, whole, least):
        calls.append((max(reach.values()), bool(whole)))
        seen = real(one, shared, reach, whole, least)
        return seen if whole else seen.withColumn("links", F.lit(0).cast("long"))

    monkeypatch.setattr(embedding_dedup, "searched", poor)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = rows(embedding_dedup.near_dedup(df), "vec_id", "n_links")
    u = embedding_dedup.unit(list(x))
    assert [got[i][0] for i in range(400)] == ((u @ u.T >= 0.93).sum(1) - 1).tolist()
    assert [w for _, w in calls] == [False, False, True] and calls[0][0] < calls[1][0] == calls[2][0]


def test_large_shards_are_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 90)
    r, looked, real = np.random.default_rng(8), [], embedding_dedup.searched
    x = r.normal(size=32) + r.normal(size=(500, 32)) * 0.2
    monkeypatch.setattr(embedding_dedup, "searched", lambda *a: looked.append(real(*a)) or looked[-1])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = rows(embedding_dedup.near_dedup(df), "vec_id", "n_links", "component_id")
    s = embedding_dedup.unit(list(x)) @ embedding_dedup.unit(list(x)).T >= 0.93
    want = roots(range(500), list(zip(*np.nonzero(s), strict=True)))
    assert 0.98 * (s.sum() - 500) <= sum(v[0] for v in got.values()) <= s.sum() - 500
    assert sum(got[i][1] == want[i] for i in want) >= 490
    assert looked[0].groupBy("cid").count().agg({"count": "min"}).first()[0] > 1  # rows of several tasks
