"""Ranked search, toxicity and hard negatives against brute force, with nulls, ties, repeated rows and empty tables."""

import itertools
import math
import os
import re
from collections import Counter

import numpy as np
import pytest
from helpers import LOWER, corpus, rows
from pyspark.sql import functions as F

from spanflow.llm import hard_negatives, lexical_search, toxicity

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, top):
    """Every item with every document."""
    bag = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(b) for _, b in bag), sum(sum(b.values()) for _, b in bag)
    df = Counter(t for _, b in bag for t in b)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in wanted.items():
        hits = []
        for i, b in bag:
            m = 50 + 50 * sum(b.values()) * n_docs // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in words if b[t])
            if s > 0:
                hits.append((-s, i is None, i))
        out += [(item, k + 1, h[2], -h[0]) for k, h in enumerate(sorted(hits, key=lambda h: (h[0], h[1], h[2] or 0))[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("item_bytes", [lexical_search.ITEM_BYTES, 300])
def test_search(spark, item_bytes):
    data = corpus(5, 120)
    data += [data[3], data[3], (None, data[3][1], *data[3][2:])] + [(500 + k, data[0][1], *data[0][2:]) for k in range(30)]  # repeated rows, a null id, copies
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, rank string, score string, item_id string, h string").repartition(5)
    items = [(0, data[0][1]), (1, "One a b c d"), (2, None), (3, ""), (4, data[1][1]), (4, data[2][1]), (None, data[4][1]), (7, "nowhereatall"), (8, " ".join(d[1] or "" for d in data[5:9]))]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    for top in (4, 50):
        got = sorted((tuple(r) for r in lexical_search.search(docs, table, top, item_bytes=item_bytes).select("item_id", "rank", "doc_id", "score").collect()), key=str)
        assert got == ranked([(r[0], r[1]) for r in data], items, top)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0
    assert lexical_search.search(spark.createDataFrame([(1, None), (2, "-")], "doc_id long, text string"), items).count() == 0


def test_classes_with_equal_hashes_stay_apart(spark, monkeypatch):
    data = corpus(6, 60)
    docs, items = spark.createDataFrame(data, "doc_id long, text string, a string, b string, c string, d string, e string"), [(0, data[0][1]), (1, data[1][1])]
    real = F.xxhash64
    monkeypatch.setattr(lexical_search.F, "xxhash64", lambda *c: real(*c) % 2)
    got = sorted((tuple(r) for r in lexical_search.search(docs, spark.createDataFrame(items, "item_id long, text string"), 9).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == ranked([(r[0], r[1]) for r in data], items, 9)


def mined(data, every, positives, negatives, low, high, scale=256):
    """Every anchor with every row."""
    ok = {}
    for i, v, label in data:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [math.floor(scale * float(np.float32(x))) for x in v])
        ok[i] = min(ok.get(i, row), row)
    out = []
    for a, (label, x) in ok.items():
        if a % every:
            continue
        s = {i: sum(p * q for p, q in zip(x, y, strict=True)) for i, (_, y) in ok.items() if i != a and len(y) == len(x)}
        best = lambda ids: sorted(ids, key=lambda i: (-s[i], i))
        for p in best(i for i in s if ok[i][0] == label)[:positives]:
            band = [i for i in s if ok[i][0] != label and low * s[p] <= 100 * s[i] <= high * s[p]]
            out += [(a, p, k + 1, i, s[p], s[i]) for k, i in enumerate(best(band)[:negatives])]
    return sorted(out)


def embedded(seed, n=400, dim=6):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(9, dim))
    out = [(i, (centers[i % 9] + r.normal(size=dim) * 0.4).astype(np.float32).tolist(), int(r.integers(0, 4))) for i in range(n)]
    out += [(n + k, centers[0].tolist(), k % 3) for k in range(60)]  # copies: ties
    out += [out[10], out[20], (20, out[21][1], 9)]  # repeated rows, two rows of one id
    out += [(1000, None, 0), (1010, [0.0] * dim, 0), (1020, [float("nan")] * dim, 0), (1030, [None] * dim, 0), (1040, [], 0), (1041, [], 1), (1042, [], 0), (1050, [1.0], 0), (1051, [2.0], 0), (1052, [1.0], 1)]
    out += [(1060, centers[1].tolist(), None), (None, centers[1].tolist(), 1), (1070, [float("inf")] + [1.0] * (dim - 1), 2), (-10, centers[2].tolist(), 3)]
    return out


@pytest.mark.parametrize(("block", "cluster", "shard"), [(1024, 32, 8192), (7, 3, 50), (3, 1, 1000)])
def test_hard_negatives(spark, monkeypatch, block, cluster, shard):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "CLUSTER", cluster)
    monkeypatch.setattr(hard_negatives, "SHARD", shard)
    monkeypatch.setattr(hard_negatives, "STEP", 16)
    data = embedded(block)
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(5)
    for clash in ("home", "part", "x", "shard", "rank", "anchor_id"):
        df = df.withColumn(clash, F.lit("clash"))
    got = sorted(tuple(r) for r in hard_negatives.mine(df, every=10).collect())
    assert got == mined(data, 10, 5, 10, 30, 90) and len(got) > 500
    assert hard_negatives.mine(df.limit(0)).count() == 0


def test_lists_end_before_their_end():
    """Rows far from an anchor are certified without being scored, and nothing that counts is left out."""
    r = np.random.default_rng(1)
    rows_ = np.floor(256 * np.concatenate([r.normal(size=(200, 8)) * 0.05 + 1, r.normal(size=(3000, 8)) * 0.05 - 1])).astype(np.int64)
    anchors, seen, best = rows_[:10], [], {}

    def visit(k, places, s):
        seen.append(len(places))
        best[k] = max(best.get(k, -1), int(s.max()))

    hard_negatives.walk(anchors, rows_, visit, lambda k, bound: k in best and bound < best[k])
    assert sum(seen) < 0.3 * len(anchors) * len(rows_)
    assert all(best[k] == (anchors[k] @ rows_.T).max() for k in range(len(anchors)))


def test_products_beyond_doubles_are_exact():
    a = np.array([[2**31, 3], [-(2**40), 1]], np.int64)
    assert hard_negatives.products(a, a).tolist() == [[2**62 + 9, 1 - 2**63], [1 - 2**63, 2**63 - 1]]


def test_marginals_are_those_of_all_taggings(monkeypatch):
    """Against the sum over all sequences of tags."""
    monkeypatch.setattr(toxicity, "CHAIN", 3)
    r = np.random.default_rng(2)
    sizes, steps = [0, 1, 7, 3, 0, 10], r.normal(size=(2, 2))
    e = r.normal(size=sum(sizes)) * 2
    got, at = toxicity.marginals(e, np.cumsum([0, *sizes[:-1]]), steps), 0
    for n in sizes:
        total, each = 0.0, np.zeros(n)
        for tags in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(e[at + i] * t for i, t in enumerate(tags)) + sum(steps[a, b] for a, b in zip((0, *tags), tags, strict=False)))
            total += w
            each += w * np.array(tags)
        assert np.allclose(got[at : at + n], each / total)
        at += n


def test_a_long_text_is_one_chain():
    """Messages that go from chain to chain are those of a walk token by token."""
    r = np.random.default_rng(4)
    e, steps = r.normal(size=20_000), np.array([[0.5, -1], [-1, 0.5]])
    got = toxicity.marginals(e, np.array([0]), steps)
    want = toxicity.messages(np.exp(e)[None], np.ones((1, len(e)), bool), np.array([[1.0, 0]]), np.ones((1, 2)), np.exp(steps))[2]
    assert np.allclose(got, want[0])


def test_training_finds_the_tags():
    r = np.random.default_rng(0)
    units = r.integers(1, 40, (200, toxicity.SEQUENCE, 1 + len(toxicity.BEGINNINGS))).astype(np.uint64)
    tags = (units[:, :, 0] < 8).astype(int)
    units += 1000 * np.arange(units.shape[2], dtype=np.uint64)
    tags[5:, 20:] = -1
    field = toxicity.train(units, tags, decay=0.0, least_steps=800)
    mask = tags >= 0
    e = np.zeros(mask.shape)
    e[mask] = field.evidence(field.places(units)[mask], np.append(0, np.cumsum(mask.sum(1)))[:-1])
    prob = toxicity.messages(np.exp(e), mask, np.tile([1.0, 0], (200, 1)), np.ones((200, 2)), np.exp(field.steps))[2]
    assert ((prob > 0.5) == (tags == 1))[mask].mean() > 0.99


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_toxicity(spark):
    docs, labels = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet"), spark.read.parquet(SF.replace("0.001", "0.01") + "/labels.parquet")
    field = toxicity.fit(docs, labels)
    got = rows(toxicity.score(docs, field), "doc_id", "held_out", "score", "predicted", "spans")
    truth = {i: t for i, (t,) in rows(labels.where("toxic IS NOT NULL"), "doc_id", "toxic").items() if got[i][0]}
    right = sum(got[i][2] == t for i, t in truth.items()) / len(truth)
    pairs = [(got[a][1] > got[b][1]) + (got[a][1] == got[b][1]) / 2 for a in truth if truth[a] for b in truth if not truth[b]]
    assert right >= 0.9 and np.mean(pairs) >= 0.8
    again = rows(toxicity.score(docs.repartition(7), toxicity.fit(docs.repartition(7), labels.repartition(3))), "doc_id", "score")
    assert all(abs(again[i][0] - got[i][1]) < 1e-9 for i in got)
    odd = spark.createDataFrame([(1, "Such a IDIOT, é, you stupid\tclown", "clash"), (2, None, None), (3, "", None), (None, "x", None), (5, "a " * 200_000 + "moron", None), (5, "a", None)], "doc_id long, text string, score string")
    out = toxicity.score(odd.coalesce(1), field).collect()
    found = next(r for r in out if r["doc_id"] == 1)
    text = "Such a IDIOT, é, you stupid\tclown"
    assert "IDIOT" in {text[s["start"] : s["start"] + s["length"]] for s in found["spans"]} and found["predicted"] == 1
    assert len(out) == 6 and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(odd.limit(0), field).count() == 0
    nothing = toxicity.fit(docs, labels.limit(0))
    assert all(r[0] == 0 for r in rows(toxicity.score(docs, nothing), "doc_id", "predicted").values())
