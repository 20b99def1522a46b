"""Toxicity: a linear-chain conditional random field that tags toxic spans."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanflow.llm import kernels as K
from spanflow.llm.common import batched, columns
from spanflow.llm.quality import held_out

#: Bytes of the word beginnings that have weights, and tokens that are chained one by one.
BEGINNINGS, CHAIN = (5, 7, 8), 64
#: Tokens of a training sequence, and sequences of one document at most.
SEQUENCE, SEQUENCES = 32, 12
#: Units that may mark toxic text, at most; how many more times a marking unit is found in toxic texts than in others; one toxic text in how many must hold it.
CANDIDATES, LIFT, SHARE = 20_000, 20, 50
#: Times that a unit must be seen in training to have weights of its own.
RARE = 3
_TERM = np.array([b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms (ASCII letters, lower-cased, digits, and all bytes beyond ASCII) of some documents: starts and ends from at[0], units
    (columns: codes of the word and of its BEGINNINGS), and where each document's terms begin."""
    low = _TERM[data[at[0] : at[-1]]]
    starts, ends, codes, first = K.words(low, at - at[0])
    n, packed, units = ends - starts, np.zeros(len(starts), np.uint64), np.empty((len(starts), 1 + len(BEGINNINGS)), np.uint64)
    units[:, 0] = codes
    wide = np.append(low, np.zeros(8, np.uint8))
    for i in range(8):
        byte = wide[starts + i].astype(np.uint64)
        byte[n <= i] = 0
        packed |= byte << np.uint64(8 * i)
    for j, k in enumerate(BEGINNINGS):
        units[:, 1 + j] = K.mix((packed & np.uint64(2 ** (8 * k) - 1)) + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64))
    return starts, ends, units, first


@dataclass
class Field:
    """Weights of the toxic tag (the other has none): by unit (word or beginning), and by the words before and after; and potentials
    of neighbouring tags, ``steps[before, after]``. The tag before a text is the clean one. The last rows of
    ``weight`` are those of unknown units of each kind. ``final`` makes a document's score of its tokens' probabilities."""

    known: np.ndarray
    weight: np.ndarray
    bias: float
    steps: np.ndarray
    final: np.ndarray

    def places(self, units: np.ndarray) -> np.ndarray:
        """Rows of the units' weights."""
        unknown = np.broadcast_to(len(self.known) + np.arange(units.shape[-1]), units.shape)
        if not len(self.known):
            return unknown
        at = np.searchsorted(self.known, units)
        at[at == len(self.known)] = 0
        return np.where(self.known[at] == units, at, unknown)

    def evidence(self, places: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log-potential of the toxic tag for every token."""
        total = self.bias + self.weight[places, 0].sum(1)
        inner = np.ones(len(places), bool)
        inner[first[first < len(places)]] = False  # no neighbour before a text's first token
        inner = np.flatnonzero(inner)
        total[inner] += self.weight[places[inner - 1, 0], 1]
        total[inner - 1] += self.weight[places[inner, 0], 2]
        return np.clip(total, -30, 30)


def messages(q: np.ndarray, mask: np.ndarray, left: np.ndarray, right: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward messages of sequences (rows) whose toxic potentials are ``q``, from the states ``left`` before
    and ``right`` after them, and the probability of the toxic tag. Where ``mask`` is false a message passes unchanged."""
    n, length = q.shape
    ahead, back = np.empty((length + 1, n, 2)), np.empty((length + 1, n, 2))
    ahead[0], back[length] = left, right
    for t in range(length):
        new = ahead[t] @ a
        new[:, 1] *= q[:, t]
        new /= new.sum(1, keepdims=True)
        ahead[t + 1] = np.where(mask[:, t : t + 1], new, ahead[t])
    for t in range(length - 1, -1, -1):
        new = back[t + 1] * np.stack([np.ones(n), q[:, t]], 1) @ a.T
        new /= new.sum(1, keepdims=True)
        back[t] = np.where(mask[:, t : t + 1], new, back[t + 1])
    both = ahead[1:] * back[1:]
    return ahead, back, (both[:, :, 1] / both.sum(2)).T


def marginals(evidence: np.ndarray, first: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Probability of the toxic tag for every token of documents that begin at ``first``.

    Documents are cut into chains of CHAIN tokens. What a chain does to a message is a 2 x 2 matrix, found
    for all chains at once; messages then go from chain to chain, and last through the tokens of all chains at
    once. Nothing is approximated, and steps grow with a document's length over CHAIN."""
    size = np.diff(np.append(first, len(evidence)))
    if not len(evidence):
        return np.zeros(0)
    a, chains = np.exp(steps), -(-size // CHAIN)
    begin = np.append(0, np.cumsum(chains))
    row = np.repeat(begin[:-1], size) + (np.arange(len(evidence)) - np.repeat(first, size)) // CHAIN
    col = (np.arange(len(evidence)) - np.repeat(first, size)) % CHAIN
    q, mask = np.ones((begin[-1], CHAIN)), np.zeros((begin[-1], CHAIN), bool)
    q[row, col], mask[row, col] = np.exp(evidence), True
    product = np.tile(np.eye(2), (begin[-1], 1, 1))
    for t in range(CHAIN):
        new = product @ a
        new[:, :, 1] *= q[:, t : t + 1]
        new /= new.sum((1, 2), keepdims=True)
        product = np.where(mask[:, t, None, None], new, product)
    left, right = np.empty((begin[-1], 2)), np.empty((begin[-1], 2))
    order = np.argsort(-chains, kind="stable")
    order = order[: int((chains > 0).sum())]
    left[begin[order]], right[begin[order + 1] - 1] = (1, 0), (1, 1)
    for k in range(1, int(chains.max(initial=0))):
        docs = order[: int(np.searchsorted(-chains[order], -k, "left"))]  # those with more than k chains
        at, last = begin[docs] + k, begin[docs + 1] - 1 - k
        new = np.einsum("ni,nij->nj", left[at - 1], product[at - 1])
        left[at] = new / new.sum(1, keepdims=True)
        new = np.einsum("nij,nj->ni", product[last + 1], right[last + 1])
        right[last] = new / new.sum(1, keepdims=True)
    return messages(q, mask, left, right, a)[2][row, col]


def train(units: np.ndarray, tags: np.ndarray, epochs: int = 10, least_steps: int = 500, rate: float = 0.1, decay: float = 2e-4, seed: int = 3) -> Field:
    """Fits by Adam on the likelihood of sequences (rows of SEQUENCE tokens, tag -1 past the end)."""
    known, often = np.unique(units[tags >= 0], return_counts=True)
    known = known[often >= RARE]  # the others are learned as what an unknown unit is
    p = {"weight": np.zeros((len(known) + units.shape[2], 3)), "bias": np.array([-2.0]), "steps": np.zeros((2, 2))}
    m, v, done = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    rng = np.random.default_rng(seed)
    field = lambda: Field(known, p["weight"], float(p["bias"][0]), p["steps"], np.zeros(3))
    places = field().places(units)
    epochs = max(epochs, -(-least_steps // max(1, -(-len(units) // 512))))
    for epoch in range(epochs if (tags == 1).any() else 0):
        order = rng.permutation(len(units))
        for lo in range(0, len(order), 512):
            y = tags[order[lo : lo + 512]]
            mask = y >= 0
            at = places[order[lo : lo + 512]][mask]
            first = np.append(0, np.cumsum(mask.sum(1)))[:-1]
            e = np.zeros(mask.shape)
            e[mask] = field().evidence(at, first)
            q, a = np.exp(e), np.exp(p["steps"])
            ahead, back, prob = messages(q, mask, np.tile([1.0, 0.0], (len(y), 1)), np.ones((len(y), 2)), a)
            d = (prob - (y == 1))[mask]
            inner = np.ones(len(d), bool)
            inner[first] = False
            inner = np.flatnonzero(inner)
            g = {"weight": np.empty_like(p["weight"]), "bias": d.sum(keepdims=True)}
            size = len(p["weight"])
            g["weight"][:, 0] = np.bincount(at.ravel(), np.repeat(d, at.shape[1]), size)
            g["weight"][:, 1] = np.bincount(at[inner - 1, 0], d[inner], size)
            g["weight"][:, 2] = np.bincount(at[inner, 0], d[inner - 1], size)
            emit = np.stack([np.ones_like(q), q], 2).transpose(1, 0, 2) * back[1:]
            pair = ahead[:-1, :, :, None] * a * emit[:, :, None, :]
            pair /= pair.sum((2, 3), keepdims=True)
            g["steps"] = (pair * mask.T[:, :, None, None]).sum((0, 1))
            before = np.concatenate([np.zeros((len(y), 1), int), np.maximum(y[:, :-1], 0)], 1)
            np.add.at(g["steps"], (before[mask], y[mask]), -1.0)
            done += 1
            step = rate * (1 - epoch / epochs)
            for k in p:
                gk = g[k] / len(y) + decay * p[k] * (k != "bias")
                m[k] += 0.1 * (gk - m[k])
                v[k] += 0.01 * (gk * gk - v[k])
                p[k] -= step * (m[k] / (1 - 0.9**done)) / (np.sqrt(v[k] / (1 - 0.99**done)) + 1e-6)
    return field()


def summary(prob: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per document: 1, the log-odds of its greatest token probability, and the log of how many toxic tokens are expected."""
    out = np.tile([1.0, -10.0, np.log(0.01)], (len(first), 1))
    some = np.flatnonzero(np.diff(np.append(first, len(prob))))
    if len(some):
        top = np.clip(np.maximum.reduceat(prob, first[some]), 4.5e-5, 1 - 4.5e-5)
        out[some, 1], out[some, 2] = np.log(top / (1 - top)), np.log(0.01 + np.add.reduceat(prob, first[some]))
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Weighted logistic regression by Newton's method, lightly damped."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(h, x.T @ (weight * (p - y)) + ridge * w), -2, 2)
    return w


def sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` labelled documents that are not held out, half of each label, chosen by a hash of the id: doc_id, toxic, text."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").alias("toxic"))
    some = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2)
        some = part if some is None else some.unionByName(part)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).join(F.broadcast(some), "doc_id")
    return text.groupBy("doc_id").agg(F.min(F.struct("text", "toxic")).alias("t")).select("doc_id", "t.*")  # of several rows of one id the least text


def marking_units(chosen: DataFrame) -> np.ndarray:
    """Codes of the words and word beginnings that mark toxic texts in the sample.

    A unit counts once per family of near copies (two least hashes of a text's words), so that what a copied text
    happens to hold marks little, and must be LIFT times as frequent in toxic families as in clean ones. The most frequent are taken, down
    to a third of the first, and then the same among the families that these do not explain, as long as a unit is in one family of SHARE."""
    schema = pa.schema([("family", pa.int64()), ("toxic", pa.int32()), ("code", pa.int64())])

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = columns(batch)
            data, at = K.buffers(b["text"])
            for i, toxic in enumerate(b["toxic"].to_pylist()):
                units = tokens(data, at[i : i + 2])[2]
                family = int(units[:, 0].min()) ^ int(K.mix(units[:, 0]).min()) if len(units) else 0
                units = np.unique(units)
                yield from batched(schema, [np.full(len(units), family, np.uint64).view(np.int64), np.full(len(units), toxic, np.int32), units.view(np.int64)])

    words = chosen.mapInArrow(distinct, "family long, toxic int, code long").distinct()
    n_toxic, n_clean = words.agg(F.count_distinct(F.when(F.col("toxic") == 1, F.col("family"))), F.count_distinct(F.when(F.col("toxic") == 0, F.col("family")))).first()
    least = max(2, n_toxic // SHARE)
    count = words.groupBy("code").agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean"), F.collect_list(F.when(F.col("toxic") == 1, F.col("family"))).alias("families"))  # of a sample of bounded size
    likely = (F.col("toxic") + 0.5) * (n_clean + 1) >= LIFT * (F.col("clean") + 0.5) * (n_toxic + 1)
    held = {r["code"]: set(r["families"]) for r in count.where((F.col("toxic") >= 2) & likely).orderBy(F.col("toxic").desc(), "code").limit(CANDIDATES).collect()}
    taken: list[int] = []
    while held and (most := max(map(len, held.values()))) >= least:
        now = [k for k, f in held.items() if 3 * len(f) >= most and len(f) >= 2]
        explained = set().union(*(held[k] for k in now))
        taken += now
        held = {k: f - explained for k, f in held.items() if k not in set(now)}
    return np.sort(np.array(taken, np.int64).view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame, most: int = 4000) -> Field:
    """Learns from at most ``most`` labelled documents that are not held out (:func:`sample`), and of each from at most SEQUENCES sequences of SEQUENCE tokens.

    Labels are given for documents; those of tokens follow from them: in toxic documents tokens with a unit of
    :func:`marking_units` are toxic, all other tokens are clean. Half of a document's sequences are those
    with toxic tokens, the others are spread evenly over the whole text. How token probabilities become a
    document's score is learned last, from the sample's whole texts, weighted as the labels of all documents are."""
    chosen = sample(docs, labels, most)
    shared = docs.sparkSession.sparkContext.broadcast(marking_units(chosen))
    schema = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("units", pa.binary()), ("tags", pa.binary())])

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = lambda x, n: x[np.linspace(0, len(x) - 1, n).astype(int)] if len(x) > n else x
        for batch in batches:
            b, rows = columns(batch), []
            data, at = K.buffers(b["text"])
            for i, (doc, toxic) in enumerate(zip(b["doc_id"].to_pylist(), b["toxic"].to_pylist(), strict=True)):
                units = tokens(data, at[i : i + 2])[2]
                tags = (np.isin(units, shared.value).any(1) & (toxic == 1)).astype(np.int8)
                starts = np.arange(0, len(units), SEQUENCE)
                with_tag = np.unique(np.flatnonzero(tags) // SEQUENCE)
                for k in np.unique(np.append(spread(with_tag, SEQUENCES // 2), spread(np.arange(len(starts)), SEQUENCES // 2))):
                    s = slice(starts[k], starts[k] + SEQUENCE)
                    rows.append((doc, int(starts[k]), units[s].tobytes(), tags[s].tobytes()))
            yield from batched(schema, [list(x) for x in zip(*rows, strict=True)] or [[]] * 4)

    got = chosen.mapInArrow(sequences, "doc_id long, at long, units binary, tags binary").toArrow().sort_by([("doc_id", "ascending"), ("at", "ascending")])
    n = len(got)
    units, tags = np.zeros((n, SEQUENCE, 1 + len(BEGINNINGS)), np.uint64), np.full((n, SEQUENCE), -1, np.int8)
    for i, (u, y) in enumerate(zip(got["units"].to_pylist(), got["tags"].to_pylist(), strict=True)):
        units[i, : len(y)], tags[i, : len(y)] = np.frombuffer(u, np.uint64).reshape(len(y), -1), np.frombuffer(y, np.int8)
    field = train(units, tags.astype(int))
    learned = docs.sparkSession.sparkContext.broadcast(field)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("toxic", pa.int32()), ("top", pa.float64()), ("many", pa.float64())])
        for batch in batches:
            b = columns(batch)
            for rows, prob, _, _, first in tagged(learned.value, b["text"]):
                x = summary(prob, first)
                yield from batched(schema, [b["toxic"].slice(rows.start, len(rows)), x[:, 1], x[:, 2]])

    x = chosen.select("text", "toxic").mapInArrow(summaries, "toxic int, top double, many double").toArrow()
    share = {r["toxic"]: r["n"] for r in labels.where("toxic IS NOT NULL").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).where("toxic IN (0, 1)").collect()}
    y = x["toxic"].to_numpy()
    order = np.lexsort((x["many"].to_numpy(), x["top"].to_numpy(), y))  # sums do not depend on the order of rows
    y, top, many = y[order], x["top"].to_numpy()[order], x["many"].to_numpy()[order]
    weight = np.ones(len(y))
    for label in (0, 1):
        weight[y == label] = share.get(label, 0) / max(1, (y == label).sum()) * len(y) / max(1, sum(share.values()))
    field.final = logistic(np.stack([np.ones(len(y)), top, many], 1), y, weight) if len(y) else np.array([-3.0, 0, 0])
    return field


def tagged(field: Field, text: pa.Array) -> Iterator[tuple[range, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows: their tokens' probabilities, starts and ends (from the first row's), and where each row's tokens begin."""
    data, at = K.buffers(text)
    for lo, hi in K.pieces(at, 1 << 18):
        starts, ends, units, first = tokens(data, at[lo : hi + 1])
        yield range(lo, hi), marginals(field.evidence(field.places(units), first[:-1]), first[:-1], field.steps), starts, ends, first[:-1]


def score(docs: DataFrame, field: Field, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted and spans, the offending places (start and length in characters, score).

    Forward-backward over all tokens of a text gives each token's probability of being toxic. The greatest of them and their
    sum make the score (with no tokens, as in null and empty texts, both are the least that can be). Runs of neighbouring tokens of ``threshold``
    or more are the spans. Null ids are not held out, repeated rows are scored alike, an empty table gives no
    rows, other columns are not read. Rows are independent: no shuffle; the weights, of bounded size, are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("spans", pa.list_(span))])

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            b = columns(batch)
            data, at = K.buffers(b["text"])
            p, spans = np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            for rows, prob, starts, ends, first in tagged(field, b["text"]):
                p[rows.start : rows.stop] = 1 / (1 + np.exp(-np.clip(summary(prob, first) @ field.final, -30, 30)))
                doc = np.repeat(np.arange(rows.start, rows.stop), np.diff(np.append(first, len(prob))))
                for i, j in runs(prob >= threshold, doc):
                    d, s, e = int(doc[i]), int(starts[i] + at[rows.start]), int(ends[j - 1] + at[rows.start])
                    begin, length = (int(np.count_nonzero(data[x:y] & 0xC0 != 0x80)) for x, y in ((at[d], s), (s, e)))
                    spans[d].append({"start": begin, "length": length, "score": float(prob[i:j].max())})
            yield from batched(schema, [b["doc_id"], b["held_out"], p, (p >= threshold).astype(np.int32), spans])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return text.mapInArrow(tag, "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start long, length long, score double>>")


def runs(on: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
    """Half-open runs of neighbouring tokens of one document that are ``on``."""
    at = np.flatnonzero(on)
    if not len(at):
        return []
    cut = np.flatnonzero((np.diff(at) > 1) | (doc[at[1:]] != doc[at[:-1]])) + 1
    return [(int(x[0]), int(x[-1]) + 1) for x in np.split(at, cut)]
