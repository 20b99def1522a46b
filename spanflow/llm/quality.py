"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanflow.llm import kernels as K
from spanflow.llm.common import batched, columns

#: Bytes that one filter sees, filters, bytes of a chunk and between the starts of two chunks.
WIDTH, FILTERS, CHUNK, STRIDE = 6, 24, 512, 448
#: Chunks that are pooled at a time in training.
BLOCK = 64


def chunk_bounds(size: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the overlapping chunks that cover a text of ``size`` bytes."""
    lo = np.arange(0, max(1, size - (CHUNK - STRIDE)), STRIDE)
    return lo, np.minimum(lo + CHUNK, max(1, size))


@dataclass
class Network:
    """taps[j] is what byte j of a filter's window adds to each filter; ``head`` weighs mean, greatest
    and least of the chunks' pooled filters."""

    taps: np.ndarray
    bias: np.ndarray
    head: np.ndarray
    shift: float

    def pooled(self, chunks: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks (n, CHUNK + WIDTH - 1) of bytes, of which ``size`` places are the text's, to pooled filters and where they were greatest."""
        z, best = np.empty((len(chunks), FILTERS), np.float32), np.empty((len(chunks), FILTERS), np.int64)
        for lo in range(0, len(chunks), BLOCK):  # so that what all places of all filters take is bounded
            some = slice(lo, lo + BLOCK)
            total = self.taps[0][chunks[some, :CHUNK]]
            for j in range(1, WIDTH):
                total += self.taps[j][chunks[some, j : CHUNK + j]]
            total[np.arange(CHUNK) >= size[some, None]] = -np.inf
            best[some] = total.argmax(1)
            z[some] = np.maximum(np.take_along_axis(total, best[some, None], 1)[:, 0] + self.bias, 0)
        return z, best

    def pairs(self) -> list[np.ndarray]:
        """Tables for two bytes at once, which halve the lookups."""
        return [(self.taps[j][:, None] + self.taps[j + 1][None]).reshape(65536, FILTERS) for j in range(0, WIDTH, 2)]


def logits(z: np.ndarray, first: np.ndarray, net: Network) -> np.ndarray:
    """Pooled chunks of documents that begin at ``first`` to one logit each."""
    n = np.diff(np.append(first, len(z)))[:, None]
    x = np.concatenate([np.add.reduceat(z, first) / n, np.maximum.reduceat(z, first), np.minimum.reduceat(z, first)], 1)
    return x @ net.head + net.shift


def train(chunks: np.ndarray, size: np.ndarray, doc: np.ndarray, labels: np.ndarray, epochs: int = 14, rate: float = 0.02, seed: int = 5) -> Network:
    """Fits by Adam on chunks (rows sorted by document), their sizes and a label per document."""
    rng = np.random.default_rng(seed)
    p = {"taps": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), "bias": np.zeros(FILTERS, np.float32), "head": rng.normal(0, 0.1, 3 * FILTERS).astype(np.float32), "shift": np.zeros(1, np.float32)}
    m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    last = np.append(first[1:], len(doc))
    share = float(labels.mean()) if len(labels) else 0.5
    cost = np.where(labels == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3)) ** 0.5
    for epoch in range(epochs if len(labels) and 0 < share < 1 else 0):
        order = rng.permutation(len(first))
        for at in range(0, len(order), 64):
            some = np.sort(order[at : at + 64])
            rows = np.concatenate([np.arange(first[i], last[i]) for i in some])
            begin = np.append(0, np.cumsum(last[some] - first[some]))[:-1]
            net = Network(p["taps"], p["bias"], p["head"], float(p["shift"][0]))
            x = chunks[rows]
            z, best = net.pooled(x, size[rows])
            y = 1 / (1 + np.exp(-np.clip(logits(z, begin, net), -30, 30)))
            d = ((y - labels[some]) * cost[some] / len(some)).astype(np.float32)
            n = np.diff(np.append(begin, len(z)))
            own = np.repeat(np.arange(len(some)), n)
            hi, lo, mean = np.maximum.reduceat(z, begin), np.minimum.reduceat(z, begin), np.add.reduceat(z, begin) / n[:, None]
            h = p["head"].reshape(3, FILTERS)
            dz = d[own][:, None] * (h[0] / n[own][:, None] + h[1] * (z == hi[own]) + h[2] * (z == lo[own])) * (z > 0)
            g = {"head": (np.concatenate([mean, hi, lo], 1) * d[:, None]).sum(0), "shift": d.sum(keepdims=True), "bias": dz.sum(0), "taps": np.zeros_like(p["taps"])}
            for j in range(WIDTH):
                np.add.at(g["taps"][j], (np.take_along_axis(x, best + j, 1), np.arange(FILTERS)[None]), dz)
            t += 1
            step = rate * min(1, 2 * (1 - epoch / epochs))
            for k in p:
                gk = g[k] + (1e-4 * p[k] if k in ("taps", "head") else 0)
                m[k] += 0.1 * (gk - m[k])
                v[k] += 0.001 * (gk * gk - v[k])
                p[k] -= (step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return Network(p["taps"], p["bias"], p["head"], float(p["shift"][0]))


def held_out(doc_id: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = 3000, most_chunks: int = 12) -> Network:
    """Learns from ``most`` labelled documents at most, chosen by a hash of their
    ids, and ``most_chunks`` chunks spread evenly over each: a sample of fixed size."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).join(F.broadcast(known), "doc_id")
    text = text.groupBy("doc_id").agg(F.min(F.struct("text", "quality")).alias("t")).select("doc_id", "t.*")  # of several rows of one id the least text

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("chunk", pa.int32()), ("size", pa.int32()), ("bytes", pa.binary())])
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                lo, hi = chunk_bounds(len(r["text"]))
                keep = range(len(lo)) if len(lo) <= most_chunks else np.linspace(0, len(lo) - 1, most_chunks).astype(int)
                rows += [(r["doc_id"], r["quality"], int(k), int(hi[k] - lo[k]), r["text"][lo[k] : lo[k] + CHUNK + WIDTH - 1]) for k in keep]
            yield from batched(schema, [list(x) for x in zip(*rows, strict=True)] or [[]] * 5)

    got = text.mapInArrow(spread, "doc_id long, quality int, chunk int, size int, bytes binary").toArrow().sort_by([("doc_id", "ascending"), ("chunk", "ascending"), ("bytes", "ascending")])
    chunks = np.zeros((len(got), CHUNK + WIDTH - 1), np.uint8)
    for i, b in enumerate(got["bytes"].to_pylist()):
        chunks[i, : len(b)] = np.frombuffer(b, np.uint8)
    doc, size, quality = (got[c].to_numpy().copy() for c in ("doc_id", "size", "quality"))
    del got
    new = np.append(True, doc[1:] != doc[:-1]) if len(doc) else np.zeros(0, bool)
    return train(chunks, size, doc, quality[new].astype(np.float32))


def score(docs: DataFrame, net: Network, threshold: float = 0.3, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, and the columns ``keep``.

    Every byte of a text lies in a chunk; chunks overlap by more than a filter's width.
    Filters are max-pooled in each chunk, and mean, greatest and least of the chunks give one
    probability. Null and empty texts are one chunk of zeros. Null ids are not held out, repeated
    rows are scored alike, an empty table gives no rows. Rows are independent: no shuffle;
    the network, of fixed size, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    text = docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_bytes"), F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), *(c for c in keep if c != "doc_id"))
    out = text.drop("_bytes").withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, tables = shared.value, shared.value.pairs()
        for batch in batches:
            data, at = K.buffers(columns(batch)["_bytes"])
            probs = []
            for lo, hi in K.pieces(at, 1 << 18):
                z, first = [], []
                for b, e in ((at[i], at[i + 1]) for i in range(lo, hi)):
                    first.append(sum(map(len, z)))
                    z.append(chunk_filters(data[b:e], net, tables))
                probs.append(1 / (1 + np.exp(-np.clip(logits(np.concatenate(z), np.array(first), net), -30, 30))))
            p = np.concatenate(probs).astype(np.float64) if probs else np.zeros(0)
            rest = [c for k, c in enumerate(batch.columns) if batch.schema.names[k] != "_bytes"]
            names = [n for n in batch.schema.names if n != "_bytes"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    return text.mapInArrow(scores, out)


def chunk_filters(text: np.ndarray, net: Network, tables: list[np.ndarray]) -> np.ndarray:
    """Pooled filters of all chunks of one text, in steps of bounded size."""
    lo, hi = chunk_bounds(len(text))
    out, many = [], 256
    for k in range(0, len(lo), many):
        a, b = lo[k], hi[min(k + many, len(lo)) - 1]
        x = np.zeros(b - a + WIDTH, np.uint16)
        piece = text[a : b + WIDTH - 1]
        x[: len(piece)] = piece
        two = x[:-1] << 8 | x[1:]
        n = b - a
        total = np.take(tables[0], two[:n], 0)
        for j in range(1, WIDTH // 2):
            total += np.take(tables[j], two[2 * j : 2 * j + n], 0)
        bounds = np.stack([lo[k : k + many] - a, hi[k : k + many] - a], 1).ravel()
        bounds[-1:] = n if bounds[-1] > n else bounds[-1]
        cut = bounds[:-1] if bounds[-1] >= n else bounds
        out.append(np.maximum.reduceat(total, cut, 0)[::2])
    return np.maximum(np.concatenate(out) + net.bias, 0)
