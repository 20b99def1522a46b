"""Suffix-array dedup: hash-compared suffix sort of the passages that share an anchor."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanflow.llm import kernels as K
from spanflow.llm.common import batched, columns
from spanflow.llm.windows import LAST, finished, first_of, repeated, spots, unique_texts

#: Passages of one anchor that are sorted together at most: some 2 kB each.
MANY = 20_000


class Suffixes:
    """Suffixes that begin at given places of a byte string, each with a bound, and
    compared by their hashes: a binary search over prefix hashes finds how far two
    agree, so that a comparison takes a number of steps logarithmic in the bound."""

    def __init__(self, data: np.ndarray, at: np.ndarray, size: np.ndarray):
        self.data, self.at, self.size = data, at, size
        self.hash = K.Prefix(K.BYTE_CODE[data])

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of suffixes i and j, by their hashes; what is removed for them is compared later."""
        a, b = self.at[i], self.at[j]
        lo, hi = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi + 1) >> 1
            equal = self.hash.of(a, a + mid) == self.hash.of(b, b + mid)
            lo = np.where(open_ & equal, mid, lo)
            hi = np.where(open_ & ~equal, mid - 1, hi)

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before j (a prefix before what it begins)."""
        n = self.common(i, j)
        ei, ej = n >= self.size[i], n >= self.size[j]
        last = len(self.data) - 1
        x, y = self.data[np.minimum(self.at[i] + n, last)], self.data[np.minimum(self.at[j] + n, last)]
        return np.where(ei | ej, ei & ~ej, x < y)

    def sort(self, group: np.ndarray) -> np.ndarray:
        """A merge sort by (group, suffix), stable; ``group`` is ascending. All runs of one
        length are merged at once: each suffix finds its rank in the run beside its
        own by binary search. Groups stand in order, so only runs inside a group are merged."""
        n = len(group)
        start = np.flatnonzero(first_of(group)) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(start, n))
        base, count = np.repeat(start, size), np.repeat(size, size)
        order, width = np.arange(n), 1
        while n and width < size.max():
            live = np.flatnonzero(count > width)  # others are sorted
            place = live - base[live]
            block = place // width
            left = block % 2 == 0
            other = np.where(left, block + 1, block - 1) * width
            lo, hi = np.minimum(other, count[live]), np.minimum(other + width, count[live])
            first, me = lo.copy(), order[live]
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) >> 1
                it, own = order[base[live][open_] + mid], me[open_]
                # Equal suffixes keep their order: those of the left run come first.
                on_left = left[open_]
                less = self.less(np.where(on_left, it, own), np.where(on_left, own, it))
                ahead = np.where(on_left, less, ~less)
                lo[open_] = np.where(ahead, mid + 1, lo[open_])
                hi[open_] = np.where(ahead, hi[open_], mid)
            to = base[live] + (block - block % 2) * width + place % width + lo - first
            merged = order.copy()
            merged[to] = me
            order, width = merged, width * 2
        return order


def earlier(table: pa.Table, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(uid, pk) of windows of ``w`` bytes whose bytes an earlier passage of the same anchor has.

    Suffixes at the anchors are sorted; where neighbours agree for less than what a
    window has right of its anchor, its class ends. Windows with the same number of bytes left
    of the anchor are equal when their classes and the hashes of these bytes are. Hashes may collide, so
    every window found is then compared with its first equal byte by byte, and where one differs, all with its key are grouped by their bytes."""
    h, uid, ord_, pk = (table.column(c).to_numpy() for c in ("h", "uid", "ord", "pk"))
    data, at = K.buffers(table.column("passage"))
    data, at = data[at[0] : at[-1]], at - at[0]
    n, a = pk >> 12 & 4095, pk & 4095
    anchor = at[:-1] + a
    s = Suffixes(data, anchor, at[1:] - anchor)
    order = s.sort(h)
    agree = np.zeros(len(h), np.int64)
    if len(h) > 1:
        agree[1:] = np.where(h[order[1:]] == h[order[:-1]], s.common(order[1:], order[:-1]), -1)
    agree[:1] = -1
    out_uid, out_pk = [], []
    low, high = a - n, a  # bytes left of the anchor: from its last window to its first
    for left in range(int(low.min(initial=0)), int(high.max(initial=-1)) + 1):
        cls = np.empty(len(h), np.int64)
        cls[order] = np.cumsum(agree < w - left)
        live = np.flatnonzero((low <= left) & (left <= high))  # in order of (h, ord, uid, place)
        if len(live) < 2:
            continue
        p = anchor[live] - left
        key = K.mix(cls[live].astype(np.uint64)) ^ s.hash.of(p, anchor[live])
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        head = first[inverse]
        late = np.flatnonzero(head != np.arange(len(live)))
        for lo in range(0, len(late), 20_000):
            some = late[lo : lo + 20_000]
            span = np.arange(w)
            same = (data[p[some][:, None] + span] == data[p[head[some]][:, None] + span]).all(1)
            if not same.all():
                of, seen = np.flatnonzero(np.isin(key, key[some[~same]])), set()
                bodies = [data[x : x + w].tobytes() for x in p[of]]
                again = np.array([i for i, body in zip(of, bodies, strict=True) if body in seen or seen.add(body)], np.int64)
                some = np.union1d(some[~np.isin(some, of)], again)
            out_uid.append(uid[live[some]])
            out_pk.append((pk[live[some]] >> 24) + (p[some] - at[live[some]]) << 24)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_uid]), np.concatenate([none, *out_pk])


def suffix_dedup(docs: DataFrame, window: int = 100, gram: int = 32, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept
    (null unless ``with_text``).

    A text is its UTF-8 bytes (null: none). Every byte is removed that lies in a
    string of ``window`` bytes which also starts earlier: in a document of smaller id (null
    ids last), or before in the same one. Strings are judged on the input and never
    cross documents. ``kept`` is what remains, as bytes, since cuts may part a character. Of rows
    with equal texts the one of the smallest id is the first; rows that share id and text count as one
    document. Of different texts with one id it is open which is the earlier. Texts of under
    ``window`` bytes stay. Empty tables give no rows, other columns are ignored."""

    def symbols(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, None]:
        return K.BYTE_CODE[data[at[0] : at[-1]]], at - at[0], None

    texts, rows = unique_texts(docs, id_col, text_col)
    spans, steps = repeated(texts, symbols, lambda t: earlier(t, window), gram, window, True, MANY, bits)
    schema = pa.schema([("uid", pa.int64()), ("ord", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = columns(batch)
            data, at = K.buffers(c["text"])
            done = []
            for i, pks in enumerate(c["spans"]):
                text = data[at[i] : at[i + 1]]
                removed = runs = 0
                kept = text
                if pks.is_valid:
                    gone = K.covered(len(text), *spots(pks.values.to_numpy(), None, window))
                    removed, runs = int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    kept = text[~gone]
                kept = kept.tobytes()
                done.append((len(text), removed, runs, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            if done:
                yield from batched(schema, [c["uid"], c["ord"], *(list(x) for x in zip(*done, strict=True))], 5_000)

    cuts = texts.select("uid", "ord", F.col("text").cast("binary").alias("text")).join(spans, "uid", "left")
    cuts = cuts.mapInArrow(remove, "uid long, ord long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    out = rows.join(cuts, "uid")
    later = (F.coalesce("doc_id", F.lit(LAST)) != F.col("ord")) & (F.col("n_bytes") >= window)  # an equal text comes before
    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = out.select(
        "doc_id",
        "n_bytes",
        F.when(later, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(later, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(later, none).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(later & F.lit(with_text), F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )
    return finished(out, texts, *steps)
