"""Substring dedup: suffix automata of reference shards give matching statistics."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Hashable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanflow.llm import kernels as K
from spanflow.llm.common import ASCII_SPACE, batched, columns
from spanflow.llm.windows import TWICE, finished, first_of, repeated, spots, unique_texts

#: Passages of one anchor that go into one automaton at most: some 50 kB each.
MANY = 1000


class SuffixAutomaton:
    """All substrings of a set of sequences, with how often each occurs."""

    def __init__(self) -> None:
        self.next: list[dict[Hashable, int]] = [{}]
        self.link, self.len, self.count = [-1], [0], [0]

    def _state(self, n: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.len.append(n)
        self.count.append(0)
        return len(self.len) - 1

    def add(self, sequence: list[Hashable], weight: int = 1) -> None:
        """Adds a sequence that counts ``weight`` times."""
        last, nxt, link, length = 0, self.next, self.link, self.len
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None:  # another sequence begins alike
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._split(last, c, q)
            else:
                new = self._state(length[last] + 1)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
                last = new
            self.count[last] += weight

    def _split(self, p: int, c: Hashable, q: int) -> int:
        clone = self._state(self.len[p] + 1)
        self.next[clone] = dict(self.next[q])
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def total(self) -> None:
        """Sums occurrences over the suffix links, longest first."""
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.link[v] >= 0:
                self.count[self.link[v]] += self.count[v]

    def statistics(self, sequence: list[Hashable], least: int = 2) -> list[int]:
        """At each place, the length of the longest string ending there that occurs ``least`` times."""
        nxt, link, length, count, v, n, out = self.next, self.link, self.len, self.count, 0, 0, []
        for c in sequence:
            while v and ((q := nxt[v].get(c)) is None or count[q] < least):
                v = link[v]
                n = length[v]
            q = nxt[v].get(c)
            if q is not None and count[q] >= least:
                v, n = q, n + 1
            out.append(n)
        return out


def matched(table: pa.Table, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(uid, pk) of windows of ``w`` words that occur in two passages, or twice in one.

    The passages of one anchor are a reference shard: they all go into one automaton, and
    then each is streamed through it."""
    h, uid, pk, kind = (table.column(c).to_numpy() for c in ("h", "uid", "pk", "kind"))
    passages = table.column("passage").to_pylist()
    start = np.append(np.flatnonzero(first_of(h)), len(h))
    out_uid: list[int] = []
    out_pk: list[int] = []
    for lo, hi in zip(start[:-1], start[1:], strict=True):
        shard = SuffixAutomaton()
        sequences = [passages[i].split() for i in range(lo, hi)]  # the words themselves, not hashes
        for i, sequence in zip(range(lo, hi), sequences, strict=True):
            shard.add(sequence, 2 if kind[i] == TWICE else 1)
        shard.total()
        for i, sequence in zip(range(lo, hi), sequences, strict=True):
            if kind[i] == TWICE:  # all its windows are gone already
                continue
            at = [0, *itertools.accumulate(len(x) + 1 for x in sequence)]
            for place, n in enumerate(shard.statistics(sequence)):
                if n >= w:
                    out_uid.append(uid[i])
                    out_pk.append(((int(pk[i]) >> 24) + at[place - w + 1]) << 24)
    return np.array(out_uid, np.int64), np.array(out_pk, np.int64)


def substring_dedup(docs: DataFrame, window: int = 35, gram: int = 20, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, kept (null unless
    ``with_text``).

    Words are runs of bytes other than ASCII white space, unchanged (null: none). Every
    word is removed that lies in ``window`` consecutive words which also start anywhere
    else, in the same document or another; windows are judged on the input. ``kept`` is the remaining
    words with one space between. Repeated rows, also of one id, are documents of their own, so
    what they have of ``window`` words goes. Empty tables give no rows, other columns are ignored."""

    def symbols(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, _, codes, first = K.words(data, at)
        return codes, first, starts - np.repeat(at[:-1] - at[0], np.diff(first))

    def body(text: Column) -> Column:
        """The words, each with a space behind it, so that a word's bytes are those up to the next."""
        words = F.trim(F.regexp_replace(text, f"[{ASCII_SPACE}]+", " "))
        return F.when(words == "", "").otherwise(F.concat(words, F.lit(" ")))

    texts, rows = unique_texts(docs, id_col, text_col, body)
    texts = texts.withColumn("ord", F.lit(0).cast("long"))
    spans, steps = repeated(texts, symbols, lambda t: matched(t, window), gram, window, False, MANY, bits)
    schema = pa.schema([("uid", pa.int64()), ("copies", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = columns(batch)
            done = []
            for text, pks, copies in zip(c["text"], c["spans"], c["copies"].to_pylist(), strict=True):
                body = text.as_py()
                words = body.split()
                n, removed = len(words), 0
                if copies > 1 and n >= window:
                    words, removed = [], n
                elif pks.is_valid:
                    places = np.array([0, *itertools.accumulate(len(x) + 1 for x in words)])
                    gone = K.covered(n, *spots(pks.values.to_numpy(), places, window))
                    removed = int(gone.sum())
                    words = [words[i] for i in np.flatnonzero(~gone)]
                kept = b" ".join(words)
                done.append((n, removed, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
            if done:
                yield from batched(schema, [c["uid"], c["copies"], *(list(x) for x in zip(*done, strict=True))], 5_000)

    cuts = texts.select("uid", "copies", F.col("text").cast("binary").alias("text")).join(spans, "uid", "left")
    cuts = cuts.mapInArrow(remove, "uid long, copies long, n_words long, n_removed long, kept_sha256 string, kept string")
    return finished(rows.join(cuts, "uid").select("doc_id", "n_words", "n_removed", "kept_sha256", "kept"), texts, *steps)
