"""Token counts: a linear longest-match automaton over the vocabulary trie."""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanflow.llm.common import batched, columns

#: Different words whose counts a task remembers, and the longest of them.
CACHE, LONG = 500_000, 256
_WORD_START = b" "


def vocabulary(rank_file: str) -> list[bytes]:
    """The byte strings of a public rank file (base64 and rank a line)."""
    with open(rank_file, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """Greedy longest-match word pieces, counted in one pass over a word's bytes.

    Pieces at a word's start are the tokens that begin with a space, without it, and
    every single byte; pieces inside it are the tokens without a space. Each trie
    node holds its children, a failure link (the node inside a word that goes on
    after the greedy pieces of its string are taken off) and how many pieces that
    takes off; so no piece is ever built and no byte is read twice (Song et al. 2021)."""

    def __init__(self, tokens: list[bytes]):
        self.children: list[dict[int, int]] = [{}, {}]  # 0: at a word's start, 1: inside
        ends = {0: False, 1: False}
        single = [bytes([b]) for b in range(256)]
        for root, words in ((0, [t[1:] for t in tokens if t.startswith(_WORD_START)] + single), (1, [t for t in tokens if _WORD_START not in t] + single)):
            for w in words:
                node = root
                for b in w:
                    nxt = self.children[node].get(b)
                    if nxt is None:
                        nxt = self.children[node][b] = len(self.children)
                        self.children.append({})
                        ends[nxt] = False
                    node = nxt
                if w:
                    ends[node] = True
        self.link, self.pops = [-1] * len(self.children), [0] * len(self.children)
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for b, v in self.children[u].items():
                if ends[v]:
                    self.link[v], self.pops[v] = 1, 1
                else:
                    z, n = self.link[u], self.pops[u]
                    while z >= 0 and b not in self.children[z]:
                        n += self.pops[z]
                        z = self.link[z]
                    self.link[v], self.pops[v] = (self.children[z][b], n) if z >= 0 else (-1, 0)
                queue.append(v)

    def count(self, word: bytes) -> int:
        """Number of pieces; 1 if the vocabulary cannot spell the word."""
        children, link, pops, node, n = self.children, self.link, self.pops, 0, 0
        for b in word:
            while (nxt := children[node].get(b)) is None:
                if link[node] < 0:
                    return 1
                n += pops[node]
                node = link[node]
            node = nxt
        while node > 1:
            if link[node] < 0:
                return 1
            n += pops[node]
            node = link[node]
        return n


class _Counts(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(word) > LONG:
            return self.automaton.count(word)
        if len(self) >= CACHE:
            self.clear()
        n = self[word] = self.automaton.count(word)
        return n


def token_counts(docs: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_tokens.

    Words are runs of bytes other than ASCII white space; a text's tokens are the
    greedy longest-match pieces of its words (:class:`Automaton`). Null and empty texts
    have none. Rows are independent: no shuffle, repeated rows and ids stay as they are,
    an empty table gives no rows, other columns are not read. The automaton is
    built once and broadcast; its size depends on the vocabulary alone."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(vocabulary(rank_file)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Counts(shared.value).__getitem__
        for batch in batches:
            c = columns(batch)
            words, tokens = [], []
            for text in c["text"]:
                parts = text.as_py().split()
                words.append(len(parts))
                tokens.append(sum(map(known, parts)))
            yield from batched(schema, [c["doc_id"], words, tokens])

    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return text.mapInArrow(count, "doc_id long, n_words long, n_tokens long")
