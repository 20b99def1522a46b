"""Ranked lexical search over classes of documents with equal bags of query terms."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanflow.llm.common import batched, columns, written

#: Bytes of item texts that are searched for in one pass over the documents, and scores that a task holds at once.
ITEM_BYTES, CELLS = 1 << 25, 1 << 21
#: Parts that the members of one class, and the hits of one item, are first cut down in.
SALT = 64
#: Stands for a null doc_id, which comes last.
NO_ID = 2**63 - 1
_TERMS = bytes(b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII; A-Z in lower case."""
    return text.translate(_TERMS).split()


def bags(docs: DataFrame, vocabulary: Broadcast, id_col: str, text_col: str) -> DataFrame:
    """One row per document: doc_id, n (terms with repeats) and bag, its vocabulary terms and how often each occurs, as pairs of 32 bits by ascending term."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("bag", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value.get
        for batch in batches:
            c, n, packed = columns(batch), [], []
            for text in c["text"]:
                words = terms(text.as_py())
                n.append(len(words))
                tf = Counter(map(known, words))
                tf.pop(None, None)
                packed.append(np.array(sorted(tf.items()), np.int32).tobytes())
            yield from batched(schema, [c["doc_id"], n, packed])

    text = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return text.mapInArrow(count, "doc_id long, n long, bag binary")


def document_frequencies(known: DataFrame, size: int) -> np.ndarray:
    """How many bags hold each term: summed in every task, then over tasks."""
    schema = pa.schema([("term", pa.int32()), ("df", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            data = b"".join(batch.column(0).to_pylist())
            total += np.bincount(np.frombuffer(data, np.int32)[::2], minlength=size)
        some = np.flatnonzero(total)
        yield from batched(schema, [some.astype(np.int32), total[some]])

    df = np.zeros(size, np.int64)
    for term, n in known.select("bag").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row per term of the vocabulary, which is bounded
        df[term] = n
    return df


def classes(known: DataFrame, docs_n: int, terms_n: int, top: int) -> DataFrame:
    """Documents of equal bag and equal m as one row: h, m, bag and members, the ``top`` smallest doc_ids in ascending order.

    No more members of a class can be among an item's ``top``, as all have one score. ``h`` is a hash of both; rows
    come together by it and are one class only where m and bag are identical byte for byte. Members
    are cut down in every task, then over SALT parts of a class, and last over the class, so no task reads a large one."""
    m = F.lit(50) + F.expr(f"(50L * n * {docs_n}L) div {max(1, terms_n)}L")
    some = known.where("length(bag) > 0").withColumn("m", m)
    some = some.select("doc_id", F.xxhash64("m", "bag").alias("h"), "m", "bag", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).alias("part"))
    for keys in (["h", "m", "bag", "part"], ["h", "m", "bag"]):
        some = some.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id"))).where(F.col("place") <= top)
    return some.groupBy("h", "m", "bag").agg(F.sort_array(F.collect_list("doc_id")).alias("members"))  # at most ``top`` of each


class Best:
    """The best hits of every item so far, equal scores by ascending doc_id."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.ones(items, np.int64)
        self.item, self.doc, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, scores: np.ndarray, members: list) -> None:
        """Scores of some classes (rows) for all items, and each class's ascending doc_ids."""
        if len(scores) > self.top:
            np.maximum(self.least, np.partition(scores, -self.top, 0)[-self.top], out=self.least)
        row, item = np.nonzero(scores >= self.least)
        many = np.array([len(x) for x in members], np.int64)
        start = np.append(0, np.cumsum(many))[:-1]
        flat = np.concatenate([np.asarray(x, np.int64) for x in members]) if len(members) else np.zeros(0, np.int64)
        n = many[row]
        at = np.repeat(start[row] - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())
        item_, doc, score = np.append(self.item, np.repeat(item, n)), np.append(self.doc, flat[at]), np.append(self.score, np.repeat(scores[row, item], n))
        order = np.lexsort((doc, -score, item_))
        item_, doc, score = item_[order], doc[order], score[order]
        place = np.arange(len(item_)) - np.searchsorted(item_, item_)
        keep = place < self.top
        last = place == self.top - 1
        self.least[item_[last]] = np.maximum(self.least[item_[last]], score[last])
        self.item, self.doc, self.score = item_[keep], doc[keep], score[keep]


def search(docs: DataFrame, items: DataFrame, top: int = 50, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The ``top`` documents of highest score for each item: item_id, rank, doc_id, score; fewer where fewer score above 0.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z
    are lower-cased. With N documents of at least one term, L terms in all and n in a document, df
    documents that hold a term and tf occurrences of it, a document's m is 50 + (50 n N) div L, a term weighs
    w = floor(1000 ln((2 N + 2) / (2 df + 1))), and the score is the sum of w ((10^9 tf) div (1000 tf + 20 m)) over
    the item's terms, once each, in 64 bits. Equal scores go by ascending doc_id.

    Null and empty texts have no terms: such documents count nowhere and such items have no rows. Rows of one
    item_id (null is one too) are one item with the terms of all. Repeated rows of documents are documents of their own
    and can both be hits. A null doc_id is last among equal scores (2^63 - 1 is read as null). Empty tables give no rows, other columns are not read.

    Every document becomes its bag of the items' terms in one pass, without a shuffle. Documents of one bag and one m are a class
    (:func:`classes`) and are scored once; hits are cut down in every task, over SALT parts of an item and over the
    item. Items are searched for in blocks of about ``item_bytes`` of text, so what is broadcast and what the driver
    gets has a bound that no table changes; each further block is one more pass."""
    spark = docs.sparkSession
    texts = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).cast("binary").alias("text"))
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / item_bytes))
    found = [_search(docs, texts.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), top, id_col, text_col) for b in range(blocks)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _search(docs: DataFrame, texts: DataFrame, top: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    wanted: dict = {}
    for r in texts.toLocalIterator():  # a block of items
        wanted.setdefault(r["item_id"], set()).update(terms(bytes(r["text"])))
    names = list(wanted)
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*wanted.values())))}
    known = written(bags(docs, spark.sparkContext.broadcast(vocabulary), id_col, text_col), "bags")
    docs_n, terms_n = known.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_frequencies(known, len(vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * docs_n + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    pairs = np.array(sorted((vocabulary[t], i) for i, x in enumerate(names) for t in wanted[x]), np.int64).reshape(-1, 2)
    first = np.searchsorted(pairs[:, 0], np.arange(len(vocabulary) + 1))
    shared = spark.sparkContext.broadcast((weight, first, pairs[:, 1].copy(), len(names)))
    schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, first, posted, n = shared.value
        best = Best(n, top)
        step = max(1, min(4096, CELLS // max(1, n)))
        for batch in batches:
            c = columns(batch)
            for lo in range(0, batch.num_rows, step):
                some = c["bag"].slice(lo, step).to_pylist()
                m = c["m"].slice(lo, step).to_numpy(zero_copy_only=False)
                best.add(scores(some, m, w, first, posted, n), c["members"].slice(lo, step).to_pylist())
        yield from batched(schema, [best.item.astype(np.int32), best.doc, best.score])

    hits = classes(known, docs_n, terms_n, top).select("m", "bag", "members").mapInArrow(score, "item int, doc_id long, score long")
    hits = hits.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)))
    order = [F.col("score").desc(), F.col("doc_id")]
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= top)
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    ids = spark.createDataFrame(list(enumerate(names)), f"item int, item_id {texts.schema['item_id'].dataType.simpleString()}")
    return hits.join(F.broadcast(ids), "item").select("item_id", "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")  # a block of items


def scores(bags: list[bytes], m: np.ndarray, weight: np.ndarray, first: np.ndarray, posted: np.ndarray, items: int) -> np.ndarray:
    """Scores of classes (rows) for all items, along the postings of the terms that a class holds."""
    many = np.array([len(b) // 8 for b in bags], np.int64)
    pairs = np.frombuffer(b"".join(bags), np.int32).reshape(-1, 2).astype(np.int64)
    row = np.repeat(np.arange(len(bags)), many)
    out = np.zeros(len(bags) * items, np.int64)
    gain = weight[pairs[:, 0]] * ((10**9 * pairs[:, 1]) // (1000 * pairs[:, 1] + 20 * m[row]))
    n = first[pairs[:, 0] + 1] - first[pairs[:, 0]]
    ends = np.cumsum(n)
    lo = 0
    while lo < len(n):  # postings of a bounded number at a time
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CELLS, "right")))
        k = n[lo:hi]
        at = np.repeat(first[pairs[lo:hi, 0]] - np.append(0, np.cumsum(k))[:-1], k) + np.arange(k.sum())
        cell = np.repeat(row[lo:hi], k) * items + posted[at]
        np.add.at(out, cell, np.repeat(gain[lo:hi], k))
        lo = hi
    return out.reshape(len(bags), items)
