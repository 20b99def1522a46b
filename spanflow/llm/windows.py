"""Windows of symbols that occur more than once in a corpus, found by content-chosen anchors.

Substring operators differ in their symbols (bytes or words) and in how they judge
the passages that share an anchor; the way of the rows is the same and is here.

1. Equal texts become one row each, in a table bucketed by a hash of the text.
2. Each window has an anchor that its content alone chooses (:func:`kernels.anchors`), so equal
   windows share it. Runs of windows with one anchor are keyed by the anchor's
   hash; per run, a hash of all it covers, its text and its place go along.
   Runs whose hashes are equal in a task are settled there, and one of them is passed on.
3. Anchors that occur once are dropped. Runs with equal hashes are settled: each names a partner.
   What remains shares an anchor but not all of its content.
4. For these, content is cut out of the texts and judged by the operator. Where an anchor
   has more of them than the operator takes at once, their windows are instead brought together one by one, by a hash, and name a partner too.
5. Nothing is removed on a hash alone: the stretches that a text is said to share with a partner are cut
   out, brought to the partner's text and compared with it. Anchors of stretches that differ are
   done again with the windows' whole content as key.
6. What is to go is gathered by text, and the texts are cut."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanflow.llm import kernels as K
from spanflow.llm.common import batched, columns, dropped, ints, partitions, written

#: Rows of runs. pk: bits 61-62 what the row says, bit 60 whether its anchor is hot, 24-59 the byte of the text at which the first window
#: starts, 12-23 the number of windows less one, 0-11 the anchor's place. Rows to compare have the anchor, the hash of the content, text and
#: its order; settled ones have text and start of the partner in place of hash and order.
RUN = pa.schema([(k, pa.int64()) for k in ("h", "c", "uid", "ord", "pk")])
RUN_DDL = "h long, c long, uid long, ord long, pk long"
KIND, HOT = 61, 1 << 60
#: What a row says: to be compared; to be compared and already known to occur twice; settled, all windows are to go; to be compared window by window.
ASK, TWICE, GONE, SPREAD = 0, 1, 2, 3
#: One text of so many is looked at for hot anchors; those in so large a share of texts, and in so many at least, are not brought to one task.
SAMPLE, SHARE, LEAST = 64, 1e-4, 50_000
#: Longest stretch that is compared at once, in bytes.
STRETCH = 1 << 14
#: Rows with content that a task holds before it passes them on.
HELD = 20_000
#: Rows of runs, and passages, that a task takes at once, and what belongs to the last one's anchor.
RUNS, PASSAGES = 500_000, 4000
LAST = 2**63 - 1


def unique_texts(docs: DataFrame, id_col: str, text_col: str, body: Callable[[Column], Column] = lambda text: text) -> tuple[DataFrame, DataFrame]:
    """A table (uid, text, ord, copies) of the different texts, as ``body`` makes them, bucketed by uid: later
    joins by uid read it without a shuffle; and doc_id with uid of all rows. ord is the smallest id (null ids last).

    Texts are the same when two 64-bit hashes are. Where the first alone is shared (some of 10^10 texts), uid is made of both."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("u1"), F.xxhash64(F.lit(1), text).alias("u2"), body(text).alias("text"))
    shared: list[int] = []
    while True:
        keyed = rows.withColumn("uid", F.when(F.col("u1").isin(shared), F.xxhash64("u1", "u2")).otherwise(F.col("u1")) if shared else F.col("u1"))
        one = keyed.groupBy("uid").agg(F.first("text").alias("text"), F.min(F.coalesce("doc_id", F.lit(LAST))).alias("ord"), F.count(F.lit(1)).alias("copies"), F.min("u2").alias("lo"), F.max("u2").alias("hi"))
        name = f"spanflow_texts_{uuid.uuid4().hex}"
        one.write.format("parquet").option("compression", "zstd").bucketBy(partitions(spark), "uid").saveAsTable(name)
        more = [r["uid"] for r in spark.table(name).where("lo <> hi").select("uid").collect()]
        if not more:
            return spark.table(name).select("uid", "text", "ord", "copies"), keyed.select("doc_id", "uid")
        if shared:
            raise RuntimeError("two texts agree in 128 bits of hash")
        spark.sql(f"DROP TABLE {name}")
        shared = more


def finished(out: DataFrame, texts: DataFrame, *steps: DataFrame) -> DataFrame:
    """The result as a table of its own, after which the copy of the texts and the steps are deleted."""
    out = written(out, "cut")
    for path in {f.rpartition("/")[0] for f in texts.inputFiles()}:
        texts.sparkSession.sql(f"DROP TABLE {path.rpartition('/')[2]}")
    dropped(*steps)
    return out


def first_of(*keys: np.ndarray) -> np.ndarray:
    """True where sorted rows differ from the row before."""
    out = np.ones(len(keys[0]), bool)
    if len(out) > 1:
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def settle(h, c, uid, ord_, pk, kind, earliest: bool, drop_single: bool) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Merges runs of one anchor and hash: (h, c, uid, ord, pk, kind) to ask with, one of each, the first in the order
    (ord, uid, place); and (uid, pk, partner's uid and start) of those to go. With ``earliest`` these are all others, and the first is
    their partner; else all, as each occurs twice. ``drop_single``: anchors that only one run has are left out."""
    order = np.lexsort((pk, uid, ord_, c, h))
    h, c, uid, ord_, pk, kind = (x[order] for x in (h, c, uid, ord_, pk, kind))
    head = first_of(h, c)
    start = np.flatnonzero(head)
    size = np.diff(np.append(start, len(h)))
    twice = (np.maximum.reduceat(kind, start) == TWICE) | (size > 1) if len(start) else np.zeros(0, bool)
    partner = np.repeat(start, size) + (head & ~np.full(len(h), earliest))
    gone = np.flatnonzero(~head if earliest else np.repeat(size > 1, size))  # a head known before to occur twice is gone already
    ask = head
    if drop_single and len(start):
        different = np.diff(np.append(np.flatnonzero(first_of(h[start])), len(start)))
        ask = head.copy()
        ask[start[np.repeat(different == 1, different)]] = False
    known = np.zeros(len(h), np.int64)
    known[start] = np.where(twice & (not earliest), TWICE, ASK)
    a, p = np.flatnonzero(ask), partner[gone]
    return (h[a], c[a], uid[a], ord_[a], pk[a], known[a]), (uid[gone], pk[gone], uid[p], starts(pk[p]))


def grouped(batches: Iterator[pa.RecordBatch], key: Callable[[pa.RecordBatch], tuple[np.ndarray, ...]], rows: int) -> Iterator[pa.Table]:
    """Rows that come sorted by ``key``, in tables of whole groups: as few as make up ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    n, last = 0, None
    for batch in batches:
        if not len(batch):
            continue
        now = key(batch)
        head = first_of(*now)
        head[0] = last is not None and any(k[0] != x for k, x in zip(now, last, strict=True))
        last, done = tuple(k[-1] for k in now), 0
        heads = np.flatnonzero(head)
        while (at := np.searchsorted(heads, done + rows - n)) < len(heads):
            cut = int(heads[at])
            yield pa.Table.from_batches([*held, batch.slice(done, cut - done)]).combine_chunks()
            held, n, done = [], 0, cut
        held.append(batch.slice(done))
        n += len(batch) - done
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def starts(pk: np.ndarray) -> np.ndarray:
    return pk >> 24 & 0xFFFFFFFFF


def spots(pk: np.ndarray, places: np.ndarray | None, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Half-open spans of symbols that the windows of packed runs cover. ``places`` are the bytes at which a text's symbols start, and its
    length; None where each byte is a symbol."""
    first = starts(pk) if places is None else np.searchsorted(places, starts(pk))
    return first, first + (pk >> 12 & 4095) + w


def repeated(texts: DataFrame, symbols: Callable, judge: Callable, k: int, w: int, earliest: bool, many: int, bits: int) -> tuple[DataFrame, list[DataFrame]]:
    """(uid, spans): the windows to remove from each of ``texts``, as an array of pk; and tables that it reads.

    symbols(data, at) gives (codes, first symbol of each document, and the bytes of its document at which each starts or None where bytes are
    symbols); judge(batch of passages) gives
    (uid, pk) of windows to remove, for passages sorted by anchor, of which one has ``many`` at most. Hashes of
    content have ``bits``: fewer than 64 make them collide in tests."""
    if w > 4096:
        raise ValueError("windows of more than 4096 symbols")
    spark = texts.sparkSession
    body = texts.select("uid", "ord", F.col("text").cast("binary").alias("text"))

    def anchored(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        """(h, c, row, pk) of a batch's runs."""
        data, at = K.buffers(columns(batch)["text"])
        for lo, hi in K.pieces(at):
            codes, first, places = symbols(data, at[lo : hi + 1])
            h, c, doc, s, n, a = K.anchors(codes, first, k, w)
            s = s if places is None else places[first[doc] + s]
            yield h.astype(np.int64), (c >> K.U(64 - bits)).astype(np.int64), lo + doc, s << 24 | n << 12 | a

    def alone(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Bytes, codes and places of one text."""
        codes, _, places = symbols(data, at)
        return data[at[0] : at[1]], codes, None if places is None else np.append(places, at[1] - at[0])

    def ends(spans: np.ndarray, places: np.ndarray | None) -> np.ndarray:
        """Bytes at which the windows of packed runs end."""
        last = spots(spans, places, w)[1]
        return last if places is None else places[last]

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, *_ in anchored(batch):
                yield from batched(pa.schema([("h", pa.int64())]), [h], 200_000)

    some = body.where(F.pmod("uid", F.lit(SAMPLE)) == 0)
    most = max(SHARE * texts.count(), LEAST) / SAMPLE
    hot = some.mapInArrow(sampled, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("h").collect()
    hot = spark.sparkContext.broadcast(np.sort(np.array([r["h"] for r in hot], np.int64)))  # texts times their anchors over SHARE at most

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = columns(batch)
            uid, ord_ = ints(col["uid"]), ints(col["ord"])
            found = list(anchored(batch))
            if not found:
                continue
            h, c, row, pk = (np.concatenate(x) for x in zip(*found, strict=True))
            ask, gone = settle(h, c, uid[row], ord_[row], pk, np.zeros(len(h), np.int64), earliest, False)
            pk = ask[4] | ask[5] << KIND | np.where(np.isin(ask[0], hot.value), HOT, 0)
            yield from batched(RUN, [*ask[:4], pk], 200_000)
            anywhere = K.mix(gone[1].astype(np.uint64) ^ gone[0].astype(np.uint64)).astype(np.int64)  # these need no place by anchor
            yield from batched(RUN, [anywhere, gone[2], gone[0], gone[3], gone[1] | GONE << KIND], 200_000)

    def alike(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Rows to be compared together: those of an anchor, or, if it is hot, of an anchor and a hash."""
        h, c, pk = (ints(columns(batch)[x]) for x in ("h", "c", "pk"))
        return h, np.where((pk & HOT) > 0, c, 0)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, alike, RUNS):
            rows = [ints(table.column(j).combine_chunks()) for j in range(5)]
            done = rows[4] >> KIND == GONE
            yield from batched(RUN, [np.zeros(int(done.sum()), np.int64), *(x[done] for x in rows[1:])], 200_000)
            h, c, uid, ord_, pk = (x[~done] for x in rows)
            far = (pk & HOT) > 0
            for some, single in ((~far, True), (far, False)):
                ask, gone = settle(h[some], c[some], uid[some], ord_[some], pk[some] & (HOT - 1), pk[some] >> KIND, earliest, single)
                zero = np.zeros(len(gone[0]), np.int64)
                yield from batched(RUN, [zero, gone[2], gone[0], gone[3], gone[1] | GONE << KIND], 200_000)
                kind = ask[5]
                if single and len(kind):
                    _, at, count = np.unique(ask[0], return_inverse=True, return_counts=True)
                    kind = np.where(count[at] > many, SPREAD, kind)
                else:
                    kind = np.full(len(kind), SPREAD)
                zero = np.zeros(len(kind), np.int64)  # hashes and order have done their work
                yield from batched(RUN, [ask[0], zero, ask[2], zero, ask[4] | kind << KIND], 200_000)

    key = F.when(F.col("pk").bitwiseAND(F.lit(HOT)) > 0, F.xxhash64("h", "c")).otherwise(F.col("h"))
    runs = body.mapInArrow(find, RUN_DDL).repartition(partitions(spark), key).sortWithinPartitions("h", "c")
    runs = written(runs.mapInArrow(compare, RUN_DDL), "runs").withColumn("kind", F.shiftright("pk", KIND)).withColumn("pk", F.col("pk").bitwiseAND(F.lit(HOT - 1)))

    passage = pa.schema([("h", pa.int64()), ("uid", pa.int64()), ("ord", pa.int64()), ("pk", pa.int64()), ("kind", pa.int32()), ("passage", pa.binary())])
    passage_ddl = "h long, uid long, ord long, pk long, kind int, passage binary"

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = columns(batch)
            data, at = K.buffers(col["text"])
            uid, ord_ = ints(col["uid"]), ints(col["ord"])
            rows: list[tuple] = []
            for i, asks in enumerate(col["asked"].to_pylist()):
                text, _, places = alone(data, at[i : i + 2])
                stop = ends(np.array([a["pk"] for a in asks], np.int64), places)
                rows += [(a["h"], uid[i], ord_[i], a["pk"], a["kind"], text[a["pk"] >> 24 : e].tobytes()) for a, e in zip(asks, stop.tolist(), strict=True)]
                if len(rows) > HELD:
                    yield from batched(passage, [list(x) for x in zip(*rows, strict=True)], 50_000)
                    rows = []
            if rows:
                yield from batched(passage, [list(x) for x in zip(*rows, strict=True)], 50_000)

    def asking(which) -> DataFrame:
        asks = runs.where(which).groupBy("uid").agg(F.collect_list(F.struct("h", "pk", "kind")).alias("asked"))
        return body.join(asks, "uid")

    passages = asking(F.col("kind").isin(ASK, TWICE)).mapInArrow(fetch, passage_ddl)

    window = pa.schema([(c, pa.int64()) for c in ("key", "ord", "uid", "start")])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = columns(batch)
            data, at = K.buffers(col["text"])
            uid, ord_, asked = ints(col["uid"]), ints(col["ord"]), col["asked"]
            for i in range(len(uid)):
                _, codes, places = alone(data, at[i : i + 2])
                pk = np.array([a["pk"] for a in asked[i].as_py()], np.int64)
                start = np.concatenate([np.arange(lo, hi - w + 1) for lo, hi in zip(*spots(pk, places, w), strict=True)])
                keys = (K.mix(K.Prefix(codes).of(start, start + w)) >> K.U(64 - bits)).astype(np.int64)
                start = start if places is None else places[start]
                yield from batched(window, [keys, np.full(len(keys), ord_[i]), np.full(len(keys), uid[i]), start], 200_000)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, lambda batch: (ints(columns(batch)["h"]),), PASSAGES):
            yield from batched(pa.schema([("uid", pa.int64()), ("pk", pa.int64())]), list(judge(table)), 200_000)

    judged = passages.repartition(partitions(spark), "h").sortWithinPartitions("h", "ord", "uid", "pk").mapInArrow(decide, "uid long, pk long")
    gone = runs.where(F.col("kind") == GONE).select("uid", "pk", F.col("c").alias("partner"), F.col("ord").alias("at"))
    steps = [runs]

    def paired(each: DataFrame, by: str) -> DataFrame:
        """Of windows (uid, ord, start) with one key those to go, each with a partner."""
        place = F.struct("ord", "uid", "start")
        two = each.groupBy(by).agg(F.min(place).alias("one"), F.max(place).alias("two")).where("one <> two")
        out = each.join(two, by).withColumn("with", F.when(place == F.col("one"), F.col("two")).otherwise(F.col("one")))
        out = out.where(place != F.col("one")) if earliest else out
        return out.select("uid", F.shiftleft("start", 24).alias("pk"), F.col("with.uid").alias("partner"), F.col("with.start").alias("at"))

    if not runs.where(F.col("kind") == SPREAD).isEmpty():
        each = written(asking(F.col("kind") == SPREAD).mapInArrow(spread, "key long, ord long, uid long, start long"), "windows")
        steps.append(each)
        gone = gone.union(paired(each, "key"))

    # Hashes have named partners: what a text is said to share with one is compared with it.
    claim = pa.schema([*((k, pa.int64()) for k in ("of", "lo", "n", "uid", "at")), ("content", pa.binary())])

    def claims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = columns(batch)
            data, at = K.buffers(col["text"])
            uid, rows = ints(col["uid"]), []
            for i in range(len(uid)):
                said = col["gone"][i].values
                pk, partner, start = (ints(said.field(f)) for f in ("pk", "partner", "at"))
                text, _, places = alone(data, at[i : i + 2])
                lo, hi = starts(pk), ends(pk, places)
                ahead = lo - start
                order = np.lexsort((lo, ahead, partner))
                lo, hi, ahead, partner = lo[order], hi[order], ahead[order], partner[order]
                other = first_of(partner, ahead)
                group = np.cumsum(other) << 40
                reach = np.maximum.accumulate(hi + group) - group
                first = np.flatnonzero(other | np.append(True, lo[1:] > reach[:-1]))
                for a, b, p, d in zip(lo[first].tolist(), reach[np.append(first[1:], len(lo)) - 1].tolist(), partner[first].tolist(), ahead[first].tolist(), strict=True):
                    rows += [(uid[i], s, min(STRETCH, b - s), p, s - d, text[s : min(s + STRETCH, b)].tobytes()) for s in range(a, b, STRETCH)]
                if len(rows) > HELD:
                    yield from batched(claim, [list(x) for x in zip(*rows, strict=True)], 5_000)
                    rows = []
            if rows:
                yield from batched(claim, [list(x) for x in zip(*rows, strict=True)], 5_000)

    lists = gone.groupBy("uid").agg(F.collect_list(F.struct("pk", "partner", "at")).alias("gone"))  # a text's own runs
    said = body.join(lists, "uid").select("uid", "text", "gone").mapInArrow(claims, "of long, lo long, n long, uid long, at long, content binary")
    wrong = written(said.join(texts.select("uid", "text"), "uid").where(F.substring(F.col("text").cast("binary"), (F.col("at") + 1).cast("int"), F.col("n").cast("int")) != F.col("content")).select("of", "lo", "n", F.col("uid").alias("with"), (F.col("lo") - F.col("at")).alias("ahead")), "wrong")
    if not wrong.isEmpty():
        start = F.shiftright("pk", 24)
        inside = (F.col("uid") == F.col("of")) & (F.col("partner") == F.col("with")) & (start - F.col("at") == F.col("ahead"))
        again = written(gone.join(wrong, inside, "left_semi").groupBy("uid").agg(F.collect_list("pk").alias("asked")), "again")  # of the pair and distance, wherever they are
        gone = gone.join(wrong, inside, "left_anti")
        steps.append(again)

        def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, at = K.buffers(columns(batch)["text"])
                for i, asked in enumerate(columns(batch)["asked"]):
                    _, codes, places = alone(data, at[i : i + 2])
                    for lo, hi in zip(*spots(ints(asked.values), places, w), strict=True):
                        h, *_ = K.anchors(codes[lo:hi], np.array([0, hi - lo]), k, w)
                        yield from batched(pa.schema([("h", pa.int64())]), [h.astype(np.int64)])

        shared = body.join(again, "uid").mapInArrow(names, "h long").distinct().collect()  # anchors under which hashes have collided
        shared = spark.sparkContext.broadcast(np.array([r["h"] for r in shared], np.int64))

        def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("key", pa.binary()), *((c, pa.int64()) for c in ("ord", "uid", "start"))])
            for batch in batches:
                col = columns(batch)
                data, at = K.buffers(col["text"])
                uid, ord_ = ints(col["uid"]), ints(col["ord"])
                for h, _, row, pk in anchored(batch):
                    keep = np.isin(h, shared.value)
                    for i, run in zip(row[keep], pk[keep], strict=True):
                        text, _, places = alone(data, at[i : i + 2])
                        lo, hi = (int(x[0]) for x in spots(np.array([run]), places, w))
                        each = np.arange(lo, hi - w + 1)
                        first, last = (each, each + w) if places is None else (places[each], places[each + w])
                        yield from batched(schema, [[text[x:y].tobytes() for x, y in zip(first, last, strict=True)], [ord_[i]] * len(each), [uid[i]] * len(each), first])

        gone = gone.union(paired(body.mapInArrow(contents, "key binary, ord long, uid long, start long"), "key"))
    spans = written(gone.select("uid", "pk").union(judged).groupBy("uid").agg(F.collect_list("pk").alias("spans")), "spans")
    return spans, [*steps, wrong, spans]
