"""Best-fit packing: a configuration linear program over the length histogram."""

from __future__ import annotations

import logging
import os
import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanflow.llm.common import batched, columns, ints, ranked, written

#: Bytes of words and ids that a task remembers, and the longest word that is.
CACHE, LONG = 1 << 28, 256
#: The linear program's groups of lengths (more where lengths differ by more than WIDTH allows) and most items of a sequence in it.
GROUPS, WIDTH, SLOTS = 64, 0.95, 16
#: Steps of the weights, coarse to fine, and how near the covering is to come to its bound.
STEPS, GAP = (0.3, 0.15, 0.08), 1.02
#: Roundings of the program that are tried: shares of its uses, of which the rest is best-fit, and items of a planned sequence that best-fit may choose.
SHARES, OPEN = (1.0, 0.95, 0.92), (0, 1, 2, 3, 4)
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


#: Below this all letters are precomposed and in place in every Unicode version, so that Python's classes are the tokenizer's.
_PLAIN = "\u0250"
#: How the tokenizer file splits text before its merges.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> str:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return "".join(chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256))


def word_encoder(tokenizer_file: str) -> Callable[[list[bytes]], list[bytes]]:
    """Texts (UTF-8) to token ids as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and no token or normalisation crosses it, so the
    ids of a text are those of its parts between ASCII white spaces, and parts seen
    before are looked up. New parts of plain letters are lowered and split here and
    only their unknown words go to the tokenizer's model; all others go to the
    tokenizer whole."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import regex
    from tokenizers import Tokenizer

    tokenizer, cache, words, held = Tokenizer.from_file(tokenizer_file), {}, {}, 0
    model, split, letters = tokenizer.model, regex.compile(_SPLIT).findall, byte_letters()

    def new(word: str) -> bytes:
        nonlocal held
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(letters)
        found = [t.id for t in model.tokenize(shown)]
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(word) <= LONG:
            words[word] = ids
            held += len(word) + len(ids) + 200
        return ids

    def learn(parts: set[bytes]) -> None:
        odd = []
        for part in parts:
            text = part.decode()
            if not text.isprintable() or not text.isascii() and max(text) >= _PLAIN or "<|" in text:
                odd.append(part)
                continue
            found = [words.get(w) or new(w) for w in split(text.lower())]
            cache[part] = found[0] if len(found) == 1 else b"".join(found)
        for at in range(0, len(odd), 20_000):
            some = odd[at : at + 20_000]
            for part, e in zip(some, tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
                cache[part] = np.array(e.ids, "<u4").tobytes()

    def encode(texts: list[bytes]) -> list[bytes]:
        nonlocal held
        parts = [t.split() for t in texts]
        if held > CACHE:
            cache.clear()
            words.clear()
            held = 0
        fresh = set().union(*parts).difference(cache)
        learn(fresh)
        out = [b"".join([cache[w] for w in p]) for p in parts]
        for w in [w for w in fresh if len(w) > LONG]:
            del cache[w]
        held += 3 * sum(map(len, fresh)) + 200 * len(fresh)
        return out

    return encode


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int, end: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = word_encoder(tokenizer_file), np.array([end], "<u4").tobytes()
        for batch in batches:
            texts, at = columns(batch)["text"], 0
            ids = batch.column(0).to_pylist()
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size < 1 << 22):
                    size += len(texts[stop].as_buffer())
                    stop += 1
                rows: list[tuple] = []
                for doc, tokens in zip(ids[at:stop], encode([t.as_py() for t in texts[at:stop]]), strict=True):
                    tokens += last
                    for k, lo in enumerate(range(0, len(tokens), 4 * capacity)):
                        part = tokens[lo : lo + 4 * capacity]
                        rows.append((doc, k, lo // 4, len(part) // 4, zlib.crc32(part)))
                yield from batched(_PIECES, [list(c) for c in zip(*rows, strict=True)])
                at = stop

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return text.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def grouped(counts: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Lengths above ``capacity / SLOTS`` in groups, long ones first: a group ends once it has its share of the items
    or its shortest is a good deal shorter than its longest. Lengths so rare that a sequence each would hold them are thus planned together."""
    lengths = np.flatnonzero(counts)[::-1]
    lengths = lengths[lengths > capacity // SLOTS]
    share, out, held = counts[lengths].sum() / GROUPS, [], 0
    for size in lengths.tolist():
        if not out or held >= share or size < WIDTH * out[-1][0]:
            out.append([])
            held = 0
        out[-1].append(size)
        held += int(counts[size])
    return [np.array(g) for g in out]


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The most valuable multiset of groups within the capacity (unbounded knapsack), as items of each group.

    ``best[c]`` reads ``best[c - size]``, so a stretch of ``size`` cells is done at once."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for g in np.flatnonzero(values > 0):
        size, value = int(sizes[g]), values[g]
        for lo in range(size, capacity + 1, size):
            hi = min(lo + size, capacity + 1)
            more = best[lo - size : hi - size] + value
            better = more > best[lo:hi]
            best[lo:hi][better] = more[better]
            pick[lo:hi][better] = g
    out, c = np.zeros(len(sizes)), int(best.argmax())
    while c > 0 and pick[c] >= 0:
        out[pick[c]] += 1
        c -= int(sizes[pick[c]])
    return out


def configurations(need: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, float]:
    """A fractional covering of ``need`` items of each of the ``sizes`` by configurations (rows: items of each size in a
    sequence), how often each is used, and a lower bound of the linear program.

    Multiplicative weights: a size's weight falls as it is covered, and a sequence is filled with the greatest weight; one
    priced before is used again while it is nearly as good. Covering goes on until every size is covered ``goal`` times, and the
    uses are divided by that. With finer steps it is done again until the uses are within GAP of the bound."""
    m, bound, pool, use = len(sizes), 0.0, np.zeros((0, len(sizes))), np.zeros(0)
    for eps in STEPS if m else ():
        pool, use, got = np.zeros((0, m)), np.zeros(0), np.zeros(m)
        goal, top = max(1.0, np.log(m) / eps**2), np.inf
        while got.min() < goal:
            weight = np.where(got < goal, np.exp(-eps * got), 0) / need
            worth = pool @ weight
            k = int(worth.argmax()) if len(pool) else -1
            if k < 0 or worth[k] < (1 - eps) * top:
                config = price(weight, sizes, capacity)
                top = float(config @ weight)
                bound = max(bound, float(weight @ need) / top)
                same = np.flatnonzero((pool == config).all(1))
                if len(same):
                    k = int(same[0])
                else:
                    k, pool, use = len(pool), np.vstack([pool, config]), np.append(use, 0.0)
            some = pool[k] > 0
            step = (need[some] / pool[k][some]).min()
            use[k] += step
            got += pool[k] * step / need
        use = use / goal
        if use.sum() <= GAP * bound:
            break
    return pool.astype(np.int64), use, bound


@dataclass
class Packed:
    """Rows (length, first rank, items, first sequence, copies a sequence, offset): the item of a rank r goes to sequence
    first + (r - first rank) // copies. ``planned`` of the ``sequences`` are from the linear program; fewer than ``least`` cannot do."""

    rows: np.ndarray
    sequences: int
    planned: int
    least: int


def plan(counts: np.ndarray, capacity: int) -> Packed:
    """Places for all items of a histogram: its configuration program is solved once and rounded in some ways (SHARES, OPEN), of
    which the fewest sequences win, then the most of them planned."""
    groups = grouped(counts, capacity)
    sizes, need = np.array([g[0] for g in groups], np.int64), np.array([int(counts[g].sum()) for g in groups], np.int64)
    pool, use, _ = configurations(need.astype(float), sizes, capacity)
    return min((rounded(counts, capacity, groups, pool, use, share, free) for share in SHARES for free in OPEN), key=lambda p: (p.sequences, -p.planned))


def rounded(counts: np.ndarray, capacity: int, groups: list[np.ndarray], pool: np.ndarray, use: np.ndarray, share: float, choose: int) -> Packed:
    """A share of the uses as whole numbers of sequences, and what remains (the rest, and items too short for the
    program, which fill the sequences' free ends) best-fit decreasing, many equal items and sequences at once. The number
    of rows depends on the capacity and not on the number of items."""
    have = np.array([int(counts[g].sum()) for g in groups], np.int64)
    left, rank, out, seq = counts.astype(np.int64).copy(), np.zeros(capacity + 1, np.int64), [], 0
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens to (first sequence, number)
    bits = 0

    def put(size: int, items: int, first: int, copies: int, offset: int) -> None:
        out.append((size, rank[size], items, first, copies, offset))
        rank[size] += items
        left[size] -= items

    def add(free: int, first: int, n: int) -> None:
        nonlocal bits
        if n and free:
            room.setdefault(free, []).append((first, n))
            bits |= 1 << free

    def fill(config: np.ndarray, n: int) -> None:
        """``n`` sequences of a configuration, without its ``choose`` shortest items: the room for these is as long as they are or longer, as lengths
        stand for a group, and best-fit finds what fits it best. Of a group's lengths the longest left are taken first; where a slot's
        length changes, a new stretch begins."""
        nonlocal seq
        slots, most = [], max(1, int(config.sum()) - choose)
        for g in np.flatnonzero(config):
            have[g] -= n * config[g]
            lengths = groups[g]
            ends = np.cumsum(left[lengths])
            for k in range(min(int(config[g]), most - len(slots))):
                at = np.searchsorted(ends, [k * n, (k + 1) * n - 1], "right")
                inside = ends[at[0] : at[1]] - k * n
                slots.append((lengths[at[0] : at[1] + 1], np.append(inside, n)))
        cuts = np.unique(np.concatenate([e for _, e in slots]))
        rows = np.stack([lengths[np.searchsorted(e, cuts - 1, "right")] for lengths, e in slots])
        for stretch, (lo, hi) in enumerate(zip(np.append(0, cuts[:-1]).tolist(), cuts.tolist(), strict=True)):
            at = 0
            for size, copies in sorted(Counter(rows[:, stretch].tolist()).items(), reverse=True):
                put(size, (hi - lo) * copies, seq + lo, copies, at)
                at += size * copies
            add(capacity - at, seq + lo, hi - lo)
        seq += n

    use, order = use * share, np.argsort(-use, kind="stable")
    for whole in (True, False):  # whole uses first, then one more of each where its items are still there
        for k in order:
            fits = int((have[pool[k] > 0] // pool[k][pool[k] > 0]).min())
            n = min(int(use[k]) if whole else int(share == 1), fits)
            if n > 0:
                fill(pool[k], n)
    planned = seq
    for size in range(capacity, 0, -1):
        while (n := int(left[size])) > 0:
            fits = bits >> size
            free = size + (fits & -fits).bit_length() - 1 if fits else capacity
            first, many = room[free].pop() if fits else (seq, -(-n // (capacity // size)))
            if fits and not room[free]:
                bits &= ~(1 << free)
            if not fits:
                seq += many
            copies = min(free // size, n)
            full = min(many, n // copies)
            put(size, full * copies, first, copies, capacity - free)
            add(free - copies * size, first, full)
            rest = int(left[size])
            if full < many and 0 < rest < copies:  # one sequence gets the last few
                put(size, rest, first + full, rest, capacity - free)
                add(free - rest * size, first + full, 1)
                full += 1
            add(free, first + full, many - full)
    volume = int((counts * np.arange(capacity + 1)).sum())
    return Packed(np.array(out, np.int64).reshape(-1, 6), seq, planned, -(-volume // capacity))


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = 4096, end: int = 1) -> DataFrame:
    """One row per piece of the rows of ``docs`` (doc_id, text): doc_id, piece, start,
    length, ids_crc32, sequence_id, offset.

    A document is its token ids and ``end``; null and empty texts are ``end`` alone.
    Longer ones than ``capacity`` are cut there. Pieces are counted by length, the
    histogram (at most ``capacity`` rows) gives a plan on the driver, and each piece
    finds its place from its rank among the pieces of its length. Ranks in a
    length are counted over many tasks, and the plan, whose size the capacity bounds,
    is sent to all. Repeated rows are pieces of their own, ids may be null or repeat;
    an empty table gives no rows, and other columns are ignored."""
    cut = written(pieces(docs, tokenizer_file, capacity, end), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in cut.groupBy("length").count().collect():  # at most `capacity` rows
        counts[size] = n
    packed = plan(counts, capacity)
    logging.getLogger(__name__).info("%d sequences, %d of them planned by the linear program, at least %d", packed.sequences, packed.planned, packed.least)
    slots = packed.rows[np.lexsort((packed.rows[:, 1], packed.rows[:, 0]))]
    keys = slots[:, 0] << 48 | slots[:, 1]
    placed = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = columns(batch)
            size, rank = ints(c["length"]), ints(c["rank"])
            s = slots[np.searchsorted(keys, size << 48 | rank, "right") - 1]
            k = rank - s[:, 1]
            at = [s[:, 3] + k // s[:, 4], s[:, 5] + k % s[:, 4] * size] if len(slots) else [rank, rank]
            yield from batched(placed, [*(c[n] for n in _PIECES.names), *at])

    order = ["doc_id", "piece", "ids_crc32", "start"]
    numbered = ranked(cut, ["length"], order, F.struct("doc_id", "piece", "ids_crc32"))
    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
