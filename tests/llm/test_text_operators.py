"""Text operators against brute force, with nulls, empty and long texts, copies, clashing names and empty tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import DOC, LOWER, corpus, roots, rows, words
from pyspark.sql import functions as F

from spanflow.llm import exact_dedup, kernels, mixing, ngram_join, packing, substring_dedup, suffix_dedup, token_counts, windows

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOC).repartition(3)


@pytest.fixture(scope="module")
def texts():
    return {r[0]: r[1] or "" for r in corpus()}


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def test_word_kernel(texts):
    import pyarrow as pa

    data, at = kernels.buffers(pa.array(list(texts.values())))
    starts, ends, codes, first = kernels.words(data, at)
    for i, t in enumerate(texts.values()):
        found = [bytes(data[a:b]).decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])]
        assert found == words(t)
    assert len(set(codes.tolist())) == len({w for t in texts.values() for w in words(t)})


def test_exact_dedup(spark, docs, texts, empty):
    got = rows(exact_dedup.exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    groups = collections.defaultdict(list)
    for i, t in texts.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append(i)
    for body, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(texts[i]), i))
        for i in ids:
            assert got[i] == (keep, len(ids), i == keep, hashlib.sha256(body.encode()).hexdigest())
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_checks_bytes(docs, texts):
    """A digest of 4 bits covers many texts: all bytes decide."""
    weak = rows(exact_dedup.exact_dedup(docs, bits=4), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert weak == rows(exact_dedup.exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert set(weak) == set(texts)


def test_exact_dedup_odd_ids(spark):
    odd = spark.createDataFrame([(None, "a b"), (2, "ab"), (2, "ab"), (3, "a  b"), (None, None)], "doc_id long, text string")
    got = [tuple(r) for r in exact_dedup.exact_dedup(odd).select("doc_id", "keep_id", "group_size", "kept").collect()]
    assert sorted(got, key=str) == sorted([(None, 3, 4, False), (2, 3, 4, False), (2, 3, 4, False), (3, 3, 4, True), (None, None, 1, True)], key=str)


def test_exact_dedup_goes_on_from_its_state(spark, tmp_path):
    facts = spark.createDataFrame([("d1", 5, 1, 0), ("d1", 7, 2, 0), ("d2", 1, 3, 0)], "digest string, n int, id long, check long")
    facts.write.parquet(f"{tmp_path}/f")
    exact_dedup.state_stream(spark.read.parquet(f"{tmp_path}/f"), f"{tmp_path}/s", f"{tmp_path}/o1")
    spark.createDataFrame([("d1", 9, 4, 0)], facts.schema).write.mode("append").parquet(f"{tmp_path}/f")
    exact_dedup.state_stream(spark.read.parquet(f"{tmp_path}/f"), f"{tmp_path}/s", f"{tmp_path}/o2")
    later = [(r["digest"], r["group_size"], r["best"]["id"]) for r in spark.read.parquet(f"{tmp_path}/o2").collect()]
    assert later == [("d1", 3, 4)]


def test_mixing(spark, docs, texts, empty):
    got = rows(mixing.mix(docs), "doc_id", "size", "source_size", "target", "taken", "source")
    size = {i: len(words(t)) for i, t in texts.items()}
    assert {i: v[0] for i, v in got.items()} == size
    by = collections.defaultdict(int)
    for i, v in got.items():
        by[v[4]] += size[i]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(by, key=lambda s: (s is None, s or "")))}
    budget, target, open_ = 1.5 * sum(by.values()), {}, set(by)
    while open_:  # reshare the excess until none is above
        level = (budget - sum(target.values())) / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > 2 * by[s]}
        if not over:
            target |= {s: level * weights[s] for s in open_}
            break
        target |= {s: 2.0 * by[s] for s in over}
        open_ -= over
    taken = collections.defaultdict(int)
    for i, v in got.items():
        assert v[1] == by[v[4]] and abs(v[2] - target[v[4]]) < 1e-6 and v[3] in (0, size[i], 2 * size[i])
        taken[v[4]] += v[3]
    for s in by:
        base, reach = int(target[s] // by[s]) if by[s] else 0, 1
        for i, v in got.items():
            reach |= reach << v[0] if v[4] == s else 0
        left = round(target[s]) - base * by[s]
        best = (reach & ((2 << left) - 1)).bit_length() - 1  # the nearest sum of whole documents below
        assert best - 2 <= taken[s] - base * by[s] <= left, (s, taken[s], target[s])
    assert got == rows(mixing.mix(docs.repartition(7)), "doc_id", "size", "source_size", "target", "taken", "source")
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_fit_is_the_best_subset(seed):
    r = np.random.default_rng(seed)
    sizes, counts = np.unique(r.integers(0, 30, 6)), None
    counts = r.integers(1, 4, len(sizes))
    sums = {0}
    for s, c in zip(sizes, counts):
        sums = {a + s * k for a in sums for k in range(c + 1)}
    for budget in range(0, int((sizes * counts).sum()) + 2, 3):
        take = mixing.fit(sizes, counts, budget)
        assert (take <= counts).all() and (take >= 0).all()
        assert budget >= (take * sizes).sum() >= max(x for x in sums if x <= budget) - (sizes.max() if budget > 4 * sizes.max() else sizes.max())


@pytest.mark.parametrize(("window", "gram"), [(100, 32), (20, 5), (9, 9)])
def test_suffix_dedup(docs, texts, window, gram):
    got = rows(suffix_dedup.suffix_dedup(docs, window, gram), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    seen = set()
    for i in sorted(texts):
        b = texts[i].encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - window + 1):
            s = b[k : k + window]
            if s in seen:
                gone[k : k + window] = True
            seen.add(s)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        assert got[i] == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept), i


def test_suffix_sort():
    r = np.random.default_rng(0)
    data = r.integers(0, 3, 400).astype(np.uint8)
    group = np.sort(r.integers(0, 4, 90))
    at = r.integers(0, 380, 90)
    size = np.minimum(r.integers(0, 20, 90), 400 - at)
    s = suffix_dedup.Suffixes(data, at, size)
    want = sorted(range(90), key=lambda i: (group[i], bytes(data[at[i] : at[i] + size[i]]), i))
    assert s.sort(group).tolist() == want


@pytest.mark.parametrize(("window", "gram"), [(35, 20), (6, 3), (5, 5)])
def test_substring_dedup(docs, texts, window, gram):
    got = rows(substring_dedup.substring_dedup(docs, window, gram), "doc_id", "n_words", "n_removed", "kept_sha256", "kept")
    w = {i: words(t) for i, t in texts.items()}
    count = collections.Counter(tuple(x[k : k + window]) for x in w.values() for k in range(len(x) - window + 1))
    for i, x in w.items():
        gone = [False] * len(x)
        for k in range(len(x) - window + 1):
            if count[tuple(x[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = " ".join(a for a, g in zip(x, gone) if not g)
        assert got[i] == (len(x), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept), i


def test_suffix_automaton():
    r = np.random.default_rng(1)
    sequences = [r.integers(0, 3, 25).tolist() for _ in range(5)]
    a = substring_dedup.SuffixAutomaton()
    for s in sequences:
        a.add(s)
    a.total()
    count = collections.Counter(tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1))
    for s in sequences:
        want = [max((n for n in range(1, k + 2) if count[tuple(s[k + 1 - n : k + 1])] >= 2), default=0) for k in range(len(s))]
        assert a.statistics(s) == want


@pytest.mark.parametrize("op", [suffix_dedup.suffix_dedup, substring_dedup.substring_dedup, ngram_join.jaccard_join])
def test_empty_tables(empty, op):
    assert op(empty).count() == 0


def near_groups(spark):
    """One shingle in many documents that are alike in groups, so that pivots and blocks have work."""
    base = [f"w{i}" for i in range(60)]
    out = []
    for i in range(120):
        w = list(base)
        for j in range(i % 3):
            w[(i * 7 + j * 13) % 60] = f"x{i}"
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("crowded", [False, True])
def test_jaccard_join(spark, docs, texts, crowded, monkeypatch):
    if crowded:
        monkeypatch.setattr(ngram_join, "BLOCK", 16)
        pairs = near_groups(spark)
        docs, texts = spark.createDataFrame(pairs, "doc_id long, text string"), dict(pairs)
    got = rows(ngram_join.jaccard_join(docs), "doc_id", "n_shingles", "component_id")
    sets = {}
    for i, t in texts.items():
        w = words(t.translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = roots(ids, links)
    assert got == {i: (len(sets[i]), want[i]) for i in ids}


def test_pack(docs, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack(docs, path, capacity=512).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for i, t in texts.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        cuts = [ids[k : k + 512] for k in range(0, len(ids), 512)]
        found = sorted(by[i], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found] == [(k, 512 * k, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for k, c in enumerate(cuts)]
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 512
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 512) + 1


def test_word_encoder():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    odd = ["", "a\x0bb c\x0cd  'T don't <|endoftext|>x é é İΣ ß ½ x² \x7f \x01 a b ​ 😀", "Été " * 3]
    tokenizer, encode = Tokenizer.from_file(path), packing.word_encoder(path)
    for _ in range(2):
        for t, b in zip(odd, encode([t.encode() for t in odd])):
            assert np.frombuffer(b, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(3))
def test_plan_places_everything(seed):
    r = np.random.default_rng(seed)
    counts = np.zeros(101, np.int64)
    np.add.at(counts, np.minimum(100, 1 + r.exponential(30, 3000).astype(int)), 1)
    packed = packing.plan(counts, 100)
    fill = placed(packed, counts, 100)
    assert packed.least == -(-int((counts * np.arange(101)).sum()) // 100)
    assert len(fill) == packed.sequences <= packed.least + 3 and packed.planned >= 0.9 * packed.sequences


def placed(packed, counts, capacity):
    """What each sequence holds; checks that all items are placed without gaps or overlaps."""
    ranks, spans = np.zeros(capacity + 1, np.int64), collections.defaultdict(list)
    for size, rank, n, first, copies, offset in packed.rows.tolist():
        assert ranks[size] == rank
        ranks[size] += n
        for k in range(n):
            spans[first + k // copies].append((offset + k % copies * size, size))
    assert (ranks == counts).all()
    for held in spans.values():
        at = 0
        for offset, size in sorted(held):
            assert offset == at
            at += size
        assert at <= capacity
    return spans


def test_the_program_beats_best_fit():
    """Best-fit decreasing needs 1100 sequences here, and 900 are enough."""
    counts = np.zeros(101, np.int64)
    counts[[51, 27, 26, 23]] = 600, 600, 600, 1200
    packed = packing.plan(counts, 100)
    placed(packed, counts, 100)
    assert packed.sequences <= 910 and packed.least == 900
    assert packing.plan(np.zeros(101, np.int64), 100).sequences == 0
    none = np.zeros((0, 0), np.int64)
    assert packing.rounded(counts, 100, [], none, np.zeros(0), 1.0, 0).sequences == 1100


def test_the_program_covers_its_histogram():
    r = np.random.default_rng(1)
    counts = np.bincount(np.minimum(4096, 1 + r.lognormal(6.5, 1, 4000).astype(int)), minlength=4097)
    groups = packing.grouped(counts, 4096)
    sizes, need = np.array([g[0] for g in groups]), np.array([counts[g].sum() for g in groups])
    pool, use, bound = packing.configurations(need.astype(float), sizes, 4096)
    assert (use @ pool >= need - 1e-6).all() and (pool @ sizes <= 4096).all()
    assert bound <= use.sum() <= 1.1 * bound


def test_an_empty_table_packs_to_nothing(empty):
    assert packing.pack(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert token_counts.token_counts(empty, public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0


def test_token_counts(docs, texts):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    vocabulary = token_counts.vocabulary(path)
    single = {bytes([b]) for b in range(256)}
    first, inside = {t[1:] for t in vocabulary if t.startswith(b" ")} | single, {t for t in vocabulary if b" " not in t} | single

    def pieces(word):
        n, at = 0, 0
        while at < len(word):
            known = inside if at else first
            at += max(k for k in range(1, len(word) - at + 1) if word[at : at + k] in known)
            n += 1
        return n

    got = rows(token_counts.token_counts(docs, path), "doc_id", "n_words", "n_tokens")
    assert got == {i: (len(words(t)), sum(pieces(w.encode()) for w in words(t))) for i, t in texts.items()}
    assert token_counts.Automaton([b" ab", b"cd"]).count(b"abcdx") == 3


def test_odd_ids(spark):
    """Null and repeated ids, repeated rows, and different texts of one id."""
    long = " ".join(f"w{i}" for i in range(60))
    odd = spark.createDataFrame([(None, long), (None, None), (2, long), (2, long), (2, "other text"), (3, long + " x"), (4, "")], "doc_id long, text string").withColumn("source", mixing.F.lit(None).cast("string"))
    path, rank = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    near = sorted((tuple(r) for r in ngram_join.jaccard_join(odd).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert near == sorted([(None, 56, 2), (None, 0, None), (2, 56, 2), (2, 56, 2), (2, 1, 2), (3, 57, 2), (4, 0, 4)], key=str)
    cut = sorted((tuple(r) for r in substring_dedup.substring_dedup(odd).select("doc_id", "n_words", "n_removed").collect()), key=str)
    assert cut == sorted([(None, 60, 60), (None, 0, 0), (2, 60, 60), (2, 60, 60), (2, 2, 0), (3, 61, 60), (4, 0, 0)], key=str)
    n = len(long.encode())
    cut = sorted((tuple(r) for r in suffix_dedup.suffix_dedup(odd).select("doc_id", "n_bytes", "n_removed").collect()), key=str)
    assert cut == sorted([(None, n, n), (None, 0, 0), (2, n, 0), (2, n, 0), (2, 10, 0), (3, n + 2, n), (4, 0, 0)], key=str)
    assert packing.pack(odd, path).count() == 7 and token_counts.token_counts(odd, rank).count() == 7
    sizes = mixing.mix(odd).collect()
    assert len(sizes) == 7 and {r["source"] for r in sizes} == {None}


@pytest.mark.parametrize("seed", range(20))
def test_sorted_rows_come_in_whole_groups(seed):
    rng = np.random.default_rng(seed)
    h = np.sort(rng.integers(0, rng.integers(1, 40), rng.integers(0, 400)))
    batches = [pa.record_batch({"h": x, "i": np.arange(len(x))}) for x in np.split(h, np.sort(rng.integers(0, len(h) + 1, 9)))]
    least = int(rng.integers(1, 60))
    tables = list(windows.grouped(iter(batches), lambda b: (b.column(0).to_numpy(),), least))
    parts = [t.column("h").to_numpy() for t in tables]
    assert np.concatenate([h[:0], *parts]).tolist() == h.tolist()
    for one, two in zip(parts, parts[1:]):
        assert one[-1] != two[0] and len(one) >= least
    for one in parts:
        assert len(one) - (one == one[-1]).sum() < least  # no more than is asked for, and the last group


@pytest.mark.parametrize("bits", [1, 3])
@pytest.mark.parametrize("op", [suffix_dedup.suffix_dedup, substring_dedup.substring_dedup])
def test_hashes_that_collide_remove_nothing(docs, op, bits):
    """With hashes of so few bits nearly all runs of an anchor are taken for equal: what they are compared with decides."""
    run = lambda **more: sorted(map(tuple, op(docs, window=20, gram=6, **more).select("doc_id", "n_removed", "kept_sha256").collect()), key=str)
    assert run(bits=bits) == run()


@pytest.mark.parametrize("op", [suffix_dedup.suffix_dedup, substring_dedup.substring_dedup])
def test_one_phrase_in_many_texts(spark, op):
    """Texts that share a phrase shorter than a window have nothing to lose."""
    word = lambda k: F.sha2(F.concat(F.col("id").cast("string"), F.lit(k)), 256)
    phrase = "a phrase of thirty two bytes ok "
    if op is suffix_dedup.suffix_dedup:
        text = F.concat(F.substring(word("a"), 1, 34), F.lit(phrase), F.substring(word("b"), 1, 34))
    else:
        text = F.concat_ws(" ", *[F.substring(word(f"a{k}"), 1, 6) for k in range(7)], *[F.lit(f"w{k}") for k in range(21)], *[F.substring(word(f"b{k}"), 1, 6) for k in range(7)])
    docs = spark.range(300_000 if op is suffix_dedup.suffix_dedup else 20_000).repartition(8).select(F.col("id").alias("doc_id"), text.alias("text"))
    assert op(docs, with_text=False).where("n_removed > 0").count() == 0


@pytest.mark.parametrize("op", [suffix_dedup.suffix_dedup, substring_dedup.substring_dedup])
def test_an_anchor_of_many_runs_is_no_single_group(docs, spark, monkeypatch, op):
    r = np.random.default_rng(4)
    line = " ".join(f"licence{k}" for k in range(40))
    texts = [" ".join(f"w{k}" for k in r.integers(0, 9, 30)) + " " + line[: 80 + 3 * (i % 5)] + " " + " ".join(f"w{k}" for k in r.integers(0, 9, 30)) for i in range(60)]
    more = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for df in (docs, more):
        run = lambda: sorted(map(tuple, op(df, window=20, gram=8).select("doc_id", "n_removed", "kept_sha256").collect()), key=str)  # noqa: E731, B023
        want, steps, written = run(), [], windows.written
        for module in (suffix_dedup, substring_dedup):
            monkeypatch.setattr(module, "MANY", 1)
        monkeypatch.setattr(windows, "written", lambda x, name: steps.append(name) or written(x, name))
        assert run() == want and "windows" in steps
        monkeypatch.undo()
        monkeypatch.setattr(windows, "LEAST", 1)
        monkeypatch.setattr(windows, "SAMPLE", 1)  # every anchor that occurs twice is hot
        assert run() == want
        monkeypatch.undo()
