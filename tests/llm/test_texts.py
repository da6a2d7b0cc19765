"""Line dedup, near duplicates, decontamination and packing against brute force, and on odd rows."""

import functools
import random
import zlib
from array import array

import pytest
from pyspark.sql import functions as F

from sparray.llm import decontam, line_dedup, ngram_join, packing, queries, token_counts
from tests.llm import brute

DOCS = "doc_id bigint, text string"
#: Nulls, empty and blank texts, repeated rows, clashing names come on top of these.
ODD = [(None, "a line of ten or more\nand another line here"), (50, None), (51, ""), (52, " \t\n \n"), (53, "One Line Of Text\none line of text  \nshort\nshort"), (54, "one line of text\nOTHER line of text\n"), (55, "é" * 12 + "\n" + "É" * 12)]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").cache()


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.select(*columns).collect()]


def test_line_dedup_query(spark, sf, docs):
    got = {d: rest for d, *rest in rows(queries.op8_line_dedup(spark, sf), "doc_id", "n_lines", "n_dropped", "kept_sha256")}
    assert got == {d: [n, k, brute.sha(t)] for d, (n, k, t) in brute.kept_lines(rows(docs, "doc_id", "text")).items()}


@pytest.mark.parametrize("batches", [1, 3, 5])
def test_line_dedup_odd(spark, batches):
    texts = [*ODD, *[(i, "the same long line\nline %d of its own" % i) for i in range(20)], (7, "the same long line\nline 7 of its own")]
    df = spark.createDataFrame(texts, DOCS).withColumn("pos", F.lit(1)).withColumn("key", F.lit("k")).withColumn("doc", F.lit(2))
    out = line_dedup.dedup_lines(df, batches=batches)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    known = dict(brute.kept_lines([(d, t) for d, t in texts if d is not None]))
    for d, text, n, k in rows(out, "doc_id", "text", "n_lines", "n_dropped"):
        if d is None:
            assert text == ODD[0][1] and k == 0
        else:
            assert (n, k, text or "") == known[d]
    assert out.count() == len(texts)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_index_levels(spark):
    index = line_dedup.LineIndex(spark, fanout=2)
    for b in range(4):
        part = spark.createDataFrame([(b, 1, 0, h, h) for h in (b, 100)], "doc bigint, version bigint, pos int, h1 bigint, h2 bigint")
        new = index.add(part)
        assert {r["h1"] for r in new.collect()} == ({0, 100} if b == 0 else {b})
    assert [len(level) for level in index.levels] == [0, 0, 1] and index.merges == 3
    assert sorted(rows(index.first_holders(), "h1", "doc")) == [(0, 0), (1, 1), (2, 2), (3, 3), (100, 0)]


def near_copies(n, words, change, seed):
    r = random.Random(seed)
    base = ["w%d" % r.randrange(5000) for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(r.randint(0, change)):
            copy[r.randrange(words)] = "x%d" % r.randrange(10**6)
        out.append(" ".join(copy))
    return out


def test_near_duplicates_query(spark, sf, docs):
    got = {d: (n, c) for d, n, c in rows(queries.op6_ngram_join(spark, sf), "doc_id", "n_shingles", "component_id")}
    assert got == brute.near_classes(rows(docs, "doc_id", "text"))


@pytest.mark.parametrize(("words", "similarity", "tile"), [(3, (90, 100), 1024), (3, (90, 100), 7), (5, (80, 100), 9)])
def test_near_duplicates_made_up(spark, monkeypatch, words, similarity, tile):
    """Groups at the edge of the similarity, short texts, and components far larger than a tile."""
    monkeypatch.setattr(ngram_join, "TILE_TEXTS", tile)
    monkeypatch.setattr(ngram_join, "TILE_MAPS", 2 * tile)
    monkeypatch.setattr(ngram_join, "BATCH_KEYS", 2000)
    texts = []
    for k, (n, size, change) in enumerate([(40, 150, 4), (25, 30, 1), (20, 60, 2), (30, 12, 1), (10, 400, 12), (6, 3, 1), (6, 2, 1)]):
        texts += near_copies(n, size, change, k)
    texts += [" ".join(t.split()[: len(t.split()) - i]) for i, t in enumerate(texts[:12])]  # sizes that shade into each other
    texts += ["", None, "  ", "one", "ONE", "one two", "One\ttwo"]
    random.Random(3).shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("node", F.lit("x")).withColumn("n", F.lit(1)).repartition(3)
    got = {d: (n, c) for d, n, c in rows(ngram_join.near_duplicates(df, words=words, similarity=similarity), "doc_id", "n_shingles", "component_id")}
    assert got == brute.near_classes(list(enumerate(texts)), words, *similarity)


def test_near_duplicates_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{p}{i}" for i in range(30)) for p in "abc")
    df = spark.createDataFrame([(5, a), (5, b), (6, b), (7, a), (None, a), (8, c), (8, c)], DOCS)
    out = rows(ngram_join.near_duplicates(df), "doc_id", "n_shingles", "component_id")
    assert sorted(out, key=str) == sorted([(5, 28, 5), (5, 28, 5), (6, 28, 5), (7, 28, 5), (None, 28, None), (8, 28, 8), (8, 28, 8)], key=str)
    assert ngram_join.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("fitting", [0, 1000])
def test_components(spark, fitting):
    """By stars and by union-find, against a plain search; the edges of a long path, a star and random ones."""
    from sparray.llm.graph import components

    r = random.Random(6)
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(20)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    want = {}
    for node in sorted(near):
        todo = [] if node in want else [node]
        while todo:
            if (x := todo.pop()) not in want:
                want[x] = node
                todo += near[x]
    found = components(spark.createDataFrame(edges, "u bigint, v bigint"), fitting)
    assert sorted(rows(found, "u", "v")) == sorted((x, t) for x, t in want.items() if x != t)


def test_keys_meet_whenever_similar():
    """Any two sets that are similar enough hold as many of each other's keys as both need: random pairs at the edge."""
    import numpy as np

    r = np.random.default_rng(1)
    for similarity in ((90, 100), (80, 100)):
        bands, linked = ngram_join.Bands(similarity), 0
        for _ in range(3000):
            n = int(r.integers(2, 300))
            a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
            k = int(r.integers(0, n // 5 + 1))
            b = np.unique(np.concatenate((a[k:], r.integers(0, 2**64, int(r.integers(0, n // 8 + 1)), dtype=np.uint64))))
            if not len(b) or not bands.linked(a, b) or np.array_equal(a, b):
                continue
            linked += 1
            for keys in (ngram_join.part_keys, lambda x, b: ngram_join.part_keys(x, b, fewest=2), ngram_join.shingle_keys):
                spaces = [{s: (k, need) for s, k, need in keys(x, bands)} for x in (a, b)]
                met = [s for s in spaces[0] if s in spaces[1] and all(np.intersect1d(spaces[0][s][0], spaces[1][s][0]).size >= x[s][1] for x in spaces)]
                assert met
        assert linked > 300


def test_shared_passages_are_no_candidates(spark):
    """Texts that share a third of their words with very many others go by counting, before any two are compared."""
    r = random.Random(8)
    passage = [f"p{i}" for i in range(40)]
    texts = [" ".join([*(f"w{r.randrange(10**9)}" for _ in range(40)), *passage, *(f"w{r.randrange(10**9)}" for _ in range(40))]) for _ in range(300)]
    texts += [f"{texts[0]} and a little more"]
    bands = ngram_join.Bands((80, 100))
    rows = ngram_join.keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, raw string"), 5, lambda f: ngram_join.part_keys(f, bands), 256)
    left = {tuple(x) for x in ngram_join.possible(ngram_join.counted(rows, 3)).collect()}
    digests = [ngram_join.digest(ngram_join.shingles(t.encode(), 5)) for t in texts]
    assert {digests[0], digests[-1]} <= left
    assert len(left) < 30


def test_decontamination_query(spark, sf, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = {d: tuple(rest) for d, *rest in rows(queries.op10_decontamination(spark, sf), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")}
    assert got == brute.marks(rows(docs, "doc_id", "text"), items)
    assert any(v[4] for v in got.values())


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 40])
def test_decontamination_odd(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    long = " ".join(f"w{i}" for i in range(20))
    items = [(1, long), (2, "short Item"), (2, None), (3, "..."), (4, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17"), (None, "no id here"), (10, "short item")]
    texts = [(1, "a b " + long + " c"), (2, None), (3, ""), (4, "a short-item b " * 3), (4, "none"), (5, "W5 w6, w7;w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 and more " + "x " * 300), (6, "no id here"), (7, "é É " + "w1 " * 40)]
    df = spark.createDataFrame(texts, DOCS).withColumn("marks", F.lit(1))
    marked = decontam.with_marks(df, spark.createDataFrame(items, "item_id bigint, text string"), "m")
    for d, t, m in rows(marked, "doc_id", "text", "m"):
        n, hit, count, _, _ = brute.marks([(d, t)], [(i, x) for i, x in items if i is not None] + [])[d]
        if d == 6:
            assert m["items"] == [] and sum(r["to"] - r["from"] for r in m["ranges"]) == 3
        else:
            assert (m["n_words"], sum(r["to"] - r["from"] for r in m["ranges"]), len(m["items"])) == (n, hit, count)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    kept = decontam.decontaminate(df, bench)
    assert kept.columns == df.columns and {d for (d,) in rows(kept, "doc_id")} == {2, 3, 4, 5, 7}
    cut = {t for d, t in rows(decontam.decontaminate(df, bench, remove="spans"), "doc_id", "text") if d == 1}
    assert cut == {"a b  c"}
    assert decontam.decontaminate(df.limit(0), bench).count() == 0
    assert decontam.decontaminate(df, bench.limit(0)).count() == len(texts)


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def tokens(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", " ", "It's a THING, isn't it...", "İstanbul ΑΣ. ﬁ é ́x", "<|endoftext|>x<|startoftext|>", "a\r\n\tb\x0bc\xa0d", "Ünïcode, straße. ŉa ǅ", "12a3b!!...,.", "日本語。한국어 🙂"])
def test_encoding(text):
    from sparray.llm.encoding import Encoder

    assert array("I", Encoder(queries.vocabulary()).encode([text])[0]).tolist() == tokens(text)


def test_encoding_random_strings():
    """Against the tokenizer: combining marks, special tokens, all white space, letters with odd lower cases, any signs."""
    from sparray.llm.encoding import PROBES, Encoder

    coder, r = Encoder(queries.vocabulary()), random.Random(11)
    assert coder.plain
    some = [*"aBzÉéßÿ.,;:!?'\"-_0 9²¼ªº", *" \t\n\x0b\x0c\r\x1c\x1f\x85\xa0\u1680\u2003\u2028\u200b\u3000", *"İıŉǅΣςÅΩKﬁ", *"\u0301\u0307\u0345\u200d\ufe0f", *"日한🙂🇩", "'s", "'LL", "<|endoftext|>", "<|StartOfText|>", "<|", "the", "İ,", "DİLİ.", "\x00", "\x7f"]
    texts = ["".join(r.choice(some) for _ in range(r.randint(1, 14))) for _ in range(20000)]
    texts += ["".join(chr(r.choice((r.randrange(0x250), r.randrange(0x3000), r.randrange(0x10000, 0x1FFFF)))) for _ in range(r.randint(1, 10))) for _ in range(10000)]
    texts = [t for t in [*texts, *PROBES] if not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    want = [e.ids for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = coder.encode(texts)
    assert [t for t, g, w in zip(texts, got, want, strict=True) if array("I", g).tolist() != w] == []
    assert coder.lengths(texts) == list(map(len, want))


def test_encoding_full_caches(monkeypatch):
    from sparray.llm import encoding

    monkeypatch.setattr(encoding, "CACHED", 30)
    monkeypatch.setattr(encoding, "PIECES", 5)
    coder = encoding.Encoder(queries.vocabulary())
    texts = [" ".join(f"word{i * 7 % 61} Ω{i}" if i % 3 else f"é{i}, y{i}." for i in range(k, k + 40)) for k in range(30)]
    assert [array("I", g).tolist() for g in coder.encode(texts)] == [tokens(t) for t in texts]


def check_packing(texts, got, capacity):
    """Every document's pieces are all there, and sequences are gapless and within capacity."""
    want = []
    for d, t in texts:
        ids = [*tokens(t), 0]
        for k, i in enumerate(range(0, len(ids), capacity)):
            part = ids[i : i + capacity]
            want.append((d, k, i, len(part), zlib.crc32(array("I", part).tobytes())))
    assert sorted((tuple(g[:5]) for g in got), key=str) == sorted(want, key=str)
    by = {}
    for *_, length, _, sequence, offset in got:
        by.setdefault(sequence, []).append((offset, length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    total = sum(w[3] for w in want)
    assert len(by) <= 1.1 * total / capacity + 1
    return len(by)


def test_packing_query(spark, sf, docs):
    got = rows(queries.op5_packing(spark, sf), "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    check_packing(rows(docs, "doc_id", "text"), got, 2048)


def test_packing_odd(spark):
    texts = [(1, None), (1, ""), (2, "x " * 40), (2, "x " * 40), (None, "a b c"), (3, "word " * 100)] + [(i, "q " * (i % 9)) for i in range(10, 90)]
    df = spark.createDataFrame(texts, DOCS).withColumn("length", F.lit(1)).withColumn("rank", F.lit(2))
    packed = packing.pack(packing.pieces_of(df, queries.vocabulary(), capacity=16, keep_ids=True), 16)
    got = rows(packed, "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    check_packing(texts, got, 16)
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"])
    assert packing.pack(packing.pieces_of(df.limit(0), queries.vocabulary())).count() == 0


def test_plan_is_best_fit_decreasing():
    r = random.Random(5)
    for _ in range(60):
        capacity = r.choice((10, 64, 100))
        lengths = [r.randint(1, capacity) for _ in range(r.randint(1, 300))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        slots, opened = packing.plan(histogram, capacity)
        spaces = []
        for n in sorted(lengths, reverse=True):  # document by document
            fits = [i for i, s in enumerate(spaces) if s >= n]
            if fits:
                spaces[min(fits, key=lambda i: spaces[i])] -= n
            else:
                spaces.append(capacity - n)
        assert opened == len(spaces)
        assert len(slots) <= packing.plan_bound(capacity)
        assert sum(s.last - s.first for s in slots) == len(lengths)


def test_token_counts(spark, sf, docs):
    lengths = sorted(len(tokens(t)) for _, t in rows(docs, "doc_id", "text"))
    got = rows(queries.op4_token_counts(spark, sf), "context_limit", "n_docs", "n_fit", "n_longer", "tokens", "tokens_kept", "tokens_lost")
    want = [(n, lengths.count(n), sum(x <= n for x in lengths), sum(x > n for x in lengths), sum(lengths), sum(min(x, n) for x in lengths), sum(x - min(x, n) for x in lengths)) for n in set(lengths)]
    assert sorted(got) == sorted(want)
    histogram = token_counts.length_histogram(docs, queries.vocabulary())
    assert dict(rows(token_counts.kept_at(histogram, [0, 7, 10**9]), "context_limit", "tokens_kept")) == {n: sum(min(x, n) for x in lengths) for n in (0, 7, 10**9)}
    odd = spark.createDataFrame([(None,), ("",), ("a b",), ("a b",)], "text string").withColumn("length", F.lit(5))
    assert dict(rows(token_counts.length_histogram(odd, queries.vocabulary()), "length", "n_docs")) == {0: 2, 2: 2}
    assert token_counts.context_limits(token_counts.length_histogram(odd.limit(0), queries.vocabulary())).count() == 0
