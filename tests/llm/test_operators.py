"""The ten operators against brute force, exact round trips and held-out accuracy, and their defined odd cases."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from siftwell.llm import (
    chat_snapshots,
    compression_bands,
    discriminant,
    feistel_pii,
    matches,
    maxent_lm,
    mixing_coder,
    order_minhash,
    ppm_language,
    prefix_bpe,
    pretokens,
    qgram_decontamination,
    textcodes,
)

SF = "/root/testdata/sf0.001"
RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, found string, node string, row string, n long"


def odd(spark, texts):
    rows = [(i, t, None if i % 3 else "en", None, None, "f", "n", "r", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


LONG = " ".join(f"word{i % 977} of{i % 13}" for i in range(60_000))
ODD = [None, "", " \n\t", "one", "one", "ÄÖ ß é", LONG, LONG, "a\n\na\nb b b b b b", "<|endoftext|> don't 12 345  x"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def base_counts(t):
    w = WORD.findall(t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    many = {g for g in grams if grams.count(g) > 1} if len(grams) < 400 else {g for g in set(grams) if sum(1 for x in grams if x == g) > 1}
    cover = {k + j for k, g in enumerate(grams) if g in many for j in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(cover)


def test_op1_counts_and_verdict(spark, docs, texts):
    short = {i: t for i, t in texts.items() if len(t) < 3000}
    got = {r.doc_id: r for r in compression_bands.compression_bands(docs).collect()}
    for i, t in short.items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(t)
    low = {r.doc_id: r for r in compression_bands.compression_bands(odd(spark, ODD)).collect()}
    assert len(low) == len(ODD) and all(low[i].base_failed and not low[i].kept for i in (0, 1, 2, 3))
    assert compression_bands.compression_bands(odd(spark, [])).count() == 0


def test_op1_verdict_equals_brute_force(spark, docs, texts):
    import zstandard

    def verdict(t):
        raw, (n, _, _, _, repeats) = t.encode(), base_counts(t)
        if n < 10 or 100 * repeats > 20 * n:
            return False
        ratio = lambda x: len(zstandard.ZstdCompressor(level=compression_bands.LEVEL).compress(x)) / len(x)
        size = compression_bands.CHUNK_BYTES
        chunks = [raw[a : a + size] for a in range(0, len(raw), size)] if len(raw) >= size else []
        chunks = [c if len(c) == size else raw[-size:] for c in chunks]
        odd = [not compression_bands.CHUNK_LIMITS[0] <= ratio(c) <= compression_bands.CHUNK_LIMITS[1] for c in chunks]
        _, low, high = [b for b in compression_bands.BANDS if b[0] <= len(raw)][-1]
        return low <= ratio(raw) <= high and (not odd or sum(odd) / len(odd) <= compression_bands.MAX_ODD_CHUNKS)

    rng = random.Random(2)
    prose = next(t for t in texts.values() if 2500 < len(t) < 6000)
    noise = "".join(chr(rng.randrange(33, 127)) for _ in range(4000))
    noise = " ".join(noise[k : k + 7] for k in range(0, 4000, 7))
    made = [prose, noise, "word " * 900, prose[:2048] + noise[:2100], prose + noise[:300], "one two", "", prose[:2047], prose[:2048]]
    short = {i: t for i, t in texts.items() if len(t) < 3000} | {10_000 + i: t for i, t in enumerate(made)}
    d = spark.createDataFrame(list(short.items()) + [(None, prose)], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in compression_bands.compression_bands(d).collect()}
    assert got == {i: verdict(t) for i, t in short.items()} | {None: verdict(prose)}
    assert got[10_000] and not got[10_001] and not got[10_002]


def test_op2_classes_equal_brute_force(spark, docs, texts):
    ids = list(texts)
    codes, bounds = order_minhash.labelled(pa.array([texts[i] for i in ids]))
    own = [codes[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if texts[ids[a]] == texts[ids[b]] or order_minhash.aligned(own[a], own[b]) >= 0.8:
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r for r in order_minhash.classes(docs).collect()}
    assert {i: got[i].class_id for i in ids} == {i: find(i) for i in ids}
    assert sum(r.kept for r in got.values()) == len(set(map(find, ids)))


def test_op2_odd_rows_and_keeping_one(spark):
    d = odd(spark, ODD)
    got = {r.doc_id: r.class_id for r in order_minhash.classes(d).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6, 7: 6, 8: 8, 9: 9}
    kept = order_minhash.keep_one(d.unionByName(d))
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [0, 0, 1, 2, 3, 5, 6, 8, 9]
    assert order_minhash.keep_one(odd(spark, [])).count() == 0


def family(rng):
    """A centre, 25 texts one word away, and 4 pairs: one text a word from the centre, one four words from it, too far from all others."""
    centre = [f"w{rng.randrange(10**6)}" for _ in range(200)]

    def edit(words, k):
        places = set(rng.sample(range(5, 195, 10), k))
        return [f"x{rng.randrange(10**6)}" if i in places else w for i, w in enumerate(words)]

    # a replaced word costs five k-mers of 196: four leave 0.815, five 0.774
    def pair():
        words = edit(centre, 1)
        free = [i for i in range(5, 195, 10) if words[i] == centre[i]]
        places = set(rng.sample(free, 4))
        return [words, [f"x{rng.randrange(10**6)}" if i in places else w for i, w in enumerate(words)]]

    return [" ".join(w) for w in (centre, *(edit(centre, 1) for _ in range(25)), *(x for _ in range(4) for x in pair()))]


def test_op2_linked_members_stay_partners(spark):
    rng = random.Random(8)
    texts = [t for _ in range(12) for t in family(rng)]
    got = {r.doc_id: r.class_id for r in order_minhash.classes(odd(spark, texts)).collect()}
    assert got == {i: i // 34 * 34 for i in range(len(texts))}


def test_op2_short_texts_find_their_near_copies(spark):
    rng = random.Random(9)
    texts = []
    for n in (*range(8, 23), 30, 40, 44):
        for _ in range(12):
            words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            texts += [" ".join(words), " ".join(["new", *words] if rng.random() < 0.5 else [*words, "new"])]
    got = {r.doc_id: r.class_id for r in order_minhash.classes(odd(spark, texts)).collect()}
    assert got == {i: i // 2 * 2 for i in range(len(texts))}


def test_op2_pairs_of_oversized_buckets_are_found(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "PAIRED", 4)
    rng = random.Random(10)
    head = [f"h{i}" for i in range(150)]
    texts = []
    for _ in range(16):
        one = head + [f"w{rng.randrange(10**6)}" for _ in range(60)]
        two = [*one[:208], f"x{rng.randrange(10**6)}", one[209]]
        three = [f"y{rng.randrange(10**6)}" if i in (155, 167, 179, 191) else w for i, w in enumerate(two)]
        texts += [" ".join(x) for x in (one, two, three)]
    ids = range(len(texts))
    codes, bounds = order_minhash.labelled(pa.array(texts))
    own = [codes[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    near = {(a, b) for a in ids for b in range(a) if order_minhash.aligned(own[a], own[b]) >= 0.8}
    assert all(a // 3 == b // 3 for a, b in near)
    want = {i: i // 3 * 3 if (i // 3 * 3 + 2, i // 3 * 3 + 1) in near else i for i in ids}
    got = {r.doc_id: r.class_id for r in order_minhash.classes(odd(spark, texts)).collect()}
    assert got == want and want[2] == 0
    rng = random.Random(8)
    texts = [t for _ in range(12) for t in family(rng)]
    got = {r.doc_id: r.class_id for r in order_minhash.classes(odd(spark, texts)).collect()}
    assert got == {i: i // 34 * 34 for i in range(len(texts))}


@pytest.mark.parametrize("carried", [400, 0])
def test_op2_families_in_large_buckets_equal_brute_force(spark, monkeypatch, carried):
    """Variants around 0.8 of one centre, with edits that several share: many classes meet in every bucket."""
    monkeypatch.setattr(order_minhash, "PAIRED", 2)
    monkeypatch.setattr(order_minhash, "CARRIED", carried)
    rng = random.Random(21)
    centre = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        words = list(centre)
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(12) * 10 + 5] = f"x{rng.randrange(3)}"
        texts.append(" ".join(words[: rng.randrange(100, 121)]))
    codes, bounds = order_minhash.labelled(pa.array(texts))
    own = [codes[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if texts[a] == texts[b] or order_minhash.aligned(own[a], own[b]) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r.class_id for r in order_minhash.classes(odd(spark, texts)).collect()}
    assert got == {i: find(i) for i in range(len(texts))} and 1 < len(set(got.values()))


def test_op3_held_out_accuracy_and_odd_rows(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in discriminant.quality_scores(docs, labels).collect()}
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in got.items())
    assert sum(a == b for a, b in held) / len(held) > 0.9
    none = discriminant.quality_scores(odd(spark, ODD), labels.limit(0)).collect()
    assert len(none) == len(ODD) and {r.score for r in none} == {0.5}


def test_op3_scores_equal_plain_densities(spark):
    rng = np.random.default_rng(5)
    d = len(discriminant.FEATURES)
    x = {0: rng.normal(0, 1, (60, d)) @ rng.normal(0, 1, (d, d)), 1: rng.normal(0.5, 1, (40, d)) @ rng.normal(0, 1, (d, d))}
    rows = [(x_.tolist(), k) for k in x for x_ in x[k]]
    moments = discriminant.class_moments(spark.createDataFrame(rows, "x array<double>, label int").repartition(5))
    model = discriminant.Discriminant(moments)
    ask = rng.normal(0, 1, (20, d))
    logs = []
    for k in (0, 1):
        mean, cov = x[k].mean(0), np.cov(x[k].T, bias=True)
        cov = (1 - discriminant.SHRINK) * cov + discriminant.SHRINK * np.diag(np.diag(cov)) + discriminant.RIDGE * np.eye(d)
        diff = ask - mean
        density = -0.5 * np.einsum("ij,ij->i", diff @ np.linalg.inv(cov), diff) - 0.5 * np.linalg.slogdet(cov)[1]
        logs.append(density + np.log(len(x[k]) / 100))
    odds = np.clip(logs[1] - logs[0], -discriminant.MAX_LOG_ODDS, discriminant.MAX_LOG_ODDS)
    assert model.score(ask) == pytest.approx(1 / (1 + np.exp(-odds)), rel=1e-6)


def test_op3_odd_labels(spark, docs):
    kinds = "doc_id long, quality int, toxic int"
    one = spark.createDataFrame([(i, 1, 0) for i in range(100)], kinds)
    assert {r.score for r in discriminant.quality_scores(docs, one).collect()} == {1.0}
    odd_ones = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (1, None, 0), (None, 1, 0), (2, 7, 0)], kinds)
    assert {r.score for r in discriminant.quality_scores(docs, odd_ones).collect()} == {0.5}
    assert discriminant.quality_scores(odd(spark, []), one).count() == 0
    extra = odd(spark, ODD).withColumn("x", F.lit(1)).withColumn("label", F.lit(2)).withColumn("score", F.lit(3))
    assert discriminant.quality_scores(extra.unionByName(extra.withColumn("doc_id", F.lit(None).cast("long"))), one).count() == 2 * len(ODD)


def test_op4_round_trip_and_damage(spark, docs, texts):
    t = Tokenizer.from_file(JSON)
    rng = np.random.default_rng(1)
    blocks = [rng.zipf(1.3, n).clip(0, 50_256).astype(np.uint32) for n in (0, 1, 2, 127, 128, 129, 700, 3000, 40_001, mixing_coder.BLOCK)]
    surprise = np.zeros(mixing_coder.BLOCK // 8, np.uint32)  # long certain, then never right
    surprise[-20_000:] = rng.permutation(50_000)[:20_000]
    blocks += [surprise, surprise.reshape(-1, 64).T.ravel()]
    blocks += [np.zeros(500, np.uint32), np.arange(mixing_coder.ALPHABET, dtype=np.uint32), np.tile(np.arange(300, dtype=np.uint32), 90)]
    coded = [mixing_coder.encode_block(b) for b in blocks]
    assert all((mixing_coder.decode_block(c) == b).all() for c, b in zip(coded, blocks))
    assert len(coded[-1]) < 0.25 * 4 * len(blocks[-1])  # what repeats is predicted
    for at in (2, 6, 12, 30, len(coded[6]) - 9):
        broken = bytearray(coded[6])
        broken[at] ^= 1
        with pytest.raises(ValueError):
            mixing_coder.decode_block(bytes(broken))
    with pytest.raises(ValueError):
        mixing_coder.decode_block(coded[6][:-2])
    with pytest.raises(ValueError):
        mixing_coder.encode_block(np.array([mixing_coder.ALPHABET]))
    check_token_file(spark, t, [(i, x) for i, x in texts.items() if len(x) < 400] + [(-5, None), (-4, "")])


def test_op4_a_whole_range_does_not_vanish():
    ranges = mixing_coder._Ranges(2)
    ranges.low[:], ranges.width[:] = [0, 5 << 48], 1 << 48
    assert ranges.due().tolist() == [0, 1]
    ranges.shift(np.arange(2))
    assert (ranges.width == (1 << 64) - 1).all() and not len(ranges.due())


def check_token_file(spark, t, rows):
    got = mixing_coder.write_and_read(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), JSON).collect()
    want, at = [], 0
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got)
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))


def test_op4_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(mixing_coder, "CACHE_WORDS", 50)
    t = Tokenizer.from_file(JSON)
    special = "a <|endoftext|>b<|endoftext|> c"
    assert 50256 in t.encode(special, add_special_tokens=False).ids
    check_token_file(spark, t, [(7, "same")] * 5 + [(None, "x"), (None, "y y"), (3, special), (2, "plain"), (7, "other"), (1, None)])
    assert mixing_coder.write_and_read(odd(spark, []), JSON).count() == 0
    # a text over several blocks, between short ones
    monkeypatch.setattr(mixing_coder, "BLOCK", 1 << 15)
    long = " ".join(f"w{i % 9973} {i % 7}" for i in range(30_000))
    assert len(t.encode(long, add_special_tokens=False).ids) > 2 * mixing_coder.BLOCK
    check_token_file(spark, t, [(1, "before"), (2, long), (3, "after"), (4, long[:1000])])
    clash = spark.createDataFrame([(1, "a b", 5, 6, "c")], "doc_id long, text string, start long, part long, payload string")
    assert [(r.doc_id, r.n_tokens) for r in mixing_coder.write_and_read(clash, JSON).collect()] == [(1, 3)]


def test_op4_new_matches_cost_less_than_a_search_by_the_library():
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("abcdefgh", k=9)) for _ in range(20_000))
    t = Tokenizer.from_file(JSON)
    fresh = lambda: mixing_coder._Library(JSON).slice

    def seconds(f, x):
        start = time.thread_time()
        f(x)
        return time.thread_time() - start

    whole = min(seconds(lambda x: t.encode_batch_fast(x, add_special_tokens=False), [text]) for _ in range(3))
    assert min(seconds(fresh(), pa.array([text])) for _ in range(3)) < 0.75 * whole


def test_op4_matches_seen_equal_the_library(monkeypatch):
    t = Tokenizer.from_file(JSON)
    rng = random.Random(5)
    words = ["".join(rng.choices("abé\x00\n '0ÿ日", k=rng.randint(1, 40))) for _ in range(4000)]
    texts = [*ODD, *(" ".join(words[k : k + 40]) for k in range(0, 4000, 40)), "x" * 17, "x" * 16, "x" * 30_000, "a\x00", "a", "a\x00\x00"]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]

    def check(library):
        for _ in range(2):
            ids, bounds = library.slice(pa.array(texts, pa.string()))
            assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want

    library = mixing_coder._Library(JSON)
    assert library.bare is not None
    check(library)
    library.bare = None  # each match by itself
    library.seen.clear()
    check(library)
    monkeypatch.setattr(mixing_coder, "CACHE_WORDS", 5)
    check(mixing_coder._Library(JSON))
    monkeypatch.setattr(matches, "mix64", lambda x: x & np.uint64(3 << 62))  # nearly all codes are equal
    texts, want = texts[: len(ODD) + 4] + texts[-6:], want[: len(ODD) + 4] + want[-6:]
    check(mixing_coder._Library(JSON))


def taught(ids):
    """A block's model that has taken in steps of ids."""
    model = mixing_coder._Model()
    for t, x in enumerate(ids):
        model.look(np.zeros(len(x), np.int64), np.zeros(len(x), np.int64))
        model.learn(t, x, 3 * model.row + 2)
    return model


def test_op4_values_are_found_by_the_part_they_are_in():
    rng = np.random.default_rng(6)
    every = rng.integers(0, mixing_coder.ALPHABET, (24, 8192))
    some = np.full((4, 50), 65_535)
    zipf = rng.zipf(1.2, (24, 8192)).clip(0, 50_256)
    for model in (mixing_coder._Model(), taught(every), taught(some), taught(np.zeros((9, 8192), np.int64)), taught(zipf)):
        upper = model.upper
        v = np.concatenate([upper[:-1], upper[1:] - 1, rng.integers(0, int(upper[-1]), 50_000, np.uint32)])
        assert (model.find(v) == np.searchsorted(upper, v, "right") - 1).all()
    values = [rng.integers(0, int(upper[-1]), 8192, np.uint32) for _ in range(64)]

    def seconds(f):
        start = time.thread_time()
        for v in values:
            f(v)
        return time.thread_time() - start

    searched = min(seconds(lambda v: np.searchsorted(upper, v, "right")) for _ in range(5))
    assert min(seconds(model.find) for _ in range(5)) < 0.6 * searched


def test_op4_checksums_combine():
    a, b = b"some bytes", b"and others" * 9
    assert mixing_coder.combine_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op5_equals_the_library(spark, docs, texts):
    e = encoding()
    every = {**texts, **{10_000 + i: t or "" for i, t in enumerate(ODD)}}
    both = docs.select("doc_id", "text").unionByName(odd(spark, ODD).selectExpr("doc_id + 10000 AS doc_id", "text"))
    for r in prefix_bpe.encode_and_decode(both, RANKS).collect():
        ids = e.encode_ordinary(every[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(every[r.doc_id].encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40), st.text(max_size=20), st.integers(0, 40), st.integers(0, 10))
def test_op5_prefixes_and_edits(text, new, start, size):
    v, e = prefix_bpe.vocabulary(RANKS), encoding()
    merge = lambda b: e._encode_single_piece(b) if b else []
    raw = text.encode()
    table = prefix_bpe.PrefixTable(v, raw)
    assert table.ids() == merge(raw) and table.prefix_ids(len(raw) // 2) == merge(raw[: len(raw) // 2])
    start = min(start, len(raw))
    end = min(len(raw), start + size)
    table.replace(start, end, new.encode())
    assert table.text == raw[:start] + new.encode() + raw[end:] and table.ids() == merge(table.text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=30), max_size=12), st.lists(st.sampled_from(["the", " and", "ization", "12", "é"]), max_size=9))
def test_op5_words_in_step_equal_single_tables(words, parts):
    v = prefix_bpe.vocabulary(RANKS)
    words = [*words, *("".join(parts[k:]).encode() for k in range(len(parts)))]
    assert v.tables.encode(words) == [prefix_bpe.PrefixTable(v, w).ids() for w in words]


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_op5_texts_with_equal_hashes_stay_apart(spark, monkeypatch):
    e = encoding()
    word = thue_morse(2048)
    texts = [word, word.translate(str.maketrans("ab", "ba")), "some words and some other words", "same words and more"]

    def right(ids, bounds):
        return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [e.encode_ordinary(t) for t in texts]

    encode = prefix_bpe.vocabulary(RANKS).words
    assert right(*pretokens.encode_slice(*textcodes.column_bytes(pa.array(texts)), encode))
    # every match collides, and then every two of one length
    monkeypatch.setattr(pretokens, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    assert right(*pretokens.encode_slice(*textcodes.column_bytes(pa.array(texts)), encode))
    monkeypatch.setattr(pretokens, "span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    assert right(*pretokens.encode_slice(*textcodes.column_bytes(pa.array(texts)), encode))


def test_hashes_of_spans_tell_bytes_and_lengths():
    rng = random.Random(4)
    words = {b"", b"\0", b"\0\0", thue_morse(64).encode(), thue_morse(128)[64:].encode()}
    words |= {bytes(rng.randrange(3) for _ in range(rng.randrange(100))) for _ in range(3000)}
    words = sorted(words)
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    assert len(set(textcodes.span_hashes(data, starts, ends).tolist())) == len(words)
    again = np.concatenate([data, data])
    assert (textcodes.span_hashes(again, starts + len(data), ends + len(data)) == textcodes.span_hashes(data, starts, ends)).all()


def lowered(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + ["\0"]


def test_op6_base_score_and_odd_rows(spark, docs, texts):
    counts: dict = {}
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for w in lowered(t):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for r in maxent_lm.score_documents(docs).collect():
        w = lowered(texts[r.doc_id])
        base = sum(np.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in counts for x in w), n)
        assert r.base_score == pytest.approx(base) and r.score < 0
    got = maxent_lm.score_documents(odd(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(np.isfinite(r.score) for r in got)
    twice = maxent_lm.score_documents(odd(spark, ODD).unionByName(odd(spark, ODD))).collect()
    assert len(twice) == 2 * len(ODD) and twice[0].train_tokens == 2 * got[0].train_tokens
    assert maxent_lm.score_documents(odd(spark, [])).count() == 0
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    none = spark.createDataFrame([(i, "a b") for i in held] + [(None, "c")], "doc_id long, text string")
    got = maxent_lm.score_documents(none).collect()
    assert all((r.train_tokens, r.n_known, r.held_out) == (0, 0, r.doc_id is not None) and np.isfinite(r.score) for r in got)
    assert all(r.base_score == 0 for r in got)  # log10(1 / (0 + 0 + 1)) a token


def chained(rng, n):
    """A text in which each word all but tells the next one."""
    out = [rng.randrange(60)]
    while len(out) < n:
        out.append((7 * out[-1] + 3) % 60 if rng.random() < 0.9 else rng.randrange(60))
    return " ".join(f"w{k}" for k in out)


def test_op6_learns_context_and_does_not_depend_on_the_layout(spark):
    rng = random.Random(6)
    texts = spark.createDataFrame([(i, chained(rng, 300)) for i in range(400)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        one = {r.doc_id: r for r in maxent_lm.score_documents(texts.repartition(3)).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        two = {r.doc_id: r for r in maxent_lm.score_documents(texts.repartition(5).orderBy("text")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    held = [r for r in one.values() if r.held_out]
    score, base = (sum(getattr(r, k) for r in held) / sum(r.n_tokens for r in held) for k in ("score", "base_score"))
    assert score > base + 0.4
    assert all(two[i].score == pytest.approx(r.score, abs=1e-4) for i, r in one.items())


def test_op6_probabilities_equal_a_plain_softmax_and_sum_to_one():
    rng = np.random.default_rng(3)
    n_rows, width = 64, maxent_lm.WIDTH
    words = rng.integers(-(2**62), 2**62, 150)
    counts = rng.integers(1, 50, 150)
    form = rng.integers(0, maxent_lm.FORMS, 150)
    frequent = maxent_lm.Frequent(words, counts)
    outside = frequent.find(words)[1] < 0
    assert not outside.any()
    frequent.code[frequent.code >= 100] = -1  # some words outside the vocabulary
    code = frequent.find(words)[1]
    buckets = np.ones((maxent_lm.FORMS, width))
    np.add.at(buckets, (form[code < 0], maxent_lm.bucket_of(words[code < 0])), counts[code < 0] + 1)
    w = maxent_lm.initial_weights(frequent.vocabulary_counts[:100], buckets, n_rows)
    w += np.where(w > -29, rng.normal(0, 0.5, w.shape), 0).astype(np.float32)

    def place(k):
        return (code[k] // width, code[k] % width) if code[k] >= 0 else (width - maxent_lm.FORMS + form[k], int(maxent_lm.bucket_of(words[k : k + 1])[0]))

    history = rng.integers(0, 150, 3)
    total = 0.0
    for k in range(150):
        own = np.array([*history, k])
        at = maxent_lm.Places(words[own], form[own], code[own], np.array([0, 4]), n_rows)
        p = 10 ** maxent_lm.log_probabilities(w, at)[3]
        rows, (c, q) = at.class_rows(slice(3, 4))[0], place(k)
        x = np.exp(w[rows].sum(0))
        y = np.exp(w[at.word_rows(slice(3, 4))[0]].sum(0))
        assert p == pytest.approx(x[c] / x.sum() * y[q] / y.sum(), rel=1e-4)
        total += p if code[k] >= 0 else p * (counts[k] + 1) / buckets[form[k], q]
    # the rest is what words never seen have: one share of each bucket
    at = maxent_lm.Places(words[np.array([*history, 0])], form[np.array([*history, 0])], code[np.array([*history, 0])], np.array([0, 4]), n_rows)
    x = np.exp(w[at.class_rows(slice(3, 4))[0]].sum(0))
    x /= x.sum()
    for f in range(maxent_lm.FORMS):
        at.classes[3] = width - maxent_lm.FORMS + f
        y = np.exp(w[at.word_rows(slice(3, 4))[0]].sum(0))
        total += (x[width - maxent_lm.FORMS + f] * y / y.sum() / buckets[f]).sum()
    free = [k for k in range(100, maxent_lm.VOCABULARY)]  # places without a word
    assert free and total == pytest.approx(1.0, abs=1e-4)


def test_op7_collapse_equals_brute_force(spark):
    rng = random.Random(3)
    talks = {}
    for c in range(60):
        base = [(rng.choice(["user", "assistant"]), rng.choice("abc")) for _ in range(rng.randint(1, 5))]
        if talks and rng.random() < 0.6:
            other = talks[rng.choice(list(talks))]
            base = other[: rng.randint(1, len(other))] + (base if rng.random() < 0.5 else [])
        talks[c] = base
    rows = [(c, t, r, x) for c, turns in talks.items() for t, (r, x) in enumerate(turns)]
    rows += rows[:7] + [(None, 0, "user", "lost")]
    got = chat_snapshots.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    keep = {}
    for c, turns in talks.items():
        if not any(len(o) > len(turns) and o[: len(turns)] == turns for o in talks.values()):
            keep.setdefault(tuple(turns), []).append(c)
    want = {min(v): (len(k), len(v), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in k)) for k, v in keep.items()}
    assert {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in got} == want


def test_op8_finds_edited_passages_and_leaves_clean_texts(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [text(40) for _ in range(20)] + [None, "short"]
    edited = list(items[3])
    for k in range(30, 200, 40):
        edited[k] = "z"
    texts = [text(100), f"{text(80)} {items[2]} {text(30)}", f"{text(10)} {''.join(edited)}", None, "", f"{text(50)} {items[5].upper()}!"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in qgram_decontamination.contamination(odd(spark, texts), bench).collect()}
    assert got == {0: [], 1: [2], 2: [3], 3: [], 4: [], 5: [5]}
    clean = qgram_decontamination.keep_clean(odd(spark, texts), bench)
    assert clean.columns == odd(spark, texts).columns and sorted(r.doc_id for r in clean.collect()) == [0, 3, 4]
    assert qgram_decontamination.contamination(odd(spark, texts), bench.limit(0)).where("contaminated").count() == 0


def least_edits(text, fragment):
    """The least edit distance between ``fragment`` and any stretch of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(fragment, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_op8_equals_alignment_of_all_windows():
    rng = random.Random(11)
    q, f, step = qgram_decontamination.Q, qgram_decontamination.FRAGMENT, qgram_decontamination.STRIDE
    line = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))

    def edited(t, k):
        t = list(t)
        for _ in range(k):
            at = rng.randrange(len(t))
            t[at : at + 1] = rng.choice([[], [rng.choice("xyz")], [t[at], rng.choice("xyz")]])
        return "".join(t)

    items = [line(n) for n in (7, 8, 12, 13, 14, 15, 16, 17, 24, 25, 31, 40, 66, 80, 81, 100, 130, 205)]
    texts = []
    for t in items:
        for k in (0, 1, 2, 3, 5, 6, 7, 8, 12):
            at = rng.randrange(max(1, len(t) - 90))
            texts.append(line(rng.randrange(60)) + edited(t[at:] if rng.random() < 0.5 else t, k) + line(rng.randrange(60)))
    got = qgram_decontamination.find(qgram_decontamination.build(list(enumerate(items))), pa.array(texts))
    total = 0
    for text, found in zip(texts, got, strict=True):
        want = set()
        for k, t in enumerate(items):
            starts = {*range(0, max(1, len(t) - f + 1), step), max(0, len(t) - f)}
            parts = [t[s : s + f] for s in starts] if len(t) >= q else []
            if any(least_edits(text, p) <= int(qgram_decontamination.budget(np.array([len(p)]))[0]) for p in parts):
                want.add(k)
        assert found == want
        total += len(want)
    assert total > 60


def test_op8_partial_quotes_blocks_and_odd_rows(spark, monkeypatch):
    rng = random.Random(12)
    line = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))
    items = [line(60) for _ in range(12)]
    texts = []
    for t in items:
        at = rng.randrange(len(t) - 100)
        texts.append(f"{line(30)}! {t[at : at + 99]} {line(30)}")
    texts += [line(200_000), None, line(90_000) + " " + items[3] + line(10), *([texts[2]] * 3)]
    bench = spark.createDataFrame([*enumerate(items), (None, items[0]), (50, None), (51, ""), (2, items[2]), (52, items[2])], "item_id long, text string")
    want = {i: [i] for i in range(12)} | {2: [2, 52], 12: [], 13: [], 14: [3]} | {k: [2, 52] for k in (15, 16, 17)}
    for chars in (4_000_000, 1500):
        monkeypatch.setattr(qgram_decontamination, "BLOCK_CHARS", chars)
        got = {r.doc_id: r for r in qgram_decontamination.contamination(odd(spark, texts), bench).collect()}
        assert {i: r.item_ids for i, r in got.items()} == want
        clean = qgram_decontamination.keep_clean(odd(spark, texts), bench)
        assert clean.columns == odd(spark, texts).columns and sorted(r.doc_id for r in clean.collect()) == [12, 13]
        assert qgram_decontamination.contamination(odd(spark, []), bench).count() == 0


def test_op8_pieces_and_small_indexes_change_nothing(monkeypatch):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    line = lambda n: " ".join(rng.choice(words[: rng.randint(2, 40)]) for _ in range(n))
    items = list(enumerate([line(rng.randint(3, 90)) for _ in range(40)] + ["ab " * 100]))
    texts = pa.array([line(400) + items[k % 41][1] + line(50) for k in range(60)] + [line(30_000)])
    want = qgram_decontamination.find(qgram_decontamination.build(items), texts)
    assert sum(map(len, want)) > 60
    for postings, at_once in ((1, 16_384), (500, 7), (1 << 20, 3)):
        monkeypatch.setattr(qgram_decontamination, "POSTINGS", postings)
        monkeypatch.setattr(qgram_decontamination, "AT_ONCE", at_once)
        assert qgram_decontamination.find(qgram_decontamination.build(items), texts) == want


def test_op8_equal_rows_and_one_long_item(spark, monkeypatch):
    rng = random.Random(22)
    line = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))
    same, long = line(60), line(20_000)
    bench = spark.createDataFrame([(k, same) for k in range(3000)] + [(9000, long)], "item_id long, text string")
    texts = [f"{line(20)} {same} {line(20)}", f"{line(20)} {long[70_000:70_120]} {line(20)}", line(300)]
    for chars in (8_000_000, 50_000):
        monkeypatch.setattr(qgram_decontamination, "BLOCK_CHARS", chars)
        got = {r.doc_id: r for r in qgram_decontamination.contamination(odd(spark, texts), bench).collect()}
        assert got[0].item_ids == list(range(3000)) and got[1].item_ids == [9000] and not got[2].contaminated


def plain_ppm(grams, text):
    """Bits of ``text`` by dictionaries of counts: the longest context that has seen a byte, an escape for each longer one."""
    bits, padded = 0.0, b" " * ppm_language.ORDER + text
    for at in range(ppm_language.ORDER, len(padded)):
        for k in range(ppm_language.ORDER, -2, -1):
            if k < 0:
                bits += 8
                break
            context, byte = padded[at - k : at], padded[at]
            seen = {g[-1]: n for g, n in grams[k + 1].items() if g[:-1] == context}
            if not seen:
                continue
            if byte in seen:
                bits += np.log2((sum(seen.values()) + len(seen)) / seen[byte])
                break
            bits += np.log2((sum(seen.values()) + len(seen)) / len(seen))
    return bits


def test_op9_code_lengths_equal_a_plain_model():
    rng = random.Random(13)
    learn = {"aa": ["banana bandana", "anna and nan"], "bb": ["hello yellow", "low owl ell"], "cc": ["xyzzy"]}
    grams, counts = {}, {}
    for lang, lines in learn.items():
        g, bounds = ppm_language.normal_grams(*textcodes.column_bytes(pa.array(lines)))
        grams[lang] = {k: {} for k in range(1, 5)}
        for x in g.tolist():
            raw = x.to_bytes(4, "big")
            for k in range(1, 5):
                grams[lang][k][raw[-k:]] = grams[lang][k].get(raw[-k:], 0) + 1
        counts[lang] = {
            k: (np.array([int.from_bytes(b, "big") for b in d], np.uint32), np.array(list(d.values()), float)) for k, d in grams[lang].items()
        }
    trees = ppm_language.ContextTrees(counts)
    texts = ["banana", "yellow banana", "zzz", *("".join(rng.choice("abnelowyz ") for _ in range(12)).strip() for _ in range(20))]
    texts = [" ".join(t.split()) or "a" for t in texts]
    bits = trees.bits(*ppm_language.normal_grams(*textcodes.column_bytes(pa.array(texts))))
    for i, t in enumerate(texts):
        for j, lang in enumerate(trees.languages):
            assert bits[i, j] == pytest.approx(plain_ppm(grams[lang], t.encode()), rel=1e-5)


def test_op9_keeps_every_language_within_its_bound(spark, docs, monkeypatch):
    monkeypatch.setattr(ppm_language, "nodes_per_language", lambda n: 300)
    trees = ppm_language.train(docs)
    langs = {r.lang for r in docs.select("lang").distinct().collect() if r.lang}
    assert set(trees.languages) == langs
    got = {r.doc_id: r.lang_pred for r in ppm_language.identify(docs).collect()}
    rows = [(got[r.doc_id], r.lang) for r in docs.where("lang IS NOT NULL").collect()]
    assert sum(a == b for a, b in rows) / len(rows) > 0.9
    assert ppm_language.identify(odd(spark, [])).count() == 0
    none = docs.limit(5).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in ppm_language.identify(none).collect()} == {"und"}


def test_op9_accuracy_and_odd_rows(spark, docs):
    got = {r.doc_id: r for r in ppm_language.identify(docs).collect()}
    held = [(got[r.doc_id].lang_pred, r.lang) for r in docs.select("doc_id", "lang").collect() if got[r.doc_id].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    few = {r.doc_id: r for r in ppm_language.identify(odd(spark, [*ODD, "12 34 !"])).collect()}
    assert all(few[i].lang_pred == "und" and few[i].score == 0 for i in (0, 1, 2, 10)) and few[6].lang_pred == "en"
    assert ppm_language.keep_identified(odd(spark, [])).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.integers(2, 10**9), st.integers(0, 10**9))
def test_op10_permutes_each_format(size, value):
    f = feistel_pii.Feistel(b"key")
    value %= size
    there = f.permute("k", size, value)
    assert 0 <= there < size and f.permute("k", size, there, inverse=True) == value


def test_op10_values_keep_their_format_and_links(spark):
    p = feistel_pii.Pseudonyms(b"key")
    new, n = p.text("Mail ann.lee@site.org, card 4111 1111 1111 1111, on 1999-12-31, again 4111 1111 1111 1111; ip 10.0.0.1 ssn 123-45-6789 not 1.2.3 or 999-99-9999x")
    assert n == 6 and "ann.lee" not in new and "4111 1111" not in new and "999-99-9999" in new
    cards = re.findall(r"(?:\d{4} ){3}\d{4}", new)
    assert cards[0] == cards[1] and feistel_pii.luhn_digit(cards[0].replace(" ", "")[:-1]) == cards[0][-1]
    got = feistel_pii.pseudonymise(odd(spark, ODD), b"key", "hits").collect()
    assert [r.text for r in got[:6]] == ODD[:6] and got[0].hits == 0 and len(got) == len(ODD)


def test_op10_finds_what_a_plain_search_finds():
    """Values of each format, valid and not, between words: all valid ones change, keep their format and their checks; nothing else does."""
    p = feistel_pii.Pseudonyms(b"key")
    rng = random.Random(15)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(valid):
        body = "4" + digits(14)
        last = int(feistel_pii.luhn_digit(body))
        return body + str(last if valid else (last + 1) % 10)

    def iban(valid):
        body = "DE00" + digits(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97
        return f"DE{check if valid else check % 96 + 1:02d}" + body[4:]

    made = {
        "card": lambda v: card(v),
        "iban": lambda v: iban(v),
        "iso": lambda v: f"{rng.randrange(1900, 2100)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29) if v else 39:02d}",
        "ip": lambda v: ".".join(str(rng.randrange(1, 250)) for _ in range(3)) + (".7" if v else ".777"),
        "ssn": lambda v: f"{rng.randrange(1, 600) if v else 999:03d}-{rng.randrange(1, 99):02d}-{rng.randrange(1, 9999):04d}",
        "email": lambda v: f"ann{digits(3)}@site.org" if v else f"ann{digits(3)} at site.org",
        "aws": lambda v: ("AKIA" if v else "AKIB") + "".join(rng.choice("ABCDEFGHJK234567") for _ in range(16)),
    }
    shape = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", re.sub(r"\d+(\.\d+){3}", "1.1.1.1", t))))
    for _ in range(300):
        parts = [(kind, rng.random() < 0.6) for kind in rng.choices(list(made), k=5)]
        values = [made[kind](ok) for kind, ok in parts]
        text = "; ".join(f"word {v} more" for v in values)
        new, n = p.text(text)
        assert n == sum(ok for _, ok in parts) and shape(new) == shape(text), (text, new)
        for (kind, ok), old, now in zip(parts, values, [x[5:-5] for x in new.split("; ")], strict=True):
            assert ok or old == now, (kind, old, now)
            if kind == "card" and ok:
                assert feistel_pii.luhn_digit(now[:-1]) == now[-1]
            if kind == "iban" and ok:
                assert feistel_pii.iban_valid(now)
        assert p.text(text)[0] == new


def test_op10_odd_tables(spark):
    assert feistel_pii.pseudonymise(odd(spark, []), b"key", "hits").count() == 0
    with pytest.raises(ValueError):
        feistel_pii.pseudonymise(odd(spark, ODD), b"")
    clash = feistel_pii.pseudonymise(odd(spark, ["on 1999-12-31", None]), b"key", "n")
    assert clash.columns.count("n") == 1 and [r.n for r in clash.orderBy("doc_id").collect()] == [1, 0]
    twice = feistel_pii.pseudonymise(odd(spark, ["on 1999-12-31"] * 3), b"key").collect()
    assert len({r.text for r in twice}) == 1 and twice[0].text != "on 1999-12-31"


def test_op10_cards_and_phones_beside_numbers():
    p = feistel_pii.Pseudonyms(b"key")
    for card in ("4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111", "3782 822463 10005"):
        for after in (" 12/27", " 123", "-7", " 12 27", " 1234"):
            for before in ("", "card ", "no 5, "):
                new, n = p.text(f"{before}{card}{after}")
                head = new[len(before) : len(before) + len(card)]
                assert n == 1 and head != card and new[len(before) + len(card) :] == after, (card, after, new)
                assert feistel_pii.luhn_digit(re.sub(r"\D", "", head)[:-1]) == head[-1]
    for phone in ("+49 30 1234567", "+44 7911 123456", "+91 98765 43210", "+1 (415) 555-0132", "+353 1 4960123"):
        for after in ("", " 12 items", ", 2024", " 123456789"):
            new, n = p.text(f"call {phone}{after}")
            assert n == 1 and phone not in new and re.sub(r"\d", "9", new) == re.sub(r"\d", "9", f"call {phone}{after}"), (phone, after, new)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.text("0123456789abcdefXYZ+/", min_size=1, max_size=4), st.integers(1, 10**5))
def test_op10_secrets_of_any_length(seed, alphabet, length):
    p = feistel_pii.Pseudonyms(b"key")
    draw = random.Random(seed)
    value = "".join(draw.choice(alphabet) for _ in range(8 + length))
    other = value[:-1] + draw.choice(alphabet)
    one, two = p.characters("secret", value), p.characters("secret", other)
    assert len(one) == len(value) and (one == two) == (value == other)
    assert feistel_pii._secret_kind(one) == feistel_pii._secret_kind(value)
    assert re.sub("[0-9a-z]", "9", one) == re.sub("[0-9a-z]", "9", one) and [c.isupper() for c in one] == [c.isupper() for c in value]
    assert all(a == b for a, b in zip(value, one, strict=True) if a in "+/")


def test_op10_kinds_of_secrets_do_not_meet():
    """Over a whole small set: hexadecimal, digits and others keep apart, and no two values get one pseudonym."""
    p = feistel_pii.Pseudonyms(b"key")
    values = ["".join(x) for x in itertools.product("019afgz", repeat=4)]
    new = [p.characters("secret", v) for v in values]
    assert len(set(new)) == len(values)
    assert [feistel_pii._secret_kind(v) for v in values] == [feistel_pii._secret_kind(v) for v in new]
    # a set that the permutation maps onto itself: every digit and every hexadecimal text of one length
    for chars, n in (("0123456789", 3), ("0123456789abcdef", 2)):
        own = {"".join(x) for x in itertools.product(chars, repeat=n)}
        assert {p.characters("secret", v) for v in own} == own


def test_op10_long_values_and_runs_take_linear_time():
    p = feistel_pii.Pseudonyms(b"key")
    for text in ("token=" + "aB3" * 350_000, "secret: " + "7" * 1_000_000, "1 " * 500_000, "1" * 1_000_000, "+1 2 " * 200_000, "4111 1111 1111 1111 " * 20_000):
        began = time.process_time()
        new, n = p.text(text)
        assert time.process_time() - began < 4 and len(new) == len(text)
        assert n == (1 if "=" in text or ":" in text else n) and (n > 0 or new == text)


def test_op10_cards_as_a_plain_search_finds_them():
    draw = random.Random(5)
    for _ in range(400):
        text = "".join(draw.choice(["1", "4", "7", "0", "9", "22", " ", " ", "-", "x", ", "]) for _ in range(draw.randint(10, 60)))
        want, at = [], 0
        for i in range(len(text)):
            if not text[i].isdigit() or (i and text[i - 1].isdigit()):
                continue
            for size in range(19, 12, -1):
                m = re.compile(r"[0-9](?:[ -]?[0-9]){%d}(?![0-9])" % (size - 1)).match(text, i)
                own = m and re.sub("[ -]", "", m[0])
                if m and feistel_pii.luhn_digit(own[:-1]) == own[-1]:
                    want.append(m.span())
                    break
        assert list(zip(*feistel_pii.card_spans(text), strict=True)) == want, text


def test_op10_needs_a_key(spark):
    assert feistel_pii.session_key(spark) == b"" and feistel_pii.session_key(spark, b"own") == b"own"


def test_op6_keeps_frequent_words_within_their_bound(spark, monkeypatch):
    monkeypatch.setattr(maxent_lm, "FREQUENT", 50)
    end = int(maxent_lm._END)
    rows = [(k, 10**6 + k * 1000) for k in range(1000, 1400)] + [(k, 7) for k in range(2000, 2030)] + [(end, 3)]
    counts = spark.createDataFrame(rows, "h long, c long")
    kept = {r.h for r in maxent_lm.frequent_words(counts).collect()}
    assert end in kept and 40 <= len(kept) <= 51 and all(k >= 1350 for k in kept - {end})
    same = spark.createDataFrame([(k, 10**9) for k in range(100)] + [(end, 3)], "h long, c long")
    assert {r.h for r in maxent_lm.frequent_words(same).collect()} == {end}
    few = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(end, 3)], "h long, c long")
    assert maxent_lm.frequent_words(few).count() == 41


def test_op7_odd_turns(spark):
    kinds = "conv_id long, turn long, role string, text string, pos long, block long, a string"
    long = [(1, k, "user", f"t{k}", 0, 0, "") for k in range(600)]
    rows = long + [(2, *r[1:]) for r in long[:300]] + [(3, None, None, None, 1, 1, "x"), (3, 1, "user", "hi", 1, 1, "x"), (3, 1, "user", "hi", 1, 1, "x")]
    got = {(r.conv_id, r.segment): r for r in chat_snapshots.render(spark.createDataFrame(rows, kinds)).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (3, 0)} and got[1, 0].n_turns == 600
    whole = "".join(got[1, k].rendered for k in range(3))
    assert whole == "".join(f"<|im_start|>user\nt{k}<|im_end|>\n" for k in range(600))
    assert got[3, 0].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>unknown\n<|im_end|>\n"
    assert chat_snapshots.render(spark.createDataFrame([], kinds)).count() == 0


def test_pipeline_on_an_empty_table(spark, tmp_path, docs):
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages_take_effect(spark, docs):
    rows = docs.columns
    at = docs.unionByName(spark.createDataFrame([(900_000, "12 34", "en", "s", 5), (900_001, None, None, None, None)], docs.schema))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SF)
        assert at.columns == rows, name
    kept = {r.doc_id for r in at.select("doc_id").collect()}
    assert not kept & {900_000, 900_001} and len(kept) > 100
    out = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in out.collect()} == kept and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_pipeline_equals_plain_stages(spark, tmp_path):
    """All stages one after another by brute force, on rows that repeat, lack ids, languages and texts, and have extra columns of clashing names."""
    rng = random.Random(31)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [line(18) for _ in range(4)]
    made = [line(rng.randint(1, 45)) for _ in range(24)]
    made += [f"{made[0]} end", made[1], made[2].replace(" ", "  ", 1), f"{line(9)} {items[1]} {line(5)}", items[2].upper(), items[3][:60]]
    made += [f"{line(8)} card 4111 1111 1111 1111 mail a.b@site.org", f"{line(8)} card 4111 1111 1111 1111", "12 34 !", "", None, f"token={'aB3' * 100} {line(7)}", f"{line(12)} on 1999-12-31"]
    rows = [(i, t, None if i % 5 == 4 else "en" if i % 2 else "de", None, None, "f", "n", "r", 7) for i, t in enumerate(made)]
    rows += [rows[5], rows[5], (None, line(20), "en", None, None, "f", "n", "r", 7)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    left = [r[:2] for r in rows if r[1] and re.search("[A-Za-z]", r[1])]
    codes, bounds = order_minhash.labelled(pa.array([t for _, t in left]))
    own = [codes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    root = list(range(len(left)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(left)):
        for b in range(a):
            if left[a][1] == left[b][1] or order_minhash.aligned(own[a], own[b]) >= 0.8:
                root[find(a)] = find(b)
    groups = {}
    for k, row in enumerate(left):
        groups.setdefault(find(k), []).append(row)
    left = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    assert len(left) < 33
    reduced = lambda t: re.sub("[^a-z0-9]+", " ", t.lower())
    f, step = qgram_decontamination.FRAGMENT, qgram_decontamination.STRIDE

    def dirty(t):
        for item in map(reduced, items):
            starts = {*range(0, max(1, len(item) - f + 1), step), max(0, len(item) - f)}
            for part in (item[s : s + f] for s in starts):
                if least_edits(reduced(t), part) <= int(qgram_decontamination.budget(np.array([len(part)]))[0]):
                    return True
        return False

    clean = [r for r in left if not dirty(r[1])]
    assert len(left) - len(clean) == 2
    p = feistel_pii.Pseudonyms(feistel_pii.session_key(spark, b"siftwell demonstration key"))
    want = []
    for i, t in clean:
        ids = encoding().encode_ordinary(p.text(t)[0])
        raw = np.array(ids, "<u4").tobytes()
        want.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(p.text(t)[0].encode()).hexdigest()))
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
