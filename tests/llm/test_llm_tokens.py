import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from nichesearch.llm import common, rans, token_counts, token_files, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = tokens.encoder(PATH)


def ids(texts):
    return [x.ids for x in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é'sx1 \n\t\r.,#<|>ß²  日Ł_-×÷"), max_size=40), max_size=8))
def test_chunks_give_the_librarys_ids(texts):
    found, counts = ENCODER.encode(texts)
    want = ids(texts)
    assert list(counts) == list(map(len, want)) == list(ENCODER.count(texts))
    assert list(found) == [i for x in want for i in x]


def test_long_texts_special_strings_and_a_full_cache(corpus, monkeypatch):
    texts = [r[1] or "" for r in corpus] + ["<|endoftext|> a", "x" * 3000, "ab cd\n" * 400_000]
    monkeypatch.setattr(tokens, "MAX_CHUNKS", 300)
    found, counts = tokens.Encoder(PATH).encode(texts)
    assert list(counts) == list(map(len, want := ids(texts))) and list(found) == [i for x in want for i in x]


def morse(a, b, n):
    """Of any two letters, a string and its complement: they collide under every polynomial hash modulo 2^64."""
    x, y = a, b
    while len(x) < n:
        x, y = x + y, y + x
    return x, y


@pytest.mark.parametrize("long", [64, 5000])
@pytest.mark.parametrize("bits", [64, 4])
def test_strings_that_share_a_hash(monkeypatch, long, bits):
    monkeypatch.setattr(tokens, "LONG", long)
    whole = tokens.Encoder._hashed
    monkeypatch.setattr(tokens.Encoder, "_hashed", lambda self, *a: whole(self, *a) >> np.uint64(64 - bits) << np.uint64(64 - bits) | np.uint64(1))
    pairs = [morse(a, b, n) for a, b in ("ab", "01", "zq", "x7") for n in (64, 256, 1024, 2048, 4096)]
    for order in (0, 1):
        texts = [f"{p[order]} {p[1 - order]} {p[order]}" for p in pairs] + [q for p in pairs for q in p]
        encoder = tokens.Encoder(PATH)
        for _ in range(2):
            found, counts = encoder.encode(texts)
            want = ids(texts)
            assert list(counts) == list(map(len, want)) == list(encoder.count(texts)) and list(found) == [i for x in want for i in x]


def test_a_workers_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_CHUNKS", 4000)
    monkeypatch.setattr(tokens, "MAX_BYTES", 60_000)
    encoder = tokens.Encoder(PATH)
    rng = np.random.default_rng(1)
    for _ in range(20):
        texts = [" ".join(map(str, rng.zipf(1.3, 400) % 10**9)) for _ in range(4)]
        assert list(encoder.encode(texts)[0]) == [i for x in ids(texts) for i in x]
        assert encoder.table.n <= 4000 and 8 * encoder.chunks.used + 4 * encoder.ids.used < 4 * 60_000


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_go_to_their_library(name):
    encoder = tokens.encoder(public_tokenizers.path(name))
    texts = ["Hello world, this is it", "", "é 日本"]
    found, counts = encoder.encode(texts)
    library = encoder.library
    want = [library.encode(t) if name.endswith("model") else library.encode(t, add_special_tokens=False).ids for t in texts]
    assert list(found) == [i for x in want for i in x] and list(encoder.count(texts)) == list(map(len, want))


def test_counts_by_cache(spark, docs, corpus, nothing, monkeypatch):
    cache = common.shared_path(spark, "test-cache")
    want = sorted(((r[0] is None, r[0] or 0), len((r[1] or "").encode()), n, n > 1024) for r, n in zip(corpus, map(len, ids([r[1] for r in corpus])), strict=True))

    def counted(df):
        return sorted(((r.doc_id is None, r.doc_id or 0), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count(df, cache, PATH).collect())

    assert counted(docs.limit(20)) == counted(docs.limit(20))
    first = spark.read.parquet(cache).count()
    assert first <= 20
    assert counted(docs) == want
    assert spark.read.parquet(cache).count() == len({r[1] or "" for r in corpus})
    monkeypatch.setattr(token_counts, "BROADCAST_DIGESTS", 0)
    assert counted(docs) == want and counted(nothing) == []
    assert spark.read.parquet(cache).count() == len({r[1] or "" for r in corpus})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=3000), st.lists(st.integers(0, 300), max_size=50))
def test_rans_round_trip(symbols, others):
    counts = np.bincount(symbols + others, minlength=301)
    freq, bits = rans.quantised(counts)
    if not counts.any():
        return
    assert freq.sum() == 1 << bits and ((freq > 0) == (counts > 0)).all()
    coder = rans.Coder(freq, bits)
    states, words, marks = coder.encode(np.array(symbols, np.uint32))
    assert list(coder.decode(states, words, len(symbols), marks)) == symbols


def test_decoding_begins_at_any_checkpoint(monkeypatch):
    monkeypatch.setattr(rans, "STEPS", 4)
    symbols = np.random.default_rng(2).zipf(1.5, 5000).clip(max=300).astype(np.uint32)
    coder = rans.Coder(*rans.quantised(np.bincount(symbols)))
    states, words, marks = coder.encode(symbols)
    assert len(marks) == 8 * (len(states) // 8 + 1) * ((-(-5000 // (len(states) // 8)) - 1) // 4)
    for a, z in ((0, 5000), (0, 1), (311, 312), (312, 624), (1000, 4999), (4999, 5000), (2500, 2500)):
        assert (coder.decode(states, words, 5000, marks, a, z) == symbols[a:z]).all()
        assert (coder.decode(states, words, 5000, b"", a, z) == symbols[a:z]).all()


def test_files_round_trip_in_order(spark, docs, corpus, nothing, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 500)
    folder = common.shared_path(spark, "test-files")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write(docs, folder, PATH)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(f"{folder}/blocks").count() > 5
    got = sorted(token_files.read(spark, folder).collect(), key=lambda r: r.start)
    texts = {}
    for r in corpus:
        texts.setdefault(r[0], []).append(r[1])
    order = sorted(corpus, key=lambda r: -1 if r[0] is None else r[0])
    assert [r.doc_id for r in got] == [r[0] for r in order]
    want = [[*x, 2] for x in ids([texts[r.doc_id][0] for r in got])]
    assert [list(r.ids) for r in got] == want
    assert [r.start for r in got] == list(np.cumsum([0, *map(len, want)])[:-1])
    digests = sorted(token_files.read(spark, folder, digests=True).collect(), key=lambda r: r.start)
    assert [r.ids_crc32 for r in digests] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in want]
    every = [i for x in want for i in x]
    for a, z in ((0, 10), (777, 1500), (len(every) - 3, len(every))):
        part = sorted(token_files.between(spark, folder, a, z).collect())
        assert part[0].place == a and [i for r in part for i in r.ids] == every[a:z]
    files = sorted(f for f in os.listdir(folder + "/blocks") if f.startswith("part-"))
    held = [d for f in files for b in pq.read_table(f"{folder}/blocks/{f}").column("doc_ids").to_pylist() for d in b]
    assert len(files) > 1 and held == [r[0] for r in order]
    empty = common.shared_path(spark, "test-files")
    token_files.write(nothing, empty, PATH)
    assert token_files.read(spark, empty).collect() == []


def test_a_damaged_block_is_noticed():
    counts = np.bincount([1, 2, 3] * 500)
    coder = rans.Coder(*rans.quantised(counts))
    states, words, marks = coder.encode(np.array([1, 2, 3] * 500, np.uint32))
    r = {"part": 0, "first": 0, "doc_ids": [1], "counts": [1500], "states": states, "words": words, "marks": marks}
    assert token_files._crc(r) != token_files._crc(r | {"words": bytes([words[0] ^ 1]) + words[1:]})
    with pytest.raises((ValueError, IndexError)):
        coder.decode(states, words + b"\0\0\0\0", 1500)
