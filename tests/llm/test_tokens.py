"""Tokens, wavelet shards, the transducer and packing against the tokenizers library and plain Python."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from sightledger.llm import base as B, bpe, packing, tokens as T, wavelet

HARD = [None, "", "a", " a", "a ", "  a  b   c", "a\n b", "a \n\n b\n", "\n\n", "x\t\ty", "don't I'll 's 's", "a, b. c! d;e: f?",
        "é. à, ü!", "a b", "a b", "x<|endoftext|>y <| z", "1,234.5 6.", "日本語 です。", "a\r\nb", "\x1ca\x1f b", "😀 😀.",
        " ,", ". .", "a. .b", "foo...", "a,\n", "(a), b.", "　a", "w" * 3000, "ab" * 500 + " " + "é" * 300, "same text", "same text"]
SCHEMA = "doc_id long, text string, start long, ids string"


@pytest.fixture(scope="module")
def tokenizer():
    return T.load_tokenizer(T.vocabulary_path())


def rows(texts):
    return [(i * 3, t, -1, "clash") for i, t in enumerate(texts)]


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def encoded(encode, texts):
    data, offsets = B.utf8(pa.array(texts, pa.string()))
    flat, edge = encode(data, offsets)
    return [flat[a:b].tolist() for a, b in zip(edge[:-1], edge[1:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab .,'\n\t é日1<|s"), max_size=30), min_size=1, max_size=5))
def test_pieces_equal_the_library(texts):
    global _E
    if "_E" not in globals():
        _E = (T.Encoder(T.vocabulary_path()), bpe.Vocabulary(T.vocabulary_path()), bpe._pattern())
    want = [ids_of(_E[0].tokenizer, t) for t in texts]
    assert encoded(_E[0].encode, texts) == want


def test_vectorised_merges_equal_the_library(tokenizer, tmp_path):
    vocabulary = bpe.Vocabulary(T.vocabulary_path())
    words = sorted({w.encode() for w in " the of and ing tion antidisestablishment xyzzy é日本 aaaaaaa".split(" ")} - {b""})
    path = tmp_path / "lexicon.mat"
    path.write_bytes(bpe.compile_lexicon(words[::2], vocabulary.merge(words[::2])) if len(words) > 1 else b"")
    coder = bpe.Coder(vocabulary, bpe._pattern(), bpe.Lexicon(str(path)))
    texts = [t or "" for t in HARD] + ["the of ing xyzzy tionx th"]
    assert encoded(coder.block, texts) == [ids_of(tokenizer, t) for t in texts]
    long_ = ("abcdefghij" * 300).encode()
    assert list(vocabulary._merge_long(long_)) == ids_of(tokenizer, long_.decode())


def test_automaton_is_minimal_and_numbers_words(tmp_path):
    words = sorted(a + b for a in (b"re", b"un", b"") for b in (b"do", b"doing", b"done", b"make", b"making"))
    path = tmp_path / "lexicon.mat"
    path.write_bytes(bpe.compile_lexicon(words, [(i,) for i in range(len(words))]))
    lexicon = bpe.Lexicon(str(path))
    assert len(lexicon.finals) < len(set(w[:k] for w in words for k in range(len(w) + 1)))  # fewer states than a trie
    probe = words + [b"redo!", b"r", b"", b"zzz"]
    ends = np.cumsum([len(w) for w in probe])
    starts = np.append(0, ends[:-1])
    got = lexicon.number(np.frombuffer(b"".join(probe), np.uint8), starts, ends)
    assert got.tolist() == [*range(len(words)), -1, -1, -1, -1]


def test_empty_lexicon(tmp_path):
    path = tmp_path / "lexicon.mat"
    path.write_bytes(bpe.compile_lexicon([], []))
    assert bpe.Lexicon(str(path)).number(np.frombuffer(b"ab", np.uint8), np.array([0]), np.array([2])).tolist() == [-1]


def test_encode_decode(spark, tokenizer):
    docs = spark.createDataFrame(rows(HARD), SCHEMA)
    got = {r.doc_id: r for r in bpe.encode_decode(docs).collect()}
    digest = {r.doc_id: r for r in bpe.digests(docs).collect()}
    for doc, text, *_ in rows(HARD):
        ids = ids_of(tokenizer, text)
        assert got[doc].ids == ids and got[doc].decoded == tokenizer.decode(ids, skip_special_tokens=False) == (text or "")
        assert digest[doc].n_tokens == len(ids)
        assert digest[doc].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digest[doc].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.digests(docs.limit(0)).count() == 0


def test_wavelet_access_count_occurrence():
    rng = np.random.default_rng(3)
    for n in (1, 63, 64, 65, 511, 512, 1300):
        ids = rng.choice([0, 1, 5, 40000, 50256, 65535], n).astype(np.uint16)
        shard = wavelet.Wavelet(wavelet.build(ids, np.array([0, n])))
        assert shard.decode().tolist() == ids.tolist()
        assert [shard.access(i) for i in range(0, n, 7)] == ids[::7].tolist()
        for token in (0, 5, 50256, 65535, 77):
            places = np.flatnonzero(ids == token)
            assert shard.count(token) == len(places) and shard.count(token, n // 3, n // 2) == (ids[n // 3:n // 2] == token).sum()
            assert [shard.occurrence(token, k) for k in range(len(places))] == places.tolist()
            with pytest.raises(IndexError):
                shard.occurrence(token, len(places))


def test_wavelet_shards_round_trip(spark, tokenizer, tmp_path):
    docs = spark.createDataFrame(rows(HARD) + [(None, "no id", 0, ""), (6, "again", 0, "")], SCHEMA)
    path = str(tmp_path / "shards")
    wavelet.write(docs, path, shard_ids=500)
    got = wavelet.read(spark, path).orderBy("start").collect()
    want, at = [], 0
    order = sorted(((d, ids_of(tokenizer, t) + [0]) for d, t, *_ in docs.collect()),
                   key=lambda x: (x[0] is not None, x[0] or 0, np.array(x[1], "<u2").tobytes()))
    for doc, ids in order:
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    assert spark.read.parquet(path).count() > 3
    assert wavelet.round_trip(docs.limit(0)).count() == 0


def test_packing_is_whole_and_dense(spark, tokenizer):
    texts = HARD + ["word " * n for n in (1, 5, 40, 200, 900, 3000)] * 20
    docs = spark.createDataFrame(rows(texts), SCHEMA).repartition(5)
    for merged, open_ in ((4096, 8), (16, 2)):
        keep, packing.MERGED = packing.MERGED, merged
        try:
            got = packing.pack(docs, length=256, open_windows=open_, with_ids=True).collect()
        finally:
            packing.MERGED = keep
        by_doc, by_sequence = {}, {}
        for r in got:
            by_doc.setdefault(r.doc_id, []).append(r)
            by_sequence.setdefault(r.sequence_id, []).append(r)
            assert r.length * 4 == len(r.ids) and r.ids_crc32 == zlib.crc32(r.ids)
        for doc, text, *_ in rows(texts):
            body = b"".join(r.ids for r in sorted(by_doc[doc], key=lambda r: r.start))
            assert np.frombuffer(body, "<u4").tolist() == ids_of(tokenizer, text) + [0]
            assert {r.doc_tokens for r in by_doc[doc]} == {len(body) // 4}
        padding = 0
        for pieces in by_sequence.values():
            at = 0
            for r in sorted(pieces, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 256
            padding += 256 - at
        # Gaps below LEAST_CUT stay, and the last windows of each of five tasks may be part full.
        assert padding < packing.LEAST_CUT * len(by_sequence) + 256 * open_
    assert packing.pack(docs.limit(0)).count() == 0
