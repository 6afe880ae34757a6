"""Byte-level BPE and token counts against the public libraries."""

import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from calibrix.llm import byte_bpe, token_count
from tests.llm.conftest import NASTY

ODD = ["", "a\x1cb \x1d\x85c  d e​ f", "  \n\n x  ", "\x1c\x1c  \x1f a", "İSTANBUL ΣΑΣ ΟΔΟΣ é ﬁ ½ Ⅷ ²",
       "<|endoftext|>hi <|startoftext|><|endoftext|>", "don't I'LL 've 'S", "日本語 テスト 한국어", "aaaa" * 500,
       "🎉👩‍👩‍👧 ᠎ ﻿", "\x00\x01\x7f", "ǅ ẞ K Å", "é Å"]


def random_texts(n=300):
    r = random.Random(5)
    pool = "abcdefghij ABC  \n\t0123.,!?'\"éèßüñ漢字🎉́\x1c\x85"
    return ODD + ["".join(r.choices(pool, k=r.randint(0, 120))) for _ in range(n)]


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal(ranks):
    keys = list(ranks)[:5000]
    table = byte_bpe.PerfectHash(keys)
    assert sorted(table.key_at) == list(range(len(keys)))
    assert (table.find(byte_bpe.hashes(keys)) == np.arange(len(keys))).all()


def test_encode(spark, ranks, reference):
    texts = random_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for x in byte_bpe.encode_decode(df, ranks, P.PATTERN).collect():
        assert np.frombuffer(x.ids, "<u4").tolist() == reference.encode_ordinary(texts[x.doc_id])
        assert bytes(x.decoded) == texts[x.doc_id].encode()


def test_encode_nasty(nasty, empty, ranks, reference):
    encoded = byte_bpe.encode(nasty, ranks, P.PATTERN)
    got = Counter((x.doc_id, bytes(x.ids)) for x in encoded.collect())
    assert got == Counter((i, np.array(reference.encode_ordinary(t or ""), "<u4").tobytes()) for i, t, _, _ in NASTY)
    back = Counter((x.doc_id, bytes(x.decoded)) for x in byte_bpe.decode(encoded, ranks, P.PATTERN).collect())
    assert back == Counter((i, (t or "").encode()) for i, t, _, _ in NASTY)
    assert byte_bpe.encode(empty, ranks, P.PATTERN).count() == 0


def test_counts(spark, nasty, empty):
    path = P.path("word_bpe_49k.json")
    reference = Tokenizer.from_file(path)
    texts = random_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = [len(e.ids) for e in reference.encode_batch(texts, add_special_tokens=False)]
    for x in token_count.token_counts(df, path, limit=40).collect():
        assert (x.n_tokens, x.n_bytes) == (want[x.doc_id], len(texts[x.doc_id].encode())), texts[x.doc_id]
        assert x.over_limit == (x.n_tokens > 40)
    got = Counter((x.doc_id, x.n_tokens) for x in token_count.token_counts(nasty, path).collect())
    assert got == Counter((i, len(reference.encode(t or "", add_special_tokens=False).ids)) for i, t, _, _ in NASTY)
    assert token_count.token_counts(empty, path).count() == 0


def test_lower_case_is_the_librarys():
    """All characters: what Python's own data lacks is in NEWER."""
    from tokenizers import normalizers
    lower = normalizers.Lowercase().normalize_str
    missing = {c: ord(low) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000
               and (low := lower(chr(c))) != chr(c).lower() and len(low) == 1}
    assert missing.items() <= token_count.NEWER.items()


def test_counts_of_new_capitals(spark):
    path = P.path("word_bpe_49k.json")
    reference = Tokenizer.from_file(path)
    texts = [f"a{chr(c)}b {chr(c)} c{chr(c)}{chr(c)}" for c in token_count.NEWER]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for x in token_count.token_counts(df, path).collect():
        assert x.n_tokens == len(reference.encode(texts[x.doc_id], add_special_tokens=False).ids), texts[x.doc_id]
