"""Byte-level BPE against the tiktoken library, and round trips."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from clickwarden.llm import bpe
from clickwarden.llm.queries import op7_byte_bpe

from .tables import TEXTS, by_id, documents

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
ODD = ["aaaaaabaaaa!!!!!!!!!!!!   \n\n  x", "日本語 אבג 한국어 😀😀", "<|endoftext|>", "x\x1cy\u0085z ", "a" * 6000, "it's I'LL we'd"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.TextEncoder(PATH, PATTERN)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text("aAbtheing '\n!é", max_size=60)), max_size=5))
def test_any_texts(library, encoder, texts):
    for text, data in zip(texts, encoder.encode(texts), strict=True):
        ids = np.frombuffer(data, "<u4")
        assert ids.tolist() == library.encode_ordinary(text)
        assert encoder.replay.decode(ids) == text.encode()


def test_merges_that_step_back():
    # "bc" goes before "ab" though "ab" was merged first in "xab" + "c".
    ranks = {bytes([value]): value for value in range(256)}
    for rank, token in enumerate(("abc", "xa", "ab", "aa", "aaa"), 256):
        ranks[token.encode()] = rank
    words = ["abab", "abcab", "aaaaa", "xaab", "ababcabab", "aaab" * 4]
    library = tiktoken.Encoding("small", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})
    found = bpe.MergeReplay(ranks).encode([word.encode() for word in words])
    assert [np.frombuffer(data, "<u4").tolist() for data in found] == [library.encode_ordinary(word) for word in words]


def check(rows, texts, library):
    assert len(rows) == len(texts)
    for key, text in texts.items():
        ids = library.encode_ordinary(text or "")
        assert rows[key]["n_tokens"] == len(ids)
        assert rows[key]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[key]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_digests(spark, library):
    texts = [*TEXTS, *ODD]
    check(by_id(bpe.round_trip_digests(documents(spark, texts), PATH, PATTERN)), dict(enumerate(texts)), library)


def test_query(spark, library):
    folder = "/root/testdata/sf0.01"
    texts = {row["doc_id"]: row["text"] for row in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    check(by_id(op7_byte_bpe(spark, folder)), texts, library)


def test_encode_and_decode_tables(spark, library):
    texts = [*TEXTS, *ODD]
    ids = bpe.encode_texts(documents(spark, texts), PATH, PATTERN)
    assert {key: row["ids"] for key, row in by_id(ids).items()} == {
        key: library.encode_ordinary(text or "") for key, text in enumerate(texts)}
    decoded = by_id(bpe.decode_ids(ids, PATH))
    assert all(bytes(decoded[key]["decoded"]) == (text or "").encode() for key, text in enumerate(texts))
    assert not bpe.round_trip_digests(documents(spark, []), PATH, PATTERN).collect()
