"""Aligned tokens against a plain walk over both sides' byte ranges."""

import hashlib
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from clickwarden.llm import alignment
from clickwarden.llm.queries import op13_tokenizer_alignment

from .tables import TEXTS, by_id, documents

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["日本語 אבג 한국어 😀😀", "<|endoftext|> and <s> </s>", "x\x1cy\u0085z ", " leading", "trailing \n", "▁ piece", "áé", "\x00\x01",
       "fi ﬁ ½ ①", "The quick brown fox."]


@cache
def plain_sides():
    bytes_side = Tokenizer.from_file(PATHS[0])
    bytes_side.encode_special_tokens = True
    pieces = SentencePieceProcessor(model_file=PATHS[1])
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {chr(byte): byte for byte in shown}
    spelled |= {chr(256 + at): byte for at, byte in enumerate(byte for byte in range(256) if byte not in shown)}

    def a(text):
        found = bytes_side.encode(" " + text, add_special_tokens=False)
        return [(number, bytes(spelled[mark] for mark in token)) for number, token in zip(found.ids, found.tokens, strict=True)]

    def b(text):
        return [(number, bytes([int(piece[3:5], 16)]) if pieces.is_byte(number) else piece.replace("▁", " ").encode())
                for number in pieces.encode(text) for piece in [pieces.id_to_piece(number)]]

    return a, b


def plain_alignment(texts):
    """Per text (n_a, n_b, groups, n_overlaps, links), links as (a, b) ids."""
    side_a, side_b = plain_sides()
    out = []
    for text in texts:
        whole = b" " + (text or "").encode()
        a, b = (side(text) if text else [] for side in (side_a, side_b))
        if not text or any(b"".join(token for _, token in side) != whole for side in (a, b)):
            out.append((0, 0, "", 0, []))
            continue
        ranges = []
        for side in (a, b):
            at, found = 0, []
            for number, token in side:
                found.append((number, at, at + len(token)))
                at += len(token)
            ranges.append(found)
        ends = sorted({end for *_, end in ranges[0]} & {end for *_, end in ranges[1]})
        groups, before = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(number) for number, _, stop in side if before < stop <= end) for side in ranges))
            before = end
        links = [(one, two) for one, _, stop in ranges[0] for two, _, end in ranges[1] if stop == end]
        overlapping = sum(1 for _, start, stop in ranges[0] for _, first, end in ranges[1] if start < end and first < stop)
        out.append((len(a), len(b), ";".join(groups), overlapping, links))
    return out


def check(rows, texts):
    wanted = plain_alignment(texts.values())
    counts = Counter(link for *_, links in wanted for link in links)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    assert len(rows) == len(texts)
    for key, (n_a, n_b, groups, overlapping, links) in zip(texts, wanted, strict=True):
        row = rows[key]
        assert (row["n_a"], row["n_b"], row["n_overlaps"], row["n_links"]) == (n_a, n_b, overlapping, len(links))
        assert row["n_groups"] == (groups.count(";") + 1 if groups else 0)
        assert row["groups_sha256"] == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        assert row["n_best"] == sum(1 for link in links if counts[link] == best[link[1]])
        assert row["count_sum"] == sum(counts[link] for link in links)


@pytest.fixture(scope="module")
def sides():
    return alignment.ByteTokens(PATHS[0]), alignment.PieceTokens(PATHS[1])


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text("aAbtheing '\n\r\t!.9é½ªß×", max_size=80), st.text(max_size=40), st.text(max_size=20).map(lambda text: f"{text}  {text} ")))
def test_words_give_the_ids_of_whole_texts(sides, text):
    text = text.encode("utf-8", "ignore").decode()
    for side, plain in zip(sides, plain_sides(), strict=True):
        tokens = plain(text)
        whole = text and b"".join(token for _, token in tokens) == b" " + text.encode()
        (found,) = side.encode([text])
        assert (np.frombuffer(found, np.int64).tolist() if found else None) == ([number for number, _ in tokens] if whole else None)


def test_a_full_cache_starts_anew(sides, monkeypatch):
    monkeypatch.setattr(alignment, "KEPT_WORDS", 2)
    for texts in (["one two three four", ""], ["one five", "six"], ["one two three four"], ["six"]):
        for side, plain in zip(sides, plain_sides(), strict=True):
            assert [np.frombuffer(found, np.int64).tolist() if found else None for found in side.encode(texts)] == [
                [number for number, _ in plain(text)] if text else None for text in texts]


@pytest.mark.parametrize("broadcast", [0, 1_000_000])
def test_hard_texts(spark, monkeypatch, broadcast):
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", broadcast)
    monkeypatch.setattr(alignment, "BATCH_CHARS", 40)
    texts = [text for text in [*TEXTS, *ODD, *ODD[:3]] if text is None or len(text) < 3000]
    check(by_id(alignment.link_support(documents(spark, texts), *PATHS)), dict(enumerate(texts)))


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {row["doc_id"]: row["text"] for row in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    short = {key: text for key, text in texts.items() if len(text or "") < 1500}
    check(by_id(alignment.link_support(spark.createDataFrame(list(short.items()), "doc_id long, text string"), *PATHS)), short)
    rows = by_id(op13_tokenizer_alignment(spark, folder))
    assert len(rows) == len(texts)
    assert all(rows[key]["n_a"] > 0 and rows[key]["n_links"] == rows[key]["n_groups"] for key in short if short[key])


def test_empty_table_and_repeated_rows(spark):
    assert alignment.link_support(documents(spark, []), *PATHS).collect() == []
    frame = spark.createDataFrame([(1, "one text"), (1, "one text"), (None, "one text")], "doc_id long, text string")
    rows = alignment.link_support(frame, *PATHS).collect()
    assert len(rows) == 3 and len({(row["n_a"], row["count_sum"], row["groups_sha256"]) for row in rows}) == 1
    assert rows[0]["count_sum"] == 3 * rows[0]["n_links"]
