"""Packing: whole pieces, few sequences, and ids as the tokenizer gives them."""

import bisect
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from clickwarden.llm import packing
from clickwarden.llm.queries import op5_best_fit_packing

from .tables import TEXTS, documents

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["<|endoftext|> is text", "x\x1cy", "ΟΔΟΣ Σ. İİ it's 'S É", "a b　c", "Don't #stop!!! ...ok", "long " * 6000]


def placed(rows, capacity):
    """Pieces fill each sequence from 0 on without gap or overlap, and none beyond its end."""
    by_sequence = {}
    for row in rows:
        by_sequence.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


def reference(texts, end_id=1, capacity=4096):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    out = []
    for key, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[start:start + capacity], "<u4").tobytes()
            out.append((key, piece, start, len(part) // 4, zlib.crc32(part)))
    return sorted(out)


def pieces(rows):
    return sorted(tuple(row[name] for name in ("doc_id", "piece", "start", "length", "ids_crc32")) for row in rows)


def test_ids_and_places(spark):
    texts = [*TEXTS, *ODD]
    rows = packing.pack_documents(documents(spark, texts), PATH).collect()
    assert pieces(rows) == reference(dict(enumerate(texts)))
    placed(rows, 4096)


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = op5_best_fit_packing(spark, folder).collect()
    texts = {row["doc_id"]: row["text"] for row in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert pieces(rows) == reference(texts)
    assert placed(rows, 4096) == -(-sum(row["length"] for row in rows) // 4096)


def least_bins(counts, capacity):
    over_half = sum(n for length, n in counts.items() if 2 * length > capacity)
    return max(over_half, -(-sum(length * n for length, n in counts.items()) // capacity))


def best_fit_decreasing(counts, capacity):
    rooms = []
    for length in sorted((length for length, n in counts.items() for _ in range(n)), reverse=True):
        at = bisect.bisect_left(rooms, length)
        room = rooms.pop(at) if at < len(rooms) else capacity
        bisect.insort(rooms, room - length)
    return len(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_fillings_place_every_length(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 100, 4096])
    counts = {rng.randint(1, capacity): rng.randint(1, 50) for _ in range(rng.randint(1, 200))}
    plan, left = packing.fillings(counts, capacity), dict(counts)
    for copies, pattern in plan:
        assert sum(length * times for length, times in pattern) <= capacity
        for length, times in pattern:
            left[length] -= copies * times
    assert not any(left.values())
    bins = sum(copies for copies, _ in plan)
    assert least_bins(counts, capacity) <= bins <= best_fit_decreasing(counts, capacity)


def test_completion_beats_best_fit():
    # Best fit takes 6 and 3 for the room of 10; completion finds 5 and 5.
    left = np.zeros(21, np.int64)
    left[[6, 5, 3]] = [1, 2, 1]
    assert sorted(packing._completion(left, 10)) == [5, 5]


def test_small_groups_and_many_equal_lengths(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 10)
    monkeypatch.setattr(packing, "LEAST_GROUPS", 7)
    rows = packing.pack_documents(documents(spark, ["a b c d"] * 500 + ["a b c d e f"] * 100), PATH, capacity=12).collect()
    assert len(rows) == 600 and placed(rows, 12) == 300


def test_empty_table(spark):
    assert not packing.pack_documents(documents(spark, []), PATH).collect()
