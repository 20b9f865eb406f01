"""Contamination against every window of every text, and the guarantee of winnowing."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clickwarden.llm import decontamination, spans
from clickwarden.llm.decontamination import Fingerprints, contamination, winnowed

from .tables import TEXTS, documents
from .test_spans import plain_words

WINDOW, GRAM = 10, 5


def plain_contamination(texts, items):
    by_window = {}
    for item, text in items:
        words = plain_words(text)
        size = min(WINDOW, len(words))
        if item is not None and words:
            for at in range(len(words) - size + 1):
                by_window.setdefault(tuple(words[at:at + size]), set()).add(str(item))
    sizes = {len(window) for window in by_window}
    out = []
    for text in texts:
        words, hit, found = plain_words(text), set(), set()
        for size in sizes:
            for at in range(len(words) - size + 1):
                if (names := by_window.get(tuple(words[at:at + size]))) is not None:
                    hit.update(range(at, at + size))
                    found |= names
        out.append((len(words), len(hit), sorted(found)))
    return out


def run(spark, texts, items):
    frame = spark.createDataFrame(items, "item_id long, text string, doc_id string, n_hit int")
    found = {row["doc_id"]: row for row in contamination(documents(spark, texts), frame).collect()}
    assert len(found) == len(texts)
    for at in range(len(texts)):
        row = found[at]
        assert row["n_items"] == len(row["items"]) and row["contaminated"] == (row["n_hit"] > 0)
        assert row["items_sha256"] == hashlib.sha256(",".join(row["items"]).encode()).hexdigest()
    return [(found[at]["n_words"], found[at]["n_hit"], found[at]["items"]) for at in range(len(texts))]


def made_up(seed):
    rng = random.Random(seed)
    common = [f"w{at}" for at in range(12)]
    passage = " ".join(rng.choices(common, k=25))
    items = [(at, passage + " " + " ".join(rng.choices(common, k=rng.randrange(9))), "x", 0) for at in range(5)]
    items += [(at + 10, ", ".join(rng.choices(common, k=rng.choice([1, 3, 9, 10, 11, 40]))), "x", 0) for at in range(20)]
    items += [(3, "one more text of the item three with more than ten words in all", "x", 0), (None, passage, "x", 0),
              (50, None, "x", 0), (51, " .- ", "x", 0), items[0]]
    texts = [*TEXTS]
    for _ in range(60):
        text = " ".join(rng.choices(common, k=rng.randrange(30)))
        for _ in range(rng.randrange(4)):
            words = plain_words(rng.choice(items)[1])
            if words:
                first = rng.randrange(len(words))
                text += ". " + "--".join(words[first:first + rng.randrange(1, 30)]).upper() + " " + rng.choice(common)
        texts.append(text)
    return texts, items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_windows(spark, seed):
    texts, items = made_up(seed)
    found = run(spark, texts, items)
    assert found == plain_contamination(texts, [item[:2] for item in items])
    assert any(hit for _, hit, _ in found)


def test_hot_passage_and_repeated_passages(spark):
    passage = " ".join(f"p{at}" for at in range(60))
    texts = [passage] * 40 + [passage + " " + passage, "x " * 3000 + passage, "q " + passage[:60]]
    items = [(at, passage, "x", 0) for at in range(30)] + [(99, passage[100:] + " tail of its own", "x", 0)]
    assert run(spark, texts, items) == plain_contamination(texts, [item[:2] for item in items])


def test_without_broadcasts_and_with_a_full_filter(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontamination, "LEAST_BITS", 1 << 15)
    monkeypatch.setattr(decontamination, "MOST_BITS", 1 << 15)
    texts, items = made_up(4)
    assert run(spark, texts, items) == plain_contamination(texts, [item[:2] for item in items])


def test_long_texts_cut_into_blocks(spark, monkeypatch):
    passage = " ".join(f"p{at}" for at in range(33))
    text = ("filler " * 40 + passage + " ") * 30
    monkeypatch.setattr(spans, "BLOCK_BYTES", 300)
    words = list(spans.word_blocks(pa.array([text]), WINDOW + GRAM, 300))
    assert len(words) > 10
    places = {int(block.numbers[at]) for block in words for at in Fingerprints(block, WINDOW, WINDOW, GRAM).places}
    whole = next(spans.word_blocks(pa.array([text])))
    assert set(Fingerprints(whole, WINDOW, WINDOW, GRAM).places.tolist()) <= places


def test_empty_tables_and_null_ids(spark):
    assert run(spark, ["a b c"], []) == [(3, 0, [])]
    empty = contamination(documents(spark, []), spark.createDataFrame([(1, "a b c")], "item_id long, text string"))
    assert empty.collect() == []
    frame = spark.createDataFrame([(None, "a b c"), (None, "x"), (7, "a b c"), (7, "a b c")], "doc_id long, text string")
    found = contamination(frame, spark.createDataFrame([(1, "a b c")], "item_id long, text string")).collect()
    assert sorted((row["doc_id"] or 0, row["n_hit"]) for row in found) == [(0, 0), (0, 3), (7, 3), (7, 3)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.integers(1, 8))
def test_winnowing_keeps_the_least_of_every_run(values, run_length):
    hashes = np.array(values, np.uint64)
    kept = winnowed(hashes, run_length)
    length = min(run_length, len(values))
    runs = [range(at, at + length) for at in range(len(values) - length + 1)] if values else []
    assert kept.tolist() == [any(at in run and values[at] == min(values[place] for place in run) for run in runs)
                             for at in range(len(values))]
