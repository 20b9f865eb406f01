"""Ranked search against scores of all documents, and what its bounds leave out."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from clickwarden.llm import lexical_search
from clickwarden.llm.lexical_search import Bucket, Vocabulary, search
from clickwarden.llm.spans import word_blocks

from .tables import TEXTS, documents
from .test_spans import plain_words


def plain_search(texts, items, k):
    """(item, rank, doc_id, score) from the formula; `texts` are (doc_id, text)."""
    counts = [(doc_id, Counter(plain_words(text))) for doc_id, text in texts]
    whole, total = sum(1 for _, of in counts if of), sum(sum(of.values()) for _, of in counts)
    held = Counter(term for _, of in counts for term in of)
    queries = {}
    for item, text in items:
        queries.setdefault(item, set()).update(plain_words(text))
    out = []
    for item, terms in queries.items():
        scored = []
        for doc_id, of in counts:
            m = 50 + 50 * sum(of.values()) * whole // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * whole + 2) / (2 * held[term] + 1)))
                        * (1_000_000_000 * of[term] // (1000 * of[term] + 20 * m)) for term in terms if term in of)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, rank, found[3], -found[0]) for rank, found in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def made_up(seed, size=300):
    rng = random.Random(seed)
    words = [f"w{at}" for at in range(60)] + ["É", "Ünder", "42", "日本"]
    weights = [1 / (at + 1) for at in range(len(words))]
    texts = [(at, " ".join(rng.choices(words, weights, k=rng.randrange(40)))) for at in range(size)]
    texts += [(1000 + at, texts[7][1]) for at in range(80)] + [(5, texts[7][1]), texts[9], (None, texts[7][1]), (None, texts[7][1])]
    texts += [(2000 + at, text) for at, text in enumerate(TEXTS)]
    items = [(at, " ".join(rng.choices(words, k=rng.randrange(12)))) for at in range(15)]
    return texts, [*items, (3, "w59 more"), (None, "w1 w58"), (90, None), (91, ""), (92, "nowhere"), (93, texts[7][1]), items[0]]


def run(spark, texts, items, k):
    docs = spark.createDataFrame([(*row, 1) for row in texts], "doc_id long, text string, score int")
    frame = spark.createDataFrame([(*row, "x") for row in items], "item_id long, text string, doc_id string")
    return sorted(map(tuple, search(docs, frame, k).select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("seed, k", [(1, 5), (2, 50), (3, 1)])
def test_against_all_scores(spark, monkeypatch, seed, k):
    monkeypatch.setattr(lexical_search, "BUCKET", 16)
    texts, items = made_up(seed)
    assert run(spark, texts, items, k) == plain_search(texts, items, k)


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_TERM_BYTES", 60)
    texts, items = made_up(4, 40)
    assert run(spark, texts, items, 4) == plain_search(texts, items, 4)


def test_text_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y"), ("c", "z")], "doc_id string, text string")
    items = spark.createDataFrame([("i", "x")], "item_id string, text string")
    assert [row["doc_id"] for row in search(docs, items, 3).orderBy("rank").collect()] == ["a", "b", None]
    assert search(documents(spark, []), items).collect() == []
    assert search(docs, items.where("item_id is null")).collect() == []
    assert search(docs.where("text is null"), items).collect() == []


def test_terms_of_one_hash():
    vocabulary = Vocabulary(["one", "two", "three"])
    words = next(word_blocks(pa.array(["three x one", "two one"])))
    assert vocabulary.lookup(words)[1].tolist() == [2, 0, 1, 0]
    # As if all three had the hash of "one": told apart by their bytes.
    vocabulary.hashes, vocabulary.numbers, vocabulary.most_alike = np.full(3, words.hashes[2]), np.arange(3), 3
    words.hashes[:] = words.hashes[2]
    places, numbers = vocabulary.lookup(words)
    assert sorted(zip(places.tolist(), numbers.tolist(), strict=True)) == [(0, 2), (2, 0), (3, 1), (4, 0)]


def test_no_bound_loses_a_vector():
    rng = np.random.default_rng(5)
    for _ in range(200):
        size = rng.integers(1, 20)
        ids = [sorted(rng.choice(8, rng.integers(1, 8), replace=False).tolist()) for _ in range(size)]
        impacts = [rng.integers(1, 100, len(of)).tolist() for of in ids]
        lengths = [math.sqrt(sum(value * value for value in of)) for of in impacts]
        bucket = Bucket(pa.RecordBatch.from_arrays(
            [pa.array(range(size)), pa.array(ids, pa.list_(pa.int32())), pa.array(impacts, pa.list_(pa.int64())), pa.array(lengths)],
            names=["doc_id", "ids", "impacts", "length"]))
        terms = np.sort(rng.choice(10, rng.integers(1, 6), replace=False))
        scores = [sum(value for term, value in zip(of, own, strict=True) if term in terms) for of, own in zip(ids, impacts, strict=True)]
        least = int(rng.integers(1, 200))
        places, found = bucket.search(terms, least)
        assert sorted(zip(places.tolist(), found.tolist(), strict=True)) == [
            (at, score) for at, score in enumerate(scores) if score >= least]
