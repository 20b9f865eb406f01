"""The n-gram join against all pairs."""

import random
import re

import numpy as np
import pytest

from clickwarden.llm import ngram_join
from clickwarden.llm.queries import op3_ngram_jaccard_join

from .tables import TEXTS, by_id, documents


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[at:at + n]) for at in range(max(1, len(words) - n + 1))}


def brute(texts, n, percent):
    sets, root = {key: shingles(text, n) for key, text in texts.items()}, {key: key for key in texts}

    def top(key):
        while root[key] != key:
            key = root[key]
        return key

    keys = sorted(key for key in texts if sets[key])
    for at, one in enumerate(keys):
        for two in keys[:at]:
            both = len(sets[one] & sets[two])
            if both and 100 * both >= percent * (len(sets[one]) + len(sets[two]) - both):
                low, high = sorted((top(one), top(two)))
                root[high] = low
    return {key: (len(sets[key]), top(key)) for key in texts}


def found(frame):
    return {key: (row["n_shingles"], row["component_id"]) for key, row in by_id(frame).items()}


def families(seed, n_families=12, members=12):
    rng = random.Random(seed)
    words = [f"w{at}" for at in range(300)]
    shared = " ".join(rng.choices(words, k=25))
    texts = []
    for _ in range(n_families):
        base = rng.choices(words, k=rng.choice([4, 12, 60, 150, 400]))
        for _ in range(members):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy) + rng.choice(["", "", " " + shared]))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_all_links_are_found(spark, n, percent):
    texts = [*TEXTS, *families(n), "Same Words here", "same words HERE", "Ähnlich É", "ähnlich É"]
    assert found(ngram_join.near_duplicates(documents(spark, texts), n, percent)) == brute(dict(enumerate(texts)), n, percent)


def test_small_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    texts = families(9, 3, 40)
    assert found(ngram_join.near_duplicates(documents(spark, texts))) == brute(dict(enumerate(texts)), 3, 90)


def test_the_exact_step_alone_finds_all(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "_family_links", lambda every, firsts, percent: spark.createDataFrame([], "a long, b long"))
    texts = families(4, 8, 10)
    assert found(ngram_join.near_duplicates(documents(spark, texts))) == brute(dict(enumerate(texts)), 3, 90)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {row["doc_id"]: row["text"] for row in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert found(op3_ngram_jaccard_join(spark, folder)) == brute(texts, 3, 90)


def test_prefix_tree_equals_all_pairs():
    rng = np.random.default_rng(5)
    for percent in (50, 80, 90):
        base = rng.choice(1000, 60, replace=False)
        sets = [np.unique(np.append(rng.choice(base, rng.integers(1, 60), replace=False), rng.choice(1000, 2)))
                for _ in range(120)]
        tree = ngram_join.PrefixTree(sets)
        for at, one in enumerate(sets):
            alike = [other for other, two in enumerate(sets) if (both := np.intersect1d(one, two).size) * 100
                     >= percent * (one.size + two.size - both)]
            assert sorted(tree.alike(at, percent)) == alike


def test_empty_table(spark):
    assert not ngram_join.near_duplicates(documents(spark, [])).collect()
