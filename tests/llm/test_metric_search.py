"""Top-k search against all products."""

import math

import numpy as np
import pytest

from clickwarden.llm import metric_search
from clickwarden.llm.queries import op9_mtree_search


def brute(rows, asked, k, scale=64):
    usable = [(key, np.floor(scale * np.array(v, float)).astype(int)) for key, v in rows
              if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = max((len(v) for _, v in usable), default=0)
    usable = [(key, np.pad(v, (0, size - len(v)))) for key, v in usable]
    out = []
    for query, q in usable:
        if asked(query):
            best = sorted((-int(q @ v), key) for key, v in usable if key != query)[:k]
            out += [(query, rank, key, -score) for rank, (score, key) in enumerate(best, 1)]
    return sorted(out)


def found(frame):
    return sorted((row["query_id"], row["rank"], row["vec_id"], row["score"]) for row in frame.collect())


@pytest.mark.parametrize("limits", [{}, {"REGION": 40, "SUBTREE": 64, "PAGE": 8, "BLOCK": 9}])
def test_equals_all_products(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(metric_search, name, value)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 12))
    rows = [(at, (centres[at % 6] + 0.3 * rng.normal(size=12)).astype(np.float32).tolist()) for at in range(500)]
    rows += [(500 + at, [0.25] * 12) for at in range(200)] + [(900, [0.0] * 12), (901, [5.0] * 12), (902, [1.0, 2.0])]
    rows += [(903, None), (904, [None] * 12), (905, [float("nan")] * 12), (906, [float("inf")] + [0.0] * 11), (907, [])]
    frame = spark.createDataFrame([(key, v, "x") for key, v in rows], "vec_id long, embedding array<float>, query_id string")
    got = found(metric_search.top_k(frame, frame.where("vec_id % 20 = 0"), 20))
    assert got == brute(rows, lambda key: key % 20 == 0, 20)


def test_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema)
    assert found(metric_search.top_k(frame, None, 20)) == [(0, 1, 1, 128 * 64), (1, 1, 0, 128 * 64)]
    assert found(metric_search.top_k(spark.createDataFrame([], schema), None, 3)) == []


def test_repeated_queries(spark, monkeypatch):
    for name, value in {"REGION": 10, "PAGE": 4}.items():
        monkeypatch.setattr(metric_search, name, value)
    rng = np.random.default_rng(5)
    rows = [(at, rng.normal(size=4).tolist()) for at in range(200)]
    schema = "vec_id long, embedding array<double>"
    frame = spark.createDataFrame(rows, schema)
    got = found(metric_search.top_k(frame, spark.createDataFrame([rows[3], rows[3], rows[8]], schema), 20))
    assert got == brute(rows, lambda key: key in (3, 8), 20)
    other = (3, rows[9][1])  # another vector under the same id
    got = found(metric_search.top_k(frame, spark.createDataFrame([rows[3], other], schema), 20))
    alone = [found(metric_search.top_k(frame, spark.createDataFrame([one], schema), 20)) for one in (rows[3], other)]
    assert got == sorted(alone[0] + alone[1])


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(row["vec_id"], row["embedding"]) for row in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert found(op9_mtree_search(spark, folder)) == brute(rows, lambda key: key % 20 == 0, 20)


def test_large_components(spark):
    """Products beyond 2^53 are exact; what does not fit 64 bits takes no part and nothing crashes."""
    rng = np.random.default_rng(9)
    rows = [(at, (rng.normal(size=6) * 1e7).tolist()) for at in range(150)]
    rows += [(200, [2e7, 2e7 + 1 / 64, -2e7, 0.0, 1.0, 2.0]), (220, [2e7, 2e7, -2e7, 0.0, 1.0, 2.0])]
    usual = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    beyond = [(400, [1e8] * 6), (420, [1e300] * 6), (440, [-1e300, 0.0, 0.0, 0.0, 0.0, 0.0]), (460, [6.7e7] * 6)]
    frame = usual.union(spark.createDataFrame(beyond, "vec_id long, embedding array<double>"))
    got = found(metric_search.top_k(frame, frame.where("vec_id % 20 = 0"), 20))
    wanted = brute(rows, lambda key: key % 20 == 0, 20)
    assert max(abs(row[3]) for row in wanted) > 2**53
    assert got == wanted
