"""The quality classifier: its tables, and held-out quality."""

import numpy as np

from clickwarden.llm import quality_gam
from clickwarden.llm.queries import op2_quality_gam

from .tables import TEXTS, by_id, documents


def auc(scores, labels):
    order = np.argsort(np.argsort(scores, kind="stable"))
    good = labels == 1
    return (order[good].sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum())


def test_shapes_and_an_interaction_are_learned():
    rng = np.random.default_rng(0)
    rows = rng.random((4000, 4))
    odds = 4 * (rows[:, 0] > 0.5) - 2 + 4 * ((rows[:, 1] > 0.5) == (rows[:, 2] > 0.5)) - 2
    labels = (rng.random(4000) < 1 / (1 + np.exp(-odds))).astype(float)
    model = quality_gam.fit_gam(rows[:3000], labels[:3000])
    assert auc(model.score(rows[3000:]), labels[3000:]) > auc(odds[3000:] + 1e-6 * rows[3000:, 3], labels[3000:]) - 0.02
    assert (1, 2) in [pair[:2] for pair in model.pairs[:1]]


def test_score_is_the_sum_of_table_entries():
    rng = np.random.default_rng(1)
    rows = rng.random((300, 3))
    model = quality_gam.fit_gam(rows, (rows[:, 0] + rows[:, 1] * rows[:, 2] > 0.7).astype(float))
    for row, score in zip(rows[:40], model.score(rows[:40]), strict=True):
        at = [int((edges <= value).sum()) for edges, value in zip(model.edges, row, strict=True)]
        total = model.base + sum(table[i] for table, i in zip(model.tables, at, strict=True))
        for one, two, table in model.pairs:
            first, second = (at[x] * quality_gam.PAIR_BINS // (len(model.edges[x]) + 1) for x in (one, two))
            total += table[first, second]
        assert np.isclose(score, 1 / (1 + np.exp(-total)))


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = by_id(op2_quality_gam(spark, folder))
    labels = {row["doc_id"]: row["quality"] for row in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == 1000
    held = [(row["score"], labels[key], row["predicted"]) for key, row in rows.items() if row["held_out"] and key in labels]
    scores, truth, predicted = map(np.array, zip(*held, strict=True))
    assert auc(scores, truth) > 0.95 and (predicted == truth).mean() > 0.9
    assert all(row["predicted"] == (row["score"] >= 0.7) for row in rows.values())


def test_odd_texts_and_no_labels(spark):
    frame = documents(spark, TEXTS)
    none = spark.createDataFrame([(None, 1), (0, None), (1, 5)], "doc_id long, quality int")
    model = quality_gam.fit(frame, none)
    scores = {key: row["score"] for key, row in by_id(quality_gam.predict(frame, model)).items()}
    assert len(scores) == len(TEXTS) and set(scores.values()) == {0.5}
    assert scores[0] == scores[1]


def test_repeated_rows_and_ids_change_nothing(spark):
    rows = [(at, f"{'good words here ' * 20} {at}" if at % 2 else "x " * (at + 1), at % 2) for at in range(60)]
    docs = spark.createDataFrame([row[:2] for row in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(row[0], row[2]) for row in rows], "doc_id long, quality int")
    more = spark.createDataFrame([(at, "z" * 5000) for at in range(60)] + [(None, "x")], "doc_id long, text string")
    models = [quality_gam.fit(docs, labels), quality_gam.fit(docs.union(docs).union(more), labels.union(labels))]
    scores = [by_id(quality_gam.predict(docs, model)) for model in models]
    assert {key: row["score"] for key, row in scores[0].items()} == {key: row["score"] for key, row in scores[1].items()}
    assert quality_gam.predict(docs.where("doc_id < 0"), models[0]).collect() == []
