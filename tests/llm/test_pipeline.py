"""Each stage of the pipeline against brute force on its own input, and the whole on odd rows."""

import pytest

import corpus_pipeline

from . import test_divergence_rules, test_line_dedup, test_ngram_join, test_packing, test_pii
from .tables import TEXTS, documents

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The input of each stage, and the result, as lists of rows."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, FOLDER))
        out.append(docs.collect())
    return out


def texts(rows):
    return {row["doc_id"]: row["text"] for row in rows}


def test_columns(steps):
    for rows in steps[1:5]:
        assert set(rows[0].asDict()) == set(steps[0][0].asDict())
        assert all(row["n_chars"] == len(row["text"]) for row in rows)


def test_quality_rules(steps):
    verdicts = test_divergence_rules.brute({row["doc_id"]: (row["text"], row["lang"]) for row in steps[0]})
    assert texts(steps[1]) == {key: text for key, text in texts(steps[0]).items() if verdicts[key][0]}
    assert len(steps[1]) < len(steps[0])


def test_line_dedup_stage(steps):
    before = texts(steps[1])
    dropped = {key: {int(at) for at in found.split(",") if at}
               for key, found in test_line_dedup.brute_by_blocks(before).items()}
    left = {key: "\n".join(line for at, line in enumerate(text.split("\n")) if at not in dropped[key])
            for key, text in before.items()}
    assert texts(steps[2]) == {key: text for key, text in left.items() if text.strip(test_line_dedup.SPACE)}


def test_near_duplicates(steps):
    before = texts(steps[2])
    first = test_ngram_join.brute(before, 5, 80)
    assert texts(steps[3]) == {key: text for key, text in before.items() if first[key][1] == key}


def test_near_duplicates_under_shared_ids(spark):
    long, other = " ".join(f"word{at}" for at in range(50)), " ".join(f"term{at}" for at in range(50))
    rows = [(1, long), (2, long), (2, other), (3, other + " x"), (4, "a b c d e f g"), (4, "a b c d e f g"), (None, long)]
    docs = spark.createDataFrame([(key, text, "en", "src", len(text)) for key, text in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()
    assert sorted(((row["doc_id"], row["text"]) for row in kept), key=str) == [(1, long), (2, other), (4, "a b c d e f g")]


def test_personal_data(steps):
    before, after = texts(steps[3]), texts(steps[4])
    assert before.keys() == after.keys()
    for key, text in before.items():
        assert not any(test_pii.plain(after[key]).values())
        if not any(test_pii.plain(text).values()):
            assert after[key] == text


def test_packing_stage(steps):
    assert test_packing.pieces(steps[5]) == test_packing.reference(texts(steps[4]))
    test_packing.placed(steps[5], 4096)


@pytest.mark.parametrize("rows", [[], TEXTS, [None], ["a word " * 30] * 3])
def test_odd_rows(spark, rows):
    docs = documents(spark, rows).selectExpr("doc_id", "text", "lang", "source", "cast(1 as bigint) n_chars", "1 as t", "2 as h")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, FOLDER))
    test_packing.placed(docs.collect(), 4096)
