"""The corpus pipeline: raw documents to packed training sequences.

Each stage takes what the one before it kept, with the columns of `documents`, and its decisions take effect: rejected documents,
lines and copies are gone, personal data is replaced. The last stage returns placed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickwarden.llm import divergence_rules, line_dedup, ngram_join, packing, pii
from clickwarden.llm.common import delete_folders, noted, saved, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
OTHERS = ("lang", "source", "n_chars")
#: Broadcast this many ids of documents at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _without(docs: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """`docs` without the rows whose keys are in `gone`, nulls being equal."""
    gone = saved(gone.select(*[F.col(key).alias(f"gone_{key}") for key in keys]).distinct())
    same = [docs[key].eqNullSafe(gone[f"gone_{key}"]) for key in keys]
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, same, "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    judged = divergence_rules.judge(docs)
    hashed = docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    return _without(hashed, judged.where(~F.col("kept")), "doc_id", "text_hash").select(*COLUMNS)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier ones; those that lose all their words that way go."""
    deduped = line_dedup.dedup_lines(docs, keep=OTHERS)
    emptied = (F.size("dropped") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return deduped.where(~F.coalesce(emptied, F.lit(False))).withColumn(
        "n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id, of each group of near-duplicates.

    Rows are told apart by numbers of their own: those that share an id may hold different texts, and equal ones are copies.
    """
    rows = saved(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()))
    found = ngram_join.near_duplicates(rows, n=5, percent=80, id_col="row").withColumnRenamed("doc_id", "row")
    named = saved(found.select("row", "component_id").join(rows.select("row", "doc_id"), "row"))
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row"))
    return _without(rows, named.select("row").join(first.select("row"), "row", "left_anti"), "row").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that give it away replaced."""
    return pii.sanitise(docs, keep=OTHERS).withColumn(
        "n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Placed pieces of all documents: the training sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


#: By folder and number of a stage, the tables that it has saved on its way.
_left: dict[tuple[str, int], list[str]] = {}


def _tidied(number: int, stage: Stage) -> Stage:
    """The stage, which first deletes the tables that the one before it saved on its way, as that one's result has been written by now."""
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete_folders(_left.pop((sf_dir, number - 1), []), docs)
        with noted() as folders:
            result = stage(spark, docs, sf_dir)
        _left[sf_dir, number] = folders
        return result

    return run_stage


STAGES = [(name, _tidied(number, stage)) for number, (name, stage) in enumerate([
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("ngram_jaccard_join", near_duplicates),
    ("pii", personal_data),
    ("best_fit_packing", pack_sequences),
])]

#: SQL has neither the tokenizer nor the searches; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over `documents`; each result is written and read again, and goes when the next is there."""
    docs, written = table(spark, sf_dir, "documents"), []
    for number, (_, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        with noted() as folders:
            docs = saved(result)
        delete_folders(_left.pop((sf_dir, number), []) + written, docs)
        written = folders
    return docs
