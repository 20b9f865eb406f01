"""The registered queries of this folder: each operator with production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickwarden.llm import (
    alignment, bpe, decontamination, divergence_rules, language_id, lexical_search, line_dedup, metric_search, ngram_join, packing, pii,
    quality_gam, url_templates)
from clickwarden.llm.common import table


def held_out() -> Column:
    """Every fourth document or so, by its id: nothing is learned from these."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op1_segmentation_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language_id.fit(docs.where(~held_out()), public_tokenizers.path("piece_bpe_32k.model"))
    return model.predict(docs).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_quality_gam(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality_gam.fit(docs.select("doc_id", "text"), table(spark, folder, "labels").where(~held_out()))
    return quality_gam.predict(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, folder, "documents"), n=3, percent=90)


def op4_divergence_rules(spark: SparkSession, folder: str) -> DataFrame:
    return divergence_rules.judge(table(spark, folder, "documents")).drop("text_hash")


def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_segment_edit_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.digest(line_dedup.dedup_lines(table(spark, folder, "documents")))


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, folder, "documents"),
                                  public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_disclosing_terms(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.sanitise(table(spark, folder, "documents")))


def op9_mtree_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return metric_search.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20, scale=64)


URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op10_path_templates(spark: SparkSession, folder: str) -> DataFrame:
    """A url that ends with a document's number is labelled by that document's quality."""
    labels = table(spark, folder, "labels").select(
        F.col("doc_id").cast("string").alias("key"), (1.0 - F.col("quality")).alias("bad"))
    return url_templates.judge_urls(table(spark, folder, "pages"), labels, URL_RULES)


def op11_impact_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=50)


def op12_winnowing_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("items")


def op13_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.link_support(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                  public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_segmentation_language_id": op1_segmentation_language_id,
    "op2_quality_gam": op2_quality_gam,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_divergence_rules": op4_divergence_rules,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_segment_edit_line_dedup": op6_segment_edit_line_dedup,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_disclosing_terms": op8_disclosing_terms,
    "op9_mtree_search": op9_mtree_search,
    "op10_path_templates": op10_path_templates,
    "op11_impact_search": op11_impact_search,
    "op12_winnowing_decontamination": op12_winnowing_decontamination,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

SQL: dict[str, str] = {
    "op3_ngram_jaccard_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS shingles FROM d),
        t AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
        p AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_shared, any_value(a.n) + any_value(b.n) AS sizes
            FROM t a JOIN t b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM p WHERE 100 * n_shared >= 90 * (sizes - n_shared)),
        reached(doc_id, root) AS (
            SELECT doc_id, doc_id FROM s UNION SELECT reached.doc_id, links.b FROM reached JOIN links ON reached.root = links.a)
        SELECT s.doc_id, len(any_value(shingles))::BIGINT AS n_shingles, min(root) AS component_id
        FROM s JOIN reached USING (doc_id) GROUP BY s.doc_id
    """,
    "op9_mtree_search": r"""
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (
            SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
            FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM p
        QUALIFY rank <= 20
    """,
    "op11_impact_search": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
        t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM d) GROUP BY ALL),
        q AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        c AS (SELECT count(*) FILTER (len(words) > 0) AS n, sum(len(words))::BIGINT AS l FROM d),
        w AS (SELECT term, floor(1000 * ln((2 * c.n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, c GROUP BY term, c.n),
        m AS (SELECT r, doc_id, 100 - 50 + (50 * len(words) * c.n) // c.l AS m FROM d, c WHERE len(words) > 0),
        s AS (
            SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
            FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL HAVING score > 0)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s
        QUALIFY rank <= 50
    """,
    "op12_winnowing_decontamination": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
        b AS (
            SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE item_id IS NOT NULL),
        bw AS (
            SELECT DISTINCT item, least(10, len(words)) AS size, array_to_string(words[i:i + least(10, len(words)) - 1], ' ') AS win
            FROM (SELECT *, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i FROM b WHERE len(words) > 0)),
        dw AS (
            SELECT r, i, size, array_to_string(words[i:i + size - 1], ' ') AS win FROM (
                SELECT r, words, size, unnest(range(1, len(words) - size + 2)) AS i
                FROM d, (SELECT DISTINCT size FROM bw) WHERE len(words) >= size)),
        hit AS (SELECT DISTINCT r, i, size, win FROM dw SEMI JOIN bw USING (size, win)),
        covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hit) GROUP BY r),
        named AS (
            SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT r, item FROM hit JOIN bw USING (size, win)) GROUP BY r)
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
    """,
}
