"""Ranked lexical search over impact vectors in buckets of similar length, after LEMP.

A document is a vector of impacts, one whole number for each term of the queries; a query is the set of its terms, and a score the sum
of a document's impacts there. Vectors are stored in order of their length. Going through them from the longest, the k-th best
score so far is a query's threshold. A bucket of neighbours is left out where the length of the query times that of its longest
vector is below (Cauchy-Schwarz), or the largest impacts of the bucket add up to less. Within a bucket only vectors are looked at
that have one of the coordinates without which the threshold is out of reach; those whose partial sum, with the lesser of both
bounds for the other coordinates, still falls short go. The rest get their exact scores.

Queries are taken in blocks whose terms have a bounded size in bytes; the documents are read once for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import nsmallest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from clickwarden.llm.common import saved
from clickwarden.llm.spans import WORD_PATTERN, Words, word_blocks

#: Bytes of the different terms of a block of queries, and queries of a block; a block of one query may have more bytes.
BLOCK_TERM_BYTES, BLOCK_QUERIES = 16_000_000, 10_000
#: Vectors of a bucket, and of a stored partition.
BUCKET, PARTITION = 2048, 65_536
#: Share of the stored partitions, those with the longest vectors, that give the first thresholds.
HEAD = 1 / 16


def lower_terms(text: Column) -> Column:
    """All terms of a text, in order; none for null."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), F.lit(WORD_PATTERN), 0)


class Vocabulary:
    """Numbers of terms, found by hashes of words and checked by their bytes."""

    def __init__(self, terms: list[str]):
        found = next(word_blocks(pa.array(["\n".join(terms)], pa.large_string()), most=1 << 62))
        order = np.argsort(found.hashes, kind="stable")
        self.hashes, self.numbers = found.hashes[order], order
        self.most_alike = int(np.unique(self.hashes, return_counts=True)[1].max())  # terms of one hash: 1, but for rare chance
        self.lengths = found.ends - found.starts
        self.starts, self.data = found.starts, np.frombuffer(found.data, np.uint8)

    def lookup(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Which words are terms, and those terms' numbers."""
        first = np.searchsorted(self.hashes, words.hashes)
        found = [self._same(words, np.minimum(first + step, len(self.hashes) - 1)) for step in range(self.most_alike)]
        return np.concatenate([places for places, _ in found]), np.concatenate([numbers for _, numbers in found])

    def _same(self, words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places = np.flatnonzero(self.hashes[at] == words.hashes)
        numbers = self.numbers[at[places]]
        lengths = (words.ends - words.starts)[places]
        same = lengths == self.lengths[numbers]
        data = np.frombuffer(words.data, np.uint8)
        for length in np.unique(lengths[same]):
            those = np.flatnonzero(same & (lengths == length))
            span = np.arange(length)
            same[those] = (data[words.starts[places[those], None] + span]
                           == self.data[self.starts[numbers[those], None] + span]).all(axis=1)
        return places[same], numbers[same]


def _counted(docs: DataFrame, terms) -> DataFrame:
    """(row, doc_id, n, ids, tfs): each document's number of terms, and its counts of the block's terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(terms.value)
        size = len(vocabulary.hashes)
        for batch in batches:
            counts, found, times = np.zeros(batch.num_rows, np.int64), [], []
            for words in word_blocks(batch.column(2)):
                counts += np.bincount(words.rows, minlength=batch.num_rows)
                places, numbers = vocabulary.lookup(words)
                keys, n = np.unique(words.rows[places] * size + numbers, return_counts=True)
                found.append(keys)
                times.append(n)
            keys, each = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_inverse=True)
            tfs = np.bincount(each, np.concatenate([np.zeros(0), *times]), len(keys)).astype(np.int64)
            ends = pa.array(np.searchsorted(keys, np.arange(batch.num_rows + 1) * size), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts),
                 pa.ListArray.from_arrays(ends, pa.array(keys % size, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))], names=["row", "doc_id", "n", "ids", "tfs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"row long, doc_id {kind}, n long, ids array<int>, tfs array<bigint>")


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and the row of each."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), sizes.astype(np.int64))


def _impacts(counted: DataFrame, weights, documents: int, total: int) -> DataFrame:
    """(row, doc_id, ids, impacts, length) of documents with an impact above 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.frombuffer(weights.value, np.int64)
        for batch in batches:
            ids, rows = _flat(batch.column(3))
            tfs, n = _flat(batch.column(4))[0], batch.column(2).to_numpy()
            m = 100 - 50 + (50 * n * documents) // max(total, 1)
            impacts = weight[ids] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[rows]))
            lengths = np.sqrt(np.bincount(rows, impacts.astype(float) ** 2, batch.num_rows))
            whole = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3),
                 pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(batch.num_rows + 1)), pa.int32()), pa.array(impacts)),
                 pa.array(lengths)], names=["row", "doc_id", "ids", "impacts", "length"])
            yield whole.filter(pa.array(lengths > 0))

    kind = counted.schema["doc_id"].dataType.simpleString()
    return counted.mapInArrow(run, f"row long, doc_id {kind}, ids array<int>, impacts array<bigint>, length double")


class Bucket:
    """Neighbours in order of length, with the places of each coordinate."""

    def __init__(self, batch: pa.RecordBatch):
        self.doc_ids = batch.column("doc_id")
        self.lengths = batch.column("length").to_numpy()
        ids, rows = _flat(batch.column("ids"))
        impacts = _flat(batch.column("impacts"))[0]
        order = np.argsort(ids, kind="stable")
        self.rows, self.impacts = rows[order], impacts[order]
        self.terms, self.starts = np.unique(ids[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(ids))
        self.largest = np.maximum.reduceat(self.impacts, self.starts) if len(ids) else np.zeros(0, np.int64)
        self.longest = float(self.lengths.max(initial=0.0))

    def search(self, terms: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of all vectors that score `least` or more with these terms, and maybe some others."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        slack = 1 + 1e-9  # lengths are rounded
        if not len(self.terms) or np.sqrt(len(terms)) * self.longest * slack < least:
            return none
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        at = at[self.terms[at] == terms]
        at = at[np.argsort(-self.largest[at], kind="stable")]
        rest = np.append(np.cumsum(self.largest[at][::-1])[::-1], 0)  # what coordinates from each place on can add
        if not len(at) or rest[0] < least:
            return none
        focus = int(np.searchsorted(-rest, -least, "right"))  # without the first so many the threshold is out of reach
        focus = min(max(focus, 1), len(at))
        sums, squares = np.zeros(len(self.lengths), np.int64), np.zeros(len(self.lengths))
        for place in at[:focus]:
            span = slice(self.starts[place], self.ends[place])
            sums[self.rows[span]] += self.impacts[span]
            squares[self.rows[span]] += self.impacts[span].astype(float) ** 2
        seen = np.flatnonzero(sums)
        others = len(at) - focus
        left = np.sqrt(np.maximum(self.lengths[seen] ** 2 * slack - squares[seen], 0) * others)
        kept = seen[sums[seen] + np.minimum(left, rest[focus]) * slack >= least]
        if others and len(kept):
            for place in at[focus:]:
                span = slice(self.starts[place], self.ends[place])
                sums[self.rows[span]] += self.impacts[span]
        scores = sums[kept]
        reached = scores >= least
        return kept[reached], scores[reached]


def _sort_key(found: tuple) -> tuple:
    score, doc_id = found
    return -score, doc_id is None, 0 if doc_id is None else doc_id


class Best:
    """The k best of one query so far, equal scores by id, nulls last."""

    def __init__(self, k: int, least: int):
        self.k, self.least, self.found = k, least, []

    def add(self, doc_ids: pa.Array, scores: np.ndarray) -> None:
        if len(scores) > self.k:  # what is below the k-th score of these alone is out
            cut = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            kept = np.flatnonzero(scores >= cut)
            doc_ids, scores = doc_ids.take(pa.array(kept)), scores[kept]
        self.found = nsmallest(self.k, [*self.found, *zip(scores.tolist(), doc_ids.to_pylist(), strict=True)], key=_sort_key)
        if len(self.found) == self.k:
            self.least = max(self.least, self.found[-1][0])


def _search(vectors: DataFrame, queries, k: int) -> DataFrame:
    """(query, doc_id, score): each task's best of each query, none below the query's threshold."""
    kind = vectors.schema["doc_id"].dataType
    arrow_kind = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {number: (np.array(terms, np.int64), Best(k, least)) for number, terms, least in queries.value}
        for batch in batches:
            for first in range(0, batch.num_rows, BUCKET):
                bucket = Bucket(batch.slice(first, BUCKET))
                for terms, own in best.values():
                    places, scores = bucket.search(terms, own.least)
                    if len(places):
                        own.add(bucket.doc_ids.take(pa.array(places)), scores)
        rows = [(number, doc_id, score) for number, (_, own) in best.items() for score, doc_id in own.found]
        yield pa.RecordBatch.from_arrays(
            [pa.array([row[0] for row in rows], pa.int32()), pa.array([row[1] for row in rows], arrow_kind),
             pa.array([row[2] for row in rows], pa.int64())], names=["query", "doc_id", "score"])

    return vectors.select("doc_id", "ids", "impacts", "length").mapInArrow(
        run, f"query int, doc_id {kind.simpleString()}, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(terms: DataFrame) -> list[DataFrame]:
    """The queries' terms in blocks by a hash of the query, each within the bounds unless one query alone exceeds them."""
    count = 1
    while True:
        dealt = terms.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(count)))
        sizes = dealt.groupBy("block").agg(
            F.sum(F.octet_length("term") + 1).alias("bytes"), F.count_distinct(F.xxhash64("item_id")).alias("queries"))
        most = sizes.agg(F.max(F.when(F.col("queries") > 1, F.greatest(
            F.col("bytes") / BLOCK_TERM_BYTES, F.col("queries") / BLOCK_QUERIES))).alias("x")).first()["x"]
        if most is None or most <= 1:
            return [dealt.where(F.col("block") == number).drop("block") for number in range(count)]
        count = max(count + 1, int(count * most * 1.5))


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's `k` highest-scoring documents with a score above 0, all if fewer.

    Terms are as in `spans`, all else whole numbers. With N documents that have a term, L their terms in all, n terms and tf of one term in a
    document, and df documents with that term: the term weighs w = floor(1000 * ln((2N + 2) / (2df + 1))), and the document
    scores the sum of w * (10^9 tf div (1000 tf + 20 m)) over the item's different terms, with m = 100 - 50 + (50 n N div L).

    Equal scores go by ascending doc_id, null last; each row is a document, repeated rows and ids too. Null and empty texts have no term and
    are never found. Rows of items with one item_id, null included, are one query of all their terms; an item without terms
    has no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    terms = saved(items.select(F.col(f"`{item_col}`").alias("item_id"), F.explode(lower_terms(F.col(f"`{item_text_col}`"))).alias("term"))
                  .distinct())
    out = spark.createDataFrame([], T.StructType([
        terms.schema["item_id"], T.StructField("rank", T.IntegerType()), rows.schema["doc_id"], T.StructField("score", T.LongType())]))
    for block in _blocks(terms):
        names = [row["term"] for row in block.select("term").distinct().orderBy("term").collect()]
        if not names:
            continue
        counted = saved(_counted(rows, spark.sparkContext.broadcast(names)))
        documents, total = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = counted.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("df"))
        weigh = F.floor(1000 * F.ln(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1))).cast("long")
        weights = np.zeros(len(names), np.int64)
        for row in held.select("id", weigh.alias("w")).collect():
            weights[row["id"]] = row["w"]
        vectors = _impacts(counted, spark.sparkContext.broadcast(weights.tobytes()), documents, total)
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-documents // PARTITION))
        stored = saved(vectors.repartitionByRange(parts, F.desc("length"), F.col("row")).sortWithinPartitions(
            F.desc("length"), "row").withColumn("part", F.spark_partition_id()))

        number = {name: at for at, name in enumerate(names)}
        queries: dict = {}
        for row in block.collect():
            queries.setdefault(row["item_id"], []).append(number[row["term"]])
        listed = [(at, sorted(of)) for at, of in enumerate(queries.values())]
        first = max(1, int(parts * HEAD))

        def send(least: dict[int, int]):
            return spark.sparkContext.broadcast([(at, of, least.get(at, 1)) for at, of in listed])

        head = saved(_top(_search(stored.where(F.col("part") < first), send({}), k), k))
        least = {row["query"]: row["score"] for row in head.where(F.col("rank") == k).select("query", "score").collect()}
        rest = _search(stored.where(F.col("part") >= first), send(least), k)
        ranked = _top(head.drop("rank").union(rest), k)
        named = spark.createDataFrame([(at, item) for at, item in enumerate(queries)], T.StructType([
            T.StructField("query", T.IntegerType()), terms.schema["item_id"]]))
        out = out.union(ranked.join(F.broadcast(named), "query").select("item_id", "rank", "doc_id", "score"))
    return out
