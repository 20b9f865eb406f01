"""N-gram Jaccard join: documents whose sets of word shingles are alike, as connected classes.

1. Documents with equal sets are one from here on.
2. Documents that agree on two minima of a set's hashes meet in a task, in blocks of bounded size, and are joined by a prefix
   tree: sets in one global order are stored in a trie, each set walks it level by level, the overlap with a shared beginning is
   counted once, and a subtree goes as soon as its overlap so far and the remaining lengths cannot reach the threshold.
   This links nearly all of each family; its classes only spare the next step pairs that are linked already.
3. What is left is exact: two sets that are alike share a shingle within their prefixes, in an order that puts frequent
   shingles last. Pairs of different classes that share enough of their prefixes are compared whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickwarden.llm.common import WORD, delete_folders, keyed_texts, noted, saved
from clickwarden.llm.components import components

#: Keys of a document in step 2, each of two minima; and about the most documents, and shingles, of a block.
BANDS, BLOCK, BLOCK_SHINGLES = 3, 4096, 1_000_000
#: Documents that a task holds the sets of at once.
GROUP = 512
#: Shingles that count as frequent: in so many documents of one batch at least, and so many of them by total count. They only
#: set the order, so the bound leaves nothing out; it keeps what reaches the driver and is broadcast below 4 MB.
FREQUENT, MOST_FREQUENT = 2, 200_000
#: Broadcast this many ids at most.
BROADCAST_ROWS = 1_000_000

_WORDS = re.compile(WORD.encode())
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_hashes(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; of the whole sequence, if it is shorter. A to Z count as a to z."""
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, _WORDS.findall(text.encode().lower())), np.uint64)
    if not words.size:
        return words
    length = min(n, words.size)
    rolled = np.zeros(words.size - length + 1, np.uint64)
    for at in range(length):
        rolled = _mix(rolled * _ODD + words[at:at + rolled.size])
    return np.unique(rolled)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.append(0, np.cumsum([part.size for part in parts])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def _parts(lists: pa.ListArray) -> list[np.ndarray]:
    """The lists as views of one array."""
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    return [values[begin:end] for begin, end in zip(ends, ends[1:], strict=False)]


def shingle_sets(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, fingerprint of the set (null if empty), keys for step 2, and the set itself, sorted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = [np.uint64(xxhash.xxh3_64_intdigest(bytes([at]))) for at in range(2 * BANDS)]
        for rows in (batch.slice(at, GROUP) for batch in batches for at in range(0, batch.num_rows, GROUP)):
            sets = [shingle_hashes(text.as_py(), n) for text in rows.column(1)]
            prints, keys = [], []
            for found in sets:
                prints.append(xxhash.xxh3_128_digest(found.tobytes()) if found.size else None)
                minima = [_mix(found ^ seed).min() for seed in seeds] if found.size else []
                keys.append([xxhash.xxh3_64_intdigest(minima[2 * at].tobytes() + minima[2 * at + 1].tobytes(), at)
                             - 2**63 for at in range(BANDS)] if found.size else [])
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array([found.size for found in sets], pa.int64()), pa.array(prints, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64())), _lists([found.view(np.int64) for found in sets])],
                names=["doc_id", "n_shingles", "print", "keys", "shingles"])

    texts = keyed_texts(docs, id_col, text_col).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))
    return texts.mapInArrow(
        run, "doc_id long, n_shingles long, print binary, keys array<long>, shingles array<long>")


class PrefixTree:
    """Sets in one order as a trie whose chains are single nodes; a walk gives the sets that are alike."""

    def __init__(self, sets: list[np.ndarray]):
        tokens, ranks = np.unique(np.concatenate(sets), return_inverse=True)
        counts = np.bincount(ranks)
        order = np.empty(tokens.size, np.int64)
        order[np.argsort(-counts, kind="stable")] = np.arange(tokens.size)  # frequent first: long common beginnings
        ends = np.cumsum([found.size for found in sets])
        self.sets = [np.sort(part) for part in np.split(order[ranks], ends[:-1])]
        self.vocabulary = tokens.size
        by_path = sorted(range(len(sets)), key=lambda at: self.sets[at].astype(">u4").tobytes())
        self.parent, self.segments, self.members = [-1], [np.zeros(0, np.int64)], {}
        self.shortest, self.longest = [], []
        stack, previous = [(0, 0)], None  # (node, its depth)
        for at in by_path:
            path = self.sets[at]
            if previous is not None:
                size = min(previous.size, path.size)
                differs = np.flatnonzero(previous[:size] != path[:size])
                shared = int(differs[0]) if differs.size else size
                last = None
                while stack[-1][1] > shared:
                    last = stack.pop()
                if stack[-1][1] < shared:  # cut the chain in two
                    upper, depth = len(self.parent), stack[-1][1]
                    segment = self.segments[last[0]]
                    self.parent.append(stack[-1][0])
                    self.segments.append(segment[:shared - depth])
                    self.segments[last[0]] = segment[shared - depth:]
                    self.parent[last[0]] = upper
                    stack.append((upper, shared))
            if stack[-1][1] < path.size:
                node, depth = len(self.parent), stack[-1][1]
                self.parent.append(stack[-1][0])
                self.segments.append(path[depth:])
                stack.append((node, path.size))
            self.members.setdefault(stack[-1][0], []).append(at)
            previous = path
        self._index()

    def _index(self) -> None:
        nodes = len(self.parent)
        children: list[list[int]] = [[] for _ in range(nodes)]
        for node, parent in enumerate(self.parent[1:], 1):
            children[parent].append(node)
        levels, level = [], [0]
        while level:
            levels.append(level)
            level = [child for node in level for child in children[node]]
        self.depth = np.zeros(nodes, np.int64)
        self.shortest, self.longest = np.full(nodes, 2**40), np.zeros(nodes, np.int64)
        sizes = [segment.size for segment in self.segments]
        for level in levels:
            for node in level:
                self.depth[node] = sizes[node] + (self.depth[self.parent[node]] if node else 0)
        for level in reversed(levels):
            for node in level:
                if node in self.members:
                    self.shortest[node] = min(self.shortest[node], self.depth[node])
                    self.longest[node] = max(self.longest[node], self.depth[node])
                for child in children[node]:
                    self.shortest[node] = min(self.shortest[node], self.shortest[child])
                    self.longest[node] = max(self.longest[node], self.longest[child])
        self.child_counts = np.array([len(found) for found in children])
        self.child_starts = np.append(0, np.cumsum(self.child_counts))[:-1]
        self.children = np.array([child for found in children for child in found], np.int64)
        self.tokens = np.concatenate(self.segments)
        self.stops = np.cumsum(sizes)
        self.starts = self.stops - sizes
        self.own = np.zeros(nodes, bool)
        self.own[list(self.members)] = True

    def alike(self, at: int, percent: int) -> list[int]:
        """The sets with 100 * intersection >= percent * union, itself included."""
        query = self.sets[at]
        member = np.zeros(self.vocabulary, bool)
        member[query] = True
        counts = np.append(0, np.cumsum(member[self.tokens]))
        nodes, overlap, found = np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while nodes.size:
            hits = nodes[self.own[nodes]]
            if hits.size:
                shared = overlap[self.own[nodes]]
                union = query.size + self.depth[hits] - shared
                for node in hits[100 * shared >= percent * union].tolist():
                    found += self.members[node]
            many = self.child_counts[nodes]
            starts = np.repeat(self.child_starts[nodes] - np.cumsum(many) + many, many)
            below = self.children[starts + np.arange(starts.size)]
            shared = np.repeat(overlap, many) + counts[self.stops[below]] - counts[self.starts[below]]
            # At best all that remains of the shorter side is shared, by the set below that this suits best.
            rest = np.minimum(self.longest[below] - self.depth[below], query.size - shared)
            best = shared + rest
            size = np.maximum(self.shortest[below], self.depth[below] + rest)
            keep = 100 * best >= percent * (query.size + size - best)
            nodes, overlap = below[keep], shared[keep]
        return found


def _block_links(percent: int):
    def links(rows: pd.DataFrame) -> pd.DataFrame:
        ids, sets = rows["doc_id"].to_numpy(), [np.asarray(found, np.int64) for found in rows["shingles"]]
        tree, root = PrefixTree(sets), list(range(len(sets)))

        def top(at: int) -> int:
            while root[at] != at:
                root[at] = at = root[root[at]]
            return at

        for at in range(len(sets)):
            for other in tree.alike(at, percent):
                one, two = top(at), top(other)
                if ids[one] > ids[two]:
                    one, two = two, one
                root[two] = one
        tops = [top(at) for at in range(len(sets))]
        pairs = [(ids[at], ids[one]) for at, one in enumerate(tops) if at != one]
        return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")

    return links


def _only(frame: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is in `ids` (distinct), by a broadcast where that is small."""
    return frame.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id", "left_semi")


def _small(rows: DataFrame) -> DataFrame:
    """The saved rows, of three numbers at most, to be broadcast where they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _told_apart(keyed: DataFrame) -> DataFrame:
    """Rows of one key of each group of keys that the same documents share: a family that agrees on all keys meets once.

    Groups are told apart by size and 128 bits over their members.
    """
    groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("x"),
                                      F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y")).where("n > 1")
    one = saved(groups.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"))
    return keyed.join(_small(one), "key", "left_semi")


def _blocks(keyed: DataFrame, seed: int) -> DataFrame:
    """Documents that share a key with others, and their block among them."""
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("m")).where("n > 1")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("m") / BLOCK_SHINGLES))
    return saved(keyed.join(sizes, "key").select(
        "doc_id", "key", "n_shingles", F.pmod(F.xxhash64("doc_id", F.lit(seed)), blocks).alias("block"),
        (blocks > 1).alias("split")))


def _family_links(every: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """Step 2: links within blocks of documents that agree on a key."""
    one = (every["print"] == firsts["print"]) & (every["doc_id"] == firsts["first"])
    keyed = every.select("doc_id", "print", "n_shingles", "keys").join(firsts, one, "left_semi").dropDuplicates(["print"])
    met = _blocks(_told_apart(saved(keyed.select("doc_id", "n_shingles", F.explode(F.array_distinct("keys")).alias("key")))), 7)
    active = saved(_only(every.select("doc_id", "shingles"), saved(met.select("doc_id").distinct())))

    def within(blocks: DataFrame) -> DataFrame:
        return saved(active.join(_small(blocks.select("doc_id", "key", "block")), "doc_id").groupBy("key", "block")
                     .applyInPandas(_block_links(percent), "a long, b long"))

    links, split = within(met), met.where("split")
    seed = 11
    while not split.isEmpty():  # the families of different blocks meet through their smallest documents
        roots = components(links)
        tops = split.join(roots, split["doc_id"] == roots["node"], "left_anti").select("doc_id", "n_shingles", "key")
        again = _blocks(tops, seed)
        more = within(again)
        if more.isEmpty():
            break
        links, split, seed = saved(links.union(more)), again.where("split"), seed + 1
    return links


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and their ranks, the most frequent last. At most MOST_FREQUENT."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, counts = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            often = counts >= FREQUENT
            yield pa.RecordBatch.from_arrays([pa.array(tokens[often]), pa.array(counts[often])], names=["token", "n"])

    totals = (sets.where("n_shingles > 0").select("shingles").mapInArrow(count, "token long, n long")
              .groupBy("token").agg(F.sum("n").alias("n")))
    found = totals.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).toPandas()["token"].to_numpy(np.int64)
    order = np.argsort(found, kind="stable")
    return found[order], len(found) - order


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(doc_id, size, tokens): each set's prefix; two sets that are alike share one of these shingles at least."""
    shared = sets.sparkSession.sparkContext.broadcast(_frequent(sets))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ranks = shared.value
        for rows in (batch.slice(at, GROUP) for batch in batches for at in range(0, batch.num_rows, GROUP)):
            parts = []
            for found in _parts(rows.column(2)):
                rank = np.zeros(found.size, np.int64)
                if tokens.size:
                    at = np.minimum(np.searchsorted(tokens, found), tokens.size - 1)
                    rank = np.where(tokens[at] == found, ranks[at], 0)
                length = found.size + (-percent * found.size // 100) + 1
                parts.append(found[np.lexsort((found, rank))[:length]])
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1).cast(pa.int32()), _lists(parts)],
                                             names=["doc_id", "size", "tokens"])

    return sets.where("n_shingles > 0").select("doc_id", "n_shingles", "shingles").mapInArrow(
        cut, "doc_id long, size int, tokens array<long>")


def _rest_links(every: DataFrame, firsts: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Step 3: all links between documents of different classes.

    Of a set's prefix only shingles that stand in another class's prefix too can be shared there: what two sets share before a common
    shingle of both prefixes is in both prefixes. `before` counts these; the rest of what stands before is its own.
    """
    ones = saved(firsts.select(F.col("first").alias("doc_id")).distinct().join(
        roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("root")))
    prefixes = saved(_prefixes(every, percent).join(_small(ones), "doc_id").select(
        F.posexplode("tokens").alias("place", "token"), "doc_id", "size", "root"))
    shared = saved(prefixes.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where(
        "low < high").select("token"))
    met = prefixes.join(_small(shared), "token").withColumn(
        "before", F.count(F.lit(1)).over(Window.partitionBy("doc_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)))
    rows = saved(met.where(100 * (F.col("before") + F.col("size") - F.col("place")) >= percent * F.col("size")))
    left, right = (rows.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("doc_id", "size", "root", "place", "before")])
                   for side in ("a", "b"))
    needed = F.ceil(percent * (F.col("size_a") + F.col("size_b")) / (100 + percent))
    # At most the shared ones before both places, this one and those behind both are shared.
    reach = F.least("before_a", "before_b") + F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    pairs = left.join(right, "token").where(
        (F.col("doc_id_a") < F.col("doc_id_b")) & (F.col("root_a") != F.col("root_b")) & (reach >= needed))
    # Behind its prefix a set has ceil(percent * size / 100) - 1 shingles, and of one of the two no more can be shared.
    behind = F.ceil(percent * F.greatest("size_a", "size_b") / 100) - 1
    likely = saved(pairs.groupBy(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"), "size_a", "size_b")
                   .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") + behind >= needed).select("a", "b"))
    ids = saved(likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    whole = saved(_only(every.select("doc_id", "shingles"), ids))
    first, second = whole.toDF("a", "shingles_a"), whole.toDF("b", "shingles_b")
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return (likely.join(first, "a").join(second, "b").withColumn("both", both)
            .where(100 * F.col("both") >= percent * (F.size("shingles_a") + F.size("shingles_b") - F.col("both")))
            .select("a", "b"))


def near_duplicates(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id, a row for each row of `docs`.

    Two documents link when 100 * intersection >= percent * union of their sets of n-word shingles; component_id is the
    smallest doc_id that links reach. Texts without a word (null too) have no set and link with nothing. Shingles are
    compared by 64-bit hashes, whole sets by 128-bit ones. Rows that share an id are one document with several texts.
    """
    every = saved(shingle_sets(docs, n, id_col, text_col))
    firsts = saved(every.where("n_shingles > 0").groupBy("print").agg(F.min("doc_id").alias("first")))
    with noted() as folders:
        family = _family_links(every, firsts, percent)
    delete_folders(folders, family)
    with noted() as folders:
        rest = saved(_rest_links(every, firsts, components(family), percent))
    delete_folders(folders, rest)
    roots = components(family.union(rest))
    named = every.select("doc_id", "n_shingles", "print").join(firsts, "print", "left").withColumn(
        "first", F.coalesce("first", "doc_id"))
    return named.join(roots, named["first"] == roots["node"], "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "first").alias("component_id"))
