"""Benchmark decontamination by winnowing.

Of every run of `window - gram + 1` word grams the least hash is kept, on both sides alike, so a passage of `window` words that a
document shares with an item has a kept gram in common. Documents' fingerprints are joined with those of the items, and each hit is
extended to the windows around it, which are compared as a whole by 128 bits. Items shorter than a window are one window and one
gram each, and then all grams of that length are kept.

A filter of a size fixed by the number of fingerprints (32 MB at most) sorts out documents' grams before they leave the task that
reads them; what it lets through by chance falls out in the join. Larger filters are not built: more passes then, nothing is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickwarden.llm.common import saved
from clickwarden.llm.spans import Words, mixed, word_blocks

#: Bits of the filter for each fingerprint, and the fewest and most bits, a power of two each.
FILTER_BITS, LEAST_BITS, MOST_BITS = 64, 1 << 20, 1 << 28
#: Fingerprints or windows, of 40 bytes or less, that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def winnowed(hashes: np.ndarray, run: int) -> np.ndarray:
    """Marks what holds the least hash of some `run` neighbours, or of all where there are fewer."""
    run = min(run, len(hashes))
    if run <= 1:
        return np.ones(len(hashes), bool)
    least = _sliding(hashes, run, np.minimum)
    edge = np.zeros(run - 1, np.uint64)
    return _sliding(np.concatenate([edge, least, edge]), run, np.maximum) == hashes


def _sliding(values: np.ndarray, run: int, pick: np.ufunc) -> np.ndarray:
    """`pick` over each `run` neighbours, by runs that double."""
    done = 1
    while done < run:
        step = min(done, run - done)
        values = pick(values[:-step], values[step:])
        done += step
    return values


def gram_hashes(words: Words, length: int) -> np.ndarray:
    """A hash for the words that begin at each place; the greatest number where a text ends before."""
    hashes, size = words.hashes, len(words.hashes)
    out = np.full(size, _NONE)
    if size >= length:
        found = hashes[:size - length + 1].copy()
        for step in range(1, length):
            found = found * np.uint64(0x9E3779B97F4A7C15) + hashes[step:size - length + 1 + step]
        out[:found.size] = np.where(words.rows[:found.size] == words.rows[length - 1:], mixed(found) >> np.uint64(1), _NONE)
    return out


class Fingerprints:
    """Kept grams of `words`, and the windows that a kept gram may lie in."""

    def __init__(self, words: Words, size: int, window: int, gram: int):
        self.words, self.size = words, size
        self.gram = gram if size == window else size
        self.reach = size - self.gram
        self.hashes = gram_hashes(words, self.gram)
        self.places = np.flatnonzero(winnowed(self.hashes, self.reach + 1) & (self.hashes != _NONE))
        self.keys: dict[int, bytes] = {}

    def key(self, first: int) -> bytes:
        if (found := self.keys.get(first)) is None:
            found = self.keys[first] = hashlib.blake2b(self.words.text(first, self.size), digest_size=16).digest()
        return found

    def windows(self, place: int) -> range:
        """First words of the windows around the gram at `place` that lie within its text."""
        rows = self.words.rows
        firsts = range(max(0, place - self.reach), min(place, len(rows) - self.size) + 1)
        within = [first for first in firsts if rows[first] == rows[place] == rows[first + self.size - 1]]
        return range(within[0], within[-1] + 1) if within else range(0)


class GramFilter:
    """A bit for the high bits of each fingerprint."""

    def __init__(self, bits: int, packed: np.ndarray):
        self.shift, self.packed = np.uint64(63 - (bits.bit_length() - 1)), packed

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _item_windows(items: DataFrame, window: int, gram: int) -> DataFrame:
    """(item, size, grams array<long>, keys array<binary>): kept grams and all windows of each item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                grams, keys, size = set(), set(), 0
                for words in word_blocks(batch.column(1).slice(row, 1), window + gram):
                    if not len(words.hashes):
                        continue
                    size = min(window, max(size, int(words.numbers[-1]) + 1))
                    found = Fingerprints(words, min(size, len(words.hashes)), window, gram)
                    grams.update(found.hashes[found.places].astype(np.int64).tolist())
                    keys.update(map(found.key, range(len(words.hashes) - found.size + 1)))
                if size:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(row, 1), pa.array([size], pa.int32()),
                         pa.array([list(grams)], pa.list_(pa.int64())), pa.array([list(keys)], pa.list_(pa.binary()))],
                        names=["item", "size", "grams", "keys"])

    return items.mapInArrow(run, "item string, size int, grams array<bigint>, keys array<binary>")


def _gram_filter(prints: DataFrame, count: int) -> tuple[int, bytes]:
    """The filter's bits, gathered as pages of 4 KB."""
    bits = min(max(1 << (FILTER_BITS * count - 1).bit_length(), LEAST_BITS), MOST_BITS)
    at = F.shiftright("gram", 63 - (bits.bit_length() - 1)) + 1
    pages = prints.select(F.bitmap_bucket_number(at).alias("page"), F.bitmap_bit_position(at).alias("bit")).groupBy("page").agg(
        F.bitmap_construct_agg("bit").alias("bits")).collect()
    packed = bytearray(bits // 8)
    for page in pages:
        packed[(page["page"] - 1) * 4096:page["page"] * 4096] = page["bits"]
    return bits, bytes(packed[:bits // 8])


def _scan(docs: DataFrame, sizes: list[int], bits: int, packed, window: int, gram: int) -> DataFrame:
    """Each document's words and what passes the filter: a gram and a window around it in each place of the arrays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = GramFilter(bits, np.frombuffer(packed.value, np.uint8))
        for batch in batches:
            counts = np.zeros(batch.num_rows, np.int64)
            hits: list[tuple[int, int, int, int, bytes]] = []
            for words in word_blocks(batch.column(2), window + gram):
                np.maximum.at(counts, words.rows, words.numbers + 1)
                for size in sizes:
                    found = Fingerprints(words, size, window, gram)
                    near = found.places[grams.may_hold(found.hashes[found.places])]
                    for place, value in zip(near.tolist(), found.hashes[near].astype(np.int64).tolist(), strict=True):
                        hits += [(int(words.rows[place]), value, int(words.numbers[first]), size, found.key(first))
                                 for first in found.windows(place)]
            hits.sort(key=lambda hit: hit[0])
            ends = np.append(0, np.cumsum(np.bincount([hit[0] for hit in hits], minlength=batch.num_rows)))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
            arrays = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([hit[at] for hit in hits], kind))
                      for at, kind in enumerate(kinds, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts), *arrays],
                                             names=["row", "doc_id", "n_words", "gram", "first", "size", "key"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"row long, doc_id {kind}, n_words long, gram array<bigint>, first array<int>, "
                                f"size array<int>, key array<binary>")


def _small(frame: DataFrame) -> DataFrame:
    """The frame, of rows of fixed size, marked for broadcast where it has few enough."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def _alike(keyed: DataFrame) -> DataFrame:
    """(key, like): for each window one window, the same for all that stand in the same items.

    Told by the count and two 64-bit sums of the items, so that items with a common preamble give one window, not one for each
    of its words, and no list of items is gathered.
    """
    sums = keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("item")).alias("x"),
        F.bit_xor(F.xxhash64("item", F.lit(1))).alias("y"))
    first = sums.groupBy("n", "x", "y").agg(F.min("key").alias("like"))
    return sums.join(first, ["n", "x", "y"]).select("key", "like")


def _covered() -> Column:
    """Words that a window covers and none that begins before it does."""
    order = Window.partitionBy("row").orderBy("first", "size")
    before = F.max(F.col("first") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return F.greatest(F.lit(0), F.col("first") + F.col("size") - F.greatest("first", F.coalesce(before, F.lit(0))))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, gram: int = 5, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, items, n_items, items_sha256, contaminated): what each document shares with the items.

    Words: see `spans`. A window is `window` words of an item on end, or all of an item that has fewer; `n_hit` counts the
    document's words within an occurrence of a window, `items` are the ids, as strings in order, of items with such windows.

    Null and empty texts have no words and are never hit. An item without an id, or without a word, takes no part; items that share
    an id count once. Repeated rows and ids of documents each get a row of their own. Other columns are not looked at.
    """
    if not 1 <= gram <= window:
        raise ValueError(f"gram must be from 1 to window, not {gram!r}")
    tested = saved(_item_windows(items.select(F.col(f"`{item_col}`").cast("string").alias("item"),
                                              F.coalesce(F.col(f"`{item_text_col}`"), F.lit("")).alias("text"))
                                 .where(F.col("item").isNotNull()), window, gram))
    keyed = saved(tested.select("item", F.explode("keys").alias("key")).distinct())
    prints = saved(tested.select(F.explode("grams").alias("gram")).distinct())
    alike = saved(_alike(keyed))
    sizes = [row["size"] for row in tested.select("size").distinct().orderBy("size").collect()]
    bits, packed = _gram_filter(prints, max(prints.count(), 1))
    sent = docs.sparkSession.sparkContext.broadcast(packed)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    scanned = saved(_scan(rows, sizes, bits, sent, window, gram))

    near = scanned.where(F.size("gram") > 0).select("row", F.explode(F.arrays_zip("gram", "first", "size", "key")).alias("hit"))
    hits = near.select("row", "hit.*").join(_small(prints), "gram", "left_semi").join(_small(alike), "key").select(
        "row", "first", "size", "like").distinct()
    marked = hits.withColumn("covered", _covered()).groupBy("row").agg(
        F.sum("covered").alias("n_hit"), F.array_sort(F.collect_set("like")).alias("likes"))
    marked = saved(marked.withColumn("kind", F.sha2(F.array_join(F.transform("likes", F.hex), ""), 256)))
    # Documents that are hit by the same windows have the same items, so the items are listed once for all of them.
    kinds = marked.groupBy("kind").agg(F.first("likes").alias("likes")).select("kind", F.explode("likes").alias("key"))
    named = saved(kinds.join(keyed, "key").groupBy("kind").agg(F.array_sort(F.collect_set("item")).alias("items")))
    none = F.array().cast("array<string>")
    listed = marked.select("row", "n_hit", "kind").join(named, "kind")
    out = scanned.select("row", "doc_id", "n_words").join(listed.select("row", "n_hit", "items"), "row", "left")
    items_found = F.coalesce("items", none)
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), items_found.alias("items"),
                      F.size(items_found).cast("long").alias("n_items"),
                      F.sha2(F.array_join(items_found, ","), 256).alias("items_sha256"),
                      F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))
