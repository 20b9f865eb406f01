"""Best-fit packing: whole documents into sequences of a fixed number of tokens, by bin completion.

The plan needs only how many pieces there are of each length, at most `capacity` numbers however large the corpus is.
Bin completion runs over these counts: around the largest length left, a branch-and-bound search looks for the filling
with the least waste, starting from the best-fit filling as incumbent, and the pattern found is used as often as
the counts allow. Spark numbers the pieces of each length and places them by these numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickwarden.llm.common import keyed_texts, saved
from clickwarden.llm.words import word_encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces in one of the groups that are numbered apart, about; and the fewest groups.
GROUP_ROWS, LEAST_GROUPS = 20_000, 64
#: Nodes that the search for one filling may visit before it takes its incumbent.
SEARCH_NODES = 600


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's token ids and then `end_id`, cut into pieces of `capacity` where longer.

    A null text counts as empty and gives one piece with `end_id` alone. `tokenizer` is a tokenizers file whose
    pre-tokens never hold white space; special tokens' strings in a text are ordinary text. A row with a null id keeps it;
    rows with the same id are packed each.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        end = np.uint32(end_id).tobytes()
        for batch in batches:
            ids, columns = batch.column(0).to_pylist(), ([], [], [], [], [])
            for key, data in zip(ids, encoder.encode(batch.column(1)), strict=True):
                data += end
                for number, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at:at + 4 * capacity]
                    for column, value in zip(columns, (key, number, at // 4, len(part) // 4, zlib.crc32(part)),
                                             strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(columns, types, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    texts = keyed_texts(docs, id_col, text_col)
    return texts.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).mapInArrow(cut, PIECES)


def fillings(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(copies, [(length, times), ...]) until all are placed: the patterns by bin completion.

    The plan of best-fit fillings alone is the incumbent of the whole; it stays in the rare case that it needs fewer bins.
    """
    plans = [_plan(counts, capacity, complete) for complete in (
        _completion, lambda left, room: _best_fit(left, np.flatnonzero(left[:room + 1]), room)[0])]
    return min(plans, key=lambda plan: sum(copies for copies, _ in plan))


def _plan(counts: dict[int, int], capacity: int, complete: Callable[[np.ndarray, int], list[int]]):
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan = []
    for largest in range(capacity, 0, -1):
        while left[largest]:
            left[largest] -= 1
            times: dict[int, int] = {largest: 1}
            for length in complete(left, capacity - largest):
                times[length] = times.get(length, 0) + 1
            left[largest] += 1
            copies = int(min(left[length] // n for length, n in times.items()))
            for length, n in times.items():
                left[length] -= copies * n
            plan.append((copies, sorted(times.items(), reverse=True)))
    return plan


def _completion(left: np.ndarray, room: int) -> list[int]:
    """The lengths that fill `room` with the least waste, large ones first: a filling of large
    lengths dominates one of their parts, which stay free for other bins."""
    present = np.flatnonzero(left[:room + 1])
    if not present.size:
        return []
    smallest = int(present[0])
    best, waste = _best_fit(left, present, room)
    nodes, stack = SEARCH_NODES, [(room, room, [])]
    while stack and waste and nodes:
        free, most, chosen = stack.pop()
        nodes -= 1
        if free < waste:
            best, waste = chosen, free
        if free < smallest:
            continue  # nothing fits any more: its waste is known
        end = int(np.searchsorted(present, min(free, most), "right"))
        branches = []
        for length in present[max(0, end - 8):end]:
            length = int(length)
            if chosen.count(length) < left[length]:
                branches.append((free - length, length, [*chosen, length]))
        stack.extend(branches)  # the largest length is tried first
    return best


def _best_fit(left: np.ndarray, present: np.ndarray, room: int) -> tuple[list[int], int]:
    chosen: list[int] = []
    end = present.size
    while room:
        end = min(end, int(np.searchsorted(present, room, "right")))
        if not end:
            break
        length = int(present[end - 1])
        n = int(min(left[length], room // length))
        chosen += [length] * n
        room -= n * length
        end -= 1
    return chosen, room


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """The pieces with `sequence_id` and `offset`; every piece is placed once, none is cut further.

    An empty table gives an empty result. Pieces of the same length are alike to the plan, so ties and repeated rows go
    by doc_id and piece, and otherwise anyhow.
    """
    pieces = saved(pieces)  # numbering needs the same rows twice
    found = {row["length"]: row["n"] for row in
             pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    groups = max(LEAST_GROUPS, sum(found.values()) // GROUP_ROWS)
    firsts = {length: 0 for length in found}
    sequence, slots = 0, []  # length, first number, times, first sequence, offset
    for copies, pattern in fillings(found, capacity):
        offset = 0
        for length, times in pattern:
            slots.append((length, firsts[length], times, sequence, offset))
            firsts[length] += copies * times
            offset += length * times
        sequence += copies
    slots.sort()
    lengths, first, times, sequences, offsets = np.array(slots, np.int64).reshape(-1, 5).T

    def place(batches):
        for rows in batches:
            number, length = rows["number"].to_numpy(np.int64), rows["length"].to_numpy(np.int64)
            at = np.zeros(len(rows), np.int64)
            for one in np.unique(length):
                begin, end = np.searchsorted(lengths, [one, one + 1])
                mine = length == one
                at[mine] = begin + np.searchsorted(first[begin:end], number[mine], "right") - 1
            within = number - first[at]
            yield rows.drop(columns="number").assign(
                sequence_id=sequences[at] + within // times[at],
                offset=offsets[at] + within % times[at] * length)

    grouped = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    before = Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    starts = (grouped.groupBy("group", "length").agg(F.count(F.lit(1)).alias("n"))
              .select("group", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    order = Window.partitionBy("group", "length").orderBy("doc_id", "piece")
    numbered = (grouped.withColumn("rank", F.row_number().over(order)).join(starts, ["group", "length"])
                .select("doc_id", "piece", "start", "length", "ids_crc32",
                        (F.col("first") + F.col("rank") - 1).alias("number")))
    return numbered.mapInPandas(place, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents to placed pieces: `token_pieces`, then `pack`."""
    return pack(token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col), capacity)
