"""Byte-level BPE encoding and decoding by replaying the merges over all words at once.

A worker lays the different new words of a batch side by side. An index from merge rank to the positions of its
pairs yields the ranks in order; a merge is applied to all its positions together, and only the pairs that touch a merged
one are looked up anew. This equals the usual word-by-word encoding, as no merge reaches over a word's end.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickwarden.llm.common import keyed_texts
from clickwarden.llm.words import CACHED_LENGTH, CACHED_WORDS

#: Characters of text whose new words are merged in one go, about.
REPLAY_CHARS = 32_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token to rank, from a file of lines `base64 rank`."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class MergeReplay:
    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.none = self.size  # as a rank: no merge
        self.token_bytes = [b""] * self.size
        for token, rank in ranks.items():
            self.token_bytes[rank] = token
        self.byte_ids = np.array([ranks[bytes([value])] for value in range(256)], np.int64)
        found = sorted((left * self.size + right, rank) for token, rank in ranks.items() for cut in range(1, len(token))
                       if (left := ranks.get(token[:cut])) is not None
                       and (right := ranks.get(token[cut:])) is not None)
        self.pairs = np.array([pair for pair, _ in found] or [-1], np.int64)
        self.merged = np.array([rank for _, rank in found] or [self.none], np.int64)
        # Merging a token of these may give a pair that goes before the token's own rank.
        self.steps_back = np.zeros(self.size + 1, bool)
        for side in (self.pairs // self.size, self.pairs % self.size):
            self.steps_back[side[self.merged < side]] = True

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, pair), self.pairs.size - 1)
        return np.where(self.pairs[at] == pair, self.merged[at], self.none)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as little-endian 32-bit bytes."""
        data = np.frombuffer(b"".join(words), np.uint8)
        end, lengths = data.size, np.fromiter(map(len, words), np.int64, len(words))
        if not end:
            return [b""] * len(words)
        word = np.repeat(np.arange(len(words)), lengths)
        token = np.append(self.byte_ids[data], -1)
        following, previous = np.arange(1, end + 2), np.arange(-1, end)
        last = np.flatnonzero(np.append(word[1:] != word[:-1], True))
        following[last] = end  # the place behind all words stands for a word's end
        previous[0] = end
        previous[last[:-1] + 1] = end
        rank = np.full(end + 1, self.none)
        inner = np.flatnonzero(following[:end] != end)
        rank[inner] = self.lookup(token[inner], token[following[inner]])
        alive = np.ones(end, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(places: np.ndarray) -> None:
            places = places[rank[places] < self.none]
            if places.size:
                ranks = rank[places]
                order = np.argsort(ranks, kind="stable")
                ranks, places = ranks[order], places[order]
                cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
                for key, part in zip(ranks[np.append(0, cuts)].tolist(), np.split(places, cuts), strict=True):
                    if key not in index:
                        heapq.heappush(heap, key)
                        index[key] = []
                    index[key].append(part)

        enter(inner)
        while heap:
            key = heapq.heappop(heap)
            parts = index.pop(key)
            places = parts[0] if len(parts) == 1 else np.concatenate(parts)
            places = places[rank[places] == key]
            if not places.size:
                continue
            if places.size > 1:
                places = np.unique(places)
                if self.steps_back[key]:  # one a word, in case a lower rank turns up beside it
                    first = np.append(True, word[places[1:]] != word[places[:-1]])
                    if not first.all():
                        index[key] = [places[~first]]
                        heapq.heappush(heap, key)
                        places = places[first]
                chained = following[places[:-1]] == places[1:]
                if chained.any():  # pairs that overlap: every other one, from the left
                    number = np.arange(places.size)
                    start = np.maximum.accumulate(np.where(np.append(True, ~chained), number, 0))
                    places = places[(number - start) % 2 == 0]
            gone = following[places]
            after = following[gone]
            token[places] = key
            following[places] = after
            previous[after] = places
            alive[gone] = False
            rank[gone] = self.none
            before = previous[places]
            inside = before != end
            before = before[inside]
            rank[before] = self.lookup(token[before], token[places[inside]])
            rank[places] = np.where(after != end, self.lookup(token[places], token[after]), self.none)
            enter(np.concatenate((before, places)))
        ids = token[:end][alive].astype("<u4").tobytes()
        stops = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bincount(word[alive], minlength=len(words)), out=stops[1:])
        stops = (4 * stops).tolist()
        return [ids[begin:stop] for begin, stop in zip(stops, stops[1:], strict=False)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))


class TextEncoder:
    """Texts to ids: words by a pattern, each new one encoded with the others of its group of texts."""

    def __init__(self, path: str, pattern: str):
        self.replay = MergeReplay(read_ranks(path))
        self.words = regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        known, words = self.known, [self.words.findall(text) for text in texts]
        if len(known) > CACHED_WORDS:
            known.clear()
        new = list({word for found in words for word in found if word not in known})
        known.update(zip(new, self.replay.encode([word.encode() for word in new]), strict=True))
        out = [b"".join(map(known.__getitem__, found)) for found in words]
        for word in new:
            if len(word) > CACHED_LENGTH:
                del known[word]
        return out


_encoders: dict[tuple[str, str], TextEncoder] = {}


def text_encoder(path: str, pattern: str) -> TextEncoder:
    """One for each file, pattern and worker."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = TextEncoder(path, pattern)
    return _encoders[path, pattern]


def _grouped(texts: pa.Array, most: int) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        group.append(text.as_py())
        size += len(group[-1])
        if size >= most:
            yield group
            group, size = [], 0
    yield group


def encode_texts(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): token ids of whole texts, without special tokens. Null and empty texts have no ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(ranks, pattern)
        for batch in batches:
            parts = [data for group in _grouped(batch.column(1), REPLAY_CHARS) for data in encoder.encode(group)]
            ends = np.append(0, np.cumsum([len(data) // 4 for data in parts], dtype=np.int32)).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(parts), "<i4"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), values)],
                                             names=["doc_id", "ids"])

    texts = keyed_texts(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", F.coalesce("text", F.lit(""))).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_ids(ids: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded binary): the bytes that the ids stand for. A null list decodes to no bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = text_encoder(ranks, "").replay
        for batch in batches:
            decoded = [replay.decode(np.array(found.as_py() or [], np.int64)) for found in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.binary())],
                                             names=["doc_id", "decoded"])

    rows = ids.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, decoded binary")


def round_trip_digests(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): both ways in one pass, keeping only digests."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(ranks, pattern)
        decimal = [str(value).encode() for value in range(encoder.replay.size)]
        for batch in batches:
            columns: tuple[list, list, list] = ([], [], [])
            for group in _grouped(batch.column(1), REPLAY_CHARS):
                for data in encoder.encode(group):
                    ids = np.frombuffer(data, "<u4")
                    columns[0].append(ids.size)
                    columns[1].append(hashlib.sha256(b",".join(map(decimal.__getitem__, ids.tolist()))).hexdigest())
                    columns[2].append(hashlib.sha256(encoder.replay.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()),
                 pa.array(columns[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    texts = keyed_texts(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", F.coalesce("text", F.lit(""))).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
