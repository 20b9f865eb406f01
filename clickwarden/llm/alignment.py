"""Alignment of two tokenizers over the same bytes.

Both tokenizers' tokens of a batch are frames of (document, start, end) in bytes. `pandas.merge_asof`, keyed by document, finds for each
token the other side's token that covers its start; the pairs of both directions together are all that overlap. Pairs whose ends
are equal close a group: the shortest stretches that both sides cut alike.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain
from unicodedata import category

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from clickwarden.llm.common import saved

#: Characters of texts that are aligned together, a single text may be longer, and ids' room within a pair's number.
BATCH_CHARS, ROOM = 500_000, 1 << 32
#: Id pairs, of 24 bytes, that are broadcast; more are joined by a shuffle.
BROADCAST_PAIRS = 1_000_000
#: Words that a worker keeps for a tokenizer before it starts anew.
KEPT_WORDS = 400_000
BLANK = "▁"

#: Texts of these characters alone are cut into words here; any others are left to the tokenizer as a whole.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\u024f]*")
_LATIN = [chr(number) for number in (*range(0x20, 0x7F), *range(0xA1, 0x250))]
_LETTERS, _NUMBERS = (re.escape("".join(mark for mark in _LATIN if category(mark)[0] == kind)) for kind in "LN")
#: The pattern by which the byte-level tokenizer cuts a text, for plain texts.
BYTE_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\\s{_LETTERS}{_NUMBERS}]+|\\s+(?!\\S)|\\s+")
#: Blanks and what follows them. No piece goes on over a blank, see `PieceTokens`.
PIECE_WORDS = re.compile(" +[^ ]*")


class WordIds:
    """Token ids of whole texts, whose words are each given to the tokenizer once, or nearly."""

    def __init__(self, words: re.Pattern, token_bytes: list[bytes]):
        self.words, self.token_bytes = words, token_bytes
        self.lengths = np.fromiter(map(len, token_bytes), np.int64, len(token_bytes))
        self.known: dict[str, bytes] = {}
        self.changed: set[str] = set()

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids one after the other, and how many each has."""
        raise NotImplementedError

    def text_ids(self, text: str) -> list[int]:
        raise NotImplementedError

    def encode(self, texts: list[str]) -> list[bytes | None]:
        """Ids of a blank and each text as 64-bit numbers; None for empty texts, and where the tokens' bytes are others than those."""
        known, uncut = self.known, self.words is None
        split = [None if uncut or not text or not PLAIN.fullmatch(text) else self.words.findall(f" {text}") for text in texts]
        if len(known) > KEPT_WORDS:
            known.clear()
            self.changed.clear()
        found = [None if words is None else list(map(known.get, words)) for words in split]
        if new := {word for words, ids in zip(split, found, strict=True) if words and None in ids
                   for word, own in zip(words, ids, strict=True) if own is None}:
            self._learn(list(new))
        out = []
        for text, words, ids in zip(texts, split, found, strict=True):
            if words is not None:
                changed = self.changed and not self.changed.isdisjoint(words)
                own = [known[word] if one is None else one for word, one in zip(words, ids, strict=True)] if None in ids else ids
                out.append(None if changed else b"".join(own))
            else:
                whole = self.text_ids(text) if text else []
                same = text and b"".join(map(self.token_bytes.__getitem__, whole)) == f" {text}".encode()
                out.append(array("q", whole).tobytes() if same else None)
        return out

    def _learn(self, words: list[str]) -> None:
        ids, counts = self.word_ids(words)
        spelled = [word.encode() for word in words]
        ends = np.append(0, np.cumsum(counts))
        sizes = np.diff(np.append(0, np.cumsum(self.lengths[ids]))[ends])
        data, flat, same = ids.tobytes(), ids.tolist(), sizes == np.fromiter(map(len, spelled), np.int64, len(words))
        if not same.all() or b"".join(map(self.token_bytes.__getitem__, flat)) != b"".join(spelled):
            self.changed.update(word for at, word in enumerate(words) if not same[at] or spelled[at] != b"".join(
                map(self.token_bytes.__getitem__, flat[ends[at]:ends[at + 1]])))
        places = (8 * ends).tolist()
        self.known.update(zip(words, map(data.__getitem__, map(slice, places, places[1:])), strict=True))


class ByteTokens(WordIds):
    """A byte-level tokenizer of the tokenizers library; special tokens' strings in texts are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        # Byte-level models spell a byte as itself if it prints, and the others, in order, from 256 on.
        shown = [byte for byte in range(256) if 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174]
        hidden = [byte for byte in range(256) if byte not in shown]
        spelled = {chr(byte): byte for byte in shown} | {chr(256 + number): byte for number, byte in enumerate(hidden)}
        tokens = {number: token for token, number in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        super().__init__(BYTE_WORDS, [
            bytes(map(spelled.__getitem__, token)) if spelled.keys() >= {*token} else token.encode()
            for number in range(max(tokens) + 1) for token in [tokens.get(number, "")]])

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        return np.array(found.ids, np.int64), np.bincount(np.array(found.word_ids, np.int64), minlength=len(words))

    def text_ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(f" {text}", add_special_tokens=False).ids


class PieceTokens(WordIds):
    """A sentencepiece model, which adds the blank before a text itself.

    Where no piece has a blank behind another character, no merge reaches over the beginning of a run of blanks, so texts can be cut
    there.
    """

    def __init__(self, path: str):
        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(number) for number in range(self.model.get_piece_size())]
        apart = all(BLANK not in piece.lstrip(BLANK) for piece in pieces)
        super().__init__(PIECE_WORDS if apart else None, [
            bytes([int(piece[3:5], 16)]) if self.model.is_byte(number) else piece.replace(BLANK, " ").encode()
            for number, piece in enumerate(pieces)])
        self.blank = [self.model.piece_to_id(BLANK)]

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [ids or self.blank for ids in self.model.encode([word[1:] for word in words], num_threads=1)]  # nothing is encoded to nothing
        counts = np.fromiter(map(len, found), np.int64, len(words))
        return np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum())), counts

    def text_ids(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


_tokenizers: dict[tuple[str, str], tuple] = {}


def _pair(path_a: str, path_b: str) -> tuple[ByteTokens, PieceTokens]:
    """One of each for a worker."""
    if (path_a, path_b) not in _tokenizers:
        _tokenizers[path_a, path_b] = ByteTokens(path_a), PieceTokens(path_b)
    return _tokenizers[path_a, path_b]


def token_frame(ids: list[bytes], lengths: np.ndarray) -> pd.DataFrame:
    """(doc, id, start, end) of all tokens; each document's bytes follow those of the one before, so starts ascend."""
    flat = np.frombuffer(b"".join(ids), np.int64)
    ends = np.cumsum(lengths[flat])
    docs = np.repeat(np.arange(len(ids)), [len(found) // 8 for found in ids])
    return pd.DataFrame({"doc": docs, "id": flat, "start": ends - lengths[flat], "end": ends})


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the tokens of `a` and of `b` that share a byte, each pair once; both sides cover the same bytes."""
    numbered_a, numbered_b = (side[["doc", "start"]].assign(number=np.arange(len(side))) for side in (a, b))
    to_b = pd.merge_asof(numbered_a, numbered_b, on="start", by="doc", suffixes=("_a", "_b"))
    to_a = pd.merge_asof(numbered_b, numbered_a, on="start", by="doc", suffixes=("_b", "_a"))
    # Tokens that start together find each other in both directions.
    again = a["start"].to_numpy()[to_a["number_a"]] == b["start"].to_numpy()
    return (np.concatenate([to_b["number_a"], to_a["number_a"][~again]]),
            np.concatenate([to_b["number_b"], to_a["number_b"][~again]]))


class Aligned:
    """The aligned tokens of some texts, whose bytes are those of both sides' tokens; `closed` marks the overlaps that end together."""

    def __init__(self, texts: list[str], byte_side: ByteTokens, piece_side: PieceTokens):
        found = list(zip(byte_side.encode(texts), piece_side.encode(texts), strict=True))
        self.covered = [a is not None and b is not None for a, b in found]
        self.a, self.b = (token_frame([ids[at] if good else b"" for ids, good in zip(found, self.covered, strict=True)], side.lengths)
                          for at, side in enumerate((byte_side, piece_side)))
        at_a, at_b = overlaps(self.a, self.b)
        self.overlapping = np.bincount(self.a["doc"].to_numpy()[at_a], minlength=len(texts))
        closed = self.a["end"].to_numpy()[at_a] == self.b["end"].to_numpy()[at_b]
        order = np.argsort(at_a[closed])
        self.last_a, self.last_b = at_a[closed][order], at_b[closed][order]  # each group's last tokens
        self.docs = self.a["doc"].to_numpy()[self.last_a]

    def linked(self) -> tuple[np.ndarray, np.ndarray]:
        """Each link's ids."""
        return self.a["id"].to_numpy()[self.last_a], self.b["id"].to_numpy()[self.last_b]

    def group_texts(self, names: list[np.ndarray]) -> list[str]:
        """Each document's groups as text; `names` has each id with a comma, a bar and a semicolon after it."""
        size_a, size_b = len(self.a), len(self.b)
        kind_a, kind_b = np.zeros(size_a, np.int64), np.zeros(size_b, np.int64)
        kind_a[self.last_a], kind_b[self.last_b] = 1, 2
        group_a = np.searchsorted(self.last_a, np.arange(size_a))
        group_b = np.searchsorted(self.last_b, np.arange(size_b))
        # A group's tokens of a come before those of b: move each by the other side's tokens before it.
        out = np.empty(size_a + size_b, object)
        out[np.arange(size_a) + np.append(0, self.last_b + 1)[group_a]] = names[0][kind_a, self.a["id"].to_numpy()]
        out[np.arange(size_b) + self.last_a[group_b] + 1] = names[1][kind_b, self.b["id"].to_numpy()]
        ends = np.cumsum([np.bincount(side["doc"], minlength=len(self.covered)) for side in (self.a, self.b)], axis=1).sum(axis=0)
        return ["".join(part)[:-1] for part in np.split(out, ends[:-1])] if len(ends) else []


def _names(size: int) -> np.ndarray:
    numbers = list(map(str, range(size)))
    return np.array([[number + mark for number in numbers] for mark in ",|;"], object)


def _batches(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= BATCH_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def align_tokens(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_overlaps, n_links, groups_sha256, pairs, times): each document's aligned tokens.

    `path_a` is a byte-level tokenizer and encodes a blank and the text, `path_b` a sentencepiece model, which puts the blank there itself.
    Groups are the shortest stretches of bytes that tokens of both sides begin and end with. Links are the pairs of tokens
    whose byte ranges end together; `pairs` has their different id pairs, a * 2^32 + b, and `times` how often each comes.
    `groups_sha256` digests `a1,a2|b1;a3|b2,b3`, the ids of each group.

    Null and empty texts, and those whose bytes a side does not give back whole, have no tokens: zeros, and an empty
    string for the digest. Repeated rows each have their own. Memory goes with the longest text. Other columns are not looked at.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _pair(path_a, path_b)
        names = [_names(len(side.token_bytes)) for side in sides]
        for batch in batches:
            first = 0
            for texts in _batches(batch.column(1).to_pylist()):
                yield _digested(batch.column(0).slice(first, len(texts)), Aligned(texts, *sides), names)
                first += len(texts)

    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_overlaps long, n_links long, "
                                 f"groups_sha256 string, pairs array<bigint>, times array<int>")


def _digested(doc_ids: pa.Array, found: Aligned, names: list[np.ndarray]) -> pa.RecordBatch:
    size = len(found.covered)
    texts = found.group_texts(names)
    digests = [hashlib.sha256(text.encode()).hexdigest() if text else "" for text in texts]
    a, b = found.linked()
    least = len(names[1][0])  # each b id is below
    links = np.sort((found.docs * len(names[0][0]) + a) * least + b)
    at = np.flatnonzero(np.append(True, links[1:] != links[:-1])) if len(links) else np.zeros(0, np.int64)
    different, b = np.divmod(links[at], least)
    docs, a = np.divmod(different, len(names[0][0]))
    ends = pa.array(np.searchsorted(docs, np.arange(size + 1)), pa.int32())
    groups = np.bincount(found.docs, minlength=size)
    arrays = [doc_ids, *(pa.array(np.bincount(side["doc"], minlength=size)) for side in (found.a, found.b)), pa.array(groups),
              pa.array(found.overlapping), pa.array(groups), pa.array(digests, pa.string()),
              pa.ListArray.from_arrays(ends, pa.array(a * ROOM + b)),
              pa.ListArray.from_arrays(ends, pa.array(np.diff(np.append(at, len(links))), pa.int32()))]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_a", "n_b", "n_groups", "n_overlaps", "n_links",
                                                     "groups_sha256", "pairs", "times"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, links, best): how many links hold each id pair, and whether no pair of its b id has more."""
    counts = saved(aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("found")).groupBy(
        F.col("found.pairs").alias("pair")).agg(F.sum("found.times").alias("links")))
    of_b = F.col("pair").bitwiseAND(F.lit(ROOM - 1)).alias("b")
    most = counts.groupBy(of_b).agg(F.max("links").alias("most"))
    return counts.select("pair", "links", of_b).join(most, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def link_support(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`align_tokens` without its arrays, and by the counts of id pairs over all documents: n_best, the links whose pair is
    the most frequent of its b id, ties included, and count_sum, the sum of the links' counts."""
    rows = saved(align_tokens(docs, path_a, path_b, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    counts = saved(pair_counts(rows))
    found = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("found")).select(
        "row", F.col("found.pairs").alias("pair"), F.col("found.times").alias("times"))
    counted = found.join(F.broadcast(counts) if counts.count() <= BROADCAST_PAIRS else counts, "pair")
    sums = counted.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("links")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return rows.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_overlaps", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
