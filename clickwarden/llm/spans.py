"""Words of many texts at once, by array operations on their UTF-8 bytes.

A word is a run of digits, ASCII letters and characters beyond ASCII, with A-Z lower-cased. All bytes of a character beyond
ASCII are above 127, so words can be cut in the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from string import ascii_letters, ascii_lowercase, ascii_uppercase, digits

import numpy as np
import pyarrow as pa

#: What separates these words, as a regular expression that Java, Python and DuckDB read alike.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text that are looked at together; a longer text is cut between words.
BLOCK_BYTES = 1 << 20

_LOWER = bytes.maketrans(ascii_uppercase.encode(), ascii_lowercase.encode())
_IN_WORD = np.zeros(256, bool)
_IN_WORD[128:] = True
_IN_WORD[list((ascii_letters + digits).encode())] = True
#: An odd number and its inverse modulo 2^64: a word's hash is its polynomial there, moved to its first byte.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


@dataclass
class Words:
    """The words of some texts of a batch, in order: of each its text, its number there, its bytes and a 64-bit hash."""

    data: bytes
    rows: np.ndarray
    numbers: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray

    def text(self, first: int, count: int) -> bytes:
        """So many words from the `first` on, with blanks between them."""
        return b" ".join([self.data[self.starts[at]:self.ends[at]] for at in range(first, first + count)])


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit numbers with their bits stirred."""
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def word_blocks(texts: pa.Array, overlap: int = 0, most: int = BLOCK_BYTES) -> Iterator[Words]:
    """All words of the texts, block by block.

    A text of more than `most` bytes comes in several blocks; each but the first repeats the last `overlap` words before it.
    Null and empty texts have no words.
    """
    offsets, data = _bytes(texts)
    row, size = 0, len(offsets) - 1
    while row < size:
        if offsets[row + 1] - offsets[row] > most:
            yield from _parts(data, row, int(offsets[row]), int(offsets[row + 1]), overlap, most)
            row += 1
            continue
        last = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        yield _words(data[offsets[row]:offsets[last]], offsets[row:last + 1] - offsets[row], row)
        row = last


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint8)
    found = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    return found.astype(np.int64), np.frombuffer(data, np.uint8)


def _parts(data: np.ndarray, row: int, start: int, end: int, overlap: int, most: int) -> Iterator[Words]:
    number, reach = 0, most
    while True:
        stop = _break(data, min(start + reach, end), end)
        words = _words(data[start:stop], np.array([0, stop - start]), row)
        found = len(words.starts)
        if stop < end and found <= overlap:  # words longer than the block: nothing would be gained
            reach *= 2
            continue
        words.numbers += number
        yield words
        if stop == end:
            return
        kept = min(overlap, found)
        start, number, reach = start + int(words.starts[found - kept]) if kept else stop, number + found - kept, most


def _break(data: np.ndarray, stop: int, end: int) -> int:
    """The first place from `stop` on that is not within a word."""
    while stop < end:
        outside = np.flatnonzero(~_IN_WORD[data[stop:stop + 4096]])
        if outside.size:
            return min(stop + int(outside[0]), end)
        stop += 4096
    return end


def _words(text: np.ndarray, offsets: np.ndarray, first_row: int) -> Words:
    data = text.tobytes().translate(_LOWER)
    low = np.frombuffer(data, np.uint8)
    inside = _IN_WORD[low]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < low.size)]  # a text's end ends its last word
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.zeros(low.size + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _power(_BASE, low.size), out=sums[1:])
    hashes = mixed((sums[stops] - sums[starts]) * _power(_INVERSE, low.size + 1)[starts])
    rows = np.searchsorted(offsets, starts, "right") - 1
    numbers = np.arange(starts.size) - np.searchsorted(starts, offsets)[rows]
    return Words(data, rows + first_row, numbers, starts, stops, hashes)


def _power(base: int, count: int) -> np.ndarray:
    """The first powers of `base` modulo 2^64."""
    if base not in _powers or len(_powers[base]) < count:
        size = max(count, BLOCK_BYTES + 1)
        found = np.full(size, base, np.uint64)
        found[0] = 1
        _powers[base] = np.cumprod(found)
    return _powers[base][:count]
