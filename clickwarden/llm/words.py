"""Token ids of texts word by word: a worker gives each word to the tokenizer once, or nearly."""

from __future__ import annotations

import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from string import punctuation
from unicodedata import is_normalized

import pyarrow as pa
from tokenizers import Tokenizer

#: Words, and parts of words, that a worker keeps before it starts anew, and the longest kept.
CACHED_WORDS, CACHED_LENGTH = 500_000, 64


class WordEncoder:
    """Texts to ids as little-endian 32-bit bytes, by a tokenizer that never joins over white space."""

    #: Python's split() takes these four for white space and the tokenizer does not.
    odd = re.compile("[\x1c-\x1f]")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        # Byte-level models spell a byte as itself if it prints, and the others, in order, from 256 on.
        hidden = [byte for byte in range(256) if not (33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174)]
        self.spelling = {byte: 256 + number for number, byte in enumerate(hidden)}
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        known = self.known
        for text in texts:
            text = text.as_py()
            if self.odd.search(text):
                yield array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
                continue
            words = text.split()
            try:
                yield b"".join(map(known.__getitem__, words))
            except KeyError:
                long = self._learn(words)
                yield b"".join(map(known.__getitem__, words))
                for word in long:
                    del known[word]

    def _learn(self, words: list[str]) -> list[str]:
        """Enters the ids of all of `words`; returns those too long to be kept."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        if len(self.parts) > CACHED_WORDS:
            self.parts.clear()
        new = list(set(words).difference(self.known))
        whole = []
        for word in new:
            core = word.rstrip(punctuation)
            small = core.lower()
            if core.isalpha() and len(small) == len(core) and (core.isascii() or is_normalized("NFC", core)) \
                    and "Σ" not in core:
                self.known[word] = self._part(small) + self._part(word[len(core):])
            else:
                whole.append(word)
        found = self.tokenizer.encode(whole, is_pretokenized=True, add_special_tokens=False)
        ids, at = array("I", found.ids).tobytes(), 0
        counts = Counter(found.word_ids)
        for number, word in enumerate(whole):
            self.known[word] = ids[at:(at := at + 4 * counts[number])]
        return [word for word in new if len(word) > CACHED_LENGTH]

    def _part(self, part: str) -> bytes:
        """Ids of a run of small letters or of marks: what the tokenizer gives to its model as one piece."""
        if (found := self.parts.get(part)) is None:
            spelled = part if part.isascii() else part.encode().decode("latin-1").translate(self.spelling)
            found = array("I", [token.id for token in self.model.tokenize(spelled)]).tobytes() if part else b""
            if len(part) <= CACHED_LENGTH:
                self.parts[part] = found
        return found


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One for each file and worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
