"""Language identification by unigram models over one fixed vocabulary, with all segmentations counted.

The pieces are those of a public tokenizer file; only their probabilities differ between languages. A word's probability in
a language is the sum over all ways to cut it into pieces of the product of the pieces' probabilities, by the forward
algorithm; a text's is the product over its words. Training is expectation maximisation: a piece's expected count, over all
cuts of all training words, becomes its new probability.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from string import punctuation

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickwarden.llm.common import BREAK, keyed_texts, saved
from clickwarden.llm.words import CACHED_LENGTH, CACHED_WORDS

#: The fit reads so many documents of a language at most (the first by a hash of the id), and runs so many rounds.
TRAINING_DOCS, ROUNDS = 1000, 3
#: A language's piece that no word uses still counts as seen so often; a character outside the vocabulary has this probability.
SMOOTHING, UNKNOWN = 0.1, 1e-7
UNDETERMINED = "und"
#: Sums, of a place in a word and a language, that are held at once, about.
CELLS = 2_600_000
START = "▁"  # what the vocabulary's pieces have in place of the blank before a word


def read_pieces(path: str) -> list[str]:
    """The vocabulary's ordinary pieces, in small letters, each once."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return sorted({model.id_to_piece(at).lower() for at in range(model.get_piece_size())
                   if not (model.is_control(at) or model.is_unknown(at) or model.is_byte(at))} - {""})


class Lattice:
    """All cuts of words into pieces, side by side for many words."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        # The pieces as a tree: node and character to the node below, as one sorted list; each node's piece, or -1.
        below: dict[int, int] = {}
        ends = [-1]
        for at, piece in enumerate(pieces):
            node = 0
            for mark in piece:
                key = node << 21 | ord(mark)
                if (found := below.get(key)) is None:
                    found = below[key] = len(ends)
                    ends.append(-1)
                node = found
            ends[node] = at
        self.steps = np.array(sorted(below) or [-1], np.int64)
        self.nodes = np.array([below[key] for key in sorted(below)] or [0], np.int64)
        self.ends = np.array(ends, np.int64)

    def edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """(word, start, end, piece) of every piece in every word, in this order; piece len(pieces) is an unknown character."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        marks = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        stops = np.cumsum(sizes)
        place, node, length = np.arange(marks.size), np.zeros(marks.size, np.int64), 0
        single = np.zeros(marks.size, bool)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while place.size:  # all places whose characters so far begin a piece
            step = node << 21 | marks[place + length]
            at = np.minimum(np.searchsorted(self.steps, step), self.steps.size - 1)
            on = self.steps[at] == step
            place, node, length = place[on], self.nodes[at[on]], length + 1
            piece = self.ends[node]
            whole = piece >= 0
            found.append((place[whole], np.full(int(whole.sum()), length), piece[whole]))
            if length == 1:
                single[place[whole]] = True
            more = place + length < stops[word[place]]
            place, node = place[more], node[more]
        unknown = np.flatnonzero(~single)
        found.append((unknown, np.ones(unknown.size, np.int64), np.full(unknown.size, len(self.pieces))))
        place, length, piece = (np.concatenate(part) for part in zip(*found, strict=True))
        order = np.lexsort((length, place))
        place, length, piece = place[order], length[order], piece[order]
        start = place - (stops - sizes)[word[place]]
        return word[place], start, start + length, piece

    def forward(self, words: list[str], model: np.ndarray) -> tuple[np.ndarray, tuple, np.ndarray, np.ndarray]:
        """Log-probability of each word in each language, the edges, and the sums over all beginnings.

        A sum is one (or zero where no cut ends) in a unit whose logarithm is kept, so that long words do not underflow.
        """
        word, start, end, piece = edges = self.edges(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        longest, languages = int(sizes.max(initial=0)), model.shape[1]
        sums = np.zeros((longest + 1, len(words), languages))
        scales = np.zeros_like(sums)  # the logarithm of the unit at each place
        sums[0] = 1
        order = np.argsort(end, kind="stable")
        stops = np.searchsorted(end[order], np.arange(longest + 2))
        for place in range(1, longest + 1):
            chosen = order[stops[place]:stops[place + 1]]  # in the order of words, as edges are
            if not chosen.size:
                continue
            own, first = word[chosen], start[chosen]
            begins = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            many = np.diff(np.append(begins, own.size))
            units = np.maximum.reduceat(scales[first, own], begins, axis=0)
            shares = sums[first, own] * np.exp(scales[first, own] - np.repeat(units, many, axis=0)) * model[piece[chosen]]
            total = np.add.reduceat(shares, begins, axis=0)
            sums[place, own[begins]] = 1
            scales[place, own[begins]] = units + np.log(total)
        return scales[sizes, np.arange(len(words))], edges, sums, scales

    def expected(self, words: list[str], weights: np.ndarray, model: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in each language, over all cuts; weights: uses of the word in each language."""
        logs, (word, start, end, piece), sums, scales = self.forward(words, model)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        longest = int(sizes.max(initial=0))
        back = np.zeros_like(sums)  # over all ends, with the forward sum as unit: forward * back is a posterior
        rows = np.arange(len(words))
        back[sizes, rows] = 1
        order = np.argsort(end, kind="stable")
        stops = np.searchsorted(end[order], np.arange(longest + 2))
        posterior = np.zeros((word.size, model.shape[1]))
        for place in range(longest, 0, -1):
            chosen = order[stops[place]:stops[place + 1]]
            if not chosen.size:
                continue
            own, first = word[chosen], start[chosen]
            step = back[place, own] * model[piece[chosen]] * np.exp(scales[first, own] - scales[place, own])
            posterior[chosen] = step * sums[first, own]
            np.add.at(back, (first, own), step)
        uses = np.zeros((len(self.pieces) + 1, model.shape[1]))
        np.add.at(uses, piece, posterior * weights[word])
        return uses


def _normalised(uses: np.ndarray) -> np.ndarray:
    """Uses to probabilities; the last row, unknown characters, keeps its fixed one."""
    known = uses[:-1] + SMOOTHING
    return np.vstack((known / known.sum(0) * (1 - UNKNOWN), np.full((1, uses.shape[1]), UNKNOWN)))


def _core(word: str) -> str:
    """The word without the marks around it."""
    return word.strip(punctuation)


def _marked(core: str) -> str:
    """The core as pieces spell it, with what stands for the blank before it; nothing stays nothing."""
    return START + core if core else ""


def _alike(words: list[str], languages: int) -> Iterator[list[int]]:
    """Numbers of words of like length, so many that their sums fit CELLS; a single long word may exceed them."""
    order = sorted(range(len(words)), key=lambda at: len(words[at]))
    first = 0
    while first < len(order):
        last = first + 1
        while last < len(order) and (len(words[order[last]]) + 1) * (last + 1 - first) * languages <= CELLS:
            last += 1
        yield order[first:last]
        first = last


class LanguageModel:
    def __init__(self, languages: list[str], pieces: list[str], model: np.ndarray):
        self.languages, self.pieces, self.model = languages, pieces, model
        self.key = uuid.uuid4().hex

    def scorer(self):
        """Words to log-probabilities in each language, as rows; remembers a bounded number of words and of their cores."""
        lattice, known, cores = Lattice(self.pieces), {}, {}

        def rows(words: list[str]) -> list[np.ndarray]:
            for kept in (known, cores):
                if len(kept) > CACHED_WORDS // 2:
                    kept.clear()
            new = {word: _core(word) for word in set(words).difference(known)}
            unseen = list(set(new.values()).difference(cores))
            marked = list(map(_marked, unseen))
            values = np.zeros((len(unseen), len(self.languages)))
            for some in _alike(marked, len(self.languages)):
                values[some] = lattice.forward([marked[at] for at in some], self.model)[0]
            cores.update(zip(unseen, values, strict=True))
            known.update((word, cores[core]) for word, core in new.items())
            out = [known[word] for word in words]
            for kept, some in ((known, new), (cores, unseen)):
                for word in some:
                    if len(word) > CACHED_LENGTH:
                        del kept[word]
            return out

        return rows

    def predict(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, lang_pred and score: the likeliest language and its posterior, all languages being equally likely before.

        `und` and 0 for null texts, texts without a letter, and when there is no language to choose from. Equal
        languages go by name.
        """
        names = self.languages

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            score = _scorer(self)
            for batch in batches:
                found, scores = [], []
                for first in range(0, batch.num_rows, 256):
                    texts = batch.column(1).slice(first, 256).to_pylist()
                    split = [text.lower().split() if text and names and any(map(str.isalpha, text)) else [] for text in texts]
                    different = list({word for words in split for word in words})
                    number = {word: at for at, word in enumerate(different)}
                    logs = np.array(score(different)) if different else np.zeros((0, len(names)))
                    for words in split:
                        if not words:
                            found.append(UNDETERMINED), scores.append(0.0)
                            continue
                        total = logs[[number[word] for word in words]].sum(0)
                        best = int(total.argmax())
                        found.append(names[best])
                        scores.append(float(1 / np.exp(total - total[best]).sum()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                    names=["doc_id", "lang_pred", "score"])

        texts = keyed_texts(docs, id_col, text_col)
        kind = texts.schema["doc_id"].dataType.simpleString()
        return texts.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


_scorers: dict[str, Callable] = {}


def _scorer(model: LanguageModel) -> Callable[[list[str]], list[np.ndarray]]:
    """One for a worker, of the model that it uses just now."""
    if model.key not in _scorers:
        _scorers.clear()
        _scorers[model.key] = model.scorer()
    return _scorers[model.key]


def fit(docs: DataFrame, pieces_path: str, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> LanguageModel:
    """Learns from rows with a language and a text: of each language TRAINING_DOCS documents at most.

    What reaches the driver is a table of pieces by languages, so as many languages as there may be. An empty table gives a model without languages.
    """
    pieces = read_pieces(pieces_path)
    rows = keyed_texts(docs, id_col, text_col, lang_col).toDF("doc_id", "text", "lang").where(
        "lang is not null and text is not null")
    chosen = rows.withColumn("place", F.xxhash64("doc_id"))
    limit = Window.partitionBy("lang").orderBy("place", "doc_id")
    # Ranks are taken of ids alone; the texts come after.
    places = (chosen.select("lang", "place", "doc_id").withColumn("rank", F.row_number().over(limit))
              .where(F.col("rank") <= TRAINING_DOCS).groupBy("lang").agg(
                  F.max("place").alias("last")))
    sample = chosen.join(F.broadcast(places), "lang").where(F.col("place") <= F.col("last"))
    words = saved(sample.select("lang", F.explode(F.split(F.lower("text"), BREAK)).alias("word"))
                  .where("word <> ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    languages = sorted(row["lang"] for row in words.select("lang").distinct().collect())
    if not languages:
        return LanguageModel([], pieces, np.zeros((len(pieces) + 1, 0)))
    number = {lang: at for at, lang in enumerate(languages)}
    lengths = np.array([len(piece) for piece in pieces] + [1.0])
    model = np.repeat(_normalised((0.02 ** lengths * 1e6)[:, None]), len(languages), axis=1)
    for _ in range(ROUNDS):
        model = _round(words, pieces, number, model)
    return LanguageModel(languages, pieces, model)


def _round(words: DataFrame, pieces: list[str], number: dict[str, int], model: np.ndarray) -> np.ndarray:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice, uses = Lattice(pieces), np.zeros_like(model)
        for rows in batches:
            langs = rows["lang"].map(number).to_numpy()
            marked, n = [_marked(_core(word)) for word in rows["word"]], rows["n"].to_numpy()
            for some in _alike(marked, model.shape[1]):
                weights = np.zeros((len(some), model.shape[1]))
                weights[np.arange(len(some)), langs[some]] = n[some]
                uses += lattice.expected([marked[at] for at in some], weights, model)
        piece, lang = np.nonzero(uses)
        yield pd.DataFrame({"piece": piece, "lang": lang, "uses": uses[piece, lang]})

    counted = words.mapInPandas(count, "piece long, lang long, uses double").groupBy("piece", "lang").agg(
        F.sum("uses").alias("uses"))
    found = counted.toPandas()  # pieces by languages
    uses = np.zeros_like(model)
    uses[found["piece"], found["lang"]] = found["uses"]
    return _normalised(uses)
