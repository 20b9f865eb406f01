"""Quality classifier: a generalised additive model with pairwise interactions, one lookup table a term.

Features of a text fall into bins. Boosting goes round the features in turn; each step fits a shallow tree to the gradients of
one feature and adds it to that feature's table, so that the tables stay readable as shape functions. Then the
pairs that best explain what is left get two-dimensional tables in the same way. A score is a sum of table entries.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickwarden.llm.common import keyed_texts

#: Labelled rows that the fit reads at most (the first by a hash of the id).
TRAINING_ROWS = 20_000
#: Bins of a feature and of each side of a pair; rounds over features and over pairs; pairs; step size; weight of a leaf's zero.
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, RIDGE = 64, 16, 120, 40, 6, 0.1, 2.0
LEAST_LEAF = 5

FEATURES = ["log_chars", "log_words", "word_length", "upper", "digit", "space", "stop", "mark", "symbol", "letter",
            "distinct", "top_word", "short_words", "repeats", "no_letters", "line_length", "same_lines"]
_UPPER, _LETTER, _DIGIT, _SPACE, _STOP, _MARK, _SYMBOL = range(7)


@cache
def _classes() -> np.ndarray:
    """Class of each code point below 2**16; those above count as symbols if they are none of the first four."""
    table = np.full(0x10000, _SYMBOL, np.uint8)
    for code in range(0x10000):
        kind = unicodedata.category(chr(code))
        if kind == "Lu":
            table[code] = _UPPER
        elif kind[0] in "LM":
            table[code] = _LETTER
        elif kind[0] == "N":
            table[code] = _DIGIT
        elif kind[0] == "Z" or 9 <= code <= 13:
            table[code] = _SPACE
    table[[ord(mark) for mark in ".,;:'()-"]] = _STOP
    table[[ord(mark) for mark in "!?\""]] = _MARK
    return table


def features(text: str) -> list[float]:
    """The features of one text; all of them defined for an empty one."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not (codes < 0x10000).all():
        codes = np.where(codes < 0x10000, codes, np.frombuffer("".join(
            "a" if char.isalpha() else "+" for char in text).encode("utf-32-le"), np.uint32))
    counts = np.bincount(_classes()[codes], minlength=7) / max(1, len(text))
    words = text.split()
    n = max(1, len(words))
    uses = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = [line for line in text.split("\n") if line.strip()]
    return [np.log1p(len(text)), np.log1p(len(words)), lengths.sum() / n, counts[_UPPER], counts[_DIGIT], counts[_SPACE],
            counts[_STOP], counts[_MARK], counts[_SYMBOL], counts[_LETTER], len(uses) / n,
            max(uses.values(), default=0) / n, (lengths <= 3).sum() / n, sum(map(eq, words, words[1:])) / n,
            sum(use for word, use in uses.items() if not any(map(str.isalpha, word))) / n,
            np.log1p(len(text) / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines))]


class Gam:
    """Bin edges of each feature, a table for each, and (first, second, table) for each pair."""

    def __init__(self, base: float, edges: list[np.ndarray], tables: list[np.ndarray], pairs: list[tuple[int, int, np.ndarray]]):
        self.base, self.edges, self.tables, self.pairs = base, edges, tables, pairs

    def bins(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(edges, rows[:, at], "right") for at, edges in enumerate(self.edges)])

    def score(self, rows: np.ndarray) -> np.ndarray:
        bins = self.bins(rows)
        total = np.full(len(rows), self.base)
        for table, at in zip(self.tables, bins, strict=True):
            total += table[at]
        for first, second, table in self.pairs:
            total += table[_coarse(bins[first], self.edges[first]), _coarse(bins[second], self.edges[second])]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def _coarse(bins: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return bins * PAIR_BINS // (len(edges) + 1)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """(gain, cut) of the best cut of a row of bins in two; cut 0: none."""
    left_g, left_h, left_n = (np.cumsum(x)[:-1] for x in (g, h, n))
    if not left_g.size:
        return 0.0, 0
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    gain[(left_n < LEAST_LEAF) | (n.sum() - left_n < LEAST_LEAF)] = 0
    best = int(gain.argmax())
    return (float(gain[best]), best + 1) if gain[best] > 1e-12 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A tree of two levels over a row of bins, as the value of each bin."""
    cut = _split(g, h, n)[1]
    ends = {0, g.size, cut}
    for first, last in ((0, cut), (cut, g.size)):
        ends.add(first + _split(g[first:last], h[first:last], n[first:last])[1])
    out, ends = np.zeros(g.size), sorted(ends)
    for first, last in zip(ends, ends[1:], strict=False):
        out[first:last] = g[first:last].sum() / (h[first:last].sum() + RIDGE)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values) of the better tree that cuts one side of a grid and then each part on the other side."""
    best = (0.0, np.zeros(g.shape))
    for turned in (False, True):
        a, b, c = (x.T if turned else x for x in (g, h, n))
        for cut in range(1, a.shape[0]):
            gain, out = -_gain(a.sum(), b.sum()), np.zeros(a.shape)
            for part in (slice(0, cut), slice(cut, None)):
                side = [x[part].sum(0) for x in (a, b, c)]
                at = _split(*side)[1]
                for end in (slice(0, at), slice(at, None)):
                    own_g, own_h = side[0][end].sum(), side[1][end].sum()
                    gain += _gain(own_g, own_h)
                    out[part, end] = own_g / (own_h + RIDGE)
            if gain > best[0]:
                best = (gain, out.T if turned else out)
    return best


def fit_gam(rows: np.ndarray, labels: np.ndarray) -> Gam:
    """Logistic loss. Without rows, or with labels of one kind alone, the score is the smoothed share for every text."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(rows[:, at], np.linspace(0, 1, BINS + 1)[1:-1])) if len(rows) else np.zeros(0)
             for at in range(rows.shape[1])]
    model = Gam(base, edges, [np.zeros(len(edge) + 1) for edge in edges], [])
    if not 0 < labels.sum() < len(labels):
        return model
    bins, total = model.bins(rows), np.full(len(rows), base)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return labels - p, p * (1 - p)

    for _ in range(ROUNDS):
        for at, table in enumerate(model.tables):
            g, h = gradients()
            step = RATE * _tree(*(np.bincount(bins[at], weights, len(table)) for weights in (g, h, None)))
            table += step
            total += step[bins[at]]
    coarse = [_coarse(bins[at], edges[at]) for at in range(len(edges))]

    def grid(first: int, second: int) -> list[np.ndarray]:
        cell, g_h = coarse[first] * PAIR_BINS + coarse[second], gradients()
        return [np.bincount(cell, weights, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for weights in (*g_h, None)]

    gains = sorted(((_pair_tree(*grid(one, two))[0], one, two) for one, two in combinations(range(len(edges)), 2)),
                   key=lambda found: (-found[0], found[1:]))
    model.pairs = [(one, two, np.zeros((PAIR_BINS, PAIR_BINS))) for _, one, two in gains[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for one, two, table in model.pairs:
            step = RATE * _pair_tree(*grid(one, two))[1]
            table += step
            total += step[coarse[one], coarse[two]]
    return model


def _feature_rows(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([features(text.as_py() or "") for text in batch.column(1)], float).reshape(-1, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> Gam:
    """Learns from documents whose id has a label 0 or 1 in `labels`: TRAINING_ROWS of them at most.

    Rows with a null id or label are left out; of several labels for one id the largest counts, of several texts the first in order, null
    being none. Empty and very long texts are measured like any other; an empty table gives a model that knows nothing.
    """
    chosen = (labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
              .where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _feature_rows(batch)
            yield pa.RecordBatch.from_arrays([batch.column(2), *map(pa.array, rows.T)], names=["label", *FEATURES])

    texts = keyed_texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(
        F.min("text").alias("text")).select("doc_id", "text", "label")
    schema = ", ".join(["label int", *[f"{name} double" for name in FEATURES]])
    found = texts.mapInArrow(measure, schema).toPandas().sort_values(["label", *FEATURES])
    return fit_gam(found[FEATURES].to_numpy(float).reshape(-1, len(FEATURES)), found["label"].to_numpy(float))


def predict(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): how likely label 1 is, for every row. A null text counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_feature_rows(batch)))],
                                             names=["doc_id", "score"])

    texts = keyed_texts(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, score double")
