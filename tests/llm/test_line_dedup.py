"""Line dedup against all pairs of lines."""

import random

import pytest
from pyspark.sql import functions as F

from clickwarden.llm import line_dedup
from clickwarden.llm.queries import op6_segment_edit_line_dedup

from .tables import TEXTS, by_id, documents

SPACE = " \t\n\x0b\x0c\r"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (x != y))
    return row[-1]


def within(a, b, k):
    """Edit distance at most k, by trying the edits at the first difference."""
    while a and b and a[0] == b[0]:
        same = next((at for at, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        a, b = a[same:], b[same:]
    if not a or not b:
        return len(a) + len(b) <= k
    return k > 0 and (within(a[1:], b[1:], k - 1) or within(a[1:], b, k - 1) or within(a, b[1:], k - 1))


def brute(texts, limit=2, least=30):
    """doc_id to (numbers of dropped lines, the text left)."""
    seen, out = {}, {}
    for key in sorted(texts):
        lines, dropped = (texts[key] or "").split("\n"), []
        for number, line in enumerate(lines):
            line = line.strip(SPACE)
            if not line:
                continue
            if line in seen or any(abs(len(line) - len(other)) <= limit and min(len(line), len(other)) >= least
                                   and distance(line, other) <= limit for other in seen):
                dropped.append(number)
            seen[line] = True
        left = "\n".join(line for number, line in enumerate(lines) if number not in set(dropped))
        out[key] = (dropped, left if texts[key] is not None else None)
    return out


def found(frame):
    return {key: (row["dropped"], row["text"]) for key, row in by_id(frame).items()}


def edited(rng, line, edits):
    chars = list(line)
    for _ in range(edits):
        at, kind = rng.randrange(len(chars)), rng.randrange(3)
        if kind == 0:
            chars[at] = rng.choice("abcé 12")
        elif kind == 1:
            chars.insert(at, rng.choice("abcé 12"))
        else:
            del chars[at]
    return "".join(chars)


def corpus(seed, n=60):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abcdeé  ") for _ in range(rng.choice([10, 29, 30, 31, 33, 47, 80]))) for _ in range(8)]
    return ["\n".join(rng.choice(["", " ", "\t"]) + edited(rng, rng.choice(bases), rng.choice([0, 1, 1, 2, 3, 4]))
                      for _ in range(rng.randrange(6))) for _ in range(n)]


@pytest.mark.parametrize("limits", [{}, {"HOT_PAIRS": 3}, {"HOT_PAIRS": 3, "BROADCAST_ROWS": -1}])
def test_equals_all_pairs(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(line_dedup, name, value)
    texts = [*TEXTS, *corpus(len(limits))]
    assert found(line_dedup.dedup_lines(documents(spark, texts))) == brute(dict(enumerate(texts)))


@pytest.mark.parametrize("limit", [1, 2, 3])
def test_edit_distance(spark, limit):
    rng = random.Random(limit)
    pairs = []
    for _ in range(400):
        line = "".join(rng.choice("abé") for _ in range(rng.randrange(8, 20)))
        pairs.append((line, edited(rng, line, rng.randrange(limit + 3))))
    pairs = [pair for pair in pairs if min(map(len, pair)) > limit + 1]
    frame = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", line_dedup.edits_at_most(F.col("a"), F.col("b"), limit).alias("near"))
    wrong = [row for row in frame.collect() if row["near"] != (distance(row["a"], row["b"]) <= limit)]
    assert not wrong


def test_many_lines_that_share_beginnings(spark):
    texts = [f"A long beginning that all of these lines have in common, and then number {at:04d}{at * 7919 % 10007:05d}"
             for at in range(300)]
    assert found(line_dedup.dedup_lines(documents(spark, texts))) == brute(dict(enumerate(texts)))


def test_repeated_rows_and_empty_table(spark):
    texts = ["the same line in a row that is there twice", "another one"]
    twice = documents(spark, texts).union(documents(spark, texts))
    assert {row["text"] for row in line_dedup.dedup_lines(twice).collect()} == set(texts)
    assert not line_dedup.dedup_lines(documents(spark, [])).collect()


def test_query(spark):
    rows = op6_segment_edit_line_dedup(spark, "/root/testdata/sf0.001").collect()
    texts = {row["doc_id"]: row["text"] for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    wanted = brute_by_blocks(texts)
    assert {row["doc_id"]: row["dropped"] for row in rows} == wanted


def brute_by_blocks(texts):
    """As brute(), comparing only lines of close lengths that share a third."""
    seen, by_part, out = set(), {}, {}
    for key in sorted(texts):
        dropped = []
        for number, line in enumerate(texts[key].split("\n")):
            line = line.strip(SPACE)
            if not line:
                continue
            thirds = [line[:len(line) // 3], line[-(len(line) // 3):]] if len(line) >= 30 else []
            near = any(within(line, other, 2) for part in _windows(line) for other in by_part.get(part, ())
                       if abs(len(other) - len(line)) <= 2) if thirds else False
            if line in seen or near:
                dropped.append(str(number))
            if line not in seen and thirds:
                for part in _windows(line):
                    by_part.setdefault(part, []).append(line)
            seen.add(line)
        out[key] = ",".join(dropped)
    return out


def _windows(line):
    """Eight characters around each of several places: two edits leave one of them whole in both lines, as sets of all."""
    return {line[at:at + 8] for at in range(0, len(line) - 7)}


def test_a_line_of_a_large_family_is_joined_once(spark, monkeypatch):
    """Lines that share two of three segments have many entries under shared keys, and entries that no other line shares go at once."""
    monkeypatch.setattr(line_dedup, "HOT_PAIRS", 50)
    joined = []
    plain = line_dedup.saved

    def watched(frame):
        table = plain(frame)
        if "key" in table.columns and "role" in table.columns:
            joined.append((table.columns, table))
        return table

    monkeypatch.setattr(line_dedup, "saved", watched)
    rng = random.Random(5)
    head = "".join(rng.choice("abcdefgh ") for _ in range(90))
    texts = [head + "".join(rng.choice("ijklmnop") for _ in range(40)) for _ in range(120)] + [head + "x" * 40, head + "x" * 39 + "y"]
    near = line_dedup.near_lines(line_dedup.lines_of(documents(spark, texts)))
    assert near.count() == 1
    marked = [table for columns, table in joined if "hot" in columns]
    assert len(marked) > 1
    for table in marked:
        assert {"one", "two"}.isdisjoint(table.columns)
        alone = table.groupBy("key").agg(F.count_distinct("h").alias("lines")).where("lines < 2")
        assert alone.isEmpty()


@pytest.mark.parametrize("limit", [1, 2, 3])
def test_families_refined_to_the_end_equal_all_pairs(spark, monkeypatch, limit):
    """Edits on one side, the other or both of what a family shares, and keys refined down to parts of a few characters."""
    monkeypatch.setattr(line_dedup, "HOT_PAIRS", 1)
    rng = random.Random(limit)
    stem = "".join(rng.choice("abcdefgh ") for _ in range(46)).strip()
    stems = [stem, "v1 " + stem, "v2 " + stem, stem + " a", stem + " b"]
    texts = [edited(rng, rng.choice(stems), rng.choice([0, 1, 2, limit + 1])) for _ in range(60)]
    texts += [f"{rng.choice('ab')} {stem} {rng.randrange(10**6):06d}" for _ in range(30)]
    texts += [f"{rng.randrange(10**6):06d} {stem} {rng.choice('ab')}" for _ in range(30)]
    assert found(line_dedup.dedup_lines(documents(spark, texts), max_edits=limit)) == brute(dict(enumerate(texts)), limit)


@pytest.mark.parametrize("line", ["{head}{number}{tail}", "{number}{head}{tail}", "{kind}{head}{tail}{number}", "{number}{head}{tail}{kind}"])
def test_rows_of_a_large_family_do_not_grow_with_each_refinement(spark, monkeypatch, line):
    """Lines that share all but a number: a key is refined where its lines differ, so entries become fewer and not more."""
    monkeypatch.setattr(line_dedup, "HOT_PAIRS", 50)
    rows, plain = [], line_dedup.saved

    def watched(frame):
        table = plain(frame)
        if "hot" in table.columns:
            rows.append(table.count())
        return table

    monkeypatch.setattr(line_dedup, "saved", watched)
    rng = random.Random(7)
    head, tail = ("".join(rng.choice("abcdefgh ") for _ in range(48)) + "." for _ in range(2))
    texts = [line.format(head=head, tail=tail, number=f"{at * 7919 % 10007:05d}{at * 104729 % 100003:06d}", kind="xy"[at % 2])
             for at in range(200)]
    assert found(line_dedup.dedup_lines(documents(spark, texts))) == brute(dict(enumerate(texts)))
    assert max(rows) <= 3 * rows[0]
