"""Quality rules against plain Python: the counts, the references and the distances."""

import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import pytest

from clickwarden.llm import divergence_rules as rules
from clickwarden.llm.queries import op4_divergence_rules

from .tables import TEXTS, by_id, documents

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
GROUPS = {"lower": lambda c: unicodedata.category(c) == "Ll", "upper": lambda c: unicodedata.category(c) == "Lu",
          "digit": lambda c: unicodedata.category(c) == "Nd", "space": lambda c: c in " \t\n\x0b\x0c\r",
          "point": lambda c: c in ".,;:'()-", "mark": lambda c: c in "!?\""}


def base(text):
    words = WORDS.findall(text or "")
    places = defaultdict(list)
    for at in range(len(words) - 7):
        places[tuple(words[at:at + 8])].append(at)
    repeated = {at + step for found in places.values() if len(found) > 1 for at in found for step in range(8)}
    lines = [line for line in (text or "").split("\n") if WORDS.search(line)]
    n, r = len(words), len(repeated)
    return {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": r,
            "base_failed": n < 20 or 100 * r > 30 * n}


def counts(text, bands):
    groups = [sum(map(test, text)) for test in GROUPS.values()]
    words = [word.lower() for word in WORDS.findall(text)]
    return groups, [sum(word in band for word in words) for band in bands], len(text), len(words)


def distance(found, total, reference):
    own = [n / total for n in found] + [(total - sum(found)) / total]
    other = [*reference, max(0.0, 1 - sum(reference))]
    out = 0.0
    for p, q in zip(own, other):
        for share in (p, q):
            if share > 0:
                out += share * math.log2(share / ((p + q) / 2)) / 2
    return math.sqrt(max(out, 0))


def brute(docs):
    """docs: id to (text, lang). Id to (kept, class distance, word distance)."""
    bands, medians = {}, {}
    for lang in {lang for _, lang in docs.values() if lang}:
        own = [text or "" for text, other in docs.values() if other == lang]
        if len(own) < rules.LEAST_DOCS:
            continue
        uses = Counter(word for text in own for word in set(WORDS.findall(text.lower()))
                       if len(word) <= rules.COMMON_LENGTH and all(c.isalpha() for c in word))
        common = [word for word, _ in sorted(uses.items(), key=lambda item: (-item[1], item[0].encode()))][:rules.BANDS[-1]]
        bands[lang] = [set(common[a:b]) for a, b in zip((0, *rules.BANDS), rules.BANDS)]
        shares = defaultdict(list)
        for text in own:
            if not base(text)["base_failed"]:
                groups, hits, n_chars, n_words = counts(text, bands[lang])
                for at, n in enumerate(groups):
                    shares[at].append(math.floor(n * 1000 / n_chars + 0.5))
                for at, n in enumerate(hits):
                    shares[len(groups) + at].append(math.floor(n * 1000 / n_words + 0.5))
        middle = [sorted(found)[(len(found) + 1) // 2 - 1] / 1000 for _, found in sorted(shares.items())]
        if middle:
            medians[lang] = middle[:len(GROUPS)], middle[len(GROUPS):]
    out = {}
    for key, (text, lang) in docs.items():
        text = text or ""
        groups, _, n_chars, n_words = counts(text, [])
        far_class = far_word = None
        if n_chars >= rules.LEAST_CHARS and medians:
            each = {name: distance(groups, n_chars, reference[0]) for name, reference in medians.items()}
            far_class = each.get(lang, min(each.values()))
        if n_words >= rules.LEAST_WORDS and lang in medians:
            far_word = distance(counts(text, bands[lang])[1], n_words, medians[lang][1])
        kept = not base(text)["base_failed"] and not (far_class or 0) > rules.CLASS_LIMIT and not (
            far_word or 0) > rules.WORD_LIMIT
        out[key] = kept, far_class, far_word
    return out


def check(rows, docs):
    wanted = brute(docs)
    assert len(rows) == len(docs)
    for key, (text, _) in docs.items():
        row = rows[key]
        assert {name: row[name] for name in base(text)} == base(text), text
        kept, far_class, far_word = wanted[key]
        assert row["kept"] == kept
        if "class_distance" in row:
            assert row["class_distance"] == pytest.approx(far_class, abs=1e-9)
            assert row["word_distance"] == pytest.approx(far_word, abs=1e-9)


def test_odd_texts_alone(spark):
    docs = dict(enumerate(zip(TEXTS, ("en", None, "de") * 9)))
    check(by_id(rules.judge(documents(spark, TEXTS))), docs)


def test_references_and_distances(spark):
    rng = random.Random(2)
    languages = {"en": "the of and to in is it for".split(), "de": "der die und das ist von zu mit".split()}

    def prose(lang, n):
        return " ".join(rng.choice(languages[lang]) if rng.random() < 0.5 else "".join(
            rng.choices("abcdefghiklmnoprstuäö", k=rng.randint(3, 9))) for _ in range(n)) + "."

    texts, langs = [], []
    for at in range(120):
        lang = "en" if at % 2 else "de"
        texts.append(prose(lang, rng.randint(25, 200)))
        langs.append(lang)
    junk = [" | ".join("".join(rng.choices("abcdefgh", k=8)) for _ in range(80)), prose("en", 90).upper() + "!!!",
            " ".join(f"{word}###" for word in prose("en", 80).split()), prose("de", 60), "short text of ten words or so"]
    texts += [*junk, *TEXTS]
    langs += ["en", "en", "en", None, "en"] + ["en", None, "xx"] * 9
    langs = langs[:len(texts)]
    rows = by_id(rules.judge(documents(spark, texts, langs)))
    check(rows, dict(enumerate(zip(texts, langs))))
    assert all(rows[at]["kept"] for at in range(120))
    assert not any(rows[at]["kept"] for at in (120, 121, 122)) and rows[123]["kept"]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = {row["doc_id"]: (row["text"], row["lang"]) for row in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    check(by_id(op4_divergence_rules(spark, folder)), docs)


def test_empty_table(spark):
    assert not rules.judge(documents(spark, [])).collect()
