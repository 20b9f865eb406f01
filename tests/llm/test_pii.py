"""Personal data against plain Python, and the terms that the method adds."""

import hashlib
import random
import re

import pytest

from clickwarden.llm import pii
from clickwarden.llm.queries import op8_disclosing_terms

from .tables import TEXTS, by_id, documents

HARD = [
    "a@b.c_d@e.f x@y z@-.- q@w..e m@n.o. a@b@c.d", "1.2.3.4.5.6.7.8 300.1.2.3.4 0001.02.003.255 1.2.3 256.1.1.1 11.2.3.4.",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111222 41111111111111112222233333 4 1 1 1",
    "+1 (269) 555-3296 +49.30.1234567 +1 +12 (((( +1234567890123456 ++33 1 23 45 67 89)", "9" * 20000, "a" * 30000 + "@",
    "é😀 me@exämple.com me@example.com 😀 1.1.1.1", "+1 4111 1111 1111 1111", "-1-2-3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9",
    "0.0.0.0 10.0.0.1 127.0.0.1, 000.0.00.007 0.1.2.3 256.0.0.1 00256.1.1.1 0000255.00.1.0 1.1.1.300 0.0.0", "10.0.0.1" * 3,
    "x@y.z " * 300, "tel +44 20 7946 0958.", "@@@@ .. +++",
]


def luhn(digits):
    total = 0
    for at, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + at % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def plain(text):
    """Kind to spans, by the plain patterns."""
    count = lambda value: len(re.sub("[^0-9]", "", value))
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda value: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda value: all(int(x) <= 255 for x in value.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda value: 13 <= count(value) <= 19 and luhn(re.sub("[^0-9]", "", value))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda value: 9 <= count(value) <= 15),
    }
    return {kind: [m.span() for m in re.finditer(rule, text or "") if valid(m[0])]
            for kind, (rule, valid) in rules.items()}


def expected(text):
    found = plain(text)
    joined = ",".join(f"{kind}:{a}:{b}" for kind, spans in found.items() for a, b in spans)
    return [len(spans) for spans in found.values()], hashlib.sha256(joined.encode()).hexdigest()


def check(rows, texts):
    assert len(rows) == len(texts)
    for key, text in texts.items():
        row = rows[key]
        counts, digest = expected(text)
        assert [row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]] == counts, text and text[:200]
        assert row["base_sha256"] == digest, text and text[:200]


def test_patterns(spark):
    texts = [*TEXTS, *HARD]
    check(by_id(pii.digest(pii.sanitise(documents(spark, texts)))), dict(enumerate(texts)))


def test_random_strings(spark):
    rng = random.Random(8)
    marks = ["0", "00", "1", "25", "255", "256", "9", "4111111111111111", ".", ".", ".", "-", " ", "+", "(", ")", "@", "a", "é", "\n"]
    texts = ["".join(rng.choices(marks, k=rng.randrange(3, 30))) for _ in range(20_000)]
    check(by_id(pii.digest(pii.sanitise(documents(spark, texts)))), dict(enumerate(texts)))


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {row["doc_id"]: row["text"] for row in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    check(by_id(op8_disclosing_terms(spark, folder)), texts)


@pytest.fixture(scope="module")
def company(spark):
    texts = [f"{opening} zorbin mail ceo@corp.org today {closing}" for opening, closing in
             [("red", "one"), ("green", "two"), ("blue", "three"), ("white", "four")]]
    texts += ["mail the today one " * 3, "zorbin alone"] + ["plain words in a mail here today"] * 60
    texts += ["same odd words x@copy.org odd same"] * 20
    return by_id(pii.sanitise(documents(spark, texts)))


def test_terms_that_give_an_entity_away_are_found(company):
    first = company[0]
    assert [span["value"] for span in first["terms"]] == ["zorbin"]
    assert first["text"] == "red [TERM] mail [EMAIL] today one"


def test_common_terms_and_copies_add_nothing(company):
    assert not company[4]["terms"] and company[4]["text"] == "mail the today one " * 3
    assert all(not company[key]["terms"] for key in range(66, 86))
    assert company[66]["text"] == "same odd words [EMAIL] odd same"


def test_copies_of_any_document_change_nothing(spark, company):
    texts = [f"{opening} zorbin mail ceo@corp.org today {closing}" for opening, closing in
             [("red", "one"), ("green", "two"), ("blue", "three"), ("white", "four")]]
    texts += ["mail the today one " * 3, "zorbin alone", "plain words in a mail here today"]
    for copied in (0, 4, 5, 6):
        rows = by_id(pii.sanitise(documents(spark, texts + [texts[copied]] * 1000)))
        assert [[span["value"] for span in rows[at]["terms"]] for at in range(7)] == [["zorbin"]] * 4 + [[]] * 3
        assert rows[0]["text"] == company[0]["text"]


def test_terms_far_from_the_mention_are_found(spark):
    between = lambda at: " ".join(f"w{at}x{n}" for n in range(60))
    texts = [f"Zorbin {between(at)} boss@corp.org" for at in range(4)] + [f"common {between(at)} mail@all.org" for at in range(4, 40)]
    texts += [f"common Kelda {between(at)} rare@two.org" for at in (40, 41)] + [f"common {between(at)}" for at in range(42, 50)]
    rows = by_id(pii.sanitise(documents(spark, texts + [texts[40]] * 5)))
    for at in range(4):
        assert rows[at]["text"] == f" {between(at)} [EMAIL]"  # it stands nowhere else: taken out
    assert not any(rows[at]["terms"] for at in range(4, 55))  # of the rest, no term tells, or two texts alone hold it


def test_terms_stand_only_where_the_entity_is(company):
    assert company[5]["text"] == "zorbin alone"


def test_null_and_empty(spark):
    rows = by_id(pii.sanitise(documents(spark, [None, ""])))
    assert rows[0]["text"] is None and rows[1]["text"] == ""
    assert not pii.sanitise(documents(spark, [])).collect()


def test_overlapping_spans_are_replaced_as_one(spark):
    rows = by_id(pii.sanitise(documents(spark, ["call +1 4111 1111 1111 now", "+1 41111111111111111"])))
    assert rows[0]["text"] == "call [PHONE] now"
    # 18 digits that pass Luhn are a card; with the 1 before it the phone would have 18 digits, too many.
    assert rows[1]["text"] == "+[CARD]"
