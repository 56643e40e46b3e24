"""Spans that the field adds: sentences of other templates than the training table's, and all documents."""

import re

import pandas as pd
import pytest
from brightloom.llm import crf, pii


@pytest.fixture(scope="module")
def model():
    return crf.Crf.train(crf.labelled_table())


def added(model, text):
    (base, every), = pii.spans_of([text], model, {})
    assert set(base) <= set(every)
    return [(pii.KINDS[k], text[a:b]) for a, k, b in every if (a, k, b) not in base]


#: Right: what the patterns miss; wrong: runs that look alike.
RIGHT = [
    ("Numbers 4111111111111111 5500005555555559 on file", [("card", "4111111111111111"), ("card", "5500005555555559")]),
    ("Ring (212) 555-0147 or come by", [("phone", "(212) 555-0147")]),
    ("his cell: 212-555-0147.", [("phone", "212-555-0147")]),
    ("Fax +1 (456) 555-2186 198.51.100.7", [("phone", "+1 (456) 555-2186")]),
]
WRONG = [
    "order 4111111111111112 left the house", "4111111111111112 4111111111111113", "version 10.2.3 of 2024-05-06", "build 1.2.3.4.5 of 999.1.1.1", "isbn 978-3-16148-410-0",
    "2024-05-06 12:30 to 13:30", "page 12 of 300", "token 9c8b45435718dcc700c184a7e303cdc64c6a8f7f", "@home and C++17", "no numbers at all", "1,234,567.89 euro", "x@y and a@b@c",
]


def test_what_the_patterns_miss(model):
    for text, want in RIGHT:
        assert added(model, text) == want


def test_look_alikes_stay_out(model):
    for text in WRONG:
        assert added(model, text) == []


def test_precision_and_recall_on_documents(model):
    """Judged by rule on the whole span: a card has 12 to 19 digits and passes its check, a phone is written as the documents' phones are."""
    texts = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").text.tolist() + pd.read_parquet("/root/testdata/sf0.1/documents.parquet").text.tolist()
    good = lambda kind, x: crf.luhn(x) if kind == "card" else re.fullmatch(r"\+\d \(\d{3}\) \d{3}-\d{4}", x) is not None
    right = wrong = missed = 0
    for i in range(0, len(texts), 256):
        part = texts[i : i + 256]
        for text, (base, every) in zip(part, pii.spans_of(part, model, {}), strict=True):
            more = [x for x in every if x not in base]
            for a, k, b in more:
                ok = good(pii.KINDS[k], text[a:b])
                right, wrong = right + ok, wrong + (not ok)
            for m in re.finditer(r"(?<![^\x20\x09-\x0D])(\d{16}|\+\d \(\d{3}\) \d{3}-\d{4})(?![^\x20\x09-\x0D])", text or ""):
                if (m[0][0] == "+" or crf.luhn(m[0])) and not any(a < m.end() and m.start() < b for a, _, b in every):
                    missed += 1
    print(f"added spans: {right} right, {wrong} wrong, {missed} missed")
    assert right >= 5 and right >= 0.9 * (right + wrong) and right >= 0.9 * (right + missed)


def test_lines_are_skipped_only_if_plain_words_are_outside(model, monkeypatch):
    seen = []
    monkeypatch.setattr(crf.Crf, "decode", lambda self, e: seen.append(len(e)) or [["O"] * len(x) for x in e])
    for outside in (True, False):
        model.plain_is_outside = outside
        pii.spans_of(["plain words\nand 12 here", "only words", None, ""], model, {})
    model.plain_is_outside = True
    assert seen == [1, 3]
