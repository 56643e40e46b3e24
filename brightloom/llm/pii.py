"""Personal data: pattern kinds, and spans that a conditional random field adds.

Base spans are leftmost and non-overlapping per kind, over the whole text; a match that fails its
kind's test is dropped. The field labels the tokens of each line (runs without white space) and adds
spans of the same kinds where no base span overlaps and the kind's test holds (a card's check digit, an
address's parts, a phone's number of digits). Lines without a token that holds a digit, @ or + are left
out where they are outside by the model itself: that no path over plain words scores more is checked on
training, and where it does not hold all lines are decoded.

Documents stay in their rows and nothing is shuffled. Null and empty texts have no spans; texts of any
length are read whole. Positions are code points, ends exclusive. Rows are scanned one by one, repeated or
not; only the id and the text are read, other columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import exact
from .crf import Crf, labelled_table, luhn

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a run of digits that fails from its first digit fails from all others
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@+]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
Span = tuple[int, int, int]  # start, kind, end


def _emails(text: str) -> Iterator[Span]:
    """From each @ the local part goes left to the end of the last match; the pattern itself would rescan every word."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, 0, m.end()
            free = m.end()
        at = text.find("@", m.end() if m else at + 1)


def base_spans(text: str) -> list[Span]:
    found = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def _lines(text: str, marked: bool) -> Iterator[tuple[list[str], list[int]]]:
    """Tokens and their places, of all lines with tokens or of those that hold a digit, @ or +."""
    at = 0
    for line in text.split("\n"):
        if not marked or _MARK.search(line):
            if ms := list(_TOKEN.finditer(line)):
                yield [m[0] for m in ms], [at + m.start() for m in ms]
        at += len(line) + 1


def _labelled_spans(tokens: list[str], places: list[int], labels: list[str]) -> Iterator[Span]:
    begin, kind, end = None, "", 0
    for token, place, label in [*zip(tokens, places, labels, strict=True), ("", 0, "O")]:
        if begin is not None and label != f"I-{kind}":
            yield begin, KINDS.index(kind), end
            begin = None
        if label != "O":
            if begin is None:
                begin, kind = place, label[2:]
            end = place + len(token)


#: What of a labelled span is the entity itself, without quotes and stops around it.
_CORE = tuple(map(re.compile, (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+){3}", r"[0-9](?:[\x20-]?[0-9])+", r"[+(]{0,2}[0-9][\x20().0-9-]*[0-9]")))


def _tested(text: str, span: Span) -> Iterator[Span]:
    """The entity in a labelled span, if the exact test of its kind holds."""
    start, kind, end = span
    if not (m := _CORE[kind].search(text, start, end)):
        return
    digits = re.sub("[^0-9]", "", m[0])
    if KINDS[kind] == "ip":
        holds = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
    elif KINDS[kind] == "card":
        holds = 12 <= len(digits) <= 19 and luhn(digits)
    else:
        holds = KINDS[kind] == "email" or 9 <= len(digits) <= 15
    if holds:
        yield m.start(), kind, m.end()


def spans_of(texts: list[str | None], model: Crf, known: dict) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    base, lines, owner = [], [], []
    for i, text in enumerate(texts):
        marked = bool(text) and _MARK.search(text)
        base.append(base_spans(text) if marked else [])
        if text and (marked or not model.plain_is_outside):
            for line in _lines(text, model.plain_is_outside):
                lines.append(line)
                owner.append(i)
    labels = model.decode([model.emissions(tokens, known) for tokens, _ in lines])
    more: list[list[Span]] = [[] for _ in texts]
    for i, line, found in zip(owner, lines, labels, strict=True):
        if any(x != "O" for x in found):
            more[i] += (x for span in _labelled_spans(*line, found) for x in _tested(texts[i], span))
    out = []
    for b, m in zip(base, more, strict=True):
        out.append((b, sorted([*b, *_apart(m, b)])))
    return out


def _apart(spans: list[Span], base: list[Span]) -> list[Span]:
    """The spans that overlap none of the base: both are in order, so one pass does."""
    kept, merged = [], []
    for s, _, e in base:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    i = 0
    for s, k, e in sorted(spans):
        while i < len(merged) and merged[i][1] <= s:
            i += 1
        if i == len(merged) or merged[i][0] >= e:
            kept.append((s, k, e))
    return kept


def named(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


BATCH = 64


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: list | None = None) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_spans, spans) per row. labelled: (tokens, labels) rows; the model is trained on the driver."""
    model = Crf.train(labelled or labelled_table())
    rows = docs.select(exact(id_col), exact(text_col)).toDF("id", "text")
    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField(c, T.StringType()) for c in ("base_spans", "spans")]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for i in range(0, batch.num_rows, BATCH):
                for base, every in spans_of(batch.column(1).slice(i, BATCH).to_pylist(), model, known):
                    kinds = [k for _, k, _ in base]
                    for c, v in zip(columns, [*(kinds.count(k) for k in range(4)), named(base), named(every)], strict=True):
                        c.append(v)
            arrays = [pa.array(c, pa.int64() if n.startswith("n_") else pa.string()) for n, c in zip(names, columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["id", *names])

    return rows.mapInArrow(run, T.StructType([rows.schema["id"], *fields]))
