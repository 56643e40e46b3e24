"""How five filters overlap: for each part of a corpus and each order of the filters, what every step removes.

A document fails A with under 50 words, B with 100 * distinct words < 65 * words, C with 100 * [A-Z] > 5 * code
points, D if it holds one of `#$%&*|`, E if a document of smaller id has the same text. Its five failures are
one mask. A table of 32 masks by 120 orders, made once, holds the step of the first failure; tasks index it with
the masks of their rows, count removals by part, order, step and label with one bincount, and send the partial
arrays on, whose sums are the answer. All columns are sums over documents, so partial ones add up.

Texts are read once, in their rows. What is shuffled are rows of an id, a digest and a mask: a text's smallest
id is found with map-side aggregation and joined by (digest, id), so a text with very many copies is no hot key;
labels are joined by id. Rows that agree in part, mask and labels are counted before the table is asked and dealt
by part, so a part is at most 128 rows of one task however many documents or parts there are.

Null texts are empty, null parts the empty string. A document is good (toxic) if any label row says so; without
labels it is neither. Repeated rows count one by one and are not copies of each other, as no id is smaller. A null
id has no smaller one, is smaller than none and has no labels. An empty table has no parts, so no rows. Other
columns, of any names, are not read. Counts are exact up to 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import exact, stored, words_of

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

WORDS_LEAST = 50
DISTINCT_LEAST = 65  # per hundred words
CAPITALS_MOST = 5  # per hundred code points
MARKS = "#$%&*|"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rows whose parts are counted at once: an array of them has at most so many times 2,880 numbers.
BLOCK = 1024
NULL_SALTS = 256

#: The filter at each order's step; an order that begins, and one that ends with each filter.
_FILTER_AT = np.array([[FILTERS.index(f) for f in o] for o in ORDERS])
_BEGINS = [next(i for i, o in enumerate(ORDERS) if o[0] == f) for f in FILTERS]
_ENDS = [next(i for i, o in enumerate(ORDERS) if o[-1] == f) for f in FILTERS]


def first_failures() -> np.ndarray:
    """The step (from 0) of the first failure by mask and order; STEPS where nothing fails."""
    fails = np.arange(1 << STEPS)[:, None, None] >> _FILTER_AT & 1
    return np.where(fails.any(axis=2), fails.argmax(axis=2), STEPS)


FIRST = first_failures()


def text_mask(text: Column) -> Column:
    """The mask of filters A to D of a text without nulls: one bit each, A the lowest."""
    words = words_of(text)
    n = F.size(words)
    length = F.length(text)
    fails = (
        n < WORDS_LEAST,
        100 * F.size(F.array_distinct(words)) < DISTINCT_LEAST * n,
        100 * (length - F.length(F.translate(text, CAPITALS, ""))) > CAPITALS_MOST * length,
        length > F.length(F.translate(text, MARKS, "")),
    )
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, label, n): how many documents of each part have a mask and a label (1: good, 2: toxic, 3: both)."""
    text = F.coalesce(exact(text_col).cast("string"), F.lit(""))
    part = F.coalesce(exact(part_col).cast("string"), F.lit(""))
    rows = docs.select(exact(id_col).alias("id"), part.alias("part"), text.alias("text"))
    rows = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("h"), text_mask(F.col("text")).alias("mask"))
    rows = stored(rows.groupBy("id", "part", "h", "mask").agg(F.count("*").alias("n")))
    first = rows.groupBy("h").agg(F.min("id").alias("id")).withColumn("is_first", F.lit(True))
    known = labels.groupBy(exact("doc_id").alias("id")).agg(
        F.max((F.coalesce(exact("quality") == 1, F.lit(False))).cast("int")).alias("good"), F.max((F.coalesce(exact("toxic") == 1, F.lit(False))).cast("int")).alias("toxic")
    )
    # null ids meet no label and would all come to one task: they are dealt by their digests
    salt = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("h"), F.lit(NULL_SALTS))).otherwise(0).cast("int")
    rows = rows.join(first, ["h", "id"], "left").withColumn("salt", salt).join(known.withColumn("salt", F.lit(0)), ["id", "salt"], "left")
    copy = F.col("id").isNotNull() & F.col("is_first").isNull()
    label = F.coalesce("good", F.lit(0)) + 2 * F.coalesce("toxic", F.lit(0))
    rows = rows.select("part", (F.col("mask") + copy.cast("int") * 16).alias("mask"), label.alias("label"), "n")
    return rows.groupBy("part", "mask", "label").agg(F.sum("n").alias("n"))


def removals(codes: np.ndarray, mask: np.ndarray, label: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Removals by part, order, step (the last: kept by all) and label, of rows that stand for n documents each."""
    parts = int(codes.max()) + 1
    at = ((codes[:, None] * len(ORDERS) + np.arange(len(ORDERS))) * (STEPS + 1) + FIRST[mask]) * 4 + label[:, None]
    counts = np.bincount(at.ravel(), weights=np.repeat(n, len(ORDERS)), minlength=parts * len(ORDERS) * (STEPS + 1) * 4)
    return counts.astype(np.int64).reshape(parts, len(ORDERS), STEPS + 1, 4)


def measures(removed: np.ndarray) -> dict[str, np.ndarray]:
    """Every measure by part, order and step.

    What fails a filter at all is what it removes as the first one; what fails it alone, what it removes as the last.
    """
    every = removed.sum(axis=3)
    total, gone = every[:, 0].sum(axis=1), every[:, :, :STEPS]
    fails, alone = gone[:, _BEGINS, 0], gone[:, _ENDS, STEPS - 1]
    by_filter = np.stack([(gone * (_FILTER_AT == f)).sum(axis=(1, 2)) for f in range(STEPS)], axis=1)
    values = (
        total[:, None, None] - gone.cumsum(axis=2), gone, fails[:, _FILTER_AT] - gone, alone[:, _FILTER_AT],
        removed[:, :, :STEPS, 1] + removed[:, :, :STEPS, 3], removed[:, :, :STEPS, 2] + removed[:, :, :STEPS, 3], by_filter[:, _FILTER_AT],
    )
    return dict(zip(MEASURES, values, strict=True))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, filter_order, step, and the MEASURES) for every part, all 120 orders and steps 1 to 5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(at, BLOCK)
                parts = rows.column(0).dictionary_encode()
                numbers = [rows.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)]
                found = measures(removals(parts.indices.to_numpy().astype(np.int64), *numbers))
                n = len(parts.dictionary)
                orders = pa.DictionaryArray.from_arrays(pa.array(np.tile(np.repeat(np.arange(len(ORDERS), dtype=np.int32), STEPS), n)), pa.array(ORDERS))
                names = parts.dictionary.take(pa.array(np.repeat(np.arange(n), len(ORDERS) * STEPS)))
                steps = pa.array(np.tile(np.arange(1, STEPS + 1, dtype=np.int32), n * len(ORDERS)))
                yield pa.RecordBatch.from_arrays([names, orders.dictionary_decode(), steps, *(pa.array(v.ravel()) for v in found.values())], names=["part", "filter_order", "step", *MEASURES])

    schema = "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES)
    counts = masks(docs, labels, id_col, text_col, part_col).repartition("part")  # at most 128 rows of a part, so partial sums are few
    partial = counts.mapInArrow(run, schema)
    return partial.groupBy("part", "filter_order", "step").agg(*[F.sum(m).alias(m) for m in MEASURES])
