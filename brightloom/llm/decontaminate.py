"""Benchmark decontamination by suffix arrays over the training texts.

Words are maximal runs of digits, a-z (A-Z lower-cased) and characters past ASCII. A test window is
`window` consecutive words of an item, or all words of a shorter one. Each shard (a few MB of whole
documents in an Arrow batch) sorts its suffixes by their first `window` words and every test suffix is
binary-searched there; the interval found holds all verbatim occurrences and their places. A suffix is
left out of the sort only if it cannot start a match: one of the words that the shortest test window
needs is no test word, or lies beyond the document. From its hits a document's longest verbatim match is
followed to its end, whatever its length, in the order of the test suffixes.

Documents never leave their row, so nothing is shuffled. The test set goes to the tasks in blocks of at
most `block_chars` characters (or one longer item), one at a time on the driver and as flat arrays; with more
than one block the hits of each are stored by text and joined back, so the documents are read once per block.
Null texts have no words. Items without words have no windows. Null item ids are left out of the lists of
ids but still hit. Rows are judged one by one, repeated or not; texts of any length are read whole. Words are
compared by 64-bit hashes, all words of a window at once. Columns of the documents may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import exact, stored
from .words import hashed, places

WINDOW = 10
BLOCK_CHARS = 16_000_000
SHARD_BYTES = 2_000_000

#: Lower-cased byte of a word, zero for a separator.
_LOWER = np.zeros(256, np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _LOWER[_b] = _b
for _b in range(0x41, 0x5B):
    _LOWER[_b] = _b + 32


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order and, for each text, where its words begin (one entry more than texts)."""
    low = _LOWER[data]
    at, to = places(low, offsets)
    return hashed(low, at, to), np.searchsorted(at, offsets)


def _suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The places of all words in the order of what follows them, to `depth` words at least; by prefix doubling."""
    rank, n, k = text.astype(np.int64), len(text), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(n - k, 0)] = rank[k:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + after
        order = np.argsort(key, kind="stable")
        if 2 * k >= depth or n < 2:
            return order
        key = key[order]
        rank[order] = np.cumsum(np.r_[0, key[1:] != key[:-1]])
        k *= 2


class TestIndex:
    """A block of the test set as arrays: words as numbers from 1 with a zero after each item, their suffixes in order, and the distinct windows."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        self.window = window
        items = sorted(((None if x is None else str(x), t or "") for x, t in items), key=lambda x: (x[0] is None, x))
        raw = [t.encode("utf-8", "surrogatepass") for _, t in items]
        offsets = np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int64)
        hashes, begin = word_hashes(np.frombuffer(b"".join(raw), np.uint8), offsets)
        self.names = [x for x, _ in items]
        self.vocabulary = np.unique(hashes)
        lengths = np.diff(begin)
        item = np.repeat(np.arange(len(items)), lengths)
        text = np.zeros(len(hashes) + len(items), ">u4")
        text[np.arange(len(hashes)) + item] = np.searchsorted(self.vocabulary, hashes) + 1
        self.begin = (begin[:-1] + np.arange(len(items))).astype(np.int64)  # of each item in text
        self.text = text.tobytes()
        order = _suffix_order(text, int(lengths.max(initial=0)))
        self.order = order[text[order] > 0]
        # places of windows in order: full ones of the suffixes, then whole short items
        left = np.zeros(len(text), np.int64)
        left[np.arange(len(hashes)) + item] = (begin[1:][item] if len(items) else 0) - np.arange(len(hashes))
        full = self.order[left[self.order] >= window]
        new = np.ones(len(full), bool)
        if len(full):
            new[1:] = False
        for d in range(window):
            new[1:] |= text[full[1:] + d] != text[full[:-1] + d]
        short = self.begin[(lengths > 0) & (lengths < window)]
        rows = np.zeros((len(short), window), ">u4")
        for d in range(window):
            rows[:, d] = text[np.minimum(short + d, max(len(text) - 1, 0))] * (left[short] > d)
        by_content = np.argsort(_keys(rows), kind="stable")
        short, rows = short[by_content], rows[by_content]
        again = np.ones(len(short), bool)
        again[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        self.places = np.concatenate([full, short])
        self.bounds = np.append(np.flatnonzero(np.concatenate([new, again])), len(self.places))
        self.lengths = np.minimum(left[self.places[self.bounds[:-1]]], window)
        self.shortest = int(self.lengths.min(initial=window)) if len(self.lengths) else 0

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest suffix key that each window matches."""
        text = np.frombuffer(self.text, ">u4")
        first = self.places[self.bounds[:-1]]
        table = np.zeros((len(first), self.window), ">u4")
        for d in range(self.window):
            table[:, d] = text[np.minimum(first + d, max(len(text) - 1, 0))] * (self.lengths > d)
        low = _keys(table.copy())
        table[np.arange(self.window) >= self.lengths[:, None]] = 0xFFFFFFFF
        return low, _keys(table)

    def items_of(self, windows: np.ndarray) -> list[str]:
        """The distinct ids of the items that have one of the windows, sorted."""
        places = np.concatenate([self.places[a:b] for a, b in zip(self.bounds[windows], self.bounds[windows + 1], strict=True)])
        return sorted({self.names[i] for i in np.unique(np.searchsorted(self.begin, places, "right") - 1)} - {None})

    def place_of(self, key: bytes) -> int | None:
        """The place of the first suffix, in order, that starts with these words."""
        low, high, n = 0, len(self.order), len(key)
        while low < high:
            mid = (low + high) // 2
            at = 4 * int(self.order[mid])
            low, high = (mid + 1, high) if self.text[at : at + n] < key else (low, mid)
        if low < len(self.order):
            at = int(self.order[low])
            return at if self.text[4 * at : 4 * at + n] == key else None
        return None

    def longest(self, words: np.ndarray, at: np.ndarray, windows: np.ndarray) -> dict:
        """The longest verbatim match of a document (its word numbers, and its hits in order) and where it is in an item; the first of equals."""
        size = self.lengths[windows]
        top = int(size.argmax())
        best = (int(size[top]), int(at[top]), int(self.places[self.bounds[windows[top]]]))
        data = np.where(words == 0, 0xFFFFFFFF, words).astype(">u4").tobytes()
        found = lambda a, n: self.place_of(data[4 * a : 4 * (a + n)])
        starts = np.unique(at[size == self.window])
        hit = set(starts.tolist())
        i = 0
        while i < len(starts):
            a = int(starts[i])
            # beyond the known length the next one is doubled while it is found, then halved
            known, step = self.window, 1
            here = found(a, known)
            while a + known + step <= len(words) and (place := found(a, known + step)) is not None:
                known, here, step = known + step, place, 2 * step
            while step:
                if a + known + step <= len(words) and (place := found(a, known + step)) is not None:
                    known, here = known + step, place
                step //= 2
            best = max(best, (known, a, here), key=lambda b: (b[0], -b[1]))
            # a longer one has the word after this match's end, so it covers the window that ends there
            end = a + known
            if end - self.window + 1 in hit:
                low, high = a + 1, end - self.window + 1
                while low < high:
                    mid = (low + high) // 2
                    low, high = (low, mid) if found(mid, end + 1 - mid) is not None else (mid + 1, high)
                i = int(np.searchsorted(starts, low))
            else:
                i = int(np.searchsorted(starts, end - self.window + 1, "right"))
        item = int(np.searchsorted(self.begin, best[2], "right")) - 1
        return {"words": best[0], "start": best[1], "item": self.names[item], "item_start": best[2] - int(self.begin[item])}


def _keys(table: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(table).view(f"S{4 * table.shape[1]}").ravel()


def shard_hits(index: TestIndex, keys: tuple[np.ndarray, np.ndarray], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's words as test numbers (0: none), where each document's begin, and its hits (document, first word, test window) in order."""
    none = np.zeros((0, 3), np.int64)
    hashes, begin = word_hashes(data, offsets)
    if not len(hashes) or not len(index.lengths):
        return np.zeros(len(hashes), np.int64), begin, none
    numbers = np.searchsorted(index.vocabulary, hashes)
    numbers[numbers == len(index.vocabulary)] = 0
    known = index.vocabulary[numbers] == hashes
    numbers = np.where(known, numbers + 1, 0)
    # how many known words follow each place within its document
    stop = np.where(known, len(hashes), np.arange(len(hashes)))
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    document = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    run = np.minimum(stop, begin[document + 1]) - np.arange(len(hashes))
    suffixes = np.flatnonzero(run >= max(1, index.shortest))
    if not len(suffixes):
        return numbers, begin, none
    depth = np.arange(index.window)
    table = numbers[np.minimum(suffixes[:, None] + depth, len(hashes) - 1)]
    table = np.where(depth < run[suffixes][:, None], table, 0).astype(">u4")
    suffix_keys = _keys(table)
    order = np.argsort(suffix_keys, kind="stable")
    suffix_keys, suffixes = suffix_keys[order], suffixes[order]
    low, high = np.searchsorted(suffix_keys, keys[0], "left"), np.searchsorted(suffix_keys, keys[1], "right")
    n = high - low
    window = np.repeat(np.arange(len(n)), n)
    at = suffixes[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
    hits = np.stack([document[at], at - begin[document[at]], window], 1)
    return numbers, begin, hits[np.lexsort((window, at))]


def _shards(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole documents of a batch."""
    text = batch.column(column).cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(text):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SHARD_BYTES, "right")) - 1)
        yield row, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


def _spans(at: np.ndarray, ends: np.ndarray) -> list[dict]:
    """Merged word spans; `at` is in order."""
    reach = np.maximum.accumulate(ends)
    first = np.r_[True, at[1:] > reach[:-1]]
    return [{"start": int(a), "end": int(b)} for a, b in zip(at[first], reach[np.append(np.flatnonzero(first)[1:] - 1, len(at) - 1)], strict=True)]


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_LONG, _TEXT = T.LongType(), T.StringType()
FOUND = _struct(
    n_words=_LONG, spans=T.ArrayType(_struct(start=_LONG, end=_LONG)), items=T.ArrayType(_TEXT),
    longest=_struct(words=_LONG, start=_LONG, item=_TEXT, item_start=_LONG),
)


def test_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> tuple[int, Iterator[TestIndex]]:
    """How many blocks the test set has, of about `block_chars` characters by a hash of the text, and the blocks, made one at a time on the driver."""
    items = benchmark.select(exact(id_col), exact(text_col)).toDF("id", "text").filter(F.col("text").isNotNull())
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // block_chars))
    part = lambda b: items if blocks == 1 else items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b)
    return blocks, (TestIndex([tuple(r) for r in part(b).collect()], window) for b in range(blocks))


def _searched(rows: DataFrame, index: TestIndex, only_hits: bool = False) -> DataFrame:
    """rows: (id, text); (id, *FOUND) of all rows or of those with hits."""
    schema = T.StructType([rows.schema["id"], *FOUND.fields])
    arrow = list(to_arrow_schema(FOUND))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = index.keys()
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            spans, items, longest = [[]] * batch.num_rows, [[]] * batch.num_rows, [None] * batch.num_rows
            for row, data, offsets in _shards(batch, 1):
                numbers, begin, hits = shard_hits(index, keys, data, offsets)
                n_words[row : row + len(offsets) - 1] = np.diff(begin)
                for part in np.split(hits, np.flatnonzero(np.diff(hits[:, 0])) + 1) if len(hits) else ():
                    d, at, windows = int(part[0, 0]), part[:, 1], part[:, 2]
                    spans[row + d] = _spans(at, at + index.lengths[windows])
                    items[row + d] = index.items_of(np.unique(windows))
                    longest[row + d] = index.longest(numbers[begin[d] : begin[d + 1]], at, windows)
            columns = [pa.array(v, f.type) for v, f in zip((n_words, spans, items, longest), arrow, strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *(f.name for f in arrow)])
            yield out.filter(pa.array([bool(s) for s in spans], pa.bool_())) if only_hits else out

    return rows.mapInArrow(search, schema)


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, n_words, n_hit, items, spans, longest) per row; items are distinct ids as strings, sorted; spans count words."""
    rows = docs.select(exact(id_col), exact(text_col)).toDF("id", "text")
    blocks, indexes = test_blocks(benchmark, text_col="text", window=window, block_chars=block_chars)
    found = _searched(rows, next(indexes)) if blocks == 1 else _of_blocks(rows, indexes, window)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("id", "n_words", hit.alias("n_hit"), "items", "spans", "longest")


def _hits_by_text(rows: DataFrame, indexes: Iterator[TestIndex]) -> DataFrame:
    """The hits of all blocks, (id, *FOUND), one row per block and text with hits; the id is the text's MD5."""
    by_text = rows.select(F.md5(F.coalesce("text", F.lit(""))).alias("id"), "text")
    every = None
    for index in indexes:
        one = stored(_searched(by_text, index, True).dropDuplicates(["id"]))
        every = one if every is None else every.unionByName(one)
    return every


def _of_blocks(rows: DataFrame, indexes: Iterator[TestIndex], window: int) -> DataFrame:
    """The hits of several blocks, united per text and joined back to its rows."""
    g = _hits_by_text(rows, indexes).groupBy(F.col("id").alias("md5")).agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max_by("longest", F.struct("longest.words", -F.col("longest.start"))).alias("longest"),
    )
    empty = F.array().cast(FOUND["spans"].dataType)

    def join(a, x):
        last = F.get(a, F.size(a) - 1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(a) > 0) & (x["start"] <= last["end"]), F.array_append(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), wider)).otherwise(F.array_append(a, x))

    g = g.withColumn("spans", F.aggregate("all", empty, join)).drop("all")
    counted = _searched(rows.select(F.struct("id", F.md5(F.coalesce("text", F.lit(""))).alias("md5")).alias("id"), "text"), TestIndex([], window)).select("id.*", "n_words")
    found = counted.join(g, "md5", "left")
    return found.select("id", "n_words", F.coalesce("spans", empty).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "longest")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents without a hit, with the columns they came with."""
    blocks, indexes = test_blocks(benchmark, window=window, block_chars=block_chars)
    if blocks > 1:
        hit = _hits_by_text(docs.select(exact(text_col)).toDF("text"), indexes).select(F.col("id").alias("md5"))
        row = docs.select(F.struct(*[exact(c) for c in docs.columns]).alias("row"), F.md5(F.coalesce(exact(text_col), F.lit(""))).alias("md5"))
        return row.join(hit, "md5", "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
    index, place = next(indexes), docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = index.keys()
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for row, data, offsets in _shards(batch, place):
                keep[row + np.unique(shard_hits(index, keys, data, offsets)[2][:, 0])] = False
            yield batch.filter(pa.array(keep))

    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return numbered.mapInArrow(clean, numbered.schema).toDF(*docs.columns)
