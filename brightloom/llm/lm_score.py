"""LM scoring: unigram base scores and prediction by partial matching, learnt from the training documents.

A row trains unless crc32(id as text) mod 5 is 1 (null ids train). Tokens are the words after lower-casing
A-Z, then one end per text; null text is empty and has its end only. All counts cover all training rows.

Nothing of the model is broadcast but the order-1 counts (at most 65,536 rows). Lookups go by chunks: the
documents are dealt by hash to chunks of about CHUNK_CHARS characters, each chunk asks once for each of its
distinct tokens, the answers come back by chunk, and every document is scored beside its chunk's own
dictionary. A frequent token is thus one row per chunk, not one per occurrence. Likewise each chunk counts the
grams of its whole texts, whose contexts cross word borders, before anything is shuffled, and asks once for each
distinct gram. Grams are grouped by the last two bytes of context, inside which a trie is complete; the four
bytes left of each travel packed, one row per chunk and group, and pass by one at a time. A chunk stays in Arrow's
buffers: Python has the texts of one batch at a time, and no string for a token that is only looked up. Rows are scored
one by one, repeated or not. With whole_texts=False contexts end at the word and each distinct token is coded once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import ppm
from .common import SPACE_CHARS, ascii_lower, exact, stored
from .words import Finder, hashed, places

_TWO = np.uint64(8 * (ppm.ORDER - 1))
CHUNK_CHARS = 16_000_000
CHUNK_TOKENS = 250_000
BATCH_CHARS = 4_000_000
MERGE_GRAMS = 4_000_000


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 1, F.lit(False))


#: A byte as a symbol, zero between words.
_SYMBOLS = np.arange(1, 257, dtype=np.uint16)
_SYMBOLS[list(SPACE_CHARS.encode())] = 0


def _bytes_of(strings: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings, and where each begins, and the end; null is empty."""
    strings = pc.fill_null(strings, "").cast(pa.large_binary())
    if isinstance(strings, pa.ChunkedArray):
        strings = pa.concat_arrays(strings.chunks) if strings.num_chunks else pa.array([], pa.large_binary())
    _, offsets, data = strings.buffers()
    if not len(strings):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _hashes(symbols: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """hashed(), by runs of words of about ppm.BLOCK symbols: a word's value does not depend on its place."""
    out, begin = np.empty(len(at), np.uint64), 0
    while begin < len(at):
        end = max(begin + 1, int(np.searchsorted(to, at[begin] + ppm.BLOCK, "right")))
        out[begin:end] = hashed(symbols[at[begin] : to[end - 1]], at[begin:end] - at[begin], to[begin:end] - at[begin])
        begin = end
    return out


class _Tokens:
    """The words of a batch of texts: hashes, the text of each, and the bytes."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray):
        self.data, offsets = _bytes_of(texts)
        symbols = _SYMBOLS[self.data]
        self.at, self.to = places(symbols, offsets)
        self.hashes = _hashes(symbols, self.at, self.to)
        self.lengths = np.diff(np.searchsorted(self.at, offsets))
        self.owner = np.repeat(np.arange(len(texts), dtype=np.int32), self.lengths)

    def words(self, which: np.ndarray) -> pa.Array:
        words = (self.data[a:b].tobytes() for a, b in zip(self.at[which].tolist(), self.to[which].tolist(), strict=True))
        return pa.array(words, pa.binary()).cast(pa.string())


def _counted_tokens(chunk: pa.Table) -> pa.Table:
    """(chunk, token, n) of a chunk's distinct tokens; the empty one is the end of a text."""
    texts, out = chunk["text"], chunk["held_out"].to_numpy()
    hashes, counts, place = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = [pa.array([""])]
    for part in _text_batches(texts):
        tokens = _Tokens(texts[part])
        order = np.argsort(tokens.hashes)
        ordered = tokens.hashes[order]
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][: len(ordered)])
        distinct, n = ordered[first], np.add.reduceat((~out[part])[tokens.owner[order]], first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
        at = np.searchsorted(hashes, distinct)
        there = at < len(hashes)
        there[there] = hashes[at[there]] == distinct[there]
        counts[at[there]] += n[there]
        words.append(tokens.words(order[first[~there]]))
        places_of = len(hashes) + 1 + np.arange(len(words[-1]))
        hashes, counts, place = (np.insert(old, at[~there], new) for old, new in ((hashes, distinct[~there]), (counts, n[~there]), (place, places_of)))
    total = np.empty(len(hashes) + 1, np.int64)
    total[0], total[place] = (~out).sum(), counts
    token = pa.chunked_array(words)
    return pa.table({"chunk": np.full(len(token), chunk["chunk"][0].as_py(), np.int32), "token": token, "n": total})


def _chunk_tokens(rows: DataFrame) -> DataFrame:
    """(chunk, token, n): the distinct tokens of every chunk with their occurrences in training rows."""
    return rows.groupBy("chunk").applyInArrow(_counted_tokens, "chunk int, token string, n bigint")


def _text_batches(texts: pa.ChunkedArray) -> Iterator[slice]:
    """Slices of about BATCH_CHARS characters."""
    begin, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.utf8_length(texts), 0).to_numpy().tolist()):
        size += n
        if size >= BATCH_CHARS or i + 1 == len(texts):
            yield slice(begin, i + 1)
            begin, size = i + 1, 0


def _counted_grams(texts: pa.ChunkedArray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of all texts in order, with their occurrences in training texts."""

    def of(part: slice) -> list[tuple[np.ndarray, np.ndarray]]:
        grams, begin = ppm.text_grams(texts[part].to_pylist())
        apart = np.repeat(out[part], np.diff(begin))
        others, grams = grams[apart], grams[~apart]
        train, seen = ppm.distinct(grams), ppm.distinct(others)
        return [train, (seen[0], np.zeros_like(seen[1]))]

    found = [pair for part in _text_batches(texts) for pair in of(part)]
    return ppm.summed(*map(np.concatenate, zip(*found, strict=True)))


def _counted(chunk: pa.Table) -> pa.Table:
    """(chunk, token, n, two, grams, counts): rows of tokens, where two is -1, and of grams by their last two bytes of context."""
    tokens = _counted_tokens(chunk)
    grams, counts = _counted_grams(chunk["text"], chunk["held_out"].to_numpy())
    two, first = np.unique(grams >> _TWO, return_index=True)
    low = grams.astype("<u4")
    pieces = list(zip(first, np.append(first[1:], len(grams)), strict=True))
    packed = pa.table(
        {
            "chunk": np.full(len(two), chunk["chunk"][0].as_py(), np.int32), "token": pa.nulls(len(two), pa.string()), "n": np.zeros(len(two), np.int64), "two": two.astype(np.int32),
            "grams": pa.array([ppm.packed_in_order(low[a:b]) for a, b in pieces], pa.binary()), "counts": pa.array([ppm.packed(counts[a:b]) for a, b in pieces], pa.binary()),
        }
    )
    none = pa.nulls(len(tokens), pa.binary())
    for name, column in (("two", np.full(len(tokens), -1, np.int32)), ("grams", none), ("counts", none)):
        tokens = tokens.append_column(name, pa.array(column) if name == "two" else column)
    return pa.concat_tables([tokens, packed])


def _chunk_tokens_and_grams(rows: DataFrame) -> DataFrame:
    """The rows of _counted() of every chunk."""
    return rows.groupBy("chunk").applyInArrow(_counted, "chunk int, token string, n bigint, two int, grams binary, counts binary")


def _unpacked(two: int, grams: bytes) -> np.ndarray:
    return ppm.unpacked_in_order(grams).astype(np.uint64) | np.uint64(two) << _TWO


def gram_answers(asked: DataFrame) -> DataFrame:
    """(chunk, two, grams, scores) from (chunk, two, grams, counts): log10 probabilities under the model of all counts, packed."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for two, grams, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                at = (two >> 8) << 8 | (ppm.unpacked_in_order(grams) & 0xFF).astype(np.int64)
                total += np.bincount(at, ppm.unpacked(counts), len(total)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    counted = asked.select("two", "grams", "counts")
    rows = counted.mapInArrow(near, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).orderBy("at").collect()  # bytes by bytes: 65,536 rows at most
    low_model = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], float))

    def models(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, size = None, [], 0

        def model() -> pa.RecordBatch:
            grams, counts = ppm.summed(*map(np.concatenate, zip(*held, strict=True)))
            scores = ppm.log_probabilities(grams, counts.astype(float), low_model)
            values = [[here], [ppm.packed_in_order(grams.astype("<u4"))], [scores.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["two", "grams", "scores"])

        for batch in batches:
            for two, grams, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if two != here:
                    if held:
                        yield model()
                    here, held, size = two, [], 0
                held.append((_unpacked(two, grams), ppm.unpacked(counts).astype(np.int64)))
                size += len(held[-1][0])
                if size > MERGE_GRAMS + 2 * len(held[0][0]):
                    held = [ppm.summed(*map(np.concatenate, zip(*held, strict=True)))]
                    size = len(held[0][0])
        if held:
            yield model()

    by_two = counted.repartition("two").sortWithinPartitions("two")
    model = by_two.mapInArrow(models, "two int, grams binary, scores binary")

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = scores = None

        def answered() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "two", "grams", "scores"])

        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for two, chunk, grams, found in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if chunk < 0:
                    known, scores = ppm.unpacked_in_order(grams), np.frombuffer(found)
                else:
                    rows.append((chunk, two, grams, scores[np.searchsorted(known, ppm.unpacked_in_order(grams))].tobytes()))
                    size += len(rows[-1][3]) // 8
                    if size > MERGE_GRAMS:
                        yield answered()
                        rows, size = [], 0
            yield answered()

    both = model.select("two", F.lit(-1).alias("chunk"), "grams", "scores").union(asked.select("two", "chunk", "grams", F.lit(None).cast("binary")))
    return both.repartition("two").sortWithinPartitions("two", "chunk").mapInArrow(answers, "chunk int, two int, grams binary, scores binary")


def _gram_rows(tokens: DataFrame, by_chunk: bool) -> DataFrame:
    """(gram, n) summed per batch, or (chunk, gram) distinct per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, begin = ppm.token_grams(batch.column(1).to_pylist())
            lengths = np.diff(begin)
            if by_chunk:
                chunk = np.repeat(batch.column(0).to_numpy(), lengths)
                order = np.lexsort((grams, chunk))
                chunk, grams = chunk[order], grams[order]
                new = np.r_[True, (np.diff(chunk) != 0) | (np.diff(grams) != 0)][: len(grams)]
                yield pa.RecordBatch.from_arrays([pa.array(chunk[new]), pa.array(grams[new].view(np.int64))], names=["chunk", "gram"])
            else:
                found, which = np.unique(grams, return_inverse=True)
                n = np.bincount(which, np.repeat(batch.column(0).to_numpy(), lengths), len(found))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])

    return tokens.mapInArrow(run, "chunk int, gram bigint" if by_chunk else "gram bigint, n bigint")


def token_scores(tokens: DataFrame) -> DataFrame:
    """(token, c, score) from (token, c): log10 probability of every distinct token under the model of all with c > 0."""
    tokens = tokens.select("token", F.col("c").alias("c"))
    counts = stored(_gram_rows(tokens.select("c", "token"), False).groupBy("gram").agg(F.sum("n").alias("n")))
    near = F.shiftright("gram", 8 * ppm.ORDER)
    low = counts.groupBy(near.alias("byte"), F.col("gram").bitwiseAND(255).alias("symbol")).agg(F.sum("n").alias("n")).filter("n > 0")
    rows = low.orderBy("byte", "symbol").collect()  # bytes by bytes: 65,536 rows at most
    low_model = (np.array([r[0] << 8 | r[1] for r in rows], np.uint64), np.array([r[2] for r in rows], float))

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("gram")
        found = ppm.log_probabilities(frame["gram"].to_numpy().view(np.uint64), frame["n"].to_numpy().astype(float), low_model)
        return pd.DataFrame({"gram": frame["gram"], "score": found})

    scored = counts.withColumn("two", F.shiftright("gram", 8 * (ppm.ORDER - 1))).groupBy("two").applyInPandas(score, "gram bigint, score double")
    n_chunks = max(1, -(-tokens.count() // CHUNK_TOKENS))
    dealt = tokens.withColumn("chunk", F.pmod(F.xxhash64("token"), F.lit(n_chunks)).cast("int"))
    asked = _gram_rows(dealt.repartition("chunk").sortWithinPartitions("chunk").select("chunk", "token"), True).distinct()
    answers = asked.join(scored, "gram").select("chunk", "gram", "score")

    def total(own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("gram")
        grams, begin = ppm.token_grams(own["token"].tolist())
        each = known["score"].to_numpy()[np.searchsorted(known["gram"].to_numpy(), grams.view(np.int64))]
        return pd.DataFrame({"token": own["token"], "c": own["c"], "score": np.add.reduceat(each, begin[:-1]) if len(own) else each})

    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(total, "token string, c bigint, score double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_texts: bool = False) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row; whole_texts: contexts cross word borders."""
    chars = docs.agg(F.coalesce(F.sum(F.length(exact(text_col))), F.lit(0))).first()[0]
    chunks = max(1, -(-int(chars) // CHUNK_CHARS))
    rows = docs.select(exact(id_col).alias("id"), ascii_lower(exact(text_col)).alias("text"), held_out(exact(id_col)).alias("held_out"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("int"))
    if whole_texts:
        found = stored(_chunk_tokens_and_grams(rows))
        asked = found.filter("two < 0").select("chunk", "token", "n")
        tokens = stored(asked.groupBy("token").agg(F.sum("n").alias("c"))).withColumn("score", F.lit(0.0))
        packed = gram_answers(found.filter("two >= 0").select("chunk", "two", "grams", "counts"))
    else:
        asked = stored(_chunk_tokens(rows))
        tokens = stored(token_scores(asked.groupBy("token").agg(F.sum("n").alias("c"))))
    known = F.col("c") > 0
    n, v = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(known, 1))).first()
    floor, size = 0.5, n + 0.5 * (v + 1)
    answers = asked.join(tokens, "token").select("chunk", "token", "c", "score")
    if whole_texts:
        answers = answers.withColumn("two", F.lit(-1)).unionByName(packed, allowMissingColumns=True)

    schema = T.StructType(
        [rows.schema["id"], T.StructField("held_out", T.BooleanType()), *[T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known")], *[T.StructField(x, T.DoubleType()) for x in ("base_score", "score")]]
    )
    id_type = to_arrow_type(schema["id"].dataType)

    def of(own: pa.Table, answers: pa.Table) -> pa.Table:
        return _scored(own.set_column(own.column_names.index("id"), "id", own["id"].cast(id_type)), answers, floor, size, whole_texts)

    scored = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(of, schema)
    return scored.select("id", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")


def _scored(own: pa.Table, answers: pa.Table, floor: float, size: float, whole_texts: bool) -> pa.Table:
    """The rows of a chunk with their sums, from the answers to its tokens and, of whole texts, to its grams."""
    texts = own["text"]
    if whole_texts:
        grams, scores = _gram_scores(answers.filter(pc.greater_equal(answers["two"], 0)))
        answers = answers.filter(pc.less(answers["two"], 0))
        finder = Finder(grams)
        score = np.concatenate([_text_scores(texts[part].to_pylist(), finder, scores) for part in _text_batches(texts)])
        del finder, grams, scores
    c = answers["c"].to_numpy()
    known = _KnownTokens(answers["token"], c, np.log10((c + floor) / size), answers["score"].to_numpy())
    found = dict(zip(("n_tokens", "n_known", "base_score", "score"), map(np.concatenate, zip(*(known.sums(texts[part]) for part in _text_batches(texts)), strict=True)), strict=True))
    if whole_texts:
        found["score"] = score
    return pa.table({"id": own["id"], "held_out": own["held_out"]} | found)


def _gram_scores(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's grams in order and their scores, from rows of them by their last two bytes of context."""
    pairs = []
    for row in pc.sort_indices(answers["two"]).to_pylist():
        two, packed, scores = (answers[name][row] for name in ("two", "grams", "scores"))
        pairs.append((_unpacked(two.as_py(), packed.as_py()), np.frombuffer(scores.as_buffer())))
    return tuple(map(np.concatenate, zip(*pairs, strict=True)))


def _text_scores(texts: list[str | None], known: Finder, scores: np.ndarray) -> np.ndarray:
    grams, begin = ppm.text_grams(texts)
    each = grams.view(float)  # a block's scores take its grams' place
    for at in range(0, len(grams), ppm.BLOCK):
        each[at : at + ppm.BLOCK] = scores[known.find(grams[at : at + ppm.BLOCK])]
    return np.add.reduceat(each, begin[:-1])


class _KnownTokens:
    """A chunk's dictionary by hash: how often each token occurs, its base score and its score."""

    def __init__(self, words: pa.ChunkedArray, c: np.ndarray, base: np.ndarray, scores: np.ndarray):
        data, begin = _bytes_of(words)
        self.end, others = (np.flatnonzero(x) for x in (np.diff(begin) == 0, np.diff(begin) > 0))
        self.finder, self.order = Finder(_hashes(_SYMBOLS[data], begin[others], begin[others + 1])), others
        self.values = ((c > 0).astype(float), base, scores)

    def sums(self, texts: pa.ChunkedArray) -> tuple[np.ndarray, ...]:
        """Per text the number of its tokens and of known ones, and the sums of base and score; each text has an end."""
        tokens = _Tokens(texts)
        at = self.order[self.finder.find(tokens.hashes)]
        known, base, score = (np.bincount(tokens.owner, v[at], len(texts)) + v[self.end] for v in self.values)
        return tokens.lengths + 1, known.astype(np.int64), base, score
