"""Token counts by dynamic programming shared along a trie of pre-tokens.

A pre-token is a run without white space with the word mark in front. Its tokens are the pieces of the
best segmentation under a unigram model: the highest sum of scores, then the fewest pieces. A character
that no piece covers costs `UNKNOWN` below the worst score and counts as its UTF-8 bytes.

The distinct pre-tokens of a batch are visited in sorted order, which is the depth-first order of their
trie: the forward scores on the path stay on a stack, each shared prefix is scored once, and the count
stands at the word's last node. Documents stay in their rows and nothing is shuffled; the vocabulary is
the only thing sent out, at most `MOST_PIECES` entries. Null text has no tokens. Rows are counted one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import exact

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN = 10.0
MOST_PIECES = 1_000_000
BATCH_CHARS = 8_000_000


def unigram_scores(path: str = VOCABULARY) -> dict[str, float]:
    """Log-probabilities of the pieces of a vocabulary file: by Zipf's law in the order of its merges.

    The file has ranks and no probabilities; special and byte pieces are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if model.get_piece_size() > MOST_PIECES:
        raise ValueError(f"over {MOST_PIECES} pieces")
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return {p: -math.log(r + 1) - total for r, p in enumerate(pieces)}


class TrieCounter:
    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.tails = {p[i:] for p in scores for i in range(len(p))}
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN

    def counts(self, words: list[str]) -> list[int]:
        """The token counts of words in sorted order."""
        get, tails, unknown = self.scores.get, self.tails, self.unknown
        before, best, out = "", [(0.0, 0)], []  # best[i]: score, and pieces negated, of the first i characters
        for word in words:
            s = MARK + word
            shared = 0
            for a, b in zip(before, s, strict=False):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :]
            for i in range(shared + 1, len(s) + 1):
                score, n = best[i - 1]
                top = (score + unknown, n - len(s[i - 1].encode("utf-8", "surrogatepass")))
                for j in range(i - 1, -1, -1):
                    piece = s[j:i]
                    if piece not in tails:
                        break
                    if (own := get(piece)) is not None:
                        score, n = best[j]
                        if (way := (score + own, n - 1)) > top:
                            top = way
                best.append(top)
            out.append(-best[-1][1])
            before = s
        return out


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scores: dict[str, float] | None = None) -> DataFrame:
    """(id, n_words, n_tokens) per row."""
    scores = unigram_scores() if scores is None else scores
    rows = docs.select(exact(id_col), exact(text_col)).toDF("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TrieCounter(scores)

        def of(ids: list[pa.Array], texts: list[list[str]]) -> pa.RecordBatch:
            distinct = sorted(set().union(*texts)) if texts else []
            known = dict(zip(distinct, counter.counts(distinct), strict=True))
            sums = [sum(map(known.__getitem__, w)) for w in texts]
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays(ids), pa.array([len(w) for w in texts], pa.int64()), pa.array(sums, pa.int64())], names=["id", "n_words", "n_tokens"]
            )

        for batch in batches:
            ids, texts, chars = [], [], 0
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or ""
                ids.append(batch.column(0).slice(i, 1))
                texts.append([w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()])
                chars += len(text)
                if chars > BATCH_CHARS:
                    yield of(ids, texts)
                    ids, texts, chars = [], [], 0
            if ids:
                yield of(ids, texts)

    schema = T.StructType([rows.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(run, schema)
