"""LM scores of whole texts: contexts cross word borders."""

import math
import zlib
from collections import Counter

import brute
import pytest
from brightloom.llm import lm_score, ppm
from pyspark.sql import GroupedData
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

TEXTS = ["the river of stone and the paper window", "stone river the of and window paper the", None, "", "\u6f22\u5b57 \x0b tail  Tail", "a b a b a c", "of the river the stone", "c a b a b a"] * 2


def plain(texts, train):
    """Prediction by partial matching over running bytes, one symbol at a time."""
    coded = lambda t: bytes(ppm.ORDER - 1) + b" " + b"".join(w.encode() + b" " for w in brute.words((t or "").translate(brute.LOWER))) + b"\n"
    trie = {}
    for s in map(coded, train):
        for i in range(ppm.ORDER, len(s)):
            for k in range(ppm.ORDER + 1):
                trie.setdefault(s[i - k : i], Counter())[s[i]] += 1
    for s in map(coded, texts):
        total = 0.0
        for i in range(ppm.ORDER, len(s)):
            excluded, p = set(), 1.0
            for k in range(ppm.ORDER, -1, -1):
                seen = {x: n for x, n in trie.get(s[i - k : i], {}).items() if x not in excluded}
                if not seen:
                    continue
                n, q = sum(seen.values()), len(seen)
                if s[i] in seen:
                    p *= (seen[s[i]] - 0.5) / n
                    break
                p *= 0.5 * q / n
                excluded |= set(seen)
            else:
                p /= 256 - len(excluded)
            total += math.log10(p)
        yield total


@pytest.mark.parametrize(("chunk", "batch", "merge"), [(16_000_000, 4_000_000, 4_000_000), (60, 50, 5)])
def test_scores_are_those_of_running_bytes(spark, monkeypatch, chunk, batch, merge):
    for name, value in (("CHUNK_CHARS", chunk), ("BATCH_CHARS", batch), ("MERGE_GRAMS", merge)):
        monkeypatch.setattr(lm_score, name, value)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.id: r.score for r in lm_score.score(docs, whole_texts=True).collect()}
    train = [t for d, t in enumerate(TEXTS) if zlib.crc32(str(d).encode()) % 5 != 1]
    assert len(train) < len(TEXTS)
    for d, want in enumerate(plain(TEXTS, train)):
        assert math.isclose(got[d], want, abs_tol=1e-6)
    assert lm_score.score(docs.limit(0), whole_texts=True).count() == 0


def test_shuffled_words_score_less(spark):
    out = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    docs = spark.createDataFrame([(d, TEXTS[out(d)]) for d in range(30)], "doc_id long, text string")
    got = {r.held_out: r for r in lm_score.score(docs, whole_texts=True).collect()}
    assert got[True].n_known == got[False].n_known == 9 and abs(got[True].base_score - got[False].base_score) < 1e-9
    assert got[False].score > got[True].score + 5


def test_a_worker_makes_few_arrays_of_the_size_of_a_batch(spark, monkeypatch, tmp_path):
    folder = str(tmp_path)

    def measured(function, *parts):
        import tracemalloc
        import uuid

        tracemalloc.start()
        try:
            return function(*parts)
        finally:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
                out.write(str(tracemalloc.get_traced_memory()[1]))
            tracemalloc.stop()

    def watch(kind, name, wrapped):
        apply = getattr(kind, name)
        monkeypatch.setattr(kind, name, lambda self, function, schema: apply(self, wrapped(function), schema))

    for name in ("applyInPandas", "applyInArrow"):
        watch(GroupedData, name, lambda function: lambda rows: measured(function, rows))
        watch(PandasCogroupedOps, name, lambda function: lambda left, right: measured(function, left, right))
    word = lambda i: F.hex(F.pmod(F.xxhash64("doc_id", i), F.lit(20_000)))
    docs = spark.range(1000).select(F.col("id").alias("doc_id")).withColumn("text", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(850)), word), " "))
    scored = lm_score.score(docs, whole_texts=True).agg(F.count("*"), F.min("n_tokens"), F.max("n_tokens")).first()
    assert tuple(scored) == (1000, 851, 851)
    peaks = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert len(peaks) == 2 and max(peaks) < 40 * lm_score.BATCH_CHARS
