"""Very long candidates without recursion, regular words that a plain polynomial hash confuses, addresses of long parts."""

import brute
import pytest
from brightloom.llm import decontaminate, lm_score, pii, secrets
from brightloom.llm.common import text_or_empty
from pyspark.sql import functions as F


@pytest.mark.parametrize(("text", "spans"), [
    ("ab-" * 1_000_000 + "ab", ""), ("ab/" * 1_000_000, ""), ("/ab/c.d" * 200_000, ""), ("a_b" * 300_000 + "-", "entropy"), ("aB3-" * 30_000, ""), ("x" * 2_000_000, ""),
])
def test_long_candidates_end_nothing(spark, text, spans):
    got = secrets.scan(spark.createDataFrame([(text,)], "text string"), text_or_empty(), "q").select("q.*").first()
    assert got.base_spans == "" and (got.spans == "" or spans and got.spans.startswith(spans) or got.n_entropy <= 1)
    assert got.n_assign == got.n_access == got.n_hex == 0


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_regular_words_are_told_apart(spark, n):
    one = thue_morse(n)
    other = one.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, other), (2, one), (3, f"x {one} y")], "doc_id long, text string")
    found = {r.id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.find(docs, spark.createDataFrame([(7, one)], "item_id long, text string")).collect()}
    assert found == {1: (1, 0, []), 2: (1, 1, ["7"]), 3: (3, 1, ["7"])} == {k: tuple(v) for k, v in brute.decontaminate({1: other, 2: one, 3: f"x {one} y"}, {7: one}).items()}
    rows = [(i, f"{one} word{i} and more") for i in range(40)] + [(100 + i, f"{other} here") for i in range(40)]
    scored = lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), whole_texts=True).filter("held_out").collect()
    trained = {r.id for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), whole_texts=True).filter("not held_out").collect()}
    words = {w for i, t in rows if i in trained for w in t.split()} | {""}
    for r in scored:
        text = dict(rows)[r.id]
        assert r.n_known == sum(w in words for w in text.split()) + 1
    only = spark.createDataFrame([(i, one) for i in range(5)] + [(200, other)], "doc_id long, text string")
    for r in lm_score.score(only, whole_texts=True).filter((F.col("id") == 200) & F.col("held_out")).collect():
        assert r.n_known == 1


@pytest.mark.parametrize("part", ["999999999", "1000000000", "256", "00000000256", "12345678901234"])
def test_added_addresses_have_parts_of_at_most_255(part):
    text = f"from 1.1.1.{part} at"
    start = text.index("1.1")
    assert not list(pii._tested(text, (start, pii.KINDS.index("ip"), len(text) - 3)))
    assert list(pii._tested("a 1.1.1.0255 b", (2, pii.KINDS.index("ip"), 12)))
