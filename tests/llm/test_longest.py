"""Longest verbatim matches against all pairs of places; several test blocks; clashing names."""

import random

import brute
import pytest
from brightloom.llm import decontaminate


def longest(words, items):
    best = 0
    for item in items:
        for i in range(len(words)):
            for j in range(len(item)):
                n = 0
                while i + n < len(words) and j + n < len(item) and words[i + n] == item[j + n]:
                    n += 1
                if n >= 10 or n == len(item):
                    best = max(best, n)
    return best


@pytest.mark.parametrize("seed", range(4))
def test_longest_match_is_that_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    letters = "abc"[: 2 + seed % 2]
    some = lambda n: " ".join(rng.choice(letters) for _ in range(n))
    items = [(i, some(rng.randrange(1, 60))) for i in range(12)]
    items += [(20, items[0][1] + " x " + items[1][1]), (21, items[2][1]), (22, None)]
    docs = [(i, " ".join(some(rng.randrange(0, 30)) + " " + rng.choice(items[:12])[1] for _ in range(3)) + rng.choice([" y", ""])) for i in range(15)]
    docs += [(99, None), (98, items[0][1])]
    bench, table = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    words = lambda t: brute.BENCH.findall((t or "").translate(brute.LOWER))
    want = {d: (longest(words(t), [words(x) for _, x in items if words(x)]), *brute.decontaminate({d: t}, dict(items))[d]) for d, t in docs}
    for chars in (10_000, 150):
        for r in decontaminate.find(table, bench, block_chars=chars).collect():
            got = r.longest.words if r.longest else 0
            assert (got, r.n_words, r.n_hit, r["items"]) == want[r.id]
            if r.longest:
                item = words(dict((str(k), t) for k, t in items)[r.longest["item"]])
                assert words(dict(docs)[r.id])[r.longest.start :][:got] == item[r.longest.item_start :][:got]


def test_a_match_of_a_later_place_of_its_first_window(spark):
    bench = spark.createDataFrame([(1, "a0 b c d e f g h i j"), (2, "zz a0 b c d e f g h i j k")], "item_id long, text string")
    docs = spark.createDataFrame([(7, "x zz a0 b c d e f g h i j y", "1")], "doc_id long, text string, `a.b` string")
    r = decontaminate.find(docs, bench).first()
    assert (r.longest.words, r.longest.start, r.longest["item"], r["items"]) == (11, 1, "2", ["1", "2"])
    for chars in (10_000, 20):
        left = decontaminate.remove_contaminated(docs, bench, block_chars=chars)
        assert left.columns == docs.columns and left.count() == 0
        assert decontaminate.remove_contaminated(docs, bench.filter("item_id > 2"), block_chars=chars).count() == 1
