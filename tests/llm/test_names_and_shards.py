"""Columns named like the operators' own, tables that end, and mixing over many shards."""

import os

import brute
import corpus_pipeline as P
import numpy as np
import pytest
from brightloom.llm import common, components, html_text, line_dedup, lm_score, mixing, pii, quality, secrets, simhash, token_counts
from pyspark.sql import functions as F

NAMES = ["__h", "__n", "__keep", "__lines", "__bare", "__at", "__places", "__gone", "__id", "__th", "__quality", "__quality_text", "q_base", "row", "p", "size", "words", "name", "h", "shard", "a.b", "c.d", "mix_pass", "mix_words", "__n_lines", "__n_removed"]
TEXT = "\n".join(" ".join(f"the t{i}x{j} of r{i}y{j}" for j in range(9)) for i in range(8))


@pytest.fixture(scope="module")
def odd(spark):
    docs = [(1, TEXT, "en", "s", *NAMES), (2, TEXT + "\nmore", "en", None, *NAMES), (3, None, "en", "s", *NAMES), (4, TEXT[::-1], "en", "t", *NAMES), (1, TEXT, "en", "s", *NAMES)]
    frame = spark.createDataFrame(docs, ["doc_id", "text", "lang", "source", *[f"x{i}" for i in range(len(NAMES))]])
    return frame.toDF("doc_id", "text", "lang", "source", *NAMES)


def test_stages_keep_columns_of_any_name(odd, spark, tmp_path):
    spark.createDataFrame([(1, "nothing of this is in any text")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in P.STAGES:
        got = stage(spark, odd, str(tmp_path))
        assert got.columns[: len(odd.columns)] == odd.columns, name
        rows = got.collect()
        assert rows and all(tuple(r)[4 : 4 + len(NAMES)] == tuple(NAMES) for r in rows), name


def test_operators_read_only_their_columns(odd):
    assert line_dedup.remove_repeats(odd).count() == 5 and quality.keep_good(odd).count() == 3 and simhash.groups(odd).count() == 5
    assert secrets.scan(odd, F.col("text"), "q").count() == pii.scan(odd).count() == token_counts.count_tokens(odd, scores={"a": -1.0}).count() == 5
    assert mixing.mix(odd).count() == lm_score.score(odd, whole_texts=True).count() == 5
    assert html_text.extract(odd, "a.b", "c.d", "text").count() == 5


def test_stored_tables_end(spark):
    since = common.tables_made()
    first, second = common.stored(spark.range(3)), common.stored(spark.range(4))
    paths = common._MADE[since:]
    common.forget_tables(spark, since, but_last=True)
    assert [os.path.exists(p.removeprefix("file:")) for p in paths] == [False, True] and second.count() == 4
    common.forget_tables(spark, since)
    assert not os.path.exists(paths[1].removeprefix("file:")) and common.tables_made() == since and first is not None


@pytest.mark.parametrize(("block", "shard"), [(50, 3), (7, 1), (20, 5)])
def test_mixing_over_many_shards(spark, block, shard):
    texts = [(i, " ".join(["w"] * (i * 37 % 120)), "abc"[i * i % 3] if i % 7 else None) for i in range(90)]
    texts += [(5, "x " * 37 * 5, "a"), (5, "y " * 37 * 5, "a")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    got = mixing.mix(docs, block_words=block, shard_docs=shard).collect()
    again = mixing.mix(docs.repartition(7), block_words=block, shard_docs=shard).collect()
    key = lambda rows: sorted((r.doc_id, r.size, r.taken) for r in rows)
    assert key(got) == key(again)
    target, taken = {}, {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        target[r.source], taken[r.source] = r.target, taken.get(r.source, 0) + r.taken
    blocks = {s: 0 for s in target}
    for _ in range(round(sum(target.values()) / block)):
        best = max(target, key=lambda s: (target[s] / (2 * blocks[s] + 1), s is None, tuple(-ord(c) for c in s or "")))
        blocks[best] += 1
    sizes = {s: sum(len(brute.words(t)) for _, t, x in texts if x == s) for s in target}
    assert taken == {s: min(blocks[s] * block, 2 * sizes[s]) for s in target}
    mixed = mixing.mixed_documents(docs, block_words=block, shard_docs=shard).collect()
    assert sum(r.mix_words for r in mixed) == sum(taken.values()) and all(len(brute.words(r.text)) == r.mix_words for r in mixed)


@pytest.mark.parametrize(("shard", "spread"), [(12, 3), (12, 9), (40, 24)])
def test_no_shard_stays_large_and_no_link_is_lost(spark, monkeypatch, shard, spread):
    monkeypatch.setattr(simhash, "SHARD", shard)
    rng = np.random.default_rng(spread)
    centre = int(rng.integers(0, 2**63))
    prints = {centre ^ sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(0, spread + 1))}) for _ in range(600)}
    signed = {f - 2**64 if f >> 63 else f: f for f in prints}
    nodes = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    sizes = [r["count"] for r in simhash._sharded(nodes, 4).groupBy("key").count().collect()]
    assert max(sizes) <= shard + 6 * shard**0.5  # blocks are dealt by hash
    roots = {r.node: r.root for r in components.components(simhash.links(nodes, 4)).collect()}
    assert {f: roots.get(f, f) for f in signed} == brute.components(signed, 4)
