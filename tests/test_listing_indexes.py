"""Feeds, pages by ranges and trigram look-ups against what they stand for."""

import random

import pytest
from brightloom.functions import text
from brightloom.operators import listing, pages, text_index
from brightloom.sources import feeds
from pyspark.sql import functions as F

RSS = """<?xml version="1.0"?><rss xmlns:dc="http://x"><channel><title>T</title><item><title>Jobs &amp;amp; more</title><link>https://a.b/1</link><guid isPermaLink="false">g1</guid><description><![CDATA[geology]]></description><pubDate>2026-09-01</pubDate></item>
<item><title>about us</title><link>/2</link></item><item><title>Jobs two</title><link>../3?utm_x=1</link><dc:description>d</dc:description></item><item><title>Jobs none</title></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title type="text">Jobs E1</title><link rel="alternate" href="https://a.b/e1"/><link rel="self" href="zz"/><summary>s</summary><updated>2026-01-02</updated></entry></feed>"""


def test_feeds(spark):
    docs = [("r", "https://a.b/x/y", RSS), ("a", "https://a.b/", ATOM), ("bad", "u", "<rss><channel>"), ("bad2", "u", "not xml"), ("none", "u", None), ("blank", "u", "<rss><channel></channel></rss>"), ("few", "https://a.b/x/y", RSS), ("all", "https://a.b/x/y", RSS)]
    d = spark.createDataFrame(docs, "source_id string, url string, document string")
    rules = spark.createDataFrame([(s, "P", "H" if s == "a" else None, 2 if s == "few" else None, s == "all") for s, _, _ in docs], "source_id string, publisher string, employer_hint string, max_items int, accept_all_entries boolean")
    got = {}
    for r in feeds.postings(d, rules, ["JOBS"], ["geology"]).collect():
        got.setdefault(r.source_id, []).append((r.position, r.title, r.source_url, r.employer, r.error))
    assert sorted(got["r"]) == [(1, "Jobs & more", "https://a.b/1", "P", None), (3, "Jobs two", "https://a.b/3", "P", None)]
    assert got["a"] == [(1, "Jobs E1", "https://a.b/e1", "H", None)] and [x[0] for x in got["few"]] == [1] and sorted(x[0] for x in got["all"]) == [1, 2, 3]
    assert got["bad"][0][4] == got["bad2"][0][4] == "Invalid RSS XML" and not {"none", "blank"} & got.keys()
    first = feeds.postings(d, rules, ["jobs"], []).filter("source_id = 'r' AND position = 1").first()
    assert (first.text, first.published_date, first.external_id, first.summary) == ("Jobs & more geology", "2026-09-01", "g1", "geology")


@pytest.mark.parametrize("ranges", [1, 4, 13])
def test_pages_equal_offsets(spark, tmp_path, ranges):
    rng = random.Random(ranges)
    rows = [(i, rng.choice([None, *range(5)]), rng.choice("xyz") * 3) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, score int, `a.b` string").repartition(5)
    order = [F.desc_nulls_last("score"), F.col("id")]
    pages.build(df, order, f"file://{tmp_path}/p", ranges)
    listed = pages.Pages(spark, f"file://{tmp_path}/p")
    assert listed.total == 200 and listed.count(7) == 29
    want = [tuple(r) for r in df.orderBy(*order).collect()]
    for size, numbers in ((7, (-1, 1, 2, 15, 29, 30)), (200, (1, 2)), (1000, (1,))):
        for n in numbers:
            at = (max(1, n) - 1) * size
            assert [tuple(r) for r in listed.page(n, size).collect()] == want[at : at + size]
    assert [tuple(r) for r in listed.page(3, 20).collect()] == [tuple(r) for r in listing.page(df, order, 3, 20).collect()]
    plan = listed.page(15, 7)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__range" in plan and "PushedFilters" in plan


def test_no_pages(spark, tmp_path):
    pages.build(spark.createDataFrame([], "id long"), [F.col("id")], f"file://{tmp_path}/p")
    listed = pages.Pages(spark, f"file://{tmp_path}/p")
    assert (listed.total, listed.count(5), listed.page(1, 5).count(), listed.page(1, 5).columns) == (0, 0, 0, ["id"])


def test_every_needle_finds_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(8)
    words = ["Geology", "geo", "Straße", "漢字 探す", "GIS\tEngineer", "a%b", "x_y", "𝒳𝒴𝒵 math", "İstanbul", "", "the", "theme"]
    rows = [(i, rng.choice([None, " ".join(rng.choices(words, k=rng.randint(0, 6)))]), rng.choice([None, *words])) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, t string, u string").repartition(4)
    text_index.build(df, "id", ["t", "u"], f"file://{tmp_path}/i")
    for needle in ("geology", "EOL", "ology the", "straße", "漢字 探", "字 ", "a%b", "x_y", "𝒳𝒴𝒵", "istanbul", "İST", "", "th", "the", "gis\te", "nothing here", "themegeo"):
        want = sorted(r.id for r in df.filter(text.keyword_search([F.col("t"), F.col("u")], needle)).collect())
        assert sorted(r.id for r in text_index.search(df, "id", ["t", "u"], f"file://{tmp_path}/i", needle).collect()) == want, needle
    assert text_index.candidates(spark, f"file://{tmp_path}/i", "th") is text_index.candidates(spark, f"file://{tmp_path}/i", "a%b") is None
    assert text_index.candidates(spark, f"file://{tmp_path}/i", "nothing here").count() == 0
