"""From captured documents of several types of sources to records and a sync."""

from brightloom import storage
from brightloom.operators import normalise, sync
from brightloom.sources import collect, details, readers
from pyspark.sql import functions as F

LISTING = '<a href="/n/1">Jobs one</a><a href="/n/2">Jobs two</a><a href="/n/3">about</a><a href="/n/9">Jobs never captured</a><a href="/n/4">Jobs short</a>'
SECOND = '<a href="/n/2">Jobs two again</a><a href="/n/5">Jobs five</a><a href="/n/6">Jobs six</a>'
PAGE = "<h1>Jobs {0} in full</h1><article>Geology work number {0} for many people who like stones. 报名截止时间为2099-01-0{0}。 Location: North</article>"
RSS = "<rss><channel><item><title>Jobs in a feed</title><link>/f/1</link><description>d</description></item></channel></rss>"


def test_all_sources_to_records_and_a_sync(spark, tmp_path):
    docs = [("notes", "https://n.org/list", LISTING), ("notes", "https://n.org/list2", SECOND), *(("notes", f"https://n.org/n/{i}", PAGE.format(i)) for i in (1, 2, 5, 6)), ("notes", "https://n.org/n/4", "<h1>Jobs</h1>short")]
    docs += [("feed", "https://f.org/x", RSS), ("broken feed", "https://b.org/", "<rss>"), ("list", "https://j.org/", '{"data": {"rows": [{"name": "Jobs listed", "link": "/j/1", "code": 7, "where": "South"}, {"name": "other", "link": "/j/2"}, {"name": "Jobs no link"}]}}'), ("bad list", "https://k.org/", "oops")]
    path = f"file://{tmp_path}/c"
    collect.capture(spark.createDataFrame(docs, "source_id string, url string, document string"), path)
    kinds = {"notes": "html", "feed": "rss", "broken feed": "rss", "list": "json", "bad list": "json", "refusing": "html"}
    (tmp_path / "c" / "source_id=refusing").mkdir()
    (tmp_path / "c" / "source_id=refusing" / "_refused").write_text("robots.txt")
    sources = spark.createDataFrame([(s, k, True, "A", 0) for s, k in kinds.items()], "source_id string, source_type string, enabled boolean, source_tier string, minimum_relevance int")
    rules = sources.select("source_id", F.upper("source_id").alias("publisher"))
    listings = rules.withColumns({"listing_urls": F.array(F.lit("https://n.org/list"), F.lit("https://n.org/list2")), "max_items": F.lit(5)})
    by_type = {
        "html": readers.notices(listings, details.Detail(least_characters=30, location_label=("Location", ())), [], ["jobs"], []), "rss": readers.rss(rules, ["jobs"], []),
        "json": readers.json(rules, "data.rows", {"title": "name", "url": "link", "external_id": "code", "location": "where"}, ["JOBS"], []),
    }
    collected = storage.stored(collect.collect(spark, sources, collect.CapturedSources, path=path))
    found, failures = readers.records(collected, sources, by_type, normalise.Vocabulary(majors=(("Geology", 30),)), F.lit("2026-09-18").cast("date"))
    found = found.cache()
    got = sorted((r.source_id, r.position, r.title, r.source_url, r.employer) for r in found.collect())
    assert got == [
        ("feed", 1, "Jobs in a feed", "https://f.org/f/1", "FEED"), ("list", 1, "Jobs listed", "https://j.org/j/1", "LIST"), ("notes", 1, "Jobs 1 in full", "https://n.org/n/1", "NOTES"),
        ("notes", 2, "Jobs 2 in full", "https://n.org/n/2", "NOTES"), ("notes", 5, "Jobs 5 in full", "https://n.org/n/5", "NOTES"),
    ]
    one = found.filter("source_id = 'notes' AND position = 1").first()
    assert (str(one.deadline_date), one.major_tags, one.relevance_score, one.status, one.location) == ("2099-01-01", ["Geology"], 50, "open", "North")
    assert {tuple(r) for r in failures.collect()} == {("broken feed", False, "Invalid RSS XML"), ("bad list", False, "not valid JSON"), ("refusing", True, "robots.txt")}
    state = "fingerprint string, content_hash string, source_id string, status string, first_seen_at timestamp, last_seen_at timestamp, updated_at timestamp"
    health = "source_id string, status string, checked_at timestamp, status_code int, detail string, last_success_at timestamp"
    done = sync.sync(spark.createDataFrame([], state), spark.createDataFrame([], health), sources, found, failures, ["source_id", "status"], F.lit("2026-09-18").cast("timestamp"))
    assert {(r.source_id, r.status, r.inserted_count) for r in done.runs.collect()} == {("feed", "finished", 1), ("list", "finished", 1), ("notes", "finished", 3), ("broken feed", "failed", 0), ("bad list", "failed", 0), ("refusing", "skipped", 0)}
    assert done.events.count() == 5 and {(r.source_id, r.status) for r in done.health.collect()} >= {("refusing", "source_blocked"), ("broken feed", "source_error"), ("feed", "source_active")}
