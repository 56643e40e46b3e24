"""Readers of whole sources: from a source's captured documents to its postings, one call for each type, and from all sources to records.

A reader is made of the rules of its type's sources and takes documents (source_id, position, url, document) as collect.split gives them; it
returns POSTING rows, of which one with an error makes its source a failure. `records` puts the types together and gives what sync takes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.functions import dates, text, urls
from brightloom.operators import normalise
from brightloom.sources import collect, details, feeds, links, nested
from brightloom.sources.html import absolute

POSTING = "source_id string, position long, title string, employer string, source_url string, text string, summary string, published_date string, deadline_date string, location string, external_id string, application_url string, match_text string"
_NAMES = [c.split()[0] for c in POSTING.split(", ")]


def shaped(rows: DataFrame) -> DataFrame:
    """The POSTING columns and error, null where the rows have none."""
    kinds = dict(c.split() for c in POSTING.split(", ")) | {"error": "string"}
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])


def notices(rules: DataFrame, detail: details.Detail, not_vacancies: Sequence[str], words: Sequence[str], majors: Sequence[str]) -> collect.Reader:
    """Listing pages, their links in order, and the pages these lead to.

    rules: source_id, publisher, listing_urls (an array; the source's documents of these addresses are its listings, in that order), the columns of
    links.RULES, and if there are any max_items and location_hint. An address counts once for a source, where it is first; the source's first max_items are
    followed. An address that was not captured, or whose page the detail refuses, is a posting less and no failure.
    """

    def read(documents: DataFrame) -> DataFrame:
        optional = {"max_items": "int", "location_hint": "string"}
        r = rules.select(*rules.columns, *[F.lit(None).cast(t).alias(c) for c, t in optional.items() if c not in rules.columns])
        listed = r.select("source_id", F.posexplode("listing_urls").alias("__listing", "__url")).select("source_id", "__listing", urls.normalize(F.col("__url")).alias("__url"))
        d = documents.select("source_id", urls.normalize(F.col("url")).alias("url"), "document").dropDuplicates(["source_id", "url"])
        pages = d.join(listed, (d["source_id"] == listed["source_id"]) & (F.col("url") == F.col("__url"))).select(d["source_id"], "url", "document", "__listing")
        found = links.links(pages, r, not_vacancies, words, majors, html="document").join(pages.select("source_id", F.col("url").alias("page"), "__listing"), ["source_id", "page"])
        at = F.struct("__listing", "position")
        once = found.groupBy("source_id", "address").agg(F.min(at).alias("at"), F.min_by("title", at).alias("title"))
        place = F.row_number().over(Window.partitionBy("source_id").orderBy("at"))
        hints = r.select("source_id", "publisher", "max_items", F.col("location_hint").alias("location"))
        once = once.withColumn("position", place).join(hints, "source_id").filter(F.col("max_items").isNull() | (F.col("position") <= F.col("max_items")))
        followed = once.join(d.select("source_id", F.col("url").alias("address"), "document"), ["source_id", "address"])
        followed = followed.select("source_id", "position", "publisher", "title", "location", F.lit(None).cast("string").alias("published_date"), F.col("address").alias("href"), "document")
        return shaped(details.details(followed, detail, F.col("publisher")))

    return read


def rss(rules: DataFrame, words: Sequence[str], majors: Sequence[str], denied: Sequence[str] = ()) -> collect.Reader:
    """Feeds; rules as for feeds.postings."""
    return lambda documents: shaped(feeds.postings(documents, rules, words, majors, denied))


def json(rules: DataFrame, items_path: str, fields: Mapping[str, str], words: Sequence[str], majors: Sequence[str], denied: Sequence[str] = ()) -> collect.Reader:
    """Lists of JSON documents: items at a dotted path, with title, url and whatever else of the POSTING columns at paths of their own.

    rules: source_id, publisher, and if there are any accept_all_entries, require_recruitment_word, require_major_match. A document that is no JSON is an error; an item
    without title or address is left out.
    """

    def read(documents: DataFrame) -> DataFrame:
        flags = ("accept_all_entries", "require_recruitment_word", "require_major_match")
        r = rules.select("source_id", "publisher", *[(F.col(c) if c in rules.columns else F.lit(None)).cast("boolean").alias(c) for c in flags])
        d = documents.select("source_id", F.col("position").alias("__document"), F.col("url").alias("__page"), "document")
        rows = nested.items(d, "document", items_path, {f"__{k}": p for k, p in fields.items()}).join(r, "source_id")
        value = lambda k: F.col(f"__{k}") if k in fields else F.lit(None).cast("string")
        title, body = text.clean(value("title")), text.clean(value("text"))
        said = F.concat_ws(" ", title, body)
        good = (title != "") & text.blank_to_null(value("url")).isNotNull() & normalise.accepts(said, denied, words, majors, F.col("require_recruitment_word"), F.col("require_major_match"), F.col("accept_all_entries"))
        day = lambda k, other: F.coalesce(dates.any_date(value(k)), other).cast("string")
        out = {
            "source_id": F.col("source_id"), "position": F.row_number().over(Window.partitionBy("source_id").orderBy("__document", "item")), "title": title, "employer": F.coalesce(text.blank_to_null(value("employer")), F.col("publisher")),
            "source_url": urls.normalize(absolute(value("url"), F.col("__page"))), "text": said, "summary": text.truncated(body, 420), "published_date": day("published_date", F.lit(None).cast("date")), "deadline_date": day("deadline_date", dates.deadline(said)),
            "location": value("location"), "external_id": value("external_id"), "application_url": value("application_url"),
        }
        bad = d.filter(F.try_parse_json("document").isNull()).select("source_id", F.lit("not valid JSON").alias("error"))
        return shaped(rows.filter(good).select(*[v.alias(k) for k, v in out.items()])).unionByName(shaped(bad))

    return read


def records(collected: DataFrame, sources: DataFrame, readers: Mapping[str, collect.Reader], v: normalise.Vocabulary, today: Column, employers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, failures) of all sources, as sync takes them: what a source could not read or its documents don't hold is a failure of that source alone.

    collected: of collect.collect, read twice, so stored by the caller; sources: source_id, source_tier, and if there are any category and undated_open_window_days.
    """
    whole, unread = collect.split(collected)
    found, unparsed = collect.postings(whole, readers, POSTING)
    s = sources.select(
        "source_id", "source_tier", *[(F.col(c) if c in sources.columns else F.lit(None)).cast(t).alias(n) for c, n, t in (("category", "source_category", "string"), ("undated_open_window_days", "undated_open_window_days", "int"))]
    )
    return normalise.posting(found.join(s, "source_id"), v, today, employers=employers), unread.unionByName(unparsed)
