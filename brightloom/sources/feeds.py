"""Feeds from captured documents: RSS items, or Atom entries where a document has no item, by one parse of the XML column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.functions import text, urls
from brightloom.operators import normalise
from brightloom.sources.html import absolute

_TEXT = "struct<_VALUE:string,_href:string,_isPermaLink:string,_rel:string,_type:string>"
_ENTRY = f"struct<title:array<{_TEXT}>,link:array<{_TEXT}>,guid:array<{_TEXT}>,description:array<{_TEXT}>,content:array<{_TEXT}>,summary:array<{_TEXT}>,pubDate:array<{_TEXT}>,published:array<{_TEXT}>,updated:array<{_TEXT}>>"
#: A document's root holds the items itself, in a channel, or as entries.
_SCHEMA = f"channel array<struct<item:array<{_ENTRY}>>>, item array<{_ENTRY}>, entry array<{_ENTRY}>, __bad string"


def entries(documents: DataFrame, document: str, most: str | None = None) -> DataFrame:
    """Every entry of every document: position from 1, title, link, description, published, external_id, error; other columns stay.

    most: a column with the number of entries of a document that are looked at, from the first, whatever becomes of them. Prefixes of names
    don't count. A document that is no XML has one row with an error and no position; one without entries, or null, has none. Of a name that
    is there more than once the first counts; a link is an element's text, else its address.
    """
    feed = F.from_xml(document, _SCHEMA, {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    d = documents.withColumn("__feed", feed)
    none = F.array().cast(f"array<{_ENTRY}>")
    items = F.concat(F.coalesce(F.flatten(F.transform("__feed.channel", lambda c: F.coalesce(c["item"], none))), none), F.coalesce("__feed.item", none))
    found = F.when(F.size(items) > 0, items).otherwise(F.coalesce("__feed.entry", none))
    found = F.slice(found, F.lit(1), F.greatest(F.col(most), F.lit(0))) if most else found
    bad = F.col("__feed.__bad").isNotNull() & (F.trim(document) != "") | (F.trim(document) == "")
    rows = d.withColumn("__error", F.when(bad, "Invalid RSS XML")).withColumn("__items", F.when(F.col("__error").isNull(), found).otherwise(F.array(F.lit(None).cast(_ENTRY))))
    rows = rows.select(*documents.columns, "__error", F.posexplode("__items").alias("__at", "__e"))
    first = lambda *names: F.coalesce(*[text.blank_to_null(F.get(F.col(f"__e.{n}"), 0)["_VALUE"]) for n in names])
    link = F.coalesce(first("link"), text.blank_to_null(F.get(F.col("__e.link"), 0)["_href"]))
    clean = lambda c: F.when(F.col("__error").isNull(), text.clean(c, references=True))
    return rows.select(
        *documents.columns, F.when(F.col("__error").isNull(), F.col("__at").cast("long") + 1).alias("position"), clean(first("title")).alias("title"), link.alias("link"), clean(first("description", "content", "summary")).alias("description"),
        first("pubDate", "published", "updated").alias("published"), first("guid").alias("external_id"), F.col("__error").alias("error"),
    )


#: A feed's posting: what normalise.posting takes, and the error of a document that can't be read.
POSTING = "source_id string, position long, title string, employer string, source_url string, text string, summary string, published_date string, deadline_date string, location string, external_id string, error string"


def postings(documents: DataFrame, rules: DataFrame, words: Sequence[str], majors: Sequence[str], denied: Sequence[str] = ()) -> DataFrame:
    """Entries as raw postings (POSTING): those with a title and a link that their source takes.

    documents: source_id, url, document; rules: source_id, publisher, and if they have them employer_hint, location_hint, max_items, accept_all_entries,
    require_recruitment_word, require_major_match. A link is taken against the document's own address.
    """
    from brightloom.functions import dates

    optional = {"employer_hint": "string", "location_hint": "string", "max_items": "int", "accept_all_entries": "boolean", "require_recruitment_word": "boolean", "require_major_match": "boolean"}
    r = rules.select("source_id", "publisher", *[(F.col(c) if c in rules.columns else F.lit(None)).cast(t).alias(c) for c, t in optional.items()])
    found = entries(documents.select("source_id", "url", "document").join(r.withColumn("__most", F.coalesce("max_items", F.lit(2**31 - 1))), "source_id"), "document", "__most")
    said = F.concat_ws(" ", "title", "description")
    taken = normalise.accepts(said, denied, words, majors, F.col("require_recruitment_word"), F.col("require_major_match"), F.col("accept_all_entries"))
    good = F.col("error").isNotNull() | ((F.col("title") != "") & F.col("link").isNotNull() & taken)
    day = lambda c: c.cast("string")
    return found.filter(good).select(
        "source_id", "position", "title", F.coalesce("employer_hint", "publisher").alias("employer"), urls.normalize(absolute(F.col("link"), F.col("url"))).alias("source_url"), said.alias("text"), text.truncated(F.col("description"), 420).alias("summary"),
        day(dates.published(F.coalesce("published", F.lit("")))).alias("published_date"), day(dates.deadline(said)).alias("deadline_date"), F.col("location_hint").alias("location"), "external_id", "error",
    )


def is_feed(document: Column) -> Column:
    """The text begins as XML does."""
    return F.coalesce(F.ltrim(document).startswith("<"), F.lit(False))
