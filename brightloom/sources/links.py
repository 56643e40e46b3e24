"""Links of captured listing pages by the rules of their source: one Arrow pass over each page's tree, then ordered tests as column expressions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom.functions import text, urls
from brightloom.sources.html import absolute

#: What a source says of its links. Patterns are regular expressions in which case counts for nothing.
RULES = (
    "listing_selector string, allowed_hosts array<string>, excluded_title_patterns array<string>, required_title_patterns array<string>, exclude_patterns array<string>, include_patterns array<string>, "
    "detail_path_patterns array<string>, include_keywords array<string>, accept_all_entries boolean, require_recruitment_word boolean, require_major_match boolean"
)
#: Fixed value: what is a file and no page, by its path.
ATTACHMENT = r"(?i)\.(?:pdf|docx?|xlsx?|zip|rar)$"


def anchors(pages: DataFrame, keys: Sequence[str], url: str, html: str, selector: str) -> DataFrame:
    """(keys, url, position, title, href): the anchors of each page by its selector (null: all), in page order; a selector that can't be read gives one row with neither title nor href."""
    from brightloom.sources import tree

    rows = pages.select(*keys, url, html, selector)
    schema = T.StructType([*(rows.schema[k] for k in (*keys, url)), T.StructField("position", T.LongType()), T.StructField("title", T.StringType()), T.StructField("href", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                owner, found = [], []
                for i, (page, chosen) in enumerate(zip(some.column(len(keys) + 1).to_pylist(), some.column(len(keys) + 2).to_pylist(), strict=True)):
                    try:
                        here = list(tree.anchors(page or "", chosen))
                    except ValueError:
                        here = [(None, None)]
                    owner += [i] * len(here)
                    found += [(n, *a) for n, a in enumerate(here, 1)]
                places = pa.array(owner, pa.int64())
                columns = [some.column(i).take(places) for i in range(len(keys) + 1)]
                columns += [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def _any(patterns: Column, value: Column) -> Column:
    """Some pattern of a column's array occurs in the value."""
    return F.coalesce(F.exists(patterns, lambda p: F.regexp_like(value, F.concat(F.lit("(?iu)"), p))), F.lit(False))


def _given(patterns: Column) -> Column:
    return F.coalesce(F.size(patterns) > 0, F.lit(False))


def judged(found: DataFrame, url: str, not_vacancies: Sequence[str], words: Sequence[str], majors: Sequence[str]) -> DataFrame:
    """anchors() with the RULES columns: adds `address` and `rejected`, the first test in order that an anchor fails; null if it passes all.

    not_vacancies: patterns of titles that announce no vacancy; words and majors: what makes a text one about jobs.
    """
    title = text.clean(F.col("title"))
    address = urls.normalize(absolute(F.col("href"), F.col(url)))
    host = lambda u: F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    bare = lambda h: F.regexp_replace(h, r":\d*$", "")
    path, query = F.regexp_extract("address", r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.regexp_extract("address", r"\?([^#]*)", 1)
    # the outer explode keeps the optimizer from resolving the address anew in every test
    known = F.struct(title.alias("title"), F.when(F.col("href") != "", address).alias("address"))
    d = found.withColumn("__known", F.explode_outer(F.array(known)))
    d = d.select(*[F.col("__known.title").alias(c) if c == "title" else F.col(c) for c in found.columns], F.col("__known.address").alias("address"))
    said = F.concat_ws(" ", "title", "address")
    low = F.lower(said)
    own = (F.col("__host") == host(F.col(url))) | (bare(F.col("__host")) == bare(host(F.col(url))))
    allowed = own | F.coalesce(F.array_contains("allowed_hosts", F.col("__host")) | F.array_contains("allowed_hosts", bare(F.col("__host"))), F.lit(False))
    word, major = text.contains_any(low, [w.lower() for w in words]), text.contains_any(low, [m.lower() for m in majors])
    wants = lambda c: F.coalesce(c, F.lit(False))
    named = F.coalesce(F.exists("include_keywords", lambda k: F.contains(low, F.lower(k))), F.lit(False))
    accepted = wants("accept_all_entries") | (
        (~wants("require_recruitment_word") | word) & (~wants("require_major_match") | major) & (~_given(F.col("include_keywords")) | named) & (word | major)
    )
    tests = (
        ("no address or title", (F.coalesce("href", F.lit("")) == "") | (F.col("title") == "")),
        ("no vacancy", text.matches_any(F.col("title"), not_vacancies)),
        ("title", _any(F.col("excluded_title_patterns"), F.col("title")) | (_given(F.col("required_title_patterns")) & ~_any(F.col("required_title_patterns"), F.col("title")))),
        ("scheme", ~F.coalesce(F.col("address").rlike("^https?://"), F.lit(False))),
        ("host", ~allowed),
        ("attachment", path.rlike(ATTACHMENT)),
        ("excluded", _any(F.col("exclude_patterns"), said)),
        ("not accepted", ~accepted),
        ("not included", _given(F.col("include_patterns")) & ~_any(F.col("include_patterns"), said)),
        ("path", _given(F.col("detail_path_patterns")) & ~_any(F.col("detail_path_patterns"), F.concat(path, F.lit("?"), query))),
    )
    chain = None
    for name, fails in tests:
        chain = F.when(fails, name) if chain is None else chain.when(fails, name)
    return d.withColumn("__host", host(F.col("address"))).withColumn("rejected", chain).drop("__host")


def links(pages: DataFrame, rules: DataFrame, not_vacancies: Sequence[str], words: Sequence[str], majors: Sequence[str], url: str = "url", html: str = "html", most: str | None = None) -> DataFrame:
    """(source_id, page, position, title, address): the links of each page that pass its source's rules, each address once, the first of a page.

    pages: source_id and the page's address and html; rules: source_id and the RULES columns (absent ones hold for none). most: a column of
    rules with the number of links of a page to take, which is the source's own limit.
    """
    wanted = dict(c.rsplit(" ", 1) for c in RULES.split(", "))
    columns = [(F.col(c) if c in rules.columns else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()]
    limit = [F.col(most).cast("int").alias("__most")] if most else []
    configured = pages.select("source_id", url, html).join(rules.select("source_id", *columns, *limit), "source_id")
    found = anchors(configured.withColumn("__rules", F.struct(*wanted, *(["__most"] if most else []))), ["source_id", "__rules"], url, html, "listing_selector")
    good = judged(found.select("*", "__rules.*").drop("__rules"), url, not_vacancies, words, majors).filter(F.col("rejected").isNull())
    keep = [F.min("position").alias("position"), F.min_by("title", "position").alias("title"), *([F.min("__most").alias("__most")] if most else [])]
    once = good.groupBy("source_id", F.col(url).alias("page"), "address").agg(*keep)
    if most:
        place = F.row_number().over(Window.partitionBy("source_id", "page").orderBy("position"))
        once = once.withColumn("__n", place).filter(F.col("__most").isNull() | (F.col("__n") <= F.col("__most")))
    return once.select("source_id", "page", "position", "title", "address")
