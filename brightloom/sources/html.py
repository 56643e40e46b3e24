"""Links and fields from captured pages, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: What is a file and no page, by the path of its address; and the words around a link by which one applies, and what such a link is not.
ATTACHMENT = r"(?i)^[^?#]*\.(?:pdf|docx?|xlsx?|zip|rar)(?:[?#].*)?$"
APPLY_WORDS = ("报名", "申请", "投递", "网申", "应聘", "招聘平台", "招聘网", "apply", "application")
FORMS = ("pdf", "doc", "docx", "xls", "xlsx", "csv", "zip", "rar")
LABELLED = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*["']?([^"'\s>]*)["']?[^>]*>(.*?)</a>"""


#: An anchor's start tag with its address in double, single or no quotes.
HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def title(html: Column) -> Column:
    """What stands in the title element, empty without one; references stay as they are."""
    return F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)</title>", 1)


def meta(html: Column, names: Iterable[str]) -> Column:
    """The content of the first of the meta elements named, in the order of the names; null without one."""
    found = []
    for n in names:
        name = rf"""(?:name|property|itemprop)\s*=\s*["']?{re.escape(n)}["'\s]"""
        value = r"""content\s*=\s*["']([^"']*)["']"""
        found += [F.nullif(F.regexp_extract(html, rf"(?is)<meta\s[^>]*?{a}[^>]*?{b}", 1), F.lit("")) for a, b in ((name, value), (value, name))]
    return F.coalesce(*found)


#: Where pages state their day of publication.
PUBLISHED_META = ("article:published_time", "PubDate", "publishdate", "pubdate", "datePublished", "date", "og:published_time")


def published_meta(html: Column, names: Iterable[str] = PUBLISHED_META) -> Column:
    from brightloom.functions import dates

    return dates.any_date(meta(html, names))


def absolute(href: Column, page: Column) -> Column:
    """An address against its page's own: scheme, host, root, directory or query from the page; dot segments are resolved."""
    root = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    whole = F.regexp_extract(page, r"^([^?#]*)", 1)
    folder = F.when(F.length(whole) > F.length(root), F.regexp_extract(whole, r"^(.*/)", 1)).otherwise(F.concat(root, F.lit("/")))
    h = F.trim(href)
    joined = (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), h))
        .when(h.startswith("/"), F.concat(root, h)).when(h.startswith("?"), F.concat(whole, h)).when(h.startswith("#") | (h == ""), F.concat(whole, h)).otherwise(F.concat(folder, h))
    )
    head = F.regexp_extract(joined, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path, tail = F.regexp_extract(joined, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.regexp_extract(joined, r"^[^?#]*([?#].*)$", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != ".")
    up = lambda done, p: F.when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.array_append(done, p))
    resolved = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/")
    last_dots = path.rlike(r"/\.{1,2}$")
    return F.when(head == "", joined).when(path.rlike(r"(^|/)\.{1,2}(/|$)"), F.concat(head, resolved, F.when(last_dots, "/").otherwise(""), tail)).otherwise(joined)


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, position, href) of the anchors, from 1; addresses in double, single or no quotes."""
    hrefs = F.transform(F.regexp_extract_all(html, F.lit(HREF), F.lit(0)), lambda a: F.concat(*[F.regexp_extract(a, HREF, i) for i in (1, 2, 3)]))
    return pages.select(key, F.posexplode(hrefs).alias("position", "href")).withColumn("position", F.col("position").cast("long") + 1)


def notice_links(pages: DataFrame, key: str, html: str, url: str, hosts: Column, wanted: str, unwanted: str | None = None, most: int | None = None) -> DataFrame:
    """(key, position, title, href): anchors with a wanted title on an allowed host, no attachments, each address once per page.

    Addresses are taken against the page's own. Anchors in CDATA blocks of scripts count like others.
    """
    from brightloom.functions import text, urls

    anchors = F.regexp_extract_all(html, F.lit(LABELLED), F.lit(0))
    rows = pages.select(key, hosts.alias("__hosts"), F.col(url).alias("__base"), F.posexplode(anchors).alias("position", "a"))
    label = text.clean(F.regexp_replace(F.regexp_extract("a", LABELLED, 2), "<[^>]*>", " "))
    href = F.regexp_extract("a", LABELLED, 1)
    href = absolute(href, F.col("__base"))
    rows = rows.select(key, "position", "__hosts", label.alias("title"), urls.normalize(href).alias("href"))
    good = urls.is_http(F.col("href")) & urls.host_allowed(F.col("href"), F.col("__hosts")) & ~F.col("href").rlike(ATTACHMENT) & F.col("title").rlike(wanted)
    if unwanted:
        good = good & ~F.col("title").rlike(unwanted)
    first = rows.filter(good).groupBy(key, "href").agg(F.min("position").alias("position"), F.min_by("title", "position").alias("title"))
    if most is not None:
        from pyspark.sql import Window

        first = first.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("position"))).filter(F.col("__n") <= most).drop("__n")
    return first.select(key, "position", "title", "href")


def application_link(document: Column, words: Sequence[str] = APPLY_WORDS, forms: Sequence[str] = FORMS) -> Column:
    """The address of the first link that speaks of applying, itself or in the text around it, and is no file; null if there is none.

    Around it is its paragraph, or what it stands in directly. Case counts for nothing. A page's tree is read, as a paragraph may hold elements of any depth.
    """
    from brightloom.sources import tree

    words, file = [w.lower() for w in words], re.compile(rf"\.(?:{'|'.join(map(re.escape, forms))})$", re.IGNORECASE)

    @pandas_udf(T.StringType())
    def read(documents: pd.Series) -> pd.Series:
        def speaks(said: str) -> bool:
            said = " ".join(said.split()).lower()
            return any(w in said for w in words)

        def first(page: str | None) -> str | None:
            around: dict[int, bool] = {}  # a list's links share what they stand in
            for a in tree.select(tree.parsed(page or ""), "a[href]"):
                href = a.attributes["href"]
                if not href or file.search(re.split("[?#]", href.strip(), maxsplit=1)[0]):
                    continue
                near = a.parent
                while near.tag and near.tag != "p":
                    near = near.parent
                near = near if near.tag else a.parent
                if id(near) not in around:
                    around[id(near)] = speaks(near.text())
                if around[id(near)] or speaks(a.text() or a.attributes.get("title", "")):
                    return href
            return None

        return documents.map(first)

    return read(document)
