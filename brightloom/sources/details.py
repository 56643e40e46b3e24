"""Details of captured pages: listing pages to links to detail pages, and the fields of a detail by elements, tables and labels.

Pages are rows; a detail that is missing or refused is a row less, never an error. One pandas UDF reads the elements that
selectors name; all else is column expressions. Selectors are a tag, .class, #id or tag.class.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from brightloom.functions import dates, rules, text, urls
from brightloom.sources import html as pages_html
from brightloom.sources import portals

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Elements(HTMLParser):
    """The text of the first element of each selector, and of the whole page; what is removed has none."""

    def __init__(self, selectors: Sequence[str], removed: Sequence[str]):
        super().__init__(convert_charrefs=True)
        self.selectors, self.removed = [(s, *_parsed(s)) for s in selectors], [_parsed(s) for s in removed]
        self.open: list[tuple[str, list[str], bool]] = []  # tag, selectors that began here, removed
        self.found: dict[str, list[str]] = {"": []}
        self.active: dict[str, int] = {}
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            return
        named = dict(attrs)
        classes, own = (named.get("class") or "").split(), named.get("id") or ""
        fits = lambda t, kind, name: (not t or t == tag) and (not kind or (name in classes if kind == "." else name == own))
        gone = any(fits(*r) for r in self.removed)
        began = []
        if not self.hidden and not gone:
            for s, *parts in self.selectors:
                if s not in self.found and fits(*parts):
                    self.found[s] = []
                    self.active[s] = 1
                    began.append(s)
        self.hidden += gone
        self.open.append((tag, began, gone))

    def handle_endtag(self, tag: str) -> None:
        if tag not in (t for t, *_ in self.open):
            return
        while self.open:
            t, began, gone = self.open.pop()
            self.hidden -= gone
            for s in began:
                self.active.pop(s, None)
            if t == tag:
                break

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.found[""].append(data)
            for s in self.active:
                self.found[s].append(data)


def _parsed(selector: str) -> tuple[str, str, str]:
    m = re.fullmatch(r"([a-zA-Z][\w-]*)?(?:([.#])([\w-]+))?", selector)
    if not m or not selector:
        raise ValueError(f"selector {selector!r}")
    return (m[1] or "").lower(), m[2] or "", m[3] or ""


def elements(document: Column, wanted: Mapping[str, Sequence[str]], removed: Sequence[str] = ("script", "style", "noscript")) -> Column:
    """struct of texts: for each name the first of its selectors, in their order, that has text; `page` is the whole page's."""
    selectors = list(dict.fromkeys(s for ss in wanted.values() for s in ss))
    for s in (*selectors, *removed):
        _parsed(s)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*wanted, "page")])

    @pandas_udf(schema)
    def read(documents: pd.Series) -> pd.DataFrame:
        rows = []
        for d in documents:
            parser = _Elements(selectors, removed)
            parser.feed(d or "")
            parser.close()
            texts = {s: " ".join(" ".join(x).split()) for s, x in parser.found.items()}
            rows.append([*(next((texts[s] for s in ss if texts.get(s)), None) for ss in wanted.values()), texts[""]])
        return pd.DataFrame(rows, columns=[*wanted, "page"])

    return read(document)


def with_detail_pages(links: DataFrame, pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Links (href, ...) with the captured page of their address as `document`; links without a page go."""
    captured = pages.select(urls.normalize(F.col(url)).alias("href"), F.col(html).alias("document"))
    return links.join(captured.dropDuplicates(["href"]), "href")


def table_fields(document: Column, aliases: Mapping[str, str]) -> Column:
    """map of the rows of tables that begin with a known label: its alias to the text of the other cells; the last row of a label wins."""
    plain = lambda x: text.clean(F.regexp_replace(x, r"(?s)<[^>]*>", " "))

    def entry(row: Column) -> Column:
        cells = F.filter(F.transform(F.regexp_extract_all(row, F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)(?=</t[hd]>|<t[hd]\b|\z)"), F.lit(1)), plain), lambda c: c != "")
        label = F.regexp_replace(F.get(cells, 0), "[：:]+$", "")
        return F.struct(rules.lookup(label, aliases).alias("key"), F.array_join(F.slice(cells, F.lit(2), F.greatest(F.size(cells), F.lit(1))), " ").alias("value"))

    rows = F.regexp_extract_all(document, F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=</tr>|<tr\b|</table>|\z)"), F.lit(1))
    found = F.filter(F.transform(rows, entry), lambda e: e["key"].isNotNull() & (e["value"] != ""))
    names = F.array_distinct(F.transform(found, lambda e: e["key"]))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(found, lambda e: e["key"] == k), -1)["value"]))


@dataclass(frozen=True)
class Detail:
    """What a kind of detail page holds and what it must hold. Patterns are of titles; labels are read in running text."""

    title: Sequence[str] = ("h1",)
    content: Sequence[str] = ("article", "main", "body")
    employer: Sequence[str] = ()
    location: Sequence[str] = ()
    removed: Sequence[str] = ("script", "style", "noscript")
    title_label: tuple[str, Sequence[str]] | None = None
    location_label: tuple[str, Sequence[str]] | None = None
    location_field: str | None = None
    table: Mapping[str, str] = field(default_factory=dict)
    summary_fields: Sequence[str] = ()
    match_fields: Sequence[str] = ()
    generic_titles: Sequence[str] = ()
    excluded: Sequence[str] = ()
    required: Sequence[str] = ()
    least_characters: int = 0
    location_evidence: bool = False
    packed: bool = False
    employer_markers: Sequence[str] = ()
    apply_words: Sequence[str] = pages_html.APPLY_WORDS


def details(rows: DataFrame, d: Detail, publisher: Column) -> DataFrame:
    """Postings of detail pages.

    rows: href, document, and hints: title, location, published_date (ISO text). Adds or replaces title, employer, source_url,
    application_url, text, summary, published_date, deadline_date, location, external_id and match_text. Pages whose
    title is excluded or lacks what is required, that are too short, or that do not name the hinted place go.
    """
    wanted = {"title": d.title, "content": d.content, "employer": d.employer or ("h1",), "location": d.location or ("h1",)}
    body_html = F.coalesce(portals.embedded_article(F.nullif(F.regexp_extract("document", portals.PACKED, 1), F.lit(""))), F.col("document")) if d.packed else F.col("document")
    r = rows.withColumn("__body", body_html).withColumn("__e", elements(F.col("document"), wanted, d.removed)).withColumn("__b", elements(F.col("__body"), {"content": d.content}, d.removed))
    body = text.clean(F.coalesce("__b.content", "__b.page"))
    meta = pages_html.meta(F.col("document"), ("ArticleTitle", "og:title"))
    labelled = text.label_value(body, *d.title_label) if d.title_label else F.lit(None).cast("string")
    found = [labelled, F.col("__e.title"), meta, F.nullif(pages_html.title(F.col("document")), F.lit(""))]
    generic = lambda c: F.when(~text.clean(c).isin(*d.generic_titles), c) if d.generic_titles else c
    title = text.clean(F.coalesce(*[generic(text.blank_to_null(c)) for c in found], F.col("title")))
    r = r.withColumns({"__hint": F.col("location"), "__title": title, "__text": body, "__fields": table_fields(F.col("__body"), d.table) if d.table else F.create_map().cast("map<string,string>")})
    keep = text.title_allowed(F.col("__title"), d.excluded, d.required) & (F.length("__text") >= d.least_characters)
    if d.location_evidence:
        keep = keep & (F.col("__hint").isNull() | portals.location_evidenced(F.col("__hint"), F.col("__text")))
    r = r.filter(keep)
    places = [F.try_element_at("__fields", F.lit(d.location_field))] if d.location_field else []
    places += [F.col("__e.location")] if d.location else []
    places += [text.label_value(F.col("__text"), *d.location_label)] if d.location_label else []
    named = text.before_earliest(F.col("__title"), d.employer_markers) if d.employer_markers else F.lit(None).cast("string")
    employer = F.coalesce(*([text.blank_to_null(F.col("__e.employer"))] if d.employer else []), named, publisher)
    listed = text.joined_fields([(k, F.try_element_at("__fields", F.lit(k))) for k in d.summary_fields]) if d.summary_fields else F.lit("")
    evidence = F.concat_ws(" ", *[F.try_element_at("__fields", F.lit(k)) for k in d.match_fields]) if d.match_fields else F.lit("")
    out = {
        "employer": employer, "source_url": urls.normalize(F.col("href")), "application_url": F.nullif(urls.normalize(pages_html.absolute(pages_html.application_link(F.col("document"), d.apply_words), F.col("href"))), F.lit("")),
        "text": F.concat_ws(" ", "__title", "__text"), "summary": F.coalesce(F.nullif(listed, F.lit("")), text.truncated(F.col("__text"), 420)),
        "published_date": F.coalesce(F.try_to_date("published_date"), pages_html.published_meta(F.col("document")), dates.published(F.col("__text"))), "deadline_date": dates.deadline(F.col("__text")),
        "location": F.coalesce(*[text.blank_to_null(p) for p in places], F.col("__hint")), "external_id": urls.external_id(F.col("href")),
        "match_text": F.concat_ws(" ", "__title", F.when(evidence != "", evidence).otherwise(F.col("__text"))),
    }
    done = r.select("*", *[c.alias(f"__new_{k}") for k, c in out.items()])
    kept = [c for c in rows.columns if c not in out and c not in ("title", "document")]
    return done.select(*kept, F.col("__title").alias("title"), *[F.col(f"__new_{k}").alias(k) for k in out])


def position_postings(rows: DataFrame, fields: Mapping[str, str], accepted: Column, publisher: Column, other_code: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Postings of the positions of an announcement.

    rows: view_id, title, url, published_date, deadline_date, position (struct). fields: our names (employer, role, code, major,
    degree, location, more...) to the position's; other_code: its field that names a position without code. Rows without role go; `accepted` judges
    `eligibility`, which has no employer's name. keep: columns of the rows to give as well.
    """
    value = lambda k: text.clean(F.col("position")[fields[k]]) if k in fields else F.lit("")
    more = F.concat_ws(" ", *[value(k) for k in fields if k not in ("employer", "role")])
    r = rows.withColumns({"__who": F.coalesce(F.nullif(value("employer"), F.lit("")), publisher), "__role": value("role"), "__more": text.clean(more)})
    r = r.withColumn("eligibility", F.concat_ws(" ", "__role", "__more")).filter((F.col("__role") != "") & accepted)
    shown = lambda k: F.coalesce(F.nullif(value(k), F.lit("")), F.lit("未注明"))
    summary = F.concat(F.lit("岗位："), "__role", F.lit("；专业："), shown("major"), F.lit("；学历："), shown("degree"), F.lit("；地点："), shown("location"))
    codes = [value("code"), *([text.clean(F.col("position")[other_code])] if other_code else [])]
    code = F.coalesce(*[F.nullif(c, F.lit("")) for c in codes], F.col("__role"))
    return r.select(
        *keep,
        F.concat_ws(" - ", "__who", "__role").alias("title"), F.col("__who").alias("employer"), F.col("url").alias("source_url"), F.concat_ws(" ", "title", "__more").alias("text"), summary.alias("summary"), "published_date", "deadline_date",
        F.nullif(value("location"), F.lit("")).alias("location"), F.concat_ws(":", "view_id", code).alias("external_id"), F.concat_ws(" ", "__who", "eligibility").alias("match_text"),
    )


def candidate_key(title: Column, address: Column, key: Column, hosts: Column, excluded: Sequence[str], required: Sequence[str]) -> Column:
    """The key of a search result (or its address) if its title is allowed and its host is one of the source's, else null."""
    good = (text.clean(title) != "") & text.title_allowed(title, excluded, required) & urls.host_allowed(address, hosts)
    return F.when(F.coalesce(good, F.lit(False)), F.coalesce(text.blank_to_null(key), text.blank_to_null(address)))


def row_cards(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, position, title, href, cells): the table rows of a listing that have a link, with the clean texts of their cells."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=</tr>|<tr\b|</table>|\z)"), F.lit(1))
    cells = F.regexp_extract_all("r", F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)(?=</t[hd]>|<t[hd]\b|\z)"), F.lit(1))
    plain = lambda x: text.clean(F.regexp_replace(x, r"(?s)<[^>]*>", " "))
    r = pages.select(key, F.posexplode(rows).alias("position", "r")).filter(F.col("r").rlike(pages_html.LABELLED))
    return r.select(key, "position", plain(F.regexp_extract("r", pages_html.LABELLED, 2)).alias("title"), F.regexp_extract("r", pages_html.LABELLED, 1).alias("href"), F.transform(cells, plain).alias("cells"))
