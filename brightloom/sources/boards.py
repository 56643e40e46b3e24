"""Readers of job boards: announcements with positions, search results, rows of result pages and encrypted portals, one call for each type of source.

Like the readers of `readers`, each is made of the rules of its sources and takes their captured documents (source_id, position, url, document); a document's
part is told by its address: a list, a detail or a page by the end of its path, and what it is the detail of by a parameter of its query. Only what can't be read is an
error, and makes its source a failure. Postings are numbered by listing and place in it; a source's first max_items count.

A listing is one document, and all else is joined by source and key: a source of very many listings is no one task's work.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from brightloom.functions import dates, places, text, urls
from brightloom.operators import normalise
from brightloom.sources import collect, details, nested, portals
from brightloom.sources.html import absolute
from brightloom.sources.readers import shaped
from brightloom.storage import stored

_FLAGS = {"accept_all_entries": "boolean", "require_recruitment_word": "boolean", "require_major_match": "boolean"}


def _rules(rules: DataFrame, **optional: str) -> DataFrame:
    """The rules with max_items and the optional columns, null where they have none."""
    kinds = {"max_items": "int"} | optional
    return rules.select(*rules.columns, *[F.lit(None).cast(t).alias(c) for c, t in kinds.items() if c not in rules.columns])


def _ending(documents: DataFrame, path: str) -> DataFrame:
    return documents.filter(F.coalesce(urls.part(F.col("url"), "PATH").endswith(path), F.lit(False)))


def _of_key(documents: DataFrame, path: str, parameter: str, key: str) -> DataFrame:
    """(source_id, key, document): the first document for each value of the query's parameter."""
    asked = F.try_url_decode(F.try_parse_url(F.col("url"), F.lit("QUERY"), F.lit(parameter)))
    found = _ending(documents, path).select("source_id", "position", asked.alias(key), "document").filter(F.col(key).isNotNull())
    return found.groupBy("source_id", key).agg(F.min_by("document", "position").alias("document"))


def _once(rows: DataFrame, key: str) -> DataFrame:
    """The first row of each key of a source, by __outer and __inner."""
    kept = rows.groupBy("source_id", key).agg(F.min_by(F.struct(*rows.columns), F.struct("__outer", "__inner")).alias("__row"))
    return kept.select("__row.*")


def _numbered(rows: DataFrame, most: str) -> DataFrame:
    """Adds position and leaves out what is behind the `most`-th of its source (null: nothing).

    Rows are counted by __outer first and numbered inside it, so no task sorts a whole source.
    """
    rows = stored(rows)
    before = Window.partitionBy("source_id").orderBy("__outer").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("source_id", "__outer").agg(F.count("*").alias("__n"))
    counts = counts.select("source_id", "__outer", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("source_id", "__outer").orderBy("__inner"))
    numbered = rows.drop("position").join(counts, ["source_id", "__outer"]).withColumn("position", F.col("__before") + inside).drop("__before")
    return numbered.filter(F.col(most).isNull() | (F.col("position") <= F.greatest(F.col(most), F.lit(1))))


def _errors(documents: DataFrame, error: Column) -> DataFrame:
    return shaped(documents.select("source_id", error.alias("error")).filter(F.col("error").isNotNull()))


def _no_list(document: Column, key: str, what: str) -> Column:
    """Why a document that should hold a list can't be read, null if it can; one without the key has an empty list."""
    whole = nested.fields_of(F.try_parse_json(document))
    value = F.try_element_at(whole, F.lit(key))
    return F.when(whole.isNull(), F.lit(f"{what} is not valid JSON")).when(value.isNotNull() & nested.members_of(value).isNull(), F.lit(f"{what} does not contain a list of {key}"))


def _day(shown: Column) -> Column:
    """The date of a field's text, as ISO text."""
    return F.coalesce(dates.month_day_date(shown), dates.any_date(shown)).cast("string")


def _plain(markup: Column) -> Column:
    return text.clean(F.regexp_replace(F.coalesce(markup, F.lit("")), r"(?s)<!--.*?-->|<[^>]*>", " "), references=True)


#: The fields of a recruitment platform's announcements and positions, and the ends of the addresses that give them.
ANNOUNCEMENT = {"key": "ViewId", "title": "Title", "published": "FbDate", "deadline": "BmjsDate", "body": "AnncCont", "employer": "Fbdw"}
POSITION = {"employer": "zpdw", "role": "zpgw", "code": "gwbh", "people": "zpryfw", "major": "zy", "degree": "xwxlyq", "needs": "gwyq", "direction": "yjfx", "location": "gzdd", "remark": "remark"}
POSITION_CODE = "gwbm"
ANNOUNCEMENT_PATHS = ("/GetAfficheList", "/GetAfficheInfo", "/GetPostSelectFyList")


def announcements(rules: DataFrame, words: Sequence[str], majors: Sequence[str], denied: Sequence[str] = (), paths: tuple[str, str, str] = ANNOUNCEMENT_PATHS, parameter: str = "viewId") -> collect.Reader:
    """Lists of announcements, the detail of each, and its positions: a posting for each accepted position, or one for an announcement that has none.

    rules: source_id, publisher, public_detail_url, and if there are any max_items, include_announcement_fallback (else true) and the flags of normalise.accepts. An
    announcement that is listed twice, or a position of one external id, counts where it is first. A detail that is no object gives nothing; one that is no JSON,
    and an announcement before the last posting whose detail or positions were not captured, are errors.
    """
    listing_path, detail_path, positions_path = paths

    def read(documents: DataFrame) -> DataFrame:
        r = _rules(rules, include_announcement_fallback="boolean", **_FLAGS)
        listings = _ending(documents, listing_path)
        listed = nested.items(listings.select("source_id", F.col("position").alias("__document"), "document"), "document", "items", {"view_id": ANNOUNCEMENT["key"], "title": ANNOUNCEMENT["title"], "__listed_day": ANNOUNCEMENT["published"]}, "__at")
        listed = listed.withColumns({"view_id": text.clean(F.col("view_id")), "title": text.clean(F.col("title")), "__outer": F.struct("__document", "__at"), "__inner": F.lit(0).cast("long")}).filter("view_id <> '' AND title <> ''")
        listed = _once(listed.drop("document"), "view_id")
        infos, lists = _of_key(documents, detail_path, parameter, "view_id"), _of_key(documents, positions_path, parameter, "view_id")
        captured = stored(listed.join(infos.withColumnRenamed("document", "__info"), ["source_id", "view_id"], "left").join(lists.withColumnRenamed("document", "__list"), ["source_id", "view_id"], "left"))
        whole = F.try_parse_json("__info")
        first = F.get(nested.members_of(whole), 0)
        detail = nested.fields_of(F.coalesce(first, whole))
        of = lambda k: nested.shown(F.try_element_at("__detail", F.lit(ANNOUNCEMENT[k])))
        a = captured.withColumn("__detail", detail).filter(F.col("__detail").isNotNull()).join(r, "source_id")
        a = a.withColumns({
            "url": F.concat("public_detail_url", F.lit("?ViewId="), "view_id"), "published_date": _day(F.coalesce(F.nullif(of("published"), F.lit("")), F.col("__listed_day"))), "deadline_date": _day(of("deadline")),
            "__body": _plain(of("body")), "__who": F.coalesce(F.nullif(of("employer"), F.lit("")), F.col("publisher")),
        })
        flags = [F.col(c) for c in ("require_recruitment_word", "require_major_match", "accept_all_entries")]
        members = F.filter(nested.members_of(nested.value_at(F.try_parse_json("__list"), "items")), lambda x: nested.fields_of(x).isNotNull())
        a = stored(a.withColumn("__has", F.coalesce(F.size(members) > 0, F.lit(False))).drop("__detail", "__info"))
        rows = nested.items(a.filter("__has").drop("__inner"), "__list", "items", {f"__{f}": f for f in (*POSITION.values(), POSITION_CODE)}, "__inner")
        rows = rows.withColumn("position", F.struct(*[F.col(f"__{f}").alias(f) for f in (*POSITION.values(), POSITION_CODE)]))
        keep = ["source_id", "__outer", "__inner", "max_items"]
        jobs = _once(details.position_postings(rows, POSITION, normalise.accepts(F.col("eligibility"), denied, words, majors, *flags), F.col("publisher"), POSITION_CODE, keep), "external_id")
        said = F.concat_ws(" ", "title", "__body")
        rest = a.filter(~F.col("__has") & F.coalesce("include_announcement_fallback", F.lit(True)) & normalise.accepts(said, denied, words, majors, *flags))
        rest = rest.select(*keep, "title", F.col("__who").alias("employer"), F.col("url").alias("source_url"), F.col("__body").alias("text"), text.truncated(F.col("__body"), 500).alias("summary"), "published_date", "deadline_date", F.col("view_id").alias("external_id"), said.alias("match_text"))
        postings = _numbered(jobs.unionByName(rest, allowMissingColumns=True), "max_items")
        # what lies behind a source's last posting would not have been asked for
        last = postings.filter(F.col("position") == F.col("max_items")).select("source_id", F.col("__outer").alias("__last"))
        lacking = captured.filter(F.col("__info").isNull() | F.col("__list").isNull()).join(last, "source_id", "left").filter(F.col("__last").isNull() | (F.col("__outer") <= F.col("__last")))
        wrong = _errors(listings, _no_list(F.col("document"), "items", "listing")).unionByName(_errors(lacking, F.concat(F.lit("announcement "), "view_id", F.lit(" was not captured whole"))))
        wrong = wrong.unionByName(_errors(_ending(documents, detail_path), F.when(F.try_parse_json("document").isNull(), F.lit("announcement detail is not valid JSON"))))
        return shaped(postings).unionByName(wrong).unionByName(_errors(_ending(documents, positions_path), _no_list(F.col("document"), "items", "position list")))

    return read


#: Where a search result's fields lie, the first that is there counts.
RESULT = {"title": ("title", "raw.title"), "address": ("clickUri", "raw.clickableuri", "uri", "raw.uri"), "key": ("raw.sysurihash", "raw.urihash"), "day": ("raw.jobposteddate", "raw.date")}


def _texts(v: Column) -> Column:
    """A list's members or a value itself as one text."""
    many = F.filter(F.transform(nested.members_of(v), nested.shown), lambda x: x != "")
    return F.coalesce(F.array_join(many, ", "), nested.shown(v))


def searches(rules: DataFrame, detail: details.Detail, path: str) -> collect.Reader:
    """Results of a public search, one document a query in the order of the queries, and the pages that they lead to.

    rules: source_id, publisher, allowed_hosts, and if there are any max_detail_candidates, max_items, fetch_detail_pages (else true). Titles are judged by the detail's patterns, before and
    after the page is read. One key counts once over all queries; of the candidates the first max_detail_candidates (else max_items) are followed. A page that was not captured or
    is refused is a posting less.
    """

    def read(documents: DataFrame) -> DataFrame:
        r = _rules(rules, max_detail_candidates="int", fetch_detail_pages="boolean")
        found = _ending(documents, path)
        rows = found.select("source_id", F.col("position").alias("__outer"), F.posexplode(nested.members_of(nested.value_at(F.try_parse_json("document"), "results"))).alias("__inner", "__item")).join(r, "source_id")
        first = lambda k: F.coalesce(*[F.nullif(nested.shown(nested.value_at(F.col("__item"), p)), F.lit("")) for p in RESULT[k]])
        place = F.array_join(F.filter(F.array(*[_texts(nested.value_at(F.col("__item"), f"raw.{k}")) for k in ("city", "country")]), lambda x: x != ""), ", ")
        rows = rows.select(
            "source_id", "publisher", "__outer", F.col("__inner").cast("long").alias("__inner"), "max_items", F.coalesce("max_detail_candidates", "max_items").alias("__most"), F.coalesce("fetch_detail_pages", F.lit(True)).alias("__follow"), first("title").alias("title"),
            first("address").alias("__address"), F.nullif(place, F.lit("")).alias("location"), dates.epoch_date(first("day").try_cast("double").cast("long")).cast("string").alias("published_date"), details.candidate_key(first("title"), first("address"), first("key"), F.col("allowed_hosts"), detail.excluded, detail.required).alias("__key"),
        )
        candidates = _numbered(_once(rows.filter(F.col("__key").isNotNull()), "__key"), "__most").withColumn("href", urls.normalize(F.col("__address")))
        pages = documents.select("source_id", urls.normalize(F.col("url")).alias("href"), "position", "document").groupBy("source_id", "href").agg(F.min_by("document", "position").alias("document"))
        followed = details.details(candidates.filter("__follow").join(pages, ["source_id", "href"]), detail, F.col("publisher"))
        followed = followed.withColumn("application_url", F.coalesce("application_url", "source_url"))
        plain = candidates.filter("NOT __follow").withColumns({
            "employer": F.col("publisher"), "source_url": F.col("href"), "application_url": F.col("href"), "text": F.concat_ws(" ", "title", "location"), "summary": F.concat(F.lit("官方职位检索结果："), "title", F.lit("。")), "match_text": F.col("title"),
        })
        both = followed.withColumn("external_id", F.col("__key")).unionByName(plain.withColumn("external_id", F.col("__key")), allowMissingColumns=True)
        return shaped(_numbered(both, "max_items")).unionByName(_errors(found, _no_list(F.col("document"), "results", "search response")))

    return read


_ROW = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("title", T.StringType()), ("label", T.StringType()), ("href", T.StringType()), ("in_row", T.IntegerType()), ("row_text", T.StringType()), ("cells", T.ArrayType(T.StringType())), ("place", T.StringType()))]))


def linked_rows(document: Column, anchor: str, row: str = "tr", place: str = ".jobLocation") -> Column:
    """The anchors of a page that a selector names, in page order, each with the nearest element around it that `row` names.

    An array of title (the title attribute, else the text), label (the text), href, in_row (the row's number, null outside of rows), row_text, cells (the texts of
    the row's own td) and place (the text of the first element in the row that `place` names).
    """
    from brightloom.sources import tree

    for selector in (anchor, row, place):
        tree.compiled(selector)

    @pandas_udf(_ROW)
    def read(documents: pd.Series) -> pd.Series:
        def rows(page: str | None) -> list[dict]:
            root = tree.parsed(page or "")
            numbers = {id(n): i for i, n in enumerate(tree.select(root, row), 1)}
            seen: dict[int, dict] = {}
            out = []
            for a in tree.select(root, anchor):
                around = a.parent
                while around is not None and id(around) not in numbers:
                    around = around.parent
                if around is None:
                    own = {"in_row": None, "row_text": None, "cells": [], "place": None}
                else:
                    own = seen.get(id(around))
                    if own is None:
                        cells = [" ".join(c.text().split()) for c in around.children if not isinstance(c, str) and c.tag == "td"]
                        named = next(tree.select(around, place), None)
                        own = seen[id(around)] = {"in_row": numbers[id(around)], "row_text": " ".join(around.text().split()), "cells": cells, "place": " ".join(named.text().split()) if named is not None else None}
                label = " ".join(a.text().split())
                out.append({"title": " ".join(a.attributes.get("title", "").split()) or label, "label": label, "href": a.attributes.get("href", "")} | own)
            return out

        return documents.map(rows)

    return read(document)


def _rows_of(pages: DataFrame, found: Column) -> DataFrame:
    """(source_id, __outer, __inner, url, and the fields of a linked row) with the row's address."""
    rows = pages.select("source_id", F.col("position").alias("__outer"), "url", F.posexplode(found).alias("__inner", "__row"))
    rows = rows.select("source_id", "__outer", F.col("__inner").cast("long").alias("__inner"), "url", "__row.*").filter("href <> ''")
    return rows.withColumn("href", urls.normalize(absolute(F.col("href"), F.col("url"))))


def _captured(documents: DataFrame) -> DataFrame:
    d = documents.select("source_id", urls.normalize(F.col("url")).alias("href"), "position", "document").groupBy("source_id", "href")
    return d.agg(F.min_by("document", "position").alias("document"))


def cards(rules: DataFrame, detail: details.Detail, anchor: str) -> collect.Reader:
    """A board's table of links with employer and place beside them, and the pages they lead to.

    rules: source_id, publisher, listing_url, and if there is any max_items. The second cell of a link's row is the employer, the third the place. A page that was not captured is a posting less; an
    address counts once.
    """

    def read(documents: DataFrame) -> DataFrame:
        r = _rules(rules)
        listings = documents.join(r.select("source_id", urls.normalize(F.col("listing_url")).alias("__listing")), "source_id").filter(urls.normalize(F.col("url")) == F.col("__listing"))
        rows = _rows_of(listings, linked_rows(F.col("document"), anchor)).filter("title <> ''").join(r, "source_id")
        rows = rows.withColumns({"__who": F.coalesce(F.get("cells", 1), "publisher"), "location": F.nullif(F.get("cells", 2), F.lit("")), "published_date": F.lit(None).cast("string")})
        chosen = _numbered(_once(rows.select("source_id", "__outer", "__inner", "href", "title", "__who", "location", "published_date", "max_items"), "href"), "max_items")
        found = details.details(chosen.join(_captured(documents), ["source_id", "href"]), detail, F.col("__who"))
        return shaped(found.withColumn("application_url", F.col("source_url")))

    return read


def result_rows(rules: DataFrame, detail: details.Detail, row: str = "tr.data-row", anchor: str = "a.jobTitle-link[href*='/job/']", topic: str = "q") -> collect.Reader:
    """Pages of search results, a row for each job, and the jobs' own pages where they are to be read; a row whose page was not captured is a posting by itself.

    rules: source_id, publisher, search_url, and if there are any fetch_detail_pages (else false) and max_items. The pages are those at the search address, in their order; a page's topic is
    a parameter of its query. Titles are judged by the detail's patterns. A row's first link counts, and an address once.
    """

    def read(documents: DataFrame) -> DataFrame:
        r = _rules(rules, fetch_detail_pages="boolean")
        base = lambda u: F.concat_ws("", urls.host(u), F.regexp_replace(F.coalesce(urls.part(u, "PATH"), F.lit("")), "/+$", ""))
        pages = documents.join(r.select("source_id", "search_url"), "source_id").filter(base(F.col("url")) == base(F.col("search_url")))
        rows = _rows_of(pages, linked_rows(F.col("document"), anchor, row, ".colLocation .jobLocation, .jobLocation")).filter(F.col("in_row").isNotNull())
        rows = rows.groupBy("source_id", "__outer", "in_row").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("source_id", "__outer", "in_row")]), "__inner").alias("__row")).select("source_id", "__outer", "__row.*")
        rows = rows.withColumn("title", F.col("label")).filter((F.col("title") != "") & text.title_allowed(F.col("title"), detail.excluded, detail.required)).join(r, "source_id")
        about = F.coalesce(F.try_url_decode(F.try_parse_url(F.col("url"), F.lit("QUERY"), F.lit(topic))), F.lit(""))
        rows = rows.select("source_id", "__outer", "__inner", "href", "title", "publisher", F.nullif("place", F.lit("")).alias("location"), "row_text", about.alias("__about"), F.coalesce("fetch_detail_pages", F.lit(False)).alias("__follow"), "max_items")
        chosen = stored(_numbered(_once(rows, "href"), "max_items"))
        hinted = chosen.withColumn("published_date", F.lit(None).cast("string")).filter("__follow").join(_captured(documents), ["source_id", "href"])
        followed = details.details(hinted, detail, F.col("publisher")).withColumn("application_url", F.coalesce("application_url", "source_url"))
        followed = stored(shaped(followed))
        plain = chosen.join(followed.select("source_id", "position"), ["source_id", "position"], "left_anti")
        row_text = F.col("row_text")
        plain = plain.withColumns({
            "employer": F.col("publisher"), "source_url": F.col("href"), "application_url": F.col("href"), "text": F.concat_ws(" ", "title", "publisher", F.coalesce("location", F.lit("")), "row_text", F.concat(F.lit("Search topic: "), "__about")),
            "match_text": F.concat_ws(" ", "title", "row_text"), "summary": F.concat("publisher", F.lit(" 官方招聘岗位"), F.coalesce(F.concat(F.lit("，地点："), "location"), F.lit(""))), "published_date": dates.published(row_text).cast("string"),
            "deadline_date": dates.deadline(row_text).cast("string"), "external_id": urls.external_id(F.col("href")),
        })
        return followed.unionByName(shaped(plain))

    return read


@pandas_udf(T.StringType())
def _initial_data(documents: pd.Series) -> pd.Series:
    """The value that a page keeps for its script, with references decoded once more; null without one."""
    from html import unescape

    from brightloom.sources import tree

    def read(page: str | None) -> str | None:
        node = next(tree.select(tree.parsed(page or ""), "#init-data"), None)
        return unescape(node.attributes.get("value", "")).strip() or None if node is not None else None

    return documents.map(read)


def opened(document: Column, iv: Column) -> Column:
    """What a portal's answer holds, as VARIANT: itself if its data is an object, else its data decrypted by the key it names; null for what can't be read or was refused."""
    outer = F.try_parse_json(document)
    at = lambda k: F.try_variant_get(F.try_element_at(nested.fields_of(outer), F.lit(k)), "$", "string")
    clear = F.try_parse_json(portals.decrypted(at("data"), at("necromancer"), iv))
    refused = F.coalesce(F.try_variant_get(F.try_element_at(nested.fields_of(clear), F.lit("success")), "$", "boolean") == F.lit(False), F.lit(False))
    inner = F.try_element_at(nested.fields_of(outer), F.lit("data"))
    return F.when(nested.fields_of(inner).isNotNull(), outer).when(nested.fields_of(clear).isNotNull() & ~refused, clear)


#: What a portal's job says of itself, and the labels under which a posting shows it.
JOB_TEXTS = ("title", "education", "commitment", "jobDescription")
JOB_NAMES = ("department", "zhineng")
JOB_LABELS = (("学历", "education"), ("职位性质", "commitment"), ("职位类别", "zhineng"), ("所属部门", "department"), ("工作地点", "location"))
PORTAL_PATHS = ("/website/jobs/v2", "/website/job")


def _occurs(patterns: Column, value: Column) -> Column:
    """Some pattern of a column's array occurs in the value, whatever the case; all are asked as one, as no lambda may hold the value's Python function."""
    one = F.concat(F.lit("(?iu)"), F.array_join(F.transform(patterns, lambda p: F.concat(F.lit("(?:"), p, F.lit(")"))), "|"))
    return F.coalesce((F.size(patterns) > 0) & F.regexp_like(value, one), F.lit(False))


def _named(v: Column) -> Column:
    """An object's name, or a value's own text."""
    return F.when(nested.fields_of(v).isNotNull(), nested.shown(F.try_element_at(nested.fields_of(v), F.lit("name")))).otherwise(nested.shown(v))


def encrypted_jobs(rules: DataFrame, majors: Sequence[str], paths: tuple[str, str] = PORTAL_PATHS, parameter: str = "jobId") -> collect.Reader:
    """Portals whose answers are encrypted: the page that names the vector, the list of jobs and the details of each, whose values win over the list's.

    rules: source_id, publisher, listing_url, and if there are any max_items, fetch_detail_pages (else true), require_detail_pages, include_patterns, exclude_patterns, detail_exclude_patterns. A job is
    judged by its list entry and again with its detail: no excluded pattern, and an included one, or a major if none are given. A detail that can't be read leaves the job as listed, or is a job
    less where it is required. One id counts once. A page without vector and a list that can't be read are errors.
    """
    list_path, detail_path = paths

    def read(documents: DataFrame) -> DataFrame:
        arrays = {k: "array<string>" for k in ("include_patterns", "exclude_patterns", "detail_exclude_patterns")}
        r = _rules(rules, fetch_detail_pages="boolean", require_detail_pages="boolean", **arrays)
        front = documents.join(r.select("source_id", "listing_url"), "source_id").filter(urls.normalize(F.col("url")) == urls.normalize(F.col("listing_url")))
        front = front.groupBy("source_id").agg(F.min_by("document", "position").alias("document"))
        iv = F.nullif(nested.shown(nested.value_at(F.try_parse_json("__data"), "aesIv")), F.lit(""))
        vectors = stored(documents.select("source_id").distinct().join(front, "source_id", "left").select("source_id", _initial_data(F.col("document")).alias("__data")).select("source_id", iv.alias("iv")))
        # a source's vector, to each of its documents
        lists = stored(_ending(documents, list_path).join(vectors, "source_id").select("source_id", F.col("position").alias("__outer"), F.to_json(nested.value_at(opened(F.col("document"), F.col("iv")), "data.jobs")).alias("jobs")))
        rows = lists.select("source_id", "__outer", F.posexplode(nested.members_of(F.try_parse_json("jobs"))).alias("__inner", "__job")).filter(nested.fields_of(F.col("__job")).isNotNull())
        rows = rows.select("source_id", "__outer", F.col("__inner").cast("long").alias("__inner"), F.to_json("__job").alias("listed"), nested.shown(nested.value_at(F.col("__job"), "id")).alias("job_id")).filter("job_id <> ''")
        rows = _once(rows, "job_id").join(r, "source_id")

        def allowed(job: Column, excluded: Column) -> Column:
            own = lambda k: F.try_variant_get(nested.value_at(job, k), "$", "string")
            said = text.clean(F.concat_ws(" ", *[_plain(own(k)) for k in JOB_TEXTS], *[_plain(own(f"{k}.name")) for k in JOB_NAMES]))
            wanted = F.when(F.coalesce(F.size("include_patterns") > 0, F.lit(False)), _occurs(F.col("include_patterns"), said)).otherwise(text.contains_any(F.lower(said), [m.lower() for m in majors]))
            return ~_occurs(excluded, said) & wanted

        rows = rows.filter(allowed(F.try_parse_json("listed"), F.col("exclude_patterns")))
        data = F.to_json(nested.value_at(opened(F.col("document"), F.col("iv")), "data"))
        found = _of_key(documents, detail_path, parameter, "job_id").join(vectors, "source_id").select("source_id", "job_id", data.alias("detail"))
        rows = rows.join(found, ["source_id", "job_id"], "left")
        listed = nested.fields_of(F.try_parse_json("listed"))
        more = F.when(F.coalesce("fetch_detail_pages", F.lit(True)), nested.fields_of(F.try_parse_json("detail")))
        rows = rows.filter(~F.coalesce("require_detail_pages", F.lit(False)) | ~F.coalesce("fetch_detail_pages", F.lit(True)) | more.isNotNull())
        both = F.when(more.isNull(), listed).otherwise(F.map_concat(F.map_filter(listed, lambda k, _: ~F.array_contains(F.map_keys(more), k)), more))
        rows = rows.withColumn("__merged", F.to_json(both)).filter(allowed(F.try_parse_json("__merged"), F.col("detail_exclude_patterns")))
        job = F.try_parse_json("__merged")
        at = lambda k: nested.value_at(job, k)
        about = _plain(nested.shown(at("jobDescription")))
        rows = rows.withColumns({"title": F.coalesce(F.nullif(nested.shown(at("title")), F.lit("")), F.lit("未命名岗位")), "__about": about, "__job": job, "education": nested.shown(at("education")), "commitment": nested.shown(at("commitment")), **{k: _named(at(k)) for k in JOB_NAMES}})
        hint = places.location_hint(F.concat_ws(" ", F.col("__about"), nested.shown(at("content")), nested.shown(at("detail"))))
        rows = rows.withColumn("location", F.coalesce(nested.place_of(F.col("__merged")), hint))
        shown = F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{label}："), c)) for label, c in JOB_LABELS])), "；")
        day = lambda k: F.nullif(F.regexp_extract(nested.shown(at(k)), r"20\d{2}-\d{2}-\d{2}", 0), F.lit(""))
        rows = rows.withColumns({"__fields": shown, "published_date": day("publishedAt"), "deadline_date": F.coalesce(day("closedAt"), dates.deadline(F.col("__about")).cast("string"))})
        said = text.clean(F.concat_ws(" ", "title", "__fields", "__about"))
        rows = rows.withColumns({
            "employer": F.col("publisher"), "source_url": F.concat(F.substring_index("listing_url", "#", 1), F.lit("#/job/"), "job_id"), "text": said, "match_text": said, "summary": text.truncated(text.clean(F.concat("__fields", F.lit("；"), "__about")), 420), "external_id": F.col("job_id"),
        }).withColumn("application_url", F.col("source_url"))
        postings = shaped(_numbered(rows.select("__outer", "__inner", "max_items", "source_id", "title", "employer", "source_url", "text", "summary", "published_date", "deadline_date", "location", "external_id", "application_url", "match_text"), "max_items"))
        wrong = _errors(vectors, F.when(F.col("iv").isNull(), F.lit("public page is missing its vector")))
        bad = lists.join(vectors.filter("iv IS NOT NULL"), "source_id", "left_semi").filter(nested.members_of(F.try_parse_json("jobs")).isNull())
        none = vectors.filter("iv IS NOT NULL").join(lists, "source_id", "left_anti")
        return postings.unionByName(wrong).unionByName(_errors(bad, F.lit("job list can't be read"))).unionByName(_errors(none, F.lit("job list was not captured")))

    return read
