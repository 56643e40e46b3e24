"""URL functions: normal form, hosts, evidence tests and redirects. Bad input gives null or false."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: beginnings of query keys that only track.
TRACKING = ("utm_", "spm", "from")


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def host(url: Column) -> Column:
    return F.lower(part(url, "HOST"))


def is_http(url: Column) -> Column:
    return F.coalesce(F.lower(part(url, "PROTOCOL")).isin("http", "https") & (F.length(part(url, "HOST")) > 0), F.lit(False))


def normalize(url: Column, tracking: Iterable[str] = TRACKING) -> Column:
    """Lower-case scheme and authority, single slashes, no tracking keys, no fragment."""
    bare = F.split_part(url, F.lit("#"), F.lit(1))
    scheme = F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.lower(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    path = F.regexp_replace(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/{2,}", "/")
    pairs = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: p != "")
    pairs = F.filter(pairs, lambda p: ~F.lower(p).rlike("^(" + "|".join(tracking) + ")"))
    query = F.array_join(pairs, "&")
    whole = F.concat(scheme, F.lit("://"), authority, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(scheme != "", whole).otherwise(bare)


def external_id(url: Column) -> Column:
    """path, or path?query."""
    return F.concat_ws("?", part(url, "PATH"), part(url, "QUERY"))


def host_allowed(url: Column, hosts: Column) -> Column:
    return F.coalesce(F.array_contains(hosts, host(url)), F.lit(False))


def keeps_entry_path(entry: Column, final: Column) -> Column:
    """A redirect stays on the entry's path, or below it; an entry at the root always does."""
    a, b = (F.regexp_replace(F.coalesce(part(u, "PATH"), F.lit("")), "/+$", "") for u in (entry, final))
    return (a == "") | (a == b) | b.startswith(F.concat(a, F.lit("/")))
