"""Text functions as column expressions: cleaning, hashing, membership and labelled values."""

from __future__ import annotations

import html
from collections.abc import Iterable
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Fixed value: what counts as white space (Unicode, and the four ASCII separators).
BLANKS = r"(?U)[\s\x1c-\x1f]+"


@pandas_udf(T.StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """Character references decoded; there is no built-in function for the named ones."""
    return text.map(lambda x: html.unescape(x) if x is not None and "&" in x else x)


def clean(text: Column, references: bool = False) -> Column:
    """Null becomes empty; runs of Unicode white space become one space; the ends are trimmed; with references they are decoded first."""
    if references:
        text = F.when(F.contains(text, F.lit("&")), unescaped(text)).otherwise(text)
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " "))


def stable_hash(*values: Column) -> Column:
    """SHA-256 of the cleaned values, one per line. Nulls count as empty."""
    return F.sha2(F.concat_ws("\n", *[clean(v) for v in values]), 256)


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def truncated(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def without_digit_gaps(text: Column) -> Column:
    """Drops blanks between digits."""
    return F.regexp_replace(text, r"(?<=\d)(?U:\s+)(?=\d)", "")


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    found = [F.contains(text, F.lit(t)) for t in terms]
    return reduce(or_, found) if found else F.lit(False)


def keyword_search(columns: Iterable[Column], needle: str) -> Column:
    """Any column holds the needle, case-insensitively; % and _ in it are wildcards. Null columns don't match."""
    return reduce(or_, [F.coalesce(c.ilike(f"%{needle}%"), F.lit(False)) for c in columns])


def first_terms(text: Column, terms: Iterable[str], most: int) -> Column:
    """The first `most` terms that the text contains, in the terms' order."""
    found = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t))
    return F.slice(found, 1, most)


def ordered_subset(text: Column, names: Iterable[tuple[str, tuple[str, ...]]]) -> Column:
    """The names of which some marker occurs in the text, in order. names: (name, markers)."""
    return F.array_compact(F.array(*[F.when(contains_any(text, markers), F.lit(name)) for name, markers in names]))


def matches_any(text: Column, patterns: Iterable[str]) -> Column:
    """Some pattern occurs, whatever the case; none does if there are none."""
    found = [text.rlike(f"(?iu){p}") for p in patterns]
    return reduce(or_, found) if found else F.lit(False)


def title_allowed(title: Column, excluded: Iterable[str], required: Iterable[str]) -> Column:
    """No excluded pattern occurs in the cleaned title and, if any are required, one of those does; case counts for nothing."""
    required, name = list(required), clean(title)
    ok = ~matches_any(name, excluded)
    return ok & matches_any(name, required) if required else ok


def label_value(text: Column, label: str, next_labels: Iterable[str], most: int = 200) -> Column:
    """The text between a label and the next one, cleaned, at most so long; null if absent or empty."""
    import re

    stop = "|".join(re.escape(x) for x in next_labels)
    pattern = rf"(?s){re.escape(label)}\s*[:：]?\s*(.*?)(?={stop}|\z)" if stop else rf"(?s){re.escape(label)}\s*[:：]?\s*(.*)"
    return blank_to_null(truncated(clean(F.regexp_extract(text, pattern, 1)), most))


def before_earliest(text: Column, markers: Iterable[str], least: int = 3) -> Column:
    """The prefix before the earliest marker if it has `least` characters, else null."""
    places = F.filter(F.array(*[F.instr(text, m) for m in markers]), lambda i: i > 0)
    prefix = F.trim(F.substring(text, F.lit(1), F.array_min(places) - 1))
    return F.when((F.size(places) > 0) & (F.length(prefix) >= least), prefix)


def joined_fields(fields: Iterable[tuple[str, Column]], between: str = "；", most: int = 420) -> Column:
    """label：value parts of the values that aren't blank, joined and cut."""
    parts = [F.when(blank_to_null(v).isNotNull(), F.concat(F.lit(f"{k}："), F.trim(v))) for k, v in fields]
    return truncated(F.array_join(F.array_compact(F.array(*parts)), between), most)
