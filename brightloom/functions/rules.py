"""Ordered first-match rules as column expressions, made from dictionaries that the caller gives.

Used for taxonomies, affiliations and directions: order is meaning, the first rule wins.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any


def first_match(text: Column, rules: Iterable[tuple[str, Iterable[str]]], default: Column | None = None) -> Column:
    """The name of the first rule any of whose markers the text contains. rules: (name, markers)."""
    chain = None
    for name, markers in rules:
        test = contains_any(text, markers)
        chain = F.when(test, F.lit(name)) if chain is None else chain.when(test, F.lit(name))
    if chain is None:
        return default if default is not None else F.lit(None).cast("string")
    return chain.otherwise(default) if default is not None else chain


def earliest_marker(text: Column, groups: Iterable[tuple[str, Iterable[str]]]) -> Column:
    """The group whose marker stands first in the text; ties go to the earlier group."""
    found = [F.struct(F.nullif(F.instr(text, m), F.lit(0)).alias("at"), F.lit(i).alias("ord"), F.lit(name).alias("name")) for i, (name, markers) in enumerate(groups) for m in markers]
    return F.array_min(F.filter(F.array(*found), lambda x: x["at"].isNotNull()))["name"]


def lookup(key: Column, table: Mapping[str, str], default: Column | None = None) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    value = F.try_element_at(F.create_map(*pairs), key) if pairs else F.lit(None).cast("string")
    return F.coalesce(value, default) if default is not None else value


def longest_first(terms: Iterable[str]) -> list[str]:
    """Longer terms first; equal lengths keep their order."""
    return sorted(terms, key=lambda t: -len(t))
