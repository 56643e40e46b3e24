"""Matching of records with profiles: majors, degrees, and the level that follows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, contains_any

#: Degree ranks, the levels with their priorities, and the alignment score.
DEGREE_RANKS = {"本科": 1, "硕士": 2, "博士": 3}
DEGREE_MARKERS = (("本科", ("本科", "学士")), ("硕士", ("硕士",)), ("博士", ("博士",)))
PRIORITY = {"explicit": 2, "review": 1, "not_recommended": 0}
ALIGNED_SCORE = 55


def rank(degree: Column) -> Column:
    chain = None
    for name, r in DEGREE_RANKS.items():
        chain = F.when(degree == name, r) if chain is None else chain.when(degree == name, r)
    return chain


def degree_status(listed: Column, own: Column, text: Column | None = None) -> Column:
    """explicit if listed, or if the text takes the own degree or a lower one and all above; blocked below the lowest listed; review above it; unspecified without a list."""
    ranks = F.filter(F.transform(listed, rank), lambda r: r.isNotNull())
    none = F.size(F.coalesce(ranks, F.array())) == 0
    return (
        F.when(F.coalesce(F.array_contains(listed, own), F.lit(False)), "explicit")
        .when(F.lit(False) if text is None else or_above(text, own), "explicit")
        .when(none, "unspecified")
        .when(rank(own) < F.array_min(ranks), "blocked")
        .otherwise("review")
    )


def english_major_required(text: Column, terms: Iterable[str], cues: Iterable[str], within: int = 100) -> Column:
    """In one sentence a discipline and a requirement cue stand within so many characters, in either order."""
    a, b = "|".join(terms), "|".join(cues)
    return F.coalesce(text.rlike(rf"(?iU)\b(?:{a})\b[^.!?;\n]{{0,{within}}}\b(?:{b})\b|\b(?:{b})\b[^.!?;\n]{{0,{within}}}\b(?:{a})\b"), F.lit(False))


def major_status(tags: Column, exact: Column, english: Column) -> Column:
    """explicit if one of a profile's exact terms (an array) is a tag, whatever the case, or its English name is required; related with other tags."""
    low = lambda words: F.transform(F.filter(words, lambda x: F.trim(x) != ""), lambda x: F.lower(clean(x)))
    own = F.coalesce(low(tags), F.array().cast("array<string>"))
    return F.when(F.coalesce(F.arrays_overlap(own, low(exact)), F.lit(False)) | english, "explicit").when(F.size(own) > 0, "related").otherwise("unspecified")


def match(degree: Column, major: Column, score: Column) -> Column:
    """struct(level, priority) from the two statuses; a record that neither its majors nor its score align isn't recommended."""
    aligned = (major != "unspecified") | (score >= ALIGNED_SCORE)
    level = (
        F.when(degree == "blocked", "not_recommended")
        .when((degree == "explicit") & (major == "explicit"), "explicit")
        .when(aligned, "review")
        .otherwise("not_recommended")
    )
    chain = None
    for name, p in PRIORITY.items():
        chain = F.when(level == name, p) if chain is None else chain.when(level == name, p)
    return F.struct(level.alias("level"), chain.alias("priority"))


def explained(matched: Column, degree: Column, major: Column, labels: dict[str, str], reasons: dict[tuple[str, str], str]) -> Column:
    """struct(level, label, reason, priority): the label by level, the reason by (degree, major) status, else by (degree, '')."""
    label = F.lit(None).cast("string")
    for level, name in labels.items():
        label = F.when(matched["level"] == level, name).otherwise(label)
    reason = F.lit("")
    for (d, m), why in sorted(reasons.items(), key=lambda x: x[0][1] != ""):
        reason = F.when((degree == d) & ((major == m) if m else F.lit(True)), why).otherwise(reason)
    for (d, m), why in reasons.items():
        if m:
            reason = F.when((degree == d) & (major == m), why).otherwise(reason)
    return F.struct(matched["level"].alias("level"), label.alias("label"), reason.alias("reason"), matched["priority"].alias("priority"))


#: The ways to write each degree, and how a text says that it or any above will do.
DEGREE_NAMES = {"本科": ("本科", "学士", "bachelor", "undergraduate"), "硕士": ("硕士", "master"), "博士": ("博士", "ph.d", "phd", "doctoral")}
OR_ABOVE = ("及以上", "学历及以上", "学位及以上", "'s degree or above", " degree or above")


def or_above(text: Column, own: Column, names: Mapping[str, Iterable[str]] = DEGREE_NAMES) -> Column:
    """The text takes a degree of at most the own rank and all above it."""
    low = F.lower(clean(text))
    found = F.lit(False)
    for degree, r in DEGREE_RANKS.items():
        found = found | (contains_any(low, [n + end for n in names.get(degree, ()) for end in OR_ABOVE]) & (rank(own) >= r))
    return F.coalesce(found, F.lit(False))
