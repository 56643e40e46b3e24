"""Employment taxonomies: what an opportunity is, by ordered dictionaries that the caller gives.

The category follows the employer's identity before the source's category before the body's markers; then the
category's own rules give employer type and affiliation. Order is meaning everywhere: the first rule wins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import earliest_marker, first_match, lookup
from .text import clean, contains_any

Rules = Sequence[tuple[str, Sequence[str]]]


@dataclass(frozen=True)
class Category:
    """types and affiliations: (name, markers) in order, with what holds if none does.

    earliest: the affiliation whose marker stands first in the text wins, not the first rule.
    """

    name: str
    sector: str
    employer_type: str
    affiliation: str
    types: Rules = ()
    affiliations: Rules = ()
    earliest: bool = False

    def affiliation_of(self, text: Column) -> Column:
        """Null where no marker is found."""
        if not self.affiliations:
            return F.lit(None).cast("string")
        return earliest_marker(text, self.affiliations) if self.earliest else first_match(text, self.affiliations)


@dataclass(frozen=True)
class Taxonomy:
    categories: Sequence[Category]
    fallback: str
    identity: Rules = ()
    body: Rules = ()
    legacy: Mapping[str, str] = field(default_factory=dict)
    overseas: Sequence[str] = ()
    codes: Sequence[str] = ()
    domestic: Sequence[str] = ()
    directions: Rules = ()
    scopes: tuple[str, str, str] = ("海外岗位", "中国境内岗位", "地域待核验")
    no_direction: str = "other"
    unverified: tuple[str, str] = ("单位属性待以官方公告核验", "所属体系待核验")


def source_category(category: Column, t: Taxonomy) -> Column:
    """A known name as it is, a legacy name by the map, else null."""
    return F.when(category.isin(*[c.name for c in t.categories]), category).otherwise(lookup(category, t.legacy))


def scope(location: Column, combined: Column, t: Taxonomy) -> Column:
    """By the location if there is one, else by the whole text; a country code counts as a word of its own."""
    where = F.lower(clean(location))
    where = F.when(where == "", combined).otherwise(where)
    abroad = contains_any(where, t.overseas)
    if t.codes:
        abroad = abroad | where.rlike(r"(?U)\b(?:" + "|".join(t.codes) + r")\b")
    return F.when(abroad, t.scopes[0]).when(contains_any(where, t.domestic), t.scopes[1]).otherwise(t.scopes[2])


def classify(text: Column, location: Column, source: Column, identity: Column, t: Taxonomy) -> Column:
    """struct(category, sector, employer_type, affiliation, opportunity_scope, role_direction)."""
    combined = F.lower(clean(F.concat_ws(" ", text, location)))
    who = F.lower(clean(identity))
    found = F.coalesce(first_match(who, t.identity), source_category(source, t), first_match(combined, t.body))
    category = F.coalesce(found, source_category(source, t), F.lit(t.fallback))
    sector = kind = affiliation = None
    for c in t.categories:
        here = category == c.name
        own = F.coalesce(c.affiliation_of(who), c.affiliation_of(combined), F.lit(c.affiliation))
        values = (F.lit(c.sector), first_match(combined, c.types, F.lit(c.employer_type)), own)
        sector, kind, affiliation = (F.when(here, v) if x is None else x.when(here, v) for x, v in zip((sector, kind, affiliation), values, strict=True))
    # what only the fallback named is not verified
    kind, affiliation = F.when(found.isNull(), t.unverified[0]).otherwise(kind), F.when(found.isNull(), t.unverified[1]).otherwise(affiliation)
    return F.struct(
        category.alias("category"), F.coalesce(sector, category).alias("sector"), kind.alias("employer_type"), affiliation.alias("affiliation"),
        scope(location, combined, t).alias("opportunity_scope"), first_match(combined, t.directions, F.lit(t.no_direction)).alias("role_direction"),
    )


def enriched(jobs, employers, t: Taxonomy):
    """Jobs with the six fields, the stored category as category_stored; a known employer's own category, type and affiliation win.

    jobs: id, title, employer, group_name, description, summary, location, category; employers: alias, ord, canonical_employer_id,
    canonical_employer_name, parent_employer_name, category, employer_type, affiliation. The longest alias in the employer's name counts.
    """
    from brightloom.operators.listing import longest_containing

    text = F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("title", "employer", "group_name", "description", "summary")])
    who = F.concat_ws(" ", "title", "employer")
    own = longest_containing(jobs.select("id", F.lower(clean(F.col("employer"))).alias("employer")), "employer", employers.withColumn("alias", F.lower(clean(F.col("alias")))), "alias", ["id"], "ord").select("id", F.struct(*[c for c in employers.columns if c not in ("alias", "ord")]).alias("__own"))
    j = jobs.withColumn("__c", classify(text, F.col("location"), F.col("category"), who, t)).withColumnRenamed("category", "category_stored").join(own, "id", "left")
    three = ("category", "employer_type", "affiliation")
    names = [c for c in ("canonical_employer_id", "canonical_employer_name", "parent_employer_name")]
    known = [F.coalesce(*([F.col(c)] if c in jobs.columns else []), F.col("__own")[c]).alias(c) for c in names]
    kept = [c for c in j.columns if c not in ("__c", "__own", *names)]
    rest = [F.col("__c")[c].alias(c) for c in ("sector", "opportunity_scope", "role_direction")]
    return j.select(*kept, *known, *[F.coalesce(F.col("__own")[c], F.col("__c")[c]).alias(c) for c in three], *rest)
