"""From a raw posting to a record: one projection of the function library, with all vocabularies as parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.functions import dates, places, profiles, rules, scoring, taxonomy, text, urls


@dataclass(frozen=True)
class Vocabulary:
    """Terms are sought in lower-cased text. taxonomy: the categories with their sectors and affiliations; without one `categories` are plain first matches."""

    majors: Sequence[tuple[str, int]] = ()
    categories: Sequence[tuple[str, Sequence[str]]] = ()
    taxonomy: taxonomy.Taxonomy | None = None
    directions: Sequence[tuple[str, Sequence[str]]] = ()
    tier_points: Mapping[str, int] = field(default_factory=lambda: {"A": 20, "B": 12})
    other_tier_points: int = 5
    category_points: Mapping[str, int] = field(default_factory=dict)
    places: places.Places = field(default_factory=places.Places)
    energy_words: Sequence[str] = ()
    energy_points: int = 15
    institution_words: Sequence[str] = ()
    institution_points: int = 8
    cap: int = 58
    bands: Sequence[tuple[int, str]] = ((55, "strong"), (30, "related"))
    lowest_band: str = "weak"
    most_tags: int = 8


def _lowered(v: Vocabulary) -> list[tuple[str, str, int]]:
    return [(name, name.lower(), weight) for name, weight in v.majors]


def major_tags(match_text: Column, v: Vocabulary) -> Column:
    """The first terms of the vocabulary, as many as a record has tags, that the text contains whatever the case."""
    low = F.lower(text.clean(match_text))
    found = F.filter(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(term).alias("term")) for name, term, _ in _lowered(v)]), lambda t: F.contains(low, t["term"])) if v.majors else None
    return F.array().cast("array<string>") if found is None else F.transform(F.slice(found, 1, v.most_tags), lambda t: t["name"])


def relevance(match_text: Column, tags: Column, tier: Column, category: Column, v: Vocabulary) -> Column:
    """Points of the tier, the capped weights of the tags, the category's points, and fixed ones for energy words and a named institution; at most 100."""
    low = F.lower(text.clean(match_text))
    points = lambda key, table, other: F.coalesce(rules.lookup(key, {k: str(n) for k, n in table.items()}).cast("int"), F.lit(other))
    bonus = lambda words, n: F.when(text.contains_any(low, [w.lower() for w in words]), n).otherwise(0)
    weights = F.aggregate(F.transform(tags, lambda t: points(t, dict(v.majors), 0)), F.lit(0), lambda a, x: a + x)
    more = bonus(v.energy_words, v.energy_points) + bonus(v.institution_words, v.institution_points)
    return F.least(F.lit(100), points(tier, v.tier_points, v.other_tier_points) + F.least(F.lit(v.cap), weights) + points(category, v.category_points, 0) + more)


#: The optional columns of a raw posting.
OPTIONAL = {"application_url": "string", "external_id": "string", "source_category": "string", "undated_open_window_days": "int"}
#: What an employer registry gives a record: null without a known employer.
EMPLOYER = ("canonical_employer_id", "canonical_employer_name", "parent_employer_name")


def posting(raw: DataFrame, v: Vocabulary, today: Column, undated_days: int | None = None, employers: DataFrame | None = None) -> DataFrame:
    """Raw columns: source_id, source_tier, title, employer, source_url, text, published_date, deadline_date, location, match_text, and the OPTIONAL ones.

    A record is known by its source and its external id, or its address without one; it is changed if title, employer, an address, the whole
    text or the deadline are. employers: alias, ord, category and the EMPLOYER columns; the longest alias in the employer's name
    counts, and a known employer's category comes before all others.
    """
    for name, kind in OPTIONAL.items():
        raw = raw if name in raw.columns else raw.withColumn(name, F.lit(None).cast(kind))
    r = raw.withColumn("title", text.clean(F.col("title"))).withColumn("employer", text.clean(F.col("employer")))
    said = F.concat_ws(" ", "title", "employer", "text")
    whole = text.clean(said)
    r = r.withColumn("source_url", urls.normalize(F.col("source_url"))).withColumn("match_text", F.coalesce(text.blank_to_null(F.col("match_text")), whole))
    r = r.withColumn("published_date", F.coalesce(F.try_to_date("published_date"), dates.published(whole)))
    r = r.withColumn("deadline_date", F.coalesce(F.try_to_date("deadline_date"), dates.deadline(said)))
    r = r.withColumn("place", places.location(F.coalesce(text.blank_to_null(F.col("location")), places.location_hint(F.col("text"))), v.places))
    r = _with_employer(r, employers)
    if v.taxonomy is None:
        sorted_in = F.coalesce(rules.first_match(whole, v.categories), F.lit("other"))
        direction = rules.first_match(whole, v.directions, F.lit("other"))
    else:
        kind = taxonomy.classify(F.col("match_text"), F.col("location"), F.col("source_category"), F.concat_ws(" ", "title", "employer"), v.taxonomy)
        sorted_in, direction = kind["category"], kind["role_direction"]
    r = r.withColumn("category", F.coalesce("__employer_category", sorted_in)).withColumn("direction", direction).drop("__employer_category")
    r = r.withColumn("degree_levels", text.ordered_subset(whole, profiles.DEGREE_MARKERS))
    r = r.withColumn("major_tags", major_tags(F.col("match_text"), v))
    r = r.withColumn("relevance_score", relevance(F.col("match_text"), F.col("major_tags"), F.col("source_tier"), F.col("category"), v))
    r = r.withColumn("relevance_band", scoring.band(F.col("relevance_score"), v.bands, v.lowest_band))
    window = F.coalesce("undated_open_window_days", F.lit(undated_days).cast("int"))
    r = r.withColumn("status", dates.status(F.col("deadline_date"), F.col("published_date"), today, window))
    r = r.withColumn("summary", text.truncated(text.clean(F.col("text")), 420)).withColumn("description", text.truncated(text.clean(F.col("text")), 12_000))
    own = F.coalesce(text.blank_to_null(F.col("external_id")), F.col("source_url"))
    r = r.withColumn("fingerprint", text.stable_hash(F.col("source_id"), own))
    content = [F.col(c) for c in ("title", "employer", "source_url", "application_url", "text")]
    return r.withColumn("content_hash", text.stable_hash(*content, F.col("deadline_date").cast("string"))).select("*", "place.*").drop("place")


def _with_employer(r: DataFrame, employers: DataFrame | None) -> DataFrame:
    """Adds the EMPLOYER columns and __employer_category."""
    if employers is None:
        return r.withColumns({c: F.lit(None).cast("string") for c in (*EMPLOYER, "__employer_category")})
    from brightloom.operators.listing import longest_containing

    # names and aliases are alike whatever their case and blanks
    who = F.lower(text.clean(F.col("employer")))
    names = r.select(who.alias("__name")).filter("__name <> ''").distinct()
    known = longest_containing(names, "__name", employers.withColumn("alias", F.lower(text.clean(F.col("alias")))), "alias", ["__name"], "ord")
    known = known.select("__name", *EMPLOYER, F.col("category").alias("__employer_category"))
    return r.drop(*EMPLOYER).join(known, who == F.col("__name"), "left").drop("__name")


#: The derived fields that a new vocabulary may change, with an event; those that change without one.
DERIVED = ("category", "degree_levels", "major_tags", "relevance_score", "relevance_band", "status")
PLACED = (*EMPLOYER, "location", "province", "city", "country_or_region", "location_confidence", "location_evidence")


def reindex(jobs: DataFrame, sources: DataFrame, v: Vocabulary, today: Column, now: Column, employers: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All stored jobs under a new vocabulary, without a sync: (jobs, reclassified events, one row of checked, reclassified, normalized, unchanged).

    jobs: fingerprint, source_id, source_tier, title, employer, summary, description, the DERIVED and PLACED columns, dates, updated_at; sources:
    source_id, source_tier, category, undated_open_window_days. Fingerprints, addresses, texts and dates stay. updated_at is new
    where a field changed; only a changed derived field makes an event.
    """
    s = sources.select("source_id", F.col("source_tier").alias("__tier"), F.col("category").alias("__source_category"), F.col("undated_open_window_days").alias("__days"))
    j = jobs.join(s, "source_id", "left")
    said = F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("title", "employer", "description")])
    place = F.coalesce(text.blank_to_null(F.col("location")), places.location_hint(F.concat_ws(" ", F.coalesce("summary", F.lit("")), F.coalesce("description", F.lit("")))))
    stored = F.struct(*[F.col(c) for c in DERIVED]).alias("__before"), F.struct(*[F.col(c) for c in PLACED]).alias("__placed")
    kept = [c for c in jobs.columns if c not in (*DERIVED, *PLACED)]
    fresh = j.select(*kept, "__tier", F.coalesce("__source_category", F.col("category")).alias("__source_category"), "__days", said.alias("__text"), place.alias("location"), *stored)
    fresh = _with_employer(fresh, employers)
    if v.taxonomy is None:
        sorted_in = F.coalesce(rules.first_match(F.col("__text"), v.categories), F.lit("other"))
    else:
        sorted_in = taxonomy.classify(F.col("__text"), F.col("location"), F.col("__source_category"), F.concat_ws(" ", "title", "employer"), v.taxonomy)["category"]
    fresh = fresh.withColumn("category", F.coalesce("__employer_category", sorted_in)).withColumn("degree_levels", text.ordered_subset(text.clean(F.col("__text")), profiles.DEGREE_MARKERS))
    fresh = fresh.withColumn("major_tags", major_tags(F.col("__text"), v))
    fresh = fresh.withColumn("relevance_score", relevance(F.col("__text"), F.col("major_tags"), F.coalesce("__tier", "source_tier"), F.col("category"), v))
    fresh = fresh.withColumn("relevance_band", scoring.band(F.col("relevance_score"), v.bands, v.lowest_band))
    status = dates.status(F.try_to_date(F.col("deadline_date").cast("string")), F.try_to_date(F.col("published_date").cast("string")), today, F.col("__days").cast("int"))
    fresh = fresh.withColumn("status", status).withColumn("place", places.location(F.col("location"), v.places)).select("*", "place.*").drop("place")
    fresh = fresh.withColumn("__after", F.struct(*[F.col(c).cast(jobs.schema[c].dataType).alias(c) for c in DERIVED]))
    fresh = fresh.withColumn("__now_placed", F.struct(*[F.col(c).cast(jobs.schema[c].dataType).alias(c) for c in PLACED]))
    fresh = fresh.withColumns({"__changed": ~F.col("__before").eqNullSafe(F.col("__after")), "__moved": ~F.col("__placed").eqNullSafe(F.col("__now_placed"))})
    hit = F.col("__changed") | F.col("__moved")
    columns = [F.col("__after")[c].alias(c) if c in DERIVED else F.col("__now_placed")[c].alias(c) if c in PLACED else F.when(hit, now).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c) for c in jobs.columns]
    payload = F.to_json(F.struct(F.col("__before").alias("before"), F.col("__after").alias("after")))
    events = fresh.filter("__changed").select("fingerprint", F.lit("reclassified").alias("event_type"), now.alias("occurred_at"), payload.alias("payload"))
    counts = fresh.agg(F.count("*").alias("checked"), F.count_if("__changed").alias("reclassified"), F.count_if("__moved").alias("normalized"), F.count_if(~hit).alias("unchanged"))
    return fresh.select(*columns), events, counts


def accepts(value: Column, denied: Sequence[str], words: Sequence[str], majors: Sequence[str], require_word: Column, require_major: Column, accept_all: Column, include: Sequence[str] = ()) -> Column:
    """Whether a candidate is taken, by its text: all are, or it has no denied pattern, the word and major that are required, one of the words to include if there are any, and a word or a major anyway.

    Case counts for nothing; denied are patterns, the others plain words.
    """
    shown = text.clean(value)
    low = F.lower(shown)
    has = lambda terms: text.contains_any(low, [t.lower() for t in terms])
    word, major = has(words), has(majors)
    required = (~F.coalesce(require_word, F.lit(False)) | word) & (~F.coalesce(require_major, F.lit(False)) | major)
    return F.coalesce(accept_all, F.lit(False)) | (~text.matches_any(shown, denied) & required & (has(include) if include else F.lit(True)) & (word | major))


def profile_page(records: DataFrame, level: Column, priority: Column, number: int, size: int, exact: str | None = None) -> DataFrame:
    """Visible records of a profile, best first; undated deadlines last; the older update first."""
    from brightloom.operators.listing import page

    seen = records.withColumns({"level": level, "priority": priority}).filter(F.col("level") != "not_recommended")
    seen = seen.filter(F.col("level") == exact) if exact else seen
    order = [F.desc("priority"), F.desc("relevance_score"), F.coalesce(F.col("deadline_date").cast("string"), F.lit("9999-12-31")), F.col("updated_at"), F.col("id")]
    return page(seen, order, number, size)
