"""Places: struct(province, city, country_or_region, location_confidence, location_evidence) from a location text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import longest_first
from .text import clean, contains_any

FIELDS = ("province", "city", "country_or_region", "location_confidence", "location_evidence")
#: Labels before a place in running text, labels of what may follow it, words for several or foreign places.
HINT_LABELS = ("工作地点", "工作地", "工作城市", "任职地点", "岗位地点", "工作区域", "地点", "location", "city", "country")
NEXT_LABELS = (
    "学历", "专业", "职位", "岗位", "职责", "要求", "任职资格", "发布时间", "截止", "申请", "报名", "福利", "department", "job description", "requirements", "qualifications", "responsibilities",
)
SEVERAL = ("multi-location", "multiple locations")
ABROAD = ("海外", "境外")


@dataclass(frozen=True)
class Places:
    """Dictionaries: aliases of provinces, of cities (to province and city), of countries; English patterns, letter codes and cities abroad."""

    provinces: Mapping[str, str] = field(default_factory=dict)
    cities: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    municipalities: Sequence[str] = ()
    countries: Mapping[str, str] = field(default_factory=dict)
    patterns: Sequence[tuple[str, str]] = ()
    codes: Mapping[str, str] = field(default_factory=dict)
    cities_abroad: Mapping[str, str] = field(default_factory=dict)
    home: str = "中国大陆"
    abroad: str = "海外"
    several: str = "多地点"


def _found(*values: Column | str | None) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v).cast("string")).alias(k) for k, v in zip(FIELDS, values, strict=True)])


def _longest(text: Column, aliases: Sequence[str]) -> Column:
    """The longest alias in the text; equal lengths keep their order."""
    terms = F.array(*[F.lit(a) for a in longest_first(aliases)]) if aliases else F.array().cast("array<string>")
    return F.get(F.filter(terms, lambda a: F.contains(text, a)), 0)


def _mapped(key: Column, table: Mapping[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key) if table else F.lit(None).cast("string")


def city_abroad(text: Column, p: Places) -> Column:
    """Several places, a known city, or what stands before the first comma."""
    low = F.lower(text)
    known = _longest(low, list(p.cities_abroad))
    first = F.trim(F.get(F.split(text, "[,，]"), 0))
    plain = F.when((first != "") & ~F.lower(first).isin(*SEVERAL, p.abroad), F.substring(first, 1, 80))
    return F.when(contains_any(low, SEVERAL), F.lit(p.several)).when(known.isNotNull(), _mapped(known, p.cities_abroad)).otherwise(plain)


def location(text: Column, p: Places) -> Column:
    """Stages: blank; a home city (explicit beside its province's name, else normalized); a province; a country; an English
    country name; a letter code; a city abroad; a word for abroad; unknown."""
    t = clean(text)
    province, city = _longest(t, list(p.provinces)), _longest(t, list(p.cities))
    named, country = _mapped(province, p.provinces), _longest(t, list(p.countries))
    chain = F.when(t == "", _found(None, None, None, "unknown", None))
    chain = chain.when(
        city.isNotNull(),
        _found(_mapped(city, {a: x for a, (x, _) in p.cities.items()}), _mapped(city, {a: c for a, (_, c) in p.cities.items()}), p.home, F.when(province.isNotNull(), "explicit").otherwise("normalized"), F.coalesce(province, city)),
    )
    own = F.when(named.isin(*p.municipalities), named) if p.municipalities else None
    chain = chain.when(province.isNotNull(), _found(named, own, p.home, "explicit", province))
    chain = chain.when(country.isNotNull(), _found(None, None, _mapped(country, p.countries), "explicit", country))
    away, low, up = city_abroad(t, p), F.lower(t), F.upper(t)
    for pattern, name in p.patterns:
        chain = chain.when(low.rlike(pattern), _found(None, away, name, "explicit", F.regexp_extract(low, pattern, 0)))
    for code, name in p.codes.items():
        chain = chain.when(up.rlike(f"(?<![A-Z]){code}(?![A-Z])"), _found(None, away, name, "explicit", code))
    chain = chain.when(away.isNotNull(), _found(None, away, p.abroad, "normalized", away))
    for word in ABROAD:
        chain = chain.when(F.contains(t, F.lit(word)), _found(None, None, p.abroad, "explicit", word))
    return chain.otherwise(_found(None, None, None, "unknown", None))


def location_hint(text: Column, labels: Sequence[str] = HINT_LABELS, following: Sequence[str] = NEXT_LABELS, most: int = 120) -> Column:
    """The place after a label in running text, up to the next label or sentence end, at most so long; null without one."""
    stop = "|".join(x.replace(" ", r"\s+") for x in following)
    pattern = rf"(?i)(?:{'|'.join(labels)})\s*[:：]\s*(.{{1,{most}}}?)(?=\s*(?:[；;。|]\s*)?(?:{stop})\w*\s*[:：]|$)"
    value = F.btrim(F.get(F.split(F.regexp_extract(clean(text), pattern, 1), "[。；;|]"), 0), F.lit(" ,，"))
    return F.nullif(value, F.lit(""))
