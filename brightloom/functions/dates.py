"""Dates in running text, deadlines, local days. Malformed dates become null and never raise."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, without_digit_gaps

#: Date notations, the words around application windows, deadlines and publication, and how far apart they may stand.
YMD = r"(20\d{2})\s*[年./-]\s*(\d{1,2})\s*[月./-]\s*(\d{1,2})"
GAPPED_YEAR = r"(?U)2[\s\x1c-\x1f]*0[\s\x1c-\x1f]*[0-9][\s\x1c-\x1f]*[0-9]"
FULL_DAY = r"(20\d{2})\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日"
MD = r"(\d{1,2})\s*月\s*(\d{1,2})\s*日"
CLOCK = r"(?:\s*\d{1,2}:\d{2})?"
ENGLISH_MDY = r"([A-Z][a-z]{2,8})\s+(\d{1,2}),\s*(20\d{2})"
ENGLISH_DMY = r"(\d{1,2})\s+([A-Z][a-z]{2,8})\s+(20\d{2})"
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
APPLY_WORDS = ("报名", "申请", "网申", "投递", "应聘")
WINDOW_WORDS = ("时间", "期间", "日期")
UNTIL_MARKS = ("至", "到", "-", "—", "~")
CLOSE_WORDS = ("截止", "截至", "截止时间", "结束")
EXPIRY_LABELS = ("过期时间", "有效期至", "有效期截止", "有效期", "到期时间")
EXPIRY_WORDS = ("截止", "截至", "过期", "有效期", "到期")
PUBLISHED_LABELS = ("发布时间", "发布于", "发布日期", "公告日期", "发文日期", "更新日期")
ENGLISH_CUES = ("application deadline", "closing date", "deadline", "apply by")

def _any(words: Iterable[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def make_date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def _groups(text: Column, pattern: str, *groups: int) -> list[Column]:
    return [F.nullif(F.regexp_extract(text, pattern, g), F.lit("")) for g in groups]


def chinese_date(text: Column) -> Column:
    """The first year-month-day notation; null if there is none or it is no date."""
    return make_date(*_groups(text, YMD, 1, 2, 3))


def _month_number(name: Column) -> Column:
    """Of a month's whole name or its first three letters, null for anything else."""
    months = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, i, *((m[:3], i) if m[:3] != m else ()))])
    return F.try_element_at(months, name).cast("string")


def english_date(text: Column) -> Column:
    """The first month-day-year notation, else the first day-month-year one; null if neither is a date."""
    m, d, y = _groups(text, ENGLISH_MDY, 1, 2, 3)
    first = make_date(y, _month_number(m), d)
    d, m, y = _groups(text, ENGLISH_DMY, 1, 2, 3)
    return F.coalesce(first, make_date(y, _month_number(m), d))


def any_date(text: Column) -> Column:
    return F.coalesce(chinese_date(text), english_date(text))


def deadline(text: Column) -> Column:
    """The closing date by the first of six patterns that the text has, null if that one holds no date.

    In order: an overall application window from some start to a date; the end of an application range; an
    end without year (the start's year counts; an impossible date passes on); a date after a closing word of
    applying; an expiry label; an English cue. A range counts only after a word of applying. All six hold a
    whole year, so a text without one, whatever blanks stand in it, is not asked for them.
    """
    t = without_digit_gaps(clean(text))
    until, window = rf"\s*{_any(UNTIL_MARKS)}\s*", rf"{_any(APPLY_WORDS)}.{{0,24}}?{_any(WINDOW_WORDS)}"
    overall = rf"{window}.{{0,32}}?(?:自|从).{{0,24}}?(?:至|到)\s*{YMD}"
    span = rf"{window}.{{0,20}}?{YMD}{until}{YMD}"
    same_year = rf"{window}.{{0,32}}?{FULL_DAY}{CLOCK}{until}(?:(20\d{{2}})\s*年\s*)?{MD}"
    closing = rf"{_any((*APPLY_WORDS, '招聘'))}.{{0,24}}?{_any(CLOSE_WORDS)}.{{0,32}}?{YMD}"
    expiry = rf"{_any(EXPIRY_LABELS)}\s*[:：]?\s*{YMD}"
    english = rf"(?i:{_any(ENGLISH_CUES)})[:\s]{{0,16}}({ENGLISH_MDY})"
    start, year, month, day = _groups(t, same_year, 1, 2, 3, 4)
    implicit = make_date(F.coalesce(year, start), month, day)
    found = (
        F.when(t.rlike(overall), make_date(*_groups(t, overall, 1, 2, 3)))
        .when(t.rlike(span), make_date(*_groups(t, span, 4, 5, 6)))
        .when(implicit.isNotNull(), implicit)
        .when(t.rlike(closing), make_date(*_groups(t, closing, 1, 2, 3)))
        .when(t.rlike(expiry), make_date(*_groups(t, expiry, 1, 2, 3)))
        .when(t.rlike(english), english_date(F.regexp_extract(t, english, 1)))
    )
    return F.when(text.rlike(GAPPED_YEAR), found)


def published(text: Column) -> Column:
    """The labelled date; else none if the text speaks of closing or expiry; else the first date."""
    t = without_digit_gaps(clean(text))
    labelled = rf"{_any(PUBLISHED_LABELS)}[:：\s]{{0,8}}{YMD}"
    return F.when(t.rlike(labelled), make_date(*_groups(t, labelled, 1, 2, 3))).when(~t.rlike(_any(EXPIRY_WORDS)), any_date(t))


def is_expired(day: Column, today: Column) -> Column:
    """Strictly before today; what is no date has not expired."""
    return F.coalesce(F.try_to_date(day.cast("string")) < today, F.lit(False))


def status(deadline_day: Column, published_day: Column, today: Column, undated_days: Column | int | None = None) -> Column:
    """expired after the deadline, or without one after `undated_days` from publication; else open."""
    late = is_expired(deadline_day, today)
    if undated_days is not None:
        late = late | (deadline_day.isNull() & F.coalesce(F.datediff(today, F.try_to_date(published_day.cast("string"))) > undated_days, F.lit(False)))
    return F.when(late, F.lit("expired")).otherwise(F.lit("open"))


def local_day_bounds(day: str, zone: str) -> tuple[Column, Column]:
    """The UTC start of a local day and of the next."""
    start = F.lit(day).cast("date")
    return tuple(F.to_utc_timestamp(d.cast("timestamp"), zone) for d in (start, F.date_add(start, 1)))


def epoch_date(millis: Column) -> Column:
    return F.when(millis > 0, F.to_date(F.timestamp_millis(millis)))


def month_day_date(text: Column) -> Column:
    """The ISO day at the front of a timestamp text, null if there is none."""
    return F.try_to_date(F.nullif(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")))


def cn_date(day: Column) -> Column:
    return F.date_format(day, "yyyy年M月d日")


def local_date(stamp: Column, zone: str) -> Column:
    """The local day of a UTC timestamp."""
    return F.to_date(F.from_utc_timestamp(stamp, zone))


def days_left(day: Column, today: Column) -> Column:
    """struct(state, days): unstated, expired, today or open, with the days from today."""
    n = F.datediff(day, today)
    state = F.when(day.isNull(), "unstated").when(n < 0, "expired").when(n == 0, "today").otherwise("open")
    return F.struct(state.alias("state"), n.alias("days"))


def heartbeat(stamp: Column, now: Column, limit_seconds: int) -> Column:
    """struct(status, age): missing, stale after the limit, or alive; the age in seconds."""
    age = F.unix_timestamp(now) - F.unix_timestamp(stamp)
    return F.struct(F.when(stamp.isNull(), "missing").when(age > limit_seconds, "stale").otherwise("alive").alias("status"), age.alias("age"))
