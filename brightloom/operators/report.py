"""Daily reports: the day's new and updated records, what closes soon, and their counts. Nothing is changed by a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_day(events: DataFrame, key: str, new: str, updated: str) -> tuple[DataFrame, DataFrame]:
    """Distinct keys with a `new` event, and those with an `updated` event that are not new."""
    fresh = events.filter(F.col("event_type") == new).select(key).distinct()
    other = events.filter(F.col("event_type") == updated).select(key).distinct()
    return fresh, other.join(fresh, key, "left_anti")


def for_day(jobs: DataFrame, events: DataFrame, start: Column, end: Column, distinct_jobs: bool = False) -> DataFrame:
    """Jobs with each of their events in [start, end); a job updated twice is there twice unless distinct_jobs."""
    day = events.filter((F.col("occurred_at") >= start) & (F.col("occurred_at") < end))
    day = day.select("job_id", "event_type", *([] if distinct_jobs else ["occurred_at"])).distinct()
    return jobs.join(day, jobs["id"] == day["job_id"]).drop("job_id")


def upcoming(jobs: DataFrame, day: Column, days: int = 7) -> DataFrame:
    """Open jobs whose deadline is in [day, day + days]."""
    return jobs.filter((F.col("status") == "open") & F.col("deadline_date").between(day, F.date_add(day, days)))


def order(columns: tuple[str, str, str] = ("relevance_score", "deadline_date", "id")) -> list[Column]:
    score, deadline, key = columns
    return [F.desc(score), F.col(deadline).asc_nulls_first(), F.col(key)]


def stats(new: DataFrame, updated: DataFrame, closing: DataFrame, opened: DataFrame) -> DataFrame:
    parts = {"new_jobs": new, "updated_jobs": updated, "upcoming_deadlines": closing, "open_jobs": opened}
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in parts.items()]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    return every.agg(*[F.max(F.when(F.col("name") == k, F.col("n"))).alias(k) for k in parts])
