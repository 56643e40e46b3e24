"""Write, audit, publish: new versions of tables become current together, after an audit of what was written, or not at all.

A version is a folder below the root with one Parquet folder a table. Readers go by a pointer, a small file that names the current
version and is replaced by one rename: they see all tables of the old version or all of the new one, and a version that is being read
stays until `forget` is told to drop it. A lost executor costs its tasks, a lost driver leaves a version that nothing points to.
One publisher at a time is assumed; a pointer that has moved since a version was begun is an error and nothing is published.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom import storage

from . import changes, report

POINTER = "CURRENT"


class Published(NamedTuple):
    """issues: what the audit found in the new version; published: whether it is current now."""

    version: str
    issues: DataFrame
    published: bool


def pointer(spark: SparkSession, root: str) -> dict:
    """{version, tables, before} of what is current; empty before the first publication."""
    return json.loads(storage.read_text(spark, f"{root}/{POINTER}") or "{}")


def current(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """The current version of a table, or None."""
    now = pointer(spark, root)
    return spark.read.parquet(now["tables"][table]) if table in now.get("tables", {}) else None


def publish(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], audit: Callable[[Mapping[str, DataFrame]], DataFrame]) -> Published:
    """Writes the tables as a new version, audits what was written, and makes it current if the audit has no rows. Tables not given stay as they are."""
    before = pointer(spark, root)
    version = uuid.uuid4().hex
    paths = {name: f"{root}/versions/{version}/{name}" for name in tables}
    for name, df in tables.items():
        df.write.parquet(paths[name])
    every = before.get("tables", {}) | paths
    issues = storage.stored(audit({name: spark.read.parquet(path) for name, path in every.items()}))
    if not issues.isEmpty():
        return Published(version, issues, False)
    if pointer(spark, root) != before:
        raise RuntimeError("another version was published since this one was begun")
    storage.replace_text(spark, f"{root}/{POINTER}", json.dumps({"version": version, "tables": every, "before": before.get("version")}))
    return Published(version, issues, True)


def forget(spark: SparkSession, root: str, version: str) -> None:
    """Deletes a version that no table of the current one lies in."""
    if any(f"/versions/{version}/" in path for path in pointer(spark, root).get("tables", {}).values()):
        raise ValueError("the current version has tables there")
    storage.delete(spark, f"{root}/versions/{version}")


#: A report's columns, one row a day: the payload is what readers get, frozen as text.
REPORT = "report_date date, payload string, delivery_status string, delivery_error string, generated_at timestamp"


def daily_payload(jobs: DataFrame, events: DataFrame, day: Column, start: Column, end: Column, card: Column, days: int = 7) -> DataFrame:
    """One row (report_date, payload): the day's new, updated and closing jobs as cards in report order, and their counts, as JSON.

    jobs: id, status, deadline_date, relevance_score; events: job_id, event_type, occurred_at; start, end: the local day as instants. Overdue jobs
    count as expired. A job updated twice is there twice, a new one is not among the updated. A report is one value by what it is: its
    sections hold one day's jobs.
    """
    overdue = (F.col("status") == "open") & F.coalesce(F.col("deadline_date") < day, F.lit(False))
    j = jobs.withColumn("status", F.when(overdue, "expired").otherwise(F.col("status")))
    moved = report.for_day(j, events.filter(F.col("event_type").isin("created", "updated")), start, end)
    first = events.filter((F.col("event_type") == "created") & (F.col("occurred_at") >= start) & (F.col("occurred_at") < end)).select(F.col("job_id").alias("id")).distinct()
    section = F.when(F.col("event_type") == "created", "new_jobs").otherwise("updated_jobs")
    of_day = moved.join(first.withColumn("__new", F.lit(True)), "id", "left").filter((F.col("event_type") == "created") | F.col("__new").isNull())
    parts = of_day.select("*", section.alias("section")).drop("__new", "event_type").unionByName(
        report.upcoming(j, day, days).withColumns({"section": F.lit("deadline_jobs"), "occurred_at": F.lit(None).cast(events.schema["occurred_at"].dataType)})
    )
    # in report order, and closing ones by their day first
    closing = F.when(F.col("section") == "deadline_jobs", F.col("deadline_date"))
    key = F.struct(closing.alias("closing"), (-F.col("relevance_score")).alias("score"), F.col("deadline_date").alias("deadline"), F.col("id").alias("id"), F.col("occurred_at").alias("at"), card.alias("card"))
    names = ("new_jobs", "updated_jobs", "deadline_jobs")
    lists = [F.array_sort(F.collect_list(F.when(F.col("section") == n, key))).alias(n) for n in names]
    counts = j.agg(F.count_if(F.col("status") == "open").alias("open_total"))
    cards = {n: F.transform(n, lambda x: x["card"]).alias(n) for n in names}
    stats = F.struct(F.size("new_jobs").alias("new"), F.size("updated_jobs").alias("updated"), F.size("deadline_jobs").alias("deadline_soon"), F.col("open_total").alias("open_total"))
    one = parts.agg(*lists).join(counts, F.lit(True))  # one row each
    return one.select(day.cast("date").alias("report_date"), F.to_json(F.struct(day.cast("date").alias("report_date"), *cards.values(), stats.alias("stats"))).alias("payload"))


def publish_report(spark: SparkSession, root: str, built: DataFrame, audit: Callable[[Mapping[str, DataFrame]], DataFrame], now: Column) -> Published:
    """Adds a day's report (daily_payload) to the published `reports`: a day that has one keeps it as it is, and nothing is written if the audit finds an issue."""
    rows = built.select("report_date", "payload", F.lit("pending").alias("delivery_status"), F.lit(None).cast("string").alias("delivery_error"), now.cast("timestamp").alias("generated_at"))
    old = current(spark, root, "reports")
    state = spark.createDataFrame([], REPORT) if old is None else old
    return publish(spark, root, {"reports": changes.insert_absent(state, rows, "report_date")}, audit)
