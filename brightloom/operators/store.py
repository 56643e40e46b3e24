"""Lookups, lists and small updates of the tables of sources, runs, reports and heartbeats, as pure functions of table states."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.functions import text

from .changes import replace_keys, upsert

#: What a skipped scan says where a site forbids it.
FORBIDDEN_WORDS = ("robots", "permit")
#: Types of sources are names of readers, so there are few; more are an error.
MOST_KINDS = 1_000


def find(table: DataFrame, key: str, value: object) -> DataFrame:
    """The row with the key, or none."""
    return table.filter(F.col(key) == F.lit(value))


def listed(table: DataFrame, *order: str | Column, enabled_only: bool = False) -> DataFrame:
    """All rows, or the enabled ones, in order: sources by tier and name, health by time."""
    return (table.filter("enabled") if enabled_only else table).orderBy(*order)


def newest(table: DataFrame, day: str, limit: int, most: int | None = None) -> DataFrame:
    """The newest rows by day: as many as asked for, at least one, and at most `most` if that is given."""
    return table.orderBy(F.desc(day)).limit(clamped(limit, 1, max(1, limit) if most is None else most))


def clamped(value: int | None, least: int, most: int, default: int | None = None) -> int:
    """A limit within its bounds, as page sizes, item limits and details of a search are."""
    return max(least, min(most, (most if default is None else default) if value is None else value))


def started(runs: DataFrame, starts: DataFrame, now: Column) -> DataFrame:
    """Appends running runs (id, source_id) to (id, source_id, started_at, finished_at, status, counts..., error_message)."""
    rows = starts.withColumns({"started_at": now, "status": F.lit("running")})
    return runs.unionByName(rows.select(*[c for c in runs.columns if c in rows.columns]), allowMissingColumns=True)


def finished(runs: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Closes running runs with results (id, status, counts..., error_message); runs that are closed stay as they are."""
    given = [c for c in results.columns if c != "id"]
    r = results.select("id", F.struct(*given).alias("__r"))
    j = runs.join(r, "id", "left").withColumn("__now", F.col("__r").isNotNull() & (F.col("status") == "running"))
    done = {c: F.when(F.col("__now"), F.col("__r")[c]).otherwise(F.col(c)) for c in given}
    done["finished_at"] = F.when(F.col("__now"), now).otherwise(F.col("finished_at"))
    return j.select(*[done.get(c, F.col(c)).alias(c) for c in runs.columns])


def stale_runs(runs: DataFrame, sources: DataFrame, cutoff: Column, enabled_only: bool = False) -> DataFrame:
    """Running runs begun at the cutoff or before, with their source's name and enabled (null if it is gone), oldest first."""
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "enabled")
    found = runs.filter((F.col("status") == "running") & (F.col("started_at") <= cutoff)).join(s, "source_id", "left")
    return (found.filter("enabled") if enabled_only else found).orderBy("started_at", "id")


def synced(sources: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Sets last_synced_at and updated_at of the sources with these ids."""
    hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    j = sources.join(hit, "id", "left")
    return j.select(*[F.when(F.col("__hit"), now).otherwise(F.col(c)).alias(c) if c in ("last_synced_at", "updated_at") else F.col(c) for c in sources.columns])


def heartbeat(state: DataFrame, beats: DataFrame, most: int = 500) -> DataFrame:
    """Upserts beats (service_name, status, detail, updated_at); details are cut."""
    return upsert(state, beats.withColumn("detail", text.truncated(F.col("detail"), most)), "service_name", [])


def delivered(reports: DataFrame, results: DataFrame) -> DataFrame:
    """Sets delivery_status and delivery_error of reports by report_date; the frozen payload stays."""
    r = results.select("report_date", F.struct("delivery_status", "delivery_error").alias("__r"))
    j = reports.join(r, "report_date", "left")
    new = {c: F.when(F.col("__r").isNotNull(), F.col("__r")[c]).otherwise(F.col(c)).alias(c) for c in ("delivery_status", "delivery_error")}
    return j.select(*[new.get(c, F.col(c)) for c in reports.columns])


def saved_snapshot(snapshots: DataFrame, today: DataFrame) -> DataFrame:
    """A day's snapshot in place of the one it had."""
    return replace_keys(snapshots, today, "snapshot_date")


def gated(postings: DataFrame, minimums: DataFrame, score: str = "relevance_score") -> tuple[DataFrame, DataFrame]:
    """Postings whose score reaches their source's minimum (none: zero), and per source how many were skipped."""
    j = postings.join(minimums.select("source_id", F.col("minimum_relevance").alias("__least")), "source_id", "left")
    low = F.coalesce(F.col(score) < F.coalesce("__least", F.lit(0)), F.lit(False))
    return j.filter(~low).drop("__least"), j.filter(low).groupBy("source_id").agg(F.count("*").alias("skipped"))


def run_summary(runs: DataFrame) -> DataFrame:
    """One row: sources, those finished, failed and skipped, and the sums of their counts."""
    counts = ("discovered_count", "open_matching_count", "inserted_count", "updated_count")
    states = [F.count_if(F.col("status") == s).alias(s) for s in ("finished", "failed", "skipped")]
    return runs.agg(F.count("*").alias("sources"), *states, *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts])


def skipped_status(detail: Column) -> Column:
    """The health of a source whose scan was skipped: blocked if the site forbids it."""
    return F.when(text.contains_any(F.lower(F.coalesce(detail, F.lit(""))), FORBIDDEN_WORDS), "source_blocked").otherwise("source_degraded")


def collected(spark: SparkSession, sources: DataFrame, readers: Mapping[str, Callable[[DataFrame], DataFrame]], schema: str) -> DataFrame:
    """The postings of all sources, each kind of source read by its reader; manual ones have none, and a kind without reader is an error."""
    kinds = {r[0] for r in sources.select("source_type").distinct().limit(MOST_KINDS + 1).collect()}
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"over {MOST_KINDS} types of sources")
    if unknown := kinds - readers.keys() - {"manual"}:
        raise ValueError(f"no reader for {sorted(map(str, unknown))}")
    out = spark.createDataFrame([], schema)
    for kind in sorted(kinds & readers.keys()):
        out = out.unionByName(readers[kind](sources.filter(F.col("source_type") == kind)))
    return out


def write_json(section: DataFrame, path: str) -> None:
    """A report's section as JSON lines."""
    section.write.mode("overwrite").json(path)


def unexpected(given: Column, allowed: list[str]) -> Column:
    """The fields that are given and not allowed, in order."""
    return F.array_sort(F.array_except(given, F.array(*[F.lit(a) for a in allowed])))

