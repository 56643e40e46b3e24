"""One sync of all sources as a pure step of table states; what fails in a source stays with that source."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom import storage

from . import changes, store


class Synced(NamedTuple):
    jobs: DataFrame
    events: DataFrame
    runs: DataFrame
    health: DataFrame


def sync(jobs: DataFrame, health: DataFrame, sources: DataFrame, records: DataFrame, failures: DataFrame, derived: list[str], now: Column) -> Synced:
    """jobs: state of changes.detect by fingerprint, with source_id and status among `derived`; health: of record_health; sources: source_id, enabled,
    minimum_relevance; records: of normalise.posting for all sources, with position; failures: source_id, skipped (boolean), error.

    The jobs' new state is stored in the shared folder, so that jobs, events and runs are of one detection. Records of failed or disabled sources and those below their source's minimum are left out. Every enabled source has
    one run: finished, skipped or failed, with its counts.
    """
    on = sources.filter("enabled")
    good = on.join(failures.select("source_id"), "source_id", "left_anti")
    taken = records.join(good.select("source_id"), "source_id", "left_semi")
    kept, skipped = store.gated(taken, good)
    batch = kept.select("fingerprint", "content_hash", *derived, "position")
    state, _ = changes.detect(jobs, batch, "fingerprint", "content_hash", derived, now, "position")
    # the four results are read apart: the detection runs once, with one time
    state = storage.stored(state)
    events = changes.told(state, "fingerprint")
    found = taken.groupBy("source_id").agg(F.count("*").alias("discovered_count"))
    opened = kept.filter("status = 'open'").groupBy("source_id").agg(F.count("*").alias("open_matching_count"))
    saved = state.filter("outcome <> 'absent'").groupBy("source_id").agg(F.count_if(F.col("outcome") == "created").alias("inserted_count"), F.count_if(F.col("outcome") == "updated").alias("updated_count"))
    runs = on.select("source_id").join(failures, "source_id", "left")
    for part in (found, opened, saved, skipped.withColumnRenamed("skipped", "below_minimum_count")):
        runs = runs.join(part, "source_id", "left")
    counts = ["discovered_count", "open_matching_count", "inserted_count", "updated_count", "below_minimum_count"]
    failed = F.col("error").isNotNull() | F.col("skipped").isNotNull()
    status = F.when(~failed, "finished").when(F.coalesce("skipped", F.lit(False)), "skipped").otherwise("failed")
    runs = runs.select("source_id", status.alias("status"), now.alias("finished_at"), *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], F.substring("error", 1, 1500).alias("error_message"))
    seen = F.when(F.col("status") == "finished", "source_active").when(F.col("status") == "skipped", store.skipped_status(F.col("error_message"))).otherwise("source_error")
    checks = runs.select("source_id", seen.alias("status"), now.cast(health.schema["checked_at"].dataType).alias("checked_at"), F.lit(None).cast("int").alias("status_code"), F.coalesce("error_message", F.lit("")).alias("detail"))
    return Synced(state, events, runs, changes.record_health(health, checks))
