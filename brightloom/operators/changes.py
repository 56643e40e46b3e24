"""Change detection and table states as pure functions: (state, input) gives the new state and the events.

Files don't change in place: a caller writes the returned state as a new version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(state: DataFrame, rows: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Rows replace those with their key, but `keep` columns stay as they were; new keys are added. Null is a key like others."""
    old, new = state.alias("o"), rows.withColumn("__there", F.lit(True)).alias("n")
    joined = old.join(new, F.col(f"o.{key}").eqNullSafe(F.col(f"n.{key}")), "full_outer")
    there = F.col("n.__there").isNotNull()
    pick = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in keep else F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return joined.select(*[pick(c).alias(c) for c in state.columns])


def detect(state: DataFrame, batch: DataFrame, key: str, content: str, derived: list[str], now: Column, position: str | None = None) -> tuple[DataFrame, DataFrame]:
    """State columns: key, content, derived columns, first_seen_at, last_seen_at, updated_at. Batch: key, content, derived.

    Unknown keys are created; the same content refreshes the derived columns and last_seen_at without an
    event; other content updates. Of rows with one key in a batch the last by `position` counts.
    Returns (new state, events (key, event_type, occurred_at)).
    """
    if position:
        batch = batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), position).alias("r")).select(key, "r.*")
    o, n = state.alias("o"), batch.alias("n")
    j = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    outcome = (
        F.when(F.col(f"n.{key}").isNull(), "absent").when(F.col(f"o.{key}").isNull(), "created")
        .when(F.col(f"o.{content}").eqNullSafe(F.col(f"n.{content}")), "unchanged").otherwise("updated")
    )
    j = j.withColumn("outcome", outcome)
    seen, new = F.col("outcome") != "absent", F.col("outcome") == "created"
    columns = [F.coalesce(f"o.{key}", f"n.{key}").alias(key)]
    columns += [F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in (content, *derived)]
    columns += [
        F.when(new, now).otherwise(F.col("o.first_seen_at")).alias("first_seen_at"), F.when(seen, now).otherwise(F.col("o.last_seen_at")).alias("last_seen_at"),
        F.when(F.col("outcome").isin("created", "updated"), now).otherwise(F.col("o.updated_at")).alias("updated_at"), "outcome",
    ]
    result = j.select(*columns)
    return result, told(result, key)


def told(detected: DataFrame, key: str) -> DataFrame:
    """The events (key, event_type, occurred_at) of a detected state: what was created or updated, at the time it was."""
    return detected.filter(F.col("outcome").isin("created", "updated")).select(key, F.col("outcome").alias("event_type"), F.col("updated_at").alias("occurred_at"))


def reclassified(before: DataFrame, after: DataFrame, key: str, fields: list[str], now: Column) -> DataFrame:
    """An event with before and after as JSON for every key whose fields differ, nulls compared as values."""
    old, new = before.select(key, F.struct(*fields).alias("old")), after.select(key, F.struct(*fields).alias("new"))
    changed = old.join(new, key).filter(~F.col("old").eqNullSafe(F.col("new")))
    return changed.select(key, F.lit("reclassified").alias("event_type"), now.alias("occurred_at"), F.to_json(F.struct(F.col("old").alias("before"), F.col("new").alias("after"))).alias("payload"))


def expire(state: DataFrame, today: Column, now: Column) -> DataFrame:
    """Open rows with a deadline before today become expired, with updated_at but no event."""
    late = (F.col("status") == "open") & F.coalesce(F.try_to_date(F.col("deadline_date").cast("string")) < today, F.lit(False))
    return state.withColumns({"status": F.when(late, "expired").otherwise(F.col("status")), "updated_at": F.when(late, now).otherwise(F.col("updated_at"))})


def insert_absent(state: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Frozen rows: keys that exist stay as they are; of new rows with one key any one is kept."""
    return state.unionByName(rows.join(state.select(key), key, "left_anti").dropDuplicates([key]).select(*state.columns))


def replace_keys(state: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows take the place of all rows with their keys, as a snapshot of a day does."""
    return state.join(rows.select(key), key, "left_anti").unionByName(rows)


def delete_cascade(parents: DataFrame, children: DataFrame, key: str, gone: Column) -> tuple[DataFrame, DataFrame]:
    """Parents without those to go, and children whose parent stays."""
    stay = parents.filter(~F.coalesce(gone, F.lit(False)))
    lost = parents.filter(F.coalesce(gone, F.lit(False))).select(key)
    return stay, children.join(lost, key, "left_anti")


def record_health(state: DataFrame, checks: DataFrame) -> DataFrame:
    """Upserts checks (source_id, status, checked_at, status_code, detail); the last success is carried on through failures."""
    joined = checks.join(state.select("source_id", F.col("last_success_at").alias("__last")), "source_id", "left")
    ok = F.col("status") == "source_active"
    rows = joined.withColumn("last_success_at", F.when(ok, F.col("checked_at")).otherwise(F.col("__last"))).withColumn("detail", F.substring("detail", 1, 1000))
    return replace_keys(state, rows.select(*state.columns), "source_id")


def interrupt_stale(runs: DataFrame, cutoff: Column, now: Column) -> DataFrame:
    """Running runs that began before the cutoff become interrupted."""
    stale = (F.col("status") == "running") & (F.col("started_at") <= cutoff)
    return runs.withColumns({"status": F.when(stale, "interrupted").otherwise(F.col("status")), "finished_at": F.when(stale, now).otherwise(F.col("finished_at"))})


def with_ids(fresh: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    """A stable surrogate id that follows from the key alone, so no task has to number all rows: 128 bits in hexadecimal."""
    return fresh.withColumn(id_col, F.md5(F.col(key).cast("string")))
