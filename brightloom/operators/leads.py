"""Candidate leads: a private table with guarded transitions; leads are never part of the published records.

A batch of changes is folded over each lead in order: every change sees the lead as the changes before it left it, is taken or
refused by the guards, and refusals come back in order with their reasons. A batch's changes of one lead are one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.functions import text

#: The states, those that need an official address, and the fields that an update may give.
CANDIDATE, FOUND, VERIFIED, REJECTED, EXPIRED, PUBLISHED = "candidate", "official_url_found", "official_content_verified", "rejected", "expired", "published"
STATES = (CANDIDATE, FOUND, VERIFIED, REJECTED, EXPIRED)
ADDRESSED = (FOUND, VERIFIED)
HINTS = ("employer_hint", "location_hint", "province_hint", "published_date")
EDITABLE = (*HINTS, "official_url", "verification_note", "metadata", "verification_status")
LEAD = (
    "id long, lead_provider string, lead_url string, title string, employer_hint string, location_hint string, province_hint string, published_date string, official_url string, "
    "verification_status string, verification_note string, metadata string, published_job_id long, created_at timestamp, updated_at timestamp"
)
#: An update's fields and their new values as text (null clears one; metadata is JSON); a publication's job. Changes of a lead go by position.
CHANGE = "id long, position long, action string, fields map<string,string>, job_id long"


def _is_object(json: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(json)).startswith("OBJECT"), F.lit(False))


def created(rows: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """New leads with provider, address and title become candidates; the others are returned with a reason.

    rows: id, lead_provider, lead_url, title, and the hints, official_url, verification_note and metadata that there are.
    """
    schema = dict(c.rsplit(" ", 1) for c in LEAD.split(", "))
    have = lambda c: F.col(c).cast(schema[c]) if c in rows.columns else F.lit(None).cast(schema[c])
    required = ("lead_provider", "lead_url", "title")
    blank = [F.when(F.trim(F.coalesce(have(c), F.lit(""))) == "", F.lit(c)) for c in required]
    missing = F.array_join(F.array_compact(F.array(*blank)), ", ")
    reason = F.when(missing != "", F.concat(F.lit("missing "), missing)).when(have("metadata").isNotNull() & ~_is_object(have("metadata")), "metadata_not_object")
    marked = rows.withColumn("reason", reason)
    new = {c: text.blank_to_null(have(c)) for c in (*HINTS, "official_url")} | {c: F.trim(have(c)) for c in required}
    new |= {
        "id": have("id"), "verification_status": F.lit(CANDIDATE), "verification_note": F.coalesce(text.blank_to_null(have("verification_note")), F.lit("")), "metadata": F.coalesce(have("metadata"), F.lit("{}")),
        "published_job_id": F.lit(None).cast("long"), "created_at": now.cast("timestamp"), "updated_at": now.cast("timestamp"),
    }
    return marked.filter("reason IS NULL").select(*[new[c].alias(c) for c in schema]), marked.filter("reason IS NOT NULL")


#: What the fold carries of a lead.
_STATE = (*HINTS, "official_url", "verification_note", "metadata", "verification_status", "published_job_id")


def _step(lead: Column, change: Column) -> Column:
    """The lead after one change, with the change's refusal appended if it has one."""
    fields = F.coalesce(change["fields"], F.create_map().cast("map<string,string>"))
    given = lambda c: F.array_contains(F.map_keys(fields), F.lit(c))
    value = lambda c: F.when(given(c), F.try_element_at(fields, F.lit(c))).otherwise(lead[c])
    unknown = F.array_sort(F.array_except(F.map_keys(fields), F.array(*[F.lit(c) for c in EDITABLE])))
    status = F.trim(value("verification_status"))
    url = text.blank_to_null(value("official_url"))
    note = F.coalesce(text.blank_to_null(value("verification_note")), F.lit(""))
    wrong = (
        F.when(F.size(unknown) > 0, F.concat(F.lit("unsupported fields "), F.array_join(unknown, ", "))).when(status == PUBLISHED, "needs the publication action")
        .when(~F.coalesce(status.isin(*STATES), F.lit(False)), "unsupported status").when(status.isin(*ADDRESSED) & url.isNull(), "needs an official address").when((status == VERIFIED) & (note == ""), "needs a note")
        .when(~_is_object(value("metadata")), "metadata_not_object")
    )
    unready = F.when(lead["verification_status"] != VERIFIED, "not verified").when(F.coalesce(lead["official_url"], F.lit("")) == "", "no official address")
    reason = F.when(change["action"] == "update", wrong).when(change["action"] == "publish", unready).otherwise("unknown action")
    updates, publishes = reason.isNull() & (change["action"] == "update"), reason.isNull() & (change["action"] == "publish")
    new = {c: text.blank_to_null(value(c)) for c in HINTS} | {"official_url": url, "verification_note": note, "metadata": value("metadata"), "verification_status": status, "published_job_id": lead["published_job_id"]}
    after = {c: F.when(updates, v).otherwise(lead[c]) for c, v in new.items()}
    after["verification_status"] = F.when(publishes, PUBLISHED).otherwise(after["verification_status"])
    after["published_job_id"] = F.when(publishes, change["job_id"]).otherwise(after["published_job_id"])
    refusal = F.struct(change["position"].alias("position"), change["action"].alias("action"), reason.alias("reason"))
    refused = F.when(reason.isNull(), lead["refused"]).otherwise(F.array_append(lead["refused"], refusal))
    return F.struct(*[after[c].alias(c) for c in _STATE], refused.alias("refused"), (lead["taken"] + reason.isNull().cast("int")).alias("taken"))


def fold(leads: DataFrame, changes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(leads, refusals (id, position, action, reason)) after a batch of CHANGE rows, those of each lead by position; of equal positions any order.

    A lead of which a change was taken is updated now. Changes of unknown leads are refused.
    """
    per_lead = changes.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("position", "action", "job_id", F.map_entries("fields").alias("entries")))).alias("__changes"))
    opened = F.transform("__changes", lambda c: F.struct(c["position"].alias("position"), c["action"].alias("action"), F.map_from_entries(c["entries"]).alias("fields"), c["job_id"].alias("job_id")))
    j = leads.withColumn("__there", F.lit(True)).join(per_lead.withColumn("__changes", opened), "id", "full_outer")
    start = F.struct(*[F.col(c) for c in _STATE], F.array().cast("array<struct<position:bigint,action:string,reason:string>>").alias("refused"), F.lit(0).alias("taken"))
    done = F.when(F.col("__changes").isNull(), start).otherwise(F.aggregate(F.col("__changes"), start, _step))
    # the outer explode keeps the fold from being computed anew for every field
    j = j.withColumn("__lead", F.explode_outer(F.array(done)))
    moved = j.filter("__there")
    after = {c: F.col("__lead")[c] for c in _STATE} | {"updated_at": F.when(F.col("__lead.taken") > 0, now.cast("timestamp")).otherwise(F.col("updated_at"))}
    refused = moved.select("id", F.inline("__lead.refused"))
    unknown = j.filter("__there IS NULL").select("id", F.explode("__changes").alias("c")).select("id", "c.position", "c.action", F.lit("unknown lead").alias("reason"))
    return moved.select(*[after.get(c, F.col(c)).alias(c) for c in leads.columns]), refused.unionByName(unknown)


def newest(leads: DataFrame, limit: int, status: str | None = None) -> DataFrame:
    """At most `limit` leads, clamped to 1..500, of a state or of all, newest first."""
    return (leads.filter(F.col("verification_status") == status) if status else leads).orderBy(F.desc("updated_at"), F.desc("id")).limit(max(1, min(limit, 500)))


#: Fixed value: the source that holds what was published from leads.
MANUAL_SOURCE = "official-manual-import"


def posting_of(leads: DataFrame, source_tier: str, source_id: str = MANUAL_SOURCE) -> DataFrame:
    """Verified leads as raw postings for normalise.posting: what their metadata says of employer, description, dates and place, else their hints."""
    said = lambda k: text.blank_to_null(F.get_json_object("metadata", f"$.{k}"))
    return leads.filter(F.col("verification_status") == VERIFIED).select(
        F.col("id").alias("lead_id"), F.lit(source_id).alias("source_id"), F.lit(source_tier).alias("source_tier"), "title", F.coalesce(said("employer"), "employer_hint").alias("employer"), F.col("official_url").alias("source_url"),
        said("application_url").alias("application_url"), F.coalesce(said("description"), F.col("title")).alias("text"), F.coalesce(said("published_date"), "published_date").alias("published_date"), said("deadline_date").alias("deadline_date"),
        F.coalesce(said("location"), "location_hint").alias("location"), F.lit(None).cast("string").alias("match_text"), F.concat(F.lit("verified-lead-"), F.col("id")).alias("external_id"),
    )
