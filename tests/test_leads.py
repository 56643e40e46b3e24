"""Leads against a plain version of their guards, over batches with several changes of one lead."""

import json
import random

from brightloom.operators import leads
from pyspark.sql import functions as F

NOW = F.lit("2026-01-02").cast("timestamp")


def text(x):
    return (x or "").strip() or None


def plain(lead, changes):
    """lead: dict; changes: [(position, action, fields, job)] in order; the lead after them and the refusals."""
    lead, refused, taken = dict(lead), [], 0
    for position, action, fields, job in changes:
        fields = fields or {}
        value = lambda c: fields[c] if c in fields else lead[c]  # noqa: E731, B023
        status = (value("verification_status") or "").strip()
        url, note = text(value("official_url")), text(value("verification_note")) or ""
        unknown = sorted(set(fields) - set(leads.EDITABLE))
        try:
            is_object = isinstance(json.loads(value("metadata")), dict)
        except (ValueError, TypeError):
            is_object = False
        reason = None
        if action == "update":
            if unknown:
                reason = "unsupported fields " + ", ".join(unknown)
            elif status == "published":
                reason = "needs the publication action"
            elif status not in ("candidate", "official_url_found", "official_content_verified", "rejected", "expired"):
                reason = "unsupported status"
            elif status.startswith("official") and not url:
                reason = "needs an official address"
            elif status == "official_content_verified" and not note:
                reason = "needs a note"
            elif not is_object:
                reason = "metadata_not_object"
            else:
                lead |= {c: text(value(c)) for c in leads.HINTS} | {"official_url": url, "verification_note": note, "metadata": value("metadata"), "verification_status": status}
        elif action == "publish":
            if lead["verification_status"] != "official_content_verified":
                reason = "not verified"
            elif not lead["official_url"]:
                reason = "no official address"
            else:
                lead |= {"verification_status": "published", "published_job_id": job}
        else:
            reason = "unknown action"
        taken += reason is None
        if reason:
            refused.append((position, action, reason))
    return lead, refused, taken


def test_a_batch_is_folded_in_order(spark):
    rng = random.Random(3)
    rows = [(i, " p ", f"https://l/{i}", "t", "hint" if i % 3 else None) for i in range(60)]
    new, bad = leads.created(spark.createDataFrame([*rows, (100, " ", "", "t", None)], "id long, lead_provider string, lead_url string, title string, employer_hint string"), F.lit("2026-01-01").cast("timestamp"))
    assert [(r.id, r.reason) for r in bad.collect()] == [(100, "missing lead_provider, lead_url")]
    start = {r.id: r.asDict() for r in new.collect()}
    assert start[1]["verification_status"] == "candidate" and start[1]["metadata"] == "{}" and start[1]["lead_provider"] == "p"
    values = {
        "verification_status": ["candidate", "official_url_found", " official_content_verified ", "official_content_verified", "rejected", "published", "odd", None], "official_url": ["https://o/1", "", None, "https://o/2"],
        "verification_note": ["seen", " ", None], "metadata": ['{"a": 1}', "[1]", "junk", None], "employer_hint": ["e", " "], "title": ["no"],
    }
    changes = []
    for i in range(-1, 60):
        for k in range(rng.randint(0, 7)):
            action = rng.choice(["update", "update", "update", "publish", "odd"] if k < 5 else ["publish"])
            names = rng.sample(list(values), rng.randint(0, 3)) if rng.random() < 0.7 else ["verification_status", "official_url", "verification_note"]
            changes.append((i, k, action, {n: rng.choice(values[n]) for n in names} if rng.random() < 0.95 else None, k * 10))
    rng.shuffle(changes)
    after, refused = leads.fold(new, spark.createDataFrame(changes, leads.CHANGE), NOW)
    got, reasons = {r.id: r for r in after.collect()}, sorted(tuple(r) for r in refused.collect())
    want_reasons = [(i, k, a, "unknown lead") for i, k, a, _, _ in changes if i == -1]
    assert after.columns == new.columns and len(got) == 60 and len(after.collect()) == 60
    states = set()
    for i, lead in start.items():
        want, why, taken = plain(lead, sorted([c[1:] for c in changes if c[0] == i], key=lambda c: c[0]))
        want["updated_at"] = got[i].updated_at if taken else lead["updated_at"]
        assert got[i].asDict() == want, (i, [c for c in changes if c[0] == i])
        assert (str(got[i].updated_at)[:10] == "2026-01-02") == bool(taken)
        want_reasons += [(i, *w) for w in why]
        states.add(want["verification_status"])
    assert reasons == sorted(want_reasons) and {"published", "candidate", "rejected"} <= states


def test_a_verified_lead_becomes_a_posting_and_none_before(spark):
    new, _ = leads.created(spark.createDataFrame([(1, "p", "https://l/1", "某地质局公开招聘", "某省地质局")], "id long, lead_provider string, lead_url string, title string, employer_hint string"), NOW)
    assert leads.posting_of(new, "A").count() == 0
    meta = '{"employer": "某省地质局", "description": "面向资源勘查工程本科", "location": "山东省东营市", "deadline_date": "2026-12-31"}'
    change = [(1, 1, "publish", None, 5), (1, 2, "update", {"official_url": "https://o/1", "verification_status": "official_content_verified", "verification_note": "checked", "metadata": meta}, None)]
    after, refused = leads.fold(new, spark.createDataFrame(change, leads.CHANGE), NOW)
    assert [r.reason for r in refused.collect()] == ["not verified"]
    raw = leads.posting_of(after, "A").first()
    assert (raw.source_url, raw.location, raw.deadline_date, raw.external_id, raw.text) == ("https://o/1", "山东省东营市", "2026-12-31", "verified-lead-1", "面向资源勘查工程本科")
    done, refused = leads.fold(after, spark.createDataFrame([(1, 1, "publish", None, 77), (1, 2, "update", {"employer_hint": "x"}, None)], leads.CHANGE), NOW)
    assert (done.first().published_job_id, done.first().verification_status) == (77, "published") and [r.reason for r in refused.collect()] == ["needs the publication action"]
    assert leads.newest(done, 0, "published").count() == 1 and leads.newest(done, 9, "candidate").count() == 0
