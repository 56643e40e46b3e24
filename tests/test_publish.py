"""Publication behind an audit, daily reports that stay as they are, as-of joins and changes between snapshots."""

import datetime as dt
import json
import random

import pytest
from brightloom import storage
from brightloom.operators import coverage, publish
from pyspark.sql import functions as F

NOW = F.lit("2026-09-18 12:00:00").cast("timestamp")


def no_negative(tables):
    return tables["jobs"].filter("n < 0").select("n")


def test_an_issue_keeps_the_old_version(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    make = lambda *n: spark.createDataFrame([(x,) for x in n], "n long")
    assert publish.current(spark, root, "jobs") is None and publish.pointer(spark, root) == {}
    first = publish.publish(spark, root, {"jobs": make(1, 2), "runs": make(7)}, no_negative)
    reader = publish.current(spark, root, "jobs")
    assert first.published and first.issues.count() == 0 and sorted(r.n for r in reader.collect()) == [1, 2]
    bad = publish.publish(spark, root, {"jobs": make(3, -4)}, no_negative)
    assert not bad.published and [r.n for r in bad.issues.collect()] == [-4]
    assert sorted(r.n for r in publish.current(spark, root, "jobs").collect()) == [1, 2] and publish.pointer(spark, root)["version"] == first.version
    second = publish.publish(spark, root, {"jobs": make(5)}, no_negative)
    assert publish.pointer(spark, root)["before"] == first.version and [r.n for r in publish.current(spark, root, "jobs").collect()] == [5]
    assert sorted(r.n for r in reader.collect()) == [1, 2]  # a version in use stays
    assert [r.n for r in publish.current(spark, root, "runs").collect()] == [7]
    with pytest.raises(ValueError):
        publish.forget(spark, root, first.version)  # runs still lie there
    publish.forget(spark, root, bad.version)
    assert second.published and not [f for f in (tmp_path / "store").iterdir() if f.name.endswith(".new")]


def test_two_publishers_at_once(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    one = spark.range(1).selectExpr("id AS n")

    def meanwhile(tables):
        storage.replace_text(spark, f"{root}/CURRENT", json.dumps({"version": "other", "tables": {}}))
        return no_negative(tables)

    with pytest.raises(RuntimeError):
        publish.publish(spark, root, {"jobs": one}, meanwhile)
    assert publish.pointer(spark, root)["version"] == "other"


def test_a_report_is_frozen_and_unwritten_where_the_audit_finds_something(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    day = dt.date(2026, 9, 18)
    jobs = spark.createDataFrame(
        [(1, "a", "open", 50, dt.date(2026, 9, 20)), (2, "b", "open", 90, None), (3, "c", "open", 10, dt.date(2026, 9, 17)), (4, "d", "open", 5, dt.date(2026, 9, 25)), (5, "e", "open", 99, dt.date(2026, 9, 26)), (6, "f", "expired", 1, dt.date(2026, 9, 18))],
        "id long, title string, status string, relevance_score int, deadline_date date",
    )
    at = lambda d, h: dt.datetime(2026, 9, d, h)
    events = spark.createDataFrame([(1, "created", at(17, 16)), (1, "updated", at(17, 18)), (2, "updated", at(17, 17)), (2, "updated", at(18, 1)), (3, "created", at(17, 20)), (4, "created", at(18, 16)), (5, "reclassified", at(18, 1)), (6, "created", at(17, 15))], "job_id long, event_type string, occurred_at timestamp")
    start, end = (F.lit(x).cast("timestamp") for x in ("2026-09-17 16:00:00", "2026-09-18 16:00:00"))
    build = lambda j: publish.daily_payload(j, events, F.lit(day), start, end, F.struct("id", "title"))
    payload = json.loads(build(jobs).first().payload)
    ids = lambda name: [c["id"] for c in payload[name]]
    assert (ids("new_jobs"), ids("updated_jobs"), ids("deadline_jobs")) == ([1, 3], [2, 2], [1, 4])
    assert payload["stats"] == {"new": 2, "updated": 2, "deadline_soon": 2, "open_total": 4} and payload["report_date"] == "2026-09-18"
    nothing = lambda t: t["reports"].limit(0)
    refuse = lambda t: t["reports"].select(F.lit("bad").alias("code"))
    assert not publish.publish_report(spark, root, build(jobs), refuse, NOW).published and publish.current(spark, root, "reports") is None
    assert publish.publish_report(spark, root, build(jobs), nothing, NOW).published
    assert publish.publish_report(spark, root, build(jobs.limit(0)), nothing, NOW).published
    (kept,) = publish.current(spark, root, "reports").collect()
    assert json.loads(kept.payload) == payload and kept.delivery_status == "pending"
    empty = json.loads(build(jobs.limit(0)).first().payload)
    assert empty["stats"] == {"new": 0, "updated": 0, "deadline_soon": 0, "open_total": 0}


@pytest.mark.parametrize("strictly", [True, False])
def test_asof_equals_a_search(spark, strictly):
    rng = random.Random(4)
    facts = [(rng.choice(["a", "b", None]), rng.choice([None, *range(20)]), i, rng.choice([None, i])) for i in range(80)]
    asked = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(25)]), i) for i in range(60)]
    f, a = spark.createDataFrame(facts, "k string, t int, n int, v int"), spark.createDataFrame(asked, "k string, t int, q int")
    got = {r.q: (r.fact_time, r.v, r.n) for r in coverage.asof(a, f, "t", ["k"], ["v", "n"], "n", strictly).collect()}
    for k, t, q in asked:
        before = [x for x in facts if x[0] == k and x[1] is not None and t is not None and (x[1] < t or not strictly and x[1] == t)]
        best = max(before, key=lambda x: (x[1], x[2]), default=None)
        assert got[q] == ((best[1], best[3], best[2]) if best else (None, None, None)), (k, t)
    assert coverage.asof(a, f.limit(0), "t", ["k"], ["v"]).filter("fact_time IS NOT NULL").count() == 0 and coverage.asof(a.limit(0), f, "t", ["k"], ["v"]).count() == 0
    assert coverage.asof(a.select("k", "t"), f, "t", ["k"], ["v"]).columns == ["k", "t", "fact_time", "v"]


def test_changes_of_all_days_at_once(spark):
    s = spark.createDataFrame([("2026-09-10", 5, {"p": 1, "q": 2}, 0.5), ("2026-09-17", 7, {"q": 5, "r": 1}, 0.3333), ("2026-09-18", None, None, None)], "d string, open int, profiles map<string,long>, share double")
    rows = {r.d: r for r in coverage.daily_changes(s, "d", ["open"], ["profiles"], ["share"]).collect()}
    assert (rows["2026-09-10"].available, rows["2026-09-10"].open_change, rows["2026-09-10"].profiles_change) == (False, None, None)
    r = rows["2026-09-17"]
    assert (r.available, r.baseline_day, r.open_change, r.profiles_change, r.share_change) == (True, "2026-09-10", 2, {"p": -1, "q": 3, "r": 1}, -0.1667)
    r = rows["2026-09-18"]
    assert (r.baseline_day, r.open_change, r.profiles_change, r.share_change) == ("2026-09-17", -7, {"q": -5, "r": -1}, -0.3333)
