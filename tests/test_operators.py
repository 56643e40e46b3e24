import datetime as dt

from brightloom.operators import audit, changes, cohort, coverage, listing, report, store
from brightloom.streaming import ingest
from pyspark.sql import functions as F

NOW, LATER = (F.lit(x).cast("timestamp") for x in ("2026-01-01", "2026-01-02"))
STATE = "k string, content string, tag string, first_seen_at timestamp, last_seen_at timestamp, updated_at timestamp"


def test_detect_creates_keeps_and_updates(spark):
    empty = spark.createDataFrame([], STATE)
    batch = spark.createDataFrame([("a", "1", "x", 0), ("b", "1", "x", 1), ("a", "2", "y", 2)], "k string, content string, tag string, pos int")
    state, events = changes.detect(empty, batch, "k", "content", ["tag"], NOW, "pos")
    assert {(r.k, r.content, r.outcome) for r in state.collect()} == {("a", "2", "created"), ("b", "1", "created")} and events.count() == 2
    again = spark.createDataFrame([("a", "2", "z"), ("b", "9", "x")], "k string, content string, tag string")
    state, events = changes.detect(state.drop("outcome"), again, "k", "content", ["tag"], LATER)
    got = {r.k: r for r in state.collect()}
    assert got["a"].outcome == "unchanged" and got["a"].tag == "z" and got["a"].updated_at == dt.datetime(2026, 1, 1) and got["a"].last_seen_at == dt.datetime(2026, 1, 2)
    assert got["b"].outcome == "updated" and [r.k for r in events.collect()] == ["b"]
    state, events = changes.detect(state.drop("outcome"), again.limit(0), "k", "content", ["tag"], LATER)
    assert {r.outcome for r in state.collect()} == {"absent"} and events.count() == 0


def test_upsert_keeps_columns(spark):
    s = spark.createDataFrame([("a", "old", 1)], "k string, v string, made int")
    n = spark.createDataFrame([("a", "new", 2), ("b", None, 2)], s.schema)
    assert {tuple(r) for r in changes.upsert(s, n, "k", ["made"]).collect()} == {("a", "new", 1), ("b", None, 2)}


def test_frozen_and_replaced_rows(spark):
    s = spark.createDataFrame([("d1", 1)], "d string, n int")
    n = spark.createDataFrame([("d1", 9), ("d2", 2)], s.schema)
    assert {tuple(r) for r in changes.insert_absent(s, n, "d").collect()} == {("d1", 1), ("d2", 2)}
    assert {tuple(r) for r in changes.replace_keys(s, n, "d").collect()} == {("d1", 9), ("d2", 2)}


def test_delete_cascades(spark):
    jobs, events = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, "x"), (2, "y")], "id int, e string")
    stay, left = changes.delete_cascade(jobs, events, "id", F.col("id") == 1)
    assert [r.id for r in stay.collect()] == [2] and [r.e for r in left.collect()] == ["y"]


def test_health_carries_the_last_success(spark):
    schema = "source_id string, status string, checked_at string, last_success_at string, status_code int, detail string"
    s = spark.createDataFrame([("a", "source_active", "t1", "t1", 200, "")], schema)
    c = spark.createDataFrame([("a", "source_error", "t2", 500, "x" * 2000)], "source_id string, status string, checked_at string, status_code int, detail string")
    r = changes.record_health(s, c).first()
    assert r.last_success_at == "t1" and r.status == "source_error" and len(r.detail) == 1000


def test_stale_runs(spark):
    r = spark.createDataFrame([("running", "2026-01-01"), ("finished", "2026-01-01"), ("running", "2026-01-03")], "status string, started_at string")
    r = r.withColumns({"started_at": F.col("started_at").cast("timestamp"), "finished_at": F.lit(None).cast("timestamp")})
    assert [x.status for x in changes.interrupt_stale(r, LATER, LATER).collect()] == ["interrupted", "finished", "running"]


def test_latest_and_first(spark):
    e = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (None, 3, "c")], "u int, i int, v string")
    assert {r.v for r in listing.latest(e, ["u"], "i").collect()} == {"b", "c"} and {r.v for r in listing.first_seen(e, ["u"], "i").collect()} == {"a", "c"}


def test_concentration_ties_and_nulls(spark):
    d = spark.createDataFrame([("g", "b"), ("g", "a"), ("h", None)], "g string, k string")
    assert {tuple(r) for r in listing.concentration(d, ["g"], "k").collect()} == {("g", "a", 1, 2, 0.5, "high"), ("h", "unknown", 1, 1, 1.0, "high")}


def test_longest_alias_wins(spark):
    t = spark.createDataFrame([(1, "中国石油勘探院"), (2, None)], "id int, t string")
    a = spark.createDataFrame([("中国石油", 0), ("中国石油勘探院", 1)], "alias string, ord int")
    assert [tuple(r) for r in listing.longest_containing(t, "t", a, "alias", ["id"], "ord").collect()] == [(1, "中国石油勘探院", 1)]


def test_page_floor(spark):
    assert [r.id for r in listing.page(spark.range(5), [F.col("id")], 0, 2).collect()] == [0, 1]


def test_day_split(spark):
    e = spark.createDataFrame([(1, "created"), (1, "updated"), (2, "updated"), (2, "updated")], "job_id int, event_type string")
    new, updated = report.split_day(e, "job_id", "created", "updated")
    assert [r.job_id for r in new.collect()] == [1] and [r.job_id for r in updated.collect()] == [2]


def test_unknown_is_not_zero(spark):
    t, n = F.lit(True), F.lit(None).cast("boolean")
    row = spark.range(1).select(coverage.no_match_is_verified(t, t, t, n).alias("a"), coverage.no_match_is_verified(t, t, t, t).alias("b")).first()
    assert (row.a, row.b) == (False, True)


def test_health_codes(spark):
    rows = spark.createDataFrame([(200, "ok"), (403, ""), (404, ""), (500, ""), (None, ""), (200, "Page not found")], "c int, t string")
    got = [r[0] for r in rows.select(coverage.health_status(F.col("c"), F.col("t"), F.lit(True))).collect()]
    assert got == ["source_active", "source_blocked", "source_degraded", "source_error", "source_error", "source_degraded"]


def test_audit_rules(spark):
    d = spark.createDataFrame([(1, ""), (2, "x"), (3, None)], "id int, t string")
    found = audit.table_issues(d, [audit.rule("empty", F.coalesce(F.trim("t") == "", F.lit(True))), audit.rule("never", F.lit(None).cast("boolean"))], "id")
    assert {tuple(r) for r in found.collect()} == {("empty", 1), ("empty", 3)}


def test_job_rules_have_one_positive_and_one_negative_row(spark):
    schema = "id int, source_type string, enabled boolean, verification_status string, official_evidence_url string, source_url string, title string, summary string, description string, minimum_relevance string, relevance_score int, status string, deadline_date string"
    good = (1, "html_notice", True, "published_official", "https://a.b/c", "https://a.b/c", "t", "s", "d", "0", 50, "open", "2026-12-01")
    bad = (2, "html_notice", False, "draft", "x", "https://other/c", " ", "forbidden", None, "no", -1, "open", "2025-01-01")
    odd = (3, None, None, "draft", "x", "x", " ", "", None, "no", -1, "open", "soon")
    late = (4, "manual", False, "published_official", "https://a.b", "nope", "interview", "", "d", "60", 50, "open", "soon")
    rows = spark.createDataFrame([good, bad, odd, late], schema)
    rules = audit.job_rules(F.lit("2026-01-01").cast("date"), F.try_to_number(F.col("minimum_relevance"), F.lit("999")).cast("int"), F.array(F.lit("a.b")), ["forbidden"], ["interview"])
    got = {}
    for r in audit.table_issues(rows, rules, "id").collect():
        got.setdefault(r.id, set()).add(r.code)
    assert 1 not in got and got[3] == {"unknown_source"}
    assert got[2] == {"unpublished_job_record", "missing_official_evidence_url", "source_host_mismatch", "forbidden_notice_text", "invalid_source_threshold", "below_source_threshold", "disabled_source_job", "empty_title", "empty_description", "stale_open_job"}
    assert got[4] == {"invalid_source_url", "non_vacancy_process_notice", "below_source_threshold", "invalid_deadline"}


def test_cohort_has_a_hundred_members(spark):
    m = cohort.members(spark, {"a": 40, "b": 14, "c": 14, "d": 14, "e": 6, "f": 6, "g": 6})
    assert m.count() == 100 and {r.member_id for r in m.collect()} >= {"GS-001", "GS-100"}


def test_stream_applies_each_batch_once(spark, tmp_path):
    schema = "k string, content string, tag string"
    batches = tmp_path / "in"
    spark.createDataFrame([("a", "1", "x")], schema).write.parquet(str(batches), mode="append")
    target = ingest.VersionedTable(str(tmp_path / "state"))
    run = lambda: ingest.start(spark.readStream.schema(schema).parquet(str(batches)), target, STATE, "k", "content", ["tag"], str(tmp_path / "ckpt")).awaitTermination(60)
    run()
    spark.createDataFrame([("a", "2", "x"), ("b", "1", "y")], schema).write.parquet(str(batches), mode="append")
    run()
    assert {(r.k, r.content) for r in target.read(spark, STATE).collect()} == {("a", "2"), ("b", "1")}
    run()
    assert target.read(spark, STATE).count() == 2


def test_stream_takes_its_time_from_the_batch(spark, tmp_path):
    schema = "k string, content string, tag string, at timestamp"
    spark.createDataFrame([("a", "1", "x", dt.datetime(2026, 1, 5))], schema).write.parquet(str(tmp_path / "in"))
    target = ingest.VersionedTable(str(tmp_path / "state"))
    ingest.start(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), target, STATE, "k", "content", ["tag"], str(tmp_path / "ckpt"), seen="at").awaitTermination(60)
    assert target.read(spark, STATE).first().first_seen_at == dt.datetime(2026, 1, 5)


def test_stream_writes_only_the_parts_it_touches(spark, tmp_path):
    schema = "k string, content string, tag string, at timestamp"
    feed, day = tmp_path / "in", lambda n: dt.datetime(2026, 1, n)
    spark.createDataFrame([(f"k{i}", "1", "x", day(1)) for i in range(60)], schema).write.parquet(str(feed))
    target = ingest.VersionedTable(str(tmp_path / "state"), parts=8)
    run = lambda: ingest.start(spark.readStream.schema(schema).parquet(str(feed)), target, STATE, "k", "content", ["tag"], str(tmp_path / "ckpt"), seen="at").awaitTermination(60)
    run()
    assert target.latest(spark) == dict.fromkeys(range(8), 0)
    spark.createDataFrame([("k7", "3", "z", day(3)), ("k7", "2", "y", day(2))], schema).coalesce(1).write.parquet(str(feed), mode="append")
    run()
    assert sorted(target.latest(spark).values()) == [0] * 7 + [1]
    rows = {r.k: r for r in target.read(spark, STATE).collect()}
    assert len(rows) == 60 == target.read(spark, STATE).count()
    assert (rows["k7"].content, rows["k7"].tag, rows["k7"].first_seen_at, rows["k7"].updated_at) == ("3", "z", day(1), day(3))
    assert rows["k8"].content == "1" and target.latest(spark, before=1) == dict.fromkeys(range(8), 0)
    told = ingest.events(spark, target, "k").collect()
    assert len(told) == 61 and [(r.k, r.event_type, r.batch) for r in told if r.batch] == [("k7", "updated", 1)]
    for i in range(4):
        spark.createDataFrame([("k9", f"n{i}", "z", day(4 + i))], schema).coalesce(1).write.parquet(str(feed), mode="append")
        run()
    assert target.batches(spark) == [3, 4, 5] and target.read(spark, STATE).count() == 60
    kept = {p.name for p in (tmp_path / "state").glob("v*")}
    assert kept == {f"v{v}" for b in target.batches(spark) for v in [*target.latest(spark, b + 1).values()]} and ingest.events(spark, target, "k").filter("batch > 1").count() == 4


def test_province_ladder(spark):
    roles = ("a", "b")
    sources = spark.createDataFrame([(f"{p}{r}", p, True) for p in "PQRS" for r in roles] + [("N", None, True)], "source_id string, province string, enabled boolean")
    health = spark.createDataFrame([(f"{p}{r}", "source_active") for p in "PQS" for r in roles] + [("Ra", "source_error"), ("N", "source_active")], "source_id string, status string")
    runs = spark.createDataFrame([(f"{p}{r}", "finished", 2 if p == "Q" and r == "a" else 0) for p in "PQRS" for r in roles], "source_id string, status string, open_matching_count int")
    targets = spark.createDataFrame([(p, r, "verified", f"{p}{r}") for p in "PQR" for r in roles] + [("S", "a", "verified", "Sa")], "province string, role string, state string, source_id string")
    provinces = spark.createDataFrame([(p,) for p in "PQRST"], "province string")
    scans = coverage.source_scans(sources, health, runs)
    nothing = spark.createDataFrame([], "province string")
    rows = coverage.province_coverage(provinces, scans, targets, nothing, spark.createDataFrame([], "province string, source_id string"), roles).collect()
    assert {r.province: r.interpretation for r in rows} == {"P": "no_match_verified", "Q": "matches", "R": "source_unhealthy", "S": "roles_unverified", "T": "no_source"}
    assert [r.province for r in rows if r.no_match_is_verified] == ["P"]


def test_quality_counts(spark):
    schema = "source_id string, location string, province string, country_or_region string, deadline_date string, summary string, description string"
    jobs = spark.createDataFrame([("s", "x", "p", None, "2026-01-01", None, None), ("s", " ", None, "c", None, "Open until filled", None), ("t", None, None, None, None, None, None), ("u", None, None, None, None, None, None)], schema)
    assert tuple(coverage.location_quality(jobs).first()) == (4, 1, 2, 1, 1)
    policies = spark.createDataFrame([("t", "rolling")], "source_id string, deadline_policy string")
    assert tuple(coverage.deadline_quality(jobs, policies, r"(?i)open\s+until\s+filled").first()) == (4, 1, 2, 1)


def test_resilience_parts_declared_from_usable_backups(spark):
    schema = "source_id string, listing_urls array<string>, fallback_entry_urls array<string>, fallback_source_ids array<string>"
    s = spark.createDataFrame([("a", ["x", "y"], None, None), ("b", ["x"], ["e"], ["b", ""]), ("c", None, None, ["a", "a", "gone", "off"]), ("d", ["x"], [], ["d"]), ("off", None, None, ["gone"])], schema)
    states = spark.createDataFrame([("a", None, True), ("b", None, True), ("c", None, True), ("d", None, True), ("off", None, False)], "source_id string, province string, enabled boolean")
    health = spark.createDataFrame([(x, "source_active") for x in ("a", "off")], "source_id string, status string")
    runs = spark.createDataFrame([(x, "finished", 0) for x in ("a", "off")], "source_id string, status string, open_matching_count int")
    scans = coverage.source_scans(states, health, runs)
    rows = {r.source_id: tuple(r)[1:] for r in coverage.backups(s, scans).collect()}
    assert rows == {"a": (True, 1, 0, []), "b": (True, 1, 0, []), "c": (True, 0, 3, ["a"]), "d": (False, 0, 0, []), "off": (True, 0, 1, [])}
    assert tuple(coverage.resilience(s, scans).first()) == (5, 4, 0.8, 1, 0.2)
    assert tuple(coverage.resilience(s.limit(0), scans).first()) == (0, 0, 0.0, 0, 0.0)


def test_a_disabled_source_proves_no_absence(spark):
    """Every role is verified and one of them by a disabled source: its finished scan and good health count for nothing."""
    roles = ("a", "b", "c")
    sources = spark.createDataFrame([("on", "P", True, "a", 5), ("off", None, False, None, None), ("sick", "Q", True, "b", None), ("new", "R", True, "", None)], "source_id string, province string, enabled boolean, source_role string, target_active_sources int")
    health = spark.createDataFrame([("on", "source_active"), ("off", "source_active"), ("sick", "source_blocked"), ("new", "checked_once")], "source_id string, status string")
    runs = spark.createDataFrame([(x, "finished", 0) for x in ("on", "off", "sick", "new")], "source_id string, status string, open_matching_count int")
    targets = spark.createDataFrame(
        [("P", r, "verified", "off" if r == "b" else "on") for r in roles] + [("Q", "a", "verified", "nowhere"), ("Q", "b", "blocked", None), ("R", "z", "verified", "on")], "province string, role string, state string, source_id string"
    )
    fallbacks = spark.createDataFrame([("Q", "on"), ("Q", "on"), ("Q", "off"), ("Q", "nowhere")], "province string, source_id string")
    provinces = spark.createDataFrame([(x,) for x in "PQRS"], "province string")
    jobs = spark.createDataFrame([("P",), ("P",)], "province string")
    got = {r.province: r for r in coverage.province_coverage(provinces, coverage.source_scans(sources, health, runs), targets, jobs, fallbacks, roles).collect()}
    p, q, r, s = (got[x] for x in "PQRS")
    assert (p.no_match_is_verified, p.interpretation, p.roles_without_scan, p.missing_target_roles, p.jobs) == (False, "role_scan_missing", ["b"], [], 2)
    assert (p.active_sources, p.accessible, p.target_active_sources, p.registered_roles, p.missing_source_roles) == (1, 1, 5, ["a"], ["b", "c"])
    assert (q.interpretation, q.unready_source_ids, q.target_states, q.missing_target_roles) == ("source_unhealthy", ["sick"], {"a": "candidate", "b": "blocked", "c": "unlocated"}, list(roles))
    assert (q.fallback_sources, q.fallback_active, q.fallback_source_ids, q.effective_active_sources, q.health_statuses) == (2, 1, ["off", "on"], 1, {"source_blocked": 1})
    assert (r.interpretation, r.unready, r.unhealthy, r.accessible_or_scanned, r.target_active_sources) == ("scan_missing", 1, 0, 1, 3)
    assert (s.interpretation, s.registered, s.health_statuses, s.unready_source_ids) == ("no_source", 0, {}, [])


def test_null_and_repeated_keys(spark):
    s = spark.createDataFrame([(None, "old", 1), ("a", "old", 1)], "k string, v string, made int")
    n = spark.createDataFrame([(None, "new", 2)], s.schema)
    assert {tuple(r) for r in changes.upsert(s, n, "k", ["made"]).collect()} == {(None, "new", 1), ("a", "old", 1)}
    again = spark.createDataFrame([("b", "x", 1), ("b", "y", 1), ("a", "z", 1)], s.schema)
    assert sorted(r.k or "" for r in changes.insert_absent(s, again, "k").collect()) == ["", "a", "b"]


def test_alias_blocks_agree_with_one(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    t = spark.createDataFrame([(i, "中国石油勘探院" + "北京" * (i % 3)) for i in range(5)] + [(9, None), (10, "")], "id int, t string")
    a = spark.createDataFrame([("中国石油", 0), ("中国石油勘探院", 1), ("勘探院北京", 2), ("", 3), ("石油勘探院北京", 5), ("油勘探院北京北", 4)], "alias string, ord int")
    found = [sorted(tuple(r) for r in listing.longest_containing(t, "t", a, "alias", ["id"], "ord", block).collect()) for block in (100, 2)]
    assert found[0] == found[1] == [(0, "中国石油勘探院", 1), (1, "中国石油勘探院", 1), (2, "中国石油勘探院", 1), (3, "中国石油勘探院", 1), (4, "中国石油勘探院", 1)]


def test_runs_start_and_finish_once(spark):
    runs = spark.createDataFrame([], "id int, source_id string, started_at timestamp, finished_at timestamp, status string, inserted_count int, error_message string")
    runs = store.started(runs, spark.createDataFrame([(1, "s"), (2, "t")], "id int, source_id string"), NOW)
    assert [r.status for r in runs.collect()] == ["running"] * 2
    one = spark.createDataFrame([(1, "finished", 3, None)], "id int, status string, inserted_count int, error_message string")
    runs = store.finished(runs, one, LATER)
    again = store.finished(runs, one.withColumn("inserted_count", F.lit(9)), LATER)
    assert sorted((r.id, r.status, r.inserted_count, r.finished_at is None) for r in again.collect()) == [(1, "finished", 3, False), (2, "running", None, True)]
    sources = spark.createDataFrame([("s", "Source", True)], "id string, name string, enabled boolean")
    assert [(r.id, r.source_name) for r in store.stale_runs(again, sources, LATER).collect()] == [(2, None)] and store.stale_runs(again, sources, LATER, enabled_only=True).count() == 0


def test_small_updates(spark):
    beats = spark.createDataFrame([("w", "ok", "x" * 900, "t2"), ("v", "ok", None, "t2")], "service_name string, status string, detail string, updated_at string")
    state = store.heartbeat(beats.limit(0), beats)
    assert {(r.service_name, len(r.detail or "")) for r in store.heartbeat(state, beats.filter("service_name = 'w'")).collect()} == {("w", 500), ("v", 0)}
    reports = spark.createDataFrame([("d1", "p", "pending", None), ("d2", "q", "pending", None)], "report_date string, payload string, delivery_status string, delivery_error string")
    done = store.delivered(reports, spark.createDataFrame([("d1", "failed", "no route")], "report_date string, delivery_status string, delivery_error string"))
    assert {tuple(r) for r in done.collect()} == {("d1", "p", "failed", "no route"), ("d2", "q", "pending", None)}
    s = spark.createDataFrame([("a", None, None), ("b", None, None)], "id string, last_synced_at timestamp, updated_at timestamp")
    assert {(r.id, r.last_synced_at is not None) for r in store.synced(s, s.filter("id = 'a'"), NOW).collect()} == {("a", True), ("b", False)}
    assert store.find(s, "id", "b").count() == 1 and [r.id for r in store.listed(s, F.desc("id")).collect()] == ["b", "a"] and store.newest(s, "id", 0).first().id == "b"
    assert [store.clamped(x, 1, 100, 40) for x in (None, 0, 7, 900)] == [40, 1, 7, 100]
    d = spark.createDataFrame([("blocked by robots.txt",), ("other",), (None,)], "d string")
    assert [r[0] for r in d.select(store.skipped_status(F.col("d"))).collect()] == ["source_blocked", "source_degraded", "source_degraded"]


def test_collected_by_kind(spark):
    s = spark.createDataFrame([("a", "feed"), ("b", "manual")], "id string, source_type string")
    read = {"feed": lambda x: x.select("id", F.lit("t").alias("title"))}
    assert [tuple(r) for r in store.collected(spark, s, read, "id string, title string").collect()] == [("a", "t")]
    try:
        store.collected(spark, s.withColumn("source_type", F.lit("odd")), read, "id string, title string")
        raise AssertionError
    except ValueError as e:
        assert "odd" in str(e)


def test_cards_and_membership(spark):
    j = spark.createDataFrame([(1, None, None), (2, "x", ["a"])], "id int, title string, degrees array<string>")
    assert [tuple(r) for r in listing.cards(j, ["title"], ["degrees"]).orderBy("id").collect()] == [(1, "", []), (2, "x", ["a"])]
    assert [r.id for r in listing.facet(j, [listing.has("degrees", "a"), listing.has("degrees", None)]).collect()] == [2]


def test_coverage_report_sections(spark):
    sources = spark.createDataFrame([("a", "P", True), ("b", "P", True), ("c", None, False)], "source_id string, province string, enabled boolean")
    health = spark.createDataFrame([("a", "source_active")], "source_id string, status string")
    runs = spark.createDataFrame([("a", "finished", 1), ("b", "failed", 0)], "source_id string, status string, open_matching_count int")
    job = "source_id string, category string, official_evidence_url string, major_tags array<string>, location string, province string, country_or_region string, deadline_date string, summary string, description string"
    jobs = spark.createDataFrame([("a", "x", "https://a", ["t"], "P", "P", None, "2026-01-01", None, None), ("a", "y", None, [], None, None, None, None, None, None)], job)
    policies = spark.createDataFrame([("a", "rolling")], "source_id string, deadline_policy string")
    targets = spark.createDataFrame([("P", "r", "verified", None)], "province string, role string, state string, source_id string")
    names = lambda *x, c: spark.createDataFrame([(n,) for n in x], f"{c} string")
    snapshots = spark.createDataFrame([("2026-01-01", 5, 0, 0, 1), ("2026-01-02", 9, 9, 9, 9)], "snapshot_date string, open_jobs long, successful_scan_sources long, sources_with_open_matches long, explicit_matches long")
    explicit = spark.createDataFrame([(3,)], "explicit_matches long")
    got = coverage.report(sources, health, runs, jobs, policies, targets, spark.createDataFrame([], "province string, source_id string"), names("P", "Q", c="province"), names("x", "z", c="category"), explicit, snapshots, F.lit("2026-01-02"), ("r",), "rolling")
    first = {k: v.first() for k, v in got.items()}
    assert tuple(first["scan_quality"]) == (2, 1, 1) and {tuple(r) for r in got["health"].collect()} == {("source_active", 1), ("unknown", 2)}
    assert {r.source_id for r in got["without_health"].collect()} == {"b", "c"} and first["target_states"].candidate == 1
    assert tuple(first["trend"]) == (True, "2026-01-01", -3, 1, 1, 2)
    assert {(r.category, r.total, r.source_count, r.risk) for r in got["category_sources"].collect()} == {("x", 1, 1, "high"), ("z", 0, 0, "no_data")}
    gate = first["quality_gate"]
    assert gate.status == "needs_attention" and gate.failed_checks == ["official_evidence_url_complete", "major_tags_at_least_90_percent", "normalized_location_at_least_90_percent", "source_concentration_below_50_percent"]
    assert coverage.target_active(spark.createDataFrame([], "target_active_sources int")).first()[0] == 3
    assert coverage.distinct_sources((sources, "source_id"), (policies, "source_id")).first()[0] == 3


def test_the_report_reads_the_jobs_once(spark, tmp_path):
    """Every number of the cube equals that of its own pass over the jobs, and its plan has one scan of them."""
    import random

    rng = random.Random(6)
    pick = lambda *x: rng.choice(x)
    rows = [(pick("a", "b", "c", None), pick("x", "y", None), pick("https://e", " ", None), pick(["t"], [], None), pick("P", " ", None), pick("P", "Q", "", None), pick("c", None), pick("2026-01-01", None), pick("open until filled", None), pick("rolling", "d", None)) for _ in range(300)]
    schema = "source_id string, category string, official_evidence_url string, major_tags array<string>, location string, province string, country_or_region string, deadline_date string, summary string, description string"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(str(tmp_path / "jobs"))
    jobs = spark.read.parquet(str(tmp_path / "jobs"))
    policies = spark.createDataFrame([("a", "rolling"), ("b", " ")], "source_id string, deadline_policy string")
    cube = coverage.job_cube(jobs, policies, "until filled|rolling")
    assert cube._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
    whole = coverage.cut(cube, "all").first()
    assert tuple(coverage.location_quality(jobs).first()) == tuple(whole[c] for c in ("total", "raw_location", "normalized_region", "province_known", "elsewhere"))
    assert tuple(coverage.deadline_quality(jobs, policies, "until filled|rolling").first()) == tuple(whole[c] for c in ("total", "explicit", "policy", "unstated"))
    assert whole.evidence == sum(bool((r[2] or "").strip()) for r in rows) and whole.tagged == sum(bool(r[3]) for r in rows)
    one = jobs.withColumn("g", F.lit(0))
    for name, key, missing in (("source", "source_id", "unknown"), ("category", "category", "unclassified")):
        assert tuple(coverage.top_share(coverage.cut(cube, name), key, missing).first()) == tuple(listing.concentration(one, ["g"], key, missing).drop("g").select("top_key", "top_count", "total", "share", "risk").first())
    assert {(r.province, r.total) for r in coverage.cut(cube, "province").collect()} == {(p, sum(r[5] == p for r in rows)) for p in ("P", "Q", "", None)}
    names = spark.createDataFrame([("x",), ("y",), ("z",)], "category string")
    pairs = coverage.cut(cube, "category_source").filter("category IS NOT NULL")
    assert {tuple(r) for r in coverage.category_sources(pairs, names, weight="total").collect()} == {tuple(r) for r in coverage.category_sources(jobs, names).collect()}
    empty = coverage.job_cube(jobs.limit(0), policies, "x")
    assert coverage.cut(empty, "all").first().total == 0 and coverage.top_share(coverage.cut(empty, "source"), "source_id", "unknown").count() == 0


def test_issues_say_what_is_wrong_and_duplicates_name_their_jobs(spark):
    from brightloom.operators import audit

    schema = "id long, source_id string, verification_status string, official_evidence_url string, source_url string, title string, summary string, description string, relevance_score int, status string, deadline_date string"
    good = (1, "s", "published_official", "https://e", "https://h.org/1", "t", "", "d", 50, "open", "2099-01-01")
    change = lambda **k: tuple(k.get(c.split()[0], v) for c, v in zip(schema.split(", "), good, strict=True))
    rows = [good, change(id=2, source_url="https://x.org/1"), change(id=3, source_url="https://h.org/3", title="a closed list"), change(id=4, source_url="https://h.org/1"), change(id=5, source_url="https://h.org/5", deadline_date="soon"), change(id=6, source_url="https://h.org/6", relevance_score=3), change(id=7, source_id="gone"), change(id=8, source_url=None)]
    jobs = spark.createDataFrame(rows, schema)
    sources = spark.createDataFrame([("s", "html", True, "https://h.org", None, "10", False)], "id string, source_type string, enabled boolean, homepage_url string, allowed_hosts array<string>, minimum_relevance string, allow_shared_urls boolean")
    runs = spark.createDataFrame([(70, "s", "running", "2026-01-01")], "id long, source_id string, status string, started_at string")
    found = audit.audit(jobs, sources, runs, F.lit("2026-09-18").cast("date"), F.lit("2026-02-01"), ["closed"], ["interview"])
    got = {(r.code, r.job_id, r.message) for r in found.collect()}
    assert got == {
        ("source_host_mismatch", 2, "the host x.org is none of the source's"), ("forbidden_notice_text", 3, "title or summary has closed"), ("invalid_deadline", 5, "the deadline soon is no date"), ("below_source_threshold", 6, "a relevance of 3 is below the source's minimum"),
        ("unknown_source", 7, "the job names a source that is not registered"), ("invalid_source_url", 8, "the source address is no http address"), ("duplicate_source_url", None, "2 jobs have the address https://h.org/1"), ("stale_crawl_run", None, "a run that never ended, 70"),
    }
    assert sorted((r.source_url, r.n, r.job_id) for r in audit.duplicate_jobs(jobs, sources).collect()) == [("https://h.org/1", 2, 1), ("https://h.org/1", 2, 4)]
    one = audit.overview(found, jobs, sources, F.lit("2026-09-18")).first()
    assert (one.ok, one.checked_jobs, one.open_jobs, one.registered_sources, one.enabled_sources, one.issues) == (False, 8, 8, 1, 1, 8)
    assert audit.overview(found.limit(0), jobs, sources, F.lit("x")).first().ok


def test_a_cohort_is_summed_up(spark):
    from brightloom.operators import cohort

    r = spark.createDataFrame([(1, "b", 9), (1, "a", 1), (2, "c", 9), (9, "", 9), (9, None, 1)], "r int, c string, s int")
    s = cohort.simulate(r, {"p": 3, "q": 2, "z": 1}, {"p": F.col("r") == 1, "q": F.lit(False), "z": F.lit(False)}, F.col("s") > 5, "c")
    rows = {x.profile: x for x in s.collect()}
    assert (rows["p"].explicit, rows["p"].review, rows["p"].categories, rows["p"].weighted) == (2, 2, ["a", "b", "c"], 6)
    assert (rows["q"].explicit, rows["q"].review, rows["q"].categories) == (0, 3, ["b", "c"])
    assert tuple(cohort.summary(s).first()) == (6, 3, 3, 0, 2, 8, 6) and tuple(cohort.summary(s.limit(0)).first()) == (0,) * 7
    none = cohort.simulate(r.limit(0), {"p": 3}, {"p": F.lit(True)}, F.lit(True), "c")
    assert tuple(cohort.summary(none).first()) == (3, 0, 0, 3, 0, 0, 0)
    people = cohort.by_member(cohort.members(spark, {"p": 3, "q": 2}), s).collect()
    assert len(people) == 5 and all(x.has_recommendation for x in people) and {x.explicit for x in people if x.profile == "p"} == {2}


def test_long_records_are_made_by_all_tasks(spark, tmp_path):
    from brightloom.plans import features

    parts = spark.range(120).select(F.col("id").alias("p_partkey"), F.lit("red ring").alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("SMALL").alias("p_type"), (F.col("id") % 50).cast("int").alias("p_size"), F.lit(1.0).alias("p_retailprice"))
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    made = features._parts(spark, str(tmp_path)).select(F.spark_partition_id().alias("task"), F.length("text").alias("n")).groupBy("task").agg(F.max("n").alias("n")).collect()
    assert len(made) == int(spark.conf.get("spark.sql.shuffle.partitions")) and min(r.n for r in made) > 15_000
    want = {}
    for k in range(120):
        outcome = "created" if k % 11 == 0 else "absent" if k % 13 == 0 else "updated" if k % 5 == 0 or k % 7 == 0 else "unchanged"
        n, events = want.get(outcome, (0, 0))
        want[outcome] = (n + 1, events + (outcome in ("created", "updated")))
    assert {r.outcome: (r.n, r.events) for r in features.edited_records(spark, str(tmp_path)).collect()} == want
