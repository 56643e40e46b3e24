"""Coverage: trends, quality gates, interpretations that don't take absence for proof."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom import storage


def trend(daily: DataFrame, day: str, metric: str) -> DataFrame:
    """Adds change, against the day before in the table. The input has one row per day, so one window holds it."""
    return daily.withColumn("change", F.col(metric) - F.lag(metric).over(Window.orderBy(day)))


def baseline(snapshots: DataFrame, day: str, today: Column, strictly_before: bool = False) -> DataFrame:
    """The newest snapshot of another day, or of an earlier one."""
    other = F.col(day) < today if strictly_before else F.col(day) != today
    return snapshots.filter(other).orderBy(F.desc(day)).limit(1)


def gate(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """One row with every check, an unknown one being false, and whether all passed."""
    one = df.agg(*[F.coalesce(c, F.lit(False)).alias(k) for k, c in checks.items()])
    return one.withColumn("passed", reduce(and_, [F.col(k) for k in checks]))


def scan_outcome(status: Column, matches: Column) -> Column:
    return F.when(status.isNull(), "not_scanned").when(status == "failed", "failed").when(status == "skipped", "skipped").when(status != "finished", "unfinished").when(matches > 0, "with_matches").otherwise("no_matches")


def no_match_is_verified(roles_complete: Column, bound_enabled: Column, scans_finished: Column, healthy: Column) -> Column:
    """Zero results count as verified only if all four hold; unknown does not hold."""
    return reduce(and_, [F.coalesce(c, F.lit(False)) for c in (roles_complete, bound_enabled, scans_finished, healthy)])


def target_states(grid: DataFrame) -> DataFrame:
    """Missing targets are unlocated; verified ones without a source are candidates."""
    state = F.coalesce("state", F.lit("unlocated"))
    return grid.withColumn("state", F.when((state == "verified") & F.col("source_id").isNull(), "candidate").otherwise(state))


def health_status(code: Column, text: Column, keeps_path: Column, soft_missing: str = "(?i)page not found|页面不存在|您访问的页面") -> Column:
    """The status of a probed source by its response."""
    return (
        F.when(code.isin(401, 403, 412, 429), "source_blocked").when(code == 404, "source_degraded").when((code < 200) | (code >= 400) | code.isNull(), "source_error")
        .when(text.rlike(soft_missing), "source_degraded").when(~F.coalesce(keeps_path, F.lit(True)), "source_degraded").otherwise("source_active")
    )


def location_quality(jobs: DataFrame) -> DataFrame:
    """One row: jobs, with a raw location, with a normal region, with a province, elsewhere only."""
    given = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return jobs.agg(
        F.count("*").alias("total"), F.count_if(given("location")).alias("raw_location"), F.count_if(given("province") | given("country_or_region")).alias("normalized_region"),
        F.count_if(given("province")).alias("province_known"), F.count_if(given("country_or_region") & ~given("province")).alias("elsewhere"),
    )


def deadline_quality(jobs: DataFrame, sources: DataFrame, open_ended: str) -> DataFrame:
    """One row: jobs with an explicit deadline, with a source policy or open-ended words, and with neither.

    sources: source_id and deadline_policy, one row each; open_ended: a pattern of phrases of postings without an end.
    """
    policies = sources.select("source_id", F.col("deadline_policy").alias("__policy"))
    given = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    words = F.concat_ws(" ", "summary", "description")
    kind = F.when(given(F.col("deadline_date").cast("string")), "explicit").when(given("__policy") | words.rlike(open_ended), "policy").otherwise("unstated")
    kinds = jobs.join(policies, "source_id", "left").select(kind.alias("kind"))
    return kinds.agg(F.count("*").alias("total"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("explicit", "policy", "unstated")])


#: The states of a source's health that speak for it, and against it; any other is unknown.
HEALTHY = ("source_active",)
UNHEALTHY = ("source_degraded", "source_blocked", "source_error")
TARGETED = 3


def source_scans(sources: DataFrame, health: DataFrame, latest_runs: DataFrame) -> DataFrame:
    """Per source: enabled, healthy (null if its health is unknown), finished, usable (enabled, healthy and its latest run finished) and matches of a usable one.

    sources: source_id, province, enabled, and if they have them source_role and target_active_sources; health: source_id, status;
    latest_runs: source_id, status, open_matching_count.
    """
    h = health.select("source_id", F.col("status").alias("__health"))
    r = latest_runs.select("source_id", F.col("status").alias("__run"), F.col("open_matching_count").alias("__matches"))
    s = sources.join(h, "source_id", "left").join(r, "source_id", "left")
    on = F.coalesce("enabled", F.lit(False))
    healthy = F.when(F.col("__health").isin(*HEALTHY), True).when(F.col("__health").isin(*UNHEALTHY), False)
    finished = F.coalesce(F.col("__run") == "finished", F.lit(False))
    usable = on & F.coalesce(healthy, F.lit(False)) & finished
    optional = [F.col(c) if c in sources.columns else F.lit(None).cast(t).alias(c) for c, t in (("source_role", "string"), ("target_active_sources", "int"))]
    return s.select(
        "source_id", "province", on.alias("enabled"), healthy.alias("healthy"), F.coalesce("__health", F.lit("unknown")).alias("health"), finished.alias("finished"), usable.alias("usable"),
        F.when(usable, F.coalesce("__matches", F.lit(0))).alias("matches"), *optional,
    )


#: What a province's numbers may be said to show, in order; the first that holds is given. Absence is proof only in one case.
LADDER = (
    ("no_source", "registered = 0"),
    ("matches", "with_matches > 0"),
    ("source_unhealthy", "unhealthy > 0"),
    ("scan_missing", "unready > 0"),
    ("roles_unverified", "NOT roles_verified"),
    ("role_scan_missing", "roles_unscanned > 0"),
    ("jobs_from_elsewhere", "jobs > 0"),
    ("fallback_matches", "fallback_matches > 0"),
    ("no_match_verified", "no_match_is_verified"),
    ("no_match_in_scanned", "without_matches > 0"),
)


def province_coverage(provinces: DataFrame, scans: DataFrame, targets: DataFrame, jobs: DataFrame, fallbacks: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """One row for every province of the dimension, whether or not anything is known of it: its numbers, ids and roles, and what they may be said to show.

    scans: of source_scans; targets: province, role, state, source_id; jobs: province of each open job, or province and jobs, their number;
    fallbacks: province, source_id of national sources that stand in; those not registered don't count. A verified target whose source is
    not registered is a candidate. What no source or target speaks of is missing.
    """
    on = F.col("enabled")
    accessible = F.coalesce("healthy", F.lit(False))
    ids = lambda test: F.array_sort(F.collect_set(F.when(test, F.col("source_id").cast("string"))))
    health = scans.groupBy("province", "health").agg(F.count("*").alias("n"))
    health = health.groupBy("province").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("health", "n")))).alias("health_statuses"))
    local = scans.groupBy("province").agg(
        F.count("*").alias("registered"), F.count_if(on).alias("enabled_sources"), F.count_if("usable").alias("active_sources"), F.count_if(on & accessible).alias("accessible"), F.count_if(on & F.col("finished")).alias("completed_scans"),
        F.count_if(on & (accessible | F.col("finished"))).alias("accessible_or_scanned"), F.count_if(F.col("matches") > 0).alias("with_matches"), F.count_if(F.col("matches") == 0).alias("without_matches"),
        F.count_if(on & ~F.col("usable")).alias("unready"), F.count_if(on & ~F.col("healthy")).alias("unhealthy"), ids(on & ~F.col("usable")).alias("unready_source_ids"),
        F.max("target_active_sources").alias("target_active_sources"), F.array_sort(F.collect_set(F.when(F.col("source_role") != "", F.col("source_role")))).alias("registered_roles"),
    )
    known = scans.select(F.col("source_id").alias("__id"), F.col("usable").alias("__usable"))
    t = targets.filter(F.col("role").isin(*roles)).join(known, F.col("source_id") == F.col("__id"), "left")
    state = F.when((F.col("state") == "verified") & F.col("__id").isNull(), "candidate").otherwise(F.coalesce("state", F.lit("unlocated")))
    t = t.withColumn("state", state).groupBy("province", "role").agg(F.max_by("state", F.col("state") == "verified").alias("state"), F.max("__usable").alias("__usable"))
    verified = F.col("state") == "verified"
    bound = t.groupBy("province").agg(
        F.count_if(verified).alias("verified_roles"), F.count_if(verified & ~F.col("__usable")).alias("roles_unscanned"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "state")))).alias("__states"),
        F.collect_set(F.when(verified, F.col("role"))).alias("__verified"), F.collect_set(F.when(verified & ~F.col("__usable"), F.col("role"))).alias("__unscanned"),
    )
    stand_in = fallbacks.select("province", "source_id").distinct().join(scans.select("source_id", "usable", "matches"), "source_id").groupBy("province").agg(
        F.count("*").alias("fallback_sources"), F.count_if("usable").alias("fallback_active"), F.count_if(F.col("matches") > 0).alias("fallback_matches"), ids(F.lit(True)).alias("fallback_source_ids")
    )
    open_jobs = jobs.select("province", "jobs") if "jobs" in jobs.columns else jobs.groupBy("province").agg(F.count("*").alias("jobs"))
    p = provinces.select("province")
    for part in (local, bound, stand_in, open_jobs, health):
        p = p.join(part, "province", "left")
    p = p.withColumn("target_active_sources", F.coalesce("target_active_sources", F.lit(TARGETED))).na.fill(0)
    none = F.array().cast("array<string>")
    lists = ("unready_source_ids", "registered_roles", "fallback_source_ids", "__verified", "__unscanned")
    p = p.withColumns({c: F.coalesce(c, none) for c in lists})
    wanted = F.array(*[F.lit(r) for r in roles])
    empty = F.create_map().cast("map<string,string>")
    p = p.withColumns(
        {
            "missing_source_roles": F.array_except(wanted, "registered_roles"), "missing_target_roles": F.array_except(wanted, "__verified"), "roles_without_scan": F.array_intersect(wanted, "__unscanned"),
            "target_states": F.map_from_arrays(wanted, F.transform(wanted, lambda r: F.coalesce(F.try_element_at(F.coalesce("__states", empty), r), F.lit("unlocated")))), "target_count": F.lit(len(roles)),
            "effective_active_sources": F.col("active_sources") + F.col("fallback_active"), "roles_verified": F.col("verified_roles") == len(roles), "all_scanned": (F.col("enabled_sources") > 0) & (F.col("unready") == 0),
            "health_statuses": F.coalesce("health_statuses", F.create_map().cast("map<string,bigint>")),
        }
    ).drop("__states", "__verified", "__unscanned")
    p = p.withColumn("no_match_is_verified", no_match_is_verified(F.col("roles_verified"), F.col("all_scanned"), F.col("roles_unscanned") == 0, F.col("with_matches") == 0))
    chain = None
    for name, condition in LADDER:
        chain = F.when(F.expr(condition), name) if chain is None else chain.when(F.expr(condition), name)
    return p.withColumn("interpretation", chain.otherwise("not_scanned"))


def backups(sources: DataFrame, scans: DataFrame) -> DataFrame:
    """Per source: has_backup, how many entry addresses and sources stand by, and which of these sources are usable now.

    sources: source_id, listing_urls, fallback_entry_urls, fallback_source_ids (arrays); an address beside the first listing, an entry, or another source is a
    backup, whether or not that source is registered; usable are registered ones with a usable scan (source_scans).
    """
    size = lambda c: F.coalesce(F.size(F.filter(c, lambda x: x.isNotNull())), F.lit(0))
    key = F.col("source_id").cast("string")
    others = F.array_sort(F.array_distinct(F.filter(F.coalesce("fallback_source_ids", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "") & (x != key))))
    s = sources.select("source_id", others.alias("__others"), (size("fallback_entry_urls") + F.greatest(size("listing_urls") - 1, F.lit(0))).alias("backup_entry_count"))
    named = s.select("source_id", F.explode("__others").alias("__id"))
    usable = named.join(scans.filter("usable").select(F.col("source_id").cast("string").alias("__id")), "__id").groupBy("source_id").agg(F.array_sort(F.collect_set("__id")).alias("usable_fallback_source_ids"))
    s = s.join(usable, "source_id", "left").withColumn("backup_source_count", F.size("__others"))
    return s.select(
        "source_id", ((F.col("backup_entry_count") > 0) | (F.col("backup_source_count") > 0)).alias("has_backup"), "backup_entry_count", "backup_source_count",
        F.coalesce("usable_fallback_source_ids", F.array().cast("array<string>")).alias("usable_fallback_source_ids"),
    )


def resilience(sources: DataFrame, scans: DataFrame) -> DataFrame:
    """One row over all sources: how many have a declared backup, how many a fallback source that is usable now, and both rates to four places."""
    rate = lambda n: F.coalesce(F.round(F.try_divide(n, F.count("*")), 4), F.lit(0.0))
    has, usable = F.count_if("has_backup"), F.count_if(F.size("usable_fallback_source_ids") > 0)
    return backups(sources, scans).agg(
        F.count("*").alias("registered_sources"), has.alias("sources_with_backup"), rate(has).alias("coverage_rate"),
        usable.alias("sources_with_usable_fallback_source"), rate(usable).alias("usable_fallback_source_coverage_rate"),
    )


def without_health(sources: DataFrame, health: DataFrame, key: str = "source_id") -> DataFrame:
    """The keys of sources that no health record has."""
    return sources.select(key).join(health.select(key), key, "left_anti")


def category_sources(jobs: DataFrame, categories: DataFrame, category: str = "category", source: str = "source_id", weight: str | None = None) -> DataFrame:
    """One row for every category of the dimension: its jobs, distinct sources, and its largest source with share and risk. weight: a column of how many jobs a row stands for."""
    from .listing import concentration

    top = concentration(jobs.filter(F.col(category).isNotNull()), [category], source, weight=weight)
    n = jobs.groupBy(category).agg(F.count_distinct(F.coalesce(source, F.lit("unknown"))).alias("source_count"))
    found = categories.select(category).join(top, category, "left").join(n, category, "left")
    return found.na.fill(0, ["top_count", "total", "share", "source_count"]).na.fill("no_data", ["risk"])


def scan_quality(sources: DataFrame, health: DataFrame, latest_runs: DataFrame, healthy: tuple[str, ...] = ("source_active",)) -> tuple[DataFrame, DataFrame]:
    """(one row of counts, outcomes with their numbers) over the latest runs of enabled sources.

    A scan succeeded if its run finished and its source is healthy; unknown health is not healthy.
    """
    on = sources.filter("enabled").select("source_id").join(latest_runs.select("source_id", "status", "open_matching_count"), "source_id")
    h = health.select("source_id", F.col("status").isin(*healthy).alias("__healthy"))
    r = on.join(h, "source_id", "left").withColumn("__good", (F.col("status") == "finished") & F.coalesce("__healthy", F.lit(False)))
    matches = F.coalesce("open_matching_count", F.lit(0)) > 0
    counts = r.agg(F.count("*").alias("sources_with_latest_run"), F.count_if(F.col("__good")).alias("successful_scan_sources"), F.count_if(F.col("__good") & matches).alias("sources_with_open_matches"))
    outcome = F.when(F.col("status") != "finished", F.col("status")).when(matches, "successful_with_open_matches").otherwise("successful_without_open_matches")
    return counts, r.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def health_distribution(sources: DataFrame, health: DataFrame) -> DataFrame:
    """(status, n) over all sources, those without record as unknown."""
    s = sources.select("source_id").join(health.select("source_id", "status"), "source_id", "left")
    return s.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


def state_totals(grid: DataFrame, states: tuple[str, ...] = ("verified", "candidate", "unlocated", "blocked")) -> DataFrame:
    """One row with the number of targets in each state."""
    return grid.agg(*[F.count_if(F.col("state") == s).alias(s) for s in states])


def distinct_sources(*columns: tuple[DataFrame, str]) -> DataFrame:
    """One row: how many distinct sources the columns name together."""
    every = reduce(DataFrame.unionAll, [df.select(F.col(c).alias("source_id")) for df, c in columns])
    return every.agg(F.count_distinct("source_id").alias("sources"))


def target_active(targets: DataFrame, column: str = "target_active_sources", default: int = 3) -> DataFrame:
    return targets.agg(F.coalesce(F.max(column), F.lit(default)).alias(column))


def asof(asked: DataFrame, facts: DataFrame, time: str, keys: list[str], values: list[str], order: str | None = None, strictly_before: bool = True) -> DataFrame:
    """Each asked row with the values of its keys' last fact before its time (or at it): one union, one shuffle by keys and one window, no join.

    Of facts at one time the last by `order` counts; without one the values are null. Keys and time are columns of both. Null keys are keys; a
    null time has no fact before it. Without keys all rows are sorted in one task: for tables of one row a day. The column `fact_time` is the fact's own.
    """
    own = [c for c in asked.columns if c not in (*keys, time)]
    held = F.struct(F.col(time).alias("fact_time"), *[F.col(v) for v in values])
    place = F.struct(F.col(order).alias("o")) if order else F.struct(F.lit(0).alias("o"))
    kind = held_type(facts, time, values)
    a = asked.select(*keys, time, F.struct(*own).alias("__own") if own else F.lit(True).alias("__own"), F.lit(None).cast(kind).alias("__fact"), F.lit(0 if strictly_before else 1).alias("__late"), F.lit(None).cast(facts.select(place.alias("p")).schema["p"].dataType).alias("__place"))
    b = facts.filter(F.col(time).isNotNull()).select(*keys, time, F.lit(None).cast(a.schema["__own"].dataType).alias("__own"), held.cast(kind).alias("__fact"), F.lit(1 if strictly_before else 0).alias("__late"), place.alias("__place"))
    w = Window.partitionBy(*keys).orderBy(F.col(time).asc_nulls_first(), "__late", "__place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = a.withColumn("__asked", F.lit(True)).unionByName(b.withColumn("__asked", F.lit(False))).withColumn("__last", F.last("__fact", ignorenulls=True).over(w)).filter("__asked")
    return found.select(*[F.col("__own")[c].alias(c) if c in own else F.col(c) for c in asked.columns], *[F.col("__last")[c].alias(c) for c in ("fact_time", *values)])


def held_type(facts: DataFrame, time: str, values: list[str]) -> T.StructType:
    return T.StructType([T.StructField("fact_time", facts.schema[time].dataType), *[T.StructField(v, facts.schema[v].dataType) for v in values]])


def daily_changes(snapshots: DataFrame, day: str, metrics: list[str], maps: list[str] = (), shares: list[str] = ()) -> DataFrame:
    """Every snapshot with its baseline, the snapshot of the last day before it: available, baseline_day, and each metric's change.

    snapshots: one row a day. A baseline's missing metric counts as zero. shares change by four places. maps: columns of name to number, by profile
    for instance; a name that one of the two lacks counts as zero there. Nothing has changed where there is no baseline: changes are null.
    """
    found = asof(snapshots, snapshots.select(day, *[F.col(c).alias(f"__{c}") for c in (*metrics, *maps, *shares)]), day, [], [f"__{c}" for c in (*metrics, *maps, *shares)])
    known = F.col("fact_time").isNotNull()
    minus = lambda a, b: F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0))
    moved = [F.when(known, minus(F.col(m), F.col(f"__{m}"))).alias(f"{m}_change") for m in metrics]
    moved += [F.when(known, F.round(minus(F.col(m), F.col(f"__{m}")), 4)).alias(f"{m}_change") for m in shares]
    empty = lambda c: F.coalesce(F.col(c), F.create_map().cast(snapshots.schema[c.removeprefix("__")].dataType))
    moved += [F.when(known, F.map_zip_with(empty(m), empty(f"__{m}"), lambda _, a, b: minus(a, b))).alias(f"{m}_change") for m in maps]
    return found.select(*snapshots.columns, known.alias("available"), F.col("fact_time").alias("baseline_day"), *moved)


def metric_trend(current: DataFrame, snapshots: DataFrame, day: str, today: Column, metrics: list[str], strictly_before: bool = False) -> DataFrame:
    """One row: whether there is an earlier snapshot, its day, and each metric's change against it (null without one)."""
    old = baseline(snapshots, day, today, strictly_before).select(F.col(day).alias("baseline_day"), *[F.col(m).alias(f"__{m}") for m in metrics])
    j = current.join(old, F.lit(True), "left")  # one row against one at most
    return j.select(F.col("baseline_day").isNotNull().alias("available"), "baseline_day", *[(F.col(m) - F.col(f"__{m}")).alias(f"{m}_change") for m in metrics])


#: The eight checks over the sections' numbers; what is unknown does not pass.
QUALITY_CHECKS = (
    ("official_evidence_url_complete", "evidence_rate = 1.0"),
    ("major_tags_at_least_90_percent", "tags_rate >= 0.9"),
    ("normalized_location_at_least_90_percent", "region_rate >= 0.9"),
    ("deadline_explicit_or_policy_at_least_80_percent", "deadline_rate >= 0.8"),
    ("explicit_profile_match_exists", "explicit_matches > 0"),
    ("source_concentration_below_50_percent", "source_share < 0.5"),
    ("category_concentration_below_70_percent", "category_share < 0.7"),
    ("no_province_marked_verified_during_source_failure", "verified_in_failure = 0"),
)


def quality_gate(numbers: DataFrame, checks: tuple[tuple[str, str], ...] = QUALITY_CHECKS) -> DataFrame:
    """One row with every check, the names of those that failed in order, and the status."""
    one = numbers.select(*[F.coalesce(F.expr(c), F.lit(False)).alias(k) for k, c in checks])
    failed = F.array_compact(F.array(*[F.when(~F.col(k), F.lit(k)) for k, _ in checks]))
    return one.withColumn("failed_checks", failed).withColumn("status", F.when(F.size("failed_checks") == 0, "pass").otherwise("needs_attention"))


#: The groupings of the jobs that a report asks for, by the grouping id of (category, source_id, province).
CUTS = {7: "all", 5: "source", 3: "category", 6: "province", 1: "category_source"}


def job_cube(jobs: DataFrame, policies: DataFrame, open_ended: str) -> DataFrame:
    """(cut, category, source_id, province, and counts): all that a report says of the jobs, by grouping sets in one pass over them.

    jobs: source_id, category, official_evidence_url, major_tags, location, province, country_or_region, deadline_date, summary, description;
    policies: source_id, deadline_policy. The counts are those of location_quality, deadline_quality, and evidence and tagged.
    """
    given = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    j = jobs.join(policies.select("source_id", F.col("deadline_policy").alias("__policy")), "source_id", "left")
    explicit = given(F.col("deadline_date").cast("string"))
    policy = ~explicit & (given("__policy") | F.coalesce(F.concat_ws(" ", "summary", "description").rlike(open_ended), F.lit(False)))
    flags = {
        "evidence": given("official_evidence_url"), "tagged": F.coalesce(F.size("major_tags"), F.lit(0)) > 0, "raw_location": given("location"), "normalized_region": given("province") | given("country_or_region"),
        "province_known": given("province"), "elsewhere": given("country_or_region") & ~given("province"), "explicit": explicit, "policy": policy,
    }
    j = j.select("category", "source_id", "province", *[f.alias(k) for k, f in flags.items()])
    sets = [[], ["source_id"], ["category"], ["province"], ["category", "source_id"]]
    cube = j.groupingSets(sets, "category", "source_id", "province").agg(F.grouping_id("category", "source_id", "province").alias("__cut"), F.count("*").alias("total"), *[F.count_if(k).alias(k) for k in flags])
    names = F.create_map(*[F.lit(x) for kv in CUTS.items() for x in kv])
    return cube.withColumn("cut", names[F.col("__cut").cast("int")]).withColumn("unstated", F.col("total") - F.col("explicit") - F.col("policy")).drop("__cut")


def cut(cube: DataFrame, name: str) -> DataFrame:
    """One grouping of job_cube. Of no jobs at all the cut `all` still has its row, of zeros."""
    rows = cube.filter(F.col("cut") == name)
    if name != "all":
        return rows
    counts = [c for c in cube.columns if c not in ("cut", "category", "source_id", "province")]
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts])


def top_share(counts: DataFrame, key: str, missing: str) -> DataFrame:
    """One row over (key, total): the largest key, its count, all, the share to four places and its risk, as listing.concentration gives; none without rows."""
    n = counts.groupBy(F.coalesce(key, F.lit(missing)).alias("top_key")).agg(F.sum("total").alias("n"))
    top = n.agg(F.min(F.struct((-F.col("n")).alias("n"), "top_key")).alias("t"), F.sum("n").alias("total")).filter("total IS NOT NULL")
    share = F.round(F.try_divide(-F.col("t.n"), F.col("total")), 4)
    risk = F.when(share >= 0.5, "high").when(share >= 0.3, "watch").otherwise("balanced")
    return top.select(F.col("t.top_key").alias("top_key"), (-F.col("t.n")).alias("top_count"), "total", share.alias("share"), risk.alias("risk"))


def _numbers(cube: DataFrame, explicit_matches: DataFrame, provinces: DataFrame) -> DataFrame:
    rate = lambda n: F.coalesce(F.round(F.try_divide(n, F.col("total")), 4), F.lit(0.0))
    rates = cut(cube, "all").select(rate(F.col("evidence")).alias("evidence_rate"), rate(F.col("tagged")).alias("tags_rate"), rate(F.col("normalized_region")).alias("region_rate"), rate(F.col("explicit") + F.col("policy")).alias("deadline_rate"))
    share = lambda name, key, missing, out: top_share(cut(cube, name), key, missing).agg(F.coalesce(F.max("share"), F.lit(0.0)).alias(out))
    failing = provinces.agg(F.count_if(F.col("no_match_is_verified") & (F.col("unhealthy") > 0)).alias("verified_in_failure"))
    parts = [rates, explicit_matches.select("explicit_matches"), share("source", "source_id", "unknown", "source_share"), share("category", "category", "unclassified", "category_share"), failing]
    return reduce(lambda a, b: a.join(b, F.lit(True)), parts)  # one row each


def numbers_for_gate(jobs: DataFrame, policies: DataFrame, explicit_matches: DataFrame, provinces: DataFrame, open_ended: str) -> DataFrame:
    """One row of what the checks ask, by one pass over the jobs. explicit_matches: one row with that column; provinces: of province_coverage; the others as for job_cube."""
    return _numbers(storage.stored(job_cube(jobs, policies, open_ended)), explicit_matches, provinces)


def report(sources: DataFrame, health: DataFrame, latest_runs: DataFrame, jobs: DataFrame, policies: DataFrame, targets: DataFrame, fallbacks: DataFrame, provinces: DataFrame, categories: DataFrame, explicit_matches: DataFrame, snapshots: DataFrame, today: Column, roles: tuple[str, ...], open_ended: str) -> dict[str, DataFrame]:
    """The sections of the coverage report as flat tables, each to be read on its own.

    The jobs are read once, for job_cube, which is stored: it has a row for each source, category, province and pair of the first two.
    """
    cube = storage.stored(job_cube(jobs, policies, open_ended))
    scans = source_scans(sources, health, latest_runs)
    by_province = province_coverage(provinces, scans, targets, cut(cube, "province").select("province", F.col("total").alias("jobs")), fallbacks, roles)
    scan_counts, outcomes = scan_quality(sources, health, latest_runs)
    whole = cut(cube, "all")
    current = whole.select(F.col("total").alias("open_jobs")).join(scan_counts, F.lit(True)).join(explicit_matches, F.lit(True))
    metrics = ["open_jobs", "successful_scan_sources", "sources_with_open_matches", "explicit_matches"]
    pairs = cut(cube, "category_source").filter("category IS NOT NULL")
    return {
        "health": health_distribution(sources, health), "without_health": without_health(sources, health), "scan_quality": scan_counts, "scan_outcomes": outcomes, "province_coverage": by_province,
        "target_states": state_totals(target_states(targets)), "location_quality": whole.select("total", "raw_location", "normalized_region", "province_known", "elsewhere"), "deadline_quality": whole.select("total", "explicit", "policy", "unstated"),
        "source_concentration": top_share(cut(cube, "source"), "source_id", "unknown"), "category_concentration": top_share(cut(cube, "category"), "category", "unclassified"),
        "category_sources": category_sources(pairs, categories, weight="total"), "trend": metric_trend(current, snapshots, "snapshot_date", today, metrics), "quality_gate": quality_gate(_numbers(cube, explicit_matches, by_province)),
    }
