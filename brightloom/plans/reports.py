"""Queries of the audit, the coverage report, the listing and the table states, over jobs, sources and runs made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.functions import places, taxonomy
from brightloom.operators import audit, coverage, listing, store
from brightloom.plans.catalog import query, read

OPEN_ENDED = "rolling|until filled"
JOBS_SQL = """sources AS (SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 10 = 9 THEN 'manual' ELSE 'html' END AS source_type, s_suppkey % 8 <> 3 AS enabled, 'https://h' || (s_suppkey % 7) || '.org' AS homepage_url,
    CASE WHEN s_suppkey % 13 = 5 THEN 'many' WHEN s_suppkey % 13 <> 6 THEN CAST(s_suppkey % 50 AS VARCHAR) END AS minimum_relevance FROM supplier),
  jobs AS (SELECT o_orderkey AS id, o_custkey % 120 AS source_id, c_mktsegment AS category, CASE WHEN o_orderkey % 50 = 7 THEN 'draft' ELSE 'published_official' END AS verification_status,
    CASE WHEN o_orderkey % 40 = 3 THEN 'x' ELSE 'https://a.b/' || o_orderkey END AS official_evidence_url,
    CASE WHEN o_orderkey % 33 = 5 THEN 'ftp://h/1' WHEN o_orderkey % 31 = 0 THEN 'https://shared.org/x' ELSE 'https://h' || (o_orderkey % 7) || '.org/' || o_orderkey END AS source_url,
    CASE WHEN o_orderkey % 29 = 1 THEN ' ' WHEN o_orderkey % 23 = 2 THEN 'interview list' ELSE 'post ' || o_orderpriority END AS title, CASE WHEN o_orderkey % 37 = 4 THEN 'forbidden thing' ELSE '' END AS summary,
    CASE WHEN o_orderkey % 41 <> 0 THEN 'rolling' END AS description, CAST(floor(o_totalprice / 5000) AS INT) AS relevance_score, CASE o_orderstatus WHEN 'O' THEN 'open' ELSE 'expired' END AS status,
    CASE WHEN o_orderkey % 19 = 0 THEN 'soon' WHEN o_orderkey % 17 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS deadline_date, CASE WHEN c_nationkey % 3 <> 0 THEN 'P' || (c_nationkey % 9) END AS province
    FROM orders JOIN customer ON o_custkey = c_custkey),
  runs AS (SELECT event_id AS id, user_id % 120 AS source_id, CASE event_type WHEN 'error' THEN 'running' WHEN 'view' THEN 'failed' ELSE 'finished' END AS status, ts AS started_at, CAST(floor(value) AS BIGINT) % 4 AS open_matching_count FROM events)"""


def _case(*pairs: tuple[Column, object], other: object = None) -> Column:
    out = other if isinstance(other, Column) else F.lit(other)
    for test, value in reversed(pairs):
        out = F.when(test, value).otherwise(out)
    return out


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        k.alias("id"), F.col("s_name").alias("name"), _case((k % 10 == 9, "manual"), other="html").alias("source_type"), (k % 8 != 3).alias("enabled"), F.concat(F.lit("https://h"), k % 7, F.lit(".org")).alias("homepage_url"),
        F.array(F.lit("h0.org"), F.lit("shared.org")).alias("allowed_hosts"), _case((k % 13 == 5, "many"), (k % 13 != 6, (k % 50).cast("string"))).cast("string").alias("minimum_relevance"), F.lit(False).alias("allow_shared_urls"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    k, text = F.col("o_orderkey"), lambda *x: F.concat(*[F.lit(c) if isinstance(c, str) else c for c in x])
    return o.select(
        k.alias("id"), (F.col("o_custkey") % 120).alias("source_id"), F.col("c_mktsegment").alias("category"), _case((k % 50 == 7, "draft"), other="published_official").alias("verification_status"),
        _case((k % 40 == 3, "x"), other=text("https://a.b/", k)).alias("official_evidence_url"), _case((k % 33 == 5, "ftp://h/1"), (k % 31 == 0, "https://shared.org/x"), other=text("https://h", k % 7, ".org/", k)).alias("source_url"),
        _case((k % 29 == 1, " "), (k % 23 == 2, "interview list"), other=text("post ", F.col("o_orderpriority"))).alias("title"), _case((k % 37 == 4, "forbidden thing"), other="").alias("summary"),
        _case((k % 41 != 0, "rolling")).cast("string").alias("description"), F.floor(F.col("o_totalprice") / 5000).cast("int").alias("relevance_score"), _case((F.col("o_orderstatus") == "O", "open"), other="expired").alias("status"),
        _case((k % 19 == 0, "soon"), (k % 17 != 0, F.col("o_orderdate").cast("date").cast("string"))).cast("string").alias("deadline_date"),
        F.when(F.col("c_nationkey") % 3 != 0, text("P", F.col("c_nationkey") % 9)).alias("province"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), (F.col("user_id") % 120).alias("source_id"), _case((kind == "error", "running"), (kind == "view", "failed"), other="finished").alias("status"), F.col("ts").alias("started_at"),
        (F.floor("value") % 4).alias("open_matching_count"),
    )


def _scans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources by source_id, their health (none for every eleventh), and latest runs."""
    s = sources(spark, sf_dir).withColumnRenamed("id", "source_id").withColumn("province", F.concat(F.lit("P"), F.col("source_id") % 9))
    health = s.filter("source_id % 11 <> 0").select("source_id", _case((F.col("source_id") % 6 == 1, "source_error"), other="source_active").alias("status"))
    return s, health, listing.latest(runs(spark, sf_dir), ["source_id"], "id")


SCANS_SQL = """, health AS (SELECT id AS source_id, CASE WHEN id % 6 = 1 THEN 'source_error' ELSE 'source_active' END AS status FROM sources WHERE id % 11 <> 0),
  latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY id DESC) AS r FROM runs) WHERE r = 1)"""
TODAY, CUTOFF = "1996-01-01", "2024-01-02 00:00:00"


@query(
    "audit_issues",
    f"""WITH {JOBS_SQL}, j AS (SELECT jobs.*, s.id AS known, source_type = 'manual' AS manual, enabled, minimum_relevance, homepage_url, TRY_CAST(minimum_relevance AS INT) AS least, TRY_CAST(deadline_date AS DATE) AS day,
      regexp_matches(source_url, '^https?://[^/]+') AS valid FROM jobs LEFT JOIN sources s ON source_id = s.id),
    k AS (SELECT * FROM j WHERE known IS NOT NULL)
    SELECT 'unknown_source' AS code, id AS job_id, source_id FROM j WHERE known IS NULL UNION ALL SELECT 'unpublished_job_record', id, source_id FROM k WHERE verification_status = 'draft'
    UNION ALL SELECT 'missing_official_evidence_url', id, source_id FROM k WHERE official_evidence_url = 'x' UNION ALL SELECT 'invalid_source_url', id, source_id FROM k WHERE NOT valid
    UNION ALL SELECT 'source_host_mismatch', id, source_id FROM k WHERE valid AND NOT manual AND regexp_extract(source_url, '//([^/]+)', 1) NOT IN ('h0.org', 'shared.org', regexp_extract(homepage_url, '//([^/]+)', 1))
    UNION ALL SELECT 'forbidden_notice_text', id, source_id FROM k WHERE contains(summary, 'forbidden') UNION ALL SELECT 'non_vacancy_process_notice', id, source_id FROM k WHERE title = 'interview list'
    UNION ALL SELECT 'invalid_source_threshold', id, source_id FROM k WHERE minimum_relevance = 'many' UNION ALL SELECT 'below_source_threshold', id, source_id FROM k WHERE relevance_score < coalesce(least, 0)
    UNION ALL SELECT 'disabled_source_job', id, source_id FROM k WHERE NOT manual AND NOT enabled AND status = 'open' UNION ALL SELECT 'empty_title', id, source_id FROM k WHERE trim(title) = ''
    UNION ALL SELECT 'empty_description', id, source_id FROM k WHERE description IS NULL UNION ALL SELECT 'invalid_deadline', id, source_id FROM k WHERE deadline_date = 'soon'
    UNION ALL SELECT 'stale_open_job', id, source_id FROM k WHERE status = 'open' AND day < DATE '{TODAY}'
    UNION ALL SELECT 'duplicate_source_url', NULL, NULL FROM (SELECT source_url FROM k GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'stale_crawl_run', NULL, source_id FROM runs WHERE status = 'running' AND started_at <= TIMESTAMP '{CUTOFF}' AND source_id IN (SELECT id FROM sources WHERE enabled)""",
)
def audit_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(jobs(spark, sf_dir), sources(spark, sf_dir), runs(spark, sf_dir), F.lit(TODAY).cast("date"), F.lit(CUTOFF).cast("timestamp_ntz"), ["forbidden"], ["interview"]).select("code", "job_id", "source_id")


_GATE_SQL = f"""WITH {JOBS_SQL}, n AS (SELECT round(count(*) FILTER (trim(official_evidence_url) <> '') / count(*), 4) AS ev, round(count(*) FILTER (id % 9 <> 0) / count(*), 4) AS tg, round(count(*) FILTER (province IS NOT NULL) / count(*), 4) AS rg,
    round(count(*) FILTER (deadline_date IS NOT NULL OR description IS NOT NULL) / count(*), 4) AS dl FROM jobs),
  ss AS (SELECT round(max(c) / sum(c), 4) AS s FROM (SELECT source_id, count(*) AS c FROM jobs GROUP BY 1)), cs AS (SELECT round(max(c) / sum(c), 4) AS s FROM (SELECT category, count(*) AS c FROM jobs GROUP BY 1)),
  c AS (SELECT ev = 1 AS official_evidence_url_complete, tg >= 0.9 AS major_tags_at_least_90_percent, rg >= 0.9 AS normalized_location_at_least_90_percent, dl >= 0.8 AS deadline_explicit_or_policy_at_least_80_percent,
    (SELECT count(*) FROM jobs WHERE relevance_score >= 55) > 0 AS explicit_profile_match_exists, ss.s < 0.5 AS source_concentration_below_50_percent, cs.s < 0.7 AS category_concentration_below_70_percent, true AS no_province_marked_verified_during_source_failure FROM n, ss, cs)
  SELECT *, array_to_string(list_filter([CASE WHEN NOT official_evidence_url_complete THEN 'official_evidence_url_complete' END, CASE WHEN NOT major_tags_at_least_90_percent THEN 'major_tags_at_least_90_percent' END,
    CASE WHEN NOT normalized_location_at_least_90_percent THEN 'normalized_location_at_least_90_percent' END], lambda x: x IS NOT NULL), ',') AS failed_checks, 'needs_attention' AS status FROM c"""


def _gate_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return jobs(spark, sf_dir).withColumns({"major_tags": F.when(F.col("id") % 9 != 0, F.array(F.lit("x"))), "location": none, "country_or_region": none})


def _province_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A province for each nation, every source a verified target of its province in one of two roles, and a fallback of the next one."""
    provinces = read(spark, sf_dir, "nation").select(F.concat(F.lit("P"), F.col("n_nationkey")).alias("province"))
    n = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"))
    targets = n.select(F.concat(F.lit("P"), F.col("source_id") % 9).alias("province"), _case((F.floor(F.col("source_id") / 9) % 2 == 0, "a"), other="b").alias("role"), F.lit("verified").alias("state"), "source_id")
    return provinces, targets, n.select(F.concat(F.lit("P"), (F.col("source_id") + 1) % 9).alias("province"), "source_id")


@query("coverage_gate", _GATE_SQL)
def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _gate_jobs(spark, sf_dir)
    s, health, latest = _scans(spark, sf_dir)
    provinces, targets, fallbacks = _province_inputs(spark, sf_dir)
    by_province = coverage.province_coverage(provinces, coverage.source_scans(s, health, latest), targets, j.select("province"), fallbacks, ("a", "b"))
    explicit = j.agg(F.count_if(F.col("relevance_score") >= 55).alias("explicit_matches"))
    policies = s.select("source_id", F.lit(None).cast("string").alias("deadline_policy"))
    numbers = coverage.numbers_for_gate(j, policies, explicit, by_province, OPEN_ENDED)
    return coverage.quality_gate(numbers).withColumn("failed_checks", F.array_join("failed_checks", ","))


@query(
    "province_ladder",
    f"""WITH {JOBS_SQL}{SCANS_SQL}, s AS (SELECT x.id, 'P' || (x.id % 9) AS province, enabled, h.status = 'source_active' AS healthy, coalesce(h.status = 'source_active' AND l.status = 'finished', false) AS usable, open_matching_count AS m FROM sources x LEFT JOIN health h ON h.source_id = x.id LEFT JOIN latest l ON l.source_id = x.id),
    g AS (SELECT province, count(*) AS registered, count(*) FILTER (enabled AND usable AND m > 0) AS with_matches, count(*) FILTER (enabled AND NOT healthy) AS unhealthy, count(*) FILTER (enabled AND NOT usable) AS unready FROM s GROUP BY 1)
    SELECT 'P' || n_nationkey AS province, coalesce(registered, 0) AS registered, coalesce(with_matches, 0) AS with_matches,
      CASE WHEN registered IS NULL THEN 'no_source' WHEN with_matches > 0 THEN 'matches' WHEN unhealthy > 0 THEN 'source_unhealthy' WHEN unready > 0 THEN 'scan_missing' ELSE 'other' END AS interpretation
    FROM nation LEFT JOIN g ON province = 'P' || n_nationkey""",
)
def province_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    provinces, targets, fallbacks = _province_inputs(spark, sf_dir)
    found = coverage.province_coverage(provinces, coverage.source_scans(*_scans(spark, sf_dir)), targets, jobs(spark, sf_dir).select("province"), fallbacks, ("a", "b"))
    known = ("no_source", "matches", "source_unhealthy", "scan_missing")
    return found.select("province", "registered", "with_matches", F.when(F.col("interpretation").isin(*known), F.col("interpretation")).otherwise("other").alias("interpretation"))


@query(
    "category_sources",
    f"""WITH {JOBS_SQL}, n AS (SELECT category, CAST(source_id AS VARCHAR) AS k, count(*) AS n FROM jobs GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, k) AS r, sum(n) OVER (PARTITION BY category) AS t, count(*) OVER (PARTITION BY category) AS s FROM n)
    SELECT category, k AS top_key, n AS top_count, t::BIGINT AS total, s AS source_count, CASE WHEN round(n / t, 4) >= 0.5 THEN 'high' WHEN round(n / t, 4) >= 0.3 THEN 'watch' ELSE 'balanced' END AS risk FROM r WHERE r = 1
    UNION ALL SELECT 'NOWHERE', NULL, 0, 0, 0, 'no_data'""",
)
def category_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jobs(spark, sf_dir).withColumn("source_id", F.col("source_id").cast("string"))
    every = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("category")).distinct().unionByName(spark.range(1).select(F.lit("NOWHERE").alias("category")))
    return coverage.category_sources(j, every).drop("share")


@query(
    "scan_outcomes",
    f"""WITH {JOBS_SQL}{SCANS_SQL}, l AS (SELECT latest.* FROM latest JOIN sources s ON source_id = s.id AND enabled)
    SELECT CASE WHEN status <> 'finished' THEN status WHEN open_matching_count > 0 THEN 'successful_with_open_matches' ELSE 'successful_without_open_matches' END AS outcome, count(*) AS n FROM l GROUP BY 1
    UNION ALL SELECT 'successful_scan_sources', count(*) FILTER (l.status = 'finished' AND h.status = 'source_active') FROM l LEFT JOIN health h USING (source_id)
    UNION ALL SELECT 'health ' || coalesce(status, 'unknown'), count(*) FROM sources LEFT JOIN health ON source_id = id GROUP BY 1""",
)
def scan_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, health, latest = _scans(spark, sf_dir)
    counts, outcomes = coverage.scan_quality(s, health, latest)
    healths = coverage.health_distribution(s, health).select(F.concat(F.lit("health "), "status").alias("outcome"), "n")
    return outcomes.unionByName(counts.select(F.lit("successful_scan_sources").alias("outcome"), F.col("successful_scan_sources").alias("n"))).unionByName(healths)


@query(
    "snapshot_change",
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY 1), t AS (SELECT * FROM d ORDER BY day DESC LIMIT 1), b AS (SELECT * FROM d WHERE day < (SELECT day FROM t) ORDER BY day DESC LIMIT 1)
    SELECT true AS available, CAST(b.day AS VARCHAR) AS baseline_day, t.events - b.events AS events_change, t.users - b.users AS users_change FROM t, b""",
)
def snapshot_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = read(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"))
    today = store.newest(daily, "day", 1)
    day = today.first()["day"]
    found = coverage.metric_trend(today, daily, "day", F.lit(day), ["events", "users"])
    return found.withColumn("baseline_day", F.col("baseline_day").cast("string"))


@query(
    "page_with_total",
    f"WITH {JOBS_SQL}, f AS (SELECT * FROM jobs WHERE status = 'open' AND category = 'BUILDING') SELECT id, relevance_score, (SELECT count(*) FROM f) AS total, (SELECT CAST(ceil(count(*) / 20) AS BIGINT) FROM f) AS pages FROM f ORDER BY relevance_score DESC, id LIMIT 20 OFFSET 40",
)
def page_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, total = listing.page_and_total(jobs(spark, sf_dir), [F.col("status") == "open", F.col("category") == "BUILDING", None], [F.desc("relevance_score"), F.col("id")], 3, 20)
    return rows.select("id", "relevance_score").join(total, F.lit(True))


@query(
    "display_order",
    f"""WITH {JOBS_SQL} SELECT id FROM jobs ORDER BY CASE WHEN relevance_score >= 55 THEN 0 WHEN relevance_score >= 20 THEN 1 ELSE 2 END, TRY_CAST(deadline_date AS DATE) NULLS LAST, title DESC, id LIMIT 40""",
)
def display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("relevance_score")
    j = jobs(spark, sf_dir).withColumns({"relevance_band": _case((score >= 55, "strong"), (score >= 20, "related"), other="weak"), "deadline_date": F.try_to_date("deadline_date"), "updated_at": F.col("title")})
    return j.orderBy(*listing.display_order(("strong", "related", "weak"))).limit(40).select("id")


@query(
    "run_summary",
    f"WITH {JOBS_SQL} SELECT count(*) AS sources, count(*) FILTER (status = 'finished') AS finished, count(*) FILTER (status = 'failed') AS failed, 0::BIGINT AS skipped, sum(open_matching_count)::BIGINT AS open_matching_count FROM runs",
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir).withColumns({c: F.lit(0) for c in ("discovered_count", "inserted_count", "updated_count")})
    return store.run_summary(r).drop("discovered_count", "inserted_count", "updated_count")


@query(
    "stale_runs",
    f"WITH {JOBS_SQL} SELECT runs.id, source_id, name AS source_name, enabled FROM runs LEFT JOIN sources s ON source_id = s.id WHERE status = 'running' AND started_at <= TIMESTAMP '{CUTOFF}'",
)
def stale_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.stale_runs(runs(spark, sf_dir), sources(spark, sf_dir), F.lit(CUTOFF).cast("timestamp_ntz")).select("id", "source_id", "source_name", "enabled")


@query(
    "relevance_gate",
    f"WITH {JOBS_SQL} SELECT source_id, count(*) AS skipped FROM jobs JOIN sources s ON source_id = s.id WHERE relevance_score < coalesce(TRY_CAST(minimum_relevance AS INT), 0) GROUP BY 1",
)
def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    least = sources(spark, sf_dir).select(F.col("id").alias("source_id"), F.try_to_number("minimum_relevance", F.lit("S999999999")).cast("int").alias("minimum_relevance"))
    return store.gated(jobs(spark, sf_dir), least)[1]


@query(
    "run_finish",
    f"WITH {JOBS_SQL} SELECT CASE WHEN status = 'running' AND id % 2 = 0 THEN 'finished' ELSE status END AS status, count(*) AS n, count(*) FILTER (status = 'running' AND id % 2 = 0) AS closed FROM runs GROUP BY 1",
)
def run_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir).withColumn("finished_at", F.lit(None).cast("timestamp"))
    done = store.finished(r, r.filter("id % 2 = 0").select("id", F.lit("finished").alias("status")), F.lit("2024-03-01").cast("timestamp"))
    return done.groupBy("status").agg(F.count("*").alias("n"), F.count("finished_at").alias("closed"))


TAXONOMY = taxonomy.Taxonomy(
    categories=(
        taxonomy.Category("works", "industry", "maker", "free", (("ring maker", ("ring",)), ("bolt maker", ("bolt",))), (("house one", ("brand#1",)), ("house two", ("brand#2",)))),
        taxonomy.Category("trade", "commerce", "shop", "free", (), (("red league", ("red",)), ("blue league", ("blue",))), earliest=True),
    ),
    fallback="trade", identity=(("works", ("economy", "standard")),), body=(("trade", ("widget",)),), legacy={"PROMO": "works"}, overseas=("large",), codes=("us",), domestic=("small",), directions=(("rings", ("ring",)), ("widgets", ("widget",))),
)


@query(
    "employment_taxonomy",
    """WITH p AS (SELECT p_partkey, lower(p_name || ' ' || p_brand) AS t, p_type, p_name FROM part), c AS (SELECT *, CASE WHEN p_type IN ('ECONOMY', 'STANDARD') OR p_type = 'PROMO' THEN 'works' WHEN contains(t, 'widget') THEN 'trade' END AS f FROM p),
    d AS (SELECT *, coalesce(f, 'trade') AS category FROM c)
    SELECT p_partkey, category, CASE category WHEN 'works' THEN 'industry' ELSE 'commerce' END AS sector,
      CASE WHEN f IS NULL THEN '单位属性待以官方公告核验' WHEN category = 'trade' THEN 'shop' WHEN contains(t, 'ring') THEN 'ring maker' WHEN contains(t, 'bolt') THEN 'bolt maker' ELSE 'maker' END AS employer_type,
      CASE WHEN f IS NULL THEN '所属体系待核验' WHEN category = 'works' THEN CASE WHEN contains(t, 'brand#1') THEN 'house one' WHEN contains(t, 'brand#2') THEN 'house two' ELSE 'free' END
        WHEN contains(t, 'red') AND (NOT contains(t, 'blue') OR strpos(t, 'red') < strpos(t, 'blue')) THEN 'red league' WHEN contains(t, 'blue') THEN 'blue league' ELSE 'free' END AS affiliation,
      CASE WHEN contains(lower(p_name), 'large') THEN '海外岗位' WHEN contains(lower(p_name), 'small') THEN '中国境内岗位' ELSE '地域待核验' END AS opportunity_scope, CASE WHEN contains(t, 'ring') THEN 'rings' WHEN contains(t, 'widget') THEN 'widgets' ELSE 'other' END AS role_direction
    FROM d""",
)
def employment_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    found = taxonomy.classify(F.concat_ws(" ", "p_name", "p_brand"), F.col("p_name"), F.col("p_type"), F.col("p_type"), TAXONOMY)
    return p.select("p_partkey", found.alias("c")).select("p_partkey", "c.*")


PLACES = places.Places(provinces={"AFRICA": "South", "ASIA": "East"}, cities={"NATION_5": ("South", "Five"), "NATION_7": ("East", "Seven")}, municipalities=("East",), countries={"EUROPE": "Old"}, codes={"XX": "Nowhere"}, cities_abroad={"customer#00000000": "Early"}, home="home")


@query(
    "location_cascade",
    """WITH l AS (SELECT c_custkey, n_name, r_name, CASE WHEN c_custkey % 13 = 0 THEN '' ELSE c_name || ', ' || n_name || ', ' || CASE WHEN c_custkey % 4 = 0 THEN 'XX' ELSE r_name END END AS t FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    m AS (SELECT *, CASE WHEN contains(t, 'AFRICA') THEN 'AFRICA' WHEN contains(t, 'ASIA') THEN 'ASIA' END AS pa, CASE WHEN contains(t, 'NATION_5') THEN 'NATION_5' WHEN contains(t, 'NATION_7') THEN 'NATION_7' END AS ca,
      CASE WHEN contains(lower(t), 'customer#00000000') THEN 'Early' ELSE split_part(t, ',', 1) END AS away FROM l)
    SELECT c_custkey, CASE WHEN ca = 'NATION_5' THEN 'South' WHEN ca = 'NATION_7' THEN 'East' WHEN pa = 'AFRICA' THEN 'South' WHEN pa = 'ASIA' THEN 'East' END AS province,
      CASE WHEN t = '' THEN NULL WHEN ca = 'NATION_5' THEN 'Five' WHEN ca = 'NATION_7' THEN 'Seven' WHEN pa = 'ASIA' THEN 'East' WHEN pa = 'AFRICA' OR contains(t, 'EUROPE') THEN NULL ELSE away END AS city,
      CASE WHEN t = '' THEN NULL WHEN ca IS NOT NULL OR pa IS NOT NULL THEN 'home' WHEN contains(t, 'EUROPE') THEN 'Old' WHEN contains(t, 'XX') THEN 'Nowhere' ELSE '海外' END AS country_or_region,
      CASE WHEN t = '' THEN 'unknown' WHEN pa IS NOT NULL THEN 'explicit' WHEN ca IS NOT NULL THEN 'normalized' WHEN contains(t, 'EUROPE') OR contains(t, 'XX') THEN 'explicit' ELSE 'normalized' END AS location_confidence,
      CASE WHEN t = '' THEN NULL WHEN pa IS NOT NULL THEN pa WHEN ca IS NOT NULL THEN ca WHEN contains(t, 'EUROPE') THEN 'EUROPE' WHEN contains(t, 'XX') THEN 'XX' ELSE away END AS location_evidence FROM m""",
)
def location_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    c = read(spark, sf_dir, "customer").join(where, F.col("c_nationkey") == F.col("n_nationkey"))
    text = F.when(F.col("c_custkey") % 13 == 0, "").otherwise(F.concat_ws(", ", "c_name", "n_name", F.when(F.col("c_custkey") % 4 == 0, "XX").otherwise(F.col("r_name"))))
    return c.select("c_custkey", places.location(text, PLACES).alias("p")).select("c_custkey", "p.*")
