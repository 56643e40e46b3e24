"""Queries of collection, records, links, publication, leads, coverage and snapshots over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom import storage
from brightloom.functions import taxonomy
from brightloom.operators import changes, coverage, leads, normalise, pages, publish, sync, text_index
from brightloom.plans.catalog import query, read
from brightloom.plans.reports import OPEN_ENDED, _case, jobs
from brightloom.sources import collect, feeds, links, nested
from brightloom.streaming import detector

TODAY = "1998-01-01"
VOCABULARY = normalise.Vocabulary(
    majors=(("RING", 30), ("Widget", 25), ("red", 20)), tier_points={"A": 20, "B": 12}, category_points={"works": 18}, energy_words=("Economy",), institution_words=("BRAND#1",), cap=45,
    taxonomy=taxonomy.Taxonomy(categories=(taxonomy.Category("works", "industry", "maker", "free"), taxonomy.Category("trade", "commerce", "shop", "free")), fallback="trade", body=(("works", ("ring", "bolt")),)),
)


def _parts(spark: SparkSession, sf_dir: str, edited: bool = False) -> DataFrame:
    """Parts as raw postings; edited: every fifth with another title, every seventh with more text at its end."""
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    title = F.when(F.lit(edited) & (k % 5 == 0), F.concat("p_name", F.lit(" revised"))).otherwise(F.col("p_name"))
    more = F.when(F.lit(edited) & (k % 7 == 0), F.repeat(F.lit(" more"), 4_000)).otherwise(F.repeat(F.lit(" text"), 3_000))
    # a row is two hundred times as large with its text, so rows are dealt to all tasks before they have it
    dealt = read(spark, sf_dir, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), k)
    return dealt.select(
        k, (F.col("p_size") % 10).cast("string").alias("source_id"), _case((F.col("p_size") % 3 == 0, "A"), (F.col("p_size") % 3 == 1, "B"), other="Z").alias("source_tier"), title.alias("title"), F.col("p_brand").alias("employer"),
        F.concat(F.lit("https://parts.org/p/"), k).alias("source_url"), F.concat(F.col("p_type"), F.when(k % 7 == 0, more).otherwise("")).alias("text"), none.alias("published_date"), none.alias("deadline_date"), none.alias("location"), none.alias("match_text"),
        F.when(k % 3 != 0, F.concat(F.lit("id-"), k)).alias("external_id"),
    )


_PARTS_SQL = """p AS (SELECT *, CAST(p_size % 10 AS VARCHAR) AS source_id, lower(p_name || ' ' || p_brand || ' ' || p_type) AS t, CASE WHEN p_partkey % 3 <> 0 THEN 'id-' || p_partkey ELSE 'https://parts.org/p/' || p_partkey END AS own FROM part)"""


@query(
    "record_identity",
    f"""WITH {_PARTS_SQL}, s AS (SELECT *, CASE WHEN contains(t, 'ring') OR contains(t, 'bolt') THEN 'works' ELSE 'trade' END AS category,
        least(45, CASE WHEN contains(t, 'ring') THEN 30 ELSE 0 END + CASE WHEN contains(t, 'widget') THEN 25 ELSE 0 END + CASE WHEN contains(t, 'red') THEN 20 ELSE 0 END) + CASE p_size % 3 WHEN 0 THEN 20 WHEN 1 THEN 12 ELSE 5 END
        + CASE WHEN contains(t, 'ring') OR contains(t, 'bolt') THEN 18 ELSE 0 END + CASE WHEN contains(t, 'economy') THEN 15 ELSE 0 END + CASE WHEN contains(t, 'brand#1') THEN 8 ELSE 0 END AS score FROM p)
    SELECT p_partkey, sha256(source_id || chr(10) || own) AS fingerprint, category, least(100, score)::INTEGER AS relevance_score, CASE WHEN score >= 55 THEN 'strong' WHEN score >= 30 THEN 'related' ELSE 'weak' END AS relevance_band,
      concat_ws(',', CASE WHEN contains(t, 'ring') THEN 'RING' END, CASE WHEN contains(t, 'widget') THEN 'Widget' END, CASE WHEN contains(t, 'red') THEN 'red' END) AS tags FROM s""",
)
def record_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity, tags, score and category of every record."""
    r = normalise.posting(_parts(spark, sf_dir), VOCABULARY, F.lit(TODAY).cast("date"))
    return r.select("p_partkey", "fingerprint", "category", "relevance_score", "relevance_band", F.array_join("major_tags", ",").alias("tags"))


@query(
    "edited_records",
    f"""WITH {_PARTS_SQL} SELECT CASE WHEN p_partkey % 11 = 0 THEN 'created' WHEN p_partkey % 13 = 0 THEN 'absent' WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN 'updated' ELSE 'unchanged' END AS outcome,
      count(*) AS n, count(*) FILTER (p_partkey % 11 = 0 OR p_partkey % 13 <> 0 AND (p_partkey % 5 = 0 OR p_partkey % 7 = 0)) AS events FROM p GROUP BY 1""",
)
def edited_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2 over P1: a new title, or text behind the twelve thousandth character, is another content of the same record."""
    today, now = F.lit(TODAY).cast("date"), F.lit(f"{TODAY} 12:00:00").cast("timestamp")
    record = lambda raw: normalise.posting(raw, VOCABULARY, today).select("fingerprint", "content_hash", "title")
    old = record(_parts(spark, sf_dir).filter("p_partkey % 11 <> 0"))
    state = old.withColumns({c: F.lit("1997-01-01").cast("timestamp") for c in ("first_seen_at", "last_seen_at", "updated_at")})
    after, events = changes.detect(state, record(_parts(spark, sf_dir, edited=True).filter("p_partkey % 11 = 0 OR p_partkey % 13 <> 0")), "fingerprint", "content_hash", ["title"], now)
    counted = after.join(events.select("fingerprint", F.lit(1).alias("event")), "fingerprint", "left")
    return counted.groupBy("outcome").agg(F.count("*").alias("n"), F.count("event").alias("events"))


ROLES = ("a", "b")
#: What is known of a province goes by its nation's key modulo 11, so that every rung of the ladder that can be reached is.
_PROVINCES_SQL = """s AS (SELECT s_suppkey AS id, n_name AS province, n_nationkey % 11 AS k, n_nationkey % 11 NOT IN (0, 10) AS enabled, CASE s_suppkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS role FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 11 <> 0),
  h AS (SELECT id, CASE WHEN k = 2 AND id % 2 = 0 THEN 'source_blocked' WHEN k = 3 AND id % 5 = 0 THEN 'seen once' ELSE 'source_active' END AS status FROM s WHERE k <> 3 OR id % 7 <> 0),
  r AS (SELECT id, CASE WHEN k = 3 AND id % 2 = 0 THEN 'failed' ELSE 'finished' END AS status, CASE k WHEN 1 THEN id % 3 ELSE 0 END AS matches FROM s),
  x AS (SELECT s.*, coalesce(h.status, 'unknown') AS health, r.status = 'finished' AS finished, matches, enabled AND coalesce(h.status, '') = 'source_active' AND r.status = 'finished' AS usable FROM s LEFT JOIN h USING (id) LEFT JOIN r USING (id)),
  good AS (SELECT min(id) FILTER (k = 1) AS one, min(id) FILTER (k = 10) AS off, min(id) FILTER (k = 1 AND id % 3 > 0) AS matching FROM x),
  t AS (SELECT n_name AS province, v.role, CASE WHEN n_nationkey % 11 = 5 AND v.role = 'b' THEN off ELSE one END AS id FROM nation, (VALUES ('a'), ('b')) v(role), good WHERE n_nationkey % 11 > 4),
  f AS (SELECT n_name AS province, matching AS id FROM nation, good WHERE n_nationkey % 11 = 7)"""


@query(
    "province_report",
    f"""WITH {_PROVINCES_SQL}, l AS (SELECT province, count(*) AS registered, count(*) FILTER (enabled) AS enabled_sources, count(*) FILTER (usable) AS active_sources, count(*) FILTER (enabled AND health = 'source_active') AS accessible,
        count(*) FILTER (enabled AND (health = 'source_active' OR finished)) AS accessible_or_scanned, count(*) FILTER (usable AND matches > 0) AS with_matches, count(*) FILTER (usable AND matches = 0) AS without_matches,
        count(*) FILTER (enabled AND NOT usable) AS unready, count(*) FILTER (enabled AND health = 'source_blocked') AS unhealthy, list_contains(list(role), 'a') AS has_a, list_contains(list(role), 'b') AS has_b FROM x GROUP BY 1),
      tt AS (SELECT t.province, count(*) AS verified_roles, count(*) FILTER (NOT usable) AS roles_unscanned FROM t JOIN x USING (id) GROUP BY 1),
      ff AS (SELECT f.province, count(*) FILTER (usable AND matches > 0) AS fallback_matches FROM f JOIN x USING (id) GROUP BY 1),
      j AS (SELECT n_name AS province, count(*) AS jobs FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 11 IN (6, 9) GROUP BY 1),
      a AS (SELECT n_name AS province, coalesce(registered, 0) AS registered, coalesce(enabled_sources, 0) AS enabled_sources, coalesce(active_sources, 0) AS active_sources, coalesce(accessible, 0) AS accessible, coalesce(accessible_or_scanned, 0) AS accessible_or_scanned,
        coalesce(with_matches, 0) AS with_matches, coalesce(without_matches, 0) AS without_matches, coalesce(unready, 0) AS unready, coalesce(unhealthy, 0) AS unhealthy, coalesce(verified_roles, 0) AS verified_roles, coalesce(roles_unscanned, 0) AS roles_unscanned,
        coalesce(fallback_matches, 0) AS fallback_matches, coalesce(jobs, 0) AS jobs, concat_ws(',', CASE WHEN NOT coalesce(has_a, false) THEN 'a' END, CASE WHEN NOT coalesce(has_b, false) THEN 'b' END) AS missing_source_roles,
        coalesce(enabled_sources, 0) > 0 AND coalesce(unready, 0) = 0 AND coalesce(verified_roles, 0) = 2 AND coalesce(roles_unscanned, 0) = 0 AND coalesce(with_matches, 0) = 0 AS no_match_is_verified
        FROM nation LEFT JOIN l ON l.province = n_name LEFT JOIN tt ON tt.province = n_name LEFT JOIN ff ON ff.province = n_name LEFT JOIN j ON j.province = n_name)
    SELECT *, CASE WHEN registered = 0 THEN 'no_source' WHEN with_matches > 0 THEN 'matches' WHEN unhealthy > 0 THEN 'source_unhealthy' WHEN unready > 0 THEN 'scan_missing' WHEN verified_roles < 2 THEN 'roles_unverified' WHEN roles_unscanned > 0 THEN 'role_scan_missing'
      WHEN jobs > 0 THEN 'jobs_from_elsewhere' WHEN fallback_matches > 0 THEN 'fallback_matches' WHEN no_match_is_verified THEN 'no_match_verified' WHEN without_matches > 0 THEN 'no_match_in_scanned' ELSE 'not_scanned' END AS interpretation FROM a""",
)
def province_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every province's numbers and what they show, absence proven by usable scans alone."""
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("n_nationkey") % 11
    s = read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).filter(k != 0)
    s = s.select(F.col("s_suppkey").alias("source_id"), F.col("n_name").alias("province"), k.alias("k"), (k != 10).alias("enabled"), _case((F.col("s_suppkey") % 3 == 0, "a"), (F.col("s_suppkey") % 3 == 1, "b")).cast("string").alias("source_role"))
    i = F.col("source_id")
    health = s.filter((F.col("k") != 3) | (i % 7 != 0)).select("source_id", _case(((F.col("k") == 2) & (i % 2 == 0), "source_blocked"), ((F.col("k") == 3) & (i % 5 == 0), "seen once"), other="source_active").alias("status"))
    runs = s.select("source_id", _case(((F.col("k") == 3) & (i % 2 == 0), "failed"), other="finished").alias("status"), F.when(F.col("k") == 1, i % 3).otherwise(0).alias("open_matching_count"))
    scans = coverage.source_scans(s, health, runs)
    pick = lambda test: F.min(F.when(test, i))
    good = s.agg(pick(F.col("k") == 1).alias("one"), pick(F.col("k") == 10).alias("off"), pick((F.col("k") == 1) & (i % 3 > 0)).alias("matching"))
    named = nation.select(F.col("n_name").alias("province"), k.alias("k")).join(good, F.lit(True))  # one row beside each nation
    targets = named.filter("k > 4").select("province", "k", "one", "off", F.explode(F.array(*[F.lit(r) for r in ROLES])).alias("role"))
    targets = targets.select("province", "role", F.lit("verified").alias("state"), F.when((F.col("k") == 5) & (F.col("role") == "b"), F.col("off")).otherwise(F.col("one")).alias("source_id"))
    fallbacks = named.filter("k = 7").select("province", F.col("matching").alias("source_id"))
    jobs = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).filter(k.isin(6, 9)).select(F.col("n_name").alias("province"))
    found = coverage.province_coverage(nation.select(F.col("n_name").alias("province")), scans, targets, jobs, fallbacks, ROLES)
    return found.select(
        "province", "registered", "enabled_sources", "active_sources", "accessible", "accessible_or_scanned", "with_matches", "without_matches", "unready", "unhealthy", "verified_roles", "roles_unscanned", "fallback_matches", "jobs",
        F.array_join("missing_source_roles", ",").alias("missing_source_roles"), "no_match_is_verified", "interpretation",
    )


@query(
    "source_backups",
    """WITH s AS (SELECT s_suppkey AS id, s_suppkey % 4 AS listings, CASE WHEN s_suppkey % 6 = 0 THEN 2 ELSE 0 END AS entries, list_filter(list_distinct([s_suppkey + 1, s_suppkey * 7 % 150, s_suppkey]), lambda x: x <> s_suppkey AND s_suppkey % 5 < 2) AS others,
        s_suppkey % 8 <> 3 AND s_suppkey % 6 <> 1 AND s_suppkey % 9 <> 0 AS usable FROM supplier),
      u AS (SELECT id, count(*) FILTER (o.usable) AS usable FROM (SELECT id, unnest(others) AS other FROM s) x JOIN (SELECT id AS other, usable FROM s) o USING (other) GROUP BY 1),
      b AS (SELECT s.id, entries + greatest(listings - 1, 0) AS backup_entry_count, len(others) AS backup_source_count, coalesce(u.usable, 0) AS usable FROM s LEFT JOIN u USING (id))
    SELECT CAST(backup_entry_count AS INTEGER) AS backup_entry_count, CAST(backup_source_count AS INTEGER) AS backup_source_count, count(*) AS sources, count(*) FILTER (backup_entry_count > 0 OR backup_source_count > 0) AS with_backup, count(*) FILTER (usable > 0) AS with_usable,
      (SELECT round(count(*) FILTER (backup_entry_count > 0 OR backup_source_count > 0) / count(*), 4) FROM b) AS coverage_rate, (SELECT round(count(*) FILTER (usable > 0) / count(*), 4) FROM b) AS usable_rate FROM b GROUP BY 1, 2""",
)
def source_backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared backups of every source and those that are usable now."""
    k = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    s = read(spark, sf_dir, "supplier").select(
        k.alias("source_id"), F.slice(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.lit(1), (k % 4).cast("int")).alias("listing_urls"), F.when(k % 6 == 0, F.array(F.lit("e"), F.lit("f"))).alias("fallback_entry_urls"),
        F.when(k % 5 < 2, F.array(text(k + 1), text(k * 7 % 150), text(k))).alias("fallback_source_ids"), (k % 8 != 3).alias("enabled"), F.lit(None).cast("string").alias("province"),
    )
    health = s.select("source_id", _case((F.col("source_id") % 6 == 1, "source_error"), other="source_active").alias("status"))
    runs = s.filter("source_id % 9 <> 0").select("source_id", F.lit("finished").alias("status"), F.lit(0).alias("open_matching_count"))
    scans = coverage.source_scans(s, health, runs)
    each = coverage.backups(s, scans).groupBy("backup_entry_count", "backup_source_count").agg(F.count("*").alias("sources"), F.count_if("has_backup").alias("with_backup"), F.count_if(F.size("usable_fallback_source_ids") > 0).alias("with_usable"))
    rates = coverage.resilience(s, scans).select("coverage_rate", F.col("usable_fallback_source_coverage_rate").alias("usable_rate"))
    return each.join(rates, F.lit(True))  # one row of rates


class _Ledgers(collect.CapturedSources):
    """A line of a ledger whose balance is below -900 can't be read; one of over 9,900 stops the reading by the site's rules."""

    @classmethod
    def name(cls) -> str:
        return "ledgers"

    def documents(self, source):
        for url, text in super().documents(source):
            balance = float(text)
            if balance < -900:
                raise ValueError("balance too low")
            if balance > 9_900:
                raise collect.SourceSkipped("robots.txt does not permit this")
            yield url, text


@query(
    "source_runs",
    """WITH s AS (SELECT n_name AS source_id, n_nationkey % 12 <> 7 AS enabled, n_nationkey % 12 = 5 AS manual FROM nation), d AS (SELECT n_name AS source_id, CAST(s_acctbal AS DOUBLE) AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey),
      x AS (SELECT source_id, count(*) AS n, bool_or(b < -900) AS low, bool_or(b > 9900) AS high FROM d GROUP BY 1)
    SELECT source_id, CASE WHEN coalesce(low, false) OR coalesce(high, false) THEN 'not finished' ELSE 'finished' END AS outcome, CASE WHEN coalesce(low, false) OR coalesce(high, false) THEN 0 ELSE coalesce(n, 0) END AS discovered_count FROM s LEFT JOIN x USING (source_id) WHERE enabled AND NOT manual""",
)
def source_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers of each nation are a source's documents; a source that fails or refuses has a run without records, the others' records stay."""
    nation = read(spark, sf_dir, "nation")
    docs = read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("source_id"), F.concat(F.lit("https://s/"), "s_suppkey").alias("url"), F.col("s_acctbal").cast("string").alias("document"))
    path = storage.fresh_folder(spark, "captures")
    collect.capture(docs, path)
    sources = nation.select(F.col("n_name").alias("source_id"), _case((F.col("n_nationkey") % 12 == 5, "manual"), other="ledger").alias("source_type"), (F.col("n_nationkey") % 12 != 7).alias("enabled"), F.lit(0).alias("minimum_relevance"))
    whole, failures = collect.split(storage.stored(collect.collect(spark, sources, _Ledgers, path=path)))
    records = whole.select("source_id", F.sha2("url", 256).alias("fingerprint"), F.sha2("document", 256).alias("content_hash"), F.lit("open").alias("status"), F.lit(1).alias("relevance_score"), "position")
    jobs = spark.createDataFrame([], "fingerprint string, content_hash string, source_id string, status string, first_seen_at timestamp, last_seen_at timestamp, updated_at timestamp")
    health = spark.createDataFrame([], "source_id string, status string, checked_at timestamp, status_code int, detail string, last_success_at timestamp")
    on = sources.withColumn("enabled", F.col("enabled") & (F.col("source_type") != "manual"))
    done = sync.sync(jobs, health, on, records, failures, ["source_id", "status"], F.lit("2024-01-01").cast("timestamp"))
    return done.runs.select("source_id", F.when(F.col("status") == "finished", "finished").otherwise("not finished").alias("outcome"), "discovered_count")


@query(
    "nested_places",
    """WITH c AS (SELECT c_custkey, r_name, n_name, c_mktsegment AS m FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
      l AS (SELECT c_custkey, list_filter([CASE WHEN c_custkey % 3 = 0 THEN n_name END, CASE WHEN c_custkey % 4 <> 1 THEN r_name END, m, CASE WHEN c_custkey % 2 = 0 THEN 'desk ' || c_custkey % 10 END, n_name], lambda x: x IS NOT NULL) AS v FROM c)
    SELECT c_custkey, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), '、') AS place FROM l""",
)
def nested_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places in JSON of up to four levels of lists and objects, each once, in order."""
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    c = read(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    k, one = F.col("c_custkey"), lambda v: F.to_json(F.struct(v.alias("name")))
    first = F.when(k % 3 == 0, one(F.col("n_name"))).otherwise("[]")
    second = F.concat(F.lit('{"country":'), F.when(k % 4 != 1, F.to_json(F.array(F.array("r_name")))).otherwise("null"), F.lit(',"city":[[{"label":"'), "c_mktsegment", F.lit('"}]],"zip":7}'))
    third = F.when(k % 2 == 0, F.concat(F.lit('"desk  '), (k % 10).cast("string"), F.lit(' "'))).otherwise("false")
    document = F.concat(F.lit('{"title":"x","locations":['), first, F.lit(",["), second, F.lit(']],"workPlace":'), third, F.lit(',"place":{"name":" '), "n_name", F.lit('"}}'))
    return c.select("c_custkey", nested.place_of(document).alias("place"))


#: One rule set for each language of the pages.
_RULES = (("en", "nav a", "the"), ("fr", "nav ul > li a", "que"), ("de", "nav a[href^='/']", "der"), ("es", "li a, nav > a", "que"))


@query(
    "page_links",
    r"""WITH p AS (SELECT DISTINCT regexp_extract(html, '<html lang="(\w+)"', 1) AS source_id, url, page_id, regexp_extract(html, '<nav>(.*?)</nav>', 1, 's') AS nav FROM pages WHERE html IS NOT NULL),
      a AS (SELECT source_id, url, page_id, i, regexp_extract(x, 'href="([^"]*)"', 1) AS href, regexp_extract(x, '>([^<]*)</a>', 1) AS title FROM (SELECT source_id, url, page_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS x FROM (SELECT *, regexp_extract_all(nav, '<a href="[^"]*">[^<]*</a>') AS l FROM p))),
      t AS (SELECT * FROM a WHERE href <> '' AND trim(title) <> '' AND contains(lower(title || ' ' || regexp_extract(url, '^\w+://[^/?#]*') || href), CASE source_id WHEN 'en' THEN 'the' WHEN 'de' THEN 'der' ELSE 'que' END) AND source_id IN ('en', 'fr', 'de', 'es'))
    SELECT source_id, count(*) AS links, count(DISTINCT url) AS pages FROM (SELECT DISTINCT source_id, url, href FROM t) GROUP BY 1""",
)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of every page that pass their source's tests, the sources being the pages' languages."""
    pages = read(spark, sf_dir, "pages").select(F.regexp_extract("html", r'<html lang="(\w+)"', 1).alias("source_id"), "url", "html")
    rules = spark.createDataFrame([(lang, css, [word], True) for lang, css, word in _RULES], "source_id string, listing_selector string, include_keywords array<string>, require_recruitment_word boolean")
    found = links.links(pages, rules, [], ["the", "que", "der"], [])
    return found.groupBy("source_id").agg(F.count("*").alias("links"), F.count_distinct("page").alias("pages"))


@query(
    "published_report",
    """WITH j AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'expired' END AS status, CAST(o_orderdate AS DATE) AS deadline FROM orders),
      e AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'created' ELSE 'updated' END AS event FROM orders WHERE o_custkey % 40 = 7)
    SELECT '1998-01-01' AS report_date, (SELECT count(*) FROM e WHERE event = 'created') AS new_jobs, (SELECT count(*) FROM e WHERE event = 'updated') AS updated_jobs,
      (SELECT count(*) FROM j WHERE status = 'open' AND deadline BETWEEN DATE '1998-01-01' AND DATE '1998-01-08') AS deadline_soon, (SELECT count(*) FROM j WHERE status = 'open' AND NOT deadline < DATE '1998-01-01') AS open_total, 1::BIGINT AS refused""",
)
def published_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report whose audit finds an order without a price is not published, the one after it is, and a third of the same day changes nothing."""
    o = read(spark, sf_dir, "orders")
    jobs = o.select(F.col("o_orderkey").alias("id"), _case((F.col("o_orderstatus") == "O", "open"), other="expired").alias("status"), F.col("o_orderdate").cast("date").alias("deadline_date"), F.col("o_totalprice").cast("int").alias("relevance_score"))
    kind = _case((F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "created"), other="updated")
    events = o.filter("o_custkey % 40 = 7").select(F.col("o_orderkey").alias("job_id"), kind.alias("event_type"), F.lit("1998-01-01 03:00:00").cast("timestamp").alias("occurred_at"))
    day = F.lit(TODAY).cast("date")
    start, end = (F.lit(f"{d} 00:00:00").cast("timestamp") for d in (TODAY, "1998-01-02"))
    root, now = storage.fresh_folder(spark, "published"), F.lit(f"{TODAY} 20:00:00").cast("timestamp")
    build = lambda j: storage.stored(publish.daily_payload(j, events, day, start, end, F.struct("id", "relevance_score")))
    audit = lambda j: lambda tables: j.filter("relevance_score <= 0").select("id")
    outcomes = [publish.publish_report(spark, root, build(j), audit(j), now).published for j in (jobs.withColumn("relevance_score", F.lit(0)), jobs, jobs.limit(0))]
    stats = F.from_json("payload", "stats struct<new:long,updated:long,deadline_soon:long,open_total:long>")["stats"]
    kept = publish.current(spark, root, "reports").select("report_date", stats.alias("s"))
    return kept.select(F.col("report_date").cast("string").alias("report_date"), F.col("s.new").alias("new_jobs"), F.col("s.updated").alias("updated_jobs"), "s.deadline_soon", "s.open_total", F.lit(outcomes.count(False)).cast("long").alias("refused"))


@query(
    "lead_changes",
    """WITH c AS (SELECT o_custkey AS id, list(o_orderpriority ORDER BY o_orderdate, o_orderkey) AS l, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders GROUP BY 1),
      f AS (SELECT c_custkey AS id, list_reduce(list_concat([{'s': 'candidate', 'u': false, 'r': 0::BIGINT, 'j': -1::BIGINT, 'p': '', 'k': 0::BIGINT}], coalesce(list_transform(l, lambda x, i: {'s': '', 'u': false, 'r': 0::BIGINT, 'j': -1::BIGINT, 'p': x, 'k': k[i]}), [])),
        lambda a, x: CASE WHEN x.p = '3-MEDIUM' THEN CASE WHEN a.s = 'official_content_verified' THEN {'s': 'published', 'u': a.u, 'r': a.r, 'j': x.k, 'p': '', 'k': 0::BIGINT} ELSE {'s': a.s, 'u': a.u, 'r': a.r + 1, 'j': a.j, 'p': '', 'k': 0::BIGINT} END
          WHEN x.p = '1-URGENT' THEN {'s': 'official_url_found', 'u': true, 'r': a.r, 'j': a.j, 'p': '', 'k': 0::BIGINT}
          WHEN x.p = '2-HIGH' THEN CASE WHEN a.u THEN {'s': 'official_content_verified', 'u': true, 'r': a.r, 'j': a.j, 'p': '', 'k': 0::BIGINT} ELSE {'s': a.s, 'u': a.u, 'r': a.r + 1, 'j': a.j, 'p': '', 'k': 0::BIGINT} END
          WHEN x.p = '5-LOW' THEN {'s': 'rejected', 'u': a.u, 'r': a.r, 'j': a.j, 'p': '', 'k': 0::BIGINT}
          ELSE CASE WHEN a.s = 'published' THEN {'s': a.s, 'u': a.u, 'r': a.r + 1, 'j': a.j, 'p': '', 'k': 0::BIGINT} ELSE {'s': a.s, 'u': a.u, 'r': a.r, 'j': a.j, 'p': '', 'k': 0::BIGINT} END END) AS x
        FROM customer LEFT JOIN c ON c.id = c_custkey)
    SELECT id, x.s AS status, x.r AS refused, CASE WHEN x.j >= 0 THEN x.j END AS job_id FROM f""",
)
def lead_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer is a lead and its orders are changes in the order of their dates."""
    new, _ = leads.created(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("p").alias("lead_provider"), F.lit("https://l").alias("lead_url"), F.col("c_name").alias("title")), F.lit("2024-01-01").cast("timestamp"))
    p = F.col("o_orderpriority")
    fields = (
        F.when(p == "1-URGENT", F.create_map(F.lit("verification_status"), F.lit("official_url_found"), F.lit("official_url"), F.lit("https://o")))
        .when(p == "2-HIGH", F.create_map(F.lit("verification_status"), F.lit("official_content_verified"), F.lit("verification_note"), F.lit("seen")))
        .when(p == "5-LOW", F.create_map(F.lit("verification_status"), F.lit("rejected"))).when(p == "4-NOT SPECIFIED", F.create_map(F.lit("employer_hint"), F.lit("x")))
    )
    place = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) * 1_000_000_000 + F.col("o_orderkey")
    moves = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), place.alias("position"), _case((p == "3-MEDIUM", "publish"), other="update").alias("action"), fields.alias("fields"), F.col("o_orderkey").alias("job_id"))
    after, refused = leads.fold(new, moves, F.lit("2024-01-02").cast("timestamp"))
    why = refused.groupBy("id").agg(F.count("*").alias("refused"))
    return after.join(why, "id", "left").select("id", F.col("verification_status").alias("status"), F.coalesce("refused", F.lit(0)).alias("refused"), F.col("published_job_id").alias("job_id"))


@query(
    "previous_order",
    """SELECT o.o_orderkey, x.o_totalprice AS before_price, CAST(CAST(x.o_orderdate AS DATE) AS VARCHAR) AS before_day FROM orders o LEFT JOIN LATERAL (SELECT o_totalprice, o_orderdate FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate < o.o_orderdate ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) x ON true""",
)
def previous_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15 in general: each order with its customer's last one of an earlier day."""
    o = read(spark, sf_dir, "orders")
    found = coverage.asof(o.select("o_orderkey", "o_custkey", "o_orderdate"), o.select("o_custkey", "o_orderdate", F.col("o_totalprice").alias("before_price"), F.col("o_orderkey").alias("k")), "o_orderdate", ["o_custkey"], ["before_price"], "k")
    return found.select("o_orderkey", "before_price", F.col("fact_time").cast("date").cast("string").alias("before_day"))


@query(
    "snapshot_history",
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events WHERE event_type <> 'error' OR day(ts) % 3 <> 0 GROUP BY 1, 2), t AS (SELECT day, sum(n)::BIGINT AS total, lag(sum(n)::BIGINT) OVER (ORDER BY day) AS before, lag(day) OVER (ORDER BY day) AS baseline_day FROM d GROUP BY 1)
    SELECT CAST(t.day AS VARCHAR) AS day, CAST(baseline_day AS VARCHAR) AS baseline_day, total - before AS total_change, coalesce(e.n, 0) - coalesce(f.n, 0) AS error_change, coalesce(c.n, 0) - coalesce(g.n, 0) AS click_change FROM t LEFT JOIN d e ON e.day = t.day AND e.event_type = 'error' LEFT JOIN d f ON f.day = t.baseline_day AND f.event_type = 'error'
      LEFT JOIN d c ON c.day = t.day AND c.event_type = 'click' LEFT JOIN d g ON g.day = t.baseline_day AND g.event_type = 'click' WHERE baseline_day IS NOT NULL""",
)
def snapshot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of all days at once, in total and by type; a type that a day lacks counts as zero."""
    e = read(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day"), "event_type").filter((F.col("event_type") != "error") | (F.dayofmonth("day") % 3 != 0))
    n = e.groupBy("day", "event_type").agg(F.count("*").alias("n"))
    s = n.groupBy("day").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("types"))
    found = coverage.daily_changes(s, "day", ["total"], ["types"]).filter("available")
    of = lambda k: F.coalesce(F.try_element_at("types_change", F.lit(k)), F.lit(0))
    return found.select(*[F.col(c).cast("string").alias(c) for c in ("day", "baseline_day")], "total_change", of("error").alias("error_change"), of("click").alias("click_change"))


@query("keyword_index", "SELECT doc_id, source FROM documents WHERE coalesce(text ILIKE '%license%', false)")
def keyword_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 by trigrams: the index of all texts is built, and only the rows that can hold the word are read again."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    path = storage.fresh_folder(spark, "indexes")
    text_index.build(docs, "doc_id", ["text"], path)
    return text_index.search(docs, "doc_id", ["text"], path, "License").select("doc_id", "source")


@query(
    "range_pages",
    """WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n, count(*) OVER () AS total FROM orders)
    SELECT CAST(ceil(n / 25) AS BIGINT) AS page, o_orderkey, total FROM o WHERE ceil(n / 25) IN (1, 2, ceil(total / 50), ceil(total / 25))""",
)
def range_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2, P5: the first two, the middle and the last page of all orders by price, each a range of the listing built once."""
    path = storage.fresh_folder(spark, "listings")
    pages.build(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], path)
    listed = pages.Pages(spark, path)
    out = None
    for n in sorted({1, 2, listed.count(50), listed.count(25)}):
        one = listed.page(n, 25).select(F.lit(n).cast("long").alias("page"), "o_orderkey", F.lit(listed.total).cast("long").alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "feed_postings",
    """WITH e AS (SELECT n_nationkey AS k, n_name, p_partkey, p_name, p_type, row_number() OVER (PARTITION BY n_nationkey ORDER BY p_partkey) AS position FROM part JOIN nation ON n_nationkey = p_partkey % 25)
    SELECT n_name AS source_id, position, p_name || ' & more' AS title, 'https://feeds.org/' || p_partkey AS source_url, CASE WHEN k % 2 = 0 THEN 'g-' || p_partkey END AS external_id, CAST(NULL AS VARCHAR) AS error
    FROM e WHERE k <> 7 AND (k % 3 = 0 OR contains(lower(p_name), 'ring')) UNION ALL SELECT n_name, NULL, NULL, NULL, NULL, 'Invalid RSS XML' FROM nation WHERE n_nationkey = 7""",
)
def feed_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed for each nation, RSS or Atom by turns and one broken; entries by their sources' rules."""
    k = F.col("n_nationkey")
    p = read(spark, sf_dir, "part").join(read(spark, sf_dir, "nation"), k == F.col("p_partkey") % 25)
    rss = F.concat(F.lit("<item><title>"), "p_name", F.lit(" &amp; more</title><link>/"), F.col("p_partkey").cast("string"), F.lit('</link><guid isPermaLink="false">g-'), F.col("p_partkey").cast("string"), F.lit("</guid><description><![CDATA["), "p_type", F.lit("]]></description></item>"))
    atom = F.concat(F.lit('<entry><title type="text">'), "p_name", F.lit(' &amp; more</title><link href="/'), F.col("p_partkey").cast("string"), F.lit('"/><summary>'), "p_type", F.lit("</summary></entry>"))
    entry = F.struct("p_partkey", F.when(k % 2 == 0, rss).otherwise(atom).alias("xml"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["xml"]), "")
    docs = p.groupBy(F.col("n_name").alias("source_id"), "n_nationkey").agg(whole.alias("all"))
    text = F.when(k == 7, F.concat(F.lit("<rss>"), "all")).when(k % 2 == 0, F.concat(F.lit("<rss><channel>"), "all", F.lit("</channel></rss>"))).otherwise(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), "all", F.lit("</feed>")))
    docs = docs.select("source_id", "n_nationkey", F.lit("https://feeds.org/x").alias("url"), text.alias("document"))
    rules = docs.select("source_id", F.lit("P").alias("publisher"), (k % 3 == 0).alias("accept_all_entries"))
    found = feeds.postings(docs.drop("n_nationkey"), rules, ["Ring"], [])
    return found.select("source_id", "position", "title", "source_url", "external_id", "error")


@query(
    "report_cube",
    """WITH j AS (SELECT o_custkey % 120 AS source_id, c_mktsegment AS category, CASE WHEN c_nationkey % 3 <> 0 THEN 'P' || (c_nationkey % 9) END AS province, o_orderkey % 40 <> 3 OR true AS evidence, o_orderkey % 19 = 0 OR o_orderkey % 17 <> 0 AS explicit, o_orderkey % 41 <> 0 AS open FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT CASE grouping_id(category, source_id, province) WHEN 7 THEN 'all' WHEN 5 THEN 'source' WHEN 3 THEN 'category' WHEN 6 THEN 'province' ELSE 'category_source' END AS cut, category, source_id, province, count(*) AS total, count(*) FILTER (evidence) AS evidence,
      count(*) FILTER (province IS NOT NULL) AS province_known, count(*) FILTER (explicit) AS explicit, count(*) FILTER (NOT explicit AND open) AS policy, count(*) FILTER (NOT explicit AND NOT open) AS unstated
    FROM j GROUP BY GROUPING SETS ((), (source_id), (category), (province), (category, source_id))""",
)
def report_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counts of the coverage report by one pass over the jobs."""
    none = F.lit(None).cast("string")
    j = jobs(spark, sf_dir).withColumns({"major_tags": F.array().cast("array<string>"), "location": none, "country_or_region": none})
    cube = coverage.job_cube(j, j.select("source_id", none.alias("deadline_policy")).distinct(), OPEN_ENDED)
    return cube.select("cut", "category", "source_id", "province", "total", "evidence", "province_known", "explicit", "policy", "unstated")


@query("stream_events", "SELECT user_id, 'created' AS event_type, CAST(max(ts) AS TIMESTAMP) AS occurred_at, arg_max(event_type, ts) AS content FROM events GROUP BY 1")
def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.10: one run of the stateful detection over all events: each user is created with its last type."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    before = spark.conf.get(detector.STORE[0])
    out, check = storage.fresh_folder(spark, "streams"), storage.fresh_folder(spark, "streams")
    try:
        spark.conf.set(*detector.STORE)
        # as a pattern, since a stream's path is a folder and the table may be one file
        told = detector.events(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]"), "user_id", "event_type", "ts")
        told.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(detector.STORE[0], before)
    found = spark.read.schema(told.schema).parquet(out)
    return found.select("user_id", "event_type", F.col("occurred_at").cast("timestamp_ntz").alias("occurred_at"), "content")
