"""The queries over the driver's tables, by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.functions import dates, profiles, rules, scoring, text, urls
from brightloom.operators import audit, changes, cohort, coverage, listing, normalise, report
from brightloom.sources import html, registries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir), and its SQL if there is any."""

    def register(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return register


VOCABULARY = (("license", 30), ("tion", 12), ("the", 8), ("ing", 6), ("@", 40))


@query(
    "score_band_listing",
    """
    SELECT doc_id, source, score, CASE WHEN score >= 55 THEN 'strong' WHEN score >= 20 THEN 'related' ELSE 'weak' END AS band
    FROM (SELECT doc_id, source, LEAST(58, CASE WHEN contains(lower(text), 'license') THEN 30 ELSE 0 END
        + CASE WHEN contains(lower(text), 'tion') THEN 12 ELSE 0 END + CASE WHEN contains(lower(text), 'the') THEN 8 ELSE 0 END
        + CASE WHEN contains(lower(text), 'ing') THEN 6 ELSE 0 END + CASE WHEN contains(lower(text), '@') THEN 40 ELSE 0 END) AS score
      FROM documents WHERE text IS NOT NULL)
    WHERE score >= 20 ORDER BY score DESC, doc_id LIMIT 50
    """,
)
def score_band_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    score = scoring.weighted_score(F.lower("text"), VOCABULARY, cap=58)
    return (
        docs.select("doc_id", "source", score.alias("score"))
        .filter(F.col("score") >= 20)
        .withColumn("band", scoring.band(F.col("score"), ((55, "strong"), (20, "related")), "weak"))
        .orderBy(F.desc("score"), "doc_id")
        .limit(50)
    )


@query("faceted_page", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice BETWEEN 50000 AND 300000 ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 20")
def faceted_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus")
    o = listing.facet(o, [F.col("o_orderstatus") == "O", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_totalprice").between(50000, 300000), None])
    order = [F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1), F.desc("o_totalprice"), F.col("o_orderkey")]
    return listing.page(o, order, 2, 20).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("facet_counts", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.counts(read(spark, sf_dir, "orders").filter("o_orderstatus = 'O'"), "o_orderpriority")


@query("keyword_search", "SELECT doc_id, source FROM documents WHERE coalesce(text ILIKE '%license%', false) OR coalesce(source ILIKE '%license%', false) OR coalesce(lang ILIKE '%license%', false)")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.keyword_search([F.col("text"), F.col("source"), F.col("lang")], "license")
    return read(spark, sf_dir, "documents").filter(found).select("doc_id", "source")


@query("latest_per_key", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return listing.latest(e, ["user_id"], "event_id")


@query("newest_is_failure", "SELECT user_id, event_id FROM events e WHERE event_type = 'error' AND event_id = (SELECT max(event_id) FROM events x WHERE x.user_id = e.user_id) ORDER BY event_id DESC LIMIT 1000")
def newest_is_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    newest = listing.latest(e, ["user_id"], "event_id").filter("event_type = 'error'")
    return newest.select("user_id", "event_id").orderBy(F.desc("event_id")).limit(1000)


LOCAL_DAY, ZONE = "2024-01-10", "Asia/Shanghai"


def _local_day(events: DataFrame) -> DataFrame:
    start, end = dates.local_day_bounds(LOCAL_DAY, ZONE)
    ts = F.col("ts").cast("timestamp")
    return events.filter((ts >= start) & (ts < end))


_DAY_SQL = "ts >= TIMESTAMP '2024-01-09 16:00:00' AND ts < TIMESTAMP '2024-01-10 16:00:00'"


@query("daily_delta_local_day", f"SELECT event_type, count(*) AS n FROM events WHERE {_DAY_SQL} GROUP BY 1")
def daily_delta_local_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _local_day(read(spark, sf_dir, "events")).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "daily_new_and_updated",
    f"""WITH d AS (SELECT * FROM events WHERE {_DAY_SQL}), new AS (SELECT DISTINCT user_id FROM d WHERE event_type = 'signup')
    SELECT 'new' AS section, count(*) AS n FROM new UNION ALL
    SELECT 'updated', count(*) FROM (SELECT DISTINCT user_id FROM d WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM new))""",
)
def daily_new_and_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, updated = report.split_day(_local_day(read(spark, sf_dir, "events")), "user_id", "signup", "view")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), "n")
    return count(new, "new").unionByName(count(updated, "updated"))


@query("upcoming_window", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders WHERE o_orderstatus = 'O' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1997-03-01' AND DATE '1997-03-08'")
def upcoming_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "open").alias("status"), F.col("o_orderdate").cast("date").alias("deadline_date"))
    return report.upcoming(o, F.lit("1997-03-01").cast("date")).select("o_orderkey", F.col("deadline_date").cast("string").alias("day"))


@query("expire_before", "SELECT CASE WHEN o_orderstatus = 'O' AND CAST(o_orderdate AS DATE) < DATE '1997-01-01' THEN 'expired' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY 1")
def expire_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "O", "open").otherwise(F.col("o_orderstatus")).alias("status"), F.col("o_orderdate").cast("date").alias("deadline_date"), F.lit(None).cast("timestamp").alias("updated_at"))
    day = F.lit("1997-01-01").cast("date")
    done = changes.expire(o, day, day.cast("timestamp"))
    return done.groupBy(F.when(F.col("status") == "open", "O").otherwise(F.col("status")).alias("status")).agg(F.count("*").alias("n"))


@query(
    "top_source_concentration",
    """WITH n AS (SELECT lang, coalesce(source, 'unknown') AS top_key, count(*) AS n FROM documents GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, top_key) AS r, sum(n) OVER (PARTITION BY lang) AS total FROM n)
    SELECT lang, top_key, n AS top_count, total::BIGINT AS total, round(n / total, 4) AS share,
      CASE WHEN round(n / total, 4) >= 0.5 THEN 'high' WHEN round(n / total, 4) >= 0.3 THEN 'watch' ELSE 'balanced' END AS risk FROM r WHERE r = 1""",
)
def top_source_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.concentration(read(spark, sf_dir, "documents"), ["lang"], "source")


@query(
    "field_completeness",
    """WITH d AS (SELECT lang, quality, text FROM documents LEFT JOIN labels USING (doc_id))
    SELECT lang, 'label' AS field, count(*) AS total, count(quality) AS complete, round(count(quality) / count(*), 4) AS share FROM d GROUP BY lang UNION ALL
    SELECT lang, 'text', count(*), count(*) FILTER (trim(text) <> ''), round(count(*) FILTER (trim(text) <> '') / count(*), 4) FROM d GROUP BY lang""",
)
def field_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return listing.completeness(d, ["lang"], {"label": F.col("quality").isNotNull(), "text": F.trim("text") != ""})


@query("missing_health", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def missing_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.without_health(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id")


@query("content_fingerprint_dups", r"SELECT fingerprint, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))) AS fingerprint FROM documents) GROUP BY 1 HAVING count(*) > 1")
def content_fingerprint_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", text.stable_hash(F.col("text")).alias("fingerprint"))
    return d.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@query(
    "alias_contains_join",
    """SELECT doc_id, item_id, alias FROM (SELECT d.doc_id, b.item_id, b.alias, row_number() OVER (PARTITION BY d.doc_id ORDER BY length(b.alias) DESC, b.item_id) AS r
    FROM documents d JOIN (SELECT item_id, text AS alias FROM benchmark) b ON contains(d.text, b.alias)) WHERE r = 1""",
)
def alias_contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("alias"))
    return listing.longest_containing(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", aliases, "alias", ["doc_id"], "item_id")


@query(
    "url_normalise",
    r"""WITH p AS (SELECT page_id, split_part(url, '#', 1) AS u FROM pages), s AS (SELECT page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
      lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)) AS host, regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/{2,}', '/', 'g') AS path,
      array_to_string(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda k: k <> '' AND NOT regexp_matches(lower(k), '^(utm_|spm|from)')), '&') AS q FROM p)
    SELECT page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS url FROM s""",
)
def url_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", urls.normalize(F.col("url")).alias("url"))


HOSTS = ("therha.example.com", "m.therou.example.com", "blog.thernd.example.net", "spam-farm.example.org")


@query("host_allowlist", "SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) IN ('" + "', '".join(HOSTS) + "') AS allowed, count(*) AS n FROM pages GROUP BY 1, 2")
def host_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = urls.host_allowed(F.col("url"), F.array(*[F.lit(h) for h in HOSTS]))
    return read(spark, sf_dir, "pages").groupBy(urls.host(F.col("url")).alias("host"), allowed.alias("allowed")).agg(F.count("*").alias("n"))


@query("json_payload_counts", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_payload_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = registries.json_value(F.col("props"), "k").cast("long")
    return read(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"))


@query(
    "dense_role_grid",
    """SELECT r_name, p.o_orderpriority, coalesce(n, 0) AS n FROM region CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) p LEFT JOIN
    (SELECT r_name, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
     WHERE o_totalprice > 300000 GROUP BY 1, 2) f USING (r_name, o_orderpriority)""",
)
def dense_role_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: read(spark, sf_dir, n)
    o = t("orders").select("o_custkey", "o_orderpriority", "o_totalprice")
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    large = o.filter("o_totalprice > 300000").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    facts = large.groupBy("r_name", "o_orderpriority").agg(F.count("*").alias("n"))
    grid = listing.dense_grid(t("region").select("r_name"), o.select("o_orderpriority").distinct(), facts, ["r_name", "o_orderpriority"])
    return grid.select("r_name", "o_orderpriority", F.coalesce("n", F.lit(0)).alias("n"))


@query("snapshot_trend", "SELECT CAST(day AS VARCHAR) AS day, n, coalesce(n - lag(n) OVER (ORDER BY day), 0)::BIGINT AS change FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)")
def snapshot_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = read(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    found = coverage.trend(daily, "day", "n")
    return found.select(F.col("day").cast("string").alias("day"), "n", F.coalesce("change", F.lit(0)).alias("change"))


@query(
    "cohort_simulation",
    """WITH p AS (SELECT * FROM (VALUES ('a', 40, 2), ('b', 14, 1), ('c', 6, 3)) t(profile, members, least)), m AS (SELECT o_orderkey, o_totalprice, CAST(left(o_orderpriority, 1) AS INT) AS r FROM orders)
    SELECT profile, members::BIGINT AS members, count(*) FILTER (r <= least) AS explicit, count(*) FILTER (r > least AND o_totalprice > 200000) AS review, (members * count(*) FILTER (r <= least))::BIGINT AS weighted FROM p CROSS JOIN m GROUP BY profile, members""",
)
def cohort_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.simulate(
        read(spark, sf_dir, "orders").select(F.substring("o_orderpriority", 1, 1).cast("int").alias("r"), "o_totalprice"),
        {"a": 40, "b": 14, "c": 6}, {"a": F.col("r") <= 2, "b": F.col("r") <= 1, "c": F.col("r") <= 3}, F.col("o_totalprice") > 200000,
    )


@query(
    "change_detection",
    """SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'created' WHEN o_orderkey % 7 = 0 THEN 'updated' ELSE 'unchanged' END AS outcome FROM orders) GROUP BY 1""",
)
def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    content = lambda price: text.stable_hash(F.col("o_orderstatus"), price.cast("string"))
    stamp = F.lit("2020-01-01").cast("timestamp")
    state = o.filter("o_orderkey % 10 <> 0").select("o_orderkey", content(F.col("o_totalprice")).alias("content_hash"), "o_orderpriority", stamp.alias("first_seen_at"), stamp.alias("last_seen_at"), stamp.alias("updated_at"))
    batch = o.select("o_orderkey", content(F.col("o_totalprice") + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0)).alias("content_hash"), "o_orderpriority")
    result, _ = changes.detect(state, batch, "o_orderkey", "content_hash", ["o_orderpriority"], F.lit("2020-02-01").cast("timestamp"))
    return result.groupBy("outcome").agg(F.count("*").alias("n"))


@query("title_extraction", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def title_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query("link_extraction", """SELECT page_id, i::BIGINT AS position, hrefs[i] AS href FROM (SELECT page_id, hrefs, unnest(range(1, len(hrefs) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1) AS hrefs FROM pages))""")
def link_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.links(read(spark, sf_dir, "pages"), "page_id", "html")


@query("registry_union_dups", "SELECT name, count(*) AS n FROM (SELECT r_name AS name FROM region UNION ALL SELECT p_type FROM part UNION ALL SELECT p_name FROM part) GROUP BY 1 HAVING count(*) > 1")
def registry_union_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return registries.duplicates([read(spark, sf_dir, "region").select(F.col("r_name").alias("name")), p.select(F.col("p_type").alias("name")), p.select(F.col("p_name").alias("name"))], "name")


@query(
    "taxonomy_cascade",
    """SELECT c_custkey, CASE WHEN contains(c_mktsegment, 'AUTO') OR contains(c_mktsegment, 'MACH') THEN 'industry' WHEN contains(c_mktsegment, 'BUILD') THEN 'building' ELSE 'other' END AS category,
    CASE WHEN contains(r_name, 'AMERICA') THEN 'west' WHEN contains(r_name, 'ASIA') THEN 'east' ELSE r_name END AS place FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def taxonomy_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    c = read(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    category = rules.first_match(F.col("c_mktsegment"), (("industry", ("AUTO", "MACH")), ("building", ("BUILD",))), F.lit("other"))
    return c.select("c_custkey", category.alias("category"), rules.first_match(F.col("r_name"), (("west", ("AMERICA",)), ("east", ("ASIA",))), F.col("r_name")).alias("place"))


@query(
    "degree_rank_match",
    """WITH d AS (SELECT c_custkey, c_mktsegment, CASE WHEN left(o_orderpriority, 1) IN ('1', '2') THEN 3 WHEN left(o_orderpriority, 1) = '3' THEN 2 ELSE 1 END AS r FROM customer JOIN orders ON o_custkey = c_custkey),
    m AS (SELECT c_custkey, c_mktsegment, list(DISTINCT r) AS rs, min(r) AS least, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 3 ELSE 2 END AS own FROM d GROUP BY 1, 2)
    SELECT c_mktsegment, CASE WHEN list_contains(rs, own) THEN 'explicit' WHEN own < least THEN 'blocked' ELSE 'review' END AS status, count(*) AS n FROM m GROUP BY 1, 2""",
)
def degree_rank_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.substring("o_orderpriority", 1, 1)
    degree = F.when(first.isin("1", "2"), "博士").when(first == "3", "硕士").otherwise("本科")
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(degree).alias("listed"))
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(o, F.col("c_custkey") == F.col("o_custkey"))
    own = F.when(F.col("c_mktsegment") == "BUILDING", "本科").when(F.col("c_mktsegment") == "MACHINERY", "博士").otherwise("硕士")
    return c.groupBy("c_mktsegment", profiles.degree_status(F.col("listed"), own).alias("status")).agg(F.count("*").alias("n"))


@query(
    "deadline_extraction",
    """WITH o AS (SELECT o_orderkey AS id, o_orderkey % 7 AS k, CAST(o_orderdate + INTERVAL 30 YEAR AS DATE) AS d FROM orders)
    SELECT id, CAST(CASE k WHEN 0 THEN d + 10 WHEN 1 THEN d + 20 WHEN 2 THEN make_date(year(d), month(d + 5), day(d + 5)) WHEN 3 THEN d - 12 WHEN 4 THEN d WHEN 5 THEN d END AS VARCHAR) AS deadline,
      CAST(CASE WHEN k IN (1, 2, 5, 6) THEN d END AS VARCHAR) AS published FROM o""",
)
def deadline_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 7).alias("k"), F.add_months(F.col("o_orderdate").cast("date"), 360).alias("d"))
    day = lambda n=0, form="yyyy年M月d日": F.date_format(F.date_add("d", n), form)
    notices = (
        ("报名时间：自公告发布之日起至", day(10), "止。第一批次：报名截止时间为", day()), ("报名时间：", day(form="yyyy.MM.dd"), "-", day(20, "yyyy.MM.dd"), "，请投递"), ("网上报名时间：", day(), "9:00至", day(5, "M月d日"), "17:00。"),
        ("会议时间", day(), "至", day(2), "，报名截止", day(-12)), ("招聘公告 过期时间：", day(form="yyyy-MM-dd")), ("Application deadline: ", day(form="MMMM d, yyyy")), ("发布时间：", day(form="yyyy-MM-dd"), " 地点另行通知"),
    )
    notice = F.lit(None).cast("string")
    for i, parts in enumerate(notices):
        notice = F.when(F.col("k") == i, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])).otherwise(notice)
    o = o.withColumn("notice", notice)
    return o.select("id", dates.deadline(F.col("notice")).cast("string").alias("deadline"), dates.published(F.col("notice")).cast("string").alias("published"))


@query(
    "keyed_upsert",
    """SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.v ELSE o.v END AS v, coalesce(o.made, n.made) AS made FROM
    (SELECT s_suppkey AS k, s_name AS v, 1 AS made FROM supplier WHERE s_suppkey % 3 <> 0) o FULL JOIN (SELECT s_suppkey AS k, s_name || '*' AS v, 2 AS made FROM supplier WHERE s_suppkey % 2 = 0) n USING (k)""",
)
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    old, new = s.filter("k % 3 <> 0").withColumn("made", F.lit(1)), s.filter("k % 2 = 0").withColumns({"v": F.concat("v", F.lit("*")), "made": F.lit(2)})
    return changes.upsert(old, new, "k", ["made"])


@query("frozen_insert", "SELECT day, max(n) AS n FROM (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1) GROUP BY day")
def frozen_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = read(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").cast("string").alias("day")).agg(F.count("*").alias("n"))
    again = daily.withColumn("n", F.col("n") - 1)
    return changes.insert_absent(daily.filter("substr(day, 10, 1) <> '5'"), daily.filter("substr(day, 10, 1) = '5'").unionByName(again.filter("substr(day, 10, 1) <> '5'")), "day")


@query("cascade_delete", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    _, lines = changes.delete_cascade(o, read(spark, sf_dir, "lineitem").select("l_orderkey"), "l_orderkey", F.col("o_orderstatus") == "F")
    return lines.groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query(
    "reclassified_events",
    """SELECT c_custkey, 'reclassified' AS event_type FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal < 0""",
)
def reclassified_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("category"), F.when(F.col("c_acctbal") < 0, F.lit(None)).otherwise(1).alias("score"))
    after = before.withColumns({"category": F.when(F.col("category") == "BUILDING", "HOUSE").otherwise(F.col("category")), "score": F.lit(1)})
    return changes.reclassified(before, after, "c_custkey", ["category", "score"], F.lit("2026-01-01").cast("timestamp")).select("c_custkey", "event_type")


@query(
    "profile_page",
    """SELECT o_orderkey AS id, priority, relevance_score FROM (SELECT o_orderkey, CAST(o_totalprice / 10000 AS INT) AS relevance_score, CAST(o_orderdate AS DATE) AS d,
      CASE WHEN o_orderstatus = 'O' THEN 3 WHEN o_orderstatus = 'P' THEN 2 ELSE 0 END AS priority FROM orders) WHERE priority > 0 ORDER BY priority DESC, relevance_score DESC, d, id LIMIT 25""",
)
def profile_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") / 10000).cast("int").alias("relevance_score"), F.col("o_orderdate").cast("date").alias("deadline_date"), F.lit(None).cast("string").alias("updated_at"), "o_orderstatus"
    )
    level = F.when(F.col("o_orderstatus") == "O", "explicit").when(F.col("o_orderstatus") == "P", "review").otherwise("not_recommended")
    priority = F.when(level == "explicit", 3).when(level == "review", 2).otherwise(0)
    return normalise.profile_page(o, level, priority, 1, 25).select("id", "priority", "relevance_score")


@query(
    "shared_urls",
    """SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1 AND NOT bool_and(l_returnflag = 'N')""",
)
def shared_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_returnflag") == "N").alias("allowed"))
    return audit.shared_urls(lines, "l_partkey", "allowed")


@query("report_order", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderdate NULLS FIRST, o_orderkey LIMIT 6")
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return o.orderBy(*report.order(("o_totalprice", "o_orderdate", "o_orderkey"))).limit(6).select("o_orderkey")


@query(
    "day_report_stats",
    f"""WITH d AS (SELECT * FROM events WHERE {_DAY_SQL}), new AS (SELECT DISTINCT user_id FROM d WHERE event_type = 'signup'), up AS (SELECT DISTINCT user_id FROM d WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM new))
    SELECT (SELECT count(*) FROM new) AS new_jobs, (SELECT count(*) FROM up) AS updated_jobs, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1997-03-01' AND DATE '1997-03-08') AS upcoming_deadlines,
      (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_jobs""",
)
def day_report_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, updated = report.split_day(_local_day(read(spark, sf_dir, "events")), "user_id", "signup", "view")
    o = read(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "O", "open").alias("status"), F.col("o_orderdate").cast("date").alias("deadline_date"))
    return report.stats(new, updated, report.upcoming(o, F.lit("1997-03-01").cast("date")), o.filter("status = 'open'"))
