"""Queries of job boards: documents that Spark makes of the driver's tables, read back by the readers of their type of source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom import storage
from brightloom.plans.catalog import query, read
from brightloom.sources import boards, details


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _object(**fields: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _in_order(key: str, item: Column) -> Column:
    """A small group's items by their key, as an array."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), item.alias("v")))), lambda x: x["v"])


@query(
    "announcement_positions",
    """WITH o AS (SELECT *, CAST(o_custkey % 8 AS VARCHAR) AS source_id FROM orders WHERE o_orderkey % 7 <> 3),
      l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2),
      p AS (SELECT source_id, o_custkey, o_orderkey, l_linenumber AS nr, o_orderkey || ':' || CASE WHEN l_linenumber % 3 = 0 THEN 'm' ELSE 'c' END || l_linenumber AS external_id, 'Maker ' || l_suppkey || ' - ' || CASE WHEN l_returnflag = 'R' THEN 'Return of ' ELSE 'Part ' END || l_partkey AS title, 'Maker ' || l_suppkey AS employer,
          CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS location, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS published_date FROM o JOIN l ON l_orderkey = o_orderkey WHERE o_orderkey % 5 <> 0 AND (l_returnflag = 'R' OR l_linestatus = 'F' AND l_quantity > 25)),
      f AS (SELECT source_id, o_custkey, o_orderkey, 0 AS nr, CAST(o_orderkey AS VARCHAR) AS external_id, 'Order of ' || o_orderstatus AS title, o_orderpriority AS employer, CAST(NULL AS VARCHAR) AS location, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS published_date
          FROM o WHERE (o_orderkey % 5 = 0 OR o_orderkey NOT IN (SELECT l_orderkey FROM l)) AND contains(o_orderpriority, 'HIGH'))
    SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY o_custkey, o_orderkey, nr) AS position, external_id, title, employer, location, published_date FROM (SELECT * FROM p UNION ALL SELECT * FROM f)""",
)
def announcement_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders are a listing, an order an announcement, its lines the positions; every fifth order has none, every seventh no detail."""
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").withColumns({"source_id": _text(F.col("o_custkey") % 8), "day": F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")})
    listing = _in_order("o_orderkey", _object(ViewId=_text(k), Title=F.concat(F.lit("Order of "), "o_orderstatus"), FbDate=F.lit("1990-01-01")))
    lists = o.groupBy("source_id", "o_custkey").agg(F.to_json(_object(items=listing)).alias("document")).select("source_id", F.col("o_custkey").cast("long").alias("position"), F.concat(F.lit("https://o.org/GetAfficheList?c="), _text("o_custkey")).alias("url"), "document")
    detail = F.when(k % 7 == 3, "[]").otherwise(F.to_json(_object(Fbdw=F.col("o_orderpriority"), FbDate=F.col("day"), AnncCont=F.concat(F.lit("<p>priority <b>"), "o_orderpriority", F.lit("</b></p>")))))
    infos = o.select("source_id", F.lit(1).cast("long").alias("position"), F.concat(F.lit("https://o.org/GetAfficheInfo?viewId="), _text(k)).alias("url"), detail.alias("document"))
    n = F.col("l_linenumber")
    status = F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 25), "finished").otherwise("")
    line = _object(zpdw=F.concat(F.lit("Maker "), _text("l_suppkey")), zpgw=F.concat(F.when(F.col("l_returnflag") == "R", "Return of ").otherwise("Part "), _text("l_partkey")), gwbh=F.when(n % 3 != 0, F.concat(F.lit("c"), _text(n))), gwbm=F.concat(F.lit("m"), _text(n)), remark=status, gzdd=F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")))
    once = read(spark, sf_dir, "lineitem").filter("l_orderkey % 5 <> 0").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey")], *[F.max(c).alias(c) for c in ("l_returnflag", "l_linestatus", "l_quantity")])
    lines = once.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(_in_order("l_linenumber", line).alias("items"))
    held = o.select("source_id", "o_orderkey").join(lines, "o_orderkey", "left")
    document = F.coalesce(F.to_json(F.when(F.col("items").isNotNull(), F.struct("items"))), F.lit('{"items":[]}'))
    positions = held.select("source_id", F.lit(1).cast("long").alias("position"), F.concat(F.lit("https://o.org/GetPostSelectFyList?viewId="), _text(k)).alias("url"), document.alias("document"))
    docs = storage.stored(lists.unionByName(infos).unionByName(positions))
    rules = spark.range(8).select(_text("id").alias("source_id"), F.lit("P").alias("publisher"), F.lit("https://o.org/d").alias("public_detail_url"))
    found = boards.announcements(rules, ["return", "high"], ["finished"])(docs)
    return found.filter("error IS NULL").select("source_id", "position", "external_id", "title", "employer", "location", "published_date")


@query(
    "encrypted_portal",
    """WITH c AS (SELECT *, c_custkey % 2 = 0 AND c_custkey % 6 <> 0 AS detailed FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey % 10 <> 4)
    SELECT n_name AS source_id, row_number() OVER (PARTITION BY n_name ORDER BY c_custkey // 50, c_custkey) AS position, CAST(c_custkey AS VARCHAR) AS external_id, CASE WHEN detailed THEN 'Detailed ' ELSE '' END || c_name AS title,
      CASE WHEN detailed THEN n_name || '、' ELSE '' END || 'City ' || c_custkey % 5 AS location, CASE WHEN detailed THEN '2028-03-0' || (1 + c_custkey % 9) END AS published_date, '所属部门：' || c_mktsegment || '；工作地点：' || CASE WHEN detailed THEN n_name || '、' ELSE '' END || 'City ' || c_custkey % 5 || '；' || CASE WHEN detailed THEN 'work of ' || c_custkey ELSE '' END AS summary
    FROM c UNION ALL SELECT n_name, NULL, NULL, 'public page is missing its vector', NULL, NULL, NULL FROM nation WHERE n_nationkey < 0""",
)
def encrypted_portal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are jobs, fifty at most a list, a portal for each nation with a vector of its own; every second has a detail, of which a third can't be decrypted."""
    k = F.col("c_custkey")
    nation = read(spark, sf_dir, "nation")
    portals = nation.groupBy("n_name").agg(F.lpad(_text(F.min("n_nationkey")), 16, "0").alias("iv"))  # nations of one name are one portal
    c = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(portals, "n_name").withColumn("source_id", F.col("n_name"))
    key = "0123456789abcdef"

    def sealed(clear: Column, broken: Column) -> Column:
        whole = F.aes_encrypt(clear, F.lit(key), F.lit("CBC"), F.lit("PKCS"), F.col("iv").cast("binary"))
        data = F.base64(F.substring(whole, 17, 2_000_000_000))
        return F.to_json(_object(data=F.when(broken, F.lit("AAAA")).otherwise(F.regexp_replace(data, r"\s", "")), necromancer=F.lit(key)))

    fronts = c.groupBy("source_id").agg(F.first("iv").alias("iv"))
    fronts = fronts.select("source_id", F.lit(0).cast("long").alias("position"), F.lit("https://m.org/jobs").alias("url"), F.concat(F.lit("<input id='init-data' value='{&quot;aesIv&quot;:&quot;"), "iv", F.lit("&quot;}'>")).alias("document"))
    job = _object(id=_text(k), title=F.col("c_name"), department=_object(name=F.col("c_mktsegment")), city=F.concat(F.lit("City "), _text(k % 5)))
    lists = c.groupBy("source_id", "iv", F.floor(k / 50).alias("page")).agg(_in_order("c_custkey", job).alias("jobs"))
    clear = F.to_json(_object(success=F.lit(True), data=F.struct("jobs")))
    lists = lists.select("source_id", (F.col("page") + 1).cast("long").alias("position"), F.concat(F.lit("https://m.org/website/jobs/v2?page="), _text("page")).alias("url"), sealed(clear, F.lit(False)).alias("document"))
    about = F.when(k % 10 == 4, "trainee").otherwise(F.concat(F.lit("<p>work of <b>"), _text(k), F.lit("</b></p>")))
    more = _object(title=F.concat(F.lit("Detailed "), "c_name"), locations=F.array(F.array(_object(name=F.col("n_name")))), publishedAt=F.concat(F.lit("2028-03-0"), _text(1 + k % 9), F.lit("T10:00")), jobDescription=about)
    pages = c.filter(k % 2 == 0).select("source_id", F.lit(1).cast("long").alias("position"), F.concat(F.lit("https://m.org/website/job?jobId="), _text(k)).alias("url"), sealed(F.to_json(_object(data=more)), (k % 6 == 0) & (k % 10 != 4)).alias("document"))
    docs = storage.stored(fronts.unionByName(lists).unionByName(pages))
    rules = portals.select(F.col("n_name").alias("source_id"), F.lit("P").alias("publisher"), F.lit("https://m.org/jobs").alias("listing_url"), F.array(F.lit("building"), F.lit("machinery")).alias("include_patterns"), F.array(F.lit("TRAINEE")).alias("detail_exclude_patterns"))
    found = boards.encrypted_jobs(rules, [])(docs)
    return found.select("source_id", "position", "external_id", F.coalesce("title", "error").alias("title"), "location", "published_date", "summary")


@query(
    "search_result_pages",
    """WITH p AS (SELECT *, p_partkey // 40 AS page, p_partkey // 40 % 4 AS s FROM part WHERE NOT contains(lower(p_name), 'bolt')), r AS (SELECT *, s < 2 AND p_partkey % 2 = 0 AS own FROM p)
    SELECT CAST(s AS VARCHAR) AS source_id, row_number() OVER (PARTITION BY s ORDER BY page, p_partkey) AS position, CASE WHEN own THEN 'Whole ' ELSE '' END || p_name AS title, CASE WHEN own THEN p_type ELSE p_brand END AS location, 'https://r.org/job/' || p_partkey AS source_url,
      '/job/' || p_partkey AS external_id, CASE WHEN own THEN '2026-12-0' ELSE '2027-01-0' END || (1 + p_partkey % 9) AS deadline_date FROM r""",
)
def search_result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are rows of result pages, forty at most; two of four sources read the parts' own pages, which every second part has."""
    k = F.col("p_partkey")
    p = read(spark, sf_dir, "part").withColumns({"page": F.floor(k / 40), "source_id": _text(F.floor(k / 40) % 4)})
    row = F.concat(F.lit('<tr class="data-row"><td><a class="jobTitle-link" href="/job/'), _text(k), F.lit('">'), "p_name", F.lit('</a></td><td><span class="jobLocation">'), "p_brand", F.lit("</span> apply by January "), _text(1 + k % 9), F.lit(", 2027</td></tr>"))
    pages = p.groupBy("source_id", "page").agg(F.concat(F.lit("<table>"), F.array_join(_in_order("p_partkey", row), ""), F.lit("</table>")).alias("document"))
    pages = pages.select("source_id", F.col("page").cast("long").alias("position"), F.concat(F.lit("https://r.org/search/?q=parts&page="), _text("page")).alias("url"), "document")
    own = F.concat(F.lit("<h1>Whole "), "p_name", F.lit('</h1><div id="content">made well. Deadline: December '), _text(1 + k % 9), F.lit(', 2026 <i class="place">'), "p_type", F.lit("</i></div>"))
    jobs = p.filter(k % 2 == 0).select("source_id", F.lit(1).cast("long").alias("position"), F.concat(F.lit("https://r.org/job/"), _text(k)).alias("url"), own.alias("document"))
    docs = storage.stored(pages.unionByName(jobs))
    rules = spark.range(4).select(_text("id").alias("source_id"), F.lit("P").alias("publisher"), F.lit("https://r.org/search").alias("search_url"), (F.col("id") < 2).alias("fetch_detail_pages"))
    found = boards.result_rows(rules, details.Detail(content=("#content",), location=(".place",), excluded=("bolt",)))(docs)
    return found.select("source_id", "position", "title", "location", "source_url", "external_id", "deadline_date")
