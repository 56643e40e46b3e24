"""Detail pages of several kinds, positions, search results and a whole sync."""

import base64
import zlib

from brightloom.operators import sync
from brightloom.sources import details, html
from pyspark.sql import functions as F

HINTS = "href string, title string, location string, published_date string, document string"


def test_notice_detail(spark):
    page = """<html><head><title>Site</title><meta name="ArticleTitle" content="油田招聘公告"></head><body><nav>x</nav><h1></h1><article><script>s</script>工作地点：西安 岗位职责：勘探。报名截止时间为2026年10月8日。发布时间：2026-09-01
    <a href="apply.html">网上报名</a></article></body></html>"""
    rows = spark.createDataFrame([("https://a.b/n/1.html", "hint", None, None, page), ("https://a.b/n/2.html", "成绩公示", None, None, "<h1>成绩公示</h1>")], HINTS)
    spec = details.Detail(excluded=("公示",), location_label=("工作地点", ("岗位职责",)), employer_markers=("招聘",), least_characters=5)
    (r,) = details.details(rows, spec, F.lit("publisher")).collect()
    assert (r.title, r.employer, r.location, str(r.deadline_date), str(r.published_date)) == ("油田招聘公告", "publisher", "西安", "2026-10-08", "2026-09-01")
    assert r.application_url == "https://a.b/n/apply.html" and r.external_id == "/n/1.html" and r.match_text.startswith("油田招聘公告 工作地点")


def test_packed_detail_with_a_table(spark):
    inner = "view12d <article><table><tr><td>岗位需求：</td><td>地质工程师</td></tr><tr><th>工作地点</th><td>北京 <b>海淀</b></td></tr><tr><td>其他</td><td>x</td></tr><tr><td>职位<td>勘探</table>内容</article>"
    packed = base64.b64encode(zlib.compress(b"mark " + base64.b64encode(inner.encode()))).decode()
    page = f"""<div class="title-message"><h5>某院招聘</h5><span class="name">某院</span></div><script>x(Base64.decode(unzip("{packed}")))</script>"""
    rows = spark.createDataFrame([("https://a.b/1", "hint", None, None, page)], HINTS)
    spec = details.Detail(title=("h5",), employer=(".name",), packed=True, table={"岗位需求": "岗位", "职位": "岗位", "工作地点": "工作地点"}, location_field="工作地点", summary_fields=("岗位", "工作地点"), match_fields=("岗位",))
    r = details.details(rows, spec, F.lit("p")).first()
    assert (r.title, r.employer, r.location, r.summary, r.match_text) == ("某院招聘", "某院", "北京 海淀", "岗位：勘探；工作地点：北京 海淀", "某院招聘 勘探")


def test_search_and_board_details(spark):
    page = "<body>Job Name: Geologist City: Oslo Job Summary: find oil in the north of the country</body>"
    rows = spark.createDataFrame([("https://s/1", "hint", "Oslo, Norway", "2026-01-02", page), ("https://s/2", "hint", "Lima", None, page), ("https://s/3", "hint", None, None, "short")], HINTS)
    spec = details.Detail(title_label=("Job Name", ("City:",)), location_label=("City", ("Job Summary",)), least_characters=30, location_evidence=True)
    got = details.details(rows, spec, F.lit("slb")).collect()
    assert [(r.title, r.location, str(r.published_date)) for r in got] == [("Geologist", "Oslo", "2026-01-02")]
    board = spark.createDataFrame([("https://c/1?id=2", "博士后", "上海", None, "<h1>岗位描述</h1><p>学科领域：地质</p>")], HINTS)
    r = details.details(board, details.Detail(generic_titles=("岗位描述",)), F.lit("cas")).first()
    assert (r.title, r.location, r.external_id) == ("博士后", "上海", "/1?id=2")
    shell = spark.createDataFrame([("https://c/1", "h", None, None, "<div id=content><div class='cookie'>c</div>Text <i class='job-location'>Kuala Lumpur</i></div>")], HINTS)
    r = details.details(shell, details.Detail(title=(".job-title",), content=(".jobDisplay", "#content"), location=(".job-location",), removed=(".cookie",)), F.lit("sf")).first()
    assert (r.title, r.location, r.text) == ("h", "Kuala Lumpur", "h Text Kuala Lumpur")


def test_positions_leave_the_employer_out_of_eligibility(spark):
    schema = "view_id string, title string, url string, published_date string, deadline_date string, position struct<zpdw:string,zpgw:string,zy:string,gwbh:string,gzdd:string>"
    rows = spark.createDataFrame([("v", "公告", "u", None, None, ("地质院", "财务", "会计", "1", None)), ("v", "公告", "u", None, None, (None, "工程师", "地质工程", None, "西安")), ("v", "公告", "u", None, None, ("x", " ", "地质", "3", None))], schema)
    fields = {"employer": "zpdw", "role": "zpgw", "code": "gwbh", "major": "zy", "location": "gzdd"}
    (r,) = details.position_postings(rows, fields, F.col("eligibility").contains("地质"), F.lit("部")).collect()
    assert (r.title, r.external_id, r.location, r.summary) == ("部 - 工程师", "v:工程师", "西安", "岗位：工程师；专业：地质工程；学历：未注明；地点：西安")


def test_candidates_cards_and_detail_pages(spark):
    rows = spark.createDataFrame([("Geologist", "https://a.b/1", None), ("Intern", "https://a.b/2", "k"), ("Geologist", "https://z/3", "k"), (None, None, None)], "t string, u string, k string")
    key = details.candidate_key(F.col("t"), F.col("u"), F.col("k"), F.array(F.lit("a.b")), ["(?i)intern"], ["(?i)geo"])
    assert [r[0] for r in rows.select(key).collect()] == ["https://a.b/1", None, None, None]
    page = "<table><tr><th>Head</th></tr><tr><td><a href='/p/1'>岗位 <b>一</b></a></td><td>北京</td></tr></table>"
    pages = spark.createDataFrame([(1, "https://a.b/list", page), (2, "https://a.b/p/1#x", "<h1>one</h1>")], "id int, url string, html string")
    (card,) = details.row_cards(pages, "id", "html").collect()
    assert (card.title, card.href, card.cells) == ("岗位 一", "/p/1", ["岗位 一", "北京"])
    links = html.notice_links(pages, "id", "html", "url", F.array(F.lit("a.b")), "岗位")
    assert [r.document for r in details.with_detail_pages(links, pages).collect()] == ["<h1>one</h1>"]


def test_a_sync_isolates_sources(spark):
    now = F.lit("2026-01-02").cast("timestamp")
    jobs = spark.createDataFrame([("f1", "h1", "a", "open")], "fingerprint string, content_hash string, source_id string, status string")
    jobs = jobs.withColumns({c: F.lit("2026-01-01").cast("timestamp") for c in ("first_seen_at", "last_seen_at", "updated_at")})
    health = spark.createDataFrame([("b", "source_active", "t0", "t0", 200, "")], "source_id string, status string, checked_at string, last_success_at string, status_code int, detail string")
    sources = spark.createDataFrame([("a", True, 10), ("b", True, None), ("c", True, None), ("d", False, None)], "source_id string, enabled boolean, minimum_relevance int")
    record = "fingerprint string, content_hash string, source_id string, status string, relevance_score int, position int"
    records = spark.createDataFrame([("f1", "h2", "a", "open", 50, 0), ("f2", "h", "a", "open", 5, 1), ("f3", "h", "a", "expired", 60, 2), ("f4", "h", "b", "open", 60, 0), ("f5", "h", "d", "open", 60, 0)], record)
    failures = spark.createDataFrame([("b", False, "timeout"), ("c", True, "robots.txt")], "source_id string, skipped boolean, error string")
    got = sync.sync(jobs, health, sources, records, failures, ["source_id", "status"], now)
    assert {(r.fingerprint, r.outcome) for r in got.jobs.collect()} == {("f1", "updated"), ("f3", "created")}
    assert {(r.fingerprint, r.event_type) for r in got.events.collect()} == {("f1", "updated"), ("f3", "created")}
    runs = {r.source_id: (r.status, r.discovered_count, r.open_matching_count, r.inserted_count, r.updated_count, r.below_minimum_count) for r in got.runs.collect()}
    assert runs == {"a": ("finished", 3, 1, 1, 1, 1), "b": ("failed", 0, 0, 0, 0, 0), "c": ("skipped", 0, 0, 0, 0, 0)}
    assert {(r.source_id, r.status, r.last_success_at is None) for r in got.health.collect()} == {("a", "source_active", False), ("b", "source_error", False), ("c", "source_blocked", True)}
