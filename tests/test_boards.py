"""Job boards of five kinds, from captured documents to postings."""

import base64
import json

import pytest
from brightloom.sources import boards, details, html, nested, portals
from pyspark.sql import functions as F

RULE = "source_id string, publisher string"


def captured(spark, source, *pages):
    return spark.createDataFrame([(source, i, u, d if isinstance(d, str) else json.dumps(d, ensure_ascii=False)) for i, (u, d) in enumerate(pages, 1)], "source_id string, position long, url string, document string")


def rows(found):
    kept = sorted(found.collect(), key=lambda r: (r.error is not None, r.source_id, r.position or 0, r.error or ""))
    return [r for r in kept if r.error is None], [(r.source_id, r.error) for r in kept if r.error is not None]


API = "https://x.org/api/Affiche"


def announcement(key, title="公告", positions=(), body="<p>招聘&amp;地质</p>", **more):
    return [(f"{API}/GetAfficheInfo?viewId={key}", {"Fbdw": "部属单位", "BmjsDate": "2026-12-31T17:00:00", "AnncCont": body} | more), (f"{API}/GetPostSelectFyList?viewId={key}", {"items": list(positions)})]


def test_announcements_with_positions_or_by_themselves(spark):
    jobs = [{"gwbm": "G-1", "zpdw": "测试中心", "zpgw": "地质岗", "zy": "地质工程", "xwxlyq": "硕士", "gzdd": "克拉玛依"}, {"gwbm": "G-2", "zpdw": "地质中心", "zpgw": "财务岗", "zy": "会计"}, {"gwbm": "G-1", "zpgw": "地质岗 again"}, "no object", {"zpgw": "  "}, {"zpgw": "地质二"}]
    listing = {"items": [{"ViewId": "n1", "Title": "公开招聘", "FbDate": "2026-09-18T10:00:00"}, {"ViewId": "n1", "Title": "twice"}, {"ViewId": "", "Title": "no key"}, 5, {"ViewId": "n2", "Title": "地质招聘"}, {"ViewId": "n3", "Title": "only a list"}, {"ViewId": "n4", "Title": "other things"}]}
    docs = captured(spark, "s", (f"{API}/GetAfficheList", listing), *announcement("n1", positions=jobs), *announcement("n2", FbDate="2026-01-02"), (f"{API}/GetAfficheInfo?viewId=n3", "[]"), (f"{API}/GetPostSelectFyList?viewId=n3", {"items": []}), *announcement("n4", body="nothing"))
    rules = spark.createDataFrame([("s", "部", "https://x.org/#/d", True)], RULE + ", public_detail_url string, require_major_match boolean")
    found, errors = rows(boards.announcements(rules, ["招聘"], ["地质"])(docs))
    assert not errors and [(r.position, r.external_id, r.title, r.employer) for r in found] == [(1, "n1:G-1", "测试中心 - 地质岗", "测试中心"), (2, "n1:地质二", "部 - 地质二", "部"), (3, "n2", "地质招聘", "部属单位")]
    assert (found[0].location, found[0].deadline_date, found[0].published_date, found[0].source_url) == ("克拉玛依", "2026-12-31", "2026-09-18", "https://x.org/#/d?ViewId=n1")
    assert "地质工程" in found[0].match_text and found[2].text == "招聘&地质" and found[2].published_date == "2026-01-02"
    # a limit counts postings, and what lies behind the last one need not be there
    two = spark.createDataFrame([("s", "部", "u", 2)], RULE + ", public_detail_url string, max_items int")
    partly = docs.filter("url NOT LIKE '%n2'")
    found, errors = rows(boards.announcements(two, ["招聘"], ["地质"])(partly))
    assert [r.external_id for r in found] == ["n1:G-1", "n1:地质二"] and not errors
    assert rows(boards.announcements(rules, ["招聘"], ["地质"])(partly))[1] == [("s", "announcement n2 was not captured whole")]
    bad = captured(spark, "s", (f"{API}/GetAfficheList", {"items": 5}), (f"{API}/GetAfficheInfo?viewId=q", "oops"), (f"{API}/GetPostSelectFyList?viewId=q", "[1]"))
    assert rows(boards.announcements(rules, [], [])(bad)) == ([], [("s", "announcement detail is not valid JSON"), ("s", "listing does not contain a list of items"), ("s", "position list is not valid JSON")])


def page(n, city="Tashkent, Uzbekistan"):
    return f"<body>Job Name: Geologist {n} City: {city} Nationality: any Job Summary: Interpret seismic data for reservoirs. Requirements: Bachelor's degree in Geology.</body>"


def result(n, city="Tashkent", country="Uzbekistan", title="Geologist", host="c.org", **more):
    return {"title": f"{title} {n}", "clickUri": f"https://{host}/d?id={n}", "raw": {"sysurihash": f"k{n}", "city": city, "country": [country]} | more}


DETAIL = details.Detail(title_label=("Job Name", ("City:",)), location_label=("City", ("Nationality",)), required=("geolog",), least_characters=80, location_evidence=True)


def test_searches_count_a_result_once_and_keep_what_its_page_confirms(spark):
    first = {"results": [result(1, jobposteddate=1789543483000), result(2, "Multi-Location", "China"), {"title": "no address"}, result(9, title="Driver"), result(8, host="elsewhere.org")]}
    second = {"results": [result(1), result(3, "Multi-Location", ""), result(4), result(5), {"raw": {"title": "Geologist raw", "uri": "https://c.org/d?id=6"}}]}
    pages = [(f"https://c.org/d?id={n}", page(n, "Luanda, Angola") if n == 2 else page(n)) for n in (1, 2, 3, 4, 6)]
    docs = captured(spark, "s", ("https://api.org/rest/search/v2?q=a", first), ("https://api.org/rest/search/v2?q=b", second), *pages)
    rules = spark.createDataFrame([("s", "P", ["c.org"])], RULE + ", allowed_hosts array<string>")
    found, errors = rows(boards.searches(rules, DETAIL, "/search/v2")(docs))
    assert not errors and [(r.position, r.title, r.external_id, r.location) for r in found] == [(1, "Geologist 1", "k1", "Tashkent, Uzbekistan"), (2, "Geologist 3", "k3", "Tashkent, Uzbekistan"), (3, "Geologist 4", "k4", "Tashkent, Uzbekistan"), (4, "Geologist 6", "https://c.org/d?id=6", "Tashkent, Uzbekistan")]
    assert (found[0].published_date, found[0].application_url) == ("2026-09-16", "https://c.org/d?id=1")
    bounded = rules.withColumns({"max_items": F.lit(5), "max_detail_candidates": F.lit(3)})
    assert [r.title for r in rows(boards.searches(bounded, DETAIL, "/search/v2")(docs))[0]] == ["Geologist 1", "Geologist 3"]
    unread, _ = rows(boards.searches(rules.withColumn("fetch_detail_pages", F.lit(False)), DETAIL, "/search/v2")(docs))
    assert [(r.title, r.location, r.match_text) for r in unread[:2]] == [("Geologist 1", "Tashkent, Uzbekistan", "Geologist 1"), ("Geologist 2", "Multi-Location, China", "Geologist 2")] and len(unread) == 6
    assert rows(boards.searches(rules, DETAIL, "/search/v2")(captured(spark, "s", ("https://api.org/search/v2", "x"))))[1] == [("s", "search response is not valid JSON")]


def test_cards_take_employer_and_place_from_their_row(spark):
    board = "<table><tr><td><a href='/r/to.do?id=1'>地质 助理</a></td><td>某所</td><td>北京</td></tr><tr><td><a title='物探' href='/r/to.do?id=2'>x</a></td></tr><tr><td><a href='/r/to.do?id=1'>again</a><a href='/about'>about</a></td></tr></table><a href='/r/to.do?id=3'>free</a>"
    docs = captured(spark, "s", ("http://b.cn/", board), ("http://b.cn/r/to.do?id=1", "<h2>岗位描述</h2><main>工作地点：上海 学历要求：硕士 招聘人数：2 发布时间：2026年09月15日 截止时间：2026年10月30日 学科领域：地质</main>"), ("http://b.cn/r/to.do?id=2", "<main>y</main>"), ("http://b.cn/r/to.do?id=3", "<main>z</main>"))
    rules = spark.createDataFrame([("s", "院", "http://b.cn/", 2)], RULE + ", listing_url string, max_items int")
    spec = details.Detail(title=("h1", "h2"), generic_titles=("岗位描述",), location_label=("工作地点", ("学历要求",)))
    found, errors = rows(boards.cards(rules, spec, "a[href*='to.do'][href*='id=']")(docs))
    assert not errors and [(r.title, r.employer, r.location) for r in found] == [("地质 助理", "某所", "上海"), ("物探", "院", None)]
    assert (found[0].published_date, found[0].deadline_date, found[0].application_url) == ("2026-09-15", "2026-10-30", "http://b.cn/r/to.do?id=1")
    with pytest.raises(ValueError):
        boards.linked_rows(F.col("document"), "a[")


def test_result_rows_with_pages_or_by_themselves(spark):
    row = lambda n, title: f'<tr class="data-row x"><td><a class="jobTitle-link" href="/job/{n}/">{title}</a><a class="jobTitle-link" href="/job/{n}b/">short</a></td><td class="colLocation"><span class="jobLocation">Houston, TX</span></td></tr>'
    first = "<table>" + row(1, "Geologist") + row(2, "Software") + '<tr><td><a class="jobTitle-link" href="/job/7/">no row</a></td></tr></table>'
    shell = '<div class="jobDisplay"><h1>Geologist in full</h1><span id="job-location">Houston</span><p>Interpret data. Application deadline: December 31, 2026.</p><a href="/apply/1/">Apply now</a></div>'
    docs = captured(spark, "s", ("https://j.com/search/?q=geology%20x&locale=en", first), ("https://j.com/search?q=two", "<table>" + row(1, "again") + row(3, "Reservoir")), ("https://j.com/job/1/", shell))
    rules = spark.createDataFrame([("s", "H", "https://j.com/search/")], RULE + ", search_url string")
    spec = details.Detail(content=(".jobDisplay",), location=("#job-location",), excluded=("software",))
    found, errors = rows(boards.result_rows(rules, spec)(docs))
    assert not errors and [(r.position, r.title, r.location, r.source_url, r.employer) for r in found] == [(1, "Geologist", "Houston, TX", "https://j.com/job/1/", "H"), (2, "Reservoir", "Houston, TX", "https://j.com/job/3/", "H")]
    assert "Search topic: geology x" in found[0].text and "Search topic" not in found[0].match_text
    found, _ = rows(boards.result_rows(rules.withColumn("fetch_detail_pages", F.lit(True)), spec)(docs))
    assert [(r.title, r.location, r.deadline_date, r.application_url) for r in found] == [("Geologist in full", "Houston", "2026-12-31", "https://j.com/apply/1/"), ("Reservoir", "Houston, TX", None, "https://j.com/job/3/")]
    assert rows(boards.result_rows(rules, spec)(docs.limit(0))) == ([], [])


KEY, IV = "0123456789abcdef", "1234567890123456"


def sealed(spark, value):
    made = spark.range(1).select(F.aes_encrypt(F.lit(json.dumps(value, ensure_ascii=False)), F.lit(KEY.encode()), F.lit("CBC"), F.lit("PKCS"), F.lit(IV.encode()))).first()[0]
    return {"data": base64.b64encode(bytes(made)[16:]).decode(), "necromancer": KEY}


def test_encrypted_jobs_are_judged_twice_and_details_win(spark):
    listing = "https://m.com/social/1?locale=zh#/jobs"
    front = f"""<input id="init-data" value='{{"org":{{"id":"z"}},"aesIv":"{IV}"}}'>"""
    jobs = [{"id": "x", "title": "软件工程师"}, {"id": "g1", "title": "地质勘探", "department": {"name": "矿产部"}, "commitment": "兼职"}, {"id": "g1", "title": "地质 twice"}, {"id": 7, "title": "地质七", "city": "长沙"}, {"id": "g3", "title": "地质三"}, "no job"]
    detail = {"id": "g1", "title": "地质勘探类", "education": "硕士", "commitment": "全职", "zhineng": {"name": "地质类"}, "locations": [{"name": "福建"}], "publishedAt": "2026-09-01T12:00:00", "jobDescription": "<p>要求：地质、<b>物探</b>。</p>"}
    one = lambda job, answer: (f"https://m.com/api/website/job?jobId={job}", answer)
    answers = [("https://m.com/api/website/jobs/v2", sealed(spark, {"success": True, "data": {"jobs": jobs}})), one("g1", sealed(spark, {"data": detail})), one("7", sealed(spark, {"success": False, "msg": "no"})), one("g3", {"data": {"title": "地质三", "jobDescription": "培训生"}})]
    docs = captured(spark, "s", (listing, front), *answers)
    rules = spark.createDataFrame([("s", "集团", listing, ["软件"], ["培训"])], RULE + ", listing_url string, exclude_patterns array<string>, detail_exclude_patterns array<string>")
    found, errors = rows(boards.encrypted_jobs(rules, ["地质"])(docs))
    assert not errors and [(r.position, r.title, r.location, r.external_id) for r in found] == [(1, "地质勘探类", "福建", "g1"), (2, "地质七", "长沙", "7")]
    g = found[0]
    assert (g.source_url, g.published_date, g.summary) == ("https://m.com/social/1?locale=zh#/job/g1", "2026-09-01", "学历：硕士；职位性质：全职；职位类别：地质类；所属部门：矿产部；工作地点：福建；要求：地质、 物探 。")
    strict = rules.withColumns({"require_detail_pages": F.lit(True), "include_patterns": F.array(F.lit("物探|三"))})
    assert rows(boards.encrypted_jobs(strict, [])(docs)) == ([], [])  # the list's own text is judged first
    assert [r.external_id for r in rows(boards.encrypted_jobs(strict.withColumn("include_patterns", F.array(F.lit("勘探|七"))), [])(docs))[0]] == ["g1"]
    assert rows(boards.encrypted_jobs(rules, ["地质"])(docs.filter("position <> 1")))[1] == [("s", "public page is missing its vector")]
    assert rows(boards.encrypted_jobs(rules, ["地质"])(docs.filter("position <> 2")))[1] == [("s", "job list was not captured")]
    assert rows(boards.encrypted_jobs(rules, ["地质"])(captured(spark, "s", (listing, front), ("https://m.com/website/jobs/v2", {"data": "junk", "necromancer": KEY}))))[1] == [("s", "job list can't be read")]


def test_a_text_of_zero_is_an_id_and_the_number_is_none(spark):
    values = ["0", "null", "false", "[]", " 0.0 ", 0, 0.0, None, False, [], {}, 7]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(12, None)], "i int, v string")
    assert [r[0] for r in df.orderBy("i").select(nested.shown(F.try_parse_json("v"))).collect()] == ["0", "null", "false", "[]", "0.0", "", "", "", "", "", "", "7", ""]
    listing = "https://m.com/jobs"
    jobs = [{"id": "0", "title": "地质零"}, {"id": 0, "title": "地质 none"}, {"id": "1", "title": "地质一"}]
    docs = captured(spark, "s", (listing, f"""<input id="init-data" value='{{"aesIv":"{IV}"}}'>"""), ("https://m.com/website/jobs/v2", sealed(spark, {"data": {"jobs": jobs}})), ("https://m.com/website/job?jobId=0", sealed(spark, {"data": {"title": "地质零 whole"}})))
    rules = spark.createDataFrame([("s", "集团", listing)], RULE + ", listing_url string")
    assert [(r.position, r.external_id, r.title) for r in rows(boards.encrypted_jobs(rules, ["地质"])(docs))[0]] == [(1, "0", "地质零 whole"), (2, "1", "地质一")]


def test_nations_of_one_name_are_one_portal(spark, tmp_path):
    from brightloom.plans.boards import encrypted_portal

    spark.createDataFrame([(0, "N"), (1, "N")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(k, f"C{k}", k % 2, "BUILDING") for k in (0, 1, 2, 3, 53)], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    want = [(1, "0", "C0"), (2, "1", "C1"), (3, "2", "Detailed C2"), (4, "3", "C3"), (5, "53", "C53")]
    assert sorted((r.position, r.external_id, r.title) for r in encrypted_portal(spark, str(tmp_path)).collect()) == want


def test_a_place_of_no_place_needs_no_evidence(spark):
    got = spark.createDataFrame([("Multi-Location", "x"), ("Multi-Location, China", "in china"), ("Oslo", "x"), (None, "x"), (" , ", "x")], "p string, t string")
    assert [r[0] for r in got.select(portals.location_evidenced(F.col("p"), F.col("t"))).collect()] == [True, True, False, False, True]


def test_application_links_go_by_their_paragraph_and_are_no_files(spark):
    pages = ['<p>附件：<a href="/files/application-form.xlsx?x=1">应聘登记表</a></p>', '<p><a href="/apply/123">立即报名</a></p>', "<div><p>Please <b>APPLY</b> <span><a href='/here'>here</a></span></p></div>", '<div>申请<p><a href="/other">more</a></p></div>', '<a title="网申" href="/t"><img></a>', "<a>报名</a>", None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, p string")
    assert [r[0] for r in df.orderBy("i").select(html.application_link(F.col("p"))).collect()] == [None, "/apply/123", "/here", None, "/t", None, None]
