import datetime as dt

import pytest
from brightloom.functions import dates, places, profiles, rules, scoring, taxonomy, text, urls
from pyspark.sql import functions as F


def one(spark, column, value=None):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("r")).first().r


V = F.col("v")


@pytest.mark.parametrize(
    ("value", "want"),
    [("  a 　 b \x1cc ", "a b c"), (None, ""), ("", ""), (" x", "x")],
)
def test_clean(spark, value, want):
    assert one(spark, text.clean(V), value) == want


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("请于 2026年10月8日前完成网申，报名截止时间为2026年10月8日。", "2026-10-08"), ("报名时间：2026.09.09-2026.10.15，请投递", "2026-10-15"), ("报名时间：202 6 .09 .09 -202 6 .10 .15。", "2026-10-15"),
        ("网上报名时间：2026年9月9日9:00至9月16日17:00。", "2026-09-16"), ("报名时间：自公告发布之日起至2026年10月31日止。第一批次：报名截止时间为2026年5月18日。", "2026-10-31"),
        ("招聘公告 过期时间：2026-11-17", "2026-11-17"), ("Application deadline: December 31, 2026", "2026-12-31"), ("会议时间2026年9月1日至2026年9月3日，报名截止2026年8月20日", "2026-08-20"),
        ("会议时间2026年9月1日至2026年9月3日", None), ("报名截止时间为2026年13月1日", None), ("报名时间：2026年9月9日至2月31日，报名截止2026年3月1日", "2026-03-01"), ("nothing", None), (None, None),
    ],
)
def test_deadline(spark, value, want):
    got = one(spark, dates.deadline(V), value)
    assert got == (dt.date.fromisoformat(want) if want else None)


def test_texts_without_a_year_are_not_asked_for_deadlines(spark):
    import random
    import time

    rng = random.Random(1)
    mixed = ["".join(rng.choices(["2", "0", "6", "20", "9", "年", "月", "日", " ", "\u3000", "\x1c", "\n", "\u2009", "-", "报名时间：", "２", "٢"], k=rng.randrange(12))) for _ in range(3_000)]
    df = spark.createDataFrame([(x,) for x in mixed], "v string")
    known = dates.without_digit_gaps(text.clean(V)).rlike(r"20\d{2}")
    assert {tuple(r) for r in df.select(known, V.rlike(dates.GAPPED_YEAR)).collect()} == {(True, True), (False, False)}
    assert one(spark, dates.deadline(V), "报名截止时间 2\u3000 0\x1c2\n6年1 0月8日") == dt.date(2026, 10, 8)
    long = spark.range(2_000, numPartitions=4).select(F.concat(F.lit("Brand#20 报名时间"), F.repeat(F.lit(" text"), 3_000), F.col("id")).alias("v")).cache()
    long.count()
    took = {}
    for k, c in (("clean", text.clean(V)), ("deadline", dates.deadline(V)), ("clean", text.clean(V)), ("deadline", dates.deadline(V))):
        began = time.perf_counter()
        long.agg(F.max(F.hash(c))).collect()
        took[k] = time.perf_counter() - began
    long.unpersist()
    assert took["deadline"] < 2 * took["clean"]  # the six patterns take several times as long


def test_published_is_none_where_a_text_speaks_of_closing(spark):
    assert [one(spark, dates.published(V), x) for x in ("招聘公告 过期时间：2026-11-17", "报名截至2026年9月3日", "有效期 2026-01-01", None)] == [None] * 4
    assert [str(one(spark, dates.published(V), x)) for x in ("发布时间:2026-09-02 08:00 截止2026-10-01", "公告日期：2026年9月2日", "更新日期 2026/9/2", "北京 2026-09-02")] == ["2026-09-02"] * 4


def test_references_are_decoded(spark):
    assert one(spark, text.clean(V, references=True), "a &amp; b&nbsp;&#20013;&lt;c &bogus; ") == "a & b 中<c &bogus;"
    assert one(spark, text.clean(V, references=True)) == ""


def test_expiry_is_strict_and_malformed_dates_are_open(spark):
    today = F.lit("2026-09-18").cast("date")
    assert [one(spark, dates.is_expired(V, today), d) for d in ("2026-09-17", "2026-09-18", "soon", None)] == [True, False, False, False]


def test_local_day(spark):
    start, end = dates.local_day_bounds("2026-09-18", "Asia/Shanghai")
    assert str(one(spark, start)) == "2026-09-17 16:00:00" and str(one(spark, end)) == "2026-09-18 16:00:00"


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("HTTP://Ex.com//a//b?utm_x=1&id=2&fromdate=3#top", "http://ex.com/a/b?id=2"), ("https://ex.com", "https://ex.com/"), ("plain", "plain"), (None, None),
    ],
)
def test_url_normal_form(spark, value, want):
    assert one(spark, urls.normalize(V), value) == want


def test_http_test_survives_bad_urls(spark):
    assert [one(spark, urls.is_http(V), u) for u in ("https://a.b/c", "ftp://a.b", "http://", "a b c", None)] == [True, False, False, False, False]


def test_score_is_capped_and_banded(spark):
    score = scoring.weighted_score(V, (("aa", 40), ("bb", 30)), cap=58)
    assert [one(spark, score, x) for x in ("aa bb", "aa", "", None)] == [58, 40, 0, 0]
    assert one(spark, scoring.band(F.lit(30), ((55, "strong"), (20, "related")), "weak")) == "related"


def test_rules_keep_their_order(spark):
    groups = (("first", ("ab",)), ("second", ("a",)))
    assert [one(spark, rules.first_match(V, groups, F.lit("none")), x) for x in ("ab", "ac", "x", None)] == ["first", "second", "none", "none"]
    assert one(spark, rules.earliest_marker(V, (("late", ("zz",)), ("early", ("yy",)))), "..yy..zz") == "early"


PLACES = places.Places(
    provinces={"北京": "北京", "北京市": "北京", "新疆": "新疆", "陕西省": "陕西"}, cities={"北京": ("北京", "北京"), "西安": ("陕西", "西安"), "克拉玛依": ("新疆", "克拉玛依")}, municipalities=("北京",),
    countries={"沙特": "沙特阿拉伯"}, patterns=((r"\bnorway\b", "挪威"),), codes={"CA": "加拿大", "MY": "马来西亚"}, cities_abroad={"kuala lumpur": "吉隆坡"},
)


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("北京市海淀区 / 西安", ("北京", "北京", "中国大陆", "explicit", "北京市")), ("克拉玛依市", ("新疆", "克拉玛依", "中国大陆", "normalized", "克拉玛依")), ("陕西省", ("陕西", None, "中国大陆", "explicit", "陕西省")),
        ("沙特", (None, None, "沙特阿拉伯", "explicit", "沙特")), ("Stavanger, Norway", (None, "Stavanger", "挪威", "explicit", "norway")), ("Calgary, AB, CA, T2P 3V4", (None, "Calgary", "加拿大", "explicit", "CA")),
        ("Kuala Lumpur, 10, MY, 50400", (None, "吉隆坡", "马来西亚", "explicit", "MY")), ("Multiple Locations", (None, "多地点", "海外", "normalized", "多地点")), ("海外", (None, None, "海外", "explicit", "海外")),
        (None, (None, None, None, "unknown", None)), ("  ", (None, None, None, "unknown", None)),
    ],
)
def test_location_stages(spark, value, want):
    assert tuple(one(spark, places.location(V, PLACES), value)) == want


def test_location_hint(spark):
    got = [one(spark, places.location_hint(V), x) for x in ("工作地点：新疆克拉玛依；学历要求：硕士", "Location: Oslo, Norway Department: R", "地点：  ", "none", None)]
    assert got == ["新疆克拉玛依", "Oslo, Norway", None, None, None]


@pytest.mark.parametrize(
    ("listed", "own", "want"),
    [(["硕士"], "硕士", "explicit"), (["博士"], "本科", "blocked"), (["本科"], "博士", "review"), ([], "硕士", "unspecified"), (None, "硕士", "unspecified")],
)
def test_degree_status(spark, listed, own, want):
    df = spark.createDataFrame([(listed, own)], "l array<string>, o string")
    assert df.select(profiles.degree_status(F.col("l"), F.col("o"))).first()[0] == want


def test_english_requirement_is_in_one_sentence(spark):
    need = profiles.english_major_required(V, ["geology"], ["degree"])
    assert [one(spark, need, x) for x in ("Bachelor's or Master's degree in Geology", "A degree. We like geology", None)] == [True, False, False]


def test_labels_and_prefixes(spark):
    assert one(spark, text.label_value(V, "地点", ["学历"]), "地点: 北京 学历: 硕士") == "北京"
    assert one(spark, text.before_earliest(V, ["招聘", "公告"]), "某某研究院公告招聘") == "某某研究院"
    assert one(spark, text.before_earliest(V, ["招聘"]), "院招聘") is None


def test_date_formats(spark):
    day, today = F.to_date(V), F.lit("2026-09-18").cast("date")
    assert one(spark, dates.cn_date(day), "2026-09-08") == "2026年9月8日"
    assert [tuple(one(spark, dates.days_left(day, today), d)) for d in ("2026-09-17", "2026-09-18", "2026-09-20", None)] == [("expired", -1), ("today", 0), ("open", 2), ("unstated", None)]
    assert one(spark, dates.local_date(F.to_timestamp(V), "Asia/Shanghai"), "2026-09-17 16:30:00") == dt.date(2026, 9, 18)
    now = F.lit("2026-09-18 00:10:00").cast("timestamp")
    assert [one(spark, dates.heartbeat(F.to_timestamp(V), now, 300), x)["status"] for x in ("2026-09-18 00:09:00", "2026-09-18 00:00:00", None)] == ["alive", "stale", "missing"]
    assert one(spark, dates.month_day_date(V), "2026-09-18T08:00:00") == dt.date(2026, 9, 18) and one(spark, dates.month_day_date(V), "soon") is None


TAXONOMY = taxonomy.Taxonomy(
    categories=(
        taxonomy.Category("service", "oil services", "service company", "独立", (("geophysics company", ("物探",)),), (("中国石油体系", ("中国石油", "东方物探")), ("中国石化体系", ("中石化",)), ("国际企业", ("halliburton",))), earliest=True),
        taxonomy.Category("operator", "upstream", "operator", "其他", (), (("中国石化体系", ("中国石化",)), ("中国石油体系", ("中国石油",)))),
        taxonomy.Category("research", "science", "institute", "高校"),
    ),
    fallback="research", identity=(("service", ("东方物探", "halliburton")), ("operator", ("油田",))), body=(("service", ("物探", "halliburton")), ("operator", ("油田", "勘探")), ("research", ("大学",))),
    legacy={"old operators": "operator"}, overseas=("kuala lumpur",), codes=("us", "my"), domestic=("北京",), directions=(("geophysics", ("物探", "geophys")), ("geology", ("地质",))),
)


@pytest.mark.parametrize(
    ("text", "location", "source", "identity", "want"),
    [
        ("中国石油某油田勘探地质", None, None, None, ("operator", "upstream", "operator", "中国石油体系", "地域待核验", "geology")),
        ("中国石油东方物探公司物探解释 中石化", "北京", None, "东方物探", ("service", "oil services", "geophysics company", "中国石油体系", "中国境内岗位", "geophysics")),
        ("Halliburton Geophysicist", "Kuala Lumpur, 10, MY, 50400", None, None, ("service", "oil services", "service company", "国际企业", "海外岗位", "geophysics")),
        ("中国石化 油田 客户 大学", None, "operator", "中国石油某油田", ("operator", "upstream", "operator", "中国石油体系", "地域待核验", "other")),
        ("大学 物探", None, "old operators", None, ("operator", "upstream", "operator", "其他", "地域待核验", "geophysics")),
        ("nothing", "Houston US", None, None, ("research", "science", "单位属性待以官方公告核验", "所属体系待核验", "海外岗位", "other")),
        (None, None, "unheard of", None, ("research", "science", "单位属性待以官方公告核验", "所属体系待核验", "地域待核验", "other")),
    ],
)
def test_taxonomy(spark, text, location, source, identity, want):
    row = spark.createDataFrame([(text, location, source, identity)], "t string, l string, s string, i string")
    assert tuple(row.select(taxonomy.classify(F.col("t"), F.col("l"), F.col("s"), F.col("i"), TAXONOMY).alias("c")).first().c) == want


def test_enriched_jobs_take_a_known_employers_fields(spark):
    job = "id int, title string, employer string, group_name string, description string, summary string, location string, category string"
    jobs = spark.createDataFrame([(1, "招聘", "中国石油东方物探公司", None, "中石化", None, None, "operator"), (2, "大学招聘", "某大学", None, None, "", None, None)], job)
    known = "alias string, ord int, canonical_employer_id string, canonical_employer_name string, parent_employer_name string, category string, employer_type string, affiliation string"
    employers = spark.createDataFrame([("中国石油", 0, "cnpc", "中国石油", None, "operator", "group", "中国石油体系"), ("东方物探公司", 1, "bgp", "东方物探", "中国石油", "service", "geo", "中国石油体系")], known)
    got = {r.id: r for r in taxonomy.enriched(jobs, employers, TAXONOMY).collect()}
    assert (got[1].category, got[1].category_stored, got[1].canonical_employer_id, got[1].employer_type) == ("service", "operator", "bgp", "geo")
    assert (got[2].category, got[2].canonical_employer_id, got[2].affiliation) == ("research", None, "高校")
