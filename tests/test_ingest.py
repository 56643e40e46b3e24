import base64
import datetime as dt
import zlib

from brightloom.functions import places, profiles
from brightloom.operators import normalise
from brightloom.sources import html, portals, registries
from pyspark.sql import functions as F


def test_posting(spark):
    v = normalise.Vocabulary(
        majors=(("地质工程", 40), ("gis", 30)), categories=(("mining", ("矿",)), ("oil", ("石油",))), places=places.Places(cities={"北京": ("北京", "北京")}), category_points={"oil": 18},
    )
    schema = "source_id string, source_tier string, title string, employer string, source_url string, text string, published_date string, deadline_date string, location string, match_text string"
    rows = spark.createDataFrame(
        [("s", "A", " 招聘 ", "石油院", "https://a.b//c?utm_x=1", "硕士 地质工程 报名截止时间为2026年10月8日", None, None, "北京市", None), ("s", None, None, None, None, None, None, "soon", None, None)], schema
    )
    got = normalise.posting(rows, v, F.lit("2026-10-08").cast("date")).orderBy(F.col("title").desc()).collect()
    a, b = got
    assert (a.title, a.source_url, a.category, a.degree_levels, a.major_tags, a.relevance_score, a.relevance_band, a.status) == ("招聘", "https://a.b/c", "oil", ["硕士"], ["地质工程"], 78, "strong", "open")
    assert a.deadline_date == dt.date(2026, 10, 8) and a.city == "北京" and len(a.fingerprint) == 64
    assert (b.relevance_score, b.status, b.location_confidence) == (5, "open", "unknown")


def test_profile_page_order(spark):
    r = spark.createDataFrame([(1, 10, None, "u"), (2, 10, "2026-01-01", "u"), (3, 90, None, "u")], "id int, relevance_score int, deadline_date string, updated_at string")
    level = profiles.match(F.lit("explicit"), F.when(F.col("id") == 3, "unspecified").otherwise("explicit"), F.col("relevance_score"))
    page = normalise.profile_page(r, level["level"], level["priority"], 1, 10)
    assert [x.id for x in page.collect()] == [2, 1, 3]


def test_portals(spark):
    packed = base64.b64encode(zlib.compress(b"mark " + base64.b64encode("view1d 正文".encode()))).decode()
    bare = base64.b64encode(zlib.compress(base64.b64encode("正文".encode()))).decode()
    df = spark.createDataFrame([(packed,), ("junk",), (None,), (bare,)], "p string")
    assert [r[0] for r in df.select(portals.embedded_article("p")).collect()] == ["正文", None, None, None]
    key, iv = b"0123456789abcdef", b"fedcba9876543210"
    sealed = df.limit(1).select(F.aes_encrypt(F.lit("hello"), F.lit(key), F.lit("CBC"), F.lit("PKCS"), F.lit(iv)).alias("x"))
    body = sealed.select(F.base64(F.substring("x", 17, 1000)).alias("b"))
    assert body.select(portals.decrypted(F.col("b"), F.lit(key), F.lit(iv))).first()[0] == "hello"
    listed = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert {tuple(r) for r in portals.with_details(listed, listed.filter("k = 1").withColumn("v", F.lit("z")), "k", ["v"]).collect()} == {(1, "z"), (2, "b")}


def test_notice_links(spark):
    page = """<a href="/n/1">招聘 一</a><a href='/n/1#x'>招聘 again</a><a href="https://other.com/n">招聘</a><a href="/f.pdf">招聘 file</a><a href="/n/2"><b>About</b></a><a href=detail/3.html>招聘 三</a>
    <A HREF='../4.html?utm_x=1&id=2'>招聘 四</A><script type="text/xml"><![CDATA[<a class="t" href="?id=5">招聘 五</a>]]></script>"""
    df = spark.createDataFrame([(1, "https://a.b/list/index.html", page), (2, "https://a.b/", None)], "id int, url string, html string")
    got = sorted(html.notice_links(df, "id", "html", "url", F.array(F.lit("a.b")), "招聘").collect())
    assert [(r.title, r.href) for r in got] == [("招聘 一", "https://a.b/n/1"), ("招聘 三", "https://a.b/list/detail/3.html"), ("招聘 四", "https://a.b/4.html?id=2"), ("招聘 五", "https://a.b/list/index.html?id=5")]


def test_addresses_are_those_of_the_standard_library(spark):
    from urllib.parse import urljoin

    pages = ["https://a.b/c/d.html?x=1", "http://a.b", "https://a.b/c/"]
    hrefs = ["e", "/e", "//h/e", "?q", "./e", "../e", "../../e", "https://z/y", "mailto:x@y.z", "e/./f/../g", ""]
    df = spark.createDataFrame([(p, h) for p in pages for h in hrefs], "p string, h string")
    for r in df.select("p", "h", html.absolute(F.col("h"), F.col("p")).alias("got")).collect():
        assert r.got.rstrip("/") == urljoin(r.p, r.h).split("#")[0].rstrip("/") or not r.h, (r.p, r.h, r.got)


def test_titles_and_published_meta(spark):
    page = """<html><head><TITLE class=x>T &amp; t</TITLE><meta content="2026-09-02T08:00" property="article:published_time"><meta name='PubDate' content='2026-01-01'></head>"""
    df = spark.createDataFrame([(page,), ("<p>",), (None,)], "h string")
    assert [(r.t, str(r.d)) for r in df.select(html.title(F.col("h")).alias("t"), html.published_meta(F.col("h")).alias("d")).collect()] == [("T &amp; t", "2026-09-02"), ("", "None"), (None, "None")]
    links = html.links(spark.createDataFrame([(1, "<a href=x>1</a><A class='a' HREF='y z'>2</A><a data-href=\"n\" href=\"w\">3</a><abbr href=no>")], "id int, h string"), "id", "h")
    assert [(r.position, r.href) for r in links.orderBy("position").collect()] == [(1, "x"), (2, "y z"), (3, "w")]


def test_verified_jobs_and_landscape(spark, tmp_path):
    import json

    import pytest

    (tmp_path / "j.json").write_text(json.dumps([{"source_id": "s", "title": "t", "source_url": "u"}]))
    assert registries.verified_jobs(spark, str(tmp_path / "j.json")).first().title == "t"
    (tmp_path / "k.json").write_text(json.dumps({"source_id": "s", "title": " ", "source_url": "u"}))
    with pytest.raises(ValueError, match="no title"):
        registries.verified_jobs(spark, str(tmp_path / "k.json"))
    (tmp_path / "l.json").write_text(json.dumps({"groups": [{"name": "g", "units": ["u", "v"]}, {"name": "h", "units": []}]}))
    assert [tuple(r) for r in registries.landscape(spark, str(tmp_path / "l.json")).collect()] == [("g", "u"), ("g", "v"), ("h", None)]


def test_explained_matches(spark):
    df = spark.createDataFrame([("explicit", "explicit", 80), ("blocked", "explicit", 80), ("review", "related", 80)], "d string, m string, s int")
    got = df.select(profiles.explained(profiles.match(F.col("d"), F.col("m"), F.col("s")), F.col("d"), F.col("m"), {"explicit": "yes", "review": "ask", "not_recommended": "no"}, {("explicit", "explicit"): "all stated", ("blocked", ""): "degree too low", ("review", ""): "check"}).alias("x"))
    assert [tuple(r.x) for r in got.collect()] == [("explicit", "yes", "all stated", 2), ("not_recommended", "no", "degree too low", 0), ("review", "ask", "check", 1)]
    own = spark.createDataFrame([("硕士及以上学历", "博士"), ("硕士及以上学历", "本科"), ("硕士", "博士"), (None, "博士")], "t string, o string")
    assert [r[0] for r in own.select(profiles.or_above(F.col("t"), F.col("o"))).collect()] == [True, False, False, False]


def test_registry_errors(spark, tmp_path):
    import json

    import pytest

    row = {k: "x" for k in registries.REQUIRED}
    (tmp_path / "a.json").write_text(json.dumps([row, row | {"id": "y", "enabled": False}]))
    got = registries.load_sources(spark, [str(tmp_path / "a.json")])
    assert {(r.id, r.enabled, r.config) for r in got.collect()} == {("x", True, "{}"), ("y", False, "{}")}
    with pytest.raises(ValueError, match="repeated"):
        registries.load_sources(spark, [str(tmp_path / "a.json")] * 2)


def test_json_items(spark):
    df = spark.createDataFrame([('{"data": {"rows": [{"a": {"b": 1}}, {"c": 2}]}}',), ("bad",), (None,)], "j string")
    assert [r.x for r in registries.json_items(df, "j", "data.rows", {"x": "a.b"}).collect()] == ["1", None]


POSTING = "source_id string, source_tier string, title string, employer string, source_url string, text string, published_date string, deadline_date string, location string, match_text string, application_url string, external_id string"


def postings(spark, v, changes, employers=None):
    """The records of one posting with each of the changes, in their order."""
    rows = []
    for i, changed in enumerate(changes):
        row = {"source_id": "s", "source_tier": "A", "title": "Senior GIS Engineer", "employer": "石油院", "source_url": "https://a.b/1", "text": "地质工程", "deadline_date": "2099-01-01", "external_id": "x1"} | changed
        rows.append((*(row.get(c.split()[0]) for c in POSTING.split(", ")), i))
    return normalise.posting(spark.createDataFrame(rows, POSTING + ", i int"), v, F.lit("2026-10-08").cast("date"), employers=employers).orderBy("i").collect()


def test_a_record_is_known_by_source_and_id_and_changes_with_any_part(spark):
    """An edited title, employer, address, deadline or text, wherever in it, is another content of the same record."""
    long = "地质工程" + " a" * 9_000
    changes = [
        {}, {"location": "x"}, {"title": "Other"}, {"employer": "x"}, {"text": long + " end"}, {"text": long + " eng"}, {"application_url": "https://a.b/apply"}, {"deadline_date": "2099-01-02"}, {"source_url": "https://a.b/2"},
        {"external_id": "x2"}, {"source_id": "t"}, {"external_id": " "}, {"external_id": None, "title": "n"}, {"external_id": None, "source_url": "https://a.b/3"},
    ]
    rows = postings(spark, normalise.Vocabulary(majors=(("地质工程", 40),)), changes)
    assert len({r.fingerprint for r in rows[:9]}) == 1 and len({r.content_hash for r in rows[1:9]}) == 8 and rows[0].content_hash == rows[1].content_hash
    assert len({rows[i].fingerprint for i in (0, 9, 10, 11, 13)}) == 5 and rows[11].fingerprint == rows[12].fingerprint


def test_terms_count_whatever_the_case_and_only_as_tags(spark):
    v = normalise.Vocabulary(majors=tuple((f"t{i}", 5) for i in range(9)) + (("GIS", 30),), institution_words=("石油大学",), energy_words=("OIL",), most_tags=2)
    rows = postings(spark, v, [{"text": "gis oil 中国石油大学 T8 T1 t3"}, {"source_tier": "Z", "text": "gis"}, {"text": "x", "title": "gis"}])
    assert [(r.major_tags, r.relevance_score) for r in rows] == [(["t1", "t3"], 20 + 10 + 15 + 8), (["GIS"], 5 + 30), (["GIS"], 50)]


def test_a_known_employer_has_its_own_category(spark):
    v = normalise.Vocabulary(categories=(("mining", ("矿",)),), category_points={"oil": 18})
    employers = spark.createDataFrame([("石油", 1, "oil", "e1", "Oil Works", "Oil Group"), ("石油院", 2, "school", "e2", "Oil School", None), ("oil\u3000WORKS", 3, "oil", "e3", "W", None)], "alias string, ord int, category string, canonical_employer_id string, canonical_employer_name string, parent_employer_name string")
    rows = postings(spark, v, [{"employer": "某石油院", "text": "矿"}, {"employer": "矿石油", "text": "x"}, {"employer": None, "text": "矿"}, {"employer": "The  OIL Works Ltd", "text": "矿"}], employers)
    assert [(r.category, r.canonical_employer_id, r.parent_employer_name) for r in rows] == [("school", "e2", None), ("oil", "e1", "Oil Group"), ("mining", None, None), ("oil", "e3", None)]
    assert rows[1].relevance_score == 38


def test_reindex_changes_what_a_new_vocabulary_changes(spark):
    old, new = normalise.Vocabulary(), normalise.Vocabulary(majors=(("gis", 30),), places=places.Places(cities={"北京": ("北京", "北京")}))
    raw = [("s", "A", t, "e", f"https://a.b/{i}", x, None, "2099-01-01", w, None, None, None) for i, (t, x, w) in enumerate([("GIS", "x", None), ("plain", "x", "北京市"), ("none", "x", None)])]
    stored = normalise.posting(spark.createDataFrame(raw, POSTING), old, F.lit("2026-10-08").cast("date")).withColumn("updated_at", F.lit("old"))
    sources = spark.createDataFrame([("s", "B", None, None)], "source_id string, source_tier string, category string, undated_open_window_days int")
    now = lambda v, s: normalise.reindex(s, sources, v, F.lit("2026-10-08").cast("date"), F.lit("new"))
    after, events, counts = now(new, stored)
    assert tuple(counts.first()) == (3, 3, 1, 0)  # the source's own tier changes every score
    again, events_again, counts_again = now(new, after.withColumn("updated_at", F.lit("old")))
    assert tuple(counts_again.first()) == (3, 0, 0, 3) and events_again.count() == 0 and {r.updated_at for r in again.collect()} == {"old"}
    rows = {r.title: r for r in after.collect()}
    assert rows["GIS"].major_tags == ["gis"] and rows["plain"].city == "北京" and rows["GIS"].fingerprint in {r.fingerprint for r in stored.collect()}
    assert after.columns == stored.columns and events.first().event_type == "reclassified"
    quiet = normalise.Vocabulary(places=new.places, tier_points={"A": 20, "B": 20})
    assert tuple(now(quiet, stored)[2].first()) == (3, 0, 1, 2) and now(quiet, stored)[1].count() == 0


def test_candidates_are_accepted_whatever_the_case(spark):
    df = spark.createDataFrame([("Careers: GIS engineer",), ("GIS result LIST",), ("careers only",), ("nothing",)], "t string")
    take = lambda **k: [r[0] for r in df.select(normalise.accepts(F.col("t"), **{"denied": [r"result\s+list"], "words": ["CAREERS"], "majors": ["gis"], "require_word": F.lit(None).cast("boolean"), "require_major": F.lit(False), "accept_all": F.lit(False)} | k)).collect()]
    assert take() == [True, False, True, False]
    assert take(require_major=F.lit(True)) == [True, False, False, False] and take(include=["ENGINEER"]) == [True, False, False, False]
    assert take(accept_all=F.lit(True)) == [True] * 4 and take(denied=[]) == [True, True, True, False]


def test_degrees_and_majors_of_profiles(spark):
    rows = [("本科及以上", ["博士"], "硕士"), ("Master's degree or above", None, "博士"), ("bachelor or above", ["硕士"], "本科"), ("学士学位及以上", ["硕士"], "本科"), ("PhD degree or above", ["硕士"], "博士"), (None, ["硕士"], "本科"), ("硕士", ["本科", "x"], "硕士")]
    df = spark.createDataFrame(rows, "t string, l array<string>, o string")
    assert [r[0] for r in df.select(profiles.degree_status(F.col("l"), F.col("o"), F.col("t"))).collect()] == ["explicit", "explicit", "blocked", "explicit", "explicit", "blocked", "review"]
    tags = spark.createDataFrame([(["GEOLOGY "],), (["other"],), ([" "],), (None,)], "t array<string>")
    assert [r[0] for r in tags.select(profiles.major_status(F.col("t"), F.array(F.lit("Geology")), F.lit(False))).collect()] == ["explicit", "related", "unspecified", "unspecified"]
    assert [r[0] for r in tags.select(profiles.major_status(F.col("t"), F.array(F.lit("x")), F.lit(True))).collect()] == ["explicit"] * 4


def test_employer_registry(spark, tmp_path):
    import json

    import pytest

    one = dict.fromkeys(registries.EMPLOYER_KEYS, None) | {"id": "e1", "canonical_name": "C", "category": "oil", "aliases": ["C  Corp", " ", "c"]}
    write = lambda x: (tmp_path / "e.json").write_text(json.dumps(x)) and str(tmp_path / "e.json")
    rows = registries.load_employers(spark, write([one, one | {"id": "e2", "aliases": []}, one | {"id": "e3", "parent_name": "P", "aliases": ["Ä"]}])).orderBy("ord").collect()
    assert [(r.alias, r.canonical_employer_id, r.parent_employer_name) for r in rows] == [("c corp", "e1", None), ("c", "e1", None), ("ä", "e3", "P")]
    for bad in ({"employers": []}, [one, {"id": "x"}], ["x"]):
        with pytest.raises(ValueError):
            registries.load_employers(spark, write(bad))
    stored = spark.createDataFrame([(1, '{"a": 1}', '["x"]'), (2, None, "[]")], "id int, config_json string, tags_json string")
    got = registries.decoded(stored, {"config_json": ("config", "map<string,string>"), "tags_json": ("tags", "array<string>")})
    assert got.columns == ["id", "config", "tags"] and [tuple(r) for r in got.collect()] == [(1, {"a": "1"}, ["x"]), (2, None, [])]
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        registries.decoded(stored.select(F.lit("{").alias("c")), {"c": ("d", "map<string,string>")}).collect()
