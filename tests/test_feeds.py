"""Feeds, sitemaps and the XML guard."""
from noticeboard.sources import feeds as X

SITE = "https://a.example.org/"
RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>c</title>
<item><title>One</title><link>https://a.example.org/1.html</link><pubDate>Wed, 01 Jul 2026 08:00:00 GMT</pubDate></item>
<item><title>One again</title><link>https://a.example.org/1.html#x</link></item>
<item><title>bad</title><link>javascript:alert(1)</link></item><item><title>other</title><link>https://b.example.org/2</link></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>E</title><link href="/e/1"/><published>2026-07-01T00:00:00Z</published></entry><entry><title>none</title></entry></feed>"""
INDEX = """<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>https://a.example.org/s1.xml</loc></sitemap><sitemap><loc>/s2.xml</loc></sitemap><sitemap><loc>https://b.example.org/s.xml</loc></sitemap></sitemapindex>"""


def docs(spark, *contents):
    return spark.createDataFrame([(i, SITE, SITE + f"d{i}", c) for i, c in enumerate(contents)], "source_id long, source_url string, page_url string, content string")


def test_rss_and_atom(spark):
    from noticeboard.operators.dedup import dedup_candidates

    out = X.explode_feed(docs(spark, RSS, ATOM))
    assert sorted(r.error for r in out.where("error is not null").collect()) == ["BAD_URL", "MISSING_URL", "OTHER_ORIGIN"]
    got = dedup_candidates(out.where("error is null")).orderBy("source_id").collect()
    assert [(r.canonical_url, r.title, r.discovery_method) for r in got] == [(SITE + "1.html", "One", "RSS"), (SITE + "e/1", "E", "ATOM")]
    assert got[1].published_time == "2026-07-01T00:00:00Z"


def test_sitemaps(spark):
    kids = X.sitemap_children(docs(spark, INDEX))
    assert sorted(r.canonical_url for r in kids.where("error is null").collect()) == [SITE + "s1.xml", SITE + "s2.xml"] and kids.where("error is not null").count() == 1


def test_guard(spark):
    deep = "<a>" * 40 + "</a>" * 40
    many = "<a>" + "<b/>" * 10001 + "</a>"
    out = X.guard_xml(docs(spark, RSS, "<rss><channel>", "<!DOCTYPE x><rss/>", deep, many, "<a>" + "x" * (1 << 20) + "</a>")).orderBy("source_id")
    assert [r.xml_error for r in out.collect()] == [None, "MALFORMED", "DTD", "TOO_DEEP", "TOO_MANY_NODES", "TOO_LARGE"]
    assert [r.error for r in X.explode_feed(docs(spark, "<html></html>")).collect()] == ["NOT_A_FEED"]
