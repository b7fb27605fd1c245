"""Pages, feeds, sitemaps, candidates, imports and versions over the given pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts as T, urls as U
from ..operators import budget as B, dedup as D, filters as P, joins as J
from ..sources import feeds, pages as G, sinks
from ..sources.tables import load
from .registry import CRAWL_JOBS, DOCS, REGISTRY, query
from .textual import WS, collapse, rx, sq, strip

HOST = r"regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)"
ORIGIN = r"regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)"
CLEAN = "regexp_replace(url, '#.*$', '')"


def pages(spark, d):
    return load(spark, d, "pages")


def unescape(c: str) -> str:
    for entity, char in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#x27;", "''"), ("&amp;", "&")):
        c = f"replace({c}, '{entity}', '{char}')"
    return c


# ------------------------------------------------------------------- pages --
_ANCHORS_SQL = rf"""a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS t FROM pages),
l AS (SELECT page_id, {ORIGIN} || {unescape('href')} AS link, {collapse(unescape('t'))} AS title FROM a)"""


@query("page_links", f"WITH {_ANCHORS_SQL} SELECT page_id, link AS url, title, count(*) AS n FROM l WHERE title<>'' GROUP BY 1,2,3")
def page_links(spark, d):
    links = G.extract_links(G.parse_pages(pages(spark, d)))
    return links.groupBy("page_id", "url", "title").agg(F.count("*").alias("n"))


@query("row_dates", "SELECT page_id, 'https://a.example.org/x/' || cast(page_id AS string) AS url, '2026-08-' || cast(1 + page_id % 28 AS string) AS published FROM pages")
def row_dates(spark, d):
    """Links inside a table row take the date of the row."""
    row = F.concat(F.lit('<table><tr><td><a href="/x/'), F.col("page_id").cast("string"), F.lit('">A row title</a></td><td>2026-08-'), (F.col("page_id") % 28 + 1).cast("string"), F.lit("</td></tr></table>"))
    raw = pages(spark, d).select("page_id", F.lit("https://a.example.org/list").alias("url"), row.alias("html"))
    return G.extract_links(G.parse_pages(raw)).select("page_id", "url", "published")


_TITLE_SQL = collapse(unescape(r"regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))
_ARTICLE_SQL = rf"""m AS (SELECT page_id, url, {_TITLE_SQL} AS title, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS body FROM pages),
h AS (SELECT page_id, title, list_concat([regexp_extract(body, '(?s)<h1>(.*?)</h1>', 1)], list_transform(list_slice(string_split(body, '</p>'), 1, -2), lambda x: regexp_extract(x, '(?s)^.*<p>(.*)$', 1))) AS parts FROM m),
b AS (SELECT page_id, title, unnest(parts) AS x, generate_subscripts(parts, 1) AS i FROM h),
c AS (SELECT page_id, title, i, {collapse(unescape(rx('x', '<[^>]+>')))} AS x FROM b),
k AS (SELECT page_id, title, x, min(i) AS i FROM c WHERE length(x)>=8 AND x<>title GROUP BY 1,2,3),
t AS (SELECT page_id, trim(string_agg(x, E'\n' ORDER BY i)) AS body FROM k GROUP BY 1)"""


@query("page_articles", f"WITH {_ARTICLE_SQL} SELECT m.page_id, m.title, sha256({sq("coalesce(t.body, '')")}) AS content_hash, coalesce(length(t.body), 0) AS body_chars, coalesce(length(t.body), 0)<60 AS rejected FROM m LEFT JOIN t USING (page_id)")
def page_articles(spark, d):
    a = G.extract_article(G.parse_pages(pages(spark, d)))
    return a.select("page_id", "title", "content_hash", F.length("body").cast("bigint").alias("body_chars"), "rejected")


@query("page_metadata", f"SELECT page_id, 'by ' || cast(page_id AS string) AS author, 'pub' AS source_name, {CLEAN} AS canonical, CASE WHEN page_id % 2 = 0 THEN 'meta title' WHEN {_TITLE_SQL}<>'' THEN {_TITLE_SQL} ELSE 'unused' END AS title FROM pages")
def page_metadata(spark, d):
    """Meta tags first, JSON-LD fills what is missing."""
    head = F.concat(
        F.lit('<head><link rel="canonical" href="'), F.regexp_replace("url", "#.*$", ""), F.lit('"><script type="application/ld+json">{"@type":"NewsArticle","headline":"unused","author":{"name":"by '),
        F.col("page_id").cast("string"), F.lit('"},"publisher":[{"name":"pub"}]}</script>'),
        F.when(F.col("page_id") % 2 == 0, '<meta property="og:title" content=" meta title ">').otherwise(""),
    )
    raw = pages(spark, d).withColumn("html", F.replace(F.col("html"), F.lit("<head>"), head))
    meta = G.coalesce_meta(G.parse_pages(raw))
    return meta.select("page_id", "author", "source_name", "canonical", "title")


@query("json_ld_articles", f"SELECT page_id, {CLEAN} AS url, 'T' || cast(page_id AS string) AS title, '2026-01-02' AS published FROM pages UNION ALL SELECT page_id, '', 'inner', NULL FROM pages WHERE page_id % 3 = 0")
def json_ld_articles(spark, d):
    article = F.concat(F.lit('{"@type":["NewsArticle"],"headline":"T'), F.col("page_id").cast("string"), F.lit('","mainEntityOfPage":{"@id":"'), F.regexp_replace("url", "#.*$", ""), F.lit('"},"datePublished":"2026-01-02"'))
    graph = F.when(F.col("page_id") % 3 == 0, ',"@graph":[{"@type":"Article","name":"inner"},{"@type":"Person","name":"no"}]').otherwise("")
    raw = pages(spark, d).withColumn("html", F.concat(F.lit('<script type="application/ld+json">['), article, graph, F.lit("}]</script><script type='application/ld+json'>{bad</script>"), F.col("html")))
    return G.extract_json_ld(G.parse_pages(raw)).select("page_id", "url", "title", "published")


@query("page_images", f"SELECT page_id, {ORIGIN} || '/i/' || cast(page_id AS string) || '.png' AS url, 800 AS width, 400 AS height, 'cap ' || cast(page_id AS string) AS caption FROM pages")
def page_images(spark, d):
    img = F.concat(F.lit('<img data-src="/i/'), F.col("page_id").cast("string"), F.lit('.png" src="data:x" width="800" height="400" alt=" cap '), F.col("page_id").cast("string"), F.lit('"></article>'))
    raw = pages(spark, d).withColumn("html", F.replace(F.col("html"), F.lit("</article>"), img))
    return G.extract_images(G.parse_pages(raw)).select("page_id", "url", "width", "height", "caption")


@query("account_hints", "SELECT page_id, 'BIZ' || cast(page_id AS string) AS account_biz, CASE WHEN page_id % 2 = 0 THEN 'a name' END AS account_name FROM pages WHERE contains(url, 'spam-farm.example.org') UNION ALL SELECT page_id, NULL, NULL FROM pages WHERE NOT contains(url, 'spam-farm.example.org')")
def account_hints(spark, d):
    html = F.concat(F.lit("var biz = 'BIZ"), F.col("page_id").cast("string"), F.lit("';"), F.when(F.col("page_id") % 2 == 0, '<span id="js_name"> a <b>name</b></span>').otherwise(""), F.col("html"))
    hints = U.account_hints(html, U.host("url"), "spam-farm.example.org")
    return pages(spark, d).select("page_id", hints.alias("h")).select("page_id", "h.account_biz", "h.account_name")


@query("normalized_urls", f"SELECT page_id, CASE WHEN page_id % 5 = 0 THEN NULL ELSE regexp_replace({CLEAN}, '(://[^/]+)$', '\\1/') END AS canonical FROM pages")
def normalized_urls(spark, d):
    """Upper-case scheme and host, default port, doubled slashes and fragments go; user info is refused."""
    raw = F.regexp_replace("url", "^(https?)://([^/]+)/?", "$1://$2//")
    raw = F.when(F.startswith(raw, F.lit("https:")), F.regexp_replace(raw, "^https://([^/]+)", "HTTPS://$1:443")).otherwise(F.regexp_replace(raw, "^http://([^/]+)", "HTTP://$1:80"))
    raw = F.when(F.col("page_id") % 5 == 0, F.regexp_replace(raw, "://", "://me@")).otherwise(raw)
    return pages(spark, d).select("page_id", U.normalize_url(raw).alias("canonical"))


_P = r"lower(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1))"
_Q = r"regexp_extract(url, '\?([^#]*)', 1)"


@query("article_link_scores", rf"""WITH s AS (SELECT page_id, {_P} AS p, {_Q} AS q, {_TITLE_SQL} AS t FROM pages)
SELECT page_id, CASE WHEN regexp_matches(p, '(^|[-_/])(article|detail|content|news|notice|view|story|post)([-_/.]|$)') THEN 60 ELSE 0 END + CASE WHEN regexp_matches(q, '(^|&)(docid)(=|&|$)') THEN 50 ELSE 0 END
+ CASE WHEN regexp_matches(p, '/20[0-9][0-9]/(0?[1-9]|1[0-2])(/|$)') THEN 30 ELSE 0 END + CASE WHEN regexp_matches(p, '[.](html|htm|shtml|pdf)$') THEN 8 ELSE 0 END + CASE WHEN length(t)>=8 THEN 10 ELSE 0 END
- CASE WHEN length(t)<=2 THEN 80 ELSE 0 END - CASE WHEN regexp_matches(p, '(^|[-_/])(category|categories|channel|directory|guide|index|list|nav|search|sitemap)([-_/.]|$)') THEN 55 ELSE 0 END
- CASE WHEN q='' AND p='/en/671' THEN 100 ELSE 0 END AS score FROM s""")
def article_link_scores(spark, d):
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    return pages(spark, d).select("page_id", U.article_link_score("url", F.replace(title, F.lit("&amp;"), F.lit("&")), F.lit("https://a.example.org/en/671")).cast("int").alias("score"))


# ------------------------------------------------------------ feeds, sitemaps --
def _xml(text):
    return F.replace(text, F.lit("&"), F.lit("&amp;"))


def feed_documents(spark, d):
    """One feed per page: RSS for even pages, Atom for odd ones."""
    link, pid = _xml(F.col("url")), F.col("page_id").cast("string")
    rss = F.concat(F.lit("<rss><channel><item><title>A"), pid, F.lit("</title><link>"), link, F.lit("</link><pubDate>today</pubDate></item><item><guid>/g/"), pid, F.lit("</guid></item><item><title>none</title></item></channel></rss>"))
    atom = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>B</title><link rel="self" href="/no"/><link href="/e/'), pid, F.lit('"/><updated>u</updated></entry><entry><link href="https://other.example.org/"/></entry></feed>'))
    doc = F.when(F.col("page_id") % 11 == 10, "<rss><channel>").when(F.col("page_id") % 2 == 0, rss).otherwise(atom)
    return pages(spark, d).select(F.col("page_id").alias("source_id"), F.col("url").alias("page_url"), F.col("url").alias("source_url"), doc.alias("content"))


@query("feed_candidates", f"""SELECT page_id AS source_id, {CLEAN} AS canonical_url, 'A' || cast(page_id AS string) AS title, 'today' AS published_time, 'RSS' AS discovery_method, NULL AS error FROM pages WHERE page_id%11<>10 AND page_id%2=0
UNION ALL SELECT page_id, {ORIGIN} || '/g/' || cast(page_id AS string), '', NULL, 'RSS', NULL FROM pages WHERE page_id%11<>10 AND page_id%2=0
UNION ALL SELECT page_id, NULL, 'none', NULL, 'RSS', 'MISSING_URL' FROM pages WHERE page_id%11<>10 AND page_id%2=0
UNION ALL SELECT page_id, {ORIGIN} || '/e/' || cast(page_id AS string), 'B', 'u', 'ATOM', NULL FROM pages WHERE page_id%11<>10 AND page_id%2=1
UNION ALL SELECT page_id, NULL, '', NULL, 'ATOM', 'OTHER_ORIGIN' FROM pages WHERE page_id%11<>10 AND page_id%2=1
UNION ALL SELECT page_id, NULL, '', NULL, NULL, 'MALFORMED' FROM pages WHERE page_id%11=10""")
def feed_candidates(spark, d):
    return feeds.explode_feed(feed_documents(spark, d)).select("source_id", "canonical_url", "title", "published_time", "discovery_method", "error")


def sitemap_documents(spark, d):
    pid, link = F.col("page_id").cast("string"), _xml(F.col("url"))
    urlset = F.concat(F.lit("<urlset><url><loc>"), link, F.lit("</loc><lastmod>2026-01-01</lastmod></url><url><loc> </loc></url></urlset>"))
    index = F.concat(F.lit("<sitemapindex><sitemap><loc>/s/"), pid, F.lit("</loc></sitemap><sitemap><loc>/s/"), pid, F.lit("</loc></sitemap></sitemapindex>"))
    return pages(spark, d).select(
        F.col("page_id").alias("source_id"), F.col("url").alias("page_url"), F.col("url").alias("source_url"), F.when(F.col("page_id") % 2 == 0, urlset).otherwise(index).alias("content")
    )


@query("sitemap_candidates", f"""SELECT page_id AS source_id, {CLEAN} AS canonical_url, '2026-01-01' AS published_time, NULL AS error FROM pages WHERE page_id%2=0
UNION ALL SELECT page_id, NULL, NULL, 'MISSING_URL' FROM pages WHERE page_id%2=0 UNION ALL SELECT page_id, {ORIGIN} || '/below/' || cast(page_id AS string), NULL, NULL FROM pages WHERE page_id%2=1""")
def sitemap_candidates(spark, d):
    """Sitemap indexes lead one level down, to documents that were fetched already."""
    docs = sitemap_documents(spark, d)
    fetched = pages(spark, d).where("page_id % 2 = 1").select(
        F.concat(F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1), F.lit("/s/"), F.col("page_id").cast("string")).alias("url"),
        F.concat(F.lit("<urlset><url><loc>/below/"), F.col("page_id").cast("string"), F.lit("</loc></url></urlset>")).alias("content"),
    )
    return feeds.explode_sitemap(docs, fetched).select("source_id", "canonical_url", "published_time", "error")


@query("sitemap_children", f"SELECT page_id AS source_id, {ORIGIN} || '/s/' || cast(page_id AS string) AS canonical_url FROM pages WHERE page_id%2=1")
def sitemap_children(spark, d):
    return feeds.sitemap_children(sitemap_documents(spark, d)).where("error is null").select("source_id", "canonical_url")


@query("guarded_xml", """SELECT page_id, CASE page_id%5 WHEN 0 THEN 'DTD' WHEN 1 THEN 'MALFORMED' WHEN 2 THEN 'TOO_DEEP' WHEN 3 THEN 'TOO_LARGE' END AS xml_error FROM pages""")
def guarded_xml(spark, d):
    k, link = F.col("page_id") % 5, _xml(F.col("url"))
    doc = (
        F.when(k == 0, F.concat(F.lit("<!DOCTYPE a><a>"), link, F.lit("</a>"))).when(k == 1, F.concat(F.lit("<a>"), link))
        .when(k == 2, F.concat(F.repeat(F.lit("<a>"), F.lit(40)), link, F.repeat(F.lit("</a>"), F.lit(40))))
        .when(k == 3, F.concat(F.lit("<a>"), F.repeat(F.lit("x" * 1024), F.lit(1025)), F.lit("</a>"))).otherwise(F.concat(F.lit("<a><b>"), link, F.lit("</b></a>")))
    )
    return feeds.guard_xml(pages(spark, d).select("page_id", doc.alias("content"))).select("page_id", "xml_error")


# --------------------------------------------------------------- candidates --
def candidates(spark, d):
    url = U.normalize_url("url")
    return pages(spark, d).select(
        F.col("page_id").alias("pos"), (F.col("page_id") % 7).alias("source_id"), "url", url.alias("canonical_url"), F.sha2(url, 256).alias("dedup_key"),
        F.regexp_extract("html", "<html lang=\"([a-z]+)", 1).alias("title"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("2026-07-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"))).alias("published_time"),
    )


_CAND_SQL = f"""cand AS (SELECT page_id AS pos, page_id%7 AS source_id, {HOST} AS host, regexp_replace({CLEAN}, '(://[^/]+)$', '\\1/') AS canonical_url, regexp_extract(html, '<html lang="([a-z]+)', 1) AS title,
 CASE WHEN page_id%3=0 THEN date '2026-07-01' + cast(page_id%28 AS int) END AS day FROM pages)"""


def gate_registry(spark, d):
    """Seven sources taken from the first suppliers; one domain each and a second allowed one."""
    key = F.col("s_suppkey") % 7
    return load(spark, d, "supplier").select(key.alias("source_id")).distinct().select(
        "source_id", F.when(F.col("source_id") % 2 == 0, "example.org").otherwise("example.com").alias("domain"), F.lit("spam-farm.example.net; example.net").alias("allowed_hosts")
    )


_KEPT_SQL = "(host='example.net' OR host LIKE '%.example.net' OR (source_id%2=0 AND host LIKE '%.example.org') OR (source_id%2=1 AND host LIKE '%.example.com'))"


@query("gated_candidates", f"WITH {_CAND_SQL}, f AS (SELECT source_id, canonical_url, min(pos) AS pos, any_value(host) AS host FROM cand GROUP BY 1,2), k AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY pos) AS rn FROM f WHERE {_KEPT_SQL}) SELECT source_id, canonical_url, pos FROM k WHERE rn<=100")
def gated_candidates(spark, d):
    """At most 100 candidates per source, as the platform keeps them."""
    return P.gate_hosts(candidates(spark, d), gate_registry(spark, d))[0].select("source_id", "canonical_url", "pos")


@query("filtered_domains", f"""WITH {_CAND_SQL}, f AS (SELECT source_id, canonical_url, min(pos) AS pos, any_value(host) AS host FROM cand GROUP BY 1,2), r AS (SELECT * FROM f WHERE NOT {_KEPT_SQL}),
h AS (SELECT source_id, host, min(pos) AS pos FROM r GROUP BY 1,2), h5 AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY pos) AS rn FROM h)
SELECT r.source_id, count(*) AS filtered_count, any_value(d.s) AS domains FROM r JOIN (SELECT source_id, string_agg(host, ' ' ORDER BY pos) AS s FROM h5 WHERE rn<=5 GROUP BY 1) d USING (source_id) GROUP BY 1""")
def filtered_domains(spark, d):
    out = P.gate_hosts(candidates(spark, d), gate_registry(spark, d))[1]
    return out.select("source_id", "filtered_count", F.array_join("filtered_domains", " ").alias("domains"))


@query("filtered_candidates", f"WITH {_CAND_SQL} SELECT pos, canonical_url FROM cand WHERE (contains(lower(title || ' ' || canonical_url), 'en') OR contains(lower(title || ' ' || canonical_url), 'th')) AND NOT contains(lower(title || ' ' || canonical_url), 'spam') AND (day IS NULL OR day >= date '2026-07-13') ORDER BY pos LIMIT 100")
def filtered_candidates(spark, d):
    """All pages as the list of one discovery call."""
    return P.filter_candidates(candidates(spark, d), "2026-07-20", ["en", "th"], ["spam"], 7, 100, by=()).select("pos", "canonical_url")


@query("source_candidates", f"WITH {_CAND_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY pos) AS rn FROM cand WHERE (contains(lower(title || ' ' || canonical_url), 'en') OR contains(lower(title || ' ' || canonical_url), 'th')) AND NOT contains(lower(title || ' ' || canonical_url), 'spam') AND (day IS NULL OR day >= date '2026-07-13')) SELECT source_id, pos, canonical_url FROM r WHERE rn<=100")
def source_candidates(spark, d):
    """One discovery call per source, each with at most 100 candidates."""
    return P.filter_candidates(candidates(spark, d), "2026-07-20", ["en", "th"], ["spam"], 7, 100).select("source_id", "pos", "canonical_url")


@query("preselected_candidates", f"WITH {_CAND_SQL} SELECT pos FROM cand WHERE canonical_url NOT IN (SELECT canonical_url FROM cand WHERE pos%4=0) AND NOT (contains(canonical_url,'spam') AND NOT contains(canonical_url,'/en'))")
def preselected_candidates(spark, d):
    """Not imported yet and not of low relevance."""
    from ..functions.classify import resident_relevance

    c = candidates(spark, d)
    c = J.flag_exists(c, c.where("pos % 4 = 0"), "canonical_url", "canonical_url", "imported")
    level = resident_relevance(F.lit(""), "canonical_url", ["/en"], ["spam"])["relevance_level"]
    return P.preselect(c.withColumn("relevance_level", level)).select("pos")


@query("unique_candidates", f"""WITH {_CAND_SQL}, u AS (SELECT *, 'SECTION' AS m, 0 AS batch FROM cand UNION ALL SELECT *, 'JSON_LD', 1 FROM cand WHERE pos%2=0 UNION ALL SELECT *, 'RSS', 2 FROM cand WHERE pos%3=0),
b AS (SELECT source_id, canonical_url, arg_min(m, CASE WHEN m='SECTION' THEN 1000000 ELSE 0 END + batch*100000 + pos) AS discovery_method FROM u GROUP BY 1,2) SELECT * FROM b""")
def unique_candidates(spark, d):
    """Union of three discovery methods; other methods replace a section link of the same address."""
    c = candidates(spark, d)
    frames = [c.withColumn("discovery_method", F.lit(m)) for m in ("SECTION", "JSON_LD", "RSS")]
    union = D.all_candidates(frames[0], frames[1].where("pos % 2 = 0"), frames[2].where("pos % 3 = 0"))
    return D.dedup_candidates(union, ("batch", "pos"), None).select("source_id", "canonical_url", "discovery_method")


# ------------------------------------------------------- documents, versions --
def hashed(spark, d):
    return load(spark, d, "documents").withColumns({"id": F.col("doc_id"), "content_hash": T.content_hash("text")})


_HASHED_SQL = f"dh AS (SELECT doc_id AS id, doc_id, lang, source, text, sha256({sq('text')}) AS h FROM documents)"


@query("unique_documents", f"WITH {_HASHED_SQL} SELECT min(id) AS id, h AS content_hash, count(*) AS copies FROM dh GROUP BY h")
def unique_documents(spark, d):
    return D.dedup_documents(hashed(spark, d)).select("id", "content_hash", "copies")


_NEW_SQL = _HASHED_SQL + """, inc AS (SELECT * FROM dh WHERE lang<>'es'), old AS (SELECT h FROM dh WHERE lang='es' OR id%17=0), n AS (SELECT min(id) AS id FROM inc WHERE h NOT IN (SELECT h FROM old) GROUP BY h)"""


def _incoming(spark, d):
    """The address is a function of the text here, so a copy collides on both keys."""
    docs = hashed(spark, d).withColumn("canonical_url", F.concat(F.lit("https://www.example.org/"), "content_hash"))
    return docs.where("lang <> 'es'").select("id", "canonical_url", "content_hash"), docs.where("lang = 'es' or id % 17 = 0").select("canonical_url", "content_hash")


@query("new_documents", f"WITH {_NEW_SQL} SELECT id FROM n")
def new_documents(spark, d):
    incoming, existing = _incoming(spark, d)
    return J.new_documents(incoming, existing, ["id"]).select("id")


_BATCH_SQL = _HASHED_SQL + """, inc AS (SELECT *, id%13=0 AS failed, CASE WHEN id%26=0 THEN 400 WHEN id%39=0 THEN 503 END AS code FROM dh WHERE lang<>'es'), old AS (SELECT h FROM dh WHERE lang='es' OR id%17=0),
n AS (SELECT min(id) AS id FROM inc WHERE NOT failed AND h NOT IN (SELECT h FROM old) GROUP BY h), o AS (SELECT inc.id, CASE WHEN failed THEN 'failed' WHEN n.id IS NOT NULL THEN 'added' ELSE 'duplicate' END AS outcome, failed AND (code IS NULL OR code>=500) AS retryable FROM inc LEFT JOIN n ON n.id=inc.id)"""


def _outcomes(spark, d):
    incoming, existing = _incoming(spark, d)
    urls = incoming.withColumns({"failed": F.col("id") % 13 == 0, "error_code": F.when(F.col("id") % 26 == 0, 400).when(F.col("id") % 39 == 0, 503)})
    return D.import_batch(urls, existing, ["id"])


@query("import_outcomes", f"WITH {_BATCH_SQL} SELECT id, outcome, retryable FROM o")
def import_outcomes(spark, d):
    return _outcomes(spark, d).select("id", "outcome", "retryable")


@query("import_totals", f"WITH {_BATCH_SQL} SELECT count(*) FILTER (outcome='added') AS added, count(*) FILTER (outcome='duplicate') AS duplicate, count(*) FILTER (outcome='failed') AS failed, 'PARTIAL_SUCCESS' AS status FROM o")
def import_totals(spark, d):
    return D.batch_totals(_outcomes(spark, d))


@query("version_changes", f"""WITH {_HASHED_SQL}, cur AS (SELECT id, h, id//3 AS root_id, id%3+1 AS version_no, CASE WHEN lang='en' THEN 'PUBLISHED' ELSE 'REVIEWED' END AS status FROM dh),
own AS (SELECT h, min(id) AS lo, max(id) AS hi FROM cur GROUP BY 1),
inc AS (SELECT dh.id, CASE dh.id%4 WHEN 0 THEN h WHEN 1 THEN sha256({sq("text || 'x'")}) ELSE (SELECT h FROM dh x WHERE x.id=0) END AS nh FROM dh), v AS (SELECT root_id, max(version_no) AS top FROM cur GROUP BY 1),
a AS (SELECT cur.*, nh, top, CASE WHEN cur.h=nh THEN 'UNCHANGED' WHEN status='PUBLISHED' THEN 'NEW_VERSION' WHEN coalesce(lo<>cur.id OR hi<>cur.id,false) THEN 'DUPLICATE' ELSE 'REPLACED' END AS action FROM cur JOIN inc USING (id) LEFT JOIN own ON own.h=nh JOIN v USING (root_id)),
g AS (SELECT nh, min(id) AS f FROM a WHERE action IN ('NEW_VERSION','REPLACED') GROUP BY 1), b AS (SELECT a.* REPLACE (CASE WHEN action='REPLACED' AND id>f THEN 'DUPLICATE' ELSE action END AS action) FROM a LEFT JOIN g USING (nh))
SELECT id, action, cast(CASE WHEN action='NEW_VERSION' THEN top+count(*) FILTER (action='NEW_VERSION') OVER (PARTITION BY root_id ORDER BY id) ELSE version_no END AS bigint) AS version_no, CASE WHEN action='NEW_VERSION' THEN id END AS previous_version_id, CASE WHEN action IN ('NEW_VERSION','REPLACED') THEN 'UPLOADED' ELSE status END AS document_status FROM b""")
def version_changes(spark, d):
    """A re-crawl: a quarter is unchanged, a quarter grew, the rest shows the text of the first document."""
    docs = hashed(spark, d)
    url = F.col("id").cast("string")
    current = docs.select(
        "id", url.alias("canonical_url"), "content_hash", "text", F.when(F.col("lang") == "en", "PUBLISHED").otherwise("REVIEWED").alias("status"),
        F.floor(F.col("id") / 3).alias("root_id"), (F.col("id") % 3 + 1).alias("version_no"),
    )
    first = docs.where("id = 0").select(F.col("text").alias("_t"))
    k = F.col("id") % 4
    incoming = docs.crossJoin(first).select(  # one row
        url.alias("canonical_url"), F.when(k == 0, F.col("text")).when(k == 1, F.concat("text", F.lit("x"))).otherwise(F.col("_t")).alias("text")
    ).withColumn("content_hash", T.content_hash("text"))
    return D.version_changes(incoming, current).select("id", "action", "version_no", "previous_version_id", "document_status")


# ------------------------------------------------------------- stored content --
@query("decoded_content", r"""WITH g AS (SELECT o_orderkey AS document_id, CASE o_orderstatus WHEN 'F' THEN 'SUMMARY' ELSE 'STEPS' END AS content_type, CASE WHEN o_totalprice<100000 THEN '{bad' WHEN o_totalprice<200000 THEN NULL ELSE '["' || o_orderpriority || '"]' END AS j, 'plain ' || cast(o_custkey AS string) AS p FROM orders)
SELECT document_id, content_type, CASE WHEN j IS NULL OR j='{bad' THEN p ELSE j END AS value FROM g UNION ALL SELECT document_id, 'ACCESSIBLE_TEXT', p FROM g WHERE content_type='SUMMARY' AND (j IS NULL OR j<>'{bad')""")
def decoded_content(spark, d):
    price = F.col("o_totalprice")
    content = load(spark, d, "orders").select(
        F.col("o_orderkey").alias("document_id"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "SUMMARY").otherwise("STEPS").alias("content_type"),
        F.when(price < 100000, "{bad").when(price >= 200000, F.concat(F.lit('["'), "o_orderpriority", F.lit('"]'))).alias("content_json"), F.concat(F.lit("plain "), F.col("o_custkey").cast("string")).alias("plain_text"),
    )
    return sinks.decode_generated(content)


@query("plan_benefits", "SELECT o_orderkey, CASE WHEN o_orderstatus='F' THEN 0 ELSE 2 END AS benefits FROM orders")
def plan_benefits(spark, d):
    j = F.when(F.col("o_orderstatus") == "F", "not a list").otherwise(F.to_json(F.array("o_orderpriority", "o_orderstatus")))
    return load(spark, d, "orders").select("o_orderkey", F.size(sinks.benefits(j)).alias("benefits"))


@query("seeds_to_insert", "SELECT c_nationkey AS domain, c_mktsegment AS section_url, min(c_custkey) AS id FROM customer WHERE (c_nationkey, c_mktsegment) NOT IN (SELECT (c_nationkey, c_mktsegment) FROM customer WHERE c_custkey%90=0) GROUP BY 1,2")
def seeds_to_insert(spark, d):
    rows = load(spark, d, "customer").select(F.col("c_nationkey").alias("domain"), F.col("c_mktsegment").alias("section_url"), F.col("c_custkey").alias("id"))
    return sinks.rows_to_insert(rows, rows.where("id % 90 = 0"), ["domain", "section_url"])


@query("daily_snapshot", "SELECT date '2026-07-01' AS snapshot_date, '{\"n\":' || cast(count(*) AS string) || ',\"quantity\":' || cast(cast(sum(l_quantity) AS bigint) AS string) || '}' AS metrics_json FROM lineitem")
def daily_snapshot(spark, d):
    m = load(spark, d, "lineitem").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("bigint").alias("quantity"))
    return sinks.snapshot_row(m, "2026-07-01")


@query("source_checks", """SELECT s_suppkey AS id, CASE WHEN s_suppkey%4=0 THEN 'DOMAIN' WHEN s_suppkey%4=1 THEN 'BUDGET,INTERVAL_HOURS' WHEN s_suppkey%4=2 THEN 'IMAGE_BASIS' ELSE '' END AS errors FROM supplier""")
def source_checks(spark, d):
    from ..functions.jobs import validate_source

    k = F.col("id") % 4
    none = F.lit(None)
    cfg = REGISTRY(spark, d).select(
        "id", F.col("source_name").alias("name"), F.lit("hospital").alias("type"), F.lit("mixed").alias("discovery_mode"), F.concat(F.lit("https://"), "domain", F.lit("/")).alias("homepage_url"),
        F.when(k == 0, "else.example.org").otherwise(F.lit("")).alias("domain"), *[none.cast("string").alias(c) for c in ("rss_url", "sitemap_url", "section_url", "daily_crawl_time", "authority_level", "schedule_mode", "duplicate_strategy", "image_usage_policy", "image_usage_basis")],
        *[none.cast("int").alias(c) for c in ("max_articles_per_run", "daily_token_budget", "recent_days", "max_retries")],
        F.when(k == 1, -1).alias("daily_article_budget"), F.when(k == 1, 999).alias("interval_hours"), (k == 2).alias("auto_approve_images"), F.lit(False).alias("image_cache_allowed"),
    )
    return cfg.select("id", F.array_join(validate_source(), ",").alias("errors"))


@query("scheduled_retries", f"""WITH e AS (SELECT id, source_registry_id AS s, canonical_url, retry_count FROM {CRAWL_JOBS.sql} WHERE status='FAILED' AND trigger_type='RETRY'), ok AS (SELECT DISTINCT source_registry_id AS s, canonical_url FROM {CRAWL_JOBS.sql} WHERE status='SUCCESS' AND id%2=0)
SELECT e.id AS error_id, cast(e.retry_count+1 AS int) AS retry_count, timestamp '1998-06-01' + to_minutes(least(60, 1 << least(e.retry_count+1, 6))) AS discovered_at FROM e JOIN {REGISTRY.sql} r ON r.id=(e.s%90)+1
WHERE e.retry_count < CASE WHEN max_retries>0 THEN max_retries ELSE 3 END AND NOT EXISTS (SELECT 1 FROM ok WHERE ok.s=e.s AND ok.canonical_url=e.canonical_url)""")
def scheduled_retries(spark, d):
    jobs = CRAWL_JOBS(spark, d)
    errors = jobs.where("status = 'FAILED'").select(
        "id", "source_registry_id", F.col("canonical_url").alias("failed_url"), F.lit(True).alias("retryable"), "retry_count",
        F.when(F.col("trigger_type") != "RETRY", F.col("discovered_at")).alias("resolved_at"),
    )
    limits = REGISTRY(spark, d).select((F.col("id") - 1).alias("k"), "max_retries")
    keys = jobs.select("source_registry_id").distinct().withColumn("k", F.col("source_registry_id") % 90)
    sources = keys.join(limits, "k").select("source_registry_id", "max_retries")
    return B.schedule_retries(errors, jobs.where("id % 2 = 0"), sources, "1998-06-01 00:00:00").select("error_id", F.col("retry_count").cast("int").alias("retry_count"), "discovered_at")


@query("plain_pages", f"SELECT doc_id, {strip('text')}='' AS empty, length({rx('text', WS + '+')}) AS solid FROM documents")
def plain_pages(spark, d):
    from ..functions.core import is_blank, squeeze

    return DOCS(spark, d).select(F.col("id").alias("doc_id"), is_blank("text").alias("empty"), F.length(squeeze("text")).cast("bigint").alias("solid"))
