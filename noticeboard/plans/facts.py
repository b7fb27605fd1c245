"""Page texts, sections, metadata, extracted facts and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as E
from ..operators import aggregates as A, facts as X, joins as J, ranking as W, structure as S
from ..sources.tables import load, spread
from .registry import query
from .textual import _Q, LINES, any_, cn_date, sq, strip

CN = "strftime(o_orderdate, '%Y') || '年' || cast(month(o_orderdate) AS string) || '月' || cast(day(o_orderdate) AS string) || '日'"


def orders(spark, d):
    """Texts are made of the orders here: pattern work, so a small table is dealt out to the cores."""
    return spread(load(spark, d, "orders"))


def order_segments(spark, d, text, extra=()):
    """One segment per order, on the page its status names."""
    page = F.when(F.col("o_orderstatus") == "F", 1).otherwise(2)
    return orders(spark, d).select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("segment_id"), page.alias("page_no"), text.alias("text"), *extra)


# -------------------------------------------------------------- pages, segments --
def doc_lines(spark, d):
    """Every non-empty line of a document is one page of it."""
    lines = load(spark, d, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.withColumn("page_no", F.col("pos") + 1).where(F.regexp_replace("text", r"(?U)\s+", "") != "")


_LINES_SQL = f"""l0 AS (SELECT doc_id, lang, unnest(string_split(text, E'\\n')) AS text, generate_subscripts(string_split(text, E'\\n'), 1) AS page_no FROM documents), l AS (SELECT * FROM l0 WHERE {sq('text')}<>'')"""


@query("repeated_edges", f"WITH {_LINES_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM l) SELECT doc_id, page_no, length(CASE WHEN n>=3 THEN trim(text) ELSE 'head of ' || lang || E'\\n' || text || E'\\nfoot' END) AS chars FROM n")
def repeated_edges(spark, d):
    """A common first and last line is taken off documents of three or more pages."""
    pages = doc_lines(spark, d).withColumn("text", F.concat(F.lit("head of "), "lang", F.lit("\n"), "text", F.lit("\nfoot")))
    out = A.strip_repeated_edges(pages.select("doc_id", "page_no", "text"))
    return out.select("doc_id", "page_no", F.length("text").alias("chars"))


_CHOICE_SQL = _Q.replace("CASE lang WHEN 'de' THEN 0.5::double ELSE 0.1::double END", "0.1::double")


@query("page_choice", f"""WITH {_CHOICE_SQL}, o AS (SELECT *, lang IN ('de','es') AS alt, floor(greatest(0.0::double, least(1.0::double, raw_score))*10000.0::double+0.5::double)/10000.0::double AS sc FROM z)
SELECT doc_id, CASE WHEN alt AND quality<>'POOR' THEN 'OCR' ELSE 'TEXT_LAYER' END AS chosen_source, quality, CASE WHEN alt AND quality='POOR' THEN 0.0::double ELSE sc END AS score FROM o""")
def page_choice(spark, d):
    """Pages in two languages have no text of their own and take the alternative, unless it is poor."""
    pages = load(spark, d, "documents").select(
        "doc_id", F.lit(1).alias("page_no"), F.when(F.col("lang").isin("de", "es"), "").otherwise(F.col("text")).alias("text"), F.col("text").alias("alt_text"), F.lit(0.1).alias("image_ratio")
    )
    return S.choose_page_text(pages).select("doc_id", "chosen_source", "quality", "score")


@query("segment_offsets", f"WITH {_LINES_SQL}, c0 AS (SELECT doc_id, page_no, 'p' || cast(page_no AS string) || ' ' || text AS t, count(*) OVER (PARTITION BY doc_id) AS n FROM l), c AS (SELECT * FROM c0 WHERE NOT (n=3 AND length(t)<100)) SELECT doc_id, page_no, cast(coalesce(sum(length(t)+1) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS start_offset FROM c")
def segment_offsets(spark, d):
    """A short one-line page counts as first and as last line, which is enough to drop it from a document of three pages."""
    chosen = doc_lines(spark, d).withColumn("chosen_text", F.concat(F.lit("p"), F.col("page_no").cast("string"), F.lit(" "), F.col("text")))
    return S.page_segments(chosen).select("doc_id", "page_no", "start_offset")


HEADING = r"^(?:The|Le|La|Der|Die|El|En|In|Of)[ .,]"
_SECTIONS_SQL = f"""{_LINES_SQL}, s1 AS (SELECT doc_id, page_no, {strip('text')} AS t FROM l), s2 AS (SELECT *, length(t)<=80 AND regexp_matches(t, '^(The|Le|La|Der|Die|El|En|In|Of)[ .,]') AS h FROM s1 WHERE t<>''),
s3 AS (SELECT *, cast(sum(h::int) OVER (PARTITION BY doc_id ORDER BY page_no) AS bigint) AS section_no FROM s2),
s4 AS (SELECT doc_id, section_no, arg_min(h, page_no) AS h, arg_min(t, page_no) AS first, min(page_no) AS page_no, count(*) AS lines, length(string_agg(t, E'\\n' ORDER BY page_no)) AS chars, string_agg(t, E'\\n' ORDER BY page_no) AS body FROM s3 GROUP BY 1,2)"""


def line_segments(spark, d):
    return doc_lines(spark, d).select("doc_id", F.col("page_no").cast("bigint").alias("segment_id"), "page_no", "text")


def sections(spark, d, max_chars=None):
    return S.split_sections(line_segments(spark, d), max_chars=max_chars, heading=HEADING)


@query("document_sections", f"WITH {_SECTIONS_SQL} SELECT doc_id, section_no, CASE WHEN h THEN first ELSE '正文' END AS title, chars, lines FROM s4")
def document_sections(spark, d):
    return sections(spark, d).select("doc_id", "section_no", "title", F.length("text").cast("bigint").alias("chars"), F.size("segment_ids").cast("bigint").alias("lines"))


# greedy packing line by line: a part ends where the next line would make it too long, a line that is too long itself is cut into pieces
_PARTS_SQL = f"""{_SECTIONS_SQL}, b0 AS (SELECT s3.doc_id, s3.section_no, page_no, t, row_number() OVER w AS i, count(*) OVER (PARTITION BY s3.doc_id, s3.section_no) AS c FROM s3 WINDOW w AS (PARTITION BY s3.doc_id, s3.section_no ORDER BY page_no)),
b1 AS (SELECT b0.doc_id, b0.section_no, i, t || CASE WHEN i<c THEN E'\\n' ELSE '' END AS s, chars>900 AS cut FROM b0 JOIN s4 ON s4.doc_id=b0.doc_id AND s4.section_no=b0.section_no),
b2 AS (SELECT *, length(s) AS n, cut AND length(s)>900 AS long FROM b1),
b3 AS (SELECT doc_id, section_no, i, 0 AS g, CASE WHEN long THEN 0 ELSE n END AS filled FROM b2 WHERE i=1 UNION ALL
 SELECT b2.doc_id, b2.section_no, b2.i, CASE WHEN b2.cut AND (b2.long OR filled=0 OR filled+n>900) THEN g+1 ELSE g END, CASE WHEN b2.long THEN 0 WHEN b2.cut AND filled+n>900 THEN n ELSE filled+n END FROM b3 JOIN b2 ON b2.doc_id=b3.doc_id AND b2.section_no=b3.section_no AND b2.i=b3.i+1),
b4 AS (SELECT b2.doc_id, b2.section_no, g, bool_or(long) AS long, string_agg(s, '' ORDER BY b2.i) AS body FROM b2 JOIN b3 ON b2.doc_id=b3.doc_id AND b2.section_no=b3.section_no AND b2.i=b3.i GROUP BY 1,2,3),
b5 AS (SELECT doc_id, section_no, g, unnest(CASE WHEN long THEN regexp_extract_all(body, '(?s).{{1,900}}') ELSE [body] END) AS x, unnest(range(CASE WHEN long THEN len(regexp_extract_all(body, '(?s).{{1,900}}')) ELSE 1 END)) AS k FROM b4),
b6 AS (SELECT doc_id, section_no, g, k, {strip('x')} AS x FROM b5)"""


@query("bounded_sections", f"WITH RECURSIVE {_PARTS_SQL} SELECT doc_id, section_no, cast(row_number() OVER (PARTITION BY doc_id, section_no ORDER BY g, k) - 1 AS int) AS part_no, cast(length(x) AS int) AS chars FROM b6 WHERE x<>''")
def bounded_sections(spark, d):
    """Long sections in parts of at most 900 characters."""
    return sections(spark, d, 900).select("doc_id", "section_no", "part_no", F.length("text").alias("chars"))


@query("section_outline", f"WITH {_SECTIONS_SQL} SELECT doc_id, section_no, substr(body, 1, 120) AS summary FROM s4")
def section_outline(spark, d):
    return S.outline(sections(spark, d)).select("doc_id", "section_no", "summary")


@query("section_facts", f"WITH {_SECTIONS_SQL}, f AS (SELECT s4.*, CASE WHEN h THEN first ELSE '正文' END AS title, lang FROM s4 JOIN documents USING (doc_id)) SELECT doc_id, section_no, CASE WHEN contains(title,'tion') THEN 'tion' ELSE 'the' END AS label, substr(body, 1, 240) AS value FROM f WHERE lang='en' AND (contains(title,'tion') OR contains(title,'the'))")
def section_facts(spark, d):
    kinds = load(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "en", "STANDARD").otherwise("OTHER").alias("document_kind"))
    return S.type_facts(sections(spark, d), kinds, labels={"STANDARD": ["tion", "the"]}).select("doc_id", "section_no", "label", "value")


_CHUNKS_SQL = f"""{_SECTIONS_SQL}, k0 AS (SELECT doc_id, section_no, count(*) AS m, sum(length(l.text)) AS n FROM s3 JOIN l USING (doc_id, page_no) GROUP BY 1,2),
k1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section_no) AS k FROM k0),
k2 AS (SELECT doc_id, k, 0 AS g, m, n, n AS filled FROM k1 WHERE k=1 UNION ALL
 SELECT k1.doc_id, k1.k, CASE WHEN filled+k1.n>1500 THEN g+1 ELSE g END, k1.m, k1.n, CASE WHEN filled+k1.n>1500 THEN k1.n ELSE filled+k1.n END FROM k2 JOIN k1 ON k1.doc_id=k2.doc_id AND k1.k=k2.k+1),
whole AS (SELECT doc_id, count(*) AS m, sum(length(text)) AS n FROM l GROUP BY 1 HAVING sum(length(text)+1)-1<=2000 OR doc_id NOT IN (SELECT doc_id FROM k0))"""


@query("packed_chunks", f"""WITH RECURSIVE {_CHUNKS_SQL} SELECT doc_id, cast(least(g, 7) AS int) AS chunk_no, cast(sum(m) AS int) AS segments, cast(sum(n) AS bigint) AS chars FROM k2 WHERE doc_id NOT IN (SELECT doc_id FROM whole) GROUP BY 1,2
UNION ALL SELECT doc_id, 0, cast(m AS int), cast(n AS bigint) FROM whole""")
def packed_chunks(spark, d):
    """Sections packed in order into chunks of 1,500 characters; the rest of a document is its eighth chunk."""
    return S.pack_chunks(sections(spark, d), line_segments(spark, d), threshold=2000, chunk_chars=1500, max_chunks=8).select("doc_id", "chunk_no", F.size("segment_ids").alias("segments"), "chars")


_META_SQL = rf"""m0 AS (SELECT doc_id, lang, list_filter(list_transform(string_split_regex(text, '{LINES}'), lambda x: {strip('x')}), lambda x: x<>'') AS ls FROM documents),
m1 AS (SELECT doc_id, ls, 'file ' || cast(doc_id AS string) AS f, coalesce(list_extract(list_filter(list_transform(ls, lambda x: regexp_extract(x, '[0-9]{{3}}-[0-9]{{4}}')), lambda x: x<>''), 1), '') AS document_number,
 list_extract(list_filter(ls, lambda x: length(x) BETWEEN 4 AND 80 AND {any_('x', ['tion', 'ment', 'ung'])}), 1) AS cand FROM m0),
m2 AS (SELECT *, coalesce(cand, f) AS title FROM m1), m3 AS (SELECT *, CASE WHEN list_contains(ls, title) THEN list_position(ls, title)-1 ELSE len(ls) END AS ti FROM m2),
u AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls,1)-1 AS i, ti FROM m3), p AS (SELECT * FROM u WHERE regexp_matches(x, '^.{{2,50}}(that|les|und|que)\.$')),
q AS (SELECT *, max((i<=ti+2)::int) OVER (PARTITION BY doc_id) AS anynear FROM p), r AS (SELECT doc_id, count(DISTINCT x) AS n, any_value(x) AS x, min(i) AS i FROM q WHERE i<=ti+2 OR anynear=0 GROUP BY 1)"""


@query("document_metadata", f"""WITH {_META_SQL} SELECT m3.doc_id, title, document_number, CASE WHEN n=1 THEN x ELSE '' END AS source_name, CASE WHEN n=1 THEN 'DOCUMENT_EVIDENCE' WHEN n>1 THEN 'CONFLICT' ELSE 'UNCONFIRMED' END AS authority_status,
CASE WHEN n=1 THEN (CASE WHEN r.i<=ti THEN 'HEADER' ELSE 'SIGNATURE' END) WHEN n>1 THEN 'NONE' ELSE 'FILENAME' END AS evidence_type FROM m3 LEFT JOIN r ON r.doc_id=m3.doc_id""")
def document_metadata(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.col("text").alias("preview_text"), F.concat(F.lit("file_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"), F.lit(1).alias("page_count"))
    out = S.detect_metadata(docs, title_words=["tion", "ment", "ung"], publisher=r"^.{2,50}(?:that|les|und|que)\.$", number=r"[0-9]{3}-[0-9]{4}", types=[(["that"], "a")])
    return out.select("doc_id", "title", "document_number", "source_name", "authority_status", "evidence_type")


# ------------------------------------------------------------------- extraction --
def session_text():
    return F.concat(F.lit("安排：\n"), cn_date(), F.lit(" 09:00 — 11:30 第"), F.col("o_custkey").cast("string"), F.lit("服务中心。另见说明"))


@query("sessions", f"SELECT o_custkey AS doc_id, {CN} AS date, '09:00-11:30' AS time, '第' || cast(o_custkey AS string) || '服务中心' AS location, count(*) AS n FROM orders GROUP BY ALL")
def sessions(spark, d):
    seg = order_segments(spark, d, session_text())
    found = seg.select("doc_id", F.explode(E.sessions("text")).alias("s")).select("doc_id", "s.date", "s.time", "s.location")
    return found.groupBy("doc_id", "date", "time", "location").agg(F.count("*").alias("n"))


@query("new_sessions", f"WITH s AS (SELECT o_custkey AS doc_id, {CN} AS date, min(CASE WHEN o_orderstatus='F' THEN 1 ELSE 2 END) AS page_no FROM orders GROUP BY 1,2) SELECT doc_id, date, page_no FROM s")
def new_sessions(spark, d):
    """Sessions of the first page are known, the ones of the other pages are added."""
    seg = order_segments(spark, d, session_text())
    known = X.extract_sessions(seg.where("page_no = 1"))
    return X.complete_sessions(known, seg).select("doc_id", "date", "page_no")


@query("service_windows", "SELECT o_custkey AS doc_id, CASE WHEN o_orderstatus='F' THEN '周一 周三' ELSE '星期五' END AS days, CASE WHEN o_orderstatus='F' THEN '8:30-11:30' ELSE '9:00-11:00 13:00-16:00' END AS times, CASE WHEN o_orderstatus='F' THEN '下午不开放' END AS note, max(o_orderpriority) AS location FROM orders GROUP BY 1,2,3,4")
def service_windows(spark, d):
    """Weekday tables; windows of one kind are merged per document."""
    f = F.col("o_orderstatus") == "F"
    text = F.when(f, "周一、周三\n8:30—11:30\n不开放\n").otherwise("星期五\r\n9:00 - 11:00\r\n13:00至16:00")
    seg = order_segments(spark, d, text, [F.col("o_orderpriority").alias("place")])
    found = X.extract_windows(seg)
    top = seg.withColumn("f", F.col("page_no") == 1).groupBy("doc_id", "f").agg(F.max("place").alias("place"))
    located = found.withColumn("f", F.col("unavailable_note").isNotNull()).join(top, ["doc_id", "f"]).withColumns({"location": F.col("place"), "pos": F.col("segment_id")})
    return A.merge_windows(located).select("doc_id", F.array_join("k_days", " ").alias("days"), F.array_join("k_times", " ").alias("times"), F.col("unavailable_note").alias("note"), "location")


@query("fee_clauses", "SELECT DISTINCT o_custkey AS doc_id, '办证工本费' AS fee_type, '每证' || cast(o_custkey%50 AS string) || '元' AS amount, NULL AS rule, '微信 现金支付' AS methods FROM orders UNION ALL SELECT DISTINCT o_custkey, '检测费', NULL, '按规定标准收取', '微信 现金支付' FROM orders")
def fee_clauses(spark, d):
    text = F.concat(F.lit("办证工本费每证 "), (F.col("o_custkey") % 50).cast("string"), F.lit("元；检测费按规定标准收取。支持微信及现金支付。"))
    out = X.extract_fees(order_segments(spark, d, text))
    return out.select("doc_id", "fee_type", "amount", "rule", F.array_join("payment_methods", " ").alias("methods"))


@query("merged_fees", "SELECT doc_id, fee_key, count(*) AS n FROM (SELECT DISTINCT o_custkey AS doc_id, unnest(['办证','检测','打印']) AS fee_key FROM orders) GROUP BY 1,2")
def merged_fees(spark, d):
    """Known fees (other spellings of the same kinds and one more) and the fees of the text."""
    text = F.concat(F.lit("办证工本费每证 "), (F.col("o_custkey") % 50).cast("string"), F.lit("元；检测费按规定标准收取。支持微信及现金支付。"))
    seg = order_segments(spark, d, text)
    known = seg.select("doc_id").distinct().select(
        "doc_id", F.explode(F.array(F.lit("办 证费用"), F.lit("打印服务费"))).alias("fee_type"), F.lit("1元").alias("amount"), F.lit(None).cast("string").alias("rule"),
        F.array(F.lit("现金支付"), F.lit("刷卡")).alias("payment_methods"), F.lit("q").alias("source_quote"), F.lit(False).alias("needs_human_review"), F.lit(0).cast("bigint").alias("pos"),
    )
    return X.complete_fees(known, seg).groupBy("doc_id", "fee_key").agg(F.count("*").alias("n"))


@query("temporal_facts", f"""WITH o AS (SELECT o_custkey AS doc_id, {CN} AS a, o_orderstatus AS s FROM orders), k AS (SELECT DISTINCT doc_id, a FROM o WHERE s='O')
SELECT DISTINCT doc_id, 'EVENT_DATE' AS field_type, a || ' → 2030年1月1日' AS value FROM o WHERE s<>'P' AND NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id=o.doc_id AND k.a=o.a) UNION ALL SELECT DISTINCT doc_id, 'END_DATE', a || '17:00前' FROM o WHERE s<>'P'""")
def temporal_facts(spark, d):
    """Moved dates a fact does not carry yet, and deadlines."""
    day = cn_date()
    text = F.when(F.col("o_orderstatus") == "P", "无").otherwise(F.concat(F.lit("原预约日期为 "), day, F.lit("的，顺延至2030年1月1日。请于"), day, F.lit(" 17:00前确认")))
    seg = order_segments(spark, d, text)
    known = orders(spark, d).where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("doc_id"), F.lit("EVENT_DATE").alias("field_type"), F.concat(day, F.lit("改到 2030年1月1日")).alias("value"))
    return X.complete_temporal(known, seg).select("doc_id", "field_type", "value")


@query("guide_fields", f"""SELECT o_orderkey, 'START_DATE' AS field_type, {CN} AS value, 1 AS page_no FROM orders UNION ALL SELECT o_orderkey, 'END_DATE', strftime(o_orderdate, '%Y') || '年12月31日', 1 FROM orders
UNION ALL SELECT o_orderkey, 'LOCATION', '窗口' || cast(o_custkey AS string), 2 FROM orders UNION ALL SELECT o_orderkey, 'FEE', '免费', 2 FROM orders WHERE o_orderstatus='F' UNION ALL SELECT o_orderkey, 'TARGET_AUDIENCE', '60周岁及以上常住居民', 2 FROM orders WHERE o_orderstatus<>'F'""")
def guide_fields(spark, d):
    text = F.concat(
        F.lit("报名时间为"), cn_date(), F.lit("至12月31日\f办理地点：窗口"), F.col("o_custkey").cast("string"), F.lit("。"),
        F.when(F.col("o_orderstatus") == "F", "活动不收取任何费用").otherwise("本街道常住居民，原则上年龄为60周岁及以上"),
    )
    return orders(spark, d).select("o_orderkey", F.inline(E.guide_fields(text))).select("o_orderkey", "field_type", "value", "page_no")


@query("guide_digests", f"SELECT o_orderkey, '报名开始日期：' || {CN} || '；报名截止日期：' || strftime(o_orderdate, '%Y') || '年12月31日；活动日期：' || {CN} || '。' AS plain_text, 2 AS summary_lines FROM orders")
def guide_digests(spark, d):
    text = F.concat(F.lit("报名时间为"), cn_date(), F.lit("至12月31日"))
    q = orders(spark, d).select("o_orderkey", text.alias("t")).withColumn("f", E.guide_fields("t")).withColumn("g", E.guide_digest("t", "f"))
    return q.select("o_orderkey", "g.plain_text", F.size("g.summary").alias("summary_lines"))


@query("news_facts", f"""WITH {_LINES_SQL}, s AS (SELECT doc_id, page_no, {strip('text')} AS t FROM l WHERE {strip('text')}<>''), ok AS (SELECT doc_id FROM documents), w AS (SELECT doc_id, count(*) AS n FROM s WHERE contains(t, 'quement') OR contains(t, 'ungen') GROUP BY 1), v AS (SELECT DISTINCT doc_id FROM s WHERE contains(t,'tion'))
SELECT ok.doc_id, CASE WHEN w.n>0 THEN 'WARNING' ELSE 'SERVICE_TIME' END AS field_type, coalesce(w.n, 1) AS n FROM ok LEFT JOIN w USING (doc_id) LEFT JOIN v USING (doc_id) WHERE w.n>0 OR v.doc_id IS NOT NULL""")
def news_facts(spark, d):
    docs = load(spark, d, "documents")
    f = docs.select("doc_id", F.inline(E.news_facts(E.news_sentences("text"), ["quement", "ungen"], ["tion"])))
    return f.groupBy("doc_id", "field_type").agg(F.count("*").alias("n"))


# --------------------------------------------------------------------- checking --
def line_facts(spark, d):
    """Facts about order lines: the quote comes from the order's text with other white space."""
    n = F.col("l_linenumber")
    return spread(load(spark, d, "lineitem")).select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") * 10 + n).alias("fact_id"), F.when(n == 1, "START_DATE").otherwise("CONTACT").alias("field_type"), F.lit("label").alias("label"),
        F.when(n == 5, "99999").otherwise(F.col("l_orderkey").cast("string")).alias("value"),
        F.when(n == 4, "not in the text").otherwise(F.concat(F.lit("order"), F.col("l_orderkey").cast("string"), F.lit("of 7"))).alias("source_quote"),
        F.when(n == 3, 2).otherwise(1).alias("page_no"), F.when(n == 2, F.lit(-1).cast("bigint")).otherwise(F.col("l_orderkey")).alias("segment_id"), F.lit(0.9).alias("confidence"),
    )


def order_text(spark, d):
    text = F.concat(F.lit("see order "), F.col("o_orderkey").cast("string"), F.lit("\nof 7 made by "), F.col("o_custkey").cast("string"))
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderkey").alias("segment_id"), F.lit(1).alias("page_no"), F.lit(1).alias("segment_no"), text.alias("text"))


_REASON_SQL = "CASE l_linenumber WHEN 2 THEN 'segment_not_found' WHEN 3 THEN 'page_mismatch' WHEN 4 THEN 'source_quote_not_found' WHEN 5 THEN (CASE WHEN l_orderkey=99999 THEN NULL ELSE 'numeric_mismatch' END) END"


@query("traced_facts", f"SELECT l_orderkey AS doc_id, l_partkey*10+l_linenumber AS fact_id, {_REASON_SQL} AS reject_reason, CASE WHEN {_REASON_SQL} IS NULL THEN 'order ' || cast(l_orderkey AS string) || E'\\nof 7' END AS quote, CASE WHEN l_linenumber=1 THEN 'order ' || cast(l_orderkey AS string) || E'\\nof 7' ELSE CASE WHEN l_linenumber=5 THEN '99999' ELSE cast(l_orderkey AS string) END END AS value FROM lineitem")
def traced_facts(spark, d):
    out = X.validate_traces(line_facts(spark, d), order_text(spark, d))
    return out.select("doc_id", "fact_id", "reject_reason", F.when(F.col("reject_reason").isNull(), F.col("source_quote")).alias("quote"), "value")


@query("fact_audit", f"WITH r AS (SELECT coalesce({_REASON_SQL}, 'trace_valid') AS reason FROM lineitem) SELECT reason, count(*) AS n FROM r GROUP BY 1 UNION ALL SELECT 'raw', count(*) FROM r UNION ALL SELECT 'schema_valid', count(*) FROM r")
def fact_audit(spark, d):
    return A.fact_audit(X.validate_traces(line_facts(spark, d), order_text(spark, d)))


@query("located_quotes", "SELECT o_orderkey AS fact_id, 'made by ' || cast(o_custkey AS string) AS located_quote FROM orders WHERE o_orderstatus<>'P'")
def located_quotes(spark, d):
    """Quotes with other white space find their original characters; wrong ones are dropped."""
    by = F.col("o_custkey").cast("string")
    quote = F.when(F.col("o_orderstatus") == "P", "nobody at all").when(F.col("o_orderstatus") == "F", F.concat(F.lit("made  by\n"), by)).otherwise(F.concat(F.lit("made by "), by))
    facts = load(spark, d, "orders").select(F.col("o_orderkey").alias("fact_id"), F.col("o_orderkey").alias("doc_id"), quote.alias("source_quote"))
    return J.locate_quotes(facts, order_text(spark, d)).select("fact_id", "located_quote")


_CUT_SQL = "SELECT doc_id, page_no, regexp_replace(text, '\\s+', '', 'g') AS t, regexp_replace(substr(text, 1 + page_no % 7, 5 + page_no % 23), '\\s+', '', 'g') AS q FROM l"


@query("located_lines", f"WITH {_LINES_SQL}, c AS ({_CUT_SQL}) SELECT a.doc_id, a.page_no AS fact, min(b.page_no) AS located_segment FROM c a JOIN c b ON a.doc_id=b.doc_id AND contains(b.t, a.q) WHERE a.q<>'' GROUP BY 1, 2")
def located_lines(spark, d):
    """Pieces of every line of every document, found in the first line that has them: many quotes and segments per document."""
    lines = line_segments(spark, d)
    n = F.col("page_no")
    cut = F.regexp_replace(F.substring(F.col("text"), 1 + n % 7, 5 + n % 23), " ", "  ")
    facts = lines.select(F.concat_ws(":", "doc_id", "page_no").alias("fact_id"), "doc_id", n.cast("bigint").alias("fact"), cut.alias("source_quote"))
    found = J.locate_quotes(facts, lines.withColumn("segment_no", F.lit(1)))
    return found.select("doc_id", "fact", "located_segment")


@query("duplicate_conditions", "SELECT o_custkey AS doc_id, max(o_orderstatus) FILTER (o_orderkey=k) <> 'P' AS duplicate_suspected FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey) AS k FROM orders) GROUP BY 1")
def duplicate_conditions(spark, d):
    """The first order of each customer decides: status P has different conditions."""
    s = F.col("o_orderstatus")
    pair = F.array(
        F.struct(F.lit("TARGET_AUDIENCE").alias("t"), F.lit("resident, sixty and older").alias("v")),
        F.struct(F.lit("ELIGIBILITY").alias("t"), F.when(s == "F", "resident， sixty and older。").when(s == "O", "resident, sixty and olderx").otherwise("something else").alias("v")),
    )
    facts = orders(spark, d).select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("fact_id"), F.explode(pair).alias("p")).select("doc_id", "fact_id", F.col("p.t").alias("field_type"), F.col("p.v").alias("value"), F.lit("q").alias("source_quote"))
    return X.duplicate_conditions(facts).select("doc_id", "duplicate_suspected")


@query("split_audience", "SELECT o_orderkey AS doc_id, unnest(['TARGET_AUDIENCE','ELIGIBILITY']) AS field_type, unnest(CASE WHEN o_orderstatus='P' THEN ['年满60周岁，目前未领取补贴者','其他'] ELSE ['本市户籍且年满' || cast(o_custkey AS string) || '周岁','目前未领取补贴'] END) AS value FROM orders")
def split_audience(spark, d):
    both = F.concat(F.lit("本市户籍且年满"), F.col("o_custkey").cast("string"), F.lit("周岁，目前未领取补贴者"))
    p = F.col("o_orderstatus") == "P"
    pair = F.array(
        F.struct(F.lit(1).alias("i"), F.lit("TARGET_AUDIENCE").alias("t"), F.when(p, "年满60周岁，目前未领取补贴者").otherwise(both).alias("v")),
        F.struct(F.lit(2).alias("i"), F.lit("ELIGIBILITY").alias("t"), F.when(p, "其他").otherwise(both).alias("v")),
    )
    facts = orders(spark, d).select(F.col("o_orderkey").alias("doc_id"), F.explode(pair).alias("p")).select("doc_id", F.col("p.i").alias("fact_id"), F.col("p.t").alias("field_type"), F.col("p.v").alias("value"), F.lit("q").alias("source_quote"))
    return X.split_audience(facts).select("doc_id", "field_type", "value")


def raw_facts(spark, d):
    n = F.col("l_linenumber")
    body = (
        F.when(n == 1, F.concat(F.lit('{"field_type":"phone","value":"'), F.col("l_partkey").cast("string"), F.lit('"}')))
        .when(n == 2, '{"field_type":"FEE","value":"1","extra":true}').when(n == 3, '{"field_type":"NOPE"}').when(n == 4, "[1]").otherwise('{"field_type":"LOCATION","value":"x"}')
    )
    return spread(load(spark, d, "lineitem")).select(F.col("l_orderkey").alias("doc_id"), n.alias("pos"), body.alias("raw"))


@query("repaired_facts", "SELECT l_orderkey AS doc_id, l_linenumber AS pos, CASE l_linenumber WHEN 1 THEN 'CONTACT' WHEN 2 THEN 'FEE' ELSE 'LOCATION' END AS field_type, CASE l_linenumber WHEN 1 THEN cast(l_partkey AS string) WHEN 2 THEN '1' ELSE 'x' END AS value FROM lineitem WHERE l_linenumber NOT IN (3,4)")
def repaired_facts(spark, d):
    return X.repair_facts(raw_facts(spark, d))[0].select("doc_id", "pos", "field_type", "value")


@query("quarantined_facts", "SELECT l_orderkey AS doc_id, '$.fields[' || cast(l_linenumber AS string) || ']' || CASE l_linenumber WHEN 2 THEN '.extra' WHEN 3 THEN '.field_type' ELSE '' END AS path, CASE l_linenumber WHEN 2 THEN 'UNKNOWN_KEY' WHEN 3 THEN 'UNKNOWN_TYPE' ELSE 'NOT_AN_OBJECT' END AS problem FROM lineitem WHERE l_linenumber IN (2,3,4)")
def quarantined_facts(spark, d):
    return X.repair_facts(raw_facts(spark, d))[1].select("doc_id", "path", "problem")


@query("valid_fields", "SELECT l_orderkey AS doc_id, count(*) AS fields, bool_and(l_quantity<>13 AND l_returnflag<>'R' OR (l_returnflag='R' AND l_quantity<>13 AND l_linestatus='O') OR (l_returnflag='R' AND l_quantity<>13 AND l_discount<0.1)) AS valid FROM lineitem GROUP BY 1")
def valid_fields(spark, d):
    """A blank value (quantity 13) or a confidence above one spoils the document."""
    bad = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") != "O") & (F.col("l_discount") >= 0.1)
    f = load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit("FEE").alias("field_type"), F.lit("l").alias("label"), F.when(F.col("l_quantity") == 13, " ").otherwise("v").alias("value"),
        F.lit("q").alias("source_quote"), F.when(bad, "1.5").otherwise("0.5").alias("confidence"),
    )
    return X.validate_fields(f)


# ------------------------------------------------------------ merging, summaries --
@query("merged_facts", "SELECT l_orderkey AS doc_id, l_returnflag AS list_key, '{\"a\":\"' || cast(l_suppkey%5 AS string) || '\"}' AS canonical, min(l_linenumber) AS chunk_no FROM lineitem GROUP BY 1,2,3")
def merged_facts(spark, d):
    item = F.concat(F.lit('{ "a" : '), (F.col("l_suppkey") % 5).cast("string"), F.lit("}"))
    c = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("list_key"), F.col("l_linenumber").alias("chunk_no"), F.col("l_partkey").alias("pos"), item.alias("item"))
    return A.merge_facts(c).select("doc_id", "list_key", "canonical", "chunk_no")


_ROLL_SQL = "SELECT l_orderkey AS doc_id, cast(sum(l_partkey) AS bigint) AS prompt_tokens, cast(sum(l_partkey+l_suppkey) AS bigint) AS total_tokens, cast({f}(l_quantity) AS bigint) AS elapsed_ms, bool_and(l_returnflag<>'R') AS json_parse_success, sha256(string_agg(sha256(cast(l_partkey AS string)), '' ORDER BY l_linenumber, l_partkey, sha256(cast(l_partkey AS string)))) AS response_sha256 FROM lineitem GROUP BY 1"


def _chunks(spark, d):
    return load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.struct("l_linenumber", "l_partkey").alias("chunk_no"), F.col("l_partkey").alias("prompt_tokens"), F.col("l_suppkey").alias("completion_tokens"), F.col("l_quantity").cast("bigint").alias("elapsed_ms"),
        F.lit(0).alias("retry_count"), F.lit(1).alias("response_length"), (F.col("l_returnflag") != "R").alias("parse_ok"), F.lit(False).alias("normalized"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("response_sha256"),
    )


@query("chunk_rollup", _ROLL_SQL.format(f="max"))
def chunk_rollup(spark, d):
    return A.rollup(_chunks(spark, d)).select("doc_id", "prompt_tokens", "total_tokens", "elapsed_ms", "json_parse_success", "response_sha256")


@query("chunk_rollup_sequential", _ROLL_SQL.format(f="sum"))
def chunk_rollup_sequential(spark, d):
    return A.rollup(_chunks(spark, d), "sequential").select("doc_id", "prompt_tokens", "total_tokens", "elapsed_ms", "json_parse_success", "response_sha256")


_TYPES_SQL = "CASE l_linenumber%4 WHEN 0 THEN 'WARNING' WHEN 1 THEN 'LOCATION' WHEN 2 THEN 'MATERIAL' ELSE 'RESULT_TIME' END"


def typed_facts(spark, d):
    n = F.col("l_linenumber") % 4
    return load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("fact_id"), F.when(n == 0, "WARNING").when(n == 1, "LOCATION").when(n == 2, "MATERIAL").otherwise("RESULT_TIME").alias("field_type"),
        F.lit("L").alias("label"), F.col("l_partkey").cast("string").alias("value"),
    )


@query("fact_summaries", f"""WITH f AS (SELECT l_orderkey AS doc_id, 'L：' || cast(l_partkey AS string) AS line, {_TYPES_SQL} AS t, l_linenumber AS a, l_partkey AS b, l_suppkey AS c FROM lineitem),
r AS (SELECT *, CASE t WHEN 'LOCATION' THEN 1 WHEN 'MATERIAL' THEN 2 WHEN 'WARNING' THEN 3 ELSE 9 END AS k, max((t<>'RESULT_TIME')::int) OVER (PARTITION BY doc_id) AS known FROM f), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, a, b, c) AS rn FROM r WHERE known=0 OR k<9)
SELECT doc_id, string_agg(line, '|' ORDER BY rn) FILTER (rn<=3) AS summary, length('已根据可追溯事实生成基础易读版本。') + sum(length(line)+1) AS plain_chars FROM n GROUP BY 1""")
def fact_summaries(spark, d):
    return X.fact_summary(typed_facts(spark, d)).select("doc_id", F.array_join("summary", "|").alias("summary"), F.length("plain_text").cast("bigint").alias("plain_chars"))


@query("session_summaries", f"""WITH s AS (SELECT o_custkey AS doc_id, o_orderdate, {CN} || '接种时间为09:00-11:30' AS line, min(o_orderkey) AS k, min(CASE WHEN o_orderstatus='F' THEN 1 ELSE 2 END) AS p FROM orders GROUP BY 1,2,3),
g AS (SELECT o_custkey AS doc_id, o_orderdate, min(struct_pack(p := CASE WHEN o_orderstatus='F' THEN 1 ELSE 2 END, k := o_orderkey)) AS place FROM orders GROUP BY 1,2)
SELECT s.doc_id, '成年人，可以登记。|' || string_agg(line, '；' ORDER BY place.p, place.k) || '。|请带' || cast(s.doc_id AS string) || '；到第' || cast(s.doc_id AS string) || '服务中心。' AS summary FROM s JOIN g USING (doc_id, o_orderdate) GROUP BY s.doc_id""")
def session_summaries(spark, d):
    seg = order_segments(spark, d, session_text())
    docs = orders(spark, d).select(F.col("o_custkey").alias("doc_id")).distinct()
    facts = docs.select("doc_id", F.explode(F.array(
        F.struct(F.lit(1).alias("i"), F.lit("TARGET_AUDIENCE").alias("t"), F.lit("成年人").alias("v")), F.struct(F.lit(2).alias("i"), F.lit("MATERIAL").alias("t"), F.col("doc_id").cast("string").alias("v")),
    )).alias("p")).select("doc_id", F.col("p.i").alias("fact_id"), F.col("p.t").alias("field_type"), F.col("p.v").alias("value"))
    return X.session_summary(facts, X.extract_sessions(seg)).select("doc_id", F.array_join("summary", "|").alias("summary"))


@query("lifecycle_dates", """WITH f AS (SELECT o_custkey AS document_id, o_orderkey AS id, CASE WHEN o_orderstatus='F' THEN 'S' ELSE 'E' END AS t, o_orderdate AS v FROM orders), a AS (SELECT document_id, arg_min(v, id) FILTER (t='S') AS s, arg_min(v, id) FILTER (t='E') AS e FROM f GROUP BY 1)
SELECT document_id, date_trunc('day', s)::timestamp AS effective_from, date_trunc('day', e)::timestamp + INTERVAL '23 hours 59 minutes 59 seconds' AS deadline_at, date_trunc('day', e)::timestamp + INTERVAL 1 DAY AS expires_at FROM a""")
def lifecycle_dates(spark, d):
    kind = F.when(F.col("o_orderstatus") == "F", "START_DATE").otherwise("END_DATE")
    f = orders(spark, d).select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("id"), kind.alias("field_type"), cn_date().alias("field_value"))
    return W.lifecycle(f)


@query("completed_temporal_values", "SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, CASE WHEN l_linenumber=1 THEN 'from ' || cast(l_partkey AS string) || ' to 5' ELSE cast(l_partkey AS string) END AS value FROM lineitem")
def completed_temporal_values(spark, d):
    from ..functions.texts import complete_temporal_value

    quote = F.concat(F.lit("from "), F.col("l_partkey").cast("string"), F.lit(" to 5"))
    kind = F.when(F.col("l_linenumber") == 1, "SERVICE_TIME").otherwise("CONTACT")
    value = complete_temporal_value(kind, F.when(F.col("l_linenumber") == 1, F.lit("x")).otherwise(F.col("l_partkey").cast("string")), quote)
    return load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", value.alias("value"))



