"""Fact extraction, repair, traces, completion, merging, summaries."""
import json
import re

from pyspark.sql import functions as F

from noticeboard.functions import extract as E
from noticeboard.operators import aggregates as A, facts as X, joins as J

FACT = "doc_id long, fact_id long, field_type string, label string, value string, source_quote string, page_no int, segment_id long, confidence double"
SEG = "doc_id long, segment_id long, page_no int, text string"


def facts(spark, rows):
    return spark.createDataFrame([(1, i + 1, *r) for i, r in enumerate(rows)], FACT)


def segs(spark, *texts):
    return spark.createDataFrame([(1, i + 1, i + 1, t) for i, t in enumerate(texts)], SEG)


def test_traces(spark):
    s = segs(spark, "咨询电话：021-5678 1234，时间为2026年7月1日 9:00 开始。", "第二页")
    f = facts(spark, [
        ("CONTACT", "电话", "021-56781234", "咨询电话：021-56781234", 1, 1, 0.9),
        ("CONTACT", "电话", "021-56781235", "咨询电话：021-5678 1234", 1, 1, 0.9),
        ("CONTACT", "电话", "x", "咨询", 2, 1, 0.9),
        ("CONTACT", "电话", "x", "不存在", 2, 2, 0.9),
        ("CONTACT", "电话", "x", "咨询", 1, 9, 0.9),
        ("START_DATE", "开始", "7月1日", "2026年7月1日 9:00", 1, 1, 0.9),
    ])
    out = X.validate_traces(f, s).orderBy("fact_id").collect()
    assert [r.reject_reason for r in out] == [None, "numeric_mismatch", "page_mismatch", "source_quote_not_found", "segment_not_found", None]
    assert out[0].source_quote == "咨询电话：021-5678 1234" and out[5].value == "2026年7月1日 9:00"
    audit = {r.reason: r.n for r in A.fact_audit(X.validate_traces(f, s)).collect()}
    assert audit["trace_valid"] == 2 and audit["raw"] == 6


def test_locate_quotes(spark):
    s = segs(spark, "first page text here", "the  quoted\nwords are on page two", "the quoted words again").withColumn("segment_no", F.lit(1))
    f = spark.createDataFrame([(1, 1, "the quoted words"), (1, 2, "page"), (1, 3, "nowhere to be found"), (1, 4, "ho")], "doc_id long, fact_id long, source_quote string")
    got = {r.fact_id: (r.located_segment, r.located_quote) for r in J.locate_quotes(f, s).collect()}
    assert got == {1: (2, "the  quoted\nwords"), 2: (1, "page")}


def test_locate_quotes_that_begin_alike(spark):
    """10,000 quotes of one document share their first words with each other and with every segment."""
    head = "the service is open to all residents at window "
    texts = [head + " ".join(str(100 * i + j) for j in range(100)) + " " + head for i in range(100)]
    s = segs(spark, *texts).withColumn("segment_no", F.lit(1))
    quotes = [f"{head}{100 * (k // 100)} {100 * (k // 100) + 1}" if k % 100 == 0 else f"{k}  {head}" if k % 100 == 99 else f"{k - 1} {k}\n{k + 1}" if k % 100 < 99 else head for k in range(10_000)]
    quotes += [head + "nowhere", "  ", "t", head]
    f = spark.createDataFrame([(1, k, q) for k, q in enumerate(quotes)], "doc_id long, fact_id long, source_quote string")
    squeezed = ["".join(t.split()) for t in texts]

    def expected(q):
        q = "".join(q.split())
        return next((i + 1 for i, t in enumerate(squeezed) if q and q in t), None)

    got = {r.fact_id: r.located_segment for r in J.locate_quotes(f, s).collect()}
    want = {k: expected(q) for k, q in enumerate(quotes)}
    assert got == {k: v for k, v in want.items() if v is not None} and len(got) == 10_002


def test_quotes_of_a_small_document_shuffle_no_pieces(spark):
    """The quotes of a document are tested on its segments; only a document with many of them is cut into pieces.  Facts keep columns named like those of segments."""
    s = segs(spark, "one two three four", "three four five", "six").withColumn("segment_no", F.lit(1))
    quotes = ["three  four", "four five", "six", "o", "seven", " ", "three four", "on e t"]
    f = spark.createDataFrame([(1, k, q, -k, 99) for k, q in enumerate(quotes)], "doc_id long, fact_id long, source_quote string, segment_id long, page_no int")
    out = {n: J.locate_quotes(f, s, direct=n) for n in (200, 3)}
    got = {n: sorted((r.fact_id, r.segment_id, r.located_segment, r.located_quote) for r in d.collect()) for n, d in out.items()}
    assert got[200] == got[3] == [(0, 0, 1, "three four"), (1, -1, 2, "four five"), (2, -2, 3, "six"), (3, -3, 1, "o"), (6, -6, 1, "three four"), (7, -7, 1, "one t")]

    lines = spark.range(2000).selectExpr("id div 20 AS doc_id", "id AS segment_id", "1 AS page_no", "1 AS segment_no", "repeat(concat('line ', id, ' '), 40) AS text")
    facts = lines.selectExpr("doc_id", "segment_id AS fact_id", "concat('e ', segment_id, ' l') AS source_quote")
    found = J.locate_quotes(facts, lines)
    assert found.count() == 2000
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("located", "located")
    found.write.format("noop").mode("overwrite").save()
    stages = {k for j in tracker.getJobIdsForGroup("located") for k in tracker.getJobInfo(j).stageIds}
    store = spark._jsc.sc().statusStore()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sum(store.lastStageAttempt(k).shuffleWriteRecords() for k in stages) < 40_000


def test_temporal_completion_is_done_once(spark):
    text = "原预约日期为7月20日的，顺延至2026年7月27日。请于7月30日 17:00前确认。"
    empty = facts(spark, [("FEE", "费用", "免费", "免费", 1, 1, 0.9)])
    out = X.complete_temporal(empty, segs(spark, text, text))
    assert sorted((r.field_type, r.value) for r in out.collect()) == [("END_DATE", "7月30日17:00前"), ("EVENT_DATE", "7月20日 → 2026年7月27日")]
    known = facts(spark, [("EVENT_DATE", "", "7月20日改为2026年7月27日", "", 1, 1, 0.9), ("END_DATE", "", "2026年7月30日 17:00前", "", 1, 1, 0.9)])
    assert X.complete_temporal(known, segs(spark, text)).count() == 0


def test_windows_and_fees(spark):
    text = "周一、周三\n8:30—11:30\n不开放\n星期五\n9:00 - 11:00\n13:00至16:00\n补办工本费每证10元；检测费按规定收取。支持微信、支付宝及现金支付。"
    w = X.extract_windows(segs(spark, text)).orderBy("pos").collect()
    assert w[0].days == ["周一", "周三"] and w[0].time_ranges == ["8:30-11:30"] and w[0].unavailable_note == "下午不开放"
    assert w[1].time_ranges == ["9:00-11:00", "13:00-16:00"] and w[1].unavailable_note is None
    known = X.extract_windows(segs(spark, text)).where("unavailable_note is null").withColumn("location", F.lit("大厅"))
    assert {tuple(r.k_days): r.location for r in X.complete_windows(known, segs(spark, text)).collect()} == {("周一", "周三"): None, ("星期五",): "大厅"}
    f = {r.fee_type: r for r in X.extract_fees(segs(spark, text)).collect()}
    assert f["补办工本费"].amount == "每证10元" and f["检测费"].rule == "按规定收取" and f["检测费"].payment_methods == ["微信", "支付宝", "现金支付"]
    known = X.extract_fees(segs(spark, text)).where("fee_type = '检测费'").withColumns({"fee_type": F.lit("检测 费用"), "rule": F.lit("按次")})
    merged = {r.fee_key: r for r in X.complete_fees(known, segs(spark, text)).collect()}
    assert merged["检测"].rule == "按规定收取" and merged["检测"].fee_type == "检测费" and merged["补办"].amount == "每证10元"


def test_sessions_and_summary(spark):
    text = "2026年9月1日 08:30—10:30 一楼预防接种门诊。\n2026年9月2日 13:00-15:00 东区服务中心"
    s = X.extract_sessions(segs(spark, text, text))
    assert [(r.date, r.time, r.location, r.segment_id) for r in s.orderBy("date").collect()] == [
        ("2026年9月1日", "08:30-10:30", "一楼预防接种门诊", 1), ("2026年9月2日", "13:00-15:00", "东区服务中心", 1)]
    f = facts(spark, [("TARGET_AUDIENCE", "", "老年人", "", 1, 1, 0.9), ("MATERIAL", "", "身份证", "", 1, 1, 0.9)])
    r = X.session_summary(f, s).first()
    assert r.summary[0] == "老年人，可以登记。" and r.summary[2] == "请带身份证；到一楼预防接种门诊。" and len(r.steps) == 2
    assert "地点为东区服务中心" in r.summary[1]
    known = s.where("date = '2026年9月1日'")
    assert X.complete_sessions(known, segs(spark, text)).count() == 2


def test_repair_and_fields(spark):
    raw = [json.dumps(x) if not isinstance(x, str) else x for x in (
        {"field_type": "audience", "label": "l", "value": "v", "source_quote": "q", "confidence": 0.9}, {"field_type": "NOPE", "value": 1},
        "[1]", {"field_type": "FEE", "extra": 1, "label": "l", "value": "v", "source_quote": "q", "confidence": "0.5"}, "{bad",
    )]
    ok, bad = X.repair_facts(spark.createDataFrame([(1, i, r) for i, r in enumerate(raw)], "doc_id long, pos int, raw string"))
    assert [(r.pos, r.field_type) for r in ok.orderBy("pos").collect()] == [(0, "TARGET_AUDIENCE"), (3, "FEE")]
    assert sorted((r.path, r.problem) for r in bad.collect()) == [
        ("$.fields[1].field_type", "UNKNOWN_TYPE"), ("$.fields[2]", "NOT_AN_OBJECT"), ("$.fields[3].extra", "UNKNOWN_KEY"), ("$.fields[4]", "NOT_AN_OBJECT")]
    f = spark.createDataFrame([(1, "a", "b", "c", "d", "0.5"), (2, "a", "b", "c", "d", "0.5"), (2, "a", "b", " ", "d", "0.5"), (3, "a", "b", "c", "d", "x"), (4, "a", "b", "c", "d", "1.5")],
                              "doc_id long, field_type string, label string, value string, source_quote string, confidence string")
    assert {r.doc_id: r.valid for r in X.validate_fields(f).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_audience(spark):
    v = "具有本市户籍且年满80周岁，目前未领取补贴者"
    f = facts(spark, [("TARGET_AUDIENCE", "", v, "q", 1, 1, 0.9), ("ELIGIBILITY", "", v, "q", 1, 1, 0.9)])
    assert [r.value for r in X.split_audience(f).orderBy("fact_id").collect()] == ["具有本市户籍且年满80周岁", "目前未领取补贴"]
    assert X.duplicate_conditions(f).first().duplicate_suspected


def test_guide_and_news(spark):
    t = "本街道常住居民，原则上年龄为60周岁及以上\f报名时间为2026年7月1日至7月10日。活动地点：社区中心。活动不收取任何费用。咨询电话：021-56781234"
    fs = E.guide_fields(F.lit(t))
    got = {r[0]: (r[1], r[2]) for r in spark.range(1).select(F.inline(fs)).select("field_type", "value", "page_no").collect()}
    assert got["TARGET_AUDIENCE"] == ("60周岁及以上常住居民", 1) and got["END_DATE"] == ("2026年7月10日", 2)
    assert got["LOCATION"][0] == "社区中心" and got["FEE"][0] == "免费" and got["CONTACT"][0] == "021-56781234"
    d = spark.range(1).select(E.guide_digest(F.lit(t), fs).alias("d")).first().d
    assert d.summary[1] == "办理时间为2026年7月1日至2026年7月10日。" and d.plain_text.endswith("。")
    n = spark.range(1).select(E.news_sentences(F.lit("今天开放。请勿转账！\n谨防诈骗")).alias("s")).select(E.news_facts("s").alias("f"), E.news_summary("s").alias("m")).first()
    assert [(x.field_type, x.value) for x in n.f] == [("WARNING", "请勿转账"), ("WARNING", "谨防诈骗")] and n.m == ["今天开放。", "请勿转账。", "谨防诈骗。"]
    n = spark.range(1).select(E.news_facts(F.array(F.lit("周六开放。"), F.lit("办理时间不变"))).alias("f")).first()
    assert [(x.field_type, x.value) for x in n.f] == [("SERVICE_TIME", "周六开放")]


def test_fact_summary(spark):
    f = facts(spark, [("LOCATION", "地点", "大厅", "", 1, 1, 0.9), ("WARNING", "提示", "勿信", "", 1, 1, 0.9), ("ELIGIBILITY", "条件", "满60", "", 1, 1, 0.9), ("RESULT_TIME", "结果", "3天", "", 1, 1, 0.9), ("WARNING", "提示", "勿信", "", 1, 1, 0.9)])
    r = X.fact_summary(f).first()
    assert r.summary == ["条件：满60", "地点：大厅", "提示：勿信"] and r.steps == ["确认办理或活动地点：大厅"] and r.warnings == ["勿信"] and "结果" not in r.plain_text


def test_merge_facts(spark):
    c = spark.createDataFrame([(1, "fees", 0, 0, '{"a":1,"b":"x"}'), (1, "fees", 1, 0, '{"b":"x","a":1}'), (1, "fees", 1, 1, '{"a":2}')], "doc_id long, list_key string, chunk_no int, pos int, item string")
    assert sorted((r.canonical, r.chunk_no, r.pos) for r in A.merge_facts(c).collect()) == [('{"a":"1","b":"x"}', 0, 0), ('{"a":"2"}', 1, 1)]


def test_news_sentences_are_cut_once_and_fast(spark):
    """The sentences of a long text are cut once, however often facts use them, with the cuts of the plain pattern."""
    texts = ["", "。", "。。a", "a。b！？c", " 。 。\r\n。x\n\ny？？", "abc\u2028d\u0085。e\n", "\U0001f600。z", "\r\n", "a\r。\r b", "é^&[]。-", "\u3000 a\u00a0b \t\u2028。\u2029 c\x0b\u0085"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.s for r in rows.select("i", E.news_sentences("text").alias("s")).collect()}
    assert [got[i] for i in range(len(texts))] == [[x for m in re.findall(r"[^。！？\r\n]+[。！？]?", t) if (x := m.strip())] for t in texts]
    plan = rows.select(F.inline(E.news_facts(E.news_sentences("text"), ["a"], ["b"])))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_repair_parses_a_row_once(spark):
    bodies = ['{"field_type":"phone","value":"1"}', ' {"field_type":"FEE","value":null,"extra":1}', "[1]", "{bad", None, '{"field_type":"NOPE"}', "{}", '{"field_type":"LOCATION","page_no":"2"}']
    raw = spark.createDataFrame([(1, i, b) for i, b in enumerate(bodies)], "doc_id long, pos int, raw string")
    ok, bad = X.repair_facts(raw)
    assert sorted((r.pos, r.field_type, r.value, r.page_no) for r in ok.collect()) == [(0, "CONTACT", "1", None), (1, "FEE", None, None), (7, "LOCATION", None, 2)]
    assert sorted((r.path, r.problem) for r in bad.collect()) == [
        ("$.fields[1].extra", "UNKNOWN_KEY"), ("$.fields[2]", "NOT_AN_OBJECT"), ("$.fields[3]", "NOT_AN_OBJECT"), ("$.fields[4]", "NOT_AN_OBJECT"),
        ("$.fields[5].field_type", "UNKNOWN_TYPE"), ("$.fields[6].field_type", "UNKNOWN_TYPE"),
    ]
    plan = ok.select("doc_id", "pos", "field_type", "value")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parse_json") + plan.count("parsejson") == 1
