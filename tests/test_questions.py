"""Classification, question understanding, evidence and grounding with the published dictionaries."""
from pyspark.sql import functions as F

from noticeboard.functions import classify as C, questions as Q, texts as T
from noticeboard.operators import retrieval as R
from noticeboard.operators.ordered import top_per_key


def channel(spark, title, text, kind=None):
    df = spark.createDataFrame([(title, text, kind)], "title string, text string, content_kind string")
    return C.suggest_channel(df).first()


def test_channels(spark):
    assert channel(spark, "长者食堂助餐服务", "为老年人提供用餐").channel == "MEALS"
    r = channel(spark, "无关", "没有特征的内容")
    assert (r.channel, r.channel_confidence) == ("COMMUNITY", 0.35)
    assert channel(spark, "警惕电信网络诈骗", "不要转账，保护验证码").channel == "FRAUD"
    assert channel(spark, "健康讲座", "", "HEALTH_EDUCATION").channel == "HEALTH"
    assert channel(spark, "证件换领办理指南", "材料清单与受理窗口").channel == "SERVICES"


def test_content_kinds(spark):
    df = spark.createDataFrame([("防诈提醒", ""), ("通报", "民政部 补贴 政策"), ("天气", "晴")], "t string, b string")
    got = [(r.c.kind, round(r.c.confidence, 2)) for r in df.select(C.classify_content("t", "b").alias("c")).collect()]
    assert got == [("ANTI_FRAUD", 0.95), ("POLICY_NEWS", 0.83), ("GENERAL_NEWS", 0.55)]


def test_fact_forms(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.normalize_fact(F.lit("2026年9月1日"))) == one(T.normalize_fact(F.lit("2026-09-01"))) == "20260901"
    assert one(T.facts_grounded(F.lit("9月1日前缴纳30元"), F.lit("费用30元，9月1日截止")))
    assert not one(T.facts_grounded(F.lit("缴纳31元"), F.lit("费用30元")))
    assert one(Q.weak_answer(F.lit("没有找到相关内容"))) and not one(Q.weak_answer(F.lit("可以办理")))
    assert one(T.stable_pick(F.lit("a"), ["x", "y", "z"])) == ["x", "y", "z"][((2166136261 ^ 97) * 16777619 % 2**32) % 3]


def items(spark):
    rows = [("guide-1", 1, "老年人健康体检", "健康", "社区体检安排", "体检时间为9月1日。地点在一楼。", "", 2), ("news-2", 2, "反诈提醒", "反诈", "谨防诈骗", "不要转账。", "联系电话：110", 1), ("news-3", 3, "停水通知", "生活服务", "停水", "停水一天", "", 3)]
    return spark.createDataFrame(rows, "slug string, document_id long, title string, category string, summary string, raw_text string, verified_facts string, published_at int")


def ask(spark, *questions):
    return R.understand(spark.createDataFrame([(i, q, s) for i, (q, s) in enumerate(questions)], "question_id long, text string, context_slug string"))


def brute(understood, rows):
    """Every pair scored with the scalar function."""
    pairs = understood.crossJoin(rows).withColumn("score", Q.lexical_score("terms", "anchors", "slug", "context_slug", "title", "category", "summary", "raw_text", "verified_facts"))
    return pairs.where("score > 0").select("question_id", "slug", "score")


def test_retrieval_equals_brute_force(spark):
    asked = ask(spark, ("体检什么时间", None), ("停水", None), ("火星移民计划", None), ("怎么防诈骗", None), ("这个在哪里", "news-3"), ("体检什么时间", None))
    want = sorted(map(tuple, brute(asked, items(spark)).collect()))
    got = R.retrieve(asked, items(spark), n=10)
    assert sorted((r.question_id, r.slug, r.score) for r in got.collect()) == want
    assert not any(q == 2 for q, _, _ in want) and (4, "news-3") in {(q, s) for q, s, _ in want}


def test_items_that_share_anchors(spark):
    """Every anchor stands in many items, empty categories and pages asked on included."""
    words = ["体检", "停水", "反诈", "社区", "医保", "办理"]
    rows = [(f"item-{i}", i, f"{words[i % 6]}通知{i}", words[i % 5] if i % 7 else "", "社区体检安排", f"{words[i % 4]}在{i}号楼", "", i % 7) for i in range(60)]
    many = spark.createDataFrame(rows, items(spark).schema)
    asked = ask(spark, *[(f"{words[i % 6]}{words[i * 5 % 6]}什么时间", f"item-{i}" if i % 4 == 0 else None) for i in range(18)])
    want = brute(asked, many).collect()
    got = R.retrieve(asked, many, n=1000).collect()
    assert sorted((r.question_id, r.slug, r.score) for r in got) == sorted(map(tuple, want)) and len(want) > 200
    top = R.retrieve(asked, many, n=3).groupBy("question_id").agg(F.count("*").alias("n"), F.min("score").alias("s")).collect()
    best = {}
    for r in want:
        best.setdefault(r.question_id, []).append(r.score)
    assert {r.question_id: r.s for r in top} == {q: sorted(v)[-3:][0] for q, v in best.items()} and {r.question_id: r.n for r in top} == {q: min(3, len(v)) for q, v in best.items()}


def test_quotes_cards_posts(spark):
    asked = ask(spark, ("体检什么时间", None))
    q = R.with_quotes(R.retrieve(asked, items(spark))).where("citation = 1").first()
    assert q.slug == "guide-1" and "体检时间为9月1日。" in q.quote and q.quote.endswith("审核摘要：社区体检安排")
    fields = spark.createDataFrame([(1, 1, "LOCATION", "地点", " 一楼 ", "CONFIRMED"), (2, 1, "LOCATION", "地点", "一楼", "MODIFIED"), (3, 1, "FEE", "费用", "免费", "PENDING"), (4, 1, "CONTACT", "电话", "1", "CONFIRMED")],
                                   "id long, document_id long, field_type string, field_label string, field_value string, review_status string")
    cited = spark.createDataFrame([(0, 1, 1)], "question_id long, citation int, document_id long")
    assert [(r.type, r.value) for r in R.fact_cards(cited, fields).orderBy("place").collect()] == [("location", "一楼"), ("phone", "1")]
    posts = spark.createDataFrame([(i, "r", i, "体检经验" if i < 3 else "拼车", "", "VISIBLE") for i in range(60)], "id long, region_code string, created_at int, content string, category string, status string")
    near = asked.withColumn("region_code", F.lit("r"))
    assert R.retrieve_posts(near, posts.withColumn("category", F.lit("x"))).count() == 0  # the matching ones are older than the latest fifty
    assert R.retrieve_posts(near, posts.where("id < 20").withColumn("category", F.lit("x"))).count() == 3


def test_posts_meet_distinct_questions_only(spark):
    """Many questions with few different terms: one answer for each set of terms and region, given to all of them."""
    posts = spark.createDataFrame([(i, f"r{i % 2}", i, "体检经验" if i % 3 else "停水", "健康" if i % 4 else None, "VISIBLE") for i in range(30)], "id long, region_code string, created_at int, content string, category string, status string")
    texts = ["体检什么时间", "停水", "体检停水", "火星"]
    asked = R.understand(spark.createDataFrame([(i, texts[i % 4], None, f"r{i % 3}" if i % 3 < 2 else None) for i in range(240)], "question_id long, text string, context_slug string, region_code string"))
    out = R.retrieve_posts(asked, posts, n=3)
    got = {}
    for r in out.collect():
        got.setdefault(r.question_id, []).append((r.place, r.id, r.score))
    pairs = asked.join(posts, "region_code").withColumn("score", Q.post_score("terms", "content", "category")).where("score > 0").collect()
    want = {}
    for r in sorted(pairs, key=lambda r: (-r.score, -r.created_at, -r.id)):
        want.setdefault(r.question_id, []).append((r.id, r.score))
    assert {k: sorted(v) for k, v in got.items()} == {k: [(i + 1, *x) for i, x in enumerate(v[:3])] for k, v in want.items()} and len(got) > 100
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" in plan and not any("aggregate(" in line and "regexp_replace" in line for line in plan.splitlines())


def test_pages_asked_on_do_not_multiply_pairs(spark, monkeypatch):
    """Questions that differ only in the page they were asked on meet the items once; the page itself keeps its place."""
    words = ["体检", "停水"]
    rows = [(f"item-{i:03}", i, f"{words[i % 2]}通知", "", words[i % 3 % 2], "", "", i % 5) for i in range(120)]
    many = spark.createDataFrame(rows, items(spark).schema)
    asked = ask(spark, *[("体检什么时间", f"item-{i:03}" if i % 8 else None) for i in range(240)])
    want = {}
    for r in brute(asked, many).join(many.select("slug", "published_at"), "slug").collect():
        want.setdefault(r.question_id, []).append((-r.score, -r.published_at, r.slug))
    ranked = R.rank_items(asked, many)
    assert {(r.question_id, r.citation, r.slug, r.score) for r in ranked.collect()} == {(k, i + 1, x[2], -x[0]) for k, v in want.items() for i, x in enumerate(sorted(v)[:3])}
    quoted = R.retrieve_quotes(asked, many).collect()
    whole = R.with_quotes(R.retrieve(asked, many)).collect()
    assert sorted((r.question_id, r.citation, r.slug, r.quote) for r in quoted) == sorted((r.question_id, r.citation, r.slug, r.quote) for r in whole)
    met = []
    monkeypatch.setattr(R, "top_per_key", lambda df, keys, *rest: (met.append((keys, df)), top_per_key(df, keys, *rest))[1])
    R.rank_items(asked, many)
    assert [df.count() for keys, df in met if "_profile" not in keys] == [100]  # the items with the one anchor, once


def test_words_in_fields(spark):
    texts = [("ab abc", "x国民ab"), ("", None), ("国", "民国国民"), ("long" * 300_000 + "tail", "characteristic")]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "id long, a string, b string")
    words = ["a", "abc", "国民", "国", "tail", "longtail", "gtai", "characteristic", "haracteristic", "zz", "longlonglonglonglonglonglonglong", ""]
    got = {(r.id, r.word, r.tag): r._fields for r in C.match_fields(df, spark.createDataFrame([(w, len(w)) for w in words], "word string, tag int"), ["a", "b"], "id").collect()}
    want = {(i, w, len(w)): sum(1 << k for k in (0, 1) if w in (t[k] or "")) for i, t in enumerate(texts) for w in words if w}
    assert got == {k: v for k, v in want.items() if v}
    assert C.match_fields(df, spark.createDataFrame([("",)], "word string"), ["a"], "id").columns == ["id", "word", "_fields"]
