"""Sections, chunks, metadata, page choice."""
from pyspark.sql import functions as F

from noticeboard.functions.classify import document_kind
from noticeboard.operators import structure as S

STANDARD = "标准编号 DB/T 1\n范围\n本标准规定了服务要求。\n术语和定义\n老年人指六十周岁以上。\n基本要求\n应当安全。\n服务内容\n助餐。\n质量评价\n每年一次。"


def seg(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, segment_id long, page_no int, text string")


def test_sections_of_a_standard(spark):
    s = seg(spark, [(1, 1, 1, STANDARD), (1, 2, 2, "附录\n补充说明。")])
    out = S.split_sections(s).orderBy("section_no").collect()
    assert [r.title for r in out] == ["正文", "范围", "术语和定义", "基本要求", "服务内容", "质量评价", "附录"]
    assert out[-1].page_no == 2 and out[-1].segment_ids == [2] and out[0].segment_ids == [1]
    kinds = s.groupBy("doc_id").agg(F.array_join(F.collect_list("text"), "\n").alias("t")).select("doc_id", document_kind(F.lit(""), "t", F.lit(""), F.lit("")).alias("document_kind"))
    assert kinds.first().document_kind == "STANDARD_SPECIFICATION"
    assert {r.label for r in S.type_facts(S.split_sections(s), kinds).collect()} == {"范围", "术语", "基本要求", "服务内容", "质量", "附录"}
    assert S.outline(S.split_sections(s)).where("section_no = 1").first().summary.startswith("范围")


def test_title_alone_does_not_decide(spark):
    df = spark.createDataFrame([("规范性引用文件 附录", "天气很好")], "t string, b string")
    assert df.select(document_kind("t", "b", F.lit(""), F.lit(None).cast("string"))).first()[0] == "GENERAL_PUBLIC_SERVICE"


def test_long_sections_are_bounded_and_whole(spark):
    body = "".join(f"第{i}句话说明服务要求。" for i in range(800))
    out = S.split_sections(seg(spark, [(1, 1, 1, body), (2, 1, 1, "x" * 2500)]), max_chars=1200).orderBy("part_no")
    one, two = [r.text for r in out.where("doc_id = 1").collect()], [r.text for r in out.where("doc_id = 2").collect()]
    assert all(len(t) <= 1200 for t in one + two) and "".join(one) == body and [len(t) for t in two] == [1200, 1200, 100]
    assert out.where("doc_id = 2").first().title == "正文（1）"


def test_chunks(spark):
    s = seg(spark, [(1, i, i, "范围\n" + "a" * 997) for i in range(1, 11)] + [(2, 1, 1, "short"), (2, 2, 1, "text")])
    out = S.pack_chunks(S.split_sections(s), s, threshold=4000, chunk_chars=3000, max_chunks=3).orderBy("doc_id", "chunk_no").collect()
    assert [(r.doc_id, r.segment_ids) for r in out] == [(1, [1, 2, 3]), (1, [4, 5, 6]), (1, [7, 8, 9, 10]), (2, [1, 2])]


def test_metadata(spark):
    def one(text, name="a_b.pdf", pages=3):
        return S.detect_metadata(spark.createDataFrame([(text, name, pages)], "preview_text string, filename string, page_count int")).first()

    r = one("某区人民医院\n关于接种疫苗的通知\n沪卫〔2026〕12号\n正文")
    assert (r.source_name, r.authority_status, r.evidence_type, r.document_number, r.source_type) == ("某区人民医院", "DOCUMENT_EVIDENCE", "HEADER", "沪卫〔2026〕12号", "医疗机构")
    assert r.title == "关于接种疫苗的通知" and r.confidence == 0.96
    r = one("关于接种疫苗的通知\n一\n二\n三\n某区人民政府")
    assert (r.evidence_type, r.source_type) == ("SIGNATURE", "政府部门")
    r = one("某区人民医院\n另一区人民医院\n关于接种疫苗的通知")
    assert (r.authority_status, r.source_name, r.confidence) == ("CONFLICT", "", 0.45)
    r = one("没有机构的正文", "模拟材料12_办事-指南.pdf")
    assert (r.authority_status, r.title, r.evidence_type, r.confidence) == ("UNCONFIRMED", "办事 指南", "FILENAME", 0.3)


def test_page_choice_and_offsets(spark):
    good = "这是一段足够长的可以正常阅读的中文文字内容用于测试页面质量的判断结果。"
    rows = [(1, 1, f"页眉\n{good}一\n页脚", "", 0.0), (1, 2, "\x01\x02\x03\x04ab", f"页眉\n{good}二\n页脚", 0.0), (1, 3, "\x01\x02\x03", "", 0.0), (1, 4, f"页眉\n{good}三\n页脚", "", 0.0)]
    p = S.choose_page_text(spark.createDataFrame(rows, "doc_id long, page_no int, text string, alt_text string, image_ratio double"))
    assert [r.chosen_source for r in p.orderBy("page_no").collect()] == ["TEXT_LAYER", "OCR", "TEXT_LAYER", "TEXT_LAYER"]
    s = S.page_segments(p).orderBy("page_no").collect()
    assert [r.page_no for r in s] == [1, 2, 4] and s[0].text == good + "一"
    assert [(r.start_offset, r.end_offset) for r in s] == [(0, len(good) + 1), (len(good) + 2, 2 * len(good) + 3), (2 * len(good) + 4, 3 * len(good) + 5)]
