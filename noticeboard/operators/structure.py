"""Page texts to segments, segments to sections, sections to chunks; document metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vocab as V
from ..functions.classify import source_type
from ..functions.core import LINE_BREAK, col, has_any, left, strip, text
from ..functions.texts import clean_page, filename_title, page_quality
from .aggregates import strip_repeated_edges
from .ordered import running_totals

BODY_TITLE = "正文"  # fixed value: title of the text before the first heading


# ---------------------------------------------------------------------- pages --
def choose_page_text(pages: DataFrame, body: str = "text", alternative: str = "alt_text", image_ratio: str = "image_ratio") -> DataFrame:
    """Adds chosen_text, chosen_source and the quality of the chosen text.

    The alternative is looked at only when the page's own text is not GOOD; it wins
    when it is not POOR and the own text is POOR or scores lower.  A POOR page is empty.
    """
    scored = pages.withColumns({"_own": page_quality(body, image_ratio), "_alt": page_quality(alternative, image_ratio)})
    own, alt = F.col("_own"), F.col("_alt")
    use_alt = (
        (own["quality"] != "GOOD") & (text(alternative) != "") & (alt["quality"] != "POOR")
        & ((own["quality"] == "POOR") | (alt["raw_score"] > own["raw_score"]))
    )
    scored = scored.withColumn("_use", use_alt).withColumn("_q", F.when(F.col("_use"), alt).otherwise(own))
    chosen = clean_page(F.when(F.col("_use"), F.col(alternative)).otherwise(F.col(body)))
    return scored.withColumns({
        "chosen_text": F.when(F.col("_q.quality") == "POOR", F.lit("")).otherwise(chosen),
        "chosen_source": F.when(F.col("_use"), "OCR").otherwise("TEXT_LAYER"),
        "quality": F.col("_q.quality"), "score": F.col("_q.score"), "needs_human_review": F.col("_q.needs_human_review"),
    }).drop("_own", "_alt", "_q", "_use")


def page_segments(chosen: DataFrame, doc: str = "doc_id", page: str = "page_no") -> DataFrame:
    """Non-empty page texts without repeated edges, with their offsets in the joined document text."""
    pages = strip_repeated_edges(chosen.select(doc, page, F.col("chosen_text").alias("text")), doc, page, "text").where("text <> ''")
    placed = running_totals(pages, [doc], [F.col(page)], start_offset=(F.length("text") + 1).cast("bigint"))
    return placed.withColumns({"segment_no": F.lit(1), "end_offset": F.col("start_offset") + F.length("text")})


# ------------------------------------------------------------------- sections --
def bounded_parts(c, max_chars: int) -> Column:
    """The text in parts of at most max_chars, cut after sentence ends where possible."""
    body = text(c)
    sentences = F.filter(F.split(body, r"(?<=[。！？；\n])"), lambda s: s != "")
    none = F.array().cast("array<string>")

    def kept(s):  # a finished part, unless blank
        return F.filter(F.array(strip(s)), lambda x: x != "")

    def step(acc, s):
        full = (acc["cur"] != "") & (F.length(acc["cur"]) + F.length(s) > max_chars)
        long = F.length(s) > max_chars
        done = F.when(full | long, F.concat(acc["parts"], kept(acc["cur"]))).otherwise(acc["parts"])
        cur = F.when(full, F.lit("")).otherwise(acc["cur"])
        pieces = F.filter(
            F.transform(F.regexp_extract_all(s, F.lit(f"(?s).{{1,{max_chars}}}"), F.lit(0)), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != ""
        )
        return F.struct(
            F.when(long, F.concat(done, pieces)).otherwise(done).alias("parts"), F.when(long, F.lit("")).otherwise(F.concat(cur, s)).alias("cur")
        )

    packed = F.aggregate(
        sentences, F.struct(none.alias("parts"), F.lit("").alias("cur")), step, lambda acc: F.concat(acc["parts"], kept(acc["cur"]))
    )
    return F.when(F.length(body) <= max_chars, F.array(body)).otherwise(packed)


def split_sections(
    segments: DataFrame, doc: str = "doc_id", max_chars: int | None = 6000, heading: str = V.SECTION_HEADING, order=("page_no", "segment_id"),
) -> DataFrame:
    """(doc, section_no, part_no, title, text, page_no, segment_ids): a short heading line starts a section.

    The section of a line is the number of headings up to it, a running total that
    does not need a document to fit into one task.
    """
    lines = segments.select(doc, "segment_id", "page_no", *[c for c in order if c not in ("segment_id", "page_no")], F.posexplode(F.split("text", r"\r?\n+")).alias("_pos", "_raw"))
    lines = lines.withColumn("_line", strip("_raw")).where("_line <> ''").drop("_raw")
    is_heading = (F.length("_line") <= 80) & F.rlike("_line", F.lit(heading))
    lines = lines.withColumn("_head", is_heading)
    place = [F.col(c) for c in (*order, "_pos")]
    numbered = running_totals(lines, [doc], place, before=F.col("_head").cast("bigint"))
    numbered = numbered.withColumn("section_no", F.col("before") + F.col("_head").cast("bigint"))
    key = F.struct(*order, "_pos")
    first = F.min_by(F.struct("_head", "_line", "page_no"), key)
    sections = numbered.groupBy(doc, "section_no").agg(
        first.alias("_first"), F.array_sort(F.collect_list(F.struct(F.struct(*order, "_pos").alias("_k"), "_line", F.col("segment_id").alias("_seg")))).alias("_l")
    )
    start = segments.groupBy(doc).agg(F.min_by("page_no", F.struct(*order)).alias("_start"))
    body = strip(F.array_join(F.transform("_l", lambda s: s["_line"]), "\n"))
    sections = sections.join(start, doc).select(
        doc, "section_no", F.when(F.col("_first._head"), left(F.col("_first._line"), 80)).otherwise(F.lit(BODY_TITLE)).alias("_title"),
        F.when(F.col("_first._head"), F.col("_first.page_no")).otherwise(F.col("_start")).alias("page_no"),
        F.array_distinct(F.transform("_l", lambda s: s["_seg"])).alias("segment_ids"), body.alias("_body"),
    )
    long = F.lit(False) if max_chars is None else F.length("_body") > max_chars
    parts = F.array("_body") if max_chars is None else bounded_parts("_body", max_chars)
    return sections.select("*", F.posexplode(parts).alias("part_no", "text")).select(
        doc, "section_no", "part_no",
        F.concat("_title", F.when(long, F.concat(F.lit("（"), (F.col("part_no") + 1).cast("string"), F.lit("）"))).otherwise("")).alias("title"),
        "text", "page_no", "segment_ids",
    )


def outline(sections: DataFrame, doc: str = "doc_id") -> DataFrame:
    return sections.select(doc, "section_no", "part_no", "title", "page_no", "segment_ids", left(F.col("text"), 120).alias("summary"))


def type_facts(sections: DataFrame, kinds: DataFrame, doc: str = "doc_id", labels=None) -> DataFrame:
    """First label of the document's kind that the section title contains, with a quote of up to 240 characters."""
    labels = labels or V.SECTION_FACT_LABELS
    first = F.lit(None).cast("string")
    for kind, words in labels.items():
        hit = F.coalesce(*[F.when(F.contains("title", F.lit(w)), F.lit(w)) for w in words], F.lit(None).cast("string"))
        first = F.when(F.col("document_kind") == kind, hit).otherwise(first)
    out = sections.join(kinds.select(doc, "document_kind"), doc).withColumn("label", first)
    quote = left(F.col("text"), 240)
    return out.where("label is not null and size(segment_ids) > 0").select(
        doc, "section_no", "part_no", "label", quote.alias("value"), quote.alias("source_quote"), "page_no",
        F.col("segment_ids")[0].alias("segment_id"), F.lit(0.9).alias("confidence"),
    )


def pack_chunks(
    sections: DataFrame, segments: DataFrame, doc: str = "doc_id", threshold: int = 12000, chunk_chars: int = 7000, max_chunks: int = 8,
) -> DataFrame:
    """(doc, chunk_no, segment_ids, chars): sections packed in order, a segment once per chunk, the tail in the last chunk.

    Only ids and lengths of a document come together, not its text.
    """
    sizes = segments.groupBy(doc).agg(
        F.map_from_entries(F.collect_list(F.struct("segment_id", F.length("text").cast("bigint")))).alias("_len"),
        F.array_sort(F.collect_list("segment_id")).alias("_every"), F.sum(F.length("text") + 1).alias("_total"),
    )
    listed = sections.groupBy(doc).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("section_no", "part_no", "segment_ids"))), lambda s: s["segment_ids"]).alias("_sections")
    )
    both = sizes.join(listed, doc, "left")
    lengths = F.col("_len")

    def chars(ids):
        return F.aggregate(ids, F.lit(0).cast("bigint"), lambda a, i: a + F.coalesce(lengths[i], F.lit(0).cast("bigint")))

    ids0 = F.array().cast("array<bigint>")

    def step(acc, section):
        fresh = F.array_except(section, acc["ids"])
        full = (F.size(acc["ids"]) > 0) & (acc["n"] + chars(fresh) > chunk_chars)
        ids = F.when(full, F.array_distinct(section)).otherwise(F.concat(acc["ids"], fresh))
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["ids"]))).otherwise(acc["done"]).alias("done"), ids.alias("ids"),
            F.when(full, chars(F.array_distinct(section))).otherwise(acc["n"] + chars(fresh)).alias("n"),
        )

    zero = F.struct(F.array().cast("array<array<bigint>>").alias("done"), ids0.alias("ids"), F.lit(0).cast("bigint").alias("n"))
    packed = F.aggregate(
        F.coalesce("_sections", F.array().cast("array<array<bigint>>")), zero, step,
        lambda acc: F.when(F.size(acc["ids"]) > 0, F.concat(acc["done"], F.array(acc["ids"]))).otherwise(acc["done"]),
    )
    groups = F.when((F.col("_total") - 1 <= threshold) | (F.size("_groups") == 0), F.array("_every")).when(
        F.size("_groups") > max_chunks,
        F.concat(F.slice("_groups", 1, max_chunks - 1), F.array(F.array_distinct(F.flatten(F.slice("_groups", F.lit(max_chunks), F.size("_groups")))))),
    ).otherwise(F.col("_groups"))
    return both.withColumn("_groups", packed).select(doc, "_len", F.posexplode(groups).alias("chunk_no", "segment_ids")).select(
        doc, "chunk_no", "segment_ids", chars(F.col("segment_ids")).alias("chars")
    )


# ------------------------------------------------------------------- metadata --
def detect_metadata(
    df: DataFrame, body: str = "preview_text", filename: str = "filename", page_count: str = "page_count", pages: str | None = None,
    title_words=None, publisher: str = V.PUBLISHER_LINE, number: str = V.DOCUMENT_NUMBER, prefixes=None, types=None,
) -> DataFrame:
    """Adds title, source_name, document_number, source_type, authority_status, confidence, evidence_type and page_no.

    pages names an optional array<struct<page_no, text>> in which the publisher is looked up.
    """
    words = title_words or V.TITLE_WORDS
    raw = F.filter(F.split(text(body), LINE_BREAK), lambda x: ~F.startswith(x, F.lit(V.PAGE_LINE_PREFIX)))
    out = df.withColumns({
        "_lines": F.filter(F.transform(raw, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != ""),
        "_file": filename_title(filename, prefixes),
    })
    numbers = F.filter(F.transform("_lines", lambda x: F.regexp_extract(x, number, 0)), lambda x: x != "")
    titles = F.filter(
        "_lines", lambda x: F.length(x).between(4, 80) & has_any(x, words) & ~F.contains(x, F.lit(V.SAMPLE_MATERIAL_MARK))
    )
    placed = F.filter(F.transform("_lines", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: F.rlike(s["x"], F.lit(publisher)))
    out = out.withColumns({
        "document_number": F.coalesce(F.try_element_at(numbers, F.lit(1)), F.lit("")),
        "title": F.coalesce(F.try_element_at(titles, F.lit(1)), F.col("_file")), "_pub": placed,
    })
    at = F.array_position("_lines", F.col("title"))
    out = out.withColumn("_at", F.when(at > 0, at - 1).otherwise(F.size("_lines")))
    out = out.withColumn("_near", F.filter("_pub", lambda s: s["i"] <= F.col("_at") + 2))
    out = out.withColumn("_near", F.when(F.size("_near") > 0, F.col("_near")).otherwise(F.col("_pub")))
    out = out.withColumn("_names", F.array_distinct(F.transform("_near", lambda s: s["x"])))
    one, n = F.size("_names") == 1, F.size("_names")
    out = out.withColumn("source_name", F.when(one, F.col("_names")[0]).otherwise(F.lit("")))
    found_on = F.lit(1)
    if pages is not None:
        hit = F.filter(pages, lambda p: (F.col("source_name") != "") & F.contains(p["text"], F.col("source_name")))
        found_on = F.coalesce(F.try_element_at(hit, F.lit(1))["page_no"], F.lit(1))
    return out.withColumns({
        "source_type": source_type("source_name", types),
        "authority_status": F.when(one, "DOCUMENT_EVIDENCE").when(n > 1, "CONFLICT").otherwise("UNCONFIRMED"),
        "confidence": F.when(one, 0.96).when(n > 1, 0.45).when(F.col("title") != "", 0.3).otherwise(0.1),
        "evidence_type": F.when(one, F.when(F.col("_near")[0]["i"] <= F.col("_at"), "HEADER").otherwise("SIGNATURE"))
        .when((n == 0) & (F.col("_file") != ""), "FILENAME").otherwise("NONE"),
        "page_no": F.least(found_on, F.greatest(col(page_count), F.lit(1))),
    }).drop("_lines", "_file", "_pub", "_at", "_near", "_names")
