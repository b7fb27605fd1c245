"""Extracted facts: repair, validation against the source, completion and summaries.

Facts are rows (doc_id, fact_id, field_type, label, value, source_quote, page_no,
segment_id, confidence); segments are rows (doc_id, segment_id, page_no, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import extract as E, vocab as V
from ..functions.core import is_blank, let, map_lookup, nulls_to, squeeze, text
from ..functions.texts import complete_temporal_value, numbers_consistent, prefix_similarity
from .aggregates import merge_fees, merge_windows
from .joins import original_span
from .ordered import top_per_key


# ------------------------------------------------------------------- checking --
def repair_facts(raw: DataFrame, doc: str = "doc_id", pos: str = "pos", body: str = "raw", aliases=None, allowed=None, keys=None) -> tuple[DataFrame, DataFrame]:
    """JSON facts to (usable rows, quarantined paths).

    Aliases of types become canonical; non-objects, unknown types and unknown keys
    are set aside with their path.
    """
    aliases, allowed, keys = aliases or V.FIELD_TYPE_ALIASES, allowed or V.FIELD_TYPES, keys or V.FACT_KEYS
    path = F.concat(F.lit("$.fields["), F.col(pos).cast("string"), F.lit("]"))
    is_object = F.startswith(F.trim(text(body)), F.lit("{")) & F.try_parse_json(body).isNotNull()

    def canonical(kind: Column) -> Column:
        return let(F.upper(text(kind)), lambda named: F.when(named.isin(list(aliases)), map_lookup(named, aliases)).otherwise(kind))

    def state(o: Column) -> Column:
        kind = let(F.when(o, F.get_json_object(body, "$.field_type")), canonical)
        return F.struct(o.alias("_object"), kind.alias("field_type"))

    # a row is parsed once: filters on what a generator makes are not pushed below it, where they would parse again
    read = raw.select(doc, pos, body, path.alias("_path"), F.inline(F.array(let(is_object, state))))
    read = read.withColumns({k: F.when(F.col("_object"), F.get_json_object(body, f"$.{k}")) for k in keys if k != "field_type"})
    known = nulls_to(F.col("field_type").isin(allowed), False)
    unknown_keys = F.filter(F.json_object_keys(body), lambda k: ~k.isin(keys))
    ok = read.where(F.col("_object") & known).select(
        doc, pos, *[k for k in keys if k not in ("page_no", "segment_id", "confidence", "needs_human_review")],
        F.col("page_no").try_cast("int").alias("page_no"), F.col("segment_id").try_cast("bigint").alias("segment_id"),
        F.col("confidence").try_cast("double").alias("confidence"), nulls_to(F.col("needs_human_review").try_cast("boolean"), False).alias("needs_human_review"),
    )
    problems = F.concat(
        F.when(~F.col("_object"), F.array(F.struct(F.col("_path").alias("path"), F.lit("NOT_AN_OBJECT").alias("problem")))).otherwise(F.array()),
        F.when(F.col("_object") & ~known, F.array(F.struct(F.concat("_path", F.lit(".field_type")).alias("path"), F.lit("UNKNOWN_TYPE").alias("problem")))).otherwise(F.array()),
        F.when(F.col("_object"), F.transform(unknown_keys, lambda k: F.struct(F.concat(F.col("_path"), F.lit("."), k).alias("path"), F.lit("UNKNOWN_KEY").alias("problem")))).otherwise(F.array()),
    )
    return ok, read.select(doc, pos, F.explode(problems).alias("p")).select(doc, pos, "p.*")


def validate_fields(fields: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, fields, valid): five filled keys and a confidence in 0..1; one bad field spoils the document."""
    number = text("confidence").try_cast("double")
    good = nulls_to(number.between(0, 1), False)
    for key in ("field_type", "label", "value", "source_quote"):
        good = good & ~is_blank(key)
    return fields.groupBy(doc).agg(F.count("*").alias("fields"), F.bool_and(good).alias("valid"))


def validate_traces(facts: DataFrame, segments: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Adds reject_reason (null when traceable); the quote becomes the original span, temporal values are completed.

    The segment is given by the fact, so this is one equi join.
    """
    seg = segments.select(doc, "segment_id", F.col("page_no").alias("_page"), F.col("text").alias("_seg"))
    joined = facts.join(seg, [doc, "segment_id"], "left").withColumn("_q", squeeze("source_quote"))
    here = F.contains("_seg", "source_quote") | ((F.col("_q") != "") & F.contains(squeeze("_seg"), "_q"))
    span = F.when(here, original_span("_seg", "source_quote", "_q"))
    joined = joined.withColumn("_span", span)
    reason = (
        F.when(F.col("_seg").isNull(), "segment_not_found").when(~F.col("_page").eqNullSafe(F.col("page_no")), "page_mismatch")
        .when(F.col("_span").isNull(), "source_quote_not_found").when(~numbers_consistent("value", "_span"), "numeric_mismatch")
    )
    joined = joined.withColumn("reject_reason", reason)
    fine = F.col("reject_reason").isNull()
    return joined.withColumns({
        "value": F.when(fine, complete_temporal_value("field_type", "value", "_span")).otherwise(F.col("value")),
        "source_quote": F.when(fine, F.col("_span")).otherwise(F.col("source_quote")),
    }).drop("_page", "_seg", "_q", "_span")


def _first_of_type(kind: str, *columns: str) -> Column:
    return F.min_by(F.when(F.col("field_type") == kind, F.struct(*columns)), F.when(F.col("field_type") == kind, F.col("fact_id")))


def duplicate_conditions(facts: DataFrame, doc: str = "doc_id", threshold: float = 0.88) -> DataFrame:
    """Documents whose first audience and first eligibility fact say the same."""

    def bare(c):
        return F.regexp_replace(text(c), r"[\s，,。；;：:]", "")

    both = facts.groupBy(doc).agg(
        _first_of_type("TARGET_AUDIENCE", "fact_id", "value", "source_quote").alias("a"), _first_of_type("ELIGIBILITY", "fact_id", "value", "source_quote").alias("e"),
    ).where("a is not null and e is not null")
    both = both.select(doc, F.col("a.fact_id").alias("audience_fact"), F.col("e.fact_id").alias("eligibility_fact"),
                       bare("a.value").alias("_av"), bare("e.value").alias("_ev"), bare("a.source_quote").alias("_aq"), bare("e.source_quote").alias("_eq"))
    same = (F.col("_av") == F.col("_ev")) | ((F.col("_aq") == F.col("_eq")) & (prefix_similarity("_av", "_ev") >= threshold))
    return both.withColumn("duplicate_suspected", same).drop("_av", "_ev", "_aq", "_eq")


def split_audience(facts: DataFrame, doc: str = "doc_id", pattern: str = V.AUDIENCE_SPLIT) -> DataFrame:
    """Identical audience and eligibility from one quote are split into who and which condition."""

    def bare(c):
        return F.regexp_replace(text(c), r"(?U)[\s，,。；;]", "")

    both = facts.groupBy(doc).agg(
        _first_of_type("TARGET_AUDIENCE", "fact_id", "value", "source_quote").alias("a"), _first_of_type("ELIGIBILITY", "fact_id", "value", "source_quote").alias("e"),
    ).where((bare("a.value") == bare("e.value")) & (F.col("a.source_quote") == F.col("e.source_quote")) & F.rlike("a.value", F.lit(pattern)))
    who, what = F.regexp_extract("a.value", pattern, 1), F.regexp_replace(F.regexp_extract("a.value", pattern, 2), "者$", "")
    new = both.select(doc, F.explode(F.array(
        F.struct(F.col("a.fact_id").alias("fact_id"), who.alias("v")), F.struct(F.col("e.fact_id").alias("fact_id"), what.alias("v")),
    )).alias("n")).select(doc, "n.fact_id", "n.v")
    return facts.join(new, [doc, "fact_id"], "left").withColumn("value", F.coalesce("v", "value")).drop("v")


# ----------------------------------------------------------------- completion --
def _found(segments: DataFrame, what: Column, doc: str) -> DataFrame:
    return segments.select(doc, "segment_id", "page_no", F.posexplode(what).alias("pos", "m")).select(doc, "segment_id", "page_no", "pos", "m.*")


def extract_sessions(segments: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Distinct sessions of each document at their first place."""
    found = _found(segments, E.sessions("text"), doc)
    place = F.struct("page_no", "segment_id", "pos")
    return found.groupBy(doc, "date", "time", "location").agg(
        F.min(place).alias("_p"), F.min_by("source_quote", place).alias("source_quote")
    ).select(doc, "date", "time", "location", "source_quote", "_p.page_no", "_p.segment_id", "_p.pos")


def complete_sessions(known: DataFrame, segments: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Known sessions and the ones of the text that are not known yet."""
    cols = [doc, "date", "time", "location", "source_quote", "page_no", "segment_id"]
    new = extract_sessions(segments, doc).join(known.select(doc, "date", "time", "location"), [doc, "date", "time", "location"], "left_anti")
    return known.select(*cols).unionByName(new.select(*cols))


def extract_windows(segments: DataFrame, doc: str = "doc_id") -> DataFrame:
    return _found(segments, E.service_windows("text"), doc).withColumns({
        "dates": F.array().cast("array<string>"), "location": F.lit(None).cast("string"), "needs_human_review": F.lit(False),
    })


def complete_windows(known: DataFrame, segments: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Known service windows plus the ones of the text, merged."""
    k = known.select(doc, F.col("days").alias("_d"), F.col("time_ranges").alias("_t"), F.col("unavailable_note").alias("_n"))
    w = extract_windows(segments, doc)
    new = w.join(
        k.withColumnRenamed(doc, "_doc"),
        (F.col(doc) == F.col("_doc")) & (F.col("days") == F.col("_d")) & (F.col("time_ranges") == F.col("_t")) & F.col("unavailable_note").eqNullSafe(F.col("_n")),
        "left_anti",
    )
    cols = [doc, "days", "dates", "time_ranges", "location", "unavailable_note", "source_quote", "needs_human_review", "pos"]
    # known windows keep their place before the found ones
    return merge_windows(known.select(*cols[:-1], (F.col("pos") - F.lit(1 << 30)).alias("pos")).unionByName(_placed(new).select(*cols)), doc)


def _placed(found: DataFrame) -> DataFrame:
    """One comparable position per match: segment first, then place in the segment."""
    return found.withColumn("pos", F.col("segment_id") * F.lit(1 << 20) + F.col("pos"))


def extract_fees(segments: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Fee clauses; the first of each fee name in a document counts."""
    found = _placed(_found(segments, E.fees("text"), doc))
    return top_per_key(found, [doc, "fee_type"], [F.col("pos")], 1).withColumn("needs_human_review", F.lit(False))


def complete_fees(known: DataFrame, segments: DataFrame, doc: str = "doc_id") -> DataFrame:
    new = extract_fees(segments, doc).join(known.select(doc, "fee_type"), [doc, "fee_type"], "left_anti")
    cols = [doc, "fee_type", "amount", "rule", "payment_methods", "source_quote", "needs_human_review", "pos"]
    return merge_fees(known.select(*cols[:-1], (F.col("pos") - F.lit(1 << 30)).alias("pos")).unionByName(new.select(*cols)), doc)


def complete_temporal(facts: DataFrame, segments: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Moved dates and deadlines the text states and no fact carries yet.

    "A fact already contains the date" is an equi join: every date (or deadline)
    embedded in the known values is listed and compared by equality.
    """
    cols = ["field_type", "label", "value", "source_quote", "page_no", "segment_id"]
    moves = _found(segments, E.date_changes("text"), doc)
    moves = moves.select(
        doc, "segment_id", "page_no", "pos", "from_date", "to_date", F.lit("EVENT_DATE").alias("field_type"), F.lit("原预约与调整日期").alias("label"),
        F.concat("from_date", F.lit(" → "), "to_date").alias("value"), "source_quote",
    )
    moves = top_per_key(moves, [doc, "from_date", "to_date"], [F.col("page_no"), F.col("segment_id"), F.col("pos")], 1)
    dated = facts.where("field_type = 'EVENT_DATE'").select(doc, E.embedded("value", V.DATE_TOKEN).alias("_all"))
    dated = dated.select(doc, "_all", F.explode("_all").alias("from_date"))
    pairs = dated.select(doc, "from_date", F.explode("_all").alias("to_date")).distinct()
    moves = moves.join(pairs, [doc, "from_date", "to_date"], "left_anti")
    ends = _found(segments, E.deadlines("text"), doc).withColumns({"field_type": F.lit("END_DATE"), "label": F.lit("确认截止")})
    ends = top_per_key(ends, [doc, "value"], [F.col("page_no"), F.col("segment_id"), F.col("pos")], 1)
    known = facts.where("field_type = 'END_DATE'").select(doc, F.explode(E.embedded("value", V.DEADLINE[1:-1])).alias("value")).distinct()
    ends = ends.join(known, [doc, "value"], "left_anti")
    return moves.select(doc, *cols).unionByName(ends.select(doc, *cols)).withColumn("confidence", F.lit(0.99))


# ------------------------------------------------------------------ summaries --
def fact_summary(facts: DataFrame, doc: str = "doc_id", type_order=None, steps=None) -> DataFrame:
    """(doc, summary, plain_text, steps, warnings) built from the facts alone.

    A fact sheet is one row per document, so its lines come together there.
    """
    type_order, steps = type_order or V.SUMMARY_TYPE_ORDER, steps or V.STEP_TITLES
    rank = F.array_position(F.array(*[F.lit(t) for t in type_order]), F.col("field_type"))
    line = F.concat("label", F.lit("："), "value")
    entry = F.struct(rank.alias("r"), F.col("fact_id").alias("i"), line.alias("line"), F.col("field_type").alias("t"), F.col("value").alias("v"))
    sheet = facts.groupBy(doc).agg(F.array_sort(F.collect_list(entry)).alias("_f"))
    ranked = F.filter("_f", lambda f: f["r"] > 0)
    used = F.when(F.size(ranked) > 0, ranked).otherwise(F.col("_f"))
    sheet = sheet.withColumn("_lines", F.transform(used, lambda f: f["line"]))

    def first_value(kind):
        return F.try_element_at(F.filter("_f", lambda f: f["t"] == kind), F.lit(1))["v"]

    step_lines = F.array_compact(F.array(*[F.concat(F.lit(title + "："), first_value(kind)) for kind, title in steps]))
    return sheet.select(
        doc, F.slice("_lines", 1, 3).alias("summary"), F.concat(F.lit("已根据可追溯事实生成基础易读版本。\n"), F.array_join("_lines", "\n")).alias("plain_text"),
        step_lines.alias("steps"), F.array_distinct(F.transform(F.filter("_f", lambda f: f["t"] == "WARNING"), lambda f: f["v"])).alias("warnings"),
    )


def session_summary(facts: DataFrame, sessions: DataFrame, doc: str = "doc_id", verb: str = "接种时间为") -> DataFrame:
    """(doc, summary, steps): who, when (place only when there are several), what to bring; one step per session."""
    kinds = ("TARGET_AUDIENCE", "ELIGIBILITY", "MATERIAL", "CONTACT")
    values = facts.groupBy(doc).agg(*[F.nullif(_first_of_type(k, "value")["value"], F.lit("")).alias(k) for k in kinds])
    listed = sessions.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("page_no", "segment_id", "pos", "date", "time", "location"))).alias("_s"))
    out = listed.join(values, doc, "left")
    several = F.size(F.array_distinct(F.transform("_s", lambda s: s["location"]))) > 1
    who = F.concat_ws("，且", "TARGET_AUDIENCE", "ELIGIBILITY")
    schedule = F.array_join(F.transform("_s", lambda s: F.concat(
        s["date"], F.lit(verb), s["time"], F.when(several, F.concat(F.lit("，地点为"), s["location"])).otherwise("")
    )), "；")
    place = F.nullif(F.col("_s")[0]["location"], F.lit(""))
    bring = F.concat_ws("；", F.concat(F.lit("请带"), "MATERIAL"), F.concat(F.lit("到"), place), F.concat(F.lit("咨询电话"), "CONTACT"))
    summary = F.concat(
        F.when(who != "", F.array(F.concat(who, F.lit("，可以登记。")))).otherwise(F.array().cast("array<string>")),
        F.array(F.concat(schedule, F.lit("。")), F.concat(bring, F.lit("。"))),
    )
    steps = F.transform("_s", lambda s: F.concat(s["date"], F.lit(" "), s["time"], F.lit("，地点："), s["location"], F.lit("。")))
    return out.select(doc, summary.alias("summary"), steps.alias("steps"))
