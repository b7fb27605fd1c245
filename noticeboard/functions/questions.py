"""Question understanding, evidence scoring and answer checks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import vocab as V
from .core import SPACES, col, first_present, has_any, is_blank, left, nulls_to, text
from .texts import normalize


def _tokens(norm: Column, stop_chars: str) -> Column:
    return F.filter(F.split(norm, f"[{stop_chars}]+"), lambda t: F.length(t) >= 2)


def _groups(norm: Column, groups: list[list[str]]) -> list[Column]:
    none = F.array().cast("array<string>")
    return [F.when(has_any(norm, g), F.array(*[F.lit(w) for w in g])).otherwise(none) for g in groups]


def query_terms(q, stop_chars: str = V.QUESTION_STOP_CHARS, categories=None, synonyms=None) -> Column:
    """Tokens of two or more characters, category words present, synonym groups of a hit."""
    n = normalize(q)
    none = F.array().cast("array<string>")
    cats = [F.when(F.contains(n, F.lit(c)), F.array(F.lit(c))).otherwise(none) for c in (V.QUERY_CATEGORY_WORDS if categories is None else categories)]
    return F.array_distinct(F.concat(_tokens(n, stop_chars), *cats, *_groups(n, V.QUERY_SYNONYMS if synonyms is None else synonyms)))


def query_anchors(q, stop_chars: str = V.QUESTION_STOP_CHARS, topics=None) -> Column:
    """Tokens plus the groups of high-signal topics only."""
    n = normalize(q)
    return F.array_distinct(F.concat(_tokens(n, stop_chars), *_groups(n, V.ANCHOR_TOPICS if topics is None else topics)))


def term_points(title: Column, category: Column, summary: Column, raw: Column, facts: Column):
    """What one term earns on an item with these (normalised) texts."""

    def points(term: Column) -> Column:
        gained = (
            F.when(F.contains(category, term) | F.contains(term, category), 12).otherwise(0) + F.when(F.contains(title, term), 8).otherwise(0)
            + F.when(F.contains(summary, term), 4).otherwise(0) + F.when(F.contains(raw, term), 2).otherwise(0) + F.when(F.contains(facts, term), 10).otherwise(0)
        )
        return F.when(F.length(term) >= 2, gained).otherwise(0)

    return points


def lexical_score(terms, anchors, slug, context_slug, title, category, summary, raw, facts, prepared: bool = False) -> Column:
    """Relevance of one item for one question; prepared means the item's texts are normalised already."""
    contextual = nulls_to(col(context_slug) == col(slug), False)
    t, c, s, r, f = (col(x) if prepared else normalize(x) for x in (title, category, summary, raw, facts))
    anchored = F.exists(
        col(anchors), lambda a: F.contains(t, a) | F.contains(c, a) | F.contains(s, a) | F.contains(f, a)
    )

    worth = term_points(t, c, s, r, f)
    total = F.aggregate(col(terms), F.when(contextual, 100).otherwise(0), lambda acc, term: acc + worth(term))
    return F.when(contextual | anchored, total).otherwise(F.lit(0))


def post_score(terms, content, category, prepared: bool = False) -> Column:
    """+8 for each term in the content, +4 for each in (or around) the category; prepared means both are normalised already."""
    n, c = (col(x) if prepared else normalize(x) for x in (content, category))
    return F.aggregate(
        F.filter(col(terms), lambda t: F.length(t) >= 2),
        F.lit(0),
        lambda acc, t: acc
        + F.when(F.contains(n, t), 8).otherwise(0)
        + F.when(F.contains(c, t) | F.contains(t, c), 4).otherwise(0),
    )


def best_quote(raw, summary, facts, terms, max_length: int = 500) -> Column:
    """Up to four sentences with a term (else the first one), with the reviewed facts and summary around them."""
    source = F.when(is_blank(raw), text(summary)).otherwise(text(raw))
    # a sentence ends after its stop mark(s) or at a line break
    sentences = F.filter(
        F.transform(F.regexp_extract_all(source, F.lit(r"[^。！？!?.\n]+[。！？!?.]*|[。！？!?.]+"), F.lit(0)), lambda x: F.trim(x)),
        lambda x: x != "",
    )
    wanted = F.filter(col(terms), lambda t: F.length(t) >= 2)
    hits = F.slice(F.filter(sentences, lambda x: F.exists(wanted, lambda t: F.contains(normalize(x), t))), 1, 4)
    body = F.when(F.size(hits) > 0, F.array_join(hits, " ")).otherwise(F.try_element_at(sentences, F.lit(1)))
    joined = F.concat_ws(
        " ",
        F.when(~is_blank(facts), F.concat(F.lit("已审核字段："), text(facts))),
        F.nullif(body, F.lit("")),
        F.when(~is_blank(summary), F.concat(F.lit("审核摘要："), text(summary))),
    )
    compact = F.trim(F.regexp_replace(joined, SPACES, " "))
    return F.when(F.length(compact) <= max_length, compact).otherwise(F.concat(left(compact, max_length - 3), F.lit("…")))


def question_category(q, categories=None, other: str = V.OTHER_CATEGORY) -> Column:
    return nulls_to(first_present(normalize(q), categories or V.QUESTION_CATEGORIES), other)


def question_intent(q, community=None, nearby: str = V.NEARBY_WORD, nearby_topics=None, status=None, high_risk=None) -> Column:
    """Struct of three flags."""
    n = normalize(q)
    return F.struct(
        (has_any(n, community or V.COMMUNITY_WORDS) | (F.contains(n, F.lit(nearby)) & has_any(n, nearby_topics or V.NEARBY_TOPICS))).alias("is_community"),
        has_any(n, status or V.STATUS_WORDS).alias("is_status"),
        has_any(n, high_risk or V.HIGH_RISK_WORDS).alias("is_high_risk"),
    )


def weak_answer(a, phrases=None, max_length: int = 180) -> Column:
    """Null, blank, or short with a failure phrase."""
    return is_blank(a) | ((F.length(text(a)) < max_length) & has_any(F.lower(text(a)), phrases or V.WEAK_ANSWER_PHRASES))


def citation_quality(answer, evidence_count, actions, high_risk) -> Column:
    """Struct(valid, answer_chars, quality): every [n] of the answer must be a known citation."""
    body = F.trim(text(answer))
    cited = F.transform(F.regexp_extract_all(body, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int"))
    chars = F.length(F.regexp_replace(body, SPACES, ""))
    valid = (body != "") & (F.size(cited) > 0) & F.forall(cited, lambda x: nulls_to(x.between(1, col(evidence_count)), False))
    quality = (
        F.when(col(high_risk), "safety").when((chars >= 250) & (col(actions) >= 3), "rich")
        .when(chars < 100, "short").otherwise("normal")
    )
    return F.struct(valid.alias("valid"), chars.alias("answer_chars"), quality.alias("quality"))

