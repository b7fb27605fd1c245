"""Scalar text functions: hashing, normalising, cleaning, measuring, masking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from . import vocab as V
from .core import (
    LINE_BREAK, SPACES, col, collapse, count_present, has_any, is_blank, left, let, round_half_up, squeeze, strip, text,
)

# ---------------------------------------------------------------- identity --


def content_hash(c: Column | str) -> Column:
    """SHA-256 of the text without (Unicode) white space."""
    return F.sha2(squeeze(c), 256)


def cache_key(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by a pipe; null parts count as empty."""
    return F.sha2(F.concat_ws("|", *[text(p) for p in parts]), 256)


def visitor_id(c: Column | str) -> Column:
    """Ids of 8..64 characters are kept, other ones are replaced by a short hash."""
    raw = strip(c)
    hashed = F.when(raw == "", F.lit("default")).otherwise(left(F.sha2(raw, 256), 16))
    return F.when(F.length(raw).between(8, 64), raw).otherwise(F.concat(F.lit("anon-"), hashed))


def identity_fingerprint(domain, account_name, account_subject, account_biz, shared_host: str = V.ACCOUNT_HOST) -> Column:
    """SHA-256 of the domain; pages of one shared host add the account key."""
    host = F.lower(text(domain))
    account = F.when(is_blank(account_biz), F.concat(text(account_name), F.lit("|"), text(account_subject))).otherwise(
        text(account_biz)
    )
    return F.sha2(F.when(host == shared_host, F.concat(host, F.lit("|"), account)).otherwise(host), 256)


def stable_pick(identity: Column | str, pool: list[str], alternate: Column | int = 0) -> Column:
    """32-bit FNV-1a of the identity picks one element of the pool."""
    codes = F.transform(
        F.filter(F.split(text(identity), ""), lambda ch: ch != ""), lambda ch: F.ascii(ch).cast("bigint")
    )
    # hash < 2^32 and prime < 2^25, so the product fits a bigint before the modulo
    h = F.aggregate(
        codes,
        F.lit(2166136261).cast("bigint"),
        lambda acc, code: (acc.bitwiseXOR(code) * F.lit(16777619).cast("bigint")) % F.lit(4294967296),
    )
    alt = F.greatest(F.lit(0), alternate if isinstance(alternate, Column) else F.lit(alternate))
    return F.element_at(F.array(*[F.lit(p) for p in pool]), ((h + alt) % F.lit(len(pool)) + 1).cast("int"))


# -------------------------------------------------------------- normalising --


def normalize(c: Column | str) -> Column:
    """Lower case without punctuation and separators (search form)."""
    return F.regexp_replace(F.lower(text(c)), r"[\p{P}\p{Z}\s]+", "")


def topic_tokens(c: Column | str) -> Column:
    """Distinct ASCII words of three or more characters plus CJK bigrams."""
    low = F.lower(text(c))
    words = F.regexp_extract_all(low, F.lit("[a-z0-9]{3,}"), F.lit(0))
    bigrams = F.regexp_extract_all(low, F.lit("(?=([㐀-鿿]{2}))"), F.lit(1))
    return F.array_distinct(F.concat(words, bigrams))


def image_relevance(title, evidence, method, base=None, unrelated=None) -> Column:
    """0..100: base by discovery method, shared topic tokens, article hints, unrelated words."""
    base = base or V.IMAGE_BASE_SCORE
    unrelated = unrelated or V.IMAGE_UNRELATED_WORDS
    ev = collapse(evidence)
    low = F.lower(ev)
    shared = F.size(F.array_intersect(topic_tokens(title), topic_tokens(ev)))
    start = F.coalesce(*[F.when(col(method) == k, F.lit(v)) for k, v in base.items()])
    score = (
        start
        + F.least(F.lit(24), shared * 4)
        + F.when(has_any(low, ["article", "main"]), 15).otherwise(0)
        - count_present(low, unrelated) * 20
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def normalize_fact(c: Column | str) -> Column:
    """No white space, ASCII colon, dates as YYYYMMDD, no dashes."""
    out = F.translate(squeeze(c), "：", ":")
    out = F.regexp_replace(out, r"(\d{4})[-/年](\d{1,2})[-/月](\d{1,2})日?", "$1\u0001$2\u0002$3\u0003")
    out = F.regexp_replace(out, "\u0001(\\d)\u0002", "\u00010$1\u0002")
    out = F.regexp_replace(out, "\u0002(\\d)\u0003", "\u00020$1\u0003")
    return F.regexp_replace(out, "[\u0001\u0002\u0003—–－-]+", "")


def facts_grounded(answer, evidence, patterns: list[str] | None = None) -> Column:
    """Does every date, time, phone or amount of the answer occur in the evidence?"""
    tokens = F.concat(
        *[F.regexp_extract_all(text(answer), F.lit(p), F.lit(0)) for p in patterns or V.GROUNDED_FACT_PATTERNS]
    )
    known = normalize_fact(evidence)
    return F.forall(tokens, lambda t: F.contains(known, normalize_fact(t)))


def number_tokens(c) -> Column:
    return F.regexp_extract_all(squeeze(c), F.lit(r"\d+"), F.lit(0))


def _numbers_within(part: Column, whole: Column) -> Column:
    return F.forall(
        F.array_distinct(part),
        lambda t: F.size(F.filter(part, lambda x: x == t)) <= F.size(F.filter(whole, lambda x: x == t)),
    )


def numbers_consistent(value, quote) -> Column:
    """Multiset of digit runs of the value is contained in the one of the quote."""
    return _numbers_within(number_tokens(value), number_tokens(quote))


def complete_temporal_value(field_type, value, quote, temporal: list[str] | None = None) -> Column:
    """A temporal value that lost digits of its quote is replaced by the quote."""
    lost = ~_numbers_within(number_tokens(quote), number_tokens(value))
    return F.when(col(field_type).isin(temporal or V.TEMPORAL_TYPES) & lost, col(quote)).otherwise(col(value))


# ---------------------------------------------------------------- measuring --


def estimate_tokens(c) -> Column:
    return F.when(is_blank(c), F.lit(0)).otherwise(
        F.greatest(F.lit(1), F.ceil(F.length(text(c)) / F.lit(2.0)).cast("int"))
    )


def reading_minutes(c) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text(c)) / F.lit(500.0)).cast("int"))


def common_prefix_length(a, b, max_bits: int = 30) -> Column:
    """Length of the common prefix by bisection: max_bits comparisons, whole texts."""
    left_text, right_text = text(a), text(b)
    limit = F.least(F.length(left_text), F.length(right_text))
    steps = F.array(*[F.lit(1 << k) for k in range(max_bits - 1, -1, -1)])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda lo, step: F.when(
            (lo + step <= limit)
            & (F.substr(left_text, F.lit(1), lo + step) == F.substr(right_text, F.lit(1), lo + step)),
            lo + step,
        ).otherwise(lo),
    )


def changed_chars(a, b) -> Column:
    return F.length(text(a)) + F.length(text(b)) - common_prefix_length(a, b) * 2


def prefix_similarity(a, b) -> Column:
    total = F.length(text(a)) + F.length(text(b))
    empty = (text(a) == "") | (text(b) == "")
    return F.when(empty, F.lit(0.0)).otherwise(common_prefix_length(a, b) * F.lit(2.0) / total)


def change_summary(old_text, new_text, old_hash, new_hash) -> Column:
    old_len, new_len = F.length(strip(old_text)), F.length(strip(new_text))
    delta = new_len - old_len
    return F.concat(
        F.lit("正文 SHA-256 由 "), left(text(old_hash), 12), F.lit(" 变为 "), left(text(new_hash), 12),
        F.lit("；正文长度由 "), old_len.cast("string"), F.lit(" 变为 "), new_len.cast("string"),
        F.lit("（"), F.when(delta >= 0, "+").otherwise(""), delta.cast("string"), F.lit(" 字）"),
    )


def page_quality(c, image_ratio, limits=(V.PAGE_GOOD, V.PAGE_UNCERTAIN, V.PAGE_THIN), weights=V.PAGE_WEIGHTS, full_chars: float = V.PAGE_FULL_CHARS) -> Column:
    """Struct of ratios, label and score of one page of extracted text."""
    raw, ratio = text(c), col(image_ratio).cast("double")

    def count(source: Column, cls: str) -> Column:
        return F.length(source) - F.length(F.regexp_replace(source, cls + "+", ""))  # whole runs at a time

    def measure(solid: Column) -> Column:
        replacement = count(solid, "[\ufffd□]")
        denom = F.greatest(F.lit(1), F.length(solid))
        garbage = count(raw, "[\u0000-\u001f]") + count(solid, r"[\p{C}&&[^\x00-\x1f]]")
        return F.struct(
            F.length(strip(raw)).alias("chars"), (count(solid, r"[\p{L}\p{N}，。；：！？、（）()《》【】\[\]\-—_/:.%+]") / denom).alias("valid"),
            (count(solid, "[一-鿿]") / denom).alias("chinese"), (replacement / denom).alias("repl"), ((garbage + replacement) / denom).alias("garbage"),
            ((F.length(raw) - F.length(solid)) / F.greatest(F.lit(1), F.length(raw))).alias("space"), denom.alias("denom"),
        )

    def judge(m: Column) -> Column:
        thin = (ratio >= limits[2]["image"]) & (m["chars"] < limits[2]["chars"])
        meets = lambda least: (m["chars"] >= least["chars"]) & (m["valid"] >= least["valid"]) & (m["repl"] <= least["repl"]) & (m["garbage"] <= least["garbage"])
        label = F.when(meets(limits[0]) & ~thin, "GOOD").when(meets(limits[1]), "UNCERTAIN").otherwise("POOR")
        parts = {"length": F.least(F.lit(1.0), m["chars"] / F.lit(full_chars)), **{k: m[k] for k in ("valid", "chinese", "repl", "garbage")}, "thin": F.when(thin, 1.0).otherwise(0.0)}
        score = reduce(lambda a, b: a + b, [parts[k] * w for k, w in weights.items()])
        return F.struct(
            label.alias("quality"), score.alias("raw_score"), round_half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4).alias("score"),
            m["chars"].alias("text_char_count"), round_half_up(m["chinese"], 4).alias("valid_chinese_ratio"), round_half_up(m["repl"], 4).alias("replacement_char_ratio"),
            round_half_up(m["space"], 4).alias("whitespace_ratio"), round_half_up(m["garbage"], 4).alias("suspicious_garbage_ratio"),
            (label != "GOOD").alias("needs_human_review"),
        )

    return let(F.regexp_replace(raw, SPACES, ""), lambda solid: let(measure(solid), judge))


def output_quality(source, summary, plain, key_facts, actions, faq) -> Column:
    """Struct of length, compression, residue and count metrics of a rewritten text."""
    return F.struct(
        F.length(text(source)).alias("source_char_count"),
        (F.length(text(plain)) + F.length(text(summary))).alias("accessible_char_count"),
        round_half_up(
            F.length(text(summary)) / F.greatest(F.lit(1), F.length(text(source))), 4
        ).alias("summary_compression_ratio"),
        col(key_facts).alias("key_fact_count"),
        col(actions).alias("action_item_count"),
        F.when((col(key_facts) > 0) | (col(actions) > 0) | (col(faq) > 0), 1.0).otherwise(0.0).alias("trace_pass_rate"),
        F.regexp_count(text(plain), F.lit(r"#{1,6}\s|\*\*|```|<[^>]+>")).alias("markdown_residue_count"),
    )


# ----------------------------------------------------------------- cleaning --


def clean_page(c) -> Column:
    """Page text without byte marks, fences, headings, emphasis and broken lines."""
    out = F.translate(text(c), "\u0000﻿", "")
    out = F.regexp_replace(out, "(?i)```(?:json)?|```", "")
    out = F.regexp_replace(out, r"(?m)^\s{0,3}#{1,6}\s*", "")
    out = F.replace(F.replace(out, F.lit("**"), F.lit("")), F.lit("__"), F.lit(""))
    out = F.regexp_replace(out, "[\t  ]+", " ")
    lines = F.transform(F.split(out, LINE_BREAK), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    kept = F.filter(
        lines,
        lambda x: (x != "")
        & ((F.length(x) - F.length(F.translate(x, "�□", ""))) / F.greatest(F.lit(1), F.length(x)) <= 0.25),
    )
    return F.array_join(kept, "\n")


def json_values_text(content_json) -> Column:
    """A JSON list or object as its values joined by blanks; a scalar or invalid JSON as text."""
    raw = col(content_json).cast("string")
    items = F.from_json(raw, "array<string>")
    values = F.map_values(F.from_json(raw, "map<string,string>"))

    def joined(arr):
        return F.array_join(F.filter(arr, lambda x: F.trim(x) != ""), " ")

    return F.coalesce(joined(items), joined(values), F.get_json_object(raw, "$"), raw)


def publication_summary(content_json, plain_text, max_length: int = 120) -> Column:
    """Plain, markup-free teaser of at most max_length characters."""
    source = text(json_values_text(content_json))
    source = F.when(is_blank(source), text(plain_text)).otherwise(source)
    out = F.regexp_replace(source, r"(?s)```(?:\w+)?\s*(.*?)```", " $1 ")
    out = F.regexp_replace(out, r"!\[[^\]]*\]\([^)]*\)", " ")
    out = F.regexp_replace(out, r"\[([^\]]+)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"(?m)^\s{0,3}#{1,6}\s*", "")
    out = F.regexp_replace(out, "<[^>]+>", " ")
    out = F.replace(F.replace(out, F.lit("**"), F.lit("")), F.lit("__"), F.lit(""))
    out = F.trim(F.regexp_replace(F.regexp_replace(out, "[*_~`>|]", " "), SPACES, " "))
    cut = F.concat(F.regexp_replace(left(out, max_length), r"[，、；：\s]+$", ""), F.lit("…"))
    return F.when(F.length(out) <= max_length, out).otherwise(cut)


def display_text(c) -> Column:
    """JSON unwrapped, entities decoded (the five predefined), markup and markdown removed."""
    raw = strip(c)
    looks_json = (F.startswith(raw, F.lit("{")) & F.endswith(raw, F.lit("}"))) | (
        F.startswith(raw, F.lit("[")) & F.endswith(raw, F.lit("]"))
    )
    out = F.when(looks_json, F.coalesce(json_values_text(raw), raw)).otherwise(raw)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(out, r"(?s)```.*?```", " ")
    out = F.regexp_replace(out, r"!\[[^\]]*\]\([^)]*\)", " ")
    out = F.regexp_replace(out, r"\[([^\]]+)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"(^|\s)#{1,6}\s*", "$1")
    out = F.regexp_replace(out, r"\*\*(.*?)\*\*", "$1")
    out = F.regexp_replace(out, r"__(.*?)__", "$1")
    out = F.regexp_replace(out, "[*_~`>|]", " ")
    out = F.regexp_replace(out, "<[^>]+>", " ")
    out = F.regexp_replace(out, r"\\[nrt]", " ")
    return F.trim(F.regexp_replace(out, SPACES, " "))


def clean_title(c, site_suffix: str = V.SITE_NAME_SUFFIX) -> Column:
    out = F.regexp_replace(display_text(c), r"\s+\d{12,}$", "")
    return F.trim(F.regexp_replace(out, site_suffix, ""))


def truncate_summary(c, max_length: int = 50) -> Column:
    out = display_text(c)
    cut = F.concat(F.regexp_replace(left(out, max_length), r"[，、；：\s]+$", ""), F.lit("…"))
    return F.when(F.length(out) > max_length, cut).otherwise(out)


def shorten_at_blank(c, max_length: int) -> Column:
    """Cut at the last blank if that keeps at least half, else at max_length - 1."""
    out = F.trim(F.regexp_replace(text(c), SPACES, " "))
    head = left(out, max_length)
    last_blank = F.length(head) - F.length(F.regexp_extract(head, r"[^ ]*$", 0)) - 1
    cut = F.greatest(F.lit(0), F.least(F.lit(max_length - 1), last_blank))
    cut = F.when(cut < max_length // 2, F.lit(max_length - 1)).otherwise(cut)
    return F.when(F.length(out) <= max_length, out).otherwise(
        F.concat(F.trim(F.substr(out, F.lit(1), cut)), F.lit("…"))
    )


def fallback_result(raw_text, title, max_length: int = 240) -> Column:
    safe = strip(raw_text)
    short = shorten_at_blank(safe, max_length)
    summary = F.when(is_blank(short), text(title)).otherwise(short)
    return F.struct(
        summary.alias("summary"),
        F.when(safe == "", summary).otherwise(safe).alias("plain_text"),
        F.when(summary == "", F.lit(0.0))
        .otherwise(F.length(summary) * F.lit(1.0) / F.greatest(F.lit(1), F.length(safe)))
        .alias("summary_compression_ratio"),
    )


# ------------------------------------------------------------------ masking --


def redact(c, mask: str = V.REDACTED, default: str = V.DEFAULT_ERROR_SUMMARY, max_length: int = 500) -> Column:
    """Mask credentials, drop stack frames, never return a blank."""
    out = F.coalesce(col(c), F.lit(default))
    for pattern, replacement in (
        (r"(?i)authorization\s*[:=]?\s*(?:bearer\s+)?[^\s,;]+", f"Authorization={mask}"),
        (r"(?i)(cookie|api[-_ ]?key)\s*[:=]?\s*[^\s,;]+", f"$1={mask}"),
        (r"(?i)bearer\s+[^\s,;]+", f"Bearer {mask}"),
        (r"(?i)sk-[A-Za-z0-9_-]{8,}", mask),
        (r"(?s)\s+at\s+[A-Za-z0-9_.$]+\([^)]*\)", ""),
    ):
        out = F.regexp_replace(out, pattern, replacement)
    out = F.trim(F.regexp_replace(out, r"^[\x00-\x20]+|[\x00-\x20]+$", ""))
    return left(F.when(out == "", F.lit(default)).otherwise(out), max_length)


def safe_code(c, max_length: int = 80, default: str = "UNKNOWN_ERROR") -> Column:
    return left(F.coalesce(F.upper(F.regexp_replace(col(c), "[^A-Za-z0-9_]", "_")), F.lit(default)), max_length)


def safe_identifier(c, max_length: int = 80) -> Column:
    cleaned = left(F.regexp_replace(col(c), "[^A-Za-z0-9._:-]", "_"), max_length)
    return F.when(is_blank(c), F.lit(None).cast("string")).otherwise(cleaned)


def filename_title(name, prefixes: list[str] | None = None) -> Column:
    """Title from a file name: no directory, no extension, no known prefixes."""
    out = F.regexp_replace(text(name), r"^.*/", "")
    out = F.regexp_replace(out, r"(?<=.)\.[^.]*$", "")
    for p in prefixes if prefixes is not None else V.FILENAME_PREFIXES:
        out = F.regexp_replace(out, p, "")
    return strip(F.regexp_replace(out, r"[_\-—\s]+", " "))


def is_chrome(c, words: list[str] | None = None) -> Column:
    """A short line with two or more navigation words."""
    line = F.replace(text(c), F.lit(" "), F.lit(""))
    return (F.length(line) < 80) & (count_present(line, words or V.CHROME_WORDS) >= 2)


def srcset_urls(c) -> Column:
    """URLs of a srcset attribute without the density or width hints."""
    firsts = F.transform(F.split(text(c), ","), lambda x: F.regexp_extract(x, r"^\s*(\S+)", 1))
    return F.filter(firsts, lambda u: u != "")


def ordered_distinct(c) -> Column:
    """First occurrences in their order."""
    return F.array_distinct(col(c))


def split_keywords(c, limit: int = 20) -> Column:
    words = F.split(F.lower(text(c)), r"[,，;；\s]+")
    return F.slice(F.array_distinct(F.filter(words, lambda w: F.trim(w) != "")), 1, limit)


def dedup_warnings(values) -> Column:
    """Clauses of an array of warnings, first of each canonical key, ending in a full stop."""
    clauses = F.flatten(F.transform(col(values), lambda v: F.split(F.coalesce(v, F.lit("")), "[。；;]+")))
    shown = F.filter(
        F.transform(clauses, lambda x: F.replace(F.regexp_replace(x, "^[ ，,。；;]+|[ ，,。；;]+$", ""), F.lit("无需"), F.lit("不需要"))),
        lambda x: x != "",
    )
    keyed = F.transform(
        shown,
        lambda x: F.struct(
            F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"[\s，,。；;！!]", ""), "向您", ""), "您", "").alias("k"),
            x.alias("v"),
        ),
    )

    def firsts(pairs: Column) -> Column:  # the clauses and their keys are made once per row, not once per clause
        return let(F.transform(pairs, lambda s: s["k"]), lambda keys: F.filter(pairs, lambda s, i: F.array_position(keys, s["k"]) == i + 1))

    return F.transform(let(keyed, firsts), lambda s: F.concat(s["v"], F.lit("。")))
