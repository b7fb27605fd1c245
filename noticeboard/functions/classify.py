"""Dictionary and rule classification.  All dictionaries are arguments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import vocab as V
from .core import (
    col, count_present, first_present, has_any, left, let, map_lookup, nulls_to, present, strip, text,
    total_occurrences,
)


def classify_content(title, body, strong=None, rules=None, body_chars: int | None = None) -> Column:
    """Struct(kind, confidence): ordered title rules first, else the best keyword score (first rule wins ties).

    The whole body is scored unless body_chars asks for a prefix.
    """
    strong, rules = strong or V.STRONG_TITLE_RULES, rules or V.CONTENT_KIND_RULES
    t = text(title)
    by_title = F.coalesce(*[F.when(has_any(t, ws), F.lit(k)) for k, ws in strong], F.lit(None).cast("string"))

    def best(b: Column) -> Column:
        scored = [
            F.struct((total_occurrences(t, ws) * 4 + total_occurrences(b, ws)).alias("score"), F.lit(-i).alias("rank"), F.lit(k).alias("kind"))
            for i, (k, ws) in enumerate(rules)
        ]
        return F.greatest(*scored) if len(scored) > 1 else scored[0]

    def verdict(top: Column) -> Column:
        score = top["score"]
        return F.struct(
            F.when(score > 0, top["kind"]).otherwise(F.lit("GENERAL_NEWS")).alias("kind"),
            F.when(score > 0, F.least(F.lit(0.98), F.lit(0.68) + score * F.lit(0.05))).otherwise(F.lit(0.55)).alias("confidence"),
        )

    # the body is only looked at when the title does not decide
    return F.when(by_title.isNotNull(), F.struct(by_title.alias("kind"), F.lit(0.95).alias("confidence"))).otherwise(
        let(text(body) if body_chars is None else left(text(body), body_chars), lambda b: let(best(b), verdict))
    )


def document_kind(title, body, source, declared, signals=None, kinds=None) -> Column:
    """Declared kind wins; else 8 x distinct + 2 x body + corpus counts; the body must hit; ties to the greatest name."""
    signals, kinds = signals or V.DOCUMENT_KIND_SIGNALS, kinds or V.DOCUMENT_KINDS
    b = text(body)

    def best(corpus: Column) -> Column:
        scored = [_signal_score(b, corpus, kind, words) for kind, words in signals.items()]
        return F.greatest(*scored) if len(scored) > 1 else scored[0]

    guessed = let(F.concat(text(title), F.lit("\n"), text(source), F.lit("\n"), b), lambda corpus: F.coalesce(best(corpus)["kind"], F.lit("GENERAL_PUBLIC_SERVICE")))
    return F.when(col(declared).isin(kinds), col(declared)).otherwise(guessed)


def _signal_score(body: Column, corpus: Column, kind: str, words: list[str]) -> Column:
    """Struct(score, kind), null unless the body has a signal."""

    def score(in_body: Column) -> Column:
        points = count_present(body, words) * 8 + in_body * 2 + total_occurrences(corpus, words)
        return F.when(in_body > 0, F.struct(points.alias("score"), F.lit(kind).alias("kind")))

    return let(total_occurrences(body, words), score)


def _confidence_table() -> dict[int, float]:
    """Published two-decimal confidences depend only on min(score,10) and min(margin,5)."""
    return {
        s * 10 + m: round(min(0.95, 0.58 + s * 0.025 + m * 0.025), 2) for s in range(1, 11) for m in range(0, 6) if m <= s
    }


def channel_scores(df: DataFrame, title: str, body: str, kind: str | None, words=None, kind_map=None) -> DataFrame:
    """One column s_<channel> and w_<channel> (matched words) per channel."""
    words, kind_map = words or V.CHANNEL_WORDS, V.CHANNEL_OF_CONTENT_KIND if kind_map is None else kind_map
    t = strip(title)
    searchable = F.concat(t, F.lit("\n"), strip(body))
    mapped = map_lookup(col(kind), kind_map) if kind and kind_map else F.lit(None).cast("string")
    cols = {}
    for channel, ws in words.items():
        points = F.when(mapped == channel, 4).otherwise(0)
        for w in ws:
            points = points + F.when(F.contains(searchable, F.lit(w)), F.when(F.contains(t, F.lit(w)), 3).otherwise(1)).otherwise(0)
        if channel == "MEALS":
            points = points + F.when(has_any(searchable, ws), 3).otherwise(0)
        cols[f"s_{channel}"] = points
        cols[f"w_{channel}"] = present(searchable, ws)
    return df.withColumns({**cols, "mapped_channel": mapped})


def suggest_channel(
    df: DataFrame, title: str = "title", body: str = "text", kind: str | None = "content_kind", words=None, kind_map=None,
    tie_order=None, labels=None,
) -> DataFrame:
    """Adds channel, channel_confidence and channel_reason."""
    words, tie_order = words or V.CHANNEL_WORDS, tie_order or V.CHANNEL_TIE_ORDER
    labels = labels or V.CHANNEL_LABELS
    base = df.columns
    scored = channel_scores(df, title, body, kind, words, kind_map)
    ranked = [
        F.struct(F.col(f"s_{c}").alias("score"), F.lit(-tie_order.index(c)).alias("rank"), F.lit(c).alias("channel"), F.col(f"w_{c}").alias("words"))
        for c in words
    ]
    scored = scored.withColumn("best", F.greatest(*ranked))
    best = F.col("best")
    runner = F.greatest(*[F.when(best["channel"] != c, F.col(f"s_{c}")).otherwise(F.lit(0)) for c in words])
    margin = F.greatest(F.lit(0), best["score"] - runner)
    level = F.least(best["score"], F.lit(10)) * 10 + F.least(margin, F.lit(5))
    evidence = F.array_join(F.slice(best["words"], 1, 4), "、")
    kind_text = text(kind) if kind else F.lit("")
    basis = F.when(
        nulls_to(F.col("mapped_channel") == best["channel"], False),
        F.concat(
            F.lit("内容类型 "), kind_text,
            F.when(evidence != "", F.concat(F.lit("，并匹配“"), evidence, F.lit("”"))).otherwise(""),
        ),
    ).otherwise(F.concat(F.lit("标题或正文匹配“"), evidence, F.lit("”")))
    none = best["score"] == 0
    return scored.select(
        *base,
        F.when(none, F.lit("COMMUNITY")).otherwise(best["channel"]).alias("channel"),
        F.when(none, F.lit(0.35)).otherwise(map_lookup(level, _confidence_table())).alias("channel_confidence"),
        F.when(none, F.lit("未识别到明确频道特征，建议由管理员根据原文确认")).otherwise(
            F.concat(basis, F.lit("，建议归入"), map_lookup(best["channel"], labels, ""), F.lit("；发布前可人工调整"))
        ).alias("channel_reason"),
    )


def rule_channel(category, kind, title, rules=None, default: str = "COMMUNITY") -> Column:
    """First rule whose pattern occurs in category, kind and title."""
    joined = F.concat_ws(" ", text(category), text(kind), text(title))
    return F.coalesce(*[F.when(F.rlike(joined, F.lit(p)), F.lit(c)) for c, p in rules or V.RULE_CHANNELS], F.lit(default))


def migration_channel(category, kind, title, rules=None, default: str = "COMMUNITY") -> Column:
    """The back-fill variant: category word, content kind or title words."""
    out = []
    for channel, word, k, title_words in rules or V.MIGRATION_CHANNELS:
        cond = F.contains(text(category), F.lit(word)) | has_any(text(title), title_words)
        if k:
            cond = cond | (text(kind) == k)
        out.append(F.when(cond, F.lit(channel)))
    return F.coalesce(*out, F.lit(default))


def category_of_kind(kind, mapping=None, default: str = V.DEFAULT_CATEGORY) -> Column:
    return map_lookup(col(kind), mapping or V.CATEGORY_OF_CONTENT_KIND, default)


def source_type(name, rules=None) -> Column:
    """First rule with one of its words in the name, else empty."""
    return F.coalesce(*[F.when(has_any(text(name), ws), F.lit(label)) for ws, label in rules or V.SOURCE_TYPES], F.lit(""))


def resident_relevance(title, url, high=None, low=None, default_topic: str = V.DEFAULT_TOPIC, reasons=None) -> Column:
    """Struct(relevance_level, relevance_score, recommended_topic, recommendation_reason)."""
    high, low = high or V.RELEVANT_WORDS, low or V.IRRELEVANT_WORDS
    searchable = F.lower(F.concat(strip(title), F.lit(" "), strip(url)))
    pos, neg = count_present(searchable, high), count_present(searchable, low)
    level = F.when((neg > 0) & (pos == 0), "LOW").when(pos >= 2, "HIGH").otherwise("MEDIUM")
    return F.struct(
        level.alias("relevance_level"),
        F.greatest(F.lit(0), F.least(F.lit(100), F.lit(45) + pos * 18 - neg * 35)).alias("relevance_score"),
        nulls_to(first_present(searchable, high), default_topic).alias("recommended_topic"),
        map_lookup(level, reasons or V.RELEVANCE_REASONS).alias("recommendation_reason"),
    )


def term_hits(df: DataFrame, text_col: str, dictionary: list[str], keep: list[str]) -> DataFrame:
    """Text x small dictionary: one row per (text, contained word)."""
    return df.select(*keep, F.explode(present(text(text_col), dictionary)).alias("word"))


def match_terms(df: DataFrame, dictionary: DataFrame, text_col: str, id_col: str, word_col: str = "word", lengths=None) -> DataFrame:
    """Text x large dictionary ("text contains word") as an equi join.

    Words form classes by length (1, 2-3, 4-7, 8-15, ...).  Each position of the
    text yields one piece per class, as long as its longest word; pieces and words
    of a class meet on the characters all its words have (its shortest length) and
    the rest is compared after the join, so there is no theta join and short words
    do not widen the join of long ones.  lengths is the (shortest, longest) word
    length, read with the classes from the dictionary when absent.
    """
    length = F.length(word_col)
    words = dictionary.where(length > 0).select(word_col).distinct()
    if lengths is None:  # a row per class
        classes = {r[0]: (r[1], r[2]) for r in words.groupBy(F.length(F.bin(length))).agg(F.min(length), F.max(length)).collect()}
    else:
        lo, hi = lengths
        classes = {k: (max(lo, 1 << k - 1), min(hi, (1 << k) - 1)) for k in range(lo.bit_length(), hi.bit_length() + 1)}
    if not classes:
        return df.select(id_col, F.lit(None).cast("string").alias(word_col)).limit(0)

    def pieces(k: int) -> Column:
        lo, hi = classes[k]
        found = F.array_distinct(F.regexp_extract_all(text(text_col), F.lit(f"(?s)(?=(.{{{lo},{hi}}}))"), F.lit(1)))
        return F.transform(found, lambda p: F.struct(F.lit(k).alias("_class"), left(p, lo).alias("_head"), p.alias("_piece")))

    words = words.withColumn("_class", F.length(F.bin(length)))
    head = F.coalesce(*[F.when(F.col("_class") == k, left(F.col(word_col), lo)) for k, (lo, _) in classes.items()])
    return (
        df.select(id_col, F.explode(F.concat(*map(pieces, sorted(classes)))).alias("_p")).select(id_col, "_p.*")
        .join(words.withColumn("_head", head), ["_class", "_head"])
        .where(F.startswith(F.col("_piece"), F.col(word_col)))
        .select(id_col, word_col).distinct()
    )


MASK = 1 << 23  # bits of the mask of a dictionary, whatever its size
_SECTION = 1 << 20  # bytes of a text that are looked at together
_ODD = 0x9E3779B97F4A7C15


def _heads(data: np.ndarray, widths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(w, hash of the w bytes at every place) for ascending powers of two; each width is made of two of the width before."""
    h, w = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(_ODD), 1
    for wanted in widths:
        while w < wanted:
            h = (h[: max(0, len(h) - w)] * np.uint64(_ODD + 2 * w) + h[w:]) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(29)
            w *= 2
        yield w, h


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h * np.uint64(_ODD) >> np.uint64(41)).astype(np.int64)


def _whole(head: np.ndarray, tail: np.ndarray, length: int) -> np.ndarray:
    """Hash of words of w to 2 w - 1 bytes from their first and their last w bytes."""
    return (head * np.uint64(3) + tail) * np.uint64(2 * length + 1)


def _word_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word its number of bytes and the bits of its beginning and of the whole of it."""
    for b in batches:
        rows = []
        for word in b.column(0):
            data = np.frombuffer(word.as_buffer(), np.uint8)
            w = 1 << len(data).bit_length() - 1
            (_, h), = _heads(data, [w])
            rows += [(len(data), int(k)) for k in _bucket(np.concatenate([h[:1], _whole(h[:1], h[-1:], len(data))]))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["length", "bucket"])


def match_fields(df: DataFrame, dictionary: DataFrame, fields: list[str], id_col: str, word_col: str = "word") -> DataFrame:
    """(id, word, other columns of the dictionary, _fields): words in texts; bit i of _fields is set when fields[i] contains the word.

    Words of any number, one row each.  Where a word may begin is looked up in a mask of fixed size before
    anything is shuffled (it lets some other places through too, the more the larger the dictionary), so only the
    words of a text are, not its pieces; the join with the dictionary decides.
    """
    words = dictionary.where(F.length(word_col) > 0).withColumn("_w", F.col(word_col).cast("binary"))
    bits = words.select("_w").mapInArrow(_word_buckets, "length long, bucket long")
    lengths = sorted(r[0] for r in bits.select("length").distinct().collect())
    if not lengths:
        return df.select(id_col, *[F.lit(None).cast(t).alias(c) for c, t in dictionary.dtypes], F.lit(0).alias("_fields")).limit(0)
    set_bits = bits.groupBy(F.expr("bucket div 8").alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(bucket % 8 as int))")).alias("bits")).toArrow()
    made = np.zeros(MASK // 8, np.uint8)
    made[set_bits["byte"].to_numpy()] = set_bits["bits"].to_numpy()
    mask = df.sparkSession.sparkContext.broadcast(made)
    classes = {}
    for n in lengths:
        classes.setdefault(1 << n.bit_length() - 1, []).append(n)

    def known(h: np.ndarray) -> np.ndarray:
        bucket = _bucket(h)
        return (mask.value[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1 == 1

    def words_of(data: np.ndarray) -> set[bytes]:
        found = set()
        for start in range(0, len(data), _SECTION):
            part = data[start : start + _SECTION + lengths[-1] - 1]
            for w, h in _heads(part, list(classes)):
                at = np.flatnonzero(known(h)) if len(part) >= w else ()
                for n in classes[w] if len(at) else ():
                    begin = at[at + n <= len(part)]
                    begin = begin[known(_whole(h[begin], h[begin + n - w], n))]
                    found.update(part[i : i + n].tobytes() for i in begin)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, word, where = [], [], []
            for i in range(b.num_rows):
                seen = {}
                for k, f in enumerate(fields):
                    value = b.column(f)[i]
                    for x in words_of(np.frombuffer(value.as_buffer(), np.uint8)) if value.is_valid else ():
                        seen[x] = seen.get(x, 0) | 1 << k
                row += [i] * len(seen)
                word += seen
                where += seen.values()
            yield pa.RecordBatch.from_arrays([b.column(id_col).take(pa.array(row, pa.int64())), pa.array(word, pa.binary()), pa.array(where, pa.int32())], names=[id_col, "_w", "_fields"])

    found = df.select(id_col, *fields).mapInArrow(run, f"{id_col} {dict(df.dtypes)[id_col]}, _w binary, _fields int")
    return found.join(words, "_w").select(id_col, *dictionary.columns, "_fields")
