"""Small column helpers shared by every other module.

Dictionary tests are unrolled into plain ``contains``/``replace`` expressions, so
they stay inside whole-stage codegen; higher-order functions are used only where
a value has to be looked at element by element.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, functions as F

# Unicode white space, as Python's str.isspace and Java's (?U)\s see it.
SPACES = r"(?U)\s+"
# str.splitlines
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """Null-safe string."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(text(c), r"(?U)^\s+|\s+$", "")


def collapse(c: Column | str) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(text(c), SPACES, " "))


def squeeze(c: Column | str) -> Column:
    """Remove all white space."""
    return F.regexp_replace(text(c), SPACES, "")


def is_blank(c: Column | str) -> Column:
    return strip(c) == ""


def all_of(conds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def any_of(conds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def has_any(c: Column, words: Iterable[str]) -> Column:
    return any_of(F.contains(c, F.lit(w)) for w in words)


def count_present(c: Column, words: Iterable[str]) -> Column:
    """How many of the words occur at least once."""
    return reduce(lambda a, b: a + b, (F.contains(c, F.lit(w)).cast("int") for w in words), F.lit(0))


def present(c: Column, words: Iterable[str]) -> Column:
    """The words that occur, in dictionary order, without duplicates."""
    hits = F.array(*[F.when(F.contains(c, F.lit(w)), F.lit(w)) for w in words])
    return F.array_except(hits, F.array(F.lit(None).cast("string")))


def first_present(c: Column, words: Iterable[str]) -> Column:
    return F.coalesce(*[F.when(F.contains(c, F.lit(w)), F.lit(w)) for w in words], F.lit(None).cast("string"))


def occurrences(c: Column, word: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(word), F.lit("")))) / F.lit(len(word))).cast("int")


def total_occurrences(c: Column, words: Iterable[str]) -> Column:
    return reduce(lambda a, b: a + b, (occurrences(c, w) for w in words), F.lit(0))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """Evaluate a costly value once and use it several times.

    Spark shares common subexpressions only outside of conditional branches.
    """
    return F.transform(F.array(value), then)[0]


def left(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def round_half_up(c: Column, digits: int) -> Column:
    """Round on doubles with one fixed rule (floor(x*10^n + 0.5)), the rule of Math.round."""
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def nulls_to(c: Column, value) -> Column:
    return F.coalesce(c, F.lit(value))


def regexp_or_null(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def map_lookup(c: Column, mapping: dict, default=None) -> Column:
    """A small fixed mapping as CASE WHEN (stays in codegen)."""
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == F.lit(k), F.lit(v)) if expr is None else expr.when(c == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)
