"""Spelling variants: words at edit distance one, found with an index of grams of variable length.

Dictionary: every gram of 2 or 3 characters of the padded words (^word$) is counted, and a gram is kept when all its shorter beginnings
are frequent; so the dictionary is given by the set of frequent grams, which a share of all grams bounds.  Decomposition: at each position
the longest gram of the dictionary, without those that lie inside an earlier one.

Pairs are looked for by the length c of the shorter word, with grams of at most q characters, at most half of the padded length.  One edit at
character i leaves two kinds of grams alone: those whose look-ahead of q characters ends before i, and those that begin after i and end
where no gram from before can swallow them.  By the choice of q a word always keeps one (affected() counts the others).  Two near words
agree in all grams that their edit leaves alone, so the lists of these grams are merged before they are shuffled: a word has one entry for
each different set of unaffected grams, not one for each gram, and there are no more of them than grams.  Candidates are verified by their
edit distance inside the join, which only near pairs leave, each of them once: under the entry of their first different character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordered import Rounds
from .common import cut

SHORTEST, LONGEST = 2, 3  # characters of a gram
SAME, LONGER, SHORTER = 0, 1, 2
LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def noisy(run: Column, doc_id: Column, modulus: int = 97) -> Column:
    """The run without one character where the checksum of document and run says so; what remains of a run of one letter is empty."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(F.pmod(h, F.lit(modulus)) == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, least_length: int = 5, least_n: int = 3) -> DataFrame:
    """docs(doc_id, text) -> (word, n) of the words that are long and frequent enough, over all whole texts."""
    text = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    runs = docs.select(F.col("doc_id").alias("_id"), F.explode(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))).alias("_run"))
    words = runs.select(noisy(F.col("_run"), F.col("_id")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def padded(word: str) -> str:
    return f"^{word}$"


def frequent_grams(words: DataFrame, share: float = 1 / 20_000, least: int = 16) -> set[str]:
    """Grams that occur in more than this share of all gram places (and more than `least` times), the only ones that the dictionary extends.

    At most (LONGEST - SHORTEST) / share grams, whatever the number of words.  The result of the pair search does not depend on them.
    """
    p = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    places = [F.transform(F.sequence(F.lit(1), F.length(p) - (q - 1)), lambda i, q=q: F.substr(p, i, F.lit(q))) for q in range(SHORTEST, LONGEST)]
    grams = words.select(F.explode(F.flatten(F.array(*places))).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    total = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    return {r["g"] for r in grams.where(F.col("n") > max(least, total * share)).select("g").collect()}


def decompose(word: str, frequent: set[str], most: int) -> list[tuple[int, str]]:
    """(position, gram) of the longest dictionary gram at every position, without grams inside an earlier one."""
    s, out, reached = padded(word), [], 0
    for p in range(len(s) - SHORTEST + 1):
        q = SHORTEST
        while q < most and p + q < len(s) and s[p : p + q] in frequent:
            q += 1
        if p + q > reached:
            out.append((p, s[p : p + q]))
            reached = p + q
    return out


def affected(grams: list[tuple[int, str]], length: int, most: int) -> int:
    """The largest number of grams that one edit of a word of this length may change."""
    worst = 0
    for i in range(1, length + 1):
        safe = sum(p + most - 1 < i or (p > i and p + len(g) - 1 > i + most - 1) for p, g in grams)
        worst = max(worst, len(grams) - safe)
    return worst


def longest_gram(shorter: int) -> int:
    """Of words paired with words of at least this length."""
    return min(LONGEST, (shorter + 2) // 2)


def entries(word: str, frequent: set[str]) -> list[tuple[str, int, int, int]]:
    """(unaffected grams, kind, first, last) of a word: an entry stands for edits at the characters first to last.

    Kinds: SAME (the character is replaced), LONGER (it is the extra one), SHORTER (the extra one would stand before it).  The grams that
    such an edit leaves alone are written as the text they cover, on the left with their look-ahead; c, the length of the shorter word of
    the pair, stands before it.
    """
    out: list[tuple[str, int, int, int]] = []
    s, length = padded(word), len(word)
    for c in (length, length - 1):
        most = longest_gram(c)
        grams = decompose(word, frequent, most)
        n = len(grams)
        # left[i], right[i]: where the grams unaffected by an edit at character i end and begin, from the right end for those on the right
        left, right, k, m = [], [], 0, 0
        for i in range(length + 2):
            while k < n and grams[k][0] + most <= i:
                k += 1
            # right[0] is for a character inserted before the first
            while m < n and (grams[m][0] <= i or grams[m][0] + len(grams[m][1]) <= i + most):
                m += 1
            left.append(grams[k - 1][0] + most if k else 0)
            right.append(grams[m][0] if m < n else length + 2)
        kinds = [(SAME, left[1:-1], right[1:-1]), (SHORTER, left[1:], right[:-1])] if c == length else [(LONGER, left[1:-1], right[1:-1])]
        for kind, lefts, rights in kinds:
            first, last = 0, len(lefts)
            tag = f"{c}=" if kind == SAME else f"{c}+"
            for i in range(1, last + 1):
                if i == last or lefts[i] != lefts[first] or rights[i] != rights[first]:
                    out.append((f"{tag}{s[: lefts[first]]}|{s[rights[first] :]}", kind, first + 1, i))
                    first = i
    return out


def _index(words: DataFrame, frequent) -> DataFrame:
    """(entry, kind, word, n, first, last) of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for word in batch.column(0).to_pylist():
                rows = entries(word, frequent.value)
                found += rows
                sizes.append(len(rows))
            entry, kind, first, last = zip(*found) if found else ([], [], [], [])
            whose = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            columns = [pa.array(entry, pa.string()), pa.array(kind, pa.int32()), batch.column(0).take(whose), batch.column(1).take(whose), pa.array(first, pa.int32()), pa.array(last, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["entry", "kind", "word", "n", "first", "last"])

    return words.select("word", "n").mapInArrow(run, "entry string, kind int, word string, n long, first int, last int")


def near_pairs(words: DataFrame, rounds: Rounds) -> DataFrame:
    """words(word, n), distinct, of at least three characters -> (a, a_n, b, b_n): every pair at edit distance one, each once."""
    frequent = words.sparkSession.sparkContext.broadcast(frequent_grams(words))
    spread = words.repartition(words.sparkSession.sparkContext.defaultParallelism * 2)  # words are few where texts are many
    index = rounds.put(_index(spread, frequent)).withColumn("entry", F.xxhash64("entry"))  # candidates are verified
    one = index.where(F.col("kind") != LONGER).select("entry", F.col("word").alias("a"), F.col("n").alias("a_n"), "first", "last")
    other = index.where(F.col("kind") != SHORTER).select("entry", F.col("word").alias("b"), F.col("n").alias("b_n"))
    ordered = (F.length("b") > F.length("a")) | (F.col("a") < F.col("b"))
    # the first different character is one of those that the entry stands for
    begins = F.substr("a", F.lit(1), F.col("first") - 1) == F.substr("b", F.lit(1), F.col("first") - 1)
    differs = (F.col("last") > F.length("a")) | (F.substr("a", F.lit(1), F.col("last")) != F.substr("b", F.lit(1), F.col("last")))
    return one.join(other, "entry").where(ordered & begins & differs & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")


def variants(counts: DataFrame, ratio: int = 2) -> DataFrame:
    """counts(word, n) -> word, form, root, n, n_near, form_n.

    form is the near word of largest n (ties: the smallest) if that is at least ratio times the word's own n, else null; root follows forms
    to the last, which ends because n grows at every step.
    """
    counts = cut(counts)
    ways = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("m")))
    rounds = Rounds(counts.sparkSession)
    near = near_pairs(counts, rounds).select(F.explode(ways).alias("w")).select("w.*")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("_best"))
    out = counts.join(best, "word", "left").withColumn("_ok", -F.col("_best.m") >= F.col("n") * ratio)
    forms = cut(out.select("word", F.when(F.col("_ok"), F.col("_best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("_ok"), -F.col("_best.m")).alias("form_n")))
    rounds.close()
    # pointer doubling: only words that have a form travel
    jumps = cut(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        on = jumps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = cut(jumps.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        jumps = step.drop("_moved")
        if step.where("_moved").isEmpty():
            break
    return forms.join(jumps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> one row per word of all whole texts with its form and the root of its group; see variants.

    Null and empty texts have no words, a null doc_id counts as an empty one; repeated rows count again; other columns are not read; an
    empty table gives an empty result.
    """
    return variants(word_counts(docs))
