"""Candidate union, precedence de-duplication, exact content dedup, import batches and change detection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.core import nulls_to
from ..functions.texts import change_summary
from .joins import accept_in_order
from .ordered import top_per_key

METHOD_ORDER = ["JSON_LD", "SECTION"]


def all_candidates(*frames: DataFrame) -> DataFrame:
    """Candidates of every discovery method, in the given order (column batch)."""
    return reduce(lambda a, b: a.unionByName(b), [f.withColumn("batch", F.lit(i)) for i, f in enumerate(frames)])


def dedup_candidates(candidates: DataFrame, order=("page_url", "pos"), per_source: int | None = 100) -> DataFrame:
    """One candidate per (source, dedup_key), at most per_source of a source.

    The place in the list is the one of the first sighting, but a JSON-LD article
    replaces a section link.  Firsts are a partial aggregate, so a key with many
    copies is reduced before the shuffle.
    """
    cols = [c for c in candidates.columns if c not in ("source_id", "dedup_key")]
    weaker = (F.col("discovery_method") == "SECTION").cast("int")
    best = candidates.groupBy("source_id", "dedup_key").agg(
        F.min(F.struct(*order)).alias("_place"), F.min_by(F.struct(*cols), F.struct(weaker, *order)).alias("_row")
    )
    out = best if per_source is None else top_per_key(best, ["source_id"], [F.col("_place")], per_source)
    return out.select("source_id", "dedup_key", "_row.*")


def dedup_documents(docs: DataFrame, key: str = "content_hash", order: str = "id") -> DataFrame:
    """The earliest document of each key, with the number of copies.  Only keys and ids are aggregated."""
    firsts = docs.groupBy(key).agg(F.min(order).alias(order), F.count("*").alias("copies"))
    return docs.join(firsts.select(order, "copies"), order)


def import_batch(urls: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """Outcome per requested url: added, duplicate or failed (with retryable), each row on its own.

    urls carries canonical_url, content_hash and error_code (null when the page was
    read); a failure with a code of 500 or more, or without one, can be retried.
    """
    failed = F.col("failed")
    known = urls
    for k in ("canonical_url", "content_hash"):
        seen = existing.where(F.col(k).isNotNull()).select(k).distinct().withColumn(f"_seen_{k}", F.lit(True))
        known = known.join(seen, k, "left")
    known = known.withColumn("_known", nulls_to(F.col("_seen_canonical_url"), False) | nulls_to(F.col("_seen_content_hash"), False))
    fresh = accept_in_order(known.where(~failed & ~F.col("_known")).select(*order, "canonical_url", "content_hash"), ["canonical_url", "content_hash"], order)
    out = known.join(fresh.where("accepted").select(*order, F.lit(True).alias("_new")), order, "left")
    retryable = failed & (F.col("error_code").isNull() | (F.col("error_code") >= 500))
    outcome = F.when(failed, "failed").when(nulls_to(F.col("_new"), False), "added").otherwise("duplicate")
    return out.select(*urls.columns, outcome.alias("outcome"), retryable.alias("retryable"))


def batch_totals(outcomes: DataFrame, *keys: str) -> DataFrame:
    """Counts of an import batch with its final state."""
    from ..functions.jobs import job_outcome

    n = outcomes.groupBy(*keys).agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("added", "duplicate", "failed")])
    return n.withColumn("status", job_outcome("added", "duplicate", F.lit(0), "failed", "failed")["status"])


def version_changes(incoming: DataFrame, current: DataFrame) -> DataFrame:
    """What a new crawl of known addresses means for the stored documents.

    incoming (canonical_url, content_hash, text), one row per address; current
    (id, canonical_url, content_hash, text, status, root_id, version_no) with the
    latest version of each address.  Same hash: UNCHANGED.  Published and changed:
    NEW_VERSION, its published item needs review.  Otherwise the document is
    REPLACED in place, unless another document already has the text (DUPLICATE), or a
    smaller id of the same batch gets it.  New versions of one root are numbered in
    the order of the ids they replace.
    """
    new = incoming.select("canonical_url", F.col("content_hash").alias("new_hash"), F.col("text").alias("_new"))
    pairs = current.join(new, "canonical_url")
    # the smallest and greatest owner of a hash tell whether somebody else has it
    owners = current.groupBy(F.col("content_hash").alias("new_hash")).agg(F.min("id").alias("_lo"), F.max("id").alias("_hi"))
    pairs = pairs.join(owners, "new_hash", "left")
    elsewhere = nulls_to((F.col("_lo") != F.col("id")) | (F.col("_hi") != F.col("id")), False)
    same, live = F.col("content_hash") == F.col("new_hash"), F.col("status") == "PUBLISHED"
    action = F.when(same, "UNCHANGED").when(live, "NEW_VERSION").when(elsewhere, "DUPLICATE").otherwise("REPLACED")
    versions = current.groupBy("root_id").agg(F.max("version_no").alias("_top"))
    out = pairs.join(versions, "root_id").withColumn("action", action)
    gets = out.where(F.col("action").isin("NEW_VERSION", "REPLACED")).groupBy(F.col("new_hash").alias("_h")).agg(F.min("id").alias("_first"))
    out = out.join(gets, F.col("new_hash") == F.col("_h"), "left")
    out = out.withColumn("action", F.when((F.col("action") == "REPLACED") & (F.col("id") > F.col("_first")), "DUPLICATE").otherwise(F.col("action")))
    is_new = F.col("action") == "NEW_VERSION"
    number = F.col("_top") + F.count_if(is_new).over(Window.partitionBy("root_id").orderBy("id"))
    changed = F.col("action").isin("NEW_VERSION", "REPLACED")
    return out.select(
        "id", "canonical_url", "root_id", "action",
        F.when(is_new, number).otherwise(F.col("version_no")).alias("version_no"),
        F.when(is_new, F.col("id")).alias("previous_version_id"),
        F.when(changed, F.lit("UPLOADED")).otherwise(F.col("status")).alias("document_status"),
        F.when(is_new, F.lit("REVIEW_REQUIRED")).alias("verification_status"),
        F.when(is_new, change_summary("text", "_new", "content_hash", "new_hash")).alias("change_summary"),
    )
