"""Joins.  Aggregates are built before the join; sides are never forced to broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.core import nulls_to, squeeze, text
from .budget import Capacity, admit_in_order
from .ordered import top_per_key


def engagement(events: DataFrame, key: str = "item_id", **types: str) -> DataFrame:
    """Conditional counts per key in one pass: engagement(ev, views='VIEW', likes='LIKE')."""
    return events.groupBy(key).agg(*[F.count_if(F.col("event_type") == t).alias(n) for n, t in types.items()])


def with_engagement(items: DataFrame, events: DataFrame, favorites: DataFrame, reminders: DataFrame) -> DataFrame:
    """Items with views, likes, favorites and reminders (0 when none).

    The four counts are taken from one union of narrow (item, type) rows, so the
    whole thing is one partial aggregate, one shuffle and one join.
    """
    facts = (
        events.where(F.col("event_type").isin("VIEW", "LIKE")).select("item_id", "event_type")
        .unionByName(favorites.select("item_id", F.lit("FAVORITE").alias("event_type")))
        .unionByName(reminders.select("item_id", F.lit("REMINDER").alias("event_type")))
    )
    counts = engagement(facts, views="VIEW", likes="LIKE", favorites="FAVORITE", reminders="REMINDER")
    joined = items.join(counts, items["id"] == counts["item_id"], "left").drop("item_id")
    return joined.withColumns({c: nulls_to(F.col(c), 0).cast("bigint") for c in ("views", "likes", "favorites", "reminders")})


def with_latest(df: DataFrame, child: DataFrame, key: str, child_key: str, order: list[str], take: dict[str, str], **aggs: Column) -> DataFrame:
    """Columns of the latest child row (greatest order) plus plain aggregates over all children."""
    latest = child.groupBy(F.col(child_key).alias("_k")).agg(
        F.max_by(F.struct(*[F.col(c).alias(n) for c, n in take.items()]), F.struct(*order)).alias("_last"),
        *[a.alias(n) for n, a in aggs.items()],
    )
    return df.join(latest, df[key] == latest["_k"], "left").select(
        *[df[c] for c in df.columns], *[F.col(f"_last.{n}").alias(n) for n in take.values()], *aggs
    )


def exists(df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    return df.join(other.select(F.col(other_key).alias(key)), key, "left_semi")


def not_exists(df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    return df.join(other.select(F.col(other_key).alias(key)), key, "left_anti")


def flag_exists(df: DataFrame, other: DataFrame, key: str, other_key: str, name: str) -> DataFrame:
    """Adds a flag telling whether the key occurs on the other side."""
    seen = other.select(F.col(other_key).alias(key)).distinct().withColumn(name, F.lit(True))
    return df.join(seen, key, "left").withColumn(name, nulls_to(F.col(name), False))


def owning_source(docs: DataFrame, jobs: DataFrame, registry: DataFrame, columns: list[str]) -> DataFrame:
    """Registry columns of the newest crawl job of each document."""
    newest = jobs.groupBy("document_id").agg(F.max_by("source_registry_id", "id").alias("source_registry_id"))
    reg = registry.select(F.col("id").alias("source_registry_id"), *columns)
    return docs.join(newest.join(reg, "source_registry_id"), docs["id"] == newest["document_id"]).drop("document_id")


def orders_view(orders: DataFrame, products: DataFrame, providers: DataFrame) -> DataFrame:
    return (
        orders.join(products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name")), "product_id")
        .join(providers.select(F.col("id").alias("provider_id"), F.col("name").alias("provider_name")), "provider_id")
    )


def queue_owner(queue: DataFrame, docs: DataFrame, users: DataFrame, orgs: DataFrame, registry: DataFrame) -> DataFrame:
    """Queue items with source (optional), creator and organisation of their document."""
    return (
        queue.join(registry.select(F.col("id").alias("source_registry_id"), "source_name"), "source_registry_id", "left")
        .join(docs.select(F.col("id").alias("document_id"), F.col("created_by").alias("user_id")), "document_id")
        .join(users.select(F.col("id").alias("user_id"), "organization_id"), "user_id")
        .join(orgs.select(F.col("id").alias("organization_id"), F.col("name").alias("organization_name")), "organization_id")
    )


def match_identity(previews: DataFrame, identities: DataFrame) -> DataFrame:
    """Previews whose fingerprint equals an officially verified registered one."""
    verified = identities.where("official_verified").select("fingerprint", "source_registry_id").distinct()
    return previews.join(verified, "fingerprint")


def recent_errors(errors: DataFrame, registry: DataFrame, limit: int = 10) -> DataFrame:
    """Newest unresolved errors that have a registered source, with its name."""
    reg = registry.select(F.col("id").alias("source_registry_id"), "source_name")
    return (
        errors.where("resolved_at is null").join(reg, "source_registry_id")
        .orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    )


def accept_in_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First come, first served on several unique keys at once.

    A row is accepted when no *accepted* earlier row has one of its key values;
    null keys never collide.  Adds the flag accepted.  Each key value is a capacity of
    one row, so a chain of rows with alternating keys is settled block by block.
    """
    caps = []
    for i, k in enumerate(keys):
        given = F.col(k).isNotNull()
        caps.append(Capacity(f"unique{i}", (k,), rows=F.lit(1), applies=given, counts=given))
    out = admit_in_order(df, caps, order, F.lit(0), F.lit(True))
    return out.select(*df.columns, F.col("admitted").alias("accepted"))


def new_documents(incoming: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """Incoming rows whose canonical_url and content_hash are both new, also within the batch."""
    fresh = incoming
    for k in ("canonical_url", "content_hash"):
        fresh = fresh.join(existing.where(F.col(k).isNotNull()).select(k).distinct(), k, "left_anti")
    return accept_in_order(fresh, ["canonical_url", "content_hash"], order).where("accepted").drop("accepted")


def locate_quotes(facts: DataFrame, segments: DataFrame, fact_id: str = "fact_id", doc: str = "doc_id", gram: int = 8, direct: int = 200) -> DataFrame:
    """First segment (page_no, segment_no) of the document containing the quote.

    Exact, else ignoring white space; located_quote is the original substring of
    the segment.  Facts without a match are dropped.

    The distinct quotes of a document travel with its name and are tested on each of its
    segments, so that a segment costs at most `direct` tests and only texts are shuffled.
    In a document with more quotes (all of its segments times all of its quotes would be
    too many) a quote is looked up by that of its pieces of `gram` characters (a shorter
    quote is one piece) which fewest segments have, in an equi join; texts are fetched
    for the segments that have the piece.  The original text is fetched for the first
    match alone.
    """
    f = facts.withColumn("_q", squeeze("source_quote")).where("_q <> ''")
    s = segments.select(doc, "segment_id", "page_no", "segment_no", F.col("text").alias("_seg"), squeeze("text").alias("_sq"))

    def pieces(c, n):  # hashes of all substrings of n characters, overlapping, in one linear scan
        found = F.regexp_extract_all(c, F.concat(F.lit("(?s)(?=(.{"), n.cast("string"), F.lit("}))")), F.lit(1))
        return F.explode(F.array_distinct(F.transform(found, lambda x: F.xxhash64(x))))

    place = F.struct("page_no", "segment_no", "segment_id")
    distinct = f.select(doc, "_q").distinct()
    many = distinct.groupBy(doc).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > direct).select(doc)
    few = distinct.join(many, doc, "left_anti").groupBy(doc).agg(F.collect_list("_q").alias("_few"))
    tested = s.join(few, doc).select(doc, F.explode(F.filter("_few", lambda q: F.contains("_sq", q))).alias("_q"), place.alias("_at"))

    quotes = distinct.join(many, doc, "left_semi").withColumn("_n", F.least(F.length("_q"), F.lit(gram)))
    asked = quotes.select(doc, "_q", "_n", pieces("_q", F.col("_n")).alias("_p"))
    sizes = quotes.select(doc, "_n").distinct()  # at most `gram` lengths of a document
    given = s.join(sizes, doc).select(doc, "segment_id", "_n", pieces("_sq", F.col("_n")).alias("_p"))
    given = given.join(asked.select(doc, "_n", "_p").distinct(), [doc, "_n", "_p"], "left_semi")
    counts = given.groupBy(doc, "_n", "_p").agg(F.count(F.lit(1)).alias("_c"))
    # a piece that no segment has comes first: its quote is nowhere, and the join below drops it
    rarest = asked.join(counts, [doc, "_n", "_p"], "left").groupBy(doc, "_q", "_n").agg(F.min(F.struct(F.coalesce("_c", F.lit(0)).alias("_c"), "_p")).alias("_r"))
    rarest = rarest.where("_r._c > 0").select(doc, "_q", "_n", F.col("_r._p").alias("_p"))
    found = rarest.join(given, [doc, "_n", "_p"]).select(doc, "_q", "segment_id")
    looked_up = found.join(s.drop("_seg"), [doc, "segment_id"]).where(F.contains("_sq", "_q")).select(doc, "_q", place.alias("_at"))
    first = tested.unionByName(looked_up).groupBy(doc, "_q").agg(F.min("_at").alias("_at")).select(doc, "_q", F.col("_at.page_no").alias("_page"), F.col("_at.segment_id").alias("segment_id"))
    best = f.select(doc, "_q", F.struct(*facts.columns).alias("_fact")).join(first, [doc, "_q"]).join(s.select(doc, "segment_id", "_seg"), [doc, "segment_id"])
    kept = [fact_id, *(c for c in facts.columns if c != fact_id)]
    return best.select(
        *[F.col("_fact")[c].alias(c) for c in kept], F.col("segment_id").alias("located_segment"), F.col("_page").alias("located_page"),
        original_span("_seg", F.col("_fact")["source_quote"], "_q").alias("located_quote"),
    )


def original_span(segment, quote, squeezed) -> Column:
    """The quote itself when contained, else the original characters it covers in the segment.

    The squeezed quote becomes a pattern that allows white space between any two
    characters; the first match is the original substring.
    """
    chars = F.filter(F.split(text(squeezed), ""), lambda c: c != "")
    escaped = F.transform(chars, lambda c: F.regexp_replace(c, r"([\\\[\](){}.*+?^$|\-#&~])", r"\\$1"))
    pattern = F.concat(F.lit("(?U)"), F.array_join(escaped, r"\s*"))
    seg, q = text(segment), text(quote)
    return F.when(F.contains(seg, q), q).otherwise(F.regexp_substr(seg, pattern))
