"""Feeds and sitemaps: guarded XML documents to article candidates.

Input frames have (source_id, page_url, content) plus source_url, the address the
source is registered with.  Bad documents and bad entries become error rows.
"""

from __future__ import annotations

from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.core import left, strip, text
from ..functions.urls import host, normalize_url
from ..operators.ordered import top_per_key

MAX_BYTES = 1024 * 1024
MAX_NODES = 10_000
MAX_DEPTH = 32

_ENTRY = "title string, link string, guid string, pubDate string"
RSS = f"channel struct<item: array<struct<{_ENTRY.replace(' string', ': string')}>>>, item array<struct<{_ENTRY.replace(' string', ': string')}>>"
ATOM = "entry array<struct<title: string, link: array<struct<_href: string, _rel: string>>, published: string, updated: string>>"
URLSET = "url array<struct<loc: string, lastmod: string>>"
SITEMAP_INDEX = "sitemap array<struct<loc: string>>"
_XML = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}


# type objects, not DDL text: modules are imported before there is a session
@F.pandas_udf(T.StructType().add("ok", T.BooleanType()).add("nodes", T.LongType()).add("depth", T.LongType()))
def _xml_shape(content: pd.Series) -> pd.DataFrame:
    def shape(doc):
        counts = [0, 0, 0]  # nodes, open, deepest

        def start(_name, _attrs):
            counts[0] += 1
            counts[1] += 1
            counts[2] = max(counts[2], counts[1])

        def end(_name):
            counts[1] -= 1

        parser = expat.ParserCreate()
        parser.StartElementHandler, parser.EndElementHandler = start, end
        try:
            parser.Parse((doc or "").encode("utf-8"), True)
        except expat.ExpatError:
            return False, 0, 0
        return True, counts[0], counts[2]

    return pd.DataFrame([shape(x) for x in content], columns=["ok", "nodes", "depth"])


def guard_xml(df: DataFrame, column: str = "content") -> DataFrame:
    """Adds xml_error: TOO_LARGE, DTD, MALFORMED, TOO_MANY_NODES, TOO_DEEP or null."""
    size, upper = F.octet_length(column), F.upper(column)
    cheap = F.when(size > MAX_BYTES, "TOO_LARGE").when(
        F.contains(upper, F.lit("<!DOCTYPE")) | F.contains(upper, F.lit("<!ENTITY")), "DTD"
    )
    # refused documents never reach the parser
    checked = df.withColumn("_cheap", cheap).withColumn("_safe", F.when(F.col("_cheap").isNull(), F.col(column)))
    checked = checked.withColumn("_shape", _xml_shape("_safe"))
    return checked.withColumn(
        "xml_error",
        F.coalesce(
            "_cheap",
            F.when(~F.col("_shape.ok"), "MALFORMED").when(F.col("_shape.nodes") > MAX_NODES, "TOO_MANY_NODES")
            .when(F.col("_shape.depth") > MAX_DEPTH, "TOO_DEEP"),
        ),
    ).drop("_cheap", "_safe", "_shape")


def root_name(c) -> Column:
    """Local name of the root element."""
    return F.lower(F.regexp_extract(text(c), r"(?s)^\s*(?:<\?.*?\?>|<!--.*?-->|\s)*<(?:[\w.-]+:)?([\w.-]+)", 1))


@F.pandas_udf(T.StringType())
def resolve_url(url: pd.Series, base: pd.Series) -> pd.Series:
    """Absolute form of a possibly relative reference; null when it cannot be read."""
    from urllib.parse import urljoin

    def one(u, b):
        try:
            return urljoin(b or "", u) if u is not None else None
        except ValueError:
            return None

    return pd.Series([one(u, b) for u, b in zip(url, base)], dtype="object")


def to_candidates(entries: DataFrame, title_chars: int = 300) -> DataFrame:
    """Entries (source_id, source_url, page_url, pos, method, raw_url, title, published) to candidates with an error column."""
    missing = strip("raw_url") == ""
    canonical = normalize_url(resolve_url("raw_url", "page_url"))
    out = entries.withColumn("canonical_url", F.when(~missing, canonical))
    error = (
        F.when(missing, "MISSING_URL").when(F.col("canonical_url").isNull(), "BAD_URL")
        .when(host("canonical_url") != F.coalesce(host("source_url"), F.lit("")), "OTHER_ORIGIN")
    )
    return out.withColumn("error", error).select(
        "source_id", "page_url", "pos", F.when(error.isNull(), F.col("canonical_url")).alias("canonical_url"),
        left(strip("title"), title_chars).alias("title"), F.nullif(strip("published"), F.lit("")).alias("published_time"),
        F.col("method").alias("discovery_method"), F.when(error.isNull(), F.sha2("canonical_url", 256)).alias("dedup_key"), "error",
    )


def _capped(candidates: DataFrame, most: int | None) -> DataFrame:
    """At most so many good entries per document, all if None; error rows stay."""
    if most is None:
        return candidates
    good = top_per_key(candidates.where("error is null"), ["source_id", "page_url"], [F.col("pos")], most)
    return good.unionByName(candidates.where("error is not null"))


def _document_errors(guarded: DataFrame, error: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    return guarded.where(error.isNotNull()).select(
        "source_id", "page_url", F.lit(-1).alias("pos"), none.alias("canonical_url"), F.lit("").alias("title"),
        none.alias("published_time"), none.alias("discovery_method"), none.alias("dedup_key"), error.alias("error"),
    )


def explode_feed(df: DataFrame, max_candidates: int | None = None) -> DataFrame:
    """RSS 2.0 items and Atom entries as candidates; one error row per bad document or entry."""
    guarded = guard_xml(df).withColumn("_root", root_name("content"))
    error = F.coalesce("xml_error", F.when(~F.col("_root").isin("rss", "feed"), "NOT_A_FEED"))
    ok = guarded.where("xml_error is null")
    keep = ["source_id", "source_url", "page_url"]
    rss = ok.where("_root = 'rss'").withColumn("x", F.from_xml("content", F.lit(RSS), _XML))
    items = F.concat(F.coalesce("x.channel.item", F.array()), F.coalesce("x.item", F.array()))
    rss = rss.select(*keep, F.posexplode(items).alias("pos", "e")).select(
        *keep, "pos", F.lit("RSS").alias("method"),
        F.coalesce(F.nullif(strip("e.link"), F.lit("")), strip("e.guid")).alias("raw_url"), F.col("e.title").alias("title"), F.col("e.pubDate").alias("published"),
    )
    atom = ok.where("_root = 'feed'").withColumn("x", F.from_xml("content", F.lit(ATOM), _XML))
    usable = F.filter(
        "e.link", lambda k: (F.coalesce(k["_href"], F.lit("")) != "") & (F.coalesce(k["_rel"], F.lit("alternate")) == "alternate")
    )
    atom = atom.select(*keep, F.posexplode("x.entry").alias("pos", "e")).select(
        *keep, "pos", F.lit("ATOM").alias("method"), F.try_element_at(usable, F.lit(1))["_href"].alias("raw_url"),
        F.col("e.title").alias("title"), F.coalesce(F.nullif(strip("e.published"), F.lit("")), F.col("e.updated")).alias("published"),
    )
    return _capped(to_candidates(rss.unionByName(atom)), max_candidates).unionByName(_document_errors(guarded, error))


def sitemap_children(df: DataFrame, max_children: int | None = None) -> DataFrame:
    """Distinct same-origin children of sitemap indexes (of the first max_children, if given), error rows for other ones."""
    ok = guard_xml(df).where("xml_error is null").where(root_name("content") == "sitemapindex")
    entries = ok.withColumn("x", F.from_xml("content", F.lit(SITEMAP_INDEX), _XML)).select(
        "source_id", "source_url", "page_url", F.posexplode("x.sitemap").alias("pos", "e")
    ).select(
        "source_id", "source_url", "page_url", "pos", F.lit("SITEMAP").alias("method"), F.col("e.loc").alias("raw_url"),
        F.lit("").alias("title"), F.lit("").alias("published"),
    )
    found = to_candidates(entries)
    good = _capped(found.where("error is null"), max_children)
    first = top_per_key(good, ["source_id", "page_url", "canonical_url"], [F.col("pos")], 1)
    return first.unionByName(found.where("error is not null"))


def explode_sitemap(df: DataFrame, fetched: DataFrame | None = None, max_candidates: int | None = None, max_children: int | None = None) -> DataFrame:
    """urlset entries as candidates; with fetched (url, content) one extra level below sitemap indexes."""
    level = df
    if fetched is not None:
        children = sitemap_children(df, max_children).where("error is null").select("source_id", F.col("page_url").alias("_parent"), F.col("canonical_url").alias("url"))
        below = children.join(fetched, "url").join(
            df.select("source_id", F.col("page_url").alias("_parent"), "source_url"), ["source_id", "_parent"]
        ).select("source_id", "source_url", F.col("url").alias("page_url"), "content")
        level = df.select("source_id", "source_url", "page_url", "content").unionByName(below)
    guarded = guard_xml(level).withColumn("_root", root_name("content"))
    error = F.coalesce("xml_error", F.when(~F.col("_root").isin("urlset", "sitemapindex"), "NOT_A_SITEMAP"))
    urls = guarded.where("xml_error is null and _root = 'urlset'").withColumn("x", F.from_xml("content", F.lit(URLSET), _XML))
    entries = urls.select("source_id", "source_url", "page_url", F.posexplode("x.url").alias("pos", "e")).select(
        "source_id", "source_url", "page_url", "pos", F.lit("SITEMAP").alias("method"), F.col("e.loc").alias("raw_url"),
        F.lit("").alias("title"), F.col("e.lastmod").alias("published"),
    )
    return _capped(to_candidates(entries), max_candidates).unionByName(_document_errors(guarded, error))
