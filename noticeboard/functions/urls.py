"""URL functions and link scoring."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import vocab as V
from .core import col, collapse, left, strip, text

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?([^/?#:@]+)(?::(\d+))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def scheme(u) -> Column:
    return F.lower(F.regexp_extract(strip(u), _URL, 1))


def host(u) -> Column:
    """Lower-case host, null when there is none."""
    return F.nullif(F.lower(F.regexp_extract(strip(u), _URL, 3)), F.lit(""))


def path(u) -> Column:
    return F.regexp_extract(strip(u), _URL, 5)


def query(u) -> Column:
    return F.regexp_extract(strip(u), _URL, 6)


def normalize_url(u) -> Column:
    """Canonical absolute http(s) URL, null when not allowed (other scheme, user info, no host).

    Lower-case scheme and host, no default port, no path parameters, no fragment,
    single slashes; the query is kept.
    """
    raw = strip(u)
    sch, user, hst = F.lower(F.regexp_extract(raw, _URL, 1)), F.regexp_extract(raw, _URL, 2), host(raw)
    port = F.regexp_extract(raw, _URL, 4)
    default_port = ((sch == "http") & (port == "80")) | ((sch == "https") & (port == "443")) | (port == "")
    pth = F.regexp_replace(path(raw), r";[^/]*$", "")
    pth = F.regexp_replace(F.when(pth == "", F.lit("/")).otherwise(pth), "/{2,}", "/")
    q = query(raw)
    ok = sch.isin("http", "https") & hst.isNotNull() & (user == "")
    return F.when(
        ok,
        F.concat(
            sch, F.lit("://"), hst,
            F.when(default_port, F.lit("")).otherwise(F.concat(F.lit(":"), port)),
            pth,
            F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)),
        ),
    )


def dedup_key(u) -> Column:
    return F.sha2(normalize_url(u), 256)


def safe_url(u, max_length: int = 1000) -> Column:
    """URL without user info and fragment; empty when it cannot be read."""
    raw = F.trim(col(u))
    sch, hst = F.regexp_extract(raw, _URL, 1), F.regexp_extract(raw, _URL, 3)
    port, q = F.regexp_extract(raw, _URL, 4), F.regexp_extract(raw, _URL, 6)
    built = F.concat(
        sch, F.lit("://"), hst,
        F.when(port == "", F.lit("")).otherwise(F.concat(F.lit(":"), port)),
        F.regexp_extract(raw, _URL, 5),
        F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)),
    )
    return F.when(raw.isNull(), F.lit(None).cast("string")).otherwise(
        F.when(hst == "", F.lit("")).otherwise(left(built, max_length))
    )


def host_allowed(host_col: Column, domain: Column, allowed_hosts: Column) -> Column:
    """Host equals, or is below, the domain or one of the allowed hosts (separated list)."""
    h = F.lower(host_col)

    def within(d):
        return (h == d) | F.endswith(h, F.concat(F.lit("."), d))

    others = F.filter(F.split(F.lower(text(allowed_hosts)), r"[,，;；\s]+"), lambda x: F.trim(x) != "")
    return F.coalesce(within(F.lower(F.trim(domain))) | F.exists(others, within), F.lit(False))


def _has_query_key(q: Column, keys: list[str]) -> Column:
    return F.rlike(q, F.lit("(?i)(?:^|&)(?:" + "|".join(keys) + ")(?:=|&|$)"))


def article_link_score(url, title, page_url) -> Column:
    """How article-like a link is; links scoring 10 or more are kept."""
    p, q = F.lower(path(url)), query(url)
    shown = collapse(title)
    article_key = _has_query_key(q, V.ARTICLE_QUERY_KEYS)
    return (
        F.when(F.rlike(p, F.lit(V.ARTICLE_PATH)), 60).otherwise(0)
        + F.when(article_key, 50).otherwise(0)
        + F.when(F.rlike(p, F.lit(V.DATED_PATH)), 30).otherwise(0)
        + F.when(F.rlike(p, F.lit(r"\.(html|htm|shtml|pdf)$")), 8).otherwise(0)
        + F.when(F.length(shown) >= 8, 10).otherwise(0)
        + F.when(F.startswith(p, F.lit("/service")) & (F.length(shown) >= 6), 15).otherwise(0)
        - F.when(F.lower(shown).isin(V.NAVIGATION_TITLES) | (F.length(shown) <= 2), 80).otherwise(0)
        - F.when(F.rlike(p, F.lit(V.DIRECTORY_PATH)), 55).otherwise(0)
        - F.when(_has_query_key(q, V.DIRECTORY_QUERY_KEYS) & ~article_key, 55).otherwise(0)
        - F.when((path(url) == path(page_url)) & (q == query(page_url)), 100).otherwise(0)
    )


def account_hints(html, page_host, shared_host: str = V.ACCOUNT_HOST, patterns: dict | None = None) -> Column:
    """Struct of account hints from raw HTML of one shared host; null fields elsewhere."""
    on_host = F.lower(text(page_host)) == shared_host
    fields = []
    for name, alternatives in (patterns or V.ACCOUNT_HINT_PATTERNS).items():
        found = []
        for p in alternatives:
            value = collapse(F.regexp_replace(F.regexp_extract(text(html), "(?is)" + p, 1), "<[^>]+>", " "))
            found.append(F.nullif(value, F.lit("")))
        fields.append(F.when(on_host, F.coalesce(*found)).alias(name))
    return F.struct(*fields)
