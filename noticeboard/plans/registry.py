"""Registered queries and how the platform's tables are derived from the given ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The few spellings in which the two SQL dialects differ.
_SPARK = {"@TS": "timestamp_ntz", "@K(props)": "cast(get_json_object(props, '$.k') as bigint)"}
_DUCK = {"@TS": "timestamp", "@K(props)": "cast(json_extract_string(props, '$.k') as bigint)"}


def _spell(expr: str, table: dict[str, str]) -> str:
    for k, v in table.items():
        expr = expr.replace(k, v)
    return expr


@dataclass(frozen=True)
class Role:
    """A platform table as a projection of a given table; expressions are valid in both dialects."""

    table: str
    columns: dict[str, str]
    where: str = ""

    def __call__(self, spark: SparkSession, directory: str) -> DataFrame:
        df = load(spark, directory, self.table)
        if self.where:
            df = df.where(_spell(self.where, _SPARK))
        return df.selectExpr(*[f"{_spell(e, _SPARK)} AS {n}" for n, e in self.columns.items()])

    @property
    def sql(self) -> str:
        cols = ", ".join(f"{_spell(e, _DUCK)} AS {n}" for n, e in self.columns.items())
        tail = f" WHERE {_spell(self.where, _DUCK)}" if self.where else ""
        return f"(SELECT {cols} FROM {self.table}{tail})"


def query(name: str, sql: str | None = None):
    """Register a query, with its oracle when SQL can express it."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


# ------------------------------------------------------------------- roles ---
_STATUS_OF_LENGTH = (
    "case when n_chars < 400 then 'FAILED' when n_chars < 800 then 'WAITING_REVIEW' when n_chars < 1500 then 'REVIEWED' "
    "when n_chars < 2500 then 'UPLOADED' when n_chars < 4000 then 'PROCESSING' when n_chars < 8000 then 'PUBLISHED' else 'WITHDRAWN' end"
)

ITEMS = Role("orders", {
    "id": "o_orderkey",
    "document_id": "o_orderkey",
    "slug": "concat(case when o_orderstatus = 'F' then 'news-' else 'guide-' end, cast(o_orderkey as string))",
    "title": "concat(o_orderpriority, ' notice ', cast(o_orderkey as string))",
    "summary": "concat('customer ', cast(o_custkey as string))",
    "category": "substr(o_orderpriority, 3)",
    "content_kind": "case when o_totalprice > 400000 then 'SERVICE_NOTICE' when o_totalprice > 300000 then 'POLICY_NEWS' else '' end",
    "publish_channel": "case substr(o_orderpriority, 1, 1) when '1' then 'HEALTH' when '2' then 'FRAUD' when '3' then 'MEALS' when '4' then 'ELDERLY' else 'COMMUNITY' end",
    "status": "case when o_orderstatus = 'P' then 'WITHDRAWN' else 'PUBLISHED' end",
    "pinned": "o_orderpriority = '1-URGENT'",
    "importance": "cast(floor(o_totalprice / 5000) as int)",
    "published_at": "o_orderdate",
    "expires_at": "case when o_orderstatus = 'O' then o_orderdate end",
    "deadline_at": "case when o_totalprice < 100000 then o_orderdate end",
    "source_name": "concat('source ', substr(cast(o_custkey as string), 1, 1))",
    "source_url": "case when o_totalprice < 50000 then '' else concat('https://www.example.org/', cast(o_orderkey as string)) end",
    "cover_image_url": "case when o_totalprice > 250000 then concat('https://img.example.org/', cast(o_orderkey as string)) end",
    "cover_image_type": "case when o_totalprice > 450000 then 'ORIGINAL_COVER' when o_totalprice > 350000 then 'ARTICLE_IMAGE' else 'CATEGORY_DEFAULT' end",
    "last_verified_at": "o_orderdate",
    "promote_to_recommend": "o_orderpriority = '2-HIGH'",
    "is_local": "o_orderstatus = 'O'",
    "is_read": "o_orderpriority = '5-LOW'",
    "custkey": "o_custkey",
})

PARTS = Role("part", {
    "id": "p_partkey",
    "document_id": "p_partkey",
    "slug": "concat('news-', cast(p_partkey as string))",
    "title": "p_name",
    "summary": "concat(p_name, ' by ', p_brand)",
    "category": "p_brand",
    "publish_channel": "p_type",
    "status": "case when p_type = 'PROMO' then 'WITHDRAWN' else 'PUBLISHED' end",
    "pinned": "p_size = 50",
    "importance": "p_size",
    "published_at": "cast(cast('2024-01-01' as date) + p_size as @TS)",
    "expires_at": "case when p_type = 'SMALL' then cast(cast('2024-01-01' as date) + p_size as @TS) end",
})

EVENTS = Role("events", {
    "event_id": "event_id",
    "ts": "ts",
    "created_at": "ts",
    "user_id": "user_id",
    "visitor_id": "concat('visitor-', cast(user_id as string))",
    "item_id": "@K(props)",
    "event_type": "case event_type when 'view' then 'VIEW' when 'click' then 'LIKE' when 'purchase' then 'FAVORITE' when 'signup' then 'REMINDER' else 'CONTENT_LISTEN' end",
    "value": "value",
})

DOCS = Role("documents", {
    "id": "doc_id",
    "document_id": "doc_id",
    "title": "concat(source, ' ', lang)",
    "text": "text",
    "source_name": "source",
    "lang": "lang",
    "n_chars": "n_chars",
    "source_type": "case lang when 'en' then 'WEB_ARTICLE' when 'fr' then 'PDF' when 'de' then 'IMAGE' else 'MANUAL' end",
    "content_kind": "case when n_chars > 2000 then 'POLICY_NEWS' else 'SERVICE_NOTICE' end",
    "processing_status": _STATUS_OF_LENGTH,
    "status": _STATUS_OF_LENGTH,
    "custom_cover_path": "case when n_chars > 1000 then 'cover' end",
    "cover_image_type": "case when n_chars > 3000 then 'CATEGORY_DEFAULT' else 'EDITOR_UPLOAD' end",
})

CRAWL_JOBS = Role("orders", {
    "id": "o_orderkey",
    "document_id": "o_custkey",
    "source_registry_id": "o_custkey",
    "canonical_url": "concat('https://www.example.org/', cast(o_custkey as string))",
    "status": "case o_orderstatus when 'F' then 'SUCCESS' when 'O' then 'PENDING' else 'FAILED' end",
    "trigger_type": "case when o_totalprice > 300000 then 'RETRY' else 'SCHEDULED' end",
    "discovered_at": "o_orderdate",
    "discovered_count": "cast(floor(o_totalprice / 10000) as bigint)",
    "added_count": "cast(floor(o_totalprice / 20000) as bigint)",
    "duplicate_count": "cast(floor(o_totalprice / 40000) as bigint)",
    "failed_count": "case when o_orderstatus = 'P' then cast(1 as bigint) else cast(0 as bigint) end",
    "skipped_count": "cast(floor(o_totalprice / 100000) as bigint)",
    "duration_ms": "cast(floor(o_totalprice) as bigint) - 100000",
    "retry_count": "cast(substr(o_orderpriority, 1, 1) as int)",
})

REGISTRY = Role("supplier", {
    "id": "s_suppkey",
    "source_id": "s_suppkey",
    "source_name": "s_name",
    "domain": "concat('s', cast(s_suppkey as string), '.example.org')",
    "enabled": "s_acctbal > 2000",
    "allow_auto_crawl": "s_acctbal < 9000",
    "allow_auto_ai": "s_acctbal < 7000",
    "daily_token_budget": "cast(floor(s_acctbal) as bigint)",
    "daily_article_budget": "cast(floor(s_acctbal / 1000) as bigint)",
    "max_retries": "cast(floor(s_acctbal / 2500) as int)",
    "nationkey": "s_nationkey",
})

# many rows per document and per source
JOBS = Role("lineitem", {
    "id": "l_orderkey * 100000 + l_partkey * 10 + l_linenumber",
    "document_id": "l_orderkey",
    "source_id": "l_suppkey",
    "part_id": "l_partkey",
    "status": "case l_returnflag when 'A' then 'SUCCEEDED' when 'N' then 'PROCESSING' else 'WAITING_BUDGET' end",
    "stage": "case l_linestatus when 'O' then 'QUEUED' else 'REWRITE' end",
    "job_type": "case when l_discount < 0.08 then 'FULL_PIPELINE' else 'REWRITE_ONLY' end",
    "progress": "cast(floor(l_quantity * 2) as int)",
    "started_at": "l_shipdate",
    "updated_at": "l_shipdate",
    "elapsed_ms": "cast(floor(l_extendedprice) as bigint)",
    "estimated_tokens": "cast(floor(l_extendedprice / 10) as bigint)",
    "actual_tokens": "cast(floor(l_quantity) as bigint)",
    "price": "l_extendedprice",
})

TURNS = Role("conversations", {
    "conv_id": "conv_id",
    "turn": "turn",
    "role": "role",
    "text": "text",
    "turn_id": "conv_id * 1000 + turn",
})

PAGES = Role("pages", {"page_id": "page_id", "url": "url", "html": "html"})
