"""Columns a document gets when it is published."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .core import col, is_blank, strip, text


def slug(source_type, doc_id) -> Column:
    return F.concat(F.when(text(source_type) == "WEB_ARTICLE", "news-").otherwise("guide-"), col(doc_id).cast("string"))


def importance_of_level(level) -> Column:
    name = F.upper(strip(level))
    return F.when(name == "URGENT", 100).when(name == "IMPORTANT", 85).otherwise(60)


def is_local(region_code, source_domain, suffix: str) -> Column:
    return ~is_blank(region_code) | F.endswith(text(source_domain), F.lit(suffix))
