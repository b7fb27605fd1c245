"""Administrative regions: visibility predicate, mention, scope derivation and normalising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import vocab as V
from .core import col, is_blank, strip, text


def region_dim(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows or V.REGIONS, "province string, city string, district string, town string, code string")


def in_region(
    region: dict, province="province", city="city", district="district", town="street_or_town",
    code="region_code", scope="local_scope", national: str = V.NATIONAL_PROVINCE,
) -> Column:
    """Is a row visible in the region?  region has the keys code, district and city (values or Columns).

    Four arms: the town itself, shared by its district, by its city, or national.
    Unclassified rows never match.
    """

    def val(key):
        v = region[key]
        return v if isinstance(v, Column) else F.lit(v)

    sc = text(scope)
    return (
        ((text(code) == val("code")) & sc.isin(V.TOWN_SCOPES))
        | ((sc == "DISTRICT_SHARED") & (text(district) == val("district")) & (text(town) == ""))
        | (sc.isin("CITY_SHARED", "CITY") & (text(city) == val("city")) & (text(district) == ""))
        | (sc.isin("NATIONAL_SHARED", "NATIONAL") & text(province).isin("", national))
    )


def region_code_or_default(c, default: str = V.DEFAULT_REGION_CODE) -> Column:
    return F.when(is_blank(c), F.lit(default)).otherwise(F.trim(col(c)))


def region_mentioned(c, regions: list[tuple[str, str]]) -> Column:
    """Code of the first registered (code, town) whose town occurs in the text, else null."""
    return F.coalesce(
        *[F.when(F.contains(text(c), F.lit(town)), F.lit(code)) for code, town in regions], F.lit(None).cast("string")
    )


def region_of(question, code, regions: list[tuple[str, str]], default: str = V.DEFAULT_REGION_CODE) -> Column:
    """Region of a question: mentioned, else given, else default; null when the given one is unknown."""
    given = region_code_or_default(code, default)
    return F.coalesce(region_mentioned(question, regions), F.when(given.isin([c for c, _ in regions]), given))


def local_scope(province="province", city="city", district="district", town="street_or_town") -> Column:
    """Most specific level that is filled in."""
    return (
        F.when(~is_blank(town), "STREET").when(~is_blank(district), "DISTRICT").when(~is_blank(city), "CITY")
        .when(~is_blank(province), "PROVINCE").otherwise("UNSPECIFIED")
    )


def upgrade_scope(scope, code) -> Column:
    """Legacy aliases to the current vocabulary."""
    s = col(scope)
    return (
        F.when(s.isin("LOCAL", "TOWN", "STREET") & col(code).isNotNull(), "LOCAL_TOWN")
        .when(s == "UNSPECIFIED", "UNCLASSIFIED").otherwise(s)
    )


def normalize_scope(
    df: DataFrame, district_name: str, city_name: str, town_codes: list[str], national: str = V.NATIONAL_PROVINCE,
    codes: dict | None = None,
) -> DataFrame:
    """Blank the levels a scope must not carry, set its code; scope_error tells why a row is refused."""
    codes = codes or V.SHARED_CODES
    scope = F.upper(strip("local_scope"))
    known = ["LOCAL_TOWN", "DISTRICT_SHARED", "CITY_SHARED", "NATIONAL_SHARED", "UNCLASSIFIED"]
    district, city, code = text("district"), text("city"), text("region_code")
    error = (
        F.when(~scope.isin(known), "UNKNOWN_SCOPE")
        .when((scope == "LOCAL_TOWN") & ~((district == district_name) & code.isin(town_codes)), "TOWN_NOT_REGISTERED")
        .when((scope == "DISTRICT_SHARED") & (district != district_name), "DISTRICT_MISMATCH")
        .when((scope == "CITY_SHARED") & (city != city_name), "CITY_MISMATCH")
    )

    def keep(c, *scopes):
        return F.nullif(F.when(scope.isin(*scopes), text(c)).otherwise(F.lit("")), F.lit(""))

    local, shared, wide = "LOCAL_TOWN", "DISTRICT_SHARED", "CITY_SHARED"
    return df.select(
        *[c for c in df.columns if c not in ("province", "city", "district", "street_or_town", "region_code", "local_scope")],
        F.when(scope == "NATIONAL_SHARED", F.lit(national)).otherwise(keep("province", local, shared, wide)).alias("province"),
        keep("city", local, shared, wide).alias("city"),
        keep("district", local, shared).alias("district"),
        keep("street_or_town", local).alias("street_or_town"),
        F.coalesce(
            *[F.when(scope == s, F.lit(c)) for s, c in codes.items()], keep("region_code", local)
        ).alias("region_code"),
        scope.alias("local_scope"),
        error.alias("scope_error"),
    )
