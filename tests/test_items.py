"""Order, neighbours, regions, directory, metrics, feeds on published rows."""
import datetime as dt

from pyspark.sql import functions as F

from noticeboard.functions import regions as R
from noticeboard.operators import aggregates as A, filters as P, joins as J, ranking as W

T = dt.datetime
ITEMS = [
    (1, "pinned", "A", True, 10, T(2026, 7, 20, 10), None, "PUBLISHED"), (2, "important", "B", False, 90, T(2026, 7, 24, 10), None, "PUBLISHED"),
    (3, "same-newer-id", "A", False, 50, T(2026, 7, 23, 10), None, "PUBLISHED"), (4, "same-older-id", "B", False, 50, T(2026, 7, 23, 10), None, "PUBLISHED"),
    (5, "withdrawn", "A", True, 100, T(2026, 7, 25, 10), None, "WITHDRAWN"),
]
SCHEMA = "id long, slug string, category string, pinned boolean, importance int, published_at timestamp_ntz, expires_at timestamp_ntz, status string"
EV = "item_id long, event_type string"


def live(spark, events=()):
    ev = spark.createDataFrame(list(events), EV)
    out = J.with_engagement(spark.createDataFrame(ITEMS, SCHEMA), ev, ev.where("event_type='FAVORITE'"), ev.where("event_type='REMINDER'"))
    return out.withColumn("hot_score", W.hot_score()).where("status = 'PUBLISHED'")


def test_business_order(spark):
    assert [r.slug for r in live(spark).orderBy(*W.business_order()).collect()] == ["pinned", "important", "same-older-id", "same-newer-id"]
    boosted = live(spark, [(3, "FAVORITE")] * 20 + [(3, "VIEW")])
    assert [r.id for r in boosted.orderBy(*W.business_order()).collect()] == [1, 3, 2, 4]
    assert boosted.where("id = 3").first().hot_score == 250 + 3 + 240


def test_neighbours(spark):
    assert {r.id: (r.previous_id, r.next_id) for r in W.neighbor_items(live(spark), False).collect()} == {1: (None, 2), 2: (1, 4), 4: (2, 3), 3: (4, None)}
    # same category first, any category where there is none in that direction
    assert {r.id: (r.previous_id, r.next_id) for r in W.neighbor_items(live(spark)).collect()} == {1: (None, 3), 2: (1, 4), 4: (2, 3), 3: (1, None)}


def test_expiry_is_inclusive(spark):
    rows = [(i, str(i), "A", False, 1, T(2026, 1, 1), e, "PUBLISHED") for i, e in enumerate((None, T(2026, 7, 1), T(2026, 6, 30, 23)))]
    assert [r.id for r in P.visible(spark.createDataFrame(rows, SCHEMA), "2026-07-01 00:00:00").collect()] == [0, 1]


def test_like_wildcards(spark):
    df = spark.createDataFrame([("a_b", "", ""), ("axb", "", ""), ("AxB", "", "")], "title string, summary string, category string")
    assert P.search(df, " a_b ").count() == 2


def test_regions(spark):
    rows = [("town a", "S", "S", "B", "A", "1", "LOCAL_TOWN"), ("town b", "S", "S", "B", "C", "2", "LOCAL_TOWN"), ("district", "S", "S", "B", "", "", "DISTRICT_SHARED"),
            ("city", "S", "S", "", "", "", "CITY_SHARED"), ("national", "全国", "", "", "", "", "NATIONAL_SHARED"), ("none", "S", "S", "B", "A", "1", "UNCLASSIFIED"), ("other", "S", "S", "X", "", "", "DISTRICT_SHARED")]
    df = spark.createDataFrame(rows, "slug string, province string, city string, district string, street_or_town string, region_code string, local_scope string")
    assert {r.slug for r in df.where(R.in_region({"code": "1", "district": "B", "city": "S"})).collect()} == {"town a", "district", "city", "national"}
    q = spark.createDataFrame([("顾村镇的活动", ""), ("活动", " "), ("活动", "999")], "t string, c string")
    got = [r[0] for r in q.select(R.region_of("t", "c", [("310113102", "大场镇"), ("310113109", "顾村镇")])).collect()]
    assert got == ["310113109", "310113102", None]


def test_directory_does_not_invent(spark):
    items = spark.createDataFrame([(1, 10, "t", "c", "s", "PUBLISHED", None, "r", "https://x", "n", T(2026, 1, 1)), (2, 11, "t", "c", "s", "PUBLISHED", None, "r", " ", "n", T(2026, 1, 1))][:1],
                                  "id long, document_id long, title string, category string, summary string, status string, expires_at timestamp_ntz, region_code string, source_url string, source_name string, last_verified_at timestamp_ntz")
    fields = spark.createDataFrame([(10, "LOCATION", "1 road", "CONFIRMED"), (10, "CONTACT", "5", "REJECTED")], "document_id long, field_type string, field_value string, review_status string")
    r = A.service_directory(items, fields, "r", "2026-07-01 00:00:00").first()
    assert (r.address, r.phone, r.source_url) == ("1 road", None, "https://x")


def test_rates_and_percentiles(spark):
    df = spark.createDataFrame([("a", v) for v in range(1, 31)] + [("b", 7)], "k string, v long")
    assert {r.k: (r.p50, r.p95, r.p99, r.max) for r in A.latency(df, "k", "v").collect()} == {"a": (15, 29, 30, 30), "b": (7, 7, 7, 7)}
    assert spark.range(1).select(A.rate(F.lit(1), F.lit(3)), A.rate(F.lit(1), F.lit(0))).first()[:] == (33.3, 0.0)


def test_snapshot_has_one_row_per_day(spark, tmp_path):
    from noticeboard.sources import sinks

    path = str(tmp_path / "snap")
    for n, day in ((1, "2026-07-01"), (2, "2026-07-02"), (3, "2026-07-01")):
        sinks.write_snapshot(spark.range(n).agg(F.count("*").alias("n")), day, path)
    assert {str(r.snapshot_date): r.metrics_json for r in spark.read.parquet(path).collect()} == {"2026-07-01": '{"n":3}', "2026-07-02": '{"n":2}'}


def test_fixture_scan(spark, tmp_path):
    import json

    import pytest

    from noticeboard.sources import fixtures

    row = {f: "x" for f in fixtures.FIELDS} | {"publishedAt": "2026-07-01"}
    good, bad = tmp_path / "g.json", tmp_path / "b.json"
    good.write_text(json.dumps([row], indent=1))
    bad.write_text(json.dumps([row | {"body": " "}]))
    assert fixtures.read_fixture(spark, str(good)).first().publishedAt == T(2026, 7, 1)
    with pytest.raises(Exception, match="body"):
        fixtures.read_fixture(spark, str(bad)).collect()
