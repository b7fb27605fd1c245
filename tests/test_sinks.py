"""Sinks, stored JSON and idempotent inserts."""
import datetime as dt

from pyspark.sql import functions as F

from noticeboard.operators import dedup as D, filters as P
from noticeboard.sources import sinks as S

T0 = dt.datetime(2026, 7, 1, 10)


def test_events_are_checked_and_appended(spark, tmp_path):
    ev = spark.createDataFrame([(1, "view", "visitor-1", 1, T0), (2, "VIEW", "visitor-1", 2, T0), (3, " content_listen ", "v", 9, T0 + dt.timedelta(days=1)), (4, "CONTENT_LISTEN", " ", 1, T0), (5, "OTHER", "v", 1, T0)],
                               "event_id long, event_type string, visitor_id string, item_id long, created_at timestamp_ntz")
    items = spark.createDataFrame([(1, "PUBLISHED"), (2, "WITHDRAWN")], "id long, status string")
    path = str(tmp_path / "ev")
    S.append_events(P.valid_events(ev, items), path)
    S.append_events(P.valid_events(ev.where("event_id = 1"), items), path)
    back = spark.read.parquet(path)
    assert sorted((r.event_id, r.event_type, str(r.event_date)) for r in back.collect()) == [(1, "VIEW", "2026-07-01"), (1, "VIEW", "2026-07-01"), (3, "CONTENT_LISTEN", "2026-07-02")]


def test_documents_append_by_domain(spark, tmp_path):
    path = str(tmp_path / "docs")
    df = spark.createDataFrame([("a.org", "x"), ("b.org", "y")], "source_domain string, text string")
    S.write_documents(df, path)
    S.write_documents(df.where("source_domain = 'a.org'"), path)
    assert spark.read.parquet(path).where("source_domain = 'a.org'").count() == 2


def test_seeds(spark, tmp_path):
    rows = spark.createDataFrame([("a", "s", 2), ("a", "s", 1), ("b", "s", 3)], "domain string, section_url string, n int")
    path = str(tmp_path / "reg")
    S.insert_if_absent(rows.where("domain = 'b'"), rows.limit(0), ["domain", "section_url"], path)
    for _ in range(2):
        S.insert_if_absent(rows, spark.read.parquet(path), ["domain", "section_url"], path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", "s", 1), ("b", "s", 3)]


def test_stored_json(spark):
    g = spark.createDataFrame([(1, 1, "SUMMARY", '["a"]', "p"), (1, 2, "STEPS", "{bad", "plain"), (1, 3, "STEPS", None, "newer")], "document_id long, id long, content_type string, content_json string, plain_text string")
    assert sorted((r.content_type, r.value) for r in S.decode_generated(g).collect()) == [("ACCESSIBLE_TEXT", "p"), ("STEPS", "newer"), ("SUMMARY", '["a"]')]
    assert spark.range(1).select(S.benefits(F.lit('["x","y"]')), S.benefits(F.lit("no"))).first()[:] == (["x", "y"], [])


def test_version_changes(spark):
    cur = spark.createDataFrame([(1, "u1", "h1", "old text", "PUBLISHED", 1, 1), (2, "u2", "h2", "b", "REVIEWED", 2, 1), (3, "u3", "h3", "c", "REVIEWED", 3, 1), (4, "u4", "h4", "d", "PUBLISHED", 4, 3)],
                                "id long, canonical_url string, content_hash string, text string, status string, root_id long, version_no long")
    inc = spark.createDataFrame([("u1", "n1", "new text!"), ("u2", "n2", "x"), ("u3", "h4", "d"), ("u4", "h4", "d"), ("u9", "n9", "z")], "canonical_url string, content_hash string, text string")
    got = {r.id: r for r in D.version_changes(inc, cur).collect()}
    assert {k: r.action for k, r in got.items()} == {1: "NEW_VERSION", 2: "REPLACED", 3: "DUPLICATE", 4: "UNCHANGED"}
    assert got[1].version_no == 2 and got[1].previous_version_id == 1 and got[1].verification_status == "REVIEW_REQUIRED" and "+1 字" in got[1].change_summary
    assert got[2].document_status == "UPLOADED" and got[2].version_no == 1


def test_import_batch(spark):
    urls = spark.createDataFrame([(1, "u1", "h1", False, None), (2, "u1", "h9", False, None), (3, "u3", "h1", False, None), (4, "old", "h4", False, None), (5, "u5", None, True, 400), (6, "u6", None, True, 502), (7, "u7", "h7", False, None)],
                                 "id long, canonical_url string, content_hash string, failed boolean, error_code int")
    out = D.import_batch(urls, spark.createDataFrame([("old", "x")], "canonical_url string, content_hash string"), ["id"])
    assert [(r.id, r.outcome, r.retryable) for r in out.orderBy("id").collect()] == [
        (1, "added", False), (2, "duplicate", False), (3, "duplicate", False), (4, "duplicate", False), (5, "failed", False), (6, "failed", True), (7, "added", False)]
    t = D.batch_totals(out).first()
    assert (t.added, t.duplicate, t.failed, t.status) == (2, 3, 2, "PARTIAL_SUCCESS")
