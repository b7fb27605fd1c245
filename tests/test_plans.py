"""Contract, plan shapes, invariance under partitioning, and the order-dependent helpers against plain Python."""
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from noticeboard.functions import classify as C
from noticeboard.operators import filters as P, joins as J, ordered as O

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_contract(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["hot_list", "items_with_engagement", "unique_documents", "traced_facts", "document_sections", "retrieved_evidence", "import_outcomes", "fact_cards", "moderation_states", "temporal_facts", "located_quotes", "gated_candidates"])
def test_no_nested_loops(spark, name):
    p = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_top_k_is_cut_before_the_shuffle(spark):
    for name in ("reading_history", "retrieved_evidence", "newest_per_source"):
        assert "WindowGroupLimit" in plan(entry.queries()[name](spark, SF)), name


def test_scans_read_only_what_they_need(spark):
    p = plan(entry.queries()["crawl_rollup"](spark, SF))
    assert "o_orderdate" not in p.split("ReadSchema")[1]
    p = plan(entry.queries()["visible_items"](spark, SF))
    assert "PushedFilters: [" in p and "o_totalprice" not in p.split("ReadSchema")[1]


@pytest.mark.parametrize("name", ["item_neighbors", "queue_position", "version_chain", "new_documents", "segment_offsets", "latency_percentiles", "document_sections", "fact_cards", "home_feed"])
def test_partitioning_does_not_matter(spark, name, rows):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    one = rows(entry.queries()[name](spark, SF))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    many = rows(entry.queries()[name](spark, SF))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == many


def test_ordered_helpers_with_a_hot_group(spark):
    rnd = random.Random(3)
    data = [("hot" if rnd.random() < 0.7 else f"k{rnd.randrange(5)}", i, rnd.randrange(9)) for i in range(400)]
    rnd.shuffle(data)
    df = spark.createDataFrame(data, "k string, i long, v long").repartition(5)
    want, seen, last = {}, {}, {}
    for k, i, v in sorted(data, key=lambda r: r[1]):
        want[i] = [seen.get(k, 0), last.get(k), None]
        if k in last:
            want[last[k]][2] = i
        seen[k], last[k] = seen.get(k, 0) + v, i
    got = {r.i: r.t for r in O.running_totals(df, ["k"], [F.col("i")], t=F.col("v")).collect()}
    assert got == {i: w[0] for i, w in want.items()}
    got = {r.i: (r.b, r.a) for r in O.neighbours(df, ["k"], [F.col("i")], "i", "b", "a").collect()}
    assert got == {i: (w[1], w[2]) for i, w in want.items()}


def test_first_come_first_served(spark):
    rnd = random.Random(4)
    data = [(i, rnd.choice([None, *range(12)]), rnd.choice([None, *range(12)])) for i in range(60)]
    urls, hashes, want = set(), set(), set()
    for i, u, h in data:
        if (u is None or u not in urls) and (h is None or h not in hashes):
            want.add(i)
            urls.add(u)
            hashes.add(h)
    df = spark.createDataFrame(data, "i long, u int, h int")
    assert {r.i for r in J.accept_in_order(df, ["u", "h"], ["i"]).where("accepted").collect()} == want


def test_large_dictionary(spark):
    texts = ["a quick brown fox", "foxes and quicksand", "", "brow"]
    words = ["fox", "quick", "brown fox", "sand", "zzz"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {tuple(r) for r in C.match_terms(df, spark.createDataFrame([(w,) for w in words], "word string"), "t", "id").collect()}
    assert got == {(i, w) for i, t in enumerate(texts) for w in words if w in t}


def test_candidates_are_cut_per_source(spark):
    df = spark.range(900).selectExpr("id AS pos", "id div 300 AS source_id", "'a title' AS title", "concat('https://a.example.org/', id) AS canonical_url", "cast(null AS string) AS published_time")
    count = lambda n: {r.source_id: r["count"] for r in P.filter_candidates(df, "2026-07-20", ["title"], max_articles=n).groupBy("source_id").count().collect()}
    assert count(120) == {0: 120, 1: 120, 2: 120} and count(None) == {0: 300, 1: 300, 2: 300}
    assert {r.pos for r in P.filter_candidates(df, "2026-07-20", max_articles=2).collect()} == {0, 1, 300, 301, 600, 601}


def test_dictionary_of_all_lengths(spark):
    """Words from one letter up; a short word does not set the join key of the long ones."""
    texts = ["a characteristic fox", "x", "", "internationally", "ab\nabc"]
    words = ["a", "fo", "fox", "characteristic", "inter", "nationally", "b\na", "zz"]
    dictionary = spark.createDataFrame([(w,) for w in words], "word string")
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    want = {(i, w) for i, t in enumerate(texts) for w in words if w in t}
    for lengths in (None, (1, 14)):
        found = C.match_terms(df, dictionary, "t", "id", lengths=lengths)
        assert {tuple(r) for r in found.collect()} == want
        assert "_class" in plan(found)
    turns = spark.read.parquet(f"{SF}/conversations.parquet").selectExpr("conv_id*1000+turn AS turn_id", "text").collect()
    known = {w for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in re.split("[^a-z]+", r.text.lower()) if w}
    counts = {r.turn_id: sum(w in (r.text or "") for w in known) for r in turns}
    assert {r.turn_id: r.words for r in entry.queries()["whole_dictionary_hits"](spark, SF).collect()} == {k: n for k, n in counts.items() if n}
