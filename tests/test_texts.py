"""Queries over texts that have the signs the queries themselves put in."""
import pyarrow as pa

import __spark_entry__ as entry
from noticeboard.functions import extract as E, texts as T, vocab as V
from noticeboard.sources import pages as P


def test_prefix_similarity_of_a_text_with_the_separator(spark, tmp_path):
    texts = ["abc#defghi", "abcdefghi", "##", "###", "", "abc$#efgh#"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'src1' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.similarity) for r in entry.queries()["prefix_similarity"](spark, str(tmp_path)).collect())
    half = lambda common, total: int(2000 * common / total + 0.5)
    want = sorted(r for i, t in enumerate(texts) for n in [len(t)] for r in ((i, half(n, 2 * n + 4)), (i, half(n // 3, 2 * n + n // 3 + 1))))
    assert got == want


def test_guide_patterns_are_searched_once(spark):
    alternatives = [take for some in V.GUIDE_PATTERNS.values() for _, take in some]
    groups = sum(0 if isinstance(take, str) else 1 if isinstance(take, int) else len(take) for take in alternatives)
    assert str(E.guide_fields("t")).count("regexp_extract(") == len(alternatives) + groups


def test_pages_are_parsed_in_slices():
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(9)), "url": ["u"] * 9, "html": ["x" * n if n is not None else None for n in (5, 5, 5, 40, None, 0, 9, 2, 1)]})
    parts = list(P._parts(batch, 10))
    assert [p.num_rows for p in parts] == [2, 1, 1, 3, 2] and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert list(P._parts(batch.slice(0, 0))) == []


def test_clauses_of_warnings_are_made_once(spark):
    assert str(T.dedup_warnings("v")).count("split(") == 1
    assert entry.queries()["distinct_warnings"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
