"""Queries of the subpackage by name, with DuckDB oracles where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    decontamination, exact_dedup, html_blocks, jaccard_join, language_id, mixing, prefix_trie, sharding, spelling_variants, substring_dedup, suffix_dedup, surrogates,
    toxicity,
)
from .common import table


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = surrogates.replaced(table(spark, sf_dir, "documents"), SURROGATE_KEY)
    return out.select("doc_id", "text", F.size("_entities").alias("n_entities"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("stay").alias("keep_id"), F.col("n").alias("group_size"), "kept", F.col("sha256").alias("text_sha256"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text_hash", F.xxhash64("text"))
    return mixing.mix(docs, MIX_WEIGHTS, by=("doc_id", "text_hash")).drop("text_hash")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), texts=False).drop("spans")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), texts=False).drop("spans")


def op4_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_blocks.extract(pages, html_blocks.train(html_blocks.sample(pages))).drop("n_blocks", "n_main")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked_documents(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(*language_id.sample(docs)), ["doc_id"])
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")), ["doc_id"], "score")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"))


#: an example; a real key is a secret
SURROGATE_KEY = "example key"

#: every source not named has weight 1
MIX_WEIGHTS = {"src0": 4, "src1": 3, "src2": 2, "src3": 2}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_html_blocks": op4_html_blocks,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_language_id": op6_language_id,
    "op7_toxicity": op7_toxicity,
    "op8_surrogates": op8_surrogates,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_sharding": op12_sharding,
    "op13_spelling_variants": op13_spelling_variants,
}

def _crc(column: str) -> str:
    """DuckDB: unsigned CRC-32 of the bytes in a column; tab.t is the table of 256 remainders."""
    values = f"list_transform(range(1, octet_length({column}) + 1), lambda i: ('0x' || hex({column}[i : i]))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {values}), lambda a, b: xor(a >> 8, tab.t[(xor(a, b) & 255) + 1])))"


_CRC_TABLE = """tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (
            SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) AS c FROM range(256) r(i)))"""

# op1, op10: tests/llm compares them with brute force; op4, op6, op7: held-out accuracy; op8: round trips.
ORACLES: dict[str, str] = {
    "op2_substring_dedup": """
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        win AS (SELECT doc_id, i, md5(list_aggregate(ws[i : i + 34], 'string_agg', ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
        rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM win WHERE h IN (SELECT h FROM rep)),
        marks AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id),
        lost AS (SELECT doc_id, ws, coalesce(ks, []) AS ks FROM w LEFT JOIN marks USING (doc_id)),
        word AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS k FROM w),
        kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.k) AS t FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.k = gone.k GROUP BY word.doc_id)
        SELECT lost.doc_id, len(ws)::BIGINT AS n_words, len(ks)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM lost LEFT JOIN kept USING (doc_id)""",
    "op3_suffix_array_dedup": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
        win AS (SELECT doc_id, i, md5(hex(b[i : i + 399])) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d)),
        rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
        hit AS (SELECT doc_id, i, i - lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM win WHERE h IN (SELECT h FROM rep)),
        run AS (SELECT doc_id, i, sum(CASE WHEN step > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit),
        span AS (SELECT doc_id, r, min(i) AS a, max(i) + 399 AS z FROM run GROUP BY doc_id, r),
        edge AS (SELECT doc_id, r, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM span),
        kept AS (SELECT doc_id, string_agg(hex(b[before + 1 : a - 1]), '' ORDER BY a) AS t, max(z) AS z, sum(z - a + 1) AS gone, count(*) AS spans
                 FROM edge JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
               sha256(unhex(coalesce(t, '') || hex(b[coalesce(z, 0) + 1 :]))) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op5_jaccard_join": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: list_aggregate(ws[i : i + 2], 'string_agg', ' '))
                           WHEN len(ws) > 0 THEN [list_aggregate(ws, 'string_agg', ' ')] ELSE [] END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        meet AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        link AS MATERIALIZED (SELECT a, b FROM meet JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
        reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
        SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce((SELECT min(b) FROM reach WHERE reach.a = w.doc_id), w.doc_id)) AS component_id
        FROM w LEFT JOIN n USING (doc_id)""",
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op11_prefix_trie": f"""
        WITH RECURSIVE {_CRC_TABLE},
        t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
                     {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS item FROM conversations WHERE conv_id IS NOT NULL),
        b AS (SELECT DISTINCT c, encode(c::VARCHAR) AS e FROM t),
        conv AS (SELECT c, {_crc("e")} % 4 AS h FROM b, tab),
        line AS (SELECT conv.c, 0 AS part, t.pos, item FROM conv JOIN t ON t.c = conv.c - conv.c % 20 AND t.pos <= h
                 UNION ALL SELECT conv.c, 1, t.pos, item FROM conv JOIN t ON t.c = conv.c AND t.pos > h),
        path AS (SELECT conv.c, coalesce(items, []) AS items FROM conv LEFT JOIN (SELECT c, list(item ORDER BY part, pos) AS items FROM line GROUP BY c) USING (c)),
        pre AS MATERIALIZED (SELECT c, d, items[1 : d] AS p, len(items) = d AS ends FROM (SELECT c, items, unnest(range(0, len(items) + 1)) AS d FROM path)),
        node AS MATERIALIZED (SELECT d, p, min(c) AS conv_id, count(*) AS n, string_agg(CASE WHEN ends THEN c::VARCHAR END, ',' ORDER BY c) AS ids FROM pre GROUP BY d, p),
        up AS (SELECT a.d, a.p, b.conv_id AS parent FROM node a JOIN node b ON b.d = a.d - 1 AND b.p = a.p[1 : a.d - 1]),
        kids AS (SELECT d - 1 AS d, p[1 : d - 1] AS p, count(*) AS k FROM node WHERE d > 0 GROUP BY 1, 2),
        own AS (SELECT node.*, coalesce(k, 0) AS k, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * len(regexp_extract_all(p[d].text, '[^\\x20\\x09-\\x0D]+')) END AS w FROM node LEFT JOIN kids USING (d, p)),
        total AS (SELECT a, p[1 : a] AS p, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS leaves, sum(w) AS saved FROM (SELECT d, p, k, w, unnest(range(0, d + 1)) AS a FROM own) GROUP BY 1, 2)
        SELECT own.conv_id, own.d AS depth, parent AS parent_conv_id, own.n AS n_convs, own.k AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
        FROM own JOIN total ON total.a = own.d AND total.p = own.p LEFT JOIN up ON up.d = own.d AND up.p = own.p""",
    "op12_sharding": f"""
        WITH RECURSIVE {_CRC_TABLE},
        d AS (SELECT doc_id, encode(coalesce(text, '')) AS e, octet_length(encode(coalesce(text, ''))) + 1 AS size, sha256(coalesce(text, '')) AS k FROM documents),
        g AS MATERIALIZED (SELECT k, sum(size)::BIGINT AS b FROM d GROUP BY k),
        big AS (SELECT k, b, row_number() OVER w AS i, sum(b) OVER w - b AS before, sum(b) OVER () AS total FROM g WINDOW w AS (ORDER BY b DESC, k ROWS UNBOUNDED PRECEDING)),
        own AS (SELECT k, (i - 1)::INT AS shard FROM big WHERE i < (SELECT min(i) FROM big WHERE i >= 16 OR b * (17 - i) <= total - before)),
        rest AS MATERIALIZED (SELECT k, b, sum(b) OVER (ORDER BY k)::BIGINT AS z FROM g WHERE k NOT IN (SELECT k FROM own)),
        ends AS MATERIALIZED (SELECT list(z ORDER BY z) AS zs, max(z) AS total, 16 - (SELECT count(*) FROM own) AS parts FROM rest),
        search(low, high, pos, step) AS (
            SELECT 0::BIGINT, total, 0::BIGINT, 0 FROM ends
            UNION ALL
            SELECT CASE WHEN NOT fits AND step = parts THEN mid ELSE low END, CASE WHEN fits THEN mid ELSE high END,
                   CASE WHEN fits OR step = parts THEN 0 ELSE coalesce(list_max(list_filter(zs, lambda z: z <= pos + mid)), 0) END, CASE WHEN fits OR step = parts THEN 0 ELSE step + 1 END
            FROM (SELECT *, (low + high) // 2 AS mid, step < parts AND pos + (low + high) // 2 >= total AS fits FROM search, ends WHERE high - low > 1)),
        capacity AS MATERIALIZED (SELECT min(high) AS c FROM search),
        cuts(pos) AS (SELECT 0::BIGINT UNION ALL SELECT list_max(list_filter(zs, lambda z: z <= pos + c)) FROM cuts, ends, capacity WHERE pos + c < total),
        placed AS (SELECT k, (SELECT count(*) FROM own) + (SELECT count(*) FROM cuts WHERE pos > 0 AND pos <= z - b) AS shard FROM rest UNION ALL SELECT k, shard FROM own)
        SELECT doc_id, size::BIGINT AS size, {_crc("e")} AS text_crc32, 'bytes' AS law, shard::INT AS shard,
               (row_number() OVER (PARTITION BY shard ORDER BY k, doc_id) - 1)::BIGINT AS slot, NULL::INT AS grown_shard
        FROM d JOIN placed USING (k), tab""",
    "op13_spelling_variants": f"""
        WITH RECURSIVE {_CRC_TABLE},
        run AS (SELECT doc_id::VARCHAR || ':' || r AS s, r, count(*) AS n FROM (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS r FROM documents) GROUP BY 1, 2),
        hashed AS (SELECT r, n, {_crc("e")} AS h FROM (SELECT r, n, encode(s) AS e FROM run), tab),
        word AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (
            SELECT CASE WHEN h % 97 = 0 THEN r[1 : h % length(r)] || r[h % length(r) + 2 :] ELSE r END AS word, n FROM hashed) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        hole AS (SELECT word, i, word[1 : i - 1] || word[i + 1 :] AS v FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM word)),
        pair AS (SELECT a.word AS a, b.word AS b FROM hole a JOIN hole b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
                 UNION SELECT v, hole.word FROM hole JOIN word ON word.word = v UNION SELECT hole.word, v FROM hole JOIN word ON word.word = v),
        near AS (SELECT a, b, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, encode(b)) AS i, count(*) OVER (PARTITION BY a) AS n_near FROM pair JOIN word ON word.word = b),
        form AS MATERIALIZED (SELECT word, word.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near.n >= 2 * word.n THEN b END AS form, CASE WHEN near.n >= 2 * word.n THEN near.n END AS form_n
                 FROM word LEFT JOIN near ON near.a = word AND i = 1),
        walk(word, pos) AS (SELECT word, word FROM form UNION ALL SELECT walk.word, form.form FROM walk JOIN form ON form.word = walk.pos WHERE form.form IS NOT NULL)
        SELECT word, form, (SELECT pos FROM walk JOIN form f ON f.word = walk.pos WHERE walk.word = form.word AND f.form IS NULL) AS root, n, n_near, form_n FROM form""",
}
