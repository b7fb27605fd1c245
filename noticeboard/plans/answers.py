"""Questions and answers: understanding, evidence, posts, cards and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import questions as Q, texts as T
from ..operators import retrieval as R
from ..sources.tables import load
from .registry import TURNS, query
from .textual import any_, norm, strip

# Latin stand-ins for the published dictionaries
STOP = "aeiouyáéíóúàèêçüöäñß"
CATEGORIES = ["que", "tion", "ung"]
SYNONYMS = [["ment", "tionwh"], ["lich", "keit"], ["ciónpa", "paren"]]
TOPICS = [["elleon", "quement"], ["ingthe", "thewh"], ["schung", "zuverein"], ["dadpara", "losque"]]


def _has(c: str, ws) -> str:
    return any_(c, ws)


def _list(ws) -> str:
    return "[" + ",".join(f"'{w}'" for w in ws) + "]"


def _groups(c: str, groups) -> str:
    return ", ".join(f"CASE WHEN {_has(c, g)} THEN {_list(g)} ELSE [] END" for g in groups)


def _tokens(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '[{STOP}]+'), lambda t: length(t)>=2)"


_TERMS_SQL = f"list_distinct(flatten([{_tokens('n')}, {', '.join(f'CASE WHEN contains(n, {chr(39)}{w}{chr(39)}) THEN [{chr(39)}{w}{chr(39)}] ELSE [] END' for w in CATEGORIES)}, {_groups('n', SYNONYMS)}]))"
_ANCHORS_SQL = f"list_distinct(flatten([{_tokens('n')}, {_groups('n', TOPICS)}]))"


@query("query_terms", f"WITH q AS (SELECT conv_id, turn, {norm('text')} AS n FROM conversations) SELECT conv_id, turn, md5(array_to_string(list_sort({_TERMS_SQL}), ' ')) AS terms, md5(array_to_string(list_sort({_ANCHORS_SQL}), ' ')) AS anchors FROM q")
def query_terms(spark, d):
    out = R.understand(TURNS(spark, d), STOP, CATEGORIES, SYNONYMS, TOPICS)
    return out.select("conv_id", "turn", F.md5(F.array_join(F.array_sort("terms"), " ")).alias("terms"), F.md5(F.array_join(F.array_sort("anchors"), " ")).alias("anchors"))


@query("question_intents", f"""WITH q AS (SELECT conv_id, turn, {norm('text')} AS n FROM conversations) SELECT conv_id, turn, CASE WHEN contains(n,'que') THEN 'que' WHEN contains(n,'tion') THEN 'tion' WHEN contains(n,'ung') THEN 'ung' ELSE '其他' END AS category,
{_has('n', ['zuver', 'ciónd'])} OR (contains(n, 'an') AND {_has('n', ['ouan', 'enan'])}) AS is_community, {_has('n', ['thwas', 'isof'])} AS is_status, {_has('n', ['elle', 'erst'])} AS is_high_risk FROM q""")
def question_intents(spark, d):
    i = Q.question_intent("text", ["zuver", "ciónd"], "an", ["ouan", "enan"], ["thwas", "isof"], ["elle", "erst"])
    return TURNS(spark, d).select("conv_id", "turn", Q.question_category("text", CATEGORIES).alias("category"), i.alias("i")).select("conv_id", "turn", "category", "i.is_community", "i.is_status", "i.is_high_risk")


# anchors and terms come from topic groups only: every letter is a stop character
LETTERS = "a-zà-ÿœß"
ANCHOR_TOPICS = [["elleon", "quement", "auxtion"], ["ingthe", "thewh", "ofthean"], ["schung", "zuverein", "lichkeit"], ["dadpara", "losque", "ciónen"]]
TERM_GROUPS = [["elleon", "tiondes"], ["ingthe", "ofthe", "wasthe"], ["schung", "undder"], ["dadpara", "delos"]]


def questions(spark, d):
    q = TURNS(spark, d).where("role = 'user'").select(
        F.col("turn_id").alias("question_id"), "text", F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("doc-"), F.col("conv_id").cast("string"))).alias("context_slug"),
        F.element_at(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]), (F.col("conv_id") % 4 + 1).cast("int")).alias("region_code"),
    )
    return R.understand(q, LETTERS, [], TERM_GROUPS, ANCHOR_TOPICS)


def items(spark, d):
    return load(spark, d, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("slug"), F.col("doc_id").alias("document_id"), F.col("source").alias("title"), F.col("lang").alias("category"),
        F.col("text").alias("summary"), F.reverse("text").alias("raw_text"), F.lit("").alias("verified_facts"), F.floor(F.col("n_chars") / 100).alias("published_at"), F.col("lang").alias("region_code"),
    )


def _understood(groups: str, topics) -> str:
    tok = f"list_filter(string_split_regex(n, '[{LETTERS}]+'), lambda t: length(t)>=2)"
    return f"list_distinct(flatten([{tok}, {_groups('n', topics)}])) AS {groups}"


_Q_SQL = f"""q AS (SELECT conv_id*1000+turn AS question_id, {norm('text')} AS n, CASE WHEN conv_id%5=0 THEN 'doc-' || cast(conv_id AS string) END AS ctx, ['en','fr','de','es'][conv_id%4+1] AS region FROM conversations WHERE role='user'),
u AS (SELECT question_id, ctx, region, {_understood('terms', TERM_GROUPS)}, {_understood('anchors', ANCHOR_TOPICS)} FROM q)"""
_I_SQL = f"it AS (SELECT 'doc-' || cast(doc_id AS string) AS slug, {norm('source')} AS t, {norm('lang')} AS c, {norm('text')} AS s, {norm('reverse(text)')} AS r, n_chars//100 AS p, lang FROM documents)"
_SCORE_SQL = "list_sum(list_transform(terms, lambda w: CASE WHEN length(w)<2 THEN 0 ELSE CASE WHEN contains(c,w) OR contains(w,c) THEN 12 ELSE 0 END + CASE WHEN contains(t,w) THEN 8 ELSE 0 END + CASE WHEN contains(s,w) THEN 4 ELSE 0 END + CASE WHEN contains(r,w) THEN 2 ELSE 0 END END))"


@query("retrieved_evidence", f"""WITH {_Q_SQL}, {_I_SQL}, a AS (SELECT question_id, slug, p, coalesce(ctx=slug,false) AS ctx, coalesce({_SCORE_SQL},0) AS k, len(list_filter(anchors, lambda x: contains(t,x) OR contains(c,x) OR contains(s,x)))>0 AS hit FROM u, it),
b AS (SELECT question_id, slug, p, cast(k + CASE WHEN ctx THEN 100 ELSE 0 END AS int) AS score FROM a WHERE ctx OR hit), r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, p DESC, slug) AS citation FROM b WHERE score>0)
SELECT question_id, citation, slug, score FROM r WHERE citation<=3""")
def retrieved_evidence(spark, d):
    """The three best documents of every question."""
    return R.retrieve(questions(spark, d), items(spark, d)).select("question_id", "citation", "slug", "score")


@query("retrieved_in_region", f"""WITH {_Q_SQL}, {_I_SQL}, a AS (SELECT question_id, slug, p, coalesce(ctx=slug,false) AS ctx, coalesce({_SCORE_SQL},0) AS k, len(list_filter(anchors, lambda x: contains(t,x) OR contains(c,x) OR contains(s,x)))>0 AS hit, region=lang AS near FROM u, it),
b AS (SELECT question_id, slug, p, cast(k + CASE WHEN ctx THEN 100 ELSE 0 END AS int) AS score FROM a WHERE ctx OR (hit AND near)), r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, p DESC, slug) AS citation FROM b WHERE score>0)
SELECT question_id, citation, slug, score FROM r WHERE citation<=3""")
def retrieved_in_region(spark, d):
    return R.retrieve(questions(spark, d), items(spark, d), same_region=True).select("question_id", "citation", "slug", "score")


_STOPS = "。！？!?."
_QUOTES_SQL = f"""e0 AS (SELECT question_id, citation, slug, terms, text, CASE WHEN {strip('text')}='' THEN text ELSE reverse(text) END AS src FROM r JOIN u USING (question_id) JOIN documents d ON slug='doc-' || cast(d.doc_id AS string) WHERE citation<=3),
e1 AS (SELECT *, list_filter(list_transform(regexp_extract_all(src, '[^{_STOPS}\\n]+[{_STOPS}]*|[{_STOPS}]+'), lambda x: trim(x)), lambda x: x<>'') AS ss FROM e0),
e2 AS (SELECT *, list_filter(ss, lambda x: len(list_filter(terms, lambda w: length(w)>=2 AND contains({norm('x')}, w)))>0)[1:4] AS hits FROM e1),
e3 AS (SELECT *, trim(regexp_replace(concat_ws(' ', nullif(CASE WHEN len(hits)>0 THEN list_aggregate(hits, 'string_agg', ' ') ELSE ss[1] END, ''), CASE WHEN {strip('text')}<>'' THEN '审核摘要：' || text END), '[\\s\\p{{Z}}]+', ' ', 'g')) AS k FROM e2)"""


@query("evidence_quotes", f"""WITH {_Q_SQL}, {_I_SQL}, a AS (SELECT question_id, slug, p, coalesce(ctx=slug,false) AS ctx, coalesce({_SCORE_SQL},0) AS k, len(list_filter(anchors, lambda x: contains(t,x) OR contains(c,x) OR contains(s,x)))>0 AS hit FROM u, it),
b AS (SELECT question_id, slug, p, cast(k + CASE WHEN ctx THEN 100 ELSE 0 END AS int) AS score FROM a WHERE ctx OR hit), r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, p DESC, slug) AS citation FROM b WHERE score>0),
{_QUOTES_SQL} SELECT question_id, citation, slug, CASE WHEN length(k)<=500 THEN k ELSE substr(k, 1, 497) || '…' END AS quote FROM e3""")
def evidence_quotes(spark, d):
    """Sentences around the terms of every question in its three best documents."""
    return R.retrieve_quotes(questions(spark, d), items(spark, d)).select("question_id", "citation", "slug", "quote")


@query("retrieved_posts", f"""WITH {_Q_SQL}, p0 AS (SELECT doc_id AS id, lang, n_chars//100 AS p, {norm('text')} AS t, {norm('source')} AS c, row_number() OVER (PARTITION BY lang ORDER BY n_chars//100 DESC, doc_id DESC) AS rn FROM documents WHERE source<>'src1'), p AS (SELECT * FROM p0 WHERE rn<=50),
s AS (SELECT question_id, id, p, cast(list_sum(list_transform(list_filter(terms, lambda w: length(w)>=2), lambda w: CASE WHEN contains(t,w) THEN 8 ELSE 0 END + CASE WHEN contains(c,w) OR contains(w,c) THEN 4 ELSE 0 END)) AS int) AS score FROM u JOIN p ON p.lang=u.region),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, p DESC, id DESC) AS place FROM s WHERE score>0) SELECT question_id, place, id, score FROM r WHERE place<=5""")
def retrieved_posts(spark, d):
    posts = load(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("region_code"), F.floor(F.col("n_chars") / 100).alias("created_at"), F.col("text").alias("content"), F.col("source").alias("category"),
        F.when(F.col("source") == "src1", "HIDDEN").otherwise("VISIBLE").alias("status"),
    )
    return R.retrieve_posts(questions(spark, d), posts).select("question_id", "place", "id", "score")


_FIELDS_SQL = """f AS (SELECT l_orderkey AS document_id, l_partkey*100000+l_suppkey*10+l_linenumber AS id, CASE l_linenumber%4 WHEN 0 THEN 'LOCATION' WHEN 1 THEN 'FEE' WHEN 2 THEN 'END_DATE' ELSE 'WARNING' END AS t, l_returnflag AS flag, cast(l_suppkey%9 AS string) AS v FROM lineitem)"""


def line_fields(spark, d):
    n = F.col("l_linenumber") % 4
    return load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), (F.col("l_partkey") * 100000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.when(n == 0, "LOCATION").when(n == 1, "FEE").when(n == 2, "END_DATE").otherwise("WARNING").alias("field_type"), F.lit("lab").alias("field_label"),
        (F.col("l_suppkey") % 9).cast("string").alias("field_value"), F.lit("q").alias("source_quote"),
        F.when(F.col("l_returnflag") == "R", "REJECTED").when(F.col("l_returnflag") == "A", "MODIFIED").otherwise("CONFIRMED").alias("review_status"),
    )


@query("fact_cards", f"""WITH {_FIELDS_SQL}, c AS (SELECT o_custkey AS question_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS citation, o_orderkey AS document_id FROM orders),
j AS (SELECT question_id, t, v, min(struct_pack(c := citation, i := id)) AS p FROM c JOIN f USING (document_id) WHERE flag<>'R' AND t<>'WARNING' GROUP BY 1,2,3), r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY p.c, p.i) AS place FROM j)
SELECT question_id, place, CASE t WHEN 'LOCATION' THEN 'location' WHEN 'FEE' THEN 'fee' ELSE 'deadline' END AS type, v AS value FROM r WHERE place<=6""")
def fact_cards(spark, d):
    from ..operators.ordered import row_numbers

    cited = row_numbers(load(spark, d, "orders").select(F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("document_id")), ["question_id"], [F.col("document_id")], "citation")
    return R.fact_cards(cited, line_fields(spark, d)).select("question_id", "place", "type", "value")


@query("facts_digests", f"""WITH {_FIELDS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY id) AS rn FROM f WHERE flag<>'R') SELECT document_id, string_agg('lab：' || v || '（原文：q）', '；' ORDER BY id) AS verified_facts FROM r WHERE rn<=12 GROUP BY 1""")
def facts_digests(spark, d):
    return R.facts_digest(line_fields(spark, d))


@query("answer_quality", f"""WITH a AS (SELECT conv_id, turn, text || CASE turn%3 WHEN 0 THEN ' [1] [2]' WHEN 1 THEN ' [9]' ELSE '' END AS t, length(regexp_replace(text, '[\\t\\n\\x0B\\f\\r ]+', '', 'g')) AS n FROM conversations WHERE role='assistant')
SELECT conv_id, turn, length(t)<180 AND ({_has('lower(t)', ['tionen', 'elle'])}) AS weak, turn%3=0 AS valid, CASE WHEN contains(t,'zu') THEN 'safety' WHEN n+CASE turn%3 WHEN 0 THEN 6 WHEN 1 THEN 3 ELSE 0 END>=250 AND length(t)%2=1 THEN 'rich' WHEN n+CASE turn%3 WHEN 0 THEN 6 WHEN 1 THEN 3 ELSE 0 END<100 THEN 'short' ELSE 'normal' END AS quality FROM a""")
def answer_quality(spark, d):
    """Failure phrases of short answers, and whether every [n] names one of the two citations."""
    k = F.col("turn") % 3
    a = TURNS(spark, d).where("role = 'assistant'")
    a = a.withColumn("t", F.concat("text", F.when(k == 0, " [1] [2]").when(k == 1, " [9]").otherwise("")))
    q = Q.citation_quality("t", F.lit(2), F.when(F.length("t") % 2 == 1, 3).otherwise(0), F.contains("t", F.lit("zu")))
    return a.select("conv_id", "turn", Q.weak_answer("t", ["tionen", "elle"]).alias("weak"), q["valid"].alias("valid"), q["quality"].alias("quality"))


@query("answer_normal_form", f"SELECT conv_id, turn, length({norm('text')}) AS n FROM conversations")
def answer_normal_form(spark, d):
    return TURNS(spark, d).select("conv_id", "turn", F.length(T.normalize("text")).cast("bigint").alias("n"))
