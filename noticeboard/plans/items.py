"""Public items: visibility, search, ranking, feeds, reminders, services."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import regions as R
from ..operators import aggregates as A, filters as P, joins as J, ranking as W
from ..operators.ordered import top_per_key
from .registry import DOCS, EVENTS, ITEMS, JOBS, PARTS, query

NOW = "1998-06-01 00:00:00"
NOW_SQL = f"timestamp '{NOW}'"
PICKS = "2024-01-20 00:00:00"

# ---------------------------------------------------------- engagement, rank --
COUNTS_SQL = f"""
ev AS {EVENTS.sql},
cnt AS (SELECT item_id, count(*) FILTER (event_type='VIEW') AS views, count(*) FILTER (event_type='LIKE') AS likes,
  count(*) FILTER (event_type='FAVORITE') AS favorites, count(*) FILTER (event_type='REMINDER') AS reminders FROM ev GROUP BY item_id)"""
SCORED_SQL = COUNTS_SQL + f""",
items AS {PARTS.sql},
scored AS (SELECT i.*, coalesce(views,0) AS views, coalesce(likes,0) AS likes, coalesce(favorites,0) AS favorites, coalesce(reminders,0) AS reminders,
  (CASE WHEN pinned THEN 500 ELSE 0 END) + importance*5 + coalesce(views,0)*3 + coalesce(likes,0)*5 + coalesce(favorites,0)*12 + coalesce(reminders,0)*8 AS hot_score
  FROM items i LEFT JOIN cnt ON cnt.item_id=i.id)"""
ORDER_SQL = "pinned DESC, hot_score DESC, importance DESC, published_at DESC, id DESC"


def scored(spark, d):
    ev = EVENTS(spark, d)
    out = J.with_engagement(
        PARTS(spark, d), ev, ev.where("event_type = 'FAVORITE'"), ev.where("event_type = 'REMINDER'")
    )
    return out.withColumn("hot_score", W.hot_score())


@query("hot_list", f"""WITH {SCORED_SQL} SELECT id, title, category, views, likes, favorites, reminders, hot_score
FROM scored WHERE status='PUBLISHED' AND (expires_at IS NULL OR expires_at >= timestamp '{PICKS}')""")
def hot_list(spark, d):
    """All visible items with their engagement in business order."""
    return (
        P.visible(scored(spark, d), PICKS).orderBy(*W.business_order())
        .select("id", "title", "category", "views", "likes", "favorites", "reminders", "hot_score")
    )


@query("item_engagement", f"WITH {COUNTS_SQL} SELECT item_id, views, likes, favorites, reminders FROM cnt")
def item_engagement(spark, d):
    return J.engagement(EVENTS(spark, d), views="VIEW", likes="LIKE", favorites="FAVORITE", reminders="REMINDER")


@query("items_with_engagement", f"WITH {SCORED_SQL} SELECT id, views, likes, favorites, reminders FROM scored")
def items_with_engagement(spark, d):
    return scored(spark, d).select("id", "views", "likes", "favorites", "reminders")


@query("item_hot_scores", f"WITH {SCORED_SQL} SELECT id, hot_score FROM scored")
def item_hot_scores(spark, d):
    return scored(spark, d).select("id", "hot_score")


@query("item_business_order", f"WITH {SCORED_SQL} SELECT id, hot_score, row_number() OVER (ORDER BY {ORDER_SQL}) AS place FROM scored WHERE status='PUBLISHED'")
def item_business_order(spark, d):
    from ..operators.ordered import row_numbers

    live = scored(spark, d).where("status = 'PUBLISHED'").select(*W.BUSINESS_COLUMNS)
    return row_numbers(live, [], W.business_order(), "place").select("id", "hot_score", "place")


@query("item_neighbors", f"""WITH {SCORED_SQL} SELECT id,
coalesce(lag(id) OVER c, lag(id) OVER g) AS previous_id, coalesce(lead(id) OVER c, lead(id) OVER g) AS next_id
FROM scored WHERE status='PUBLISHED' WINDOW g AS (ORDER BY {ORDER_SQL}), c AS (PARTITION BY category ORDER BY {ORDER_SQL})""")
def item_neighbors(spark, d):
    return W.neighbor_items(scored(spark, d).where("status = 'PUBLISHED'"))


@query("popular_content", f"""WITH {COUNTS_SQL}, l AS (SELECT item_id, count(*) FILTER (event_type='CONTENT_LISTEN') AS listens FROM ev GROUP BY 1), items AS {PARTS.sql}
SELECT id, title, category, coalesce(views,0) AS views, coalesce(favorites,0) AS favorites, coalesce(listens,0) AS listens
FROM items i LEFT JOIN cnt ON cnt.item_id=id LEFT JOIN l ON l.item_id=id WHERE status='PUBLISHED'
ORDER BY views DESC, favorites DESC, listens DESC, published_at DESC, id DESC LIMIT 5""")
def popular_content(spark, d):
    ev = EVENTS(spark, d)
    out = A.popular(PARTS(spark, d), ev, ev.where("event_type = 'FAVORITE'"), ev)
    return out.select("id", "title", "category", "views", "favorites", "listens")


_IMPORTANCE_SQL = f"""importance + (CASE WHEN pinned THEN 100 ELSE 0 END) + (CASE category WHEN 'URGENT' THEN 40 WHEN 'HIGH' THEN 30 WHEN 'MEDIUM' THEN 20 ELSE 10 END)
+ greatest(0.0, 30.0 - greatest(0.0, (epoch_us({NOW_SQL}) - epoch_us(published_at)) / 86400000000.0)) - (CASE WHEN is_read THEN 12 ELSE 0 END)"""
LATIN_WEIGHTS = {"URGENT": 40, "HIGH": 30, "MEDIUM": 20}


@query("item_importance", f"WITH items AS {ITEMS.sql} SELECT id, cast({_IMPORTANCE_SQL} AS double) AS score FROM items")
def item_importance(spark, d):
    return ITEMS(spark, d).select("id", W.importance_score(NOW, LATIN_WEIGHTS).alias("score"))


@query("home_feed", f"""WITH items AS {ITEMS.sql}, s AS (SELECT id, cast({_IMPORTANCE_SQL} AS double)
 + (CASE WHEN category IN ('HIGH','LOW') THEN 12 ELSE 0 END) + (CASE WHEN deadline_at IS NOT NULL THEN 18 ELSE 0 END)
 + (CASE WHEN is_local OR publish_channel='FRAUD' THEN 16 ELSE 0 END)
 + (CASE WHEN coalesce(cover_image_url,'')='' THEN 0 WHEN cover_image_type='ORIGINAL_COVER' THEN 30 WHEN cover_image_type='ARTICLE_IMAGE' THEN 25 ELSE 0 END) AS feed_score
 FROM items WHERE status='PUBLISHED'), r AS (SELECT id, feed_score, row_number() OVER (ORDER BY feed_score DESC, id DESC) AS feed_rank FROM s)
SELECT id, feed_score, feed_rank, feed_rank=1 AS featured FROM r WHERE feed_rank<=13""")
def home_feed(spark, d):
    items = ITEMS(spark, d).where("status = 'PUBLISHED'").withColumn("region_code", F.col("publish_channel"))
    return W.home_feed(items, ["HIGH", "LOW"], "FRAUD", NOW, weights=LATIN_WEIGHTS).select("id", "feed_score", "feed_rank", "featured")


@query("reading_history", f"""WITH ev AS {EVENTS.sql}, l AS (SELECT user_id, item_id, max(ts) AS visited_at FROM ev WHERE event_type='VIEW' GROUP BY 1,2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY visited_at DESC, item_id DESC) AS history_rank FROM l)
SELECT user_id, item_id, visited_at, history_rank FROM r WHERE history_rank <= 50""")
def reading_history(spark, d):
    return W.history(EVENTS(spark, d).where("event_type = 'VIEW'"))


# ------------------------------------------------------------------- filters --
@query("visible_items", f"WITH items AS {ITEMS.sql} SELECT id, status, expires_at FROM items WHERE status='PUBLISHED' AND (expires_at IS NULL OR expires_at >= {NOW_SQL})")
def visible_items(spark, d):
    return P.visible(ITEMS(spark, d), NOW).select("id", "status", "expires_at")


@query("keyword_search", f"WITH items AS {PARTS.sql} SELECT id, title FROM items WHERE title LIKE '%b_l%' OR summary LIKE '%b_l%' OR category LIKE '%b_l%'")
def keyword_search(spark, d):
    """The underscore of the keyword is a wildcard."""
    return P.search(PARTS(spark, d), " b_l ").select("id", "title")


@query("items_by_channel", f"WITH items AS {PARTS.sql} SELECT id, category FROM items WHERE category IN ('Brand#1','Brand#12')")
def items_by_channel(spark, d):
    return P.by_channel(PARTS(spark, d), "first", {"first": ["Brand#1", "Brand#12"]}).select("id", "category")


_KIND_SQL = """CASE WHEN content_kind <> '' THEN (CASE WHEN content_kind='SERVICE_NOTICE' THEN 'guide' ELSE 'news' END)
WHEN slug LIKE 'news-%' THEN 'news' WHEN category IN ('HIGH','LOW') THEN 'news' ELSE 'guide' END"""


@query("item_content_kind", f"WITH items AS {ITEMS.sql} SELECT id, {_KIND_SQL} AS kind FROM items")
def item_content_kind(spark, d):
    return ITEMS(spark, d).select("id", P.content_kind(news_categories=["HIGH", "LOW"]).alias("kind"))


@query("feed_card_kind", f"""WITH items AS {ITEMS.sql} SELECT id, CASE WHEN coalesce(cover_image_url,'')<>'' AND cover_image_type IN ('ORIGINAL_COVER','ARTICLE_IMAGE') THEN 'image'
WHEN regexp_matches(title || ' ' || summary || ' ' || category, 'MED|7$') THEN 'activity' WHEN ({_KIND_SQL})='guide' THEN 'service'
WHEN regexp_matches(title, 'URG|3') THEN 'alert' ELSE 'text' END AS card FROM items""")
def feed_card_kind(spark, d):
    items = ITEMS(spark, d)
    return items.select("id", P.card_kind(items, "MED|7$", "URG|3", ["HIGH", "LOW"]).alias("card"))


@query("service_kind_items", f"WITH items AS {ITEMS.sql} SELECT id FROM items WHERE regexp_matches(title || summary || category, 'HIGH|99') OR ({_KIND_SQL})='guide'")
def service_kind_items(spark, d):
    return P.by_service_kind(ITEMS(spark, d), "guides", {"guides": "HIGH|99"}, ["HIGH", "LOW"]).select("id")


@query("service_facets", f"WITH items AS {ITEMS.sql} SELECT id, category, source_name FROM items WHERE category IN ('HIGH','LOW') AND contains(title || summary, '12') AND category='LOW' AND source_name='source 1'")
def service_facets(spark, d):
    return P.facet(ITEMS(spark, d), "12", "LOW", "source 1", ["HIGH", "LOW"]).select("id", "category", "source_name")


@query("service_facet_values", f"WITH items AS {ITEMS.sql} SELECT DISTINCT source_name FROM items WHERE category IN ('HIGH','LOW')")
def service_facet_values(spark, d):
    return P.facet_values(ITEMS(spark, d), ["HIGH", "LOW"])


@query("title_audit", f"WITH items AS {PARTS.sql} SELECT id, CASE WHEN regexp_matches(title, '(?i)(RING|gear)') THEN 'SUSPICIOUS' ELSE 'ok' END AS title_check FROM items WHERE status='PUBLISHED'")
def title_audit(spark, d):
    return P.audit_titles(PARTS(spark, d), "(?i)(RING|gear)").select("id", "title_check")


@query("reminder_groups", f"""WITH ev AS {EVENTS.sql}, items AS {PARTS.sql} SELECT r.event_id, i.title, i.status AS content_status,
CASE WHEN r.ts >= timestamp '{PICKS}' THEN 'upcoming' ELSE 'ended' END AS reminder_group FROM ev r JOIN items i ON i.id=r.item_id WHERE r.event_type='REMINDER'""")
def reminder_groups(spark, d):
    r = EVENTS(spark, d).where("event_type = 'REMINDER'").withColumnsRenamed({"item_id": "published_item_id", "ts": "remind_at"})
    return P.reminders(r, PARTS(spark, d), PICKS).select("event_id", "title", "content_status", "reminder_group")


@query("accepted_events", f"""WITH ev AS {EVENTS.sql}, items AS {PARTS.sql} SELECT event_id, event_type FROM ev WHERE event_type='CONTENT_LISTEN'
OR (event_type='VIEW' AND item_id IN (SELECT id FROM items WHERE status='PUBLISHED'))""")
def accepted_events(spark, d):
    return P.valid_events(EVENTS(spark, d), PARTS(spark, d)).select("event_id", "event_type")


# -------------------------------------------------------------------- regions --
# customers give every order a place: region = city, nation = district, segment decides the scope
PLACED_SQL = f"""items AS {ITEMS.sql}, placed AS (SELECT i.id, i.title, i.status, i.published_at,
 CASE c_mktsegment WHEN 'BUILDING' THEN '' ELSE 'world' END AS province, r_name AS city,
 CASE WHEN c_mktsegment IN ('AUTOMOBILE') THEN '' ELSE n_name END AS district,
 CASE WHEN c_mktsegment IN ('HOUSEHOLD') THEN concat('town ', cast(c_custkey as string)) ELSE '' END AS street_or_town,
 concat(cast(n_nationkey as string), '-', cast(n_regionkey as string)) AS region_code,
 CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'LOCAL_TOWN' WHEN 'MACHINERY' THEN 'DISTRICT_SHARED' WHEN 'AUTOMOBILE' THEN 'CITY_SHARED' WHEN 'BUILDING' THEN 'NATIONAL_SHARED' ELSE 'UNCLASSIFIED' END AS local_scope
 FROM items i JOIN customer c ON c.c_custkey=i.custkey JOIN nation n ON n.n_nationkey=c.c_nationkey JOIN region r ON r.r_regionkey=n.n_regionkey)"""


def placed(spark, d):
    from ..sources.tables import load

    seg = F.col("c_mktsegment")
    places = (
        load(spark, d, "customer").join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return ITEMS(spark, d).join(places, F.col("custkey") == F.col("c_custkey")).select(
        "id", "title", "status", "published_at",
        F.when(seg == "BUILDING", "").otherwise("world").alias("province"),
        F.col("r_name").alias("city"),
        F.when(seg == "AUTOMOBILE", "").otherwise(F.col("n_name")).alias("district"),
        F.when(seg == "HOUSEHOLD", F.concat(F.lit("town "), F.col("c_custkey").cast("string"))).otherwise("").alias("street_or_town"),
        F.concat_ws("-", F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")).alias("region_code"),
        F.when(seg == "HOUSEHOLD", "LOCAL_TOWN").when(seg == "MACHINERY", "DISTRICT_SHARED").when(seg == "AUTOMOBILE", "CITY_SHARED")
        .when(seg == "BUILDING", "NATIONAL_SHARED").otherwise("UNCLASSIFIED").alias("local_scope"),
    )


HOME = {"code": "7-2", "district": "NATION_7", "city": "ASIA"}
_IN_REGION_SQL = """((region_code='7-2' AND local_scope IN ('LOCAL_TOWN','TOWN','STREET','LOCAL'))
OR (local_scope='DISTRICT_SHARED' AND district='NATION_7' AND coalesce(street_or_town,'')='')
OR (local_scope IN ('CITY_SHARED','CITY') AND city='ASIA' AND coalesce(district,'')='')
OR (local_scope IN ('NATIONAL_SHARED','NATIONAL') AND coalesce(province,'') IN ('','world')))"""


@query("items_in_region", f"WITH {PLACED_SQL} SELECT id, local_scope FROM placed WHERE status='PUBLISHED' AND {_IN_REGION_SQL}")
def items_in_region(spark, d):
    return placed(spark, d).where("status = 'PUBLISHED'").where(R.in_region(HOME, national="world")).select("id", "local_scope")


@query("region_leaks", f"""WITH {PLACED_SQL} SELECT local_scope, count(*) AS rows_outside FROM placed
WHERE NOT {_IN_REGION_SQL} GROUP BY local_scope""")
def region_leaks(spark, d):
    """All rows except the visible ones, as a set difference, by scope."""
    rows = placed(spark, d).select("id", "local_scope", "region_code", "district", "city", "street_or_town", "province")
    inside = rows.where(R.in_region(HOME, national="world"))
    return rows.exceptAll(inside).groupBy("local_scope").agg(F.count("*").alias("rows_outside"))


@query("evidence_order", f"""WITH {PLACED_SQL} SELECT id, CASE WHEN region_code='7-2' THEN 0 ELSE 1 END AS own FROM placed
WHERE status='PUBLISHED' AND {_IN_REGION_SQL}""")
def evidence_order(spark, d):
    rows = placed(spark, d).where("status = 'PUBLISHED'").where(R.in_region(HOME, national="world"))
    return W.evidence(rows, "7-2").select("id", F.when(F.col("region_code") == "7-2", 0).otherwise(1).alias("own"))


@query("derived_scope", f"""WITH {PLACED_SQL} SELECT id, CASE WHEN street_or_town<>'' THEN 'STREET' WHEN district<>'' THEN 'DISTRICT' WHEN city<>'' THEN 'CITY'
WHEN province<>'' THEN 'PROVINCE' ELSE 'UNSPECIFIED' END AS scope FROM placed""")
def derived_scope(spark, d):
    return placed(spark, d).select("id", R.local_scope().alias("scope"))


@query("normalized_scope", f"""WITH {PLACED_SQL} SELECT id, local_scope,
 CASE WHEN local_scope='NATIONAL_SHARED' THEN 'world' WHEN local_scope='UNCLASSIFIED' THEN NULL ELSE nullif(province,'') END AS province,
 CASE WHEN local_scope IN ('LOCAL_TOWN','DISTRICT_SHARED','CITY_SHARED') THEN city END AS city,
 CASE WHEN local_scope IN ('LOCAL_TOWN','DISTRICT_SHARED') THEN nullif(district,'') END AS district,
 CASE WHEN local_scope='LOCAL_TOWN' THEN nullif(street_or_town,'') END AS street_or_town,
 CASE local_scope WHEN 'DISTRICT_SHARED' THEN 'D' WHEN 'CITY_SHARED' THEN 'C' WHEN 'NATIONAL_SHARED' THEN 'N' WHEN 'LOCAL_TOWN' THEN region_code END AS region_code,
 CASE WHEN local_scope='LOCAL_TOWN' AND NOT (district='NATION_7' AND region_code='7-2') THEN 'TOWN_NOT_REGISTERED'
  WHEN local_scope='DISTRICT_SHARED' AND district<>'NATION_7' THEN 'DISTRICT_MISMATCH' WHEN local_scope='CITY_SHARED' AND city<>'ASIA' THEN 'CITY_MISMATCH' END AS scope_error
FROM placed""")
def normalized_scope(spark, d):
    rows = placed(spark, d).select("id", "province", "city", "district", "street_or_town", "region_code", "local_scope")
    return R.normalize_scope(rows, "NATION_7", "ASIA", ["7-2"], "world", {"DISTRICT_SHARED": "D", "CITY_SHARED": "C", "NATIONAL_SHARED": "N"})


@query("upgraded_scope", """SELECT o_orderkey AS id, CASE WHEN s IN ('LOCAL','TOWN','STREET') AND code IS NOT NULL THEN 'LOCAL_TOWN' WHEN s='UNSPECIFIED' THEN 'UNCLASSIFIED' ELSE s END AS scope
FROM (SELECT o_orderkey, CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'LOCAL' WHEN '2' THEN 'STREET' WHEN '3' THEN 'UNSPECIFIED' ELSE 'CITY' END AS s, CASE WHEN o_orderstatus='F' THEN 'x' END AS code FROM orders)""")
def upgraded_scope(spark, d):
    p = F.substring("o_orderpriority", 1, 1)
    from ..sources.tables import load

    rows = load(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(p == "1", "LOCAL").when(p == "2", "STREET").when(p == "3", "UNSPECIFIED").otherwise("CITY").alias("s"),
        F.when(F.col("o_orderstatus") == "F", "x").alias("code"),
    )
    return rows.select("id", R.upgrade_scope("s", "code").alias("scope"))


@query("region_of_text", f"""WITH docs AS {DOCS.sql} SELECT id, CASE WHEN contains(text,'tion') THEN 'R1' WHEN contains(text,'ing') THEN 'R2' WHEN contains(text,'que') THEN 'R3'
WHEN lang='de' THEN 'R1' WHEN lang='es' THEN NULL ELSE 'R2' END AS region FROM docs""")
def region_of_text(spark, d):
    docs = DOCS(spark, d).withColumn("given", F.when(F.col("lang") == "de", "R1").when(F.col("lang") == "es", "unknown").otherwise(" "))
    return docs.select("id", R.region_of("text", "given", [("R1", "tion"), ("R2", "ing"), ("R3", "que")], "R2").alias("region"))


# ------------------------------------------------------------ services, members --
@query("active_campaigns", """WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority<>'5-LOW' THEN cast(o_custkey AS string) END AS region_code,
 CASE WHEN o_orderstatus='P' THEN 'PAUSED' ELSE 'ACTIVE' END AS status, o_orderdate AS start_at, CASE WHEN o_orderstatus='O' THEN o_orderdate + INTERVAL 400 DAY END AS end_at FROM orders),
run AS (SELECT * FROM c WHERE status='ACTIVE' AND start_at <= timestamp '1998-06-01' AND (end_at IS NULL OR end_at > timestamp '1998-06-01'))
SELECT cast(c_custkey AS string) AS region_code, coalesce((SELECT max(id) FROM run WHERE run.region_code=cast(c_custkey AS string)), (SELECT max(id) FROM run WHERE region_code IS NULL)) AS campaign_id FROM customer""")
def active_campaigns(spark, d):
    from ..sources.tables import load

    c = load(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey").cast("string")).alias("region_code"),
        F.when(F.col("o_orderstatus") == "P", "PAUSED").otherwise("ACTIVE").alias("status"),
        F.col("o_orderdate").alias("start_at"),
        F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate") + F.expr("interval 400 day")).alias("end_at"),
    )
    regions = load(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("region_code"))
    return P.active_campaign(c, regions, NOW)


@query("verified_services", """SELECT p_partkey AS id, p_name AS name, s_name AS provider_name FROM part JOIN supplier ON s_suppkey=p_size
WHERE p_type<>'PROMO' AND s_acctbal>1000 AND p_brand='Brand#5'""")
def verified_services(spark, d):
    from ..sources.tables import load

    products = load(spark, d, "part").selectExpr(
        "p_partkey id", "p_name name", "p_name description", "cast(p_size as bigint) provider_id", "p_brand region_code",
        "case when p_type = 'PROMO' then 'OFF' else 'ACTIVE' end status", "case when p_size < 10 then 0 else p_size end price_cents",
    )
    providers = load(spark, d, "supplier").selectExpr(
        "s_suppkey id", "s_name name", "'ACTIVE' status", "case when s_acctbal > 1000 then 'VERIFIED' else 'NEW' end verification_status"
    )
    return P.list_services(products, providers, "Brand#5").select("id", "name", "provider_name")


MEMBERS_SQL = """m AS (SELECT o_orderkey AS id, o_custkey AS resident_user_id, CASE o_orderstatus WHEN 'F' THEN 'ACTIVE' WHEN 'O' THEN 'DEMO_ACTIVE_MEMBERSHIP' ELSE 'ENDED' END AS status,
 o_orderdate AS starts_at, o_orderdate + INTERVAL 365 DAY AS expires_at, substr(o_orderpriority,1,1) AS plan_id FROM orders)"""


def memberships(spark, d):
    from ..sources.tables import load

    return load(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("resident_user_id"),
        F.when(F.col("o_orderstatus") == "F", "ACTIVE").when(F.col("o_orderstatus") == "O", "DEMO_ACTIVE_MEMBERSHIP").otherwise("ENDED").alias("status"),
        F.col("o_orderdate").alias("starts_at"), F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderdate") + F.expr("interval 365 day")).alias("expires_at"),
        F.substring("o_orderpriority", 1, 1).alias("plan_id"),
    )


@query("active_memberships", f"""WITH {MEMBERS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY resident_user_id ORDER BY expires_at DESC, id DESC) AS rn FROM m
 WHERE status IN ('ACTIVE','DEMO_ACTIVE_MEMBERSHIP') AND expires_at > {NOW_SQL}),
p AS (SELECT DISTINCT substr(o_orderpriority,1,1) AS id, substr(o_orderpriority,3) AS name FROM orders)
SELECT resident_user_id, r.id, status, name AS plan_name FROM r JOIN p ON p.id=r.plan_id WHERE rn=1""")
def active_memberships(spark, d):
    from ..sources.tables import load

    plans = load(spark, d, "orders").select(
        F.substring("o_orderpriority", 1, 1).alias("id"), F.expr("substr(o_orderpriority, 3)").alias("name"), F.lit("YEAR").alias("billing_period")
    ).distinct()
    return P.active_membership(memberships(spark, d), plans, NOW).select("resident_user_id", "id", "status", "plan_name")


@query("orders_with_provider", """SELECT l_orderkey, l_linenumber, l_partkey, p_name AS product_name, s_name AS provider_name
FROM lineitem JOIN part ON p_partkey=l_partkey JOIN supplier ON s_suppkey=l_suppkey""")
def orders_with_provider(spark, d):
    from ..sources.tables import load

    lines = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("provider_id"))
    parts = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    sup = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return J.orders_view(lines, parts, sup).select("l_orderkey", "l_linenumber", "l_partkey", "product_name", "provider_name")


@query("latest_job_of_document", f"""WITH jobs AS {JOBS.sql}, l AS (SELECT document_id, max(progress) AS progress, arg_max(stage, {{'a': id, 'b': source_id, 'c': status, 'd': stage}}) AS stage, arg_max(status, {{'a': id, 'b': source_id, 'c': status, 'd': stage}}) AS job_status FROM jobs GROUP BY 1)
SELECT o_orderkey AS id, stage, job_status, coalesce(progress,0) AS progress FROM orders LEFT JOIN l ON l.document_id=o_orderkey""")
def latest_job_of_document(spark, d):
    docs = ITEMS(spark, d).select("id")
    out = J.with_latest(docs, JOBS(spark, d), "id", "document_id", ["id", "source_id", "status", "stage"], {"stage": "stage", "status": "job_status"}, progress=F.max("progress"))
    return out.withColumn("progress", F.coalesce("progress", F.lit(0)))


@query("documents_with_jobs", f"WITH jobs AS {JOBS.sql} SELECT o_orderkey AS id FROM orders WHERE EXISTS (SELECT 1 FROM jobs WHERE jobs.document_id=o_orderkey AND jobs.stage='QUEUED')")
def documents_with_jobs(spark, d):
    return J.exists(ITEMS(spark, d).select("id"), JOBS(spark, d).where("stage = 'QUEUED'"), "id", "document_id")


@query("items_never_engaged", f"WITH ev AS {EVENTS.sql} SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT item_id FROM ev)")
def items_never_engaged(spark, d):
    return J.not_exists(PARTS(spark, d).select("id"), EVENTS(spark, d), "id", "item_id")


@query("imported_flag", f"WITH ev AS {EVENTS.sql} SELECT p_partkey AS id, p_partkey IN (SELECT item_id FROM ev WHERE event_type='FAVORITE') AS imported FROM part")
def imported_flag(spark, d):
    fav = EVENTS(spark, d).where("event_type = 'FAVORITE'")
    return J.flag_exists(PARTS(spark, d).select("id"), fav, "id", "item_id", "imported")


@query("items_of_documents", f"WITH items AS {ITEMS.sql} SELECT i.id, c_name AS owner FROM items i JOIN customer ON c_custkey=i.custkey")
def items_of_documents(spark, d):
    from ..sources.tables import load

    owners = load(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("owner"))
    return ITEMS(spark, d).select("id", "custkey").join(owners, "custkey").select("id", "owner")


@query("newest_per_source", """WITH r AS (SELECT o_orderkey AS id, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT id, o_custkey AS source_registry_id FROM r WHERE rn<=3""")
def newest_per_source(spark, d):
    from .registry import CRAWL_JOBS

    return top_per_key(CRAWL_JOBS(spark, d), ["source_registry_id"], [F.desc("discovered_at"), F.desc("id")], 3).select("id", "source_registry_id")
