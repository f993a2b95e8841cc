"""Dump lines, titles, wikitext and claims: the text side, over lines made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import robust, titles
from pulsegrid.operators import entities, staging
from pulsegrid.plans import base as b
from pulsegrid.plans.registry import query
from pulsegrid.session import table
from pulsegrid.sources import canonical, dumps

#: Some lines are broken on purpose: a fifth field, or views that are no number.
_LINES = """lines AS (SELECT CASE WHEN event_id % 17 = 0 THEN event_type || ' T' || user_id || ' x 0' WHEN event_id % 19 = 0 THEN event_type || ' T' || user_id || ' 1 0 9'
ELSE event_type || CASE WHEN event_id % 2 = 0 THEN '.m' ELSE '' END || ' T' || user_id || ' ' || CAST(floor(value) AS BIGINT) || ' 0' END AS value FROM events)"""


def hourly_lines(spark, sf_dir):
    project = F.concat(F.col("event_type"), F.when(F.col("event_id") % 2 == 0, ".m").otherwise(""))
    title, views = F.concat(F.lit("T"), "user_id"), F.floor("value").cast("string")
    line = F.when(F.col("event_id") % 17 == 0, F.concat_ws(" ", "event_type", title, F.lit("x"), F.lit("0")))
    line = line.when(F.col("event_id") % 19 == 0, F.concat_ws(" ", "event_type", title, F.lit("1"), F.lit("0"), F.lit("9")))
    return table(spark, sf_dir, "events").select(line.otherwise(F.concat_ws(" ", project, title, views, F.lit("0"))).alias("value"))


@query("s1_scan_hourly_dump", "WITH " + _LINES + """, p AS (SELECT string_split(value, ' ') AS f FROM lines) SELECT f[1] AS project, f[2] AS title, CAST(sum(try_cast(f[3] AS BIGINT)) AS BIGINT) AS views, count(*) AS n
FROM p WHERE len(f) = 4 AND try_cast(f[3] AS BIGINT) IS NOT NULL GROUP BY ALL""")
def s1(spark, sf_dir):
    rows = dumps.parse_hourly_lines(hourly_lines(spark, sf_dir))
    return rows.groupBy("project", "title").agg(F.sum("views").alias("views"), F.count("*").alias("n"))


@query("p2_project_codes", "WITH " + _LINES + """, p AS (SELECT string_split(value, ' ') AS f FROM lines) SELECT replace(f[1], '.m', '') AS lang, ends_with(f[1], '.m') AS is_mobile, count(*) AS n
FROM p WHERE len(f) = 4 AND try_cast(f[3] AS BIGINT) IS NOT NULL AND replace(f[1], '.m', '') <> 'signup' GROUP BY ALL""")
def p2(spark, sf_dir):
    code = staging.project_code(F.col("project"), ["signup"])
    rows = dumps.parse_hourly_lines(hourly_lines(spark, sf_dir)).withColumn("p", code).filter("p IS NOT NULL")
    return rows.groupBy("p.lang", "p.is_mobile").agg(F.count("*").alias("n"))


_DAILY = """cells AS (SELECT event_type AS wiki, 'T' || user_id AS title, CASE WHEN user_id % 2 = 0 THEN 'desktop' ELSE 'mobile-web' END AS access, ts::DATE AS day, hour(ts) AS hour, CAST(sum(floor(value)) AS BIGINT) AS v FROM events GROUP BY ALL)"""


def daily_lines(spark, sf_dir):
    """A line an item and day; every third has no page id."""
    e = table(spark, sf_dir, "events")
    access = F.when(F.col("user_id") % 2 == 0, "desktop").otherwise("mobile-web")
    cells = e.groupBy("event_type", "user_id", access.alias("access"), F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(F.sum(F.floor("value")).alias("v"))
    text = F.sort_array(F.collect_list(F.concat(F.char(F.col("hour") + 65), F.col("v").cast("string"))))
    rows = cells.groupBy("event_type", "user_id", "access", "day").agg(F.array_join(text, "").alias("hours"), F.sum("v").alias("total"))
    page = F.when(F.col("user_id") % 3 == 0, F.lit(None).cast("string")).otherwise(F.lit("null"))
    return rows.select("day", F.concat_ws(" ", "event_type", F.concat(F.lit("T"), "user_id"), page, "access", F.col("total").cast("string"), "hours").alias("value"))


@query("s2_scan_daily_complete", "WITH " + _DAILY + "SELECT wiki, title, access, hour::INT AS hour, CAST(sum(v) AS BIGINT) AS views, count(*) AS days FROM cells GROUP BY ALL")
def s2(spark, sf_dir):
    rows = dumps.parse_daily_lines(daily_lines(spark, sf_dir), "day")
    return rows.groupBy("wiki", "title", "access", "hour").agg(F.sum("views").alias("views"), F.count("*").alias("days"))


@query("e22_codec_check", "WITH " + _DAILY + ", t AS (SELECT wiki, title, access, day, sum(v) AS total FROM cells GROUP BY ALL) SELECT wiki, count(*) AS n_lines, count(*) FILTER (WHERE total % 10 <> 3) AS n_matching FROM t GROUP BY wiki")
def e22(spark, sf_dir):
    """Lines whose cells sum to their total; totals that end in 3 are written one too high."""
    lines = daily_lines(spark, sf_dir).withColumn("value", F.when(F.regexp_like("value", F.lit("3 [A-X0-9]+$")), F.regexp_replace("value", "3 ([A-X0-9]+)$", "4 $1")).otherwise(F.col("value")))
    rows = dumps.parse_daily_lines(lines, "day")
    sums = rows.groupBy("day", "wiki", "title", "access", "daily_total").agg(F.sum("views").alias("v"))
    return sums.groupBy("wiki").agg(F.count("*").alias("n_lines"), F.count_if(F.col("v") == F.col("daily_total")).alias("n_matching"))


@query("s3_scan_sitelinks", "SELECT 'en' AS lang, replace(p_name, ' ', '_') || '''s' AS title, p_partkey AS qid FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 'zh-yue', replace(p_name, ' ', '_') || '''s', p_partkey FROM part WHERE p_size % 2 = 1 AND p_size < 40")
def s3(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    site = F.when(F.col("p_size") % 2 == 0, "enwiki").when(F.col("p_size") < 40, "zh_yuewiki").otherwise("commonswiki")
    line = F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(","), F.col("p_partkey").cast("string"), F.lit(",'"), site, F.lit("','"), "p_name", F.lit("\\'s'),"))
    sites = spark.createDataFrame([("enwiki", "en"), ("zh_yuewiki", "zh-yue")], "site string, lang string")
    return dumps.parse_sitelinks(part.select(line.alias("value")), sites)


@query("p4_article_filter", """WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'User talk:' || conv_id WHEN turn % 4 = 1 THEN 'Main_Page' WHEN conv_id % 9 = 0 THEN '-' ELSE 'A:' || conv_id END AS title FROM conversations)
SELECT conv_id, turn, title FROM t WHERE title NOT IN ('-', 'Main_Page') AND title NOT LIKE 'User talk:%'""")
def p4(spark, sf_dir):
    t, c = F.col("turn"), F.col("conv_id").cast("string")
    title = F.when(t % 4 == 0, F.concat(F.lit("User talk:"), c)).when(t % 4 == 1, "Main_Page").when(F.col("conv_id") % 9 == 0, "-").otherwise(F.concat(F.lit("A:"), c))
    rows = table(spark, sf_dir, "conversations").select(F.lit("en").alias("lang"), "conv_id", "turn", title.alias("title"))
    excluded = spark.createDataFrame([("en", "Main_Page")], "lang string, title string")
    spaces = spark.createDataFrame([("en", "user talk"), ("en", "user")], "lang string, prefix string")
    return staging.articles(rows, excluded, spaces).select("conv_id", "turn", "title")


@query("f1_normalized_titles", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN replace(p_name, ' ', '_') || '_é' WHEN p_partkey % 4 = 1 THEN '100%_' || replace(p_name, ' ', '_') WHEN p_partkey % 4 = 2 THEN 'a+%ff' ELSE replace(p_name, ' ', '_') END AS title FROM part""")
def f1(spark, sf_dir):
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.concat("p_name", F.lit("%20%C3%A9"))).when(k == 1, F.concat(F.lit("100%_"), "p_name")).when(k == 2, F.lit("a+%ff")).otherwise(F.col("p_name"))
    return titles.normalize_titles(table(spark, sf_dir, "part").select("p_partkey", raw.alias("title")))


@query("f3_labels_and_urls", """SELECT p_partkey, p_name AS label, 'https://en.wikipedia.org/wiki/' || replace(p_name, ' ', '_') || '_(' || p_size || '%3F)' AS url, CASE WHEN length(p_type) > 6 THEN rtrim(left(p_type, 5)) || '…' ELSE p_type END AS short FROM part""")
def f3(spark, sf_dir):
    title = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_("), F.col("p_size").cast("string"), F.lit("?)"))
    return table(spark, sf_dir, "part").select("p_partkey", titles.label(title).alias("label"), titles.wiki_url(F.lit("en"), title).alias("url"), titles.shortened(F.col("p_type"), 6).alias("short"))


@query("f13_haversine", """WITH p AS (SELECT s_suppkey AS id, (s_suppkey * 7 % 180) - 90.0 AS a, (s_suppkey * 13 % 360) - 180.0 AS o FROM supplier)
SELECT x.id, y.id AS other, round(2 * 6371 * asin(least(1, sqrt(pow(sin(radians(y.a - x.a) / 2), 2) + cos(radians(x.a)) * cos(radians(y.a)) * pow(sin(radians(y.o - x.o) / 2), 2)))), 6) AS km FROM p x JOIN p y ON y.id = x.id + 1""")
def f13(spark, sf_dir):
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), ((F.col("s_suppkey") * 7) % 180 - 90.0).alias("a"), ((F.col("s_suppkey") * 13) % 360 - 180.0).alias("o"))
    q = p.select((F.col("id") - 1).alias("id"), F.col("id").alias("other"), F.col("a").alias("a2"), F.col("o").alias("o2"))
    return p.join(q, "id").select("id", "other", F.round(robust.haversine_km(F.col("a"), F.col("o"), F.col("a2"), F.col("o2")), b.R).alias("km"))


@query("f14_link_functions", "SELECT event_id, round(ln(p / (1 - p)), 6) AS logit, round(1 / (1 + exp(-value / 100)), 6) AS sigmoid, round(least(1, greatest(0, ln((value + 1) / 8) / ln(5000 / 8))), 6) AS scaled FROM (SELECT *, least(greatest(value / 600, 1e-6), 1 - 1e-6) AS p FROM events)")
def f14(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(robust.logit(v / 600), b.R).alias("logit"), F.round(robust.sigmoid(v / 100), b.R).alias("sigmoid"), F.round(robust.log_scale(v + 1), b.R).alias("scaled"))


@query("e11_wikitext_links", """WITH e AS (SELECT ts::DATE AS date, event_type AS section, event_id, 'T' || (user_id % 8) AS t, 'U' || user_id AS u, event_id % 3 = 0 AS two FROM events),
l AS (SELECT e.*, k.k, row_number() OVER (PARTITION BY date ORDER BY section, event_id, k.k) AS entry FROM e JOIN (VALUES (0), (1)) k(k) ON k.k = 0 OR two)
SELECT date, section, entry, k + 1 AS depth, 'en' AS lang, CASE WHEN k = 1 THEN 'Sub ' || event_id ELSE t END AS title FROM l UNION ALL SELECT date, section, entry, 1, 'de', u FROM l WHERE NOT two""")
def e11(spark, sf_dir):
    """A page a day with a section for each kind of event and an entry, or an entry and one below it, for each event."""
    link = F.concat(F.lit("[[T"), F.col("user_id") % canonical.ENTITIES)
    one = F.concat(F.lit("* "), link, F.lit("]] {{ill|x|de|U"), "user_id", F.lit("}} [[File:x.png]]\nno bullet [[Other]]"))
    two = F.concat(F.lit("* "), link, F.lit("|shown]] and "), link, F.lit("#top]]\n** [[Sub "), "event_id", F.lit("]]"))
    lines = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), "event_type", "event_id", F.when(F.col("event_id") % 3 == 0, two).otherwise(one).alias("text"))
    heads = lines.select("date", "event_type").distinct().select("date", "event_type", F.lit(-1).cast("long").alias("event_id"), F.concat(F.lit("'''"), "event_type", F.lit("'''")).alias("text"))
    pages = lines.union(heads).groupBy("date").agg(F.array_sort(F.collect_list(F.struct("event_type", "event_id", "text"))).alias("x"))  # a page is one text
    return dumps.links_of_wikitext(pages.select("date", F.array_join("x.text", "\n").alias("text")))


@query("d13_entity_classes", """SELECT c_custkey AS qid, CASE WHEN c_mktsegment = 'BUILDING' THEN 'disaster' WHEN c_nationkey % 3 = 0 THEN 'sports' WHEN c_mktsegment = 'MACHINERY' THEN 'human' ELSE 'other' END AS entity_class FROM customer""")
def d13(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    claims = c.select(F.col("c_custkey").alias("qid"), F.array(F.col("c_mktsegment"), F.concat(F.lit("N"), (F.col("c_nationkey") % 3).cast("string"))).alias("p31"))
    classes = spark.createDataFrame([("BUILDING", "disaster", 1), ("N0", "sports", 2), ("MACHINERY", "human", 3)], "member string, entity_class string, priority int")
    return entities.classify(claims, classes)


@query("d14_died_near", """SELECT o_orderkey AS id, o_orderstatus = 'F' AND (date_diff('day', DATE '1998-01-01', o_orderdate::DATE) % 20) BETWEEN -1 AND 7 AS died_near FROM orders""")
def d14(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    gap = F.datediff(F.to_date("o_orderdate"), F.lit("1998-01-01").cast("date")) % 20
    start = F.to_date("o_orderdate")
    dates = F.array(F.date_format(F.date_sub(start, gap), "yyyy-MM-dd"), F.lit("no date"))
    return o.select(F.col("o_orderkey").alias("id"), entities.died_near(F.col("o_orderstatus") == "F", dates, start).alias("died_near"))


@query("d32_entity_titles", b.with_(b.HOURLY) + "SELECT qid, string_agg(lang || '=' || title, ';' ORDER BY lang, title) AS titles FROM links WHERE lang IN ('view', 'click', 'error') GROUP BY qid")
def d32(spark, sf_dir):
    rows = canonical.sitelinks(spark, sf_dir).filter(F.col("lang").isin("view", "click", "error"))
    found = entities.titles_by_language(rows)
    return found.select("qid", F.array_join(F.transform(F.array_sort(F.map_entries("titles")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("titles"))


@query("p9_json_claims", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS INT) IN (3, 5, 7) AS is_generic FROM events")
def p9(spark, sf_dir):
    claims = F.from_json("props", "k long")
    return table(spark, sf_dir, "events").select("event_id", claims["k"].alias("k"), F.arrays_overlap(F.array(claims["k"]), F.array(*[F.lit(x).cast("long") for x in (3, 5, 7)])).alias("is_generic"))
