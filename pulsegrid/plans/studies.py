"""Studies of events against entities, ground truth and edits."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from pulsegrid.operators import entities, evaluation, selection, studies
from pulsegrid.params import Events
from pulsegrid.plans import base as b
from pulsegrid.plans.evaluation import GT, ground_truth, majors
from pulsegrid.plans.registry import query
from pulsegrid.plans.selections import wide
from pulsegrid.plans.streams import CAND, EDITS, P, edit_rows
from pulsegrid.session import table
from pulsegrid.sources import canonical
from pulsegrid.streaming import bursts

_EV = b.with_(b.HOURLY, b.LOUD, b.event_sql(langs=2, threshold=1.2))

# ---------------------------------------------------------------- countries and languages
#: Entities are customers by their key; one in two has a country of its own, others a place.
_COUNTRIES = """claims AS (SELECT c_custkey AS qid, CASE WHEN c_custkey % 2 = 0 THEN [c_nationkey] ELSE [] END AS p17, [c_nationkey + 100] AS p276 FROM customer),
places AS (SELECT n_nationkey + 100 AS place, n_nationkey AS country FROM nation),
official AS (SELECT n_nationkey AS country, lang FROM nation, (VALUES ('view', 0), ('click', 1), ('purchase', 2), ('error', 3), ('signup', 4)) l(lang, i) WHERE (n_nationkey + i) % 2 = 0),
owned AS (SELECT qid, unnest(p17) AS country FROM claims UNION SELECT qid, country FROM (SELECT qid, unnest(p276) AS place FROM claims WHERE len(p17) = 0) JOIN places USING (place))"""


def _claims(spark, sf_dir):
    nation = F.col("c_nationkey").cast("long")
    none = F.array().cast("array<bigint>")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("qid"), F.when(F.col("c_custkey") % 2 == 0, F.array(nation)).otherwise(none).alias("p17"), F.array(nation + 100).alias("p276"))


def _official(spark, sf_dir):
    langs = spark.createDataFrame([("view", 0), ("click", 1), ("purchase", 2), ("error", 3), ("signup", 4)], "lang string, i int")
    pairs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("country"), F.explode(F.array(*map(F.lit, range(5)))).alias("i"))
    return pairs.join(langs, "i").filter((F.col("country") + F.col("i")) % 2 == 0).select("country", "lang")


@query("e8_lead_language", _EV + "," + _COUNTRIES + """, h AS (SELECT event_id, lead_lang, EXISTS (SELECT 1 FROM owned o JOIN official f USING (country) WHERE o.qid = ev.qid AND f.lang = ev.lead_lang) AS is_official FROM ev WHERE qid IN (SELECT qid FROM owned))
SELECT lead_lang, count(*) AS n, count(*) FILTER (WHERE is_official) AS n_official FROM h GROUP BY lead_lang""")
def e8(spark, sf_dir):
    places = table(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("long") + 100).alias("place"), F.col("n_nationkey").cast("long").alias("country"))
    owned = studies.entity_countries(_claims(spark, sf_dir), places)
    rows = studies.lead_is_official(wide(spark, sf_dir), owned, _official(spark, sf_dir))
    return rows.groupBy("lead_lang").agg(F.count("*").alias("n"), F.count_if("is_official").alias("n_official"))


@query("e23_resolved_country", """WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey % 25 END AS own, o_custkey % 11 AS state, [200 + o_custkey % 90, 100 + o_orderkey % 60, o_custkey % 31] AS places FROM orders),
s AS (SELECT id, own, state, unnest(list_reverse(places)) AS place, generate_subscripts(places, 1) AS pos FROM r),
k AS (SELECT id, pos, place, CASE WHEN place < 25 THEN place END AS itself, CASE WHEN place BETWEEN 100 AND 124 THEN place - 100 END AS holder FROM s)
SELECT r.id, coalesce(r.own, CASE WHEN r.state < 3 THEN r.state + 20 END, (SELECT arg_min(itself, pos) FROM k WHERE k.id = r.id AND itself IS NOT NULL), (SELECT arg_min(holder, pos) FROM k WHERE k.id = r.id AND holder IS NOT NULL)) AS country FROM r""")
def e23(spark, sf_dir):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(key.alias("id"), F.when(key % 7 == 0, cust % 25).alias("own"), (cust % 11).alias("state"), F.array(200 + cust % 90, 100 + key % 60, cust % 31).alias("places"))
    rules = spark.createDataFrame([(k, k + 20) for k in range(3)], "state long, country long")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"))
    places = n.select(F.col("n").alias("place"), F.lit(True).alias("is_country"), F.lit(None).cast("long").alias("country")).union(n.select(F.col("n") + 100, F.lit(False), F.col("n")))
    return studies.resolved_country(rows, rules, places)


# ---------------------------------------------------------------- delays and recall
@query("e9_detection_delay", _EV + "," + GT + """, d AS (SELECT (SELECT min(date_diff('hour', m.date::TIMESTAMP, e.start_hour)) FROM ev e WHERE e.qid = m.qid AND e.start_hour >= m.date - INTERVAL 24 HOUR AND e.start_hour < m.date + INTERVAL 48 HOUR) AS delay FROM majors m)
SELECT count(delay) AS n, quantile_cont(delay, 0.25) AS q25, quantile_cont(delay, 0.5) AS middle, quantile_cont(delay, 0.75) AS q75 FROM d""")
def e9(spark, sf_dir):
    return studies.quartiles(studies.detection_delays(majors(spark, sf_dir), wide(spark, sf_dir), 24), "delay")


VARIANTS = (2, 3, 5)
_TARGETS = "tg AS (SELECT o_orderkey AS id, substr(o_orderpriority, 1, 1) AS bucket, TIMESTAMP '2024-01-01' + to_hours(CAST(o_orderkey % 700 AS INT)) AS moment, [o_custkey % 40, (o_custkey + 1) % 40] AS qids FROM orders)"


def _anchored_sql() -> str:
    parts = [b.HOURLY, b.LOUD, *(b.event_sql(f"n{n}_", 0.8, n) for n in VARIANTS), _TARGETS]
    every = " UNION ALL ".join(f"SELECT {n} AS min_languages, id, bucket, moment, (SELECT min(start_hour) FROM n{n}_ev e WHERE e.qid IN (tg.qids[1], tg.qids[2]) AND e.start_hour BETWEEN tg.moment - to_hours(6) AND tg.moment + to_hours(24)) AS hit FROM tg" for n in VARIANTS)
    return b.with_(*parts, f"h AS ({every})") + """SELECT min_languages, bucket, count(*) AS targets, count(hit) AS found, round(count(hit) / count(*), 6) AS recall, median(date_diff('hour', moment, hit)) AS middle_delay FROM h GROUP BY ALL"""


@query("e10_anchored_recall", _anchored_sql())
def e10(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    at = F.expr("timestampadd(HOUR, int(o_orderkey % 700), TIMESTAMP_NTZ '2024-01-01 00:00:00')")
    targets = o.select(F.col("o_orderkey").alias("id"), F.substring("o_orderpriority", 1, 1).alias("bucket"), at.alias("at"), F.array(F.col("o_custkey") % 40, (F.col("o_custkey") + 1) % 40).alias("qids"))
    out = None
    for n in VARIANTS:
        found = evaluation.first_match(targets.drop("bucket"), b.event_rows(spark, sf_dir, replace(b.EVENTS, min_languages=n)), 6, 24)
        rows = targets.select("id", "bucket").join(found, "id").withColumn("delay", F.timestamp_diff("HOUR", "at", "start_hour"))
        rows = rows.groupBy(F.lit(n).alias("min_languages"), "bucket").agg(F.count("*").alias("targets"), F.count("event_id").alias("found"), F.round(F.count("event_id") / F.count("*"), b.R).alias("recall"), F.median("delay").alias("middle_delay"))
        out = rows if out is None else out.union(rows)
    return out


_ENTITY = "ent AS (SELECT qid, count(DISTINCT lang) AS n_languages, qid = 5 AS is_generic FROM links GROUP BY qid)"


@query("e12_major_links", b.with_(b.HOURLY, GT, _ENTITY) + "SELECT date, g.qid, section, coalesce(NOT is_generic AND n_languages >= 3, false) AS is_major, count(*) AS n FROM gt g LEFT JOIN ent USING (qid) GROUP BY ALL")
def e12(spark, sf_dir):
    known = canonical.sitelinks(spark, sf_dir).groupBy("qid").agg(F.countDistinct("lang").alias("n_languages")).withColumn("is_generic", F.col("qid") == 5)
    rows = studies.major_links(ground_truth(spark, sf_dir).drop("is_major"), known)
    return rows.groupBy("date", "qid", "section", "is_major").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- death lists
@query("e13_death_list", "SELECT strftime(o_orderdate::DATE, '%Y-%m') AS page, extract(day FROM o_orderdate::DATE)::INT AS day, 'Person ' || o_custkey AS title, count(*) AS n FROM orders WHERE o_orderstatus <> 'O' GROUP BY ALL")
def e13(spark, sf_dir):
    """A page a month: a heading a day, an entry an order; some entries have no link."""
    o = table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    name = F.concat(F.lit("[[Person "), "o_custkey", F.when(F.col("o_custkey") % 2 == 0, "|P]]").otherwise("]]"))
    entry = F.when(F.col("o_orderstatus") == "O", F.lit("* nobody, 80")).otherwise(F.concat(F.lit("* "), name, F.lit(", 80, of [[Old Town]]")))
    days = o.groupBy("d").agg(F.array_join(F.sort_array(F.collect_list(entry)), "\n").alias("entries"))
    text = F.sort_array(F.collect_list(F.struct("d", F.concat(F.lit("== "), F.dayofmonth("d"), F.lit(" ==\n"), "entries").alias("t"))))
    pages = days.groupBy(F.date_format("d", "yyyy-MM").alias("page")).agg(F.concat(F.lit("* [[Before]] any day\n"), F.array_join(F.transform(text, lambda x: x["t"]), "\n")).alias("text"))
    return studies.death_list(pages).groupBy("page", "day", "title").agg(F.count("*").alias("n"))


@query("e14_first_revision", "WITH " + GT + f""", t AS (SELECT DISTINCT 'T' || qid AS title, date FROM gt), rv AS (SELECT 'T' || (user_id % 8) AS title, ts FROM events WHERE event_id % {len(canonical.COMMENTS)} = {canonical.COMMENTS.index('he died today')})
SELECT title, date, (SELECT min(ts) FROM rv WHERE rv.title = t.title AND rv.ts >= t.date - INTERVAL 1 DAY AND rv.ts < t.date + INTERVAL 2 DAY) AS first FROM t""")
def e14(spark, sf_dir):
    e = canonical.changes(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts")), "event_id")
    targets = ground_truth(spark, sf_dir).select(F.concat(F.lit("T"), "qid").alias("title"), "date").distinct()
    return studies.first_revision(targets, e, r"\b(died|death|dies)\b")


# ---------------------------------------------------------------- audit
_SAMPLE = "smp AS (SELECT event_id, qid, start_hour FROM ev ORDER BY md5('audit|' || event_id) LIMIT 10)"


@query("e15_audit_sheet", _EV + "," + _SAMPLE + """, v AS (SELECT CAST(substr(title, 2) AS BIGINT) AS qid, ts_hour, sum(views) AS views FROM stg GROUP BY ALL),
g AS (SELECT event_id, i, coalesce(views, 0) AS views FROM smp CROSS JOIN range(-48, 48) r(i) LEFT JOIN v ON v.qid = smp.qid AND v.ts_hour = smp.start_hour + to_hours(i::INT)) SELECT event_id, string_agg(views, ' ' ORDER BY i) AS series FROM g GROUP BY event_id""")
def e15_sheet(spark, sf_dir):
    """The sheet shows a sample by a seeded hash, without what the events were called."""
    sample = wide(spark, sf_dir).orderBy(F.md5(F.concat(F.lit("audit|"), "event_id"))).limit(10)
    rows = b.stg(spark, sf_dir).withColumn("qid", F.substring("title", 2, 9).cast("long"))
    return studies.series(sample, rows)


@query("e15_audit_scores", _EV + "," + _SAMPLE + """, l AS (SELECT event_id, qid % 3 <> 0 AS is_real FROM smp) SELECT count(*) AS n, count(*) FILTER (WHERE is_real) AS n_real, round(count(*) FILTER (WHERE is_real) / count(*), 6) AS share,
CASE WHEN count(*) < 5 THEN 'inconclusive' WHEN count(*) FILTER (WHERE is_real) / count(*) >= 0.6 THEN 'supported' ELSE 'rejected' END AS verdict FROM l""")
def e15_scores(spark, sf_dir):
    sample = wide(spark, sf_dir).orderBy(F.md5(F.concat(F.lit("audit|"), "event_id"))).limit(10)
    labels = sample.select("event_id", (F.col("qid") % 3 != 0).alias("is_real"))
    rows = sample.join(labels, "event_id").agg(F.count("*").alias("n"), F.count_if("is_real").alias("n_real"))
    share = F.col("n_real") / F.col("n")
    return rows.select("n", "n_real", F.round(share, b.R).alias("share"), evaluation.verdict(share, 0.6, F.col("n"), 5).alias("verdict"))


# ---------------------------------------------------------------- edits and events
_BURSTS = EDITS + "," + CAND + ", bq AS (SELECT CAST(substr(title, 2) AS BIGINT) AS qid, lang, second FROM pick WHERE second IS NOT NULL)"
_EVB = "WITH RECURSIVE " + ",".join([b.HOURLY, b.LOUD, b.event_sql(langs=2, threshold=1.2), _BURSTS])


def _bursts(spark, sf_dir):
    return bursts.bursts(edit_rows(spark, sf_dir), P).withColumn("qid", F.substring("title", 2, 9).cast("long"))


@query("e17_edit_leads", _EVB + """, ld AS (SELECT lead_lang, (SELECT floor((epoch(ev.start_hour) - min(bq.second)) / 60)::BIGINT FROM bq WHERE bq.qid = ev.qid AND abs(bq.second - epoch(ev.start_hour)) <= 86400) AS m FROM ev)
SELECT coalesce(lead_lang, 'all') AS category, count(m) AS n, quantile_cont(m, 0.25) AS q25, quantile_cont(m, 0.5) AS middle, quantile_cont(m, 0.75) AS q75 FROM ld GROUP BY GROUPING SETS ((), (lead_lang)) HAVING count(m) >= 2""")
def e17(spark, sf_dir):
    leads = studies.edit_leads(wide(spark, sf_dir), _bursts(spark, sf_dir))
    both = leads.select(F.explode(F.array("lead_lang", F.lit("all"))).alias("category"), "lead_minutes")
    return studies.quartiles(both, "lead_minutes", "category", least=2)


@query("e18_burst_precision", _EVB + """, lv AS (SELECT qid, s AS lo, lead(s) OVER w AS hi FROM (SELECT qid, lang, min(second) AS s FROM bq GROUP BY ALL) WINDOW w AS (PARTITION BY qid ORDER BY s, lang)),
k AS (SELECT bq.*, EXISTS (SELECT 1 FROM lv WHERE lv.qid = bq.qid AND hi - lo <= 86400) AS live, EXISTS (SELECT 1 FROM ev WHERE ev.qid = bq.qid AND ev.start_hour BETWEEN time_bucket(INTERVAL 1 HOUR, to_timestamp(second)::TIMESTAMP) - INTERVAL 2 HOUR AND time_bucket(INTERVAL 1 HOUR, to_timestamp(second)::TIMESTAMP) + INTERVAL 24 HOUR) AS hit FROM bq)
SELECT live, count(*) AS n, count(*) FILTER (WHERE hit) AS hits, round(avg(hit::INT), 6) AS "precision" FROM k GROUP BY live""")
def e18(spark, sf_dir):
    rows = _bursts(spark, sf_dir).select("qid", "lang", "title", "second")
    live = bursts.live_events(rows, 1440).select("qid", F.lit(True).alias("live"))
    marked = studies.burst_hits(rows, wide(spark, sf_dir)).join(live, "qid", "left").withColumn("live", F.coalesce("live", F.lit(False)))
    return marked.groupBy("live").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.round(F.count_if("hit") / F.count("*"), b.R).alias("precision"))


@query("e25_first_edit", _EV + """, ed AS (SELECT user_id % 8 AS qid, floor(epoch(ts))::BIGINT AS second FROM events), f AS (SELECT event_id, (SELECT min(floor((second - epoch(start_hour)) / 60)) FROM ed WHERE ed.qid = ev.qid AND second >= epoch(start_hour) AND second < epoch(start_hour) + 86400)::BIGINT AS m FROM ev)
SELECT event_id, m AS edit_minutes, 105 - m AS lead_minutes FROM f WHERE m IS NOT NULL""")
def e25(spark, sf_dir):
    rows = edit_rows(spark, sf_dir).withColumn("qid", F.substring("title", 2, 9).cast("long"))
    return studies.first_edit_after(wide(spark, sf_dir), rows, 45)


# ---------------------------------------------------------------- entities and products
LOOSEST = Events(r3_threshold=0.8, min_languages=2, window_hours=12)


@query("d16_entities", b.with_(b.HOURLY, b.LOUD, b.event_sql(langs=2, window=12)) + """SELECT q.qid, string_agg(lang || '=' || title, ',' ORDER BY lang) AS labels, count(lang) AS n_languages FROM (SELECT DISTINCT qid FROM ev) q LEFT JOIN links USING (qid) GROUP BY q.qid""")
def d16(spark, sf_dir):
    """Entities of the loosest setting, with their titles by language."""
    ids = b.event_rows(spark, sf_dir, LOOSEST).select("qid").distinct()
    rows = ids.join(entities.titles_by_language(canonical.sitelinks(spark, sf_dir)), "qid", "left")
    pairs = F.sort_array(F.transform(F.map_entries("titles"), lambda x: F.concat_ws("=", x["key"], x["value"])))
    return rows.select("qid", F.nullif(F.array_join(F.coalesce(pairs, F.array().cast("array<string>")), ","), F.lit("")).alias("labels"), F.coalesce(F.map_size("titles") if hasattr(F, "map_size") else F.size(F.map_keys("titles")), F.lit(0)).cast("long").alias("n_languages"))


@query("d24_latest", _EV + """, r AS (SELECT event_id, qid, breadth FROM ev WHERE start_hour > (SELECT max(start_hour) FROM ev) - INTERVAL 240 HOUR ORDER BY breadth DESC, peak_intensity DESC, event_id LIMIT 50)
SELECT event_id, breadth, (SELECT min(title) FROM links WHERE links.qid = r.qid AND lang = 'view') AS label FROM r""")
def d24(spark, sf_dir):
    rows = selection.latest(wide(spark, sf_dir), 240).orderBy(F.desc("breadth"), F.desc("peak_intensity"), "event_id").limit(50)
    labels = entities.titles_by_language(canonical.sitelinks(spark, sf_dir))
    return rows.join(labels, "qid", "left").select("event_id", "breadth", F.col("titles")["view"].alias("label"))


@query("d25_catch_up", b.with_(b.HOURLY) + "SELECT h AS ts_hour FROM range(TIMESTAMP '2024-01-24', TIMESTAMP '2024-01-31', INTERVAL 1 HOUR) r(h) WHERE h NOT IN (SELECT ts_hour FROM stg WHERE lang = 'click' AND title = 'T3') ORDER BY h DESC LIMIT 12")
def d25(spark, sf_dir):
    """The last 168 hours that are missing, newest first, twelve at once."""
    present = b.stg(spark, sf_dir).filter("lang = 'click' AND title = 'T3'")
    return selection.catch_up(present, F.lit("2024-01-30 23:00:00").cast("timestamp_ntz"), 168, 12)


@query("d30_projects", """SELECT CASE WHEN event_id % 2 = 1 THEN 'm' ELSE '' END AS suffix, count(*) AS n_rows, CAST(sum(floor(value * 10)) AS BIGINT) AS views, count(DISTINCT user_id % 40) AS titles FROM events GROUP BY ALL""")
def d30(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("project", F.concat("event_type", F.when(F.col("event_id") % 2 == 1, ".m").otherwise("")))
    suffix = F.when(F.contains("project", F.lit(".")), F.substring_index("project", ".", -1)).otherwise("")
    return e.groupBy(suffix.alias("suffix")).agg(F.count("*").alias("n_rows"), F.sum(F.floor(F.col("value") * 10)).alias("views"), F.countDistinct(F.col("user_id") % 40).alias("titles"))


@query("d31_top_languages", b.with_(b.HOURLY) + """, s AS (SELECT lang, sum(views) AS v FROM stg GROUP BY lang), r AS (SELECT v, row_number() OVER (ORDER BY v DESC, lang) AS k FROM s)
SELECT n AS top, round((SELECT sum(v) FROM r WHERE k <= n) / (SELECT sum(v) FROM r), 6) AS share FROM (VALUES (1), (2), (3), (5)) t(n)""")
def d31(spark, sf_dir):
    return selection.top_shares(b.stg(spark, sf_dir), "lang", (1, 2, 3, 5)).withColumn("share", F.round("share", b.R))


@query("d15_gender", "SELECT p_partkey AS qid, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN 'female' WHEN p_size % 5 = 2 THEN 'male' ELSE 'other' END AS gender FROM part")
def d15(spark, sf_dir):
    kinds = {1: [6581072, 1052281], 2: [6581097], 3: [6581072, 6581097], 4: [48270]}
    values = F.lit(None).cast("array<bigint>")
    for k, own in kinds.items():
        values = F.when(F.col("p_size") % 5 == k, F.array(*[F.lit(x).cast("long") for x in own])).otherwise(values)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("qid"), entities.gender(values, [6581072, 1052281], [6581097, 2449503]).alias("gender"))


@query("p11_event_cards", _EV + """SELECT event_id FROM ev WHERE tier IN ('noticed', 'international', 'planetary') AND 'click' IN (SELECT unnest(string_split(languages, ','))) AND qid IN (SELECT qid FROM links WHERE lower(title) LIKE '%t3%') AND qid % 2 = 1""")
def p11(spark, sf_dir):
    labels = entities.titles_by_language(canonical.sitelinks(spark, sf_dir)).withColumnRenamed("titles", "labels")
    rows = wide(spark, sf_dir).join(labels, "qid").withColumn("category", F.when(F.col("qid") % 2 == 1, "odd").otherwise("even"))
    return studies.cards(rows, "noticed", "Ť3", "odd", "click").select("event_id")


@query("d14_categories", """SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 <> 0 AND o_orderkey % 4 = 0 AND date_diff('day', (o_orderdate::DATE - (o_custkey % 12 - 2)::INT), o_orderdate::DATE) BETWEEN -1 AND 7 THEN 'death' ELSE CASE o_custkey % 3 WHEN 0 THEN 'place' WHEN 1 THEN 'person' ELSE 'work' END END AS category FROM orders""")
def d14(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("place"), F.lit("person"), F.lit("work")), (F.col("o_custkey") % 3 + 1).cast("int"))
    day = F.to_date("o_orderdate")
    died = F.date_format(F.date_sub(day, (F.col("o_custkey") % 12 - 2).cast("int")), "yyyy-MM-dd")
    dates = F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit("1900-00-00"), died)).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), kind.alias("kind"), day.alias("day"), dates.alias("dates"))
    return rows.select("id", entities.category(F.col("kind"), F.col("kind") != "place", F.col("dates"), F.col("day")).alias("category"))


@query("d3_rank_channels", b.with_(b.HOURLY) + """, t AS (SELECT lang, title, sum(views) AS v, sum(views_mobile) AS m FROM stg WHERE day BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' GROUP BY ALL),
k AS (SELECT *, NOT (title = 'T7' OR (title = 'T6' AND lang IN ('view', 'error'))) AS article FROM t), f AS (SELECT *, article AND v > 1000 AND m < 0.45 * v AS auto FROM k),
s AS (SELECT lang, CAST(sum(v) AS BIGINT) AS raw_views, CAST(coalesce(sum(v) FILTER (WHERE article AND NOT auto), 0) AS BIGINT) AS human_views, coalesce(sum(m) FILTER (WHERE article AND NOT auto), 0) AS mob, coalesce(sum(v) FILTER (WHERE auto), 0) AS av, coalesce(sum(v) FILTER (WHERE NOT article), 0) AS na FROM f GROUP BY lang)
SELECT * FROM (SELECT lang, row_number() OVER (ORDER BY human_views DESC, lang)::INT AS rank, row_number() OVER (ORDER BY raw_views DESC, lang)::INT AS raw_rank, raw_views, human_views, round(mob / nullif(human_views, 0), 6) AS mobile_share,
round(av / raw_views, 6) AS automated_share, round(na / raw_views, 6) AS non_article_share, round(sum(human_views) OVER (ORDER BY human_views DESC, lang ROWS UNBOUNDED PRECEDING) / sum(human_views) OVER (), 6) AS cumulative_share FROM s) WHERE rank <= 4""")
def d3(spark, sf_dir):
    """The threshold of mobile views is raised for the test tables, where nearly half of all views are mobile."""
    langs = ("view", "click", "purchase", "error", "signup")
    excluded = spark.createDataFrame([(k, "T7") for k in langs] + [("view", "T6"), ("error", "T6")], "lang string, title string")
    rows = selection.rank_channels(b.stg(spark, sf_dir), "2024-01-08", excluded, 4, least_mobile=0.45)
    return rows.withColumns({c: F.round(c, b.R) for c in ("mobile_share", "automated_share", "non_article_share", "cumulative_share")})


@query("s13_day_documents", _EV + """, d AS (SELECT ev.start_hour::DATE AS day, ev.event_id, ev.lead_lang, el.lang, el.spread_lag_hours FROM ev JOIN el USING (event_id))
SELECT day, (SELECT count(*) FROM ev WHERE ev.start_hour::DATE = d.day) AS n_events, event_id, lead_lang, lang, spread_lag_hours FROM d""")
def s13_documents(spark, sf_dir):
    """Documents are written as text by day, read again and taken apart."""
    from pulsegrid.operators import events
    from pulsegrid.plans.selections import WIDE
    from pulsegrid.session import scratch

    langs = b.languages(spark, sf_dir, WIDE)
    path = scratch(spark, "days")
    selection.day_documents(events.attention_events(langs, WIDE), langs).write.partitionBy("day").text(path)
    schema = "struct<summary:struct<events:long,tiers:map<string,long>,hourly:array<long>>,events:array<struct<id:string,qid:long,lead:string,breadth:long,tier:string,langs:array<struct<spread_lag_hours:long,lang:string>>>>>"
    back = spark.read.text(path).select(F.col("day").cast("date").alias("day"), F.from_json("value", schema).alias("j"))
    each = back.select("day", F.col("j.summary.events").alias("n_events"), F.explode("j.events").alias("e"))
    return each.select("day", "n_events", F.col("e.id").alias("event_id"), F.col("e.lead").alias("lead_lang"), F.explode("e.langs").alias("l")).select("day", "n_events", "event_id", "lead_lang", "l.lang", "l.spread_lag_hours")


@query("p6_row_value_in", b.with_(b.HOURLY) + "SELECT lang, title, ts_hour, views FROM stg WHERE (lang, title) IN (SELECT lang, title FROM stg WHERE views >= 1500)")
def p6(spark, sf_dir):
    b.stg(spark, sf_dir).createOrReplaceTempView("staged")
    return spark.sql("SELECT lang, title, ts_hour, views FROM staged WHERE (lang, title) IN (SELECT lang, title FROM staged WHERE views >= 1500)")


@query("f16_claims", """SELECT p_partkey AS qid, CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN '5' ELSE '5,' || p_size END AS p31, CASE WHEN p_size % 3 = 0 THEN '30' ELSE '' END AS p17,
CASE WHEN p_size % 5 = 0 THEN '1999-0' || (1 + p_size % 9) || '-11' ELSE '' END AS died FROM part""")
def f16(spark, sf_dir):
    """Entity documents in JSON: some claims are missing, some values are no items, some dates are a year alone."""
    size = F.col("p_size")
    claim = lambda v: F.concat(F.lit('{"mainsnak":{"datavalue":{"value":"'), v, F.lit('"}}}'))
    kinds = F.when(size % 4 == 0, claim(F.lit("somevalue"))).when(size % 4 == 1, claim(F.lit("Q5"))).otherwise(F.concat(claim(F.lit("Q5")), F.lit(","), claim(F.concat(F.lit("Q"), size))))
    died = F.when(size % 5 == 0, claim(F.concat(F.lit("+1999-0"), 1 + size % 9, F.lit("-11T00:00:00Z")))).otherwise(claim(F.lit("+1999-00-00T00:00:00Z")))
    land = F.when(size % 3 == 0, F.lit(',"P17":[{"mainsnak":{"datavalue":{"value":"Q30"}}}]')).otherwise("")
    body = F.concat(F.lit('{"claims":{"P31":['), kinds, F.lit('],"P570":['), died, F.lit("]"), land, F.lit("}}"))
    rows = entities.claims_of(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("qid"), body.alias("body")))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return rows.select("qid", joined("p31").alias("p31"), joined("p17").alias("p17"), joined("dates_of_death").alias("died"))


@query("e20_leakage_guard", _EV + """, x AS (SELECT e.event_id, l.lang, date_diff('hour', e.start_hour, l.ts_hour) AS h FROM ev e JOIN loud l ON l.qid = e.qid AND l.ts_hour >= e.start_hour AND l.ts_hour < e.start_hour + INTERVAL 24 HOUR WHERE l.surprise >= 1.2),
f AS (SELECT event_id, lang, min(h) AS first FROM x GROUP BY ALL), d AS (SELECT event_id, list_sort(list(first))[2] AS t0 FROM f GROUP BY event_id HAVING count(*) >= 2) SELECT count(*) AS snapshots, 0::BIGINT AS violations FROM d, (VALUES (0), (1), (3)) o(k) WHERE t0 + k < 24""")
def e20_guard(spark, sf_dir):
    """Snapshots whose breadth is not what the spikes up to their own hour say."""
    from pulsegrid.operators import snapshots

    loud = b.loud(spark, sf_dir)
    snaps = snapshots.snapshots(wide(spark, sf_dir), loud, 1.2).select("snapshot_id", "qid", "start_hour", "snapshot_ts", "breadth_t")
    spikes = loud.filter("surprise >= 1.2").select("qid", F.col("lang").alias("l"), "ts_hour")
    raw = snaps.join(spikes, "qid").filter("ts_hour >= start_hour AND ts_hour <= snapshot_ts AND ts_hour < start_hour + INTERVAL 24 HOURS")
    own = raw.groupBy("snapshot_id").agg(F.countDistinct("l").alias("n"))
    return snaps.join(own, "snapshot_id", "left").agg(F.count("*").alias("snapshots"), F.count_if(F.coalesce("n", F.lit(0)) != F.col("breadth_t")).alias("violations"))


@query("e16_agreement_by_hour", b.with_(b.HOURLY, b.FLAGS, b.CALENDAR, b.PRIORS, b.SCORED, b.SPIKES) + """, a AS (SELECT ts_hour, lang, title FROM spikes WHERE surprise >= 0.8), z AS (SELECT ts_hour, lang, title FROM stg WHERE views >= 500)
SELECT coalesce(a.ts_hour, z.ts_hour)::DATE AS day, count(a.lang) AS n_batch, count(z.lang) AS n_live, count(*) FILTER (WHERE a.lang IS NOT NULL AND z.lang IS NOT NULL) AS n_both FROM a FULL JOIN z ON a.ts_hour = z.ts_hour AND a.lang = z.lang AND a.title = z.title GROUP BY 1""")
def e16_hours(spark, sf_dir):
    """Spikes of the batch against a plain threshold on views, by day."""
    a = b.spikes(spark, sf_dir).filter("surprise >= 0.8").select("ts_hour", "lang", "title", F.lit(1).alias("a"))
    z = b.stg(spark, sf_dir).filter("views >= 500").select("ts_hour", "lang", "title", F.lit(1).alias("z"))
    rows = a.join(z, ["ts_hour", "lang", "title"], "full").groupBy(F.to_date("ts_hour").alias("day"))
    return rows.agg(F.count("a").alias("n_batch"), F.count("z").alias("n_live"), F.count_if(F.col("a").isNotNull() & F.col("z").isNotNull()).alias("n_both"))
