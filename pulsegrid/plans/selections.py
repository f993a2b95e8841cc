"""Top-k, rollups, set comparisons, windows and sketches over counts and events."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsegrid.functions import robust
from pulsegrid.operators import evaluation, quantiles, selection, staging
from pulsegrid.plans import base as b
from pulsegrid.plans.registry import query
from pulsegrid.session import table
from pulsegrid.sources import canonical
from pulsegrid.streaming.bursts import hashed_user

WIDE = replace(b.EVENTS, min_languages=2, r3_threshold=1.2)
_EV = b.with_(b.HOURLY, b.LOUD, b.event_sql(langs=2, threshold=1.2))


def wide(spark, sf_dir):
    return b.event_rows(spark, sf_dir, WIDE)


@query("t1_top_articles", b.with_(b.HOURLY) + f"SELECT title, views, round(100 * mobile_share, 1) AS mobile_percent FROM stg WHERE lang = 'view' AND ts_hour = TIMESTAMP '{b.HOUR}' ORDER BY views DESC, title LIMIT 5")
def t1(spark, sf_dir):
    rows = b.stg(spark, sf_dir).filter((F.col("lang") == "view") & (F.col("ts_hour") == F.lit(b.HOUR).cast("timestamp_ntz")))
    return rows.orderBy(F.desc("views"), "title").limit(5).select("title", "views", F.round(100 * F.col("mobile_share"), 1).alias("mobile_percent"))


@query("t2_latest_events_by_class", _EV + """, c AS (SELECT *, CASE WHEN lead_excess_share >= 0.95 THEN 'single_language' ELSE 'multi_language' END AS event_class FROM ev),
r AS (SELECT event_class, event_id, breadth, row_number() OVER (PARTITION BY event_class ORDER BY breadth DESC, peak_intensity DESC, event_id) AS rank FROM c WHERE start_hour > (SELECT max(start_hour) FROM ev) - INTERVAL 240 HOUR)
SELECT event_class, event_id, breadth, rank FROM r WHERE rank <= 50""")
def t2(spark, sf_dir):
    rows = wide(spark, sf_dir)
    last = rows.agg(F.max("start_hour").alias("last")).withColumn("k", F.lit(1))  # one row
    recent = rows.withColumn("k", F.lit(1)).join(F.broadcast(last), "k").filter(F.col("start_hour") > F.expr("last - INTERVAL 240 HOURS"))
    top = selection.top_rows(recent, 50, [F.desc("breadth"), F.desc("peak_intensity"), F.col("event_id")], "event_class")
    return top.select("event_class", "event_id", "breadth", "rank")


@query("t3_event_selection", _EV + """SELECT event_id FROM ev QUALIFY row_number() OVER (PARTITION BY start_hour::DATE ORDER BY breadth DESC, peak_intensity DESC, event_id) <= 2
OR row_number() OVER (PARTITION BY start_hour::DATE ORDER BY excess_views DESC, event_id) <= 1 OR row_number() OVER (PARTITION BY start_hour::DATE, lead_lang ORDER BY breadth DESC, peak_intensity DESC, event_id) <= 1""")
def t3(spark, sf_dir):
    return selection.selected_events(wide(spark, sf_dir), 2, 1, 1).select("event_id")


@query("t4_hero", _EV + """, a AS (SELECT *, date_diff('hour', start_hour, TIMESTAMP '2024-01-30 12:00:00') AS age FROM ev)
SELECT CASE WHEN age < 24 THEN 0 WHEN age < 48 THEN 1 ELSE 2 END AS "window", event_id FROM a WHERE age >= 0 AND age < 168 AND (excess_views >= 2000 OR tier IN ('international', 'planetary'))
ORDER BY 1, excess_views DESC, breadth DESC, event_id LIMIT 1""")
def t4(spark, sf_dir):
    return selection.hero(wide(spark, sf_dir), F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"), excess=2000)


@query("t6_seeded_sample", b.with_(b.HOURLY) + """, pool AS (SELECT lang, title, ts_hour, views FROM stg ORDER BY views DESC, lang, title, ts_hour LIMIT 1000)
SELECT lang, title, ts_hour, views FROM pool ORDER BY md5('seed|' || lang || '|' || title || '|' || strftime(ts_hour, '%Y-%m-%d %H')) LIMIT 100""")
def t6(spark, sf_dir):
    pool = b.stg(spark, sf_dir).orderBy(F.desc("views"), "lang", "title", "ts_hour").limit(1000)
    key = F.md5(F.concat_ws("|", F.lit("seed"), "lang", "title", F.date_format("ts_hour", "yyyy-MM-dd HH")))
    return pool.orderBy(key).limit(100).select("lang", "title", "ts_hour", "views")


@query("t8_day_facts", _EV + """SELECT start_hour::DATE AS day, first(event_id ORDER BY breadth DESC, event_id) AS widest, first(event_id ORDER BY max_spread_lag_hours, event_id) FILTER (WHERE breadth >= 3) AS fastest,
first(event_id ORDER BY excess_views DESC, event_id) FILTER (WHERE lead_lang <> 'view') AS top_other FROM ev GROUP BY ALL""")
def t8(spark, sf_dir):
    pick = lambda order, when: F.min(F.when(when, F.struct(order.alias("o"), "event_id")))["event_id"]
    return wide(spark, sf_dir).groupBy(F.to_date("start_hour").alias("day")).agg(
        pick(-F.col("breadth"), F.lit(True)).alias("widest"),
        pick(F.col("max_spread_lag_hours"), F.col("breadth") >= 3).alias("fastest"),
        pick(-F.col("excess_views"), F.col("lead_lang") != "view").alias("top_other"),
    )


@query("t9_lead_counts", _EV + "SELECT lead_lang, count(*) AS n FROM ev GROUP BY ALL ORDER BY n DESC, lead_lang")
def t9(spark, sf_dir):
    return wide(spark, sf_dir).groupBy("lead_lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lead_lang")


@query("t7_spread_order", b.with_(b.HOURLY, b.LOUD, b.event_sql()) + "SELECT event_id, string_agg(lang, '>' ORDER BY spread_lag_hours, excess_views DESC, lang) AS spread FROM el GROUP BY ALL")
def t7(spark, sf_dir):
    steps = F.sort_array(F.collect_list(F.struct("spread_lag_hours", (-F.col("excess_views")).alias("e"), "lang")))
    return b.languages(spark, sf_dir).groupBy("event_id").agg(F.concat_ws(">", steps["lang"]).alias("spread"))


@query("d22_sparklines", _EV + """, g AS (SELECT event_id, qid, i, start_hour - INTERVAL 24 HOUR + to_hours(i) AS ts FROM ev, range(48) r(i)),
q AS (SELECT CAST(substr(title, 2) AS BIGINT) AS qid, ts_hour, sum(views) AS v FROM stg GROUP BY ALL)
SELECT event_id, string_agg(CASE WHEN ts > TIMESTAMP '2024-01-29 00:00:00' THEN '-' ELSE CAST(coalesce(v, 0) AS VARCHAR) END, ',' ORDER BY i) AS spark FROM g LEFT JOIN q ON q.qid = g.qid AND q.ts_hour = g.ts GROUP BY ALL""")
def d22(spark, sf_dir):
    views = b.stg(spark, sf_dir).select(F.substring("title", 2, 9).cast("long").alias("qid"), "ts_hour", "views")
    rows = selection.sparklines(wide(spark, sf_dir), views, F.lit("2024-01-29 00:00:00").cast("timestamp_ntz"))
    text = F.transform("spark", lambda v: F.coalesce(v.cast("string"), F.lit("-")))
    return rows.select("event_id", F.concat_ws(",", text).alias("spark"))


@query("d23_day_summary", _EV + """SELECT start_hour::DATE AS day, count(*) AS events, count(*) FILTER (WHERE tier = 'planetary') AS planetary, count(*) FILTER (WHERE tier = 'international') AS international,
count(*) FILTER (WHERE tier = 'noticed') AS noticed, array_to_string([(SELECT count(*) FROM ev e WHERE e.start_hour = ev.start_hour::DATE + to_hours(h)) FOR h IN range(24)], ',') AS hourly FROM ev GROUP BY ALL""".replace(
    "array_to_string([(SELECT count(*) FROM ev e WHERE e.start_hour = ev.start_hour::DATE + to_hours(h)) FOR h IN range(24)], ',')",
    "array_to_string([" + ", ".join(f"count(*) FILTER (WHERE hour(start_hour) = {h})" for h in range(24)) + "], ',')",
))
def d23(spark, sf_dir):
    return selection.day_summary(wide(spark, sf_dir)).withColumn("hourly", F.concat_ws(",", F.col("hourly").cast("array<string>")))


@query("g12_language_rollup", b.with_(b.HOURLY, b.FLAGS) + """, s AS (SELECT lang, CAST(sum(views) AS BIGINT) AS raw_views, CAST(coalesce(sum(views) FILTER (WHERE NOT coalesce(is_low_mobile OR is_flat, false)), 0) AS BIGINT) AS human_views
FROM stg LEFT JOIN flagged USING (lang, title, day) GROUP BY ALL) SELECT lang, raw_views, human_views, raw_views - human_views AS automated_views, CAST(row_number() OVER w AS INT) AS rank,
round(sum(human_views) OVER (ORDER BY human_views DESC, lang ROWS UNBOUNDED PRECEDING) / sum(human_views) OVER (), 6) AS cumulative_share FROM s WINDOW w AS (ORDER BY human_views DESC, lang)""")
def g12(spark, sf_dir):
    stg = b.stg(spark, sf_dir)
    flags = staging.automation_flags(stg, b.AUTOMATION).select("lang", "title", "day", "is_automated")
    rows = stg.join(flags, ["lang", "title", "day"], "left").withColumn("is_automated", F.coalesce("is_automated", F.lit(False)))
    return selection.rollup_by_language(rows).withColumn("cumulative_share", F.round("cumulative_share", b.R))


#: Events as they come from scored rows have classes; here every third entity's stay in one language.
_CLASSED = """, cl AS (SELECT *, CASE WHEN qid % 3 = 0 THEN 'single_language' ELSE 'multi_language' END AS kind FROM ev),
pl AS (SELECT day, lang, sum(events) AS events, sum(lead) AS lead, sum(excess) AS excess, sum(only_here) AS only_here FROM (
  SELECT cl.start_hour::DATE AS day, el.lang, 1 AS events, 0 AS lead, floor(el.excess_views) AS excess, 0 AS only_here FROM cl JOIN el USING (event_id) WHERE kind = 'multi_language'
  UNION ALL SELECT start_hour::DATE, lead_lang, 0, 1, 0, 0 FROM cl WHERE kind = 'multi_language' UNION ALL SELECT start_hour::DATE, lead_lang, 0, 0, 0, 1 FROM cl WHERE kind = 'single_language') GROUP BY ALL)"""


def classed(spark, sf_dir):
    """Events with their classes, their languages, and the sums of each day and language."""
    langs = b.languages(spark, sf_dir, WIDE)
    rows = wide(spark, sf_dir).withColumn("event_class", F.when(F.col("qid") % 3 == 0, "single_language").otherwise("multi_language"))
    return rows, selection.language_summary(rows, langs)


@query("d23_language_summary", _EV + _CLASSED + " SELECT day, lang, CAST(events AS BIGINT) AS events, CAST(lead AS BIGINT) AS lead, CAST(excess AS BIGINT) AS excess, CAST(only_here AS BIGINT) AS only_here FROM pl")
def d23_languages(spark, sf_dir):
    return classed(spark, sf_dir)[1]


@query("g13_totals", _EV + _CLASSED + """ SELECT lang, CAST(sum(events) AS BIGINT) AS events, CAST(sum(lead) AS BIGINT) AS lead, CAST(sum(excess) AS BIGINT) AS excess, CAST(sum(only_here) AS BIGINT) AS only_here,
round(sum(lead) / (SELECT count(*) FROM cl WHERE kind = 'multi_language'), 4) AS lead_share FROM pl GROUP BY lang""")
def g13(spark, sf_dir):
    rows, days = classed(spark, sf_dir)
    return selection.period_totals(days, rows.filter("event_class <> 'single_language'").count())


@query("g13_timeline", _EV + _CLASSED + """ SELECT start_hour::DATE AS day, hour(start_hour)::INT AS hour, count(*) FILTER (WHERE kind = 'multi_language') AS events, count(*) FILTER (WHERE kind = 'multi_language' AND tier = 'planetary') AS planetary,
count(*) FILTER (WHERE kind = 'multi_language' AND tier = 'international') AS international, count(*) FILTER (WHERE kind = 'multi_language' AND tier = 'noticed') AS noticed, count(*) FILTER (WHERE kind = 'single_language') AS single_language FROM cl GROUP BY ALL""")
def g13_timeline(spark, sf_dir):
    rows, _ = classed(spark, sf_dir)
    several = F.col("event_class") != "single_language"
    tiers = [F.count_if(several & (F.col("tier") == t)).alias(t) for t in ("planetary", "international", "noticed")]
    return rows.groupBy(F.to_date("start_hour").alias("day"), F.hour("start_hour").alias("hour")).agg(F.count_if(several).alias("events"), *tiers, F.count_if(~several).alias("single_language"))


@query("g14_hourly_histogram", b.with_(b.HOURLY) + "SELECT h.h::INT AS hour_of_day, count(s.lang) AS n, CAST(coalesce(sum(views), 0) AS BIGINT) AS views FROM range(24) h(h) LEFT JOIN stg s ON s.hour_of_day = h.h GROUP BY ALL")
def g14(spark, sf_dir):
    hours = spark.range(24).select(F.col("id").cast("int").alias("hour_of_day"))
    sums = b.stg(spark, sf_dir).groupBy("hour_of_day").agg(F.count("*").alias("n"), F.sum("views").alias("views"))
    return hours.join(sums, "hour_of_day", "left").na.fill(0, ["n", "views"])


@query("g15_linear_counting", """WITH b AS (SELECT event_type AS lang, date_trunc('day', ts) AS day, bit_or(1::BIGINT << (user_id % 63)::INT) AS bits FROM events GROUP BY ALL)
SELECT lang, day::DATE AS day, CAST(bit_count(bits) AS INT) AS ones, round(CASE WHEN bit_count(bits) >= 63 THEN 63.0 ELSE -63 * ln(1 - bit_count(bits) / 63) END, 6) AS estimate FROM b""")
def g15(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("lang"), F.to_date("ts").alias("day")).agg(robust.bitmap(F.col("user_id"), 63).alias("bits"))
    return rows.select("lang", "day", F.bit_count("bits").alias("ones"), F.round(robust.linear_count(F.col("bits"), 63), b.R).alias("estimate"))


@query("g16_exact_distinct", "SELECT event_type AS lang, ts::DATE AS day, count(DISTINCT CASE WHEN user_id % 9 <> 0 THEN sha256('salt' || user_id) END) AS users FROM events GROUP BY ALL")
def g16(spark, sf_dir):
    """Users are known by their salted hashes; edits without a user don't count."""
    user = F.when(F.col("user_id") % 9 != 0, hashed_user(F.col("user_id").cast("string"), "salt"))
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("lang"), F.to_date("ts").alias("day"))
    return rows.agg(F.countDistinct(user).alias("users"))


@query("g17_quantiles", b.with_(b.HOURLY) + "SELECT lang, median(views) AS middle, quantile_cont(views, 0.9) AS q90, list_sort(list(views))[least(floor(count(*) * 0.9)::INT + 1, count(*))] AS rank90 FROM stg GROUP BY lang")
def g17(spark, sf_dir):
    """Views meet as counts by value."""
    counts = b.stg(spark, sf_dir).groupBy("lang", "views").agg(F.count("*").alias("n"))
    q = lambda p: F.expr(f"percentile(views, {p}, n)")
    sums = counts.groupBy("lang").agg(q(0.5).alias("middle"), q(0.9).alias("q90"), F.sum("n").alias("total"))
    upto = evaluation.running(counts, "views", {"upto": F.col("n")}, ("lang",)).join(F.broadcast(sums), "lang")  # a row a language
    rank = F.least(F.floor(F.col("total") * 0.9) + 1, F.col("total"))
    return upto.groupBy("lang", "middle", "q90").agg(F.min(F.when(F.col("upto") >= rank, F.col("views"))).alias("rank90"))


@query("w7_sliding_edit_counts", """SELECT event_id, count(*) OVER (w RANGE BETWEEN INTERVAL 599 SECOND PRECEDING AND CURRENT ROW) AS n10, count(*) OVER (w RANGE BETWEEN INTERVAL 1799 SECOND PRECEDING AND CURRENT ROW) AS n30,
count(*) OVER (w RANGE BETWEEN INTERVAL 3599 SECOND PRECEDING AND CURRENT ROW) AS n60 FROM (SELECT event_id, event_type, user_id % 8 AS t, date_trunc('second', ts) AS s FROM events) WINDOW w AS (PARTITION BY event_type, t ORDER BY s)""")
def w7(spark, sf_dir):
    rows = canonical.edits(spark, sf_dir).withColumn("s", F.unix_timestamp(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("lang", "title").orderBy("s")
    return rows.select("event_id", *(F.count("*").over(w.rangeBetween(1 - 60 * m, 0)).alias(f"n{m}") for m in (10, 30, 60)))


@query("w6_cumulative_rank", b.with_(b.HOURLY) + """, s AS (SELECT lang, title, CAST(sum(views) AS BIGINT) AS views FROM stg GROUP BY ALL) SELECT lang, title, views, CAST(rank() OVER (PARTITION BY lang ORDER BY views DESC) AS INT) AS rank,
round(sum(views) OVER (PARTITION BY lang ORDER BY views DESC, title ROWS UNBOUNDED PRECEDING) / sum(views) OVER (PARTITION BY lang), 6) AS share FROM s""")
def w6(spark, sf_dir):
    rows = b.stg(spark, sf_dir).groupBy("lang", "title").agg(F.sum("views").alias("views"))
    totals = F.broadcast(rows.groupBy("lang").agg(F.sum("views").alias("whole")))  # a row a language
    down = rows.withColumn("order", -F.col("views"))
    ranked = evaluation.running(down, "order", {"upto": F.col("views"), "k": F.lit(1)}, ("lang",), ("title",)).join(totals, "lang")
    first = ranked.groupBy("lang", "views").agg(F.min("k").cast("int").alias("rank"))
    return ranked.join(first, ["lang", "views"]).select("lang", "title", "views", "rank", F.round(F.col("upto") / F.col("whole"), b.R).alias("share"))


@query("w5_top_titles_per_language", b.with_(b.HOURLY) + "SELECT * FROM (SELECT lang, title, ts_hour, views, CAST(row_number() OVER (PARTITION BY lang ORDER BY views DESC, title, ts_hour) AS INT) AS rank FROM stg) WHERE rank <= 5")
def w5(spark, sf_dir):
    rows = b.stg(spark, sf_dir).select("lang", "title", "ts_hour", "views")
    return selection.top_rows(rows, 5, [F.desc("views"), F.col("title"), F.col("ts_hour")], "lang")


@query("u3_rebuild_validation", b.with_(b.HOURLY) + """, o AS (SELECT ts_hour, lang, title, views FROM stg), n AS (SELECT ts_hour, lang, title, CASE WHEN title = 'T3' AND day = DATE '2024-01-05' THEN views + 1 ELSE views END AS views FROM stg WHERE NOT (title = 'T1' AND hour_of_day = 3))
SELECT (SELECT count(*) FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n)) AS only_old, (SELECT count(*) FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o)) AS only_new, (SELECT count(*) FROM (SELECT * FROM o INTERSECT ALL SELECT * FROM n)) AS n_same""")
def u3(spark, sf_dir):
    old = b.stg(spark, sf_dir).select("ts_hour", "lang", "title", "views")
    new = old.filter(~((F.col("title") == "T1") & (F.hour("ts_hour") == 3)))
    new = new.withColumn("views", F.when((F.col("title") == "T3") & (F.to_date("ts_hour") == F.lit("2024-01-05").cast("date")), F.col("views") + 1).otherwise(F.col("views")))
    # one pass instead of three set operations: how often each row is on either side
    sides = old.withColumn("o", F.lit(1)).withColumn("n", F.lit(0)).union(new.withColumn("o", F.lit(0)).withColumn("n", F.lit(1)))
    counts = sides.groupBy("ts_hour", "lang", "title", "views").agg(F.sum("o").alias("o"), F.sum("n").alias("n"))
    over = lambda a, c: F.coalesce(F.sum(F.greatest(F.col(a) - F.col(c), F.lit(0))), F.lit(0))
    return counts.agg(over("o", "n").alias("only_old"), over("n", "o").alias("only_new"), F.coalesce(F.sum(F.least("o", "n")), F.lit(0)).alias("n_same"))


@query("u4_missing_hours", b.with_(b.HOURLY) + "SELECT h AS ts_hour FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01', INTERVAL 1 HOUR) r(h) WHERE h NOT IN (SELECT ts_hour FROM stg WHERE lang = 'view' AND title = 'T2') ORDER BY h DESC LIMIT 12")
def u4(spark, sf_dir):
    present = b.stg(spark, sf_dir).filter("lang = 'view' AND title = 'T2'")
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return selection.missing_hours(present, at("2024-01-01 00:00:00"), at("2024-01-31 23:00:00"), 12)


@query("e21_completeness", b.with_(b.HOURLY) + """, span AS (SELECT 24 * (max(day) - min(day) + 1) AS hours FROM stg) SELECT lang, count(DISTINCT ts_hour) AS present, round(count(DISTINCT ts_hour) / any_value(hours), 6) AS share, count(DISTINCT ts_hour) / any_value(hours) >= 0.98 AS complete FROM stg, span GROUP BY lang""")
def e21(spark, sf_dir):
    """Hours present of those between the first and the last day of the data."""
    stg = b.stg(spark, sf_dir)
    rows = stg.groupBy("lang").agg(F.countDistinct("ts_hour").alias("present"))
    span = stg.agg((24 * (F.datediff(F.max("day"), F.min("day")) + 1)).alias("hours"))  # one row
    share = F.col("present") / F.col("hours")
    return rows.crossJoin(F.broadcast(span)).select("lang", "present", F.round(share, b.R).alias("share"), (share >= 0.98).alias("complete"))


@query("d28_storage_tiers", b.with_(b.HOURLY) + "SELECT t AS threshold, count(*) FILTER (WHERE views >= t) AS n_rows, CAST(coalesce(sum(views) FILTER (WHERE views >= t), 0) AS BIGINT) AS views FROM stg, (VALUES (10), (100), (500), (1000), (2500)) v(t) GROUP BY ALL")
def d28(spark, sf_dir):
    kept = b.stg(spark, sf_dir).select(F.explode(F.array(*[F.lit(t) for t in (10, 100, 500, 1000, 2500)])).alias("threshold"), "views")
    over = F.col("views") >= F.col("threshold")
    return kept.groupBy("threshold").agg(F.count_if(over).alias("n_rows"), F.sum(F.when(over, F.col("views")).otherwise(0)).alias("views"))


@query("d27_first_fixed_threshold_spike", b.with_(b.HOURLY) + """, g AS (SELECT a.lang, a.title, h AS ts_hour FROM (SELECT DISTINCT lang, title FROM stg) a, range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 HOUR) r(h)),
d AS (SELECT g.*, coalesce(views, 0) AS v FROM g LEFT JOIN stg USING (lang, title, ts_hour)),
l AS (SELECT *, lag(v, 24) OVER w AS y, lag(v, 1) OVER w AS a, lag(v, 2) OVER w AS b, lag(v, 3) OVER w AS c FROM d WINDOW w AS (PARTITION BY lang, title ORDER BY ts_hour))
SELECT lang, title, min(ts_hour) FILTER (WHERE v >= 20 AND y > 0 AND v >= 5 * y) AS day_over_day, min(ts_hour) FILTER (WHERE v >= 20 AND c IS NOT NULL AND v >= 3 * list_aggregate([a, b, c], 'median')) AS hour_over_hour FROM l GROUP BY ALL""")
def d27(spark, sf_dir):
    stg = b.stg(spark, sf_dir).select("lang", "title", "ts_hour", "views")
    grid = F.expr("sequence(TIMESTAMP_NTZ '2024-01-01 00:00:00', TIMESTAMP_NTZ '2024-01-30 23:00:00', INTERVAL 1 HOUR)")
    dense = stg.select("lang", "title").distinct().withColumn("ts_hour", F.explode(grid)).join(stg, ["lang", "title", "ts_hour"], "left").withColumn("v", F.coalesce("views", F.lit(0)))
    w = Window.partitionBy("lang", "title").orderBy("ts_hour")
    rows = dense.withColumns({"y": F.lag("v", 24).over(w), "last": F.array(*[F.lag("v", k).over(w) for k in (1, 2, 3)])})
    first = lambda c: F.min(F.when((F.col("v") >= 20) & c, F.col("ts_hour")))
    rose = F.col("last")[2].isNotNull() & (F.col("v") >= 3 * robust.array_median(F.col("last")))
    return rows.groupBy("lang", "title").agg(first((F.col("y") > 0) & (F.col("v") >= 5 * F.col("y"))).alias("day_over_day"), first(rose).alias("hour_over_hour"))


@query("d29_redirect_collapse", b.with_(b.HOURLY) + "SELECT lang, ts_hour, CASE WHEN title IN ('T1', 'T2') THEN 'T0' ELSE title END AS title, CAST(sum(views) AS BIGINT) AS views FROM stg GROUP BY ALL")
def d29(spark, sf_dir):
    alias = spark.createDataFrame([("T1", "T0"), ("T2", "T0")], "title string, target string")
    rows = b.stg(spark, sf_dir).join(F.broadcast(alias), "title", "left")
    return rows.groupBy("lang", "ts_hour", F.coalesce("target", "title").alias("title")).agg(F.sum("views").alias("views"))


@query("d30_both_access_kinds", b.with_(b.HOURLY) + "SELECT lang, CAST(sum(views) AS BIGINT) AS views, round(sum(views_mobile) / sum(views), 6) AS mobile_share, count(*) FILTER (WHERE views_mobile > 0 AND views_desktop > 0) AS n_both FROM stg GROUP BY lang")
def d30(spark, sf_dir):
    both = F.count_if((F.col("views_mobile") > 0) & (F.col("views_desktop") > 0))
    return b.stg(spark, sf_dir).groupBy("lang").agg(F.sum("views").alias("views"), F.round(F.sum("views_mobile") / F.sum("views"), b.R).alias("mobile_share"), both.alias("n_both"))


@query("d33_distributions", _EV + "SELECT breadth, CAST(floor(least(greatest(coalesce(median_spread_lag_hours, 0), 0), 12) / 3) AS BIGINT) AS lag_bin, count(*) AS n FROM ev GROUP BY ALL")
def d33(spark, sf_dir):
    held = F.least(F.greatest(F.coalesce("median_spread_lag_hours", F.lit(0.0)), F.lit(0.0)), F.lit(12.0))
    return wide(spark, sf_dir).groupBy("breadth", F.floor(held / 3).alias("lag_bin")).agg(F.count("*").alias("n"))


@query("d33_detected_share", _EV + """, gt AS (SELECT o_orderkey AS id, DATE '2024-01-01' + (o_custkey % 30)::INT AS date, o_orderkey % 8 AS qid, (o_custkey * 7 % 150 + 1)::INT AS n FROM orders),
hit AS (SELECT gt.*, EXISTS (SELECT 1 FROM ev WHERE ev.qid = gt.qid AND ev.start_hour::DATE BETWEEN gt.date - 1 AND gt.date + 1) AS found FROM gt)
SELECT CASE WHEN n < 10 THEN '1-9' WHEN n < 25 THEN '10-24' WHEN n < 50 THEN '25-49' WHEN n < 100 THEN '50-99' ELSE '100+' END AS bucket, count(*) AS links, count(*) FILTER (WHERE found) AS detected, round(avg(found::INT), 6) AS share FROM hit GROUP BY ALL""")
def d33_share(spark, sf_dir):
    date = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_custkey") % 30).cast("int"))
    links = table(spark, sf_dir, "orders").select(date.alias("date"), (F.col("o_orderkey") % 8).alias("qid"), (F.col("o_custkey") * 7 % 150 + 1).alias("n_languages"))
    return selection.detected_share(links, wide(spark, sf_dir)).withColumn("share", F.round("share", b.R))


@query("d34_arrival_lag", """WITH h AS (SELECT event_type AS source, date_trunc('hour', ts) AS hour, min(ts) AS first FROM events GROUP BY ALL), a AS (SELECT source, hour, epoch(lead(first) OVER (PARTITION BY source ORDER BY hour) - (hour + INTERVAL 1 HOUR)) / 60 AS m FROM h)
SELECT source, round(min(m), 6) AS least, round(median(m), 6) AS middle, round(quantile_cont(m, 0.9), 6) AS q90, round(max(m), 6) AS most, count(*) FILTER (WHERE m > 360) AS late FROM a WHERE m IS NOT NULL GROUP BY source""")
def d34(spark, sf_dir):
    """An hour's data arrives when the source is heard of next, after the hour's end; what takes more than six hours is late."""
    hours = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source"), F.date_trunc("hour", "ts").alias("hour")).agg(F.min("ts").alias("first"))
    arrived = F.lead("first").over(Window.partitionBy("source").orderBy("hour"))  # a row an hour
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    rows = hours.withColumn("m", (seconds(arrived) - seconds(F.col("hour")) - 3600) / 60).filter("m IS NOT NULL")
    sums = rows.groupBy("source").agg(F.min("m").alias("least"), F.max("m").alias("most"), F.count_if(F.col("m") > 360).alias("late"))
    found = sums.join(quantiles.quantile_columns(rows, ["source"], "m", {"middle": 0.5, "q90": 0.9}), "source")
    return found.withColumns({c: F.round(c, b.R) for c in ("least", "middle", "q90", "most")})


@query("g17_exact_quantiles", """WITH x AS (SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS kind, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 3 = 0 THEN exp(value / 10) ELSE -value END AS v FROM events)
SELECT kind, share, round(CASE share WHEN 0.0 THEN quantile_cont(v, 0.0) WHEN 0.25 THEN quantile_cont(v, 0.25) WHEN 0.5 THEN quantile_cont(v, 0.5) WHEN 0.99 THEN quantile_cont(v, 0.99) ELSE quantile_cont(v, 1.0) END, 6) AS quantile
FROM x, (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.99::DOUBLE), (1.0::DOUBLE)) s(share) GROUP BY kind, share""")
def g17_exact(spark, sf_dir):
    """Doubles of any size and sign, missing ones, and a group whose key is null."""
    n = F.col("event_id")
    v = F.when(n % 11 == 0, None).when(n % 3 == 0, F.exp(F.col("value") / 10)).otherwise(-F.col("value"))
    rows = table(spark, sf_dir, "events").select(F.when(n % 7 != 0, F.col("event_type")).alias("kind"), v.alias("v"))
    return quantiles.exact_quantiles(rows, ["kind"], "v", (0.0, 0.25, 0.5, 0.99, 1.0)).withColumn("quantile", F.round("quantile", b.R))


@query("f17_hash_sample", """WITH h AS (SELECT user_id, ('0x' || substr(md5('sample|' || user_id), 1, 8))::BIGINT AS h FROM (SELECT DISTINCT user_id FROM events)) SELECT user_id, h % 50 AS bucket FROM h WHERE h % 50 < 10""")
def f17(spark, sf_dir):
    """Users of ten buckets of fifty, the same in every engine and run."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.withColumn("bucket", robust.hash_bucket(F.concat(F.lit("sample|"), "user_id"), 50)).filter("bucket < 10")


@query("e19_hour_alignment", b.with_(b.HOURLY) + "SELECT ts_hour, CAST(sum(views) FILTER (WHERE lang IN ('view', 'click')) AS BIGINT) AS first_set, CAST(sum(views) FILTER (WHERE lang NOT IN ('view', 'click')) AS BIGINT) AS second_set FROM stg GROUP BY ALL")
def e19(spark, sf_dir):
    side = F.col("lang").isin("view", "click")
    return b.stg(spark, sf_dir).groupBy("ts_hour").agg(F.sum(F.when(side, F.col("views"))).alias("first_set"), F.sum(F.when(~side, F.col("views"))).alias("second_set"))
