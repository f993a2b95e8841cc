"""Staging, baselines, scores, spikes and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import baseline, events, staging
from pulsegrid.plans import base as b
from pulsegrid.plans.registry import query
from pulsegrid.sources import canonical

rnd = lambda c: F.round(c, b.R).alias(c)


@query("g1_hourly_merge", b.with_(b.HOURLY) + "SELECT ts_hour, lang, title, views_desktop, views_mobile FROM hourly")
def g1(spark, sf_dir):
    return canonical.hourly(spark, sf_dir)


@query("p1_stage", b.with_(b.HOURLY) + "SELECT ts_hour, lang, title, day, hour_of_day, is_weekend, views, round(mobile_share, 6) AS mobile_share FROM stg")
def p1(spark, sf_dir):
    return b.stg(spark, sf_dir).select("ts_hour", "lang", "title", "day", "hour_of_day", "is_weekend", "views", rnd("mobile_share"))


@query("d4_automation_flags", b.with_(b.HOURLY, b.FLAGS) + """SELECT lang, title, day, CAST(day_views AS BIGINT) AS day_views, round(mobile_share, 6) AS mobile_share,
round(hourly_mean, 6) AS hourly_mean, round(hourly_cv, 6) AS hourly_cv, is_low_mobile, is_flat, is_low_mobile OR is_flat AS is_automated FROM flagged""")
def d4(spark, sf_dir):
    rows = staging.automation_flags(b.stg(spark, sf_dir), b.AUTOMATION)
    return rows.withColumns({c: F.round(c, b.R) for c in ("mobile_share", "hourly_mean", "hourly_cv")})


@query("d7_observation_counts", b.with_(b.HOURLY, b.CALENDAR) + "SELECT day, n_all::INT AS n_all, n_weekend::INT AS n_weekend, (n_all - n_weekend)::INT AS n_weekday FROM days")
def d7(spark, sf_dir):
    return baseline.calendar(b.stg(spark, sf_dir).select("day").distinct(), b.START)


@query("d5_language_priors", b.with_(b.HOURLY, b.CALENDAR, b.PRIORS) + "SELECT day, lang, round(prior_median, 6) AS prior_median, round(prior_mad, 6) AS prior_mad FROM priors")
def d5(spark, sf_dir):
    return baseline.language_priors(b.stg(spark, sf_dir)).select("day", "lang", rnd("prior_median"), rnd("prior_mad"))


SCORE_COLUMNS = ["baseline_median", "baseline_mad", "prev3_median", "surprise"]
_SCORE = """SELECT ts_hour, lang, title, views, baseline_level, unseen, round(baseline_median, 6) AS baseline_median, round(baseline_mad, 6) AS baseline_mad,
views_yesterday, round(prev3_median, 6) AS prev3_median, round(surprise, 6) AS surprise, r1, r2 FROM scored"""


@query("d6_score_candidates", b.with_(b.HOURLY, b.CALENDAR, b.PRIORS, b.SCORED) + _SCORE)
def d6(spark, sf_dir):
    rows = b.scored(spark, sf_dir).withColumns({c: F.round(c, b.R) for c in SCORE_COLUMNS})
    return rows.select("ts_hour", "lang", "title", "views", "baseline_level", "unseen", "baseline_median", "baseline_mad", "views_yesterday", "prev3_median", "surprise", "r1", "r2")


@query("d10_spikes", b.with_(b.HOURLY, b.FLAGS, b.CALENDAR, b.PRIORS, b.SCORED, b.SPIKES) + """SELECT ts_hour, lang, title, qid, views, round(surprise, 6) AS surprise, is_automated,
coalesce('Q' || qid, lang || '|' || title) AS entity_key, surprise >= 0.8 AND NOT is_automated AS is_spike FROM spikes""")
def d10(spark, sf_dir):
    return b.spikes(spark, sf_dir).select("ts_hour", "lang", "title", "qid", "views", rnd("surprise"), "is_automated", "entity_key", "is_spike")


_SLOTS = f"""
lb AS (SELECT * FROM stg WHERE day BETWEEN DATE '{b.DAY}' - 28 AND DATE '{b.DAY}' - 1 AND day >= DATE '{b.START}'),
slots AS (SELECT lang, title, hour_of_day, list_resize(list(views), 17, 0) AS vals FROM lb WHERE NOT is_weekend GROUP BY ALL HAVING 2 * count(*) >= 17),
stored AS (SELECT lang, title, hour_of_day, CAST(list_aggregate(vals, 'median') AS DOUBLE) AS baseline_median, CAST(list_aggregate(vals, 'mad') AS DOUBLE) AS baseline_mad, 'day_type' AS baseline_level, 17 AS n_obs FROM slots),
est AS (SELECT lang, title FROM lb GROUP BY ALL HAVING count(DISTINCT day) >= 7),
baselines AS (SELECT * FROM stored WHERE baseline_median > 0 OR baseline_mad > 0
  UNION ALL SELECT lang, NULL, NULL, CAST(median(views) AS DOUBLE), CAST(mad(views) AS DOUBLE), 'prior', NULL FROM lb SEMI JOIN est USING (lang, title) GROUP BY lang)"""


def baselines_of(spark, sf_dir):
    return baseline.daily_baselines(b.stg(spark, sf_dir), b.DAY, b.START)


@query("d8_daily_baselines", b.with_(b.HOURLY, _SLOTS) + f"""SELECT DATE '{b.DAY}' AS day, lang, title, hour_of_day::INT AS hour_of_day, round(baseline_median, 6) AS baseline_median,
round(baseline_mad, 6) AS baseline_mad, baseline_level, n_obs::INT AS n_obs FROM baselines""")
def d8(spark, sf_dir):
    return baselines_of(spark, sf_dir).withColumns({c: F.round(c, b.R) for c in ("baseline_median", "baseline_mad")})


_HOUR = f"""
c AS (SELECT * FROM stg WHERE ts_hour = TIMESTAMP '{b.HOUR}' AND views >= 100),
lag AS (SELECT c.lang, c.title, coalesce(max(p.views) FILTER (WHERE p.ts_hour = c.ts_hour - INTERVAL 24 HOUR), 0) AS y, coalesce(max(p.views) FILTER (WHERE p.ts_hour = c.ts_hour - INTERVAL 1 HOUR), 0) AS a,
        coalesce(max(p.views) FILTER (WHERE p.ts_hour = c.ts_hour - INTERVAL 2 HOUR), 0) AS b, coalesce(max(p.views) FILTER (WHERE p.ts_hour = c.ts_hour - INTERVAL 3 HOUR), 0) AS d,
        sum(p.views) FILTER (WHERE p.day = c.day) + any_value(c.views) AS s, coalesce(sum(p.views_mobile) FILTER (WHERE p.day = c.day), 0) + any_value(c.views_mobile) AS m
        FROM c LEFT JOIN stg p ON p.lang = c.lang AND p.title = c.title AND p.ts_hour >= c.ts_hour - INTERVAL 24 HOUR AND p.ts_hour < c.ts_hour GROUP BY ALL),
day_so_far AS (SELECT c.lang, c.title, CAST(sum(p.views) AS DOUBLE) AS s, CAST(sum(p.views_mobile) AS DOUBLE) AS m, sum(CAST(p.views AS DOUBLE) * p.views) AS q
        FROM c JOIN stg p ON p.lang = c.lang AND p.title = c.title AND p.day = c.day AND p.ts_hour <= c.ts_hour GROUP BY ALL),
hb AS (SELECT c.*, k.lang IS NULL AS unseen, CASE WHEN k.lang IS NULL THEN coalesce(pr.baseline_median, 0) ELSE coalesce(sl.baseline_median, 0) END AS med,
        CASE WHEN k.lang IS NULL THEN coalesce(pr.baseline_mad, 0) ELSE coalesce(sl.baseline_mad, 0) END AS dev, CASE WHEN k.lang IS NULL THEN 'prior' ELSE coalesce(sl.baseline_level, 'zero') END AS lvl
        FROM c LEFT JOIN (SELECT DISTINCT lang, title FROM baselines WHERE title IS NOT NULL) k USING (lang, title)
        LEFT JOIN baselines sl ON sl.lang = c.lang AND sl.title = c.title AND sl.hour_of_day = c.hour_of_day LEFT JOIN baselines pr ON pr.lang = c.lang AND pr.title IS NULL)"""


@query("d9_score_hour", b.with_(b.HOURLY, _SLOTS, _HOUR) + f"""SELECT hb.ts_hour, hb.lang, hb.title, hb.views, lvl AS baseline_level, unseen, round(med, 6) AS baseline_median, round(dev, 6) AS baseline_mad, y AS views_yesterday,
CAST(list_aggregate([a, b, d], 'median') AS DOUBLE) AS prev3_median, round((hb.views - med) / (1.4826 * dev + sqrt(med) + 1), 6) AS surprise, NOT unseen AND hb.views >= 1.5 * y AS r1,
hb.views >= 1.2 * list_aggregate([a, b, d], 'median') AS r2,
(ds.s >= 500 AND ds.m / ds.s < 0.05) OR (ds.s / 15 >= 200 AND sqrt(greatest(ds.q / 15 - (ds.s / 15) * (ds.s / 15), 0)) / (ds.s / 15) < 1.2) AS is_automated
FROM hb JOIN lag USING (lang, title) JOIN day_so_far ds USING (lang, title)""")
def d9(spark, sf_dir):
    rows = baseline.score_hour(b.stg(spark, sf_dir), baselines_of(spark, sf_dir), b.HOUR, b.SPIKE, b.AUTOMATION)
    return rows.drop("mobile_share").withColumns({c: F.round(c, b.R) for c in SCORE_COLUMNS})


_EVENT = """SELECT event_id, qid, start_hour, lead_lang, breadth, round(peak_intensity, 6) AS peak_intensity, round(excess_views, 6) AS excess_views, median_spread_lag_hours, max_spread_lag_hours, languages,
round(lead_excess_share, 6) AS lead_excess_share, CASE WHEN lead_excess_share >= 0.95 THEN 'single_language' ELSE 'multi_language' END AS event_class, tier FROM ev"""


def _flat(rows):
    rows = rows.withColumn("languages", F.concat_ws(",", "languages"))
    return rows.withColumns({c: F.round(c, b.R) for c in ("peak_intensity", "excess_views", "lead_excess_share")})


@query("d11_attention_events", b.with_(b.HOURLY, b.LOUD, b.event_sql()) + _EVENT)
def d11(spark, sf_dir):
    return _flat(b.event_rows(spark, sf_dir))


@query("d11_event_languages", b.with_(b.HOURLY, b.LOUD, b.event_sql()) + "SELECT event_id, qid, start_hour, lang, first_spike, spread_lag_hours, round(peak_surprise, 6) AS peak_surprise, spike_hours, round(excess_views, 6) AS excess_views, is_lead FROM el")
def d11_languages(spark, sf_dir):
    return b.languages(spark, sf_dir).withColumns({c: F.round(c, b.R) for c in ("peak_surprise", "excess_views")})


@query("d11_events_of_scored_spikes", b.with_(b.HOURLY, b.FLAGS, b.CALENDAR, b.PRIORS, b.SCORED, b.SPIKES, "src AS (SELECT * FROM spikes WHERE NOT is_automated)", b.event_sql(source="src", langs=2)) + _EVENT)
def d11_scored(spark, sf_dir):
    from dataclasses import replace

    p = replace(b.EVENTS, min_languages=2)
    rows = b.spikes(spark, sf_dir).filter(~F.col("is_automated"))
    return _flat(events.attention_events(events.event_languages(rows, p), p))


@query("d18_product_events", b.with_(b.HOURLY, b.LOUD, b.event_sql(langs=2, threshold=1.2)) + _EVENT)
def d18(spark, sf_dir):
    from dataclasses import replace

    return _flat(b.event_rows(spark, sf_dir, replace(b.EVENTS, min_languages=2, r3_threshold=1.2)))


@query("d12_tier_counts", b.with_(b.HOURLY, b.LOUD, b.event_sql()) + "SELECT tier, count(*) AS n FROM ev GROUP BY tier")
def d12(spark, sf_dir):
    return b.event_rows(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n"))


@query("d17_event_languages_titled", b.with_(b.HOURLY, b.LOUD, b.event_sql()) + "SELECT event_id, el.lang, title FROM el LEFT JOIN links USING (qid, lang)")
def d17(spark, sf_dir):
    return b.languages(spark, sf_dir).join(canonical.sitelinks(spark, sf_dir), ["qid", "lang"], "left").select("event_id", "lang", "title")


@query("d19_scored_of_spiking_items", b.with_(b.HOURLY, b.FLAGS, b.CALENDAR, b.PRIORS, b.SCORED, b.SPIKES) + """SELECT s.ts_hour, s.lang, s.title, k.qid, s.views FROM scored s
JOIN (SELECT DISTINCT lang, title, qid FROM spikes WHERE surprise >= 1.5 AND qid IS NOT NULL) k USING (lang, title)""")
def d19(spark, sf_dir):
    keys = b.spikes(spark, sf_dir).filter((F.col("surprise") >= 1.5) & F.col("qid").isNotNull()).select("lang", "title", "qid").distinct()
    return b.scored(spark, sf_dir).join(keys, ["lang", "title"]).select("ts_hour", "lang", "title", "qid", "views")


@query("e16_production_agreement", b.with_(b.HOURLY, b.FLAGS, b.CALENDAR, b.PRIORS, b.SCORED, _SLOTS, _HOUR) + f"""
, prod AS (SELECT lang, title FROM hb JOIN lag USING (lang, title) WHERE (hb.views - med) / (1.4826 * dev + sqrt(med) + 1) >= 0.4),
batch AS (SELECT lang, title FROM scored WHERE ts_hour = TIMESTAMP '{b.HOUR}' AND surprise >= 0.4)
SELECT count(p.lang) AS n_production, count(q.lang) AS n_batch, count(*) FILTER (WHERE p.lang IS NOT NULL AND q.lang IS NOT NULL) AS n_both
FROM prod p FULL JOIN batch q USING (lang, title)""".replace("\n, prod", ", prod"))
def e16(spark, sf_dir):
    hour = baseline.score_hour(b.stg(spark, sf_dir), baselines_of(spark, sf_dir), b.HOUR, b.SPIKE, b.AUTOMATION)
    prod = hour.filter("surprise >= 0.4").select("lang", "title", F.lit(1).alias("p"))
    batch = b.scored(spark, sf_dir).filter((F.col("ts_hour") == F.lit(b.HOUR).cast("timestamp_ntz")) & (F.col("surprise") >= 0.4)).select("lang", "title", F.lit(1).alias("q"))
    return prod.join(batch, ["lang", "title"], "full").agg(F.count("p").alias("n_production"), F.count("q").alias("n_batch"), F.count_if(F.col("p").isNotNull() & F.col("q").isNotNull()).alias("n_both"))
