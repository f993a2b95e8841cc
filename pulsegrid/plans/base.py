"""What the registered queries share: parameters fitted to the test tables, canonical relations, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import baseline, events, staging
from pulsegrid.params import Automation, Events, Spike
from pulsegrid.session import scratch
from pulsegrid.sources import canonical

START = "2024-01-01"
DAY, HOUR = "2024-01-24", "2024-01-24 14:00:00"
AUTOMATION = Automation(flat_cv_max=1.2)
SPIKE = Spike(r1_ratio=1.5, r2_ratio=1.2, r3_threshold=0.8, r3_candidate=0.4)
EVENTS = Events(r3_threshold=0.8)
R = 6  # decimals at which both engines' doubles are compared


def stg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.stage(canonical.hourly(spark, sf_dir))


def stg_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged hours written once, for plans that read them several times."""
    path = scratch(spark, "stg")
    rows = stg(spark, sf_dir)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def scored(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    rows = stg_files(spark, sf_dir) if rows is None else rows
    days = baseline.calendar(rows.select("day").distinct(), START)
    return baseline.score_candidates(rows, baseline.language_priors(rows), days, s=SPIKE)


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stg_files(spark, sf_dir)
    flags = staging.automation_flags(rows, AUTOMATION)
    return baseline.spikes(scored(spark, sf_dir, rows), flags, canonical.sitelinks(spark, sf_dir), SPIKE)


def loud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loud hours of each entity as plain spikes: surprise is views in thousands, the baseline half of them."""
    rows = stg(spark, sf_dir).withColumn("qid", F.substring("title", 2, 9).cast("long"))
    return rows.select("qid", "lang", "title", "ts_hour", "views", (F.col("views") / 1000.0).alias("surprise"), (F.col("views") / 2.0).alias("baseline_median"))


def languages(spark: SparkSession, sf_dir: str, p: Events = EVENTS) -> DataFrame:
    return events.event_languages(loud(spark, sf_dir), p)


def event_rows(spark: SparkSession, sf_dir: str, p: Events = EVENTS) -> DataFrame:
    return events.attention_events(languages(spark, sf_dir, p), p)


# ---------------------------------------------------------------- DuckDB
HOURLY = f"""
raw AS (SELECT date_trunc('hour', ts) AS ts_hour, event_type AS lang, 'T' || (user_id % {canonical.ENTITIES}) AS title,
               CAST(floor(value * 10) AS BIGINT) AS v, CAST(json_extract_string(props, '$.k') AS INT) % 2 = 1 AS is_mobile FROM events),
hourly AS (SELECT ts_hour, lang, title, CAST(coalesce(sum(v) FILTER (WHERE NOT is_mobile), 0) AS BIGINT) AS views_desktop,
                  CAST(coalesce(sum(v) FILTER (WHERE is_mobile), 0) AS BIGINT) AS views_mobile
           FROM raw GROUP BY ALL HAVING sum(v) >= 5),
stg AS (SELECT *, CAST(ts_hour AS DATE) AS day, CAST(hour(ts_hour) AS INT) AS hour_of_day, isodow(ts_hour) >= 6 AS is_weekend,
               views_desktop + views_mobile AS views, CASE WHEN views_desktop + views_mobile > 0 THEN views_mobile / (views_desktop + views_mobile) END AS mobile_share
        FROM hourly),
links AS (SELECT DISTINCT event_type AS lang, 'T' || (user_id % {canonical.ENTITIES}) AS title, user_id % {canonical.ENTITIES} AS qid
          FROM events WHERE user_id % {canonical.ENTITIES} < {canonical.ENTITIES - 1})"""

FLAGS = """
flags AS (SELECT lang, title, day, day_views, mobile / day_views AS mobile_share, day_views / 24 AS hourly_mean,
                 sqrt(greatest(squares / 24 - (day_views / 24) * (day_views / 24), 0)) / (day_views / 24) AS hourly_cv
          FROM (SELECT lang, title, day, CAST(sum(views) AS DOUBLE) AS day_views, CAST(sum(views_mobile) AS DOUBLE) AS mobile,
                       sum(CAST(views AS DOUBLE) * views) AS squares FROM stg GROUP BY ALL) WHERE day_views >= 500),
flagged AS (SELECT *, day_views >= 500 AND mobile_share < 0.05 AS is_low_mobile, hourly_mean >= 200 AND hourly_cv < 1.2 AS is_flat FROM flags)"""

CALENDAR = f"""
days AS (SELECT day, (SELECT count(*) FROM range(1, 29) r(i) WHERE day - CAST(i AS INT) >= DATE '{START}') AS n_all,
                (SELECT count(*) FROM range(1, 29) r(i) WHERE day - CAST(i AS INT) >= DATE '{START}' AND isodow(day - CAST(i AS INT)) >= 6) AS n_weekend
         FROM (SELECT DISTINCT day FROM stg))"""

PRIORS = """
seen_days AS (SELECT d.day, s.lang, s.title FROM days d JOIN stg s ON s.day BETWEEN d.day - 28 AND d.day - 1
              GROUP BY ALL HAVING count(DISTINCT s.day) >= 7),
priors AS (SELECT k.day, k.lang, CAST(median(s.views) AS DOUBLE) AS prior_median, CAST(mad(s.views) AS DOUBLE) AS prior_mad
           FROM seen_days k JOIN stg s ON s.lang = k.lang AND s.title = k.title AND s.day BETWEEN k.day - 28 AND k.day - 1 GROUP BY ALL)"""

#: An observation for every day of the look-back, found or zero, so that medians are plain aggregates over it.
SCORED = f"""
obs AS (SELECT c.lang, c.title, c.ts_hour, coalesce(h.views, 0) AS v, (isodow(c.day - back.i) >= 6) = c.is_weekend AS alike
        FROM stg c JOIN (SELECT CAST(range AS INT) AS i FROM range(1, 29)) back ON c.day - back.i >= DATE '{START}'
        LEFT JOIN stg h ON h.lang = c.lang AND h.title = c.title AND h.ts_hour = c.ts_hour - to_days(back.i) WHERE c.views >= 100),
rob AS (SELECT lang, title, ts_hour, count(*) AS n_any, count(*) FILTER (WHERE alike) AS n_alike,
               MAP {{'hour': [median(v), mad(v)], 'day_type': [median(v) FILTER (WHERE alike), mad(v) FILTER (WHERE alike)]}} AS found FROM obs GROUP BY ALL),
past AS (SELECT lang, title, ts_hour, views FROM stg),
fresh AS (SELECT lang, title, ts_hour, NOT EXISTS (SELECT 1 FROM stg k WHERE k.lang = c.lang AND k.title = c.title AND k.day < c.day AND k.day >= c.day - 28) AS unseen
          FROM stg c WHERE views >= 100),
scored AS (
  SELECT c.*, unseen,
         if(unseen, 'prior', coalesce(if(n_alike >= 7, 'day_type', NULL), if(n_any >= 7, 'hour', NULL), 'prior')) AS baseline_level,
         coalesce(if(baseline_level = 'prior', prior_median, found[baseline_level][1]), 0)::DOUBLE AS baseline_median,
         coalesce(if(baseline_level = 'prior', prior_mad, found[baseline_level][2]), 0)::DOUBLE AS baseline_mad,
         coalesce(y.views, 0) AS views_yesterday,
         list_sort([coalesce(h1.views, 0), coalesce(h2.views, 0), coalesce(h3.views, 0)])[2]::DOUBLE AS prev3_median,
         (c.views - baseline_median) / (1 + sqrt(baseline_median) + 1.4826 * baseline_mad) AS surprise,
         c.views >= 1.5 * views_yesterday AND NOT unseen AS r1, c.views >= 1.2 * prev3_median AS r2
  FROM stg c JOIN fresh USING (lang, title, ts_hour) LEFT JOIN rob USING (lang, title, ts_hour) LEFT JOIN priors USING (day, lang)
  LEFT JOIN past y ON y.lang = c.lang AND y.title = c.title AND y.ts_hour = c.ts_hour - to_hours(24)
  LEFT JOIN past h1 ON h1.lang = c.lang AND h1.title = c.title AND h1.ts_hour = c.ts_hour - to_hours(1)
  LEFT JOIN past h2 ON h2.lang = c.lang AND h2.title = c.title AND h2.ts_hour = c.ts_hour - to_hours(2)
  LEFT JOIN past h3 ON h3.lang = c.lang AND h3.title = c.title AND h3.ts_hour = c.ts_hour - to_hours(3)
  WHERE c.views >= 100)"""

SPIKES = """
spikes AS (SELECT s.*, qid, coalesce(f.is_low_mobile OR f.is_flat, false) AS is_automated
           FROM scored s LEFT JOIN flagged f USING (lang, title, day) LEFT JOIN links USING (lang, title)
           WHERE (r1 OR r2) AND surprise >= 0.4)"""

LOUD = """
loud AS (SELECT CAST(substr(title, 2) AS BIGINT) AS qid, lang, title, ts_hour, views, views / 1000 AS surprise, views / 2 AS baseline_median FROM stg)"""


def event_sql(prefix: str = "", threshold: float = 0.8, langs: int = 3, window: int = 6, source: str = "loud") -> str:
    """CTEs of event languages (el) and events (ev), from a relation of spikes: an hour opens an episode if the day before
    it was quiet, hours belong to the last opening before them, and the rest is said with lists and subqueries."""
    p = prefix
    return f"""
{p}strong AS (SELECT qid, ts_hour AS t, lang, max(surprise) AS s FROM {source} WHERE surprise >= {threshold} AND qid IS NOT NULL GROUP BY ALL),
{p}opening AS (SELECT DISTINCT qid, t AS opened FROM {p}strong n
               WHERE NOT EXISTS (SELECT 1 FROM {p}strong o WHERE o.qid = n.qid AND o.t < n.t AND o.t > n.t - to_hours(24))),
{p}inside AS (SELECT n.*, o.opened FROM {p}strong n ASOF JOIN {p}opening o ON n.qid = o.qid AND n.t >= o.opened),
{p}crowded AS (SELECT i.qid, i.opened, i.t, len(list_distinct((SELECT list(j.lang) FROM {p}inside j WHERE j.qid = i.qid AND j.opened = i.opened AND j.t >= i.t AND j.t < i.t + to_hours({window})))) AS n FROM {p}inside i),
{p}begin AS (SELECT qid, opened, arg_min(t, t) AS start_hour FROM {p}crowded WHERE n >= {langs} GROUP BY qid, opened),
{p}told AS (SELECT g.qid, g.start_hour, i.lang, list({{'t': i.t, 's': i.s}} ORDER BY i.t) AS hits
            FROM {p}begin g JOIN {p}inside i ON i.qid = g.qid AND i.opened = g.opened AND i.t BETWEEN g.start_hour AND g.start_hour + to_hours(23) GROUP BY ALL),
{p}el AS (SELECT concat('Q', qid, '@', strftime(start_hour, '%Y%m%dT%H')) AS event_id, qid, start_hour, lang, hits[1].t AS first_spike,
                 list_max([x.s for x in hits]) AS peak_surprise, len(hits) AS spike_hours, date_diff('hour', start_hour, hits[1].t) AS spread_lag_hours,
                 coalesce((SELECT sum(if(o.views > o.baseline_median, o.views - o.baseline_median, 0)) FROM {source} o
                           WHERE o.qid = k.qid AND o.lang = k.lang AND o.ts_hour BETWEEN k.start_hour AND k.start_hour + to_hours(23)), 0) AS excess_views,
                 1 = row_number() OVER (PARTITION BY qid, start_hour ORDER BY hits[1].t, hits[1].s DESC, lang) AS is_lead
          FROM {p}told k),
{p}whole AS (SELECT event_id, qid, start_hour, list({{'lag': spread_lag_hours, 'lang': lang, 'peak': peak_surprise, 'over': excess_views, 'lead': is_lead}} ORDER BY spread_lag_hours, lang) AS m
             FROM {p}el GROUP BY ALL),
{p}ev AS (SELECT event_id, qid, start_hour, len(m) AS breadth, [x.lang for x in m if x.lead][1] AS lead_lang, list_max([x.peak for x in m]) AS peak_intensity,
                 list_sum([x.over for x in m]) AS excess_views, list_median([x.lag for x in m if NOT x.lead]) AS median_spread_lag_hours, list_max([x.lag for x in m]) AS max_spread_lag_hours,
                 array_to_string([x.lang for x in m], ',') AS languages,
                 coalesce(list_sum([x.over for x in m if x.lead]) / nullif(list_sum([x.over for x in m]), 0), 0) AS lead_excess_share,
                 (SELECT arg_max(name, least_n) FROM (VALUES (2, 'noticed'), (5, 'international'), (20, 'planetary')) tiers(least_n, name) WHERE least_n <= len(m)) AS tier
          FROM {p}whole)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"
