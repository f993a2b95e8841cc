"""Change streams: bursts, slots, sketches and live events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import robust
from pulsegrid.operators import quantiles
from pulsegrid.params import Bursts
from pulsegrid.plans import base as b
from pulsegrid.plans.registry import query
from pulsegrid.session import scratch, table
from pulsegrid.sources import canonical
from pulsegrid.streaming import bursts

P = Bursts(min_edits=4, min_editors=3, window_minutes=180, ratio=3.0, new_page_minutes=0)
#: With the rule for new pages.
P_NEW = Bursts(min_edits=5, min_editors=4, window_minutes=180, ratio=3.0, new_page_minutes=1440, new_page_edits=3, new_page_editors=2)

EDITS = """edits AS (SELECT event_type AS lang, 'T' || (user_id % 8) AS title, CAST(floor(epoch(ts)) AS BIGINT) AS second, 'U' || user_id AS usr FROM events),
hm AS (SELECT lang, hour, median(n) AS m FROM (SELECT lang, title, second // 3600 AS hour, count(*) AS n FROM edits GROUP BY ALL) GROUP BY ALL),
wb AS (SELECT lang, hour, CASE WHEN len(past) >= 24 THEN list_aggregate(past, 'median') ELSE 1.0 END AS baseline
       FROM (SELECT lang, hour, coalesce(list(m) OVER (PARTITION BY lang ORDER BY hour ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING), []) AS past FROM hm))"""
CAND = """cand AS (SELECT a.lang, a.title, a.second, count(*) AS n_edits, count(DISTINCT b.usr) AS n_editors, any_value(baseline) AS baseline FROM (SELECT DISTINCT lang, title, second FROM edits) a
JOIN edits b ON b.lang = a.lang AND b.title = a.title AND b.second BETWEEN a.second - 10799 AND a.second JOIN wb ON wb.lang = a.lang AND wb.hour = a.second // 3600 GROUP BY ALL),
ok AS (SELECT * FROM cand WHERE n_edits >= 4 AND n_editors >= 3 AND 2 * n_edits >= 3 * baseline),
pick AS (SELECT lang, title, min(second) AS second FROM ok GROUP BY ALL UNION ALL
         SELECT p.lang, p.title, (SELECT min(o.second) FROM ok o WHERE o.lang = p.lang AND o.title = p.title AND o.second >= p.second + 21600) FROM pick p WHERE p.second IS NOT NULL)"""


def edit_rows(spark, sf_dir) -> DataFrame:
    rows = canonical.edits(spark, sf_dir)
    return rows.select("lang", "title", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("second"), "user")


@query("st3_wiki_baselines", "WITH " + EDITS + "SELECT lang, hour, round(baseline, 6)::DOUBLE AS baseline FROM wb")
def st3(spark, sf_dir):
    return bursts.wiki_baselines(edit_rows(spark, sf_dir), P).withColumn("baseline", F.round("baseline", b.R))


@query("st2_edit_bursts", "WITH RECURSIVE " + EDITS + "," + CAND + "SELECT p.lang, p.title, p.second, n_edits, n_editors::INT AS n_editors FROM pick p JOIN ok USING (lang, title, second)")
def st2(spark, sf_dir):
    return bursts.bursts(edit_rows(spark, sf_dir), P).drop("kind")


_NEW = """cr AS (SELECT event_type AS lang, 'T' || (user_id % 8) AS title, min(CAST(floor(epoch(ts)) AS BIGINT)) AS created FROM events WHERE event_id % 7 = 0 GROUP BY ALL),
cn AS (SELECT a.lang, a.title, a.second, created, count(*) FILTER (WHERE b.second > a.second - 10800) AS wn, count(DISTINCT b.usr) FILTER (WHERE b.second > a.second - 10800) AS we, any_value(baseline) AS baseline,
  count(*) FILTER (WHERE b.second >= created) AS nn, count(DISTINCT b.usr) FILTER (WHERE b.second >= created) AS ne FROM (SELECT DISTINCT lang, title, second FROM edits) a LEFT JOIN cr USING (lang, title)
  JOIN edits b ON b.lang = a.lang AND b.title = a.title AND b.second BETWEEN a.second - 86400 AND a.second JOIN wb ON wb.lang = a.lang AND wb.hour = a.second // 3600 GROUP BY ALL),
fit AS (SELECT lang, title, second, CASE WHEN wn >= 5 AND we >= 4 AND 2 * wn >= 3 * baseline THEN {'kind': 'window', 'n': wn, 'e': we}
  WHEN second BETWEEN created AND created + 86400 AND nn >= 3 AND ne >= 2 THEN {'kind': 'new', 'n': nn, 'e': ne} END AS found FROM cn),
took AS (SELECT lang, title, min(second) AS second FROM fit WHERE found IS NOT NULL GROUP BY ALL UNION ALL
         SELECT p.lang, p.title, (SELECT min(o.second) FROM fit o WHERE o.found IS NOT NULL AND o.lang = p.lang AND o.title = p.title AND o.second >= p.second + 21600) FROM took p WHERE p.second IS NOT NULL)"""


def new_rows(spark, sf_dir) -> DataFrame:
    """Edits with what tells new pages: every seventh edit is a page's creation, the first counts."""
    rows = canonical.edits(spark, sf_dir)
    return rows.select("event_id", "lang", "title", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("second"), "user", (F.col("event_id") % 7 == 0).alias("is_new"))


@query("st2_new_page_bursts", "WITH RECURSIVE " + EDITS + "," + _NEW + "SELECT t.lang, t.title, t.second, found.kind AS kind, found.n AS n_edits, found.e::INT AS n_editors FROM took t JOIN fit USING (lang, title, second)")
def st2_new(spark, sf_dir):
    return bursts.bursts(new_rows(spark, sf_dir), P_NEW)


@query("st7_live_view", "WITH RECURSIVE " + EDITS + "," + CAND + f""", bq AS (SELECT CAST(substr(p.title, 2) AS BIGINT) AS qid, p.lang, p.title, p.second, n_edits, n_editors FROM pick p JOIN ok USING (lang, title, second)),
nw AS (SELECT epoch(TIMESTAMP '2024-01-16 12:00:00')::BIGINT AS now), kp AS (SELECT bq.* FROM bq, nw WHERE second > now - 604800 AND second <= now),
f AS (SELECT qid, lang, min(second) AS s FROM kp GROUP BY ALL), lv AS (SELECT DISTINCT qid FROM (SELECT qid, s - lag(s) OVER (PARTITION BY qid ORDER BY s, lang) AS gap FROM f) WHERE gap <= 7200),
rc AS (SELECT kp.*, CASE WHEN qid IN (SELECT qid FROM lv) THEN 'event' ELSE 'single' END AS kind FROM kp, nw WHERE second > now - 259200)
SELECT qid, lang, title, second, kind FROM rc WHERE kind = 'event' UNION ALL (SELECT qid, lang, title, second, kind FROM rc WHERE kind = 'single' ORDER BY n_editors DESC, n_edits DESC, second DESC, lang, title LIMIT 5)""")
def st7(spark, sf_dir):
    rows = bursts.bursts(edit_rows(spark, sf_dir), P).drop("kind").withColumn("qid", F.substring("title", 2, 9).cast("long"))
    return bursts.live_view(rows, 1705406400, minutes=4320, keep_hours=168).select("qid", "lang", "title", "second", "kind")


@query("st11_late_entities", "WITH RECURSIVE " + EDITS + "," + CAND + ", ln AS (SELECT DISTINCT event_type AS lang, 'T' || (user_id % 8) AS title, user_id % 8 AS qid FROM events WHERE user_id % 8 < 7) SELECT lang, title, second, qid FROM pick LEFT JOIN ln USING (lang, title) WHERE second IS NOT NULL")
def st11(spark, sf_dir):
    """A third of the bursts knew their entity at once; the others get it when the links are read again."""
    number = F.substring("title", 2, 9).cast("long")
    rows = bursts.bursts(edit_rows(spark, sf_dir), P).withColumn("qid", F.when((number % 3 == 0) & (number < 7), number))
    return bursts.with_entities(rows, canonical.sitelinks(spark, sf_dir)).select("lang", "title", "second", "qid")


@query("st5_live_events", "WITH RECURSIVE " + EDITS + "," + CAND + """, f AS (SELECT CAST(substr(title, 2) AS BIGINT) AS qid, lang, min(second) AS s FROM pick WHERE second IS NOT NULL GROUP BY ALL),
g AS (SELECT *, s - lag(s) OVER (PARTITION BY qid ORDER BY s, lang) AS gap FROM f) SELECT qid, min(s) FILTER (WHERE gap <= 86400) AS second, min(s) AS first, count(*) AS languages FROM g GROUP BY qid HAVING count(*) FILTER (WHERE gap <= 86400) > 0""")
def st5(spark, sf_dir):
    rows = bursts.bursts(edit_rows(spark, sf_dir), P).withColumn("qid", F.substring("title", 2, 9).cast("long"))
    return bursts.live_events(rows, 1440)


@query("st1_filtered_edits", f"""SELECT event_id, event_type AS lang, to_timestamp(floor(epoch(ts)))::TIMESTAMP AS time FROM events WHERE event_type IN ('view', 'click', 'purchase') AND event_id % 5 <> 0 AND event_id % 13 <> 0 AND user_id % 10 <> 0 AND event_id % 11 <> 0
AND {canonical.COMMENTS!r}[event_id % {len(canonical.COMMENTS)} + 1] NOT IN ('Reverted edits by A', 'fix typo', 'rv vandalism', 'HotCat: +category')""")
def st1(spark, sf_dir):
    """Change events in JSON files as a stream: parsed, filtered, and timed by their own second or else by their date."""
    path = scratch(spark, "changes")
    canonical.changes(spark, sf_dir).write.json(path)
    schema = "event_id long, wiki string, namespace int, type string, bot boolean, title string, user string, comment string, tags array<string>, timestamp long, dt string"
    known = spark.createDataFrame([(k + "wiki", k) for k in ("view", "click", "purchase")], "wiki string, lang string")
    rows = bursts.article_edits(spark.readStream.schema(schema).json(path), known).select("event_id", "lang", "time")
    return drained(rows, spark, "append", "edits").withColumn("time", F.col("time").cast("timestamp_ntz"))


def event_stream(spark, sf_dir) -> DataFrame:
    """The events table as a file stream, with a time that watermarks accept."""
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("time", F.col("ts").cast("timestamp"))


def drained(rows: DataFrame, spark, mode: str, name: str) -> DataFrame:
    """Run a stream over what is there now, each batch's result written to the shared folder; read the last."""
    out = scratch(spark, name)
    empty = spark.createDataFrame([], rows.schema)
    empty.write.parquet(out)
    write = lambda df, _: df.write.mode("overwrite" if mode == "complete" else "append").parquet(out)
    q = rows.writeStream.outputMode(mode).option("checkpointLocation", scratch(spark, name + "-log")).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


_CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


@query("st4_stream_slots", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS slot, event_type AS lang, count(*) AS n, round(CASE WHEN bit_count(bit_or(1::BIGINT << (user_id % 63)::INT)) >= 63 THEN 63.0 ELSE -63 * ln(1 - bit_count(bit_or(1::BIGINT << (user_id % 63)::INT)) / 63) END, 6) AS editors FROM events GROUP BY ALL HAVING time_bucket(INTERVAL 5 MINUTE, any_value(ts)) + INTERVAL 5 MINUTE <= " + _CLOSED)
def st4(spark, sf_dir):
    """Slots that the watermark has closed, each written once; no state is kept for them."""
    rows = event_stream(spark, sf_dir).withWatermark("time", "1 hour").groupBy(F.window("time", "5 minutes").alias("w"), F.col("event_type").alias("lang"))
    rows = rows.agg(F.count("*").alias("n"), robust.bitmap(F.col("user_id"), 63).alias("bits"))
    slots = drained(rows.select(F.col("w.start").alias("slot"), "lang", "n", "bits"), spark, "append", "slots")
    return slots.select(F.col("slot").cast("timestamp_ntz").alias("slot"), "lang", "n", F.round(robust.linear_count(F.col("bits"), 63), b.R).alias("editors"))


@query("st12_hourly_stream", "SELECT date_trunc('hour', ts) AS ts_hour, event_type AS lang, 'T' || (user_id % 8) AS title, CAST(sum(CASE WHEN event_id % 2 = 0 THEN floor(value * 10) ELSE 0 END) AS BIGINT) AS views_desktop, CAST(sum(CASE WHEN event_id % 2 = 1 THEN floor(value * 10) ELSE 0 END) AS BIGINT) AS views_mobile FROM events GROUP BY ALL HAVING date_trunc('hour', any_value(ts)) + INTERVAL 1 HOUR <= " + _CLOSED)
def st12(spark, sf_dir):
    """Reads as a stream: an hour's sums are written once the hour is closed, and feed the same staging as batch hours."""
    rows = event_stream(spark, sf_dir).select("time", F.col("event_type").alias("lang"), F.concat(F.lit("T"), F.col("user_id") % 8).alias("title"), F.floor(F.col("value") * 10).alias("v"), (F.col("event_id") % 2 == 1).alias("is_mobile"))
    hours = drained(bursts.hourly_counts(rows), spark, "append", "hours")
    return hours.withColumn("ts_hour", F.col("ts_hour").cast("timestamp_ntz"))


@query("st8_bursts_per_hour", "WITH RECURSIVE " + EDITS + "," + CAND + "SELECT lang, second // 3600 AS hour, count(*) AS n FROM pick WHERE second IS NOT NULL GROUP BY ALL")
def st8(spark, sf_dir):
    return bursts.bursts(edit_rows(spark, sf_dir), P).groupBy("lang", F.expr("second div 3600").alias("hour")).agg(F.count("*").alias("n"))


@query("st9_gaps", """SELECT event_type AS lang, max(gap) AS longest_gap, count(*) FILTER (WHERE gap > 21600) AS n_gaps FROM (SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) - lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS gap FROM events) GROUP BY ALL""")
def st9(spark, sf_dir):
    """Gaps inside an hour, and between an hour's last and the next one's first event: a wiki meets as a row an hour."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("lang"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s")).withColumn("h", F.expr("s div 3600"))
    inside = rows.withColumn("gap", F.col("s") - F.lag("s").over(Window.partitionBy("lang", "h").orderBy("s"))).groupBy("lang", "h")
    hours = inside.agg(F.min("s").alias("a"), F.max("s").alias("z"), F.max("gap").alias("own"), F.count_if(F.col("gap") > 21600).alias("n"))
    hours = hours.withColumn("gap", F.col("a") - F.lag("z").over(Window.partitionBy("lang").orderBy("h")))
    return hours.groupBy("lang").agg(F.max(F.greatest("own", "gap")).alias("longest_gap"), (F.sum("n") + F.count_if(F.col("gap") > 21600)).alias("n_gaps"))


@query("st13_stream_profile", """WITH e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events), span AS (SELECT (max(s) - min(s) + 1) / 3600 AS hours FROM e)
SELECT event_type AS kind, count(*) AS n, round(count(*) / any_value(hours), 6) AS per_hour, round(avg(CASE WHEN user_id % 10 = 0 THEN 1 ELSE 0 END), 6) AS bot_share, count(DISTINCT s // 3600) AS hours_seen,
round(median(value), 6) AS middle, round(quantile_cont(value, 0.95), 6) AS q95 FROM e, span GROUP BY ALL""")
def st13(spark, sf_dir):
    """Rates over the time that the stream covers, and exact quantiles of what an event weighs."""
    s = F.unix_timestamp(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), "user_id", "value", s.alias("s"))
    sums = rows.groupBy("kind").agg(F.count("*").alias("n"), F.avg((F.col("user_id") % 10 == 0).cast("int")).alias("bot_share"), F.countDistinct(F.expr("s div 3600")).alias("hours_seen"))
    span = rows.agg(((F.max("s") - F.min("s") + 1) / 3600).alias("hours"))  # one row
    found = sums.crossJoin(F.broadcast(span)).withColumn("per_hour", F.col("n") / F.col("hours")).drop("hours")
    found = found.join(quantiles.quantile_columns(rows, ["kind"], "value", {"middle": 0.5, "q95": 0.95}), "kind")
    return found.withColumns({c: F.round(c, b.R) for c in ("per_hour", "bot_share", "middle", "q95")})
