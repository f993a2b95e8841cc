"""Files: dumps written and scanned again, the lake, ledgers, exports, and filters of what comes in."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import titles
from pulsegrid.operators import staging
from pulsegrid.plans import base as b
from pulsegrid.plans.registry import query
from pulsegrid.plans.selections import wide
from pulsegrid.plans.streams import CAND, EDITS, P, edit_rows
from pulsegrid.session import scratch, table
from pulsegrid.sources import canonical, dumps, lake
from pulsegrid.streaming import bursts

# ---------------------------------------------------------------- dump files
#: What the dump lines hold: some titles are no articles, some lines are broken, some projects and kinds are others.
_READS = """reads AS (SELECT *, date_trunc('hour', ts) AS ts_hour, floor(value * 10)::BIGINT AS v,
  CASE WHEN user_id % 13 = 0 THEN 'Talk:T' || user_id % 40 WHEN user_id % 17 = 0 THEN '-' WHEN user_id % 19 = 0 THEN 'Main_Page' ELSE 'T' || user_id % 40 END AS title FROM events),
fit AS (SELECT * FROM reads WHERE title <> '-' AND title <> 'Main_Page' AND NOT starts_with(title, 'Talk:') AND event_type <> 'signup')"""
_MERGED = """SELECT ts_hour, event_type AS lang, title, CAST(sum(CASE WHEN event_id % 2 = 1 THEN 0 ELSE v END) AS BIGINT) AS views_desktop,
CAST(sum(CASE WHEN event_id % 2 = 1 THEN v ELSE 0 END) AS BIGINT) AS views_mobile FROM fit WHERE {} GROUP BY ALL HAVING sum(v) >= 5"""


def reads(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    user = F.col("user_id")
    own = F.concat(F.lit("T"), user % 40)
    title = F.when(user % 13 == 0, F.concat(F.lit("Talk:"), own)).when(user % 17 == 0, "-").when(user % 19 == 0, "Main_Page").otherwise(own)
    return e.select("event_id", "event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts_hour"), title.alias("title"), F.floor(F.col("value") * 10).alias("v"))


def finalised(spark, raw):
    """The end that both kinds of dumps share: articles only, desktop and mobile sums, retained hours."""
    excluded = spark.createDataFrame([(k, "Main_Page") for k in ("view", "click", "purchase", "error", "signup")], "lang string, title string")
    namespaces = spark.createDataFrame([(k, "talk") for k in ("view", "click", "purchase", "error", "signup")], "lang string, prefix string")
    return staging.merge_counts(staging.articles(raw, excluded, namespaces))


@query("d1_ingest_hourly_files", "WITH " + _READS + _MERGED.format("event_id % 23 <> 0"))
def d1(spark, sf_dir):
    """Gzip files by hour, named by the hour after; every 23rd line is broken."""
    n = F.col("event_id")
    code = F.concat("event_type", F.when(n % 2 == 1, ".m").otherwise(""))
    line = F.when(n % 23 != 0, F.concat_ws(" ", code, "title", F.col("v").cast("string"), F.lit("0"))).when(n % 2 == 0, F.concat_ws(" ", code, "title", F.lit("x"), F.lit("0")))
    line = line.otherwise(F.concat_ws(" ", code, "title", F.lit("5"), F.lit("0"), F.lit("0")))
    name = F.date_format(F.col("ts_hour") + F.expr("INTERVAL 1 HOUR"), "'pageviews-'yyyyMMdd-HHmmss")
    path = scratch(spark, "dumps")
    dumps.write_dump(reads(spark, sf_dir).select(name.alias("file"), line.alias("value")), path, "gzip")
    rows = dumps.scan_hourly(spark, path).withColumn("p", staging.project_code(F.col("project"), ["signup"])).filter("p IS NOT NULL")
    return finalised(spark, rows.select("ts_hour", "p.lang", "title", F.col("views").alias("v"), "p.is_mobile"))


def daily_path(spark, sf_dir):
    """Bzip2 files by day; every 29th read is of another project, every 31st of another kind of access."""
    n = F.col("event_id")
    wiki = F.concat("event_type", F.when(n % 29 == 0, ".wiktionary").otherwise(".wikipedia"))
    access = F.when(n % 31 == 0, "other").when(n % 4 == 3, "mobile-app").when(n % 2 == 1, "mobile-web").otherwise("desktop")
    cells = reads(spark, sf_dir).groupBy(F.to_date("ts_hour").alias("day"), wiki.alias("wiki"), "title", access.alias("access"), F.hour("ts_hour").alias("h")).agg(F.sum("v").alias("v"))
    coded = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("h", "v"))), lambda x: F.concat(F.char(x["h"] + 65), x["v"].cast("string"))), "")
    rows = cells.groupBy("day", "wiki", "title", "access").agg(F.sum("v").alias("total"), coded.alias("hours"))
    page = F.when(F.length("title") % 2 == 0, F.lit("null"))  # some lines have no page id
    off = F.when(F.col("total") % 10 == 3, 1).otherwise(0)  # totals that don't match their cells
    line = F.concat_ws(" ", "wiki", "title", page, "access", (F.col("total") + off).cast("string"), "hours")
    path = scratch(spark, "daily")
    dumps.write_dump(rows.select(F.date_format("day", "'pageviews-'yyyyMMdd").alias("file"), line.alias("value")), path, "bzip2")
    return path


@query("d2_ingest_daily_files", "WITH " + _READS + _MERGED.format("event_id % 29 <> 0 AND event_id % 31 <> 0"))
def d2(spark, sf_dir):
    rows = dumps.scan_daily(spark, daily_path(spark, sf_dir))
    rows = rows.withColumn("p", dumps.access_kind(F.col("wiki"), F.col("access"))).filter("p IS NOT NULL AND p.lang != 'signup'")
    return finalised(spark, rows.select("ts_hour", "p.lang", "title", F.col("views").alias("v"), "p.is_mobile"))


_KIND = "CASE WHEN event_id % 31 = 0 THEN 'other' WHEN event_id % 4 = 3 THEN 'mobile-app' WHEN event_id % 2 = 1 THEN 'mobile-web' ELSE 'desktop' END"


@query("p3_access_filter", "WITH " + _READS + f"SELECT event_type AS lang, {_KIND} <> 'desktop' AS is_mobile, CAST(sum(v) AS BIGINT) AS views FROM reads WHERE event_id % 29 <> 0 AND event_id % 31 <> 0 GROUP BY ALL")
def p3(spark, sf_dir):
    rows = dumps.scan_daily(spark, daily_path(spark, sf_dir)).withColumn("p", dumps.access_kind(F.col("wiki"), F.col("access")))
    return rows.filter("p IS NOT NULL").groupBy("p.lang", "p.is_mobile").agg(F.sum("views").alias("views"))


@query("e22_codec_check_files", "WITH " + _READS + f", t AS (SELECT ts_hour::DATE AS day, event_type || CASE WHEN event_id % 29 = 0 THEN '.wiktionary' ELSE '.wikipedia' END AS wiki, title, {_KIND} AS access, sum(v) AS total FROM reads GROUP BY ALL) SELECT wiki, count(*) AS n_lines, count(*) FILTER (WHERE total % 10 <> 3) AS n_matching FROM t GROUP BY wiki")
def e22_files(spark, sf_dir):
    rows = dumps.scan_daily(spark, daily_path(spark, sf_dir))
    lines = rows.groupBy(F.to_date("ts_hour").alias("day"), "wiki", "title", "access", "daily_total").agg(F.sum("views").alias("v"))
    return lines.groupBy("wiki").agg(F.count("*").alias("n_lines"), F.count_if(F.col("v") == F.col("daily_total")).alias("n_matching"))


# ---------------------------------------------------------------- the lake
@query("s12_compact", b.with_(b.HOURLY) + "SELECT day, count(*) AS n_rows, count(DISTINCT ts_hour) AS files_before, 1::BIGINT AS files_after FROM stg GROUP BY day")
def s12(spark, sf_dir):
    source, target = scratch(spark, "hours"), scratch(spark, "days")
    canonical.hourly(spark, sf_dir).withColumn("hour", F.date_format("ts_hour", "yyyyMMddHH")).repartition("hour").write.partitionBy("hour").parquet(source)
    return lake.compact(spark, source, target)


@query("s4_read_lake", b.with_(b.HOURLY) + "SELECT day, lang, CAST(sum(views) AS BIGINT) AS views FROM stg WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' GROUP BY ALL")
def s4(spark, sf_dir):
    path = scratch(spark, "lake")
    lake.write_days(canonical.hourly(spark, sf_dir), path)
    rows = lake.read_days(spark, path, "2024-01-05", "2024-01-12")
    return rows.groupBy("day", "lang").agg(F.sum(F.col("views_desktop") + F.col("views_mobile")).alias("views"))


@query("s15_pending_days", b.with_(b.HOURLY) + "SELECT day, count(*) AS n_rows, day >= DATE '2024-01-16' AS built_now FROM stg GROUP BY day")
def s15(spark, sf_dir):
    rows, target = b.stg(spark, sf_dir), scratch(spark, "target")
    rows.filter("day < DATE '2024-01-16'").repartition("day").write.partitionBy("day").parquet(target)
    built = lake.build_pending(rows, target, lambda some: some)
    built = spark.createDataFrame(built.collect(), "day date").withColumn("built_now", F.lit(True))  # a row a day, as read before the build
    found = spark.read.parquet(target).groupBy("day").agg(F.count("*").alias("n_rows"))
    return found.join(F.broadcast(built), "day", "left").select("day", "n_rows", F.coalesce("built_now", F.lit(False)).alias("built_now"))


@query("s6_read_manifest", b.with_(b.HOURLY) + "SELECT ts_hour, count(*) AS n_rows, CASE WHEN hour(ts_hour) % 2 = 0 THEN 'hourly' ELSE 'daily' END AS source FROM stg GROUP BY ts_hour")
def s6(spark, sf_dir):
    hours = lake.ledger(canonical.hourly(spark, sf_dir))
    entry = F.struct(F.col("n_rows").alias("rows"), F.when(F.hour("ts_hour") % 2 == 0, "hourly").otherwise("daily").alias("source"))
    whole = hours.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.date_format("ts_hour", "yyyy-MM-dd'T'HH"), entry)))).alias("value"))  # an entry an hour
    path = scratch(spark, "manifest")
    whole.write.text(path)
    return dumps.read_manifest(spark, path)


@query("s7_read_bursts", "WITH RECURSIVE " + EDITS + "," + CAND + "SELECT p.lang, p.title, p.second, n_edits, n_editors::INT AS n_editors FROM pick p JOIN ok USING (lang, title, second) WHERE to_timestamp(p.second)::DATE = DATE '2024-01-10'")
def s7(spark, sf_dir):
    path = scratch(spark, "bursts")
    bursts.bursts(edit_rows(spark, sf_dir), P).write.json(path)
    return dumps.read_bursts(spark, path, "2024-01-10")


@query("s8_read_labels", "SELECT doc_id AS unit_id, quality AS label FROM labels")
def s8(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("unit_id"), F.col("quality").alias("label"))
    path = scratch(spark, "labels")
    rows.write.option("header", True).csv(path)
    return dumps.read_labels(spark, path, rows)


@query("s5_register_views", b.with_(b.HOURLY) + "SELECT qid, CAST(sum(views) AS BIGINT) AS views FROM stg JOIN links USING (lang, title) GROUP BY qid")
def s5(spark, sf_dir):
    lake.register_views(spark, canonical.hourly(spark, sf_dir), canonical.sitelinks(spark, sf_dir))
    return spark.sql("SELECT qid, sum(views_desktop + views_mobile) AS views FROM hourly JOIN sitelinks USING (lang, title) GROUP BY qid")


_EVENTS = b.with_(b.HOURLY, b.LOUD, b.event_sql(langs=2, threshold=1.2))
#: Fixed: the columns of an export, in order.
EXPORT = ["event_id", "qid", "label", "start_hour", "lead_lang", "breadth", "tier", "event_class", "peak_intensity", "excess_views", "median_spread_lag_hours", "max_spread_lag_hours", "lead_excess_share", "languages"]


@query("s14_export_csv", _EVENTS + """SELECT event_id, CAST(qid AS VARCHAR) AS qid, 'The "T' || qid || '", so called' AS label, lead_lang, CAST(breadth AS VARCHAR) AS breadth, tier, languages, 14::BIGINT AS n_columns FROM ev""")
def s14(spark, sf_dir):
    rows = wide(spark, sf_dir).withColumns({"languages": F.concat_ws(",", "languages"), "label": F.concat(F.lit('The "T'), "qid", F.lit('", so called'))})
    path = scratch(spark, "export")
    rows.select(EXPORT).write.option("header", True).option("escape", '"').csv(path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select("event_id", "qid", "label", "lead_lang", "breadth", "tier", "languages", F.lit(len(back.columns)).cast("long").alias("n_columns"))


@query("u2_union_by_name", b.with_(b.HOURLY) + "SELECT lang, count(*) AS n_rows, count(*) FILTER (WHERE day >= DATE '2024-01-15') AS with_mobile, CAST(sum(CASE WHEN day >= DATE '2024-01-15' THEN views_mobile ELSE 0 END) AS BIGINT) AS views_mobile FROM stg GROUP BY lang")
def u2(spark, sf_dir):
    rows, old, new = b.stg(spark, sf_dir), scratch(spark, "old"), scratch(spark, "new")
    rows.filter("day < DATE '2024-01-15'").select("lang", "title", "ts_hour", "views_desktop").write.parquet(old)
    rows.filter("day >= DATE '2024-01-15'").select("views_mobile", "lang", "title", "ts_hour", "views_desktop").write.parquet(new)
    both = lake.read_evolving(spark, old, new)
    return both.groupBy("lang").agg(F.count("*").alias("n_rows"), F.count("views_mobile").alias("with_mobile"), F.coalesce(F.sum("views_mobile"), F.lit(0)).alias("views_mobile"))


@query("d26_replaced_hours", b.with_(b.HOURLY) + f"SELECT ts_hour, lang, title, CASE WHEN hour_of_day >= 12 THEN views + 1 ELSE views END AS views FROM stg WHERE day = DATE '{b.DAY}' AND NOT (hour_of_day >= 12 AND views < 50)")
def d26(spark, sf_dir):
    """The hours that were scored anew replace the day file's, also where they have fewer rows."""
    day = b.stg(spark, sf_dir).filter(F.col("day") == F.lit(b.DAY).cast("date")).select("ts_hour", "lang", "title", "views")
    new = day.filter("hour(ts_hour) >= 12 AND views >= 50").withColumn("views", F.col("views") + 1)
    return lake.merged_hours(day, new, overwrite=True)


# ---------------------------------------------------------------- filters and functions of what comes in
_CHANGES = f"""ch AS (SELECT event_id, event_type, event_id % 5 = 0 AS talk, event_id % 13 = 0 AS log, user_id % 10 = 0 AS bot, user_id % 12 = 0 AS named_bot, event_id % 11 = 0 AS reverted,
{canonical.COMMENTS!r}[event_id % {len(canonical.COMMENTS)} + 1] AS comment FROM events), mt AS (SELECT *, comment IN ('Reverted edits by A', 'fix typo', 'rv vandalism', 'HotCat: +category') AS maintenance FROM ch)"""


@query("p7_edit_filter", "WITH " + _CHANGES + " SELECT event_id, event_type AS lang FROM mt WHERE event_type <> 'error' AND NOT talk AND NOT log AND NOT bot AND NOT reverted AND NOT maintenance")
def p7(spark, sf_dir):
    known = spark.createDataFrame([(k + "wiki", k) for k in ("view", "click", "purchase", "signup")], "wiki string, lang string")
    return bursts.article_edits(canonical.changes(spark, sf_dir), known).select("event_id", "lang")


@query("p8_historical_revisions", "WITH " + _CHANGES + " SELECT comment, count(*) AS n FROM mt WHERE NOT named_bot AND NOT reverted AND NOT maintenance GROUP BY comment")
def p8(spark, sf_dir):
    rows = bursts.historical_revisions(canonical.changes(spark, sf_dir))
    return rows.groupBy("comment").agg(F.count("*").alias("n"))


@query("f4_folded", """WITH f AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5(replace(replace(replace(replace(replace(replace(replace(replace(replace(strip_accents(t), 'æ', 'ae'), 'œ', 'oe'), 'ß', 'ss'), 'þ', 'th'), 'ø', 'o'), 'đ', 'd'), 'ł', 'l'), 'ð', 'd'), 'ı', 'i')) AS folded FROM f""")
def f4(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(titles.folded(F.col("text"))).alias("folded"))


@query("f18_salted_users", "SELECT event_type AS lang, sha256('salt' || user_id) AS user_hash, count(*) AS n FROM events GROUP BY ALL")
def f18(spark, sf_dir):
    user = bursts.hashed_user(F.col("user_id").cast("string"), "salt")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("lang"), user.alias("user_hash")).agg(F.count("*").alias("n"))


_BOXES = """boxes AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN '{{Infobox quake}}' ELSE '{{Infobox quake | timestamp = ' || strftime(o_orderdate::DATE, '%Y-%m-%d') || ' 0' || o_orderkey % 10 || ':15:00 | mag = 6 }}' END AS box,
CASE WHEN o_orderkey % 3 = 0 THEN 'Old Town' ELSE (o_custkey % 90) || ' km NNE of Place ' || o_custkey || ', ' || n_name END AS place FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""


@query("f19_times_and_places", "WITH " + _BOXES + r"""SELECT id, try_cast(nullif(regexp_extract(box, '\|\s*timestamp\s*=\s*(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)', 1), '') AS TIMESTAMP) AS at, try_cast(nullif(regexp_extract(place, '^(\d+) km', 1), '') AS INT) AS km,
CASE WHEN contains(place, ' km ') THEN regexp_extract(place, ' of (.+), ', 1) ELSE place END AS town, CASE WHEN contains(place, ', ') THEN string_split(place, ', ')[-1] END AS region FROM boxes""")
def f19(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    time = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 0"), F.col("o_orderkey") % 10, F.lit(":15:00"))
    box = F.when(F.col("o_orderkey") % 4 == 0, "{{Infobox quake}}").otherwise(F.concat(F.lit("{{Infobox quake | timestamp = "), time, F.lit(" | mag = 6 }}")))
    place = F.when(F.col("o_orderkey") % 3 == 0, "Old Town").otherwise(F.concat(F.col("o_custkey") % 90, F.lit(" km NNE of Place "), F.col("o_custkey"), F.lit(", "), F.col("n_name")))
    rows = o.select(F.col("o_orderkey").alias("id"), box.alias("box"), place.alias("place"))
    return rows.select("id", titles.infobox_time(F.col("box")).alias("at"), titles.place_parts(F.col("place")).alias("p")).select("id", "at", "p.km", "p.town", "p.region")
