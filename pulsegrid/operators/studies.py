"""Studies over events: countries and languages, delays, audits, edits before events, and death lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hours_from(ts: Column, n: Column | int) -> Column:
    return F.timestamp_add("HOUR", F.lit(n) if isinstance(n, int) else n, ts)


def entity_countries(claims: DataFrame, places: DataFrame) -> DataFrame:
    """(qid, country): an entity's own countries, else those of its locations. claims (qid, p17, p276), places
    (place, country)."""
    own = claims.select("qid", F.explode("p17").alias("country"))
    rest = claims.filter(F.coalesce(F.size("p17"), F.lit(0)) == 0).select("qid", F.explode("p276").alias("place"))
    return own.union(rest.join(places, "place").select("qid", "country")).distinct()


def lead_is_official(events: DataFrame, countries: DataFrame, official: DataFrame) -> DataFrame:
    """Events whose entity has a country, with is_official: the lead language is one of any of its countries. official
    (country, lang) is a fixed table."""
    known = events.select("event_id", "qid", "lead_lang").join(countries, "qid")
    hits = known.join(F.broadcast(official.withColumn("hit", F.lit(True))), (known["country"] == official["country"]) & (known["lead_lang"] == official["lang"]), "left")
    return hits.groupBy("event_id", "lead_lang").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("is_official"))


def resolved_country(rows: DataFrame, rules: DataFrame, places: DataFrame) -> DataFrame:
    """(id, country) by priority: a row's own country; its state's by rule; a place of its list that is a country, from the last
    (widest) to the first; such a place's own country. rows (id, own, state, places), rules (state, country), places
    (place, is_country, country)."""
    spread = rows.select("id", F.posexplode(F.reverse("places")).alias("at", "place")).join(places, "place")
    rank = F.when(F.col("is_country"), F.struct(F.lit(2).alias("step"), "at", F.col("place").alias("country"))).when(F.col("country").isNotNull(), F.struct(F.lit(3).alias("step"), "at", "country"))
    best = spread.groupBy("id").agg(F.min(rank).alias("x"))
    out = rows.join(F.broadcast(rules.withColumnRenamed("country", "by_state")), "state", "left").join(best, "id", "left")  # a fixed rule table
    return out.select("id", F.coalesce("own", "by_state", "x.country").alias("country"))


def detection_delays(majors: DataFrame, events: DataFrame, window_hours: int) -> DataFrame:
    """(date, qid, delay): hours from a day's beginning to its entity's first event within the window."""
    day = F.col("date").cast("timestamp_ntz")
    e = events.select("qid", "start_hour")
    near = majors.join(e, "qid").filter((F.col("start_hour") >= hours_from(day, -window_hours)) & (F.col("start_hour") < hours_from(day, 24 + window_hours)))
    return near.groupBy("date", "qid").agg(F.min(F.timestamp_diff("HOUR", day, F.col("start_hour"))).alias("delay"))


def quartiles(rows: DataFrame, value: str, *by: str, least: int = 1) -> DataFrame:
    """Quartiles of whole numbers from their counts by value: no group's rows meet in one place."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("k"))
    q = lambda p: F.expr(f"percentile({value}, {p}, k)")
    return counts.groupBy(*by).agg(F.sum("k").alias("n"), q(0.25).alias("q25"), q(0.5).alias("middle"), q(0.75).alias("q75")).filter(F.col("n") >= least)


def series(events: DataFrame, hourly: DataFrame, before: int = 48, hours: int = 96) -> DataFrame:
    """(event_id, series): the hourly views of an event's entity from before hours ahead of its start, hours with none as zero."""
    first = hours_from(F.col("start_hour"), -before)
    grid = events.select("event_id", "qid", F.posexplode(F.sequence(first, hours_from(F.col("start_hour"), hours - before - 1), F.expr("INTERVAL 1 HOUR"))).alias("i", "ts_hour"))
    sums = hourly.groupBy("qid", "ts_hour").agg(F.sum("views").alias("views"))
    rows = grid.join(sums, ["qid", "ts_hour"], "left").select("event_id", F.struct("i", F.coalesce("views", F.lit(0)).alias("v")).alias("x"))
    return rows.groupBy("event_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["v"].cast("string")), " ").alias("series"))


def edit_leads(events: DataFrame, bursts: DataFrame, hours: int = 24) -> DataFrame:
    """events with lead_minutes: from the first burst of the entity within so many hours of the start to the start."""
    start = F.unix_timestamp(F.col("start_hour").cast("timestamp"))
    b = bursts.select("qid", "second")
    near = events.join(b, "qid").filter(F.abs(F.col("second") - start) <= 3600 * hours)
    first = near.groupBy("event_id").agg(F.min("second").alias("second"))
    return events.join(first, "event_id", "left").withColumn("lead_minutes", F.floor((start - F.col("second")) / 60))


def burst_hits(bursts: DataFrame, events: DataFrame, before: int = 2, after: int = 24) -> DataFrame:
    """bursts (id, qid, second, ...) with hit: an event of the entity starts from before hours ahead of the burst's hour to after
    hours behind it."""
    floor = hours_from(F.lit("1970-01-01").cast("timestamp_ntz"), F.expr("int(second div 3600)"))
    e = events.select(F.col("qid").alias("eq"), "start_hour")
    near = (F.col("qid") == F.col("eq")) & (F.col("start_hour") >= hours_from(floor, -before)) & (F.col("start_hour") <= hours_from(floor, after))
    return bursts.join(e, near, "left").groupBy(*bursts.columns).agg(F.bool_or(F.col("eq").isNotNull()).alias("hit"))


def first_edit_after(events: DataFrame, edits: DataFrame, lag_minutes: int, hours: int = 24) -> DataFrame:
    """(event_id, edit_minutes, lead_minutes): the entity's first edit at or after the start, and how long before the hour's counts
    are published (an hour and lag_minutes after the start) that is."""
    start = F.unix_timestamp(F.col("start_hour").cast("timestamp"))
    near = events.select("event_id", "qid", "start_hour").join(edits.select("qid", "second"), "qid").filter((F.col("second") >= start) & (F.col("second") < start + 3600 * hours))
    first = near.groupBy("event_id").agg(F.min(F.floor((F.col("second") - start) / 60)).alias("edit_minutes"))
    return first.withColumn("lead_minutes", 60 + lag_minutes - F.col("edit_minutes"))


def death_list(pages: DataFrame) -> DataFrame:
    """(page, day, title) of pages of deaths: the heading of a day carries forward, an entry's first link is the person."""
    heading, link = r"^==\s*(\d{1,2})\s*==\s*$", r"\[\[([^\[\]|#]+)(?:\|[^\[\]]*)?\]\]"
    lines = pages.select("page", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    order = Window.partitionBy("page").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    day = F.last(F.when(F.col("line").rlike(heading), F.regexp_extract("line", heading, 1).cast("int")), ignorenulls=True).over(order)
    rows = lines.withColumn("day", day).filter(F.col("line").startswith("*") & F.col("day").isNotNull())
    return rows.withColumn("title", F.trim(F.regexp_extract("line", link, 1))).filter("title != ''").select("page", "day", "title")


def first_revision(targets: DataFrame, revisions: DataFrame, words: str, before: int = 1, after: int = 2) -> DataFrame:
    """targets (title, date) with first: the earliest revision whose comment has one of the words, from before days ahead of the date
    to, not including, after days behind it."""
    told = revisions.filter(F.lower("comment").rlike(words)).select(F.col("title").alias("rt"), "ts")
    day = F.col("date").cast("timestamp_ntz")
    near = (F.col("title") == F.col("rt")) & (F.col("ts") >= hours_from(day, -24 * before)) & (F.col("ts") < hours_from(day, 24 * after))
    return targets.join(told, near, "left").groupBy("title", "date").agg(F.min("ts").alias("first"))


def major_links(links: DataFrame, entities: DataFrame, least_languages: int = 3) -> DataFrame:
    """links with is_major: resolved to an entity that is not generic and has enough languages. entities (qid, n_languages,
    is_generic)."""
    rows = links.join(entities, "qid", "left")
    return rows.withColumn("is_major", F.coalesce(~F.col("is_generic") & (F.col("n_languages") >= least_languages), F.lit(False)))


def cards(events: DataFrame, least_tier: str | None = None, text: str | None = None, category: str | None = None, lang: str | None = None) -> DataFrame:
    """The events that a reader's filter keeps. events has tier, category, labels (a map), qid and languages."""
    from pulsegrid.functions.titles import folded

    rank = lambda t: F.coalesce(F.array_position(F.array(F.lit("noticed"), F.lit("international"), F.lit("planetary")), t), F.lit(0))
    keep = F.lit(True)
    if least_tier:
        keep &= rank(F.col("tier")) >= rank(F.lit(least_tier))
    if text:
        sought = folded(F.lit(text))
        keep &= F.exists(F.map_values("labels"), lambda x: F.contains(folded(x), sought)) | (F.concat(F.lit("q"), "qid") == sought)
    if category:
        keep &= F.col("category") == category
    if lang:
        keep &= F.array_contains("languages", lang)
    return events.filter(keep)
