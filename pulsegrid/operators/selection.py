"""Ranking, rollups and per-day documents of events and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.robust import quotient


def top_rows(rows: DataFrame, n: int, order: list[Column], *by: str) -> DataFrame:
    """The first n rows of each group; Spark prunes by rank before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= n)


def selected_events(events: DataFrame, by_breadth: int, by_excess: int, per_language: int) -> DataFrame:
    """Events among the broadest, those of most excess, or the broadest of their lead language."""
    day = F.to_date("start_hour")
    rank = lambda *order, by=(): F.row_number().over(Window.partitionBy(day, *by).orderBy(*order))
    broad = (F.desc("breadth"), F.desc("peak_intensity"), F.col("event_id"))
    rows = events.withColumns({
        "by_breadth": rank(*broad), "by_excess": rank(F.desc("excess_views"), F.col("event_id")),
        "by_language": rank(*broad, by=("lead_lang",)),
    })
    return rows.filter((F.col("by_breadth") <= by_breadth) | (F.col("by_excess") <= by_excess) | (F.col("by_language") <= per_language))


def sparklines(events: DataFrame, hourly: DataFrame, known_until: Column, hours: int = 48, before: int = 24) -> DataFrame:
    """Total views of an event's entity over so many hours from before its start: missing hours are zero, hours
    after known_until are null."""
    first = F.expr(f"start_hour - INTERVAL {before} HOURS")
    grid = events.select("event_id", "qid", "start_hour", F.posexplode(F.sequence(first, F.expr(f"start_hour + INTERVAL {hours - before - 1} HOURS"), F.expr("INTERVAL 1 HOUR"))).alias("i", "ts_hour"))
    sums = hourly.groupBy("qid", "ts_hour").agg(F.sum("views").alias("views"))
    rows = grid.join(sums, ["qid", "ts_hour"], "left")
    value = F.when(F.col("ts_hour") <= known_until, F.coalesce("views", F.lit(0)))
    slots = F.sort_array(F.collect_list(F.struct("i", value.alias("v"))))
    return rows.groupBy("event_id").agg(slots.alias("slots")).select("event_id", F.col("slots.v").alias("spark"))


def rollup_by_language(counts: DataFrame) -> DataFrame:
    """Human, automated and all views of each language with rank and cumulative share of the human ones; NaN where there are none."""
    sums = counts.groupBy("lang").agg(F.sum("views").alias("raw_views"), F.sum(F.when(~F.col("is_automated"), F.col("views")).otherwise(0)).alias("human_views"))
    order = Window.partitionBy("whole").orderBy(F.desc("human_views"), "lang")
    rows = sums.withColumn("whole", F.lit(1))  # a row a language
    total = F.sum("human_views").over(Window.partitionBy("whole"))
    share = quotient(F.sum("human_views").over(order.rowsBetween(Window.unboundedPreceding, 0)), total)
    return rows.withColumns({"automated_views": F.col("raw_views") - F.col("human_views"), "rank": F.row_number().over(order), "cumulative_share": share}).drop("whole")


def day_summary(events: DataFrame) -> DataFrame:
    """One row a day: events, tiers, and starts by hour as 24 numbers."""
    at = [F.count_if(F.hour("start_hour") == h) for h in range(24)]
    tiers = [F.count_if(F.col("tier") == t).alias(t) for t in ("planetary", "international", "noticed")]
    return events.groupBy(F.to_date("start_hour").alias("day")).agg(F.count("*").alias("events"), *tiers, F.array(*at).alias("hourly"))


def language_summary(events: DataFrame, languages: DataFrame) -> DataFrame:
    """(day, lang, events, lead, excess, only_here): how many events of several languages a language took part in and led, its
    excess views in them, and how many events stayed in it alone."""
    day = F.to_date("start_hour").alias("day")
    wide, single = events.filter("event_class <> 'single_language'"), events.filter("event_class = 'single_language'")
    zero = F.lit(0).cast("long")
    part = languages.join(wide.select("event_id", day), "event_id").select("day", "lang", F.lit(1).cast("long").alias("events"), zero.alias("lead"), F.floor("excess_views").alias("excess"), zero.alias("only_here"))
    lead = wide.select(day, F.col("lead_lang").alias("lang"), zero.alias("events"), F.lit(1).cast("long").alias("lead"), zero.alias("excess"), zero.alias("only_here"))
    own = single.select(day, F.col("lead_lang").alias("lang"), zero.alias("events"), zero.alias("lead"), zero.alias("excess"), F.lit(1).cast("long").alias("only_here"))
    return part.unionByName(lead).unionByName(own).groupBy("day", "lang").agg(*[F.sum(c).alias(c) for c in ("events", "lead", "excess", "only_here")])


def period_totals(days: DataFrame, events: int | F.Column) -> DataFrame:
    """(lang, events, lead, excess, only_here, lead_share) over the days of language_summary; events is how many of several languages
    the period has."""
    sums = days.groupBy("lang").agg(*[F.sum(c).alias(c) for c in ("events", "lead", "excess", "only_here")])
    return sums.withColumn("lead_share", F.round(F.coalesce(F.try_divide(F.col("lead").cast("double"), F.lit(events)), F.lit(0.0)), 4))


def detected_share(links: DataFrame, events: DataFrame, days: int = 1) -> DataFrame:
    """(bucket, links, detected, share): of ground-truth links (date, qid, n_languages), how many have an event of their entity that
    starts within so many days, by how many languages the entity has: below 10, 25, 50, 100, or more."""
    bucket = F.when(F.col("n_languages") < 10, "1-9").when(F.col("n_languages") < 25, "10-24").when(F.col("n_languages") < 50, "25-49").when(F.col("n_languages") < 100, "50-99").otherwise("100+")
    near = events.select(F.col("qid").alias("_q"), F.explode(F.sequence(F.date_sub(F.to_date("start_hour"), days), F.date_add(F.to_date("start_hour"), days))).alias("_d")).distinct()
    found = links.join(near, (links["qid"] == near["_q"]) & (links["date"] == near["_d"]), "left")
    rows = found.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("links"), F.count("_q").alias("detected"))
    return rows.withColumn("share", F.col("detected") / F.col("links"))


def hero(events: DataFrame, now: Column, windows: tuple[int, ...] = (24, 48, 168), excess: float = 100_000) -> DataFrame:
    """The event to show first: the narrowest window that has a qualifying one, then excess, breadth and id."""
    age = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("start_hour").cast("timestamp"))) / 3600
    window = None
    for i, w in enumerate(windows):
        window = F.when(age < w, i) if window is None else window.when(age < w, i)
    fits = (age >= 0) & ((F.col("excess_views") >= excess) | F.col("tier").isin("international", "planetary"))
    rows = events.withColumn("window", window).filter(fits & F.col("window").isNotNull())
    best = rows.agg(F.min(F.struct("window", (-F.col("excess_views")).alias("e"), (-F.col("breadth")).alias("b"), "event_id")).alias("x"))
    return best.filter("x IS NOT NULL").select("x.window", "x.event_id")


def missing_hours(present: DataFrame, first: Column, last: Column, limit: int | None = None) -> DataFrame:
    """Expected hours that a ledger lacks, newest first."""
    expected = present.sparkSession.range(1).select(F.explode(F.sequence(first, last, F.expr("INTERVAL 1 HOUR"))).alias("ts_hour"))
    gaps = expected.join(present.select("ts_hour").distinct(), "ts_hour", "left_anti").orderBy(F.desc("ts_hour"))
    return gaps.limit(limit) if limit else gaps


def latest(events: DataFrame, hours: int) -> DataFrame:
    """Events that start within so many hours before the last one."""
    last = events.agg(F.max("start_hour").alias("last"))  # one row
    return events.join(F.broadcast(last), F.col("start_hour") > F.timestamp_add("HOUR", F.lit(-hours), F.col("last"))).drop("last")


def catch_up(present: DataFrame, last: Column, hours: int, limit: int) -> DataFrame:
    """The hours to load next: those missing of the last so many, newest first, no more than limit at once."""
    return missing_hours(present, F.timestamp_add("HOUR", F.lit(1 - hours), last), last, limit)


def top_shares(rows: DataFrame, key: str, sizes: tuple[int, ...], value: str = "views") -> DataFrame:
    """The share of a value that the so many largest keys hold; keys are few (languages), a row each."""
    sums = rows.groupBy(key).agg(F.sum(value).alias("v")).withColumn("whole", F.lit(1))
    ranked = sums.withColumn("k", F.row_number().over(Window.partitionBy("whole").orderBy(F.desc("v"), key)))
    shares = [F.struct(F.lit(n).alias("top"), (F.sum(F.when(F.col("k") <= n, F.col("v"))) / F.sum("v")).alias("share")) for n in sizes]
    return ranked.agg(F.explode(F.array(*shares)).alias("x")).select("x.top", "x.share")


def rank_channels(hourly: DataFrame, first: str, excluded: DataFrame, n: int, days: int = 7, most_views: int = 1000, least_mobile: float = 0.05) -> DataFrame:
    """The n languages that people read most in a week: (lang, rank, raw_rank, raw_views, human_views, mobile_share, automated_share,
    non_article_share, cumulative_share). Articles are what excluded (lang, title) lacks; of those, more than most_views of a title in the
    week with fewer than least_mobile of them mobile are no people's. Titles meet once; a row a language is left to rank."""
    start = F.lit(first).cast("date")
    week = hourly.filter((F.col("day") >= start) & (F.col("day") < F.date_add(start, days)))
    titles = week.groupBy("lang", "title").agg(F.sum("views").alias("v"), F.sum("views_mobile").alias("m"))
    marked = titles.join(excluded.select("lang", "title", F.lit(False).alias("article")), ["lang", "title"], "left").withColumn("article", F.coalesce("article", F.lit(True)))
    automated = F.col("article") & (F.col("v") > most_views) & (F.col("m") < least_mobile * F.col("v"))
    human = F.col("article") & ~automated
    total = lambda when, c="v": F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    sums = marked.groupBy("lang").agg(F.sum("v").alias("raw_views"), total(human).alias("human_views"), total(human, "m").alias("mobile"), total(automated).alias("auto"), total(~F.col("article")).alias("other"))
    order = Window.orderBy(F.desc("human_views"), "lang")
    whole = F.sum("human_views").over(Window.partitionBy())
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    ranked = sums.select(
        "lang", F.row_number().over(order).alias("rank"), F.row_number().over(Window.orderBy(F.desc("raw_views"), "lang")).alias("raw_rank"), "raw_views", "human_views",
        share("mobile", "human_views").alias("mobile_share"), share("auto", "raw_views").alias("automated_share"), share("other", "raw_views").alias("non_article_share"),
        F.try_divide(F.sum("human_views").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("double"), whole).alias("cumulative_share"),
    )
    return ranked.filter(F.col("rank") <= n)


def day_documents(events: DataFrame, languages: DataFrame) -> DataFrame:
    """(day, document): one JSON text a day with a summary (events, tiers, starts by hour) and the day's events, each with its languages in
    the order of their spread. A day's events are few hundred at most, whatever the counts they come from."""
    langs = languages.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("spread_lag_hours", "lang"))).alias("langs"))
    rows = events.join(langs, "event_id").withColumn("day", F.to_date("start_hour"))
    one = F.struct(F.col("event_id").alias("id"), "qid", F.col("lead_lang").alias("lead"), "breadth", "tier", "langs")
    per_tier = rows.groupBy("day", "tier").agg(F.count("*").alias("n")).groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("tier", "n"))).alias("tiers"))
    hours = F.array(*[F.count_if(F.hour("start_hour") == h) for h in range(24)])
    days = rows.groupBy("day").agg(F.count("*").alias("events"), hours.alias("hourly"), F.sort_array(F.collect_list(one)).alias("list"))
    summary = F.struct("events", "tiers", "hourly")
    return days.join(per_tier, "day").select("day", F.to_json(F.struct(summary.alias("summary"), F.col("list").alias("events"))).alias("document"))
