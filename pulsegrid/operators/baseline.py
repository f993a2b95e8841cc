"""Calendar-aware robust baselines and surprise scores, for all days of a period in one job.

History is never joined to itself: the look-back of an hour is a range frame over days of the same item and hour,
so one shuffle on (lang, title) serves slot histories, whether an item was seen before, and the earlier hours that
the ratio rules compare with.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.robust import array_mad, array_median, zero_padded
from pulsegrid.params import Automation, Baseline, Spike


def day_number(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def hour_number(ts: Column) -> Column:
    return day_number(F.to_date(ts)) * 24 + F.hour(ts)


def calendar(days: DataFrame, start: str, p: Baseline = Baseline()) -> DataFrame:
    """Weekday, weekend and all days in the look-back of each day, clipped at the period's start."""
    first = F.greatest(F.date_sub("day", p.lookback_days), F.lit(start).cast("date"))
    last = F.date_sub("day", 1)
    back = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<date>"))
    weekend = F.size(F.filter(back, lambda d: F.weekday(d) >= 5))
    return days.select("day", F.size(back).alias("n_all"), weekend.alias("n_weekend"), (F.size(back) - weekend).alias("n_weekday"))


def language_priors(stg: DataFrame, p: Baseline = Baseline()) -> DataFrame:
    """Median and deviation of retained hours of established items, for every day that has rows.

    A row feeds the days after it; the retained hours of a language meet as counts by value, so no group holds
    more than the distinct values.
    """
    days = stg.select(F.col("day").alias("for_day")).distinct()
    sample = stg.filter(F.pmod(F.xxhash64("lang", "title"), F.lit(p.prior_sample_mod)) == 0).select("lang", "title", "day", "views")
    ahead = F.explode(F.sequence(F.date_add("day", 1), F.date_add("day", p.lookback_days)))
    fed = sample.groupBy("lang", "title", "day").agg(F.collect_list("views").alias("hours")).withColumn("for_day", ahead)
    seen = fed.groupBy("lang", "title", "for_day").agg(F.count("*").alias("days"), F.flatten(F.collect_list("hours")).alias("hours"))
    rows = seen.filter(F.col("days") >= p.prior_min_days_seen).join(days, "for_day", "left_semi").select("lang", "for_day", F.explode("hours").alias("views"))
    counts = rows.groupBy("lang", "for_day", "views").agg(F.count("*").alias("n"))
    middle = counts.groupBy("lang", "for_day").agg(F.expr("percentile(views, 0.5, n)").alias("prior_median"))
    spread = counts.join(middle, ["lang", "for_day"]).groupBy("lang", "for_day", "prior_median").agg(F.expr("percentile(abs(views - prior_median), 0.5, n)").alias("prior_mad"))
    return spread.select(F.col("for_day").alias("day"), "lang", "prior_median", "prior_mad")


def with_history(stg: DataFrame, p: Baseline = Baseline()) -> DataFrame:
    """stg with the slot's views in the look-back (same day type, any day), whether the item was unseen, and the
    views of a day and one to three hours before."""
    back = p.lookback_days
    rows = stg.withColumns({"d": day_number(F.col("day")), "h": hour_number(F.col("ts_hour"))})
    item = Window.partitionBy("lang", "title").orderBy("h")
    by_day = Window.partitionBy("lang", "title").orderBy("d").rangeBetween(-back, -1)
    slot = Window.partitionBy("lang", "title", "hour_of_day").orderBy("d").rangeBetween(-back, -1)
    same = Window.partitionBy("lang", "title", "hour_of_day", "is_weekend").orderBy("d").rangeBetween(-back, -1)
    before = lambda k: F.coalesce(F.max("views").over(item.rangeBetween(-k, -k)), F.lit(0))
    return rows.withColumns({
        "unseen": F.count("*").over(by_day) == 0,
        "vals_h": F.collect_list("views").over(slot),
        "vals_dt": F.collect_list("views").over(same),
        "views_yesterday": before(24),
        "v1": before(1), "v2": before(2), "v3": before(3),
    }).drop("d", "h")


def score_candidates(stg: DataFrame, priors: DataFrame, days: DataFrame, b: Baseline = Baseline(), s: Spike = Spike()) -> DataFrame:
    """Every hour of at least min_views with its baseline (day type, else hour, else prior), surprise and ratio rules.
    days is the calendar: one row a day, so it is small whatever the input."""
    # only items that ever have a candidate hour need their history
    keys = stg.filter(F.col("views") >= s.min_views).select("lang", "title").distinct()
    rows = with_history(stg.join(keys, ["lang", "title"], "left_semi"), b).filter(F.col("views") >= s.min_views)
    rows = rows.join(F.broadcast(days), "day").join(priors, ["day", "lang"], "left")
    n_dt = F.when(F.col("is_weekend"), F.col("n_weekend")).otherwise(F.col("n_weekday"))
    level = F.when(F.col("unseen"), "prior").when(n_dt >= b.min_observations, "day_type").when(F.col("n_all") >= b.min_observations, "hour").otherwise("prior")
    padded = F.when(n_dt >= b.min_observations, zero_padded(F.col("vals_dt"), n_dt)).otherwise(zero_padded(F.col("vals_h"), F.col("n_all")))
    rows = rows.withColumns({"baseline_level": level, "padded": padded})
    prior = F.col("baseline_level") == "prior"
    rows = rows.withColumns({
        "baseline_median": F.when(prior, F.coalesce("prior_median", F.lit(0.0))).otherwise(array_median(F.col("padded"))),
        "baseline_mad": F.when(prior, F.coalesce("prior_mad", F.lit(0.0))).otherwise(array_mad(F.col("padded"))),
        "prev3_median": array_median(F.array("v1", "v2", "v3")),
    })
    return rows.select(
        "ts_hour", "day", "hour_of_day", "is_weekend", "lang", "title", "views", "mobile_share", "baseline_level", "unseen", "baseline_median", "baseline_mad", "views_yesterday", "prev3_median",
        surprise(s).alias("surprise"),
        (~F.col("unseen") & (F.col("views") >= s.r1_ratio * F.col("views_yesterday"))).alias("r1"),
        (F.col("views") >= s.r2_ratio * F.col("prev3_median")).alias("r2"),
    )


def surprise(s: Spike = Spike()) -> Column:
    return (F.col("views") - F.col("baseline_median")) / (s.mad_scale * F.col("baseline_mad") + F.sqrt("baseline_median") + 1)


def spikes(scored: DataFrame, flags: DataFrame, links: DataFrame, s: Spike = Spike()) -> DataFrame:
    """Scored hours that meet a ratio rule and nearly the threshold, with flags and entity. The filter comes first:
    links are joined to the few rows that are left."""
    few = scored.filter((F.col("r1") | F.col("r2")) & (F.col("surprise") >= s.r3_candidate))
    few = few.join(flags.select("lang", "title", "day", "is_automated"), ["lang", "title", "day"], "left")
    few = few.join(links, ["lang", "title"], "left").withColumn("is_automated", F.coalesce("is_automated", F.lit(False)))
    key = F.coalesce(F.concat(F.lit("Q"), "qid"), F.concat_ws("|", "lang", "title"))
    return few.withColumns({"entity_key": key, "is_spike": (F.col("surprise") >= s.r3_threshold) & ~F.col("is_automated")})


def daily_baselines(stg: DataFrame, day: str, start: str, p: Baseline = Baseline()) -> DataFrame:
    """Stored slots of one day."""
    return stored_baselines(stg, [date.fromisoformat(day)], start, p)


def stored_baselines(stg: DataFrame, for_days: list[date], start: str, p: Baseline = Baseline()) -> DataFrame:
    """Stored slots of some days: items present on at least half the observations, with a median or deviation above
    zero, and one row a language (title null) with its prior. A row feeds those of the days that look back on it."""
    listed = F.array(*map(F.lit, for_days))
    days = calendar(stg.sparkSession.createDataFrame([(d,) for d in for_days], "day date"), start, p)
    near = stg.filter((F.col("day") >= F.greatest(F.lit(min(for_days) - timedelta(days=p.lookback_days)), F.lit(start).cast("date"))) & (F.col("day") < F.lit(max(for_days))))
    feeds = F.filter(listed, lambda d: (d > F.col("day")) & (F.datediff(d, F.col("day")) <= p.lookback_days))
    lookback = near.withColumn("for_day", F.explode(feeds))
    rows = lookback.join(F.broadcast(days.withColumnRenamed("day", "for_day")), "for_day")  # a row a day asked for
    weekend = F.weekday("for_day") >= 5
    n_dt = F.when(weekend, F.col("n_weekend")).otherwise(F.col("n_weekday"))
    by_type = n_dt >= p.min_observations
    rows = rows.withColumn("n_obs", F.when(by_type, n_dt).otherwise(F.col("n_all"))).filter(~by_type | (F.col("is_weekend") == weekend))
    slots = rows.groupBy("for_day", "lang", "title", "hour_of_day", "n_obs", F.when(by_type, "day_type").otherwise("hour").alias("baseline_level")).agg(F.collect_list("views").alias("vals"))
    slots = slots.filter(2 * F.size("vals") >= F.col("n_obs")).withColumn("padded", zero_padded(F.col("vals"), F.col("n_obs")))
    slots = slots.withColumns({"baseline_median": array_median(F.col("padded")), "baseline_mad": array_mad(F.col("padded"))})
    slots = slots.filter("baseline_median > 0 OR baseline_mad > 0").select("lang", "title", "hour_of_day", "baseline_median", "baseline_mad", "baseline_level", "n_obs", F.col("for_day").alias("day"))
    none = F.lit(None)
    priors = _prior_of(lookback, p).select("lang", none.cast("string").alias("title"), none.cast("int").alias("hour_of_day"), F.col("prior_median").alias("baseline_median"), F.col("prior_mad").alias("baseline_mad"), F.lit("prior").alias("baseline_level"), none.cast("int").alias("n_obs"), F.col("for_day").alias("day"))
    return slots.unionByName(priors)


def _prior_of(lookback: DataFrame, p: Baseline) -> DataFrame:
    seen = lookback.groupBy("for_day", "lang", "title").agg(F.countDistinct("day").alias("days")).filter(F.col("days") >= p.prior_min_days_seen)
    counts = lookback.join(seen, ["for_day", "lang", "title"], "left_semi").groupBy("for_day", "lang", "views").agg(F.count("*").alias("n"))
    middle = counts.groupBy("for_day", "lang").agg(F.expr("percentile(views, 0.5, n)").alias("prior_median"))
    return counts.join(middle, ["for_day", "lang"]).groupBy("for_day", "lang", "prior_median").agg(F.expr("percentile(abs(views - prior_median), 0.5, n)").alias("prior_mad"))


def score_hour(stg: DataFrame, baselines: DataFrame, ts: str, s: Spike = Spike(), a: Automation = Automation()) -> DataFrame:
    """Candidates of one hour against stored slots, with ratio rules and flags of the day so far."""
    at = F.lit(ts).cast("timestamp_ntz")
    near = stg.filter((F.col("ts_hour") >= at - F.expr("INTERVAL 24 HOURS")) & (F.col("ts_hour") <= at))
    return score_hours(near, baselines, stg.sparkSession.range(1).select(at.alias("ts_hour")), s, a)


def score_hours(stg: DataFrame, baselines: DataFrame, hours: DataFrame, s: Spike = Spike(), a: Automation = Automation()) -> DataFrame:
    """Candidates of some hours (ts_hour; a row an hour) against the stored slots of their days. stg has the hours' days and
    the 24 hours before; earlier hours and the day so far are frames over an item's hours, with one shuffle."""
    item = Window.partitionBy("lang", "title").orderBy("h")
    back = lambda k: F.coalesce(F.max("views").over(item.rangeBetween(-k, -k)), F.lit(0))
    today = Window.partitionBy("lang", "title", "day").orderBy("h").rangeBetween(Window.unboundedPreceding, 0)
    rows = stg.withColumn("h", hour_number(F.col("ts_hour"))).withColumns({
        "views_yesterday": back(24), "prev": F.array(back(1), back(2), back(3)),
        "sum": F.sum("views").over(today), "mobile": F.sum("views_mobile").over(today), "squares": F.sum(F.col("views").cast("double") * F.col("views")).over(today),
    })
    rows = rows.filter(F.col("views") >= s.min_views).join(F.broadcast(hours), "ts_hour", "left_semi")
    slots, priors = baselines.filter("title IS NOT NULL"), baselines.filter("title IS NULL")
    known = slots.select("day", "lang", "title").distinct().withColumn("known", F.lit(True))
    slots = slots.select("day", "lang", "title", "hour_of_day", F.col("baseline_median").alias("slot_median"), F.col("baseline_mad").alias("slot_mad"), F.col("baseline_level").alias("slot_level"))
    priors = priors.select("day", "lang", F.col("baseline_median").alias("prior_median"), F.col("baseline_mad").alias("prior_mad"))
    rows = rows.join(known, ["day", "lang", "title"], "left").join(slots, ["day", "lang", "title", "hour_of_day"], "left").join(priors, ["day", "lang"], "left")
    unseen = F.col("known").isNull()
    pick = lambda a, b: F.when(unseen, F.coalesce(a, F.lit(0.0))).otherwise(F.coalesce(b, F.lit(0.0)))
    rows = rows.withColumns({
        "unseen": unseen,
        "baseline_median": pick("prior_median", "slot_median"), "baseline_mad": pick("prior_mad", "slot_mad"),
        "baseline_level": F.when(unseen, "prior").otherwise(F.coalesce("slot_level", F.lit("zero"))),
        "prev3_median": array_median(F.col("prev")),
    })
    hour = F.col("hour_of_day")
    mean = F.col("sum") / (hour + 1.0)
    cv = F.sqrt(F.greatest(F.col("squares") / (hour + 1.0) - mean * mean, F.lit(0.0))) / mean
    low = (F.col("sum") >= a.day_views_min) & (F.col("mobile") / F.col("sum").cast("double") < a.mobile_share_max)
    flat = (hour >= 5) & (mean >= a.flat_hourly_mean_min) & (cv < a.flat_cv_max)
    return rows.select(
        "ts_hour", "lang", "title", "views", "mobile_share", "baseline_level", "unseen", "baseline_median", "baseline_mad", "views_yesterday", "prev3_median",
        surprise(s).alias("surprise"),
        (~F.col("unseen") & (F.col("views") >= s.r1_ratio * F.col("views_yesterday"))).alias("r1"),
        (F.col("views") >= s.r2_ratio * F.col("prev3_median")).alias("r2"),
        (low | flat).alias("is_automated"),
    )
