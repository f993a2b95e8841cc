"""Attention events: spiking hours of one entity, grouped over channels and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.baseline import hour_number
from pulsegrid.params import Events


def tier(breadth: Column, p: Events = Events()) -> Column:
    out = None
    for n, name in p.tiers:
        out = F.when(breadth >= n, name) if out is None else out.when(breadth >= n, name)
    return out


def episodes(spikes: DataFrame, p: Events = Events(), by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Spikes over the threshold with the number of their episode; a gap of exactly the limit begins a new one."""
    rows = spikes.filter(F.col("qid").isNotNull() & (F.col("surprise") >= p.r3_threshold)).withColumn("h", hour_number(F.col("ts_hour")))
    rows = rows.groupBy(*by, "lang", "ts_hour", "h").agg(F.max("surprise").alias("surprise"))  # several titles of one entity
    order = Window.partitionBy(*by).orderBy("h", "lang")
    gap = F.col("h") - F.lag("h").over(order)
    fresh = F.when(gap.isNull() | (gap >= p.new_event_gap_hours), 1).otherwise(0)
    return rows.withColumn("fresh", fresh).withColumn("episode", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")


def event_languages(spikes: DataFrame, p: Events = Events(), scored: DataFrame | None = None, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """One row an event and language. Windows and groups all begin with the entity: one shuffle up to here."""
    rows = episodes(spikes, p, by)
    ahead = Window.partitionBy(*by, "episode").orderBy("h").rangeBetween(0, p.window_hours - 1)
    rows = rows.withColumn("n_langs", F.size(F.collect_set("lang").over(ahead)))
    whole = Window.partitionBy(*by, "episode")
    rows = rows.withColumn("start", F.min(F.when(F.col("n_langs") >= p.min_languages, F.col("h"))).over(whole))
    members = rows.filter((F.col("h") >= F.col("start")) & (F.col("h") < F.col("start") + p.breadth_hours))
    # strongest language of the first hour; equal ones in alphabetical order
    first = F.when(F.col("h") == F.col("start"), F.struct((-F.col("surprise")).alias("s"), "lang"))
    members = members.withColumn("lead", F.min(first).over(whole)["lang"])
    per = members.groupBy(*by, "start", "lead", "lang").agg(F.min("ts_hour").alias("first_spike"), F.min("h").alias("first_h"), F.max("surprise").alias("peak_surprise"), F.count("*").alias("spike_hours"))
    source = (scored if scored is not None else spikes).withColumn("x", hour_number(F.col("ts_hour"))).select("qid", F.col("lang").alias("xl"), "x", F.greatest(F.col("views") - F.col("baseline_median"), F.lit(0.0)).alias("over"))
    starts = per.select(*by, "start", "lang")
    inside = (F.col("x") >= F.col("start")) & (F.col("x") < F.col("start") + p.breadth_hours)
    excess = starts.join(source, (starts["qid"] == source["qid"]) & (starts["lang"] == source["xl"]) & inside).drop(source["qid"])
    excess = excess.groupBy(*by, "start", "lang").agg(F.sum("over").alias("excess_views"))
    out = per.join(excess, [*by, "start", "lang"], "left")
    start_hour = F.expr("timestampadd(HOUR, start, TIMESTAMP_NTZ '1970-01-01 00:00:00')")
    return out.select(
        *by, F.concat(F.lit("Q"), "qid", F.lit("@"), F.date_format(start_hour, "yyyyMMdd'T'HH")).alias("event_id"), start_hour.alias("start_hour"), "lang", "first_spike",
        (F.col("first_h") - F.col("start")).cast("long").alias("spread_lag_hours"), "peak_surprise", "spike_hours", F.coalesce("excess_views", F.lit(0.0)).alias("excess_views"), (F.col("lang") == F.col("lead")).alias("is_lead"),
    )


def attention_events(languages: DataFrame, p: Events = Events(), by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Events from their languages: lead, breadth, intensity, excess, spread, tier and class."""
    lead_excess = F.sum(F.when(F.col("is_lead"), F.col("excess_views")))
    share = F.coalesce(F.try_divide(lead_excess, F.sum("excess_views")), F.lit(0.0))
    rows = languages.groupBy(*by, "event_id", "start_hour").agg(
        F.max(F.when(F.col("is_lead"), F.col("lang"))).alias("lead_lang"),
        F.count("*").alias("breadth"),
        F.max("peak_surprise").alias("peak_intensity"),
        F.sum("excess_views").alias("excess_views"),
        F.median(F.when(~F.col("is_lead"), F.col("spread_lag_hours"))).alias("median_spread_lag_hours"),
        F.max("spread_lag_hours").alias("max_spread_lag_hours"),
        F.sort_array(F.collect_list(F.struct("spread_lag_hours", "lang"))).alias("spread"),
        share.alias("lead_excess_share"),
    )
    kind = F.when(F.col("lead_excess_share") >= p.single_language_share, "single_language").otherwise("multi_language")
    return rows.withColumns({"languages": F.col("spread.lang"), "event_class": kind, "tier": tier(F.col("breadth"), p)}).drop("spread")
