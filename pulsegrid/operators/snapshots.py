"""Decision-time features of events and their later outcomes; no feature reads an hour after its snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.baseline import hour_number

HORIZON, FADE_CAP = 72, 48


def event_hours(events: DataFrame, rows: DataFrame) -> DataFrame:
    """Hours of an event's entity from its start on: h counts from the start. rows has qid, lang, title, ts_hour,
    views, baseline_median and surprise."""
    ev = events.select("event_id", "qid", "start_hour", "lead_lang", hour_number(F.col("start_hour")).alias("h0"))
    x = rows.select("qid", "lang", "title", "views", "surprise", F.greatest(F.col("views") - F.col("baseline_median"), F.lit(0.0)).alias("ex"), hour_number(F.col("ts_hour")).alias("hn"))
    joined = ev.join(x, (ev["qid"] == x["qid"]) & (x["hn"] >= ev["h0"]) & (x["hn"] <= ev["h0"] + HORIZON)).drop(x["qid"])
    return joined.withColumn("h", F.col("hn") - F.col("h0")).drop("hn", "h0")


def snapshots(events: DataFrame, rows: DataFrame, threshold: float, offsets: tuple[int, ...] = (0, 1, 3)) -> DataFrame:
    """Features at so many hours after the second language's first spike, while the event is in its first day."""
    x = event_hours(events, rows)
    spiking = (F.col("surprise") >= threshold) & (F.col("h") < 24)
    item = Window.partitionBy("event_id", "lang", "title")
    x = x.withColumn("known_from", F.min(F.when(spiking, F.col("h"))).over(item))
    firsts = x.filter(spiking).groupBy("event_id", "lang").agg(F.min("h").alias("first"))
    firsts = firsts.groupBy("event_id").agg(F.sort_array(F.collect_list("first")).alias("firsts")).filter(F.size("firsts") >= 2)
    snaps = firsts.withColumn("k", F.explode(F.array(*[F.lit(k) for k in offsets]))).withColumn("T", F.col("firsts")[1] + F.col("k")).filter(F.col("T") < 24)
    # the past of each snapshot only
    past = x.join(snaps, "event_id").filter(F.col("h") <= F.col("T"))
    lead = F.col("lang") == F.col("lead_lang")
    early = F.col("h") < 24
    if_spiking = lambda c: F.when(spiking, c)
    known = F.col("known_from") <= F.col("T")
    agg = past.groupBy("event_id", "k").agg(
        F.countDistinct(if_spiking(F.col("lang"))).alias("breadth_t"),
        F.max(if_spiking(F.col("surprise"))).alias("max_surprise_t"),
        F.sum(if_spiking(F.col("surprise"))).alias("sum_surprise_t"),
        F.sum(F.when(early, F.col("ex"))).alias("excess_t"),
        F.sum(F.when(early & lead, F.col("ex"))).alias("lead_ex"),
        F.sum(F.when(F.col("h") == F.col("T"), F.col("ex"))).alias("excess_hour_t"),
    )
    hours = past.filter(known).groupBy("event_id", "k", "T", "h").agg(F.sum("views").alias("v"), F.sum(F.when(lead, F.col("views"))).alias("lv"))
    at = lambda back: F.coalesce(F.max(F.when(F.col("h") == F.col("T") - back, F.col("v"))), F.lit(0))
    views = hours.groupBy("event_id", "k", "T").agg(
        at(0).alias("views_t"),
        (F.log1p(at(0)) - F.log1p(at(2))).alias("views_slope"),
        F.max("v").alias("peak_views_so_far"),
        F.coalesce(F.try_divide(F.sum("lv"), F.sum("v")), F.lit(0.0)).alias("lead_views_share"),
        (F.col("T") - F.max(F.struct("v", (-F.col("h")).alias("h")))["h"] * -1).alias("hours_since_peak"),
    )
    out = snaps.join(events.select("event_id", "qid", "start_hour", "lead_lang", "breadth"), "event_id").join(agg, ["event_id", "k"], "left").join(views.drop("T"), ["event_id", "k"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    when = F.expr("timestampadd(HOUR, T, start_hour)")
    return out.select(
        F.concat_ws("#", "event_id", "k").alias("snapshot_id"), "event_id", "qid", F.col("k").alias("offset_h"), "start_hour", "lead_lang", "breadth", F.col("T").alias("hours_since_start"),
        when.alias("snapshot_ts"), F.hour(when).alias("hour_utc"), F.weekday(when).alias("weekday"),
        F.coalesce("breadth_t", F.lit(0)).alias("breadth_t"), zero("max_surprise_t").alias("max_surprise_t"), zero("sum_surprise_t").alias("sum_surprise_t"), zero("excess_t").alias("excess_t"),
        F.coalesce(F.try_divide("lead_ex", "excess_t"), F.lit(0.0)).alias("lead_share_t"), zero("excess_hour_t").alias("excess_hour_t"),
        F.size(F.filter("firsts", lambda f: f == F.col("T"))).alias("new_langs_last_hour"),
        F.coalesce("views_t", F.lit(0)).alias("views_t"), zero("views_slope").alias("views_slope"), F.coalesce("peak_views_so_far", F.lit(0)).alias("peak_views_so_far"),
        zero("lead_views_share").alias("lead_views_share"), F.coalesce("hours_since_peak", F.lit(0)).alias("hours_since_peak"),
    )


def targets(snaps: DataFrame, events: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """Outcomes of snapshots: reached tiers, excess of the next 24 hours, and hours until views fall below half the
    peak. Each event's dense hours are one array of HORIZON + 1 totals."""
    x = event_hours(events, rows)
    item = Window.partitionBy("event_id", "lang", "title")
    x = x.withColumn("ever", F.max((F.col("surprise") >= threshold) & (F.col("h") < 24)).over(item)).filter("ever")
    sums = x.groupBy("event_id", "h").agg(F.sum("views").alias("v"), F.sum("ex").alias("e"))
    maps = sums.groupBy("event_id").agg(F.map_from_entries(F.collect_list(F.struct("h", "v"))).alias("v"), F.map_from_entries(F.collect_list(F.struct("h", "e"))).alias("e"))
    grid = F.sequence(F.lit(0), F.lit(HORIZON))
    dense = lambda m, zero: F.transform(grid, lambda i: F.coalesce(F.try_element_at(m, i), zero))
    maps = maps.select("event_id", dense(F.col("v"), F.lit(0).cast("long")).alias("v"), dense(F.col("e"), F.lit(0.0)).alias("e"))
    rows = snaps.join(maps, "event_id", "left")
    t, peak = F.col("hours_since_start"), F.array_max("v")
    peak_at = (F.array_position("v", peak) - 1).cast("int")
    next24 = F.aggregate(F.filter("e", lambda _, i: (i > t) & (i <= t + 24)), F.lit(0.0), lambda a, y: a + y)
    low = F.filter(F.sequence(F.greatest(t, peak_at), F.lit(HORIZON)), lambda i: F.element_at("v", i + 1) < peak / 2)
    fade = F.when(F.size(low) > 0, F.least(low[0] - t, F.lit(FADE_CAP))).otherwise(FADE_CAP)
    return rows.select("snapshot_id", (F.col("breadth") >= 5).alias("reach_international"), (F.col("breadth") >= 20).alias("reach_planetary"), next24.alias("excess_next24"), fade.alias("fade_hours"))


def with_dims(snaps: DataFrame, dims: DataFrame) -> DataFrame:
    """snaps with the class of their entity and how many languages it has, from dims (qid, entity_class, n_languages): "other" and 0
    where it isn't there."""
    found = snaps.join(dims.select("qid", F.col("entity_class").alias("_class"), F.col("n_languages").alias("_n")), "qid", "left")
    return found.withColumns({"entity_class": F.coalesce("_class", F.lit("other")), "n_sitelinks": F.coalesce("_n", F.lit(0)).cast("long")}).drop("_class", "_n")
