"""The hourly pipeline as a stream: closed hours go into the store, are scored against stored baselines, and the events of the
last days are renewed, one micro-batch at a time.

Each of the four stores takes a batch under the same key, so a batch that runs again after a failure goes on where it broke:
what was committed stays, and the rest is computed from the committed hours, not from the batch's rows. Hours come in order of
time (a stream in append mode emits them once the watermark has closed them), so a day's baselines are fixed when its first
hour comes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.operators import baseline, events, staging
from pulsegrid.params import Automation, Baseline, Events, Spike
from pulsegrid.sources.store import DayStore

HOURS = "ts_hour timestamp_ntz, lang string, title string, views_desktop long, views_mobile long"
SLOTS = "ts_hour timestamp_ntz, lang string, title string, hour_of_day int, baseline_median double, baseline_mad double, baseline_level string, n_obs int"
SPIKES = "ts_hour timestamp_ntz, lang string, title string, qid long, views long, baseline_median double, surprise double, is_automated boolean"
EVENTS = "ts_hour timestamp_ntz, event_id string, qid long, lead_lang string, breadth long, peak_intensity double, excess_views double, languages array<string>, lead_excess_share double, event_class string, tier string"


def _schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


@dataclass
class HourlyPipeline:
    """Stores below root, the links of titles to entities, and the rules. step is called with the name of each stage before
    it commits (tests break a run there)."""

    spark: SparkSession
    root: str
    links: DataFrame
    start: str
    spike: Spike = Spike()
    automation: Automation = Automation()
    event: Events = Events()
    base: Baseline = Baseline()
    name: str = "hourly"
    step: Callable[[str], None] = lambda name: None
    hours: DayStore = field(init=False)
    slots: DayStore = field(init=False)
    spikes: DayStore = field(init=False)
    events: DayStore = field(init=False)

    def __post_init__(self):
        store = lambda name, text, **more: DayStore(self.spark, f"{self.root}/{name}", _schema(text), **more)
        self.hours, self.slots = store("hours", HOURS), store("slots", SLOTS)
        self.spikes, self.events = store("spikes", SPIKES), store("events", EVENTS, by=("qid",))

    def settle(self, batch: DataFrame, batch_id: int) -> None:
        """Take the closed hours of one micro-batch; the same batch_id again changes nothing that was committed."""
        key = f"{self.name}-{batch_id}"
        if self.hours.has(key):  # a stream's state is kept for a batch only where its rows are read to the end
            batch.write.format("noop").mode("overwrite").save()
        else:
            self.hours.upsert(batch, "stream", key=key, before_commit=lambda: self.step("hours"))
        came = self.hours.hours_of(key)
        days = [r[0] for r in came.select(F.to_date("ts_hour").alias("d")).distinct().orderBy("d").collect()]
        if days:
            self._store_slots(days, key)
            self._score(came, days, key)
            self._renew(days, key)

    def _store_slots(self, days: list[date], key: str) -> None:
        """Baselines of the days that have none yet, in the hour 0 of their day."""
        if self.slots.has(key):
            return
        known = {r[0].date() for r in self.slots.ledger().select("ts_hour").collect()}  # a row a day
        fresh = [d for d in days if d not in known]
        past = staging.stage(self.hours.read(days[0] - timedelta(days=self.base.lookback_days), days[-1]))
        rows = baseline.stored_baselines(past, fresh, self.start, self.base) if fresh else self.spark.createDataFrame([], _schema(SLOTS + ", day date")).drop("ts_hour")
        at = self.spark.createDataFrame([(d,) for d in fresh], "day date").select(F.col("day").cast("timestamp_ntz").alias("ts_hour"))
        self.slots.upsert(rows.withColumn("ts_hour", F.col("day").cast("timestamp_ntz")), "stream", key=key, hours=at, before_commit=lambda: self.step("slots"))

    def _score(self, came: DataFrame, days: list[date], key: str) -> None:
        if self.spikes.has(key):
            return
        near = staging.stage(self.hours.read(days[0] - timedelta(days=1), days[-1]))
        slots = self.slots.read(days[0], days[-1]).withColumn("day", F.to_date("ts_hour")).drop("ts_hour")
        rows = baseline.score_hours(near, slots, came, self.spike, self.automation)
        rows = rows.filter((F.col("r1") | F.col("r2")) & (F.col("surprise") >= self.spike.r3_candidate)).join(self.links, ["lang", "title"], "left")
        self.spikes.upsert(rows, "stream", overwrite=True, key=key, hours=came, before_commit=lambda: self.step("spikes"))

    def _renew(self, days: list[date], key: str) -> None:
        """The events that begin on the day before the batch's first, or later. A day's events are found in its own spikes and
        those of the next day; those of the last day in its own and the day's before."""
        if self.events.has(key):
            return
        first, last = days[0] - timedelta(days=1), days[-1]
        rows = self.spikes.read(first, last).filter("NOT is_automated AND qid IS NOT NULL").withColumn("day", F.to_date("ts_hour"))
        end = F.lit(last)
        groups = F.array_distinct(F.array(F.col("day"), F.date_sub("day", 1), F.when(F.col("day") == F.date_sub(end, 1), end).otherwise(F.col("day"))))
        grouped = rows.withColumn("of_day", F.explode(F.filter(groups, lambda d: (d >= F.lit(first)) & (d <= end))))
        by = ("of_day", "qid")
        found = events.attention_events(events.event_languages(grouped, self.event, scored=rows, by=by), self.event, by)
        found = found.filter(F.to_date("start_hour") == F.col("of_day")).withColumnRenamed("start_hour", "ts_hour")
        whole = self.spark.range((last - first).days * 24 + 24).select(F.expr(f"timestampadd(HOUR, id, TIMESTAMP_NTZ '{first} 00:00:00')").alias("ts_hour"))
        self.events.upsert(found, "stream", overwrite=True, key=key, hours=whole, before_commit=lambda: self.step("events"))

    def run(self, hours: DataFrame, checkpoint: str) -> None:
        """Drain a stream of closed hours (ts_hour, lang, title, views_desktop, views_mobile)."""
        kept = hours.withColumn("ts_hour", F.col("ts_hour").cast("timestamp_ntz"))
        write = kept.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        write.foreachBatch(lambda df, n: self.settle(df, n)).start().awaitTermination()
