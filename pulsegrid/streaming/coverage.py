"""Coverage of a stream: what its progress says of rates, languages and minutes without events, as rows.

`watched` adds counters to a stream of events; Spark's own progress reports carry them, a row a micro-batch, and the
listener keeps the reports of the queries with its name. Nothing is collected but those rows.
"""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

def watched(events: DataFrame, name: str, second: Column, lang: Column, kept: Column) -> DataFrame:
    """events with counters of each batch: how many came, how many are kept, first and last second, and the
    minutes and languages seen (a value for each minute that a batch has)."""
    return events.observe(
        name,
        F.count(F.lit(1)).alias("n_in"), F.count_if(kept).alias("n_kept"), F.min(second).alias("first"), F.max(second).alias("last"),
        F.collect_set(F.floor(second / 60)).alias("minutes"), F.collect_set(lang).alias("languages"),
    )


class Coverage(StreamingQueryListener):
    """Keeps (batch, counters) of every batch whose stream is watched under the name."""

    def __init__(self, name: str):
        self.name, self.rows, self.lock, self.ended = name, [], threading.Lock(), threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.name in p.observedMetrics:
            m = p.observedMetrics[self.name].asDict()
            with self.lock:
                self.rows.append({"query": str(p.id), "batch": p.batchId, "rate": p.processedRowsPerSecond, **m})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()

    def batches(self, spark: SparkSession) -> DataFrame:
        """(batch, n_in, n_kept, first, last, minutes, languages): a row a batch that had events."""
        with self.lock:
            kept = [(r["batch"], r["n_in"], r["n_kept"], r["first"], r["last"], list(r["minutes"]), list(r["languages"])) for r in self.rows if r["n_in"]]
        return spark.createDataFrame(kept, "batch long, n_in long, n_kept long, first long, last long, minutes array<long>, languages array<string>")


def coverage(batches: DataFrame, window_minutes: int | None = None) -> DataFrame:
    """One row over all batches, or the last window_minutes before the newest event: events and kept events a minute, last event,
    minutes covered, minutes of the window without any event and the longest such stretch, and the languages seen."""
    minutes = batches.select(F.explode("minutes").alias("m")).distinct()
    ends = batches.agg(F.max("last").alias("last"), F.min("first").alias("first"), F.sum("n_in").alias("n_in"), F.sum("n_kept").alias("n_kept"))
    newest = F.floor(F.col("last") / 60)
    low = F.floor(F.col("first") / 60) if window_minutes is None else F.greatest(newest - window_minutes + 1, F.floor(F.col("first") / 60))
    ends = ends.withColumns({"low": low, "high": newest})
    # minutes of a day are one window: the step from a day to the next one is a row a day
    inside = minutes.join(F.broadcast(ends.select("low", "high")), F.col("m").between(F.col("low"), F.col("high"))).withColumn("day", F.floor(F.col("m") / 1440))
    gap = F.col("m") - F.lag("m").over(Window.partitionBy("day").orderBy("m")) - 1
    days = inside.withColumn("gap", gap).groupBy("day").agg(F.count("*").alias("n"), F.max("gap").alias("own"), F.min("m").alias("a"), F.max("m").alias("z"))
    days = days.withColumn("between", F.col("a") - F.lag("z").over(Window.orderBy("day")) - 1)
    found = days.agg(F.sum("n").alias("covered"), F.coalesce(F.max(F.greatest("own", "between")), F.lit(0)).alias("longest_gap"))
    seen = batches.select(F.explode("languages").alias("l")).agg(F.array_join(F.array_sort(F.collect_set("l")), ",").alias("languages"))
    whole = ends.crossJoin(found).crossJoin(seen)  # one row each
    return whole.select("n_in", "n_kept", "last", (F.col("high") - F.col("low") + 1).alias("minutes"), "covered", (F.col("high") - F.col("low") + 1 - F.col("covered")).alias("gap_minutes"), "longest_gap", "languages")
