"""Canonical relations derived from the given tables: hourly counts, links, claims, ground truth, edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.session import table

#: Entities that the event users are folded to.
ENTITIES = 8


def raw_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an event: hour, channel, item, views, and whether they came from a mobile site."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts_hour"),
        F.col("event_type").alias("lang"),
        F.concat(F.lit("T"), F.col("user_id") % ENTITIES).alias("title"),
        F.floor(F.col("value") * 10).alias("v"),
        (F.get_json_object("props", "$.k").cast("int") % 2 == 1).alias("is_mobile"),
    )


def hourly(spark: SparkSession, sf_dir: str, min_views: int = 5) -> DataFrame:
    from pulsegrid.operators.staging import merge_counts

    return merge_counts(raw_counts(spark, sf_dir), min_views)


def sitelinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, title, qid), unique by (lang, title); the last entity has no link."""
    pairs = table(spark, sf_dir, "events").select(F.col("event_type").alias("lang"), (F.col("user_id") % ENTITIES).alias("qid")).distinct()
    return pairs.filter(F.col("qid") < ENTITIES - 1).select("lang", F.concat(F.lit("T"), "qid").alias("title"), "qid")


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change stream: time, wiki, article, user, comment, and whether the page was created."""
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id", "ts", F.col("event_type").alias("lang"), F.concat(F.lit("T"), F.col("user_id") % ENTITIES).alias("title"),
        F.concat(F.lit("U"), F.col("user_id")).alias("user"), F.col("props").alias("comment"), F.col("value"),
    )


#: Comments of edits, by the event's number.
COMMENTS = ["Reverted edits by A", "expand history", "fix typo", "add source", "rv vandalism", "new section", "HotCat: +category", "answer", "he died today"]


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change stream before any filter: wiki, namespace, type, bot, title, user, comment, tags and both times."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    return e.select(
        "event_id", F.concat("event_type", F.lit("wiki")).alias("wiki"), F.when(n % 5 == 0, 1).otherwise(0).alias("namespace"),
        F.when(n % 13 == 0, "log").when(n % 7 == 0, "new").otherwise("edit").alias("type"), (F.col("user_id") % 10 == 0).alias("bot"),
        F.concat(F.lit("T"), F.col("user_id") % ENTITIES).alias("title"), F.concat(F.lit("U"), "user_id", F.when(F.col("user_id") % 12 == 0, "Bot").otherwise("")).alias("user"),
        F.element_at(F.array(*map(F.lit, COMMENTS)), (n % len(COMMENTS) + 1).cast("int")).alias("comment"),
        F.when(n % 11 == 0, F.array(F.lit("mw-reverted"))).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.when(n % 3 != 0, F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("timestamp"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("dt"),
    )
