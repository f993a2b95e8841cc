"""Merging, staging and filtering of hourly counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.robust import population_cv
from pulsegrid.params import Automation


def merge_counts(raw: DataFrame, min_views: int = 5) -> DataFrame:
    """Desktop and mobile sums of each (hour, lang, title); hours below min_views are not retained."""
    counts = raw.groupBy("ts_hour", "lang", "title").agg(
        F.sum(F.when(~F.col("is_mobile"), F.col("v")).otherwise(0)).alias("views_desktop"),
        F.sum(F.when(F.col("is_mobile"), F.col("v")).otherwise(0)).alias("views_mobile"),
    )
    return counts.filter(F.col("views_desktop") + F.col("views_mobile") >= min_views)


def stage(hourly: DataFrame) -> DataFrame:
    """Calendar columns, views and mobile share of hourly counts."""
    views = F.col("views_desktop") + F.col("views_mobile")
    return hourly.withColumns({
        "day": F.to_date("ts_hour"),
        "hour_of_day": F.hour("ts_hour"),
        "is_weekend": F.weekday("ts_hour") >= 5,
        "views": views,
        "mobile_share": F.try_divide(F.col("views_mobile").cast("double"), views),
    })


def project_code(code: Column, excluded: list[str]) -> Column:
    """struct(lang, is_mobile) of a project code such as "de" or "de.m"; null for others."""
    shape = r"^([a-z][a-z0-9-]*)(\.m)?$"
    lang = F.regexp_extract(code, shape, 1)
    return F.when(code.rlike(shape) & ~lang.isin(excluded), F.struct(lang.alias("lang"), code.endswith(".m").alias("is_mobile")))


def namespace_prefix(title: Column) -> Column:
    """What stands before the first colon, folded; empty without one."""
    return F.lower(F.trim(F.replace(F.regexp_extract(title, "^([^:]+):", 1), F.lit("_"), F.lit(" "))))


def articles(rows: DataFrame, excluded_titles: DataFrame, namespaces: DataFrame) -> DataFrame:
    """rows without excluded (lang, title) pairs and titles in an excluded (lang, prefix) namespace."""
    found = rows.filter(~F.col("title").isin("", "-")).withColumn("prefix", namespace_prefix(F.col("title")))
    return found.join(excluded_titles, ["lang", "title"], "left_anti").join(namespaces, ["lang", "prefix"], "left_anti").drop("prefix")


def automation_flags(stg: DataFrame, p: Automation = Automation()) -> DataFrame:
    """Days of items whose traffic looks automated: hardly any mobile share, or a flat day."""
    day = stg.groupBy("lang", "title", "day").agg(
        F.sum("views").alias("day_views"),
        F.sum("views_mobile").alias("day_mobile"),
        F.sum(F.col("views").cast("double") * F.col("views")).alias("squares"),
    )
    mean = F.col("day_views") / 24.0
    shaped = day.filter(F.col("day_views") >= p.floor).withColumns({
        "mobile_share": F.col("day_mobile") / F.col("day_views").cast("double"),
        "hourly_mean": mean,
        "hourly_cv": population_cv(F.col("day_views"), F.col("squares"), 24.0),
    })
    low = (F.col("day_views") >= p.day_views_min) & (F.col("mobile_share") < p.mobile_share_max)
    flat = (F.col("hourly_mean") >= p.flat_hourly_mean_min) & (F.col("hourly_cv") < p.flat_cv_max)
    return shaped.select("lang", "title", "day", "day_views", "mobile_share", "hourly_mean", "hourly_cv", low.alias("is_low_mobile"), flat.alias("is_flat"), (low | flat).alias("is_automated"))
