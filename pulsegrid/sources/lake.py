"""The lake: one partition a day, sorted files, idempotent replacement of whole hours, and a ledger of hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_days(rows: DataFrame, path: str) -> None:
    """Replace the days that rows has; files are sorted, so min and max values skip row groups."""
    tidy = rows.withColumn("day", F.to_date("ts_hour")).repartition("day").sortWithinPartitions("day", "lang", "title", "ts_hour")
    tidy.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("day").parquet(path)


def read_days(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def merged_hours(existing: DataFrame, new: DataFrame, overwrite: bool = False) -> DataFrame:
    """existing with the hours of new: hours already present are kept, or replaced as a whole with overwrite."""
    if overwrite:
        return existing.join(new.select("ts_hour").distinct(), "ts_hour", "left_anti").unionByName(new.select(existing.columns))
    fresh = new.join(existing.select("ts_hour").distinct(), "ts_hour", "left_anti")
    return existing.unionByName(fresh.select(existing.columns))


def ledger(rows: DataFrame) -> DataFrame:
    return rows.groupBy("ts_hour").agg(F.count("*").alias("n_rows"))


def unmatched(ledger_rows: DataFrame, rows: DataFrame) -> DataFrame:
    """Hours whose row count in the lake differs from the ledger's, or that only one of them has."""
    there = rows.groupBy("ts_hour").agg(F.count("*").alias("n_lake"))
    both = ledger_rows.select("ts_hour", F.col("n_rows").alias("n_ledger")).join(there, "ts_hour", "full")
    return both.filter(~F.col("n_ledger").eqNullSafe(F.col("n_lake")))


def compact(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Many files a day become one sorted file a day; (day, n_rows, files_before, files_after) of each day."""
    write_days(spark.read.parquet(source), target)

    def files(path: str, name: str) -> DataFrame:
        rows = spark.read.parquet(path).select(F.to_date("ts_hour").alias("day"), F.col("_metadata.file_path").alias("file"))
        return rows.groupBy("day").agg(F.countDistinct("file").alias(name), F.count("*").alias("n_rows"))

    return files(target, "files_after").join(files(source, "files_before").drop("n_rows"), "day").select("day", "n_rows", "files_before", "files_after")


def pending_days(source: DataFrame, target: DataFrame) -> DataFrame:
    """Days of source that target doesn't have."""
    return source.select("day").distinct().join(target.select("day").distinct(), "day", "left_anti")


def build_pending(source: DataFrame, target: str, build) -> DataFrame:
    """Build the days that target lacks, each partition replaced as a whole; gives those days."""
    spark = source.sparkSession
    days = pending_days(source, spark.read.parquet(target))
    build(source.join(F.broadcast(days), "day", "left_semi")).repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(target)  # a row a day
    return days


def register_views(spark: SparkSession, hourly: DataFrame, sitelinks: DataFrame) -> None:
    """Views hourly and sitelinks for queries in SQL."""
    hourly.createOrReplaceTempView("hourly")
    sitelinks.createOrReplaceTempView("sitelinks")


def read_evolving(spark: SparkSession, *paths: str) -> DataFrame:
    """Day files whose columns changed over time, united by name; a column that a file lacks is null there."""
    return spark.read.option("mergeSchema", True).parquet(*paths)
