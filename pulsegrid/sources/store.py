"""A store of day partitions whose state is a log of commits.

Every write puts whole new versions of the days it touches beside the old ones; the commit, one small file that must not exist
yet, makes them current. So a reader sees all of a write or nothing, a run that broke leaves nothing but files that no commit
names, and of two writers that started from the same state the second merges again. A commit can carry a key (a stream's
batch, a job's run): a key that the log has is not written again.

    data/<version>/day=2024-01-05/*.parquet    rows of a day, sorted
    log/0000000012.json                        days and their versions, hours and their row counts, the key
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import date, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = "commit long, key string, days array<struct<day: date, version: string, n_rows: long>>, hours array<struct<hour: timestamp_ntz, n_rows: long, source: string>>"


class Conflict(RuntimeError):
    """Other writers committed first, again and again."""


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file with the text, all at once; false if the file is there already."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    aside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    fs = target.getFileSystem(conf)
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:  # without an option the rename fails where the target exists
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
        context.rename(aside, target, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        fs.delete(aside, False)
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    return True


class DayStore:
    """Rows of a fixed schema, replaced by whole hours. time is the column with their hour, by are the columns that sort a
    day's files. Log entries are a row a day or hour of a commit; only those meet the driver."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, time: str = "ts_hour", by: tuple[str, ...] = ("lang", "title")):
        self.spark, self.root, self.schema, self.time, self.by = spark, root, schema, time, by
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/log")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG).json(f"{self.root}/log")

    def head(self) -> int:
        return self.log().agg(F.max("commit")).first()[0] or 0

    def has(self, key: str) -> bool:
        return bool(self.log().filter(F.col("key") == key).limit(1).count())

    def hours_of(self, key: str) -> DataFrame:
        """(ts_hour) of the commit with the key, hours without rows included."""
        return self.log().filter(F.col("key") == key).select(F.explode("hours").alias("x")).select(F.col("x.hour").alias(self.time))

    def ledger(self, upto: int | None = None) -> DataFrame:
        """(ts_hour, n_rows, source): the latest entry of every hour."""
        rows = self.log() if upto is None else self.log().filter(F.col("commit") <= upto)
        rows = rows.select("commit", F.explode("hours").alias("x")).groupBy(F.col("x.hour").alias(self.time))
        return rows.agg(F.max_by("x", "commit").alias("x")).select(self.time, "x.n_rows", "x.source")

    def versions(self, upto: int | None = None) -> dict[date, str]:
        """The version of each day that has rows."""
        rows = self.log() if upto is None else self.log().filter(F.col("commit") <= upto)
        rows = rows.select("commit", F.explode("days").alias("x")).groupBy("x.day").agg(F.max_by("x", "commit").alias("x"))
        return {r.day: r.version for r in rows.filter("x.n_rows > 0").select("x.day", "x.version").collect()}

    def read(self, first: date | None = None, last: date | None = None, upto: int | None = None) -> DataFrame:
        """Rows of the days between, as they were after a commit (the latest)."""
        paths = [f"{self.root}/data/{v}/day={d}" for d, v in sorted(self.versions(upto).items()) if (first is None or d >= first) and (last is None or d <= last)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def upsert(
        self, rows: DataFrame, source: str, overwrite: bool = False, key: str | None = None, hours: DataFrame | None = None,
        attempts: int = 5, before_commit: Callable[[], None] = lambda: None,
    ) -> list[datetime]:
        """Put whole hours in: those that the ledger has are left alone, or replaced with overwrite. hours names them where an
        hour may have no rows (else they are those of rows). Gives the hours written; none for a key that was committed."""
        spark, time = self.spark, self.time
        if key is not None and self.has(key):
            return []
        staged = f"{self.root}/aside/{uuid.uuid4().hex}"
        rows.select([F.col(f.name).cast(f.dataType) for f in self.schema]).write.parquet(staged)
        new = spark.read.schema(self.schema).parquet(staged)
        asked = (new if hours is None else hours).select(F.date_trunc("hour", time).cast("timestamp_ntz").alias(time)).distinct()
        for _ in range(attempts):
            head = self.head()
            todo = asked if overwrite else asked.join(self.ledger(head), time, "left_anti")
            todo = spark.createDataFrame([(r[0],) for r in todo.collect()], f"{time} timestamp_ntz")  # a row an hour
            written = sorted(r[0] for r in todo.collect())
            if not written and key is None:
                return []
            log = self._write(new, todo, sorted({h.date() for h in written}), head) if written else {"days": [], "hours": []}
            before_commit()
            entry = {"commit": head + 1, "key": key, "days": log["days"], "hours": [h | {"source": source} for h in log["hours"]]}
            if publish(spark, f"{self.root}/log/{head + 1:010d}.json", json.dumps(entry)):
                return written
        raise Conflict(f"{self.root}: other writers came first {attempts} times")

    def _write(self, new: DataFrame, todo: DataFrame, days: list[date], head: int) -> dict:
        """Write the days anew with todo's hours replaced; what the log says of it."""
        spark, time, hour = self.spark, self.time, F.date_trunc("hour", self.time).cast("timestamp_ntz")
        keyed = lambda df: df.withColumn("_hour", hour)
        asked = F.broadcast(todo.withColumnRenamed(time, "_hour"))  # a row an hour of this write
        versions = self.versions(head)
        paths = [f"{self.root}/data/{versions[d]}/day={d}" for d in days if d in versions]
        merged = keyed(new).join(asked, "_hour", "left_semi")
        if paths:
            merged = merged.unionByName(keyed(spark.read.schema(self.schema).parquet(*paths)).join(asked, "_hour", "left_anti"))
        version = uuid.uuid4().hex
        tidy = merged.drop("_hour").withColumn("day", F.to_date(time)).repartitionByRange("day", *self.by).sortWithinPartitions("day", *self.by, time)
        tidy.write.option("compression", "zstd").partitionBy("day").parquet(f"{self.root}/data/{version}")
        found = keyed(spark.read.schema(T.StructType([*self.schema, T.StructField("day", T.DateType())])).parquet(f"{self.root}/data/{version}"))
        counts = found.groupBy("_hour").agg(F.count("*").alias("n"))
        by_hour = {r["_hour"]: r["n"] for r in counts.collect()}  # a row an hour of the days written
        asked_hours = [r[0] for r in todo.collect()]
        return {
            "days": [{"day": str(d), "version": version, "n_rows": sum(n for h, n in by_hour.items() if h.date() == d)} for d in days],
            "hours": [{"hour": h.strftime("%Y-%m-%dT%H:%M:%S"), "n_rows": by_hour.get(h, 0)} for h in sorted(asked_hours)],
        }
