"""Readers of public dump formats: hourly counts, daily complete counts, and site links as SQL tuples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_hourly_lines(lines: DataFrame, *kept: str) -> DataFrame:
    """(kept, project, title, views) of "project title views bytes" lines in the column value; malformed ones are dropped."""
    part = F.split("value", " ")
    rows = lines.filter(F.size(part) == 4).select(*kept, part[0].alias("project"), part[1].alias("title"), part[2].try_cast("long").alias("views"))
    return rows.filter("views IS NOT NULL")


def parse_daily_lines(lines: DataFrame, *kept: str) -> DataFrame:
    """(kept, wiki, title, access, daily_total, hour, views): a row for each hour of "wiki title [page] access total
    A3C12" lines of five or six fields in the column value, read from both ends. Letters A to X are the hours of the day."""
    part = F.split("value", " ")
    rows = lines.filter(F.size(part).isin(5, 6)).select(
        *kept, part[0].alias("wiki"), part[1].alias("title"), F.element_at(part, -3).alias("access"), F.element_at(part, -2).try_cast("long").alias("daily_total"),
        F.explode(F.regexp_extract_all(F.element_at(part, -1), F.lit("([A-X][0-9]+)"), F.lit(1))).alias("cell"),
    )
    return rows.withColumns({"hour": F.ascii("cell") - 65, "views": F.substring("cell", 2, 12).cast("long")}).drop("cell")


def parse_sitelinks(lines: DataFrame, sites: DataFrame, value: str = "value") -> DataFrame:
    """(lang, title, qid) of SQL-dump tuples (row,item,'site','page') whose site is in sites (site, lang)."""
    shape = r"\((\d+),(\d+),'((?:[^'\\]|\\.)*)','((?:[^'\\]|\\.)*)'\)"
    some = lines.filter(F.col(value).startswith("(") | F.col(value).startswith("INSERT INTO"))
    rows = some.select(F.explode(F.regexp_extract_all(value, F.lit(f"({shape})"), F.lit(1))).alias("t"))
    field = lambda i: F.regexp_extract("t", shape, i)
    page = F.regexp_replace(field(4), r"\\(.)", "$1")
    rows = rows.select(field(2).cast("long").alias("qid"), field(3).alias("site"), F.replace(page, F.lit(" "), F.lit("_")).alias("title"))
    return rows.join(F.broadcast(sites), "site").select("lang", "title", "qid")


def scan_hourly(spark, path: str) -> DataFrame:
    """Hourly dump files with the hour they cover: one before the stamp in the file's name."""
    stamp = F.regexp_extract(F.input_file_name(), r"pageviews-(\d{8}-\d{6})", 1)
    lines = spark.read.text(path).withColumn("ts_hour", F.to_timestamp_ntz(stamp, F.lit("yyyyMMdd-HHmmss")) - F.expr("INTERVAL 1 HOUR"))
    return parse_hourly_lines(lines, "ts_hour")


def links_of_wikitext(days: DataFrame) -> DataFrame:
    """(date, section, entry, depth, lang, title) of the links in the bullets of portal pages (date, text).
    The heading carries forward over lines; a link counts once an entry."""
    lines = days.select("date", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("line", F.trim("line"))
    heading = r"^'''([^']+)'''\s*$"
    from pyspark.sql import Window

    order = Window.partitionBy("date").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    bullet = F.col("line").rlike(r"^\*+")
    rows = lines.withColumns({
        "section": F.coalesce(F.last(F.when(F.col("line").rlike(heading), F.trim(F.regexp_extract("line", heading, 1))), ignorenulls=True).over(order), F.lit("Uncategorized")),
        "entry": F.sum(bullet.cast("int")).over(order),
    }).filter(bullet)
    rows = rows.withColumns({"depth": F.length(F.regexp_extract("line", r"^(\*+)", 1)), "body": F.regexp_replace("line", r"^\*+\s*", "")})
    own = F.transform(F.regexp_extract_all("body", F.lit(r"\[\[([^\[\]|#]+)(?:#[^\[\]|]*)?(?:\|[^\[\]]*)?\]\]"), F.lit(1)), lambda t: F.struct(F.lit("en").alias("lang"), F.trim(t).alias("title")))
    foreign = r"\{\{\s*ill\s*\|[^|}]+\|([a-z-]+)\|([^|}]+)"
    other = F.zip_with(F.regexp_extract_all("body", F.lit(foreign), F.lit(1)), F.regexp_extract_all("body", F.lit(foreign), F.lit(2)), lambda a, t: F.struct(a.alias("lang"), F.trim(t).alias("title")))
    skipped = r"^(?i)(file|image|category|wikt|portal|template)?:"
    own = F.filter(own, lambda x: (x["title"] != "") & ~x["title"].rlike(skipped))
    return rows.select("date", "section", "entry", "depth", F.explode(F.array_distinct(F.concat(own, other))).alias("l")).select("date", "section", "entry", "depth", "l.lang", "l.title")


def scan_daily(spark, path: str) -> DataFrame:
    """(ts_hour, wiki, title, access, daily_total, views) of daily files; the day is in the file's name."""
    lines = spark.read.text(path).withColumn("day", F.to_date(F.regexp_extract(F.input_file_name(), r"pageviews-(\d{8})", 1), "yyyyMMdd"))
    hour = F.expr("timestampadd(HOUR, hour, CAST(day AS TIMESTAMP_NTZ))")
    return parse_daily_lines(lines, "day").select(hour.alias("ts_hour"), "wiki", "title", "access", "daily_total", "views")


def access_kind(wiki: Column, access: Column) -> Column:
    """struct(lang, is_mobile) of a row of a daily file; null for other projects and other kinds of access."""
    known = wiki.endswith(".wikipedia") & access.isin("desktop", "mobile-web", "mobile-app")
    return F.when(known, F.struct(F.regexp_replace(wiki, r"\.wikipedia$", "").alias("lang"), (access != "desktop").alias("is_mobile")))


def write_dump(lines: DataFrame, path: str, compression: str) -> None:
    """Text files by the name in the column file; one folder a name, so that readers find it in the path."""
    lines.repartition("file").write.partitionBy("file").option("compression", compression).text(path)


def read_manifest(spark, path: str) -> DataFrame:
    """(ts_hour, n_rows, source) of a JSON map from hours to their entries."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,struct<rows:long,source:string>>")).alias("hour", "x"))
    return rows.select(F.to_timestamp_ntz("hour", F.lit("yyyy-MM-dd'T'HH")).alias("ts_hour"), F.col("x.rows").alias("n_rows"), "x.source")


BURSTS = "lang string, title string, second long, n_edits long, n_editors int"


def read_bursts(spark, path: str, day: str | None = None) -> DataFrame:
    """Bursts of JSON lines, those of one day or all."""
    rows = spark.read.schema(BURSTS).json(path)
    return rows if day is None else rows.filter(F.to_date(F.timestamp_seconds("second")) == F.lit(day).cast("date"))


def read_labels(spark, path: str, units: DataFrame) -> DataFrame:
    """(unit_id, label) of a CSV file with a header; an error if a unit of the sheet (unit_id) has no label."""
    rows = spark.read.option("header", True).schema("unit_id long, label int").csv(path)
    missing = units.select("unit_id").join(rows, "unit_id", "left_anti").limit(1).count()
    if missing:
        raise ValueError("units of the sheet without a label")
    return rows
