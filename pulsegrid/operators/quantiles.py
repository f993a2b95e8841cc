"""Exact quantiles of groups of any size, by rounds of range refinement.

A rank lies in one of some thousand ranges of values; counting rows by range tells which, and the next round looks at that range
alone, from its least to its largest value. Each round is one scan with a count by range before the shuffle, so no task
ever holds a group's values; a range is done when its least and largest value are the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.session import scratch


def _joined(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """a with b's further columns, by columns that may be null."""
    renamed = b.select(*[b[c].alias(f"_{c}") for c in by], *[c for c in b.columns if c not in by])
    on = F.lit(True)
    for c in by:
        on = on & a[c].eqNullSafe(renamed[f"_{c}"])
    return a.join(renamed, on).drop(*[f"_{c}" for c in by])


def exact_quantiles(rows: DataFrame, by: list[str], value: str, shares: tuple[float, ...], ranges: int = 2048) -> DataFrame:
    """(by, share, quantile) of each group, interpolated between the two ranks beside it as percentile does. Null and
    NaN values are not counted; a group without others has no rows. by may be empty, and its columns null."""
    spark = rows.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = scratch(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    v = F.col("v")
    data = kept(rows.select(*by, F.col(value).cast("double").alias("v")).filter(v.isNotNull() & ~F.isnan("v")), "values")
    ends = data.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = (F.col("n") - 1) * F.col("share")
    asked = kept(ends.filter("n > 0").withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("place", place), "asked")
    ranks = asked.select(*by, "lo", "hi", F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("rank")).distinct()
    state = kept(ranks.withColumn("below", F.lit(0).cast("long")), "ranks")
    while state.filter("lo < hi").limit(1).count():
        wide = state.filter("lo < hi")
        spans = wide.select(*by, "lo", "hi").distinct()
        inside = _joined(data, spans, by).filter((v >= F.col("lo")) & (v <= F.col("hi")))
        part = F.least(F.floor((v / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * ranges), F.lit(ranges - 1))
        counts = inside.groupBy(*by, "lo", "hi", part.alias("part")).agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("z"))
        before = Window.partitionBy(*by, "lo", "hi").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        found = counts.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
        at = F.col("rank") - F.col("below")
        next_ = _joined(wide, found, [*by, "lo", "hi"]).filter((at >= F.col("before")) & (at < F.col("before") + F.col("c")))
        next_ = next_.select(*by, F.col("a").alias("lo"), F.col("z").alias("hi"), "rank", (F.col("below") + F.col("before")).alias("below"))
        state = kept(state.filter("lo = hi").select(*by, "lo", "hi", "rank", "below").unionByName(next_), "ranks")
    known = state.select(*by, "rank", F.col("lo").alias("found"))
    low = _joined(asked.withColumn("rank", F.floor("place")).drop("lo", "hi"), known, [*by, "rank"]).withColumnRenamed("found", "low").drop("rank")
    both = _joined(low.withColumn("rank", F.ceil("place")), known, [*by, "rank"])
    return both.select(*by, "share", (F.col("low") + (F.col("found") - F.col("low")) * (F.col("place") - F.floor("place"))).alias("quantile"))


def quantile_columns(rows: DataFrame, by: list[str], value: str, names: dict[str, float]) -> DataFrame:
    """(by, one column a name): exact_quantiles side by side."""
    found = exact_quantiles(rows, by, value, tuple(names.values()))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("share") == p, F.col("quantile"))).alias(n) for n, p in names.items()])
