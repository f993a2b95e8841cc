"""Results at the edges of SQL's arithmetic, and plans whose work must follow their input."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.operators import evaluation, selection
from pulsegrid.plans import registry
from pulsegrid.sources import changes


def test_shares_of_no_human_views_are_nan_as_in_sql(spark):
    rows = spark.createDataFrame([("en", 5, True), ("de", 7, True)], "lang string, views long, is_automated boolean")
    got = sorted((r.lang, r.raw_views, r.human_views, r.automated_views, r.rank, math.isnan(r.cumulative_share)) for r in selection.rollup_by_language(rows).collect())
    assert got == [("de", 7, 0, 7, 1, True), ("en", 5, 0, 5, 2, True)]
    mixed = selection.rollup_by_language(rows.union(spark.createDataFrame([("en", 3, False)], rows.schema))).collect()
    assert sorted((r.lang, r.cumulative_share) for r in mixed) == [("de", 1.0), ("en", 1.0)]


def test_rank_tests_of_equal_values_or_empty_groups(spark):
    def test(rows):
        return tuple(evaluation.mann_whitney_less(spark.createDataFrame(rows, "g boolean, x long"), "g", "x").first())

    assert test([(True, 0)] * 3 + [(False, 0)] * 2) == (3, 2, 3.0, math.inf, 1.0)
    assert test([(True, 1), (True, 2)]) == (2, 0, 0.0, math.inf, 1.0)
    assert test([(False, 1), (False, 2)]) == (0, 2, None, None, None)
    assert test([]) == (0, 0, None, None, None)
    assert math.isnan(test([(True, 1)])[3])
    # a row of neither group moves the ranks of the others
    assert test([(None, 1), (True, 2), (False, 3)])[:3] == (1, 1, 1.0)


def test_a_larger_feed_has_larger_segments_read_in_parts(spark, tmp_path, monkeypatch):
    for name, value in (("LEAST", 10), ("SEGMENTS", 4), ("PART", 7)):
        monkeypatch.setattr(changes, name, value)
    for n, size in ((30, 10), (200, 50)):  # batches of a replay are segments: three and four
        path = f"file://{tmp_path}/feed{n}"
        changes.write_segments(spark.range(n).select(F.col("id").alias("event_id"), F.col("id").alias("timestamp")), path, ["timestamp"], "timestamp")
        reader = changes.ChangeReader(T.StructType.fromDDL(changes.SCHEMA), {"path": path, "position": "3", "batch_events": "1"})
        assert [s[0] for s in reader.segments()] == list(range(0, n, size))
        assert reader.latestOffset() == {"position": size}
        parts = reader.partitions({"position": 3}, {"position": n})
        assert all(0 < p.high - p.low <= 7 for p in parts)
        assert [(r[0], r[1]) for p in parts for r in reader.read(p)] == [(k, k) for k in range(3, n)]


def test_the_nearest_order_among_many_of_one_place(spark, tmp_path):
    """Few places, so most orders have others at no distance; equal prices, none at all, and orders alone for days."""
    rng = random.Random(5)
    rows = [(i, rng.choice((1, 1, 1, 2, 200, 361)), rng.choice((None, 10.0, 10.0, 25.5, round(rng.random() * 9e4, 2))), datetime(2024, 1, 1) + timedelta(days=rng.choice((0, 0, 1, 3, 9, rng.randrange(90))))) for i in range(400)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    found = registry.queries()["j16_nearest_in_space_and_time"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["j16_nearest_in_space_and_time"]).fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 300
    # rows for each order, whatever the orders in reach: none that the plan joins are as many as the pairs of a place
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "Window" in plan
