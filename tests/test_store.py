"""The store with a commit log: whole hours, broken and repeated runs, two writers, and the pipeline's stages."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.session import scratch
from pulsegrid.sources.store import Conflict, DayStore

SCHEMA = T.StructType([T.StructField("ts_hour", T.TimestampNTZType()), T.StructField("lang", T.StringType()), T.StructField("title", T.StringType()), T.StructField("v", T.LongType())])


def rows(spark, hours, v=1, day=5):
    return spark.createDataFrame([(datetime(2024, 1, day, h), "a", f"t{k}", v) for h in hours for k in range(3)], SCHEMA)


@pytest.fixture
def store(spark):
    return DayStore(spark, scratch(spark, "store"), SCHEMA)


def content(store, **more):
    return sorted((r.ts_hour.day, r.ts_hour.hour, r.title, r.v) for r in store.read(**more).collect())


def test_hours_are_kept_or_replaced_as_a_whole(spark, store):
    assert content(store) == [] and store.ledger().count() == 0
    assert [h.hour for h in store.upsert(rows(spark, [1, 2]), "x")] == [1, 2]
    assert [h.hour for h in store.upsert(rows(spark, [2, 3], v=9), "y")] == [3]
    assert {(h, v) for _, h, _, v in content(store)} == {(1, 1), (2, 1), (3, 9)}
    new = rows(spark, [2], v=7).filter("title = 't0'")
    store.upsert(new, "z", overwrite=True)
    assert [(h, v) for _, h, _, v in content(store)] == [(1, 1)] * 3 + [(2, 7)] + [(3, 9)] * 3
    assert {(r.ts_hour.hour, r.n_rows, r.source) for r in store.ledger().collect()} == {(1, 3, "x"), (2, 1, "z"), (3, 3, "y")}
    assert [(h, v) for _, h, _, v in content(store, upto=1)] == [(1, 1)] * 3 + [(2, 1)] * 3  # as it was


def test_hours_without_rows_empty_what_was_there(spark, store):
    store.upsert(rows(spark, [1, 2]), "x")
    store.upsert(rows(spark, [1]).filter("false"), "x", overwrite=True, hours=rows(spark, [1, 2]).select("ts_hour"))
    assert content(store) == [] and {r.n_rows for r in store.ledger().collect()} == {0}
    store.upsert(rows(spark, [1], day=6), "x")
    assert {d for d, *_ in content(store)} == {6} and content(store, last=date(2024, 1, 5)) == []


def test_a_broken_run_changes_nothing_and_a_repeated_one_once(spark, store):
    store.upsert(rows(spark, [1]), "x")

    def broken():
        raise RuntimeError("on purpose")

    with pytest.raises(RuntimeError, match="on purpose"):
        store.upsert(rows(spark, [1, 2], v=5), "x", overwrite=True, key="k", before_commit=broken)
    assert {v for *_, v in content(store)} == {1} and not store.has("k")
    assert len(store.upsert(rows(spark, [1, 2], v=5), "x", overwrite=True, key="k")) == 2
    assert store.upsert(rows(spark, [1, 2], v=6), "x", overwrite=True, key="k") == []
    assert {v for *_, v in content(store)} == {5} and store.hours_of("k").count() == 2


def test_the_second_of_two_writers_merges_again(spark, store):
    other = DayStore(spark, store.root, SCHEMA)
    calls = []

    def meanwhile():
        if not calls:
            calls.append(1)
            other.upsert(rows(spark, [2], v=8), "other")

    store.upsert(rows(spark, [1, 2], v=3), "own", before_commit=meanwhile)
    assert {(h, v) for _, h, _, v in content(store)} == {(1, 3), (2, 8)} and store.head() == 2

    def always():
        calls.append(1)
        other.upsert(rows(spark, [len(calls)], day=7), "other")

    with pytest.raises(Conflict):
        store.upsert(rows(spark, [9]), "own", attempts=2, before_commit=always)


def test_null_keys_and_further_columns(spark, store):
    odd = spark.createDataFrame([(datetime(2024, 1, 5, 1), None, None, None), (datetime(2024, 1, 5, 1), "a", None, 2)], SCHEMA).withColumn("day", F.lit("own"))
    store.upsert(odd, "x")
    store.upsert(rows(spark, [2]), "x")
    assert sorted((r.lang or "", r.v or 0) for r in store.read().filter("hour(ts_hour) = 1").collect()) == [("", 0), ("a", 2)]
