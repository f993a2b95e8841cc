"""Events, scores and bursts on hand-made rows: ties, window ends, padding and order."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pulsegrid.functions import robust, titles
from pulsegrid.operators import baseline, events, staging
from pulsegrid.params import Bursts, Events
from pulsegrid.sources import dumps, lake
from pulsegrid.streaming import bursts

T0 = datetime(2026, 3, 1)
P = Events(min_languages=3, r3_threshold=8.0)
SPIKE = "qid long, lang string, title string, ts_hour timestamp_ntz, surprise double, views long, baseline_median double"


def spikes(spark, rows):
    return spark.createDataFrame([(q, lang, "t", T0 + timedelta(hours=h), float(s), 100, 20.0) for q, lang, h, s in rows], SPIKE)


def found(spark, rows, p=P):
    return events.attention_events(events.event_languages(spikes(spark, rows), p), p).collect()


def test_three_languages_within_the_window_are_an_event(spark):
    rows = found(spark, [(1, "de", 0, 9), (1, "en", 2, 20), (1, "fr", 5, 9)])
    assert [(r.event_id, r.breadth, r.lead_lang, r.tier) for r in rows] == [("Q1@20260301T00", 3, "de", "noticed")]


def test_windows_are_half_open(spark):
    assert found(spark, [(1, "de", 0, 9), (1, "en", 2, 9), (1, "fr", 6, 9)]) == []


def test_a_gap_of_exactly_a_day_begins_a_new_episode(spark):
    rows = [(1, x, h, 9) for h in (0, 24) for x in ("de", "en", "fr")]
    assert len(found(spark, rows)) == 2
    assert len(found(spark, [(1, x, h, 9) for h in (0, 23) for x in ("de", "en", "fr")])) == 1


def test_equal_leads_go_by_the_alphabet_and_low_surprise_does_not_count(spark):
    rows = found(spark, [(1, "fr", 0, 9), (1, "de", 0, 9), (1, "en", 1, 9), (1, "it", 1, 7.9)])
    assert [(r.lead_lang, r.breadth) for r in rows] == [("de", 3)]


def test_excess_is_never_negative_and_covers_a_day(spark):
    rows = events.event_languages(spikes(spark, [(1, "de", 0, 9), (1, "en", 0, 9), (1, "fr", 0, 9), (1, "de", 30, 9)]), P).collect()
    assert {r.lang: r.excess_views for r in rows} == {"de": 80.0, "en": 80.0, "fr": 80.0}


def test_order_of_rows_does_not_matter(spark):
    rows = [(q, x, h, 9 + h % 3) for q in range(3) for x in ("de", "en", "fr", "it") for h in (0, 3, 40, 41)]
    one = found(spark, rows)
    random.Random(1).shuffle(rows)
    assert sorted(map(str, one)) == sorted(map(str, found(spark, rows)))


def test_padded_median_counts_absent_observations(spark):
    row = spark.sql("SELECT array(10L, 30L) AS v, 5 AS n").select(
        robust.array_median(robust.zero_padded(F.col("v"), F.col("n"))).alias("m"), robust.array_mad(robust.zero_padded(F.col("v"), F.col("n"))).alias("d"), robust.array_median(F.col("v")).alias("p")
    ).first()
    assert (row.m, row.d, row.p) == (0.0, 0.0, 20.0)


def test_an_unseen_item_has_the_prior_and_no_first_rule(spark):
    rows = [("en", f"old{k}", T0 + timedelta(hours=24 * d + h), 100, 100) for k in range(3) for d in range(10) for h in (5, 6)]
    rows.append(("en", "new", T0 + timedelta(days=9, hours=6), 5000, 5000))
    stg = staging.stage(spark.createDataFrame(rows, "lang string, title string, ts_hour timestamp_ntz, views_desktop long, views_mobile long"))
    days = baseline.calendar(stg.select("day").distinct(), "2026-03-01")
    got = {r.title: r for r in baseline.score_candidates(stg, baseline.language_priors(stg), days).filter("day = '2026-03-10' AND hour_of_day = 6").collect()}
    assert (got["new"].baseline_level, got["new"].unseen, got["new"].r1, got["new"].r2) == ("prior", True, False, True)
    assert got["new"].baseline_median == 200.0
    assert (got["old0"].unseen, got["old0"].views_yesterday) == (False, 200)


def test_titles_decode_once_and_keep_what_is_not_utf8(spark):
    raw = ["a%20b", "100%_Love", "%ff", "a+b c", None]
    rows = titles.normalize_titles(spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, title string")).orderBy("i").collect()
    assert [r.title for r in rows] == ["a_b", "100%_Love", "%ff", "a+b_c", None]


def test_broken_lines_are_dropped_and_letters_are_hours(spark):
    lines = spark.createDataFrame([("en A 3 0",), ("en A x 0",), ("en A 3",), ("",)], "value string")
    assert [tuple(r) for r in dumps.parse_hourly_lines(lines).collect()] == [("en", "A", 3)]
    daily = spark.createDataFrame([("en.wikipedia T null desktop 15 A3X12",), ("en.wikipedia T desktop 3 B3",), ("bad",)], "value string")
    got = sorted((r.daily_total, r.hour, r.views) for r in dumps.parse_daily_lines(daily).collect())
    assert got == [(3, 1, 3), (15, 0, 3), (15, 23, 12)]


def test_upserting_hours_twice_changes_nothing(spark):
    shape = "ts_hour timestamp_ntz, lang string, views long"
    old = spark.createDataFrame([(T0, "en", 1), (T0 + timedelta(hours=1), "en", 2)], shape)
    new = spark.createDataFrame([(T0 + timedelta(hours=1), "en", 9), (T0 + timedelta(hours=2), "en", 3)], shape)
    once = lake.merged_hours(old, new)
    assert sorted(r.views for r in once.collect()) == [1, 2, 3]
    assert sorted(r.views for r in lake.merged_hours(once, new).collect()) == [1, 2, 3]
    assert sorted(r.views for r in lake.merged_hours(old, new, overwrite=True).collect()) == [1, 3, 9]


def test_the_lake_keeps_other_days(spark, tmp_path):
    shape = "ts_hour timestamp_ntz, lang string, title string, views long"
    path = str(tmp_path / "lake")
    lake.write_days(spark.createDataFrame([(T0, "en", "a", 1), (T0 + timedelta(days=1), "en", "a", 2)], shape), path)
    lake.write_days(spark.createDataFrame([(T0, "en", "a", 5)], shape), path)
    assert sorted(r.views for r in lake.read_days(spark, path, "2026-03-01", "2026-03-02").collect()) == [2, 5]


def test_bursts_cool_down_and_anonymous_users_are_not_editors(spark):
    p = Bursts(min_edits=3, min_editors=2, window_minutes=30, ratio=2.0)
    edits = [("en", "a", s, u) for s, u in [(0, "x"), (60, "y"), (120, None), (180, "x"), (21_720, "x"), (21_730, "y"), (21_740, "z")]]
    edits += [("en", "b", s, None) for s in range(0, 500, 60)]
    got = bursts.bursts(spark.createDataFrame(edits, "lang string, title string, second long, user string"), p).collect()
    assert sorted((r.title, r.second, r.n_edits, r.n_editors) for r in got) == [("a", 120, 3, 2), ("a", 21_740, 3, 3)]


def test_new_pages_burst_by_fewer_edits(spark):
    p = Bursts(min_edits=9, min_editors=9, new_page_minutes=60, new_page_edits=3, new_page_editors=2)
    edits = [("en", "a", s, u, s == 0) for s, u in [(0, "x"), (60, "x"), (3000, "y"), (3100, "z"), (30_000, "q")]]
    edits += [("en", "b", s, u, False) for s, u in [(0, "x"), (60, "x"), (3000, "y")]]
    got = bursts.bursts(spark.createDataFrame(edits, "lang string, title string, second long, user string, is_new boolean"), p).collect()
    assert [(r.title, r.second, r.kind, r.n_edits, r.n_editors) for r in got] == [("a", 3000, "new", 3, 2)]


def test_the_stream_drops_replays_and_ends_idle_states(spark, tmp_path):
    from pulsegrid.streaming import stateful

    p = Bursts(min_edits=3, min_editors=2, window_minutes=30, ratio=2.0, new_page_minutes=0, cooldown_hours=1)
    schema = "event_id long, lang string, title string, second long, user string, is_new boolean"
    first = [(1, "en", "a", 100, "x", False), (2, "en", "a", 130, "y", False), (2, "en", "a", 130, "y", False), (2, "en", "a", 130, "y", False)]
    second = [(3, "en", "a", 110, "z", False), (4, "en", "far", 400_000, "q", False)]
    third = [(5, "en", "a", 400_100, "x", False), (6, "en", "a", 90, "late", False)]
    for i, rows in enumerate((first, second, third)):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{tmp_path}/in/{i}")
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in").withColumn("time", F.timestamp_seconds("second"))
    out = stateful.stream_bursts(rows, None, p)
    query = out.writeStream.format("memory").queryName("found").option("checkpointLocation", f"{tmp_path}/log").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    # a replay is no edit; edits that come before their time is closed count in their place, as in the batch form
    want = bursts.bursts(spark.createDataFrame([first[0], first[1], *second, *third], schema), p).filter("second < 1000")
    got = [(r.title, r.second, r.n_edits, r.n_editors) for r in spark.table("found").collect()]
    assert got == [(r.title, r.second, r.n_edits, r.n_editors) for r in want.collect()] == [("a", 110, 3, 3)]
    states = [s for s in query.lastProgress["stateOperators"] if "transformWithState" in s["operatorName"]]
    assert states  # what is left are the two articles that wait for the watermark: no rows of the old window


def test_later_hours_never_change_features(spark):
    from pulsegrid.operators import snapshots

    shape = "qid long, lang string, title string, ts_hour timestamp_ntz, views long, surprise double, baseline_median double"
    ev = spark.createDataFrame([("Q1@x", 1, T0, "de", 3)], "event_id string, qid long, start_hour timestamp_ntz, lead_lang string, breadth long")
    past = [(1, x, "t", T0 + timedelta(hours=h), 100 + h, 9.0, 20.0) for x, h in (("de", 0), ("en", 1), ("fr", 3))]
    later = [(1, "it", "u", T0 + timedelta(hours=h), 9999, 50.0, 20.0) for h in range(5, 60)]
    one, two = (snapshots.snapshots(ev, spark.createDataFrame(r, shape), 8.0).orderBy("snapshot_id").collect() for r in (past, past + later))
    assert len(one) == 3 and one == two
