"""Burst rules in batch and in a stream, exact quantiles, the feed and coverage, against plain Python."""

from __future__ import annotations

import math
import random
import statistics
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.operators import quantiles
from pulsegrid.params import Bursts
from pulsegrid.plans.live import arrivals
from pulsegrid.plans.streams import drained
from pulsegrid.session import scratch
from pulsegrid.sources import changes
from pulsegrid.streaming import bursts, coverage, stateful

P = Bursts(min_edits=4, min_editors=3, window_minutes=30, ratio=2.0, new_page_minutes=60, new_page_edits=3, new_page_editors=2, cooldown_hours=1, baseline_hours=5, baseline_min_hours=2)


def made_edits(seed, n=900, articles=3, step=90):
    rng = random.Random(seed)
    at, out = 1_700_000_000 - 1_700_000_000 % 86400 + 80000, []
    for i in range(n):
        at += rng.choice([0, 0, 1, rng.randrange(step), rng.randrange(40 * step) if rng.random() < 0.02 else 3])
        out.append((i, "a" if rng.random() < 0.8 else "b", f"T{rng.randrange(articles)}", at, rng.choice([None, "u", "v", "w", "x", "y"]), rng.random() < 0.02))
    return out


def plain_bursts(edits, p):
    """Second by second, with every list looked through again."""
    hours = defaultdict(lambda: defaultdict(int))
    for _, lang, title, s, _, _ in edits:
        hours[lang, s // 3600][title] += 1
    base = {}
    for lang in {k[0] for k in hours}:
        own = sorted(h for k, h in hours if k == lang)
        for h in own:
            past = [statistics.median(hours[lang, g].values()) for g in own if g < h][-p.baseline_hours :]
            base[lang, h] = statistics.median(past) if len(past) >= p.baseline_min_hours else 1.0
    out = []
    for key in {(e[1], e[2]) for e in edits}:
        own = sorted((e for e in edits if (e[1], e[2]) == key), key=lambda e: e[3])
        created, last = min((e[3] for e in own if e[5]), default=None), None
        for s in sorted({e[3] for e in own}):
            if last is not None and s - last < 3600 * p.cooldown_hours:
                continue
            near = [e for e in own if s - 60 * p.window_minutes < e[3] <= s]
            people = len({e[4] for e in near} - {None})
            if len(near) >= p.min_edits and people >= p.min_editors and 2 * len(near) >= p.ratio * base[key[0], s // 3600]:
                out.append((*key, s, "window", len(near), people))
                last = s
                continue
            if created is not None and 0 <= s - created <= 60 * p.new_page_minutes:
                near = [e for e in own if created <= e[3] <= s]
                people = len({e[4] for e in near} - {None})
                if len(near) >= p.new_page_edits and people >= p.new_page_editors:
                    out.append((*key, s, "new", len(near), people))
                    last = s
    return sorted(out)


def frame(spark, edits):
    return spark.createDataFrame(edits, "event_id long, lang string, title string, second long, user string, is_new boolean")


def test_bursts_equal_a_plain_walk(spark):
    kinds = set()
    for seed in range(4):
        edits = made_edits(seed)
        want = plain_bursts(edits, P)
        assert sorted(tuple(r) for r in bursts.bursts(frame(spark, edits), P).collect()) == want
        kinds |= {r[3] for r in want}
    assert kinds == {"window", "new"}
    assert bursts.bursts(frame(spark, []), P).count() == 0


def test_counts_carry_over_the_borders_of_blocks(spark):
    edits = [(i, "a", "T", 86400 - 5 + i, u, False) for i, u in enumerate(["u", "v", "u", None, "w", "v", "u", "x", "x", "u"])]
    got = {r.second: (r.n_edits, r.n_editors) for r in bursts.window_counts(frame(spark, edits), 6).collect()}
    for _, _, _, s, _, _ in edits:
        near = [e for e in edits if s - 6 < e[3] <= s]
        assert got[s] == (len(near), len({e[4] for e in near} - {None}))


def stream_of(spark, edits, late, files=5):
    path = scratch(spark, "edits")
    arrivals(frame(spark, edits), F.col("second") + F.pmod(F.xxhash64("event_id"), F.lit(60 * late)), path, files)
    return spark.readStream.schema("event_id long, lang string, title string, second long, user string, is_new boolean").option("maxFilesPerTrigger", 1).json(path).withColumn("time", F.timestamp_seconds("second"))


def test_late_rows_over_many_batches_make_no_false_bursts(spark):
    """Six edits at once, one a little older in a later batch: with a baseline of 10 nothing bursts."""
    first = 1_700_000_000
    edits = [(i, "a", "T", first + i, f"u{i}", False) for i in range(6)] + [(6, "a", "T", first - 10, "late", False)] + [(7 + i, "b", "Z", first + 9000 * (i + 1), "z", False) for i in range(3)]
    path = scratch(spark, "edits")
    for part in (edits[:6], edits[6:7], edits[7:8], edits[8:]):
        frame(spark, part).coalesce(1).write.mode("append").json(path)
    rows = spark.readStream.schema("event_id long, lang string, title string, second long, user string, is_new boolean").option("maxFilesPerTrigger", 1).json(path).withColumn("time", F.timestamp_seconds("second"))
    base = spark.createDataFrame([("a", h, 10.0) for h in range(first // 3600 - 2, first // 3600 + 3)], "lang string, hour long, baseline double")
    p = Bursts(min_edits=4, min_editors=3, ratio=4.0, new_page_minutes=0)
    assert drained(stateful.stream_bursts(rows, base, p), spark, "append", "bursts").count() == 0
    base = base.withColumn("baseline", F.lit(1.0))
    got = drained(stateful.stream_bursts(rows, base, p), spark, "append", "bursts").collect()
    assert [(r.second, r.n_edits, r.n_editors) for r in got] == [(first + 2, 4, 4)]  # the late one counts, in its place


def test_a_stream_with_late_rows_finds_what_the_batch_finds(spark):
    edits = made_edits(7, n=500)
    last = max(e[3] for e in edits) - 3600
    want = [b for b in plain_bursts(edits, P) if b[2] < last]
    base = spark.read.schema("lang string, hour long, baseline double").parquet(_saved(spark, bursts.wiki_baselines(frame(spark, edits), P)))
    got = drained(stateful.stream_bursts(stream_of(spark, edits, 50), base, P), spark, "append", "bursts")
    assert sorted(tuple(r)[:6] for r in got.collect()) == want and want


def _saved(spark, rows):
    path = scratch(spark, "saved")
    rows.write.parquet(path)
    return path


def test_exact_quantiles_equal_sorting(spark):
    rng = np.random.default_rng(3)
    groups = {"flat": rng.random(3000), "heavy": np.exp(rng.normal(0, 30, 2000)), "tied": np.repeat([1.0, 2.0], 700), "one": np.array([5.0]), "signs": rng.normal(0, 1e300, 500), None: np.array([1.0, 4.0])}
    data = [(g, float(v)) for g, values in groups.items() for v in values] + [("flat", None), ("gone", None), ("nan", math.nan)]
    shares = (0.0, 0.1, 0.5, 0.9, 0.999, 1.0)
    got = {(r.g, r.share): r.quantile for r in quantiles.exact_quantiles(spark.createDataFrame(data, "g string, x double").repartition(7), ["g"], "x", shares, ranges=16).collect()}
    assert set(got) == {(g, p) for g in groups for p in shares}
    for g, values in groups.items():
        for p in shares:
            place = (len(values) - 1) * p
            a, b = np.sort(values)[[math.floor(place), math.ceil(place)]]
            assert math.isclose(got[g, p], a + (b - a) * (place - math.floor(place)), rel_tol=1e-12)
    whole = quantiles.exact_quantiles(spark.createDataFrame([(1.0,), (3.0,)], "x double"), [], "x", (0.5,)).collect()
    assert [(r.share, r.quantile) for r in whole] == [(0.5, 2.0)]
    assert quantiles.exact_quantiles(spark.createDataFrame([], "g string, x double"), ["g"], "x", (0.5,)).count() == 0


def test_a_feed_is_replayed_from_a_moment_or_a_position(spark, tmp_path):
    path = f"file://{tmp_path}/feed"
    rows = spark.createDataFrame([(i, 60 * i) for i in range(300)], "event_id long, timestamp long")
    changes.write_segments(rows, path, ["timestamp"], "timestamp", size=40)
    with open(f"{tmp_path}/feed/{changes.segment_name(300, 18000)}", "w") as f:
        f.write('{"event_id": 300, "timestamp": 18000, "title": 7, "more": 1}\nno json\n[1]\n{"event_id": 303, "timestamp": 18120}\n')
    spark.dataSource.register(changes.ChangeSource)

    def read(**options):
        q = spark.readStream.format("changes").option("path", path).options(**options).load()
        return {r.position: r for r in drained(q, spark, "append", "feed").collect()}

    assert sorted(read()) == [*range(242, 300), 300, 303]
    assert sorted(read(replay_minutes="all")) == [*range(301), 303]
    sizes = []
    q = spark.readStream.format("changes").option("path", path).options(replay_minutes="all", batch_events="70").load().writeStream.option("checkpointLocation", scratch(spark, "log"))
    q = q.foreachBatch(lambda df, _: sizes.append(df.count())).start()
    q.processAllAvailable()
    q.stop()
    assert sizes == [80, 80, 80, 62]
    assert sorted(read(position="290")) == [*range(290, 301), 303]
    found = read(replay_minutes="5")
    assert found[303].event_id == 303 and found[300].title is None


def test_coverage_counts_minutes_gaps_and_languages(spark):
    batches = spark.createDataFrame([(0, 3, 2, 0, 130, [0, 1, 2], ["a"]), (1, 2, 2, 600, 86400 + 600, [10, 1450], ["b"])], "batch long, n_in long, n_kept long, first long, last long, minutes array<long>, languages array<string>")
    r = coverage.coverage(batches).first()
    assert tuple(r) == (5, 4, 87000, 1451, 5, 1446, 1439, "a,b")
    assert coverage.coverage(batches, window_minutes=60).first().minutes == 60
