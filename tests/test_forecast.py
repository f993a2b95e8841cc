"""Monotone scores, calibration on rows that no tree has seen, and the search's and importance's choices."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import forecast

CUT = "2024-02-10 00:00:00"


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = random.Random(3), []
    for i in range(900):
        b = rng.randrange(4)
        label = int(rng.random() < (0.05, 0.2, 0.35, 0.7)[b])
        numbers = {f: rng.random() for f in forecast.NUMERIC} | {"breadth_t": b}
        out.append((f"s{i}", datetime(2024, 1, 1) + timedelta(hours=i), label, rng.choice("abc"), *[float(numbers[f]) if f != "breadth_t" else b for f in forecast.NUMERIC]))
    kinds = ", ".join(f"{f} {'long' if f == 'breadth_t' else 'double'}" for f in forecast.NUMERIC)
    found = spark.createDataFrame(out, f"snapshot_id string, start_hour timestamp_ntz, label int, lead_lang string, {kinds}")
    return found.coalesce(2).persist()


def test_calibration_takes_the_shortest_span_and_no_training_row(rows):
    train, held, days = forecast.calibration_span(rows, CUT)
    assert days == 10 and held.agg(F.sum("label")).first()[0] >= 5
    assert train.agg(F.max("start_hour")).first()[0] < datetime(2024, 1, 31) <= held.agg(F.min("start_hour")).first()[0]
    assert held.agg(F.max("start_hour")).first()[0] < datetime(2024, 2, 10)
    few = rows.withColumn("label", F.when(F.col("start_hour") < F.lit("2024-01-20").cast("timestamp_ntz"), F.col("label")).otherwise(0))
    assert forecast.calibration_span(few, CUT)[2] == 30
    assert forecast.calibration_span(rows.filter("false"), CUT)[2] == 40


def test_scores_never_fall_with_breadth_and_calibration_mends_weights(rows):
    model, fit, steps, days = forecast.calibrated_forecast(rows, CUT, maxIter=4, maxDepth=2)
    assert days == 10 and fit[0] > 0
    one = rows.limit(40).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(3))))
    one = one.withColumns({"of": F.col("snapshot_id"), "snapshot_id": F.concat_ws("#", "snapshot_id", "b"), "breadth_t": F.col("b").cast("long")})
    got = {(r.of, r.b): r.score for r in forecast.monotone_scores(model, one).select("of", "b", "score").collect()}
    assert len(got) == 160 and all(got[i, b] <= got[i, b + 1] for i, b in got if b < 3)
    later = forecast.monotone_scores(model, rows.filter(F.col("start_hour") >= F.lit("2024-02-10").cast("timestamp_ntz")).unionByName(forecast.calibration_span(rows, CUT)[1]))
    raw, platt = (df.agg(F.avg("score"), F.avg("label")).first() for df in (later, forecast.calibrated(later, *fit)))
    assert abs(platt[0] - platt[1]) < abs(raw[0] - raw[1])  # both classes were weighted alike, so raw scores are too high
    stepped = [r.isotonic for r in steps.transform(later).orderBy("score").select("isotonic").collect()]
    assert stepped == sorted(stepped)
    curve = forecast.calibration_curve(later).orderBy("bin").collect()
    assert sum(r.n for r in curve) == later.count() and all(r.bin / 10 <= r.mean_score <= (r.bin + 1) / 10 for r in curve)


def test_importance_finds_what_the_label_hangs_on(rows):
    train, test = forecast.chronological_split(rows, "2024-01-25 00:00:00")
    model = forecast.boosted_trees(train, maxIter=4, maxDepth=2)
    found = {r.feature: r.auc_drop for r in forecast.importance(model, test, (*forecast.NUMERIC, "lead_lang"), repeats=2).collect()}
    assert len(found) == 14 and max(found, key=found.get) == "breadth_t" and found["breadth_t"] > 0.1
    dealt = forecast.shuffled(test, ("views_t", "lead_lang"), 2, 5)
    assert dealt.count() == 4 * test.count()
    kept = dealt.filter("feature = 'views_t' AND repeat = 1")
    assert kept.exceptAll(kept).count() == 0 and sorted(r.views_t for r in kept.collect()) == sorted(r.views_t for r in test.collect())


def test_the_search_ranks_seeded_trials_by_validation(rows):
    train, valid = forecast.chronological_split(rows, "2024-01-25 00:00:00")
    found = forecast.random_search(train, valid, n=3)
    assert sorted(i for i, _, _ in found) == [0, 1, 2] and [v for *_, v in found] == sorted((v for *_, v in found), reverse=True)
    assert [s for _, s, _ in sorted(found)] == forecast.trials(3)
