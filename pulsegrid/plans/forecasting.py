"""Forecast rows, baselines and boosted trees over snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import forecast, snapshots
from pulsegrid.plans import base as b
from pulsegrid.plans.evaluation import _EV, _SNAPS
from pulsegrid.plans.registry import query
from pulsegrid.plans.selections import wide
from pulsegrid.session import scratch
from pulsegrid.sources import canonical

CUT = "2024-01-16 00:00:00"


def _snaps(spark, sf_dir):
    return snapshots.snapshots(wide(spark, sf_dir), b.loud(spark, sf_dir), 1.2)


_BASE = _EV + "," + _SNAPS + f""", rows AS (SELECT s.event_id, s.k, e.start_hour, e.breadth, coalesce(a.breadth_t, 0) AS breadth_t, e.lead_lang, coalesce(now, 0) AS now FROM snaps s JOIN ev e USING (event_id) LEFT JOIN ag a USING (event_id, k))"""


@query("m1_chronological_split", _BASE + f"SELECT start_hour < TIMESTAMP '{CUT}' AS is_train, count(*) AS n FROM rows GROUP BY ALL")
def m1(spark, sf_dir):
    train, test = forecast.chronological_split(_snaps(spark, sf_dir), CUT)
    count = lambda df, flag: df.agg(F.count("*").alias("n")).select(F.lit(flag).alias("is_train"), "n").filter("n > 0")
    return count(train, True).union(count(test, False))


@query("m2_target_rows", _BASE + "SELECT event_id || '#' || k AS snapshot_id, (breadth >= 4)::INT AS label FROM rows WHERE breadth_t < 4")
def m2(spark, sf_dir):
    return forecast.undecided(_snaps(spark, sf_dir), 4).select("snapshot_id", "label")


@query("m8_baselines", _BASE + f""", t AS (SELECT *, (breadth >= 4)::INT AS y, start_hour < TIMESTAMP '{CUT}' AS tr FROM rows WHERE breadth_t < 4)
SELECT round((SELECT avg(y) FROM t WHERE tr), 6) AS base_rate, count(*) FILTER (WHERE breadth_t >= 3) AS rule_calls, count(*) FILTER (WHERE breadth_t >= 3 AND y = 1) AS rule_hits, CAST(coalesce(sum(y), 0) AS BIGINT) AS positives FROM t WHERE NOT tr""")
def m8(spark, sf_dir):
    train, test = forecast.chronological_split(forecast.undecided(_snaps(spark, sf_dir), 4), CUT)
    rule = F.col("breadth_t") >= 3
    sums = test.agg(F.count_if(rule).alias("rule_calls"), F.count_if(rule & (F.col("label") == 1)).alias("rule_hits"), F.coalesce(F.sum("label"), F.lit(0)).alias("positives")).withColumn("k", F.lit(1))
    rate = train.agg(F.round(F.avg("label"), b.R).alias("base_rate")).withColumn("k", F.lit(1))
    return rate.join(sums, "k").drop("k")


@query("m8_category_decay", _BASE + """, nx AS (SELECT s.event_id, s.k, coalesce(sum(ex), 0) AS later FROM snaps s LEFT JOIN (SELECT x.* FROM x JOIN known USING (event_id, lang, title)) y ON y.event_id = s.event_id AND y.h > s.t AND y.h <= s.t + 24 GROUP BY ALL),
f AS (SELECT * FROM rows JOIN nx USING (event_id, k)), q AS (SELECT lead_lang, median(later / now) AS own FROM f WHERE now > 0 GROUP BY lead_lang HAVING count(*) >= 5)
SELECT event_id || '#' || k AS snapshot_id, round(ln(1 + now * coalesce(own, (SELECT median(later / now) FROM f WHERE now > 0), 0)), 6) AS decay FROM f LEFT JOIN q USING (lead_lang)""")
def m8_decay(spark, sf_dir):
    snaps = _snaps(spark, sf_dir)
    later = snapshots.targets(snaps, wide(spark, sf_dir), b.loud(spark, sf_dir), 1.2).select("snapshot_id", "excess_next24")
    path = scratch(spark, "decay")
    snaps.join(later, "snapshot_id").write.parquet(path)
    rows = spark.read.parquet(path)
    out = forecast.category_decay(rows, rows, "lead_lang", "excess_hour_t", "excess_next24", least=5)
    return out.select("snapshot_id", F.round("decay", b.R).alias("decay"))


@query("m11_open_events", _BASE + "SELECT event_id, max(k) AS offset_h FROM rows WHERE breadth_t < 4 AND start_hour + to_hours((SELECT t FROM snaps s WHERE s.event_id = rows.event_id AND s.k = rows.k)::INT) <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY event_id")
def m11(spark, sf_dir):
    rows = forecast.latest_open(_snaps(spark, sf_dir), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), 4)
    return rows.select("event_id", "offset_h")


@query("m4_boosted_trees")
def m4(spark, sf_dir):
    """Scores of the snapshots from the cutoff on, by trees fitted on the earliest ones: monotone in breadth, and calibrated in two ways
    on the span between, which no tree has seen. Rows only: the fit has no SQL twin."""
    path = scratch(spark, "snapshots")
    _snaps(spark, sf_dir).write.parquet(path)
    rows = forecast.undecided(spark.read.parquet(path), 4)
    train, _, _ = forecast.calibration_span(rows, CUT)
    later = rows.filter(F.col("start_hour") >= F.lit(CUT).cast("timestamp_ntz"))
    none = F.lit(None).cast("double")
    if train.select("label").distinct().count() < 2:
        return later.select("snapshot_id", "label", none.alias("score"), none.alias("platt"), none.alias("isotonic"))
    model, fit, steps, _ = forecast.calibrated_forecast(rows, CUT)
    scored = forecast.monotone_scores(model, later)
    if fit is None:
        return scored.select("snapshot_id", "label", F.round("score", b.R).alias("score"), none.alias("platt"), none.alias("isotonic"))
    platt = forecast.calibrated(scored, *fit).select("snapshot_id", F.col("score").alias("platt"))
    out = steps.transform(scored).join(platt, "snapshot_id")
    return out.select("snapshot_id", "label", *[F.round(c, b.R).alias(c) for c in ("score", "platt", "isotonic")])


FOLDS = ["2024-01-08", "2024-01-13", "2024-01-18", "2024-01-23", "2024-01-30"]


@query("m10_rolling_folds", _BASE + ", c AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, TIMESTAMP '{a}', TIMESTAMP '{z}')" for k, (a, z) in enumerate(zip(FOLDS, FOLDS[1:]), 1)) + ") v(fold, a, z)) SELECT fold, CASE WHEN start_hour < a THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM rows JOIN c ON start_hour < z GROUP BY ALL")
def m10(spark, sf_dir):
    return forecast.rolling_folds(_snaps(spark, sf_dir), FOLDS).groupBy("fold", "part").agg(F.count("*").alias("n"))


@query("m12_training_set", _BASE + """, p AS (SELECT event_id || '#' || k AS snapshot_id, start_hour, 0 AS part FROM rows WHERE start_hour < TIMESTAMP '2024-01-20' UNION ALL SELECT event_id || '#' || k, start_hour, 1 FROM rows WHERE start_hour >= TIMESTAMP '2024-01-12')
SELECT snapshot_id, min(part)::INT AS part FROM p WHERE start_hour <= TIMESTAMP '2024-01-25' GROUP BY snapshot_id""")
def m12(spark, sf_dir):
    """A batch part with a column more, and a weekly part that overlaps it."""
    snaps = _snaps(spark, sf_dir)
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    batch = snaps.filter(F.col("start_hour") < at("2024-01-20")).withColumn("extra", F.lit(1))
    weekly = snaps.filter(F.col("start_hour") >= at("2024-01-12"))
    return forecast.assembled([batch, weekly], "2024-01-28").select("snapshot_id", "part")


_SCORED = _BASE + ", sc AS (SELECT event_id || '#' || k AS snapshot_id, start_hour, (breadth >= 4)::INT AS label, round(breadth_t / 8.0 + k / 16.0, 6)::DOUBLE AS score, now FROM rows WHERE breadth_t < 4)"


def _ruled(spark, sf_dir):
    """Undecided snapshots with a score by rule, so that what follows has a twin."""
    rows = forecast.undecided(_snaps(spark, sf_dir), 4)
    return rows.withColumn("score", F.round(F.col("breadth_t") / 8.0 + F.col("offset_h") / 16.0, 6))


@query("m14_examples", _SCORED + """ SELECT kind, snapshot_id FROM (SELECT 'top_hit' AS kind, (SELECT snapshot_id FROM sc WHERE label = 1 ORDER BY score DESC, snapshot_id LIMIT 1) AS snapshot_id UNION ALL SELECT 'false_alarm', (SELECT snapshot_id FROM sc WHERE label = 0 ORDER BY score DESC, snapshot_id LIMIT 1)
UNION ALL SELECT 'worst_miss', (SELECT snapshot_id FROM sc WHERE label = 1 ORDER BY score, snapshot_id LIMIT 1) UNION ALL SELECT 'middle', (SELECT snapshot_id FROM sc ORDER BY abs(score - 0.5), snapshot_id LIMIT 1)
UNION ALL SELECT 'largest', (SELECT snapshot_id FROM sc ORDER BY now DESC, snapshot_id LIMIT 1)) WHERE snapshot_id IS NOT NULL""")
def m14(spark, sf_dir):
    return forecast.examples(_ruled(spark, sf_dir), "excess_hour_t")


@query("m6_calibration_window", _SCORED + """, w AS (SELECT d, count(*) FILTER (WHERE label = 1) AS p FROM (VALUES (10), (20), (30), (40)) v(d) LEFT JOIN sc ON start_hour < TIMESTAMP '2024-01-26' AND start_hour >= TIMESTAMP '2024-01-26' - to_days(d) GROUP BY d)
SELECT coalesce((SELECT min(d) FROM w WHERE p >= 5), 40)::INT AS window_days, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives FROM sc WHERE start_hour < TIMESTAMP '2024-01-26' AND start_hour >= TIMESTAMP '2024-01-26' - to_days(coalesce((SELECT min(d) FROM w WHERE p >= 5), 40)) HAVING count(*) > 0""")
def m6(spark, sf_dir):
    rows = forecast.widening_calibration(_ruled(spark, sf_dir), "2024-01-26 00:00:00")
    return rows.groupBy("window_days").agg(F.count("*").alias("n"), F.sum("label").alias("positives"))


_NEWTON = """nt(it, a, b) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT it + 1, a + (g1 * h00 - g0 * h01) / (h00 * h11 - h01 * h01), b + (g0 * h11 - g1 * h01) / (h00 * h11 - h01 * h01) FROM (
  SELECT it, a, b, sum((p - n * q) * x) AS g1, sum(p - n * q) AS g0, sum(n * q * (1 - q) * x * x) AS h11, sum(n * q * (1 - q) * x) AS h01, sum(n * q * (1 - q)) AS h00
  FROM (SELECT nt.*, pts.*, 1 / (1 + exp(-(a * x + b))) AS q FROM nt, pts WHERE it < 25) GROUP BY it, a, b) WHERE h00 * h11 - h01 * h01 > 1e-12)
SELECT round(a, 3) AS slope, round(b, 3) AS intercept FROM nt WHERE it = 25"""
_HELD = _SCORED + """, w AS (SELECT d, count(*) FILTER (WHERE label = 1) AS p FROM (VALUES (10), (20), (30), (40)) v(d) LEFT JOIN sc ON start_hour < TIMESTAMP '2024-01-26' AND start_hour >= TIMESTAMP '2024-01-26' - to_days(d) GROUP BY d),
held AS (SELECT score, count(*) AS n, sum(label) AS p FROM sc WHERE start_hour < TIMESTAMP '2024-01-26' AND start_hour >= TIMESTAMP '2024-01-26' - to_days(coalesce((SELECT min(d) FROM w WHERE p >= 5), 40)) GROUP BY score)"""


def _held(spark, sf_dir):
    return forecast.calibration_span(_ruled(spark, sf_dir), "2024-01-26 00:00:00")[1]


@query("m6_isotonic", _HELD + """, spans AS (SELECT a.score AS lo, z.score AS hi, sum(m.p) / sum(m.n) AS share FROM held a JOIN held z ON z.score >= a.score JOIN held m ON m.score BETWEEN a.score AND z.score GROUP BY ALL)
SELECT h.score, h.n, round((SELECT max(low) FROM (SELECT lo, min(share) AS low FROM spans WHERE lo <= h.score AND hi >= h.score GROUP BY lo)), 6) AS isotonic FROM held h""")
def m6_isotonic(spark, sf_dir):
    """What pooling gives each score of the held-out span; the twin is its max-min form: the largest, over spans that begin at or
    before a score, of the least mean of those that end at or after it."""
    held = _held(spark, sf_dir)
    counts = forecast.by_score(held)
    if not counts.take(1):
        return counts.select("score", "n", F.lit(None).cast("double").alias("isotonic"))
    return forecast.isotonic(held).transform(counts).select("score", "n", F.round("isotonic", b.R).alias("isotonic"))


@query("m6_platt", "WITH RECURSIVE " + _HELD.strip().removeprefix("WITH") + """, pts AS (SELECT ln(greatest(least(score, 1 - 1e-6), 1e-6) / (1 - greatest(least(score, 1 - 1e-6), 1e-6))) AS x, n, p FROM held),
""" + _NEWTON)
def m6_platt(spark, sf_dir):
    """The logistic fit on the held-out span; the twin takes Newton steps. No row where the span has one outcome or one score."""
    held = _held(spark, sf_dir)
    kinds = held.agg(F.countDistinct("label"), F.countDistinct("score")).first()
    fit = [forecast.platt(held)] if min(kinds) > 1 else []
    return spark.createDataFrame([(round(a, 3), round(c, 3)) for a, c in fit], "slope double, intercept double")


_DIMS = """dims AS (SELECT qid, CASE WHEN qid % 3 = 0 THEN 'human' ELSE 'place' END AS entity_class, count(*) + 4 * qid AS n_languages FROM links WHERE qid <> 5 GROUP BY qid)"""


def _dims(spark, sf_dir):
    """Entities' classes and languages; one entity has none."""
    links = canonical.sitelinks(spark, sf_dir).filter("qid <> 5").groupBy("qid").agg(F.count("*").alias("n"))
    return links.select("qid", F.when(F.col("qid") % 3 == 0, "human").otherwise("place").alias("entity_class"), (F.col("n") + 4 * F.col("qid")).alias("n_languages"))


@query("d20_snapshot_dims", _BASE + "," + _DIMS + " SELECT event_id || '#' || k AS snapshot_id, coalesce(entity_class, 'other') AS entity_class, coalesce(n_languages, 0) AS n_sitelinks FROM rows JOIN ev USING (event_id) LEFT JOIN dims USING (qid)")
def d20_dims(spark, sf_dir):
    return snapshots.with_dims(_snaps(spark, sf_dir), _dims(spark, sf_dir)).select("snapshot_id", "entity_class", "n_sitelinks")


@query("m8_sitelinks_logistic", "WITH RECURSIVE " + _BASE.strip().removeprefix("WITH") + "," + _DIMS + f""", pts AS (SELECT ln(1 + coalesce(n_languages, 0)) AS x, count(*) AS n, count(*) FILTER (WHERE rows.breadth >= 4) AS p FROM rows JOIN ev USING (event_id) LEFT JOIN dims USING (qid) WHERE breadth_t < 4 AND rows.start_hour < TIMESTAMP '{CUT}' GROUP BY ALL),
""" + _NEWTON)
def m8_sitelinks(spark, sf_dir):
    """How far fame alone tells: the baseline that takes only how many languages an entity has."""
    rows = snapshots.with_dims(forecast.undecided(_snaps(spark, sf_dir), 4), _dims(spark, sf_dir))
    fit = forecast.fame(forecast.chronological_split(rows, CUT)[0])
    return spark.createDataFrame([tuple(round(x, 3) for x in fit)] if fit else [], "slope double, intercept double")


@query("m7_calibration_curve", _SCORED + " SELECT least(floor(score * 10), 9)::INT AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS observed FROM sc GROUP BY ALL")
def m7_curve(spark, sf_dir):
    rows = forecast.calibration_curve(_ruled(spark, sf_dir))
    return rows.withColumns({c: F.round(c, b.R) for c in ("mean_score", "observed")})


@query("m7_lift", """WITH s AS (SELECT round(n_chars / (n_chars + 2000.0), 3)::DOUBLE AS score, quality AS y FROM labels JOIN documents USING (doc_id)), l AS (SELECT quantile_cont(score, 0.9) AS q FROM s)
SELECT count(*) FILTER (WHERE score >= q)::BIGINT AS n_top, round(avg(y) FILTER (WHERE score >= q) / avg(y), 6) AS lift FROM s, l""")
def m7_lift(spark, sf_dir):
    from pulsegrid.session import table

    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    rows = rows.select(F.round(F.col("n_chars") / (F.col("n_chars") + 2000.0), 3).alias("score"), F.col("quality").alias("y"))
    return forecast.lift(rows, "score", "y").select("n_top", F.round("lift", b.R).alias("lift"))


@query("m7_regression_metrics", "SELECT count(*) AS n, round(avg(abs(ln(1 + o_totalprice) - ln(1 + o_custkey))), 6) AS mae_log FROM orders")
def m7_regression(spark, sf_dir):
    from pulsegrid.session import table

    return forecast.regression_metrics(table(spark, sf_dir, "orders"), "o_totalprice", "o_custkey").select("n", F.round("mae_log", b.R).alias("mae_log"))


def _parts(spark, sf_dir):
    """Undecided snapshots, read back from files: train and test rows, and whether the train rows have both labels."""
    path = scratch(spark, "snapshots")
    _snaps(spark, sf_dir).write.parquet(path)
    rows = forecast.undecided(spark.read.parquet(path), 4)
    train, test = forecast.chronological_split(rows, CUT)
    return rows, train, test, train.select("label").distinct().count() == 2


@query("m5_random_search")
def m5(spark, sf_dir):
    """50 seeded trials, chosen by average precision on a span between training and test rows, best first; the fits have no SQL
    twin."""
    _, train, _, fit = _parts(spark, sf_dir)
    before, valid = forecast.chronological_split(train, "2024-01-11 00:00:00")
    found = forecast.random_search(before, valid) if fit and before.select("label").distinct().count() == 2 else []
    return spark.createDataFrame([(k, i, str(sorted(s.items())), round(float(v), 6)) for k, (i, s, v) in enumerate(found, 1)], "rank int, trial int, setting string, average_precision double")


@query("m9_importance")
def m9(spark, sf_dir):
    """Every feature, five deals each."""
    _, train, test, fit = _parts(spark, sf_dir)
    if not fit:
        return spark.createDataFrame([], "feature string, auc_drop double")
    found = forecast.importance(forecast.boosted_trees(train), test, (*forecast.NUMERIC, "lead_lang"))
    return found.withColumn("auc_drop", F.round("auc_drop", b.R))


@query("m13_sensitivity")
def m13(spark, sf_dir):
    """The ranking with all features and without those that could leak."""
    _, train, test, fit = _parts(spark, sf_dir)
    safe = tuple(f for f in forecast.NUMERIC if f not in ("peak_views_so_far", "lead_views_share"))
    found = [(name, forecast.ranking_metrics(forecast.scores(forecast.boosted_trees(train, features), test), "score", "label").first()["auc"]) for name, features in (("all", forecast.NUMERIC), ("safe", safe))] if fit else []
    return spark.createDataFrame([(n, None if a is None else round(float(a), 6)) for n, a in found], "features string, auc double")


@query("m4_boosted_regression")
def m4_regression(spark, sf_dir):
    rows, train, _, fit = _parts(spark, sf_dir)
    if not fit:
        return rows.select("snapshot_id", F.lit(None).cast("double").alias("predicted"))
    model = forecast.boosted_regression(train, "excess_t")
    return model.transform(rows).select("snapshot_id", F.round(F.expm1("prediction"), b.R).alias("predicted"))


@query("m11_scored_open_events")
def m11_scored(spark, sf_dir):
    """Scores of the events that are open at an hour, each at its latest snapshot."""
    rows, train, _, fit = _parts(spark, sf_dir)
    open_rows = forecast.latest_open(rows, F.lit("2024-01-24 00:00:00").cast("timestamp_ntz"), 4)
    if not fit:
        return open_rows.select("event_id", "offset_h", F.lit(None).cast("double").alias("score"))
    return forecast.scores(forecast.boosted_trees(train), open_rows).select("event_id", "offset_h", F.round("score", b.R).alias("score"))
