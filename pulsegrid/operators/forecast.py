"""Forecasts from snapshots: splits, target rows, encoding, boosted trees, calibration, baselines and importance."""

from __future__ import annotations

import random
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.robust import logit, sigmoid
from pulsegrid.operators.evaluation import ranking_metrics
from pulsegrid.operators.quantiles import quantile_columns
from pulsegrid.session import scratch

NUMERIC = (
    "breadth_t", "max_surprise_t", "sum_surprise_t", "excess_t", "lead_share_t", "new_langs_last_hour", "hours_since_start", "hour_utc", "weekday",
    "views_t", "views_slope", "peak_views_so_far", "lead_views_share",
)


#: Rows of a block in which a column's values are dealt anew, about.
BLOCK_ROWS = 100_000


def chronological_split(rows: DataFrame, *cuts: str) -> list[DataFrame]:
    """Rows before the first cut, between cuts, and from the last on, by start hour."""
    at = [F.lit(c).cast("timestamp_ntz") for c in cuts]
    start = F.col("start_hour")
    parts = [rows.filter(start < at[0])]
    parts += [rows.filter((start >= a) & (start < z)) for a, z in zip(at, at[1:])]
    return [*parts, rows.filter(start >= at[-1])]


def undecided(snaps: DataFrame, tier_breadth: int) -> DataFrame:
    """Snapshots that haven't reached the tier yet, with the label of whether their event will."""
    return snaps.filter(F.col("breadth_t") < tier_breadth).withColumn("label", (F.col("breadth") >= tier_breadth).cast("int"))


def weighted(rows: DataFrame, label: str = "label") -> DataFrame:
    """Rows with a weight by which both classes count alike."""
    sums = rows.agg(F.avg(label).alias("rate")).withColumn("k", F.lit(1))  # one row
    rows = rows.withColumn("k", F.lit(1)).join(F.broadcast(sums), "k").drop("k")
    share = F.when(F.col(label) == 1, F.col("rate")).otherwise(1 - F.col("rate"))
    return rows.withColumn("weight", F.coalesce(F.try_divide(F.lit(0.5), share), F.lit(1.0))).drop("rate")


def encoders(features: tuple[str, ...] = NUMERIC, categorical: tuple[str, ...] = ("lead_lang",)) -> list:
    """Stages that put numeric and indexed features in one vector; unknown categories are a value of their own, missing numbers
    stay missing."""
    index = [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep", stringOrderType="alphabetAsc") for c in categorical]
    return [*index, VectorAssembler(inputCols=[*features, *(f"{c}_i" for c in categorical)], outputCol="features", handleInvalid="keep")]


def boosted_trees(train: DataFrame, features: tuple[str, ...] = NUMERIC, categorical: tuple[str, ...] = ("lead_lang",), seed: int = 7, **params) -> PipelineModel:
    """Gradient-boosted trees over encoded features, both classes weighted alike."""
    trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", seed=seed, **{"maxIter": 10, "maxDepth": 3, **params})
    return Pipeline(stages=[*encoders(features, categorical), trees]).fit(weighted(train))


def scores(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction", "lead_lang_i")


def monotone_scores(model: PipelineModel, rows: DataFrame, feature: str = "breadth_t", key: str = "snapshot_id") -> DataFrame:
    """Scores that never fall as the feature, a small whole number, grows while the others stay: the largest of the model's scores
    at all its values up to the row's own. (Spark's trees take no monotone constraints.)"""
    lower = rows.select("*", F.explode(F.sequence(F.lit(0), F.col(feature).cast("int"))).alias("_value"))
    found = scores(model, lower.withColumn(feature, F.col("_value").cast(rows.schema[feature].dataType)))
    best = found.groupBy(key).agg(F.max("score").alias("score"))
    return rows.join(best, key)


def calibration_span(rows: DataFrame, cutoff: str, days: tuple[int, ...] = (10, 20, 30, 40), positives: int = 5) -> tuple[DataFrame, DataFrame, int]:
    """(rows to train on, rows to calibrate on, days): what starts in the shortest span before cutoff that has enough positives is
    held out for calibration, training rows start before it."""
    held = widening_calibration(rows, cutoff, days, positives)
    chosen = held.select("window_days").first()  # one row
    n = chosen[0] if chosen else days[-1]
    begin = F.timestamp_add("DAY", F.lit(-n), F.lit(cutoff).cast("timestamp_ntz"))
    return rows.filter(F.col("start_hour") < begin), held.drop("window_days"), n


def by_score(scored: DataFrame) -> DataFrame:
    """(score, n, p): rows and positives of each score; fits take these, as equal scores count alike."""
    return scored.groupBy("score").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("p"))


def _logistic(counts: DataFrame) -> tuple[float, float]:
    """Slope and intercept of a logistic fit on counts (x, n, p): rows and positives of each value."""
    rows = counts.select("x", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("w")), F.struct(F.lit(0.0).alias("label"), (F.col("n") - F.col("p")).alias("w")))).alias("y")).select("x", "y.*")
    rows = VectorAssembler(inputCols=["x"], outputCol="v").transform(rows.filter("w > 0"))
    fit = LogisticRegression(featuresCol="v", labelCol="label", weightCol="w", maxIter=200, tol=1e-12, standardization=False).fit(rows)
    return float(fit.coefficients[0]), float(fit.intercept)


def platt(held: DataFrame) -> tuple[float, float]:
    """Slope and intercept of a logistic fit of held-out labels on the logit of their scores."""
    return _logistic(by_score(held).withColumn("x", logit(F.col("score"))))


def fame(train: DataFrame, column: str = "n_sitelinks") -> tuple[float, float] | None:
    """Slope and intercept of a logistic fit of the label on log1p of how many languages an entity has; none where the rows have one
    label or one value. Equal values meet as counts."""
    counts = train.groupBy(F.log1p(column).alias("x")).agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("p"))
    whole = counts.agg(F.count("*").alias("values"), F.sum("n").alias("n"), F.sum("p").alias("p")).first()
    return _logistic(counts) if whole["values"] > 1 and 0 < whole["p"] < whole["n"] else None


def calibrated(scored: DataFrame, slope: float, intercept: float) -> DataFrame:
    return scored.withColumn("score", sigmoid(slope * logit(F.col("score")) + intercept))


def isotonic(held: DataFrame) -> IsotonicRegressionModel:
    """A step function that never falls, fitted to held-out labels by pooling adjacent violators; scores between steps
    are interpolated. Violators are pooled within ranges of scores first, so only the pools of each range meet."""
    counts = by_score(held).select("score", (F.col("p") / F.col("n")).alias("share"), F.col("n").cast("double").alias("w"))
    return IsotonicRegression(featuresCol="score", labelCol="share", weightCol="w", predictionCol="isotonic").fit(counts)


def calibration_curve(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, observed): mean score and share of positives in bins of equal width, empty ones left out."""
    at = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg("label").alias("observed"))


def calibrated_forecast(rows: DataFrame, cutoff: str, positives: int = 5, **params) -> tuple[PipelineModel, tuple[float, float] | None, IsotonicRegressionModel | None, int]:
    """(trees, Platt's slope and intercept, isotonic steps, days held out): trees fitted on rows before the span that calibration
    takes, both calibrations on monotone scores of the span alone; none where the span has one outcome only."""
    train, held, days = calibration_span(rows, cutoff, positives=positives)
    model = boosted_trees(train, **params)
    if held.select("label").distinct().count() < 2:
        return model, None, None, days
    scored = monotone_scores(model, held)
    return model, platt(scored), isotonic(scored), days


def shuffled(rows: DataFrame, features: tuple[str, ...], repeats: int, seed: int, key: str = "snapshot_id") -> DataFrame:
    """rows once for each feature and repeat, with that feature's values dealt anew: each row takes the value of the next row in
    a hashed order, the last of a block that of its first. A block has about BLOCK_ROWS rows."""
    blocks = max(1, rows.count() // BLOCK_ROWS)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(r).alias("repeat")) for f in features for r in range(repeats)]))
    many = rows.withColumn("_x", each).select("*", "_x.feature", "_x.repeat").drop("_x")
    own = F.coalesce(*[F.when(F.col("feature") == f, F.col(f).cast("string")) for f in features])
    block = F.pmod(F.xxhash64(key, "feature", "repeat", F.lit(seed)), F.lit(blocks))
    order = Window.partitionBy("feature", "repeat", block).orderBy(F.xxhash64(key, "repeat", F.lit(seed + 1)), key)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dealt = many.withColumn("_own", own).withColumn("_new", F.when(F.lead(F.lit(1)).over(order) == 1, F.lead("_own").over(order)).otherwise(F.first("_own").over(whole)))
    return dealt.withColumns({f: F.when(F.col("feature") == f, F.col("_new").cast(rows.schema[f].dataType)).otherwise(F.col(f)) for f in features}).drop("_own", "_new")


def importance(model: PipelineModel, rows: DataFrame, features: tuple[str, ...], repeats: int = 5, seed: int = 5) -> DataFrame:
    """(feature, auc_drop): how much the ROC AUC falls, on average over repeats, when a feature's values are dealt anew. All deals
    are scored in one pass."""
    base = ranking_metrics(scores(model, rows), "score", "label").select(F.coalesce("auc", F.lit(0.0)).alias("base"))
    dealt = ranking_metrics(scores(model, shuffled(rows, features, repeats, seed)), "score", "label", ("feature", "repeat"))
    drop = F.avg(F.col("base") - F.coalesce("auc", F.lit(0.0)))
    return dealt.crossJoin(F.broadcast(base)).groupBy("feature").agg(drop.alias("auc_drop"))  # base is one row


def category_decay(train: DataFrame, rows: DataFrame, by: str, now: str, later: str, least: int = 20) -> DataFrame:
    """rows with decay: what is left by the median ratio of the row's category, or of all where it has few rows."""
    ratio = train.filter(F.col(now) > 0).select(F.col(by), (F.col(later) / F.col(now)).alias("ratio"))
    enough = ratio.groupBy(by).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    own = quantile_columns(ratio, [by], "ratio", {"own": 0.5}).join(enough.select(by), by, "left_semi")
    every = quantile_columns(ratio, [], "ratio", {"every": 0.5}).agg(F.max("every").alias("every")).withColumn("k", F.lit(1))  # one row
    out = rows.join(own, by, "left").withColumn("k", F.lit(1)).join(F.broadcast(every), "k").drop("k")
    return out.withColumn("decay", F.log1p(F.col(now) * F.coalesce("own", "every", F.lit(0.0)))).drop("own", "every")


def latest_open(snaps: DataFrame, last_hour, tier_breadth: int) -> DataFrame:
    """For each event that hasn't reached the tier, its latest snapshot that is known at last_hour."""
    known = snaps.filter((F.col("snapshot_ts") <= last_hour) & (F.col("breadth_t") < tier_breadth))
    top = known.groupBy("event_id").agg(F.max("offset_h").alias("offset_h"))
    return known.join(top, ["event_id", "offset_h"], "left_semi")


def boosted_regression(train: DataFrame, target: str, features: tuple[str, ...] = NUMERIC, categorical: tuple[str, ...] = ("lead_lang",), seed: int = 7, **params) -> PipelineModel:
    """Gradient-boosted trees for a number, in logarithms: predictions are of log1p(target)."""
    trees = GBTRegressor(featuresCol="features", labelCol="y", seed=seed, **{"maxIter": 10, "maxDepth": 3, **params})
    rows = train.withColumn("y", F.log1p(target))
    return Pipeline(stages=[*encoders(features, categorical), trees]).fit(rows)


def trials(n: int, seed: int = 11) -> list[dict]:
    """A seeded list of settings to try."""
    rng = random.Random(seed)
    return [{"maxDepth": rng.randint(2, 5), "maxIter": rng.choice((5, 10, 20)), "stepSize": rng.choice((0.05, 0.1, 0.2)), "subsamplingRate": rng.choice((0.7, 1.0))} for _ in range(n)]


def random_search(train: DataFrame, valid: DataFrame, n: int = 50, seed: int = 11, parallelism: int = 4) -> list[tuple[int, dict, float]]:
    """(trial, setting, average precision on the validation rows), best first. Features are encoded once, and trials are fitted
    side by side; test rows have no part in it."""
    encoder = Pipeline(stages=encoders()).fit(train)
    path = scratch(train.sparkSession, "encoded")
    encoder.transform(weighted(train)).select("features", "label", "weight").write.parquet(f"{path}/train")
    encoder.transform(valid).select("features", "label").write.parquet(f"{path}/valid")
    fit_rows, check_rows = (train.sparkSession.read.parquet(f"{path}/{k}").persist() for k in ("train", "valid"))

    def trial(setting: dict) -> float:
        model = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", seed=7, **setting).fit(fit_rows)
        scored = model.transform(check_rows).select("label", vector_to_array("probability")[1].alias("score"))
        return ranking_metrics(scored, "score", "label").first()["average_precision"] or 0.0

    settings = trials(n, seed)
    with ThreadPool(parallelism) as pool:
        found = pool.map(inheritable_thread_target(train.sparkSession)(trial), settings)
    fit_rows.unpersist()
    check_rows.unpersist()
    return sorted(zip(range(n), settings, found), key=lambda x: (-x[2], x[0]))


def rolling_folds(rows: DataFrame, cuts: list[str]) -> DataFrame:
    """rows with fold and part: fold k trains on all that starts before cut k and tests on what starts before the next."""
    at = [F.lit(c).cast("timestamp_ntz") for c in cuts]
    parts = [F.when(F.col("start_hour") < a, F.struct(F.lit(k).alias("fold"), F.lit("train").alias("part"))).when(F.col("start_hour") < z, F.struct(F.lit(k).alias("fold"), F.lit("test").alias("part"))) for k, (a, z) in enumerate(zip(at, at[1:]), 1)]
    return rows.withColumn("f", F.explode(F.array_compact(F.array(*parts)))).select(*rows.columns, "f.fold", "f.part")


def assembled(parts: list[DataFrame], now: str, label_days: int = 3) -> DataFrame:
    """Training rows of several parts by the columns that all have; an event counts once, in the first part that has it, and only if
    its labels are known: it started label_days before now."""
    common = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
    out = None
    for i, p in enumerate(parts):
        own = p.select(common).withColumn("part", F.lit(i))
        out = own if out is None else out.unionByName(own)
    known = out.filter(F.col("start_hour") <= F.timestamp_add("DAY", F.lit(-label_days), F.lit(now).cast("timestamp_ntz")))
    first = known.groupBy("snapshot_id").agg(F.min("part").alias("part"))
    return known.join(first, ["snapshot_id", "part"], "left_semi")


def widening_calibration(scored: DataFrame, ends: str, days: tuple[int, ...] = (10, 20, 30, 40), positives: int = 5) -> DataFrame:
    """The rows of the shortest window before ends that has enough positives; of the longest where none has."""
    end = F.lit(ends).cast("timestamp_ntz")
    since = lambda d: F.timestamp_add("DAY", F.lit(-d), end)
    before = scored.filter(F.col("start_hour") < end)
    counts = before.agg(*[F.count_if((F.col("start_hour") >= since(d)) & (F.col("label") == 1)).alias(f"d{d}") for d in days]).first()  # one row
    chosen = next((d for d in days if counts[f"d{d}"] >= positives), days[-1])
    return before.filter(F.col("start_hour") >= since(chosen)).withColumn("window_days", F.lit(chosen))


def examples(scored: DataFrame, target: str) -> DataFrame:
    """(kind, snapshot_id): the surest hit, the surest false alarm, the worst miss, the call nearest one half, the largest target."""
    best = lambda when, *order: F.min(F.when(when, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], "snapshot_id")))["snapshot_id"]
    hit, yes = F.col("label") == 1, F.lit(True)
    picks = {
        "top_hit": best(hit, -F.col("score")), "false_alarm": best(~hit, -F.col("score")), "worst_miss": best(hit, F.col("score")),
        "middle": best(yes, F.abs(F.col("score") - 0.5)), "largest": best(yes, -F.col(target)),
    }
    row = scored.agg(*[c.alias(k) for k, c in picks.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("snapshot_id")) for k in picks])).alias("x")).select("x.*").filter("snapshot_id IS NOT NULL")


def regression_metrics(rows: DataFrame, predicted: str, target: str) -> DataFrame:
    """Mean absolute error of log1p, and the median of |exp(error) - 1|."""
    error = F.abs(F.log1p(predicted) - F.log1p(target))
    return rows.agg(F.count("*").alias("n"), F.avg(error).alias("mae_log"), F.percentile_approx(F.expm1(error), 0.5, 10_000).alias("middle_ratio"))


def lift(rows: DataFrame, score: str, label: str, share: float = 0.1) -> DataFrame:
    """How much more often the label holds in the best share of rows by score than in all; ties at the limit are all taken. Scores meet as
    counts by value."""
    counts = rows.groupBy(score).agg(F.count("*").alias("n"), F.sum(label).alias("p"))
    limit = quantile_columns(rows, [], score, {"limit": 1 - share}).agg(F.max("limit").alias("limit")).withColumn("k", F.lit(1))  # one row
    marked = counts.withColumn("k", F.lit(1)).join(F.broadcast(limit), "k").withColumn("top", F.col(score) >= F.col("limit"))
    top = lambda c: F.sum(F.when(F.col("top"), F.col(c)))
    return marked.agg(top("n").alias("n_top"), (top("p") / top("n") / (F.sum("p") / F.sum("n"))).alias("lift"))
