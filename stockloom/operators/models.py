"""Model fitting on the panel with MLlib: pooled regressors, residual bands, thick tails."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALGORITHMS = ("lightgbm", "xgboost")


def fit_pooled(
    train: DataFrame, features: list[str], label: str, rounds: int = 10, depth: int = 3, seed: int = 7,
    parameters: dict[str, dict] | None = None, held_out: DataFrame | None = None,
) -> dict[str, PipelineModel]:
    """Two tree regressors on the rows with a label; missing features take the median of their column.

    The names of the algorithms are those of the model registry; MLlib's boosted trees and random
    forest stand for them. A feature with no value at all in the training rows is left out.
    ``parameters`` holds rounds and depth by algorithm. Rows of ``held_out`` end the boosting early
    and touch neither medians nor weights.
    """
    rows = train.filter(F.col(label).isNotNull())
    some = rows.agg(*[F.count(f).alias(f) for f in features]).first()
    used = [f for f in features if some[f]]
    ready = [Imputer(strategy="median", inputCols=used, outputCols=[f"_{f}" for f in used]), VectorAssembler(inputCols=[f"_{f}" for f in used], outputCol="_x")]
    ready = Pipeline(stages=ready).fit(rows)
    shared = {"featuresCol": "_x", "labelCol": label, "predictionCol": "score", "seed": seed}
    given = {a: {"rounds": rounds, "depth": depth} | (parameters or {}).get(a, {}) for a in ALGORITHMS}
    boosted, forest = (given[a] for a in ALGORITHMS)
    makers = {"lightgbm": GBTRegressor(maxIter=boosted["rounds"], maxDepth=boosted["depth"], **shared), "xgboost": RandomForestRegressor(numTrees=forest["rounds"], maxDepth=forest["depth"], **shared)}
    prepared = ready.transform(rows).select(label, "_x")
    seen = {a: prepared for a in ALGORITHMS}
    if held_out is not None:
        shown = ready.transform(held_out.filter(F.col(label).isNotNull())).select(label, "_x", F.lit(True).alias("_held_out"))
        seen["lightgbm"] = prepared.withColumn("_held_out", F.lit(False)).unionByName(shown)
        makers["lightgbm"].setValidationIndicatorCol("_held_out")
    return {name: PipelineModel(stages=[*ready.stages, made.fit(seen[name])]) for name, made in makers.items()}


def scored_wide(models: dict[str, PipelineModel], rows: DataFrame, label: str) -> DataFrame:
    """Rows with a label, both scores in one row: ``stock_code, trade_date, ret, score_a, score_b``."""
    out, made = rows.filter(F.col(label).isNotNull()), {}
    for to, name in zip(("score_a", "score_b"), ALGORITHMS):
        out = models[name].transform(out.select(*rows.columns, *made)).withColumnRenamed("score", to)
        made[to] = name
    return out.select("stock_code", "trade_date", F.col(label).alias("ret"), *made)


def scored(models: dict[str, PipelineModel], rows: DataFrame, label: str) -> DataFrame:
    """Long rows of ``algorithm, score`` for rows with a label."""
    keys = ["stock_code", "trade_date", F.col(label).alias("ret")]
    each = [m.transform(rows.filter(F.col(label).isNotNull())).select(*keys, F.lit(a).alias("algorithm"), "score") for a, m in models.items()]
    return reduce(DataFrame.unionByName, each)


def residual_band(fitted: DataFrame, new: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Adds ``p10`` and ``p90``: the score plus residual quantiles of its bin of scores, learnt on ``fitted`` rows.

    Bins are cut at quantiles of the fitted scores, so no window holds a whole key in one task.
    """
    at = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    cuts = fitted.groupBy(*keys).agg(F.percentile_approx("score", at, 10000).alias("_cuts"))
    place = F.size(F.filter("_cuts", lambda c: c <= F.col("score")))
    binned = lambda rows: rows.join(F.broadcast(cuts), keys).withColumn("_bin", place).drop("_cuts")
    band = binned(fitted).groupBy(*keys, "_bin").agg(F.percentile(F.col("ret") - F.col("score"), F.array(F.lit(0.1), F.lit(0.9))).alias("_q"))
    out = binned(new).join(F.broadcast(band), [*keys, "_bin"], "left")
    return out.withColumns({"p10": F.col("score") + F.col("_q")[0], "p90": F.col("score") + F.col("_q")[1]}).drop("_q", "_bin")


def thick_tails(rows: DataFrame, features: list[str], label: str, train_share: int = 8) -> DataFrame:
    """Mean absolute error of a Huber fit and of least squares on clipped targets, on the same split by row hash.

    Missing features take the median of their column in the training rows; a feature without any value there is left out.
    """
    given = rows.filter(F.col(label).isNotNull())
    part = F.pmod(F.xxhash64("stock_code", "trade_date"), F.lit(10)) < train_share
    train, test = given.filter(part), given.filter(~part)
    low, high = train.agg(F.percentile(label, F.array(F.lit(0.01), F.lit(0.99))).alias("q")).first()["q"]
    clipped = train.withColumn(label, F.least(F.greatest(F.col(label), F.lit(low)), F.lit(high)))
    shared = {"featuresCol": "_x", "labelCol": label, "predictionCol": "score"}
    cases = {"huber": (train, LinearRegression(loss="huber", epsilon=1.35, **shared)), "winsorized": (clipped, LinearRegression(**shared))}
    some = train.agg(*[F.count(f).alias(f) for f in features]).first()
    used = [f for f in features if some[f]]
    ready = [Imputer(strategy="median", inputCols=used, outputCols=[f"_{f}" for f in used]), VectorAssembler(inputCols=[f"_{f}" for f in used], outputCol="_x")]
    ready = Pipeline(stages=ready).fit(train)
    found = []
    for name, (own, maker) in cases.items():
        model = PipelineModel(stages=[*ready.stages, maker.fit(ready.transform(own))])
        found.append(model.transform(test).agg(F.lit(name).alias("strategy"), F.avg(F.abs(F.col(label) - F.col("score"))).alias("mae")))
    return reduce(DataFrame.unionByName, found)


def holdout_bounds(axis: DataFrame, gap: int, size: int = 20) -> DataFrame:
    """One row of indices: train before ``train_end``, a purge gap, then ``size`` days; the last ``gap`` days are unused."""
    n = axis.agg(F.count(F.lit(1)).cast("int").alias("n"))
    return n.select((F.col("n") - 2 * gap - size).alias("train_end"), (F.col("n") - gap - size).alias("val_start"), (F.col("n") - gap).alias("val_end"))


def with_roles(panel: DataFrame, axis: DataFrame, bounds: DataFrame) -> DataFrame:
    """Panel rows with ``role`` train or val; rows in the gaps are left out. ``axis`` has one row per day, ``bounds`` one."""
    role = F.when(F.col("idx") < F.col("train_end"), "train").when((F.col("idx") >= F.col("val_start")) & (F.col("idx") < F.col("val_end")), "val")
    days = axis.join(F.broadcast(bounds), F.lit(True)).select("trade_date", role.alias("role")).filter("role IS NOT NULL")
    return panel.join(F.broadcast(days), "trade_date")
