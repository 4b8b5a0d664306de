"""Stability gates over fold metrics, and the choice of a champion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COMBO = ("market", "horizon", "algorithm")
SHORT, LONG, LEAST_ICIR = 12, 52, 0.10
ORDER = ("lightgbm", "xgboost", "ensemble")


def verdicts(folds: DataFrame) -> DataFrame:
    """The three gates of each combination; too few folds fail a gate."""
    n = F.row_number().over(Window.partitionBy(*COMBO).orderBy(F.desc("fold_index")))
    rows = folds.select(*COMBO, "fold_index", F.coalesce("rank_ic", F.lit(0.0)).alias("rank_ic")).withColumn("n", n)
    last = lambda k, f: F.when(F.count(F.when(F.col("n") <= k, 1)) == k, f(F.when(F.col("n") <= k, F.col("rank_ic"))))
    out = rows.groupBy(*COMBO).agg(
        last(SHORT, F.avg).alias("rolling_mean"), F.avg("rank_ic").alias("overall_mean"), last(LONG, F.avg).alias("long_mean"), last(LONG, F.stddev_pop).alias("long_std")
    )
    icir = F.when(F.col("long_std") == 0, 0.0).otherwise(F.try_divide("long_mean", "long_std"))
    out = out.withColumn("rolling_icir", icir).drop("long_mean", "long_std")
    gates = {"gate1": F.col("rolling_mean") > 0, "gate2": F.col("overall_mean") > 0, "gate3": F.col("rolling_icir") > LEAST_ICIR}
    out = out.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in gates.items()}).withColumn("stabilized", F.expr("gate1 AND gate2 AND gate3"))
    failed = F.array_compact(F.array(*[F.when(~F.col(g), F.lit(g)) for g in gates]))
    return out.withColumn("failed_gates", F.array_join(failed, ","))


def champions(verdict: DataFrame) -> DataFrame:
    """The eligible strategy with the best rolling mean; none prohibits deployment. An ensemble needs both models stable."""
    stable = lambda a: F.coalesce(F.bool_or(F.when(F.col("algorithm") == a, F.col("stabilized"))), F.lit(False))
    pair = verdict.groupBy("market", "horizon").agg(stable("lightgbm").alias("l"), stable("xgboost").alias("x"))
    rows = verdict.join(pair, ["market", "horizon"])
    eligible = F.when(F.col("algorithm") == "lightgbm", F.col("l")).when(F.col("algorithm") == "xgboost", F.col("x")).otherwise(F.col("l") & F.col("x"))
    worst = F.lit(float("-inf"))
    score = F.when(F.col("rolling_mean").isNull() | (F.col("rolling_mean") == 0), worst).otherwise(F.col("rolling_mean"))
    place = F.array_position(F.array(*[F.lit(a) for a in ORDER]), F.col("algorithm"))
    best = F.min_by(F.col("algorithm"), F.when(eligible, F.struct((-score).alias("s"), place.alias("p"))))
    out = rows.groupBy("market", "horizon", "l", "x").agg(best.alias("best"), F.bool_or(eligible).alias("any"))
    champion = F.when(F.col("any"), F.col("best"))
    excluded = F.when((champion == "lightgbm") & ~F.col("x"), "xgboost").when((champion == "xgboost") & ~F.col("l"), "lightgbm")
    return out.select("market", "horizon", champion.alias("champion"), (~F.col("any")).alias("deployment_prohibited"), excluded.alias("excluded_artifact"))


def promotions(challenger: DataFrame, champion: DataFrame, threshold: float = 0.0, keys: tuple[str, ...] = COMBO) -> DataFrame:
    """Challengers that beat the champion of the same combination by more than the threshold."""
    own = champion.select(*keys, F.col("rank_ic").alias("champion_rank_ic"))
    return challenger.join(own, [*keys]).withColumn("promoted", F.col("rank_ic") - F.col("champion_rank_ic") > threshold)
