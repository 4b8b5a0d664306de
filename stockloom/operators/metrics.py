"""Scores, confidence, grades and quality metrics per market, horizon, algorithm and fold."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions.columns import correlation, weighted_correlation, weighted_covariance
from stockloom.operators.ordered import before, drawdowns
from stockloom.sources import sinks

KEYS = ("market", "horizon", "algorithm", "fold_index")
#: Standard deviations between the 10 % and 90 % quantiles of a normal distribution.
SPREAD = 2.563
#: Rows that a task counts, on average.
TASK_ROWS = 1 << 19


def ensemble(a: Column, b: Column) -> Column:
    """The weaker score where both agree in sign, else 0."""
    return F.when((a > 0) & (b > 0), F.least(a, b)).when((a < 0) & (b < 0), -F.least(F.abs(a), F.abs(b))).otherwise(F.lit(0.0))


#: Terms of the series below, and where its rest is beyond the precision of doubles.
TERMS, FAR = 80, 7.0


def normal(z: Column) -> Column:
    """P(Z <= z) of a standard normal variable for z >= 0: 1/2 + density(z) * (z + z^3/3 + z^5/(3*5) + ...)."""
    square, series = z * z, F.lit(1.0)
    for k in range(TERMS, 0, -1):
        series = 1.0 + square / (2.0 * k + 1.0) * series
    return F.when(z >= FAR, 1.0).otherwise(0.5 + F.exp(square / -2.0) * z * series / math.sqrt(2 * math.pi))


def normal_sql(z: str) -> str:
    """The same in SQL."""
    series = "1.0"
    for k in range(TERMS, 0, -1):
        series = f"(1.0 + {z} * {z} / {2.0 * k + 1.0} * {series})"
    return f"CASE WHEN {z} >= {FAR} THEN 1.0 ELSE 0.5 + exp({z} * {z} / -2.0) * {z} * {series} / {math.sqrt(2 * math.pi)!r}::DOUBLE END"


def confidence(score: Column, p10: Column, p90: Column, strict: bool = False) -> Column:
    """Normal probability of the score's sign; one half for score 0. Crossing quantiles are swapped.

    Quantiles that do not differ are an error where ``strict``, else they give one half.
    """
    sigma = (F.greatest(p10, p90) - F.least(p10, p90)) / SPREAD
    flat = F.raise_error(F.lit("quantiles do not differ")).cast("double") if strict else F.lit(0.5)
    return F.when(score == 0, F.lit(0.5)).when(sigma <= 0, flat).otherwise(normal(F.try_divide(F.abs(score), sigma)))


def by_algorithm(scores: DataFrame) -> DataFrame:
    """Long rows of both models and their ensemble."""
    return _long(with_models(scores))


def with_models(scores: DataFrame) -> DataFrame:
    """Rows with ``models``, an array of algorithm and score: both models and their ensemble."""
    made = {"lightgbm": F.col("score_a"), "xgboost": F.col("score_b"), "ensemble": ensemble(F.col("score_a"), F.col("score_b"))}
    each = F.array(*[F.struct(F.lit(k).alias("algorithm"), v.alias("score")) for k, v in made.items()])
    return scores.select("market", "horizon", "fold_index", each.alias("models"), "ret", "confidence", "k")


def _long(rows: DataFrame) -> DataFrame:
    return rows.withColumn("m", F.explode("models")).select("market", "horizon", "fold_index", "m.algorithm", "m.score", "ret", "confidence", "k")


def counted(rows: DataFrame, size: int | None = None) -> DataFrame:
    """``n`` rows of each key, score and return. ``size``: the number of rows, where it is known before they are computed.

    Rows are dealt by key and return before they are counted, ``TASK_ROWS`` to a task where their number is known: counts made where
    the rows are read would hold as many scores and returns as a split of the input has. Up to ``spark.shuffle.sort.bypassMergeThreshold``
    tasks Spark deals rows without sorting them; for more it would hold a split's rows in memory, so they are dealt in rounds of so many.
    """
    wide = "models" in rows.columns
    by = ["market", "horizon", "fold_index", "ret", *([] if wide else ["algorithm"])]
    if size is None:
        return _counted(rows, by, wide)
    context = rows.sparkSession.sparkContext
    tasks = max(context.defaultParallelism, -(-size // TASK_ROWS))
    rounds = -(-tasks // max(1, int(context.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))))
    if rounds == 1:
        return _counted(rows, by, wide, tasks)
    # Not the hash that deals rows to tasks: those of a round would meet in a few of its tasks.
    own = F.pmod(F.xxhash64(*by), F.lit(rounds))
    # Written one by one: Spark counts the same partition of all parts of a union in one task.
    each = [sinks.stored(_counted(rows.filter(own == i), by, wide, -(-tasks // rounds)), f"cells-{i}") for i in range(rounds)]
    return reduce(DataFrame.unionByName, each)


def _counted(rows: DataFrame, by: list[str], wide: bool, *tasks: int) -> DataFrame:
    if wide:
        # The names are the same in nearly every row, the scores are not.
        rows = rows.select(*by, F.col("models.algorithm").alias("names"), F.col("models.score").alias("scores")).repartition(*tasks, *by)
        rows = rows.select(*by, F.explode(F.arrays_zip("names", "scores")).alias("m")).select(*by, F.col("m.names").alias("algorithm"), F.col("m.scores").alias("score"))
    else:
        rows = rows.select(*by, "score").repartition(*tasks, *by)
    return rows.groupBy(*KEYS, "score", "ret").agg(F.count(F.lit(1)).alias("n"))


def correlations(rows: DataFrame, size: int | None = None) -> DataFrame:
    """Hit rate, two correlations, precision and Sharpe ratio by key, from counts of each score and return; rows are long or have ``models``.

    Rows are counted in tasks whose number follows ``size``, the number of rows; ranks are sums of counts in ranges of values. So no task holds a whole key.
    Joins name their sides: counts are so small in Parquet that Spark would broadcast them by the size of their files.
    """
    keys = list(KEYS)
    cells = sinks.stored(counted(rows, size), "cells")
    most = 2 * cells.count()
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("of"), F.col(c).alias("value"), F.col("n")) for c in ("score", "ret")]))
    values = cells.select(*keys, each.alias("e")).select(*keys, "e.*").groupBy(*keys, "of", "value").agg(F.sum("n").alias("n"))
    ranked = before(values, [*keys, "of"], "value", "n", most).withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)
    gain = F.signum("score") * F.col("ret")
    mean = lambda c: F.sum(c * F.col("n")) / F.sum(F.when(c.isNotNull(), F.col("n")))
    centre = cells.groupBy(*keys).agg(F.sum("n").alias("_n"), mean(F.col("score")).alias("_score"), mean(F.col("ret")).alias("_ret"), mean(gain).alias("_gain"))
    # One row of each key.
    rows = cells.join(F.broadcast(centre), keys)
    for c in ("score", "ret"):
        own = ranked.filter(F.col("of") == c).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("value").alias("_value"), F.col("rank").alias(f"rank_{c}"))
        same = [F.col(k) == F.col(f"_{k}") for k in keys]
        rows = rows.join(own.hint("merge"), [*same, F.col(c).eqNullSafe(F.col("_value"))]).drop("_value", *[f"_{k}" for k in keys])
    # About their means, so that squares keep their digits.
    at = {"score": F.col("_score"), "ret": F.col("_ret"), "rank_score": (F.col("_n") + 1) / 2, "rank_ret": (F.col("_n") + 1) / 2}
    hit = (F.signum("score") == F.signum("ret")).cast("double")
    rows = rows.withColumns({**{c: F.col(c) - v for c, v in at.items()}, "hit": hit, "called": F.when(F.col("score") != 0, hit), "gain": gain - F.col("_gain")})
    spread = F.sqrt(weighted_covariance("gain", "gain", "n"))
    return rows.groupBy(*keys).agg(
        mean(F.col("hit")).alias("hit_rate"), weighted_correlation("score", "ret", "n").alias("ic"), weighted_correlation("rank_score", "rank_ret", "n").alias("rank_ic"),
        mean(F.col("called")).alias("precision"), F.when(spread < 1e-12, 0.0).otherwise(F.try_divide(F.first("_gain"), spread)).alias("sharpe"),
    )


def calibration(rows: DataFrame) -> DataFrame:
    """Correlation of mean confidence and hit rate over five bins by confidence and ``k``, the first n mod 5 one larger.

    A group of equal confidence that lies in one bin goes there as a whole; only groups across a bound are split in the order of ``k``.
    """
    keys = list(KEYS)
    rows = rows.select(*keys, "confidence", (F.signum("score") == F.signum("ret")).cast("double").alias("hit"), "k")
    sums = [F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"), F.count("hit").alias("known")]
    groups = before(rows.groupBy(*keys, "confidence").agg(*sums), keys, "confidence", "n")
    total = groups.groupBy(*keys).agg(F.sum("n").alias("_n"))
    bins = F.least(F.lit(5), F.col("_n"))
    small, larger = F.floor(F.col("_n") / bins), F.col("_n") % bins

    def tile(at: Column) -> Column:
        return F.when(at < larger * (small + 1), F.floor(at / (small + 1))).otherwise(larger + F.floor((at - larger * (small + 1)) / small))

    groups = groups.join(F.broadcast(total), keys).withColumns({"bin": tile(F.col("before")), "_last": tile(F.col("before") + F.col("n") - 1)})
    groups = sinks.stored(groups, "confidences")
    whole = groups.filter("bin = _last").select(*keys, "bin", "confidence", "n", "hits", "known")
    across = groups.filter("bin <> _last").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("confidence").alias("_confidence"), F.col("before").alias("_start"), "_n")
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    # Four of a key at most.
    split = rows.join(F.broadcast(across), [*same, F.col("confidence").eqNullSafe(F.col("_confidence"))]).select(*rows.columns, "_start", "_n", F.lit(1).alias("_one"))
    split = before(split, [*keys, "confidence"], "k", "_one").withColumn("bin", tile(F.col("_start") + F.col("before")))
    parts = whole.unionByName(split.groupBy(*keys, "bin", "confidence").agg(*sums))
    share = F.sum(F.col("confidence") * F.col("n")) / F.sum(F.when(F.col("confidence").isNotNull(), F.col("n")))
    binned = parts.groupBy(*keys, "bin").agg(share.alias("c"), F.try_divide(F.sum("hits"), F.sum("known")).alias("h"))
    spread = lambda c: F.max(c) - F.min(c) < 1e-12
    return binned.groupBy(*keys).agg(F.when(spread("c") | spread("h"), 0.0).otherwise(F.coalesce(correlation("c", "h"), F.lit(0.0))).alias("calibration"))


def backtest(rows: DataFrame, size: int | None = None) -> DataFrame:
    """Hit rate, two correlations, precision, Sharpe ratio, drawdown and calibration by key; rows are long or have ``models``."""
    given = rows
    if "models" in rows.columns:
        wide, rows = rows, _long(rows)
    else:
        wide = rows.withColumn("models", F.array(F.struct("algorithm", "score")))
    factors = F.transform("models", lambda m: 1 + F.signum(m["score"]) * F.col("ret"))
    wide = wide.select("market", "horizon", "fold_index", F.col("models.algorithm").alias("names"), factors.alias("factors"), "k")
    falls = drawdowns(wide, ["market", "horizon", "fold_index"], "k").withColumnRenamed("name", "algorithm")
    return correlations(given, size).join(falls, [*KEYS]).join(calibration(rows), [*KEYS])


def grade_boundaries(rows: DataFrame, keys: list[str], ratios: dict[str, float]) -> DataFrame:
    """Quantiles of the returns at the cumulative ratios of the ordered grades."""
    if any(r <= 0 for r in ratios.values()) or abs(sum(ratios.values()) - 1) > 1e-9:
        raise ValueError("ratios must be positive and sum to 1")
    values = list(ratios.values())
    cuts = [sum(values[:i]) for i in range(1, len(values))]
    at = F.percentile("ret", F.array(*[F.lit(c) for c in cuts]))
    return rows.groupBy(*keys).agg(at.alias("q")).select(*keys, *[F.col("q")[i].alias(f"b{i + 1}") for i in range(len(cuts))])


def grade(value: Column, cuts: list[Column], grades: list[str]) -> Column:
    """The first grade whose upper boundary is above the value; missing values fall in the last."""
    out = F.lit(grades[-1])
    for cut, name in reversed(list(zip(cuts, grades))):
        out = F.when(value < cut, name).otherwise(out)
    return out


def aggregated(folds: DataFrame) -> DataFrame:
    """Mean, population deviation and their ratio of the folds' rank correlations; none gives zeros."""
    mean, spread = F.avg("rank_ic"), F.stddev_pop("rank_ic")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    ratio = F.when(spread > 0, F.try_divide(mean, spread))
    return folds.groupBy("market", "horizon", "algorithm").agg(zero(mean).alias("mean"), zero(spread).alias("stddev"), zero(ratio).alias("icir"))


def winsorized(rows: DataFrame, keys: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Returns clipped to two quantiles of their key."""
    cuts = rows.groupBy(*keys).agg(F.percentile("ret", F.array(F.lit(low), F.lit(high))).alias("q"))
    return rows.join(F.broadcast(cuts), keys).withColumn("ret", F.least(F.greatest("ret", F.col("q")[0]), F.col("q")[1])).drop("q")
