"""Campaigns of boosted trees: one search per combination, fits in every short fold, champions saved, loaded and challenged.

A combination is a market and a horizon; both algorithms are settings of one kind of trees. The search takes its
trials through rungs: all grow a few trees, the better part goes on. Its history is the first ``initial`` days alone.

Nulls: rows without a label are left out where they would train or be scored, missing features have a bin of their own. A combination whose data
cannot be prepared (no such label, no labelled rows before the first fold) gets a status row with its error and stops no other.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.operators import folds, gates, metrics, models
from stockloom.operators.forests import Forest, Model, Setting, Tree, coded, edges
from stockloom.sources import sinks

#: Bounds of the search.
SPACE = {
    "lightgbm": {"rounds": (20, 200), "rate": (0.01, 0.3), "leaves": (7, 63)},
    "xgboost": {"rounds": (20, 200), "rate": (0.01, 0.3), "depth": (3, 10)},
}
TRIALS, RUNGS, KEEP = 50, (10, 30, 90, 200), 3
STATUS = "market string, horizon int, status string, error string"
Combo = tuple[str, int]


def _halton(i: int, base: int) -> float:
    """The i-th point of a sequence that fills the unit interval evenly, from 1."""
    out, part = 0.0, 1.0
    while i:
        part /= base
        out += part * (i % base)
        i //= base
    return out


def _whole(at: float, low: int, high: int) -> int:
    return min(int(low + at * (high - low + 1)), high)


def trials(algorithm: str, count: int = TRIALS, space: dict = SPACE) -> list[Setting]:
    """Settings spread evenly over the space; rates by their logarithm. Boosting by leaves may be deeper than it has leaves for."""
    out, bounds = [], space[algorithm]
    low, high = (math.log(x) for x in bounds["rate"])
    for i in range(1, count + 1):
        rounds, rate = _whole(_halton(i, 2), *bounds["rounds"]), math.exp(low + _halton(i, 3) * (high - low))
        if algorithm == "lightgbm":
            leaves = _whole(_halton(i, 5), *bounds["leaves"])
            out.append(Setting(rounds, rate, math.ceil(math.log2(leaves)) + 1, leaves, 0.0, 20))
        else:
            depth = _whole(_halton(i, 5), *bounds["depth"])
            out.append(Setting(rounds, rate, depth, 2**depth, 1.0, 1))
    return out


@dataclass
class Prepared:
    """Coded rows of all combinations that have data; ``combos`` by number; cuts of the bins by combination."""

    rows: DataFrame
    combos: dict[int, Combo]
    cuts: dict[int, list[np.ndarray]]
    features: list[str]
    status: list[tuple]


def prepared(panel: DataFrame, axis: DataFrame, combos: Sequence[Combo], features: list[str], initial: int | Sequence[int], name: str = "coded", cuts: dict[int, list[np.ndarray]] | None = None) -> Prepared:
    """One table of coded rows, sorted by day within parts; bins are cut on the days before ``initial`` (one for all or one for each) or given."""
    spark, parts, found, kept, status = panel.sparkSession, [], {}, {}, []
    days = F.broadcast(axis.select("trade_date", F.col("idx").cast("int").alias("day")))
    for number, (market, horizon) in enumerate(combos):
        try:
            own = panel.filter(F.col("market") == market).join(days, "trade_date").select(F.lit(number).alias("combo"), "day", F.col(f"label_D{horizon}").cast("double").alias("y"), "stock_code", "trade_date", *features)
            end = initial if isinstance(initial, int) else initial[number]
            made = (edges(own.filter(F.col("day") < end).filter("y IS NOT NULL"), features) if cuts is None else cuts).get(number)
            if made is None:
                raise ValueError("no labelled rows in the initial history")
            found[number] = made
            parts.append(coded(own, features, {number: made}, sinks.stored_path(spark, f"{name}-{market}-{horizon}")))
            kept[number] = (market, horizon)
            status.append((market, horizon, "success", None))
        except (PySparkException, ValueError, ArithmeticError) as error:
            status.append((market, horizon, "error", f"{type(error).__name__}: {error}"[:500]))
    return Prepared(reduce(DataFrame.unionByName, parts) if parts else None, kept, found, features, status)


def _rank_ics(scores: DataFrame) -> dict[int, float]:
    rows = scores.select(F.lit("").alias("market"), F.lit(0).alias("horizon"), F.lit("").alias("algorithm"), F.col("model").alias("fold_index"), "score", "ret", F.lit(0.5).alias("confidence"), F.struct("trade_date", "stock_code").alias("k"))
    return {r["fold_index"]: r["rank_ic"] for r in metrics.correlations(rows).select("fold_index", "rank_ic").collect()}  # a row for each model


def search(data: Prepared, initial: int, path: str, count: int = TRIALS, rungs: Sequence[int] = RUNGS, keep: int = KEEP, space: dict = SPACE) -> tuple[dict[tuple[int, str], Setting], list[tuple]]:
    """For each combination and algorithm the best setting, and the rungs: ``market, horizon, algorithm, trial, rung, trees, rank_ic, kept``.

    Trials are judged by their rank correlation on the validation part of the initial history; its test part stays
    hidden. After each rung one in ``keep`` goes on, ties to the earlier trial; ``keep`` 1 is an exhaustive search.
    """
    spark, made = data.rows.sparkSession, []
    for number, (_, horizon) in data.combos.items():
        cut = folds.purged_split(spark, initial, horizon).first()
        for algorithm in models.ALGORITHMS:
            made += [Model((number, algorithm, t), number, cut["train_end"], cut["val_start"], cut["val_end"], s) for t, s in enumerate(trials(algorithm, count, space))]
    forest, record, last = Forest(data.rows, made, len(data.features), path), [], {}
    live = list(range(len(made)))
    for rung, trees in enumerate(rungs):
        forest.grow(trees)
        ics = _rank_ics(forest.scores(live))
        last |= {i: ics.get(i) for i in live}
        order = sorted(live, key=lambda i: (-(last[i] if last[i] is not None else -math.inf), made[i].key[2]))
        going = []
        for group in {made[i].key[:2] for i in live}:
            own = [i for i in order if made[i].key[:2] == group]
            best = own[: max(1, math.ceil(len(own) / keep))] if rung < len(rungs) - 1 else own[:1]
            going += best
            record += [(*data.combos[group[0]], group[1], made[i].key[2], rung, len(made[i].trees), None if last[i] is None else float(last[i]), i in best) for i in own]
        for i in set(live) - set(going):
            made[i].done = True
        live = sorted(going)
    return {made[i].key[:2]: made[i].setting for i in live}, record


def fold_models(data: Prepared, cuts: dict[int, list[tuple]], best: dict[tuple[int, str], Setting]) -> list[Model]:
    """A model for each combination, algorithm and fold; ``cuts`` has ``fold_index, train_end, val_start, val_end`` as days by horizon."""
    out = []
    for number, (_, horizon) in data.combos.items():
        out += [Model((number, a, i), number, t, v, z, best[number, a]) for a in models.ALGORITHMS for i, t, v, z in cuts[horizon]]
    return out


def day_cuts(cuts: DataFrame, axis: DataFrame) -> list[tuple]:
    """Folds given by dates as places on the axis; an open end is beyond it."""
    place = {r["trade_date"]: r["idx"] for r in axis.collect()}  # bounded by the calendar, as are the folds
    return [(r["fold_index"], place[r["train_end"]], place[r["val_start"]], place.get(r["val_end"], len(place))) for r in cuts.orderBy("fold_index").collect()]


def walk_forward(data: Prepared, made: list[Model], path: str) -> DataFrame:
    """Scores of all folds: ``market, horizon, fold_index, stock_code, trade_date, ret, score_a, score_b, confidence``.

    The confidence comes from the residual band of the first algorithm on each fold's training rows.
    """
    spark = data.rows.sparkSession
    forest = Forest(data.rows, made, len(data.features), path)
    forest.grow(max((m.setting.rounds for m in made), default=0))
    named = [(i, *data.combos[m.key[0]], m.key[1], m.key[2]) for i, m in enumerate(made)]
    names = spark.createDataFrame(named, "model int, market string, horizon int, algorithm string, fold_index int")
    first = [i for i, m in enumerate(made) if m.key[1] == models.ALGORITHMS[0]]
    scores = sinks.written(forest.scores(), f"{path}/scores")
    known = forest.scores(first, train=True).select("model", "ret", "score")
    banded = models.residual_band(known, scores.join(F.broadcast(names.filter(F.col("algorithm") == models.ALGORITHMS[0]).select("model")), "model"), ["model"])
    own = banded.withColumn("confidence", F.coalesce(metrics.confidence(F.col("score"), F.col("p10"), F.col("p90")), F.lit(0.5)))
    keys = ["market", "horizon", "fold_index", "stock_code", "trade_date"]
    a = own.join(F.broadcast(names), "model").select(*keys, "ret", F.col("score").alias("score_a"), "confidence")
    b = scores.join(F.broadcast(names.filter(F.col("algorithm") == models.ALGORITHMS[1])), "model").select(*keys, F.col("score").alias("score_b"))
    return a.join(b, keys)


def campaign(panel: DataFrame, axis: DataFrame, cuts: DataFrame, combos: Sequence[Combo], features: list[str], initial: int, path: str, count: int = TRIALS, rungs: Sequence[int] = RUNGS, space: dict = SPACE) -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """Fold metrics of all combinations, a status row for each, and the rungs of the search. ``cuts`` has dates by ``horizon, fold_index``."""
    spark = panel.sparkSession
    data = prepared(panel, axis, combos, features, initial)
    status = spark.createDataFrame(data.status, STATUS)
    rung_schema = "market string, horizon int, algorithm string, trial int, rung int, trees int, rank_ic double, kept boolean"
    if not data.combos:
        return None, status, spark.createDataFrame([], rung_schema)
    best, record = search(data, initial, f"{path}/search", count, rungs, space=space)
    at = {h: day_cuts(cuts.filter(F.col("horizon") == h), axis) for h in {h for _, h in data.combos.values()}}
    rows = walk_forward(data, fold_models(data, at, best), f"{path}/folds")
    rows = metrics.backtest(metrics.with_models(rows.withColumn("k", F.struct("trade_date", "stock_code"))))
    return rows, status, spark.createDataFrame(record, rung_schema)


_NODES = "name string, base double, tree int, node int, feature int, bin long, value double"


def save(spark: SparkSession, path: str, named: dict[str, Model], cuts: list[np.ndarray], features: list[str], patience: int | None = None) -> None:
    """Models over one set of bins as tables under a path: nodes of trees, and the bins with their features' names."""
    nodes = []
    for name, m in named.items():
        nodes.append((name, float(m.base), -1, 0, -1, 0, 0.0))  # a model may have no tree
        for t, tree in enumerate(m.trees[: m.best(patience)]):
            nodes += [(name, float(m.base), t, k, int(f), int(b), float(v)) for k, (f, b, v) in enumerate(zip(tree.feature, tree.bin, tree.value))]
    spark.createDataFrame(nodes, _NODES).write.mode("overwrite").parquet(f"{path}/nodes")
    bins = [(i, f, [float(x) for x in c]) for i, (f, c) in enumerate(zip(features, cuts))]
    spark.createDataFrame(bins, "place int, feature string, cuts array<double>").write.mode("overwrite").parquet(f"{path}/bins")


def load(spark: SparkSession, path: str) -> tuple[dict[str, Model], list[np.ndarray], list[str]]:
    """The models that were saved under a path, without windows; a model's nodes are a few hundred per tree."""
    bins = spark.read.parquet(f"{path}/bins").orderBy("place").collect()
    out: dict[str, Model] = {}
    rows = spark.read.parquet(f"{path}/nodes").orderBy("name", "tree", "node").collect()
    for name in dict.fromkeys(r["name"] for r in rows):
        own = [r for r in rows if r["name"] == name]
        m = out[name] = Model((name,), 0, 0, 0, 0, Setting(0), base=own[0]["base"])
        for t in range(1 + max(r["tree"] for r in own)):
            heap = [(r["feature"], r["bin"], r["value"]) for r in own if r["tree"] == t]
            f, b, v = (np.array(x) for x in zip(*heap))
            m.trees.append(Tree(f, b, v))
    return out, [np.array(r["cuts"], float) for r in bins], [r["feature"] for r in bins]


def refits(panel: DataFrame, axis: DataFrame, ends: dict[Combo, int], features: list[str], best: dict[str, Setting], paths: dict[Combo, str]) -> dict[Combo, int]:
    """T6 for several combinations: the given algorithms fitted on all days before each one's end and saved under its path. Returns the rows used.

    All grow together, so there are no more jobs than for one.
    """
    spark, data = panel.sparkSession, prepared(panel, axis, list(ends), features, list(ends.values()), "refit")
    for *_, error in data.status:
        if error:
            raise ValueError(error)
    made = [Model((n, a), n, ends[c], ends[c], ends[c], s) for n, c in data.combos.items() for a, s in best.items()]
    forest = Forest(data.rows, made, len(features), sinks.stored_path(spark, "refit"))
    forest.grow(max(s.rounds for s in best.values()))
    for n, c in data.combos.items():
        save(spark, paths[c], {m.key[1]: m for m in made if m.combo == n}, data.cuts[n], features)
    used = [F.count(F.when((F.col("combo") == n) & (F.col("day") < ends[c]), 1)) for n, c in data.combos.items()]
    return dict(zip(data.combos.values(), data.rows.agg(*used).first()))


def refit(panel: DataFrame, axis: DataFrame, combo: Combo, train_end: int, features: list[str], best: dict[str, Setting], path: str) -> int:
    """T6: the given algorithms fitted on all days before ``train_end`` and saved. Returns the rows used."""
    return refits(panel, axis, {combo: train_end}, features, best, {combo: path})[combo]


def score_saved(panel: DataFrame, axis: DataFrame, combo: Combo, path: str, low: int, high: int) -> DataFrame:
    """T7: ``algorithm, stock_code, trade_date, ret, score`` of the saved models over the labelled rows of some days."""
    spark = panel.sparkSession
    named, cuts, features = load(spark, path)
    data = prepared(panel, axis, [combo], features, 0, "scored", {0: cuts})
    if not data.combos:
        raise ValueError(data.status[0][3])
    made = [replace(m, key=(a,), val_start=low, val_end=high) for a, m in named.items()]
    names = spark.createDataFrame([(i, m.key[0]) for i, m in enumerate(made)], "model int, algorithm string")
    return Forest(data.rows, made, len(features), path).scores().join(F.broadcast(names), "model").drop("model")


@dataclass
class Challenge:
    """Challengers over the holdout of their combinations, grown and ready to be scored."""

    data: Prepared
    forest: Forest
    bounds: dict[int, tuple[int, int, int]]
    patience: int

    def scores(self) -> DataFrame:
        """``market, horizon, algorithm, stock_code, trade_date, ret, score`` of the holdout rows, by the trees up to the least loss."""
        named = [(i, *self.data.combos[m.combo], m.key[1]) for i, m in enumerate(self.forest.models)]
        names = self.data.rows.sparkSession.createDataFrame(named, "model int, market string, horizon int, algorithm string")
        return self.forest.scores(patience=self.patience).join(F.broadcast(names), "model").drop("model")


def challengers(panel: DataFrame, axis: DataFrame, combos: Sequence[Combo], features: list[str], settings: dict[str, Setting], path: str, holdout: int = 20, patience: int = 20) -> Challenge:
    """T8: a model of each combination and algorithm on the days before a purge gap and the holdout.

    The holdout only ends a model's boosting, once ``patience`` trees brought no gain; it touches no weight. All combinations grow together.
    """
    bounds = {h: tuple(models.holdout_bounds(axis, h, holdout).first()) for h in {h for _, h in combos}}
    data = prepared(panel, axis, combos, features, min(b[0] for b in bounds.values()), "challengers")
    if not data.combos:
        raise ValueError(data.status[0][3])
    made = [Model((n, a), n, *bounds[h], s) for n, (_, h) in data.combos.items() for a, s in settings.items()]
    forest = Forest(data.rows, made, len(features), path)
    forest.grow(max(s.rounds for s in settings.values()), patience)
    return Challenge(data, forest, {n: bounds[h] for n, (_, h) in data.combos.items()}, patience)


def holdout_metrics(scores: DataFrame, side: int = 0) -> DataFrame:
    """M11: the metrics of holdout scores, point models only, with confidence one half."""
    rows = scores.select("market", "horizon", "algorithm", F.lit(side).alias("fold_index"), "score", "ret", F.lit(0.5).alias("confidence"), F.struct("trade_date", "stock_code").alias("k"))
    return metrics.backtest(rows)


def gate(challenge: Challenge, panel: DataFrame, axis: DataFrame, champions: dict[Combo, str], path: str, threshold: float = 0.0) -> DataFrame:
    """J10: the challengers against the champions saved under the given paths, on the same holdout rows.

    Rows of ``market, horizon, algorithm`` with both rank correlations and ``promoted``; a combination or algorithm
    without a saved champion is dropped. The challengers are saved under ``path``, a folder for each combination.
    """
    spark, old = panel.sparkSession, []
    for number, combo in challenge.data.combos.items():
        own = {m.key[1]: m for m in challenge.forest.models if m.combo == number}
        save(spark, f"{path}/{combo[0]}-{combo[1]}", own, challenge.data.cuts[number], challenge.data.features, challenge.patience)
        if combo in champions:
            _, low, high = challenge.bounds[number]
            old.append(score_saved(panel, axis, combo, champions[combo], low, high).withColumns({"market": F.lit(combo[0]), "horizon": F.lit(combo[1])}))
    new = holdout_metrics(challenge.scores())
    if not old:
        return gates.promotions(new, new.limit(0), threshold)
    return gates.promotions(new, holdout_metrics(reduce(DataFrame.unionByName, old)), threshold)
