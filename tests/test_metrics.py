"""Fold metrics from counts and ranges against plain loops, on ties, nulls, signs of any kind and one large key."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.operators import metrics, ordered

SCHEMA = "market string, horizon int, algorithm string, fold_index int, score double, ret double, confidence double, k int"


def _rows(seed, n, spread):
    r = np.random.default_rng(seed)
    score, ret = r.integers(-3, 4, n) / 10, r.normal(0, spread, n).round(2)
    confidence = r.integers(0, 4, n) / 4
    return [("m", 20, "a", 1, float(s), float(x), float(c), int(k)) for s, x, c, k in zip(score, ret, confidence, r.permutation(n))]


def _ranks(v):
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


@pytest.mark.parametrize("n, spread", [(1, 0.1), (7, 0.1), (400, 0.1), (400, 1.5)])
def test_backtest_equals_plain_loops(spark, n, spread):
    rows = _rows(n, n, spread)
    got = metrics.backtest(spark.createDataFrame(rows, SCHEMA)).first()
    score, ret, confidence = (np.array([x[i] for x in rows]) for i in (4, 5, 6))
    k = np.array([x[7] for x in rows])
    hit, gain = (np.sign(score) == np.sign(ret)).astype(float), np.sign(score) * ret
    assert got["hit_rate"] == pytest.approx(hit.mean())
    if n > 2:
        assert got["ic"] == pytest.approx(np.corrcoef(score, ret)[0, 1])
        assert got["rank_ic"] == pytest.approx(np.corrcoef(_ranks(score), _ranks(ret))[0, 1])
        assert got["precision"] == pytest.approx(hit[score != 0].mean()) and got["sharpe"] == pytest.approx(gain.mean() / gain.std())
        parts = np.array_split(np.lexsort((k, confidence)), 5)
        c, h = np.array([confidence[p].mean() for p in parts]), np.array([hit[p].mean() for p in parts])
        flat = np.ptp(c) < 1e-12 or np.ptp(h) < 1e-12
        assert got["calibration"] == pytest.approx(0 if flat else np.corrcoef(c, h)[0, 1])
    # Losses beyond the whole (spread 1.5) turn the product's sign.
    equity = np.cumprod(1 + gain[np.argsort(k)])
    peak = np.maximum.accumulate(equity)
    falls = [(e - p) / p for e, p in zip(equity, peak) if p != 0]
    assert got["max_drawdown"] == pytest.approx(abs(min(falls)))


def test_rows_without_a_return_and_two_names(spark):
    rows = [("m", 20, "a", 1, 1.0, r, 0.5, i) for i, r in enumerate([None, 0.5, None, -0.5])] + [("m", 20, "b", 1, 1.0, r, 0.5, i) for i, r in enumerate([-1.0, 0.5])]
    got = {r["algorithm"]: r["max_drawdown"] for r in metrics.backtest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"a": pytest.approx(0.5), "b": None}


def test_constant_scores_have_no_correlation(spark):
    rows = [("m", 20, "a", 1, 0.1, x / 7, 0.5, x) for x in range(50)]
    got = metrics.correlations(spark.createDataFrame(rows, SCHEMA)).first()
    assert got["ic"] is None and got["rank_ic"] is None and got["hit_rate"] == pytest.approx(0.98)


def test_no_window_holds_the_rows_of_a_key(spark):
    made = metrics.correlations(spark.createDataFrame(_rows(1, 300, 0.1), SCHEMA))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"Window \[.*", plan)
    # Windows run within ranges, or over the sums of ranges.
    assert windows and all("block" in w for w in windows) and "rank(" not in plan


def test_a_large_key_is_summed_in_many_ranges(spark):
    rows = spark.range(2000).select(F.lit("a").alias("g"), F.col("id").alias("v"), (F.col("id") % 3).alias("w"))
    got = ordered.before(rows, ["g"], "v", "w")
    want, total = {}, 0
    for v in range(2000):
        want[v], total = total, total + v % 3
    assert {r["v"]: r["before"] for r in got.collect()} == want and math.isfinite(total)


def test_rows_are_counted_in_tasks_that_follow_their_number(spark, monkeypatch):
    monkeypatch.setattr(metrics, "TASK_ROWS", 100)
    rows = spark.createDataFrame(_rows(3, 2000, 0.1), SCHEMA).repartition(1)
    wide = rows.withColumn("models", F.array(F.struct("algorithm", "score")))
    want = {tuple(r) for r in rows.groupBy(*metrics.KEYS, "score", "ret").count().collect()}
    for given in (rows, wide):
        made = metrics.counted(given, 2000)
        assert {tuple(r) for r in made.collect()} == want and made.rdd.getNumPartitions() == 20
        # Nothing is counted before the rows are dealt.
        plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert "HashAggregate" not in plan.split("Exchange hashpartitioning")[1] and plan.count("Exchange hashpartitioning") == 1


def test_many_rows_are_dealt_in_rounds_that_need_no_sort(spark, monkeypatch):
    monkeypatch.setattr(metrics, "TASK_ROWS", 5)
    odd = [("m", 20, "a", 1, 0.1, ret, 0.5, 2000) for ret in (None, 0.0, -0.0, float("nan"))]
    rows = spark.createDataFrame(_rows(3, 2000, 0.1) + odd, SCHEMA).repartition(1)
    wide = rows.withColumn("models", F.array(F.struct("algorithm", "score")))
    seen, deal = [], type(wide).repartition
    monkeypatch.setattr(type(wide), "repartition", lambda self, *by: seen.append(by[0]) or deal(self, *by))
    made = metrics.counted(wide, 2004)
    counts = lambda df: sorted(str(tuple(r)).replace("-0.0,", "0.0,") for r in df.collect())
    assert counts(made) == counts(rows.groupBy(*metrics.KEYS, "score", "ret").count())
    # Beyond 200 tasks a shuffle sorts, and a task holds the rows of its split.
    assert sum(seen) >= 401 and max(seen) <= 200


def test_counts_are_not_broadcast_for_the_size_of_their_files(spark):
    rows = spark.createDataFrame(_rows(4, 300, 0.1), SCHEMA)
    made = metrics.correlations(rows)
    joins = [x for x in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
    # The two joins of counts with ranks are merged; what is broadcast has a row for each key, or range and key.
    assert sum("rightHint=(strategy=merge)" in x for x in joins) == 2 and all("rightHint=(strategy=" in x and "leftHint" not in x for x in joins)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "BuildLeft" not in plan
