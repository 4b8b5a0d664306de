"""Extension points, defined errors and small cases of the market operators, and the entry without the optional parts."""

import datetime as dt
import math
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stockloom.operators import activation, adjustment, calendars, features, folds, labels, metrics, registry_tables
from stockloom.sources import panels, scans

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_optional_parts(tmp_path):
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__")
    for name, left_out in (("both", skip), ("subpackage", shutil.ignore_patterns("llm", ".git", "__pycache__"))):
        shutil.copytree(ROOT, tmp_path / name, ignore=left_out)
        code = "import __spark_entry__ as e; q = e.queries(); assert 'p_panel' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path / name, check=True)


def _day(x):
    return dt.date.fromisoformat(x)


def _bars(spark, rows):
    return spark.createDataFrame([(c, _day(d), x, x, x, x, 10) for c, d, x in rows], "stock_code string, trade_date date, open_price double, high_price double, low_price double, close_price double, volume long")


EVENTS = "stock_code string, event_type string, event_date date, stock_rate double, cash_amount double, event_subtype string, ex_dividend_date date, currency_code string"


def _expanded(spark):
    days = [("NYSE", _day(f"2024-01-{d:02d}"), int(d not in (6, 7, 13, 14))) for d in range(1, 20)]
    return panels.expanded(spark.createDataFrame(days, "calendar_code string, cal_date date, is_open int"))


def test_dividend_base_follows_the_order_of_first_events(spark):
    bars = _bars(spark, [("A", "2024-01-02", 100.0), ("A", "2024-01-03", 100.0), ("A", "2024-01-04", 98.0), ("A", "2024-01-08", 50.0), ("B", "2024-01-03", 100.0), ("B", "2024-01-08", 50.0)])
    universe = spark.createDataFrame([("A", "overseas"), ("B", "overseas")], "stock_code string, market string")
    split, cash = (_day("2024-01-08"), 2.0, None, None, None, None), (_day("2024-01-04"), None, 2.0, "annual", _day("2024-01-04"), "USD")
    rows = [("A", "SPLIT", *split), ("A", "DIVIDEND", *cash), ("B", "SPLIT", *split), ("B", "SPLIT", _day("2024-01-01"), 1.0, None, None, None, None), ("B", "DIVIDEND", *cash)]
    rows += [("A", "DIVIDEND", _day("2024-01-04"), None, None, "annual", _day("2024-01-04"), "USD"), ("A", "SPLIT", _day("2024-01-03"), None, None, None, None, None)]
    events = adjustment.with_calendar(spark.createDataFrame(rows, EVENTS), universe)
    own = lambda **k: {(r["stock_code"], r["trade_date"].day): r["close_price"] for r in adjustment.adjust_prices(bars, events.filter("stock_rate IS NOT NULL OR event_type = 'DIVIDEND'"), _expanded(spark), **k).collect()}
    got = own()
    assert got["A", 2] == pytest.approx(100 / 2 * 0.98) and got["A", 4] == 49.0 and got["A", 8] == 50.0
    # Splits come first in B: the base close of 100 is one of 50 after the split.
    assert got["B", 3] == pytest.approx(100 / 2 * 0.96)
    # As of each stock's own last bar the split of the 8th is known; a day earlier it is not.
    assert own(as_of="2024-01-07")["A", 4] == 98.0


def test_registered_handlers_apply_further_event_types(spark):
    bars = _bars(spark, [("A", "2024-01-02", 100.0), ("A", "2024-01-03", 90.0)])
    events = spark.createDataFrame([("A", "RIGHTS", _day("2024-01-03"), None, None, None, None, None)], EVENTS).withColumn("calendar_code", F.lit("NYSE"))
    assert [r["close_price"] for r in adjustment.adjust_prices(bars, events, _expanded(spark)).orderBy("trade_date").collect()] == [100.0, 90.0]

    @adjustment.register_handler("RIGHTS")
    def rights(bars, events, expanded, as_of):
        return events.filter("event_type = 'RIGHTS'").select("stock_code", F.col("event_date").alias("at"), F.lit(1.0).alias("divide"), F.lit(0.9).alias("times"))

    try:
        assert [r["close_price"] for r in adjustment.adjust_prices(bars, events, _expanded(spark)).orderBy("trade_date").collect()] == [90.0, 90.0]
    finally:
        del adjustment.HANDLERS["RIGHTS"]


def test_calendar_of_a_market_can_be_overridden(spark):
    universe = spark.createDataFrame([("A", "domestic"), ("B", "overseas")], "stock_code string, market string")
    rows = spark.createDataFrame([("A",), ("B",), ("C",)], "stock_code string")
    codes = lambda **k: {r["stock_code"]: r["calendar_code"] for r in adjustment.with_calendar(rows, universe, **k).collect()}
    assert codes() == {"A": "KRX", "B": "NYSE", "C": None} and codes(calendars={"domestic": "XKRX"})["A"] == "XKRX"


def test_nth_open_day(spark):
    cal = _expanded(spark)
    rows = spark.createDataFrame([("NYSE", _day(d)) for d in ("2024-01-05", "2024-01-06", "2024-01-19", "2030-01-01")] + [("NYSE", None)], "calendar_code string, start date")
    got = lambda n: {str(r["start"]): r["nth_open"] and r["nth_open"].day for r in calendars.nth_open(rows, cal, n).collect()}
    assert got(1) == {"2024-01-05": 5, "2024-01-06": 8, "2024-01-19": 19, "2030-01-01": None, "None": None}
    assert got(2) == {"2024-01-05": 8, "2024-01-06": 9, "2024-01-19": None, "2030-01-01": None, "None": None}
    with pytest.raises(ValueError):
        calendars.nth_open(rows, cal, 0)


def test_normal_distribution_and_strict_confidence(spark):
    values = [i / 50 for i in range(0, 500)]
    rows = spark.createDataFrame([(v,) for v in values], "z double").select("z", metrics.normal(F.col("z")).alias("p")).collect()
    assert all(r["p"] == pytest.approx(0.5 * (1 + math.erf(r["z"] / math.sqrt(2))), abs=2e-12) for r in rows)
    flat = spark.createDataFrame([(0.1, 0.2, 0.2)], "s double, l double, h double")
    assert flat.select(metrics.confidence(F.col("s"), F.col("l"), F.col("h"))).first()[0] == 0.5
    with pytest.raises(Exception, match="do not differ"):
        flat.select(metrics.confidence(F.col("s"), F.col("l"), F.col("h"), strict=True)).collect()


def test_feature_selection_and_constraints(spark):
    panel = spark.createDataFrame([("A", 1.0, 2.0, 3.0, 0.1), ("A", 1.0, 2.0, 3.0, None)], "stock_code string, foreign_net_ratio double, volume double, KMID double, label_D20 double")
    rows, names = features.selected(panel, "label_D20")
    assert names == ["foreign_net_ratio", "KMID"] and rows.count() == 1 and features.monotone(names) == [0, 1]
    with pytest.raises(ValueError):
        features.monotone(["volume"])


def test_first_row_per_date_and_market_starts(spark):
    rows = spark.createDataFrame([("A", _day("2007-01-02"), 2), ("A", _day("2007-01-02"), 1), ("B", _day("2007-01-02"), 1), ("B", _day("2007-08-20"), 1)], "stock_code string, trade_date date, n int")
    assert labels.first_row_per_date(rows, "n").filter("stock_code = 'A'").collect()[0]["n"] == 1
    universe = spark.createDataFrame([("A", "domestic"), ("B", "overseas")], "stock_code string, market string")
    assert {(r["stock_code"], str(r["trade_date"])) for r in labels.from_start(rows, universe).collect()} == {("A", "2007-01-02"), ("B", "2007-08-20")}


def test_fold_sizes_equal_slices_and_bounds_past_the_end(spark):
    days = [_day("2024-01-01") + dt.timedelta(days=i) for i in range(40)]
    panel = spark.createDataFrame([(d, i) for i, d in enumerate(days) for _ in range(i % 3 + 1)], "trade_date date, x int")
    axis = folds.date_axis(panel)
    cuts = folds.weekly_folds(axis, 3, 10, 5)
    want = {(r["fold_index"], r["role"], r["n"]) for r in folds.slices(panel, cuts).groupBy("fold_index", "role").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert want and {tuple(r) for r in folds.sizes(panel, cuts).select("fold_index", "role", "n").collect()} == want
    last = folds.final_train_window(panel, cuts)
    assert last.count() == max(n for f, role, n in want if role == "train") and folds.final_train_window(panel, cuts.limit(0)).count() == 0
    bounds = lambda *row: spark.createDataFrame([row], "train_end int, val_start int, val_end int")
    assert folds.on_axis(bounds(5, 8, 40), axis).first()["val_end"] is None
    with pytest.raises(Exception, match="past the end"):
        folds.on_axis(bounds(5, 40, 45), axis).collect()
    assert folds.initial_train_end(5000) == 2480 and folds.initial_train_end(100) == 1


def test_scans(spark):
    stocks = spark.createDataFrame([("A", "KOSPI", "STOCK"), ("B", "NYSE", "STOCK"), ("C", "KOSDAQ", "ETF")], "stock_code string, exchange string, asset_type string")
    grades = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", None)], "stock_code string, grade string")
    assert sorted(tuple(r) for r in scans.scan_universe(stocks, grades, "domestic").collect()) == [("A", "domestic", "A"), ("A", "domestic", "B")]
    assert scans.scan_universe(stocks, grades, "overseas").count() == 0
    with pytest.raises(ValueError):
        scans.scan_universe(stocks, grades, "moon")
    bars = _bars(spark, [("A", "2024-01-02", 1.0), ("A", "2024-01-04", 1.0), ("Z", "2024-01-02", 1.0)])
    assert scans.scan_bars(bars, stocks, "2024-01-02", "2024-01-03").count() == 1 and scans.scan_bars(bars, stocks).count() == 2
    with pytest.raises(Exception, match="blank"):
        scans.scan_bars(bars, stocks.select(F.lit(" ").alias("stock_code"))).collect()
    assert scans.cast_decimals(stocks.select(F.lit("1.5").cast("decimal(9,2)").alias("x")), ["x", "y"]).dtypes == [("x", "double")]


def test_promotions_are_applied_once_merged(spark):
    rows = spark.createDataFrame([("m", 20, "a", _day("2024-01-01"), 0.3, 0.1, True), ("m", 60, "a", _day("2024-01-01"), 0.1, 0.1, False)], "market string, horizon int, algorithm string, trained_date date, rank_ic double, champion_rank_ic double, promoted boolean")
    manifest = rows.select(*activation.COMBO, "trained_date", F.lit("d1").alias("digest"))
    got = activation.applied(rows, manifest, "2024-02-01").collect()
    assert [(r["horizon"], r["basis"]["digest"]) for r in got] == [(20, "d1")] and activation.applied(rows, manifest, "2024-02-01", merged=False).count() == 0
    champions = spark.createDataFrame([("m", 20, "ensemble"), ("m", 60, None)], "market string, horizon int, champion string")
    versions = spark.createDataFrame([("m", 20, a, _day(d)) for a in ("lightgbm", "xgboost") for d in ("2024-01-01", "2024-02-01")], "market string, horizon int, algorithm string, trained_date date")
    models, chosen = activation.activations_of(champions, versions, "2024-03-01")
    assert sorted((r["algorithm"], r["trained_date"].month) for r in models.collect()) == [("lightgbm", 2), ("xgboost", 2)] and [r["strategy"] for r in chosen.collect()] == ["ensemble"]


def test_file_names_round_trip(spark):
    row = spark.range(1).select(F.lit("domestic").alias("m"), F.lit(20).alias("h"), F.lit("xgboost").alias("a"), F.lit("2024-01-05").cast("date").alias("d"))
    names = row.select(registry_tables.file_name(*[F.col(c) for c in "mhad"]).alias("file_name"), registry_tables.file_name(*[F.col(c) for c in "mhad"], F.lit(0.9)).alias("q")).first()
    assert tuple(names) == ("domestic_20_xgboost_2024-01-05.json", "domestic_20_xgboost_2024-01-05_q90.json")
