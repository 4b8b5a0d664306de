"""Worked examples of the market-panel operators."""

import datetime as dt

import pytest

from stockloom.operators import adjustment, features, folds, metrics, registry_tables
from stockloom.sources import panels


def _bars(spark, rows):
    made = [(c, 20, dt.date.fromisoformat(d), o, h, l, x, v) for c, d, o, h, l, x, v in rows]
    return spark.createDataFrame(made, "stock_code string, b int, trade_date date, open_price double, high_price double, low_price double, close_price double, volume long")


def test_split_divides_prices_before_the_event(spark):
    bars = _bars(spark, [("A", "2020-08-28", 499.23, 499.23, 499.23, 499.23, 200), ("A", "2020-08-31", 129.0, 129.0, 129.0, 129.0, 100)])
    events = spark.createDataFrame([("A", "SPLIT", dt.date(2020, 8, 31), 4.0)], "stock_code string, event_type string, event_date date, stock_rate double")
    rows = {r["trade_date"]: r for r in adjustment.adjust_split(bars, events, "2020-08-31").collect()}
    assert rows[dt.date(2020, 8, 28)]["close_price"] == pytest.approx(124.8075)
    assert rows[dt.date(2020, 8, 28)]["volume"] == pytest.approx(800)
    assert rows[dt.date(2020, 8, 31)]["close_price"] == 129.0
    early = adjustment.adjust_split(bars, events, "2020-08-30").filter("volume = 800").count()
    assert early == 0


def test_bar_shapes(spark):
    row = features.technical(_bars(spark, [("A", "2020-01-02", 10000.0, 10500.0, 9800.0, 10300.0, 5)])).collect()[0]
    assert [round(row[k], 6) for k in features.SHAPES] == [0.03, 0.07, 0.02, 0.02, 0.03]


def test_rolling_features_and_constant_window(spark):
    rows = [("A", f"2020-01-0{i + 1}", c, c, c, c, 7) for i, c in enumerate([100.0, 105.0, 110.0, 115.0, 120.0, 125.0])]
    last = features.technical(_bars(spark, rows)).orderBy("trade_date").collect()[-1]
    assert (round(last["ROC_5"], 6), round(last["MA_5"], 6), round(last["STD_5"], 5), last["RANK_5"]) == (0.25, -0.08, 0.06325, 1.0)
    assert last["CORR_5"] is None and last["MA_10"] is None


def test_registry_of_features():
    kinds = features.registry()
    assert len(kinds) == 40 and sum(v == "FROZEN" for v in kinds.values()) == 15
    with pytest.raises(ValueError):
        features.classify("volume")


def test_expanded_calendar(spark):
    days = [(f"2024-01-{d:02d}", int(d not in (1, 6, 7))) for d in range(1, 10)]
    cal = spark.createDataFrame([("NYSE", dt.date.fromisoformat(d), o) for d, o in days], "calendar_code string, cal_date date, is_open int")
    rows = {r["cal_date"].day: r for r in panels.expanded(cal).collect()}
    assert rows[6]["prev_open_incl"].day == 5 and rows[6]["next_open_incl"].day == 8 and rows[1]["prev_open_incl"] is None
    assert rows[8]["prev_open_excl"].day == 5 and rows[9]["idx_incl"] == 6


def test_purged_split(spark):
    row = folds.purged_split(spark, 200, 20).collect()[0]
    assert row["train_end"] == 112 and row["val_end"] - row["val_start"] == 24 and row["test_end"] - row["test_start"] == 24
    with pytest.raises(ValueError):
        folds.purged_split(spark, 40, 20)


def test_ensemble_and_confidence(spark):
    from pyspark.sql import functions as F

    pairs = spark.createDataFrame([(0.05, 0.03), (0.05, -0.02), (-0.05, -0.03), (0.0, 0.05)], "a double, b double")
    assert [r[0] for r in pairs.select(metrics.ensemble(F.col("a"), F.col("b"))).collect()] == [0.03, 0.0, -0.03, 0.0]
    rows = spark.createDataFrame([(0.04, -0.02, 0.06), (0.0, -0.02, 0.06), (0.1, 0.2, 0.2)], "s double, l double, h double")
    got = [r[0] for r in rows.select(metrics.confidence(F.col("s"), F.col("l"), F.col("h"))).collect()]
    assert got[0] == pytest.approx(0.9, abs=0.001) and got[1:] == [0.5, 0.5]


def test_stale_at_more_than_28_days(spark):
    from pyspark.sql import functions as F

    own = "domestic_20_lightgbm_2026-01-01"
    broken = [f"{own}_q10.txt", f"{own}.txt.sha256", "domestic_D20_lightgbm_2026-01-01.txt", "domestic_20_lightgbm_2026-13-41.txt", "README.md", own]
    names = spark.createDataFrame([(f"{own}.txt",), *((x,) for x in broken)], "file_name string")
    versions = registry_tables.parsed(names)
    flags = [registry_tables.stale(versions, F.lit(d).cast("date")).collect()[0]["is_stale"] for d in ("2026-01-29", "2026-01-30")]
    assert flags == [False, True] and versions.count() == 1


def test_stage_markers_drop_broken_lines(spark):
    lines = spark.createDataFrame([('{"stage_marker": true, "message": "x"}',), ('{"stage_marker": false}',), ("{broken",)], "value string")
    assert [r["message"] for r in registry_tables.stage_markers(lines).collect()] == ["x"]


def test_streamed_counters_match_batch(spark):
    from stockloom.streaming.runs import counted_stream

    folder = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{folder}/events.parquet")
    got = counted_stream(spark, f"{folder}/events.parquet*", events.schema, "runs").collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in registry_tables.run_counters(events).collect()}


def test_a_brand_number_is_taken_from_parts_and_not_from_their_lines(spark):
    plan = panels.trades(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" in plan and "regexp_extract" not in plan.split("Join")[0]
