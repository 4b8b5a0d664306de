"""Edges of the market operators: bounds, unknown markets, repeated bars, folds that don't fit, empty universes, rolling sums."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stockloom.operators import adjustment, calendars, features, folds, labels
from stockloom.plans import registry
from stockloom.sources import panels, sinks

SF = "/root/testdata/sf0.001"
BARS = "stock_code string, trade_date date, open_price double, high_price double, low_price double, close_price double, volume long"


def _calendar(spark, days=40):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(i),) for i in range(days)]
    cal = spark.createDataFrame(rows, "cal_date date").select(F.lit("KRX").alias("calendar_code"), "cal_date", (F.dayofweek("cal_date").between(2, 6)).cast("int").alias("is_open"))
    return panels.expanded(cal)


def test_next_open_day_within_a_bound(spark):
    day = lambda d: dt.date(2024, 1, d)
    asked = [("KRX", day(5), day(7)), ("KRX", day(5), day(8)), ("KRX", day(2), day(2)), ("KRX", day(2), day(3)), ("KRX", None, day(3)), ("KRX", day(2), None), ("none", day(2), day(9))]
    rows = spark.createDataFrame(asked, "calendar_code string, start date, bound date")
    got = {(r["calendar_code"], r["start"], r["bound"]): r["next_open"] for r in calendars.next_open(rows, _calendar(spark)).collect()}
    assert [got[k] for k in asked] == [None, day(8), None, day(3), None, None, None]


def test_settlement_days_of_unknown_and_overridden_markets(spark):
    rows = spark.createDataFrame([("KRX",), ("NYSE",), (None,)], "code string")
    days = lambda given=None: [r[0] for r in rows.select(adjustment.settlement_days(F.col("code"), given)).collect()]
    assert days() == [2, 1, None] and days({"KRX": 5}) == [5, 1, None]
    with pytest.raises(ValueError, match="LSE"):
        adjustment.settlement_days(F.col("code"), {"LSE": 2})
    with pytest.raises(Exception, match="no settlement days for the calendar LSE"):
        spark.createDataFrame([("LSE",)], "code string").select(adjustment.settlement_days(F.col("code"))).collect()


def test_dividends_of_a_stock_without_a_market_are_skipped(spark):
    events = spark.createDataFrame([("A", "DIVIDEND", dt.date(2024, 1, 10), None, 5.0, "annual", dt.date(2024, 1, 9), "USD", None)], "stock_code string, event_type string, event_date date, stock_rate double, cash_amount double, event_subtype string, ex_dividend_date date, currency_code string, calendar_code string")
    bars = spark.createDataFrame([("A", dt.date(2024, 1, 8), 1.0, 1.0, 1.0, 100.0, 1)], BARS)
    assert [r["skip_reason"] for r in adjustment.dividends_checked(events, bars, _calendar(spark)).collect()] == ["market"]


def test_folds_that_do_not_fit_are_errors(spark):
    axis = spark.range(50).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("trade_date"), F.col("id").cast("int").alias("idx"))
    for given in ({"gap": -1}, {"train_end": 0}, {"size": 0}, {"count": 0}):
        with pytest.raises(ValueError, match="at least"):
            folds.weekly_folds(axis, **({"gap": 2, "train_end": 10, "size": 5} | given))
    with pytest.raises(ValueError, match="too few"):
        folds.weekly_folds(axis, 20, 10, 5, count=20)
    made = folds.weekly_folds(axis, 20, 10, 5, count=5).orderBy("fold_index").collect()
    assert len(made) == 5 and made[0]["val_start"] == dt.date(2024, 1, 31) and made[-1]["val_end"] is None
    assert folds.weekly_folds(axis.limit(0), 2, 10, 5).count() == 0
    with pytest.raises(KeyError):
        labels.PURGE_GAP[99]


def test_repeated_bars_count_once(spark):
    day = lambda d: dt.date(2024, 1, d)
    rows = [("A", day(2), 1.0, 1.0, 1.0, 10.0, 1, 2), ("A", day(2), 1.0, 1.0, 1.0, 99.0, 1, 1), ("A", day(3), 1.0, 1.0, 1.0, 11.0, 1, 3), ("B", day(2), 1.0, 1.0, 1.0, 7.0, 1, 4), ("A", None, 1.0, 1.0, 1.0, 5.0, 1, 5), ("A", None, 1.0, 1.0, 1.0, 6.0, 1, 6)]
    bars = spark.createDataFrame(rows, BARS + ", seq int")
    kept = lambda *order: sorted((r["stock_code"], r["close_price"]) for r in labels.unrepeated(bars, *order).collect())
    assert kept("seq") == [("A", 5.0), ("A", 6.0), ("A", 11.0), ("A", 99.0), ("B", 7.0)]
    assert kept() == [("A", 5.0), ("A", 6.0), ("A", 10.0), ("A", 11.0), ("B", 7.0)]


def test_panel_with_repeated_bars_and_of_an_empty_universe(spark):
    m = registry.market(spark, SF)
    whole = registry.panel_of(m)
    twice = registry.panel_of(panels.Market(m.bars.unionByName(m.bars), m.events.limit(0), m.expanded, m.universe, m.flows))
    once = registry.panel_of(panels.Market(m.bars, m.events.limit(0), m.expanded, m.universe, m.flows))
    keys = ["stock_code", "trade_date", "label_D20", "RANK_20"]
    rows = twice.select(*keys).collect()
    assert len(rows) > 1000 and sorted(map(str, rows)) == sorted(map(str, once.select(*keys).collect()))
    empty = registry.panel_of(panels.Market(m.bars, m.events, m.expanded, m.universe.limit(0), m.flows))
    assert empty.schema.names == whole.schema.names and empty.dtypes == whole.dtypes and empty.count() == 0


def _rolled(frame, w):
    """Every window of one stock on its own, about its first value; ranks and counts as the operator defines them."""
    c, v = frame["close_price"], frame["volume"]
    same = lambda s: s.rolling(w).apply(lambda x: len(set(x)) == 1, raw=True) == 1
    with np.errstate(all="ignore"):
        return pd.DataFrame({
            "MA": c.rolling(w).apply(lambda x: x[0] + np.mean(x - x[0]), raw=True) / c - 1, "STD": c.rolling(w).apply(lambda x: np.std(x - x[0], ddof=1), raw=True) / c, "RANK": c.rolling(w).rank() / w,
            "CORR": c.rolling(w).apply(lambda x: np.corrcoef(x - x.iloc[0], v.loc[x.index])[0, 1]).mask(same(c) | same(v)), "ROC": c / c.shift(w) - 1,
        })


def test_rolling_sums_against_pandas(spark):
    """Prices about a billion that move by single units, constant stretches, missing closes, more rows than two blocks."""
    rng, rows = np.random.default_rng(8), []
    for stock, base in (("big", 1e9), ("small", 3.7)):
        for i in range(420):
            close = base + float(rng.integers(0, 40)) * (0.25 if stock == "big" else 0.1)
            close = None if stock == "small" and i in (200, 330) else base if 60 <= i < 150 else close
            rows.append((stock, dt.date(2020, 1, 1) + dt.timedelta(i), base, base * 1.1, base * 0.9, close, 5 if 100 <= i < 180 else int(rng.integers(1, 10**9))))
    got = features.technical(spark.createDataFrame(rows, BARS)).orderBy("stock_code", "trade_date").toPandas()
    for stock, own in got.groupby("stock_code"):
        own = own.reset_index(drop=True)
        for w in features.WINDOWS:
            want = _rolled(own, w)
            for name in want:
                a, b = own[f"{name}_{w}"].astype(float), want[name].astype(float)
                assert (a.isna() == b.isna()).all(), (stock, name, w)
                assert np.allclose(a.dropna(), b.dropna(), rtol=1e-9, atol={"MA": 1e-14, "STD": 1e-15}.get(name, 1e-9)), (stock, name, w)


def test_a_fold_reads_only_its_days(spark):
    """The scan of a clustered table puts out the rows of a few row groups; the rows are those of any layout."""
    rows = spark.range(8000).select(F.concat(F.lit("s"), F.col("id") % 20).alias("stock_code"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 20).cast("int")).alias("trade_date"), F.col("id").alias("x"))
    table = sinks.clustered(rows.orderBy(F.rand(1)), "clustered")
    cut = folds.weekly_folds(folds.date_axis(table), 5, 60, 40).orderBy("fold_index").first()
    window = table.filter((F.col("trade_date") >= F.lit(cut["val_start"])) & (F.col("trade_date") < F.lit(cut["val_end"])))
    plan = window._jdf.queryExecution().executedPlan()
    got = len(plan.executeCollect())
    read = plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()
    assert got == 40 * 20 and got <= read <= 2 * 8000 / int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert window.exceptAll(rows).count() == 0
