"""Reading market tables: symbols and date ranges, universes, decimals, one stock in one partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.sources.panels import EXCHANGES


def scan_bars(bars: DataFrame, stocks: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of listed stocks in an inclusive range of dates; the range reaches the scan. A blank code is an error."""
    for bound, within in ((start, lambda d, x: d >= x), (end, lambda d, x: d <= x)):
        if bound is not None:
            bars = bars.filter(within(F.col("trade_date"), F.lit(bound).cast("date")))
    code = F.when(F.trim("stock_code") == "", F.raise_error(F.lit("a stock code is blank")).cast("string")).otherwise(F.col("stock_code"))
    return bars.join(stocks.select(code.alias("stock_code")).distinct(), "stock_code", "left_semi")


def scan_universe(stocks: DataFrame, grades: DataFrame, market: str) -> DataFrame:
    """Stocks (no funds) of the market's exchanges with each of their grades: ``stock_code, market, grade``."""
    if market not in EXCHANGES:
        raise ValueError(f"unknown market {market}")
    own = stocks.filter(F.col("exchange").isin(*EXCHANGES[market]) & (F.col("asset_type") == "STOCK"))
    return own.select("stock_code", F.lit(market).alias("market")).join(grades.filter("grade IS NOT NULL").select("stock_code", "grade"), "stock_code")


def market_data(universe: DataFrame, bars: DataFrame, events: DataFrame, flows: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bars up to the date, all events and all flows of the universe's stocks."""
    members = universe.select("stock_code").distinct()
    known = bars.filter(F.col("trade_date") <= F.lit(as_of).cast("date"))
    return tuple(x.join(members, "stock_code", "left_semi") for x in (known, events, flows))


def cast_decimals(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The listed columns that exist, as doubles."""
    return rows.withColumns({c: F.col(c).cast("double") for c in columns if c in rows.columns})


def by_stock(rows: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """Rows dealt by stock, so that a task holds whole stocks; only the given codes where there are some."""
    chosen = rows if codes is None else rows.filter(F.col("stock_code").isin(*codes))
    return chosen.repartition("stock_code")
