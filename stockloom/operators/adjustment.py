"""Point-in-time price adjustment: splits divide earlier prices, dividends deflate them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Open days from trade to settlement, and the currency of dividends, by calendar.
SETTLEMENT_DAYS = {"KRX": 2, "NYSE": 1}
CURRENCY = {"KRX": "KRW", "NYSE": "USD"}
MARKET_CALENDAR = {"domestic": "KRX", "overseas": "NYSE"}
PRICES = ("open_price", "high_price", "low_price", "close_price")


def with_calendar(rows: DataFrame, universe: DataFrame, calendars: dict[str, str] | None = None) -> DataFrame:
    """Adds ``calendar_code``, the calendar of the stock's market in the universe; unknown stocks have none.

    ``calendars`` overrides the calendar of a market. The universe has a row per listed stock.
    """
    own = F.create_map(*[F.lit(x) for pair in (MARKET_CALENDAR | (calendars or {})).items() for x in pair])
    members = universe.select("stock_code", F.try_element_at(own, F.col("market")).alias("calendar_code")).distinct()
    return rows.drop("calendar_code").join(F.broadcast(members), "stock_code", "left")


def valid_dividends(events: DataFrame) -> DataFrame:
    """Dividends with cash and a subtype; unknown cash is rejected too."""
    return events.filter("event_type = 'DIVIDEND' AND cash_amount <> 0 AND event_subtype <> ''")


def settlement_days(code: Column, overrides: dict[str, int] | None = None) -> Column:
    """Open days from trade to settlement of a calendar; null for none. ``overrides`` replace the days of known calendars.

    An unknown calendar is an error, in the overrides at once and in the rows when they are read.
    """
    unknown = set(overrides or {}) - set(SETTLEMENT_DAYS)
    if unknown:
        raise ValueError(f"no settlement days for the calendars {sorted(unknown)}")
    days = F.create_map(*[F.lit(x) for pair in (SETTLEMENT_DAYS | (overrides or {})).items() for x in pair])
    error = F.raise_error(F.concat(F.lit("no settlement days for the calendar "), code)).cast("int")
    return F.when(code.isNull(), F.lit(None)).when(code.isin(*SETTLEMENT_DAYS), F.try_element_at(days, code)).otherwise(error)


def ex_dates(dividends: DataFrame, expanded: DataFrame, settlement: dict[str, int] | None = None) -> DataFrame:
    """Adds ``ex_date``: the stored one, else settlement days less one before the record date, and ``base_date``.

    The dividends have their ``calendar_code``; without one, or before the calendar begins, only a stored date counts.
    ``settlement`` overrides the days of a calendar; a calendar without settlement days is an error.
    """
    cal = F.broadcast(expanded)  # one row per civil day and calendar
    rows = dividends
    steps = settlement_days(F.col("calendar_code"), settlement) - 1
    at = cal.select("calendar_code", F.col("cal_date").alias("event_date"), "idx_incl")
    rows = rows.join(at, ["calendar_code", "event_date"], "left").withColumn("target", F.col("idx_incl") - steps)
    opened = cal.filter("is_open").select("calendar_code", F.col("idx_incl").alias("target"), F.col("cal_date").alias("derived"))
    rows = rows.join(opened, ["calendar_code", "target"], "left").withColumn("ex_date", F.coalesce("ex_dividend_date", "derived"))
    before = cal.select("calendar_code", F.col("cal_date").alias("ex_date"), F.col("prev_open_excl").alias("base_date"))
    return rows.join(before, ["calendar_code", "ex_date"], "left").drop("target", "derived", "idx_incl")


def dividends_checked(events: DataFrame, bars: DataFrame, expanded: DataFrame, settlement: dict[str, int] | None = None) -> DataFrame:
    """Valid dividends with ``base_close`` and ``skip_reason`` (null: applied); a stock without a market is skipped as ``market``."""
    rows = ex_dates(valid_dividends(events), expanded, settlement)
    expected = F.try_element_at(F.create_map(*[F.lit(x) for pair in CURRENCY.items() for x in pair]), F.col("calendar_code"))
    base = bars.select("stock_code", F.col("trade_date").alias("base_date"), F.col("close_price").alias("base_close"))
    rows = rows.join(base, ["stock_code", "base_date"], "left")
    reason = F.when(F.col("calendar_code").isNull(), "market").when(~F.col("currency_code").eqNullSafe(expected), "currency").when(F.col("base_close").isNull(), "no_base_close")
    return rows.withColumn("skip_reason", reason)


def as_of_dates(bars: DataFrame, as_of: str | None) -> DataFrame:
    """``stock_code, as_of``: the given date for every stock, or each stock's own last bar."""
    day = F.max("trade_date") if as_of is None else F.max(F.lit(as_of).cast("date"))
    return bars.groupBy("stock_code").agg(day.alias("as_of"))


Factors = Callable[[DataFrame, DataFrame, DataFrame, DataFrame], DataFrame]
#: By event type: (bars, all events, expanded calendar, as-of dates) -> ``stock_code, at, divide, times``. Prices before
#: ``at`` are divided by the one and multiplied by the other, volumes are multiplied by ``divide``.
HANDLERS: dict[str, Factors] = {}


def register_handler(event_type: str) -> Callable[[Factors], Factors]:
    """Makes ``adjust_prices`` apply a further event type."""

    def keep(handler: Factors) -> Factors:
        HANDLERS[event_type] = handler
        return handler

    return keep


@register_handler("SPLIT")
def split_factors(bars: DataFrame, events: DataFrame, expanded: DataFrame, as_of: DataFrame) -> DataFrame:
    """Splits with a rate; unknown and zero rates are rejected."""
    own = events.filter("event_type = 'SPLIT' AND stock_rate <> 0")
    return own.select("stock_code", F.col("event_date").alias("at"), F.col("stock_rate").alias("divide"), F.lit(1.0).alias("times"))


@register_handler("DIVIDEND")
def dividend_factors(bars: DataFrame, events: DataFrame, expanded: DataFrame, as_of: DataFrame) -> DataFrame:
    """Applied dividends; where a stock's splits come first, the base close is divided by the later ones known at the as-of date."""
    found = dividends_checked(events, bars, expanded).filter("skip_reason IS NULL").join(event_order(events), "stock_code", "left").join(as_of, "stock_code")
    found = found.select("stock_code", "event_date", "ex_date", "base_date", "base_close", "cash_amount", "split_first", "as_of")
    splits = split_factors(bars, events, expanded, as_of).select(F.col("stock_code").alias("s"), F.col("at").alias("split_date"), "divide")
    held = (F.col("stock_code") == F.col("s")) & F.expr("split_first AND split_date > base_date AND split_date <= as_of")
    keys = ["stock_code", "event_date", "ex_date", "base_close", "cash_amount", "nth"]
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy(*keys[:-1]).orderBy("split_first")))  # equal events each count
    each = found.join(splits, held, "left").groupBy(*keys).agg(F.coalesce(F.product("divide"), F.lit(1.0)).alias("rate"))
    return each.select("stock_code", F.col("ex_date").alias("at"), F.lit(1.0).alias("divide"), (1 - F.col("cash_amount") / (F.col("base_close") / F.col("rate"))).alias("times"))


def _adjusted(bars: DataFrame, factors: DataFrame, as_of: DataFrame) -> DataFrame:
    """Bars with the factors dated after each row: one window over rows and events, newest first."""
    known = factors.join(as_of, "stock_code").filter(F.col("at") <= F.col("as_of"))
    rows = bars.withColumns({"_event": F.lit(False), "_divide": F.lit(1.0), "_times": F.lit(1.0), "_day": F.unix_date("trade_date")})
    marks = known.select("stock_code", F.lit(True).alias("_event"), F.col("divide").alias("_divide"), F.col("times").alias("_times"), F.unix_date("at").alias("_day"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    later = Window.partitionBy("stock_code").orderBy(F.desc("_day")).rangeBetween(Window.unboundedPreceding, -1)
    after = lambda name: F.coalesce(F.product(name).over(later), F.lit(1.0))
    out = both.withColumns({"_d": after("_divide"), "_t": after("_times")}).filter("NOT _event")
    made = {p: F.col(p) / F.col("_d") * F.col("_t") for p in PRICES} | {"volume": F.col("volume") * F.col("_d")}
    return out.withColumns(made).drop("_event", "_divide", "_times", "_day", "_d", "_t")


def adjust_split(bars: DataFrame, events: DataFrame, as_of: str | None = None) -> DataFrame:
    """Prices before a split are divided by its rate and volumes multiplied; the event's day stays."""
    dates = as_of_dates(bars, as_of)
    return _adjusted(bars, split_factors(bars, events, None, dates), dates)


def adjust_dividend(bars: DataFrame, events: DataFrame, expanded: DataFrame, as_of: str | None = None) -> DataFrame:
    """Prices before an ex-date are multiplied by one less the share that the cash has in the unadjusted base close."""
    dates = as_of_dates(bars, as_of)
    return _adjusted(bars, dividend_factors(bars, events.filter("event_type = 'DIVIDEND'"), expanded, dates), dates)


def event_order(events: DataFrame) -> DataFrame:
    """Whether a stock's splits come first: by the least event date of each type, ties to dividends."""
    first = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("event_date")))
    both = events.groupBy("stock_code").agg(first("SPLIT").alias("s"), first("DIVIDEND").alias("d"))
    return both.select("stock_code", F.coalesce(F.col("s") < F.col("d"), F.col("d").isNull()).alias("split_first"))


def adjust_prices(bars: DataFrame, events: DataFrame, expanded: DataFrame, as_of: str | None = None, handlers: dict[str, Factors] | None = None) -> DataFrame:
    """All registered adjustments in one pass; without ``as_of`` each stock is adjusted as of its own last bar.

    Splits and dividends commute but for the dividends' base closes, so only those follow the order of a
    stock's first events. Rows of events without a handler, with null rates, cash or dates change nothing.
    """
    dates = as_of_dates(bars, as_of)
    made = [handler(bars, events, expanded, dates) for handler in (HANDLERS if handlers is None else handlers).values()]
    return _adjusted(bars, reduce(DataFrame.unionByName, made), dates)


def skip_audit(events: DataFrame, bars: DataFrame, expanded: DataFrame, size: int = 25) -> DataFrame:
    """Skipped stocks by reason, in batches; dividends without a cash amount are among them."""
    skipped = dividends_checked(events, bars, expanded).filter("skip_reason IS NOT NULL").select("skip_reason", "stock_code")
    unknown = events.filter("event_type = 'DIVIDEND' AND cash_amount IS NULL AND event_subtype <> ''").select(F.lit("no_cash").alias("skip_reason"), "stock_code")
    skipped = skipped.unionByName(unknown).distinct()
    n = F.row_number().over(Window.partitionBy("skip_reason").orderBy("stock_code"))
    batch = F.floor((n - 1) / size).cast("int")
    grouped = skipped.withColumn("batch", batch).groupBy("skip_reason", "batch").agg(F.array_sort(F.collect_list("stock_code")).alias("codes"))
    return grouped.select("skip_reason", "batch", F.array_join("codes", ",").alias("stock_codes"))
