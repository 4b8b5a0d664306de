"""Forward realised returns with halt and delisting rules, in closed form.

A stock's events are one row of arrays beside its bars, so that no bar meets an event in a join: the splits and dividends
between two dates are folded within the row. A stock has a few events a year.

Nulls: rows without a date, or on days outside the calendar, have no target; a missing close gives a null label. Of bars
that repeat a date the first counts. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.operators.adjustment import with_calendar

HORIZONS = (20, 60)
#: Open days between train and validation rows of each horizon, and the first day of each market's panel.
PURGE_GAP = {h: h for h in HORIZONS}  # another horizon is a KeyError
START_DATES = {"domestic": "2005-01-01", "overseas": "2007-08-20"}


def targets(bars: DataFrame, expanded: DataFrame, universe: DataFrame, horizons=HORIZONS) -> DataFrame:
    """``stock_code, trade_date, horizon, target, resolved, reason, halt_days, close_price, end_close`` for every bar and horizon.

    The target is the horizon-th open day after the bar. A missing target day inside a halt rolls
    forward to the first later bar on an open day, unless the halt is as long as the horizon.
    """
    cal = F.broadcast(expanded)
    rows = with_calendar(unrepeated(bars).select("stock_code", "trade_date", "close_price"), universe)
    at = cal.select("calendar_code", F.col("cal_date").alias("trade_date"), "idx_incl", "is_open")
    rows = rows.join(at, ["calendar_code", "trade_date"])
    span = Window.partitionBy("stock_code")
    rows = rows.withColumns({"first_obs": F.min("trade_date").over(span), "last_obs": F.max("trade_date").over(span)})
    rows = rows.withColumns({"lo": F.min("idx_incl").over(span), "hi": F.max("idx_incl").over(span)})
    wanted = rows.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("t_idx", F.col("idx_incl") + F.col("horizon"))
    opened = cal.filter("is_open").select("calendar_code", F.col("idx_incl").alias("t_idx"), F.col("cal_date").alias("target"))
    wanted = wanted.join(opened, ["calendar_code", "t_idx"], "left")
    # Observed open days around each target index: bars and targets in one ordered series per stock.
    seen = rows.filter("is_open").select("stock_code", F.col("idx_incl").alias("i"), F.col("trade_date").alias("day"), F.col("close_price").alias("close"), F.lit(0).alias("probe"))
    ask = wanted.select("stock_code", F.col("t_idx").alias("i"), F.lit(None).cast("date").alias("day"), F.lit(None).cast("double").alias("close"), F.lit(1).alias("probe")).distinct()
    both = seen.unionByName(ask)
    back = Window.partitionBy("stock_code").orderBy("i", "probe").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("stock_code").orderBy(F.desc("i"), F.desc("probe")).rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("probe") == 0, F.struct("i", "day", "close"))
    around = both.withColumns({"prev": F.last(mark, True).over(back), "next": F.last(mark, True).over(ahead)}).filter("probe = 1")
    # A bar on the target day itself sorts before the probe, so it is the previous one.
    around = around.select("stock_code", F.col("i").alias("t_idx"), F.col("prev.i").alias("p_i"), F.col("next.i").alias("n_i"), F.col("next.day").alias("n_day"), F.col("prev.close").alias("p_close"), F.col("next.close").alias("n_close"))
    met = wanted.join(around, ["stock_code", "t_idx"]).join(F.broadcast(universe.select("stock_code", F.col("delisted_at").isNotNull().alias("gone"))), "stock_code", "left")
    short = F.when(F.col("gone"), "delisted").otherwise("insufficient_future_data")
    length = F.coalesce("n_i", F.col("hi") + 1) - F.coalesce("p_i", F.col("lo")) - 1
    observed = F.col("p_i") == F.col("t_idx")
    reason = (
        F.when(F.col("target").isNull(), "insufficient_future_data").when(F.col("target") > F.col("last_obs"), short).when(observed, F.lit(None))
        .when(length >= F.col("horizon"), "halted").when(F.col("n_day").isNull(), short)
    )
    met = met.withColumn("reason", reason).withColumn("halt_days", F.when(F.col("target").isNotNull() & (F.col("target") <= F.col("last_obs")) & ~F.coalesce(observed, F.lit(False)), length))
    resolved = F.when(F.col("reason").isNotNull(), F.lit(None)).when(observed, F.col("target")).otherwise(F.col("n_day"))
    end = F.when(resolved.isNotNull(), F.when(observed, F.col("p_close")).otherwise(F.col("n_close")))
    return met.withColumns({"resolved": resolved, "end_close": end}).select("stock_code", "trade_date", "horizon", "target", "resolved", "reason", "halt_days", "close_price", "end_close")


def first_row_per_date(rows: DataFrame, *order: str) -> DataFrame:
    """The first row of each stock and date in the given order; ties keep any one."""
    n = F.row_number().over(Window.partitionBy("stock_code", "trade_date").orderBy(*order))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_n")


def unrepeated(bars: DataFrame, *order: str) -> DataFrame:
    """Bars without further rows of a stock and date: the first in the given ingest order stays.

    Without an order the values of the row decide, so that the choice is the same in every run. The window is that of the
    stock, as the other operators need it, so no further shuffle comes of it. Rows without a date stay.
    """
    rest = [c for c in bars.columns if c not in ("stock_code", "trade_date", *order)]
    before = F.lag("trade_date").over(Window.partitionBy("stock_code").orderBy("trade_date", *order, *rest))
    return bars.withColumn("_same", before == F.col("trade_date")).filter("_same IS NOT TRUE").drop("_same")


def from_start(rows: DataFrame, universe: DataFrame, starts: dict[str, str] = START_DATES) -> DataFrame:
    """Rows of the universe's stocks from the first day of their market on."""
    own = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])
    first = universe.select("stock_code", F.try_element_at(own, F.col("market")).cast("date").alias("_start")).distinct()
    return rows.join(F.broadcast(first), "stock_code").filter(F.col("trade_date") >= F.col("_start")).drop("_start")


def _splits(events: DataFrame) -> DataFrame:
    """``stock_code, splits``: dates and rates of each stock's splits."""
    own = events.filter("event_type = 'SPLIT' AND stock_rate IS NOT NULL")
    return own.groupBy("stock_code").agg(F.collect_list(F.struct("event_date", "stock_rate")).alias("splits"))


#: The product of the rates of splits after one date up to another.
_RATE = "aggregate(filter(splits, s -> s.event_date > {a} AND s.event_date <= {z}), 1.0D, (r, s) -> r * s.stock_rate)"


def split_labels(targets_: DataFrame, events: DataFrame) -> DataFrame:
    """Adds ``label``: the resolved close over the bar's close adjusted for splits up to the target, less one."""
    rows = targets_.join(_splits(events), "stock_code", "left")
    rate = F.when(F.col("splits").isNull(), 1.0).otherwise(F.expr(_RATE.format(a="trade_date", z="target")))
    return rows.withColumn("label", F.col("end_close") * rate / F.col("close_price") - 1).drop("splits")


def all_labels(targets_: DataFrame, events: DataFrame, dividends: DataFrame, order: DataFrame) -> DataFrame:
    """Adds ``label`` with splits and dividends up to the target.

    ``dividends`` are checked ones; ``order`` says which stocks' splits come first: their base closes
    are divided by the splits between the base day and the target.
    """
    applied = dividends.filter("skip_reason IS NULL").join(order, "stock_code", "left")
    first = F.coalesce("split_first", F.lit(False)).alias("split_first")
    own = applied.groupBy("stock_code").agg(F.collect_list(F.struct("ex_date", "base_date", "cash_amount", "base_close", first)).alias("dividends"))
    rows = targets_.join(_splits(events), "stock_code", "left").join(own, "stock_code", "left")
    rows = rows.withColumn("splits", F.coalesce("splits", F.array().cast("array<struct<event_date:date,stock_rate:double>>")))
    held = f"IF(d.split_first, {_RATE.format(a='d.base_date', z='target')}, 1.0D)"
    deflator = F.expr(f"aggregate(filter(dividends, d -> d.ex_date > trade_date AND d.ex_date <= target), 1.0D, (r, d) -> r * (1 - d.cash_amount * {held} / d.base_close))")
    rate = F.expr(_RATE.format(a="trade_date", z="target"))
    label = F.col("end_close") * rate / F.col("close_price") / F.coalesce(deflator, F.lit(1.0)) - 1
    return rows.withColumn("label", label).drop("splits", "dividends")
