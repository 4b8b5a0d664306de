"""Technical and flow features: one shuffle per stock for all windows.

A sliding window is the difference of two running sums, so a row costs the same for any window. The sums begin anew
every ``RESTART`` rows and are taken about the first value of their block, so that they stay
small beside what they are summed from; a second tiling, shifted by half a block, holds the windows that cross a border of
the first. Ranks compare the row with the rows before it, which are there as lags.

Nulls: a window with a missing close has no average, deviation or rank, and no correlation if a close or volume is
missing; divisions by zero and constant windows give null. Repeated dates of a stock are rows of their own, in any order:
remove them first (``labels.first_row_per_date``). An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions.columns import finite

WINDOWS = (5, 10, 20, 60)
INVESTORS = ("foreign", "institution", "individual")
SHAPES = ("KMID", "KLEN", "KUP", "KLOW", "KSFT")
ROLLING = ("ROC", "MA", "STD", "RANK", "CORR")
#: Rows after which running sums begin anew; at least twice the longest window and two more.
RESTART = 128


def registry() -> dict[str, str]:
    """Class of each feature: prices can be derived again, flows are frozen."""
    prices = [*SHAPES, *(f"{r}_{w}" for r in ROLLING for w in WINDOWS)]
    flows = [f"{i}_net_{x}" for i in INVESTORS for x in ("ratio", *(f"cum_{w}" for w in WINDOWS))]
    return dict.fromkeys(prices, "PRICE_DERIVED") | dict.fromkeys(flows, "FROZEN")


def classify(name: str) -> str:
    if name not in registry():
        raise ValueError(f"unknown feature {name}")
    return registry()[name]


def _series():
    return Window.partitionBy("stock_code").orderBy("trade_date")


def _running(rows: DataFrame, tiling: str, shift: int) -> DataFrame:
    """Adds running sums of a tiling: ``{tiling}n`` closes, ``{tiling}p`` rows with both, sums and products about the block's first values."""
    block, place = F.floor((F.col("_row") + shift) / RESTART), F.pmod(F.col("_row") + shift, F.lit(RESTART))
    own = Window.partitionBy("stock_code", f"{tiling}block").orderBy("trade_date")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"{tiling}block": block, f"{tiling}at": place})
    first = {f"{tiling}c0": F.first("close_price", True).over(upto), f"{tiling}v0": F.first(F.col("volume").cast("double"), True).over(upto)}
    # The first values stand once the block has any; rows before that are null and add nothing.
    rows = rows.withColumns(first)
    c, v = F.col("close_price") - F.col(f"{tiling}c0"), F.col("volume").cast("double") - F.col(f"{tiling}v0")
    sums = {"n": F.when(c.isNotNull(), 1), "p": F.when(c.isNotNull() & v.isNotNull(), 1), "c": c, "v": v, "cc": c * c, "vv": v * v, "cv": c * v, "dc": F.col("_turn_c"), "dv": F.col("_turn_v")}
    return rows.withColumns({f"{tiling}{k}": F.coalesce(F.sum(x).over(upto), F.lit(0)) for k, x in sums.items()})


def _windowed(w: int, name: str, both: dict[str, Column]) -> Column:
    """The sum over the last ``w`` rows: of the first tiling where its block holds them all, else of the second."""
    return F.when(F.col("_a_at") >= w - 1, both[f"_a_{name}"]).otherwise(both[f"_b_{name}"])


def technical(bars: DataFrame) -> DataFrame:
    """Adds the 25 price features; inputs stay as they are."""
    o, h, l, c = (F.col(f"{x}_price") for x in ("open", "high", "low", "close"))
    shape = dict(zip(SHAPES, (c - o, h - l, h - F.greatest(o, c), F.least(o, c) - l, 2 * c - h - l)))
    out = {k: F.try_divide(v, o) for k, v in shape.items()}
    series = _series()
    # A turn is a row whose value is not the one before: a window is constant if it has none after its first row.
    turns = {f"_turn_{k}": F.when(F.col(x).eqNullSafe(F.lag(x).over(series)), 0).otherwise(1) for k, x in (("c", "close_price"), ("v", "volume"))}
    rows = bars.withColumns({"_row": F.row_number().over(series) - 1} | turns)
    for tiling, shift in (("_a_", 0), ("_b_", RESTART // 2)):
        rows = _running(rows, tiling, shift)
    names = ("n", "p", "c", "v", "cc", "vv", "cv", "dc", "dv")
    over = "OVER (PARTITION BY stock_code ORDER BY trade_date)"
    before = [f"lag(close_price, {k}) {over} AS _lag{k}" for k in range(1, max(WINDOWS) + 1)]
    for w in WINDOWS:
        # Turns count after the window's first row: one row less.
        before += [f"lag({t}{k}, {w - 1 if k in ('dc', 'dv') else w}) {over} AS {t}{k}_{w}" for t in ("_a_", "_b_") for k in names]
    rows = rows.selectExpr("*", *before)
    # How many of the rows before are less or the same, window by window: each goes on from the shorter one's.
    for kind, sign in (("less", "<"), ("same", "=")):
        shorter, done = "0" if kind == "less" else "1", 1
        for w in WINDOWS:
            rows = rows.selectExpr("*", " + ".join([shorter, *[f"IF(_lag{k} {sign} close_price, 1, 0)" for k in range(done, w)]]) + f" AS _{kind}{w}")
            shorter, done = f"_{kind}{w}", w
    for w in WINDOWS:
        gone = lambda t, k, least: F.when(F.col(f"{t}at") >= least, F.col(f"{t}{k}_{w}")).otherwise(0)
        both = {f"{t}{k}": F.col(f"{t}{k}") - gone(t, k, w - 1 if k in ("dc", "dv") else w) for t in ("_a_", "_b_") for k in names}
        n, pairs, sc, sv, scc, svv, scv, turned_c, turned_v = (_windowed(w, k, both) for k in names)
        centre = F.when(F.col("_a_at") >= w - 1, F.col("_a_c0")).otherwise(F.col("_b_c0"))
        spread_c, spread_v = scc - sc * sc / w, svv - sv * sv / w
        out[f"ROC_{w}"] = F.try_divide(c, F.col(f"_lag{w}")) - 1
        out[f"MA_{w}"] = F.when(n == w, F.try_divide(centre + sc / w, c) - 1)
        deviation = F.when(turned_c == 0, 0.0).otherwise(F.sqrt(F.greatest(spread_c, F.lit(0.0)) / (w - 1)))
        out[f"STD_{w}"] = F.when(n == w, F.try_divide(deviation, c))
        out[f"RANK_{w}"] = F.when(n == w, (F.col(f"_less{w}") + (F.col(f"_same{w}") + 1) / 2) / w)
        moves = (turned_c > 0) & (turned_v > 0) & (spread_c > 0) & (spread_v > 0)
        out[f"CORR_{w}"] = F.when((pairs == w) & moves, finite(F.try_divide(scv - sc * sv / w, F.sqrt(spread_c) * F.sqrt(spread_v))))
    return rows.select(*bars.columns, *[v.alias(k) for k, v in out.items()])


def selected(panel: DataFrame, label: str) -> tuple[DataFrame, list[str]]:
    """Rows with the label, and the registered features in the panel's order; raw prices and volumes are none."""
    return panel.filter(F.col(label).isNotNull()), [c for c in panel.columns if c in registry()]


def monotone(names: list[str]) -> list[int]:
    """1 for features derived from prices, 0 for frozen ones; an unknown name is an error."""
    return [int(classify(n) == "PRICE_DERIVED") for n in names]


def supply_demand(flows: DataFrame) -> DataFrame:
    """Adds the 15 flow features, over the flow table's own rows; sums are differences of running sums, exact for whole numbers."""
    series = _series()
    upto = series.rowsBetween(Window.unboundedPreceding, 0)
    rows = flows
    for i in INVESTORS:
        name = f"{i}_net_value"
        rows = rows.withColumns({f"_{i}_n": F.count(name).over(upto), f"_{i}_s": F.coalesce(F.sum(name).over(upto), F.lit(0))})
    out = {}
    for i in INVESTORS:
        out[f"{i}_net_ratio"] = F.try_divide(F.col(f"{i}_net_value").cast("double"), F.col("total_trading_value").cast("double"))
        for w in WINDOWS:
            own = lambda k: F.col(f"_{i}_{k}") - F.lag(f"_{i}_{k}", w, 0).over(series)  # noqa: E731, B023
            out[f"{i}_net_cum_{w}"] = F.when(own("n") == w, own("s"))
    return rows.select(*flows.columns, *[v.alias(k) for k, v in out.items()])
