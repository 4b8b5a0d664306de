"""Market-panel inputs projected from the given tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockloom.sources import sinks

HALT = ("1998-03-02", "1998-04-15")
DELISTED = "2000-06-30"
#: Exchanges of each market.
EXCHANGES = {"domestic": ("KOSPI", "KOSDAQ"), "overseas": ("NYSE", "NASDAQ", "AMEX")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trades of a stock (the part's brand) at a unit price."""
    # The brand's number is taken from each part, not from each of its line items.
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("stock_code"), brand.alias("b"))
    lines = table(spark, sf_dir, "lineitem").join(part, "l_partkey")
    return lines.select(
        "stock_code", "b", F.to_date("l_shipdate").alias("trade_date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("quantity"), "l_extendedprice", "l_returnflag", "l_linestatus",
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("k"),
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices, volume and net values of every stock and day with trades: one pass over the trades."""
    cents = F.round(F.col("l_extendedprice")).cast("long")
    foreign = F.when(F.col("l_returnflag") == "A", cents).when(F.col("l_returnflag") == "R", -cents).otherwise(F.lit(0).cast("long"))
    return trades(spark, sf_dir).groupBy("stock_code", "b", "trade_date").agg(
        F.min_by("price", "k").alias("open_price"), F.max("price").alias("high_price"), F.min("price").alias("low_price"),
        F.max_by("price", "k").alias("close_price"), F.sum("quantity").cast("long").alias("volume"),
        F.sum(foreign).alias("foreign_net_value"), F.sum(F.when(F.col("l_linestatus") == "O", cents).otherwise(-cents)).alias("institution_net_value"), F.sum(cents).alias("total"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_of(daily(spark, sf_dir))


def bars_of(rows: DataFrame) -> DataFrame:
    """Daily bars on weekdays, with forced halts and delistings."""
    rows = rows.filter(F.dayofweek("trade_date").between(2, 6))
    rows = rows.select("stock_code", "b", "trade_date", "open_price", "high_price", "low_price", "close_price", "volume")
    halted = (F.col("b") % 6 == 0) & F.col("trade_date").between(F.lit(HALT[0]).cast("date"), F.lit(HALT[1]).cast("date"))
    gone = (F.col("b") % 5 == 0) & (F.col("trade_date") >= F.lit(DELISTED).cast("date"))
    return rows.filter(~halted & ~gone)


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar_of(table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("trade_date")))


def calendar_of(rows: DataFrame) -> DataFrame:
    """Every civil day of the two calendars between the first and the last trade, 0/1 open."""
    days = rows.agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("z"))
    days = days.select(F.explode(F.sequence("a", "z")).alias("cal_date")).withColumn("weekday", F.dayofweek("cal_date").between(2, 6))
    krx = days.select(F.lit("KRX").alias("calendar_code"), "cal_date", (F.col("weekday") & (F.dayofmonth("cal_date") != 1)).cast("int").alias("is_open"))
    return krx.unionByName(days.select(F.lit("NYSE").alias("calendar_code"), "cal_date", F.col("weekday").cast("int").alias("is_open")))


def corp_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_of(bars(spark, sf_dir))


def events_of(given: DataFrame) -> DataFrame:
    """Splits and dividends on bar days chosen by arithmetic; some dividends have no cash amount."""
    rows = given.select("stock_code", "b", "trade_date", F.datediff("trade_date", F.lit("1995-01-01").cast("date")).alias("days"))
    none = lambda t: F.lit(None).cast(t)
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))
    splits = rows.filter((F.col("b") * 31 + F.col("days")) % 211 == 0).select(
        "stock_code", "b", F.lit("SPLIT").alias("event_type"), F.col("trade_date").alias("event_date"), pick([2.0, 4.0, 0.5, 5.0], F.col("b")).alias("stock_rate"),
        none("double").alias("cash_amount"), none("string").alias("event_subtype"), none("date").alias("ex_dividend_date"), none("string").alias("currency_code"),
    )
    right = F.when(F.col("b") <= 13, "KRW").otherwise("USD")
    dividends = rows.filter((F.col("b") * 17 + F.col("days")) % 173 == 0).select(
        "stock_code", "b", F.lit("DIVIDEND").alias("event_type"), F.col("trade_date").alias("event_date"), none("double").alias("stock_rate"),
        F.when(F.col("days") % 13 != 0, pick([0.0, 5.0, 10.0, 2.0], F.col("b") + F.col("days"))).alias("cash_amount"),
        F.when(F.col("days") % 7 == 0, none("string")).when(F.col("days") % 7 == 1, "").otherwise("annual").alias("event_subtype"),
        F.when(F.col("b") % 2 == 0, none("date")).otherwise(F.col("trade_date")).alias("ex_dividend_date"),
        F.when(F.col("days") % 11 == 0, "EUR").otherwise(right).alias("currency_code"),
    )
    return splits.unionByName(dividends)


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brands with grade, market and delisting date."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("stock_code")).distinct()
    b = F.regexp_extract("stock_code", r"(\d+)", 1).cast("int")
    brands = brands.withColumn("b", b)
    grade = F.when(F.col("b") == 23, F.lit(None)).when(F.col("b") % 4 == 1, "B").when(F.col("b") % 4 == 2, "C").otherwise("A")
    return brands.select(
        "stock_code", grade.alias("grade"), F.when(F.col("b") <= 13, "domestic").otherwise("overseas").alias("market"),
        F.when(F.col("b") % 5 == 0, F.lit(DELISTED).cast("date")).alias("delisted_at"),
    )


def stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brands as listings: exchange and kind of asset; brand numbers that 9 divides are funds."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("stock_code")).distinct()
    b = F.regexp_extract("stock_code", r"(\d+)", 1).cast("int")
    pick = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), (b % len(names) + 1).cast("int"))
    exchange = F.when(b <= 13, pick(EXCHANGES["domestic"])).otherwise(pick(EXCHANGES["overseas"]))
    return brands.select("stock_code", exchange.alias("exchange"), F.when(b % 9 == 0, "ETF").otherwise("STOCK").alias("asset_type"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows_of(daily(spark, sf_dir))


def flows_of(rows: DataFrame) -> DataFrame:
    """Net values by investor and the day's total."""
    days = F.datediff("trade_date", F.lit("1995-01-01").cast("date"))
    return rows.select(
        "stock_code", "trade_date", "foreign_net_value", "institution_net_value", (-(F.col("foreign_net_value") + F.col("institution_net_value"))).alias("individual_net_value"),
        F.when(days % 97 == 0, F.lit(0).cast("long")).otherwise(F.col("total")).alias("total_trading_value"),
    )


@dataclass(frozen=True)
class Market:
    """What the panel operators read; all of it follows from one written table of daily rows."""

    bars: DataFrame
    events: DataFrame
    expanded: DataFrame
    universe: DataFrame
    flows: DataFrame


def market(spark: SparkSession, sf_dir: str) -> Market:
    """The inputs of a query: trades are read once, bars and events are written before they are used several times."""
    rows = sinks.stored(daily(spark, sf_dir), "daily")
    own = bars_of(rows)
    return Market(own, sinks.stored(events_of(own), "events"), sinks.stored(expanded(calendar_of(rows)), "calendar"), universe(spark, sf_dir), flows_of(rows))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' scores, returns, quantiles and confidence; ``k`` orders the rows."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        F.when(F.col("l_suppkey") % 2 == 0, "domestic").otherwise("overseas").alias("market"), F.when(F.col("l_partkey") % 2 == 0, 20).otherwise(60).alias("horizon"),
        (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("fold_index"), (F.col("l_discount") - 0.05).alias("score_a"), (F.col("l_tax") - 0.04).alias("score_b"),
        (((F.col("l_orderkey") * 7 + F.col("l_partkey")) % 201 - 100) / 1000.0).alias("ret"), ((F.col("l_suppkey") % 7 - 5) / 100.0).alias("p10"),
        ((F.col("l_linenumber") % 5 - 1) / 100.0).alias("p90"), (F.col("l_quantity") / 50.0).alias("confidence"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("k"),
    )


def expanded(cal: DataFrame) -> DataFrame:
    """Every civil day with the open-day index and the open days around it: turns as-of look-ups into equi-joins."""
    past = Window.partitionBy("calendar_code").orderBy("cal_date").rowsBetween(Window.unboundedPreceding, 0)
    future = Window.partitionBy("calendar_code").orderBy(F.desc("cal_date")).rowsBetween(Window.unboundedPreceding, 0)
    is_open = F.col("is_open").cast("boolean")
    day = F.when(is_open, F.col("cal_date"))
    return cal.select(
        "calendar_code", "cal_date", is_open.alias("is_open"), F.sum(is_open.cast("int")).over(past).cast("int").alias("idx_incl"),
        F.max(day).over(past).alias("prev_open_incl"), F.max(day).over(past.rowsBetween(Window.unboundedPreceding, -1)).alias("prev_open_excl"),
        F.min(day).over(future).alias("next_open_incl"), F.min(day).over(future.rowsBetween(Window.unboundedPreceding, -1)).alias("next_open_excl"),
    )


_B = "CAST(regexp_extract({c}, '(\\d+)', 1) AS INTEGER)"
#: Common table expressions of the projections, in order of use.
SQL = {
    "trades": f"SELECT p_brand AS stock_code, {_B.format(c='p_brand')} AS b, CAST(l_shipdate AS DATE) AS trade_date, l_extendedprice / l_quantity AS price, l_quantity AS quantity, l_extendedprice, "
    "l_returnflag, l_linestatus, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem JOIN part ON p_partkey = l_partkey",
    "all_bars": "SELECT stock_code, b, trade_date, arg_min(price, k) AS open_price, max(price) AS high_price, min(price) AS low_price, arg_max(price, k) AS close_price, CAST(sum(quantity) AS BIGINT) AS volume "
    f"FROM trades WHERE isodow(trade_date) <= 5 AND NOT (b % 6 = 0 AND trade_date BETWEEN '{HALT[0]}' AND '{HALT[1]}') AND NOT (b % 5 = 0 AND trade_date >= '{DELISTED}') GROUP BY ALL",
    "bars": "SELECT * FROM all_bars",
    "days": "SELECT CAST(unnest(generate_series(min(CAST(l_shipdate AS DATE)), max(CAST(l_shipdate AS DATE)), INTERVAL 1 DAY)) AS DATE) AS cal_date FROM lineitem",
    "cal": "SELECT 'KRX' AS calendar_code, cal_date, CAST(isodow(cal_date) <= 5 AND day(cal_date) <> 1 AS INTEGER) AS is_open FROM days UNION ALL SELECT 'NYSE', cal_date, CAST(isodow(cal_date) <= 5 AS INTEGER) FROM days",
    "expanded": "SELECT calendar_code, cal_date, is_open = 1 AS is_open, CAST(sum(is_open) OVER p AS INTEGER) AS idx_incl, max(CASE WHEN is_open = 1 THEN cal_date END) OVER p AS prev_open_incl, "
    "max(CASE WHEN is_open = 1 THEN cal_date END) OVER (PARTITION BY calendar_code ORDER BY cal_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_open_excl, "
    "min(CASE WHEN is_open = 1 THEN cal_date END) OVER (PARTITION BY calendar_code ORDER BY cal_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_open_incl, "
    "min(CASE WHEN is_open = 1 THEN cal_date END) OVER (PARTITION BY calendar_code ORDER BY cal_date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_open_excl "
    "FROM cal WINDOW p AS (PARTITION BY calendar_code ORDER BY cal_date)",
    "ev": "SELECT *, CAST(trade_date - DATE '1995-01-01' AS INTEGER) AS days FROM all_bars",
    "corp_events": "SELECT stock_code, b, 'SPLIT' AS event_type, trade_date AS event_date, CASE b % 4 WHEN 0 THEN 2.0 WHEN 1 THEN 4.0 WHEN 2 THEN 0.5 ELSE 5.0 END::DOUBLE AS stock_rate, NULL::DOUBLE AS cash_amount, NULL::VARCHAR AS event_subtype, "
    "NULL::DATE AS ex_dividend_date, NULL::VARCHAR AS currency_code FROM ev WHERE (b * 31 + days) % 211 = 0 UNION ALL SELECT stock_code, b, 'DIVIDEND', trade_date, NULL, CASE WHEN days % 13 <> 0 THEN CASE (b + days) % 4 WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 10 ELSE 2 END END::DOUBLE, "
    "CASE days % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'annual' END, CASE WHEN b % 2 = 0 THEN NULL ELSE trade_date END, CASE WHEN days % 11 = 0 THEN 'EUR' WHEN b <= 13 THEN 'KRW' ELSE 'USD' END FROM ev WHERE (b * 17 + days) % 173 = 0",
    "universe": f"SELECT stock_code, CASE WHEN b = 23 THEN NULL WHEN b % 4 = 1 THEN 'B' WHEN b % 4 = 2 THEN 'C' ELSE 'A' END AS grade, CASE WHEN b <= 13 THEN 'domestic' ELSE 'overseas' END AS market, "
    f"CASE WHEN b % 5 = 0 THEN DATE '{DELISTED}' END AS delisted_at FROM (SELECT DISTINCT p_brand AS stock_code, {_B.format(c='p_brand')} AS b FROM part)",
    "fl": "SELECT stock_code, trade_date, CAST(sum(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END * CAST(round(l_extendedprice) AS BIGINT)) AS BIGINT) AS foreign_net_value, "
    "CAST(sum(CASE l_linestatus WHEN 'O' THEN 1 ELSE -1 END * CAST(round(l_extendedprice) AS BIGINT)) AS BIGINT) AS institution_net_value, CAST(sum(CAST(round(l_extendedprice) AS BIGINT)) AS BIGINT) AS total FROM trades GROUP BY ALL",
    "stocks": f"SELECT stock_code, CASE WHEN b <= 13 THEN {list(EXCHANGES['domestic'])}[b % 2 + 1] ELSE {list(EXCHANGES['overseas'])}[b % 3 + 1] END AS exchange, CASE WHEN b % 9 = 0 THEN 'ETF' ELSE 'STOCK' END AS asset_type "
    f"FROM (SELECT DISTINCT p_brand AS stock_code, {_B.format(c='p_brand')} AS b FROM part)",
    "flows": "SELECT stock_code, trade_date, foreign_net_value, institution_net_value, -(foreign_net_value + institution_net_value) AS individual_net_value, "
    "CASE WHEN CAST(trade_date - DATE '1995-01-01' AS INTEGER) % 97 = 0 THEN 0 ELSE total END AS total_trading_value FROM fl",
    "scores": "SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'domestic' ELSE 'overseas' END AS market, CASE WHEN l_partkey % 2 = 0 THEN 20 ELSE 60 END AS horizon, CAST(year(CAST(l_shipdate AS DATE)) * 12 + month(CAST(l_shipdate AS DATE)) AS INTEGER) AS fold_index, "
    "l_discount - 0.05::DOUBLE AS score_a, l_tax - 0.04::DOUBLE AS score_b, ((l_orderkey * 7 + l_partkey) % 201 - 100) / 1000.0::DOUBLE AS ret, (l_suppkey % 7 - 5) / 100.0::DOUBLE AS p10, (l_linenumber % 5 - 1) / 100.0::DOUBLE AS p90, "
    "l_quantity / 50.0::DOUBLE AS confidence, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem",
}
_NEEDS = {
    "all_bars": ["trades"], "bars": ["all_bars"], "cal": ["days"], "expanded": ["cal"], "ev": ["all_bars"], "corp_events": ["ev", "bars"], "fl": ["trades"], "flows": ["fl"],
}


def sql(select: str, *names: str, **more: str) -> str:
    """A query over the named projections, with further expressions in order."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        done.setdefault(name, SQL[name])

    for n in names:
        add(n)
    done |= more
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in done.items()) + "\n" + select
