"""Purged walk-forward folds: index arithmetic on a date axis and broadcast range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def date_axis(panel: DataFrame) -> DataFrame:
    """Distinct dates with their number from 0; as many rows as trading days, so one task may number them."""
    days = panel.select("trade_date").distinct()
    return days.select("trade_date", (F.row_number().over(Window.orderBy("trade_date")) - 1).alias("idx"))


def initial_train_end(n: int, years: int = 10, days: int = 252) -> int:
    """Where the first fold's history ends so that so many years of folds follow; at least 1."""
    return max(n - years * days, 1)


def purged_split(spark: SparkSession, n: int, gap: int, ratios=(0.70, 0.15, 0.15)) -> DataFrame:
    """Half-open train, val and test ranges with a purge gap between them; rounding is half to even."""
    if abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("ratios must sum to 1")
    left = n - 2 * gap
    train, val = round(left * ratios[0]), round(left * ratios[1])
    bounds = [0, train, train + gap, train + gap + val, train + 2 * gap + val, n]
    if min(train, val, bounds[5] - bounds[4]) <= 0:
        raise ValueError("a part is empty")
    return spark.createDataFrame([tuple(bounds)], "train_start int, train_end int, val_start int, val_end int, test_start int, test_end int")


def weekly_folds(axis: DataFrame, gap: int, train_end: int, size: int, reserve: int | None = None, count: int | None = None) -> DataFrame:
    """Folds that advance by their validation size, as dates; the last upper bound may be open (null).

    ``reserve`` days stay free after the initial history: twice the gap, or the largest of several horizons
    that share a number of folds. There are as many folds as fit, or ``count``; sizes below 1, a negative gap and an axis
    too short for ``count`` folds are errors.
    """
    for name, value, least in (("train_end", train_end, 1), ("size", size, 1), ("gap", gap, 0), ("count", 1 if count is None else count, 1)):
        if value < least:
            raise ValueError(f"{name} must be at least {least}")
    if count is not None:
        days = axis.count()  # bounded by the calendar
        if train_end + (count - 1) * size + gap > days:
            raise ValueError(f"{days} days are too few for {count} folds")
        return _dated(axis.sparkSession.range(count).select(F.col("id").cast("int").alias("fold_index")), axis, gap, train_end, size)
    n = axis.agg(F.count(F.lit(1)).alias("n"))
    room = F.greatest(F.floor((F.col("n") - train_end - (2 * gap if reserve is None else reserve)) / size), F.lit(0)).cast("int")
    folds = n.select(F.explode(F.when(room > 0, F.sequence(F.lit(0), room - 1)).otherwise(F.array().cast("array<int>"))).alias("fold_index"))
    return _dated(folds, axis, gap, train_end, size)


def _dated(folds: DataFrame, axis: DataFrame, gap: int, train_end: int, size: int) -> DataFrame:
    """Bounds of the folds by their number, as dates of the axis."""
    folds = folds.withColumn("a", F.lit(train_end) + F.col("fold_index") * size).withColumns({"v": F.col("a") + gap, "z": F.col("a") + gap + size})
    for at, name in (("a", "train_end"), ("v", "val_start"), ("z", "val_end")):
        folds = folds.join(F.broadcast(axis.select(F.col("idx").alias(at), F.col("trade_date").alias(name))), at, "left").drop(at)
    return folds


def expanding_folds(spark: SparkSession, n: int, gap: int, n_folds: int, size: int, test_ratio: float = 0.15) -> DataFrame:
    """Half-open ranges of folds that grow from row 0 and share one test tail; rounding is half to even.

    The last validation range ends one gap before the tail, and each fold starts its own a gap after
    its train rows, so neighbours lie ``gap + size`` apart.
    """
    if min(n_folds, size) < 1:
        raise ValueError("folds and their size must be at least 1")
    test, step = n - round(n * test_ratio), gap + size
    first = test - gap - n_folds * step
    if first <= 0:
        raise ValueError("too few rows for these folds")
    train = F.lit(first) + F.col("id") * step
    columns = {"fold_index": F.col("id"), "train_start": F.lit(0), "train_end": train, "val_start": train + gap, "val_end": train + step, "test_start": F.lit(test), "test_end": F.lit(n)}
    return spark.range(n_folds).select(*[c.cast("int").alias(k) for k, c in columns.items()])


def sizes(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """``fold_index, role, n``: how many rows each fold has, from the number of rows before its dates.

    One aggregate by day; folds are looked up by equal dates, since their bounds lie on the axis.
    """
    # As many rows as trading days, so one task may sum them.
    daily = panel.groupBy("trade_date").agg(F.count(F.lit(1)).alias("own"))
    upto = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    before = daily.withColumn("before", F.sum("own").over(upto) - F.col("own"))
    total = daily.agg(F.sum("own").alias("total"))
    out = folds
    for name in ("train_end", "val_start", "val_end"):
        out = out.join(F.broadcast(before.select(F.col("trade_date").alias(name), F.col("before").alias(f"n_{name}"))), name, "left")
    out = out.join(F.broadcast(total), F.lit(True))
    val = F.when(F.col("val_end").isNull(), F.col("total")).otherwise(F.col("n_val_end")) - F.col("n_val_start")
    each = F.explode(F.array(F.struct(F.lit("train").alias("role"), F.col("n_train_end").alias("n")), F.struct(F.lit("val").alias("role"), val.alias("n"))))
    return out.select("fold_index", each.alias("x")).select("fold_index", "x.role", "x.n").filter("n > 0")


def final_train_window(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """The rows that the last fold trains on; none where there is no fold."""
    last = folds.agg(F.max_by("train_end", "fold_index").alias("_end"))
    return panel.join(F.broadcast(last), F.col("trade_date") < F.col("_end")).drop("_end")


def on_axis(bounds: DataFrame, axis: DataFrame) -> DataFrame:
    """Index bounds (``train_end, val_start, val_end``) as dates; past the end only the last may lie (null)."""
    out = bounds
    for name in ("train_end", "val_start", "val_end"):
        out = out.withColumnRenamed(name, "_at").join(F.broadcast(axis.select(F.col("idx").alias("_at"), F.col("trade_date").alias(name))), "_at", "left").drop("_at")
        if name != "val_end":
            out = out.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.lit(f"{name} is past the end")).cast("date")).otherwise(F.col(name)))
    return out


def slices(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """Panel rows by fold and role; rows in the purge gap have neither. For few folds: each repeats its history."""
    role = F.when(F.col("trade_date") < F.col("train_end"), "train").when(
        (F.col("trade_date") >= F.col("val_start")) & (F.col("val_end").isNull() | (F.col("trade_date") < F.col("val_end"))), "val"
    )
    return panel.join(F.broadcast(folds), F.lit(True)).withColumn("role", role).filter("role IS NOT NULL")
