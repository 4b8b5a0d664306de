"""Look-ups on the expanded calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def next_open(rows: DataFrame, expanded: DataFrame, column: str = "start", bound: str = "bound") -> DataFrame:
    """Adds ``next_open``: the first open day after the date, or null where it lies past the row's bound.

    ``rows`` have ``calendar_code``, the date and the bound. Dates outside the calendar and null dates or bounds give null.
    """
    after = F.broadcast(expanded).select("calendar_code", F.col("cal_date").alias(column), F.col("next_open_excl").alias("_next"))
    found = rows.join(after, ["calendar_code", column], "left")
    return found.withColumn("next_open", F.when(F.col("_next") <= F.col(bound), F.col("_next"))).drop("_next")


def nth_open(rows: DataFrame, expanded: DataFrame, n: int, column: str = "start") -> DataFrame:
    """Adds ``nth_open``: the n-th open day on or after the date, which counts if it is open itself.

    ``rows`` have ``calendar_code`` and the date. Dates outside the calendar, null dates and places past its
    end give null; n below 1 is an error. The calendar has one row per civil day.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    cal = F.broadcast(expanded)
    at = cal.select("calendar_code", F.col("cal_date").alias(column), (F.col("idx_incl") + n - F.col("is_open").cast("int")).alias("_at"))
    opened = cal.filter("is_open").select("calendar_code", F.col("idx_incl").alias("_at"), F.col("cal_date").alias("nth_open"))
    return rows.join(at, ["calendar_code", column], "left").join(opened, ["calendar_code", "_at"], "left").drop("_at")
