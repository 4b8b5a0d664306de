"""Model-registry and run-event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: market_horizon_algorithm_date.extension; sidecars and quantile models have further parts and are left out.
NAME = r"^([a-z]+)_(\d+)_([a-z]+)_(\d{4}-\d{2}-\d{2})\.\w+$"
COMBO = ("market", "horizon", "algorithm")


def parsed(names: DataFrame) -> DataFrame:
    """``market, horizon, algorithm, trained_date`` of artifact names; other names are left out."""
    part = lambda i: F.regexp_extract("file_name", NAME, i)
    rows = names.filter(F.col("file_name").rlike(NAME))
    date = F.try_to_date(part(4))
    return rows.select("file_name", part(1).alias("market"), part(2).cast("int").alias("horizon"), part(3).alias("algorithm"), date.alias("trained_date")).filter("trained_date IS NOT NULL")


def file_name(market: Column, horizon: Column, algorithm: Column, date: Column, quantile: Column | None = None) -> Column:
    """The name of a model's file; a quantile model has the quantile in percent after the date."""
    kind = F.when(algorithm == "xgboost", "json").otherwise("txt")
    tag = F.lit("") if quantile is None else F.concat(F.lit("_q"), F.lpad(F.round(quantile * 100).cast("int").cast("string"), 2, "0"))
    return F.concat(market, F.lit("_"), horizon.cast("string"), F.lit("_"), algorithm, F.lit("_"), F.date_format(date, "yyyy-MM-dd"), tag, F.lit("."), kind)


def stale(versions: DataFrame, as_of: Column, days: int = 28) -> DataFrame:
    latest = versions.groupBy(*COMBO).agg(F.max("trained_date").alias("latest"))
    return latest.withColumn("is_stale", F.datediff(as_of, F.col("latest")) > days)


def retention(versions: DataFrame, active: int = 12) -> DataFrame:
    """The newest versions of a combination are active, older ones are archived by month."""
    n = F.row_number().over(Window.partitionBy(*COMBO).orderBy(F.desc("trained_date"), "file_name"))
    return versions.withColumn("archive_month", F.when(n > active, F.date_format("trained_date", "yyyy-MM")))


def stale_gauge(versions: DataFrame, as_of: Column, days: int = 28) -> DataFrame:
    """1 for combinations whose newest version is too old, else 0."""
    return stale(versions, as_of, days).select(*COMBO, F.col("is_stale").cast("int").alias("stale"))


def timings(runs: DataFrame) -> DataFrame:
    """Number, total, mean and longest of each stage's seconds."""
    return runs.groupBy("stage").agg(F.count("seconds").alias("runs"), F.sum("seconds").alias("total"), F.avg("seconds").alias("mean"), F.max("seconds").alias("longest"))


def verdict_outcome(promoted: Column) -> Column:
    """A promoted challenger is a success, any other is held back."""
    return F.when(promoted, "success").otherwise("held-back")


def outcome(event_type: Column) -> Column:
    return F.when(event_type == "error", "failure").when(event_type == "purchase", "success").otherwise("held-back")


def run_counters(events: DataFrame) -> DataFrame:
    """Runs by stage and outcome; works on a stream too."""
    return events.groupBy(F.col("event_type").alias("stage"), outcome(F.col("event_type")).alias("outcome")).agg(F.count(F.lit(1)).alias("runs"))


def stage_markers(lines: DataFrame) -> DataFrame:
    """Messages of the JSON lines whose ``stage_marker`` is true; broken lines are left out."""
    found = F.from_json("value", "stage_marker boolean, message string")
    rows = lines.withColumn("j", found).filter("j.stage_marker")
    return rows.select(F.coalesce("j.message", "value").alias("message"))
