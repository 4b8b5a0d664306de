"""Activation logs as append-only tables: current rows, rollbacks, promotions, digests, run gauges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COMBO = ("market", "horizon", "algorithm")


def activated(log: DataFrame) -> DataFrame:
    """Rows that may become active: merged, and past their gate."""
    return log.filter("merged AND gate_passed")


def current(log: DataFrame, keys: tuple[str, ...] = COMBO) -> DataFrame:
    """The newest row of each key; of equal times, the later training date."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("promoted_at"), F.desc("trained_date"))
    return log.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def rolled_back(log: DataFrame, versions: DataFrame, at: str) -> DataFrame:
    """A new row per key that points at the version before the current one and remembers where it came from.

    Keys without an older version are an error.
    """
    now = current(log)
    older = versions.select(*COMBO, F.col("trained_date").alias("_older"))
    found = now.join(older, [*COMBO], "left").groupBy(*COMBO, "trained_date").agg(F.max(F.when(F.col("_older") < F.col("trained_date"), F.col("_older"))).alias("_to"))
    target = F.when(F.col("_to").isNotNull(), F.col("_to")).otherwise(F.raise_error(F.lit("no older version")).cast("date"))
    basis = F.create_map(F.lit("rollback_from_trained_date"), F.col("trained_date").cast("string"))
    return found.select(*COMBO, target.alias("trained_date"), F.lit(at).cast("date").alias("promoted_at"), basis.alias("basis"))


def dangling(active_log: DataFrame, versions: DataFrame) -> DataFrame:
    """Current activations whose version is no longer active (``archive_month`` set, or unknown)."""
    kept = versions.filter("archive_month IS NULL").select(*COMBO, "trained_date")
    return current(active_log).join(kept, [*COMBO, "trained_date"], "left_anti")


def persisted(champions: DataFrame) -> DataFrame:
    """The artifacts to keep of each champion: both models for an ensemble, else the champion's own."""
    both = F.array(F.lit("lightgbm"), F.lit("xgboost"))
    rows = champions.filter("champion IS NOT NULL")
    return rows.select("market", "horizon", F.explode(F.when(F.col("champion") == "ensemble", both).otherwise(F.array("champion"))).alias("algorithm"))


def saved_combos(artifacts: DataFrame) -> DataFrame:
    """Distinct combinations; quantile models belong to lightgbm."""
    name = F.when(F.col("algorithm") == "quantile", "lightgbm").otherwise(F.col("algorithm"))
    return artifacts.select("market", "horizon", name.alias("algorithm")).distinct()


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``file_name, digest`` of the files under a path; contents stay in their tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.sha2("content", 256).alias("digest"))


def artifact_digests(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Adds the stored digest of each version; null where the manifest has none."""
    return rows.join(manifest.select(*COMBO, "trained_date", "digest"), [*COMBO, "trained_date"], "left")


def applied(verdicts: DataFrame, manifest: DataFrame, at: str, merged: bool = True) -> DataFrame:
    """New activations of promoted challengers, with their basis; none where the change was not merged.

    ``verdicts``: combination, trained_date, rank_ic, champion_rank_ic, promoted.
    """
    won = artifact_digests(verdicts.filter(F.col("promoted") & F.lit(merged)), manifest)
    gain = (F.col("rank_ic") - F.col("champion_rank_ic")).cast("string")
    basis = F.create_map(F.lit("rank_ic_gain"), gain, F.lit("digest"), F.coalesce("digest", F.lit("")))
    return won.select(*COMBO, "trained_date", F.lit(at).cast("date").alias("promoted_at"), basis.alias("basis"))


def strategies(log: DataFrame) -> DataFrame:
    """The active strategy of each market and horizon, whatever models are active."""
    return current(activated(log), ("market", "horizon")).drop("merged", "gate_passed")


def activations_of(champions: DataFrame, versions: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """From the champions: new rows of the activation log, of the newest version of each artifact to keep, and of the strategy log.

    A combination without a champion, or an artifact without a version, adds no row.
    """
    newest = versions.groupBy(*COMBO).agg(F.max("trained_date").alias("trained_date"))
    models = persisted(champions).join(newest, [*COMBO]).withColumn("promoted_at", F.lit(at).cast("date"))
    chosen = champions.filter("champion IS NOT NULL").select("market", "horizon", F.col("champion").alias("strategy"), F.lit(at).cast("date").alias("promoted_at"))
    return models, chosen


def integrity(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """State of each expected or found file: ok, changed, missing or unexpected."""
    both = manifest.withColumnRenamed("digest", "_want").join(found.withColumnRenamed("digest", "_have"), "file_name", "full")
    state = F.when(F.col("_want").isNull(), "unexpected").when(F.col("_have").isNull(), "missing").when(F.col("_want") == F.col("_have"), "ok").otherwise("changed")
    return both.select("file_name", state.alias("state"))


def gauges(runs: DataFrame) -> DataFrame:
    """By stage: time of the last success only, and the newest value."""
    return runs.groupBy("stage").agg(F.max(F.when(F.col("outcome") == "success", F.col("at"))).alias("last_success"), F.max_by("value", F.struct("at", "run_id")).alias("latest"))


def batches(codes: DataFrame, keys: tuple[str, ...], size: int = 25) -> DataFrame:
    """Distinct stock codes of each key in batches; the last may be smaller, none is empty."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("stock_code"))
    rows = codes.select(*keys, "stock_code").distinct().withColumn("batch", F.floor((n - 1) / size).cast("int"))
    grouped = rows.groupBy(*keys, "batch").agg(F.array_sort(F.collect_list("stock_code")).alias("codes"))
    return grouped.select(*keys, "batch", F.array_join("codes", ",").alias("stock_codes"))
