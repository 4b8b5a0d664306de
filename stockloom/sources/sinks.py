"""Sinks: the panel cache, fold metrics, model metadata and campaign summaries."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAVEAT = "neighbouring folds share nearly all of their training rows"


def cache_path(root: str, market: str, as_of: str, version: str) -> str:
    return f"{root.rstrip('/')}/features_{market}_{as_of}_{version}"


def cached_panel(spark: SparkSession, root: str, market: str, as_of: str, version: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The written panel, or ``build()`` written first; only a finished write counts as a hit."""
    path = cache_path(root, market, as_of, version)
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a new Parquet table in the shared folder, ``spark.checkpoint.dir``; cuts the plan before loops of fits."""
    return written(df, stored_path(df.sparkSession, name))


def clustered(df: DataFrame, name: str, by: str = "trade_date", then: str = "stock_code") -> DataFrame:
    """The rows as a new table whose files hold ranges of ``by``, sorted within: a filter on it reads only the row groups of its range.

    Rows without a value come first.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(parts, by).sortWithinPartitions(by, then), name)


def stored_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; a local session without that setting takes a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="stockloom-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_fold_metrics(metrics: DataFrame, path: str) -> None:
    """One JSON line per fold, in a folder per market, horizon and algorithm; nulls are written."""
    metrics.write.mode("append").partitionBy("market", "horizon", "algorithm").option("ignoreNullFields", "false").json(path)


def model_metadata(aggregates: DataFrame, rows: DataFrame, parameters: dict[str, float], features: list[str], metrics_path: str) -> DataFrame:
    """One record per champion: aggregates, train rows, parameters, features and where its fold metrics are."""
    given = F.create_map(*[F.lit(x) for pair in parameters.items() for x in pair])
    return aggregates.join(rows, ["market", "horizon", "algorithm"], "left").withColumns(
        {"parameters": given, "features": F.array(*[F.lit(f) for f in features]), "fold_metrics": F.lit(metrics_path)}
    )


def campaign_summary(verdicts: DataFrame, champions: DataFrame) -> DataFrame:
    """A line per combination and per market and horizon, with the caveat on overlapping folds."""
    own = verdicts.select(
        "market", "horizon", "algorithm", F.when(F.col("stabilized"), "stabilized").otherwise("not_stabilized").alias("verdict"), F.col("failed_gates").alias("detail")
    )
    chosen = F.when(F.col("deployment_prohibited"), "deployment_prohibited").otherwise(F.concat(F.lit("champion="), F.col("champion")))
    best = champions.select("market", "horizon", F.lit("all").alias("algorithm"), chosen.alias("verdict"), F.coalesce("excluded_artifact", F.lit("")).alias("detail"))
    return own.unionByName(best).withColumn("caveat", F.lit(CAVEAT))


def removed(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
