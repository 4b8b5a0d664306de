"""Append-only logs in storage: versions with an expected number, appends that repeat nothing, state read back.

A version is a Parquet folder and a commit file that names it. The commit file is created only if it is not there, so of two
writers of the same version one fails. A run that is repeated finds its own commit and adds nothing.
A writer that dies before its commit leaves a folder that no reader sees.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionConflict(RuntimeError):
    """Another writer has made the expected version, or the log is not as far as expected."""


def _place(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def commits(spark: SparkSession, path: str) -> list[tuple[int, str, str]]:
    """``version, run_id, folder`` in order; one for each append."""
    target, files = _place(spark, f"{path}/commits")
    if not files.exists(target):
        return []
    rows = spark.read.text(f"{path}/commits").collect()
    found = [json.loads(r["value"]) for r in rows if r["value"]]
    return sorted((c["version"], c["run_id"], c["folder"]) for c in found)


def append(rows: DataFrame, path: str, run_id: str, expected: int) -> int:
    """Adds the rows as version ``expected``; returns the version that holds the run's rows.

    The first version is 0. A run that is in the log already adds nothing, whatever it expects; any other
    append that expects a version which is there, or leaves one out, is a ``VersionConflict``.
    """
    spark, known = rows.sparkSession, commits(rows.sparkSession, path)
    for version, own, _ in known:
        if own == run_id:
            return version
    if expected != len(known):
        raise VersionConflict(f"the log is at version {len(known)}, the writer expects {expected}")
    folder = f"rows-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{folder}")
    target, files = _place(spark, f"{path}/commits/{expected:08d}.json")
    text = json.dumps({"version": expected, "run_id": run_id, "folder": folder})
    try:
        out = files.create(target, False)
    except Exception as error:  # the JVM's file-exists error has no Python class
        if files.exists(target):
            raise VersionConflict(f"version {expected} was written meanwhile") from error
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return expected


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of the log with their ``version``; none where nothing was appended."""
    parts = [spark.read.schema(schema).parquet(f"{path}/{folder}").withColumn("version", F.lit(version)) for version, _, folder in commits(spark, path)]
    out = spark.createDataFrame([], schema).withColumn("version", F.lit(0))
    for part in parts:
        out = out.unionByName(part)
    return out
