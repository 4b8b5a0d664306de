"""Sums over rows in order that never hold a whole key in one task: rows are dealt to ranges, and ranges are summed up apart."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.sources import sinks


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a range, on average, where their number is known.
RANGE_ROWS = 1 << 19


def before(rows: DataFrame, keys: list[str], by: str, weight: str, most: int = 0) -> DataFrame:
    """Adds ``before``: the weights of the key's rows that come earlier by ``by``, which no two of them share.

    Rows go to ranges of key and ``by``, so a large key lies in many tasks. There are more ranges for more rows, of which there are ``most`` at most.
    """
    parts = max(_parts(rows), -(-most // RANGE_ROWS))
    # Written, since the bounds of the ranges may differ when they are drawn again.
    dealt = sinks.stored(rows.repartitionByRange(parts, *keys, by).withColumn("block", F.spark_partition_id()), "dealt")
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("block", *keys).agg(F.sum(weight).alias("_own"))
    earlier = totals.select("block", *keys, F.sum("_own").over(up_to(Window.partitionBy(*keys).orderBy("block"))).alias("_earlier"))
    within = F.sum(weight).over(up_to(Window.partitionBy("block", *keys).orderBy(by)))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in ("block", *keys)]
    # One row of each range and key that meet; the rows themselves may be many in a file small enough for Spark to broadcast.
    out = dealt.withColumn("_within", within).alias("l").join(F.broadcast(earlier.alias("r")), same)
    count = F.coalesce("_within", F.lit(0)) + F.coalesce("_earlier", F.lit(0))
    return out.select(*[F.col(f"l.{c}").alias(c) for c in rows.columns], count.alias("before"))


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs of positive factors of one key and name, each after at most one factor that is not positive."""
    block = TaskContext.get().partitionId()
    number = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for k in (*keys, "names"):
            c = batch.column(k)
            differs = pc.xor(c.slice(1).is_null(), c.slice(0, len(c) - 1).is_null())
            new[1:] |= pc.or_kleene(pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)), False), differs).to_numpy(zero_copy_only=False)
        bounds = [*np.flatnonzero(new), batch.num_rows]
        factors, out = batch.column("factors"), []
        for a, z in zip(bounds, bounds[1:]):
            names = json.loads(batch.column("names")[a].as_py())
            flat = factors.slice(a, z - a).flatten()
            values = flat.to_numpy(zero_copy_only=False).reshape(z - a, len(names))
            there = flat.is_valid().to_numpy(zero_copy_only=False).reshape(z - a, len(names))
            for i, name in enumerate(names):
                own = values[there[:, i], i]
                cuts = [*np.flatnonzero(np.r_[True, ~(own[1:] > 0)][: len(own)]), len(own)]
                for s, e in zip(cuts, cuts[1:]):
                    size = np.cumprod(np.abs(own[s:e]))
                    top = np.maximum.accumulate(size)
                    worst = np.divide(size, top, out=np.ones(e - s), where=top != 0).min()
                    out.append((a, name, number, float(np.sign(own[s])), size[-1], size.max(), size.min(), worst))
                    number += 1
        if out:
            at, *columns = zip(*out)
            given = [batch.column(k).take(pa.array(at, pa.int32())) for k in keys]
            yield pa.RecordBatch.from_arrays([*given, pa.array([block] * len(at), pa.int32()), *[pa.array(c) for c in columns]], [*keys, "block", *_RUN])


_RUN = {"name": "string", "number": "long", "sign": "double", "size": "double", "top": "double", "low": "double", "worst": "double"}


def drawdowns(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """``keys, name, max_drawdown``: the largest relative fall of a running product below its peak so far.

    ``rows``: the keys, ``by``, and the arrays ``names`` and ``factors`` with a factor for each product; null factors are left out.
    Factors may have any sign. Rows are sorted in ranges of key and ``by``; a task turns each batch into a few rows, a run of
    one sign each, and only these meet by key.
    """
    # By their hash, so that a sort compares numbers; keys that share one end each other's runs and stay right.
    rows = rows.select(*keys, F.to_json("names").alias("names"), "factors", F.xxhash64(*keys, "names").alias("_h"), by)
    dealt = rows.repartitionByRange(_parts(rows), "_h", by).sortWithinPartitions("_h", by)
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "block int", *(f"{k} {t}" for k, t in _RUN.items())])
    runs = dealt.select(*keys, "names", "factors").mapInArrow(lambda batches: _runs(batches, keys), schema)
    earlier = Window.partitionBy(*keys, "name").orderBy("block", "number").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_start", F.coalesce(F.product(F.col("sign") * F.col("size")).over(earlier), F.lit(1.0)))
    start, sign = F.abs("_start"), F.signum("_start") * F.col("sign")
    highest = F.when(sign > 0, start * F.col("top")).when(sign < 0, -start * F.col("low")).otherwise(0.0)
    runs = runs.withColumns({"_size": start, "_sign": sign, "_highest": highest}).withColumn("_peak", F.max("_highest").over(earlier))
    peak, own = F.coalesce("_peak", F.lit(0.0)), F.col("worst")
    up = F.when(peak > 0, F.least(F.col("_size") * F.col("low") / peak, own)).otherwise(own)
    # Below zero a product only falls from a positive peak; while all of it was negative, its first row (0) stays the least.
    down = F.when(peak > 0, -F.col("_size") * F.col("top") / peak).when(F.coalesce("_peak", F.lit(-1.0)) < 0, 1.0)
    share = F.when(F.col("_sign") > 0, up).when(F.col("_sign") < 0, down).when(peak > 0, 0.0)
    return runs.groupBy(*keys, "name").agg(F.abs(F.min(share - 1.0)).alias("max_drawdown"))
