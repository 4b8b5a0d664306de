"""What the training-data operators share: the cluster's folder, written tables, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch that goes to Python; documents may be 100,000 characters long.
ARROW_ROWS = 400
#: Bytes of text that Python takes from a batch at a time, unless one text is longer.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder of the cluster, ``spark.checkpoint.dir``.

    Where that setting is absent, a local session (tests) gets the session's checkpoint folder or
    one under the warehouse; on a cluster its absence is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="stockloom-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, batch_rows: int | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage, survives lost executors.

    ``batch_rows`` bounds the Arrow batches of this write alone.
    """
    with _batches_of(df.sparkSession, batch_rows):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Within it the session's Arrow batches hold at most so many rows; then its own setting is back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if rows and not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in slices whose texts (the column's) have at most so many bytes together, or of a single row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for at, size in enumerate(sizes.tolist()):
            if at > begin and held + size > most:
                yield batch.slice(begin, at - begin)
                begin, held = at, 0
            held += size
        if begin < batch.num_rows:
            yield batch.slice(begin)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_key(text: str = "text") -> Column:
    """With doc_id it names a row: equal keys mean the same id and the same text."""
    return F.xxhash64(F.col(text))


def as_row(docs: DataFrame) -> DataFrame:
    """The rows as one column ``row`` beside their ``row_key``, so that names added later meet no others."""
    return docs.select(F.struct("*").alias("row"), row_key().alias("row_key"))


def row_columns(docs: DataFrame, **instead: Column) -> list[Column]:
    """The columns of ``docs`` out of ``row``, by the expressions given instead where there are some."""
    return [instead.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
