"""Token-ID output: Arrow files of fixed-size-list batches, and random access to them.

Documents are dealt by ranges of ``doc_id``; each task encodes its documents in ascending order and
writes one shard, an Arrow IPC file whose rows are equal-length sequences with a mask. Every batch
but the last of a shard has the same number of rows, so a token's batch, row and column follow from
its position, and a reader maps the file and slices it without copying.

Nulls: a null text is an empty one (only the end id); a null ``doc_id`` sorts first. Rows that share
a ``doc_id`` are ordered by text. Extra columns are ignored. An empty table writes no shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockloom.llm import encoding
from stockloom.llm.common import shared_dir, slices, text_or_empty, written
from stockloom.llm.packing import ALONE_WORDS

ARROW_ROWS = 1500
#: Bytes of text that are encoded together, unless one text is longer: a word that they share is looked up once.
TEXT_BYTES = 1 << 22
#: Ids that a task reads back, and of them those that stay together.
TASK_IDS, RUN_IDS = 1 << 22, 1 << 18

INDEX = "shard string, shard_no long, doc_id long, shard_start long, n_tokens long"
SPANS = "doc_id long, start long, n_tokens long, ids_crc32 long"


@dataclass(frozen=True)
class Format:
    """How ids are laid out: sequence length, rows of a batch, the id that ends a document."""

    length: int = 2048
    batch_rows: int = 256
    end_id: int = 2


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Shard:
    """Writes one Arrow file; ids are kept only until a batch is full."""

    def __init__(self, folder: str, layout: Format, vocabulary_size: int):
        task = TaskContext.get()
        self.name = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.arrow"
        self.layout, self.kind = layout, pa.uint16() if vocabulary_size <= 1 << 16 else pa.uint32()
        self.schema = pa.schema({"ids": pa.list_(self.kind, layout.length), "mask": pa.list_(pa.bool_(), layout.length)})
        system, path = _file_system(folder)
        system.create_dir(path, recursive=True)
        self._out = system.open_output_stream(f"{path}/{self.name.rpartition('/')[2]}")
        self._writer = pa.ipc.new_file(self._out, self.schema)
        self._parts: list[np.ndarray] = []
        self._held = 0

    def add(self, ids: np.ndarray) -> None:
        self._parts.append(ids.astype(self.kind.to_pandas_dtype()))
        self._held += len(ids)
        full = self.layout.length * self.layout.batch_rows
        if self._held >= full:
            flat = np.concatenate(self._parts)
            cut = len(flat) // full * full
            for at in range(0, cut, full):
                self._write(flat[at : at + full], full)
            self._parts, self._held = [flat[cut:]], len(flat) - cut

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x, type=t), self.layout.length) for x, t in ((ids, self.kind), (mask, pa.bool_()))]
        self._writer.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        flat = np.concatenate([np.empty(0, self.kind.to_pandas_dtype()), *self._parts])
        if len(flat):
            padded = np.zeros(-(-len(flat) // self.layout.length) * self.layout.length, flat.dtype)
            padded[: len(flat)] = flat
            self._write(padded, len(flat))
        self._writer.close()
        self._out.close()


def write_sequences(docs: DataFrame, folder: str, layout: Format = Format(), vocabulary: str | None = None, cache_words: int = encoding.CACHE_WORDS) -> DataFrame:
    """Write the shards under ``folder`` and return their index, one row per document, as a written table.

    ``shard_start`` counts the ids before the document in its shard; shards are numbered in
    ascending order of their documents. ``cache_words``: distinct words that a worker remembers.
    """
    path = vocabulary or encoding.default_vocabulary()

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, encoder = None, 0, encoding.encoder(path, cache_words)
        number = TaskContext.get().partitionId()
        for batch in slices(batches, 1, TEXT_BYTES):
            out = out or _Shard(folder, layout, encoder.size)
            flat, first = encoder.encode(batch.column(1))
            n = np.diff(first) + 1
            ids = np.insert(flat, first[1:], layout.end_id)
            out.add(ids)
            start = at + np.cumsum(n) - n
            at += int(n.sum())
            same = len(n)
            yield pa.record_batch(
                [pa.array([out.name] * same), pa.array([number] * same, pa.int64()), batch.column(0), pa.array(start), pa.array(n)],
                names=["shard", "shard_no", "doc_id", "shard_start", "n_tokens"],
            )
        if out is not None:
            out.close()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).repartitionByRange("doc_id")
    index = ordered.sortWithinPartitions("doc_id", "text").mapInArrow(shard, INDEX)
    return written(index, f"{folder}-index", ARROW_ROWS)


def read_spans(index: DataFrame, layout: Format = Format()) -> DataFrame:
    """Each document's ids read back from the shards by position: start, number and checksum.

    ``start`` is the number of ids of all documents before it. The checksum is the unsigned CRC-32
    of the ids as little-endian unsigned 32-bit integers.
    """
    sizes = index.groupBy("shard_no").agg(F.sum("n_tokens").alias("shard_tokens"))
    before = Window.orderBy("shard_no").rowsBetween(Window.unboundedPreceding, -1)
    # One row per shard: far fewer than documents.
    bases = sizes.select("shard_no", F.coalesce(F.sum("shard_tokens").over(before), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader, batch_no, ids = None, None, -1, None
        per_batch = layout.length * layout.batch_rows
        for batch in batches:
            crcs = []
            starts, counts = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for shard, start, n in zip(batch.column(0).to_pylist(), starts.tolist(), counts.tolist()):
                if shard != name:
                    name, batch_no = shard, -1
                    system, path = _file_system(shard)
                    source = pa.memory_map(path) if system.type_name == "local" else system.open_input_file(path)
                    reader = pa.ipc.open_file(source)
                crc, at, end = 0, start, start + n
                while at < end:
                    if at // per_batch != batch_no:
                        batch_no = at // per_batch
                        ids = reader.get_batch(batch_no).column(0).flatten().to_numpy()
                    low = at - batch_no * per_batch
                    piece = ids[low : min(per_batch, end - batch_no * per_batch)]
                    crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                    at += len(piece)
                crcs.append(crc)
            yield pa.record_batch(
                [batch.column(1), pa.array(starts + batch.column(4).to_numpy()), batch.column(3), pa.array(crcs, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    placed = index.join(F.broadcast(bases), "shard_no").select("shard", "doc_id", "shard_start", "n_tokens", "base")
    # Dealt by stretches of the shards, so that the tasks follow from the ids and not from the index's size.
    spark = index.sparkSession
    ids = index.agg(F.sum("n_tokens")).collect()[0][0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-ids // TASK_IDS))
    dealt = placed.repartition(tasks, "shard", F.floor(F.col("shard_start") / RUN_IDS))
    return dealt.sortWithinPartitions("shard", "shard_start").mapInArrow(read, SPANS)


def op3_token_files(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write all documents to Arrow files in the shared folder and read every document back from them."""
    return read_spans(write_sequences(docs, shared_dir(spark, "sequences"), cache_words=ALONE_WORDS))
