"""Packing documents into equal windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into whole windows, which need no partner, and pieces of at most
``piece`` ids. Each task packs the pieces of ``group`` documents at a time: every piece begins as a
partition of k windows with one window filled; the two partitions with the largest spread are merged
so that full windows meet empty ones, until one partition is left. Where its fullest window exceeds
the capacity, k rises by one and the merging starts again.

Nulls: a null text is an empty one (only the end id). Repeated rows are packed each. Extra columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm import encoding
from stockloom.llm.common import shared_dir, slices, text_or_empty, written

ARROW_ROWS = 1500
#: Distinct words that a worker remembers where packing runs alone (about 300 MB).
ALONE_WORDS = 1_600_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each piece, by multiway differencing over ``windows`` windows."""
    n = len(sizes)
    children: list[tuple[np.ndarray, np.ndarray]] = []
    nodes, heap = n, []
    for i, size in enumerate(sizes.tolist()):
        sums, node = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[0], node[0] = size, i
        heap.append((-size, i, sums, node))
    heapq.heapify(heap)
    turn = n
    while len(heap) > 1:
        _, _, sums_a, node_a = heapq.heappop(heap)
        _, _, sums_b, node_b = heapq.heappop(heap)
        # The fullest of one meets the emptiest of the other.
        sums, low = sums_a + sums_b[::-1], node_b[::-1]
        both = (node_a >= 0) & (low >= 0)
        node = np.where(node_a >= 0, node_a, low)
        made = int(both.sum())
        if made:
            children.append((node_a[both], low[both]))
            node[both] = nodes + np.arange(made)
            nodes += made
        order = np.argsort(-sums, kind="stable")
        sums, node = sums[order], node[order]
        sums -= sums[-1]
        heapq.heappush(heap, (-int(sums[0]), turn, sums, node))
        turn += 1
    window = np.full(nodes, -1, np.int64)
    if n:
        roots = heap[0][3]
        window[roots[roots >= 0]] = np.flatnonzero(roots >= 0)
    at = nodes
    for left, right in reversed(children):
        at -= len(left)
        window[left] = window[right] = window[at : at + len(left)]
    return window[:n]


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each piece; no window holds more than the capacity, and their number is near the least."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differencing(sizes, windows)
        if np.bincount(window, sizes, windows).max(initial=0) <= capacity:
            return window
        windows += 1


def cut(tokens: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """A document's pieces (start, length): whole windows first, then at most ``piece`` ids each."""
    whole = tokens // capacity * capacity
    return [(at, capacity) for at in range(0, whole, capacity)] + [(at, min(piece, tokens - at)) for at in range(whole, tokens, piece)]


def packed(
    docs: DataFrame, capacity: int = 2048, piece: int = 512, group: int = 1024, end_id: int = 1, vocabulary: str | None = None, with_ids: bool = False,
    cache_words: int = encoding.CACHE_WORDS,
) -> DataFrame:
    """Pack all documents; a row per piece, with its place in the document and in its sequence.

    ``sequence_tokens`` is what the sequence holds; the rest up to ``capacity`` is padding. With
    ``with_ids`` a column ``ids`` (array of int) holds the piece's ids. Documents stay in the task
    that read them: nothing is shuffled, and a sequence id holds the number of its partition. The rows are
    written to the shared folder. ``cache_words``: distinct words that a worker remembers.
    """
    if not 0 < piece <= capacity:
        raise ValueError("piece must be between 1 and capacity")
    path = vocabulary or encoding.default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding.encoder(path, cache_words)
        sequence = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        docs_held = 0

        def rows(pieces: list[tuple], window: np.ndarray | None) -> pa.RecordBatch:
            nonlocal sequence
            sizes = np.asarray([p[2] for p in pieces], np.int64)
            if window is None:
                window = np.arange(len(pieces))
            order = np.argsort(window, kind="stable")
            number = np.unique(window, return_inverse=True)[1]
            sums = np.bincount(number, sizes).astype(np.int64)
            ends = np.cumsum(sizes[order])
            offset = np.empty(len(pieces), np.int64)
            offset[order] = ends - sizes[order] - (np.cumsum(sums) - sums)[number[order]]
            columns = [pa.array([p[i] for p in pieces], pa.int64()) for i in range(5)]
            columns += [pa.array(sequence + number), pa.array(offset), pa.array(sums[number])]
            if with_ids:
                columns.append(pa.array([p[5] for p in pieces], pa.list_(pa.int32())))
            sequence += len(sums)
            return pa.record_batch(columns, names=names)

        for batch in slices(batches, 1):
            flat, first = encoder.encode(batch.column(1))
            whole = []
            for doc, a, b in zip(batch.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist()):
                ids = np.append(flat[a:b], np.uint32(end_id))
                for at, n in cut(len(ids), capacity, piece):
                    own = ids[at : at + n]
                    row = (doc, at, n, zlib.crc32(own.astype("<u4").tobytes()), len(ids), own.astype(np.int32) if with_ids else None)
                    (whole if n == capacity else held).append(row)
                docs_held += 1
                if docs_held >= group and held:
                    yield rows(held, pack(np.asarray([p[2] for p in held]), capacity))
                    held, docs_held = [], 0
            if whole:
                yield rows(whole, None)
        if held:
            yield rows(held, pack(np.asarray([p[2] for p in held]), capacity))

    schema = PIECES + (", ids array<int>" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)
    return written(found, shared_dir(docs.sparkSession, "packed"), ARROW_ROWS)


def op2_packing(docs: DataFrame) -> DataFrame:
    """All documents in sequences of at most 2048 ids, each document ended by id 1."""
    return packed(docs, cache_words=ALONE_WORDS)
