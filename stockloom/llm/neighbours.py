"""Exact nearest neighbours by int8 block products with error bounds.

Vectors are packed into blocks. A vector is held as int8 steps of its own scale, with the exact norm
of what the rounding leaves out; by the triangle inequality that norm bounds how far a quantised
distance is off. A block of queries meets each block of candidates: a product of the int8 matrices
(computed in float32 slabs in which every sum is exact) gives quantised distances, candidates whose
lower bound exceeds the query's k-th best distance are dropped, and the rest are computed in double
precision from the original vectors and kept in a bounded heap per query. Heaps of candidate groups
are merged per query.

Query blocks and candidate blocks are dealt to the tiles of a grid: a task holds the queries of a tile
(a bounded number of bytes) and streams the tile's candidates past them once.

Vectors that are null, zero, empty or hold null or non-finite components take no part, nor do rows with
a null id; vectors of different length are never compared. Ties go to the smaller id. Rows that share
an id are rows of their own: each is a candidate of the others, and each query row has its own k lines
(so ``query_id`` and ``rank`` repeat where an id does). A distance beyond the range of doubles is
infinite. An empty table, or one without queries, gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import shared_dir, written

SLAB = 1024  # 127 * 127 * 1024 < 2**24, so float32 sums of int8 products are exact
#: Bytes of original query vectors that a tile holds.
TILE_BYTES = 16 << 20
ARROW_ROWS = 128
FOUND = "query_id long, query_key long, copies long, vec_id long, score double"


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 steps, scale, squared norm of the quantised vector, norm of the rounding error."""
    v = vectors.astype(np.float64)
    scale = np.maximum(np.abs(v).max(1) / 127, 1e-290)
    steps = np.rint(v / scale[:, None]).astype(np.int8)
    back = steps * scale[:, None]
    return steps, scale, (back * back).sum(1), np.sqrt(((v - back) ** 2).sum(1))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows; where squares would leave the range of doubles, of scaled gaps."""
    gap = np.abs(a.astype(np.float64) - b.astype(np.float64))
    most = gap.max(1)
    found = np.sqrt((gap * gap).sum(1))
    odd = (most > 1e150) | ((most < 1e-150) & (most > 0))
    if odd.any():
        found[odd] = most[odd] * np.sqrt(((gap[odd] / most[odd, None]) ** 2).sum(1))
        found[np.isinf(most)] = np.inf
    return found


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows, in double precision."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], SLAB):
        out += a[:, at : at + SLAB].astype(np.float32) @ b[:, at : at + SLAB].astype(np.float32).T
    return out


class Nearest:
    """The k nearest candidates of a block of queries so far: a heap per query, its worst on top."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, copies: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.keys, self.copies, self.vectors, self.k = ids, keys, copies, vectors.astype(np.float64), k
        self.q = quantise(vectors)
        self.best: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.limit = np.full(len(ids), np.inf)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> int:
        """Take in a block of candidates; returns how many pairs were computed exactly."""
        with np.errstate(over="ignore", invalid="ignore"):
            steps, scale, norm, error = quantise(vectors)
            own_steps, own_scale, own_norm, own_error = self.q
            square = own_norm[:, None] + norm[None] - 2 * own_scale[:, None] * scale[None] * products(own_steps, steps)
            near = np.sqrt(np.maximum(square, 0))
            slack = (own_error[:, None] + error[None]) * (1 + 1e-9) + 1e-7 * (np.sqrt(own_norm)[:, None] + np.sqrt(norm)[None])
            lower, upper = near - slack, near + slack
        # Squares beyond the range of doubles bound nothing: such pairs are all computed.
        known = np.isfinite(upper)
        lower, upper = np.where(known, lower, -np.inf), np.where(known, upper, np.inf)
        if len(ids) >= self.k:
            self.limit = np.minimum(self.limit, np.partition(upper, self.k - 1, 1)[:, self.k - 1])
        rows, columns = np.nonzero(lower <= self.limit[:, None])
        for at in range(0, len(rows), 65_536):
            self._exact(rows[at : at + 65_536], columns[at : at + 65_536], ids, vectors)
        return len(rows)

    def _exact(self, rows: np.ndarray, columns: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            exact = distances(self.vectors[rows], vectors[columns])
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        for a, b in zip(first, np.append(first[1:], len(rows))):
            i, own = rows[a], ids[columns[a:b]]
            top = np.lexsort((own, exact[a:b]))[: self.k]
            heap = self.best[i]
            for score, vec in zip(exact[a:b][top].tolist(), own[top].tolist()):
                if len(heap) < self.k:
                    heapq.heappush(heap, (-score, -vec))
                elif (-score, -vec) > heap[0]:
                    heapq.heapreplace(heap, (-score, -vec))
                else:
                    break
            if len(heap) == self.k:
                self.limit[i] = min(self.limit[i], -heap[0][0])

    def rows(self) -> pa.RecordBatch:
        sizes = [len(x) for x in self.best]
        columns = [pa.array(np.repeat(x, sizes)) for x in (self.ids, self.keys, self.copies)]
        columns += [pa.array([-v for x in self.best for _, v in x], pa.int64()), pa.array([-s for x in self.best for s, _ in x], pa.float64())]
        return pa.record_batch(columns, names=[x.split()[0] for x in FOUND.split(", ")])


def usable(vector: Column) -> Column:
    """Whether a vector takes part: finite throughout, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Rows ``id, key, copies, vector`` as blocks of one length, at most ``rows`` each: ``dim, ids, keys, copies, data`` (little-endian)."""
    kind = _kind(vectors)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def block(dim: int) -> pa.RecordBatch:
            *numbers, data = zip(*held.pop(dim))
            parts = [np.asarray(x, "<i8").tobytes() for x in numbers] + [np.asarray(data, kind).tobytes()]
            return pa.record_batch([pa.array([dim]), *(pa.array([x]) for x in parts)], names=["dim", "ids", "keys", "copies", "data"])

        for batch in batches:
            lists = batch.column(3)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            numbers = zip(*(batch.column(i).to_pylist() for i in range(3)))
            for own, a, b in zip(numbers, ends[:-1].tolist(), ends[1:].tolist()):
                held.setdefault(b - a, []).append((*own, flat[a:b]))
                if len(held[b - a]) >= rows:
                    yield block(b - a)
        for dim in list(held):
            yield block(dim)

    return vectors.select("id", "key", "copies", "vector").mapInArrow(pack, "dim long, ids binary, keys binary, copies binary, data binary")


def _kind(vectors: DataFrame) -> str:
    """Components keep their precision: four bytes where the column has floats, else eight."""
    return "<f4" if dict(vectors.dtypes)["vector"] == "array<float>" else "<f8"


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", query_rows: int = 512, block_rows: int = 512,
    groups: int | None = None, tile_bytes: int = TILE_BYTES,
) -> DataFrame:
    """The k nearest other rows of each query row: ``query_id, rank, vec_id, score``.

    ``groups``: how many tiles there are at least (as many as shuffle partitions). A query row is found
    among its own candidates at distance 0, so k + 1 are kept and one such line is taken off again.
    """
    spark = vectors.sparkSession
    groups = groups or int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = vectors.filter(usable(F.col(vector_column)) & F.col(id_column).isNotNull())
    chosen = chosen.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector"), is_query.alias("is_query"))
    kind = _kind(chosen)
    one = F.lit(1).cast("long")
    # Query rows equal in id and vector have the same answer: it is found once.
    asked = chosen.filter("is_query").withColumn("key", F.xxhash64("vector")).groupBy("id", "key").agg(F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    asked = written(asked, shared_dir(spark, "queries"))
    size = asked.agg(F.sum(8 * F.size("vector").cast("long"))).collect()[0][0] or 0
    across = max(1, -(-size // tile_bytes))
    down = max(1, -(-groups // across))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    dealt = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n))
    queries = blocks(asked, query_rows).withColumn("i", dealt("ids", across)).withColumn("j", every(down)).withColumn("is_candidate", F.lit(0))
    candidates = blocks(chosen.select("id", one.alias("key"), one.alias("copies"), "vector"), block_rows)
    candidates = candidates.withColumn("keys", F.lit(b"")).withColumn("copies", F.lit(b""))
    candidates = candidates.withColumn("j", dealt("ids", down)).withColumn("i", every(across)).withColumn("is_candidate", F.lit(1))
    both = queries.unionByName(candidates).repartition(across * down, "i", "j").sortWithinPartitions("i", "j", "is_candidate")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []
        for batch in batches:
            for i, j, is_candidate, dim, ids, keys, copies, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (i, j) != tile:
                    yield from (best.rows() for _, best in held)
                    tile, held = (i, j), []
                matrix = np.frombuffer(data, kind).reshape(-1, dim)
                numbers = [np.frombuffer(x, "<i8") for x in (ids, keys, copies)]
                if not is_candidate:
                    held.append((dim, Nearest(*numbers, matrix, k + 1)))
                    continue
                for own, best in held:
                    if own == dim:
                        best.add(numbers[0], matrix)
        yield from (best.rows() for _, best in held)

    streamed = both.select("i", "j", "is_candidate", "dim", "ids", "keys", "copies", "data").mapInArrow(search, FOUND)
    found = written(streamed, shared_dir(spark, "neighbours"), ARROW_ROWS)
    hits = F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k + 1)
    merged = found.groupBy("query_id", "query_key").agg(F.first("copies").alias("copies"), hits.alias("top"))
    own = F.struct(F.lit(0.0).alias("score"), F.col("query_id").alias("vec_id"))
    at = F.array_position("top", own).cast("int")
    others = F.when(at > 0, F.filter("top", lambda _, i: i != at - 1)).otherwise(F.col("top"))
    lines = merged.select("query_id", F.explode(F.sequence(one, F.col("copies"))), F.slice(others, 1, k).alias("top"))
    return lines.select("query_id", F.posexplode("top").alias("pos", "hit")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")
    )


def op10_neighbours(embeddings: DataFrame) -> DataFrame:
    """Queries: every hundredth id; candidates: all other rows."""
    return nearest(embeddings, F.col("vec_id") % 100 == 0)
