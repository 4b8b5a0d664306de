"""Order MinHash fingerprints, sensitive to edit distance.

Every k-mer of a text (k code points) is numbered by its occurrence, so that repeats differ. Each of
``tuples`` hash functions selects the ``picked`` numbered k-mers with the least hashes; their k-mers,
in the order of the text, are hashed to one 32-bit entry of the signature. The likeness of two
signatures is the share of equal entries.

Nulls: a null text is an empty one; all empty texts have one fingerprint. A text shorter than k is one
k-mer. A null ``doc_id`` sorts first; rows that share a ``doc_id`` are ordered by text. Extra columns
are ignored; an empty table gives no rows. A single row's next document is itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import shuffle_partitions, slices, text_or_empty

SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)
_ROWS = 16_384


@dataclass(frozen=True)
class OrderMinHash:
    """k: code points of a k-mer. picked: k-mers of a tuple. tuples: entries of a signature."""

    k: int = 8
    picked: int = 2
    tuples: int = 48
    seed: int = 7

    def _factors(self) -> np.ndarray:
        return np.random.default_rng(self.seed).integers(0, 1 << 64, (self.tuples, 1), np.uint64) | np.uint64(1)

    def _kmers(self, codes: np.ndarray) -> np.ndarray:
        k = min(self.k, len(codes))
        h = np.zeros(len(codes) - k + 1, np.uint64)
        for i in range(k):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += codes[i : len(codes) - k + 1 + i]
        return _mix(h + np.uint64(k))

    def signature(self, text: str) -> np.ndarray:
        """The 32-bit entries; one pass over the k-mers in blocks, so a long text needs no more memory."""
        if not text:
            return np.zeros(self.tuples, np.uint32)
        kmers = self._kmers(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64))
        order = np.argsort(kmers, kind="stable")
        ranked = kmers[order]
        begin = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        nth = np.arange(len(ranked)) - np.repeat(begin, np.diff(np.append(begin, len(ranked))))
        numbered = np.empty_like(kmers)
        numbered[order] = _mix(ranked + nth.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        factors = self._factors()
        best_hash = np.empty((self.tuples, 0), np.uint64)
        best_at = np.empty((self.tuples, 0), np.int64)
        lines = np.arange(self.tuples)
        for low in range(0, len(numbered), _ROWS):
            hashed = factors * numbered[None, low : low + _ROWS]
            for _ in range(min(self.picked, hashed.shape[1])):
                at = hashed.argmin(1)
                best_hash = np.concatenate((best_hash, hashed[lines, at][:, None]), 1)
                best_at = np.concatenate((best_at, low + at[:, None]), 1)
                hashed[lines, at] = np.uint64(0xFFFFFFFFFFFFFFFF)
        keep = np.argsort(best_hash, 1, kind="stable")[:, : self.picked]
        places = np.sort(np.take_along_axis(best_at, keep, 1), 1)
        entry = np.full(self.tuples, np.uint64(places.shape[1]), np.uint64)
        for column in kmers[places].T:
            entry = _mix(entry * np.uint64(0x9E3779B97F4A7C15) + column)
        return (entry >> np.uint64(32)).astype(np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many first ones of the next document, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame) -> DataFrame:
    """Rows ``bucket, part, doc_id, text`` so that, sorted, a document's next one follows it in its bucket.

    Buckets are ranges of doc_id. The first document of a bucket is also sent to the bucket before
    it with ``part`` 1 (the first of all to the last). Split points and first ids: as many as shuffle
    partitions.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    n = shuffle_partitions(spark)
    # Null ids sort first, so they share the first bucket.
    points = sorted(set(rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (8 * n)))) if n > 1 else []
    bucket = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(_halve(F.col("doc_id"), [int(p) for p in points], 0)).cast("int")
    rows = rows.withColumn("bucket", bucket)
    firsts = sorted(
        rows.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("first")).collect(),
        key=lambda r: r["bucket"],
    )
    if not firsts:
        return rows.select("bucket", F.lit(0).alias("part"), "doc_id", "text")
    before = {r["first"]["doc_id"]: firsts[i - 1]["bucket"] for i, r in enumerate(firsts)}
    to = F.create_map(*[x for k, v in before.items() if k is not None for x in (F.lit(k), F.lit(v))]) if any(k is not None for k in before) else None
    target = F.try_element_at(to, F.col("doc_id")) if to is not None else F.lit(None).cast("int")
    if None in before:
        target = F.when(F.col("doc_id").isNull(), F.lit(before[None])).otherwise(target)
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("part"))
    sent = F.struct(target.cast("int").alias("bucket"), F.lit(1).alias("part"))
    to_rows = F.explode(F.when(target.isNotNull(), F.array(own, sent)).otherwise(F.array(own)))
    return rows.select(to_rows.alias("to"), "doc_id", "text").select("to.bucket", "to.part", "doc_id", "text")


def _halve(value, points: list[int], base: int):
    """How many split points are at most the value; nested as deep as the logarithm of their number."""
    if not points:
        return F.lit(base)
    mid = len(points) // 2
    return F.when(value < F.lit(points[mid]), _halve(value, points[:mid], base)).otherwise(_halve(value, points[mid + 1 :], base + mid + 1))


def fingerprints(docs: DataFrame, form: OrderMinHash = OrderMinHash()) -> DataFrame:
    """Each text's and its edited text's fingerprint (hexadecimal), and two likenesses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # bucket, doc_id, text, signature of the row before

        def row(next_text: str, next_signature: np.ndarray) -> tuple:
            _, doc, text, own = held
            changed = edited(text, next_text)
            other = form.signature(changed)
            digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
            return doc, len(text), digest, own.tobytes().hex(), other.tobytes().hex(), likeness(own, other), likeness(own, next_signature)

        for batch in slices(batches, 3):
            found = []
            for bucket, part, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                if part == 1 and (held is None or held[0] != bucket):
                    continue  # a further row with the first id of the next bucket
                own = form.signature(text)
                if held is not None:
                    found.append(row(text, own))
                held = None if part == 1 else (bucket, doc, text, own)
            columns = list(zip(*found)) if found else [[]] * 7
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)

    rows = with_next(docs)
    # By range, as hashes would put several buckets into one task and none into another.
    dealt = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "part", "doc_id", "text")
    return dealt.mapInArrow(run, SCHEMA)


_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def op8_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and their edited texts."""
    return fingerprints(docs)
