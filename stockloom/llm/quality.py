"""Quality: how much better a dictionary of good texts compresses a document than one of bad texts.

Two zstandard dictionaries are built from blocks of good and of bad labelled texts. A document is cut
into blocks, each compressed with both dictionaries; the difference of the sizes over their sum is the
normalised difference. A logistic curve over the document's difference, its worst block's difference and
its compression rate, fitted to the labels, makes the score. All three are taken of two views of the
text: its bytes, and its bytes with letters and digits replaced by their kind and repeated words by
marks, so that shouting, lists and repetition show in words that no dictionary holds. The curve is
fitted to halves of the sample compressed with dictionaries of the other half.

The sample is bounded: at most ``per_label`` labelled texts of each label, none longer than
``most_chars``, those with the least hashes. The curve's classes weigh as much as they do among all
labelled rows. Rows whose crc32(doc_id) mod ``folds`` is ``fold`` are never used for fitting. All rows
are scored over their whole texts.

Nulls: a null text is an empty one and is scored; rows with a null label or ``doc_id`` are not used for
fitting; a null ``doc_id`` counts as not held out. Of repeated labels of a document, the largest counts.
Equal texts have equal scores. Extra columns are ignored. Without labelled rows of both labels the score
is the share of label 1 among them, or one half where there are none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import slices, text_or_empty

SCORES = "doc_id long, held_out boolean, score double, predicted int"


@dataclass(frozen=True)
class Settings:
    """per_label, most_chars: bounds of the sample. block: bytes compressed at a time. bar: least score of a good text."""

    per_label: int = 1500
    most_chars: int = 20_000
    block: int = 1024
    dictionary: int = 1 << 15
    level: int = 3
    folds: int = 4
    fold: int = 2
    bar: float = 0.7
    penalty: float = 1e-3


def held_out(settings: Settings = Settings()) -> Column:
    """crc32 of the id as text, modulo the folds, is the given fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % settings.folds == settings.fold, F.lit(False))


def _kinds() -> bytes:
    kinds = {ord("0"): range(48, 58), ord("A"): range(65, 91), ord("a"): [*range(97, 123), *range(128, 256)]}
    table = bytearray(range(256))
    for kind, members in kinds.items():
        for byte in members:
            table[byte] = kind
    return bytes(table)


_KINDS = _kinds()
#: Words of up to 64 bytes that follow themselves; possessive, so that long texts take linear time.
_REPEATED = re.compile(rb"(?<!\S)(\S{1,64}+)(?!\S)(?: \1(?!\S))+")
_RUN = re.compile(rb"([aA0])\1+")


def kinds(text: bytes) -> bytes:
    """Letters and digits as runs of their kind, a word's immediate repetitions as ``=``."""
    marked = _REPEATED.sub(lambda m: m[1] + b" =" * m[0].count(b" "), text)
    return _RUN.sub(rb"\1", marked.translate(_KINDS))


VIEWS = (bytes, kinds)


def blocks(text: bytes, size: int) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)] or [b""]


def dictionary(texts: list[bytes], settings: Settings) -> bytes:
    """A dictionary of the texts' blocks; the blocks themselves where there are too few to train one."""
    parts = [b for t in texts for b in blocks(t, settings.block) if len(b) > 16]
    try:
        return zstandard.train_dictionary(settings.dictionary, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-settings.dictionary :]


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    if not content:
        return zstandard.ZstdCompressor(level=level, write_content_size=False)
    made = zstandard.ZstdCompressionDict(content)  # a trained one is told by its first bytes, others are raw content
    made.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=made, write_content_size=False, write_dict_id=False)


class Measures:
    """What two dictionaries for each view make of a text; lives in the process that compresses."""

    def __init__(self, dictionaries: list[tuple[bytes, bytes]], settings: Settings):
        self._pairs = [tuple(_compressor(d, settings.level) for d in pair) for pair in dictionaries]
        self._block = settings.block

    def __call__(self, text: bytes) -> list[float]:
        """For each view: the normalised difference, that of the worst block, and bytes compressed for each byte."""
        out = []
        for view, (good, bad) in zip(VIEWS, self._pairs):
            parts = blocks(view(text), self._block)
            with_good = np.array([len(good.compress(b)) for b in parts], float)
            with_bad = np.array([len(bad.compress(b)) for b in parts], float)
            apart, both = with_bad - with_good, with_bad + with_good
            out += [apart.sum() / both.sum(), (apart / both).min(), with_good.sum() / sum(len(b) + 1 for b in parts)]
        return out


@dataclass
class Classifier:
    """Dictionaries (good, bad) of each view and the curve over the standardised measures."""

    dictionaries: list[tuple[bytes, bytes]]
    centre: np.ndarray
    spread: np.ndarray
    curve: np.ndarray
    rate: float
    settings: Settings

    def scores(self, measures: list[list[float]]) -> np.ndarray:
        if not self.dictionaries:
            return np.full(len(measures), self.rate)
        x = (np.reshape(measures, (-1, len(self.centre))) - self.centre) / self.spread
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + x @ self.curve[1:], -30, 30)))


def fit(texts: list[str], marks: list[int], rate: float | None = None, settings: Settings = Settings()) -> Classifier:
    """``marks``: 1 for good; ``rate``: share of good ones among all labelled rows, the sample's if not given."""
    data, y = [t.encode("utf-8", "replace") for t in texts], np.asarray(marks, float)
    if rate is None:
        rate = float(y.mean()) if len(y) else 0.5
    none = Classifier([], np.zeros(0), np.ones(0), np.zeros(1), rate, settings)
    half = np.zeros(len(y), int)  # each label's texts fall into the two halves in turn
    for mark in (0, 1):
        half[y == mark] = np.arange(int((y == mark).sum())) % 2
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return none

    def made(chosen: np.ndarray) -> list[tuple[bytes, bytes]]:
        of = lambda view, mark: [view(data[i]) for i in np.flatnonzero(chosen & (y == mark))]
        return [(dictionary(of(view, 1), settings), dictionary(of(view, 0), settings)) for view in VIEWS]

    x = np.empty((len(y), 3 * len(VIEWS)))
    for side in (0, 1):
        measure = Measures(made(half != side), settings)
        for i in np.flatnonzero(half == side):
            x[i] = measure(data[i])
    centre, spread = x.mean(0), x.std(0) + 1e-9
    weight = np.where(y == 1, rate / (y == 1).sum(), (1 - rate) / (y == 0).sum())
    curve = _logistic((x - centre) / spread, y, weight, settings.penalty)
    return Classifier(made(np.ones(len(y), bool)), centre, spread, curve, rate, settings)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float) -> np.ndarray:
    """Weighted logistic regression with a ridge, by Newton steps."""
    x = np.column_stack((np.ones(len(x)), x))
    ridge, b = penalty * np.eye(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b += np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ b)
    return b


def sample(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[list[str], list[int], float | None]:
    """Texts and labels of the bounded sample, least text hashes first, and the share of label 1 among all labelled rows."""
    marks = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = docs.filter(F.col("doc_id").isNotNull() & ~held_out(settings)).select("doc_id", text_or_empty().alias("text"))
    keyed = rows.select("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("size")).join(marks.withColumn("mark", F.col("quality") > 0), "doc_id")
    rate = keyed.agg(F.avg(F.col("mark").cast("double"))).first()[0]
    texts, found = [], []
    for mark in (0, 1):
        # Ids are chosen first, by hash; only the chosen texts travel.
        chosen = keyed.filter((F.col("mark") == bool(mark)) & (F.col("size") <= settings.most_chars)).groupBy("h").agg(F.min("doc_id").alias("doc_id"))
        chosen = chosen.orderBy("h").limit(settings.per_label).collect()
        if chosen:
            ids = docs.sparkSession.createDataFrame([(r["doc_id"], r["h"]) for r in chosen], "doc_id long, h long")
            got = rows.join(F.broadcast(ids), "doc_id").filter(F.xxhash64("text") == F.col("h")).select("h", "text").collect()
            once = {r["h"]: r["text"] for r in got}
            texts += [once[h] for h in sorted(once)]
            found += [mark] * len(once)
    return texts, found, rate


def scored(docs: DataFrame, model: Classifier) -> DataFrame:
    """Every row's score; a text is in a worker one batch at a time, of at most Spark's bytes for an Arrow batch."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        measure = Measures(own.dictionaries, own.settings)
        for batch in slices(batches, 2):
            score = own.scores([measure(t) for t in batch.column(2).cast(pa.binary()).to_pylist()])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= own.settings.bar).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(model.settings).alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, SCORES)


def op11_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by dictionaries and a curve of the labels outside the held-out rows."""
    return scored(docs, fit(*sample(docs, labels)))
