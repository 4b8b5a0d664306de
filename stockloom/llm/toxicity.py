"""Toxicity: a linear-chain conditional random field tags toxic spans; marginals give the score.

Only documents are labelled, so token labels are derived: a feature of a token (the word, or its first
3 to 6 characters) that a likelihood-ratio test finds bound to toxic documents marks the tokens that
have it, in toxic documents only. The field is fitted to those sequences (sentences) by gradient
ascent; its features are the word, prefixes, suffixes and character trigrams of each token and the
transitions between tags. Forward-backward gives each token's marginal; a logistic curve over two
sums of a document's marginals, fitted to the document labels, gives the score.

The model is fitted on at most ``per_label`` labelled documents of each label, those with the least
hashes of their text; near copies among them are used once. Everything else covers whole texts of
all rows. Rows whose crc32(doc_id) mod 5 is 0 are never used for fitting.

Nulls: a null text is an empty one and is scored; rows with a null label or ``doc_id`` are not used for
fitting; a null ``doc_id`` counts as not held out. Of repeated labels of a document, the largest
counts. Extra columns are ignored. With no labelled rows of either label, the score is the share of
label 1 in the sample, or 0.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import ARROW_ROWS, shared_dir, slices, text_or_empty, written

SCORES = "doc_id long, held_out boolean, score double, predicted int"
SPANS = SCORES + ", spans array<struct<start:int,end:int,marginal:double>>"
_TOKEN = re.compile(r"\w+|[.!?\n]")
_WORD = re.compile(r"\w")
#: Distinct words whose emission a worker remembers.
CACHE_WORDS = 400_000


@dataclass(frozen=True)
class Settings:
    """per_label: documents of each label in the sample. signal: least likelihood ratio (2 ln) of a marking feature."""

    per_label: int = 700
    signal: float = 28.0
    lift: float = 10.0
    buckets: int = 1 << 18
    steps: int = 30
    penalty: float = 1e-4
    folds: int = 5


def held_out(folds: int = 5):
    """crc32 of the id as text, modulo the folds, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))


def tokens(text: str) -> list[str]:
    """Lower-case words, and the marks that end a sentence."""
    return _TOKEN.findall(text.lower())


def marking(word: str) -> set[str]:
    return {"w" + word} | {f"{n}{word[:n]}" for n in (3, 4, 5, 6) if len(word) > n}


def features(word: str, buckets: int) -> list[int]:
    """Hashed features of a token; crc32 is the same in every process."""
    from zlib import crc32

    padded = f"^{word}$"
    own = [f"w{word}", f"s{word[-3:]}"] + [f"{n}{word[:n]}" for n in (3, 4, 5, 6) if len(word) >= n]
    own += [f"t{padded[i:i + 3]}" for i in range(len(padded) - 2)]
    return [crc32(x.encode("utf-8", "surrogatepass")) % buckets for x in dict.fromkeys(own)]


class Chains:
    """Sentences of many documents laid out for forward-backward: the longest first, step by step."""

    def __init__(self, sentence: np.ndarray):
        # sentence: non-decreasing sentence numbers of the tokens
        starts = np.flatnonzero(np.diff(sentence, prepend=-1))
        sizes = np.diff(np.append(starts, len(sentence)))
        order = np.argsort(-sizes, kind="stable")
        self.starts, self.sizes = starts[order], sizes[order]
        depth = int(self.sizes[0]) if len(sizes) else 0
        self.alive = np.searchsorted(-self.sizes, -np.arange(depth), side="left")

    def marginals(self, lean: np.ndarray, model: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(tag 1) of each token, and each token's two messages as odds of tag 1."""
        own = np.exp(np.clip(lean, -30, 30))
        (a, b), (c, d) = np.exp(model.transition)  # from 0: to 0, to 1; from 1: to 0, to 1
        forward, backward = np.empty(len(lean)), np.ones(len(lean))
        for t, n in enumerate(self.alive):
            at = self.starts[:n] + t
            if t:
                odds = forward[at - 1]
                forward[at] = own[at] * (b + odds * d) / (a + odds * c)
            else:
                forward[at] = own[at] * math.exp(model.start)
        for t in range(len(self.alive) - 2, -1, -1):
            at = self.starts[: self.alive[t + 1]] + t
            odds = own[at + 1] * backward[at + 1]
            backward[at] = (c + d * odds) / (a + b * odds)
        both = forward * backward
        return both / (1 + both), forward, backward


@dataclass
class Field:
    """Weights of the field and of the curve from marginals to the score."""

    weights: np.ndarray
    transition: np.ndarray
    start: float
    curve: np.ndarray
    rate: float
    buckets: int

    def lean(self, word: str) -> float:
        """The log odds of tag 1 that the token's own features give."""
        return float(self.weights[features(word, self.buckets)].sum())

    def score(self, sums: np.ndarray) -> np.ndarray:
        if not self.curve.any():
            return np.full(len(sums), self.rate)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + sums @ self.curve[1:], -30, 30)))


def document_sums(marginal: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Two columns: log odds that any token is toxic, within limits, and log of one more than the expected number."""
    none = np.bincount(doc, np.log1p(-np.minimum(marginal, 1 - 1e-6)), docs)
    some = np.log(np.maximum(-np.expm1(none), 1e-4)) - none
    return np.column_stack((np.clip(some, -9, 9) / 9, np.log1p(np.bincount(doc, marginal, docs))))


def _laid_out(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words; and for every word of all texts its place among them, its document and its sentence."""
    place: dict[str, int] = {}
    number, doc, sentence, at = array("i"), array("i"), array("i"), 0
    for i, text in enumerate(texts):
        for x in tokens(text):
            if x in ".!?\n":
                at += 1
            else:
                number.append(place.setdefault(x, len(place)))
                doc.append(i)
                sentence.append(at)
        at += 1
    return list(place), *(np.frombuffer(x, np.int32) if len(x) else np.empty(0, np.int32) for x in (number, doc, sentence))


def _distinct(texts: list[str], labels: list[int]) -> tuple[list[str], list[int]]:
    """One of each group of near copies: texts that share one of two least hashes of word triples count as copies."""
    from zlib import crc32

    seen: set[tuple[int, int]] = set()
    kept = []
    for i, text in enumerate(texts):
        words = tokens(text)
        triples = {" ".join(words[j : j + 3]).encode("utf-8", "surrogatepass") for j in range(max(1, len(words) - 2))}
        marks = {(seed, min(crc32(x, seed) for x in triples)) for seed in (1, 2)}
        if not marks & seen:
            kept.append(i)
        seen |= marks
    return [texts[i] for i in kept], [labels[i] for i in kept]


def marked_features(texts: list[str], labels: list[int], settings: Settings) -> set[str]:
    """Token features bound to toxic documents, by likelihood ratio and lift of document counts."""
    counts = (Counter(), Counter())
    # Toxic documents first; of the others only what is left is counted.
    for label in (1, 0):
        for text, own in zip(texts, labels):
            if own == label:
                seen = set().union(*map(marking, set(tokens(text))))
                counts[label].update(seen if label else seen & counts[1].keys())
        if label:
            counts = (counts[0], Counter({f: k for f, k in counts[1].items() if k >= 3}))
    n1 = sum(labels)
    n0 = len(labels) - n1
    found = set()
    for f, k1 in counts[1].items():
        k0 = counts[0][f]
        if (k1 + 0.5) * (n0 + 1) < settings.lift * (k0 + 0.5) * (n1 + 1):
            continue
        p = (k1 + k0) / (n1 + n0)
        ratio = 0.0
        for k, n in ((k1, n1), (k0, n0)):
            for seen, part in ((k, p), (n - k, 1 - p)):
                ratio += seen * math.log(seen / (n * part)) if seen else 0
        if 2 * ratio >= settings.signal:
            found.add(f)
    return found


def fit(texts: list[str], labels: list[int], settings: Settings = Settings()) -> Field:
    """The field and the score's curve from labelled documents."""
    rate = sum(labels) / len(labels) if labels else 0.0
    model = Field(np.zeros(settings.buckets), np.zeros((2, 2)), 0.0, np.zeros(3), rate, settings.buckets)
    if rate in (0.0, 1.0):
        return model
    texts, labels = _distinct(texts, labels)
    marks = marked_features(texts, labels, settings)
    names, number, doc, sentence = _laid_out(texts)
    if not names:
        return model
    marked = np.asarray([bool(marking(w) & marks) for w in names])
    label = np.asarray(labels)
    tag = marked[number] & (label[doc] == 1)
    own = [features(w, settings.buckets) for w in names]
    width = np.asarray([len(x) for x in own])
    flat, row = np.concatenate(own).astype(np.int32), np.repeat(np.arange(len(names), dtype=np.int32), width)
    del own
    chains = Chains(sentence)
    # Observed pairs of tags, and starts of sentences.
    inner = np.flatnonzero(np.diff(sentence) == 0)
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (tag[inner].astype(int), tag[inner + 1].astype(int)), 1)
    begins = np.flatnonzero(np.diff(sentence, prepend=-1))
    scale, step = 1 / max(1, tag.sum()), 0.0
    moment = [np.zeros(settings.buckets), np.zeros((2, 2)), 0.0]
    square = [np.zeros(settings.buckets), np.zeros((2, 2)), 0.0]
    model.start = math.log((tag[begins].sum() + 1) / (len(begins) - tag[begins].sum() + 1))
    for step in range(1, settings.steps + 1):
        lean = np.bincount(row, model.weights[flat], len(names))[number]
        p, forward, backward = chains.marginals(lean, model)
        slope = np.bincount(flat, np.bincount(number, tag - p, len(names))[row], settings.buckets) * scale
        odds = forward[inner]
        after = np.exp(np.clip(lean[inner + 1], -30, 30)) * backward[inner + 1]
        t = np.exp(model.transition)
        joint = np.stack((np.full(len(inner), t[0, 0]), t[0, 1] * after, t[1, 0] * odds, t[1, 1] * odds * after))
        expected = (joint / joint.sum(0)).sum(1).reshape(2, 2)
        slopes = [slope - settings.penalty * model.weights, (pairs - expected) * scale, (tag[begins].sum() - p[begins].sum()) * scale]
        moves = []
        for i, g in enumerate(slopes):
            moment[i] = 0.9 * moment[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            moves.append(0.15 * (moment[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-6))
        model.weights += moves[0]
        model.transition += moves[1]
        model.start += float(moves[2])
    lean = np.bincount(row, model.weights[flat], len(names))[number]
    sums = document_sums(chains.marginals(lean, model)[0], doc, len(texts))
    model.curve = _logistic(sums, label)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Weights of a logistic curve (the first is the constant), by Newton's method."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(len(w))
    ridge[0, 0] = 1e-9
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
    return w


def sample(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[list[str], list[int]]:
    """Texts and labels of the bounded sample: rows that are not held out, least text hashes first."""
    marks = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.filter(F.col("doc_id").isNotNull() & ~held_out(settings.folds)).select("doc_id", text_or_empty().alias("text"))
    texts, found = [], []
    # Ids are chosen first, by hash; only the chosen texts travel.
    keyed = rows.select("doc_id", F.xxhash64("text").alias("h")).join(marks, "doc_id")
    for label in (0, 1):
        chosen = keyed.filter((F.col("toxic") > 0) == bool(label)).dropDuplicates(["h"]).orderBy("h", "doc_id").limit(settings.per_label).collect()
        wanted = {r["h"] for r in chosen}
        ids = docs.sparkSession.createDataFrame([(r["doc_id"], r["h"]) for r in chosen], "doc_id long, h long")
        got = rows.join(F.broadcast(ids), "doc_id").filter(F.xxhash64("text") == F.col("h")).select("h", "text").collect() if wanted else []
        once = {r["h"]: r["text"] for r in got}
        texts += [once[h] for h in sorted(once)]
        found += [label] * len(once)
    return texts, found


class Scorer:
    """Scores batches of texts in a worker; remembers what each word's features add up to."""

    def __init__(self, model: Field):
        self.model, self.place, self.leans = model, {}, np.empty(0)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, and the marginals of all words with their texts' numbers."""
        parts = [tokens(t) for t in texts]
        if len(self.place) > CACHE_WORDS:
            self.place, self.leans = {}, np.empty(0)
        place = self.place
        fresh = list({x for p in parts for x in p}.difference(place))
        place.update(zip(fresh, range(len(place), len(place) + len(fresh))))
        self.leans = np.concatenate((self.leans, [math.inf if w in ".!?\n" else self.model.lean(w) for w in fresh]))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        number = np.fromiter((place[x] for p in parts for x in p), np.int64, int(sizes.sum()))
        lean, doc = self.leans[number], np.repeat(np.arange(len(parts)), sizes)
        word = np.isfinite(lean)
        sentence = np.cumsum(~word) + doc
        lean, doc, sentence = lean[word], doc[word], sentence[word]
        p = Chains(sentence).marginals(lean, self.model)[0] if len(lean) else np.empty(0)
        return self.model.score(document_sums(p, doc, len(texts))), p, doc


def scored(docs: DataFrame, model: Field, with_spans: bool = False, span_floor: float = 0.5) -> DataFrame:
    """Every row's score; with ``with_spans`` also the spans (code points) whose marginals reach the floor. A written table."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in slices(batches, 2):
            texts = batch.column(2).to_pylist()
            score, p, doc = scorer(texts)
            columns = [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            if with_spans:
                columns.append(pa.array(_spans(texts, p, doc, span_floor), _SPAN_LIST))
            yield pa.record_batch(columns, names=names)

    names = ["doc_id", "held_out", "score", "predicted"] + ["spans"] * with_spans
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_or_empty().alias("text"))
    return written(rows.mapInArrow(run, SPANS if with_spans else SCORES), shared_dir(spark, "scores"), ARROW_ROWS)


def without_toxic(docs: DataFrame, model: Field) -> DataFrame:
    """The rows, with all their columns, whose score is below one half; a written table."""
    spark = docs.sparkSession
    sent, at = spark.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in slices(batches, at):
            yield batch.filter(pa.array(scorer(batch.column(at).fill_null("").to_pylist())[0] < 0.5))

    return written(docs.mapInArrow(run, docs.schema), shared_dir(spark, "not-toxic"), ARROW_ROWS)


_SPAN_LIST = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))


def _spans(texts: list[str], p: np.ndarray, doc: np.ndarray, floor: float) -> list[list[dict]]:
    """Neighbouring tokens at or above the floor are one span; offsets are looked up only in documents that have any."""
    out: list[list[dict]] = [[] for _ in texts]
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    for i in np.unique(doc[p >= floor]).tolist():
        # Lower-casing may change a text's length (one letter to two), so offsets come from the text itself.
        found = [m for m in _TOKEN.finditer(texts[i]) if _WORD.match(m.group())]
        own = p[bounds[i] : bounds[i + 1]].tolist()
        if len(found) != len(own):
            found = [m for m in _TOKEN.finditer(texts[i].lower()) if _WORD.match(m.group())]
        last = -2
        for j, (m, x) in enumerate(zip(found, own)):
            if x < floor:
                continue
            if j == last + 1:
                out[i][-1] = {"start": out[i][-1]["start"], "end": m.end(), "marginal": max(x, out[i][-1]["marginal"])}
            else:
                out[i].append({"start": m.start(), "end": m.end(), "marginal": x})
            last = j
    return out


def op5_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores and offending spans of all documents by a field fitted to the labels outside the held-out rows."""
    return scored(docs, fit(*sample(docs, labels)), with_spans=True)
