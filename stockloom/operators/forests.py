"""Boosted trees for many folds and settings at once, from histograms of binned features.

A *model* is a setting with a training window: a fold of a campaign, or a trial of a search. Features are cut into bins
once. Every level of every model's current tree is one Spark aggregate: a task walks its rows and adds, for all models
that train on a row, the row's residual to histograms by node, feature and bin; the
histograms of a model meet in one group, where the best split of each node is found. So the number of jobs
is that of rounds times levels, however many folds and trials there are, and no fold's rows are ever in one place.

What a task holds is bounded: histograms of at most ``CELLS`` cells (further models take further jobs). What the driver holds is the models'
trees, a few numbers for each node. A row carries its predictions by the trees of finished
rounds, rewritten every ``CARRY`` rounds; the trees since then are walked anew. Written tables and plain
jobs make a lost executor repeat its tasks only.

Missing features have the lowest bin of their own; rows without a label are left out. A model without training rows predicts 0.
Splits with equal gains go to the first feature and bin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.operators import metrics
from stockloom.sources import sinks

BINS, CELLS, CARRY = 32, 1 << 22, 8
ROWS = "combo int, day int, y double, codes binary, held array<double>, stock_code string, trade_date date"


@dataclass(frozen=True)
class Setting:
    """rounds, rate: trees and the share of each that counts. depth, leaves: bounds of a tree. penalty, least: of leaf values, and least rows of a leaf."""

    rounds: int = 20
    rate: float = 0.1
    depth: int = 3
    leaves: int = 8
    penalty: float = 0.0
    least: int = 20


@dataclass
class Tree:
    """A heap: node k has the children 2k + 1 and 2k + 2; a leaf has the feature -1."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    def values(self, codes: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(codes)]

    def nodes(self, codes: np.ndarray) -> np.ndarray:
        """The node that each row ends in."""
        at, row = np.zeros(len(codes), np.int64), np.arange(len(codes))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            right = codes[row, np.where(inner, f, 0)] > self.bin[at]
            at = np.where(inner, 2 * at + 1 + right, at)


@dataclass
class Model:
    """``key`` names it for the caller. Days are places on the axis; rows before ``train_end`` train, those from ``val_start`` to ``val_end`` are scored."""

    key: tuple
    combo: int
    train_end: int
    val_start: int
    val_end: int
    setting: Setting
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    done: bool = False

    def best(self, patience: int | None) -> int:
        """The number of trees to use: all, or those up to the least loss on the validation rows."""
        return len(self.trees) if patience is None or not self.losses else int(np.argmin(self.losses))


def edges(panel: DataFrame, features: list[str], combo: str = "combo", bins: int = BINS) -> dict[int, list[np.ndarray]]:
    """For each combination and feature the cuts between bins: quantiles of the given rows (those of the initial history)."""
    at = F.array(*[F.lit(i / (bins - 1)) for i in range(1, bins - 1)])
    found = panel.groupBy(combo).agg(*[F.percentile_approx(F.col(f).cast("double"), at, 10_000).alias(f"q{i}") for i, f in enumerate(features)])
    return {r[combo]: [np.unique(np.asarray(r[f"q{i}"] or [], float)) for i in range(len(features))] for r in found.collect()}


def coded(panel: DataFrame, features: list[str], cuts: dict[int, list[np.ndarray]], path: str) -> DataFrame:
    """Rows ``combo, day, y`` and features as one byte each, as a table sorted by day within its parts; ``panel`` has ``combo, day, y``."""
    sent, width = panel.sparkSession.sparkContext.broadcast(cuts), len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[5:]]) if width else np.empty((batch.num_rows, 0))
            combo, codes = batch.column(0).to_numpy(), np.zeros(x.shape, np.uint8)
            for c in np.unique(combo):
                own = combo == c
                for i, cut in enumerate(sent.value.get(int(c), [np.empty(0)] * width)):
                    codes[own, i] = np.where(np.isnan(x[own, i]), 0, 1 + np.searchsorted(cut, x[own, i], side="right"))
            packed = pa.array([row.tobytes() for row in codes], pa.binary())
            none = pa.nulls(batch.num_rows, pa.list_(pa.float64()))
            yield pa.record_batch([*batch.columns[:3], packed, none, batch.column(3), batch.column(4)], names=["combo", "day", "y", "codes", "held", "stock_code", "trade_date"])

    given = panel.filter("y IS NOT NULL").select(F.col("combo").cast("int"), F.col("day").cast("int"), F.col("y").cast("double"), "stock_code", "trade_date", *[F.col(f).cast("double") for f in features])
    return sinks.written(given.mapInArrow(run, ROWS).sortWithinPartitions("day"), path)


class _Rows:
    """A batch's rows of one combination, by day."""

    def __init__(self, batch: pa.RecordBatch, at: np.ndarray, models: int):
        day = batch.column(1).to_numpy()[at]
        order = np.argsort(day, kind="stable")
        self.at = at[order]
        self.day, self.y = day[order], batch.column(2).to_numpy()[self.at]
        codes = batch.column(3).take(pa.array(self.at))
        self.codes = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(at), -1)
        held = batch.column(4)
        self.held = None if held.null_count else held.take(pa.array(self.at)).flatten().to_numpy().reshape(len(at), models)

    def window(self, low: int, high: int) -> slice:
        return slice(*np.searchsorted(self.day, [low, high]))

    def predicted(self, model: Model, place: int, window: slice, trees: list[Tree]) -> np.ndarray:
        """What the trees so far make of the rows of a window: the carried sum and the trees since."""
        start = np.full(len(self.y), model.base) if self.held is None else self.held[:, place]
        out, codes = start[window].copy(), self.codes[window]
        for tree in trees:
            out += tree.values(codes)
        return out


def _by_combo(batch: pa.RecordBatch, places: dict[int, list[int]]) -> Iterator[tuple[int, _Rows]]:
    combo = batch.column(0).to_numpy()
    for c in np.unique(combo):
        if int(c) in places:
            yield int(c), _Rows(batch, np.flatnonzero(combo == c), len(places[int(c)]))


class Forest:
    """Models over one table of coded rows, grown together; the order of ``models`` is fixed."""

    def __init__(self, rows: DataFrame, models: list[Model], features: int, path: str, bins: int = BINS):
        self.rows, self.models, self.features, self.path, self.bins = rows, models, features, path, bins + 1
        self.carried = 0  # trees that the rows' predictions hold
        self.tables = 0
        self.places: dict[int, list[int]] = {}
        for i, m in enumerate(models):
            self.places.setdefault(m.combo, []).append(i)

    def _sent(self, chosen: list[int]):
        """The chosen models with the trees that rows do not carry yet."""
        since = {i: replace(self.models[i], trees=self.models[i].trees[self.carried :], losses=[]) for i in chosen}
        return self.rows.sparkSession.sparkContext.broadcast((since, self.places))

    def _bases(self) -> None:
        """Every model's mean label, and whether it has rows at all: sums by combination and day are enough."""
        daily = self.rows.groupBy("combo", "day").agg(F.sum("y").alias("s"), F.count("y").alias("n")).collect()  # bounded by the calendar
        for combo, own in self.places.items():
            table = np.array(sorted((r["day"], r["s"], r["n"]) for r in daily if r["combo"] == combo), float).reshape(-1, 3)
            sums = np.vstack([[0, 0], np.cumsum(table[:, 1:], axis=0)])
            for i in own:
                s, n = sums[np.searchsorted(table[:, 0], self.models[i].train_end)]
                self.models[i].base, self.models[i].done = (s / n, False) if n else (0.0, True)

    def grow(self, rounds: int, patience: int | None = None) -> None:
        """Up to so many trees in each model; with ``patience`` a model ends when its validation loss has not fallen for so many rounds."""
        if not any(m.trees for m in self.models) and not self.carried:
            self._bases()
        for _ in range(max((len(m.trees) for m in self.models), default=0), rounds):
            active = [i for i, m in enumerate(self.models) if not m.done and len(m.trees) < m.setting.rounds]
            if not active:
                return
            self._round(active, patience)
            if max(len(m.trees) for m in self.models) - self.carried >= CARRY:
                self._carry()

    def _round(self, active: list[int], patience: int | None) -> None:
        grown = {i: Tree(np.full(1, -1), np.zeros(1, np.int64), np.zeros(1)) for i in active}
        deepest = max(self.models[i].setting.depth for i in active)
        for level in range(deepest):
            open_ = [i for i in active if level < self.models[i].setting.depth and (level == 0 or (grown[i].feature[2 ** (level - 1) - 1 : 2**level - 1] >= 0).any())]
            step = max(1, CELLS // (2**level * self.features * self.bins))
            for begin in range(0, len(open_), step):
                self._level(open_[begin : begin + step], grown, level, patience if level == 0 else None)
            if level == 0 and patience is not None:
                for i in active:
                    m = self.models[i]
                    if m.losses and len(m.losses) - 1 - int(np.argmin(m.losses)) >= patience:
                        m.done = True
        for i in active:
            self.models[i].trees.append(grown[i])

    def _level(self, chosen: list[int], grown: dict[int, Tree], level: int, patience: int | None) -> None:
        """One aggregate: histograms of the nodes of a level of the chosen models, and the splits that they give."""
        if not chosen:
            return
        features, bins, nodes, first = self.features, self.bins, 2**level, 2**level - 1
        sent = self._sent(chosen)
        partial = self.rows.sparkSession.sparkContext.broadcast({i: grown[i] for i in chosen})
        watch = patience is not None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models, places = sent.value
            held: dict[int, np.ndarray] = {}
            loss: dict[int, list[float]] = {}
            for batch in batches:
                for combo, rows in _by_combo(batch, places):
                    offset = np.arange(features) * bins
                    for place, i in enumerate(places[combo]):
                        if i not in models:
                            continue
                        model, window = models[i], rows.window(0, models[i].train_end)
                        if watch:
                            val = rows.window(model.val_start, model.val_end)
                            off = rows.y[val] - rows.predicted(model, place, val, model.trees)
                            was = loss.setdefault(i, [0.0, 0])
                            was[0], was[1] = was[0] + float(off @ off), was[1] + len(off)
                        codes = rows.codes[window]
                        if not len(codes):
                            continue
                        residual = rows.y[window] - rows.predicted(model, place, window, model.trees)
                        node = partial.value[i].nodes(codes) - first
                        inside = node >= 0
                        if not inside.all():
                            codes, residual, node = codes[inside], residual[inside], node[inside]
                        key = (node[:, None] * (features * bins) + offset + codes).ravel()
                        size = nodes * features * bins
                        own = held.setdefault(i, np.zeros((2, size)))
                        own[0] += np.bincount(key, np.repeat(residual, features), size)
                        own[1] += np.bincount(key, minlength=size)
            for i in held.keys() | loss.keys():
                s, n = loss.get(i, (0.0, 0))
                yield pa.record_batch([pa.array([i], pa.int32()), pa.array([held[i].tobytes() if i in held else b""], pa.binary()), pa.array([s]), pa.array([n], pa.int64())], names=["model", "sums", "loss", "n"])

        def split(table: pa.Table) -> pa.Table:
            i = table["model"][0].as_py()
            parts = [np.frombuffer(b) for b in table["sums"].to_pylist() if b]
            sums = np.sum(parts, axis=0).reshape(2, nodes, features, bins) if parts else np.zeros((2, nodes, features, bins))
            model = sent.value[0][i]
            at, f, b, gain, low, high, own = _splits(sums, model.setting)
            total = float(np.sum(table["loss"].to_numpy())), int(np.sum(table["n"].to_numpy()))
            lists = [at.tolist(), f.tolist(), b.tolist(), gain.tolist(), low.tolist(), high.tolist(), own.tolist()]
            kinds = [pa.int64()] * 3 + [pa.float64()] * 4
            return pa.table([pa.array([i], pa.int32()), *[pa.array([x], pa.list_(k)) for x, k in zip(lists, kinds)], pa.array([total[0]]), pa.array([total[1]], pa.int64())], names=["model", "node", "feature", "bin", "gain", "low", "high", "own", "loss", "n"])

        made = self.rows.mapInArrow(run, "model int, sums binary, loss double, n long")
        schema = "model int, node array<long>, feature array<long>, bin array<long>, gain array<double>, low array<double>, high array<double>, own array<double>, loss double, n long"
        for r in made.groupBy("model").applyInArrow(split, schema).collect():  # a row for each model
            model, tree = self.models[r["model"]], grown[r["model"]]
            if watch and r["n"]:
                model.losses.append(r["loss"] / r["n"])
            if level == 0 and r["own"]:
                tree.value[0] = r["own"][0]
            _applied(tree, level, model.setting, r)

    def _carry(self) -> None:
        """Writes the rows with their predictions by all trees so far."""
        sent, spark = self._sent(list(range(len(self.models)))), self.rows.sparkSession

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models, places = sent.value
            for batch in batches:
                for combo, rows in _by_combo(batch, places):
                    every = slice(0, len(rows.y))
                    held = np.column_stack([rows.predicted(models[i], place, every, models[i].trees) for place, i in enumerate(places[combo])])
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1, dtype=np.int32) * held.shape[1]), pa.array(held.ravel()))
                    own = batch.take(pa.array(rows.at))
                    yield pa.record_batch([*own.columns[:4], lists, own.column(5), own.column(6)], names=batch.schema.names)

        self.rows = sinks.written(self.rows.mapInArrow(run, ROWS), f"{self.path}/carried-{self.tables}")
        if self.tables:
            sinks.removed(spark, f"{self.path}/carried-{self.tables - 1}")
        self.tables += 1
        self.carried = max(len(m.trees) for m in self.models)

    def scores(self, chosen: list[int] | None = None, train: bool = False, patience: int | None = None) -> DataFrame:
        """``model, stock_code, trade_date, ret, score`` of the validation rows (or the training rows) of the chosen models.

        All trees count, or with ``patience`` those up to the least validation loss.
        """
        chosen = list(range(len(self.models))) if chosen is None else chosen
        whole = {i: replace(self.models[i], trees=self.models[i].trees[: self.models[i].best(patience)], losses=[]) for i in chosen}
        sent = self._sent(chosen) if patience is None else self.rows.sparkSession.sparkContext.broadcast((whole, self.places))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models, places = sent.value
            for batch in batches:
                for combo, rows in _by_combo(batch, places):
                    if patience is not None:
                        rows.held = None  # the carried sums hold all trees
                    for place, i in enumerate(places[combo]):
                        if i not in models:
                            continue
                        model = models[i]
                        window = rows.window(0, model.train_end) if train else rows.window(model.val_start, model.val_end)
                        if window.start == window.stop:
                            continue
                        own = batch.take(pa.array(rows.at[window]))
                        score = rows.predicted(model, place, window, model.trees)
                        yield pa.record_batch([pa.array(np.full(len(score), i, np.int32)), own.column(5), own.column(6), own.column(2), pa.array(score)], names=["model", "stock_code", "trade_date", "ret", "score"])

        return self.rows.mapInArrow(run, "model int, stock_code string, trade_date date, ret double, score double")


def _splits(sums: np.ndarray, setting: Setting) -> tuple[np.ndarray, ...]:
    """For every node with rows the best split: node, feature (-1: none), bin, gain, both children's values and its own."""
    g, n = np.cumsum(sums[0], axis=2), np.cumsum(sums[1], axis=2)
    all_g, all_n = g[:, :, -1:], n[:, :, -1:]
    part = lambda s, c: np.divide(s * s, c + setting.penalty, out=np.zeros_like(s), where=c > 0)
    gain = part(g, n) + part(all_g - g, all_n - n) - part(all_g, all_n)
    gain[(n < setting.least) | (all_n - n < setting.least)] = -np.inf
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(1)
    node = np.flatnonzero(all_n[:, 0, 0] > 0)
    best, f, b = best[node], best[node] // gain.shape[2], best[node] % gain.shape[2]
    top = flat[node, best]
    value = lambda s, c: setting.rate * np.divide(s, c + setting.penalty, out=np.zeros_like(s), where=c > 0)
    low, high = value(g[node, f, b], n[node, f, b]), value((all_g - g)[node, f, b], (all_n - n)[node, f, b])
    own = value(all_g[node, 0, 0], all_n[node, 0, 0])
    none = ~(top > 1e-12)
    return node, np.where(none, -1, f), b, np.where(none, 0.0, top), low, high, own


def _applied(tree: Tree, level: int, setting: Setting, found) -> None:
    """Splits the nodes of a level, largest gains first, while the tree has fewer leaves than it may."""
    size = 2 ** (level + 2) - 1
    grow = size - len(tree.feature)
    tree.feature = np.append(tree.feature, np.full(grow, -1))
    tree.bin, tree.value = np.append(tree.bin, np.zeros(grow, np.int64)), np.append(tree.value, np.zeros(grow))
    leaves = 1 + int((tree.feature >= 0).sum())
    for k in sorted(range(len(found["node"])), key=lambda k: (-found["gain"][k], found["node"][k])):
        if found["feature"][k] < 0 or leaves >= setting.leaves:
            continue
        at = 2**level - 1 + found["node"][k]
        tree.feature[at], tree.bin[at] = found["feature"][k], found["bin"][k]
        tree.value[2 * at + 1], tree.value[2 * at + 2] = found["low"][k], found["high"][k]
        leaves += 1
