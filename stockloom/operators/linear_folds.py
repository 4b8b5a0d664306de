"""Linear models in every fold from one pass: sums of products by fold step, medians from mergeable sketches.

Folds differ only in how many steps of rows they train on, so the sums of the steps, added up in order,
are each fold's. A missing feature takes the median of the fold's training rows, which is not known while the sums are
made; but with ``z`` the feature or 0 and ``d`` 1 where it is missing, the imputed feature is ``z + median * d``, and the
products of all ``z`` and ``d`` give its products for any median. The medians are those of quantile
sketches of each step, merged in the order of the steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sums by key and step that a task holds before it hands them on, and the sketches' size (rank error about 0.4 %).
HELD, SKETCH = 512, 800


def steps(panel: DataFrame, cuts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each day the first fold that trains on it, and the fold that it is a validation day of; both as ``fold_index``.

    Days and folds are both bounded by the calendar.
    """
    days, given = panel.select("trade_date").distinct(), F.broadcast(cuts)
    opens = days.join(given, days["trade_date"] < cuts["train_end"]).groupBy("trade_date").agg(F.min("fold_index").alias("fold_index"))
    inside = (days["trade_date"] >= cuts["val_start"]) & (cuts["val_end"].isNull() | (days["trade_date"] < cuts["val_end"]))
    return opens, days.join(given, inside).groupBy("trade_date").agg(F.min("fold_index").alias("fold_index"))


def medians(rows: DataFrame, features: list[str], keys: tuple[str, ...]) -> DataFrame:
    """``*keys, fold_index, medians``: of every feature over the rows of the step and all before it; null where there is no value."""
    sketch = [F.when(F.count(f) > 0, F.kll_sketch_agg_double(F.col(f).cast("double"), F.lit(SKETCH))).alias(f"s{i}") for i, f in enumerate(features)]
    own = rows.groupBy(*keys, "fold_index").agg(*sketch)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"s{i}").alias("s")) for i in range(len(features))])).alias("x")
    listed = own.select(*keys, "fold_index", each).groupBy(*keys, "x.i").agg(F.array_sort(F.collect_list(F.struct("fold_index", "x.s"))).alias("held"))

    def merged(before: Column, step: Column) -> Column:
        last, s = before["last"], step["s"]
        both = F.when(last.isNull(), s).when(s.isNull(), last).otherwise(F.kll_sketch_merge_double(last, s))
        found = F.struct(step["fold_index"].alias("fold_index"), F.when(both.isNotNull(), F.kll_sketch_get_quantile_double(both, F.lit(0.5))).alias("median"))
        return F.struct(F.concat(before["out"], F.array(found)).alias("out"), both.alias("last"))

    kind = dict(rows.dtypes)["fold_index"]
    none = F.struct(F.array().cast(f"array<struct<fold_index:{kind},median:double>>").alias("out"), F.lit(None).cast("binary").alias("last"))
    grown = listed.select(*keys, "i", F.inline(F.aggregate("held", none, merged, lambda x: x["out"])))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("i", "median"))), lambda x: x["median"])
    return grown.groupBy(*keys, "fold_index").agg(in_order.alias("medians"))


def products(rows: DataFrame, features: list[str], label: str, keys: tuple[str, ...]) -> DataFrame:
    """``*keys, fold_index, s``: sums of products of 1, every feature or 0, every feature's lack, and the label."""
    names, width = [*keys, "fold_index"], 2 * len(features) + 2
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in names) + ", s array<double>"

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def handed() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in held], batch.schema.field(i).type) for i in range(len(names))]
            flat = pa.array(np.concatenate([m.ravel() for m in held.values()]))
            offsets = pa.array(np.arange(len(held) + 1, dtype=np.int32) * width * width)
            held.clear()
            return pa.record_batch([*columns, pa.ListArray.from_arrays(offsets, flat)], names=[*names, "s"])

        for batch in batches:
            x = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns[len(names) : -1]])
            lacks = np.isnan(x)
            y = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            full = np.column_stack([np.ones(len(x)), np.where(lacks, 0.0, x), lacks, y])
            keyed: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(*[c.to_pylist() for c in batch.columns[: len(names)]])):
                keyed.setdefault(k, []).append(i)
            for k, at in keyed.items():
                part = full[at]
                held[k] = held[k] + part.T @ part if k in held else part.T @ part
            if len(held) > HELD:
                yield handed()
        if held:
            yield handed()

    def added(table: pa.Table) -> pa.Table:
        total = np.sum([np.asarray(s) for s in table["s"].combine_chunks().flatten().to_numpy().reshape(-1, width * width)], axis=0)
        first = [pa.array([table[k][0].as_py()], table.schema.field(k).type) for k in names]
        return pa.table([*first, pa.array([total.tolist()], pa.list_(pa.float64()))], names=[*names, "s"])

    given = rows.select(*names, *[F.col(f).cast("double") for f in features], F.col(label).cast("double").alias("_y"))
    return given.mapInArrow(gathered, schema).groupBy(*names).applyInArrow(added, schema)


def solution(sums: np.ndarray, medians_: np.ndarray, penalty: float) -> np.ndarray:
    """Intercept and coefficients over imputed features; the penalty is on coefficients of features of unit variance.

    A feature without values or variance has the coefficient 0. ``medians_`` holds NaN for the first kind.
    """
    n = len(medians_)
    turn = np.zeros((n + 2, 2 * n + 2))  # 1, imputed features, label, out of 1, z, d, label
    turn[0, 0] = turn[n + 1, 2 * n + 1] = 1
    known = np.flatnonzero(~np.isnan(medians_))
    turn[known + 1, known + 1], turn[known + 1, known + 1 + n] = 1, medians_[known]
    gram = turn @ sums.reshape(2 * n + 2, 2 * n + 2) @ turn.T
    rows, mean = gram[0, 0], gram[0, 1:] / gram[0, 0]
    cov = gram[1:, 1:] / rows - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov)[:n], 0))
    used = np.flatnonzero(spread > 1e-9 * np.sqrt(np.maximum(np.diag(gram)[1 : n + 1] / rows, 0)) + 1e-300)
    beta = np.zeros(n + 1)
    if len(used):
        scale = spread[used]
        r = cov[np.ix_(used, used)] / np.outer(scale, scale) + np.eye(len(used)) * penalty / rows
        beta[used + 1] = np.linalg.lstsq(r, cov[used, n] / scale, rcond=1e-10)[0] / scale
    beta[0] = mean[n] - beta[1:] @ mean[:n]
    return beta


def walk_forward(panel: DataFrame, cuts: DataFrame, features: list[str], label: str, penalties: dict[str, float], keys: tuple[str, ...] = ("market",)) -> DataFrame:
    """Scores of linear models in every fold: ``*keys, fold_index, algorithm, stock_code, trade_date, ret, score``.

    The rows are read once for the sums and once for the scores, however many folds there are; what a task holds
    whole is one key's sums by step, bounded by the calendar and the number of features. A fold with fewer
    training rows than coefficients has no scores. Rows without the label take no part; missing features
    take the fold's median, those that have none in its training rows have no effect. Validation windows do not overlap.
    """
    given = panel.filter(F.col(label).isNotNull())
    opens, shown = steps(panel, cuts)
    train = given.join(F.broadcast(opens), "trade_date")
    width, kinds = len(features) + 1, dict(train.dtypes)
    order = sorted(r["fold_index"] for r in cuts.select("fold_index").collect())  # bounded by the calendar
    made = products(train, features, label, keys).join(medians(train, features, keys), [*keys, "fold_index"])
    schema = ", ".join(f"{k} {kinds[k]}" for k in (*keys, "fold_index")) + ", algorithm string, beta array<double>, medians array<double>"

    def solved(table: pa.Table) -> pa.Table:
        own = {r["fold_index"]: r for r in table.to_pylist()}
        sums, middle, out = np.zeros((2 * len(features) + 2) ** 2), None, []
        for fold in order:
            if fold in own:
                sums = sums + np.asarray(own[fold]["s"])
                middle = np.array([np.nan if m is None else m for m in own[fold]["medians"]])
            if middle is None or sums[0] < width:
                continue
            for name, penalty in penalties.items():
                known = [None if np.isnan(m) else m for m in middle]
                out.append((*[table[k][0].as_py() for k in keys], fold, name, solution(sums, middle, penalty).tolist(), known))
        columns = list(zip(*out)) or [[] for _ in range(len(keys) + 4)]
        fields = [pa.field(k, table.schema.field(k).type) for k in (*keys, "fold_index")]
        fields += [pa.field("algorithm", pa.string()), pa.field("beta", pa.list_(pa.float64())), pa.field("medians", pa.list_(pa.float64()))]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=pa.schema(fields))

    beta = made.groupBy(*keys).applyInArrow(solved, schema)
    score = F.col("beta")[0]
    for i, f in enumerate(features):
        score = score + F.col("beta")[i + 1] * F.coalesce(F.col(f).cast("double"), F.col("medians")[i], F.lit(0.0))
    scored = given.join(F.broadcast(shown), "trade_date").join(beta, [*keys, "fold_index"])
    return scored.select(*keys, "fold_index", "algorithm", "stock_code", "trade_date", F.col(label).alias("ret"), score.alias("score"))
