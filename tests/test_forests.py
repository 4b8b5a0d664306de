"""Trees of many folds grown together against a plain loop over the same histograms, fold by fold."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.operators import forests
from stockloom.sources import sinks

FEATURES = ["f", "g", "h"]


@pytest.fixture(scope="module")
def panel(spark):
    rng, rows = np.random.default_rng(5), []
    for combo in (0, 1):
        for day in range(80):
            for stock in range(6):
                f, g = rng.normal(size=2)
                y = np.sign(f) * 0.5 + (g > 0.3) * 0.2 * (combo + 1) + 0.05 * rng.normal()
                rows.append((combo, day, f"s{stock}", dt.date(2024, 1, 1) + dt.timedelta(day), float(f), None if rng.random() < 0.1 else float(g), None, None if day >= 76 else float(y)))
    made = spark.createDataFrame(rows, "combo int, day int, stock_code string, trade_date date, f double, g double, h double, y double")
    return sinks.stored(made.repartition(3), "trees")


@pytest.fixture(scope="module")
def rows(spark, panel):
    cuts = forests.edges(panel.filter("day < 40"), FEATURES)
    return forests.coded(panel, FEATURES, cuts, sinks.stored_path(spark, "coded"))


def _models(setting, combos=(0, 1)):
    return [forests.Model((c, fold), c, 40 + 5 * fold, 42 + 5 * fold, 47 + 5 * fold, setting) for c in combos for fold in range(6)]


def _plain(codes, y, setting, rounds):
    """One fold's trees by loops over nodes, features and bins."""
    base, trees, score = y.mean(), [], np.full(len(y), y.mean())
    for _ in range(rounds):
        residual, node, splits = y - score, np.zeros(len(y), int), {}
        value = {0: setting.rate * residual.sum() / (len(y) + setting.penalty)}
        for level in range(setting.depth):
            found = []
            for k in sorted({n for n in node if n >= 2**level - 1}):
                at, best = node == k, None
                g, n = residual[at].sum(), at.sum()
                for f in range(codes.shape[1]):
                    for b in range(forests.BINS + 1):
                        low = at & (codes[:, f] <= b)
                        gl, nl = residual[low].sum(), low.sum()
                        if nl >= setting.least and n - nl >= setting.least:
                            part = lambda s, c: s * s / (c + setting.penalty)
                            gain = part(gl, nl) + part(g - gl, n - nl) - part(g, n)
                            if best is None or gain > best[0] + 1e-12:
                                best = (gain, f, b, gl, nl, g - gl, n - nl)
                if best and best[0] > 1e-12:
                    found.append((-best[0], k, best))
            for _, k, (_, f, b, gl, nl, gr, nr) in sorted(found, key=lambda x: x[:2]):
                if len(splits) + 1 >= setting.leaves:
                    break
                splits[k] = (f, b)
                value[2 * k + 1], value[2 * k + 2] = setting.rate * gl / (nl + setting.penalty), setting.rate * gr / (nr + setting.penalty)
                at = node == k
                node[at] = 2 * k + 1 + (codes[at, f] > b)
        score = score + np.array([value[n] for n in node])
        trees.append((splits, value))
    return base, trees


def _scored(base, trees, codes):
    out = np.full(len(codes), base)
    for splits, value in trees:
        for i, row in enumerate(codes):
            k = 0
            while k in splits:
                k = 2 * k + 1 + (row[splits[k][0]] > splits[k][1])
            out[i] += value[k]
    return out


@pytest.mark.parametrize("setting", [forests.Setting(rounds=4, depth=3, leaves=8, least=5), forests.Setting(rounds=4, rate=0.3, depth=4, leaves=5, penalty=1.0, least=1)])
def test_folds_grown_together_equal_a_loop(spark, rows, setting, monkeypatch):
    monkeypatch.setattr(forests, "CARRY", 3)  # the rows' predictions are written once on the way
    monkeypatch.setattr(forests, "CELLS", 4 * 3 * 33 * 5)  # several jobs for the models of a level
    models = _models(setting)
    forest = forests.Forest(rows, models, len(FEATURES), sinks.stored_path(spark, "forest"))
    forest.grow(setting.rounds)
    got = {(r["model"], r["stock_code"], r["trade_date"]): r["score"] for r in forest.scores().collect()}
    held = rows.toPandas()
    assert len(got) == sum(((held.combo == m.combo) & (held.day >= m.val_start) & (held.day < m.val_end)).sum() for m in models)
    for i in (0, 3, 11):
        m = models[i]
        own = held[held.combo == m.combo]
        codes = np.array([list(c) for c in own.codes])
        train, val = (own.day < m.train_end).to_numpy(), ((own.day >= m.val_start) & (own.day < m.val_end)).to_numpy()
        base, trees = _plain(codes[train], own.y.to_numpy()[train], setting, setting.rounds)
        want = _scored(base, trees, codes[val])
        assert [got[i, s, d] for s, d in zip(own.stock_code[val], own.trade_date[val])] == pytest.approx(want.tolist(), abs=1e-9)


def test_empty_rows_and_windows(spark, rows):
    setting = forests.Setting(rounds=2)
    models = [forests.Model(("none",), 0, 0, 0, 0, setting), forests.Model(("other",), 7, 50, 50, 60, setting)]
    forest = forests.Forest(rows, models, len(FEATURES), sinks.stored_path(spark, "forest"))
    forest.grow(2)
    assert forest.scores().count() == 0 and all(m.done and m.base == 0.0 for m in models)
    empty = forests.Forest(rows.limit(0), _models(setting), len(FEATURES), sinks.stored_path(spark, "forest"))
    empty.grow(2)
    assert empty.scores().count() == 0


def test_validation_loss_ends_a_model(spark, rows):
    """Labels of the validation rows are turned about, so that every tree makes them worse."""
    turned = sinks.stored(rows.withColumn("y", F.when(F.col("day") >= 42, -F.col("y")).otherwise(F.col("y"))), "turned")
    models = [forests.Model((0,), 0, 40, 42, 76, forests.Setting(rounds=30, rate=0.5, least=5))]
    forest = forests.Forest(turned, models, len(FEATURES), sinks.stored_path(spark, "forest"))
    forest.grow(30, patience=3)
    assert models[0].done and len(models[0].trees) == 4 and models[0].best(3) == 0
    base = forest.scores(patience=3).select("score").distinct().collect()
    assert [r["score"] for r in base] == [models[0].base]
