"""Walk-forward campaigns against loops over the same folds in numpy, on small panels."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.operators import campaigns, folds, forests, linear_folds, models
from stockloom.sources import logs, sinks

FEATURES = ["f", "g"]


@pytest.fixture(scope="module")
def panel(spark):
    rng, rows = np.random.default_rng(3), []
    for market in ("domestic", "overseas"):
        for day in range(90):
            for stock in range(3):
                f, g = rng.normal(size=2)
                y = 0.5 * f - 0.2 * g + 0.1 + 0.05 * rng.normal()
                rows.append((market, f"{market[0]}{stock}", dt.date(2024, 1, 1) + dt.timedelta(day), float(f), None if rng.random() < 0.05 else float(g), None if day >= 85 else float(y)))
    made = spark.createDataFrame(rows, "market string, stock_code string, trade_date date, f double, g double, label_D2 double")
    return sinks.stored(made, "panel")


def _cuts(panel, size):
    return folds.weekly_folds(folds.date_axis(panel), 2, 50, size)


def _imputed(train, val, middle):
    """Training and validation features with the given medians, or those of the training rows."""
    middle = train[FEATURES].median() if middle is None else middle
    return train[FEATURES].fillna(middle), val[FEATURES].fillna(middle)


def test_linear_folds_equal_a_loop(panel):
    """The sketches keep so few values whole, so medians are those of the rows but for the choice between two middle ones."""
    cuts, rows, want = _cuts(panel, 5), panel.toPandas(), {}
    made = linear_folds.walk_forward(panel, cuts, FEATURES, "label_D2", {"plain": 0.0, "ridge": 3.0})
    got = {(r["market"], r["fold_index"], r["algorithm"], r["stock_code"], r["trade_date"]): r["score"] for r in made.collect()}
    opens = linear_folds.steps(panel, cuts)[0]
    trained = panel.filter("label_D2 IS NOT NULL").join(opens, "trade_date")
    middle = {(r["market"], r["fold_index"]): dict(zip(FEATURES, r["medians"])) for r in linear_folds.medians(trained, FEATURES, ("market",)).collect()}
    for fold in cuts.collect():
        for market, own in rows[rows["label_D2"].notna()].groupby("market"):
            train = own[own["trade_date"] < fold["train_end"]]
            val = own[(own["trade_date"] >= fold["val_start"]) & ((own["trade_date"] < fold["val_end"]) if fold["val_end"] else True)]
            for f in FEATURES:
                held = np.sort(train[f].dropna())
                assert abs(np.searchsorted(held, middle[market, fold["fold_index"]][f]) - len(held) / 2) <= 0.01 * len(held) + 1
            x, new = _imputed(train, val, middle[market, fold["fold_index"]])
            spread, mean = x.std(ddof=0), x.mean()
            z = ((x - mean) / spread).to_numpy()
            for name, penalty in (("plain", 0.0), ("ridge", 3.0)):
                beta = np.linalg.solve(z.T @ z + penalty * np.eye(2), z.T @ (train["label_D2"] - train["label_D2"].mean()))
                for r, score in zip(val.itertuples(), ((new - mean) / spread).to_numpy() @ beta + train["label_D2"].mean()):
                    want[market, fold["fold_index"], name, r.stock_code, r.trade_date] = score
    assert len(cuts.collect()) > 5 and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_linear_solution_of_odd_features():
    """One feature constant, one without values, one a copy of another: the fitted values are those of least squares."""
    rng = np.random.default_rng(1)
    f, n = rng.normal(size=200) * 1e-4 + 5, 200
    x = np.column_stack([f, np.full(n, 3.0), np.full(n, np.nan), f, rng.normal(size=n) * 1e6])
    x[::7, 4] = np.nan
    y = f * 1e3 + rng.normal(size=n)
    lacks = np.isnan(x)
    full = np.column_stack([np.ones(n), np.where(lacks, 0, x), lacks, y])
    beta = linear_folds.solution((full.T @ full).ravel(), np.array([5.0, 3.0, np.nan, 5.0, 10.0]), 0.0)
    made = np.where(lacks, [5.0, 3.0, 0.0, 5.0, 10.0], x)
    want = np.linalg.lstsq(np.column_stack([np.ones(n), f - 5, made[:, 4] / 1e6]), y, rcond=None)[0]
    assert beta[2] == beta[3] == 0
    assert np.allclose(np.column_stack([np.ones(n), made]) @ beta, np.column_stack([np.ones(n), f - 5, made[:, 4] / 1e6]) @ want, atol=1e-4)


def test_linear_folds_of_empty_panel_and_few_rows(panel):
    cuts = _cuts(panel, 5)
    assert linear_folds.walk_forward(panel.limit(0), cuts, FEATURES, "label_D2", {"plain": 0.0}).count() == 0
    few = panel.filter("trade_date >= '2024-02-20' AND stock_code = 'd0' AND market = 'domestic'")
    assert 0 < linear_folds.walk_forward(few, cuts, FEATURES, "label_D2", {"plain": 0.0}).count() < few.count()


SMALL = {"lightgbm": {"rounds": (2, 9), "rate": (0.1, 0.5), "leaves": (2, 6)}, "xgboost": {"rounds": (2, 9), "rate": (0.1, 0.5), "depth": (1, 3)}}


def _both(panel, size):
    """Cuts of the one horizon that has a label and of one that has none."""
    own = _cuts(panel, size)
    return own.withColumn("horizon", F.lit(2)).unionByName(own.withColumn("horizon", F.lit(60)))


def test_campaign_records_a_failure_and_goes_on(spark, panel):
    axis = sinks.stored(folds.date_axis(panel), "axis")
    combos = [("domestic", 2), ("overseas", 60), ("nowhere", 2)]  # there is no label of horizon 60
    rows, status, rungs = campaigns.campaign(panel, axis, _both(panel, 5), combos, FEATURES, 50, sinks.stored_path(spark, "c"), 6, (3, 9), SMALL)
    assert {(r["market"], r["status"]) for r in status.collect()} == {("domestic", "success"), ("overseas", "error"), ("nowhere", "error")}
    got = rows.collect()
    assert {(r["algorithm"], r["fold_index"]) for r in got} == {(a, i) for a in ("lightgbm", "xgboost", "ensemble") for i in range(_cuts(panel, 5).count())}
    assert np.mean([r["rank_ic"] for r in got if r["algorithm"] == "lightgbm"]) > 0.5
    kept = {(r["algorithm"], r["rung"]): 0 for r in rungs.collect()} | {}
    for r in rungs.collect():
        kept[r["algorithm"], r["rung"]] += r["kept"]
    assert kept == {("lightgbm", 0): 2, ("lightgbm", 1): 1, ("xgboost", 0): 2, ("xgboost", 1): 1}


def test_search_finds_what_every_trial_run_to_its_end_finds(spark, panel):
    """On this panel halving and the exhaustive search agree; the latter is held against a forest of each trial alone."""
    axis = sinks.stored(folds.date_axis(panel), "axis")
    data = campaigns.prepared(panel, axis, [("domestic", 2)], FEATURES, 50)
    full, record = campaigns.search(data, 50, sinks.stored_path(spark, "s"), 5, (9,), 1, SMALL)
    cut, alone = folds.purged_split(spark, 50, 2).first(), {}
    for a in models.ALGORITHMS:
        for t, setting in enumerate(campaigns.trials(a, 5, SMALL)):
            m = forests.Model((a, t), 0, cut["train_end"], cut["val_start"], cut["val_end"], setting)
            forest = forests.Forest(data.rows, [m], len(FEATURES), sinks.stored_path(spark, "one"))
            forest.grow(setting.rounds)
            alone[a, t] = campaigns._rank_ics(forest.scores())[0]
    assert {(r[2], r[3]): r[6] for r in record} == pytest.approx(alone)
    best = {a: max(range(5), key=lambda t: (alone[a, t], -t)) for a in models.ALGORITHMS}  # noqa: B023
    assert full == {(0, a): campaigns.trials(a, 5, SMALL)[best[a]] for a in models.ALGORITHMS}
    halved, _ = campaigns.search(data, 50, sinks.stored_path(spark, "s"), 5, (2, 9), 2, SMALL)
    by_setting = {a: {s: alone[a, t] for t, s in enumerate(campaigns.trials(a, 5, SMALL))} for a in models.ALGORITHMS}
    assert all(by_setting[a][halved[0, a]] >= sorted(by_setting[a].values())[-2] for a in models.ALGORITHMS)


def test_trials_fill_their_space():
    for a in models.ALGORITHMS:
        made = campaigns.trials(a)
        assert len(set(made)) == 50 and all(20 <= s.rounds <= 200 and 0.01 <= s.rate <= 0.3 for s in made)
        assert min(s.rounds for s in made) < 30 and max(s.rounds for s in made) > 190
    assert {s.leaves for s in campaigns.trials("lightgbm")} <= set(range(7, 64)) and {s.depth for s in campaigns.trials("xgboost")} == set(range(3, 11))


def test_champion_is_saved_loaded_and_challenged(spark, panel, tmp_path):
    axis = sinks.stored(folds.date_axis(panel), "axis")
    settings = {a: forests.Setting(6, 0.3, 2, 4, 1.0, 2) for a in models.ALGORITHMS}
    used = campaigns.refit(panel, axis, ("domestic", 2), 60, FEATURES, settings, str(tmp_path / "old"))
    own = panel.filter("market = 'domestic'").join(axis, "trade_date")
    assert used == own.filter("idx < 60 AND label_D2 IS NOT NULL").count()
    got = campaigns.score_saved(panel, axis, ("domestic", 2), str(tmp_path / "old"), 70, 80)
    assert got.count() == 2 * own.filter("idx >= 70 AND idx < 80 AND label_D2 IS NOT NULL").count()
    # The same models, never saved.
    data = campaigns.prepared(panel, axis, [("domestic", 2)], FEATURES, 60)
    forest = forests.Forest(data.rows, [forests.Model((a,), 0, 60, 70, 80, s) for a, s in settings.items()], 2, str(tmp_path / "f"))
    forest.grow(6)
    key = lambda r, a: (a, r["stock_code"], r["trade_date"])
    want = {key(r, models.ALGORITHMS[r["model"]]): r["score"] for r in forest.scores().collect()}
    assert {key(r, r["algorithm"]): r["score"] for r in got.collect()} == pytest.approx(want)
    # The champion of another combination is dropped, and a worse one is beaten on the same rows.
    poor = {a: forests.Setting(1, 0.01, 1, 2, 0.0, 80) for a in models.ALGORITHMS}
    campaigns.refit(panel, axis, ("overseas", 2), 20, FEATURES, poor, str(tmp_path / "poor"))
    made = campaigns.challengers(panel, axis, [("domestic", 2), ("overseas", 2)], FEATURES, settings, str(tmp_path / "w"), holdout=8)
    rows = campaigns.gate(made, panel, axis, {("overseas", 2): str(tmp_path / "poor")}, str(tmp_path / "new")).collect()
    assert {(r["market"], r["algorithm"]) for r in rows} == {("overseas", a) for a in models.ALGORITHMS}
    assert all(r["promoted"] == (r["rank_ic"] - r["champion_rank_ic"] > 0) for r in rows if r["champion_rank_ic"] is not None)
    again = campaigns.score_saved(panel, axis, ("overseas", 2), str(tmp_path / "new" / "overseas-2"), *made.bounds[1][1:])
    ours = made.scores().filter("market = 'overseas'")
    assert again.select("algorithm", "stock_code", "trade_date", F.round("score", 9)).exceptAll(ours.select("algorithm", "stock_code", "trade_date", F.round("score", 9))).count() == 0


def test_champions_refitted_together_take_the_jobs_of_one(spark, panel, tmp_path, monkeypatch):
    axis, calls, level = sinks.stored(folds.date_axis(panel), "axis"), [], forests.Forest._level
    monkeypatch.setattr(forests.Forest, "_level", lambda self, *a: (calls.append(1), level(self, *a))[1])
    settings = {a: forests.Setting(2, 0.3, 2, 4, 1.0, 2) for a in models.ALGORITHMS}
    ends, at = {("domestic", 2): 60, ("overseas", 2): 40}, lambda kind, c: str(tmp_path / f"{kind}-{c[0]}")
    used = campaigns.refits(panel, axis, ends, FEATURES, settings, {c: at("all", c) for c in ends})
    assert len(calls) == 4
    for c, end in ends.items():
        assert campaigns.refit(panel, axis, c, end, FEATURES, settings, at("one", c)) == used[c]
        (some, cuts, _), (want, own, _) = (campaigns.load(spark, at(kind, c)) for kind in ("all", "one"))
        assert all(np.array_equal(x, y) for x, y in zip(cuts, own)) and some.keys() == want.keys()
        for a, m in want.items():
            assert some[a].base == pytest.approx(m.base) and len(some[a].trees) == len(m.trees)
            for x, y in zip(some[a].trees, m.trees):
                assert np.array_equal(x.feature, y.feature) and np.array_equal(x.bin, y.bin) and x.value == pytest.approx(y.value)


def test_log_keeps_one_writer_of_a_version(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "market string, at int"
    rows = lambda at: spark.createDataFrame([("m", at)], schema)
    assert logs.read(spark, path, schema).count() == 0
    assert logs.append(rows(1), path, "a", 0) == 0 and logs.append(rows(1), path, "a", 0) == 0
    for expected in (0, 2):
        with pytest.raises(logs.VersionConflict):
            logs.append(rows(2), path, "b", expected)
    assert logs.append(rows(2), path, "b", 1) == 1 and logs.append(rows(9), path, "a", 7) == 0
    # A writer that has looked before another one commits fails on the commit itself.
    before, known = logs.commits, logs.commits(spark, path)[:1]
    logs.commits = lambda *_: known
    try:
        with pytest.raises(logs.VersionConflict, match="meanwhile"):
            logs.append(rows(3), path, "c", 1)
    finally:
        logs.commits = before
    assert sorted((r["at"], r["version"]) for r in logs.read(spark, path, schema).collect()) == [(1, 0), (2, 1)]


def test_held_out_rows_end_boosting_and_leave_medians_alone(panel):
    train, other = panel.filter("trade_date < '2024-02-15'"), panel.filter("trade_date >= '2024-02-15'")
    noise = other.withColumns({"label_D2": F.when(F.col("label_D2").isNotNull(), -F.col("label_D2")), "g": F.lit(1e6)})
    early = models.fit_pooled(train, FEATURES, "label_D2", rounds=8, depth=2, held_out=noise)
    full = models.fit_pooled(train, FEATURES, "label_D2", rounds=8, depth=2)
    assert early["lightgbm"].stages[-1].getNumTrees < full["lightgbm"].stages[-1].getNumTrees == 8
    assert early["lightgbm"].stages[0].surrogateDF.first() == full["lightgbm"].stages[0].surrogateDF.first()
