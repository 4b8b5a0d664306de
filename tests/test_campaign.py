"""Campaign operators: adjusted prices, activations, digests, sinks, grades, fitted models."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from stockloom.operators import activation, metrics, models
from stockloom.plans import campaign, registry
from stockloom.sources import sinks

SF = "/root/testdata/sf0.001"


def test_adjusted_prices_match_sql(spark):
    con = duckdb.connect()
    for name in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = {(c, d): x for c, d, *_, x, _ in con.execute(campaign.adjusted_sql()).fetchall()}
    got = {(r[0], r[1]): r["log_close_price"] for r in registry.queries()["a_adjust"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)


def _log(spark):
    day = lambda m: dt.date(2024, m, 1)
    rows = [("m", "D20", "a", day(1), day(2)), ("m", "D20", "a", day(3), day(4))]
    return spark.createDataFrame(rows, "market string, horizon string, algorithm string, trained_date date, promoted_at date")


def test_current_rollback_and_dangling(spark):
    log = _log(spark)
    assert activation.current(log).first()["trained_date"].month == 3
    back = activation.rolled_back(log, log, "2024-05-01").first()
    assert back["trained_date"].month == 1 and back["basis"] == {"rollback_from_trained_date": "2024-03-01"}
    versions = log.withColumn("archive_month", F.when(F.month("trained_date") == 3, "2024-03"))
    assert activation.dangling(log, versions).count() == 1 and activation.dangling(log.limit(0), versions).count() == 0
    with pytest.raises(Exception, match="no older version"):
        activation.rolled_back(log, log.filter("trained_date > '2024-02-01'"), "2024-05-01").collect()


def test_integrity_of_files(spark, tmp_path):
    for name, text in (("a.txt", "x"), ("b.txt", "y"), ("c.txt", "z")):
        (tmp_path / name).write_text(text)
    found = activation.file_digests(spark, str(tmp_path))
    manifest = found.filter("file_name <> 'c.txt'").withColumn("digest", F.when(F.col("file_name") == "b.txt", "old").otherwise(F.col("digest")))
    manifest = manifest.unionByName(spark.createDataFrame([("d.txt", "q")], "file_name string, digest string"))
    states = {r["file_name"]: r["state"] for r in activation.integrity(manifest, found).collect()}
    assert states == {"a.txt": "ok", "b.txt": "changed", "c.txt": "unexpected", "d.txt": "missing"}


def test_cached_panel_builds_once_per_version(spark, tmp_path):
    built = []
    build = lambda: built.append(1) or spark.range(3)
    for version in ("v1", "v1", "v2"):
        assert sinks.cached_panel(spark, str(tmp_path), "domestic", "2024-01-01", version, build).count() == 3
    assert len(built) == 2


def test_fold_metrics_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("m", 20, "a", 0, None, 0.5)], "market string, horizon int, algorithm string, fold_index int, val_end date, rank_ic double")
    sinks.write_fold_metrics(rows, str(tmp_path / "m"))
    sinks.write_fold_metrics(rows, str(tmp_path / "m"))
    got = spark.read.json(str(tmp_path / "m"))
    assert got.count() == 2 and got.filter("rank_ic = 0.5 AND val_end IS NULL AND market = 'm'").count() == 2


def test_grades(spark):
    rows = spark.createDataFrame([(-1.0,), (0.0,), (9.0,), (float("nan"),)], "x double")
    grade = metrics.grade(F.col("x"), [F.lit(0.0), F.lit(1.0)], ["C", "B", "A"])
    assert [r[0] for r in rows.select(grade).collect()] == ["C", "B", "A", "A"]


def test_pooled_fit_band_and_thick_tails(spark):
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int"))
    x = F.sin(F.col("id").cast("double"))
    panel = spark.range(200).select(F.lit("A").alias("stock_code"), day.alias("trade_date"), x.alias("f"), F.when(F.col("id") % 9 > 0, F.cos("id")).alias("g"), F.lit(None).cast("double").alias("none"), (2 * x).alias("y"))
    axis = panel.select("trade_date", F.datediff("trade_date", F.lit("2024-01-01")).alias("idx"))
    bounds = models.holdout_bounds(axis, 5, 20)
    assert tuple(bounds.first()) == (170, 175, 195)
    rows = models.with_roles(panel, axis, bounds)
    train, val = rows.filter("role = 'train'"), rows.filter("role = 'val'")
    fitted = models.fit_pooled(train, ["f", "g", "none"], "y")
    made = models.scored(fitted, val, "y")
    assert made.count() == 40 and made.select(F.avg(F.abs(F.col("ret") - F.col("score")))).first()[0] < 0.6
    band = models.residual_band(models.scored(fitted, train, "y"), made, ["algorithm"])
    assert band.count() == 40 and band.filter("p10 > p90").count() == 0
    tails = {r["strategy"]: r["mae"] for r in models.thick_tails(panel, ["f"], "y").collect()}
    assert set(tails) == {"huber", "winsorized"} and max(tails.values()) < 0.2


def test_fits_take_every_registered_feature(spark):
    from stockloom.operators import features as f
    from stockloom.plans import campaign

    columns = ["stock_code", *reversed(f.registry()), "open_price"]
    made = spark.createDataFrame([], ", ".join(f"{c} double" for c in columns))
    assert len(campaign._used(made)) == 40 and campaign._used(made.drop("RANK_60")) == [x for x in f.registry() if x != "RANK_60"]


def test_thick_tails_keep_rows_that_lack_a_feature(spark):
    from stockloom.operators import models

    rows = [(f"s{i}", i, float(i % 17), None if i % 2 else 1.0 + i % 5, None, 0.1 * (i % 17)) for i in range(200)]
    given = spark.createDataFrame(rows, "stock_code string, trade_date int, f double, g double, none double, label_D2 double")
    got = {r["strategy"]: r["mae"] for r in models.thick_tails(given, ["f", "g", "none"], "label_D2").collect()}
    assert set(got) == {"huber", "winsorized"} and all(v < 0.05 for v in got.values())
