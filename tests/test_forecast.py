"""The model, the forecaster and the weekly stream on a made panel of 60 stores."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from storecast.jobs.forecaster import Forecaster, feature_arms, global_and_segmented, overfit_check, rank_settings
from storecast.jobs.model import SalesModel, best_round, exact_metric_weight, inner_split
from storecast.operators.metrics import rmspe
from storecast.schema import DAILY, STORE
from storecast.sources.files import clean_panel
from storecast.streaming.weekly import weekly_scores

SPLIT = dt.date(2015, 4, 1)
SMALL = {"maxIter": 8, "maxDepth": 4, "stepSize": 0.4}


@pytest.fixture(scope="module")
def made(spark):
    """Sixty stores of rising size over sixteen months; shut on Sundays and on every 61st day, promotion in two weeks of five."""
    rng = np.random.default_rng(41)
    begin, rows, stores = dt.date(2014, 1, 6), [], []
    for s in range(60):
        size, lift = 2000 + 150 * s, 1.2 + 0.1 * (s % 5)
        stores.append((s + 1, "dcba"[s % 4], "cba"[s // 20], 250.0 * (s + 1), 1 + s % 12, 2001 + s % 10, 0, None, None, None) if s % 3 else (s + 1, "abcd"[s % 4], "a", None, None, None, 1, 3 + s % 40, 2013, "Mar,Jun,Sept,Dec"))
        for k in range(490):
            day = begin + dt.timedelta(k)
            shut, promo = day.isoweekday() == 7 or k % 61 == 60, int(k // 7 % 5 < 2 and day.isoweekday() < 6)
            sales = 0 if shut else round(size * (1.3 - 0.07 * day.isoweekday()) * (lift if promo else 1.0) * (1 + 0.06 * rng.standard_normal()))
            rows.append((s + 1, day.isoweekday(), day, sales, sales // 7, 1 - shut, promo, "b" if k % 61 == 60 else "0", int(day.month == 8)))
    panel = clean_panel(spark.createDataFrame(rows, DAILY), spark.createDataFrame(stores, STORE), drop_closed=False).persist()
    return panel.filter(F.col("Date") < F.lit(SPLIT)), panel.filter((F.col("Date") >= F.lit(SPLIT)) & (F.col("Date") < F.lit(SPLIT + dt.timedelta(14))))


@pytest.fixture(scope="module")
def fitted(made):
    past, _ = made
    return Forecaster(params=SMALL, n_segments=2, min_days=300, min_cell_stores=5).fit(past.filter("Open = 1"), past, fixed_rounds=8)


def test_forecast(made, fitted, tmp_path, spark):
    past, future = made
    out = fitted.predict(future.drop("Sales"), interval=0.8).join(future.select("Store", "Date", "Sales"), ["Store", "Date"]).persist()
    assert out.count() == future.count()
    assert out.filter("Open = 0 and (prediction <> 0 or low <> 0 or high <> 0)").count() == 0 and out.filter("Open = 1 and prediction <= 0").count() == 0
    assert rmspe(out.filter("Open = 1")) < 0.2
    inside = out.filter("Open = 1").agg(F.avg(F.col("Sales").between(F.col("low"), F.col("high")).cast("int"))).first()[0]
    assert 0.5 < inside < 0.99 and out.filter("low > high").count() == 0
    fitted.save(str(tmp_path / "m"), note="x")
    again = Forecaster.load(spark, str(tmp_path / "m"))
    assert again.card["note"] == "x" and again.card["train_rows"] == past.filter("Open = 1").count()
    both = again.predict(future).select("Store", "Date", F.round("prediction", 6).alias("p"))
    assert both.exceptAll(out.select("Store", "Date", F.round("prediction", 6).alias("p"))).isEmpty()
    one = future.filter((F.col("Store") == 3) & (F.col("Date") == F.lit(SPLIT + dt.timedelta(5))))
    assert abs(fitted.predict(one, planned=future).first().prediction - out.filter((F.col("Store") == 3) & (F.col("Date") == F.lit(SPLIT + dt.timedelta(5)))).first().prediction) < 1e-6
    with pytest.raises(ValueError, match="previous day"):
        fitted.predict(one)
    with pytest.raises(ValueError, match="first"):
        Forecaster().predict(future)


def test_wider_intervals_hold_more(made, fitted):
    past, future = made
    width = lambda level: fitted.predict(future, interval=level).filter("Open = 1").agg(F.avg(F.col("high") - F.col("low"))).first()[0]
    assert width(0.5) < width(0.95)


def test_rows_outside_the_plan_are_refused(made, fitted):
    past, future = made
    late = future.limit(20).withColumn("Date", F.date_add("Date", 400))
    with pytest.raises(ValueError, match="not in the calendar"):
        fitted.predict(late, planned=future, strict=False)


def test_models_against_each_other(made, fitted):
    past, future = made
    train, sold = past.filter("Open = 1"), future.filter("Open = 1")
    both = global_and_segmented(fitted, train, sold, fixed_rounds=4)
    assert both.count() == sold.count() and both.filter("pred_global is null or prediction is null").isEmpty()
    got = {r.days: r for r in overfit_check(fitted, train, sold).collect()}
    assert got["train"].model < 0.2 and got["hidden"].median_rule > 0


def test_raw_sales_and_two_seeds_survive_a_round_trip(made, spark, tmp_path):
    past, future = made
    few = past.filter("Store <= 20"), future.filter("Store <= 20")
    own = Forecaster(seeds=[0, 1], params=SMALL, n_segments=1, min_days=300, min_cell_stores=5).fit(few[0].filter("Open = 1"), few[0], fixed_rounds=3, log=False)
    assert [m.seed for m in own.models[1]] == [0, 1]
    own.save(str(tmp_path / "raw"))
    want, got = (f.predict(few[1]).agg(F.sum("prediction")).first()[0] for f in (own, Forecaster.load(spark, str(tmp_path / "raw"))))
    one = own.models[1][1:]
    own.models = {1: one}
    assert math.isclose(want, got, rel_tol=1e-9) and not math.isclose(want, own.predict(few[1]).agg(F.sum("prediction")).first()[0], rel_tol=1e-9)


def test_settings_and_arms(made):
    rows = made[0].filter("Open = 1 and Store < 10").withColumn("month", F.month("Date"))
    ranked = rank_settings(rows, ["DayOfWeek", "Promo"], {"flat": {"maxIter": 1, "maxDepth": 0}, "deep": {"maxIter": 4, "maxDepth": 4, "stepSize": 0.5}}).collect()
    assert [r.setting for r in ranked] == ["deep", "flat"]
    arms = feature_arms(rows, rows.filter("Store < 3"), {"one": ["Promo"], "two": ["Promo", "DayOfWeek"]}, [0], {"maxIter": 2, "maxDepth": 2}, fixed_rounds=2)
    assert arms.groupBy("arm", "seed").count().count() == 2


def test_every_store_has_one_segment(made, fitted):
    rows = fitted.segments.assignment.collect()
    assert len(rows) == 60 and {r.segment for r in rows} == {1, 2}
    unknown = made[1].limit(1).withColumn("Store", F.lit(9999))
    assert fitted.segments.transform(unknown).first().segment == fitted.segments.default


def test_model_counts_trees(made):
    rows = made[0].filter("Open = 1 and Store < 20").withColumn("month", F.month("Date"))
    m = SalesModel(["DayOfWeek", "Promo", "month"], {**SMALL, "maxIter": 5}, refit=False).fit(rows)
    assert 1 <= m.rounds <= 5 and m.model.getNumTrees == m.rounds and m.predict(rows).filter("prediction < 0").count() == 0
    assert {r.feature for r in m.importance(rows.sparkSession).collect()} == {"DayOfWeek", "Promo", "month"}
    with pytest.raises(ValueError, match="missing"):
        SalesModel(["nothing"]).fit(rows)
    with pytest.raises(ValueError, match="too few"):
        inner_split(rows.limit(0))
    assert best_round([3, 2, 1, 2, 3], 1) == 3 and best_round([1, 2, 3, 0], 2) == 1


def test_growth_stops_when_patience_is_used_up(made):
    rows = made[0].filter("Open = 1 and Store < 4")
    own = SalesModel(["Promo"], {"maxIter": 64, "maxDepth": 1, "stepSize": 1.0, "subsamplingRate": 1.0}, patience=2)
    old, new = inner_split(own.assembled(rows).withColumn("label", F.log1p("Sales")))
    whole = best_round(list(own._regressor(64).fit(old).evaluateEachIteration(new, "squared")), 2)
    assert own._counted(old, new) == whole < 32


def test_weights_have_mean_one(made):
    rows = exact_metric_weight(made[0], "StoreType")
    assert all(math.isclose(r[0], 1, rel_tol=1e-9) for r in rows.groupBy("StoreType").agg(F.avg("weight")).select("avg(weight)").collect())
    assert math.isclose(exact_metric_weight(made[0]).agg(F.avg("weight")).first()[0], 1, rel_tol=1e-9)


def test_weeks_come_out_when_complete(spark, tmp_path):
    monday = dt.datetime(2014, 6, 2)
    rows = [(1, monday + dt.timedelta(days=k, hours=9), 100) for k in range(21)] + [(1, monday + dt.timedelta(days=60), 100)]
    spark.createDataFrame(rows, "Store int, ts timestamp, Sales int").coalesce(1).write.parquet(f"{tmp_path}/in")
    predictions = spark.createDataFrame([(1, (monday + dt.timedelta(days=k)).date(), 110.0 if k < 7 else 100.0) for k in range(21)], "Store int, Date date, prediction double")
    stream = weekly_scores(spark.readStream.schema("Store int, ts timestamp, Sales int").parquet(f"{tmp_path}/in"), predictions, 0.05)
    q = stream.writeStream.format("memory").queryName("weeks").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = {r.week: (r.rows, round(r.rmspe, 6), r.above_threshold) for r in spark.table("weeks").collect()}
    assert got[dt.date(2014, 6, 2)] == (7, 0.1, True) and got[dt.date(2014, 6, 9)] == (7, 0.0, False)


def test_registered_forecast_counts_its_trees(spark, sf_dir, monkeypatch):
    from storecast import queries
    from storecast.jobs import forecaster

    asked = []

    def fit(self, train, calendar, **options):
        asked.append((self.params, self.n_segments, self.min_days, options))
        raise InterruptedError

    monkeypatch.setattr(forecaster.Forecaster, "fit", fit)
    with pytest.raises(InterruptedError):
        queries.q_forecast(spark, sf_dir)
    assert asked == [({}, 4, 365, {})]
    assert {r.segment for r in queries.q_store_segments(spark, sf_dir).collect()} == {1, 2, 3, 4}
