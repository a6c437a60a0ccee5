"""The backtest over folds, arms and seeds, feature families, weights and rankings by segment, on the made panel."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from test_forecast import SMALL, made  # noqa: F401

from storecast.jobs.backtest import Arm, Backtest, results
from storecast.jobs.forecaster import Forecaster, settings_by_segment
from storecast.jobs.model import SalesModel
from storecast.operators.experiment import accepted
from storecast.operators.features import Features, statistics
from storecast.operators.metrics import rmspe
from storecast.operators.monitor import correction_scores, corrections
from storecast.operators.validation import RollingOrigin
from storecast.sources import versions
from storecast.schema import LEARNED_FEATURES, feature_names

FOLDS = RollingOrigin(n_splits=2, horizon_days=21, min_train_days=300)
ARMS = [
    Arm("plain", {"closure": False, "easter": False}), Arm("flags/only", {"closure": "flags"}), Arm("global with segment", segmented=False, one_hot=True),
    Arm("all", {"reopening": True, "month": True, "promo2": True, "customers": True}, since_reopening=True), Arm("weights", segmented=False, exact_weights=True),
]


def backtest(path, arms=ARMS, seeds=(0,), **more):
    return Backtest(str(path), list(arms), list(seeds), FOLDS, SMALL, {"fixed_rounds": 3}, n_segments=2, min_days=250, min_cell_stores=5, **more)


def test_an_interrupted_backtest_goes_on(made, spark, tmp_path, monkeypatch):  # noqa: F811
    past = made[0].filter("Store <= 30")
    own = backtest(tmp_path / "b", parallelism=2)
    fits, plain_fit = [], SalesModel.fit

    def breaking(self, *a, **b):
        if len(fits) == 4:
            raise InterruptedError
        fits.append(tuple(self.features))
        return plain_fit(self, *a, **b)

    monkeypatch.setattr(SalesModel, "fit", breaking)
    with pytest.raises(InterruptedError):
        own.run(past)
    left = own.missing(spark, 2)
    assert 10 > len(left) > 5 and not results(own.scored(spark, 2)).isEmpty()
    stored = {(r.arm, r.seed, r.fold): r.rmspe for r in results(own.scored(spark, 2)).collect()}
    assert len(stored) + len(left) == 10

    ran = []
    monkeypatch.setattr(SalesModel, "fit", plain_fit)
    plain_one = Backtest._one
    monkeypatch.setattr(Backtest, "_one", lambda self, frame, arm, seed, fold: (ran.append((arm.name, seed, fold)), plain_one(self, frame, arm, seed, fold)))
    table = results(own.run(past))
    assert sorted(ran) == sorted((a.name, s, f) for a, s, f in left)
    scores = {(r.arm, r.seed, r.fold): (r.rmspe, r.rows) for r in table.collect()}
    assert len(scores) == 10 and all(scores[k][0] == pytest.approx(v) for k, v in stored.items())
    valid = past.filter("Open = 1 and Sales > 0").filter(F.col("Date") > F.lit(dt.date(2015, 3, 31) - dt.timedelta(21)))
    assert {n for (_, _, f), (_, n) in scores.items() if f == 2} == {valid.count()}
    assert all(0.01 < s < 0.5 for s, _ in scores.values())
    ran.clear()
    verdicts = {r.arm: r for r in accepted(results(own.run(past)).drop("rows"), "plain").collect()}
    assert not ran and set(verdicts) == {a.name for a in ARMS} - {"plain"} and verdicts["all"].folds == 2


def test_frames_of_folds_are_the_forecasters_features(made, spark, tmp_path):  # noqa: F811
    from storecast.operators.folds import fold_statistics

    past = made[0].filter("Store <= 12")
    open_days = past.filter("Open = 1 and Sales > 0")
    own, learned = backtest(tmp_path / "b"), fold_statistics(open_days, FOLDS)
    base = own.base(open_days, past, learned)
    for fold in (1, 2):
        f = learned.folds[fold - 1]
        frame = own.frame(base, learned, fold)
        assert frame.filter("role = 'train'").agg(F.max("Date")).first()[0] == f.train_end
        train = open_days.filter(F.col("Date") <= F.lit(f.train_end))
        names = [n for n in feature_names(reopening=True, month=True) if n in frame.columns]
        assert names == feature_names(reopening=True, month=True)
        want = Features(statistics(train), past, with_reopening=True, month=True).transform(open_days.filter(F.col("Date") <= F.lit(f.valid_end)))
        cols = ["Store", "Date", *(F.round(n, 6).alias(n) if n in LEARNED_FEATURES else F.col(n) for n in names)]
        assert frame.select(*cols).exceptAll(want.select(*cols)).isEmpty() and frame.count() == want.count()


def test_arms_need_their_own_names(tmp_path):
    with pytest.raises(ValueError, match="names"):
        backtest(tmp_path, [Arm("x"), Arm("x")])


def test_forecaster_takes_families_and_weights(made, spark, tmp_path, monkeypatch):  # noqa: F811
    past, future = (df.filter("Store <= 24") for df in made)
    train, sold = past.filter("Open = 1 and Sales > 0"), future.filter("Open = 1 and Sales > 0")
    scores = {}
    for name, own in {"families": {"families": {"reopening": True, "month": True, "promo2": True, "easter": False}, "since_reopening": True}, "weights": {"exact_weights": True, "families": {"closure": "distances"}}}.items():
        model = Forecaster(params=SMALL, n_segments=2, min_days=300, min_cell_stores=4, **own).fit(train, past, fixed_rounds=5)
        out = model.predict(future.drop("Sales")).join(sold.select("Store", "Date", "Sales"), ["Store", "Date"])
        scores[name] = rmspe(out)
        model.save(str(tmp_path / name))
        again = Forecaster.load(spark, str(tmp_path / name))
        assert again.features.names == model.features.names and again.exact_weights == model.exact_weights
        assert abs(rmspe(again.predict(future.drop("Sales")).join(sold.select("Store", "Date", "Sales"), ["Store", "Date"])) - scores[name]) < 1e-9
        if name == "families":
            assert {"days_since_reopening", "days_to_month_end", "promo_cycle_pos"} <= set(model.features.names) and "days_to_easter" not in model.features.names
        if name == "weights":
            assert "open_yesterday" not in model.features.names and "days_to_next_holiday" in model.features.names
    # A save that breaks leaves the model before it.
    model.card["note"] = "half written"
    with monkeypatch.context() as m:
        m.setattr(versions, "commit", lambda *_: (_ for _ in ()).throw(InterruptedError()))
        with pytest.raises(InterruptedError):
            model.save(str(tmp_path / "weights"))
    old = Forecaster.load(spark, str(tmp_path / "weights"))
    assert "note" not in old.card and old.predict(future.limit(5), planned=future.drop("Sales")).count() == 5
    with pytest.raises(ValueError, match="no saved"):
        Forecaster.load(spark, str(tmp_path / "nothing"))
    assert all(s < 0.4 for s in scores.values()) and scores["weights"] != scores["families"]
    with pytest.raises(ValueError, match="no such feature family"):
        Forecaster(families={"weather": True}).fit(train, past)


def test_reopening_columns_do_not_depend_on_how_much_history_is_kept(made):  # noqa: F811
    from storecast.operators.calendar import extended, reopening
    from storecast.schema import LONG_CLOSURE, REOPENING_CAP

    past, future = (df.filter("Store <= 6") for df in made)
    # A long closure for two stores, one of it far back.
    shut = lambda s, a, b: (F.col("Store") == s) & F.col("Date").between(F.lit(dt.date(2014, 1, 6) + dt.timedelta(a)), F.lit(dt.date(2014, 1, 6) + dt.timedelta(b)))
    past = past.withColumn("Open", F.when(shut(2, 50, 90) | shut(3, 380, 420), 0).otherwise(F.col("Open")))
    whole = reopening(past.select("Store", "Date", "Open", "StateHoliday").unionByName(future.select("Store", "Date", "Open", "StateHoliday")))
    cut = reopening(extended(past, future, REOPENING_CAP + LONG_CLOSURE))
    days = future.select("Store", "Date")
    assert whole.join(days, ["Store", "Date"]).exceptAll(cut.join(days, ["Store", "Date"])).isEmpty()


def test_settings_are_ranked_within_each_segment(made):  # noqa: F811
    rows = made[0].filter("Open = 1 and Sales > 0 and Store <= 12").withColumn("segment", 1 + F.col("Store") % 2)
    settings = {"flat": {"maxIter": 1, "maxDepth": 0}, "deep": {"maxIter": 4, "maxDepth": 4, "stepSize": 0.5}}
    got = [(r.segment, r.place, r.setting) for r in settings_by_segment(rows, ["DayOfWeek", "Promo"], settings).orderBy("segment", "place").collect()]
    assert got == [(1, 1, "deep"), (1, 2, "flat"), (2, 1, "deep"), (2, 2, "flat")]


def plain_score(rows, g):
    return (sum((1 - g(r) * r.prediction / r.Sales) ** 2 for r in rows) / len(rows)) ** 0.5


def plain_factor(rows):
    return sum(r.prediction / r.Sales for r in rows) / sum((r.prediction / r.Sales) ** 2 for r in rows)


def test_inner_cuts_are_stored_with_their_cells_and_give_the_factors(made, spark, tmp_path, monkeypatch):  # noqa: F811
    past = made[0].filter("Store <= 30")
    arms = [Arm("by segment"), Arm("weights", segmented=False, exact_weights=True)]
    own = backtest(tmp_path / "b", arms, seeds=(0, 1), inner=True)
    assert len(own.missing(spark, 2)) == 8
    scored = own.run(past)
    assert not own.missing(spark, 2)
    inner = own.inner_scored(spark, 2)
    ends = {f.fold: f.train_end for f in FOLDS.folds(past.filter("Open = 1 and Sales > 0")).collect()}
    for r in inner.groupBy("arm", "seed", "fold").agg(F.min("Date").alias("a"), F.max("Date").alias("b")).collect():
        assert ends[r.fold] - dt.timedelta(42) < r.a < r.b <= ends[r.fold]
    got = {(r.arm, r.fold): r for r in corrections(scored, inner, keys=("arm", "fold")).collect()}
    assert len(got) == 4
    new, old = scored.collect(), inner.collect()
    for (arm, fold), r in got.items():
        of = lambda rows, **k: [x for x in rows if x.arm == arm and x.fold == fold and all(x[n] == v for n, v in k.items())]  # noqa: B023, E731
        segments = {x.segment for x in of(new)}
        assert segments == ({1, 2} if arm == "by segment" else {None})
        by = {s: plain_factor(of(old, segment=s)) for s in segments}
        one, top = plain_factor(of(old)), plain_factor(of(new))
        assert r.factor == pytest.approx(one) and r.ceiling_factor == pytest.approx(top)
        for name, g in (("before", lambda _: 1), ("one_factor", lambda _: one), ("by_group", lambda x: by[x.segment]), ("ceiling", lambda _: top)):  # noqa: B023
            assert r[name] == pytest.approx(sum(plain_score(of(new, seed=s), g) for s in (0, 1)) / 2), (arm, fold, name)
    # A cell without its inner cut is missing; an arm that needs none is not.
    again = backtest(tmp_path / "b", arms, seeds=(0, 1))
    assert not again.missing(spark, 2)
    verdicts = {r.arm: r for r in accepted(correction_scores(corrections(scored.filter("arm = 'weights'"), inner.filter("arm = 'weights'"))), "before").collect()}
    assert set(verdicts) == {"one_factor", "by_group", "ceiling"} and all(v.folds == 2 for v in verdicts.values())


def test_corrections_of_odd_input(spark):
    cols = "fold int, seed int, segment int, Sales long, prediction double"
    rows = spark.createDataFrame([(1, 0, 1, 10, 20.0), (1, 0, None, 10, 5.0), (1, 0, 1, 0, None), (2, 0, 1, 10, 10.0)], cols)
    inner = spark.createDataFrame([(1, 0, None, 10, 20.0), (1, 0, 9, 10, 20.0)], cols)
    got = {r.fold: r for r in corrections(rows, inner).collect()}
    # Segment 1 has no inner cut and keeps its predictions; null segments are one group; window 2 has no inner cut.
    assert got[1].factor == 0.5 and got[1].by_group == pytest.approx(((1 - 2) ** 2 / 2 + (1 - 0.25) ** 2 / 2) ** 0.5)
    assert got[1].one_factor == pytest.approx(((1 - 1) ** 2 / 2 + (1 - 0.25) ** 2 / 2) ** 0.5)
    assert got[2].factor is None and got[2].one_factor == got[2].before == 0.0
    assert corrections(rows.limit(0), inner).isEmpty()
    with pytest.raises(Exception, match="no prediction"):
        corrections(rows.withColumn("prediction", F.lit(None).cast("double")), inner).collect()
