"""What a task holds does not grow with the panel; scored rows are computed once; medians of folds are those of percentile."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from storecast import queries
from storecast.operators import calendar as cal
from storecast.operators.baseline import scored_folds
from storecast.operators.features import since_reopening
from storecast.operators.validation import RollingOrigin
from storecast.sources import tables
from storecast.sources.panel import daily_rows

DAY = dt.date(2020, 1, 1)


@pytest.fixture
def panel(spark):
    """40 stores with 120 days; store 39 is new in the last window, promotions and sales may be null."""
    rng = np.random.default_rng(8)
    rows = []
    for store in range(40):
        for k in range(0 if store < 39 else 112, 120):
            if rng.random() < 0.9:
                sales = None if rng.random() < 0.03 else int(rng.integers(1, 30))
                rows.append((store, DAY + dt.timedelta(k), sales, int(rng.random() < 0.9), None if rng.random() < 0.03 else int(rng.integers(0, 2)), "0", k % 7 + 1))
    return tables.written(spark.createDataFrame(rows, "Store int, Date date, Sales long, Open int, Promo int, StateHoliday string, DayOfWeek int"), "panel")


def partitions(df):
    return df.rdd.getNumPartitions()


def test_tasks_are_as_many_as_rows_ask_for(spark, sf_dir, panel, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 200)
    n = panel.count()
    assert partitions(cal.reopening(panel)) >= n // 200
    assert partitions(scored_folds(panel, RollingOrigin(3, 10, min_train_days=20))) >= n // 200
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert partitions(daily_rows(spark, sf_dir)) >= lines // 200


def test_scored_rows_are_stored_once_and_nothing_else_is_kept(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(tables, "_kept", {})
    out = queries.scored(spark, sf_dir)
    assert tables.is_stored(out) and list(tables._kept) == [out._stored_at] and "Customers" not in out.columns


@pytest.mark.parametrize("fixed", [False, True])
def test_medians_of_folds_are_those_of_percentile(spark, panel, fixed):
    split = RollingOrigin(3, 10, min_train_days=20)
    folds = split.folds(panel).orderBy("fold").collect()
    got = {(r.fold, r.Store, r.Date): r.prediction for r in scored_folds(panel, split, fixed_train=fixed).collect()}
    levels, seen = (["Store", "DayOfWeek", "Promo"], ["Store"], []), 0
    for f in folds:
        train = panel.filter(F.col("Date") <= F.lit(folds[0].train_end if fixed else f.train_end))
        own = [{tuple(r[:-1]): r[-1] for r in train.groupBy(*by).agg(F.percentile("Sales", 0.5)).collect()} for by in levels]
        for r in panel.filter(F.col("Date").between(F.lit(f.valid_start), F.lit(f.valid_end))).collect():
            found = [None if r.Promo is None else own[0].get((r.Store, r.DayOfWeek, r.Promo)), own[1].get((r.Store,)), own[2][()]]
            assert got[f.fold, r.Store, r.Date] == next(x for x in found if x is not None)
            seen += 1
    assert seen == len(got)


def test_rows_since_a_reopening(spark):
    shut = range(20, 60)
    day = lambda s, k: (s, DAY + dt.timedelta(k), 0 if s and k in shut else 1, "0", 10 + k)
    days = tables.written(spark.createDataFrame([day(s, k) for s in range(3) for k in range(90 if s < 2 else 65)], "Store int, Date date, Open int, StateHoliday string, Sales int"), "days")
    rows = since_reopening(days.filter("Open = 1"), days, least=20)
    got = {r.Store: (r.n, (r.first - DAY).days) for r in rows.groupBy("Store").agg(F.count("*").alias("n"), F.min("Date").alias("first")).collect()}
    # Store 0 never shut; store 1 has 30 days since; store 2 has five, which are too few.
    assert got == {0: (90, 0), 1: (30, 60), 2: (25, 0)} and rows.columns == days.columns


def test_a_fit_keeps_its_own_columns_in_tasks_of_bounded_rows(spark, panel, monkeypatch):
    from storecast.jobs.model import SalesModel

    monkeypatch.setattr(tables, "TASK_ROWS", 200)
    seen, own = [], SalesModel._regressor

    class Watched:
        def __init__(self, regressor):
            self.regressor = regressor

        def fit(self, rows):
            seen.append((set(rows.columns), partitions(rows), rows.count()))
            return self.regressor.fit(rows)

    monkeypatch.setattr(SalesModel, "_regressor", lambda self, trees: Watched(own(self, trees)))
    train = panel.filter("Sales > 0 and Promo is not null")
    model = SalesModel(["DayOfWeek", "Store"], {"maxDepth": 2}, fixed_rounds=2).fit(train)
    assert seen and all(columns == {"features", "label", "Date"} and parts >= n // 200 for columns, parts, n in seen)
    assert model.predict(train).filter("prediction > 0").count() == train.count()


def test_fold_medians_sort_a_store_without_windows(spark):
    import statistics
    from types import SimpleNamespace

    from storecast.operators.folds import fold_medians

    first = DAY
    rows = [(s, first + dt.timedelta(k), k % 7 + 1 if k % 31 else None, k % 2 if k % 29 else None, (s * 7919 + k * k * 31) % 997 if k % 23 else None) for s in range(9) for k in range(0, 200, s + 1)]
    df = spark.createDataFrame(rows, "Store int, Date date, DayOfWeek int, Promo int, Sales long")
    folds = [SimpleNamespace(train_end=first + dt.timedelta(k)) for k in (0, 90, 150)]
    own = fold_medians(df, folds, len(rows))
    assert "Window" not in own.by_store._jdf.queryExecution().executedPlan().toString()
    middle = lambda x: statistics.median(x) if x else None
    known = [r for r in rows if r[4] is not None]
    got = {r.Store: r for r in own.by_store.collect()}
    for f, fold in enumerate(folds):
        train = [r for r in known if r[1] <= fold.train_end]
        assert own.overall.first().medians[f] == middle([r[4] for r in train])
        for s, r in got.items():
            assert r.medians[f] == middle([x[4] for x in train if x[0] == s])
            for key, x in r.key_medians.items():
                assert x[f] == middle([x[4] for x in train if (x[0], x[2], x[3]) == (s, key.DayOfWeek, key.Promo)])
    assert got.keys() == {r[0] for r in known if r[1] <= folds[-1].train_end}


def test_a_counted_model_is_cut_and_not_grown_again(spark, panel, monkeypatch):
    from storecast.jobs.model import SalesModel, inner_split
    from storecast.sources.tables import TASK_ROWS, dealt

    own, grown = SalesModel._regressor, []
    monkeypatch.setattr(SalesModel, "_regressor", lambda self, trees: (grown.append(trees), own(self, trees))[1])
    train = panel.filter("Sales > 0 and Promo is not null")
    model = SalesModel(["DayOfWeek", "Promo", "Store"], {"maxDepth": 2, "maxIter": 9}, inner_days=30).fit(train, watch=True)
    assert grown == [9, model.rounds] and 1 <= model.rounds < 9 and model.watched.getNumTrees == model.rounds
    # The trees kept are those that a fit of that number gives on the same rows.
    old, new = inner_split(model.assembled(train.withColumn("label", F.log1p("Sales"))).coalesce(1).persist(), 30)
    counted, alone = model._grown(old, new), own(model, 1).fit(old)
    again = own(model, counted.getNumTrees).fit(old)
    text = lambda m: m.toDebugString.split("\n")[1:]
    assert text(counted) == text(again) and text(counted.trees[0]) == text(alone.trees[0])
    same = counted.transform(new).select("raw").collect()
    assert same == again.transform(new).select("raw").collect() and len(same) == new.count()
    model.model = counted
    assert {r.feature for r in model.importance(spark).collect()} == {"DayOfWeek", "Promo", "Store"}
    # A fit's tasks are no more than the cores until the rows ask for them.
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    assert (partitions(dealt(panel, "Store", 90, 2)), partitions(dealt(panel, "Store", 1000, 2)), TASK_ROWS) == (2, 10, 250_000)


def test_feature_days_are_stored_without_facts_in_buckets_by_rows(spark, sf_dir, monkeypatch):
    from storecast.operators import features

    monkeypatch.setattr(tables, "TASK_ROWS", 200)
    seen = []
    monkeypatch.setattr(queries, "bucketed", lambda df, name, **own: seen.append((df.columns, own)) or tables.bucketed(df, name, **own))
    out = queries.q_features(spark, sf_dir)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    ((columns, own),) = seen
    assert not {"StoreType", "CompetitionDistance", "PromoInterval"} & set(columns) and own["buckets"] >= lines // 200
    # The same rows as with facts in the panel and numbers rounded in every row.
    days = tables.written(queries.panel(spark, sf_dir), "panel")
    train_end, _ = queries.window_start(days)
    learned = features.statistics(queries.open_days(days).filter(F.col("Date") <= F.lit(train_end)))
    first, last = cal.bounds(days)
    want = queries.r6(features.Features(learned, days, with_reopening=True, month=True).of_panel(days, first, last).select(*out.columns))
    assert out.exceptAll(want).isEmpty() and out.count() == want.count() > 0 and out.dtypes == want.dtypes


def test_fold_means_are_those_of_counted_numbers(spark, panel):
    from storecast.operators.folds import fold_means, fold_statistics

    split = RollingOrigin(3, 10, min_train_days=20)
    days = panel.withColumns({"CompetitionDistance": F.when(F.col("Store") % 3 > 0, 10.0 * F.col("Store")), "DayOfWeek": F.when(F.col("Store") != 7, F.col("DayOfWeek"))})
    folds = split.folds(days).orderBy("fold").collect()
    own, want = fold_means(days, folds), fold_statistics(days, folds=folds)
    read = lambda s: ({r.Store: (r.means, r.uplifts, r.weekday_means) for r in s.by_store.collect()}, s.overall.select("means", "uplifts").first(), s.distance.first())
    assert read(own) == read(want) and own.by_store.count() > 30
    # No median of sales, and no row for every number sold.
    plan = own.by_store._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "Sales" not in own.by_store.columns and "medians" not in own.by_store.columns


def test_the_fits_of_a_fold_share_their_rows_in_memory(spark, panel, tmp_path, monkeypatch):
    from storecast.jobs import backtest
    from storecast.jobs.model import SalesModel

    facts = {"Assortment": F.lit("a"), "StoreType": F.lit("b"), "SchoolHoliday": F.lit(0), "CompetitionDistance": F.lit(5.0), "Promo2": F.lit(0)}
    none = ("CompetitionOpenSinceMonth", "CompetitionOpenSinceYear", "Promo2SinceWeek", "Promo2SinceYear")
    days = panel.filter("Promo is not null and Sales is not null").withColumns(facts | {n: F.lit(None).cast("int") for n in none} | {"PromoInterval": F.lit(None).cast("string")})
    monkeypatch.setattr(tables, "TASK_ROWS", 200)
    held, fits, own = [], [], SalesModel._regressor

    class Watched:
        def __init__(self, regressor):
            self.regressor = regressor

        def fit(self, rows):
            fits.append((rows.count(), partitions(rows), rows._jdf.queryExecution().optimizedPlan().toString()))
            return self.regressor.fit(rows)

    monkeypatch.setattr(SalesModel, "_regressor", lambda self, trees: Watched(own(self, trees)))
    plain, names = backtest.hold, ("DayOfWeek", "Promo")
    kept = lambda: set(spark.sparkContext._jsc.getPersistentRDDs())
    before = kept()
    monkeypatch.setattr(backtest, "hold", lambda rows, count: held.append(count) or plain(rows, count))
    arms = [backtest.Arm("two", names=names, segmented=False), backtest.Arm("one", names=names[:1], segmented=False)]
    out = backtest.Backtest(str(tmp_path / "b"), arms, splitter=RollingOrigin(2, 10, min_train_days=20), params={"maxDepth": 2}, options={"fixed_rounds": 2}).run(days)
    assert len(held) == 2 and sorted(n for n, _, _ in fits) == sorted(2 * held)
    # Columns are held and put together by each fit; nothing is moved again.
    assert all(parts >= n // 200 and "features" not in plan.partition("InMemoryRelation")[2] and "InMemoryRelation" in plan for n, parts, plan in fits), fits[0]
    sold = days.filter("Open = 1 and Sales > 0").filter(F.col("Date") > F.lit(DAY + dt.timedelta(99))).count()
    assert out.groupBy("arm").count().collect()[0]["count"] == sold and kept() <= before


def test_fits_that_fill_the_cores_are_run_one_at_a_time(spark):
    from storecast.jobs.pools import side_by_side

    cores = spark.sparkContext.defaultParallelism
    assert [side_by_side(spark, 4, n) for n in (0, 1, 2 * cores, 4 * cores, 8 * cores, 100 * cores)] == [4, 4, 4, 2, 1, 1]
    assert side_by_side(spark, 1, 1) == 1


@pytest.mark.parametrize("best, asked", [(1, [60]), (10, [60]), (11, [60, 120]), (71, [60, 120, 240])])
def test_growth_begins_little_beyond_the_patience(monkeypatch, best, asked):
    from storecast.jobs import model

    class Grown:
        def __init__(self, trees):
            self.getNumTrees = trees

        def fit(self, rows):
            return self

        def evaluateEachIteration(self, rows, loss):
            return [abs(k + 1 - best) + 1.0 for k in range(self.getNumTrees)]

    seen = []
    monkeypatch.setattr(model.SalesModel, "_regressor", lambda self, trees: (seen.append(trees), Grown(trees))[1])
    monkeypatch.setattr(model, "first_trees", lambda grown, trees: Grown(trees))
    assert model.SalesModel([])._counted(None, None) == best and seen == asked
