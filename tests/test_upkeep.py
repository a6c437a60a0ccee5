"""A calendar kept up to date equals one built at once; versions are whole or not there; columns and scores by fold from counts."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from storecast.jobs.calendar_store import CalendarStore
from storecast.operators.calendar import around
from storecast.operators.folds import by_fold, counted, fold_statistics
from storecast.operators.validation import RollingOrigin
from storecast.sources import versions

FIRST = dt.date(2013, 1, 20)


@pytest.fixture(scope="module")
def days(spark):
    """Thirty stores over five months with gaps, repeated days, long closures that cross updates, and stores that begin late or end early."""
    rng = np.random.default_rng(8)
    rows = []
    for s in range(30):
        shut = {int(rng.integers(0, 150)): int(rng.integers(15, 40)) for _ in range(int(rng.integers(0, 4)))}
        for k in range(150):
            if (s == 5 and k < 60) or (s == 6 and k > 60) or rng.random() < 0.05:
                continue
            is_open = int(rng.random() < 0.85 and not any(a <= k < a + n for a, n in shut.items()))
            rows.append((s, FIRST + dt.timedelta(k), is_open, "a" if rng.random() < 0.03 else None if rng.random() < 0.05 else "0"))
            if rng.random() < 0.02:
                rows.append((s, FIRST + dt.timedelta(k), 1 - is_open, "b"))
    return spark.createDataFrame(rows, "Store int, Date date, Open int, StateHoliday string").persist()


def same(a, b):
    cols = ["Store", "Date", "open_yesterday", "open_tomorrow", "closed_days_next_7", "closed_days_last_7", "days_to_next_holiday", "days_since_last_holiday", "days_since_reopening"]
    a, b = a.select(cols), b.select(cols)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def up_to(df, k):
    return df.filter(F.col("Date") < F.lit(FIRST + dt.timedelta(k)))


def test_added_weeks_equal_a_full_rebuild(spark, days, tmp_path):
    store = CalendarStore(spark, str(tmp_path / "c"))
    assert store.days().isEmpty() and store.add(days.limit(0)) == 0
    bounds = [0, 33, 40, 41, 76, 150]
    for a, b in zip(bounds, bounds[1:]):
        week = up_to(days, b).filter(F.col("Date") >= F.lit(FIRST + dt.timedelta(a)))
        assert store.add(week) == week.select("Store", "Date").distinct().count()
        assert same(store.days(), around(up_to(days, b)))
    with pytest.raises(ValueError, match="known already"):
        store.add(up_to(days, 1))


def test_an_update_reads_two_months_at_most(spark, days, tmp_path, monkeypatch):
    store = CalendarStore(spark, str(tmp_path / "c"))
    store.add(up_to(days, 120))
    read = set()
    plain = CalendarStore.days

    def watched(self, *a):
        df = plain(self, *a)
        read.update(r[0].rpartition("month=")[2].partition("/")[0] for r in df.select(F.input_file_name()).distinct().collect())
        return df

    monkeypatch.setattr(CalendarStore, "days", watched)
    store.add(up_to(days, 127).filter(F.col("Date") >= F.lit(FIRST + dt.timedelta(120))))
    assert 1 <= len(read) <= 2 < len({p.name for p in (tmp_path / "c" / "months").iterdir() if p.name.startswith("month=")})


def test_an_update_that_breaks_is_put_right(spark, days, tmp_path, monkeypatch):
    store = CalendarStore(spark, str(tmp_path / "c"))
    store.add(up_to(days, 60))
    week = up_to(days, 67).filter(F.col("Date") >= F.lit(FIRST + dt.timedelta(60)))

    def broken(*_):
        raise InterruptedError

    monkeypatch.setattr(versions, "commit", broken)
    with pytest.raises(InterruptedError):
        store.add(week)
    monkeypatch.undo()
    assert store.days().agg(F.max("Date")).first()[0] < FIRST + dt.timedelta(60)
    assert store.add(week) > 0 and same(store.days(), around(up_to(days, 67)))


def test_versions_are_whole_or_not_there(spark, tmp_path):
    path = str(tmp_path / "v")
    assert versions.latest(spark, path) is None
    for k in range(4):
        folder = versions.new_folder(path)
        spark.range(k + 1).write.parquet(f"{folder}/t")
        if k != 2:
            assert versions.commit(spark, path, folder, {"k": k}) == (k if k == 3 else k + 1)
        got = versions.latest(spark, path)
        assert got["k"] == (1 if k == 2 else k) and spark.read.parquet(f"{got['folder']}/t").count() == got["k"] + 1
    assert len([p for p in (tmp_path / "v").iterdir() if p.name.startswith("version-")]) == 2


def test_counts_of_two_tables_add_up(spark):
    rng = np.random.default_rng(3)
    rows = [(int(s), int(rng.integers(1, 8)) if rng.random() > 0.05 else None, int(rng.integers(0, 2)), FIRST + dt.timedelta(int(k)), int(rng.integers(0, 30)) if rng.random() > 0.05 else None) for s in range(6) for k in range(200)]
    df = spark.createDataFrame(rows, "Store int, DayOfWeek int, Promo int, Date date, Sales long").persist()
    split = RollingOrigin(n_splits=3, horizon_days=20, step_days=8, min_train_days=50)
    folds = split.folds(df).orderBy("fold").collect()
    ends = [f.train_end for f in folds]
    early = df.filter(F.col("Date") <= F.lit(ends[0]))
    late = df.filter(F.col("Date") > F.lit(ends[0]))
    keys = ["Store", "DayOfWeek", "Promo"]
    both = counted(early, ends, *keys).unionByName(counted(late, ends, *keys))
    a, b = by_fold(both, 3, *keys), by_fold(counted(df, ends, *keys), 3, *keys)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    own = fold_statistics(df, split)
    pdf = df.toPandas()
    stores = {r.Store: r for r in own.by_store.collect()}
    every = own.overall.first()
    for f in folds:
        train = pdf[pdf.Date <= f.train_end]
        assert every.medians[f.fold - 1] == train.Sales.median() and every.means[f.fold - 1] == pytest.approx(train.Sales.mean())
        for s, part in train.groupby("Store"):
            r = stores[s]
            assert r.means[f.fold - 1] == pytest.approx(part.Sales.mean()) and r.medians[f.fold - 1] == part.Sales.median()
            sides = part.groupby("Promo").Sales.mean()
            assert r.uplifts[f.fold - 1] == pytest.approx(sides[1] / sides[0])
            assert {k: v[f.fold - 1] for k, v in r.weekday_means.items()} == pytest.approx(part.groupby("DayOfWeek").Sales.mean().to_dict())
            medians = part.groupby(["DayOfWeek", "Promo"]).Sales.median()
            got = {(k.DayOfWeek, k.Promo): v[f.fold - 1] for k, v in r.key_medians.items()}
            assert {k: v for k, v in got.items() if v is not None} == medians.dropna().to_dict()
    # Overlapping windows: a row is scored once for every window it stands in.
    from storecast.operators.baseline import scored_folds

    scored = scored_folds(df, split)
    assert scored.count() == sum(len(pdf[(pdf.Date >= f.valid_start) & (pdf.Date <= f.valid_end)]) for f in folds) and scored.filter("prediction is null").isEmpty()


def test_a_job_leaves_no_stored_tables(spark, monkeypatch):
    from storecast.sources import tables

    monkeypatch.setattr(tables, "_kept", {})
    df = spark.range(100).withColumnRenamed("id", "Store").withColumn("Date", F.lit(1))
    one, two, three = tables.written(df, "one"), tables.bucketed(df, "two"), tables.written(df, "three")
    assert one.count() == two.count() == three.count() == 100
    tables.dropped(three)
    assert [tables.exists(spark, x._stored_at) for x in (one, two, three)] == [True, True, False]
    assert tables.released(spark) == 2 and tables.released(spark) == 0
    assert not any(tables.exists(spark, x._stored_at) for x in (one, two)) and not spark.catalog.tableExists(two._table)


def test_a_step_keeps_its_result_alone(spark, monkeypatch):
    from storecast.sources import tables

    monkeypatch.setattr(tables, "_kept", {})
    df, made = spark.range(10).withColumn("Date", F.lit(1)), []

    def inner():
        made.append(tables.written(df, "inner"))
        return made[-1].filter("id > 1")

    def step():
        made.append(tables.bucketed(df, "first", "id"))
        made.append(tables.settled(spark, inner, "nested"))
        tables.dropped(made[0])
        return made[-1].filter("id > 2")

    def breaks():
        made.append(tables.written(df, "broken"))
        raise InterruptedError

    before = tables.written(df, "before")
    out = tables.settled(spark, step, "out")
    with pytest.raises(InterruptedError):
        tables.settled(spark, breaks, "never")
    assert out.count() == 7 and before.count() == 10 and len(made) == 4
    assert not any(tables.exists(spark, x._stored_at) for x in made) and set(tables._kept) == {out._stored_at, before._stored_at}
    assert tables.released(spark) == 2
