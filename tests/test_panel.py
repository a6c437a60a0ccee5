"""Calendars, features, folds and metrics on small tables with values by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from storecast.functions.dates import days_to_easter, easter_sunday
from storecast.functions.facts import promo2
from storecast.operators import calendar as cal
from storecast.operators.baseline import median_rule
from storecast.operators.experiment import run_cv
from storecast.operators.features import Features, statistics
from storecast.operators.metrics import rmspe
from storecast.operators.monitor import alarms, evaluate
from storecast.operators.quantiles import quantiles
from storecast.operators.segments import merged_cells, ward
from storecast.operators.validation import RollingOrigin
from storecast.schema import DAILY, STORE
from storecast.sources import files

DAY = dt.date(2014, 1, 1)
CAL = "Store int, Date date, Open int, StateHoliday string"


def days(spark, spec, store=1, start=DAY, holidays=()):
    """A character per day: o open, c closed with a row, . no row."""
    rows = [(store, start + dt.timedelta(k), int(x == "o"), "a" if k in holidays else "0") for k, x in enumerate(spec) if x != "."]
    return spark.createDataFrame(rows, CAL)


def by_day(df, col):
    return {(r.Date - DAY).days: r[col] for r in df.collect()}


def plain_closure(spec, k):
    last = len(spec) - 1
    shut = lambda d: spec[d] != "o"
    nxt = -1 if k + 7 > last else sum(shut(d) for d in range(k + 1, k + 8))
    prev = -1 if k < 7 else sum(shut(d) for d in range(k - 7, k))
    return (-1 if k == 0 else int(not shut(k - 1)), -1 if k == last else int(not shut(k + 1)), nxt, prev)


@pytest.mark.parametrize("spec", ["ooc.o.cooooooccoo..oooo", "ooooooo", "oc.oooocooo", "o", "c.....................o"])
def test_closure_equals_the_day_axis(spark, spec):
    got = {(r.Date - DAY).days: (r.open_yesterday, r.open_tomorrow, r.closed_days_next_7, r.closed_days_last_7) for r in cal.closure(days(spark, spec)).collect()}
    assert got == {k: plain_closure(spec, k) for k, x in enumerate(spec) if x != "."}


def test_holidays_are_capped_at_ten(spark):
    out = cal.closure(days(spark, "o" * 40, holidays=(20,)))
    ahead, since = by_day(out, "days_to_next_holiday"), by_day(out, "days_since_last_holiday")
    assert (ahead[20], ahead[10], ahead[9], ahead[21], since[20], since[30], since[31]) == (0, 10, 10, 10, 0, 10, 10)
    assert by_day(cal.nearest_holiday(days(spark, "o" * 40, holidays=(20,))), "holiday_gap")[0] == 20
    assert set(by_day(cal.nearest_holiday(days(spark, "ooo")), "holiday_gap").values()) == {99}


def test_reopening_counts_from_the_newest_long_gap(spark):
    spec = "ooo" + "." * 21 + "oco" + "c" * 20 + "o" + "." * 25 + "oo"
    got = by_day(cal.reopening(days(spark, spec)), "days_since_reopening")
    assert (got[2], got[24], got[25], got[26]) == (365, 0, 1, 2)
    assert (got[47], got[73], got[74]) == (23, 0, 1)
    # A store that begins 30 days after the calendar has been closed; one that ends early has not reopened.
    both = days(spark, "o" * 60).unionByName(days(spark, "." * 30 + "oo", store=2))
    late = {(r.Store, (r.Date - DAY).days): r.days_since_reopening for r in cal.reopening(both).collect()}
    assert (late[2, 30], late[2, 31], late[1, 59]) == (0, 1, 365)


def test_plan_wins_and_single_rows_need_one(spark):
    known, plan = days(spark, "o" * 30), days(spark, "c" * 5, start=DAY + dt.timedelta(28))
    got = by_day(cal.extended(known, plan), "Open")
    assert got == {**{k: 1 for k in range(18, 28)}, **{k: 0 for k in range(28, 33)}}
    lone = days(spark, "o", start=DAY + dt.timedelta(40))
    with pytest.raises(ValueError, match="previous day"):
        cal.check_neighbours(lone, known.unionByName(lone), DAY + dt.timedelta(29))
    cal.check_neighbours(plan, known.unionByName(plan), DAY + dt.timedelta(27))


def test_easter(spark):
    df = spark.createDataFrame([(y,) for y in range(1900, 2100)], "y int").select("y", easter_sunday(F.col("y")).alias("e"))
    got = {r.y: r.e for r in df.collect()}
    assert (got[2013], got[2014], got[2015], got[1954], got[1981], got[2049]) == (dt.date(2013, 3, 31), dt.date(2014, 4, 20), dt.date(2015, 4, 5), dt.date(1954, 4, 18), dt.date(1981, 4, 19), dt.date(2049, 4, 18))
    assert all(e.isoweekday() == 7 and dt.date(y, 3, 22) <= e <= dt.date(y, 4, 25) for y, e in got.items())
    away = spark.createDataFrame([(dt.date(2014, 3, 3),), (dt.date(2015, 4, 5),), (dt.date(2014, 12, 1),)], "Date date").select(days_to_easter().alias("d")).collect()
    assert [r.d for r in away] == [-48, 0, 60]


def test_promo2_edges(spark):
    schema = "Date date, Promo2 int, Promo2SinceWeek int, Promo2SinceYear int, PromoInterval string"
    rows = [(dt.date(2014, 12, 29), 1, 2, 2014, "Mar,Jun,Sept,Dec"), (dt.date(2014, 9, 1), 1, 10, 2013, "Mar,Jun,Sept,Dec"), (dt.date(2014, 9, 1), 1, None, 2013, "Jan,Apr,Jul,Oct"), (dt.date(2014, 9, 1), 0, None, None, None)]
    got = [(r.promo2_active, r.promo2_tenure_weeks, r.promo_cycle_pos) for r in promo2(spark.createDataFrame(rows, schema)).collect()]
    assert got == [(0, 0, -1), (1, 78, 0), (0, 0, 2), (0, 0, -1)]


def test_rmspe(spark):
    make = lambda rows: spark.createDataFrame(rows, "Sales long, prediction double")
    assert rmspe(make([(100, 100.0), (200, 200.0)])) == 0
    assert math.isclose(rmspe(make([(100, 110.0), (0, 5000.0), (200, 220.0)])), 0.1)
    for bad in ([(0, 1.0)], [(100, float("nan"))], [(100, None)]):
        with pytest.raises(ValueError):
            rmspe(make(bad))


def test_folds(spark):
    df = spark.createDataFrame([(DAY + dt.timedelta(k), 1) for k in range(600)], "Date date, Sales int")
    rows = RollingOrigin().describe(df).orderBy("fold").collect()
    assert [(r.valid_rows, r.train_rows) for r in rows] == [(42, 600 - 42 * k) for k in (4, 3, 2, 1)] and rows[-1].valid_end == DAY + dt.timedelta(599)
    with pytest.raises(ValueError, match="fewer"):
        RollingOrigin().describe(df.limit(400))
    with pytest.raises(ValueError):
        RollingOrigin(n_splits=0)


def test_baseline_falls_back(spark):
    schema = "Store int, DayOfWeek int, Promo int, Sales long"
    train = spark.createDataFrame([(1, 1, 0, 10), (1, 1, 0, 20), (1, 2, 0, 90)], schema)
    rows = spark.createDataFrame([(1, 1, 0, 1), (1, 1, 1, 1), (2, 1, 0, 1)], schema)
    assert [r.prediction for r in median_rule(train, rows).orderBy("Store", "Promo").collect()] == [15, 20, 20]


def test_weekly_report_and_alarm(spark):
    rows = [(DAY + dt.timedelta(5 + 7 * w), 100, 100.0 + x, 0.0, 1000.0) for w, x in enumerate((0, 20, 30, 1))]
    report = evaluate(spark.createDataFrame(rows, "Date date, Sales int, prediction double, low double, high double"), 0.17)
    got = {r.week: r for r in report.collect()}
    assert got["all"].rows == 4 and all(r.coverage == 1 for r in got.values())
    assert [r.state for r in alarms(report).orderBy("week").collect()] == ["fine", "warning", "alarm", "fine"]


def test_files_round_trip(spark, tmp_path):
    daily = [(1, 7, dt.date(2014, 6, 1), 0, 0, 0, 0, "0", 0), (1, 1, dt.date(2014, 6, 2), 5, 1, 1, 0, "a", 0), (9, 2, dt.date(2014, 6, 3), 6, 2, 1, 1, "0", 0)]
    store = [(1, "a", "b", 100.0, None, None, 1, 1, 2010, "Jan,Apr,Jul,Oct")]
    spark.createDataFrame(daily, DAILY).write.option("header", True).csv(f"{tmp_path}/daily")
    spark.createDataFrame(store, STORE).write.option("header", True).csv(f"{tmp_path}/store")
    rows = files.read_panel(spark, f"{tmp_path}/daily", f"{tmp_path}/store").orderBy("Store").collect()
    assert [(r.Store, r.Sales, r.StateHoliday, r.PromoInterval) for r in rows] == [(1, 5, "a", "Jan,Apr,Jul,Oct"), (9, 6, "0", None)]
    (tmp_path / "request.csv").write_text("Id,Store,Date,Open,Promo,StateHoliday,SchoolHoliday\n1,1,2015-06-01,1,1,0,0\n2,1,2015-06-02,,0,a,0\n")
    asked = files.read_request(spark, f"{tmp_path}/request.csv", f"{tmp_path}/store").orderBy("Id").collect()
    assert [(r.DayOfWeek, r.Open, r.StateHoliday) for r in asked] == [(1, 1, "0"), (2, 1, "a")]


def test_features_do_not_see_the_rows_they_describe(spark, sf_dir):
    from storecast.queries import history, open_panel, panel

    built = Features(statistics(history(spark, sf_dir)), panel(spark, sf_dir))
    rows = open_panel(spark, sf_dir)
    doubled = rows.withColumn("Sales", rows.Sales * 2)
    one, two = (built.transform(x).select("Store", "Date", *built.names) for x in (rows, doubled))
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
    with pytest.raises(ValueError, match="calendar"):
        Features(built.learned, built.calendar.filter("Store <> 1")).transform(rows, validate=True)


def test_cell_merge_and_ward():
    import numpy as np

    total = {0: np.array([0.0]), 1: np.array([2.0]), 2: np.array([200.0]), 3: np.array([1000.0])}
    assert merged_cells({0: 20, 1: 2, 2: 20, 3: 20}, total, 15, 1) == {0: 0, 1: 0, 2: 2, 3: 3}
    assert ward(np.array([[0.0], [1.0], [10.0], [11.0], [50.0]]), 3) == [0, 0, 1, 1, 2]


def test_repeated_days_count_once(spark):
    spec = "ooooccooooooooo"
    once, twice = days(spark, spec), days(spark, spec).unionByName(days(spark, spec)).unionByName(days(spark, "c" * len(spec)))
    same = lambda f: sorted(map(str, f(once).collect())) == sorted(map(str, f(twice).collect()))
    assert same(cal.closure) and same(cal.reopening) and same(lambda d: cal.extended(once, d)) and same(lambda d: cal.extended(d, once))
    assert cal.last_per_key(twice.withColumn("v", F.col("Open")), ["Store", "Date"], "v").count() == len(spec)


def test_missing_predictions_are_an_error(spark):
    schema = "Date date, Sales int, prediction double"
    with pytest.raises(Exception, match="has no prediction"):
        evaluate(spark.createDataFrame([(DAY, 5, None), (DAY, 5, 5.0)], schema)).collect()
    assert evaluate(spark.createDataFrame([(DAY, 0, None), (DAY, 5, 5.0)], schema)).filter("week = 'all'").first().rmspe == 0
    assert evaluate(spark.createDataFrame([], schema)).count() == 0


def test_malformed_files_are_an_error(spark, tmp_path):
    good = "Store,Date,Sales,Open\n1,2014-01-02,9.0,\n"
    (tmp_path / "a.csv").write_text(good)
    row = files.read(spark, str(tmp_path / "a.csv"), DAILY).first()
    assert (row.Store, row.Date, row.Sales, row.Open) == (1, dt.date(2014, 1, 2), 9, None)
    for name, bad in (("b", good.replace("2014-01-02", "2014-13-45")), ("c", good.replace("9.0", "abc"))):
        (tmp_path / f"{name}.csv").write_text(bad)
        with pytest.raises(Exception, match="malformed"):
            files.read(spark, str(tmp_path / f"{name}.csv"), DAILY).collect()


def test_cross_validation_of_a_function(spark):
    rows = spark.createDataFrame([(1, DAY + dt.timedelta(k), 100 + k % 3) for k in range(60)], "Store int, Date date, Sales int")
    split = RollingOrigin(n_splits=2, horizon_days=10, min_train_days=10)
    results, scored = run_cv(rows, lambda train, valid: valid.withColumn("prediction", F.lit(100.0)), split)
    assert sorted((r.fold, r.rows) for r in results.collect()) == [(1, 10), (2, 10)] and scored.count() == 20
    with pytest.raises(ValueError, match="prediction"):
        run_cv(rows, lambda train, valid: valid, split)


def test_quantiles_are_those_of_percentile(spark):
    """Ties, null keys, null values, a group of nulls only, one large group, shares at the ends, an empty table."""
    rows = [("a", float(k * 37 % 101)) for k in range(900)] + [("b", 5.0)] * 40 + [(None, v) for v in (1.0, 4.0, None)] + [("c", None), ("d", -2.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"least": 0.0, "low": 0.13, "half": 0.5, "high": 0.9, "most": 1.0}
    want = df.filter("v is not null").groupBy("g").agg(*(F.percentile("v", s).alias(n) for n, s in shares.items()))
    key = lambda r: str(r.g)
    got, want = sorted(quantiles(df, ["g"], "v", shares).collect(), key=key), sorted(want.collect(), key=key)
    assert [r.g for r in got] == [r.g for r in want]
    assert all(a == pytest.approx(b) for g, w in zip(got, want, strict=True) for a, b in zip(g[1:], w[1:], strict=True))
    assert quantiles(df, [], "v", {"half": 0.5}).first().half == df.agg(F.median("v")).first()[0]
    assert quantiles(df.limit(0), ["g"], "v", shares).isEmpty()
