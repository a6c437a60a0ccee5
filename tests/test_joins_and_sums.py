"""As-of joins, running sums, pairs of folds, sketches, the report of one pass, and lines that cannot be read."""

import datetime as dt
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from storecast.operators.analysis import concentration, fold_correlations
from storecast.operators.asof import asof
from storecast.operators.quality import report
from storecast.operators.running import running
from storecast.operators.sketches import between, error, united, weekly_sketches
from storecast.schema import DAILY
from storecast.sources.files import aside_counts, read_setting_aside

DAY = dt.date(2020, 1, 1)


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables would be put together in one range, which has no border to carry anything across."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def plain_asof(rows, events, direction, strict, tolerance):
    out = []
    for n, k, t in rows:
        fits = [(et, v) for ek, et, v in events if k is not None and t is not None and ek == k and et is not None and abs(t - et) <= tolerance and ((et <= t) if direction == "backward" else (et >= t)) and not (strict and et == t)]
        best = (max(fits, key=lambda x: (x[0], x[1] is not None, x[1] or 0)) if direction == "backward" else min(fits, key=lambda x: (x[0], x[1] is None, -(x[1] or 0)))) if fits else (None, None)
        out.append((n, k, t, *best))
    return sorted(out, key=str)


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_equals_plain_python(spark, direction, strict):
    rng = np.random.default_rng(4)
    key = lambda: [None, "hot", "hot", "hot", "a", "b", "c", "d"][int(rng.integers(0, 8))]
    rows = [(n, key(), None if rng.random() < 0.02 else 500 if rng.random() < 0.3 else int(rng.integers(0, 1000))) for n in range(1500)]
    events = [(key(), None if rng.random() < 0.05 else int(rng.integers(0, 1000)) // 5 * 5, None if rng.random() < 0.1 else int(rng.integers(0, 9))) for _ in range(300)] + [("e", 5, 1)]
    a = spark.createDataFrame(rows, "n long, k string, t long").withColumns({"_t": F.lit(1), "_row": F.lit(2), "v": F.lit(3)})
    b = spark.createDataFrame(events, "k string, t long, v long").withColumn("n", F.lit(9))
    got = asof(a, b, ["k"], "t", ["v"], direction=direction, strict=strict, tolerance=60)
    assert got.columns == [*a.columns, "event_t", "event_v"]
    assert sorted(((r.n, r.k, r.t, r.event_t, r.event_v) for r in got.collect()), key=str) == plain_asof(rows, events, direction, strict, 60)


def test_a_hot_key_is_dealt_over_tasks(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("k"), F.date_add(F.lit(DAY), (F.col("id") % 1000).cast("int")).alias("t"), "id")
    events = spark.createDataFrame([(1, DAY, "first"), (2, DAY, "other"), (1, DAY + dt.timedelta(700), "late")], "k int, t date, v string")
    out = asof(rows, events, ["k"], "t", ["v"])
    assert {r.event_v: r.n for r in out.groupBy("event_v").agg(F.count("*").alias("n")).collect()} == {"first": 14_000, "late": 6_000}
    scan = next(f for f in out.inputFiles())
    sizes = [r.n for r in spark.read.parquet(scan.rpartition("/")[0]).groupBy("_range").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 3 and max(sizes) < 0.6 * sum(sizes)
    near = asof(rows, events, ["k"], "t", ["v"], tolerance=dt.timedelta(days=10)).filter("event_v is not null").select(F.max(F.date_diff("t", "event_t"))).first()[0]
    assert near == 10


def test_asof_of_empty_tables(spark):
    rows, events = spark.createDataFrame([(1, 2)], "k int, t int"), spark.createDataFrame([], "k int, t int, v int")
    assert asof(rows, events, ["k"], "t", ["v"]).collect() == [(1, 2, None, None)]
    assert asof(rows.limit(0), rows.withColumn("v", F.lit(1)), ["k"], "t", ["v"]).count() == 0
    with pytest.raises(ValueError, match="direction"):
        asof(rows, events, ["k"], "t", ["v"], direction="nearest")


def test_running_sums_over_ranges(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"x": rng.integers(0, 50, 4000), "id": np.arange(4000), "v": rng.integers(-5, 6, 4000)})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.col("id") % 7 != 0, F.col("v")))
    want = pdf.assign(v=pdf.v.where(pdf.id % 7 != 0, 0)).sort_values(["x", "id"], ascending=[False, True])
    got = running(df, [F.desc("x"), F.asc("id")], {"upto": F.col("v")}, place="place").toPandas().sort_values("place")
    assert got.id.tolist() == want.id.tolist() and got.upto.tolist() == want.v.cumsum().tolist() and got.place.tolist() == list(range(1, 4001))
    tied = running(df, [F.desc("x")], {"upto": F.col("v")}, place="place", ties=True).select("x", "upto", "place").distinct().toPandas().set_index("x")
    assert tied.place.to_dict() == {x: int((pdf.x >= x).sum()) for x in pdf.x.unique()} and tied.upto.to_dict() == {x: int(want.v[want.x >= x].sum()) for x in pdf.x.unique()}
    assert running(df.limit(0), [F.asc("x")], {"upto": F.col("v")}).count() == 0


def test_concentration_has_no_single_task(spark):
    rows = spark.createDataFrame([(k, 100, 100.0 + k % 50) for k in range(2000)], "Store int, Sales long, prediction double")
    out = concentration(rows, "Store")
    shares = out.orderBy("place").select("running_share", "Store").collect()
    assert shares[-1].running_share == pytest.approx(1) and [r.Store for r in shares[:3]] == [49, 99, 149]


def test_all_pairs_of_folds(spark):
    rng = np.random.default_rng(1)
    rows = [(s, f, 100, 100 + float(rng.normal()) * (1 + s % 5)) for s in range(40) for f in range(1, 5) if (s + f) % 6 for _ in range(3)] + [(99, 1, 0, 5.0), (98, 2, 10, 9.0)]
    df = spark.createDataFrame(rows, "Store int, fold int, Sales long, prediction double")
    pdf = pd.DataFrame(rows, columns=["s", "f", "y", "p"]).query("y != 0")
    scores = pdf.assign(q=((pdf.y - pdf.p) / pdf.y) ** 2).groupby(["s", "f"]).q.mean().pow(0.5).unstack()
    got = {(r.fold_a, r.fold_b): (r.stores, r.correlation) for r in fold_correlations(df).collect()}
    assert set(got) == set(combinations(range(1, 5), 2))
    for (a, b), (n, c) in got.items():
        both = scores[[a, b]].dropna()
        assert n == len(both) and c == pytest.approx(both[a].corr(both[b]))


def test_sketches_unite_over_any_weeks(spark):
    rows = spark.range(60_000).select(F.date_add(F.lit(DAY), (F.col("id") % 140).cast("int")).alias("Date"), (F.col("id") * 7919 % 20_011).alias("x"), (F.col("id") % 3).alias("few")).persist()
    weeks = weekly_sketches(rows, ["x", "few"]).persist()
    assert weeks.count() == rows.select(F.date_trunc("week", "Date")).distinct().count()
    # Added later, in parts, or at once: the same.
    cut = F.col("Date") < F.lit(DAY + dt.timedelta(61))
    parts = weekly_sketches(rows.filter(cut), ["x", "few"]).unionByName(weekly_sketches(rows.filter(~cut), ["x", "few"]))
    for own in (weeks, parts):
        for r in united(own, ["x", "few"], F.date_trunc("month", "week").cast("date").alias("month")).collect():
            exact = rows.filter((F.date_trunc("month", F.date_trunc("week", "Date")).cast("date")) == F.lit(r.month)).agg(F.count_distinct("x")).first()[0]
            assert abs(r.x - exact) <= error() * exact and r.few == 3
    one = between(weeks, ["x"], DAY, DAY + dt.timedelta(40)).first()
    exact = rows.filter(F.date_trunc("week", "Date").between(F.lit(DAY), F.lit(DAY + dt.timedelta(40)))).agg(F.count_distinct("x")).first()[0]
    assert abs(one.x - exact) <= error() * exact
    assert between(weeks, ["x"], dt.date(1999, 1, 1), dt.date(1999, 2, 1)).first().weeks == 0


def test_report_counts_every_check(spark):
    row = lambda **x: {"Store": 1, "DayOfWeek": 3, "Date": DAY, "Sales": 5, "Customers": 1, "Open": 1, "Promo": 0, "StateHoliday": "0", "SchoolHoliday": 0, "StoreType": "a", **x}
    rows = [row(), row(Open=0, Sales=0, Customers=4), row(Store=0, Sales=0, Customers=3), row(Store=2, DayOfWeek=4), row(Store=2, StateHoliday="x", Open=2)]
    schema = "Store int, DayOfWeek int, Date date, Sales long, Customers int, Open int, Promo int, StateHoliday string, SchoolHoliday int, StoreType string"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    stores = spark.createDataFrame([(1, "a", "a", None, None, None, 1, None, None, None)], "Store int, StoreType string, Assortment string, CompetitionDistance double, CompetitionOpenSinceMonth int, CompetitionOpenSinceYear int, Promo2 int, Promo2SinceWeek int, Promo2SinceYear int, PromoInterval string")
    got = {r.check: r.bad for r in report(df, stores).collect()}
    assert len(got) == 22 and {k: v for k, v in got.items() if v} == {
        "store below 1": 1, "weekday differs from date": 1, "unknown holiday": 1, "open not 0 or 1": 1, "closed with customers": 1, "customers without sales": 2, "open without sales": 1, "repeated key": 2,
        "no distance": 1, "no competitor date": 1, "promo2 without start": 1, "promo2 without months": 1,
    }
    assert not any(r.bad for r in report(df.limit(0), stores.limit(0)).collect())


def test_lines_that_cannot_be_read_are_set_aside(spark, tmp_path):
    (tmp_path / "d.csv").write_text(
        "Store,DayOfWeek,Date,Sales,Customers,Open,Promo,StateHoliday,SchoolHoliday\n1,3,2020-01-01,10,1,1,0,0,0\n2,3,2020-13-01,10,1,1,0,0,0\n3,x,never,10.0,1,1,0,0,0\n4,3,2020-01-01,9.0,,1,0,a,0\n5,3,2020-01-01\n6,3,2020-01-01,1,1,1,0,0,0,7\n"
    )
    good = read_setting_aside(spark, str(tmp_path / "d.csv"), DAILY, str(tmp_path / "bad"))
    assert [(r.Store, r.Sales, r.Customers) for r in good.orderBy("Store").collect()] == [(1, 10, 1), (4, 9, None)] and good.schema["Date"].dataType.typeName() == "date"
    bad = {r.record.split(",")[0]: (r.record, r.problems) for r in spark.read.parquet(str(tmp_path / "bad")).collect()}
    assert bad["2"][1] == ["Date"] and bad["3"] == ("3,x,never,10.0,1,1,0,0,0", ["DayOfWeek", "Date"]) and bad["5"][1] == bad["6"][1] == ["number of fields"]
    assert {r.problem: r.rows for r in aside_counts(spark, str(tmp_path / "bad")).collect()} == {"Date": 2, "DayOfWeek": 1, "number of fields": 2}
