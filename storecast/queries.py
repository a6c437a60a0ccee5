"""One query per kind of work on panels, over the whole stand-in panel."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates, facts
from .operators import analysis, baseline, calendar, experiment, features, monitor, profiles, quality, segments, sketches
from .operators.asof import asof
from .operators.folds import fold_statistics
from .operators.metrics import rmspe_by, rmspe_of, worst_first
from .operators.validation import RollingOrigin
from .schema import feature_names
from .sources import files
from .sources.panel import daily_rows, panel, store_facts
from .sources.tables import bucketed, settled, shared_dir, tasks, written

SPLIT = RollingOrigin()


def r6(df: DataFrame) -> DataFrame:
    """Floats at six decimals, as the SQL has them."""
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def open_panel(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d, drop_closed=True)


def stored(spark: SparkSession, d: str) -> DataFrame:
    """The panel as a table, for queries that read it more than once. None of them asks for customers, whose distinct count is most of the panel's cost."""
    return written(panel(spark, d).drop("Customers"), "panel")


def open_days(rows: DataFrame) -> DataFrame:
    return rows.filter("Open = 1")


def scored(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    """All folds with the median rule as a table, since queries read it more than once; ``rows``: the stored panel, if the query has it."""
    days = lambda: open_days(rows) if rows is not None else written(open_panel(spark, d).drop("Customers"), "open-days")
    return settled(spark, lambda: baseline.scored_folds(days(), SPLIT), "scored")


def newest(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    return scored(spark, d, rows).filter("fold = 4")


def history(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    days = open_days(rows) if rows is not None else written(open_panel(spark, d).drop("Customers"), "open-days")
    return SPLIT.assigned(days, "train").filter("fold = 4").drop("fold", "train_end", "valid_start", "valid_end", "role")


def window_start(rows: DataFrame) -> tuple:
    """(train_end, valid_start) of the newest fold of a stored panel."""
    f = SPLIT.folds(open_days(rows)).filter("fold = 4").first()
    return f.train_end, f.valid_start


def q_median_rule_by_store_type(spark, d):
    return r6(worst_first(rmspe_by(newest(spark, d), "StoreType"), "StoreType"))


def q_clean_panel(spark, d):
    return open_panel(spark, d).select("Store", "Date", "Sales", "Customers", "Promo", "StateHoliday", "SchoolHoliday", "DayOfWeek", "StoreType", "Assortment", "CompetitionDistance", "PromoInterval")


def q_rows_to_score(spark, d):
    daily = written(daily_rows(spark, d), "daily")
    _, start = window_start(daily)
    request = daily.filter(F.col("Date") >= F.lit(start)).select("Store", "Date", F.when(F.pmod(F.unix_date("Date"), F.lit(3)) != 0, F.col("Open")).alias("Open"), "Promo")
    return files.rows_to_score(request, store_facts(spark, d)).select("Store", "Date", "DayOfWeek", "Open", "Promo", "StoreType")


def q_scored_file(spark, d):
    return files.scored_columns(newest(spark, d).select("Store", "Date", "Open", "prediction"))


def q_joined_actuals(spark, d):
    rows = stored(spark, d)
    predictions = files.scored_columns(newest(spark, d, rows).filter("Sales > 0").select("Store", "Date", "prediction"))
    return files.with_predictions(open_days(rows).select("Store", "Date", "Sales"), predictions)


def q_dates(spark, d):
    days = dates.month_columns(dates.calendar_parts(panel(spark, d).select("Date").distinct())).withColumns({"days_to_easter": dates.days_to_easter(), "carnival_gap": dates.carnival_gap()})
    return days.withColumn("weeks_to_easter", dates.whole(F.date_diff(F.col("Date"), dates.easter_sunday(F.year("Date"))), 7))


def q_facts(spark, d):
    rows = stored(spark, d)
    median = open_days(rows).agg(F.median("CompetitionDistance")).first()[0]
    return facts.promo2(facts.competition(rows, median)).select("Store", "Date", "CompetitionDistance", "competition_age_months", "promo2_active", "promo2_tenure_weeks", "promo_cycle_pos")


def q_dummies(spark, d):
    out = facts.dummies(panel(spark, d))
    return out.select("Store", "Date", *(c for c in out.columns if "_" in c))


def q_features(spark, d):
    """Days in buckets by store: windows and statistics need no exchange, and dates are asked for once. Facts of stores join open days after the windows; numbers of a store are rounded before they join."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").count()
    days = bucketed(daily_rows(spark, d).drop("Customers"), "days", buckets=tasks(spark, lines))
    facts = r6(store_facts(spark, d))
    ends = days.agg(*(f(c).alias(f"{n}_{k}") for k, c in (("day", F.col("Date")), ("open", F.when(F.col("Open") == 1, F.col("Date")))) for n, f in (("first", F.min), ("last", F.max)))).first()
    train_end = SPLIT.dates(ends.first_open, ends.last_open)[-1][1]
    learned = features.statistics(open_days(days).filter(F.col("Date") <= F.lit(train_end)), facts=facts).rounded(6)
    built = features.Features(learned, days, with_reopening=True, month=True)
    out = built.of_panel(days, *((x - datetime.date(1970, 1, 1)).days for x in (ends.first_day, ends.last_day)), facts)
    built.check(out)
    return out.select("Store", "Date", *feature_names(reopening=True, month=True))


def q_error_columns(spark, d):
    away = F.date_diff(F.col("Date"), F.col("valid_start"))
    out = scored(spark, d).filter("Sales <> 0").select("Store", "Date", "fold", facts.squared_error().alias("sq"), facts.relative_error().alias("rel"), facts.log_target().alias("log_sales"), dates.whole(away, 7).alias("week_in_window"), dates.bucket(away, 5).alias("day_block"))
    return r6(out)


def q_size_quartiles(spark, d):
    return analysis.size_quartiles(history(spark, d))


def store_profiles(spark, d) -> DataFrame:
    """One row per store."""
    return written(profiles.profiles(written(open_panel(spark, d), "open-days")), "profiles")


def cell_table(spark, d) -> DataFrame:
    return profiles.cells(profiles.long_history(store_profiles(spark, d), 300))


def cell_segments(spark, d) -> DataFrame:
    return cell_table(spark, d).select("Store", (1 + F.col("cell") % 4).alias("segment"))


def q_weights(spark, d):
    from .jobs.model import exact_metric_weight

    return r6(exact_metric_weight(open_panel(spark, d).join(cell_segments(spark, d), "Store"), "segment").select("Store", "Date", "segment", "weight"))


def q_closure(spark, d):
    return calendar.closure(daily_rows(spark, d))


def q_closure_labels(spark, d):
    days = stored(spark, d)
    rows = scored(spark, d, days).join(calendar.closure(days), ["Store", "Date"]).withColumn("label", facts.closure_label())
    return r6(analysis.shares(rows, "label"))


def q_closure_flags(spark, d):
    """Rows and shares of flags that overlap, with how many of the flagged are Mondays and first days of a promotion."""
    days = stored(spark, d)
    rows = scored(spark, d, days).join(calendar.closure(days), ["Store", "Date"]).withColumns(facts.closure_flags())
    first = calendar.promo_block(open_days(days)).filter("Promo = 1 and place = 1").select("Store", "Date", F.lit(True).alias("first_promo"))
    rows = rows.join(first, ["Store", "Date"], "left").withColumn("flag", F.explode(F.array(*(F.when(F.col(n), F.lit(n)) for n in ("after_closed", "before_closed", "near_holiday", "any_flag")))))
    out = rows.filter("flag is not null").groupBy("flag").agg(F.count("*").alias("rows"), F.count_if(F.col("DayOfWeek") == 1).alias("mondays"), F.count_if("first_promo").alias("first_promo_days"), rmspe_of().alias("rmspe"))
    return r6(out)


def q_reopening(spark, d):
    return calendar.reopening(daily_rows(spark, d))


def q_first_back(spark, d):
    rows = stored(spark, d)
    back = calendar.reopening(rows).filter("days_since_reopening = 0").groupBy("Store").agg(F.min("Date").alias("back"))
    return open_days(rows).join(back, "Store").select("Store", "Date", dates.bucket(F.date_diff("Date", "back"), 30).alias("bucket"))


def q_neighbouring_rows(spark, d):
    return calendar.neighbouring_rows(panel(spark, d))


def q_promo_block(spark, d):
    return calendar.promo_block(open_panel(spark, d))


def q_nearest_holiday(spark, d):
    return calendar.nearest_holiday(panel(spark, d))


def q_calendar_extension(spark, d):
    known = stored(spark, d)
    _, start = window_start(known)
    plan = known.filter(F.col("Date") >= F.lit(start)).select("Store", "Date", F.lit(1).alias("Open"), "StateHoliday")
    return calendar.extended(known, plan)


def q_missing_day_before(spark, d):
    rows = stored(spark, d)
    return calendar.without_day_before(open_days(rows), rows, window_start(rows)[0])


def q_folds(spark, d):
    return SPLIT.describe(written(open_panel(spark, d).select("Date"), "open-dates"))


def q_learned(spark, d):
    s = features.statistics(history(spark, d))
    rows = s.by_weekday.join(s.by_store, "Store").join(s.uplift, "Store")
    return r6(rows.withColumns({n: F.lit(getattr(s, n)).cast("double") for n in ("global_mean", "global_uplift", "comp_dist_median")}))


def q_mean_shift(spark, d):
    days = stored(spark, d)
    rows = history(spark, d, days)
    return r6(features.mean_shift(features.store_means(rows), features.store_means(features.since_reopening(rows, days))))


def q_fixed_train(spark, d):
    return r6(baseline.scored_folds(written(open_panel(spark, d).drop("Customers"), "open-days"), SPLIT, fixed_train=True).groupBy("fold").agg(rmspe_of().alias("rmspe")))


def fold_numbers(spark, d):
    rows = written(open_panel(spark, d).drop("Customers"), "open-days")
    return fold_statistics(rows, SPLIT)


def q_fold_means(spark, d):
    """What the features of every fold stand on, all folds from one pass."""
    own = fold_numbers(spark, d)
    one = own.overall.crossJoin(own.distance.select(F.col("medians").alias("distances")))
    days = own.by_store.select("Store", "means", "uplifts", F.explode("weekday_means").alias("DayOfWeek", "x")).crossJoin(F.broadcast(one.select(F.col("means").alias("every"), F.col("uplifts").alias("every_uplift"), "distances")))
    each = days.select("Store", "DayOfWeek", F.inline(F.arrays_zip(F.sequence(F.lit(1), F.lit(len(own.folds))).alias("fold"), "means", "uplifts", "x", "every", "every_uplift", "distances")))
    names = {"means": "store_mean_sales", "uplifts": "store_promo_uplift", "x": "store_dow_mean_sales", "every": "global_mean", "every_uplift": "global_uplift", "distances": "comp_dist_median"}
    return r6(each.withColumnsRenamed(names).filter("store_dow_mean_sales is not null"))


def q_fold_medians(spark, d):
    own = fold_numbers(spark, d)
    keys = own.by_store.select("Store", "medians", F.explode("key_medians").alias("key", "x")).crossJoin(F.broadcast(own.overall.select(F.col("medians").alias("every"))))
    each = keys.select("Store", "key.DayOfWeek", "key.Promo", F.inline(F.arrays_zip(F.sequence(F.lit(1), F.lit(len(own.folds))).alias("fold"), "medians", "x", "every")))
    return r6(each.withColumnsRenamed({"medians": "store_median", "x": "median", "every": "all_median"}).filter("median is not null"))


def q_fold_summary(spark, d):
    return r6(analysis.fold_summary(scored(spark, d).groupBy("fold").agg(rmspe_of().alias("rmspe"))))


def q_year_ago(spark, d):
    days = stored(spark, d)
    rows = SPLIT.assigned(open_days(days), "valid").filter("fold = 4").drop("fold", "train_end", "valid_start", "valid_end", "role")
    return r6(baseline.year_ago(history(spark, d, days), rows).select("Store", "Date", "filled", "prediction"))


def q_cv_results(spark, d):
    rows = stored(spark, d)
    return r6(experiment.cv_results(scored(spark, d, rows).filter("Sales <> 0"), SPLIT, open_days(rows)))


def q_compare(spark, d):
    rows = scored(spark, d)
    score = lambda p: rows.withColumn("prediction", p).groupBy("fold").agg(rmspe_of().alias("rmspe"))
    return r6(experiment.compare({"median_rule": score(F.col("prediction")), "lower": score(0.9 * F.col("prediction"))}))


def q_evaluate(spark, d):
    return monitor.evaluate(scored(spark, d), 0.9)


def q_alarms(spark, d):
    return monitor.alarms(monitor.evaluate(scored(spark, d), 0.9)).select("week", "state")


def q_error_shares(spark, d):
    return r6(analysis.shares(scored(spark, d), "StoreType", "Assortment", "Promo"))


def q_concentration(spark, d):
    return r6(analysis.concentration(scored(spark, d), "Store"))


def q_worst_days(spark, d):
    return r6(analysis.worst_days(scored(spark, d)))


def q_without_worst_days(spark, d):
    return r6(analysis.without_worst_days(scored(spark, d)))


def q_pivot(spark, d):
    return r6(analysis.pivoted(scored(spark, d), "StoreType", "fold", [1, 2, 3, 4]).toDF("StoreType", *(f"fold_{k}" for k in range(1, 5))))


def q_correlations(spark, d):
    rows = open_panel(spark, d)
    one = rows.agg(F.corr("Customers", "Sales").alias("customers_sales"))
    two = quality.store_means_with_facts(rows).agg(F.corr("distance", "mean_sales").alias("distance_sales"))
    return r6(one.join(F.broadcast(two)))


def q_ratio_size(spark, d):
    """How a store's ratios go with its size."""
    rows = store_profiles(spark, d)
    return r6(rows.agg(*(F.corr(c, "mean_sales").alias(c) for c in ("promo_uplift", "school_uplift", "weekend_ratio", "season_amp", "dec_lift", "basket", "momentum"))))


def q_last_rows(spark, d):
    return analysis.last_rows(open_panel(spark, d).select("Store", "Date", "Sales"), 5, "Store")


def q_means_by(spark, d):
    c = F.col
    dims = {"weekday": c("DayOfWeek"), "month": F.month("Date"), "promo": c("Promo"), "holiday": c("StateHoliday"), "school": c("SchoolHoliday"), "type": c("StoreType"), "assortment": c("Assortment")}
    return r6(quality.means_by(open_panel(spark, d), dims))


def q_weekly(spark, d):
    return r6(quality.weekly(open_panel(spark, d)))


def q_store_means(spark, d):
    return r6(quality.store_means_with_facts(open_panel(spark, d)))


def q_quality(spark, d):
    return quality.report(panel(spark, d), store_facts(spark, d))


def q_silent_stores(spark, d):
    return quality.silent_stores(panel(spark, d), datetime.date(1998, 1, 1), datetime.date(1998, 1, 10))


def q_calibration(spark, d):
    rows = scored(spark, d).filter("Sales > 0")
    after = monitor.recalibrated(rows, monitor.best_factor(rows, "fold", "StoreType"), "fold", "StoreType").groupBy("fold").agg(rmspe_of().alias("after"))
    return r6(rows.groupBy("fold").agg(rmspe_of().alias("before")).join(after, "fold"))


def q_inner_calibration(spark, d):
    """Factors by store type learnt on the window before, applied to the newest: what could have been known."""
    rows = scored(spark, d).filter("Sales > 0")
    last, new = rows.filter("fold = 3"), rows.filter("fold = 4")
    one = monitor.recalibrated(new.withColumn("all", F.lit(1)), monitor.best_factor(last.withColumn("all", F.lit(1)), "all"), "all")
    own = monitor.recalibrated(new, monitor.best_factor(last, "StoreType"), "StoreType")
    score = lambda df, n: df.agg(rmspe_of().alias(n))
    return r6(score(new, "before").join(F.broadcast(score(one, "one_factor"))).join(F.broadcast(score(own, "by_type"))))


def q_corrections(spark, d):
    """Factors learnt on each window's inner cut, the six weeks before it, by the median rule learnt before these."""
    rows = settled(spark, lambda: baseline.scored_folds(written(open_panel(spark, d).drop("Customers"), "open-days"), RollingOrigin(SPLIT.n_splits + 1)), "scored").withColumn("seed", F.lit(0))
    return r6(monitor.corrections(rows.withColumn("fold", F.col("fold") - 1).filter("fold > 0"), rows.filter(F.col("fold") <= SPLIT.n_splits), "StoreType"))


def q_profiles(spark, d):
    return r6(store_profiles(spark, d))


def q_standardised(spark, d):
    return r6(profiles.standardised(profiles.long_history(store_profiles(spark, d), 300)).drop("mean_sales", "days", "raw_uplift"))


def q_cells(spark, d):
    return cell_table(spark, d)


def q_segment_summary(spark, d):
    return r6(segments.summary(open_panel(spark, d), cell_segments(spark, d)))


def q_segment_sizes(spark, d):
    return segments.sizes(cell_segments(spark, d))


def q_segment_types(spark, d):
    return segments.type_counts(store_facts(spark, d), cell_segments(spark, d), ["a", "b", "c", "d"])


def q_segment_lookup(spark, d):
    own = cell_segments(spark, d)
    return segments.Segmenter(own, segments.largest(own)).transform(open_panel(spark, d)).select("Store", "Date", "segment")


def q_adjusted_rand(spark, d):
    labels = cell_table(spark, d).select("Store", (1 + F.col("cell") % 4).alias("a"), (F.col("cell") % 3).alias("b"))
    return r6(segments.adjusted_rand(labels, "a", "b"))


def q_business(spark, d):
    return r6(analysis.business(written(newest(spark, d).select("Sales", "prediction"), "newest")))


def q_week_ahead(spark, d):
    rows = scored(spark, d).withColumn("week_ahead", dates.whole(F.date_diff("Date", "valid_start"), 7))
    return r6(rmspe_by(rows, "week_ahead"))


def q_bias(spark, d):
    return r6(analysis.bias(written(scored(spark, d).select("StoreType", "Sales", "prediction"), "scored"), "StoreType"))


def q_shape(spark, d):
    days = stored(spark, d)
    rows = newest(spark, d, days)
    return r6(monitor.shape(rows).join(F.broadcast(monitor.level_ratios(rows, history(spark, d, days)))))


def q_intervals(spark, d):
    rows = written(scored(spark, d).select("fold", "Sales", "Open", "prediction", (F.ascii("StoreType") - 96).cast("int").alias("segment")), "scored")
    ratios = monitor.interval_ratios(rows.filter("fold = 3"))
    return r6(monitor.interval_quality(monitor.with_interval(rows.filter("fold = 4"), ratios), "segment"))


def arms(spark, d) -> DataFrame:
    """Two arms of three seeds from the median rule, scaled."""
    rows = scored(spark, d).withColumn("seed", F.explode(F.array(*map(F.lit, range(3)))))
    both = rows.withColumn("x", F.explode(F.array(F.struct(F.lit("median").alias("arm"), F.lit(1.0).alias("by")), F.struct(F.lit("low").alias("arm"), F.lit(0.8).alias("by")))))
    return both.withColumns({"arm": F.col("x.arm"), "prediction": F.col("prediction") * (F.col("x.by") + 0.01 * F.col("seed"))}).drop("x")


def q_arms(spark, d):
    return r6(experiment.arm_summary(experiment.grid(arms(spark, d))))


def q_accepted(spark, d):
    return experiment.accepted(written(experiment.grid(arms(spark, d)), "grid"), "median")


def q_seed_scores(spark, d):
    return r6(analysis.seed_scores(arms(spark, d).filter("arm = 'median'"), "fold"))


def q_seed_mean(spark, d):
    return r6(analysis.mean_of_seeds(arms(spark, d).filter("arm = 'median' and fold = 4")))


def q_two_models(spark, d):
    rows = scored(spark, d).filter("Sales <> 0").withColumn("pred_b", 0.8 * F.col("prediction"))
    return r6(analysis.side_by_side(rows, "fold", "Promo", a="prediction", b="pred_b"))


def q_worst_days_by_arm(spark, d):
    return r6(analysis.on_worst_days(arms(spark, d).filter("fold = 4 and seed = 0"), ["median", "low"], "median"))


def q_promote(spark, d):
    rows = newest(spark, d)
    return r6(monitor.promote(rows, rows.withColumn("prediction", 0.8 * F.col("prediction")), 0.01))


def q_weekly_events(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.to_date("ts").alias("Date"), (F.col("user_id") % 50).cast("int").alias("Store"), "value")
    return r6(rows.groupBy(dates.week().alias("week")).agg(F.count("*").alias("rows"), F.avg("value").alias("mean_value"), F.count_distinct("Store").alias("stores")))


def q_compared_sets(spark, d):
    rows = panel(spark, d)
    by_gap = calendar.reopening(rows).filter("days_since_reopening < 365").select("Store")
    by_period = quality.silent_stores(rows, datetime.date(1998, 1, 1), datetime.date(1998, 1, 10))
    return quality.compared_sets(by_gap, by_period)


def q_stable_labels(spark, d):
    rows = SPLIT.assigned(open_panel(spark, d), "train")
    means = rows.groupBy("fold", "Store").agg(F.avg("Sales").alias("m"))
    labels = means.select("fold", "Store", dates.whole(F.col("m"), 4000).alias("segment"))
    return r6(segments.stable_share(labels))


def q_daily_totals(spark, d):
    return r6(monitor.daily_totals(newest(spark, d)))


def q_weekday_levels(spark, d):
    rows = stored(spark, d)
    return r6(monitor.weekday_levels(newest(spark, d, rows), history(spark, d, rows)))


def q_segment_described(spark, d):
    return r6(segments.described(store_profiles(spark, d), cell_segments(spark, d)))


def q_fold_correlation(spark, d):
    return r6(analysis.fold_correlation(scored(spark, d), 3, 4))


def q_segment_one_hot(spark, d):
    own = cell_segments(spark, d)
    return segments.one_hot(segments.Segmenter(own, segments.largest(own)).transform(open_panel(spark, d)).select("Store", "Date", "segment"), 4)


def q_fold_correlations(spark, d):
    return r6(analysis.fold_correlations(scored(spark, d)))


def q_asof_holiday(spark, d):
    """Every open day with its store's last holiday and the next, 200 days away at most."""
    days = stored(spark, d)
    holidays = days.filter("StateHoliday <> '0'").select("Store", "Date", F.col("StateHoliday").alias("kind"))
    rows = open_days(days).select("Store", "Date")
    last = asof(rows, holidays, ["Store"], "Date", ["kind"], tolerance=200, prefix="last_")
    both = asof(last, holidays, ["Store"], "Date", ["kind"], direction="forward", tolerance=200, prefix="next_")
    return both.select("Store", "Date", "last_kind", F.date_diff("Date", "last_Date").alias("days_since"), "next_kind", F.date_diff("next_Date", "Date").alias("days_until"))


def q_asof_shipment(spark, d):
    """Every order with the newest shipment before it among lines of its priority: few keys with very many rows."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").cast("date").alias("day"))
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").cast("date").alias("day"), "l_linenumber")
    shipped = lines.join(orders.select("o_orderkey", "priority"), "o_orderkey").groupBy("priority", "day").agg(F.max(F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("line"))
    return asof(orders, shipped, ["priority"], "day", ["line"], tolerance=30, strict=True, prefix="shipped_")


def q_calendar_upkeep(spark, d):
    """The calendar with all its columns, as it stands after its last weeks were added one by one."""
    from .jobs.calendar_store import CalendarStore

    days, store = stored(spark, d), CalendarStore(spark, f"{shared_dir(spark)}/calendar-{uuid.uuid4().hex}")
    last = days.agg(F.max("Date")).first()[0]
    cuts = [last - datetime.timedelta(days=k) for k in (14, 7, 0)]
    for low, high in zip([datetime.date(1900, 1, 1), *cuts], cuts):
        store.add(days.filter((F.col("Date") > F.lit(low)) & (F.col("Date") <= F.lit(high))))
    return store.days()


def q_distinct_sketches(spark, d):
    """Distinct orders and suppliers of every quarter from weekly sketches: whether they are within the stated error, next to the exact counts."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_shipdate").cast("date").alias("Date"), F.col("l_orderkey").alias("orders"), F.col("l_suppkey").alias("suppliers"))
    names, quarter = ["orders", "suppliers"], F.date_trunc("quarter", "week").cast("date").alias("quarter")
    kept = written(sketches.weekly_sketches(rows, names), "sketches")
    near = sketches.united(kept, names, quarter)
    exact = rows.withColumn("week", dates.week()).groupBy(quarter).agg(*(F.count_distinct(n).alias(f"exact_{n}") for n in names))
    within = lambda n: F.abs(F.col(n) - F.col(f"exact_{n}")) <= F.greatest(F.lit(1.0), sketches.error() * F.col(f"exact_{n}"))
    return near.join(exact, "quarter").select("quarter", "first_week", "last_week", "weeks", *(F.col(f"exact_{n}") for n in names), *(within(n).alias(f"{n}_within") for n in names))


def q_sample(spark, d):
    return quality.sample(open_panel(spark, d).select("Store", "Date", "Sales"), 5000)


def least_cell(rows: DataFrame, n_segments: int, min_days: int, most: int) -> int:
    """Stores a cell must have, by one rule for tables of any size: the operator's own number, or an even share of the stores with a long history where that is smaller."""
    long = profiles.long_history(profiles.profiles(rows), min_days).count()
    return max(1, min(most, long // n_segments))


def q_store_segments(spark, d):
    """Cells merged and clustered: no SQL."""
    from .jobs.forecaster import Forecaster

    own, rows = Forecaster(), written(open_panel(spark, d), "open-days")
    return segments.segmenter(rows, own.n_segments, own.min_days, least_cell(rows, own.n_segments, own.min_days, own.min_cell_stores)).assignment


def q_forecast(spark, d):
    """The newest window forecast by the forecaster's own models, trees counted on the inner window, with intervals."""
    from .jobs.forecaster import Forecaster

    rows = written(panel(spark, d), "panel")  # the segments' profiles need customers
    train_end, start = window_start(rows)
    past, future = rows.filter(F.col("Date") <= F.lit(train_end)), rows.filter(F.col("Date") >= F.lit(start))
    train = past.filter("Open = 1 and Sales > 0")
    model = Forecaster()
    model.min_cell_stores = least_cell(train, model.n_segments, model.min_days, model.min_cell_stores)
    model.fit(train, past)
    return model.predict(future.drop("Sales", "Customers"), interval=0.8, strict=False).select("Store", "Date", "Open", "prediction", "low", "high")


def q_backtest(spark, d):
    """Two arms of one small model over all folds: with and without the closed-day family. No SQL."""
    from .jobs.backtest import Arm, Backtest, results

    arms = [Arm("closed days", segmented=False), Arm("without", {"closure": False}, segmented=False)]
    params = {"maxDepth": 4, "stepSize": 0.3, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}
    return r6(results(Backtest(f"{shared_dir(spark)}/backtest-{uuid.uuid4().hex}", arms, params=params, options={"fixed_rounds": 10}).run(panel(spark, d).drop("Customers"))))


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_")}
