"""The same results in SQL, from the same tables: what the queries are held against."""

from __future__ import annotations

PANEL = """WITH lines AS (
  SELECT CAST(l_suppkey AS INT) AS Store, CAST(l_shipdate AS DATE) AS Date, l_orderkey,
         CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS ok,
         CAST(floor(l_extendedprice * (1 - l_discount)) AS BIGINT) AS amount,
         CASE WHEN l_discount > 0.045 THEN 1 ELSE 0 END AS promo
  FROM lineitem
), daily AS (
  SELECT Store, Date, CAST(sum(ok * amount) AS BIGINT) AS Sales,
         CAST(count(DISTINCT CASE WHEN ok = 1 THEN l_orderkey END) AS INT) AS Customers,
         CAST(max(ok) AS INT) AS Open, CAST(max(promo) AS INT) AS Promo,
         CASE WHEN month(Date) = 12 AND day(Date) IN (25, 26) THEN 'c'
              WHEN month(Date) = 4 AND day(Date) = 15 THEN 'b'
              WHEN (month(Date) = 1 AND day(Date) = 1) OR (month(Date) = 5 AND day(Date) = 1)
                OR (month(Date) = 10 AND day(Date) = 3) THEN 'a' ELSE '0' END AS StateHoliday,
         CASE WHEN month(Date) IN (7, 8) THEN 1 ELSE 0 END AS SchoolHoliday, CAST(isodow(Date) AS INT) AS DayOfWeek
  FROM lines GROUP BY Store, Date
), store AS (
  SELECT CAST(s_suppkey AS INT) AS Store, substr('abcd', CAST(s_suppkey % 4 AS INT) + 1, 1) AS StoreType,
         substr('abc', CAST(s_nationkey % 3 AS INT) + 1, 1) AS Assortment,
         CASE WHEN s_suppkey % 17 = 3 THEN NULL ELSE CAST(100 + (s_suppkey * 37) % 20000 AS DOUBLE) END AS CompetitionDistance,
         CAST(CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey % 12 + 1 END AS INT) AS CompetitionOpenSinceMonth,
         CAST(CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 23 = 1 THEN 1900 ELSE 1985 + s_suppkey % 14 END AS INT) AS CompetitionOpenSinceYear,
         CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS Promo2,
         CAST(CASE WHEN s_suppkey % 2 = 0 THEN 1 + (s_suppkey * 7) % 50 END AS INT) AS Promo2SinceWeek,
         CAST(CASE WHEN s_suppkey % 2 = 0 THEN 1994 + s_suppkey % 6 END AS INT) AS Promo2SinceYear,
         CASE WHEN s_suppkey % 2 = 0 THEN CASE s_suppkey % 3 WHEN 0 THEN 'Jan,Apr,Jul,Oct' WHEN 1 THEN 'Feb,May,Aug,Nov' ELSE 'Mar,Jun,Sept,Dec' END END AS PromoInterval
  FROM supplier
), panel AS (SELECT daily.*, store.* EXCLUDE (Store), date_diff('day', DATE '1970-01-01', Date) AS d FROM daily LEFT JOIN store USING (Store)),
open_days AS (SELECT * FROM panel WHERE Open = 1),
edge AS (SELECT min(d) AS first_d, max(d) AS last_d FROM panel)"""

FOLDS = """, ends AS (SELECT max(Date) AS last_day FROM open_days),
folds AS (SELECT CAST(4 - i AS INT) AS fold, CAST(last_day - CAST(42 * i + 42 AS INT) AS DATE) AS train_end,
          CAST(last_day - CAST(42 * i + 41 AS INT) AS DATE) AS valid_start, CAST(last_day - CAST(42 * i AS INT) AS DATE) AS valid_end FROM ends, range(0, 4) r(i))"""

SCORED = (
    FOLDS
    + """, train AS (SELECT fold, o.* FROM open_days o JOIN folds ON Date <= train_end),
m3 AS (SELECT fold, Store, DayOfWeek, Promo, median(Sales) AS m3 FROM train GROUP BY ALL),
m2 AS (SELECT fold, Store, median(Sales) AS m2 FROM train GROUP BY ALL),
m0 AS (SELECT fold, median(Sales) AS m0 FROM train GROUP BY ALL),
scored AS (SELECT o.*, fold, valid_start, coalesce(m3, m2, m0) AS prediction
  FROM open_days o JOIN folds ON Date BETWEEN valid_start AND valid_end
  LEFT JOIN m3 USING (fold, Store, DayOfWeek, Promo) LEFT JOIN m2 USING (fold, Store) LEFT JOIN m0 USING (fold)),
sold AS (SELECT *, pow((Sales - prediction) / Sales, 2) AS sq, (prediction - Sales) / Sales AS rel FROM scored WHERE Sales <> 0),
newest AS (SELECT * FROM scored WHERE fold = 4), history AS (SELECT o.* FROM open_days o JOIN folds ON fold = 4 AND Date <= train_end)"""
)

LEARNED = """, by_store AS (SELECT Store, avg(Sales) AS store_mean_sales FROM history GROUP BY 1),
by_day AS (SELECT Store, DayOfWeek, avg(Sales) AS store_dow_mean_sales FROM history GROUP BY 1, 2),
uplift AS (SELECT Store, avg(Sales) FILTER (WHERE Promo = 1) / nullif(avg(Sales) FILTER (WHERE Promo = 0), 0) AS store_promo_uplift FROM history GROUP BY 1),
every AS (SELECT avg(Sales) AS global_mean, avg(Sales) FILTER (WHERE Promo = 1) / avg(Sales) FILTER (WHERE Promo = 0) AS global_uplift, median(CompetitionDistance) AS comp_dist_median FROM history)"""

EASTER = """, years AS (SELECT DISTINCT CAST(year(Date) AS INT) AS y FROM panel),
e1 AS (SELECT y, y % 19 AS g, y // 100 AS c FROM years),
e2 AS (SELECT *, (c - c // 4 - (8 * c + 13) // 25 + 19 * g + 15) % 30 AS h FROM e1),
e3 AS (SELECT *, h - CASE WHEN h = 29 OR (h = 28 AND g > 10) THEN 1 ELSE 0 END AS i FROM e2),
easter AS (SELECT y, CAST(make_date(y, 3, 28) + CAST(i - (y + y // 4 + i + 2 - c + c // 4) % 7 AS INT) AS DATE) AS sunday FROM e3)"""

W = "PARTITION BY Store ORDER BY d"
CLOSURE = f""", closure AS (SELECT Store, Date,
  CAST(CASE WHEN d = first_d THEN -1 ELSE coalesce(sum(Open) OVER ({W} RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), 0) END AS INT) AS open_yesterday,
  CAST(CASE WHEN d = last_d THEN -1 ELSE coalesce(sum(Open) OVER ({W} RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING), 0) END AS INT) AS open_tomorrow,
  CAST(CASE WHEN d + 7 > last_d THEN -1 ELSE 7 - coalesce(sum(Open) OVER ({W} RANGE BETWEEN 1 FOLLOWING AND 7 FOLLOWING), 0) END AS INT) AS closed_days_next_7,
  CAST(CASE WHEN d - 7 < first_d THEN -1 ELSE 7 - coalesce(sum(Open) OVER ({W} RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING), 0) END AS INT) AS closed_days_last_7,
  CAST(coalesce(min(CASE WHEN StateHoliday <> '0' THEN d END) OVER ({W} RANGE BETWEEN 0 PRECEDING AND 10 FOLLOWING) - d, 10) AS INT) AS days_to_next_holiday,
  CAST(coalesce(d - max(CASE WHEN StateHoliday <> '0' THEN d END) OVER ({W} RANGE BETWEEN 10 PRECEDING AND 0 FOLLOWING), 10) AS INT) AS days_since_last_holiday
  FROM panel, edge)"""
REOPENING = f""", gaps AS (SELECT *, d - coalesce(max(CASE WHEN Open = 1 THEN d END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first_d - 1) - 1 AS gap FROM panel, edge),
reopening AS (SELECT Store, Date, CAST(coalesce(least(d - max(CASE WHEN Open = 1 AND gap >= 21 THEN d END) OVER ({W} ROWS UNBOUNDED PRECEDING), 365), 365) AS INT) AS days_since_reopening FROM gaps)"""

MONTH_NAMES = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sept','Oct','Nov','Dec']"
PROMO2 = f""", promo_base AS (SELECT *, string_split(coalesce(PromoInterval, ''), ',') AS months, year(Date) AS y, week(Date) AS wk,
  coalesce(Promo2 = 1 AND (year(Date) > Promo2SinceYear OR (year(Date) = Promo2SinceYear AND week(Date) >= Promo2SinceWeek)), false) AS running FROM panel),
promo2 AS (SELECT Store, Date, CAST(running AND list_contains(months, {MONTH_NAMES}[month(Date)]) AS INT) AS promo2_active,
  CAST(CASE WHEN running AND Promo2SinceWeek IS NOT NULL THEN greatest((y - Promo2SinceYear) * 52 + wk - Promo2SinceWeek, 0) ELSE 0 END AS INT) AS promo2_tenure_weeks,
  CAST(CASE WHEN running AND list_position({MONTH_NAMES}, months[1]) > 0 THEN (month(Date) - list_position({MONTH_NAMES}, months[1]) + 12) % 3 ELSE -1 END AS INT) AS promo_cycle_pos FROM promo_base)"""
AGE = """CAST(CASE WHEN CompetitionOpenSinceYear IS NOT NULL AND CompetitionOpenSinceMonth IS NOT NULL AND CompetitionOpenSinceYear >= 1950
  THEN greatest((year(Date) - CompetitionOpenSinceYear) * 12 + month(Date) - CompetitionOpenSinceMonth, 0) ELSE 0 END AS INT)"""

RATIO = "CASE WHEN {b} = 0 THEN NULL ELSE {a} / {b} END"


def _mean(where: str) -> str:
    return f"avg(Sales) FILTER (WHERE {where})"


def _ratio(a: str, b: str) -> str:
    return f"({_mean(a)} / nullif({_mean(b)}, 0))"


PROFILES = f""", span AS (SELECT max(Date) AS last_day FROM open_days),
plain AS (SELECT Store, avg(Sales) AS mean_sales, count(*) AS days, {_ratio('Promo = 1', 'Promo = 0')} AS promo_uplift, {_ratio('SchoolHoliday = 1', 'SchoolHoliday = 0')} AS school_uplift,
  {_ratio('DayOfWeek >= 5', 'DayOfWeek < 5')} AS weekend_ratio, sum(Sales) / nullif(sum(Customers), 0) AS basket,
  {_ratio("Date > last_day - 90", "Date > last_day - 455 AND Date <= last_day - 365")} AS momentum FROM open_days, span GROUP BY Store),
months AS (SELECT Store, month(Date) AS mo, avg(Sales) AS m FROM open_days GROUP BY 1, 2),
season AS (SELECT Store, max(m) / nullif(min(m), 0) AS season_amp, max(m) FILTER (WHERE mo = 12) / nullif(avg(m), 0) AS dec_lift FROM months GROUP BY 1),
raw_profiles AS (SELECT * FROM plain JOIN season USING (Store)),
profiles AS (SELECT Store, mean_sales, days, {', '.join(f'coalesce({c}, (SELECT median({c}) FROM raw_profiles)) AS {c}' for c in ('promo_uplift', 'school_uplift', 'weekend_ratio', 'season_amp', 'dec_lift', 'basket', 'momentum'))} FROM raw_profiles)"""
CELLS = """, cuts AS (SELECT quantile_cont(mean_sales, [0.25, 0.5, 0.75]) AS a, quantile_cont(promo_uplift, [1 / 3.0, 2 / 3.0]) AS b, quantile_cont(season_amp, [1 / 3.0, 2 / 3.0]) AS c FROM profiles WHERE days >= 300),
cells AS (SELECT Store, CAST(((CAST(mean_sales >= a[1] AS INT) + CAST(mean_sales >= a[2] AS INT) + CAST(mean_sales >= a[3] AS INT)) * 3
  + CAST(promo_uplift >= b[1] AS INT) + CAST(promo_uplift >= b[2] AS INT)) * 3 + CAST(season_amp >= c[1] AS INT) + CAST(season_amp >= c[2] AS INT) AS INT) AS cell FROM profiles, cuts WHERE days >= 300),
assignment AS (SELECT Store, CAST(1 + cell % 4 AS INT) AS segment FROM cells)"""

RMSPE = "sqrt(avg(sq))"
R6 = lambda x, n: f"round({x}, 6) AS {n}"
ARMS = """, arms AS (SELECT *, 'median' AS arm, CAST(s AS INT) AS seed, prediction * (1 + 0.01 * s) AS p FROM scored, range(0, 3) t(s)
  UNION ALL SELECT *, 'low' AS arm, CAST(s AS INT) AS seed, prediction * (0.8 + 0.01 * s) AS p FROM scored, range(0, 3) t(s)),
arm_grid AS (SELECT arm, seed, fold, sqrt(avg(pow((Sales - p) / Sales, 2)) FILTER (WHERE Sales <> 0)) AS rmspe FROM arms GROUP BY ALL),
arm_folds AS (SELECT arm, fold, avg(rmspe) AS rmspe FROM arm_grid GROUP BY ALL),
arm_means AS (SELECT arm, avg(m) AS rmspe, stddev_pop(m) AS noise FROM (SELECT arm, seed, avg(rmspe) AS m FROM arm_grid GROUP BY ALL) GROUP BY ALL)"""

FOLD_LEARNED = """, f_store AS (SELECT fold, Store, avg(Sales) AS store_mean_sales, avg(Sales) FILTER (WHERE Promo = 1) / nullif(avg(Sales) FILTER (WHERE Promo = 0), 0) AS store_promo_uplift FROM train GROUP BY ALL),
f_day AS (SELECT fold, Store, DayOfWeek, avg(Sales) AS store_dow_mean_sales FROM train GROUP BY ALL),
f_all AS (SELECT fold, avg(Sales) AS global_mean, avg(Sales) FILTER (WHERE Promo = 1) / avg(Sales) FILTER (WHERE Promo = 0) AS global_uplift, median(CompetitionDistance) AS comp_dist_median FROM train GROUP BY ALL)"""
SQL = {
    "q_fold_correlations": PANEL + SCORED + ", s AS (SELECT Store, fold, sqrt(avg(sq)) AS x FROM sold GROUP BY 1, 2) SELECT a.fold AS fold_a, b.fold AS fold_b, count(*) AS stores, round(corr(a.x, b.x), 6) AS correlation FROM s a JOIN s b ON a.Store = b.Store AND a.fold < b.fold GROUP BY 1, 2",
    "q_asof_holiday": PANEL + """, h AS (SELECT DISTINCT Store, Date, StateHoliday AS kind FROM panel WHERE StateHoliday <> '0'),
last AS (SELECT o.Store, o.Date, h.Date AS at, h.kind FROM open_days o ASOF LEFT JOIN h ON o.Store = h.Store AND o.Date >= h.Date),
next AS (SELECT o.Store, o.Date, h.Date AS at, h.kind FROM open_days o ASOF LEFT JOIN h ON o.Store = h.Store AND o.Date <= h.Date)
SELECT Store, Date, CASE WHEN Date - last.at <= 200 THEN last.kind END AS last_kind, CAST(CASE WHEN Date - last.at <= 200 THEN Date - last.at END AS INT) AS days_since,
  CASE WHEN next.at - Date <= 200 THEN next.kind END AS next_kind, CAST(CASE WHEN next.at - Date <= 200 THEN next.at - Date END AS INT) AS days_until FROM last JOIN next USING (Store, Date)""",
    "q_asof_shipment": """WITH o AS (SELECT o_orderkey, o_orderpriority AS priority, CAST(o_orderdate AS DATE) AS day FROM orders),
s AS (SELECT priority, CAST(l_shipdate AS DATE) AS day, max(o_orderkey * 10 + l_linenumber) AS line FROM lineitem JOIN o ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT o.*, CASE WHEN o.day - s.day <= 30 THEN s.day END AS shipped_day, CASE WHEN o.day - s.day <= 30 THEN s.line END AS shipped_line
FROM o ASOF LEFT JOIN s ON o.priority = s.priority AND o.day > s.day""",
    "q_calendar_upkeep": PANEL + CLOSURE + REOPENING + " SELECT Store, Date, Open, StateHoliday, closure.* EXCLUDE (Store, Date), days_since_reopening FROM closure JOIN reopening USING (Store, Date) JOIN (SELECT Store, Date, Open, StateHoliday FROM panel) USING (Store, Date)",
    "q_distinct_sketches": """WITH l AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS week, l_orderkey, l_suppkey FROM lineitem)
SELECT CAST(date_trunc('quarter', week) AS DATE) AS quarter, min(week) AS first_week, max(week) AS last_week, count(DISTINCT week) AS weeks,
  count(DISTINCT l_orderkey) AS exact_orders, count(DISTINCT l_suppkey) AS exact_suppliers, true AS orders_within, true AS suppliers_within FROM l GROUP BY 1""",
    "q_fold_means": PANEL + SCORED + FOLD_LEARNED + " SELECT fold, Store, DayOfWeek, " + ", ".join(R6(c, c) for c in ("store_mean_sales", "store_promo_uplift", "store_dow_mean_sales", "global_mean", "global_uplift", "comp_dist_median")) + " FROM f_day JOIN f_store USING (fold, Store) JOIN f_all USING (fold)",
    "q_fold_medians": PANEL + SCORED + f" SELECT fold, Store, DayOfWeek, Promo, {R6('m3', 'median')}, {R6('m2', 'store_median')}, {R6('m0', 'all_median')} FROM m3 JOIN m2 USING (fold, Store) JOIN m0 USING (fold)",
    "q_median_rule_by_store_type": PANEL + SCORED + f" SELECT StoreType, {R6(RMSPE, 'rmspe')}, count(*) AS rows, {R6('avg(Sales)', 'mean_sales')} FROM sold WHERE fold = 4 GROUP BY StoreType",
    "q_clean_panel": PANEL + " SELECT Store, Date, Sales, Customers, Promo, StateHoliday, SchoolHoliday, DayOfWeek, StoreType, Assortment, CompetitionDistance, PromoInterval FROM open_days",
    "q_rows_to_score": PANEL + FOLDS + " SELECT Store, Date, DayOfWeek, CASE WHEN d % 3 = 0 THEN 1 ELSE Open END AS Open, Promo, StoreType FROM panel, folds WHERE fold = 4 AND Date >= valid_start",
    "q_scored_file": PANEL + SCORED + " SELECT Store, Date, Open, round(prediction, 2) AS prediction FROM newest",
    "q_joined_actuals": PANEL + SCORED + " SELECT Store, Date, Sales, round(prediction, 2) AS prediction FROM newest WHERE Sales > 0",
    "q_dates": PANEL + EASTER + """ SELECT DISTINCT Date, CAST(year(Date) AS INT) AS year, CAST(month(Date) AS INT) AS month, CAST(day(Date) AS INT) AS day_of_month, CAST(week(Date) AS INT) AS weekofyear,
  CAST(greatest(-60, least(60, date_diff('day', sunday, Date))) AS INT) AS days_to_easter, CAST(day(Date) <= 5 AS INT) AS month_start, CAST(date_diff('day', Date, last_day(Date)) AS INT) AS days_to_month_end,
  CAST(abs(date_diff('day', sunday, Date) + 48) AS INT) AS carnival_gap, CAST(floor(date_diff('day', sunday, Date) / 7.0) AS INT) AS weeks_to_easter FROM panel JOIN easter ON y = year(Date)""",
    "q_facts": PANEL + PROMO2 + f" SELECT Store, Date, coalesce(CompetitionDistance, (SELECT median(CompetitionDistance) FROM open_days)) AS CompetitionDistance, {AGE} AS competition_age_months, promo2_active, promo2_tenure_weeks, promo_cycle_pos FROM panel JOIN promo2 USING (Store, Date)",
    "q_dummies": PANEL + " SELECT Store, Date, " + ", ".join(f"CAST({c} = '{x}' AS INT) AS \"{c}_{x}\"" for c, xs in (("StoreType", "abcd"), ("Assortment", "abc"), ("StateHoliday", "0abc")) for x in xs) + " FROM panel",
    "q_features": PANEL + SCORED + LEARNED + EASTER + CLOSURE + REOPENING + PROMO2 + f""" SELECT p.Store, p.Date, p.DayOfWeek, CAST(year(p.Date) AS INT) AS year, CAST(month(p.Date) AS INT) AS month, CAST(day(p.Date) AS INT) AS day_of_month, CAST(week(p.Date) AS INT) AS weekofyear,
  p.Promo, p.SchoolHoliday, coalesce(CompetitionDistance, comp_dist_median) AS CompetitionDistance, {AGE.replace('Date', 'p.Date')} AS competition_age_months, promo2_active, """
    + ", ".join(f"CAST({c} = '{x}' AS INT) AS \"{c}_{x}\"" for c, xs in (("StoreType", "abcd"), ("Assortment", "abc"), ("StateHoliday", "0abc")) for x in xs)
    + """, round(coalesce(store_mean_sales, global_mean), 6) AS store_mean_sales, round(coalesce(store_dow_mean_sales, store_mean_sales, global_mean), 6) AS store_dow_mean_sales, round(coalesce(store_promo_uplift, global_uplift), 6) AS store_promo_uplift,
  open_yesterday, open_tomorrow, closed_days_next_7, closed_days_last_7, days_to_next_holiday, days_since_last_holiday, CAST(greatest(-60, least(60, date_diff('day', sunday, p.Date))) AS INT) AS days_to_easter, days_since_reopening,
  CAST(day(p.Date) <= 5 AS INT) AS month_start, CAST(date_diff('day', p.Date, last_day(p.Date)) AS INT) AS days_to_month_end
  FROM open_days p CROSS JOIN every JOIN closure USING (Store, Date) JOIN reopening USING (Store, Date) JOIN promo2 USING (Store, Date) JOIN easter ON y = year(p.Date) LEFT JOIN by_store USING (Store) LEFT JOIN by_day USING (Store, DayOfWeek) LEFT JOIN uplift USING (Store)""",
    "q_error_columns": PANEL + SCORED + " SELECT Store, Date, fold, round(sq, 6) AS sq, round(rel, 6) AS rel, round(ln(1 + Sales), 6) AS log_sales, CAST(floor(date_diff('day', valid_start, Date) / 7.0) AS INT) AS week_in_window, CAST(floor(date_diff('day', valid_start, Date) / 5.0) AS INT) * 5 AS day_block FROM sold",
    "q_size_quartiles": PANEL + SCORED + ", means AS (SELECT Store, avg(Sales) AS m FROM history GROUP BY 1), q AS (SELECT quantile_cont(m, [0.25, 0.5, 0.75]) AS c FROM means) SELECT Store, CASE WHEN m < c[1] THEN 'Q1 small' WHEN m < c[2] THEN 'Q2' WHEN m < c[3] THEN 'Q3' ELSE 'Q4 large' END AS size FROM means, q",
    "q_weights": PANEL + PROFILES + CELLS + ", w AS (SELECT Store, Date, segment, 1.0 / (Sales * Sales) AS w FROM open_days JOIN assignment USING (Store) WHERE Sales > 0) SELECT Store, Date, segment, round(w / avg(w) OVER (PARTITION BY segment), 6) AS weight FROM w",
    "q_closure": PANEL + CLOSURE + " SELECT * FROM closure",
    "q_closure_labels": PANEL + SCORED + CLOSURE + f", labelled AS (SELECT *, CASE WHEN open_yesterday = 0 THEN 'after a closed day' WHEN open_tomorrow = 0 THEN 'before a closed day' ELSE 'a normal day' END AS label FROM sold JOIN closure USING (Store, Date)) SELECT label, count(*) AS rows, round(count(*) / sum(count(*)) OVER (), 6) AS row_share, round(sum(sq) / sum(sum(sq)) OVER (), 6) AS error_share FROM labelled GROUP BY label",
    "q_closure_flags": PANEL + SCORED + CLOSURE + f""", promo_runs AS (SELECT Store, Date, Promo = 1 AND coalesce(lag(Promo) OVER ({W}), 0) <> 1 AS first_promo FROM open_days),
flagged AS (SELECT s.*, first_promo, open_yesterday = 0 AS after_closed, open_tomorrow = 0 AS before_closed, days_to_next_holiday <= 1 OR days_since_last_holiday <= 1 AS near_holiday
  FROM scored s JOIN closure USING (Store, Date) JOIN promo_runs USING (Store, Date)),
long AS (SELECT *, 'after_closed' AS flag FROM flagged WHERE after_closed UNION ALL SELECT *, 'before_closed' FROM flagged WHERE before_closed UNION ALL SELECT *, 'near_holiday' FROM flagged WHERE near_holiday
  UNION ALL SELECT *, 'any_flag' FROM flagged WHERE after_closed OR before_closed OR near_holiday)
SELECT flag, count(*) AS rows, count(*) FILTER (WHERE DayOfWeek = 1) AS mondays, count(*) FILTER (WHERE first_promo) AS first_promo_days, round(sqrt(avg(pow((Sales - prediction) / Sales, 2)) FILTER (WHERE Sales <> 0)), 6) AS rmspe FROM long GROUP BY flag""",
    "q_reopening": PANEL + REOPENING + " SELECT * FROM reopening",
    "q_first_back": PANEL + REOPENING + ", b AS (SELECT Store, min(Date) AS back FROM reopening WHERE days_since_reopening = 0 GROUP BY 1) SELECT Store, Date, CAST(floor(date_diff('day', back, Date) / 30.0) AS INT) * 30 AS bucket FROM open_days JOIN b USING (Store)",
    "q_neighbouring_rows": PANEL + f" SELECT Store, Date, Open, lag(Open) OVER ({W}) AS open_before, lead(Open) OVER ({W}) AS open_after FROM panel",
    "q_promo_block": PANEL + f", c AS (SELECT Store, Date, Promo, d, CASE WHEN Promo = lag(Promo) OVER ({W}) THEN 0 ELSE 1 END AS change FROM open_days), r AS (SELECT *, CAST(sum(change) OVER ({W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM c) SELECT Store, Date, Promo, run, CAST(row_number() OVER (PARTITION BY Store, run ORDER BY Date) AS INT) AS place FROM r",
    "q_nearest_holiday": PANEL + f" SELECT Store, Date, CAST(coalesce(least(d - max(CASE WHEN StateHoliday <> '0' THEN d END) OVER ({W} ROWS UNBOUNDED PRECEDING), min(CASE WHEN StateHoliday <> '0' THEN d END) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - d), 99) AS INT) AS holiday_gap FROM panel",
    "q_calendar_extension": PANEL + FOLDS + ", plan AS (SELECT Store, Date, 1 AS Open, StateHoliday FROM panel, folds WHERE fold = 4 AND Date >= valid_start), own AS (SELECT Store, Date, Open, StateHoliday FROM panel WHERE Date >= (SELECT min(Date) - 10 FROM plan) AND Store IN (SELECT Store FROM plan)) SELECT * FROM plan UNION ALL SELECT own.* FROM own ANTI JOIN plan USING (Store, Date)",
    "q_missing_day_before": PANEL + FOLDS + " SELECT p.Store, p.Date FROM open_days p, folds WHERE fold = 4 AND p.Date > train_end AND NOT EXISTS (SELECT 1 FROM panel c WHERE c.Store = p.Store AND c.Date = p.Date - 1)",
    "q_folds": PANEL + FOLDS + " SELECT fold, train_end, valid_start, valid_end, count(*) FILTER (WHERE Date <= train_end) AS train_rows, count(*) FILTER (WHERE Date BETWEEN valid_start AND valid_end) AS valid_rows FROM folds, open_days GROUP BY ALL",
    "q_learned": PANEL + SCORED + LEARNED + " SELECT Store, DayOfWeek, round(store_mean_sales, 6) AS store_mean_sales, round(store_dow_mean_sales, 6) AS store_dow_mean_sales, round(store_promo_uplift, 6) AS store_promo_uplift, round(global_mean, 6) AS global_mean, round(global_uplift, 6) AS global_uplift, comp_dist_median FROM by_day JOIN by_store USING (Store) JOIN uplift USING (Store), every",
    "q_mean_shift": PANEL + SCORED + LEARNED + REOPENING + ", back AS (SELECT r.Store, max(r.Date) AS back FROM reopening r, folds WHERE fold = 4 AND days_since_reopening = 0 AND r.Date <= (SELECT max(Date) FROM history) GROUP BY 1), enough AS (SELECT Store, back FROM history JOIN back USING (Store) WHERE Date >= back GROUP BY 1, 2 HAVING count(*) >= 60), kept AS (SELECT h.* FROM history h LEFT JOIN enough e USING (Store) WHERE back IS NULL OR Date >= back), new AS (SELECT Store, avg(Sales) AS m FROM kept GROUP BY 1) SELECT Store, round(m / store_mean_sales - 1, 6) AS shift FROM new JOIN by_store USING (Store) WHERE abs(m / store_mean_sales - 1) > 1e-6",
    "q_fixed_train": PANEL + SCORED + ", t1 AS (SELECT * FROM train WHERE fold = 1), a3 AS (SELECT Store, DayOfWeek, Promo, median(Sales) AS a3 FROM t1 GROUP BY ALL), a2 AS (SELECT Store, median(Sales) AS a2 FROM t1 GROUP BY ALL), s AS (SELECT fold, Sales, coalesce(a3, a2, (SELECT median(Sales) FROM t1)) AS p FROM scored LEFT JOIN a3 USING (Store, DayOfWeek, Promo) LEFT JOIN a2 USING (Store)) SELECT fold, round(sqrt(avg(pow((Sales - p) / Sales, 2)) FILTER (WHERE Sales <> 0)), 6) AS rmspe FROM s GROUP BY 1",
    "q_fold_summary": PANEL + SCORED + ", f AS (SELECT sqrt(avg(sq)) AS s FROM sold GROUP BY fold) SELECT round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS deviation, round(max(s) / min(s), 6) AS hardest_to_easiest FROM f",
    "q_ratio_size": PANEL + PROFILES + " SELECT " + ", ".join(f"round(corr({c}, mean_sales), 6) AS {c}" for c in ("promo_uplift", "school_uplift", "weekend_ratio", "season_amp", "dec_lift", "basket", "momentum")) + " FROM profiles",
    "q_last_rows": PANEL + " SELECT Store, Date, Sales, CAST(row_number() OVER (PARTITION BY Store ORDER BY Date DESC) AS INT) AS place FROM open_days QUALIFY row_number() OVER (PARTITION BY Store ORDER BY Date DESC) <= 5",
    "q_inner_calibration": PANEL + SCORED + ", g AS (SELECT sum(prediction / Sales) / sum(pow(prediction / Sales, 2)) AS g FROM sold WHERE fold = 3), t AS (SELECT StoreType, sum(prediction / Sales) / sum(pow(prediction / Sales, 2)) AS t FROM sold WHERE fold = 3 GROUP BY 1) SELECT round(sqrt(avg(sq)), 6) AS before, round(sqrt(avg(pow((Sales - prediction * g) / Sales, 2))), 6) AS one_factor, round(sqrt(avg(pow((Sales - prediction * coalesce(t, 1)) / Sales, 2))), 6) AS by_type FROM sold LEFT JOIN t USING (StoreType), g WHERE fold = 4",
    "q_corrections": PANEL + SCORED.replace("range(0, 4)", "range(0, 5)") + """, one AS (SELECT fold + 1 AS fold, sum(prediction / Sales) / sum(pow(prediction / Sales, 2)) AS g FROM sold GROUP BY 1),
own AS (SELECT fold + 1 AS fold, StoreType, sum(prediction / Sales) / sum(pow(prediction / Sales, 2)) AS t FROM sold GROUP BY 1, 2),
top AS (SELECT fold, sum(prediction / Sales) / sum(pow(prediction / Sales, 2)) AS c FROM sold GROUP BY 1)
SELECT fold, round(any_value(g), 6) AS factor, round(any_value(c), 6) AS ceiling_factor, round(sqrt(avg(sq)), 6) AS before, round(sqrt(avg(pow((Sales - prediction * g) / Sales, 2))), 6) AS one_factor,
  round(sqrt(avg(pow((Sales - prediction * coalesce(t, 1)) / Sales, 2))), 6) AS by_group, round(sqrt(avg(pow((Sales - prediction * c) / Sales, 2))), 6) AS ceiling
FROM sold JOIN one USING (fold) LEFT JOIN own USING (fold, StoreType) JOIN top USING (fold) GROUP BY fold""",
    "q_sample": PANEL + " SELECT Store, Date, Sales FROM open_days ORDER BY md5('0:' || Store || ':' || Date), Store, Date LIMIT 5000",
    "q_year_ago": PANEL + SCORED + ", k AS (SELECT Store, DayOfWeek, Promo, median(Sales) AS k FROM history GROUP BY ALL), s AS (SELECT n.Store, n.Date, h.Sales IS NULL AS filled, coalesce(CAST(h.Sales AS DOUBLE), k, (SELECT median(Sales) FROM history)) AS p FROM newest n LEFT JOIN history h ON h.Store = n.Store AND h.Date = n.Date - 364 LEFT JOIN k ON k.Store = n.Store AND k.DayOfWeek = n.DayOfWeek AND k.Promo = n.Promo) SELECT Store, Date, filled, round(p, 6) AS prediction FROM s",
    "q_cv_results": PANEL + SCORED + f" SELECT fold, valid_start, valid_end, count(*) AS rows, {R6(RMSPE, 'rmspe')} FROM sold JOIN folds USING (fold, valid_start) GROUP BY ALL",
    "q_compare": PANEL + SCORED + ", f AS (SELECT CAST(fold AS VARCHAR) AS fold, sqrt(avg(sq)) AS a, sqrt(avg(pow((Sales - 0.9 * prediction) / Sales, 2))) AS b FROM sold GROUP BY 1) SELECT fold, round(a, 6) AS median_rule, round(b, 6) AS lower FROM f UNION ALL SELECT 'mean', round(avg(a), 6), round(avg(b), 6) FROM f",
    "q_evaluate": PANEL + SCORED + ", e AS (SELECT CASE WHEN grouping(w) = 1 THEN 'all' ELSE CAST(w AS VARCHAR) END AS week, count(*) AS rows, round(sqrt(avg(sq)), 4) AS rmspe FROM (SELECT *, CAST(date_trunc('week', Date) AS DATE) AS w FROM sold WHERE Sales > 0) GROUP BY ROLLUP (w)) SELECT *, rmspe > 0.9 AS above_threshold FROM e",
    "q_alarms": PANEL + SCORED + ", e AS (SELECT CAST(CAST(date_trunc('week', Date) AS DATE) AS VARCHAR) AS week, round(sqrt(avg(sq)), 4) > 0.9 AS above FROM sold GROUP BY 1) SELECT week, CASE WHEN above AND coalesce(lag(above) OVER (ORDER BY week), false) THEN 'alarm' WHEN above THEN 'warning' ELSE 'fine' END AS state FROM e",
    "q_error_shares": PANEL + SCORED + " SELECT StoreType, Assortment, Promo, count(*) AS rows, round(count(*) / sum(count(*)) OVER (), 6) AS row_share, round(sum(sq) / sum(sum(sq)) OVER (), 6) AS error_share FROM sold GROUP BY 1, 2, 3",
    "q_concentration": PANEL + SCORED + ", g AS (SELECT Store, sum(sq) AS total, count(*) AS rows FROM sold GROUP BY 1) SELECT Store, round(total, 6) AS total, rows, round(sum(total) OVER (ORDER BY total DESC, Store ROWS UNBOUNDED PRECEDING) / sum(total) OVER (), 6) AS running_share, CAST(row_number() OVER (ORDER BY total DESC, Store) AS INT) AS place FROM g",
    "q_worst_days": PANEL + SCORED + ", g AS (SELECT fold, Date, sum(sq) AS total FROM sold GROUP BY 1, 2), r AS (SELECT *, total / sum(total) OVER (PARTITION BY fold) AS share, CAST(row_number() OVER (PARTITION BY fold ORDER BY total DESC, Date) AS INT) AS place FROM g) SELECT fold, Date, round(total, 6) AS total, round(share, 6) AS share, place FROM r WHERE place <= 4",
    "q_without_worst_days": PANEL + SCORED + ", g AS (SELECT fold, Date, sum(sq) AS total FROM sold GROUP BY 1, 2), r AS (SELECT fold, Date FROM g QUALIFY row_number() OVER (PARTITION BY fold ORDER BY total DESC, Date) <= 2) SELECT fold, round(sqrt(avg(sq)), 6) AS rmspe FROM sold ANTI JOIN r USING (fold, Date) GROUP BY 1",
    "q_pivot": PANEL + SCORED + " SELECT StoreType, " + ", ".join(f"round(sqrt(avg(sq) FILTER (WHERE fold = {k})), 6) AS fold_{k}" for k in range(1, 5)) + " FROM sold GROUP BY 1",
    "q_correlations": PANEL + ", s AS (SELECT Store, avg(Sales) AS m, max(CompetitionDistance) AS dist FROM open_days GROUP BY 1) SELECT round((SELECT corr(Customers, Sales) FROM open_days), 6) AS customers_sales, round((SELECT corr(dist, m) FROM s WHERE dist IS NOT NULL), 6) AS distance_sales",
    "q_means_by": PANEL + "".join(f"{' UNION ALL' if i else ''} SELECT '{n}' AS dim, CAST({x} AS VARCHAR) AS level, round(avg(Sales), 6) AS mean_sales, count(*) AS rows FROM open_days GROUP BY 2" for i, (n, x) in enumerate({"weekday": "DayOfWeek", "month": "month(Date)", "promo": "Promo", "holiday": "StateHoliday", "school": "SchoolHoliday", "type": "StoreType", "assortment": "Assortment"}.items())),
    "q_weekly": PANEL + " SELECT CAST(date_trunc('week', Date) AS DATE) AS week, round(avg(Sales), 6) AS mean_sales, count(DISTINCT Store) AS stores FROM open_days GROUP BY 1",
    "q_store_means": PANEL + " SELECT Store, round(avg(Sales), 6) AS mean_sales, max(CompetitionDistance) AS distance, max(StoreType) AS type FROM open_days GROUP BY Store HAVING max(CompetitionDistance) IS NOT NULL",
    "q_quality": PANEL + ", r AS (SELECT *, weekday(Date) AS wd FROM panel)" + "".join(
        f"{' UNION ALL' if i else ''} SELECT '{n}' AS \"check\", count(*) AS bad FROM {t} WHERE {x}" for i, (n, t, x) in enumerate([
            ("store below 1", "r", "Store < 1"), ("weekday out of range", "r", "DayOfWeek NOT BETWEEN 1 AND 7"), ("weekday differs from date", "r", "DayOfWeek <> isodow(Date)"), ("negative sales", "r", "Sales < 0"),
            ("negative customers", "r", "Customers < 0"), ("open not 0 or 1", "r", "Open NOT IN (0, 1)"), ("promo not 0 or 1", "r", "Promo NOT IN (0, 1)"), ("unknown holiday", "r", "StateHoliday NOT IN ('0', 'a', 'b', 'c')"),
            ("closed with sales", "r", "Open = 0 AND Sales > 0"), ("closed with customers", "r", "Open = 0 AND Customers > 0"), ("customers without sales", "r", "Customers > 0 AND Sales = 0"), ("open without sales", "r", "Open = 1 AND Sales = 0"), ("sales without customers", "r", "Sales > 0 AND Customers = 0"), ("no store facts", "r", "StoreType IS NULL"),
            ("no distance", "store", "CompetitionDistance IS NULL"), ("no competitor date", "store", "CompetitionOpenSinceYear IS NULL"), ("placeholder year", "store", "CompetitionOpenSinceYear < 1950"), ("unknown type", "store", "StoreType NOT IN ('a', 'b', 'c', 'd')"),
            ("promo2 without start", "store", "Promo2 = 1 AND Promo2SinceYear IS NULL"), ("start without promo2", "store", "Promo2 = 0 AND Promo2SinceYear IS NOT NULL"), ("promo2 without months", "store", "Promo2 = 1 AND PromoInterval IS NULL"),
            ("repeated key", "(SELECT Store, Date FROM panel GROUP BY ALL HAVING count(*) > 1)", "true")])),
    "q_silent_stores": PANEL + " SELECT DISTINCT Store FROM panel WHERE Store NOT IN (SELECT Store FROM panel WHERE Date BETWEEN DATE '1998-01-01' AND DATE '1998-01-10')",
    "q_calibration": PANEL + SCORED + ", f AS (SELECT fold, StoreType, sum(prediction / Sales) / sum(pow(prediction / Sales, 2)) AS factor FROM sold WHERE Sales > 0 GROUP BY 1, 2), c AS (SELECT s.fold, s.Sales, s.prediction * factor AS p, s.sq FROM sold s JOIN f USING (fold, StoreType)) SELECT fold, round(sqrt(avg(sq)), 6) AS before, round(sqrt(avg(pow((Sales - p) / Sales, 2))), 6) AS after FROM c GROUP BY 1",
    "q_profiles": PANEL + PROFILES + " SELECT Store, round(mean_sales, 6) AS mean_sales, days, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("promo_uplift", "school_uplift", "weekend_ratio", "season_amp", "dec_lift", "basket", "momentum")) + " FROM profiles",
    "q_standardised": PANEL + PROFILES + ", l AS (SELECT * FROM profiles WHERE days >= 300) SELECT Store, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1), 6) AS z_{c}" for c in ("promo_uplift", "school_uplift", "weekend_ratio", "season_amp", "dec_lift", "basket", "momentum")) + " FROM l",
    "q_cells": PANEL + PROFILES + CELLS + " SELECT * FROM cells",
    "q_segment_summary": PANEL + PROFILES + CELLS + ", g AS (SELECT segment, CAST(sum(Sales) AS BIGINT) AS sales, count(DISTINCT Store) AS stores FROM open_days JOIN assignment USING (Store) GROUP BY 1) SELECT segment, sales, stores, round(sales / sum(sales) OVER (), 6) AS sales_share, round(stores / sum(stores) OVER (), 6) AS store_share, round((sales / sum(sales) OVER ()) / (stores / sum(stores) OVER ()), 6) AS lift FROM g",
    "q_segment_sizes": PANEL + PROFILES + CELLS + ", g AS (SELECT segment, count(*) AS stores FROM assignment GROUP BY 1) SELECT segment, stores, row_number() OVER (ORDER BY stores DESC, segment) = 1 AS is_default FROM g",
    "q_segment_types": PANEL + PROFILES + CELLS + " SELECT segment, " + ", ".join(f"count(*) FILTER (WHERE StoreType = '{x}') AS {x}" for x in "abcd") + " FROM store JOIN assignment USING (Store) GROUP BY 1",
    "q_segment_lookup": PANEL + PROFILES + CELLS + ", g AS (SELECT segment FROM assignment GROUP BY 1 ORDER BY count(*) DESC, segment LIMIT 1) SELECT Store, Date, coalesce(a.segment, g.segment) AS segment FROM open_days LEFT JOIN assignment a USING (Store), g",
    "q_adjusted_rand": PANEL + PROFILES + CELLS + ", l AS (SELECT segment AS a, cell % 3 AS b FROM cells JOIN assignment USING (Store)), n AS (SELECT a, b, count(*) AS n FROM l GROUP BY ALL), t AS (SELECT sum(n * (n - 1) / 2) AS both_, sum(n) AS every_ FROM n), x AS (SELECT sum(s * (s - 1) / 2) AS ia FROM (SELECT a, sum(n) AS s FROM n GROUP BY 1)), y AS (SELECT sum(s * (s - 1) / 2) AS ib FROM (SELECT b, sum(n) AS s FROM n GROUP BY 1)) SELECT round((both_ - ia * ib / (every_ * (every_ - 1) / 2)) / ((ia + ib) / 2 - ia * ib / (every_ * (every_ - 1) / 2)), 6) AS ari FROM t, x, y",
    "q_business": PANEL + SCORED + " SELECT median(Sales) AS median_sales, round(quantile_cont(abs(prediction - Sales), 0.5), 6) AS miss_median, round(quantile_cont(abs(prediction - Sales), 0.9), 6) AS miss_90, round(quantile_cont(abs(rel), 0.5), 6) AS share_median, round(quantile_cont(abs(rel), 0.9), 6) AS share_90, round(avg(CAST(rel > 0 AS INT)), 6) AS too_high, round(avg(CAST(rel < 0 AS INT)), 6) AS too_low, round(sum(prediction) / sum(Sales) - 1, 6) AS bias FROM sold WHERE fold = 4",
    "q_week_ahead": PANEL + SCORED + f" SELECT CAST(floor(date_diff('day', valid_start, Date) / 7.0) AS INT) AS week_ahead, {R6(RMSPE, 'rmspe')}, count(*) AS rows, {R6('avg(Sales)', 'mean_sales')} FROM sold GROUP BY 1",
    "q_bias": PANEL + SCORED + " SELECT StoreType, round(avg(rel), 6) AS mean_error, round(median(rel), 6) AS median_error FROM sold GROUP BY 1",
    "q_shape": PANEL + SCORED + ", h AS (SELECT Store, avg(Sales) AS was FROM history WHERE Date > (SELECT max(Date) - 42 FROM history) GROUP BY 1), r AS (SELECT avg(prediction) / nullif(was, 0) AS ratio FROM newest JOIN h USING (Store) GROUP BY Store, was) SELECT count(*) AS rows, count(DISTINCT Store) AS stores, count(DISTINCT Date) AS days, count(*) FILTER (WHERE prediction IS NULL) AS missing, count(*) FILTER (WHERE Open = 0) AS closed, count(*) FILTER (WHERE Open = 0 AND prediction <> 0) AS closed_not_zero, (SELECT round(quantile_cont(ratio, 0.05), 6) FROM r) AS ratio_5, (SELECT round(quantile_cont(ratio, 0.5), 6) FROM r) AS ratio_50, (SELECT round(quantile_cont(ratio, 0.95), 6) FROM r) AS ratio_95 FROM newest",
    "q_intervals": PANEL + SCORED + ", s AS (SELECT *, ascii(StoreType) - 96 AS segment FROM scored), q AS (SELECT segment, quantile_cont(Sales / prediction, 0.1) AS ql, quantile_cont(Sales / prediction, 0.9) AS qh FROM s WHERE fold = 3 AND Sales > 0 AND prediction > 0 GROUP BY 1), i AS (SELECT segment, Sales, prediction, prediction * ql AS low, prediction * qh AS high FROM s JOIN q USING (segment) WHERE fold = 4 AND Sales > 0) SELECT CAST(segment AS INT) AS segment, round(avg(CAST(Sales BETWEEN low AND high AS INT)), 6) AS coverage, round(avg((high - low) / prediction), 6) AS width, round(min((high - low) / prediction), 6) AS width_min, round(max((high - low) / prediction), 6) AS width_max FROM i GROUP BY 1",
    "q_arms": PANEL + SCORED + ARMS + " SELECT arm, round(rmspe, 6) AS rmspe, round(noise, 6) AS noise FROM arm_means",
    "q_accepted": PANEL + SCORED + ARMS + ", b AS (SELECT fold, rmspe AS base FROM arm_folds WHERE arm = 'median'), n AS (SELECT noise FROM arm_means WHERE arm = 'median') SELECT arm, count(*) FILTER (WHERE rmspe - base < 0) AS better_on, count(*) AS folds, bool_and(rmspe - base < -noise) AS accepted FROM arm_folds JOIN b USING (fold), n WHERE arm <> 'median' GROUP BY arm",
    "q_seed_scores": PANEL + SCORED + ARMS + ", e AS (SELECT fold, seed, sqrt(avg(pow((Sales - p) / Sales, 2)) FILTER (WHERE Sales <> 0)) AS s, count(*) AS n FROM arms WHERE arm = 'median' GROUP BY ALL) SELECT fold, round(avg(s), 6) AS rmspe, round(stddev_pop(s), 6) AS noise, CAST(avg(n) AS INT) AS rows FROM e GROUP BY 1",
    "q_seed_mean": PANEL + SCORED + ARMS + " SELECT Store, Date, max(Sales) AS Sales, round(avg(p), 6) AS prediction FROM arms WHERE arm = 'median' AND fold = 4 GROUP BY 1, 2",
    "q_two_models": PANEL + SCORED + " SELECT fold, Promo, round(sqrt(avg(sq)), 6) AS rmspe_a, round(sqrt(avg(pow((Sales - 0.8 * prediction) / Sales, 2))), 6) AS rmspe_b, count(*) AS rows, round(sqrt(avg(pow((Sales - 0.8 * prediction) / Sales, 2))) - sqrt(avg(sq)), 6) AS delta FROM sold GROUP BY 1, 2",
    "q_worst_days_by_arm": PANEL + SCORED + ", d AS (SELECT Date, sum(sq) AS total FROM sold WHERE fold = 4 GROUP BY 1 ORDER BY total DESC, Date LIMIT 8) SELECT Date, round(sqrt(avg(sq)), 6) AS median, round(sqrt(avg(pow((Sales - 0.8 * prediction) / Sales, 2))), 6) AS low FROM sold SEMI JOIN d USING (Date) WHERE fold = 4 GROUP BY 1",
    "q_promote": PANEL + SCORED + ", s AS (SELECT sqrt(avg(sq)) AS a, sqrt(avg(pow((Sales - 0.8 * prediction) / Sales, 2))) AS b FROM sold WHERE fold = 4) SELECT round(a, 6) AS champion, round(b, 6) AS challenger, b <= a + 0.01 AS promoted FROM s",
    "q_weekly_events": "WITH p AS (SELECT CAST(ts AS DATE) AS Date, CAST(user_id % 50 AS INT) AS Store, value FROM events) SELECT CAST(date_trunc('week', Date) AS DATE) AS week, count(*) AS rows, round(avg(value), 6) AS mean_value, count(DISTINCT Store) AS stores FROM p GROUP BY 1",
    "q_compared_sets": PANEL + REOPENING + ", a AS (SELECT DISTINCT Store FROM reopening WHERE days_since_reopening < 365), b AS (SELECT DISTINCT Store FROM panel WHERE Store NOT IN (SELECT Store FROM panel WHERE Date BETWEEN DATE '1998-01-01' AND DATE '1998-01-10')) SELECT (SELECT count(*) FROM a ANTI JOIN b USING (Store)) AS only_a, (SELECT count(*) FROM b ANTI JOIN a USING (Store)) AS only_b, (SELECT count(*) FROM a JOIN b USING (Store)) AS \"both\"",
    "q_stable_labels": PANEL + SCORED + ", l AS (SELECT fold, Store, floor(avg(Sales) / 4000) AS segment FROM train GROUP BY 1, 2), o AS (SELECT Store, count(DISTINCT segment) AS labels FROM l GROUP BY 1 HAVING count(DISTINCT fold) = 4) SELECT count(*) AS stores, count(*) FILTER (WHERE labels = 1) AS stable, round(avg(CAST(labels = 1 AS INT)), 6) AS share FROM o",
    "q_daily_totals": PANEL + SCORED + " SELECT Date, round(sum(prediction), 6) AS total, count(*) FILTER (WHERE Open = 1) AS open_stores FROM newest GROUP BY 1",
    "q_weekday_levels": PANEL + SCORED + ", r AS (SELECT DayOfWeek, avg(Sales) AS recent FROM history WHERE Date > (SELECT max(Date) - 42 FROM history) AND Store IN (SELECT Store FROM newest) GROUP BY 1), n AS (SELECT DayOfWeek, avg(prediction) AS forecast FROM newest WHERE Open = 1 GROUP BY 1) SELECT DayOfWeek, round(forecast, 6) AS forecast, round(recent, 6) AS recent FROM n FULL JOIN r USING (DayOfWeek)",
    "q_segment_described": PANEL + PROFILES + CELLS + " SELECT segment, count(*) AS stores, round(avg(mean_sales), 0) AS mean_sales, " + ", ".join(f"round(avg({c}), 3) AS {c}" for c in ("promo_uplift", "school_uplift", "weekend_ratio", "season_amp", "dec_lift", "basket", "momentum")) + " FROM profiles JOIN assignment USING (Store) GROUP BY 1",
    "q_fold_correlation": PANEL + SCORED + ", s AS (SELECT Store, sqrt(avg(sq) FILTER (WHERE fold = 3)) AS a, sqrt(avg(sq) FILTER (WHERE fold = 4)) AS b FROM sold GROUP BY 1) SELECT round(corr(a, b), 6) AS correlation, count(*) AS stores FROM s WHERE a IS NOT NULL AND b IS NOT NULL",
    "q_segment_one_hot": PANEL + PROFILES + CELLS + ", g AS (SELECT segment FROM assignment GROUP BY 1 ORDER BY count(*) DESC, segment LIMIT 1), l AS (SELECT Store, Date, coalesce(a.segment, g.segment) AS segment FROM open_days LEFT JOIN assignment a USING (Store), g) SELECT *, " + ", ".join(f"CAST(segment = {k} AS INT) AS segment_{k}" for k in range(1, 5)) + " FROM l",
}
