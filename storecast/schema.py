"""Input schemas and the constants that the feature columns depend on."""

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    kinds = {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "date": T.DateType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (pair.split(":") for pair in text.split())])


DAILY = _struct("Store:int DayOfWeek:int Date:date Sales:long Customers:int Open:int Promo:int StateHoliday:string SchoolHoliday:int")
STORE = _struct(
    "Store:int StoreType:string Assortment:string CompetitionDistance:double CompetitionOpenSinceMonth:int CompetitionOpenSinceYear:int Promo2:int Promo2SinceWeek:int Promo2SinceYear:int PromoInterval:string"
)
REQUEST = _struct("Id:long Store:int Date:date Open:int Promo:int StateHoliday:string SchoolHoliday:int")
CALENDAR = ("Store", "Date", "Open", "StateHoliday")

# Category levels and month names as the data spell them.
STORE_TYPES = ("a", "b", "c", "d")
ASSORTMENTS = ("a", "b", "c")
HOLIDAYS = ("0", "a", "b", "c")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sept", "Oct", "Nov", "Dec")

FIRST_REAL_YEAR = 1950  # an earlier opening year is a placeholder
HOLIDAY_CAP = 10
LONG_CLOSURE, REOPENING_CAP = 21, 365
EASTER_CAP = 60
MIN_REOPENED_ROWS = 60
HORIZON, FOLDS, MIN_TRAIN_DAYS = 42, 4, 365

DATE_FEATURES = ["DayOfWeek", "year", "month", "day_of_month", "weekofyear"]
KNOWN_FEATURES = ["Promo", "SchoolHoliday", "CompetitionDistance", "competition_age_months", "promo2_active"]
DUMMIES = [*(f"StoreType_{x}" for x in STORE_TYPES), *(f"Assortment_{x}" for x in ASSORTMENTS), *(f"StateHoliday_{x}" for x in HOLIDAYS)]
LEARNED_FEATURES = ["store_mean_sales", "store_dow_mean_sales", "store_promo_uplift"]
CLOSURE_FEATURES = ["open_yesterday", "open_tomorrow", "closed_days_next_7", "closed_days_last_7", "days_to_next_holiday", "days_since_last_holiday"]


PROMO2_EXTRAS = ["promo2_tenure_weeks", "promo_cycle_pos"]
#: Switches of :func:`feature_names`, as arms and the forecaster name them.
FAMILIES = ("closure", "easter", "reopening", "month", "promo2", "customers")


def feature_names(*, closure: bool | str = True, easter: bool = True, reopening: bool = False, month: bool = False, promo2: bool = False, customers: bool = False) -> list[str]:
    """The model's features in their fixed order.

    ``closure`` may be "flags" (the neighbouring days and counts) or "distances"
    (to holidays). ``customers`` leaks what is not known beforehand: for comparison only.
    """
    names = DATE_FEATURES + KNOWN_FEATURES + DUMMIES + LEARNED_FEATURES
    names += {"flags": CLOSURE_FEATURES[:4], "distances": CLOSURE_FEATURES[4:]}.get(closure, CLOSURE_FEATURES if closure else [])
    names += ["days_to_easter"] if easter else []
    names += ["days_since_reopening"] if reopening else []
    names += ["month_start", "days_to_month_end"] if month else []
    return names + (PROMO2_EXTRAS if promo2 else []) + (["Customers"] if customers else [])
