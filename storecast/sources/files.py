"""Daily rows, store facts and requests from CSV or Parquet; scored rows to CSV or Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..schema import DAILY, REQUEST, STORE

WHOLE = ("Sales", "Customers", "Open", "Promo", "SchoolHoliday", "DayOfWeek", "Store")
SCORED = ("Id", "Store", "Date", "Open", "prediction", "low", "high")


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table with the given columns, from Parquet by its ending, else from CSV with a header.

    An empty field of a CSV file is null; a malformed one (a date or number that is none) is an error when the row is read.
    """
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
        return df.select(*(F.col(f.name).cast(f.dataType) for f in schema if f.name in df.columns))
    # By the header's names, so files may lack columns or hold them in another order.
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*(strictly(f.name, f.dataType).alias(f.name) for f in schema if f.name in raw.columns))


def read_setting_aside(spark: SparkSession, path: str, schema, aside: str) -> DataFrame:
    """The rows of a CSV file that can be read; the others go to the Parquet folder ``aside`` (replaced) as file, record, problems.

    ``problems`` names the malformed columns, or "number of fields" for a line
    with more or fewer fields than the header. :func:`aside_counts` has their
    numbers. The file is parsed twice: for what is set aside, and when the rows are used.
    """
    names = spark.read.option("header", True).csv(path).columns
    texts = ", ".join(f"`{n}` string" for n in names)
    lines = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_record").schema(f"{texts}, `_record` string").csv(path)
    own = [f for f in schema if f.name in names]
    problems = F.filter(F.array(*(F.when(_malformed(f.name, f.dataType), F.lit(f.name)) for f in own), F.when(F.col("_record").isNotNull(), F.lit("number of fields"))), lambda x: x.isNotNull())
    record = F.coalesce("_record", F.to_csv(F.struct(*(F.col(f"`{n}`") for n in names))))
    checked = lines.withColumns({"_problems": problems, "_line": record})
    bad = checked.filter(F.size("_problems") > 0).select(F.input_file_name().alias("file"), F.col("_line").alias("record"), F.col("_problems").alias("problems"))
    bad.write.mode("overwrite").parquet(aside)
    return checked.filter(F.size("_problems") == 0).select(*(strictly(f.name, f.dataType).alias(f.name) for f in own))


def aside_counts(spark: SparkSession, aside: str) -> DataFrame:
    """problem, rows: a row with two malformed columns counts for both."""
    return spark.read.parquet(aside).select(F.explode("problems").alias("problem")).groupBy("problem").agg(F.count("*").alias("rows"))


def _value(name: str, kind) -> Column:
    text = F.col(name)
    return text.try_cast("double").try_cast(kind) if isinstance(kind, IntegralType) else text.try_cast(kind)


def _malformed(name: str, kind) -> Column:
    return F.col(name).isNotNull() & _value(name, kind).isNull()


def strictly(name: str, kind) -> Column:
    """Text as ``kind``; whole numbers may be written with a point ("9.0"). What cannot be read raises."""
    bad = F.raise_error(F.concat(F.lit(f"{name} is malformed: "), F.col(name))).cast(kind)
    return F.when(_malformed(name, kind), bad).otherwise(_value(name, kind))


def clean_panel(daily: DataFrame, store: DataFrame, drop_closed: bool = True) -> DataFrame:
    """Daily rows with their store's facts; rows of unknown stores keep null facts. Closed days go unless kept."""
    rows = daily.filter("Open = 1") if drop_closed else daily
    rows = rows.join(store, "Store", "left")
    return rows.withColumns({c: F.col(c).cast("long" if c == "Sales" else "int") for c in WHOLE if c in rows.columns})


def rows_to_score(request: DataFrame, store: DataFrame) -> DataFrame:
    """Rows to predict: a missing Open counts as open, the weekday is filled where the column is absent."""
    rows = request.withColumn("Open", F.coalesce("Open", F.lit(1)))
    if "DayOfWeek" not in rows.columns:
        rows = rows.withColumn("DayOfWeek", F.weekday("Date") + 1)
    return clean_panel(rows, store, drop_closed=False)


def read_panel(spark: SparkSession, daily: str, store: str, drop_closed: bool = True) -> DataFrame:
    return clean_panel(read(spark, daily, DAILY), read(spark, store, STORE), drop_closed)


def read_request(spark: SparkSession, path: str, store: str) -> DataFrame:
    schema = [*REQUEST.fields, DAILY["DayOfWeek"]]
    return rows_to_score(read(spark, path, schema), read(spark, store, STORE))


def scored_columns(scored: DataFrame) -> DataFrame:
    """The columns of the predictions file that exist, numbers at two decimals."""
    own = [c for c in SCORED if c in scored.columns]
    return scored.select(*(F.round(c, 2).alias(c) if c in ("prediction", "low", "high") else F.col(c) for c in own))


def write_scored(scored: DataFrame, path: str) -> None:
    """One folder of files; the order of rows inside a file is Store, Date."""
    out = scored_columns(scored).sortWithinPartitions("Store", "Date").write.mode("overwrite")
    if path.rstrip("/").endswith(".parquet"):
        out.parquet(path)
    else:
        out.option("header", True).csv(path)


def with_predictions(actuals: DataFrame, predictions: DataFrame) -> DataFrame:
    """Actual and predicted rows that match by store and day."""
    own = [c for c in ("prediction", "low", "high") if c in predictions.columns]
    return actuals.join(predictions.select("Store", "Date", *own), ["Store", "Date"])
