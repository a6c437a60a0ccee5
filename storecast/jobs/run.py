"""spark-submit storecast/jobs/run.py fit|predict|evaluate|backtest|compare|correct|calendar ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from storecast.jobs.backtest import Arm, Backtest, results
from storecast.jobs.calendar_store import CalendarStore
from storecast.jobs.forecaster import Forecaster
from storecast.operators import baseline, experiment, monitor
from storecast.operators.validation import RollingOrigin
from storecast.schema import DAILY, STORE
from storecast.sources import files
from storecast.sources.tables import released


def fit(spark: SparkSession, a: argparse.Namespace) -> None:
    calendar = files.read_panel(spark, a.daily, a.store, drop_closed=False).persist()
    train = calendar.filter("Open = 1 and Sales > 0")
    Forecaster(seeds=list(range(a.seeds))).fit(train, calendar).save(a.model)


def predict(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = files.read_request(spark, a.rows, a.store)
    files.write_scored(Forecaster.load(spark, a.model).predict(rows, interval=a.interval), a.out)


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    scored = spark.read.option("header", True).csv(a.predictions, inferSchema=False)
    scored = scored.select(F.col("Store").cast("int"), F.col("Date").cast("date"), *(F.col(c).cast("double") for c in ("prediction", "low", "high") if c in scored.columns))
    both = files.with_predictions(files.read(spark, a.daily, DAILY), scored)
    if both.filter("Sales > 0").isEmpty():
        raise ValueError("no row has sales and a prediction")
    monitor.evaluate(both, a.threshold).coalesce(1).write.mode("overwrite").option("header", True).csv(a.out)


def backtest(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = files.clean_panel(files.read(spark, a.daily, DAILY), files.read(spark, a.store, STORE))
    split = RollingOrigin()
    experiment.cv_results(baseline.scored_folds(rows, split), split, rows).coalesce(1).write.mode("overwrite").option("header", True).csv(a.out)


def _arms(spark: SparkSession, path: str) -> list[Arm]:
    return [Arm(**x) for x in json.loads("\n".join(r.value for r in spark.read.text(path).collect()))]  # a file written by hand


def compare(spark: SparkSession, a: argparse.Namespace) -> None:
    """Arms of the model over folds and seeds; --model is the folder of what is scored already, --arms a JSON list of arms."""
    arms = _arms(spark, a.arms)
    calendar = files.read_panel(spark, a.daily, a.store, drop_closed=False)
    scores = results(Backtest(a.model, arms, list(range(a.seeds))).run(calendar))
    summary = experiment.arm_summary(scores).join(experiment.accepted(scores, a.base), "arm", "left")
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(a.out)


def correct(spark: SparkSession, a: argparse.Namespace) -> None:
    """What factors learnt on the inner cuts would have done to the arms of --arms, by arm and window; --model as for compare."""
    own = Backtest(a.model, _arms(spark, a.arms), list(range(a.seeds)), inner=True)
    scored = own.run(files.read_panel(spark, a.daily, a.store, drop_closed=False))
    out = monitor.corrections(scored, own.inner_scored(spark, own.splitter.n_splits), keys=("arm", "fold"))
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(a.out)


def calendar(spark: SparkSession, a: argparse.Namespace) -> None:
    """Add the days of --daily to the calendar kept in --model."""
    print(CalendarStore(spark, a.model).add(files.read(spark, a.daily, DAILY)), "days added")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("job", choices=["fit", "predict", "evaluate", "backtest", "compare", "correct", "calendar"])
    for name in ("daily", "store", "rows", "model", "predictions", "out", "arms", "base"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--seeds", type=int, default=1)
    parser.add_argument("--threshold", type=float)
    parser.add_argument("--interval", type=float, help="share of sales that low and high shall hold, such as 0.8")
    a = parser.parse_args()
    spark = SparkSession.builder.appName(f"storecast {a.job}").getOrCreate()
    try:
        globals()[a.job](spark, a)
    finally:
        released(spark)


if __name__ == "__main__":
    main()
