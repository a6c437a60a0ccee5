"""A boosted-tree sales model whose number of trees is found on the newest days of training."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.facts import from_log, log_target
from ..schema import HORIZON
from ..sources.tables import dealt

DEFAULTS = {"stepSize": 0.05, "maxDepth": 8, "minInstancesPerNode": 5, "subsamplingRate": 0.9, "featureSubsetStrategy": "0.8", "maxIter": 2000}
PATIENCE = 50


def inner_split(train: DataFrame, days: int = HORIZON) -> tuple[DataFrame, DataFrame]:
    """Older rows, and those of the last days; an error where a side is empty."""
    last = train.agg(F.max("Date")).first()[0]
    cut = F.lit(last - timedelta(days)) if last else F.lit(None).cast("date")
    old, new = train.filter(F.col("Date") <= cut), train.filter(F.col("Date") > cut)
    if last is None or old.isEmpty() or new.isEmpty():
        raise ValueError("too few days of training for an inner window")
    return old, new


def best_round(errors: list[float], patience: int = PATIENCE) -> int:
    """The number of trees with the least error, stopping ``patience`` trees after the last improvement."""
    best = 0
    for k, e in enumerate(errors):
        if e < errors[best]:
            best = k
        elif k - best >= patience:
            break
    return best + 1


def first_trees(model: GBTRegressionModel, trees: int) -> GBTRegressionModel:
    """The model that a fit of so many trees alone gives on the same rows."""
    if trees == model.getNumTrees:
        return model
    java = model._java_obj
    own = SparkSession.active()._jvm.org.apache.spark.ml.regression.GBTRegressionModel(java.uid(), java.trees()[:trees], java.treeWeights()[:trees])
    return GBTRegressionModel(own).setFeaturesCol(model.getFeaturesCol()).setPredictionCol(model.getPredictionCol())


def exact_metric_weight(rows: DataFrame, by: str | None = None, name: str = "weight") -> DataFrame:
    """The rows with sales and 1 / Sales squared at mean one (within ``by``): with it, squared error on raw sales is the squared relative error.

    The means are aggregated and joined back, one row per level of ``by``.
    """
    sold = rows.filter("Sales > 0").withColumn(name, 1 / (F.col("Sales") * F.col("Sales")).cast("double"))
    level = F.col(by) if by else F.lit(1)
    means = sold.groupBy(level.alias("_level")).agg(F.avg(name).alias("_mean"))
    return sold.join(means, level == F.col("_level")).withColumn(name, F.col(name) / F.col("_mean")).drop("_level", "_mean")


def hold(rows: DataFrame, count: int) -> DataFrame:
    """Rows kept in memory for fits, ``count`` of them, in tasks whose rows do not grow with the table.

    Every tree is a job a level over these tasks, each with sums for all nodes: no more tasks than cores, unless the rows ask for them.
    """
    return dealt(rows, "Store", count, rows.sparkSession.sparkContext.defaultParallelism).persist()


@dataclass
class SalesModel:
    features: list[str]
    params: dict = field(default_factory=dict)
    seed: int = 0
    log: bool = True
    weight: str | None = None
    patience: int = PATIENCE
    inner_days: int = HORIZON
    fixed_rounds: int | None = None
    refit: bool = True
    rounds: int = 0
    model: GBTRegressionModel | None = None
    watched: GBTRegressionModel | None = None

    def assembled(self, df: DataFrame) -> DataFrame:
        if missing := [c for c in self.features if c not in df.columns]:
            raise ValueError(f"missing features: {', '.join(missing)}")
        return VectorAssembler(inputCols=self.features, outputCol="features", handleInvalid="keep").transform(df)

    def _regressor(self, trees: int) -> GBTRegressor:
        out = GBTRegressor(featuresCol="features", labelCol="label", predictionCol="raw", seed=self.seed, **{**DEFAULTS, **self.params, "maxIter": trees})
        return out.setWeightCol(self.weight) if self.weight else out

    def _counted(self, old: DataFrame, new: DataFrame) -> int:
        """The number of trees that is best on the newer rows."""
        return self._grown(old, new).getNumTrees

    def _grown(self, old: DataFrame, new: DataFrame) -> GBTRegressionModel:
        """The older rows' model of the number of trees that is best on the newer ones. Trees do not depend on how many follow, so growth stops
        once the patience is used up: the limit, little beyond it at first, doubles until then, or until ``maxIter``. What was grown beyond the best number is cut off."""
        most, trees = {**DEFAULTS, **self.params}["maxIter"], self.patience + max(1, self.patience // 5)
        while True:
            trees = max(1, min(trees, most))
            model = self._regressor(trees).fit(old)
            best = best_round(list(model.evaluateEachIteration(new, "squared")), self.patience)
            if trees == most or best + self.patience <= trees:
                return first_trees(model, best)
            trees *= 2

    def fit(self, train: DataFrame, watch: bool = False, held: bool = False) -> SalesModel:
        """Trees are counted on the last days, then all rows are fitted with that number, unless it is fixed or ``refit`` is off.

        ``watch`` (and no refit) keeps as ``watched`` the model of the older rows with that number of trees.
        ``held``: the rows are in memory as :func:`hold` has them, for several fits, and are not dealt again.
        """
        labelled = train.withColumn("label", log_target() if self.log else F.col("Sales").cast("double"))
        own = dict.fromkeys(["Date", *([self.weight] if self.weight else []), "label"])
        needed = labelled.select("Store", *(c for c in dict.fromkeys([*own, *self.features]) if c in labelled.columns and c != "Store"))
        if not held:
            needed = hold(needed, train.count())
        try:
            # Columns are in memory, not vectors, which take several times as much: a fit puts its rows together three times before it has its own copy.
            rows = self.assembled(needed).select("features", *own)
            old, new = (rows, rows) if self.fixed_rounds and self.refit and not watch else inner_split(rows, self.inner_days)
            grown = None if self.fixed_rounds else self._grown(old, new)
            self.rounds = self.fixed_rounds or grown.getNumTrees
            self.watched = (grown or self._regressor(self.rounds).fit(old)) if watch or not self.refit else None
            self.model = self._regressor(self.rounds).fit(rows) if self.refit else self.watched
        finally:
            if not held:
                needed.unpersist()
        return self

    def predict(self, df: DataFrame, name: str = "prediction", model: GBTRegressionModel | None = None) -> DataFrame:
        model = model or self.model
        if model is None:
            raise ValueError("fit the model first")
        raw = model.transform(self.assembled(df))
        value = from_log("raw") if self.log else F.greatest(F.col("raw"), F.lit(0.0))
        return raw.withColumn(name, value).drop("raw", "features")

    def importance(self, spark) -> DataFrame:
        """Every feature with its share of the gain, unused ones with zero."""
        gains = self.model.featureImportances.toArray().tolist()  # of a model cut short, up to the last feature used
        pairs = sorted(zip(self.features, gains + [0.0] * (len(self.features) - len(gains)), strict=True), key=lambda x: (-x[1], x[0]))
        return spark.createDataFrame(pairs, "feature string, importance double")
