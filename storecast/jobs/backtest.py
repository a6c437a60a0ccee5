"""The sales model over folds, arms and seeds, so that arms can be accepted or not.

What all folds share is built once: the features that do not depend on training
rows, and every fold's statistics of each store as arrays with an entry per
fold. A fold's frame is a projection of that table. Each cell of the grid (arm,
seed, fold) is stored as soon as it is scored, so an interrupted run goes on
with the cells that are missing.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.experiment import grid
from ..operators.features import Features, Statistics, since_reopening, statistics
from ..operators.folds import FoldStatistics, fold_means
from ..operators.metrics import rmspe
from ..operators.segments import one_hot, segmenter
from ..operators.validation import RollingOrigin
from ..schema import LEARNED_FEATURES, feature_names
from ..sources.tables import dropped, exists, written
from .model import SalesModel, exact_metric_weight, hold, inner_split
from .pools import in_pools, side_by_side

CELL = "Store int, Date date, Sales long, prediction double, trees int, segment int"


@dataclass(frozen=True)
class Arm:
    """One way to model. ``families`` are the switches of :func:`~..schema.feature_names`; ``names`` replaces them by a list."""

    name: str
    families: dict = field(default_factory=dict)
    names: tuple[str, ...] = ()
    segmented: bool = True
    one_hot: bool = False
    since_reopening: bool = False
    exact_weights: bool = False
    params: dict = field(default_factory=dict)

    def features(self, n_segments: int) -> list[str]:
        own = list(self.names) or feature_names(**self.families)
        return own + ([f"segment_{k}" for k in range(1, n_segments + 1)] if self.one_hot else [])


@dataclass
class Backtest:
    """``path``: a folder that all executors share. ``options`` are those of :class:`SalesModel` for all arms.

    With ``inner`` each cell also stores the last days of its training rows,
    scored by a model of the same number of trees that did not see them
    (:meth:`inner_scored`): one fit more for each model.
    """

    path: str
    arms: list[Arm]
    seeds: list[int] = field(default_factory=lambda: [0])
    splitter: RollingOrigin = field(default_factory=RollingOrigin)
    params: dict = field(default_factory=dict)
    options: dict = field(default_factory=dict)
    n_segments: int = 4
    min_days: int = 365
    min_cell_stores: int = 15
    parallelism: int = 4
    inner: bool = False

    def __post_init__(self):
        if len({a.name for a in self.arms}) < len(self.arms) or not self.arms:
            raise ValueError("arms need names of their own")

    def _cell(self, arm: str, seed: int, fold: int, inner: bool = False) -> str:
        # A name is a folder: what paths give a meaning to is written as its number.
        own = "".join(c if c.isalnum() or c in " -_+" else f"%{ord(c):02X}" for c in arm)
        return f"{self.path.rstrip('/')}/{'inner/' if inner else ''}arm={own}/seed={seed}/fold={fold}"

    def _done(self, spark: SparkSession, arm: str, seed: int, fold: int) -> bool:
        return all(exists(spark, f"{self._cell(arm, seed, fold, inner)}/_SUCCESS") for inner in {False, self.inner})

    def missing(self, spark: SparkSession, n_folds: int) -> list[tuple[Arm, int, int]]:
        return [(a, s, f) for f in range(1, n_folds + 1) for a in self.arms for s in self.seeds if not self._done(spark, a.name, s, f)]

    def base(self, open_days: DataFrame, calendar: DataFrame, learned: FoldStatistics) -> DataFrame:
        """The rows that any fold trains on or is scored on, with all features but the learned ones, and these as arrays over the folds."""
        none = Statistics(*(open_days.sparkSession.createDataFrame([], s) for s in ("Store int, store_mean_sales double", "Store int, DayOfWeek int, store_dow_mean_sales double", "Store int, store_promo_uplift double")), None, None, None)
        rows = Features(none, calendar, with_reopening=True, month=True).transform(open_days).drop(*LEARNED_FEATURES)
        own = learned.by_store.select("Store", "means", "uplifts", "weekday_means")
        return rows.join(own, "Store", "left").withColumn("weekday_means", F.try_element_at("weekday_means", F.col("DayOfWeek").cast("int")))

    def frame(self, base: DataFrame, learned: FoldStatistics, fold: int) -> DataFrame:
        """The rows of a fold with role (train or valid) and what the fold has learnt."""
        f, at = learned.folds[fold - 1], F.lit(fold - 1)
        one = learned.overall.select(F.get("means", at).alias("mean"), F.get("uplifts", at).alias("uplift")).first()
        far = learned.distance.select(F.get("medians", at)).first()[0] if learned.distance is not None else None
        train, valid = F.col("Date") <= F.lit(f.train_end), F.col("Date").between(F.lit(f.valid_start), F.lit(f.valid_end))
        rows = base.filter(train | valid).withColumn("role", F.when(train, "train").otherwise("valid"))
        mean = F.coalesce(F.get("means", at), F.lit(one["mean"]))
        return rows.withColumns({
            "CompetitionDistance": F.coalesce("CompetitionDistance", F.lit(far).cast("double")), "store_mean_sales": mean,
            "store_dow_mean_sales": F.coalesce(F.get("weekday_means", at), mean), "store_promo_uplift": F.coalesce(F.get("uplifts", at), F.lit(one["uplift"])),
        }).drop("means", "uplifts", "weekday_means")

    def run(self, calendar: DataFrame) -> DataFrame:
        """The scored rows of all cells, from all days of all stores (closed ones kept). :func:`results` has their scores.

        Rows without sales are neither trained on nor scored. A row without a
        prediction, or a fold without rows, is an error, and its cell stays missing.
        """
        spark = calendar.sparkSession
        n_folds = self.splitter.n_splits
        todo = self.missing(spark, n_folds)
        if todo:
            # Stored before anything is asked of it: the calendar may cost much, and its open days are a filter of it.
            kept = [written(calendar, "calendar")]
            try:
                open_days = kept[0].filter("Open = 1 and Sales > 0")
                learned = fold_means(open_days, self.splitter.folds(open_days).orderBy("fold").collect())  # a row a fold
                # Computed once, not for every fold: a row a store, and single rows.
                learned.by_store, learned.overall = written(learned.by_store, "fold-statistics"), written(learned.overall, "fold-overall")
                kept += [learned.by_store, learned.overall]
                if learned.distance is not None:
                    learned.distance = written(learned.distance, "fold-distance")
                    kept.append(learned.distance)
                kept.append(written(self.base(open_days, kept[0], learned), "base"))
                for fold in sorted({f for *_, f in todo}):
                    self._fold(kept[-1], kept[0], learned, fold, [(a, s) for a, s, f in todo if f == fold])
            finally:
                for table in kept:
                    dropped(table)
        return self.scored(spark, n_folds)

    def _fold(self, base: DataFrame, calendar: DataFrame, learned: FoldStatistics, fold: int, cells: list[tuple[Arm, int]]) -> None:
        frame = self.frame(base, learned, fold)
        segments = None
        if any(a.segmented or a.one_hot for a, _ in cells):
            segments = segmenter(frame.filter("role = 'train'"), self.n_segments, self.min_days, self.min_cell_stores)
            frame = one_hot(segments.transform(frame), self.n_segments)
        used = ["Store", "Date", "Sales", "segment", "role", *(n for a, _ in cells for n in a.features(self.n_segments))]
        usual = frame.select(*(c for c in dict.fromkeys(used) if c in frame.columns))
        made: list[tuple[DataFrame, DataFrame]] = []
        try:
            # Rows that only some arms need are not made where none does.
            sides = {}
            if not all(a.since_reopening for a, _ in cells):
                made.append(self._sides(usual, fold, "fold"))
                sides[False] = made[-1]
            if any(a.since_reopening for a, _ in cells):
                own = statistics(since_reopening(frame.filter("role = 'train'"), calendar))
                whole = Statistics(own.by_store, own.by_weekday, own.uplift, *(learned.of_fold(fold).__getattribute__(n) for n in ("global_mean", "global_uplift", "comp_dist_median")))
                again = whole.join(frame.drop(*LEARNED_FEATURES))
                made.append(self._sides(again.select(*usual.columns), fold, "reopened"))
                sides[True] = made[-1]
            calls = {f"{a.name}-{s}-{fold}": partial(self._one, sides[a.since_reopening], a, s, fold) for a, s in cells}
            most = max(train.rdd.getNumPartitions() for train, _ in made)
            in_pools(base.sparkSession, calls, side_by_side(base.sparkSession, self.parallelism, most))
        finally:
            for train, valid in made:
                train.unpersist()
                dropped(valid)
            if segments is not None:
                segments.assignment.unpersist()

    def _sides(self, frame: DataFrame, fold: int, name: str) -> tuple[DataFrame, DataFrame]:
        """A fold's training rows, in memory for the fits of all its cells, and its few validation rows as a table."""
        valid = written(frame.filter("role = 'valid'").drop("role"), f"{name}-{fold}")
        train = frame.filter("role = 'train'").drop("role")
        train = hold(train, train.count())
        train.count()
        return train, valid

    def _one(self, frame: tuple[DataFrame, DataFrame], arm: Arm, seed: int, fold: int) -> None:
        """Fit, score and store one cell. ``frame``: training and validation rows, as :meth:`_sides` has them."""
        groups = range(1, self.n_segments + 1) if arm.segmented else [None]
        parts, cuts = [], []
        keep = lambda df, g, model: df.select("Store", "Date", "Sales", "prediction", F.lit(model.rounds).alias("trees"), F.lit(g).cast("int").alias("segment"))
        for g in groups:
            train, valid = frame if g is None else (side.filter(F.col("segment") == g) for side in frame)
            if train.isEmpty():
                continue
            own = dict(self.options)
            if arm.exact_weights:
                train, own = exact_metric_weight(train), {**own, "log": False, "weight": "weight"}
            # All rows as they are held; a part of them, or rows with a weight, are dealt anew.
            model = SalesModel(arm.features(self.n_segments), {**self.params, **arm.params}, seed, **own).fit(train, watch=self.inner, held=g is None and not arm.exact_weights)
            parts.append(keep(model.predict(valid), g, model))
            if self.inner:
                cuts.append(keep(model.predict(inner_split(train, model.inner_days)[1], model=model.watched), g, model))
        if not parts:
            raise ValueError(f"fold {fold} has no rows to train on")
        scored = reduce(DataFrame.unionByName, parts)
        rmspe(scored)  # raises where a prediction is missing
        if cuts:
            reduce(DataFrame.unionByName, cuts).write.mode("overwrite").parquet(self._cell(arm.name, seed, fold, inner=True))
        scored.write.mode("overwrite").parquet(self._cell(arm.name, seed, fold))

    def inner_scored(self, spark: SparkSession, n_folds: int) -> DataFrame:
        """arm, seed, fold and the scored rows of the stored cells' inner cuts."""
        return self.scored(spark, n_folds, inner=True)

    def scored(self, spark: SparkSession, n_folds: int, inner: bool = False) -> DataFrame:
        """arm, seed, fold and the scored rows of the cells that are stored. A model of all segments has a null segment."""
        own = [(a.name, s, f) for a in self.arms for s in self.seeds for f in range(1, n_folds + 1) if self._done(spark, a.name, s, f)]
        read = lambda a, s, f: spark.read.schema(CELL).parquet(self._cell(a, s, f, inner)).select(F.lit(a).alias("arm"), F.lit(s).alias("seed"), F.lit(f).alias("fold"), "*")
        return reduce(DataFrame.unionByName, (read(*x) for x in own)) if own else spark.createDataFrame([], f"arm string, seed int, fold int, {CELL}")


def results(scored: DataFrame) -> DataFrame:
    """arm, seed, fold, rmspe, rows: what :func:`~..operators.experiment.accepted` and its like take."""
    return grid(scored).join(scored.groupBy("arm", "seed", "fold").agg(F.count("*").alias("rows")), ["arm", "seed", "fold"])
