"""One model per segment, with intervals; fit, predict, save and load."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date
from functools import partial, reduce

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.baseline import median_rule
from ..operators.calendar import check_neighbours, compact, extended
from ..operators.features import Features, Statistics, statistics
from ..operators.metrics import rmspe
from ..operators.monitor import interval_quantiles, sales_ratios, with_interval
from ..operators.segments import Segmenter, segmenter
from ..schema import HOLIDAY_CAP, HORIZON, LONG_CLOSURE, REOPENING_CAP
from ..sources import versions
from ..sources.tables import tasks
from .model import SalesModel, exact_metric_weight, inner_split
from .pools import in_pools, side_by_side


@dataclass
class Forecaster:
    seeds: list[int] = field(default_factory=lambda: [0])
    params: dict = field(default_factory=dict)
    n_segments: int = 4
    min_days: int = 365
    min_cell_stores: int = 15
    parallelism: int = 4
    options: dict = field(default_factory=dict)
    #: Feature families that differ from the usual ones, by the names of schema.FAMILIES.
    families: dict = field(default_factory=dict)
    #: Learned statistics from the rows since a store's newest reopening, where these are enough.
    since_reopening: bool = False
    #: Raw sales with weights that make squared error the squared relative error.
    exact_weights: bool = False
    features: Features | None = None
    segments: Segmenter | None = None
    models: dict[int, list[SalesModel]] = field(default_factory=dict)
    ratios: DataFrame | None = None
    card: dict = field(default_factory=dict)

    def _fit_segment(self, frame: DataFrame, segment: int) -> tuple[list[SalesModel], DataFrame] | None:
        """The segment's models by seed, and its last days scored by the first seed's model that did not see them."""
        rows = frame.filter(F.col("segment") == segment)
        if rows.isEmpty():
            return None
        if self.exact_weights:
            rows = exact_metric_weight(rows)
        first = SalesModel(self.features.names, self.params, self.seeds[0], **self.options).fit(rows, watch=True)
        later = {**self.options, "fixed_rounds": first.rounds, "refit": True}
        more = [SalesModel(self.features.names, self.params, seed, **later).fit(rows) for seed in self.seeds[1:]]
        _, new = inner_split(rows, first.inner_days)
        return [first, *more], first.predict(new, model=first.watched).select("segment", "Sales", "prediction")

    def fit(self, train: DataFrame, calendar: DataFrame, **model_options) -> Forecaster:
        """From open days and the calendar with closed ones.

        Each segment is a distributed fit of its own, ``parallelism`` of them at
        a time; no segment goes to one task. ``model_options`` are those of
        :class:`SalesModel`.
        """
        self.options = {**model_options, **({"log": False, "weight": "weight"} if self.exact_weights else {})}
        self.features = Features.of(statistics(train, calendar if self.since_reopening else None), compact(calendar), self.families)
        self.segments = segmenter(train, self.n_segments, self.min_days, self.min_cell_stores)
        kept = dict.fromkeys(["Store", "Date", "Sales", "segment", *self.features.names])
        frame = self.segments.transform(self.features.transform(train)).select(*kept).persist()
        # Computed once, by all cores, before the segments ask for it side by side.
        spark, rows = train.sparkSession, frame.count()
        at_once = side_by_side(spark, self.parallelism, tasks(spark, rows // self.n_segments, spark.sparkContext.defaultParallelism))
        numbers = range(1, self.n_segments + 1)
        found = in_pools(spark, {f"segment-{s}": partial(self._fit_segment, frame, s) for s in numbers}, at_once)
        fitted = {s: x for s, x in zip(numbers, found.values(), strict=True) if x}
        self.models = {s: models for s, (models, _) in fitted.items()}
        self.ratios = sales_ratios(reduce(DataFrame.unionByName, [scored for _, scored in fitted.values()])).persist()
        self.ratios.count()
        low, high, n, stores = frame.agg(F.min("Date"), F.max("Date"), F.count("*"), F.count_distinct("Store")).first()
        self.card = {
            "train_start": str(low), "train_end": str(high), "train_rows": n, "stores": stores, "features": self.features.names, "seeds": self.seeds, "params": self.params,
            "trees_per_segment": {s: m[0].rounds for s, m in self.models.items()}, "interval_source": "last days of training", "model_options": self.options,
            "families": self.families, "since_reopening": self.since_reopening, "exact_weights": self.exact_weights,
            "stores_per_segment": {r["segment"]: r["count"] for r in self.segments.assignment.groupBy("segment").count().collect()},
        }
        frame.unpersist()
        return self

    def predict(self, rows: DataFrame, planned: DataFrame | None = None, interval: float | None = None, strict: bool = True) -> DataFrame:
        """The request with a prediction (zero on closed days), and with ``interval`` the low and high that held that share of the last days of training.

        ``planned`` are the days to come of the request's stores; without it
        the request itself is the plan. A row in neither calendar nor plan is
        an error, and unless ``strict`` is off one without a day before too.
        """
        if not self.models:
            raise ValueError("fit the forecaster first")
        known = self.features.calendar
        # A reopening within the cap has its closed stretch within the cap and the stretch's least length.
        context = REOPENING_CAP + LONG_CLOSURE if self.features.with_reopening else HOLIDAY_CAP
        whole = extended(known, planned if planned is not None else rows, context, request=rows)
        if strict:
            check_neighbours(rows, whole, date.fromisoformat(self.card["train_end"]))
        built = replace(self.features, calendar=whole).transform(rows, validate=planned is not None)
        parts = []
        frame = self.segments.transform(built)
        for s, models in self.models.items():
            out = frame.filter(F.col("segment") == s)
            for k, m in enumerate(models):
                out = m.predict(out, f"p_{k}")
            mean = sum((F.col(f"p_{k}") for k in range(len(models))), F.lit(0.0)) / len(models)
            parts.append(out.withColumn("prediction", F.when(F.col("Open") == 0, 0.0).otherwise(mean)))
        scored = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        scored = with_interval(scored, interval_quantiles(self.ratios, (1 - interval) / 2)) if interval else scored
        own = [*rows.columns, "prediction", *(["low", "high"] if interval else [])]
        return scored.select(*own)

    def save(self, path: str, **extra) -> None:
        """Models, side tables and one JSON card as a version of their own: a reader has the old model until the new one is whole."""
        spark = self.ratios.sparkSession
        folder = versions.new_folder(path)
        learned = self.features.learned
        tables = {"by_store": learned.by_store, "by_weekday": learned.by_weekday, "uplift": learned.uplift, "calendar": self.features.calendar, "assignment": self.segments.assignment, "ratios": self.ratios}
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}")
        for s, models in self.models.items():
            for k, m in enumerate(models):
                m.model.save(f"{folder}/model-{s}-{k}")
        scalars = {n: getattr(learned, n) for n in ("global_mean", "global_uplift", "comp_dist_median")}
        card = {**self.card, **extra, "scalars": scalars, "default_segment": self.segments.default, "n_models": len(self.seeds)}
        versions.commit(spark, path, folder, {"card": card})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forecaster:
        """The newest whole version under ``path``."""
        manifest = versions.latest(spark, path)
        if manifest is None:
            raise ValueError(f"no saved forecaster in {path}")
        card, folder = manifest["card"], manifest["folder"]
        read = lambda n: spark.read.parquet(f"{folder}/{n}")
        learned = Statistics(read("by_store"), read("by_weekday"), read("uplift"), **card["scalars"])
        out = cls(seeds=card["seeds"], params=card["params"], options=card["model_options"], card=card, ratios=read("ratios"))
        out.families, out.since_reopening, out.exact_weights = card["families"], card["since_reopening"], card["exact_weights"]
        out.features = Features.of(learned, read("calendar"), out.families)
        out.segments = Segmenter(read("assignment"), card["default_segment"])
        for s, trees in card["trees_per_segment"].items():
            out.models[int(s)] = [SalesModel(card["features"], card["params"], seed, **{**out.options, "fixed_rounds": trees}, rounds=trees, model=GBTRegressionModel.load(f"{folder}/model-{s}-{k}")) for k, seed in enumerate(out.seeds)]
        return out


def rank_settings(train: DataFrame, features: list[str], settings: dict[str, dict], **options) -> DataFrame:
    """Settings by their score on the inner window, best first. For every segment's own ranking: :func:`settings_by_segment`."""
    _, new = inner_split(train, options.get("inner_days", HORIZON))
    rows = []
    for name, params in settings.items():
        model = SalesModel(features, params, **{**options, "refit": False}).fit(train)
        rows.append((name, model.rounds, rmspe(model.predict(new))))
    return train.sparkSession.createDataFrame(rows, "setting string, trees int, rmspe double").orderBy("rmspe", "setting")


def settings_by_segment(frame: DataFrame, features: list[str], settings: dict[str, dict], parallelism: int = 4, **options) -> DataFrame:
    """segment, place, setting, trees, rmspe: the settings ranked within each segment of ``frame``.

    Segments and settings are fits side by side; a segment whose days are too few for an inner window is an error.
    """
    segments = [r.segment for r in frame.select("segment").distinct().orderBy("segment").collect()]  # as many as there are segments
    calls = {f"{s}|{name}": partial(rank_settings, frame.filter(F.col("segment") == s), features, {name: params}, **options) for s in segments for name, params in settings.items()}
    found = in_pools(frame.sparkSession, calls, parallelism)
    rows = [(int(key.split("|")[0]), *r) for key, df in found.items() for r in df.collect()]
    ranked = frame.sparkSession.createDataFrame(rows, "segment int, setting string, trees int, rmspe double")
    place = F.row_number().over(W.partitionBy("segment").orderBy("rmspe", "setting"))
    return ranked.select("segment", place.alias("place"), "setting", "trees", "rmspe")


def feature_arms(train: DataFrame, valid: DataFrame, arms: dict[str, list[str]], seeds: list[int], params: dict, **options) -> DataFrame:
    """Validation rows scored by one model per arm and seed: input of the acceptance rule."""
    parts = []
    for arm, names in arms.items():
        for seed in seeds:
            out = SalesModel(names, params, seed, **options).fit(train).predict(valid)
            parts.append(out.select("Store", "Date", "Sales", "prediction", F.lit(arm).alias("arm"), F.lit(seed).alias("seed")))
    return reduce(DataFrame.unionByName, parts)


def global_and_segmented(forecaster: Forecaster, train: DataFrame, valid: DataFrame, **options) -> DataFrame:
    """The validation rows with the fitted forecaster's prediction and, as pred_global, that of one model of all segments' rows."""
    features = forecaster.features
    whole = SalesModel(features.names, forecaster.params, forecaster.seeds[0], **options).fit(features.transform(train))
    both = whole.predict(features.transform(valid), "pred_global").select("Store", "Date", "pred_global")
    return forecaster.predict(valid, strict=False).join(both, ["Store", "Date"])


def overfit_check(forecaster: Forecaster, train: DataFrame, hidden: DataFrame) -> DataFrame:
    """Two rows, train and hidden: the forecaster's score and the median rule's, both learnt from ``train``."""
    rows = [(name, rmspe(forecaster.predict(part, strict=False)), rmspe(median_rule(train, part, store_level=False))) for name, part in (("train", train), ("hidden", hidden))]
    return train.sparkSession.createDataFrame(rows, "days string, model double, median_rule double")
