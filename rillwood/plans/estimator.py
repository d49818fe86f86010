"""Learners by name, with fit, predict and transform."""

from __future__ import annotations

import math
from dataclasses import replace
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwood.errors import RillwoodError
from rillwood.operators.profile import CATEGORIC, NUMERIC
from rillwood.sources.work import written

from . import forest as FO
from .model import Forest
from .online import OnlineParams, collect_forest, train_online
from .parallel import grow

KINDS = [f"{m}_{t}" for m in ("hoeffding", "hoeffding_extra", "rf", "rf_extra") for t in ("classifier", "regressor")]


class Learner(Protocol):
    """What every learner can do; others may take a learner's place."""

    def fit(self, df: DataFrame, key: str, numeric: list[str], categoric: list[str], target: str) -> Learner: ...
    def predict(self, df: DataFrame, full: bool = False) -> DataFrame: ...
    def transform(self, df: DataFrame) -> DataFrame: ...
    def importances(self, k: int = -1) -> DataFrame: ...
    def stats(self, df: DataFrame) -> DataFrame: ...
    def info(self) -> dict: ...


class TreeLearner:
    """One online Hoeffding tree, or a forest trained level by level. A Hoeffding tree looks at each event, in one task; with
    ``parallel`` all tasks grow it in micro-batches."""

    def __init__(self, kind: str, parallel: bool = False, **params):
        if kind not in KINDS:
            raise RillwoodError(f"no learner {kind!r}; there are {', '.join(KINDS)}")
        self.kind, self.regression, extra = kind, kind.endswith("regressor"), "_extra" in kind
        self.online, self.parallel = kind.startswith("hoeffding"), parallel
        self.params = replace(OnlineParams(extra=extra), **params) if self.online else replace(FO.Params(extra=extra), **params)
        self.model: Forest | None = None
        self.spark = None

    def fit(self, df: DataFrame, key: str, numeric: list[str], categoric: list[str], target: str) -> TreeLearner:
        self.spark = df.sparkSession
        if self.online and self.parallel:
            self.model = grow(df, key, numeric, categoric, target, self.regression, 1, self.params).forest()
        elif self.online:
            state = train_online(df, key, numeric, categoric, target, self.regression, 1, self.params)
            self.model = collect_forest(state, target, numeric, categoric, self.regression)
        else:
            self.model = FO.ForestTrainer(self.params).fit(df, key, numeric, categoric, target, self.regression)
        return self

    def predict(self, df: DataFrame, full: bool = False) -> DataFrame:
        return FO.predict(df, self.model, full and not self.regression)

    def transform(self, df: DataFrame) -> DataFrame:
        return FO.embed(df, self.model)

    def importances(self, k: int = -1) -> DataFrame:
        return FO.related_fields(self.spark, self.model, k)

    def stats(self, df: DataFrame) -> DataFrame:
        return FO.evaluate(df, self.model)

    def info(self) -> dict:
        return {"kind": self.kind, **self.model.info()}


def make_learner(kind: str, parallel: bool = False, **params) -> TreeLearner:
    return TreeLearner(kind, parallel, **params)


def learner_for(target_type: str) -> str:
    """The learner that suits a target's type."""
    if target_type not in (CATEGORIC, NUMERIC):
        raise RillwoodError(f"a {target_type} attribute can't be a target")
    return "rf_classifier" if target_type == CATEGORIC else "rf_regressor"


class Classifier(TreeLearner):
    def __init__(self, **params):
        super().__init__("rf_classifier", **params)


class Regressor(TreeLearner):
    def __init__(self, **params):
        super().__init__("rf_regressor", **params)


#: Distinct rows of numbers in a task of k-means, which keeps them in memory.
POINTS = 1 << 18


class Clusterer:
    """k-means over numeric columns; rows with a missing value have no cluster.

    Rows alike are one point with their number as its weight, so that k-means holds distinct points only. Points are dealt by
    their values, at most some ``POINTS`` to a task, in order: how the table was cut doesn't matter to the clusters.
    """

    def __init__(self, k: int = 8, seed: int = 42):
        self.k, self.seed, self.model, self.columns = k, seed, None, []

    def fit(self, df: DataFrame, numeric: list[str]) -> Clusterer:
        from pyspark.ml.clustering import KMeans

        self.columns = numeric
        names = [f"`{c}`" for c in numeric]
        points = written(df.groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias("_w")), "points")
        dealt = points.repartition(max(1, math.ceil(points.count() / POINTS)), *names).sortWithinPartitions(*names)
        self.model = KMeans(k=self.k, seed=self.seed, featuresCol="_v", predictionCol="prediction", weightCol="_w").fit(self._vectors(dealt))
        return self

    def _vectors(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        return VectorAssembler(inputCols=self.columns, outputCol="_v", handleInvalid="skip").transform(df)

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self._vectors(df)).drop("_v")
