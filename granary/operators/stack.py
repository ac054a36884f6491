"""Stacked models: out-of-fold predictions as features, and features made of them."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import hash_fold, order_key, require_columns, spread, written


def meta_features(df: DataFrame, names: list[str]) -> DataFrame:
    """Pairwise differences, and the mean and sample standard deviation of each row."""
    require_columns(df, *names)
    c = {n: F.col(f"`{n}`").cast("double") for n in names}
    mean = reduce(lambda a, b: a + b, c.values()) / len(names)
    spread = F.sqrt(reduce(lambda a, b: a + b, (F.pow(v - mean, 2) for v in c.values())) / (len(names) - 1)) if len(names) > 1 else F.lit(None).cast("double")
    return df.select("*", *((c[a] - c[b]).alias(f"{a}_minus_{b}") for a, b in combinations(names, 2)), spread.alias("row_std"), mean.alias("row_mean"))


def random_settings(estimator, ranges: dict[str, tuple], trials: int, seed: int = 1) -> list[dict]:
    """`trials` draws of an estimator's settings: ("int", low, high), ("uniform", low, high), ("log", low, high) or ("choice", *values)."""
    import numpy as np

    from .tuner import sampled

    rng = np.random.default_rng(seed)
    return [{estimator.getParam(n): v for n, v in sampled(ranges, rng).items()} for _ in range(trials)]


def best_setting(estimator, settings: list[dict], df: DataFrame, evaluator, folds: int = 3, seed: int = 1):
    """The setting of the best mean score over folds, and all scores; df has a label, features and a column `fold` of 60 or so."""
    sign = 1 if evaluator.isLargerBetter() else -1
    scores = []
    for setting in settings:
        total = 0.0
        for k in range(folds):
            fold = F.pmod(F.col("fold"), F.lit(folds)) == k
            total += evaluator.evaluate(estimator.fit(df.filter(~fold), setting).transform(df.filter(fold))) / folds
        scores.append(total)
    return settings[max(range(len(settings)), key=lambda i: (sign * scores[i], -i))], scores


def parameter_grid(estimator, **values) -> list[dict]:
    """Every combination of the listed values of an estimator's settings."""
    grid = ParamGridBuilder()
    for name, v in values.items():
        grid = grid.addGrid(estimator.getParam(name), v)
    return grid.build()


class Stacker:
    """Layers of models: training rows get out-of-fold predictions, other rows the mean of the folds' models (for more than two
    classes their vote). A layer learns from what the one before it made, at depth 3 and 4 from what all before it made;
    include_x adds the columns of the start. metafeats, on from depth 2 unless set, adds features made of a layer's."""

    def __init__(self, objective: str = "regression", layers: list[list] | None = None, folds: int = 4, depth: int = 1, include_x: bool = False, seed: int = 1, metafeats: bool | None = None):
        if objective not in ("regression", "binary", "multiclass"):
            raise ValueError("objective is regression, binary or multiclass")
        if isinstance(depth, bool) or depth not in (1, 2, 3, 4):
            raise ValueError("depth is 1 to 4")
        self.objective, self.folds, self.depth, self.include_x, self.seed = objective, folds, depth, include_x, seed
        self.metafeats = depth > 1 if metafeats is None else metafeats
        common = {"featuresCol": "x", "labelCol": "y", "predictionCol": "p"}
        if layers is None:
            if objective == "regression":
                layers = [[LinearRegression(**common), RandomForestRegressor(numTrees=20, seed=seed, **common), GBTRegressor(maxIter=10, seed=seed, **common)]]
            else:
                layers = [[LogisticRegression(**common), RandomForestClassifier(numTrees=20, seed=seed, **common), *([GBTClassifier(maxIter=10, seed=seed, **common)] if objective == "binary" else [])]]
        self.layers = layers

    def _value(self, model, df: DataFrame):
        out = model.transform(df)
        return out.withColumn("v", vector_to_array("probability")[1] if self.objective == "binary" else F.col("p"))

    def fit_transform(self, df: DataFrame, target: str, key: str | None = None) -> DataFrame:
        rows, key_ = order_key(df, key)
        self.features = [c for c in df.columns if c not in (target, key)]
        data = written(rows.select(F.col(key_).alias("k"), *self.features, F.col(target).cast("double").alias("y"), hash_fold(key_, self.folds, self.seed).alias("fold")))
        names, self.models, all_made, n = self.features, [], [], data.count()
        for number, layer in enumerate(self.layers):
            # Every fit of the layer reads these rows several times.
            data = held = spread(data, "k", n).persist()
            ready = VectorAssembler(inputCols=names, outputCol="x", handleInvalid="keep").transform(data)
            made, fitted = [], []
            for m, estimator in enumerate(layer):
                name = f"layer{number}_{m}"
                models = [estimator.fit(ready.filter(F.col("fold") != k)) for k in range(self.folds)]
                made.append(name)
                fitted.append(models)
            # All models' columns in one projection; each row takes that of its own fold's model, which hasn't seen it.
            for name, models in zip(made, fitted):
                ready = self._columns(ready, models)
                own = F.coalesce(*(F.when(F.col("fold") == k, F.col(f"__v{k}")) for k in range(self.folds)))
                ready = ready.withColumn(name, own).drop(*(f"__v{k}" for k in range(self.folds)))
            data = ready.drop("x")
            new = list(made)
            if self.metafeats and len(made) > 1:
                before, data = data.columns, self._metas(data, made, number)
                new += [c for c in data.columns if c not in before]
            data = written(data)
            held.unpersist()
            all_made.append(new)
            self.models.append((names, fitted, made))
            names = [*(self.features if self.include_x else []), *(all_made[-1] if self.depth < 3 else [c for x in all_made for c in x])]
        self.names = names
        return data.select(F.col("k").alias(key) if key else F.col("k"), *names, "y")

    def _metas(self, data: DataFrame, made: list[str], number: int) -> DataFrame:
        """The meta features of a layer; from the second layer on, those of the whole row bear its number."""
        kept = {c: f"__kept_{c}" for c in ("row_std", "row_mean") if c in data.columns}
        out = meta_features(data.withColumnsRenamed(kept), made)
        own = {c: f"layer{number}_{c}" for c in ("row_std", "row_mean")} if number else {}
        return out.withColumnsRenamed(own).withColumnsRenamed({v: k for k, v in kept.items()})

    def _columns(self, ready: DataFrame, models: list) -> DataFrame:
        for k, model in enumerate(models):
            ready = self._value(model, ready).withColumnRenamed("v", f"__v{k}").drop("p", "probability", "rawPrediction")
        return ready

    def transform(self, df: DataFrame) -> DataFrame:
        data = df
        for number, (names, fitted, made) in enumerate(self.models):
            ready = VectorAssembler(inputCols=names, outputCol="x", handleInvalid="keep").transform(data)
            for name, models in zip(made, fitted):
                ready = self._columns(ready, models)
                vs = [F.col(f"__v{k}") for k in range(len(models))]
                if self.objective == "multiclass":
                    votes = F.array(*vs)
                    count = lambda v: F.size(F.filter(votes, lambda x: x == v))
                    value = F.element_at(F.array_sort(F.transform(votes, lambda v: F.struct((-count(v)).alias("n"), v.alias("v")))), 1)["v"]
                else:
                    value = reduce(lambda a, b: a + b, vs) / len(vs)
                ready = ready.withColumn(name, value).drop(*(f"__v{k}" for k in range(len(models))))
            data = ready.drop("x")
            if self.metafeats and len(made) > 1:
                data = self._metas(data, made, number)
        return data.select(*(c for c in df.columns if c not in self.names), *self.names)
