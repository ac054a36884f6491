"""Feature selection: recursive elimination scored by cross-validation, by a linear or a forest model or the better of both."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import flag, hash_fold, order_key, require_columns, require_frame, written


def standardized(df: DataFrame, names: list[str]) -> DataFrame:
    """(x - mean) / population standard deviation; a constant column becomes 0. One pass for all columns."""
    row = df.agg(*(f(F.col(f"`{n}`").cast("double")) for n in names for f in (F.avg, F.stddev_pop))).first()
    of = {n: (row[2 * k], row[2 * k + 1]) for k, n in enumerate(names)}
    return df.select(*(((F.col(f"`{c}`") - F.lit(of[c][0])) / F.lit(of[c][1] or 1.0)).alias(c) if c in of and of[c][0] is not None else F.col(f"`{c}`") for c in df.columns))


def cleaned(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns as floats; rows with a missing or infinite value go."""
    cast = df.select(*(F.col(f"`{c}`").cast("float").alias(c) if c in names else F.col(f"`{c}`") for c in df.columns))
    good = [(~F.isnan(f"`{n}`")) & (F.abs(F.col(f"`{n}`")) != float("inf")) & F.col(f"`{n}`").isNotNull() for n in names]
    for g in good:
        cast = cast.filter(g)
    return cast


def choose(results: dict[str, dict], allowed_score_gap: float = 0.0) -> str:
    """The name of the better of two results {score, features}: the higher score; or, within the allowed relative gap, the one of
    strictly fewer features. Equal scores: fewer features."""
    a, b = results
    fewer = min(results, key=lambda k: len(results[k]["features"]))
    if results[a]["score"] == results[b]["score"]:
        return fewer
    high = max(results, key=lambda k: results[k]["score"])
    low = b if high == a else a
    gap = abs(results[low]["score"] / results[high]["score"] - 1) if results[high]["score"] else float("inf")
    return low if allowed_score_gap and gap < allowed_score_gap and len(results[low]["features"]) < len(results[high]["features"]) else high


class FeatureSelector:
    """fit_transform(df, target) keeps the features of the best elimination step; transform(df) projects them.

    objective regression or classification; auto compares a linear and a forest model by a third. Elimination drops `step`
    features a time down to min_features_to_select, each set scored over cv folds. Rows beyond subset_size_mb are
    left out by the key's hash while selecting.
    """

    def __init__(self, objective: str = "regression", auto: bool = False, allowed_score_gap: float = 0.0, final_scoring_model=None, default_model: str = "linear", subset_size_mb: float = 20, min_features_to_select: int = 5, step: int = 1, cv: int = 2, random_state: int = 42):
        if objective not in ("regression", "classification"):
            raise ValueError("objective is regression or classification")
        self.objective, self.auto, self.gap = objective, flag(auto, "auto", False), allowed_score_gap
        if not 0 <= allowed_score_gap < 1:
            raise ValueError("allowed_score_gap lies in 0 to 1")
        self.model, self.final, self.mb = default_model, final_scoring_model, subset_size_mb
        self.least, self.step, self.cv, self.seed = min_features_to_select, step, cv, random_state
        self.selected_features: list[str] | None = None

    def scoring(self, classes: int) -> str:
        return "neg_root_mean_squared_error" if self.objective == "regression" else "roc_auc" if classes == 2 else "neg_log_loss"

    def _estimator(self, kind: str):
        common = {"featuresCol": "x", "labelCol": "y", "predictionCol": "p"}
        regression = self.objective == "regression"
        if kind == "linear":
            return LinearRegression(regParam=1.0, elasticNetParam=0.0, **common) if regression else LogisticRegression(maxIter=1000, **common)
        if kind == "forest":
            return (RandomForestRegressor if regression else RandomForestClassifier)(numTrees=50, maxDepth=2, seed=self.seed, **common)
        if kind == "final":
            if self.final is not None:
                return self.final
            if regression:
                return GBTRegressor(maxIter=10, maxDepth=3, seed=self.seed, **common)
            return GBTClassifier(maxIter=10, maxDepth=3, seed=self.seed, **common) if self.classes == 2 else RandomForestClassifier(numTrees=50, maxDepth=5, seed=self.seed, **common)
        raise ValueError("a model is linear or forest")

    def _evaluator(self):
        if self.objective == "regression":
            return RegressionEvaluator(labelCol="y", predictionCol="p", metricName="rmse"), -1
        if self.classes == 2:
            return BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="rawPrediction"), 1
        return MulticlassClassificationEvaluator(labelCol="y", probabilityCol="probability", metricName="logLoss"), -1

    def _assembled(self, df: DataFrame, features: list[str]) -> DataFrame:
        return VectorAssembler(inputCols=features, outputCol="x").transform(df).select("x", "y", "fold")

    def _fitted(self, df: DataFrame, features: list[str], kind: str, folds: int, k: int | None):
        """A model of the rows outside fold k, and its score on fold k; k None: of all rows, without a score."""
        data = self._assembled(df, features)
        if k is None:
            return self._estimator(kind).fit(data), None
        evaluator, sign = self._evaluator()
        fold = F.pmod(F.col("fold"), F.lit(folds)) == k
        model = self._estimator(kind).fit(data.filter(~fold))
        return model, sign * evaluator.evaluate(model.transform(data.filter(fold)))

    def _scored(self, df: DataFrame, features: list[str], kind: str, folds: int) -> float:
        return sum(self._fitted(df, features, kind, folds, k)[1] for k in range(folds)) / folds

    def _weights(self, model, kind: str) -> list[float]:
        if kind == "forest":
            return model.featureImportances.toArray().tolist()
        if self.objective == "regression":
            return [abs(v) for v in model.coefficients.toArray()]
        return abs(model.coefficientMatrix.toArray()).sum(0).tolist()

    def _ranked(self, df: DataFrame, features: list[str], kind: str, least: int, k: int | None) -> list[tuple[list[str], float | None]]:
        """The sets of an elimination down to `least` features, ranked by rows outside fold k alone, each with its score there."""
        left, out = list(features), []
        while True:
            model, score = self._fitted(df, left, kind, self.cv, k)
            out.append((left, score))
            if len(left) <= least:
                return out
            weight = dict(zip(left, self._weights(model, kind)))
            drop = set(sorted(left, key=lambda f: weight[f])[: min(self.step, len(left) - least)])
            left = [f for f in left if f not in drop]

    def _eliminated(self, df: DataFrame, features: list[str], kind: str) -> dict:
        """Each fold eliminates by its own training rows; the number of features with the best mean score, the fewest on ties,
        is what an elimination by all rows then goes down to."""
        least = max(1, min(self.least, len(features)))
        total: dict[int, float] = {}
        for k in range(self.cv):
            for left, score in self._ranked(df, features, kind, least, k):
                total[len(left)] = total.get(len(left), 0.0) + score / self.cv
        number = max(total, key=lambda n: (total[n], -n))
        return {"score": total[number], "features": self._ranked(df, features, kind, number, None)[-1][0]}

    def fit_transform(self, df: DataFrame, target: str, key: str | None = None) -> DataFrame:
        require_frame(df)
        require_columns(df, target)
        rows, key_ = order_key(df, key)
        features = [c for c in df.columns if c not in (target, key)]
        rows = cleaned(rows.select(*features, F.col(target).cast("double").alias("y"), hash_fold(key_, 60, self.seed).alias("fold"), hash_fold(key_, 1_000_000, self.seed + 1).alias("draw")), [*features, "y"])
        n = rows.count()
        size = n * 4 * (len(features) + 1) / 1e6
        if size > self.mb:
            rows = rows.filter(F.col("draw") < int(1_000_000 * self.mb / size))
        rows = written(rows.drop("draw"))
        self.classes = rows.agg(F.count_distinct("y")).first()[0]
        scaled = standardized(rows, features)
        if self.auto:
            found = {kind: self._eliminated(scaled if kind == "linear" else rows, features, kind) for kind in ("linear", "forest")}
            for r in found.values():
                r["score"] = self._scored(rows, r["features"], "final", 3)
            self.results = found
            self.selected_features = found[choose(found, self.gap)]["features"]
        else:
            self.selected_features = self._eliminated(scaled if self.model == "linear" else rows, features, self.model)["features"]
        return self.transform(df)

    def transform(self, df: DataFrame) -> DataFrame:
        if self.selected_features is None:
            raise ValueError("fit_transform() comes first")
        require_columns(df, *self.selected_features)
        return df.select(*(F.col(f"`{c}`") for c in self.selected_features))
