"""Evaluation metrics as aggregations over a label and a prediction column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPS = 1e-10
#: Probabilities are kept this far from 0 and 1 in log_loss.
CLIP = 1e-15

def _y():
    return F.col("y")


def _p():
    return F.col("p")


def _share(top, bottom):
    """top / bottom, and 0 where there is nothing to divide by."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def _count(condition):
    return F.sum(condition.cast("double"))


def _squares():
    return F.avg(F.pow(_y() - _p(), 2))


def _some(y_not_zero):
    return F.when(_y() != 0, y_not_zero)


def _positive(kind: str):
    hit, said, real = _count((_y() == 1) & (_p() == 1)), _count(_p() == 1), _count(_y() == 1)
    precision, recall = _share(hit, said), _share(hit, real)
    return {"precision": precision, "recall": recall, "f1": _share(2 * hit, said + real), "lift": _share(precision, _share(real, F.count(F.lit(1)).cast("double")))}[kind]


#: Metrics of one aggregation over y and p.
SIMPLE = {
    "mae": lambda: F.avg(F.abs(_y() - _p())),
    "mse": _squares,
    "rmse": lambda: F.sqrt(_squares()),
    "rmsle": lambda: F.sqrt(F.avg(F.pow(F.log1p(_y()) - F.log1p(_p()), 2))),
    "mape": lambda: F.avg(_some(F.abs((_y() - _p()) / _y()))),
    "smape": lambda: F.avg(_some(2 * F.abs(_y() - _p()) / (F.abs(_y()) + F.abs(_p()) + EPS))),
    "rmspe": lambda: F.sqrt(F.avg(_some(F.pow((_y() - _p()) / (_y() + EPS), 2)))),
    # The sum of squares about the mean in one pass, from the population variance.
    "r2": lambda: 1 - F.sum(F.pow(_y() - _p(), 2)) / (F.var_pop(_y()) * F.count(_y())),
    "log_loss": lambda: -F.avg(_y() * F.log(F.least(F.greatest(_p(), F.lit(CLIP)), F.lit(1 - CLIP))) + (1 - _y()) * F.log(1 - F.least(F.greatest(_p(), F.lit(CLIP)), F.lit(1 - CLIP)))),
    "accuracy": lambda: F.avg((_y() == _p()).cast("double")),
    **{k: (lambda k=k: _positive(k)) for k in ("precision", "recall", "f1", "lift")},
}
REGRESSION = ("mae", "mse", "rmse", "rmsle", "mape", "smape", "rmspe", "r2")
CLASSIFICATION = ("auc", "gini", "log_loss", "accuracy", "balanced_accuracy", "precision", "precision_weighted", "precision_macro", "recall", "recall_weighted", "recall_macro", "f1", "f1_weighted", "f1_macro", "lift")
NAMES = REGRESSION + CLASSIFICATION
LOWER_IS_BETTER = ("mae", "mse", "rmse", "rmsle", "mape", "smape", "rmspe", "log_loss")
_BY_CLASS = ("balanced_accuracy", *(f"{m}_{a}" for m in ("precision", "recall", "f1") for a in ("weighted", "macro")))


def _by_class(pairs: DataFrame) -> DataFrame:
    """The metrics that need each class, as one row: from the confusion matrix, which is all that leaves the first pass."""
    matrix = pairs.groupBy("y", "p").agg(F.count(F.lit(1)).cast("double").alias("n"))
    sides = matrix.select(F.explode(F.array(F.struct(F.col("y").alias("k"), F.col("n").alias("real"), F.lit(0.0).alias("said"), F.when(_y() == _p(), F.col("n")).otherwise(0.0).alias("hit")), F.struct(F.col("p").alias("k"), F.lit(0.0).alias("real"), F.col("n").alias("said"), F.lit(0.0).alias("hit")))).alias("x")).select("x.*")
    each = sides.groupBy("k").agg(*(F.sum(c).alias(c) for c in ("real", "said", "hit")))
    value = {"precision": _share(F.col("hit"), F.col("said")), "recall": _share(F.col("hit"), F.col("real")), "f1": _share(2 * F.col("hit"), F.col("said") + F.col("real"))}
    out = [F.avg(F.when(F.col("real") > 0, value["recall"])).alias("balanced_accuracy")]
    for name, v in value.items():
        out += [(F.sum(v * F.col("real")) / F.sum("real")).alias(f"{name}_weighted"), F.avg(v).alias(f"{name}_macro")]
    return each.agg(*out)


def _auc(pairs: DataFrame) -> DataFrame:
    """Area under the curve by mid-ranks. Counts by distinct score come first; then ranges of scores are summed each by itself
    and joined with the sums before them, so no task sees all scores."""
    scores = pairs.groupBy("p").agg(_count(_y() == 1).alias("pos"), _count(_y() != 1).alias("neg"))
    scores = scores.repartitionByRange("p").withColumn("part", F.spark_partition_id())
    from ..core import written

    scores = written(scores)
    size = scores.groupBy("part").agg(F.sum("neg").alias("s"))
    # A row for each partition.
    size = size.withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("part").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    wins = scores.withColumn("below", below).join(F.broadcast(size.select("part", "before")), "part")
    wins = wins.agg(F.sum(F.col("pos") * (F.col("below") + F.col("before") + F.col("neg") / 2)).alias("w"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    area = F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("w") / (F.col("pos") * F.col("neg")))
    return wins.select(area.alias("auc"), (2 * area - 1).alias("gini"))


def evaluate(df: DataFrame, label: str, prediction: str, metrics: list[str] | tuple[str, ...]) -> DataFrame:
    """One row with a column for each metric. Rows in which the label or prediction is missing count for none."""
    for m in metrics:
        if m not in NAMES:
            raise ValueError(f"no metric {m!r}; there are {', '.join(NAMES)}")
    pairs = df.select(F.col(label).cast("double").alias("y"), F.col(prediction).cast("double").alias("p")).filter("y is not null and p is not null and not isnan(y) and not isnan(p)")
    parts = []
    if simple := [m for m in metrics if m in SIMPLE]:
        parts.append(pairs.agg(*(SIMPLE[m]().alias(m) for m in simple)))
    if any(m in _BY_CLASS for m in metrics):
        parts.append(_by_class(pairs))
    if any(m in ("auc", "gini") for m in metrics):
        parts.append(_auc(pairs))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p), F.lit(True))  # one row each
    return out.select(*metrics)


def score(df: DataFrame, label: str, prediction: str, metric: str) -> float:
    return evaluate(df, label, prediction, [metric]).first()[0]


def optimization_metric(metric: str) -> str:
    """What is optimised for a metric, always to a minimum: itself for regression, but mse for r2; log_loss for classes."""
    return ("mse" if metric == "r2" else metric) if metric in REGRESSION else "log_loss"


def pruning_metric(metric: str, classes: int) -> str:
    if metric in REGRESSION:
        return {"mae": "l1", "mse": "l2", "rmse": "rmse", "mape": "mape"}.get(metric, "l2")
    return "binary_logloss" if classes == 2 else "multi_logloss"


def objective(metric: str, classes: int) -> str:
    return "regression" if metric in REGRESSION else "binary" if classes == 2 else "multiclass"


def direction(metric: str) -> str:
    return "lower-better" if metric in LOWER_IS_BETTER else "greater-better"


def eval_score(df: DataFrame, label: str, raw: str, metric: str, task: str) -> float:
    """A metric of raw predictions: binary ones are cut at 0.5 unless the metric takes probabilities; of a multiclass array of
    probabilities the place of the greatest counts, and log_loss takes that of the label."""
    if task == "binary" and metric not in ("auc", "gini", "log_loss"):
        df = df.withColumn(raw, (F.col(raw) > 0.5).cast("int"))
    elif task == "multiclass":
        p = F.col(raw)
        if metric == "log_loss":
            own = F.element_at(p, F.col(label).cast("int") + 1)
            return df.agg(-F.avg(F.log(F.least(F.greatest(own, F.lit(CLIP)), F.lit(1 - CLIP))))).first()[0]
        df = df.withColumn(raw, F.array_position(p, F.array_max(p)) - 1)
    return score(df, label, raw, metric)
