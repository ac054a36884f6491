"""Decision thresholds for binary scores: one histogram by threshold, then sums from the top."""

from __future__ import annotations

import inspect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import require_columns, require_frame

#: Scores that a sweep can rank by, from the four counts of a threshold.
LOSSES = ("accuracy", "balanced_accuracy", "precision", "recall", "f1", "lift")

#: Thresholds whose own scores are aggregated in one pass.
OWN = 50


def _div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def _score(name: str) -> Column:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = _div(tp, tp + fp), _div(tp, tp + fn)
    sides = F.when(tp + fn == 0, _div(tn, tn + fp)).when(tn + fp == 0, recall).otherwise((recall + _div(tn, tn + fp)) / 2)
    return {"accuracy": _div(tp + tn, tp + fp + fn + tn), "balanced_accuracy": sides, "precision": precision, "recall": recall, "f1": _div(2 * tp, 2 * tp + fp + fn), "lift": _div(precision, _div(tp + fn, tp + fp + fn + tn))}[name]


class ThreshTuner:
    """Scores `n_thresholds` evenly spaced thresholds between the least and the greatest prediction, or between bounds.

    Rows fall into the last threshold that they reach; the counts above each threshold are sums of those bins, so the
    data is read once for its range and once for the bins, however many thresholds there are.
    """

    def __init__(self, n_thresholds: int = 1000, min_threshold: float | None = None, max_threshold: float | None = None, auto_bounds: bool = False):
        if isinstance(n_thresholds, bool) or not isinstance(n_thresholds, int) or n_thresholds < 1:
            raise ValueError("n_thresholds must be a positive integer")
        self.n, self.low, self.high, self.auto = n_thresholds, min_threshold, max_threshold, auto_bounds

    def fit(self, df: DataFrame, label: str, prediction: str, loss_func: str | None = None) -> DataFrame:
        """threshold, score, fraction_of_1 for each threshold that calls some row positive. loss_func: one of LOSSES, a function
        of the count columns tp, fp, fn, tn, or one of the label and 0/1 prediction columns that gives an aggregate of any
        kind, which costs a pass for each OWN thresholds. Labels of one class: a single row at 0.5, fraction 0, scored there."""
        require_frame(df)
        require_columns(df, label, prediction)
        loss = loss_func or "balanced_accuracy"
        own = callable(loss) and len(inspect.signature(loss).parameters) == 2
        value = F.lit(None).cast("double") if own else loss(*(F.col(c) for c in ("tp", "fp", "fn", "tn"))) if callable(loss) else _score(loss)
        y, p = F.col(f"`{label}`").cast("double"), F.col(f"`{prediction}`").cast("double")
        rows = df.select(y.alias("y"), p.alias("p"))
        r = rows.agg(F.min("p"), F.max("p"), F.avg("y"), F.count_distinct("y"), F.sum((~F.col("y").isin(0.0, 1.0)).cast("int")), F.count("y"), F.count("p"), F.count(F.lit(1))).first()
        low, high, self.label_rate, classes, odd, ny, np_, n = r
        if odd or ny != n or np_ != n:
            raise ValueError("labels must be 0 or 1, and every row needs a label and a prediction")
        spark = df.sparkSession
        if not n:
            raise ValueError("there are no rows")
        if classes < 2:
            one = rows.agg(*self._counts(F.col("p") > 0.5)).withColumn("threshold", F.lit(0.5))
            if own:
                one = rows.agg(loss(F.col("y"), (F.col("p") > 0.5).cast("int")).cast("double").alias("score")).withColumn("threshold", F.lit(0.5))
            self.result = one.select("threshold", F.col("score") if own else value.alias("score"), F.lit(0.0).alias("fraction_of_1"))
            return self.result
        if self.auto:
            low, high = max(0.0, self.label_rate * 0.8), min(1.0, self.label_rate * 1.2)
        low, high = (self.low if self.low is not None else low), (self.high if self.high is not None else high)
        step = (high - low) / (self.n - 1) if self.n > 1 else 0.0
        # The bin by division may be one off at an edge; comparing with the edges themselves settles it.
        guess = F.floor((F.col("p") - low) / step) if step else F.lit(0)
        edge = lambda k: F.lit(low) + k * F.lit(step)
        guess = F.least(F.greatest(guess, F.lit(-1)), F.lit(self.n - 1))
        # A row is positive where its prediction exceeds the threshold: bin k holds rows above threshold k only up to k.
        k = F.when(F.col("p") > edge(guess + 1), guess + 1).when(F.col("p") > edge(guess), guess).otherwise(guess - 1)
        bins = rows.groupBy(F.least(k, F.lit(self.n - 1)).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
        grid = spark.range(self.n).select(F.col("id").cast("int").alias("k"))
        above = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)  # a row for each threshold
        s = grid.join(bins, "k", "left").select("k", F.sum(F.coalesce("n", F.lit(0))).over(above).alias("n"), F.sum(F.coalesce("pos", F.lit(0.0))).over(above).alias("tp"))
        positive = self.label_rate * n
        s = s.filter("n > 0").select(edge(F.col("k")).alias("threshold"), (F.col("n") / F.lit(float(n))).alias("fraction_of_1"), "tp", (F.col("n") - F.col("tp")).alias("fp"), (F.lit(float(round(positive))) - F.col("tp")).alias("fn"), (F.lit(float(n - round(positive))) - (F.col("n") - F.col("tp"))).alias("tn"))
        self.result = self._own(rows, s.select("threshold", "fraction_of_1"), loss) if own else s.select("threshold", value.alias("score"), "fraction_of_1")
        return self.result

    @staticmethod
    def _own(rows: DataFrame, grid: DataFrame, loss) -> DataFrame:
        """Scores that don't follow from counts: the aggregate for each threshold, OWN of them in a pass."""
        found, at = grid.orderBy("threshold").collect(), 0  # a row for each threshold
        out = []
        while at < len(found):
            part = found[at : at + OWN]
            row = rows.agg(*(loss(F.col("y"), (F.col("p") > F.lit(r.threshold)).cast("int")).cast("double").alias(f"s{k}") for k, r in enumerate(part))).first()
            out += [(r.threshold, v, r.fraction_of_1) for r, v in zip(part, row)]
            at += OWN
        return rows.sparkSession.createDataFrame(out, "threshold double, score double, fraction_of_1 double")

    @staticmethod
    def _counts(said: Column) -> list[Column]:
        y = F.col("y") == 1
        return [F.sum(c.cast("double")).alias(n) for n, c in (("tp", y & said), ("fp", ~y & said), ("fn", y & ~said), ("tn", ~y & ~said))]

    def best_score(self) -> DataFrame:
        """Every threshold with the greatest score."""
        return self.result.join(F.broadcast(self.result.agg(F.max("score").alias("score"))), "score", "left_semi")

    def best_predict_ratio(self) -> DataFrame:
        """The first threshold whose share of positives lies closest to the labels'."""
        return self.result.orderBy(F.abs(F.col("fraction_of_1") - self.label_rate), "threshold").limit(1)
