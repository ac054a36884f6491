"""Categorical encoders: one aggregation to fit, a projection or lookup join to apply, and back."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import BROADCAST_ROWS, Lookup, flag, hash_fold, hash_normal, known, numbered, order_key, replaced, require_columns, require_frame, type_of, written


class _Encoder:
    column: str | None = None

    def _checked(self, df: DataFrame, *more: str) -> None:
        require_frame(df)
        if self.column is None:
            raise ValueError("fit_transform() comes first")
        require_columns(df, self.column, *more)

    def _with(self, df: DataFrame, lookup: Lookup, names: dict[str, str]) -> DataFrame:
        """df with NaN as null in the column, and the lookup's values."""
        return lookup.join(df.withColumn(self.column, known(df, self.column)), [self.column], names)

    def _decoded(self, df: DataFrame, back: Lookup) -> DataFrame:
        """The column replaced by what its values stand for; unknown values become null."""
        column = back.table.columns[0]
        coded = df.withColumn(self.column, F.col(f"`{self.column}`").cast(back.table.schema[column].dataType))
        return replaced(back.join(coded, [self.column], {back.table.columns[1]: "__back"}), df.columns, self.column, "__back")


class Factorizer(_Encoder):
    """Categories as 0, 1, ... in order of first appearance by `key`. Missing values and unseen categories get na_sentinel;
    NaN as sentinel keeps them missing. A text sentinel makes the codes text."""

    def __init__(self, na_sentinel=-1):
        if isinstance(na_sentinel, bool) or not isinstance(na_sentinel, int | float | str):
            print("na_sentinel must be a number, a string or NaN; -1 is used")
            na_sentinel = -1
        self.na_sentinel = na_sentinel
        self.keep = isinstance(na_sentinel, float) and math.isnan(na_sentinel)

    def fit_transform(self, df: DataFrame, column: str, key: str | None = None) -> DataFrame:
        self.column = column
        self._checked(df)
        rows, key = order_key(df, key)
        first = rows.select(known(df, column).alias("c"), F.col(key).alias("k")).filter("c is not null").groupBy("c").agg(F.min("k").alias("k"))
        code = F.col("__n").cast("string") if isinstance(self.na_sentinel, str) else F.col("__n")
        self.lookup = Lookup(numbered(first, "k", "c").select("c", code.alias("code")))
        self.back = Lookup(self.lookup.table.select("code", "c"))
        return self.transform(df)

    def transform(self, df: DataFrame) -> DataFrame:
        self._checked(df)
        out = self._with(df, self.lookup, {"code": "__code"})
        if not self.keep:
            sentinel = self.na_sentinel
            code = F.col("__code").cast("double") if isinstance(sentinel, float) else F.col("__code")
            out = out.withColumn("__code", F.coalesce(code, F.lit(sentinel).cast("long") if isinstance(sentinel, int) else F.lit(sentinel)))
        return replaced(out, df.columns, self.column, "__code")

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        """Codes back to categories; the sentinel and unknown codes become null."""
        self._checked(df)
        return self._decoded(df, self.back)


class OneHotEncoder(_Encoder):
    """An indicator column for each category, sorted, at the end of the frame; with na_sentinel one for missing values, last,
    if fitting met any. Absent categories give zeros; unseen ones a row of zeros."""

    def __init__(self, na_sentinel: bool = True, limit: int = 4096):
        self.na_sentinel, self.limit = flag(na_sentinel, "na_sentinel", True), limit

    def fit_transform(self, df: DataFrame, column: str, prefix: str | None = None) -> DataFrame:
        self.column, self.prefix = column, prefix
        self._checked(df)
        found = [r[0] for r in df.select(known(df, column).alias("c")).distinct().limit(self.limit + 2).collect()]
        if len(found) > self.limit + 1:
            raise ValueError(f"{column!r} has more than {self.limit} categories")
        self.categories = sorted(v for v in found if v is not None)
        self.na_sentinel = self.na_sentinel and None in found
        self.columns_before = df.columns
        names = [*self.categories, *([None] if self.na_sentinel else [])]
        self.indicators = {self._name(v): v for v in names}
        return self.transform(df)

    def _name(self, value) -> str:
        return f"{self.prefix}_{'nan' if value is None else value}" if self.prefix else "nan" if value is None else str(value)

    def transform(self, df: DataFrame) -> DataFrame:
        self._checked(df)
        c = known(df, self.column)
        rest = [F.col(f"`{x}`") for x in df.columns if x != self.column]
        return df.select(*rest, *(F.when(c.eqNullSafe(F.lit(v)), 1).otherwise(0).alias(n) for n, v in self.indicators.items()))

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        """The category whose indicator is 1, in the column's old place; a row of zeros becomes null. Without the indicator
        columns the frame comes back as it is, with a message."""
        require_frame(df)
        if any(n not in df.columns for n in self.indicators):
            print("the indicator columns aren't all there; nothing is changed")
            return df
        value = F.coalesce(*(F.when(F.col(f"`{n}`") == 1, F.lit(v)) for n, v in self.indicators.items() if v is not None), F.lit(None))
        rest = [c for c in df.columns if c not in self.indicators]
        order = [c for c in self.columns_before if c in rest or c == self.column] + [c for c in rest if c not in self.columns_before]
        return df.select(*(value.alias(c) if c == self.column else F.col(f"`{c}`") for c in order))


class FrequencyEncoder(_Encoder):
    """Categories as their share of rows. A count that an earlier category, in sorted order with missing last, has too is
    raised by 0.1 before it is divided. Unseen: the greatest share with na_sentinel, else null."""

    def __init__(self, na_sentinel: bool = True):
        self.na_sentinel = flag(na_sentinel, "na_sentinel", True)

    def fit_transform(self, df: DataFrame, column: str) -> DataFrame:
        self.column = column
        self._checked(df)
        counts = df.groupBy(known(df, column).alias("c")).agg(F.count(F.lit(1)).alias("n"))
        counts = written(counts)
        total = counts.agg(F.sum("n")).first()[0] or 0
        if not self.na_sentinel:
            counts = counts.filter("c is not null")
        elif counts.filter("c is null").isEmpty():
            none = df.sparkSession.createDataFrame([(None, 0)], T.StructType([T.StructField("c", type_of(df, column)), T.StructField("n", T.LongType())]))
            counts = counts.unionByName(none)
        # The first category of each count keeps it: a minimum by count, so no sort of all categories. Null sorts last.
        mark = F.struct(F.col("c").isNull().cast("int").alias("late"), F.col("c").alias("c"))
        first = counts.groupBy("n").agg(F.min(mark).alias("first"))
        # Far fewer counts than categories, most of which share the smallest ones: these rows go to every task if they may.
        first = F.broadcast(first) if first.count() <= BROADCAST_ROWS else first
        repeated = ~F.col("first.c").eqNullSafe(F.col("c")) | (F.col("first.late") != F.col("c").isNull().cast("int"))
        table = counts.join(first, "n").select("c", ((F.col("n") + F.when(repeated, F.lit(0.1)).otherwise(F.lit(0.0))) / F.lit(float(total or 1))).alias("share"))
        self.lookup = Lookup(table)
        self.most = self.lookup.table.agg(F.max("share")).first()[0]
        # Of categories with one share, the smallest.
        self.back = Lookup(self.lookup.table.filter("c is not null or share > 0").groupBy("share").agg(F.min("c").alias("c")))
        return self.transform(df)

    def transform(self, df: DataFrame) -> DataFrame:
        self._checked(df)
        out = self._with(df, self.lookup, {"share": "__code"})
        if self.na_sentinel:
            out = out.withColumn("__code", F.coalesce("__code", F.lit(self.most)))
        return replaced(out, df.columns, self.column, "__code")

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        self._checked(df)
        return self._decoded(df, self.back)


class MeanTargetEncoder(_Encoder):
    """Categories as the mean target. Training rows get the mean of the other folds, so no row sees its own target; folds come
    from the key. With na_sentinel all that is missing becomes the global mean."""

    def __init__(self, na_sentinel: bool = True, save_inverse_transform: bool = False, folds: int = 5, seed: int = 5):
        self.na_sentinel, self.save = flag(na_sentinel, "na_sentinel", True), flag(save_inverse_transform, "save_inverse_transform", False)
        self.folds, self.seed = folds, seed

    def fit_transform(self, df: DataFrame, column: str, target: str, key: str | None = None) -> DataFrame:
        self.column, self.target = column, target
        self._checked(df, target)
        rows, self.key = order_key(df, key)
        y = known(df, target).cast("double")
        base = rows.select(known(df, column).alias("c"), hash_fold(self.key, self.folds, self.seed).alias("fold"), y.alias("y"))
        # Sums by category and fold are all that is needed: totals and out-of-fold means follow from them.
        sums = written(base.groupBy("c", "fold").agg(F.sum("y").alias("s"), F.count("y").alias("n")))
        whole = sums.agg(F.sum("s"), F.sum("n")).first()
        self.mean = whole[0] / whole[1] if whole[1] else None
        total = sums.filter("c is not null").groupBy("c").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
        self.lookup = Lookup(total.select("c", (F.col("ts") / F.col("tn")).alias("mean")))
        other = sums.join(total, "c").select("c", "fold", F.when(F.col("tn") > F.col("n"), (F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))).alias("mean"))
        self.by_fold = Lookup(other)
        marked = rows.withColumn(column, known(df, column)).withColumn("__fold", hash_fold(self.key, self.folds, self.seed))
        # A category may lack a fold of its own only where it has no row of it, so every training row finds its mean.
        out = self.by_fold.join(marked, [column, "__fold"], {"mean": "__code"})
        if self.na_sentinel:
            out = out.withColumn("__code", F.coalesce("__code", F.lit(self.mean)))
        return replaced(out, df.columns, column, "__code")

    def transform(self, df: DataFrame) -> DataFrame:
        self._checked(df)
        out = self._with(df, self.lookup, {"mean": "__code"})
        value = F.coalesce("__code", F.lit(self.mean))
        if not self.na_sentinel:
            value = F.when(F.col(f"`{self.column}`").isNotNull(), value)
        return replaced(out.withColumn("__code", value), df.columns, self.column, "__code")

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        """Means back to categories where they are plain ones; those of training rows by fold, which
        save_inverse_transform=True must have asked for. Of categories with one mean, the smallest."""
        self._checked(df)
        plain = Lookup(self.lookup.table.groupBy("mean").agg(F.min("c").alias("c")))
        marked = plain.join(df, [self.column], {"c": "__back"})
        odd = marked.filter(F.col("__back").isNull() & F.col(f"`{self.column}`").isNotNull() & (F.col(f"`{self.column}`") != F.lit(self.mean)))
        if odd.isEmpty():
            return replaced(marked, df.columns, self.column, "__back")
        if not self.save or self.key not in df.columns:
            print("values of training rows need save_inverse_transform=True and the key column; nothing is changed")
            return df
        back = Lookup(self.by_fold.table.filter("mean is not null").groupBy("mean", "fold").agg(F.min("c").alias("c")))
        out = back.join(df.withColumn("__fold", hash_fold(self.key, self.folds, self.seed)), [self.column, "__fold"], {"c": "__back"})
        return replaced(out, df.columns, self.column, "__back")


class WeightOfEvidenceEncoder(_Encoder):
    """Categories as ln(((pos + r) / (P + 2r)) / ((neg + r) / (N + 2r))), r = 1, of a 0/1 target. Training rows carry
    multiplicative normal noise of spread sigma, drawn from the key, unless randomized=False. Unseen: 0; missing: 0 with
    na_sentinel, else null."""

    def __init__(self, na_sentinel: bool = True, randomized: bool = True, sigma: float = 0.05, regularization: float = 1.0):
        self.na_sentinel, self.randomized = flag(na_sentinel, "na_sentinel", True), flag(randomized, "randomized", True)
        self.sigma, self.r = sigma, regularization

    def fit_transform(self, df: DataFrame, column: str, target: str, key: str | None = None) -> DataFrame:
        self.column = column
        self._checked(df, target)
        rows, self.key = order_key(df, key)
        y = known(df, target).cast("double")
        sums = written(df.groupBy(known(df, column).alias("c")).agg(F.sum(y).alias("pos"), F.count(y).alias("n"), F.sum(((y != 0) & (y != 1)).cast("int")).alias("odd")))
        whole = sums.agg(F.sum("pos"), F.sum("n"), F.sum("odd")).first()
        if whole[2] or not whole[1] or whole[0] in (0, whole[1]):
            raise ValueError("the target must hold both 0 and 1 and nothing else")
        positive, negative, r = float(whole[0]), float(whole[1] - whole[0]), self.r
        woe = F.log(((F.col("pos") + r) / (positive + 2 * r)) / ((F.col("n") - F.col("pos") + r) / (negative + 2 * r)))
        self.lookup = Lookup(sums.filter("c is not null").select("c", woe.alias("woe")))
        self.back = Lookup(self.lookup.table.select(F.round("woe", 5).alias("woe"), "c").groupBy("woe").agg(F.min("c").alias("c")))
        out = self._value(rows)
        if self.randomized:
            out = out.withColumn("__code", F.col("__code") * self._noise())
        return replaced(out, df.columns, column, "__code")

    def _noise(self):
        return 1 + F.lit(self.sigma) * hash_normal(self.key)

    def _value(self, df: DataFrame) -> DataFrame:
        out = self._with(df, self.lookup, {"woe": "__code"})
        value = F.coalesce("__code", F.lit(0.0))
        return out.withColumn("__code", value if self.na_sentinel else F.when(F.col(f"`{self.column}`").isNotNull(), value))

    def transform(self, df: DataFrame) -> DataFrame:
        self._checked(df)
        return replaced(self._value(df), df.columns, self.column, "__code")

    def inverse_transform(self, df: DataFrame, noisy: bool = False) -> DataFrame:
        """Values back to categories, matched to five places; noisy: of training rows, whose noise is divided out by the key."""
        self._checked(df)
        value = F.col(f"`{self.column}`")
        if noisy:
            require_columns(df, self.key)
            value = value / self._noise()
        return self._decoded(df.withColumn(self.column, F.round(value, 5)), self.back)
