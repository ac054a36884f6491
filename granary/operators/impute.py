"""Missing values: what can't be saved is dropped, the rest is predicted from the most correlated columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import hash_order, known, order_key, require_frame, written
from .encoders import Factorizer

TEXT_FILL = "Missing_data"


def _text(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.StringType)


def _number(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def fix_text_nulls(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Text columns of numbers, in which missing values were written as words, as doubles: those in which every value that is no
    number is one of a few words for nothing."""
    nothing = ("", "na", "n/a", "nan", "null", "none", "missing", "-", "?")
    names = names or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not names:
        return df
    value = {n: F.expr(f"try_cast(`{n}` as double)") for n in names}
    odd = {n: F.col(f"`{n}`").isNotNull() & value[n].isNull() & ~F.lower(F.trim(F.col(f"`{n}`"))).isin(*nothing) for n in names}
    row = df.agg(*(F.sum(odd[n].cast("int")) for n in names), *(F.count(value[n]) for n in names)).first()
    chosen = [n for k, n in enumerate(names) if row[k] == 0 and row[len(names) + k]]
    return df.select(*(F.when(~F.isnan(value[c]), value[c]).alias(c) if c in chosen else F.col(f"`{c}`") for c in df.columns))


def profile(df: DataFrame) -> dict[str, dict]:
    """rows, nulls, distinct, mean and whether fractions occur, of every column, in one pass. `distinct` is approximate above
    a thousand, where only its size matters."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for k, c in enumerate(df.columns):
        v = known(df, c)
        aggs += [F.count(v).alias(f"n{k}"), F.approx_count_distinct(v, 0.02).alias(f"d{k}")]
        if _number(df, c):
            aggs += [F.avg(v).alias(f"m{k}"), F.max((v.cast("double") % 1 != 0).cast("int")).alias(f"f{k}")]
    row = df.agg(*aggs).first().asDict()
    close = [k for k in range(len(df.columns)) if row[f"d{k}"] <= 1000]
    exact = df.agg(*(F.count_distinct(known(df, df.columns[k])).alias(f"d{k}") for k in close)).first().asDict() if close else {}
    out = {}
    for k, c in enumerate(df.columns):
        out[c] = {"rows": row["rows"], "nulls": row["rows"] - row[f"n{k}"], "distinct": exact.get(f"d{k}", row[f"d{k}"]), "mean": row.get(f"m{k}"), "fractions": bool(row.get(f"f{k}"))}
    return out


def hopeless(p: dict) -> bool:
    """Nulls, and one known value at most, or nulls in more than half the rows."""
    return p["nulls"] > 0 and (p["distinct"] <= 1 or p["nulls"] > int(0.5 * p["rows"]))


def objective(t: T.DataType, distinct: int, fractions: bool) -> str:
    """What kind of model fills a column: by its type and number of known values."""
    if isinstance(t, T.BooleanType):
        return "binary"
    if isinstance(t, T.StringType):
        return "binary" if distinct == 2 else "multiclass"
    if distinct == 2:
        return "binary"
    return "regression" if fractions or distinct >= 30 else "multiclass"


def modes(df: DataFrame, names: list[str]) -> dict[str, object]:
    """The commonest known value of each text or boolean column, the smallest on ties, null if there is none. One pass counts
    pairs of column and value, and a minimum finds the commonest, so nothing is sorted."""
    if not names:
        return {}
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"`{n}`").cast("string").alias("v")) for k, n in enumerate(names)))
    count = df.select(F.explode(pairs).alias("x")).select("x.*").filter("v is not null").groupBy("k", "v").count()
    top = {r.k: r.top.v for r in count.groupBy("k").agg(F.min(F.struct((-F.col("count")).alias("n"), "v")).alias("top")).collect()}
    return {n: (top[k] == "true" if isinstance(df.schema[n].dataType, T.BooleanType) else top[k]) if k in top else None for k, n in enumerate(names)}


def constants(df: DataFrame, p: dict[str, dict]) -> dict[str, object]:
    """What fills a column without a model: the mode of text and booleans, the mean of numbers."""
    rest = [c for c in df.columns if _text(df, c) or isinstance(df.schema[c].dataType, T.BooleanType)]
    return modes(df, rest) | {c: v["mean"] for c, v in p.items() if _number(df, c)}


def correlated(df: DataFrame, column: str, among: list[str], top: int = 10) -> list[str]:
    """The columns of greatest absolute correlation with `column`, ties by name; all in one pass."""
    if not among:
        return []
    row = df.agg(*(F.corr(known(df, column).cast("double"), known(df, c).cast("double")) for c in among)).first()
    found = sorted((-abs(r), c) for r, c in zip(row, among) if r is not None and r == r)
    return [c for _, c in found[:top]]


def sample(df: DataFrame, column: str, key: str, size: int, classes: bool) -> DataFrame:
    """At most `size` rows, or of each class, in the order of the key's hash. Classes are cut to about twice as many by hash
    before they are ordered, so a common class doesn't land in one task."""
    from pyspark.sql import Window

    if not classes:
        return df.orderBy(*hash_order(key)).limit(size)
    count = df.groupBy(F.col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    share = (F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("double") + 1) / 4294967296.0
    few = df.join(count, F.col(column) == F.col("__v")).filter((F.col("__n") <= 2 * size) | (share <= 2.0 * size / F.col("__n")))
    n = F.row_number().over(Window.partitionBy(column).orderBy(*hash_order(key)))
    return few.withColumn("__r", n).filter(F.col("__r") <= size).drop("__r", "__v", "__n")


class NaNImputer:
    """impute(df) learns and fills; impute(df, drop_hopeless=False) fills another frame as learned.

    Hopeless columns go. Text with over 200 values is filled with "Missing_data". Every other column is predicted by
    trees from its ten most correlated columns, in order, so that what is filled helps the next. Constants step in
    where no model can be trained. `key` names a unique column that isn't touched.
    """

    def __init__(self, train_sample_size: int = 30_000, trees: int = 20, depth: int = 5, seed: int = 7, text_cutoff: int = 200, top: int = 10):
        self.size, self.trees, self.depth, self.seed, self.cutoff, self.top = train_sample_size, trees, depth, seed, text_cutoff, top
        self.constants: dict | None = None

    def fit(self, df: DataFrame, key: str | None = None) -> NaNImputer:
        self.impute(df, True, key)
        return self

    def impute(self, df: DataFrame, drop_hopeless: bool = True, key: str | None = None) -> DataFrame:
        require_frame(df)
        rows, key_ = order_key(df, key)
        skip = {key_}
        p = {c: v for c, v in profile(rows).items() if c not in skip}
        if drop_hopeless:
            self.constants = constants(rows.drop(*skip), p)
            self.to_drop = [c for c, v in p.items() if hopeless(v)]
            self.text = [c for c, v in p.items() if c not in self.to_drop and _text(df, c) and v["nulls"] and v["distinct"] > self.cutoff]
        if self.constants is None:
            raise ValueError("impute() with drop_hopeless comes first")
        if all(not v["nulls"] for v in p.values()):
            return df
        rows = rows.drop(*self.to_drop)
        fills = {c: TEXT_FILL for c in self.text}
        if not drop_hopeless:
            fills |= {c: self.constants[c] for c, v in p.items() if c in rows.columns and v["nulls"] and v["distinct"] <= 1 and self.constants.get(c) is not None}
        rows = rows.select(*(self._filled(rows, c, fills[c]).alias(c) if c in fills else F.col(f"`{c}`") for c in rows.columns))
        order = [c for c in rows.columns if c in p and p[c]["nulls"] and c not in fills]
        wide = [c for c in rows.columns if c not in skip and c not in self.text and (_number(rows, c) or _text(rows, c) or isinstance(rows.schema[c].dataType, T.BooleanType))]
        types = {c: rows.schema[c].dataType for c in rows.columns}
        encoders = {}
        coded = rows
        for c in wide:
            if _text(rows, c) or (c in order and objective(types[c], p[c]["distinct"], p[c]["fractions"]) != "regression"):
                encoders[c] = Factorizer(na_sentinel=float("nan"))
                coded = encoders[c].fit_transform(coded.withColumn(c, F.col(c).cast("string")) if isinstance(types[c], T.BooleanType) else coded, c, key_)
        # What is filled joins the rest here; a written table after each column ends its lineage.
        coded = written(coded.select(*(F.col(f"`{c}`").cast("double").alias(c) if c in wide else F.col(f"`{c}`") for c in coded.columns)))
        for c in order:
            if c in wide:
                coded = written(self._predicted(coded, c, [x for x in wide if x != c], key_, objective(types[c], p[c]["distinct"], p[c]["fractions"])))
        for c, e in encoders.items():
            coded = e.inverse_transform(coded)
        out = coded.select(*(self._typed(c, types[c], c in order).alias(c) for c in rows.columns))
        return out.select(*(F.coalesce(F.col(f"`{c}`"), F.lit(self.constants[c]).cast(out.schema[c].dataType)).alias(c) if c in order and self.constants.get(c) is not None else F.col(f"`{c}`") for c in out.columns if c != "__row"))

    def _filled(self, df: DataFrame, c: str, value) -> Column:
        t = df.schema[c].dataType
        return F.coalesce(known(df, c), F.lit(value).cast("double" if isinstance(t, T.NumericType) and not isinstance(t, T.DoubleType) and value != int(value) else t)) if _number(df, c) else F.coalesce(F.col(f"`{c}`"), F.lit(value))

    def _typed(self, c: str, t: T.DataType, filled: bool) -> Column:
        v = F.col(f"`{c}`")
        return F.round(v).cast(t) if filled and isinstance(t, T.IntegralType) else v.cast(t)

    def _predicted(self, df: DataFrame, c: str, among: list[str], key: str, kind: str) -> DataFrame:
        from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import GBTRegressor

        value = known(df, c)
        train = df.filter(value.isNotNull())
        features = correlated(train, c, among, self.top)
        classes = train.agg(F.count_distinct(c)).first()[0] if kind != "regression" else 2
        if not features or classes < 2:
            return df.withColumn(c, F.coalesce(value, F.lit(self.constants.get(c)).cast("double"))) if isinstance(self.constants.get(c), int | float) else df
        # Missing inputs of the trees stand apart, below all values.
        ready = df.select("*", *(F.coalesce(known(df, x), F.lit(-1e9)).alias(f"__x{k}") for k, x in enumerate(features)))
        ready = VectorAssembler(inputCols=[f"__x{k}" for k in range(len(features))], outputCol="__x").transform(ready)
        few = sample(ready.filter(value.isNotNull()).select(key, "__x", F.col(c).alias("__y")), "__y", key, self.size, kind != "regression")
        common = {"featuresCol": "__x", "labelCol": "__y", "predictionCol": "__p", "maxDepth": self.depth, "seed": self.seed}
        if kind == "regression":
            model = GBTRegressor(maxIter=self.trees, **common)
        elif kind == "binary" and classes == 2:
            model = GBTClassifier(maxIter=self.trees, **common)
        else:
            model = RandomForestClassifier(numTrees=self.trees, **common)
        out = model.fit(few).transform(ready)
        return out.withColumn(c, F.coalesce(value, F.col("__p"))).select(*df.columns)
