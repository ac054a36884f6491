"""Stratified splits on continuous or categorical targets, decided row by row from the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import Lookup, order_key, require_columns, require_frame, written


def estimate_nbins(n: int) -> int:
    """Edges of the bins of n values: a tenth of n, 100 at most."""
    return min(100, n // 10)


def bin_column(c, low: float, high: float, edges: int):
    """The number of edges at or below a value: bins open on the right, the greatest value in one of its own."""
    if edges < 2 or high == low:
        return F.lit(1 if edges else 0).cast("int")
    return (1 + F.floor((c - low) / ((high - low) / (edges - 1)))).cast("int")


def combine_single_bins(count: dict) -> dict:
    """Which bin each bin of `count` joins, so that none is left with one value: single bins with a neighbour among the single
    ones, or else among all, pair up in order; the rest go to the nearest bin with more. Bins are integers."""
    single = sorted(k for k, n in count.items() if n == 1)
    if not single:
        return {}
    beside = lambda ks, pool: {x for k in ks for j in (k - 1, k + 1) if j in pool for x in (k, j)}
    close = beside(single, set(single)) or beside(single, set(count))
    close |= beside([k for k in single if k not in close], set(count))
    to, line = {}, sorted(close)
    groups = len(line) // 2
    size, more = divmod(len(line), groups) if groups else (0, 0)
    at = 0
    for g in range(groups):
        n = size + (g < more)
        to |= {k: line[at] for k in line[at : at + n]}
        at += n
    left = [k for k in single if k not in to]
    rest = [k for k in count if k not in left]
    for k in left:
        if rest:
            nearest = min(rest, key=lambda b: (abs(b - k), b))
            to[k] = to.get(nearest, nearest)
    return {k: v for k, v in to.items() if k != v}


def sizes(test_size: float | None, train_size: float | None) -> tuple[float, float]:
    """Shares of test and train: 0.3 and 0.7 unless given, each from the other, and train less what exceeds 1."""
    if not test_size and not train_size:
        return 0.3, 0.7
    if not test_size:
        return 1 - train_size, train_size
    if not train_size:
        return test_size, 1 - test_size
    return test_size, min(train_size, 1 - test_size)


def scsplit(df: DataFrame, stratify: str, test_size: float | None = None, train_size: float | None = None, continuous: bool = True, random_state: int | None = None, key: str | None = None, target: str | None = None):
    """(train, test), or with a target column (X_train, X_test, y_train, y_test): every stratum is split in the same proportion.

    Rows of a stratum are ordered by the md5 of the key (and of random_state, 0 included); the first part is test. A
    stratum is cut into slices by that hash first, each of which gives its share by rounding on running sums, so a stratum
    with a third of all rows is no task of its own.
    """
    require_frame(df)
    require_columns(df, stratify)
    test_size, train_size = sizes(test_size, train_size)
    rows, key_ = order_key(df, key)
    c = F.col(f"`{stratify}`")
    if continuous:
        n, low, high = rows.agg(F.count(c), F.min(c).cast("double"), F.max(c).cast("double")).first()
        rows = rows.withColumn("__bin", bin_column(c.cast("double"), low, high, estimate_nbins(n)) if n else F.lit(0))
        count = {r[0]: r[1] for r in rows.groupBy("__bin").count().collect()}  # 102 rows at most
        to = combine_single_bins({k: v for k, v in count.items() if k is not None})
        if to:
            rows = rows.withColumn("__bin", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in to.items() for x in kv]), F.col("__bin")), F.col("__bin")))
    else:
        # Labels with one row join the label beside them in sorted order, which any number of labels allows.
        labels = Lookup(rows.groupBy(c.alias("label")).count().withColumn("number", F.xxhash64("label")))
        if labels.small:
            order = sorted((r for r in labels.rows if r["label"] is not None), key=lambda r: r["label"])
            place = {r["label"]: k for k, r in enumerate(order)}
            to = combine_single_bins({place[r["label"]]: r["count"] for r in order})
            numbers = df.sparkSession.createDataFrame([(r["label"], to.get(k, k)) for k, r in enumerate(order)], rows.select(c.alias("label"), F.lit(1).alias("n")).schema) if order else None
            rows = Lookup(numbers).join(rows, [stratify], {"n": "__bin"}) if numbers is not None else rows.withColumn("__bin", F.lit(0))
        else:
            rows = rows.withColumn("__bin", F.xxhash64(c))
    salt = F.concat(F.lit("" if random_state is None else f"{random_state}:"), F.col(key_).cast("string"))
    rows = rows.withColumn("__h", F.md5(salt)).withColumn("__slice", F.substring("__h", 1, 2))
    # 256 slices a stratum: their sizes give each the count of rows before it, and so its quota.
    size = rows.groupBy("__bin", "__slice").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("__bin").orderBy("__slice")
    size = size.withColumn("__before", F.sum("__n").over(w) - F.col("__n")).withColumn("__all", F.sum("__n").over(Window.partitionBy("__bin")))
    within = F.row_number().over(Window.partitionBy("__bin", "__slice").orderBy("__h", F.col(key_)))
    rows = rows.withColumn("__r", within)
    size = size.select(F.col("__bin").alias("__b"), F.col("__slice").alias("__s"), "__before", "__all")
    rows = rows.join(size, F.col("__bin").eqNullSafe(F.col("__b")) & (F.col("__slice") == F.col("__s")))
    place = F.col("__before") + F.col("__r")
    tested = F.round(F.col("__all") * test_size)
    side = F.when(place <= tested, 0).when(place <= tested + F.round(F.col("__all") * train_size), 1)
    rows = written(rows.select(*(F.col(f"`{x}`") for x in df.columns), side.alias("__side")))
    test, train = (rows.filter(f"__side = {k}").drop("__side") for k in (0, 1))
    if target is None:
        return train, test
    require_columns(df, target)
    return train.drop(target), test.drop(target), train.select(target), test.select(target)
