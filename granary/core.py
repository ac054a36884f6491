"""What every operator shares: argument checks, missing values, key-derived order, lookups of checked size."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows, and bytes of their values, of a lookup that may go to every task; larger ones are joined by shuffling.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


def require_frame(df, name: str = "df") -> DataFrame:
    if not isinstance(df, DataFrame):
        raise TypeError(f"{name} must be a Spark DataFrame, not {type(df).__name__}")
    return df


def require_columns(df: DataFrame, *names: str) -> None:
    for name in names:
        if not isinstance(name, str):
            raise TypeError(f"a column name must be a string, not {type(name).__name__}")
        if name not in df.columns:
            raise KeyError(f"no column {name!r} in {df.columns}")


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_float(t: T.DataType) -> bool:
    return isinstance(t, T.FloatType | T.DoubleType)


def known(df: DataFrame, name: str) -> Column:
    """The column with NaN as null: missing is one notion."""
    c = F.col(f"`{name}`")
    return F.when(~F.isnan(c), c) if is_float(type_of(df, name)) else c


def hash_order(key: str) -> list[Column]:
    """A pseudo-random order that depends on the key alone: the same on any cluster, in any partitioning."""
    return [F.md5(F.col(key).cast("string")), F.col(key)]


def hash_fold(key: str, folds: int, seed: int = 0) -> Column:
    """0 .. folds-1 from the key's md5."""
    salted = F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")) if seed else F.col(key).cast("string")
    return (F.conv(F.substring(F.md5(salted), 1, 8), 16, 10).cast("long") % folds).cast("int")


def hash_uniform(key: str, part: int) -> Column:
    """In (0, 1): 32 bits of the key's md5, at one of four parts."""
    return (F.conv(F.substring(F.md5(F.col(key).cast("string")), 1 + 8 * part, 8), 16, 10).cast("double") + 1) / 4294967297.0


def hash_normal(key: str) -> Column:
    """Standard normal by Box and Muller from the key's md5."""
    return F.sqrt(-2 * F.log(hash_uniform(key, 0))) * F.cos(2 * F.lit(3.141592653589793) * hash_uniform(key, 1))


def order_key(df: DataFrame, key: str | None) -> tuple[DataFrame, str]:
    """The frame and the name of its row key. Without one: the order in which Spark reads the rows, which a shuffle before
    or another file layout changes."""
    if key:
        require_columns(df, key)
        return df, key
    return df.withColumn("__row", F.monotonically_increasing_id()), "__row"


def shared_path(df: DataFrame) -> str:
    """A new path in the folder that the cluster shares."""
    sc = df.sparkSession.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir("/tmp/checkpoints/granary")
        base = sc.getCheckpointDir()
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/granary-{uuid.uuid4().hex}")
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and reread: what follows doesn't compute it again, and lost executors lose nothing."""
    path = shared_path(df)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task of a model's training holds at most, about; and at least, where the cores don't all get some.
TASK_ROWS, LEAST_ROWS = 500_000, 10_000


def spread(df: DataFrame, key: str, rows: int) -> DataFrame:
    """df, of so many rows, dealt evenly by a unique key for training. A file's rows are read by as many tasks as it has row
    groups, of which well compressed rows make few, so that one task may hold most of a read table."""
    parts = max(1, min(df.sparkSession.sparkContext.defaultParallelism, rows // LEAST_ROWS), -(-rows // TASK_ROWS))
    return df.repartition(parts, F.col(f"`{key}`"))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with `__n` = 0, 1, ... in that order, without one task that sees all rows: ranges are numbered each by itself, and
    the counts of the ranges before, a row for each, are added."""
    parts = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    size = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    # A row for each partition, so this window is short.
    size = size.withColumn("__before", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return parts.withColumn("__n", within).join(F.broadcast(size.select("__part", "__before")), "__part").withColumn("__n", (F.col("__n") + F.col("__before")).cast("long")).drop("__part", "__before")


class Lookup:
    """A fitted table of distinct keys and values. Small ones live on the driver and are broadcast; larger ones are written
    once and joined as Spark sees fit, with skewed keys split by adaptive execution."""

    def __init__(self, table: DataFrame, limit: int = BROADCAST_ROWS):
        # Text has the bytes that it has, anything else counts eight.
        width = reduce(lambda a, b: a + b, (F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)).cast("long") if isinstance(f.dataType, T.StringType | T.BinaryType) else F.lit(8) for f in table.schema))
        n, size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
        self.small = n <= limit and size <= BROADCAST_BYTES
        self.rows = table.collect() if self.small else None
        self.table = table.sparkSession.createDataFrame(self.rows, table.schema) if self.small else written(table)

    def join(self, df: DataFrame, on: list[str], names: dict[str, str], null_safe: bool = True) -> DataFrame:
        """df with the values under new names, null where no key matches. on: df's columns, in the order of the table's first
        ones; names: value column to new name."""
        keys = self.table.columns[: len(on)]
        side = self.table.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *(F.col(v).alias(n) for v, n in names.items()))
        test = reduce(lambda a, b: a & b, (df[f"`{c}`"].eqNullSafe(F.col(f"__k{i}")) if null_safe else df[f"`{c}`"] == F.col(f"__k{i}") for i, c in enumerate(on)))
        return df.join(F.broadcast(side) if self.small else side, test, "left").drop(*(f"__k{i}" for i in range(len(on))))

    def to_dict(self) -> dict:
        if not self.small:
            raise ValueError("the table is too large for the driver")
        return {r[0]: r[1] for r in self.rows}


def replaced(df: DataFrame, columns: list[str], name: str, value: str) -> DataFrame:
    """The columns in their order, with `name` taken from column `value`."""
    return df.select(*(F.col(f"`{value}`").alias(c) if c == name else F.col(f"`{c}`") for c in columns))


def flag(value, name: str, default: bool) -> bool:
    """A boolean argument; anything else is reported and the default taken."""
    if isinstance(value, bool):
        return value
    print(f"{name} must be True or False; {default} is used")
    return default


_shipped: set[str] = set()


def ship(spark) -> None:
    """Sends this package to the executors, once for each application, so that their Python finds it wherever it was started."""
    import os
    import tempfile
    import zipfile

    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), "granary_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("granary", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
