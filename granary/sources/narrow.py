"""Narrow types: one aggregation finds the ranges of all numeric columns, a projection casts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import require_columns, require_frame

#: The ladders, narrowest first, with the least and greatest value of each type. There is no 16-bit float.
INTEGERS = tuple((n, -(2 ** (b - 1)), 2 ** (b - 1) - 1) for n, b in (("tinyint", 8), ("smallint", 16), ("int", 32), ("bigint", 64)))
FLOATS = (("float", -3.4028234663852886e38, 3.4028234663852886e38), ("double", float("-inf"), float("inf")))
_WIDTH = {T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4, T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.TimestampNTZType: 8}


def narrowest(low, high, ladder) -> str:
    """The first type whose range holds low and high strictly inside; the widest if none does, or if nothing is known."""
    if low is not None:
        for name, least, most in ladder:
            if low > least and high < most:
                return name
    return ladder[-1][0]


class TypeOptimizer:
    """Reads CSV, or takes a frame, and casts each numeric column to the narrowest type of its kind that holds its values.

    Options: sep or delimiter, usecols, encoding, and any other option of Spark's CSV reader. Booleans stay.
    """

    def __init__(self, spark: SparkSession | None = None, sep: str | None = None, delimiter: str | None = None, usecols: list[str] | None = None, encoding: str | None = None, **options):
        self.spark, self.usecols = spark, usecols
        self.options = {"header": True, "inferSchema": True, "sep": sep or delimiter or ",", **({"encoding": encoding} if encoding else {}), **options}
        self.types: dict[str, str] | None = None

    def read(self, source) -> DataFrame:
        if isinstance(source, str):
            source = (self.spark or SparkSession.active()).read.options(**self.options).csv(source)
        require_frame(source)
        if self.usecols:
            require_columns(source, *self.usecols)
            source = source.select(*self.usecols)
        return source

    def get_shape(self, source) -> tuple[int, int]:
        """Rows and columns; a file's header counts as no row. Of a file only lines are counted, no values read."""
        if isinstance(source, str):
            text = (self.spark or SparkSession.active()).read.text(source)
            first = text.first()
            columns = len(re.split(re.escape(self.options["sep"]), first[0])) if first else 0
            # Files of a folder each have a header.
            files = text.select(F.input_file_name()).distinct().count() if first else 0
            return text.filter("length(value) > 0").count() - files, columns
        return require_frame(source).count(), len(source.columns)

    def discover_dtypes(self, source) -> dict[str, str]:
        df = self.read(source)
        numeric = [f for f in df.schema if isinstance(f.dataType, T.NumericType)]
        values = {f.name: F.when(~F.isnan(f"`{f.name}`"), F.col(f"`{f.name}`")) if isinstance(f.dataType, T.FloatType | T.DoubleType) else F.col(f"`{f.name}`") for f in numeric}
        row = df.agg(F.count(F.lit(1)), *(x for f in numeric for x in (F.min(values[f.name]), F.max(values[f.name])))).first()
        self.rows = row[0]
        self.types = {}
        for k, f in enumerate(numeric):
            ladder = INTEGERS if isinstance(f.dataType, T.IntegralType) else FLOATS
            self.types[f.name] = narrowest(row[1 + 2 * k], row[2 + 2 * k], ladder)
        return self.types

    def optimize_memory_usage(self, source) -> DataFrame:
        df = self.read(source)
        self.discover_dtypes(df)
        out = df.select(*(F.col(f"`{c}`").cast(self.types[c]).alias(c) if c in self.types else F.col(f"`{c}`") for c in df.columns))
        width = lambda d: sum(_WIDTH.get(type(f.dataType), f.dataType.typeName() == "string" and 20 or 16) for f in d.schema)
        self.original_mb, self.optimized_mb = (width(d) * self.rows / 1e6 for d in (df, out))
        self.ratio = self.optimized_mb / self.original_mb if self.original_mb else 1.0
        return out

    def report(self) -> DataFrame:
        """Estimated sizes: the schema's width times rows; text counts 20 bytes."""
        return (self.spark or SparkSession.active()).createDataFrame([(self.original_mb, self.optimized_mb, self.ratio)], "original_mb double, optimized_mb double, ratio double")
