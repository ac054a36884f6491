"""A user's Python function over chunks of a collection or a frame, on the cluster's cores."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Multicore:
    """execute(func, iterable, *more) cuts each iterable into `workers` chunks; func gets the chunks of one place, and the results
    are merged in order by their type. A Spark frame isn't collected: func maps pandas frames of it to pandas frames. Two
    frames are zipped by a key: both are cut alike by its hash, into as many chunks as Spark shuffles into, and func gets
    the pandas frames of one place, an empty one where a frame has no rows there."""

    def __init__(self, workers: int | bool = False, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.active()
        cores = self.spark.sparkContext.defaultParallelism
        if workers is not False and (isinstance(workers, bool) or not isinstance(workers, int) or not 1 <= workers <= cores):
            raise ValueError(f"workers is False, for all cores, or 1 to {cores}")
        self.workers = workers or cores

    def execute(self, func: Callable, iterable, *more, schema: str | None = None, key: str | None = None):
        if isinstance(iterable, DataFrame):
            if more:
                return self._zipped(func, iterable, more, schema, key)
            frame = iterable.repartition(self.workers)
            return frame.mapInPandas(lambda batches: (func(b) for b in batches), schema or iterable.schema)
        parts = [self._chunks(x) for x in (iterable, *more)]
        jobs = list(zip(*parts))
        found = self.spark.sparkContext.parallelize(list(enumerate(jobs)), max(1, len(jobs))).map(lambda job: (job[0], func(*job[1]))).collect()
        return self._merged([r for _, r in sorted(found, key=lambda x: x[0])])

    def _zipped(self, func: Callable, one: DataFrame, more: tuple, schema: str | None, key: str | None) -> DataFrame:
        if len(more) != 1 or not isinstance(more[0], DataFrame) or not key or not schema:
            raise ValueError("two frames are zipped by a key, with the schema of the result")
        chunks = max(self.workers, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        cut = [df.withColumn("__chunk", F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(chunks))) for df in (one, more[0])]
        whole = lambda a, b: func(a.drop(columns="__chunk"), b.drop(columns="__chunk"))
        return cut[0].groupBy("__chunk").cogroup(cut[1].groupBy("__chunk")).applyInPandas(whole, schema)

    def _chunks(self, x) -> list:
        if isinstance(x, dict):
            keys = list(x)
            return [{k: x[k] for k in part} for part in self._cut(keys)]
        if isinstance(x, pd.DataFrame | pd.Series):
            return [x.iloc[a:b] for a, b in self._bounds(len(x))]
        return self._cut(list(x)) if not isinstance(x, np.ndarray) else [x[a:b] for a, b in self._bounds(len(x))]

    def _bounds(self, n: int) -> list[tuple[int, int]]:
        size, rest = divmod(n, self.workers)
        ends = np.cumsum([size + (k < rest) for k in range(self.workers)]).tolist()
        return [(a, b) for a, b in zip([0, *ends], ends) if a < b] or [(0, 0)]

    def _cut(self, x: list) -> list[list]:
        return [x[a:b] for a, b in self._bounds(len(x))]

    @staticmethod
    def _merged(results: list):
        first = results[0]
        if isinstance(first, tuple):
            return [list(r) for r in results]
        if isinstance(first, np.ndarray):
            return np.concatenate(results)
        if isinstance(first, list):
            return [x for r in results for x in r]
        if isinstance(first, pd.Series | pd.DataFrame):
            return pd.concat(results)
        if isinstance(first, dict):
            return reduce(lambda a, b: {**a, **b}, results)
        raise TypeError(f"results of {type(first).__name__} can't be merged")
