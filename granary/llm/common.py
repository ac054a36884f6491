"""Helpers shared by the operators of this package: shared storage, Arrow loops, word splitting."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows turned into Python objects at a time, so that long texts don't pile up in a worker.
SLICE = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, deleted when the driver's JVM ends.

    The setting is the cluster's; one of our own is set only where there is none (tests in local mode).
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir("/tmp/checkpoints/granary")
        base = sc.getCheckpointDir()
    path = f"{base.rstrip('/')}/granary-{uuid.uuid4().hex}"
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return fs.makeQualified(hadoop).toString()


def written(df: DataFrame, name: str = "table", folder: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and reread: the lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows that a file takes, where the cores all get some.
FILE_BYTES = 8 << 20


def gathered(df: DataFrame, size: int | None) -> DataFrame:
    """df, of about so many bytes, in as many partitions as it fills and at least two for each core, if it has more;
    unchanged if the size isn't known.

    Each file costs more than its rows if they are few: on file systems that call a program to set its mode (Hadoop's local
    one does, twice a file), that process has the executor's whole memory again until it has started. Partitions meet in the
    task that writes them, without another shuffle, so what comes before that in the same stage is done by as few tasks.
    """
    return df if size is None else df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // FILE_BYTES)))


def arrow_map(df: DataFrame, rows: Callable[[dict], Iterator[tuple] | list[tuple]], schema: str, size: int = SLICE) -> DataFrame:
    """mapInArrow whose function gets a dict of column lists for at most `size` rows and returns output rows."""
    from pyspark.sql.types import StructType

    out = arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                made = list(rows({n: c.to_pylist() for n, c in zip(part.schema.names, part.columns)}))
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), out)], schema=out)

    return df.mapInArrow(run, schema)


def arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def text_of(name: str = "text"):
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def train_rows(key, folds: int, out: int):
    """True for rows whose labels may be learned from: crc32 of the key as text, modulo folds, isn't `out`."""
    return F.crc32(key.cast("string").cast("binary")) % folds != out


#: Upper to lower case for A-Z; every ASCII byte that is no digit or letter becomes a space. Bytes from 0x80 up stay.
WORD_BYTES = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
