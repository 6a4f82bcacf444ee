"""Helpers the training-data operators share: Arrow columns, hash folds, scratch tables, summed arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.session import scratch_path


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of every row of a string column."""
    return column.cast(pa.large_binary()).to_pylist()


def remainder(key: Column, mod: int) -> Column:
    """crc32 of the key as text, modulo ``mod``; null for a null key (such rows are in no fold)."""
    return F.crc32(key.cast("string").cast("binary")) % mod


def in_fold(key: Column, mod: int, rest: int) -> Column:
    """True where the key's remainder is ``rest``; false for null keys."""
    return F.coalesce(remainder(key, mod) == rest, F.lit(False))


def with_struct(df: DataFrame, name: str, work: Callable[[Iterator[pa.Array]], Iterator[pa.Array]],
                kind: str, *columns: Column | str) -> DataFrame:
    """Add a column made by an Arrow function over batches of one column.

    The function is marked nondeterministic so that a filter on its result is not pushed below it,
    which would run it twice.
    """
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return work(batches)

    return df.withColumn(name, F.arrow_udf(run, kind).asNondeterministic()(*columns))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the frame does not use yet (names are compared without case)."""
    used = {c.lower() for c in df.columns}
    while wanted.lower() in used:
        wanted += "_"
    return wanted


class Scratch:
    """Tables written to the shared folder while an operator runs.

    ``keep`` writes a frame and goes on from the written files, so that an executor lost later costs a
    reread and not a recomputation. ``drop`` removes a table that no later step reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "table")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.paths.pop(id(df), None)
        if path:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def summed(parts: DataFrame, width: int, groups: int = 16) -> np.ndarray:
    """Add up the float64 vectors (column ``v``, binary) that tasks have emitted.

    Two levels: tasks' vectors meet in ``groups`` groups on the executors, and at most ``groups`` vectors of
    ``width`` numbers reach the driver, however many tasks there were.
    """
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.frombuffer(raw)
        yield pa.RecordBatch.from_pydict({"v": pa.array([total.tobytes()], pa.binary())})

    rows = parts.select("v").repartition(groups).mapInArrow(add, "v binary").collect()
    return np.sum([np.frombuffer(r.v) for r in rows], axis=0) if rows else np.zeros(width)
