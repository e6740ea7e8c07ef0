"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only up to this many rows of a few numbers each.
BROADCAST_ROWS = 200_000

#: Bytes that a memo of words may hold before it is emptied.
MEMO_BYTES = 96 << 20


def release() -> None:
    """Give freed memory back to the system: a worker keeps it otherwise, and lives through
    several operators beside its JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass  # not the GNU library


class Memo(dict):
    """What a worker process keeps of words. Workers live through several operators, so only
    the memo that was used last keeps its entries, and at most MEMO_BYTES of them, by `used`.
    emptied is called then, to let go of what is kept by the entries' numbers."""

    _last: Memo | None = None

    def __init__(self, make: Callable[[str], Any] | None = None, most: int = MEMO_BYTES, emptied: Callable[[], None] | None = None):
        super().__init__()
        self._make, self._most, self._emptied, self.used = make, most, emptied, 0

    def __missing__(self, word: str) -> Any:
        found = self[word] = self._make(word)
        self.used += len(word) + 150
        return found

    def clear(self) -> None:
        super().clear()
        self.used = 0
        if self._emptied:
            self._emptied()

    def ready(self, more: int = 0) -> bool:
        """To be called before every batch of so many bytes; whether the memo was emptied."""
        if Memo._last is not self:
            if Memo._last is not None:
                Memo._last.clear()
                release()
            Memo._last = self
        if self and self.used + more > self._most:
            self.clear()
            release()
            return True
        return not self


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, of about `most` bytes or one row, so that few texts are
    Python objects at a time."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * most // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    batch = None
    release()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fields(docs: DataFrame, **picked: str) -> DataFrame:
    """Columns under new names: picked[new] is found by its exact name, even where others differ
    from it by case alone; of several with one name the first counts."""
    flat = docs.toDF(*[f"__{i}" for i in range(len(docs.columns))])
    return flat.select(*[F.col(f"__{docs.columns.index(old)}").alias(new) for new, old in picked.items()])


def with_row(docs: DataFrame, **picked: str) -> DataFrame:
    """fields, and all columns as the struct __row, so that no name of theirs can clash."""
    flat = docs.toDF(*[f"__{i}" for i in range(len(docs.columns))])
    return flat.select(*[F.col(f"__{docs.columns.index(old)}").alias(new) for new, old in picked.items()], F.struct(*flat.columns).alias("__row"))


def rows_back(rows: DataFrame, names: list[str]) -> DataFrame:
    """The columns that with_row packed, under their names."""
    return rows.select(*[F.col(f"__row.__{i}").alias(name) for i, name in enumerate(names)])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a folder of this
    machine serves if there is no other machine; on a cluster it would lose what is written."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not named:
        named = sc.getCheckpointDir()
    if not named:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='docquarry-')}"
        sc.setCheckpointDir(named)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Compute df once, into the shared checkpoint folder, and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def beside(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b): the rows that have the same place in the same partition, as structs. Both must have as
    many partitions and rows in each. The JVM does it; RDDs of Python would start a second daemon in
    every executor, with workers of its own for either side and for what joins them."""
    spark = a.sparkSession
    encoders = spark.sparkContext._jvm.org.apache.spark.sql.Encoders
    pairs = a._jdf.toJavaRDD().zip(b._jdf.toJavaRDD()).rdd()
    both = spark._jsparkSession.createDataset(pairs, encoders.tuple(encoders.row(a._jdf.schema()), encoders.row(b._jdf.schema())))
    return DataFrame(both.toDF(), spark).toDF("a", "b")


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet into the shared folder and read it again; compressed, unlike a checkpoint."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(schema).parquet(path)


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast for a side whose counted rows are few; else the planner's own join."""
    return F.broadcast(df) if rows <= limit else df


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer over an array of unsigned integers."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
