"""Keeping tables of documents up to date with files that arrive or change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import extract
from ..sources.files import supported


def extracted(files: DataFrame, **how) -> DataFrame:
    """Documents of a stream of files; it keeps no state."""
    return extract.documents(supported(files), **how)


def once_a_version(files: DataFrame, id_col: str = "path", time_col: str = "modificationTime", delay: str = "7 days") -> DataFrame:
    """Every version of a file once. What is remembered ends with the watermark."""
    return files.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col, time_col])


def newest(files: DataFrame, id_col: str = "path", time_col: str = "modificationTime") -> DataFrame:
    """Of each file the newest version, for batches; ties are broken by all other columns."""
    rest = [F.xxhash64(*[c for c in files.columns if c != time_col])]
    by = Window.partitionBy(id_col).orderBy(F.col(time_col).desc(), *rest)
    return files.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def merged(old: DataFrame, new: DataFrame, id_col: str = "path") -> DataFrame:
    """Rows of old whose file isn't in new, and all of new."""
    return old.join(new.select(id_col).distinct(), id_col, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert(write: Callable[[DataFrame, int], None], id_col: str = "path", time_col: str = "modificationTime") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: hands on the newest version of each file of the micro-batch."""
    return lambda batch, number: write(newest(batch, id_col, time_col), number)


def counts_by_window(files: DataFrame, time_col: str = "modificationTime", window: str = "1 hour", delay: str | None = "1 day") -> DataFrame:
    """Files and bytes by type and tumbling window; late ones count until the watermark. With
    delay None the files have a watermark already."""
    from .. import routing

    kind = routing.file_type_column(F.col("path"))
    marked = files.withWatermark(time_col, delay) if delay else files
    grouped = marked.groupBy(F.window(time_col, window), kind.alias("file_type"))
    return grouped.agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))
