"""Files as rows, by Spark's binary source, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import routing
from ..formats.dispatch import MAX_FILE_SIZE
from ..operators import extract
from ..operators.relational import FileFilter

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def files(spark: SparkSession, path: str | Sequence[str], recursive: bool = True, glob: str | None = None, modified_after: str | None = None, modified_before: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content). Names and times are tested at listing, before
    a byte is read; times are of the form 2024-01-31T00:00:00."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    for key, value in (("pathGlobFilter", glob), ("modifiedAfter", modified_after), ("modifiedBefore", modified_before)):
        if value:
            reader = reader.option(key, value)
    return reader.load([path] if isinstance(path, str) else list(path))


def supported(found: DataFrame, max_file_size: int = MAX_FILE_SIZE) -> DataFrame:
    """Files with a reader, up to a size (0: any). Sizes are tested before the content is read; so
    are names where the files are listed with routing.supported_glob()."""
    kept = found.where(routing.file_type_column(F.col("path")).isNotNull())
    return kept.where(F.col("length") <= max_file_size) if max_file_size else kept


def read_documents(spark: SparkSession, path: str | Sequence[str], test: FileFilter | None = None, binary: bool = False, attachments: bool = False, max_file_size: int = MAX_FILE_SIZE) -> DataFrame:
    """Documents of all supported files below a path; others aren't read. Files that are too large
    give error rows."""
    found = supported(files(spark, path, glob=routing.supported_glob()), 0)
    if test:
        found = test.apply(found, "modificationTime", "modificationTime", "path")
    # Oversized files keep their row, but their content isn't moved to a worker.
    if max_file_size:
        big = found.where(F.col("length") > max_file_size).select("path", F.col("length").alias("__n"))
        failed = big.select("path", F.lit(0).alias("doc_idx"), F.struct(F.lit("too_large").alias("kind"), F.format_string(f"%d bytes are more than the {max_file_size} allowed", "__n").alias("message")).alias("error"))
        docs = extract.documents(found.where(F.col("length") <= max_file_size), binary, attachments, max_file_size)
        return docs.unionByName(failed, allowMissingColumns=True)
    return extract.documents(found, binary, attachments, 0)


def file_stream(spark: SparkSession, path: str, glob: str | None = None, per_trigger: int = 1000) -> DataFrame:
    """Files as they arrive, at most so many a micro-batch."""
    reader = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)
