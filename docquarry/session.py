"""Making the library importable on executors."""

from __future__ import annotations

import io
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import SparkSession

_shipped: weakref.WeakSet = weakref.WeakSet()


def _packed() -> bytes:
    root = Path(__file__).resolve().parent
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    return out.getvalue()


def _put(sc: SparkContext, folder: str, name: str, content: bytes) -> str:
    """Write a file by Hadoop's file systems, so that folder may be on any of them."""
    path = sc._jvm.org.apache.hadoop.fs.Path(folder, name)
    stream = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()
    return path.toString()


def ship(spark: SparkSession) -> SparkSession:
    """Add this package's sources to the session's Python files, once for each context. They go
    through the folder that all executors share; a folder of this machine is used only where
    spark.checkpoint.dir is unset, as in tests."""
    sc = spark.sparkContext
    if sc in _shipped:
        return spark
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or f"file://{tempfile.mkdtemp(prefix='docquarry-')}"
    sc.addPyFile(_put(sc, folder, f"docquarry-{uuid.uuid4().hex}.zip", _packed()))
    _shipped.add(sc)
    return spark
