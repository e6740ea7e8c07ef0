"""Exact dedup by a Golomb-coded fingerprint exchange.

Every partition sorts the 64-bit fingerprints of its texts, splits them by owner (a range
of the hash space) and sends each owner one Golomb-Rice-coded message. Owners count
fingerprints over all messages and answer with a bitmap per message. The fingerprints themselves
stay in their checkpointed partition, which is put together with its own bitmaps, partition by
partition, by the JVM; nothing but messages and bitmaps is exchanged. Owners are so many that each counts
OWNER_ROWS fingerprints or fewer. Only rows whose bit is set (suspects) have their texts moved,
and those are compared byte by byte.

Defined cases: ids may be of any type; a row whose id or text is NULL takes part in nothing and
stays; empty texts are equal to each other; texts are compared whole, however long; of equal
texts the row with the least id stays, and of several equal rows with that id exactly one; an
empty table gives no pairs; the two columns are picked by exact name, and other columns, of any
name, are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._util import beside, cut, fields, maybe_broadcast, parallelism, release, rows_back, with_row


#: Fingerprints that an owner counts.
OWNER_ROWS = 4_000_000


def golomb_encode(values: np.ndarray, low: int, span: int) -> bytes:
    """Sorted unsigned integers from low on, as Golomb-Rice-coded gaps.

    Layout: count (8 bytes), parameter (1), unary bits length (8), unary bits, remainders.
    Unary parts and remainders are separate streams, so that both ends work on arrays.
    """
    n = len(values)
    k = max(0, int(span // max(n, 1)).bit_length() - 1)
    gaps = np.diff(values, prepend=np.uint64(low))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1)
    unary = np.ones(int(ends[-1]) if n else 0, np.uint8)
    unary[ends - 1] = 0
    shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
    bits = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    head = np.array([n, len(unary)], np.uint64).tobytes() + bytes([k])
    return head + np.packbits(unary).tobytes() + np.packbits(bits.ravel()).tobytes()


def golomb_decode(message: bytes, low: int) -> np.ndarray:
    n, length = (int(x) for x in np.frombuffer(message, np.uint64, 2))
    k = message[16]
    middle = 17 + (length + 7) // 8
    unary = np.unpackbits(np.frombuffer(message, np.uint8)[17:middle], count=length)
    gaps = np.diff(np.flatnonzero(unary == 0), prepend=-1).astype(np.uint64) - np.uint64(1)
    rest = np.unpackbits(np.frombuffer(message, np.uint8)[middle:], count=n * k).reshape(n, k)
    gaps <<= np.uint64(k)
    for i in range(k):
        gaps |= rest[:, i].astype(np.uint64) << np.uint64(k - 1 - i)
    with np.errstate(over="ignore"):
        return np.cumsum(gaps, dtype=np.uint64) + np.uint64(low)


def _bounds(owners: int) -> list[int]:
    return [(i << 64) // owners for i in range(owners + 1)]


def _split(hashes: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes in order, and where each owner's run begins."""
    ordered = np.sort(hashes)
    cuts = np.searchsorted(ordered, np.array(_bounds(owners)[1:-1], np.uint64))
    return ordered, np.concatenate([[0], cuts, [len(ordered)]]).astype(np.int64)


def _fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return fields(docs, __dq_id=id_col, __dq_text=text_col).where("__dq_id IS NOT NULL AND __dq_text IS NOT NULL").withColumn("__dq_h", F.xxhash64("__dq_text"))


def suspects(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__dq_id, __dq_h) of the rows whose fingerprint occurs more than once."""
    spark = docs.sparkSession
    prints = _fingerprints(docs, id_col, text_col).select("__dq_id", "__dq_h")
    prints_schema = T.StructType([T.StructField("__dq_id", prints.schema["__dq_id"].dataType), T.StructField("__dq_h", T.LongType())])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The partition as one row, so that it can be put beside its bitmaps."""
        out, n = pa.BufferOutputStream(), 0
        schema = to_arrow_schema(prints_schema)
        with pa.ipc.new_stream(out, schema) as stream:
            for b in batches:
                stream.write_batch(b.cast(schema))
                n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n]), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["part", "n", "rows"])
        release()

    # Each step that runs Python ends in a checkpoint or an exchange, so that a task has one
    # worker at a time: workers of steps that wait on each other stay beside their JVM.
    held = cut(prints.mapInArrow(whole, "part int, n long, rows binary"))
    n = held.agg(F.sum("n")).first()[0]
    if not n:
        return spark.createDataFrame([], prints_schema)
    owners = max(parallelism(spark), -(-n // OWNER_ROWS))
    bounds = _bounds(owners)

    def unpacked(rows: pa.Scalar) -> tuple[pa.Table, np.ndarray]:
        mine = pa.ipc.open_stream(rows.as_buffer()).read_all()
        return mine, mine.column(1).to_numpy().view(np.uint64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                ordered, at = _split(unpacked(rows)[1], owners)
                to = np.flatnonzero(np.diff(at))
                messages = [golomb_encode(ordered[at[o] : at[o + 1]], bounds[o], bounds[o + 1] - bounds[o]) for o in to.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(np.full(len(to), part, np.int32)), pa.array(messages, pa.binary())], names=["owner", "part", "message"])
        release()

    def answer(group: pa.Table) -> pa.Table:
        low = bounds[group.column("owner")[0].as_py()]
        hashes = [golomb_decode(m.as_py(), low) for m in group.column("message")]
        found, counts = np.unique(np.concatenate(hashes), return_counts=True)
        twice = found[counts > 1]
        bitmaps = [np.packbits(np.isin(h, twice)).tobytes() for h in hashes]
        return pa.table({"part": group.column("part"), "owner": group.column("owner"), "bitmap": pa.array(bitmaps, pa.binary())})

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All bitmaps of a partition as one row; none for a partition without rows."""
        got = [(o, m) for b in batches for o, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([[o for o, _ in got]], pa.list_(pa.int32())), pa.array([[m for _, m in got]], pa.list_(pa.binary()))], names=["owners", "bitmaps"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, to, bitmaps in zip(*batch.columns):
                mine, hashes = unpacked(rows)
                order = np.argsort(hashes, kind="stable")
                _, at = _split(hashes, owners)
                flags = np.zeros(len(hashes), bool)
                for owner, bitmap in zip(to.as_py(), bitmaps.as_py()):
                    low, high = at[owner], at[owner + 1]
                    flags[low:high] = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=high - low)
                yield from mine.take(pa.array(np.sort(order[flags]))).to_batches()
        release()

    messages = held.select("part", "rows").mapInArrow(send, "owner int, part int, message binary")
    bitmaps = messages.groupBy("owner").applyInArrow(answer, "part int, owner int, bitmap binary")
    replies = cut(bitmaps.repartitionById(held.rdd.getNumPartitions(), F.col("part")).mapInArrow(gathered, "owners array<int>, bitmaps array<binary>"))
    return cut(beside(held.select("rows"), replies).select("a.rows", "b.owners", "b.bitmaps").mapInArrow(mark, prints_schema))


def _verified(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The suspects, and (__dq_id, __dq_h, __dq_keep) of every one whose text an earlier id has."""
    found = suspects(docs, id_col, text_col)
    wanted = found.distinct()
    texts = _fingerprints(docs, id_col, text_col).join(maybe_broadcast(wanted, found.count()), ["__dq_id", "__dq_h"], "left_semi")
    # Equal texts are folded before the exchange: a text with a million copies moves once a map task.
    groups = texts.groupBy("__dq_h", "__dq_text").agg(F.min("__dq_id").alias("__dq_keep"))
    classes = groups.groupBy("__dq_h").agg(F.count("*").alias("__n"), F.min("__dq_keep").alias("__dq_keep"))
    classes = cut(classes)
    sure = wanted.join(classes.where("__n = 1").drop("__n"), "__dq_h").where("__dq_id <> __dq_keep")
    # Different texts with one fingerprint: these few are matched on the text itself.
    clash = classes.where("__n > 1").select("__dq_h")
    if clash.isEmpty():
        return found, sure.select("__dq_id", "__dq_h", "__dq_keep")
    mixed = texts.join(clash, "__dq_h", "left_semi").withColumn("__dq_keep", F.min("__dq_id").over(Window.partitionBy("__dq_h", "__dq_text"))).where("__dq_id <> __dq_keep").select("__dq_id", "__dq_h", "__dq_keep").distinct()
    return found, sure.select("__dq_id", "__dq_h", "__dq_keep").unionByName(mixed)


def duplicate_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id) of every document whose whole text a document with a lesser id has."""
    _, pairs = _verified(docs, id_col, text_col)
    return pairs.select(F.col("__dq_id").alias(id_col), F.col("__dq_keep").alias("keep_id")).distinct()


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without repeats of a text, all columns kept."""
    found, pairs = _verified(docs, id_col, text_col)
    pairs = cut(pairs.select("__dq_id", "__dq_h").distinct())
    repeated = cut(found.groupBy("__dq_id", "__dq_h").count().where("count > 1").select("__dq_id", "__dq_h"))
    n_pairs, n_repeated = pairs.count(), repeated.count()
    rows = with_row(docs, __dq_id=id_col, __dq_text=text_col).withColumn("__dq_h", F.xxhash64("__dq_text"))
    kept = rows.join(maybe_broadcast(pairs, n_pairs), ["__dq_id", "__dq_h"], "left_anti")
    if not n_repeated:
        return rows_back(kept, docs.columns)
    once = kept.join(maybe_broadcast(repeated, n_repeated), ["__dq_id", "__dq_h"], "left_anti")
    again = kept.join(maybe_broadcast(repeated, n_repeated), ["__dq_id", "__dq_h"], "left_semi").dropDuplicates(["__dq_id", "__dq_text"])
    return rows_back(once.unionByName(again), docs.columns)
