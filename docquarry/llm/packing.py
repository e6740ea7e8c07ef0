"""Best-fit packing planned on the length histogram.

Documents are cut into pieces of at most `capacity` tokens. Only the histogram of piece
lengths (at most `capacity` entries) reaches the driver, where best-fit-decreasing runs on
counts: a group of bins with equal room takes as many pieces of a length as it can at once.
The plan is a list of segments (length, ranks from-to, first bin, pieces a bin, offset) whose
size depends on the capacity alone. Pieces then learn their slot from their rank within their
length; the rank comes from counts by (length, hash bucket), so that a common length isn't
ranked in one place.

Defined cases: ids may be of any type, and NULL ids are packed as well; NULL and empty texts have
no tokens and give no piece; a very long text gives as many pieces as it needs; equal lengths are
ranked by hash bucket, id and position, and repeated rows each get a slot of their own; an empty
table gives an empty plan; the two columns are picked by exact name, and other columns, of any
name, take no part.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import cut, fields, maybe_broadcast, parallelism, slices
from .tokens import DEFAULT_VOCAB, TEXT_BYTES, bpe

CAPACITY = 2048


class Segment(NamedTuple):
    length: int
    rank_from: int
    rank_to: int
    bin_from: int
    per_bin: int
    offset: int


def plan_best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Segment]:
    """Best-fit decreasing over counts; the same bins as placing the pieces one by one."""
    plan: list[Segment] = []
    rooms: list[int] = []  # the distinct free sizes, ascending
    groups: dict[int, list[tuple[int, int]]] = {}  # free size -> [(first bin, bins)]
    bins = 0

    def give(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit {capacity}")
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, count = groups[room].pop(0)
                if not groups[room]:
                    del groups[room]
                    rooms.pop(i)
            else:
                room, first, count = capacity, bins, -(-left // (capacity // length))
                bins += count
            each = room // length
            full, rest = divmod(left, each)
            if full >= count:
                full, rest = count, 0
            took = full * each + rest
            plan.append(Segment(length, rank, rank + took, first, each, capacity - room))
            rank, left = rank + took, left - took
            give(room - each * length, first, full)
            give(room - rest * length, first + full, 1 if rest else 0)
            used = full + bool(rest)
            give(room, first + used, count - used)
    return plan


def piece_lengths(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """(__id, __tokens): the token count of every document that has tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe(vocab)
        for batch in slices(batches, 1024, TEXT_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encode.counts(batch.column(1)), pa.int64())], names=["__id", "__tokens"])

    rows = fields(docs, __id=id_col, __text=text_col).withColumn("__text", F.col("__text").cast("string"))
    return rows.mapInArrow(count, f"__id {rows.schema[0].dataType.simpleString()}, __tokens long").where("__tokens > 0")


def best_fit_pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """(id, piece, token_from, length, bin_id, bin_offset) of every piece of every document."""
    spark = docs.sparkSession
    counted = cut(piece_lengths(docs, capacity, id_col, text_col, vocab))
    pieces = counted.select(
        F.col("__id"),
        F.explode(F.sequence(F.lit(0), F.expr(f"cast((__tokens - 1) div {capacity} as int)"))).alias("piece"),
        "__tokens",
    ).select("__id", "piece", F.least(F.lit(capacity), F.col("__tokens") - F.col("piece") * capacity).cast("int").alias("length"))
    pieces = pieces.withColumn("__bucket", F.pmod(F.xxhash64("__id"), F.lit(parallelism(spark))).cast("int"))
    # At most capacity * buckets rows, whatever the corpus.
    counts = cut(pieces.groupBy("length", "__bucket").agg(F.count("*").alias("__n")))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("__n")).collect()}
    plan = plan_best_fit(histogram, capacity)
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    local = Window.partitionBy("length", "__bucket").orderBy("__id", "piece")
    ranked = pieces.withColumn("__local", F.row_number().over(local)).join(starts, ["length", "__bucket"]).withColumn("__rank", F.col("__start") + F.col("__local") - 1)
    slots = spark.createDataFrame([tuple(s) for s in plan], "length int, rank_from long, rank_to long, bin_from long, per_bin int, offset int")
    placed = ranked.join(maybe_broadcast(slots, len(plan)), "length").where("__rank >= rank_from AND __rank < rank_to")
    return placed.select(
        F.col("__id").alias(id_col),
        "piece",
        (F.col("piece").cast("long") * capacity).alias("token_from"),
        "length",
        F.expr("bin_from + (__rank - rank_from) div per_bin").alias("bin_id"),
        F.expr("cast(offset + ((__rank - rank_from) % per_bin) * length as int)").alias("bin_offset"),
    )
