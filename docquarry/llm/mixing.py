"""Mixing sources to target weights, by blocks of tokens.

1. Each source's documents are packed, partition by partition, into blocks of `block` tokens
   with an end-of-text token after every document; the last block of a partition is filled up
   with end-of-text tokens. Blocks of a source are numbered from 0 over all partitions.
2. For each output shard a multinomial draw, seeded by the shard's number, says how many of
   its slots each source gets.
3. The n-th slot of a source takes block p(n mod N) of its N blocks, where p is a
   pseudorandom permutation (a Feistel network with cycle walking) keyed by source and by the
   epoch n div N. A source is thus used up before any of its blocks comes again.
4. Slots and blocks are joined on (source, block number).

`min_epochs` sets how many slots there are in all: first so many that each source's expected
share, less four standard deviations, is so many times its blocks; then, where the draw gave a
source fewer after all, slots are added until none has fewer. None: as many slots as blocks.
Weights are in proportion to blocks to the power `temperature` unless given.

Defined cases: a NULL source is a source by itself, named "" (as is an empty one); NULL texts count
as empty and give one end-of-text token; a very long text goes on through as many blocks as it
needs; repeated rows are packed one by one; ids may be of any type, and NULL ids stand in doc_ids;
documents, blocks and slots of equal standing keep the order of their partitions; sources without
a weight get none of the slots; an empty table gives no rows; the three columns are picked by
exact name, and of mix_documents' rows all other columns, of any name, are carried along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._util import cut, fields, maybe_broadcast, mix64, parallelism, rows_back, slices, with_row, written
from .tokens import DEFAULT_VOCAB, END_OF_TEXT, TEXT_BYTES, TokenStream, bpe, closed, gathered

BLOCK = 2048
SHARD_SLOTS = 512
SEED = 20


def permute(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """The places of index (each under size) in the permutation of range(size) named by key."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix64(np.arange(1, 5, dtype=np.uint64) + np.uint64(key & (2**64 - 1)))

    def rounds(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (mix64(right ^ k) & mask)
        return left << np.uint64(half) | right

    found = rounds(index.astype(np.uint64))
    out = found >= size
    while out.any():
        found[out] = rounds(found[out])
        out = found >= size
    return found.astype(np.int64)


def source_key(source: str, epoch: int, seed: int) -> int:
    return xxhash.xxh64_intdigest(f"{seed}/{epoch}/{source}")


def shard_counts(shard: int, slots: int, weights: list[float], seed: int) -> np.ndarray:
    return np.random.default_rng([seed, shard]).multinomial(slots, weights)


def pack_blocks(docs: DataFrame, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocab: str = DEFAULT_VOCAB, with_tokens: bool = True) -> DataFrame:
    """(source, part, local, doc_ids, starts, tokens): doc_ids of a block's documents, starts
    those that begin in it; tokens as little-endian 16-bit ids, or NULL if not wanted."""
    rows = fields(docs, __source=source_col, __id=id_col, __text=text_col).select(F.coalesce(F.col("__source").cast("string"), F.lit("")).alias("__source"), "__id", F.coalesce(F.col("__text").cast("string"), F.lit("")))
    kind = rows.schema[1].dataType.simpleString()
    names = ["source", "part", "local", "doc_ids", "starts", "tokens"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = bpe(vocab), TaskContext.get().partitionId()
        streams: dict[str, TokenStream] = {}
        numbers: dict[str, int] = {}

        def emit(source: str, size: int) -> pa.RecordBatch:
            cut = streams[source].cut(size, block)
            n, at = len(cut.blocks), numbers.get(source, 0)
            numbers[source] = at + n
            begun = cut.taken == 0
            starting = np.concatenate([[0], np.cumsum(begun)])[cut.lists].astype(np.int32)
            padded = [np.pad(b, (0, block - len(b)), constant_values=END_OF_TEXT).astype("<u2").tobytes() for b in cut.blocks] if with_tokens else [None] * n
            columns = [
                pa.array([source] * n, pa.string()),
                pa.array(np.full(n, part, np.int32)),
                pa.array(np.arange(at, at + n)),
                pa.ListArray.from_arrays(pa.array(cut.lists), cut.names),
                pa.ListArray.from_arrays(pa.array(starting), cut.names.filter(pa.array(begun))),
                pa.array(padded, pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in slices(batches, 1024, TEXT_BYTES):
            ids, ends = closed(*encoder.batch(batch.column(2)))
            lengths = np.diff(ends, prepend=0)
            coded = batch.column(0).dictionary_encode()
            own = coded.indices.to_numpy()
            order = np.argsort(own, kind="stable")
            edges = np.searchsorted(own[order], np.arange(len(coded.dictionary) + 1))
            for k, source in enumerate(coded.dictionary.to_pylist()):
                mine = order[edges[k] : edges[k + 1]]
                stream = streams.setdefault(source, TokenStream())
                stream.add(ids[gathered(ends[mine] - lengths[mine], lengths[mine])], np.cumsum(lengths[mine]), batch.column(1).take(pa.array(mine)))
                if len(stream) >= block:
                    yield emit(source, len(stream) // block * block)
        for source, stream in streams.items():
            if len(stream):
                yield emit(source, len(stream))

    return rows.mapInArrow(pack, f"source string, part int, local long, doc_ids array<{kind}>, starts array<{kind}>, tokens binary")


def _numbered(blocks: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """The blocks with `block`, their number within the source, and each source's count.

    There is one row for each source and partition in what is summed here.
    """
    sizes = cut(blocks.groupBy("source", "part").agg(F.count("*").alias("n")))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    joined = blocks.join(maybe_broadcast(starts, sizes.count()), ["source", "part"])
    return joined.withColumn("block", F.col("__start") + F.col("local")).drop("__start"), {r[0]: r[1] for r in sizes.groupBy("source").agg(F.sum("n")).collect()}


def target_weights(sizes: dict[str, int], temperature: float = 0.7) -> dict[str, float]:
    powers = {s: n**temperature for s, n in sorted(sizes.items())}
    total = math.fsum(powers.values())
    return {s: p / total for s, p in powers.items()}


def slot_total(sizes: dict[str, int], weights: dict[str, float], min_epochs: float | None) -> int:
    if min_epochs is None:
        return sum(sizes.values())
    return max((math.ceil((min_epochs * n + 4 * math.sqrt(min_epochs * n)) / weights[s]) for s, n in sizes.items() if weights.get(s)), default=0)


def _shard_draws(spark: SparkSession, total: int, shares: list[float], shard_slots: int, seed: int) -> tuple[DataFrame, int, int]:
    """(shard, k, n): the slots of every shard that the k-th share gets; the shards, and the slots of the last."""
    shards = -(-total // shard_slots)
    last = total - (shards - 1) * shard_slots

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = np.repeat(batch.column(0).to_numpy(), len(shares))
            counts = [shard_counts(s, shard_slots if s < shards - 1 else last, shares, seed) for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(np.tile(np.arange(len(shares), dtype=np.int32), batch.num_rows)), pa.array(np.concatenate(counts).astype(np.int64))], names=["shard", "k", "n"])

    return spark.range(shards).mapInArrow(draw, "shard long, k int, n long"), shards, last


def draw_slots(spark: SparkSession, sizes: dict[str, int], weights: dict[str, float], min_epochs: float | None = None, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(shard, slot, source, block, epoch) of every slot of every shard."""
    names = [s for s in sorted(sizes) if weights.get(s)]
    schema = "shard long, slot int, source string, block long, epoch long"
    if not names:
        return spark.createDataFrame([], schema)
    scale = math.fsum(weights[s] for s in names)
    shares = [weights[s] / scale for s in names]
    total = slot_total(sizes, dict(zip(names, shares)), min_epochs)
    while True:
        counts, shards, last = _shard_draws(spark, total, shares, shard_slots, seed)
        if min_epochs is None:
            break
        drawn = {r[0]: r[1] for r in counts.groupBy("k").agg(F.sum("n")).collect()}
        lacking = max((math.ceil((min_epochs * sizes[s] - drawn.get(k, 0)) / shares[k]) for k, s in enumerate(names)), default=0)
        if lacking <= 0:
            break
        total += lacking

    by_source = Window.partitionBy("k").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    by_shard = Window.partitionBy("shard").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("first", F.coalesce(F.sum("n").over(by_source), F.lit(0))).withColumn("place", F.coalesce(F.sum("n").over(by_shard), F.lit(0)))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, k, n, first, place in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if not n:
                    continue
                size = sizes[names[k]]
                draws = np.arange(first, first + n)
                epochs, index = draws // size, draws % size
                found = np.empty(n, np.int64)
                for epoch in np.unique(epochs).tolist():
                    mine = epochs == epoch
                    found[mine] = permute(index[mine], size, source_key(names[k], epoch, seed))
                slots = permute(np.arange(place, place + n), shard_slots if shard < shards - 1 else last, source_key("", shard, seed))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard, np.int64)), pa.array(slots.astype(np.int32)), pa.array([names[k]] * n, pa.string()), pa.array(found), pa.array(epochs)], names=["shard", "slot", "source", "block", "epoch"])

    return placed.select("shard", "k", "n", "first", "place").repartition(parallelism(spark), "shard").mapInArrow(fill, schema)


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7, min_epochs: float | None = None, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED, vocab: str = DEFAULT_VOCAB, **names: str) -> DataFrame:
    """(shard, slot, source, block, epoch, doc_ids, tokens) of the mixed blocks."""
    blocks, sizes = _numbered(written(pack_blocks(docs, block, vocab=vocab, **names)))
    weights = weights or target_weights(sizes, temperature)
    slots = draw_slots(docs.sparkSession, sizes, weights, min_epochs, shard_slots, seed)
    # Slots grow with the corpus, though the planner takes what is made of a range for small.
    return slots.hint("merge").join(blocks.select("source", "block", "doc_ids", "tokens"), ["source", "block"]).select("shard", "slot", "source", "block", "epoch", "doc_ids", "tokens")


def mix_documents(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7, min_epochs: float | None = 1.0, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED, vocab: str = DEFAULT_VOCAB, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Whole documents in the mixed proportions: a document goes wherever the block does in
    which it begins, so it occurs once for every slot of that block. Columns as in docs; rows
    with a NULL id stay as they are. With min_epochs of at least 1 every block has a slot, so no
    document is left out; else those are whose block drew none, and those of sources without weight."""
    meta = written(pack_blocks(docs, block, id_col, text_col, source_col, vocab, with_tokens=False).select("source", "part", "local", "starts"))
    blocks, sizes = _numbered(meta)
    slots = draw_slots(docs.sparkSession, sizes, weights or target_weights(sizes, temperature), min_epochs, shard_slots, seed)
    uses = slots.groupBy("source", "block").agg(F.count("*").cast("int").alias("__uses"))
    # The planner takes what is made of a range for small; these sides grow with the corpus.
    per_row = uses.hint("merge").join(blocks.select("source", "block", "starts"), ["source", "block"]).select(F.explode("starts").alias("__dq_id"), "__uses")
    most = per_row.where("__dq_id IS NOT NULL").groupBy("__dq_id").agg(F.max("__uses").alias("__uses"))
    rows = with_row(docs, __dq_id=id_col).join(most.hint("merge"), "__dq_id", "left")
    copies = F.expr("CASE WHEN __dq_id IS NULL THEN array(1) WHEN __uses IS NULL THEN array() ELSE sequence(1, __uses) END")
    return rows_back(rows.withColumn("__copy", F.explode(copies)), docs.columns)
