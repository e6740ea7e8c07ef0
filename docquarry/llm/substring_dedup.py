"""Passages that repeat, across documents or within one, by prefix-partitioned suffix trees over words.

A passage is a run of at least MIN_WORDS words (split at white space) that also stands in another
document or at another place of its own. Words are compared by 31-bit hashes and prefixes by 64-bit
ones: a passage is a false find only where all its MIN_WORDS words, one after another, meet the
hashes of other words, which no corpus comes near to. The suffixes that can begin in one are found by
sampling that never misses: of the HEAD-word grams in every window of MIN_WORDS words the one with
the least hash is an anchor, so equal windows hold equal anchors at equal places.

1. Anchors are counted by their gram, map side first; those whose gram stands at one place
   alone are dropped.
2. The suffixes at the others are partitioned by prefix. A prefix is the HEAD-word gram; one
   with more than GROUP suffixes is lengthened to all MIN_WORDS words, once for each start
   that a window around the anchor can have.
3. The suffixes of a partition come in the order of their prefixes, and a task holds CHUNK of
   them, or those of one prefix, at a time. They are sorted, with the common prefix of
   neighbours; the runs whose common prefix is at least r words are the nodes of depth r of the
   prefix's suffix tree. Under a node, leaves are joined by their preceding MIN_WORDS - r words:
   two leaves there are one repeated window around the anchor, across documents if their ids
   differ. A lengthened prefix is a node by itself, deep enough for its leaves to be one
   repeated window, so these are only counted, map side first, whatever their number.
4. All windows of an anchor unite to one span a kind, and the spans of a document to its maximal
   repeated passages.

Defined cases: ids are integers; NULL ids and NULL texts take no part; texts under MIN_WORDS words
(empty ones too) have no passage; occurrences may overlap (one word 60 times is a repeat); rows
that repeat an id and text are one document; texts of one id are no other documents to each other,
so what only they share repeats within; of occurrences none is the first or the best, all are
reported; an empty table gives no rows; the two columns are picked by exact name, and other
columns, of any name, take no part. Whole texts are used, however long, and no group is cut short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import Memo, fields, mix64, slices, written

MIN_WORDS = 50
HEAD = 8
GROUP = 200_000
#: Suffixes that a task looks at together.
CHUNK = 50_000

_FACTORS = mix64(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)
_PLACE_BITS = 28


#: No zero low byte: see _sorted_suffixes.
_hashes = Memo(lambda word: xxhash.xxh32_intdigest(word) | 1)


def word_hashes(text: str) -> np.ndarray:
    _hashes.ready()
    words = text.split()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint32, len(words))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of size words."""
    n = len(words) - size + 1
    total = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        wide = words.astype(np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                total += wide[k : k + n] * _FACTORS[k]
    return mix64(total)


def anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """Places that are the first least gram of some window of span grams."""
    if len(grams) < span:
        return np.empty(0, np.int64)
    places = np.arange(len(grams), dtype=np.uint64)
    least = (grams >> np.uint64(_PLACE_BITS)) << np.uint64(_PLACE_BITS) | places
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        rest = span - width
        least = np.minimum(least[:-rest], least[rest:])
    chosen = np.zeros(len(grams), bool)
    chosen[(least & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)] = True
    return np.flatnonzero(chosen)


def _runs(batches: Iterator[pa.RecordBatch], key: str, least: int) -> Iterator[pa.Table]:
    """Rows that come in the order of key, at least so many at a time and no key's rows apart."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < least:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_numpy()
        # Where the last key begins; what is before it is complete.
        last = int(np.flatnonzero(keys != keys[-1]).max(initial=-1)) + 1
        if last:
            yield table.slice(0, last)
        held, n = table.slice(last).to_batches(), n - last
        if not last:
            least = max(least, 2 * n)
    if n:
        yield pa.Table.from_batches(held)


def _repeats(keys: np.ndarray, docs: np.ndarray, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, whether its key is in several documents, and whether it is at several
    suffixes of one document alone."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sizes = np.diff(np.append(edges, len(keys)))

    def several(owner: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(owner[order], edges) != np.maximum.reduceat(owner[order], edges)

    across = several(docs)
    out = []
    for found in (across, several(suffixes) & ~across):
        out.append(np.empty(len(keys), found.dtype))
        out[-1][order] = np.repeat(found, sizes)
    return tuple(out)


def _suffix_ids(rows: pa.Table, place: np.ndarray) -> np.ndarray:
    """A 64-bit name of every row's suffix; rows that repeat an id, text and place share it."""
    doc, digest = (rows.column(c).to_numpy().view(np.uint64) for c in ("__id", "__h"))
    return mix64(doc ^ mix64(digest ^ mix64(place.astype(np.int64).view(np.uint64))))


def _sorted_suffixes(right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes (rows of words) and each one's common prefix with the one before."""
    rows = np.ascontiguousarray(right.astype(">u4"))
    order = np.argsort(rows.view(f"S{rows.shape[1] * 4}").ravel(), kind="stable")
    ordered = right[order]
    differs = ordered[1:] != ordered[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), right.shape[1])
    return order, np.concatenate([[0], common])


def repeated_windows(right: np.ndarray, left: np.ndarray, docs: np.ndarray, suffixes: np.ndarray, min_words: int, head: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every anchor the least and greatest number of words that a repeated window has
    before it; -1 where there is none: first of windows in several documents, then of those
    within one alone. right: the words from the anchor on; left: those before it, the nearest
    first."""
    order, common = _sorted_suffixes(right)
    left, owner, suffixes = left[order].astype(np.uint64), docs[order], suffixes[order]
    bounds = [(np.full(len(order), -1), np.full(len(order), -1)) for _ in range(2)]
    before = np.zeros(len(order), np.uint64)
    with np.errstate(over="ignore"):
        for depth in range(min_words, head - 1, -1):
            back = min_words - depth
            if back:
                before += left[:, back - 1] * _FACTORS[back]
            node = np.cumsum(common < depth).astype(np.uint64)
            across, within = _repeats(mix64(before ^ mix64(node)), owner, suffixes)
            for several, (low, high) in zip((across, within), bounds):
                low[several & (low < 0)] = back
                high[several] = back
    place = np.argsort(order)
    return [(low[place], high[place]) for low, high in bounds]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return fields(docs, __id=id_col, __text=text_col).select(F.col("__id").cast("long"), F.xxhash64("__text").alias("__h"), F.col("__text").cast("string")).where("__id IS NOT NULL AND __text IS NOT NULL")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, head: int = HEAD, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text", kinds: bool = False) -> DataFrame:
    """(id, word_from, word_to, n_words): the maximal runs of words [word_from, word_to) that
    are covered by passages of at least min_words words which stand elsewhere too, in another
    document or in this one. With kinds there is also the column across, and each kind has runs
    of its own: of passages that another document has (true), and that this one alone has."""
    span = min_words - head + 1
    rows = _keyed(docs, id_col, text_col)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            grams, places, sizes = [], [], []
            for text in batch.column(2).to_pylist():
                found = gram_hashes(word_hashes(text), head)
                at = anchors(found, span)
                grams.append(found[at])
                places.append(at)
                sizes.append(len(at))
            if sum(sizes):
                owner = np.repeat(np.arange(batch.num_rows), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner)), pa.array(np.concatenate(places).astype(np.int32))], names=["gram", "__id", "__h", "place"])

    anchor_rows = written(rows.mapInArrow(sample, "gram long, __id long, __h long, place int")).withColumn("__sfx", F.xxhash64("__id", "__h", "place"))
    # Rows that repeat an id, text and place are one suffix.
    grams = anchor_rows.groupBy("gram").agg(F.min("__sfx").alias("__a"), F.max("__sfx").alias("__b"), F.count("*").alias("__n")).where("__a <> __b").select("gram", (F.col("__n") > group).alias("large"))
    wanted = written(anchor_rows.join(grams, "gram").select("__id", "__h", "place", "large"))
    by_doc = wanted.groupBy("__id", "__h").agg(F.collect_set(F.when(~F.col("large"), F.col("place"))).alias("__small"), F.collect_set(F.when(F.col("large"), F.col("place"))).alias("__large"))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                yield from _suffix_rows(one.column(0)[0].as_py(), one.column(1)[0].as_py(), word_hashes(one.column(2)[0].as_py()), np.sort(one.column(3).flatten().to_numpy()).astype(np.int64), min_words, head)

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches, "key", CHUNK):
            owner, place = part.column("__id").to_numpy(), part.column("place").to_numpy()
            words = np.frombuffer(b"".join(part.column("words").to_pylist()), np.uint32).reshape(part.num_rows, -1)
            bounds = repeated_windows(words[:, :min_words], words[:, min_words:], owner, _suffix_ids(part, place), min_words, head)
            for across, (low, high) in zip((True, False), bounds):
                hit = np.flatnonzero(high >= 0)
                kept = part.select(["__id", "__h"]).take(pa.array(hit))
                kept = kept.append_column("word_from", pa.array((place[hit] - high[hit]).astype(np.int32))).append_column("word_to", pa.array((place[hit] - low[hit] + min_words).astype(np.int32)))
                yield from kept.append_column("across", pa.array(np.full(len(hit), across))).to_batches(max_chunksize=100_000)

    texts = rows.join(by_doc, ["__id", "__h"])
    spread = texts.where("size(__small) > 0").select("__id", "__h", "__text", "__small").mapInArrow(suffixes, "key long, __id long, __h long, place int, words binary")
    spans = spread.repartition("key").sortWithinPartitions("key").mapInArrow(trees, "__id long, __h long, word_from int, word_to int, across boolean")
    if not wanted.where("large").isEmpty():

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    one = batch.slice(i, 1)
                    yield from _window_rows(one.column(0)[0].as_py(), one.column(1)[0].as_py(), word_hashes(one.column(2)[0].as_py()), one.column(3).flatten().to_numpy().astype(np.int64), min_words, head)

        found = written(texts.where("size(__large) > 0").select("__id", "__h", "__text", "__large").mapInArrow(windows, "key long, __id long, __h long, word_from int")).withColumn("__sfx", F.xxhash64("__id", "__h", "word_from"))
        nodes = found.groupBy("key").agg(F.min("__sfx").alias("__a"), F.max("__sfx").alias("__b"), (F.min("__id") != F.max("__id")).alias("across")).where("__a <> __b").select("key", "across")
        spans = spans.unionByName(found.join(nodes, "key").select("__id", "__h", "word_from", (F.col("word_from") + min_words).alias("word_to"), "across"))
    apart = ["__id", "__h", *["across"] * kinds]
    mine = Window.partitionBy(*apart).orderBy("word_from", "word_to")
    reach = F.max("word_to").over(mine.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("__new", F.coalesce((F.col("word_from") > reach).cast("int"), F.lit(1)))
    islands = marked.withColumn("__island", F.sum("__new").over(mine.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy(*apart, "__island").agg(F.min("word_from").alias("word_from"), F.max("word_to").alias("word_to"))
    return merged.select(F.col("__id").alias(id_col), "word_from", "word_to", (F.col("word_to") - F.col("word_from")).alias("n_words"), *["across"] * kinds)


def _named(keys: np.ndarray, doc: int, digest: int, place: np.ndarray, name: str, *more: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(place), doc, np.int64)), pa.array(np.full(len(place), digest, np.int64)), pa.array(place.astype(np.int32)), *more], names=["key", "__id", "__h", name, "words"][: 4 + len(more)])


def _suffix_rows(doc: int, digest: int, words: np.ndarray, place: np.ndarray, min_words: int, head: int) -> Iterator[pa.RecordBatch]:
    """The suffixes at these places: min_words words on, and before them those that a window can have."""
    n, grams = len(words), gram_hashes(words, head)
    steps = np.concatenate([np.arange(min_words), -np.arange(1, min_words - head + 1)])
    for low in range(0, len(place), 20_000):
        at = place[low : low + 20_000]
        # Beyond the text's ends stand words of this place alone.
        where = at[:, None] + steps
        inside = (where >= 0) & (where < n)
        own = mix64(np.uint64(digest & (2**64 - 1)) ^ np.uint64(doc & (2**64 - 1)) ^ mix64(np.where(inside, 0, where).astype(np.uint64)))
        content = np.where(inside, words[np.clip(where, 0, n - 1)], (own >> np.uint64(32)).astype(np.uint32) | np.uint32(1))
        size = content.shape[1] * 4
        data = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.arange(0, (len(at) + 1) * size, size, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(content))])
        yield _named(grams[at], doc, digest, at, "place", data)


def _window_rows(doc: int, digest: int, words: np.ndarray, place: np.ndarray, min_words: int, head: int) -> Iterator[pa.RecordBatch]:
    """The windows of min_words words around these places, each once, by their hash."""
    hashes = gram_hashes(words, min_words)
    starts = np.unique(np.concatenate([place - back for back in range(min_words - head + 1)]))
    starts = starts[(starts >= 0) & (starts < len(hashes))]
    for low in range(0, len(starts), 100_000):
        some = starts[low : low + 100_000]
        yield _named(hashes[some], doc, digest, some, "word_from")
