"""Exact top-k inner-product search by norm-bucketed retrieval.

The queries are the vectors whose id is divisible by `every`; they are searched against all
vectors. Vectors are put in buckets of like length, the longest first, and queries in blocks of
like length. A first round compares every block with the longest bucket, which gives each query
a lower bound theta of its k-th product. In the second round a query goes only to the buckets
that can still hold an answer: those for which theta / (|q| * longest in bucket), the local cosine
threshold, is at most 1. There, queries whose local threshold is high use coordinate pruning
(bounds on the vector's largest coordinates that any vector at that cosine must meet), the
others length pruning (vectors are sorted by length; those under theta / |q| are left out). What
remains is verified by its full product in double precision.

A bucket's matrix travels once for every VISITS blocks of queries, and a query's vector once to
every bucket that it visits; both sizes of a group are bounded, and buckets grow with the table
up to LARGEST, so that less travels.

Defined cases: ids are integers; NULL ids, NULL or empty vectors and vectors with NULL or
non-finite elements take no part; vectors may have any number of dimensions, and only those of
the same are compared; products are rounded to six decimals and ties go to the lesser id; rows
that repeat an id are separate vectors, but no row is a neighbour of its own id; with fewer than
k others a query has fewer rows; zero vectors have product 0 with all; an empty table gives no
rows; the two columns are picked by exact name, and other columns, of any name, take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import BROADCAST_ROWS, cut, fields, maybe_broadcast, parallelism, written

K = 10
#: Every so manieth id is a query.
EVERY = 50
#: Vectors of a bucket: 4096, or more where the table is large; queries of a block, and the
#: blocks that meet a bucket in one task.
BUCKET, LARGEST = 4096, 32768
QUERIES, VISITS = 2048, 8
#: Ranges of lengths at most; larger ranges are split by id.
RANGES = 10_000
#: The longest buckets, one for every dimension, are broadcast up to this number.
MOST_TOPS = 4
#: From this local cosine threshold on, coordinates prune more than lengths.
COORDINATE_FROM = 0.9
FOCUS = 4
_SLACK = 2e-6

ORACLE = f"""
    WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
    p AS (SELECT a.vec_id, b.vec_id AS neighbour_id, round(list_inner_product(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e))
    SELECT vec_id, neighbour_id, score, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbour_id) AS rank FROM p)
    WHERE rank <= {K}
"""


def coordinate_mask(unit: np.ndarray, others: np.ndarray, threshold: float, focus: int = FOCUS) -> np.ndarray:
    """Which unit vectors can have a cosine of at least threshold with unit, by its largest
    coordinates: of a unit x, x_f lies within q_f t +- sqrt((1 - t^2)(1 - q_f^2)), or beyond
    where q_f itself is nearer to x_f than the threshold's angle."""
    mask = np.ones(len(others), bool)
    angle = math.acos(min(1.0, max(-1.0, threshold)))
    for f in np.argsort(-np.abs(unit))[:focus]:
        own = math.acos(min(1.0, max(-1.0, float(unit[f]))))
        low = math.cos(min(math.pi, own + angle)) - 1e-9
        high = math.cos(max(0.0, own - angle)) + 1e-9
        mask &= (others[:, f] >= low) & (others[:, f] <= high)
    return mask


def search_bucket(queries: np.ndarray, query_norms: np.ndarray, theta: np.ndarray, vectors: np.ndarray, norms: np.ndarray, coordinate_from: float = COORDINATE_FROM, apart: tuple[np.ndarray, np.ndarray, int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, vector, product) of all products of at least theta; norms descending. With apart,
    the ids of both sides and k, pairs of one id are left out, and of some queries at a time no
    more is given than what the k-th product in this bucket lets through."""
    longest = float(norms[0])
    reach = query_norms * longest
    alive = np.flatnonzero(reach >= theta - _SLACK)
    local = np.divide(theta[alive], reach[alive], out=np.full(len(alive), -1.0), where=reach[alive] > 0)
    high = local >= coordinate_from
    units = None
    for q in alive[high]:
        if units is None:
            units = np.divide(vectors, norms[:, None], out=np.zeros_like(vectors), where=norms[:, None] > 0)
        # The vectors long enough, and then those within the angle that the longest would need.
        n = int(np.searchsorted(-norms, -(theta[q] - _SLACK) / query_norms[q], side="right"))
        found = np.flatnonzero(coordinate_mask(queries[q] / query_norms[q], units[:n], (theta[q] - _SLACK) / reach[q]))
        scores = vectors[found] @ queries[q]
        hit = scores >= theta[q] - _SLACK
        yield np.full(int(hit.sum()), q), found[hit], scores[hit]
    rest = alive[~high]
    needed = np.divide(theta[rest] - _SLACK, query_norms[rest], out=np.full(len(rest), -np.inf), where=query_norms[rest] > 0)
    lengths = np.searchsorted(-norms, -needed, side="right")
    order = np.argsort(lengths, kind="stable")
    step = max(16, 1_000_000 // max(1, len(vectors)))
    for i in range(0, len(order), step):
        some = rest[order[i : i + step]]
        n = int(lengths[order[i : i + 256]].max())
        scores = queries[some] @ vectors[:n].T
        least = theta[some]
        if apart:
            ids, other_ids, k = apart
            scores[ids[some][:, None] == other_ids[:n]] = -np.inf
            if n > k:
                least = np.maximum(least, np.partition(scores, n - k, axis=1)[:, n - k])
        q, x = np.nonzero(scores >= np.maximum(least - _SLACK, np.finfo(np.float64).min)[:, None])
        yield some[q], x, scores[q, x]


def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Rows that are among the k best of their query: greater rounded score, then lesser id."""
    order = np.lexsort((ids, -score, query))
    ordered = query[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(order) else np.empty(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


def _searched(own: tuple, theta: np.ndarray, other: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, neighbour id, rounded score) of the k best in a bucket that reach theta."""
    ids, vectors, norms = own
    other_ids, other_vectors, other_norms = other
    got = []
    for query, place, score in search_bucket(vectors, norms, theta, other_vectors, other_norms, apart=(ids, other_ids, k)):
        apart = ids[query] != other_ids[place]
        query, found, score = query[apart], other_ids[place[apart]], np.round(score[apart], 6) + 0.0
        # All products of a query come at once, so what isn't among its k best can go at once.
        kept = best(query, found, score, k)
        got.append((query[kept], found[kept], score[kept]))
    return tuple(np.concatenate([g[i] for g in got]) if got else np.empty(0, t) for i, t in enumerate((np.int64, np.int64, np.float64)))


def _matrix(ids: bytes, matrix: bytes, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    vectors = np.frombuffer(matrix, kind).reshape(len(ids), -1).astype(np.float64)
    return ids, vectors, np.sqrt(np.einsum("ij,ij->i", vectors, vectors))


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """(__id, __e, dim, __norm) of the vectors that take part, and the NumPy kind of their elements."""
    found = fields(vectors, __id=id_col, __e=vector_col)
    single = found.schema["__e"].dataType.elementType.simpleString() == "float"
    rows = found.select(F.col("__id").cast("long"), F.col("__e").cast("array<float>" if single else "array<double>")).where("__id IS NOT NULL AND size(__e) > 0 AND NOT exists(__e, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))")
    return rows.withColumn("dim", F.size("__e")).withColumn("__norm", F.sqrt(F.aggregate("__e", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))), "<f4" if single else "<f8"


def buckets(rows: DataFrame, cuts: list[float], size: int) -> DataFrame:
    """One row a bucket: (dim, bucket, longest, n, ids, matrix), vectors by descending length.

    Bounds are lengths, quantiles of all; a range with many equal lengths is split by id.
    """
    bounds = rows.sparkSession.sparkContext.broadcast(np.array(cuts))

    def place(norms: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in norms:
            yield pa.array((len(bounds.value) - np.searchsorted(bounds.value, batch.to_numpy(), side="right")).astype(np.int32))

    # At equal length the vectors are in one range; ranges are numbered from the longest.
    placed = rows.withColumn("__range", F.arrow_udf(place, "int")("__norm"))
    counts = cut(placed.groupBy("dim", "__range").agg(F.count("*").alias("__n")))
    split = placed.join(maybe_broadcast(counts, counts.count()), ["dim", "__range"]).withColumn("__part", F.pmod(F.xxhash64("__id"), F.ceil(F.col("__n") / (1.5 * size))).cast("int"))

    def pack(key, group):
        ids, norms = group.column("__id").to_numpy(), group.column("__norm").to_numpy()
        order = np.lexsort((ids, -norms))
        matrix = group.column("__e").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "rank": pa.array([key[1].as_py()], pa.int32()), "part": pa.array([key[2].as_py()], pa.int32()), "longest": [float(norms.max())], "n": pa.array([len(ids)], pa.int32()), "ids": [ids[order].tobytes()], "matrix": [np.ascontiguousarray(matrix).tobytes()]})

    packed = written(split.groupBy("dim", "__range", "__part").applyInArrow(pack, "dim int, rank int, part int, longest double, n int, ids binary, matrix binary"))
    # There is one row a bucket here, and only its three numbers are sorted.
    numbered = packed.select("dim", "rank", "part", (F.row_number().over(Window.partitionBy("dim").orderBy("rank", "part")) - 1).alias("bucket"))
    return packed.join(maybe_broadcast(cut(numbered), packed.count()), ["dim", "rank", "part"]).drop("rank", "part")


def _results(key: dict, found: tuple[np.ndarray, np.ndarray, np.ndarray], own: np.ndarray) -> pa.RecordBatch:
    """Rows of _FOUND: places of queries in their block, their ids, what was found and its product."""
    place, neighbour, score = found
    n = len(place)
    return pa.RecordBatch.from_arrays([*(pa.array(np.full(n, key[k], np.int32)) for k in ("dim", "block")), pa.array(place.astype(np.int32)), pa.array(own), pa.array(neighbour), pa.array(score)], names=["dim", "block", "place", "query", "found", "score"])


_FOUND = "dim int, block int, place int, query long, found long, score double"


def top_k_neighbours(vectors: DataFrame, k: int = K, every: int = EVERY, size: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, neighbour_id, score, rank) of the k other rows with the greatest products, for every
    row whose id is divisible by `every`."""
    rows, kind = _valid(vectors, id_col, vector_col)
    spark = vectors.sparkSession
    n = rows.count()
    size = size or min(LARGEST, max(BUCKET, n // (4 * parallelism(spark))))
    parts = min(-(-n // size), RANGES)
    cuts = rows.approxQuantile("__norm", [i / parts for i in range(1, parts)], 0.001) if parts > 1 else []
    packed = buckets(rows, sorted(set(cuts)), size)
    # About as many ranges of queries as blocks of them, at quantiles of all vectors.
    step = max(1, parts // max(1, -(-n // (QUERIES * every))))
    asked = buckets(rows.where(F.col("__id") % every == 0), sorted(set(cuts[step - 1 :: step])), QUERIES).select("dim", F.col("bucket").alias("block"), "ids", "matrix")

    first = packed.where("bucket = 0").select("dim", F.col("ids").alias("top_ids"), F.col("matrix").alias("top_matrix"))
    first = maybe_broadcast(first, first.count(), MOST_TOPS)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                own, top = _matrix(row["ids"], row["matrix"], kind), _matrix(row["top_ids"], row["top_matrix"], kind)
                yield _results(row, found := _searched(own, np.full(len(own[0]), -np.inf), top, k), own[0][found[0]])

    early = cut(asked.join(first, "dim").mapInArrow(begin, _FOUND))
    # The k-th product so far, for queries that have so many.
    bounds = early.groupBy("dim", "block", "place").agg(F.count("*").alias("__n"), F.min("score").alias("least")).where(F.col("__n") >= k)
    thetas = bounds.groupBy("dim", "block").agg(F.sort_array(F.collect_list(F.struct("place", "least"))).alias("thetas"))

    # What queries must know of the buckets: the longest vector of each, or of some in a row
    # where there are very many. Buckets are told apart by number when they are visited.
    levels = packed.where("bucket > 0").select("dim", "bucket", "longest", F.expr(f"bucket div {-(-packed.count() // BROADCAST_ROWS)}").alias("level"))
    levels = cut(levels.groupBy("dim", "level").agg(F.max("longest").alias("longest"), F.min("bucket").alias("low"), F.max("bucket").alias("high")).groupBy("dim").agg(F.collect_list(F.struct("longest", "low", "high")).alias("levels")))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, matrix, norms = _matrix(row["ids"], row["matrix"], kind)
                theta = np.full(len(ids), -np.inf)
                for bound in row["thetas"] or ():
                    theta[bound["place"]] = bound["least"]
                # Buckets whose longest vector isn't this long hold no answer.
                need = np.divide(theta - _SLACK, norms, out=np.where(theta <= _SLACK, -np.inf, np.inf), where=norms > 0)
                for level in row["levels"]:
                    alive = np.flatnonzero(need <= level["longest"])
                    if not len(alive):
                        continue
                    held = [alive.astype(np.int32).tobytes(), ids[alive].tobytes(), theta[alive].tobytes(), np.ascontiguousarray(matrix[alive].astype(kind)).tobytes()]
                    for bucket in range(level["low"], level["high"] + 1):
                        yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in (row["dim"], bucket, row["block"] // VISITS, row["block"])), *(pa.array([x], pa.binary()) for x in held)], names=["dim", "bucket", "salt", "block", "places", "ids", "theta", "matrix"])

    visits = asked.join(thetas, ["dim", "block"], "left").join(maybe_broadcast(levels, levels.count(), MOST_TOPS), "dim").mapInArrow(visit, "dim int, bucket int, salt int, block int, places binary, ids binary, theta binary, matrix binary")
    salts = asked.groupBy("dim").agg(F.max(F.expr(f"block div {VISITS}")).alias("last"))
    targets = packed.where("bucket > 0").join(salts, "dim").select("dim", "bucket", F.explode(F.sequence(F.lit(0), F.col("last").cast("int"))).alias("salt"), "ids", "matrix")

    def meet(mine: pa.Table, bucket: pa.Table) -> pa.Table:
        out = []
        if mine.num_rows and bucket.num_rows:
            other = _matrix(bucket.column("ids")[0].as_py(), bucket.column("matrix")[0].as_py(), kind)
            for i in range(mine.num_rows):
                row = mine.slice(i, 1).to_pylist()[0]
                own = _matrix(row["ids"], row["matrix"], kind)
                place, found, score = _searched(own, np.frombuffer(row["theta"], np.float64), other, k)
                out.append(_results(row, (np.frombuffer(row["places"], np.int32)[place], found, score), own[0][place]))
        return pa.Table.from_batches(out, schema=_ARROW)

    late = visits.groupBy("dim", "bucket", "salt").cogroup(targets.groupBy("dim", "bucket", "salt")).applyInArrow(meet, _FOUND)
    order = Window.partitionBy("dim", "block", "place").orderBy(F.col("score").desc(), "found")
    ranked = early.unionByName(late).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias(id_col), F.col("found").alias("neighbour_id"), "score", F.col("rank").cast("int").alias("rank"))


_ARROW = pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("place", pa.int32()), ("query", pa.int64()), ("found", pa.int64()), ("score", pa.float64())])
