import numpy as np
import pytest

from docquarry.llm import topk_search as K


def brute(rows, k, every=1):
    found = set()
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for i, q in good:
        if i % every:
            continue
        scored = sorted((-round(float(q @ v), 6) + 0.0, j) for j, v in good if j != i and len(v) == len(q))
        for s, j in scored[:k]:
            found.add((i, j, round(-s, 5)))
    return found


def vectors(n, dim, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    lengths = rng.lognormal(0, spread, n)
    v = rng.normal(size=(n, dim))
    v = v / np.linalg.norm(v, axis=1, keepdims=True) * lengths[:, None]
    return [(i, [float(np.float32(x)) for x in row]) for i, row in enumerate(v)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, *["x"] * 9) for i, v in rows], "vec_id long, embedding array<float>, score string, dim string, bucket string, block string, found string, place string, query string, __id string, rank string").repartition(3)


@pytest.mark.parametrize("size, spread, every, queries", [(None, 1.0, 1, K.QUERIES), (40, 1.5, 1, 30), (25, 0.0, 1, 300), (40, 1.5, 7, 4)])
def test_equals_brute_force(spark, monkeypatch, size, spread, every, queries):
    monkeypatch.setattr(K, "QUERIES", queries)
    monkeypatch.setattr(K, "VISITS", 2)
    monkeypatch.setattr(K, "BROADCAST_ROWS", 3 if every > 1 else K.BROADCAST_ROWS)
    rows = vectors(300, 8, 1, spread)
    got = {(r.vec_id, r.neighbour_id, round(r.score, 5)) for r in K.top_k_neighbours(frame(spark, rows), k=5, every=every, size=size).collect()}
    expected = brute(rows, 5, every)
    assert {(a, b) for a, b, _ in got} == {(a, b) for a, b, _ in expected}


def test_coordinate_pruning_keeps_all_within_the_angle():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(2000, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for q in v[:20]:
        for t in (0.5, 0.9, 0.99):
            mask = K.coordinate_mask(q, v, t)
            assert mask[v @ q >= t].all() and (t < 0.9 or mask.mean() < 0.6)


def test_both_prunings_give_the_same(spark):
    rows = vectors(200, 6, 3, 1.0)
    q = np.array([v for _, v in rows])
    norms = np.linalg.norm(q, axis=1)
    order = np.argsort(-norms)
    theta = np.full(200, 0.6)
    found = [sorted((int(a), int(b)) for qs, xs, _ in K.search_bucket(q, norms, theta, q[order], norms[order], limit) for a, b in zip(qs, xs)) for limit in (-2.0, 2.0)]
    assert found[0] == found[1]


def test_edges(spark):
    rows = vectors(30, 4, 4) + [(None, [1.0] * 4), (100, None), (101, []), (102, [1.0, None, 1.0, 1.0]), (103, [float("nan")] * 4), (104, [0.0] * 4), (105, [1.0, 2.0]), (106, [2.0, 1.0]), (7, [9.0] * 4), (7, [9.0] * 4)]
    found = K.top_k_neighbours(frame(spark, rows), k=3, every=1).collect()
    assert {r.neighbour_id for r in found if r.vec_id == 105} == {106}
    assert not any(r.vec_id == r.neighbour_id for r in found) and {r.vec_id for r in found}.isdisjoint({None, 100, 101, 102, 103})
    assert sorted(r.neighbour_id for r in found if r.vec_id == 104) == [0, 1, 2]
    assert K.top_k_neighbours(frame(spark, rows).limit(0)).count() == 0
    # No row is a query.
    assert K.top_k_neighbours(frame(spark, vectors(5, 4, 1)[1:])).count() == 0
