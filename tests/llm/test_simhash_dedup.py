import numpy as np
import pytest
from conftest import words

from docquarry.llm import simhash_dedup as S


def near(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("tau, held", [(3, S.HELD), (6, 3), (10, S.HELD), (10, 1)])
def test_pairs_equal_brute_force(spark, monkeypatch, tau, held):
    monkeypatch.setattr(S, "HELD", held)
    rng = np.random.default_rng(tau)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sigs = list(base)
    for s in base[:40]:
        for _ in range(3):
            flips = rng.choice(64, rng.integers(1, 14), replace=False)
            sigs.append(s ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64)))
    sigs = np.array([*sigs, sigs[3], sigs[3]], np.uint64)
    df = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sigs.view(np.int64))], "__id long, s0 long").repartition(3)
    got = {tuple(r) for r in S.hamming_pairs(df, tau).select("a", "b").collect()}
    distance = np.bitwise_count(sigs[:, None] ^ sigs)
    assert got == {(i, j) for i in range(len(sigs)) for j in range(i + 1, len(sigs)) if distance[i, j] <= tau}


def test_allocation_spends_the_whole_radius():
    rng = np.random.default_rng(1)
    costs = [np.vstack([np.zeros(50), np.cumsum(rng.random((S.MOST, 50)), axis=0)]) for _ in range(5)]
    levels = S.allocate(costs, 10)
    assert (levels.sum(axis=0) == 11).all()
    chosen = sum(costs[k][levels[k], np.arange(50)] for k in range(5))
    from itertools import product

    best = [min(sum(costs[k][u[k], q] for k in range(5)) for u in product(range(5), repeat=5) if sum(u) == 11) for q in range(3)]
    assert np.allclose(chosen[:3], best)


def test_groups_and_one_stays(make, rng):
    originals = [words(rng, 200) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(originals)]
    rows += [(100 + 10 * i + k, near(rng, t, 3)) for i, t in enumerate(originals[:6]) for k in range(4)]
    rows += [(300, originals[0].upper() + "."), (301, originals[1])]
    docs = make(rows, clash=True)
    pairs = {tuple(r) for r in S.near_duplicates(docs).collect()}
    assert pairs == {(100 + 10 * i + k, i) for i in range(6) for k in range(4)} | {(300, 0), (301, 1)}
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.collect()) == list(range(12))


def test_edges(make, rng):
    text = words(rng, 80)
    rows = [(None, text), (1, None), (2, ""), (3, "!!! ... ?"), (4, text), (4, text), (5, words(rng, 40_000)), (6, text)]
    assert {tuple(r) for r in S.near_duplicates(make(rows)).collect()} == {(6, 4)}
    assert sorted((r.doc_id for r in S.drop_near_duplicates(make(rows)).collect()), key=str) == [1, 2, 3, 4, 4, 5, None]
    assert S.near_duplicates(make([])).count() == 0 and S.drop_near_duplicates(make([])).count() == 0


def test_components_of_a_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (150, 200)], "a long, b long")
    got = dict(map(tuple, S.components(pairs).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100}


def test_signature_ignores_case_order_and_punctuation(rng):
    text = words(rng, 60)
    turned = " ".join(reversed(text.upper().split())) + " !"
    assert (S.signature(text) == S.signature(turned)).all() and S.signature("  ") is None


@pytest.mark.parametrize("verify", [S.VERIFY, 14, 2])
def test_pairs_within_all_bits_equal_brute_force(spark, verify):
    rng = np.random.default_rng(verify)
    assert sum(r + 1 for r in S.word_radii(verify)) == verify + 1
    sigs = list(rng.integers(0, 2**63, (20, 4), dtype=np.uint64))
    for s in sigs[:20]:
        for k in range(5):
            bits = np.zeros(256, np.uint8)
            # All over the signature, or in one or two of its words alone.
            low, high = [(0, 256), (0, 64), (64, 192), (128, 192), (192, 256)][k]
            bits[rng.choice(np.arange(low, high), rng.integers(1, min(verify + 6, 60)), replace=False)] = 1
            sigs.append(s ^ np.packbits(bits, bitorder="little").view(np.uint64))
    sigs = np.array(sigs)
    df = spark.createDataFrame([(i, *map(int, s)) for i, s in enumerate(sigs.view(np.int64))], "__id long, s0 long, s1 long, s2 long, s3 long").repartition(3)
    distance = np.bitwise_count(sigs[:, None] ^ sigs).sum(axis=2)
    got = [tuple(r) for r in S.near_pairs(df, verify).collect()]
    assert sorted(got) == [(i, j) for i in range(len(sigs)) for j in range(i + 1, len(sigs)) if distance[i, j] <= verify]


def test_pairs_whose_first_words_differ_are_found(make, rng):
    while True:
        text = words(rng, 200)
        other = near(rng, text, 22)
        apart = np.bitwise_count(S.signature(text) ^ S.signature(other))
        if apart[0] > 12 and apart.sum() <= S.VERIFY:
            break
    assert {tuple(r) for r in S.near_duplicates(make([(1, text), (2, other)])).collect()} == {(2, 1)}


def test_a_large_group_is_linked_without_all_its_pairs(make, rng, monkeypatch):
    counted = []
    components = S.components
    monkeypatch.setattr(S, "components", lambda pairs: counted.append(pairs.count()) or components(pairs))
    text = words(rng, 300)
    docs = make([(i, near(rng, text, 1)) for i in range(400)] + [(1000 + i, words(rng, 100)) for i in range(20)])
    assert {tuple(r) for r in S.near_duplicates(docs).collect()} == {(i, 0) for i in range(1, 400)}
    # All pairs are 79,800; of each part of each word at most one link for each of its signatures.
    assert counted[0] <= 400 * 4 * 8


@pytest.mark.parametrize("held", [20, 3])
def test_links_join_what_all_pairs_join(spark, monkeypatch, held):
    monkeypatch.setattr(S, "HELD", held)
    rng = np.random.default_rng(held)
    sigs = list(rng.integers(0, 2**63, (30, 4), dtype=np.uint64))
    for _ in range(120):
        bits = np.zeros(256, np.uint8)
        bits[rng.choice(256, rng.integers(20, 60), replace=False)] = 1
        sigs.append(sigs[rng.integers(len(sigs))] ^ np.packbits(bits).view(np.uint64))
    sigs = np.array(sigs)
    df = spark.createDataFrame([tuple(map(int, s)) for s in sigs.view(np.int64)], "s0 long, s1 long, s2 long, s3 long").repartition(3)
    number = {tuple(map(int, s)): i for i, s in enumerate(sigs.view(np.int64))}
    hashed = {r[4]: number[tuple(r)[:4]] for r in df.selectExpr("*", "xxhash64(s0, s1, s2, s3)").collect()}
    got = np.array([(hashed[r.a], hashed[r.b]) for r in S.near_links(df).collect()])
    a, b = np.nonzero(np.bitwise_count(sigs[:, None] ^ sigs).sum(axis=2, dtype=np.int64) <= S.VERIFY)
    assert (S.joined(np.arange(len(sigs)), *got.T) == S.joined(np.arange(len(sigs)), a, b)).all()


def test_arrays_of_words_go_when_another_memo_takes_over():
    from docquarry.llm._util import Memo

    before = S.signature("one two three")
    S.signature(" ".join(f"x{i}" for i in range(100_000)))
    large = S._words.bits.nbytes
    Memo().ready()
    assert not S._words.number and S._words.bits.nbytes < large
    assert (S.signature("one two three") == before).all()
