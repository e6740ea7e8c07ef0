import numpy as np
import pyarrow as pa
import pytest
from conftest import words

from docquarry.llm import substring_dedup as S


def brute(rows, least):
    """Words covered by a window of `least` words that a document of another id has too."""
    owners, out = {}, set()
    texts = {(i, t) for i, t in rows if i is not None and t is not None}
    for i, t in texts:
        w = t.split()
        for k in range(len(w) - least + 1):
            owners.setdefault(tuple(w[k : k + least]), set()).add(i)
    for i, t in texts:
        w, covered = t.split(), set()
        for k in range(len(w) - least + 1):
            if len(owners[tuple(w[k : k + least])]) > 1:
                covered |= set(range(k, k + least))
        # Windows that touch without a common word stay two passages only if no window joins them.
        start = None
        for k in range(len(w) + 1):
            if k in covered and start is None:
                start = k
            elif k not in covered and start is not None:
                out.add((i, start, k, k - start))
                start = None
    return out


def planted(rng):
    shared, longer = words(rng, 12), words(rng, 30)
    rows = [(i, words(rng, 40)) for i in range(20)]
    rows += [(20 + i, f"{words(rng, 9 + i)} {shared} {words(rng, 7)}") for i in range(6)]
    rows += [(30 + i, f"{words(rng, 5)} {longer} {words(rng, 11)} {shared}") for i in range(4)]
    rows += [(40, shared + " " + shared), (41, " ".join(longer.split()[4:20])), (42, words(rng, 2000) + " " + longer), (43, "same " * 60), (44, "same " * 45)]
    return rows + [(None, shared), (50, None), (51, ""), (52, "short one"), rows[0], rows[-1]]


@pytest.mark.parametrize("group", [S.GROUP, 3])
def test_passages_equal_brute_force(make, rng, group):
    rows = planted(rng)
    found = S.repeated_passages(make(rows, clash=True), min_words=10, head=4, group=group).collect()
    got = {tuple(r) for r in found}
    assert len(got) == len(found)
    assert got == brute(rows, 10)


def test_production_parameters(make, rng):
    shared = words(rng, 60)
    rows = [(1, words(rng, 100) + " " + shared), (2, shared + " " + words(rng, 30)), (3, words(rng, 300)), (4, " ".join(shared.split()[:49]))]
    assert {tuple(r) for r in S.repeated_passages(make(rows)).collect()} == {(1, 100, 160, 60), (2, 0, 60, 60)}


def test_anchors_cover_every_window(rng):
    grams = S.mix64(np.array([rng.randrange(2**40) for _ in range(500)], np.uint64))
    at = set(S.anchors(grams, 43).tolist())
    assert all(any(k in at for k in range(i, i + 43)) for i in range(500 - 43 + 1))
    assert not len(S.anchors(grams[:10], 43))


def test_runs_keep_keys_together():
    keys = [1] * 3 + [2] + [3] * 9 + [4, 5, 5]
    batches = [pa.record_batch({"key": pa.array(keys[i : i + 2], pa.int64())}) for i in range(0, len(keys), 2)]
    found = [t.column("key").to_pylist() for t in S._runs(iter(batches), "key", 4)]
    assert sum(found, []) == keys and all(not set(a) & set(b) for a, b in zip(found, found[1:])) and len(found) > 2


def test_very_long_texts(make, rng, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 100)
    shared = words(rng, 60, 10**6)
    long = f"{words(rng, 150_000, 10**6)} {shared} {words(rng, 50_000, 10**6)}"
    rows = [(1, long), (2, f"{words(rng, 10, 10**6)} {shared}"), (3, "z" * 500_000)]
    for group in (S.GROUP, 1):
        assert {tuple(r) for r in S.repeated_passages(make(rows), group=group).collect()} == {(1, 150_000, 150_060, 60), (2, 10, 70, 60)}


def test_empty_table(make):
    assert S.repeated_passages(make([])).count() == 0


def brute_kinds(rows, least):
    """Runs of words covered by windows that another id has (True), or that stand at several
    places of one id's texts alone (False)."""
    places, out = {}, set()
    texts = {(i, t) for i, t in rows if i is not None and t is not None}
    for i, t in texts:
        w = t.split()
        for k in range(len(w) - least + 1):
            places.setdefault(tuple(w[k : k + least]), set()).add((i, t, k))
    for i, t in texts:
        w = t.split()
        covered = {True: set(), False: set()}
        for k in range(len(w) - least + 1):
            found = places[tuple(w[k : k + least])]
            if len(found) > 1:
                covered[len({j for j, _, _ in found}) > 1] |= set(range(k, k + least))
        for across, mine in covered.items():
            for start in sorted(k for k in mine if k - 1 not in mine):
                end = start
                while end in mine:
                    end += 1
                out.add((i, start, end, end - start, across))
    return out


@pytest.mark.parametrize("group", [S.GROUP, 3])
def test_repeats_within_a_document(make, rng, group):
    own, both, split = words(rng, 14), words(rng, 13), words(rng, 12)
    rows = [(1, f"{words(rng, 9)} {own} {words(rng, 20)} {own} {words(rng, 5)} {own}"), (2, words(rng, 60)), (3, f"{both} {words(rng, 8)} {both}"), (4, f"{words(rng, 6)} {both}")]
    rows += [(5, "one " * 40), (6, f"{split} {words(rng, 9)}"), (6, f"{words(rng, 4)} {split}"), (7, words(rng, 25)), (8, "a b c d e " * 9)]
    rows += [rows[1], rows[1], rows[7]]
    docs = make(rows, clash=True)
    found = S.repeated_passages(docs, min_words=10, head=4, group=group, kinds=True).collect()
    expected = brute_kinds(rows, 10)
    assert found[0].asDict().keys() == {"doc_id", "word_from", "word_to", "n_words", "across"}
    assert {tuple(r) for r in found} == expected and len(found) == len(expected)
    assert {(r[0], r[4]) for r in expected} == {(1, False), (3, True), (4, True), (5, False), (6, False), (8, False)}
    assert {1, 3, 4, 5, 6, 8} == {r.doc_id for r in S.repeated_passages(docs, min_words=10, head=4, group=group).collect()}
