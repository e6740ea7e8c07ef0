import random
from bisect import bisect_left, insort

from hypothesis import given, settings
from hypothesis import strategies as st

from docquarry.llm import packing as P
from docquarry.llm.tokens import bpe


def one_by_one(lengths, capacity):
    """Best fit decreasing on single pieces: the rooms that are left."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        i = bisect_left(rooms, n)
        room = rooms.pop(i) if i < len(rooms) else capacity
        insort(rooms, room - n)
    return rooms


def rooms_of(plan, capacity):
    used = {}
    for s in plan:
        for k in range(s.rank_to - s.rank_from):
            used.setdefault(s.bin_from + k // s.per_bin, []).append((s.offset + k % s.per_bin * s.length, s.length))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return sorted(capacity - sum(n for _, n in pieces) for pieces in used.values())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_packs_as_piece_by_piece(lengths):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    plan = P.plan_best_fit(histogram, 40)
    assert rooms_of(plan, 40) == one_by_one(lengths, 40)
    assert {n: sum(s.rank_to - s.rank_from for s in plan if s.length == n) for n in histogram} == histogram


def test_all_pieces_get_disjoint_places(make):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(60)))) for i in range(80)] + [(5, "same text"), (5, "same text"), (None, "x y"), (90, None), (91, ""), (92, "long " * 20_000)]
    found = P.best_fit_pack(make(rows, clash=True), capacity=64).collect()
    places = {}
    for r in found:
        assert 0 < r.length <= 64 and r.bin_offset + r.length <= 64 and r.token_from == r.piece * 64
        places.setdefault(r.bin_id, []).append((r.bin_offset, r.length))
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
    counts = [bpe().count(t) for _, t in rows if t]
    pieces = [min(64, n - k) for n in counts for k in range(0, n, 64)]
    assert sorted(r.length for r in found) == sorted(pieces)
    assert len(places) == len(one_by_one(pieces, 64))


def test_empty_table(make):
    assert P.best_fit_pack(make([])).count() == 0
