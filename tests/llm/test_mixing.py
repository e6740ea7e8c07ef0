from array import array
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docquarry.llm import mixing as M
from docquarry.llm._util import cut
from docquarry.llm.tokens import END_OF_TEXT, bpe


@pytest.mark.parametrize("size", [1, 2, 3, 17, 256, 1000])
def test_permutation(size):
    assert sorted(M.permute(np.arange(size), size, 12345).tolist()) == list(range(size))
    if size > 100:
        assert M.permute(np.arange(size), size, 1).tolist() != M.permute(np.arange(size), size, 2).tolist()


def docs_of(rng, make, n=60, clash=False):
    rows = [(i, " ".join(f"word{rng.randrange(50)}" for _ in range(rng.randrange(0, 90))), f"s{i % 3}" if i % 7 else None) for i in range(n)]
    return rows, make(rows, clash)


def test_blocks_hold_all_tokens(make, rng):
    rows, docs = docs_of(rng, make)
    found = M.pack_blocks(docs, block=32).collect()
    assert all(len(r.tokens) == 64 for r in found)
    got = Counter(t for r in found for t in array("H", r.tokens) if t != END_OF_TEXT)
    encode = bpe()
    assert got == Counter(t for _, text, _ in rows for t in array("H", encode.ids(text)))
    assert sorted(i for r in found for i in r.starts) == sorted(i for i, *_ in rows)


def test_mix_follows_the_weights_and_the_permutation(make, rng):
    _, docs = docs_of(rng, make)
    weights = {"s0": 0.5, "s1": 0.3, "s2": 0.2}
    found = M.mix_sources(docs, weights, block=16, shard_slots=20, min_epochs=3.0).collect()
    assert {(r.shard, r.slot) for r in found} == {(s, i) for s in {r.shard for r in found} for i in range(max(r.slot for r in found if r.shard == s) + 1)}
    assert len({(r.shard, r.slot) for r in found}) == len(found)
    for shard in {r.shard for r in found}:
        mine = [r for r in found if r.shard == shard]
        assert [sum(r.source == s for r in mine) for s in sorted(weights)] == M.shard_counts(shard, len(mine), [0.5, 0.3, 0.2], M.SEED).tolist()
    for source in weights:
        uses = Counter((r.epoch, r.block) for r in found if r.source == source)
        assert max(uses.values()) == 1
        blocks = {b for e, b in uses if e == 0}
        assert blocks == set(range(len(blocks)))


def test_documents_come_at_least_once(make, rng):
    rows, docs = docs_of(rng, make, clash=True)
    mixed = M.mix_documents(docs, temperature=0.5, min_epochs=1.0, block=64)
    assert mixed.columns == docs.columns
    got = mixed.collect()
    assert {r[0] for r in got} == {i for i, *_ in rows}
    assert all(r[5] == f"__dq_id-{r[0]}" for r in got)
    most = Counter(r[0] for r in got)
    assert max(most.values()) >= 1


def test_null_ids_repeats_and_empty_tables(make):
    rows = [(None, "a b", "x"), (1, None, "x"), (2, "", None), (3, "c", "x"), (3, "c", "x"), (4, "long " * 30_000, "y")]
    got = Counter(r.doc_id for r in M.mix_documents(make(rows), block=64).collect())
    assert got[None] == 1 and {1, 2, 3, 4} <= set(got)
    assert M.mix_sources(make(rows), block=64).count() > 0
    assert M.mix_sources(make([])).count() == 0 and M.mix_documents(make([])).count() == 0


def test_sources_without_weight_get_no_slot(make):
    docs = make([(1, "a b c", "x"), (2, "d e f", "y")])
    assert {r.source for r in M.mix_sources(docs, {"x": 1.0}, block=4).collect()} == {"x"}


@pytest.mark.parametrize("epochs", [1.0, 2.0])
def test_every_source_is_used_whole_whatever_the_draw(spark, epochs):
    sizes, weights = {"a": 30, "b": 1}, {"a": 0.9, "b": 0.1}
    total = M.slot_total(sizes, weights, epochs)

    def drawn(seed, source):
        shards = -(-total // 20)
        return sum(M.shard_counts(s, min(20, total - 20 * s), [0.9, 0.1], seed)[source] for s in range(shards))

    # A seed whose first draw gives the small source too few.
    seed = next(s for s in range(100_000) if drawn(s, 1) < epochs)
    found = M.draw_slots(spark, sizes, weights, epochs, shard_slots=20, seed=seed).collect()
    assert all(sum(r.source == s for r in found) >= epochs * n for s, n in sizes.items())
    assert {(r.source, r.block) for r in found} == {("b", 0)} | {("a", i) for i in range(30)}
    assert len({(r.shard, r.slot) for r in found}) == len(found) > total


def feistel(x, size, key):
    """The permutation of range(size), a number at a time."""

    def mix(v):
        v &= 2**64 - 1
        v = (v ^ v >> 30) * 0xBF58476D1CE4E5B9 & 2**64 - 1
        v = (v ^ v >> 27) * 0x94D049BB133111EB & 2**64 - 1
        return v ^ v >> 31

    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    while True:
        left, right = x >> half, x & 2**half - 1
        for k in range(1, 5):
            left, right = right, left ^ mix(right ^ mix(k + key)) & 2**half - 1
        x = left << half | right
        if x < size:
            return x


def brute(parts, weights, total, block, shard_slots, seed):
    """(shard, slot) -> (source, block, epoch, doc_ids, tokens), one slot at a time. parts: the rows
    (doc_id, text, source) of every partition, in order."""
    encode, held = bpe(), {}
    for part in parts:
        streams = {}
        for doc, text, source in part:
            ids = [*array("H", encode.ids(text or "")), END_OF_TEXT]
            streams.setdefault(source or "", []).extend((t, doc) for t in ids)
        for source, stream in streams.items():
            for i in range(0, len(stream), block):
                piece = stream[i : i + block]
                tokens = [t for t, _ in piece] + [END_OF_TEXT] * (block - len(piece))
                held.setdefault(source, []).append((list(dict.fromkeys(d for _, d in piece)), array("H", tokens).tobytes()))
    names = [s for s in sorted(held) if weights.get(s)]
    scale = sum(weights[s] for s in names)
    given = dict.fromkeys(names, 0)
    out = {}
    for shard in range(-(-total // shard_slots)):
        size = min(shard_slots, total - shard * shard_slots)
        place = 0
        for source, n in zip(names, np.random.default_rng([seed, shard]).multinomial(size, [weights[s] / scale for s in names])):
            for _ in range(n):
                epoch, index = divmod(given[source], len(held[source]))
                number = feistel(index, len(held[source]), xxhash.xxh64_intdigest(f"{seed}/{epoch}/{source}"))
                out[shard, feistel(place, size, xxhash.xxh64_intdigest(f"{seed}/{shard}/"))] = (source, number, epoch, *held[source][number])
                given[source] += 1
                place += 1
    return out


def test_mix_equals_brute_force(spark, make, rng):
    rows = [(i, " ".join(f"word{rng.randrange(50)}" for _ in range(rng.randrange(0, 60))), ["a", "b", "c", None][i % 4]) for i in range(50)] + [(51, None, "a"), (52, "", "b"), (53, "long " * 3000, "c"), (7, "again", "a"), (7, "again", "a")]
    docs = cut(make(rows, clash=True))  # so that its partitions are the same in both
    parts = [[(r[0], r[1], r[3]) for r in p] for p in docs.rdd.glom().collect()]
    weights = {"a": 0.5, "b": 0.2, "c": 0.2, "": 0.1}
    found = M.mix_sources(docs, weights, block=32, shard_slots=20).collect()
    expected = brute(parts, weights, len(found), 32, 20, M.SEED)
    assert {(r.shard, r.slot): (r.source, r.block, r.epoch, list(r.doc_ids), bytes(r.tokens)) for r in found} == expected and len(found) == len(expected)


@pytest.mark.parametrize("seed", range(6))
def test_no_document_is_lost_whatever_the_seed(make, rng, seed):
    rows = [(f"id{i}", "word " * rng.randrange(40), f"s{i % 5 // 4}") for i in range(40)]
    docs = make([(i, t, s) for i, (_, t, s) in enumerate(rows)]).withColumn("doc_id", F.concat(F.lit("id"), F.col("doc_id")))
    got = M.mix_documents(docs, temperature=0.9, min_epochs=1.0, block=16, shard_slots=8, seed=seed).collect()
    assert {r.doc_id for r in got} == {i for i, _, _ in rows}
