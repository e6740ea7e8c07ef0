from array import array

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docquarry.llm import token_binary as B
from docquarry.llm.tokens import END_OF_TEXT, bpe


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0, 1, 2, 7, 300, 50256, 65535]), max_size=400), min_size=1, max_size=4))
def test_block_round_trip(blocks):
    coded = B.encode_blocks([np.array(b, np.int64) for b in blocks])
    assert [B.decode_block(c, len(b)).tolist() for c, b in zip(coded, blocks)] == blocks


def test_blocks_are_coded_independently(rng):
    blocks = [np.array([rng.randrange(2000) for _ in range(n)]) for n in (2048, 1, 777, 2048)]
    together = B.encode_blocks(blocks)
    assert [B.encode_blocks([b])[0] for b in blocks] == together
    assert B.encode_blocks(blocks, group=2) == together


def test_damage_is_noticed():
    coded = B.encode_blocks([np.arange(100)])[0]
    import zlib

    with pytest.raises(ValueError):
        B.decode_block(coded[:-1] + bytes([coded[-1] ^ 1]), 100, zlib.crc32(coded))


def test_repeats_take_less_than_half():
    ids = np.array(list(range(200)) * 10)
    assert len(B.encode_blocks([ids])[0]) < len(ids)


def test_corpus_round_trip(make):
    rows = [(1, "hello world " * 50), (2, ""), (3, None), (None, "no id"), (4, "text"), (4, "text"), (5, "many words of a long text " * 2000)]
    blocks = B.encode_corpus(make(rows, clash=True))
    parts = sorted((tuple(r) for r in B.decode_corpus(blocks).collect()), key=repr)
    encode = bpe()
    expected = sorted((i, *array("H", encode.ids(t)), END_OF_TEXT) for i, t in rows if t is not None and i not in (None, 4))
    joined = {}
    for i, first, ids in sorted(((p[0] or -1, p[1], p[2]) for p in parts)):
        joined.setdefault(i, []).append((first, ids))
    got = [(i, *[t for _, ids in sorted(pieces) for t in ids]) for i, pieces in joined.items() if i not in (-1, 4)]
    assert sorted(got) == expected
    assert len(joined[4]) == 2 and joined[-1][0][1][-1] == END_OF_TEXT
    assert B.encode_corpus(make([])).count() == 0
