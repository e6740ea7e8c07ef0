"""Byte-level BPE ids of whole texts, looked up by space-delimited chunk.

A space is a boundary of pre-tokens unless white space stands on both its sides (or before it,
at the end of the text): a piece never goes on from another character into white space, and
white space before a word leaves its last character to the word. Texts are split at such spaces
in Arrow, the distinct chunks of a batch are looked up in the worker's memo, and the ids of all
texts are gathered from its pool at once. Chunks that are new are encoded in one call and told
apart by the bytes of their ids. A memo over MEMO_BYTES is emptied between batches.
"""

from __future__ import annotations

import base64
import re
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._util import Memo

DEFAULT_VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_OF_TEXT = 50256
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A space that may lie within a pre-token; the class takes in more than the pattern's \s.
_NO_BOUNDARY = f"{_BLANK} (?:{_BLANK}|$)"
_BOUNDARY = re.compile(r"(?<!\s) | (?=\S)")

#: Bytes of text that are tokenized at once.
TEXT_BYTES = 4 << 20

_loaded: dict[str, "BpeTokens"] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


def split_chunks(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """All chunks of all texts, and where each text's begin; a chunk's space goes before it,
    but for the first of a text. A NULL has none, an empty text one empty chunk."""
    split = pc.split_pattern(texts, " ")
    mixed = pc.fill_null(pc.match_substring_regex(texts, _NO_BOUNDARY), False)
    if pc.any(mixed).as_py():
        inside = mixed.to_numpy(zero_copy_only=False)
        parts = [_BOUNDARY.split(texts[i].as_py()) if inside[i] else None for i in range(len(texts))]
        split = pc.if_else(mixed, pa.array(parts, split.type), split)
    counts = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False)
    return split.flatten(), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs that begin at starts and have these lengths, one run after another."""
    ends = np.cumsum(lengths, dtype=np.int64)
    places = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    places += np.repeat(starts - (ends - lengths), lengths)
    return places


def strings(column: pa.StringArray) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class BpeTokens:
    """Encodes texts as unsigned 16-bit ids."""

    def __init__(self, path: str):
        import tiktoken

        ranks = read_ranks(path)
        self._encode = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._bytes = np.zeros(max(ranks.values(), default=0) + 1, np.int32)
        for piece, rank in ranks.items():
            self._bytes[rank] = len(piece)
        self._memo = Memo(emptied=self._clear)
        self._clear()

    def _clear(self) -> None:
        self._start, self._length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self._pool, self._filled = np.zeros(1 << 14, np.uint16), 0

    def _keep(self, first: int, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Pool the ids of chunks numbered from first on."""
        after = first + len(lengths)
        while len(self._start) < after:
            self._start, self._length = (np.concatenate([a, np.zeros_like(a)]) for a in (self._start, self._length))
        while len(self._pool) < self._filled + len(ids):
            self._pool = np.concatenate([self._pool, np.zeros_like(self._pool)])
        ends = np.cumsum(lengths, dtype=np.int64)
        self._start[first:after] = self._filled + ends - lengths
        self._length[first:after] = lengths
        self._pool[self._filled : self._filled + len(ids)] = ids
        self._filled += len(ids)

    def _encoded(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks, each with a space before it, and how many each has."""
        # Beside white space of its own a chunk's first space may be no boundary.
        apart = pc.match_substring_regex(chunks, f"^$|^{_BLANK}|{_BLANK}$").to_numpy(zero_copy_only=False)
        plain = chunks.filter(pa.array(~apart)) if apart.any() else chunks
        together = self._encode(" " + " ".join(strings(plain))) if len(plain) else []
        ids = np.array(together, np.uint16)
        ends = np.cumsum(pc.binary_length(plain).to_numpy().astype(np.int64) + 1)
        counts = np.diff(np.searchsorted(np.cumsum(self._bytes[ids], dtype=np.int64), ends, side="left") + 1, prepend=0)
        if not apart.any():
            return ids, counts
        others = [self._encode(" " + c) for c in chunks.filter(pa.array(apart)).to_pylist()]
        lengths = np.empty(len(chunks), np.int64)
        lengths[~apart], lengths[apart] = counts, list(map(len, others))
        both = np.empty(int(lengths.sum()), np.uint16)
        among = np.repeat(apart, lengths)
        both[~among], both[among] = ids, [x for o in others for x in o]
        return both, lengths

    def _numbered(self, chunks: pa.Array, names: list) -> np.ndarray:
        """The numbers of distinct chunks, by their names in the memo; new ones are learnt. Strings
        have a space before them; bytes are the first chunks of their texts and have none."""
        memo = self._memo
        numbers = np.fromiter(map(memo.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(numbers < 0)
        if len(new):
            first = len(memo)
            numbers[new] = np.arange(first, first + len(new))
            learnt = chunks.take(pa.array(new))
            memo.update(zip([names[i] for i in new.tolist()], range(first, first + len(new))))
            memo.used += 150 * len(new) + learnt.nbytes
            if pa.types.is_binary(chunks.type):
                found = [self._encode(c.decode()) for c in learnt.to_pylist()]
                self._keep(first, np.array([x for f in found for x in f], np.uint16), np.array(list(map(len, found)), np.int64))
            else:
                self._keep(first, *self._encoded(learnt))
        return numbers

    def _numbers(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all chunks of all texts, and where each text's begin."""
        if self._memo.ready(pc.sum(pc.binary_length(texts)).as_py() or 0):
            self._clear()
        flat, offsets = split_chunks(texts)
        coded = flat.dictionary_encode()
        found = self._numbered(coded.dictionary, strings(coded.dictionary))[coded.indices.to_numpy()]
        begins = offsets[:-1][np.diff(offsets) > 0]
        firsts = flat.take(pa.array(begins)).cast(pa.binary()).dictionary_encode()
        found[begins] = self._numbered(firsts.dictionary, firsts.dictionary.to_pylist())[firsts.indices.to_numpy()]
        return found, offsets

    def batch(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin and end; a NULL has none."""
        numbers, offsets = self._numbers(texts)
        lengths = self._length[numbers]
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        return self._pool[gathered(self._start[numbers], lengths)], ends[offsets]

    def counts(self, texts: pa.StringArray) -> np.ndarray:
        numbers, offsets = self._numbers(texts)
        return np.diff(np.concatenate([[0], np.cumsum(self._length[numbers], dtype=np.int64)])[offsets])

    def ids(self, text: str) -> bytes:
        """Little-endian ids of one text."""
        return self.batch(pa.array([text], pa.string()))[0].astype("<u2").tobytes()

    def count(self, text: str) -> int:
        return len(self.ids(text)) // 2


def closed(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents' ids with the end-of-text id after each, and where each one then ends."""
    ends = offsets[1:] + np.arange(1, len(offsets))
    own = np.ones(len(ids) + len(ends), bool)
    own[ends - 1] = False
    out = np.full(len(own), END_OF_TEXT, ids.dtype)
    out[own] = ids
    return out, ends


class Cut(NamedTuple):
    """Blocks of a stream. Block i has the documents from lists[i] to lists[i + 1] of names, which
    begin at its place `starts` (0 if before it) with their `taken`-th id."""

    blocks: list[np.ndarray]
    lists: np.ndarray
    names: pa.Array
    starts: np.ndarray
    taken: np.ndarray


class TokenStream:
    """Documents' ids one after another, to be cut into blocks."""

    def __init__(self) -> None:
        self._ids = np.empty(0, np.uint16)
        self._begins = self._ends = np.empty(0, np.int64)
        self._names: list[pa.Array] = []

    def __len__(self) -> int:
        return len(self._ids)

    def add(self, ids: np.ndarray, ends: np.ndarray, names: pa.Array) -> None:
        """Documents that end at ends, each of one id at least."""
        at = len(self._ids)
        self._begins = np.concatenate([self._begins, at + np.concatenate([[0], ends[:-1]])])
        self._ends = np.concatenate([self._ends, at + ends])
        self._names.append(names)
        self._ids = np.concatenate([self._ids, ids])

    def cut(self, size: int, block: int) -> Cut:
        """The first `size` ids as blocks, the last of which may be shorter; they leave the stream."""
        begins, ends, names = self._begins, self._ends, pa.concat_arrays(self._names)
        cuts = np.arange(0, size, block)
        blocks = [self._ids[i : min(i + block, size)] for i in cuts.tolist()]
        first = np.searchsorted(ends, cuts, side="right")
        counts = np.searchsorted(begins, np.minimum(cuts + block, size), side="left") - first
        at, where = gathered(first, counts), np.repeat(cuts, counts)
        left = int(np.searchsorted(ends, size, side="right"))
        self._ids, self._begins, self._ends, self._names = self._ids[size:], begins[left:] - size, ends[left:] - size, [names.slice(left)]
        return Cut(blocks, np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), names.take(pa.array(at)), np.maximum(begins[at] - where, 0).astype(np.int32), np.maximum(where - begins[at], 0).astype(np.int64))


def bpe(path: str = DEFAULT_VOCAB) -> BpeTokens:
    """The encoder of this worker process for a vocabulary file; the path must exist on every executor."""
    if path not in _loaded:
        _loaded[path] = BpeTokens(path)
    return _loaded[path]
