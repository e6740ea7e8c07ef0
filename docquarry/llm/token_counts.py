"""Token counts under a unigram vocabulary, by dynamic programming over a trie.

The distinct pre-tokens of a batch are put in a trie. A node's forward score (the best
log-probability of a segmentation of the bytes on the path to it) depends only on its path,
so it is computed once for all pre-tokens that share the prefix; where a pre-token ends, the
number of pieces on its best path is stored as its count. The trie is scored level by level, all
nodes of a level side by side; the pieces that end at a byte are found by walking back through
an automaton of reversed pieces, so that a byte costs as many steps as the longest piece that
may end there. Pre-tokens over TRIE_BYTES are scored one by one, with a window of scores, so
that a word of megabytes takes no more memory than its bytes.

Counts are memoised by chunk for the whole worker, by the bytes that this takes (chunks over
LONG characters aren't kept), and a document's count is a sum of look-ups. No rows are exchanged.

Piece probabilities follow Zipf's law over the ranks of a public vocabulary: no tokenizer
is trained. Of segmentations with equal scores the one with the longer last piece counts.

Defined cases: NULL text gives a NULL count, an empty text 0; very long texts are counted whole,
with or without white space; repeated rows are counted one by one; rows with a NULL id are kept,
and ids may be of any type; an empty table gives no rows; the two columns are picked by exact
name, and other columns, of any name, take no part.
"""

from __future__ import annotations

import math
from collections import ChainMap
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import Memo, fields, slices
from .tokens import DEFAULT_VOCAB, PATTERN, TEXT_BYTES, read_ranks, split_chunks, strings

ZIPF_SHIFT = 2.7

#: Characters up to which a chunk is kept in the memo, bytes up to which a pre-token is in the
#: trie, and pre-tokens that are in one trie.
LONG = 1000
TRIE_BYTES = 64
WORDS = 1 << 16

_models: dict[str, "UnigramCounter"] = {}


def zipf_scores(ranks: dict[bytes, int], shift: float = ZIPF_SHIFT) -> dict[bytes, float]:
    total = math.fsum(1 / (r + shift) for r in ranks.values())
    return {piece: -math.log((rank + shift) * total) for piece, rank in ranks.items()}


class Backwards:
    """The pieces by their bytes from the last to the first: an automaton in arrays."""

    def __init__(self, scores: dict[bytes, float]):
        self.longest = max(map(len, scores), default=1)
        numbers: dict[tuple[int, int], int] = {}
        ends: dict[int, float] = {}
        for piece, score in scores.items():
            state = 0
            for byte in reversed(piece):
                state = numbers.setdefault((state, byte), len(numbers) + 1)
            ends[state] = score
        #: By state, the score of the piece that is read by then; -inf where none is.
        self.scores = np.full(len(numbers) + 1, -np.inf)
        self.scores[list(ends)] = list(ends.values())
        # Open addressing, at most a quarter full.
        self._bits = max(4, (4 * len(numbers)).bit_length())
        self._keys, self._states = np.full(1 << self._bits, -1, np.int64), np.zeros(1 << self._bits, np.int32)
        keys = np.array([s << 8 | b for s, b in numbers], np.int64)
        states = np.array(list(numbers.values()), np.int32)
        at = self._place(keys)
        while len(keys):
            free = self._keys[at] < 0
            self._keys[at[free]] = keys[free]
            left = self._keys[at] != keys
            self._states[at[~left]] = states[~left]
            keys, states, at = keys[left], states[left], (at[left] + 1) & len(self._keys) - 1

    def _place(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self._bits)).astype(np.int64)

    def step(self, states: np.ndarray, read: np.ndarray) -> np.ndarray:
        """The states after reading one byte more, -1 where no piece goes on so."""
        keys = states.astype(np.int64) << 8 | read
        at = self._place(keys)
        there = self._keys[at]
        found = np.where(there == keys, self._states[at], -1)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & len(self._keys) - 1
            there = self._keys[at[open_]]
            hit = there == keys[open_]
            found[open_[hit]] = self._states[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return found


def trie_counts(words: list[bytes], pieces: Backwards) -> tuple[np.ndarray, int]:
    """Pieces on the best path of every word, and how many nodes of the trie were scored. words:
    sorted, distinct, of at most TRIE_BYTES bytes each. The trie is scored level by level; a
    node belongs to the first word that has its prefix, and later words copy its score."""
    n, lengths = len(words), np.fromiter(map(len, words), np.int64, len(words))
    deep = int(lengths.max(initial=0))
    letters = np.zeros((n, deep), np.uint8)
    letters[np.arange(deep) < lengths[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    differs = letters[1:] != letters[:-1]
    shared = np.zeros(n, np.int64)
    if deep:
        shared[1:] = np.minimum(np.where(differs.any(axis=1), differs.argmax(axis=1), deep), np.minimum(lengths[1:], lengths[:-1]))
    letters = np.ascontiguousarray(letters.T)
    scores, counts = np.full((deep + 1, n), -np.inf), np.zeros((deep + 1, n), np.int32)
    scores[0] = 0
    nodes = 1
    for depth in range(1, deep + 1):
        new = np.flatnonzero((shared < depth) & (lengths >= depth))
        nodes += len(new)
        best, count = np.full(len(new), -np.inf), np.zeros(len(new), np.int32)
        alive, states = np.arange(len(new)), np.zeros(len(new), np.int32)
        for at in range(depth - 1, -1, -1):
            states = pieces.step(states, letters[at, new[alive]])
            on = states >= 0
            alive, states = alive[on], states[on]
            if not len(alive):
                break
            total = scores[at, new[alive]] + pieces.scores[states]
            # Longer pieces come later, so they win where scores are equal.
            better = (total >= best[alive]) & (total > -np.inf)
            mine = alive[better]
            best[mine] = total[better]
            count[mine] = counts[at, new[mine]] + 1
        owner = np.zeros(n, np.int64)
        owner[new] = new
        owner = np.maximum.accumulate(owner)
        scores[depth, new], counts[depth, new] = best, count
        scores[depth], counts[depth] = scores[depth, owner], counts[depth, owner]
    return counts[lengths, np.arange(n)], nodes


def long_count(word: bytes, pieces: Backwards) -> int:
    """Pieces on the best path of one word of any length, by itself: the automaton starts at every
    byte of a window at once, and scores are kept for the longest piece before it."""
    letters = np.frombuffer(word, np.uint8)
    ahead, step = pieces.longest, 1 << 14
    scores, counts = [0.0], [0]
    base = 0
    for begin in range(0, len(word), step):
        ends = np.arange(begin, min(begin + step, len(word)))
        # For every end in the window its pieces as (begin, score), longer ones later.
        owner, starts, found = [], [], []
        alive, states, at = ends, np.zeros(len(ends), np.int32), ends
        while len(alive):
            states = pieces.step(states, letters[at])
            on = states >= 0
            alive, states, at = alive[on], states[on], at[on]
            hit = pieces.scores[states] > -np.inf
            owner.append(alive[hit])
            starts.append(at[hit])
            found.append(pieces.scores[states[hit]])
            more = at > 0
            alive, states, at = alive[more], states[more], at[more] - 1
        owner, starts, found = (np.concatenate(x) for x in (owner, starts, found))
        order = np.argsort(owner, kind="stable")
        edges = np.searchsorted(owner[order], np.append(ends, ends[-1] + 1)).tolist()
        starts, found = starts[order].tolist(), found[order].tolist()
        for low, high in zip(edges, edges[1:]):
            best, count = -math.inf, 0
            for i in range(low, high):
                total = scores[starts[i] - base] + found[i]
                if total >= best:
                    best, count = total, counts[starts[i] - base] + 1
            scores.append(best)
            counts.append(count)
        gone = max(0, len(scores) - ahead - 1)
        base += gone
        del scores[:gone], counts[:gone]
    return counts[-1]


class UnigramCounter:
    def __init__(self, path: str):
        self._pieces = Backwards(zipf_scores(read_ranks(path)))
        self._split = regex.compile(PATTERN).findall
        self._words: dict[str, int] = {}
        self._memo = Memo()

    def _learn(self, chunks: list[str], names: list) -> list[int]:
        """Counts of new chunks; their new pre-tokens share one trie."""
        words, memo = self._words, self._memo
        # Letters alone, after at most one space, are one pre-token.
        parts = [(c,) if c.isalpha() or c[:1] == " " and c[1:].isalpha() else self._split(c) for c in chunks]
        fresh = {w: w.encode() for w in set(chain.from_iterable(parts)).difference(words)}
        short = sorted((raw, w) for w, raw in fresh.items() if len(raw) <= TRIE_BYTES)
        count = {}
        for at in range(0, len(short), WORDS):
            some = short[at : at + WORDS]
            count.update(zip((w for _, w in some), trie_counts([raw for raw, _ in some], self._pieces)[0].tolist()))
        count.update((w, long_count(raw, self._pieces)) for w, raw in fresh.items() if len(raw) > TRIE_BYTES)
        kept = {w: n for w, n in count.items() if len(w) <= LONG}
        words.update(kept)
        count = words if len(kept) == len(count) else ChainMap(words, count)
        found = [sum(map(count.__getitem__, split)) for split in parts]
        memo.update((name, n) for name, n in zip(names, found) if len(name) <= LONG)
        memo.used += sum(len(c) + 150 for c in [*kept, *names] if len(c) <= LONG)
        return found

    def _counted(self, chunks: list[str], names: list) -> np.ndarray:
        found = np.fromiter(map(self._memo.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(found < 0).tolist()
        if new:
            found[new] = self._learn([chunks[i] for i in new], [names[i] for i in new])
        return found

    def counts(self, texts: pa.StringArray) -> np.ndarray:
        """The count of every text, 0 for a NULL."""
        if self._memo.ready(pc.sum(pc.binary_length(texts)).as_py() or 0):
            self._words.clear()
        flat, offsets = split_chunks(texts)
        coded = flat.dictionary_encode()
        names = strings(coded.dictionary)
        found = self._counted([" " + n for n in names], names)[coded.indices.to_numpy()]
        # The first chunk of a text has no space before it; its name is its bytes.
        begins = offsets[:-1][np.diff(offsets) > 0]
        firsts = flat.take(pa.array(begins)).dictionary_encode()
        plain = strings(firsts.dictionary)
        found[begins] = self._counted(plain, [p.encode() for p in plain])[firsts.indices.to_numpy()]
        return np.diff(np.concatenate([[0], np.cumsum(found)])[offsets])


def unigram_counter(path: str = DEFAULT_VOCAB) -> UnigramCounter:
    if path not in _models:
        _models[path] = UnigramCounter(path)
    return _models[path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """(id, n_tokens) of every document. vocab must exist on every executor."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = unigram_counter(vocab)
        for batch in slices(batches, 1024, TEXT_BYTES):
            texts = batch.column(1)
            counts = pa.array(counter.counts(texts), mask=texts.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), counts], names=[id_col, "n_tokens"])

    rows = fields(docs, __id=id_col, __text=text_col).select("__id", F.col("__text").cast("string"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(count, f"`{id_col}` {kind}, n_tokens long")
