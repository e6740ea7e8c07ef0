"""Token ids as compact binary blocks: an adaptive context-mixing range coder.

Documents' ids, each document closed by an end-of-text id, are cut into blocks of BLOCK ids.
A block is coded by itself (all statistics are reset) and carries a CRC-32 of its payload.

An id is coded by up to two decisions:
- is it the id that last followed the two ids before it (order 2), else the one that last
  followed the id before it (order 1), or neither?
- if neither, which id is it, by counts of the ids so far in the block (order 0), refreshed every
  CHUNK ids; ids without a count are an escape.
The probability that a guess is right mixes three adaptive predictions in the logistic domain:
one keyed by how order 2 did so far in this context, one by order 1, one by the candidate's
order-0 count; that of order 1 divides what order 2 leaves. Weights are learned as the block goes
on. All arithmetic is on integers, so encoder and decoder agree on every machine. The range coder
keeps 32 bits, moves 16 at a time and resolves carries at the end. Escaped ids aren't foretold at
all: they stand as 16 plain bits each at the payload's end, the first one last.

The encoder works on many blocks at once, one lane each: what depends on the past alone is
found by sorting, and the mixer and the coder go through the blocks side by side.

Defined cases: a NULL text isn't coded; an empty text is one end-of-text id; a very long text
goes on through as many blocks as it needs; a NULL id is kept in doc_ids, and ids may be of any
type; repeated rows are coded one by one, and where several ids in a block are as likely, the
order of their first places decides; an empty table gives no blocks; the id and text columns are
picked by exact name, and other columns, of any name, take no part.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import fields, slices
from .tokens import DEFAULT_VOCAB, TEXT_BYTES, TokenStream, bpe, closed

BLOCK = 2048
CHUNK = 128
LANES = 1024
_PLACE = BLOCK.bit_length() - 1
_HASH2 = 2_654_435_761
_WEIGHT, _RATE = 22_000, 6
#: Weights stay within this, so that sums of their products fit 32 bits.
_MOST = 1 << 18
#: What the first decision's three answers share: room for a 12-bit part of a 12-bit part.
_SHARES = 1 << 14

def _tables() -> tuple[np.ndarray, np.ndarray]:
    """squash[x + 2048]: 12-bit probability of a logit x / 256; stretch: its inverse."""
    points = (1, 2, 3, 6, 10, 16, 27, 45, 73, 120, 194, 310, 488, 747, 1101, 1546, 2047, 2549, 2994, 3348, 3607, 3785, 3901, 3975, 4022, 4050, 4068, 4079, 4085, 4089, 4092, 4093, 4094)
    x = np.arange(-2048, 2048)
    at, part = (x + 2048) >> 7, x & 127
    p = np.array([*points, 4095])
    squash = np.clip((p[at] * (128 - part) + p[at + 1] * part + 64) >> 7, 1, 4095)
    stretch = np.clip(np.searchsorted(squash, np.arange(4096)) - 2048, -2047, 2047)
    return squash.astype(np.int64), stretch.astype(np.int64)


SQUASH, STRETCH = _tables()
_SQUASH, _STRETCH = SQUASH.astype(np.int32), STRETCH.astype(np.int32)
#: Slots of the three predictions' tables: order 2, order 1, order 0.
_SLOTS = (0, 8, 24, 32)


_BUCKETS = np.minimum(np.frexp(np.arange(BLOCK + 1, dtype=np.float32))[1], 7).astype(np.int32)


def _forecasts(known: np.ndarray, same: np.ndarray) -> np.ndarray:
    """What the place before with the same context foretells, places in the order of contexts.

    known: id | number << 16 of every place. Gives, packed: that place's id (16 bits) and number
    (11), how many such places there were (2, 3 at most), and whether its own forecast was right.
    No such places: no forecast."""
    found = np.zeros_like(known)
    found[:, 1:] = known[:, :-1]
    right = same & ((found ^ known) & 0xFFFF == 0)
    seen = same.astype(np.int32)
    seen[:, 1:] += same[:, 1:] & same[:, :-1]
    seen[:, 2:] += same[:, 2:] & same[:, 1:-1] & same[:, :-2]
    found |= seen << 27
    found[:, 1:] |= right[:, :-1].astype(np.int32) << 29
    found *= same
    return found


#: Fields of _Group.state, by their lowest bit: slots of order 2 and order 1, buckets of both
#: guesses' counts, then whether each decision is made, and whether order 2 and order 1 are right.
_SECOND, _OF2, _OF1, _ASK2, _HIT2, _ASK1, _HIT1, _ASK0, _RAW = 3, 7, 10, 13, 14, 15, 16, 17, 18


class _Group(NamedTuple):
    """What the coder needs of some lanes; all arrays are (places, lanes), total is (chunks, lanes)."""

    state: np.ndarray
    plain: np.ndarray  # order 0: low | size << 16
    total: np.ndarray
    ids: np.ndarray


def _examine(blocks: list[np.ndarray], n: int) -> _Group:
    lanes = len(blocks)
    lengths = np.array([len(b) for b in blocks])
    # A last column for what would follow the last place.
    ids = np.zeros((lanes, n + 1), np.int32)
    for i, b in enumerate(blocks):
        ids[i, : len(b)] = b
    rows = np.arange(lanes, dtype=np.int64)[:, None] * (n + 1)
    places = np.arange(n, dtype=np.uint32)

    def ordered(context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the order of their contexts, and which share theirs with the place before."""
        keys = context << np.uint32(_PLACE)
        keys |= places
        keys.sort(axis=1)
        same = np.zeros(keys.shape, bool)
        same[:, 1:] = (keys[:, 1:] ^ keys[:, :-1]) < BLOCK
        return (keys & np.uint32(BLOCK - 1)).astype(np.int64), same

    # Ids are numbered in the order in which they first occur in their lane.
    at, same = ordered(ids[:, :n].astype(np.uint32))
    flat = at + rows
    index = np.arange(n, dtype=np.int32)
    head = np.maximum.accumulate(np.where(same, 0, index), axis=1)
    first = np.zeros((lanes, n + 1), bool)
    first.ravel()[flat[~same]] = True
    distinct = np.cumsum(first, axis=1, dtype=np.int32)
    number = distinct.ravel()[flat.ravel()[(head + index[:1] + np.arange(lanes, dtype=np.int64)[:, None] * n)]] - 1
    of_id = np.zeros((lanes, n + 1), np.int32)
    of_id.ravel()[flat] = number | (index - head) << 16
    dense, times = of_id[:, :n] & 0xFFFF, (of_id[:, :n] >> 16) + 1

    # Order 1: the contexts are the ids, each for the place after its own.
    known = ids | (of_id & 0xFFFF) << 16
    one, two = np.zeros((lanes, n + 1), np.int32), np.zeros((lanes, n + 1), np.int32)
    flat += 1
    one.ravel()[flat] = _forecasts(known.ravel()[flat], same)
    # Order 2: places without a full context get the context after the last one.
    context = np.full((lanes, n), 1 << 20, np.uint32)
    context[:, 2:] = ((ids[:, : n - 2].astype(np.int64) << 16 | ids[:, 1 : n - 1]) * _HASH2 >> 12) & 0xFFFFF
    at, same = ordered(context)
    flat = at + rows
    two.ravel()[flat] = _forecasts(known.ravel()[flat], same)
    two[:, :2] = 0
    one, two = one[:, :n], two[:, :n]

    # Order 0: counts as they stood when the chunk began.
    counts = np.zeros((lanes, n), np.int32)
    plain, buckets = np.zeros((lanes, n), np.int32), np.zeros((lanes, n), np.int32)
    total = np.ones((-(-n // CHUNK), lanes), np.int32)
    new = np.ones((lanes, n), bool)
    lane = np.arange(lanes, dtype=np.int64)[:, None] * n
    for start in range(0, n, CHUNK):
        upto = slice(start, min(start + CHUNK, n))
        mine = dense[:, upto]
        own = mine + lane
        if start:
            escape = distinct[:, start - 1 : start]
            most = int(escape.max())
            freq = counts.ravel()[own]
            sums = np.zeros((lanes, most + 1), np.int32)
            np.cumsum(counts[:, :most], axis=1, out=sums[:, 1:])
            below = sums.ravel()[np.minimum(mine, most) + np.arange(lanes, dtype=np.int64)[:, None] * (most + 1)]
            new[:, upto] = freq == 0
            plain[:, upto] = np.where(freq > 0, below | freq << 16, start | escape << 16)
            total[start // CHUNK] = start + escape[:, 0]
            of1, of2 = (counts.ravel()[(f[:, upto] >> 16 & BLOCK - 1) + lane] for f in (one, two))
            buckets[:, upto] = _BUCKETS[of2] << _OF2 | _BUCKETS[of1] << _OF1
        counts.ravel()[own] = times[:, upto]

    there = index < lengths[:, None]
    own = ids[:, :n]
    has1, has2 = one >= 1 << 27, two >= 1 << 27
    agree = has1 & has2 & ((one ^ two) & 0xFFFF == 0)
    ask2, hit2 = has2 & there, has2 & ((two ^ own) & 0xFFFF == 0)
    ask1 = has1 & there & ~hit2 & ~agree
    hit1 = ask1 & ((one ^ own) & 0xFFFF == 0)
    rest = there & ~hit2 & ~hit1
    state = buckets
    state |= (two >> 27 & 3) << 1 | two >> 29
    state |= ((one >> 27 & 3) << 1 | one >> 29) << _SECOND
    for flag, place in ((agree, _SECOND + 3), (ask2, _ASK2), (hit2 & ask2, _HIT2), (ask1, _ASK1), (hit1, _HIT1), (rest & (index >= CHUNK), _ASK0), (rest & new, _RAW)):
        state |= flag.astype(np.int32) << place
    return _Group(*(np.ascontiguousarray(x.T) for x in (state, plain)), total, np.ascontiguousarray(own.T))


def _mixed(state: np.ndarray) -> np.ndarray:
    """12-bit probabilities (places, 2, lanes) that order 2 and order 1 are right."""
    places, lanes = state.shape
    # One table a lane and order, and in it the slots of three predictions.
    table = np.full(2 * _SLOTS[3] * lanes, 32768, np.int32)
    weights = np.full((2, 3, lanes), _WEIGHT, np.int32)
    lane = np.arange(lanes, dtype=np.int32) + np.array([0, _SLOTS[3] * lanes], np.int32)[:, None]
    found = np.empty((places, 2, lanes), np.int16)
    at = np.empty((2, 3, lanes), np.intp)
    p, logit, step = (np.empty((2, 3, lanes), np.int32) for _ in range(3))
    x = np.empty((2, lanes), np.int32)
    for begin in range(0, places, 64):
        some = state[begin : begin + 64]
        slots = np.empty((len(some), 2, 3, lanes), np.int32)
        slots[:, :, 0] = (some & 7)[:, None]
        slots[:, :, 1] = (_SLOTS[1] + (some >> _SECOND & 15))[:, None]
        slots[:, 0, 2] = _SLOTS[2] + (some >> _OF2 & 7)
        slots[:, 1, 2] = _SLOTS[2] + (some >> _OF1 & 7)
        slots *= lanes
        slots += lane[:, None]
        on = np.stack([some >> _ASK2 & 1, some >> _ASK1 & 1], axis=1)
        bit = np.stack([some >> _HIT2 & 1, some >> _HIT1 & 1], axis=1)
        aim, gain, goal = bit << 12, on * _RATE, (bit << 16) - bit
        active = on.any(axis=(1, 2))
        for t in range(len(some)):
            if not active[t]:
                found[begin + t] = 2048
                continue
            at[...] = slots[t]
            np.take(table, at, out=p, mode="clip")
            np.right_shift(p, 4, out=step)
            np.take(_STRETCH, step, out=logit, mode="clip")
            np.multiply(weights, logit, out=step)
            np.add(step[:, 0], step[:, 1], out=x)
            x += step[:, 2]
            x >>= 16
            x += 2048
            np.maximum(x, 1, out=x)
            np.minimum(x, 4095, out=x)
            mixed = _SQUASH[x]
            found[begin + t] = mixed
            error = (aim[t] - mixed) * gain[t]
            np.multiply(logit, error[:, None], out=step)
            step += 0x2000
            step >>= 14
            weights += step
            np.minimum(weights, _MOST, out=weights)
            np.maximum(weights, -_MOST, out=weights)
            np.subtract(goal[t][:, None], p, out=step)
            step >>= 4
            step *= on[t][:, None]
            p += step
            table[at] = p
    return found


def encode_blocks(blocks: list[np.ndarray], group: int = 32) -> list[bytes]:
    """Payloads of blocks of at most BLOCK ids each."""
    lanes, n = len(blocks), max(map(len, blocks), default=0)
    if not n:
        return [b""] * lanes
    groups = [_examine(blocks[i : i + group], n) for i in range(0, lanes, group)]
    state, plain, total, ids = (np.concatenate(parts, axis=1) for parts in zip(*groups))
    del groups
    return _range_code(state, _mixed(state), plain, total, ids)


def _events(state: np.ndarray, yes: np.ndarray, plain: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(low, size, total) of both decisions at some places of one chunk, and which are made
    in any lane; a decision that isn't made is one of size 1 of 1."""
    shape = (len(state), 2, state.shape[1])
    lows, sizes, totals = np.zeros(shape), np.ones(shape), np.ones(shape)
    made = np.empty((len(state), 2), bool)
    ask2, ask1, hit2, hit1 = ((state >> k & 1).astype(bool) for k in (_ASK2, _ASK1, _HIT2, _HIT1))
    second = np.where(ask2, yes[:, 0], 0).astype(np.int32) * (_SHARES >> 12)
    left = _SHARES - second
    first = np.where(ask1, np.clip(left * yes[:, 1] >> 12, 1, left - 1), 0)
    asked = ask2 | ask1
    made[:, 0] = asked.any(axis=1)
    np.copyto(lows[:, 0], np.where(hit2, 0, np.where(hit1, second, second + first)), where=asked)
    np.copyto(sizes[:, 0], np.where(hit2, second, np.where(hit1, first, left - first)), where=asked)
    np.copyto(totals[:, 0], _SHARES, where=asked)
    asked = (state >> _ASK0 & 1).astype(bool)
    made[:, 1] = asked.any(axis=1)
    np.copyto(lows[:, 1], plain & 0xFFFF, where=asked)
    np.copyto(sizes[:, 1], plain >> 16, where=asked)
    np.copyto(totals[:, 1], total, where=asked)
    return lows, sizes, totals, made


def _range_code(state: np.ndarray, yes: np.ndarray, plain: np.ndarray, total: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """Code all lanes side by side. Integers are held in doubles: they stay under 2**53, and a
    quotient of a 32-bit by a 14-bit integer is never rounded up to the next one."""
    places, lanes = state.shape
    # Sixteen bits come out at most once a decision.
    flags = state >> _ASK2
    most = int((((flags | flags >> 2) & 1) + (flags >> 4 & 1)).sum(axis=0, dtype=np.int64).max()) + 3
    digits = np.zeros((most, lanes))
    out = digits.ravel()
    at = np.arange(lanes, dtype=np.intp)
    low, span = np.zeros(lanes), np.full(lanes, float((1 << 32) - 1))
    part, short = np.empty(lanes), np.empty(lanes, bool)
    for begin in range(0, places, 64):
        some = slice(begin, min(begin + 64, places))
        lows, sizes, totals, made = _events(state[some], yes[some], plain[some], total[begin // CHUNK])
        for t, k in np.argwhere(made).tolist():
            np.divide(span, totals[t, k], out=part)
            np.floor(part, out=part)
            np.multiply(part, sizes[t, k], out=span)
            part *= lows[t, k]
            low += part
            # The lanes whose span is short give out the upper half of low.
            i = np.less(span, 65536.0, out=short).nonzero()[0]
            if len(i):
                mine, place = low[i], at[i]
                high = np.floor(mine * (1 / 65536))
                out[place] = high
                low[i] = (mine - high * 65536.0) * 65536.0
                span[i] *= 65536.0
                at[i] = place + lanes
    filled = at // lanes
    out[at] = np.floor(low / 65536)
    out[at + lanes] = low % 65536
    filled += 2
    whole = np.ascontiguousarray(digits.T).astype(np.int64)
    whole[np.arange(most) >= filled[:, None]] = 0
    for k in range(most - 1, 0, -1):
        whole[:, k - 1] += whole[:, k] >> 16
        whole[:, k] &= 0xFFFF
    coded = whole.astype(">u2")
    raw = state >> _RAW & 1 == 1
    escaped = np.ascontiguousarray(ids.T[:, ::-1])[np.ascontiguousarray(raw.T[:, ::-1])].astype(">u2")
    ends = np.cumsum(raw.sum(axis=0))
    begins = np.concatenate([[0], ends[:-1]])
    return [coded[i, : filled[i]].tobytes() + escaped[begins[i] : ends[i]].tobytes() for i in range(lanes)]


class _Mixer:
    def __init__(self) -> None:
        self.table = [32768] * _SLOTS[3]
        self.weights = [_WEIGHT] * 3

    def probability(self, slots: tuple[int, int, int]) -> int:
        self.slots = slots
        self.logits = [int(STRETCH[self.table[s] >> 4]) for s in slots]
        x = sum(w * g for w, g in zip(self.weights, self.logits)) >> 16
        self.p = int(SQUASH[max(-2047, min(2047, x)) + 2048])
        return self.p

    def learn(self, bit: int) -> None:
        error = ((bit << 12) - self.p) * _RATE
        self.weights = [max(-_MOST, min(_MOST, w + ((g * error + 0x2000) >> 14))) for w, g in zip(self.weights, self.logits)]
        for s in self.slots:
            self.table[s] += ((bit << 16) - bit - self.table[s]) >> 4


def decode_block(payload: bytes, n: int, crc: int | None = None) -> np.ndarray:
    """The ids of a block; ValueError if the checksum differs."""
    if crc is not None and zlib.crc32(payload) != crc:
        raise ValueError("the block's checksum differs")
    digits = np.frombuffer(payload, ">u2").tolist()
    at = 2
    span, value = (1 << 32) - 1, (digits[0] << 16 | digits[1]) if digits else 0

    def target(total: int) -> tuple[int, int]:
        part = span // total
        return part, min(value // part, total - 1)

    def took(part: int, low: int, size: int) -> None:
        nonlocal span, value, at
        value -= part * low
        span = part * size
        if span < 1 << 16:
            span <<= 16
            value = value << 16 | (digits[at] if at < len(digits) else 0)
            at += 1

    ids: list[int] = []
    counts: dict[int, int] = {}
    order: list[int] = []
    sums: list[int] = [0]
    stood: dict[int, int] = {}
    past: tuple[dict, dict] = ({}, {})  # context -> (last id, times, whether its guess was right)
    mixers = (_Mixer(), _Mixer())
    for t in range(n):
        base = t // CHUNK * CHUNK
        if t == base:
            stood = dict(counts)
            sums = [0]
            for x in order:
                sums.append(sums[-1] + stood[x])
        esc = max(1, len(stood))
        key1 = ids[-1] if t >= 1 else None
        key2 = ((ids[-2] << 16 | ids[-1]) * _HASH2 >> 12) & 0xFFFFF if t >= 2 else None
        guess1, seen1, did1 = past[0].get(key1, (None, 0, False)) if t >= 1 else (None, 0, False)
        guess2, seen2, did2 = past[1].get(key2, (None, 0, False)) if t >= 2 else (None, 0, False)
        agree = guess1 is not None and guess1 == guess2
        guesses = (guess2, None if agree else guess1)
        states = (min(seen2, 3) * 2 + did2, _SLOTS[1] + min(seen1, 3) * 2 + did1 + 8 * agree)
        found = None
        if guesses != (None, None):
            part, v = target(_SHARES)
            low, left = 0, _SHARES
            for k, (mixer, guess) in enumerate(zip(mixers, guesses)):
                if found is None and guess is not None:
                    p = mixer.probability((*states, _SLOTS[2] + min(stood.get(guess, 0).bit_length(), 7)))
                    share = min(max(left * p >> 12, 1), left - 1) if k else p * (_SHARES >> 12)
                    hit = v < low + share
                    mixer.learn(int(hit))
                    if hit:
                        found, left = guess, share
                    else:
                        low, left = low + share, left - share
            took(part, low, left)
        if found is None and base:
            part, v = target(base + esc)
            if v < base:
                k = bisect_right(sums, v) - 1
                found = order[k]
                took(part, sums[k], stood[found])
            else:
                took(part, base, esc)
        if found is None:
            found = digits.pop()
        for key, guess, seen, table in ((key1, guess1, seen1, past[0]), (key2, guess2, seen2, past[1])):
            if key is not None:
                table[key] = (found, seen + 1, guess == found and seen > 0)
        if found not in counts:
            order.append(found)
        counts[found] = counts.get(found, 0) + 1
        ids.append(found)
    return np.array(ids, np.int64)


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """Blocks of the corpus. doc_ids[i] has ids in the block from place starts[i] on; the first
    of them is the document's from_token[i]-th."""
    rows = fields(docs, __id=id_col, __text=text_col).select("__id", F.col("__text").cast("string"))
    kind = rows.schema[0].dataType.simpleString()
    names = ["part", "block", "n_tokens", "crc32", "payload", "doc_ids", "starts", "from_token"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = bpe(vocab), TaskContext.get().partitionId()
        stream, done = TokenStream(), 0

        def flush(size: int) -> pa.RecordBatch:
            nonlocal done
            cut = stream.cut(size, BLOCK)
            payloads, lists = encode_blocks(cut.blocks), pa.array(cut.lists)
            done += len(payloads)
            columns = [
                pa.array(np.full(len(payloads), part, np.int32)),
                pa.array(np.arange(done - len(payloads), done)),
                pa.array(np.array(list(map(len, cut.blocks)), np.int32)),
                pa.array([zlib.crc32(p) for p in payloads], pa.int64()),
                pa.array(payloads, pa.binary()),
                *(pa.ListArray.from_arrays(lists, values) for values in (cut.names, pa.array(cut.starts), pa.array(cut.taken))),
            ]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in slices(batches, 4096, TEXT_BYTES):
            batch = batch.filter(batch.column(1).is_valid())
            if batch.num_rows:
                stream.add(*closed(*encoder.batch(batch.column(1))), batch.column(0))
            while len(stream) >= LANES * BLOCK:
                yield flush(LANES * BLOCK)
        while len(stream):
            yield flush(min(len(stream), LANES * BLOCK))

    return rows.mapInArrow(encode, f"part int, block long, n_tokens int, crc32 long, payload binary, doc_ids array<{kind}>, starts array<int>, from_token array<long>")


def decode_corpus(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, from_token, ids): the ids that a document has in each block, the end-of-text id last."""
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = {c: batch.column(batch.schema.get_field_index(c)) for c in ("payload", "n_tokens", "crc32", "doc_ids", "starts", "from_token")}
            for i in range(batch.num_rows):
                ids = decode_block(held["payload"][i].as_py(), held["n_tokens"][i].as_py(), held["crc32"][i].as_py())
                starts = np.array(held["starts"][i].as_py(), np.int32)
                parts = pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([held["doc_ids"][i].values, pa.array(held["from_token"][i].as_py(), pa.int64()), parts], names=[id_col, "from_token", "ids"])

    return blocks.mapInArrow(decode, f"`{id_col}` {kind}, from_token long, ids array<int>")
