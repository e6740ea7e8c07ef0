"""Near-duplicate documents by SimHash and the generalised pigeonhole principle.

A document's signature has 256 bits: signs of weighted sums over its distinct words, the
weight growing with a word's length up to 12. All pairs within VERIFY of the 256 bits are
found: they are within r of 64 bits in one of the four words, for radii r whose sum of r + 1
is VERIFY + 1. So each word is searched exactly for all pairs within its radius tau:

- bits are grouped into parts so that correlated ones lie together;
- every signature gets its own thresholds t_i >= -1 (-1: the part isn't probed) with
  sum(t_i + 1) = tau + 1, chosen by dynamic programming over the estimated candidates: the
  exact count of signatures within t_i of its value in part i, from the parts' histograms;
- a pair within tau then agrees to within t_i in some part, so probing the values within t_i
  misses nothing; candidates are verified on the word's 64 bits, then on all 256, which
  removes chance collisions of short texts;
- a signature travels once for each cell of values that it probes, not for each value: the
  values are probed where the cell is held.

Groups are connected components over the verified pairs, of which a task passes on as many as
join what all of them join; the document with the least id of each group stays. Documents whose signatures are the same are one entry in the search.

Defined cases: ids are integers; rows with a NULL id and texts without any word (NULL, empty, only
punctuation) take no part and stay; texts are read whole, however long; rows that repeat id and
text count as one document, and all of them stay or go; of a group the least id stays, and of
several texts with that id the one with the least hash; an empty table gives no pairs; the two
columns are picked by exact name, and all others, of any name, are carried along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, combinations, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import Memo, cut, fields, maybe_broadcast, mix64, parallelism, release, rows_back, slices, with_row

BITS = 64
VERIFY = 44
MOST = 4  # the largest t_i + 1 that is considered
#: Signatures of a cell that a task holds about; cells of half as many again are spread over several tasks.
HELD = 2_000_000
#: Bits of a part that make cells, at most.
CELL_BITS = 6
#: Signatures that travel in one row, so that rows are few and a batch of rows is small.
PACKED = 64
#: Counts of a part's values that travel in one row.
SLAB = 1 << 10

_PUNCTUATION = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "…“”‘’«»–—¡¿"


class _Words:
    """Word numbers of this worker, with each number's 256 hashed bits and weight."""

    def __init__(self) -> None:
        self.number = Memo(emptied=self.fresh)
        self.fresh()

    def fresh(self) -> None:
        self.bits = np.empty((1 << 16, 4), np.uint64)
        self.weight = np.empty(1 << 16, np.float32)

    def learn(self, new: list[str]) -> None:
        at = len(self.number)
        while len(self.bits) < at + len(new):
            self.bits = np.concatenate([self.bits, np.empty_like(self.bits)])
            self.weight = np.concatenate([self.weight, np.empty_like(self.weight)])
        hashes = np.empty(len(new), np.uint64)
        for i, raw in enumerate(new):
            word = raw.strip(_PUNCTUATION).lower()
            self.number[raw] = at + i
            self.number.used += len(raw) + 190
            hashes[i] = xxhash.xxh64_intdigest(word)
            self.weight[at + i] = min(len(word), 12) - 2 if len(word) > 2 else 1 / 64 if word else 0
        for k in range(4):
            with np.errstate(over="ignore"):
                self.bits[at : at + len(new), k] = mix64(hashes + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15))


_words = _Words()


def signature(text: str | None) -> np.ndarray | None:
    """Four 64-bit integers, or None for a text without words."""
    if not text:
        return None
    distinct = set(text.split())
    known = _words.number
    known.ready(200 * len(distinct))
    new = [w for w in distinct if w not in known]
    if new:
        _words.learn(new)
    at = np.fromiter(map(_words.number.__getitem__, distinct), np.int64, len(distinct))
    weight = _words.weight[at]
    total = float(weight.sum(dtype=np.float64))
    if total <= 0:
        return None
    # Words that differ in case or punctuation alone are one feature.
    rows = _words.bits[at]
    _, once = np.unique(rows[:, 0], return_index=True)
    rows, weight = rows[once], weight[once]
    bits = np.unpackbits(np.ascontiguousarray(rows).view(np.uint8), axis=1)
    ones = np.zeros(256, np.float64)
    for i in range(0, len(bits), 4096):
        ones += weight[i : i + 4096] @ bits[i : i + 4096].astype(np.float32)
    total = float(weight.sum(dtype=np.float64))
    return np.packbits(ones * 2 > total).view(np.uint64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, __h, s0, s1, s2, s3) of every document that has words; __h is the text's hash."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [(i, s) for i, s in enumerate(map(signature, batch.column(2).to_pylist())) if s is not None]
            at = pa.array([i for i, _ in found], pa.int64())
            sigs = np.array([s for _, s in found], np.uint64).reshape(-1, 4).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(np.ascontiguousarray(sigs[:, k])) for k in range(4))], names=["__id", "__h", "s0", "s1", "s2", "s3"])

    rows = fields(docs, __id=id_col, __text=text_col).select(F.col("__id").cast("long"), F.xxhash64("__text").alias("__h"), F.col("__text").cast("string")).where("__id IS NOT NULL")
    return rows.mapInArrow(sign, "__id long, __h long, s0 long, s1 long, s2 long, s3 long")


def unpacked(sigs: np.ndarray) -> np.ndarray:
    """Bits of 64-bit signatures, one row each; bit 0 is the lowest."""
    return np.unpackbits(sigs.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlations(sigs: DataFrame, words: list[str]) -> np.ndarray:
    """Of each word the absolute correlations of its bits over all signatures; 64 x 65 sums a word reach the driver."""
    size = BITS * BITS + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(words), size))
        for batch in batches:
            for k, column in enumerate(batch.columns):
                bits = unpacked(column.to_numpy().view(np.uint64)).astype(np.float32)
                total[k] += np.append((bits.T @ bits).ravel(), len(bits))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["k", "v"])

    total = np.zeros(len(words) * size)
    for k, v in sigs.select(*words).mapInArrow(sums, "k int, v double").groupBy("k").agg(F.sum("v")).collect():
        total[k] = v
    total = total.reshape(len(words), size)
    both = total[:, :-1].reshape(-1, BITS, BITS) / np.maximum(total[:, -1], 1)[:, None, None]
    mean = np.diagonal(both, axis1=1, axis2=2)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    return np.abs(both - mean[:, :, None] * mean[:, None]) / (spread[:, :, None] * spread[:, None])


def group_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in parts of nearly equal size, each grown by the bit most correlated with it."""
    left = set(range(BITS))
    groups = []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        first = max(left, key=lambda b: (sum(correlation[b][c] for c in left), -b))
        group = [first]
        left.discard(first)
        while len(group) < size:
            nearest = max(left, key=lambda b: (sum(correlation[b][c] for c in group), -b))
            group.append(nearest)
            left.discard(nearest)
        groups.append(sorted(group))
    return groups


def part_values(sigs: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of a part, packed; the first bit of the group is the lowest."""
    out = np.zeros(len(sigs), np.int64)
    for place, bit in enumerate(group):
        out |= ((sigs >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << place
    return out


def ball_counts(histogram: np.ndarray, width: int) -> np.ndarray:
    """counts[t, v]: how many signatures have a value within t of v."""
    exact = np.zeros((MOST, 1 << width))
    exact[0] = histogram
    values = np.arange(1 << width)
    for bit in range(width):
        exact[1:] += exact[:-1, values ^ (1 << bit)]
    return np.cumsum(exact, axis=0)


def ball_masks(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(range(width), r)], np.int64)


#: Relative costs of a signature that is sent, of a value that is probed, of a candidate that is
#: verified, and of the probes of those that have one value in common, whatever their number.
SENT, PROBE, CANDIDATE, VALUE = 1.0, 0.01, 0.001, 50.0


def allocate(costs: list[np.ndarray], tau: int) -> np.ndarray:
    """For each query the t_i + 1 of every part that sum to tau + 1 at least cost.

    costs[i][u, q]: cost for query q of t_i + 1 = u in part i, 0 at u = 0.
    """
    queries = costs[0].shape[1]
    best = np.full((tau + 2, queries), np.inf)
    best[0] = 0
    picks = []
    for cost in costs:
        after = np.full_like(best, np.inf)
        pick = np.zeros(best.shape, np.int8)
        for u in range(len(cost)):
            tried = best[: tau + 2 - u] + cost[u]
            better = tried < after[u:]
            after[u:][better] = tried[better]
            pick[u:][better] = u
        best = after
        picks.append(pick)
    found = np.zeros((len(costs), queries), np.int8)
    left = np.full(queries, tau + 1)
    for i in range(len(costs) - 1, -1, -1):
        found[i] = picks[i][left, np.arange(queries)]
        left -= found[i]
    return found


def _parts_for(n: int, tau: int) -> int:
    """The number of parts with the least cost if values were uniform."""

    def cost(parts: int) -> float:
        width = BITS / parts
        levels = [(tau + 1) // parts + (k < (tau + 1) % parts) for k in range(parts)]
        if max(levels) > MOST:
            return math.inf
        balls = sum(sum(math.comb(round(width), r) for r in range(u)) for u in levels)
        rows = sum(len(ball_masks(_cell_bits(n), u - 1)) for u in levels if u)
        return rows * SENT + balls * PROBE + balls * n / 2**width * CANDIDATE + parts * min(1, 2**width / max(n, 1)) * VALUE

    return min(range(4, 9), key=cost)


def _cell_bits(n: int) -> int:
    return min(CELL_BITS, max(0, math.ceil(math.log2(max(n, 1) / HELD))))


class _Part:
    """A part of a word: its bits, how many signatures are within t of each value, and its cells.

    A cell is the values that agree in the highest bits of the part; its signatures have the
    tasks first[cell] and after, as many as share[cell], and go to one of these by their hash.
    """

    def __init__(self, word: int, group: list[int], histogram: np.ndarray, bits: int, first: int):
        self.word, self.group, self.low = word, group, len(group) - bits
        self.balls = ball_counts(histogram, len(group)).astype(np.float32)
        held = histogram.reshape(1 << bits, -1).sum(axis=1)
        self.share = np.ceil(held / (1.5 * HELD)).astype(np.int64)
        self.first = first + np.cumsum(self.share) - self.share
        self.masks = [ball_masks(bits, t) for t in range(MOST)]

    def costs(self, own: np.ndarray) -> np.ndarray:
        """costs[u, q] of t + 1 = u for each value, as allocate wants them."""
        each = [math.comb(len(self.group), r) for r in range(MOST)]
        return np.vstack([np.zeros(len(own)), *(self.balls[t][own] * CANDIDATE + (len(self.masks[t]) * SENT + sum(each[: t + 1]) * PROBE) for t in range(MOST))])

    def sent(self, own: np.ndarray, levels: np.ndarray, hashed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(which signatures, their tasks, 1 as a probe and 0 as what is probed): each once to its own
        cell, where it probes too, and as a probe to all other tasks that have values within t."""
        cell = own >> self.low
        home = self.first[cell] + (hashed % self.share[cell].astype(np.uint64)).astype(np.int64)
        yield np.arange(len(own)), home, 0
        for mask in self.masks[-1]:
            mine = np.flatnonzero(levels > int(mask).bit_count())
            to = cell[mine] ^ mask
            for salt in range(int(self.share[to].max(initial=0))):
                task = self.first[to] + salt
                on = (self.share[to] > salt) & (task != home[mine])
                yield mine[on], task[on], 1


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = 1 << 15) -> Iterator[np.ndarray]:
    """Signatures, one row each, about so many at a time."""
    kept, n = [], 0
    for batch in chain(batches, [None]):
        if batch is not None and batch.num_rows:
            kept.append(np.column_stack([c.to_numpy().view(np.uint64) for c in batch.columns]))
            n += batch.num_rows
        if kept and (n >= rows or batch is None):
            yield np.concatenate(kept)
            kept, n = [], 0


def _histograms(sigs: DataFrame, groups: list[tuple[int, list[int]]]) -> list[list[np.ndarray]]:
    """Of each (word, bits) how many signatures have each value, in pieces; these travel as arrays."""
    pieces = [max(1, (1 << len(g)) // SLAB) for _, g in groups]

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(1 << len(g), np.int64) for _, g in groups]
        for found in _chunks(batches):
            for total, (k, group) in zip(totals, groups):
                total += np.bincount(part_values(found[:, k], group), minlength=len(total))
        slabs = [piece for total, n in zip(totals, pieces) for piece in np.split(total, n)]
        at = [i for i, slab in enumerate(slabs) if slab.any()]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([slabs[i].tobytes() for i in at], pa.binary())], names=["slab", "n"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, n in zip(batch.column(0).to_pylist(), batch.column(1)):
                more = np.frombuffer(n.as_buffer(), np.int64)
                totals[i] = totals[i] + more if i in totals else more.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([n.tobytes() for n in totals.values()], pa.binary())], names=["slab", "n"])

    kind = "slab int, n binary"
    whole = {r[0]: np.frombuffer(bytes(r[1]), np.int64) for r in sigs.mapInArrow(counts, kind).repartition("slab").mapInArrow(summed, kind).collect()}
    slabs = iter(range(sum(pieces)))
    return [[whole.get(next(slabs), np.zeros((1 << len(g)) // n, np.int64)) for _ in range(n)] for (_, g), n in zip(groups, pieces)]


def _search(sigs: DataFrame, radii: list[int], verify: int, links: bool) -> DataFrame:
    """(a0, ..., b0, ...): pairs within verify bits of sigs' rows, which are distinct signatures
    of a word for each radius, columns s0 and so on. All pairs within a radius in some word are
    looked at. With links only as many pairs as join what all of them join, else each pair once."""
    spark = sigs.sparkSession
    names = [f"s{k}" for k in range(len(radii))]
    sigs = sigs.select(*names)
    n = sigs.count()
    related = correlations(sigs, names)
    groups = [(k, g) for k, tau in enumerate(radii) if tau >= 0 for g in group_bits(related[k], _parts_for(n, tau))]

    # At most 16 * 2**16 counts, whatever the corpus.
    histograms = [np.concatenate(h) for h in _histograms(sigs, groups)]
    parts: list[_Part] = []
    first = 0
    for (k, group), histogram in zip(groups, histograms):
        parts.append(_Part(k, group, histogram, _cell_bits(n), first))
        first += int(parts[-1].share.sum())
    shared = spark.sparkContext.broadcast(parts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _chunks(batches):
            hashed = mix64(found[:, 0])
            for k, tau in enumerate(radii):
                mine = [p for p in shared.value if p.word == k]
                own = [part_values(found[:, k], p.group) for p in mine]
                levels = allocate([p.costs(v) for p, v in zip(mine, own)], tau) if mine else []
                for part, v, level in zip(mine, own, levels):
                    for which, task, probe in part.sent(v, level, hashed):
                        yield from _packed(found, level, which, task, probe)
        release()

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of their tasks, of each the signatures before the probes."""
        of = [p for p in shared.value for _ in range(int(p.share.sum()))]
        for task, rows in groupby(_runs(batches), key=lambda run: run[0]):
            cell = _Cell(of[task], radii, verify, links)
            for found in cell.answers((probe, blobs) for _, probe, blobs in rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in found.view(np.int64).T], names=out)
        release()

    out = [f"{side}{k}" for side in "ab" for k in range(len(radii))]
    sent = sigs.mapInArrow(send, "task int, probe int, sigs binary")
    apart = sent.repartitionById(max(1, min(first, 8 * parallelism(spark))), F.col("task")).sortWithinPartitions("task", "probe")
    return apart.mapInArrow(verified, ", ".join(f"{c} long" for c in out)).distinct()


def _packed(sigs: np.ndarray, levels: np.ndarray, which: np.ndarray, task: np.ndarray, probe: int) -> Iterator[pa.RecordBatch]:
    """Rows of at most PACKED signatures for one task: their words, then their t + 1."""
    if not len(which):
        return
    order = np.argsort(task, kind="stable")
    which, task = which[order], task[order]
    width = sigs.shape[1] * 8
    data = np.ascontiguousarray(sigs[which]).view(np.uint8).reshape(len(which), width)
    level = levels[which].astype(np.uint8)
    edges = np.flatnonzero(np.diff(task, prepend=-1))
    tasks, blobs = [], []
    for low, high in zip(edges, np.append(edges[1:], len(task))):
        for at in range(low, high, PACKED):
            to = min(high, at + PACKED)
            tasks.append(task[low])
            blobs.append(data[at:to].tobytes() + level[at:to].tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(tasks, pa.int32()), pa.array(np.full(len(tasks), probe, np.int32)), pa.array(blobs, pa.binary())], names=["task", "probe", "sigs"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[bytes]]]:
    """(task, probe, packed signatures) of rows that follow each other in a batch."""
    for batch in batches:
        if batch.num_rows:
            task, probe = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.diff(task.astype(np.int64) << 1 | probe, prepend=-1))
            for low, high in zip(edges, np.append(edges[1:], batch.num_rows)):
                yield int(task[low]), int(probe[low]), batch.column(2).slice(low, high - low).to_pylist()


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label, the least of its set for each number, after the sets of a and b are united."""
    while True:
        one, other = label[a], label[b]
        apart = one != other
        if not apart.any():
            return label
        a, b, one, other = a[apart], b[apart], one[apart], other[apart]
        np.minimum.at(label, np.maximum(one, other), np.minimum(one, other))
        while ((further := label[label]) != label).any():
            label = further


class _Cell:
    """What a task holds of a cell, and the search in it."""

    def __init__(self, part: _Part, radii: list[int], verify: int, links: bool):
        self.part, self.radii, self.verify, self.links = part, radii, verify, links
        self.width = len(part.group)
        self.masks = [ball_masks(self.width, t) for t in range(MOST)]

    def answers(self, runs: Iterator[tuple[int, list[bytes]]]) -> Iterator[np.ndarray]:
        """Pairs as rows of a's words and b's. Probes are answered so many at a time as are held."""
        kept, n, holding = [], 0, False
        for probe, blobs in chain(runs, [(2, [])]):
            if probe and not holding:
                yield from self.hold(*self.unpacked(kept))
                kept, n, holding = [], 0, True
            kept += blobs
            n += sum(map(len, blobs))
            if n and (probe == 2 or probe and n > HELD * 16):
                yield from self.pairs(*self.unpacked(kept))
                kept, n = [], 0
        if self.links:
            yield self.rows(np.arange(len(self.sigs)), self.label)

    def unpacked(self, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words = len(self.radii)
        sizes = [len(b) // (8 * words + 1) for b in blobs]
        sigs = np.frombuffer(b"".join(b[: 8 * words * n] for b, n in zip(blobs, sizes)), np.uint64).reshape(-1, words)
        return sigs, np.frombuffer(b"".join(b[8 * words * n :] for b, n in zip(blobs, sizes)), np.uint8)

    def hold(self, sigs: np.ndarray, levels: np.ndarray) -> Iterator[np.ndarray]:
        value = part_values(sigs[:, self.part.word], self.part.group)
        order = np.argsort(value, kind="stable")
        self.sigs, value = sigs[order], value[order]
        self.word = np.ascontiguousarray(self.sigs[:, self.part.word])
        self.start = np.searchsorted(value, np.arange((1 << self.width) + 1))
        self.label = np.arange(len(sigs))
        yield from self.pairs(self.sigs, levels[order], np.arange(len(sigs)))

    def rows(self, a: np.ndarray, b: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
        """Pairs of numbers as rows of words, without those of one and the same, in one order."""
        sigs = self.sigs if more is None else np.concatenate([self.sigs, more])
        a, b = sigs[a[a != b]], sigs[b[a != b]]
        different = (a != b).argmax(axis=1)[:, None]
        turn = np.take_along_axis(a, different, 1) > np.take_along_axis(b, different, 1)
        return np.hstack([np.where(turn, b, a), np.where(turn, a, b)])

    def pairs(self, sigs: np.ndarray, levels: np.ndarray, number: np.ndarray | None = None) -> Iterator[np.ndarray]:
        """Answers to probes; number: what they are if they are held themselves."""
        held, more = len(self.sigs), None
        label = self.label
        if number is None:
            number, more = held + np.arange(len(sigs)), sigs
            label = np.append(label, number)
        asked = np.ascontiguousarray(sigs[:, self.part.word])
        key = part_values(asked, self.part.group) << 3 | levels
        order = np.argsort(key, kind="stable")
        key = key[order]
        edges = np.flatnonzero(np.diff(key, prepend=-1))
        tau, left, right, n = self.radii[self.part.word], [], [], 0
        for low, high in zip(edges, np.append(edges[1:], len(key))):
            if not (level := int(key[low]) & 7):
                continue
            near = (int(key[low]) >> 3) ^ self.masks[level - 1]
            begin, sizes = self.start[near], self.start[near + 1] - self.start[near]
            have = np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            if not len(have):
                continue
            words = self.word[have]
            step = max(1, (1 << 17) // len(have))
            for at in range(low, high, step):
                which = order[at : min(high, at + step)]
                hits = np.flatnonzero(np.bitwise_count(asked[which][:, None] ^ words).ravel() <= tau)
                q, x = which[hits // len(have)], have[hits % len(have)]
                one, apart = number[q], label[x] != label[number[q]] if self.links else x != number[q]
                q, x, one = q[apart], x[apart], one[apart]
                if not len(q):
                    continue
                bits = np.bitwise_count(sigs[q] ^ self.sigs[x])
                good = bits.sum(axis=1, dtype=np.int64) <= self.verify
                for k in range(self.part.word):
                    good &= bits[:, k] > self.radii[k]  # else the search of that word has it
                left.append(one[good])
                right.append(x[good])
                n += len(left[-1])
                if n > max(1 << 18, len(label) >> 2 if self.links else 0):
                    a, b = np.concatenate(left), np.concatenate(right)
                    left, right, n = [], [], 0
                    if self.links:
                        label = joined(label, a, b)
                    else:
                        yield self.rows(a, b, more)
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            if self.links:
                label = joined(label, a, b)
            else:
                yield self.rows(a, b, more)
        if self.links:
            self.label = label[:held]
            if more is not None:
                yield self.rows(number, label[held:], more)


def hamming_pairs(sigs: DataFrame, tau: int) -> DataFrame:
    """(a, b) with a < b of all rows within tau bits on s0, by their distinct __id, and their
    other columns as a_... and b_...; rows with the same s0 are found by an equi-join."""
    return _all_pairs(sigs, [tau], tau)


def _all_pairs(sigs: DataFrame, radii: list[int], verify: int) -> DataFrame:
    a, b = (sigs.select(F.col("__id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in sigs.columns if c != "__id"]) for side in "ab")
    words = range(len(radii))
    found = _search(cut(sigs.select(*[f"s{k}" for k in words]).distinct()), radii, verify, links=False)
    both = found.union(found.select(*[f"b{k}" for k in words], *[f"a{k}" for k in words])).toDF(*[f"{side}_s{k}" for side in "ab" for k in words])
    apart = both.join(a, [f"a_s{k}" for k in words]).join(b, [f"b_s{k}" for k in words]).where("a < b")
    same = a.join(b, [F.col(f"a_s{k}") == F.col(f"b_s{k}") for k in words]).where("a < b")
    return same.unionByName(apart)


def word_radii(verify: int) -> list[int]:
    """Of pairs within verify bits in all, each is within its radius in one of the four words."""
    return [(verify + 1 + k) // 4 - 1 for k in range(3, -1, -1)]


def near_pairs(heads: DataFrame, verify: int = VERIFY) -> DataFrame:
    """(a, b) with a < b, once each, of all rows within verify bits on s0 to s3, by their distinct __id."""
    return _all_pairs(heads, word_radii(verify), verify).select("a", "b")


def near_links(heads: DataFrame, verify: int = VERIFY) -> DataFrame:
    """(a, b) of rows within verify bits on s0 to s3, as the xxhash64 of these; rows must be distinct.
    They are not all pairs, which grow as the square of a group, but join what all pairs join."""
    found = _search(heads, word_radii(verify), verify, links=True)
    return found.select(*[F.xxhash64(*[f"{side}{k}" for k in range(4)]).alias(side) for side in "ab"])


def components(pairs: DataFrame) -> DataFrame:
    """(id, root) of every id in pairs (a, b): root is the least id of its connected component.

    Each round takes the least label among neighbours, then follows labels once more.
    """
    edges = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        seen = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        lower = labels.join(seen, "id").select("id", "root", F.least("root", "near").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("root").alias("further"))
        after = cut(lower.join(jump, "low", "left").select("id", F.least("low", F.coalesce("further", "low")).alias("root"), (F.least("low", F.coalesce("further", "low")) < F.col("root")).alias("moved")))
        if not after.where("moved").limit(1).count():
            return after.select("id", "root")
        labels = after.select("id", "root")


def _grouped(docs: DataFrame, verify: int, id_col: str, text_col: str) -> DataFrame:
    """(__id, __h, __keep) of every document whose group has another with a lesser key."""
    sigs = cut(signatures(docs, id_col, text_col).distinct())
    same = ["s0", "s1", "s2", "s3"]
    # Entries are numbered by their signatures' hashes, as an id may have several texts.
    heads = cut(sigs.select(*same).distinct())
    roots = components(near_links(heads, verify))
    # The least document of a component, by (id, hash), stays.
    numbered = sigs.select("__id", "__h", F.xxhash64(*same).alias("id"))
    members = numbered.join(roots, "id", "left").select("__id", "__h", F.coalesce("root", "id").alias("__root"))
    kept = members.groupBy("__root").agg(F.min(F.struct("__id", "__h")).alias("__kept"))
    return members.join(kept, "__root").where("__id <> __kept.__id OR __h <> __kept.__h").select("__id", "__h", F.col("__kept.__id").alias("__keep"))


def near_duplicates(docs: DataFrame, verify: int = VERIFY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id) of every document that goes, with the one of its group that stays."""
    return _grouped(docs, verify, id_col, text_col).select(F.col("__id").alias(id_col), F.col("__keep").alias("keep_id")).distinct()


def drop_near_duplicates(docs: DataFrame, verify: int = VERIFY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without all but one of each group, all columns kept."""
    gone = cut(_grouped(docs, verify, id_col, text_col).select(F.col("__id").alias("__dq_id"), F.col("__h").alias("__dq_h")).distinct())
    rows = with_row(docs, __dq_id=id_col, __dq_text=text_col).select(F.col("__dq_id").cast("long"), F.xxhash64("__dq_text").alias("__dq_h"), "__row")
    return rows_back(rows.join(maybe_broadcast(gone, gone.count()), ["__dq_id", "__dq_h"], "left_anti"), docs.columns)
