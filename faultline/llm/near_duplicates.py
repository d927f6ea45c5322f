"""Problem 3: near-duplicates with small edits, by meet-in-the-middle ball hashing.

A row is the set of its words. Its fingerprints are FUNCTIONS sets of m = WORDS words: under each of as many independent
hash functions, the m smallest words among the rare ones (words of at most ALWAYS_INFORMATIVE sets or COMMON of all). Two
fingerprints of one function that differ by one replaced word lie at distance 2; each emits its ball of
half that radius, the m sets with one word removed, and they meet in the set they share. The variants
are shuffled as packed blocks, colliding rows become candidate pairs, and each distinct pair is
verified on the full word sets, so what is reported is exact.

What can be missed: with s the similarity on rare words, one function finds a pair with chance
p(s) = s^(m-1) * (1 + 2(m-1)q + m(m-1)q^2), q = (1-s)/2, and all functions miss it with (1-p)^FUNCTIONS: 4e-5 at s = LEAST_RARE,
2e-10 at s = 0.7. Equal fingerprints are told apart from ones with another word removed by 15 bits of that word.

A pair alike in its common words may have s below that, down to 0. Where s < LEAST_RARE, both its rows have less
than most = (1 - threshold) / (1 - LEAST_RARE) of their words rare. Rows below that share are the close ones. Rows of one
vocabulary share more than half of their common words by chance, so keys of these alone would be held by a fixed part
of all rows, whatever the table's size. A pair that differs in its rare words is the more alike in its common ones, as its
differences are limited in all; so keys mix minima of both kinds, each mix for another part of that range, and at every
rare share and every division of the differences all keys miss a pair with MISS at most (see `schedule`). The fewer rare words
a pair has, the more keys that takes; so the few close rows with the least (at most FEW) are compared with every close row
instead. As unlike rows still share keys, a signature travels with each: a bit per word, from which follows how many words two rows can
share at most. Pairs that cannot reach the threshold are dropped; no other is.

Crowded keys are split. Keys of many rows are found by counts combined per task. Variants of BUSY rows or more carry
signatures too, and a key of CROWD rows or more is dealt out over cells of two blocks of its rows, each cell a key of its own; so the
largest group a task compares has 2 CROWD rows, and a hot key's work is shared by as many tasks as it has pairs of blocks.

Texts are read once; words are 40-bit hashes from then on. Rows with the same set of words are one class: a class is hashed
once per task, whatever its number of copies, and the pairs of classes are expanded to rows at the end, for results that ask for
row pairs.

Defined results: rows without a stack are left out of row pairs; a null message has no words of its own;
rows without any word are in no pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import shuffle_partitions, spread, written

FUNCTIONS, WORDS = 22, 5
COMMON = 0.05
ALWAYS_INFORMATIVE = 200
LEAST_RARE = 0.56
MISS = 1e-4
#: What unlike rows share by chance of their rare and of their common words, and what a group of keys costs beside a comparison with a row;
#: these decide which mixes are taken, not what they find.
CHANCE_RARE, CHANCE_COMMON, GROUP_COST = 0.02, 0.7, 25_000
#: Keys that share their first common minimum travel together, with one signature.
TOGETHER = 8
MOST_RARE_MINIMA, MOST_COMMON_MINIMA, SHARES = 3, 14, 64
FEW, FEW_OF, BINS = 20_000, 64, 1024
SMALL = 48
SIGNATURE, COMMON_BITS = 8, 384
WORD_BYTES, NAME_BYTES = 5, 6
BUSY, CROWD, MOST_HOT, LEAST_NOTED = 1024, 16_384, 100_000, 8
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_WORDCHAR = np.zeros(256, bool)
_WORDCHAR[[*range(48, 58), *range(97, 123)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        out = []
        for base in (_P, inverse):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[:] = out
    return _POWERS[0][:n], _POWERS[1][:n]


def word_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, word hash), sorted and distinct, of lower-cased texts: every maximal run of ASCII letters and digits."""
    arr = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    rows_out, hash_out = [], []
    step, i = 4_000_000, 0
    offsets = offsets - offsets[0]
    while i < len(arr):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + step, "right")) - 1)
        j = min(j, len(arr))
        lo, hi = offsets[i], offsets[j]
        chunk = data[lo:hi]
        if len(chunk):
            inside = _WORDCHAR[chunk]
            # a row's first byte begins a word even if the row before it ends in one
            edge = np.zeros(len(chunk) + 1, bool)
            edge[offsets[i:j] - lo] = True
            prev = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
            starts = np.flatnonzero(inside & ~prev)
            nxt = np.concatenate((inside[1:], [False])) & ~edge[1:]
            ends = np.flatnonzero(inside & ~nxt) + 1
            p, inv = _powers(len(chunk) + 1)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(chunk.astype(np.uint64) * p[:-1], dtype=np.uint64)))
            h = (total[ends] - total[starts]) * inv[starts]
            h = mix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(56)))
            row = np.searchsorted(offsets[i : j + 1] - lo, starts, "right") - 1 + i
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            keep = np.ones(len(h), bool)
            keep[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
            rows_out.append(row[keep])
            hash_out.append(h[keep])
        i = j
    if not rows_out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows_out), np.concatenate(hash_out)


def _per_row(row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    count = np.bincount(row, minlength=n)
    return count, np.concatenate(([0], np.cumsum(count)))


def _set_ids(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each row's set (commutative sums of mixed hashes)."""
    out = []
    for seed in (0x1234567, 0x7654321):
        c = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(seed)), dtype=np.uint64)))
        out.append(mix(c[bounds[1:]] - c[bounds[:-1]] + np.uint64(seed)))
    return out[0].view(np.int64), out[1].view(np.int64)


@dataclass(frozen=True)
class Plan:
    """What both routes need to know; all of bounded size."""

    common: np.ndarray  # sorted hashes of words of more than `common` of all sets
    hot: np.ndarray  # sorted keys that very many rows hold
    blocks: np.ndarray  # for each of them, into how many blocks its rows are dealt
    threshold: float
    buckets: int = 1
    below: float = 0.0  # close rows whose share of rare words is below this are compared with all


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The only pass over the texts: each row with its set's names (kind 0), and, the first time a task meets a set, its
    words as 40-bit hashes; how many of this task's sets hold each word (kind 1), and how many sets there are (kind 2)."""
    words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    seen: set[int] = set()
    sets = 0

    def out(kind: int, a, b, c, blobs=None) -> pa.RecordBatch:
        n = len(a)
        cols = [pa.array(np.full(n, kind, np.int8)), pa.array(a), pa.array(b), pa.array(c), pa.array([None] * n if blobs is None else blobs, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["kind", "a", "b", "c", "words"])

    for batch in batches:
        row, h = word_sets(batch.column(1))
        h = h >> np.uint64(64 - 8 * WORD_BYTES)
        count, bounds = _per_row(row, batch.num_rows)
        one, two = _set_ids(h, bounds)
        one = (one.view(np.uint64) >> np.uint64(64 - 8 * NAME_BYTES)).view(np.int64)
        own = _unseen(one, count, seen)
        packed = _bytes(h.view(np.int64), WORD_BYTES)
        blobs: list[bytes | None] = [None] * batch.num_rows
        for i in own:
            blobs[i] = packed[WORD_BYTES * bounds[i] : WORD_BYTES * bounds[i + 1]]
        some = np.flatnonzero(count > 0)
        yield out(0, batch.column(0).to_numpy()[some], one[some], two[some], [blobs[i] for i in some])
        new = np.zeros(batch.num_rows, bool)
        new[own] = True
        sets += len(own)
        w, n = np.unique(h[new[row]], return_counts=True)
        words, k = np.unique(np.concatenate((words, w)), return_inverse=True)
        counts = np.bincount(k, np.concatenate((counts, n)), len(words)).astype(np.int64)
        if len(words) > 1_000_000:
            yield out(1, words.view(np.int64), counts, counts)
            words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(words):
        yield out(1, words.view(np.int64), counts, counts)
    yield out(2, *[np.array([sets], np.int64)] * 3)


def _unseen(ids: np.ndarray, count: np.ndarray, seen: set[int]) -> np.ndarray:
    """Rows with words whose class this task has not had; what it remembers is bounded, so a class may come again."""
    own = []
    for i in np.flatnonzero(count > 0).tolist():
        if (x := int(ids[i])) not in seen:
            seen.add(x)
            own.append(i)
    if len(seen) > 500_000:
        seen.clear()
    return np.array(own, np.int64)


def _bytes(x: np.ndarray, width: int) -> bytes:
    """The low bytes of 64-bit numbers."""
    return np.ascontiguousarray(x).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _numbers(blob: bytes, width: int) -> np.ndarray:
    x = np.zeros((len(blob) // width, 8), np.uint8)
    x[:, :width] = np.frombuffer(blob, np.uint8).reshape(-1, width)
    return x.view("<i8").ravel()


class _Sets:
    """The word sets of some rows side by side: row of each word, words, and each row's share of them."""

    def __init__(self, blobs: pa.Array):
        arr = blobs.cast(pa.large_binary())
        at = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
        raw = np.frombuffer(arr.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        self.words = _numbers(raw.tobytes(), WORD_BYTES).view(np.uint64)
        self.bounds = (at - at[0]) // WORD_BYTES
        self.count = np.diff(self.bounds)
        self.row = np.repeat(np.arange(len(arr)), self.count)


def fingerprints(row: np.ndarray, h: np.ndarray, n_rows: int, functions: int = FUNCTIONS, m: int = WORDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, variant, mark) for every function: the m variants of each row's fingerprint, which is the m smallest of
    its words. mark tells which word was removed and whether it is the first."""
    count, bounds = _per_row(row, n_rows)
    # rows of like size are laid out together, padded to the largest of them
    size_class = np.ceil(np.log2(np.maximum(count, 1) / m) * 2).clip(0)
    for c in np.unique(size_class[count > 0]):
        own = np.flatnonzero((size_class == c) & (count > 0))
        width = max(int(count[own].max()), m)
        for part in np.array_split(own, len(own) * width // 1_000_000 + 1):
            if not len(part):
                continue
            at = bounds[part][:, None] + np.arange(width)
            missing = np.arange(width) >= count[part][:, None]
            x = h[np.minimum(at, len(h) - 1)]
            for g in range(functions):
                v = mix(x + np.uint64((g + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
                # words a row lacks are filled with one value, so that short rows can still meet
                v[missing] = np.uint64(0xFFFFFFFFFFFFFFFF)
                low = np.sort(np.partition(v, m - 1, axis=1)[:, :m], axis=1)
                each = mix(low)
                rest = each.sum(axis=1, dtype=np.uint64)[:, None] - each
                mark = (low & np.uint64(0x7FFF)).astype(np.uint16) << np.uint16(1)
                mark[:, 0] |= np.uint16(1)
                yield np.repeat(part, m), mix(rest + np.uint64(g)).ravel(), mark.ravel()


def _minima(x: np.ndarray, n: int, seed: int = 0) -> Iterator[np.ndarray]:
    """Of n hash functions of 32 bits, the least value in each column of x."""
    for a, b in mix(np.arange(seed + 1, seed + 2 * n + 1, dtype=np.uint64) * _P).astype(np.uint32).reshape(n, 2):
        v = (x ^ a) * (b | np.uint32(1))
        v ^= v >> np.uint32(16)
        v *= np.uint32(0x7FEB352D)
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x846CA68B)
        v ^= v >> np.uint32(16)
        yield v.min(axis=0)


@lru_cache(maxsize=8)
def schedule(threshold: float) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Mixes (rare minima, common minima), and how many groups of TOGETHER keys of each a pair needs whose share of rare words is at least
    k / SHARES, for every k. These numbers fall with k, so rows that go by the least share of any pair they can be in hold
    all keys that the pair needs.

    Of a pair's words, counted in both rows, let r be rare, and x + y = d = (1 - t) / (1 + t) at most be unshared, x of
    them rare: then its rare words are alike to (r - x) / (r + x), its common ones to (1 - r - y) / (1 - r + y). Groups are added
    where they find most for what they cost until no x is missed more often than MISS. From `least_joint` on, pairs
    whose rare words are alike to LEAST_RARE have fingerprints."""
    d = (1 - threshold) / (1 + threshold)
    mixes = [(a, b) for a in range(MOST_RARE_MINIMA + 1) for b in range(1, MOST_COMMON_MINIMA + 1)]
    power = np.array(mixes)
    cost = GROUP_COST + 1e6 * TOGETHER * CHANCE_RARE ** power[:, :1] * CHANCE_COMMON ** power[:, 1:]
    keys, out = np.zeros(len(mixes)), np.zeros((SHARES + 1, len(mixes)), np.int64)
    for k in range(SHARES, -1, -1):
        for r in np.linspace(k, k + 1, 4) / SHARES:
            x = np.linspace(0, min(d, r), 48)
            y = np.minimum(d - x, 1 - r)
            rare, common = (r - x) / np.maximum(r + x, 1e-9), (1 - r - y) / np.maximum(1 - r + y, 1e-9)
            if k / SHARES >= least_joint(threshold):
                rare, common = rare[rare < LEAST_RARE], common[rare < LEAST_RARE]
            if r > 1 or not len(rare) or k / SHARES > (1 - threshold) / (1 - LEAST_RARE):
                continue
            found = group_chance(rare[None], common[None], power[:, :1], power[:, 1:])
            gain = -np.log1p(-np.minimum(found, 1 - 1e-9)) / -np.log(MISS)
            while (got := np.ceil(keys) @ gain).min() < 1:
                weight = np.where(got < 1, np.exp(-40 * (got - got.min())), 0)
                keys[np.argmax((gain @ weight) / cost[:, 0])] += 1
        out[k] = keys
    return mixes, out


def group_chance(rare: np.ndarray, common: np.ndarray, a, b):
    """How likely a group of keys of a rare and b common minima finds a pair whose rare and common words are alike to these."""
    return common * (1 - (1 - rare**a * common ** (b - 1)) ** TOGETHER)


def least_joint(threshold: float) -> float:
    """From this share of rare words in both rows of a pair on, both have fingerprints of them."""
    return least_share(threshold, (1 - threshold) / (1 - LEAST_RARE))


def _fingerprinted(threshold: float) -> float:
    """No pair of a share of `least_joint` has a row below this: at most the other has n (1 / t - 1) rare words besides a row's n
    words, or lacks n (1 - t) common ones."""
    u = 1 / threshold - 1
    return max(0.0, min(least_joint(threshold) * (1 + threshold), least_joint(threshold) * (2 + u) - u) / 2)


def _least_pair(share: np.ndarray, plan: Plan) -> np.ndarray:
    """The least share of rare words, in both rows, of any pair that a row with this share can be in: the other lacks 1 - t of
    the row's words, all rare, or has 1 / t - 1 as many common ones besides; and if it has 1 / t as many words, no fewer of them
    are rare than in any row that is not compared with all."""
    t = plan.threshold
    least = np.minimum(2 * share - (1 - t), 2 * t * share)
    return np.maximum(np.maximum(least, t * share + plan.below) / (1 + t), 0)


def _columns(words: np.ndarray, bounds: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The words of rows side by side, a column for each row; a row shorter than the longest repeats its last word, which
    changes no minimum."""
    last = bounds[part + 1] - 1
    return words[np.minimum(bounds[part] + np.arange(int((last - bounds[part]).max()) + 1)[:, None], last)]


def _close_keys(s: _Sets, rows: np.ndarray, plan: Plan) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, keys, group) of the rows named, some hundred rows at a time: TOGETHER keys each; those of rows of another group differ."""
    mixes, needed = schedule(plan.threshold)
    most = needed.max(axis=0)
    first = np.concatenate(([0], np.cumsum(most)))
    known, place = _known(s.words, plan.common)
    counts, bounds = zip(*(_per_row(s.row[own], len(s.count)) for own in (~known, known)))
    rare_words, place = s.words[~known].astype(np.uint32), place[known]
    # the values of each common word under all functions of a mix; equal values of unlike words only add candidates
    values = {i: (mix(plan.common[:, None] + mix(np.arange(most[i] * (1 + TOGETHER * (b - 1)), dtype=np.uint64) + np.uint64(i << 32))) >> np.uint64(48)).astype(np.uint16) for i, (_, b) in enumerate(mixes) if most[i]}
    factors = mix(np.arange(1, MOST_RARE_MINIMA + MOST_COMMON_MINIMA + 1, dtype=np.uint64)) | np.uint64(1)
    needs = needed[np.floor(_least_pair(counts[0][rows] / s.count[rows], plan) * SHARES).astype(np.int64)]
    # rows of like needs and sizes are laid out together
    order = np.lexsort((s.count[rows], needs.sum(axis=1)))
    for at in np.array_split(order, len(order) // 128 + 1):
        # a row without words of one kind is in no pair alike in that kind
        at = at[counts[1][rows[at]] > 0]
        some = counts[0][rows[at]] > 0
        for own, with_rare in ((at[some], True), (at[~some], False)):
            if not len(own):
                continue
            part = rows[own]
            common_at = _columns(place, bounds[1], part).T
            rare_at = _columns(rare_words, bounds[0], part) if with_rare else None
            for i, (a, b) in enumerate(mixes):
                n = int(needs[own, i].max())
                if not n or (a and not with_rare):
                    continue
                width = n * (1 + TOGETHER * (b - 1))
                step = max(1, 2_000_000 // (width * common_at.shape[1]))
                table = np.ascontiguousarray(values[i][:, :width])
                least = np.concatenate([table[common_at[j : j + step]].min(axis=1) for j in range(0, len(part), step)]).reshape(len(part), n, -1).astype(np.uint64)
                group = mix((np.arange(n, dtype=np.uint64) + np.uint64(int(first[i]) + 1)) * _P + least[:, :, 0])
                keys = group[:, :, None] + np.arange(TOGETHER, dtype=np.uint64)
                keys += (least[:, :, 1:].reshape(len(part), n, TOGETHER, b - 1) * factors[: b - 1]).sum(axis=3, dtype=np.uint64)
                if a:
                    least = np.stack(list(_minima(rare_at, n * TOGETHER * a, i << 20)), axis=1).reshape(len(part), n, TOGETHER, a)
                    keys += (least * factors[-a:]).sum(axis=3, dtype=np.uint64)
                row, g = np.nonzero(needs[own, i][:, None] > np.arange(n))
                yield part[row], mix(keys[row, g]), group[row, g]


def _known(words: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words are common, and where among them."""
    at = np.searchsorted(common, words)
    if not len(common):
        return np.zeros(len(words), bool), at
    return common[np.minimum(at, len(common) - 1)] == words, at


def signatures(s: _Sets, common: np.ndarray) -> np.ndarray:
    """(rows, SIGNATURE + 1) words of 64 bits: each word of a row sets one bit, the common ones in a part of their own; the last
    says how many words found their bit set. Two rows share at most as many words as bits, and the lesser of these."""
    known, at = _known(s.words, common)
    bit = np.where(known, at % COMMON_BITS, COMMON_BITS + (mix(s.words) % np.uint64(64 * SIGNATURE - COMMON_BITS)).astype(np.int64))
    out = np.zeros((len(s.count), SIGNATURE + 1), np.uint64)
    np.bitwise_or.at(out, (s.row, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    out[:, -1] = (s.count - np.bitwise_count(out[:, :-1]).sum(axis=1, dtype=np.int64)).astype(np.uint64)
    return out


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, _Sets]]:
    """(class names, sets), each class once per task, in pieces of bounded size."""
    seen: set[int] = set()
    for b in batches:
        for i in range(0, b.num_rows, 4096):
            part = b.slice(i, 4096)
            ids = part.column(0).to_numpy()
            own = _unseen(ids, np.ones(len(ids), np.int64), seen)
            if len(own):
                yield ids[own], _Sets(part.column(1).take(pa.array(own)))


def least_share(threshold: float, most: float) -> float:
    """A row whose share of rare words is below this is alike to no row whose share is `most` or more.

    Rows of a and b words that share c have c >= t (a + b) / (1 + t), and b's rare words are at most a's and b's own:
    most * b <= share * a + b - c. The share follows, and is least at b = t a or at b = a / t."""
    t = threshold
    return max(0.0, t / (1 + t) + min(t * (k := t / (1 + t) - (1 - most)), k / t))


def _entries(s: _Sets, plan: Plan) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(close, row, key, mark) of both routes; of close rows (True, row, keys, group)."""
    rare, n_rare, close = _shares(s, plan)
    some = rare & (n_rare >= _fingerprinted(plan.threshold) * s.count)[s.row]
    for row, key, mark in fingerprints(s.row[some], s.words[some], len(s.count)):
        yield False, row, key, mark
    rows = np.flatnonzero(close & (n_rare >= plan.below * s.count))
    if len(rows):
        for row, keys, group in _close_keys(s, rows, plan):
            yield True, row, keys, group


def _shares(s: _Sets, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words are rare, how many of each row, and which rows are close."""
    rare = ~_known(s.words, plan.common)[0]
    n_rare = np.bincount(s.row[rare], minlength=len(s.count))
    return rare, n_rare, (n_rare < (1 - plan.threshold) / (1 - LEAST_RARE) * s.count) & (len(plan.common) > 0)


def _close_shares(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """How many close rows have which share of rare words, in BINS steps."""
    n = np.zeros(BINS, np.int64)
    for _, s in _distinct(batches):
        _, n_rare, close = _shares(s, plan)
        n += np.bincount(np.minimum(n_rare[close] * BINS // s.count[close], BINS - 1), minlength=BINS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(n)], ["bin", "n"])


def _few(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """The close rows that are compared with all, with their signatures."""
    for ids, s in _distinct(batches):
        _, n_rare, close = _shares(s, plan)
        own = np.flatnonzero(close & (n_rare < plan.below * s.count))
        if len(own):
            sign = signatures(s, plan.common)
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array([sign[i].tobytes() for i in own], pa.binary())], ["c", "s"])


def _with_few(batches: Iterator[pa.RecordBatch], plan: Plan, few: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Pairs of a close row and one of the few that their signatures leave possible."""
    ids_few, sign_few = few
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for ids, s in _distinct(batches):
        close = np.flatnonzero(_shares(s, plan)[2])
        if not len(close):
            continue
        for x, y in _possible_pairs(signatures(s, plan.common)[close], sign_few, plan.threshold):
            a, b = ids[close[x]], ids_few[y]
            held.append((np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]))
        if sum(len(a) for a, _ in held) > 1_000_000:
            yield _pairs_out(held)
            held = []
    if held:
        yield _pairs_out(held)


def _words_needed(sign: np.ndarray, threshold: float) -> np.ndarray:
    """Two rows reach the threshold if they share the sum of their values."""
    size = np.bitwise_count(sign[:, :-1]).sum(axis=1, dtype=np.int64) + sign[:, -1].astype(np.int64)
    return (size * (threshold / (1 + threshold))).astype(np.float32)


def _possible_pairs(p: np.ndarray, q: np.ndarray, threshold: float, own: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, y) of the rows of p and of q whose signatures leave room for the threshold. own: q is p, and only x < y are asked for."""
    bits = [np.ascontiguousarray(z[:, :-1].T) for z in (p, q)]
    spare = [np.minimum(z[:, -1], 32_767).astype(np.int16) for z in (p, q)]
    need = [_words_needed(z, threshold) for z in (p, q)]
    need[0] = need[0] - np.float32(1e-3)
    for lo in range(0, len(p), 32):
        hi = min(lo + 32, len(p))
        for at in range(lo if own else 0, len(q), 2048):
            to = min(at + 2048, len(q))
            both = np.empty((hi - lo, to - at), np.uint64)
            ones, some = np.empty(both.shape, np.uint8), np.empty(both.shape, np.uint8)
            shared = np.minimum(spare[0][lo:hi, None], spare[1][None, at:to])
            for i in range(SIGNATURE):
                np.bitwise_and(bits[0][i, lo:hi, None], bits[1][i, None, at:to], out=both)
                np.bitwise_count(both, out=ones if i % 2 else some)
                # two counts of 64 at most fit a byte
                if i % 2:
                    some += ones
                if i % 2 or i == SIGNATURE - 1:
                    shared += some
            x, y = np.nonzero(shared >= need[0][lo:hi, None] + need[1][None, at:to])
            x, y = x + lo, y + at
            if own:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield x, y


def _crowded(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """Keys held by at least LEAST_NOTED rows of a block, with the numbers of them."""
    held: dict[bool, list[np.ndarray]] = {False: [], True: []}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for close, keys in held.items():
            if keys:
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                often = n >= LEAST_NOTED
                if often.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int(often.sum()), close)), pa.array(key[often].view(np.int64)), pa.array(n[often])], ["close", "key", "n"])
            keys.clear()

    for _, s in _distinct(batches):
        for close, _, key, _ in _entries(s, plan):
            held[close].append(key.ravel())
            size += key.size
        if size > 4_000_000:
            yield from flush()
            size = 0
    yield from flush()


def _dealt(key: np.ndarray, ids: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, cell, hot) of each entry. An entry of a crowded key goes to one cell for each block of that key: a cell is
    a pair of blocks, so any two of the key's rows meet in one, and no cell holds more than two blocks."""
    at = np.minimum(np.searchsorted(plan.hot, key), max(0, len(plan.hot) - 1))
    hot = plan.hot[at] == key if len(plan.hot) else np.zeros(len(key), bool)
    if not hot.any():
        return np.arange(len(key)), key, hot
    n = np.where(hot, plan.blocks[at] if len(plan.hot) else 1, 1)
    index = np.repeat(np.arange(len(key)), n)
    k = np.arange(len(index)) - np.repeat(np.cumsum(n) - n, n)
    block = (mix(ids.view(np.uint64)[index]) % n[index].astype(np.uint64)).astype(np.int64)
    cell = np.minimum(block, k) * (1 << 20) + np.maximum(block, k)
    cells = np.where(hot[index], mix(key[index] + mix(cell.astype(np.uint64) + np.uint64(1))), key[index])
    return index, cells, hot[index]


PLAIN, SIGNED, GROUPED = range(3)


def _emit(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """Packed blocks (bucket, kind, keys, classes, marks or signatures). Groups of keys of close rows, and rows of a crowded
    key, carry a signature; a crowded key of a group goes to its cells by itself, and its place in the group is 0."""
    held: list[list[tuple]] = [[], [], []]
    size = [0, 0, 0]

    def flush(kind: int) -> Iterator[pa.RecordBatch]:
        if not held[kind]:
            return
        where, key, c, extra = (np.concatenate(x) for x in zip(*held[kind]))
        held[kind], size[kind] = [], 0
        bucket = (where >> np.uint64(32)) % np.uint64(plan.buckets)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(plan.buckets + 1, dtype=np.uint64))
        full = np.flatnonzero(np.diff(ends))
        for some in np.array_split(full, len(full) // 32 + 1):
            own = [order[ends[b] : ends[b + 1]] for b in some]
            blobs = [[key[o].tobytes() for o in own], [_bytes(c[o], NAME_BYTES) for o in own], [extra[o].tobytes() for o in own]]
            cols = [pa.array(some.astype(np.int32)), pa.array([kind] * len(some), pa.int8()), *(pa.array(x, pa.binary()) for x in blobs)]
            yield pa.RecordBatch.from_arrays(cols, ["bucket", "kind", "v", "c", "x"])

    def hold(kind: int, where: np.ndarray, key: np.ndarray, c: np.ndarray, extra: np.ndarray) -> None:
        if len(c):
            held[kind].append((where, key.astype(np.uint32), c, extra))
            size[kind] += len(c) * (1, 8, 12)[kind]

    for ids, s in _distinct(batches):
        sign = None
        for close, row, key, mark in _entries(s, plan):
            index, cell, hot = _dealt(key.ravel(), np.repeat(ids[row], key.size // len(row)), plan)
            if sign is None and (close or hot.any()):
                sign = signatures(s, plan.common)
            if close:
                lone = index[hot]
                hold(SIGNED, cell[hot], cell[hot], ids[row[lone // TOGETHER]], sign[row[lone // TOGETHER]] if len(lone) else mark)
                key.reshape(-1)[lone] = 0
                hold(GROUPED, mark, key, ids[row], sign[row])
            else:
                hold(PLAIN, cell[~hot], cell[~hot], ids[row[index[~hot]]], mark[index[~hot]])
                if hot.any():
                    hold(SIGNED, cell[hot], cell[hot], ids[row[index[hot]]], sign[row[index[hot]]])
        for kind in (PLAIN, SIGNED, GROUPED):
            if size[kind] > 2_000_000:
                yield from flush(kind)
    for kind in (PLAIN, SIGNED, GROUPED):
        yield from flush(kind)


def _unpacked(rows: list[tuple], width: int, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, classes and extras in order of key and class, each pair of the two once (with each of its marks)."""
    v = np.concatenate([np.frombuffer(r[0], np.uint32) for r in rows])
    c = np.concatenate([_numbers(r[1], NAME_BYTES) for r in rows])
    x = np.concatenate([np.frombuffer(r[2], kind).reshape(-1, width) for r in rows])
    order = np.lexsort((c, v))
    v, c, x = v[order], c[order], x[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (c[1:] != c[:-1]) | ((x[1:] != x[:-1]).any(axis=1) if width == 1 else False)
    return v[keep], c[keep], x[keep]


def _pairs_out(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    p = np.unique(np.stack([np.concatenate(z) for z in zip(*held)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["a", "b"])


def _collide(threshold: float):
    """Candidate pairs of one bucket."""

    def plain(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Rows of one variant; equal fingerprints share all their variants and are paired on the first only."""
        v, c, k = _unpacked(rows, 1, np.uint16)
        k = k.ravel()
        starts = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        length = np.diff(np.append(starts, len(v)))
        starts, length = starts[length > 1], length[length > 1]
        held, size = [], 0
        for gap in range(1, int(length.max()) if len(length) else 1):
            starts, length = starts[length > gap], length[length > gap]
            reach = length - gap
            at = np.repeat(starts - (np.cumsum(reach) - reach), reach) + np.arange(int(reach.sum()))
            for i in range(0, len(at), 1_000_000):
                x, y = at[i : i + 1_000_000], at[i : i + 1_000_000] + gap
                ok = (c[x] != c[y]) & ((k[x] >> 1 != k[y] >> 1) | (k[x] & 1 == 1))
                if ok.any():
                    held.append((c[x[ok]], c[y[ok]]))
                    size += int(ok.sum())
                if size > 1_000_000:
                    yield _pairs_out(held)
                    held, size = [], 0
        if held:
            yield _pairs_out(held)

    def signed(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Rows of one key whose signatures leave room for the similarity asked for; nothing above it is lost."""
        v, c, s = _unpacked(rows, SIGNATURE + 1, np.uint64)
        yield from possible(v, np.arange(len(v)), c, s)

    def grouped(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        v = np.concatenate([np.frombuffer(r[0], np.uint32).reshape(-1, TOGETHER) for r in rows])
        c = np.concatenate([_numbers(r[1], NAME_BYTES) for r in rows])
        s = np.concatenate([np.frombuffer(r[2], np.uint64).reshape(-1, SIGNATURE + 1) for r in rows])
        key = v.ravel()
        order = np.argsort(key, kind="stable")
        order = order[key[order] > 0]
        yield from possible(key[order], order // TOGETHER, c, s)

    def possible(v: np.ndarray, at: np.ndarray, c: np.ndarray, s: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of entries in order of their keys v, those of rows `at` of c and s."""
        need = _words_needed(s, threshold)
        starts = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        length = np.diff(np.append(starts, len(v)))
        held, size = [], 0
        for x, y in chain(small(starts, length, at, s, need), large(starts, length, at, s)):
            a, b = c[x], c[y]
            x, y = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
            held.append((x, y))
            size += len(x)
            if size > 1_000_000:
                yield _pairs_out(held)
                held, size = [], 0
        if held:
            yield _pairs_out(held)

    def small(starts: np.ndarray, length: np.ndarray, rows: np.ndarray, s: np.ndarray, need: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs within groups of SMALL rows at most, those of all groups at once."""
        starts, length = starts[length <= SMALL], length[length <= SMALL]
        for gap in range(1, SMALL):
            starts, length = starts[length > gap], length[length > gap]
            reach = length - gap
            at = np.repeat(starts - (np.cumsum(reach) - reach), reach) + np.arange(int(reach.sum()))
            for i in range(0, len(at), 65_536):
                x, y = rows[at[i : i + 65_536]], rows[at[i : i + 65_536] + gap]
                p, q = s[x], s[y]
                shared = np.bitwise_count(p[:, :-1] & q[:, :-1]).sum(axis=1, dtype=np.int64) + np.minimum(p[:, -1], q[:, -1]).astype(np.int64)
                ok = shared >= need[x] + need[y] - np.float32(1e-3)
                if ok.any():
                    yield x[ok], y[ok]

    def large(starts: np.ndarray, length: np.ndarray, rows: np.ndarray, s: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i, n in zip(starts[length > SMALL], length[length > SMALL]):
            own = rows[i : i + n]
            for x, y in _possible_pairs(s[own], s[own], threshold, own=True):
                yield own[x], own[y]

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list[tuple]] = [[], [], []]
        for b in batches:
            for kind, *blobs in zip(*(b.column(n).to_pylist() for n in ("kind", "v", "c", "x"))):
                rows[kind].append(tuple(blobs))
        for kind, f in ((PLAIN, plain), (SIGNED, signed), (GROUPED, grouped)):
            if own := rows[kind]:
                rows[kind] = []
                yield from f(own)

    return run


def _possible(candidates: DataFrame, sets: DataFrame, plan, threshold: float) -> DataFrame:
    """The candidates whose signatures leave room for the threshold: most others never meet their words."""
    names = [f"s{i}" for i in range(SIGNATURE + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sign = signatures(_Sets(b.column(1)), plan.value.common).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(c)) for c in sign.T)], ["c1", *names])

    signed = sets.select("c1", "words").mapInArrow(run, ", ".join(f"{n} long" for n in ("c1", *names)))
    side = lambda end: signed.select(F.col("c1").alias(end), *(F.col(n).alias(f"{end}_{n}") for n in names))
    j = candidates.join(side("a"), "a").join(side("b"), "b")
    total = lambda f: sum((f(n) for n in names[1:-1]), f(names[0]))
    size = lambda end: total(lambda n: F.bit_count(F.col(f"{end}_{n}"))) + F.col(f"{end}_{names[-1]}")
    shared = total(lambda n: F.bit_count(F.col(f"a_{n}").bitwiseAND(F.col(f"b_{n}")))) + F.least(f"a_{names[-1]}", f"b_{names[-1]}")
    return j.where(shared >= threshold / (1 + threshold) * (size("a") + size("b")) - 1e-6).select("a", "b").distinct()


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sims = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                p, q = len(x) // WORD_BYTES, len(y) // WORD_BYTES
                if min(p, q) < threshold * max(p, q):
                    sims.append(0.0)
                    continue
                both = np.concatenate((_numbers(x, WORD_BYTES), _numbers(y, WORD_BYTES)))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                sims.append(shared / (p + q - shared))
            s = pa.array(sims, pa.float64())
            keep = pc.greater_equal(s, threshold)
            t = pa.RecordBatch.from_arrays([b.column("a1"), b.column("a2"), b.column("b1"), b.column("b2"), s], ["a1", "a2", "b1", "b2", "similarity"])
            yield t.filter(keep)

    return run


class NearDuplicates:
    """classes: (row_id, c1, c2) of every row with words; pairs: (a1, a2, b1, b2, similarity) of all pairs of different
    classes at or above the threshold, a before b."""

    def __init__(self, df: DataFrame, row_id: str, text: str, threshold: float, common: float = COMMON, busy: int = BUSY, crowd: int = CROWD):
        spark = df.sparkSession
        rows = spread(df.select(F.col(row_id).cast("long").alias("row_id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text")))
        scan = written(rows.mapInArrow(_scan, "kind byte, a long, b long, c long, words binary"))
        self.classes = scan.where("kind = 0").select(F.col("a").alias("row_id"), F.col("b").alias("c1"), F.col("c").alias("c2"))
        total = scan.where("kind = 2").agg(F.coalesce(F.sum("a"), F.lit(0))).first()[0]
        # at most (words per row) / common of them, whatever the number of rows
        often = scan.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).where(F.col("n") > max(float(ALWAYS_INFORMATIVE), common * total))
        frequent = np.sort(np.array([r.a for r in often.collect()], np.int64).view(np.uint64))
        sets = scan.where("kind = 0 and words is not null").select(F.col("b").alias("c1"), F.col("c").alias("c2"), "words")
        none = np.zeros(0, np.int64)
        plan = Plan(frequent, none.view(np.uint64), none, threshold)
        close, few = np.zeros(BINS, np.int64), (none, none)
        words = sets.select("c1", "words")
        if len(frequent):
            basis = spark.sparkContext.broadcast(plan)
            for r in words.mapInArrow(lambda it: _close_shares(it, basis.value), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
                close[r.bin] = r.n
            # whole bins of rows, so a share that very many rows have is not taken in part
            bins = int(np.searchsorted(np.cumsum(close), min(FEW, close.sum() // FEW_OF), "right"))
            plan = replace(plan, below=bins / BINS if close[:bins].any() else 0.0)
        least = spark.sparkContext.broadcast(plan)
        if plan.below:
            got = {r.c: r.s for r in words.mapInArrow(lambda it: _few(it, least.value), "c long, s binary").collect()}
            few = (np.array(list(got), np.int64), np.frombuffer(b"".join(map(bytes, got.values())), np.uint64).reshape(-1, SIGNATURE + 1))
        needed = schedule(threshold)[1].sum(axis=1)
        groups = int((close * needed[np.floor(_least_pair(np.arange(BINS) / BINS, plan) * SHARES).astype(np.int64)])[round(plan.below * BINS) :].sum())
        # fewer than (entries) / n keys can have n rows, and no more than MOST_HOT are asked for
        busy, crowd = (max(n, (total * FUNCTIONS * WORDS + TOGETHER * groups) // MOST_HOT) for n in (busy, crowd))
        hot = words.mapInArrow(lambda it: _crowded(it, least.value), "close boolean, key long, n long").groupBy("close", "key").agg(F.sum("n").alias("n"))
        hot = sorted((int(np.int64(r.key).view(np.uint64)), r.n) for r in hot.where(F.col("n") >= F.when(F.col("close"), crowd).otherwise(busy)).collect())
        # a bucket holds some hundred thousand entries
        buckets = max(shuffle_partitions(spark), (total * FUNCTIONS * WORDS + 12 * groups) // 800_000 + 1)
        plan = replace(plan, hot=np.array([k for k, _ in hot], np.uint64), blocks=np.array([-(-n // crowd) for _, n in hot], np.int64), buckets=buckets)
        shared = spark.sparkContext.broadcast(plan)
        emitted = words.mapInArrow(lambda it: _emit(it, shared.value), "bucket int, kind byte, v binary, c binary, x binary")
        candidates = emitted.groupBy("bucket").applyInArrow(_collide(threshold), "a long, b long")
        if len(few[0]):
            rest = spark.sparkContext.broadcast(few)
            candidates = candidates.unionAll(words.mapInArrow(lambda it: _with_few(it, shared.value, rest.value), "a long, b long"))
        candidates = candidates.distinct()
        # one exchange by c1 serves the grouping and both joins
        sets = sets.repartition("c1").groupBy("c1", "c2").agg(F.first("words").alias("words"))
        candidates = _possible(candidates, sets, shared, threshold)
        x = candidates.join(sets.select(F.col("c1").alias("a"), F.col("c2").alias("a2"), F.col("words").alias("x")), "a")
        xy = x.join(sets.select(F.col("c1").alias("b"), F.col("c2").alias("b2"), F.col("words").alias("y")), "b")
        xy = xy.select(F.col("a").alias("a1"), "a2", F.col("b").alias("b1"), "b2", "x", "y")
        self.pairs = xy.mapInArrow(_verify(threshold), "a1 long, a2 long, b1 long, b2 long, similarity double")

    def row_pairs(self) -> DataFrame:
        """row_id_a < row_id_b of every pair of rows, pairs within a class included."""
        c = self.classes
        a = c.select(F.col("row_id").alias("ra"), F.col("c1").alias("a1"), F.col("c2").alias("a2"))
        b = c.select(F.col("row_id").alias("rb"), F.col("c1").alias("b1"), F.col("c2").alias("b2"))
        between = self.pairs.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).select("ra", "rb")
        within = a.join(b, (F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2")) & (F.col("ra") < F.col("rb"))).select("ra", "rb")
        out = between.unionAll(within)
        return out.select(F.least("ra", "rb").alias("row_id_a"), F.greatest("ra", "rb").alias("row_id_b"))

    def memberships(self) -> DataFrame:
        """row_id, class_id (smallest row id of the same words), n_copies, n_links (other classes linked)."""
        firsts = self.classes.groupBy("c1", "c2").agg(F.min("row_id").alias("class_id"), F.count(F.lit(1)).alias("n_copies"))
        ends = self.pairs.select(F.explode(F.array(F.struct(F.col("a1").alias("c1"), F.col("a2").alias("c2")), F.struct(F.col("b1").alias("c1"), F.col("b2").alias("c2")))).alias("e"))
        links = ends.groupBy("e.c1", "e.c2").agg(F.count(F.lit(1)).alias("n_links"))
        known = firsts.join(links, ["c1", "c2"], "left").select("c1", "c2", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
        return self.classes.join(known, ["c1", "c2"]).select("row_id", "class_id", "n_copies", "n_links")


def failure_texts(df: DataFrame) -> DataFrame:
    """rowId and text (message and stack) of the failures that have a stack."""
    return df.where(F.col("stackText").isNotNull()).select("rowId", F.concat(F.coalesce("message", F.lit("")), F.lit("\n"), F.col("stackText")).alias("text"))
