"""Problem 7: items into fixed-capacity containers, by non-negative least squares over the length histogram.

The plan is made from the histogram of lengths alone (at most `capacity` numbers, whatever the corpus). A
container is cut into equal windows of a few typical items each (at most MAX_WINDOW tokens, so the plan's size does not depend on the capacity). All combinations of up to three lengths
that fill a window exactly are enumerated; non-negative least squares finds how often to repeat each so
that the histogram is used up; the counts are rounded down to what is there, and whole containers are
built from the filled windows. What remains is packed greedily, longest first, by patterns that are
repeated as often as the remaining counts allow.

Documents then find their place without any of them meeting on the driver: each item has a rank among the
items of its length (its rank within its task plus the counts of earlier tasks), and the plan maps ranges of
ranks to containers. A document longer than the capacity is cut into full pieces and a rest.

Defined results: a document without tokens (null or empty text) has one piece of size 0 in container 0;
other columns are ignored; a capacity below 1 is an error.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import written


@dataclass
class Slot:
    """Items of `length` with ranks start .. start + per * repeats - 1 fill windows from `window` on, `per` in each;
    `group` windows make a container, counted from `container`."""

    length: int
    start: int
    per: int
    window: int
    group: int
    container: int


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows (i, j, k) of indexes into sorted `lengths` (-1: none), i >= j >= k, whose lengths add up to window."""
    n = len(lengths)
    index = np.full(window + 1, -1)
    index[lengths] = np.arange(n)
    out = [np.array([[index[window], -1, -1]])] if index[window] >= 0 else []
    other = window - lengths
    ok = (other >= 1) & (other <= lengths)
    ok[ok] = index[other[ok]] >= 0
    i = np.flatnonzero(ok)
    out.append(np.stack((i, index[other[i]], np.full(len(i), -1)), axis=1))
    for a in range(n):
        rest = window - lengths[a]
        b = np.arange(a + 1)
        third = rest - lengths[b]
        good = (third >= 1) & (third <= lengths[b])
        b = b[good]
        c = index[third[good]]
        b, c = b[c >= 0], c[c >= 0]
        if len(b):
            out.append(np.stack((np.full(len(b), a), b, c), axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def nnls(combos: np.ndarray, target: np.ndarray, weight: np.ndarray, steps: int = 300) -> np.ndarray:
    """x >= 0 that minimises |W (A x - target)|, A counting the lengths of each combination; accelerated
    projected gradient with a step from A's row and column sums."""
    if not len(combos):
        return np.zeros(0)
    used = combos >= 0
    safe = np.where(used, combos, 0)
    w2 = weight**2

    def product(x: np.ndarray) -> np.ndarray:
        return np.bincount(safe.ravel(), (x[:, None] * used).ravel(), len(target))

    def transposed(r: np.ndarray) -> np.ndarray:
        return (r[safe] * used).sum(axis=1)

    bound = (transposed(w2 * product(np.ones(len(combos))))).max()
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - transposed(w2 * (product(y) - target)) / bound)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


MAX_WINDOW = 2048


def window_of(counts: dict[int, int], capacity: int) -> int:
    """The size of a window: about three mean items, 64 tokens at least and MAX_WINDOW at most, whatever the capacity.

    A container holds capacity // window windows. Of the sizes between half that aim and all of it, the one that wastes least of a
    container is taken, the largest of equals: none is wasted where one divides the capacity, and a few tokens of a
    container where none does."""
    n = sum(counts.values())
    mean = sum(k * c for k, c in counts.items()) / max(1, n)
    aim = min(MAX_WINDOW, max(64, int(3 * mean)))
    if capacity <= aim:
        return capacity
    return min(range(max(1, aim // 2), aim + 1), key=lambda w: (capacity % w, -w))


def plan(counts: dict[int, int], capacity: int, steps: int = 300) -> tuple[list[Slot], int]:
    """Slots for a histogram of lengths 1 .. capacity, and the number of containers."""
    left = {k: int(c) for k, c in counts.items() if c > 0}
    taken = dict.fromkeys(left, 0)
    slots: list[Slot] = []
    containers = 0

    def take(pattern: list[int], repeats: int, window: int, group: int, container: int) -> None:
        for length in sorted(set(pattern)):
            per = pattern.count(length)
            slots.append(Slot(length, taken[length], per, window, group, container))
            taken[length] += per * repeats
            left[length] -= per * repeats

    if left:
        window = window_of(left, capacity)
        group = capacity // window
        lengths = np.array(sorted(k for k in left if k <= window), np.int64)
        if len(lengths):
            combos = combinations(lengths, window)
            target = np.array([left[int(k)] for k in lengths], float)
            x = nnls(combos, target, np.sqrt(lengths / window), steps)
            room = target.astype(np.int64).copy()
            chosen: list[tuple[list[int], int]] = []
            for i in np.argsort(-x, kind="stable"):
                # rounding up is safe here: what is taken never exceeds what is there
                r = int(np.ceil(x[i] - 0.25))
                if r < 1:
                    break
                idx, per = np.unique(combos[i][combos[i] >= 0], return_counts=True)
                r = min(r, int((room[idx] // per).min()))
                if r > 0:
                    room[idx] -= per * r
                    chosen.append(([int(lengths[j]) for j in combos[i] if j >= 0], r))
            spare = sum(r for _, r in chosen) % group
            while spare:  # only whole containers; the last windows' items are packed greedily
                pattern, r = chosen.pop()
                cut = min(spare, r)
                spare -= cut
                if r > cut:
                    chosen.append((pattern, r - cut))
            at = 0
            for pattern, r in chosen:
                take(pattern, r, at, group, 0)
                at += r
            containers = at // group
    order = sorted(k for k, c in left.items() if c > 0)
    while order:
        pattern, free, used = [], capacity, {}
        hi = len(order)
        while hi:
            hi = bisect_right(order, free, 0, hi)
            while hi and left[order[hi - 1]] <= used.get(order[hi - 1], 0):
                hi -= 1
            if not hi:
                break
            k = order[hi - 1]
            m = min(free // k, left[k] - used.get(k, 0))
            pattern += [k] * m
            used[k] = used.get(k, 0) + m
            free -= m * k
        repeats = min(left[k] // m for k, m in used.items())
        take(pattern, repeats, 0, 1, containers)
        containers += repeats
        order = [k for k in order if left[k] > 0]
    return slots, containers


def _items(batches: Iterator[pa.RecordBatch], capacities: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """(target_id, doc_id, piece_no, start_token, size, part, rank) of every piece; rank counts this task's items of one
    target and size."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    seen: dict[tuple[int, int], int] = {}
    names = ["target_id", "doc_id", "piece_no", "start_token", "size", "part", "rank"]
    for b in batches:
        docs, sizes = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
        for target, capacity in capacities:
            full, rest = sizes // capacity, sizes % capacity
            pieces = full + (rest > 0) + (sizes == 0)
            at = np.repeat(np.arange(len(sizes)), pieces)
            no = np.arange(len(at)) - np.repeat(np.concatenate(([0], np.cumsum(pieces)[:-1])), pieces)
            size = np.where(no < full[at], capacity, rest[at]).astype(np.int32)
            order = np.argsort(size, kind="stable")
            values, first, count = np.unique(size[order], return_index=True, return_counts=True)
            rank = np.empty(len(size), np.int64)
            for v, f, c in zip(values.tolist(), first.tolist(), count.tolist()):
                base = seen.get((target, v), 0)
                rank[order[f : f + c]] = base + np.arange(c)
                seen[target, v] = base + c
            cols = [np.full(len(at), target, np.int32), docs[at], no.astype(np.int32), (no * capacity).astype(np.int64), size, np.full(len(at), part, np.int32), rank]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)


class _Lookup:
    def __init__(self, plans: dict[int, list[Slot]]):
        self.by = {}
        for target, slots in plans.items():
            slots = sorted(slots, key=lambda s: (s.length, s.start))
            cols = np.array([(s.length, s.start, s.per, s.window, s.group, s.container) for s in slots], np.int64).reshape(-1, 6)
            self.by[target] = cols

    def containers(self, target: int, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        cols = self.by[target]
        out = np.zeros(len(size), np.int64)
        big = size > 0
        if big.any() and len(cols):
            key = (cols[:, 0].astype(object) * (1 << 40) + cols[:, 1]).astype(np.int64)
            s = cols[np.searchsorted(key, size[big].astype(np.int64) * (1 << 40) + rank[big], "right") - 1]
            out[big] = s[:, 5] + (s[:, 3] + (rank[big] - s[:, 1]) // s[:, 2]) // s[:, 4]
        return out


def pack(sizes: DataFrame, capacities: dict[int, int], doc_id: str = "doc_id", n_tokens: str = "n_tokens") -> DataFrame:
    """target_id, container_id, doc_id, piece_no, start_token, n_tokens of every piece for every target's capacity."""
    spark = sizes.sparkSession
    if any(c < 1 for c in capacities.values()):
        raise ValueError("a capacity is at least 1")
    targets = sorted(capacities.items())
    src = sizes.select(F.col(doc_id).cast("long"), F.coalesce(F.col(n_tokens), F.lit(0)).cast("long"))
    schema = "target_id int, doc_id long, piece_no int, start_token long, size int, part int, rank long"
    items = written(src.mapInArrow(lambda it: _items(it, targets), schema))
    tasks = items.groupBy("target_id", "size", "part").agg((F.max("rank") + 1).alias("n"))
    # a length's earlier tasks: one row per task, however many items have that length
    earlier = Window.partitionBy("target_id", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tasks.select("target_id", "size", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    hist = tasks.where("size > 0").groupBy("target_id", "size").agg(F.sum("n").alias("n")).collect()  # at most the sum of capacities
    plans = {t: plan({r.size_: r.n for r in (_Row(h) for h in hist) if r.target == t}, c)[0] for t, c in targets}
    lookup = spark.sparkContext.broadcast(_Lookup(plans))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, size, rank = (b.column(c).to_numpy() for c in ("target_id", "size", "rank"))
            box = np.zeros(len(t), np.int64)
            for x in np.unique(t):
                own = t == x
                box[own] = lookup.value.containers(int(x), size[own], rank[own])
            cols = [b.column("target_id"), pa.array(box), b.column("doc_id"), b.column("piece_no"), b.column("start_token"), b.column("size")]
            yield pa.RecordBatch.from_arrays(cols, ["target_id", "container_id", "doc_id", "piece_no", "start_token", "n_tokens"])

    ranked = items.join(offsets, ["target_id", "size", "part"]).select("target_id", "doc_id", "piece_no", "start_token", "size", (F.col("rank") + F.col("offset")).alias("rank"))
    return ranked.mapInArrow(place, "target_id int, container_id long, doc_id long, piece_no int, start_token long, n_tokens int")


class _Row:
    def __init__(self, r):
        self.target, self.size_, self.n = r["target_id"], r["size"], r["n"]


def report(packed: DataFrame, capacities: dict[int, int]) -> DataFrame:
    """Per target: containers, least possible number of them, tokens and filled share."""
    spark = packed.sparkSession
    caps = spark.createDataFrame(sorted(capacities.items()), "target_id int, capacity int")
    boxes = packed.groupBy("target_id", "container_id").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces")).where("tokens > 0")
    out = boxes.groupBy("target_id").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("tokens").alias("n_tokens"), F.sum("pieces").alias("n_pieces"), F.max("tokens").alias("fullest"))
    out = out.join(F.broadcast(caps), "target_id")
    return out.select(
        "target_id", "capacity", "n_containers", F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least_containers"), "n_tokens", "n_pieces", "fullest",
        (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))).alias("filled"),
    )
