"""Problem 4: consensus of several labelers, by minimax conditional entropy.

A labeler i who sees an item j of true class c answers k with probability proportional to
exp(sigma_i(c, k) + tau_j(c, k)): one tilting table per labeler and one per item, both with a quadratic
penalty. The dual is climbed one coordinate block at a time: each pass over the items finds every item's
posterior and its tau for the present sigma (nothing is kept per item between passes), adds up the
gradient and curvature of every sigma, and takes one damped Newton step for each row of a table, until no
coordinate moves by more than `tolerance`. A pass is one scan of the items; what comes back is one table per labeler, combined per
task before the shuffle.

For categories, an item is a failure and a class a category. Failures with the same votes have the same posterior, so
the model runs over the distinct sets of votes of the whole corpus, with their numbers.

For root causes, group names mean something only within one run, so an item is a pair of failures of a run, its classes are
"same cause" and "other cause", and a labeler's answer is whether they put the two together. Failures of a run with the same
statements are one node, counted where they lie, so what a task holds of a run is its distinct statements, however many
failures it has; copies weigh as many pairs as they stand for. Posteriors of pairs need not agree
with each other: a run's consensus grouping is the partition that collects the most log-odds (all partitions of up to four
nodes are tried, larger runs are climbed by moving nodes and joining groups until nothing gains), with
the ratio that the posteriors of two failures' categories give; it is the class of each pair in the next step of
the tilts. Failures of one cause share a category, whose posterior is then pooled.

Agreement is reported apart from the model: Krippendorff's alpha for categories and the share of failure
pairs grouped alike for groups.

Defined results: names of labelers are compared without case and outer blanks; of repeated or earlier
sittings of a labeler (same run, context and failure) the latest counts, ties to the greatest label;
spellings of a category are compared by their letters, and unknown or null ones are no vote; a null or
blank group is no statement on grouping; failures with fewer than `least` labelers get no consensus; a failure without any
category vote has all categories alike. More than MAX_LABELERS labelers are an error, as there is a table of each on every task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import shuffle_partitions, written

#: The label vocabulary; fixed values.
CATEGORIES = (
    "PRODUCT_REGRESSION", "TEST_DEFECT", "FLAKY", "ENVIRONMENT_FAILURE",
    "DEPENDENCY_FAILURE", "DATA_FAILURE", "PERFORMANCE_REGRESSION", "UNKNOWN",
)
K = len(CATEGORIES)
MAX_LABELERS = 50_000
#: How much two failures' categories count beside what labelers say of their groups.
TILT = 0.7


def votes(run_labels: DataFrame) -> DataFrame:
    """run_id, failure_id, labeler, context, category (index or null), grp (normalised or null): one row per statement."""
    letters = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    known = F.create_map(*(F.lit(x) for i, c in enumerate(CATEGORIES) for x in (c.replace("_", ""), i)))
    rows = run_labels.where("corpusRunId is not null and labeler is not null").select(
        F.col("corpusRunId").alias("run_id"), F.lower(F.trim("labeler")).alias("labeler"), F.coalesce("context", F.lit("")).alias("context"), F.coalesce("labeledAt", F.lit("")).alias("at"), F.explode("labels").alias("failure_id", "l"),
    )
    name = F.regexp_replace(F.lower("l.group"), r"[^\p{L}\p{N}]", "")
    rows = rows.select("run_id", "failure_id", "labeler", "context", "at", F.try_element_at(known, letters(F.col("l.category"))).alias("category"), F.when(name != "", name).alias("grp"))
    latest = rows.groupBy("run_id", "failure_id", "labeler", "context").agg(F.max(F.struct("at", "category", "grp")).alias("m"))
    return latest.select("run_id", "failure_id", "labeler", "context", "m.category", "m.grp")


class Entropy:
    """The model: sigma by labeler, and the prior of the classes."""

    def __init__(self, labelers: list[str], k: int, item_penalty: float):
        self.index = {n: i for i, n in enumerate(labelers)}
        self.sigma = np.zeros((len(labelers), k, k))
        self.sigma[:, np.arange(k), np.arange(k)] = 1.5
        self.prior = np.full(k, 1 / k)
        self.item_penalty = item_penalty

    def posteriors(self, item: np.ndarray, who: np.ndarray, said: np.ndarray, n: int, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """(posterior of each item, answer probabilities of each vote): tau starts at 0 and follows the posterior. Votes lie in
        the order of their items, and every item has one."""
        k = self.sigma.shape[1]
        if not n:
            return np.zeros((0, k)), np.zeros((0, k, k))
        start = np.searchsorted(item, np.arange(n))
        count = np.diff(np.append(start, len(item)))[:, None, None]
        tau, rows = np.zeros((n, k, k)), np.arange(len(item))
        for r in range(rounds + 1):
            logit = self.sigma[who] + tau[item]
            p = np.exp(logit - logit.max(axis=2, keepdims=True))
            p /= p.sum(axis=2, keepdims=True)
            log_q = np.log(self.prior) + np.add.reduceat(np.log(np.maximum(p[rows, :, said], 1e-300)), start)
            q = np.exp(log_q - log_q.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            if r == rounds:
                return q, p
            miss = -p
            miss[rows, :, said] += 1
            grad = np.add.reduceat(miss, start) * q[:, :, None] - self.item_penalty * tau
            tau += grad / (0.25 * count * q[:, :, None] + self.item_penalty)
        raise AssertionError

    def sums(self, who: np.ndarray, said: np.ndarray, p: np.ndarray, w: np.ndarray) -> dict[int, np.ndarray]:
        """Gradient of sigma and expected answers for each labeler here; w: the weight of each vote under each class."""
        if not len(who):
            return {}
        miss = -p
        miss[np.arange(len(who)), :, said] += 1
        both = np.concatenate((w[:, :, None] * miss, w[:, :, None] * p), axis=1).reshape(len(who), -1)
        order = np.argsort(who, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(who[order]) > 0)))
        return dict(zip(who[order][first].tolist(), np.add.reduceat(both[order], first)))


class _Sums:
    """What a task adds up: a table per labeler met, and the mass of the classes under a null name."""

    def __init__(self, model: Entropy):
        self.model, self.tables, self.mass = model, {}, np.zeros(len(model.prior))

    def add(self, sums: dict[int, np.ndarray], mass: np.ndarray) -> None:
        for i, v in sums.items():
            self.tables[i] = self.tables[i] + v if i in self.tables else v
        self.mass += mass

    def batch(self) -> pa.RecordBatch:
        names = list(self.model.index)
        rows = [v.tolist() for v in self.tables.values()]
        return pa.RecordBatch.from_arrays([pa.array([*(names[i] for i in self.tables), None], pa.string()), pa.array([*rows, self.mass.tolist()], pa.list_(pa.float64()))], ["labeler", "v"])


def _newton(gradient: np.ndarray, expected: np.ndarray, sigma: np.ndarray, penalty: float) -> np.ndarray:
    """The step of one labeler's table, one row (true class) at a time, with the row's whole curvature."""
    k = len(sigma)
    n = expected.sum(axis=1, keepdims=True)
    mean = expected / np.maximum(n, 1e-300)
    curve = n[:, :, None] * (mean[:, :, None] * np.eye(k) - mean[:, :, None] * mean[:, None, :]) + penalty * np.eye(k)
    return np.linalg.solve(curve, (gradient - penalty * sigma)[:, :, None])[:, :, 0]


def fit(items: DataFrame, one_pass: Callable, model: Entropy, passes: int, penalty: float = 1.0, tolerance: float = 0.02, learn_prior: bool = True) -> Entropy:
    """Climbs until no coordinate moves by more than `tolerance`, `passes` passes at most. one_pass: (batches, model) to sums.
    Sums are added as decimals, so the order of tasks does not matter."""
    spark = items.sparkSession
    k = len(model.prior)
    for _ in range(passes):
        shared = spark.sparkContext.broadcast(model)  # a table per labeler, at most MAX_LABELERS
        parts = items.mapInArrow(lambda it: one_pass(it, shared.value), "labeler string, v array<double>")  # noqa: B023
        sums = parts.select("labeler", F.posexplode("v").alias("i", "x")).groupBy("labeler", "i").agg(F.sum(F.round("x", 9).cast("decimal(30,9)")).cast("double").alias("x"))
        sums = sums.groupBy("labeler").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).collect()  # one row per labeler
        fresh = Entropy(list(model.index), k, model.item_penalty)
        fresh.sigma, fresh.prior = model.sigma.copy(), model.prior
        moved = 0.0
        for r in sums:
            v = np.array([x["x"] for x in r.v])
            if r.labeler is not None:
                i = model.index[r.labeler]
                step = np.clip(_newton(*v.reshape(2, k, k), model.sigma[i], penalty), -2, 2)
                fresh.sigma[i] += step
                moved = max(moved, float(np.abs(step).max()))
            elif learn_prior:
                fresh.prior = (v + 1) / (v.sum() + k)
        shared.unpersist()
        model = fresh
        if moved < tolerance:
            break
    return model


def _codes(names: pa.Array, index: dict[str, int]) -> np.ndarray:
    enc = names.dictionary_encode()
    return np.array([index[x] for x in enc.dictionary.to_pylist()], np.int64)[enc.indices.to_numpy()] if len(names) else np.zeros(0, np.int64)


def _lists(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """(length of each list, all values in a row)."""
    return np.diff(column.offsets.to_numpy()), column.flatten()


def _slices(batches: Iterator[pa.RecordBatch], n: int = 2000) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, n):
            yield b.slice(i, n)


def _votes(b: pa.RecordBatch, model: Entropy) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length, names = _lists(b.column("who"))
    said = b.column("said").flatten().to_numpy().astype(np.int64)
    return np.repeat(np.arange(b.num_rows), length), _codes(names, model.index), said


def _category_pass(batches: Iterator[pa.RecordBatch], model: Entropy) -> Iterator[pa.RecordBatch]:
    out = _Sums(model)
    for b in _slices(batches):
        item, who, said = _votes(b, model)
        q, p = model.posteriors(item, who, said, b.num_rows)
        w = q * b.column("n").to_numpy()[:, None]
        out.add(model.sums(who, said, p, w[item]), w.sum(axis=0))
    yield out.batch()


def _category_rows(batches: Iterator[pa.RecordBatch], model: Entropy) -> Iterator[pa.RecordBatch]:
    """The nodes with the posterior of their category."""
    for b in _slices(batches):
        item, who, said = _votes(b, model)
        some, item = np.unique(item, return_inverse=True)
        q = np.full((b.num_rows, len(model.prior)), 1 / len(model.prior))
        q[some] = model.posteriors(item, who, said, len(some))[0]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(q.tolist(), pa.list_(pa.float64()))], [*b.schema.names, "q"])


# ---- grouping ------------------------------------------------------------------------------------


def _partitions(d: int) -> list[list[int]]:
    """All partitions of d nodes, as group numbers."""
    out = [[]]
    for _ in range(d):
        out = [[*p, g] for p in out for g in range(max(p, default=-1) + 2)]
    return out


_SMALL = {d: np.array(_partitions(d)) for d in range(1, 5)}
_TOGETHER = {d: p[:, :, None] == p[:, None, :] for d, p in _SMALL.items()}


def partition(w: np.ndarray, starts: list[np.ndarray]) -> np.ndarray:
    """Group numbers that collect the most weight; w is symmetric with an empty diagonal. The first best of all partitions of
    up to four nodes, else the best end of climbs from `starts`."""
    d = len(w)
    if d <= 4:
        return _SMALL[d][(_TOGETHER[d] * w).sum(axis=(1, 2)).argmax()]
    best, best_score = None, -np.inf
    for start in {tuple(x.tolist()): None for x in starts}:
        lab = _climb(w, np.array(start))
        score = w[lab[:, None] == lab[None, :]].sum()
        if score > best_score + 1e-9:
            best, best_score = lab, score
    return best


def _climb(w: np.ndarray, lab: np.ndarray) -> np.ndarray:
    """Moves single nodes, then joins whole groups, while either gains; the sum rises with every step, so it ends."""
    d = len(w)
    while True:
        moved = False
        for u in range(d):
            gain = np.bincount(lab, w[u], minlength=d + 1)
            size = np.bincount(lab, minlength=d + 1)
            size[lab[u]] -= 1
            gain[size == 0] = -np.inf
            gain[np.flatnonzero(size == 0)[0]] = 0.0  # alone
            k = int(gain.argmax())
            now = gain[lab[u]] if size[lab[u]] else 0.0
            if gain[k] > now + 1e-9:
                lab[u], moved = k, True
        names, small = np.unique(lab, return_inverse=True)
        one = np.zeros((d, len(names)))
        one[np.arange(d), small] = 1
        between = one.T @ w @ one
        np.fill_diagonal(between, -np.inf)
        a, b = divmod(int(between.argmax()), len(names)) if len(names) > 1 else (0, 0)
        if a != b and between[a, b] > 1e-9:
            lab, moved = np.where(lab == names[b], names[a], lab), True
        if not moved:
            return lab


class _Runs:
    """Runs side by side: their nodes, and what was said of each."""

    def __init__(self, b: pa.RecordBatch, index: dict[str, int]):
        self.per_run, nodes = _lists(b.column("nodes"))
        self.run = np.repeat(np.arange(b.num_rows), self.per_run)
        field = lambda n: pc.struct_field(nodes, n)
        self.n, self.first = field("n").to_numpy(), field("first").to_pylist()
        self.h1, self.h2 = field("h1"), field("h2")
        self.q = np.array(field("q").flatten().to_numpy()).reshape(len(nodes), K)
        length, names = _lists(field("labelers"))
        at = np.repeat(np.arange(len(nodes)), length)
        context = field("contexts").flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
        grp = field("groups").flatten()
        said = np.flatnonzero(grp.is_valid().to_numpy(zero_copy_only=False))
        code = pc.fill_null(grp.dictionary_encode().indices, -1).to_numpy().astype(np.int64)
        who = _codes(names, index)
        # columns of statements: one labeler in one context in one run
        at, who, context, code = at[said], who[said], context[said], code[said]
        order = np.lexsort((at, context, who, self.run[at]))
        self.at, self.who, self.code = at[order], who[order], code[order]
        key = np.stack((self.run[self.at], self.who, context[order]))
        self.col = np.cumsum(np.concatenate(([0], (key[:, 1:] != key[:, :-1]).any(axis=0)))) if len(said) else np.zeros(0, np.int64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(u, v) of every pair of nodes that one column has both of, u = v for copies; (item, who, said) of the votes."""
        total = len(self.run)
        copied = self.n[self.at] > 1
        keys, who, said = [self.at[copied] * (total + 1)], [self.who[copied]], [np.ones(int(copied.sum()), np.int64)]
        for gap in range(1, len(self.at)):
            x = np.flatnonzero(self.col[gap:] == self.col[:-gap])
            if not len(x):
                break
            keys.append(self.at[x] * total + self.at[x + gap])
            who.append(self.who[x])
            said.append((self.code[x] == self.code[x + gap]).astype(np.int64))
        key, who, said = (np.concatenate(c) for c in (keys, who, said))
        names, item = np.unique(key, return_inverse=True)
        order = np.argsort(item, kind="stable")
        return names // max(1, total), names % max(1, total), item[order], who[order], said[order]

    def groups(self, u: np.ndarray, v: np.ndarray, q: np.ndarray, prior: np.ndarray) -> np.ndarray:
        """The group number of each node within its run."""
        lab = np.zeros(len(self.run), np.int64)
        odds = np.log(np.maximum(q[:, 1], 1e-12)) - np.log(np.maximum(q[:, 0], 1e-12)) if len(q) else np.zeros(0)
        other = u != v
        u, v, odds = u[other], v[other], odds[other]
        ends = np.cumsum(self.per_run)
        scaled, top = self.q / prior, self.q.argmax(axis=1)
        pair_run, stated = self.run[u], self.run[self.at]
        for r in np.flatnonzero(self.per_run > 1):
            lo, hi = ends[r] - self.per_run[r], ends[r]
            d = hi - lo
            w = TILT * np.clip(np.log(np.maximum(scaled[lo:hi] @ self.q[lo:hi].T, 1e-9)), -2, 2)
            own = slice(*np.searchsorted(pair_run, (r, r + 1)))
            w[u[own] - lo, v[own] - lo] += odds[own]
            w[v[own] - lo, u[own] - lo] += odds[own]
            w *= np.outer(self.n[lo:hi], self.n[lo:hi])
            np.fill_diagonal(w, 0)
            starts = []
            if d > 4:
                starts = [np.arange(d), np.unique(top[lo:hi], return_inverse=True)[1]]
                s = slice(*np.searchsorted(stated, (r, r + 1)))
                for c in np.unique(self.col[s]):
                    mine = self.col[s] == c
                    start = -1 - np.arange(d)
                    start[self.at[s][mine] - lo] = self.code[s][mine]
                    starts.append(np.unique(start, return_inverse=True)[1])
            lab[lo:hi] = partition(w, starts)
        return lab


def _run_slices(batches: Iterator[pa.RecordBatch], pairs: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Runs of bounded numbers of node pairs together; a larger run alone."""
    for b in batches:
        d = np.diff(b.column("nodes").offsets.to_numpy()).astype(float)
        part = np.floor(np.cumsum(d * d + 50) / pairs).astype(np.int64)
        cut = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [b.num_rows]))
        for i, j in zip(cut[:-1], cut[1:]):
            if j > i:
                yield b.slice(i, j - i)


def _group_pass(batches: Iterator[pa.RecordBatch], model: Entropy, prior: np.ndarray) -> Iterator[pa.RecordBatch]:
    out = _Sums(model)
    for b in _run_slices(batches):
        runs = _Runs(b, model.index)
        u, v, item, who, said = runs.pairs()
        q, p = model.posteriors(item, who, said, len(u))
        lab = runs.groups(u, v, q, prior)
        truth = (lab[u] == lab[v]).astype(np.int64)
        n = runs.n.astype(float)
        w = np.zeros((len(u), 2))
        w[np.arange(len(u)), truth] = np.where(u == v, n[u] * (n[u] - 1) / 2, n[u] * n[v])
        out.add(model.sums(who, said, p, w[item]), w.sum(axis=0))
    yield out.batch()


def _consensus_rows(batches: Iterator[pa.RecordBatch], model: Entropy, prior: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in _run_slices(batches):
        runs = _Runs(b, model.index)
        u, v, item, who, said = runs.pairs()
        lab = runs.groups(u, v, model.posteriors(item, who, said, len(u))[0], prior)
        names, group = np.unique(np.stack((runs.run, lab)), axis=1, return_inverse=True)
        group = group.ravel()
        size = np.bincount(group, runs.n, names.shape[1])
        log_q = np.zeros((names.shape[1], K))
        np.add.at(log_q, group, runs.n[:, None] * np.log(np.maximum(runs.q, 1e-12)))
        log_q -= (size - 1)[:, None] * np.log(prior)
        q = np.exp(log_q - log_q.max(axis=1, keepdims=True))
        share = q.max(axis=1) / q.sum(axis=1)
        least: dict[int, str] = {}
        for g, f in zip(group.tolist(), runs.first):
            least[g] = min(f, least.get(g, f))
        cols = [
            pa.array(np.array(b.column("run_id").to_pylist(), object)[runs.run], pa.string()), runs.h1, runs.h2, pa.array(np.array(CATEGORIES, object)[log_q.argmax(axis=1)[group]], pa.string()),
            pa.array(share[group]), pa.array([least[g] for g in group.tolist()], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(cols, ["run_id", "h1", "h2", "category", "confidence", "first_of_group"])


def _pair_agreement(batches: Iterator[pa.RecordBatch], index: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Pairs of failures both of two statements of different labelers grouped, and those grouped alike."""
    pairs = alike = 0.0
    for b in _run_slices(batches):
        runs = _Runs(b, index)
        u, v, item, who, said = runs.pairs()
        if len(item):
            n = runs.n.astype(float)
            weight = np.where(u == v, n[u] * (n[u] - 1) / 2, n[u] * n[v])
            # of an item's votes, all pairs by different labelers: all pairs less those of one labeler
            t, s = np.bincount(item), np.bincount(item, said)
            key = item * (int(who.max()) + 1) + who
            names, own = np.unique(key, return_inverse=True)
            of = names // (int(who.max()) + 1)
            t1, s1 = np.bincount(own), np.bincount(own, said)
            both = lambda x: x * (x - 1) / 2
            pairs += (weight * (both(t) - np.bincount(of, both(t1), len(t)))).sum()
            alike += (weight * (both(s) + both(t - s) - np.bincount(of, both(s1) + both(t1 - s1), len(t)))).sum()
    yield pa.RecordBatch.from_arrays([pa.array([float(pairs)]), pa.array([float(alike)])], ["pairs", "alike"])


def _per_run(nodes: DataFrame) -> DataFrame:
    """run_id and its nodes: its distinct statements, not its failures."""
    return nodes.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("first", "h1", "h2", "n", "labelers", "contexts", "groups", "q"))).alias("nodes"))


class Statements:
    """What was said: `failures` with their statements, `nodes` (failures of a run with equal ones, counted), `names` of labelers."""

    def __init__(self, run_labels: DataFrame):
        # a (run, failure) has at most two statements of a labeler, so a row is as long as there are labelers
        own = votes(run_labels).groupBy("run_id", "failure_id").agg(F.array_sort(F.collect_list(F.struct("labeler", "context", "category", "grp"))).alias("v"))
        self.failures = failures = written(own.select("run_id", "failure_id", F.xxhash64("v").alias("h1"), F.xxhash64("v", F.lit(1)).alias("h2"), "v"))
        self.statements = failures.select("run_id", "failure_id", F.explode("v").alias("s")).select("run_id", "failure_id", "s.*")
        nodes = failures.groupBy("run_id", "h1", "h2").agg(F.first("v").alias("v"), F.min("failure_id").alias("first"), F.count(F.lit(1)).alias("n"))
        voted = F.filter("v", lambda x: x["category"].isNotNull())
        self.nodes = written(nodes.select("run_id", "h1", "h2", "first", "n", voted["labeler"].alias("who"), voted["category"].alias("said"), F.col("v.labeler").alias("labelers"), F.col("v.context").alias("contexts"), F.col("v.grp").alias("groups")))
        self.names = sorted(r.labeler for r in self.statements.select("labeler").distinct().limit(MAX_LABELERS + 1).collect())
        if len(self.names) > MAX_LABELERS:
            raise ValueError(f"more than {MAX_LABELERS} labelers; a table of each is kept on every task")

    def agreement(self) -> DataFrame:
        """One row: failures and labels compared, observed and expected disagreement, Krippendorff's alpha; pairs of failures
        that two labelers both grouped, and the share grouped alike."""
        st = self.statements.where("category is not null")
        per = st.groupBy("run_id", "failure_id", "category").agg(F.count(F.lit(1)).alias("n"))
        unit = per.groupBy("run_id", "failure_id").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("s")).where("m > 1")
        kept = per.join(unit.select("run_id", "failure_id"), ["run_id", "failure_id"], "left_semi").groupBy("category").agg(F.sum("n").alias("n"))
        a = unit.agg(F.count(F.lit(1)).alias("n_failures"), F.sum("m").alias("n_labels"), F.sum((F.col("m") * F.col("m") - F.col("s")) / (F.col("m") - 1)).alias("x"))
        b = kept.agg(F.sum(F.col("n") * F.col("n")).alias("s2"))
        observed = F.try_divide("x", "n_labels")
        expected = F.try_divide(F.col("n_labels") * F.col("n_labels") - F.col("s2"), F.col("n_labels") * (F.col("n_labels") - 1))
        cat = a.join(b).select("n_failures", "n_labels", observed.alias("observed_disagreement"), expected.alias("expected_disagreement"), (1 - F.try_divide(observed, expected)).alias("alpha"))
        index = {n: i for i, n in enumerate(self.names)}
        runs = _per_run(self.nodes.withColumn("q", F.array_repeat(F.lit(1 / K), K)))
        pairs = runs.mapInArrow(lambda it: _pair_agreement(it, index), "pairs double, alike double").agg(F.sum("pairs").alias("n_group_pairs"), F.try_divide(F.sum("alike"), F.sum("pairs")).alias("group_agreement"))
        return cat.join(pairs)


class Consensus(Statements):
    """Fits both models to a label table; `model` and `pair_model` are kept."""

    def __init__(self, run_labels: DataFrame, passes: int = 40, group_passes: int = 20):
        super().__init__(run_labels)
        spark, nodes, names = run_labels.sparkSession, self.nodes, self.names
        tasks = max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism)
        items = nodes.where(F.size("said") > 0).groupBy("who", "said").agg(F.sum("n").alias("n"))
        self.items = written(items.repartition(tasks))
        self.model = model = fit(self.items, _category_pass, Entropy(names, K, 4.0), passes)
        shared = spark.sparkContext.broadcast(model)
        schema = "run_id string, h1 long, h2 long, first string, n long, who array<string>, said array<int>, labelers array<string>, contexts array<string>, groups array<string>, q array<double>"
        self.runs = written(_per_run(nodes.mapInArrow(lambda it: _category_rows(it, shared.value), schema)).repartition(tasks))
        prior = model.prior
        some = self.runs.where("exists(nodes, x -> x.n > 1) or size(nodes) > 1")
        # the classes of a pair have no prior of their own: how many pairs differ says more of the sizes of runs than of the two
        self.pair_model = fit(some, lambda it, m: _group_pass(it, m, prior), Entropy(names, 2, 4.0), group_passes, learn_prior=False)

    def rows(self, least: int = 3) -> DataFrame:
        """run_id, failure_id, category, confidence, first_of_group, n_labelers."""
        pair_model, prior = self.pair_model, self.model.prior
        nodes = self.runs.mapInArrow(lambda it: _consensus_rows(it, pair_model, prior), "run_id string, h1 long, h2 long, category string, confidence double, first_of_group string")
        n = F.size(F.array_distinct("v.labeler")).alias("n_labelers")
        own = self.failures.select("run_id", "failure_id", "h1", "h2", n).where(F.col("n_labelers") >= least)
        return own.join(nodes, ["run_id", "h1", "h2"]).select("run_id", "failure_id", "category", "confidence", "first_of_group", "n_labelers")

    def labelers(self) -> DataFrame:
        """labeler, n_labels, expected accuracy under the posteriors, and how likely they put two failures of one cause, and of two
        causes, together (null for labelers who grouped nothing)."""
        spark = self.runs.sparkSession
        shared = spark.sparkContext.broadcast(self.model)
        each = self.items.mapInArrow(lambda it: _accuracy(it, shared.value), "labeler string, n double, hit double")
        acc = each.groupBy("labeler").agg(F.sum("n").cast("long").alias("n_labels"), (F.sum("hit") / F.sum("n")).alias("expected_accuracy"))
        grouped = self.statements.where("grp is not null").select("labeler").distinct()
        p = np.exp(self.pair_model.sigma)
        p = p[:, :, 1] / p.sum(axis=2)
        rows = [(n, float(p[i, 1]), float(p[i, 0])) for n, i in self.pair_model.index.items()]
        rates = spark.createDataFrame(rows, "labeler string, joins_same_cause double, joins_other_cause double").join(grouped, "labeler", "left_semi")
        return acc.join(rates, "labeler", "left")

def _accuracy(batches: Iterator[pa.RecordBatch], model: Entropy) -> Iterator[pa.RecordBatch]:
    """Per task and labeler: votes, and how many of them the posteriors expect to be right."""
    n, hit = np.zeros(len(model.index)), np.zeros(len(model.index))
    for b in _slices(batches):
        item, who, said = _votes(b, model)
        q, _ = model.posteriors(item, who, said, b.num_rows)
        weight = b.column("n").to_numpy()[item]
        n += np.bincount(who, weight, len(n))
        hit += np.bincount(who, weight * q[item, said], len(n))
    some = np.flatnonzero(n)
    names = list(model.index)
    yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in some], pa.string()), pa.array(n[some]), pa.array(hit[some])], ["labeler", "n", "hit"])
