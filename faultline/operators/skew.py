"""Per-key work when a few keys hold most rows: fragment-replicate by estimated load.

Keys are counted once (the count is combined map-side, so a hot key costs one row per map task). Only keys
above a task's fair share are planned one by one; there can be at most `4 * tasks` of them, whatever the
data, so the plan is bounded. A planned key is split into shards in proportion to its load, and the
shards are bin-packed onto tasks, largest first, on top of the hash-spread load of all other keys. Rows
of a planned key go to one of its shards, and the matching side of a join is replicated to just those.

Defined results: a null key is a key of its own for per-key results and matches nothing in a join; an
empty input gives an empty result. Columns may carry any names; those added here begin with `_fr_`.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.session import shuffle_partitions


@dataclass
class LoadPlan:
    """tasks: the number of bins; shards: for each planned key the bins of its shards (repeats allowed)."""

    tasks: int
    total: int = 0
    shards: list[tuple[object, list[int]]] = field(default_factory=list)

    def loads(self, counts: dict) -> list[float]:
        """Planned rows per bin, with the unplanned ones spread evenly."""
        rest = self.total - sum(counts[k] for k, _ in self.shards)
        out = [rest / self.tasks] * self.tasks
        for k, bins in self.shards:
            for b in bins:
                out[b] += counts[k] / len(bins)
        return out


def pack(counts: list[tuple[object, int]], total: int, tasks: int) -> LoadPlan:
    """Splits each heavy key into shards of at most half a task's fair share and packs them, largest first."""
    plan = LoadPlan(tasks, total)
    rest = total - sum(n for _, n in counts)
    bins = [(rest / tasks, b) for b in range(tasks)]
    heapq.heapify(bins)
    unit = max(1.0, total / tasks / 2)
    for key, n in sorted(counts, key=lambda c: (-c[1], str(c[0]))):
        parts, own = max(1, -(-n // int(unit))), []
        for _ in range(parts):
            load, b = heapq.heappop(bins)
            own.append(b)
            heapq.heappush(bins, (load + n / parts, b))
        plan.shards.append((key, own))
    return plan


def plan_load(df: DataFrame, key: str, tasks: int | None = None) -> LoadPlan:
    """The plan for df's rows by `key`; only keys above a quarter of a task's fair share come to the driver."""
    tasks = tasks or shuffle_partitions(df.sparkSession)
    counts = df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    total = df.count()  # from the file footers where df is a scan
    heavy = counts.where((F.col("n") * (4 * tasks) > total) & F.col("k").isNotNull()).collect()
    return pack([(r.k, r.n) for r in heavy], total, tasks)


def _shards(plan: LoadPlan, df: DataFrame, key: str) -> DataFrame:
    """The plan as a table (bounded by its 4 * tasks keys): _fr_key, _fr_bins."""
    kind = dict(df.dtypes)[key]
    return df.sparkSession.createDataFrame([(k, bins) for k, bins in plan.shards], f"_fr_key {kind}, _fr_bins array<int>")


def _bin(plan: LoadPlan, key: str, row: Column) -> tuple[Column, Column]:
    """(shard, bin) of a row: the row's own shard for planned keys, the key's hash for others."""
    shard = F.pmod(F.xxhash64(row), F.coalesce(F.size("_fr_bins"), F.lit(1))).cast("int")
    planned = F.element_at("_fr_bins", shard + 1)
    return F.when(F.col("_fr_bins").isNull(), 0).otherwise(shard), F.coalesce(planned, F.pmod(F.xxhash64(key), F.lit(plan.tasks)).cast("int"))


def assign(df: DataFrame, key: str, plan: LoadPlan, spread: Column | None = None) -> DataFrame:
    """Adds _fr_shard and _fr_bin. spread: what picks the shard of a row of a planned key; all columns if none."""
    row = spread if spread is not None else F.struct(*(F.col(f"`{c}`").cast("string") for c, t in df.dtypes if not t.startswith("map")))
    j = df.withColumn("_fr_row", row).join(F.broadcast(_shards(plan, df, key)), F.col(key) == F.col("_fr_key"), "left")
    shard, b = _bin(plan, key, F.col("_fr_row"))
    return j.withColumn("_fr_shard", shard).withColumn("_fr_bin", b).drop("_fr_key", "_fr_bins", "_fr_row")


def balanced(df: DataFrame, key: str, plan: LoadPlan | None = None, spread: Column | None = None) -> DataFrame:
    """df with every task holding about the same number of rows; a row's _fr_bin is its partition."""
    plan = plan or plan_load(df, key)
    return assign(df, key, plan, spread).repartitionById(plan.tasks, F.col("_fr_bin"))


def per_key(df: DataFrame, key: str, partial: list[Column], final: list[Column], plan: LoadPlan | None = None, spread: Column | None = None) -> DataFrame:
    """Per-key results: `partial` aggregates of each (key, shard), then `final` aggregates over a key's shards."""
    rows = balanced(df, key, plan, spread)
    return rows.groupBy("_fr_bin", key, "_fr_shard").agg(*partial).groupBy(key).agg(*final)


def join(left: DataFrame, right: DataFrame, key: str, plan: LoadPlan | None = None, spread: Column | None = None, how: str = "inner") -> DataFrame:
    """left joined with right on `key` (inner or left): left's hot keys are cut into shards, and right's rows of
    those keys are copied to each shard, no further. Both sides are dealt out by the plan's bins, so a task holds the
    shards packed for it and no second exchange follows."""
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    return _joined(left, right, key, plan or plan_load(left, key), spread, how).drop("_fr_shard", "_fr_bin")


def _joined(left: DataFrame, right: DataFrame, key: str, plan: LoadPlan, spread: Column | None, how: str) -> DataFrame:
    a = balanced(left, key, plan, spread)
    b = right.join(F.broadcast(_shards(plan, left, key)), F.col(key) == F.col("_fr_key"), "left")
    own = F.array(F.struct(F.lit(0).alias("s"), F.pmod(F.xxhash64(key), F.lit(plan.tasks)).cast("int").alias("b")))
    copies = F.when(F.col("_fr_bins").isNull(), own).otherwise(F.transform("_fr_bins", lambda x, i: F.struct(i.alias("s"), x.alias("b"))))
    b = b.withColumn("_fr_c", F.explode(copies)).withColumns({"_fr_shard": F.col("_fr_c.s"), "_fr_bin": F.col("_fr_c.b")}).drop("_fr_c", "_fr_key", "_fr_bins")
    return a.join(b.repartitionById(plan.tasks, F.col("_fr_bin")), ["_fr_bin", key, "_fr_shard"], how)


def join_per_key(left: DataFrame, right: DataFrame, key: str, partial: list[Column], final: list[Column], plan: LoadPlan | None = None, spread: Column | None = None, how: str = "inner") -> DataFrame:
    """Per-key results of a join: `partial` aggregates of each shard where it was joined, `final` ones over a key's shards."""
    rows = _joined(left, right, key, plan or plan_load(left, key), spread, how)
    return rows.groupBy("_fr_bin", key, "_fr_shard").agg(*partial).groupBy(key).agg(*final)


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """The non-null keys that hold at least `share` of df's rows, with their counts."""
    plan = plan_load(df.select(key), key)
    # rows of a key alone are alike, so what spreads them is where they stand
    sums = per_key(df.select(key), key, [F.count(F.lit(1)).alias("n")], [F.sum("n").alias("n_rows")], plan, F.monotonically_increasing_id())
    return sums.where(F.col(key).isNotNull() & (F.col("n_rows") >= share * plan.total))
