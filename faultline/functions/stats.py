"""Statistics as columns: pair counts, precision/recall/F1, Wilson intervals, a counter-based generator, bootstraps."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.session import written

SEED = 0x0C0FFEE
RESAMPLES = 2000
SENT_ALONG = 32 << 20
_MASK = (1 << 32) - 1
_STEP = 0x6D2B79F5


def nan() -> Column:
    return F.lit(float("nan"))


def choose2(n: Column) -> Column:
    """n(n-1)/2 as a whole number; n(n-1) is even."""
    return F.shiftright(n * (n - 1), 1)


def pair_counts(df: DataFrame, by: list[str], predicted: str, truth: str) -> DataFrame:
    """tp, fp, fn, tn over all pairs of rows within `by`, from contingency counts: no pair is ever made.

    Null predictions or truths are values of their own."""
    joint = df.groupBy(*by, F.col(predicted).alias("_p"), F.col(truth).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    # one pass over the joint counts yields all three margins
    sides = joint.select(*by, "_n", F.explode(F.array(
        F.struct(F.lit(0).alias("k"), F.col("_p").cast("string").alias("a"), F.col("_t").cast("string").alias("b")),
        F.struct(F.lit(1).alias("k"), F.col("_p").cast("string").alias("a"), F.lit(None).cast("string").alias("b")),
        F.struct(F.lit(2).alias("k"), F.lit(None).cast("string").alias("a"), F.col("_t").cast("string").alias("b")),
        F.struct(F.lit(3).alias("k"), F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b")),
    )).alias("s"))
    cells = sides.groupBy(*by, "s").agg(F.sum("_n").alias("_n"))
    s = [F.coalesce(F.sum(F.when(F.col("s.k") == k, choose2(F.col("_n")))), F.lit(0)) for k in range(4)]
    sums = cells.groupBy(*by).agg(*(x.alias(f"_s{k}") for k, x in enumerate(s)), F.sum(F.when(F.col("s.k") == 3, F.col("_n"))).alias("n"))
    tp, sp, st, sn = (F.col(f"_s{k}") for k in range(4))
    return sums.select(*by, "n", tp.alias("tp"), (sp - tp).alias("fp"), (st - tp).alias("fn"), (sn - sp - st + tp).alias("tn"))


def ratio(a: Column, b: Column, undefined: str = "nan") -> Column:
    x = F.try_divide(a.cast("double"), b.cast("double"))
    return F.coalesce(x, nan()) if undefined == "nan" else x


def prf(tp: Column, fp: Column, fn: Column, undefined: str = "nan") -> dict[str, Column]:
    """precision, recall and f1; undefined ones are NaN (or null), an f1 of nothing right is 0."""
    return {"precision": ratio(tp, tp + fp, undefined), "recall": ratio(tp, tp + fn, undefined), "f1": ratio(2 * tp, 2 * tp + fp + fn, undefined)}


def z_for(level: float = 0.95) -> float:
    return NormalDist().inv_cdf(1 - (1 - level) / 2)


def wilson(successes: Column, n: Column, level: float = 0.95) -> dict[str, Column]:
    """point, lower, upper; without trials the point is NaN and the bounds are 0 and 1. Impossible counts raise."""
    z = z_for(level)
    s, t = successes.cast("double"), n.cast("double")
    safe = F.when(t > 0, t).otherwise(1.0)
    p = s / safe
    denom = 1 + z * z / safe
    center = (p + z * z / (2 * safe)) / denom
    half = z * F.sqrt(F.greatest(F.lit(0.0), p * (1 - p) / safe + z * z / (4 * safe * safe))) / denom
    bad = (successes < 0) | (n < 0) | (successes > n)
    checked = lambda c: F.when(bad, F.raise_error(F.lit("0 <= successes <= n is required")).cast("double")).otherwise(c)
    return {
        "point": checked(F.when(t > 0, p).otherwise(nan())),
        "lower": checked(F.when(t > 0, F.greatest(F.lit(0.0), center - half)).otherwise(0.0)),
        "upper": checked(F.when(t > 0, F.least(F.lit(1.0), center + half)).otherwise(1.0)),
    }


def gate_passes(lower: Column, threshold: float) -> Column:
    return ~F.isnan(lower) & (lower >= threshold)


def _imul(a: Column, b: Column) -> Column:
    """32-bit product modulo 2^32 without overflowing a signed 64-bit number."""
    high = F.shiftright(a, 16) * b
    return (F.shiftleft(high.bitwiseAND(0xFFFF), 16) + a.bitwiseAND(0xFFFF) * b).bitwiseAND(_MASK)


def draw(k: Column, seed: int = SEED) -> Column:
    """The k-th number (k from 1) in [0, 1) of the generator with this seed, as a function of k alone."""
    a = (F.lit(seed & _MASK) + k.cast("long").bitwiseAND(_MASK) * F.lit(_STEP)).bitwiseAND(_MASK)
    t = _imul(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1).cast("long")))
    t = t.bitwiseXOR((t + _imul(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61).cast("long")))).bitwiseAND(_MASK))
    return t.bitwiseXOR(F.shiftright(t, 14)) / float(1 << 32)


def python_draws(seed: int):
    """The same generator as an iterator, for driver-side permutations of small tables."""
    a = seed & _MASK
    while True:
        a = (a + _STEP) & _MASK
        t = ((a ^ (a >> 15)) * (a | 1)) & _MASK
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & _MASK)) & _MASK
        yield ((t ^ (t >> 14)) & _MASK) / 2**32


def shuffled(items: list, seed: int) -> list:
    out, rng = list(items), python_draws(seed)
    for i in range(len(out) - 1, 0, -1):
        j = int(next(rng) * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out


def seed_of(text: str) -> int:
    """FNV-1a over UTF-16 code units."""
    h, raw = 0x811C9DC5, text.encode("utf-16-be")
    for i in range(0, len(raw), 2):
        h = ((h ^ (raw[i] << 8 | raw[i + 1])) * 16777619) & _MASK
    return h


def bootstrap(units: DataFrame, order: list[str], sums: list[str], statistic: Column, by: list[str] | None = None, resamples: int = RESAMPLES, seed: int = SEED, level: float = 0.95) -> DataFrame:
    """Percentile interval of `statistic` (over the sums of `sums`) from resampled whole units, per group `by`.

    Units are numbered by `order` within their group; resample b's slot i takes unit floor(u * n) with the
    generator's draw b*n + i + 1. Every (group, resample) is a row of its own before its slots are drawn, dealt out over all
    tasks; a resample's draws meet the units there, where they are few enough to be sent along, and are summed where they
    were drawn. Groups of one unit have a point and NaN bounds. Columns: by, n, point, lower, upper.
    """
    from pyspark.sql import Window

    by = by or []
    spark = units.sparkSession
    # units are few numbers each and read three times; groups go by a 64-bit hash, so a draw is three numbers
    units = written(units.select(*by, *order, *sums, (F.xxhash64(*by) if by else F.lit(0).cast("long")).alias("_g")))
    w = Window.partitionBy("_g")
    numbered = units.select("_g", *(F.col(c) for c in sums), (F.row_number().over(w.orderBy(*order)) - 1).alias("_i"))
    groups = units.groupBy("_g").agg(F.count(F.lit(1)).alias("_m"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    slots = groups.select("_g", "_m", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("_b")).repartition(tasks, "_g", "_b")
    slots = slots.select("_g", "_b", "_m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)).alias("_s"))
    # never null, so no filter repeats the whole expression under the join
    slot = F.coalesce(F.floor(draw(F.col("_b") * F.col("_m") + F.col("_s") + 1, seed) * F.col("_m")).cast("int"), F.lit(0))
    picks = slots.select("_g", "_b", slot.alias("_i"))
    # draws outnumber the units by `resamples` and never travel where the units, counted first, can
    small = units.count() * 8 * (len(sums) + 3) < SENT_ALONG
    numbered = F.broadcast(numbered) if small else numbered.hint("merge")
    drawn = picks.join(numbered, ["_g", "_i"]).groupBy("_g", "_b").agg(*(F.sum(c).alias(c) for c in sums))
    stat = drawn.select("_g", statistic.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    tail = (1 - level) / 2
    bounds = stat.groupBy("_g").agg(F.percentile("_x", F.lit(tail)).alias("lower"), F.percentile("_x", F.lit(1 - tail)).alias("upper"))
    total = units.groupBy(*by, "_g").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in sums)).select(*by, "_g", "n", statistic.alias("point"))
    out = total.join(bounds, "_g", "left")
    single = F.col("n") < 2
    return out.select(*by, "n", "point", *(F.when(single, nan()).otherwise(F.coalesce(c, nan())).alias(c) for c in ("lower", "upper")))


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The element at floor(n/2) of each group's ascending values, found from value counts."""
    from pyspark.sql import Window

    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    if not by:
        # how many values lie below comes from sums per value, in order, by one sort over all tasks: no single window
        total = counts.agg(F.sum("_c").alias("_n"))
        parts = written(counts.orderBy(value).select(value, "_c", F.spark_partition_id().alias("_k")))  # read twice, and must not be dealt out anew
        before = parts.groupBy("_k").agg(F.sum("_c").alias("_s"))
        earlier = Window.partitionBy(F.lit(1)).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
        before = before.select("_k", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s"))
        run = parts.join(F.broadcast(before), "_k").withColumn("_u", F.col("_s") + F.sum("_c").over(Window.partitionBy("_k").orderBy(value)))
        return run.join(F.broadcast(total)).where(F.col("_u") > F.floor(F.col("_n") / 2)).agg(F.min(value).alias("upper_median"))
    w = Window.partitionBy(*by)
    run = counts.withColumn("_u", F.sum("_c").over(w.orderBy(value))).withColumn("_n", F.sum("_c").over(w))
    return run.where(F.col("_u") > F.floor(F.col("_n") / 2)).groupBy(*by).agg(F.min(value).alias("upper_median"))
