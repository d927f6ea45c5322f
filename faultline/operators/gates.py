"""The gate: what a corpus must hold before it is used, counted over what may be committed, machine labels left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators import corpus, scoring

#: Requirements as reports give them: id, description, floor; fixed values.
FLOORS = (
    ("runs", ">=80 complete CI runs", 80), ("multi-failure-runs", ">=50 runs with >=5 failures each", 50), ("failures", ">=1000 labeled failures total", 1000),
    ("repositories", ">=10 distinct repositories", 10), ("frameworks", ">=3 frameworks", 3), ("labelers", ">=2 independent labelers", 2),
)
SYNTHETIC_PERCENT, CATEGORY_FLOOR = 20, 30
AGREEMENT_FLOOR, SEPARABILITY_FLOOR = 0.8, 0.6
NEEDS_TWO = "agreement needs two people who label the same failures independently"
NEEDS_LABELS = "separability needs a labeler who sees only the payload, beside labels of full context"


def sizes(runs: DataFrame, failures: DataFrame) -> DataFrame:
    """corpusRunId, repo, fidelity and n (stored failures) of every run that may be committed."""
    n = failures.groupBy("corpusRunId").agg(F.count(F.lit(1)).alias("n"))
    kept = corpus.committable(runs).select("corpusRunId", F.coalesce("source.repo", F.lit("?")).alias("repo"), "fidelity")
    return kept.join(n, "corpusRunId", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def frameworks_seen(flags: DataFrame) -> DataFrame:
    """The distinct frameworks of scoring.frame_flags, in order; failures without one add none."""
    return flags.where("framework <> 'unidentified'").select("framework").distinct().orderBy("framework")


def counted(per_run: DataFrame, flags: DataFrame, labels: DataFrame) -> DataFrame:
    """id, description, observed, required, met of the counted requirements.

    per_run: as `sizes`; flags: corpusRunId and framework of each failure; labels: one row per label. A category's floor counts distinct
    failures, and a failure that two people put into different categories counts for both."""
    human = labels.where(~corpus.is_machine())
    key = F.struct("corpusRunId", "failureId")
    seen = flags.join(per_run.select("corpusRunId"), "corpusRunId", "left_semi")
    a = per_run.agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("n") >= 5).alias("multi-failure-runs"), F.count_distinct("repo").alias("repositories"), F.count_if(F.col("fidelity") == "synthetic").alias("synthetic")
    )
    b = human.agg(F.count_distinct(key).alias("failures"), F.count_distinct("labeler").alias("labelers"))
    c = seen.where("framework <> 'unidentified'").agg(F.count_distinct("framework").alias("frameworks"))
    one = lambda i, d, seen, floor, met: F.struct(F.lit(i).alias("id"), F.lit(d).alias("description"), seen.cast("double").alias("observed"), F.lit(float(floor)).alias("required"), met.alias("met"))
    floors = [one(i, d, F.col(f"`{i}`"), k, F.col(f"`{i}`") >= k) for i, d, k in FLOORS]
    share = F.coalesce(F.try_divide(F.col("synthetic"), F.col("runs")), F.lit(0.0))
    cap = one("synthetic-cap", f"synthetic runs <={SYNTHETIC_PERCENT}% of corpus", F.round(share * 100, 1), SYNTHETIC_PERCENT, share <= SYNTHETIC_PERCENT / 100)
    rows = a.join(b).join(c).select(F.explode(F.array(*floors, cap)).alias("x")).select("x.*")
    n = human.groupBy("category").agg(F.count_distinct(key).cast("double").alias("observed"))
    what = F.format_string(f">={CATEGORY_FLOOR} examples of %s to carry a precision gate", "category")
    cats = n.select(F.concat(F.lit("category:"), "category").alias("id"), what.alias("description"), "observed", F.lit(float(CATEGORY_FLOOR)).alias("required"), (F.col("observed") >= CATEGORY_FLOOR).alias("met"))
    return rows.unionByName(cats)


def measured(pairs: DataFrame, separable: DataFrame, **how) -> DataFrame:
    """The weakest pair's lower bounds of grouping agreement and of separability; what is not measured is unmet. Bounds are rounded,
    so the weakest pair does not depend on the order of sums; ties go to the smallest names."""
    def weakest(df: DataFrame, id: str, floor: float) -> DataFrame:
        named = df.where(~F.isnan("lower")).select(F.round("lower", 9).alias("lower"), F.concat_ws(" vs ", *scoring.PAIR).alias("pair"))
        return named.agg(F.min(F.struct("lower", "pair")).alias("m")).select(F.lit(id).alias("id"), "m.lower", "m.pair", F.lit(floor).alias("required"))

    out = weakest(scoring.grouping_agreement(pairs, **how), "grouping-agreement", AGREEMENT_FLOOR).unionByName(weakest(scoring.category_agreement(separable, **how), "separability", SEPARABILITY_FLOOR))
    return out.withColumn("met", F.coalesce(F.col("lower") >= F.col("required"), F.lit(False)))


def table(counts: DataFrame, gates: DataFrame) -> DataFrame:
    """Both kinds of requirements as one table, in the order reports give them."""
    g = gates.select("id", F.concat(F.lit("lower bound of the weakest pair: "), F.coalesce("pair", F.lit("none"))).alias("description"), F.col("lower").alias("observed"), "required", "met")
    order = F.array_position(F.array(*(F.lit(i) for i, _, _ in FLOORS), F.lit("synthetic-cap")), F.col("id"))
    last = F.when(F.col("id").isin("grouping-agreement", "separability"), 2).when(order == 0, 1).otherwise(0)
    return counts.unionByName(g).withColumn("state", corpus.requirement_state(F.col("observed").isNotNull(), F.col("observed"), F.col("met"))).orderBy(last, order, "id")


def held_out(runs: DataFrame, failures: DataFrame) -> DataFrame:
    """One row on the runs kept out: runs, failures, repositories, runs of five failures or more, and of 5 to 24."""
    n = failures.groupBy("corpusRunId").agg(F.count(F.lit(1)).alias("n"))
    out = runs.where(corpus.hold_out_reason(F.col("source.licenseSpdx")).isNotNull()).join(n, "corpusRunId", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.agg(
        F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum("n"), F.lit(0)).alias("failures"), F.count_distinct("source.repo").alias("repositories"),
        F.count_if(F.col("n") >= 5).alias("runs_with_5_failures"), F.count_if(F.col("n").between(5, 24)).alias("runs_in_band"),
    )


def blocked_on_people(labelers: int, labelled: int) -> list[str]:
    """What no tool can measure for want of labels."""
    return [text for missing, text in ((labelers < 2, NEEDS_TWO), (labelled == 0, NEEDS_LABELS)) if missing]
