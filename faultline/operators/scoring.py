"""Scoring of groupings against labels, agreement of labelers, separability, gates, reports on the corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import hashing, stats
from faultline.functions.frames import detect_framework, frame_summary, framework_or_adapter
from faultline.operators import corpus

#: Reasons as reports give them; fixed values.
TOO_FEW, NO_LABELS = "only %d labelled failure(s); a run needs 2 to contribute a pair", "no labels"

Grouping = Callable[[DataFrame], DataFrame]


def by_column(column: str) -> Grouping:
    """Equal values of a column are one group."""
    return lambda failures: failures.select("corpusRunId", "failureId", F.col(column).alias("grp"))


def loose_fingerprint(failures: DataFrame) -> DataFrame:
    """corpusRunId, failureId, grp: equal loose fingerprints are one group."""
    return hashing.with_fingerprint(failures).select("corpusRunId", "failureId", F.col("loose_hash").alias("grp"))


def same_text(failures: DataFrame) -> DataFrame:
    """corpusRunId, failureId, grp: equal error type and message are one group."""
    parts = F.array(F.coalesce("errorType", F.lit("")), F.coalesce("message", F.lit("")))
    return failures.select("corpusRunId", "failureId", hashing.sha_128(hashing.framed(parts)).alias("grp"))


def same_error_type(failures: DataFrame) -> DataFrame:
    return failures.select("corpusRunId", "failureId", F.coalesce("errorType", F.lit("")).alias("grp"))


# ---- baseline ------------------------------------------------------------------------------------


def scored(failures: DataFrame, labels: DataFrame, grouping: Grouping, by_framework: bool = False) -> DataFrame:
    """labeler, corpusRunId, failureId, predicted, truth (and framework) of labelled failures that are stored. A failure that
    the grouping leaves out stands alone."""
    ids = failures.select("corpusRunId", "failureId", *([detect_framework().alias("framework")] if by_framework else []))
    j = labels.select("labeler", "corpusRunId", "failureId", F.col("grp").alias("truth")).join(ids, ["corpusRunId", "failureId"])
    p = grouping(failures).withColumnRenamed("grp", "predicted")
    alone = F.concat(F.lit("unpredicted:"), "failureId")
    return j.join(p, ["corpusRunId", "failureId"], "left").withColumn("predicted", F.coalesce("predicted", alone))


def baseline_runs(rows: DataFrame, undefined: str = "nan") -> DataFrame:
    """Per labeler and run with at least two labelled failures: groups, pair counts, precision, recall, F1."""
    counts = stats.pair_counts(rows, ["labeler", "corpusRunId"], "predicted", "truth").where("n >= 2")
    groups = rows.groupBy("labeler", "corpusRunId").agg(F.count_distinct("truth").alias("labelled_groups"), F.count_distinct("predicted").alias("predicted_groups"))
    score = stats.prf(F.col("tp"), F.col("fp"), F.col("fn"), undefined)
    return counts.join(groups, ["labeler", "corpusRunId"]).withColumns(score).withColumnRenamed("n", "n_failures")


def baseline_total(per_run: DataFrame, by: list[str], seed: int = stats.SEED, resamples: int = stats.RESAMPLES, undefined: str = "nan") -> DataFrame:
    """Sums over runs, their scores, and the F1 interval from resampled runs, in order of run id."""
    sums = ["tp", "fp", "fn", "tn"]
    total = per_run.groupBy(*by).agg(F.count(F.lit(1)).alias("n_runs"), F.sum("n_failures").alias("n_failures"), *(F.sum(c).alias(c) for c in sums))
    f1 = stats.prf(F.col("tp"), F.col("fp"), F.col("fn"))["f1"]
    iv = stats.bootstrap(per_run, ["corpusRunId"], sums[:3], f1, by, resamples, seed).select(*by, F.col("lower").alias("f1_lower"), F.col("upper").alias("f1_upper"))
    return total.withColumns(stats.prf(F.col("tp"), F.col("fp"), F.col("fn"), undefined)).join(iv, by)


def strata(rows: DataFrame, stratum: str, undefined: str = "nan") -> DataFrame:
    """Per labeler and stratum: pairs whose both members are of it, from runs that are scored. Failures count even where a
    run has one of the stratum only."""
    n = rows.groupBy("labeler", "corpusRunId").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2")
    kept = rows.join(n.drop("_n"), ["labeler", "corpusRunId"], "left_semi")
    per = stats.pair_counts(kept, ["labeler", stratum, "corpusRunId"], "predicted", "truth")
    some = F.col("n") >= 2
    out = per.groupBy("labeler", stratum).agg(
        F.sum("n").alias("n_failures"), F.count_if(some).alias("n_runs"), *(F.sum(F.when(some, F.col(c)).otherwise(0)).alias(c) for c in ("tp", "fp", "fn", "tn"))
    )
    return out.where("n_runs > 0").withColumns(stats.prf(F.col("tp"), F.col("fp"), F.col("fn"), undefined))


def cross_pairs(rows: DataFrame, stratum: str) -> DataFrame:
    """Per labeler: pairs of one scored run whose members are of different strata, by counting."""
    cell = rows.groupBy("labeler", "corpusRunId", stratum).agg(F.count(F.lit(1)).alias("n"))
    run = cell.groupBy("labeler", "corpusRunId").agg(F.sum("n").alias("m"), F.sum(stats.choose2(F.col("n"))).alias("own")).where("m >= 2")
    return run.groupBy("labeler").agg(F.sum(stats.choose2(F.col("m")) - F.col("own")).alias("cross_pairs"))


def exclusions(runs: DataFrame, rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Per labeler: why stored runs are not scored, digits masked, with counts."""
    names = labels.select("labeler").distinct()
    docs = labels.select("labeler", "corpusRunId").distinct()
    n = rows.groupBy("labeler", "corpusRunId").agg(F.count(F.lit(1)).alias("n"))
    # every stored run counts once for every labeler: totals instead of a product of both
    seen = docs.join(runs.select("corpusRunId"), "corpusRunId", "left_semi").join(n, ["labeler", "corpusRunId"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    few = F.regexp_replace(F.format_string(TOO_FEW, "n"), r"\d+", "N")
    some = seen.where("n < 2").select("labeler", few.alias("reason")).groupBy("labeler", "reason").agg(F.count(F.lit(1)).alias("n_runs"))
    total = runs.select("corpusRunId").distinct().agg(F.count(F.lit(1)).alias("t"))
    had = names.join(seen.groupBy("labeler").agg(F.count(F.lit(1)).alias("h")), "labeler", "left")
    none = had.join(F.broadcast(total)).select("labeler", F.lit(NO_LABELS).alias("reason"), (F.col("t") - F.coalesce("h", F.lit(0))).alias("n_runs"))
    return some.unionByName(none.where("n_runs > 0"))


# ---- agreement -----------------------------------------------------------------------------------


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Labels of two labelers side by side, for the failures both labelled; group names stay each labeler's own."""
    keys = ["corpusRunId", "failureId"]
    return a.select(*keys, F.col("labeler").alias("labeler_a"), F.col("category").alias("cat_a"), F.col("grp").alias("grp_a")).join(
        b.select(*keys, F.col("labeler").alias("labeler_b"), F.col("category").alias("cat_b"), F.col("grp").alias("grp_b")), keys
    )


def labeler_pairs(labels: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """All pairs of human labelers (a < b) over stored failures they share. The join is on the failure, so a failure
    yields at most the pairs of its own labelers."""
    human = labels.where(~corpus.is_machine())
    if stored is not None:
        human = human.join(stored.select("corpusRunId", "failureId"), ["corpusRunId", "failureId"], "left_semi")
    return aligned(human, human).where("labeler_a < labeler_b")


PAIR = ["labeler_a", "labeler_b"]


def kappa(pairs: DataFrame, undefined: str = "nan") -> DataFrame:
    """Cohen's kappa per labeler pair: po, pe over the union of categories; pe = 1 gives 1, nothing compared gives NaN."""
    cells = pairs.groupBy(*PAIR, "cat_a", "cat_b").agg(F.count(F.lit(1)).alias("c"))
    side = cells.select(*PAIR, "c", F.explode(F.array(F.struct(F.lit("a").alias("s"), F.col("cat_a").alias("cat")), F.struct(F.lit("b").alias("s"), F.col("cat_b").alias("cat")))).alias("x"))
    margin = side.groupBy(*PAIR, "x.cat").agg(F.sum(F.when(F.col("x.s") == "a", F.col("c")).otherwise(0)).alias("a"), F.sum(F.when(F.col("x.s") == "b", F.col("c")).otherwise(0)).alias("b"))
    chance = margin.groupBy(*PAIR).agg(F.sum(F.col("a") * F.col("b")).alias("ab"))
    seen = cells.groupBy(*PAIR).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("cat_a") == F.col("cat_b"), F.col("c")).otherwise(0)).alias("agreed"))
    po, pe = F.col("agreed") / F.col("n"), F.col("ab") / (F.col("n") * F.col("n"))
    k = F.when(F.col("ab") == F.col("n") * F.col("n"), 1.0).otherwise(stats.ratio(F.col("agreed") * F.col("n") - F.col("ab"), F.col("n") * F.col("n") - F.col("ab"), undefined))
    return seen.join(chance, PAIR).select(*PAIR, "n", "agreed", po.alias("po"), pe.alias("pe"), k.alias("kappa"))


def kappa_categories(pairs: DataFrame) -> DataFrame:
    """Per labeler pair and category: how often each used it, and both at once."""
    side = F.explode(F.array(F.struct(F.lit(1).alias("a"), F.lit(0).alias("b"), F.col("cat_a").alias("c")), F.struct(F.lit(0).alias("a"), F.lit(1).alias("b"), F.col("cat_b").alias("c"))))
    rows = pairs.select(*PAIR, side.alias("x"), (F.col("cat_a") == F.col("cat_b")).cast("int").alias("e"))
    return rows.groupBy(*PAIR, F.col("x.c").alias("category")).agg(F.sum("x.a").alias("n_a"), F.sum("x.b").alias("n_b"), F.sum(F.col("x.a") * F.col("e")).alias("n_agreed"))


def grouping_agreement(pairs: DataFrame, resamples: int = stats.RESAMPLES, seed: int = stats.SEED) -> DataFrame:
    """Per labeler pair: pairs of failures grouped alike, per run, with the interval from resampled runs."""
    per = stats.pair_counts(pairs, [*PAIR, "corpusRunId"], "grp_a", "grp_b").where("n >= 2")
    per = per.select(*PAIR, "corpusRunId", (F.col("tp") + F.col("tn")).alias("alike"), stats.choose2(F.col("n")).alias("total"))
    total = per.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n_runs"), F.sum("alike").alias("alike"), F.sum("total").alias("n_pairs"))
    iv = stats.bootstrap(per, ["corpusRunId"], ["alike", "total"], stats.ratio(F.col("alike"), F.col("total")), PAIR, resamples, seed)
    return total.join(iv.select(*PAIR, "point", "lower", "upper"), PAIR)


def category_agreement(pairs: DataFrame, resamples: int = stats.RESAMPLES, seed: int = stats.SEED) -> DataFrame:
    per = pairs.groupBy(*PAIR, "corpusRunId").agg(F.count_if(F.col("cat_a") == F.col("cat_b")).alias("agreed"), F.count(F.lit(1)).alias("total"))
    return stats.bootstrap(per, ["corpusRunId"], ["agreed", "total"], stats.ratio(F.col("agreed"), F.col("total")), PAIR, resamples, seed)


def ambiguous(lower: Column) -> Column:
    return ~F.isnan(lower) & (lower < 0.8)


def separability_pairs(labels: DataFrame) -> DataFrame:
    """Human labels of full context beside payload-only ones of other labelers, for the same failure. A labeler who works in
    both contexts is on neither side."""
    human = labels.where(~corpus.is_machine())
    one = human.groupBy("labeler").agg(F.count_distinct("context").alias("k"), F.first("context").alias("c")).where("k = 1")
    side = lambda c: human.join(one.where(F.col("c") == c).select("labeler"), "labeler", "left_semi")
    return aligned(side("full"), side("payload-only"))


def check_contexts(full: DataFrame, payload: DataFrame) -> None:
    """Refuses machine labelers and labels of the wrong context."""
    for df, context in ((full, "full"), (payload, "payload-only")):
        bad = df.where(corpus.is_machine() | (F.col("context") != context)).select("labeler", "context").limit(1).collect()
        if bad:
            raise corpus.ValidationError(f"{bad[0].labeler} labelled in context {bad[0].context}; {context} labels of people are compared")


# ---- reports -------------------------------------------------------------------------------------


def frame_flags(failures: DataFrame, *keep: str, **options) -> DataFrame:
    """corpusRunId, the columns to keep, framework, and whether the stack has any frame and one of the application (0 or 1): what a
    report needs of a stack, found where the stack is read. Options are test_globs and vendor_dirs."""
    f = failures.select("corpusRunId", *keep, framework_or_adapter(detect_framework()).alias("framework"), frame_summary("stackText", **options).alias("s"))
    return f.select("corpusRunId", *keep, "framework", (F.col("s.n_frames") > 0).cast("long").alias("any"), (F.col("s.n_app") > 0).cast("long").alias("app"))


def frame_report(flags: DataFrame, repo_of: DataFrame) -> DataFrame:
    """Per framework: failures, with any frame, with an application frame, its Wilson interval, repositories, top share."""
    f = flags.join(repo_of, "corpusRunId")
    per = f.groupBy("framework", "repo").agg(F.count(F.lit(1)).alias("n"), F.sum("any").alias("any"), F.sum("app").alias("app"))
    rows = per.groupBy("framework").agg(F.sum("n").alias("failures"), F.sum("any").alias("with_any_frame"), F.sum("app").alias("with_app_frame"), F.count(F.lit(1)).alias("repositories"), (F.max("n") / F.sum("n")).alias("top_repo_share"))
    total = per.agg(F.lit("total").alias("framework"), F.sum("n").alias("failures"), F.sum("any").alias("with_any_frame"), F.sum("app").alias("with_app_frame"), F.count_distinct("repo").alias("repositories"), F.lit(0.0).alias("top_repo_share"))
    w = stats.wilson(F.col("with_app_frame"), F.col("failures"))
    return rows.unionByName(total).withColumns({"rate": w["point"], "lower": w["lower"], "upper": w["upper"]})


def digest(ids: DataFrame, by: list[str], id: str) -> DataFrame:
    """First 12 hex digits of SHA-256 over a group's sorted ids, each followed by a line feed."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(id)), lambda x: F.concat(x, F.lit("\n"))), "")
    return ids.groupBy(*by).agg(F.substring(F.sha2(text, 256), 1, 12).alias("digest"), F.count(F.lit(1)).alias("n_ids"))


def concentration(per_run: DataFrame) -> DataFrame:
    """One row from (corpusRunId, repo, n): top shares, runs over 200, upper median, runs in 5..24 and with pairs."""
    all_ = per_run.agg(F.sum("n").alias("t"), F.max("n").alias("m"), F.count_if(F.col("n") > 200).alias("runs_over_200"), F.count_if(F.col("n").between(5, 24)).alias("runs_in_band"), F.count_if(F.col("n") >= 2).alias("runs_with_pairs"))
    repo = per_run.groupBy("repo").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "repo").limit(3).agg(F.max("n").alias("r1"), F.sum("n").alias("r3"))
    median = stats.upper_median(per_run, [], "n")
    share = lambda c: F.when(F.col("t") > 0, F.col(c) / F.col("t")).otherwise(0.0)
    return all_.join(repo).join(median).select(
        share("m").alias("top_run_share"), share("r1").alias("top_repo_share"), share("r3").alias("top3_repo_share"), "runs_over_200",
        F.col("upper_median").alias("median_failures_per_run"), "runs_in_band", "runs_with_pairs",
    )


def dominant(counts: DataFrame, by: str, value: str, n: str) -> DataFrame:
    """The most frequent value of each group, ties to the smallest."""
    return counts.groupBy(by).agg(F.min(F.struct((-F.col(n)).alias("k"), F.col(value).alias("v"))).alias("x")).select(by, F.col("x.v").alias(value), (-F.col("x.k")).alias(n))


def mix_gaps(corpus_counts: DataFrame, sample_counts: DataFrame, key: str) -> DataFrame:
    """Shares of both, and whether a family of at least 2% of the corpus has less than a third of its share in the sample."""
    a = corpus_counts.join(F.broadcast(corpus_counts.agg(F.sum("n").alias("t")))).select(key, (F.col("n") / F.col("t")).alias("corpus_share"))
    b = sample_counts.join(F.broadcast(sample_counts.agg(F.sum("n").alias("t")))).select(key, F.try_divide("n", "t").alias("sample_share"))
    j = a.join(b, key, "left").withColumn("sample_share", F.coalesce("sample_share", F.lit(0.0)))
    return j.withColumn("is_gap", (F.col("corpus_share") >= 0.02) & (F.col("sample_share") < F.col("corpus_share") / 3))
