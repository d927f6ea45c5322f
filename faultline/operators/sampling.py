"""Sampling for labelling, worksheets and their import.

Choosing runs is a sequential greedy procedure over a matrix of (run, framework) counts. The matrix is made by
one aggregation; it is the only thing that comes to the driver, and it has one row per eligible run.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions import stats
from faultline.operators import corpus
from faultline.operators.scoring import digest


@dataclass(frozen=True)
class Policy:
    """Limits of a selection; the defaults are fixed values."""

    target_failures: int = 100
    min_failures: int = 5
    max_failures: int = 40
    max_runs_per_repo: int = 3
    slice_large_runs: int = 0
    min_per_framework: int = 15
    max_slices_per_repo: int = 1
    seed: int = 0x5A3D1E


@dataclass
class Sample:
    selected: DataFrame
    runs: list[dict]
    excluded: dict[str, int] = field(default_factory=dict)
    policy: Policy = Policy()

    def digest(self) -> str:
        rows = digest(self.selected.select(F.lit(0).alias("k"), "corpusRunId"), ["k"], "corpusRunId").collect()
        return rows[0].digest if rows else ""


class _Chooser:
    """State of one selection: how much of each framework is had, and what each repository has used up."""

    def __init__(self, policy: Policy, mix: dict[str, int]):
        self.p, self.mix, self.all = policy, mix, max(1, sum(mix.values()))
        self.have: Counter = Counter()
        self.per_repo: Counter = Counter()
        self.slices: Counter = Counter()

    def families(self) -> list[str]:
        return [k for k in sorted(self.mix) if self.mix[k] / self.all >= 0.02]

    def wanted(self) -> str | None:
        """The family furthest below its floor; once all are at theirs, the one furthest below its share."""

        def need(k: str) -> float:
            floor = self.p.min_per_framework - self.have[k]
            return 1000 + floor if floor > 0 else self.mix[k] / self.all * self.p.target_failures - self.have[k]

        return max(self.families(), key=need, default=None)

    def oversized(self, run: dict) -> bool:
        return run["n"] > self.p.max_failures and self.p.slice_large_runs > 0

    def admits(self, run: dict) -> bool:
        if self.per_repo[run["repo"]] >= self.p.max_runs_per_repo:
            return False
        return not (self.oversized(run) and self.slices[run["repo"]] >= self.p.max_slices_per_repo)

    def best(self, left: list[dict], wanted: str | None) -> dict | None:
        open_ = [r for r in left if self.admits(r)]
        if not open_:
            return None
        gain = lambda r: 1 if wanted is None else r["by"].get(wanted, 0)
        top = max(open_, key=gain)  # the first of equals
        return top if gain(top) else max(open_, key=lambda r: r["n"])

    def part(self, run: dict, ids: dict[str, list[str]], wanted: str | None) -> list[str]:
        """A slice: one id in turn from every family under its floor, the wanted one first, then from the rest."""
        short = {k for k in self.families() if self.have[k] < self.p.min_per_framework}
        queues: dict[str, list[str]] = {}
        for k, own in ids.items():
            queues.setdefault(k if k in short else "", []).extend(own)
        order = sorted((k for k in queues if k), key=lambda k: (k != wanted, k)) + ([""] if "" in queues else [])
        lines = [sorted(queues[k]) for k in order]
        out: list[str] = []
        turn = 0
        while lines and len(out) < self.p.slice_large_runs:
            turn %= len(lines)
            if not lines[turn]:
                lines.pop(turn)
                continue
            out.append(lines[turn].pop(0))
            turn += 1
        return sorted(out)


def sample(runs: DataFrame, failures: DataFrame, policy: Policy = Policy()) -> Sample:
    """runs: corpusRunId, repo. failures: corpusRunId, failureId, framework. The selection has one row per run:
    corpusRunId, repo, framework (its dominant one), n_failures, failureIds (null: the whole run)."""
    spark = runs.sparkSession
    cells = failures.groupBy("corpusRunId", "framework").agg(F.count(F.lit(1)).alias("n"))
    mix = {r.framework: r.n for r in cells.groupBy("framework").agg(F.sum("n").alias("n")).collect()}
    sizes = runs.join(cells.groupBy("corpusRunId").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("framework", "n"))).alias("by")), "corpusRunId")
    large = F.lit(policy.slice_large_runs > 0) | (F.col("n") <= policy.max_failures)
    count = sizes.agg(F.count_if(F.col("n") < policy.min_failures).alias("small"), F.count_if((F.col("n") >= policy.min_failures) & ~large).alias("large")).first()
    eligible = [
        {"id": r.corpusRunId, "repo": r.repo, "n": r.n, "by": r["by"], "framework": min(r["by"], key=lambda k: (-r["by"][k], k))}
        for r in sizes.where((F.col("n") >= policy.min_failures) & large).orderBy("corpusRunId").collect()
    ]
    left = stats.shuffled(eligible, policy.seed)
    choose, chosen, total = _Chooser(policy, mix), [], 0
    while total < policy.target_failures and left:
        wanted = choose.wanted()
        run = choose.best(left, wanted)
        if run is None:
            break
        left.remove(run)
        choose.per_repo[run["repo"]] += 1
        ids = None
        took = Counter(run["by"])
        if choose.oversized(run):
            choose.slices[run["repo"]] += 1
            own = failures.where(F.col("corpusRunId") == run["id"]).groupBy("framework").agg(F.collect_list("failureId").alias("ids")).collect()
            frame_of = {i: r.framework for r in own for i in r.ids}
            ids = choose.part(run, {r.framework: r.ids for r in own}, wanted)
            took = Counter(frame_of[i] for i in ids)
        choose.have.update(took)
        n = sum(took.values())
        total += n
        chosen.append({"corpusRunId": run["id"], "repo": run["repo"], "framework": run["framework"], "n_failures": n, "failureIds": ids})
    capped = sum(choose.per_repo[r["repo"]] >= policy.max_runs_per_repo for r in left)
    schema = "corpusRunId string, repo string, framework string, n_failures long, failureIds array<string>"
    return Sample(spark.createDataFrame([tuple(c.values()) for c in chosen], schema), chosen, {"too_small": count.small, "too_large": count.large, "repo_capped": capped}, policy)


def total_pairs(selected: DataFrame) -> DataFrame:
    return selected.agg(F.coalesce(F.sum(stats.choose2(F.col("n_failures"))), F.lit(0)).alias("total_pairs"))


def policy_row(policy: Policy) -> dict:
    return asdict(policy)


def selected(entries: DataFrame, failures: DataFrame) -> DataFrame:
    """The failures that entries (corpusRunId, failureIds or null for the whole run) name, one row per entry and failure."""
    whole = F.col("failureIds").isNull()
    listed = entries.where(~whole).withColumn("failureId", F.explode(F.array_distinct("failureIds")))
    one = listed.join(failures, ["corpusRunId", "failureId"]).drop("failureIds")
    all_ = entries.where(whole).drop("failureIds").join(failures, "corpusRunId")
    return one.unionByName(all_)


def check_selection(entries: DataFrame, runs: DataFrame) -> None:
    lost = entries.join(runs, "corpusRunId", "left_anti").select("corpusRunId").limit(1).collect()
    if lost:
        raise corpus.ValidationError(f"the selection names run {lost[0].corpusRunId}, which is not stored")


# ---- worksheets ----------------------------------------------------------------------------------

#: Columns that tell where a failure comes from; a payload-only sheet has none of them.
PROVENANCE = ("corpusRunId", "failureId", "repo", "workflow", "commit", "stdout")


def worksheet(chosen: DataFrame, runs: DataFrame, context: str = "full", selection_digest: str = "") -> tuple[DataFrame, DataFrame]:
    """(sheet, key). Entries are numbered e0001 on; a payload-only sheet is shuffled by a seed made from the selection, and the
    key alone says which failure an entry is. A worksheet is what people read: it is small by nature."""
    if context not in corpus.CONTEXTS:
        raise ValueError(f"context is one of {corpus.CONTEXTS}")
    spark = chosen.sparkSession
    keys = [(r.corpusRunId, r.failureId) for r in chosen.select("corpusRunId", "failureId").orderBy("corpusRunId", "failureId").collect()]
    if context == "payload-only":
        keys = stats.shuffled(keys, stats.seed_of(f"payload-only:{selection_digest}"))
    key = spark.createDataFrame([(f"e{i + 1:04d}", *k) for i, k in enumerate(keys)], "entryId string, corpusRunId string, failureId string")
    src = runs.select("corpusRunId", F.col("source.repo").alias("repo"), F.col("source.workflowName").alias("workflow"), F.col("source.headSha").alias("commit"))
    rows = chosen.join(key, ["corpusRunId", "failureId"]).join(src, "corpusRunId", "left")
    sheet = rows.select(
        "entryId", *PROVENANCE, F.col("displayName").alias("test"), F.array_join("suitePath", " > ").alias("suite"), F.col("filePath").alias("file"), "status",
        F.col("attemptIndex").alias("attempt"), "durationMs", "errorType", "message", F.col("stackText").alias("stack"),
        *(F.lit(None).cast("string").alias(c) for c in ("group", "category", "note")),
    )
    return (sheet.drop(*PROVENANCE) if context == "payload-only" else sheet), key


def sheet_problems(sheet: DataFrame, key: DataFrame | None = None) -> DataFrame:
    """id and problem of every row of a filled sheet that cannot be taken over."""
    rows = _resolve(sheet, key)
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    category = corpus.category(F.col("category"))
    rules = (
        (F.col("corpusRunId").isNull() | F.col("failureId").isNull(), "the entry is not in the key"),
        (filled("group") != filled("category"), "group and category go together"),
        (filled("category") & ~category.isin(*corpus.CATEGORIES), "category is unknown"),
    )
    return rows.select(corpus._problems(F.col("entryId"), *rules).alias("p")).select("p.*")


def _resolve(sheet: DataFrame, key: DataFrame | None) -> DataFrame:
    if key is None:
        return sheet
    return sheet.drop("corpusRunId", "failureId").join(key, "entryId", "left")


def import_sheet(sheet: DataFrame, labeler: str, at: str, context: str, key: DataFrame | None = None) -> DataFrame:
    """Label documents from a filled sheet; rows left empty are skipped, any problem rejects the whole sheet."""
    corpus._report(sheet_problems(sheet, key), "the worksheet cannot be imported")
    rows = _resolve(sheet, key).where(F.coalesce(F.trim("group") != "", F.lit(False)))
    entry = F.struct(F.col("failureId").alias("key"), F.struct(F.trim("group").alias("group"), corpus.category(F.col("category")).alias("category"), "note").alias("value"))
    docs = rows.groupBy("corpusRunId").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("labels"))
    return docs.select(F.lit(corpus.SCHEMA_VERSION).alias("schemaVersion"), "corpusRunId", F.lit(labeler).alias("labeler"), F.lit(at).alias("labeledAt"), F.lit(context).alias("context"), "labels")


def import_ledger(docs: DataFrame, key: DataFrame, labeler: str, at: str, context: str) -> tuple[DataFrame, DataFrame]:
    """(label documents, unresolved ids) from ledger documents (id, group, category, note): unknown ids are handed back."""
    rows = docs.withColumnRenamed("id", "entryId")
    lost = rows.join(key, "entryId", "left_anti").select("entryId")
    known = rows.join(key.select("entryId"), "entryId", "left_semi")
    return import_sheet(known, labeler, at, context, key), lost


def leaks(sheet: DataFrame, terms: list[str]) -> DataFrame:
    """How many entries of a payload-only sheet contain a term (longer than three letters) that names their source."""
    long_ = [t.lower() for t in terms if len(t) > 3]
    body = F.lower(F.concat_ws("\n", *[c for c in sheet.columns if c != "entryId"]))
    hit = F.lit(False)
    for t in long_:
        hit = hit | F.contains(body, F.lit(t))
    return sheet.agg(F.count(F.lit(1)).alias("n_entries"), F.count_if(hit).alias("n_leaking"))


def budget(sizes: list[tuple[str, int]], limit: int) -> list[str]:
    """Smallest first; an item that no longer fits is skipped and uses up nothing."""
    out, used = [], 0
    for name, size in sorted(sizes, key=lambda x: (x[1], x[0])):
        if math.isfinite(size) and used + size <= limit:
            out.append(name)
            used += size
    return out
