"""Views of the stored tables, validation that rejects and never repairs, and the policy predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import written

#: Vocabulary of the stored documents; fixed values.
CATEGORIES = ("PRODUCT_REGRESSION", "TEST_DEFECT", "FLAKY", "ENVIRONMENT_FAILURE", "DEPENDENCY_FAILURE", "DATA_FAILURE", "PERFORMANCE_REGRESSION", "UNKNOWN")
FIDELITIES = ("artifact", "log-scrape", "synthetic")
CONTEXTS = ("full", "payload-only")
SCHEMA_VERSION = 1
MACHINE = "machine:"
COPYLEFT = r"(?i)^(?:A?GPL|LGPL|GPL|EUPL|OSL|CECILL|SSPL|CPAL)(?:-|\z)"
MAX_RUN_BYTES = 50 * 1024 * 1024
ARTIFACT_HINT = r"(?i)test|junit|report|result|playwright|blob|surefire"
BANDS = ("1", "2-4", "5-24", "25-99", "100+")


class ValidationError(ValueError):
    pass


def run_id(provider: Column, repo: Column, provider_run: Column, attempt: Column) -> Column:
    return F.concat_ws(":", provider, repo, provider_run, attempt.cast("string"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """One document per run: the latest harvest, ties to the greater counts. Only one row per run is kept map-side."""
    rest = [c for c in runs.columns if c != "corpusRunId"]
    order = F.struct("ingestedAt", "counts.attempts", "counts.failures")
    return runs.groupBy("corpusRunId").agg(F.max_by(F.struct(*rest), order).alias("r")).select("corpusRunId", "r.*")


def first_deliveries(failures: DataFrame, *columns: str) -> DataFrame:
    """One row per failure of a run, the one delivered first, with the columns asked for."""
    keep = list(columns) or [c for c in failures.columns if c not in ("corpusRunId", "failureId")]
    return failures.groupBy("corpusRunId", "failureId").agg(F.min_by(F.struct(*keep), "rowId").alias("f")).select("corpusRunId", "failureId", "f.*")


def labeler_name(c: Column | str = "labeler") -> Column:
    return F.lower(F.trim(c))


def is_machine(c: Column | str = "labeler") -> Column:
    return (F.col(c) if isinstance(c, str) else c).startswith(MACHINE)


def latest_labels(run_labels: DataFrame, keys: tuple[str, ...] = ("labeler", "corpusRunId")) -> DataFrame:
    """The latest document of each labeler for each run: labeler (folded), corpusRunId, context, labeledAt, labels."""
    docs = run_labels.select(labeler_name().alias("labeler"), "corpusRunId", "context", "labeledAt", "labels")
    rest = [c for c in docs.columns if c not in keys]
    # maps cannot be ordered; a document's entries can
    entries = F.array_sort(F.map_entries("labels"))
    return docs.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("labeledAt", "context", entries)).alias("d")).select(*keys, "d.*")


def category(c: Column) -> Column:
    """A category's spelling folded to the vocabulary's."""
    return F.regexp_replace(F.upper(F.trim(c)), r"[ -]+", "_")


def label_rows(docs: DataFrame) -> DataFrame:
    """One row per labelled failure: labeler, corpusRunId, context, failureId, grp, category, note."""
    rows = docs.select("labeler", "corpusRunId", "context", F.explode("labels").alias("failureId", "l"))
    return rows.select("labeler", "corpusRunId", "context", "failureId", F.col("l.group").alias("grp"), category(F.col("l.category")).alias("category"), F.col("l.note").alias("note"))


# ---- policies ------------------------------------------------------------------------------------


def hold_out_reason(spdx: Column, size: Column | None = None, limit: int = MAX_RUN_BYTES) -> Column:
    """oversized, unidentified, copyleft, or null for a run that may be committed. Size counts only where it is given."""
    out = F.when(size > limit, "oversized") if size is not None else F.when(F.lit(False), "")
    return out.when(spdx.isNull() | (spdx == "NOASSERTION"), "unidentified").when(spdx.rlike(COPYLEFT), "copyleft")


def normal_license(spdx: Column) -> Column:
    return F.nullif(spdx, F.lit("NOASSERTION"))


def size_band(n: Column) -> Column:
    """1, 2-4, 5-24, 25-99, 100+; a run of none falls into 2-4."""
    return F.when(n == 1, "1").when(n < 5, "2-4").when(n < 25, "5-24").when(n < 100, "25-99").otherwise("100+")


def probe_reason(parsed: Column, failures: Column, artifacts: Column) -> Column:
    return F.when(artifacts == 0, "no artifacts").when(parsed == 0, "nothing parsed").when(failures == 0, "no failures").otherwise("productive")


def requirement_state(measured: Column, observed: Column, met: Column) -> Column:
    return F.when(met, "met").when(~measured | (observed == 0), "blocked").otherwise("unmet")


def usable_artifact(name: Column, size: Column, expired: Column, cap: int) -> Column:
    return name.rlike(ARTIFACT_HINT) & (size <= cap) & ~expired


def tracked(runs: DataFrame, paths: list[str]) -> DataFrame:
    """The runs whose document is among the paths under version control (as `git ls-files` lists them)."""
    dirs = sorted({p.split("/")[-2] for p in paths if p.endswith("/run.json") and p.count("/")})
    return runs.where(F.regexp_replace("corpusRunId", r"[^A-Za-z0-9._-]+", "_").isin(dirs)) if dirs else runs.limit(0)


def ordered(runs: DataFrame) -> DataFrame:
    """Adds ordinal: a run's place among all by the name of its folder, without bringing all runs into one task."""
    name = F.regexp_replace("corpusRunId", r"[^A-Za-z0-9._-]+", "_")
    # written once: both readers must see the same parts
    parts = written(runs.withColumn("_d", name).orderBy("_d", "corpusRunId").withColumn("_p", F.spark_partition_id()))
    own = Window.partitionBy("_p").orderBy("_d", "corpusRunId")
    earlier = Window.partitionBy(F.lit(1)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    before = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_b"))
    return parts.join(F.broadcast(before), "_p").withColumn("ordinal", F.row_number().over(own) - 1 + F.col("_b")).drop("_d", "_p", "_b")


def filtered(runs: DataFrame, text: str = "", held: bool | None = None, framework: str | None = None) -> DataFrame:
    """Runs whose id, repository or branch contains a text, that are held out or not, and of a framework (column frameworks)."""
    out = runs
    if text:
        hay = F.lower(F.concat_ws(" ", "corpusRunId", "source.repo", "source.headBranch"))
        out = out.where(hay.contains(text.lower()))
    if held is not None:
        out = out.where(hold_out_reason(F.col("source.licenseSpdx")).isNotNull() == F.lit(held))
    return out.where(F.array_contains("frameworks", framework)) if framework else out


def sorted_by(df: DataFrame, column: str, before: tuple[str, bool] | None = None) -> tuple[DataFrame, tuple[str, bool]]:
    """df by a column, falling first; asking for the same column again turns the direction. Ties by run."""
    falling = not before[1] if before and before[0] == column else True
    return df.orderBy(F.desc_nulls_last(column) if falling else F.asc_nulls_last(column), "corpusRunId"), (column, falling)


def category_of(answer: str) -> str | None:
    """A category by its number in the vocabulary (from 1) or by its name; null for anything else."""
    folded = answer.strip().upper().replace(" ", "_").replace("-", "_")
    if folded.isdigit():
        return CATEGORIES[int(folded) - 1] if 1 <= int(folded) <= len(CATEGORIES) else None
    return folded if folded in CATEGORIES else None


def committable(runs: DataFrame) -> DataFrame:
    return runs.where(hold_out_reason(F.col("source.licenseSpdx")).isNull())


# ---- validation ----------------------------------------------------------------------------------


def _report(problems: DataFrame, what: str, limit: int = 20) -> None:
    found = problems.limit(limit + 1).collect()
    if found:
        lines = [f"{r.id}: {r.problem}" for r in found[:limit]] + (["and more"] if len(found) > limit else [])
        raise ValidationError(f"{what}\n" + "\n".join(lines))


def readable_version(v: Column) -> Column:
    return v.isNotNull() & (v <= SCHEMA_VERSION) & (v >= SCHEMA_VERSION - 1)


def _problems(id: Column, *rules: tuple[Column, str]) -> Column:
    return F.explode(F.filter(F.array(*(F.when(bad, F.struct(id.cast("string").alias("id"), F.lit(text).alias("problem"))) for bad, text in rules)), lambda x: x.isNotNull()))


def run_problems(runs: DataFrame, failures: DataFrame | None = None, version: int = SCHEMA_VERSION, by_run: bool = False) -> DataFrame:
    """id and problem of every breach: version window, empty identity, unknown fidelity, failure ids empty or repeated.
    The id of a failure's breach is run#failure, or the run alone with `by_run`."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    v = F.col("schemaVersion")
    rules = (
        (v.isNull() | (v > version) | (v < version - 1), "schema version cannot be read"), (blank("corpusRunId"), "corpusRunId is empty"),
        (blank("source.repo"), "source.repo is empty"), (blank("source.providerRunId"), "source.providerRunId is empty"),
        (F.coalesce(~F.col("fidelity").isin(*FIDELITIES), F.lit(True)), "fidelity is unknown"),
    )
    out = runs.select(_problems(F.coalesce("corpusRunId", F.lit("?")), *rules).alias("p")).select("p.*")
    if failures is None:
        return out
    n = failures.groupBy("corpusRunId", "failureId").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("message").isNull()).alias("m"))
    id = F.coalesce("corpusRunId", F.lit("?")) if by_run else F.concat_ws("#", "corpusRunId", "failureId")
    own = n.select(_problems(id, (blank("failureId"), "failureId is empty"), (F.col("n") > 1, "failureId is repeated"), (F.col("m") > 0, "message is missing")).alias("p")).select("p.*")
    return out.unionByName(own)


def label_problems(run_labels: DataFrame, failures: DataFrame | None = None, version: int = SCHEMA_VERSION, keys: tuple[str, ...] = ("labeler", "corpusRunId", "failureId")) -> DataFrame:
    """Breaches of label documents, by an id of `keys`; failure ids are checked where the run is stored."""
    id = F.concat_ws("/", *(k for k in keys if k != "failureId"))
    v = F.col("schemaVersion")
    doc = run_labels.select(_problems(id, (v.isNull() | (v > version) | (v < version - 1), "schema version cannot be read"), (F.coalesce(~F.col("context").isin(*CONTEXTS), F.lit(True)), "context is unknown"), (F.coalesce(F.size("labels"), F.lit(0)) <= 0, "no labels")).alias("p")).select("p.*")
    rows = run_labels.select("labeler", "corpusRunId", F.explode("labels").alias("failureId", "l"))
    rid = F.concat_ws("/", *keys)
    out = doc.unionByName(rows.select(_problems(rid, (F.coalesce(F.trim("l.group") == "", F.lit(True)), "group is empty"), (F.coalesce(~F.col("l.category").isin(*CATEGORIES), F.lit(True)), "category is unknown")).alias("p")).select("p.*"))
    if failures is None:
        return out
    known = failures.select("corpusRunId", "failureId").distinct()
    stored = known.select("corpusRunId").distinct()
    lost = rows.join(stored, "corpusRunId", "left_semi").join(known, ["corpusRunId", "failureId"], "left_anti")
    return out.unionByName(lost.select(rid.alias("id"), F.lit("failure is not in the run").alias("problem")))


def validate_runs(runs: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    _report(run_problems(runs, failures), "runs cannot be read")
    return runs


def validate_labels(run_labels: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    _report(label_problems(run_labels, failures), "labels cannot be read")
    return run_labels
