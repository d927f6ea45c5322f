"""Command line over a corpus folder (runs/, labels/): python -m faultline.cli COMMAND [options].

Exit codes: 0 done, 2 nothing to measure or bad input, 3 usage.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import hashing
from faultline.functions import text as T
from faultline.functions.frames import detect_framework
from faultline.operators import corpus, gates, sampling, scoring
from faultline.session import build_session, written
from faultline.sources import reports, sinks
from faultline.sources.model import ParseError


class Nothing(Exception):
    pass


class Corpus:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.runs, self.failures = reports.read_runs(spark, f"{folder}/runs")
        corpus.validate_runs(self.runs, self.failures)

    def docs(self, labeler: str | None = None) -> DataFrame:
        path = f"{self.folder}/labels"
        if not reports.exists(self.spark, path):
            return self.spark.createDataFrame([], reports.LABELS)
        docs = reports.read_labels(self.spark, path, labeler)
        return corpus.validate_labels(docs, self.failures)

    def labels(self, labeler: str | None = None) -> DataFrame:
        return corpus.label_rows(self.docs(labeler))

    def named(self) -> DataFrame:
        return self.failures.withColumn("framework", detect_framework())

    def sizes(self) -> DataFrame:
        n = self.failures.groupBy("corpusRunId").agg(F.count(F.lit(1)).alias("n"))
        runs = corpus.committable(self.runs).select("corpusRunId", F.col("source.repo").alias("repo"))
        return runs.join(n, "corpusRunId", "left").select("corpusRunId", "repo", F.coalesce("n", F.lit(0)).alias("n"))


def _show(df: DataFrame) -> None:
    print(sinks.text_table(df))


def gate(c: Corpus) -> tuple[DataFrame, dict]:
    """The gate's table, and what is said beside it."""
    labels, flags = c.labels(), scoring.frame_flags(c.failures)
    counts = gates.counted(gates.sizes(c.runs, c.failures), flags, labels)
    table = written(gates.table(counts, gates.measured(scoring.labeler_pairs(labels, c.failures), scoring.separability_pairs(labels))))
    seen = {r.id: r.observed for r in table.collect()}
    return table, {
        "passed": table.where("not met").isEmpty(), "heldOut": sinks.rows(gates.held_out(c.runs, c.failures))[0], "frameworks": [r.framework for r in gates.frameworks_seen(flags).collect()],
        "unidentified": flags.where("framework = 'unidentified'").count(), "fidelity": {r.fidelity: r["count"] for r in c.runs.groupBy("fidelity").count().collect()},
        "machineLabelers": sorted(r.labeler for r in labels.where(corpus.is_machine()).select("labeler").distinct().collect()), "blockedOnPeople": gates.blocked_on_people(int(seen["labelers"]), int(seen["failures"])),
    }


def status(c: Corpus, a: argparse.Namespace) -> None:
    table, beside = gate(c)
    concentration = scoring.concentration(c.sizes())
    if a.json:
        print(json.dumps(sinks.plain({**beside, "requirements": sinks.rows(table), "concentration": sinks.rows(concentration)[0]}), indent=1, default=str))
        return
    print("gate: met" if beside["passed"] else "gate: not met")
    _show(table)
    _show(concentration)
    _show(c.sizes().groupBy(corpus.size_band(F.col("n")).alias("band")).count().orderBy("band"))
    for k in ("heldOut", "frameworks", "unidentified", "fidelity", "machineLabelers"):
        print(f"{k}: {beside[k]}")
    for text in beside["blockedOnPeople"]:
        print(f"blocked on people: {text}")


def frames(c: Corpus, a: argparse.Namespace) -> None:
    repo = c.runs.select("corpusRunId", F.col("source.repo").alias("repo"))
    _show(scoring.frame_report(scoring.frame_flags(c.failures), repo).orderBy(F.desc("failures"), "framework"))


def baseline(c: Corpus, a: argparse.Namespace) -> None:
    rows = scoring.scored(c.failures, c.labels(a.labeler), scoring.loose_fingerprint, by_framework=True).join(c.runs.select("corpusRunId", F.col("source.repo").alias("repo")), "corpusRunId", "left")
    per = scoring.baseline_runs(rows)
    if per.isEmpty():
        raise Nothing("no run has two labelled failures")
    _show(scoring.baseline_total(per, ["labeler"]))
    _show(per.orderBy(F.nanvl("f1", F.lit(0.0)), "corpusRunId"))
    _show(scoring.strata(rows, "framework").orderBy(F.desc(F.col("tp") + F.col("fp")), "framework"))
    _show(scoring.strata(rows, "repo").orderBy(F.desc(F.col("tp") + F.col("fp")), "repo"))
    _show(scoring.exclusions(c.runs, rows, c.labels(a.labeler)))


def agreement(c: Corpus, a: argparse.Namespace) -> None:
    if any(x.startswith(corpus.MACHINE) for x in (a.a, a.b)):
        raise Nothing("agreement is measured between people")
    pairs = scoring.aligned(c.labels(a.a), c.labels(a.b)).join(c.failures.select("corpusRunId", "failureId"), ["corpusRunId", "failureId"], "left_semi")
    if pairs.isEmpty():
        raise Nothing("the two have no failure in common")
    for df in (scoring.kappa(pairs), scoring.category_agreement(pairs), scoring.grouping_agreement(pairs)):
        _show(df)


def separability(c: Corpus, a: argparse.Namespace) -> None:
    full, payload = c.labels(a.full), c.labels(a.payload)
    scoring.check_contexts(full, payload)
    pairs = scoring.aligned(full, payload)
    if pairs.isEmpty():
        raise Nothing("the two have no failure in common")
    rate = scoring.category_agreement(pairs)
    _show(rate.withColumn("thesis_falsified", ~F.isnan("upper") & (F.col("upper") < 0.6)))


def sample(c: Corpus, a: argparse.Namespace) -> None:
    s = sampling.sample(c.runs.select("corpusRunId", F.col("source.repo").alias("repo")), c.named(), sampling.Policy(a.target, a.min, a.max, slice_large_runs=a.slice))
    doc = {"schemaVersion": 1, "digest": s.digest(), "policy": sampling.policy_row(s.policy), "runs": [{"corpusRunId": r["corpusRunId"], "failureIds": r["failureIds"]} for r in s.runs]}
    sinks.write_json(doc, a.out)
    _show(s.selected.drop("failureIds").orderBy(F.desc("n_failures"), "corpusRunId"))


def snapshot(c: Corpus, a: argparse.Namespace) -> None:
    """Runs by failures, labelers by failures, the gate, size bands, and a baseline per labeler, people first."""
    table, beside = gate(c)
    n = c.failures.groupBy("corpusRunId").agg(F.count(F.lit(1)).alias("failures"), F.sort_array(F.collect_set(detect_framework())).alias("frameworks"))
    runs = corpus.ordered(c.runs).join(n, "corpusRunId", "left").withColumn("heldOut", corpus.hold_out_reason(F.col("source.licenseSpdx"))).withColumn("failures", F.coalesce("failures", F.lit(0)))
    labels = c.labels()
    per = labels.groupBy("labeler", "category").agg(F.count(F.lit(1)).alias("n")).groupBy("labeler").agg(F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("categories"))
    lab = labels.groupBy("labeler").agg(F.count_distinct("corpusRunId").alias("runs"), F.count(F.lit(1)).alias("failures"), F.sort_array(F.collect_set("context")).alias("contexts"))
    lab = lab.join(per, "labeler").withColumn("machine", corpus.is_machine()).orderBy(F.desc("failures"), "labeler")
    f = hashing.with_fingerprint(c.failures.select("corpusRunId", "failureId", "errorType", "message", "stackText")).select("corpusRunId", "failureId", "loose_hash")
    scored = scoring.baseline_runs(scoring.scored(f, labels, scoring.by_column("loose_hash")))
    base = scoring.baseline_total(scored, ["labeler"]).withColumn("machine", corpus.is_machine()).orderBy("machine", "labeler")
    sinks.write_json({
        "schemaVersion": 1, "generatedAt": datetime.now(timezone.utc).isoformat(), "gate": {**beside, "requirements": sinks.rows(table), "concentration": sinks.rows(scoring.concentration(c.sizes()))[0]},
        "runs": sinks.rows(runs.orderBy(F.desc("failures"), "ordinal")), "labelers": sinks.rows(lab), "sizeBands": sinks.rows(_bands(c)), "baselines": sinks.rows(base),
    }, a.out)


def _bands(c: Corpus) -> DataFrame:
    n = c.sizes().groupBy(corpus.size_band(F.col("n")).alias("band")).agg(F.count(F.lit(1)).alias("runs"))
    all_ = c.spark.createDataFrame(list(enumerate(corpus.BANDS)), "k int, band string")
    return all_.join(n, "band", "left").orderBy("k").select("band", F.coalesce("runs", F.lit(0)).alias("runs"))


def holdout(c: Corpus, a: argparse.Namespace) -> None:
    x = c.runs.withColumn("kind", corpus.hold_out_reason(F.col("source.licenseSpdx"))).where("kind is not null")
    _show(x.groupBy("source.repo", "kind").count().orderBy("repo", "kind"))
    if a.ignore_file:
        old = open(a.ignore_file, encoding="utf-8").read() if os.path.exists(a.ignore_file) else ""
        paths = [f"runs/{r.dir}/" for r in x.select(T.path_safe("corpusRunId").alias("dir")).collect()]
        with open(a.ignore_file, "w", encoding="utf-8") as f:
            f.write(sinks.ignore_block(old, paths))


def compact(c: Corpus, a: argparse.Namespace) -> None:
    reports.write_runs(c.runs, T.compact(c.failures, a.cap), a.out)


def worksheet(c: Corpus, a: argparse.Namespace) -> None:
    entries = c.spark.read.option("multiLine", "true").schema("digest string, runs array<struct<corpusRunId: string, failureIds: array<string>>>").json(a.selection)
    rows = entries.select(F.explode("runs").alias("r")).select("r.*")
    sampling.check_selection(rows, c.runs)
    sheet, key = sampling.worksheet(sampling.selected(rows, c.failures), c.runs, a.context, entries.first().digest or "")
    sinks.write_json({"schemaVersion": 1, "context": a.context, "entries": sinks.rows(sheet.orderBy("entryId"))}, a.out)
    sinks.write_json({"schemaVersion": 1, "entries": sinks.rows(key.orderBy("entryId"))}, a.key)
    if a.page:
        with open(a.page, "w", encoding="utf-8") as f:
            f.write(sinks.ledger_page(sheet))


def import_(c: Corpus, a: argparse.Namespace) -> None:
    read = lambda p, s: c.spark.read.option("multiLine", "true").schema(f"entries array<struct<{s}>>").json(p).select(F.explode("entries").alias("e")).select("e.*")
    sheet = read(a.sheet, "entryId: string, corpusRunId: string, failureId: string, group: string, category: string, note: string")
    key = read(a.key, "entryId: string, corpusRunId: string, failureId: string") if a.key else None
    reports.write_labels(sampling.import_sheet(sheet, a.labeler, a.at, a.context, key), f"{a.corpus}/labels")


def scan(spark: SparkSession, a: argparse.Namespace) -> None:
    """What the archives yield: per repository of the listing, or per archive without one; --out lists the productive."""
    found = written(reports.read_archives(spark, a.archives))
    if a.sources:
        src = reports.archive_sources(spark, found, a.sources).select("archive", "repo")
    else:
        src = found.select("archive", F.col("archive").alias("repo")).distinct()
    per = written(reports.probe(found, src))
    good = per.where("reason = 'productive'")
    print(f"{good.count()} of {per.count()} yield failures; {found.select('archive', 'bytes').distinct().agg(F.coalesce(F.sum('bytes'), F.lit(0))).first()[0]} bytes in {found.select('archive').distinct().count()} archive(s)")
    _show(per.orderBy("repo"))
    _show(per.groupBy("reason").count().orderBy(F.desc("count"), "reason"))
    _show(reports.skip_reasons(found).orderBy("reason"))
    _show(reports.warning_counts(found.where("path is not null")))
    if a.out:
        with open(a.out, "w", encoding="utf-8") as f:
            f.write("".join(f"{r.repo}\n" for r in good.orderBy("repo").collect()))


def harvest(spark: SparkSession, a: argparse.Namespace) -> None:
    """Runs of the listing, from their archives, into the corpus folder; runs that are stored already are left alone."""
    found = written(reports.read_archives(spark, a.archives))
    src = reports.archive_sources(spark, found, a.sources)
    folder = f"{a.corpus}/runs"
    known = reports.read_runs(spark, folder)[0].select("corpusRunId") if reports.exists(spark, folder) else None
    runs, failures = reports.harvest(found, src, a.max_bytes, known)
    kept = corpus.committable(runs) if a.licensed_only else runs
    failures = failures.join(kept.select("corpusRunId"), "corpusRunId", "left_semi")
    reports.write_runs(kept.withColumn("warnings", F.lit(None).cast("array<struct<code:string,count:bigint>>")), failures, folder)
    stored = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum("counts.failures"), F.lit(0))).first()
    print(f"added {stored[0]} run(s), {stored[1]} failure(s); {src.select('corpusRunId').distinct().count()} listed")
    _show(reports.skip_reasons(found).orderBy("reason"))


COMMANDS = {"status": status, "frames": frames, "baseline": baseline, "agreement": agreement, "separability": separability, "sample": sample, "snapshot": snapshot, "holdout": holdout, "compact": compact, "worksheet": worksheet, "import": import_}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="faultline", exit_on_error=False)
    sub = p.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        s = sub.add_parser(name)
        s.add_argument("--corpus", required=True)
        options = {
            "status": [("--json", {"action": "store_true"})], "baseline": [("--labeler", {})], "agreement": [("a", {}), ("b", {})], "separability": [("full", {}), ("payload", {})],
            "sample": [("--out", {"required": True}), ("--target", {"type": int, "default": 100}), ("--min", {"type": int, "default": 5}), ("--max", {"type": int, "default": 40}), ("--slice", {"type": int, "default": 0})],
            "snapshot": [("--out", {"required": True})], "holdout": [("--ignore-file", {})], "compact": [("--cap", {"type": int, "default": T.FIELD_CAP}), ("--out", {"required": True})],
            "worksheet": [("--selection", {"required": True}), ("--context", {"default": "full"}), ("--out", {"required": True}), ("--key", {"required": True}), ("--page", {})],
            "import": [("--sheet", {"required": True}), ("--key", {}), ("--labeler", {"required": True}), ("--at", {"required": True}), ("--context", {"required": True})],
        }.get(name, [])
        for flag, kw in options:
            s.add_argument(flag, **kw)
    s = sub.add_parser("scan")
    s.add_argument("--archives", required=True)
    s.add_argument("--sources")
    s.add_argument("--out")
    s = sub.add_parser("harvest")
    for flag in ("--corpus", "--archives", "--sources"):
        s.add_argument(flag, required=True)
    s.add_argument("--max-bytes", type=int)
    s.add_argument("--licensed-only", action="store_true")
    return p


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except (argparse.ArgumentError, SystemExit):
        return 3
    spark = spark or build_session("faultline-cli")
    try:
        if a.command in ("scan", "harvest"):
            {"scan": scan, "harvest": harvest}[a.command](spark, a)
        else:
            COMMANDS[a.command](Corpus(spark, a.corpus), a)
        return 0
    except (Nothing, corpus.ValidationError, ParseError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
