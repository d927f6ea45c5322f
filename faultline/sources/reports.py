"""Spark sources: reports and archives as DataFrames, and the stored corpus as files.

Files are read by `binaryFile`; one parse per file runs in Arrow batches on the executors. The same parsers
back a Python data source, `spark.read.format("ci_report").load(folder)`.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from faultline.operators import corpus
from faultline.sources import junit, playwright
from faultline.sources.archive import ArchiveLimits, unpack
from faultline.sources.model import ATTEMPT, PARSED, Limits, ParseError

ADAPTERS = {m.NAME: m for m in (junit, playwright)}
_S, _L = T.StringType(), T.LongType()
SOURCE = T.StructType([
    *(T.StructField(n, _S) for n in ("provider", "repo", "providerRunId")), T.StructField("runAttempt", T.IntegerType()),
    *(T.StructField(n, _S) for n in ("url", "workflowName", "event", "headSha", "headBranch")), T.StructField("artifactIds", T.ArrayType(_S)),
    *(T.StructField(n, _S) for n in ("licenseSpdx", "licenseRaw", "retrievedAt")),
])
COUNTS = T.StructType([T.StructField(n, _L) for n in ("attempts", "failures", "passed", "skipped", "filesParsed", "filesRejected")])
STORED_FAILURE = T.StructType([
    *(T.StructField(n, _S) for n in ("failureId", "sourceFile", "producerAdapter")), T.StructField("shardIndex", T.IntegerType()), T.StructField("attemptIndex", T.IntegerType()),
    T.StructField("displayName", _S), T.StructField("suitePath", T.ArrayType(_S)), T.StructField("filePath", _S), T.StructField("status", _S),
    T.StructField("durationMs", T.DoubleType()), *(T.StructField(n, _S) for n in ("errorType", "message", "stackText", "stdout", "stderr")),
    T.StructField("truncated", T.MapType(_S, _L)),
])
RUN = T.StructType([
    T.StructField("schemaVersion", T.IntegerType()), T.StructField("corpusRunId", _S), T.StructField("source", SOURCE), T.StructField("fidelity", _S),
    T.StructField("counts", COUNTS), T.StructField("warnings", T.ArrayType(T.StructType([T.StructField("code", _S), T.StructField("count", _L)]))),
    T.StructField("failures", T.ArrayType(STORED_FAILURE)),
])
LABEL = T.StructType([T.StructField("group", _S), T.StructField("category", _S), T.StructField("note", _S)])
LABELS = T.StructType([
    T.StructField("schemaVersion", T.IntegerType()), T.StructField("corpusRunId", _S), T.StructField("labeler", _S), T.StructField("labeledAt", _S),
    T.StructField("context", _S), T.StructField("labels", T.MapType(_S, LABEL)),
])


def pick_adapter(name: str, data: bytes) -> str | None:
    """junit, playwright or none, by the file's ending and first 4096 bytes."""
    head, low = data[:4096].decode("utf-8", "replace"), name.lower()
    if low.endswith(".xml") and re.search(r"<\s*testsuites?[\s>]", head, re.I):
        return junit.NAME
    if low.endswith(".jsonl") and '"method"' in head:
        return playwright.NAME
    if low.endswith(".json") and re.search(r'"suites"\s*:', head) and re.search(r'"config"\s*:|"specs"\s*:', head):
        return playwright.NAME
    return None


def parse_file(name: str, data: bytes, shard: int = 0, skip_invalid: bool = True, limits: Limits = Limits()) -> dict | None:
    """One row of PARSED; None for files that are no report. A fatal error is a row with a code and no attempts."""
    adapter = pick_adapter(name, data)
    if adapter is None:
        return None
    row = {"path": name, "adapter": adapter, "error": None, "warnings": [], "attempts": []}
    try:
        p = ADAPTERS[adapter].parse(data, shard, skip_invalid, limits)
        return row | {"warnings": p.warnings, "attempts": p.attempts}
    except ParseError as e:
        return row | {"error": e.code}


#: Report bytes whose rows make one Arrow batch.
_BATCH_BYTES = 4 << 20


def _batch(rows: list[dict], schema: T.StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, to_arrow_schema(schema))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any file system Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")


def parse_reports(files: DataFrame, skip_invalid: bool = True, limits: Limits = Limits()) -> DataFrame:
    """path, adapter, error, warnings, attempts of every report among files (path, content); other files are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for p, c in zip(b.column(0).to_pylist(), b.column(1)):
                data = c.as_py()
                if row := parse_file(p, data, 0, skip_invalid, limits):
                    rows.append(row)
                    size += len(data)
                if size > _BATCH_BYTES:
                    yield _batch(rows, PARSED)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, PARSED)

    return files.select("path", "content").mapInArrow(run, PARSED)


def read_reports(spark: SparkSession, path: str, skip_invalid: bool = True, limits: Limits = Limits()) -> DataFrame:
    """The reports under a folder, in any file system Spark reads."""
    return parse_reports(_files(spark, path, "*.{xml,json,jsonl}"), skip_invalid, limits)


def attempts(reports: DataFrame) -> DataFrame:
    """One row per attempt, with its file, adapter and position in the file."""
    return reports.select("path", "adapter", F.posexplode("attempts").alias("position", "a")).select("path", "adapter", "position", "a.*")


def warning_counts(reports: DataFrame) -> DataFrame:
    rows = reports.select(F.explode("warnings.code").alias("code")).unionByName(reports.where("error is not null").select(F.concat_ws(":", F.lit("parse_failed"), "adapter", "error").alias("code")))
    return rows.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


ARCHIVED = T.StructType([T.StructField("archive", _S), T.StructField("bytes", _L), T.StructField("skipped", T.ArrayType(_S)), *PARSED.fields])


def read_archives(spark: SparkSession, path: str, limits: ArchiveLimits = ArchiveLimits()) -> DataFrame:
    """One row per report inside the zip files under a folder; an archive without any has one row of nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1)):
                data = c.as_py()
                files, skipped = unpack(data, limits)
                rows = [r for n in sorted(files) if (r := parse_file(n, files[n]))]
                yield _batch([{"archive": p, "bytes": len(data), "skipped": skipped} | r for r in rows or [dict.fromkeys(PARSED.names)]], ARCHIVED)

    return _files(spark, path, "*.zip").mapInArrow(run, ARCHIVED)


def skip_reasons(archives: DataFrame) -> DataFrame:
    """reason and n of what was skipped in archives; an archive's reasons count once, however many reports it holds."""
    each = archives.groupBy("archive").agg(F.any_value("skipped").alias("s"))
    return each.select(F.explode("s").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def probe(archives: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per repository of sources (archive, repo): artifacts, bytes, parsed reports, failures, adapters and the reason. A repository
    without any artifact has a row too."""
    fails = F.coalesce(F.size(F.filter("attempts", lambda a: a["failure"].isNotNull())), F.lit(0))
    per = archives.groupBy("archive").agg(F.any_value("bytes").alias("bytes"), F.count_if(F.col("path").isNotNull() & F.col("error").isNull()).alias("parsed"), F.sum(fails).alias("failures"), F.collect_set("adapter").alias("adapters"))
    out = sources.join(per, "archive", "left").groupBy("repo").agg(
        F.count("bytes").alias("artifacts"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("parsed"), F.lit(0)).alias("parsed"), F.coalesce(F.sum("failures"), F.lit(0)).alias("failures"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("adapters")))).alias("adapters"),
    )
    return out.withColumn("reason", corpus.probe_reason(F.col("parsed"), F.col("failures"), F.col("artifacts")))


def archive_sources(spark: SparkSession, archives: DataFrame, listing: str) -> DataFrame:
    """archive, size, corpusRunId, source, repo from a JSON-lines listing: name (of the file, null for a run without artifacts), corpusRunId, source."""
    schema = T.StructType([T.StructField("name", _S), T.StructField("corpusRunId", _S), T.StructField("source", SOURCE)])
    rows = spark.read.schema(schema).json(listing)
    files = archives.select("archive", F.col("bytes").alias("size"), F.regexp_extract("archive", r"([^/]*)$", 1).alias("name")).distinct()
    return rows.join(files, "name", "left").select("archive", "size", "corpusRunId", "source", F.col("source.repo").alias("repo"))


def harvest(archives: DataFrame, sources: DataFrame, budget: int | None = None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(runs, failures) from archives (archive, path, adapter, attempts ...) and sources (archive, size, corpusRunId, source).

    Runs that are known already are left out, as are runs without failures. Archives of a run are taken smallest
    first within the budget; one that does not fit is passed over. Failures are numbered by archive, file and position.
    """
    sources = sources.where("archive is not null")
    if known is not None:
        sources = sources.join(known.select("corpusRunId"), "corpusRunId", "left_anti")
    order = F.array_sort(F.collect_list(F.struct("size", "archive")))
    kept = sources.groupBy("corpusRunId").agg(order.alias("all"))
    if budget is None:
        taken = F.col("all")
    else:
        start = F.struct(F.lit(0).cast("long").alias("used"), F.slice("all", 1, 0).alias("out"))
        fits = lambda acc, x: acc["used"] + x["size"] <= budget
        step = lambda acc, x: F.when(fits(acc, x), F.struct((acc["used"] + x["size"]).cast("long").alias("used"), F.concat(acc["out"], F.array(x)).alias("out"))).otherwise(acc)
        taken = F.aggregate("all", start, step, lambda acc: acc["out"])
    kept = kept.select("corpusRunId", F.posexplode(taken).alias("shard", "x")).select("corpusRunId", "shard", F.col("x.archive").alias("archive"))
    files = archives.join(kept, "archive")
    counts = files.groupBy("corpusRunId").agg(
        *(F.sum(F.coalesce(F.size(F.filter("attempts", c)), F.lit(0)).cast("long")).alias(n) for n, c in (
            ("attempts", lambda a: F.lit(True)), ("failures", lambda a: a["failure"].isNotNull()), ("passed", lambda a: a["status"] == "passed"),
            ("skipped", lambda a: a["status"] == "skipped"),
        )),
        F.count_if(F.col("path").isNotNull() & F.col("error").isNull()).alias("filesParsed"), F.count_if(F.col("error").isNotNull()).alias("filesRejected"),
    )
    from pyspark.sql import Window

    # a failure's number is its place in its file behind the failures of the run's earlier files: the window has a row per file
    file, bad = ["corpusRunId", "archive", "path"], F.filter("attempts", lambda a: a["failure"].isNotNull())
    earlier = Window.partitionBy("corpusRunId").orderBy("shard", "path").rowsBetween(Window.unboundedPreceding, -1)
    sizes = files.where("path is not null").select(*file, "shard", F.coalesce(F.size(bad), F.lit(0)).alias("n"))
    starts = sizes.select(*file, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    rows = files.where("path is not null").select(*file, "shard", F.col("adapter").alias("producerAdapter"), F.posexplode(bad).alias("pos", "a")).join(starts, file)
    failures = rows.select(
        "corpusRunId", F.format_string("f%04d", F.col("start") + F.col("pos") + 1).alias("failureId"),
        F.concat_ws("/", F.regexp_extract("archive", r"([^/]*?)(?:\.zip)?$", 1), "path").alias("sourceFile"), "producerAdapter", F.col("shard").alias("shardIndex"),
        "a.attemptIndex", "a.displayName", "a.suitePath", "a.filePath", "a.status", "a.durationMs", "a.failure.errorType", "a.failure.message", "a.failure.stackText",
        "a.failure.stdout", "a.failure.stderr", F.lit(None).cast("map<string,bigint>").alias("truncated"),
    )
    one = sources.groupBy("corpusRunId").agg(F.first("source").alias("source"))
    runs = counts.where("failures > 0").join(one, "corpusRunId").select(
        F.lit(corpus.SCHEMA_VERSION).alias("schemaVersion"), "corpusRunId", "source", F.lit("artifact").alias("fidelity"), F.struct(*COUNTS.names).alias("counts")
    )
    return runs, failures


# ---- stored corpus -------------------------------------------------------------------------------


def read_runs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(runs, failures) of run documents under folder/<dir>/run.json; a document that cannot be parsed fails the read."""
    docs = spark.read.schema(RUN).option("multiLine", "true").option("mode", "FAILFAST").json(f"{folder}/*/run.json")
    failures = docs.select("corpusRunId", F.explode("failures").alias("f")).select("corpusRunId", "f.*")
    return docs.drop("failures"), failures


def _by_id(a, b):
    return F.when(a["failureId"] < b["failureId"], -1).when(a["failureId"] > b["failureId"], 1).otherwise(0)


def write_runs(runs: DataFrame, failures: DataFrame, folder: str) -> None:
    """One document per run, one folder per run; folders that exist are replaced."""
    own = failures.groupBy("corpusRunId").agg(F.array_sort(F.collect_list(F.struct(*STORED_FAILURE.names)), _by_id).alias("failures"))
    docs = runs.join(own, "corpusRunId", "left").withColumn("dir", F.regexp_replace("corpusRunId", r"[^A-Za-z0-9._-]+", "_"))
    _write_documents(docs, folder, "run.json")


def _safe(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]+", "_", name)


def read_labels(spark: SparkSession, folder: str, labeler: str | None = None, run: str | None = None) -> DataFrame:
    """Label documents under folder/<labeler>/<run>.json, of one labeler or run if named; one without a file has none."""
    path = f"{folder}/{'*' if labeler is None else _safe(labeler)}/{'*' if run is None else _safe(run)}.json"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    if found is None or not len(found):
        return spark.createDataFrame([], LABELS)
    return spark.read.schema(LABELS).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def labelers(spark: SparkSession, folder: str) -> list[str]:
    """The folders of labelers, by name, without reading a document."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    return sorted(f.getPath().getName() for f in found if f.isDirectory())


def write_labels(labels: DataFrame, folder: str) -> None:
    safe = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_")
    _write_documents(labels.withColumn("dir", safe("labeler")).withColumn("file", F.concat(safe("corpusRunId"), F.lit(".json"))), folder, None)


def _write_documents(docs: DataFrame, folder: str, name: str | None) -> None:
    """Each row as one JSON file; executors write to the shared folder themselves, through a file that is renamed."""
    body = F.to_json(F.struct(*[c for c in docs.columns if c not in ("dir", "file")])).alias("body")
    rows = docs.select("dir", F.lit(name).alias("file") if name else F.col("file"), body)

    def put(part: Iterator) -> None:
        for r in part:
            target = os.path.join(folder, r.dir)
            os.makedirs(target, exist_ok=True)
            with open(os.path.join(target, f".{r.file}.new"), "w", encoding="utf-8") as f:
                f.write(r.body + "\n")
            os.replace(os.path.join(target, f".{r.file}.new"), os.path.join(target, r.file))

    rows.foreachPartition(put)


def read_repository_list(spark: SparkSession, source: str) -> DataFrame:
    """owner/name per row, from a file (# begins a comment) or a comma list."""
    lines = spark.read.text(source) if exists(spark, source) else spark.createDataFrame([(x,) for x in source.split(",")], "value string")
    return lines.select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("repo")).where("repo <> ''").distinct()


# ---- generated input -----------------------------------------------------------------------------


def synthetic_reports(spark: SparkSession, n: int, suites: int = 50) -> DataFrame:
    """JUnit reports (path, content) with n failing results in all, one report per suite; values, identifiers,
    addresses, ports and times vary from result to result."""
    per = -(-n // suites)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for suite in b.column(0).to_pylist():
                cases = []
                for k in range(suite * per, min(n, (suite + 1) * per)):
                    what = f"wanted {k % 9} rows but found {k % 13}"
                    cases.append(
                        f'<testcase name="result {k}" classname="Suite{suite}" time="{k % 89 / 10}"><failure type="AssertionError" message="{what}"><![CDATA[AssertionError: {what}\n'
                        f"    at verify (src/part{suite}/table.ts:{k % 400 + 1}:{k % 60 + 1})\n    at drive (node_modules/runner/lib/main.js:9:4)\n    at Object.<anonymous> (test/part{suite}.spec.ts:{k % 200}:7)\n"
                        f"after {k % 5000}ms; request 3f2504e0-4f89-41d3-9a0c-0305e82c33{k % 100:02d} to 10.1.{k % 250}.{k * 7 % 250}:9090 was refused]]></failure></testcase>"
                    )
                xml = f'<testsuites><testsuite name="suite {suite}" file="test/part{suite}.spec.ts">{"".join(cases)}</testsuite></testsuites>'
                yield pa.RecordBatch.from_arrays([pa.array([f"suite-{suite}.xml"]), pa.array([xml.encode()])], ["path", "content"])

    return spark.range(suites, numPartitions=min(suites, spark.sparkContext.defaultParallelism * 2)).mapInArrow(run, "path string, content binary")


def synthetic_messages(spark: SparkSession, n: int) -> DataFrame:
    """Messages with values, times, addresses and identifiers for normalisation to fold."""
    i = F.col("id")
    text = F.format_string("AssertionError: wanted %d but found %d after %dms at 10.0.0.%d:9090 for request 3f2504e0-4f89-41d3-9a0c-0305e82c%04d", i % 13, i % 17, i % 900, i % 255, i % 10000)
    return spark.range(n).select(text.alias("message"))


# ---- Python data source --------------------------------------------------------------------------


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    """Partitions are planned by bytes: small files share one, a file is never split."""

    def __init__(self, folder: str, skip_invalid: bool, partition_bytes: int):
        self.folder, self.skip_invalid, self.partition_bytes = folder, skip_invalid, partition_bytes

    def partitions(self) -> list[_Files]:
        found = [os.path.join(d, f) for d, _, fs in os.walk(self.folder) for f in fs if f.lower().endswith((".xml", ".json", ".jsonl"))]
        out, size = [_Files([])], 0
        for path in sorted(found):
            n = os.path.getsize(path)
            if out[-1].paths and size + n > self.partition_bytes:
                out.append(_Files([]))
                size = 0
            out[-1].paths.append(path)
            size += n
        return out

    def read(self, partition: _Files):
        for path in partition.paths:
            with open(path, "rb") as f:
                row = parse_file(path, f.read(), 0, self.skip_invalid)
            for a in (row or {}).get("attempts", []):
                fields = [a[n] for n in ATTEMPT.names[:-1]]
                x = a["failure"]
                yield (path, row["adapter"], *fields, None if x is None else tuple([tuple(v.values()) for v in y] if k == "artifacts" else y for k, y in x.items()))


class ReportSource(DataSource):
    """spark.dataSource.register(ReportSource); spark.read.format("ci_report").load(folder), for a folder that all nodes mount;
    `read_reports` reads any file system Spark knows."""

    @classmethod
    def name(cls) -> str:
        return "ci_report"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("path", _S), T.StructField("adapter", _S), *ATTEMPT.fields])

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options["path"], self.options.get("skipInvalid", "true") == "true", int(self.options.get("partitionBytes", 64 << 20)))
