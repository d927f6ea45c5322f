"""Structured Streaming: idempotent ingestion, event-time windows and sessions, late rows, assembly of split events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_new(target: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows whose key is stored already, or comes twice in the batch, are not stored again.

    A batch that is replayed after a failure finds its own rows and stores nothing."""

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(key)
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):  # something is stored
            fresh = fresh.join(spark.read.schema(batch.schema).parquet(target).select(*key), key, "left_anti")
        fresh.write.mode("append").parquet(target)

    return put


def ingest(stream: DataFrame, target: str, checkpoint: str, key: list[str], available_now: bool = True) -> StreamingQuery:
    w = stream.writeStream.foreachBatch(append_new(target, key)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def windowed(rows: DataFrame, ts: str, length: str, *aggregates: Column, slide: str | None = None, by: list[str] | None = None, lateness: str | None = None) -> DataFrame:
    """Aggregates per event-time window; with `lateness`, state is dropped once the watermark has passed a window."""
    if lateness:
        rows = rows.withWatermark(ts, lateness)
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = rows.groupBy(w.alias("w"), *(by or [])).agg(*aggregates)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def sessions(rows: DataFrame, ts: str, gap: str, *aggregates: Column, by: list[str], lateness: str | None = None) -> DataFrame:
    """Runs of rows of one key without a pause of `gap`."""
    if lateness:
        rows = rows.withWatermark(ts, lateness)
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(*aggregates)
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *[c for c in out.columns if c != "w"])


def late_rows(rows: DataFrame, happened: str, arrived: str, lateness: str) -> DataFrame:
    """Rows that arrived more than `lateness` after they happened."""
    return rows.where(F.col(arrived) > F.col(happened) + F.expr(f"interval {lateness}"))


def assemble(results: DataFrame, attachments: DataFrame, key: str, ts: str, within: str) -> DataFrame:
    """Results with their attachments, which may come earlier or later by at most `within`; both sides are streams or tables."""
    a = results.withWatermark(ts, within).alias("a")
    b = attachments.withWatermark(ts, within).withColumnRenamed(ts, "_at").withColumnRenamed(key, "_key").alias("b")
    near = (F.col("_at") >= F.col(f"a.{ts}") - F.expr(f"interval {within}")) & (F.col("_at") <= F.col(f"a.{ts}") + F.expr(f"interval {within}"))
    return a.join(b, (F.col(f"a.{key}") == F.col("_key")) & near, "left").drop("_key", "_at")
