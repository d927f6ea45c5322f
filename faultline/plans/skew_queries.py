"""Queries of the skew operator over the failure and selection tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators import skew
from faultline.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys that hold at least 5% of their table's rows."""
    parts = (("failures", "failureId"), ("agreement_selection", "corpusRunId"))
    found = [skew.heavy_keys(table(spark, d, t), k, 0.05).select(F.lit(k).alias("field_name"), F.col(k).alias("key_value")) for t, k in parts]
    return found[0].unionAll(found[1])


def p2_failure_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per failureId: rows, rows with a stack, longest and total duration, first and last arrival."""
    df = table(spark, d, "failures").select("rowId", "failureId", "durationMs", "stackText", "ingestedAt")
    df = df.select("rowId", "failureId", "durationMs", F.col("stackText").isNotNull().cast("long").alias("has_stack"), "ingestedAt")
    partial = [
        F.count(F.lit(1)).alias("n"), F.sum("has_stack").alias("s"), F.max("durationMs").alias("d"), F.sum(F.round("durationMs").cast("long")).alias("t"),
        F.min("ingestedAt").alias("a"), F.max("ingestedAt").alias("z"),
    ]
    final = [
        F.sum("n").alias("n_rows"), F.sum("s").alias("n_with_stack"), F.max("d").alias("max_duration_ms"), F.sum("t").alias("total_duration_ms"),
        F.min("a").alias("first_ingested"), F.max("z").alias("last_ingested"),
    ]
    return skew.per_key(df, "failureId", partial, final, spread=F.col("rowId"))


def p2_selected_runs(spark: SparkSession, d: str) -> DataFrame:
    """Each selection entry of a stored run with that run's latest harvest, counted by run."""
    entries = table(spark, d, "agreement_selection").select("corpusRunId", "digest", F.size("failureIds").alias("n_ids"))
    runs = table(spark, d, "runs").groupBy("corpusRunId").agg(
        F.max_by(F.struct("source.repo", "counts.failures"), F.struct("ingestedAt", "counts.attempts", "counts.failures")).alias("r")
    )
    plan = skew.plan_load(table(spark, d, "agreement_selection").select("corpusRunId"), "corpusRunId")
    partial = [F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("n_ids") >= 0, F.col("n_ids"))).alias("ids"), F.first("r").alias("r")]
    final = [F.sum("n").alias("n_entries"), F.sum("ids").alias("n_failure_ids"), F.first("r").alias("r")]
    out = skew.join_per_key(entries, runs, "corpusRunId", partial, final, plan, F.struct("digest", "n_ids", F.monotonically_increasing_id()))
    return out.select("corpusRunId", "n_entries", "n_failure_ids", "r.repo", F.col("r.failures").alias("run_failures"))


QUERIES = {"p2_found": p2_found, "p2_failure_profile": p2_failure_profile, "p2_selected_runs": p2_selected_runs}

SQL = {
    "p2_found": """
        SELECT 'failureId' AS field_name, failureId AS key_value FROM failures WHERE failureId IS NOT NULL GROUP BY failureId
        HAVING count(*) >= 0.05 * (SELECT count(*) FROM failures)
        UNION ALL
        SELECT 'corpusRunId', corpusRunId FROM agreement_selection WHERE corpusRunId IS NOT NULL GROUP BY corpusRunId
        HAVING count(*) >= 0.05 * (SELECT count(*) FROM agreement_selection)""",
    "p2_failure_profile": """
        SELECT failureId, count(*)::BIGINT AS n_rows, count(stackText)::BIGINT AS n_with_stack, max(durationMs) AS max_duration_ms,
          sum(round(durationMs)::BIGINT)::BIGINT AS total_duration_ms, min(ingestedAt) AS first_ingested, max(ingestedAt) AS last_ingested
        FROM failures GROUP BY failureId""",
    "p2_selected_runs": """
        WITH r AS (SELECT corpusRunId, source.repo AS repo, counts.failures AS run_failures, row_number() OVER (PARTITION BY corpusRunId
            ORDER BY ingestedAt DESC, counts.attempts DESC, counts.failures DESC) AS k FROM runs)
        SELECT a.corpusRunId, count(*)::BIGINT AS n_entries, sum(len(a.failureIds))::BIGINT AS n_failure_ids, any_value(r.repo) AS repo,
          any_value(r.run_failures) AS run_failures
        FROM agreement_selection a JOIN r ON a.corpusRunId = r.corpusRunId AND r.k = 1 GROUP BY a.corpusRunId""",
}
