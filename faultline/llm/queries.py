"""Queries of the training-data operators, with SQL where SQL can express them over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import abuse, consensus, duplicates, encoding_repair, near_duplicates, packing, tokenize
from faultline.session import table, written

SIMILAR = 0.7


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.copies(table(spark, d, "failures"))


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.records(table(spark, d, "failures"))


def _near(spark: SparkSession, d: str) -> near_duplicates.NearDuplicates:
    texts = near_duplicates.failure_texts(table(spark, d, "failures"))
    return near_duplicates.NearDuplicates(texts, "rowId", "text", SIMILAR)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).row_pairs()


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).memberships()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = consensus.Consensus(table(spark, d, "run_labels")).rows()
    two = F.explode(F.array(
        F.struct(F.lit("category").alias("field_name"), F.col("category").alias("consensus_value")),
        F.struct(F.lit("group").alias("field_name"), F.col("first_of_group").alias("consensus_value")),
    ))
    return rows.select(F.col("run_id").alias("corpus_run_id"), "failure_id", two.alias("x")).select("corpus_run_id", "failure_id", "x.*")


def p4_labelers(spark: SparkSession, d: str) -> DataFrame:
    return consensus.Consensus(table(spark, d, "run_labels")).labelers()


def p4_agreement(spark: SparkSession, d: str) -> DataFrame:
    out = consensus.Statements(table(spark, d, "run_labels")).agreement()
    return out.withColumns({c: F.round(c, 9) for c in ("observed_disagreement", "expected_disagreement", "alpha", "group_agreement")})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding_repair.Repair(table(spark, d, "failures")).found()


def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding_repair.Repair(table(spark, d, "failures")).restored()


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode(table(spark, d, "documents"), tokenizer="byte_bpe_50k")


def _packed(spark: SparkSession, d: str) -> tuple[DataFrame, dict[int, int]]:
    """Targets are few rows of a fixed table; each tokenizer named there sizes the corpus once."""
    targets = table(spark, d, "pack_targets").collect()
    out = None
    for name in sorted({t.tokenizer for t in targets}):
        sizes = written(tokenize.sizes(table(spark, d, "documents"), tokenizer=name))
        part = packing.pack(sizes, {t.target_id: t.capacity_tokens for t in targets if t.tokenizer == name})
        out = part if out is None else out.unionAll(part)
    return out, {t.target_id: t.capacity_tokens for t in targets}


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)[0]


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(*_packed(spark, d))


def _abuse(spark: SparkSession, d: str) -> abuse.AbuseClassifier:
    return abuse.AbuseClassifier(table(spark, d, "documents"), table(spark, d, "review_labels"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _abuse(spark, d).scores().where("flagged").select("doc_id")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return _abuse(spark, d).scores()


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return _abuse(spark, d).rates()


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_records, p3_found, p3_classes, p4_found, p4_labelers, p4_agreement, p5_found, p5_restored, p6_ids,
        p7_containers, p7_report, p8_found, p8_scores, p8_rates,
    )
}
_SETS = "list_sort(list_distinct(regexp_extract_all(lower(coalesce(message, '') || chr(10) || stackText), '[a-z0-9]+')))"
_LETTERS = " ".join(f"WHEN '{c.replace('_', '')}' THEN {i}" for i, c in enumerate(consensus.CATEGORIES))
_C2 = "({0} * ({0} - 1) // 2)"
SQL = {
    "p3_found": """
        WITH w AS (SELECT rowId, unnest(list_distinct(regexp_extract_all(lower(message || chr(10) || stackText), '[a-z0-9]+'))) AS w
            FROM failures WHERE stackText IS NOT NULL),
          n AS (SELECT rowId, count(*) AS n FROM w GROUP BY rowId),
          c AS (SELECT a.rowId AS a, b.rowId AS b, count(*) AS k FROM w a JOIN w b ON a.w = b.w AND a.rowId < b.rowId GROUP BY ALL)
        SELECT a AS row_id_a, b AS row_id_b FROM c JOIN n x ON x.rowId = a JOIN n y ON y.rowId = b WHERE k >= 0.7 * (x.n + y.n - k)""",
    "p3_classes": f"""
        WITH s AS (SELECT rowId, {_SETS} AS w FROM failures WHERE stackText IS NOT NULL),
          c AS (SELECT w, min(rowId) AS id, count(*) AS n FROM s WHERE len(w) > 0 GROUP BY w),
          x AS (SELECT id, len(w) AS n, unnest(w) AS w FROM c),
          p AS (SELECT a.id AS a, b.id AS b, any_value(a.n) + any_value(b.n) AS n, count(*) AS k FROM x a JOIN x b ON a.w = b.w AND a.id < b.id GROUP BY ALL),
          e AS (SELECT unnest([a, b]) AS id FROM p WHERE k >= 0.7 * (n - k)), l AS (SELECT id, count(*) AS n FROM e GROUP BY id)
        SELECT rowId AS row_id, c.id AS class_id, c.n::BIGINT AS n_copies, coalesce(l.n, 0)::BIGINT AS n_links FROM s JOIN c USING (w) LEFT JOIN l ON l.id = c.id""",
    "p4_agreement": f"""
        WITH e AS (SELECT corpusRunId AS run, lower(trim(labeler)) AS who, coalesce(context, '') AS context, coalesce(labeledAt, '') AS said_at, unnest(map_entries(labels)) AS e
            FROM run_labels WHERE corpusRunId IS NOT NULL AND labeler IS NOT NULL),
          x AS (SELECT run, e.key AS f, who, context, said_at, CASE regexp_replace(upper(e.value.category), '[^A-Z0-9]', '', 'g') {_LETTERS} END AS c,
            nullif(regexp_replace(lower(e.value."group"), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '') AS g FROM e),
          st AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY run, f, who, context ORDER BY said_at DESC, c DESC NULLS LAST, g DESC NULLS LAST) AS k FROM x) WHERE k = 1),
          u AS (SELECT run, f, sum(n) AS m, sum(n * n) AS s FROM (SELECT run, f, c, count(*) AS n FROM st WHERE c IS NOT NULL GROUP BY ALL) GROUP BY ALL HAVING sum(n) > 1),
          t AS (SELECT count(*)::BIGINT AS n_failures, sum(m)::BIGINT AS n_labels, sum((m * m - s) / (m - 1)) AS d FROM u),
          k AS (SELECT sum(n * n) AS s2 FROM (SELECT c, count(*) AS n FROM st JOIN u USING (run, f) WHERE c IS NOT NULL GROUP BY c)),
          a AS (SELECT n_failures, n_labels, d / n_labels AS o, (n_labels::DOUBLE * n_labels - s2) / (n_labels::DOUBLE * (n_labels - 1)) AS ex FROM t, k),
          b AS (SELECT p.run, p.who AS w1, p.context AS c1, q.who AS w2, q.context AS c2, p.g AS g1, q.g AS g2, count(*) AS n FROM st p JOIN st q ON p.run = q.run AND p.f = q.f AND p.who < q.who
            WHERE p.g IS NOT NULL AND q.g IS NOT NULL GROUP BY ALL),
          tot AS (SELECT sum({_C2.format('n')}) AS n FROM (SELECT run, w1, c1, w2, c2, sum(n) AS n FROM b GROUP BY ALL)), both_ AS (SELECT sum({_C2.format('n')}) AS n FROM b),
          r1 AS (SELECT sum({_C2.format('n')}) AS n FROM (SELECT run, w1, c1, w2, c2, g1, sum(n) AS n FROM b GROUP BY ALL)),
          r2 AS (SELECT sum({_C2.format('n')}) AS n FROM (SELECT run, w1, c1, w2, c2, g2, sum(n) AS n FROM b GROUP BY ALL))
        SELECT n_failures, n_labels, round(o, 9) AS observed_disagreement, round(ex, 9) AS expected_disagreement, round(1 - o / ex, 9) AS alpha, tot.n::DOUBLE AS n_group_pairs,
          round((tot.n - r1.n - r2.n + 2 * both_.n) / tot.n, 9) AS group_agreement FROM a, tot, both_, r1, r2""",
}
