"""Queries over runs, failures, labels and selections, each over its whole tables, with SQL where SQL can say it.

Undefined ratios are null here, so that both engines agree; the library's own default is NaN.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.functions import hashing, stats, text
from faultline.functions.frames import detect_framework, framework_or_adapter
from faultline.functions.normalize import normalize
from faultline.operators import corpus, gates, sampling, scoring
from faultline.session import spread, table, written

RESAMPLES = stats.RESAMPLES
QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _runs(s: SparkSession, d: str) -> DataFrame:
    return corpus.latest_runs(table(s, d, "runs"))


def _failures(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return corpus.first_deliveries(table(s, d, "failures"), *columns)


def _labels(s: SparkSession, d: str, *keys: str) -> DataFrame:
    return corpus.label_rows(corpus.latest_labels(table(s, d, "run_labels"), keys or ("labeler", "corpusRunId")))


#: The views that several statements start from.
_RUNS = """runs_ AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY corpusRunId ORDER BY ingestedAt DESC,
    counts.attempts DESC, counts.failures DESC) AS k FROM runs) WHERE k = 1)"""
_FAILURES = """failures_ AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY corpusRunId, failureId ORDER BY rowId) AS k
    FROM failures) WHERE k = 1)"""
_DOCS = """docs AS (SELECT * EXCLUDE k FROM (SELECT lower(trim(labeler)) AS labeler, corpusRunId, context, labeledAt, labels,
    row_number() OVER (PARTITION BY lower(trim(labeler)), corpusRunId ORDER BY labeledAt DESC, context DESC,
      list_sort(map_entries(labels)) DESC) AS k FROM run_labels) WHERE k = 1)"""
_LABELS = (
    _DOCS
    + """, labels_ AS (SELECT labeler, corpusRunId, context, e.key AS failureId, e.value."group" AS grp,
    regexp_replace(upper(trim(e.value.category)), '[ -]+', '_', 'g') AS category
    FROM (SELECT labeler, corpusRunId, context, unnest(map_entries(labels)) AS e FROM docs))"""
)
_PAIRS = """pairs AS (SELECT a.corpusRunId, a.failureId, a.labeler AS labeler_a, b.labeler AS labeler_b, a.category AS cat_a, b.category AS cat_b,
    a.grp AS grp_a, b.grp AS grp_b FROM labels_ a JOIN labels_ b ON a.corpusRunId = b.corpusRunId AND a.failureId = b.failureId
    AND a.labeler < b.labeler JOIN (SELECT corpusRunId, failureId FROM failures_) f ON a.corpusRunId = f.corpusRunId AND a.failureId = f.failureId
    WHERE NOT starts_with(a.labeler, 'machine:') AND NOT starts_with(b.labeler, 'machine:'))"""


def _counts_sql(src: str, by: str, p: str, t: str) -> str:
    """Pair counts by contingency, as CTEs ending in `pc`."""
    c2 = lambda x: f"sum({x} * ({x} - 1) // 2)"
    return f"""
      cell AS (SELECT {by}, {p} AS p, {t} AS t, count(*) AS n FROM {src} GROUP BY ALL),
      mp AS (SELECT {by}, {c2('n')} AS s FROM (SELECT {by}, p, sum(n) AS n FROM cell GROUP BY ALL) GROUP BY ALL),
      mt AS (SELECT {by}, {c2('n')} AS s FROM (SELECT {by}, t, sum(n) AS n FROM cell GROUP BY ALL) GROUP BY ALL),
      mj AS (SELECT {by}, {c2('n')} AS s, sum(n) AS n FROM cell GROUP BY ALL),
      pc AS (SELECT {by}, mj.n::BIGINT AS n, mj.s::BIGINT AS tp, (mp.s - mj.s)::BIGINT AS fp, (mt.s - mj.s)::BIGINT AS fn,
        (mj.n * (mj.n - 1) // 2 - mp.s - mt.s + mj.s)::BIGINT AS tn FROM mj JOIN mp USING ({by}) JOIN mt USING ({by}))"""


_PRF = "tp / nullif(tp + fp, 0)::DOUBLE AS \"precision\", tp / nullif(tp + fn, 0)::DOUBLE AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE AS f1"


def _boot_sql(src: str, by: str, order: str, sums: list[str], stat: str, resamples: int, seed: int) -> str:
    """CTEs ending in `iv`: by, n, point, lower, upper of resampled units."""
    m = "4294967296"
    imul = lambda a, b: f"(({a})::HUGEINT * ({b}) % {m})::BIGINT"
    g = f"{by}," if by else ""
    over = f"PARTITION BY {by}" if by else ""
    on = " AND ".join(f"u.{c.strip()} = s.{c.strip()}" for c in by.split(",")) + " AND " if by else ""
    return f"""
      unit AS (SELECT *, row_number() OVER ({over} ORDER BY {order}) - 1 AS i, count(*) OVER ({over}) AS m FROM {src}),
      grp_ AS (SELECT {g} max(m) AS m FROM unit {'GROUP BY ' + by if by else ''}),
      slot AS (SELECT {g} m, b, unnest(range(m)) AS s FROM (SELECT *, unnest(range({resamples})) AS b FROM grp_ WHERE m > 0)),
      d0 AS (SELECT {g} b, m, (({seed}::HUGEINT + (b * m + s + 1)::HUGEINT * 1831565813) % {m})::BIGINT AS a FROM slot),
      d1 AS (SELECT {g} b, m, {imul('xor(a, a >> 15)', 'a | 1')} AS t FROM d0),
      d2 AS (SELECT {g} b, m, xor(t, (t + {imul('xor(t, t >> 7)', 't | 61')}) % {m}) AS t FROM d1),
      pick AS (SELECT {g} b, floor(xor(t, t >> 14) / {m}.0::DOUBLE * m)::BIGINT AS i FROM d2),
      res AS (SELECT {', '.join(f's.{c.strip()}' for c in by.split(',')) + ',' if by else ''} s.b, {', '.join(f'sum(u.{c}) AS {c}' for c in sums)}
        FROM pick s JOIN unit u ON {on} u.i = s.i GROUP BY ALL),
      bound AS (SELECT {g} quantile_cont(x, 0.025) AS lower, quantile_cont(x, 0.975) AS upper FROM (SELECT {g} {stat} AS x FROM res)
        WHERE x IS NOT NULL GROUP BY ALL),
      tot AS (SELECT {g} count(*)::BIGINT AS n, {', '.join(f'sum({c}) AS {c}' for c in sums)} FROM {src} GROUP BY ALL),
      iv AS (SELECT {', '.join(f'tot.{c.strip()}' for c in by.split(',')) + ',' if by else ''} n, {stat} AS point,
        CASE WHEN n < 2 THEN NULL ELSE lower END AS lower, CASE WHEN n < 2 THEN NULL ELSE upper END AS upper
        FROM tot LEFT JOIN bound ON {' AND '.join(f'tot.{c.strip()} = bound.{c.strip()}' for c in by.split(',')) if by else 'true'})"""


def _null(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols})


# ---- baseline ------------------------------------------------------------------------------------


def _scored(s: SparkSession, d: str, grouping=scoring.same_error_type) -> DataFrame:
    return scoring.scored(_failures(s, d, "errorType"), _labels(s, d), grouping)


def _derived(s: SparkSession, d: str, make, *columns: str) -> DataFrame:
    """One row per failure with columns derived from its texts. They are derived where the texts are read, so no text is shuffled."""
    f = spread(table(s, d, "failures").select("rowId", "corpusRunId", "failureId", "sourceFile", "producerAdapter", "errorType", "message", "stackText"))
    return corpus.first_deliveries(make(f).select("rowId", "corpusRunId", "failureId", *columns), *columns)


_SCORED = f"""WITH {_FAILURES}, {_LABELS},
  scored AS (SELECT l.labeler, l.corpusRunId, l.failureId, coalesce(f.errorType, '') AS predicted, l.grp AS truth
    FROM labels_ l JOIN failures_ f ON l.corpusRunId = f.corpusRunId AND l.failureId = f.failureId)"""
_PER_RUN = f"""{_SCORED}, {_counts_sql('scored', 'labeler, corpusRunId', 'predicted', 'truth')},
  grps AS (SELECT labeler, corpusRunId, count(DISTINCT truth)::BIGINT AS labelled_groups, count(DISTINCT predicted)::BIGINT AS predicted_groups
    FROM scored GROUP BY ALL),
  per_run AS (SELECT labeler, corpusRunId, n AS n_failures, tp, fp, fn, tn, labelled_groups, predicted_groups, {_PRF} FROM pc JOIN grps USING (labeler, corpusRunId)
    WHERE n >= 2)"""
_F1 = "2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE"


@_query(f"{_PER_RUN} SELECT * FROM per_run")
def baseline_per_run(s: SparkSession, d: str) -> DataFrame:
    """Grouping by error type scored against every labeler's groups, run by run."""
    return scoring.baseline_runs(_scored(s, d), undefined="null")


@_query(f"""{_PER_RUN}, {_boot_sql('per_run', 'labeler', 'corpusRunId', ['tp', 'fp', 'fn'], _F1, RESAMPLES, stats.SEED)},
  t AS (SELECT labeler, count(*)::BIGINT AS n_runs, sum(n_failures)::BIGINT AS n_failures, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp,
    sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn FROM per_run GROUP BY labeler)
  SELECT t.labeler, n_runs, n_failures, tp, fp, fn, tn, {_PRF}, round(iv.lower, 9) AS f1_lower, round(iv.upper, 9) AS f1_upper
  FROM t JOIN iv USING (labeler)""")
def baseline_total(s: SparkSession, d: str) -> DataFrame:
    """Scores over all runs of each labeler, with the F1 interval over resampled runs."""
    out = scoring.baseline_total(scoring.baseline_runs(_scored(s, d)), ["labeler"], resamples=stats.RESAMPLES, undefined="null")
    return _null(out, "f1_lower", "f1_upper").withColumns({c: F.round(c, 9) for c in ("f1_lower", "f1_upper")})


@_query()
def baseline_loose_fingerprint(s: SparkSession, d: str) -> DataFrame:
    """The same with groups of equal loose fingerprints."""
    f = _derived(s, d, hashing.with_fingerprint, "loose_hash")
    rows = scoring.scored(f, _labels(s, d), scoring.by_column("loose_hash"))
    return scoring.baseline_total(scoring.baseline_runs(rows), ["labeler"], resamples=stats.RESAMPLES, undefined="null")


@_query(f"""{_SCORED.replace("l.grp AS truth", "l.grp AS truth, coalesce(f.producerAdapter, 'none') AS stratum")},
  kept AS (SELECT * FROM scored WHERE (labeler, corpusRunId) IN (SELECT (labeler, corpusRunId) FROM scored GROUP BY labeler, corpusRunId HAVING count(*) >= 2)),
  {_counts_sql('kept', 'labeler, stratum, corpusRunId', 'predicted', 'truth')},
  st AS (SELECT labeler, stratum, sum(n)::BIGINT AS n_failures, count_if(n >= 2)::BIGINT AS n_runs, sum(CASE WHEN n >= 2 THEN tp ELSE 0 END)::BIGINT AS tp,
    sum(CASE WHEN n >= 2 THEN fp ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN n >= 2 THEN fn ELSE 0 END)::BIGINT AS fn,
    sum(CASE WHEN n >= 2 THEN tn ELSE 0 END)::BIGINT AS tn FROM pc GROUP BY labeler, stratum)
  SELECT *, {_PRF} FROM st WHERE n_runs > 0""")
def baseline_by_adapter(s: SparkSession, d: str) -> DataFrame:
    """Scores within strata: both members of a pair come from one producing adapter."""
    f = _failures(s, d, "errorType", "producerAdapter")
    rows = scoring.scored(f, _labels(s, d), scoring.same_error_type).join(f.select("corpusRunId", "failureId", F.coalesce("producerAdapter", F.lit("none")).alias("stratum")), ["corpusRunId", "failureId"])
    return scoring.strata(rows, "stratum", undefined="null")


def _detect_sql() -> str:
    """The detection chain with ASCII word boundaries for the look-arounds RE2 lacks."""
    from faultline.functions.frames import DETECTION

    subject = {"stack": "coalesce(stackText, '')", "type": "coalesce(errorType, '')", "all": "coalesce(sourceFile, '') || chr(10) || coalesce(stackText, '') || chr(10) || coalesce(errorType, '')"}
    cases = []
    for name, where, p in DETECTION:
        p = p.replace(r"(?<!\w)", r"\b").replace(r"(?!\w)", r"\b").replace("'", "''")
        cases.append(f"WHEN regexp_matches({subject[where]}, '{p}') THEN '{name}'")
    return "CASE " + " ".join(cases) + " ELSE 'unknown' END"


def _strata_sql(stratum: str) -> str:
    return f"""
  kept AS (SELECT * FROM scored WHERE (labeler, corpusRunId) IN (SELECT (labeler, corpusRunId) FROM scored GROUP BY labeler, corpusRunId HAVING count(*) >= 2)),
  {_counts_sql('kept', f'labeler, {stratum}, corpusRunId', 'predicted', 'truth')},
  st AS (SELECT labeler, {stratum}, sum(n)::BIGINT AS n_failures, count_if(n >= 2)::BIGINT AS n_runs, sum(CASE WHEN n >= 2 THEN tp ELSE 0 END)::BIGINT AS tp,
    sum(CASE WHEN n >= 2 THEN fp ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN n >= 2 THEN fn ELSE 0 END)::BIGINT AS fn,
    sum(CASE WHEN n >= 2 THEN tn ELSE 0 END)::BIGINT AS tn FROM pc GROUP BY labeler, {stratum})
  SELECT *, {_PRF} FROM st WHERE n_runs > 0"""


@_query(f"""{_SCORED.replace("l.grp AS truth", f"l.grp AS truth, {_detect_sql()} AS framework")}, {_strata_sql('framework')}""")
def baseline_by_framework(s: SparkSession, d: str) -> DataFrame:
    f = _derived(s, d, lambda x: x.withColumn("framework", detect_framework()), "errorType", "framework")
    rows = scoring.scored(f, _labels(s, d), scoring.same_error_type).join(f.select("corpusRunId", "failureId", "framework"), ["corpusRunId", "failureId"])
    return scoring.strata(rows, "framework", undefined="null")


@_query(f"""{_SCORED}, {_RUNS}, scored_ AS (SELECT s.*, coalesce(r.source.repo, '?') AS repo FROM scored s JOIN runs_ r USING (corpusRunId)),
  {_strata_sql('repo').replace('FROM scored ', 'FROM scored_ ')}""")
def baseline_by_repository(s: SparkSession, d: str) -> DataFrame:
    """Scores within the runs of each repository."""
    repo = _runs(s, d).select("corpusRunId", F.coalesce("source.repo", F.lit("?")).alias("repo"))
    return scoring.strata(_scored(s, d).join(repo, "corpusRunId"), "repo", undefined="null")


@_query(f"""{_SCORED.replace("l.grp AS truth", "l.grp AS truth, coalesce(f.producerAdapter, 'none') AS stratum")},
  cell AS (SELECT labeler, corpusRunId, stratum, count(*) AS n FROM scored GROUP BY ALL),
  run AS (SELECT labeler, corpusRunId, sum(n) AS m, sum(n * (n - 1) // 2) AS own FROM cell GROUP BY ALL HAVING sum(n) >= 2)
  SELECT labeler, sum(m * (m - 1) // 2 - own)::BIGINT AS cross_pairs FROM run GROUP BY labeler""")
def cross_adapter_pairs(s: SparkSession, d: str) -> DataFrame:
    """Pairs of one run whose members come from different adapters, counted without making them."""
    f = _failures(s, d, "errorType", "producerAdapter")
    rows = scoring.scored(f, _labels(s, d), scoring.same_error_type).join(f.select("corpusRunId", "failureId", F.coalesce("producerAdapter", F.lit("none")).alias("stratum")), ["corpusRunId", "failureId"])
    return scoring.cross_pairs(rows, "stratum")


@_query(f"""{_SCORED}, {_RUNS}, n AS (SELECT labeler, corpusRunId, count(*) AS n FROM scored GROUP BY ALL),
  seen AS (SELECT DISTINCT l.labeler, l.corpusRunId FROM labels_ l JOIN runs_ r USING (corpusRunId)),
  few AS (SELECT seen.labeler, regexp_replace('only ' || coalesce(n, 0) || ' labelled failure(s); a run needs 2 to contribute a pair', '[0-9]+', 'N', 'g') AS reason,
    count(*)::BIGINT AS n_runs FROM seen LEFT JOIN n USING (labeler, corpusRunId) WHERE coalesce(n, 0) < 2 GROUP BY ALL),
  none AS (SELECT labeler, 'no labels' AS reason, ((SELECT count(*) FROM runs_) - coalesce(h, 0))::BIGINT AS n_runs FROM (SELECT DISTINCT labeler FROM labels_)
    LEFT JOIN (SELECT labeler, count(*) AS h FROM seen GROUP BY labeler) USING (labeler))
  SELECT * FROM few UNION ALL SELECT * FROM none WHERE n_runs > 0""")
def exclusion_reasons(s: SparkSession, d: str) -> DataFrame:
    return scoring.exclusions(_runs(s, d).select("corpusRunId"), _scored(s, d), _labels(s, d))


@_query(f"""WITH {_FAILURES}, {_LABELS} SELECT f.corpusRunId, count(*)::BIGINT AS n_unlabelled FROM failures_ f
  WHERE NOT EXISTS (SELECT 1 FROM labels_ l WHERE l.corpusRunId = f.corpusRunId AND l.failureId = f.failureId) GROUP BY f.corpusRunId""")
def unlabelled_failures(s: SparkSession, d: str) -> DataFrame:
    """Stored failures nobody labelled, per run."""
    j = _failures(s, d, "rowId").join(_labels(s, d).select("corpusRunId", "failureId"), ["corpusRunId", "failureId"], "left_anti")
    return j.groupBy("corpusRunId").agg(F.count(F.lit(1)).alias("n_unlabelled"))


# ---- agreement -----------------------------------------------------------------------------------


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return scoring.labeler_pairs(_labels(s, d), _failures(s, d, "rowId"))


_WITH_PAIRS = f"WITH {_FAILURES}, {_LABELS}, {_PAIRS}"


@_query(f"""{_WITH_PAIRS}, n AS (SELECT labeler_a, labeler_b, count(*)::BIGINT AS n, count_if(cat_a = cat_b)::BIGINT AS agreed FROM pairs GROUP BY ALL),
  ma AS (SELECT labeler_a, labeler_b, cat_a AS c, count(*) AS k FROM pairs GROUP BY ALL), mb AS (SELECT labeler_a, labeler_b, cat_b AS c, count(*) AS k FROM pairs GROUP BY ALL),
  ch AS (SELECT labeler_a, labeler_b, sum(ma.k * mb.k) AS ab FROM ma JOIN mb USING (labeler_a, labeler_b, c) GROUP BY ALL)
  SELECT labeler_a, labeler_b, n, agreed, agreed / n AS po, coalesce(ab, 0) / (n * n) AS pe,
    CASE WHEN coalesce(ab, 0) = n * n THEN 1.0 ELSE (agreed * n - coalesce(ab, 0)) / nullif(n * n - coalesce(ab, 0), 0)::DOUBLE END AS kappa
  FROM n LEFT JOIN ch USING (labeler_a, labeler_b)""")
def cohens_kappa(s: SparkSession, d: str) -> DataFrame:
    """Kappa of every two people over the failures both labelled."""
    return scoring.kappa(_pairs(s, d), undefined="null")


@_query(f"""{_WITH_PAIRS}, x AS (SELECT labeler_a, labeler_b, cat_a AS category, 1 AS a, 0 AS b, (cat_a = cat_b)::INT AS e FROM pairs
  UNION ALL SELECT labeler_a, labeler_b, cat_b, 0, 1, (cat_a = cat_b)::INT FROM pairs)
  SELECT labeler_a, labeler_b, category, sum(a)::BIGINT AS n_a, sum(b)::BIGINT AS n_b, sum(a * e)::BIGINT AS n_agreed FROM x GROUP BY ALL""")
def kappa_per_category(s: SparkSession, d: str) -> DataFrame:
    return scoring.kappa_categories(_pairs(s, d))


@_query(f"""{_WITH_PAIRS}, {_counts_sql('pairs', 'labeler_a, labeler_b, corpusRunId', 'grp_a', 'grp_b')},
  per AS (SELECT labeler_a, labeler_b, corpusRunId, tp + tn AS alike, n * (n - 1) // 2 AS total FROM pc WHERE n >= 2),
  {_boot_sql('per', 'labeler_a, labeler_b', 'corpusRunId', ['alike', 'total'], 'alike / nullif(total, 0)::DOUBLE', RESAMPLES, stats.SEED)},
  t AS (SELECT labeler_a, labeler_b, count(*)::BIGINT AS n_runs, sum(alike)::BIGINT AS alike, sum(total)::BIGINT AS n_pairs FROM per GROUP BY ALL)
  SELECT labeler_a, labeler_b, n_runs, t.alike, n_pairs, round(point, 9) AS point, round(lower, 9) AS lower, round(upper, 9) AS upper
  FROM t JOIN iv USING (labeler_a, labeler_b)""")
def grouping_agreement(s: SparkSession, d: str) -> DataFrame:
    """How alike every two people group the failures of a run, with the interval over resampled runs."""
    out = scoring.grouping_agreement(_pairs(s, d), resamples=stats.RESAMPLES)
    return _null(out, "point", "lower", "upper").withColumns({c: F.round(c, 9) for c in ("point", "lower", "upper")})


@_query(f"""{_WITH_PAIRS}, per AS (SELECT labeler_a, labeler_b, corpusRunId, count_if(cat_a = cat_b) AS agreed, count(*) AS total FROM pairs GROUP BY ALL),
  {_boot_sql('per', 'labeler_a, labeler_b', 'corpusRunId', ['agreed', 'total'], 'agreed / nullif(total, 0)::DOUBLE', RESAMPLES, stats.SEED)}
  SELECT labeler_a, labeler_b, n, round(point, 9) AS point, round(lower, 9) AS lower, round(upper, 9) AS upper FROM iv""")
def category_agreement(s: SparkSession, d: str) -> DataFrame:
    out = scoring.category_agreement(_pairs(s, d), resamples=stats.RESAMPLES)
    return _null(out, "point", "lower", "upper").withColumns({c: F.round(c, 9) for c in ("point", "lower", "upper")})


_CONTEXT_DOCS = _DOCS.replace("PARTITION BY lower(trim(labeler)), corpusRunId ORDER", "PARTITION BY lower(trim(labeler)), corpusRunId, context ORDER")


@_query(f"""WITH {_LABELS.replace(_DOCS, _CONTEXT_DOCS)},
  h AS (SELECT * FROM labels_ WHERE NOT starts_with(labeler, 'machine:'))
  SELECT f.labeler AS labeler_a, p.labeler AS labeler_b, f.category, count(*)::BIGINT AS n, count_if(f.category = p.category)::BIGINT AS agreed
  FROM h f JOIN h p ON f.corpusRunId = p.corpusRunId AND f.failureId = p.failureId AND f.context = 'full' AND p.context = 'payload-only' AND f.labeler <> p.labeler
  GROUP BY ALL""")
def separability_by_category(s: SparkSession, d: str) -> DataFrame:
    """Full-context labels beside other people's payload-only ones, by the full label's category."""
    h = _labels(s, d, "labeler", "corpusRunId", "context").where(~corpus.is_machine())
    j = scoring.aligned(h.where("context = 'full'"), h.where("context = 'payload-only'")).where("labeler_a <> labeler_b")
    return j.groupBy("labeler_a", "labeler_b", F.col("cat_a").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cat_a") == F.col("cat_b")).alias("agreed"))


@_query(f"""WITH {_LABELS} SELECT labeler, count(DISTINCT corpusRunId)::BIGINT AS n_runs, count(*)::BIGINT AS n_failures, count(DISTINCT context)::BIGINT AS n_contexts,
  count(DISTINCT category)::BIGINT AS n_categories, starts_with(labeler, 'machine:') AS is_machine FROM labels_ GROUP BY labeler""")
def labeler_summary(s: SparkSession, d: str) -> DataFrame:
    rows = _labels(s, d).groupBy("labeler").agg(
        F.count_distinct("corpusRunId").alias("n_runs"), F.count(F.lit(1)).alias("n_failures"), F.count_distinct("context").alias("n_contexts"), F.count_distinct("category").alias("n_categories")
    )
    return rows.withColumn("is_machine", corpus.is_machine())


@_query(f"""WITH {_LABELS} SELECT labeler, category, count(*)::BIGINT AS n FROM labels_ GROUP BY ALL""")
def labeler_categories(s: SparkSession, d: str) -> DataFrame:
    return _labels(s, d).groupBy("labeler", "category").agg(F.count(F.lit(1)).alias("n"))


# ---- corpus --------------------------------------------------------------------------------------


def _per_run(s: SparkSession, d: str) -> DataFrame:
    n = _failures(s, d, "rowId").groupBy("corpusRunId").agg(F.count(F.lit(1)).alias("n"))
    runs = corpus.committable(_runs(s, d)).select("corpusRunId", F.coalesce("source.repo", F.lit("?")).alias("repo"))
    return runs.join(n, "corpusRunId", "left").select("corpusRunId", "repo", F.coalesce("n", F.lit(0)).alias("n"))


_SPDX = "regexp_matches(source.licenseSpdx, '(?i)^(A?GPL|LGPL|GPL|EUPL|OSL|CECILL|SSPL|CPAL)(-|$)')"
_HELD = f"CASE WHEN source.licenseSpdx IS NULL OR source.licenseSpdx = 'NOASSERTION' THEN 'unidentified' WHEN {_SPDX} THEN 'copyleft' END"
_RUN_SIZES = f"""WITH {_RUNS}, {_FAILURES}, per AS (SELECT r.corpusRunId, coalesce(r.source.repo, '?') AS repo, coalesce(n, 0) AS n FROM runs_ r
  LEFT JOIN (SELECT corpusRunId, count(*) AS n FROM failures_ GROUP BY ALL) USING (corpusRunId) WHERE {_HELD} IS NULL)"""


@_query(f"""{_RUN_SIZES}, t AS (SELECT sum(n) AS t, max(n) AS m FROM per), r AS (SELECT repo, sum(n) AS n FROM per GROUP BY repo ORDER BY n DESC, repo LIMIT 3)
  SELECT m / t AS top_run_share, (SELECT max(n) FROM r) / t AS top_repo_share, (SELECT sum(n) FROM r) / t AS top3_repo_share,
    (SELECT count_if(n > 200) FROM per)::BIGINT AS runs_over_200, (SELECT n FROM (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i FROM per)
      WHERE i = (SELECT count(*) FROM per) // 2)::BIGINT AS median_failures_per_run,
    (SELECT count_if(n BETWEEN 5 AND 24) FROM per)::BIGINT AS runs_in_band, (SELECT count_if(n >= 2) FROM per)::BIGINT AS runs_with_pairs FROM t""")
def concentration(s: SparkSession, d: str) -> DataFrame:
    return scoring.concentration(_per_run(s, d))


@_query(f"""{_RUN_SIZES} SELECT b.band, count(per.n)::BIGINT AS n_runs, coalesce(sum(per.n), 0)::BIGINT AS n_failures FROM (VALUES ('1'), ('2-4'), ('5-24'), ('25-99'), ('100+')) b(band)
  LEFT JOIN per ON b.band = CASE WHEN n = 1 THEN '1' WHEN n < 5 THEN '2-4' WHEN n < 25 THEN '5-24' WHEN n < 100 THEN '25-99' ELSE '100+' END GROUP BY b.band""")
def size_bands(s: SparkSession, d: str) -> DataFrame:
    """Committable runs by number of failures; empty bands stay."""
    n = _per_run(s, d).groupBy(corpus.size_band(F.col("n")).alias("band")).agg(F.count(F.lit(1)).alias("n_runs"), F.sum("n").alias("n_failures"))
    bands = s.createDataFrame([(b,) for b in corpus.BANDS], "band string")
    return bands.join(n, "band", "left").select("band", F.coalesce("n_runs", F.lit(0)).alias("n_runs"), F.coalesce("n_failures", F.lit(0)).alias("n_failures"))


@_query(f"""WITH {_RUNS}, x AS (SELECT *, {_HELD} AS kind FROM runs_) SELECT coalesce(source.repo, '?') AS repo, kind, count(*)::BIGINT AS n_runs,
  sum(counts.failures)::BIGINT AS n_failures FROM x WHERE kind IS NOT NULL GROUP BY ALL""")
def held_out(s: SparkSession, d: str) -> DataFrame:
    """Runs whose licence keeps them out, by repository and reason."""
    x = _runs(s, d).withColumn("kind", corpus.hold_out_reason(F.col("source.licenseSpdx"))).where("kind is not null")
    return x.groupBy(F.coalesce("source.repo", F.lit("?")).alias("repo"), "kind").agg(F.count(F.lit(1)).alias("n_runs"), F.sum("counts.failures").alias("n_failures"))


@_query(f"WITH {_RUNS} SELECT coalesce(fidelity, 'none') AS fidelity, count(*)::BIGINT AS n_runs FROM runs_ GROUP BY ALL")
def fidelity_breakdown(s: SparkSession, d: str) -> DataFrame:
    return _runs(s, d).groupBy(F.coalesce("fidelity", F.lit("none")).alias("fidelity")).agg(F.count(F.lit(1)).alias("n_runs"))


@_query(f"WITH {_RUNS} SELECT w.code, sum(w.count)::BIGINT AS n, count(*)::BIGINT AS n_runs FROM (SELECT unnest(warnings) AS w FROM runs_) GROUP BY w.code")
def warning_codes(s: SparkSession, d: str) -> DataFrame:
    w = _runs(s, d).select(F.explode("warnings").alias("w"))
    return w.groupBy("w.code").agg(F.sum("w.count").alias("n"), F.count(F.lit(1)).alias("n_runs"))


@_query(f"""WITH {_RUNS}, {_FAILURES}, n AS (SELECT corpusRunId, count(*) AS n FROM failures_ GROUP BY ALL)
  SELECT r.corpusRunId, r.counts.failures AS counted, coalesce(n, 0)::BIGINT AS stored FROM runs_ r LEFT JOIN n USING (corpusRunId) WHERE r.counts.failures <> coalesce(n, 0)""")
def count_mismatches(s: SparkSession, d: str) -> DataFrame:
    """Runs whose own count disagrees with the failures stored."""
    n = _failures(s, d, "rowId").groupBy("corpusRunId").agg(F.count(F.lit(1)).alias("n"))
    j = _runs(s, d).select("corpusRunId", F.col("counts.failures").alias("counted")).join(n, "corpusRunId", "left")
    return j.select("corpusRunId", "counted", F.coalesce("n", F.lit(0)).alias("stored")).where("counted <> stored")


@_query(f"""WITH {_FAILURES}, n AS (SELECT corpusRunId, coalesce(errorType, '') AS errorType, count(*) AS n FROM failures_ GROUP BY ALL)
  SELECT corpusRunId, errorType, n::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY corpusRunId ORDER BY n DESC, errorType) AS k FROM n) WHERE k = 1""")
def dominant_error_type(s: SparkSession, d: str) -> DataFrame:
    """The most frequent error type of each run, ties to the smallest."""
    n = _failures(s, d, "errorType").groupBy("corpusRunId", F.coalesce("errorType", F.lit("")).alias("errorType")).agg(F.count(F.lit(1)).alias("n"))
    return scoring.dominant(n, "corpusRunId", "errorType", "n")


@_query(f"""WITH {_RUNS} SELECT coalesce(source.repo, '?') AS repo, substr(sha256(string_agg(corpusRunId || chr(10), '' ORDER BY corpusRunId)), 1, 12) AS digest,
  count(*)::BIGINT AS n_ids FROM runs_ GROUP BY ALL""")
def run_digests(s: SparkSession, d: str) -> DataFrame:
    """Order-independent digest of each repository's runs."""
    return scoring.digest(_runs(s, d).select("corpusRunId", F.coalesce("source.repo", F.lit("?")).alias("repo")), ["repo"], "corpusRunId")


@_query(f"""WITH {_FAILURES}, {_LABELS}, c AS (SELECT coalesce(producerAdapter, 'none') AS adapter, count(*) AS n FROM failures_ GROUP BY ALL),
  l AS (SELECT coalesce(producerAdapter, 'none') AS adapter, count(*) AS n FROM failures_ f WHERE EXISTS (SELECT 1 FROM labels_ l WHERE l.corpusRunId = f.corpusRunId
    AND l.failureId = f.failureId) GROUP BY ALL)
  SELECT c.adapter, c.n / (SELECT sum(n) FROM c) AS corpus_share, coalesce(l.n / (SELECT sum(n) FROM l), 0) AS sample_share,
    c.n / (SELECT sum(n) FROM c) >= 0.02 AND coalesce(l.n / (SELECT sum(n) FROM l), 0) < c.n / (SELECT sum(n) FROM c) / 3 AS is_gap FROM c LEFT JOIN l USING (adapter)""")
def coverage_gaps(s: SparkSession, d: str) -> DataFrame:
    """Mix of the corpus beside that of the labelled part, by adapter."""
    f = _failures(s, d, "producerAdapter").select("corpusRunId", "failureId", F.coalesce("producerAdapter", F.lit("none")).alias("adapter"))
    n = lambda x: x.groupBy("adapter").agg(F.count(F.lit(1)).alias("n"))
    return scoring.mix_gaps(n(f), n(f.join(_labels(s, d).select("corpusRunId", "failureId"), ["corpusRunId", "failureId"], "left_semi")), "adapter")


@_query(f"""{_RUN_SIZES}, {_LABELS}, hl AS (SELECT * FROM labels_ WHERE NOT starts_with(labeler, 'machine:')),
  k AS (SELECT category, count(DISTINCT corpusRunId || '#' || failureId) AS n FROM hl GROUP BY category),
  kept AS (SELECT * FROM runs_ WHERE {_HELD} IS NULL), fk AS (SELECT {_detect_sql()} AS k, producerAdapter FROM failures_ WHERE corpusRunId IN (SELECT corpusRunId FROM kept)),
  fw AS (SELECT CASE WHEN k <> 'unknown' THEN k WHEN producerAdapter = 'playwright' THEN 'playwright' ELSE 'unidentified' END AS k FROM fk)
  SELECT 'runs' AS id, (SELECT count(*) FROM per)::DOUBLE AS observed, 80::DOUBLE AS required, (SELECT count(*) FROM per) >= 80 AS met
  UNION ALL SELECT 'multi-failure-runs', (SELECT count_if(n >= 5) FROM per), 50, (SELECT count_if(n >= 5) FROM per) >= 50
  UNION ALL SELECT 'failures', (SELECT count(DISTINCT corpusRunId || '#' || failureId) FROM hl), 1000, (SELECT count(DISTINCT corpusRunId || '#' || failureId) FROM hl) >= 1000
  UNION ALL SELECT 'repositories', (SELECT count(DISTINCT repo) FROM per), 10, (SELECT count(DISTINCT repo) FROM per) >= 10
  UNION ALL SELECT 'labelers', (SELECT count(DISTINCT labeler) FROM hl), 2, (SELECT count(DISTINCT labeler) FROM hl) >= 2
  UNION ALL SELECT 'frameworks', (SELECT count(DISTINCT k) FROM fw WHERE k <> 'unidentified'), 3, (SELECT count(DISTINCT k) FROM fw WHERE k <> 'unidentified') >= 3
  UNION ALL SELECT 'synthetic-cap', (SELECT round(100.0 * count_if(fidelity = 'synthetic') / count(*), 1) FROM kept), 20, (SELECT count_if(fidelity = 'synthetic') / count(*) <= 0.2 FROM kept)
  UNION ALL SELECT 'category:' || category, n, 30, n >= 30 FROM k""")
def gate_counts(s: SparkSession, d: str) -> DataFrame:
    """The counted requirements, machine labels left out; a category's floor counts distinct failures."""
    flags = _derived(s, d, lambda x: x.withColumn("framework", framework_or_adapter(detect_framework())), "framework")
    out = gates.counted(gates.sizes(_runs(s, d), _failures(s, d, "rowId")), flags, _labels(s, d))
    return out.select("id", "observed", "required", "met")


def _agreement_sql(pairs: str, sums: list[str], per: str, stat: str) -> str:
    return f"""WITH {_FAILURES}, {pairs}, {per}, {_boot_sql('per', 'labeler_a, labeler_b', 'corpusRunId', sums, stat, RESAMPLES, stats.SEED)}
      SELECT labeler_a || ' vs ' || labeler_b AS pair, round(lower, 9) AS lower FROM iv WHERE lower IS NOT NULL"""


_GROUPING = _agreement_sql(
    f"{_LABELS}, {_PAIRS}, {_counts_sql('pairs', 'labeler_a, labeler_b, corpusRunId', 'grp_a', 'grp_b')}", ["alike", "total"],
    "per AS (SELECT labeler_a, labeler_b, corpusRunId, tp + tn AS alike, n * (n - 1) // 2 AS total FROM pc WHERE n >= 2)", "alike / nullif(total, 0)::DOUBLE",
)
_SEPARABLE = _agreement_sql(
    f"""{_LABELS}, h AS (SELECT * FROM labels_ WHERE NOT starts_with(labeler, 'machine:')), one AS (SELECT labeler, min(context) AS c FROM h GROUP BY labeler HAVING count(DISTINCT context) = 1),
    pairs AS (SELECT a.corpusRunId, a.labeler AS labeler_a, b.labeler AS labeler_b, a.category AS cat_a, b.category AS cat_b FROM h a JOIN h b
      ON a.corpusRunId = b.corpusRunId AND a.failureId = b.failureId WHERE a.labeler IN (SELECT labeler FROM one WHERE c = 'full') AND b.labeler IN (SELECT labeler FROM one WHERE c = 'payload-only'))""",
    ["agreed", "total"], "per AS (SELECT labeler_a, labeler_b, corpusRunId, count_if(cat_a = cat_b) AS agreed, count(*) AS total FROM pairs GROUP BY ALL)", "agreed / nullif(total, 0)::DOUBLE",
)


def _weakest_sql(id: str, rows: str, required: float) -> str:
    return f"""SELECT '{id}' AS id, min(lower) AS lower, (SELECT pair FROM ({rows}) ORDER BY lower, pair LIMIT 1) AS pair, {required}::DOUBLE AS required,
      coalesce(min(lower) >= {required}, false) AS met FROM ({rows})"""


@_query(f"{_weakest_sql('grouping-agreement', _GROUPING, 0.8)} UNION ALL {_weakest_sql('separability', _SEPARABLE, 0.6)}")
def gate_measured(s: SparkSession, d: str) -> DataFrame:
    """The weakest pair's lower bounds of grouping agreement and of separability; an unmeasured gate is unmet."""
    return gates.measured(_pairs(s, d), scoring.separability_pairs(_labels(s, d)), resamples=stats.RESAMPLES)


@_query(f"""WITH {_FAILURES}, x AS (SELECT corpusRunId, sourceFile, suitePath, displayName, attemptIndex, failureId,
    row_number() OVER (PARTITION BY corpusRunId, sourceFile, suitePath, displayName ORDER BY attemptIndex, failureId) - 1 AS ordinal,
    count(*) OVER (PARTITION BY corpusRunId, sourceFile, suitePath, displayName) AS of FROM failures_)
  SELECT corpusRunId, failureId, ordinal::INT AS ordinal, ordinal = of - 1 AS is_last FROM x""")
def attempt_ordinals(s: SparkSession, d: str) -> DataFrame:
    """Attempts of one test within a file, numbered on; only the last would carry a duration."""
    f = _failures(s, d, "sourceFile", "suitePath", "displayName", "attemptIndex")
    w = Window.partitionBy("corpusRunId", "sourceFile", "suitePath", "displayName").orderBy("attemptIndex", "failureId")
    return f.select("corpusRunId", "failureId", (F.row_number().over(w) - 1).alias("ordinal"), F.lead("failureId").over(w).isNull().alias("is_last"))


# ---- texts and stacks ----------------------------------------------------------------------------


@_query(f"""WITH {_FAILURES} SELECT corpusRunId, failureId, regexp_replace(corpusRunId, '[^A-Za-z0-9._-]+', '_', 'g') AS dir FROM failures_""")
def path_safe_ids(s: SparkSession, d: str) -> DataFrame:
    return _failures(s, d, "rowId").select("corpusRunId", "failureId", text.path_safe("corpusRunId").alias("dir"))


@_query(r"""SELECT rowId, regexp_matches(stdout, '\r|\x1B(\[[0-9;:?]*[ -/]*[@-~]|\][^\x07\x1B]{0,512}(\x07|\x1B\\)|[@-Z\\-_])|[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]|[\x{061C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]')
  AS hazard FROM failures WHERE stdout IS NOT NULL""")
def terminal_hazards(s: SparkSession, d: str) -> DataFrame:
    """Output that could move a terminal's cursor or reorder its text."""
    return table(s, d, "failures").where("stdout is not null").select("rowId", text.has_terminal_hazard("stdout").alias("hazard"))


@_query(r"""SELECT rowId, regexp_replace(regexp_replace(regexp_replace(replace(replace(stdout, chr(13) || chr(10), chr(10)), chr(13), chr(65533)),
  '\x1B(\[[0-9;:?]*[ -/]*[@-~]|\][^\x07\x1B]{0,512}(\x07|\x1B\\)|[@-Z\\-_])', chr(65533), 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', chr(65533), 'g'),
  '[\x{061C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]', '<bidi>', 'g') AS clean FROM failures WHERE stdout IS NOT NULL""")
def terminal_sanitized(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "failures").where("stdout is not null").select("rowId", text.sanitize_terminal("stdout").alias("clean"))


_CUT = """CASE WHEN length(x) <= 1000 THEN x ELSE substr(x, 1, h) || chr(10) || chr(10) || '... [truncated, ' || (length(x) - b) || ' characters omitted] ...' ||
  chr(10) || chr(10) || right(x, b - h) END"""


@_query(f"""SELECT rowId, {_CUT} AS stack FROM (SELECT rowId, stackText AS x, b, b * 2 // 3 AS h FROM (SELECT rowId, stackText,
  1000 - length('... [truncated,  characters omitted] ...') - 4 - length(length(stackText)::VARCHAR) AS b FROM failures WHERE stackText IS NOT NULL))""")
def stacks_truncated(s: SparkSession, d: str) -> DataFrame:
    """Stacks capped at 1000 units: head, marker and tail within the cap."""
    f = table(s, d, "failures").where("stackText is not null")
    return f.select("rowId", text.truncate("stackText", 1000).alias("stack"))


_WS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


@_query(f"""SELECT rowId, split_part(replace(replace(trim(message, '{_WS}'), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10), 1) AS first_line
  FROM failures WHERE message IS NOT NULL""")
def first_lines(s: SparkSession, d: str) -> DataFrame:
    """First line of each message."""
    return table(s, d, "failures").where("message is not null").select("rowId", text.first_line("message").alias("first_line"))


@_query(f"SELECT {_detect_sql()} AS framework, count(*)::BIGINT AS n, count(DISTINCT corpusRunId)::BIGINT AS n_runs FROM failures GROUP BY 1")
def framework_mix(s: SparkSession, d: str) -> DataFrame:
    """Frameworks by the shape of stacks first and by names last."""
    f = spread(table(s, d, "failures").select("corpusRunId", "sourceFile", "stackText", "errorType")).select("corpusRunId", detect_framework().alias("framework"))
    return f.groupBy("framework").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("corpusRunId").alias("n_runs"))


def _frames_sql() -> str:
    """Per failure, whether any line is a frame and any is the application's: dialects in order, then the classes."""
    from faultline.functions import frames as f

    text = lambda p: p.replace("'", "''")
    kind = "CASE " + " ".join(f"WHEN regexp_matches(line, '{text(p)}') THEN '{n}'" for n, p in f.DIALECTS) + " END"

    def part(group: str) -> str:
        cases = []
        for n, p in f.DIALECTS:
            names = re.findall(r"\(\?P<(\w+)>", p)
            if group in names:
                cases.append(f"WHEN '{n}' THEN regexp_extract(line, '{text(p)}', [{', '.join(repr(x) for x in names)}]).{group}")
        return "CASE dialect " + " ".join(cases) + " ELSE '' END"

    dirs = "|".join(re.escape(d) for d in f.VENDOR_DIRS)
    framework = text(rf"(?:^|/)(?:{dirs})/|{f.RUNTIME}|(?i:{f.RUNNERS_ANY_CASE})|{f.RUNNERS}")
    test = text("|".join(f.glob_regex(g).replace(r"\Z", r"\z") for g in f.TEST_GLOBS))
    return f"""lines AS (SELECT rowId, unnest(regexp_split_to_array(stackText, '\\r\\n|\\r|\\n')) AS line FROM failures_ WHERE stackText IS NOT NULL),
  d AS (SELECT rowId, line, {kind} AS dialect FROM lines WHERE trim(line) <> ''),
  p AS (SELECT rowId, dialect, {part("file")} AS file, trim({part("fn")}) AS fn FROM d WHERE dialect IS NOT NULL),
  c AS (SELECT rowId, replace(file, '\\', '/') AS path, CASE WHEN fn = '<anonymous>' THEN '' ELSE regexp_replace(fn, '^(?:async|new)\\s+', '') END AS fn FROM p
    WHERE NOT (dialect = 'v8' AND file <> '' AND NOT regexp_matches(file, '[/\\\\.]'))),
  fr AS (SELECT rowId, count(*) AS n, count_if(path <> '' AND NOT regexp_matches(path, '{framework}') AND NOT (fn <> '' AND regexp_matches(fn, '{framework}'))
    AND NOT regexp_matches(path, '{test}')) AS app FROM c GROUP BY rowId)"""


_Z = "1.959963984540054"


@_query(f"""WITH {_FAILURES}, {_RUNS}, {_frames_sql()},
  x AS (SELECT f.rowId, coalesce(r.source.repo, '?') AS repo, coalesce(fr.n, 0) > 0 AS any_, coalesce(fr.app, 0) > 0 AS app_, {_detect_sql()} AS k, producerAdapter
    FROM failures_ f JOIN runs_ r USING (corpusRunId) LEFT JOIN fr ON fr.rowId = f.rowId),
  y AS (SELECT *, CASE WHEN k <> 'unknown' THEN k WHEN producerAdapter = 'playwright' THEN 'playwright' ELSE 'unidentified' END AS framework FROM x),
  per AS (SELECT framework, repo, count(*) AS n, count_if(any_) AS a, count_if(app_) AS p FROM y GROUP BY ALL),
  rows_ AS (SELECT framework, sum(n)::BIGINT AS failures, sum(a)::BIGINT AS with_any_frame, sum(p)::BIGINT AS with_app_frame, count(*)::BIGINT AS repositories,
      max(n) / sum(n) AS top_repo_share FROM per GROUP BY framework
    UNION ALL SELECT 'total', sum(n)::BIGINT, sum(a)::BIGINT, sum(p)::BIGINT, count(DISTINCT repo)::BIGINT, 0.0 FROM per),
  w AS (SELECT *, with_app_frame / failures AS q, {_Z}::DOUBLE * {_Z}::DOUBLE AS zz FROM rows_)
  SELECT framework, failures, with_any_frame, with_app_frame, repositories, round(top_repo_share, 9) AS top_repo_share, round(q, 9) AS rate,
    round(greatest(0, (q + zz / (2 * failures) - {_Z}::DOUBLE * sqrt(q * (1 - q) / failures + zz / (4 * failures * failures))) / (1 + zz / failures)), 9) AS lower,
    round(least(1, (q + zz / (2 * failures) + {_Z}::DOUBLE * sqrt(q * (1 - q) / failures + zz / (4 * failures * failures))) / (1 + zz / failures)), 9) AS upper FROM w""")
def frame_availability(s: SparkSession, d: str) -> DataFrame:
    """Per framework and in total: failures with any frame and with an application frame, with Wilson intervals."""
    runs = _runs(s, d).select("corpusRunId", F.coalesce("source.repo", F.lit("?")).alias("repo"))
    flags = _derived(s, d, lambda f: scoring.frame_flags(f, "rowId", "failureId"), "framework", "any", "app")
    out = scoring.frame_report(flags, runs)
    return out.withColumns({c: F.round(c, 9) for c in ("rate", "lower", "upper", "top_repo_share")})


@_query("""WITH u AS (SELECT failureId, count(*) AS n, count_if(stackText IS NULL) AS k FROM failures GROUP BY failureId), z AS (SELECT 1.959963984540054 AS z)
  SELECT failureId, n::BIGINT AS n, k::BIGINT AS k, round(k / n, 9) AS point,
    round(greatest(0, (k / n + z * z / (2 * n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) AS lower,
    round(least(1, (k / n + z * z / (2 * n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) AS upper FROM u, z""")
def wilson_without_stack(s: SparkSession, d: str) -> DataFrame:
    """Share of failures without a stack, per failure id, with its Wilson interval."""
    u = table(s, d, "failures").groupBy("failureId").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("stackText").isNull()).alias("k"))
    return u.select("failureId", "n", "k", *(F.round(c, 9).alias(k) for k, c in stats.wilson(F.col("k"), F.col("n")).items()))


@_query("""SELECT status, quantile_cont(durationMs, 0.5) AS p50, quantile_cont(durationMs, 0.9) AS p90 FROM failures WHERE durationMs IS NOT NULL GROUP BY status""")
def duration_quantiles(s: SparkSession, d: str) -> DataFrame:
    """Exact linear-interpolated quantiles."""
    f = table(s, d, "failures").where("durationMs is not null")
    return f.groupBy("status").agg(F.percentile("durationMs", F.lit(0.5)).alias("p50"), F.percentile("durationMs", F.lit(0.9)).alias("p90"))


@_query()
def normalized_groups(s: SparkSession, d: str) -> DataFrame:
    """Messages by their loose normal form, most frequent first."""
    m = spread(table(s, d, "failures").select("message"))
    return m.select(normalize("message", "loose").alias("normal")).groupBy("normal").agg(F.count(F.lit(1)).alias("n"))


#: Rules with conditions that RE2 has no words for; the others are checked against SQL.
_BEYOND_RE2 = ("port", "generated-email", "assertion-values", "assertion-literals")


def _plain_rules_sql(text: str, passes: int) -> str:
    """The other rules of loose mode, as nested replacements, once per pass."""
    from faultline.functions import normalize as n

    w = _WS.replace("\n", "")
    steps = (
        (n.ANSI, "", ""), (n.CONTROL, "", ""), (r"\r\n?", chr(10), ""), (n.SPACES, " ", ""), (n.UUID, "<id>", "i"), (n.ULID, "<id>", ""), (n.OBJECT_ID, "<id>", "i"), (n.LONG_HEX, "<id>", "i"),
        (n.HEX_ADDRESS, "<addr>", "i"), (n.ISO_TIME, "<ts>", ""), (n.EPOCH_MS, "<ts>", ""), (n.EPOCH_S, "<ts>", ""), (n.DURATION, "<dur>", "i"), (n.TEMP_PATH, "<tmp>", "i"),
        (n.HOME, "<home>", ""), (n.HOME_WINDOWS, "<home>", ""), (n.URL_QUERY, r"\1", "i"), (n.URL_NUMBER.replace(r"(?=/|\b)", r"\b"), r"\1/<n>", "i"), (n.IPV6, "<ip>", "i"), (n.IPV4, "<ip>", ""),
        (n.GENERATED_NAME, "<gen>", "i"), (n.COUNTER, "<n>", "i"), (n.LINE_COLUMN, r"\1", ""),
        (f"[{w}]+(\n|\\z)", r"\1", ""), (n.BLANK_LINES, chr(10) * 2, ""), (f"\\A[{_WS}]+|[{_WS}]+\\z", "", ""),
    )
    out = "t"
    for pattern, new, flags in steps:
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{new}', 'g{flags}')"
    rows = f"(SELECT rowId, {text} AS t FROM failures WHERE {text} IS NOT NULL)"
    for _ in range(passes):
        rows = f"(SELECT rowId, {out} AS t FROM {rows})"
    return f"SELECT rowId, t AS normal FROM {rows}"


@_query(_plain_rules_sql("message", 3))
def normalized_by_plain_rules(s: SparkSession, d: str) -> DataFrame:
    """Each message's loose form by the 22 rules that SQL can say as well, after three passes."""
    m = spread(table(s, d, "failures").where("message is not null").select("rowId", "message"))
    return m.select("rowId", normalize("message", "loose", disabled=_BEYOND_RE2, passes=3).alias("normal"))


@_query()
def fingerprint_groups(s: SparkSession, d: str) -> DataFrame:
    """Failures by strict and loose fingerprint."""
    f = hashing.with_fingerprint(spread(table(s, d, "failures").select("rowId", "errorType", "message", "stackText")))
    return f.groupBy("loose_hash").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("strict_hash").alias("n_strict"), F.count_if("frame_fallback").alias("n_fallback"), F.min("rowId").alias("first_row_id"))


def _units_sql(x: str) -> str:
    """Length in UTF-16 units: a character above U+FFFF counts twice."""
    return f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


@_query(f"""SELECT substr(sha256({_units_sql("coalesce(errorType, '')")} || chr(31) || coalesce(errorType, '') || chr(31) || {_units_sql("message")} || chr(31) || message), 1, 32) AS grp,
  count(*)::BIGINT AS n, min(rowId) AS first_row_id FROM failures WHERE message IS NOT NULL GROUP BY 1""")
def same_text_groups(s: SparkSession, d: str) -> DataFrame:
    """Failures of equal error type and message, by the length-framed hash of both."""
    f = table(s, d, "failures").where("message is not null")
    parts = F.array(F.coalesce("errorType", F.lit("")), "message")
    return f.groupBy(hashing.sha_128(hashing.framed(parts)).alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.min("rowId").alias("first_row_id"))


@_query()
def minhash_candidates(s: SparkSession, d: str) -> DataFrame:
    """Pairs of distinct normalised messages with an estimated similarity of 0.8 or more, by banded sketches, those
    of equal sketches included. A message goes by its first row; `minhash_members` has the others."""
    m = spread(table(s, d, "failures").select("message", "rowId")).select(normalize("message", "strict").alias("t"), "rowId").groupBy("t").agg(F.min("rowId").alias("id"))
    return hashing.lsh_candidates(written(m.select("id", "t")).withColumn("sig", hashing.minhash("t")), "id", "sig", 0.8, members=True, text="t")


@_query()
def minhash_members(s: SparkSession, d: str) -> DataFrame:
    """Every row with a message, and the first row of the same normalised message: the id in `minhash_candidates`."""
    m = written(spread(table(s, d, "failures").where("message is not null").select("rowId", "message")).select("rowId", F.sha2(normalize("message", "strict"), 256).alias("t")))
    return m.join(m.groupBy("t").agg(F.min("rowId").alias("id")), "t").select("rowId", "id")


@_query("""WITH p AS (SELECT p_partkey, p_name, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS next FROM part)
  SELECT p_partkey, CASE WHEN p_name = next THEN 1.0 ELSE 1 - levenshtein(p_name, next) / greatest(length(p_name), length(next)) END AS similarity FROM p WHERE next IS NOT NULL""")
def levenshtein_neighbours(s: SparkSession, d: str) -> DataFrame:
    """Edit similarity of each part's name and the next of its brand."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    p = table(s, d, "part").select("p_partkey", "p_name", F.lead("p_name").over(w).alias("next")).where("next is not null")
    return p.select("p_partkey", hashing.levenshtein_similarity(F.col("p_name"), F.col("next")).alias("similarity"))


@_query(f"""WITH k AS (SELECT unnest(range(1, 5001)) AS k), d0 AS (SELECT k, ((12648430::HUGEINT + k::HUGEINT * 1831565813) % 4294967296)::BIGINT AS a FROM k),
  d1 AS (SELECT k, (xor(a, a >> 15)::HUGEINT * (a | 1) % 4294967296)::BIGINT AS t FROM d0),
  d2 AS (SELECT k, xor(t, (t + (xor(t, t >> 7)::HUGEINT * (t | 61) % 4294967296)::BIGINT) % 4294967296) AS t FROM d1)
  SELECT k, xor(t, t >> 14) / 4294967296.0::DOUBLE AS u FROM d2""")
def generator_sequence(s: SparkSession, d: str) -> DataFrame:
    """The first numbers of the counter-based generator."""
    return s.range(1, 5001).select(F.col("id").alias("k"), stats.draw(F.col("id")).alias("u"))


# ---- selections ----------------------------------------------------------------------------------


@_query()
def labelling_sample(s: SparkSession, d: str) -> DataFrame:
    """A coverage-driven selection of runs for labelling."""
    f = _derived(s, d, lambda x: x.withColumn("framework", detect_framework()), "framework")
    return sampling.sample(_runs(s, d).select("corpusRunId", "source.repo"), f).selected


@_query(f"""WITH {_FAILURES}, e AS (SELECT digest, corpusRunId, failureIds FROM agreement_selection GROUP BY ALL)
  SELECT e.digest, e.corpusRunId, count(*)::BIGINT AS n_failures FROM e JOIN failures_ f ON e.corpusRunId = f.corpusRunId
    AND (e.failureIds IS NULL OR list_contains(e.failureIds, f.failureId)) GROUP BY ALL""")
def selected_failures(s: SparkSession, d: str) -> DataFrame:
    """Failures that a selection's entries name; no list means the whole run."""
    e = table(s, d, "agreement_selection").select("digest", "corpusRunId", "failureIds").distinct()
    return sampling.selected(e, _failures(s, d, "rowId")).groupBy("digest", "corpusRunId").agg(F.count(F.lit(1)).alias("n_failures"))


@_query(f"""WITH {_RUNS}, e AS (SELECT DISTINCT digest, corpusRunId FROM agreement_selection)
  SELECT digest, count(*)::BIGINT AS n_missing FROM e WHERE corpusRunId NOT IN (SELECT corpusRunId FROM runs_) GROUP BY digest""")
def selection_missing_runs(s: SparkSession, d: str) -> DataFrame:
    """Selections that name runs which are not stored."""
    e = table(s, d, "agreement_selection").select("digest", "corpusRunId").distinct()
    return e.join(table(s, d, "runs").select("corpusRunId"), "corpusRunId", "left_anti").groupBy("digest").agg(F.count(F.lit(1)).alias("n_missing"))


_VERSION = "schemaVersion IS NULL OR schemaVersion > 1 OR schemaVersion < 0"
_KINDS = ", ".join(f"'{c}'" for c in corpus.CATEGORIES)


@_query(f"""WITH run AS (SELECT coalesce(corpusRunId, '?') AS corpusRunId, unnest([
    CASE WHEN {_VERSION} THEN 'schema version cannot be read' END, CASE WHEN coalesce(trim(corpusRunId), '') = '' THEN 'corpusRunId is empty' END,
    CASE WHEN coalesce(trim(source.repo), '') = '' THEN 'source.repo is empty' END, CASE WHEN coalesce(trim(source.providerRunId), '') = '' THEN 'source.providerRunId is empty' END,
    CASE WHEN coalesce(fidelity NOT IN ('artifact', 'log-scrape', 'synthetic'), true) THEN 'fidelity is unknown' END]) AS problem FROM runs),
  f AS (SELECT corpusRunId, failureId, count(*) AS n, count_if(message IS NULL) AS m FROM failures GROUP BY ALL),
  own AS (SELECT coalesce(corpusRunId, '?') AS corpusRunId, unnest([CASE WHEN coalesce(trim(failureId), '') = '' THEN 'failureId is empty' END,
    CASE WHEN n > 1 THEN 'failureId is repeated' END, CASE WHEN m > 0 THEN 'message is missing' END]) AS problem FROM f),
  doc AS (SELECT coalesce(corpusRunId, '') AS corpusRunId, unnest([CASE WHEN {_VERSION} THEN 'schema version cannot be read' END,
    CASE WHEN coalesce(context NOT IN ('full', 'payload-only'), true) THEN 'context is unknown' END,
    CASE WHEN coalesce(cardinality(labels), 0) = 0 THEN 'no labels' END]) AS problem FROM run_labels),
  l AS (SELECT corpusRunId, e.key AS failureId, e.value AS v FROM (SELECT corpusRunId, unnest(map_entries(labels)) AS e FROM run_labels)),
  lab AS (SELECT coalesce(corpusRunId, '') AS corpusRunId, unnest([CASE WHEN coalesce(trim(v."group"), '') = '' THEN 'group is empty' END,
    CASE WHEN coalesce(v.category NOT IN ({_KINDS}), true) THEN 'category is unknown' END]) AS problem FROM l),
  lost AS (SELECT l.corpusRunId, 'failure is not in the run' AS problem FROM l WHERE corpusRunId IN (SELECT corpusRunId FROM f)
    AND NOT EXISTS (SELECT 1 FROM f WHERE f.corpusRunId = l.corpusRunId AND f.failureId = l.failureId)),
  x AS (FROM run UNION ALL FROM own UNION ALL FROM doc UNION ALL FROM lab UNION ALL FROM lost)
  SELECT corpusRunId, problem, count(*)::BIGINT AS n FROM x WHERE problem IS NOT NULL GROUP BY ALL""")
def validation_problems(s: SparkSession, d: str) -> DataFrame:
    """What validation would reject among the stored runs, failures and labels, by run."""
    f = table(s, d, "failures")
    own = corpus.run_problems(table(s, d, "runs"), f, by_run=True).select(F.col("id").alias("corpusRunId"), "problem")
    labels = corpus.label_problems(table(s, d, "run_labels"), f, keys=("corpusRunId",)).select(F.col("id").alias("corpusRunId"), "problem")
    return own.unionAll(labels).groupBy("corpusRunId", "problem").agg(F.count(F.lit(1)).alias("n"))


# ---- events (extension) --------------------------------------------------------------------------


@_query("""SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def hourly_events(s: SparkSession, d: str) -> DataFrame:
    w = table(s, d, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return w.select("event_type", F.col("w.start").alias("hour"), "n", "total")
