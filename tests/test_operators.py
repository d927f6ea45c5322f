"""Skew handling, validation, scoring, sampling, worksheets and streams on small tables."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from faultline.operators import corpus, sampling, scoring, skew
from faultline.streaming import ingest


def test_plan_balances_and_splits():
    counts = [("a", 5000), ("b", 3000), ("c", 1200)]
    plan = skew.pack(counts, 10_000, 8)
    loads = plan.loads(dict(counts))
    assert max(loads) <= 1.5 * 10_000 / 8 and len(plan.shards[0][1]) >= 8
    assert skew.pack([], 0, 4).shards == []


def skewed(spark):
    rows = [("hot" if i % 3 else f"k{i % 50}", i, i % 7) for i in range(3000)] + [(None, 9000 + i, 1) for i in range(5)]
    return spark.createDataFrame(rows, "key string, n long, `count` long")


def test_per_key_and_join_equal_the_plain_ones(spark):
    df = skewed(spark)
    plan = skew.plan_load(df, "key", 8)
    assert [k for k, _ in plan.shards] == ["hot"]
    got = skew.per_key(df, "key", [F.count(F.lit(1)).alias("c"), F.max("n").alias("m")], [F.sum("c").alias("c"), F.max("m").alias("m")], plan)
    want = df.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("m"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3), ("none", 4), (None, 5)], "key string, w int")
    for how in ("inner", "left"):
        a = skew.join(df, right, "key", plan, how=how).select("key", "n", "count", "w")
        b = df.join(right, "key", how).select("key", "n", "count", "w")
        assert Counter(map(tuple, a.collect())) == Counter(map(tuple, b.collect()))
    with pytest.raises(ValueError):
        skew.join(df, right, "key", plan, how="full")


def test_balanced_partitions_and_empty_tables(spark):
    df = skewed(spark)
    sizes = [len(p) for p in skew.balanced(df, "key", skew.plan_load(df, "key", 8)).rdd.glom().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8
    empty = df.limit(0)
    assert skew.heavy_keys(empty, "key", 0.05).count() == 0
    assert [r.key for r in skew.heavy_keys(df, "key", 0.05).collect()] == ["hot"]
    assert skew.join(empty, df.select("key"), "key").count() == 0


def run_row(id, repo="o/r", spdx="MIT", fidelity="artifact", version=1, provider_run="1"):
    return (version, id, ("gh", repo, provider_run, 1, spdx), fidelity)


RUN_SCHEMA = "schemaVersion int, corpusRunId string, source struct<provider string, repo string, providerRunId string, runAttempt int, licenseSpdx string>, fidelity string"


def test_validation_rejects(spark):
    good = spark.createDataFrame([run_row("a")], RUN_SCHEMA)
    f = spark.createDataFrame([("a", "f0001", "m")], "corpusRunId string, failureId string, message string")
    assert corpus.validate_runs(good, f) is good
    bad = spark.createDataFrame([run_row("b", version=3), run_row("", fidelity="x"), run_row("c", provider_run=" ")], RUN_SCHEMA)
    assert corpus.run_problems(bad).count() == 4
    twice = spark.createDataFrame([("a", "f0001", "m"), ("a", "f0001", None), ("a", "", "m")], f.schema)
    assert {r.problem for r in corpus.run_problems(good, twice).collect()} == {"failureId is repeated", "message is missing", "failureId is empty"}
    with pytest.raises(corpus.ValidationError, match="repeated"):
        corpus.validate_runs(good, twice)
    labels = spark.createDataFrame([(1, "a", "kim", "t", "full", {"f0001": ("g", "FLAKY", None), "f0009": ("", "NOPE", None)}), (1, "zz", "kim", "t", "other", {})],
        "schemaVersion int, corpusRunId string, labeler string, labeledAt string, context string, labels map<string,struct<group string, category string, note string>>")
    got = Counter(r.problem for r in corpus.label_problems(labels, f).collect())
    assert got == {"group is empty": 1, "category is unknown": 1, "failure is not in the run": 1, "context is unknown": 1, "no labels": 1}


def test_policies(spark):
    rows = [("MIT", None), (None, "unidentified"), ("NOASSERTION", "unidentified"), ("GPL-3.0", "copyleft"), ("agpl", "copyleft"), ("GPLX", None), ("LGPL-2.1", "copyleft")]
    df = spark.createDataFrame(rows, "s string, want string")
    assert all(r.got == r.want for r in df.select("want", corpus.hold_out_reason(F.col("s")).alias("got")).collect())
    assert spark.range(1).select(corpus.hold_out_reason(F.lit("MIT"), F.lit(1 << 30)).alias("x")).first().x == "oversized"
    bands = [r.b for r in spark.createDataFrame([(n,) for n in (0, 1, 4, 24, 25, 100)], "n int").select(corpus.size_band(F.col("n")).alias("b")).collect()]
    assert bands == ["2-4", "1", "2-4", "5-24", "25-99", "100+"]


def label(run, who, groups, cats=None, context="full"):
    return [(who, run, context, f"f{i:04d}", g, (cats or ["FLAKY"] * len(groups))[i]) for i, g in enumerate(groups)]


LABEL_SCHEMA = "labeler string, corpusRunId string, context string, failureId string, grp string, category string"


def test_agreement_of_two(spark):
    rows = label("r1", "a", ["g1", "g1", "g2"]) + label("r1", "b", ["h1", "h1", "h2"]) + label("r2", "a", ["g1", "g2"]) + label("r2", "b", ["h1", "h1"]) + label("r1", "machine:m", ["x", "x", "x"])
    p = scoring.labeler_pairs(spark.createDataFrame(rows, LABEL_SCHEMA))
    g = scoring.grouping_agreement(p, resamples=50).collect()
    assert len(g) == 1 and g[0].n_pairs == 4 and g[0].point == 0.75
    k = scoring.kappa(p).first()
    assert k.kappa == 1.0 and k.n == 5
    mixed = label("r1", "a", list("wxyz"), ["A", "B", "A", "C"]) + label("r1", "b", list("wxyz"), ["A", "B", "B", "C"])
    k = scoring.kappa(scoring.labeler_pairs(spark.createDataFrame(mixed, LABEL_SCHEMA))).first()
    assert k.po == 0.75 and k.kappa == pytest.approx((0.75 - 5 / 16) / (1 - 5 / 16))
    sep = spark.createDataFrame(label("r1", "a", ["g"] * 2) + label("r1", "p", ["g"] * 2, ["FLAKY", "UNKNOWN"], "payload-only"), LABEL_SCHEMA)
    assert scoring.category_agreement(scoring.separability_pairs(sep), 20).first().point == 0.5
    with pytest.raises(corpus.ValidationError):
        scoring.check_contexts(sep.where("labeler = 'a'"), sep.where("labeler = 'a'"))


def failures(spark, rows):
    return spark.createDataFrame([(r, f, "s.xml", e, m, None) for r, f, e, m in rows], "corpusRunId string, failureId string, sourceFile string, errorType string, message string, stackText string")


def test_baseline_by_hand(spark):
    f = failures(spark, [("r1", "f0000", "A", "x 1"), ("r1", "f0001", "A", "x 2"), ("r1", "f0002", "B", "y"), ("r2", "f0000", "A", "x")])
    lab = spark.createDataFrame(label("r1", "kim", ["g", "g", "h"]) + label("r2", "kim", ["g"]), LABEL_SCHEMA)
    rows = scoring.scored(f, lab, scoring.loose_fingerprint, by_framework=True)
    per = scoring.baseline_runs(rows).collect()
    assert len(per) == 1 and (per[0].tp, per[0].fp, per[0].fn, per[0].tn, per[0].f1) == (1, 0, 0, 2, 1.0)
    total = scoring.baseline_total(scoring.baseline_runs(rows), ["labeler"], resamples=20).first()
    assert total.f1 == 1.0 and math.isnan(total.f1_lower)
    assert scoring.cross_pairs(rows, "framework").first().cross_pairs == 0
    assert scoring.strata(rows, "framework").first().n_failures == 3
    runs = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "corpusRunId string")
    why = {r.reason: r.n_runs for r in scoring.exclusions(runs, rows, lab).collect()}
    assert why == {"no labels": 1, "only N labelled failure(s); a run needs N to contribute a pair": 1}
    assert scoring.baseline_runs(scoring.scored(f.limit(0), lab, scoring.same_text)).count() == 0


def test_concentration_and_mix(spark):
    per = spark.createDataFrame([("a", "x", 6), ("b", "x", 2), ("c", "y", 1), ("d", "z", 1)], "corpusRunId string, repo string, n long")
    c = scoring.concentration(per).first()
    assert (c.top_run_share, c.top_repo_share, c.top3_repo_share, c.median_failures_per_run, c.runs_in_band, c.runs_with_pairs) == (0.6, 0.8, 1.0, 2, 1, 2)
    n = lambda *r: spark.createDataFrame(r, "k string, n long")
    gaps = {r.k: r.is_gap for r in scoring.mix_gaps(n(("a", 90), ("b", 9), ("c", 1)), n(("a", 10)), "k").collect()}
    assert gaps == {"a": False, "b": True, "c": False}
    assert scoring.dominant(spark.createDataFrame([("r", "b", 2), ("r", "a", 2), ("r", "c", 1)], "r string, v string, n long"), "r", "v", "n").first().v == "a"


def corpus_of(spark, spec):
    runs = spark.createDataFrame([(r, repo) for r, repo, _ in spec], "corpusRunId string, repo string")
    f = spark.createDataFrame([(r, f"f{i:04d}", fw) for r, _, fws in spec for i, fw in enumerate(fws)], "corpusRunId string, failureId string, framework string")
    return runs, f


def test_sampling_policy(spark):
    spec = [(f"r{i}", f"o/r{i % 3}", ["jest"] * 6) for i in range(9)] + [("p", "o/p", ["pytest"] * 8), ("tiny", "o/t", ["jest"]), ("huge", "o/h", ["go"] * 60 + ["jest"] * 3)]
    runs, f = corpus_of(spark, spec)
    s = sampling.sample(runs, f, sampling.Policy(target_failures=40, max_runs_per_repo=2))
    ids = [r["corpusRunId"] for r in s.runs]
    assert "p" in ids and "tiny" not in ids and "huge" not in ids and s.excluded["too_small"] == 1 and s.excluded["too_large"] == 1
    assert max(Counter(r["repo"] for r in s.runs).values()) <= 2
    again = sampling.sample(runs, f, sampling.Policy(target_failures=40, max_runs_per_repo=2))
    assert ids == [r["corpusRunId"] for r in again.runs] and s.digest() == again.digest() and len(s.digest()) == 12
    sliced = sampling.sample(runs, f, sampling.Policy(target_failures=200, slice_large_runs=10))
    part = next(r for r in sliced.runs if r["corpusRunId"] == "huge")
    assert len(part["failureIds"]) == 10 and part["failureIds"] == sorted(part["failureIds"])
    assert sampling.total_pairs(s.selected).first().total_pairs == sum(r["n_failures"] * (r["n_failures"] - 1) // 2 for r in s.runs)
    assert sampling.sample(runs.limit(0), f.limit(0)).runs == []
    assert sampling.budget([("a", 5), ("b", 1), ("c", 4)], 6) == ["b", "c"]


def test_worksheet_round_trip(spark):
    cols = "corpusRunId string, failureId string, displayName string, suitePath array<string>, filePath string, status string, attemptIndex int, durationMs double, errorType string, message string, stackText string, stdout string"
    f = spark.createDataFrame([("r1", f"f000{i}", "t", ["a", "b"], None, "failed", 0, 1.0, None, f"m{i} o/shop", None, "out") for i in range(5)], cols)
    runs = spark.createDataFrame([("r1", ("o/shop", "w", "sha"))], "corpusRunId string, source struct<repo string, workflowName string, headSha string>")
    chosen = sampling.selected(spark.createDataFrame([("r1", None)], "corpusRunId string, failureIds array<string>"), f)
    sheet, key = sampling.worksheet(chosen, runs, "payload-only", "abc")
    assert sheet.count() == 5 and "repo" not in sheet.columns and sheet.first().suite == "a > b"
    assert [r.failureId for r in key.orderBy("entryId").collect()] == [k[1] for k in __import__("faultline.functions.stats", fromlist=["x"]).shuffled([("r1", f"f000{i}") for i in range(5)], __import__("faultline.functions.stats", fromlist=["x"]).seed_of("payload-only:abc"))]
    filled = sheet.withColumn("group", F.lit("g1")).withColumn("category", F.when(F.col("entryId") == "e0001", "flaky").otherwise("TEST_DEFECT"))
    doc = sampling.import_sheet(filled, "kim", "2031-01-01", "payload-only", key).first()
    assert len(doc.labels) == 5 and {v.category for v in doc.labels.values()} == {"FLAKY", "TEST_DEFECT"}
    with pytest.raises(corpus.ValidationError, match="go together"):
        sampling.import_sheet(filled.withColumn("category", F.lit("")), "kim", "t", "full", key)
    with pytest.raises(corpus.ValidationError, match="not in the key"):
        sampling.import_sheet(filled, "kim", "t", "full", key.where("entryId <> 'e0002'"))
    docs = spark.createDataFrame([("e0001", "g", "FLAKY", None), ("e9999", "g", "FLAKY", None)], "id string, group string, category string, note string")
    got, lost = sampling.import_ledger(docs, key, "kim", "t", "full")
    assert got.count() == 1 and [r.entryId for r in lost.collect()] == ["e9999"]
    assert sampling.leaks(sheet, ["o", "shop"]).first().n_leaking == 5


def test_idempotent_ingestion(spark, tmp_path):
    src, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "id string, n int"
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], schema).write.parquet(src)
    go = lambda c: ingest.ingest(spark.readStream.schema(schema).parquet(src), out, c, ["id"]).awaitTermination()
    go(cp)
    spark.createDataFrame([("b", 3), ("c", 4)], schema).write.mode("append").parquet(src)
    go(cp)
    go(str(tmp_path / "fresh"))  # a harvest that starts over stores nothing twice
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_windows_and_late_rows(spark):
    rows = spark.sql("select * from values (1, timestamp'2031-01-01 00:01:00', timestamp'2031-01-01 00:02:00'), (1, timestamp'2031-01-01 00:09:00', timestamp'2031-01-09 00:00:00'), (1, timestamp'2031-01-01 01:00:00', timestamp'2031-01-01 01:00:00') as t(u, ts, seen)")
    assert sorted(r.n for r in ingest.windowed(rows, "ts", "10 minutes", F.count(F.lit(1)).alias("n")).collect()) == [1, 2]
    assert sorted(r.n for r in ingest.sessions(rows, "ts", "30 minutes", F.count(F.lit(1)).alias("n"), by=["u"]).collect()) == [1, 2]
    assert ingest.late_rows(rows, "ts", "seen", "1 day").count() == 1


def test_minhash_keeps_equal_sketches(spark, tmp_path):
    """Texts of one set of shingles have one sketch; all their pairs and the rows of each text come back."""
    from faultline.plans import reference_queries as q

    one, two, three = "ab cd ef gh " * 8, "ab cd ef gh " * 9, "ab cd ef gh " * 10
    rows = [(1, one), (2, two), (3, one), (4, three), (5, "something else entirely that has no like among the rest"), (6, None)]
    spark.createDataFrame(rows, "rowId long, message string").write.parquet(f"{tmp_path}/failures.parquet")
    got = sorted((r.a, r.b, r.similarity) for r in q.minhash_candidates(spark, str(tmp_path)).collect())
    assert got == [(1, 2, 1.0), (1, 4, 1.0), (2, 4, 1.0)]
    assert dict(q.minhash_members(spark, str(tmp_path)).collect()) == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_first_lines_of_all_messages(spark, tmp_path):
    from faultline.plans import reference_queries as q

    odd = [0x0B, 0xA0, 0x1680, 0x2003, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
    texts = ["plain\nrest", *(f"{chr(c)} a{chr(c)}b {chr(c)}\r\nrest{chr(c)}" for c in odd)]
    spark.createDataFrame(list(enumerate([*texts, None])), "rowId long, message string").write.parquet(f"{tmp_path}/failures.parquet")
    space = "\t\n\x0b\f\r " + "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
    want = {i: t.strip(space).replace("\r\n", "\n").replace("\r", "\n").split("\n")[0] for i, t in enumerate(texts)}
    assert dict(q.first_lines(spark, str(tmp_path)).collect()) == want


def test_registered_intervals_use_all_resamples(spark, monkeypatch):
    from faultline.functions import stats
    from faultline.plans import reference_queries as q

    pairs = spark.createDataFrame([("a", "b", "r", "f", "X", "X", "g", "g")], "labeler_a string, labeler_b string, corpusRunId string, failureId string, cat_a string, cat_b string, grp_a string, grp_b string")
    seen, real = [], stats.bootstrap

    def spy(units, order, sums, statistic, by=None, resamples=stats.RESAMPLES, *rest, **named):
        seen.append(resamples)
        return real(units, order, sums, statistic, by, resamples, *rest, **named)

    monkeypatch.setattr(stats, "bootstrap", spy)
    scored = spark.createDataFrame([("a", "r", "f", "p", "t")], "labeler string, corpusRunId string, failureId string, predicted string, truth string")
    monkeypatch.setattr(q, "_pairs", lambda s, d: pairs)
    monkeypatch.setattr(q, "_scored", lambda s, d, *g: scored)
    monkeypatch.setattr(q, "_labels", lambda s, d, *k: None)
    monkeypatch.setattr(q, "_derived", lambda *a: None)
    monkeypatch.setattr(scoring, "scored", lambda *a, **k: scored)
    monkeypatch.setattr(scoring, "separability_pairs", lambda labels: pairs)
    for f in (q.baseline_total, q.baseline_loose_fingerprint, q.grouping_agreement, q.category_agreement, q.gate_measured):
        f(spark, "")
    assert seen == [2000] * 6


def test_validation_covers_runs_and_labels(spark, tmp_path):
    from faultline.plans import reference_queries as q

    spark.createDataFrame([run_row("a/b", fidelity="x"), run_row("c", version=3)], RUN_SCHEMA).write.parquet(f"{tmp_path}/runs.parquet")
    f = [("a/b", "f1", "m"), ("a/b", "f1", "m")]
    spark.createDataFrame(f, "corpusRunId string, failureId string, message string").write.parquet(f"{tmp_path}/failures.parquet")
    labels = [(1, "a/b", who, "t", "full", {"f1": ("", "NOPE", None), "f9": ("g", "FLAKY", None)}) for who in ("kim", "lee")]
    schema = "schemaVersion int, corpusRunId string, labeler string, labeledAt string, context string, labels map<string,struct<group string, category string, note string>>"
    spark.createDataFrame(labels, schema).write.parquet(f"{tmp_path}/run_labels.parquet")
    got = {(r.corpusRunId, r.problem): r.n for r in q.validation_problems(spark, str(tmp_path)).collect()}
    assert got == {
        ("a/b", "fidelity is unknown"): 1, ("c", "schema version cannot be read"): 1, ("a/b", "failureId is repeated"): 1,
        ("a/b", "group is empty"): 2, ("a/b", "category is unknown"): 2, ("a/b", "failure is not in the run"): 2,
    }


def test_astral_characters_are_kept(spark, tmp_path):
    import hashlib

    from faultline.plans import reference_queries as q

    smile = chr(0x1F600)
    rows = [(1, "E", "a" + smile, smile * 900), (2, "E", "a" + smile, "short" + smile), (3, smile, "b", None), (4, None, "b", "x" * 1200)]
    spark.createDataFrame(rows, "rowId long, errorType string, message string, stackText string").write.parquet(f"{tmp_path}/failures.parquet")
    n = lambda t: len(t.encode("utf-16-le")) // 2
    name = lambda e, m: hashlib.sha256(f"{n(e)}\x1f{e}\x1f{n(m)}\x1f{m}".encode()).hexdigest()[:32]
    got = {r.grp: (r.n, r.first_row_id) for r in q.same_text_groups(spark, str(tmp_path)).collect()}
    assert got == {name("E", "a" + smile): (2, 1), name(smile, "b"): (1, 3), name("", "b"): (1, 4)}
    stacks = dict(q.stacks_truncated(spark, str(tmp_path)).collect())
    assert set(stacks) == {1, 2, 4} and stacks[2] == "short" + smile and all(n(t) <= 1000 for t in stacks.values())
    assert stacks[1].startswith(smile) and stacks[1].endswith(smile) and "characters omitted" in stacks[1]


def test_run_views(spark):
    rows = [(f"gh:o/{n}:1:1", (f"o/{n}", "MIT" if n != "b" else None, "main"), ["jest"] if n == "a" else []) for n in ("b", "a", "c")]
    runs = spark.createDataFrame(rows, "corpusRunId string, source struct<repo string, licenseSpdx string, headBranch string>, frameworks array<string>").repartition(3)
    assert [(r.ordinal, r.source.repo) for r in corpus.ordered(runs).orderBy("ordinal").collect()] == [(0, "o/a"), (1, "o/b"), (2, "o/c")]
    ids = lambda df: sorted(r.source.repo for r in df.collect())
    assert ids(corpus.tracked(runs, ["corpus/runs/gh_o_a_1_1/run.json", "x"])) == ["o/a"] and ids(corpus.tracked(runs, [])) == []
    assert ids(corpus.filtered(runs, "O/A")) == ["o/a"] and ids(corpus.filtered(runs, held=True)) == ["o/b"] and ids(corpus.filtered(runs, framework="jest")) == ["o/a"]
    down, state = corpus.sorted_by(runs, "corpusRunId")
    up, _ = corpus.sorted_by(runs, "corpusRunId", state)
    assert [r.source.repo for r in down.collect()] == ["o/c", "o/b", "o/a"] == [r.source.repo for r in up.collect()][::-1]
    assert [corpus.category_of(x) for x in ("1", " flaky ", "99", "product regression", "?")] == [corpus.CATEGORIES[0], "FLAKY", None, "PRODUCT_REGRESSION", None]
