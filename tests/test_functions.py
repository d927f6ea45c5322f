"""Scalars, normalisation, frames, hashes and statistics on literals."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from faultline.functions import frames, hashing, stats, text
from faultline.functions.normalize import RULE_IDS, normalize

ID = "3f2504e0-4f89-41d3-9a0c-0305e82c3301"
CASES = [
    ("\x1b[31mred\x1b[0m tail  ", "red tail", "red tail"),
    (f"row {ID} gone", "row <id> gone", "row <id> gone"),
    ("01ARZ3NDEKTSV4RRFFQ69G5FAV x", "<id> x", "<id> x"),
    ("507f1f77bcf86cd799439011", "<id>", "<id>"),
    ("at 0xDEADBEEF", "at <addr>", "at <addr>"),
    ("2031-02-03T04:05:06.789Z late", "<ts> late", "<ts> late"),
    ("t=1700000000123 s=1700000000", "t=<ts> s=<ts>", "t=<ts> s=<ts>"),
    ("took 35ms, 1.5 s", "took <dur>, <dur>", "took <dur>, <dur>"),
    ("/tmp/a/b.txt and /home/kim/x", "<tmp> and <home>/x", "<tmp> and <home>/x"),
    ("GET http://h.example/a/12/b?x=1", "GET http://h.example/a/<n>/b", "GET http://h.example/a/<n>/b"),
    ("10.0.0.1:8080 and fe80:0:0:1", "<ip>:<port> and <ip>", "<ip>:<port> and <ip>"),
    ("localhost:3000 line 3000", "localhost:<port> line 3000", "localhost:<port> line <val>"),
    ("mail a123@corp.io or me@corp.io", "mail <gen> or me@corp.io", "mail <gen> or me@corp.io"),
    ("bob@example.com2.org bob@test.io-x.org bob@test.io", "bob@example.com2.org bob@test.io-x.org <gen>", "bob@example.com2.org bob@test.io-x.org <gen>"),
    ("http://h.io:8080/v1/42/x?q=1 C:\\Users\\me\\a 550E8400-e29b-41d4-A716-446655440000", "http://h.io:<port>/v1/<n>/x <home>\\a <id>", "http://h.io:<port>/v1/<n>/x <home>\\a <id>"),
    ("got +5, 1234567890123 at 0xDEADBEEF", "got +5, <ts> at <addr>", "got <val> <ts> at <addr>"),
    ("user-12 on worker 3", "<gen> on <n>", "<gen> on <n>"),
    ("at x.ts:12:7 end", "at x.ts:12:7 end", "at x.ts end"),
    ('expected: "a b" got 5', 'expected: "a b" got 5', "expected: <val> got <val>"),
    ("a\r\n\r\n\r\n\r\nb", "a\n\nb", "a\n\nb"),
    ("élan 123 nu", "élan 123 nu", "élan <val> nu"),
    ("", "", ""),
    (None, None, None),
]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_normalize_table(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
    got = df.select("i", normalize("t", "strict").alias("s"), normalize("t", "loose").alias("l")).orderBy("i").collect()
    assert [(r.s, r.l) for r in got] == [(c[1], c[2]) for c in CASES]


def test_normalize_is_idempotent_and_total(spark):
    rng = random.Random(5)
    parts = [c[0] or "" for c in CASES] + ["\x00", "😀", "a" * 500, "\t", "'", ":12", "<val>", "/", "::1", "@example.com"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for mode in ("strict", "loose"):
        rows = df.select(normalize("t", mode).alias("a")).select("a", normalize("a", mode).alias("b")).collect()
        assert all(r.a == r.b for r in rows)


def test_normalize_options(spark):
    assert one(spark, normalize(F.lit("/w/app/src/x took 5ms"), "strict", repo_root="/w/app", disabled=("duration",))) == "src/x took 5ms"
    with pytest.raises(ValueError):
        normalize("t", disabled=("nothing",))
    assert len(RULE_IDS) == 26 and RULE_IDS[0] == "ansi-control" and RULE_IDS[-1] == "whitespace-trim"


def test_text_scalars(spark):
    assert one(spark, text.units(F.lit("a😀b"))) == 4
    assert one(spark, text.clip(F.lit("ab😀"), 3)) == "ab"
    assert one(spark, text.sanitize_terminal(F.lit("a\r\nb\rc\x1b[2Jd\u202e"), "?")) == "a\nb?c?d<bidi>"
    assert one(spark, text.has_terminal_hazard(F.lit("plain\ttext\n"))) is False
    cut = one(spark, text.truncate(F.lit("x" * 500), 100))
    assert len(cut) <= 100 and cut.startswith("x") and cut.endswith("x") and "omitted" in cut
    assert one(spark, text.truncate(F.lit(cut), 100)) == cut
    assert one(spark, text.path_safe(F.lit("a:b/c d"))) == "a_b_c_d"
    assert one(spark, text.first_line(F.lit("  \n one\r\ntwo"))) == "one"
    assert one(spark, text.error_class(F.lit(" TypeError: x"))) == "TypeError"
    assert one(spark, text.error_class(F.lit("no class"))) is None
    assert [one(spark, text.seconds_to_ms(F.lit(x))) for x in ("1.2345", "", "-1", "x", "NaN")] == [1235, None, None, None, None]
    row = one(spark, text.scrub_xml(F.lit("a\x1b[1mb\x00c")))
    assert (row.text, row.n_ansi, row.n_control) == ("abc", 1, 1)
    assert one(spark, text.escape_json_in_html(F.lit("</x>\u2028"))) == "<\\/x>\\u2028"


def test_compact_keeps_the_first_length(spark):
    df = spark.createDataFrame([("y" * 300, None, None, None, {"stackText": 9}), ("s", "t" * 50, None, None, None)], "message string, stackText string, stdout string, stderr string, truncated map<string,bigint>")
    a, b = text.compact(df, 200).collect()
    assert a.truncated == {"stackText": 9, "message": 300} and len(a.message) <= 200
    assert b.truncated is None and b.message == "s"


STACKS = {
    "v8": "    at run (/srv/app/src/a.ts:88:3)\n    at Object.<anonymous> (/srv/app/node_modules/jest-x/b.js:1:2)\n  at /srv/app/test/c.test.ts:5:1",
    "jvm": "\tat com.shop.Cart.add(Cart.java:42)\n\tat org.junit.runners.Run.go(Run.java:7)\n\tat java.lang.Thread.run(Thread.java:1)",
    "python": 'Traceback\n  File "/usr/lib/python3/x.py", line 1, in a\n  File "/srv/app/core.py", line 9, in b',
    "pytest": "src/orders.py:42: in charge\ntests/test_orders.py:7: AssertionError",
    "ruby": "from lib/pay.rb:3:in `go'",
    "vitest": " ❯ add src/sum.ts:4:9",
    "go": "\tpkg/pay.go:109 +0x1a",
}


def test_frames_by_dialect(spark):
    f = frames.parse_stack
    assert [x[5] for x in f(STACKS["v8"])] == ["app", "framework", "test"]
    assert [x[5] for x in f(STACKS["jvm"])] == ["app", "framework", "framework"]
    assert [(x[2], x[3], x[5]) for x in f(STACKS["python"])][0] == ("/srv/app/core.py", 9, "app")
    assert [x[2] for x in f(STACKS["pytest"])] == ["tests/test_orders.py", "src/orders.py"]
    assert [f(STACKS[k])[0][3] for k in ("ruby", "vitest", "go")] == [3, 4, 109]
    assert f("at once the thing failed") == [] and f(None) == [] and f("") == []
    assert f(STACKS["v8"].replace("\n", "\r")) == f(STACKS["v8"])
    assert f("at run (C:\\app\\a.ts:8:3)")[0][2] == "C:\\app\\a.ts"
    df = spark.createDataFrame([(s,) for s in STACKS.values()] + [(None,)], "s string")
    rows = df.select(frames.frames("s").alias("f"), frames.frame_summary("s").alias("m")).collect()
    assert [len(r.f) for r in rows] == [r.m.n_frames for r in rows] and rows[-1].m.n_frames == 0
    assert df.select(frames.deepest_app_frame(frames.frames("s")).alias("d")).first().d.line == 88


def test_globs():
    m = lambda g, p: re.search(frames.glob_regex(g), p) is not None
    assert m("**/test/**", "src/test/a.js") and m("**/*.spec.*", "x/a.spec.ts") and not m("**/*.spec.*", "x/spec.ts") and m("**/*Test.java", "CartTest.java")


def test_detection(spark):
    rows = [("a.xml", STACKS["jvm"], None, "junit-jvm"), ("a.xml", STACKS["python"], None, "pytest"), ("a", STACKS["vitest"], None, "vitest"), ("a", STACKS["ruby"], None, "rspec"),
            ("a", "expect(received).toBe(expected)", None, "jest"), ("a", "x.go:1: no", None, "go-test"), ("a", None, None, "unknown"), ("a", None, "org.junit.X", "junit-jvm"), ("playwright/r.json", None, None, "playwright")]
    df = spark.createDataFrame(rows, "sourceFile string, stackText string, errorType string, want string")
    assert all(r.got == r.want for r in df.select("want", frames.detect_framework().alias("got")).collect())


def test_blake3_vectors():
    """Published vectors: the empty input and the repeating byte pattern of the algorithm's test file."""
    pattern = lambda n: bytes(i % 251 for i in range(n))
    assert hashing.blake3_128([b""])[0] == "af1349b9f5f9a1a6a0404dea36dcc949"
    assert hashing.blake3_128([pattern(1)])[0] == "2d3adedff11b61f14c886e35afa03673"
    assert hashing.blake3_128([pattern(1024)])[0] == "42214739f095a406f3fc83deb889744a"
    assert hashing.blake3_128([pattern(1025)])[0] == "d00278ae47eb27b34faecf67b4fe263f"
    assert hashing.blake3_128([pattern(2049)])[0] == "5f4d72f40d7a5f82b15ca2b2e44b1de3"


def test_fingerprints(spark):
    rows = [("E", "took 5ms", STACKS["v8"]), ("E", "took 9ms", STACKS["v8"].replace(":88:", ":90:")), ("E", "took 5ms", None), (None, None, None)]
    df = spark.createDataFrame(rows, "errorType string, message string, stackText string")
    for algorithm in ("sha256", "blake3"):
        a, b, c, d = hashing.with_fingerprint(df, algorithm=algorithm).collect()
        assert a.fingerprint == f"fp_v4_{a.strict_hash}" and not a.frame_fallback
        assert a.loose_hash == b.loose_hash and a.strict_hash != b.strict_hash and c.loose_hash != a.loose_hash and len(d.strict_hash) == 32
    apart = hashing.with_fingerprint(df.withColumn("loose_hash", F.lit("x")), vendor_dirs=("src",)).first()
    assert apart.frame_fallback and apart.loose_hash != "x"
    framed = lambda *p: one(spark, hashing.framed(F.array(*map(F.lit, p))))
    assert framed("a", "b") != framed("a\x1f1\x1fb") and framed("ab", "c") != framed("a", "bc")


def test_minhash(spark):
    s = "the quick brown fox jumps over the lazy dog again and again"
    a, b = hashing.minhash_signature(s), hashing.minhash_signature(s.replace("lazy", "idle"))
    assert hashing.minhash_signature("short") is None and hashing.minhash_signature(None) is None and len(a) == 128
    same = sum(x == y for x, y in zip(a, b)) / 128
    sh = lambda t: {t[i : i + 5] for i in range(len(t) - 4)}
    x, y = sh(s), sh(s.replace("lazy", "idle"))
    assert abs(same - len(x & y) / len(x | y)) < 0.15
    assert len(hashing._bands(__import__("numpy").asarray(a, "uint64"))) == 32
    df = spark.createDataFrame([(1, s), (2, s.replace("lazy", "idle")), (3, "entirely different words about nothing in particular at all"), (4, None), (5, s)], "id long, t string")
    got = hashing.lsh_candidates(df.select("id", hashing.minhash("t").alias("sig")), "id", "sig", 0.5).collect()
    assert [(r.a, r.b) for r in got] == [(1, 2)]


def test_crowded_bands_are_split(spark):
    """The pairs are the same however many cells a band's sketches are dealt out over, and none comes twice."""
    s = "the quick brown fox jumps over the lazy dog again and again number "
    df = spark.createDataFrame([(i, s + str(i)) for i in range(40)], "id long, t string").select("id", hashing.minhash("t").alias("sig"))
    whole, split = (sorted((r.a, r.b) for r in hashing.lsh_candidates(df, "id", "sig", crowd=n).collect()) for n in (2000, 3))
    assert whole == split and len(set(whole)) == len(whole) > 500


def test_unlike_sketches_end_where_they_meet(spark):
    """Texts half alike share band keys with each other; no more is shuffled for them, and the pairs are those of brute force."""
    import random

    r = random.Random(1)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    same = word(70)
    texts = [same + word(30) for _ in range(500)]
    texts += [t[:-k] for k in range(1, 9) for t in texts[:40]] + ["x y z " * n for n in (8, 9, 10)] + ["short", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumn("sig", hashing.minhash("t"))
    known = [(i, s) for i, s in enumerate(map(hashing.minhash_signature, texts)) if s is not None]
    want = {(i, j): n / 128 for k, (i, s) in enumerate(known) for j, u in known[k + 1 :] if (n := sum(x == y for x, y in zip(s, u))) >= 103}
    moved = lambda: spark._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    for how in ({}, {"text": "t"}, {"text": "t", "crowd": 60}):
        before = moved()
        got = [((x.a, x.b), x.similarity) for x in hashing.lsh_candidates(df, "id", "sig", 0.8, members=True, **how).collect()]
        assert len(got) == len(want) > 1000 and dict(got) == want
        assert moved() - before < 1_500_000


def test_levenshtein(spark):
    f = lambda a, b: one(spark, hashing.levenshtein_similarity(F.lit(a), F.lit(b)))
    assert f("abc", "abc") == 1.0 and f("", "x") == 0.0 and f("kitten", "sitting") == pytest.approx(1 - 3 / 7)


def pairs(p, t):
    c = [0, 0, 0, 0]
    for i in range(len(p)):
        for j in range(i):
            c[(0 if p[i] == p[j] else 2) + (0 if t[i] == t[j] else 1) if p[i] == p[j] or t[i] == t[j] else 3] += 1
    return {"tp": c[0], "fp": c[1], "fn": c[2], "tn": c[3]}


def test_pair_counts_against_all_pairs(spark):
    rng = random.Random(2)
    runs = {r: ([rng.choice("abc") for _ in range(n)], [rng.choice("xyz") for _ in range(n)]) for r, n in (("r1", 9), ("r2", 1), ("r3", 6), ("r4", 2))}
    df = spark.createDataFrame([(r, p, t) for r, (ps, ts) in runs.items() for p, t in zip(ps, ts)], "r string, p string, t string")
    got = {x.r: x for x in stats.pair_counts(df, ["r"], "p", "t").collect()}
    for r, (p, t) in runs.items():
        want = pairs(p, t)
        assert {k: got[r][k] for k in want} == want and got[r].n == len(p)


def test_prf_and_wilson(spark):
    df = spark.createDataFrame([(0, 12, 9), (0, 0, 0), (3, 0, 0)], "tp long, fp long, fn long")
    rows = df.select(*(c.alias(k) for k, c in stats.prf(F.col("tp"), F.col("fp"), F.col("fn")).items())).collect()
    assert rows[0].f1 == 0 and math.isnan(rows[1].f1) and rows[2].f1 == 1
    w = spark.range(1).select(*(c.alias(k) for k, c in stats.wilson(F.lit(10), F.lit(20)).items())).first()
    assert (round(w.lower, 4), round(w.upper, 4)) == (0.2993, 0.7007)
    z = spark.range(1).select(*(c.alias(k) for k, c in stats.wilson(F.lit(0), F.lit(0)).items())).first()
    assert math.isnan(z.point) and (z.lower, z.upper) == (0, 1)
    with pytest.raises(Exception, match="required"):
        spark.range(1).select(stats.wilson(F.lit(3), F.lit(2))["point"].alias("x")).collect()
    assert one(spark, stats.gate_passes(F.lit(float("nan")), 0.8)) is False


def test_generator_and_bootstrap(spark):
    rng = stats.python_draws(stats.SEED)
    want = [next(rng) for _ in range(600)]
    got = [r.u for r in spark.range(1, 601).orderBy("id").select(stats.draw(F.col("id")).alias("u")).collect()]
    assert got == want
    units = [("a", 3, 5), ("b", 1, 4), ("c", 6, 6), ("d", 0, 2)]
    df = spark.createDataFrame([("g", *u) for u in units] + [("solo", "a", 1, 2)], "g string, id string, s long, t long")
    out = {r.g: r for r in stats.bootstrap(df, ["id"], ["s", "t"], stats.ratio(F.col("s"), F.col("t")), ["g"], 100).collect()}
    rng = stats.python_draws(stats.SEED)
    sims = sorted(sum(u[1] for u in d) / sum(u[2] for u in d) for d in ([units[int(next(rng) * 4)] for _ in range(4)] for _ in range(100)))
    q = lambda p: sims[int(p * 99)] + (p * 99 - int(p * 99)) * (sims[min(99, int(p * 99) + 1)] - sims[int(p * 99)])
    assert out["g"].lower == pytest.approx(q(0.025)) and out["g"].upper == pytest.approx(q(0.975)) and out["g"].point == pytest.approx(10 / 17)
    assert math.isnan(out["solo"].lower) and out["solo"].point == 0.5
    assert stats.shuffled([1, 2, 3, 4], 7) == stats.shuffled([1, 2, 3, 4], 7) and sorted(stats.shuffled(list(range(9)), 1)) == list(range(9))
