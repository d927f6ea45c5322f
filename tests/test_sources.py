"""Parsers, archives, stored corpus and command line on literal input."""

from __future__ import annotations

import gzip
import io
import json
import random
import zipfile

import pytest

from faultline import cli
from faultline.sources import archive, conformance, junit, playwright, reports, sinks
from faultline.sources.model import Limits, Parsed, ParseError, attempt

XML = b"""<?xml version="1.0"?>
<testsuites><testsuite name="outer" file="a.ts"><testsuite name="">
<testcase name="ok" classname="C" time="1.2345"/>
<testcase name="bad" classname="outer"><failure message="boom" type="E">boom\n at x</failure><system-out>hello</system-out></testcase>
<testcase name="err" file="own.ts"><error>first line\nrest</error></testcase>
<testcase name="skip"><skipped/></testcase>
<testcase name="flaky"><flakyFailure message="m"><stackTrace>trace</stackTrace></flakyFailure><rerunError type="X">t</rerunError></testcase>
<TestCase NAME="retry"><rerunFailure message="r1"/><failure message="r2"/></TestCase>
<testcase name="bad" classname="outer"><failure message="again"/></testcase>
</testsuite></testsuite></testsuites>"""


def test_junit_rows():
    p = junit.parse(XML)
    rows = [(a["displayName"], a["attemptIndex"], a["status"], a["durationMs"]) for a in p.attempts]
    assert rows == [("ok", 0, "passed", 1235.0), ("bad", 0, "failed", None), ("err", 0, "error", None), ("skip", 0, "skipped", None), ("flaky", 0, "failed", None), ("flaky", 1, "error", None), ("flaky", 2, "passed", None),
                    ("retry", 0, "failed", None), ("retry", 1, "failed", None), ("bad", 1, "failed", None)]
    ok, bad, err, _, flaky = p.attempts[:5]
    assert ok["suitePath"] == ["outer", "C"] and bad["suitePath"] == ["outer"] and ok["filePath"] == "a.ts" and err["filePath"] == "own.ts"
    assert bad["failure"] | {"artifacts": []} == {"errorType": "E", "message": "boom", "stackText": "boom\n at x", "stdout": "hello", "stderr": None, "artifacts": []}
    assert err["failure"]["message"] == "first line" and flaky["failure"]["stackText"] == "trace"
    assert [w["code"] for w in p.warnings] == ["DUPLICATE_TESTCASE"]


@pytest.mark.parametrize(
    ("data", "limits", "code"),
    [
        (b"<!DOCTYPE x><testsuite/>", Limits(), "XXE_DOCTYPE"), (b"<testsuite><testcase></testsuite>", Limits(), "XML_ERROR"), (b"<a>" * 70, Limits(), "DEPTH_LIMIT"),
        (b"<testsuite a='1' b='2' c='3'/>", Limits(max_attributes=2), "ATTR_LIMIT"), (XML, Limits(max_attempts=3), "ATTEMPT_LIMIT"), (XML, Limits(max_bytes=10), "SIZE_LIMIT"),
    ],
)
def test_junit_fatal(data, limits, code):
    with pytest.raises(ParseError) as e:
        junit.parse(data, limits=limits)
    assert e.value.code == code


def test_junit_tolerance():
    p = junit.parse(b"<testsuite><testcase name='a'><failure>x", skip_invalid=True)
    assert [w["code"] for w in p.warnings] == ["XML_ERROR", "TRUNCATED_INPUT"] and len(p.attempts) == 1
    with pytest.raises(ParseError, match="XXE"):
        junit.parse(b"<!DOCTYPE x><testsuite/>", skip_invalid=True)
    p = junit.parse("<testsuite><testcase name='a'><failure message='\x1b[31mred'>\x00y</failure></testcase></testsuite>".encode())
    assert p.warnings[0]["code"] == "CONTROL_CHARS_STRIPPED" and p.attempts[0]["failure"]["message"] == "red"
    p = junit.parse(b"<testsuite><testcase name='a'><testcase name='b'/></testcase></testsuite>")
    assert [a["displayName"] for a in p.attempts] == ["a", "b"] and p.warnings[0]["code"] == "NESTED_TESTCASE"
    p = junit.parse(b"<testsuite><testcase name='a'><failure>" + b"z" * 500 + b"</failure></testcase></testsuite>", limits=Limits(max_text=100))
    assert p.warnings[0]["code"] == "TEXT_TRUNCATED" and len(p.attempts[0]["failure"]["stackText"]) < 200


def test_junit_fuzz():
    rng, parts = random.Random(9), [b"<testsuite>", b"</testsuite>", b"<testcase name='x'>", b"</testcase>", b"<failure message='m'>", b"</failure>", b"text", b"<![CDATA[", b"]]>", b"&lt;", b"&x;", b"\x1b[", b"\xff", b"<!--", b"-->", b"<", b"'"]
    for _ in range(300):
        data = b"".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        for skip in (True, False):
            try:
                junit.parse(data, skip_invalid=skip)
            except ParseError:
                pass


RESULT = {"id": "R1", "status": "failed", "duration": 5, "errors": [{"message": "TypeError: x", "stack": "s1"}, {"message": "more", "stack": "s2"}], "stdout": ["a", {"buffer": "=="}]}
DOC = {"config": {}, "suites": [{"title": "a.ts", "file": "a.ts", "suites": [{"title": "group", "specs": [{"title": "t", "tests": [{"projectName": "p", "results": [RESULT, {"status": "interrupted", "retry": 3}, 7]}]}]}]}]}
LOG = [
    {"method": "onBlobReportMetadata", "params": {"version": 9}}, {"method": "onTestEnd", "params": {"test": {"testId": "T"}, "result": RESULT}},
    {"method": "onTestEnd", "params": {"test": {"testId": "T"}, "result": {"status": "timedOut", "workerIndex": 2}}}, {"method": "onTestEnd", "params": {"test": {"testId": "U"}, "result": {"status": "passed"}}},
    {"method": "onProject", "params": {"project": {"suites": [{"title": "a.ts", "location": {"file": "a.ts"}, "entries": [{"title": "d", "entries": [{"testId": "T", "title": "t"}]}]}]}}},
    {"method": "onAttach", "params": {"resultId": "R1", "attachments": [{"name": "my-trace", "path": "x.zip"}]}}, 5,
]


def test_playwright_document():
    a, b = playwright.parse(json.dumps(DOC).encode()).attempts
    assert a["suitePath"] == ["p", "group"] and a["filePath"] == "a.ts" and a["failure"]["errorType"] == "TypeError" and a["failure"]["message"].endswith("[+1 more error(s)]")
    assert a["failure"]["stackText"] == "s1\ns2" and a["failure"]["stdout"] == "a[binary output omitted]"
    assert b["status"] == "error" and b["attemptIndex"] == 3 and b["failure"]["message"] == ""


def test_playwright_log():
    p = playwright.parse("\n".join(map(json.dumps, LOG)).encode())
    assert [(a["displayName"], a["attemptIndex"], a["status"]) for a in p.attempts] == [("t", 0, "failed"), ("t", 1, "timed_out"), ("U", 0, "passed")]
    assert p.attempts[0]["failure"]["artifacts"] == [{"kind": "trace", "path": "x.zip", "mediaType": None}] and p.attempts[0]["suitePath"] == ["d"]
    assert {w["code"] for w in p.warnings} == {"BLOB_VERSION", "BLOB_LINE_NOT_EVENT"}
    with pytest.raises(ParseError, match="JSON_ERROR"):
        playwright.parse(b'{"method": 1}\n{broken')
    deep = {"title": "x"}
    for _ in range(80):
        deep = {"title": "x", "suites": [deep]}
    with pytest.raises(ParseError, match="DEPTH"):
        playwright.parse(json.dumps({"suites": [deep]}).encode())
    assert playwright.parse(b'{"suites": 5, "config": null}').attempts == []


def test_dispatch_and_confidence():
    assert reports.pick_adapter("a.XML", b"<testsuite >") == "junit" and reports.pick_adapter("a.xml", b"<html>") is None
    assert reports.pick_adapter("a.jsonl", b'{"method":1}') == "playwright" and reports.pick_adapter("a.json", b'{"suites": [], "config": {}}') == "playwright"
    assert junit.confidence("x.xml", b"<testsuites>") == 0.95 and junit.confidence("x.txt", b"no") == 0 and playwright.confidence("a.jsonl", b"{}") == 0.05


def tar_of(files, kind=b"0"):
    out = b""
    for name, body in files:
        head = bytearray(512)
        head[: len(name)] = name.encode()
        head[124:136] = b"%011o\0" % len(body)
        head[156:157] = kind
        out += bytes(head) + body + b"\0" * (-len(body) % 512)
    return out + b"\0" * 1024


def zip_of(files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, d in files:
            z.writestr(n, d)
    return b.getvalue()


def test_archives():
    tar = tar_of([("a.xml", XML), ("b.txt", b"x")])
    assert archive.untar(tar) == {"a.xml": XML, "b.txt": b"x"}
    assert archive.untar(tar[: 512 + len(XML) // 2]) == {} and archive.untar(b"junk") == {} and archive.untar(tar_of([("l", b"x")], b"5")) == {}
    long_ = tar_of([("././@LongLink", b"deep/" * 40 + b"n.xml\0")], b"L")[:-1024] + tar_of([("short", b"body")])
    assert list(archive.untar(long_)) == ["deep/" * 40 + "n.xml"]
    data = zip_of([("r/a.xml", XML), ("in.tgz", gzip.compress(tar)), ("in.zip", zip_of([("z.xml", XML)])), ("bad.zip", b"no"), ("big.bin", b"0" * 5000)])
    files, skipped = archive.unpack(data, archive.ArchiveLimits(max_entry=4000))
    assert set(files) == {"r/a.xml", "in.tgz!a.xml", "in.tgz!b.txt", "in.zip!z.xml"} and skipped == ["entry too large", "nested unzip failed"]
    assert archive.unpack(b"not a zip")[0] == {}


def test_spark_sources_and_harvest(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.xml").write_bytes(XML)
    (tmp_path / "x" / "b.json").write_text(json.dumps(DOC))
    (tmp_path / "x" / "c.xml").write_bytes(b"<!DOCTYPE y><testsuite></testsuite>")
    got = reports.read_reports(spark, str(tmp_path / "x"))
    assert reports.attempts(got).count() == 12
    assert {r.code: r.n for r in reports.warning_counts(got).collect()} == {"DUPLICATE_TESTCASE": 1, "parse_failed:junit:XXE_DOCTYPE": 1}
    spark.dataSource.register(reports.ReportSource)
    direct = spark.read.format("ci_report").load(str(tmp_path / "x"))
    assert direct.count() == 12 and direct.where("failure is not null").count() == 9
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "one.zip").write_bytes(zip_of([("a.xml", XML), ("b.json", json.dumps(DOC))]))
    (tmp_path / "z" / "none.zip").write_bytes(zip_of([("readme", "x")]))
    arch = reports.read_archives(spark, str(tmp_path / "z"))
    name = {("one" if "/one.zip" in r.archive else "none"): r.archive for r in arch.select("archive").distinct().collect()}
    src = spark.createDataFrame([(name["one"], 10, "gh:o/r:1:1", ("gh", "o/r")), (name["none"], 5, "gh:o/r:2:1", ("gh", "o/r"))], "archive string, size long, corpusRunId string, source struct<provider string, repo string>")
    runs, fails = reports.harvest(arch, src, budget=100)
    r = runs.collect()
    assert len(r) == 1 and r[0].counts.failures == 9 and r[0].counts.attempts == 12 and r[0].counts.filesParsed == 2
    assert [x.failureId for x in fails.orderBy("failureId").collect()][:2] == ["f0001", "f0002"] and fails.first().sourceFile.startswith("one/")
    assert reports.harvest(arch, src, known=runs)[0].count() == 0 and reports.harvest(arch, src, budget=3)[0].count() == 0


def stored(tmp_path):
    fail = lambda i, m: {"failureId": f"f{i:04d}", "sourceFile": "a.xml", "shardIndex": 0, "attemptIndex": 0, "displayName": "t", "suitePath": ["s"], "status": "failed", "errorType": "E", "message": m}
    for n, spdx in ((1, "MIT"), (2, "GPL-3.0")):
        d = tmp_path / "runs" / f"gh_o_r_{n}_1"
        d.mkdir(parents=True)
        doc = {"schemaVersion": 1, "corpusRunId": f"gh:o/r:{n}:1", "source": {"provider": "gh", "repo": "o/r", "providerRunId": str(n), "runAttempt": 1, "licenseSpdx": spdx}, "fidelity": "artifact",
               "counts": {"attempts": 9, "failures": 3}, "warnings": [], "failures": [fail(1, "x 1"), fail(2, "x 2"), fail(3, "y")]}
        (d / "run.json").write_text(json.dumps(doc))
    for who, groups in (("kim", "ggh"), ("lee", "gh" + "h")):
        d = tmp_path / "labels" / who
        d.mkdir(parents=True)
        doc = {"schemaVersion": 1, "corpusRunId": "gh:o/r:1:1", "labeler": who, "labeledAt": "t", "context": "full", "labels": {f"f{i + 1:04d}": {"group": g, "category": "FLAKY"} for i, g in enumerate(groups)}}
        (d / "gh_o_r_1_1.json").write_text(json.dumps(doc))
    return str(tmp_path)


def test_command_line(spark, tmp_path, capsys):
    root = stored(tmp_path / "c")
    go = lambda *a: cli.main(list(a), spark)
    assert go("nonsense") == 3 and go("status") == 3
    for name in ("status", "frames", "baseline", "holdout"):
        assert go(name, "--corpus", root) == 0
    assert "copyleft" in capsys.readouterr().out
    assert go("agreement", "--corpus", root, "kim", "lee") == 0 and go("agreement", "--corpus", root, "machine:m", "lee") == 2 and go("agreement", "--corpus", root, "kim", "nobody") == 2
    assert go("separability", "--corpus", root, "kim", "lee") == 2
    sel, sheet, key, page = (str(tmp_path / n) for n in ("sel.json", "sheet.json", "key.json", "page.html"))
    assert go("sample", "--corpus", root, "--out", sel, "--min", "2", "--target", "3") == 0
    assert go("worksheet", "--corpus", root, "--selection", sel, "--context", "payload-only", "--out", sheet, "--key", key, "--page", page) == 0
    doc = json.load(open(sheet))
    assert doc["entries"] and "repo" not in doc["entries"][0] and "<main>" in open(page).read()
    for e in doc["entries"]:
        e |= {"group": "g", "category": "FLAKY"}
    json.dump(doc, open(sheet, "w"))
    assert go("import", "--corpus", root, "--sheet", sheet, "--key", key, "--labeler", "new one", "--at", "t", "--context", "payload-only") == 0
    assert reports.read_labels(spark, f"{root}/labels", "new one").count() == 1 and reports.read_labels(spark, f"{root}/labels", "none").count() == 0
    assert reports.labelers(spark, f"{root}/labels") == ["kim", "lee", "new_one"] and reports.labelers(spark, f"{root}/nowhere") == []
    assert reports.read_labels(spark, f"{root}/labels", run="gh:o/r:1:1").count() == 3 and reports.read_labels(spark, f"{root}/labels", run="other").count() == 0
    assert go("snapshot", "--corpus", root, "--out", str(tmp_path / "snap.json")) == 0 and json.load(open(tmp_path / "snap.json"))["runs"]
    snap = json.load(open(tmp_path / "snap.json"))
    assert {r["id"] for r in snap["gate"]["requirements"]} >= {"runs", "frameworks", "synthetic-cap", "grouping-agreement", "separability"} and not snap["gate"]["passed"]
    assert [b["band"] for b in snap["sizeBands"]] == ["1", "2-4", "5-24", "25-99", "100+"] and len(snap["baselines"]) == 3 and snap["labelers"][0]["categories"] == {"FLAKY": 3}
    assert snap["gate"]["heldOut"] == {"runs": 1, "failures": 3, "repositories": 1, "runs_with_5_failures": 0, "runs_in_band": 0}
    capsys.readouterr()
    assert go("status", "--corpus", root, "--json") == 0 and len(json.loads(capsys.readouterr().out)["requirements"]) == 10
    assert go("compact", "--corpus", root, "--cap", "100", "--out", str(tmp_path / "again")) == 0
    assert reports.read_runs(spark, str(tmp_path / "again"))[1].count() == 6


def test_scan_and_harvest_commands(spark, tmp_path, capsys):
    root, z = tmp_path / "c", tmp_path / "z"
    z.mkdir()
    root.mkdir()
    (z / "one.zip").write_bytes(zip_of([("a.xml", XML)]))
    (z / "none.zip").write_bytes(zip_of([("readme", "x")]))
    listing = tmp_path / "src.jsonl"
    src = lambda n, k, spdx="MIT": {"name": n, "corpusRunId": f"gh:o/{k}:1:1", "source": {"provider": "gh", "repo": f"o/{k}", "providerRunId": "1", "runAttempt": 1, "licenseSpdx": spdx}}
    listing.write_text("\n".join(map(json.dumps, [src("one.zip", "a"), src("none.zip", "b"), src(None, "c")])))
    go = lambda *a: cli.main(list(a), spark)
    out = str(tmp_path / "good.txt")
    assert go("scan", "--archives", str(z), "--sources", str(listing), "--out", out) == 0 and open(out).read() == "o/a\n"
    said = capsys.readouterr().out
    assert "1 of 3 yield failures" in said and "no artifacts" in said and "nothing parsed" in said
    for added in (1, 0):  # the second harvest finds the run stored
        assert go("harvest", "--corpus", str(root), "--archives", str(z), "--sources", str(listing)) == 0
        assert f"added {added} run(s)" in capsys.readouterr().out
    runs, fails = reports.read_runs(spark, str(root / "runs"))
    assert runs.count() == 1 and fails.count() > 0 and go("status", "--corpus", str(root)) == 0


def test_chunks_do_not_matter():
    """Any cut of the bytes gives the same attempts and warnings; attempts are given out before the end."""
    text = XML + b""
    whole = junit.parse(text, skip_invalid=True)
    for size in (1, 7, 64, 1000):
        out = Parsed()
        parts = list(junit.stream((text[i : i + size] for i in range(0, len(text), size)), out, skip_invalid=True))
        assert [a for p in parts for a in p] == whole.attempts and [w["code"] for w in out.warnings] == [w["code"] for w in whole.warnings]
    many = b"<testsuite>" + b"".join(b"<testcase name='t%d'><failure>\x1b[31m%s\x1b[0m</failure></testcase>" % (i, b"x" * 300) for i in range(100)) + b"</testsuite>"
    out = Parsed()
    first = next(junit.stream((many[i : i + 8000] for i in range(0, len(many), 8000)), out))
    assert 0 < len(first) < 100 and first[0]["failure"]["stackText"] == "x" * 300


def test_adapters_conform():
    esc = b"<testsuite><testcase name='a\x1b[1mb'><failure message='\x1b[31mred'>x</failure></testcase></testsuite>"
    assert conformance.findings(junit, {"whole": XML, "cut": XML[: len(XML) // 2], "escapes": esc}) == []
    assert conformance.findings(playwright, {"document": json.dumps(DOC).encode(), "log": "\n".join(map(json.dumps, LOG)).encode()}) == []

    class Careless:
        NAME, CAPABILITIES = "careless", {}
        confidence = staticmethod(lambda path, head: 2.0)

        @staticmethod
        def stream(chunks, out, *_):
            for c in chunks:
                if b"\xff" in c:
                    raise KeyError("x")
                yield [attempt(displayName=c.decode("utf-8", "replace"), durationMs=-1.0)]

    assert {f.check for f in conformance.findings(Careless)} == {"confidence", "contract", "terminal safety", "capabilities", "chunks", "errors"}


def test_sinks():
    assert sinks.ignore_block("a\n", ["x/"]) == f"a\n{sinks.BEGIN}\nx/\n{sinks.END}\n"
    assert sinks.ignore_block(sinks.ignore_block("a", ["x/"]), ["y/"]).count("/") == 1
    assert "</script" not in sinks.embed_json({"a": "</script> "}) and sinks.plain(float("nan")) is None
    assert sinks.run_header({"corpusRunId": "r", "source": {"repo": "o/r", "event": None}}, 2) == "run r, 2 failure(s)\n  repository: o/r"
    assert sinks.head_and_tail("\n".join("abcdefghijklmnop")).count("\n") == 11
