"""Playwright reports: a JSON document of nested suites, or a log of events, one JSON object per line."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from faultline.sources.model import Limits, Parsed, ParseError, attempt, clip, failure, utf16

NAME = "playwright"
VERSIONS = (1, 2)
_STATUS = {"passed": "passed", "failed": "failed", "timedOut": "timed_out", "skipped": "skipped"}
_KINDS = (("screenshot", r"screenshot"), ("video", r"video"), ("trace", r"trace"), ("log", r"log|stdout|stderr"))
_CLASS = re.compile(r"\s*((?:[A-Z][A-Za-z0-9_]*)?(?:Error|Exception|Failure))\s*:", re.ASCII)


def _dict(x: object) -> dict:
    return x if isinstance(x, dict) else {}


def _dicts(x: object) -> list[dict]:
    return [y for y in x if isinstance(y, dict)] if isinstance(x, list) else []


def _text(x: object) -> str | None:
    return x if isinstance(x, str) else None


def _number(x: object) -> float | None:
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None


def _cut(s: str, n: int) -> str:
    return s if utf16(s) <= n else clip(s, n) + f"\n[truncated at {n} units]"


def artifact(a: dict) -> dict:
    name = _text(a.get("name")) or ""
    kind = next((k for k, p in _KINDS if re.search(p, name, re.I)), "other")
    return {"kind": kind, "path": _text(a.get("path")) or name, "mediaType": _text(a.get("contentType"))}


def _io(entries: object, limits: Limits) -> str | None:
    parts = []
    for e in entries if isinstance(entries, list) else []:
        if isinstance(e, str):
            parts.append(e)
        elif isinstance(_dict(e).get("text"), str):
            parts.append(e["text"])
        elif isinstance(_dict(e).get("buffer"), str):
            parts.append("[binary output omitted]")
    return _cut("".join(parts), limits.max_text) if any(parts) else None


def _failure(result: dict, artifacts: list[dict], limits: Limits) -> dict:
    errors = _dicts(result.get("errors")) if "errors" in result else _dicts([result.get("error")])
    message = _cut(_text(_dict(errors[0] if errors else None).get("message")) or "", limits.max_text)
    more = sum(bool(_text(e.get("message"))) for e in errors[1:])
    stack = "\n".join(s for e in errors if (s := _text(e.get("stack"))))
    m = _CLASS.match(message)
    return failure(
        errorType=m and m.group(1), message=message + (f"\n[+{more} more error(s)]" if more else ""), stackText=_cut(stack, limits.max_text) if stack else None,
        stdout=_io(result.get("stdout"), limits), stderr=_io(result.get("stderr"), limits), artifacts=artifacts,
    )


def _attempt(title: str, path: list[str], file: str | None, index: int, result: dict, artifacts: list[dict], shard: int, limits: Limits) -> dict:
    status = _STATUS.get(result.get("status") if isinstance(result.get("status"), str) else "", "error")
    bad = status in ("failed", "error", "timed_out")
    worker = _number(result.get("workerIndex"))
    return attempt(
        shardIndex=shard, displayName=_cut(title, limits.max_name), suitePath=[_cut(p, limits.max_name) for p in path], filePath=file, attemptIndex=index, status=status,
        durationMs=_number(result.get("duration")), startedAt=_text(result.get("startTime")), workerId=None if worker is None else f"{worker:g}",
        failure=_failure(result, artifacts, limits) if bad else None,
    )


def _deeper(path: list[str], title: str, file: str | None) -> list[str]:
    """A suite titled like its file, or not at all, adds nothing to the path."""
    return path if title in ("", file) else [*path, title]


def _too_deep(depth: int, limits: Limits) -> None:
    if depth > limits.max_depth:
        raise ParseError("DEPTH_LIMIT", f"suites nest deeper than {limits.max_depth}")


def _json_attempts(node: dict, path: list[str], file: str | None, shard: int, limits: Limits, depth: int = 0) -> Iterator[dict]:
    _too_deep(depth, limits)
    file = _text(node.get("file")) or file
    path = _deeper(path, _text(node.get("title")) or "", file)
    for spec in _dicts(node.get("specs")):
        for test in _dicts(spec.get("tests")):
            project = _text(test.get("projectName"))
            full = path if project is None else [project, *path]
            for i, r in enumerate(_dicts(test.get("results"))):
                retry = _number(r.get("retry"))
                arts = [artifact(a) for a in _dicts(r.get("attachments"))]
                yield _attempt(_text(spec.get("title")) or "", full, _text(spec.get("file")) or file, i if retry is None else int(retry), r, arts, shard, limits)
    for child in _dicts(node.get("suites")):
        yield from _json_attempts(child, path, file, shard, limits, depth + 1)


def _tests(node: dict, path: list[str], limits: Limits, depth: int = 0) -> Iterator[tuple[str, tuple]]:
    """(test id, (title, path, file)) of a suite tree in an event log."""
    _too_deep(depth, limits)
    file = _text(_dict(node.get("location")).get("file"))
    path = _deeper(path, _text(node.get("title")) or "", file)
    for e in [x for k in ("entries", "suites", "tests") for x in _dicts(node.get(k))]:
        if isinstance(e.get("testId"), str):
            yield e["testId"], (_text(e.get("title")) or "", path, _text(_dict(e.get("location")).get("file")) or file)
        else:
            yield from _tests(e, path, limits, depth + 1)


def _keep(out: Parsed, a: dict, limits: Limits) -> None:
    out.attempts.append(a)
    if len(out.attempts) > limits.max_attempts:
        raise ParseError("ATTEMPT_LIMIT", f"more than {limits.max_attempts} attempts", None, "split the report")


def _events(text: str, skip_invalid: bool, out: Parsed) -> list[tuple[int, str, dict]]:
    found = []
    for no, line in enumerate(text.split("\n"), 1):
        if not line.strip():
            continue
        try:
            e = json.loads(line)
        except (ValueError, RecursionError) as x:
            if not skip_invalid:
                raise ParseError("JSON_ERROR", f"not valid JSON: {x}", f"line {no}", "the upload was probably cut off") from None
            out.warn("JSON_ERROR", "a line cannot be read", f"line {no}")
            continue
        if not isinstance(e, dict):
            out.warn("BLOB_LINE_NOT_EVENT", "a line is no object", f"line {no}")
            continue
        found.append((no, _text(e.get("method")) or "", _dict(e.get("params"))))
    return found


def _parse_log(text: str, shard: int, skip_invalid: bool, limits: Limits, out: Parsed) -> None:
    """Suites and attachments are gathered first: they may come after the tests they belong to."""
    events = _events(text, skip_invalid, out)
    tests: dict[str, tuple] = {}
    attached: dict[str, list[dict]] = {}
    for no, method, p in events:
        if method == "onBlobReportMetadata" and p.get("version", 0) not in VERSIONS:
            out.warn("BLOB_VERSION", f"version {p.get('version', 0)} is unknown; fields may be missing", f"line {no}")
        elif method == "onProject":
            for suite in _dicts(_dict(p.get("project")).get("suites")):
                tests.update(_tests(suite, [], limits))
        elif method == "onAttach" and isinstance(p.get("resultId"), str):
            attached[p["resultId"]] = [artifact(a) for a in _dicts(p.get("attachments"))]
    count: dict[str, int] = {}
    for _, method, p in events:
        test, result = _text(_dict(p.get("test")).get("testId")), p.get("result")
        if method != "onTestEnd" or test is None or not isinstance(result, dict):
            continue
        title, path, file = tests.get(test, (test, [], None))
        retry = _number(result.get("retry"))
        index = count.get(test, 0) if retry is None else int(retry)
        count[test] = index + 1
        _keep(out, _attempt(title, path, file, index, result, attached.get(_text(result.get("id")) or "", []), shard, limits), limits)


def parse(data: bytes, shard: int = 0, skip_invalid: bool = False, limits: Limits = Limits()) -> Parsed:
    """An event log if "method" is named early, a document otherwise."""
    if len(data) > limits.max_bytes:
        raise ParseError("SIZE_LIMIT", f"the report exceeds {limits.max_bytes} bytes")
    text, out = data.decode("utf-8-sig", "replace"), Parsed()
    if re.search(r'"method"\s*:', text[:4096]):
        _parse_log(text, shard, skip_invalid, limits, out)
        return out
    try:
        doc = json.loads(text)
    except (ValueError, RecursionError) as e:
        if not skip_invalid:
            raise ParseError("JSON_ERROR", f"not valid JSON: {e}", None, "the upload was probably cut off") from None
        out.warn("JSON_ERROR", "the report cannot be read")
        return out
    for suite in _dicts(_dict(doc).get("suites")):
        for a in _json_attempts(suite, [], None, shard, limits):
            _keep(out, a, limits)
    return out


def confidence(path: str, head: bytes) -> float:
    """How sure it is that a file is a Playwright report, from its name and first 8 KiB."""
    text, name = head[:8192].decode("utf-8", "replace"), path.lower()
    if name.endswith(".jsonl"):
        return 0.99 if "onBlobReportMetadata" in text else 0.8 if '"method"' in text else 0.05
    if re.search(r'"suites"\s*:', text):
        return 0.95 if re.search(r'"config"\s*:', text) and "playwright" in text.lower() else 0.9 if re.search(r'"config"\s*:|"specs"\s*:', text) else 0.05
    return 0.05 if name.endswith(".json") else 0.0


CAPABILITIES = {
    "retries": True, "shards": True, "stdout": True, "stderr": True, "durations": True, "startTimes": True, "workers": True, "artifacts": True,
    "assertions": False, "filePaths": True,
}
