"""JUnit XML reports: one pass of an event parser over chunks of a scrubbed document.

Elements and attributes are matched without case. Escape sequences and characters that XML forbids are
removed and counted before parsing; a DOCTYPE is always refused.
"""

from __future__ import annotations

import codecs
import itertools
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from xml.parsers import expat

from faultline.functions.text import ANSI
from faultline.sources.model import Limits, Parsed, ParseError, attempt, clip, failure, utf16

_ANSI = re.compile(ANSI)
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
_RERUNS = {"rerunfailure": "failed", "flakyfailure": "failed", "rerunerror": "error", "flakyerror": "error"}
_OUTCOMES = {"failure": "failed", "error": "error", "skipped": "skipped"}
_TEXTS = {"system-out", "system-err", *_RERUNS, *_OUTCOMES}
NAME = "junit"


@dataclass
class _Case:
    name: str
    classname: str
    file: str | None
    duration: float | None
    reruns: list[tuple[str, dict | None]] = field(default_factory=list)
    outcomes: list[tuple[str, dict | None]] = field(default_factory=list)
    stdout: str | None = None
    stderr: str | None = None


def milliseconds(text: str | None) -> float | None:
    try:
        x = float(text) if text and text.strip() else math.nan
    except ValueError:
        return None
    return float(math.floor(x * 1000 + 0.5)) if math.isfinite(x) and x >= 0 else None


class _Reader:
    def __init__(self, out: Parsed, limits: Limits, shard: int):
        self.out, self.limits, self.shard = out, limits, shard
        self.depth = 0
        self.suites: list[tuple[str, str | None]] = []
        self.case: _Case | None = None
        self.texts: list[tuple[str, dict]] = []  # open text elements; the outermost collects
        self.parts: list[str] = []
        self.size, self.full = 0, False
        self.seen: dict[tuple, int] = {}
        self.done: list[dict] = []  # finished attempts that nobody has taken yet
        self.total = 0
        self.parser = p = expat.ParserCreate()
        p.buffer_text = True
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self.start, self.end, self.data
        p.StartDoctypeDeclHandler = self.doctype

    def take(self) -> list[dict]:
        out, self.done = self.done, []
        return out

    def at(self) -> str:
        return f"line {self.parser.CurrentLineNumber}"

    def doctype(self, *_: object) -> None:
        raise ParseError("XXE_DOCTYPE", "the report declares a document type", self.at(), "a test report needs none; reject this input")

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        self.depth += 1
        if self.depth > self.limits.max_depth:
            raise ParseError("DEPTH_LIMIT", f"elements nest deeper than {self.limits.max_depth}", self.at())
        if len(attrs) > self.limits.max_attributes:
            raise ParseError("ATTR_LIMIT", f"an element has more than {self.limits.max_attributes} attributes", self.at())
        tag, a = tag.lower(), {k.lower(): v for k, v in attrs.items()}
        name = lambda k: clip(a[k], self.limits.max_name) if k in a else None
        if tag == "testsuite":
            self.suites.append((name("name") or "", name("file")))
        elif tag == "testcase":
            if self.case:
                self.out.warn("NESTED_TESTCASE", "a testcase begins inside another", self.at())
                self.finish()
            file = name("file") or next((f for _, f in reversed(self.suites) if f), None)
            self.case = _Case(name("name") or "", name("classname") or "", file, milliseconds(a.get("time")))
        elif self.case and tag in _TEXTS:
            if not self.texts:
                self.parts, self.size, self.full = [], 0, False
            self.texts.append((tag, a))
        elif self.texts:
            self.texts.append((tag, a))

    def data(self, s: str) -> None:
        if not self.texts or self.full:
            return
        room = self.limits.max_text - self.size
        n = utf16(s)
        if n > room:
            self.out.warn("TEXT_TRUNCATED", f"text exceeds {self.limits.max_text} units", self.at())
            s, self.full = clip(s, room) + f"\n[truncated at {self.limits.max_text} units]", True
        self.parts.append(s)
        self.size += n

    def end(self, tag: str) -> None:
        self.depth -= 1
        tag = tag.lower()
        if self.texts and self.texts[-1][0] == tag:
            _, a = self.texts.pop()
            if not self.texts and self.case:
                self.close_text(tag, a, "".join(self.parts))
        elif tag == "testsuite" and self.suites:
            self.suites.pop()
        elif tag == "testcase" and self.case:
            self.finish()

    def close_text(self, tag: str, a: dict[str, str], text: str) -> None:
        case = self.case
        if tag in ("system-out", "system-err"):
            key = "stdout" if tag == "system-out" else "stderr"
            setattr(case, key, (getattr(case, key) or "") + text)
        elif tag == "skipped":
            case.outcomes.append(("skipped", None))
        elif tag in _RERUNS:
            case.reruns.append((_RERUNS[tag], self.failure(a, text)))
        else:
            case.outcomes.append((_OUTCOMES[tag], self.failure(a, text)))

    def failure(self, a: dict[str, str], text: str) -> dict:
        message = a.get("message", "")
        if utf16(message) > self.limits.max_text:
            self.out.warn("TEXT_TRUNCATED", f"a message exceeds {self.limits.max_text} units", self.at())
            message = clip(message, self.limits.max_text)
        if not message.strip():
            lines = text.strip().splitlines()
            message = lines[0] if lines else ""
        kind = clip(a["type"], self.limits.max_name) if "type" in a else None
        return failure(errorType=kind, message=message, stackText=text if text.strip() else None)

    def finish(self) -> None:
        case, self.case, self.texts = self.case, None, []
        path = [n for n, _ in self.suites if n]
        if case.classname and case.classname not in path:
            path.append(case.classname)
        steps = case.reruns + (case.outcomes or [("passed", None)])
        key = (*path, case.name)
        base = self.seen.get(key, 0)
        for i, (status, f) in enumerate(steps):
            self.done.append(attempt(
                shardIndex=self.shard, displayName=case.name, suitePath=path, filePath=case.file, attemptIndex=base + i, status=status,
                durationMs=case.duration if i == len(steps) - 1 else None, failure=f and f | {"stdout": case.stdout, "stderr": case.stderr},
            ))
        if base:
            self.out.warn("DUPLICATE_TESTCASE", f"testcase {case.name!r} appears again; recorded as attempt {base} on", self.at())
        self.seen[key] = base + len(steps)
        self.total += len(steps)
        if self.total > self.limits.max_attempts:
            raise ParseError("ATTEMPT_LIMIT", f"more than {self.limits.max_attempts} attempts", self.at(), "split the report")


#: Longest escape sequence that is removed; what could be the beginning of one waits for the next chunk.
_CARRY = 528
_PROLOG = re.compile(r"^\s*<\?xml[^>]*\?>")


def stream(chunks: Iterable[bytes], out: Parsed, shard: int = 0, skip_invalid: bool = False, limits: Limits = Limits()) -> Iterator[list[dict]]:
    """Attempts as they end, in document order, chunk by chunk; only the open testcase and a short carry are held. Warnings go
    to `out`. The result does not depend on where chunks are cut."""
    decoder = codecs.getincrementaldecoder("utf-8-sig")("replace")
    reader = _Reader(out, limits, shard)
    held, read, scrubbed, begun = "", 0, [0, 0], False

    def feed(text: str, last: bool) -> None:
        text, a = _ANSI.subn("", text)
        text, b = _ILLEGAL.subn("", text)
        scrubbed[0], scrubbed[1] = scrubbed[0] + a, scrubbed[1] + b
        reader.parser.Parse(text.encode("utf-8", "replace"), last)

    try:
        for chunk in itertools.chain(chunks, (None,)):
            last = chunk is None
            read += len(chunk or b"")
            if read > limits.max_bytes:
                raise ParseError("SIZE_LIMIT", f"the report exceeds {limits.max_bytes} bytes")
            held += decoder.decode(chunk or b"", last)
            if not begun:
                if len(held) < 4096 and not last:
                    continue
                held, begun = _PROLOG.sub("", held), True
            cut = -1 if last else held.find("\x1b", max(0, len(held) - _CARRY))
            text, held = (held, "") if cut < 0 else (held[:cut], held[cut:])
            feed(text, last)
            if reader.done:
                yield reader.take()
    except expat.ExpatError as e:
        if not skip_invalid:
            raise ParseError("XML_ERROR", str(e), reader.at(), "the upload was probably cut off; run the job again") from None
        out.warn("XML_ERROR", str(e), reader.at())
    if reader.case:
        out.warn("TRUNCATED_INPUT", "the report ends inside a testcase", reader.at())
        reader.finish()
    if sum(scrubbed):
        out.warn("CONTROL_CHARS_STRIPPED", f"{scrubbed[0]} escape sequences and {scrubbed[1]} control characters were removed")
    yield reader.take()


def parse(data: bytes, shard: int = 0, skip_invalid: bool = False, limits: Limits = Limits()) -> Parsed:
    """Attempts in document order, and warnings. Malformed documents raise unless skip_invalid; what was complete is kept."""
    out = Parsed()
    for some in stream((data,), out, shard, skip_invalid, limits):
        out.attempts += some
    return out


def confidence(path: str, head: bytes) -> float:
    """How sure it is that a file is a JUnit report, from its name and first 4 KiB."""
    text = head[:4096].decode("utf-8", "replace")
    xml = path.lower().endswith(".xml")
    if re.search(r"<\s*testsuites[\s>]", text, re.I):
        return 0.95
    if re.search(r"<\s*testsuite[\s>]", text, re.I):
        return 0.9
    if re.search(r"<\s*testcase[\s>]", text, re.I):
        return 0.75
    return 0.1 if xml and text.lstrip().startswith("<") else 0.0


CAPABILITIES = {
    "retries": True, "shards": False, "stdout": True, "stderr": True, "durations": True, "startTimes": False, "workers": False, "artifacts": False,
    "assertions": False, "filePaths": True,
}
