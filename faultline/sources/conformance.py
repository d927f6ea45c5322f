"""A kit that tells whether a report adapter keeps its contract, on inputs that break parsers and on the adapter's own.

An adapter is a module or object with NAME, CAPABILITIES, confidence(path, head), parse(data, shard, skip_invalid, limits) and, if it
reads in chunks, stream(chunks, out, shard, skip_invalid, limits)."""

from __future__ import annotations

import json
import math
import re
import time
from collections.abc import Iterable
from dataclasses import dataclass

from faultline.sources.model import Limits, Parsed, ParseError

CHUNKS = (1, 7, 4096, 1 << 20)
SECONDS = 5.0
_UNSAFE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
#: What an attempt may only carry if the adapter says so: capability, and where it would show.
_DECLARED = (
    ("durations", lambda a: a["durationMs"] is not None), ("workers", lambda a: a["workerId"] is not None), ("startTimes", lambda a: a["startedAt"] is not None),
    ("artifacts", lambda a: bool(a["failure"] and a["failure"]["artifacts"])), ("stdout", lambda a: bool(a["failure"] and a["failure"]["stdout"])),
    ("stderr", lambda a: bool(a["failure"] and a["failure"]["stderr"])), ("filePaths", lambda a: a["filePath"] is not None),
)


@dataclass(frozen=True)
class Finding:
    case: str
    check: str
    detail: str


def hostile_inputs() -> dict[str, bytes]:
    """Shapes that no format is made for: nothing, too little, the wrong thing, controls, depth, length, broken encodings."""
    esc = b"\x1b"
    return {
        "empty": b"", "blanks": b" \n\t\r\n ", "one byte": b"z", "prose": b"this is no report\nat all\n", "nul": b"p\x00q", "half a surrogate": b"p\xed\xa0\x80q", "bad utf-8": b"\xff\xfe\xc3",
        "lone escape": b"p" + esc + b"q", "title without end": b"p" + esc + b"]" + b"T" * 3000, "colours": (esc + b"[32m" + esc + b"[0m") * 400,
        "brackets": b"[" * 6000, "angles": b"<a>" * 6000, "one long line": b"z" * 250_000, "line feeds": b"\n" * 60_000, "mark then prose": "\ufeffno report".encode(),
    }


def _attempts(adapter, data: bytes, size: int) -> list[dict]:
    if hasattr(adapter, "stream"):
        out = Parsed()
        chunks = (data[i : i + size] for i in range(0, len(data), size))
        return [a for some in adapter.stream(chunks, out, 0, True, Limits()) for a in some]
    return adapter.parse(data, 0, True, Limits()).attempts


def _contract(a: dict, declared: dict[str, bool]) -> Iterable[tuple[str, str]]:
    if not isinstance(a["displayName"], str) or not isinstance(a["suitePath"], list):
        yield "contract", "displayName is a text and suitePath a list"
    for n in ("attemptIndex", "shardIndex"):
        if not isinstance(a[n], int) or a[n] < 0:
            yield "contract", f"{n} is {a[n]!r}"
    d = a["durationMs"]
    if d is not None and (not math.isfinite(d) or d < 0):
        yield "contract", f"durationMs is {d}"
    if a["failure"] is not None and not isinstance(a["failure"]["message"], str):
        yield "contract", "a failure's message is a text"
    printed = "".join([a["displayName"], *a["suitePath"], (a["failure"] or {}).get("message") or ""])
    if _UNSAFE.search(printed):
        yield "terminal safety", "a control character is left in what gets printed"
    for name, shows in _DECLARED:
        if not declared.get(name) and shows(a):
            yield "capabilities", f"{name} is there but not declared"


def findings(adapter, own: dict[str, bytes] | None = None, seconds: float = SECONDS) -> list[Finding]:
    """What breaks the contract; an empty list if nothing does. `own` are inputs in the adapter's format."""
    out: list[Finding] = []
    declared = adapter.CAPABILITIES
    if declared.get("assertions") and not declared.get("stdout"):
        out.append(Finding("(capabilities)", "capabilities", "structured assertions without any output are unlikely"))
    for path, head in (("gone/nothing", b""), ("a.xml", b"\xff\x00"), ("a.json", b"{")):
        try:
            score = adapter.confidence(path, head)
            if not 0 <= score <= 1:
                out.append(Finding("(confidence)", "confidence", f"{path} scores {score}"))
        except Exception as e:
            out.append(Finding("(confidence)", "confidence", f"{path}: {e}"))
    for name, data in {**hostile_inputs(), **(own or {})}.items():
        shapes = set()
        for size in CHUNKS if hasattr(adapter, "stream") else CHUNKS[-1:]:
            if len(data) // size > 100_000:
                continue  # a call per byte of a long input times the loop, not the adapter
            case, began = f"{name} by {size}", time.perf_counter()
            try:
                rows = _attempts(adapter, data, size)
                shapes.add(json.dumps([[a[k] for k in ("displayName", "suitePath", "status", "attemptIndex", "durationMs")] for a in rows]))
                out += {Finding(case, *x) for a in rows for x in _contract(a, declared)}
            except ParseError as e:
                shapes.add(e.code)
            except Exception as e:
                out.append(Finding(case, "errors", f"{type(e).__name__} instead of a ParseError: {str(e)[:80]}"))
            if (took := time.perf_counter() - began) > seconds:
                out.append(Finding(case, "time", f"{took:.1f} s"))
        if len(shapes) > 1:
            out.append(Finding(name, "chunks", "the result depends on where the input is cut"))
    return out
