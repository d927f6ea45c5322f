"""Sinks other than tables: reports as text, a self-contained ledger page, a managed block in an ignore file, JSON."""

from __future__ import annotations

import json
import math
import os
import re

from pyspark.sql import DataFrame

LEDGER_FIELDS = ("entryId", "repo", "workflow", "commit", "test", "suite", "file", "status", "attempt", "durationMs", "errorType", "message", "stack", "stdout", "note")
BEGIN, END = "# held out of the repository, managed", "# end of managed block"


def plain(x: object) -> object:
    """JSON has no NaN: it becomes null."""
    if isinstance(x, float) and not math.isfinite(x):
        return None
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x


def write_json(obj: object, path: str) -> None:
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        json.dump(plain(obj), f, ensure_ascii=False, indent=1, default=str)
    os.replace(f"{path}.new", path)


def rows(df: DataFrame) -> list[dict]:
    """For reports and snapshots, whose tables are small by construction."""
    return [plain(r.asDict(recursive=True)) for r in df.collect()]


def text_table(df: DataFrame, digits: int = 3) -> str:
    """A report as aligned text; numbers keep `digits` decimals, what is undefined reads n/a."""
    data = df.collect()

    def cell(v: object) -> str:
        if v is None or isinstance(v, float) and math.isnan(v):
            return "n/a"
        return f"{v:.{digits}f}" if isinstance(v, float) else str(v)

    lines = [df.columns, *([cell(v) for v in r] for r in data)]
    width = [max(len(r[i]) for r in lines) for i in range(len(df.columns))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, width)).rstrip() for r in lines)


def embed_json(obj: object) -> str:
    """JSON that can stand inside a script element."""
    s = json.dumps(plain(obj), ensure_ascii=False, default=str).replace("</", "<\\/")
    return s.replace("\ufffd", "\\ufffd").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")


_PAGE = """<!doctype html><meta charset="utf-8"><title>{title}</title>
<style>body{{font:14px sans-serif;margin:2em}}pre{{background:#f4f4f4;padding:.6em;overflow:auto}}</style>
<h1>{title}</h1><main></main><script type="application/json" id="data">{data}</script>
<script>const entries = JSON.parse(document.getElementById("data").textContent);
for (const e of entries) {{ const s = document.createElement("section"), h = document.createElement("h2"), p = document.createElement("pre");
 h.textContent = e.entryId + " " + (e.test || ""); p.textContent = Object.entries(e).filter(([k, v]) => v !== null).map(([k, v]) => k + ": " + v).join("\\n");
 s.append(h, p); document.querySelector("main").append(s); }}</script>
"""


def ledger_page(sheet: DataFrame, title: str = "Failures to label") -> str:
    """The sheet as one page without outside references; only known fields are taken over."""
    keep = [c for c in LEDGER_FIELDS if c in sheet.columns]
    return _PAGE.format(title=title, data=embed_json(rows(sheet.select(*keep).orderBy("entryId"))))


def ignore_block(existing: str, paths: list[str]) -> str:
    """The text with its managed block replaced; what stands outside the block stays."""
    block = "\n".join([BEGIN, *sorted(set(paths)), END]) + "\n"
    found = re.compile(re.escape(BEGIN) + r".*?" + re.escape(END) + r"\n?", re.S)
    if found.search(existing):
        return found.sub(lambda _: block, existing, count=1)
    return existing + ("" if not existing or existing.endswith("\n") else "\n") + block


def run_header(run: dict, failures: int) -> str:
    """A run in a few lines, for a prompt or a report; what is unknown is left out."""
    source = run.get("source") or {}
    known = ((k, source.get(n)) for k, n in (("repository", "repo"), ("workflow", "workflowName"), ("event", "event"), ("branch", "headBranch"), ("commit", "headSha"), ("url", "url")))
    return "\n".join([f"run {run['corpusRunId']}, {failures} failure(s)", *(f"  {k}: {v}" for k, v in known if v)])


def head_and_tail(text: str | None, head: int = 12, tail: int = 8, last: bool = False) -> str:
    """The first lines of a stack, or the last lines of output, for a label prompt."""
    lines = re.split(r"\r\n|\r|\n", text or "")
    return "\n".join(lines[-tail:] if last else lines[:head])
