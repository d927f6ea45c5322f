"""Stack frames: line dialects, classification, deepest application frame, and framework detection.

Splitting and matching lines is one Arrow function over a column of stacks, with every pattern compiled once
per worker; framework detection is a chain of Spark regular expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Line shapes by dialect, in the order they are tried; fixed values.
DIALECTS = (
    ("python", r'^\s*File\s+"(?P<file>[^"]+)",\s+line\s+(?P<line>\d+)(?:,\s+in\s+(?P<fn>\S+))?'),
    ("pytest", r"^\s*(?P<file>[^\s:][^:\n]*\.py):(?P<line>\d+):\s*(?:in\s+(?P<fn>\S+)|[A-Za-z_][\w.]*)?\s*$"),
    ("jvm", r"^\s*at\s+(?P<fn>[\w$.<>]+)\((?:(?P<file>[\w$.-]+\.(?:java|kt|scala|groovy)):(?P<line>\d+)|[^)]*)\)"),
    ("ruby", r"^\s*(?:from\s+)?(?P<file>(?:[A-Za-z]:)?[^\s:]+\.rb):(?P<line>\d+):in\s+[`'](?P<fn>[^'`]+)['`]"),
    ("vitest", r"^\s*❯\s+(?:(?P<fn>\S.*?)\s+)?(?P<file>(?:[A-Za-z]:)?[^\s:]+):(?P<line>\d+):(?P<col>\d+)\s*$"),
    ("v8", r"^\s*at\s+(?:(?P<fn>[^()]+?)\s+\()?(?P<file>[^()\s][^()]*?)(?::(?P<line>\d+)(?::(?P<col>\d+))?)?\)?\s*$"),
    ("go", r"^\s*(?P<file>(?:[A-Za-z]:)?[^\s:]+\.go):(?P<line>\d+)(?:\s+\+0x[0-9a-f]+)?\s*$"),
)
#: Paths and names that mark test code, vendored code and runners; fixed values.
TEST_GLOBS = (
    "**/test/**", "**/tests/**", "**/__tests__/**", "**/spec/**", "**/e2e/**", "**/*.test.*", "**/*.spec.*", "**/*_test.*", "**/test_*.py",
    "**/*Test.java", "**/*Tests.java", "**/*IT.java", "**/*_spec.rb",
)
VENDOR_DIRS = ("node_modules", "site-packages", "dist-packages", "vendor", ".venv", "venv", ".tox", ".gradle", ".m2", "go/pkg/mod")
RUNTIME = r"^(?:node|internal):|^(?:java|javax|jdk|sun|kotlin|scala)\.|^/usr/lib/(?:python|jvm)"
RUNNERS_ANY_CASE = r"(?:^|[/\\])(?:(?:playwright|jest|mocha|jasmine|cypress|rspec|vitest)(?:[/\\-]|$)|@(?:playwright|jest)(?:[/\\]|$))"
RUNNERS = r"(?:^|[/\\])(?:(?:_pytest|pluggy)(?:[/\\]|$)|unittest(?:[/\\.]|$))|^(?:org\.junit|org\.testng|junit)\.|^testing\.(?:tRunner|runTests)"
#: What a line of each dialect cannot do without, to look for before its pattern is tried; "at" is what it begins with.
_NEEDS = {"python": "File", "pytest": ".py:", "jvm": "at", "ruby": ".rb:", "vitest": "❯", "v8": "at", "go": ".go:"}
_PARSERS = tuple((name, _NEEDS[name], re.compile(p, re.ASCII)) for name, p in DIALECTS)
FRAME = T.StructType([
    T.StructField("raw", T.StringType()), T.StructField("function_name", T.StringType()), T.StructField("file", T.StringType()),
    T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType()), T.StructField("kind", T.StringType()),
])


def glob_regex(glob: str) -> str:
    """`**/` is any number of segments, `**` anything, `*` and `?` stay within one; open at the start, closed at the end."""
    # as the start is open, a leading `**/` says nothing more
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", glob.removeprefix("**/"))
    special = {"**/": "(?:[^/]+/)*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "(?:^|/)" + "".join(special.get(p, re.escape(p)) for p in parts) + r"\Z"


class Classifier:
    """framework, test, app or unknown, by path and function name."""

    def __init__(self, test_globs: Iterable[str] = TEST_GLOBS, vendor_dirs: Iterable[str] = ()):
        dirs = "|".join(re.escape(d) for d in (*VENDOR_DIRS, *vendor_dirs))
        self.framework = re.compile(rf"(?:^|/)(?:{dirs})/|{RUNTIME}|(?i:{RUNNERS_ANY_CASE})|{RUNNERS}")
        self.test = re.compile("|".join(glob_regex(g) for g in test_globs))
        # paths and names come again and again; what each is by itself is remembered
        self.of_path = lru_cache(maxsize=1 << 15)(self._of_path)
        # every alternative begins at the start or behind a separator: without one, only the start needs a look
        self.is_runner = lru_cache(maxsize=1 << 15)(lambda name: bool(self.framework.search(name) if "/" in name or "\\" in name else self.framework.match(name)))

    def _of_path(self, path: str) -> str:
        if self.framework.search(path):
            return "framework"
        return "test" if self.test.search(path) else "app"

    def __call__(self, file: str | None, name: str | None) -> str:
        path = (file or "").replace("\\", "/")
        kind = self.of_path(path) if path else "unknown"
        return "framework" if kind != "framework" and name and self.is_runner(name) else kind


@lru_cache(maxsize=16)
def _classifier(globs: tuple[str, ...], vendor: tuple[str, ...]) -> Classifier:
    return Classifier(globs, vendor)


def _function_name(fn: str | None) -> str | None:
    fn = (fn or "").strip()
    return re.sub(r"^(?:async|new)\s+", "", fn) if fn and fn != "<anonymous>" else None


@lru_cache(maxsize=1 << 16)
def _frame(line: str, globs: tuple[str, ...], vendor: tuple[str, ...]) -> tuple[str, tuple] | None:
    begins = line.lstrip().startswith("at")
    for dialect, needs, pattern in _PARSERS:
        if not (begins if needs == "at" else needs in line):
            continue
        m = pattern.search(line)
        if not m:
            continue
        g = m.groupdict()
        file = g.get("file")
        if dialect == "v8" and file is not None and not re.search(r"[/\\.]", file):
            return None  # prose that begins with "at"
        name = _function_name(g.get("fn"))
        number = lambda k: int(g[k]) if g.get(k) and len(g[k]) < 10 else None
        return dialect, (line, name, file, number("line"), number("col"), _classifier(globs, vendor)(file, name))
    return None


def parse_stack(stack: str | None, globs: tuple[str, ...] = TEST_GLOBS, vendor: tuple[str, ...] = ()) -> list[tuple]:
    """Frames (raw, function_name, file, line, column, kind), innermost first."""
    found = [f for line in re.split(r"\r\n|\r|\n", stack or "") if line.strip() and (f := _frame(line, globs, vendor))]
    python = sum(d in ("python", "pytest") for d, _ in found)
    frames = [f for _, f in found]
    return frames[::-1] if python and python >= len(frames) / 2 else frames


def frames(stack: Column | str, test_globs: tuple[str, ...] = TEST_GLOBS, vendor_dirs: tuple[str, ...] = ()) -> Column:
    """array<struct<raw, function_name, file, line, column, kind>> of a stack text; empty for null."""

    @F.pandas_udf(T.ArrayType(FRAME))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: parse_stack(x, tuple(test_globs), tuple(vendor_dirs)))

    return run(stack)


def frame_summary(stack: Column | str, test_globs: tuple[str, ...] = TEST_GLOBS, vendor_dirs: tuple[str, ...] = ()) -> Column:
    """struct(n_frames, n_app, deepest_app, deepest_line): what reports need, without shipping the frames back."""
    kind = T.StructType([T.StructField("n_frames", T.IntegerType()), T.StructField("n_app", T.IntegerType()), T.StructField("deepest_app", T.StringType()), T.StructField("deepest_line", T.IntegerType())])

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            fs = parse_stack(x, tuple(test_globs), tuple(vendor_dirs))
            app = [f for f in fs if f[5] == "app"]
            rows.append((len(fs), len(app), app[0][2] if app else None, app[0][3] if app else None))
        return pd.DataFrame(rows, columns=["n_frames", "n_app", "deepest_app", "deepest_line"]).astype({"deepest_line": "Int32"})

    return run(stack)


def app_frames(fs: Column) -> Column:
    return F.filter(fs, lambda f: f["kind"] == "app")


def deepest_app_frame(fs: Column) -> Column:
    return F.try_element_at(app_frames(fs), F.lit(1))


#: Framework by shape first, then by name; (framework, subject, pattern) in order of precedence. Fixed values.
DETECTION = (
    ("vitest", "stack", r"(?m)^\s*❯\s"),
    ("junit-jvm", "stack", r"(?m)^\s*at\s+[\w$.@/]+\([\w$ .-]+\.(?:java|kt|kts|scala|groovy):\d+\)"),
    ("junit-jvm", "type", r"(?<!\w)(?:org\.opentest4j|org\.junit|junit\.framework|org\.testng|org\.assertj|org\.hamcrest|org\.mockito|java\.lang\.|java\.base/|jakarta\.|javax\.)"),
    ("pytest", "stack", r'(?m)^\s*File "[^"]+\.py", line \d+|^\s*[\w./\\-]+\.py:\d+:\s+in\s+\S'),
    ("rspec", "stack", r"(?m)^\s*(?:from\s+)?[\w./-]+\.rb:\d+:in\s"),
    ("playwright", "all", r"(?i)node_modules[\\/](?:@playwright[\\/])?playwright|@playwright/test|playwright-core"),
    ("jest", "all", r"(?i)node_modules[\\/](?:@jest[\\/]|jest-)"),
    ("vitest", "all", r"(?i)node_modules[\\/]vitest|(?<!\w)vitest(?!\w)"),
    ("cypress", "all", r"(?i)node_modules[\\/]cypress|(?<!\w)cypress(?!\w)"),
    ("mocha", "all", r"(?i)node_modules[\\/]mocha|(?<!\w)mocha(?!\w)"),
    ("pytest", "all", r"(?mi)site-packages/_pytest|(?<!\w)pytest(?!\w)|^E\s{2,}\w"),
    ("go-test", "stack", r"(?m)^\s*[\w./\\-]+\.go:\d+(?::\d+)?(?!\w)|^\s*Error Trace:\s|(?<!\w)testify(?!\w)"),
    ("go-test", "all", r"(?<!\w)testing\.T(?!\w)|(?<!\w)go test(?!\w)"),
    ("junit-jvm", "all", r"(?i)(?<!\w)surefire(?!\w)"),
    ("rspec", "all", r"(?i)rspec|_spec\.rb"),
    ("jest", "all", r"expect\((?:received|jest\.fn\(\))\)\.|(?<!\w)expect\(received\)\.to\w+\(expected\)"),
    ("playwright", "all", r"(?i)(?<!\w)playwright(?!\w)"),
    ("jest", "all", r"(?i)(?<!\w)jest(?!\w)"),
)
#: What every pattern over the whole text contains.
NAMED = r"(?mi)playwright|jest|vitest|cypress|mocha|pytest|testing\.T|go test|surefire|rspec|_spec\.rb|expect\(|^E\s{2,}\w"


def detect_framework(source_file: Column | str = "sourceFile", stack: Column | str = "stackText", error_type: Column | str = "errorType") -> Column:
    c = lambda x: F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))
    subject = {"stack": c(stack), "type": c(error_type), "all": F.concat(c(source_file), F.lit("\n"), c(stack), F.lit("\n"), c(error_type))}

    def chain(wheres: tuple[str, ...]) -> Column:
        out = F
        for name, where, pattern in DETECTION:
            if where in wheres:
                out = out.when(subject[where].rlike(pattern), name)
        return out.otherwise("unknown")

    # most texts name no framework: one look decides whether the patterns over the whole text are tried at all
    return F.when(subject["all"].rlike(NAMED), chain(("stack", "type", "all"))).otherwise(chain(("stack", "type")))


def framework_or_adapter(detected: Column, adapter: Column | str = "producerAdapter", default: str = "unidentified") -> Column:
    """An unknown framework is the adapter's where the adapter names one."""
    adapter = F.col(adapter) if isinstance(adapter, str) else adapter
    return F.when(detected != "unknown", detected).when(adapter == "playwright", adapter).otherwise(default)
