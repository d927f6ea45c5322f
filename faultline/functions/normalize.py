"""Normalisation of failure texts: an ordered cascade of rewrite rules, repeated to a fixed point.

The cascade runs over the distinct texts of an Arrow batch, in Python with patterns compiled once per worker.
A text's marks (a digit, a colon, an `@` and the like) choose the rewrites that can touch it at all, and a
costly pattern is tried only where a part of it that is found fast is there. The rules
before the first loose one are the same in both modes, so a text's first pass through them is made once.

Lengths in the patterns count characters; a character beyond U+FFFF counts as one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import partial

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = 4
MAX_PASSES = 8
_KNOWN_TEXTS = 50_000
_A, _I = re.ASCII, re.ASCII | re.IGNORECASE
_BLANKS = "\t\n\x0b\x0c\r \xa0                　﻿"
_W = r"\t\n\x0b\x0c\r \xa0  -     　﻿"  # body of a class of white space

# ---- patterns; fixed values ----------------------------------------------------------------------
ANSI = r"\x1b(?:\[[0-9;:?]*[ -/]*[@-~]|\][^\x07\x1b]{0,512}(?:\x07|\x1b\\)|[@-Z\\-_])"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
SPACES = r"[ \t\xa0]{2,}"
UUID = r"\b[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b"
ULID = r"\b[0-7][0-9A-HJKMNP-TV-Z]{25}\b"
OBJECT_ID = r"\b[0-9a-f]{24}\b"
LONG_HEX = r"\b[0-9a-f]{32,}\b"
HEX_ADDRESS = r"\b0x[0-9a-f]{4,}\b"
ISO_TIME = r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?(?:Z|[+-]\d{2}:?\d{2})?"
EPOCH_MS = r"\b1\d{12}\b"
EPOCH_S = r"\b1\d{9}\b"
DURATION = rf"\b\d+(?:\.\d+)?[{_W}]?(?:ms|[\xb5μΜ]s|us|ns|s|m|h)\b"
_STOP = rf"[^{_W}'\"`,;)\]]*"
TEMP_PATH = rf"(?:/private)?/tmp/{_STOP}|/var/folders/{_STOP}|%TEMP%{_STOP}|[A-Z]:\\+(?:Users\\+[^\\{_W}]+\\+AppData\\+Local\\+Temp|Temp)\\+{_STOP}"
HOME = rf"/(?:home|Users)/[^/{_W}'\"`,;)\]]+"
HOME_WINDOWS = rf"[A-Za-z]:\\+Users\\+[^\\{_W}]+"
URL_QUERY = rf"(\bhttps?://[^{_W}'\"`<>]*?)\?[^{_W}'\"`<>]*"
URL_NUMBER = rf"(\bhttps?://[^{_W}'\"`<>]*?)/\d+(?=/|\b)"
IPV6 = r"\b(?:[0-9a-f]{1,4}:){2,7}(?::|[0-9a-f]{1,4})\b"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
PORT = r":\d{2,5}\b(?!\.\d)"
PORT_AFTER = ("<ip>", "]", r"\blocalhost", r"//[A-Za-z0-9._-]{1,253}")
EMAIL = r"\b[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,253}\.[A-Za-z]{2,24}\b"
GENERATED_DOMAIN = r"@(?:example|test|invalid|localhost|mailinator|faker)\.[A-Za-z.]+\Z"
GENERATED_LOCAL = r"\d{3,}|[0-9a-f]{8,}"
GENERATED_NAME = r"\b(?:user|test|fixture|acct|account|tenant|org|customer)[-_]\d+\b"
COUNTER = r"\b(?:worker|shard|attempt|retry|thread|proc|process|job|chunk)[-_ ]?#?\d+\b"
LINE_COLUMN = r"(\.[A-Za-z0-9]{1,6}):\d+(?::\d+)?\b"
QUOTED = r"'[^'\n]{0,120}'|\"[^\"\n]{0,120}\"|`[^`\n]{0,120}`"
NUMBER = r"(?<![\w<])-?\d+(?:\.\d+)?(?![\w>])"
_VALUE = rf"(?:{QUOTED}|[-+]?\d+(?:\.\d+)?(?![\w.])|true|false|null|undefined|NaN|[^{_W}]{{1,60}})"
EXPECTED = rf"\b([eE]xpected)[{_W}]*:[{_W}]*{_VALUE}"
RECEIVED = rf"\b([rR]eceived|[aA]ctual)[{_W}]*:[{_W}]*{_VALUE}"
GOT = rf"\b(got|received)[{_W}]+{_VALUE}"
BLANK_LINES = r"\n{3,}"
# --------------------------------------------------------------------------------------------------

Rewrite = Callable[[str], str]
#: Characters a rewrite may ask for; "0" stands for any digit.
_MARKS = "\x1b\r-:@?\\/.\n"
_digit = re.compile(r"\d", _A).search
_odd = re.compile(CONTROL).search


@dataclass(frozen=True)
class Step:
    """A rewrite, and the marks without which it changes nothing. No rewrite brings a mark into a text that has none
    of it, so the marks of a text hold for a whole pass."""

    needs: str
    rewrite: Rewrite


@dataclass(frozen=True)
class Rule:
    id: str
    make: Callable[[str | None, str | None], list[Step]]
    loose_only: bool = False


def _step(pattern: str, new: str | Callable, needs: str = "", flags: int = _A, look: str | None = None, look_flags: int = _A) -> Step:
    """look: a pattern that is found fast and must be there."""
    run = partial(re.compile(pattern, flags).sub, new)
    if look is None:
        return Step(needs, run)
    there = re.compile(look, look_flags).search
    return Step(needs, lambda s: run(s) if there(s) else s)


def _rule(id: str, *steps: Step, loose_only: bool = False) -> Rule:
    return Rule(id, lambda root, home: list(steps), loose_only)


def _marks(s: str) -> str:
    found = "".join([c for c in _MARKS if c in s])
    return found + "0" if _digit(s) else found


_HOST_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._-"
_LOCALHOST = re.compile(r"\blocalhost\Z", _A)


def _after_host(m: re.Match) -> str:
    before = m.string[max(0, m.start() - 256) : m.start()]
    if before.endswith(("<ip>", "]")) or _LOCALHOST.search(before):
        return ":<port>"
    rest = before.rstrip(_HOST_CHARS)
    return ":<port>" if rest.endswith("//") and 1 <= len(before) - len(rest) <= 253 else m.group()


_CONTROL_SUB = re.compile(CONTROL).sub
_DOMAIN, _LOCAL = re.compile(GENERATED_DOMAIN, _I), re.compile(GENERATED_LOCAL, _I)


def _generated(m: re.Match) -> str:
    """The whole address decides: a reserved domain to its end, or a counter or blob before the @."""
    address = m.group()
    return "<gen>" if _DOMAIN.search(address) or _LOCAL.search(address.rpartition("@")[0]) else address


def _literal(old: str | None, new: str, strip: bool) -> list[Step]:
    if not old:
        return []
    old = old.removesuffix("/") + ("/" if strip else "")
    return [Step("", lambda s: s.replace(old, new))]


_blank_lines = re.compile(BLANK_LINES).sub


def _trim(s: str) -> str:
    if "\n" in s:
        s = "\n".join([line.rstrip(_BLANKS) for line in s.split("\n")])
        if "\n\n\n" in s:
            s = _blank_lines("\n\n", s)
    return s.strip(_BLANKS)


#: Ids and order are fixed values.
RULES = (
    _rule("ansi-control", _step(ANSI, "", "\x1b"), Step("", lambda s: _CONTROL_SUB("", s) if _odd(s) else s)),
    _rule("whitespace-canonical", _step(r"\r\n?", "\n", "\r"), _step(SPACES, " ")),
    _rule("uuid", _step(UUID, "<id>", "-0", _I, r"-[1-8][0-9A-Fa-f]{3}-[89ABab]")),
    _rule("ulid", _step(ULID, "<id>", "0", look=r"\d[0-9A-Z]{25}")),
    _rule("object-id", _step(OBJECT_ID, "<id>", "", _I, r"[0-9A-Fa-f]{24}")),
    _rule("long-hex", _step(LONG_HEX, "<id>", "", _I, r"[0-9A-Fa-f]{32}")),
    _rule("hex-address", _step(HEX_ADDRESS, "<addr>", "0", _I, r"0[xX]")),
    _rule("iso-timestamp", _step(ISO_TIME, "<ts>", "-:0", look=r":\d\d:\d\d")),
    _rule("epoch-ms", _step(EPOCH_MS, "<ts>", "0", look=r"1\d{12}")),
    _rule("epoch-s", _step(EPOCH_S, "<ts>", "0", look=r"1\d{9}")),
    _rule("duration", _step(DURATION, "<dur>", "0", _I)),
    _rule("temp-path", _step(TEMP_PATH, "<tmp>", "", _I, r"/tmp/|/var/folders/|%temp%|temp\\", _I)),
    Rule("repo-path", lambda root, home: _literal(root, "", True)),
    Rule("home-dir", lambda root, home: [*_literal(home, "<home>", False), _step(HOME, "<home>", "/", look=r"/(?:home|Users)/"), _step(HOME_WINDOWS, "<home>", "\\:")]),
    _rule("url-query", _step(URL_QUERY, r"\1", "?:/", _I)),
    _rule("url-numeric-segment", _step(URL_NUMBER, r"\1/<n>", ":/0", _I, r"://")),
    _rule("ipv6", _step(IPV6, "<ip>", ":", _I, r":[0-9A-Fa-f]{0,4}:")),
    _rule("ipv4", _step(IPV4, "<ip>", ".0", look=r"\.\d{1,3}\.\d")),
    _rule("port", _step(PORT, _after_host, ":0")),
    _rule("generated-email", _step(EMAIL, _generated, "@.")),
    _rule("generated-name", _step(GENERATED_NAME, "<gen>", "0", _I, r"[-_]\d")),
    _rule("worker-counter", _step(COUNTER, "<n>", "0", _I)),
    _rule("stack-line-col", _step(LINE_COLUMN, r"\1", ".:0"), loose_only=True),
    _rule("assertion-values", _step(EXPECTED, r"\1: <val>", ":", look="xpected"), _step(RECEIVED, r"\1: <val>", ":", look="eceived|ctual"), _step(GOT, r"\1 <val>", "", _I, "got|received", _I), loose_only=True),
    _rule("assertion-literals", _step(QUOTED, "<val>"), _step(NUMBER, "<val>", "0"), loose_only=True),
    _rule("whitespace-trim", Step("", _trim)),
)
RULE_IDS = tuple(r.id for r in RULES)


class Normalizer:
    """Normal forms of texts; forms of recent texts are remembered, up to a fixed number."""

    def __init__(self, disabled: Iterable[str] = (), repo_root: str | None = None, home_dir: str | None = None, passes: int = MAX_PASSES):
        off = set(disabled)
        if unknown := off - set(RULE_IDS):
            raise ValueError(f"no such rule: {', '.join(sorted(unknown))}")
        on = [r for r in RULES if r.id not in off]
        first_loose = next((i for i, r in enumerate(on) if r.loose_only), len(on))
        steps = lambda rules: [f for r in rules for f in r.make(repo_root, home_dir)]
        self.parts = {"shared": steps(on[:first_loose]), "strict": steps(r for r in on[first_loose:] if not r.loose_only), "loose": steps(on[first_loose:])}
        self.plans: dict[tuple[str, str], list[Rewrite]] = {}
        self.passes = passes
        self.known: dict[tuple[str, str], str] = {}

    def _run(self, text: str, part: str, marks: str) -> str:
        plan = self.plans.get((part, marks))
        if plan is None:
            plan = self.plans[part, marks] = [f.rewrite for f in self.parts[part] if set(f.needs) <= set(marks)]
        for rewrite in plan:
            text = rewrite(text)
        return text

    def forms(self, text: str, modes: tuple[str, ...] = ("strict", "loose")) -> list[str]:
        """The form of a text in each mode."""
        out, start, marks = [], None, ""
        for mode in modes:
            known = self.known.get((mode, text))
            if known is None:
                if start is None:
                    marks = _marks(text)
                    start = self._run(text, "shared", marks)
                known = self._fixed(text, start, mode, marks)
                if len(self.known) >= _KNOWN_TEXTS:
                    self.known.clear()
                self.known[mode, text] = known
            out.append(known)
        return out

    def _fixed(self, text: str, start: str, mode: str, marks: str) -> str:
        new = self._run(start, mode, marks)
        for _ in range(self.passes - 1):
            if new == text:
                return new
            text, marks = new, _marks(new)
            new = self._run(self._run(new, "shared", marks), mode, marks)
        return new

    def form(self, text: str, mode: str) -> str:
        return self.forms(text, (mode,))[0]


_WORKER: dict[tuple, Normalizer] = {}


def worker_normalizer(*args) -> Normalizer:
    """One normaliser per worker process and set of options."""
    if args not in _WORKER:
        _WORKER[args] = Normalizer(*args)
    return _WORKER[args]


def normalize(text: Column | str, mode: str = "loose", disabled: tuple[str, ...] = (), repo_root: str | None = None, home_dir: str | None = None, passes: int = MAX_PASSES) -> Column:
    """The text after the cascade's fixed point. Unknown ids in `disabled` are an error; null stays null."""
    if mode not in ("strict", "loose"):
        raise ValueError("mode is strict or loose")
    args = (tuple(disabled), repo_root, home_dir, passes)
    Normalizer(*args)  # bad options fail here, not on an executor

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        n = worker_normalizer(*args)
        return s.map(lambda x: None if x is None else n.form(x, mode))

    return run(text)


def normalize_both(text: Column | str, disabled: tuple[str, ...] = (), repo_root: str | None = None, home_dir: str | None = None) -> Column:
    """struct(strict, loose) of one text; the rules both modes share run once."""
    args = (tuple(disabled), repo_root, home_dir)
    Normalizer(*args)

    @F.pandas_udf("strict string, loose string")
    def run(s: pd.Series) -> pd.DataFrame:
        n = worker_normalizer(*args)
        return pd.DataFrame([(None, None) if x is None else n.forms(x) for x in s], columns=["strict", "loose"])

    return run(text)
