"""Text scalars as Spark columns: UTF-16 lengths, clipping, truncation, sanitising, small parsers.

Lengths and cuts count UTF-16 code units where a rule is stated in them; strings without astral characters
(the usual case) take the cheap path, where units and characters agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Body of a character class: what counts as white space; a fixed value.
WS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: Escape sequences: CSI, OSC of at most 512 units, two-character ones; fixed values.
ANSI = r"\x1B(?:\[[0-9;:?]*[ -/]*[@-~]|\][^\x07\x1B]{0,512}(?:\x07|\x1B\\)|[@-Z\\-_])"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
BIDI = r"[\x{61C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]"
FIELD_CAP = 64 * 1024
TRUNCATABLE = ("message", "stackText", "stdout", "stderr")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def units(s: Column | str) -> Column:
    """Length in UTF-16 code units."""
    s = _c(s)
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")


def _slice(s: Column, start: Column, n: Column) -> Column:
    """n units from the 0-based unit `start`. A cut inside a surrogate pair drops the half pair."""
    wide = F.encode(s, "UTF-16BE")
    part = F.substring(wide, start * 2 + 1, n * 2)
    size = F.octet_length(part)
    first, last = F.hex(F.substring(part, F.lit(1), F.lit(1))), F.hex(F.substring(part, size - 1, F.lit(1)))
    skip = F.when(first.between("DC", "DF"), 2).otherwise(0)
    cut = F.decode(F.substring(part, skip + 1, size - skip - F.when(last.between("D8", "DB"), 2).otherwise(0)), "UTF-16BE")
    return F.when(units(s) == F.length(s), F.substring(s, start + 1, n)).otherwise(cut)


def clip(s: Column | str, n: int) -> Column:
    """The first n units."""
    s = _c(s)
    return F.when(units(s) <= n, s).otherwise(_slice(s, F.lit(0), F.lit(n)))


def sanitize_terminal(s: Column | str, marker: str = "�") -> Column:
    """Safe to print: CRLF folds to LF; lone CR, escape sequences and controls become the marker; bidi marks become <bidi>."""
    out = F.regexp_replace(_c(s), r"\r\n", "\n")
    for pattern in (r"\r", ANSI, CONTROL):
        out = F.regexp_replace(out, pattern, marker)
    return F.regexp_replace(out, BIDI, "<bidi>")


def has_terminal_hazard(s: Column | str) -> Column:
    return _c(s).rlike(rf"\r(?!\n)|\r\n|{ANSI}|{CONTROL}|{BIDI}")


def scrub_xml(s: Column | str) -> Column:
    """struct(text, n_ansi, n_control): escape sequences and characters illegal in XML removed and counted."""
    s = _c(s)
    plain = F.regexp_replace(s, ANSI, "")
    illegal = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"
    return F.struct(F.regexp_replace(plain, illegal, "").alias("text"), F.regexp_count(s, F.lit(ANSI)).alias("n_ansi"), F.regexp_count(plain, F.lit(illegal)).alias("n_control"))


def _marker(n: Column) -> Column:
    return F.concat(F.lit("\n\n... [truncated, "), n.cast("string"), F.lit(" characters omitted] ...\n\n"))


def truncate(s: Column | str, cap: int = FIELD_CAP) -> Column:
    """Two thirds head and one third tail around a marker, all within `cap` units; shorter texts stay."""
    s = _c(s)
    n = units(s)
    budget = F.greatest(F.lit(0), F.lit(cap) - F.length(_marker(n)))
    head = F.floor(budget * 2 / 3).cast("int")
    tail = budget - head
    cut = F.concat(_slice(s, F.lit(0), head), _marker(n - head - tail), F.when(tail > 0, _slice(s, n - tail, tail)).otherwise(""))
    return F.when(n <= cap, s).otherwise(cut)


def compact(df, cap: int = FIELD_CAP, fields: tuple[str, ...] = TRUNCATABLE, record: str = "truncated"):
    """Caps the fields of each row; `record` keeps the first length a field ever had."""
    over = [F.when(units(f) > cap, F.struct(F.lit(f).alias("key"), units(f).cast("bigint").alias("value"))) for f in fields]
    new = F.map_from_entries(F.filter(F.array(*over), lambda x: x.isNotNull()))
    old = F.coalesce(F.col(record), F.create_map().cast("map<string,bigint>"))
    merged = F.map_concat(old, F.map_filter(new, lambda k, _: ~F.array_contains(F.map_keys(old), k)))
    merged = F.when(F.size(merged) > 0, merged)
    return df.withColumns({record: merged, **{f: truncate(f, cap) for f in fields}})


def path_safe(s: Column | str) -> Column:
    return F.regexp_replace(_c(s), r"[^A-Za-z0-9._-]+", "_")


def first_line(s: Column | str) -> Column:
    """First line of the trimmed text."""
    trimmed = F.regexp_replace(_c(s), rf"\A[{WS}]+|[{WS}]+\z", "")
    return F.element_at(F.split(trimmed, r"\r\n|\r|\n"), 1)


def indent(s: Column | str, prefix: str = "    ") -> Column:
    return F.concat(F.lit(prefix), F.array_join(F.split(_c(s), r"\r\n|\r|\n"), "\n" + prefix))


def error_class(s: Column | str) -> Column:
    """The class name that a message begins with, if a colon follows it; else null."""
    return F.nullif(F.regexp_extract(_c(s), rf"\A[{WS}]*((?:[A-Z][A-Za-z0-9_]*)?(?:Error|Exception|Failure))\s*:", 1), F.lit(""))


def seconds_to_ms(s: Column | str) -> Column:
    """Milliseconds, rounded half up; null for blank, non-numeric, non-finite or negative values."""
    x = F.expr("double('NaN')") if s is None else F.trim(_c(s)).try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf")), F.floor(x * 1000 + 0.5).cast("bigint"))


def escape_json_in_html(s: Column | str) -> Column:
    out = F.replace(_c(s), F.lit("</"), F.lit("<\\/"))
    for c, e in (("\ufffd", "\\ufffd"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        out = F.replace(out, F.lit(c), F.lit(e))
    return out
