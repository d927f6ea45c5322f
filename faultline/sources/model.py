"""What every report parser yields, its limits and its errors."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()
_ARTIFACT = T.StructType([T.StructField("kind", _S), T.StructField("path", _S), T.StructField("mediaType", _S)])
FAILURE = T.StructType([
    T.StructField("errorType", _S), T.StructField("message", _S), T.StructField("stackText", _S), T.StructField("stdout", _S), T.StructField("stderr", _S),
    T.StructField("artifacts", T.ArrayType(_ARTIFACT)),
])
ATTEMPT = T.StructType([
    T.StructField("shardIndex", _I), T.StructField("displayName", _S), T.StructField("suitePath", T.ArrayType(_S)), T.StructField("filePath", _S),
    T.StructField("attemptIndex", _I), T.StructField("status", _S), T.StructField("durationMs", _D), T.StructField("startedAt", _S), T.StructField("workerId", _S),
    T.StructField("failure", FAILURE),
])
WARNING = T.StructType([T.StructField("code", _S), T.StructField("message", _S), T.StructField("at", _S)])
PARSED = T.StructType([
    T.StructField("path", _S), T.StructField("adapter", _S), T.StructField("error", _S), T.StructField("warnings", T.ArrayType(WARNING)),
    T.StructField("attempts", T.ArrayType(ATTEMPT)),
])


class ParseError(Exception):
    """A report that cannot be read, with a code, a place and what to do about it."""

    def __init__(self, code: str, message: str, at: str | None = None, remedy: str = ""):
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.at, self.remedy = code, message, at, remedy


@dataclass(frozen=True)
class Limits:
    """Caps on hostile input; sizes count UTF-16 units where texts are meant. Fixed values."""

    max_bytes: int = 512 * 1024 * 1024
    max_attempts: int = 2_000_000
    max_depth: int = 64
    max_attributes: int = 256
    max_text: int = 1024 * 1024
    max_name: int = 8 * 1024


@dataclass
class Parsed:
    attempts: list[dict] = field(default_factory=list)
    warnings: list[dict] = field(default_factory=list)

    def warn(self, code: str, message: str, at: str | None = None) -> None:
        self.warnings.append({"code": code, "message": message, "at": at})


def attempt(**kw) -> dict:
    base = {"shardIndex": 0, "displayName": "", "suitePath": [], "filePath": None, "attemptIndex": 0, "status": "passed", "durationMs": None, "startedAt": None, "workerId": None, "failure": None}
    return base | kw


def failure(**kw) -> dict:
    return {"errorType": None, "message": "", "stackText": None, "stdout": None, "stderr": None, "artifacts": []} | kw


def utf16(s: str) -> int:
    return len(s) + sum(c > "\uffff" for c in s) if not s.isascii() else len(s)


def clip(s: str, n: int) -> str:
    if len(s) <= n // 2 or utf16(s) <= n:
        return s
    return s.encode("utf-16-le", "surrogatepass")[: 2 * n].decode("utf-16-le", "ignore")
