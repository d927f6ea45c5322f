"""Artifact archives: zip files, with one level of zip or tar inside, unpacked within budgets checked before inflating."""

from __future__ import annotations

import gzip
import io
import zipfile
import zlib
from dataclasses import dataclass

BLOCK = 512


@dataclass(frozen=True)
class ArchiveLimits:
    max_archive: int = 64 * 1024 * 1024
    max_entry: int = 32 * 1024 * 1024
    inflate_factor: int = 8
    max_entries: int = 20_000

    @property
    def total(self) -> int:
        return self.max_archive * self.inflate_factor


def is_tarball(name: str) -> bool:
    return name.lower().endswith((".tgz", ".tar.gz", ".tar"))


def is_gzipped(name: str, data: bytes) -> bool:
    return not name.lower().endswith(".tar") and len(data) > 2 and data[:2] == b"\x1f\x8b"


def _string(field: bytes) -> str:
    return field.split(b"\0", 1)[0].decode("utf-8", "replace")


def _size(field: bytes) -> int:
    """Octal, or base 256 where the first bit is set; nonsense is 0."""
    if field[0] & 0x80:
        return int.from_bytes(bytes([field[0] & 0x7F]) + field[1:], "big")
    digits = field.split(b"\0", 1)[0].strip()
    try:
        return int(digits, 8) if digits else 0
    except ValueError:
        return 0


def untar(data: bytes, limits: ArchiveLimits = ArchiveLimits()) -> dict[str, bytes]:
    """Regular members of a tar image. Long names are read; long links and extended headers are passed over; a cut-off
    archive yields what is whole, and nothing raises."""
    out: dict[str, bytes] = {}
    at, total, long_name = 0, 0, None
    while at + BLOCK <= len(data):
        head = data[at : at + BLOCK]
        if not any(head):
            break
        size, kind, start = _size(head[124:136]), head[156:157], at + BLOCK
        if start + size > len(data):
            break
        at = start + -(-size // BLOCK) * BLOCK
        if kind == b"L":
            long_name = _string(data[start : start + size])
            continue
        if kind in (b"K", b"x", b"g"):
            continue
        name, prefix = long_name or _string(head[:100]), _string(head[345:500])
        name, long_name = f"{prefix}/{name}" if prefix and not long_name else name, None
        if kind in (b"0", b"\0", b"7") and 0 < size <= limits.max_entry and total + size <= limits.total:
            if len(out) >= limits.max_entries:
                break
            out[name] = data[start : start + size]
            total += size
    return out


def _unzip(data: bytes, limits: ArchiveLimits, skipped: list[str]) -> dict[str, bytes]:
    """Entries whose stated size fits the rest of the budget; what inflates beyond its stated size is dropped. Reasons are noted."""
    out, left = {}, limits.total
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        entries = z.infolist()
        skipped += ["too many entries"] * max(0, len(entries) - limits.max_entries)
        for info in entries[: limits.max_entries]:
            if info.is_dir():
                continue
            if info.file_size > min(limits.max_entry, left):
                skipped.append("entry too large" if info.file_size > limits.max_entry else "inflate budget used up")
                continue
            left -= info.file_size
            with z.open(info) as f:
                body = f.read(info.file_size + 1)
            if len(body) == info.file_size:
                out[info.filename] = body
            else:
                skipped.append("size differs from the stated one")
    return out


def _gunzip(data: bytes, most: int) -> bytes:
    with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
        body = f.read(most + 1)
    if len(body) > most:
        raise ValueError("inflates beyond the budget")
    return body


def unpack(data: bytes, limits: ArchiveLimits = ArchiveLimits()) -> tuple[dict[str, bytes], list[str]]:
    """(files, reasons for what was skipped). Members of nested archives are named outer!inner."""
    bad = (zipfile.BadZipFile, zlib.error, EOFError, OSError, ValueError, NotImplementedError, RuntimeError)
    out, skipped = {}, []
    try:
        entries = _unzip(data, limits, skipped)
    except bad as e:
        return {}, [f"unzip failed: {str(e)[:60]}"]
    for name, body in entries.items():
        nested = is_tarball(name) or name.lower().endswith(".zip")
        if not nested or len(body) > limits.max_archive:
            out[name] = body
            continue
        try:
            if is_tarball(name):
                inner = untar(_gunzip(body, limits.total) if is_gzipped(name, body) else body, limits)
            else:
                inner = _unzip(body, limits, skipped)
            out.update({f"{name}!{k}": v for k, v in inner.items()})
        except bad:
            skipped.append("nested untar failed" if is_tarball(name) else "nested unzip failed")
    return out, skipped
