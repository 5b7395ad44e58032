"""What is checked before a file is read: kind of file, size, binary content, encoding, delimiter, header."""

from __future__ import annotations

import hashlib
import os
import stat
from dataclasses import dataclass, field

from quarrymill.errors import SourceError

ENCODING = "utf-8-sig"
DELIMITERS = (",", ";", "\t", "|")
FORMATS = {".csv": "csv", ".tsv": "tsv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".sql": "sql"}
#: Leading bytes of files that are not text (fixed values); those of the second table only if the data holds NUL.
SIGNATURES = {
    b"\xff\xfe\x00\x00": "UTF-32 text",
    b"\x00\x00\xfe\xff": "UTF-32 text",
    b"\xff\xfe": "UTF-16 text",
    b"\xfe\xff": "UTF-16 text",
    b"\x1f\x8b": "gzip",
    b"PK\x03\x04": "zip or a spreadsheet",
    b"PK\x05\x06": "an empty zip",
    b"\xfd7zXZ\x00": "xz",
    b"\x28\xb5\x2f\xfd": "zstd",
    b"7z\xbc\xaf\x27\x1c": "7z",
    b"Rar!\x1a\x07": "rar",
    b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1": "an old office document",
    b"SQLite format 3\x00": "an SQLite database",
    b"\x89PNG\r\n\x1a\n": "a PNG image",
    b"\xff\xd8\xff": "a JPEG image",
}
#: The fourth byte of bzip2 is a digit.
SIGNATURES_WITH_NUL = {b"%PDF-": "PDF", b"PAR1": "Parquet", b"BZh": "bzip2", b"GIF8": "a GIF image"}
#: Estimated bytes that a parsed row and a parsed cell take on the driver, for formats that are read there.
ROW_BYTES, CELL_BYTES = 400, 170


@dataclass
class SourceInfo:
    path: str
    format: str
    bytes: int
    sha256: str
    encoding: str = ENCODING
    delimiter: str | None = None
    columns: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def detect_format(path: str, head: str) -> str:
    """By extension, else by the first character."""
    kind = FORMATS.get(os.path.splitext(path)[1].lower())
    if kind:
        return kind
    if head.lstrip("﻿ \t\r\n")[:1] in ("[", "{"):
        return "json"
    raise SourceError("unknown format: name it, or use the extension csv, tsv, json, jsonl, ndjson or sql")


def binary_kind(head: bytes, has_nul: bool) -> str | None:
    for table in (SIGNATURES, SIGNATURES_WITH_NUL if has_nul else {}):
        for mark, kind in table.items():
            if head.startswith(mark) and (mark != b"BZh" or head[3:4].isdigit()):
                return kind
    return None


def sniff_delimiter(line: str) -> tuple[str, str | None]:
    """(the most frequent delimiter of the header line, a warning if several kinds occur)."""
    counts = [line.count(d) for d in DELIMITERS]
    best = DELIMITERS[counts.index(max(counts))] if max(counts) else ","
    several = sum(c > 0 for c in counts) > 1
    return best, "the header holds more than one kind of delimiter" if several else None


def check_header(cells: list[str]) -> list[str]:
    names = [c.strip() for c in cells]
    if any(not n for n in names):
        raise SourceError("the header holds an empty column name")
    if len(set(names)) != len(names):
        raise SourceError("the header holds a column name twice")
    return names


def estimate_memory(rows: int, columns: int) -> int:
    return rows * (ROW_BYTES + CELL_BYTES * columns)


def check_memory(rows: int, columns: int, limit: float | None) -> None:
    if limit is not None and estimate_memory(rows, columns) > limit:
        raise SourceError("the file would take more memory on the driver than the policy allows")


def inspect(path: str, max_bytes: int | None = None, fmt: str | None = None) -> SourceInfo:
    """Size, content kind, format and hash of a file; the bytes are streamed once."""
    try:
        st = os.stat(path)
    except OSError as e:
        raise SourceError("the file cannot be opened") from e
    if not stat.S_ISREG(st.st_mode):
        raise SourceError("the path is not a regular file")
    if not st.st_size:
        raise SourceError("the file is empty")
    if max_bytes is not None and st.st_size > max_bytes:
        raise SourceError("the file is larger than the policy allows")
    h, nul, head = hashlib.sha256(), False, b""
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            head = head or block[:4096]
            h.update(block)
            nul = nul or b"\0" in block
    kind = binary_kind(head, nul)
    if kind:
        raise SourceError(f"the file is not text: it looks like {kind}")
    if nul:
        raise SourceError("the file holds NUL bytes and is not text")
    return SourceInfo(path, fmt or detect_format(path, head.decode("utf-8", "replace")), st.st_size, h.hexdigest())


def unchanged(info: SourceInfo) -> None:
    """Refuses results if the file's content is no longer what was inspected."""
    h = hashlib.sha256()
    with open(info.path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    if h.hexdigest() != info.sha256:
        raise SourceError("the file changed while it was read")
