"""Bytes of delimited files to text.

UTF-16 is known by its byte order mark or by where its zero bytes stand, UTF-8 by being valid. Anything else is mixed:
valid UTF-8 stays and only the bytes between are read as Windows-1252 (policy "bytes"), or the whole file is
(policy "file"). Which bytes were read so, and on which lines, is reported. Line feeds are no part of any longer UTF-8 character, so
that lines can be decoded one by one (records.py), and so can those of UTF-16, cut at line feeds of two bytes.
"""

from __future__ import annotations

import codecs
import threading
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes that Windows-1252 leaves undefined; they are read as Latin-1.
UNDEFINED = b"\x81\x8d\x8f\x90\x9d"
FALLBACK = {b: bytes([b]).decode("latin-1" if b in UNDEFINED else "cp1252") for b in range(128, 256)}
MARKS = ((codecs.BOM_UTF16_LE, "utf-16-le", "UTF-16LE (BOM)"), (codecs.BOM_UTF16_BE, "utf-16-be", "UTF-16BE (BOM)"))
SNIFF_BYTES, MAX_LINES = 4096, 10
MIXED = "UTF-8 with cp1252 bytes"
DDL = "path string, text string, encoding string, fallback_bytes long, fallback_lines array<long>, error string"


def zero_pattern(head: bytes, policy: str) -> str | None:
    """UTF-16 without a mark: nearly all odd (LE) or even (BE) bytes are zero and few of the others; policy "file" takes the majority."""
    if len(head) < 4:
        return None
    even, odd = head[0::2], head[1::2]
    zeros = even.count(0) / len(even), odd.count(0) / len(odd)
    if policy == "file":
        return None if zeros[0] == zeros[1] else "utf-16-le" if odd.count(0) > even.count(0) else "utf-16-be" if even.count(0) > odd.count(0) else None
    if zeros[1] >= 0.9 and zeros[0] < 0.1:
        return "utf-16-le"
    if zeros[0] >= 0.9 and zeros[1] < 0.1:
        return "utf-16-be"
    return None


class _Replacer:
    """An `errors=` handler: bytes that are no UTF-8 become Windows-1252 characters, and their places are kept."""

    def __init__(self) -> None:
        self.places: list[int] = []
        self.count = 0

    def __call__(self, error: UnicodeError) -> tuple[str, int]:
        if not isinstance(error, UnicodeDecodeError):
            raise error
        self.places.append(error.start)
        self.count += error.end - error.start
        return "".join(FALLBACK[b] for b in error.object[error.start : error.end]), error.end


_current = threading.local()
codecs.register_error("rowproof-cp1252", lambda e: _current.handler(e))


def mixed(data: bytes) -> tuple[str, int, list[int]]:
    """Valid UTF-8 as it is, all other bytes as Windows-1252, in one decode: the text, how many such bytes, and their first lines."""
    _current.handler = kept = _Replacer()
    text = data.decode("utf-8", "rowproof-cp1252")
    lines: list[int] = []
    breaks, scanned = 1, 0
    for place in kept.places:
        breaks += data.count(b"\n", scanned, place)
        scanned = place
        if not lines or lines[-1] != breaks:
            lines.append(breaks)
        if len(lines) == MAX_LINES:
            break
    return text, kept.count, lines


def sort_of(head: bytes, policy: str = "bytes") -> tuple[str, str, int] | None:
    """What a file's opening tells: (codec, label, bytes of its mark) of UTF-16 and of marked UTF-8; None for anything else."""
    for mark, name, label in MARKS:
        if head.startswith(mark):
            return name, label, 2
    if head.startswith(codecs.BOM_UTF8):
        return "utf-8", "UTF-8 (BOM)", 3
    name = zero_pattern(head[:SNIFF_BYTES], policy)
    return (name, f"{name.upper().replace('-L', 'L').replace('-B', 'B')} (NUL pattern)", 0) if name else None


def decode(data: bytes, policy: str = "bytes") -> tuple[str, str, int, list[int]]:
    """(text without a mark, label, bytes read as Windows-1252, their lines); raises UnicodeDecodeError."""
    name, label, skip = sort_of(data, policy) or ("utf-8", "UTF-8", 0)
    body = data[skip:]
    try:
        return body.decode(name), label, 0, []
    except UnicodeDecodeError:
        if name != "utf-8":
            raise
    if policy == "file":
        return data.decode("cp1252"), "cp1252", 0, []
    text, count, lines = mixed(body)
    return text, MIXED, count, lines


def by_lines(encoding: str) -> bool:
    """Whether text in this encoding can be cut at the bytes of line breaks before it is decoded."""
    name = codecs.lookup(encoding).name
    return not name.startswith(("utf-32", "utf-7"))


def read_texts(spark: SparkSession, paths: list[str], policy: str = "bytes", encoding: str | None = None) -> DataFrame:
    """One row per file: path, text, encoding and what was read as Windows-1252; a file that cannot be decoded has an error.

    For encodings that cannot be cut at the bytes of line breaks, as such a file is one value; others are read by records.py.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    text, label, count, lines = (content.decode(encoding), encoding, 0, []) if encoding else decode(content, policy)
                    row, error = (text, label, count, lines), None
                except (UnicodeDecodeError, LookupError) as e:
                    row, error = (None, None, 0, []), str(e)
                kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((path, *row, error), kinds)], names=[c.split()[0] for c in DDL.split(", ")])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, DDL)
