"""A workbook of samples: summary, columns, and the first rows of each list, all cells as text."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable, Iterator
from itertools import chain
from xml.sax.saxutils import escape

from pyspark.sql import functions as F

from rowproof.plans.reconcile import Result
from rowproof.settings import Settings
from rowproof.sinks.csv import named_differences, status_names

# Limits of the file format.
MAX_CHARS, MAX_ROWS = 32_767, 1_048_575
CUT = "…[truncated]"
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def cell(value: object) -> str:
    """Text of a cell, cut at the format's limit."""
    text = "" if value is None else str(value)
    return text if len(text) <= MAX_CHARS else text[: MAX_CHARS - len(CUT)] + CUT


def quoted(value: str, on: bool) -> str:
    return f"'{value}'" if on else value


def summary_rows(result: Result, settings: Settings) -> Iterator[list[object]]:
    a, b = settings.sides
    yield ["Pair", result.prefix]
    yield ["Overall result", result.overall]
    if result.message:
        yield ["Error", result.message]
    yield ["Per side", a, b]
    yield ["Encoding", *result.encodings]
    if result.formats:
        yield ["Delimiter and quote", *(f"{f.delim!r} {f.quote!r} ({f.source})" for f in result.formats)]
    yield ["Data rows", *result.rows]
    yield ["Rejected lines", *result.rejected]
    if result.header_check and not result.header_check.match:
        yield ["Position", f"{a} header", f"{b} header", "Status"]
        yield from map(list, result.header_check.positions)
    if m := result.metrics:
        yield ["Distinct rows", m.distinct_a, m.distinct_b]
        yield ["Matched rows", m.matched_rows]
        yield [f"Rows only in {a}", m.only_a]
        yield [f"Rows only in {b}", m.only_b]
        yield [f"Extra copies in {a}", m.extra_a]
        yield [f"Extra copies in {b}", m.extra_b]
        yield ["Match rate", f"{m.match_rate:.2f}%"]
    yield from (["Warning", w] for w in result.warnings)
    if k := result.key:
        yield ["Key source", k.source]
        yield ["Key columns", ", ".join(k.names) or "(none)"]
        if k.overlap is not None:
            yield ["Key overlap", f"{100 * k.overlap:.2f}%"]
        if k.reason:
            yield ["Key reason", k.reason]
    yield from ([name, n] for name, n in sorted(result.counts.items()))
    yield from ([f"Rows written: {kind}", n] for kind, n in result.written.items())
    yield from (["Seconds", name, f"{s:.3f}"] for name, s in result.timings)


def column_rows(result: Result, settings: Settings) -> Iterator[list[object]]:
    a, b = settings.sides
    yield ["Column", f"{a} type", f"{b} type", f"{a} distinct", f"{b} distinct", f"Only in {a}", f"Only in {b}", "Paired records differing", f"{a}-only examples", f"{b}-only examples", f"{a} integer", f"{a} decimal", f"{a} text", f"{b} integer", f"{b} decimal", f"{b} text"]
    keys = set(result.key.positions) if result.key else set()
    join = lambda values: ", ".join(quoted(v, settings.quote_values) for v in values)
    for c in result.columns:
        differ = "Key" if c.pos in keys else result.paired_differing.get(c.pos, 0)
        yield [result.headers[c.pos - 1], c.a_label, c.b_label, c.a_distinct, c.b_distinct, c.only_a, c.only_b, differ, join(c.a_examples), join(c.b_examples), c.a_integer, c.a_decimal, c.a_text, c.b_integer, c.b_decimal, c.b_text]


def sample_sheets(result: Result, settings: Settings) -> Iterator[tuple[str, Iterator[list[object]]]]:
    """Sheets of the first rows in a fixed order; Spark keeps the top rows, which come over one partition at a time."""
    limit = min(settings.sample_rows, MAX_ROWS)
    cells = [f"c{i}" for i in range(1, len(result.headers) + 1)]

    def rows(df, names: list[str]) -> Iterator[list[object]]:
        yield list(names)
        for r in df.toLocalIterator():
            yield list(r)

    if result.differences is not None:
        keys = [f"c{p}" for p in result.key.positions]
        _, names = named_differences(result, settings.sides)
        named = F.element_at(F.array(*map(F.lit, result.headers)), F.col("pos"))
        top = result.differences.orderBy(*keys, "pos").limit(limit)
        wrap = (lambda c: F.concat(F.lit("'"), c, F.lit("'"))) if settings.quote_values else (lambda c: c)
        top = top.select(*keys, named, wrap(F.col("b_val")), wrap(F.col("a_val")), "b_copies", "a_copies")
        yield "Differences", rows(top, names)
    for title, df in (("Unpaired", result.unpaired), ("Mismatches", result.mismatches)):
        if df is not None:
            yield title, rows(df.orderBy(*cells, "status").limit(limit), status_names(result, settings.sides))
    if result.rejects is not None:
        yield "Rejected", rows(result.rejects.orderBy("file", "line").limit(limit), ["File", "Line", "Error type", "Error message", "Raw line"])


def _sheet(out: zipfile.ZipFile, number: int, rows: Iterable[list[object]], cut: list[int]) -> None:
    """Write one sheet; cut[0] counts the cells that are shortened."""
    with out.open(f"xl/worksheets/sheet{number}.xml", "w") as f:
        f.write(b'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
        for row in rows:
            cut[0] += sum(isinstance(v, str) and len(v) > MAX_CHARS for v in row)
            made = "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_BAD.sub(" ", cell(v)))}</t></is></c>' for v in row)
            f.write(f"<row>{made}</row>".encode())
        f.write(b"</sheetData></worksheet>")


def write_workbook(result: Result, path: str, settings: Settings) -> list[str]:
    """Write the workbook, row by row; returns its sheets."""
    sheets = [("Summary", summary_rows(result, settings)), ("Column differences", column_rows(result, settings)), *sample_sheets(result, settings)]
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    n = range(1, len(sheets) + 1)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        cut = [0]
        for i, (_, rows) in list(zip(n, sheets))[1:]:
            _sheet(z, i, rows, cut)
        _sheet(z, 1, chain(sheets[0][1], [["Cells cut in sheets", cut[0]]]), [0])  # the first sheet knows what the others came to
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n) + "</Types>")
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(t)}" sheetId="{i}" r:id="r{i}"/>' for i, (t, _) in zip(n, sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>")
    return [t for t, _ in sheets]
