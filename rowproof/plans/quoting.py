"""Quoting profiles of files: one profile, column list and sample list for each."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from rowproof.functions import delimited, habits
from rowproof.session import saved
from rowproof.sources import records


@dataclass
class FileProfile:
    path: str
    error: str = ""
    encoding: str = ""
    profile: Row | None = None
    names: list[str] = field(default_factory=list)
    columns: list[Row] = field(default_factory=list)
    samples: list[Row] = field(default_factory=list)
    n_bytes: int = 0
    seconds: float = 0.0
    detail: str = ""

    def groups(self) -> dict[str, list[str]]:
        """Labels of the columns by how they are quoted: with, without, both."""
        return {kind: [c.label for c in self.columns if c.quoting == kind] for _, kind in GROUPS}


def column_table(tok: DataFrame) -> DataFrame:
    """One row per column of the header or the data: field_no, label, and the counts and group of column_habits (null without data).

    A label is the header's name on one line; a column without a name, or with one that others have too, shows its number."""
    names = tok.where("part = 'header'").select("field_no", F.regexp_replace("value", r"\s+", " ").alias("name"))
    both = names.join(delimited.column_habits(tok, "path").drop("path"), "field_no", "full")
    number = F.concat(F.lit("column "), F.col("field_no").cast("string"))
    both = both.withColumn("name", F.coalesce(F.nullif(F.btrim("name"), F.lit("")), number))
    shared = F.count("*").over(Window.partitionBy("name")) > 1
    return both.select("field_no", F.when(shared, F.concat("name", F.lit(" ("), number, F.lit(")"))).otherwise(F.col("name")).alias("label"), "quoted_cells", "bare_cells", "quoting")


def profile_file(spark: SparkSession, path: str, delim: str | None = None, quote: str | None = None, encoding_name: str | None = None, header: bool = True, max_rows: int = 0) -> FileProfile:
    """Profile one file; what cannot be read becomes its error."""
    try:
        start = time.time()
        opened = records.open_file(spark, path, "file", encoding_name)
        status = "given"
        if not (delim and quote):
            scores = delimited.dialect_scores(opened.opening_text(spark), "path", delim=delim, quote=quote, opening_chars=delimited.SNIFF_CHARS)
            d = delimited.choose_dialect(scores, "path", delim, quote).first()
            status, delim, quote = d.delim_status, d.delim, d.quote
        # Tokens are written once; the profile, the columns and the samples are read from them.
        raw = records.with_header(records.records(opened, delim, quote), delim, quote)
        tok = saved(delimited.records_of(delimited.classified(delimited.tokens_of(raw, "path", delim, quote)), "path", header, max_rows), "tokens")
        profile = habits.judged(delimited.profile_of(tok, records.newlines(opened), "path", delim, quote, header))
        profile = profile.withColumn("delim_status", F.lit(status)).withColumn("checks", habits.checks())
        names = [r.value for r in tok.where("part = 'header'").orderBy("field_no").select("value").collect()]
        return FileProfile(
            path, "", opened.label, profile.first(), names,
            column_table(tok).orderBy("field_no").collect(), delimited.first_samples(tok, "path", delim, quote).orderBy("part", "record_no").collect(),
            opened.n_bytes, time.time() - start,
        )
    except Exception as e:
        text = str(e)
        return FileProfile(path, "File not found." if "PATH_NOT_FOUND" in text or "FileNotFound" in text else f"{type(e).__name__}: {text[:300]}")


#: What a report says before its files.
EXPLANATION = """How to read this report
  Values are judged as their file writes them: a field is quoted if it begins with the quote mark.
  "when required" means that only values with a delimiter, a quote mark or a line break are quoted; "text quoted" that numbers are bare and
  other values quoted; "mixed" that no single rule explains the file. Empty and blank fields are judged on their own.
  Samples show the first field of each kind; previews are cut at 40 characters.
"""
CAVEATS = {
    "low_confidence": "many rows have another number of columns than the header: delimiter or quote mark may be wrong",
    "unterminated": "a quoted field is never closed: all that follows it was read as its value",
    "guessed": "no delimiter was found in the opening: the comma was assumed",
}


def size_text(n: int) -> str:
    """Bytes in the largest unit that leaves a whole part."""
    units = ["bytes", "KB", "MB", "GB", "TB"]
    at = min(max(n.bit_length() - 1, 0) // 10, len(units) - 1)
    return f"{n:,} bytes" if at == 0 else f"{n / (1 << 10 * at):.1f} {units[at]}"


def write_details(found: list[FileProfile], folder: str) -> list[str]:
    """One report for each file, named after it; a name that is taken gets -2, -3 and so on. Returns the paths."""
    out, taken = Path(folder), set()
    out.mkdir(parents=True, exist_ok=True)
    for f in found:
        name = base = f.path.rstrip("/").rsplit("/", 1)[-1]
        k = 1
        while name.casefold() in taken:
            k += 1
            name = f"{base}-{k}"
        taken.add(name.casefold())
        (out / f"{name}.txt").write_text(full_report([f]), encoding="utf-8")
        f.detail = str(out / f"{name}.txt")
    return [f.detail for f in found]


def _columns(f: FileProfile) -> Iterator[str]:
    for title, kind in GROUPS:
        yield f"{title}: {'; '.join(f.groups()[kind]) or '-'}"


def _format(f: FileProfile) -> Iterator[str]:
    p = f.profile
    yield f"encoding {f.encoding}, delimiter {p.delim!r} ({p.delim_status}), quote {p.quote!r}, line breaks {p.newline}"
    yield f"{size_text(f.n_bytes)}, read in {f.seconds:.1f} s"
    for name, on in (("guessed", p.delim_status == "guessed"), ("unterminated", p.unterminated), ("low_confidence", p.low_confidence)):
        if on:
            yield f"caution: {CAVEATS[name]}"


def _counts(f: FileProfile) -> Iterator[str]:
    p = f.profile
    yield f"{p.data_records:,} data rows, {p.columns} columns, judged from {p.judged}"
    yield f"values: {p.value_habit}; empties: {p.empty_habit}; {p.habit}" + (f" ({p.caveat})" if p.caveat else "")
    for where in ("header", "data"):
        counts = ", ".join(f"{n} {p[f'{where}_{n}']:,}" for n in delimited.COUNTERS if p[f"{where}_{n}"])
        yield f"{where}: {counts or 'nothing'}"


def _lists(f: FileProfile) -> Iterator[str]:
    yield from (f"column {c.label}: {c.quoted_cells:,} quoted, {c.bare_cells:,} bare" for c in f.columns if c.quoting)
    yield from (f"check: {c}" for c in f.profile.checks)
    yield from (f"{s.part} {s.kind}: row {s.record_no} {s.preview}" for s in f.samples)


#: How columns are grouped, and what the sections of a file are in either report.
GROUPS = (("always quoted", "with"), ("never quoted", "without"), ("quoted in part", "both"))
SHORT, FULL = (_columns,), (_format, _counts, _columns, _lists)


def report(found: list[FileProfile], sections: tuple[Callable[[FileProfile], Iterator[str]], ...]) -> list[str]:
    """The lines of the given sections for each file, under its path; a file's error stands instead of them."""
    out = []
    for f in found:
        out += [f"== {f.path}", *(f"  {line}" for line in ([f.error] if f.error else (x for section in sections for x in section(f))))]
    return out


def short_report(found: list[FileProfile]) -> str:
    """Per file, which columns are quoted."""
    return "".join(f"{line}\n" for line in report(found, SHORT))


def full_report(found: list[FileProfile]) -> str:
    """Per file: format, habits, counts, columns, checks and samples; then how the files compare."""
    out = [EXPLANATION, *report(found, FULL)]
    usable = [f.profile for f in found if not f.error]
    if len(usable) > 1:
        for what, name in (("value", "value_habit"), ("empty", "empty_habit")):
            out.append(f"Across files: {what} quoting {'matches' if len({p[name] for p in usable}) == 1 else 'differs'}.")
    return "\n".join(out) + "\n"
