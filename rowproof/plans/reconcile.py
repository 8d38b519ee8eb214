"""A reconciliation from two tables or two files to its result."""

from __future__ import annotations

import tempfile
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from rowproof.functions import delimited
from rowproof.operators import columns, compare, differences, keys
from rowproof.session import removed, saved, scratch_path, shared_folder
from rowproof.settings import Settings
from rowproof.sources import files, records, tables


@dataclass
class Result:
    """What a pair came to. The frames hold the full lists; everything else is small."""

    prefix: str
    overall: str = "ERROR"
    message: str = ""
    headers: list[str] = field(default_factory=list)
    header_check: tables.HeaderCheck | None = None
    metrics: Row | None = None
    columns: list[Row] = field(default_factory=list)
    key: keys.Key | None = None
    counts: dict[str, int] = field(default_factory=dict)
    paired_differing: dict[int, int] = field(default_factory=dict)
    differences: DataFrame | None = None
    unpaired: DataFrame | None = None
    mismatches: DataFrame | None = None
    rejects: DataFrame | None = None
    rows: tuple[int, int] = (0, 0)
    rejected: tuple[int, int] = (0, 0)
    encodings: tuple[str, str] = ("", "")
    formats: tuple[tables.Format, tables.Format] | None = None
    warnings: list[str] = field(default_factory=list)
    #: Rows of each list that was written.
    written: dict[str, int] = field(default_factory=dict)
    timings: list[tuple[str, float]] = field(default_factory=list)


class _Clock:
    def __init__(self, result: Result) -> None:
        self.result, self.at = result, time.time()

    def step(self, name: str) -> None:
        self.result.timings.append((name, time.time() - self.at))
        self.at = time.time()


def reconcile(a: DataFrame, b: DataFrame, headers: list[str], settings: Settings | None = None, prefix: str = "", result: Result | None = None, written: list[str] | None = None) -> Result:
    """Compare two tables of text cells with hashes (see functions.cells); `written` are the headers before repeated ones were numbered.

    The counts, the paired records and the unpaired rows are written once each to the shared folder: what reads them later (counts by
    column, lists, sheets) runs no join again. Nothing is cached.
    """
    settings = settings or Settings()
    result = result or Result(prefix)
    result.headers = headers
    clock = _Clock(result)
    cmp = saved(compare.counts(a, b), "row-counts")
    m = result.metrics = compare.metrics(cmp).first()
    result.rows = (m.rows_a, m.rows_b)
    clock.step("row comparison")
    distinct = (m.distinct_a, m.distinct_b)
    result.columns = columns.statistics(a, b, *distinct, settings.example_values).orderBy("pos").collect()  # one row a column
    clock.step("column analysis")
    key = result.key = keys.select(
        a, b, prefix, result.columns, headers, distinct, settings.key_mode, settings.key_overrides, written,
        min_overlap=settings.key_min_overlap, max_columns=settings.key_max_columns, candidates=settings.key_candidates, hints=settings.key_hints,
    )
    clock.step("key")
    if key.invalid:
        result.overall, result.message = "ERROR", f"Invalid key: {key.reason}"
        return result
    if key.positions:
        names = [f"c{p}" for p in key.positions]
        found = differences.keyed(a, b, cmp, names, key.manual, settings.sides)
        paired, result.unpaired = saved(found.paired, "paired"), saved(found.unpaired, "unpaired")
        result.differences = differences.cell_differences(paired, names, compare.cells(a))
        result.paired_differing = {r.pos: r.paired_differing for r in columns.differing_by_column(result.differences).collect()}  # one row a column
        result.counts = {r.status: r["n"] for r in compare.status_counts(result.unpaired).collect()}
        result.counts |= {"Paired records": paired.count(), "Differing cells": sum(result.paired_differing.values())}
    else:
        result.mismatches = saved(compare.mismatches(a, b, cmp, settings.sides), "mismatches")
        result.counts = {r.status: r["n"] for r in compare.status_counts(result.mismatches).collect()}
    clock.step("pairing")
    same = m.rows_a == m.rows_b == m.matched_rows and not sum(result.rejected)
    result.overall = "MATCH" if same else "MISMATCH"
    return result


def process_pair(spark: SparkSession, pair: files.Pair, settings: Settings | None = None) -> Result:
    """Decode, sniff, check headers, load, gate on rejects, and reconcile one pair of files."""
    settings = settings or Settings()
    result = Result(pair.prefix)
    try:
        return _process(spark, pair, settings, result)
    except Exception as e:  # one pair's failure is its result; the run goes on
        result.overall, result.message = "ERROR", f"{type(e).__name__}: {str(e)[:500]}"
        return result


def _process(spark: SparkSession, pair: files.Pair, settings: Settings, result: Result) -> Result:
    clock = _Clock(result)
    paths = (pair.a, pair.b)
    fits, room = files.room_for(shared_folder(spark), files.sizes_of(spark, list(paths)), settings.disk_factor, spark)
    if not fits:
        raise OSError(f"not enough room to work: {room}")
    opened = []
    for side, path in zip(settings.sides, paths):
        try:
            opened.append(records.open_file(spark, path))
        except (UnicodeDecodeError, ValueError) as e:
            raise ValueError(f"{side}: {e}") from e
        if n := opened[-1].fallback_bytes:
            result.warnings.append(f"{side}: {n} bytes read as cp1252, first on lines {', '.join(map(str, opened[-1].fallback_lines))}")
    result.encodings = tuple(o.label for o in opened)
    clock.step("encoding")
    overrides = {name.casefold(): given for name, given in settings.format_overrides.items()}.get(pair.prefix.casefold())
    formats = result.formats = tuple(tables.sniff(o.opening_text(spark), overrides, s) for o, s in zip(opened, "ab"))
    names = [records.first_record(o, spark, f.delim, f.quote) or [] for o, f in zip(opened, formats)]
    check = result.header_check = tables.compare_headers(*names, settings.sides)
    clock.step("format and headers")
    sides = []
    for side, o, f, n in zip(settings.sides, opened, formats, names):
        try:
            found = records.records(o, f.delim, f.quote, settings.max_line_bytes)
        except ValueError as e:
            raise ValueError(f"{side}: {e}") from e
        sides.append(tables.load(found, f, max(len(n), 1)))
    result.rows, result.rejected = tuple(s.n_rows for s in sides), tuple(s.n_rejects for s in sides)
    clock.step("load")
    for side, s in zip(settings.sides, sides):
        if s.longest > settings.max_line_bytes:
            raise ValueError(f"{side}: a line of {s.longest} bytes is over the limit of {settings.max_line_bytes}")
    if not check.match:
        result.overall, result.rejected = "COLUMNS DIFFER", (0, 0)
        return result
    if sum(result.rejected):
        result.rejects = sides[0].rejects.unionByName(sides[1].rejects)
    if any(tables.over_limit(n, bad, settings.reject_limit_percent) for n, bad in zip(result.rows, result.rejected)):
        result.overall = "Too many malformed lines"
        return result
    return reconcile(sides[0].rows, sides[1].rows, check.display, settings, pair.prefix, result, check.written)


# One cell of each kind that a reader may bend.
SELF_CHECK = (" lead", "trail ", "", "", " ", "0000000100.00", "10.000", "a,b", "line1\nline2", 'say "hi"', "café")


def self_check(spark: SparkSession) -> bool:
    """Whether a row of awkward cells, in a file of the shared folder, comes through the reader of files unchanged."""
    quoted = [f'"{c.replace(chr(34), chr(34) * 2)}"' if any(x in c for x in ',"\n') else c for c in SELF_CHECK]
    quoted[3] = '""'
    path = scratch_path(spark, "self-check")
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", newline="") as f:
        f.write(",".join(f"C{i}" for i in range(1, 12)) + "\n" + ",".join(quoted) + "\n")
        f.flush()
        files.put(spark, f.name, path)
    try:
        loaded = tables.load(records.records(records.open_file(spark, path), ",", '"'), tables.Format(), len(SELF_CHECK))
        got = loaded.rows.collect()  # one row, as the file has
    finally:
        removed(spark, path)
    return len(got) == 1 and tuple(got[0])[:-1] == SELF_CHECK and got[0].h is not None and loaded.n_rejects == 0


def _facts_of(f: tables.Format):
    return lambda x: F.struct(*[v.alias(k) for k, v in delimited.field_facts(x, f.delim, f.quote).items() if k in ("value", "unterminated", "junk")])


def read_pair(spark: SparkSession, pair: files.Pair, settings: Settings | None = None) -> DataFrame:
    """Both files of a pair as one table: side, record_no and line (from 1), the cells as an array, and what is wrong with the quotes, if anything. Headers and blank lines are records, too."""
    settings = settings or Settings()
    overrides = {name.casefold(): given for name, given in settings.format_overrides.items()}.get(pair.prefix.casefold())
    sides = []
    for name, side, path in zip(settings.sides, "ab", (pair.a, pair.b)):
        opened = records.open_file(spark, path)
        f = tables.sniff(opened.opening_text(spark), overrides, side)
        facts = F.transform("fields", _facts_of(f))
        rows = delimited.raw_fields(records.records(opened, f.delim, f.quote, settings.max_line_bytes), f.delim, f.quote).withColumn("_x", facts)
        wrong = F.when(F.exists("_x", lambda x: x["unterminated"]), "UNQUOTED VALUE").when(F.exists("_x", lambda x: x["junk"]), "INVALID STATE")
        sides.append(rows.select(F.lit(name).alias("side"), "record_no", "line", F.transform("_x", lambda x: x["value"]).alias("cells"), wrong.alias("error")))
    return sides[0].unionByName(sides[1])
