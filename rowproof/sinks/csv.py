"""Full lists as CSV, written by the executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rowproof.plans.reconcile import Result
from rowproof.session import removed
from rowproof.sources import files


def unique_names(names: list[str]) -> list[str]:
    """Names that stand once each, whatever the case: later ones get _1, _2 and so on."""
    seen, out = set(), []
    for name in names:
        new, k = name, 0
        while new.casefold() in seen:
            k += 1
            new = f"{name}_{k}"
        seen.add(new.casefold())
        out.append(new)
    return out


def write_csv(df: DataFrame, folder: str, names: list[str], one_file: bool = False) -> tuple[str, int]:
    """A folder of part files with headers; returns where it is and its rows. Values keep their blanks, and quotes are doubled inside quotes.

    The parts are written beside the target, which they replace only when all are there: a failing write leaves the list that was there. Rows are
    counted as they are written. one_file writes through a single task, for lists known to be short.
    """
    out, seen, beside = df.toDF(*unique_names(names)), Observation(), f"{folder}.new-{uuid.uuid4().hex}"
    out = (out.coalesce(1) if one_file else out).observe(seen, F.count(F.lit(1)).alias("rows"))
    try:
        out.write.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
            "ignoreTrailingWhiteSpace", False
        ).option("emptyValue", '""').csv(beside)
    except Exception:
        removed(df.sparkSession, beside)
        raise
    return files.replace(df.sparkSession, beside, folder), seen.get["rows"]


def named_differences(result: Result, sides: tuple[str, str]) -> tuple[DataFrame, list[str]]:
    """The differences with column names for positions: key columns, Column, both values, both copies."""
    keys = [f"c{p}" for p in result.key.positions]
    name = F.element_at(F.array(*map(F.lit, result.headers)), F.col("pos"))
    rows = result.differences.select(*keys, name.alias("column"), "b_val", "a_val", "b_copies", "a_copies")
    return rows, [*result.key.names, "Column", sides[1], sides[0], f"{sides[1]} copies", f"{sides[0]} copies"]


def status_names(result: Result, sides: tuple[str, str]) -> list[str]:
    return ["Status", f"{sides[0]} copies", f"{sides[1]} copies", "Unmatched copies", *result.headers]


def write_lists(result: Result, folder: str, sides: tuple[str, str]) -> dict[str, str]:
    """Write the lists that have rows; returns what was written where. The rows of each list are in result.written."""
    base, lists = f"{folder.rstrip('/')}/{result.prefix}", []
    if result.differences is not None and result.counts.get("Differing cells"):
        lists.append(("differences", *named_differences(result, sides)))
    unpaired = sum(n for s, n in result.counts.items() if s not in ("Paired records", "Differing cells"))
    for kind, rows in (("unpaired", result.unpaired), ("mismatches", result.mismatches)):
        if rows is not None and unpaired:
            lists.append((kind, rows, status_names(result, sides)))
    if result.rejects is not None:
        lists.append(("rejected", result.rejects, ["File", "Line", "Error type", "Error message", "Raw line"]))
    found = {kind: write_csv(rows, f"{base}_{kind}.csv", names) for kind, rows, names in lists}
    result.written = {kind: n for kind, (_, n) in found.items()}
    return {kind: path for kind, (path, _) in found.items()}
