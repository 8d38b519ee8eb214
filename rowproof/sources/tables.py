"""Records of delimited files to tables of text cells, with the lines that do not fit listed rather than dropped."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import zip_longest

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowproof.functions import delimited
from rowproof.functions.cells import row_hash
from rowproof.operators.keys import folded
from rowproof.session import saved


@dataclass(frozen=True)
class Format:
    """`quote` is the quote mark, with its escape after it where marks are not doubled."""

    delim: str = ","
    quote: str = '"'
    source: str = "detected"
    note: str = ""


def sniff(texts: DataFrame, overrides: dict[str, dict[str, str]] | None = None, side: str = "a") -> Format:
    """The format of a file's opening (path, text): an override for its side, else the dialect that reads it best."""
    given = (overrides or {}).get(side)
    if given:
        quote = given.get("quote", '"')
        return Format(given.get("delim", ","), quote + given.get("escape", quote).replace(quote, ""), "settings")
    r = delimited.choose_dialect(delimited.dialect_scores(texts, "path", opening_chars=delimited.SNIFF_CHARS), "path").first()
    if r is None:
        return Format(note="empty file")
    return Format(r.delim, r.quote, r.delim_status, "comma assumed" if r.delim_status == "guessed" else "")


@dataclass
class Loaded:
    """rows: c1 .. cN and h. rejects: file, line, error_type, error_message, raw_line."""

    rows: DataFrame
    rejects: DataFrame
    n_rows: int
    n_rejects: int
    longest: int


def load(records: DataFrame, fmt: Format, n_columns: int) -> Loaded:
    """Rows with the wrong number of cells, an open quote or text after a closing quote are rejects.

    records has path, record_no, line and raw. The first record that is not blank is the header. A blank line is a row only where there is
    one column. Every record is read once: rows and rejects are written together, column by column, and counted from what was written.
    """
    plain = ~F.contains("raw", F.lit(fmt.quote[0]))
    # A record without a quote mark has bare fields only, which its delimiters cut; others are read field by field.
    split = F.split("raw", re.escape(fmt.delim), -1)
    held = delimited.raw_fields(records, fmt.delim, fmt.quote, where=~plain)
    said = lambda x: F.struct(*[v.alias(k) for k, v in delimited.field_facts(x, fmt.delim, fmt.quote).items() if k in ("value", "unterminated", "junk")])
    held = held.withColumn("_facts", F.transform("fields", said))
    facts = lambda k: F.exists("_facts", lambda x: x[k])
    cells = held.withColumn("_cells", F.when(plain, split).otherwise(F.transform("_facts", lambda x: x["value"])))
    n = F.size("_cells")
    error = (
        F.when(~plain & facts("unterminated"), "UNQUOTED VALUE").when(~plain & facts("junk"), "INVALID STATE")
        .when(n < n_columns, "MISSING COLUMNS").when(n > n_columns, "TOO MANY COLUMNS")
    )
    names = [f"c{i + 1}" for i in range(n_columns)]
    made = cells.select(
        "path", "record_no", "line", (F.col("raw") != "").alias("filled"), F.octet_length("raw").alias("bytes"), error.alias("error"), n.alias("width"),
        F.when(error.isNotNull(), F.col("raw")).alias("raw"), *[F.coalesce(F.get("_cells", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(names)],
    )
    table = saved(made.withColumn("h", row_hash(names)), "loaded")
    first, longest = table.agg(F.min(F.when(F.col("filled"), F.col("record_no"))), F.max("bytes")).first()
    data = table.where(F.col("record_no") > F.lit(first)) if first is not None else table.where("false")
    if n_columns > 1:
        data = data.where("filled")
    message = F.concat(F.lit(f"Expected {n_columns} columns, found "), F.col("width").cast("string"))
    rejects = data.where("error is not null").select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "line", F.col("error").alias("error_type"), message.alias("error_message"), F.btrim("raw", F.lit("\r\n")).alias("raw_line")
    )
    good, bad = data.agg(F.count_if(F.col("error").isNull()), F.count_distinct(F.when(F.col("error").isNotNull(), F.col("line")))).first()
    return Loaded(data.where("error is null").select(*names, "h"), rejects, good, bad, longest or 0)


def over_limit(rows: int, rejected: int, percent: float) -> bool:
    """Whether more than the given share of lines is rejected; a file without rows is over if anything is."""
    return rejected > 0 and 100.0 * rejected / (rows + rejected) > percent


@dataclass(frozen=True)
class HeaderCheck:
    match: bool
    positions: list[tuple[int, str, str, str]]
    display: list[str]
    #: The names as written, which keys chosen by hand are looked up by.
    written: list[str]


def display_names(names: list[str]) -> list[str]:
    """Names as written; those that collide after trimming and folding get their position."""
    uses = Counter(map(folded, names))
    return [name if uses[folded(name)] == 1 else f"{name.strip()} ({at})" for at, name in enumerate(names, 1)]


def compare_headers(a: list[str], b: list[str], sides: tuple[str, str] = ("A", "B")) -> HeaderCheck:
    """By position, trimmed and folded; a name without a counterpart is extra on its side."""

    def status(x: str | None, y: str | None) -> str:
        if x is not None and y is not None:
            return "Match" if folded(x) == folded(y) else "Different"
        return f"Extra in {sides[x is None]}"

    pairs = list(zip_longest(a, b))
    rows = [(at, x or "", y or "", status(x, y)) for at, (x, y) in enumerate(pairs, 1)]
    written = a or b
    return HeaderCheck({r[3] for r in rows} <= {"Match"}, rows, display_names(written), written)
