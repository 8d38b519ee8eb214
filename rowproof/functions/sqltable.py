"""The tokenizer for SQL callers: table functions, registered in a session, that LATERAL joins apply to any text column.

    SELECT d.doc_id, t.* FROM documents d, LATERAL csv_tokens(d.text, '|', "'") t

`csv_tokens(content, delim, quote)` has a row per field: record_no and field_no (from 1), width of the record, value, quoted, unterminated, junk.
`csv_records(content, delim, quote)` has a row per record: record_no, width, raw (without its terminator), ended (the terminator).
Both are SQL over built-in functions, which Spark puts into the caller's plan: generators on the rows where they are, without Python and without a shuffle. The patterns
follow from the arguments, comma and double quote where they are left out; `quote` is one character (see delimited.py for texts with an escape).

A null text has no rows, nor has an empty one.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

ARGUMENTS = "content STRING, delim STRING DEFAULT ',', quote STRING DEFAULT '\"'"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _joined(pattern: str) -> str:
    """An expression for a pattern in which D and Q stand for the delimiter and the quote mark, whatever characters they are, B for what stands between marks and F for a field."""
    pattern = pattern.replace("F", "(?:QB(?:Q[^D\\r\\n]*+)?+|(?!Q)[^D\\r\\n]*+)").replace("B", "[^Q]*+(?:QQ[^Q]*+)*+")
    marks = {"D": r"concat('\\Q', delim, '\\E')", "Q": r"concat('\\Q', quote, '\\E')"}
    parts, held = [], ""
    for c in pattern:
        if c in marks:
            parts += [_text(held), marks[c]] if held else [marks[c]]
            held = ""
        else:
            held += c
    return f"concat({', '.join(parts + ([_text(held)] if held else []))})"


def statements(prefix: str = "csv") -> list[str]:
    """The CREATE FUNCTION statements; names begin with `prefix`."""
    record, field = _joined(r"((?:FD)*+F)(\r\n|\r|\n|\z)"), _joined(r"(?:\A|(?<=D))(F)(?:D|\z)")
    inside, open_ = _joined(r"\AQ(B)(Q?)(?s:(.*))\z"), _joined(r"\AQB\z")
    part = lambda k: f"regexp_extract(f.raw, {inside}, {k})"
    blanks = "replace(' \\t', delim, '')"
    rest = f"ltrim({blanks}, {part(3)})"
    # A field that runs to the end may itself end in a delimiter, after which nothing follows.
    whole = f"CASE WHEN size(x) > 1 AND element_at(x, -1) = '' AND rlike(element_at(x, -2), {open_}) THEN slice(x, 1, size(x) - 1) ELSE x END"
    fields = lambda raw: f"transform(array(regexp_extract_all({raw}, {field}, 1)), x -> {whole})[0]"
    found = lambda k: f"regexp_extract_all(coalesce(content, ''), {record}, {k})"
    both = f"zip_with({found(1)}, {found(2)}, (raw, ended) -> named_struct('raw', raw, 'ended', ended))"
    # The search finds one more record, empty, at the very end.
    cut = f"filter(transform({both}, (x, i) -> named_struct('no', CAST(i + 1 AS BIGINT), 'raw', x.raw, 'ended', x.ended, 'fields', {fields('x.raw')})), x -> x.raw <> '' OR x.ended <> '')"
    records = f"SELECT r.no, size(r.fields), r.raw, r.ended FROM inline({cut}) AS r(no, raw, ended, fields)"
    # One generator: a second one, on the rows of the first, would not see the arguments.
    each = f"flatten(transform({cut}, r -> transform(r.fields, (raw, k) -> named_struct('no', r.no, 'k', k + 1, 'width', size(r.fields), 'raw', raw))))"
    value = f"CASE WHEN startswith(f.raw, quote) THEN concat(replace(regexp_replace({part(1)}, '\\\\r\\\\n|\\\\r', '\\n'), concat(quote, quote), quote), {rest}) ELSE f.raw END"
    tokens = (
        f"SELECT f.no, f.k, f.width, {value}, startswith(f.raw, quote), startswith(f.raw, quote) AND {part(2)} = '', startswith(f.raw, quote) AND {rest} <> '' "
        f"FROM inline({each}) AS f(no, k, width, raw)"
    )
    create = "CREATE OR REPLACE TEMPORARY FUNCTION"
    return [
        f"{create} {prefix}_records({ARGUMENTS}) RETURNS TABLE (record_no BIGINT, width INT, raw STRING, ended STRING) RETURN {records}",
        f"{create} {prefix}_tokens({ARGUMENTS}) RETURNS TABLE (record_no BIGINT, field_no INT, width INT, value STRING, quoted BOOLEAN, unterminated BOOLEAN, junk BOOLEAN) RETURN {tokens}",
    ]


def register(spark: SparkSession, prefix: str = "csv") -> None:
    """Make the table functions known in a session, for as long as it lasts."""
    for statement in statements(prefix):
        spark.sql(statement)
