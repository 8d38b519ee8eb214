"""SQL for the queries on delimited texts: a walk over the fields of each text, one field of every text a step.

The queries cut texts with array functions; the walk takes a text's next field with one anchored pattern, looks at the character after it, and goes on from
there, so that the two have the tokens' definition in common but no way of finding them.
"""

from __future__ import annotations

from rowproof.functions.delimited import COUNTERS, DELIMITERS, QUOTES, SNIFF_ROWS

CRLF, LF, CR = "chr(13) || chr(10)", "chr(10)", "chr(13)"
TEXTS = "doc AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents)"
NUMBER = r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _pattern(c: str) -> str:
    return {"|": r"\|", "\t": r"\t"}.get(c, c)


def walk(name: str, delim: str, quote: str) -> str:
    """Rows (doc_id, pos, record_no, field_no, raw, term) of every field as written, with what ended it."""
    d, q = _pattern(delim), _pattern(quote)
    field = _lit(rf"^(?:{q}(?:[^{q}]|{q}{q})*(?:{q}[^{d}\r\n]*)?|[^{d}\r\n]*)")
    mark = _lit(delim)
    end = "pos + length(raw)"
    term = f"CASE WHEN substr(t, {end}, 1) = {mark} THEN {mark} WHEN substr(t, {end}, 2) = {CRLF} THEN {CRLF} WHEN substr(t, {end}, 1) = {LF} THEN {LF} WHEN substr(t, {end}, 1) = {CR} THEN {CR} ELSE '' END"
    row = f"SELECT doc_id, {end} + length(term) AS pos, record_no, field_no, raw, term FROM (SELECT *, {term} AS term FROM"
    return f"""{name}(doc_id, pos, record_no, field_no, raw, term) AS (
{row} (SELECT doc_id, t, CAST(1 AS BIGINT) AS pos, CAST(1 AS BIGINT) AS record_no, 1 AS field_no, regexp_extract(t, {field}) AS raw FROM doc WHERE n > 0))
UNION ALL
{row} (SELECT w.doc_id, t, w.pos, record_no + (w.term <> {mark})::INT AS record_no, CASE WHEN w.term = {mark} THEN field_no + 1 ELSE 1 END AS field_no, regexp_extract(substr(t, w.pos), {field}) AS raw
FROM {name} w JOIN doc ON doc.doc_id = w.doc_id WHERE w.term = {mark} OR (w.term <> '' AND w.pos <= n))))"""


def parts_of(quote: str) -> str:
    """Expressions over raw: whether it is quoted, what stands between the marks, whether it is closed, and what follows."""
    q, mark = _pattern(quote), _lit(quote)
    body = f"CASE WHEN starts_with(raw, {mark}) THEN regexp_extract(raw, {_lit(f'^{q}((?:[^{q}]|{q}{q})*)')}, 1) END"
    return f"starts_with(raw, {mark}) AS quoted, {body} AS body"


def tokens() -> str:
    """CTEs up to `tok`, the classified tokens of all texts, comma-separated with double quotes, with their part."""
    return f"""WITH RECURSIVE {TEXTS},
{walk("w", ",", '"')},
cut AS (SELECT *, {parts_of('"')} FROM w),
closed AS (SELECT *, quoted AND substr(raw, 2 + length(body), 1) = '"' AS closed, CASE WHEN quoted THEN substr(raw, 3 + length(body)) ELSE '' END AS tail, regexp_replace(body, '\\r\\n|\\r', chr(10), 'g') AS broken FROM cut),
said AS (SELECT *, ltrim(tail, ' ' || chr(9)) AS rest, CASE WHEN quoted THEN replace(broken, '""', '"') || ltrim(tail, ' ' || chr(9)) ELSE raw END AS value FROM closed),
fact AS (SELECT doc_id, record_no, field_no, value, quoted, contains(value, ',') AS has_delim, quoted AND contains(broken, chr(10)) AS has_break,
    CASE WHEN quoted THEN contains(body, '"') OR contains(rest, '"') ELSE contains(raw, '"') END AS has_inner_quote, quoted AND NOT closed AS unterminated, quoted AND rest <> '' AS junk,
    quoted AND (starts_with(tail, ' ') OR starts_with(tail, chr(9))) AS padded, trim(value, ' ' || chr(9)) = '' AND value <> '' AS blank, raw FROM said),
wide AS (SELECT doc_id, record_no, max(field_no) AS width, bool_and(raw = '') AND max(field_no) = 1 AS lone FROM fact GROUP BY ALL),
head AS (SELECT doc_id, min(record_no) FILTER (NOT lone) AS header_record, min_by(width, record_no) FILTER (NOT lone) AS header_width FROM wide GROUP BY doc_id),
kinds AS (SELECT f.*, width, header_record, header_width,
    CASE WHEN value = '' AND quoted THEN 'quoted_empty' WHEN value = '' THEN 'bare_empty' WHEN blank AND quoted THEN 'ws_quoted' WHEN blank THEN 'ws_bare'
    WHEN quoted AND (has_delim OR has_break OR has_inner_quote) THEN 'quoted_required' WHEN quoted THEN 'quoted_optional' ELSE 'bare' END AS kind
    FROM fact f JOIN wide USING (doc_id, record_no) JOIN head USING (doc_id)),
tok AS MATERIALIZED (SELECT *, kind IN ('quoted_required', 'quoted_optional', 'bare') AND length(value) <= 64 AND regexp_full_match(value, '{NUMBER}') AS "numeric",
    CASE WHEN width = 1 AND kind = 'bare_empty' AND (header_record IS NULL OR record_no < header_record OR header_width > 1) THEN 'blank' WHEN record_no = header_record THEN 'header' ELSE 'data' END AS part FROM kinds)
"""


COLUMNS = "doc_id, record_no, header_record, header_width, width, field_no, value, quoted, has_delim, has_break, has_inner_quote, unterminated, junk, padded, blank, kind, \"numeric\""
CSV_TOKENS = tokens() + f"SELECT {COLUMNS} FROM tok"
TABLE_FUNCTION = tokens() + "SELECT doc_id, record_no, field_no, width, value, quoted, unterminated, junk FROM tok"
CSV_COLUMNS = tokens() + """SELECT *, CASE WHEN quoted_cells > 0 AND bare_cells > 0 THEN 'both' WHEN quoted_cells > 0 THEN 'with' ELSE 'without' END AS quoting
FROM (SELECT doc_id, field_no, count(*) FILTER (quoted) AS quoted_cells, count(*) FILTER (NOT quoted) AS bare_cells FROM tok WHERE part = 'data' GROUP BY ALL)"""

_SHOWN = "replace(replace(replace(substr(value, 1, 40), chr(13), '\\n'), chr(10), '\\n'), chr(9), '\\t')"
_DOTS = "CASE WHEN length(value) > 40 THEN '...' ELSE '' END"
CSV_SAMPLES = tokens() + f"""SELECT doc_id, part, kind, min(record_no) AS record_no, arg_min(preview, (record_no, field_no)) AS preview FROM (SELECT *,
CASE kind WHEN 'quoted_empty' THEN '""' WHEN 'bare_empty' THEN '(blank)' WHEN 'ws_bare' THEN '[' || {_SHOWN} || {_DOTS} || ']' WHEN 'bare' THEN {_SHOWN} || {_DOTS}
ELSE '"' || replace({_SHOWN}, '"', '""') || {_DOTS} || '"' END AS preview FROM tok WHERE part <> 'blank') GROUP BY ALL"""

_HELD = "kind IN ('quoted_required', 'quoted_optional')"
_COUNTS = {
    "fields": "true", "empty_quoted": "kind = 'quoted_empty'", "empty_bare": "kind = 'bare_empty'", "ws_quoted": "kind = 'ws_quoted'", "ws_bare": "kind = 'ws_bare'",
    "quoted_required": "kind = 'quoted_required'", "quoted_optional": "kind = 'quoted_optional'", "bare": "kind = 'bare'",
    "numeric_quoted": f'{_HELD} AND "numeric"', "numeric_bare": "kind = 'bare' AND \"numeric\"", "text_quoted": f'{_HELD} AND NOT "numeric"', "text_bare": "kind = 'bare' AND NOT \"numeric\"",
    "with_delim": "has_delim", "with_break": "has_break", "with_inner_quote": "has_inner_quote AND quoted", "bare_with_quote": "kind = 'bare' AND has_inner_quote",
}


def _value_habit(p: str) -> str:
    return f"""CASE WHEN {p}quoted_optional + {p}quoted_required = 0 AND {p}bare = 0 THEN 'no values' WHEN {p}quoted_optional + {p}quoted_required = 0 THEN 'bare'
WHEN {p}quoted_optional = 0 THEN 'when required' WHEN {p}bare = 0 THEN 'always quoted'
WHEN {p}text_quoted > 0 AND {p}numeric_bare > 0 AND {p}text_bare = 0 AND {p}numeric_quoted = 0 THEN 'text quoted' ELSE 'mixed' END"""


def _empty_habit(p: str) -> str:
    return f"""CASE WHEN {p}empty_quoted + {p}empty_bare = 0 THEN 'none seen' WHEN {p}empty_bare = 0 THEN 'quoted ("")' WHEN {p}empty_quoted = 0 THEN 'bare' ELSE 'mixed' END"""


def _caveat(p: str) -> str:
    forced = f"{p}with_delim + {p}with_break + {p}with_inner_quote + {p}bare_with_quote"
    return f"""CASE WHEN {_value_habit(p)} = 'bare' AND {forced} = 0 AND {p}bare > 0 THEN 'nothing forced'
WHEN {_value_habit(p)} = 'when required' AND {p}bare = 0 AND {p}quoted_optional = 0 AND {p}quoted_required > 0 THEN 'all forced' ELSE '' END"""


def profiles() -> str:
    """CTEs up to `judged`, a profile of every text."""
    first = "field_no = 1"
    names = [f"{part}_{n}" for part in ("header", "data") for n in COUNTERS]
    counts = ", ".join(f"count(*) FILTER (part = '{part}' AND ({_COUNTS[n]})) AS {part}_{n}" for part in ("header", "data") for n in COUNTERS)
    shape = ("header_records", "data_records", "blank_lines", "ragged", "unterminated", "junk_after_quote", "padded_quotes")
    pick = lambda f: f"CASE judged WHEN 'data' THEN {f('data_')} WHEN 'header' THEN {f('header_')} END"
    n = lambda p: f"len(regexp_extract_all(t, '{p}'))"
    return tokens().rstrip() + f""",
breaks AS (SELECT doc_id, {n('\\r\\n')} AS crlf, {n('\\n')} - {n('\\r\\n')} AS lf, {n('\\r')} - {n('\\r\\n')} AS cr FROM doc),
newline AS (SELECT doc_id, CASE WHEN crlf + lf + cr = 0 THEN 'none' WHEN (crlf > 0)::INT + (lf > 0)::INT + (cr > 0)::INT = 1 THEN CASE WHEN crlf > 0 THEN 'CRLF' WHEN lf > 0 THEN 'LF' ELSE 'CR' END
    ELSE 'mixed (' || concat_ws(', ', CASE WHEN crlf > 0 THEN 'CRLF' END, CASE WHEN lf > 0 THEN 'LF' END, CASE WHEN cr > 0 THEN 'CR' END) || ')' END AS newline FROM breaks),
shape AS (SELECT doc_id, count(*) FILTER ({first} AND part = 'header') AS header_records, count(*) FILTER ({first} AND part = 'data') AS data_records, count(*) FILTER ({first} AND part = 'blank') AS blank_lines,
    count(*) FILTER ({first} AND part = 'data' AND width <> header_width) AS ragged, count(*) FILTER (unterminated) AS unterminated, min(record_no) FILTER (unterminated) AS first_unterminated,
    count(*) FILTER (junk) AS junk_after_quote, count(*) FILTER (padded) AS padded_quotes, max(header_width) AS header_width, {counts} FROM tok GROUP BY doc_id),
profile AS (SELECT doc_id, newline, {", ".join(f"coalesce({c}, 0) AS {c}" for c in (*shape, *names))}, first_unterminated, coalesce(header_width, 0) AS columns FROM newline LEFT JOIN shape USING (doc_id)),
judge AS (SELECT *, CASE WHEN data_records > 0 THEN 'data' WHEN header_records > 0 THEN 'header' ELSE 'none' END AS judged, data_records >= 10 AND ragged >= 0.05 * data_records AS low_confidence, ',' AS delim, '"' AS quote FROM profile),
habit AS (SELECT *, coalesce({pick(_value_habit)}, 'no values') AS value_habit, coalesce({pick(_empty_habit)}, 'none seen') AS empty_habit, coalesce({pick(_caveat)}, '') AS caveat,
    {_value_habit('header_')} AS hv, {_value_habit('data_')} AS dv, {_empty_habit('header_')} AS he, {_empty_habit('data_')} AS de FROM judge),
judged AS (SELECT * EXCLUDE (hv, dv, he, de), CASE WHEN value_habit = 'no values' AND empty_habit = 'none seen' THEN 'Nothing to judge.' WHEN value_habit = 'mixed' OR empty_habit = 'mixed' THEN 'Mixed quoting.' ELSE 'Uniform quoting.' END AS habit,
    (hv <> 'no values' AND dv <> 'no values' AND hv <> dv) OR (he <> 'none seen' AND de <> 'none seen' AND he <> de) AS header_differs,
    CASE WHEN judged = 'data' THEN data_bare_with_quote ELSE header_bare_with_quote END AS judged_bare FROM habit)
"""


_N = "format('{{:,}}', {0})"
_CHECKS = [
    ("ragged > 0", f"'Rows with a different column count: ' || {_N.format('ragged')} || '.'"),
    ("low_confidence", "'So many rows differ in width that the delimiter or quote mark may be wrong.'"),
    ("unterminated > 0", f"'Unterminated quotes: ' || {_N.format('unterminated')} || ', first at row ' || {_N.format('first_unterminated')} || '.'"),
    ("junk_after_quote > 0", f"'Fields with text after the closing quote: ' || {_N.format('junk_after_quote')} || '.'"),
    ("judged_bare > 0", f"'Bare values that hold a quote mark: ' || {_N.format('judged_bare')} || '.'"),
    ("padded_quotes > 0", f"'Closing quotes with blanks after them: ' || {_N.format('padded_quotes')} || '.'"),
    ("blank_lines > 0", f"'Blank lines left out: ' || {_N.format('blank_lines')} || '.'"),
]
CSV_PROFILE = profiles() + f"SELECT * EXCLUDE (judged_bare), concat_ws(' ', {', '.join(f'CASE WHEN {on} THEN {text} END' for on, text in _CHECKS)}) AS checks FROM judged"
ACROSS = profiles() + "SELECT count(*) AS texts, count(DISTINCT value_habit) <= 1 AS values_match, count(DISTINCT empty_habit) <= 1 AS empties_match FROM judged"


def dialects() -> str:
    """The choice of delimiter and quote mark: each candidate's walk, what its opening records say, and the best score."""
    pairs = [(d, q) for d in DELIMITERS for q in QUOTES]
    ctes, each = [TEXTS], []
    for k, (d, q) in enumerate(pairs):
        ctes.append(walk(f"w{k}", d, q))
        # A field that is open at the end of the text, and ends in a delimiter there, counts as two.
        cut = f"SELECT *, quoted AND substr(raw, 2 + length(body), 1) <> {_lit(q)} AS open, CASE WHEN quoted THEN substr(raw, 3 + length(body)) ELSE '' END AS tail FROM (SELECT *, {parts_of(q)} FROM w{k})"
        each.append(
            f"SELECT doc_id, {k} AS rank, record_no, count(*) + count(*) FILTER (open AND ends_with(raw, {_lit(d)})) AS width, count(*) FILTER (quoted) AS quoted, count(*) FILTER (open) AS open, "
            f"count(*) FILTER (NOT quoted AND contains(raw, {_lit(q)})) AS bare_quote, count(*) FILTER (quoted AND NOT open AND trim(tail, ' ' || chr(9)) <> '') AS junk FROM ({cut}) GROUP BY doc_id, record_no HAVING count(*) > 1 OR any_value(raw) <> ''"
        )
    names = ", ".join(f"({k}, {_lit(d)}, {_lit(q)})" for k, (d, q) in enumerate(pairs))
    sums = ("quoted", "open", "bare_quote", "junk")
    return f"""WITH RECURSIVE {", ".join(ctes)},
opening AS (SELECT * FROM ({" UNION ALL ".join(each)}) QUALIFY row_number() OVER (PARTITION BY doc_id, rank ORDER BY record_no) <= {SNIFF_ROWS}),
by_width AS (SELECT doc_id, rank, width, count(*) AS n, {", ".join(f"sum({c}) AS {c}" for c in sums)} FROM opening GROUP BY ALL),
best AS (SELECT doc_id, rank, arg_max(width, (n, -width)) AS mode, max(n) AS most, sum(n) AS whole, {", ".join(f"sum({c}) AS {c}" for c in sums)} FROM by_width GROUP BY ALL),
pair(rank, delim, quote) AS (VALUES {names}),
score AS (SELECT d.doc_id, p.rank, delim, quote, coalesce(mode, 0) AS mode, CASE WHEN whole > 0 THEN most / CAST(whole AS DOUBLE) * 1000 + mode * 25 - CASE WHEN mode <= 1 THEN 800 ELSE 0 END + CASE WHEN quoted > 0 THEN 100 ELSE 0 END
    - least(open, 3) * 70 - least(bare_quote, 10) * 25 - junk * 40 ELSE -1.0 END AS score FROM doc d CROSS JOIN pair p LEFT JOIN best b ON b.doc_id = d.doc_id AND b.rank = p.rank)
SELECT doc_id, arg_max(delim, (score, -rank)) AS delim, arg_max(quote, (score, -rank)) AS quote, CASE WHEN max(mode) <= 1 THEN 'guessed' ELSE 'detected' END AS delim_status, 'detected' AS quote_status FROM score GROUP BY doc_id"""


DIALECTS = dialects()
