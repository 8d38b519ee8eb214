"""Delimited text as DataFrame expressions: tokens, records, quoting counters, dialect choice.

A text column holds whole delimited texts. One regular expression cuts a text into fields with their terminators; all
else is array functions and aggregates, so that texts are read on the JVM, without a shuffle until counts are summed.

A field that starts with the quote mark runs to the closing mark, where a doubled mark stands for one and line breaks
count as one line feed each; blanks after the closing mark are padding, anything else there is junk and becomes part of the value;
without a closing mark the field runs to the end of the text. Any other field runs to the delimiter or line break and may
hold quote marks as ordinary characters.

A `quote` of two characters is a mark and its escape, for texts that escape marks instead of doubling them: within quotes the escape makes the mark or another
escape an ordinary character, a doubled mark ends the field with junk after it, and an escape before anything else is junk, too.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowproof.functions.cells import is_number

#: Candidates in the order that ties prefer.
DELIMITERS, QUOTES = (",", "|", "\t", ";"), ('"', "'")
SNIFF_CHARS, SNIFF_ROWS = 512 * 1024, 200
#: Counters of a set of fields.
COUNTERS = (
    "fields", "empty_quoted", "empty_bare", "ws_quoted", "ws_bare", "quoted_required", "quoted_optional", "bare",
    "numeric_quoted", "numeric_bare", "text_quoted", "text_bare", "with_delim", "with_break", "with_inner_quote", "bare_with_quote",
)


def quoted_body(quote: str) -> tuple[str, str]:
    """The mark, escaped for patterns, and the pattern of what stands between marks. All repetitions are possessive: Java then matches them in a loop, however long the text."""
    q, e = re.escape(quote[0]), re.escape(quote[1:])
    return (q, rf"[^{q}{e}]*+(?:{e}(?s:.|\z)[^{q}{e}]*+)*+") if e and e != q else (q, f"[^{q}]*+(?:{q}{q}[^{q}]*+)*+")


def _field(delim: str, quote: str) -> str:
    """One field as written."""
    d, (q, body) = re.escape(delim), quoted_body(quote)
    return f"(?:{q}{body}(?:{q}[^{d}\\r\\n]*+)?+|(?!{q})[^{d}\\r\\n]*+)"


def _record_pattern(delim: str, quote: str) -> str:
    f, d = _field(delim, quote), re.escape(delim)
    return f"((?:{f}{d})*+{f})(\\r\\n|\\r|\\n|\\z)"


def _field_pattern(delim: str, quote: str) -> str:
    d = re.escape(delim)
    return f"(?:\\A|(?<={d}))({_field(delim, quote)})(?:{d}|\\z)"


def record_array(text: Column, delim: str, quote: str) -> Column:
    """The records of a text: structs (raw, end) of what stands before the terminator, and it; one more, empty, at the very end."""
    pattern = F.lit(_record_pattern(delim, quote))
    return F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("raw"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("end"))


def raw_records(df: DataFrame, id_col: str, text: Column, delim: str, quote: str) -> DataFrame:
    """One row per record: id, record_no (from 1), raw (without its terminator), end (the terminator, '' at the end of the text), and the header's record and width."""
    both = df.select(id_col, record_array(text, delim, quote).alias("_r"))
    # The header is the first record that is no lone blank line.
    filled = F.transform("_r", lambda x: x["raw"] != "")
    both = both.withColumn("header_record", F.nullif(F.array_position(filled, F.lit(True)), F.lit(0)))
    first = F.get("_r", (F.col("header_record") - 1).cast("int"))["raw"]
    both = both.withColumn("_h", F.regexp_extract_all(first, F.lit(_field_pattern(delim, quote)), F.lit(1)))
    both = both.withColumn("header_width", F.size("_h") - _open_end("_h", quote).cast("int"))
    rows = both.select(id_col, "header_record", F.when(F.col("header_record").isNotNull(), F.col("header_width")).alias("header_width"), F.posexplode("_r").alias("_k", "_x"))
    rows = rows.select(id_col, (F.col("_k") + 1).cast("long").alias("record_no"), "header_record", "header_width", "_x.raw", "_x.end")
    return rows.where("raw <> '' or end <> ''")  # the search finds one more, empty, at the very end


def _open_end(fields: str, quote: str) -> Column:
    """Whether the last of the found fields is none: a field that runs to the end may itself end in a delimiter, after which nothing follows."""
    q, body = quoted_body(quote)
    n = F.size(fields)
    return F.coalesce((F.get(fields, n - 1) == "") & F.rlike(F.get(fields, n - 2), F.lit(rf"\A{q}{body}\z")), F.lit(False))


def raw_fields(rows: DataFrame, delim: str, quote: str, where: Column | None = None) -> DataFrame:
    """rows (with raw) with the array `fields` of fields as written; null for rows outside `where`."""
    cut = F.regexp_extract_all("raw", F.lit(_field_pattern(delim, quote)), F.lit(1))
    found = rows.withColumn("_f", cut if where is None else F.when(where, cut))
    return found.withColumn("fields", F.when(_open_end("_f", quote), F.slice("_f", F.lit(1), F.size("_f") - 1)).otherwise(F.col("_f"))).drop("_f")


def field_facts(raw: Column, delim: str, quote: str) -> dict[str, Column]:
    """What a raw field says, by the column names of the token table."""
    q, between = quoted_body(quote)
    inside, quote, escape = rf"\A{q}({between})({q}?)(?s:(.*))\z", quote[0], quote[1:]
    spaces = "".join(c for c in " \t" if c != delim)
    quoted = F.startswith(raw, F.lit(quote))
    part = lambda k: F.regexp_extract(raw, inside, k)
    body, closing, tail = part(1), part(2), part(3)
    junk = F.ltrim(tail, F.lit(spaces)) if spaces else tail
    broken = F.regexp_replace(body, r"\r\n|\r", "\n")
    if escape and escape != quote:
        e = re.escape(escape)
        plain, odd = F.regexp_replace(broken, f"{e}([{e}{q}])", "$1"), ~F.rlike(body, F.lit(rf"\A[^{e}]*+(?:{e}[{e}{q}][^{e}]*+)*+\z"))
    else:
        plain, odd = F.replace(broken, F.lit(quote * 2), F.lit(quote)), F.lit(False)
    value = F.when(quoted, F.concat(plain, junk)).otherwise(raw)
    blank = F.btrim(value, F.lit(spaces)) == "" if spaces else F.lit(False)
    has_quote = F.when(quoted, F.contains(body, F.lit(quote)) | F.contains(junk, F.lit(quote))).otherwise(F.contains(raw, F.lit(quote)))
    return {
        "value": value,
        "quoted": quoted,
        "has_delim": F.contains(value, F.lit(delim)),
        "has_break": quoted & F.contains(broken, F.lit("\n")),
        "has_inner_quote": has_quote,
        "unterminated": quoted & (closing == ""),
        "junk": quoted & ((junk != "") | odd),
        "padded": quoted & (tail != "") & F.startswith(tail, F.lit(" ")) if spaces == " " else quoted & F.rlike(tail, F.lit(r"\A[ \t]" if spaces == " \t" else r"\A ")),
        "blank": blank & (value != ""),
    }


def tokens(df: DataFrame, id_col: str, text_col: str = "text", delim: str = ",", quote: str = '"') -> DataFrame:
    """One row per field: id, record_no and field_no (from 1), width of its record, value, flags and terminator."""
    return tokens_of(raw_records(df, id_col, F.coalesce(F.col(text_col), F.lit("")), delim, quote), id_col, delim, quote)


def tokens_of(records: DataFrame, id_col: str, delim: str, quote: str) -> DataFrame:
    """The tokens of raw records, with the header's record and width."""
    rows = raw_fields(records, delim, quote)
    rows = rows.select(id_col, "record_no", "header_record", "header_width", "end", F.size("fields").alias("width"), F.posexplode("fields").alias("_i", "_x"))
    facts = field_facts(F.col("_x"), delim, quote)
    return rows.select(id_col, "record_no", "header_record", "header_width", "width", (F.col("_i") + 1).alias("field_no"), *[v.alias(k) for k, v in facts.items()], "end")


def field_kind(value: Column, quoted: Column, blank: Column, needs: Column) -> Column:
    return (
        F.when((value == "") & quoted, "quoted_empty")
        .when(value == "", "bare_empty")
        .when(blank & quoted, "ws_quoted")
        .when(blank, "ws_bare")
        .when(quoted & needs, "quoted_required")
        .when(quoted, "quoted_optional")
        .otherwise("bare")
    )


def classified(tok: DataFrame) -> DataFrame:
    """tokens with `kind` and `numeric`."""
    c = F.col
    kind = field_kind(c("value"), c("quoted"), c("blank"), c("has_delim") | c("has_break") | c("has_inner_quote"))
    return tok.withColumn("kind", kind).withColumn("numeric", kind.isin("quoted_required", "quoted_optional", "bare") & is_number(c("value")))


def counter_columns(of: Column) -> dict[str, Column]:
    """The aggregates that fill COUNTERS from the classified tokens that `of` picks."""
    c = F.col
    kind, numeric = c("kind"), c("numeric")
    held = kind.isin("quoted_required", "quoted_optional")
    when = {
        "fields": F.lit(True), "empty_quoted": kind == "quoted_empty", "empty_bare": kind == "bare_empty", "ws_quoted": kind == "ws_quoted", "ws_bare": kind == "ws_bare",
        "quoted_required": kind == "quoted_required", "quoted_optional": kind == "quoted_optional", "bare": kind == "bare",
        "numeric_quoted": held & numeric, "numeric_bare": (kind == "bare") & numeric, "text_quoted": held & ~numeric, "text_bare": (kind == "bare") & ~numeric,
        "with_delim": c("has_delim"), "with_break": c("has_break"), "with_inner_quote": c("has_inner_quote") & c("quoted"), "bare_with_quote": (kind == "bare") & c("has_inner_quote"),
    }
    return {name: F.count_if(of & when[name]) for name in COUNTERS}


def _candidate(delim: str, quote: str, rank: int) -> Column:
    """A dialect with its patterns, so that one pass over exploded candidates reads a text by all of them."""
    q, body = quoted_body(quote)
    inside = rf"\A{q}{body}"
    parts = {"delim": delim, "quote": quote[0], "record": _record_pattern(delim, quote), "field": _field_pattern(delim, quote), "open": inside + r"\z", "junk": inside + q + r"[ \t]*+[^ \t]"}
    return F.struct(F.lit(rank).alias("rank"), *[F.lit(v).alias(k) for k, v in parts.items()])


def dialect_scores(df: DataFrame, id_col: str, text_col: str = "text", delim: str | None = None, quote: str | None = None, opening_chars: int | None = None) -> DataFrame:
    """One row per text and candidate: id, delim, quote, score, mode, rank (the order that ties prefer).

    The text is read whole, or its first `opening_chars` where it is a file's. The opening rows of a text are read by each dialect: equal widths and more columns count for it, open
    quotes, junk and marks in bare fields against it. Lone blank lines and a record that the opening cuts do not count.
    """
    pairs = [(d, q) for d in ([delim] if delim else DELIMITERS) for q in ([quote] if quote else QUOTES) if d != q]
    if not pairs:
        raise ValueError("delimiter and quote must be different characters")
    text = F.coalesce(F.col(text_col), F.lit(""))
    candidates = F.explode(F.array(*[_candidate(d, q, i) for i, (d, q) in enumerate(pairs)]))
    part, more = (text, F.lit(False)) if opening_chars is None else (F.substring(text, 1, opening_chars), F.length(text) > opening_chars)
    opening = df.select(id_col, part.alias("_t"), more.alias("_more"), candidates.alias("c"))
    found = F.arrays_zip(F.regexp_extract_all("_t", F.col("c.record"), F.lit(1)).alias("raw"), F.regexp_extract_all("_t", F.col("c.record"), F.lit(2)).alias("end"))
    found = F.slice(F.filter(found, lambda x: (x["raw"] != "") & ~(F.col("_more") & (x["end"] == ""))), 1, SNIFF_ROWS)
    # A text without records keeps one row, whose width is null.
    rows = opening.select(id_col, "c", found.alias("_r")).select(id_col, "c", F.explode_outer("_r").alias("_x"))
    rows = rows.withColumn("_f", F.regexp_extract_all("_x.raw", F.col("c.field"), F.lit(1)))
    marked = lambda x: F.startswith(x, F.col("c.quote"))
    count = lambda test: F.size(F.filter("_f", test))
    facts = rows.select(
        id_col, "c.rank", "c.delim", "c.quote", F.when(F.col("_x").isNotNull(), F.size("_f")).alias("width"),
        count(marked).alias("quoted"),
        count(lambda x: F.rlike(x, F.col("c.open"))).alias("open"),
        count(lambda x: ~marked(x) & F.contains(x, F.col("c.quote"))).alias("bare_quote"),
        count(lambda x: F.rlike(x, F.col("c.junk"))).alias("junk"),
    )
    sums = ("quoted", "open", "bare_quote", "junk")
    by = [id_col, "rank", "delim", "quote"]
    by_width = facts.groupBy(*by, "width").agg(F.count("width").alias("n"), *[F.sum(c).alias(c) for c in sums])
    best = by_width.groupBy(*by).agg(F.max(F.struct("n", (-F.col("width")).alias("w"))).alias("m"), F.sum("n").alias("all"), *[F.sum(c).alias(c) for c in sums])
    mode = F.coalesce(-F.col("m.w"), F.lit(0))
    score = (
        F.col("m.n") / F.greatest("all", F.lit(1)) * 1000 + mode * 25 - F.when(mode <= 1, 800).otherwise(0) + F.when(F.col("quoted") > 0, 100).otherwise(0)
        - F.least(F.col("open"), F.lit(3)) * 70 - F.least(F.col("bare_quote"), F.lit(10)) * 25 - F.col("junk") * 40
    )
    return best.select(*by, F.when(F.col("all") > 0, score.cast("double")).otherwise(-1.0).alias("score"), mode.cast("int").alias("mode"))


def choose_dialect(scores: DataFrame, id_col: str, delim: str | None = None, quote: str | None = None) -> DataFrame:
    """One row per text: id, delim, quote, delim_status and quote_status (given, guessed, detected)."""
    best = scores.groupBy(id_col).agg(F.max(F.struct("score", (-F.col("rank")).alias("r"), "delim", "quote")).alias("b"), F.max("mode").alias("mode"))
    status = F.lit("given") if delim else F.when(F.col("mode") <= 1, "guessed").otherwise("detected")
    return best.select(id_col, "b.delim", "b.quote", status.alias("delim_status"), F.lit("given" if quote else "detected").alias("quote_status"))


def records_of(tok: DataFrame, id_col: str, header: bool = True, max_rows: int = 0) -> DataFrame:
    """Classified tokens with `part` (header, data, blank); max_rows keeps that many data records in order.

    The header is the first record that is no lone blank line; later lone blanks count as blank lines unless the
    header has one column or there is none.
    """
    lone = (F.col("width") == 1) & (F.col("kind") == "bare_empty")
    if header:
        at = F.col("header_record")
        before = at.isNull() | (F.col("record_no") < at)
        part = F.when(lone & (before | (F.col("header_width") > 1)), "blank").when(F.col("record_no") == at, "header").otherwise("data")
        out = tok.withColumn("part", part)
    else:
        out = tok.withColumn("header_width", F.lit(None).cast("int")).withColumn("part", F.lit("data"))
    if max_rows:
        # The number of the last record wanted: Spark keeps the first max_rows of each text before it shuffles.
        records = out.where((F.col("part") == "data") & (F.col("field_no") == 1)).select(F.col(id_col).alias("_of"), "record_no")
        nth = F.row_number().over(Window.partitionBy("_of").orderBy("record_no"))
        last = records.withColumn("_n", nth).where(F.col("_n") <= max_rows).where(F.col("_n") == max_rows).select("_of", F.col("record_no").alias("_last"))
        out = out.join(last, F.col(id_col).eqNullSafe(F.col("_of")), "left").where(F.col("_last").isNull() | (F.col("record_no") <= F.col("_last"))).drop("_of", "_last")
    return out


def profile(df: DataFrame, id_col: str, text_col: str = "text", delim: str = ",", quote: str = '"', header: bool = True, max_rows: int = 0) -> DataFrame:
    """One row per text: the 16 counters of header and data, records, columns and irregularities."""
    tok = records_of(classified(tokens(df, id_col, text_col, delim, quote)), id_col, header, max_rows)
    return profile_of(tok, newline_counts(df, id_col, text_col), id_col, delim, quote, header)


def profile_of(tok: DataFrame, newlines: DataFrame, id_col: str, delim: str, quote: str, header: bool = True) -> DataFrame:
    """The profiles of the texts in `newlines` (id, crlf, lf, cr, label) from their tokens with `part`."""
    first_field, data = F.col("field_no") == 1, F.col("part") == "data"
    shape = tok.groupBy(id_col).agg(
        F.count_if(first_field & (F.col("part") == "header")).alias("header_records"),
        F.count_if(first_field & data).alias("data_records"),
        F.count_if(first_field & (F.col("part") == "blank")).alias("blank_lines"),
        F.count_if(first_field & data & (F.col("width") != F.col("header_width"))).alias("ragged"),
        F.count_if("unterminated").alias("unterminated"),
        F.min(F.when(F.col("unterminated"), F.col("record_no"))).alias("first_unterminated"),
        F.count_if("junk").alias("junk_after_quote"),
        F.count_if("padded").alias("padded_quotes"),
        F.max("header_width").alias("header_width"),
        *[agg.alias(f"{where}_{name}") for where in ("header", "data") for name, agg in counter_columns(F.col("part") == where).items()],
    )
    if not header:
        mode = width_modes(tok.where(first_field & data), id_col)
        mode = mode.select(F.col(id_col).alias("_of"), F.col("width").alias("_mode"), (F.col("records") - F.col("n")).alias("_ragged"))
        shape = shape.join(mode, F.col(id_col).eqNullSafe(F.col("_of")), "left").withColumns({"header_width": F.col("_mode"), "ragged": F.coalesce("_ragged", F.lit(0))}).drop("_of", "_mode", "_ragged")
    out = shape
    # Line breaks count wherever they are, and texts without a record have a profile of zeros.
    base = newlines.select(F.col(id_col).alias("_of"), F.col("label").alias("newline"))
    out = base.join(out, F.col("_of").eqNullSafe(F.col(id_col)), "left").drop(id_col).withColumnRenamed("_of", id_col)
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("header_records", "data_records", "blank_lines", "ragged", "unterminated", "junk_after_quote", "padded_quotes")})
    zero = {f"{where}_{n}": F.coalesce(f"{where}_{n}", F.lit(0)) for where in ("header", "data") for n in COUNTERS}
    out = out.withColumns(zero).withColumn("columns", F.coalesce("header_width", F.lit(0))).drop("header_width")
    judged = F.when(F.col("data_records") > 0, "data").when(F.col("header_records") > 0, "header").otherwise("none")
    low = (F.col("data_records") >= 10) & (F.col("ragged") >= 0.05 * F.col("data_records"))
    return out.withColumns({"judged": judged, "low_confidence": low, "delim": F.lit(delim), "quote": F.lit(quote)})


def newline_label(crlf: Column, lf: Column, cr: Column) -> Column:
    names = F.filter(F.array(F.when(crlf > 0, "CRLF"), F.when(lf > 0, "LF"), F.when(cr > 0, "CR")), lambda x: x.isNotNull())
    return F.when(F.size(names) == 0, "none").when(F.size(names) == 1, F.get(names, F.lit(0))).otherwise(F.concat(F.lit("mixed ("), F.array_join(names, ", "), F.lit(")")))


def newline_counts(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """One row per text: its line breaks by kind, and their label."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    both = n(r"\r\n")
    c = df.select(id_col, both.alias("crlf"), (n("\n") - both).alias("lf"), (n("\r") - both).alias("cr"))
    return c.withColumn("label", newline_label(F.col("crlf"), F.col("lf"), F.col("cr")))


def width_modes(rows: DataFrame, by: str | list[str]) -> DataFrame:
    """The commonest `width` of each group, the smaller on ties: its records `n`, and those of all widths."""
    keys = [by] if isinstance(by, str) else by
    w = rows.groupBy(*keys, "width").agg(F.count("*").alias("n"))
    best = w.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("width")).alias("w"))).alias("m"), F.sum("n").alias("records"))
    return best.select(*keys, (-F.col("m.w")).alias("width"), F.col("m.n").alias("n"), "records")


def quotes_needed(df: DataFrame, by: str, value_col: str, delim: str = ",", quote: str = '"') -> DataFrame:
    """For each group its values, those that hold the delimiter, the quote mark, a line break, and those that need quotes for any of these."""
    t = df.select(by, F.coalesce(F.col(value_col), F.lit("")).alias("_t"))
    has = lambda x: F.contains("_t", F.lit(x))
    broken = has("\n") | has("\r")
    counts = {"with_delim": has(delim), "with_quote": has(quote), "with_break": broken, "needs_quotes": has(delim) | has(quote) | broken}
    return t.groupBy(by).agg(F.count("*").alias("texts"), *[F.count_if(test).alias(name) for name, test in counts.items()])


def column_habits(tok: DataFrame, id_col: str) -> DataFrame:
    """One row per text and column over the data records: quoted and bare cells, and whether it has both."""
    c = tok.where("part = 'data'").groupBy(id_col, "field_no").agg(F.count_if("quoted").alias("quoted_cells"), F.count_if(~F.col("quoted")).alias("bare_cells"))
    group = F.when((F.col("quoted_cells") > 0) & (F.col("bare_cells") > 0), "both").when(F.col("quoted_cells") > 0, "with").otherwise("without")
    return c.withColumn("quoting", group)


def first_samples(tok: DataFrame, id_col: str, delim: str = ",", quote: str = '"', chars: int = 40) -> DataFrame:
    """The first field of each kind, in header and data, with its row and a preview."""
    shown = F.replace(F.replace(F.replace(F.substring("value", 1, chars), F.lit("\r"), F.lit("\\n")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    dots = F.when(F.length("value") > chars, "...").otherwise("")
    kind = F.col("kind")
    text = (
        F.when(kind == "quoted_empty", '""').when(kind == "bare_empty", "(blank)")
        .when(kind == "ws_bare", F.concat(F.lit("["), shown, dots, F.lit("]"))).when(kind == "bare", F.concat(shown, dots))
        .otherwise(F.concat(F.lit('"'), F.replace(shown, F.lit('"'), F.lit('""')), dots, F.lit('"')))
    )
    least = tok.where("part <> 'blank'").groupBy(id_col, "part", "kind").agg(F.min_by(F.struct("record_no", text.alias("preview")), F.struct("record_no", "field_no")).alias("s"))
    return least.select(id_col, "part", "kind", F.col("s.record_no").alias("record_no"), "s.preview")
