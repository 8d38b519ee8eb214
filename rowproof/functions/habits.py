"""What the quoting counters say about the writer, as expressions over the counter columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}{name}")


def value_habit(prefix: str = "") -> Column:
    """no values, bare, when required, always quoted, text quoted, or mixed: the first that holds."""
    c = lambda n: _c(prefix, n)
    quoted, bare = c("quoted_optional") + c("quoted_required"), c("bare")
    needed_only = (c("quoted_optional") == 0) & (c("quoted_required") > 0)
    text_quoted = (c("quoted_optional") > 0) & (c("text_quoted") > 0) & (c("numeric_bare") > 0) & (c("text_bare") == 0) & (c("numeric_quoted") == 0)
    return (
        F.when((quoted == 0) & (bare == 0), "no values")
        .when(quoted == 0, "bare")
        .when(needed_only, "when required")
        .when(bare == 0, "always quoted")
        .when(text_quoted, "text quoted")
        .otherwise("mixed")
    )


def empty_habit(prefix: str = "") -> Column:
    """none seen, quoted (""), bare, or mixed."""
    quoted, bare = _c(prefix, "empty_quoted"), _c(prefix, "empty_bare")
    return F.when((quoted == 0) & (bare == 0), "none seen").when(bare == 0, 'quoted ("")').when(quoted == 0, "bare").otherwise("mixed")


def summary(value: Column, empty: Column) -> Column:
    return (
        F.when((value == "no values") & (empty == "none seen"), "Nothing to judge.")
        .when((value == "mixed") | (empty == "mixed"), "Mixed quoting.")
        .otherwise("Uniform quoting.")
    )


def caveat(prefix: str = "") -> Column:
    """'nothing forced' where no bare value needed quotes, 'all forced' where every value did, else ''."""
    c = lambda n: _c(prefix, n)
    forced = c("with_delim") + c("with_break") + c("with_inner_quote") + c("bare_with_quote")
    label = value_habit(prefix)
    all_forced = (label == "when required") & (c("bare") == 0) & (c("quoted_optional") == 0) & (c("quoted_required") > 0)
    return F.when((label == "bare") & (forced == 0) & (c("bare") > 0), "nothing forced").when(all_forced, "all forced").otherwise("")


def habits_differ() -> Column:
    """Whether header and data are written by different habits, where both can be judged."""
    hv, dv, he, de = value_habit("header_"), value_habit("data_"), empty_habit("header_"), empty_habit("data_")
    values = (hv != "no values") & (dv != "no values") & (hv != dv)
    return values | ((he != "none seen") & (de != "none seen") & (he != de))


def judged(profiles: DataFrame) -> DataFrame:
    """profiles with value_habit, empty_habit, habit (summary), caveat and header_differs."""
    pick = lambda f: F.when(F.col("judged") == "data", f("data_")).when(F.col("judged") == "header", f("header_"))
    value, empty = F.coalesce(pick(value_habit), F.lit("no values")), F.coalesce(pick(empty_habit), F.lit("none seen"))
    return profiles.withColumns({"value_habit": value, "empty_habit": empty, "habit": summary(value, empty), "caveat": F.coalesce(pick(caveat), F.lit("")), "header_differs": habits_differ()})


def across(judged_profiles: DataFrame) -> DataFrame:
    """One row: how many texts, and whether their value and empty habits match."""
    return judged_profiles.agg(F.count("*").alias("texts"), (F.count_distinct("value_habit") <= 1).alias("values_match"), (F.count_distinct("empty_habit") <= 1).alias("empties_match"))


def checks() -> Column:
    """The irregularities of a profile as an array of messages."""
    c = F.col
    judged_bare = F.when(c("judged") == "data", c("data_bare_with_quote")).otherwise(c("header_bare_with_quote"))
    n = lambda col: F.format_number(col, 0)
    found = [
        F.when(c("ragged") > 0, F.concat(F.lit("Rows with a different column count: "), n(c("ragged")), F.lit("."))),
        F.when(c("low_confidence"), "So many rows differ in width that the delimiter or quote mark may be wrong."),
        F.when(c("unterminated") > 0, F.concat(F.lit("Unterminated quotes: "), n(c("unterminated")), F.lit(", first at row "), n(c("first_unterminated")), F.lit("."))),
        F.when(c("junk_after_quote") > 0, F.concat(F.lit("Fields with text after the closing quote: "), n(c("junk_after_quote")), F.lit("."))),
        F.when(judged_bare > 0, F.concat(F.lit("Bare values that hold a quote mark: "), n(judged_bare), F.lit("."))),
        F.when(c("padded_quotes") > 0, F.concat(F.lit("Closing quotes with blanks after them: "), n(c("padded_quotes")), F.lit("."))),
        F.when(c("blank_lines") > 0, F.concat(F.lit("Blank lines left out: "), n(c("blank_lines")), F.lit("."))),
    ]
    return F.filter(F.array(*found), lambda x: x.isNotNull())
