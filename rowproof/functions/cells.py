"""Expressions over single cells: text form, row hash, number shapes, kinds of written fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Whole-value patterns; \\A and \\z, as $ would accept a trailing line break.
INTEGER, DECIMAL = r"\A-?[0-9]+\z", r"\A-?([0-9]+\.[0-9]*|\.[0-9]+)\z"
NUMBER = r"\A[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\z"


def as_text(col: Column, kind: T.DataType) -> Column:
    """A cell as text: null is empty, strings stay as they are, floats get a fixed form that no engine prints otherwise."""
    if isinstance(kind, T.StringType):
        text = col
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = col.cast(T.DecimalType(38, 6)).cast("string")
    elif isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        text = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
    elif isinstance(kind, T.BinaryType):
        text = F.hex(col)
    else:
        text = col.cast("string")
    return F.coalesce(text, F.lit(""))


def to_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The columns as text under the positional names c1 .. cN."""
    chosen = columns or df.columns
    return df.select(*[as_text(F.col(f"`{c}`"), df.schema[c].dataType).alias(f"c{i}") for i, c in enumerate(chosen, 1)])


def row_hash(columns: list[str]) -> Column:
    """MD5 over the cells, each after its length in bytes, so that the hashed text is injective."""
    parts: list[Column] = []
    for c in columns:
        parts += [F.octet_length(c).cast("string"), F.lit(":"), F.col(c)]
    return F.unhex(F.md5(F.concat(*parts)))


def with_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("h", row_hash([c for c in df.columns if c != "h"]))


def shape_counts(c: str) -> dict[str, Column]:
    """Aggregates of the non-empty cells that look like integers, like decimals, like neither."""
    col = F.col(c)
    whole, part = F.rlike(col, F.lit(INTEGER)), F.rlike(col, F.lit(DECIMAL))
    return {
        "integer": F.count_if((col != "") & whole),
        "decimal": F.count_if((col != "") & part),
        "text": F.count_if((col != "") & ~whole & ~part),
    }


def shape_label(integer: Column, decimal: Column, text: Column) -> Column:
    kinds = sum(((x > 0).cast("int") for x in (integer, decimal, text)), F.lit(0))
    return (
        F.when(kinds == 0, "Empty").when(kinds > 1, "Mixed").when(integer > 0, "Integer-like").when(decimal > 0, "Decimal-like").otherwise("Text")
    )


def is_number(value: Column) -> Column:
    """Plain integers and decimals with an optional sign or exponent, of 64 characters at most."""
    return (F.length(value) <= 64) & F.rlike(value, F.lit(NUMBER))
