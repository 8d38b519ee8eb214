"""The tokenizer against a plain state machine, and the profile fixtures."""

import csv
import io
import random

import pytest

from rowproof.functions import delimited, habits


def walk(text, delim=",", quote='"'):
    """Records of (value, quoted, unterminated, junk) by walking the characters."""
    out, rec, i, n = [], [], 0, len(text)
    while i < n or rec:
        value, quoted, opened, junk = "", False, False, False
        if i < n and text[i] == quote:
            quoted, opened, i = True, True, i + 1
            while i < n:
                if text[i] == quote:
                    if text[i + 1 : i + 2] == quote:
                        value, i = value + quote, i + 2
                        continue
                    opened, i = False, i + 1
                    break
                if text[i] in "\r\n":
                    i += 2 if text[i : i + 2] == "\r\n" else 1
                    value += "\n"
                else:
                    value, i = value + text[i], i + 1
            while not opened and i < n and text[i] in " \t".replace(delim, ""):
                i += 1
        while i < n and text[i] not in delim + "\r\n":
            value, junk, i = value + text[i], quoted, i + 1
        rec.append((value, quoted, opened, junk))
        if i >= n:
            out.append(rec)
            break
        if text[i] == delim:
            i += 1
            if i >= n:
                rec.append(("", False, False, False))
                out.append(rec)
                break
        else:
            i += 2 if text[i : i + 2] == "\r\n" else 1
            out.append(rec)
            rec = []
    return out


def read(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in delimited.tokens(df, "id", **options).orderBy("id", "record_no", "field_no").collect():
        got.setdefault(r.id, {}).setdefault(r.record_no, []).append((r.value, r.quoted, r.unterminated, r.junk))
    return [list(got.get(i, {}).values()) for i in range(len(texts))]


def test_random_texts_read_as_the_state_machine_reads_them(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(['"', '""', ",", "\n", "\r\n", "\r", " ", "a", "b1", "é", "\t"]) for _ in range(rng.randrange(14))) for _ in range(400)]
    for text, got in zip(texts, read(spark, texts)):
        assert got == walk(text), repr(text)


def test_well_formed_text_reads_as_the_csv_module_reads_it(spark):
    rng = random.Random(6)
    tables = [[[rng.choice(["", "x", "a,b", 'say "hi"', "l1\nl2", " pad ", "é"]) for _ in range(3)] for _ in range(4)] for _ in range(20)]
    texts = []
    for t in tables:
        f = io.StringIO()
        csv.writer(f).writerows(t)
        texts.append(f.getvalue())
    assert [[[v[0] for v in rec] for rec in doc] for doc in read(spark, texts)] == tables


def test_long_records_do_not_overflow(spark):
    (rows,) = read(spark, ['"' + 'x""' * 30_000 + '",2\n' + "1," * 20_000 + "2\n"])
    assert [len(r) for r in rows] == [2, 20_001] and rows[0][0][0] == 'x"' * 30_000


# The profile fixtures.
HABITS = {
    "A,B\n1,x\n": ("bare", "none seen"), '"A","B"\n"1","x"\n': ("always quoted", "none seen"), 'A,B\n1,"x"\n': ("text quoted", "none seen"),
    'A,B\n1,"x,y"\n2,z\n': ("when required", "none seen"), 'A,B\n"1",x\n2,"y"\n': ("mixed", "none seen"), 'A,B\n1,\n2,""\n': ("bare", "mixed"), "": ("no values", "none seen"),
}


def profile(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return habits.judged(delimited.profile(df, "id", **options)).orderBy("id").collect()


def test_habits(spark):
    for r, want in zip(profile(spark, list(HABITS)), HABITS.values()):
        assert (r.value_habit, r.empty_habit) == want


def test_irregularities(spark):
    texts = ["A,B\n1\n", "A,B\n\n1,2\n", 'A,B\n1,"x', 'A,B\n1,"x"y\n', 'A,B\n1,"x" \n', "A,B\r\n1,2\n", 'A,B\n1, \n2," "\n']
    ragged, blank, opened, junk, padded, mixed, spaces = profile(spark, texts)
    assert ragged.ragged == 1 and blank.blank_lines == 1 and blank.data_records == 1
    assert (opened.unterminated, opened.first_unterminated) == (1, 2)
    assert junk.junk_after_quote == 1 and padded.padded_quotes == 1
    assert mixed.newline == "mixed (CRLF, LF)" and (spaces.data_ws_bare, spaces.data_ws_quoted) == (1, 1)


def test_no_header_takes_the_commonest_width(spark):
    (r,) = profile(spark, ["1,2\n3,4\n5\n"], header=False)
    assert (r.columns, r.ragged, r.data_records) == (2, 1, 3)


def test_row_limit_is_an_ordered_prefix(spark):
    (r,) = profile(spark, ["A,B\n1,x\n2,y\n3,z\n"], max_rows=2)
    assert r.data_records == 2 and r.data_fields == 4


def test_dialects(spark):
    texts = ["a|b\n1|2\n", "a\tb\n1\t2\n", "a;b\n'x;y';2\n", "A\n1\n", "a,b\n1,2\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = [(r.delim, r.quote, r.delim_status) for r in delimited.choose_dialect(delimited.dialect_scores(df, "id"), "id").orderBy("id").collect()]
    assert got == [("|", '"', "detected"), ("\t", '"', "detected"), (";", "'", "detected"), (",", '"', "guessed"), (",", '"', "detected")]


def test_same_delimiter_and_quote_is_refused(spark):
    with pytest.raises(ValueError):
        delimited.dialect_scores(spark.createDataFrame([(1, "a")], "id int, text string"), "id", delim='"', quote='"')
