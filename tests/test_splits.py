"""Files in splits: numbers that no setting moves, the line limit before assembly, UTF-16, carriage returns, escapes, and the session's settings."""

import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowproof import __main__ as cli
from rowproof.functions import delimited
from rowproof.plans.reconcile import process_pair
from rowproof.session import scratch
from rowproof.settings import Settings
from rowproof.sources import encoding, files, records

FILES = "spark.sql.files.maxPartitionBytes", "spark.sql.leafNodeDefaultParallelism"


@pytest.fixture
def size(spark):
    """Sets the size of splits."""
    before = spark.conf.get(FILES[0])
    yield lambda n: spark.conf.set(FILES[0], str(n))
    spark.conf.set(FILES[0], before)
    spark.conf.unset(FILES[1])


def read(spark, path, delim=",", quote='"', **options):
    o = records.open_file(spark, str(path))
    rows = records.records(o, delim, quote, **options).orderBy("record_no").collect()
    return [(r.record_no, r.line, r.raw, r.end) for r in rows], o


def whole(spark, data, delim=",", quote='"', codec=None):
    """The same from the text as one value; a line feed ends the last line in any case."""
    text = data.decode(codec) if codec else encoding.decode(data)[0]
    rows = delimited.raw_records(spark.createDataFrame([("p", text)], "path string, text string"), "path", F.col("text"), delim, quote).orderBy("record_no").collect()
    out, line = [], 1
    for r in rows:
        out.append((r.record_no, line, r.raw))
        line += len(delimited.re.findall("\r\n|\r|\n", r.raw)) + 1
    return out


@pytest.mark.parametrize("span", [False, True])
def test_numbers_hold_when_parallelism_changes_between_jobs(spark, tmp_path, size, span):
    field = b'"a\nb"' if span else b"ab"
    lines = [b"%d,%s" % (i, field) for i in range(20001)]
    lines[7], lines[19000] = b"7,\xe9", b"19000,\xe9"
    (tmp_path / "f.csv").write_bytes(b"\n".join(lines) + b"\n")
    size(1 << 20)
    spark.conf.set(FILES[1], "4")
    o = records.open_file(spark, str(tmp_path / "f.csv"))
    spark.conf.set(FILES[1], "8")
    size(30000)
    got = records.records(o, ",", '"')
    spark.conf.set(FILES[1], "3")
    rows = got.select("record_no", "line", F.split("raw", ",")[0].alias("n")).collect()
    step = 2 if span else 1
    want = [(i + 1, i * step + 1, str(i)) for i in range(8)] if not span else None
    assert sorted(r.record_no for r in rows) == list(range(1, 20002)) and all(int(r.n) == r.record_no - 1 for r in rows)
    assert all(r.line == (r.record_no if not span else 2 * r.record_no - 1 - (r.record_no > 8) - (r.record_no > 19001)) for r in rows), want
    assert o.fallback_lines == ([8, 19001] if not span else [15, 38000])


def test_plain_lines_are_not_shuffled_and_crossing_records_are_whole(spark, tmp_path, size):
    (tmp_path / "f.csv").write_bytes(b"".join(b"%d,x\n" % i for i in range(5000)))
    size(4000)
    o = records.open_file(spark, str(tmp_path / "f.csv"))
    rows = records.records(o, ",", '"')
    assert o.lines.rdd.getNumPartitions() >= 6 and "Exchange hash" not in rows._jdf.queryExecution().executedPlan().toString()
    data = b"".join(b'%d,"x%s"\n' % (i, b"\ny" * (i % 5)) for i in range(900)) + b'z,"' + b"l\n" * 3000 + b'"\nend,1'
    (tmp_path / "g.csv").write_bytes(data)
    size(2000)
    got, o = read(spark, tmp_path / "g.csv")
    assert [r[:3] for r in got] == whole(spark, data) and len(o.splits) > 5 and got[-2][2].count("\n") == 3000


def test_an_open_quote_ends_at_the_limit_before_anything_is_put_together(spark, tmp_path, size):
    (tmp_path / "p_a.csv").write_bytes(b'ID,N\n1,a\n2,"open\n' + b"3,some more text\n" * 60_000)
    (tmp_path / "p_b.csv").write_bytes(b"ID,N\n1,a\n")
    size(100_000)
    o = records.open_file(spark, str(tmp_path / "p_a.csv"))
    places = records._placed(o, records._walked(o.lines, ",", '"'))
    assert (places.longest, places.line, places.open_end) == (len(b'2,"open\n') + 17 * 60_000 - 1, 3, True)
    with pytest.raises(ValueError, match="over the limit of 1000; it begins on line 3"):
        records.records(o, ",", '"', 1000)
    with scratch(spark) as folder:
        given = {"p": {s: {"delim": ","} for s in "ab"}}
        r = process_pair(spark, files.Pair("p", str(tmp_path / "p_a.csv"), str(tmp_path / "p_b.csv")), Settings(format_overrides=given, max_line_bytes=100_000))
        assert r.overall == "ERROR" and "A: a line of 10200" in r.message and not files.list_folder(spark, folder)


def test_states_and_lengths_equal_a_walk_line_by_line():
    r = np.random.default_rng(3)
    for _ in range(300):
        n = int(r.integers(1, 30))
        o, i, entry = r.random(n) < 0.4, r.random(n) < 0.6, bool(r.integers(2))
        sizes, cut = r.integers(1, 9, n), r.integers(1, 3, n)
        state, want, starts, lead, longest, held, foreign, begun, where = entry, [], 0, None, 0, 0, entry, 0, 0
        for k in range(n):
            starts += not state
            begun = begun if state else k
            state = bool(i[k] if state else o[k])
            want.append(state)
            held += int(sizes[k])
            if not state:
                size, held = held - int(cut[k]), 0
                if foreign:
                    lead, foreign = size, False
                elif size > longest:
                    longest, where = size, begun
        assert records.states(o, i, entry).tolist() == want
        w, at = records._Walk(entry), int(r.integers(0, n))
        for part in (slice(0, at), slice(at, n)):
            if part.stop > part.start:
                w.add(o[part], i[part], sizes[part], cut[part])
        assert (w.state, w.starts, w.lead, w.longest, w.open, w.begun, w.where) == (state, starts, lead, longest, held, begun, where)


@pytest.mark.parametrize("codec", ["utf-16-le", "utf-16-be"])
def test_utf_16_is_read_in_splits(spark, tmp_path, size, codec):
    text = "﻿" + "".join(f'{i},"é\u0a15{"x" * (i % 40)}\n{i}"\r\n{i},plain \U0001f600\n' for i in range(400))
    data = text.encode(codec)
    (tmp_path / "f.csv").write_bytes(data)
    size(3001)
    got, o = read(spark, tmp_path / "f.csv")
    assert o.texts is None and o.lines.rdd.getNumPartitions() >= 4 and o.label.startswith("UTF-16")
    assert [r[:3] for r in got] == whole(spark, text[1:].encode())
    # The bytes of a line feed across two characters, and an odd byte at the end.
    odd = ("a,b\n" + "\u0a15\u3000\u0a00," * 9 + "\n1,2\n").encode(codec)
    (tmp_path / "g.csv").write_bytes(encoding.codecs.BOM_UTF16_LE * (codec == "utf-16-le") + encoding.codecs.BOM_UTF16_BE * (codec == "utf-16-be") + odd)
    got, o = read(spark, tmp_path / "g.csv")
    assert o.texts is not None and [r[2] for r in got] == odd.decode(codec).split("\n")[:3]
    (tmp_path / "h.csv").write_bytes(data[:200] + b"\n\x00x")
    with pytest.raises(ValueError):
        records.open_file(spark, str(tmp_path / "h.csv"))


def test_carriage_returns_alone_are_read_in_splits(spark, tmp_path, size):
    data = b"".join(b'%d,"x\ry"\r%d,\xc3\xa9\r' % (i, i) for i in range(600)) + b"end,1"
    (tmp_path / "f.csv").write_bytes(data)
    size(2000)
    got, o = read(spark, tmp_path / "f.csv")
    assert o.sep == "\r" and o.lines.rdd.getNumPartitions() >= 4 and [r[:3] for r in got] == whole(spark, data)
    assert tuple(records.newlines(o).first()) == (str(tmp_path / "f.csv"), 0, 0, 1800, "CR")
    late = b"a\r" * (records.HEAD_BYTES // 2 + 10) + b"b\nc\n"  # the opening has none of the line feeds
    (tmp_path / "g.csv").write_bytes(late)
    o = records.open_file(spark, str(tmp_path / "g.csv"))
    assert o.sep == "\n" and tuple(records.newlines(o).first())[1:] == (0, 2, late.count(b"\r"), "mixed (LF, CR)")


def machine(text, delim, quote, escape):
    """Records of (value, unterminated, junk) by a walk over the characters."""
    out, row, k, n = [], [], 0, len(text)
    while k < n:
        value, open_, junk = "", False, False
        if text[k] == quote:
            k, open_ = k + 1, True
            while k < n:
                c = text[k]
                if c == escape and escape != quote:
                    if k + 1 < n and text[k + 1] in (quote, escape):
                        value, k = value + text[k + 1], k + 2
                    else:
                        value, junk, k = value + c, True, k + 1
                        if k < n:
                            value, k = value + text[k], k + 1
                elif c == escape and text[k + 1 : k + 2] == quote:
                    value, k = value + quote, k + 2
                elif c == quote:
                    k, open_ = k + 1, False
                    break
                else:
                    value, k = value + c, k + 1
            rest = ""
            while k < n and not open_ and text[k] not in (delim, "\n", "\r"):
                rest, k = rest + text[k], k + 1
            junk = junk or rest.lstrip(" \t") != ""
            value = value.replace("\r\n", "\n").replace("\r", "\n") + rest.lstrip(" \t")
        else:
            while k < n and text[k] not in (delim, "\n", "\r"):
                value, k = value + text[k], k + 1
        row.append((None if junk else value, open_, junk))
        if k < n and text[k] == delim:
            k += 1
            if k == n:
                row.append(("", False, False))
        elif k < n:
            k += 2 if text[k : k + 2] == "\r\n" else 1
            out.append(row)
            row = []
    return out + ([row] if row else [])


def fields(rows, delim, quote):
    facts = F.transform("fields", lambda x: F.struct(*[v.alias(k) for k, v in delimited.field_facts(x, delim, quote).items() if k in ("value", "unterminated", "junk")]))
    found = delimited.raw_fields(rows, delim, quote).select("path", "record_no", facts.alias("f")).orderBy("path", "record_no").collect()
    out = {}
    for r in found:
        out.setdefault(r.path, []).append([(None if x["junk"] else x["value"], x["unterminated"], x["junk"]) for x in r.f])
    return out


@pytest.mark.parametrize("escape", ["\\", '"'])
def test_escapes_equal_a_state_machine_at_any_split(spark, tmp_path, size, escape):
    rng, quote = random.Random(11), '"' + escape.replace('"', "")
    bits = ['"', "\\", '\\"', "\\\\", '""', "|", "|", "\n", "\n", "\r\n", " ", "a", "é", '"|"', '"\n"']
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    df = spark.createDataFrame([(f"{i:03}", t) for i, t in enumerate(texts)], "path string, text string")
    got = fields(delimited.raw_records(df, "path", df.text, "|", quote), "|", quote)
    for i, t in enumerate(texts):
        assert got.get(f"{i:03}", []) == machine(t, "|", '"', escape), (t, escape)
    long = "".join(t + "\n" for t in texts[:60])
    (tmp_path / "f.csv").write_bytes(long.encode())
    for n in (7, 100):
        size(n)
        found = fields(records.records(records.open_file(spark, str(tmp_path / "f.csv")), "|", quote), "|", quote)
        assert found[str(tmp_path / "f.csv")] == machine(long, "|", '"', escape)


def test_a_pair_with_an_escape(spark, tmp_path):
    args = cli.parser().parse_args(["compare", "in", "out", "--format", "one:a=pipe+double+backslash", "--format", "one:b=comma"])
    given = cli.settings_of(args).format_overrides
    assert given == {"one": {"a": {"delim": "|", "quote": '"', "escape": "\\"}, "b": {"delim": ",", "quote": '"'}}}
    (tmp_path / "a.csv").write_text('ID|N\n1|"say \\"hi\\" \\\\"\n2|"x|\ny"\n3|"bad \\x"\n')
    (tmp_path / "b.csv").write_text('ID,N\n1,"say ""hi"" \\"\n2,"x|\ny"\n3,"bad"\n')
    r = process_pair(spark, files.Pair("one", str(tmp_path / "a.csv"), str(tmp_path / "b.csv")), Settings(format_overrides=given, reject_limit_percent=50))
    assert (r.rows, r.rejected, r.metrics.matched_rows) == ((2, 3), (1, 0), 2), r.message
    assert [(x.line, x.error_type) for x in r.rejects.collect()] == [(5, "INVALID STATE")]


def test_settings_that_spark_was_started_with_win():
    code = (
        "from rowproof.session import get_session\ns = get_session('t', **{'spark.sql.shuffle.partitions': '5', 'spark.sql.session.timeZone': 'UTC'})\n"
        "print('GOT', s.sparkContext.master, s.conf.get('spark.sql.shuffle.partitions'), s.conf.get('spark.sql.adaptive.enabled'), s.sparkContext.getConf().get('spark.driver.memory', 'none'), s.conf.get('spark.sql.session.timeZone'))"
    )
    env = os.environ | {"PYTHONPATH": os.getcwd() + os.pathsep + os.environ.get("PYTHONPATH", "")}
    run = lambda **more: next(x for x in subprocess.run([sys.executable, "-c", code], env=env | more, capture_output=True, text=True, timeout=120).stdout.splitlines() if x.startswith("GOT"))
    given = "--master local[2] --conf spark.sql.shuffle.partitions=77 --driver-memory 600m pyspark-shell"
    assert run(PYSPARK_SUBMIT_ARGS=given) == "GOT local[2] 77 true 600m UTC"
    assert run() == "GOT local[*] 5 true 12g UTC"
