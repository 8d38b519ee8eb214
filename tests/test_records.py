"""Files read in splits against the reading of their whole text; encodings, large files, repeated calls and settings."""

import random
import time

import pytest

from rowproof import __main__ as cli
from rowproof.functions import delimited
from rowproof.plans.quoting import profile_file, write_details
from rowproof.plans.reconcile import process_pair
from rowproof.session import scratch
from rowproof.settings import Settings
from rowproof.sources import encoding, files, records

SPLIT = "spark.sql.files.maxPartitionBytes"


def whole(spark, data, delim=",", quote='"'):
    """(record_no, raw) by reading the decoded text as one value."""
    df = spark.createDataFrame([("p", encoding.decode(data)[0])], "path string, text string")
    rows = delimited.raw_records(df, "path", df.text, delim, quote).orderBy("record_no").collect()
    out, line = [], 1
    for r in rows:
        out.append((r.record_no, line, r.raw.rstrip("\n")))
        line += len(delimited.re.findall("\r\n|\r|\n", r.raw)) + 1
    return out


def split(spark, path, delim=",", quote='"'):
    rows = records.records(records.open_file(spark, str(path)), delim, quote).orderBy("record_no").collect()
    return [(r.record_no, r.line, r.raw.rstrip("\n")) for r in rows]


# Files that splits could cut badly.
FIXTURES = {
    "plain": b"a,b\n1,2\n3,4\n", "crlf": b"a,b\r\n1,2\r\n\r\n3,4\r\n", "cr": b"a,b\r1,2\r3,4", "no end": b"a,b\n1,2", "blank": b"\n\na\n\n", "empty": b"",
    "spans": b'a,b\n1,"x\ny\n\nz"\n2,"q"\n3,"p\n', "doubled": b'a,b\n1,"x ""\n"" y"\n"","\n"""\n4,5\n', "bare marks": b'a,b\n1,x "y\n2,z"\n3," w"t\n"u\nv",1\n',
    "marked": "﻿a,b\n1,é\n".encode(), "mixed": b"a,b\n1,\xe9\n\xff,\x81\xc3\xa9\n3,\xe2\x82\n", "mixed span": b'a,b\n1,"\xe9\n\xc3\xa9\xff"\n', "utf-16": "a,b\n1,é\n".encode("utf-16"),
    "mixed breaks": b'a,b\r1,"x\r\ny"\n2,3\r\r\n4,"\r"\n',
}


@pytest.fixture
def sizes(spark):
    before = spark.conf.get(SPLIT)
    yield ("6", before)
    spark.conf.set(SPLIT, before)


@pytest.mark.parametrize("name", FIXTURES)
def test_splits_do_not_change_records(spark, tmp_path, sizes, name):
    (tmp_path / "f.csv").write_bytes(FIXTURES[name])
    want = whole(spark, FIXTURES[name])
    spark.conf.set(SPLIT, sizes[0])
    assert split(spark, tmp_path / "f.csv") == want


def test_random_files_read_alike_at_any_split_size(spark, tmp_path, sizes):
    rng = random.Random(8)
    for i in range(1):
        data = "".join(rng.choice(['"', '""', ",", "\n", "\n", "\r\n", "\r", " ", "a", "é", '","', '"\n']) for _ in range(60)).encode()
        (tmp_path / f"{i}.csv").write_bytes(data)
        want = whole(spark, data)
        spark.conf.set(SPLIT, "9")
        assert split(spark, tmp_path / f"{i}.csv") == want, data


def test_fallback_is_linear_and_reported(spark, tmp_path):
    start = time.process_time()
    text, count, lines = encoding.mixed(b"ab\xe9\n" * 500_000)
    assert (count, lines, len(text)) == (500_000, list(range(1, 11)), 2_000_000) and time.process_time() - start < 10
    (tmp_path / "f.csv").write_bytes(b"a\n" * 20 + b"\xe9\n" * 12 + b"\xe9\xe9")
    o = records.open_file(spark, str(tmp_path / "f.csv"))
    assert (o.label, o.fallback_bytes, o.fallback_lines) == (encoding.MIXED, 14, list(range(21, 31)))
    assert records.open_file(spark, str(tmp_path / "f.csv"), "file").label == "cp1252"


def test_pairs_at_small_splits(spark, tmp_path, sizes):
    a = b"ID,N\n" + b"".join(b'%d,"x\ny"\n' % i for i in range(60)) + b"bad\n"
    (tmp_path / "p_a.csv").write_bytes(a)
    (tmp_path / "p_b.csv").write_bytes(a.replace(b'\n7,"x', b'\n7,"z').replace(b"\n", b"\r\n"))
    spark.conf.set(SPLIT, "200")
    given = {"P": {s: {"delim": ","} for s in "ab"}}  # whatever the case, as for keys
    with scratch(spark) as folder:
        r = process_pair(spark, files.Pair("p", str(tmp_path / "p_a.csv"), str(tmp_path / "p_b.csv")), Settings(format_overrides=given, reject_limit_percent=5))
        assert (r.overall, r.rows, r.rejected, r.counts["Differing cells"]) == ("MISMATCH", (60, 60), (1, 1), 1), r.message
        assert r.rejects.first().line == 122 and r.formats[0].source == "settings"
        assert files.list_folder(spark, folder) is not None
    assert files.list_folder(spark, folder) is None


def test_no_room_is_an_error(spark, tmp_path):
    for s in "ab":
        (tmp_path / f"p_{s}.csv").write_bytes(b"ID\n1\n")
    r = process_pair(spark, files.Pair("p", str(tmp_path / "p_a.csv"), str(tmp_path / "p_b.csv")), Settings(disk_factor=1e15))
    assert r.overall == "ERROR" and "not enough room" in r.message


def test_profiles_of_split_files(spark, tmp_path, sizes):
    data = b'A,B\r\n1,"x\ny"\r\n\r\n2,\xe9\n3,"open'
    (tmp_path / "f.csv").write_bytes(data)
    found = []
    for size in sizes:
        spark.conf.set(SPLIT, size)
        f = profile_file(spark, str(tmp_path / "f.csv"))
        found.append((f.error, f.encoding, f.names, f.profile, f.columns, f.samples))
    assert found[0] == found[1] and found[0][1] == "cp1252" and found[0][2] == ["A", "B"]
    p = found[0][3]
    assert (p.data_records, p.blank_lines, p.unterminated, p.first_unterminated, p.newline) == (3, 1, 1, 5, "mixed (CRLF, LF)")
    assert profile_file(spark, str(tmp_path / "f.csv"), max_rows=1).profile.data_records == 1


def test_detail_reports_do_not_collide(spark, tmp_path):
    paths = []
    for d in ("one", "two", "three"):
        (tmp_path / d).mkdir()
        (tmp_path / d / ("X.csv" if d == "two" else "x.csv")).write_text("A\n1\n")
        paths.append(str(next((tmp_path / d).iterdir())))
    written = write_details([profile_file(spark, p) for p in paths], str(tmp_path / "out"))
    assert [w.rsplit("/", 1)[-1] for w in written] == ["x.csv.txt", "X.csv-2.txt", "x.csv-3.txt"]
    assert "no delimiter was found" in (tmp_path / "out" / "x.csv.txt").read_text()


def test_settings_from_the_command_line(tmp_path):
    def parse(*more):
        return cli.settings_of(cli.parser().parse_args(["compare", str(tmp_path), str(tmp_path / "out"), *more]))

    s = parse("--format", "One:b=pipe+single", "--no-key", "two", "--key", "three=A,B", "--key-min-overlap", "0.5", "--reject-limit-percent", "2", "--key-mode", "none", "--bare-values", "--name-a", "old")
    assert s.format_overrides == {"One": {"b": {"delim": "|", "quote": "'"}}} and s.key_overrides == {"two": None, "three": ["A", "B"]}
    assert (s.key_min_overlap, s.reject_limit_percent, s.key_mode, s.quote_values, s.sides, s.sample_rows) == (0.5, 2.0, "none", False, ("old", "B"), 100_000)
    with pytest.raises(SystemExit):
        parse("--format", "One=pipe")
    assert cli.main(["quotes", str(tmp_path), "--max-rows", "-1"]) == 2
