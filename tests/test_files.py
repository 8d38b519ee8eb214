"""Discovery, decoding, headers, rejects, and pairs of files end to end."""

import zipfile

import pytest

from rowproof.plans.quoting import full_report, profile_file, short_report
from rowproof.plans.reconcile import process_pair, self_check
from rowproof.settings import Settings
from rowproof.sinks.csv import unique_names, write_lists
from rowproof.sinks.workbook import CUT, MAX_CHARS, cell, write_workbook
from rowproof.sources import encoding, files, tables


def pair(folder, a, b, prefix="p"):
    for side, data in (("a", a), ("b", b)):
        (folder / f"{prefix}_{side}.csv").write_bytes(data)
    return files.Pair(prefix, str(folder / f"{prefix}_a.csv"), str(folder / f"{prefix}_b.csv"))


def test_discovery(spark, tmp_path):
    for name in ("One_A.csv", "one_b.csv", "lonely_a.csv", "x_a (1).csv", ".hid_a.csv"):
        (tmp_path / name).write_text("ID\n1\n")
    d = files.discover(spark, str(tmp_path), "_a.csv", "_b.csv")
    assert [p.prefix for p in d.pairs] == ["One"] and d.unpaired == ["lonely_a.csv"] and d.ignored == ["x_a (1).csv"]
    assert files.discover(spark, str(tmp_path / "no"), "_a", "_b").ignored
    (tmp_path / "ONE_b.csv").write_text("ID\n2\n")
    d = files.discover(spark, str(tmp_path), "_a.csv", "_b.csv")
    assert d.pairs == [] and sorted(d.ambiguous) == ["ONE_b.csv", "One_A.csv", "one_b.csv"]
    assert files.expand([str(tmp_path), str(tmp_path / "*.nope")])[-1].endswith("*.nope")
    assert files.room_for(str(tmp_path / "deep" / "er"), [1], 1)[0] and not files.room_for(str(tmp_path), [1 << 60], 4)[0]


def test_decoding():
    text = "ID,N\n1,café\n"
    assert encoding.decode(text.encode())[:2] == (text, "UTF-8")
    assert encoding.decode(b"\xff\xfe" + text.encode("utf-16-le"))[:2] == (text, "UTF-16LE (BOM)")
    assert encoding.decode(b"\xfe\xff" + text.encode("utf-16-be"))[:2] == (text, "UTF-16BE (BOM)")
    assert "NUL pattern" in encoding.decode("ID,NAME\n1,hello\n".encode("utf-16-le"))[1]
    assert encoding.decode(b"a\xe9\n\x81\x80 ok \xc3\xa9") == ("aé\n\x81€ ok é", "UTF-8 with cp1252 bytes", 3, [1, 2])
    assert encoding.decode(b"caf\xe9", "file")[:2] == ("café", "cp1252")
    with pytest.raises(UnicodeDecodeError):
        encoding.decode(b"\x81\xe9", "file")


def test_headers():
    same = tables.compare_headers(["CUST_ID", "NAME"], ["cust_id ", " name"])
    assert same.match and same.display == ["CUST_ID", "NAME"]
    other = tables.compare_headers(["A", "B", "C"], ["A", "X"])
    assert [p[3] for p in other.positions] == ["Match", "Different", "Extra in A"]
    assert tables.display_names(["A", "a ", "B"]) == ["A (1)", "a (2)", "B"]
    assert unique_names(["Status", "status", "x"]) == ["Status", "status_1", "x"]


def test_reject_limit_is_strict():
    assert not tables.over_limit(99, 1, 1.0) and tables.over_limit(98, 1, 1.0) and not tables.over_limit(0, 0, 1.0) and tables.over_limit(0, 1, 1.0)


def test_self_check(spark):
    assert self_check(spark)


def test_awkward_pair_matches(spark, tmp_path):
    p = pair(tmp_path, b'ID,NOTE\r\n1,"line1\r\nline2"\r\n2,"say ""hi"""\r\n', "ID|note \n1|\"line1\nline2\"\n2|\"say \"\"hi\"\"\"\n".encode())
    r = process_pair(spark, p)
    assert r.overall == "MATCH", r.message
    assert r.rows == (2, 2) and [f.delim for f in r.formats] == [",", "|"]


def test_mixed_encoding_and_rejects(spark, tmp_path):
    a = b"ID,N\n" + b"".join(b"%d,x\n" % i for i in range(150))
    p = pair(tmp_path, a + "999,é\n".encode(), a + b"999,\xe9\nbad_only_one_field\n")
    r = process_pair(spark, p, Settings(format_overrides={"p": {"a": {"delim": ","}, "b": {"delim": ","}}}))
    assert r.rejected == (0, 1) and r.overall == "MISMATCH" and r.metrics.matched_rows == 151 and r.warnings
    bad = r.rejects.first()
    assert (bad.line, bad.error_type, bad.raw_line) == (153, "MISSING COLUMNS", "bad_only_one_field")


def test_too_many_rejects_and_column_differences(spark, tmp_path):
    rows = b"ID,NAME\n" + b"".join(b"%d,x\n" % i for i in range(10))
    given = {"p": {"b": {"delim": ","}}}
    p = pair(tmp_path, rows, b"ID,NAME\n" + b"too,many,fields,here\n" * 5)
    r = process_pair(spark, p, Settings(format_overrides=given))
    assert (r.overall, r.rows) == ("Too many malformed lines", (10, 0))
    r = process_pair(spark, pair(tmp_path, b"A,B,C\n1,2,3\n", b"A,B,D,E\n1,2,3,4\n", "q"))
    assert (r.overall, r.rows) == ("COLUMNS DIFFER", (1, 1))
    assert process_pair(spark, files.Pair("gone", "/nowhere/a.csv", "/nowhere/b.csv")).overall == "ERROR"
    assert "over the limit" in process_pair(spark, p, Settings(format_overrides=given, max_line_bytes=3)).message


def test_outputs(spark, tmp_path):
    p = pair(tmp_path, b"ID,V\n1,a \n2,b\n3,c\n4,d\n5,e\n", b"ID,V\n1,a\n2,b\n3,c\n4,d\n9,z\n")
    settings = Settings()
    r = process_pair(spark, p, settings)
    assert r.key.names == ["ID"], r
    written = write_lists(r, str(tmp_path / "out"), settings.sides)
    assert set(written) == {"differences", "unpaired"}
    lines = [x for f in (tmp_path / "out" / "p_differences.csv").glob("part-*") for x in f.read_text().splitlines()]
    assert "1,V,a,a ,1,1" in lines
    sheets = write_workbook(r, str(tmp_path / "p.xlsx"), settings)
    assert sheets == ["Summary", "Column differences", "Differences", "Unpaired"]
    with zipfile.ZipFile(tmp_path / "p.xlsx") as z:
        assert "'a '" in z.read("xl/worksheets/sheet3.xml").decode()
    assert cell("x" * 40_000).endswith(CUT) and len(cell("x" * 40_000)) == MAX_CHARS and cell(None) == ""


def test_quote_profile_of_files(spark, tmp_path):
    (tmp_path / "f.csv").write_text('ID,NAME,ID\n1,"x",2\n2,"y",\n')
    found = [profile_file(spark, str(tmp_path / "f.csv")), profile_file(spark, str(tmp_path / "gone.csv"))]
    assert found[0].groups() == {"with": ["NAME"], "without": ["ID (column 1)", "ID (column 3)"], "both": []}
    assert found[0].profile.value_habit == "text quoted" and found[1].error == "File not found."
    assert "File not found." in short_report(found) and "column NAME: 2 quoted, 0 bare" in full_report(found)
