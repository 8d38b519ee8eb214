"""Lists are written beside their target, rows and cut cells are counted, and all outputs go to one store."""

import zipfile

import pytest
from pyspark.sql import functions as F

from rowproof import __main__ as cli
from rowproof.plans.reconcile import Result
from rowproof.settings import Settings
from rowproof.sinks.csv import write_csv
from rowproof.sinks.workbook import MAX_CHARS, write_workbook
from rowproof.sources import files


def lines(folder):
    return sorted(x for f in folder.glob("part-*") for x in f.read_text().splitlines())


def test_a_failing_write_leaves_the_old_list(spark, tmp_path):
    at = tmp_path / "x.csv"
    old = spark.createDataFrame([("1",), ("2",)], "a string")
    assert write_csv(old, str(at), ["A"], one_file=True) == (str(at), 2) and lines(at) == ["1", "2", "A"]
    bad = spark.range(2).select(F.when(F.col("id") == 1, F.raise_error(F.lit("no"))).otherwise("3").alias("a"))
    with pytest.raises(Exception, match="no"):
        write_csv(bad, str(at), ["A"])
    assert lines(at) == ["1", "2", "A"] and [p.name for p in tmp_path.iterdir()] == ["x.csv"]
    assert write_csv(old.limit(1), str(at), ["A"], one_file=True)[1] == 1 and lines(at) == ["1", "A"]
    assert write_csv(old.where("false"), str(at), ["A"])[1] == 0 and [p.name for p in tmp_path.iterdir()] == ["x.csv"]


def test_a_list_that_cannot_be_replaced_gets_a_dated_name(spark, tmp_path, monkeypatch):
    (tmp_path / "new").mkdir()
    (tmp_path / "x.csv").mkdir()
    (tmp_path / "x.csv" / "keep").write_text("1")
    fs, path = files._store(spark, str(tmp_path))

    class Stuck:
        """A store that does not move x.csv."""

        def __getattr__(self, name):
            return getattr(fs, name)

        def rename(self, a, b):
            return False if a.getName() == "x.csv" else fs.rename(a, b)

    store = files._store
    monkeypatch.setattr(files, "_store", lambda s, p: (Stuck(), store(s, p)[1]))
    got = files.replace(spark, str(tmp_path / "new"), str(tmp_path / "x.csv"))
    assert got.startswith(str(tmp_path / "x_2")) and got.endswith(".csv") and (tmp_path / "x.csv" / "keep").exists() and not (tmp_path / "new").exists()


def test_cut_cells_and_written_rows_are_on_the_summary(spark, tmp_path):
    rejects = spark.createDataFrame([("f", 1, "E", "m", "x" * (MAX_CHARS + 1)), ("f", 2, "E", "m", "x" * MAX_CHARS)], "file string, line long, error_type string, error_message string, raw_line string")
    r = Result("p", overall="MISMATCH", rejects=rejects, written={"rejected": 2})
    assert write_workbook(r, str(tmp_path / "p.xlsx"), Settings()) == ["Summary", "Column differences", "Rejected"]
    with zipfile.ZipFile(tmp_path / "p.xlsx") as z:
        text = z.read("xl/worksheets/sheet1.xml").decode()
    cells = [x.partition("<")[0] for x in text.split('preserve">')[1:]]
    assert cells[cells.index("Cells cut in sheets") + 1] == "1" and cells[cells.index("Rows written: rejected") + 1] == "2"


def test_the_command_line_writes_to_a_store(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p_a.csv").write_text("ID,N\n1,a\n2,b\n")
    (tmp_path / "in" / "p_b.csv").write_text("ID,N\n1,a\n2,c\n")
    monkeypatch.chdir(tmp_path)
    assert cli.main(["compare", str(tmp_path / "in"), (tmp_path / "out").as_uri()]) == 0
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["p.xlsx", "p_differences.csv", "run_log.txt"]
    assert "p: 1 rows in p_differences.csv" in (tmp_path / "out" / "run_log.txt").read_text() and sorted(p.name for p in tmp_path.iterdir()) == ["in", "out"]


def test_addresses_of_a_store_are_expanded(spark, tmp_path):
    for name in ("b.csv", "A.CSV", "c.txt", "sub/d.csv"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("A\n1\n")
    address, names = tmp_path.as_uri(), lambda found: [p.rsplit("/", 1)[-1] for p in found]
    assert names(files.expand([address], spark=spark)) == ["A.CSV", "b.csv"]
    assert names(files.expand([address], True, spark)) == ["A.CSV", "b.csv", "d.csv"]
    assert names(files.expand([f"{address}/*.txt", f"{address}/none*"], spark=spark)) == ["c.txt", "none*"]


def test_the_self_check_reads_a_file_in_splits(spark, monkeypatch):
    from rowproof.plans import reconcile

    assert reconcile.self_check(spark)
    opened = []
    real = reconcile.records.open_file
    monkeypatch.setattr(reconcile.records, "open_file", lambda s, p, *a: opened.append(real(s, p, *a)) or opened[-1])
    assert reconcile.self_check(spark) and opened[0].lines is not None and opened[0].texts is None
    monkeypatch.setattr(reconcile, "SELF_CHECK", ("x", *reconcile.SELF_CHECK[1:9], "\r", "é"))
    assert not reconcile.self_check(spark)  # a lone carriage return outside quotes ends a record


def test_a_pair_as_one_table(spark, tmp_path):
    from rowproof.plans.reconcile import read_pair

    (tmp_path / "a.csv").write_text('ID,N\n1,"x\ny"\n')
    (tmp_path / "b.csv").write_text('ID,N\n1,"x" z\n2,"open')
    given = Settings(format_overrides={"p": {s: {"delim": ","} for s in "ab"}})
    got = read_pair(spark, files.Pair("p", str(tmp_path / "a.csv"), str(tmp_path / "b.csv")), given).orderBy("side", "record_no").collect()
    assert [(r.side, r.record_no, r.line, r.cells, r.error) for r in got] == [
        ("A", 1, 1, ["ID", "N"], None), ("A", 2, 2, ["1", "x\ny"], None), ("B", 1, 1, ["ID", "N"], None), ("B", 2, 2, ["1", "xz"], "INVALID STATE"), ("B", 3, 3, ["2", "open"], "UNQUOTED VALUE"),
    ]
