"""python -m rowproof compare IN OUT | quotes PATH..."""

from __future__ import annotations

import argparse
import sys
import tempfile
from dataclasses import fields
from pathlib import Path

from rowproof.plans.quoting import full_report, profile_file, short_report, write_details
from rowproof.plans.reconcile import process_pair, self_check
from rowproof.session import get_session, scratch, ship
from rowproof.settings import Settings
from rowproof.sinks.csv import write_lists
from rowproof.sinks.workbook import write_workbook
from rowproof.sources.files import discover, expand, put

# Names that stand for delimiters and quote marks.
DELIMITER_NAMES = {"comma": ",", "pipe": "|", "tab": "\t", "semicolon": ";", "\\t": "\t"}
QUOTE_NAMES = {"double": '"', "single": "'"}
ESCAPE_NAMES = {"backslash": "\\"}


def split_option(text: str, what: str) -> tuple[str, str]:
    name, sign, value = text.partition("=")
    if not (name and sign):
        raise SystemExit(f"{what} is written NAME=VALUE, not {text!r}")
    return name, value


def settings_of(args: argparse.Namespace) -> Settings:
    """The settings that the command line gives; what it does not name keeps its default."""
    formats: dict[str, dict[str, dict[str, str]]] = {}
    for text in args.format:
        name, value = split_option(text, "--format")
        pair, _, side = name.rpartition(":")
        delim, quote, escape = (value.split("+", 2) + ["", ""])[:3]
        if side not in ("a", "b") or not pair:
            raise SystemExit(f"--format is written PAIR:a=DELIMITER+QUOTE or PAIR:a=DELIMITER+QUOTE+ESCAPE, not {text!r}")
        formats.setdefault(pair, {})[side] = {"delim": DELIMITER_NAMES.get(delim, delim) or ",", "quote": QUOTE_NAMES.get(quote, quote) or '"'} | ({"escape": ESCAPE_NAMES.get(escape, QUOTE_NAMES.get(escape, escape))} if escape else {})
    keys: dict[str, list[str] | None] = {k: v.split(",") for k, v in (split_option(x, "--key") for x in args.key)}
    keys |= {name: None for name in args.no_key}
    plain = {f.name: getattr(args, f.name) for f in fields(Settings) if getattr(args, f.name, None) is not None}
    return Settings(**plain, sides=(args.name_a, args.name_b), key_overrides=keys, format_overrides=formats, quote_values=not args.bare_values)


def compare(args: argparse.Namespace) -> int:
    spark = get_session("rowproof compare")
    ship(spark)
    settings = settings_of(args)
    if not self_check(spark):
        print("The reader does not return cells unchanged; nothing was compared.")
        return 2
    found = discover(spark, args.folder, settings.suffix_a, settings.suffix_b)
    out = args.out.rstrip("/") if "://" in args.out else Path(args.out).absolute().as_uri()
    # The log and the workbooks are made here and copied to the store that the lists are written to.
    with tempfile.TemporaryDirectory() as here:
        log = Path(here) / "run_log.txt"

        def say(line: str) -> None:
            print(line)
            with log.open("a", encoding="utf-8") as f:
                f.write(line + "\n")
            put(spark, str(log), f"{out}/run_log.txt")

        for name in found.ignored + found.unpaired:
            say(f"{name}: no pair")
        for name in found.ambiguous:
            say(f"{name}: not compared, as another file of its side has this name in other letters")
        for pair in found.pairs:
            with scratch(spark):  # what a pair wrote to work with goes when its outputs are written
                result = process_pair(spark, pair, settings)
                written = write_lists(result, out, settings.sides)
                write_workbook(result, f"{here}/{pair.prefix}.xlsx", settings)
                put(spark, f"{here}/{pair.prefix}.xlsx", f"{out}/{pair.prefix}.xlsx")
                say(f"{pair.prefix}: {result.overall} {result.message}".rstrip() + f" ({result.rows[0]} and {result.rows[1]} rows, {sum(s for _, s in result.timings):.1f} s)")
                for kind, path in written.items():
                    say(f"{pair.prefix}: {result.written[kind]} rows in {path.rsplit('/', 1)[-1]}")
    return 0


def quotes(args: argparse.Namespace) -> int:
    delim, quote = DELIMITER_NAMES.get(args.delimiter, args.delimiter), QUOTE_NAMES.get(args.quote, args.quote)
    if any(x and len(x) != 1 for x in (delim, quote)) or (delim and delim == quote):
        print("Delimiter and quote mark are one character each, and differ.", file=sys.stderr)
        return 2
    if args.max_rows < 0:
        print("--max-rows is 0 (all) or more.", file=sys.stderr)
        return 2
    spark = get_session("rowproof quotes") if any("://" in p for p in args.paths) else None
    paths = expand(args.paths, args.recursive, spark)
    if not paths:
        print("No files.", file=sys.stderr)
        return 1
    spark = spark or get_session("rowproof quotes")
    ship(spark)
    found = []
    for p in paths:
        with scratch(spark):
            found.append(profile_file(spark, p, delim, quote, args.encoding, not args.no_header, args.max_rows))
    print(short_report(found), end="")
    if args.report:
        Path(args.report).write_text(full_report(found), encoding="utf-8")
    if args.details:
        write_details(found, args.details)
    return int(any(f.error for f in found))


def parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="rowproof", description=__doc__)
    commands = parser.add_subparsers(required=True)
    c = commands.add_parser("compare", help="compare pairs of delimited files")
    c.add_argument("folder")
    c.add_argument("out")
    c.add_argument("--suffix-a", default="_a.csv")
    c.add_argument("--suffix-b", default="_b.csv")
    c.add_argument("--name-a", default="A")
    c.add_argument("--name-b", default="B")
    c.add_argument("--key", action="append", default=[], metavar="PAIR=COL,COL")
    c.add_argument("--no-key", action="append", default=[], metavar="PAIR", help="compare this pair row by row")
    c.add_argument("--format", action="append", default=[], metavar="PAIR:SIDE=DELIMITER+QUOTE+ESCAPE", help="SIDE is a or b, e.g. one:b=pipe+double; the escape may be left out, and is the mark itself then, e.g. one:a=pipe+double+backslash")
    c.add_argument("--key-mode", choices=("auto", "none"))
    c.add_argument("--key-min-overlap", type=float)
    c.add_argument("--key-max-columns", type=int)
    c.add_argument("--key-candidates", type=int)
    c.add_argument("--key-hints", type=lambda x: tuple(x.split(",")))
    c.add_argument("--reject-limit-percent", type=float)
    c.add_argument("--max-line-bytes", type=int)
    c.add_argument("--example-values", type=int)
    c.add_argument("--sample-rows", type=int)
    c.add_argument("--disk-factor", type=float)
    c.add_argument("--bare-values", action="store_true", help="no quote marks around values in sheets")
    c.set_defaults(run=compare)
    q = commands.add_parser("quotes", help="profile the quoting of delimited files")
    q.add_argument("paths", nargs="+")
    q.add_argument("-r", "--recursive", action="store_true")
    q.add_argument("--no-header", action="store_true")
    q.add_argument("--delimiter")
    q.add_argument("--quote")
    q.add_argument("--encoding")
    q.add_argument("--max-rows", type=int, default=0)
    q.add_argument("--report", metavar="FILE", help="one full report of all files")
    q.add_argument("--details", metavar="FOLDER", help="a full report for each file")
    q.set_defaults(run=quotes)
    return parser


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run(args)
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
