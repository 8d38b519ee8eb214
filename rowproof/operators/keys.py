"""Choosing a record key: by hand, by settings, or by overlap and uniqueness.

Candidates are rows of one table: the columns, with their counts from the column statistics, and sets of columns, whose
rough counts are taken for all sets in one pass over each side before any is counted exactly. The table is ordered by preference; the first
candidate that identifies every distinct row on both sides is the key.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, combinations, islice

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

MIN_OVERLAP, MAX_COLUMNS, CANDIDATES, MAX_TRIES, SCREEN = 0.80, 3, 5, 20, 0.9
# Header words that hint at a key.
HINTS = ("ID", "KEY", "NO", "NUM", "CODE")


@dataclass
class Key:
    """The chosen columns (positions from 1), how they were found, and why not if none were."""

    source: str
    positions: list[int] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    reason: str = ""
    invalid: bool = False
    overlap: float | None = None
    distinct: tuple[int, int] | None = None

    @property
    def manual(self) -> bool:
        return self.source == "manual"


def folded(name: str) -> str:
    return name.strip().casefold()


def header_words(header: str) -> frozenset[str]:
    return frozenset(filter(None, re.split(r"[^A-Z0-9]+", header.upper())))


def hinted(header: str, hints: tuple[str, ...] = HINTS) -> bool:
    return bool(header_words(header) & {h.upper() for h in hints})


class Headers:
    """Where the names of a table stand: as they are written, and as they are shown where several are alike."""

    def __init__(self, written: list[str], shown: list[str]) -> None:
        self.places: dict[str, set[int]] = defaultdict(set)
        for names in (written, shown):
            for at, name in enumerate(names, 1):
                self.places[folded(name)].add(at)

    def place(self, name: str) -> int:
        """The one column of that name; raises LookupError."""
        found = self.places.get(folded(name), set())
        if len(found) == 1:
            return next(iter(found))
        where = "in columns " + ", ".join(map(str, sorted(found))) if found else "in no column"
        raise LookupError(f"key column {name!r} is found {where}")


def tuple_stats(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """One row for a set of key columns: distinct tuples on each side and common ones, in one shuffle."""
    flags = lambda df, x: df.select(*columns, F.lit(x).alias("in_a"), F.lit(not x).alias("in_b"))
    seen = flags(a, True).unionByName(flags(b, False)).groupBy(*columns).agg(F.bool_or("in_a").alias("in_a"), F.bool_or("in_b").alias("in_b"))
    out = seen.agg(F.count_if("in_a").alias("a_distinct"), F.count_if("in_b").alias("b_distinct"), F.count_if(F.col("in_a") & F.col("in_b")).alias("common"))
    return out.withColumn("overlap", F.col("common") / F.greatest("a_distinct", "b_distinct", F.lit(1)))


def set_stats(a: DataFrame, b: DataFrame, sets: list[list[str]]) -> DataFrame:
    """tuple_stats of several sets in one job and one shuffle: one row for each, with its number in `sets`; each row stands once for every set."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("number"), F.array(*s).alias("cells")) for i, s in enumerate(sets)]))
    flags = lambda df, x: df.select(each.alias("x"), F.lit(x).alias("in_a"), F.lit(not x).alias("in_b"))
    seen = flags(a, True).unionByName(flags(b, False)).groupBy("x.number", "x.cells").agg(F.bool_or("in_a").alias("in_a"), F.bool_or("in_b").alias("in_b"))
    out = seen.groupBy("number").agg(F.count_if("in_a").alias("a_distinct"), F.count_if("in_b").alias("b_distinct"), F.count_if(F.col("in_a") & F.col("in_b")).alias("common"))
    return out.withColumn("overlap", F.col("common") / F.greatest("a_distinct", "b_distinct", F.lit(1)))


def screened(a: DataFrame, b: DataFrame, sets: list[list[str]], distinct: tuple[int, int] | None = None) -> DataFrame:
    """One row per column set: columns, and whether it has nearly as many tuples as distinct rows on both sides.

    All sets are sketched in one aggregate over each side; without `distinct`, the distinct rows are sketched too.
    """
    names = [",".join(s) for s in sets]

    def judged(side: DataFrame, rows: int | None) -> DataFrame:
        whole = F.approx_count_distinct("h", 0.02) if rows is None else F.lit(rows)
        return side.agg(*[(F.approx_count_distinct(F.struct(*s), 0.02) >= SCREEN * whole).alias(f"p{i}") for i, s in enumerate(sets)])

    both = judged(a, distinct and distinct[0]).unionByName(judged(b, distinct and distinct[1]))
    one = both.agg(*[F.bool_and(f"p{i}").alias(f"p{i}") for i in range(len(sets))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("columns"), F.col(f"p{i}").alias("likely")) for i, n in enumerate(names)])).alias("x")).select("x.*")


@dataclass
class Finder:
    """The search for a key among the columns of two tables. `stats` has one row per column."""

    a: DataFrame
    b: DataFrame
    stats: list[Row]
    headers: list[str]
    distinct: tuple[int, int]
    min_overlap: float = MIN_OVERLAP
    max_columns: int = MAX_COLUMNS
    candidates: int = CANDIDATES
    hints: tuple[str, ...] = HINTS

    def key(self, positions: tuple[int, ...], stats: Row, source: str = "detected") -> Key:
        return Key(source, list(positions), [self.headers[p - 1] for p in positions], overlap=stats.overlap, distinct=(stats.a_distinct, stats.b_distinct))

    def identifies(self, stats: Row) -> bool:
        return (stats.a_distinct, stats.b_distinct) == tuple(self.distinct) and stats.overlap >= self.min_overlap

    def exact(self, positions: tuple[int, ...]) -> Row:
        return tuple_stats(self.a, self.b, [f"c{p}" for p in positions]).first()

    def single(self) -> Iterator[tuple[tuple[int, ...], Row]]:
        """Columns by preference: a hinting header, more overlap, further left."""
        order = {s.pos: (not hinted(self.headers[s.pos - 1], self.hints), -s.overlap, s.pos) for s in self.stats}
        yield from (((s.pos,), s) for s in sorted(self.stats, key=lambda s: order[s.pos]))

    def combined(self) -> Iterator[tuple[tuple[int, ...], Row]]:
        """Sets of the columns with most values, small sets first, that a sketch does not rule out, counted in one job."""
        usable = [s for s in self.stats if s.overlap >= self.min_overlap]
        richest = [s.pos for s in sorted(usable, key=lambda s: (-max(s.a_distinct, s.b_distinct), s.pos))[: self.candidates]]
        sets = list(islice(chain.from_iterable(combinations(richest, size) for size in range(2, self.max_columns + 1)), MAX_TRIES))
        if sets:
            rough = {r.columns: r.likely for r in screened(self.a, self.b, [[f"c{p}" for p in s] for s in sets], self.distinct).collect()}
            likely = [s for s in sets if rough[",".join(f"c{p}" for p in s)]]
            counted = {r.number: r for r in set_stats(self.a, self.b, [[f"c{p}" for p in s] for s in likely]).collect()} if likely else {}
            yield from ((s, counted[i]) for i, s in enumerate(likely) if i in counted)

    def detect(self) -> Key:
        for positions, stats in chain(self.single(), self.combined()):
            if self.identifies(stats):
                return self.key(positions, stats)
        shared = any(s.overlap >= self.min_overlap for s in self.stats)
        return Key("none", reason="No column or set of columns tells all rows apart" if shared else f"No column has {self.min_overlap:.0%} of its values on both sides")


def select(a: DataFrame, b: DataFrame, prefix: str, stats: list[Row], headers: list[str], distinct: tuple[int, int], mode: str = "auto", overrides: dict[str, list[str] | None] | None = None, written: list[str] | None = None, **limits) -> Key:
    """An override for the pair comes first (None: no key), then mode "none", then detection.

    Names given by hand are matched against the headers as written, and as shown where alike ones were numbered."""
    finder = Finder(a, b, stats, headers, distinct, **limits)
    given = {folded(name): wanted for name, wanted in (overrides or {}).items()}
    if folded(prefix) not in given:
        return finder.detect() if mode != "none" else Key("none", reason="Keys are switched off")
    wanted = given[folded(prefix)]
    if wanted is None:
        return Key("none", reason="The settings name no key for this pair")
    places = Headers(written or headers, headers)
    try:
        positions = tuple(places.place(name) for name in wanted)
    except LookupError as e:
        return Key("manual", reason=str(e.args[0]), invalid=True)
    return finder.key(positions, finder.exact(positions), "manual")
