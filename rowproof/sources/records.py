"""Delimited files of any size to records, read in splits.

Spark's line reader cuts a file into splits and lines. The size of the splits is settled once, when a file is opened, and kept in a session of its own, so that
every later job sees the same splits with the same lines, whatever the cluster's size or settings by then. Whether a line begins inside a quoted field depends on all
lines before it, but each line only maps that state (outside, inside) to the next: it sets it, flips it or keeps it. Such maps compose:

* One aggregate when the file is opened tells, for each split, its lines, bytes, invalid lines and carriage returns.
* One narrow pass a dialect composes the maps of each split for both states that it can be entered in, with its records and the bytes of the longest, of the end of
  a record that came in and of the record that goes on (numbers only reach Python, not the lines). The driver then knows, a row a split, the state, the record and the line
  that each split begins with, and the longest record of the file: a record over a limit ends the reading there, before any of it was put together.
* One narrow pass makes the records. Only the pieces of records that cross splits, two a split at most, are shuffled; for them the file is read once more.

A line feed is the break of a line, or a carriage return where the opening has no line feed and no line has one. UTF-16 is cut at line feeds of two bytes. Lines that are not
UTF-8 are decoded one by one (encoding.py). Where lone carriage returns stand among line feeds, their records are written once and numbered by windows over splits. A UTF-16 file in which the
two bytes of a line feed also stand across two characters is read whole, as one value and one task; a record is one value in any case.

Equal at any split size: tests hold this reader against the reading of the whole text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from rowproof.functions import delimited
from rowproof.session import saved, ship
from rowproof.sources import encoding, files

#: Bytes of a file's opening that the driver reads: enough for the opening that formats are judged by, in any encoding.
HEAD_BYTES = 4 * (delimited.SNIFF_CHARS + 2)


@dataclass
class Opened:
    """A file whose encoding is known. `opening` is its first text, `whole` whether that is all of it."""

    path: str
    label: str
    opening: str = ""
    whole: bool = True
    codec: str | None = None
    policy: str = "bytes"
    n_bytes: int = 0
    tail: str = ""
    sep: str = "\n"
    fallback_bytes: int = 0
    fallback_lines: list[int] = field(default_factory=list)
    #: Lines (block, seq, value) of files read by lines, in file order within a task, and what is known of each split in file order; else the text (path, text).
    lines: DataFrame | None = None
    splits: list[Row] = field(default_factory=list)
    texts: DataFrame | None = None

    def opening_text(self, spark: SparkSession) -> DataFrame:
        """The opening as a table, for judging formats: a character more than is judged tells that the file goes on."""
        return spark.createDataFrame([(self.path, self.opening)], "path string, text string")


def raw_lines(spark: SparkSession, path: str, n_bytes: int, sep: str = "\n") -> DataFrame:
    """(block, seq, value): the lines of a file with the place of their split, and numbers that ascend within it; the splits are the same in every job."""
    conf = spark._jsparkSession.sessionState().conf()
    size = min(conf.filesMaxPartitionBytes(), max(conf.filesOpenCostInBytes(), n_bytes // spark.sparkContext.defaultParallelism))
    reader = spark.newSession()
    for key, value in (("maxPartitionBytes", size), ("openCostInBytes", size), ("minPartitionNum", 1)):  # a task a split
        reader.conf.set(f"spark.sql.files.{key}", value)
    lines = reader.read.option("lineSep", sep).text(path).select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")
    name = f"lines_{uuid.uuid4().hex}"
    lines.createGlobalTempView(name)  # the caller's session gets the scan, which keeps the reader's settings
    found = spark.table(f"global_temp.{name}")
    spark.catalog.dropGlobalTempView(name)
    return found


def _decoded_lines(lines: DataFrame, codec: str | None) -> DataFrame:
    """Lines decoded by Python: `fallback` counts the bytes read as Windows-1252, `bad` says what could not be decoded."""
    unit = 2 if codec and encoding.codecs.lookup(codec).name.startswith("utf-16") else 1

    def decoded(value: bytes) -> tuple[str, int, str | None]:
        if codec is None:
            return *encoding.mixed(value)[:2], None
        if len(value) % unit:
            return "", 0, CUT
        try:
            return value.decode(codec), 0, None
        except UnicodeDecodeError as e:
            return "", 0, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, fallback, bad = zip(*map(decoded, batch.column("value").to_pylist())) if batch.num_rows else ((), (), ())
            columns = [batch.column("block"), batch.column("seq"), pa.array(texts, pa.string()), pa.array(fallback, pa.int64()), pa.array(bad, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "seq", "value", "fallback", "bad"])

    raw = lines.select("block", "seq", F.col("value").cast("binary").alias("value"))
    return raw.mapInArrow(run, "block long, seq long, value string, fallback long, bad string")


#: A line break of two bytes that stands across two characters.
CUT = "cut within a character"


def _splits(lines: DataFrame, sep: str) -> list[Row]:
    """A row a split, in file order: its first seq, lines, and what they hold."""
    value, more = F.col("value"), "bad" in lines.columns
    has_cr = F.contains(value, F.lit("\r"))
    other = F.lit("\n" if sep == "\r" else "\r")
    return sorted(
        lines.groupBy("block").agg(
            F.min("seq").alias("first"), F.count("*").alias("n"), F.count_if(F.lit(False) if more else ~F.is_valid_utf8(value)).alias("invalid"),
            F.count_if(F.endswith(value, F.lit("\r"))).alias("ends_cr"), F.sum(F.when(has_cr, F.regexp_count(value, F.lit("\r"))).otherwise(0)).alias("crs"),
            F.count_if(F.contains(value, other)).alias("others"), F.count_if(has_cr & F.rlike(value, F.lit(r"\r(?!\z)"))).alias("lone"),
            F.sum("fallback" if more else F.lit(0)).alias("fallback"), F.max("bad" if more else F.lit(None).cast("string")).alias("bad"),
        ).collect(), key=lambda r: r.block,
    )


def _whole(spark: SparkSession, path: str, n_bytes: int, policy: str, codec: str | None, name: str | None) -> Opened:
    text = encoding.read_texts(spark, [path], policy, codec)
    row = text.select("encoding", "error", F.substring("text", 1, delimited.SNIFF_CHARS + 1).alias("opening"), F.length("text").alias("n")).first()
    if row.error:
        raise ValueError(row.error)
    return Opened(path, row.encoding, row.opening, row.n <= delimited.SNIFF_CHARS, name, policy, n_bytes, texts=saved(text.select("path", "text"), "text"))


def open_file(spark: SparkSession, path: str, policy: str = "bytes", codec: str | None = None) -> Opened:
    """Judge a file's encoding by its opening and, for UTF-8, the validity of all its lines; raises ValueError, LookupError."""
    ship(spark)
    head, n_bytes = files.head_of(spark, path, HEAD_BYTES)
    sort = (codec, codec, 0) if codec else encoding.sort_of(head, policy)
    if sort and not encoding.by_lines(sort[0]):
        return _whole(spark, path, n_bytes, policy, codec, sort[0])
    name, label, skip = sort or ("utf-8", "UTF-8", 0)
    name = encoding.codecs.lookup(name).name
    if name == "utf-16":  # the mark tells the order
        name, skip = ("utf-16-be" if head.startswith(encoding.codecs.BOM_UTF16_BE) else "utf-16-le"), 2
    unit = 2 if name.startswith("utf-16") else 1
    opened = Opened(path, label, codec=name, policy=policy, n_bytes=n_bytes, whole=len(head) == n_bytes)
    body = head[skip:]
    opened.opening = encoding.mixed(body)[0] if name == "utf-8" else body[: len(body) - len(body) % unit].decode(name, "replace")
    opened.tail = files.tail_of(spark, path, unit).decode(name, "replace") if n_bytes else ""
    opened.sep = "\r" if "\r" in opened.opening and "\n" not in opened.opening else "\n"
    while True:
        raw = raw_lines(spark, path, n_bytes, opened.sep if unit == 1 else opened.sep.encode(name).decode("latin-1"))
        opened.lines = raw if name == "utf-8" else _decoded_lines(raw, name)
        opened.splits = _splits(opened.lines, opened.sep)
        if name == "utf-8" and (invalid := sum(r.invalid for r in opened.splits)):
            if codec:
                raise ValueError(f"{invalid} lines are not valid {codec}")
            if policy == "file":
                name = opened.label = opened.codec = "cp1252"
                opened.opening = head.decode(name, "replace")
                continue
            opened.lines, opened.label = _decoded_lines(raw, None), encoding.MIXED
            opened.splits = _splits(opened.lines, opened.sep)
        if opened.sep == "\n" or not any(r.others for r in opened.splits):
            break
        opened.sep = "\n"
    bad = [r.bad for r in opened.splits if r.bad]
    if CUT in bad and n_bytes % unit == 0:
        return _whole(spark, path, n_bytes, policy, codec, name)
    if bad:
        raise ValueError(bad[0])
    if opened.label == encoding.MIXED:
        opened.fallback_bytes = sum(r.fallback for r in opened.splits)
        found = opened.lines.where("fallback > 0").select("block", "seq").orderBy("block", "seq").limit(encoding.MAX_LINES).collect()
        before = _before(opened.splits)
        opened.fallback_lines = [before[r.block] + r.seq + 1 for r in found]
    if opened.splits and skip:
        mark = (F.col("block") == opened.splits[0].block) & (F.col("seq") == opened.splits[0].first) & F.startswith("value", F.lit("\ufeff"))
        opened.lines = opened.lines.withColumn("value", F.when(mark, F.substring("value", 2, 1 << 30)).otherwise(F.col("value")))
    opened.lines = opened.lines.select("block", "seq", "value")
    if not opened.whole:  # the cut may have split a character; more than the judged characters are left
        opened.opening = opened.opening[: max(delimited.SNIFF_CHARS + 1, len(opened.opening) - 4)]
    return opened


def _before(splits: list[Row]) -> dict[int, int]:
    """For each split what its seq has to be raised by to number the lines of the file from 0."""
    out, n = {}, 0
    for r in splits:
        out[r.block] = n - r.first
        n += r.n
    return out


def _open_patterns(delim: str, quote: str) -> tuple[str, str]:
    """Whether a line ends inside a quoted field, if it begins outside one or inside one. A carriage return also ends a record."""
    d, (q, body) = re.escape(delim), delimited.quoted_body(quote)
    closed = f"(?:{q}{body}{q}[^{d}\\r]*+|(?!{q})[^{d}\\r]*+)"
    rest = f"(?:{closed}[{d}\\r])*+{q}{body}\\z"
    return rf"\A{rest}", rf"\A{body}(?:\z|{q}[^{d}\r]*+[{d}\r]{rest})"


def _mapped(lines: DataFrame, delim: str, quote: str) -> DataFrame:
    """lines with what they make of the state: `o` if a line that begins outside a field ends inside one, `i` if one that begins inside does."""
    marked = F.contains("value", F.lit(quote[0]))
    outside, inside = (F.rlike("value", F.lit(p)) for p in _open_patterns(delim, quote))
    return lines.withColumns({"o": marked & outside, "i": ~marked | inside})


def states(o: np.ndarray, i: np.ndarray, entry: bool) -> np.ndarray:
    """The state after each line, from that before the first."""
    flips = np.cumsum(o & ~i) & 1
    at = np.maximum.accumulate(np.where(o == i, np.arange(len(o)), -1))  # the last line that sets the state
    held = np.where(at >= 0, o[at] ^ (flips[at] == 1), entry)
    return held ^ (flips == 1)


class _Walk:
    """What one split makes of the state that it is entered in: records begun, bytes of the longest that ends in it, of what it ends of another, and of what it leaves open."""

    def __init__(self, entry: bool) -> None:
        self.state, self.starts, self.longest, self.open, self.lead, self.foreign = entry, 0, 0, 0, None, entry
        self.lines, self.begun, self.where = 0, 0, 0  # lines so far, the line that began the last record, and the longest one

    def add(self, o: np.ndarray, i: np.ndarray, sizes: np.ndarray, cut: np.ndarray) -> None:
        after = states(o, i, self.state)
        before = np.concatenate([[self.state], after[:-1]])
        begins = np.flatnonzero(~before)
        self.starts += len(begins)
        ends, upto = np.flatnonzero(~after), np.cumsum(sizes)
        if len(ends):
            lengths = np.diff(np.concatenate([[-self.open], upto[ends]])) - cut[ends]
            if self.foreign:
                self.lead, self.foreign, lengths, ends = int(lengths[0]), False, lengths[1:], ends[1:]
            if len(lengths) and lengths.max() > self.longest:
                k = int(lengths.argmax())
                own = int(np.searchsorted(begins, ends[k], side="right"))
                self.longest, self.where = int(lengths[k]), self.lines + int(begins[own - 1]) if own else self.begun
            ends = np.flatnonzero(~after)
            self.open = int(upto[-1] - upto[ends[-1]])
        else:
            self.open += int(upto[-1])
        if len(begins):
            self.begun = self.lines + int(begins[-1])
        self.state, self.lines = bool(after[-1]), self.lines + len(after)


WALK = "block long, entry int, exit int, starts long, lead long, longest long, open long, begun long, place long"


def _walked(lines: DataFrame, delim: str, quote: str) -> dict[tuple[int, int], Row]:
    """For each split and state that it can be entered in, a _Walk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(block: int, walks: list[_Walk]) -> pa.RecordBatch:
            rows = [(block, e, int(w.state), w.starts, w.lead, w.longest, w.open, w.begun, w.where) for e, w in enumerate(walks)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k in (1, 2) else pa.int64()) for k, c in enumerate(zip(*rows))], names=[c.split()[0] for c in WALK.split(", ")])

        block, walks = None, []
        for batch in batches:
            blocks, size, cut, o, i = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            for at in _runs(blocks):
                if blocks[at.start] != block:
                    if walks:
                        yield done(block, walks)
                    block, walks = int(blocks[at.start]), [_Walk(False), _Walk(True)]
                for w in walks:
                    w.add(o[at].astype(bool), i[at].astype(bool), size[at].astype(np.int64) + 1, cut[at].astype(np.int64) + 1)
        if walks:
            yield done(block, walks)

    told = _mapped(lines, delim, quote).select("block", F.octet_length("value"), F.endswith("value", F.lit("\r")).cast("int"), "o", "i")
    return {(r.block, r.entry): r for r in told.mapInArrow(run, WALK).collect()}  # two rows a split


def _runs(blocks: np.ndarray) -> list[slice]:
    """The stretches of one block."""
    if not len(blocks):
        return []
    at = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
    return [slice(a, b) for a, b in zip(at, at[1:])]


@dataclass
class _Places:
    """For each split the state that it is entered in, and the records and lines before it; whether the file ends inside a field, and its longest record."""

    entry: dict[int, tuple[int, int, int]]
    open_end: bool
    longest: int
    line: int
    plain: bool
    records: int


def _placed(opened: Opened, walks: dict[tuple[int, int], Row]) -> _Places:
    state = records = line = held = longest = longest_line = 0
    since, entry, plain = 1, {}, True
    for split in opened.splits:
        w = walks[split.block, state]
        entry[split.block] = (state, records, line)
        plain = plain and not state and not w.exit and w.starts == split.n
        through = state and w.lead is None  # the split is all inside one field
        ended = [(held + w.lead, since)] if state and not through else []
        held = held + w.open if through else w.open if w.exit else 0
        if not through and w.exit:
            since = line + w.begun + 1
        for size, at in [*ended, (w.longest if not through else 0, line + w.place + 1)]:
            if size > longest:
                longest, longest_line = size, at
        records, line, state = records + w.starts, line + split.n, w.exit
    if state and held - 1 > longest:
        longest, longest_line = held - 1, since
    return _Places(entry, bool(state), longest, longest_line, plain, records)


def _pieces(lines: DataFrame, delim: str, quote: str, places: _Places, sep: str) -> DataFrame:
    """(block, record_no, line, text, part): whole records without their break, and, with a `part`, what a split holds of a record that crosses its ends."""
    entries = places.entry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "record_no", "line", "text", "part"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32()]
        block, held, state, record, line, foreign, begun = None, [], False, 0, 0, False, 0

        def part() -> list[tuple]:
            return [(block, record, begun, sep.join(held), 1)] if held else []

        for batch in batches:
            blocks, values = batch.column("block").to_numpy(), batch.column("value")
            o, i = (batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("o", "i"))
            for at in _runs(blocks):
                made: list[tuple] = []
                if blocks[at.start] != block:
                    made += part()
                    block, held = int(blocks[at.start]), []
                    state, record, line = entries[block]
                    foreign, begun = bool(state), line + 1
                after = states(o[at], i[at], bool(state))
                before = np.concatenate([[bool(state)], after[:-1]])
                numbers = record + np.cumsum(~before)
                alone = np.flatnonzero(~before & ~after)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(alone), block), pa.int64()), pa.array(numbers[alone], pa.int64()), pa.array(line + 1 + alone, pa.int64()), values.take(pa.array(alone + at.start)), pa.nulls(len(alone), pa.int32())], names=names
                )
                for k in np.flatnonzero(before | after):
                    if not before[k]:
                        held, begun = [], line + 1 + int(k)
                    held.append(values[at.start + int(k)].as_py())
                    if not after[k]:
                        made.append((block, int(numbers[k]), begun, sep.join(held), 1 if foreign else None))
                        held, foreign = [], False
                state, record, line = bool(after[-1]), int(numbers[-1]), line + len(after)
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*made), kinds)], names=names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*part()), kinds)], names=names)

    return _mapped(lines, delim, quote).mapInArrow(run, "block long, record_no long, line long, text string, part int")


def _chunks(opened: Opened, delim: str, quote: str, limit: int | None) -> DataFrame:
    """(block, record_no, line, text): the lines, where those that a quoted field spans are one text, at its first line."""
    places = _placed(opened, _walked(opened.lines, delim, quote))
    if limit is not None and places.longest > limit and not any(r.lone for r in opened.splits):
        raise ValueError(f"a line of {places.longest} bytes is over the limit of {limit}; it begins on line {places.line}")
    text = F.concat("text", F.lit(opened.sep)).alias("text")
    if places.plain:
        at = F.col("seq") + F.col("before") + 1
        rows = opened.lines.sparkSession.createDataFrame(list(_before(opened.splits).items()) or [(0, 0)], "block long, before long")
        return opened.lines.withColumnRenamed("value", "text").join(F.broadcast(rows), "block").select("block", at.alias("record_no"), at.alias("line"), text)
    pieces = _pieces(opened.lines, delim, quote, places, opened.sep)
    whole = pieces.where("part is null").select("block", "record_no", "line", text)
    if not places.open_end and not any(state for state, *_ in places.entry.values()):
        return whole
    crossed = pieces.where("part is not null").groupBy("record_no").agg(F.array_sort(F.collect_list(F.struct("block", "line", "text"))).alias("x"))
    first = F.element_at("x", 1)
    end = F.when(F.lit(places.open_end) & (F.col("record_no") == places.records), "").otherwise(opened.sep)
    joined = F.concat(F.array_join(F.transform("x", lambda x: x["text"]), opened.sep), end)
    return whole.unionByName(crossed.select(first["block"].alias("block"), "record_no", first["line"].alias("line"), joined.alias("text")))


def records(opened: Opened, delim: str, quote: str, limit: int | None = None) -> DataFrame:
    """One row per record: path, record_no and line (both from 1, in file order), raw and end. A record of more than `limit` bytes is a ValueError."""
    cut = lambda text: delimited.record_array(text, delim, quote)
    path = F.lit(opened.path).alias("path")
    if opened.lines is None:
        rows = opened.texts.select(F.posexplode(cut(F.coalesce("text", F.lit("")))).alias("k", "x")).select(F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("seq"), "k", "x.raw", "x.end")
    else:
        chunks = _chunks(opened, delim, quote, limit)
        if opened.sep == "\r" or not any(r.lone for r in opened.splits):
            # Each text is a record: its break is all there is to cut off.
            broken = r"\r?\n\z" if opened.sep == "\n" else r"\r\z"
            return chunks.select(path, "record_no", "line", F.regexp_replace("text", broken, "").alias("raw"), F.regexp_extract("text", broken, 0).alias("end"))
        rows = chunks.select("block", F.col("record_no").alias("seq"), F.posexplode(cut(F.col("text"))).alias("k", "x")).select("block", "seq", "k", "x.raw", "x.end")
    # Records of several lines and lines of several records: numbered by counts within splits and over them.
    rows = rows.where("raw <> '' or end <> ''")  # the search finds one more, empty, at the very end
    held = saved(rows.withColumn("_lines", F.regexp_count("raw", F.lit(r"\r\n|\r|\n")) + 1), "records")
    per = held.groupBy("block").agg(F.count("*").alias("n"), F.sum("_lines").alias("m"))
    by = Window.orderBy("block")  # one row for each split
    per = per.select("block", (F.sum("n").over(by) - F.col("n")).alias("_n"), (F.sum("m").over(by) - F.col("m")).alias("_m"))
    order = Window.partitionBy("block").orderBy("seq", "k")
    number, lines = F.row_number().over(order).cast("long"), F.sum("_lines").over(order) - F.col("_lines") + 1
    return held.select("*", number.alias("_k"), lines.alias("_l")).join(F.broadcast(per), "block").select(path, (F.col("_n") + F.col("_k")).alias("record_no"), (F.col("_m") + F.col("_l")).alias("line"), "raw", "end")


def first_record(opened: Opened, spark: SparkSession, delim: str, quote: str) -> list[str] | None:
    """The cells of the first record that is no lone blank line, from the file's opening."""
    found = delimited.record_array(F.col("text"), delim, quote)
    row = opened.opening_text(spark).select(F.get(F.filter(found, lambda x: x["raw"] != ""), F.lit(0)).alias("x")).select("x.*").where("raw is not null")
    cells = delimited.raw_fields(row, delim, quote).select(F.transform("fields", lambda x: delimited.field_facts(x, delim, quote)["value"]).alias("cells"), "end").first()
    if cells and not cells.end and not opened.whole:
        raise ValueError(f"the first record is longer than {HEAD_BYTES} bytes")
    return list(cells.cells) if cells else None



def with_header(rows: DataFrame, delim: str, quote: str) -> DataFrame:
    """records with the number and the width of the header, the first record that is no lone blank line."""
    first = rows.where("raw <> ''").select("record_no", "raw").orderBy("record_no").limit(1)
    found = delimited.raw_fields(first, delim, quote).select("record_no", F.size("fields").alias("width")).first()
    at, width = (found.record_no, found.width) if found else (None, None)
    return rows.withColumns({"header_record": F.lit(at).cast("long"), "header_width": F.lit(width).cast("int")})


def newlines(opened: Opened) -> DataFrame:
    """One row: path and the line breaks of the file by kind, with their label."""
    if opened.lines is None:
        return delimited.newline_counts(opened.texts, "path")
    n, ends_cr, crs = (sum(r[k] for r in opened.splits) for k in ("n", "ends_cr", "crs"))
    broken = n if opened.tail == opened.sep else max(n - 1, 0)  # the last line of a file may lack its break
    if opened.sep == "\r":
        crlf, lf, cr = 0, 0, broken
    else:
        crlf = ends_cr - (broken < n and opened.tail == "\r")
        lf, cr = broken - crlf, crs - crlf
    counts = opened.lines.sparkSession.createDataFrame([(opened.path, crlf, lf, cr)], "path string, crlf long, lf long, cr long")
    return counts.withColumn("label", delimited.newline_label(F.col("crlf"), F.col("lf"), F.col("cr")))
