"""Periodic runs of words, over tiles by period octave.

A run is a stretch of words with smallest period q that is LEAST words and TIMES periods long at least and that no neighbour extends. In terms of
matches (places i whose word equals that q words on) it is a maximal interval of max(LEAST, TIMES * q) - q matches or more.

* Explode: for each octave of periods [low, high) (the first holds all under 16) a document has a boundary every `high` words, and every interval of such a
  period holds one. The tile of a boundary reaches 2 * high words to its left and right (and `high` more, where the second copy of a match stands), so that
  neighbouring tiles overlap. Of the matches next to a boundary a half, high / 2, are on one side, so that block hashes of that length, doubled
  from octave to octave, tell the tiles without any such pair; only the others are made rows, with their words as numbers.
* Solve: each tile alone gives, by Z-functions from its boundary to the right and to the left, the interval around the boundary for every period of the
  octave, cut at the tile's ends. Hashes only screen: what a tile finds is compared word by word, in time linear in the tile.
* Stitch: intervals, joined within a batch first, are shuffled by document and period; those that overlap or touch become one. Of the runs with
  the same place only that of the smallest period stays: others are its multiples.

Texts without tiles are done in the first pass. Those with tiles (some tenth of a corpus with planted runs) are written with them, and meet their runs in one
join by a key given in that pass; the texts of all documents are never shuffled. Work is n log n for any text, also one of one word a million times.

Words are what stands between the characters 9 to 13 and 32. Defined cases: a null text has no words; a null id is never rewritten; repeated rows and ids are
documents of their own; an empty table gives no rows; texts are read whole, some 60 bytes of memory a word, one Arrow batch at a time; extra columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowproof.llm.common import small_batches
from rowproof.session import scratch_path

#: The shortest run in words, and in periods. The octaves rest on these values.
LEAST, TIMES = 24, 3
FIRST = 16
#: Compared hashes at once.
CELLS = 1 << 20
ROWS = "kind string, key long, doc_id {id}, n_words long, text binary, digest string, start long, low int, high int, before int, window binary"
Rewrite = Callable[[object, list[bytes]], list[bytes]]


def least_matches(q: int) -> int:
    return max(LEAST, TIMES * q) - q


def planted(doc_id: object, words: list[bytes]) -> list[bytes]:
    """One document in ten, by the CRC of its id, repeats the words that follow a place which the CRC also chooses."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _numbers(words: list[bytes]) -> np.ndarray:
    return pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int32)


def tiles(ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(document, boundary, low, high) of the tiles that can hold a run, of documents that begin at `starts` in ids (with the end of the last)."""
    sizes = np.diff(starts)
    if not len(ids) or sizes.max() < LEAST:
        return
    hashes, length, low, high = _mixed(ids.astype(np.uint64) + np.uint64(1)), 1, 1, FIRST
    while True:
        docs = np.flatnonzero(sizes >= max(LEAST, TIMES * low))
        if not len(docs):
            return
        block = high // 2
        while length < block:  # hashes of twice as many words
            ahead = np.concatenate([hashes[length:], np.zeros(min(length, len(hashes)), np.uint64)])
            hashes, length = _mixed(hashes * np.uint64(3) + ahead), 2 * length
        padded = np.concatenate([np.zeros(block, np.uint64), hashes, np.zeros(2 * high, np.uint64)])
        shifted = np.lib.stride_tricks.sliding_window_view(padded, high - low)
        per = (sizes[docs] + high - 1) // high
        of = np.repeat(docs, per)
        at = (np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)) * high
        step = max(1, CELLS // (high - low))
        for k in range(0, len(of), step):
            b = starts[of[k : k + step]] + at[k : k + step] + block  # in padded
            right = (padded[b][:, None] == shifted[b + low]).any(1)
            left = (padded[b - block][:, None] == shifted[b - block + low]).any(1) & (at[k : k + step] > 0)
            for i in np.flatnonzero(right | left):
                yield int(of[k + i]), int(at[k + i]), low, high
        low, high = high, 2 * high


def _z(u: list[int], upto: int, cap: int) -> list[int]:
    """The Z-function of u up to place `upto`: how many elements from a place on equal those from the start, `cap` at most."""
    n = len(u)
    z, left, right = [0] * upto, 0, 0
    for i in range(1, min(upto, n)):
        k = min(right - i, z[i - left]) if i < right else 0
        while k < cap and i + k < n and u[k] == u[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def _met(p: list[int], t: list[int], upto: int) -> list[int]:
    """How many elements of t from each place up to `upto` equal those of p from its start."""
    z, out, left, right = _z(p, min(upto, len(p)) + 1, len(p)), [0] * upto, 0, 0
    for i in range(min(upto, len(t))):
        k = min(right - i, z[i - left]) if i < right and i > left and i - left < len(z) else 0
        while k < len(p) and i + k < len(t) and p[k] == t[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        out[i] = k
    return out


def solved(words: list[int], before: int, low: int, high: int) -> list[tuple[int, int, int]]:
    """(period, start, end) of the intervals of matches next to the boundary of a tile, which has `before` words to the left; places count from the boundary."""
    reach = 2 * high
    right, left = words[before:], words[:before][::-1]
    last = min(high, len(right) + 1)  # periods under it have their second copy in the text
    if last <= low:
        return []
    ahead = _z(right, last, reach)
    behind = _met(left, words[: before + last - 1][::-1], last - low)  # place t has the words that end where period last - 1 - t begins
    found = []
    for q in range(low, last):
        fore, back = ahead[q], min(behind[last - 1 - q], reach)
        if fore + back >= least_matches(q):
            found.append((q, -back, fore))
    return found


def _joined(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Intervals (key, period, start, end) with those that overlap or touch put together."""
    out: list[tuple[int, int, int, int]] = []
    for key, q, start, end in sorted(found):
        if out and out[-1][:2] == (key, q) and start <= out[-1][3]:
            out[-1] = (key, q, out[-1][2], max(end, out[-1][3]))
        else:
            out.append((key, q, start, end))
    return out


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def exploded(docs: DataFrame, rewrite: Rewrite | None = None, texts: bool = False) -> DataFrame:
    """Rows of kind 'doc' for all documents (the text, words joined by a space, only where there are tiles or `texts` is set, else its digest) and of kind 'tile'."""
    ddl = ROWS.format(id=dict(docs.dtypes)["doc_id"])
    names = [c.split()[0] for c in ddl.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}

    def batch_of(kind: str, n: int, ids: pa.Array, **columns: pa.Array) -> pa.RecordBatch:
        columns |= {"kind": pa.array([kind] * n, pa.string()), "doc_id": ids}
        types = dict(c.split() for c in ddl.split(", ") if not c.startswith("doc_id"))
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, kinds[types[c]]) for c in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column(0)
            found = [(t or b"").split() for t in batch.column(1).to_pylist()]
            if rewrite:
                found = [rewrite(i, w) for i, w in zip(ids.to_pylist(), found)]
            starts = np.concatenate([[0], np.cumsum([len(w) for w in found])]).astype(np.int64)
            numbers = _numbers([w for words in found for w in words])
            made, hit = [], set()
            for d, b, low, high in tiles(numbers, starts):
                s, e = max(0, b - 2 * high), min(len(found[d]), b + 3 * high)
                made.append((key + d, s, low, high, b - s, numbers[starts[d] + s : starts[d] + e].tobytes()))
                hit.add(d)
            joined = [b" ".join(w) for w in found]
            n = batch.num_rows
            yield batch_of(
                "doc", n, ids, key=pa.array(range(key, key + n), pa.int64()), n_words=pa.array(np.diff(starts), pa.int64()),
                text=pa.array([t if texts or d in hit else None for d, t in enumerate(joined)], pa.binary()), digest=pa.array([None if d in hit else _sha(t) for d, t in enumerate(joined)], pa.string()),
            )
            key += n
            size = 0
            for first in range(0, len(made), 4096):
                some = made[first : first + 4096]
                keys, begin, lows, highs, befores, windows = zip(*some)
                size += len(some)
                yield batch_of(
                    "tile", len(some), pa.nulls(len(some), ids.type), key=pa.array(keys, pa.int64()), start=pa.array(begin, pa.int64()), low=pa.array(lows, pa.int32()), high=pa.array(highs, pa.int32()),
                    before=pa.array(befores, pa.int32()), window=pa.array(windows, pa.binary()),
                )

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, ddl)


def intervals(tile_rows: DataFrame) -> DataFrame:
    """(key, period, start, end): what each tile finds, joined within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for key, start, low, high, before, window in zip(*[batch.column(i).to_pylist() for i in range(6)]):
                at = start + before
                found += [(key, q, at + s, at + e) for q, s, e in solved(np.frombuffer(window, np.int32).tolist(), before, low, high)]
            columns = zip(*_joined(found)) if found else ([],) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "period", "start", "end"])

    return tile_rows.select("key", "start", "low", "high", "before", "window").mapInArrow(run, "key long, period long, start long, end long")


def stitched(found: DataFrame) -> DataFrame:
    """(key, start, length, period) of the runs, from intervals of matches of any tiles."""
    order = Window.partitionBy("key", "period").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("_new", F.when(reached.isNull() | (F.col("start") > reached), 1).otherwise(0))
    islands = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = islands.groupBy("key", "period", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    length = F.col("end") - F.col("start") + F.col("period")
    return whole.select("key", "start", length.alias("length"), "period").groupBy("key", "start", "length").agg(F.min("period").alias("period"))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that stay: all but those of runs (start, length, period) after their first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, over in zip(words, np.cumsum(change)) if not over]


def _with_runs(docs: DataFrame, rewrite: Rewrite | None, texts: bool) -> DataFrame:
    """(doc_id, n_words, text, digest, runs) of all documents; runs are null where a document has no tiles."""
    spark = docs.sparkSession
    small_batches(spark)
    made, path = exploded(docs, rewrite, texts), scratch_path(spark, "tiles")
    made.write.partitionBy("kind").parquet(path)
    rows = spark.read.schema(made.schema).parquet(path)
    runs = stitched(intervals(rows.where("kind = 'tile'"))).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    held = rows.where("kind = 'doc'").select("key", "doc_id", "n_words", "text", "digest")
    none = F.lit(None).cast("array<struct<start:bigint,length:bigint,period:bigint>>")
    met = held.where("digest is null").join(runs, "key", "left").withColumn("runs", F.coalesce("runs", F.array().cast(runs.schema["runs"].dataType)))
    return held.where("digest is not null").withColumn("runs", none).unionByName(met).drop("key")


def documents(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, n_words, text (the words that stay, joined by a space) and runs (start, length, period) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
                found = [(r["start"], r["length"], r["period"]) for r in runs or []]
                texts.append((b" ".join(collapsed(text.split(), found)) if found else text).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(texts, pa.string()), batch.column("runs")], names=["doc_id", "n_words", "text", "runs"])

    rows = _with_runs(docs, rewrite, texts=True).select("doc_id", "n_words", "text", F.coalesce("runs", F.array().cast("array<struct<start:bigint,length:bigint,period:bigint>>")).alias("runs"))
    return rows.mapInArrow(run, rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace("text:binary", "text:string"))


def digests(docs: DataFrame, rewrite: Rewrite | None = planted) -> DataFrame:
    """One row per document: doc_id, n_runs, the run of the greatest exponent, and digests of all runs and of the collapsed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
                found = [(r["start"], r["length"], r["period"]) for r in runs]
                best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
                milli = 1000 * best[1] // best[2] if found else None
                out.append((len(found), *best, milli, _sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), _sha(b" ".join(collapsed(text.split(), found)))))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            columns = zip(*out) if out else ([],) * 7
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["doc_id", *RESULT])

    rows = _with_runs(docs, rewrite, texts=False)
    ddl = f"doc_id {dict(rows.dtypes)['doc_id']}, " + ", ".join(f"{c} {'string' if 'sha' in c else 'long'}" for c in RESULT)
    fixed: dict[str, Column] = {"n_runs": F.lit(0).cast("long"), "runs_sha256": F.lit(_sha(b"")), "collapsed_sha256": F.col("digest")}
    done = rows.where("runs is null").select("doc_id", *[fixed.get(c, F.lit(None).cast("long")).alias(c) for c in RESULT])
    return done.unionByName(rows.where("runs is not null").select("doc_id", "text", "runs").mapInArrow(run, ddl))


RESULT = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
