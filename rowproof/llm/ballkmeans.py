"""Vector code compression by ball k-means: eight bytes of four bits each stand for a vector's parts.

Components become integers, vectors are cut into PARTS equal parts, and each part position has a codebook of ENTRIES entries, fitted by
Lloyd rounds on all vectors in integer arithmetic. An entry with the parts assigned to it is a ball:

* Its radius is known from the last assignment, and grows by what its entry moved at most. An entry farther from the ball's than twice its
  radius can be nearest to none of its parts; the others are its neighbours.
* Within the ball, a part whose distance to its own entry is under half of that to the nearest neighbour is in the stable core: it stays, and
  nothing else is computed.
* Neighbours by distance from the entry cut the rest into rings: a part in the k-th ring is held against the k nearest neighbours only.

Bounds are compared as exact integers (four times the squared distance against that between entries) and include equality, so that ties
go to the lower index as in a full search: the codes are those of plain Lloyd rounds.

Each round is one pass over a written table of integer vectors and codes: tasks write the table with new codes together with one row of counts,
sums and radius for each entry; Spark adds these up, and only the codebooks (ENTRIES times the vector length) come to the driver. The table before the last
is deleted. A lost executor costs tasks of one pass. Nothing else is shuffled but the label sums.

Defined cases: vectors that are null or hold null or non-finite components are dropped; the vector length is that of the smallest kept id, a length that PARTS
does not divide is filled with zeros, and vectors of another length stay with null code and error; repeated rows are vectors of their own, also among the first entries; a null id
sorts last; with fewer vectors than entries the codebooks are shorter; null labels are one label; an empty table gives no rows; extra columns
are left out, whatever their names. Components of BOUND / sqrt(length) / SCALE or more raise ValueError, as their squares pass 64 bits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from rowproof.llm.common import unused
from rowproof.llm.components import looked_up
from rowproof.session import removed, saved, scratch_path, ship

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Largest norm of integer vectors: the squared distance of two of them fits 62 bits.
BOUND = 1 << 30
#: Rows and bytes that are assigned at once.
BLOCK_ROWS, BLOCK_BYTES = 8192, 32 << 20


@dataclass(frozen=True)
class Balls:
    """Codebooks (part, entry, component) and, but for the first round, bounds on the radii of the balls (part, entry)."""

    books: np.ndarray
    radii: np.ndarray | None = None


def neighbours(books: np.ndarray, radii: np.ndarray) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For each part and entry: the entries that can be nearest to a part of its ball, by distance, and those squared distances."""
    found = []
    for book, radius in zip(books, radii):
        between = ((book[:, None, :] - book[None, :, :]) ** 2).sum(2)
        rows = []
        for i, gaps in enumerate(between):
            order = np.argsort(gaps, kind="stable")
            order = order[(order != i) & (gaps[order] <= 4 * int(radius[i]) ** 2)]
            rows.append((order, gaps[order]))
        found.append(rows)
    return found


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part, by a full search, and its squared distance; ties go to the lower index."""
    best, at = ((x - book[0]) ** 2).sum(1), np.zeros(len(x), np.int64)
    for j in range(1, len(book)):
        d = ((x - book[j]) ** 2).sum(1)
        closer = d < best
        best[closer], at[closer] = d[closer], j
    return at, best


def moved(x: np.ndarray, home: np.ndarray, book: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """As nearest(), from the entry that each part was assigned to: stable cores stay, rings meet their own candidates."""
    at = home.copy()
    best = ((x - book[home]) ** 2).sum(1)
    for i, (others, gaps) in enumerate(near):
        if not len(others):
            continue
        ball = np.flatnonzero(home == i)
        ring = np.searchsorted(gaps, 4 * best[ball], side="right")  # how many neighbours the part's ring reaches
        for k, j in enumerate(others):
            rows = ball[ring > k]
            if not len(rows):
                break
            d = ((x[rows] - book[j]) ** 2).sum(1)
            closer = (d < best[rows]) | ((d == best[rows]) & (j < at[rows]))
            best[rows[closer]], at[rows[closer]] = d[closer], j
    return at, best


def assign(x: np.ndarray, codes: np.ndarray | None, balls: Balls, near: list | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances (row, part) of integer vectors (row, part, component)."""
    both = [nearest(x[:, p], book) if near is None else moved(x[:, p], codes[:, p], book, near[p]) for p, book in enumerate(balls.books)]
    return np.stack([a for a, _ in both], 1), np.stack([d for _, d in both], 1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Arrow batches put together to BLOCK_ROWS rows or BLOCK_BYTES."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK_ROWS or sum(b.nbytes for b in held) >= BLOCK_BYTES:
            yield pa.Table.from_batches(held)
            held = []
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _integers(vectors: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have the table's length, and their integers (row, part, component). Vectors are stored in 2 or in 4 bytes a component."""
    n = PARTS * width
    if not n:
        return np.array([v == b"" for v in vectors], bool), np.zeros((sum(v == b"" for v in vectors), PARTS, 0), np.int64)
    right = np.array([v is not None and len(v) in (2 * n, 4 * n) for v in vectors], bool)
    good = [v for v in vectors if v is not None and len(v) in (2 * n, 4 * n)]
    short = b"".join(v for v in good if len(v) == 2 * n)
    long = b"".join(v for v in good if len(v) == 4 * n)
    out = np.empty((len(good), n), np.int64)
    wide = np.array([len(v) == 4 * n for v in good], bool)
    out[~wide] = np.frombuffer(short, "<i2").reshape(-1, n)
    out[wide] = np.frombuffer(long, "<i4").reshape(-1, n)
    return right, out.reshape(len(good), PARTS, width)


def integers_of(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, length, q): kept vectors as the bytes of integers floor(SCALE * component), filled with zeros to a multiple of PARTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, kept = batch.column(0), batch.column(1), []
            lists = batch.column(2)
            starts, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            present = lists.is_valid().to_numpy(zero_copy_only=False)
            whole = ~(~np.isfinite(flat) | lists.values.is_null().to_numpy(zero_copy_only=False))
            broken = np.concatenate([[0], np.cumsum(~whole)])
            for i in range(batch.num_rows):
                low, high = starts[i], starts[i + 1]
                if present[i] and broken[low] == broken[high]:
                    q = np.floor(flat[low:high].astype(np.float64) * SCALE)
                    if len(q) and np.abs(q).max() * math.sqrt(len(q)) >= BOUND:
                        raise ValueError(f"a component of {np.abs(q).max() / SCALE:g} is too large for exact distances")
                    q = np.concatenate([q, np.zeros(-len(q) % PARTS)])
                    kind = "<i2" if not len(q) or np.abs(q).max() < 1 << 15 else "<i4"
                    kept.append((i, int(high - low), q.astype(kind).tobytes()))
            rows = pa.array([i for i, _, _ in kept], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids.take(rows), labels.take(rows), pa.array([n for _, n, _ in kept], pa.int32()), pa.array([q for *_, q in kept], pa.binary())], names=["vec_id", "label", "length", "q"]
            )

    kinds = {f.name: f.dataType.simpleString() for f in embeddings.schema.fields}
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col(vector).cast("array<double>").alias("x"))
    return rows.mapInArrow(run, f"vec_id long, label {kinds['label']}, length int, q binary")


def _pass(rows: DataFrame, balls: Balls, width: int, length: int, last: bool) -> DataFrame:
    """One assignment of all rows: the rows with their codes (kind 'row'), and the sums of each task and entry (kind 'sum').

    In the last pass the vectors themselves are left out and the error of a row is put in."""
    near = None if balls.radii is None else neighbours(balls.books, balls.radii)
    label = dict(rows.dtypes)["label"]
    ddl = f"kind string, vec_id long, label {label}, length int, q binary, code binary, error long, part int, entry int, n long, radius long, sums array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries = balls.books.shape[:2]
        count, radius = np.zeros((parts, entries), np.int64), np.zeros((parts, entries), np.int64)
        sums, names, schema = np.zeros(balls.books.shape, np.int64), [c.split()[0] for c in ddl.split(", ")], None
        for block in _blocks(batches):
            right, x = _integers(block.column("q").to_pylist(), width)
            right &= block.column("length").to_numpy() == length
            if right.sum() < len(x):  # another length that fills up to the same number of bytes
                x = _integers([v if ok else None for v, ok in zip(block.column("q").to_pylist(), right)], width)[1]
            codes = None
            if near is not None:
                stored = [c for c, ok in zip(block.column("code").to_pylist(), right) if ok]
                codes = np.frombuffer(b"".join(stored), np.uint8).reshape(-1, parts).astype(np.int64)
            at, d = assign(x, codes, balls, near)
            for p in range(parts):
                count[p] += np.bincount(at[:, p], minlength=entries)
                np.maximum.at(radius[p], at[:, p], d[:, p])
                np.add.at(sums[p], at[:, p], x[:, p])
            code, error = [None] * len(right), [None] * len(right)
            for i, c, e in zip(np.flatnonzero(right), at.astype(np.uint8), d.sum(1)):
                code[i], error[i] = c.tobytes(), int(e)
            n = block.num_rows
            nulls = lambda kind: pa.nulls(n, kind)
            table = block.combine_chunks()
            one = lambda c: table.column(c).combine_chunks()
            label_type, schema = table.schema.field("label").type, table.schema
            columns = [
                pa.array(["row"] * n, pa.string()), one("vec_id"), one("label"), one("length"), nulls(pa.binary()) if last else one("q"), pa.array(code, pa.binary()), pa.array(error, pa.int64()),
                nulls(pa.int32()), nulls(pa.int32()), nulls(pa.int64()), nulls(pa.int64()), nulls(pa.list_(pa.int64())),
            ]
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        if schema is None or last:
            return
        used = [(p, e) for p in range(parts) for e in range(entries) if count[p, e]]
        n = len(used)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(["sum"] * n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, label_type), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()),
                pa.array([p for p, _ in used], pa.int32()), pa.array([e for _, e in used], pa.int32()), pa.array([int(count[u]) for u in used], pa.int64()), pa.array([int(radius[u]) for u in used], pa.int64()),
                pa.array([sums[u].tolist() for u in used], pa.list_(pa.int64())),
            ], names=names,
        )

    return rows.mapInArrow(run, ddl)


def updated(sums: DataFrame, balls: Balls) -> Balls:
    """The next codebooks, from the sums of all tasks: floor(sum / count), where an entry is used. ENTRIES times the vector length values come to the driver."""
    books, radii = balls.books.copy(), np.zeros(balls.books.shape[:2], np.int64)
    each = sums.select("part", "entry", "n", "radius", F.posexplode("sums").alias("at", "x")).groupBy("part", "entry", "at")
    total = F.sum(F.col("x").cast("decimal(38,0)")).alias("x")
    for r in each.agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), total).collect():
        books[r.part, r.entry, r["at"]] = int(r.x) // r["n"]
        radii[r.part, r.entry] = math.isqrt(r.radius) + 1
    shift = ((books - balls.books) ** 2).sum(2)
    radii += np.array([[math.isqrt(int(s)) + 1 if s else 0 for s in row] for row in shift], np.int64)
    return Balls(books, radii)


def _first(rows: DataFrame, n: int) -> list[Row]:
    """The n first rows (length, x) by id, then by components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, stored = batch.column("length").to_pylist(), batch.column("q").to_pylist()
            x = [np.frombuffer(q, "<i4" if len(q) == 4 * (k + -k % PARTS) else "<i2").tolist() for k, q in zip(sizes, stored)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("length"), pa.array(x, pa.list_(pa.int64()))], names=["vec_id", "length", "x"])

    by = F.col("vec_id").asc_nulls_last()
    ids = rows.select("vec_id").orderBy(by).limit(n).collect()
    if not ids:
        return []
    upto = F.lit(True) if ids[-1].vec_id is None else F.col("vec_id") <= ids[-1].vec_id
    return rows.where(upto).select("vec_id", "length", "q").mapInArrow(run, "vec_id long, length int, x array<long>").orderBy(by, "x").limit(n).collect()


def fit(embeddings: DataFrame, vector: str = "embedding", rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code binary, error long) of all kept vectors, written, and the final codebooks (part, entry, component)."""
    spark: SparkSession = embeddings.sparkSession
    ship(spark)
    made, path = integers_of(embeddings, vector), scratch_path(spark, "integers")
    made.write.parquet(path)
    rows = spark.read.schema(made.schema).parquet(path)
    first = _first(rows, entries)
    if not first:
        return rows.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), np.zeros((PARTS, 0, 0), np.int64)
    length = first[0].length
    width = (length + PARTS - 1) // PARTS
    seeds = _first(rows.where(F.col("length") == length), entries) if any(r.length != length for r in first) else first
    balls = Balls(np.array([r.x for r in seeds], np.int64).reshape(len(seeds), PARTS, width).transpose(1, 0, 2).copy())
    for _ in range(rounds):
        made, before, path = _pass(rows, balls, width, length, last=False), path, scratch_path(spark, "codes")
        made.write.partitionBy("kind").parquet(path)
        removed(spark, before)
        both = spark.read.schema(made.schema).parquet(path)
        balls = updated(both.where("kind = 'sum'"), balls)
        rows = both.where("kind = 'row'").select("vec_id", "label", "length", "q", "code")
    found = saved(_pass(rows, balls, width, length, last=True).select("vec_id", "label", "code", "error"), "codes")
    removed(spark, path)
    return found, balls.books


def codebook_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def codes(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error and the digest of the codebooks."""
    rows, books = fit(embeddings, vector)
    of, other, total = unused(rows, "_of", "_row", "_total")
    named = rows.select(F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias(of), F.struct("vec_id", "code", "error").alias(other))
    sums = saved(named.groupBy(of).agg(F.sum(f"{other}.error").alias(total), F.count("*").alias("n")), "label-errors")
    met = looked_up(named, sums, of, total, other, rows.count())
    code = F.lower(F.hex(f"{other}.code"))
    return met.select(f"{other}.vec_id", code.alias("code"), f"{other}.error", F.col(total).alias("label_error"), F.lit(codebook_digest(books)).alias("codebooks_sha256"))


def oracle(rounds: int = ROUNDS) -> str:
    """Plain Lloyd rounds in SQL, for vectors of one length."""
    far = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    sql = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_resize(list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)), "
        f"{PARTS} * CAST(ceil(len(embedding) / {PARTS}.0) AS BIGINT), 0) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT r, vec_id, q, part, q[part * (len(q) // {PARTS}) + 1 : (part + 1) * (len(q) // {PARTS})] AS x FROM v, (SELECT unnest(range({PARTS})) AS part))",
        f"b0 AS MATERIALIZED (SELECT part, e AS entry, x AS c FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id, q) - 1 AS e FROM p) WHERE e < {ENTRIES})",
    ]
    for k in range(rounds + 1):
        sql.append(
            f"a{k} AS MATERIALIZED (SELECT r, part, any_value(x) AS x, min(struct_pack(d := d, e := entry)) AS best FROM (SELECT r, p.part, x, entry, {far} AS d FROM p JOIN b{k} b ON p.part = b.part) GROUP BY r, part)"
        )
        if k < rounds:
            sql.append(
                f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS c FROM "
                f"(SELECT part, best.e AS entry, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT part, best, x, unnest(range(1, len(x) + 1)) AS i FROM a{k}) GROUP BY ALL) GROUP BY part, entry) m ON b.part = m.part AND b.entry = m.entry)"
            )
    return (
        "WITH " + ",\n".join(sql) + f""",
coded AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN coded USING (r) CROSS JOIN book"""
    )
