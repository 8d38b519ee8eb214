"""Embedding near-duplicates with an inverted multi-index.

Vectors are scaled to length one and cut in two halves; each half has its own codebook, and the grid of both is the
cells' product. A vector lives in the cell of its nearest codewords. To find its neighbours it visits cells in the
order of a multi-sequence traversal: a heap over the two sorted lists of half distances, least sum first. The half
distance to a codeword is that to the plane which separates it from the vector's own, so that the sum of squares is a
lower bound on the distance to anything in that cell. With `reach` = 1 the traversal stops where the bound passes the
threshold's distance, and recall is 1; a lower reach stops earlier. Cosines are then verified in double precision.

Equal vectors of a label are one class with a count. Each label's cells are shuffled to tasks, with the vectors as they were given; a cell
with more than `part` classes is cut, its visitors meet every part, and stream through it in batches. A task sends on only the number of links of
each visitor and the edges of a spanning forest.

The codebooks come from a bounded sample (`sample_rows`, by hash), one for every vector length in it; a length too rare for the sample is one
cell. The index holds every vector. Codewords per half: the root of classes / labels / cell_size, 2 to 256. Cells are large, as a product of
matrices costs less than the shuffle of a vector to one more cell.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link with
nothing and are their own component; only vectors of equal length are compared; repeated rows count as separate
vectors; a null vec_id is counted as a link but names no component; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowproof.llm.components import components, looked_up
from rowproof.session import saved

THRESHOLD, REACH = 0.98, 1.0
SAMPLE_ROWS, CELL_SIZE, PART = 20_000, 2048, 4096
FORMAT = "label string, dim int, cell int, role int, key binary, m long, vec binary"


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Codewords for the rows of x; the same for the same rows."""
    rng = np.random.default_rng(7)
    words = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((words**2).sum(1) - 2 * x @ words.T, axis=1)
        count = np.bincount(near, minlength=len(words))
        total = np.zeros_like(words)
        np.add.at(total, near, x)
        words = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], words)
    return np.unique(words, axis=0)


def plane_distances(x: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row its nearest codeword, and for each codeword the distance to the plane between the two (0 for its own)."""
    square = np.maximum((x**2).sum(1)[:, None] + (words**2).sum(1) - 2 * x @ words.T, 0)
    own = np.argmin(square, axis=1)
    apart = np.sqrt(((words[own][:, None, :] - words[None]) ** 2).sum(2))
    gap = square - square[np.arange(len(x)), own][:, None]
    return own, np.where(apart > 0, gap / np.maximum(2 * apart, 1e-300), 0.0)


def multi_sequence(first: np.ndarray, second: np.ndarray, most: float) -> Iterator[tuple[int, int]]:
    """Cells (i, j) in ascending order of first[i]^2 + second[j]^2, while the sum is at most `most`."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    f, s = first[a] ** 2, second[b] ** 2
    heap = [(float(f[0] + s[0]), 0, 0)]
    while heap and heap[0][0] <= most:
        _, i, j = heapq.heappop(heap)
        yield int(a[i]), int(b[j])
        if j + 1 < len(s):
            heapq.heappush(heap, (float(f[i] + s[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(f):
            heapq.heappush(heap, (float(f[i + 1] + s[0]), i + 1, 0))


def _unit(vectors: np.ndarray) -> np.ndarray:
    big = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / big  # first by the largest component, so that squares neither vanish nor overflow
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _valid(vec: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return (F.size(vec) > 0) & F.forall(vec, fine) & F.exists(vec, lambda x: x != 0)


def codebooks(classes: DataFrame, sample_rows: int, cell_size: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The two codebooks of each vector length, from a bounded sample of the classes."""
    total = classes.count()
    place = F.pmod(F.xxhash64(F.lit("codebook"), "key"), F.lit(1 << 30)) / float(1 << 30)
    rows = classes.where(place < min(1.0, sample_rows / max(total, 1))).select("dim", "vec").orderBy("dim", "key").toArrow()
    dims = rows.column("dim").to_numpy()
    met = np.unique(dims).tolist()  # as many as the sample has rows, at most
    counts = classes.where(F.col("dim").isin(met)).groupBy("dim").agg(F.count("*").alias("n"), F.approx_count_distinct("label").alias("labels"))
    shape = counts.orderBy("dim").collect() if met else []
    books = {}
    for r in shape:
        mine = rows.filter(pa.array(dims == r.dim)).column("vec")
        x = pc.list_flatten(mine).to_numpy().astype(float).reshape(len(mine), r.dim)
        if len(x):
            x, k = _unit(x), int(np.clip(round((r["n"] / max(r.labels, 1) / cell_size) ** 0.5), 2, 256))
            books[r.dim] = (k_means(x[:, : r.dim // 2], k), k_means(x[:, r.dim // 2 :], k))
    return books


def _dtype(classes: DataFrame) -> str:
    """How vectors are sent: floats as they are, other numbers as doubles."""
    return "<f4" if classes.schema["vec"].dataType.elementType.typeName() == "float" else "<f8"


def _visits(classes: DataFrame, books: dict, bound: float, members_only: bool = False) -> DataFrame:
    """Each class as a member (role 0) of its cell and, unless `members_only`, as a visitor (role 1) of each cell it must look in."""
    shared = classes.sparkSession.sparkContext.broadcast(books)  # 512 codewords for each length that the bounded sample has
    dtype = _dtype(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                given = part.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                unit = _unit(given.astype(float))
                zero = np.zeros((1, 0))
                one, two = shared.value.get(dim, (zero, zero))
                own1, d1 = plane_distances(unit[:, : one.shape[1]], one)
                own2, d2 = plane_distances(unit[:, dim - two.shape[1] :], two)
                row, cell, role = [], [], []
                for i in range(len(unit)):
                    visited = [] if members_only else [a * len(two) + b for a, b in multi_sequence(d1[i], d2[i], bound)]
                    row += [i] * (len(visited) + 1)
                    cell += [int(own1[i]) * len(two) + int(own2[i]), *visited]
                    role += [0] + [1] * len(visited)
                take = pa.array(row, pa.int64())
                sent = given.astype(dtype)[row] if not members_only else np.zeros((len(row), 0), dtype)
                ends = np.arange(0, sent.shape[1] * sent.itemsize * len(row) + 1, max(sent.shape[1] * sent.itemsize, 1), np.int32) if sent.size else np.zeros(len(row) + 1, np.int32)
                vec = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(sent.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(cell, pa.int32()), pa.array(role, pa.int32()), part.column(2).take(take), part.column(3).take(take), vec], names=["label", "dim", "cell", "role", "key", "m", "vec"])

    return classes.select("label", "dim", "key", "m", "vec").mapInArrow(run, FORMAT)


class _Part:
    """The members of one part of a cell."""

    def __init__(self) -> None:
        self.keys: list[bytes] = []
        self.weights: list[int] = []
        self.vectors: list[np.ndarray] = []
        self.root: np.ndarray | None = None

    def add(self, keys: list[bytes], weights: list[int], vectors: np.ndarray) -> None:
        self.keys += keys
        self.weights += weights
        self.vectors.append(vectors)

    def visit(self, keys: list[bytes], vectors: np.ndarray, threshold: float) -> tuple[np.ndarray, list[tuple[bytes, bytes]]]:
        """Weighted links of each visitor, and the edges that join parts of the forest."""
        if not self.keys:
            return np.zeros(len(keys), np.int64), []
        if self.root is None:
            self.matrix, self.root, self.m = np.concatenate(self.vectors), np.arange(len(self.keys)), np.array(self.weights, np.int64)
        near = vectors @ self.matrix.T >= threshold
        edges = []
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            roots, first = np.unique(self.root[near[i]], return_index=True)
            at = np.flatnonzero(near[i])[first]
            edges += [(keys[i], self.keys[j]) for j in at.tolist() if self.keys[j] != keys[i]]
            if len(roots) > 1:
                self.root[np.isin(self.root, roots)] = roots[0]
        return near @ self.m, edges


def _verified(classes: DataFrame, books: dict, bound: float, threshold: float, part: int) -> DataFrame:
    """(key, n, other): weighted links of key within one part, or an edge to other.

    Vectors are shuffled once, to the cells that they visit. The cells that are cut, one for `part` classes at most, are counted before.
    """
    cell = ["label", "dim", "cell"]
    members = _visits(classes, books, bound, members_only=True).groupBy(*cell).agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    cut = saved(members.where("parts > 1"), "cut-cells")
    dealt = _visits(classes, books, bound).join(cut, cell, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    mine = F.pmod(F.xxhash64("key"), F.col("parts").cast("long")).cast("int")
    part_col = F.explode(F.when(F.col("role") == 0, F.array(mine)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select(*cell, "role", "key", "m", "vec", part_col.alias("part"))
    rows = dealt.repartition(*cell, "part").sortWithinPartitions(*cell, "part", "role")
    dtype = _dtype(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, _Part()
        for batch in batches:
            names = batch.schema.names
            col = {n: batch.column(i) for i, n in enumerate(names)}
            ids = list(zip(*(col[n].to_pylist() for n in (*cell, "part", "role"))))
            cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            out: list[tuple[bytes, int, bytes | None]] = []
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if ids[i][:4] != at:
                    at, held = ids[i][:4], _Part()
                keys = col["key"].slice(i, j - i).to_pylist()
                vectors = _unit(np.frombuffer(b"".join(col["vec"].slice(i, j - i).to_pylist()), dtype).reshape(j - i, -1).astype(float))
                if ids[i][4] == 0:
                    held.add(keys, col["m"].slice(i, j - i).to_pylist(), vectors)
                else:
                    links, edges = held.visit(keys, vectors, threshold)
                    out += [(k, int(n), None) for k, n in zip(keys, links.tolist()) if n]
                    out += [(a, 0, b) for a, b in edges]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), (pa.binary(), pa.int64(), pa.binary()))], names=["key", "n", "other"])

    return rows.mapInArrow(run, "key binary, n long, other binary")


def links(vectors: DataFrame, threshold: float = THRESHOLD, reach: float = REACH, sample_rows: int = SAMPLE_ROWS, cell_size: int = CELL_SIZE, part: int = PART) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept."""
    vec = F.col("embedding")
    ok = F.coalesce(F.col("label").isNotNull() & _valid(vec), F.lit(False))
    hashes = (F.xxhash64("label", vec), F.xxhash64(F.lit("v"), "label", vec))
    own = F.unhex(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in hashes]))
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.when(ok, vec).alias("vec"), F.when(ok, own).alias("key"))
    classes = saved(rows.where("key is not null").groupBy("key").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.count("*").alias("m"), F.min("vec_id").alias("least")).withColumn("dim", F.size("vec")), "classes")
    books = codebooks(classes, sample_rows, cell_size)
    # |u - v|^2 = 2 - 2 cos; a hair more, as the bound is computed in floating point.
    found = saved(_verified(classes, books, (2 - 2 * threshold) * reach + 1e-9, threshold, part), "links")
    roots = components(found.where("other is not null").select(F.col("key").alias("u"), F.col("other").alias("v")))
    counts = found.where("other is null").groupBy("key").agg((F.sum("n") - 1).alias("n_links"))
    named = saved(classes.select("key", "least", "m").join(roots, F.col("key") == F.col("node"), "left").select("key", "least", "m", F.coalesce("root", "key").alias("root")), "members")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    by_class = looked_up(named.select("root", F.struct("key", "m").alias("class")), ids, "root", "component_id", "class", named.count())
    told = F.struct("component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")).alias("told")
    per_class = saved(by_class.select("class.key", "component_id", "class.m").join(counts, "key", "left").select("key", told, F.col("m").alias("n")), "per-class")
    # Vectors of a class of very many copies are dealt out by their ids, and those that link with nothing meet no class.
    met = looked_up(rows.where("key is not null").select("key", "vec_id"), per_class, "key", "told", "vec_id", per_class.agg(F.sum("n")).first()[0] or 0)
    linked = met.select("vec_id", "told.n_links", "told.component_id")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
