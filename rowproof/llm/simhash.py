"""SimHash near-duplicates with BK-trees.

A fingerprint is the bitwise majority of the 64-bit XXH64 hashes (seed 42) of a text's word shingles. Distinct
fingerprints within `radius` differing bits are linked, and documents whose fingerprints are reachable from
each other form a group.

Search: cut the 64 bits into `radius + 2` blocks. Fingerprints that differ in at most `radius` bits agree in at least two blocks, so
that each pair of blocks gives a shard key of about 21 bits and every close pair meets under some key. A shard's
fingerprints form a BK-tree, whose children are keyed by their Hamming distance to the parent; a query follows only
the edges within the radius. A shard of more than `shard_rows` fingerprints is cut into several trees and each
pair of them gets a task of its own. Trees are built where Spark's shuffle brings a shard together rather than
broadcast, as the trees of all documents have no size bound. Only edges of a spanning forest leave a shard.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; fewer words than a shingle
make one shingle of the whole sequence; equal fingerprints are one node however many documents have them; a null
doc_id is carried but never names a component (null if no other id is in it); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowproof.llm.common import text_of
from rowproof.llm.components import components, looked_up
from rowproof.session import saved

WORDS, RADIUS, SEED = 4, 4, 42
SHARD_ROWS = 512
#: Shingles whose bits are counted at a time, so that long texts need bounded memory.
RUN = 65_536


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The SimHash of a text in UTF-8: A-Z lower-cased, cut at ASCII white space, shingles with repeats."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) < words:
        starts, ends = [0], [len(joined)]
    else:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        stop = np.cumsum(sizes + 1) - 1
        starts, ends = (stop - sizes)[: len(parts) - words + 1].tolist(), stop[words - 1 :].tolist()
    total = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), RUN):
        hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(starts[at : at + RUN], ends[at : at + RUN])], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(total * 2 > len(starts), bitorder="little")
    return int(bits.view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, fp): the fingerprint of every whole text as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_of(text_col).cast("binary").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, fp long")


class BkTree:
    """A metric tree over integers under Hamming distance."""

    def __init__(self, values: Iterable[int] = ()) -> None:
        self.root: tuple[int, dict] | None = None
        for v in values:
            self.add(v)

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while d := (node[0] ^ value).bit_count():
            if d not in node[1]:
                node[1][d] = (value, {})
                return
            node = node[1][d]

    def within(self, value: int, radius: int) -> Iterator[int]:
        """The values at most radius away: by the triangle inequality only edges d - radius .. d + radius can lead there."""
        stack = [self.root] if self.root else []
        while stack:
            held, children = stack.pop()
            d = (held ^ value).bit_count()
            if d <= radius:
                yield held
            if len(children) <= 2 * radius:
                stack += [child for edge, child in children.items() if d - radius <= edge <= d + radius]
            else:
                stack += [children[edge] for edge in range(d - radius, d + radius + 1) if edge in children]


def shard_edges(left: list[int], right: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within left, or between left and right where right is another list."""
    parent = {v: v for v in (*left, *right)}

    def find(v: int) -> int:
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    out = []

    def link(a: int, b: int) -> None:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))

    tree = BkTree(left)
    for v in right or left:
        for w in tree.within(v, radius):
            link(v, w)
    return out


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of radius + 2 blocks of nearly equal width."""
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _keys(fp: Column, radius: int) -> Column:
    """One shard key for each pair of blocks: the pair's number above the two blocks' bits."""
    part = lambda a, n: F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << n) - 1))
    return F.array(*[F.lit(k << 48).bitwiseOR(F.shiftleft(part(*x), y[1])).bitwiseOR(part(*y)) for k, (x, y) in enumerate(combinations(_blocks(radius), 2))])


def close_edges(fps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(u, v): links between distinct fingerprints of column fp that connect all pairs within the radius."""
    keyed = fps.select("fp", F.explode(_keys(F.col("fp"), radius)).alias("key"))
    sizes = saved(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shards")
    parts = F.ceil(F.col("n") / shard_rows).cast("int")
    mine = F.pmod(F.xxhash64("fp"), parts.cast("long")).cast("int")
    # Part i of a shard meets every part j: in task (i, j) as the left side for j >= i, as the right side below.
    met = keyed.join(sizes, "key").withColumn("parts", parts).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = met.select("key", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "mine", "fp")
    rows = dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, at = [], [], None
        found: list[tuple[int, int]] = []
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1
            for i, j in zip([0, *change], [*change, batch.num_rows]):
                if j <= i:
                    continue
                here = (int(cols[0][i]), int(cols[1][i]), int(cols[2][i]))
                if here != at:
                    found += _shard(left, right, at, radius)
                    left, right, at = [], [], here
                values = cols[4][i:j].view(np.uint64)
                side = cols[3][i:j] == here[1]
                left += values[side].tolist()
                right += values[~side].tolist()
            if len(found) > 50_000:
                yield _edge_batch(found)
                found = []
        found += _shard(left, right, at, radius)
        yield _edge_batch(found)

    return rows.mapInArrow(run, "u long, v long")


def _shard(left: list[int], right: list[int], at: tuple[int, int, int] | None, radius: int) -> list[tuple[int, int]]:
    if at is None or len(left) + len(right) < 2:
        return []
    if at[1] == at[2]:
        if len(left) == 2:
            return [(left[0], left[1])] if (left[0] ^ left[1]).bit_count() <= radius else []
        return shard_edges(left, [], radius)
    return shard_edges(left, right, radius) if left and right else []


def _edge_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


def groups(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex) and component_id, the smallest doc_id of its group."""
    marked = saved(with_fingerprints(docs, words=words), "fingerprints")
    nodes = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = saved(components(close_edges(nodes, radius, shard_rows)), "roots")
    member = saved(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "members")
    named = saved(member.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "components")
    by_fp = looked_up(member.select("root", "fp"), named, "root", "component_id", "fp", member.count())
    return marked.join(by_fp.drop("root"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """The rows of docs that are the smallest id of their group, once each; rows without an id stay, as nothing stands for them.

    The ids that go, and those that repeat, are written first, so that the optimizer knows their size: it broadcasts a
    short list and shuffles docs only for a long one.
    """
    found = groups(docs.where("doc_id is not null"), radius, words)
    found = found.groupBy("doc_id").agg(F.min("component_id").alias("least"), F.count("*").alias("n"))
    out = saved(found.where("n > 1 or least <> doc_id"), "repeated")
    once = docs.join(out, "doc_id", "left_anti")
    again = docs.join(out.where("least = doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.select(*docs.columns).unionByName(again.select(*docs.columns))
