"""Ball k-means against plain Lloyd rounds in integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowproof.llm import ballkmeans as bk

DDL = "vec_id long, embedding array<float>, label int, code string, kind int"


def lloyd(rows):
    """{row: (code, error)} and the codebooks of rows (vec_id, vector), by full searches."""
    kept = sorted(((i, [math.floor(bk.SCALE * float(np.float32(x))) for x in v]) for i, v in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    n = -(-len(kept[0][1]) // bk.PARTS)
    x = np.array([v + [0] * (n * bk.PARTS - len(v)) for _, v in kept]).reshape(len(kept), bk.PARTS, n)
    books = x[: bk.ENTRIES].copy()
    for k in range(bk.ROUNDS + 1):
        d = ((x[:, None] - books[None]) ** 2).sum(3)
        at = d.argmin(1)
        if k < bk.ROUNDS:
            for p in range(bk.PARTS):
                for e in range(len(books)):
                    mine = x[at[:, p] == e, p]
                    if len(mine):
                        books[e, p] = [int(s) // len(mine) for s in mine.sum(0)]
    codes = ["".join(f"{c:02x}" for c in row) for row in at]
    digest = hashlib.sha256(",".join(str(v) for v in books.transpose(1, 0, 2).reshape(-1)).encode()).hexdigest()
    return sorted(zip([i for i, _ in kept], codes, d.min(1).sum(1)), key=str), digest


def vectors(seed, n, length, ties=False):
    r = random.Random(seed)
    homes = [[r.uniform(-1, 1) for _ in range(length)] for _ in range(20)]
    near = lambda h: [round(c * 3) / 4 if ties else c + r.gauss(0, 0.1) for c in h]
    return [(i * 3 % n, near(r.choice(homes)), r.choice([None, 1, 2]), "x", 5) for i in range(n)]


@pytest.mark.parametrize("seed,n,length,ties", [(1, 400, 16, False), (2, 300, 24, True), (3, 9, 8, False), (4, 60, 13, False)])
def test_codes_equal_full_searches(spark, seed, n, length, ties):
    rows = vectors(seed, n, length, ties)
    dirty = [(7, None, 1, "", 0), (8, [None] * length, 1, "", 0), (9, [float("nan")] * length, 2, "", 0), (10, [float("inf")] * length, 2, "", 0)]
    more = [rows[0], rows[0], (None, rows[1][1], 3, "", 0)]
    want, digest = lloyd([(i, v) for i, v, *_ in rows + more])
    got = bk.codes(spark.createDataFrame(rows + more + dirty, DDL).repartition(5)).collect()
    assert sorted([(r.vec_id, r.code, r.error) for r in got], key=str) == [(i, c, int(e)) for i, c, e in want]
    assert {r.codebooks_sha256 for r in got} == {digest}
    label = {}
    for (i, v, lab, *_), (_, _, e) in zip(sorted(rows + more, key=lambda r: (r[0] is None, r[0] or 0)), sorted(want, key=lambda r: (r[0] is None, r[0] or 0))):
        label[lab] = label.get(lab, 0) + int(e)
    assert sum({r.label_error for r in got}) == sum(set(label.values())) or ties


def test_cores_and_rings_skip_work_and_change_nothing():
    r = np.random.default_rng(5)
    homes = r.integers(-4000, 4000, (16, 12))
    x = homes[r.integers(0, 16, 5000)] + r.integers(-900, 900, (5000, 12))
    home, d = bk.nearest(x, homes)
    book = homes + r.integers(-60, 60, homes.shape)
    radius = np.array([math.isqrt(int(d[home == e].max(initial=0))) + 1 + math.isqrt(int(((book[e] - homes[e]) ** 2).sum())) + 1 for e in range(16)])
    near = bk.neighbours(book[None], radius[None])[0]
    at, best = bk.moved(x, home, book, near)
    full, least = bk.nearest(x, book)
    assert (at == full).all() and (best == least).all()
    own = ((x - book[home]) ** 2).sum(1)
    met = sum(int(np.searchsorted(gaps, 4 * own[home == i], side="right").sum()) for i, (_, gaps) in enumerate(near))
    assert met < 0.5 * 15 * len(x)  # of the distances that a full search computes


def test_ties_go_to_the_lower_index():
    book = np.array([[0, 0], [4, 0], [4, 0]])
    x = np.array([[2, 0], [4, 0]])
    near = bk.neighbours(book[None], np.full((1, 3), 10))[0]
    for home in ([0, 2], [2, 1], [1, 0]):
        assert bk.moved(x, np.array(home), book, near)[0].tolist() == [0, 1]


def test_other_lengths_large_components_and_no_rows(spark):
    assert bk.codes(spark.createDataFrame([], DDL)).collect() == []
    rows = [(1, [0.5] * 8, 1, "", 0), (2, [0.25] * 16, 1, "", 0), (3, [9.5] * 8, 1, "", 0), (4, [], 1, "", 0)]
    got = {r.vec_id: r for r in bk.codes(spark.createDataFrame(rows, DDL)).collect()}
    assert got[2].code is None and got[4].code is None and got[1].error == 0 and got[3].error == 0 and got[2].label_error == 0
    assert [r.error for r in bk.codes(spark.createDataFrame([(1, [], 1, "", 0)], DDL)).collect()] == [0]
    with pytest.raises(Exception, match="too large"):
        bk.codes(spark.createDataFrame([(1, [1e30] * 8, 1, "", 0)], DDL)).collect()


def test_a_label_that_most_rows_share_is_summed_once(spark):
    rows = [(i, [float(i % 7), 1.0, 0, 0, 0, 0, 0, i % 3], 1 if i % 10 else None, "", 0) for i in range(500)]
    got = bk.codes(spark.createDataFrame(rows, DDL)).select("vec_id", "error", "label_error").collect()
    total = sum(r.error for r in got if r.vec_id % 10)
    assert {r.label_error for r in got if r.vec_id % 10} == {total}
    assert spark.createDataFrame(rows, DDL).where(F.col("label").isNull()).count() == sum(1 for r in got if r.vec_id % 10 == 0)
