"""Periodic runs against a search of all periods, and the contract's columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from rowproof.llm import periodic as pr


def all_runs(words):
    """Every run (start, length, period), by trying each period at each place."""
    n, found = len(words), {}
    for q in range(1, n // pr.TIMES + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(pr.LEAST, pr.TIMES * q):
                found.setdefault((start, length), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def made(seed):
    r = random.Random(seed)
    words = []
    for _ in range(r.randint(1, 5)):
        words += [f"w{r.randint(0, r.choice([1, 3, 500]))}" for _ in range(r.randint(0, 40))]
        unit = [f"u{r.randint(0, r.choice([0, 2, 60]))}" for _ in range(r.choice([1, 2, 5, 7, 8, 15, 16, 17, 31, 32, 33, 50]))]
        words += (unit * 9)[: r.randint(0, 6 * len(unit))]
    return words


def by_tiles(words):
    ids = pr._numbers([w.encode() for w in words])
    found = []
    for _, b, low, high in pr.tiles(ids, np.array([0, len(words)])):
        s = max(0, b - 2 * high)
        found += [(0, q, b + x, b + y) for q, x, y in pr.solved(ids[s : b + 3 * high].tolist(), b - s, low, high)]
    least = {}
    for _, q, s, e in pr._joined(found):
        least[s, e - s + q] = min(q, least.get((s, e - s + q), q))
    return sorted((s, n, q) for (s, n), q in least.items())


@pytest.mark.parametrize("seed", range(150))
def test_tiles_find_what_a_full_search_finds(seed):
    words = made(seed)
    assert by_tiles(words) == all_runs(words)


def test_long_runs_are_stitched_over_many_tiles_in_linear_time():
    assert by_tiles(["a"] * 20000) == [(0, 20000, 1)]
    words = [f"x{i % 700}" for i in range(9000)] + ["end"]
    assert by_tiles(words) == [(0, 9000, 700)]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = all_runs(words)
    over = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in over)))


def test_the_query_equals_brute_force(spark):
    r = random.Random(9)
    rows = [(i, " ".join(made(i)) if i % 3 else "\t".join(f"w{r.randint(0, 99)}\u00a0é" for _ in range(r.randint(0, 200))), "x", 1) for i in range(260)]
    rows += [(1, None, "x", 1), (None, "a b " * 40, None, 1), (3, "", "x", 1), (3, " \n\x0b ", "x", 1), (5, "b " * 30, "x", 1), (5, "b " * 30, "x", 1)]
    got = pr.digests(spark.createDataFrame(rows, "doc_id long, text string, key string, n_words int").repartition(3))
    assert sorted(map(str, got.collect())) == sorted(map(str, (spark.createDataFrame([expected(i, t) for i, t, *_ in rows], got.schema).collect())))
    assert sum(1 for x in got.collect() if x.n_runs) > 100


def test_texts_and_runs_of_the_operator(spark):
    rows = [(1, "go " + "la di da " * 20 + "end"), (2, "no run  here"), (3, None)]
    got = {r.doc_id: (r.text, [tuple(x) for x in r.runs], r.n_words) for r in pr.documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("go la di da end", [(1, 60, 3)], 62), 2: ("no run here", [], 3), 3: ("", [], 0)}
    assert pr.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_intervals_of_different_tiles_are_stitched(spark):
    found = [(1, 5, 0, 40), (1, 5, 30, 60), (1, 5, 60, 90), (1, 5, 100, 130), (1, 10, 0, 85), (2, 5, 0, 40)]
    got = pr.stitched(spark.createDataFrame(found, "key long, period long, start long, end long").repartition(3)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 95, 5), (1, 100, 35, 5), (2, 0, 45, 5)]
