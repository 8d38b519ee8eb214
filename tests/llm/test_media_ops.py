"""GIF, WARC, HTML and embeddings: round trips, brute force, and the awkward cases."""

import gzip
import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from rowproof.llm import gif, htmlcrf, multiindex, warc
from rowproof.session import scratch_path

AWKWARD = ["", None, " ", "a" * 576, "é" * 288, "x" * 100_000, "plain", "plain"]


# ---- GIF


@pytest.mark.parametrize("n", [1, 2, 575, 3000, 40_000])
@pytest.mark.parametrize("k", [1, 2, 5, 256])
def test_lzw_round_trip(n, k):
    rng = random.Random(n * k)
    data = bytes(rng.randrange(k) for _ in range(n))
    assert gif.lzw_expand(gif.lzw_compress(data), 8, n) == data


def pack(codes, width):
    bits = "".join(f"{c:0{width}b}"[::-1] for c in codes)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))


def test_small_code_sizes_and_bad_streams():
    assert gif.lzw_expand(pack([4, 1, 6, 2, 5], 3), 2, 9) == bytes([1, 1, 1, 2])  # code 6 names itself
    with pytest.raises(ValueError):
        gif.lzw_expand(pack([4, 1, 7, 5], 3), 2, 9)
    full = bytes(i % 251 for i in range(60_000))
    assert gif.lzw_expand(gif.lzw_compress(full), 8, 60_000) == full


def frame(index, w, h, left=0, top=0, disposal=1, clear=None, delay=5, flags=0, palette=b""):
    control = b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (clear is not None), delay, clear or 0, 0)
    return control + b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + palette + b"\x08" + gif._blocks(gif.lzw_compress(bytes(index)))


def test_disposal_transparency_palettes_and_interlacing():
    shared = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])  # black, red, green, blue
    local = bytes([9, 9, 9, 7, 7, 7])
    data = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0xF1, 0, 0) + shared + b"\x21\xfe\x03abc\x00"
    data += frame([1, 1, 1, 1], 2, 2) + frame([2, 3], 2, 1, clear=3, disposal=2) + frame([3], 1, 1, 1, 1, disposal=3, delay=0)
    data += frame([1], 1, 1, 0, 1, flags=0x80, palette=local) + b"\x3b"
    f = list(gif.read_gif(data))
    red, green, blue, none = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0)
    shown = [[tuple(p) for p in x.canvas.reshape(-1, 4).tolist()] for x in f]
    assert shown[0] == [red] * 4
    assert shown[1] == [green, red, red, red]  # the transparent pixel lets red through
    assert shown[2] == [none, none, red, blue]  # the second frame's row was cleared
    assert shown[3] == [none, none, (7, 7, 7, 255), red]  # the blue pixel was undone
    assert [(x.start_ms, x.delay_ms) for x in f] == [(0, 50), (50, 50), (100, 0), (100, 50)]
    rows = [bytes([i]) * 2 for i in range(9)]
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    data = b"GIF89a" + struct.pack("<HHBBB", 2, 9, 0, 0, 0) + frame(b"".join(rows[i] for i in order), 2, 9, flags=0x40) + b"\x3b"
    assert next(gif.read_gif(data)).samples == b"".join(rows)
    assert gif.colour_histogram(f[0].canvas)[0b110000] == 4


HUGE = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b"\x3b"


def test_stored_texts_come_back(spark):
    d = spark.createDataFrame(list(enumerate(AWKWARD)), "doc_id long, text string").selectExpr("*", "1 as media")
    got = {r.doc_id: r for r in gif.digests(d).collect()}
    for i, t in enumerate(AWKWARD):
        raw = (t or "").encode()
        want = raw + b"\xff" * (576 - len(raw) if not raw else -len(raw) % 576)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
        assert r.error is None
    assert got[6].media_sha256 == got[7].media_sha256 and "frames=3;" in got[5].feature
    broken = spark.createDataFrame([(1, b"GIF89a"), (2, b"nope"), (3, None), (4, HUGE)], "doc_id long, media binary")
    assert {r.doc_id: (r.error, len(r.frames)) for r in gif.decode_frames(broken, ["doc_id"]).collect()} == {1: ("the file is cut short", 0), 2: ("the file is cut short", 0), 3: (None, 0), 4: ("a canvas of 65535 x 65535 pixels", 0)}
    assert gif.digests(d.where("false")).count() == 0


# ---- WARC


def test_records_survive_normalising_and_offsets_seek(spark, tmp_path):
    rows = [(i, f"http://h/{i}\r\nX: y" if i else None, "<p>%s</p>" % ("same " * 40 if i % 4 == 1 else f"own {i} " * (i % 50))) for i in range(60)] + [(60, "u", None), (61, "u", "short"), (62, "u", "short"), (63, "u", "é\r\n\r\nWARC/1.1 " * 30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as payload")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    first = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        digest = hashlib.sha256(raw).hexdigest()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), digest)
        revisit = len(raw) >= 100 and digest in first
        assert (got[i].record_type, got[i].refers_to) == (("revisit", first[digest]) if revisit else ("response", None))
        first.setdefault(digest, i)
    assert warc.round_trip(pages.where("false")).count() == 0


def test_archives_are_members_with_an_index(spark):
    pages = spark.createDataFrame([(i, "u", f"page {i}" * 50) for i in range(30)], "page_id long, url string, html string").coalesce(1)
    raw, target = scratch_path(spark, "t-raw"), scratch_path(spark, "t-out")
    crawl = warc.write_monolithic(pages, raw, roll_bytes=4000)
    assert crawl.count() > 1
    done = warc.normalise(spark, raw, crawl, target)
    assert sum(r.records for r in done.collect()) == 30
    fs, base = warc.open_folder(target)
    name = done.first().archive
    data = fs.open_input_stream(f"{base}/{name}", compression=None).read()
    assert list(warc.split_records(iter([gzip.decompress(data)])))  # still one valid gzip file as a whole
    with pytest.raises(ValueError):
        list(warc.inflate(data[:-5]))
    pieces = [b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"]
    for cut in range(1, len(pieces[0])):
        assert len(list(warc.split_records(iter([pieces[0][:cut], pieces[0][cut:]])))) == 1
    with pytest.raises(ValueError):
        list(warc.split_records(iter([pieces[0][:-3]])))


# ---- HTML


def test_leaf_blocks():
    page = "<title>t</title><div>a &amp; b&copy <b>c<p>d<br>e<li>f</li><script>x='<p>'</script><!-- <p>no --><style>p{}</style><p>g<table><tr><td>h<td>i</table>tail"
    assert [b.text for b in htmlcrf.leaf_blocks(page)] == ["a & b© c", "d e", "f", "g", "h", "i", "tail"]
    assert htmlcrf.leaf_blocks("") == [] and htmlcrf.leaf_blocks("<script>never closed") == []
    assert [b.text for b in htmlcrf.leaf_blocks("plain < text")] == ["plain < text"]


def test_viterbi_and_training_agree_with_enumeration():
    rng = np.random.default_rng(0)
    model = htmlcrf.Field({f: tuple(rng.normal(size=2)) for f in "abc"}, rng.normal(size=(2, 2)))
    rows = [[str(rng.choice(list("abc"))) for _ in range(2)] for _ in range(7)]
    unary = np.array([[sum(model.weights[f][s] for f in r) for s in (0, 1)] for r in rows])
    best = max((tuple(n >> i & 1 for i in range(7)) for n in range(128)), key=lambda s: sum(unary[i, x] for i, x in enumerate(s)) + sum(model.steps[a, b] for a, b in zip(s, s[1:])))
    assert model.decode(rows) == list(best) and model.decode([]) == []
    trained = htmlcrf.train_field([([["a"], ["b"], ["b"], ["a"]], [0, 1, 1, 0]), ([["b"]], [1]), ([], [])])
    assert trained.decode([["a"], ["b"], ["a"]]) == [0, 1, 0]


CUSTOM = """<html><body><div id="cookie-notice">We use cookies.</div><header class="site-header">My Site</header><ul class="nav"><li><a href=/>Home</a><li><a href=/b>About</a></ul>
<div class="sidebar"><h3>Related</h3><p>Some other story here about things. It is long, too, really.</p></div><div class="post-content"><h1>The Title</h1><p>First paragraph of text, with <a href=x>a link</a> &amp; more. It goes on.
<p>Second one.<br>More.</div><form><p>Subscribe now</p></form><div class="comments"><p>Great post, thanks! I really liked it.</p></div><div class="footer">&copy; 2020</div></body></html>"""


def test_main_text_on_held_out_pages_and_a_foreign_layout(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id")
    model = htmlcrf.train(pages.where("page_id % 2 = 0"))
    held = pages.where("page_id % 2 = 1").collect()
    right = 0
    for r in held:
        blocks = htmlcrf.leaf_blocks(r.html)
        want = "\n".join(b.text for b, s in zip(blocks, htmlcrf.weak_labels(blocks)) if s)
        right += htmlcrf.main_text(r.html, model) == want
    assert right >= 0.98 * len(held)
    assert htmlcrf.main_text(CUSTOM, model) == "The Title\nFirst paragraph of text, with a link & more. It goes on.\nSecond one. More."


def test_extraction_of_awkward_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    more = spark.createDataFrame([(-1, None, None), (-2, "u", ""), (None, "u", "<p>"), (-3, "u", "no markup at all")], pages.schema)
    got = {r.page_id: r for r in htmlcrf.extracted(pages.unionByName(more)).collect()}
    assert got[-1].text == got[-2].text == got[None].text == "" and got[-1].n_chars == 0 and len(got) == pages.count() + 4
    assert htmlcrf.extracted(pages.where("false")).count() == 0


# ---- embeddings


def brute_links(rows, threshold):
    out = {}
    for i, (v, label, x) in enumerate(rows):
        out[i] = []
        for j, (_, other, y) in enumerate(rows):
            if i != j and label is not None and label == other and usable(x) and usable(y) and len(x) == len(y):
                a, b = np.array(x, float), np.array(y, float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                    out[i].append(j)
    return out


def usable(x):
    return x is not None and len(x) > 0 and all(c is not None and np.isfinite(c) for c in x) and any(x)


@pytest.mark.parametrize("part,cell_size", [(1024, 256), (3, 4)])
def test_links_equal_brute_force(spark, part, cell_size):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    rows = []
    for i in range(220):
        rows.append((i, int(i % 3), (centres[rng.integers(12)] + rng.normal(size=8) * rng.choice([0.01, 0.1, 0.25])).astype(np.float32).tolist()))
    rows += [(300 + k, 1, rows[1][2]) for k in range(5)] + [(400, None, rows[1][2]), (401, 1, None), (402, 1, [0.0] * 8), (403, 1, [float("nan")] * 8), (404, 1, [None, 1.0]), (405, 1, []), (406, 1, [1.0, 2.0]), (407, 1, [2.0, 4.0]), (408, 0, [1e-30] * 8), (409, 0, [3.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = {r.vec_id: r for r in multiindex.links(df, part=part, cell_size=cell_size).collect()}
    want = brute_links(rows, 0.98)
    assert {v: got[v].n_links for v, _, _ in rows} == {rows[i][0]: len(x) for i, x in want.items()}
    for i, (v, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in want[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min(rows[j][0] for j in seen)
        assert (got[v].component_id, got[v].kept) == (least, v == least)


def test_multi_sequence_visits_cells_in_order():
    rng = np.random.default_rng(2)
    a, b = rng.random(7), rng.random(5)
    seen = list(multiindex.multi_sequence(a, b, 0.8))
    cost = [a[i] ** 2 + b[j] ** 2 for i, j in seen]
    assert cost == sorted(cost) and set(seen) == {(i, j) for i in range(7) for j in range(5) if a[i] ** 2 + b[j] ** 2 <= 0.8}


def test_empty_embeddings(spark):
    assert multiindex.links(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0
