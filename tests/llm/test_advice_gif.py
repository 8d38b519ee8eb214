"""The feature counts every byte of a text, not those of the first frame alone."""

import numpy as np

from rowproof.llm import gif


def test_the_feature_covers_all_frames(spark):
    start = "x" * 36_864
    texts = [start + "a" * 576, start + "z" * 576, "é" * 50_000, "short", None]
    got = {r.doc_id: r.feature for r in gif.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    rgba = np.concatenate([gif.palette_332(), np.full((256, 1), 255, np.uint8)], axis=1)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        raw += b"\xff" * (576 - len(raw) if not raw else -len(raw) % 576)
        want = gif.colour_histogram(rgba[np.frombuffer(raw, np.uint8)].reshape(1, -1, 4))
        assert got[i].split("hist=")[1] == ",".join(map(str, want)) and sum(want) == len(raw)
    assert got[0] != got[1]
