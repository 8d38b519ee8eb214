"""Byte-level BPE encoding and decoding with a pair occurrence index.

Texts are cut into words by the vocabulary's public pattern. The distinct words that a partition has not
seen yet are laid end to end in one symbol array; an index maps each adjacent pair that has a rank to all
its positions there. The active ranks are then applied in ascending order: one rank is merged at all its
positions at once and only the lists of the neighbouring pairs are updated. A merge can only create pairs
of a higher rank (a token must exist before a rule can use it), so that one ascending pass is exact.

Defined cases: a null text is the empty text and gives no ids; equal texts give equal ids; the text of an
added token (such as an end-of-text mark) becomes that token's id, as the public library does by default;
words of any length are taken whole; null ids decode to the empty text; other columns of the input are not
carried, so that their names cannot clash.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the public pre-tokenization pattern of this vocabulary family.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents are taken in runs of this much text, so that a task's memory does not follow its input.
CHUNK_CHARS = 2_000_000
#: Words whose ids a task keeps; at the limit it starts anew.
KEPT_WORDS = 250_000


def byte_alphabet() -> dict[str, int]:
    """The public byte-to-character rule: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Ranks, ids and bytes of a byte-level BPE file of the tokenizers library."""

    def __init__(self, spec: str) -> None:
        data = json.loads(spec)
        model, letters = data["model"], byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.size = max([*vocab.values(), *self.added.values()], default=-1) + 1
        raw = [b""] * self.size
        for token, i in vocab.items():
            raw[i] = bytes(letters[c] for c in token)
        for token, i in self.added.items():
            raw[i] = token.encode()
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        self.lengths = np.array([len(x) for x in raw], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.byte_ids = np.full(256, -1, np.int64)
        for token, i in vocab.items():
            if len(token) == 1:
                self.byte_ids[letters[token]] = i
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = self.left * self.size + self.right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.words = regex.compile(WORD_PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit integers."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size)
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.arange(1, len(sym) + 1), np.arange(-1, len(sym) - 1)
        after[end[size > 0] - 1] = -1
        before[(end - size)[size > 0]] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray, rank: np.ndarray) -> None:
            known = rank >= 0
            at, rank = at[known], rank[known]
            if len(at) == 0:
                return
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, part in zip(rank[np.r_[0, cut]].tolist(), np.split(at, cut) if len(cut) else [at]):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(active, r)

        first = np.flatnonzero(after >= 0)
        if len(self.keys):
            enter(first, self.ranks(sym[first], sym[first + 1]))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            a, b, c = self.left[r], self.right[r], self.merged[r]
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            nxt = after[at]
            live = (sym[at] == a) & (nxt >= 0)
            live &= sym[nxt] == b
            at, nxt = at[live], nxt[live]
            if a == b and len(at) > 1:  # runs such as "aaa": from the left, without overlap
                at.sort()
                keep, used = [], -1
                for p, q in zip(at.tolist(), after[at].tolist()):
                    if p != used:
                        keep.append(p)
                        used = q
                at = np.array(keep, np.int64)
                nxt = after[at]
            if len(at) == 0:
                continue
            far = after[nxt]
            sym[at], sym[nxt], after[at] = c, -1, far
            right = far >= 0
            before[far[right]] = at[right]
            near = before[at]
            left = near >= 0
            pl, pr = near[left], at[right]
            where = np.concatenate([pl, pr])
            if len(where):
                enter(where, self.ranks(sym[where], np.concatenate([sym[at[left]], sym[far[right]]])))
        kept = sym >= 0
        ids = sym[kept].astype("<i4").tobytes()
        ends = np.concatenate([[0], np.cumsum(kept)])[end].tolist() if len(sym) else [0] * len(words)
        out, start = [], 0
        for stop in ends:
            out.append(ids[4 * start : 4 * stop])
            start = stop
        return out

    def encode_batch(self, texts: list[str], seen: dict[str, bytes]) -> list[bytes]:
        """The ids of each text; seen holds the ids of words met before and is added to."""
        cut = []
        for text in texts:
            if self.cut and self.cut.search(text):
                parts: list[str] = []
                for k, piece in enumerate(self.cut.split(text)):
                    if k % 2:
                        seen[piece] = np.array([self.added[piece]], "<i4").tobytes()
                        parts.append(piece)
                    else:
                        parts += self.words.findall(piece)
                cut.append(parts)
            else:
                cut.append(self.words.findall(text))
        new = list(set().union(*cut).difference(seen))
        if new:
            seen.update(zip(new, self.encode_words([w.encode("utf-8", "replace") for w in new])))
        return [b"".join(map(seen.__getitem__, words)) for words in cut]

    def decode_flat(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of several lists of ids laid end to end; bytes that are no UTF-8 become U+FFFD."""
        size = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(self.starts[ids] - ends[:-1], size) + np.arange(ends[-1])
        raw, cuts = self.flat[take].tobytes(), ends[offsets].tolist()
        return [raw[i:j].decode("utf-8", "replace") for i, j in zip(cuts, cuts[1:])]


@lru_cache(maxsize=2)
def _vocabulary(spec: str) -> Vocabulary:
    return Vocabulary(spec)


def _runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id and `ids` array<int>. The vocabulary file has a fixed size and is broadcast."""
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, seen = _vocabulary(spec.value), {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in _runs([len(t) for t in texts], CHUNK_CHARS):
                if len(seen) > KEPT_WORDS:
                    seen = {}
                coded = vocabulary.encode_batch(texts[i:j], seen)
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in coded])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), ids], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: the id, `ids` as given and `text`, the text that the ids stand for, special tokens included."""
    spark = encoded.sparkSession
    with open(vocabulary_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(spec.value)
        for batch in batches:
            ids = batch.column(1)
            sizes = np.diff(ids.offsets.to_numpy()).tolist()
            for i, j in _runs([4 * n for n in sizes], CHUNK_CHARS):
                part = ids.slice(i, j - i)
                offsets = part.offsets.to_numpy()
                texts = vocabulary.decode_flat(part.flatten().to_numpy(), offsets - offsets[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), part, pa.array(texts, pa.string())], names=[id_col, "ids", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    rows = encoded.select(id_col, F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, text string")


def digests(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Encode and decode every document; token count and the hashes of ids and decoded text."""
    both = decode(encode(docs, vocabulary_path), vocabulary_path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("text"), 256).alias("decoded_sha256"),
    )
