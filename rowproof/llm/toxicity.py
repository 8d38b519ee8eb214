"""Toxicity: a linear classifier whose training penalises score changes when identity terms are swapped.

Features are the distinct words of a whole text and the beginnings of those words. Training minimises
logistic loss + ridge + `swap_penalty` times the mean squared change of the score between labelled texts and their
counterfactuals. A text that names a group has two: one in which every identity term is replaced by the next one of its kind,
and one without any. Every text has a third, in which one more term (by a hash of the text) is mentioned. A group's name, and what it
has in common with other words, can then not carry a label that the rest of the sentence does not earn, be the group
named in the labelled texts or not. The model says how many pairs of each sort changed a feature (`swaps`, `mentions`). `terms` holds the
groups of terms, by default IDENTITY_TERMS for the four languages.

Labels are learned from a bounded sample: `max_toxic` and `max_clean` rows at most, on average, chosen by a hash
of the id; an id with several documents is learned from once, by the first of its texts in order. Features are those in MIN_DOCS
texts of the sample or more whose symmetric divergence between the classes is MIN_GAIN or more (identity terms whatever theirs),
the MAX_FEATURES with most of it: bounds of the model, which weigh no document differently by the size of the table. A score
takes both classes as equally likely beforehand. Feature counts, selection and scoring run on Spark;
the fit itself sees only that sample's selected features. Every document is scored by its whole text.

Defined cases: a null or empty text scores by the intercept alone; ids or labels that are null are not learned from; an id
with several labels counts as toxic if any is 1; without labels of both kinds the score is the base rate (0
without any); an empty table gives no rows; equal texts get equal scores, repeated rows a row each; texts of any length are read
whole; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowproof.llm.common import text_of
from rowproof.session import saved

MAX_TOXIC, MAX_CLEAN = 4000, 8000
MAX_FEATURES, MIN_DOCS, MIN_GAIN = 4000, 3, 12.0
PREFIXES = range(2, 7)
THRESHOLD = 0.7
SWAP_PENALTY = 4.0
KEPT_WORDS = 250_000
Terms = Sequence[Sequence[str]]

# Identity terms by kind, each replaced by the next of its kind; English, French, German, Spanish.
IDENTITY_TERMS = tuple(
    tuple(kind.split())
    for kind in (
        "women men", "woman man", "girls boys", "muslims christians jews hindus buddhists atheists", "muslim christian jewish hindu buddhist atheist",
        "gay straight lesbian bisexual transgender", "black white asian latino arab", "african european american chinese mexican",
        "immigrants citizens refugees", "deaf blind disabled autistic", "old young",
        "femmes hommes", "femme homme", "filles garçons", "musulmans chrétiens juifs hindous bouddhistes athées", "musulman chrétien juif hindou bouddhiste athée",
        "homosexuel hétérosexuel lesbienne bisexuel transgenre", "noirs blancs asiatiques arabes", "africain européen américain chinois mexicain",
        "immigrés citoyens réfugiés", "sourd aveugle handicapé autiste", "vieux jeunes",
        "frauen männer", "frau mann", "mädchen jungen", "muslime christen juden buddhisten atheisten", "muslimisch christlich jüdisch hinduistisch buddhistisch",
        "schwul hetero lesbisch bisexuell", "schwarze weiße asiatische arabische", "afrikaner europäer amerikaner chinesen mexikaner",
        "einwanderer bürger flüchtlinge", "taub behindert autistisch", "alte junge",
        "mujeres hombres", "mujer hombre", "chicas chicos", "musulmanes cristianos judíos hindúes budistas ateos", "musulmán cristiano judío hindú budista ateo",
        "homosexual heterosexual lesbiana transexual", "negros blancos asiáticos árabes", "africanos europeos americanos chinos mexicanos",
        "inmigrantes ciudadanos refugiados", "sordo ciego discapacitado autista", "viejos jóvenes",
    )
)


def next_terms(groups: Terms) -> dict[str, str]:
    """Each term with the next of its kind; a term of several kinds is of the first."""
    out: dict[str, str] = {}
    for group in groups:
        for i, term in enumerate(group):
            out.setdefault(term, group[(i + 1) % len(group)])
    return out


NEXT_TERM = next_terms(IDENTITY_TERMS)

_WORD = re.compile(r"\w+")


def features(words: Iterable[str]) -> set[str]:
    """Words, and beginnings of words (marked ^)."""
    out = set()
    for w in words:
        out.add(w)
        out.update("^" + w[:n] for n in PREFIXES if len(w) > n)
    return out


def words_in(token: str) -> list[str]:
    """The words of a token, which is what stands between white space."""
    return _WORD.findall(token.lower())


def words_of(text: str) -> set[str]:
    return {w for token in set(text.split()) for w in words_in(token)}


def swapped(words: set[str], following: dict[str, str] = NEXT_TERM) -> set[str]:
    """The words after each identity term has become the next of its kind."""
    return {following.get(w, w) for w in words}


def without_terms(words: set[str], following: dict[str, str] = NEXT_TERM) -> set[str]:
    return {w for w in words if w not in following}


def mentioning(words: set[str], following: dict[str, str] = NEXT_TERM) -> set[str]:
    """The words and one term more, chosen by a hash of the words."""
    terms = sorted(following)
    return words | {terms[zlib.crc32(" ".join(sorted(words)).encode()) % len(terms)]} if terms else words


@dataclass
class Model:
    bias: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)
    base_rate: float | None = None
    #: Pairs of texts and counterfactuals that differ in a feature of the model.
    swaps: int = 0
    mentions: int = 0


Pairs = Sequence[tuple[Sequence[int], Sequence[int]]]


class Apart(NamedTuple):
    """What the differing pairs differ in: pair, feature and sign of each difference, and the number of such pairs."""

    row: np.ndarray
    feature: np.ndarray
    sign: np.ndarray
    pairs: int


def _differences(pairs: Pairs) -> Apart:
    apart = [(set(x).difference(y), set(y).difference(x)) for x, y in pairs]
    apart = [(p, m) for p, m in apart if p or m]
    entries = [(i, j, sign) for i, both in enumerate(apart) for part, sign in zip(both, (1.0, -1.0)) for j in sorted(part)]
    row, col, sign = zip(*entries) if entries else ((), (), ())
    return Apart(np.array(row, np.int64), np.array(col, np.int64), np.array(sign, float), len(apart))


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The row and the value of each element of a column of lists."""
    sizes = pc.list_value_length(lists).to_numpy()
    return np.repeat(np.arange(len(sizes)), sizes), pc.list_flatten(lists).to_numpy().astype(np.int64)


def _apart(signed: list[tuple[pa.ChunkedArray, float]], m: int) -> Apart:
    """As _differences, from columns of features with their sign; two columns, lost and gained, are one sort of pairs."""
    parts = [(*_flat(lists), sign, k // 2 * m) for k, (lists, sign) in enumerate(signed)]
    row = np.concatenate([r + base for r, _, _, base in parts])
    pairs, row = np.unique(row, return_inverse=True)
    return Apart(row, np.concatenate([c for _, c, _, _ in parts]), np.concatenate([np.full(len(c), sign) for _, c, sign, _ in parts]), len(pairs))


def fit(
    rows: list[list[int]] | pa.ChunkedArray, pairs: Pairs | Apart, toxic: np.ndarray, n: int, *, swap_penalty: float, mentions: Pairs | Apart = (), ridge: float = 1e-5, steps: int = 1500
) -> tuple[np.ndarray, float]:
    """Weights and intercept for rows of feature numbers; pairs and mentions hold texts and their counterfactuals (equal ones are left out), or their differences.

    Both classes weigh half. The objective is smooth and convex; it is minimised by accelerated gradient steps
    from zero over the full bounded sample, so that the result is repeatable and features that many rows share
    come before those that name a single row.
    """
    at, col = _flat(rows if isinstance(rows, pa.ChunkedArray) else pa.chunked_array([pa.array(rows, pa.list_(pa.int32()))]))
    m, y = len(rows), toxic.astype(float)
    both = [p if isinstance(p, Apart) else _differences(p) for p in (pairs, mentions)]
    apart = [d for d in both if d.pairs] if swap_penalty else []
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    size = np.bincount(at, minlength=m) + 1.0
    # The trace bounds the curvature.
    step = 1 / (0.25 * (share * size).sum() + ridge + sum(2 * swap_penalty * len(d[0]) / d[3] for d in apart))
    w = look = np.zeros(n + 1)
    for t in range(1, steps + 1):
        z = np.bincount(at, look[col], m) + look[n]
        g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) * share
        grad = np.append(np.bincount(col, g[at], n) + ridge * look[:n], g.sum())
        for row, feature, sign, k in apart:
            change = np.bincount(row, sign * look[feature], k)
            grad[:n] += np.bincount(feature, 2 * swap_penalty / k * sign * change[row], n)
        moved = look - step * grad
        look, w = moved + (t - 1) / (t + 2) * (moved - w), moved
    return w[:n], w[n]


def fold(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3, F.lit(0))


def train(docs: DataFrame, labels: DataFrame, *, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, swap_penalty: float = SWAP_PENALTY, terms: Terms = IDENTITY_TERMS) -> Model:
    """Fit on labelled rows outside the held-out fold (crc32 of the id mod 3 is 1)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold() != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = counts.get(1, 0), counts.get(0, 0)
    if not n_toxic or not n_clean:
        return Model(base_rate=float(n_toxic > 0))
    rate = {1: min(1.0, max_toxic / n_toxic), 0: min(1.0, max_clean / n_clean)}
    place = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = known.where(place < F.when(F.col("toxic") == 1, rate[1]).otherwise(rate[0]))
    # The sample is bounded by max_toxic + max_clean rows of two numbers, so that it may be broadcast.
    held = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(picked), "doc_id")
    sample = saved(held.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "toxicity-sample")
    following = next_terms(terms)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[toxic].update(features(words_of(text)))
        names = sorted(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_pydict({"feature": pa.array(names, pa.string()), "clean": [seen[0][x] for x in names], "toxic": [seen[1][x] for x in names]})

    found = sample.select("text", "toxic").mapInArrow(tally, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    totals = {r.toxic: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return Model(base_rate=n_toxic / (n_toxic + n_clean))
    p, q = (F.col("toxic") + 0.5) / (totals[1] + 1.0), (F.col("clean") + 0.5) / (totals[0] + 1.0)
    gain = (p - q) * F.log(p / q) * (2.0 * totals[1] * totals[0] / (totals[1] + totals[0]))
    keep = (F.col("toxic") + F.col("clean") >= MIN_DOCS) & ((gain >= MIN_GAIN) | F.col("feature").isin(*following))
    chosen = [r.feature for r in found.where(keep).orderBy(gain.desc(), "feature").limit(MAX_FEATURES).select("feature").collect()]
    if not chosen:
        return Model(base_rate=n_toxic / (n_toxic + n_clean))
    number = {f: i for i, f in enumerate(chosen)}

    sorts = ("swap_lost", "swap_gained", "plain_lost", "plain_gained", "mention_lost", "mention_gained")

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int32())
        for batch in batches:
            out: list[list[list[int]]] = []
            for text in batch.column("text").to_pylist():
                w = words_of(text)
                x, *others = ({number[f] for f in features(v) if f in number} for v in (w, swapped(w, following), without_terms(w, following), mentioning(w, following)))
                out.append([sorted(x), *(sorted(part) for other in others for part in (x - other, other - x))])
            lists = [pa.array([r[k] for r in out], kind) for k in range(1 + len(sorts))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *lists], names=["doc_id", "toxic", "x", *sorts])

    id_kind, label_kind = (sample.schema[c].dataType.simpleString() for c in ("doc_id", "toxic"))
    rows = sample.select("doc_id", "text", "toxic").mapInArrow(indexed, f"doc_id {id_kind}, toxic {label_kind}, x array<int>, " + ", ".join(f"{c} array<int>" for c in sorts))
    # Bounded as the sample is, and by the selected features; it stays in Arrow's arrays, as Python's lists take ten times as much.
    data = rows.orderBy("doc_id", "x").drop("doc_id").toArrow()
    signed = [(data[c], 1.0 if c.endswith("lost") else -1.0) for c in sorts]
    pairs, mentions = _apart(signed[:4], len(data)), _apart(signed[4:], len(data))
    weights, bias = fit(data["x"], pairs, data["toxic"].to_numpy(), len(chosen), swap_penalty=swap_penalty, mentions=mentions)
    return Model(float(bias), {f: float(w) for f, w in zip(chosen, weights) if abs(w) > 1e-6}, None, pairs.pairs, mentions.pairs)


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """The columns of docs and the score under `name`: every whole text, 0 to 1. The model has at most MAX_FEATURES weights."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scorer(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, hits = shared.value, {}
        number = {f: i for i, f in enumerate(model.weights)}
        weights = np.array([*model.weights.values(), 0.0])
        for texts in parts:
            scores = []
            for text in texts:
                tokens = set(text.split())
                if len(hits) > KEPT_WORDS:
                    hits = {}
                for token in tokens.difference(hits):
                    hits[token] = tuple(number[f] for f in features(words_in(token)) if f in number)
                found = set().union(*filter(None, map(hits.__getitem__, tokens)))
                scores.append(model.bias + weights[sorted(found)].sum() if found else model.bias)
            z = np.clip(np.array(scores, float), -60, 60)
            yield pd.Series(1 / (1 + np.exp(-z)) if model.base_rate is None else np.full(len(z), model.base_rate))

    return docs.withColumn(name, scorer(text_of(text_col)))


def classified(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """Train on the labels, by the options of `train`, and judge every document."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels, **options))
    return scored.select("doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
