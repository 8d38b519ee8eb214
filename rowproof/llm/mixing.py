"""Mixing sources to target weights by iterative proportional fitting, on DataFrame functions alone.

Documents fall into cells of source, language and topic. Topics come from the texts: every language has TOPICS key words, found by their
counts over all words of all documents (`key_table`), and a document's topic is the number of the one it says most often. (Words that name a
topic in one language only would tie topics to languages, so that targets for both could not be met.) `topic` takes any other column, such as
`form_of`, a text's form. The cells' token weights are raked: each sweep scales them to the
target of every source, then of every language, then of every topic, until no scale moves by more than `tolerance`.
A cell's calibrated weight over its tokens, times one scale and one at most, is the probability that each of its
documents is sampled with. The scale is solved on the cells so that the sample's expected tokens are `budget` times the table's: a sparse cell
whose probability reaches one is clipped there, and what it lacks of its weight (`shortfalls`) is made up by the others, so that
a rare value costs other cells nothing. Without clipped cells the sample has the target marginals. `budget` None takes
the largest scale that clips no cell: there the sparsest cell sets the size of the sample. The draw
is a hash of the id: repeatable, and independent of partitions.

Targets are shares by value; where none are given, each value's share is its corpus share to the power `flatten`,
scaled to one. Only cells are shuffled, after partial sums; documents meet them in one join, broadcast if the written
table of cells is small.

Defined cases: a null source, language or topic is the value (none); a null text has the weight of one token; rows without an
id are drawn by the text "null"; repeated ids share one draw; values without a given target get weight zero and
are not sampled; targets for absent values are left out and the rest scaled to one; targets that the cells cannot meet within MAX_OFF raise
ValueError where they were given, and warn where they are the default shares; an empty table gives no rows; texts are read whole; extra
columns are carried, whatever their names.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowproof.llm.common import unused
from rowproof.session import saved

FLATTEN, TOLERANCE, MAX_SWEEPS = 0.8, 1e-10, 40
#: Sweeps of one plan: three windows each.
PLAN_SWEEPS = 5
#: Expected tokens of the sample, as a share of the table's.
BUDGET = 0.5
DIMENSIONS = ("source", "lang", "topic")
NONE, OTHER = "(none)", "(other)"
#: Topics of a language, and which words can name them: letters at least, and one in how many of the language's texts has to say them at least and may at most.
TOPICS, LEAST_LETTERS, RARE, COMMON = 8, 4, 50, 5
UPPER, WORD, WORD_BREAK, TOKEN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]+", r"[^ \t\n\r]+"
#: How far a marginal may be from its target, relative to it, before raking counts as failed.
MAX_OFF = 0.01


def words_of(text: Column, least: int = LEAST_LETTERS) -> Column:
    """The words of a text of `least` letters or more: A-Z in lower case, cut at anything but letters and digits."""
    t = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(t) == F.length(t)  # there lower does no more than translate, and faster
    low = F.when(ascii_only, F.lower(t)).otherwise(F.translate(t, UPPER, UPPER.lower()))
    return F.regexp_extract_all(low, F.lit(f"{WORD}{{{least},}}"), F.lit(0))


def form_of(text: Column) -> Column:
    """A topic by form: tables, short notes, articles, long reads."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.contains(t, F.lit(" | ")), "table").when(F.length(t) < 500, "note").when(F.length(t) < 5000, "article").otherwise("long read")


Names = dict[str, list[str]]


def key_table(docs: DataFrame, topics: int = TOPICS) -> DataFrame:
    """The words that tell the topics of each language, lang, keys and all keys as one text: of those in some but not in most of its texts, those in most texts.

    Every text of docs is read and every language has its own; written.
    """
    held = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("lang"), "text")
    sizes = saved(held.groupBy("lang").agg(F.count("*").alias("of")), "languages")
    # The outer form, as for the other Spark cuts the texts a second time to test for empty arrays.
    found = held.select("lang", F.explode_outer(F.array_distinct(words_of(F.col("text")))).alias("w")).where("w IS NOT NULL").groupBy("lang", "w").agg(F.count("*").alias("n"))
    found = found.join(sizes, "lang").where(F.col("n") * RARE >= F.col("of")).where(F.col("n") * COMMON <= F.col("of"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "w"))
    first = found.select("lang", "w", place.alias("place")).where(F.col("place") <= topics)
    keys = F.transform(F.array_sort(F.collect_list(F.struct("place", "w"))), lambda x: x["w"])
    return saved(first.groupBy("lang").agg(keys.alias("keys")).withColumn("joined", F.array_join("keys", " ")), "keys")


def key_words(docs: DataFrame, topics: int = TOPICS) -> Names:
    """`key_table` on the driver, for tables of few languages."""
    return {r.lang: r["keys"] for r in key_table(docs, topics).collect()}


def _topic(text: Column, keys: Column, joined: Column, least: int = LEAST_LETTERS) -> Column:
    """The number of the key word that a text says most often, the first on ties; OTHER if it says none or keys is null."""
    said = F.filter(words_of(text, least), lambda w: F.contains(joined, w) & F.array_contains(keys, w))  # most words fail the first test, which is the faster one

    def best(said: Column) -> Column:
        times = F.transform(keys, lambda k, i: F.struct(F.size(F.filter(said, lambda w: w == k)).alias("n"), (-1 - i).alias("place")))
        return F.concat(F.lit("topic "), (-F.array_max(times)["place"]).cast("string"))

    one = F.transform(F.array(said), lambda x: F.when(F.size(x) > 0, best(x)))  # said is cut once
    return F.coalesce(F.get(F.when(keys.isNotNull(), one), F.lit(0)), F.lit(OTHER))


def topic_of(text: Column, lang: Column, names: Names) -> Column:
    """The number of the key word of its language that a text says most often, the first on ties; OTHER if it says none."""
    if not names:
        return F.lit(OTHER)
    keys = F.create_map(*[x for name, words in names.items() for x in (F.lit(name), F.array(*map(F.lit, words)))])
    mine = F.try_element_at(keys, F.coalesce(lang, F.lit(NONE)))
    return _topic(text, mine, F.array_join(mine, " "), min((len(w) for words in names.values() for w in words), default=1))


def tokens_of(text: Column) -> Column:
    """Token weight: the words between white space, one at least."""
    return F.greatest(F.lit(1).cast("long"), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN)).cast("long"))


def draw(id_col: Column) -> Column:
    """A number in [0, 1) that depends on the id alone: 52 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("null"))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _celled(docs: DataFrame, topic: Column | None, cell: str, tokens: str) -> DataFrame:
    """docs with the cell and the tokens of each row; the key words of its language meet a row in one join, broadcast if the written table of them is small."""
    text, lang, columns = F.col("text"), F.col("lang").cast("string"), [f"`{c}`" for c in docs.columns]
    if topic is None:
        keys, joined, of = unused(docs, "_keys", "_joined", "_of")
        words = key_table(docs).select(F.col("lang").alias(of), F.col("keys").alias(keys), F.col("joined").alias(joined))
        docs, topic = docs.join(words, F.coalesce(lang, F.lit(NONE)) == F.col(of), "left"), _topic(text, F.col(keys), F.col(joined))
    named = {"source": F.col("source").cast("string"), "lang": lang, "topic": topic}
    return docs.select(*columns, F.struct(*[F.coalesce(v, F.lit(NONE)).alias(k) for k, v in named.items()]).alias(cell), tokens_of(text).alias(tokens))


def _aimed(cells: DataFrame, targets: dict[str, DataFrame] | None, flatten: float) -> DataFrame:
    """The cells with the tokens that each of their values is to have, aim_source, aim_lang and aim_topic; written."""
    cells = cells.select(*DIMENSIONS, F.col("tokens").cast("double").alias("tokens"))
    for d in DIMENSIONS:
        if targets and d in targets:
            given = targets[d].select(F.col("value").alias(d), F.col("share").cast("double").alias(f"share_{d}"))
            cells = cells.join(given, d, "left").withColumn(f"share_{d}", F.coalesce(f"share_{d}", F.lit(0.0)))
        else:
            cells = cells.withColumn(f"share_{d}", F.pow(F.sum("tokens").over(Window.partitionBy(d)), F.lit(flatten)))
        cells = cells.withColumn(f"cells_{d}", F.count("*").over(Window.partitionBy(d)))
    cells = saved(cells, "cells")
    sums = cells.agg(F.sum("tokens"), *[F.sum(F.col(f"share_{d}") / F.col(f"cells_{d}")) for d in DIMENSIONS]).first()
    whole, *scales = [x or 0.0 for x in sums]
    return cells.select(*DIMENSIONS, "tokens", *[(F.col(f"share_{d}") / F.lit(scale or 1.0) * F.lit(whole)).alias(f"aim_{d}") for d, scale in zip(DIMENSIONS, scales)])


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, flatten: float = FLATTEN, tolerance: float = TOLERANCE, max_sweeps: int = MAX_SWEEPS) -> DataFrame:
    """cells (source, lang, topic, tokens) with `weight` raked to the targets (value, share) of each dimension.

    Each step is a window over the cells of a value; PLAN_SWEEPS sweeps are one plan and one written table.
    """
    cells = _aimed(cells, targets, flatten).withColumn("weight", F.col("tokens"))
    done = 0
    while done < max_sweeps:
        for _ in range(min(PLAN_SWEEPS, max_sweeps - done)):
            done, moved = done + 1, F.lit(0.0)
            cells = cells.withColumn("moved", moved)
            for d in DIMENSIONS:
                cells = cells.withColumn("have", F.sum("weight").over(Window.partitionBy(d)))
                cells = cells.withColumn("scale", F.when(F.col("have") > 0, F.col(f"aim_{d}") / F.col("have")).otherwise(0.0)).withColumn("weight", F.col("weight") * F.col("scale"))
                cells = cells.withColumn("moved", F.greatest("moved", F.when(F.col("weight") > 0, F.abs(F.col("scale") - 1)).otherwise(0.0)))
        cells = saved(cells.drop("have", "scale"), "raked")
        if (cells.agg(F.max("moved")).first()[0] or 0.0) <= tolerance:
            return cells.select(*DIMENSIONS, "tokens", "weight")
    missed = unmet(cells)
    if missed:
        text = f"targets not met after {max_sweeps} sweeps: " + "; ".join(f"{d} {value!r} has {have:.6g} of {aim:.6g} tokens" for d, value, have, aim in missed[:5])
        if targets:
            raise ValueError(text)
        warnings.warn(text, stacklevel=2)
    return cells.select(*DIMENSIONS, "tokens", "weight")


def unmet(cells: DataFrame) -> list[tuple[str, str, float, float]]:
    """(dimension, value, weight, target) of the marginals that are MAX_OFF or more from their target, the worst first: a row a value at most."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col(d).alias("value"), F.col(f"aim_{d}").alias("aim")) for d in DIMENSIONS]))
    sums = cells.select("weight", each.alias("x")).groupBy("x.d", "x.value").agg(F.sum("weight").alias("have"), F.first("x.aim").alias("aim"))
    out = [(r.d, r.value, r.have, r.aim) for r in sums.where(F.abs(F.col("have") - F.col("aim")) > MAX_OFF * F.col("aim")).collect()]
    return sorted(out, key=lambda x: -abs(x[2] - x[3]) / x[3] if x[3] else 0.0)


def scale_for(raked: DataFrame, budget: float | None) -> float:
    """The factor from a cell's weight / tokens to its probability, for raked cells.

    Expected tokens are concave in the scale, so that Newton steps from below end on the budget after finitely many;
    each is one aggregate over the cells.
    """
    if budget is None:
        return 1.0 / (raked.agg(F.max(F.col("weight") / F.col("tokens"))).first()[0] or 1.0)
    whole, weight = raked.agg(F.sum("tokens"), F.sum("weight")).first()
    if not weight:
        return 0.0
    scale, clipped = budget * whole / weight, 0
    while True:
        full = F.lit(scale) * F.col("weight") >= F.col("tokens")
        n, held, free = raked.agg(F.count_if(full), F.sum(F.when(full, F.col("tokens")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if n == clipped or not free:
            return scale
        scale, clipped = max(scale, (budget * whole - held) / free), n


def _rates(held: DataFrame, cell: str, tokens: str, targets: dict[str, DataFrame] | None, flatten: float, budget: float | None) -> DataFrame:
    """The raked cells with `wanted`, the tokens that the scale asks of each, and `rate`, its probability."""
    raked = rake(held.groupBy(F.col(cell).alias("cell")).agg(F.sum(tokens).alias("tokens")).select("cell.*", "tokens"), targets, flatten)
    scale = F.lit(scale_for(raked, budget))
    quotient = F.col("weight") / F.col("tokens")
    return saved(raked.select(*DIMENSIONS, "tokens", (F.col("weight") * scale).alias("wanted"), F.least(F.lit(1.0), quotient * scale).alias("rate")), "rates")


def probabilities(docs: DataFrame, cell: str, tokens: str, p: str, targets: dict[str, DataFrame] | None = None, topic: Column | None = None, flatten: float = FLATTEN, budget: float | None = BUDGET) -> DataFrame:
    """docs with three more columns under the given names: the cell, the tokens and the sampling probability."""
    return _rated(_celled(docs, topic, cell, tokens), cell, tokens, p, targets, flatten, budget)


def _rated(held: DataFrame, cell: str, tokens: str, p: str, targets: dict[str, DataFrame] | None = None, flatten: float = FLATTEN, budget: float | None = BUDGET) -> DataFrame:
    (of,) = unused(held, "_of")
    rates = _rates(held, cell, tokens, targets, flatten, budget).select(F.struct(*DIMENSIONS).alias(of), F.col("rate").alias(p))
    return held.join(rates, held[cell] == rates[of]).drop(of)


def shortfalls(docs: DataFrame, targets: dict[str, DataFrame] | None = None, topic: Column | None = None, flatten: float = FLATTEN, budget: float | None = BUDGET) -> DataFrame:
    """The clipped cells: tokens, the tokens wanted of each, and the shortfall between them."""
    cells = _rates(_celled(docs, topic, "cell", "n"), "cell", "n", targets, flatten, budget)
    return cells.where("wanted > tokens").select(*DIMENSIONS, "tokens", "wanted", (F.col("wanted") - F.col("tokens")).alias("shortfall"))


def sampled(docs: DataFrame, **options) -> DataFrame:
    """The documents drawn, with the columns of docs."""
    cell, tokens, p = unused(docs, "_cell", "_tokens", "_p")
    return probabilities(docs, cell, tokens, p, **options).where(draw(F.col("doc_id")) < F.col(p)).select(*[f"`{c}`" for c in docs.columns])


def report(docs: DataFrame, topic: Column | None = None, **options) -> DataFrame:
    """Every document with its cell, tokens, probability and whether it is drawn; cells and tokens are written, so that texts are cut into words for them once."""
    held = saved(_celled(docs.select("doc_id", "text", "source", "lang"), topic, "cell", "tokens").drop("text", "source", "lang"), "celled")
    rows = _rated(held, "cell", "tokens", "p", **options)
    return rows.select("doc_id", "cell.*", "tokens", F.round("p", 6).alias("p"), (draw(F.col("doc_id")) < F.col("p")).alias("kept"))


def oracle(sweeps: int = MAX_SWEEPS) -> str:
    """The same in SQL, with the sweeps written out."""
    cut = "coalesce(text, '')"
    draws = "CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0"
    words = f"string_split_regex(translate({cut}, '{UPPER}', '{UPPER.lower()}'), '{WORD_BREAK}')"
    sql = [
        f"said AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text, source, coalesce(lang, '{NONE}') AS lang, {words} AS words FROM documents)",
        "held AS MATERIALIZED (SELECT lang, count(*) AS m FROM said GROUP BY lang)",
        f"often AS (SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(list_distinct(words)) AS w FROM said) WHERE length(w) >= {LEAST_LETTERS} GROUP BY lang, w)",
        f"named AS MATERIALIZED (SELECT lang, w, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS i FROM often JOIN held USING (lang) WHERE n * {RARE} >= m AND n * {COMMON} <= m QUALIFY i <= {TOPICS})",
        "hit AS (SELECT r, i, count(*) AS n FROM (SELECT r, lang, unnest(words) AS w FROM said) JOIN named USING (lang, w) GROUP BY ALL)",
        "topic AS (SELECT r, 'topic ' || i AS w FROM hit QUALIFY row_number() OVER (PARTITION BY r ORDER BY n DESC, i) = 1)",
        f"doc AS MATERIALIZED (SELECT doc_id, coalesce(source, '{NONE}') AS source, lang, coalesce(w, '{OTHER}') AS topic, "
        f"greatest(1, len(regexp_extract_all({cut}, '{TOKEN}'))) AS tokens FROM said LEFT JOIN topic USING (r))",
        "cell AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM doc GROUP BY ALL)",
    ]
    for d in DIMENSIONS:
        sql.append(f"share_{d} AS (SELECT {d}, pow(sum(tokens) / (SELECT sum(tokens) FROM cell), {FLATTEN}) AS share FROM cell GROUP BY {d})")
        sql.append(f"aim_{d} AS MATERIALIZED (SELECT {d}, share / (SELECT sum(share) FROM share_{d}) * (SELECT sum(tokens) FROM cell) AS aim FROM share_{d})")
    at = "(SELECT *, tokens AS weight FROM cell)"
    for k in range(sweeps):
        for d in DIMENSIONS:
            name = f"w{k}_{d}"
            sql.append(f"{name} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, tokens, weight * aim / have AS weight FROM {at} c JOIN (SELECT {d}, sum(weight) AS have FROM {at} x GROUP BY {d}) h USING ({d}) JOIN aim_{d} USING ({d}))")
            at = name
    # Expected tokens are the least of the lines that clip the k cells of the smallest quotients, so that the greatest scale of these lines meets the budget.
    scale = (
        f"SELECT max((budget - clipped) / left_over) FROM (SELECT {BUDGET} * sum(tokens) OVER () AS budget, coalesce(sum(tokens) OVER before, 0) AS clipped, "
        f"sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS left_over FROM {at} WHERE weight > 0 WINDOW before AS (ORDER BY tokens / weight, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
    )
    return (
        "WITH "
        + ",\n".join(sql)
        + f",\nrate AS (SELECT source, lang, topic, least(1.0, weight / tokens * ({scale})) AS p FROM {at})\n"
        + f"SELECT doc_id, source, lang, topic, tokens, round(p, 6) AS p, {draws} < p AS kept FROM doc JOIN rate USING (source, lang, topic)"
    )
