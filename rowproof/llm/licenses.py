"""License scan: base phrases, and an exact set-similarity join of text blocks with license templates, on DataFrame functions alone.

A block is a line (`break_at` takes another pattern, such as blank lines for wrapped notices). A block has a template's license if it holds THRESHOLD percent of
the template's distinct words: word sets, not shingles; at a lower share a template of five words would match without the license's own name. Blocks are found by:

* Order: a first pass counts the blocks that hold each word of the templates, summed before the shuffle. Words are ordered from the rarest on; the counts
  that come to the driver are as many as the templates have words.
* Prefix filter: to hold `need` of n words a block has to hold one of the n - need + 1 rarest. Texts and blocks without any such word end here.
* Length filter: a block of fewer than `need` distinct words is out.
* Positional filter: after the first common word at places i and j of template and block, 1 + min(n - i, m - j) words can be common at most,
  of the template's n and the block's m words that templates know.
* What is left is counted word by word, so that no block that meets the threshold is lost and none below it is found.

The templates are a literal of bounded size and meet each text where it is read: nothing but word counts is shuffled, and no text is held against a template of
which it has no rare word. Base phrases are places where the phrase's words follow each other, also across lines.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower case. Defined cases: a null text is empty and has no words; an empty or blank text has
score 0 and no labels; repeated rows and ids are documents of their own; of ties in the order the smaller word comes first; an empty table gives no rows; texts of any
length are read whole; extra columns are left out by `report` and carried by `scanned`, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowproof.llm.common import unused

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Percent of a template's words that a block has to hold.
THRESHOLD = 90
LINE = "\n"
# The base phrases with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Openings of public license texts, and the lines that name a license.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
)


@dataclass(frozen=True)
class Template:
    """Distinct words from the rarest on; a block has to hold `need` of them."""

    label: str
    words: tuple[str, ...]
    need: int

    @property
    def prefix(self) -> tuple[str, ...]:
        return self.words[: len(self.words) - self.need + 1]


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def words_of(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def _words(values) -> Column:
    return F.array(*map(F.lit, values))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def frequencies(docs: DataFrame, text: str, vocabulary: list[str], break_at: str = LINE) -> dict[str, int]:
    """How many blocks of all documents hold each word of the vocabulary."""
    held = docs.select(F.explode(F.split(lowered(F.col(text)), break_at, -1)).alias("block"))
    said = held.select(F.explode(F.array_intersect(_words(vocabulary), words_of(F.col("block")))).alias("word"))
    return dict.fromkeys(vocabulary, 0) | {r.word: r["n"] for r in said.groupBy("word").agg(F.count("*").alias("n")).collect()}


def ordered(templates: tuple[tuple[str, str], ...], order: list[str], threshold: int = THRESHOLD) -> list[Template]:
    place, found = {w: i for i, w in enumerate(order)}, []
    for label, text in templates:
        words = sorted(set(text.split()), key=place.get)
        found.append(Template(label, tuple(words), -(-threshold * len(words) // 100)))
    return found


def _match(template: Template, size: Column, known: Column) -> Column:
    """The number of the template's words in a block, null if under its need; known are the block's words that templates know, from the rarest on."""
    n, words = len(template.words), _words(template.words)
    first = F.element_at(F.array_intersect(_words(template.prefix), known), 1)
    possible = 1 + F.least(n - F.array_position(words, first), F.size(known) - F.array_position(known, first))
    common = F.size(F.array_intersect(words, known))
    screened = (size >= template.need) & F.arrays_overlap(_words(template.prefix), known) & (possible >= template.need)
    return F.when(screened & (common >= template.need), common)


def matches(low: Column, text: Column, templates: list[Template], order: list[str], break_at: str = LINE) -> Column:
    """An array of (block, text, label, share): the blocks of a text that meet a template, by number from 0; `order` has all words of the templates, from the rarest on."""
    rare = sorted({w for t in templates for w in t.prefix})
    # Any rare word as a piece of the text, which is quicker to tell than its words.
    some = lambda c: reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in rare])
    blocks = F.arrays_zip(F.split(low, break_at, -1).alias("low"), F.split(text, break_at, -1).alias("text"))
    numbered = F.filter(F.transform(blocks, lambda b, i: F.struct(i.cast("long").alias("block"), b["low"].alias("low"), b["text"].alias("text"))), lambda b: some(b["low"]))
    none = F.array().cast("array<struct<block:bigint,text:string,label:string,share:double>>")

    def of_block(b: Column) -> Column:
        def held(words: Column) -> Column:
            def met(known: Column) -> Column:
                each = [F.struct(b["block"].alias("block"), b["text"].alias("text"), F.lit(t.label).alias("label"), (_match(t, F.size(words), known).cast("double") / len(t.words)).alias("share")) for t in templates]
                return F.filter(F.array(*each), lambda m: m["share"].isNotNull())

            return _let(F.array_intersect(_words(order), words), met)

        return _let(F.array_distinct(words_of(b["low"])), held)

    return F.when(some(low), F.flatten(F.transform(numbered, of_block))).otherwise(none)


def places(words: Column, phrase: str) -> Column:
    """The starts of a phrase among words, from 0."""
    said = phrase.split()
    starts = F.when(F.size(words) >= len(said), F.sequence(F.lit(0), F.size(words) - len(said))).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == w for k, w in enumerate(said)]))


def scanned(docs: DataFrame, text: str = "text", templates=TEMPLATES, phrases=PHRASES, threshold: int = THRESHOLD, break_at: str = LINE) -> tuple[DataFrame, dict[str, str]]:
    """docs with three more columns, and their names: n_words, base (label, place) and blocks (block, text, label, share)."""
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    counts = frequencies(docs, text, vocabulary, break_at)
    order = sorted(vocabulary, key=lambda w: (counts[w], w))
    found = ordered(templates, order, threshold)
    low, held, n, base, blocks = unused(docs, "_low", "_said", "n_words", "base", "blocks")
    may = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.contains(low, F.lit(w)) for w in p.split()]) for p, _ in phrases])
    none = F.array().cast("array<struct<label:string,place:int>>")
    rows = docs.withColumn(low, lowered(F.col(text))).withColumn(held, F.when(may, words_of(F.col(low))))
    named = lambda label: lambda i: F.struct(F.lit(label).alias("label"), i.alias("place"))
    each = [F.transform(places(F.col(held), p), named(label)) for p, label in phrases]
    rows = rows.withColumns({
        n: F.regexp_count(low, F.lit(WORD)).cast("long"), base: F.when(F.col(held).isNotNull(), F.flatten(F.array(*each))).otherwise(none),
        blocks: matches(F.col(low), F.coalesce(F.col(text), F.lit("")), found, order, break_at),
    })
    return rows.drop(low, held), {"n_words": n, "base": base, "blocks": blocks}


def report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: counts and places of base phrases, labels and the score: 1 with a base phrase, else the best share of a matching template, else 0."""
    rows, names = scanned(docs.select("doc_id", "text"), **options)
    base, blocks = F.col(names["base"]), F.col(names["blocks"])
    labels, starts = F.transform(base, lambda x: x["label"]), F.transform(base, lambda x: x["place"])
    listed = lambda *c: F.array_join(F.array_sort(F.array_distinct(F.concat(*c))), ",")
    share = F.coalesce(F.array_max(F.transform(blocks, lambda x: x["share"])), F.lit(0.0))
    return rows.select(
        "doc_id", F.col(names["n_words"]).alias("n_words"), F.size(base).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        listed(labels).alias("base_labels"), listed(labels, F.transform(blocks, lambda x: x["label"])).alias("labels"), F.when(F.size(base) > 0, 1.0).otherwise(share).alias("score"),
    )


def oracle(threshold: int = THRESHOLD) -> str:
    """The same in SQL, with every block held against every template."""
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = ", ".join(f"('{label}', {listed(sorted(set(text.split())))})" for label, text in TEMPLATES)
    found = []
    for phrase, label in PHRASES:
        said = phrase.split()
        same = " AND ".join(f"words[i + {k + 1}] = '{w}'" for k, w in enumerate(said))
        found.append(f"list_transform(list_filter(range(0, greatest(0, CAST(len(words) AS BIGINT) - {len(said) - 1})), lambda i: {same}), lambda i: struct_pack(label := '{label}', place := i))")
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS low FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(low, '{WORD}') AS words FROM d),
b AS (SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n_words, list_concat({found[0]}, list_concat({found[1]}, {found[2]})) AS base FROM w),
t(label, words) AS (VALUES {rows}),
line AS (SELECT r, list_distinct(regexp_extract_all(x, '{WORD}')) AS held FROM (SELECT r, unnest(string_split(low, chr(10))) AS x FROM d)),
met AS (SELECT r, label, max(n / CAST(len(words) AS DOUBLE)) AS share FROM (SELECT r, label, words, len(list_intersect(held, words)) AS n FROM line CROSS JOIN t) WHERE 100 * n >= {threshold} * len(words) GROUP BY r, label),
m AS (SELECT r, list(label) AS found, max(share) AS share FROM met GROUP BY r)
SELECT doc_id, n_words, CAST(len(base) AS BIGINT) AS n_base, CAST(list_min(list_transform(base, lambda x: x.place)) AS BIGINT) AS first_word, CAST(list_max(list_transform(base, lambda x: x.place)) AS BIGINT) AS last_word,
       array_to_string(list_sort(list_distinct(list_transform(base, lambda x: x.label))), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(list_transform(base, lambda x: x.label), coalesce(found, [])))), ',') AS labels,
       CASE WHEN len(base) > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score
FROM b LEFT JOIN m USING (r)"""
