"""License scans: phrases by place, and an exact set-similarity join of text blocks with license templates.

DataFrame functions only."""

from __future__ import annotations

import functools
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import scope, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: ASCII other than digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and their labels.
PHRASES: dict[str, str] = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: The notices by which licenses are commonly given, with their labels.
TEMPLATES: list[tuple[str, str]] = [
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]

#: Templates go into plans as literals; more distinct words than this are refused.
MOST_WORDS = 5000


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; null has none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), BETWEEN), lambda w: w != "")


def places(within: Column, phrases: dict[str, str]) -> Column:
    """Array of (at, label) for each place, from 0, where a phrase's words stand consecutively."""
    def of(parts: list[str], label: str) -> Column:
        starts = F.when(F.size(within) >= len(parts), F.sequence(F.lit(0), F.size(within) - len(parts))).otherwise(F.array().cast("array<int>"))
        here = lambda i: functools.reduce(Column.__and__, [F.get(within, i + k) == part for k, part in enumerate(parts)])
        return F.transform(F.filter(starts, here), lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))

    return F.concat(*[of(phrase.split(" "), label) for phrase, label in phrases.items()])


def blocks(within: Column, vocabulary: Column, width: int, stride: int) -> Column:
    """For each run of `width` words that starts at a multiple of `stride`, its distinct words that vocabulary holds, in
    vocabulary's order. Every run of width - stride words lies in one block."""
    n = F.greatest(F.lit(1), F.ceil((F.size(within) - (width - stride)) / stride)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.array_intersect(vocabulary, F.slice(within, b * stride + 1, F.lit(width))))


def scan(
    docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None,
    percent: int = 80, width: int = 64, stride: int = 32, id_col: str = "doc_id",
) -> DataFrame:
    """One row per document: id, n_words, n_base (places of phrases), first_word and last_word (the least and the
    greatest such place), base_labels, labels (with those of templates; distinct, sorted, comma-joined) and score.

    A block meets a template when it holds at least `percent` of the template's distinct words. The words of templates
    are counted over all documents and put into one order, rare ones first; words of no template can't meet one, so
    they need no place in it. A block that meets a template of n words holds at least need = ceil(n * percent / 100) of
    them, so one of the first n - need + 1 words of the template is among the first b - need + 1 of the block's b words
    (prefix filter), b is need at least (length filter), and after the first word in common both still have enough
    words (positional filter). What is left is intersected, so that exactly the blocks that meet a template are found.
    Only documents with a prefix word are cut into blocks; their texts are not moved between tasks.

    score is 1 with a phrase, else the greatest share of a template in a block that meets it, else 0. Defined results:
    null and empty texts have no words, no labels and score 0; null and repeated ids have a row each; an empty table
    gives no rows; other columns are ignored. Counts of templates' words, at most MOST_WORDS, come to the driver."""
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    sets = [(label, sorted(set(text.split(" ")))) for label, text in templates]
    vocabulary = sorted({w for _, s in sets for w in s})
    if len(vocabulary) > MOST_WORDS or not all(w for _, s in sets for w in s):
        raise ValueError(f"templates need words, and at most {MOST_WORDS} different ones")
    literal = lambda ws: F.array(*map(F.lit, ws)).cast("array<string>")
    with scope() as keep:
        texts = docs.select(F.col(id_col), words(F.col("text")).alias("words"))
        held = texts.select(F.explode(F.array_intersect("words", literal(vocabulary))).alias("word")).groupBy("word").count()
        count = Counter({r["word"]: r["count"] for r in held.collect()})
        order = sorted(vocabulary, key=lambda w: (count[w], w))
        place = {w: i for i, w in enumerate(order)}
        index, shapes = [], []
        for no, (label, s) in enumerate(sets):
            ranked, need = sorted(s, key=place.get), max(1, -(-len(s) * percent // 100))
            index += [(w, no, i) for i, w in enumerate(ranked[: len(s) - need + 1])]
            shapes.append((no, label, ranked, len(s), need))
        least = min((need for *_, need in shapes), default=1)

        near = F.arrays_overlap("words", literal(sorted({w for w, _, _ in index})))
        last = literal(sorted({p.split(" ")[-1] for p in phrases}))
        base = F.when(F.arrays_overlap("words", last), places(F.col("words"), phrases)) if phrases else F.lit(None).cast("array<struct<at:bigint,label:string>>")
        rows = written(texts.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.size("words").cast("long").alias("n_words"), F.coalesce(base, F.array().cast("array<struct<at:bigint,label:string>>")).alias("base"), F.when(near, F.col("words")).alias("words")))

        cut = rows.where("words is not null").select("row", F.explode(blocks(F.col("words"), literal(order), width, stride)).alias("block"))
        prefix = cut.where(F.size("block") >= least).select("row", "block", F.posexplode(F.slice("block", F.lit(1), F.size("block") - (least - 1))).alias("at", "word"))
        spark = docs.sparkSession
        asked = spark.createDataFrame(index, "word string, no int, i int").join(spark.createDataFrame(shapes, "no int, label string, template array<string>, n int, need int"), "no")
        after = F.least(F.col("n") - F.col("i"), F.size("block") - F.col("at"))
        met = prefix.join(asked, "word").where((F.size("block") >= F.col("need")) & (F.col("at") <= F.size("block") - F.col("need")) & (after >= F.col("need")))
        met = met.select("row", "label", "n", "need", F.size(F.array_intersect("block", "template")).alias("shared")).where("shared >= need")
        found = met.groupBy("row").agg(F.collect_set("label").alias("found"), F.max(F.col("shared") / F.col("n")).alias("share"))

        both = rows.drop("words").join(found, "row", "left")
        at, own = F.transform("base", lambda p: p["at"]), F.transform("base", lambda p: p["label"])
        joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
        score = F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
        return keep(both.select(F.col("id").alias(id_col), "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), joined(own).alias("base_labels"), joined(F.concat(own, F.coalesce("found", F.array().cast("array<string>")))).alias("labels"), score.alias("score")))


def _oracle(width: int = 64, stride: int = 32, percent: int = 80) -> str:
    """All blocks against all templates."""
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    listed = ", ".join(f"('{label}', {quoted(sorted(set(text.split(' '))))})" for label, text in TEMPLATES)
    place = lambda parts: " AND ".join(f"words[i + {k}] = '{p}'" for k, p in enumerate(parts.split(" "), 1))
    found = " || ".join(f"list_transform(list_filter(range(len(words)), lambda i: {place(p)}), lambda i: {{'at': i, 'label': '{label}'}})" for p, label in PHRASES.items())
    return rf"""
WITH t(label, template) AS (VALUES {listed}),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{BETWEEN}'), lambda w: w <> '') AS words FROM documents),
b AS (SELECT *, {found} AS base FROM d),
k AS (SELECT r, unnest(list_transform(range(CAST(greatest(1, ceil((len(words) - {width - stride}) / {stride}.0)) AS BIGINT)), lambda j: list_distinct(words[j * {stride} + 1 : j * {stride} + {width}]))) AS block FROM d),
m AS (SELECT r, label, len(list_intersect(template, block)) AS shared, len(template) AS n FROM k, t),
f AS (SELECT r, list(DISTINCT label) AS labels, max(shared / CAST(n AS DOUBLE)) AS share FROM m WHERE 100 * shared >= {percent} * n GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(base) AS BIGINT) AS n_base, list_min(list_transform(base, lambda p: p.at)) AS first_word, list_max(list_transform(base, lambda p: p.at)) AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(base, lambda p: p.label))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(list_transform(base, lambda p: p.label), coalesce(f.labels, [])))), ',') AS labels,
  CASE WHEN len(base) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM b LEFT JOIN f USING (r)
"""


ORACLE_SQL = _oracle()
