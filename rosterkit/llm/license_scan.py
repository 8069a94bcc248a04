"""License scans with a positional rare-token index, in DataFrame functions only.

A template is a short run of licence words with a label and the key phrases
(runs inside it) that must stand word for word.  One pass over the corpus
counts in how many texts each licence word occurs; per template the
``ANCHORS`` rarest words (highest IDF) are its postings: word and offset.

A text's places for a template are the positions of its rarest word minus
that word's offset, intersected with those of the next rare words at their
own relative offsets.  A place holds if its key phrases stand there and the
IDF weight of the template words found in place reaches the template's
share.  Both passes read the texts and shuffle nothing but one count per
licence word; the table of counts has one row per template word.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANCHORS = 2


@dataclass(frozen=True)
class Template:
    """``words`` at consecutive offsets; ``keys``: (offset, length) of the mandatory phrases."""

    label: str
    text: str
    keys: tuple[tuple[int, int], ...]
    share: float = 0.7
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()


def phrase(label: str, text: str) -> Template:
    return Template(label, text, ((0, len(text.split())),), 1.0, True)


# The phrases and labels that must be found.
BASE = (
    phrase("gpl", "gnu general public license"),
    phrase("apache", "apache license"),
    phrase("cc-by", "cc by"),
    phrase("mit", "mit license"),
)

#: Labels of the method's own, beside the base ones.
MORE = (
    Template("gpl-3.0", "gnu general public license version 3", ((0, 4), (4, 2)), 0.9),
    Template("gpl-2.0", "gnu general public license version 2", ((0, 4), (4, 2)), 0.9),
    Template("lgpl", "gnu lesser general public license", ((0, 5),), 1.0),
    Template("apache-2.0", "licensed under the apache license version 2 0", ((3, 2), (5, 3)), 0.6),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ((2, 3),), 0.5),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ((2, 3),), 0.5),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this "
             "software and associated documentation files", ((0, 7), (8, 4)), 0.7),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are "
             "permitted provided that the following conditions are met", ((0, 3), (4, 4)), 0.7),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or "
             "without fee is hereby granted", ((0, 5), (7, 3)), 0.7),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ((6, 3),), 0.7),
    Template("all-rights-reserved", "all rights reserved", ((0, 3),), 1.0),
)


def _words(text: Column) -> Column:
    """Words of the text with A-Z lower-cased.

    ``lower`` is the fast way; the two letters beyond ASCII whose lower case
    has an ASCII letter in it are first replaced by another such letter, so
    no word changes its borders and no ASCII word appears.
    """
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("é")),
                      F.lit("İ"), F.lit("é"))
    return F.regexp_extract_all(F.lower(plain), F.lit(WORD), F.lit(0))


def word_idf(docs: DataFrame, text_col: str, templates) -> dict[str, float]:
    """IDF of every template word over all texts: ln((N + 1) / (df + 1)) + 1."""
    vocabulary = sorted({w for t in templates for w in t.words})
    known = F.array(*[F.lit(w) for w in vocabulary])
    # a word that never occurs counts zero texts; the empty word counts the texts
    counts = {r["w"]: r["n"] for r in docs.select(_words(F.col(text_col)).alias("_w")).select(
        F.explode(F.concat(F.array(F.lit("")), F.array_intersect("_w", known))).alias("w"))
        .groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = counts.get("", 0)
    return {w: math.log((total + 1) / (counts.get(w, 0) + 1)) + 1 for w in vocabulary}


def anchors(template: Template, idf: dict[str, float], count: int = ANCHORS) -> list[int]:
    """Offsets of the template's rarest words, rarest first; ties by offset."""
    words = template.words
    return sorted(range(len(words)), key=lambda j: (-round(idf[words[j]], 9), j))[:count]


def _places(template: Template, idf: dict[str, float], words: Column, hits: Column) -> Column:
    tokens, rare = template.words, anchors(template, idf)
    first, rest = rare[0], rare[1:]

    def stands(j: int, start: Column) -> Column:
        return F.coalesce(F.get(words, start + j) == tokens[j], F.lit(False))

    def at(start: Column) -> Column:
        found = sum((F.when(stands(j, start), F.lit(idf[w])).otherwise(F.lit(0.0)) for j, w in enumerate(tokens)),
                    F.lit(0.0))
        keys = F.lit(True)
        for offset, length in template.keys:
            for j in range(offset, offset + length):
                keys = keys & stands(j, start)
        share = F.least(F.lit(1.0), found / F.lit(sum(idf[w] for w in tokens)))
        return F.struct(F.lit(template.label).alias("label"), F.lit(template.base).alias("base"),
                        start.cast("long").alias("start"), share.alias("share"),
                        (keys & (share >= F.lit(template.share - 1e-9))).alias("holds"))

    starts = F.transform(F.filter(hits, lambda x: x["w"] == tokens[first]), lambda x: x["i"] - first)
    for j in rest:
        starts = F.filter(starts, partial(stands, j))
    return F.transform(starts, at)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more=MORE) -> DataFrame:
    """Per row: id, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``, ``places``.

    Places are (label, base, start word, share, holds).  ``score`` is the
    largest share of a template's weight found at a place, 0 without one.
    Null and empty texts have no words and no label; other columns are not
    looked at.
    """
    templates = [*BASE, *more]
    idf = word_idf(docs, text_col, templates)
    rare = sorted({t.words[anchors(t, idf)[0]] for t in templates})
    df = docs.select(F.col(id_col).alias("_id"), _words(F.col(text_col)).alias("_w"))
    known = F.array(*[F.lit(w) for w in rare])
    df = df.withColumn("_hits", F.when(F.arrays_overlap("_w", known), F.filter(
        F.transform("_w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(rare)))
        .otherwise(F.expr("cast(array() as array<struct<w:string,i:int>>)")))
    found = F.concat(*[_places(t, idf, F.col("_w"), F.col("_hits")) for t in templates])
    none = F.expr("cast(array() as array<struct<label:string,base:boolean,start:bigint,share:double,holds:boolean>>)")
    df = df.withColumn("places", F.when(F.size("_hits") > 0, found).otherwise(none))
    df = df.withColumn("_base", F.filter("places", lambda x: x["base"] & x["holds"]))

    def labels(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda x: x["label"]))), ",")

    return df.select(
        F.col("_id").alias(id_col), F.size("_w").cast("long").alias("n_words"),
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda x: x["start"])).alias("first_word"),
        F.array_max(F.transform("_base", lambda x: x["start"])).alias("last_word"),
        labels(F.col("_base")).alias("base_labels"),
        labels(F.filter("places", lambda x: x["holds"])).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("places", lambda x: x["share"])), F.lit(0.0)), 6).alias("score"),
        "places")
