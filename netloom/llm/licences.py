"""Licence scans through a positional index of rare words, with DataFrame functions only.

Every notice in NOTICES is a template of words, some of them mandatory (its key phrase). Document frequencies of the
templates' words are counted over all documents; the words of highest inverse document frequency of each template form
the index: word -> (template, place). A document's places of a template's indexed words, each less the word's place in the
template, are intersected: what is left are the starts at which all of them stand at their relative places. A start
counts if the template's mandatory words stand exactly there and at least MATCH of its weight (inverse document
frequencies) agrees place by place. Indexed words are the rarest of the mandatory ones, so the intersection loses none. Besides, the base phrases are counted at every place.

Null texts are empty, without words. Places overlap freely and are all counted. An empty table gives no rows. Extra
columns are ignored. score is the largest agreeing share of any candidate whose mandatory words stand, 1 for a base
phrase, else 0.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels (fixed values).
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices in their public wording, as words: label, text, key phrase.
NOTICES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("apache", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", "licensed under the bsd license", "bsd license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd 4 0"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0", "cc by nc sa 4 0"),
    ("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved", "all rights reserved"),
)
#: Indexed words for each template, and the share of a template's weight that has to agree.
RARE, MATCH = 3, 0.6
_SHIFT = 1 << 40


def with_words(df: DataFrame) -> DataFrame:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = F.translate(F.coalesce("text", F.lit("")), upper, lower)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.array_remove(F.split(text, BREAKS), "").alias("w"))


def weights(words: DataFrame, notices=NOTICES) -> dict[str, float]:
    """Inverse document frequency of every word of the notices over all documents; as many rows come back as there are such words."""
    known = sorted({w for _, text, _ in notices for w in text.split()})
    found = words.select(F.explode(F.array_intersect("w", F.array(*map(F.lit, known)))).alias("word")).groupBy("word").count().collect()
    total, seen = words.count(), {r["word"]: r["count"] for r in found}
    return {w: math.log((total + 1) / (seen.get(w, 0) + 1)) + 1e-9 for w in known}


def index(weight: dict[str, float], notices=NOTICES) -> tuple[dict[str, list[tuple[int, int]]], list[list[tuple[str, float, bool]]]]:
    """Postings of the rarest words, and each template as (word, share of weight, mandatory)."""
    postings: dict[str, list[tuple[int, int]]] = {}
    templates = []
    for t, (_, text, phrase) in enumerate(notices):
        words, key = text.split(), phrase.split()
        at = next(k for k in range(len(words)) if words[k : k + len(key)] == key)
        total = sum(weight[w] for w in words)
        templates.append([(w, weight[w] / total, at <= k < at + len(key)) for k, w in enumerate(words)])
        # indexed are the rarest of the mandatory words: a place that counts has them all
        for word in sorted(dict.fromkeys(key), key=lambda w: (-weight[w], w))[:RARE]:
            postings.setdefault(word, []).append((t, words.index(word, at)))
    return postings, templates


def _literal(templates):
    return F.array(*[F.array(*[F.struct(F.lit(w).alias("word"), F.lit(float(x)).alias("share"), F.lit(m).alias("must")) for w, x, m in one]) for one in templates])


def _starts(key: list[str]):
    """First places of a base phrase among the places (_ends) of its last word, "license" for all of them."""
    n = len(key) - 1

    def stands(i):
        return F.coalesce(functools.reduce(lambda a, b: a & b, [F.get(F.col("w"), i - (n - k)) == key[k] for k in range(n)]), F.lit(False))

    return F.transform(F.filter("_ends", stands), lambda i: i - n)


def _numbered(t: int, starts):
    return F.transform(starts, lambda a: a.cast("long") + F.lit(t * _SHIFT).cast("long"))


def scan(df: DataFrame, notices=NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    words = with_words(df)
    postings, templates = index(weights(words, notices), notices)
    w = F.col("w")
    ends = F.when(F.array_contains(w, "license"), F.filter(F.transform(w, lambda x, i: F.when(x == "license", i)), lambda i: i.isNotNull()))
    words = words.withColumn("_ends", F.coalesce(ends, F.array().cast("array<int>")))
    starts = {label: _starts(phrase.split()) for phrase, label in BASE.items()}
    words = words.withColumns({f"_{label}": c for label, c in starts.items()})
    base = [F.col(f"_{label}") for label in starts]
    words = words.withColumn("_all", F.concat(*base))

    rare = F.array(*map(F.lit, sorted(postings)))
    hits = F.filter(F.transform(w, lambda x, i: F.struct(F.when(F.array_contains(rare, x), x).alias("x"), i.alias("i"))), lambda h: h["x"].isNotNull())
    words = words.withColumn("_hits", F.when(F.arrays_overlap(w, rare), hits))

    def starts_of(word: str, place: int):
        """Where a template would start for each place of one of its words."""
        here = F.filter("_hits", lambda h: (h["x"] == word) & (h["i"] >= place))
        return F.transform(here, lambda h: h["i"] - F.lit(place))

    of: dict[int, list] = {}
    for word, where in postings.items():
        for t, place in where:
            of.setdefault(t, []).append(starts_of(word, place))
    # the intersection of a template's postings, each as one number: template * 2^40 + start
    met = [_numbered(t, functools.reduce(F.array_intersect, lists)) for t, lists in sorted(of.items())]
    words = words.withColumn("_found", F.when(F.col("_hits").isNotNull(), F.concat(*met)).otherwise(F.array().cast("array<bigint>")))
    literal = _literal(templates)

    def judged(c):
        one = F.get(literal, (c / _SHIFT).cast("int"))
        start = F.pmod(c, F.lit(_SHIFT)).cast("int")
        at = lambda x, j: F.coalesce(F.get(w, start + j) == x["word"], F.lit(False))
        must = F.forall(F.transform(one, lambda x, j: ~x["must"] | at(x, j)), lambda ok: ok)
        share = F.aggregate(F.transform(one, lambda x, j: F.when(at(x, j), x["share"]).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)
        return F.when(must, F.struct((c / _SHIFT).cast("int").alias("t"), share.alias("share")))

    words = words.withColumn("_kept", F.filter(F.transform("_found", judged), lambda x: x.isNotNull()))
    label_of = F.array(*[F.lit(label) for label, _, _ in notices])
    own = F.transform(F.filter("_kept", lambda x: x["share"] >= MATCH), lambda x: F.get(label_of, x["t"]))
    base_labels = F.array_compact(F.array(*[F.when(F.size(f"_{label}") > 0, F.lit(label)) for label in starts]))
    best = F.coalesce(F.array_max(F.transform("_kept", lambda x: x["share"])), F.lit(0.0))
    return words.select(
        "doc_id",
        F.size(w).cast("long").alias("n_words"),
        F.size("_all").cast("long").alias("n_base"),
        F.array_min("_all").cast("long").alias("first_word"),
        F.array_max("_all").cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, own))), ",").alias("labels"),
        F.when(F.size("_all") > 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), best)).alias("score"),
    )
