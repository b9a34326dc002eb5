"""License scan by a positional rare-token index. DataFrame functions only.

One pass over the texts keeps the places of each file's licence words (words of the templates), from which all
else follows. Every licence template is a word sequence with a mandatory key phrase inside it. The index
has a posting (template, position) for the rarest word (highest IDF over all documents) of each
key phrase. A file's words are looked up there; each place of such a word proposes a template at a relative position
(file position less template position). There the postings of the other words must meet at the same relative
position: first those of the key phrase, all of them, so no place is missed, then enough of the template's IDF
weight. All this happens inside the file's own row: no explosion, no join, and copies do not meet.

Words: A-Z lower-cased, then [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. Base labels are places
where a base phrase's words stand consecutively; the index adds labels, base ones stay.

Rules: null and empty texts have no words, no labels and score 0; null ids are kept; every row of
the input gives one row (equal texts give equal rows); texts of any length are read whole; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table

# Base phrases and their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
# Label, notice words, mandatory key phrase.
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "you may not use this file except in compliance with the license", "except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("bsd", "released under the bsd license", "bsd license"),
    ("mpl", "subject to the terms of the mozilla public license version 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc0", "dedicated to the public domain under cc0 1 0", "public domain"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "to deal in the software without restriction"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain the above copyright notice"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "distributed under the license is distributed on an as is basis"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "under the terms of the gnu general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one", "a copy of the mpl was not distributed with this file"),
    ("proprietary", "all rights reserved no part may be reproduced without permission", "all rights reserved"),
]
#: Share of a template's IDF weight that must meet at one relative position.
LEAST = 0.6

#: The class of a word, listed so that Java tests a table first; possessive.
RUN = r"[0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz\x{80}-\x{10FFFF}]++"


def folded(text: Column) -> Column:
    """A-Z lower-cased and nothing else: lower() also turns two other letters into ASCII ones."""
    return F.when(text.rlike("[Kİ]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(RUN), F.lit(0))


def vocabulary() -> list[str]:
    return sorted({w for _, notice, _ in TEMPLATES for w in notice.split()})


def places(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """__id, n_words, hits (places and licence words, in order) of every row: a table in the shared folder."""
    vocab = vocabulary()
    rows = df.select(F.col(id_col).alias("__id"), words(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("w"))
    seen = F.transform("w", lambda w, i: F.when(w.isin(vocab), F.struct(i.alias("at"), w.alias("w"))))
    rows = rows.select("__id", F.size("w").cast("long").alias("n_words"), F.filter(seen, lambda x: x.isNotNull()).alias("hits"))
    return table(df.sparkSession, rows, "places")


def weights(rows: DataFrame) -> dict[str, float]:
    """IDF of each licence word over all rows of places()."""
    held = F.concat(F.array(F.lit("")), F.array_distinct(F.transform("hits", lambda h: h["w"])))
    found = {r.w: r.n for r in rows.select(F.explode(held).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    total = found.get("", 0)
    return {w: math.log((1 + total) / (1 + found.get(w, 0))) + 1e-3 for w in vocabulary()}


def index(idf: dict[str, float]) -> Column:
    """The postings, as a constant: each template under its rarest key word, with its words relative to that one, key words first."""
    postings = []
    for label, notice, phrase in TEMPLATES:
        notice, phrase = notice.split(), phrase.split()
        first = next(i for i in range(len(notice)) if notice[i : i + len(phrase)] == phrase)
        keys = range(first, first + len(phrase))
        at = max(keys, key=lambda i: (idf[notice[i]], -i))
        cells = [{"w": w, "off": i - at, "idf": idf[w]} for i, w in enumerate(notice)]
        postings.append({"w": notice[at], "label": label, "keys": [cells[i] for i in keys], "notice": cells, "whole": sum(idf[w] for w in notice)})
    cell = "array<struct<w: string, off: int, idf: double>>"
    return F.from_json(F.lit(json.dumps(postings)), f"array<struct<w: string, label: string, keys: {cell}, notice: {cell}, whole: double>>")


def verified(hits: Column, postings: Column, proposing: list[str], least: float = LEAST) -> Column:
    """Array of (label, share) of the templates that stand in a file, once a place."""

    def stands(h: Column, j: Column, x: Column) -> Column:
        """Whether the template's word stands at its relative position; it is among as many hits as its distance says."""
        near = F.slice(hits, F.greatest(j + 1 + F.least(x["off"], F.lit(0)), F.lit(1)), F.abs(x["off"]) + 1)
        return F.exists(near, lambda n: (n["at"] == h["at"] + x["off"]) & (n["w"] == x["w"]))

    def weigh(h: Column, j: Column, t: Column) -> Column:
        met = F.aggregate(t["notice"], F.lit(0.0), lambda met, x: met + F.when(stands(h, j, x), x["idf"]).otherwise(F.lit(0.0)))
        return F.struct(t["label"].alias("label"), (met / t["whole"]).alias("share"))

    def propose(h: Column, j: Column) -> Column:
        fit = F.filter(postings, lambda t: (t["w"] == h["w"]) & F.forall(t["keys"], lambda x: stands(h, j, x)))
        return F.when(h["w"].isin(proposing), F.filter(F.transform(fit, lambda t: weigh(h, j, t)), lambda r: r["share"] >= least))

    return F.flatten(F.filter(F.transform(hits, propose), lambda x: x.isNotNull()))


def base_places(hits: Column, phrase: str) -> Column:
    """First words' places of a base phrase; its words are licence words, so they are neighbours among the hits."""
    rest = list(enumerate(phrase.split()))[1:]

    def here(h: Column, j: Column) -> Column:
        out = h["w"] == phrase.split()[0]
        for i, w in rest:
            out = out & F.coalesce((F.get(hits, j + i)["w"] == w) & (F.get(hits, j + i)["at"] == h["at"] + i), F.lit(False))
        return F.when(out, h["at"])

    return F.filter(F.transform(hits, here), lambda x: x.isNotNull())


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of df: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = places(df, id_col, text_col)
    idf = weights(rows)
    proposing = sorted({max(phrase.split(), key=lambda w: (idf[w], -phrase.split().index(w))) for _, _, phrase in TEMPLATES})
    hits = F.col("hits")
    # Base phrases need the word, so the other files' hits are not walked again.
    has = F.exists(hits, lambda h: h["w"] == "license")
    none = F.array().cast("array<int>")
    rows = rows.withColumn("__base", F.array(*[F.when(has, base_places(hits, p)).otherwise(none) for p, _ in BASE]))
    rows = rows.withColumn("__all", F.flatten("__base")).withColumn("__found", verified(hits, index(idf), proposing))
    base = F.array_compact(F.array(*[F.when(F.size(F.col("__base")[i]) > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]))
    labels = F.array_sort(F.array_union(base, F.transform("__found", lambda r: r["label"])))
    best = F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform("__found", lambda r: r["share"])), F.lit(0.0)))
    return rows.select(
        F.col("__id").alias(id_col), "n_words", F.size("__all").cast("long").alias("n_base"),
        F.array_min("__all").cast("long").alias("first_word"), F.array_max("__all").cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size("__all") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
