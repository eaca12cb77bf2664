"""Licence scan through a positional index of rare template words, in DataFrame functions only."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text


class Template(NamedTuple):
    label: str
    base: bool
    text: str  # words of the template
    key: str  # the mandatory phrase inside it


# The phrases asked for, then further notices.
TEMPLATES = [
    Template("mit", True, "under the mit license", "under the mit license"),
    Template("apache-2", True, "apache license version 2", "apache license version 2"),
    Template("cc-by-nc", True, "cc by nc", "cc by nc"),
    Template("apache-2", False, "licensed under the apache license version 2 0 the license you may not use this file "
             "except in compliance with the license", "under the apache license version 2"),
    Template("bsd", False, "redistribution and use in source and binary forms with or without modification are permitted",
             "redistribution and use in source and binary forms"),
    Template("cc-by-sa", False, "licensed under cc by sa", "cc by sa"),
    Template("gpl-2", False, "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-3", False, "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("lgpl", False, "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("mit", False, "permission is hereby granted free of charge to any person obtaining a copy of this software",
             "permission is hereby granted free of charge to any person"),
    Template("mpl-2", False, "subject to the terms of the mozilla public license version 2 0", "mozilla public license version 2"),
]
# everything but 0-9, a-z and non-ASCII characters
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of the text with A-Z in lower case.

    ``lower`` also changes other letters, which stay non-ASCII word characters either way; the two that would turn
    into ASCII letters (Kelvin sign, dotted capital I) are replaced before.
    """
    safe = F.replace(F.replace(text, F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ı"))
    return F.array_remove(F.split(F.lower(safe), SEPARATORS, -1), "")


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def anchors(docs: DataFrame, templates: list[Template]) -> list[tuple[int, int]]:
    """For each template the positions in its key phrase of the two words with the highest IDF in ``docs``.

    Document frequencies are counted over all documents, for the words of the key phrases only, so what reaches the
    driver is bounded by the list of templates.
    """
    vocabulary = sorted({w for t in templates for w in t.key.split()})
    found = (
        docs.select(F.explode(F.array_intersect(words(F.col("text")), _strings(vocabulary))).alias("word"))
        .groupBy("word").count().collect())
    frequency = {r["word"]: r["count"] for r in found}
    idf = {w: -math.log1p(frequency.get(w, 0)) for w in vocabulary}  # up to a constant
    picked = []
    for t in templates:
        key = t.key.split()
        first, second = sorted({w: i for i, w in reversed(list(enumerate(key)))}.items(), key=lambda x: (-idf[x[0]], -len(x[0]), x))[:2]
        picked.append((first[1], second[1]))
    return picked


def license_places(docs: DataFrame, templates: list[Template] = TEMPLATES, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, places`` with places ``label, base, at, share``.

    A place is where the rarest word of a key phrase stands, the second rarest stands at the right distance, and the
    whole phrase is then verified; ``at`` is the word number where the phrase starts (from 0), ``share`` the part of
    the template's words found at their relative positions. Null text is empty; repeated rows are scanned each;
    nothing is shuffled but the word frequencies.
    """
    base = id_text(docs, id_col, text_col)
    index, rare = [], set()
    for t, (i, j) in zip(templates, anchors(base, templates)):
        text, key = t.text.split(), t.key.split()
        shift = next(s for s in range(len(text)) if text[s:s + len(key)] == key)
        rare.add(key[i])
        index.append(F.struct(
            F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), _strings(text).alias("text"), _strings(key).alias("key"),
            F.lit(shift).alias("shift"), F.lit(key[i]).alias("rarest"), F.lit(i).alias("i"), F.lit(key[j]).alias("second"),
            F.lit(j).alias("j")))
    rarest = _strings(sorted(rare))
    one = base.select("doc_id", words(F.col("text")).alias("w"))
    w = F.col("w")
    hits = F.when(F.arrays_overlap(w, rarest), F.filter(
        F.transform(w, lambda x, i: F.struct(x.alias("word"), i.alias("i"))), lambda h: F.array_contains(rarest, h["word"])))
    two = one.select("doc_id", "w", F.size(w).cast("long").alias("n_words"), hits.alias("hits"))

    def places(t: Column) -> Column:
        starts = F.transform(F.filter("hits", lambda h: h["word"] == t["rarest"]), lambda h: h["i"] - t["i"])
        whole = F.filter(starts, lambda at: (at >= 0) & (F.get(w, at + t["j"]) == t["second"]) & (F.slice(w, at + 1, F.size(t["key"])) == t["key"]))
        return F.transform(whole, lambda at: F.struct(
            t["label"].alias("label"), t["base"].alias("base"), at.cast("long").alias("at"), share(t, at).alias("share")))

    def share(t: Column, at: Column) -> Column:
        same = F.filter(t["text"], lambda x, k: F.coalesce(F.get(w, at - t["shift"] + k) == x, F.lit(False)))
        return F.size(same) / F.size(t["text"])

    found = F.when(F.col("hits").isNotNull(), F.flatten(F.transform(F.array(*index), places)))
    empty = F.array().cast("array<struct<label: string, base: boolean, at: bigint, share: double>>")
    return two.select("doc_id", "n_words", F.coalesce(found, empty).alias("places"))


def license_labels(places: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` from ``license_places``."""
    base = F.filter("places", lambda p: p["base"])
    names = lambda p: F.array_join(F.array_sort(F.array_distinct(p["label"])), ",")
    return places.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base["at"]).alias("first_word"),
        F.array_max(base["at"]).alias("last_word"), names(base).alias("base_labels"), names(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.col("places")["share"]), F.lit(0.0)).alias("score"))
