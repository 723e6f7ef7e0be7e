"""License scans by an exact set-similarity join, in DataFrame functions only.

A text block is a line, or a run of as many consecutive words as the template has, across line breaks, so that a
wrapped notice is one.  It meets a template when it holds at least `THRESHOLD` per cent of the template's distinct
words.  All such pairs are found, none by chance.  For lines:

* only words of templates can count, so a document is reduced to those; a document that holds too few of
  every template's words cannot have a block that meets one, and goes no further;
* the template words are ordered by the number of documents that have them, rarest first, over the whole
  corpus.  A block that holds `need` of a template's n words holds one of its n - need + 1 rarest: the join
  is on this *prefix*, whose words are seldom;
* *length*: a block with fewer than `need` template words is left out; *position*: for a shared prefix word at
  place i of the template and j of the block, at most 1 + min(n - i - 1, m - j - 1) words are shared beyond
  earlier ones, so a pair is kept only where that (with the words before, min(i, j)) reaches `need`;
* what is left is counted in full.

For runs, only documents that hold enough of a template's words as a whole are looked at, and of them the places
of these words.  A word at place p is new to the runs that start behind its last occurrence and reach p, so
the distinct words of all runs are a running sum over the ends of these ranges, two rows a place, whatever the length.

The templates are a fixed list, so their index has a fixed size and is broadcast.  Base phrases are found on the
words of the few documents that hold "license" at all.

Defined results: null and empty texts have no words, labels or places; there is no limit on length; a phrase may
cross lines and punctuation; each row of `docs` gives one row, repeated or not; an empty table gives an empty
result; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Steps

#: Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z, stated on the text as it is.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
THRESHOLD = 80

# Notices of public licenses, as their stewards word them.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
)


def _words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(UPPER, LOWER)))


def _lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _list(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def base_places(words: Column) -> Column:
    """Array of (start, label) of the base phrases in an array of lower-case words."""
    at = F.filter(F.transform(words, lambda w, i: F.when(w == "license", i)), lambda i: i.isNotNull())

    def phrase(i: Column) -> Column:
        before, earlier = F.get(words, i - 1), F.get(words, i - 2)
        place = lambda back, label: F.struct((i - back).cast("long").alias("start"), F.lit(label).alias("label"))
        return F.when(before == "mit", place(1, "mit")).when(before == "apache", place(1, "apache")).when((before == "public") & (earlier == "general"), place(2, "gpl"))

    return F.filter(F.transform(at, phrase), lambda p: p.isNotNull())


def reduced(docs: DataFrame, templates, threshold: int) -> DataFrame:
    """Per document: its base places and, where a template could be met, its lines as sets of template words and the places of these words."""
    sets = [sorted(set(_words_of(text))) for _, text in templates]
    need = [math.ceil(threshold * len(s) / 100) for s in sets]
    vocabulary = sorted(set().union(*sets))
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", words)
    # Words of ASCII letters in another case are folded only where they can matter.
    held = F.array_intersect(F.transform(F.array_distinct("words"), lambda w: F.lower(w)), _list(vocabulary))
    rows = rows.select("row_id", "doc_id", "text", "words", F.size("words").cast("long").alias("n_words"), F.when(F.col("text").rlike("(?i)license"), F.transform("words", _lowered)).alias("folded"), held.alias("held"))
    may = F.lit(False)
    for s, n in zip(sets, need, strict=True):
        may = may | (F.size(F.array_intersect("held", _list(s))) >= n)
    least = min(need)
    line_words = lambda line: F.array_intersect(F.regexp_extract_all(_lowered(line), F.lit(WORD), F.lit(0)), _list(vocabulary))
    blocks = F.filter(F.transform(F.split("text", "\n"), line_words), lambda b: F.size(b) >= least)
    marks = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("pos"), _lowered(w).alias("word"))), lambda m: m["word"].isin(vocabulary))
    none = F.array().cast("array<struct<start:bigint,label:string>>")
    return rows.select(
        "row_id",
        "doc_id",
        "n_words",
        F.coalesce(base_places(F.col("folded")), none).alias("places"),
        F.col("held"),
        F.when(may, blocks).otherwise(F.array().cast("array<array<string>>")).alias("blocks"),
        F.when(may, marks).alias("marks"),
    )


def met_by_runs(rows: DataFrame, templates, threshold: int) -> DataFrame:
    """(row_id, label, containment) of the templates that a run of words meets, by the best run."""
    each = []
    for t, (label, text) in enumerate(templates):
        words = sorted(set(_words_of(text)))
        each.append(F.struct(F.lit(t).alias("t"), F.lit(label).alias("label"), _list(words).alias("words"), F.lit(len(words)).alias("n"), F.lit(math.ceil(threshold * len(words) / 100)).alias("need"), F.lit(len(_words_of(text))).alias("length")))
    marked = rows.where("marks is not null").select("row_id", "marks", F.transform("marks", lambda m: m["word"]).alias("_words"))
    may = F.filter(F.array(*each), lambda t: F.size(F.array_intersect(t["words"], F.col("_words"))) >= t["need"])
    found = marked.select("row_id", "marks", F.explode(may).alias("t")).select("row_id", "marks", "t.*")
    places = found.select("row_id", "t", "label", "n", "need", "length", F.explode(F.filter("marks", lambda m: F.array_contains(F.col("words"), m["word"]))).alias("m"))
    last = F.lag("m.pos").over(Window.partitionBy("row_id", "t", "m.word").orderBy("m.pos"))
    first = F.greatest(last + 1, F.col("m.pos") - F.col("length") + 1)
    ends = places.withColumn("first", first).select(
        "row_id", "t", "label", "n", "need", F.explode(F.array(F.struct(F.col("first").alias("at"), F.lit(1).alias("by")), F.struct((F.col("m.pos") + 1).alias("at"), F.lit(-1).alias("by")))).alias("e")
    )
    held = F.sum("e.by").over(Window.partitionBy("row_id", "t").orderBy("e.at"))
    best = ends.withColumn("held", held).groupBy("row_id", "t", "label", "n", "need").agg(F.max("held").alias("held"))
    return best.where("held >= need").select("row_id", "label", (F.col("held") / F.col("n")).alias("containment"))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: int = THRESHOLD) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, places, and `met`, an array of (label, containment)."""
    spark = docs.sparkSession
    rows = Steps(spark, "licenses").write(reduced(docs, templates, threshold))
    sets = [sorted(set(_words_of(text))) for _, text in templates]
    counted = rows.select(F.explode("held").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()
    # At most as many rows as the templates have words.
    n_docs = {r["word"]: r["n"] for r in counted}
    order = sorted(set().union(*sets), key=lambda w: (n_docs.get(w, 0), w))
    index = []
    for (label, _), words in zip(templates, sets, strict=True):
        ranked = sorted(words, key=order.index)
        need = math.ceil(threshold * len(ranked) / 100)
        index += [(label, ranked, need, i) for i in range(len(ranked) - need + 1)]
    entry = lambda label, ranked, need, i: F.struct(F.lit(label).alias("label"), _list(ranked).alias("words"), F.lit(len(ranked)).alias("n"), F.lit(need).alias("need"), F.lit(i).alias("i"), F.lit(ranked[i]).alias("word"))
    prefix = spark.range(1).select(F.explode(F.array(*[entry(*x) for x in index])).alias("t")).select("t.*")
    # array_intersect keeps the order of its first side: a block's words, rarest first.
    ordered = F.array_intersect(_list(order), F.col("b"))
    blocks = rows.where(F.size("blocks") > 0).select("row_id", F.posexplode("blocks").alias("block", "b")).select("row_id", "block", ordered.alias("held"))
    probes = blocks.select("row_id", "block", "held", F.size("held").alias("m"), F.posexplode("held").alias("j", "word"))
    pairs = probes.join(F.broadcast(prefix), "word").where(
        (F.col("m") >= F.col("need")) & (F.least("i", "j") + 1 + F.least(F.col("n") - F.col("i") - 1, F.col("m") - F.col("j") - 1) >= F.col("need"))
    )
    # Each pair counts at its first shared prefix word only.
    shared = F.array_intersect("words", "held")
    pairs = pairs.where(F.get(shared, F.lit(0)) == F.col("word"))
    met = pairs.where(F.size(shared) >= F.col("need")).select("row_id", "label", (F.size(shared) / F.col("n")).alias("containment"))
    met = met.unionByName(met_by_runs(rows, templates, threshold))
    met = met.groupBy("row_id", "label").agg(F.max("containment").alias("containment")).groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("label", "containment"))).alias("met"))
    out = rows.select("row_id", "doc_id", "n_words", "places").join(met, "row_id", "left")
    return out.select("doc_id", "n_words", "places", F.coalesce("met", F.array().cast("array<struct<label:string,containment:double>>")).alias("met"))
