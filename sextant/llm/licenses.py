"""License scans: fixed phrases, and an exact set-similarity join with notice templates.

The join finds every text block that holds at least ``THRESHOLD`` of a template's words. A
block is a line, or a window of two of the longest templates; windows overlap by half and
are cut from long lines and from all words of the text, so that any notice, however it is
wrapped over lines, lies whole in one of them. Words are
ordered by the number of documents that hold them, rarest first, over the whole table.
A template of t words, c of which are needed, and a block that holds c of them share one of
the template's t - c + 1 rarest words (prefix filter). Blocks of fewer template words than
the least c are left out (length filter), and so are meetings after which too few words are
left on either side (positional filter). What meets on an equal word is verified exactly. A
template whose words all belong to a longer matching one of another label does not count,
and one that another label's template would nearly match needs a word that sets it apart.

All rows of a document come from one scan and are pre-aggregated where they are made, so a
hot source or many copies cost no more than their share.

Cases: a null text is empty; an empty one has no words and the score 0; a label is listed
once however often it occurs; repeated rows give equal rows, each its own; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.columns import ascii_lower, let, literals, words

# --- fixed values: word breaks after lower-casing, and the base phrases with their labels ---
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices with their labels.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "dedicated to the public domain under the creative commons cc0 1 0 universal"),
    ("proprietary", "all rights reserved no part of this work may be reproduced without permission"),
)
THRESHOLD = 0.8


def _phrase_starts(tokens: Column, phrase: str) -> Column:
    parts = phrase.split(" ")
    rare = max(parts, key=len)

    def here(i: Column) -> Column:
        same = F.get(tokens, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            same = same & (F.get(tokens, i + k) == part)
        return F.coalesce(same, F.lit(False))

    found = F.filter(F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0))), here)
    return F.when(F.array_contains(tokens, rare), found).otherwise(F.array().cast("array<int>"))


def _blocks(lowered: Column, tokens: Column, width: int) -> Column:
    """Word lists of the lines and of the whole text, long ones as overlapping windows."""

    def cut(line: Column) -> Column:
        step = width // 2
        windows = F.transform(
            F.sequence(F.lit(0), F.ceil((F.size(line) - width) / step).cast("int")), lambda i: F.slice(line, i * step + 1, width)
        )
        return F.when(F.size(line) <= width, F.array(line)).otherwise(windows)

    lines = F.flatten(F.transform(F.split(lowered, "\n"), lambda line: let(words(line, BREAKS), cut)))
    return F.concat(lines, cut(tokens))


def word_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' words, those of the fewest documents first.

    The result has one row for each word of the templates, however many documents there are.
    """
    tokens = words(ascii_lower(F.coalesce("text", F.lit(""))), BREAKS)
    held = docs.select(F.explode(F.array_intersect(literals(vocabulary), tokens)).alias("word"))
    counts = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: word and phrase counts, first and last start, labels and the best containment."""
    notices = [(label, frozenset(text.split(" "))) for label, text in templates]
    width = 2 * max(len(text.split(" ")) for _, text in templates)
    needed = {n: max(1, math.ceil(threshold * len(n[1]) - 1e-9)) for n in notices}
    order = word_order(docs, sorted(set().union(*(n[1] for n in notices))))
    rank = {w: k for k, w in enumerate(order)}
    spark = docs.sparkSession

    # templates by the words of their prefixes: a fixed, small table
    rows = []
    for k, notice in enumerate(notices):
        label, held = notice
        by_rank = sorted(held, key=rank.get)
        rivals = [sorted(held - o[1]) for o in notices if o[0] != label and held - o[1] and len(held & o[1]) >= needed[notice]]
        longer = [(sorted(o[1]), needed[o]) for o in notices if o[0] != label and held < o[1]]
        for at, word in enumerate(by_rank[: len(held) - needed[notice] + 1]):
            rows.append((word, k, label, at, len(held), needed[notice], by_rank, longer, rivals))
    prefixes = spark.createDataFrame(
        rows,
        "word string, template int, label string, t_at int, t_size int, needed int, t_words array<string>, "
        "longer array<struct<words: array<string>, needed: int>>, rivals array<array<string>>",
    )
    least = min(needed.values())
    prefix_words = sorted({r[0] for r in rows})

    lowered = F.col("lowered")
    tokens = F.col("tokens")
    starts = [_phrase_starts(tokens, p) for p in PHRASES]
    read = docs.select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("lowered")
    ).withColumn("tokens", words(lowered, BREAKS))
    blocks = F.filter(
        F.array_distinct(F.transform(_blocks(lowered, tokens, width), lambda b: F.array_intersect(literals(order), b))),
        lambda b: F.size(b) >= least,
    )
    base = read.select(
        "row_id",
        "doc_id",
        F.size(tokens).alias("n_words"),
        *[s.alias(f"p{k}") for k, s in enumerate(starts)],
        F.when(F.arrays_overlap(tokens, literals(prefix_words)), blocks).alias("blocks"),
    )
    each = base.withColumn("block", F.explode_outer("blocks")).drop("blocks")
    met = (
        each.withColumn("meeting", F.explode_outer(F.transform(F.slice("block", 1, F.greatest(F.size("block") - least + 1, F.lit(1))), lambda w, i: F.struct(w.alias("word"), i.alias("b_at")))))
        .withColumn("word", F.col("meeting.word"))
        .join(prefixes, "word", "left")
    )
    left_over = F.least(F.size("block") - F.col("meeting.b_at"), F.col("t_size") - F.col("t_at"))
    shared = F.size(F.array_intersect("block", "t_words"))
    covered = F.exists("longer", lambda o: F.size(F.array_intersect(F.col("block"), o["words"])) >= o["needed"])
    apart = F.forall("rivals", lambda r: F.arrays_overlap(r, F.col("block")))
    fits = (F.size("block") >= F.col("needed")) & (left_over >= F.col("needed")) & (shared >= F.col("needed")) & apart & ~covered
    hit = met.withColumn("hit", F.coalesce(fits, F.lit(False)))
    phrases = [f"p{k}" for k in range(len(starts))]
    return (
        hit.groupBy("row_id")
        .agg(
            *[F.first(c).alias(c) for c in ("doc_id", "n_words", *phrases)],
            F.collect_set(F.when(F.col("hit"), F.col("label"))).alias("found"),
            F.max(F.when(F.col("hit"), shared / F.col("t_size"))).alias("containment"),
        )
        .withColumn("starts", F.concat(*phrases))
        .withColumn(
            "base", F.array_sort(F.array_compact(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for p, label in zip(phrases, PHRASES.values())])))
        )
        .select(
            "doc_id",
            F.col("n_words").cast("long").alias("n_words"),
            F.size("starts").cast("long").alias("n_base"),
            F.array_min("starts").cast("long").alias("first_word"),
            F.array_max("starts").cast("long").alias("last_word"),
            F.array_join("base", ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_union("base", "found")), ",").alias("labels"),
            F.greatest(F.coalesce("containment", F.lit(0.0)), F.when(F.size("starts") > 0, 1.0).otherwise(0.0)).alias("score"),
        )
    )
