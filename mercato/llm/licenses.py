"""License scan by diagonal voting over word k-grams."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercato.llm.common import LOWER, UPPER, ascii_lower, whole

#: Runs of ASCII characters that are neither letters nor digits part words.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# The base phrases with their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Opening passages and notices of public licenses, by label.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You "
        "may obtain a copy of the License at",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met",
    ),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0",),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation",
    ),
    "mit": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction",
    ),
}

#: More template grams than this are joined by shuffling instead of being broadcast.
BROADCAST_GRAMS = 200_000
#: A template counts as found from this part of its grams.
FOUND = 0.75


def words_of(text: str) -> list[str]:
    """The words of one template, as :func:`words` makes them."""
    lowered = text.translate(str.maketrans(UPPER, LOWER))
    return [w for w in re.split(SEPARATORS, lowered) if w]


def words(text: Column) -> Column:
    """Words in their own case; folding waits until a gram's hash is known."""
    return F.filter(F.split(text, SEPARATORS), lambda w: w != "")


def template_grams(
    spark: SparkSession, phrases: Mapping[str, str], templates: Mapping[str, Sequence[str]], k: int
) -> DataFrame:
    """A row for each k-gram of each phrase and template: gram, template, label, place, number of grams, whether a base phrase."""
    texts = [(label, text, True) for text, label in phrases.items()]
    texts += [(label, text, False) for label, all_of in templates.items() for text in all_of]
    rows = []
    for number, (label, text, base) in enumerate(texts):
        listed = words_of(text)
        grams = [" ".join(listed[i : i + k]) for i in range(len(listed) - k + 1)]
        if not grams:
            raise ValueError(f"a template needs at least {k} words: {text!r}")
        rows += [(gram, number, label, place, len(grams), base) for place, gram in enumerate(grams)]
    schema = "t_gram string, template int, label string, place int, grams int, base boolean"
    frame = spark.createDataFrame(rows, schema).withColumn("t_hash", F.xxhash64("t_gram"))
    return F.broadcast(frame) if len(rows) <= BROADCAST_GRAMS else frame


def spans(
    docs: DataFrame,
    phrases: Mapping[str, str] = BASE_PHRASES,
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
    k: int = 2,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """Places of phrases and templates: key, text_hash, label, base, start and stop word, coverage.

    Every rolling k-gram of every text meets the template grams by hash, and the gram itself is compared, so a span holds only words that
    are really there. Hits vote for their diagonal (place in the text minus place in the template). A base phrase is a diagonal with all its votes.
    For templates, diagonals at most a few words apart merge, which lets words be added or left out; a merged span counts
    if it covers ``FOUND`` of the template and is not much longer than it.
    """
    words_ = docs.select(F.col(key).alias("key"), F.xxhash64(whole(text)).alias("text_hash"), words(whole(text)).alias("words"))
    tail = lambda w, i: [w, *(F.get("words", i + j) for j in range(1, k))]
    pieces = lambda w, i: [x for j, y in enumerate(tail(w, i)) for x in ([F.lit(" "), y] if j else [y])]
    grams = F.transform("words", lambda w, i: F.concat(*pieces(w, i)))
    rolled = words_.where(F.size("words") >= k).select("key", "text_hash", F.posexplode(grams).alias("at", "gram"))
    known = template_grams(docs.sparkSession, phrases, templates, k)
    hits = rolled.join(
        known, (F.xxhash64(F.lower("gram")) == F.col("t_hash")) & (ascii_lower(F.col("gram")) == F.col("t_gram"))
    )
    of = ["key", "text_hash", "template", "label", "base", "grams"]
    diagonals = (
        hits.groupBy(*of, (F.col("at") - F.col("place")).alias("diagonal"))
        .agg(F.count_distinct("place").alias("votes"), F.min("place").alias("low"), F.max("place").alias("high"))
        .where("not base or votes = grams")
    )
    drift = F.when(F.col("base"), -1).otherwise(F.least(F.lit(3), F.floor(F.col("grams") / 4)))
    order = Window.partitionBy(*of).orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(order) > F.greatest(drift, F.lit(0))
    merged = (
        diagonals.withColumn("new", F.coalesce(far, F.lit(True)).cast("int"))
        .withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*of, "run")
        .agg(
            F.sum("votes").alias("votes"),
            F.min(F.col("diagonal") + F.col("low")).alias("start"),
            F.max(F.col("diagonal") + F.col("high")).alias("last_gram"),
        )
    )
    coverage = F.least(F.lit(1.0), F.col("votes") / F.col("grams"))
    fits = F.col("last_gram") - F.col("start") + 1 <= F.col("grams") * 1.25 + 3
    return merged.where(F.col("base") | ((coverage >= FOUND) & fits)).select(
        "key",
        "text_hash",
        "label",
        "base",
        F.col("start").cast("long").alias("start"),
        (F.col("last_gram") + k).cast("long").alias("stop"),
        coverage.alias("coverage"),
    )


def scan(
    docs: DataFrame,
    phrases: Mapping[str, str] = BASE_PHRASES,
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
    k: int = 2,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the best coverage found, 0 without any. Cases: a null text is empty and has no words; texts shorter than k words have no
    hits; a null id is matched like any other; rows that repeat an id with the same text get the same figures. No rows in, no rows out.
    Only the id and the text are read, so other columns cannot clash.
    """
    found = spans(docs, phrases, templates, k, text, key)
    base_start = F.when(F.col("base"), F.col("start"))
    joined = lambda label: F.array_join(F.array_sort(F.collect_set(label)), ",")
    summary = found.groupBy(F.col("key").alias("__key"), F.col("text_hash").alias("__hash")).agg(
        F.count(base_start).alias("n_base"),
        F.min(base_start).alias("first_word"),
        F.max(base_start).alias("last_word"),
        joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        joined("label").alias("labels"),
        F.max("coverage").alias("score"),
    )
    parts = F.split(whole(text), SEPARATORS)
    edges = (F.get(parts, F.lit(0)) == "").cast("int") + ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    light = docs.select(
        F.col(key), F.xxhash64(whole(text)).alias("text_hash"), (F.size(parts) - edges).cast("long").alias("n_words")
    )
    return light.join(
        summary, F.col(key).eqNullSafe(F.col("__key")) & (F.col("text_hash") == F.col("__hash")), "left"
    ).select(
        key,
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
