"""License scans: MinHash bands over overlapping windows retrieve templates, shingle containment verifies them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binflow.llm.common import letter_words, pieces

#: Notices by license; the last words of a notice may differ, so only their fixed part is here.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "All rights reserved"),
)
#: Words of a window and between the starts of two: a run of up to WINDOW - STRIDE + 1 words lies whole in one.
WINDOW, STRIDE = 8, 4
#: Bands of one MinHash each. A notice's windows share 2/7 of the pairs of words at least where the
#: notice is whole (three words in a window of eight), so a miss has a chance of (5/7)^BANDS = 0.5 %
#: at most from three words on; from seven words on the share is 4/9 and the chance is 0.01 %. A notice of two
#: words is one pair of seven, and its chance is (6/7)^BANDS = 8.5 % where only one window holds it.
BANDS = 16
CONTAINED = 0.9
#: Words of a piece of a long document; a multiple of STRIDE.
PIECE = 1024
#: Words of all templates up to which their bands are broadcast (BANDS rows of some hundred bytes a word).
BROADCAST_WORDS = 100_000


def collision_chance(similarity: float, bands: int = BANDS) -> float:
    """Chance that two windows of this Jaccard similarity share a band."""
    return 1.0 - (1.0 - similarity) ** bands


def _pairs(df: DataFrame, key: Column, text: Column) -> DataFrame:
    """(key, ``_pairs``): hashes of each two neighbouring words of texts that have two at least."""
    words = df.select(key, F.transform(letter_words(text), lambda w: F.xxhash64(w)).alias("_words")).where(F.size("_words") >= 2)
    pairs = F.transform(F.slice("_words", 1, F.size("_words") - 1), lambda w, i: F.xxhash64(w, F.get(F.col("_words"), i + 1)))
    return words.select(*[c for c in words.columns if c != "_words"], pairs.alias("_pairs"))


def _bands(windows: DataFrame) -> DataFrame:
    """The windows at ``_at`` of ``_pairs``, one row per band with its key ``_band``: the least pair hash
    after hashing each pair anew with the band's constant.

    The pairs become columns first and the bands rows, so that the generated code of a key stays small.
    """
    pairs = [f"_p{k}" for k in range(WINDOW - 1)]
    wide = windows.select("*", *[F.get("_pairs", F.col("_at") + k).alias(name) for k, name in enumerate(pairs)])
    masks = F.array(*[F.xxhash64(F.lit(band), F.lit("band")) for band in range(BANDS)])
    each = wide.select("*", F.explode(masks).alias("_mask"))
    # A pair that is missing stays NULL, which least() passes over.
    least = F.least(*[F.when(F.col(name).isNotNull(), F.xxhash64("_mask", name)) for name in pairs])
    return each.select(*windows.columns, F.xxhash64("_mask", least).alias("_band"))


def template_table(spark, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    return spark.createDataFrame(list(templates), "license string, text string")


def scan_licenses(
    docs: DataFrame,
    templates: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    contained: float = CONTAINED,
) -> DataFrame:
    """Licenses whose notices documents hold: one row per document and license.

    Words are lower-cased runs of letters and digits, shingles are pairs of
    neighbouring words. The windows of a document start every STRIDE words, those
    of a template (``license``, ``text``) at every word; windows that share a band
    retrieve a template. It is confirmed when the document's words around the
    window, as far as the template is long on both sides, hold at least
    ``contained`` of the template's distinct shingles. Returns the id, ``license``,
    ``containment`` (the best) and ``first_word`` (position from 0 of the first
    shingle found).

    NULL texts and texts of less than two words hold nothing; templates of less
    than two words are never found. A NULL id groups with other NULL ids; rows of
    one id count as one document. A license may have several templates. Other
    columns are not read. An empty table of documents or templates gives an empty
    table. The bands of the templates are broadcast after their words are counted;
    from BROADCAST_WORDS on, Spark joins by shuffle.
    """
    spark = docs.sparkSession
    templates = template_table(spark) if templates is None else templates
    known = _pairs(templates, F.col("license").alias("_license"), F.col("text"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_pairs") + 1 - WINDOW, F.lit(0)))
    planted = _bands(known.select("_license", "_pairs", F.explode(starts).alias("_at"))).select(
        "_license", F.array_distinct("_pairs").alias("_wanted"), (F.size("_pairs") + 1).alias("_long"), "_band"
    )
    planted = planted.distinct()
    sizes = known.agg(F.sum(F.size("_pairs") + 1).alias("n"), F.max(F.size("_pairs") + 1).alias("most")).first()
    words, most = sizes["n"] or 0, sizes["most"] or 0
    if words <= BROADCAST_WORDS:
        planted = F.broadcast(planted)
    texts = _pairs(docs, F.col(id_col).alias("_id"), F.col(text_col))
    cut = texts.select("_id", F.explode(pieces(F.col("_pairs"), PIECE, most + WINDOW)).alias("_p"))
    starts = F.sequence(F.col("_p.lead"), F.col("_p.lead") + F.col("_p.count") - 1, F.lit(STRIDE))
    windows = cut.select("_id", F.col("_p.words").alias("_pairs"), F.col("_p.from").alias("_from"), F.explode(starts).alias("_at"))
    first = F.greatest(F.col("_at") - F.col("_long"), F.lit(0))
    count = F.least(F.col("_at") + WINDOW + F.col("_long"), F.size("_pairs") + 1) - 1 - first
    found = (
        _bands(windows)
        .join(planted, "_band")
        .select("_id", "_license", "_wanted", (F.col("_from") + first).alias("_first"), F.slice("_pairs", first + 1, count).alias("_around"))
        .withColumn("_both", F.array_intersect("_around", "_wanted"))
        .withColumn("_share", F.size("_both") / F.size("_wanted"))
        .where(F.col("_share") >= contained)
        .withColumn("_word", F.col("_first") + F.array_position("_around", F.get("_both", 0)).cast("int") - 1)
    )
    return (
        found.groupBy("_id", "_license")
        .agg(F.max("_share").alias("containment"), F.min("_word").alias("first_word"))
        .withColumnsRenamed({"_id": id_col, "_license": "license"})
    )
