"""License scans by diagonal voting: word k-gram hashes joined to template places, votes per diagonal, bands aligned in order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hotspan.storage import write_once

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 2

# Phrases that name a license wherever their words stand consecutively, with labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Opening passages of public licenses and common license lines, with labels of this method.
PASSAGES = [
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
     " documentation files, to deal in the software without restriction, including without limitation the rights to use,"
     " copy, modify, merge, publish, distribute, sublicense, and or sell copies of the software"),
    ("apache-text", "Licensed under the Apache License, Version 2.0, you may not use this file except in compliance with the"
     " license. You may obtain a copy of the license at"),
    ("apache-text", "Unless required by applicable law or agreed to in writing, software distributed under the license is"
     " distributed on an as is basis, without warranties or conditions of any kind, either express or implied"),
    ("gpl-text", "This program is free software: you can redistribute it and or modify it under the terms of the GNU General"
     " Public License as published by the Free Software Foundation"),
    ("lgpl-text", "GNU Lesser General Public License"),
    ("agpl-text", "GNU Affero General Public License"),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
     " that the following conditions are met"),
    ("isc-text", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is"
     " hereby granted"),
    ("mpl-text", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("unlicense-text", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-text", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
]

# Diagonals of one template at most this far apart, and at most STRETCH - 1 template lengths, belong to one band: a passage
# with so many words put in or left out.
DRIFT = 24
# A passage counts when this share of its template's k-grams stands in order within so many template lengths.
COVERAGE, STRETCH = 0.75, 1.5
# Of a template with fewer k-grams than this, all must vote.
SHORT = 8


def words_of(text: Column) -> Column:
    """Lower-case words of a text. The one non-ASCII letter whose lower case is an ASCII letter is kept from turning into it."""
    kept = F.when(F.contains(text, F.lit("K")), F.replace(text, F.lit("K"), F.lit("ĸ"))).otherwise(text)
    return F.regexp_extract_all(F.lower(kept), F.lit(WORD), F.lit(0))


def templates(spark: SparkSession, phrases: dict[str, str] = PHRASES, passages=PASSAGES, k: int = K) -> DataFrame:
    """One row per k-gram of a template: gram, place in the template, template number, label, kind, number of grams.

    The templates are parameters of the call, so the size of this table does not depend on the documents.
    """
    rows = []
    for number, (label, content, base) in enumerate(
            [(label, content, True) for content, label in phrases.items()] + [(*p, False) for p in passages]):
        words = re.findall(WORD, content.lower())
        for place in range(len(words) - k + 1):
            rows.append((" ".join(words[place:place + k]), place, number, label, base, len(words) - k + 1))
    grams = spark.createDataFrame(rows, "t_gram string, place int, template int, label string, base boolean, grams int")
    return grams.withColumn("t_hash", F.xxhash64("t_gram"))


def license_votes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", patterns: DataFrame | None = None,
                  k: int = K) -> DataFrame:
    """(row, doc_id, n_words, template, ..., diagonal, votes, places): one row per document and diagonal with a vote.

    All rolling k-gram hashes of a document are joined to the template positions; equal hashes are confirmed by the
    words themselves. A diagonal holds every template place at most once, so ``places`` is no longer than the template. Every document also carries one entry that matches a blank template, so that documents
    without any vote stay in the result; its template is -1.
    """
    patterns = templates(docs.sparkSession, k=k) if patterns is None else patterns
    blank = patterns.sparkSession.range(1).select(
        F.lit("").alias("t_gram"), F.lit(0).alias("place"), F.lit(-1).alias("template"), F.lit(None).cast("string").alias("label"),
        F.lit(False).alias("base"), F.lit(0).alias("grams"), F.xxhash64(F.lit("")).alias("t_hash"))
    listed = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                         words_of(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    def gram(i: Column) -> Column:
        return F.concat_ws(" ", *[F.get("w", i + j) for j in range(k)])
    grams = F.when(F.size("w") >= k, F.transform(F.sequence(F.lit(0), F.size("w") - k), gram)).otherwise(F.array().cast("array<string>"))
    entries = listed.select("doc_id", "row", F.size("w").cast("bigint").alias("n_words"),
                            F.posexplode(F.concat(F.array(F.lit("")), grams)).alias("at", "gram"))
    entries = entries.withColumn("hash", F.xxhash64("gram"))
    hits = entries.join(F.broadcast(patterns.unionByName(blank)), (F.col("hash") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")))
    diagonal = (F.col("at") - 1 - F.col("place")).cast("bigint")
    return hits.withColumn("diagonal", diagonal).groupBy(
        "row", "doc_id", "n_words", "template", "label", "base", "grams", "diagonal").agg(
        F.count(F.lit(1)).alias("votes"), F.collect_set("place").alias("places"))


def in_order(hits: Column) -> Column:
    """Length of the longest run of hits (at, down) whose words and template places both go up; ``down`` is minus the place.

    The hits come by ``at`` and ``down``. The state lists, for each length reached, the least place that ends such a run.
    """
    def step(ends: Column, hit: Column) -> Column:
        place = -hit["down"]
        below = F.size(F.filter(ends, lambda e: e < place))
        return F.concat(F.slice(ends, F.lit(1), below), F.array(place),
                        F.slice(ends, below + 2, F.greatest(F.lit(0), F.size(ends) - below - 1)))
    return F.size(F.aggregate(hits, F.array().cast("array<int>"), step))


def license_spans(votes: DataFrame, k: int = K, stretch: float = STRETCH, drift: int = DRIFT) -> DataFrame:
    """(row, template, ..., start, stop, held, coverage): one row per diagonal, merged with the neighbours after it to a band.

    ``held`` counts the different template places that voted in the band, so words that repeat count once. Where they are
    half of the template or more, the band is verified: ``coverage`` is then the share of places that stand in the
    template's order. A band is at most ``stretch`` template lengths long and so is what it collects.
    """
    along = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(0, drift)
    bands = votes.where("template >= 0 and not base").withColumn("band", F.collect_list(F.struct("diagonal", "places")).over(along))
    wide = F.floor((F.col("grams") + k - 1) * F.lit(stretch - 1))
    def hits_of(part: Column) -> Column:
        return F.transform(part["places"], lambda p: F.struct((part["diagonal"] + p).alias("at"), (-p).alias("down")))
    near = F.filter("band", lambda part: part["diagonal"] - F.col("diagonal") <= wide)
    bands = bands.withColumn("hits", F.array_sort(F.flatten(F.transform(near, hits_of))))
    bands = bands.withColumn("held", F.size(F.array_distinct(F.transform("hits", lambda h: h["down"]))))
    agreed = F.when(F.col("held") * 2 >= F.col("grams"), in_order(F.col("hits"))).otherwise(F.col("held"))
    return bands.select("row", "doc_id", "n_words", "template", "label", "grams", F.get("hits", F.lit(0))["at"].alias("start"),
                        (F.element_at("hits", -1)["at"] + k).alias("stop"), "held", (agreed / F.col("grams")).alias("coverage"))


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", coverage: float = COVERAGE,
                  stretch: float = STRETCH, k: int = K) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A phrase stands where one diagonal collects all of its k-grams. A longer passage is found where a band of neighbouring
    diagonals, at most ``stretch`` template lengths long, holds ``coverage`` of its k-grams in order (all of them, if it has
    fewer than ``SHORT``). ``score`` is the largest such share that a document reaches; a phrase gives 1.

    A null or empty text has no words: counts 0, labels empty, score 0. Repeated rows and null ids are rows of their
    own, for rows are told apart by their place in the scan. Only the two named columns are read.
    """
    votes = write_once(license_votes(docs, doc_id, text, k=k))  # small; the texts are read once
    exact = votes.where("base and votes = grams").select(
        "row", "doc_id", "n_words", F.col("label"), F.lit(True).alias("base"), F.col("diagonal").alias("start"), F.lit(1.0).alias("score"),
        F.lit(True).alias("holds"))
    passages = license_spans(votes, k, stretch).select(
        "row", "doc_id", "n_words", F.col("label"), F.lit(False).alias("base"), F.lit(None).cast("bigint").alias("start"),
        F.col("coverage").alias("score"),
        (F.col("coverage") >= F.when(F.col("grams") < SHORT, 1.0).otherwise(coverage)).alias("holds"))
    all_rows = votes.where("template < 0").select(
        "row", "doc_id", "n_words", F.lit(None).cast("string").alias("label"), F.lit(False).alias("base"),
        F.lit(None).cast("bigint").alias("start"), F.lit(0.0).alias("score"), F.lit(False).alias("holds"))
    found = all_rows.unionByName(exact).unionByName(passages)
    def listed(keep: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(keep, F.col("label")))), ",")
    return found.groupBy("row", "doc_id", "n_words").agg(
        F.count_if("base").alias("n_base"), F.min("start").alias("first_word"), F.max("start").alias("last_word"),
        listed(F.col("base")).alias("base_labels"), listed(F.col("holds")).alias("labels"), F.max("score").alias("score")).drop("row")
