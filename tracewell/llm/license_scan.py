"""License scans by diagonal voting (operator 8), native.

Texts are cut into lower-case words, and every pair of neighbouring words is hashed. Pairs whose hash occurs in a
template are joined to the template positions that have it (and compared word by word there), which gives votes for
diagonals: document position less template position. Votes are counted by document, template and diagonal. A phrase
is found where one diagonal has all its pairs. For longer templates, neighbouring diagonals are merged (words put in
or left out shift the diagonal), and a merged span is verified: enough of the template's pairs, at a density that
scattered words do not reach. The templates are a fixed table of a few hundred pairs, so it is always broadcast.

Defined results: a null or empty text has no words, no places and no labels. Texts of any length are scanned whole.
Rows are told apart by a number of their own, so repeated rows and repeated or null ids are scanned each on their own.
Of equal spans all count. An empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import cut, lower_ascii

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The phrases and labels of the base scan.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Opening words of public license notices, and the labels that voting adds.
NOTICES = {
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-notice",
    "this work is licensed under the gnu general public license version 3": "gpl-statement",
    "licensed under the apache license version 2 0": "apache-statement",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-notice",
    "released under the mit license": "mit-statement",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-notice",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc-notice",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-notice",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
}
#: Diagonals at most this far apart are merged; a span needs this share of the template's pairs (all of them for a
#: template of fewer than WHOLE pairs), and as many as this share of its own words.
MERGE, SHARE, WHOLE, DENSITY = 3, 0.75, 8, 0.5


def templates(docs: DataFrame) -> DataFrame:
    """One row for each pair of each template: template, label, base, size (pairs), t (position), hash, first, second."""
    rows = []
    for n, (text, label) in enumerate([*BASE.items(), *NOTICES.items()]):
        words = text.split()
        rows += [(n, label, n < len(BASE), len(words) - 1, t, a, b) for t, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    out = docs.sparkSession.createDataFrame(rows, "template int, label string, base boolean, size int, t int, first string, second string")
    return out.withColumn("hash", F.xxhash64("first", "second"))


def word_pairs(docs: DataFrame, hashes: list[int], id_column: str = "doc_id") -> DataFrame:
    """row, id, n_words and ``hits``: the places of word pairs with a wanted hash, and their words."""
    words = F.filter(F.split(lower_ascii(F.coalesce("text", F.lit(""))), SEPARATORS), lambda w: w != "")
    step = docs.select(F.monotonically_increasing_id().alias("row"), id_column, words.alias("words"))
    rest = F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0)))
    step = step.select("row", id_column, "words", F.size("words").cast("long").alias("n_words"), F.zip_with("words", rest, lambda a, b: F.xxhash64(a, b)).alias("h"))
    step = step.select("row", id_column, "words", "n_words", F.array_compact(F.transform("h", lambda x, i: F.when(x.isin(hashes), F.struct(i.alias("p"), x.alias("hash"))))).alias("at"))
    hits = F.transform("at", lambda a: F.struct(a["p"].cast("long").alias("p"), a["hash"].alias("hash"), F.get("words", a["p"]).alias("first"), F.get("words", a["p"] + 1).alias("second")))
    return step.select("row", id_column, "n_words", hits.alias("hits"))


def spans(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Verified spans: row, template, label, base, start, score."""
    hits = pairs.select("row", F.explode("hits").alias("hit")).select("row", "hit.*")
    votes = hits.join(F.broadcast(table), ["hash", "first", "second"]).withColumn("diagonal", F.col("p") - F.col("t"))
    of = ["row", "template", "label", "base", "size"]
    diagonals = votes.groupBy(*of, "diagonal").agg(F.count("*").alias("votes"), F.collect_set("t").alias("seen"), F.min("p").alias("low"), F.max("p").alias("high"))
    phrases = diagonals.where("base and votes = size").select("row", "template", "label", "base", F.col("diagonal").alias("start"), F.lit(1.0).alias("score"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > MERGE).cast("int"), F.lit(1))
    merged = diagonals.where("not base").withColumn("apart", apart).withColumn("span", F.sum("apart").over(along))
    found = merged.groupBy(*of, "span").agg(F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("pairs"), F.min("low").alias("start"), (F.max("high") + 2 - F.min("low")).alias("words"))
    least = F.when(F.col("size") < WHOLE, F.col("size")).otherwise(SHARE * F.col("size"))
    found = found.where((F.col("pairs") >= least) & (F.col("pairs") >= DENSITY * F.col("words")))
    return phrases.unionByName(found.select("row", "template", "label", "base", "start", (F.col("pairs") / F.col("size")).alias("score")))


def scan(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    table = templates(docs)
    hashes = [r["hash"] for r in table.select("hash").distinct().collect()]  # of the fixed templates
    pairs = cut(word_pairs(docs, hashes, id_column))
    joined = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c)))
    by_row = spans(pairs, table).groupBy("row").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        joined("label").alias("labels"),
        F.max("score").alias("score"),
    )
    out = pairs.drop("hits").join(by_row, "row", "left")
    nothing = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    return out.select(id_column, "n_words", *[F.coalesce(c, nothing[c]).alias(c) if c in nothing else c for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")])
